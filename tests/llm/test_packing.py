"""The placement rule against trying every level."""

import random

import numpy as np
import pytest

from pagewright.llm import packing


@pytest.mark.parametrize("window", [7, 32, 100])
def test_each_piece_goes_where_the_sum_of_squares_is_least(window):
    draw, emitted = random.Random(window), []
    packer = packing.Packer(emitted.append, window, max_open=10**6)
    placed = 0
    for number in range(1500):
        size = min(3 * window, max(1, round(draw.expovariate(3 / window))))
        before = packer.level[1:window].copy()
        rest = size % window
        options = []
        if rest:
            for fill in range(window - rest + 1):
                if fill == 0 or before[fill - 1] > 0:
                    after = before.copy()
                    if fill:
                        after[fill - 1] -= 1
                    if fill + rest < window:
                        after[fill + rest - 1] += 1
                    options.append(int((after**2).sum()))
        packer.add(number, np.arange(size, dtype=np.uint32))
        now = packer.level[1:window]
        assert (now >= 0).all() and int((now**2).sum()) == (min(options) if options else int((before**2).sum()))
        assert [len(x) for x in packer.open[1:window]] == now.tolist() and packer.count == now.sum()
        placed += size
    packer.close()
    assert sum(len(ids) for pieces in emitted for _, _, ids, _ in pieces) == placed
    assert all(sum(len(ids) for _, _, ids, _ in pieces) in (window, *(1 << b for b in range(7))) for pieces in emitted)


def test_full_lanes_are_settled_by_cutting():
    emitted = []
    packer = packing.Packer(emitted.append, 64, max_open=5)
    for number in range(200):
        packer.add(number, np.arange(33, dtype=np.uint32))
        assert packer.count < 5 and packer.count == packer.level.sum()
    packer.close()
    assert sum(len(ids) for pieces in emitted for _, _, ids, _ in pieces) == 200 * 33


def test_wavelet_look_ups_at_all_places():
    from pagewright.llm import wavelet

    x = np.random.default_rng(4).integers(0, 37, 70_003).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.build(x, [1], [len(x)]))
    for i in [*range(0, 70_003, 997), 65_535, 65_536, 65_537, 70_002]:
        assert m.access(i) == x[i] and m.count(int(x[i]), i) == (x[:i] == x[i]).sum()
    where = np.flatnonzero(x == 36)
    assert [m.find(36, k) for k in range(0, len(where), 41)] == where[::41].tolist()
