"""Features of whole texts against a plain version, and trees against node walks."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import boosting, quality


def badness(words):
    if len(words) < 4:
        return 0.0
    strange = sum(w.isupper() and len(w) > 1 for w in words)
    marked = sum(w[-1:] in b"!#$%&*|" for w in words)
    return max(strange, marked, sum(a == b for a, b in zip(words, words[1:]))) / len(words)


def plain(text):
    """The features of one text, word by word."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality.FEATURES)
    n, by = len(raw), Counter(raw)
    kinds = Counter(int(quality._KINDS[c]) for c in raw)
    lines = [x.split() for x in raw.split(b"\n")]
    words = [w for line in lines for w in line]
    m, seen = max(1, len(words)), Counter(words)
    pairs = list(zip(words, words[1:]))
    run = best = 1
    for a, b in pairs:
        run = run + 1 if a == b else 1
        best = max(best, run)
    return [
        np.log1p(n), np.log1p(len(words)), (n - by[32]) / m, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[7] / n,
        kinds[5] / n, by[ord("|")] / n, by[ord("!")] / n, len(seen) / m, max(seen.values(), default=0) / m,
        sum(a == b for a, b in pairs) / m, len(set(pairs)) / m, by[ord(".")] / m, sum(w[-1:] in b"!#$%&*|" for w in words) / m,
        sum(w.isupper() and len(w) > 1 for w in words) / m, np.log1p(len(lines)), len({tuple(x) for x in lines}) / len(lines),
        len(words) / len(lines), np.log1p(best), max(badness(x) for x in lines), sum(len(x) for x in lines if badness(x) >= 0.5) / m,
    ]


def test_features_equal_a_plain_version():
    draw = random.Random(5)
    parts = ["word", "WORD", "Word!", "a", "A", "é", "ÉÀ", "12", "x|", "|", "\n", "\n\n", " ", "\t", "\x0b", " ", "don't", "same same", "SHOUT SHOUT", "$$", "end.", "\x1c", "\x00"]
    texts = [None, "", " ", "\n", "a", "a\n", "\na", "\n\n\n", "same " * 50, *("".join(p + draw.choice(["", " ", "\n"]) for p in draw.choices(parts, k=draw.randint(1, 60))) for _ in range(800))]
    found = quality.statistics(pa.array(texts))
    for k, text in enumerate(texts):
        assert found[k] == pytest.approx(plain(text)), (repr(text), list(zip(quality.FEATURES, found[k], plain(text))))
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(alone, found)
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.FEATURES))


def test_all_rows_walk_the_trees_alike():
    draw = np.random.default_rng(3)
    x = draw.standard_normal((1500, 6)).round(1)
    forest = boosting.fit(x, (x[:, 0] * x[:, 1] > 0.2).astype(float), trees=25)
    walked = []
    for row in x:
        raw = forest.base
        for root in forest.roots:
            k = root
            while forest.feature[k] >= 0:
                k = forest.left[k] if row[forest.feature[k]] <= forest.threshold[k] else forest.right[k]
            raw += forest.value[k]
        walked.append(raw)
    assert forest.raw(x) == pytest.approx(walked)
