"""Nearest neighbours by inner product against brute force: skewed norms, several parts, order of probes, odd numbers."""

import itertools
import math

import numpy as np
import pytest

from pagewright.llm import ann


def clustered(rows, dims, spread, seed=6):
    draw = np.random.default_rng(seed)
    v = draw.standard_normal((40, dims))[draw.integers(0, 40, rows)] + spread * draw.standard_normal((rows, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True), draw


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def recall(spark, vectors, probing, k=20):
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]).repartition(4)
    found = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), k, probing=probing).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, got in found.items():
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        assert len(got) == k
        hits += len(got & set(np.argsort(-scores)[:k].tolist()))
    return hits / (k * len(range(0, len(vectors), 20)))


@pytest.mark.parametrize("part_rows", [65_536, 500])
@pytest.mark.parametrize("skew", ["none", "outlier", "lognormal 0.5", "lognormal 1"])
def test_recall_where_norms_differ(spark, skew, part_rows):
    vectors, draw = clustered(4000, 64, 1.5)
    if skew == "outlier":
        vectors[3999] *= 10
    elif skew != "none":
        vectors *= np.exp(float(skew.split()[1]) * draw.standard_normal((len(vectors), 1)))
    assert recall(spark, vectors, ann.Probing(part_rows=part_rows)) >= 0.9


def test_neighbours_at_any_angle_are_found(spark):
    vectors, _ = clustered(3000, 128, 20.0)  # all but orthogonal
    assert recall(spark, vectors, ann.Probing()) >= 0.9


def test_production_parameters_meet_few_rows_where_vectors_cluster():
    draw = np.random.default_rng(8)
    centres = draw.standard_normal((400, 64))
    v = centres[draw.integers(0, 400, 40_000)] + 0.35 * draw.standard_normal((40_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    probing, asked = ann.Probing(), np.arange(0, 1280, 20)
    scores = v @ v[asked].T
    scores[asked, np.arange(len(asked))] = -np.inf
    best = np.argsort(-scores, axis=0)[:20].T
    near = float(np.median(np.take_along_axis(scores.T, best, 1)))
    shares = []
    for probes in probing.ladder:
        plan = ann.Plan(0.0, min(near, 0.95), probes, None)
        met = ann.Part(v, plan, probing).met(v[asked], plan, probing)
        shares.append((np.take_along_axis(met, best, 1).mean(), met.mean()))
        if shares[-1][0] >= probing.recall:
            break
    assert shares[-1][0] >= 0.9 and shares[-1][1] < 0.2


def test_probes_come_in_order_of_success():
    probing = ann.Probing(tables=1, functions=4, width=1.0)
    functions = ann._draw(probing, 9, 1, 4, 0)
    query = np.append(np.random.default_rng(1).standard_normal(8), 0.0)
    query /= np.linalg.norm(query)
    near = 0.6
    a, offsets, multipliers = functions
    mean = near * (query @ a[:, 0])
    base = np.floor(mean + offsets[0])
    phi = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))

    def worth(steps):
        total = 0.0
        for f, step in enumerate(steps):
            low = base[f] + step - offsets[0, f]
            chance = phi((low + 1 - mean[f]) / 0.8) - phi((low - mean[f]) / 0.8)
            total += math.log(chance) - probing.thrift * math.log(phi(low + 1) - phi(low))
        return total

    every = sorted(itertools.product((-1, 0, 1), repeat=4), key=worth, reverse=True)
    want = [int(sum((int(base[f]) + s) * int(multipliers[0, f]) for f, s in enumerate(steps)) + 2**63) % 2**64 - 2**63 for steps in every]
    with np.errstate(over="ignore"):
        assert ann.probe_keys(query[None, :], functions, 0, near, 81, probing)[0].tolist() == want
        assert ann.probe_keys(query[None, :], functions, 0, near, 20, probing)[0].tolist() == want[:20]


def test_huge_and_tiny_numbers_and_ids_with_several_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, -1e199]), (2, [3e-200, 1e-200]), (3, [1.0, 2.0]), (3, [2.0, 1.0]), (4, [-1e250, 0.0]), (20, [1.0, 1.0]), (20, [1.0, 1.5])]
    df = frame(spark, rows)
    found = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [v for v, _ in found[0]] == [1, 3, 20, 2, 4]
    assert found[0][0][1] == math.inf and found[0][-1][1] == -math.inf and [s for _, s in found[0][1:3]] == pytest.approx([3e200, 2.5e200])
    assert [v for v, _ in found[20]] == [0, 1, 3, 2, 4] and found[20][2] == (3, 4.0)


def test_an_id_with_many_vectors_hides_no_others(spark):
    draw = np.random.default_rng(2)
    many = [(7, [1.0, 1.0, float(x)]) for x in draw.uniform(0, 1e-3, 200)]
    others = [(100 + i, [0.5, 0.5 - i / 100, 0.0]) for i in range(30)]
    df = frame(spark, [(20, [1.0, 1.0, 0.0]), *many, *others])
    got = [r.vec_id for r in ann.nearest(df, df.filter("vec_id = 20"), 20).orderBy("rank").collect()]
    assert got == [7, *range(100, 119)]
