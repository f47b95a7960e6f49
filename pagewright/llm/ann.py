"""Nearest neighbours by multiprobe p-stable hashing: perturbed buckets in estimated success order, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import durable


@dataclass(frozen=True)
class Probing:
    """Parameters of the index."""

    tables: int = 16
    functions: int = 10
    width: float = 2.0
    seed: int = 20
    #: How far a bucket's own share of all vectors counts against it in the order of probes: 0 asks for the fewest
    #: probes, 1 for the fewest rows.
    thrift: float = 0.8
    #: Norms in a band differ by this factor at most; each band is lifted by its upper end. Bands with fewer rows than
    #: `small` in a part are looked at whole.
    band: float = 1.1
    small: int = 256
    #: The least number of probes of `ladder` that finds this share of the sampled queries' neighbours is used for all.
    recall: float = 0.92
    ladder: tuple[int, ...] = (16, 32, 64, 128, 192, 256, 384, 512, 768, 1024, 2048)
    sample: int = 128
    #: Distinct vectors in a part of the index, and queries in a block; both bound what a task holds.
    part_rows: int = 65_536
    block_rows: int = 1_024


_ERF = np.frompyfunc(math.erf, 1, 1)


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(x / math.sqrt(2)).astype(float))


def _draw(probing: Probing, dims: int, tables: int, functions: int, name: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gaussian (2-stable) directions, offsets and key multipliers of all tables: the same on every executor."""
    draw = np.random.default_rng((probing.seed, dims, name))
    shape = (tables, functions)
    return draw.standard_normal((dims, *shape)), draw.random(shape) * probing.width, draw.integers(1, 2**62, shape) | 1


def bucket_keys(vectors: np.ndarray, functions: tuple, probing: Probing) -> np.ndarray:
    """The key of each vector's bucket in each table."""
    a, offsets, multipliers = functions
    cells = np.floor((np.tensordot(vectors, a, axes=1) + offsets) / probing.width).astype(np.int64)
    return (cells * multipliers).sum(axis=2)


#: Chances of a standard normal variable below tenths of it; steps of a probe around the likeliest cell.
_STEPS = np.arange(-1, 2)


def probe_keys(queries: np.ndarray, functions: tuple, table: int, near: float, count: int, probing: Probing) -> np.ndarray:
    """Keys (queries x count) of one table's buckets in estimated order of success, the best first.

    Of a neighbour whose inner product with a unit query is `near`, the projection is normal around near times the
    query's, so the chance of each cell of each function is known; a bucket's is their product. It is weighed against the
    bucket's share of all vectors by `thrift`. The best sums of one logarithm a function are found function by function:
    a prefix outside the best `count` prefixes can't be part of any of them.
    """
    a, offsets, multipliers = (functions[0][:, table], functions[1][table], functions[2][table])
    mean, spread = near * (queries @ a), math.sqrt(1 - near * near)
    base = np.floor((mean + offsets) / probing.width)
    low = (base[:, :, None] + _STEPS) * probing.width - offsets[:, None]
    high = low + probing.width
    chance = _phi((high - mean[:, :, None]) / spread) - _phi((low - mean[:, :, None]) / spread)
    share = _phi(high) - _phi(low)
    logs = np.log(np.maximum(chance, 1e-12)) - probing.thrift * np.log(np.maximum(share, 1e-12))
    steps = (base[:, :, None].astype(np.int64) + _STEPS) * multipliers[:, None]
    scores, keys = np.zeros((len(queries), 1)), np.zeros((len(queries), 1), np.int64)
    for f in range(a.shape[1]):
        scores = (scores[:, :, None] + logs[:, f, None, :]).reshape(len(queries), -1)
        keys = (keys[:, :, None] + steps[:, f, None, :]).reshape(len(queries), -1)
        if scores.shape[1] > count:
            best = np.argpartition(-scores, count - 1, axis=1)[:, :count]
            scores, keys = np.take_along_axis(scores, best, 1), np.take_along_axis(keys, best, 1)
    return np.take_along_axis(keys, np.argsort(-scores, axis=1, kind="stable"), 1)


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two each, so that no product overflows, and the exponents that were taken out."""
    exponents = np.frexp(np.abs(vectors).max(axis=1))[1]
    return np.ldexp(vectors, -exponents[:, None]), exponents


def times_power(values: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # beyond double precision a product is infinite
        return np.ldexp(values, exponents)


def log_norms(vectors: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    return np.log(np.linalg.norm(vectors, axis=1)) + exponents * math.log(2)


def lifted(vectors: np.ndarray, logs: np.ndarray, top: float, probing: Probing) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's band below the largest norm, and the vector on the unit sphere with one more coordinate.

    It is shrunk by the upper end of its band and lifted by the coordinate; the inner product with a unit query, which has
    zero there, then orders the vectors of a band as the true one does.
    """
    step = math.log(probing.band)
    bands = np.maximum(np.floor((top - logs) / step), 0).astype(np.int64)
    shrunk = np.exp(np.minimum(logs - (top - bands * step), 0.0))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return bands, np.column_stack((unit * shrunk[:, None], np.sqrt(np.maximum(0.0, 1 - shrunk**2))))


def unit_queries(vectors: np.ndarray) -> np.ndarray:
    return np.column_stack((vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros(len(vectors))))


@dataclass(frozen=True)
class Plan:
    """What the sampled queries have shown: the inner product at which neighbours are, and how many buckets to visit.

    probes: in each table of a part, or None where the whole part has to be looked at. cells: in the coarse hash that
    deals vectors to parts, or None where all have to be visited.
    """

    top: float
    near: float
    probes: int | None
    cells: int | None


class Part:
    """Vectors of a part and, for each band and table, its buckets."""

    def __init__(self, vectors: np.ndarray, plan: Plan, probing: Probing):
        self.vectors, self.exponents = scaled(vectors)
        self.functions = _draw(probing, vectors.shape[1] + 1, probing.tables, probing.functions, 0)
        self.small, self.bands = np.ones(len(vectors), bool), []
        if plan.probes is None:
            return
        bands, sphere = lifted(self.vectors, log_norms(self.vectors, self.exponents), plan.top, probing)
        for number, rows in zip(*np.unique(bands, return_counts=True), strict=True):
            if rows < probing.small:
                continue
            members = np.flatnonzero(bands == number)
            self.small[members] = False
            keys = bucket_keys(sphere[members], self.functions, probing)
            for t in range(probing.tables):
                order = np.argsort(keys[:, t], kind="stable")
                distinct, starts = np.unique(keys[order, t], return_index=True)
                self.bands.append((t, distinct, np.append(starts, len(order)), members[order]))

    def met(self, queries: np.ndarray, plan: Plan, probing: Probing) -> np.ndarray:
        """Which vectors (columns) each query (rows) meets: those of small bands and of the buckets it visits."""
        out = np.repeat(self.small[None, :], len(queries), axis=0)
        probes, sphere = {}, unit_queries(queries)
        for t, distinct, starts, members in self.bands:
            if t not in probes:
                probes[t] = probe_keys(sphere, self.functions, t, plan.near, plan.probes, probing)
            at = np.minimum(np.searchsorted(distinct, probes[t].ravel()), len(distinct) - 1)
            hit = np.flatnonzero(distinct[at] == probes[t].ravel())
            begin, size = starts[at[hit]], starts[at[hit] + 1] - starts[at[hit]]
            rows = members[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            out[np.repeat(hit // plan.probes, size), rows] = True
        return out


def search_part(vectors: np.ndarray, ids: list[list[int]], queries: np.ndarray, own: list[int], k: int, plan: Plan, probing: Probing, block: int = 64) -> Iterator[tuple]:
    """For each query the best classes of a part among those that it meets: (query, class, exact score).

    ids: the ids of each class of equal vectors; own: each query's id, which is no candidate. As many classes are given as
    hold k other ids; a query that meets too few looks at the whole part.
    """
    part = Part(vectors, plan, probing)
    rows, powers = scaled(queries)
    least = np.array([i[0] for i in ids])
    for at in range(0, len(queries), block):
        some = rows[at : at + block]
        met = part.met(some, plan, probing)
        for i in np.flatnonzero(met.sum(axis=1) <= k):
            met[i] = True
        union = np.flatnonzero(met.any(axis=0))
        together = 8 * met.sum() >= len(union) * len(some)  # one product for the block, or one for each query
        products = part.vectors[union] @ some.T if together else None
        for i, query in enumerate(some):
            found = np.flatnonzero(met[i])
            scores = products[np.searchsorted(union, found), i] if together else part.vectors[found] @ query
            scores = times_power(scores, part.exponents[found] + powers[at + i])
            yield from ((at + i, int(found[j]), exact) for j, exact in _best(scores, found, part, query, powers[at + i], least, ids, own[at + i], k))


def _best(scores: np.ndarray, found: np.ndarray, part: Part, query: np.ndarray, power: int, least: np.ndarray, ids: list[list[int]], own: int, k: int) -> Iterator[tuple[int, float]]:
    """Places in `found` and exact scores of the best classes, as many as hold k ids other than the query's own."""
    wanted = min(len(found), k + 1)
    while True:
        floor = np.partition(scores, len(scores) - wanted)[len(scores) - wanted]
        near = np.flatnonzero(scores >= floor - 1e-12 * (1 + abs(floor)) if np.isfinite(floor) else scores >= floor)
        exact = np.array([_ldexp(math.fsum(part.vectors[found[j]] * query), int(part.exponents[found[j]] + power)) for j in near])
        order = np.lexsort((least[found[near]], -exact))[:wanted]
        seen: set[int] = set()
        for j in order:
            seen.update(ids[found[near[j]]])
        if wanted == len(found) or len(seen - {own}) >= k:
            return ((int(near[j]), float(exact[j])) for j in order)
        wanted = min(len(found), 2 * wanted)


def _ldexp(value: float, exponent: int) -> float:
    try:
        return math.ldexp(value, exponent)
    except OverflowError:
        return math.copysign(math.inf, value)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite parts."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.empty((0, 0))
    flat = lists.flatten()
    return np.asarray(flat).reshape(len(lists), len(flat) // len(lists))


def coarse_functions(rows: int, probing: Probing) -> int:
    """Functions of the hash that deals vectors to parts: a normal projection falls into about e^0.73 cells."""
    return max(0, math.ceil(math.log(max(1, rows) / probing.part_rows) / 0.73))


def coarse_keys(vectors: np.ndarray, functions: int, probing: Probing) -> np.ndarray:
    if not functions:
        return np.zeros(len(vectors), np.int64)
    small, _ = scaled(vectors)
    unit = small / np.linalg.norm(small, axis=1, keepdims=True)
    return bucket_keys(unit, _draw(probing, vectors.shape[1], 1, functions, 1), probing)[:, 0]


def coarse_probes(queries: np.ndarray, functions: int, near: float, count: int, probing: Probing) -> np.ndarray:
    if not functions:
        return np.zeros((len(queries), 1), np.int64)
    small, _ = scaled(queries)
    unit = small / np.linalg.norm(small, axis=1, keepdims=True)
    return probe_keys(unit, _draw(probing, queries.shape[1], 1, functions, 1), 0, near, count, probing)


def sampled_neighbours(classes: DataFrame, asked: list, k: int) -> list:
    """The nearest k rows of each of a few queries among all classes, by looking at every one: (query, vector)."""
    numbers, vectors = [r.id for r in asked], [np.array(r.v, dtype=float) for r in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, powers = scaled(_matrix(batch.column("v")))
            firsts = batch.column("first").to_numpy()
            out: list[tuple[int, float, int]] = []
            for number, vector in zip(numbers, vectors, strict=True):
                query, power = scaled(vector[None, :])
                scores = times_power(rows @ query[0], powers + power[0])
                scores[firsts == number] = -np.inf
                out += [(number, float(scores[j]), j) for j in np.argpartition(-scores, min(k, len(scores)) - 1)[:k]]
            columns = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64()), batch.column("v").take(pa.array([o[2] for o in out]))]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "score", "v"])

    found = classes.select("v", F.col("ids")[0].alias("first")).mapInArrow(run, "query long, score double, v array<double>")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.xxhash64("v"))
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("query", "v").collect()


def largest_log_norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([float(log_norms(*scaled(_matrix(batch.column("v")))).max())])], names=["top"])


def make_plan(classes: DataFrame, queries: DataFrame, dims: int, rows: int, k: int, probing: Probing) -> Plan:
    """Looks at all rows for at most `sample` queries, and takes the fewest probes that would have found their neighbours."""
    mine = classes.filter(F.size("v") == dims)
    asked = queries.filter(F.size("v") == dims).orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).dropDuplicates(["id"]).limit(probing.sample).collect()
    top = mine.select("v").mapInArrow(largest_log_norm, "top double").agg(F.max("top")).first()[0] or 0.0
    found = sampled_neighbours(mine, asked, k) if asked else []
    if not found:
        return Plan(top, 0.5, None, None)
    at = {r.id: i for i, r in enumerate(asked)}
    owner = np.array([at[r["query"]] for r in found])
    near_rows, powers = scaled(np.array([r.v for r in found], dtype=float))
    asking, _ = scaled(np.array([r.v for r in asked], dtype=float))
    _, sphere = lifted(near_rows, log_norms(near_rows, powers), top, probing)
    units = unit_queries(asking)
    near = float(np.clip(np.median((sphere * units[owner]).sum(axis=1)), 0.05, 0.95))
    most = probing.ladder[-1]
    functions = _draw(probing, dims + 1, probing.tables, probing.functions, 0)
    keys = bucket_keys(sphere, functions, probing)
    rank = np.full(len(found), most)
    for t in range(probing.tables):
        probes = probe_keys(units, functions, t, near, most, probing)[owner]
        hit = probes == keys[:, t, None]
        rank = np.minimum(rank, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
    coarse = coarse_functions(rows, probing)
    visited = coarse_probes(asking, coarse, near, most, probing)[owner] == coarse_keys(near_rows, coarse, probing)[:, None]
    cell = np.where(visited.any(axis=1), visited.argmax(axis=1), most)
    half = math.sqrt(probing.recall)
    cells = next((n for n in probing.ladder if (cell < n).mean() >= half), None)
    reached = cell < (cells or most + 1)
    probes = next((n for n in probing.ladder if ((rank < n) & reached).mean() >= probing.recall), None)
    return Plan(top, near, probes, cells)


FOUND = "query_id long, vec_ids array<bigint>, score double"


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", probing: Probing = Probing()) -> DataFrame:
    """Each query's k nearest rows by inner product: query_id, rank (from 1), vec_id, score.

    Equal vectors form a class with its k + 1 least ids (no more can be among the nearest), so a vector that a third of
    the rows share is one row of the index. A coarse hash of the direction deals classes to parts of bounded size, and a
    query goes to the parts of the cells that it visits; inside a part the tables of each band of norms choose the
    candidates. How many cells and buckets are visited is measured on a sample of queries, which look at all rows; where
    the most don't suffice, all are looked at.

    A query's own id is no candidate. An id with several vectors is listed once, with its best score, and asks with all of
    them. Vectors that aren't usable take no part; vectors meet those of equal length alone. Ties go to the lesser id. A
    product beyond double precision is infinite. Null ids take no part; repeated rows count once; empty tables give no
    rows; other columns are ignored.
    """
    def rows(df: DataFrame) -> DataFrame:
        vector = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).distinct()

    among = Window.partitionBy("v").orderBy("id")
    # dense_rank lets repeated rows of one id share a place, so they cannot push other ids out of the class
    classes = rows(embeddings).withColumn("place", F.dense_rank().over(among)).filter(F.col("place") <= k + 1)
    classes = durable(classes.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    asks = durable(rows(queries))
    sizes = {r.d: (r.n, r.q) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).join(asks.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("q")), "d").collect()}
    found = None
    for dims, (held, asked) in sorted(sizes.items()):
        plan = make_plan(classes, asks, dims, held, k, probing)
        some = _search(classes.filter(F.size("v") == dims), asks.filter(F.size("v") == dims), held, asked, k, plan, probing)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pairs = found.select("query_id", F.explode("vec_ids").alias("vec_id"), "score").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(classes: DataFrame, asks: DataFrame, held: int, asked: int, k: int, plan: Plan, probing: Probing) -> DataFrame:
    """The best classes of each query in each part that it visits."""
    coarse = coarse_functions(held, probing)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = coarse_keys(_matrix(batch.column("v")), coarse, probing)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "cell"])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = coarse_probes(_matrix(batch.column("v")), coarse, plan.near, plan.cells, probing)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    index = classes.mapInArrow(keyed, "v array<double>, ids array<bigint>, cell long")
    # a cell of more vectors than a part has is dealt to several, all of which are visited
    counts = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / probing.part_rows).cast("int").alias("subs"))
    index = index.join(counts, "cell").withColumn("sub", F.pmod(F.xxhash64("v"), F.col("subs")).cast("int"))
    if plan.cells is None:
        visits = asks.select("id", "v", F.lit(1).alias("one")).join(counts.select("cell", "subs", F.lit(1).alias("one")), "one")
    else:
        visits = asks.mapInArrow(visiting, "id long, v array<double>, cells array<bigint>").select("id", "v", F.explode("cells").alias("cell")).distinct().join(counts, "cell")
    visits = visits.select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    parts = max(1, -(-held // probing.part_rows))
    blocks = max(1, -(-asked * min(parts, plan.cells or parts) // (parts * probing.block_rows)))
    index = index.select("v", "ids", "cell", "sub", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    visits = visits.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, numbers = left.column("ids").to_pylist(), right.column("id").to_pylist()
            for q, c, score in search_part(_matrix(left.column("v")), ids, _matrix(right.column("v")), numbers, k, plan, probing):
                out.append((numbers[q], ids[c], score))
        columns = [list(x) for x in zip(*out, strict=True)] or [[]] * 3
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.float64())], names=["query_id", "vec_ids", "score"])

    return index.groupBy("cell", "sub", "block").cogroup(visits.groupBy("cell", "sub", "block")).applyInArrow(run, FOUND)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))
