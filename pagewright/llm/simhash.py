"""SimHash near-duplicates: one-wildcard segment variants as an index, equality grouping, verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import durable, in_slices, text_or_empty

SHINGLE_WORDS, SEED, BITS = 4, 42, 64
#: Four flipped bits over three segments leave one segment with at most one flip.
MAX_DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str, words_per_shingle: int = SHINGLE_WORDS, chunk: int = 1 << 16) -> int:
    """The 64-bit SimHash of a whole text: a bit is set if over half of the shingles' hashes have it set.

    A-Z are lowered, words are cut at ASCII white space; a text of fewer words than a shingle is one shingle, one
    without words has fingerprint zero. Long texts are counted in chunks, so memory follows the text alone.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    span = min(words_per_shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: len(words) - span + 1]
    ends = ends[span - 1 :]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begins), chunk):
        pairs = zip(begins[at : at + chunk].tolist(), ends[at : at + chunk].tolist(), strict=True)
        hashes = np.array([digest(body[b:e], SEED) for b, e in pairs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row of docs. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in in_slices(batch, "text"):
                found = np.array([fingerprint(t, words_per_shingle) for t in cut.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def wildcard_keys(fp: Column) -> Column:
    """The 64 variant keys of a fingerprint: (wildcard bit, its segment's bits without that one), in one int each."""
    keys = []
    for start, width in SEGMENTS:
        segment = F.shiftrightunsigned(fp, start).bitwiseAND((1 << width) - 1)
        for bit in range(width):
            rest = segment.bitwiseAND(((1 << width) - 1) & ~(1 << bit))
            keys.append((rest + F.lit((start + bit) << 22)).cast("int"))
    return F.array(*keys)


def _first_key(diff: np.ndarray) -> np.ndarray:
    """The first wildcard bit under which two fingerprints that differ by diff meet, or 64."""
    first = np.full(len(diff), BITS, np.int64)
    for start, width in reversed(SEGMENTS):
        part = (diff >> np.uint64(start)) & np.uint64((1 << width) - 1)
        flips = np.bitwise_count(part)
        at = np.where(flips == 0, start, start + np.bitwise_count(part - np.uint64(1) * (part > 0)))
        first = np.where(flips <= 1, at, first)
    return first


def _forest(members: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that join all members of a bucket that links connect: at most one for each member."""
    left = members
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(left ^ node) <= distance
            if near.any():
                found, left = left[near], left[~near]
                yield np.full(len(found), node), found
                queue.extend(found)


#: Buckets up to this size have all their pairs compared at once; larger ones are joined by a spanning forest.
SMALL_BUCKET = 16


def _bucket_edges(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified edges of buckets whose rows stand together; a pair of a small bucket comes from its first key alone."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    for gap in range(1, SMALL_BUCKET):
        at = np.flatnonzero((keys[gap:] == keys[:-gap]) & small[:-gap])
        if not len(at):
            break
        x, y = fps[at], fps[at + gap]
        diff = x ^ y
        near = np.bitwise_count(diff) <= distance
        at, x, y, diff = at[near], x[near], y[near], diff[near]
        first = _first_key(diff) == (keys[at] >> 22)
        a.append(x[first])
        b.append(y[first])
    for k in np.flatnonzero(sizes > SMALL_BUCKET):
        for x, y in _forest(fps[starts[k] : starts[k] + sizes[k]], distance):
            a.append(x)
            b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def links(distinct: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at most `distance` bits apart, enough to connect all that links connect.

    Rows meet by equality of a one-wildcard variant; a bucket of over SMALL_BUCKET fingerprints yields a spanning forest
    instead of its pairs, so edges grow with the members. Buckets hold distinct fingerprints, 8 bytes each.
    """
    if distance > MAX_DISTANCE:
        raise ValueError(f"three segments bear at most {MAX_DISTANCE} differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int32), np.empty(0, np.uint64)

        def made(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        pending, held = [], 0
        for batch in batches:
            k, f = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(k):
                continue
            pending.append((k, f))
            held += len(k)
            if held < 1 << 20 or k[-1] == pending[0][0][0]:
                continue
            keys, fps = (np.concatenate(x) for x in zip(*pending, strict=True))
            whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            yield made(*_bucket_edges(keys[:whole], fps[:whole], distance))
            pending, held = [(keys[whole:], fps[whole:])], len(keys) - whole
        if pending:
            keys, fps = (np.concatenate(x) for x in zip(*pending, strict=True))
            yield made(*_bucket_edges(keys, fps, distance))

    variants = distinct.select("fp", F.explode(wildcard_keys(F.col("fp"))).alias("key"))
    return variants.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an undirected edge list (a, b): root is the least node reachable.

    Large-star and small-star in turn until a round changes nothing; a round ends in the shared folder. Each star step joins the edges with a row per
    node, so the edges of a hot node can be split among tasks.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # pairs hold u > v; large-star looks at all neighbours, small-star at the smaller ones
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        moved = joined.filter("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
        return moved.filter("u <> v").distinct()

    pairs = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark, seen = None, ()
    while seen != mark:
        mark, pairs = seen, durable(star(star(pairs, True), False))
        seen = tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


#: Parts that the fingerprints of one component are dealt to when they learn its least id.
SALTS = 64
#: A fingerprint of more than this share of the rows is hot; so there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1024


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = MAX_DISTANCE, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    Fingerprints link at `distance` or fewer differing bits; component_id is the least doc_id reachable through links.
    Copies are joined as one fingerprint first, so a group of copies costs one row in the index; the few hot fingerprints
    find their class in a broadcast table, whose size is bounded by HOT_SHARE, so their copies stay where they are.
    Null ids take part, but are never a component's id unless it has no other. Empty and null texts have fingerprint
    zero, linked like any other. Repeated rows stay. An empty table gives no rows; other columns are ignored.
    """
    marked = durable(fingerprints(docs, id_col, text_col, words_per_shingle))
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    limit = (distinct.agg(F.sum("copies")).first()[0] or 0) * HOT_SHARE
    roots = components(links(distinct, distance))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    rooted = rooted.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    # a component's least id goes to each of its salts that occurs, so that a giant component is many tasks' work
    salts = rooted.groupBy("root", "salt").agg(F.min("least").alias("least"))
    least = salts.groupBy("root").agg(F.min("least").alias("component_id"), F.collect_set("salt").alias("salts")).select("root", "component_id", F.explode("salts").alias("salt"))
    classes = durable(rooted.join(least, ["root", "salt"]).select("fp", "component_id", (F.col("copies") > limit).alias("hot")))
    hot = F.broadcast(classes.filter("hot").select("fp", "component_id"))
    usual = marked.join(F.broadcast(classes.filter("hot").select("fp")), "fp", "left_anti")
    found = marked.join(hot, "fp").unionByName(usual.join(classes.filter("not hot").drop("hot"), "fp"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
