"""Hot keys: a text, an id or a fingerprint that a third of the rows share."""

from pagewright.llm import sharding, simhash


def test_hot_and_rare_fingerprints_find_their_class(spark):
    rows = [(i, "one common text of some words" if i % 3 == 0 else f"text number {i} of its own kind {i * i}") for i in range(6000)]
    df = spark.createDataFrame([*rows, (9000, "text number 1 of its own kind 1")], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert len(found) == 6001 and {found[i] for i in range(0, 6000, 3)} == {0} and found[9000] == found[1] == 1


def test_a_shared_id_is_spread_over_the_buckets(spark):
    rows = [(None if i % 3 == 0 else i, f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.assign_shards(df, 4, buckets=16).collect()
    for shard in range(4):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in found if r.doc_id is None}) == 1
