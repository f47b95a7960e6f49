"""Jump consistent hashing: stable keys to shards without a ring table, in Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The multiplier of the published generator, 2862933555777941757, in limbs of 22, 22 and 20 bits.
_MULTIPLIER = 2862933555777941757
_LOW, _MID, _HIGH = _MULTIPLIER & 0x3FFFFF, (_MULTIPLIER >> 22) & 0x3FFFFF, _MULTIPLIER >> 44


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key among `shards`.

    Going from n to n + 1 shards moves a key only into shard n, with probability 1 / (n + 1). The generator's product is
    taken modulo 2^64 in three limbs, because ANSI arithmetic refuses to overflow. Each step's jump exceeds the last, so
    that `shards` steps always suffice.
    """
    if shards < 1:
        raise ValueError("shards must be positive")

    def step(state: Column, _: Column) -> Column:
        low = state["k0"] * _LOW + 1
        mid = state["k1"] * _LOW + state["k0"] * _MID + F.shiftright(low, 22)
        high = state["k2"] * _LOW + state["k1"] * _MID + state["k0"] * _HIGH + F.shiftright(mid, 22)
        k0, k1, k2 = low.bitwiseAND(0x3FFFFF), mid.bitwiseAND(0x3FFFFF), high.bitwiseAND(0xFFFFF)
        top = F.shiftleft(k2, 11).bitwiseOR(F.shiftright(k1, 11)) + 1
        jump = F.floor((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / top.cast("double"))).cast("bigint")
        moved = F.struct(k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), state["j"].alias("b"), jump.alias("j"))
        return F.when(state["j"] < shards, moved).otherwise(state)

    start = F.struct(
        key.bitwiseAND(0x3FFFFF).alias("k0"),
        F.shiftrightunsigned(key, 22).bitwiseAND(0x3FFFFF).alias("k1"),
        F.shiftrightunsigned(key, 44).bitwiseAND(0xFFFFF).alias("k2"),
        F.lit(-1).cast("bigint").alias("b"),
        F.lit(0).cast("bigint").alias("j"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"]).cast("int")


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int = 512) -> DataFrame:
    """A row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: id and shard count alone decide the shard. Slots run gapless from 0 in each shard, in the order of
    (bucket of the row, id, size, crc). Rows are numbered within (shard, bucket) and shifted by the counts of the
    buckets before, so no task holds a whole shard; the counts have at most shards x buckets rows, hence the broadcast.
    Null text: size 1, crc 0. A null id is a key like any other. Repeated rows get slots of their own. An empty table
    gives no rows. Other columns are ignored.
    """
    key = F.xxhash64(F.col(id_col).cast("string"))
    raw = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("bigint").alias("text_crc32"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    # an id that many rows share, null too, is spread over all buckets by the texts
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("place", F.row_number().over(within).cast("bigint") - 1)
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("before")).alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id") -> None:
    """Writes docs as Parquet, a folder for each shard; several tasks fill a shard."""
    shard = jump_shard(F.xxhash64(F.col(id_col).cast("string")), shards)
    docs.withColumn("shard", shard).write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shards=8)
