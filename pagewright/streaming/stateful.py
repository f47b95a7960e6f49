"""Keyed state over streams: bounded history, unchanged visits, a timed cache and pages that grow stale.

Each processor holds a few values a key in the state store, so a restarted query goes on from its checkpoint. Rows of a
key within a batch are taken in the order of time and id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewright.operators import state
from pagewright.storage import shared_path

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ROWS = "event_id long, user_id long, hash string, ts timestamp"


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")


class RecentHistory(StatefulProcessor):
    """The newest rows of each key; a key that has new ones gives them all, with the number of rows that it has ever had."""

    SCHEMA = "user_id long, event_id long, recency int, seen long"

    def __init__(self, keep: int = state.HISTORY):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "ts timestamp, event_id long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = _ordered(rows)
        seen = (self.count.get()[0] if self.count.exists() else 0) + len(fresh)
        both = [*self.held.get(), *zip(fresh["ts"], fresh["event_id"].astype(int), strict=True)]
        newest = sorted(((pd.Timestamp(t), int(e)) for t, e in both), reverse=True)[: self.keep]
        self.held.put([(t.to_pydatetime(), e) for t, e in newest])
        self.count.update((seen,))
        yield pd.DataFrame({"user_id": key[0], "event_id": [e for _, e in newest], "recency": range(1, len(newest) + 1), "seen": seen})

    def close(self) -> None:
        pass


class SkipUnchanged(StatefulProcessor):
    """Rows whose hash isn't that of the key's row before; nothing is known before the first."""

    SCHEMA = "user_id long, event_id long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = _ordered(rows)
        before = pd.Series([self.last.get()[0] if self.last.exists() else None, *fresh["hash"][:-1]], index=fresh.index, dtype=object)
        self.last.update((fresh["hash"].iloc[-1],))
        yield fresh[(fresh["hash"] != before).to_numpy()][["event_id"]].assign(user_id=key[0])[["user_id", "event_id"]]

    def close(self) -> None:
        pass


class TimedCache(StatefulProcessor):
    """Rows that aren't entries, with whether the key's latest entry was under `seconds` old; entries of the same time count."""

    SCHEMA = "user_id long, event_id long, hit boolean"

    def __init__(self, entry: str, seconds: int = 3600):
        self.entry, self.seconds = entry, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = _ordered(rows)
        at = fresh["ts"].astype("datetime64[us]")
        entries = at.where(fresh["hash"] == self.entry).groupby(at).transform("max").ffill()
        if self.stored.exists():
            entries = entries.fillna(pd.Timestamp(self.stored.get()[0]))
        if entries.notna().any():
            self.stored.update((entries.iloc[-1].to_pydatetime(),))
        hit = ((at - entries) < pd.Timedelta(seconds=self.seconds)).fillna(False)
        asked = (fresh["hash"] != self.entry).to_numpy()
        yield pd.DataFrame({"user_id": key[0], "event_id": fresh["event_id"], "hit": hit.astype(bool)})[asked]

    def close(self) -> None:
        pass


class Stale(StatefulProcessor):
    """A row for each key that has had no row for `days`: a timer in event time, set anew by each row."""

    SCHEMA = "user_id long, last timestamp"

    def __init__(self, days: int = 7):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(frame["ts"].max() for frame in rows)
        if self.last.exists():
            newest = max(newest, pd.Timestamp(self.last.get()[0]))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.last.update((newest.to_pydatetime(),))
        self.handle.registerTimer(int(newest.timestamp() * 1000) + self.days * 86_400_000)
        yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "last": pd.Series(dtype="datetime64[us]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"user_id": [key[0]], "last": [last]})

    def close(self) -> None:
        pass


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """ROWS of an event table, one file or a folder of files, as a stream."""
    schema = spark.read.parquet(path).schema
    source = path if _is_folder(spark, path) else path.replace(path.rpartition("/")[2], "[" + path.rpartition("/")[2][0] + "]" + path.rpartition("/")[2][1:])
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.select("event_id", "user_id", F.col("event_type").alias("hash"), F.col("ts").cast("timestamp").alias("ts"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def replay(rows: DataFrame, processor: StatefulProcessor, time_mode: str = "None") -> DataFrame:
    """All that a processor gives over a stream that is read until nothing is left; each batch is a folder of its own."""
    spark = rows.sparkSession
    root = shared_path(spark, type(processor).__name__.lower())
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        made = rows.groupBy("user_id").transformWithStateInPandas(processor, outputStructType=processor.SCHEMA, outputMode="Update", timeMode=time_mode)
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/batches/batch={number}")
        made.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
    schema = f"{processor.SCHEMA}, batch int"
    try:
        return spark.read.schema(schema).parquet(f"{root}/batches")
    except Exception as e:  # a stream without rows has no batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def recent_history(rows: DataFrame, keep: int = state.HISTORY) -> DataFrame:
    """(event_id, user_id, recency): what the stream holds at its end."""
    given = replay(rows, RecentHistory(keep))
    last = given.groupBy("user_id").agg(F.max("seen").alias("seen"))
    return given.join(last, ["user_id", "seen"]).select("event_id", "user_id", "recency")
