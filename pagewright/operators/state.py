"""Stored page state against new analyses: change and recrawl decisions, history windows, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import content, fixed, language, timestamps, urls

STATE_FIELDS = (
    "identifier", "last_updated", "timestamp_source", "content_hash", "structured_hash", "last_modified_header", "etag_header",
    "crawl_timestamp", "detected_language", "language_confidence", "language_source", "is_rtl", "script_hint",
)
HISTORY = 5


def content_hash(html: Column) -> Column:
    return F.sha2(content.clean_content(html), 256)


def structured_hash(html: Column) -> Column:
    return F.sha2(content.structured_json(html), 256)


def identifier(last_modified: Column, etag: Column, content_h: Column, structured_h: Column, fuzzy_h: Column) -> Column:
    part = lambda name, c: F.concat(F.lit(f"{name}:"), c)
    header = lambda name, c: F.when(c != "", part(name, c))
    return F.concat_ws("|", header("last_modified_header", last_modified), header("etag_header", etag), part("content_hash", content_h), part("structured_hash", structured_h), part("fuzzy_hash", fuzzy_h))


def fuzzy_hash(text: Column, top: int = 50) -> Column:
    """The hash of a text's commonest words of over two letters, ties by first place."""
    words = F.array_join(F.transform(content.top_words(text, top, by_place=True), lambda x: x["word"]), " ")
    return F.sha2(F.coalesce(words, F.lit("")), 256)


def analyse(pages: DataFrame, as_of: Column) -> DataFrame:
    """pages(page_id, url, html) with its hashes, last-updated time and language hints; one narrow projection."""
    found = timestamps.last_updated(F.col("html"), as_of)
    return pages.select(
        "page_id", "url",
        content_hash(F.col("html")).alias("content_hash"),
        structured_hash(F.col("html")).alias("structured_hash"),
        F.length(content.clean_content(F.col("html"))).alias("cleaned_content_length"),
        timestamps.utc_text(found["ts"]).alias("last_updated"),
        found["source"].alias("timestamp_source"),
        language.hints(F.col("html"), F.col("url")).alias("hints"),
    )


def light_check(url: Column, old: dict[str, Column], content_type: Column, last_modified: Column, etag: Column, status: Column, feed_time: Column, as_of: Column) -> Column:
    """struct(needs_deep_check, reason): the first rule that decides, before any body is read."""
    crawled = timestamps.comparable(old["crawl_timestamp"])
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(crawled)
    hours = F.try_element_at(F.create_map(*(x for k, v in fixed.RECRAWL_HOURS.items() for x in (F.lit(k), F.lit(v)))), urls.netloc(url))
    same = (old["last_modified_header"] == last_modified) & (old["etag_header"] == etag)
    out = lambda deep, reason: F.struct(F.lit(deep).alias("needs_deep_check"), F.lit(reason).alias("reason"))
    return (
        F.when(old["known"].isNull(), out(True, "no_previous_data"))
        .when(content_type.isNotNull() & ~F.lower(content_type).startswith("text/html"), out(True, "non_html_content"))
        .when(same, out(False, "headers_unchanged"))
        .when(status == 304, out(False, "not_modified"))
        .when(feed_time > crawled, out(True, "rss_newer_than_crawl"))
        .when(F.floor(seconds / 86400) > 7, out(True, "old_crawl"))
        .when(seconds / 3600 < hours, out(False, "within_recrawl_frequency"))
        .otherwise(out(True, "default_check_needed"))
    )


def conditional_request(old: dict[str, Column]) -> Column:
    """The headers of a conditional GET, as a map: those that the state knows."""
    known = lambda c: F.when(c != "", c)
    named = F.create_map(F.lit("If-Modified-Since"), known(old["last_modified_header"]), F.lit("If-None-Match"), known(old["etag_header"]))
    return F.map_filter(named, lambda _, v: v.isNotNull())


def not_modified(old: dict[str, Column], head_status: Column, last_modified: Column, etag: Column, get_status: Column) -> Column:
    """Why no body need be read: 'head_304', 'headers_unchanged' (both equal), 'get_304'; null where it must be."""
    same = lambda a, b: (a != "") & (a == b)
    return (
        F.when(head_status == 304, "head_304")
        .when(same(old["last_modified_header"], last_modified) & same(old["etag_header"], etag), "headers_unchanged")
        .when(get_status == 304, "get_304")
    )


def cached_lookup(requests: DataFrame, entries: DataFrame, key: str, at: str, seconds: int = 3600) -> DataFrame:
    """requests with `hit`: whether the key's latest entry, by the time of the request, was under `seconds` old.

    One window over the union; a request sees entries of its own time.
    """
    both = requests.withColumn("__set", F.lit(None).cast("timestamp")).withColumn("__kind", F.lit(1)).unionByName(
        entries.select(key, at, F.col(at).alias("__set"), F.lit(0).alias("__kind")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(at, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__set", F.last("__set", ignorenulls=True).over(w)).filter("__kind = 1")
    age = F.unix_micros(at) - F.unix_micros("__set")
    return seen.withColumn("hit", F.coalesce(age < seconds * 1_000_000, F.lit(False))).drop("__set", "__kind")


def parts_of(identifier_: Column) -> Column:
    """An identifier's key:value parts; parts without a colon are dropped."""
    kept = F.filter(F.split(identifier_, r"\|"), lambda p: F.contains(p, F.lit(":")))
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(F.split(p, ":", 2)[0], F.split(p, ":", 2)[1])))


def has_changed(old: Column, new: Column) -> Column:
    a, b = parts_of(old), parts_of(new)
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    out = F.when(old.isNull() | (old == ""), True)
    for key in ("last_modified_header", "etag_header"):
        out = out.when(F.map_contains_key(a, key) & ~get(a, key).eqNullSafe(get(b, key)), True)
    for key in ("structured_hash", "content_hash"):
        out = out.when(~get(a, key).eqNullSafe(get(b, key)), True)
    return out.otherwise(False)


def differs_much(old: dict[str, Column], new: dict[str, Column], threshold: Column) -> Column:
    """Whether the fuzzy hashes, both known, differ, and the canonical contents, both known, are less alike than threshold."""
    some = lambda c: c.isNotNull() & (c != "")
    asked = some(old["fuzzy_hash"]) & some(new["fuzzy_hash"]) & (old["fuzzy_hash"] != new["fuzzy_hash"])
    asked = asked & some(old["canonical_content"]) & some(new["canonical_content"])
    return F.coalesce(F.when(asked, content.jaccard(old["canonical_content"], new["canonical_content"]) < threshold), F.lit(False))


def should_recrawl(old: dict[str, Column], new: dict[str, Column], flapping: Column, as_of: Column, threshold: Column | None = None) -> Column:
    """Ordered rules; the first that applies decides.

    Where old and new have a fuzzy_hash and canonical_content, the site's similarity threshold (0.8 without a history)
    stands second. Unknown values (null, empty) never decide.
    """
    crawled, written = timestamps.comparable(old["crawl_timestamp"]), timestamps.comparable(new["last_updated"])
    some = lambda c: c.isNotNull() & (c != "")
    reliable = some(old["last_updated"]) | some(old["last_modified_header"]) | some(old["etag_header"])
    fresh = F.unix_timestamp(as_of) - F.unix_timestamp(crawled) < 24 * 3600
    known = all("fuzzy_hash" in x and "canonical_content" in x for x in (old, new))
    unlike = differs_much(old, new, F.coalesce(F.lit(0.8) if threshold is None else threshold, F.lit(0.8))) if known else F.lit(False)
    return (
        F.when(~old["structured_hash"].eqNullSafe(new["structured_hash"]), True)
        .when(unlike, True)
        .when(flapping, False)
        .when(~old["content_hash"].eqNullSafe(new["content_hash"]), True)
        .when(some(old["last_updated"]) & some(new["last_updated"]) & (old["last_updated"] == new["last_updated"]), False)
        .when(some(old["last_modified_header"]) & (old["last_modified_header"] == new["last_modified_header"]), False)
        .when(some(old["etag_header"]) & (old["etag_header"] == new["etag_header"]), False)
        .when(written < crawled, False)
        .when(~reliable & fresh, False)
        .otherwise(True)
    )


def recrawl_hours(url: Column) -> Column:
    table = F.create_map(*(x for k, v in fixed.RECRAWL_HOURS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, urls.netloc(url)), F.lit(fixed.DEFAULT_RECRAWL_HOURS))


def classify(old: DataFrame, new: DataFrame, hash_col: str = "structured_hash") -> DataFrame:
    """(url, change): new, changed, unchanged or missing, by a full outer join of two snapshots."""
    a, b = old.select("url", F.col(hash_col).alias("old_hash"), F.lit(1).alias("in_old")), new.select("url", F.col(hash_col).alias("new_hash"), F.lit(1).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "missing").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    return a.join(b, "url", "full_outer").select("url", change.alias("change"))


def upsert(state: DataFrame, fresh: DataFrame, key: str = "url", clock: str = "crawl_timestamp") -> DataFrame:
    """The latest row of each key in both tables; the fresh one on ties."""
    both = state.withColumn("__side", F.lit(0)).unionByName(fresh.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.desc(clock), F.desc("__side"))
    return both.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__side")


def recent_history(history: DataFrame, key: str, order: list, keep: int = HISTORY) -> DataFrame:
    latest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return history.withColumn("recency", F.row_number().over(latest)).filter(F.col("recency") <= keep)


def flapping(history: DataFrame, key: str, order: list, hash_col: str) -> DataFrame:
    """history with flapping: the row is at least the key's third, and its hash occurs twice in the last three."""
    last = Window.partitionBy(key).orderBy(*order).rowsBetween(-2, 0)
    seen = F.collect_list(hash_col).over(last)
    times = F.size(F.filter(seen, lambda x: x == F.col(hash_col)))
    return history.withColumn("flapping", (F.count(F.lit(1)).over(last) == 3) & (times >= 2))


def change_rate(history: DataFrame, key: str, order: list, hash_col: str) -> DataFrame:
    """(key, visits, change_rate): the share of visits, after the first, whose hash differs from the one before."""
    before = F.lag(hash_col).over(Window.partitionBy(key).orderBy(*order))
    rated = history.withColumn("__changed", F.when(before != F.col(hash_col), 1)).groupBy(key).agg(F.count(F.lit(1)).alias("visits"), F.count("__changed").alias("n"))
    return rated.select(key, "visits", F.when(F.col("visits") > 1, F.col("n") / (F.col("visits") - 1)).alias("change_rate"))


def site_threshold(history: DataFrame, key: str, order: list, hash_col: str) -> DataFrame:
    """(key, change_rate, threshold) over each key's last five rows."""
    w = Window.partitionBy(key).orderBy(*order)
    recent = recent_history(history, key, order).withColumn("before", F.lag(hash_col).over(w)).withColumn("i", F.row_number().over(w))
    rated = recent.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when((F.col("i") > 1) & (F.col("before") != F.col(hash_col)), 1).otherwise(0)).alias("changes"))
    rate = F.when(F.col("n") >= 2, F.col("changes") / (F.col("n") - 1))
    threshold = F.when(F.col("n") < 2, 0.8).when(rate > 0.8, 0.6).when(rate > 0.5, 0.7).otherwise(0.9)
    return rated.select(key, rate.alias("change_rate"), threshold.alias("threshold"))


def as_of_state(history: DataFrame, times: DataFrame, key: str, clock: str, at: str) -> DataFrame:
    """times with the history row that held at each time: an as-of join as one window over the union, no range join."""
    values = [c for c in history.columns if c not in (key, clock)]
    past = history.select(key, F.col(clock).alias("__t"), F.lit(0).alias("__kind"), F.struct(*values).alias("__v"), F.lit(None).cast("timestamp").alias(at))
    asked = times.select(key, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(past.schema["__v"].dataType).alias("__v"), F.col(at))
    w = Window.partitionBy(key).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return past.unionByName(asked).withColumn("__h", F.last("__v", ignorenulls=True).over(w)).filter("__kind = 1").select(key, at, *(F.col("__h")[v].alias(v) for v in values))


def migrate_legacy(state: DataFrame, column: str = "legacy") -> DataFrame:
    """Rows whose state is one 'k:v|k:v' string, as state rows that want a new visit."""
    get = lambda k: F.try_element_at(parts_of(F.col(column)), F.lit(k))
    return state.select(
        "url", F.col(column).alias("identifier"), get("last_modified").alias("last_updated"),
        F.when(get("last_modified").isNotNull() & (get("last_modified") != ""), "http_header").otherwise("none").alias("timestamp_source"),
        get("content_hash").alias("content_hash"), get("last_modified").alias("last_modified_header"), get("etag").alias("etag_header"), F.lit(True).alias("needs_recrawl"),
    )
