"""Feeds and sitemaps: discovery as Columns, XML by Arrow-batched functions that never fail on bad input."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import fixed, timestamps, urls


def feed_urls(html: Column, url: Column) -> Column:
    """At most five: links in document order, then the fixed paths; on the page's host, equal but for slashes once."""
    found = F.transform(F.regexp_extract_all(html, F.lit("(?iu)" + fixed.FEED_LINK), F.lit(1)), lambda h: urls.resolve(h, url))
    origin = F.concat(urls.scheme(url), F.lit("://"), urls.netloc(url))
    fixed_paths = F.array(*(F.concat(origin, F.lit(p)) for p in fixed.FEED_PATHS))
    own = F.filter(F.concat(found, fixed_paths), lambda u: urls.netloc(u) == urls.netloc(url))
    bare = F.transform(own, lambda u: F.regexp_replace(u, "/+$", ""))
    return F.slice(F.filter(own, lambda u, i: F.array_position(bare, F.element_at(bare, i + 1)) == i + 1), 1, fixed.MAX_FEEDS)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _root(text: str | None):
    try:
        return ElementTree.fromstring(text) if text else None
    except ElementTree.ParseError:
        return None


def feed_times_of(text: str | None) -> list[str]:
    """Atom: every updated and published; RSS: lastBuildDate, then the dates of items. Bad XML gives none."""
    root = _root(text)
    if root is None:
        return []
    written = lambda nodes, names: [(x.text or "").strip() for x in nodes if _local(x.tag) in names and (x.text or "").strip()]
    if _local(root.tag) == "feed":
        return written(root.iter(), {"updated", "published"})
    items = [x for x in root.iter() if x.tag == "item"]
    return written(root.iter("lastBuildDate"), {"lastbuilddate"})[:1] + [w for item in items for w in written(item, {"pubdate", "date"})]


def sitemap_of(text: str | None) -> list[tuple[str, str, str]]:
    """(kind, loc, lastmod): a sitemap's pages that have both, or the sitemaps that an index names."""
    root = _root(text)
    if root is None:
        return []
    out, index = [], "sitemapindex" in root.tag
    for entry in (x for x in root.iter() if _local(x.tag) == ("sitemap" if index else "url")):
        parts = {_local(c.tag): (c.text or "").strip() for c in entry}
        if parts.get("loc") and (index or parts.get("lastmod")):
            out.append(("sitemap" if index else "url", parts["loc"], parts.get("lastmod", "")))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def feed_times(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in texts:
        yield some.map(feed_times_of)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "loc", "lastmod")])))
def sitemap_parts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in texts:
        yield some.map(lambda t: [dict(zip(("kind", "loc", "lastmod"), x, strict=True)) for x in sitemap_of(t)])


def sitemap_entries(xml: Column | str) -> Column:
    """The pages of a sitemap: array<struct(kind, loc, lastmod)>."""
    return F.filter(sitemap_parts(xml), lambda e: e["kind"] == "url")


def site_sitemap(bases: DataFrame, fetched: DataFrame) -> DataFrame:
    """(base_url, url, lastmod) of each site's sitemaps among what was fetched: fetched(url, status, body).

    Candidates are the fixed paths and the sitemap that robots.txt names (the last one that was fetched well); an index
    leads to its sitemaps, a level deep. Of several entries of a page the last one holds. What isn't XML gives nothing.
    """
    good = fetched.filter("status = 200").select(F.col("url").alias("at"), "body")
    origin = F.concat(urls.scheme(F.col("base_url")), F.lit("://"), urls.netloc(F.col("base_url")))
    asked = bases.select("base_url", F.posexplode(F.transform(F.array(*(F.lit(p) for p in fixed.SITEMAP_PATHS)), lambda p: F.concat(origin, p))).alias("pos", "at"))
    answered = asked.join(good, "at")
    robots = F.col("at").endswith("robots.txt")
    lines = answered.filter(robots).select("base_url", "pos", F.posexplode(F.split("body", "\n")).alias("line", "text")).filter(F.lower("text").startswith("sitemap:"))
    named = lines.select("base_url", "pos", "line", F.trim(F.regexp_replace("text", "^[^:]*:", "")).alias("at")).join(good, "at")
    told = named.groupBy("base_url", "pos").agg(F.max_by("body", "line").alias("body"))
    maps = answered.filter(~robots).select("base_url", "pos", "body").unionByName(told)
    parts = maps.select("base_url", "pos", F.posexplode(sitemap_parts("body")).alias("place", "e")).select("base_url", "pos", "place", "e.*")
    deeper = parts.filter("kind = 'sitemap'").select("base_url", "pos", "place", F.col("loc").alias("at")).join(good, "at")
    below = deeper.select("base_url", "pos", "place", F.posexplode(sitemap_parts("body")).alias("below", "e")).select("base_url", "pos", "place", "below", "e.*")
    pages = parts.withColumn("below", F.lit(-1)).unionByName(below).filter("kind = 'url'")
    return pages.groupBy("base_url", F.col("loc").alias("url")).agg(F.max_by("lastmod", F.struct("pos", "place", "below")).alias("lastmod"))


def first_feed_time(pages: DataFrame, fetched: DataFrame, as_of: Column, compat: bool = False) -> DataFrame:
    """(page_id, feed_url, ts) of the first of each page's feeds that tells a time: pages(page_id, feeds), fetched(url, status, body)."""
    asked = pages.select("page_id", F.posexplode("feeds").alias("pos", "feed_url"))
    good = fetched.filter("status = 200").select(F.col("url").alias("feed_url"), "body").filter(F.lower("body").contains("<rss") | F.lower("body").contains("<feed"))
    told = asked.join(good, "feed_url").withColumn("ts", timestamps.latest_feed_time(feed_times("body"), as_of, compat)).filter("ts is not null")
    return told.groupBy("page_id").agg(F.min_by("feed_url", "pos").alias("feed_url"), F.min_by("ts", "pos").alias("ts"))
