"""Breadth-first frontier over a link table, as unrolled level joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.storage import durable


def bfs(starts: DataFrame, links: DataFrame, seen: DataFrame | None = None, depth: int = 2, max_pages: int = 50, outcomes: DataFrame | None = None) -> DataFrame:
    """(site, url, depth, rank): pages in the order of a breadth-first crawl, at most max_pages a site.

    starts(site, url), links(src, dst, pos). Targets lose their query, must be followable, unblocked and neither media
    nor off the site; those in `seen` are never entered. A page keeps its first place: (depth, parent's rank, position).
    outcomes(url, outcome) says what a visit gave: 'unchanged' pages stay in the result but their links aren't followed;
    'failed' ones, whose links nobody has seen, neither count nor stay. Sites of many pages are one task's window a
    level, of at most the frontier's links.
    """
    visit = None if outcomes is None else outcomes.groupBy("url").agg(F.max("outcome").alias("outcome"))
    place = ("site", "url", "depth", "parent", "pos")
    order = Window.partitionBy("site").orderBy("depth", "parent", "pos", "url").rowsBetween(Window.unboundedPreceding, 0)

    def visited(pages: DataFrame) -> DataFrame:
        return pages.withColumn("outcome", F.lit(None).cast("string")) if visit is None else pages.join(visit, "url", "left")

    def ranked(pages: DataFrame) -> DataFrame:
        counts = F.when(~F.col("outcome").eqNullSafe("failed"), 1)
        return pages.withColumn("rank", F.count(counts).over(order)).filter(F.col("rank") <= max_pages)

    first = starts.select("site", F.col("url"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("parent"), F.lit(0).alias("pos"))
    first = first.filter(~urls.is_media(F.col("url")) & ~urls.is_blocked(F.col("url")))
    reached = ranked(visited(first))
    target = urls.strip_query(F.col("dst"))
    ok = urls.is_followable(target) & ~urls.is_media(target) & ~urls.is_blocked(target, urls.netloc(F.col("src")))
    edges = links.filter(ok).select("src", target.alias("dst"), F.col("pos").alias("link_pos"))
    for step in range(1, depth + 1):
        if step > 2:  # each level reads those before it twice
            reached = durable(reached)
        frontier = reached.filter((F.col("depth") == step - 1) & F.col("outcome").isNull()).select("site", F.col("url").alias("src"), "rank")
        found = frontier.join(edges, "src").select("site", F.col("dst").alias("url"), F.lit(step).alias("depth"), F.col("rank").alias("parent"), F.col("link_pos").alias("pos"))
        if seen is not None:
            found = found.join(seen.select("url").distinct(), "url", "left_anti")
        found = found.join(reached.select("site", "url"), ["site", "url"], "left_anti")
        once = Window.partitionBy("site", "url").orderBy("parent", "pos")
        fresh = found.withColumn("k", F.row_number().over(once)).filter("k = 1").select(*place)
        reached = ranked(reached.select(*place, "outcome").unionByName(visited(fresh).select(*place, "outcome")))
    return reached.filter(~F.col("outcome").eqNullSafe("failed")).select("site", "url", "depth", "rank")


def match_sitemap(pages: DataFrame, sitemap: DataFrame, place: str | None = None) -> DataFrame:
    """(page_id, url, lastmod): a page's sitemap entry, matched exactly, without a trailing slash, or without www.

    The alternatives are three equality joins on derived keys rather than one join on their disjunction; the best match
    is the exact one, then the first of the others by sitemap URL. Of entries with equal URLs that of the least `place`
    holds, a column of the sitemap; without one, that of the least lastmod. Only the first entry of a key is joined, so
    a row of a page meets three entries at most, however often a URL occurs.
    """
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    plain = lambda c: F.replace(c, F.lit("www."), F.lit(""))
    entries = sitemap.select(F.struct(F.col("url").alias("entry"), F.col(place or "lastmod").alias("place"), "lastmod").alias("e"))
    found = None
    for rank, key in enumerate((lambda c: c, bare, plain)):
        left = pages.select("page_id", "url", key(F.col("url")).alias("k"))
        right = entries.groupBy(key(F.col("e")["entry"]).alias("k")).agg(F.min("e").alias("e"))
        part = left.join(right, "k").select("page_id", "url", F.struct(F.lit(rank).alias("rank"), "e").alias("best"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("page_id", "url").agg(F.min("best").alias("best")).select("page_id", "url", F.col("best.e.lastmod").alias("lastmod"))
