"""Decisions, feeds, sitemaps, generators, hashes and streams on small literals."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pagewright import storage
from pagewright.functions import content, language
from pagewright.operators import graph, reports, state
from pagewright.sources import feeds, stores
from pagewright.streaming import stateful

EVENTS = "event_id long, user_id long, event_type string, ts timestamp"


def as_of():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def test_structured_hash_is_that_of_pythons_json(spark):
    html = """<html><head><title> T "q" \\ é中\U0001f600\x7f </title><link rel="canonical" href="http://c/"></head><body><h1>A</h1><h2> B\tx </h2>
      <a href="/article/1"> one </a><li data-id="i1"></li><script type="application/ld+json">{"modified":"m","dateModified":"d"}</script></body></html>"""
    row = spark.createDataFrame([(html,)], "html string").select(content.structured_content(F.col("html")).alias("c"), state.structured_hash(F.col("html")).alias("h")).first()
    made = row.c.asDict(recursive=True)
    made["stable_elements"] = {k: v for k, v in made["stable_elements"].items() if v is not None}
    made["listing_content"] = {k: v for k, v in made["listing_content"].items() if v is not None}
    assert made["structured_data"] == {"json_ld_dateModified": "d", "json_ld_modified": "m"} and made["listing_content"]["item_ids"] == ["i1"]
    assert row.h == hashlib.sha256(json.dumps(made, sort_keys=True).encode()).hexdigest()


def test_top_words_stay_in_their_row(spark):
    rows = spark.createDataFrame([(1, "bbb aaa bbb ccc aaa bbb dd"), (2, ""), (3, None)], "id int, t string")
    by_word = rows.select("id", content.top_words(F.col("t"), 2, by_place=False).alias("w"))
    assert {r.id: r.w and [(x.word, x.n) for x in r.w] for r in by_word.collect()} == {1: [("bbb", 3), ("aaa", 2)], 2: [], 3: None}
    hashed = rows.select("id", state.fuzzy_hash(F.col("t")).alias("h"))
    assert {r.id: r.h for r in hashed.collect()} == {1: hashlib.sha256(b"bbb aaa ccc").hexdigest(), 2: hashlib.sha256(b"").hexdigest(), 3: hashlib.sha256(b"").hexdigest()}
    for df in (by_word, hashed):
        assert "Exchange" not in df._jdf.queryExecution().toString()


def test_a_robots_file_names_the_sitemap(spark):
    entry = "<urlset><url><loc>{}</loc><lastmod>{}</lastmod></url></urlset>"
    fetched = [
        ("http://a/robots.txt", 200, "Sitemap: http://a/one.xml\nsitemap:http://a/two.xml\nSitemap: http://a/gone.xml"), ("http://a/one.xml", 200, entry.format("http://a/x", "1")),
        ("http://a/two.xml", 200, entry.format("http://a/y", "2")), ("http://a/gone.xml", 404, entry.format("http://a/z", "3")),
        ("http://b/sitemap.xml", 200, entry.format("http://b/x", "1")), ("http://b/sitemaps.xml", 200, entry.format("http://b/x", "later")), ("http://b/sitemap_index.xml", 200, "<html"),
        ("http://c/sitemap_index.xml", 200, "<sitemapindex><sitemap><loc>http://c/s.xml</loc></sitemap></sitemapindex>"), ("http://c/s.xml", 200, entry.format("http://c/x", "1")),
    ]
    bases = spark.createDataFrame([(f"http://{h}/",) for h in "abcd"], "base_url string")
    found = feeds.site_sitemap(bases, spark.createDataFrame(fetched, "url string, status int, body string"))
    assert sorted((r.url, r.lastmod) for r in found.collect()) == [("http://a/y", "2"), ("http://b/x", "later"), ("http://c/x", "1")]


def test_the_first_feed_that_tells_a_time_holds(spark):
    pages = spark.createDataFrame([(1, ["http://f/0", "http://f/1", "http://f/2"]), (2, ["http://f/3"]), (3, [])], "page_id long, feeds array<string>")
    bodies = [("http://f/0", 200, "<rss><item/></rss>"), ("http://f/1", 200, "<feed><updated>2024-01-01</updated><published>2024-02-01</published></feed>"), ("http://f/2", 200, "<feed><updated>2024-05-01</updated></feed>"), ("http://f/3", 500, "<feed><updated>2024-05-01</updated></feed>")]
    fetched = spark.createDataFrame(bodies, "url string, status int, body string")
    assert [(r.page_id, r.feed_url, str(r.ts)[:10]) for r in feeds.first_feed_time(pages, fetched, as_of()).collect()] == [(1, "http://f/1", "2024-02-01")]
    assert str(feeds.first_feed_time(pages, fetched, as_of(), compat=True).first().ts)[:10] == "2024-01-01"


def test_two_phases_read_no_body_of_unchanged_pages(spark):
    fields = "url string, crawl_timestamp string, content_hash string, structured_hash string, last_updated string, timestamp_source string, last_modified_header string, etag_header string, identifier string"
    states = spark.createDataFrame([("u1", "2024-05-31 00:00:00 UTC", "c", "s", "l", "og", "Mon", "e", "i"), ("u2", "2024-05-31 00:00:00 UTC", "c", "s", None, "none", None, None, "i")], fields)
    signals = spark.createDataFrame([("u1", "text/html", "Mon", "e", 200, None), ("u2", "text/html", None, None, 200, None), ("u3", "text/plain", None, None, 200, None), ("u4", None, None, None, None, None)], "url string, content_type string, last_modified string, etag string, status int, feed_time timestamp")
    bodies = spark.createDataFrame([("u2", "<title>a</title>", b"a"), ("u3", "", b"raw words"), ("u4", "<p>x</p>", b"x")], "url string, html string, body binary")
    found = {r.url: r for r in reports.two_phase(signals, states, bodies, as_of()).collect()}
    assert [(u, found[u].phase, found[u].reason) for u in sorted(found)] == [("u1", "lightweight", "headers_unchanged"), ("u2", "deep", "default_check_needed"), ("u3", "non_html", "no_previous_data"), ("u4", "deep", "no_previous_data")]
    assert (found["u1"].identifier, found["u1"].last_updated) == ("i", "l") and found["u3"].content_hash == hashlib.sha256(b"raw words").hexdigest()
    assert found["u3"].fuzzy_hash and found["u2"].identifier.startswith("content_hash:")


def test_a_generator_can_be_plugged_in(spark):
    pages = spark.createDataFrame([("http://s.org/a", "<p>x</p>", True), ("http://s.org/b", "<p>y</p>", False)], "url string, html string, known boolean")
    documents = spark.createDataFrame([("s_a", "s", "# T\n\n**URL:** http://s.org/a\n\n**Old?**\nyes")], "doc_key string, prefix string, text string")
    none = spark.createDataFrame([], "doc_key string")
    made = lambda p: p.select("doc_key", F.concat(F.lit("**URL:** "), "url", F.lit("\n**New?**\n"), "html").alias("text"))
    found = {r.url: r for r in reports.page_answers(pages, documents, none, made).collect()}
    assert [(f.question, f.answer, f.source_url) for f in found["http://s.org/a"].faqs] == [("Old?", "yes", "http://s.org/a")] and not found["http://s.org/a"].faq_generated
    assert [f.question for f in found["http://s.org/b"].faqs] == ["New?"] and found["http://s.org/b"].just_crawled and found["http://s.org/b"].message is None
    site = reports.site_answers(pages.select(F.col("url").alias("base_url")), pages.select("url"), documents.limit(0), none, pages, made)
    assert {(r.domain, r.generated_now, r.total_pages, r.question) for r in site.collect()} == {("s.org", 2, 2, "New?")}


def test_unchanged_and_failed_pages_lead_nowhere(spark):
    links = spark.createDataFrame([("http://h/0", "http://h/1", 1), ("http://h/0", "http://h/2", 2), ("http://h/0", "http://h/3", 3), ("http://h/1", "http://h/4", 1), ("http://h/2", "http://h/5", 1), ("http://h/3", "http://h/6", 1)], "src string, dst string, pos int")
    start = spark.createDataFrame([("h", "http://h/0")], "site string, url string")
    outcomes = spark.createDataFrame([("http://h/1", "unchanged"), ("http://h/2", "failed")], "url string, outcome string")
    assert [(r.url[-1], r["rank"]) for r in graph.bfs(start, links, outcomes=outcomes).orderBy("rank").collect()] == [("0", 1), ("1", 2), ("3", 3), ("6", 4)]
    assert [r.url[-1] for r in graph.bfs(start, links, outcomes=outcomes, max_pages=3).orderBy("rank").collect()] == list("013")


def test_detection_without_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language.detect(docs.select("doc_id", "text"), "doc_id", F.col("text"), language.common_word_profiles(spark)).join(docs, "doc_id").filter("content_source = 'trigrams'")
    assert told.filter("content_lang = lang").count() >= 0.98 * told.count() > 900
    russian = spark.createDataFrame([(1, "Библиотека хранит записи обо всех посещениях и сообщает, какие страницы изменились с того времени, когда их читали.")], "id int, t string")
    assert language.detect(russian, "id", F.col("t"), language.common_word_profiles(spark)).first().content_lang == "ru"


def written(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{path}/p{i}")
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path)).select("event_id", "user_id", F.col("event_type").alias("hash"), "ts")


def at(spark, text):
    import datetime

    return datetime.datetime.strptime(text, "%Y-%m-%d %H:%M")


def test_streams_keep_state_between_batches(spark, tmp_path):
    parts = [[(i, 1, "ab"[i % 2] if i < 6 else "b", at(spark, f"2024-01-01 0{i}:00")) for i in range(k, k + 3)] for k in (0, 3, 6)]
    parts[1].append((20, 2, "signup", at(spark, "2024-01-01 03:30")))
    parts[2] += [(21, 2, "x", at(spark, "2024-01-01 04:29")), (22, 2, "x", at(spark, "2024-01-01 04:30"))]
    rows = written(spark, tmp_path / "e", parts)
    held = {(r.user_id, r.event_id): r.recency for r in stateful.recent_history(rows).collect()}
    assert [held.get((1, e)) for e in range(9)] == [None, None, None, None, 5, 4, 3, 2, 1]
    changed = stateful.replay(rows, stateful.SkipUnchanged()).filter("user_id = 1").collect()
    assert sorted(r.event_id for r in changed) == [0, 1, 2, 3, 4, 5]
    hits = {r.event_id: r.hit for r in stateful.replay(rows, stateful.TimedCache("signup")).filter("user_id = 2").collect()}
    assert hits == {21: True, 22: False}


def test_a_timer_tells_stale_pages(spark, tmp_path):
    parts = [[(1, 1, "a", at(spark, "2024-01-01 00:00")), (2, 2, "a", at(spark, "2024-01-01 00:00"))], [(3, 1, "a", at(spark, "2024-01-05 00:00"))], [(4, 3, "a", at(spark, "2024-01-10 00:00"))]]
    rows = written(spark, tmp_path / "s", parts).withWatermark("ts", "0 seconds")
    assert [(r.user_id, str(r.last)[:10]) for r in stateful.replay(rows, stateful.Stale(days=7), "eventTime").collect()] == [(2, "2024-01-01")]


def test_an_empty_stream_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "none"))
    assert stateful.recent_history(stateful.event_stream(spark, str(tmp_path / "none"))).count() == 0


def test_documents_are_written_by_host_label(spark, tmp_path):
    docs = spark.createDataFrame([("k", "http://www.site.com/a", "t")], "doc_key string, url string, text string")
    stores.write_documents(docs, str(tmp_path / "d"))
    assert (tmp_path / "d" / "prefix=site").is_dir() and spark.read.parquet(str(tmp_path / "d")).first().prefix == "site"


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        storage.shared_dir(Session())
