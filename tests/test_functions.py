"""Odd literals, one by one."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import content, language, timestamps, urls
from pagewright.operators import faq, graph, state
from pagewright.sources import feeds, markdown, stores


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def as_of():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


@pytest.mark.parametrize(
    ("url", "want"),
    [("http://netflix.com/", True), ("http://microsoft.com/a", True), ("https://h.org/Help/me", True), ("https://h.org/?SHARE=1", True), ("https://h.org/ok", False)],
)
def test_blocked(spark, url, want):
    assert one(spark, urls.is_blocked(F.lit(url))) is want


@pytest.mark.parametrize(("url", "want"), [("http://h/a/.png", False), ("http://h/a.png;x", True), ("http://h/a.PNG?v", True), ("http://h/a.tar.gz", False), ("http://h/x.zip", True)])
def test_media(spark, url, want):
    assert one(spark, urls.is_media(F.lit(url))) is want


@pytest.mark.parametrize(
    ("href", "root", "want"),
    [
        ("/x", False, "https://h.org/x"), ("//cdn/x", False, "https://h.org//cdn/x"), ("b", False, "https://h.org/d/b"), ("../b?q", False, "https://h.org/b?q"), ("./b/./c", False, "https://h.org/d/b/c"),
        ("?p=1", False, "https://h.org/d/a?p=1"), ("http://o/", False, "http://o/"), ("#t", False, None), ("mailto:a", False, None), ("", False, None),
        ("//cdn/x", True, "https://cdn/x"), ("b", True, "https://h.org/b"), ("/x", True, "https://h.org/x"),
    ],
)
def test_resolve(spark, href, root, want):
    assert one(spark, urls.resolve(F.lit(href), F.lit("https://h.org/d/a"), root)) == want


def test_url_parts(spark):
    assert one(spark, urls.normalize_netloc(F.lit("AWWW.x.org"))) == "ax.org"
    assert one(spark, urls.strip_query(F.lit("HTTP://h/a?x#y"))) == "http://h/a"
    assert one(spark, urls.strip_query(F.lit("http://h/a?x=1&y=2&x=3&z="), ["x", "z"])) == "http://h/a?x=3"
    assert one(spark, urls.doc_key(F.lit("https://www.site.com/a b/c.d/"))) == "site_c_d"
    assert one(spark, urls.doc_key(F.lit("https://site.com"))) == "site_index"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Wed, 21 Oct 2023 10:30:00 GMT", "2023-10-21 10:30:00"), ("2024-01-01T10:00:00.000Z", None), ("2024-01-01 10:00:00 UTC", None), ("2024-01-01 10:00:00 EST", None),
        ("13/02/2024", "2024-02-13 00:00:00"), ("02/03/2024", "2024-02-03 00:00:00"), ("May 5, 2024", "2024-05-05 00:00:00"), ("Chicago", None), ("12/31/2099", None),
        ("3 years ago 2 days ago", "2021-06-02 00:00:00"), ("2024-01-01T10:00:00+02:00", "2024-01-01 08:00:00"), ("1889-01-01", None), ("99999999999999999999 days ago", None),
    ],
)
def test_normalize(spark, text, want):
    found = one(spark, F.date_format(timestamps.normalize(F.lit(text), as_of()), "yyyy-MM-dd HH:mm:ss"))
    assert found == want
    if want:
        assert one(spark, timestamps.comparable(F.lit(want + " UTC"))) is not None


def test_schema_times(spark):
    page = lambda body: F.lit(f'<script type="application/ld+json">{body}</script>')
    day = lambda body: str(one(spark, timestamps.schema_time(page(body), as_of())))[:10]
    assert day('{"@graph":[{"a":1},{"dateModified":"2024-02-03"}]}') == "2024-02-03"
    assert day('[{"a":1},{"dateModified":"2024-02-04"}]') == "2024-02-04"
    assert day('{bad json') == "None"
    assert day('{"dateModified":"unreadable"}') == "None"
    found = one(spark, content.structured_data(page('[{"dateModified":"1"},{"dateModified":"2","updated":"3"}]')))
    assert found == {"json_ld_dateModified": "2", "json_ld_updated": "3"}


def test_cascade_without_and_with_headers(spark):
    found = one(spark, timestamps.last_updated(F.lit("<p>x</p>"), as_of()))
    assert (found.ts, found.source) == (None, "none")
    found = one(spark, timestamps.last_updated(F.lit("<p>x</p>"), as_of(), header=F.lit("Wed, 21 Oct 2023 10:30:00 GMT")))
    assert found.source == "http_header"


def test_similarity(spark):
    assert one(spark, content.jaccard(F.lit(""), F.lit("!"))) == 1.0
    assert one(spark, content.jaccard(F.lit("A b"), F.lit("b c"))) == pytest.approx(1 / 3) == one(spark, content.jaccard(F.lit("b c"), F.lit("A b")))


@pytest.mark.parametrize(("code", "want"), [("zh-TW", "zh"), ("pt_BR", "pt"), ("fil", "und"), ("ckb", "ckb"), ("xx", "xx"), ("eng", "en"), ("", "und"), (None, "und")])
def test_codes(spark, code, want):
    assert one(spark, language.normalize_code(F.lit(code).cast("string"))) == want


@pytest.mark.parametrize(("url", "want"), [("https://fr.example.com/", "fr"), ("http://shop.fr:8080/", None), ("https://pt-br.site.com", "pt"), ("https://a.co.uk/", "en"), ("https://example.com", None)])
def test_url_hint(spark, url, want):
    assert one(spark, language.url_hint(F.lit(url))) == want


def test_language_model_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = language.train_profiles(docs.filter("doc_id % 2 = 0"), "lang", "text")
    found = language.detect(docs.filter("doc_id % 2 = 1").select("doc_id", "text"), "doc_id", F.col("text"), profiles).join(docs, "doc_id").filter("content_source = 'trigrams'")
    total, right = found.count(), found.filter("content_lang = lang").count()
    assert total > 50 and right >= 0.95 * total


def test_segmenting_reads_back_what_is_written(spark):
    pairs = F.array(*(F.struct(F.lit(q).alias("question"), F.lit(a).alias("answer")) for q, a in (("One?", "yes"), ("Two?", "no"))))
    docs = spark.range(1).select("id", faq.extractive_document(F.lit("T"), F.lit("http://u"), pairs).alias("text"))
    assert [(r.question, r.answer) for r in faq.segment(docs, "id", "text").orderBy("pos").collect()] == [("One?", "yes"), ("Two?", "no")]
    assert one(spark, faq.inline_faqs(F.lit('{"question":"x"}'))) is None and one(spark, F.size(faq.inline_faqs(F.lit("[" + ",".join(["{}"] * 150) + "]")))) == 100
    assert '"@type":"FAQPage"' in faq.json_ld(faq.segment(docs, "id", "text"), "id").first().json


def test_bfs_depth_cap_and_seen(spark):
    links = spark.createDataFrame([("http://h/0", f"http://h/{i}", i) for i in (1, 2, 3)] + [("http://h/1", "http://h/4?q", 1), ("http://h/4", "http://h/5", 1), ("http://h/5", "http://h/6", 1), ("http://h/2", "http://h/a.png", 1), ("http://h/2", "http://o/x", 2)], "src string, dst string, pos int")
    start = spark.createDataFrame([("h", "http://h/0")], "site string, url string")
    assert [r.url[-1] for r in graph.bfs(start, links).orderBy("rank").collect()] == list("01234")
    assert [r.url[-1] for r in graph.bfs(start, links, max_pages=3).orderBy("rank").collect()] == list("012")
    seen = spark.createDataFrame([("http://h/1",)], "url string")
    assert [r.url[-1] for r in graph.bfs(start, links, seen).orderBy("rank").collect()] == list("023")


def test_feeds_and_sitemaps():
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><updated>u</updated><entry><published>p</published></entry></feed>'
    rss = "<rss><channel><lastBuildDate>l</lastBuildDate><item><pubDate>a</pubDate></item><item><date>b</date></item></channel></rss>"
    assert feeds.feed_times_of(atom) == ["u", "p"] and feeds.feed_times_of(rss) == ["l", "a", "b"]
    assert feeds.feed_times_of("<bad") == feeds.feed_times_of(None) == []
    assert feeds.sitemap_of("<urlset><url><loc>a</loc><lastmod>1</lastmod></url><url><loc>b</loc></url></urlset>") == [("url", "a", "1")]
    assert feeds.sitemap_of("<sitemapindex><sitemap><loc>m</loc></sitemap><url><loc>a</loc><lastmod>1</lastmod></url></sitemapindex>") == [("sitemap", "m", "")]
    assert feeds.sitemap_of("<html") == feeds.sitemap_of(None) == []


def test_markdown():
    html = "<html><head><title>T</title><script>x</script></head><body><h1>A <b>b</b></h1><p>p <a href='/u'>l</a><br>q</p><ul><li>one<li>two</ul><img alt=i src=s></body>"
    text = markdown.to_markdown_text(html)
    assert "# A **b**" in text and "[l](/u)" in text and "* one\n* two" in text and "![i](s)" in text and "x" not in text.replace("x)", "")
    assert markdown.to_markdown_text(None) == ""


def test_state_round_trip(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"http://a": {"content_hash": "c", "is_rtl": true}, "http://b": "last_modified:m|etag:a:b"}')
    rows = {r.url: r for r in stores.read_state(spark, str(tmp_path / "s.json")).collect()}
    assert rows["http://a"].content_hash == "c" and rows["http://a"].is_rtl and rows["http://b"].legacy == "last_modified:m|etag:a:b"
    (tmp_path / "bad.json").write_text("{oops")
    assert stores.read_state(spark, str(tmp_path / "bad.json")).count() == 0
    moved = state.migrate_legacy(stores.read_state(spark, str(tmp_path / "s.json")).filter("legacy is not null")).first()
    assert (moved.last_updated, moved.etag_header, moved.needs_recrawl) == ("m", "a:b", True)
    (tmp_path / "site_x.md").write_text("# T\n\n**URL:** http://u\n\nbody")
    assert stores.read_documents(spark, str(tmp_path)).first().prefix == "site"
    assert stores.read_bodies(spark, str(tmp_path / "s.json")).first().length > 0


def test_directive(spark):
    assert one(spark, language.directive(F.lit("und"), F.lit(0.9), F.lit(None).cast("string"))) == language.ENGLISH_DIRECTIVE
    text = one(spark, language.directive(F.lit("he"), F.lit(0.875), F.lit(None).cast("string")))
    assert "right-to-left" in text and "87.5%" in text


def test_detection_reads_whole_texts(spark):
    known = spark.createDataFrame([("en", "the cat and the dog " * 9), ("fr", "le chat et le chien " * 9), (None, "x" * 200), ("en", None)], "lang string, t string")
    profiles = language.train_profiles(known, "lang", "t")
    late = "zq " * 3000 + "le chat et le chien " * 40
    rows = spark.createDataFrame([(1, late), (2, "short"), (3, None), (4, "\U0001f600" * 150), (5, "the dog and the cat " * 8)], "id long, text string")
    found = {r.id: (r.content_lang, r.content_source) for r in language.detect(rows, "id", F.col("text"), profiles).collect()}
    assert found == {1: ("fr", "trigrams"), 2: ("und", "insufficient_text"), 3: ("und", "insufficient_text"), 4: ("und", "detection_failed"), 5: ("en", "trigrams")}
    untaught = language.detect(rows, "id", F.col("text"), language.train_profiles(known.limit(0), "lang", "t"))
    assert {r.content_source for r in untaught.collect()} == {"insufficient_text", "detection_failed"}


def test_conditional_requests(spark):
    old = {"last_modified_header": F.lit("Mon"), "etag_header": F.lit("")}
    assert one(spark, state.conditional_request(old)) == {"If-Modified-Since": "Mon"}
    both = {"last_modified_header": F.lit("Mon"), "etag_header": F.lit("e")}
    assert one(spark, state.not_modified(both, F.lit(200), F.lit("Mon"), F.lit("e"), F.lit(200))) == "headers_unchanged"
    assert one(spark, state.not_modified(old, F.lit(200), F.lit("Mon"), F.lit(""), F.lit(304))) == "get_304"
    assert one(spark, state.not_modified(old, F.lit(200), F.lit("Tue"), F.lit("e"), F.lit(200))) is None


def test_timed_cache(spark):
    at = lambda t: f"timestamp '2024-01-01 {t}'"
    sets = spark.sql(f"SELECT 'a' AS k, {at('10:00:00')} AS t")
    asked = spark.sql(" UNION ALL ".join(f"SELECT {i} AS id, '{k}' AS k, {at(t)} AS t" for i, (k, t) in enumerate([("a", "09:59:59"), ("a", "10:00:00"), ("a", "10:59:59"), ("a", "11:00:00"), ("b", "10:30:00")])))
    assert {r.id: r.hit for r in state.cached_lookup(asked, sets, "k", "t").collect()} == {0: False, 1: True, 2: True, 3: False, 4: False}


def test_raw_bodies(spark):
    rows = spark.createDataFrame([(1, "text/plain", b"word word other", "2024-02-29"), (2, "application/pdf", b"\xff\x00", "no"), (3, None, None, None)], "id long, content_type string, body binary, last_modified string")
    found = {r.id: r for r in stores.analyse_bodies(rows, "id", F.lit("2024-06-01").cast("timestamp")).collect()}
    assert found[1].fuzzy_hash and found[1].timestamp_source == "http_header" and found[1].content_hash != found[2].content_hash
    assert found[2].fuzzy_hash is None and found[2].timestamp_source == "none" and found[3].content_hash is None
