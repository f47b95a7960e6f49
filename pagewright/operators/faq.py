"""Question-and-answer documents: segmenting, look-up by page, site unions, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import content, urls

MAX_FAQS, MAX_INLINE_CHARS, MAX_INLINE_ITEMS = 10, 65_536, 100


def segment(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, question, answer): a bold line opens a question, the lines up to the next one are its answer.

    A running count of bold lines within the document numbers the groups; lines are joined in their order.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "raw")).select(key, "at", F.trim(F.regexp_replace("raw", r"[\t\r\f\x0b]", " ")).alias("line"))
    bold = (F.col("line").startswith("**") & F.col("line").endswith("**")) | (F.col("line").startswith("# **") & F.col("line").endswith("**"))
    w = Window.partitionBy(key).orderBy("at")
    marked = lines.withColumn("bold", bold).withColumn("pos", F.sum(F.col("bold").cast("int")).over(w)).filter("pos > 0")
    grouped = marked.groupBy(key, "pos").agg(F.array_sort(F.collect_list(F.struct("at", "bold", "line"))).alias("rows"))
    question = F.regexp_replace(F.replace(F.col("rows")[0]["line"], F.lit("# "), F.lit("")), r"^\*+|\*+$", "")
    answer = F.array_join(F.transform(F.filter("rows", lambda r: ~r["bold"] & (r["line"] != "")), lambda r: r["line"]), " ")
    return grouped.select(key, "pos", question.alias("question"), F.trim(answer).alias("answer")).filter("question <> '' and answer <> ''")


def extractive_document(title: Column, url: Column, pairs: Column) -> Column:
    """A document that segment() reads back: the header, then each question in bold and its answer."""
    body = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("**"), p["question"], F.lit("**\n"), p["answer"])), "\n\n")
    return F.concat(F.lit("# "), title, F.lit("\n\n**URL:** "), url, F.lit("\n\n"), body)


def page_document(html: Column, url: Column) -> Column:
    """The default, offline generator: the page's title as question, its first paragraph as answer."""
    title = F.coalesce(content.title(html), F.lit("FAQ"))
    paragraph = content.collapse(F.regexp_replace(F.coalesce(content.first(html, "<p>(.*?)</p>", 1, "(?ius)"), F.lit("")), "<[^>]+>", " "))
    return extractive_document(title, url, F.array(F.struct(title.alias("question"), paragraph.alias("answer"))))


def find_document(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(page_id, url, doc_key, found_key): a page's own document, else the least key of its host label."""
    wanted = pages.select("page_id", "url", urls.doc_key(F.col("url")).alias("doc_key"), urls.domain_prefix(F.col("url")).alias("prefix"))
    own = documents.select(F.col("doc_key").alias("found"), F.col("doc_key")).distinct()
    by_prefix = documents.select("doc_key", F.col("prefix")).groupBy("prefix").agg(F.min("doc_key").alias("any"))
    return wanted.join(own, "doc_key", "left").join(by_prefix, "prefix", "left").select("page_id", "url", "doc_key", F.coalesce("found", "any").alias("found_key"))


def missing_documents(pages: DataFrame, documents: DataFrame, markdown: DataFrame) -> DataFrame:
    """(page_id, url, action): followable pages without a document, by whether their markdown is there."""
    ok = pages.filter(~urls.is_media(F.col("url")) & ~urls.is_blocked(F.col("url")))
    lacking = find_document(ok, documents).filter("found_key is null")
    have = markdown.select("doc_key", F.lit(True).alias("has")).distinct()
    return lacking.join(have, "doc_key", "left").select("page_id", "url", F.when(F.col("has"), "generate").otherwise("recrawl").alias("action"))


def site_faqs(documents: DataFrame, text: str, prefix: str | None = None) -> DataFrame:
    """(doc_key, pos, question, answer, source_url) of all documents of a host label."""
    rows = documents if prefix is None else documents.filter(F.col("prefix") == prefix)
    sources = rows.select("doc_key", content.markdown_url(F.col(text)).alias("source_url"))
    return segment(rows, "doc_key", text).join(sources, "doc_key")


def valid_faqs(faqs: DataFrame, key: str, limit: int = MAX_FAQS) -> DataFrame:
    """The first `limit` rows of each key with a question and an answer: a top-k report."""
    kept = faqs.select(key, "pos", F.trim("question").alias("question"), F.trim("answer").alias("answer")).filter("question <> '' and answer <> ''")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.col("n") <= limit)


def inline_faqs(json: Column) -> Column:
    """Inline JSON as an array of at most MAX_INLINE_ITEMS pairs; null if it is too long or no array."""
    parsed = F.from_json(json, "array<struct<question:string,answer:string>>")
    return F.when((F.length(json) <= MAX_INLINE_CHARS) & F.ltrim(json).startswith("["), F.slice(parsed, 1, MAX_INLINE_ITEMS))


def render(faqs: DataFrame, key: str) -> DataFrame:
    """(key, html): a fragment per pair, in order; pairs with neither part are left out."""
    shown = faqs.filter("coalesce(question, '') <> '' or coalesce(answer, '') <> ''")
    item = F.concat(F.lit('<div class="faq"><h3>'), content.escape_html(F.coalesce("question", F.lit(""))), F.lit("</h3><p>"), content.escape_html(F.coalesce("answer", F.lit(""))), F.lit("</p></div>"))
    made = shown.select(key, "pos", item.alias("item"))
    return made.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda r: r["item"]), "").alias("html"))


def json_ld(faqs: DataFrame, key: str) -> DataFrame:
    """(key, json): schema.org FAQPage of each key's valid pairs."""
    entity = F.struct(F.lit("Question").alias("@type"), F.col("question").alias("name"), F.struct(F.lit("Answer").alias("@type"), F.col("answer").alias("text")).alias("acceptedAnswer"))
    made = valid_faqs(faqs, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", entity.alias("e")))), lambda r: r["e"]).alias("e"))
    return made.select(key, F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), F.col("e").alias("mainEntity"))).alias("json"))


def per_domain(pages: DataFrame, faqs: DataFrame) -> DataFrame:
    """(host, pages, faqs): pages by exact host, pairs by their page's host."""
    a = pages.groupBy(urls.netloc(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    b = faqs.groupBy(urls.netloc(F.col("source_url")).alias("host")).agg(F.count(F.lit(1)).alias("faqs"))
    return a.join(b, "host", "left").select("host", "pages", F.coalesce("faqs", F.lit(0)).alias("faqs"))
