"""Cleaning and structural extraction of HTML as Columns: folds of regular expressions, in one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions.fixed import ARTICLE, ARTICLE_LINK, BODY, CANONICAL, DATA_ID, HEADING, JSON_LD, MAIN, OG_URL, PAGE_NUMBER, TITLE, meta  # noqa: F401


def _without(text: Column, patterns, flags: str, by: str = "") -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, flags + p, by), patterns, text)


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, and written once in the plan."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def first(text: Column, pattern: str, group: int = 1, flags: str = "(?iud)") -> Column:
    """What the first match of a pattern captures; null without a match."""
    found = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))
    return F.try_element_at(found, F.lit(1))


def every(text: Column, pattern: str, group: int = 1, flags: str = "(?iud)") -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def clean_content(html: Column) -> Column:
    text = _without(html, fixed.DYNAMIC_PATTERNS, "(?iud)")
    return collapse(_without(text, (fixed.SCRIPT, fixed.STYLE, fixed.COMMENT), "(?ius)"))


def volatile_pattern(attribute: str, word: str) -> str:
    return rf"""<div[^>]*{attribute}=["'][^"']*{word}[^"']*["'][^>]*>.*?</div>"""


def remove_volatile(html: Column) -> Column:
    return _without(html, (fixed.SCRIPT, fixed.STYLE, *(volatile_pattern(*v) for v in fixed.VOLATILE_DIVS)), "(?ius)")


def canonical_content(html: Column) -> Column:
    return collapse(F.regexp_replace(remove_volatile(html), fixed.TAG, " "))


def microdata(name: str) -> str:
    return rf"""itemprop=["']{name}["'][^>]*content=["']([^"']+)["']"""


def title(html: Column) -> Column:
    return F.trim(first(html, TITLE))


def headings(html: Column) -> Column:
    return F.transform(every(html, HEADING, 2), lambda h: F.trim(h))


def canonical_url(html: Column, url: Column) -> Column:
    return F.coalesce(first(html, CANONICAL), first(html, OG_URL), url)


def listing_pattern(element: str, word: str) -> str:
    return rf"""<{element}[^>]*class=["'][^"']*{word}[^"']*["'][^>]*>"""


def is_listing(html: Column) -> Column:
    return reduce(lambda a, b: a | b, (html.rlike("(?iu)" + listing_pattern(*c)) for c in fixed.LISTING_CLASSES))


def article_links(html: Column) -> Column:
    return F.zip_with(every(html, ARTICLE_LINK, 1), every(html, ARTICLE_LINK, 2), lambda h, t: F.struct(h.alias("href"), F.trim(t).alias("text")))


def listing_content(html: Column) -> Column:
    return F.struct(article_links(html).alias("article_links"), every(html, DATA_ID).alias("item_ids"), first(html, PAGE_NUMBER).alias("page_number"))


def stable_elements(html: Column) -> Column:
    return F.struct(title(html).alias("title"), headings(html).alias("headings"), first(html, CANONICAL).alias("canonical_url"), first(html, OG_URL).alias("og_url"))


def _values_of(objects: Column, key: str) -> Column:
    return F.filter(F.transform(objects, lambda o: F.try_variant_get(o, f"$.{key}", "string")), lambda v: v.isNotNull())


def structured_data(html: Column) -> Column:
    """Dates of JSON-LD objects (later ones win) and of microdata, as a map."""
    blocks = F.filter(F.transform(every(html, JSON_LD, 1, "(?ius)"), lambda b: F.try_parse_json(b)), lambda b: b.isNotNull())
    objects = F.flatten(F.transform(blocks, lambda b: F.when(F.schema_of_variant(b).startswith("ARRAY"), F.try_variant_get(b, "$", "array<variant>")).otherwise(F.array(b))))
    pairs = []
    for key in fixed.JSON_LD_KEYS:
        pairs.append((f"json_ld_{key}", F.try_element_at(_values_of(objects, key), F.lit(-1))))
    for key in ("dateModified", "datePublished", "updated"):
        pairs.append((f"schema_{key}", first(html, microdata(key))))
    return F.map_filter(F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))), lambda _, v: v.isNotNull())


def structured_content(html: Column) -> Column:
    return F.struct(
        canonical_content(html).alias("canonical_content"),
        structured_data(html).alias("structured_data"),
        stable_elements(html).alias("stable_elements"),
        listing_content(html).alias("listing_content"),
    )


#: Characters that JSON has a short escape for, with it.
_SHORT_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def json_string(text: Column) -> Column:
    """A JSON string of ASCII characters alone, as serialisers in plain-ASCII mode write it; null stays null."""
    for mark, escape in _SHORT_ESCAPES:
        text = F.replace(text, F.lit(mark), F.lit(escape))
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def ascii_of(c: Column) -> Column:
        code = F.ascii(c)
        beyond = code - 0x10000
        pair = F.concat(unit(F.shiftright(beyond, 10) + 0xD800), unit(beyond.bitwiseAND(0x3FF) + 0xDC00))
        return F.when((code >= 32) & (code < 127), c).when(code < 0x10000, unit(code)).otherwise(pair)

    odd = text.rlike(r"[^\x20-\x7e]")
    parts = F.regexp_extract_all(text, F.lit(r"[\x20-\x7e]+|[^\x20-\x7e]"), F.lit(0))  # plain runs and other characters one by one
    return F.concat(F.lit('"'), F.when(odd, F.array_join(F.transform(parts, ascii_of), "")).otherwise(text), F.lit('"'))


def _json_object(pairs: list[tuple[str, Column]]) -> Column:
    """An object of the pairs whose value, JSON already, isn't null, in the order given."""
    written = F.array(*(F.concat(F.lit(f'"{k}": '), v) for k, v in pairs))
    return F.concat(F.lit("{"), F.array_join(written, ", "), F.lit("}"))


def _json_array(values: Column, write) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, write), ", "), F.lit("]"))


def structured_json(html: Column) -> Column:
    """structured_content as one JSON text: sorted keys, a blank after commas and colons, ASCII alone; absent parts left out."""

    def write(c: Column) -> Column:
        stable, listing = c["stable_elements"], c["listing_content"]
        data = F.transform(F.array_sort(F.map_entries(c["structured_data"])), lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_string(e["value"])))
        link = lambda x: _json_object([("href", json_string(x["href"])), ("text", json_string(x["text"]))])
        return _json_object(
            [
                ("canonical_content", json_string(c["canonical_content"])),
                ("listing_content", _json_object([("article_links", _json_array(listing["article_links"], link)), ("item_ids", _json_array(listing["item_ids"], json_string)), ("page_number", json_string(listing["page_number"]))])),
                ("stable_elements", _json_object([("canonical_url", json_string(stable["canonical_url"])), ("headings", _json_array(stable["headings"], json_string)), ("og_url", json_string(stable["og_url"])), ("title", json_string(stable["title"]))])),
                ("structured_data", F.concat(F.lit("{"), F.array_join(data, ", "), F.lit("}"))),
            ]
        )

    return let(structured_content(html), write)


def content_pattern(attribute: str, word: str) -> str:
    inside = rf"""[^"']*{word}[^"']*""" if attribute == "class" else word
    return rf"""<[^>]*{attribute}=["']{inside}["'][^>]*>(.*?)</[^>]*>"""


def text_content(html: Column) -> Column:
    """The content elements' inner HTML, joined selector by selector (overlaps repeat), else the body's, else the text."""
    bare = _without(html, (fixed.SCRIPT, fixed.STYLE, fixed.COMMENT), "(?ius)")
    parts = F.concat(*(every(bare, p, 1, "(?ius)") for p in (MAIN, ARTICLE, *(content_pattern(*s) for s in fixed.CONTENT_SELECTORS))))
    body = first(bare, BODY, 1, "(?ius)")
    return collapse(F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(F.coalesce(body, F.regexp_replace(bare, fixed.TAG, " "))))


def detection_text(text: Column) -> Column:
    for pattern in (r"<[^>]+>", r"https?://\S+", r"\S+@\S+", r"(?U)\s+", r"\b\d+\b", r"[^\p{L}\p{N}_\s.,!?;:()'\"-]"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(text)


TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of the distinct tokens; two texts without any are equal."""
    a, b = tokens(left), tokens(right)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def top_words(text: Column, top: int, by_place: bool) -> Column:
    """array<struct(word, n)>: a text's commonest words of over two letters, ties by first place or by the word.

    Words are sorted with their places, equal ones are runs, and runs are ranked: all inside the row, no shuffle.
    """
    placed = F.array_sort(F.filter(F.transform(tokens(text), lambda w, i: F.struct(w.alias("word"), i.alias("place"))), lambda x: F.length(x["word"]) > 2))
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x["word"].alias("word"), x["place"].alias("place"), i.alias("at"))), lambda x: (x["at"] == 0) | (F.element_at(s, F.greatest(x["at"], F.lit(1)))["word"] != x["word"]))

    def runs(pair: Column) -> Column:
        end = lambda k: F.coalesce(F.try_element_at(pair["starts"], k + 2)["at"], pair["size"])
        tie = lambda x: x["place"] if by_place else x["word"]
        return F.transform(pair["starts"], lambda x, k: F.struct((x["at"] - end(k)).alias("less"), tie(x).alias("tie"), x["word"].alias("word")))

    ranked = let(placed, lambda s: let(F.struct(starts(s).alias("starts"), F.size(s).alias("size")), runs))
    return F.transform(F.slice(F.array_sort(ranked), 1, top), lambda x: F.struct(x["word"].alias("word"), (-x["less"]).cast("bigint").alias("n")))


def markdown_title(markdown: Column) -> Column:
    return F.coalesce(F.trim(first(markdown, r"^# ([^\n]*)", 1, "(?md)")), F.lit("FAQ"))


def markdown_url(markdown: Column) -> Column:
    return F.trim(F.replace(first(markdown, r"^(\*\*URL:\*\*[^\n]*)", 1, "(?md)"), F.lit("**URL:**"), F.lit("")))


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text
