"""Timestamps of pages as Columns. Every clock is an argument, `as_of`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions.content import every, first, let, microdata
from pagewright.functions.fixed import CONTENT_PATTERNS, JSON_LD, META_PATTERNS, OG_NAMES, PAGE_DATES, VISIBLE, meta

# Formats in order of trial: Spark's pattern, and what must match before it is tried.
ISO_OFFSET, ISO, SQL_TIME, DAY = "yyyy-M-d'T'H:m:s[XXX][XX]", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d"
RFC = "d MMM yyyy H:m:s [XXX][XX]"
NORMAL_FORMATS = (ISO_OFFSET, SQL_TIME, RFC, DAY, "M/d/yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy", "yyyy-M-d H:m", "M/d/yyyy H:m:s", "d/M/yyyy H:m:s")
META_FORMATS = (ISO_OFFSET, SQL_TIME, DAY)
CONTENT_FORMATS = (ISO_OFFSET, SQL_TIME, DAY, "M/d/yyyy", "MMMM d, yyyy", "MMMM d yyyy")
COMPARED_FORMATS = (DAY, "M/d/yyyy", "MMMM d, yyyy", "MMMM d yyyy")
_SHAPES = {
    ISO_OFFSET: r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(Z|[+-]\d{2}:?\d{2})?$",
    SQL_TIME: r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    RFC: r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2} [+-]\d{2}:?\d{2}$",
    DAY: r"^\d{4}-\d{1,2}-\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]+ \d{1,2}, \d{4}$",
    "MMMM d yyyy": r"^[A-Za-z]+ \d{1,2} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]+ \d{4}$",
    "yyyy-M-d H:m": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$",
    "M/d/yyyy H:m:s": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$",
    "d/M/yyyy H:m:s": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$",
}
WEEKDAY = "(?i)^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), "


def _parsed(text: Column, pattern: str) -> Column:
    if pattern == RFC:
        rest = F.regexp_replace(text, WEEKDAY, "")
        return F.when(text.rlike(WEEKDAY) & rest.rlike(_SHAPES[RFC]), F.try_to_timestamp(rest, F.lit(RFC)))
    return F.when(text.rlike(_SHAPES[pattern]), F.try_to_timestamp(text, F.lit(pattern)))


def reasonable(when: Column, as_of: Column) -> Column:
    """From 1990 on, and not over a day after as_of."""
    return (when >= F.lit(fixed.EARLIEST).cast("timestamp")) & (when <= as_of + F.expr("interval 1 day"))


def _first_reasonable(text: Column, patterns, as_of: Column) -> Column:
    """The first reasonable reading of a text, or of the first readable one of an array's texts."""
    tried = lambda x: F.filter(F.array(*(_parsed(x, p) for p in patterns)), lambda t: reasonable(t, as_of))
    return F.try_element_at(let(text, tried), F.lit(1))


def utc_text(when: Column) -> Column:
    return F.concat(F.date_format(when, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def _ago(amount: Column, seconds: int, as_of: Column) -> Column:
    return let(amount, lambda n: F.when(n < 100_000_000, F.timestamp_seconds(F.unix_timestamp(as_of) - n * seconds)))


def relative_time(text: Column, as_of: Column) -> Column:
    """The first reasonable of years, months, weeks, days, hours and minutes ago, in this order."""
    tried = []
    for unit, seconds in fixed.RELATIVE_UNITS:
        amount = first(text, rf"(\d+)\s*{unit[:-1]}s?\s*ago").try_cast("bigint")
        tried.append(_ago(amount, seconds, as_of))
    return F.try_element_at(F.filter(F.array(*tried), lambda t: reasonable(t, as_of)), F.lit(1))


def normalize(text: Column, as_of: Column) -> Column:
    """A written time as a UTC timestamp, or null: sixteen notations, tried in order; unreasonable readings are passed over."""

    def plain(t: Column) -> Column:
        for name in fixed.OTHER_ZONES:
            t = F.regexp_replace(t, rf"(?i)\b{name}\b", "+-")
        for name in fixed.UTC_NAMES:
            t = F.regexp_replace(t, rf"(?i)\b{name}\b", "+00:00")
        # 'Z' after a digit isn't a word of its own, yet a literal Z ends the second notation
        return F.regexp_replace(t, r"(?i)(\d)Z$", "$1Z")

    return let(F.trim(text), lambda t: F.when(F.contains(F.lower(t), F.lit("ago")), relative_time(t, as_of)).otherwise(_first_reasonable(plain(t), NORMAL_FORMATS, as_of)))


def first_normal(texts: list, as_of: Column) -> Column:
    """The first of several texts that can be read."""
    read = F.transform(F.filter(F.array(*texts), lambda t: t.isNotNull()), lambda t: normalize(t, as_of))
    return F.try_element_at(F.filter(read, lambda t: t.isNotNull()), F.lit(1))


def comparable(text: Column) -> Column:
    """Stored times as timestamps: with ' UTC', ISO with or without offset, or one of four dates."""
    utc = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2} UTC$"), F.try_to_timestamp(F.replace(text, F.lit(" UTC"), F.lit("")), F.lit(SQL_TIME)))
    return F.when(F.contains(text, F.lit(" UTC")), utc).when(F.contains(text, F.lit("T")), _parsed(text, ISO_OFFSET)).otherwise(F.coalesce(*(_parsed(text, p) for p in COMPARED_FORMATS)))


def is_reasonable(text: Column, as_of: Column) -> Column:
    return F.coalesce(reasonable(comparable(text), as_of), F.lit(False))


# --- sources, in order of priority ---

def schema_time(html: Column, as_of: Column) -> Column:
    """The dateModified of the first JSON-LD object, list item or @graph item that has one (even if it can't be read);
    without any, the microdata's."""
    blocks = F.transform(every(html, JSON_LD, 1, "(?ius)"), lambda b: F.try_parse_json(F.regexp_replace(F.regexp_replace(F.trim(b), "(?s)<!--.*?-->", ""), r"(?s)<!\[CDATA\[.*?\]\]>", "")))

    def dates(block: Column) -> Column:
        none = F.expr("cast(array() as array<variant>)")
        items = F.when(F.schema_of_variant(block).startswith("ARRAY"), F.try_variant_get(block, "$", "array<variant>")).otherwise(
            F.concat(F.array(block), F.coalesce(F.try_variant_get(block, '$["@graph"]', "array<variant>"), none))
        )
        return F.filter(F.transform(F.coalesce(items, none), lambda i: F.try_variant_get(i, "$.dateModified", "string")), lambda d: d.isNotNull())

    found = F.try_element_at(F.flatten(F.transform(F.filter(blocks, lambda b: b.isNotNull()), dates)), F.lit(1))
    return F.when(found.isNotNull(), normalize(found, as_of)).otherwise(normalize(first(html, microdata("dateModified")), as_of))


def og_time(html: Column, as_of: Column) -> Column:
    return first_normal([first(html, meta("property", n)) for n in OG_NAMES], as_of)


def visible_time(html: Column, as_of: Column) -> Column:
    return first_normal([first(html, p) for p in VISIBLE], as_of)


def _first_of(texts: list, patterns, as_of: Column) -> Column:
    read = F.transform(F.filter(F.array(*texts), lambda t: t.isNotNull()), lambda t: _first_reasonable(t, patterns, as_of))
    return F.try_element_at(F.filter(read, lambda t: t.isNotNull()), F.lit(1))


def meta_time(html: Column, as_of: Column) -> Column:
    return _first_of([first(html, p) for p in META_PATTERNS], META_FORMATS, as_of)


def content_time(html: Column, as_of: Column) -> Column:
    return F.coalesce(_first_of([first(html, p) for p in CONTENT_PATTERNS], CONTENT_FORMATS, as_of), relative_time(html, as_of))


def _times_of(texts: Column, pattern: str) -> Column:
    return F.transform(texts, lambda x: F.try_to_timestamp(x, F.lit(pattern)))


def page_date(html: Column) -> Column:
    """The latest date written anywhere on a page. Of the months, May alone is read by name."""
    return F.array_max(F.concat(*(_times_of(every(html, p), f) for p, f in PAGE_DATES)))


def last_updated(html: Column, as_of: Column, feed_time: Column | None = None, header: Column | None = None) -> Column:
    """struct(ts, source): the first source of the cascade that gives a time."""
    empty = F.lit(None).cast("timestamp")
    sources = [
        ("schema", schema_time(html, as_of)),
        ("og", og_time(html, as_of)),
        ("rss_or_atom", empty if feed_time is None else feed_time),
        ("visible", visible_time(html, as_of)),
        ("meta_tag", meta_time(html, as_of)),
        ("content_extraction", content_time(html, as_of)),
        ("http_header", empty if header is None else normalize(header, as_of)),
        ("page_date_extraction", page_date(html)),
    ]
    made = F.array(*(F.struct(ts.alias("ts"), F.lit(name).alias("source")) for name, ts in sources))
    nothing = F.struct(empty.alias("ts"), F.lit("none").alias("source"))
    return F.coalesce(F.try_element_at(F.filter(made, lambda s: s["ts"].isNotNull()), F.lit(1)), nothing)


def latest_feed_time(times: Column, as_of: Column, compat: bool = False) -> Column:
    """The latest readable time of a feed, or the first, where compat asks for what the original really does."""
    read = F.filter(F.transform(times, lambda t: normalize(t, as_of)), lambda t: t.isNotNull())
    return F.try_element_at(read, F.lit(1)) if compat else F.array_max(read)
