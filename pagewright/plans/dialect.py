"""DuckDB expressions for the oracles: regular expressions without look-around, times, codes."""

from __future__ import annotations

from pagewright.functions import content, fixed, timestamps
from pagewright.functions.urls import URL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, by: str = "", options: str = "g") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(by)}, '{options}')"


def fold(expr: str, patterns, options: str, by: str = "") -> str:
    for p in patterns:
        expr = sub(expr, p, by, options)
    return expr


def every(expr: str, pattern: str, group: int = 1, options: str = "i") -> str:
    return f"regexp_extract_all({expr}, {q(pattern)}, {group}, '{options}')"


def first(expr: str, pattern: str, group: int = 1, options: str = "i") -> str:
    return f"({every(expr, pattern, group, options)})[1]"


def has(expr: str, pattern: str, options: str = "i") -> str:
    return f"regexp_matches({expr}, {q(pattern)}, '{options}')"


def collapse(expr: str) -> str:
    return f"trim({sub(expr, r'\s+', ' ')})"


def part(url: str, group: int) -> str:
    return f"regexp_extract({url}, {q(URL)}, {group}, 's')"


def scheme(url: str) -> str:
    return f"lower({part(url, 1)})"


def netloc(url: str) -> str:
    return part(url, 2)


def path(url: str) -> str:
    return sub(part(url, 3), ";[^/]*$")


def plain(host: str) -> str:
    return f"replace(lower({host}), 'www.', '')"


def strip_query(url: str) -> str:
    bare = sub(url, r"[?#].*$", "", "gs")
    head = f"regexp_extract({bare}, '^([^:/?#]+:)', 1)"
    return f"lower({head}) || substr({bare}, length({head}) + 1)"


def is_media(url: str) -> str:
    ext = rf"regexp_extract(lower({path(url)}), '[^/.][^/]*(\.[^./]*)$', 1)"
    return f"{ext} IN ({', '.join(map(q, fixed.MEDIA_EXTENSIONS))})"


def is_blocked(url: str, base: str | None = None) -> str:
    host = plain(netloc(url))
    tests = [f"contains({host}, {q(x)})" for x in fixed.BLOCKED_HOSTS] + [f"contains(lower({path(url)}), {q(x)})" for x in fixed.BLOCKED_PATHS]
    tests.append(f"contains(lower({part(url, 4)}), {q(fixed.BLOCKED_QUERY)})")
    if base:
        tests.append(f"({plain(base)} <> '' AND {host} <> '' AND {plain(base)} <> {host})")
    return "(" + " OR ".join(tests) + ")"


def prefix(url: str) -> str:
    return rf"regexp_extract(replace({netloc(url)}, 'www.', ''), '^([^.]*)', 1)"


def doc_key(url: str) -> str:
    seg = f"regexp_extract({path(url)}, '([^/]+)/*$', 1)"
    return f"substr({prefix(url)} || '_' || {sub(f"CASE WHEN {seg} = '' THEN 'index' ELSE {seg} END", r'[^\p{L}\p{N}_-]', '_')}, 1, 255)"


def clean(html: str) -> str:
    return collapse(fold(fold(html, fixed.DYNAMIC_PATTERNS, "gi"), (fixed.SCRIPT, fixed.STYLE, fixed.COMMENT), "gis"))


def volatile(html: str) -> str:
    return fold(html, (fixed.SCRIPT, fixed.STYLE, *(content.volatile_pattern(*v) for v in fixed.VOLATILE_DIVS)), "gis")


def canonical(html: str) -> str:
    return collapse(sub(volatile(html), fixed.TAG, " "))


def text_content(html: str) -> str:
    bare = fold(html, (fixed.SCRIPT, fixed.STYLE, fixed.COMMENT), "gis")
    parts = "[]::VARCHAR[]"
    for p in (content.MAIN, content.ARTICLE, *(content.content_pattern(*s) for s in fixed.CONTENT_SELECTORS)):
        parts = f"list_concat({parts}, {every('bare', p, 1, 'is')})"
    inner = f"CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' ') ELSE coalesce({first('bare', content.BODY, 1, 'is')}, {sub('bare', fixed.TAG, ' ')}) END"
    return f"(SELECT {collapse(inner)} FROM (SELECT bare, {parts} AS parts FROM (SELECT {bare} AS bare)))"


def tokens(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def case_map(values: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in values.items()) + " END"


def normalize_code(code: str) -> str:
    c = f"lower(trim({code}))"
    primary = f"regexp_extract({c}, '^([^-_]*)', 1)"
    regional = case_map(fixed.REGIONAL, c)
    three = f"coalesce({case_map(fixed.THREE_LETTER, primary)}, 'und')"
    told = rf"CASE WHEN regexp_full_match({primary}, '\p{{L}}{{2}}') THEN {primary} WHEN regexp_full_match({primary}, '\p{{L}}{{3}}') THEN {three} ELSE 'und' END"
    return f"CASE WHEN {code} IS NULL OR {code} = '' THEN 'und' ELSE coalesce({regional}, {told}) END"


def url_hint(url: str) -> str:
    host = f"lower({netloc(url)})"
    top = case_map(fixed.TOP_LEVEL, rf"regexp_extract({host}, '\.([^.]*)$', 1)")
    label = rf"regexp_extract({host}, '^([^.]*)\.', 1)"
    return rf"coalesce({top}, CASE WHEN regexp_full_match({label}, '\p{{L}}{{2}}') THEN {normalize_code(label)} END, {case_map(fixed.REGIONAL, label)})"


_STRP = {
    timestamps.ISO_OFFSET: None,
    timestamps.SQL_TIME: "%Y-%m-%d %H:%M:%S",
    timestamps.DAY: "%Y-%m-%d",
    "M/d/yyyy": "%m/%d/%Y",
    "d/M/yyyy": "%d/%m/%Y",
    "MMMM d, yyyy": "%B %d, %Y",
    "MMMM d yyyy": "%B %d %Y",
    "d MMMM yyyy": "%d %B %Y",
    "yyyy-M-d H:m": "%Y-%m-%d %H:%M",
    "M/d/yyyy H:m:s": "%m/%d/%Y %H:%M:%S",
    "d/M/yyyy H:m:s": "%d/%m/%Y %H:%M:%S",
}


def parsed(text: str, pattern: str) -> str:
    shape = timestamps._SHAPES[pattern]
    if pattern == timestamps.ISO_OFFSET:
        zoned = f"(try_strptime(replace({text}, 'Z', '+00:00'), '%Y-%m-%dT%H:%M:%S%z') AT TIME ZONE 'UTC')"
        bare = f"try_strptime({text}, '%Y-%m-%dT%H:%M:%S')"
        return rf"CASE WHEN regexp_matches({text}, '(Z|[+-]\d{{2}}:?\d{{2}})$') AND {has(text, shape, 'c')} THEN {zoned} WHEN {has(text, shape, 'c')} THEN {bare} END"
    if pattern == timestamps.RFC:
        rest = sub(text, timestamps.WEEKDAY)
        return f"CASE WHEN {has(text, timestamps.WEEKDAY, 'c')} AND {has(rest, shape, 'c')} THEN (try_strptime({rest}, '%d %b %Y %H:%M:%S %z') AT TIME ZONE 'UTC') END"
    return f"CASE WHEN {has(text, shape, 'c')} THEN try_strptime({text}, {q(_STRP[pattern])}) END"


def reasonable(ts: str, as_of: str) -> str:
    return f"({ts} >= TIMESTAMP '{fixed.EARLIEST}' AND {ts} <= TIMESTAMP '{as_of}' + INTERVAL 1 DAY)"


def first_reasonable(text: str, patterns, as_of: str) -> str:
    return "coalesce(" + ", ".join(f"(SELECT CASE WHEN {reasonable('ts', as_of)} THEN ts END FROM (SELECT {parsed(text, p)} AS ts))" for p in patterns) + ")"


def relative(text: str, as_of: str) -> str:
    tried = []
    for unit, seconds in fixed.RELATIVE_UNITS:
        amount = f"try_cast({first(text, rf'(\d+)\s*{unit[:-1]}s?\s*ago')} AS BIGINT)"
        tried.append(f"(SELECT CASE WHEN n < 100000000 AND {reasonable('ts', as_of)} THEN ts END FROM (SELECT n, CASE WHEN n < 100000000 THEN TIMESTAMP '{as_of}' - to_seconds(n * {seconds}) END AS ts FROM (SELECT {amount} AS n)))")
    return "coalesce(" + ", ".join(tried) + ")"


def normalize(text: str, as_of: str) -> str:
    """A scalar subquery, so that the text is written once."""
    plain_text = "written"
    for name in fixed.OTHER_ZONES:
        plain_text = sub(plain_text, rf"(?i)\b{name}\b", "+-")
    for name in fixed.UTC_NAMES:
        plain_text = sub(plain_text, rf"(?i)\b{name}\b", "+00:00")
    plain_text = sub(plain_text, r"(?i)(\d)Z$", r"\1Z")
    ago, tried = relative("written", as_of), first_reasonable("plain", timestamps.NORMAL_FORMATS, as_of)
    return f"(SELECT CASE WHEN contains(lower(written), 'ago') THEN {ago} ELSE {tried} END FROM (SELECT written, {plain_text} AS plain FROM (SELECT trim({text}) AS written)))"


def comparable(text: str) -> str:
    utc = f"CASE WHEN regexp_matches({text}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}} \\d{{1,2}}:\\d{{1,2}}:\\d{{1,2}} UTC$') THEN try_strptime(replace({text}, ' UTC', ''), '%Y-%m-%d %H:%M:%S') END"
    rest = "coalesce(" + ", ".join(parsed(text, p) for p in timestamps.COMPARED_FORMATS) + ")"
    return f"CASE WHEN contains({text}, ' UTC') THEN {utc} WHEN contains({text}, 'T') THEN {parsed(text, timestamps.ISO_OFFSET)} ELSE {rest} END"


def utc_text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S') || ' UTC'"
