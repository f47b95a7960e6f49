"""Deterministic decorations of the driver's pages: SQL that Spark and DuckDB read alike."""

from __future__ import annotations

AS_OF = "2024-06-01 00:00:00"
DATE = "cast(date '2024-01-01' + cast(page_id % 120 as int) as string)"

_HEAD = lambda inner: f"replace(html, '</head>', {inner} || '</head>')"
_BODY = lambda inner: f"replace(html, '</article>', {inner} || '</article>')"

DECORATED = f"""CASE page_id % 8
  WHEN 0 THEN {_HEAD(f"'<script type=" + '"application/ld+json"' + '>{"@type":"Article","dateModified":"' + "' || " + DATE + " || '" + 'T10:00:00Z"}' + "</script>'")}
  WHEN 1 THEN {_HEAD(f"'<meta property=" + '"article:modified_time" content="' + f"' || {DATE} || 'T10:00:00+02:00" + '">' + "'")}
  WHEN 2 THEN {_BODY("'<time datetime=" + '"' + f"' || {DATE} || '" + '">x</time>' + "'")}
  WHEN 3 THEN {_HEAD("'<meta name=" + '"lastmod" content="' + f"' || {DATE} || ' 08:30:00" + '">' + "'")}
  WHEN 4 THEN {_BODY("'<p>posted ' || cast(page_id % 30 as string) || ' days ago</p>'")}
  WHEN 5 THEN {_BODY(f"'<p>12/31/2023 and ' || {DATE} || '</p>'")}
  WHEN 6 THEN {_HEAD("'<link rel=" + '"canonical" href="https://example.org/c/' + "' || cast(page_id as string) || '" + '"><meta property="og:locale" content="pt_BR"><link rel="alternate" hreflang="zh-TW" href="/zh"><link rel="alternate" hreflang="x-default" href="/"><meta http-equiv="content-language" content="x-default, fr-CA">' + "'").replace("replace(html,", "replace(replace(html, '</article>', '<h2 class=" + '"a"> Part <b>one</b> </h2><ul class="posts"><li data-id="i' + "' || cast(page_id as string) || '" + '"><a href="/article/7"> seven </a></li></ul><a class="page">3</a>' + "</article>'),", 1)}
  ELSE html END"""

PAGES = f"(SELECT page_id, url, {DECORATED} AS html FROM pages)"

# Snapshot v2: a changed paragraph, a changed advertisement, dropped and added rows.
V2_HTML = """CASE WHEN page_id % 5 = 0 THEN replace(html, '</article>', '<p>changed paragraph</p></article>')
  WHEN page_id % 5 = 1 THEN replace(html, 'class="ad">', 'class="ad">new ') ELSE html END"""
V2 = f"""(SELECT page_id, url, {V2_HTML} AS html FROM {PAGES} p WHERE page_id % 7 <> 0
  UNION ALL SELECT page_id + 1000000 AS page_id, url || '-new' AS url, html FROM {PAGES} q WHERE page_id % 50 = 0)"""

# URLs that the pages' own lack.
ODD_URLS = (
    "http://netflix.com/", "http://microsoft.com/", "http://awww.x.org/", "http://h.org/a/.png", "http://h.org/a.png;x", "http://h.org/a.PNG?v=1",
    "http://u:p@WWW.Ex.com:80/a;x?b#c", "https://h.org/p?SHARE=1", "https://h.org/Help/me", "HTTPS://www.h.org/x.tar.gz", "mailto:a@b.c", "ftp://h.org/f.zip",
    "https://fr.example.com/", "http://shop.fr:8080/x", "https://pt-br.site.com/", "https://site.co.uk/a/b/", "", "https://www.facebook.com/x",
)
ODD = " UNION ALL ".join(f"SELECT {900000 + i} AS page_id, '{u}' AS url" for i, u in enumerate(ODD_URLS))
ALL_URLS = f"(SELECT page_id, url FROM pages UNION ALL {ODD})"

TIMES = (
    "Wed, 21 Oct 2023 10:30:00 GMT", "2024-01-01T10:00:00.000Z", "2024-01-01 10:00:00 UTC", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00+02:00",
    "2024-01-01 10:00:00 EST", "13/02/2024", "02/13/2024", "May 5, 2024", "May 5 2024", "5 May 2024", "Chicago", "12/31/2099", "3 years ago 2 days ago",
    "5 hours ago", "1889-01-01", "2024-05-31 23:59", "  2024-02-30 ", "2024-02-29", "02/03/2024 04:05:06", "25/03/2024 04:05:06", "", "2024-06-01T12:00:00", "2024-06-03T12:00:00",
)
TIMES_SQL = "(" + " UNION ALL ".join(f"SELECT {i} AS id, '{t}' AS t" for i, t in enumerate(TIMES)) + ")"

CODES = ("en-US", "pt_BR", "zh-TW", "fil", "ckb", "xx", "eng", "xyz", "", "e1", " DE ", "fr-ca", "zh-hans", "ast", "a", "ast-es")
CODES_SQL = "(" + " UNION ALL ".join(f"SELECT {i} AS id, '{c}' AS code" for i, c in enumerate(CODES)) + ")"

FAQ_TEXTS = (
    "preamble\n**Q1**\nA\n\nB\n**Q2**\n**Q3**\n c \n", "# **C# basics**\nanswer\n## **not a question**\nmore", "**\nlost\n**Real?**\nyes",
    "# T\n\n**URL:** https://a.b/c\n\n**What is \"it\"?**\n<b>It & that</b> isn't", "",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
