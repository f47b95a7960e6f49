"""URL algebra as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import fixed

#: Scheme, authority, path, query and fragment, by the grammar of RFC 3986, appendix B.
URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?s)" + URL, group)


def scheme(url: Column) -> Column:
    return F.lower(url_part(url, 1))


def netloc(url: Column) -> Column:
    return url_part(url, 2)


def path(url: Column) -> Column:
    """Without the parameters of its last segment."""
    return F.regexp_replace(url_part(url, 3), ";[^/]*$", "")


def query(url: Column) -> Column:
    return url_part(url, 4)


def normalize_netloc(host: Column) -> Column:
    return F.replace(F.lower(host), F.lit("www."), F.lit(""))


def same_domain(url: Column, base: Column) -> Column:
    return normalize_netloc(netloc(url)) == normalize_netloc(netloc(base))


def strip_query(url: Column, keep: list[str] | None = None) -> Column:
    """Without query and fragment, or with the kept query keys alone: the last of equal keys, blanks dropped."""
    bare = F.regexp_replace(url, r"(?s)[?#].*$", "")
    head = F.regexp_extract(bare, "^([^:/?#]+:)", 1)
    bare = F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))
    if not keep:
        return bare
    pairs = F.transform(F.split(query(url), "&"), lambda p: F.split(p, "=", 2))
    wanted = F.filter(pairs, lambda p: (F.size(p) == 2) & (p[1] != "") & p[0].isin(*keep))
    names = F.array_distinct(F.transform(wanted, lambda p: p[0]))
    last = lambda n: F.element_at(F.filter(wanted, lambda p: p[0] == n), -1)[1]
    decoded = lambda v: F.try_url_decode(v)
    text = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("="), F.url_encode(F.coalesce(decoded(last(n)), last(n))))), "&")
    return F.when(text == "", bare).otherwise(F.concat(bare, F.lit("?"), text))


def extension(url: Column) -> Column:
    return F.regexp_extract(F.lower(path(url)), r"[^/.][^/]*(\.[^./]*)$", 1)


def is_media(url: Column) -> Column:
    return extension(url).isin(*fixed.MEDIA_EXTENSIONS)


def is_blocked(url: Column, base_netloc: Column | None = None) -> Column:
    """Off the base's domain, or a blocked host, path or query; hosts match as substrings. No URL counts as blocked."""
    host, lower_path = normalize_netloc(netloc(url)), F.lower(path(url))
    out = F.lit(False)
    if base_netloc is not None:
        base = normalize_netloc(base_netloc)
        out = out | ((base != "") & (host != "") & (base != host))
    for part in fixed.BLOCKED_HOSTS:
        out = out | F.contains(host, F.lit(part))
    for part in fixed.BLOCKED_PATHS:
        out = out | F.contains(lower_path, F.lit(part))
    return F.coalesce(out | F.contains(F.lower(query(url)), F.lit(fixed.BLOCKED_QUERY)), F.lit(True))


def is_followable(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def is_skipped_resource(url: Column, kind: Column, base_netloc: Column) -> Column:
    third_party = (normalize_netloc(netloc(url)) != normalize_netloc(base_netloc)) & kind.isin("xhr", "fetch")
    return kind.isin(*fixed.SKIPPED_RESOURCES) | is_media(url) | is_blocked(url) | third_party


def without_dots(joined: Column) -> Column:
    """A path with its '.' and '..' segments resolved: a fold over segments, each '..' dropping the one before it."""
    segments = F.split(joined, "/")
    step = lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
    body = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
    folded = F.aggregate(body, F.array(F.lit("")), step)
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(folded, "/"), tail)


def resolve(href: Column, current: Column, to_root: bool = False) -> Column:
    """The absolute URL of a link, null for links that are skipped.

    to_root False: '/x' hangs on the current host (so '//h' isn't protocol-relative), others on the current folder.
    to_root True: '//h/p' names a host; all relative links hang on the root of the current host.
    """
    link = F.trim(href)
    origin = F.concat(scheme(current), F.lit("://"), netloc(current))
    absolute = F.lower(link).startswith("http")
    skipped = link.isNull() | (link == "") | link.startswith("#") | link.startswith("mailto:") | link.startswith("tel:")
    has_scheme = link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    if to_root:
        rooted = F.concat(origin, F.lit("/"), F.regexp_replace(link, "^/+", ""))
        return F.when(skipped, None).when(absolute | has_scheme, link).when(link.startswith("//"), F.concat(scheme(current), F.lit(":"), link)).when(link.startswith("?"), F.concat(origin, link)).otherwise(rooted)
    folder = F.regexp_extract(path(current), "^(.*/)", 1)
    target = F.regexp_extract(link, "^([^?#]*)", 1)
    rest = F.regexp_extract(link, "^[^?#]*(.*)$", 1)
    base = F.when(folder == "", F.lit("/")).otherwise(folder)
    relative = F.when(target == "", F.concat(origin, path(current), rest)).otherwise(F.concat(origin, without_dots(F.concat(base, target)), rest))
    return F.when(skipped, None).when(link.startswith("/"), F.concat(origin, link)).when(absolute | has_scheme, link).otherwise(relative)


def domain_prefix(url: Column) -> Column:
    return F.regexp_extract(F.replace(netloc(url), F.lit("www."), F.lit("")), r"^([^.]*)", 1)


def doc_key(url: Column) -> Column:
    """Host label and last path segment; distinct URLs may share one."""
    segment = F.regexp_extract(path(url), "([^/]+)/*$", 1)
    slug = F.regexp_replace(F.when(segment == "", F.lit("index")).otherwise(segment), r"[^\p{L}\p{N}_-]", "_")
    return F.substring(F.concat_ws("_", domain_prefix(url), slug), 1, 255)


def links(html: Column) -> Column:
    """The href of each anchor, in the order of the document."""
    return F.regexp_extract_all(html, F.lit(r"""(?iu)<a\b[^>]*\bhref=["']([^"']*)"""), F.lit(1))
