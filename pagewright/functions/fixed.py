"""Word lists, formats and patterns that results depend on. They are data, in their natural order."""

# Extensions of media files.
MEDIA_EXTENSIONS = (
    ".jpg .jpeg .png .gif .webp .svg .bmp .tiff .ico .mp4 .webm .mov .avi .mkv .m3u8 .ts .flv .m4v "
    ".mp3 .wav .ogg .m4a .flac .woff .woff2 .ttf .otf .eot "
    ".pdf .doc .docx .xls .xlsx .ppt .pptx .csv .zip .rar .7z"
).split()

# Parts of host names, path parts and query parts that are never followed.
BLOCKED_HOSTS = (
    "facebook.com fbcdn.net twitter.com x.com t.co instagram.com linkedin.com "
    "googletagmanager.com google-analytics.com analytics.google.com doubleclick.net"
).split()
BLOCKED_PATHS = "/login /privacy /help /careers /settings /allactivity".split()
BLOCKED_QUERY = "share="
SKIPPED_RESOURCES = "image media font stylesheet".split()

# Patterns of dynamic content, in the order in which they are removed.
DYNAMIC_PATTERNS = (
    r"[?&](?:session|token|csrf|auth|key|id)=[a-zA-Z0-9_-]+",
    r"[?&]captcha=[a-zA-Z0-9_-]+",
    r"[?&]t=\d+",
    r"[?&]v=\d+",
    r"[?&]cache=\d+",
    r"[?&]timestamp=\d+",
    r'data-[a-zA-Z-]+="[^"]*"',
    r'id="[a-zA-Z0-9_-]*dynamic[a-zA-Z0-9_-]*"',
    r'class="[^"]*dynamic[^"]*"',
    r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{1,2}:\d{2}:\d{2}\b",
    r"\b\d{1,2}:\d{2}\s*(?:AM|PM)\b",
    r"Last updated:[^\n]*",
    r"Updated:[^\n]*",
    r"Modified:[^\n]*",
    r"Published:[^\n]*",
    r"Created:[^\n]*",
    r"\d+\s*(?:views?|likes?|shares?|comments?)",
    r"[0-9,]+ views",
    r"[0-9,]+ likes",
    r"Advertisement",
    r"Sponsored",
    r"Ad by",
    r"Promoted",
    r"google-analytics\.com",
    r"googletagmanager\.com",
    r"facebook\.net",
    r"connect\.facebook\.net",
    r"twitter\.com/widgets",
    r"platform\.twitter\.com",
)
SCRIPT, STYLE, COMMENT, TAG = r"<script[^>]*>.*?</script>", r"<style[^>]*>.*?</style>", r"<!--.*?-->", r"<[^>]+>"
# Fixed values: (attribute, word in it) of div elements that are volatile, in the order in which they are removed.
VOLATILE_DIVS = (
    ("class", "ad"), ("id", "ad"), ("class", "cookie"), ("id", "cookie"), ("class", "consent"),
    ("class", "ticker"), ("class", "timestamp"), ("class", "social"), ("class", "analytics"),
)
# Fixed values: (element, word in its class) by which a page counts as a listing.
LISTING_CLASSES = (("div", "list"), ("div", "grid"), ("div", "catalog"), ("div", "archive"), ("div", "index"), ("ul", "posts"), ("div", "articles"))

# Words in a class attribute, and ids, of elements that hold content, in the order in which they are joined.
CONTENT_SELECTORS = (
    ("class", "content"), ("id", "content"), ("class", "main-content"), ("id", "main"), ("class", "post-content"),
    ("class", "entry-content"), ("class", "article-content"), ("class", "story-content"), ("class", "page-content"),
)

# Hours between visits of hosts, and of all others.
RECRAWL_HOURS = {"news.example.com": 2, "blog.example.com": 4, "docs.example.com": 24, "help.example.com": 48}
DEFAULT_RECRAWL_HOURS = 12

# Languages written from right to left; names of Chinese scripts by region.
RTL = "ar he fa ur ps sd yi dv ku ckb".split()
CHINESE_SCRIPTS = {
    "zh-cn": "Simplified Chinese", "zh-tw": "Traditional Chinese", "zh-hk": "Traditional Chinese",
    "zh-sg": "Simplified Chinese", "zh-mo": "Traditional Chinese",
}
# Regional codes and their languages.
REGIONAL = {
    "en-us": "en", "en-gb": "en", "en-ca": "en", "en-au": "en", "es-es": "es", "es-mx": "es", "es-ar": "es", "es-cl": "es", "fr-fr": "fr",
    "fr-ca": "fr", "fr-be": "fr", "fr-ch": "fr", "de-de": "de", "de-at": "de", "de-ch": "de", "de-li": "de", "pt-br": "pt", "pt-pt": "pt",
    "zh-cn": "zh", "zh-tw": "zh", "zh-hk": "zh", "zh-sg": "zh", "ja-jp": "ja", "ko-kr": "ko", "ru-ru": "ru", "it-it": "it", "it-ch": "it",
    "nl-nl": "nl", "nl-be": "nl", "sv-se": "sv", "sv-fi": "sv", "da-dk": "da", "no-no": "no", "fi-fi": "fi", "pl-pl": "pl", "cs-cz": "cs",
    "sk-sk": "sk", "hu-hu": "hu", "ro-ro": "ro", "bg-bg": "bg", "hr-hr": "hr", "sl-si": "sl", "et-ee": "et", "lv-lv": "lv", "lt-lt": "lt",
    "mt-mt": "mt", "el-gr": "el", "tr-tr": "tr", "is-is": "is", "ga-ie": "ga", "cy-gb": "cy", "eu-es": "eu", "ca-es": "ca", "gl-es": "gl",
    "ast-es": "ast", "oc-fr": "oc", "br-fr": "br", "co-fr": "co", "rm-ch": "rm", "fur-it": "fur", "sc-it": "sc", "vec-it": "vec",
    "lmo-it": "lmo", "pms-it": "pms", "nap-it": "nap", "scn-it": "scn", "lij-it": "lij", "rgn-it": "rgn", "eml-it": "eml",
}
# Three-letter codes and what they become.
THREE_LETTER = {
    "eng": "en", "spa": "es", "fra": "fr", "deu": "de", "por": "pt", "zho": "zh", "jpn": "ja", "kor": "ko", "rus": "ru", "ita": "it",
    "nld": "nl", "swe": "sv", "dan": "da", "nor": "no", "fin": "fi", "pol": "pl", "ces": "cs", "slk": "sk", "hun": "hu", "ron": "ro",
    "bul": "bg", "hrv": "hr", "slv": "sl", "est": "et", "lav": "lv", "lit": "lt", "mlt": "mt", "ell": "el", "tur": "tr", "isl": "is",
    "gle": "ga", "cym": "cy", "eus": "eu", "cat": "ca", "glg": "gl", "ast": "ast", "oci": "oc", "bre": "br", "cos": "co", "roh": "rm",
    "fur": "fur", "srd": "sc", "vec": "vec", "lmo": "lmo", "pms": "pms", "nap": "nap", "scn": "scn", "lij": "lij", "rgn": "rgn",
    "eml": "eml", "ara": "ar", "heb": "he", "fas": "fa", "urd": "ur", "pus": "ps", "snd": "sd", "yid": "yi", "div": "dv", "kur": "ku",
    "ckb": "ckb",
}
# Top-level domains and the languages they hint at.
TOP_LEVEL = {
    "fr": "fr", "de": "de", "es": "es", "it": "it", "pt": "pt", "ru": "ru", "pl": "pl", "nl": "nl", "se": "sv", "no": "no", "dk": "da",
    "fi": "fi", "hu": "hu", "ro": "ro", "bg": "bg", "hr": "hr", "si": "sl", "sk": "sk", "cz": "cs", "ee": "et", "lv": "lv", "lt": "lt",
    "mt": "mt", "gr": "el", "tr": "tr", "is": "is", "ie": "ga", "uk": "en", "au": "en", "jp": "ja", "kr": "ko", "cn": "zh", "tw": "zh",
    "hk": "zh", "sg": "zh", "ar": "ar", "il": "he", "ir": "fa", "pk": "ur", "af": "ps", "sd": "sd", "yi": "yi", "mv": "dv", "iq": "ku",
}
# Names of languages.
LANGUAGE_NAMES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "pt": "Portuguese", "it": "Italian", "nl": "Dutch", "sv": "Swedish",
    "da": "Danish", "no": "Norwegian", "fi": "Finnish", "pl": "Polish", "cs": "Czech", "sk": "Slovak", "hu": "Hungarian", "ro": "Romanian",
    "bg": "Bulgarian", "hr": "Croatian", "sl": "Slovenian", "et": "Estonian", "lv": "Latvian", "lt": "Lithuanian", "mt": "Maltese",
    "el": "Greek", "tr": "Turkish", "is": "Icelandic", "ga": "Irish", "cy": "Welsh", "eu": "Basque", "ca": "Catalan", "gl": "Galician",
    "ast": "Asturian", "oc": "Occitan", "br": "Breton", "cos": "Corsican", "rm": "Romansh", "fur": "Friulian", "srd": "Sardinian",
    "vec": "Venetian", "lmo": "Lombard", "pms": "Piedmontese", "nap": "Neapolitan", "scn": "Sicilian", "lij": "Ligurian", "rgn": "Romagnol",
    "eml": "Emilian", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "ru": "Russian", "ar": "Arabic", "he": "Hebrew", "fa": "Persian",
    "ur": "Urdu", "ps": "Pashto", "sd": "Sindhi", "yi": "Yiddish", "dv": "Dhivehi", "ku": "Kurdish", "ckb": "Central Kurdish",
}

# Abbreviations of time zones. Those of UTC become +00:00; the others make a time unreadable.
UTC_NAMES, OTHER_ZONES = ("GMT", "UTC", "Z"), ("EST", "EDT", "CST", "CDT", "MST", "MDT", "PST", "PDT")
# Patterns of relative times, in order, with their length in seconds.
RELATIVE_UNITS = (("years", 365 * 86400), ("months", 30 * 86400), ("weeks", 7 * 86400), ("days", 86400), ("hours", 3600), ("minutes", 60))
EARLIEST = "1990-01-01 00:00:00"
# Keys of JSON-LD objects that hold dates.
JSON_LD_KEYS = ("dateModified", "datePublished", "lastModified", "updated", "modified")

# Where feeds and sitemaps are looked for, how many feeds are, and links to feeds.
FEED_PATHS = ("/feed", "/rss.xml", "/atom.xml", "/feed.xml", "/index.xml")
MAX_FEEDS = 5
FEED_LINK = r"""<link[^>]*rel=["']alternate["'][^>]*type=["'][^"']*(?:rss|atom|xml)[^"']*["'][^>]*href=["']([^"']+)["']"""
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/robots.txt")


def meta(attribute: str, names: str) -> str:
    """A meta element whose attribute has one of the names, capturing its content."""
    return rf"""<meta[^>]*{attribute}=["'](?:{names})["'][^>]*content=["']([^"']+)["']"""


# Elements of a page.
TITLE, HEADING = r"<title[^>]*>(.*?)</title>", r"<h([1-6])[^>]*>(.*?)</h\1>"
CANONICAL = r"""<link[^>]*rel=["']canonical["'][^>]*href=["']([^"']+)["']"""
OG_URL = meta("property", "og:url")
ARTICLE_LINK = r"""<a[^>]*href=["']([^"']*article[^"']*)["'][^>]*>(.*?)</a>"""
DATA_ID, PAGE_NUMBER = r"""data-id=["']([^"']+)["']""", r"page[^>]*>(\d+)</[^>]*>"
JSON_LD = r"""<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
MAIN, ARTICLE, BODY = r"<main[^>]*>(.*?)</main>", r"<article[^>]*>(.*?)</article>", r"<body[^>]*>(.*?)</body>"
HTML_LANG = r"""<html[^>]*lang=["']([^"']+)["']"""
HREFLANG = r"""<link[^>]*hreflang=["']([^"']+)["'][^>]*>"""
ALTERNATE = r"""<link[^>]*rel=["']alternate["'][^>]*hreflang=["']([^"']+)["'][^>]*>"""

# Where pages write their times, in order of priority within each source.
OG_NAMES = ("article:modified_time", "og:updated_time", "article:published_time")
VISIBLE = (
    r"""<time[^>]*datetime=["']([^"']+)["'][^>]*>""",
    r"""<span[^>]*class=["'][^"']*date[^"']*["'][^>]*>([^<]+)</span>""",
    r"""<div[^>]*class=["'][^"']*date[^"']*["'][^>]*>([^<]+)</div>""",
    r"Updated[^:]*:\s*([^\n\r<]+)",
    r"Last updated[^:]*:\s*([^\n\r<]+)",
    r"Modified[^:]*:\s*([^\n\r<]+)",
)
META_PATTERNS = (
    meta("name", "last-modified|lastmod|modified|updated|date"),
    meta("property", "article:modified_time|og:updated_time"),
    meta("http-equiv", "last-modified"),
)
# Seven label patterns of this source can capture one character only, so no time; they are left out.
CONTENT_PATTERNS = (
    *(rf'"{key}":\s*"([^"]+)"' for key in ("dateModified", "lastModified", "updated", "modified")),
    *VISIBLE[:3],
    meta("property", "article:modified_time"),
    meta("name", "modified_date"),
)
# Dates anywhere on a page, with the format they are read by; of the months, May alone is known by name.
PAGE_DATES = (
    (r"\b(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+-]\d{2}:\d{2})\b", "yyyy-M-d'T'H:m:s[XXX][XX]"),
    (r"\b(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\b", "yyyy-M-d'T'H:m:s[XXX][XX]"),
    (r"\b(\d{1,2}/\d{1,2}/\d{4})\b", "M/d/yyyy"),
    (r"\b(\d{4}-\d{2}-\d{2})\b", "yyyy-M-d"),
    (r"\b(May \d{1,2}, \d{4})\b", "MMMM d, yyyy"),
    (r"\b(May \d{1,2} \d{4})\b", "MMMM d yyyy"),
    (r"\b(\d{1,2} May \d{4})\b", "d MMMM yyyy"),
)

# The sentences of a language directive; braces hold the language's name, its code, a script and a confidence.
ENGLISH_DIRECTIVE = "REQUIREMENT: Write the FAQs in English. If the page content is in a different language, translate the FAQs to English."
DIRECTIVE = (
    "REQUIREMENT: Write the FAQs strictly in {name} (language code: {code}). Both questions and answers must be in {name}. ",
    "Note: {name} is a right-to-left language. ",
    "Use {script} script. ",
    "Generate FAQs in the same language as the page content. The detected language is {code} with {confidence} confidence. You must use {name} for both questions and answers.",
)
TARGET_DIRECTIVE = "LANGUAGE REQUIREMENT: Generate FAQs in {code} language. Both questions and answers must be in {code}."
# Fixed value: what is told where a page has no document and none could be made.
NO_DOCUMENT = "No FAQ file found for this URL and could not generate one"
