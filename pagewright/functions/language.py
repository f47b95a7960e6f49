"""Language of pages as Columns: hints, codes, blending and directives."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import content, fixed, urls
from pagewright.functions.content import every, first, meta
from pagewright.functions.fixed import ALTERNATE, ENGLISH_DIRECTIVE, HREFLANG, HTML_LANG, REGIONAL

def _map(values: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def _look_up(values: dict, key: Column) -> Column:
    return F.try_element_at(_map(values), key)


def normalize_code(code: Column) -> Column:
    """A language code as two letters (or one of the few longer ones): 'und' where that can't be told."""
    c = F.lower(F.trim(code))
    primary = F.regexp_extract(c, "^([^-_]*)", 1)
    three = F.coalesce(_look_up(fixed.THREE_LETTER, primary), F.lit("und"))
    told = F.when(primary.rlike(r"^\p{L}{2}$"), primary).when(primary.rlike(r"^\p{L}{3}$"), three).otherwise("und")
    return F.when(code.isNull() | (code == ""), "und").otherwise(F.coalesce(_look_up(REGIONAL, c), told))


def url_hint(url: Column) -> Column:
    """By the top-level domain, else the first host label: two letters, or a known regional code."""
    host = F.lower(urls.netloc(url))
    top = _look_up(fixed.TOP_LEVEL, F.regexp_extract(host, r"\.([^.]*)$", 1))
    label = F.regexp_extract(host, r"^([^.]*)\.", 1)
    return F.coalesce(top, F.when(label.rlike(r"^\p{L}{2}$"), normalize_code(label)), _look_up(REGIONAL, label))


def hints(html: Column, url: Column) -> Column:
    listed = F.transform(F.split(F.lower(first(html, meta("http-equiv", "content-language"))), "[,;]"), lambda c: F.trim(c))
    valid = F.filter(listed, lambda c: (c != "") & (c != "x-default") & (normalize_code(c) != "und"))
    codes = lambda p: F.filter(F.transform(every(html, p), lambda c: F.lower(c)), lambda c: c != "x-default")
    return F.struct(
        F.lower(first(html, HTML_LANG)).alias("html_lang"),
        F.lower(first(html, meta("property", "og:locale"))).alias("og_locale"),
        F.try_element_at(valid, F.lit(1)).alias("content_language"),
        F.lower(first(html, meta("name", "language"))).alias("meta_language"),
        codes(HREFLANG).alias("hreflang"),
        codes(ALTERNATE).alias("alternates"),
        url_hint(url).alias("url_hint"),
    )


def is_rtl(code: Column) -> Column:
    return code.isin(*fixed.RTL)


def script_hint(code: Column, original: Column) -> Column:
    return F.when(code == "zh", _look_up(fixed.CHINESE_SCRIPTS, F.lower(original)))


def blend(hint: Column, text: Column, content_lang: Column, content_confidence: Column, content_source: Column) -> Column:
    """struct(lang, confidence, source, is_rtl, script_hint): the content's language if it is sure enough, else the
    first hint's (by presence, so an unreadable one doesn't fall through), else English."""
    raw_hreflang = F.try_element_at(hint["hreflang"], F.lit(1))
    ladder = [
        (hint["html_lang"], 0.7, "html_lang"),
        (hint["og_locale"], 0.65, "og_locale"),
        (hint["content_language"], 0.6, "content_language"),
        (hint["meta_language"], 0.55, "meta_language"),
        (raw_hreflang, 0.5, "hreflang"),
    ]
    present = lambda c: c.isNotNull() & (c != "")
    lang, sure, source, raw = F.when(present(hint["url_hint"]), hint["url_hint"]).otherwise("und"), F.when(present(hint["url_hint"]), 0.4).otherwise(0.0), F.when(present(hint["url_hint"]), "url_hint").otherwise("none"), F.lit(None).cast("string")
    for value, confidence, name in reversed(ladder):
        has = present(value)
        lang = F.when(has, normalize_code(value)).otherwise(lang)
        sure = F.when(has, confidence).otherwise(sure)
        source = F.when(has, name).otherwise(source)
        raw = F.when(has, value).otherwise(raw)
    capped = F.when(F.length(text) < 200, F.least(content_confidence, F.lit(0.8))).otherwise(content_confidence)
    by_content = (content_lang != "und") & (capped > 0.6)
    by_hint = lang != "und"
    final = F.when(by_content, content_lang).when(by_hint, lang).otherwise("en")
    return F.struct(
        final.alias("lang"),
        F.when(by_content, capped).when(by_hint, sure).otherwise(0.5).alias("confidence"),
        F.when(by_content, F.concat(F.lit("content_"), content_source)).when(by_hint, source).otherwise("fallback_english").alias("source"),
        is_rtl(final).alias("is_rtl"),
        script_hint(lang, raw).alias("script_hint"),
    )


def _filled(text: str, **values: Column) -> Column:
    """A fixed sentence with its braces filled."""
    return F.concat(*(values[part[1:-1]] if part.startswith("{") else F.lit(part) for part in re.split(r"(\{\w+\})", text) if part))


def directive(code: Column, confidence: Column, script: Column) -> Column:
    name = F.coalesce(_look_up(fixed.LANGUAGE_NAMES, code), F.upper(code))
    given = {"name": name, "code": code, "script": script, "confidence": F.format_string("%.1f%%", confidence.cast("double") * 100)}
    opening, right_to_left, by_script, closing = (_filled(part, **given) for part in fixed.DIRECTIVE)
    text = F.concat(opening, F.when(is_rtl(code), right_to_left).otherwise(""), F.when(script.isNotNull() & (script != ""), by_script).otherwise(""), closing)
    return F.when((code == "und") | (confidence < 0.5), ENGLISH_DIRECTIVE).otherwise(text)


def prompt(markdown: Column, instruction: Column, target: str | None = None) -> Column:
    """What a generator is asked: a target language, if given, overrides the directive."""
    if target:
        instruction = F.lit(fixed.TARGET_DIRECTIVE.format(code=target.upper()))
    return F.concat(F.lit("Summarise the page as 5-10 questions and answers.\n"), instruction, F.lit("\nFormat: markdown, each question a bold heading, its answer a paragraph below.\nMarkdown content:\n\n"), markdown)


# --- content detection: character trigrams, add-one smoothed, counted in numpy over Arrow batches ---

#: Texts of a batch whose trigrams are held at once.
_SLICE_CHARS = 1 << 21


def _trigram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of all texts in turn, each as one integer in the order of its characters, and where each text begins."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(lengths - 2, 0)
    starts = np.concatenate(([0], np.cumsum(counts)))
    begins = np.cumsum(lengths) - lengths
    at = np.repeat(begins - starts[:-1], counts) + np.arange(starts[-1])
    return (codes[at] << 42) | (codes[at + 1] << 21) | codes[at + 2], starts


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _SLICE_CHARS together; a longer text is a range of its own."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > begin and held + size > _SLICE_CHARS:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def train_profiles(texts: DataFrame, lang_col: str, text_col: str, vocabulary: int = 20_000) -> DataFrame:
    """(gram, langs, logps) of the commonest grams, with all languages in one order; `vocabulary` bounds the rows.

    Whole texts are counted, batch by batch, so what is shuffled is a row per batch, language and gram. Rows without a
    language or text teach nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, held = batch.column("lang").to_pylist(), batch.column("t").to_pylist()
            for begin, end in _slices(held):
                for lang in sorted(set(langs[begin:end])):
                    keys, _ = _trigram_keys([t for t, of in zip(held[begin:end], langs[begin:end], strict=True) if of == lang])
                    grams, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    labelled = texts.select(F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col)).alias("t")).filter("lang is not null and t is not null")
    counted = labelled.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_gram = counted.groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("counts"))
    lengths = F.greatest(F.length("t") - 2, F.lit(0))
    totals = labelled.groupBy("lang").agg(F.sum(lengths).alias("total")).orderBy("lang").collect()  # a row per language
    commonest = by_gram.orderBy(F.desc("all"), "gram").limit(vocabulary)
    seen = lambda lang: F.coalesce(F.try_element_at("counts", F.lit(lang)), F.lit(0))
    logps = [F.log((seen(r.lang) + 1) / F.lit(float(r.total + vocabulary))) for r in totals]
    return commonest.select("gram", F.array(*(F.lit(r.lang) for r in totals)).cast("array<string>").alias("langs"), F.array(*logps).cast("array<double>").alias("logps"))


#: Common words of languages, the commonest first: what detection knows where no labelled texts are at hand.
COMMON_WORDS = {
    "cs": "a se v na je že to s z do o i jako za by po tak ale si jsem co už jen když který nebo aby pro jeho byl od",
    "da": "og i at det er en til på som for de med den af der har ikke et han jeg vi var men fra du om kan så skal eller",
    "de": "die der und in zu den das nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als an nach wie im für",
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí",
    "fi": "ja on ei se että oli hän mutta ovat kuin niin joka myös sen kun minä vain mitä nyt siitä jos sitten voi hänen olla mukaan kanssa tämä",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son",
    "hu": "a az és hogy nem is egy ez meg de volt el csak ha már még mint ki azt vagy kell lesz van minden aki majd után",
    "it": "di e il la che in un a per è una sono non con si da come le dei nel alla più anche i lo ma al del gli questo",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar bij uit nog worden door naar heeft ze hij",
    "no": "og i det er på som en til å han av for at med var de ikke den har jeg om et men så seg hun hadde fra vi du",
    "pl": "w i z na się do nie to że jest o jak a po co tak za od przez ale ma już tylko czy być był dla może te są",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à",
    "ro": "de și în a la cu pe nu că este din o care se un pentru mai sau dar ce am fost prin ca le lui după fi său această",
    "sv": "och i att det som en på är av för med den till inte ett de har om var jag men han från så vi kan när hade eller",
    "tr": "bir ve bu da de için ile çok ne daha gibi en o kadar ama sonra var olarak ben olan her mi ya değil diye onun kendi iki",
}


def common_word_counts(word_weight: int = 1000) -> dict[str, Counter]:
    """How often each trigram counts in each language, by COMMON_WORDS alone: a word of rank r counts word_weight / r times.

    Trigrams lie within a word and the blanks around it. Cyrillic, Greek, Arabic, Hebrew and Thai letters are told as one
    language each, by runs of their commonest letters. Chinese, Japanese and Korean aren't told.
    """
    letters = {"ru": "оеаинтсрвл", "el": "αοιετσνρκπ", "ar": "المنويتربه", "he": "יוהלאמתרשנ", "th": "านรอกเงมยล"}
    counts = {lang: Counter() for lang in sorted({*COMMON_WORDS, *letters})}
    for lang, words in COMMON_WORDS.items():
        for rank, word in enumerate(words.split(), 1):
            for at in range(len(word)):
                counts[lang][f" {word} "[at : at + 3]] += word_weight // rank
    for lang, own in letters.items():
        for a in own:
            for b in own:
                for gram in (f" {a}{b}", f"{a}{b} ", *(f"{a}{b}{c}" for c in own)):
                    counts[lang][gram] += 1
    return counts


def common_word_profiles(spark: SparkSession) -> DataFrame:
    """Profiles as train_profiles makes them, of common_word_counts."""
    counts = common_word_counts()
    grams = sorted({g for c in counts.values() for g in c})
    totals = {lang: sum(c.values()) + len(grams) for lang, c in counts.items()}
    rows = [((ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2]), [float(np.log((c[g] + 1) / totals[lang])) for lang, c in counts.items()]) for g in grams]
    langs = list(counts)
    return spark.createDataFrame([(k, langs, logps) for k, logps in rows], "gram long, langs array<string>, logps array<double>")


def detect(df: DataFrame, id_col: str, text: Column, profiles: DataFrame) -> DataFrame:
    """(id, content_lang, content_confidence, content_source) of each row, over its whole text; nothing is shuffled.

    Under 100 characters nothing is tried. Confidence is the softmax of log-likelihoods over the root of the count of
    known grams, ties going to the lesser name; a lead of under 0.15 costs a fifth of it. Without a known gram, detection
    has failed. Profiles are bounded by their vocabulary, so they are held by every task.
    """
    held = profiles.toArrow().sort_by("gram")
    langs = held.column("langs")[0].as_py() if held.num_rows else []
    grams = held.column("gram").to_numpy().astype(np.int64)
    logps = np.array(held.column("logps").to_pylist(), dtype=float).reshape(len(grams), len(langs))

    def told(texts: list[str | None]) -> Iterator[tuple[str | None, float, str]]:
        keys, starts = _trigram_keys([t or "" for t in texts])
        at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
        known = grams[at] == keys
        for k, one in enumerate(texts):
            found = at[starts[k] : starts[k + 1]][known[starts[k] : starts[k + 1]]]
            if one is None:
                yield None, 0.0, "insufficient_text"
            elif not len(found):
                yield None, 0.0, "detection_failed"
            else:
                scaled = logps[found].sum(axis=0) / np.sqrt(len(found))
                order = np.argsort(-scaled, kind="stable")  # languages stand in the order of their names
                weights = np.exp(scaled[order] - scaled[order[0]])
                lead, second = 1 / weights.sum(), (weights[1] if len(weights) > 1 else 0.0) / weights.sum()
                yield langs[order[0]], lead * 0.8 if lead - second < 0.15 else lead, "trigrams"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for begin, end in _slices(texts):
                some = texts[begin:end]
                rows = list(told(some)) if langs else [(None, 0.0, "insufficient_text" if t is None else "detection_failed") for t in some]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(begin, end - begin), *columns], names=[id_col, "lang", "content_confidence", "content_source"])

    enough = df.select(id_col, F.when(F.length(F.trim(text)) >= 100, F.lower(content.detection_text(text))).alias("t"))
    found = enough.mapInArrow(run, f"`{id_col}` {dict(enough.dtypes)[id_col]}, lang string, content_confidence double, content_source string")
    return found.select(id_col, F.when(F.col("lang").isNull(), "und").otherwise(normalize_code(F.col("lang"))).alias("content_lang"), "content_confidence", "content_source")
