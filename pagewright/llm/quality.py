"""Quality classifier: statistics of whole texts, scored by histogram gradient-boosted trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import boosting
from pagewright.llm.common import in_slices, relieved, text_or_empty

#: Labelled rows that the trees are fitted on: those of the least hashes of their ids.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
#: Texts whose features are counted together: enough for numpy, and little memory for the workers that go on to other stages.
SLICE_BYTES = 1 << 19

FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper_share", "digit_share", "mark_share", "space_share", "wide_share",
    "odd_mark_share", "pipe_share", "bang_share", "distinct_words", "top_word", "repeat_next", "distinct_pairs", "end_marks",
    "marked_words", "upper_words", "lines", "distinct_lines", "line_words", "longest_run", "bad_line", "bad_lines",
)

#: Classes of bytes: other, capital, digit, mark, white space, odd mark, and (7) parts of wider characters.
_KINDS = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _KINDS[_c] = 7 if _c >= 128 else 1 if "A" <= _ch <= "Z" else 2 if "0" <= _ch <= "9" else 3 if _ch in ".,;:'\"-()?" else 4 if _c in (9, 10, 11, 12, 13, 32) else 5 if _c > 32 and not _ch.isalnum() else 0
_BYTE = np.arange(256)
_IS_SPACE, _IS_UPPER, _IS_LOWER = _KINDS == 4, _KINDS == 1, (_BYTE >= ord("a")) & (_BYTE <= ord("z"))
_IS_JUNK_END = np.isin(_BYTE, list(b"!#$%&*|"))
_SINGLE = {"pipe_share": ord("|"), "bang_share": ord("!")}
#: Lines of fewer words than this are never bad.
_LINE_WORDS = 4


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds; empty stretches give zero."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _counts(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many flags are set from each of the ascending begins up to the next; no array of the flags' length is made."""
    return np.add.reduceat(flags, begins, dtype=np.int64) if len(begins) else np.empty(0, np.int64)


def _most(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The largest of values (none negative) between neighbouring bounds; empty stretches give zero."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        out[some] = np.maximum.reduceat(values, bounds[:-1][some])
    return out


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each group has, and how often its commonest occurs. Values aren't negative, or any hashes."""
    least = int(value.max(initial=0)) + 1 if value.dtype == np.int64 else 2**64
    if least * max(1, groups) < 2**63:  # one number for both sorts faster
        both = np.sort(group * least + value)
        g, v = both // least, both
    else:
        order = np.lexsort((value, group))
        g, v = group[order], value[order]
    starts = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])))) if len(g) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(g)))
    owners = g[starts]
    return np.bincount(owners, minlength=groups), _most(sizes, np.searchsorted(owners, np.arange(groups + 1)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def statistics(texts: pa.Array) -> np.ndarray:
    """The FEATURES of whole texts, a row each; null and empty ones have zeros.

    All texts' bytes lie in one array: words and lines are stretches of it, words are numbers of a dictionary, and every
    feature is a sum, a maximum or a count of different values over the stretches of a text.
    """
    n_texts = len(texts)
    raw = pc.fill_null(texts.cast(pa.binary()), b"")
    chars = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    ends = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(raw), dtype=np.int64))))
    size = np.diff(ends)
    # words and lines; a line ends at its feed or with its text
    space = _IS_SPACE[chars]
    before = np.concatenate(([True], space[:-1])) if len(chars) else space
    before[ends[:-1][size > 0]] = True
    begins = np.flatnonzero(~space & before)
    after = np.concatenate((space[1:], [True])) if len(chars) else space
    after[ends[1:][size > 0] - 1] = True
    stops = np.flatnonzero(~space & after) + 1
    text_words = np.searchsorted(begins, ends)
    feeds = np.flatnonzero(chars == 10)
    lines = np.diff(np.searchsorted(feeds, ends)) + (size > 0)
    line_bounds = np.unique(np.append(feeds + 1, ends))  # an empty last line has no stretch of its own
    word_bounds = np.searchsorted(begins, line_bounds)
    words = np.diff(text_words)
    flat = _words(raw).dictionary_encode()
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(n_texts), words)
    # flags of words
    shout = (_counts(_IS_UPPER[chars], begins) > 0) & (_counts(_IS_LOWER[chars], begins) == 0) & (stops - begins > 1)
    marked = _IS_JUNK_END[chars[stops - 1]]
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
    in_line = again.copy()
    in_line[word_bounds[:-1][word_bounds[:-1] < len(code)]] = False
    # lines: how bad, and which are different
    per_line = np.diff(word_bounds)
    worst = np.maximum(np.maximum(_sums(shout, word_bounds), _sums(marked, word_bounds)), _sums(in_line, word_bounds))
    bad = np.where(per_line >= _LINE_WORDS, worst / np.maximum(1, per_line), 0.0)
    text_lines = np.searchsorted(line_bounds, ends)
    place = (np.arange(len(code)) - np.repeat(word_bounds[:-1], per_line)).astype(np.uint64)
    mixed = _mixed(code.astype(np.uint64) + np.uint64(1) + _mixed(place + np.uint64(1)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    line_hash = (total[word_bounds[1:]] - total[word_bounds[:-1]]) ^ _mixed(per_line.astype(np.uint64))
    line_owner = np.repeat(np.arange(n_texts), np.diff(text_lines))
    blank_end = (size > 0) & (lines > np.diff(text_lines))
    line_hash = np.concatenate((line_hash, np.full(int(blank_end.sum()), _mixed(np.zeros(1, np.uint64))[0])))
    line_owner = np.concatenate((line_owner, np.flatnonzero(blank_end)))
    different_lines, _ = _distinct(line_owner, line_hash, n_texts)
    different, commonest = _distinct(owner, code, n_texts)
    follows = np.flatnonzero(owner[1:] == owner[:-1])
    pairs, _ = _distinct(owner[follows], code[follows] * len(flat.dictionary) + code[follows + 1], n_texts)
    # the longest run of one word
    change = np.flatnonzero(~again)
    run = np.diff(np.append(change, len(code)))
    longest = _most(run, np.searchsorted(owner[change], np.arange(n_texts + 1)))
    m, n = np.maximum(1, words), np.maximum(1, size)
    by = np.array([np.bincount(chars[a:b], minlength=256) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.int64).reshape(n_texts, 256)
    of_kind = lambda k: by[:, _KINDS == k].sum(axis=1) / n
    of_byte = lambda c: by[:, c]
    out = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(words), "mean_word": (size - of_byte(32)) / m,
        "upper_share": of_kind(1), "digit_share": of_kind(2), "mark_share": of_kind(3), "space_share": of_kind(4),
        "wide_share": of_kind(7), "odd_mark_share": of_kind(5),
        **{name: of_byte(c) / n for name, c in _SINGLE.items()},
        "distinct_words": different / m, "top_word": commonest / m, "repeat_next": _sums(again, text_words) / m,
        "distinct_pairs": pairs / m, "end_marks": of_byte(ord(".")) / m, "marked_words": _sums(marked, text_words) / m,
        "upper_words": _sums(shout, text_words) / m, "lines": np.log1p(lines), "distinct_lines": different_lines / np.maximum(1, lines),
        "line_words": words / np.maximum(1, lines), "longest_run": np.log1p(np.maximum(1, longest)),
        "bad_line": _most(bad, text_lines), "bad_lines": _sums(np.where(bad >= 0.5, per_line, 0), text_lines) / m,
    }
    return np.where(size[:, None] > 0, np.column_stack([out[name] for name in FEATURES]).astype(np.float64), 0.0)


def _words(raw: pa.Array) -> pa.Array:
    """All texts' words in turn: what lies between ASCII white space."""
    found = pc.ascii_split_whitespace(raw.cast(pa.string())).flatten()
    return found.filter(pc.greater(pc.binary_length(found), 0))


def with_statistics(rows: DataFrame, keep: str) -> DataFrame:
    """The column `keep` and the features of each row's text."""
    kind = dict(rows.dtypes)[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in in_slices(batch, "text", max_bytes=SLICE_BYTES):
                found = pa.array(list(statistics(cut.column("text"))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([cut.column(keep), found], names=[keep, "features"])

    return rows.select(keep, "text").mapInArrow(relieved(run), f"{keep} {kind}, features array<double>")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents that aren't held out, chosen by a hash of the id.

    Null ids and labels teach nothing. An id with several labels has the label of the greater part of them, one with
    several texts has the least of them, so there are at most `rows` rows and they are always the same. The sample is cut
    before texts are read; it has a bounded size, so it is broadcast to the documents.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna()
    known = known.filter(id_remainder(F.col("doc_id"), modulus) != held_out).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> boosting.Forest:
    sample = with_statistics(labelled_sample(docs, labels, label, modulus, held_out, rows), "label")
    found = sample.toArrow()
    order = np.lexsort(np.array(found.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES)).T) if found.num_rows else np.empty(0, int)
    features = np.array(found.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES))[order]
    return boosting.fit(features, np.array(found.column("label").to_pylist(), dtype=float)[order])


def score(docs: DataFrame, forest: boosting.Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of each row, over its whole text.

    Null text is empty, and empty texts are scored like others; null ids stay null, repeated rows are scored each, an
    empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in in_slices(batch, "text", max_bytes=SLICE_BYTES):
                found = forest.predict(statistics(cut.column("text")))
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(relieved(run), "doc_id long, score double")


def keep_good(docs: DataFrame, forest: boosting.Forest, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold; nothing is shuffled.

    Null text counts as empty; all columns stay, whatever their names; repeated rows stay or go together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in in_slices(batch, text_col, max_bytes=SLICE_BYTES):
                yield cut.filter(pa.array(forest.predict(statistics(cut.column(text_col))) >= threshold))

    return docs.mapInArrow(relieved(run), docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows are scored each; a null doc_id isn't held out; empty tables give no rows, or the prior's score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, forest).select(
        "doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
