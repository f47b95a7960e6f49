"""Benchmark decontamination by spaced seeds: masked token windows are hashed, joined and verified around the hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import bit_filter, durable, in_slices, passing, relieved, text_or_empty

#: 1: the token counts, 0: it is ignored. Three faults among 16 tokens, four among 20 or five among 25 leave one of these
#: masks whole, wherever they lie.
MASKS = ("1101100101", "1011010011", "1111111", "10110111")
#: An overlap needs so many equal tokens, or MIN_SHARE of a shorter item's, and this share of its span.
MIN_MATCHED, MIN_SHARE = 13, 0.8
#: Equal tokens that bear a fault at MIN_SHARE.
FAULT = round(MIN_SHARE / (1 - MIN_SHARE))
#: Items of fewer tokens than this count only as a whole document.
MIN_ITEM = 5
#: A benchmark of up to so many tokens is held by every task; of a larger one the seeds are shuffled and joined.
HELD_TOKENS = 1 << 20
#: Pairs of equal seeds that are listed at once; where there are more, an item's diagonals are all looked at.
PAIRS = 1 << 20

_TOKEN = r"[^\p{L}\p{N}]+"
#: Scripts that are written without spaces: each of their letters is a token.
_UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def hash_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens in one array, and where each text begins in it (one more entry than texts).

    Tokens are the stretches of letters and digits of the lowered text, so punctuation and spacing don't matter; letters of
    scripts without spaces are tokens of their own.
    """
    lowered = pc.utf8_lower(texts)
    if pc.any(pc.match_substring_regex(lowered, _UNSPACED)).as_py():
        lowered = pc.replace_substring_regex(lowered, _UNSPACED, r" \1 ")
    lists = pc.split_pattern_regex(lowered, pattern=_TOKEN)
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    table = np.array([xxhash.xxh64_intdigest(w) for w in words] or [0], dtype=np.uint64)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    hashes = table[codes] if len(codes) else np.empty(0, np.uint64)
    keep = hashes != np.uint64(xxhash.xxh64_intdigest(""))  # splitting leaves empty ends
    offsets = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
    return hashes[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def _mixers(count: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"place {i}") | 1 for i in range(count)], dtype=np.uint64)


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the masked window that begins at each token, as far as windows fit."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for at, mixer in zip([i for i, m in enumerate(mask) if m == "1"], _mixers(len(mask)), strict=False):
        total += (tokens[at : at + n] ^ (tokens[at : at + n] >> np.uint64(29))) * mixer
    return total ^ (total >> np.uint64(32))


def needed(length: int) -> int:
    """How many tokens of an item of this length have to be equal."""
    return min(MIN_MATCHED, -(-FAULT * length // (FAULT + 1)))


def piece_places(length: int) -> tuple[int, list[int]]:
    """Width and places of the pieces of an item that needs fewer tokens; no pieces for any other.

    It is cut in one piece more than it may have faults, so one piece is whole.
    """
    if length < MIN_ITEM or needed(length) >= MIN_MATCHED:
        return 0, []
    count = length - needed(length) + 1
    return length // count, [i * length // count for i in range(count)]


def whole_seed(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes())


#: Every kind of seed by its number: the masks, the pieces by their width (all lie below the widest mask), whole texts.
KINDS = (*MASKS, *("1" * w for w in range(1, MIN_MATCHED)))
WHOLE = len(KINDS)
PIECE_KINDS = sorted({len(MASKS) - 1 + piece_places(n)[0] for n in range(MIN_ITEM, 4 * MIN_MATCHED) if piece_places(n)[0]})
DOC_KINDS = [*range(len(MASKS)), *PIECE_KINDS]


class Block:
    """A benchmark of bounded size: its tokens, and for each kind of seed the sorted hashes with their places."""

    def __init__(self, rows: list[tuple[str, np.ndarray]]):
        self.items = [r[0] for r in rows]
        self.starts = np.concatenate(([0], np.cumsum([len(r[1]) for r in rows]))).astype(np.int64)
        self.tokens = np.concatenate([r[1] for r in rows]) if rows else np.empty(0, np.uint64)
        self.lengths = np.diff(self.starts)
        self.index = []
        for kind in range(len(MASKS)):
            found = seed_hashes(self.tokens, MASKS[kind])
            starts = np.arange(len(found))
            row = np.searchsorted(self.starts, starts, side="right") - 1
            inside = starts + len(MASKS[kind]) <= self.starts[row + 1] if len(found) else np.empty(0, bool)
            self._add(kind, found[inside], starts[inside])
        pieces: dict[int, list[int]] = {}
        for start, n in zip(self.starts.tolist(), self.lengths.tolist(), strict=False):
            width, places = piece_places(n)
            if width:
                pieces.setdefault(len(MASKS) - 1 + width, []).extend(start + p for p in places)
        for kind, places in sorted(pieces.items()):
            self._add(kind, seed_hashes(self.tokens, KINDS[kind])[places], np.array(places))
        self.short: dict[bytes, list[int]] = {}
        for row in np.flatnonzero((self.lengths > 0) & (self.lengths < MIN_ITEM)).tolist():
            self.short.setdefault(self.item(row).tobytes(), []).append(row)

    def item(self, row: int) -> np.ndarray:
        return self.tokens[self.starts[row] : self.starts[row + 1]]

    def _add(self, kind: int, keys: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.index.append((kind, keys[order], places[order]))

    def _diagonals(self, n: int, hashes: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Each item that shares a seed with a text of n tokens, and the ascending diagonals to look at.

        A diagonal is where the item's first token would stand in the text. Where equal seeds make more pairs than an
        item has diagonals (repeated words in both), all of them are given instead, so the work stays bounded.
        """
        keys, every = [], set()
        for (_, index, places), own in zip(self.index, hashes, strict=True):
            low, high = np.searchsorted(index, own, side="left"), np.searchsorted(index, own, side="right")
            at = np.flatnonzero(high > low)
            counts = (high - low)[at]
            if counts.sum() > PAIRS:
                begins, first, times = np.unique(low[at], return_index=True, return_counts=True)
                pairs, rows = np.zeros(len(self.items), np.int64), self._row(places)
                for begin, end, k in zip(begins.tolist(), high[at][first].tolist(), times.tolist(), strict=True):
                    pairs += k * np.bincount(rows[begin:end], minlength=len(self.items))
                many = pairs > n + self.lengths
                every.update(np.flatnonzero(many).tolist())
                index, places = index[~many[rows]], places[~many[rows]]
                low, high = np.searchsorted(index, own, side="left"), np.searchsorted(index, own, side="right")
                at = np.flatnonzero(high > low)
                counts = (high - low)[at]
            for part in np.array_split(np.arange(len(at)), max(1, -(-int(counts.sum()) // PAIRS))):
                size = counts[part]
                place = places[np.repeat(low[at[part]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                row, shift = self._row(place), np.repeat(at[part], size) - place
                keys.append(np.unique(np.stack((row, shift + self.starts[row])), axis=1))
        found = np.unique(np.concatenate(keys, axis=1), axis=1) if keys else np.empty((2, 0), np.int64)
        for row in np.union1d(found[0], sorted(every)).astype(np.int64).tolist():
            yield row, np.arange(1 - self.lengths[row], n) if row in every else found[1][found[0] == row]

    def _row(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def search(self, doc: np.ndarray, hashes: list[np.ndarray]) -> list[tuple]:
        """Overlaps of one document: (item, equal tokens, first token, tokens, share of the item); one for each item."""
        best: dict[str, tuple] = {}
        rows = [(row, best_overlap(doc, self.item(row), shifts)) for row, shifts in self._diagonals(len(doc), hashes)]
        if len(doc) < MIN_ITEM:
            rows += [(row, (len(doc), 0, len(doc))) for row in self.short.get(doc.tobytes(), ())]
        for row, found in rows:
            if found:
                matched, at, length = found
                entry = (matched, -at, -length, matched / int(self.lengths[row]))
                best[self.items[row]] = max(best.get(self.items[row], entry), entry)
        return [(item, matched, -at, -length, share) for item, (matched, at, length, share) in sorted(best.items())]


def best_overlap(doc: np.ndarray, item: np.ndarray, shifts: np.ndarray, cells: int = 1 << 20) -> tuple[int, int, int] | None:
    """Equal tokens, first token and length of the best span on any of the diagonals, or None if too few are equal.

    Most equal tokens come first, then the earliest, then the shortest. A diagonal can't have more equal tokens on a span
    than on the whole, so only those are aligned that may still be better than what has been found.
    """
    n, m = len(doc), len(item)
    absent = np.setdiff1d(np.arange(m + 1, dtype=np.uint64), item)[:1].repeat(m)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((absent, doc, absent)), m)
    totals = np.empty(len(shifts), np.int64)
    step = max(1, cells // max(1, m))
    for a in range(0, len(shifts), step):
        some = shifts[a : a + step] + m
        some = slice(some[0], some[-1] + 1) if some[-1] - some[0] == len(some) - 1 else some
        totals[a : a + step] = (windows[some] == item).sum(axis=1)
    best, least = None, needed(m)
    for k in np.lexsort((shifts, -totals)).tolist():
        shift = int(shifts[k])
        if totals[k] < (best[0] if best else least):
            break
        begin, end = max(0, shift), min(n, shift + m)
        if best and totals[k] == best[0] and begin > best[1]:
            break  # later diagonals with as many equal tokens begin later still
        a, b, matched = best_span(doc[begin:end] == item[begin - shift : end - shift])
        if matched >= least and (best is None or (-matched, begin + a, b - a) < (-best[0], best[1], best[2])):
            best = (matched, begin + a, b - a)
    return best


def best_span(equal: np.ndarray) -> tuple[int, int, int]:
    """Begin, end and equal tokens of the span of a diagonal that has the most of them at MIN_SHARE or more.

    Of several the shortest, then the first. With 1 for an equal token and -FAULT for another, those are the spans whose
    sum isn't negative; for each begin the farthest such end is found in the running maximum from the right.
    """
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0, 0
    sums = np.concatenate(([0], np.cumsum(np.where(equal, 1, -FAULT))))
    ahead = np.maximum.accumulate(sums[at + 1][::-1])[::-1]
    last = np.searchsorted(-ahead, -sums[at], side="right") - 1
    matched = last - np.arange(len(at)) + 1
    k = np.lexsort((at, at[last] - at, -matched))[0]
    return int(at[k]), int(at[last[k]]) + 1, int(matched[k])


def _item_rows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id and token hashes of each item that has any token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in in_slices(batch, "text"):
                tokens, starts = hash_tokens(cut.column("text"))
                kept = np.flatnonzero(np.diff(starts))
                parts = pa.array([tokens[starts[k] : starts[k + 1]].view(np.int64) for k in kept], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([cut.column("item_id").take(pa.array(kept)), parts], names=["item_id", "tokens"])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "item_id string, tokens array<bigint>").distinct()


LEAKS = "doc_id long, item_id string, matched int, at_token int, span int, share double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", held_tokens: int = HELD_TOKENS) -> DataFrame:
    """A row per document and benchmark item that overlap: doc_id, item_id, matched, at_token, span, share.

    An overlap lies on one diagonal, has at least MIN_MATCHED equal tokens (or MIN_SHARE of a shorter item's) and at least
    MIN_SHARE equal ones of its span; substituted tokens inside it are borne. The span with most equal ones is reported,
    of several the first. Items of any length are whole, whatever the benchmark's size. A benchmark of at most
    held_tokens is held by every task, and the documents stream past it without a shuffle; else seeds are joined
    (see seed_leaks), with the same rows.
    Null texts are empty and overlap nothing; null doc_ids stay null, a null item_id is ''; repeated rows of docs each give
    their own, repeated items one; empty tables give no rows; other columns are ignored. Items under MIN_ITEM tokens count
    only where they are the whole document.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    items = _item_rows(benchmark, item_col, item_text_col)
    if (block := _held(items, held_tokens)) is not None:
        return texts.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(block)), LEAKS)
    found = seed_leaks(texts.select("text"), items)
    return texts.select("doc_id", *_key(F.col("text"))).join(found, ["k1", "k2"]).select(*(x.split()[0] for x in LEAKS.split(", ")))


def _held(items: DataFrame, held_tokens: int) -> Block | None:
    """The benchmark as one block, or None if it has more tokens; they are counted before any are fetched."""
    total = items.agg(F.sum(F.size("tokens"))).first()[0] or 0
    if total > held_tokens:
        return None
    rows = sorted((r.item_id, list(r.tokens)) for r in items.collect())
    return Block([(item, np.array(tokens, np.int64).view(np.uint64)) for item, tokens in rows])


def _leaking(block: Block, texts: pa.Array) -> Iterator[tuple[int, list[tuple]]]:
    """(row, overlaps) for each text that has any."""
    tokens, starts = hash_tokens(texts)
    marked = np.diff(starts) < MIN_ITEM
    every = []
    for kind, keys, _ in block.index:
        own = seed_hashes(tokens, KINDS[kind])
        every.append(own)
        if len(keys) and len(own):
            hit = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own)
            marked[np.searchsorted(starts, hit, side="right") - 1] = True
    for k in np.flatnonzero(marked):
        a, b = starts[k], starts[k + 1]
        hashes = [h[a : max(a, b - len(KINDS[kind]) + 1)] for h, (kind, _, _) in zip(every, block.index, strict=True)]
        if found := block.search(tokens[a:b], hashes):
            yield int(k), found


def _searcher(held):
    names = [x.split()[0] for x in LEAKS.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in in_slices(batch, "text", max_bytes=4 << 20):
                ids = cut.column("doc_id").to_pylist()
                out = [(ids[k], *overlap) for k, found in _leaking(held.value, cut.column("text")) for overlap in found]
                columns = [list(c) for c in zip(*out, strict=True)] or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return relieved(run)


def _keeper(held, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in in_slices(batch, text_col, max_bytes=4 << 20):
                keep = np.ones(cut.num_rows, bool)
                keep[[k for k, _ in _leaking(held.value, pc.fill_null(cut.column(text_col).cast(pa.string()), ""))]] = False
                yield cut.filter(pa.array(keep))

    return relieved(run)


# --- a benchmark that is too large to be held ---


def _key(text: Column) -> tuple[Column, Column]:
    """Two hashes that stand for a text together."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")


def _seeds_of(tokens: np.ndarray, item: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, seeds, places) of one text: all windows of a document, or those by which an item is found."""
    if 0 < len(tokens) < MIN_ITEM:
        yield WHOLE, np.array([whole_seed(tokens)], np.uint64), np.zeros(1, np.int64)
        if item:
            return
    width, places = piece_places(len(tokens)) if item else (0, [])
    for kind in range(len(MASKS)) if item else DOC_KINDS:
        seeds = seed_hashes(tokens, KINDS[kind])
        yield kind, seeds, np.arange(len(seeds))
    if width:
        yield len(MASKS) - 1 + width, seed_hashes(tokens, "1" * width)[places], np.array(places)


SEED_KINDS = {"kind": pa.int32(), "seed": pa.int64(), "place": pa.int64()}


def _document_seeds(texts: DataFrame, held) -> DataFrame:
    """k1, k2, kind, seed, place for each seed of each text that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", *SEED_KINDS]
        for batch in batches:
            for cut in in_slices(batch, "text", max_bytes=1 << 20):
                tokens, starts = hash_tokens(cut.column("text"))
                rows: list[np.ndarray] = [np.empty((4, 0), np.int64)]
                for k in range(cut.num_rows):
                    for kind, seeds, places in _seeds_of(tokens[starts[k] : starts[k + 1]], item=False):
                        through = passing(held.value, seeds)
                        rows.append(np.stack((np.full(len(through), k), np.full(len(through), kind), seeds[through].view(np.int64), places[through])))
                own, kind, seed, place = np.concatenate(rows, axis=1)
                keys = [cut.column(c).take(pa.array(own)) for c in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(kind.astype(np.int32)), pa.array(seed), pa.array(place)], names=names)

    return texts.mapInArrow(run, "k1 long, k2 long, kind int, seed long, place long")


def _benchmark_seeds(items: DataFrame) -> DataFrame:
    """item, item_tokens, kind, seed, place for each seed of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, tokens in zip(batch.column("item").to_pylist(), batch.column("tokens"), strict=True):
                own = np.asarray(tokens.values).view(np.uint64)
                for kind, seeds, places in _seeds_of(own, item=True):
                    n = len(seeds)
                    columns = [np.full(n, item), np.full(n, len(own)), np.full(n, kind, np.int32), seeds.view(np.int64), places]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "item_tokens", *SEED_KINDS])

    return items.select("item", "tokens").mapInArrow(run, "item long, item_tokens long, kind int, seed long, place long")


def seed_leaks(texts: DataFrame, items: DataFrame) -> DataFrame:
    """k1, k2, item_id, matched, at_token, span, share for each distinct text and item that overlap, by a join of seeds.

    Equal texts are one first. Seeds that the benchmark lacks are dropped by a filter of bounded size before the shuffle;
    equal seeds give the diagonals of a text and an item, each once; only the stretch of the text that a diagonal
    touches goes to the item and is aligned there. Nothing of either side is held whole.
    """
    spark = texts.sparkSession
    numbered = durable(items.groupBy("tokens").agg(F.collect_set("item_id").alias("names")).withColumn("item", F.xxhash64("tokens", F.size("tokens"))))
    item_seeds = durable(_benchmark_seeds(numbered))
    distinct = durable(texts.select(*_key(F.col("text")), "text").dropDuplicates(["k1", "k2"]))
    doc_seeds = _document_seeds(distinct, spark.sparkContext.broadcast(bit_filter(item_seeds, "seed")))
    met = doc_seeds.withColumnRenamed("place", "at").join(item_seeds, ["kind", "seed"])
    diagonals = met.select("k1", "k2", "item", "item_tokens", (F.col("at") - F.col("place")).alias("shift")).distinct()
    asked = diagonals.groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "item_tokens", "shift")).alias("asked"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "item", "shift", "begin", "doc_tokens", "part"]
        for batch in batches:
            for cut in in_slices(batch, "text", max_bytes=1 << 20):
                tokens, starts = hash_tokens(cut.column("text"))
                for k, (k1, k2, own) in enumerate(zip(cut.column("k1").to_pylist(), cut.column("k2").to_pylist(), cut.column("asked").to_pylist(), strict=True)):
                    doc = tokens[starts[k] : starts[k + 1]].view(np.int64)
                    for at in range(0, len(own), 256):
                        some = own[at : at + 256]
                        begins = [max(0, x["shift"]) for x in some]
                        parts = [doc[b : max(0, x["shift"] + x["item_tokens"])] for b, x in zip(begins, some, strict=True)]
                        columns = [[k1] * len(some), [k2] * len(some), [x["item"] for x in some], [x["shift"] for x in some], begins, [len(doc)] * len(some)]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(parts, pa.list_(pa.int64()))], names=names)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "item", "matched", "at_token", "span", "share"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("k1", "k2", "item", "shift", "begin", "doc_tokens")]
            for k1, k2, item, shift, begin, n, part, tokens in zip(*columns, batch.column("part"), batch.column("tokens"), strict=True):
                piece, whole = np.asarray(part.values), np.asarray(tokens.values)
                if len(whole) < MIN_ITEM:
                    if n == len(whole) and (piece == whole).all():
                        out.append((k1, k2, item, n, 0, n, 1.0))
                    continue
                a, b, matched = best_span(piece == whole[begin - shift : begin - shift + len(piece)])
                if matched >= needed(len(whole)):
                    out.append((k1, k2, item, matched, begin + a, b - a, matched / len(whole)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([list(x) for x in zip(*out, strict=True)] or [[]] * 7, kinds, strict=True)], names=names)

    parts = distinct.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "asked")
    parts = parts.mapInArrow(cut_out, "k1 long, k2 long, item long, shift long, begin long, doc_tokens long, part array<bigint>")
    aligned = parts.join(numbered.select("item", "tokens"), "item").mapInArrow(align, "k1 long, k2 long, item long, matched int, at_token int, span int, share double")
    named = aligned.join(numbered.select("item", F.explode("names").alias("item_id")), "item")
    order = F.struct("matched", -F.col("at_token"), -F.col("span"))
    return named.groupBy("k1", "k2", "item_id").agg(*(F.max_by(c, order).alias(c) for c in ("matched", "at_token", "span", "share")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", held_tokens: int = HELD_TOKENS) -> DataFrame:
    """docs without the rows whose text overlaps with a benchmark item, as find_leaks defines it.

    Rows are dropped where they are read, without a shuffle; only for a benchmark of over held_tokens the seeds are
    joined. All columns stay, whatever their names; null and empty texts and null ids stay, repeated rows stay or go
    together; an empty benchmark drops nothing, an empty table gives no rows.
    """
    items = _item_rows(benchmark, item_col, "text")
    if (block := _held(items, held_tokens)) is not None:
        return docs.mapInArrow(_keeper(docs.sparkSession.sparkContext.broadcast(block), text_col), docs.schema)
    leaks = seed_leaks(docs.select(text_or_empty(text_col).alias("text")), items).select(F.col("k1").alias("__leak_1"), F.col("k2").alias("__leak_2")).distinct()
    k1, k2 = _key(text_or_empty(text_col))
    return docs.join(leaks, (k1 == F.col("__leak_1")) & (k2 == F.col("__leak_2")), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
