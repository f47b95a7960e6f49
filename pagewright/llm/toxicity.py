"""Toxicity by a weighted finite-state grammar: a lexical transducer, composed rewriting transducers, scored clauses."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import durable, in_slices, text_or_empty
from pagewright.llm.quality import id_remainder, labelled_sample

#: Labelled rows that lexicon and weights are learned on, and candidate terms that are looked at.
SAMPLE_ROWS, CANDIDATES = 20_000, 20_000
#: A term must stand after so many different words in toxic texts, and a stem go on in so many ways.
LEAST_CONTEXTS, LEAST_SUFFIXES = 4, 4
#: The words before it must be this share of its texts, or so many: in a group of copies they are the same again and again.
FRESH_SHARE, MANY_CONTEXTS = 0.5, 40
STEM_LENGTHS = range(4, 9)
#: A term's texts must be toxic by this factor more often than others.
LEAST_RATIO = 4.0
#: Chance, over all candidates, of a term that stands in toxic texts so often by luck.
LUCK = 0.05
#: What a threat's verb weighs before labels speak, where no insult has been learned, and the texts that this counts as.
PRIOR_WEIGHT, PRIOR_TEXTS = 4.0, 10

# Classes that the lexical transducer gives to words.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END, INTENT = range(8)
# The closed word classes of the four languages.
TARGETS = "you your yours yourself u ur he she they him her them tu te toi vous ton ta votre du dich dir ihr euch dein ihre usted ustedes tú tus vosotros"
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't won't ne pas jamais aucun nicht kein keine nie niemals ni nunca jamás"
REPORTS = "said says say wrote writes claimed quoted called quote dit disait écrit sagte sagt schrieb dijo dice escribió"
THREATS = "kill murder hurt destroy stab shoot beat strangle tuer frapper töten schlagen matar golpear"
INTENTS = "will i'll we'll they'll gonna going shall must should want vais va allons veux werde werden wird voy vamos quiero"


class Transducer:
    """A sequential transducer over small alphabets: move[state][symbol] = (next state, output symbol)."""

    def __init__(self, move: list[list[tuple[int, int]]]):
        self.move = move

    @classmethod
    def rewriting(cls, states: int, symbols: int, rule) -> Transducer:
        return cls([[rule(state, symbol) for symbol in range(symbols)] for state in range(states)])

    def then(self, other: Transducer) -> Transducer:
        """The composition: what self writes, other reads."""
        m = len(other.move)
        move = []
        for p in range(len(self.move)):
            for q in range(m):
                row = []
                for symbol in range(len(self.move[0])):
                    np_, out = self.move[p][symbol]
                    nq, final = other.move[q][out]
                    row.append((np_ * m + nq, final))
                move.append(row)
        return Transducer(move)


#: Marks that the grammar's parts put on a matched word, as bits above the class.
NEGATED, REPORTED, AIMED, INTENDED = 8, 16, 32, 64
_SYMBOLS = 128
#: How many words a negation reaches; report, target and intent reach through their clause.
_WINDOW = 3


def _negation(state: int, symbol: int) -> tuple[int, int]:
    kind = symbol & 7
    if kind in (END, NEGATION):
        return _WINDOW * (kind == NEGATION), symbol
    return max(0, state - 1), symbol | NEGATED if state and kind in (INSULT, THREAT) else symbol


def _mark_after(wanted: int, mark: int):
    """The rule that marks the matches of a clause that stand after a word of a class, in reading order."""

    def rule(state: int, symbol: int) -> tuple[int, int]:
        kind = symbol & 7
        if kind == END:
            return 0, symbol
        return int(state or kind == wanted), symbol | mark if state and kind in (INSULT, THREAT) else symbol

    return Transducer.rewriting(2, _SYMBOLS, rule)


#: From left to right: negation, then intent, then what stands before a match as report or target.
FORWARD = (
    Transducer.rewriting(_WINDOW + 1, _SYMBOLS, _negation).then(_mark_after(INTENT, INTENDED)).then(_mark_after(REPORT, REPORTED)).then(_mark_after(TARGET, AIMED))
)
#: From right to left over what FORWARD wrote: report and target may follow as well.
BACKWARD = _mark_after(REPORT, REPORTED).then(_mark_after(TARGET, AIMED))

#: Weight of each path: negated and reported ones hardly count, whatever else they are; a threat needs intent or a target.
PATHS = {"negated": 0.1, "reported": 0.1, "plain": 1.0, "aimed": 1.5, "threat": 0.1, "half_threat": 0.3, "aimed_threat": 2.0}


def path_of(symbol: int) -> str:
    """The path of PATHS by which a marked match was reached."""
    if symbol & NEGATED:
        return "negated"
    if symbol & REPORTED:
        return "reported"
    if symbol & 7 == INSULT:
        return "aimed" if symbol & AIMED else "plain"
    return ("threat", "half_threat", "aimed_threat")[bool(symbol & AIMED) + bool(symbol & INTENDED)]


_WEIGHT_OF = [PATHS[path_of(symbol)] if symbol & 7 in (INSULT, THREAT) else 0.0 for symbol in range(_SYMBOLS)]
_CLOSED = {w: k for k, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INTENT, INTENTS)) for w in words.split()}
_PIECES = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;\n]")
_WORD_SPLIT = r"[^\p{L}\p{N}'’]+"


@dataclass
class Lexicon:
    """The lexical transducer: whole words, stems (paths after which any letters follow) and threats' verbs, with weights.

    The longest path that a word ends on, or passes, gives its weight.
    """

    words: dict[str, float]
    stems: dict[str, float]
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS.split(), PRIOR_WEIGHT))

    def __post_init__(self):
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)

    def weight(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        return next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems and len(word) >= n), 0.0)

    def read(self, word: str) -> tuple[int, float]:
        if w := self.weight(word):
            return INSULT, w
        kind = _CLOSED.get(word, OTHER)
        return kind, self.threats[word] if kind == THREAT else 0.0


def marked_clause(symbols: list[int]) -> list[int]:
    """The symbols of one clause after both transducers."""
    state, out = 0, []
    for symbol in symbols:
        state, written = FORWARD.move[state][symbol]
        out.append(written)
    state = 0
    for i in range(len(out) - 1, -1, -1):
        state, out[i] = BACKWARD.move[state][out[i]]
    return out


def clauses(text: str, lexicon: Lexicon) -> Iterator[tuple[list[int], list[float]]]:
    """Symbols and weights of the words of each clause that holds a match."""
    symbols: list[int] = []
    weights: list[float] = []
    hit = False
    for m in _PIECES.finditer(text.lower()):
        piece = m.group().replace("’", "'")
        if piece in ".!?;\n":
            if hit:
                yield symbols, weights
            symbols, weights, hit = [], [], False
            continue
        kind, weight = lexicon.read(piece)
        symbols.append(kind)
        weights.append(weight)
        hit |= weight > 0
    if hit:
        yield symbols, weights


def path_sums(text: str, lexicon: Lexicon) -> dict[str, float]:
    """The weights of a text's matches, summed by path."""
    sums = dict.fromkeys(PATHS, 0.0)
    for symbols, weights in clauses(text, lexicon):
        for symbol, weight in zip(marked_clause(symbols), weights, strict=True):
            if weight:
                sums[path_of(symbol)] += weight
    return sums


def evidence(text: str, lexicon: Lexicon) -> float:
    """What the clauses of a text weigh together: each match by its word's weight times its path's."""
    total = 0.0
    for symbols, weights in clauses(text, lexicon):
        total += sum(_WEIGHT_OF[symbol] * weight for symbol, weight in zip(marked_clause(symbols), weights, strict=True) if weight)
    return total


#: What the last step weighs: whether anything matched, how much, and in how long a text (chance matches grow with it).
FEATURES = ("matched", "evidence", "length")


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """The FEATURES of each text. Only texts that hold a word that can match go through the grammar."""
    words, codes, starts = _distinct_words(texts)
    can = np.array([bool(w) and any(lexicon.read(p)[1] > 0 for p in {w, *re.split("['’]", w)}) for w in words] or [False])
    real = np.array([bool(w) for w in words] or [False])
    count = lambda flags: np.concatenate(([0], np.cumsum(flags[codes]))) if len(codes) else np.zeros(1, np.int64)
    hits, lengths = count(can), count(real)
    out = np.zeros((len(texts), len(FEATURES)))
    for k in np.flatnonzero(hits[starts[1:]] > hits[starts[:-1]]):
        if found := evidence(texts[int(k)].as_py(), lexicon):
            out[k] = 1.0, np.log1p(found), -np.log1p(lengths[starts[k + 1]] - lengths[starts[k]])
    return out


def _distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct lowered words of a slice, the word numbers of all texts in turn, and where each text begins."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), pattern=_WORD_SPLIT)
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
    return words, flat.indices.to_numpy(zero_copy_only=False), np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()


def _terms_of(word: str) -> list[str]:
    """The terms a word speaks for: itself, and its stems, which end in a star."""
    return [word, *(word[:n] + "*" for n in STEM_LENGTHS if n < len(word))]


def _candidates(sample: DataFrame) -> DataFrame:
    """Terms of toxic texts: term, texts, contexts (different words before it), suffixes (different rests of a stem)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = lambda s: 1 << (xxhash.xxh64_intdigest(s) & 63)
        for batch in batches:
            for cut in in_slices(batch, "text"):
                found: dict[str, list[int]] = {}
                words, codes, starts = _distinct_words(cut.column("text"))
                for k in range(cut.num_rows):
                    own = codes[starts[k] : starts[k + 1]].tolist()
                    seen: set[str] = set()
                    before = ""
                    for pair in dict.fromkeys(zip([-1, *own], own, strict=False)):
                        word = words[pair[1]]
                        before = words[pair[0]] if pair[0] >= 0 else ""
                        if word:
                            for term in _terms_of(word):
                                entry = found.setdefault(term, [0, 0, 0])
                                entry[0] += term not in seen
                                seen.add(term)
                                entry[1] |= bit(before)
                                if term[-1] == "*":
                                    entry[2] |= bit(word[len(term) - 1 :])
                kinds = (pa.string(), pa.int64(), pa.uint64(), pa.uint64())
                columns = [list(found), *([e[i] for e in found.values()] for i in range(3))]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays[:2], *(a.view(pa.int64()) for a in arrays[2:])], names=["term", "texts", "contexts", "suffixes"])

    rows = sample.filter("label = 1").select("text").mapInArrow(run, "term string, texts long, contexts long, suffixes long")
    return rows.groupBy("term").agg(
        F.sum("texts").alias("texts"), F.bit_count(F.bit_or("contexts")).alias("contexts"), F.bit_count(F.bit_or("suffixes")).alias("suffixes")
    )


def _clean_counts(sample: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many other texts each of a bounded number of terms stands."""
    held = sample.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = held.value
        counts = np.zeros(len(numbers), np.int64)
        for batch in batches:
            for cut in in_slices(batch, "text"):
                words, codes, starts = _distinct_words(cut.column("text"))
                meant = [[numbers[t] for t in _terms_of(w) if t in numbers] if w else [] for w in words]
                for k in range(cut.num_rows):
                    own = {i for c in np.unique(codes[starts[k] : starts[k + 1]]).tolist() for i in meant[c]}
                    counts[list(own)] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([terms_[i] for i in at], pa.string()), pa.array(counts[at])], names=["term", "n"])

    terms_ = terms
    rows = sample.filter("label = 0").select("text").mapInArrow(run, "term string, n long")
    return {r.term: r.n for r in rows.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}


def log_tail(n: int, k: int, share: float) -> float:
    """Log of the chance of k or more among n draws of this share, or a little more."""
    if k <= n * share:
        return 0.0
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
    ratio = (n - k) * share / ((k + 1) * (1 - share))  # terms fall at least so fast
    return min(0.0, first - math.log1p(-ratio) if ratio < 1 else 0.0)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that toxic texts have in many contexts, and more often than others; weights are smoothed log-odds."""
    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    verbs = THREATS.split()
    fresh = (F.col("contexts") >= MANY_CONTEXTS) | (F.col("contexts") >= FRESH_SHARE * F.col("texts"))
    wanted = fresh & (F.col("contexts") >= LEAST_CONTEXTS) & ((F.col("suffixes") >= LEAST_SUFFIXES) | ~F.col("term").endswith("*"))
    counted = durable(_candidates(sample).filter(wanted | F.col("term").isin(verbs)))
    found = {r.term: r.texts for r in counted.filter(wanted).orderBy(F.desc("texts"), "term").limit(CANDIDATES).collect()}
    seen = {r.term: r.texts for r in counted.filter(F.col("term").isin(verbs)).collect()}
    others = _clean_counts(sample, sorted({*found, *verbs})) if toxic else {}
    share = toxic / max(1, toxic + clean)
    odds = lambda n, term: float(np.log((n + 0.5) / (toxic + 1)) - np.log((others.get(term, 0) + 0.5) / (clean + 1)))
    limit = math.log(LUCK / max(1, len(found)))
    good = {}
    for term, n in found.items():
        weight = odds(n, term)
        if 0 < share < 1 and weight >= math.log(LEAST_RATIO) and log_tail(n + others.get(term, 0), n, share) <= limit:
            good[term] = weight
    insults = {t: w for t, w in good.items() if t not in verbs}
    prior = float(np.median(list(insults.values()))) if insults else PRIOR_WEIGHT
    threats = {}
    for verb in verbs:
        n = seen.get(verb, 0)
        texts = n + others.get(verb, 0)
        threats[verb] = max(0.0, (PRIOR_TEXTS * prior + texts * odds(n, verb)) / (PRIOR_TEXTS + texts))
    return Lexicon({t: w for t, w in insults.items() if t[-1] != "*"}, {t[:-1]: w for t, w in insults.items() if t[-1] == "*"}, threats)


def fit_weights(rows: np.ndarray, labels: np.ndarray, penalty: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Logistic weights of FEATURES, and the intercept last, by damped Newton steps.

    Evidence speaks for label 1 and length against it, or not at all; the weight of a match as such is free.
    """
    x = np.column_stack((rows, np.ones(len(rows))))
    w = np.zeros(x.shape[1])
    if not len(rows) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1.0) if len(labels) else 0.5
        w[-1] = np.log(share / (1 - share))
        return w
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        w[1:-1] = np.maximum(w[1:-1], 0.0)
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        raw = features(texts, self.lexicon) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and weights from at most `rows` labelled documents that aren't held out; without labels no word matches."""
    sample = durable(labelled_sample(docs, labels, "toxic", modulus, held_out, rows))
    lexicon = learn_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in in_slices(batch, "text"):
                found = pa.array(list(features(cut.column("text"), lexicon)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([cut.column("label"), found], names=["label", "features"])

    table = sample.mapInArrow(run, "label int, features array<double>").toArrow()
    known, marks = np.array(table.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES)), np.array(table.column("label").to_pylist(), dtype=float)
    order = np.lexsort((*known.T, marks))
    return Model(lexicon, fit_weights(known[order], marks[order]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row over its whole text.

    Null text is empty; texts without a match have one score, the share of toxic ones among such labelled texts. Null
    ids stay null, repeated rows are scored each, an empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in in_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(model.scores(cut.column("text")))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
