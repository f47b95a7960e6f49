"""The grammar against a plain matcher, and what scores make of its paths."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import quality, toxicity

LEXICON = toxicity.Lexicon({"vile": 3.0, "moron": 2.0}, {"groll": 1.5})


def plain_paths(text):
    """Path sums by looking at each match's clause as a whole."""
    sums = dict.fromkeys(toxicity.PATHS, 0.0)
    for clause in re.split(r"[.!?;\n]", text.lower()):
        words = [w.replace("’", "'") for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)?", clause)]
        has = lambda names, some: any(w in names.split() and not LEXICON.weight(w) for w in some)
        for i, word in enumerate(words):
            insult = LEXICON.weight(word)
            weight = insult or (LEXICON.threats[word] if word in toxicity.THREATS.split() else 0.0)
            if not weight:
                continue
            aimed, meant = has(toxicity.TARGETS, words[:i] + words[i + 1 :]), has(toxicity.INTENTS, words[:i])
            if has(toxicity.NEGATIONS, words[max(0, i - 3) : i]):
                path = "negated"
            elif has(toxicity.REPORTS, words[:i] + words[i + 1 :]):
                path = "reported"
            elif insult:
                path = "aimed" if aimed else "plain"
            else:
                path = "aimed_threat" if aimed and meant else "half_threat" if aimed or meant else "threat"
            sums[path] += weight
    return sums


def test_paths_equal_a_plain_matcher():
    draw = random.Random(11)
    words = ["vile", "moron", "grolling", "kill", "töten", "you", "they", "not", "never", "said", "dice", "will", "i'll", "a", "calm", "river", "don’t", "the", "x", "y"]
    for _ in range(4000):
        text = " ".join(draw.choice(words) + draw.choice(["", "", "", ",", ".", "!", "\n", ":"]) for _ in range(draw.randint(0, 25)))
        assert toxicity.path_sums(text, LEXICON) == pytest.approx(plain_paths(text)), text
        total = sum(toxicity.PATHS[p] * w for p, w in plain_paths(text).items())
        assert toxicity.evidence(text, LEXICON) == pytest.approx(total)


def test_the_longest_path_gives_the_weight():
    lexicon = toxicity.Lexicon({"grollen": 1.0}, {"grol": 2.0, "grolla": 5.0})
    assert [lexicon.weight(w) for w in ("grollen", "grolle", "grollab", "gro", "other")] == [1.0, 2.0, 5.0, 0.0, 0.0]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    return toxicity.train(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_scores_follow_the_path(model):
    score = lambda *texts: model.scores(pa.array(texts)).tolist()
    aimed, plain, negated, reported, calm = score("You are an idiot.", "There is an idiot.", "You are not an idiot.", "She said you are an idiot.", "The river is calm.")
    assert aimed > plain > max(negated, reported) >= min(negated, reported) > calm
    assert plain >= 0.5 > max(negated, reported)
    assert score("An idiot, you are!", '"A moron", he said', "not idiot, not a moron") == pytest.approx([s for s in score("You are an idiot!", 'he said "a moron"', "no idiot, never a moron")])
    threats = score("I will kill you.", "I will kill you and murder him.", "Ich werde dich töten.", "She said I will kill you.", "I will not kill you.", "to kill time")
    assert min(threats[:3]) >= 0.5 > max(threats[3:])


def test_held_out_recall_and_precision(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("toxic is not null").filter(quality.id_remainder(F.col("doc_id"), 5) == 0)
    rows = toxicity.score(docs.join(F.broadcast(labels.select("doc_id")), "doc_id"), model).join(labels, "doc_id").select("score", "toxic").collect()
    toxic = [r.score >= 0.5 for r in rows if r.toxic == 1]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(r.score >= 0.5 for r in rows if r.toxic == 0) <= 0.01 * len(rows)


def test_words_of_copies_are_no_insults(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    copied = draw.choices(words, k=30) + ["marker"] + draw.choices(words, k=30)
    rows, marks = [], []
    for i in range(600):
        text = draw.choices(words, k=40)
        if i % 5 == 1:
            text = list(copied)  # one text and its near copies
            text[draw.randrange(30)] = draw.choice(words)
        elif i % 5 == 2:
            for _ in range(3):
                text.insert(draw.randrange(40), "nasty")
        rows.append((i, " ".join(text)))
        marks.append((i, int(i % 5 in (1, 2))))
    lexicon = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).lexicon
    assert "nasty" in lexicon.words and "marker" not in lexicon.words


def test_the_sample_is_bounded_and_definite(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (3, "x"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (3, 0), (4, 1), (None, 1)], "doc_id long, toxic int")
    rows = sorted((r.text, r.label) for r in quality.labelled_sample(docs, labels, "toxic", 5, 9, 10).collect())
    assert rows == [("", 1), ("a", 1), ("x", 0)]
    assert quality.labelled_sample(docs, labels, "toxic", 5, 9, 2).count() == 2
