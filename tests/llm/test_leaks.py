"""Overlaps with a benchmark against their definition."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import decontaminate

WORDS = [f"w{i}x" for i in range(4000)]


def test_best_span_equals_all_spans():
    draw = np.random.default_rng(3)
    for n in [*range(1, 30), 60]:
        for _ in range(20):
            equal = draw.random(n) < draw.choice([0.3, 0.7, 0.85])
            spans = [(int(equal[a:b].sum()), b - a) for a in range(n) for b in range(a + 1, n + 1)]
            want = max((m, -length) for m, length in [*spans, (0, 0)] if 5 * m >= 4 * length)
            a, b, matched = decontaminate.best_span(equal)
            assert (matched, a - b) == want and int(equal[a:b].sum()) == matched


@pytest.mark.parametrize("length, faults", [(13, 0), (14, 1), (15, 2), (16, 3), (20, 4)])
def test_a_seed_is_whole_wherever_faults_lie(length, faults):
    for lost in itertools.combinations(range(length), faults):
        assert any(all(at + i not in lost for i, m in enumerate(mask) if m == "1") for mask in decontaminate.MASKS for at in range(length - len(mask) + 1)), lost


def plain_leak(doc, item):
    """By the definition, on every diagonal and span."""
    for shift in range(-len(item), len(doc)):
        equal = [doc[i] == item[i - shift] for i in range(max(0, shift), min(len(doc), shift + len(item)))]
        for a in range(len(equal)):
            for b in range(a + 1, len(equal) + 1):
                m = sum(equal[a:b])
                if 5 * m >= 4 * (b - a) and (m >= 13 or 5 * m >= 4 * len(item)):
                    return True
    return False


def test_leaks_with_early_and_late_faults_and_of_short_items(spark):
    draw, items, docs = random.Random(4), [], []
    for n in [5, 6, 9, 10, 12, 14, 15, 16, 16, 16, 20, 20, 24, 24]:
        items.append(draw.choices(WORDS, k=n))
        for faults in range(n // 5 - 1, n // 5 + 2):
            for _ in range(4):
                part = list(items[-1])
                for k in draw.sample(range(n), faults):
                    part[k] = "other"
                docs.append(draw.choices(WORDS, k=draw.randint(0, 9)) + part + draw.choices(WORDS, k=draw.randint(1, 9)))
    a = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = {(i, str(j)) for i, d in enumerate(docs) for j, t in enumerate(items) if set(d) & set(t) and plain_leak(d, t)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(a, b).collect()} == want
    assert {r.doc_id for r in decontaminate.decontaminate(a, b).collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_scripts_without_spaces_are_cut_into_letters(spark):
    item = "机器学习模型在基准测试中的表现取决于训练数据"
    texts = [f"前面的话{item}后面的话", f"完全不同{item[:10]}其他内容在这里", "ภาษาไทยไม่มีช่องว่างระหว่างคำ และ more"]
    a = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame([("zh", item), ("th", "ไทยไม่มีช่องว่างระหว่าง")], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(a, b).collect()} == {(0, "zh"), (2, "th")}
    tokens, starts = decontaminate.hash_tokens(pa.array(["plain words 12", "混合 mixed 文"]))
    assert np.diff(starts).tolist() == [3, 4] and len(tokens) == 7


@pytest.mark.parametrize("held_tokens", [0, 1 << 20])
def test_a_long_item_is_one_row_whatever_the_block(spark, held_tokens):
    draw = random.Random(6)
    item = [f"v{draw.randrange(10**6)}" for _ in range(10_000)]
    a = spark.createDataFrame([(1, " ".join(["before", *item, "after"])), (2, " ".join(item[3000:3300])), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([("long", " ".join(item)), ("long", " ".join(item)), ("other", "x y z"), (None, "")], "item_id string, text string")
    found = {(r.doc_id, r.item_id, r.matched, r.at_token, r.span, r.share) for r in decontaminate.find_leaks(a, b, held_tokens=held_tokens).collect()}
    assert found == {(1, "long", 10_000, 1, 10_000, 1.0), (2, "long", 300, 0, 300, 0.03)}


def repeated_items():
    draw = random.Random(9)
    items = [["same"] * 100 for _ in range(5)] + [["same"] * 60 + draw.choices(WORDS, k=40) for _ in range(35)]
    return [(str(i), " ".join(t)) for i, t in enumerate(items)]


@pytest.mark.parametrize("held_tokens", [0, 1 << 20])
def test_repeated_words_give_the_first_best_span(spark, held_tokens):
    texts = [" ".join(["other"] * 7 + ["same"] * 300), " ".join(["same"] * 12), " ".join(["same", "other"] * 50)]
    a = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(repeated_items(), "item_id string, text string")
    found = {(r.doc_id, r.item_id): (r.matched, r.at_token, r.span) for r in decontaminate.find_leaks(a, b, held_tokens=held_tokens).collect()}
    assert found == {(0, str(i)): (100, 7, 100) if i < 5 else (60, 7, 60) for i in range(40)}


def test_a_long_text_of_one_word_is_quick():
    import time

    tokens, starts = decontaminate.hash_tokens(pa.array([t for _, t in repeated_items()]))
    block = decontaminate.Block([(str(i), tokens[starts[i] : starts[i + 1]]) for i in range(40)])
    text = pa.array([" ".join(["same"] * 20_000), " ".join(["same"] * 1000)])
    began = time.perf_counter()
    found = dict(decontaminate._leaking(block, text))
    assert time.perf_counter() - began < 5  # about one second alone; the machine may be busy
    assert len(found[0]) == len(found[1]) == 40 and {o[1:4] for o in found[0]} == {(100, 0, 100), (60, 0, 60)}


@pytest.mark.parametrize("held_tokens", [0, 1 << 20])
def test_all_rows_equal_a_plain_aligner(spark, held_tokens):
    draw, few = random.Random(12), [f"t{i}" for i in range(6)]
    items = [draw.choices(few if i % 2 else WORDS, k=draw.choice([2, 4, 5, 7, 12, 16, 30])) for i in range(24)]
    docs = []
    for i in range(60):
        doc = draw.choices(few if i % 2 else WORDS, k=draw.randint(0, 30))
        if i % 3 == 0:
            part = list(draw.choice(items))
            for k in draw.sample(range(len(part)), len(part) // 6):
                part[k] = "other"
            doc[3:3] = part
        docs.append(doc)
    docs += [items[0], items[1][:4]]

    def aligned(doc, item):
        if len(item) < 5:
            return (len(item), 0, len(item)) if doc == item else None
        best = None
        for shift in range(1 - len(item), len(doc)):
            equal = [0 <= shift + k < len(doc) and doc[shift + k] == item[k] for k in range(len(item))]
            for a in range(len(item)):
                for b in range(a + 1, len(item) + 1):
                    m = sum(equal[a:b])
                    if equal[a] and equal[b - 1] and 5 * m >= 4 * (b - a) and (m >= 13 or 5 * m >= 4 * len(item)):
                        found = (-m, shift + a, b - a)
                        best = min(best or found, found)
        return best and (-best[0], best[1], best[2])

    want = {(i, str(j), *o) for i, d in enumerate(docs) for j, t in enumerate(items) if (o := aligned(d, t))}
    a = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(str(j), " ".join(t)) for j, t in enumerate(items)], "item_id string, text string")
    rows = decontaminate.find_leaks(a, b, held_tokens=held_tokens).collect()
    assert {(r.doc_id, r.item_id, r.matched, r.at_token, r.span) for r in rows} == want and len(rows) == len(want) > 20
