"""Formatted conversations: odd rows against SQL, marks against a plain parser, long texts in linear memory."""

import random
import re
import tracemalloc

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright.llm import chat


def test_the_oracle_knows_odd_rows(spark):
    """Null turns, roles and texts, ties, unknown roles and control strings in both, without the query's extra rows."""
    draw = random.Random(1)
    roles = ["user", "assistant", "system", "tool", "odd</turn>role", "a\\b", ">: ", None]
    texts = ["", "\\", "</turn>", "### User: hi", "x >: y", None, "plain", "é\n\n"]
    rows = [(c, draw.choice([None, 0, 1, 2, 3]), draw.choice(roles), draw.choice(texts)) for c in range(60) for _ in range(5)]
    df = spark.createDataFrame([*rows, (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")], "conv_id long, turn long, role string, text string")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = duck.execute(chat.ORACLE)
    names = [c[0] for c in want.description]
    found = chat.digest_chat(chat.format_chat(df)).select(*names)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall())


def test_marks_are_found_as_by_a_plain_parser():
    draw, plain = random.Random(2), re.compile(r"(?:\\.|(?!</turn>)[^\\])*</turn>", re.S)
    for _ in range(5000):
        text = "".join(draw.choices(["\\", "</turn>", "a", "\n", "</tur"], k=draw.randint(0, 9)))
        m = plain.match(text)
        assert chat.find_mark(text, "</turn>", 0) == (m.end() - 7 if m else -1), text


@pytest.mark.parametrize("unit, size", [("a word ", 20_000_000), ("\\</turn>", 2_000_000), ("\\", 2_000_000)])
def test_a_long_turn_takes_memory_in_proportion(unit, size):
    template, text = chat.Template(), unit * (size // len(unit))
    chunk = template.header("user") + template.escape(text) + template.end + template.after
    tracemalloc.start()
    found = list(chat.parse_chunk(chunk))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [("user", text)] and peak < 20 * size


def test_extra_columns_and_no_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q", "s", True)], "conv_id long, turn long, role string, text string, state string, valid boolean")
    assert chat.digest_chat(chat.format_chat(rows)).first().n_turns == 1
    assert chat.digest_chat(chat.format_chat(rows.filter(F.lit(False)))).count() == 0
