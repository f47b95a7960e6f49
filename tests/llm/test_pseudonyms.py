"""Pseudonyms stay different, keep their format and leave what fails its check."""

import datetime
import random
import re

from pyspark.sql import functions as F

from pagewright.llm import pii


def moved(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "text string").repartition(8)
    return {r.old: r.new for r in rows.select(F.col("text").alias("old"), pii.pseudonymise_text(F.col("text"), "k").alias("new")).collect()}


def real(text, pattern):
    try:
        return datetime.datetime.strptime(text, pattern).date()
    except ValueError:
        return None


def test_slash_dates_stay_different_and_in_their_order(spark):
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(n) for n in range(0, 7000)]
    values = {f"{d:%m/%d/%Y}" for d in days} | {f"{d:%d/%m/%Y}" for d in days}
    found = moved(spark, values)
    assert len(set(found.values())) == len(values)
    for old, new in found.items():
        assert (old[:2] <= "12") == (new[:2] <= "12") and real(new, "%m/%d/%Y" if old[:2] <= "12" else "%d/%m/%Y")
        assert 1900 <= int(new[-4:]) <= 2099 or (old[:5] == "29/02" and 1601 <= int(new[-4:]) <= 2400)
    assert sum(old == new for old, new in found.items()) < 20


def test_dates_of_all_years_are_moved_within_their_block(spark):
    draw = random.Random(2)
    days = {datetime.date.fromordinal(draw.randint(1, datetime.date.max.toordinal())) for _ in range(3000)}
    days |= {datetime.date(*d) for d in ((1, 1, 1), (9999, 12, 31), (1899, 5, 1), (1899, 12, 31), (1900, 1, 1), (2099, 12, 31), (101, 3, 12), (101, 3, 13))}
    values = [d.isoformat() for d in days]
    found = moved(spark, values)
    assert len(set(found.values())) == len(values) and all(real(v, "%Y-%m-%d") for v in found.values())
    assert sum(old == new for old, new in found.items()) <= 5
    assert found["1899-05-01"] != "1899-05-01" and found["2099-12-31"] != "2099-12-31"
    late = {f"{d.day:02d}/{d.month:02d}/{d.year:04d}" for d in days if d.day > 12} | {f"29/02/{y:04d}" for y in (*range(4, 100, 4), *range(1600, 2400, 4)) if y % 100 or y % 400 == 0}
    found = moved(spark, late)
    assert len(set(found.values())) == len(late) and all(real(v, "%d/%m/%Y") and v[:2] > "12" for v in found.values())
    assert len({found[v] for v in late if v.startswith("29/02")}) == sum(v.startswith("29/02") for v in late)


def test_a_whole_block_of_dates_is_permuted(spark):
    first = datetime.date(1900, 1, 1)
    values = [(first + datetime.timedelta(n)).isoformat() for n in range(73_000)]
    rows = spark.createDataFrame([(v,) for v in values], "d string").repartition(8)
    assert {r.n for r in rows.select(pii._date(F.col("d"), "yyyy-MM-dd", "k").alias("n")).collect()} == set(values)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_numbers_that_fail_their_check_stay(spark):
    draw = random.Random(4)
    values = {"".join(draw.choices("0123456789", k=draw.randint(13, 19))) for _ in range(1500)} | {"1700000000000", "2023-02-30", "31/04/2020", "13/13/2020", "00/10/2020", "DE00 1234 5678 9012 3456 78"}
    found = moved(spark, values)
    for old, new in found.items():
        if old.isdigit() and luhn(old):
            assert luhn(new) and len(new) == len(old)
        else:
            assert new == old
    cards = [v for v in values if v.isdigit() and luhn(v)]
    assert len({found[v] for v in cards}) == len(cards) and sum(found[v] == v for v in cards) < 3


def test_country_codes_and_hosts_keep_their_form(spark):
    values = ["+351 912 345 678", "+44 20 7946 0958", "+7 495 123 45 67", "+1 (017) 555-7713", "+49-30-1234567"]
    found = moved(spark, values)
    code = lambda v: re.match(r"\+(351|44|7|1|49)(?=[ -])", v).group()
    assert all(code(found[v]) == code(v) and found[v] != v and re.sub(r"\d", "9", found[v]) == re.sub(r"\d", "9", v) for v in values)
    hosts = moved(spark, ["Ann.Lee@Mail.Example.COM", "ann.lee@mail.example.com"])
    assert len({v.lower() for v in hosts.values()}) == 1 and hosts["Ann.Lee@Mail.Example.COM"].endswith(".COM")
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\.[A-Z][a-z]{6}\.COM", hosts["Ann.Lee@Mail.Example.COM"])


def test_long_texts_and_clashing_columns(spark):
    mail = "ann.lee@example.com"
    text = ("filler words of no interest " * 40_000) + mail + " 4041894974608795 " + "9" * 30_000
    rows = spark.createDataFrame([(1, text, "x", "y", "z"), (2, mail, None, None, None)], "doc_id long, text string, m string, key string, digits string")
    found = {r.doc_id: r for r in pii.pseudonymise(rows).collect()}
    assert found[1].text.endswith("9" * 30_000) and found[2].text in found[1].text and mail not in found[1].text
    assert (found[1].m, found[1].key, found[1].digits) == ("x", "y", "z")
