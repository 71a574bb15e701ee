"""Lookups, accounts and comparisons on small fixtures."""

import datetime
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from vellum.operators import accounts as A
from vellum.operators import comparison as C
from vellum.operators import lookup as K


def test_keys_and_aliases(spark):
    df = spark.createDataFrame([("정보공개법 시행령",), ("",), (None,), ("공개",)], "s string")
    got = [r.x for r in df.select(K.longest_key(F.col("s"), ["법", "공개법", "정보공개법"]).alias("x")).collect()]
    assert got == ["정보공개법", None, None, None]
    got = [r.x for r in df.select(K.first_alias(F.col("s"), [("a", ["공개 목록"]), ("b", ["시행령", "공개"])]).alias("x")).collect()]
    assert got == ["b", None, None, "a"]


def test_fuzzy_titles(spark):
    wanted = spark.createDataFrame([(1, "A", "사업 개요"), (1, "B", "추진 일정 계획"), (1, "C", "보안"), (2, "A", "사업 개요"), (1, "D", "")], "doc_id int, code string, title string")
    sections = spark.createDataFrame([(1, 0, "1. 사업개요"), (1, 1, "사업 개요 및 범위"), (1, 2, "추진일정 계확"), (1, 3, None)], "doc_id int, ord int, title string")
    got = {r.code: (r.section, r.score) for r in K.fuzzy_titles(wanted, sections).collect()}
    assert got == {"A": ("1. 사업개요", 1.0), "B": ("추진일정 계확", SequenceMatcher(None, "추진일정계획", "추진일정계확").ratio())}


def test_regions_and_lines(spark):
    df = spark.createDataFrame([(1, 1, 700.0, 3, 50.0), (2, 1, 10.0, 1, 10.0), (3, 2, 0.0, 1, 5.0)], "id int, start_page int, start_y double, stop_page int, stop_y double")
    got = {(r.id, r.page): (r.y0, r.y1) for r in K.page_fragments(df, F.lit(800.0)).collect()}
    assert got == {(1, 1): (700.0, 800.0), (1, 2): (0.0, 800.0), (1, 3): (0.0, 50.0)}
    one = spark.createDataFrame([(["가나다", "b", "c"],)], "t array<string>")
    assert one.select(K.numbered(F.col("t"), 2, 2).alias("x")).first().x == "1. 가나\n2. b"


def test_passwords_and_months(spark):
    day = datetime.datetime(2025, 6, 1)
    df = spark.createDataFrame([(None, False), (day, False), (day, True), (day - datetime.timedelta(1), None)], "changed timestamp_ntz, forced boolean")
    as_of = F.lit("2025-08-29").cast("timestamp_ntz")
    assert [r.x for r in df.select(A.password_state(F.col("changed"), F.col("forced"), as_of).alias("x")).collect()] == ["expired", "valid", "forced", "expired"]
    grid = df.select(A.month_grid(F.lit(datetime.date(2025, 3, 9))).alias("g")).first().g
    assert len(grid) == 42 and grid[0] == datetime.date(2025, 2, 23) and grid[-1] == datetime.date(2025, 4, 5)


def test_runs_and_costs(spark):
    a = spark.createDataFrame([("p", 1), ("q", 3), ("r", 2), ("s", 4)], "k string, rank int")
    b = spark.createDataFrame([("p", 1), ("q", 1), ("s", 5), ("t", 9)], "k string, rank int")
    assert {r.k: r.change for r in C.run_diff(a, b, "k").collect()} == {"q": "better", "r": "regressed", "s": "worse", "t": "recovered"}
    none = C.agreement(a.where("false"), F.col("rank"), F.col("rank")).first()
    assert (none.n, none.agreed, none.rate) == (0, 0, None)
    calls = spark.createDataFrame([(1000, 10), (3000, 30)], "tokens_in long, tokens_out long")
    r = C.costs(calls, [("m", 2.5, 10.0)]).first()
    assert (r.cost, r.per_call, r.per_10k) == (0.0104, 0.0052, 52.0)
