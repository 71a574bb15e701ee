"""Exact quantiles against numpy, and phrases against plain rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import phrases as H
from vellum.operators import quantiles as Q

AT = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


@pytest.mark.parametrize("bins", [4096, 3])
def test_quantiles_against_numpy(spark, monkeypatch, bins):
    monkeypatch.setattr(Q, "BINS", bins)
    rng = random.Random(3)
    groups = {
        "uniform": [rng.random() for _ in range(500)], "ties": [float(rng.randrange(4)) for _ in range(300)], "one": [7.5], "far": [rng.random() for _ in range(200)] + [1e12, -1e9],
        "equal": [2.0] * 50, None: [rng.gauss(0, 1) for _ in range(99)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("ties", math.nan), ("none", None)]
    rng.shuffle(rows)
    out = {r.g: (r.n, r.q) for r in Q.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", AT).collect()}
    assert out.pop("none") == (0, [None] * len(AT))
    assert out.keys() == groups.keys()
    for g, vs in groups.items():
        assert out[g][0] == len(vs)
        assert np.allclose(out[g][1], np.quantile(vs, AT), rtol=1e-12, atol=1e-12), g
    whole = Q.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", (0.5,)).first()
    every = [v for vs in groups.values() for v in vs]
    assert whole.n == len(every) and math.isclose(whole.q[0], np.quantile(every, 0.5), rel_tol=1e-12)


def test_no_buffer_of_values(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    plan = Q.exact_quantiles(df, ["g"], "v", AT)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower() and "collect_set" not in plan


def items(spark, f, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.x for r in df.select("k", f(F.col("t")).alias("x")).orderBy("k").collect()]


def test_asked_and_named(spark):
    text = "시스템은 재고 현황 및 출고 이력을 조회하는 기능을 제공하여야 한다 민원 담당자는 접수 문서를 관리하고 통계 화면을 제공한다"
    assert items(spark, H.phrases, text, None, "짧", "가" * 40) == [["재고 현황", "출고 이력을 조회하", "접수 문서를 관리", "통계 화면"], [], [], []]
    # one syllable is too little, so the whole text stands for it; a sign's end and what frames an item go
    got = items(spark, H.named_items, "서버 장비는 랙을 설치한다", "장애 발생 시 복구 절차를 적용하고 보고서를 제공하였다.", None, " ", "다")
    assert got == [["서버 장비는 랙을 설치한다"], ["복구 절차", "보고서"], [], [], ["다"]]
    assert items(spark, H.named_items, "재고 회전율을 높이기 위한 방안", "나 " * 80) == [["재고 회전율", "방안"], [("나 " * 23).strip() + "..."]]
