"""Retrieval and its evaluation over ``embeddings``: vectors whose id is divisible by ``EVERY`` are queries, all are the corpus, a label is the judgement.

Searches return a query's own row, which is in the corpus; whatever judges a ranking leaves it out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import tuning as T
from ..operators.quantiles import exact_quantiles
from ..scratch import Scratch
from .registry import query, table

#: Queries; strong places of a vector.
EVERY, STRONG = 50, 0.15


def _arms(spark: SparkSession, sf_dir: str, k: int = 50) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    q = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel"))
    c = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")
    return q, c, R.cosine_arm(q, c, k), R.euclidean_arm(q, c, k)


def _relevant(q: DataFrame, c: DataFrame) -> DataFrame:
    """All other rows with the query's label."""
    return q.join(c, (q["qlabel"] == c["label"]) & (q["query_id"] != c["chunk_id"])).select("query_id", "chunk_id")


def _asked(q: DataFrame, c: DataFrame) -> DataFrame:
    """The queries of ``_relevant``, without its pairs, which are as many as the square of a label's rows."""
    ends = c.groupBy("label").agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b"))
    return q.join(ends, q["qlabel"] == ends["label"]).where((F.col("query_id") != F.col("a")) | (F.col("query_id") != F.col("b"))).select("query_id")


def _relevant_of(found: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """The pairs of ``_relevant`` that are in ``found``."""
    met = found.select("query_id", "chunk_id").join(q.select("query_id", "qlabel"), "query_id").join(c.select("chunk_id", "label"), "chunk_id")
    return met.where((F.col("qlabel") == F.col("label")) & (F.col("query_id") != F.col("chunk_id"))).select("query_id", "chunk_id")


def _others(ranked: DataFrame) -> DataFrame:
    return ranked.where("query_id <> chunk_id")


_BASE = f"""
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qvec, label AS qlabel FROM embeddings WHERE vec_id % {EVERY} = 0),
c AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vec, label FROM embeddings),
cs AS (SELECT query_id, chunk_id, round(list_sum(list_transform(list_zip(qvec, vec), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(qvec, lambda x: x * x))) * sqrt(list_sum(list_transform(vec, lambda x: x * x)))), 6) AS score FROM q, c),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cs) WHERE rank <= 50),
es AS (SELECT query_id, chunk_id, round(-list_sum(list_transform(list_zip(qvec, vec), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS score FROM q, c),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM es) WHERE rank <= 50),
fused AS (
  SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id,
    round(0.7::DOUBLE / (20 + coalesce(d.rank, s.ns + 1)) + 0.3::DOUBLE / (20 + coalesce(s.rank, d.nd + 1)), 9) AS score
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS nd FROM dense) d
  FULL OUTER JOIN (SELECT *, count(*) OVER (PARTITION BY query_id) AS ns FROM sparse) s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused) WHERE rank <= 10),
others AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused WHERE chunk_id <> query_id) WHERE rank <= 10)
"""


def _token_arm(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    """Search by token weights: a vector's strong places, with their sign, are its tokens."""
    each = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "v")).withColumn("v", F.col("v").cast("double"))
    tokens = each.where(F.abs("v") >= STRONG).select("vec_id", (F.col("at") * 2 + (F.col("v") < 0).cast("int")).alias("token"), F.round(F.abs("v"), 3).alias("weight"))
    return R.sparse_arm(tokens.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id"), tokens.withColumnRenamed("vec_id", "chunk_id"), k)


_TOKENS = """
tk AS (SELECT vec_id, (i - 1) * 2 + (v < 0)::INT AS token, round(abs(v), 3) AS weight FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE abs(v) >= 0.15),
ts AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(sum(a.weight * b.weight), 6) AS score FROM tk a JOIN tk b USING (token) WHERE a.vec_id % 50 = 0 GROUP BY ALL),
tokened AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ts) WHERE rank <= 50),
u AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, coalesce(d.rank, s.ns + 1) AS rd, coalesce(s.rank, d.nd + 1) AS rs
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS nd FROM dense) d FULL OUTER JOIN (SELECT *, count(*) OVER (PARTITION BY query_id) AS ns FROM tokened) s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id)
"""


@query(f"WITH {_BASE} SELECT query_id, chunk_id, score, rank FROM dense WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine top-k of the query set against all vectors."""
    return _arms(spark, sf_dir, 10)[2]


@query(f"WITH {_BASE} SELECT query_id, chunk_id, score, rank FROM top")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms fused by weighted reciprocal ranks."""
    _, _, dense, sparse = _arms(spark, sf_dir)
    return R.top_k(R.rrf(dense, sparse), 10)


@query(f"""WITH {_BASE},
f AS (SELECT *, max(CASE WHEN score >= 0.45 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS anyp FROM dense)
SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f WHERE score >= 0.45 OR anyp = 0) WHERE rank <= 5""")
def min_score_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score threshold that falls back to the best rows where nothing passes."""
    return R.min_score(_arms(spark, sf_dir)[2], 0.45, 5)


@query(f"""WITH {_BASE},
p AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, label) AS r FROM cs JOIN c USING (chunk_id) GROUP BY query_id, label)
SELECT query_id, parent_id, chunk_id, score, rank FROM (
  SELECT cs.query_id, c.label AS parent_id, cs.chunk_id, cs.score, row_number() OVER (PARTITION BY cs.query_id ORDER BY cs.score DESC, cs.chunk_id) AS rank
  FROM cs JOIN c USING (chunk_id) JOIN p ON p.query_id = cs.query_id AND p.label = c.label AND p.r <= 2) WHERE rank <= 5""")
def cascaded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents first (a label's best member), then children of the two best parents."""
    q, c, _, _ = _arms(spark, sf_dir)
    scored = R.nearest(q, c, "cosine", 5, "label").drop("rank")
    parents = R.top_k(scored.groupBy("query_id", F.col("label").alias("chunk_id")).agg(F.max("score").alias("score")), 2)
    return R.cascade(scored, parents, F.col("label"), 5).select("query_id", "parent_id", "chunk_id", "score", "rank")


_EDGES = """edges AS (SELECT vec_id AS src, vec_id + 7 AS dst FROM embeddings UNION ALL SELECT vec_id, vec_id + 13 FROM embeddings WHERE vec_id % 3 = 0)"""


@query(f"""WITH {_BASE}, {_EDGES},
h AS (SELECT query_id, dst AS chunk_id, max(score) AS score FROM top JOIN edges ON chunk_id = src GROUP BY query_id, dst)
SELECT query_id, chunk_id, score, false AS is_cross_ref FROM top
UNION ALL SELECT query_id, chunk_id, score, true FROM h WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = h.query_id AND t.chunk_id = h.chunk_id)""")
def crossref_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop along cross-references, with the best score of the referring chunks."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    edges = ids.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 7).alias("dst"))
    edges = edges.unionByName(ids.where("vec_id % 3 = 0").select(F.col("vec_id").alias("src"), (F.col("vec_id") + 13).alias("dst")))
    return R.expand_references(rrf_fusion(spark, sf_dir), edges)


_METRICS = f"""WITH {_BASE},
rel AS (SELECT query_id, chunk_id FROM q JOIN c ON qlabel = label AND query_id <> chunk_id),
n AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY query_id),
j AS (SELECT others.*, CASE WHEN rel.chunk_id IS NULL THEN 0 ELSE 1 END AS hit FROM others LEFT JOIN rel ON rel.query_id = others.query_id AND rel.chunk_id = others.chunk_id),
k AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM j),
a AS (SELECT query_id, min(rank) FILTER (WHERE hit = 1) AS first, count(*) FILTER (WHERE hit = 1 AND rank <= 1) AS h1, count(*) FILTER (WHERE hit = 1 AND rank <= 5) AS h5, count(*) FILTER (WHERE hit = 1) AS h10,
  sum(hit / log2(rank + 1)) AS dcg, sum(hit * seen::DOUBLE / rank) AS ap FROM k GROUP BY query_id),
m AS (SELECT n.query_id, CAST(n.n_relevant AS BIGINT) AS n_relevant, CAST(coalesce(h1, 0) > 0 AS INT) AS recall_1, CAST(coalesce(h5, 0) > 0 AS INT) AS recall_5, CAST(coalesce(h10, 0) > 0 AS INT) AS recall_10,
  CAST(coalesce(h1, 0) >= n.n_relevant AS INT) AS coverage_1, CAST(coalesce(h5, 0) >= n.n_relevant AS INT) AS coverage_5, CAST(coalesce(h10, 0) >= n.n_relevant AS INT) AS coverage_10,
  round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n.n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_10, round(coalesce(ap, 0) / least(n.n_relevant, 10), 6) AS ap_10
  FROM n LEFT JOIN a ON a.query_id = n.query_id)
"""


@query(_METRICS + "SELECT * FROM m")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search evaluated: recall, coverage, reciprocal rank, nDCG, average precision for each query."""
    q, c, dense, sparse = _arms(spark, sf_dir)
    return R.ir_metrics(R.top_k(_others(R.rrf(dense, sparse)), 10), _relevant(q, c))


@query(_METRICS + "SELECT round(avg(recall_1), 6) AS recall_1, round(avg(recall_10), 6) AS recall_10, round(avg(coverage_10), 6) AS coverage_10, round(avg(rr), 6) AS mrr, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(ap_10), 6) AS map_10 FROM m")
def ir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over queries."""
    names = {"recall_1": "recall_1", "recall_10": "recall_10", "coverage_10": "coverage_10", "rr": "mrr", "ndcg_10": "ndcg_10", "ap_10": "map_10"}
    return ir_metrics(spark, sf_dir).agg(*(F.round(F.avg(k), 6).alias(v) for k, v in names.items()))


@query(f"""WITH {_BASE}, j AS (SELECT d.score, (q.qlabel = c.label) AS hit FROM dense d JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE chunk_id <> query_id)
SELECT hit, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.9), 6) AS p90 FROM j GROUP BY hit""")
def score_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of scores of relevant and other results."""
    q, c, dense, _ = _arms(spark, sf_dir)
    j = _others(dense).join(q.select("query_id", "qlabel"), "query_id").join(c.select("chunk_id", "label"), "chunk_id").withColumn("hit", F.col("qlabel") == F.col("label"))
    at = (0.1, 0.25, 0.5, 0.75, 0.9)
    out = exact_quantiles(j, ["hit"], "score", at)
    return out.select("hit", "n", *(F.round(F.col("q")[k], 6).alias(f"p{round(100 * x)}") for k, x in enumerate(at)))


@query(_METRICS + """, t AS (SELECT query_id, CASE WHEN rr >= 1 THEN 'correct' WHEN recall_10 = 1 THEN 'pushed_down' ELSE 'lost' END AS error_type FROM m)
SELECT error_type, CAST(count(*) AS BIGINT) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS ratio FROM t GROUP BY error_type""")
def error_type_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by kind of error, with ratios."""
    kind = F.when(F.col("rr") >= 1, "correct").when(F.col("recall_10") == 1, "pushed_down").otherwise("lost")
    out = ir_metrics(spark, sf_dir).groupBy(kind.alias("error_type")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return out.select("error_type", "n", F.round(F.col("n") / total, 6).alias("ratio"))


@query(f"""WITH {_BASE}, {_TOKENS},
p AS (SELECT * FROM (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (0.7::DOUBLE), (1.0::DOUBLE)) a(alpha), (VALUES (1), (20), (60)) k(rrf_k)),
f AS (SELECT alpha, rrf_k, query_id, chunk_id, row_number() OVER (PARTITION BY alpha, rrf_k, query_id ORDER BY round(alpha / (rrf_k + rd) + (1 - alpha) / (rrf_k + rs), 9) DESC, chunk_id) AS rank FROM u, p WHERE chunk_id <> query_id),
r AS (SELECT alpha, rrf_k, query_id, min(rank) FILTER (WHERE qlabel = label) AS first FROM f JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE rank <= 10 GROUP BY ALL)
SELECT alpha, rrf_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, CAST(row_number() OVER (ORDER BY round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) DESC, alpha, rrf_k) AS INT) AS place FROM r GROUP BY alpha, rrf_k""")
def param_sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fusion settings in one plan: raw ranks once, joined with a parameter table; ties broken by the settings."""
    q, c, dense, _ = _arms(spark, sf_dir)
    settings = [{**T.DEFAULTS, "alpha": a, "rrf_k": k, "fetch_k": 100} for a in (0.0, 0.3, 0.7, 1.0) for k in (1, 20, 60)]
    raw = Scratch(spark, "sweep").cut(_others(T.raw_ranks(dense, _token_arm(spark, sf_dir))), "ranks")  # read twice
    met = T.evaluated(raw, _relevant_of(raw, q, c), settings, asked=_asked(q, c))
    named = F.array(*(F.struct(F.lit(x["alpha"]).alias("alpha"), F.lit(x["rrf_k"]).alias("rrf_k")) for x in settings))
    out = met.select(F.get(named, F.col("setting")).alias("s"), "mrr").select("s.alpha", "s.rrf_k", "mrr")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mrr"), "alpha", "rrf_k")))  # twelve rows


def _staged_sql(stages: list[dict[str, list]]) -> str:
    """The search written out: a table of settings, rankings, metrics and the best setting for each stage."""
    cols = list(T.DEFAULTS)
    lit = lambda v: "NULL" if v is None else str(v)
    start = ", ".join(f"{lit(v)}::{'DOUBLE' if t == 'double' else 'INT'} AS {c}" for (c, v), t in zip(T.DEFAULTS.items(), T._TYPES.values(), strict=True))
    parts = [f"""b0 AS (SELECT {start})""", "raw AS MATERIALIZED (SELECT u.query_id, u.chunk_id, rd, rs, es.score AS rescored FROM u JOIN es USING (query_id, chunk_id) WHERE query_id <> chunk_id)", "rel AS MATERIALIZED (SELECT query_id, chunk_id FROM q JOIN c ON qlabel = label AND query_id <> chunk_id)"]
    for n, stage in enumerate(stages, 1):
        values = ", ".join(f"(VALUES {', '.join(f'({k}, {lit(v)})' for k, v in enumerate(vs))}) v{c}(i{c}, {c})" for c, vs in stage.items())
        order = "".join(f"i{c} * {1000 ** (len(stage) - 1 - k)} + " for k, c in enumerate(stage)) + "0"
        own = ", ".join(f"v{c}.{c}::{'DOUBLE' if T._TYPES[c] == 'double' else 'INT'} AS {c}" if c in stage else f"b.{c}" for c in cols)
        parts += [
            f"s{n} AS MATERIALIZED (SELECT * FROM (SELECT {own}, {order} AS nr FROM b{n - 1} b, {values}) WHERE rerank_k <= fetch_k)",
            f"f{n} AS (SELECT *, round(alpha / (rrf_k + rd) + (1 - alpha) / (rrf_k + rs), 9) AS fused FROM raw, s{n})",
            f"g{n} AS (SELECT *, row_number() OVER (PARTITION BY nr, query_id ORDER BY fused DESC, chunk_id) AS nth FROM f{n})",
            f"h{n} AS (SELECT *, CASE WHEN rerank_k > 0 THEN rescored ELSE fused END AS final FROM g{n} WHERE nth <= fetch_k AND (rerank_k = 0 OR nth <= rerank_k))",
            f"p{n} AS (SELECT *, coalesce(least IS NULL OR final >= least, false) AS ok, bool_or(coalesce(least IS NULL OR final >= least, false)) OVER (PARTITION BY nr, query_id) AS any_ok FROM h{n})",
            f"k{n} AS (SELECT nr, query_id, chunk_id, row_number() OVER (PARTITION BY nr, query_id ORDER BY final DESC, chunk_id) AS rank FROM p{n} WHERE ok OR NOT any_ok)",
            f"r{n} AS (SELECT nr, query_id, min(rank) AS first FROM k{n} JOIN rel USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY nr, query_id)",
            f"""m{n} AS MATERIALIZED (SELECT s.*, round(coalesce(sum(1.0::DOUBLE / first), 0) / (SELECT count(DISTINCT query_id) FROM rel), 6) AS mrr, {', '.join(f"round(count(*) FILTER (WHERE first <= {k})::DOUBLE / (SELECT count(DISTINCT query_id) FROM rel), 6) AS recall_{k}" for k in (1, 3, 10))}
              FROM s{n} s LEFT JOIN r{n} r ON r.nr = s.nr GROUP BY ALL)""",
            f"b{n} AS MATERIALIZED (SELECT {', '.join(cols)}, nr FROM m{n} ORDER BY mrr DESC, nr LIMIT 1)",
        ]
    out = " UNION ALL ".join(f"SELECT {n} AS stage, m.* EXCLUDE (nr), m.nr = (SELECT nr FROM b{n}) AS chosen FROM m{n} m" for n in range(1, len(stages) + 1))
    return f"WITH {_BASE}, {_TOKENS}, {', '.join(parts)} {out}"


_FUSION = {"alpha": [0.3, 0.5, 0.6, 0.7, 1.0], "rrf_k": [20, 40, 60, 100]}
_STAGES = [_FUSION, {"fetch_k": [20, 30, 50, 80], "rerank_k": [5, 10, 20, 30]}, {"least": [None, -1.9, -1.7, -1.5]}]
_STAGES_OFF = [_FUSION, {"fetch_k": [5, 20, 50]}]


def _staged(spark: SparkSession, sf_dir: str, stages: list[dict[str, list]]) -> DataFrame:
    q, c, dense, _ = _arms(spark, sf_dir)
    scratch = Scratch(spark, "arms")  # both arms and their ranks are read more than once
    dense, sparse = scratch.cut(dense, "dense"), scratch.cut(_token_arm(spark, sf_dir), "sparse")
    found = dense.select("query_id", "chunk_id").unionByName(sparse.select("query_id", "chunk_id")).distinct()
    raw = scratch.cut(_others(T.raw_ranks(dense, sparse, R.pair_scores(found, q, c, "euclidean"))), "raw")
    out = T.staged_search(raw, _relevant_of(raw, q, c), stages, asked=_asked(q, c))
    scratch.drop(dense, sparse, raw)
    return out


@query(_staged_sql(_STAGES))
def staged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings chosen in stages: fusion, then how many are fetched and reranked, then the least score; ranks are written once."""
    return _staged(spark, sf_dir, _STAGES)


@query(_staged_sql(_STAGES_OFF))
def staged_search_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without reranking: fusion, then how many are fetched."""
    return _staged(spark, sf_dir, _STAGES_OFF)
