"""Hybrid retrieval: top-k arms, rank fusion, filters, cascades and reference expansion.

Results are long tables ``(query_id, chunk_id, score, rank)``. Every ranking
has a tie-breaker, so results don't depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .nearest import nearest
from .postings import searched
from .quantiles import exact_quantiles


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def top_k(scored: DataFrame, k: int, by: Column | None = None, key: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows of each query with their ``rank``; planned as a window group limit."""
    order = [F.desc("score") if by is None else by, F.asc(tie)]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def cosine_arm(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Exact cosine search: the ``k`` best of all of the corpus for each query."""
    return nearest(queries, corpus, "cosine", k, digits=digits)


def euclidean_arm(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The same by negative squared distance."""
    return nearest(queries, corpus, "euclidean", k, digits=digits)


def pair_scores(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, how: str, digits: int = 6) -> DataFrame:
    """``query_id, chunk_id, score`` of given pairs by their vectors."""
    met = pairs.select("query_id", "chunk_id").join(queries.select("query_id", "qvec"), "query_id").join(corpus.select("chunk_id", "vec"), "chunk_id")
    if how == "cosine":
        score = F.try_divide(dot(F.col("qvec"), F.col("vec")), norm(F.col("qvec")) * norm(F.col("vec")))
    else:
        score = -F.aggregate(F.zip_with("qvec", "vec", lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0)), F.lit(0.0), lambda s, x: s + x)
    return met.select("query_id", "chunk_id", F.round(score, digits).alias("score"))


def rrf(dense: DataFrame, sparse: DataFrame, alpha: float = 0.7, rrf_k: int = 20, digits: int = 9) -> DataFrame:
    """Weighted reciprocal rank fusion as a full outer join.

    A row that one arm alone has gets, for the other arm, the rank after the
    last of the arm that has it.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    both = dense.select("query_id", "chunk_id", F.col("rank").alias("rd"), n.alias("nd")).join(
        sparse.select("query_id", "chunk_id", F.col("rank").alias("rs"), n.alias("ns")), ["query_id", "chunk_id"], "full_outer"
    )
    rd, rs = F.coalesce("rd", F.col("ns") + 1), F.coalesce("rs", F.col("nd") + 1)
    fused = F.round(F.lit(alpha) / (rrf_k + rd) + F.lit(1 - alpha) / (rrf_k + rs), digits)
    return both.select("query_id", "chunk_id", fused.alias("score"))


def min_score(ranked: DataFrame, least: float, k: int) -> DataFrame:
    """Rows at ``least`` or better, or the best ``k`` of a query where none is; ``k`` at most either way."""
    w = Window.partitionBy("query_id")
    passing = F.col("score") >= least
    kept = ranked.withColumn("any_pass", F.max(passing).over(w)).where(passing | ~F.col("any_pass"))
    return top_k(kept.drop("rank", "any_pass"), k)


def cascade(children: DataFrame, parents: DataFrame, parent_of: Column, k: int) -> DataFrame:
    """The best children among those of the parents found for the query."""
    own = children.withColumn("parent_id", parent_of)
    met = own.join(parents.select("query_id", F.col("chunk_id").alias("parent_id")), ["query_id", "parent_id"], "left_semi")
    return top_k(met.drop("rank"), k)


def expand_references(found: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop along ``edges(src, dst)``: new chunks with the best score of those that refer to them; ``is_cross_ref`` tells them."""
    hop = found.join(edges, found["chunk_id"] == edges["src"]).groupBy("query_id", F.col("dst").alias("chunk_id")).agg(F.max("score").alias("score"))
    new = hop.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return found.select("query_id", "chunk_id", "score", F.lit(False).alias("is_cross_ref")).unionByName(new.withColumn("is_cross_ref", F.lit(True)))


def fetch_parents(found: DataFrame, parents: DataFrame, parent_id: Column) -> DataFrame:
    """Text of the ancestor in place of the child's, which stays where the ancestor is missing. ``parents(parent_id, parent_text)``."""
    own = found.withColumn("parent_id", parent_id).join(parents, "parent_id", "left")
    return own.withColumn("text", F.coalesce("parent_text", "text")).withColumn("is_parent", F.col("parent_text").isNotNull()).drop("parent_text")


def ancestor_id(chunk_id: Column, long_prefix: str = "PYG") -> Column:
    """The article's id in front of a sub-article's: four tokens, five under one prefix."""
    tokens = F.split(chunk_id, "_")
    return F.array_join(F.slice(tokens, 1, F.when(F.element_at(tokens, 1) == long_prefix, 5).otherwise(4)), "_")


def budget_fold(items: Column, budget: int, used: Column) -> Column:
    """Keys of an ordered array of ``(key, size)`` that fit a budget; one that doesn't is skipped and later ones still tried."""
    start = F.struct(used.cast("long").alias("used"), F.array().cast("array<bigint>").alias("keys"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["size"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.array_append(acc["keys"], x["key"])).otherwise(acc["keys"]).alias("keys"),
        )

    return F.aggregate(items, start, step)


def judge(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """``ranked`` with ``hit``, and queries without any result as rows of nulls. ``relevant(query_id, chunk_id)``."""
    return ranked.join(relevant.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def ir_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query: any-hit recall and full coverage at each k, reciprocal rank, nDCG and average precision at the largest k."""
    top = max(ks)
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    judged = judge(ranked, relevant).where(F.col("rank") <= top)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("seen", F.sum("hit").over(w))
    hit = F.col("hit") == 1
    aggs = [F.min(F.when(hit, F.col("rank"))).alias("first")]
    aggs += [F.count_if(hit & (F.col("rank") <= k)).alias(f"hits_{k}") for k in ks]
    aggs += [F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum(F.when(hit, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap")]
    per = n.join(judged.groupBy("query_id").agg(*aggs), "query_id", "left").na.fill(0, [f"hits_{k}" for k in ks]).na.fill(0.0, ["dcg", "ap"])
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least("n_relevant", F.lit(top)).cast("int")), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    out = [F.col("query_id"), F.col("n_relevant")]
    out += [(F.col(f"hits_{k}") > 0).cast("int").alias(f"recall_{k}") for k in ks]
    out += [(F.col(f"hits_{k}") >= F.col("n_relevant")).cast("int").alias(f"coverage_{k}") for k in ks]
    out += [F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.col("dcg") / ideal, 6).alias(f"ndcg_{top}"), F.round(F.col("ap") / F.least("n_relevant", F.lit(top)), 6).alias(f"ap_{top}")]
    return per.select(*out)


def error_type(rank: Column, top: int, same_group: Column, in_candidates: Column) -> Column:
    """Why a query missed: right, pushed down, confused with another group, or lost."""
    return F.when(rank <= top, "correct").when(in_candidates, "pushed_down").when(~same_group, "wrong_group").otherwise("lost")


def word_containment(docs: DataFrame, items: DataFrame, doc: str, item: str, least: float) -> DataFrame:
    """``doc, item, score``: the part of an item's words that a document holds, where that is ``least`` (above 0) or more.

    Both sides are ``(id, word)``, each word once. An item with ``m`` words must share one of its rarest
    ``m - ceil(least * m) + 1`` with such a document, so only those (as counted in the documents) open a pair, and frequent
    words open hardly any; all its words are then counted for the pairs found. The documents' words are never broadcast: their
    file is small, as it holds few different words, their rows are not.
    """
    scratch = Scratch(docs.sparkSession, "words")
    docs = scratch.cut(docs.join(items.select("word").distinct(), "word", "left_semi"), "docs").hint("merge")  # read three times
    counts = docs.groupBy("word").agg(F.count("*").alias("df"))
    w = Window.partitionBy(item)
    ranked = items.join(counts, "word", "left").withColumn("m", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.coalesce("df", F.lit(0)), "word")))
    first = ranked.where(F.col("nth") <= F.col("m") - F.ceil(F.col("m") * least - F.lit(1e-9)) + 1).select(item, "word")
    pairs = docs.join(first, "word").select(doc, item).distinct()
    met = pairs.join(ranked.where("df is not null").select(item, "word", "m"), item).join(docs, [doc, "word"])
    out = met.groupBy(doc, item).agg((F.count("*") / F.max("m")).alias("score"))
    return out.where(F.round("score", 6) >= least).select(doc, item, F.round("score", 6).alias("score"))


def rerank(candidates: DataFrame, scores: DataFrame, rerank_k: int, scope: str = "first") -> DataFrame:
    """Candidates ordered anew by ``scores(query_id, chunk_id, rerank_score)``, of which a model or a fixed rule is the source.

    ``first`` scores only the ``rerank_k`` best candidates; ``all`` scores all of them and keeps the ``rerank_k`` best after
    that. Candidates without a score come last. Both scores stay: ``score`` is the new one, ``fused_score`` the old.
    """
    own = top_k(candidates.select("query_id", "chunk_id", "score"), rerank_k) if scope == "first" else candidates
    met = own.select("query_id", "chunk_id", F.col("score").alias("fused_score")).join(scores, ["query_id", "chunk_id"], "left")
    return top_k(met.withColumnRenamed("rerank_score", "score"), rerank_k, F.desc_nulls_last("score"))


def search_articles(dense: DataFrame, sparse: DataFrame, scores: DataFrame, fetch_k: int = 50, rerank_k: int = 10, top: int = 2, least: float | None = None, alpha: float = 0.7, rrf_k: int = 20) -> DataFrame:
    """Fused, cut to ``fetch_k``, reranked, filtered by a least score (or the best where none passes), cut to ``top``."""
    fused = top_k(rrf(dense, sparse, alpha, rrf_k), fetch_k)
    ranked = rerank(fused.drop("rank"), scores, rerank_k)
    return min_score(ranked, least, top) if least is not None else ranked.where(F.col("rank") <= top)


def search_items(fused: DataFrame, edges: DataFrame, parent_of: DataFrame, parents: DataFrame, budget: int, top: int) -> DataFrame:
    """Items found, expanded along references, and replaced by their articles: ``query_id, parent_id, score, is_cross_ref, size, rank``.

    ``parent_of(chunk_id, parent_id)``, ``parents(parent_id, size)``. Of an article found more than once the best counts, one found
    directly before one that is only referred to. Articles found directly always stay and use up the budget first; the others
    are taken in order of score as long as they fit, ones that don't are passed over.
    """
    every = expand_references(fused, edges).join(parent_of, "chunk_id").join(parents, "parent_id")
    best = every.groupBy("query_id", "parent_id", "size").agg(F.min("is_cross_ref").alias("is_cross_ref"), F.max_by("score", F.struct(~F.col("is_cross_ref"), "score")).alias("score"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("parent_id").alias("key"), F.col("size").cast("long").alias("size"), "is_cross_ref")))
    per = best.groupBy("query_id").agg(items.alias("items"))
    own, more = F.filter("items", lambda x: ~x["is_cross_ref"]), F.filter("items", lambda x: x["is_cross_ref"])
    used = F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x["size"])
    fits = budget_fold(F.transform(more, lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"))), budget, used)["keys"]
    kept = per.withColumn("fits", fits).select("query_id", F.inline(F.filter("items", lambda x: ~x["is_cross_ref"] | F.array_contains(F.col("fits"), x["key"]))))
    return top_k(kept.select("query_id", F.col("key").alias("parent_id"), (-F.col("o")).alias("score"), "is_cross_ref", "size"), top, tie="parent_id")


def stage_recall(found: DataFrame, relevant: DataFrame, parent: str) -> DataFrame:
    """``n, survived, recall``: queries of which a relevant item's parent is among the parents found in the first stage."""
    asked = relevant.select("query_id").distinct()
    hit = relevant.select("query_id", parent).distinct().join(found.select("query_id", parent), ["query_id", parent], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    met = asked.join(hit, "query_id", "left")
    return met.agg(F.count("*").alias("n"), F.count("hit").alias("survived")).withColumn("recall", F.round(F.try_divide("survived", "n"), 6))


def risk_search(ranked: DataFrame, flagged: DataFrame, least: float = 0.4, k: int = 10) -> DataFrame:
    """The ``k`` best results of each query with a flagged payload and at least a score."""
    return top_k(ranked.where(F.col("score") >= least).join(flagged.select("chunk_id"), "chunk_id", "left_semi").drop("rank"), k)


def miss_kind(first_hit: Column, wanted: Column, top_category: Column) -> Column:
    """Why a query's best result is right or not: ``correct``, ``pushed_down``, ``unknown_category``, ``wrong_law`` or ``lost``.

    ``wanted`` holds the relevant chunks' categories, nulls and blanks left out.
    """
    names = F.filter(wanted, lambda c: F.coalesce(c, F.lit("")) != "")
    blank = (F.size(names) == 0) | (F.coalesce(top_category, F.lit("")) == "")
    return F.when(first_hit == 1, "correct").when(first_hit.isNotNull(), "pushed_down").when(blank, "unknown_category").when(~F.array_contains(names, top_category), "wrong_law").otherwise("lost")


def recommended_threshold(judged: DataFrame) -> DataFrame:
    """``p10_relevant, p90_other, threshold``: halfway between the low scores of hits and the high ones of others; ``judged(score, hit)``."""
    q = exact_quantiles(judged, ["hit"], "score", (0.1, 0.9))
    t = q.agg(F.max(F.when(F.col("hit"), F.col("q")[0])).alias("a"), F.max(F.when(~F.col("hit"), F.col("q")[1])).alias("b"))
    return t.select(F.round("a", 6).alias("p10_relevant"), F.round("b", 6).alias("p90_other"), F.round((F.col("a") + F.col("b")) / 2, 6).alias("threshold"))


def sparse_arm(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Search by token weights: sums of products over shared tokens.

    ``queries(query_id, token, weight)``, ``corpus(chunk_id, token, weight)``, a token once each.
    """
    return searched(queries, corpus, k, digits)
