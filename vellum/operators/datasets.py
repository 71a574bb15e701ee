"""Training sets: splits, unique ids, chat records, masks, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .ordered import running_sum


def digest(id_: Column, seed: int) -> Column:
    """A text that orders ids at random, the same in every run and every system: the MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")))


def hash_number(id_: Column, seed: int) -> Column:
    """The first 60 bits of the digest as a number."""
    return F.conv(F.substring(digest(id_, seed), 1, 15), 16, 10).cast("bigint")


def hash_order(id_col: str, seed: int) -> list[Column]:
    """A shuffled order that is the same in every run."""
    return [digest(F.col(id_col), seed), F.col(id_col)]


def stratified_split(df: DataFrame, label: str, id_col: str, share: float = 0.3, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """``split``: of each label ``max(1, round(share * n))`` rows to ``valid``, halves rounded to even.

    Rows are ranked in hash order. Labels are few, so a rank over a whole label would be one task; counts of
    ``buckets`` ranges of the hash give each range's offset, and rows are ranked within their range only.
    """
    own = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(id_col))).withColumn("__b", F.pmod("__h", F.lit(buckets)))
    counts = own.groupBy(label, "__b").agg(F.count("*").alias("__n"))  # labels * buckets rows
    w = Window.partitionBy(label)
    ahead = F.sum("__n").over(w.orderBy("__b")) - F.col("__n")
    offsets = counts.select(F.col(label).alias("__l"), F.col("__b").alias("__k"), ahead.alias("__ahead"), F.sum("__n").over(w).alias("__all"))
    nth = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", id_col))
    ranked = own.withColumn("__nth", nth).join(offsets, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__k")))
    n = F.greatest(F.lit(1), F.bround(F.col("__all") * share))
    return ranked.withColumn("split", F.when(F.col("__ahead") + F.col("__nth") <= n, "valid").otherwise("train")).select(*df.columns, "split")


def unique_ids(df: DataFrame, id_col: str, order: list[Column]) -> DataFrame:
    """Ids that repeat get ``#1``, ``#2`` and so on."""
    w = Window.partitionBy(id_col)
    many, nth = F.count("*").over(w) > 1, F.row_number().over(w.orderBy(*order))
    return df.withColumn("unique_id", F.when(many, F.concat_ws("#", F.col(id_col).cast("string"), nth)).otherwise(F.col(id_col).cast("string")))


def chat_records(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """One row for each conversation with its messages in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(turn), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(key).agg(F.transform(items, lambda x: F.struct(x["role"], x["content"])).alias("messages"))


def masked_labels(prompt_ids: Column, target_ids: Column, limit: int) -> Column:
    """Label ids of an example: -100 for the prompt's, cut at a length."""
    return F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), target_ids), 1, limit)


def triage(accept: Column, drop: Column) -> Column:
    """accept, drop, or review where nothing is known."""
    return F.when(drop, "drop").when(accept, "accept").otherwise("review")


def reject_reason(*gates: tuple[Column, str]) -> Column:
    """The name of the first gate that an example fails; null if it passes all."""
    out = F.lit(None).cast("string")
    for fails, name in reversed(gates):
        out = F.when(fails, name).otherwise(out)
    return out


def sample_distractors(present: DataFrame, pool: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``example_id, item_id, nth``: for each ``(example_id, group)`` the next ``n`` pool items of its group on a ring that it doesn't hold.

    ``present(example_id, group, item_id)``, ``pool(item_id, group)``, an item once in a group. Items and examples stand on a ring by
    the digests of their ids; an example takes the items behind it, on from the ring's start where it ends. Items are numbered
    along the ring (``running_sum``, no task sees a whole group), so an example meets ``n`` items and as many as it holds, each
    by its number. It gets fewer only where its group has no more.
    """
    scratch = Scratch(pool.sparkSession, "distractors")
    held = present.groupBy("example_id", "group").agg(F.count_distinct("item_id").alias("held"))
    kind = dict(pool.dtypes)["item_id"]
    items = pool.select("group", digest(F.col("item_id"), seed).alias("at"), F.lit(1).alias("is_item"), "item_id", F.lit(None).cast(dict(held.dtypes)["example_id"]).alias("example_id"), F.lit(None).cast("long").alias("held"))
    asked = held.select("group", digest(F.col("example_id"), seed).alias("at"), F.lit(0).alias("is_item"), F.lit(None).cast(kind).alias("item_id"), "example_id", "held")
    ring = scratch.cut(running_sum(items.unionByName(asked), ["group"], ["at", "is_item", "item_id", "example_id"], F.col("is_item"), "place", scratch), "ring")
    numbered = ring.where("is_item = 1").select(F.col("group").alias("g"), (F.col("place") - 1).alias("number"), "item_id")
    sizes = ring.groupBy("group").agg(F.sum("is_item").alias("m")).where("m > 0").select(F.col("group").alias("g"), "m")
    wants = ring.where("is_item = 0").join(sizes, F.col("group").eqNullSafe(F.col("g"))).drop("g")
    steps = F.sequence(F.lit(0).cast("long"), F.least(F.col("m"), F.col("held") + n) - 1)
    each = wants.select("example_id", "group", "place", "m", F.explode(steps).alias("step")).withColumn("wanted", (F.col("place") + F.col("step")) % F.col("m"))
    met = each.join(numbered, F.col("group").eqNullSafe(F.col("g")) & (F.col("wanted") == F.col("number")))
    free = met.join(present.select("example_id", "item_id").distinct(), ["example_id", "item_id"], "left_anti")
    w = Window.partitionBy("example_id", "group").orderBy("step")
    return free.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("example_id", "item_id", "nth")


# Numbers with a unit, and ratios that aren't part of a dotted date.
UNIT_NUMBER, RATIO = r"(?U)\d+\s*(?:일|개월|%|퍼센트|년|월|점|배|명)", r"(?U)(?<!\.)\d+\s*/\s*\d+"


def unit_numbers(s: Column) -> Column:
    """Distinct numbers with a unit and ratios of a text."""
    text = F.coalesce(s, F.lit(""))
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), 0) for p in (UNIT_NUMBER, RATIO))))


def unwrap_array(text: Column, element: str) -> Column:
    """A JSON list, else the first list among an object's values, else the object itself in a list; empty for no text."""
    values = F.map_values(F.from_json(text, "map<string,string>"))
    inner = F.get(F.filter(values, lambda v: F.ltrim(v).startswith("[")), F.lit(0))
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<{element}>")).when(inner.isNotNull(), F.from_json(inner, f"array<{element}>"))
    alone = F.when(F.ltrim(text).startswith("{") & inner.isNull(), F.array(F.from_json(text, element)))
    return F.coalesce(listed, alone, F.array().cast(f"array<{element}>"))


def eval_map(lines: Column) -> Column:
    """``feature: verdict — reason`` lines as a map from feature to verdict; of a feature given twice the last counts."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    own = F.filter(lines, lambda x: x.contains(":"))
    feature = lambda x: trim(F.split_part(x, F.lit(":"), F.lit(1)))
    verdict = lambda x: trim(F.split_part(F.substring(x, F.instr(x, ":") + 1, F.length(x)), F.lit("—"), F.lit(1)))
    pairs = F.transform(own, lambda x: F.struct(feature(x).alias("k"), verdict(x).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def eval_reason(line: Column) -> Column:
    """What stands behind the first dash; empty without one."""
    at = F.instr(line, "—")
    return F.when(at > 0, F.trim(F.substring(line, at + 1, F.length(line)))).otherwise("")


def point_id(key: Column) -> Column:
    """A non-negative number for a text id, the same in every run."""
    return hash_number(key, 0)


def share_split(df: DataFrame, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """``split``: each row by a hash of its id, ``share`` of them to ``train`` in the mean, the rest to ``valid``; no row looks at another."""
    part = F.pmod(hash_number(F.col(id_col), seed), F.lit(1_000_000)) < round(share * 1_000_000)
    return df.withColumn("split", F.when(part, "train").otherwise("valid"))


def field_accuracy(df: DataFrame, negative: list[str], fields: list[str], required: list[str]) -> DataFrame:
    """One row of rates: fields right where a negative verdict was right, evidence hit, all required fields present.

    Columns are ``gold_x`` and ``pred_x``. Evidence is hit if one of the gold tokens is in the prediction; gold without
    evidence (null, empty or a dash) doesn't count.
    """
    right = F.col("gold_verdict").isin(negative) & F.coalesce(F.col("pred_verdict") == F.col("gold_verdict"), F.lit(False))
    rate = lambda ok: F.round(F.avg(ok.cast("double")), 6)
    has = F.coalesce(F.col("gold_basis"), F.lit("")) != ""
    has = has & (F.col("gold_basis") != "-")
    tokens = F.filter(F.split("gold_basis", r"(?U)[,\s]+"), lambda t: t != "")
    hit = F.exists(tokens, lambda t: F.coalesce(F.col("pred_basis"), F.lit("")).contains(t))
    whole = F.lit(True)
    for f in required:
        whole = whole & F.col(f"pred_{f}").isNotNull()
    aggs = [F.count_if(right).alias("n_right"), *(rate(F.when(right, F.col(f"gold_{f}").eqNullSafe(F.col(f"pred_{f}")))).alias(f"{f}_accuracy") for f in fields)]
    return df.agg(*aggs, F.count_if(has).alias("n_evidence"), rate(F.when(has, hit)).alias("evidence_rate"), rate(whole).alias("format_rate"))


def length_limits(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """The longest example and how many are over a limit."""
    return df.agg(F.max(size).alias("longest"), F.count_if(size > limit).alias("n_over"))


def best_checkpoint(df: DataFrame, step: str, loss: str) -> DataFrame:
    """The step with the least loss, the first of equal ones."""
    return df.agg(F.min_by(F.col(step), F.struct(loss, step)).alias("best_step"), F.min(loss).alias("best_loss"))


def synthetic_queries(chunks: DataFrame, templates: list[str], n: int, least: int = 80, front: int = 120, seed: int = 42) -> DataFrame:
    """``query_id, query, relevant``: ``n`` texts of ``least`` characters or more in hash order, each asked for by a template and its front.

    The template goes by the id's hash too. The first ``n`` of an order is a limit, planned without sorting everything.
    """
    names = F.array(*map(F.lit, templates))
    own = chunks.where(F.length("text") >= least).select("chunk_id", F.get(names, F.pmod(hash_number(F.col("chunk_id"), seed + 1), F.lit(len(templates))).cast("int")).alias("t"), F.substring("text", 1, front).alias("f"))
    picked = own.orderBy(*hash_order("chunk_id", seed)).limit(n)
    nth = F.row_number().over(Window.orderBy(*hash_order("chunk_id", seed)))  # n rows
    return picked.select(F.format_string("eval_%03d", nth).alias("query_id"), F.concat("t", F.lit("\n\n"), "f").alias("query"), F.col("chunk_id").alias("relevant"))


def judge_batches(df: DataFrame, id_col: str, fields: list[str], n: int) -> DataFrame:
    """``batch, id, payload``: only the named fields as JSON (never the label), in batches of ``n`` in order of the id.

    Rows are numbered by ranges of the id: counts of the ranges first, then places within each, so no task sees all rows.
    """
    own = df.select(id_col, F.to_json(F.struct(*fields)).alias("payload")).withColumn("__r", F.floor(F.col(id_col) / F.lit(10_000)))
    counts = own.groupBy("__r").agg(F.count("*").alias("__n"))
    ahead = counts.select("__r", (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__ahead"))  # a row for each range
    nth = F.row_number().over(Window.partitionBy("__r").orderBy(id_col)) - 1 + F.col("__ahead")
    return own.join(ahead, "__r").select(F.floor(nth / n).alias("batch"), id_col, "payload")


# The fields of a judge's answer.
VERDICT_FIELDS = "struct<id: string, `판정`: string, `이유`: string>"


def judged(answers: DataFrame, asked: DataFrame, valid: list[str]) -> tuple[DataFrame, DataFrame]:
    """``id, verdict, reason`` of the answers that count, and the asked ids ``(id)`` that have none.

    ``answers(batch, raw)`` holds JSON as a judge gave it (a list, an object with a list, or one item; broken text counts as
    nothing), ``asked(id)`` the ids. An item counts if it has an asked id and a valid verdict; of several for an id the last
    one in order of batch and place.
    """
    items = answers.select("batch", F.posexplode(unwrap_array(F.coalesce("raw", F.lit("")), VERDICT_FIELDS)).alias("k", "x")).select("batch", "k", F.col("x.id").alias("id"), F.col("x.판정").alias("verdict"), F.coalesce("x.이유", F.lit("")).alias("reason"))
    ids = asked.select(F.col("id").cast("string").alias("id")).distinct()
    met = items.where(F.col("verdict").isin(valid)).join(ids, "id", "left_semi")
    kept = met.groupBy("id").agg(F.max_by(F.struct("verdict", "reason"), F.struct("batch", "k")).alias("x")).select("id", "x.*")
    return kept, ids.join(kept.select("id"), "id", "left_anti")


def better_judge(kappas: DataFrame) -> DataFrame:
    """``task, winner``: the judge with the higher agreement (null counts as 0), of equal ones the first; ``kappas(task, ord, judge, kappa)``."""
    key = F.struct(F.coalesce("kappa", F.lit(0.0)), -F.col("ord"))
    return kappas.groupBy("task").agg(F.max_by("judge", key).alias("winner"))


def filled_targets(variants: DataFrame, targets: DataFrame, order: list[str]) -> DataFrame:
    """Variants accepted for each label: those that pass, in order, up to the target, among the first ``target * over`` generated.

    ``variants(label, ok, ...)``, ``targets(label, target, over)``; ``order`` tells all rows of a label apart. Labels are few, so
    rows are numbered by ranges of the order, no label in one task.
    """
    scratch = Scratch(variants.sparkSession, "targets")
    made = running_sum(variants, ["label"], order, F.lit(1), "__made", scratch).join(targets, "label")
    own = made.where(F.col("__made") <= F.floor(F.col("target") * F.col("over"))).where("ok").select(*variants.columns, "target")
    kept = running_sum(own, ["label"], order, F.lit(1), "nth", scratch)
    return kept.where(F.col("nth") <= F.col("target")).select(*variants.columns, F.col("nth").cast("int").alias("nth"))


def inject_texts(refs: DataFrame, chunks: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """References ``(key, k, chunk_id)`` gathered for each record with the chunks' texts in order; a missing chunk gives a null text."""
    text = F.col("text") if cap is None else F.substring("text", 1, cap)
    met = refs.join(chunks.select("chunk_id", text.alias("text")), "chunk_id", "left")
    items = F.array_sort(F.collect_list(F.struct("k", "chunk_id", "text")))
    return met.groupBy(key).agg(F.transform(items, lambda x: F.struct(x["chunk_id"], x["text"])).alias("refs"))


def invalidated(results: DataFrame, uploads: DataFrame, entity: str, version: str) -> DataFrame:
    """Results without those made from an older version of their entity than the last upload."""
    last = uploads.groupBy(entity).agg(F.max(version).alias("__last"))
    met = results.join(last, entity, "left")
    return met.where(F.col("__last").isNull() | (F.col(version) >= F.col("__last"))).select(*results.columns)


def text_to_key(df: DataFrame, text: str, order: str, prefix: str = "ORG") -> tuple[DataFrame, DataFrame]:
    """A table of the distinct texts ``(code, name)``, coded in the order they first came, and the rows with their ``code`` (null for blank texts)."""
    name = F.trim(F.coalesce(text, F.lit("")))
    first = df.where(name != "").groupBy(name.alias("name")).agg(F.min(order).alias("at"))
    nth = F.row_number().over(Window.orderBy("at", "name"))  # a row for each distinct text
    names = first.select(F.concat(F.lit(prefix), F.lpad(nth.cast("string"), 3, "0")).alias("code"), "name")
    return names, df.join(names.withColumnRenamed("name", "__name"), name == F.col("__name"), "left").drop("__name")


def settled_status(status: Column, finished: Column) -> Column:
    """Idle rows that have a result are done."""
    return F.when((status == "idle") & finished, "done").otherwise(status)


# Verdicts that a variant may have, and the feature that is never left to review.
VALID, EXACTNESS, TO_REVIEW = ("충족", "불가", "검토"), "정확성", "검토"


def variant_reason(label: Column, old_label: Column, criteria: Column, old_criteria: Column, evals: Column, old_evals: Column | None = None, excerpt: Column | None = None) -> Column:
    """Why a variant of a seed is refused; null if it passes.

    Its label must be valid and the seed's, its criteria the seed's, its judgements (``feature: verdict — reason``) there and of
    criteria only, exactness never left to review. With the seed's judgements given, verdicts must agree feature by feature;
    with an excerpt, numbers in reasons must occur in it.
    """
    feature = lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(1)))
    outside = F.get(F.filter(F.transform(evals, feature), lambda f: ~F.array_contains(criteria, f)), F.lit(0))
    unsure = F.exists(evals, lambda x: (feature(x) == EXACTNESS) & F.split_part(x, F.lit("—"), F.lit(1)).contains(TO_REVIEW))
    gates = [
        (~F.coalesce(label.isin(*VALID), F.lit(False)), F.lit("label")), (label != old_label, F.lit("label_changed")), (F.array_sort(criteria) != F.array_sort(old_criteria), F.lit("criteria_changed")),
        (F.coalesce(F.size(evals), F.lit(0)) <= 0, F.lit("no_judgements")), (outside.isNotNull(), F.concat(F.lit("outside:"), outside)), (unsure, F.lit("exactness_to_review")),
    ]
    if old_evals is not None:
        pairs = lambda e: F.array_sort(F.map_entries(eval_map(e)))
        gates.append((pairs(evals) != pairs(old_evals), F.lit("verdicts_differ")))
    if excerpt is not None:
        loose = F.array_except(F.flatten(F.transform(evals, lambda x: unit_numbers(eval_reason(x)))), unit_numbers(excerpt))
        gates.append((F.size(loose) > 0, F.lit("ungrounded_number")))
    out = F.lit(None).cast("string")
    for fails, name in reversed(gates):
        out = F.when(fails, name).otherwise(out)
    return out
