"""Queries on lookups, accounts, calendars, page regions, run comparison and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators import comparison as C
from ..operators import lookup as K
from ..operators import ordered as O
from .registry import query, table


@query("SELECT p_partkey, list_filter(['yellow', 'green', 'black', 'blue', 'red', 'al', 'an', 'e'], lambda x: contains(lower(p_name), x))[1] AS best FROM part")
def longest_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest configured key in a name."""
    keys = ["red", "blue", "green", "black", "yellow", "e", "an", "al"]
    return table(spark, sf_dir, "part").select("p_partkey", K.longest_key(F.lower("p_name"), keys).alias("best"))


@query("""SELECT c_custkey, CASE WHEN trim(c_mktsegment) = '' THEN NULL WHEN contains(c_mktsegment, 'AUTO') OR contains('AUTO', c_mktsegment) THEN 'vehicle'
WHEN contains(c_mktsegment, 'HOUSEHOLD GOODS') OR contains('HOUSEHOLD GOODS', c_mktsegment) OR contains(c_mktsegment, 'FURN') OR contains('FURN', c_mktsegment) THEN 'home'
WHEN contains(c_mktsegment, 'MACHINE') OR contains('MACHINE', c_mktsegment) THEN 'plant' END AS kind FROM customer""")
def alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first kind one of whose aliases holds the name, or is held by it."""
    kinds = [("vehicle", ["AUTO"]), ("home", ["HOUSEHOLD GOODS", "FURN"]), ("plant", ["MACHINE"])]
    return table(spark, sf_dir, "customer").select("c_custkey", K.first_alias(F.col("c_mktsegment"), kinds).alias("kind"))


@query("SELECT c_custkey, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS deletable FROM customer")
def restrict_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that nothing refers to, so that they may go."""
    facts = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return K.unreferenced(table(spark, sf_dir, "customer"), "c_custkey", facts, "o_custkey").select("c_custkey", "deletable")


@query("""WITH p AS (SELECT *, unnest(range(l_linenumber, l_linenumber + l_linenumber % 3 + 1)) AS page FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, CAST(page AS INT) AS page, CASE WHEN page = l_linenumber THEN l_quantity ELSE 0 END AS y0, CASE WHEN page = l_linenumber + l_linenumber % 3 THEN 51 - l_quantity ELSE 51 END AS y1 FROM p)
SELECT * FROM f WHERE y1 > y0""")
def region_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions cut at page ends."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linenumber").alias("start_page"), F.col("l_quantity").alias("start_y"),
        (F.col("l_linenumber") + F.col("l_linenumber") % 3).alias("stop_page"), (51 - F.col("l_quantity")).alias("stop_y"),
    )
    return K.page_fragments(li, F.lit(51.0)).select("l_orderkey", "l_linenumber", "page", "y0", "y1")


@query("SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_extendedprice, l_linenumber, l_returnflag) AS marks FROM lineitem GROUP BY l_orderkey")
def reordered_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters put in the order of their place."""
    items = F.collect_list(F.struct("l_extendedprice", "l_linenumber", "l_returnflag"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(K.in_order(items, "l_returnflag").alias("marks"))


@query("""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT conv_id, md5(string_agg(r || '. ' || substr(text, 1, 300), chr(10) ORDER BY r)) AS digest FROM t WHERE r <= 3 GROUP BY conv_id""")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three turns as numbered lines of at most 300 characters."""
    t = O.latest(table(spark, sf_dir, "conversations"), ["conv_id"], [F.asc("turn")], 3)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"])
    return t.groupBy("conv_id").agg(texts.alias("t")).select("conv_id", F.md5(K.numbered(F.col("t"), 3, 300)).alias("digest"))


@query("""SELECT state, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'forced'
WHEN o_orderdate IS NULL OR TIMESTAMP '1997-06-01' >= o_orderdate + INTERVAL 90 DAY THEN 'expired' ELSE 'valid' END AS state FROM orders) GROUP BY state""")
def password_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts by the state of their password on a stated day."""
    as_of = F.lit("1997-06-01").cast("timestamp_ntz")
    state = A.password_state(F.col("o_orderdate"), F.col("o_orderpriority") == "1-URGENT", as_of)
    return table(spark, sf_dir, "orders").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended_by FROM events WHERE event_type = 'signup'")
def single_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new login ends the user's session before it."""
    logins = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return A.single_sessions(logins, "user_id", [F.col("ts"), F.col("event_id")], "event_id").select("event_id", "user_id", "ended_by")


@query("""WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders WHERE o_orderdate IS NOT NULL),
g AS (SELECT month, month - CAST(dayofweek(month) AS INT) AS first_cell, last_day(month) + CAST(6 - dayofweek(last_day(month)) AS INT) AS last_cell FROM m)
SELECT month, first_cell, last_cell, CAST(date_diff('day', first_cell, last_cell) + 1 AS INT) AS cells FROM g""")
def month_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar cells of each month with an item."""
    months = table(spark, sf_dir, "orders").where("o_orderdate is not null").select(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")).distinct()
    grid = months.select("month", A.month_grid(F.col("month")).alias("g"))
    return grid.select("month", F.get("g", F.lit(0)).alias("first_cell"), F.element_at("g", -1).alias("last_cell"), F.size("g").alias("cells"))


@query("""WITH t AS (SELECT conv_id, max(turn) AS top FROM conversations WHERE turn < 2 GROUP BY conv_id), n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE turn >= 2)
SELECT n.conv_id, n.turn, n.conv_id || '-aug' || (coalesce(top, 0) + r) AS variant_id FROM n LEFT JOIN t USING (conv_id)""")
def free_variant_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of new variants that collide with no old one."""
    c = table(spark, sf_dir, "conversations")
    taken = c.where("turn < 2").select("conv_id", F.col("turn").alias("k"))
    return A.variant_ids(c.where("turn >= 2").select("conv_id", "turn"), taken, "conv_id", [F.col("turn")])


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('click', 'view')),
f AS (SELECT user_id, event_type, CAST(min(r) AS BIGINT) AS r FROM e WHERE value > 120 GROUP BY user_id, event_type),
j AS (SELECT user_id, a.r AS before, b.r AS after FROM (SELECT * FROM f WHERE event_type = 'click') a FULL JOIN (SELECT * FROM f WHERE event_type = 'view') b USING (user_id))
SELECT user_id, before, after, CASE WHEN before IS NULL THEN 'recovered' WHEN after IS NULL THEN 'regressed' WHEN after < before THEN 'better' ELSE 'worse' END AS change FROM j WHERE before IS DISTINCT FROM after""")
def run_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose first hit stands at another rank in the second run, with what was recovered and lost."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    first = e.withColumn("r", nth).where("value > 120").groupBy("user_id", "event_type").agg(F.min("r").cast("long").alias("rank"))
    return C.run_diff(first.where("event_type = 'click'"), first.where("event_type = 'view'"), "user_id")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE quality = 1 - toxic) AS BIGINT) AS agreed, round(count(*) FILTER (WHERE quality = 1 - toxic) / count(*)::DOUBLE, 6) AS rate FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two judgements agree."""
    return C.agreement(table(spark, sf_dir, "labels"), F.col("quality"), 1 - F.col("toxic"))


@query("""WITH a AS (SELECT l_returnflag, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS f, avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(f, 6) AS mean_off, round(o, 6) AS mean_on, round(o - f, 6) AS delta FROM a""")
def on_off_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means without and with something, side by side."""
    return C.on_off(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "F", "O", "l_quantity")


@query("""WITH c AS (SELECT conv_id, coalesce(sum(length(text)) FILTER (WHERE role <> 'assistant'), 0) AS i, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS o FROM conversations GROUP BY conv_id),
t AS (SELECT count(*) AS n, CAST(sum(i) AS BIGINT) AS i, CAST(sum(o) AS BIGINT) AS o FROM c), p AS (SELECT model, n, i, o, (i * a + o * b) / 1e6::DOUBLE AS cost FROM t, (VALUES ('large', 2.5::DOUBLE, 10::DOUBLE), ('small', 2::DOUBLE, 8::DOUBLE)) v(model, a, b))
SELECT model, CAST(n AS BIGINT) AS n, i AS tokens_in, o AS tokens_out, round(cost, 6) AS cost, round(cost / n, 9) AS per_call, round(cost / n * 10000, 5) AS per_10k FROM p""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the conversations cost by model, at stated prices; a character counts as a token."""
    n, said = F.length("text").cast("long"), F.col("role") == "assistant"
    calls = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.when(said, F.lit(0)).otherwise(n)).alias("tokens_in"), F.sum(F.when(said, n).otherwise(0)).alias("tokens_out"))
    return C.costs(calls, [("large", 2.5, 10.0), ("small", 2.0, 8.0)])


@query("""WITH c AS (SELECT lang, length(text) - length(regexp_replace(text, '[A-Za-z]+', '', 'g')) AS g, length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]+', '', 'g')) AS b FROM documents)
SELECT lang, CAST(sum(g) AS BIGINT) AS good, CAST(sum(b) AS BIGINT) AS broken, round(sum(g)::DOUBLE / nullif(sum(g) + sum(b), 0), 6) AS ratio FROM c GROUP BY lang""")
def glyph_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of plain letters among those and the characters beyond ASCII."""
    good, broken = C.class_counts(F.col("text"), "A-Za-z", r"^\x00-\x7F")
    out = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(good.cast("long")).alias("good"), F.sum(broken.cast("long")).alias("broken"))
    return out.withColumn("ratio", F.round(F.try_divide(F.col("good"), F.col("good") + F.col("broken")), 6))


@query("""WITH f AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds FROM f WHERE r = 1 GROUP BY user_id""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different kinds of each user in the order they came; only the first of each is gathered."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))
