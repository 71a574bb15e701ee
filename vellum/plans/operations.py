"""Operational queries: dashboards, owner scope, completeness, history, streaks, sessions and deadlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ordered as O
from .registry import query, table


def _c(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS finished, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS open, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS pending FROM orders")
def dashboard_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and counts by status, in one pass."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), *(F.count_if(s == k).alias(n) for k, n in (("F", "finished"), ("O", "open"), ("P", "pending"))))


@query("SELECT n_name, c_mktsegment, CAST(count(*) FILTER (WHERE c_acctbal >= 0) AS BIGINT) AS active, CAST(count(*) FILTER (WHERE c_acctbal < 0) AS BIGINT) AS inactive FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def active_segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and inactive accounts by nation and segment."""
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.count_if(F.col("c_acctbal") >= 0).alias("active"), F.count_if(F.col("c_acctbal") < 0).alias("inactive"))


@query("SELECT o_orderkey, c_name, o_orderstatus, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 7 AND o_orderstatus IN ('O', 'P')")
def owner_scoped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one owner in some states; both predicates reach the scan."""
    o = table(spark, sf_dir, "orders").where((F.col("o_custkey") == 7) & F.col("o_orderstatus").isin("O", "P"))
    return o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderstatus", "o_totalprice")


@query("WITH r AS (SELECT unnest(['click', 'purchase', 'signup', 'view']) AS event_type), u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, event_type FROM u, r WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = r.event_type AND e.value > 30)")
def required_event_types_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required kinds that a user lacks."""
    e = table(spark, sf_dir, "events")
    need = e.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, ("click", "purchase", "signup", "view")))).alias("event_type"))
    return need.join(e.where("value > 30").select("user_id", "event_type"), ["user_id", "event_type"], "left_anti")


@query("SELECT r_name, n_name, CAST(count(s_suppkey) AS BIGINT) AS suppliers, coalesce(round(sum(s_acctbal), 2), 0) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY ALL")
def dimension_preserving_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation, with zeros where nothing matches."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = n.join(table(spark, sf_dir, "supplier").where("s_acctbal > 9000"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("r_name", "n_name").agg(F.count("s_suppkey").alias("suppliers"), F.coalesce(F.round(F.sum("s_acctbal"), 2), F.lit(0.0)).alias("balance"))


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND event_type <> 'view'")
def recent_window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last week before a stated day, without one kind."""
    return table(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-31' - interval 7 days and event_type <> 'view'").select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key."""
    return O.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, CAST(n AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def latest5_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest rows of each key."""
    return O.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "nth")


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def paged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(50)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), lower('RED'))")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive search over the joined text of a row."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return table(spark, sf_dir, "part").where(text.contains("red")).select("p_partkey", "p_name")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1999-01-01') AS live FROM customer")
def live_user_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag for accounts with a live session."""
    live = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1999-01-01'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("live", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(live, "c_custkey", "left").select("c_custkey", F.coalesce("live", F.lit(False)).alias("live"))


@query("""WITH g AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events),
s AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS streak FROM g)
SELECT event_id, user_id, CAST(streak AS BIGINT) AS streak, (event_type = 'error' AND streak = 5) AS locks FROM s WHERE event_type = 'error'""")
def error_streak_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row since the last success, and the one that locks."""
    failed, reset = F.col("event_type") == "error", F.col("event_type") == "signup"
    out = O.failure_streaks(table(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], failed, reset)
    return out.where(failed).select("event_id", "user_id", "streak", "locks")


@query("""WITH d AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM d)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY user_id, session""")
def idle_sessions_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that half an hour of silence ends."""
    s = O.idle_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 1800)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("""SELECT o_orderkey, CAST(date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) AS INT) AS days_left FROM orders
WHERE o_orderstatus = 'O' AND date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) IN (7, 3, 1)""")
def deadline_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items due in seven, three or one days of a stated day."""
    left = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1998-06-01").cast("date"))
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "O").select("o_orderkey", left.alias("days_left")).where(F.col("days_left").isin(7, 3, 1))


@query("""SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, CAST(min(o_orderkey) AS BIGINT) AS first_key, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY 1""")
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items grouped by day for a calendar."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), keys.alias("keys"))


@query("SELECT o_orderkey, coalesce(c_name, 'unknown') AS owner, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 99 END AS ord, list_extract(['red', 'blue', 'green'], CAST(o_orderkey % 3 + 1 AS BIGINT)) AS colour FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with fallbacks, a fixed order of states, a colour by id."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(99)
    colour = F.get(F.array(*map(F.lit, ("red", "blue", "green"))), F.pmod(F.col("o_orderkey"), F.lit(3)).cast("int"))
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("owner"), rank.alias("ord"), colour.alias("colour"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey IS NULL THEN 'no nation' WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'no orders'
WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'none finished' ELSE 'ready' END AS reason FROM customer""")
def precondition_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first precondition that fails."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    why = F.when(F.col("c_nationkey").isNull(), "no nation").when(F.col("done").isNull(), "no orders").when(F.col("done") == 0, "none finished").otherwise("ready")
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", why.alias("reason"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 = 0)
SELECT o.o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN round(n.o_totalprice * 2, 2) ELSE o.o_totalprice END AS price, n.o_orderkey IS NOT NULL AS changed FROM orders o LEFT JOIN n USING (o_orderkey) WHERE o.o_orderkey % 100 <> 50""")
def overlay_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections laid over a table by id, and deletions."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("new"))
    gone = o.where("o_orderkey % 100 = 50").select("o_orderkey")
    j = o.join(gone, "o_orderkey", "left_anti").join(new, "o_orderkey", "left")
    return j.select("o_orderkey", F.coalesce("new", "o_totalprice").alias("price"), F.col("new").isNotNull().alias("changed"))


@query("""WITH p AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN value END AS v, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS context FROM p""")
def forward_fill_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase so far, forgotten at each error."""
    v = F.when(F.col("event_type") == "purchase", F.col("value"))
    out = O.forward_fill(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], v, "context", F.col("event_type") == "error")
    return out.select("event_id", "context")


@query("""WITH b AS (SELECT *, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events), d AS (SELECT *, s - lag(s + value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM b),
g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600 OR event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM d)
SELECT user_id, CAST(grp AS BIGINT) AS grp, CAST(count(*) AS BIGINT) AS n, string_agg(event_type, ' ' ORDER BY ts, event_id) AS kinds FROM g GROUP BY user_id, grp""")
def gap_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups parted by a gap or by an opening row."""
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    g = O.gap_groups(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("s"), F.col("s") + F.col("value"), 3600.0, F.col("event_type") == "signup")
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), " ")
    return g.groupBy("user_id", "grp").agg(F.count("*").alias("n"), kinds.alias("kinds"))


@query("""WITH s AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'signup'), p AS (SELECT user_id, event_id AS p_id, value AS p_value FROM events WHERE event_type = 'purchase')
SELECT event_id, p_id FROM (SELECT s.event_id, p.p_id, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(s.value - p.p_value), p.p_id) AS n FROM s JOIN p USING (user_id)) WHERE n = 1""")
def nearest_value_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase nearest in value to each signup of a user."""
    e = table(spark, sf_dir, "events")
    p = e.where("event_type = 'purchase'").select("user_id", "value", F.col("event_id").alias("p_id"))
    return O.nearest_join(e.where("event_type = 'signup'").select("user_id", "value", "event_id"), p, ["user_id"], "value", "event_id", "p_id")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a FROM orders),
j AS (SELECT l.o_orderkey, r.o_orderkey AS best, least(l.a + 30, r.a + 45) - greatest(l.a, r.a) AS overlap FROM o l JOIN o r ON l.o_custkey = r.o_custkey AND l.o_orderstatus = 'O' AND r.o_orderstatus = 'F' AND l.a < r.a + 45 AND r.a < l.a + 30)
SELECT o_orderkey, best, CAST(overlap AS INT) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY overlap DESC, best) AS n FROM j) WHERE n = 1""")
def interval_overlap_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the same owner that overlaps most."""
    o = table(spark, sf_dir, "orders").withColumn("a", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")))
    left = o.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.col("a").alias("l_start"), (F.col("a") + 30).alias("l_stop"))
    right = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("best"), F.col("a").alias("r_start"), (F.col("a") + 45).alias("r_stop"))
    return O.best_overlap(left, right, ["o_custkey"], "o_orderkey", "best", 45).select("o_orderkey", "best", "overlap")


@query("""SELECT user_id, c.event_type AS next_pending FROM (SELECT user_id, r.event_type, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS n
FROM (SELECT DISTINCT user_id FROM events) u, (VALUES (1, 'signup'), (2, 'view'), (3, 'click'), (4, 'purchase')) r(ord, event_type)
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = r.event_type AND e.value > 40)) c WHERE n = 1""")
def next_pending_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step of a fixed order that isn't done."""
    e = table(spark, sf_dir, "events")
    steps = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(t).alias("event_type")) for k, t in enumerate(("signup", "view", "click", "purchase"), 1)))
    need = e.select("user_id").distinct().select("user_id", F.inline(steps))
    open_ = need.join(e.where("value > 40").select("user_id", "event_type"), ["user_id", "event_type"], "left_anti")
    return open_.groupBy("user_id").agg(F.min_by("event_type", "ord").alias("next_pending"))


@query("""WITH t AS (SELECT l_orderkey, CAST(count(DISTINCT l_returnflag) FILTER (WHERE l_quantity > 20) AS DOUBLE) / 3 AS cov FROM lineitem GROUP BY 1)
SELECT CASE WHEN cov >= 1 THEN 'satisfied' WHEN cov > 0 THEN 'partial' ELSE 'unsatisfied' END AS bucket, CAST(count(*) AS BIGINT) AS n, round(avg(cov), 6) AS mean FROM t GROUP BY 1""")
def coverage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required targets found: all, some, none."""
    cov = F.count_distinct(F.when(F.col("l_quantity") > 20, F.col("l_returnflag"))).cast("double") / 3
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(cov.alias("cov"))
    bucket = F.when(F.col("cov") >= 1, "satisfied").when(F.col("cov") > 0, "partial").otherwise("unsatisfied")
    return t.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("cov"), 6).alias("mean"))


@query("""WITH t AS (SELECT l_orderkey, l_returnflag, max(CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0 END) AS has, CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END AS w FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, CAST(round_even(sum(w * has) / sum(w) * 100, 0) AS BIGINT) AS score FROM t GROUP BY 1""")
def weighted_coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted coverage in per cent, rounded half to even."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max((F.col("l_quantity") > 25).cast("double")).alias("has"))
    w = F.when(F.col("l_returnflag") == "A", 2).otherwise(1)
    return t.groupBy("l_orderkey").agg(F.bround(F.sum(w * F.col("has")) / F.sum(w) * 100).cast("long").alias("score"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS i FROM lineitem),
f(l_orderkey, i, last, n) AS (SELECT l_orderkey, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT l_orderkey FROM lineitem)
 UNION ALL SELECT l.l_orderkey, l.i, CASE WHEN l_linenumber BETWEEN last AND last + 1 THEN l_linenumber ELSE last END, n + CASE WHEN l_linenumber BETWEEN last AND last + 1 THEN 1 ELSE 0 END FROM f JOIN l ON l.l_orderkey = f.l_orderkey AND l.i = f.i + 1)
SELECT l_orderkey, max(n) AS n_accepted, CAST(max(i) AS INT) AS n_lines FROM f GROUP BY 1""")
def monotone_clause_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that continue a sequence, others skipped."""
    order = F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber")))
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(order, lambda x: x["l_linenumber"]).alias("n"))
    return t.select("l_orderkey", F.size(O.monotone_fold(F.col("n"))).cast("long").alias("n_accepted"), F.size("n").alias("n_lines"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(o_orderstatus, l_linestatus) AS text, o_orderkey IS NOT NULL AS is_parent FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def parent_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child's text replaced by its ancestor's, found by the prefix of its id."""
    from ..operators import retrieval as R

    li = table(spark, sf_dir, "lineitem").withColumn("chunk_id", F.concat_ws("_", F.lit("L"), F.lit("0"), F.lit("0"), "l_orderkey", "l_linenumber")).withColumn("text", F.col("l_linestatus"))
    parents = table(spark, sf_dir, "orders").select(F.concat_ws("_", F.lit("L"), F.lit("0"), F.lit("0"), "o_orderkey").alias("parent_id"), F.col("o_orderstatus").alias("parent_text"))
    return R.fetch_parents(li, parents, R.ancestor_id(F.col("chunk_id"))).select("l_orderkey", "l_linenumber", "l_partkey", "text", "is_parent")


@query("SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def json_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path out of a JSON column."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))
