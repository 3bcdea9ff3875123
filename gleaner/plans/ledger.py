"""Score histories, run and usage ledgers: latest rows, KPIs, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import age_in_days, is_due, month_of, week_start
from ..functions.money import candidate_confidence, percent, recommendation, tier_confidence, token_cost
from ..functions.rules import half_up
from ..operators import aggregates as A
from ..operators import latest as L
from ..streaming.events import weekly_activity, windowed_sums
from .registry import TODAY, Tables, query


def _now(day: str = TODAY) -> Column:
    return F.lit(day).cast("timestamp")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return L.latest_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""WITH latest AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
hot AS (SELECT c_mktsegment FROM latest JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 250000),
dim(segment) AS (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('MACHINERY'), ('AEROSPACE'))
SELECT segment, count(c_mktsegment) AS n FROM dim LEFT JOIN hot ON segment = c_mktsegment GROUP BY segment
UNION ALL SELECT 'unassigned', count(*) FROM hot WHERE c_mktsegment NOT IN (SELECT segment FROM dim)""")
def hot_by_segment(t: Tables) -> DataFrame:
    """Entities whose latest score is over a threshold, by category, zeros included."""
    latest = L.latest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    hot = latest.where("o_totalprice >= 250000").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    dim = t.spark.createDataFrame([(s,) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "AEROSPACE")], "segment string")
    return A.breakdown(hot, "c_mktsegment", dim, "segment")


@query(f"""SELECT count(*) FILTER (o_orderdate >= date_trunc('week', TIMESTAMP '{TODAY}') AND o_orderdate < date_trunc('week', TIMESTAMP '{TODAY}') + INTERVAL 7 DAY) AS this_week,
count(*) FILTER (o_orderstatus = 'O') AS awaiting_review, count(*) AS cumulative,
count(*) FILTER (TIMESTAMP '{TODAY}' - o_orderdate >= INTERVAL 7 DAY AND o_orderstatus NOT IN ('F')) AS stale,
count(*) FILTER (o_totalprice / 50000 >= 8 AND NOT (o_orderpriority = '5-LOW')) AS hot FROM orders""")
def entity_kpis(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "new").otherwise(F.col("o_orderstatus"))
    rows = t.orders.select("o_orderdate", status.alias("o_orderstatus"), (F.col("o_totalprice") / 50000).alias("score"), (F.col("o_orderpriority") == "5-LOW").alias("provisional"))
    return A.entity_kpis(rows, _now(), "o_orderdate", "o_orderdate", "o_orderstatus", "score", "provisional", ["F"])


@query(f"""SELECT 'all-time' AS period, count(*) AS n FROM orders
UNION ALL SELECT 'this-month', count(*) FROM orders WHERE date_trunc('month', o_orderdate) = DATE '{TODAY}'
UNION ALL SELECT 'last-month', count(*) FROM orders WHERE date_trunc('month', o_orderdate) = DATE '2001-07-01'
UNION ALL SELECT 'this-year', count(*) FROM orders WHERE year(o_orderdate) = 2001
UNION ALL SELECT 'last-year', count(*) FROM orders WHERE year(o_orderdate) = 2000""")
def cumulative_period(t: Tables) -> DataFrame:
    return A.count_by_period(t.orders.select("o_orderdate"), "o_orderdate", _now())


def _runs(t: Tables) -> DataFrame:
    """Events read as results of source runs."""
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("success")
    return t.events.select(
        F.concat(F.lit("s"), (F.col("user_id") % 9).cast("string")).alias("source"),
        outcome.alias("outcome"),
        F.floor(F.col("value") * 10).alias("duration"),
        F.get_json_object("props", "$.k").cast("long").alias("found"),
        "ts",
        "event_id",
    )


_RUNS = """runs AS (SELECT 's' || (user_id % 9) AS source, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'success' END AS outcome,
CAST(floor(value * 10) AS BIGINT) AS duration, CAST(json_extract_string(props, '$.k') AS BIGINT) AS found, ts, event_id FROM events)"""
_ANALYTICS = f"""WITH {_RUNS}, dim AS (SELECT 's' || i AS source FROM range(12) r(i)),
agg AS (SELECT source, count(*) AS appearances, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'failed') AS failed,
count(*) FILTER (outcome = 'skipped') AS skipped, CAST(floor(avg(duration) + 0.5) AS BIGINT) AS avg_duration,
CAST(sum(found) FILTER (outcome = 'success') AS BIGINT) AS found, max(ts) FILTER (outcome = 'success') AS last_success, max(ts) FILTER (outcome = 'failed') AS last_failure FROM runs GROUP BY source)"""


def _analytics(t: Tables) -> DataFrame:
    dim = t.spark.range(12).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    return A.source_analytics(_runs(t), "source", "outcome", "duration", "found", "ts", dim)


@query(f"""{_ANALYTICS} SELECT dim.source, coalesce(appearances, 0) AS appearances, coalesce(success, 0) AS success, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped,
coalesce(found, 0) AS found, round(CASE WHEN success + failed > 0 THEN failed / (success + failed) END, 3) AS failure_rate, avg_duration, last_success, last_failure
FROM dim LEFT JOIN agg USING (source)""")
def source_analytics(t: Tables) -> DataFrame:
    return _analytics(t)


@query(f"""{_ANALYTICS} SELECT dim.source, CASE WHEN dim.source = 's11' THEN 'blocked' WHEN dim.source = 's10' THEN 'disabled' WHEN appearances IS NULL THEN 'enabled'
WHEN failed = success + failed THEN 'failed' WHEN failed > 0 OR last_failure > last_success THEN 'degraded' ELSE 'healthy' END AS health FROM dim LEFT JOIN agg USING (source)""")
def source_health(t: Tables) -> DataFrame:
    state = F.when(F.col("source") == "s11", "unavailable").when(F.col("source") == "s10", "planned").otherwise("live")
    failed_last = F.coalesce(F.col("last_failure") > F.col("last_success"), F.lit(False))
    return _analytics(t).select("source", A.health(state, F.col("appearances"), F.col("failure_rate"), failed_last).alias("health"))


@query(f"""WITH {_RUNS} SELECT source, arg_max(event_id, ts) AS latest_error FROM runs WHERE outcome = 'failed' GROUP BY source""")
def latest_error(t: Tables) -> DataFrame:
    return _runs(t).where("outcome = 'failed'").groupBy("source").agg(F.max_by("event_id", "ts").alias("latest_error"))


@query("""SELECT user_id, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type = 'error'""")
def latest_is_error(t: Tables) -> DataFrame:
    """Entities whose last entry is an error; an earlier error doesn't count."""
    return L.latest_if(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type") == "error").drop("event_type")


@query("""SELECT event_id, ts, event_type FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id DESC LIMIT 1""")
def latest_completed_run(t: Tables) -> DataFrame:
    return L.latest_run(t.events.select("event_id", "ts", "event_type"), F.col("event_type") != "error", ["ts", "event_id"])


@query("""WITH s AS (SELECT 'l_returnflag' AS dimension, l_returnflag AS key, * FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, * FROM lineitem
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), * FROM lineitem)
SELECT dimension, key, count(*) AS calls, round(sum(l_quantity), 2) AS l_quantity, round(sum(CASE WHEN l_tax = 0 THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END), 0) AS cost FROM s GROUP BY ALL""")
def usage_breakdown(t: Tables) -> DataFrame:
    """All breakdowns of a ledger in one pass; the actual cost where there is one, else the estimate."""
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_extendedprice", F.when(F.col("l_tax") == 0, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("actual"))
    out = A.usage_breakdown(rows, ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_quantity"], "actual", "l_extendedprice")
    return out.withColumns({"l_quantity": F.round("l_quantity", 2), "cost": F.round("cost", 0)})


@query("""SELECT strftime(l_shipdate, '%Y-%m') AS month, round(sum(l_extendedprice), 0) AS spent,
CASE WHEN sum(l_extendedprice) >= 30000000 THEN 'exhausted' WHEN sum(l_extendedprice) >= 27000000 THEN 'warn-again' WHEN sum(l_extendedprice) >= 22500000 THEN 'warn' ELSE 'ok' END AS level
FROM lineitem GROUP BY 1""")
def monthly_budget(t: Tables) -> DataFrame:
    spent = t.lineitem.groupBy(month_of(F.col("l_shipdate")).alias("month")).agg(F.sum("l_extendedprice").alias("s"))
    return spent.select("month", F.round("s", 0).alias("spent"), A.budget_level(F.col("s"), F.lit(30_000_000)).alias("level"))


@query("""SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS spent, sum(o_totalprice) OVER w <= 1000000 AS admitted FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def budget_admission(t: Tables) -> DataFrame:
    rows = L.running_within(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_totalprice"), 1_000_000)
    return rows.select("o_custkey", "o_orderkey", F.round("spent", 2).alias("spent"), "admitted")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT a.o_custkey, a.o_orderkey, a.o_totalprice, floor((a.o_totalprice - b.o_totalprice) * 10 + 0.5) / 10 AS delta FROM r a LEFT JOIN r b ON a.o_custkey = b.o_custkey AND b.n = 2 WHERE a.n = 1""")
def rescore_delta(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return L.change_from_previous(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").drop("o_orderdate")


@query("""WITH q AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, max(o_totalprice) FILTER (i = least(n - 1, floor(n * 0.5))) AS median, max(o_totalprice) FILTER (i = least(n - 1, floor(n * 0.75))) AS top_quartile FROM q GROUP BY 1""")
def floor_quantiles(t: Tables) -> DataFrame:
    return A.floor_quantiles(t.orders, ["o_orderpriority"], "o_totalprice", {"median": 0.5, "top_quartile": 0.75})


@query("""WITH s AS (SELECT p_type AS p_source, p_brand, CAST(p_size % 3 + 1 AS VARCHAR) AS tier FROM part), u AS (SELECT 'p_source' AS dimension, p_source AS key FROM s UNION ALL SELECT 'p_brand', p_brand FROM s UNION ALL SELECT 'tier', tier FROM s),
g AS (SELECT dimension, key, count(*) AS n FROM u GROUP BY ALL), a AS (SELECT count(*) AS total FROM part)
SELECT dimension, key, n, round(n / total, 4) AS share, dimension = 'p_source' AND n / total > 0.4 AS warns FROM g, a""")
def diversity_share(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_type").alias("p_source"), "p_brand", (F.col("p_size") % 3 + 1).alias("tier"))
    return A.diversity(rows, "p_source", "p_brand", "tier")


@query("SELECT p_name, p_brand, count(DISTINCT p_size) AS n_values FROM part GROUP BY ALL HAVING count(DISTINCT p_size) > 1")
def amount_conflicts(t: Tables) -> DataFrame:
    return A.conflicts(t.part, ["p_name", "p_brand"], "p_size")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal < 0, c_acctbal DESC, c_custkey) AS rank FROM customer")
def rank_provisional_last(t: Tables) -> DataFrame:
    order = [F.col("c_acctbal") < 0, F.col("c_acctbal").desc(), F.col("c_custkey")]
    return L.ranked(t.customer, ["c_mktsegment"], order).select("c_custkey", "rank")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def top_three_per_brand(t: Tables) -> DataFrame:
    return L.top_per_group(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 3)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def recent_runs(t: Tables) -> DataFrame:
    """A top-k report: the newest hundred."""
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(100)


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_retailprice DESC, p_partkey) AS rank FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY rank) AS inf FROM p),
c AS (SELECT *, ins > CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 1 WHEN 'blue' THEN 2 ELSE 1000000 END AS capped FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, split_part(p_name, ' ', 1) ORDER BY inf <> 1, rank) AS ins FROM f))
SELECT p_brand, p_partkey, rank FROM c WHERE NOT capped QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY inf <> 1, rank) <= 5""")
def shortlist_two_pass(t: Tables) -> DataFrame:
    pool = t.part.select("p_brand", "p_type", "p_partkey", F.split("p_name", " ")[0].alias("source"), (F.col("p_size") % 3).alias("tier"), "p_retailprice")
    order = [F.col("tier"), F.col("p_retailprice").desc(), F.col("p_partkey")]
    return L.shortlist(pool, "p_brand", "p_type", "source", order, {"red": 1, "blue": 2}).where("picked").select("p_brand", "p_partkey", "rank")


@query("SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def weekly_counts(t: Tables) -> DataFrame:
    return weekly_activity(t.events, "ts", "event_type")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_sums(t: Tables) -> DataFrame:
    return windowed_sums(t.events, "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("""SELECT user_id, CASE WHEN user_id % 2 = 0 THEN epoch(TIMESTAMP '2024-01-31' - max(ts)) / 86400 >= 7 ELSE epoch(TIMESTAMP '2024-01-31' - max(ts)) / 86400 >= 14 END AS due,
CAST(date_trunc('week', max(ts)) AS DATE) AS last_week FROM events GROUP BY 1""")
def due_for_refresh(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    cadence = F.when(F.col("user_id") % 2 == 0, "weekly").otherwise("biweekly")
    return last.select("user_id", is_due(F.col("last"), _now("2024-01-31"), cadence).alias("due"), week_start(F.col("last")).cast("date").alias("last_week"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN false ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') > 30 END AS stale FROM orders""")
def stale_records(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", False).otherwise(age_in_days(F.col("o_orderdate"), _now()) > 30).alias("stale"))


@query("""SELECT p_partkey, round(greatest(0, CAST(CASE p_size % 4 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 ELSE 0 END AS DOUBLE) - least(0.3::DOUBLE, (p_partkey % 4) * 0.15::DOUBLE)), 2) AS tier_confidence,
round(greatest(0.05::DOUBLE, least(CAST(CASE WHEN p_size % 2 = 0 THEN 0.95 ELSE 0.6 END AS DOUBLE), least(0.9::DOUBLE, (p_size % 11) / 10) * CAST(CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.6 END AS DOUBLE) + CAST(CASE WHEN p_partkey % 3 = 0 THEN 0.08 ELSE 0 END AS DOUBLE))), 2) AS candidate_confidence,
CASE WHEN p_retailprice / 150 >= 8 THEN 'prioritize' WHEN p_retailprice / 150 >= 6.5 THEN 'track' WHEN p_retailprice / 150 >= 5 THEN 'monitor' ELSE 'pass' END AS recommendation,
floor(p_size / 50 * 1000 + 0.5) / 10 AS pct, CAST(floor(p_retailprice - 1000.5 + 0.5) AS BIGINT) AS rounded FROM part""")
def confidences(t: Tables) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    return t.part.select(
        "p_partkey",
        tier_confidence(F.nullif(F.col("p_size") % 4, F.lit(0)), F.col("p_partkey") % 4).alias("tier_confidence"),
        candidate_confidence(F.col("p_size") % 11, even, F.col("p_partkey") % 3 == 0).alias("candidate_confidence"),
        recommendation(F.col("p_retailprice") / 150).alias("recommendation"),
        percent(F.col("p_size"), F.lit(50)).alias("pct"),
        half_up(F.col("p_retailprice") - 1000.5).cast("long").alias("rounded"),
    )


@query("""WITH p(model, valid_from, valid_to, i, o, r, w, s) AS (VALUES ('A', DATE '1990-01-01', DATE '1998-01-01', 3.0, 15.0, 0.3, 3.75, 0.01), ('A', DATE '1998-01-01', NULL, 2.0, 10.0, 0.2, 2.5, 0.01), ('N', DATE '1990-01-01', NULL, 1.0, 5.0, 0.1, 1.25, 0.01)),
u AS (SELECT l_returnflag AS model, CAST(l_shipdate AS DATE) AS d, * FROM lineitem),
c AS (SELECT u.*, coalesce(i, 3.0) AS pi, coalesce(o, 15.0) AS po, coalesce(r, 0.3) AS pr, coalesce(w, 3.75) AS pw, coalesce(s, 0.01) AS ps FROM u LEFT JOIN p ON u.model = p.model AND d >= valid_from AND (valid_to IS NULL OR d < valid_to))
SELECT model, count(*) AS uses, round(sum((l_quantity * 100 * pi + l_quantity * 10 * po + l_linenumber * pr + 0 * pw) / 1e6 + l_linenumber * ps), 3) AS cost FROM c GROUP BY model""")
def model_costs(t: Tables) -> DataFrame:
    prices = t.spark.createDataFrame(
        [("A", "1990-01-01", "1998-01-01", 3.0, 15.0, 0.3, 3.75, 0.01), ("A", "1998-01-01", None, 2.0, 10.0, 0.2, 2.5, 0.01), ("N", "1990-01-01", None, 1.0, 5.0, 0.1, 1.25, 0.01)],
        "model string, valid_from string, valid_to string, input double, output double, cache_read double, cache_write double, web_search double",
    ).withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")})
    usage = t.lineitem.select(F.col("l_returnflag").alias("model"), F.col("l_shipdate").alias("at"), (F.col("l_quantity") * 100).alias("input_tokens"), (F.col("l_quantity") * 10).alias("output_tokens"), F.col("l_linenumber").alias("cached_tokens"), F.lit(0).alias("cache_write_tokens"), F.col("l_linenumber").alias("web_searches"))
    return token_cost(usage, prices).groupBy("model").agg(F.count(F.lit(1)).alias("uses"), F.round(F.sum("cost_usd"), 3).alias("cost"))
