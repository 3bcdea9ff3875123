"""Views and patches of records over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.site_evidence import spelt_host
from ..operators import records as R
from .registry import Tables, query


@query("""SELECT o_custkey AS run_id, count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) > 0 AND o_custkey % 2 = 0 AS warned, CASE WHEN o_custkey % 2 = 0 THEN count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) ELSE 0 END AS warning_count,
CASE WHEN o_custkey % 2 = 0 THEN count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN o_orderkey % 5 END) ELSE 0 END AS n_sources FROM orders GROUP BY 1""")
def partial_runs(t: Tables) -> DataFrame:
    """Runs of source results, with what went wrong in those that ended with warnings."""
    mode = F.when(F.col("o_orderpriority") == "1-URGENT", "failed").when(F.col("o_orderpriority") == "5-LOW", "skipped").otherwise("ok")
    results = t.orders.select(F.col("o_custkey").alias("run_id"), mode.alias("mode"), (F.col("o_orderkey") % 5).cast("string").alias("source_id"))
    runs = results.select("run_id").distinct().withColumn("status", F.when(F.col("run_id") % 2 == 0, "Completed with warnings").otherwise("Completed"))
    found = R.run_warnings(runs, results)
    return found.select("run_id", (F.col("is_partial") & (F.col("warning_count") > 0)).alias("warned"), "warning_count", F.size("affected_sources").cast("long").alias("n_sources"))


@query("""SELECT 'all' AS o_orderpriority, count(*) AS n FROM orders UNION ALL SELECT p, count(*) FILTER (o_orderpriority = p) FROM (VALUES ('1-URGENT'), ('5-LOW'), ('never')) AS s(p), orders GROUP BY p""")
def status_counts(t: Tables) -> DataFrame:
    return R.counts_by_status(t.orders, "o_orderpriority", ["1-URGENT", "5-LOW", "never"])


@query("""WITH l AS (SELECT o_custkey, 'v' || (arg_max(o_orderkey, o_orderkey) % 3) AS v FROM orders GROUP BY 1), j AS (SELECT c_custkey, v FROM customer LEFT JOIN l ON c_custkey = o_custkey)
SELECT count(*) AS total, count(v) AS scored, count(*) - count(v) AS unscored, count(*) FILTER (v = 'v2') AS up_to_date, count(*) FILTER (v <> 'v2') AS needs_rescore, count(*) FILTER (v = 'v0') AS of_v0 FROM j""")
def rescore_state(t: Tables) -> DataFrame:
    latest = t.orders.groupBy(F.col("o_custkey").alias("company_id")).agg(F.concat(F.lit("v"), (F.max("o_orderkey") % 3).cast("string")).alias("version"))
    found = R.rescore_status(t.customer.select(F.col("c_custkey").alias("company_id")), latest, "v2")
    return found.select("total", "scored", "unscored", "up_to_date", "needs_rescore", F.coalesce(F.element_at("stale_by_version", "v0"), F.lit(0)).alias("of_v0"))


@query("SELECT o_custkey AS company_id, count(*) FILTER (o_orderstatus <> 'F') AS active, count(*) FILTER (o_orderstatus = 'F') AS archived FROM orders GROUP BY 1")
def notes_per_record(t: Tables) -> DataFrame:
    return R.note_counts(t.orders.select(F.col("o_custkey").alias("company_id"), (F.col("o_orderstatus") == "F").alias("archived")))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0")
def lost_history(t: Tables) -> DataFrame:
    return R.history_lost(t.customer, t.customer.where("c_custkey % 10 <> 0"), "c_custkey")


@query("SELECT c_custkey, c_acctbal / 1000 AS score FROM customer WHERE c_custkey % 7 <> 0 AND c_mktsegment = 'HOUSEHOLD' AND lower(c_name || ' ' || c_mktsegment) LIKE '%hold%' AND c_custkey % 3 <> 0 AND c_acctbal / 1000 >= 8")
def high_fit_view(t: Tables) -> DataFrame:
    rows = t.customer.select("*", (F.col("c_acctbal") / 1000).alias("score"), (F.col("c_custkey") % 3 == 0).alias("provisional"), (F.col("c_custkey") % 7 == 0).alias("quarantined"))
    return R.ranking_view(rows, " HOLD ", {"c_mktsegment": "HOUSEHOLD"}, "highFit", ("c_name", "c_mktsegment")).select("c_custkey", "score")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'A' END AS owner FROM customer")
def owners_by_host(t: Tables) -> DataFrame:
    """Pages on or below a registered domain; a name that merely ends like one isn't."""
    kinds = F.array(*map(F.lit, ("https://a.example.com/x", "http://www.news.b.example.com/", "https://deep.a.example.com", "https://nota.example.org")))
    pages = t.customer.select("c_custkey", F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int")).alias("url"))
    registry = t.spark.createDataFrame([("a.example.com", "A"), ("b.example.com", "B"), ("a.example.org", "C")], "domain string, owner_name string")
    return R.owner_of_url(pages, registry).select("c_custkey", F.col("owner.owner_name").alias("owner"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'slug' WHEN 1 THEN 'domain' ELSE 'none' END AS basis, CASE c_custkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE ELSE FALSE END AS belongs,
CASE c_custkey % 3 WHEN 0 THEN 'Y Combinator' WHEN 1 THEN 'StartX' END AS accelerator, CASE c_custkey % 3 WHEN 0 THEN 'Seed / Seed+' WHEN 1 THEN 'Series B / Series B+' END AS round,
CASE WHEN c_custkey % 2 = 0 THEN 'PROVISIONAL: no company-descriptive component could be judged, so this score reflects only our own sourcing quality, not the company | ' ELSE '' END || 'Policy flags for partner review: x, y' AS caveats FROM customer""")
def record_options(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    slug = F.when(k % 5 == 0, "Acme").when(k % 5 == 2, "other")
    site = F.when(k % 5 == 1, "https://www.acme.example.com/a").when(k % 5 == 3, "https://b.example.com")
    page = F.element_at(F.array(*map(F.lit, ("https://bluecore.com", "https://www.bluecoreenergy.io/x", "https://unlike.org", "no host"))), (k % 4 + 1).cast("int"))
    return t.customer.select(
        "c_custkey",
        R.profile_match(slug, site, F.lit("acme"), F.lit("https://acme.example.com")).alias("basis"),
        spelt_host(page, F.lit("Bluecore Energy")).alias("belongs"),
        R.accelerator_option(F.when(k % 3 == 0, " y combinator (S21)").when(k % 3 == 1, "startx").otherwise("none of these")).alias("accelerator"),
        R.round_option(F.when(k % 3 == 0, "Seed").when(k % 3 == 1, "Series B+").otherwise("Stealth")).alias("round"),
        R.caveats(k % 2 == 0, F.array().cast("array<string>"), F.array(F.lit("x"), F.lit("y"))).alias("caveats"),
    )


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Ann Example' ELSE 'Bob Real' END AS first_founder, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS n_founders, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_kept FROM customer")
def founder_replacement(t: Tables) -> DataFrame:
    """Placeholders give way to people; a real name stays; empty values of a map go."""
    k = F.col("c_custkey")
    person = lambda name: F.struct(name.alias("name"))
    existing = F.array(person(F.when(k % 3 == 0, "Unknown founder").otherwise("Bob Real")))
    found = F.array(person(F.lit("Ann Example")), person(F.lit("ann  example!")), person(F.lit("Cy Other")), person(F.lit("42")))
    now = R.resolved_founders(existing, found)
    kept = R.without_empty(F.create_map(F.lit("a"), F.when(k % 2 == 0, "x").otherwise(""), F.lit("b"), F.lit(None).cast("string")))
    return t.customer.select("c_custkey", now[0]["name"].alias("first_founder"), F.size(now).alias("n_founders"), F.size(kept).alias("n_kept"))


@query("""WITH p AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 = 0) AS seg, arg_max(o_totalprice, o_orderkey) FILTER (o_orderkey % 2 = 0) AS bal FROM orders GROUP BY 1) SELECT c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, coalesce(bal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN p ON c_custkey = o_custkey""")
def patched_records(t: Tables) -> DataFrame:
    patches = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("c_mktsegment"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("c_acctbal"))
    return R.patched(t.customer, patches, "c_custkey", ["c_mktsegment", "c_acctbal"], "at").select("c_custkey", "c_mktsegment", "c_acctbal")
