"""Entity resolution, decisions, scores and upserts over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.entities import NON_COMPANY, entity_problem
from ..functions.names import claim_fingerprint, name_tokens
from ..functions.urls import domain_key, host, readable_text
from ..operators import decisions as X
from ..operators import matching as M
from ..operators import scoring as S
from ..operators import upserts as U
from ..operators.aggregates import independent_counts
from ..operators.filters import matches_query, recent_enough, without_attempt
from ..operators.graph import with_checkpoints
from ..streaming.changes import write_back
from ..streaming.store import Store
from .registry import TODAY, Tables, query

_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '')"


def _today():
    return F.lit(TODAY).cast("date")


_EVIDENCE = """e AS (SELECT o_custkey AS company_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'funding-announcement' WHEN '2-HIGH' THEN 'explicit-raising-statement' WHEN '3-MEDIUM' THEN 'accelerator-batch' WHEN '4-NOT SPECIFIED' THEN 'product-launch' ELSE 'none' END AS kind,
CASE o_orderkey % 4 WHEN 0 THEN 'sec' WHEN 1 THEN 'funding-news' WHEN 2 THEN 'github' ELSE 'blog' END AS source_id, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS tier, CAST(o_orderdate AS DATE) AS d FROM orders)"""


def _evidence(t: Tables) -> DataFrame:
    """Orders read as dated evidence about customers."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "funding-announcement").when(F.col("o_orderpriority") == "2-HIGH", "explicit-raising-statement").when(F.col("o_orderpriority") == "3-MEDIUM", "accelerator-batch").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "product-launch").otherwise("none")
    source = F.element_at(F.array(*map(F.lit, ("sec", "funding-news", "github", "blog"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = t.orders.select(F.col("o_custkey").alias("company_id"), kind.alias("opportunity_type"), source.alias("source_id"), F.col("o_orderdate").cast("date").alias("published_at"))
    return rows.withColumn("tier", X.tier_of(F.col("source_id")))


_CLASSES = f"""{_EVIDENCE}, c AS (SELECT *, d BETWEEN DATE '{TODAY}' - 365 AND DATE '{TODAY}' AS recent, d BETWEEN DATE '{TODAY}' - 365 AND DATE '{TODAY}' AND tier <= 2 AS ok FROM e),
g AS (SELECT company_id, count(*) FILTER (ok AND kind = 'funding-announcement') AS fin, count(*) FILTER (ok AND kind IN ('explicit-raising-statement', 'accelerator-batch')) AS rai, count(*) FILTER (ok AND kind = 'product-launch') AS com,
count(DISTINCT source_id) FILTER (recent) AS n_sources FROM c GROUP BY 1),
k AS (SELECT *, CASE WHEN fin > 0 AND rai > 0 THEN 'verified-current-opportunity' WHEN fin > 0 THEN 'recent-financing-signal' WHEN rai > 0 THEN 'credible-fundraising-signal' WHEN com > 0 THEN 'unverified-opportunity' ELSE 'company-lead' END AS classification,
CASE WHEN fin > 0 THEN 1 WHEN rai > 0 THEN 2 WHEN com > 0 THEN 3 END AS pick FROM g)"""


def _classes(t: Tables) -> DataFrame:
    return X.classify(_evidence(t), _today(), operating=F.lit(True))


@query(f"""WITH {_CLASSES}, p AS (SELECT k.*, c.source_id, c.tier, c.d FROM k LEFT JOIN c ON k.company_id = c.company_id AND c.ok AND CASE c.kind WHEN 'funding-announcement' THEN 1 WHEN 'explicit-raising-statement' THEN 2 WHEN 'accelerator-batch' THEN 2 WHEN 'product-launch' THEN 3 END = k.pick
QUALIFY row_number() OVER (PARTITION BY k.company_id ORDER BY tier, d DESC, source_id) = 1)
SELECT company_id, classification, source_id AS primary_source, tier AS primary_tier, d AS primary_date, n_sources FROM p""")
def opportunity_classes(t: Tables) -> DataFrame:
    return _classes(t)


@query(f"""WITH {_CLASSES}, v AS (SELECT company_id, classification, CASE company_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'disqualified' ELSE 'qualified' END AS verdict, n_sources > 1 AS corroborated, company_id % 7 = 0 AS review FROM k)
SELECT CASE WHEN verdict IS NULL THEN 'unverified-opportunity' WHEN verdict = 'disqualified' OR NOT corroborated THEN 'company-lead' WHEN review THEN 'unverified-opportunity' ELSE classification END AS classification, count(*) AS n FROM v GROUP BY 1""")
def gated_classes(t: Tables) -> DataFrame:
    verdict = F.when(F.col("company_id") % 5 == 0, None).when(F.col("company_id") % 5 == 1, "disqualified").otherwise("qualified")
    gated = X.gated(F.col("classification"), verdict, F.col("n_sources") > 1, F.col("company_id") % 7 == 0)
    return _classes(t).groupBy(gated.alias("classification")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT o_custkey AS company_id, CASE o_orderkey % 5 WHEN 0 THEN 'Seed' WHEN 1 THEN 'Series A' END AS stage, o_orderstatus <> 'P' AS authoritative, o_orderpriority AS family FROM orders),
g AS (SELECT company_id, count(DISTINCT stage) FILTER (authoritative) AS k, max(stage) FILTER (authoritative) AS s, count(DISTINCT family) FILTER (authoritative AND stage IS NOT NULL) AS n, count(DISTINCT family) AS searched FROM e GROUP BY 1)
SELECT company_id, CASE WHEN k > 1 THEN 'Stage conflict' WHEN k = 1 THEN s ELSE 'Unknown' END AS stage, round(CASE WHEN k = 1 THEN least(0.95::DOUBLE, 0.75::DOUBLE + 0.1::DOUBLE * n) WHEN k > 1 THEN 0.15::DOUBLE ELSE least(0.55::DOUBLE, 0.2::DOUBLE + 0.08::DOUBLE * searched) END, 2) AS confidence, n AS n_sources FROM g""")
def stage_resolution(t: Tables) -> DataFrame:
    stage = F.when(F.col("o_orderkey") % 5 == 0, "Seed").when(F.col("o_orderkey") % 5 == 1, "Series A")
    rows = t.orders.select(F.col("o_custkey").alias("company_id"), stage.alias("stage"), (F.col("o_orderstatus") != "P").alias("authoritative"), F.col("o_orderpriority").alias("family"))
    return X.resolve_stage(rows)


@query("""WITH c AS (SELECT o_custkey AS company_id, CAST(o_orderkey % 7 AS VARCHAR) AS person_key, CASE o_orderkey % 3 WHEN 0 THEN 'CEO' WHEN 1 THEN 'CTO' END AS title, o_orderstatus <> 'P' AS authoritative, CAST(floor(o_totalprice % 10) AS INTEGER) AS match_score, o_orderkey % 11 = 0 AS director FROM orders),
s AS (SELECT *, authoritative AND title IS NOT NULL AND match_score >= 7 AND NOT director AS sure FROM c),
x AS (SELECT DISTINCT company_id FROM (SELECT company_id, title FROM s WHERE sure GROUP BY ALL HAVING count(DISTINCT person_key) > 1)),
g AS (SELECT company_id, count(*) FILTER (sure) AS sure, count(*) FILTER (match_score >= 5) AS likely, arg_max(person_key, match_score * 100 + ascii(person_key)) AS best_person FROM s GROUP BY 1)
SELECT g.company_id, CASE WHEN x.company_id IS NOT NULL THEN 'conflict' WHEN sure > 0 THEN 'verified' WHEN likely > 0 THEN 'probable' ELSE 'manual-review' END AS status, best_person FROM g LEFT JOIN x ON g.company_id = x.company_id""")
def founder_resolution(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_custkey").alias("company_id"),
        (F.col("o_orderkey") % 7).cast("string").alias("person_key"),
        F.when(F.col("o_orderkey") % 3 == 0, "CEO").when(F.col("o_orderkey") % 3 == 1, "CTO").alias("title"),
        (F.col("o_orderstatus") != "P").alias("authoritative"),
        F.floor(F.col("o_totalprice") % 10).cast("int").alias("match_score"),
        (F.col("o_orderkey") % 11 == 0).alias("director"),
    )
    return X.founder_status(rows)


def _companies(t: Tables) -> DataFrame:
    """Customers as companies: up to all of their orders are evidence."""
    kind = F.when(F.col("o_orderstatus") == "F", "Filing").when(F.col("o_orderstatus") == "O", "Accelerator").otherwise("Press")
    evidence = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("source"), F.concat(F.lit("https://e/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_orderdate").cast("date").alias("date"), kind.alias("type"))).alias("evidence"))
    k = F.col("c_custkey")
    identity = F.when(k % 4 == 0, F.struct((k % 8 == 0).alias("latino_led"), F.lit(True).alias("female_led"), F.lit(False).alias("other")))
    founder = lambda name, past: F.struct(F.lit(name).alias("name"), past.alias("background"), identity.alias("identity"))
    past = F.when(k % 3 == 0, "founded two companies, engineer").when(k % 3 == 1, "Unknown").otherwise("teacher")
    rows = t.customer.select(
        k.alias("id"),
        F.col("c_mktsegment").alias("subcategory"),
        F.element_at(F.array(*map(F.lit, ("Seed", "Pre-seed", "Series B+", "Unknown"))), (k % 4 + 1).cast("int")).alias("stage"),
        F.struct((F.col("c_acctbal") / 1000).alias("level"), F.when(k % 5 == 0, "Unknown").otherwise("rated").alias("note")).alias("traction"),
        F.when(k % 2 == 0, F.array(founder("A B", past), founder("C D", past))).otherwise(F.array(founder("Unknown founder", past))).alias("founders"),
        F.element_at(F.array(*map(F.lit, ("CA", "??", "FL"))), (k % 3 + 1).cast("int")).alias("state"),
        F.when(k % 2 == 0, "$1M").alias("raising"),
        F.when(k % 6 == 0, F.lit("2001-01-01").cast("date")).when(k % 6 == 1, F.lit("1999-01-01").cast("date")).alias("last_funding_date"),
        F.when(k % 7 == 0, "Acc").alias("accelerator"),
    )
    none = F.array().cast("array<struct<source:string,url:string,date:date,type:string>>")
    return rows.join(evidence, "id", "left").withColumn("evidence", F.coalesce("evidence", none))


@query(f"""WITH v AS (SELECT o_custkey AS id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS filings, count(*) FILTER (o_orderstatus = 'O') AS accs, count(DISTINCT o_orderpriority) AS sources, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{TODAY}') AS age FROM orders GROUP BY 1),
c AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal, coalesce(n, 0) AS n, coalesce(filings, 0) AS filings, coalesce(accs, 0) AS accs, coalesce(sources, 0) AS sources, age FROM customer LEFT JOIN v ON c_custkey = id),
p AS (SELECT *, CASE seg WHEN 'BUILDING' THEN 20 WHEN 'MACHINERY' THEN 12 ELSE 16 END AS thesis,
CASE k % 4 WHEN 0 THEN 15 WHEN 1 THEN 12 WHEN 2 THEN 3 ELSE 5 END AS stage, k % 4 <> 3 AS stage_ok, CASE WHEN k % 8 = 0 THEN 12 WHEN k % 4 = 0 THEN 4 ELSE 0 END AS mission, k % 4 = 0 AS mission_ok,
greatest(0, least(10, CAST(floor(bal / 1000 + 0.5) AS INTEGER))) AS traction, bal > 0 OR k % 5 <> 0 AS traction_ok,
CASE WHEN k % 2 = 0 THEN 4 ELSE 1 END + CASE WHEN k % 3 = 0 THEN 6 ELSE 0 END AS founder, k % 2 = 0 OR k % 3 <> 1 AS founder_ok, CASE k % 3 WHEN 0 THEN 10 WHEN 1 THEN 2 ELSE 4 END AS geo, k % 3 <> 1 AS geo_ok,
CASE WHEN k % 2 = 0 THEN 3 ELSE 0 END + CASE k % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS funding, k % 2 = 0 OR k % 6 = 1 AS funding_ok,
CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END + (accs > 0)::INT + (filings > 0)::INT AS validation, least(5, n + filings) AS evidence, CASE WHEN n = 0 THEN 0 WHEN age <= 30 THEN 5 WHEN age <= 90 THEN 4 WHEN age <= 180 THEN 3 WHEN age <= 365 THEN 2 ELSE 1 END AS recency FROM c),
s AS (SELECT *, 20 + stage_ok::INT * 15 + mission_ok::INT * 15 + traction_ok::INT * 10 + founder_ok::INT * 10 + geo_ok::INT * 10 + funding_ok::INT * 5 + 10 + (n > 0)::INT * 5 AS most,
thesis + stage_ok::INT * stage + mission_ok::INT * mission + traction_ok::INT * traction + founder_ok::INT * founder + geo_ok::INT * geo + funding_ok::INT * funding + validation + evidence + recency AS earned FROM p)
SELECT k AS id, CAST(most AS INTEGER) AS assessable_points, CAST(earned AS INTEGER) AS earned, greatest(1::DOUBLE, floor(earned / most * 100 + 0.5) / 10) AS score, floor(most / 100 * 100 + 0.5) / 100 AS completeness,
NOT (stage_ok AND traction_ok AND founder_ok AND geo_ok) OR floor(most / 100 * 100 + 0.5) / 100 < 0.6 OR n < 1 AS provisional,
floor((0.4::DOUBLE * least(n, 4) / 4 + 0.2::DOUBLE * CASE WHEN n > 0 THEN filings / n ELSE 0 END + 0.2::DOUBLE * least(sources, 3) / 3 + 0.2::DOUBLE * CASE WHEN n > 0 THEN greatest(0::DOUBLE, 1 - age / 365) ELSE 0 END) * 100 + 0.5) / 100 AS evidence_confidence FROM s""")
def fit_scores(t: Tables) -> DataFrame:
    """Ten components, normalised over what could be judged."""
    scored = S.fit_score(_companies(t), _today(), {"BUILDING": "core", "MACHINERY": "exception"}, ["CA", "TX"])
    return scored.select("id", "assessable_points", "earned", "score", "completeness", "provisional", "evidence_confidence")


@query()
def component_extremes(t: Tables) -> DataFrame:
    scored = S.fit_score(_companies(t), _today(), {"BUILDING": "core", "MACHINERY": "exception"}, ["CA", "TX"])
    best, worst = S.strongest_and_weakest(F.col("components"))
    return scored.select("id", best.alias("strongest"), worst.alias("weakest"))


@query(f"""WITH r AS (SELECT page_id, {_HOST} AS h, md5(html) AS d FROM pages), a AS (SELECT h AS k, min(page_id) AS f FROM r GROUP BY 1), b AS (SELECT d AS k, min(page_id) AS f FROM r GROUP BY 1),
u AS (SELECT f AS first_id, page_id AS other_id, 0 AS x FROM r JOIN b ON d = k WHERE f <> page_id UNION ALL SELECT f, page_id, 1 FROM r JOIN a ON h = k WHERE f <> page_id)
SELECT first_id, other_id, CASE min(x) WHEN 0 THEN 'digest' ELSE 'host' END AS basis FROM u GROUP BY 1, 2""")
def duplicate_hints(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", domain_key(F.col("url")).alias("host"), F.md5(F.col("html").cast("binary")).alias("digest"))
    return M.duplicate_hints(rows, "page_id", ["digest", "host"])


def _records(t: Tables, odd: int) -> DataFrame:
    """Parts as records with odd or even keys: names recur, a few have domains, ids and founders."""
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    return t.part.where(k % 2 == odd).select(
        k.alias("id"),
        k.alias("position"),
        F.concat("p_name", F.lit(" "), "p_type").alias("name"),
        F.when(k % 10 < 2, F.concat(F.lit("https://www.d"), F.floor(k / 10).cast("string"), F.lit(".com/x"))).alias("domain"),
        F.when(k % 14 < 2, F.array(F.concat(F.lit("yc:"), F.floor(k / 14).cast("string")))).otherwise(none).alias("external_ids"),
        F.when(k % 22 < 2, F.floor(k / 22).cast("string")).alias("crm_id"),
        F.when(k % 6 < 2, F.array(F.concat(F.lit("person "), F.translate((k % 50).cast("string"), "0123456789", "abcdefghij")))).otherwise(none).alias("founders"),
    )


_EXACT = """r AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS nk, CASE WHEN p_partkey % 10 < 2 THEN 'd' || p_partkey // 10 END AS dk, CASE WHEN p_partkey % 14 < 2 THEN p_partkey // 14 END AS ek, CASE WHEN p_partkey % 22 < 2 THEN p_partkey // 22 END AS ck FROM part),
a AS (SELECT * FROM r WHERE id % 2 = 1), b AS (SELECT * FROM r WHERE id % 2 = 0),
h AS (SELECT a.id, 0 AS tier, min(b.id) AS m FROM a JOIN b USING (dk) GROUP BY 1 UNION ALL SELECT a.id, 1, min(b.id) FROM a JOIN b USING (ek) GROUP BY 1 UNION ALL SELECT a.id, 2, min(b.id) FROM a JOIN b USING (ck) GROUP BY 1 UNION ALL SELECT a.id, 3, min(b.id) FROM a JOIN b USING (nk) GROUP BY 1)"""


@query(f"""WITH {_EXACT} SELECT id, arg_min(CASE tier WHEN 0 THEN 'domain' WHEN 1 THEN 'external-id' WHEN 2 THEN 'crm-id' ELSE 'name' END, tier) AS matched_by, arg_min(m, tier) AS match_id, CASE WHEN min(tier) < 3 THEN 'exact' ELSE 'likely' END AS duplicate_status FROM h GROUP BY id""")
def match_exact_tiers(t: Tables) -> DataFrame:
    """The exact tiers of the match cascade; names alone make a likely duplicate."""
    exact = [tier for tier, kind in M.TIERS.items() if kind == "exact"]
    found = M.duplicate_status(M.match(_records(t, 1), _records(t, 0), tiers=exact))
    return found.where(F.col("kind") == "exact").select("id", "matched_by", "match_id", "duplicate_status")


@query()
def match_possible_tiers(t: Tables) -> DataFrame:
    """The tiers that only suggest: fuzzy names by alignment distance, and shared founders."""
    return M.match(_records(t, 1), _records(t, 0)).where(F.col("kind") != "exact")


@query()
def fuzzy_names(t: Tables) -> DataFrame:
    names = t.part.select(F.lower(F.concat("p_name", F.lit(" "), "p_brand")).alias("key"))
    # Both ways round is one pair.
    return M.fuzzy_pairs(names, names, "key").where("key < other")


@query("""WITH n(x) AS (VALUES (1), (2), (3)) SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS edge_id, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT x FROM n) OR l_suppkey IN (SELECT x FROM n)""")
def edges_of_nodes(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("edge_id"), "l_partkey", "l_suppkey").distinct()
    return M.edges_of(edges, t.spark.createDataFrame([(1,), (2,), (3,)], "node long"), "l_partkey", "l_suppkey")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_documents(t: Tables) -> DataFrame:
    return without_attempt(t.documents.select("doc_id"), t.labels, "doc_id")


@query("SELECT lang, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS passed FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def gate_by_label(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 1000")
def query_filter(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("vertical"), F.lit("Stealth").alias("stage"), F.lit("Unknown").alias("hq_state"), F.col("c_acctbal").alias("confidence"))
    return rows.where(matches_query(["BUILDING", "MACHINERY"], ["Seed"], ["CA"], 1000)).select("c_custkey")


@query(f"SELECT o_custkey FROM orders GROUP BY 1 HAVING date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '{TODAY}') <= 60")
def recent_evidence(t: Tables) -> DataFrame:
    dates = t.orders.groupBy("o_custkey").agg(F.array(F.max(F.col("o_orderdate").cast("date"))).alias("dates"))
    return dates.where(recent_enough(F.col("dates"), _today(), 60)).select("o_custkey")


_UPDATES = """u AS (SELECT o_custkey AS k, o_orderstatus AS field, o_totalprice AS value, CASE o_orderkey % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'user' WHEN 2 THEN 'extracted' WHEN 3 THEN 'ai' WHEN 4 THEN 'unverified' ELSE 'missing' END AS origin, 5 - o_orderkey % 6 AS r, o_orderkey AS seq FROM orders)"""


def _updates(t: Tables) -> DataFrame:
    origin = F.element_at(F.array(*map(F.lit, ("verified", "user", "extracted", "ai", "unverified", "missing"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("field"), F.col("o_totalprice").alias("value"), origin.alias("origin"), F.col("o_orderkey").alias("seq"))


@query(f"WITH {_UPDATES} SELECT k, field, value, origin, seq FROM u QUALIFY row_number() OVER (PARTITION BY k, field ORDER BY r DESC, seq DESC) = 1")
def provenance_fold(t: Tables) -> DataFrame:
    """The value that stands after updates of different trust."""
    return U.current_fields(_updates(t), ["k", "field"])


_SPLIT = "2000-06-01"


@query(f"""WITH u AS (SELECT o_custkey AS record_id, o_orderstatus AS field, round(o_totalprice / 50000)::INT::VARCHAR AS value, CASE o_orderkey % 6 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS r, o_orderpriority AS source,
date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 100000000 + o_orderkey AS seq, o_orderdate < TIMESTAMP '{_SPLIT}' AS old FROM orders),
a AS (SELECT * FROM u WHERE old QUALIFY row_number() OVER (PARTITION BY record_id, field ORDER BY r DESC, seq DESC) = 1), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY record_id, field ORDER BY r DESC, seq DESC) = 1)
SELECT b.record_id, b.field, a.value AS before, b.value AS after, b.source, b.seq, CASE WHEN a.seq IS NULL THEN 'added' WHEN a.value = b.value THEN 'confirmed' ELSE 'changed' END AS change FROM b LEFT JOIN a USING (record_id, field) WHERE a.seq IS NULL OR a.seq <> b.seq""")
def field_changes(t: Tables) -> DataFrame:
    """What the orders of the last months change of the fields that all earlier ones have made, as a feed."""
    with_checkpoints(t.spark)
    store = Store(t.spark, f"{t.spark.sparkContext.getCheckpointDir()}/fields-{uuid.uuid4().hex}")
    origin = F.element_at(F.array(*map(F.lit, ("verified", "user", "extracted", "ai", "unverified", "missing"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    seq = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 100_000_000 + F.col("o_orderkey")
    updates = t.orders.select(F.col("o_custkey").cast("long").alias("record_id"), F.col("o_orderstatus").alias("field"), F.round(F.col("o_totalprice") / 50000).cast("int").cast("string").alias("value"), origin.alias("origin"), F.col("o_orderpriority").alias("source"), seq.alias("seq"), F.lit(False).alias("manual"), (F.col("o_orderdate") < _SPLIT).alias("old"))
    write_back(store, updates.where("old").drop("old"), 0)
    return write_back(store, updates.where("not old").drop("old"), 1).drop("origin")


@query("""WITH i AS (SELECT p_partkey, p_name, p_size, p_retailprice FROM (SELECT p_partkey + 50 AS p_partkey, upper(p_name) AS p_name, p_size + 1 AS p_size, p_retailprice FROM part))
SELECT coalesce(p.p_partkey, i.p_partkey) AS p_partkey, coalesce(i.p_name, p.p_name) AS p_name, coalesce(p.p_size, i.p_size) AS p_size, coalesce(i.p_retailprice, p.p_retailprice) AS p_retailprice FROM part p FULL JOIN i ON p.p_partkey = i.p_partkey""")
def upsert_parts(t: Tables) -> DataFrame:
    """Latest wins, but for the size, which keeps its first value."""
    now = t.part.select("p_partkey", "p_name", "p_size", "p_retailprice")
    new = now.select((F.col("p_partkey") + 50).alias("p_partkey"), F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"), "p_retailprice")
    return U.upsert(now, new, ["p_partkey"], preserve=["p_size"])


@query("""WITH cur AS (SELECT DISTINCT user_id AS k, 0 AS seq FROM events WHERE user_id % 3 = 0), inc AS (SELECT user_id + 5 AS k, event_id AS seq FROM events)
SELECT * FROM cur UNION ALL SELECT k, min(seq) FROM inc WHERE k NOT IN (SELECT k FROM cur) GROUP BY k""")
def insert_or_ignore(t: Tables) -> DataFrame:
    now = t.events.where("user_id % 3 = 0").select(F.col("user_id").alias("k")).distinct().withColumn("seq", F.lit(0).cast("long"))
    return U.insert_new(now, t.events.select((F.col("user_id") + 5).alias("k"), F.col("event_id").alias("seq")), ["k"], ["seq"])


@query("""WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS d FROM events)
SELECT user_id, event_type, min(event_id) AS event_id, arg_min(d, event_id) FILTER (d IS NOT NULL) AS d FROM e GROUP BY 1, 2""")
def date_backfill(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("date")).alias("d"))
    return U.backfilled(rows, ["user_id", "event_type"], "d", "event_id")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def first_decisions(t: Tables) -> DataFrame:
    return U.first_decision(t.events.select("user_id", "event_type", "event_id"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT event_id, user_id, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), 'unknown') AS previous FROM events")
def review_log(t: Tables) -> DataFrame:
    return U.with_previous(t.events.select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type", start="unknown")


@query("""WITH m AS (SELECT s_suppkey AS f, s_suppkey - 1 AS t FROM supplier WHERE s_suppkey % 10 = 1), r AS (SELECT coalesce(m.t, l_suppkey) AS l_suppkey, l_shipdate, min(l_orderkey) AS l_orderkey FROM lineitem LEFT JOIN m ON l_suppkey = m.f GROUP BY 1, 2)
SELECT * FROM r""")
def merged_evidence(t: Tables) -> DataFrame:
    merges = t.supplier.where("s_suppkey % 10 = 1").select(F.col("s_suppkey").alias("from_id"), (F.col("s_suppkey") - 1).alias("to_id"))
    return U.merged_into(t.lineitem.select("l_suppkey", "l_shipdate", "l_orderkey"), merges, "l_suppkey", "l_shipdate", "l_orderkey")


@query("""WITH q AS (SELECT o_custkey * 2 AS k FROM orders) SELECT DISTINCT k, CASE WHEN c_custkey IS NULL THEN 'not-found' WHEN c_mktsegment = 'BUILDING' THEN 'skipped' ELSE 'changed' END AS outcome FROM q LEFT JOIN customer ON k = c_custkey""")
def bulk_status_change(t: Tables) -> DataFrame:
    asked = t.orders.select((F.col("o_custkey") * 2).alias("k"))
    return U.bulk_change(asked, t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("status")), "k", "status", ["BUILDING"])


@query("""WITH o AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS p_type FROM part), n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Brand#0' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS p_type FROM part),
j AS (SELECT o.p_partkey, 'p_brand' AS field, o.p_brand AS before, n.p_brand AS after FROM o JOIN n USING (p_partkey) UNION ALL SELECT o.p_partkey, 'p_type', o.p_type, n.p_type FROM o JOIN n USING (p_partkey))
SELECT *, CASE WHEN after IS NULL OR before IS NOT DISTINCT FROM after THEN 'unchanged' WHEN before IS NULL THEN 'updated' ELSE 'conflicting' END AS change FROM j""")
def refresh_changes(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    old = t.part.select("p_partkey", "p_brand", F.when(k % 3 == 0, None).otherwise(F.col("p_type")).alias("p_type"))
    new = t.part.select("p_partkey", F.when(k % 4 == 0, "Brand#0").otherwise(F.col("p_brand")).alias("p_brand"), F.when(k % 5 == 0, None).otherwise(F.col("p_type")).alias("p_type"))
    return U.refresh_diff(old, new, "p_partkey", ["p_brand", "p_type"])


@query("""WITH c AS (SELECT p_name AS k, p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE p_brand END AS brand, p_size FROM part)
SELECT k, min(seq) AS seq, coalesce(arg_min(brand, seq) FILTER (brand <> 'Unknown'), 'Unknown') AS brand, max(p_size) AS p_size, count(*) AS n_merged FROM c GROUP BY k""")
def merged_candidates(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_name").alias("k"), F.col("p_partkey").alias("seq"), F.when(F.col("p_partkey") % 3 == 0, "Unknown").otherwise(F.col("p_brand")).alias("brand"), "p_size")
    return U.merge_within_run(rows, "k", "seq", ["brand"], [], ["p_size"])


@query(r"""WITH RECURSIVE d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'), f AS (
SELECT user_id, min(day) AS day, min(day) AS head FROM d GROUP BY 1
UNION ALL SELECT f.user_id, n.day, CASE WHEN n.day - f.head <= 5 THEN f.head ELSE n.day END FROM f, LATERAL (SELECT min(day) AS day FROM d WHERE d.user_id = f.user_id AND d.day > f.day) n WHERE n.day IS NOT NULL)
SELECT e.event_id, e.user_id, f.head AS head_at FROM events e JOIN f ON e.user_id = f.user_id AND CAST(e.ts AS DATE) = f.day WHERE e.event_type = 'purchase'""")
def anchored_events(t: Tables) -> DataFrame:
    """Events within five days of the first of their group; groups are anchored, not chained."""
    return X.merged_events(t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), "user_id", "ts", days=5).select("event_id", "user_id", "head_at")


@query()
def independent_hosts(t: Tables) -> DataFrame:
    """How many pages of each language tell something new, in order of page."""
    rows = t.pages.select("page_id", host(F.col("url")).alias("host"), claim_fingerprint(readable_text(F.col("html"))).alias("fingerprint"), F.regexp_extract("html", 'lang="(\\w+)"', 1).alias("lang"))
    return independent_counts(rows, "lang", "page_id", "host", "fingerprint")


@query("""SELECT user_id, list_aggregate(list_sort(list_distinct(list(event_type))), 'string_agg', ',') AS seen, CASE WHEN list_contains(list(event_type), 'error') THEN 'has-error' ELSE 'clean' END AS state FROM events GROUP BY 1""")
def families_seen(t: Tables) -> DataFrame:
    seen = t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    return seen.select("user_id", F.array_join("s", ",").alias("seen"), F.when(F.array_contains("s", "error"), "has-error").otherwise("clean").alias("state"))


@query("""SELECT doc_id, CAST(len(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) > 3))) AS INTEGER) AS n_tokens FROM documents""")
def distinctive_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(name_tokens(F.col("text"))).alias("n_tokens"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'inactive' WHEN c_custkey % 8 = 0 THEN 'partner-review' WHEN c_acctbal < 0 THEN 'refresh' WHEN c_custkey % 5 = 0 THEN 'first-review' WHEN c_custkey % 4 = 0 THEN 'needs-data'
WHEN c_acctbal / 1000 >= 8 THEN 'prioritize' WHEN c_acctbal / 1000 >= 6.5 THEN 'track' ELSE 'monitor' END AS action FROM customer""")
def next_actions(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    status = F.when(k % 9 == 0, "Passed").when(k % 5 == 0, "new").otherwise("Monitor")
    return t.customer.select("c_custkey", X.next_action(status, F.when(k % 8 == 0, 1).otherwise(0), F.col("c_acctbal") < 0, k % 4 == 0, F.col("c_acctbal") / 1000).alias("action"))


def _entity_cases() -> str:
    return "CASE WHEN regexp_matches(name, '[’'']s\\s+[a-z]') THEN 'person-possessive' " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{label}'" for label, p in NON_COMPANY) + " END"


@query(f"""WITH n AS (SELECT s_suppkey, s_name || CASE s_suppkey % 9 WHEN 0 THEN ' Fund II' WHEN 1 THEN ' Partners, L.P.' WHEN 2 THEN ' University' WHEN 3 THEN '''s logistics startup' WHEN 4 THEN ' Institute of Things' WHEN 5 THEN ', a series of X' WHEN 6 THEN ' Academy' ELSE ' Labs' END AS name FROM supplier)
SELECT s_suppkey, {_entity_cases()} AS problem FROM n""")
def entity_types(t: Tables) -> DataFrame:
    """Names that aren't those of operating companies."""
    k = F.col("s_suppkey") % 9
    tail = F.when(k == 0, " Fund II").when(k == 1, " Partners, L.P.").when(k == 2, " University").when(k == 3, "'s logistics startup").when(k == 4, " Institute of Things").when(k == 5, ", a series of X").when(k == 6, " Academy").otherwise(" Labs")
    return t.supplier.select("s_suppkey", entity_problem(F.concat("s_name", tail)).alias("problem"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE floor(least(1.0::DOUBLE, CASE WHEN c_custkey % 3 = 0 THEN 0.4 WHEN c_custkey % 2 = 0 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN c_custkey % 5 = 0 THEN 0.15 ELSE 0 END::DOUBLE + least(0.3::DOUBLE, (c_custkey % 4) * 0.15::DOUBLE) + CASE WHEN c_custkey % 7 = 0 THEN 0.05 ELSE 0 END::DOUBLE) * 100 + 0.5) / 100 END AS confidence,
CASE WHEN c_custkey % 13 = 0 THEN 'terminal' WHEN c_custkey % 6 = 0 THEN 'duplicate' WHEN c_custkey % 5 = 0 THEN 'not-operating-company' WHEN c_custkey % 4 = 0 THEN 'outside-sector' WHEN c_acctbal < 0 THEN 'validation-failed' ELSE 'imported' END AS decision,
CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'guess' END AS vertical, CASE WHEN c_custkey % 3 = 0 THEN 'source' WHEN c_custkey % 2 = 0 THEN 'classifier' ELSE 'low-confidence' END AS reason FROM customer""")
def import_decisions(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    every = lambda n: k % n == 0
    level = F.when(every(3), "substantive").otherwise("thin")
    vertical = X.vertical_of(F.when(every(3), F.col("c_mktsegment")), F.lit("guess"), F.when(every(2), 0.8).otherwise(0.2))
    decision = X.import_decision(F.lit(True), F.when(every(13), "imported").otherwise("pending"), F.when(every(6), "exact").otherwise("none"), ~every(5), ~every(4), F.col("c_acctbal") >= 0)
    return t.customer.select("c_custkey", X.operating_confidence(level, every(2), k % 4, every(5), every(11), every(7)).alias("confidence"), decision.alias("decision"), vertical["vertical"].alias("vertical"), vertical["reason"].alias("reason"))


@query("""SELECT c_custkey, NOT (c_custkey % 7 = 0) AND NOT (c_custkey % 5 = 0) AS needs_diligence, NOT (c_custkey % 7 = 0) AND NOT (c_custkey % 5 = 0) AND c_acctbal / 1000 >= 6.5 AND c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AS eligible FROM customer""")
def promising_queue(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rows = t.customer.select(
        "c_custkey", F.lit(True).alias("thesis_eligible"), F.when(k % 7 == 0, 1).otherwise(0).alias("n_flags"), F.lit(False).alias("inactive"), F.lit(False).alias("duplicate"),
        F.lit(None).cast("string").alias("review_status"), (k % 5 != 0).alias("provisional"), F.array(F.lit("traction")).alias("missing_critical"), (F.col("c_acctbal") / 1000).alias("score"),
        F.when(k % 2 == 0, "high").alias("quality_band"), F.array(F.lit("data-moat")).alias("signals"), F.when(k % 3 == 0, 1990).otherwise(2000).alias("batch_year"),
    )
    return X.promising(rows, _today()).select("c_custkey", "needs_diligence", "eligible")


@query("""WITH r AS (SELECT p_partkey AS id, lower(p_type) AS v, lower(p_name) AS s FROM part), e AS (SELECT p_partkey AS name, lower(p_type) AS v, unnest([string_split(p_name, ' ')[-1], p_name || ' ' || p_brand]) AS theme, p_size FROM part WHERE p_size > 40),
k AS (SELECT DISTINCT s FROM r), t AS (SELECT DISTINCT theme FROM e), n AS (SELECT s, theme FROM k, t WHERE contains(s, lower(theme)) OR contains(lower(theme), s)),
c AS (SELECT s, count(DISTINCT name) AS themed, count(DISTINCT name) FILTER (p_size > 45) AS competitive, list_sort(list(DISTINCT theme)) AS shared FROM n JOIN e USING (theme) GROUP BY 1), w AS (SELECT v, count(DISTINCT name) AS n FROM e GROUP BY 1)
SELECT id, coalesce(w.n, 0) AS same_vertical, CASE WHEN coalesce(w.n, 0) = 0 THEN 'none' WHEN w.n / (SELECT count(DISTINCT name) FROM e) >= 0.2 THEN 'high' ELSE 'moderate' END AS concentration, coalesce(themed, 0) AS themed, 0::BIGINT AS partnership, coalesce(competitive, 0) AS competitive,
coalesce(array_to_string(shared, ','), '') AS shared_themes, CASE WHEN coalesce(w.n, 0) + coalesce(themed, 0) + coalesce(competitive, 0) > 0 THEN 'Medium' ELSE 'Low' END AS confidence FROM r LEFT JOIN c USING (s) LEFT JOIN w USING (v)""")
def portfolio_overlaps(t: Tables) -> DataFrame:
    """What a portfolio of the larger parts holds near every part, by type and by themes within names, either way round."""
    themes = F.array(F.element_at(F.split("p_name", " "), -1), F.concat("p_name", F.lit(" "), "p_brand"))
    none = F.array().cast("array<string>")
    ours = t.part.where("p_size > 40").select(F.col("p_partkey").alias("name"), F.col("p_type").alias("vertical"), themes.alias("themes"), none.alias("partnership_themes"), F.when(F.col("p_size") > 45, themes).otherwise(none).alias("competitive_themes"))
    found = M.portfolio_comparison(t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("vertical"), F.col("p_name").alias("subcategory")), ours, concentrated=0.2)
    return found.withColumn("shared_themes", F.array_join("shared_themes", ","))
