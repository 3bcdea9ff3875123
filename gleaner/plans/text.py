"""Names, URLs, pages, amounts and rule sets over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import dates as D
from ..functions import names as N
from ..functions import site_evidence as E
from ..functions import urls as U
from ..functions.money import amount_usd, number, raise_bucket
from ..functions.rules import first_match
from ..functions.urls import host
from ..operators import aggregates as A
from ..operators.filters import EXCLUDED_BUSINESS, INACTIVE, MATURE_STAGE, eligibility, has_text, split_valid
from ..sources.feeds import display_name, relation
from ..sources.writers import csv_cell
from .registry import Tables, query

_SPACES = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SUFFIX = "|".join(N.CORPORATE_SUFFIXES)
_NAMES = """n AS (SELECT p_partkey, p_name || CASE p_partkey % 8 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Labs, LLC' WHEN 2 THEN ' & Bros. Intl' WHEN 3 THEN ' Tech Co' WHEN 4 THEN ' Mfg Grp' WHEN 5 THEN '''s Holdings PLC' WHEN 6 THEN ' (Svcs)' ELSE '' END AS name FROM part)"""


def _names(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 8
    tail = F.when(k == 0, ", Inc.").when(k == 1, " Labs, LLC").when(k == 2, " & Bros. Intl").when(k == 3, " Tech Co").when(k == 4, " Mfg Grp").when(k == 5, "'s Holdings PLC").when(k == 6, " (Svcs)").otherwise("")
    return t.part.select("p_partkey", F.concat("p_name", tail).alias("name"))


def _alias_sql(column: str) -> str:
    for pattern, full in N.ALIASES.items():
        column = f"regexp_replace({column}, '{pattern}', ' {full} ', 'g')"
    return column


@query(f"""WITH {_NAMES} SELECT p_partkey,
regexp_replace(trim(regexp_replace(regexp_replace({_alias_sql("lower(name)")}, '[.,''’"()‘“”!?:;/\\\\|]', ' ', 'g'), '\\s+', ' ', 'g')), '^(.+?)((?: (?:{_SUFFIX}))+)$', '\\1') AS company_key,
trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[.,''’]', '', 'g'), '\\b(inc|llc|ltd|corp|co|labs|technologies|tech)\\b', '', 'g'), '\\s+', ' ', 'g')) AS company_name,
trim(regexp_replace(regexp_replace(lower(name), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')) AS founder_key,
regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
regexp_replace(regexp_replace(lower(name), '\\b({_SUFFIX})\\b', '', 'g'), '[^a-z0-9]', '', 'g') AS domain_stem,
len(trim(name)) >= 3 AND len(regexp_split_to_array(trim(name), '\\s+')) >= 2 AS is_full_name FROM n""")
def name_keys(t: Tables) -> DataFrame:
    n = F.col("name")
    return _names(t).select("p_partkey", N.company_key(n).alias("company_key"), N.company_name(n).alias("company_name"), N.founder_key(n).alias("founder_key"), N.slug(n).alias("slug"), N.domain_stem(n).alias("domain_stem"), N.is_full_name(n).alias("is_full_name"))


@query(f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(translate(text, '{N.MARKED}', '{N.PLAIN}')), '[^a-z\\s-]', '', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents""")
def person_keys(t: Tables) -> DataFrame:
    """Keys of whole texts, read as names, by their digest."""
    return t.documents.select("doc_id", F.md5(N.person_key(F.col("text")).cast("binary")).alias("digest"))


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN len(s) >= 40 THEN s[1:120] ELSE '' END AS fingerprint FROM f""")
def claim_fingerprints(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", N.claim_fingerprint(F.col("text")).alias("fingerprint"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '')"


@query(f"""SELECT page_id, {_HOST} AS host, {_HOST} || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS normal_url, {_HOST} AS domain_key, {_HOST} AS normal_domain,
CASE WHEN page_id % 7 = 0 THEN 'malformed-url' WHEN page_id % 7 = 1 THEN 'not-http' WHEN page_id % 7 = 2 THEN 'credentials-in-url' WHEN page_id % 7 = 3 THEN 'bare-ip' WHEN page_id % 7 = 4 THEN 'no-domain' END AS problem,
page_id % 7 <> 3 AS outside FROM pages""")
def url_keys(t: Tables) -> DataFrame:
    """Hosts and keys of URLs, and what is wrong with spoilt ones."""
    u, k = F.col("url"), F.col("page_id") % 7
    spoilt = F.when(k == 0, "no url at all").when(k == 1, "ftp://a.example.com/x").when(k == 2, "https://me:pw@a.example.com/").when(k == 3, "http://10.0.0.7/x").when(k == 4, "http://intranet/x").otherwise(u)
    outside = F.when(k == 3, U.is_outside_host(spoilt)).otherwise(U.is_outside_host(u))
    return t.pages.select("page_id", U.host(u).alias("host"), U.normal_url(u).alias("normal_url"), U.domain_key(u).alias("domain_key"), U.normal_domain(u).alias("normal_domain"), U.url_problem(spoilt).alias("problem"), outside.alias("outside"))


def _strip_sql(column: str) -> str:
    for tag in ("script", "style", "noscript", "template"):
        column = f"regexp_replace({column}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g')"
    column = f"regexp_replace(regexp_replace({column}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    column = f"regexp_replace({column}, '(?i)&(?:nbsp|amp|quot|#39|lt|gt);', ' ', 'g')"
    return f"trim(regexp_replace({column}, '{_SPACES}+', ' ', 'g'))"


@query(f"""SELECT page_id, md5({_strip_sql("html")}) AS digest, len({_strip_sql("html")}) AS n_chars, regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1) AS title,
len(regexp_extract_all(html, '(?is)<a(?:\\s[^>]*)?>(.*?)</a>', 1)) AS n_links FROM pages""")
def readable_pages(t: Tables) -> DataFrame:
    text = U.readable_text(F.col("html"))
    return t.pages.select("page_id", text.alias("s"), "html").select("page_id", F.md5(F.col("s").cast("binary")).alias("digest"), F.length("s").cast("long").alias("n_chars"), F.coalesce(U.tag_content(F.col("html"), "title"), F.lit("")).alias("title"), F.size(U.tag_contents(F.col("html"), "a")).cast("long").alias("n_links"))


@query(f"""WITH h AS (SELECT {_HOST} AS host FROM pages) SELECT host, count(*) AS n FROM h GROUP BY 1""")
def pages_by_host(t: Tables) -> DataFrame:
    return A.histogram(t.pages.select(U.host(F.col("url")).alias("host")), "host")


_AMOUNT_SQL = """o AS (SELECT o_orderkey, 'raised ' || CASE o_orderkey % 6 WHEN 0 THEN '$' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || 'k' WHEN 1 THEN '$' || CAST(o_orderkey % 90 AS VARCHAR) || '.5M seed'
WHEN 2 THEN '$ 2 billion' WHEN 3 THEN '$1,250,000' WHEN 4 THEN 'nothing' ELSE '$7 thousand' END || ' today' AS s FROM orders)"""


@query(f"""WITH {_AMOUNT_SQL}, e AS (SELECT o_orderkey, s, regexp_extract(s, '(?i)\\$\\s?([\\d,]+(?:\\.\\d+)?)\\s*(k|m|b|million|billion|thousand)?', 1) AS d, lower(regexp_extract(s, '(?i)\\$\\s?([\\d,]+(?:\\.\\d+)?)\\s*(k|m|b|million|billion|thousand)?', 2)) AS u FROM o),
v AS (SELECT o_orderkey, s, try_cast(replace(d, ',', '') AS DOUBLE) AS n, u FROM e)
SELECT o_orderkey, CASE WHEN n > 0 THEN n * CASE u[1] WHEN 'k' THEN 1000 WHEN 't' THEN 1000 WHEN 'm' THEN 1000000 WHEN 'b' THEN 1000000000 ELSE 1 END END AS usd,
CASE WHEN n IS NULL THEN NULL WHEN n * CASE u WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END < 1000000 THEN '$0-1,000,000' WHEN n * CASE u WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END < 5000000 THEN '$1,000,000-5,000,000'
WHEN n * CASE u WHEN 'm' THEN 1000000 ELSE 1 END < 10000000 THEN '$5,000,000-10,000,000' WHEN n * CASE u WHEN 'm' THEN 1000000 ELSE 1 END < 20000000 THEN '$10,000,000-20,000,000' ELSE '$20,000,000+' END AS bucket FROM v""")
def stated_amounts(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 6
    said = F.when(k == 0, F.concat(F.lit("$"), F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("k"))).when(k == 1, F.concat(F.lit("$"), (F.col("o_orderkey") % 90).cast("string"), F.lit(".5M seed"))).when(k == 2, "$ 2 billion").when(k == 3, "$1,250,000").when(k == 4, "nothing").otherwise("$7 thousand")
    rows = t.orders.select("o_orderkey", F.concat(F.lit("raised "), said, F.lit(" today")).alias("s"))
    return rows.select("o_orderkey", amount_usd(F.col("s")).alias("usd"), raise_bucket(F.col("s")).alias("bucket"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS long_form, CAST(o_orderdate AS DATE) AS feed_form,
CAST(make_date(2000 + CAST(o_orderkey % 30 AS INTEGER), CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 9 END, 1) AS DATE) AS batch,
strftime(o_orderdate, '%B %-d, %Y') AS shown, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS INTEGER) AS age FROM orders""")
def parsed_dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    season = F.element_at(F.array(*map(F.lit, ("W", "SP", "S", "F"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    batch = F.concat(season, F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0"))
    return t.orders.select(
        "o_orderkey",
        D.iso_date(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"),
        D.iso_date(F.date_format(d, "MMMM d, yyyy")).alias("long_form"),
        D.feed_timestamp(F.date_format(d, "EEE, d MMM yyyy HH:mm:ss '+0000'")).cast("date").alias("feed_form"),
        D.batch_date(batch).alias("batch"),
        D.long_date(d).alias("shown"),
        D.days_between(d, F.lit("2001-08-01")).alias("age"),
    )


_SAID = """c AS (SELECT doc_id, source, lang, text || CASE doc_id % 9 WHEN 1 THEN ' We are an agency.' WHEN 2 THEN ' It raised $250 million.' WHEN 3 THEN ' Status: inactive' WHEN 4 THEN ' Series C closed.' WHEN 5 THEN ' They offer staff augmentation.' ELSE '' END AS said FROM documents)"""


def _said(t: Tables):
    k = F.col("doc_id") % 9
    tail = F.when(k == 1, " We are an agency.").when(k == 2, " It raised $250 million.").when(k == 3, " Status: inactive").when(k == 4, " Series C closed.").when(k == 5, " They offer staff augmentation.").otherwise("")
    return t.documents.select("doc_id", "source", "lang", F.concat("text", tail).alias("said"))


def _cases(rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(said, '{p.replace(chr(39), chr(39) * 2)}') THEN '{label}'" for label, p in rules) + " END"


@query(f"""WITH {_SAID}, r AS (SELECT doc_id, {_cases(EXCLUDED_BUSINESS)} AS excluded, {_cases(MATURE_STAGE)} AS mature, {_cases(INACTIVE)} AS inactive, lang = 'de' AS outside, source IN ('src3', 'src4') AS unapproved, doc_id % 13 = 0 AS duplicate FROM c)
SELECT doc_id, excluded, mature, inactive, (excluded IS NOT NULL)::INT + (mature IS NOT NULL)::INT + (inactive IS NOT NULL)::INT + outside::INT + unapproved::INT + duplicate::INT + (doc_id % 10 < 3)::INT AS n_rejections,
(excluded IS NOT NULL)::INT + (mature IS NOT NULL)::INT + (inactive IS NOT NULL)::INT + outside::INT + unapproved::INT + duplicate::INT + (doc_id % 10 < 3)::INT = 0 AS eligible FROM r""")
def thesis_eligibility(t: Tables) -> DataFrame:
    """Eight checks that reject, pass or can't tell."""
    rows = _said(t).select(
        "doc_id",
        "said",
        F.col("source").alias("vertical"),
        F.lit("Seed").alias("stage"),
        F.col("lang").alias("hq_state"),
        F.lit("news").alias("source_id"),
        ((F.col("doc_id") % 10) / 10).alias("confidence"),
        F.lit("a pitch").alias("pitch"),
        F.when(F.col("doc_id") % 13 == 0, "exact").otherwise("none").alias("duplicate_status"),
        F.lit(None).cast("string").alias("entity_problem"),
    )
    said = F.col("said")
    verticals = [f"src{i}" for i in range(200) if i not in (3, 4)]
    out = eligibility(rows, said, ["en", "fr", "es"], verticals)
    return out.select("doc_id", "found.*", F.size("rejections").alias("n_rejections"), "eligible")


@query("SELECT doc_id FROM documents WHERE contains(lower(source || ' ' || text), 'license')")
def free_text_search(t: Tables) -> DataFrame:
    return t.documents.where(has_text(" License ", "source", "text")).select("doc_id")


@query("""WITH s AS (SELECT doc_id, regexp_replace(text, '(?i)\\b(?:sk-[A-Za-z0-9_-]{8,}|bearer\\s+[A-Za-z0-9._-]{8,}|(?:api[_-]?key|token|secret|password)\\s*[=:]\\s*\\S+)', '[redacted]', 'g') AS s FROM documents) SELECT doc_id, md5(s) AS digest, contains(s, '[redacted]') AS changed FROM s""")
def secret_redaction(t: Tables) -> DataFrame:
    s = C.without_secrets(F.col("text"))
    return t.documents.select("doc_id", F.md5(s.cast("binary")).alias("digest"), s.contains("[redacted]").alias("changed"))


_RULES = {"legal": [(r"(?i)\blicensed?\b", 3), (r"(?i)\brights reserved\b", 3)], "contact": [(r"@[a-z0-9]+\.", 3), (r"\b\d{3}-\d{4}\b", 1)], "table": [(r" \| ", 3), (r"\d", 1)]}


def _score_sql(patterns) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END" for p, w in patterns) + ")"


@query(f"""WITH s AS (SELECT doc_id, {_score_sql(_RULES["legal"])} AS a, {_score_sql(_RULES["contact"])} AS b, {_score_sql(_RULES["table"])} AS c FROM documents),
m AS (SELECT *, greatest(a, b, c) AS top, list_sort([a, b, c], 'DESC')[2] AS second FROM s)
SELECT doc_id, CASE WHEN top < 3 THEN NULL WHEN a = top THEN 'legal' WHEN b = top THEN 'contact' ELSE 'table' END AS label, top AS score,
CASE WHEN top < 3 THEN 0 ELSE floor((0.5::DOUBLE * least(1.0::DOUBLE, top / 6) + 0.5::DOUBLE * ((top - second) / top)) * 100 + 0.5) / 100 END AS confidence FROM m""")
def rule_classes(t: Tables) -> DataFrame:
    """Weighted rule sets with a confidence from the score and its lead."""
    return t.documents.select("doc_id", C.classified(F.col("text"), _RULES).alias("c")).select("doc_id", "c.*")


@query("""SELECT doc_id, ((contains(lower(text), 'license'))::INT + (contains(lower(text), 'work'))::INT) * ((contains(lower(text), 'public'))::INT + 1) AS score FROM documents""")
def sector_signal(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.does_and_pays(F.col("text"), ["license", "work"], ["public"]).alias("score"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Pre-seed' WHEN 1 THEN 'Seed' WHEN 2 THEN 'Series A' WHEN 3 THEN 'Series B+' END AS stage,
CASE c_custkey % 3 WHEN 0 THEN 'CEO' WHEN 1 THEN 'CTO' END AS role, CASE c_custkey % 4 WHEN 0 THEN 'officer' WHEN 1 THEN 'director' WHEN 2 THEN 'promoter' ELSE 'other' END AS relation,
'Acme ' || c_custkey || ' Corp' AS issuer, CAST(c_custkey AS VARCHAR) AS cik, CASE WHEN c_custkey % 2 = 0 THEN 'ACME' END AS ticker FROM customer""")
def stated_roles(t: Tables) -> DataFrame:
    """Rounds, roles, relations and filer names read from phrases."""
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (F.col("c_custkey") % n + 1).cast("int"))
    round_ = pick(5, "a pre-seed of note", "its Seed round", "a series A led by", "the Series D", "no round")
    title = pick(3, "Chief Executive Officer", "co-founder & CTO", "engineer")
    role = pick(4, "Executive Officer", "Director", "Promoter", "Trustee")
    shown = F.concat(F.lit("Acme "), F.col("c_custkey").cast("string"), F.lit(" Corp"), F.when(F.col("c_custkey") % 2 == 0, "  (ACME)").otherwise(""), F.lit("  (CIK "), F.col("c_custkey").cast("string"), F.lit(")"))
    name = display_name(shown)
    return t.customer.select("c_custkey", C.stage_of(round_).alias("stage"), C.role_of(title).alias("role"), relation(role).alias("relation"), name["name"].alias("issuer"), name["cik"].alias("cik"), name["ticker"].alias("ticker"))


@query("""WITH x AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '=' || text WHEN 1 THEN text || ', "x"' ELSE text END AS s FROM conversations),
y AS (SELECT conv_id, turn, regexp_replace(s, '[\\r\\n]+', ' ', 'g') AS s FROM x), z AS (SELECT conv_id, turn, CASE WHEN regexp_matches(s, '^[=+\\-@]') THEN '''' || s ELSE s END AS s FROM y)
SELECT conv_id, turn, md5(CASE WHEN regexp_matches(s, '[,;"\\t]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END) AS cell FROM z""")
def csv_cells(t: Tables) -> DataFrame:
    k = F.col("turn") % 4
    s = F.when(k == 0, F.concat(F.lit("="), "text")).when(k == 1, F.concat("text", F.lit(', "x"'))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.md5(csv_cell(s).cast("binary")).alias("cell"))


@query("SELECT c_custkey, c_acctbal < 0 AS no_balance, c_custkey % 11 = 0 AS no_name FROM customer WHERE c_acctbal < 0 OR c_custkey % 11 = 0")
def rejected_rows(t: Tables) -> DataFrame:
    """Rows that fail their checks, with what they fail."""
    named = F.when(F.col("c_custkey") % 11 == 0, None).otherwise(F.col("c_name"))
    _, bad = split_valid(t.customer, {"balance": F.col("c_acctbal") >= 0, "name": named.isNotNull()})
    return bad.select("c_custkey", F.array_contains("issues", "balance").alias("no_balance"), F.array_contains("issues", "name").alias("no_name"))


@query(f"""SELECT doc_id, regexp_replace(trim(regexp_replace(text, '{_SPACES}+', ' ', 'g')), '^(.{{279}}).{{2,}}$', '\\1…') AS support, CASE WHEN regexp_matches(regexp_replace(text, '[^0-9.]', '', 'g'), '^\\d{{1,9}}(\\.\\d+)?$') AND CAST(regexp_replace(text, '[^0-9.]', '', 'g') AS DOUBLE) > 0 THEN CAST(regexp_replace(text, '[^0-9.]', '', 'g') AS DOUBLE) END AS figure FROM documents""")
def shortened_support(t: Tables) -> DataFrame:
    """Support shown to a reader, cut with an ellipsis, and the figure that the whole text holds, if it is one."""
    s = F.col("text")
    digits = F.regexp_replace(s, "[^0-9.]", "")
    return t.documents.select("doc_id", N.shortened(s).alias("support"), F.when(digits.rlike(r"^\d{1,9}(\.\d+)?$"), number(s)).alias("figure"))


_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{label}' END" for label, p in C.INJECTION_FLAGS) + "], lambda f: f IS NOT NULL)"


@query(f"""WITH d AS (SELECT doc_id, text AS x, list_filter(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s) <> '') AS parts,
list_distinct(list_concat(regexp_extract_all(text, '\\$[\\d,.]+[kKmMbB]?'), regexp_extract_all(text, '\\d+(?:\\.\\d+)?%'))) AS figures FROM documents)
SELECT doc_id, CAST(len(parts) AS INTEGER) AS n_sentences, array_to_string({_FLAGS}, ',') AS flags, CAST(len(list_filter(figures, lambda f: f NOT IN ('$1', '$', '1'))) AS INTEGER) AS n_unsupported FROM d""")
def text_facts(t: Tables) -> DataFrame:
    """Sentences, phrases that try to instruct their reader, and figures that an allowed text doesn't hold."""
    s = F.col("text")
    return t.documents.select("doc_id", F.size(C.sentences(s)).alias("n_sentences"), F.array_join(C.flags(s), ",").alias("flags"), F.size(C.unsupported(s, F.lit("$1"))).alias("n_unsupported"))


def _seen_sql(column: str) -> str:
    for p in C.UNSEEN:
        column = f"regexp_replace({column}, '{p.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    for entity, char in C.ENTITIES:
        column = f"replace({column}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({column}, '{C.NO_WIDTH}', '', 'g'), '[ \\t\\r\\f\\v]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_SPACES}+|{_SPACES}+$', '', 'g')"


@query(f"""WITH d AS (SELECT page_id, {_seen_sql("html")} AS x FROM pages) SELECT page_id, CASE WHEN len(x) > 8000 THEN md5(x[1:8000] || chr(10) || '[truncated at 8000 characters]') ELSE md5(x) END AS digest, array_to_string({_FLAGS}, ',') AS flags, len(x) > 8000 AS truncated FROM d""")
def sanitised_pages(t: Tables) -> DataFrame:
    """What a model may be shown of every page."""
    shown = t.pages.withColumn("s", C.sanitised(F.col("html")))
    return shown.select("page_id", F.md5(F.col("s.text").cast("binary")).alias("digest"), F.array_join("s.flags", ",").alias("flags"), "s.truncated")


_WRAPS = ("{{j}}", "Sure, here it is:\n```json\n{{j}}\n```\nAnything else?", "The answer is {{j}} as asked.", "I can't help with that.", "```{{j}}```", "", "{{j}} and {{j}}")


@query(r"""WITH e AS (SELECT event_id, json_object('user', user_id, 'value', value, 'props', props::JSON)::VARCHAR AS j FROM events),
r AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN j WHEN 1 THEN 'Sure, here it is:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' || chr(10) || 'Anything else?' WHEN 2 THEN 'The answer is ' || j || ' as asked.' WHEN 3 THEN 'I can''t help with that.' WHEN 4 THEN '```' || j || '```' WHEN 5 THEN '' ELSE j || ' and ' || j END AS raw FROM e),
b AS (SELECT event_id, trim(raw) AS t, CASE WHEN regexp_matches(raw, '(?is)```(?:json)?\s*.*?```') THEN trim(regexp_extract(raw, '(?is)```(?:json)?\s*(.*?)```', 1), ' ' || chr(10)) ELSE trim(raw) END AS x FROM r),
c AS (SELECT *, CASE WHEN json_valid(x) THEN x WHEN json_valid(regexp_extract(x, '(?s)\{.*\}')) THEN regexp_extract(x, '(?s)\{.*\}') END AS j FROM b)
SELECT event_id, CAST(json_extract(j, '$.user') AS BIGINT) AS user_id, CAST(json_extract(j, '$.props.k') AS BIGINT) AS k, CASE WHEN t = '' THEN 'empty' WHEN j IS NULL THEN 'not-json' END AS error FROM c""")
def model_answers(t: Tables) -> DataFrame:
    """Answers of a model that hold an event as JSON, bare, fenced, in prose or not at all."""
    j = F.to_json(F.struct(F.col("user_id").alias("user"), "value", F.from_json("props", "struct<k:long>").alias("props")))
    raw = F.element_at(F.array(*map(F.lit, _WRAPS)), (F.col("event_id") % len(_WRAPS) + 1).cast("int"))
    said = t.events.withColumn("m", C.model_json(F.replace(raw, F.lit("{{j}}"), j)))
    parsed = F.from_json("m.json", "user long, props struct<k:long>")
    return said.select("event_id", parsed["user"].alias("user_id"), parsed["props"]["k"].alias("k"), F.col("m.error").alias("error"))


_NAMED = "upper(label[1:1]) || label[2:]"
_STEM = f"regexp_replace(regexp_replace(regexp_replace(lower(name), '[,.]', ' ', 'g'), '{E.LEGAL}', ' ', 'g'), '[^a-z0-9]+', '', 'g')"
_TELLING = f"list_filter(string_split_regex(regexp_replace(lower(name), '{E.COMMON}', ' ', 'g'), '[^a-z0-9]+'), lambda w: len(w) > 3)"
_HOLDS = lambda column, words: "len(list_filter([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"], lambda w: contains({column}, w)))"
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.{0,200}?)</title>', 1)"


@query(f"""WITH a AS (SELECT page_id, url, html, {_strip_sql("html")} AS s, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS h, {_TITLE} AS title FROM pages),
b AS (SELECT *, string_split(h, '.')[1] AS label, regexp_extract(title, '[A-Za-z]+') AS w FROM a), c AS (SELECT *, CASE page_id % 3 WHEN 0 THEN {_NAMED} WHEN 1 THEN w ELSE {_NAMED} || ' Holdings, Inc.' END AS name, lower(s) AS low FROM b),
d AS (SELECT *, {_STEM} AS stem, {_TELLING} AS words, array_to_string(string_split(h, '.')[1:greatest(len(string_split(h, '.')) - 1, 1)], '') AS hs FROM c),
e AS (SELECT *, coalesce(hs <> '' AND ((len(stem) >= 4 AND (contains(hs, stem) OR contains(stem, hs))) OR len(list_filter(words, lambda w: contains(hs, w))) > 0), FALSE) AND ((len(stem) >= 6 AND contains(regexp_replace(low, '[^a-z0-9]+', '', 'g'), stem)) OR (len(words) > 0 AND len(list_filter(words, lambda w: NOT contains(low, w))) = 0)) AS own,
list_filter(string_split_regex(regexp_replace(s, '([.!?])\\s+', '\\1|', 'g'), '[|•·]|\\s{{2,}}'), lambda f: trim(f) <> '') AS lines, {_HOLDS("low", E.OFFERS)} AS offers, {_HOLDS("low", E.CUSTOMERS)} AS customers, {_HOLDS("low", E.HOLDINGS)} > 0 AS holding FROM d),
f AS (SELECT *, len(list_filter(list_transform(lines, lambda f: {{'n': len(string_split_regex(trim(f), '\\s+')), 'l': regexp_replace(lower(f), '[^a-z0-9]+', '', 'g')}}), lambda x: x.n >= 8 AND len(x.l) - CASE WHEN contains(x.l, stem) THEN len(stem) ELSE 0 END >= 30)) > 0 AS descriptive FROM e),
g AS (SELECT *, CASE WHEN {_HOLDS("lower(html[1:20000])", E.PARKED)} > 0 OR regexp_matches(lower(trim(title)), '^(?:www\\.)?[a-z0-9-]+(?:\\.[a-z0-9-]+)+\\.?$') THEN 'parked' WHEN len(trim(regexp_replace(html, '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))) < 200 THEN 'thin' WHEN NOT own THEN 'unrelated'
WHEN (holding AND offers = 0) OR len(s) < 500 THEN 'identity-only' WHEN offers > 0 AND descriptive THEN 'substantive' WHEN offers > 0 OR descriptive THEN 'undetermined' ELSE 'identity-only' END AS level FROM f)
SELECT page_id, level, CAST(CASE WHEN level IN ('parked', 'thin', 'unrelated') THEN 0 ELSE offers END AS INTEGER) AS n_offers, CAST(CASE WHEN level IN ('parked', 'thin', 'unrelated') THEN 0 ELSE customers END AS INTEGER) AS n_customers, CAST(len(s) AS INTEGER) AS text_length FROM g""")
def page_signals(t: Tables) -> DataFrame:
    """What every page shows of an issuer that is named by its host or its title."""
    label = F.initcap(F.substring_index(host(F.col("url")), ".", 1))
    title = F.regexp_extract(F.regexp_extract("html", r"(?is)<title[^>]*>(.{0,200}?)</title>", 1), "[A-Za-z]+", 0)
    k = F.col("page_id") % 3
    rows = t.pages.withColumn("name", F.when(k == 0, label).when(k == 1, title).otherwise(F.concat(label, F.lit(" Holdings, Inc."))))
    found = rows.withColumn("e", E.site_evidence(F.col("html"), F.col("name"), F.col("url")))
    return found.select("page_id", "e.level", F.size("e.offers").alias("n_offers"), F.size("e.customers").alias("n_customers"), "e.text_length")
