"""Feeds, filings, directories and CSV files as typed rows.

Nothing here fetches: texts land in storage first, and these functions read
them with Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import feed_timestamp
from ..functions.money import number
from ..functions.urls import decoded, host, tag_content, tag_contents, url_problem

SOCIAL_HOSTS = ("twitter.com", "x.com", "facebook.com", "linkedin.com", "instagram.com", "youtube.com", "t.co")


def feed_items(feeds: DataFrame, xml: str = "xml", feed: str = "feed", most_links: int = 12) -> DataFrame:
    """(feed, title, link, published_at, body, links, rejection) of RSS and Atom feeds, one row per item.

    The longest of the bodies counts; links out of the body leave the feed's
    own host and social sites out. Items without a title or usable link have
    a reason in ``rejection``.
    """
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:item|entry)(?:\s[^>]*)?>(.*?)</(?:item|entry)>"), F.lit(1))
    items = feeds.select(F.col(feed).alias("feed"), F.explode(blocks).alias("x"))
    x = F.col("x")
    bodies = F.array(*(F.coalesce(decoded(tag_content(x, t)), F.lit("")) for t in ("content:encoded", "content", "description", "summary")))
    body = F.element_at(F.array_sort(bodies, lambda a, b: F.length(b) - F.length(a)), 1)
    link = F.coalesce(F.nullif(decoded(tag_content(x, "link")), F.lit("")), F.nullif(F.regexp_extract(x, r"""(?is)<link[^>]+href=["']([^"']+)["']""", 1), F.lit("")))
    date = F.coalesce(*(tag_content(x, t) for t in ("pubDate", "dc:date", "published", "updated", "date")))
    found = F.regexp_extract_all(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&quot;"), F.lit('"')), F.lit(r"""(?i)href=["'](https?://[^"']+)["']"""), F.lit(1))
    rows = items.select("feed", decoded(tag_content(x, "title")).alias("title"), link.alias("link"), feed_timestamp(date).alias("published_at"), body.alias("body"), found.alias("links"))
    outward = F.filter(F.array_distinct("links"), lambda u: ~host(u).isin(*SOCIAL_HOSTS) & ~host(u).eqNullSafe(host(F.col("link"))))
    rejection = F.when(F.coalesce(F.col("title"), F.lit("")) == "", "no-title").otherwise(url_problem(F.col("link")))
    return rows.withColumn("links", F.slice(outward, 1, most_links)).withColumn("rejection", rejection)


def feed_report(items: DataFrame) -> DataFrame:
    """Per feed: items, kept ones, failure rate and a count for each reason."""
    reasons = items.groupBy("feed", "rejection").agg(F.count(F.lit(1)).alias("n"))
    return reasons.groupBy("feed").agg(
        F.sum("n").alias("items"),
        F.sum(F.when(F.col("rejection").isNull(), F.col("n")).otherwise(0)).alias("kept"),
        F.round(1 - F.sum(F.when(F.col("rejection").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 2).alias("failure_rate"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("rejection").isNotNull(), F.struct("rejection", "n"))))).alias("reasons"),
    )


def filings(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """Offering filings: issuer, place, amounts, industry, pooled fund flag and related persons."""
    x = F.col(xml)
    text = lambda tag: F.nullif(F.trim(decoded(tag_content(x, tag))), F.lit(""))
    people = F.transform(
        tag_contents(x, "relatedPersonInfo"),
        lambda p: F.struct(
            F.concat_ws(" ", tag_content(p, "firstName"), tag_content(p, "lastName")).alias("name"),
            F.transform(tag_contents(p, "relationship"), F.lower).alias("roles"),
        ),
    )
    # The first of each name, whatever its case.
    once = F.filter(people, lambda p, i: F.array_position(F.transform(people, lambda q: F.lower(q["name"])), F.lower(p["name"])) == i + 1)
    industry = text("industryGroupType")
    return rows.select(
        *rows.columns,
        text("entityName").alias("issuer"),
        text("city").alias("city"),
        text("stateOrCountry").alias("state"),
        number(text("totalOfferingAmount")).alias("offering_usd"),
        number(text("totalAmountSold")).alias("sold_usd"),
        industry.alias("industry"),
        F.coalesce(industry.rlike("(?i)pooled investment fund"), F.lit(False)).alias("is_pooled_fund"),
        F.to_date(text("signatureDate")).alias("signed_on"),
        once.alias("people"),
    )


def relation(role: Column) -> Column:
    """Officer, director, promoter or other."""
    r = F.lower(role)
    return F.when(r.contains("officer"), "officer").when(r.contains("director"), "director").when(r.contains("promoter"), "promoter").otherwise("other")


def awards(rows: DataFrame, json: str = "json") -> DataFrame:
    """Awards from a JSON array, or from an object that holds one under ``results``."""
    item = "struct<firm:string,award_amount:string,proposal_award_date:string,state:string,award_title:string>"
    listed = F.ltrim(json).startswith("[")
    many = F.when(listed, F.from_json(json, f"array<{item}>")).otherwise(F.from_json(json, f"struct<results:array<{item}>>")["results"])
    out = rows.select(F.explode(many).alias("a")).where("a.firm is not null")
    date = F.when(F.col("a.proposal_award_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date("a.proposal_award_date"))
    return out.select(F.col("a.firm").alias("firm"), number(F.col("a.award_amount")).alias("amount_usd"), date.alias("awarded_on"), F.when(F.col("a.state").rlike("^[A-Za-z]{2}$"), F.upper("a.state")).alias("state"), F.col("a.award_title").alias("title"))


def display_name(text: Column) -> Column:
    """struct<name, cik, ticker> of "Name  (TICK)  (CIK 0000123)"."""
    cik = F.nullif(F.regexp_extract(text, r"\(CIK\s+(\d+)\)", 1), F.lit(""))
    ticker = F.nullif(F.regexp_extract(text, r"\(([A-Z]{1,5}(?:,\s*[A-Z.]{1,6})*)\)\s*\(CIK", 1), F.lit(""))
    name = F.trim(F.regexp_replace(text, r"\s*\((?:CIK\s+\d+|[A-Z]{1,5}(?:,\s*[A-Z.]{1,6})*)\)", ""))
    return F.struct(name.alias("name"), cik.alias("cik"), ticker.alias("ticker"))


def csv_rows(spark: SparkSession, path: str, columns: list[str], refused: tuple[str, ...] = ("race", "ethnicity", "gender", "age", "religion")) -> DataFrame:
    """A CSV file with a header, all cells trimmed text; files with demographic columns are refused."""
    header = [c.lower().strip() for c in spark.read.option("header", True).csv(path).columns]
    if any(r in header for r in refused):
        raise ValueError("demographic columns aren't taken")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("enforceSchema", False).schema(schema).csv(path)


def validated_json(rows: DataFrame, json: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, rejected rows with a reason): parse errors and missing required fields are rejected."""
    parsed = rows.withColumn("_p", F.from_json(json, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    missing = F.array_compact(F.array(*(F.when(F.col(f"_p.{c}").isNull(), F.lit(c)) for c in required)))
    reason = F.when(F.col("_p").isNull() | F.col("_p._bad").isNotNull(), "invalid-response").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    marked = parsed.withColumn("reason", reason)
    return marked.where("reason is null").select("_p.*").drop("_bad"), marked.where("reason is not null").select(json, "reason")
