"""Directory profiles: one record from a page whose parts are told apart by where they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .claims import claims_of
from .page_facts import is_founder_title
from .rules import collapsed, java, once, trimmed
from .urls import character

# The address of a profile, headings at which sections begin and end, the classes of their parts, and hosts that are never a company's own.
PROFILE_URL = r"(?i)^https?://(?:www\.)?ycombinator\.com/companies/([a-z0-9][a-z0-9-]*)/?\z"
FOUNDERS, LAUNCHES, CARD = r"(?i)Active\s+Founders", r"(?i)Company\s+Launches", r"(?i)Primary\s+Partner"
AFTER_FOUNDERS, AFTER_LAUNCHES = r"(?i)Company\s+Launches|Jobs at|Similar Companies|<footer", r"(?i)Similar\s+Companies|Jobs at|Active\s+Founders|<footer"
FOUNDER_NAME, FOUNDER_ROLE, FOUNDER_BIO, COMPANY_NAME, PROSE, TAG = "text-xl font-bold", "text-gray-600", "whitespace-pre-line", "text-xl font-medium", "prose", "ycdc-badge"
AFTER_CARD = r"(?i)Active\s+Founders|Company\s+Launches|Similar\s+Companies|Jobs at|<footer"
NOT_OWN = r"(?i)ycombinator\.com|linkedin\.com|twitter\.com|x\.com|facebook\.com|instagram\.com|github\.com|plus\.google|bookface|startupschool"
BLOCK = r"(?i)<\s*/?\s*(?:div|p|li|ul|ol|br|h[1-6]|section|tr|td|table|blockquote)\b[^>]*>"
ENTITIES = ((r"(?i)&#x27;|&#39;|&apos;", "'"), ("(?i)&quot;", '"'), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&#x2019;|&rsquo;", "’"))
PERSON = r"^\p{Lu}[\p{L}'’.-]*(?:\s+[\p{L}'’.-]+){1,3}\z"

_FOUNDER = "array<struct<full_name:string,role:string,bio:string,linkedin:string>>"


def _decoded(text: Column) -> Column:
    for pattern, char in ENTITIES:
        text = F.regexp_replace(text, pattern, char)
    codes = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(\d{1,7});"), F.lit(1))), lambda c: c.cast("int").between(1, 0x10FFFF))
    return F.aggregate(codes, text, lambda t, c: F.replace(t, F.concat(F.lit("&#"), c, F.lit(";")), character(c.cast("int"))))


def stripped(html: Column) -> Column:
    """Text on one line, without tags."""
    return collapsed(_decoded(F.regexp_replace(html, "<[^>]*>", " ")))


def lined(html: Column) -> Column:
    """Text with a line for each block, without addresses."""
    s = F.regexp_replace(_decoded(F.regexp_replace(F.regexp_replace(html, java(BLOCK), "\n"), "<[^>]*>", " ")), r"https?://\S+", " ")
    return trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r" ?\n ?", "\n"), r"\n{2,}", "\n"))


def of_class(html: Column, needle: str) -> Column:
    """Texts of the elements whose class holds ``needle``, in order; empty ones are left out."""
    found = F.regexp_extract_all(html, F.lit(rf'(?is)<(\w+)[^>]*class="[^"]*{needle}[^"]*"[^>]*>(.*?)</\1>'), F.lit(2))
    return F.filter(F.transform(found, stripped), lambda t: t != "")


def labelled(html: Column, label: str) -> Column:
    """The value beside a label: the element after its own, or else what follows a colon in the plain text."""
    beside = stripped(F.regexp_extract(html, rf"(?is){label}\s*:?\s*</[^>]+>(.{{0,300}}?)</div>", 1))
    flat = trimmed(F.regexp_extract(stripped(html), rf"{label}\s*:\s*([^:]{{1,60}}?)(?=\s{{2,}}|\s+[A-Z][a-z]+\s*:|$)", 1))
    return F.coalesce(F.nullif(beside, F.lit("")), F.nullif(flat, F.lit("")))


def _first(text: Column, n: Column) -> Column:
    return F.substring(text, F.lit(1), n)


def _onwards(text: str, at: str) -> Column:
    """``text`` from place ``at`` to its end."""
    return F.expr(f"substring({text}, {at})")


def _founders(section: Column) -> Column:
    parts = F.split(section, rf'(?i)<div[^>]*class="[^"]*{FOUNDER_NAME}[^"]*"[^>]*>', -1)

    def person(part: Column) -> Column:
        role, bio = F.get(of_class(part, FOUNDER_ROLE), F.lit(0)), F.get(of_class(part, FOUNDER_BIO), F.lit(0))
        link = F.regexp_extract(part, r'(?i)href="(https://(?:www\.)?linkedin\.com/in/[^"]+)"', 1)
        return F.struct(stripped(F.substring_index(part, "</div>", 1)).alias("full_name"), role.alias("role"), bio.alias("bio"), F.nullif(link, F.lit("")).alias("linkedin"))

    def each_once(people: Column) -> Column:
        key = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.lower(p["full_name"]), r"[^\p{L}\s]", ""), r"\s+", " "))
        keys = F.transform(people, key)
        firsts = F.filter(people, lambda p, i: F.array_position(keys, key(p)) == i + 1)
        return F.transform(firsts, lambda p: p.withField("role", F.when(F.length(p["role"]) <= 80, p["role"])))

    found = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), person)
    fit = F.filter(found, lambda p: p["full_name"].rlike(PERSON) & p["role"].isNotNull() & is_founder_title(p["role"]))
    return F.coalesce(once(fit, each_once), F.array().cast(_FOUNDER))


def profiles(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """(key, slug, name, website, batch, status, location, team_size, founded_year, description, launch_post, founders, tags) of pages that are profiles.

    Founders stand between their heading and the next, the company's site in
    the card below the partner's row, the launch post between its heading and
    the next; a description is prose outside the founders' section that is no
    founder's own. A part without a next heading lasts to the page's end, and
    all are read whole, however long. Each is found once, in a step of its
    own. Pages at other addresses, and null ones, are left out.
    """
    d = pages.select(key, F.regexp_extract(F.trim(url), PROFILE_URL, 1).alias("slug"), F.col(html).alias("_h")).where("slug <> '' and _h is not null").withColumn("slug", F.lower("slug"))
    h = F.col("_h")
    d = d.withColumns({"_at": F.regexp_instr(h, F.lit(FOUNDERS)), "_launch": F.regexp_instr(h, F.lit(LAUNCHES)), "_card": F.regexp_instr(h, F.lit(CARD))})
    d = d.withColumn("_rest", F.when(F.col("_at") > 0, _onwards("_h", "_at"))).withColumn("_end", F.regexp_instr("_rest", F.lit(AFTER_FOUNDERS)))
    d = d.withColumn("_section", F.when(F.col("_end") > 1, _first(F.col("_rest"), F.col("_end") - 1)).otherwise(F.col("_rest")))
    d = d.withColumns({"founders": _founders(F.col("_section")), "_slab": F.when(F.col("_launch") > 1, _onwards("_h", "_launch")), "_below": F.when(F.col("_card") > 1, _onwards("_h", "_card"))})
    d = d.withColumns({"_stop": F.regexp_instr(_onwards("_slab", "2"), F.lit(AFTER_LAUNCHES)), "_foot": F.regexp_instr("_below", F.lit(AFTER_CARD))})
    card = F.when(F.col("_foot") > 0, _first(F.col("_below"), F.col("_foot") - 1)).otherwise(F.coalesce("_below", F.lit("")))
    d = d.withColumn("_links", F.regexp_extract_all(card, F.lit(r'(?i)href="(https?://[^"]+)"'), F.lit(1)))
    launch = lined(F.when(F.col("_stop") > 1, _first(F.col("_slab"), F.col("_stop"))).otherwise(F.col("_slab")))
    before = F.when(F.col("_at") > 0, _first(h, F.col("_at") - 1)).otherwise(h)
    after = F.when(F.col("_at") > 0, _onwards("_h", "_at + length(_section)")).otherwise("")
    prose = F.filter(F.concat(of_class(before, PROSE), of_class(after, PROSE)), lambda t: (F.length(t) > 60) & ~F.coalesce(F.array_contains(F.transform("founders", lambda f: f["bio"]), t), F.lit(False)))
    whole = lambda c, pattern: F.when(c.rlike(pattern), c.cast("int"))
    return d.select(
        key, "slug", F.get(of_class(h, COMPANY_NAME), F.lit(0)).alias("name"), F.get(F.filter("_links", lambda u: ~u.rlike(NOT_OWN)), F.lit(0)).alias("website"), labelled(h, "Batch").alias("batch"), labelled(h, "Status").alias("status"),
        labelled(h, "Location").alias("location"), whole(labelled(h, "Team Size"), r"^\d{1,9}\z").alias("team_size"), whole(labelled(h, "Founded"), r"^\d{4}\z").alias("founded_year"), F.get(prose, F.lit(0)).alias("description"), launch.alias("launch_post"),
        "founders", F.array_distinct(of_class(h, TAG)).alias("tags"),
    )


def profile_claims(found: DataFrame, key: str) -> DataFrame:
    """Claims of traction of each profile, and whether they are the company's own; see ``claims.claims_of``."""
    told = found.withColumns({"_bios": F.array_join(F.transform("founders", lambda f: f["bio"]), "\n"), "_people": F.transform("founders", lambda f: f["full_name"])})
    return claims_of(told, key, {"launch-post": "launch_post", "description": "description", "founder-bio": "_bios"}, "name", "_people")
