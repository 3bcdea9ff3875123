"""What a fetched page shows of an issuer: whose it is, and whether it tells of an operating business."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import java, once, trimmed
from .urls import host, readable_text

# What holding pages, offers, customers, organisations and holdings say, in lower case.
PARKED = (
    "domain is for sale", "buy this domain", "parked domain", "godaddy.com/domainfind", "this domain may be for sale", "coming soon", "under construction", "default web page", "welcome to nginx", "apache2 default",
    "is for sale", "domain for sale", "make an offer", "inquire about this domain", "this domain is available", "buy now for", "dan.com", "sedo.com", "afternic", "hugedomains", "domain parking", "checking your browser",
    "reserved for", "this page is parked", "future home of",
)
OFFERS = (
    "product", "products", "platform", "pricing", "plans", "features", "solutions", "services", "how it works", "what we do", "technology", "use cases", "integrations", "documentation", "developers", "api reference", "get started",
    "book a demo", "request a demo", "schedule a demo", "start free", "sign up", "our software", "our platform", "capabilities",
)
CUSTOMERS = ("customers", "case study", "case studies", "testimonial", "trusted by", "our clients", "partners", "success stories", "used by")
ORGANISATION = ("careers", "we are hiring", "we're hiring", "join our team", "our team", "about us", "leadership", "contact us", "privacy policy", "terms of service", "blog", "newsroom")
HOLDINGS = ("holding company", "investment holding", "holding group", "special purpose vehicle", "asset holding", "we hold interests", "portfolio of investments")
#: Readable characters of a page that says something, of one that serves anything, and of a page's head that tells it is parked.
SUBSTANTIVE, THIN, HEAD = 500, 200, 20_000
LEAST_WORDS, LEAST_LETTERS = 8, 30
# Legal words that hosts leave out of a name, and words that don't tell a name from others.
LEGAL = r"\b(inc|incorporated|corp|corporation|llc|l\.?l\.?c|ltd|limited|co|company|holdings?|group|technologies|technology|labs?|plc|gmbh)\b"
COMMON = r"\b(inc|incorporated|corp|corporation|llc|ltd|limited|co|company|holdings?|group|plc|gmbh|the|and)\b"
FRAGMENTS = r"(?<=[.!?])\s+|[|•·]|\s{2,}"
BARE_DOMAIN = r"^(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+\.?\z"


def issuer_stem(name: Column) -> Column:
    """Letters and digits of a name without its legal words."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), "[,.]", " "), java(LEGAL), " "), "[^a-z0-9]+", "")


def telling_words(name: Column) -> Column:
    """Words of four letters or more that tell a name from others."""
    return F.filter(F.split(F.regexp_replace(F.lower(name), java(COMMON), " "), "[^a-z0-9]+"), lambda w: F.length(w) > 3)


def markers(low: Column, words: tuple[str, ...]) -> Column:
    """Those of ``words`` that a lower-case text holds, in order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def is_parked(html: Column) -> Column:
    """Whether a page's head reads like a registrar's, or its title is a bare domain."""
    title = F.lower(trimmed(F.regexp_extract(html, r"(?is)<title[^>]*>(.{0,200}?)</title>", 1)))
    return once(F.lower(F.substring(html, 1, HEAD)), lambda low: F.size(markers(low, PARKED)) > 0) | title.rlike(BARE_DOMAIN)


def is_thin(html: Column) -> Column:
    return F.length(trimmed(F.regexp_replace(html, "<[^>]*>", ""))) < THIN


def names_company(low: Column, name: Column) -> Column:
    """Whether a lower-case text names the company: its stem, letters only, or else all of its telling words."""
    stem, words = issuer_stem(name), telling_words(name)
    return ((F.length(stem) >= 6) & F.contains(F.regexp_replace(low, "[^a-z0-9]+", ""), stem)) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(low, w)))


def spelt_host(url: Column, name: Column) -> Column:
    """Whether a site's host is spelt like the issuer: one stem within the other, or one of the name's telling words in it."""
    labels = F.split(host(url), r"\.")
    stem = F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), "")
    own = issuer_stem(name)
    within = (F.length(own) >= 4) & (stem.contains(own) | own.contains(stem))
    return F.coalesce((stem != "") & (within | F.exists(telling_words(name), lambda t: stem.contains(t))), F.lit(False))


def describes(text: Column, name: Column) -> Column:
    """Whether a line of eight words or more says something beside the name."""

    def line(f: Column) -> Column:
        letters = F.regexp_replace(F.lower(f), "[^a-z0-9]+", "")
        stem = issuer_stem(name)
        return (F.size(F.split(trimmed(f), r"\s+")) >= LEAST_WORDS) & (F.length(letters) - F.when(F.contains(letters, stem), F.length(stem)).otherwise(0) >= LEAST_LETTERS)

    return F.exists(F.filter(F.split(text, FRAGMENTS), lambda f: trimmed(f) != ""), line)


def site_evidence(html: Column, name: Column, url: Column) -> Column:
    """struct<level, identity_confirmed, offers, customers, organisation, descriptive, text_length> of a page.

    Parked and thin pages are found first, then pages of others; a page of
    the issuer's own is substantive if it offers something and describes it,
    undetermined if it does one of both, else it tells of identity only.
    Null pages have a null struct.
    """

    def of(text: Column) -> Column:
        return once(F.struct(text.alias("text"), F.lower(text).alias("low")), judged)

    def judged(x: Column) -> Column:
        return once(
            F.struct(
                F.length(x["text"]).alias("n"), markers(x["low"], OFFERS).alias("offers"), markers(x["low"], CUSTOMERS).alias("customers"), markers(x["low"], ORGANISATION).alias("organisation"),
                F.coalesce(describes(x["text"], name), F.lit(False)).alias("descriptive"), (F.size(markers(x["low"], HOLDINGS)) > 0).alias("holding"), F.coalesce(spelt_host(url, name) & names_company(x["low"], name), F.lit(False)).alias("own"),
            ),
            level,
        )

    def level(x: Column) -> Column:
        offers = F.size(x["offers"]) > 0
        own = F.when((x["holding"] & ~offers) | (x["n"] < SUBSTANTIVE), "identity-only").when(offers & x["descriptive"], "substantive").when(offers | x["descriptive"], "undetermined").otherwise("identity-only")
        found = F.when(is_parked(html), "parked").when(is_thin(html), "thin").when(~x["own"], "unrelated").otherwise(own)
        return once(found, lambda v: told(v, ~v.isin("parked", "thin", "unrelated"), x))

    def told(v: Column, identity: Column, x: Column) -> Column:
        some = lambda c: F.when(identity, x[c]).otherwise(F.array().cast("array<string>")).alias(c)
        return F.struct(v.alias("level"), identity.alias("identity_confirmed"), some("offers"), some("customers"), some("organisation"), (identity & x["descriptive"]).alias("descriptive"), x["n"].alias("text_length"))

    return F.when(html.isNotNull(), once(readable_text(html), of))
