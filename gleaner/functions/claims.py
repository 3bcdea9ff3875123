"""Traction claims of a text, and whose story they tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import collapsed, found_in, java, matches, once, trimmed, with_low

# What shows that a sentence is of an earlier company.
PRIOR_COMPANY = (
    r"\b[Bb]efore\s+(?:founding\s+|starting\s+|building\s+)?[A-Z]",
    r"(?i)\bprior to\s+(?:founding|starting|building|joining|this)\b",
    r"(?i)\bat (?:my|our|his|her|their) (?:last|previous|former|prior)\b",
    r"(?i)\b(?:my|our|his|her|their) (?:last|previous|former|prior) (?:company|startup|job|role|venture|employer)\b",
    r"(?i)\bpreviously (?:at|with|a |the |product lead|co-?founded|built|led|founded)\b",
    r"(?i)\bwe (?:later )?left the acquiring company\b",
    r"(?i)\bwas acquired by\b|\bwere acquired by\b|\bwe (?:exited|sold)\b",
    r"(?i)\b(?:co-?founded|founded|built and exited|built, scaled,? and exited)\b[^.!?\n]*\b(?:acquired|exited|sold)\b",
)
# How a company speaks of what it does now; of a founder's office; and words and amounts of traction.
SPEAKS_NOW = r"(?i)\b(?:we (?:are|have|handle|support|serve|offer|help|track|process|now)\b|today,? we\b|our (?:platform|product|API|SDK|clients|customers) (?:is|are|now)\b)"
OFFICE = r"(?i)\b(?:our|the)\s+(?:CEO|CTO|COO|CFO|founder|co-?founder|head)\b"
TRACTION_CUE = (
    r"\b(?:customers?|clients?|hospitals?|departments?|design partners?|pilots?|contracts?|integrat(?:ed|ion|ions)|live with|deployed|onboard(?:ed|ing)|processed|processing|"
    r"revenue|ARR|MRR|GMV|payment volume|payouts?|pa(?:y|ys|ying|id) out|transactions?|users?|waitlist|LOIs?|letters of intent)\b|"
    r"\$\d[\d.,]*\s*(?:k|m|b|million|billion)\+?"
)
SHORTEST, LONGEST = 25, 320
#: Sections whose claims are about the company itself.
OWN_SECTIONS = ("launch-post", "description")

# A match can begin after a mark only, as what comes before is part of it; without saying so, texts without marks cost their length squared.
_CLAIM = rf"(?i)(?<![^.!?\n])[^.!?\n]*(?:{TRACTION_CUE})[^.!?\n]*[.!?\n]?"
_WORD_END = r"\b"


def _literally(text: Column) -> Column:
    """A pattern that matches just ``text``."""
    return F.regexp_replace(text, r"([\\.*+?^${}()|\[\]])", r"\\$1")


def told_sentences(text: Column) -> Column:
    """Sentences, trimmed; line breaks end them too."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])(?U:\s)+|\n+"), trimmed), lambda s: s != "")


def returns_to_company(sentence: Column, company: Column) -> Column:
    """Whether a sentence speaks of the company again, by its name or of what it does now."""
    return once(with_low(sentence), lambda x: _returns(x, company))


def _returns(x: Column, company: Column) -> Column:
    """As :func:`returns_to_company`, of a struct of the sentence and its lower case."""
    # A pattern that differs from row to row is compiled for each sentence, so only for those that can hold the name.
    held = ~company.rlike(r"\A\p{ASCII}*+\z") | F.contains(x["low"], F.lower(company))
    named = held & F.regexp_like(x["text"], F.concat(F.lit("(?i)" + java(_WORD_END)), _literally(company), F.lit(java(_WORD_END))))
    return F.coalesce((company != "") & named, F.lit(False)) | found_in(x["text"], x["low"], SPEAKS_NOW)


def tells_of_founder(sentence: Column, founders: Column) -> Column:
    """Whether a sentence is about a named founder: by full name, or by surname beside an office."""
    return once(_surnamed(founders), lambda people: _tells(sentence, people))


def _surnamed(founders: Column) -> Column:
    """array<struct<name, last>>: names with their last word, which is null if there is but one of three letters or more."""

    def named(name: Column) -> Column:
        parts = F.filter(F.split(name, r"(?U)\s+"), lambda p: F.length(p) > 2)
        return F.struct(name.alias("name"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("last"))

    return F.transform(founders, named)


def _tells(sentence: Column, people: Column) -> Column:
    # A missing surname is as good as one that isn't there.
    beside = lambda p: F.coalesce(sentence.contains(p["last"]), F.lit(False)) & matches(sentence, OFFICE)
    return F.coalesce(F.exists(people, lambda p: sentence.contains(p["name"]) | beside(p)), F.lit(False))


def narrative(sentences: Column, company: Column, founders: Column) -> Column:
    """For each sentence, whether it tells of an earlier company or a person: array<boolean>.

    Such a sentence opens a story that lasts until one returns to the
    company. Each sentence is a letter (P opens, C returns, - goes on); what a
    letter starts is filled with it, so the fold is linear in the text.
    """

    def letter(x: Column, people: Column) -> Column:
        prior = _tells(x["text"], people)
        for p in PRIOR_COMPANY:
            prior = prior | found_in(x["text"], x["low"], p)
        return F.when(prior, "P").when(_returns(x, company), "C").otherwise("-")

    # Surnames are split off once a text.
    letters = once(_surnamed(founders), lambda people: F.concat_ws("", F.transform(F.transform(sentences, with_low), lambda x: letter(x, people))))
    filled = F.transform(F.regexp_extract_all(letters, F.lit("[PC]-*|^-+"), F.lit(0)), lambda run: F.repeat(F.substring(run, 1, 1), F.length(run)))
    return F.transform(F.split(F.concat_ws("", filled), ""), lambda c: c == "P")


def claims(text: Column, section: str, company: Column, founders: Column) -> Column:
    """array<struct<quote, section, about_company>> of a section's text, in order; null and empty texts claim nothing."""
    kind = F.array().cast("array<struct<quote:string,section:string,about_company:boolean>>")

    def of(sentence: Column, prior: Column) -> Column:
        effective = F.lit(section) if section == "founder-bio" else F.when(prior, "prior-company").otherwise(section)
        quotes = F.transform(F.regexp_extract_all(sentence, F.lit(java(_CLAIM)), F.lit(0)), collapsed)
        fit = F.filter(quotes, lambda q: F.length(q).between(SHORTEST, LONGEST))
        found = F.transform(fit, lambda q: F.struct(q.alias("quote"), effective.alias("section"), effective.isin(*OWN_SECTIONS).alias("about_company")))
        # Most sentences hold no cue, and looking for one is quicker than matching around it.
        return F.when(matches(sentence, f"(?i){TRACTION_CUE}"), found).otherwise(kind)

    told = lambda s: F.flatten(F.zip_with(s, narrative(s, company, founders), of))
    return F.when(F.coalesce(text, F.lit("")) == "", kind).otherwise(once(told_sentences(text), told))


def claim_key(quote: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(quote), "[^a-z0-9]+", " "))


def claims_of(pages: DataFrame, key: str, sections: dict[str, str], company: str, founders: str) -> DataFrame:
    """(key, place, quote, section, about_company): each claim of a page once.

    ``sections`` names the text column of each section, in the order in which
    they are read. Where a sentence shows up twice, the reading that doesn't
    credit the company wins, at the place of the first.
    """
    each = F.concat(*(claims(F.col(c), s, F.coalesce(F.col(company), F.lit("")), F.coalesce(F.col(founders), F.array().cast("array<string>"))) for s, c in sections.items()))
    rows = pages.select(F.col(key), F.posexplode(each).alias("place", "c")).select(key, "place", "c.*")
    best = rows.groupBy(key, claim_key(F.col("quote")).alias("_key")).agg(F.min("place").alias("place"), F.min_by(F.struct("quote", "section", "about_company"), F.struct("about_company", "place")).alias("c"))
    return best.select(key, "place", "c.*")
