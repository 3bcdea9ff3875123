"""Sector of a company: what it makes and who pays, held against a directory's own category, or why there is none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import half_up, once
from .sectors import subvertical_of

# What a directory's categories are by sector, in the order in which they are tried, and categories that tell nothing.
DIRECTORY = (
    ("health", r"(?i)health|medical|diagnostic|bio|therapeut|pharma|wellness|fitness|nutrition|mental"),
    ("fintech", r"(?i)fintech|payment|banking|finance|insurance|lending|credit|asset management|investing|crypto"),
    ("frontier", r"(?i)aviation|space|satellite|aerospace"),
    ("frontier", r"(?i)robotic|manufacturing|drone|autonomous|hard tech|industrial"),
    ("sustainability", r"(?i)climate|energy|sustainab|agriculture|carbon|environment|water|recycl"),
    ("fow", r"(?i)human resources|recruit|hiring|talent|education|elearning|learning|productivity|workforce|future of work|hr tech|ops|supply chain|logistics"),
    ("fow", r"(?i)artificial intelligence|machine learning|generative|data|analytics|developer tools|infrastructure"),
)
NO_CATEGORY = r"(?i)^\s*$|unclassified|requires manual review|unknown|n/?a$"
LEAST_SCORE, SECOND_SHARE, BY_DIRECTORY = 2, 0.5, 0.4

Signals = Mapping[str, tuple[Sequence[str], Sequence[str]]]


def directory_sector(raw: Column) -> Column:
    """struct<sector, category> of a directory's list of categories: the first rule that one of them fits, and the first that does."""
    parts = F.filter(F.transform(F.split(raw, "[,;/]"), F.trim), lambda p: p != "")

    def found(parts: Column) -> Column:
        hit = lambda p: F.get(F.filter(parts, lambda x: x.rlike(p)), F.lit(0))
        return F.coalesce(*(F.when(hit(p).isNotNull(), F.struct(F.lit(s).alias("sector"), hit(p).alias("category"))) for s, p in DIRECTORY))

    return F.when(~raw.rlike(NO_CATEGORY), once(parts, found))


def sector_scores(text: Column, signals: Signals) -> Column:
    """array<struct<score, rank, sector, does, pays>>, best first: words of what is made times words of who pays and one.

    ``signals`` has both lists of words for each sector; equal scores keep its
    order.
    """
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"(?U)\s+", " "), F.lit(" "))

    def scored(low: Column) -> Column:
        hits = lambda words: F.filter(F.array(*(F.lit(w.lower()) for w in words)).cast("array<string>"), lambda w: F.contains(low, w))
        one = lambda k, s, does, pays: once(F.struct(hits(does).alias("does"), hits(pays).alias("pays")), lambda h: F.struct((F.size(h["does"]) * (F.size(h["pays"]) + 1)).alias("score"), F.lit(-k).alias("rank"), F.lit(s).alias("sector"), h["does"].alias("does"), h["pays"].alias("pays")))
        return F.sort_array(F.array(*(one(k, s, does, pays) for k, (s, (does, pays)) in enumerate(signals.items()))), asc=False)

    return once(low, scored)


def company_class(text: Column, resolved: Column, self_described: Column, categories: Column, signals: Signals) -> Column:
    """struct<sector, secondary, subvertical, confidence, basis, gap> of a company.

    Without a confirmed identity there is none. Text that doesn't say enough
    leaves it to a directory's category, as an inference; else the text
    decides, a directory that agrees makes it surer and one that doesn't less
    sure. A second sector counts from half the first's score. Null texts are
    empty, null flags false.
    """
    said = F.coalesce(text, F.lit(""))
    own = F.coalesce(self_described, F.lit(False))
    kind = lambda sector, second, sub, sure, basis, gap: F.struct(sector.cast("string").alias("sector"), second.cast("string").alias("secondary"), sub.cast("string").alias("subvertical"), sure.cast("double").alias("confidence"), basis.alias("basis"), gap.cast("string").alias("gap"))
    none = F.lit(None)

    def of(x: Column) -> Column:
        top, second, listed = F.get(x["scores"], F.lit(0)), F.get(x["scores"], F.lit(1)), x["listed"]
        other = F.when((second["score"] > 0) & (second["score"] >= top["score"] * SECOND_SHARE), second["sector"])
        agrees = F.when(listed.isNull(), 0.0).when(listed["sector"] == top["sector"], 0.1).otherwise(-0.1)
        sure = 0.35 * F.least(F.lit(1.0), F.size(top["does"]) / 4) + 0.45 * F.least(F.lit(1.0), F.size(top["pays"]) / 3) + F.when(own, 0.2).otherwise(0.05) + agrees - F.when(other.isNotNull(), 0.15).otherwise(0.0)
        explicit = F.when(own & (F.size(top["pays"]) > 0), "explicit").otherwise("inferred")
        by_text = kind(top["sector"], other, subvertical_of(top["sector"], said), half_up(F.greatest(F.lit(0.1), F.least(F.lit(0.95), sure)), 2), explicit, none)
        by_list = kind(listed["sector"], none, subvertical_of(listed["sector"], said), F.lit(BY_DIRECTORY), F.lit("inferred"), none)
        neither = kind(none, none, none, F.lit(0.0), F.lit("inferred"), F.lit("no-product-or-buyer-stated"))
        return F.when(top["score"] >= LEAST_SCORE, by_text).when(listed.isNotNull(), by_list).otherwise(neither)

    unresolved = kind(none, none, none, F.lit(0.0), F.lit("inferred"), F.lit("identity-unresolved"))
    return F.when(F.coalesce(resolved, F.lit(False)), once(F.struct(sector_scores(said, signals).alias("scores"), directory_sector(categories).alias("listed")), of)).otherwise(unresolved)
