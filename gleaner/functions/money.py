"""Amounts, prices, shares and confidences."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import half_up, lookup

AMOUNT = r"(?i)\$\s?([\d,]+(?:\.\d+)?)\s*(k|m|b|million|billion|thousand)?"


def amount_usd(text: Column) -> Column:
    """The first dollar amount, units spelt out or not; null if there is none above 0."""
    n = F.nullif(F.regexp_replace(F.regexp_extract(text, AMOUNT, 1), ",", ""), F.lit("")).cast("double")
    unit = F.lower(F.substring(F.regexp_extract(text, AMOUNT, 2), 1, 1))
    value = n * F.when(unit.isin("k", "t"), 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    return F.when(text.rlike(AMOUNT) & (value > 0), value)


def raise_bucket(text: Column) -> Column:
    """The range that a raise falls in. Billions aren't read, as the ranges' source has it."""
    pattern = r"\$\s*([\d,.]+)\s*([kKmM])?"
    n = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "")
    n = F.nullif(F.regexp_extract(n, r"^\d+(?:\.\d+)?|^\.\d+", 0), F.lit("")).cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    usd = n * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)
    bounds = ((1e6, "$0-1,000,000"), (5e6, "$1,000,000-5,000,000"), (1e7, "$5,000,000-10,000,000"), (2e7, "$10,000,000-20,000,000"))
    out = F.when(~text.rlike(pattern) | usd.isNull(), None)
    for bound, label in bounds:
        out = out.when(usd < bound, label)
    return out.otherwise("$20,000,000+")


def number(text: Column) -> Column:
    """A positive number from text with currency signs and commas."""
    n = F.regexp_replace(text, r"[^0-9.]", "")
    value = F.when(n.rlike(r"^\d+(\.\d+)?$"), n).cast("double")
    return F.when(value > 0, value)


def tier_confidence(tier: Column, conflicts: Column) -> Column:
    """Confidence by source tier, less what recorded conflicts take."""
    base = F.when(tier == 1, 0.9).when(tier == 2, 0.7).when(tier == 3, 0.4).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), base - F.least(F.lit(0.3), conflicts * 0.15)), 2)


def candidate_confidence(score: Column, authoritative: Column, title_stated: Column) -> Column:
    value = F.least(F.lit(0.9), score / 10) * F.when(authoritative, 1.0).otherwise(0.6) + F.when(title_stated, 0.08).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.05), F.least(F.when(authoritative, 0.95).otherwise(0.6), value)), 2)


def match_score(signals: Column, weights: Mapping[str, int]) -> Column:
    """Sum of the weights of the distinct signals; unknown ones weigh nothing."""
    return F.aggregate(F.array_distinct(signals), F.lit(0), lambda s, x: s + lookup(x, weights, 0))


def percent(part: Column, whole: Column) -> Column:
    """Percent to one decimal, half up; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(half_up(part / whole * 1000.0) / 10.0)


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits))


def recommendation(score: Column) -> Column:
    return F.when(score >= 8, "prioritize").when(score >= 6.5, "track").when(score >= 5, "monitor").otherwise("pass")


def token_cost(usage: DataFrame, prices: DataFrame, model: str = "model", at: str = "at") -> DataFrame:
    """``usage`` with ``cost_usd``, by the price that is valid on its day.

    ``prices``: model, valid_from, valid_to (exclusive, null: open), and per
    million tokens input, output, cache_read, cache_write, and per search
    web_search. Models without a price get the dearest row's, as no cost may
    be understated. One row per use comes out.
    """
    dear = prices.orderBy(F.col("output").desc(), F.col("input").desc()).first()
    rates = ("input", "output", "cache_read", "cache_write", "web_search")
    p = prices.select(F.col("model").alias("_m"), F.col("valid_from").alias("_a"), F.col("valid_to").alias("_b"), *(F.col(r).alias(f"_{r}") for r in rates))
    day = F.col(at).cast("date")
    # Joined by model alone, a frequent model's uses would all go to one task.
    p = F.broadcast(p) if prices.count() <= 100_000 else p
    joined = usage.join(p, (F.col(model) == F.col("_m")) & (day >= F.col("_a")) & (F.col("_b").isNull() | (day < F.col("_b"))), "left")
    rate = lambda r: F.coalesce(F.col(f"_{r}"), F.lit(dear[r] if dear else None))
    cost = (F.col("input_tokens") * rate("input") + F.col("output_tokens") * rate("output") + F.col("cached_tokens") * rate("cache_read") + F.col("cache_write_tokens") * rate("cache_write")) / 1e6 + F.col("web_searches") * rate("web_search")
    return joined.select(*(usage[c] for c in usage.columns), cost.alias("cost_usd"))


def run_estimate(most_tokens: Column, most_calls: Column, tokens_per_call: int = 1200, usd_per_thousand: float = 0.003) -> Column:
    """struct<tokens, cost_usd>: what a run may use, by its limits and a blended rate."""
    tokens = F.least(most_tokens, most_calls * tokens_per_call)
    return F.struct(tokens.alias("tokens"), F.round(tokens / 1000 * usd_per_thousand, 4).alias("cost_usd"))
