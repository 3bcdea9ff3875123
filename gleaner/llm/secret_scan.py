"""Secret scans: fixed patterns and a character Markov model.

Long unbroken strings are scored with two first-order character models, one
of random strings and one of ordinary identifiers; those whose log-likelihood
ratio passes a threshold are added to what the patterns find. Everything on
the rows is built-in SQL functions.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_or_empty

#: Fixed patterns, in the order in which ties are listed: kind, pattern, group to measure, least length of it.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: What a text must hold for the pattern to be tried at all.
_NEEDS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{32}"}
MARKOV = "markov"
_SPAN = "array<struct<start:int,rank:int,kind:string,stop:int,value:string>>"
#: Characters are numbered from space to tilde; others can't be in a candidate.
_FIRST, _SIZE = 32, 96


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios of character pairs, random over ordinary."""

    ratios: tuple[float, ...]
    least_length: int = 20
    threshold: float = 10.0

    @property
    def pattern(self) -> str:
        return rf"[A-Za-z0-9+/_-]{{{self.least_length},}}"

    def score(self, value: Column) -> Column:
        table = F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")
        codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - _FIRST)
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.element_at(table, a * _SIZE + b + 1))
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """n labelled random strings: hexadecimal, base64, mixed and upper-case ones."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512)
    base64 = F.base64(F.unhex(digest))
    kinds = [F.substring(digest, 1, 40), F.substring(base64, 1, 40), F.substring(F.translate(base64, "+/=", ""), 1, 32), F.substring(F.upper(F.translate(base64, "+/=", "")), 1, 24)]
    return spark.range(n).select(F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int")).alias("value"))


def ordinary_strings(docs: DataFrame, n_texts: int, text: str = "text") -> DataFrame:
    """Words of ``n_texts`` different texts at most, plain and joined as identifiers are.

    Of each task's texts the first by hash go on, so a text that fills a
    third of all rows counts once, and the bound holds for any table.
    """
    picked = _first_by_hash(docs.where(F.col(text).isNotNull()), n_texts, text)
    w = F.regexp_extract_all(F.col(text), F.lit(r"(?<![A-Za-z0-9+/_-])[A-Za-z]{2,24}(?![A-Za-z0-9+/_-])"), F.lit(0))
    rows = picked.select(w.alias("w")).where(F.size("w") > 2)
    joined = F.transform("w", lambda x, i: F.concat(F.lower(x), F.initcap(F.coalesce(F.get("w", i + 1), F.lit("")))))
    snake = F.transform("w", lambda x, i: F.concat_ws("_", F.lower(x), F.lower(F.get("w", i + 1)), F.lower(F.get("w", i + 2))))
    dashed = F.transform("w", lambda x, i: F.concat_ws("-", F.upper(x), F.upper(F.get("w", i + 1)), (i % 100).cast("string")))
    path = F.transform("w", lambda x, i: F.concat_ws("/", x, F.get("w", i + 1), F.get("w", i + 2)))
    return rows.select(F.explode(F.concat("w", joined, snake, dashed, path)).alias("value"))


def _first_by_hash(docs: DataFrame, n: int, text: str) -> DataFrame:
    """``n`` different texts with the least hashes; hashes alone are sorted, and only ``n`` of them meet."""
    hashed = docs.select(F.xxhash64(text).alias("_h")).distinct()
    bound = hashed.orderBy("_h").limit(n).agg(F.max("_h").alias("most")).first()["most"]
    if bound is None:
        return docs.select(text).limit(0)
    return docs.select(text).where(F.xxhash64(text) <= bound).groupBy(F.xxhash64(text).alias("_h")).agg(F.min(text).alias(text)).select(text)


def train(random: DataFrame, ordinary: DataFrame, smoothing: float = 0.5, **options) -> MarkovModel:
    """Fit both models on labelled samples; at most ``_SIZE`` squared counts per label come back."""
    both = random.withColumn("label", F.lit(1)).unionByName(ordinary.withColumn("label", F.lit(0)))
    chars = both.select("label", F.transform(F.split("value", ""), lambda c: F.ascii(c) - _FIRST).alias("c"))
    pairs = chars.select("label", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))).alias("b"))).alias("p"))
    rows = pairs.where("p.a between 0 and 94 and p.b between 0 and 94").groupBy("label", "p.a", "p.b").count().collect()
    counts = [[smoothing] * (_SIZE * _SIZE) for _ in range(2)]
    for r in rows:
        counts[r["label"]][r["a"] * _SIZE + r["b"]] += r["count"]
    ratios = []
    for a in range(_SIZE):
        own = [c[a * _SIZE : (a + 1) * _SIZE] for c in counts]
        sums = [math.fsum(x) for x in own]
        ratios += [round(math.log(own[1][b] / sums[1]) - math.log(own[0][b] / sums[0]), 4) for b in range(_SIZE)]
    return MarkovModel(tuple(ratios), **options)


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int, keep=None) -> Column:
    """Leftmost matches with their places, in code points.

    ``split`` and ``regexp_extract_all`` walk over the same matches, so the
    lengths of gaps and matches add up to every start.
    """
    none = F.array().cast(_SPAN)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        stop = start + F.coalesce(F.char_length(x["found"]), F.lit(0))
        fits = F.char_length(x["value"]) >= least
        if keep is not None:
            fits = fits & keep(x["value"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"), x["value"].alias("value")))
        return F.struct(stop.alias("at"), F.when(fits, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    # Cast: literals are not nullable, what replaces them may be.
    zero = zero.cast(f"struct<at:int,out:{_SPAN}>")
    return F.when(text.rlike(_NEEDS.get(kind, pattern)), F.aggregate(parts, zero, lambda a, x: add(a, x).cast(f"struct<at:int,out:{_SPAN}>"), lambda a: a["out"])).otherwise(none)


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def secret_spans(docs: DataFrame, model: MarkovModel, text: str = "text") -> DataFrame:
    """``docs`` with arrays ``base_spans`` and ``spans`` of (start, rank, kind, stop, value).

    Places count code points, ends are exclusive; ``spans`` adds strings that
    the model takes for random to the base ones, unless they overlap one.
    Null and empty texts have empty arrays; rows are judged one by one, so
    repeats and other columns stay; columns of these two names are an error.
    Of a very long text every match counts; no rows give no rows.
    """
    if {"base_spans", "spans"} & {c.lower() for c in docs.columns}:
        raise ValueError("columns base_spans or spans exist")
    t = text_or_empty(text)
    base = F.array_sort(F.concat(*(_spans(t, kind, rank, *rest) for rank, (kind, *rest) in enumerate(PATTERNS))))
    more = _spans(t, MARKOV, len(PATTERNS), model.pattern, 0, model.least_length, lambda v: model.score(v) >= model.threshold)
    clear = F.filter("_more", lambda m: ~F.exists("base_spans", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
    return docs.withColumns({"base_spans": base, "_more": more}).withColumn("spans", F.array_sort(F.concat("base_spans", clear))).drop("_more")


def train_on(docs: DataFrame, n_random: int = 20_000, n_texts: int = 500) -> MarkovModel:
    """A model from ``n_random`` made-up strings and the words of ``n_texts`` texts at most."""
    return train(random_strings(docs.sparkSession, n_random), ordinary_strings(docs, n_texts))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document; a null text is an empty one, repeated rows keep a row each."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_spans(docs, train_on(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind, *_ in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
