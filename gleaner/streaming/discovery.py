"""Discovery runs over what lands: each micro-batch is a run, and running it again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import discovery as D
from .events import run_in_batches
from .store import Store


_CANDIDATES = "target long, seq long, n_sources long, source_id string, company_name string, " + ", ".join(f"{f} string" for f in D.FILLED) + ", confidence double, founding_year int, funding_date date, founder_names array<string>"
_EVIDENCE = "target long, url string, claim string, accessed date"


def candidates(store: Store, before: int = 1 << 60) -> DataFrame:
    """Every candidate as its last batch left it."""
    rows = store.before("candidates", before, _CANDIDATES)
    names = [c for c in rows.columns if c not in ("target", "batch")]
    return rows.groupBy("target").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("target", "r.*")


def run_once(store: Store, raw: DataFrame, batch: int, companies: DataFrame, query: D.Query) -> dict[str, int]:
    """One run over ``raw``: decisions, new and changed candidates, new evidence and counters, all under ``batch``.

    Counters are observed while the decisions are written. Only candidates
    that the batch touches are merged again.
    """
    old = candidates(store, batch)
    seen = Observation(f"run-{batch}")
    rows = D.decided(raw, companies, old.select(F.col("target").alias("seq"), "website", "company_name"), query)
    columns = [f.split(" ", 1)[0] for f in D.CANDIDATE.split(", ")]
    kept = rows.select(*columns, "outcome", "target", "duplicate_status", "match_id", "rejections", "quality").observe(seen, *(c.alias(k) for k, c in D.counters().items()))
    taken = store.put("decisions", batch, kept).where("target is not null")
    touched = old.join(taken.select("target").distinct(), "target", "left_semi")
    fresh = D.merged_candidates(taken.select("target", *columns).unionByName(touched.drop("n_sources"), allowMissingColumns=True))
    before = touched.select("target", (F.col("n_sources") - 1).alias("_more"))
    store.put("candidates", batch, fresh.join(before, "target", "left").withColumn("n_sources", F.col("n_sources") + F.coalesce("_more", F.lit(0))).drop("_more"))
    known = store.before("evidence", batch, _EVIDENCE).select("target", "url")
    store.put("evidence", batch, D.merged_evidence(taken).join(known, ["target", "url"], "left_anti"))
    counts = dict(seen.get)
    store.put("runs", batch, store.spark.createDataFrame([counts]))
    return counts


def discover(stream: DataFrame, path: str, companies: Callable[[], DataFrame], query: D.Query, checkpoint: str) -> StreamingQuery:
    """Runs over everything that has landed, batch by batch; ``companies`` is read anew for each."""
    store = Store(stream.sparkSession, path)
    return run_in_batches(stream, lambda rows, batch: run_once(store, rows, batch, companies(), query) and None, checkpoint)
