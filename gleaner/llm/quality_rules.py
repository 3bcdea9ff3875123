"""Quality rules: word counts and compression bands.

Each text is compressed with zstandard as a whole and in fixed chunks.
Repetitive text compresses far better than prose of its length and noise far
worse, so a text is kept when both ratios lie within limits for its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, read_table

_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_bytes long, whole_ratio double, worst_chunk_ratio double, best_chunk_ratio double, kept boolean"
)
_BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits on compressed size over size, by UTF-8 length.

    ``whole`` holds (bytes from which it applies, least ratio, most ratio) in
    rising order; the last that applies counts. The defaults hold where
    :func:`fit_bands` finds too few labelled texts of a length. Chunks have ``chunk_bytes``
    each; a shorter tail is compressed along with the chunk before it. A text
    fails when over ``chunk_share`` of its chunks are outside ``chunk``.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.55, 2.00),
        (48, 0.70, 1.35),
        (96, 0.64, 1.20),
        (192, 0.565, 1.00),
        (384, 0.555, 0.88),
        (512, 0.51, 0.82),
        (768, 0.485, 0.78),
        (1024, 0.468, 0.74),
        (1536, 0.455, 0.70),
        (2048, 0.448, 0.68),
        (3072, 0.438, 0.66),
        (4096, 0.418, 0.65),
        (8192, 0.403, 0.63),
        (16384, 0.380, 0.61),
        (65536, 0.350, 0.60),
        (1 << 20, 0.300, 0.60),
    )
    chunk: tuple[float, float] = (0.395, 0.66)
    chunk_bytes: int = 4096
    chunk_share: float = 0.25
    level: int = 3
    least_words: int = 10
    repeat_percent: int = 20
    window: int = 5


def _repeated(words: list[bytes], n: int) -> int:
    """Words covered by n-word windows that occur twice or more."""
    if len(words) <= n:
        return 0
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + n - max(i, upto)
            upto = i + n
    return covered


def _chunks(data: bytes, size: int) -> list[bytes]:
    n = max(1, len(data) // size)
    return [data[i * size : (i + 1) * size if i < n - 1 else len(data)] for i in range(n)]


def judge(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """The row of ``_SCHEMA`` for one text; null counts as a text without words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _BLANK))
    symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    repeat = _repeated(words, bands.window)
    failed = n < bands.least_words or 100 * repeat > bands.repeat_percent * n
    if not data:
        return n, word_chars, symbols, 0, repeat, failed, 0, None, None, None, False
    whole = len(packer.compress(data)) / len(data)
    parts = [len(packer.compress(c)) / len(c) for c in _chunks(data, bands.chunk_bytes)] if len(data) >= 2 * bands.chunk_bytes else [whole]
    low, high = next((a, b) for at, a, b in reversed(bands.whole) if len(data) >= at)
    inside = low <= whole <= high
    if len(parts) > 1:
        out = sum(not bands.chunk[0] <= p <= bands.chunk[1] for p in parts)
        inside = inside and out <= bands.chunk_share * len(parts)
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeat, failed, len(data), whole, max(parts), min(parts), inside and not failed


def quality_rules(docs: DataFrame, text: str = "text", bands: Bands = Bands(), into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into`` that holds the counts and the verdict.

    Null or empty texts have no words, so they fail the base rule; their
    ratios are null. Rows are judged one by one: repeats and extra columns
    are left as they are; one named as ``into`` is an error. A very long text
    is compressed as a whole and in all its chunks. No rows give no rows.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {into!r} exists")

    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (c.split() for c in _SCHEMA.split(", "))]

    @F.arrow_udf(_SCHEMA)
    def rules(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for texts in batches:
            # A few texts at a time, as each is held three times over while it is judged.
            rows = [judge(t, bands, packer) for at in range(0, len(texts), 256) for t in texts.slice(at, 256).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)

    return docs.withColumn(into, rules(F.col(text)))


#: Ratios are counted by this fraction, so that a length has some ten thousand counts however many texts it has.
_STEPS = 100_000


def _ratios(docs: DataFrame, labels: DataFrame, bands: Bands, id_col: str, text: str) -> DataFrame:
    """(at, step, n): how many good texts there are of each length and ratio, each text at all lengths near its own."""
    good = labels.where("quality = 1").select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    some = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(broadcast_if_small(good), "_id", "left_semi")
    starts = [at for at, *_ in bands.whole]
    n = F.col("_q.n_bytes")
    spans = [F.when(~F.col("_q.base_failed") & n.between(int(a / 1.5), int(b * 1.5)), F.lit(a)) for a, b in zip(starts, [*starts[1:], 1 << 61], strict=True)]
    rows = quality_rules(some, "_text", bands, "_q").select(F.round(F.col("_q.whole_ratio") * _STEPS).cast("long").alias("step"), F.array(*spans).alias("spans"))
    # Nulls go after the explode: a filter on the verdict would be moved before the join and judge all texts once more.
    return rows.select("step", F.explode("spans").alias("at")).groupBy("at", "step").agg(F.count(F.lit(1)).alias("n")).where("at is not null")


def fit_bands(docs: DataFrame, labels: DataFrame, bands: Bands = Bands(), least_rows: int = 30, id_col: str = "doc_id", text: str = "text") -> Bands:
    """``bands`` with limits on whole texts by what good ones show at each length.

    Learns from every document that ``labels`` (id, quality) call good and the
    base rule passes. At each length, with its neighbours by a factor of 1.5,
    the limits are the 0.2 and 99.8 per cent points of all its texts, with
    ratios to five places, and with a margin of 1.5 per cent below
    and 10 above: repetitive text lies close to prose, noise far off. Lengths
    with under ``least_rows`` texts keep their limits. Nulls are passed over.
    """
    counted = _ratios(docs, labels, bands, id_col, text).groupBy("at")
    points = F.percentile("step", F.array(F.lit(0.002), F.lit(0.998)), F.col("n"))
    found = {r["at"]: r for r in counted.agg(F.sum("n").alias("n"), points.alias("q")).collect()}
    fits = lambda at: at in found and found[at]["n"] >= least_rows
    return replace(bands, whole=tuple((at, found[at]["q"][0] / _STEPS * 0.985, found[at]["q"][1] / _STEPS * 1.1) if fits(at) else (at, low, high) for at, low, high in bands.whole))


def bands_for(docs: DataFrame, sf_dir: str) -> Bands:
    """Limits fitted to the labels beside ``docs``; the defaults in a folder without labels."""
    try:
        labels = read_table(docs.sparkSession, sf_dir, "labels")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Bands()
    return fit_bands(docs, labels)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, the counts and ratios, kept) of every document; a null or empty text is not kept."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, bands=bands_for(docs, sf_dir)).select("doc_id", "quality.*")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` whose text the rules keep.

    Null and empty texts go, as they have too few words; null ids don't
    matter, and repeated rows stay or go together. Columns stay as they are,
    whatever their names. No rows give no rows.
    """
    at = fresh(docs, "quality")
    return quality_rules(docs, into=at, **options).where(F.col(f"{at}.kept")).drop(at)
