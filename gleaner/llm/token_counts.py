"""Token counts through a digest cache.

A cache table holds (content digest, tokenizer digest, n_tokens). Texts are
reduced to their digest; digests without a stored count for this tokenizer
are encoded once each and appended. Counts then come from a join.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_written, freed_shuffles, join_with_hot_keys, read_table, shared_dir, text_or_empty, written

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the vocabulary file and the library's version."""
    lib = _library(path)
    module = __import__(lib)
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{lib}|{module.__version__}".encode()).hexdigest()


def _library(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


_LOADED: dict[str, Callable] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts; loaded once in a Python worker."""
    if path not in _LOADED:
        if _library(path) == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _LOADED[path] = lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    return _LOADED[path]


def content_digest(text):
    """SHA-256 of the normalised content: null becomes empty, nothing else
    changes, as any other folding could change a tokenizer's count."""
    return F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))


def encode_missing(docs: DataFrame, bearers: DataFrame, id_col: str, text: str, path: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """Rows of ``CACHE_SCHEMA`` for ``bearers`` (content_digest, id): one row for each digest to encode.

    While these are few they are broadcast and no text moves: each is encoded
    where it is read. Else the texts of ``docs`` meet them by a shuffle.
    """
    version = tokenizer_digest(path)
    keyed = docs.select(F.col(id_col).alias("id"), text_or_empty(text).alias("text")).withColumn("content_digest", content_digest("text"))
    # A null id bears a digest too, hence the null-safe comparison.
    joined = keyed.alias("k").join(broadcast_if_small(bearers).alias("b"), (F.col("k.content_digest") == F.col("b.content_digest")) & F.col("k.id").eqNullSafe(F.col("b.id")), "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, done = counter(path), set()
        for batch in batches:
            digests, texts = batch.column("content_digest").to_pylist(), batch.column("text")
            # A bearer's row may be repeated in the table.
            new = [k for k, d in enumerate(digests) if not (d in done or done.add(d))]
            counts, held, size = [], [], 0
            for k in new:
                held.append(texts[k].as_py())
                size += len(held[-1])
                if size >= batch_bytes:
                    counts += encode(held)
                    held, size = [], 0
            counts += encode(held)
            yield pa.RecordBatch.from_arrays([pa.array([digests[k] for k in new], pa.binary()), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    counted = joined.select("content_digest", "text").mapInArrow(count, CACHE_SCHEMA)
    # Of a row that is repeated in several tasks, each brought a count.
    return counted.groupBy("content_digest", "tokenizer_digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache_path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", most: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    ``cache_path`` holds earlier counts as Parquet; missing ones are appended
    to it. Null texts count as empty ones; equal texts are encoded once, also
    in later runs; repeated rows and null ids keep their own result rows; a
    very long text is encoded as a whole. Other columns are left out, so none
    can clash. No rows give no rows.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    # Ids and digests alone find out what is missing.
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), content_digest(text).alias("content_digest"))
    with freed_shuffles(spark):
        rows = written(rows, "digests")
        distinct = written(rows.groupBy("content_digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "distinct")
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
        bearers = written(distinct.join(known, "content_digest", "left_anti").select("content_digest", "id"), "bearers")
        if bearers.limit(1).count():
            encode_missing(docs, bearers, id_col, text, tokenizer).write.mode("append").parquet(cache_path)
        drop_written(bearers)
        spark.catalog.refreshByPath(cache_path)
        # Two runs that append at once may both store a digest.
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
        counts = stored.join(broadcast_if_small(distinct.select("content_digest", "n")), "content_digest").groupBy("content_digest", "n").agg(F.max("n_tokens").alias("n_tokens"))
        counts = written(counts, "counts")
        drop_written(distinct)
    found = join_with_hot_keys(rows, counts, "content_digest", "n", rows.count())
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > most).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, through a cache that later runs find again.

    A null text counts as an empty one, repeated rows keep a row each, and an
    empty table gives no rows. The cache lies in the shared folder.
    """
    docs = read_table(spark, sf_dir, "documents")
    return token_counts(docs, f"{shared_dir(spark)}/token-counts", tokenizer_path("piece_bpe_32k.model"))
