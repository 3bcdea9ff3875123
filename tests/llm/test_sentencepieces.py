"""Sampled segmentations: lossless, reproducible, and drawn in proportion."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm.sentencepieces import Encoder, Vocabulary, decode, encode
from gleaner.llm.token_counts import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["hello world", " a  b\n\nc ▁ x", "", "日本語テキスト 😀", "   ", "▁▁ ▁", "a" * 300 + " " * 20, None, "x\ty\r\n", " é", "\x00�", "word " * 60_000]
SCHEMA = "doc_id long, text string, decoded_at int"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH, 1.0)


def test_decoding_gives_the_text_back(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no key", 1), (0, "hello world", 1)], SCHEMA)
    rows = decode(encode(docs, PATH), PATH).collect()
    assert len(rows) == len(TEXTS) + 2
    assert all(r["decoded"] == r["text"] for r in rows)
    assert [r["pieces"] for r in rows if r["text"] is None] == [None] and [r["pieces"] for r in rows if r["text"] == ""] == [[]]
    again = [r["pieces"] for r in rows if r["doc_id"] == 0]
    assert again[0] == again[1]
    assert encode(docs.limit(0), PATH).collect() == []


def test_ids_depend_on_seed_key_and_text_alone(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:-1])], "doc_id long, text string")
    one = {r["doc_id"]: r["pieces"] for r in encode(docs.repartition(1), PATH, seed=3).collect()}
    many = {r["doc_id"]: r["pieces"] for r in encode(docs.repartition(5, F.rand(1)), PATH, seed=3).collect()}
    assert one == many
    assert one != {r["doc_id"]: r["pieces"] for r in encode(docs, PATH, seed=4).collect()}


def test_batches_and_kept_lattices_change_nothing(vocabulary):
    texts = [t for t in TEXTS[:-1]] * 3 + ["some words recur and some words recur again"] * 5
    keys = list(range(len(texts)))
    whole = Encoder(vocabulary).encode(texts, keys)
    small = Encoder(vocabulary, batch_chars=3, most_arcs=40)
    for _ in range(2):
        ids, n = small.encode(texts, keys)
        assert (ids == whole[0]).all() and (n == whole[1]).all()


def test_long_parts_are_drawn_as_in_one_lattice(vocabulary):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeéß日😀") for _ in range(n)) for n in (1, 15, 40, 300, 1500)] + ["x " + "thequickbrown" * 70 + " y\n", "_" * 500]
    keys = [k * 104729 for k in range(len(texts))]
    whole = Encoder(vocabulary).encode(texts, keys)
    cut = Encoder(vocabulary, window=3)
    draw = cut._sample_long
    cut._sample_long = lambda part, place, key: draw(part, place, key, stretch=64)
    ids, n = cut.encode(texts, keys)
    assert (ids == whole[0]).all() and (n == whole[1]).all()


def test_a_text_of_millions_of_letters_without_a_space(vocabulary):
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2_000_000))
    ids, n = Encoder(vocabulary).encode([text], [1])
    assert b"".join(vocabulary.bytes[i] for i in ids.tolist()) == b" " + text.encode() and n.tolist() == [len(ids)]


def test_checked_columns_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, checked string")
    rows = {r["doc_id"]: r for r in encode(docs, PATH, check="lossless").collect()}
    plain = {r["doc_id"]: r["pieces"] for r in encode(docs, PATH).collect()}
    assert all(r["lossless"] and r["checked"] == "c" and r["pieces"] == plain[k] for k, r in rows.items())
    with pytest.raises(ValueError, match="exist"):
        encode(docs, PATH, into="Text")
    with pytest.raises(ValueError, match="exists"):
        decode(encode(docs, PATH), PATH, into="text")


def test_segmentations_are_drawn_in_proportion(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            i = model.piece_to_id(s[:k])
            if i != model.unk_id():
                yield from ((i, *rest) for rest in ways(s[k:]))

    for alpha in (1.0, 0.0):
        v = Vocabulary(PATH, alpha)
        every = list(ways("▁the"))
        share = [math.exp(sum(v.weight[i] for i in w)) for w in every]
        n = 40_000
        ids, per = Encoder(v).encode(["the"] * n, [k * 7919 for k in range(n)])
        at, seen = 0, Counter()
        for k in per.tolist():
            seen[tuple(ids[at : at + k].tolist())] += 1
            at += k
        assert set(seen) <= set(every)
        for w, s in zip(every, share, strict=True):
            p = s / sum(share)
            assert abs(seen[w] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
