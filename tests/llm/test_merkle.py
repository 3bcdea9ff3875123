"""Merkle manifests against plain code and SQL."""

from __future__ import annotations

import random
from hashlib import sha256
from itertools import groupby
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.llm import merkle as M
from gleaner.llm.queries import ORACLES

rng = random.Random(12)


def sha(x):
    return sha256(x.encode()).hexdigest()


def digest(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """(root, for each leaf its siblings as (left, right) by level)."""
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for path, j in zip(paths, places, strict=True):
            a = j - j % 3
            path.append(("".join(level[a:j]), "".join(level[j + 1 : a + 3])))
        places = [j // 3 for j in places]
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_rows(docs):
    rows = [(r["source"], r["doc_id"], digest(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]), r) for r in docs]
    rows.sort(key=lambda x: ((x[0] is not None, (x[0] or "").encode()), (x[1] is not None, x[1] or 0), x[2]))
    groups = [list(g) for _, g in groupby(rows, key=lambda x: x[0])]
    below = [plain_tree([x[2] for x in g]) for g in groups]
    root, above = plain_tree([r for r, _ in below])
    out = []
    for g, (subroot, paths), top in zip(groups, below, above, strict=True):
        for (_, i, leaf, r), path in zip(g, paths, strict=True):
            t = r["text"]
            if i is not None and t is not None and crc32(str(i).encode()) % 2 == 0:
                t = t.replace("\n", "")
            now = digest(i, r["source"], r["lang"], r["n_chars"], t)
            for a, b in path + top:
                now = sha(a + now + b)
            out.append((i, leaf, subroot, root, sha("".join(a + b for a, b in path + top)), now, now == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path string, _group int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, rng.choice(["en", None]), s, rng.choice([3, None]), "x", "y", 1) for i, t, s in rows], SCHEMA)


def _texts(n):
    return [rng.choice([None, "", "é\nü", "a\nb" * rng.randint(1, 9), "plain"]) for _ in range(n)]


@pytest.mark.parametrize("n,sources,parts", [(1, 1, 3), (2, 1, 1), (3, 3, 4), (700, 1, 7), (900, 5, 8), (400, 130, 6)])
def test_query_equals_plain_code(spark, tmp_path, n, sources, parts):
    names = [None, "", "ß", "z", *(f"s{i}" for i in range(sources))][:: -1 if sources == 1 else 1][: max(1, sources)]
    rows = [(rng.choice([None, *range(1000)]), t, names[0] if rng.random() < 0.4 else rng.choice(names)) for t in _texts(n)]
    docs = _docs(spark, rows + rows[:2] * (n > 600) * 20)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in M.op12_merkle_manifest(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain_rows(docs.collect())
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert n < 100 or (any(w[-1] for w in want) and not all(w[-1] for w in want))


def test_equals_its_sql_where_ids_are_given_once(spark, tmp_path):
    docs = _docs(spark, [(i, t, rng.choice([None, "ß", "z", "a", "hot", "hot", "hot"])) for i, t in enumerate(_texts(200))] + [(990, "one", "alone")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = db.execute(ORACLES["op12_merkle_manifest"])
    names = [c[0] for c in found.description]
    rows = sorted(found.fetchall())
    assert rows == sorted(tuple(r[c] for c in names) for r in M.op12_merkle_manifest(spark, str(tmp_path)).collect())


def test_no_rows_and_clashing_names(spark, tmp_path):
    docs = _docs(spark, [(1, "a", "s"), (2, None, None)])
    assert M.merkle_manifest(docs.limit(0)).collect() == []
    rows = M.merkle_manifest(docs, keep={"size": F.length("text")}).collect()
    assert {r["size"] for r in rows} == {1, None} and len({r["root"] for r in rows}) == 1
    assert M.merkle_manifest(docs).where(M.folded("leaf", "path") != F.col("root")).count() == 0


def test_a_long_text_and_another_group(spark):
    docs = spark.createDataFrame([("b", "x" * 3_000_000), ("a", "y"), (None, "z")], "name string, body string").withColumn("half", F.lit(None).cast("int"))
    rows = {r["name"]: r for r in M.merkle_manifest(docs, ("name", "body"), "name", "half").collect()}
    leaves = [digest(None, "z"), digest("a", "y"), digest("b", "x" * 3_000_000)]
    assert [rows[k]["leaf"] for k in (None, "a", "b")] == leaves and rows["a"]["root"] == sha("".join(leaves))


def test_forests_merge_in_any_order():
    """However leaves are cut into fragments and these are merged, the same root comes out, and with it all that was resolved."""
    for n in (1, 2, 3, 4, 9, 10, 27, 100, 244):
        leaves = [sha(str(i)) for i in range(n)]
        root, _ = plain_tree(leaves)
        sizes = {5: M.level_sizes(n)}
        for _ in range(12):
            cuts = sorted({0, n, *(rng.randrange(n) for _ in range(rng.randint(0, 9)))})
            forests = [M.Forest(sizes, (((5, v, k), d) for v, k, d in M._unresolved(M._fold(leaves[a:b], a, sizes[5])))) for a, b in zip(cuts, cuts[1:])]
            rng.shuffle(forests)
            while len(forests) > 1:
                i = rng.randrange(len(forests) - 1)
                forests[i : i + 2] = [forests[i].merge(forests[i + 1])]
            assert forests[0].open == {(5, len(sizes[5]) - 1, 0): root}
