"""Merkle manifest of a dataset: a tree for each group of rows, and one over the groups.

Leaves are sorted over ranges, so a partition holds a run of neighbouring
leaves and knows the place of each and the size of its group. It folds its run
into a sparse forest: nodes keyed by tree, level and index, where a run of
siblings whose number is known becomes its parent as soon as all are there.
Forests form a commutative monoid under union and completion; a tree reduction
over the partitions joins what crosses their bounds. What was completed in that
reduction is all that a partition lacks for the paths of its leaves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, freed_shuffles, join_with_hot_keys, read_table, shared_dir, written

ARITY = 3
_PATH = "array<struct<left:string,right:string>>"
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

Node = tuple[int, int, int]  # tree, level, index


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def level_sizes(n: int) -> list[int]:
    """Nodes of a tree over n leaves, level by level, down to one."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


class Forest:
    """Unresolved nodes by key, and those that a merge has resolved.

    ``sizes`` has the level sizes of each tree, so a run's number of siblings
    is known. Merging is associative and commutative: which nodes are complete
    depends on the leaves beneath alone.
    """

    def __init__(self, sizes: dict[int, list[int]], nodes: Iterable[tuple[Node, str]] = ()):
        self.sizes, self.open, self.resolved = sizes, dict(nodes), {}

    def merge(self, other: Forest) -> Forest:
        if len(other.open) > len(self.open):
            return other.merge(self)
        self.open |= other.open
        self.resolved |= other.resolved
        for key in other.open:
            self._complete(key)
        return self

    def _complete(self, key: Node) -> None:
        while key in self.open:
            tree, level, i = key
            n = self.sizes[tree][level]
            if n == 1:
                return
            run = [(tree, level, j) for j in range(i - i % ARITY, min(n, i - i % ARITY + ARITY))]
            if not all(k in self.open for k in run):
                return
            digests = [self.open.pop(k) for k in run]
            self.resolved |= zip(run, digests, strict=True)
            key = (tree, level + 1, i // ARITY)
            self.open[key] = _hash("".join(digests))


def _fold(digests: list[str], at: int, sizes: list[int]) -> list[tuple[int, list[str]]]:
    """For each level, the first index and digests of the nodes that leaves ``at`` and on make by themselves."""
    levels = [(at, digests)]
    for n in sizes[:-1]:
        a, held = levels[-1]
        b = a + len(held)
        low, high = -(-a // ARITY), -(-n // ARITY) if b == n else b // ARITY
        levels.append((low, [_hash("".join(held[k * ARITY - a : (k + 1) * ARITY - a])) for k in range(low, high)]))
    return levels


def _unresolved(levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of nodes whose parent isn't made."""
    for level, (a, held) in enumerate(levels):
        low, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
        for k, digest in enumerate(held, a):
            if not low <= k // ARITY < low + len(above):
                yield level, k, digest


def _stretches(groups: pa.Array) -> list[tuple[object, int, int]]:
    """(value, begin, end) of equal neighbours; null is a value."""
    if not len(groups):
        return []
    codes = groups.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return [(groups[a].as_py(), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class _Place:
    """Where a partition's first stretch begins in its tree; numbers and sizes of its first and last tree."""

    start: int
    first: tuple[int, int]
    last: tuple[int, int]


def _places(ends: list[tuple]) -> tuple[dict[int, _Place], dict[int, object], dict[int, int]]:
    """Places of partitions, and groups and sizes of the trees that cross a bound.

    ``ends``: (part, several, first group, its rows, last group, its rows) of
    each partition that has rows, in order.
    """
    places, groups, sizes, members = {}, [], [], []
    for part, several, first, n_first, last, n_last in ends:
        if not groups or groups[-1] != first:
            groups.append(first), sizes.append(0), members.append(0)
        start, tree = sizes[-1], len(groups) - 1
        sizes[-1] += n_first
        members[-1] += 1
        if several:
            groups.append(last), sizes.append(n_last), members.append(1)
        places[part] = (start, tree, len(groups) - 1)
    crossing = [t for t, m in enumerate(members) if m > 1]
    return {p: _Place(s, (a, sizes[a]), (b, sizes[b])) for p, (s, a, b) in places.items()}, {t: groups[t] for t in crossing}, {t: sizes[t] for t in crossing}


def _runs(stretches: list[tuple[object, int, int]], place: _Place) -> Iterator[tuple[object, int, int, int, int, int]]:
    """(group, begin, end, tree or -1, place of the first leaf, leaves of the tree)."""
    for k, (group, a, b) in enumerate(stretches):
        first, last = k == 0, k == len(stretches) - 1
        tree, n = place.first if first else place.last if last else (-1, b - a)
        yield group, a, b, tree, place.start if first else 0, n


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _paths(levels: list[tuple[int, list[str]]], at: int, count: int, sizes: list[int], tree: int, resolved: dict[Node, str], most: int = 8192) -> Iterator[pa.Array]:
    """Paths of ``count`` leaves from place ``at`` on, in slices: at each level what is left and right of the node in its run."""
    lefts, rights, firsts, bases = [], [], [], []
    for level, n in enumerate(sizes[:-1]):
        low, held = levels[level]
        first, last = at // ARITY**level, (at + count - 1) // ARITY**level
        begin, end = first - first % ARITY, min(n, last - last % ARITY + ARITY)
        row = [held[k - low] if low <= k < low + len(held) else resolved[tree, level, k] for k in range(begin, end)]
        firsts.append(first), bases.append(len(lefts))
        for k in range(first, last + 1):
            a = k - k % ARITY - begin
            lefts.append("".join(row[a : k - begin]))
            rights.append("".join(row[k - begin + 1 : a + ARITY]))
    depth = len(sizes) - 1
    left, right = pa.array(lefts, pa.string()), pa.array(rights, pa.string())
    powers = np.array([ARITY**level for level in range(depth)], np.int64)
    for a in range(at, at + count, most):
        leaves = np.arange(a, min(a + most, at + count))
        rows = (leaves[:, None] // powers - np.array(firsts, np.int64) + np.array(bases, np.int64)).ravel() if depth else np.zeros(0, np.int64)
        some = pa.array(rows)
        offsets = pa.array(np.arange(len(leaves) + 1) * depth, pa.int32())
        yield pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([left.take(some), right.take(some)], names=["left", "right"])).cast(_PATH_TYPE)


def trees(leaves: DataFrame, group: str, order: list[str], leaf: str, partitions: int) -> tuple[DataFrame, DataFrame]:
    """(``leaves`` with ``path``, the roots) of a tree for each ``group``.

    Leaves of a group go by ``order``, nulls first, then by digest; repeated
    rows are as many leaves. The first table is lazy and sorted; the second,
    (group, root, n), is written. The driver holds a place for each partition
    and, as digests, at most 2 * (ARITY - 1) nodes for each partition and
    level; these go to all tasks.
    """
    spark = leaves.sparkSession
    shared_dir(spark)
    kind = leaves.schema[group].dataType
    # The random number parts rows that are equal in everything, of which there may be any number.
    by = [group, *order, leaf, "_tie"]
    ranged = leaves.withColumn("_tie", F.rand(12)).repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    with freed_shuffles(spark):
        at = ranged.drop("_tie").withColumn("_part", F.spark_partition_id()).checkpoint()

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _whole(batches)
        if held is not None:
            s = _stretches(held[group].combine_chunks())
            row = {"part": held["_part"][0].as_py(), "several": len(s) > 1, "first": s[0][0], "n_first": s[0][2] - s[0][1], "last": s[-1][0], "n_last": s[-1][2] - s[-1][1]}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("several", pa.bool_()), ("first", held.schema.field(group).type), ("n_first", pa.int64()), ("last", held.schema.field(group).type), ("n_last", pa.int64())]))

    name = kind.simpleString()
    ends = at.select("_part", group).mapInArrow(outline, f"part int, several boolean, first {name}, n_first bigint, last {name}, n_last bigint").collect()
    places, crossing, counts = _places(sorted((tuple(r) for r in ends), key=lambda r: r[0]))
    sizes = {t: level_sizes(n) for t, n in counts.items()}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _whole(batches)
        if held is None:
            return
        groups, digests = held[group].combine_chunks(), held[leaf].to_pylist()
        rows = []
        for value, a, b, tree, start, n in _runs(_stretches(groups), places[held["_part"][0].as_py()]):
            levels = _fold(digests[a:b], start, level_sizes(n))
            if b - a == n:
                rows.append((value, n, None, None, None, levels[-1][1][0]))
            else:
                rows += [(None, None, tree, level, k, digest) for level, k, digest in _unresolved(levels)]
        kinds = [groups.type, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["group", "n", "tree", "level", "index", "digest"])

    folded = written(at.select("_part", group, leaf).mapInArrow(fold, f"`group` {name}, n bigint, tree bigint, level int, index bigint, digest string"), "forests")
    resolved: dict[Node, str] = {}
    found = folded.where("tree is null").select(F.col("group").alias(group), F.col("digest").alias("root"), "n")
    if crossing:
        parts = folded.where("tree is not null").select("tree", "level", "index", "digest").rdd.mapPartitions(lambda rows: [Forest(sizes, (((t, v, i), d) for t, v, i, d in rows))])
        forest = parts.map(_completed).treeReduce(Forest.merge)
        resolved = forest.resolved
        tops = [(crossing[tree], digest, counts[tree]) for (tree, _, _), digest in forest.open.items()]
        schema = T.StructType([T.StructField(group, kind), T.StructField("root", T.StringType()), T.StructField("n", T.LongType())])
        found = found.unionByName(spark.createDataFrame(tops, schema))
    roots = written(found, "roots")
    drop_written(folded)
    shared = spark.sparkContext.broadcast(resolved)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _whole(batches)
        if held is None:
            return
        groups, digests = held[group].combine_chunks(), held[leaf].to_pylist()
        others = held.drop_columns(["_part"])
        for _, a, b, tree, start, n in _runs(_stretches(groups), places[held["_part"][0].as_py()]):
            tall = level_sizes(n)
            done = a
            for path in _paths(_fold(digests[a:b], start, tall), start, b - a, tall, tree, shared.value):
                some = others.slice(done, len(path)).append_column("path", path)
                yield from some.to_batches()
                done += len(path)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.drop("_part").schema)
    return at.mapInArrow(paths, f"{columns}, path {_PATH}"), roots


def _completed(forest: Forest) -> Forest:
    """What is complete within one forest, as a partition of the table may hold several partitions' nodes."""
    for key in list(forest.open):
        forest._complete(key)
    return forest


def field_digest(*columns: str | Column) -> Column:
    """sha256 of the columns' values, each ``-`` if null, else its UTF-8 byte count, a colon and it."""
    each = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in each)).cast("binary"), 256)


def proof_digest(path: str | Column) -> Column:
    """sha256 of the siblings on a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))).cast("binary"), 256)


def folded(leaf: str | Column, path: str | Column) -> Column:
    """The root that ``leaf`` and its path give."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, start, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]).cast("binary"), 256))


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group: str = "source", keep: dict[str, Column] | None = None, rows_per_partition: int = 500_000) -> DataFrame:
    """(id, group, leaf, subroot, root, path) of every row; :func:`folded` of leaf and path is the root.

    A leaf is :func:`field_digest` of ``fields``. In a group leaves ascend by
    id; every three neighbours become a node (the last run fewer, even one)
    until one is left, the subroot, and so do the subroots, by group. Null ids
    and groups come first and are as good as any; rows with one id go by
    digest, equal rows are as many leaves. Texts are read once and don't move:
    ids, groups and digests are sorted, whole groups never meet in a task, and
    a partition has about ``rows_per_partition`` rows. ``keep`` adds columns
    computed from the row. Other columns are left out, so no name clashes. No
    rows give no rows.
    """
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    extra = {f"_k{i}": c for i, c in enumerate((keep or {}).values())}
    leaves = docs.select(F.col(id_col).alias("_id"), F.col(group).alias("_group"), field_digest(*fields).alias("_leaf"), *(c.alias(k) for k, c in extra.items()))
    n = docs.select(id_col).count()
    below, subroots = trees(leaves, "_group", ["_id"], "_leaf", max(least, ceil(n / rows_per_partition)))
    # Subroots are the leaves of one more tree.
    top, roots = trees(subroots.select(F.lit(0).alias("_all"), F.col("_group"), F.col("root").alias("subroot"), "n"), "_all", ["_group"], "subroot", max(1, ceil(subroots.count() / rows_per_partition)))
    root = roots.first()
    key = F.coalesce(F.concat(F.lit("="), F.col("_group").cast("string")), F.lit("-"))
    above = written(top.select(key.alias("_key"), "subroot", "n", F.col("path").alias("_above")), "subroots")
    joined = join_with_hot_keys(below.withColumn("_key", key), above, "_key", "n", n, small=20_000)
    return joined.select(
        F.col("_id").alias(id_col), F.col("_group").alias(group), F.col("_leaf").alias("leaf"), "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"),
        F.concat("path", "_above").alias("path"), *(F.col(k).alias(name) for k, name in zip(extra, keep or {}, strict=True)),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and digest of the proof of every document, and the root that a tampered text gives.

    Tampering takes the line feeds out of texts whose id has an even crc32;
    null ids and texts stay as they are.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle_manifest(docs, keep={"tampered": field_digest("doc_id", "source", "lang", "n_chars", text)})
    root = rows.withColumn("folded_root", folded("tampered", "path"))
    return root.select("doc_id", "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of the decimal id, bit by bit: an entry of the list is a byte to take in, or -1 for a step of the register.
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten([list_concat([ascii(c)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1]) for c in string_split(doc_id::VARCHAR, '')])),
    lambda r, b: CASE WHEN b >= 0 THEN xor(r, b) WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))"""


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


def _levels(name: str, leaves: str) -> str:
    """All nodes of the trees over ``leaves`` (tree, i, n, digest), with what is left and right of each in its run."""
    return f"""
{name}_nodes AS (
    SELECT tree, 0 AS level, i, n, digest FROM {leaves}
    UNION ALL
    SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, i // 3, n),
{name}_siblings AS (
    SELECT a.tree, a.level, a.i, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
    FROM {name}_nodes a JOIN {name}_nodes b ON a.tree = b.tree AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),"""


def _fold_sql(name: str, start: str, siblings: str) -> str:
    return f"""
{name} AS (
    SELECT tree, k, 0 AS level, i, digest, proof, n FROM {start}
    UNION ALL
    SELECT f.tree, f.k, f.level + 1, f.i // 3, sha256(s.l || f.digest || s.r), f.proof || s.l || s.r, (f.n + 2) // 3 FROM {name} f JOIN {siblings} s USING (tree, level, i) WHERE f.n > 1),"""


#: Rows with one id and equal digests are told apart by number, as the operator's tables may hold them too.
SQL = f"""
WITH RECURSIVE rows AS (
    SELECT doc_id, source, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
        CASE WHEN {_CRC} % 2 = 0 THEN sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")))}) END AS changed
    FROM documents),
placed AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
        row_number() OVER () AS k, coalesce(changed, leaf) AS now FROM rows),
leaves AS (SELECT tree, i, n, leaf AS digest FROM placed),{_levels("low", "leaves")}
subroots AS (SELECT tree AS source_tree, digest AS subroot FROM low_nodes WHERE n = 1),
top_leaves AS (SELECT 0 AS tree, source_tree AS i, count(*) OVER () AS n, subroot AS digest FROM subroots),{_levels("top", "top_leaves")}
low_start AS (SELECT tree, k, i, n, now AS digest, '' AS proof FROM placed),{_fold_sql("low_fold", "low_start", "low_siblings")}
top_start AS (SELECT 0 AS tree, k, f.tree AS i, (SELECT count(*) FROM subroots) AS n, digest, proof FROM low_fold f WHERE n = 1),{_fold_sql("top_fold", "top_start", "top_siblings")}
root AS (SELECT digest AS root FROM top_nodes WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = root AS verified
FROM placed p JOIN subroots s ON s.source_tree = p.tree JOIN top_fold f ON f.k = p.k AND f.n = 1 CROSS JOIN root
"""
