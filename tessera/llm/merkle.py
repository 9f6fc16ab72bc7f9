"""Merkle manifest of a dataset: Pregel-style supersteps over RDDs, up for the hashes and down for the proofs.

Rows are leaves. Each group (a language, say) has a tree over its leaves in the order of their key: eight
consecutive nodes have one parent, whose hash is over their hashes. The groups' roots, in the order of the groups, are
the leaves of one more tree of the same kind, whose root stands for the dataset.

Upward supersteps: a child messages its hash and place to its parent. A parent that has as many children as its tree
gives it is complete: it hashes and messages upward in the next superstep; the others keep what they have and wait (the
upper tree waits for the highest of the group trees). Downward supersteps: the root messages to its children the path
above them, each adds their siblings and passes it on, and the lowest parents, which hold their leaves, fold
every leaf's path and compare the result with the root.

Leaves are hashed and ordered by DataFrame operations: ranges are numbered in parallel, so that no task sorts a
whole group. A vertex has eight children at most and levels shrink by eight, so a hot group costs what its rows
cost. Leaves are shuffled once (hashes and key, not the row), and meet the proofs where their parents are: the
paths of a dataset are sent once for eight leaves. What each superstep leaves is checkpointed in the shared folder,
so a lost executor costs one superstep.

H is the lower-case hex SHA-256 of concatenated texts; digests count as hex text. A leaf is H of its fields in
order, each ``-`` if null, else the number of its UTF-8 bytes, a colon and the value. A null group comes first, groups follow
in UTF-8 order; null keys come first, equal keys are ordered by their leaves. Equal rows are leaves of their own with one
content. The crc32 of a null key is that of the empty text. Extra columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, tidied, written
from tessera.operators.load import numbered

#: Children of a vertex.
FAN_OUT = 8
#: Vertices of a partition, about.
VERTICES = 20_000
#: The tree over the groups' roots, and the key above every root.
UPPER, ROOT = -1, (-2, 0, 0)
_UPPERS, _LOWERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Key = tuple[int, int, int]  # tree, level, place


def leaf(fields: list[Column]) -> Column:
    """The hash of a row."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPERS, _LOWERS)


def width(leaves: int, level: int) -> int:
    """The nodes of a level of a tree."""
    for _ in range(level):
        leaves = -(-leaves // FAN_OUT)
    return leaves


def parent(key: Key, leaves: int, groups: int) -> tuple[Key, int, int, int]:
    """A node's parent, the node's place there, the leaves of the parent's tree, and the children that the parent has."""
    tree, level, place = key
    if (nodes := width(leaves, level)) > 1:
        above = place // FAN_OUT
        return (tree, level + 1, above), place % FAN_OUT, leaves, min(FAN_OUT, nodes - above * FAN_OUT)
    if tree == UPPER or groups == 1:
        return ROOT, 0, 0, 1
    above = tree // FAN_OUT
    return (UPPER, 1, above), tree % FAN_OUT, groups, min(FAN_OUT, groups - above * FAN_OUT)


def folded(hash_: bytes, path: tuple) -> str:
    """The root (hex) that a leaf and its path (siblings before and after, level by level) lead to."""
    at = hash_.hex()
    for before, after in path:
        at = hashlib.sha256((before.hex() + at + after.hex()).encode()).hexdigest()
    return at


def _kept(rdd: RDD, counted: Callable[[tuple], bool]) -> tuple[RDD, int]:
    """Computed, and written to the shared folder; how many entries are ``counted``."""
    rdd = rdd.persist(StorageLevel.DISK_ONLY)
    rdd.checkpoint()
    found = rdd.filter(counted).count()
    rdd.unpersist()
    return rdd, found


def _ranked(leaves: DataFrame) -> tuple[DataFrame, int]:
    """The leaves with ``tree`` (the group's number from 0), ``place`` in it and ``size`` of it; the number of groups."""
    rows = written(numbered(leaves, [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf")], "at"), "numbered")
    spans = rows.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    spans = written(numbered(spans, [F.col("group").asc_nulls_first()], "tree"), "groups")
    # Both sides have a row for the null group; adaptive execution broadcasts few groups and splits hot ones.
    placed = rows.join(spans, rows["group"].eqNullSafe(spans["group"])).select("key", "leaf", "changed", (F.col("tree") - 1).alias("tree"), (F.col("at") - F.col("first")).alias("place"), "size")
    return placed, spans.count()


def _upward(leaves: RDD, groups: int, count: int) -> list[RDD]:
    """Complete vertices of each superstep: (key, (hash, children)); a child is (place, hash, its key or its leaf's row)."""

    def first(row) -> tuple[Key, tuple]:
        above, place, size, due = parent((row["tree"], 0, row["place"]), row["size"], groups)
        return above, (place, bytes(row["leaf"]), size, due, (row["key"], bytes(row["changed"])))

    def gathered(entry: tuple[Key, list]) -> tuple[Key, bool, list]:
        key, children = entry[0], sorted(entry[1], key=lambda c: c[0])
        return key, len(children) == children[0][3], children

    def hashed(entry: tuple[Key, bool, list]) -> tuple[Key, tuple]:
        key, _, children = entry
        hash_ = children[0][1] if key == ROOT else hashlib.sha256("".join(c[1].hex() for c in children).encode()).digest()
        return key, (hash_, children[0][2], [(c[0], c[1], c[4]) for c in children])

    def message(entry: tuple[Key, tuple]) -> tuple[Key, tuple]:
        key, (hash_, size, _) = entry
        above, place, size, due = parent(key, size, groups)
        return above, (place, hash_, size, due, key)

    steps, messages = [], leaves.map(first)
    while True:
        # Levels shrink: so do the tasks of their supersteps.
        parts = max(1, -(-count // (FAN_OUT * VERTICES)))
        inbox, unfinished = _kept(messages.groupByKey(parts).coalesce(parts).map(gathered), lambda v: v[0] != ROOT)
        steps.append(inbox.filter(lambda v: v[1]).map(hashed))
        if not unfinished:
            return steps
        # Complete vertices message upward; those that wait send themselves what they have.
        messages = inbox.flatMap(lambda v: [message(hashed(v))] * (v[0] != ROOT) if v[1] else [(v[0], c) for c in v[2]])
        count = -(-count // FAN_OUT) + groups


def _downward(steps: list[RDD]) -> RDD:
    """(key, leaf, subroot, root, proof, folded root) of every leaf, in parts by superstep."""

    def spread(entry: tuple[Key, tuple]) -> Iterator[tuple]:
        """What a vertex with its path tells its children: to inner ones (True, key, message), of leaves (False, row)."""
        key, ((hash_, _, children), (path, subroot, root)) = entry
        hashes = [c[1] for c in children]
        for i, (_, own, child) in enumerate(children):
            is_leaf = len(child) == 2
            # The top of a group's tree hangs below the upper tree or below the root.
            top = key[0] < 0 and (is_leaf or child[0] >= 0)
            down = path if key == ROOT else ((b"".join(hashes[:i]), b"".join(hashes[i + 1 :])), *path)
            low = own if top else subroot
            whole = own if key == ROOT else root
            if is_leaf:
                proof = hashlib.sha256("".join(a.hex() + b.hex() for a, b in down).encode()).hexdigest()
                yield False, (child[0], own.hex(), low.hex(), whole.hex(), proof, folded(child[1], down))
            else:
                yield True, (child, (down, low, whole))

    rows, paths = [], None
    for vertices in reversed(steps):
        n = vertices.getNumPartitions()
        if paths is None:
            met = vertices.mapValues(lambda v: (v, ((), None, None)))
            told, _ = _kept(met.flatMap(spread), lambda t: t[0])
        else:
            # A path whose vertex was complete in an earlier superstep goes on to it.
            met = vertices.cogroup(paths, n).coalesce(n).flatMapValues(lambda x: [(next(iter(x[0]), None), p) for p in x[1]])
            told, _ = _kept(met.flatMap(lambda e: spread(e) if e[1][0] is not None else [(True, (e[0], e[1][1]))]), lambda t: t[0])
        rows.append(told.filter(lambda t: not t[0]).map(lambda t: t[1]))
        paths = told.filter(lambda t: t[0]).map(lambda t: t[1])
    return rows[0].context.union(rows)


def manifest(docs: DataFrame, key: str, group: str, fields: list[str], tampered: dict[str, Column] | None = None) -> DataFrame:
    """(``key``, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    ``tampered``: fields as they are met again at verification (columns of ``docs``); without it, the row as it is. A
    row is verified if its leaf as met again leads to the root by the siblings of the manifest.
    """
    spark = docs.sparkSession
    again = tampered or {}
    changed = leaf([again.get(c, F.col(f"`{c}`")) for c in fields])
    with tidied() as keep:
        leaves = written(docs.select(F.col(f"`{group}`").cast("string").alias("group"), F.col(f"`{key}`").alias("key"), F.unhex(leaf([F.col(f"`{c}`") for c in fields])).alias("leaf"), F.unhex(changed).alias("changed")), "leaves")
        types = f"`{key}` {docs.schema[key].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
        if not (count := leaves.count()):
            return spark.createDataFrame([], types + ", verified boolean")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        placed, groups = _ranked(leaves)
        placed = written(placed, "placed")
        found = spark.createDataFrame(_downward(_upward(placed.rdd, groups, count)), types, verifySchema=False)
        return keep(written(found.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest"))


def changed_case(key: Column, text: Column) -> Column:
    """The tampering of the query: where 3 divides the crc32 of a key, a text's A-Z are lower-cased."""
    return F.when(F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 0, ascii_lower(text)).otherwise(text)


def _levels(of: str, by: str, leaves: str, levels: int) -> str:
    """CTEs of the nodes (grp, level, place, h) of trees over ``leaves`` (grp, place, h), and of the width of each tree's levels."""
    out = [f"{of}0 AS (SELECT grp, place, h, count(*) OVER (PARTITION BY grp) AS n FROM {leaves})"]
    for i in range(1, levels + 1):
        out.append(f"{of}{i} AS (SELECT grp, place // {FAN_OUT} AS place, sha256(string_agg(h, '' ORDER BY place)) AS h, max((n + {FAN_OUT - 1}) // {FAN_OUT}) AS n FROM {of}{i - 1} WHERE n > 1 GROUP BY grp, place // {FAN_OUT})")
    return ",\n".join(out)


def _paths(of: str, top: str, levels: int) -> str:
    """CTEs (grp, place, path) from the highest level down: lists of (before, after) below the path of the tree's root (``top``: grp, path)."""
    out = []
    for i in range(levels, -1, -1):
        at = f"SELECT a.grp, a.place, t.path FROM {of}{i} a JOIN {top} t USING (grp) WHERE a.n = 1"
        if i < levels:
            sib = f"SELECT grp, place, coalesce(string_agg(h, '') OVER (PARTITION BY grp, place // {FAN_OUT} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER (PARTITION BY grp, place // {FAN_OUT} ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {of}{i} WHERE n > 1"
            at += f" UNION ALL SELECT s.grp, s.place, list_concat([{{'before': s.before, 'after': s.after}}], p.path) FROM ({sib}) s JOIN {of}p{i + 1} p ON p.grp = s.grp AND p.place = s.place // {FAN_OUT}"
        out.append(f"{of}p{i} AS ({at})")
    return ",\n".join(out)


def oracle(levels: int = 8, upper: int = 3) -> str:
    """SQL for trees of up to ``8 ** levels`` leaves and ``8 ** upper`` groups over ``documents``."""
    fields = lambda text: "sha256(" + " || ".join(f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1))), 4294967295)"
    tops = lambda of, n, what="h": " UNION ALL ".join(f"SELECT grp, {what} FROM {of}{i} WHERE n = 1" for i in range(n + 1))
    return f"""
WITH d AS (SELECT doc_id, lang, {fields('text')} AS leaf, {fields(f"CASE WHEN {crc} % 3 = 0 THEN translate(text, '{_UPPERS}', '{_LOWERS}') ELSE text END")} AS changed FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM (SELECT DISTINCT lang FROM d)),
l AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf AS h, doc_id, changed FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
{_levels("a", "grp", "l", levels)},
r AS ({tops("a", levels)}),
u AS (SELECT 0 AS grp, grp AS place, h FROM r),
{_levels("b", "grp", "u", upper)},
whole AS (SELECT h AS root FROM ({tops("b", upper)})),
none AS (SELECT 0 AS grp, CAST([] AS STRUCT("before" VARCHAR, "after" VARCHAR)[]) AS path),
{_paths("b", "none", upper)},
above AS (SELECT place AS grp, path FROM bp0),
{_paths("a", "above", levels)}
SELECT l.doc_id, l.h AS leaf, r.h AS subroot, whole.root, sha256(array_to_string(list_transform(p.path, lambda x: x.before || x.after), '')) AS proof_sha256,
  list_reduce(list_prepend(l.changed, list_transform(p.path, lambda x: x.before || ',' || x.after)), lambda s, x: sha256(split_part(x, ',', 1) || s || split_part(x, ',', 2))) AS folded_root,
  folded_root = whole.root AS verified
FROM l JOIN r USING (grp) JOIN ap0 p ON p.grp = l.grp AND p.place = l.place CROSS JOIN whole
"""


ORACLE = oracle()
