"""A hash tree over a set of keys that is changed in place by revisions, and read by pages that prove themselves.

Keys are hex digits of one length, such as ids without dashes or digests, so they are spread evenly. A node stands for a
prefix of an even number of digits under which two or more keys part ways, so it has at most 256 children; the node of the
empty prefix is the root and always there. The tree follows from the set alone, whatever the changes that led to it.

A table of nodes has (revision, prefix, children, n, hash), children an array of (prefix, n, hash) in order; a node that a
revision takes away is a row without hash. A revision adds the nodes on the ways to the keys that it changes, nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.overlay import latest
from tessera.storage import tidied, written

#: Digits that a step of the tree takes.
STEP = 2
NODE = "revision long, prefix string, children array<struct<prefix:string,n:long,hash:string>>, n long, hash string"


class Broken(ValueError):
    """Nodes that don't follow from the committed root, or a key that isn't a member of it."""


def node_hash(prefix: Column, children: Column) -> Column:
    """The hash of a node: over its prefix and, in order, prefix, number of keys and hash of each child."""
    part = lambda c: F.concat_ws(":", c["prefix"], c["n"].cast("string"), c["hash"])
    return F.sha2(F.concat(F.lit("node:"), prefix, F.lit("/"), F.array_join(F.transform(children, part), "/")), 256)


def leaf(key: Column, content: Column) -> Column:
    return F.struct(key.alias("prefix"), F.lit(1).cast("long").alias("n"), F.sha2(F.concat(F.lit("leaf:"), key, F.lit(":"), content), 256).alias("hash"))


def _placed(tops: DataFrame) -> DataFrame:
    """``tops`` with ``_depth``: the longest prefix that each shares with a neighbour in order, which is where it meets others first.

    Neighbours are looked for under their first four digits; where these differ, so do all longer prefixes.
    """
    order = Window.partitionBy(F.substring("prefix", 1, 2 * STEP)).orderBy("prefix")
    steps = F.sequence(F.lit(STEP), F.greatest(F.length("prefix"), F.lit(STEP)), F.lit(STEP))
    shared = lambda other: F.size(F.filter(steps, lambda d: F.substring(F.col("prefix"), F.lit(1), d) == F.substring(other, F.lit(1), d)))
    near = tops.withColumns({"_before": F.lag("prefix").over(order), "_after": F.lead("prefix").over(order)})
    return near.select("prefix", "n", "hash", (STEP * F.greatest(F.lit(1), shared(F.col("_before")), shared(F.col("_after")))).alias("_depth"))


def _grown(tops: DataFrame, revision: int) -> DataFrame:
    """The nodes over ``tops`` (prefix, n, hash: keys, and nodes that are done), the root's included.

    One grouping a length of prefix, from the deepest shared one up; a group is at most 256 rows. A top comes in at the
    length that it shares with a neighbour, so each is grouped once but for those that share two digits at most. What is
    alone under a prefix is handed on as it is.
    """
    placed = written(_placed(tops), "placed")
    deepest = placed.agg(F.max("_depth")).first()[0] or STEP
    nodes, rest = [], None
    for depth in range(deepest, -1, -STEP):
        own = placed.filter(F.col("_depth") == depth).drop("_depth")
        rest = own if rest is None else rest.unionByName(own)
        at = F.substring("prefix", 1, depth) if depth else F.lit("")
        # What already stands for a shorter prefix waits for its turn.
        groups = rest.groupBy(F.when(F.length("prefix") > depth, at).otherwise(F.col("prefix")).alias("at")).agg(F.array_sort(F.collect_list(F.struct("prefix", "n", "hash"))).alias("children"))
        total = F.aggregate("children", F.lit(0).cast("long"), lambda n, c: n + c["n"])
        made = (F.size("children") > 1) | F.lit(depth == 0)
        level = written(groups.select("at", "children", made.alias("made"), total.alias("n"), node_hash(F.col("at"), F.col("children")).alias("hash")), "keytree")
        nodes.append(level.filter("made").select(F.lit(revision).cast("long").alias("revision"), F.col("at").alias("prefix"), "children", "n", "hash"))
        alone = F.col("children")[0]
        rest = level.select(*(F.when(F.col("made"), F.col(own)).otherwise(alone[c]).alias(c) for own, c in (("at", "prefix"), ("n", "n"), ("hash", "hash"))))
    return reduce(DataFrame.unionByName, nodes)


def at_revision(nodes: DataFrame, revision: int | None = None) -> DataFrame:
    """The nodes in force at a revision (null: the last one)."""
    known = nodes if revision is None else nodes.filter(F.col("revision") <= revision)
    return latest(known, ["prefix"], ["revision"]).filter("hash IS NOT NULL")


def revised(nodes: DataFrame | None, changes: DataFrame, key: str, content: str, revision: int) -> DataFrame:
    """The rows that a revision adds to ``nodes`` (null: there are none yet); append them to it.

    ``changes`` has each key once: with its content, or null for a key that goes, whether or not it was there. Null keys are
    no keys. Only nodes on the ways to changed keys are read and made, so a revision costs its changes times the height. A
    revision whose changes alter nothing adds no rows, but the first always adds a root.
    """
    given = changes.filter(F.col(key).isNotNull()).select(F.lower(F.replace(F.col(key), F.lit("-"), F.lit(""))).alias("key"), F.col(content).cast("string").alias("content"))
    put = given.filter("content IS NOT NULL").select(F.inline(F.array(leaf(F.col("key"), F.col("content")))))
    if nodes is None:
        made = _grown(written(put, "tops"), revision)
        # A set without keys has a root without children.
        empty = made.sparkSession.range(1).select(F.lit(revision).cast("long").alias("revision"), F.lit("").alias("prefix"), F.array().cast("array<struct<prefix:string,n:long,hash:string>>").alias("children"), F.lit(0).cast("long").alias("n"))
        return made if not put.isEmpty() else empty.withColumn("hash", node_hash(F.col("prefix"), F.col("children")))
    # Tables on the way go once the revision is written.
    with tidied() as keep:
        ways = given.select(F.explode(F.sequence(F.lit(0), F.length("key") - STEP, F.lit(STEP))).alias("d"), "key").select(F.substring(F.col("key"), F.lit(1), F.col("d")).alias("prefix")).distinct()
        passed = written(at_revision(nodes).join(ways, "prefix", "left_semi"), "passed")
        # Beside the ways: what the nodes on them hold, but for these nodes and the changed keys themselves.
        beside = passed.select(F.inline("children")).join(passed.select("prefix").unionByName(given.select(F.col("key").alias("prefix"))), "prefix", "left_anti")
        tops = written(beside.unionByName(put), "tops")
        new = _grown(tops, revision) if not tops.isEmpty() else revised(None, changes.limit(0), key, content, revision)
        old = passed.select("prefix", F.col("hash").alias("_old"))
        changed = new.join(old, "prefix", "left").filter(~F.col("hash").eqNullSafe(F.col("_old"))).select(new.columns)
        gone = passed.join(new, "prefix", "left_anti").select(F.lit(revision).cast("long").alias("revision"), "prefix", F.lit(None).cast("array<struct<prefix:string,n:long,hash:string>>").alias("children"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("hash"))
        return keep(written(changed.unionByName(gone), "revised"))


def root(nodes: DataFrame, revision: int | None = None) -> DataFrame:
    """One row (n, hash) of a revision."""
    return at_revision(nodes.filter("prefix = ''"), revision).select("n", "hash")


class Page:
    """Members of a page in order, whether more follow, and how many nodes were read for it."""

    def __init__(self, members: list[tuple[str, str]], more: bool, reads: int, height: int):
        self.members, self.more, self.reads, self.height = members, more, reads, height


def page(nodes: DataFrame, committed: str, after: str | None, size: int, revision: int | None = None) -> Page:
    """The next ``size`` members (key, leaf hash) after a member, read under the root hash ``committed`` of a revision.

    The nodes on the way to the member give its place by their numbers of keys; below that, only nodes whose keys are of the
    page are read: at most one filter of the table a level, and rows in proportion to height and size. Every node's hash is
    computed from its children and held against its parent's; :class:`Broken` says that one differs, or that ``after``
    isn't a member. A page is small by contract, so the driver holds it.
    """
    if size < 1:
        raise ValueError("a page has at least one row")
    live, reads = at_revision(nodes, revision), 0

    def read(expected: dict[str, str]) -> dict[str, list]:
        nonlocal reads
        found = live.filter(F.col("prefix").isin(list(expected))).select("prefix", "children", node_hash(F.col("prefix"), F.col("children")).alias("hash")).collect()
        reads += len(found)
        if {r["prefix"]: r["hash"] for r in found} != expected:
            raise Broken("a node isn't the one that its parent or the root names")
        return {r["prefix"]: r["children"] for r in found}

    begin, height = 0, 0
    if after is not None:
        # All nodes that may be on the way are named by the member itself; they are held against their parents from the root down.
        rows = {r["prefix"]: r for r in live.filter(F.col("prefix").isin([after[:d] for d in range(0, len(after), STEP)])).select("prefix", "children", node_hash(F.col("prefix"), F.col("children")).alias("hash")).collect()}
        reads += len(rows)
        prefix, expected = "", committed
        while prefix != after:
            if prefix not in rows or rows[prefix]["hash"] != expected:
                raise Broken("a node isn't the one that its parent or the root names")
            children, height = rows[prefix]["children"], height + 1
            begin += sum(c["n"] for c in children if c["prefix"] < prefix_of(after, c["prefix"]))
            following = [c for c in children if after.startswith(c["prefix"])]
            if not following:
                raise Broken("the place isn't a member of the committed set")
            prefix, expected = following[0]["prefix"], following[0]["hash"]
        begin += 1
    end, depth, members = begin + size + 1, 0, []
    frontier = {"": (0, committed)}
    while frontier:
        depth += 1
        below, following = read({p: h for p, (_, h) in frontier.items()}), {}
        for prefix, children in below.items():
            at = frontier[prefix][0]
            for c in children:
                if at < end and at + c["n"] > begin:
                    # Keys have one length, and a node has fewer digits than they.
                    if c["n"] == 1:
                        members.append((c["prefix"], c["hash"]))
                    else:
                        following[c["prefix"]] = (at, c["hash"])
                at += c["n"]
        frontier = following
    members.sort()
    return Page(members[:size], len(members) > size, reads, max(height, depth))


def prefix_of(key: str, other: str) -> str:
    """As many digits of a key as another prefix has."""
    return key[: len(other)]
