"""Commitments to sets: one hash that stands for a sorted set, with a path that proves a member."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.load import numbered, ordered_ids
from tessera.storage import written

#: Children of a node.
FAN_OUT = 64


def leaves(ids: DataFrame, column: str) -> DataFrame:
    """(level, place, hash) of the distinct ids in order; ranges are numbered in parallel."""
    numbered = ordered_ids(ids.select(F.col(column).cast("string").alias("id")).distinct(), ["id"], "P")
    place = F.substring("code", 3, 20).cast("long") - 1
    return numbered.select(F.lit(0).alias("level"), place.alias("place"), F.sha2(F.concat(F.lit("leaf:"), F.col("id")), 256).alias("hash"))


def tree(ids: DataFrame, column: str, fan_out: int = FAN_OUT) -> DataFrame:
    """All nodes over the distinct ids in order. An empty set has no node."""
    return grown(leaves(ids, column), fan_out)


def grown(leaves: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """All nodes over leaves with places from 0: level by level, each the hash of its children in order.

    A level is one grouping on the parent's place; its groups are at most ``fan_out`` rows, and levels shrink by it.
    """
    level = written(leaves, "leaves")
    nodes, depth, n = level, 0, level.count()
    while n > 1:
        depth += 1
        children = F.array_sort(F.collect_list(F.struct("place", "hash")))
        parents = level.groupBy((F.floor(F.col("place") / fan_out)).alias("_place")).agg(children.alias("_c"))
        joined = F.array_join(F.transform("_c", lambda c: c["hash"]), ":")
        level = written(parents.select(F.lit(depth).alias("level"), F.col("_place").alias("place"), F.sha2(F.concat(F.lit("node:"), joined), 256).alias("hash")), "level")
        nodes = nodes.unionByName(level)
        n = -(-n // fan_out)
    return nodes


def packed(*columns: str) -> Column:
    """The values of a row as one text that tells them apart: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    value = lambda c: F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))
    return F.concat(*(F.coalesce(value(c), F.lit("-")) for c in columns))


def ordered_tree(rows: DataFrame, order: list[str], fields: list[str], fan_out: int = FAN_OUT) -> DataFrame:
    """All nodes over the rows of a list in ``order``: every row is a leaf over its ``fields``, repeated rows too.

    Columns outside ``fields``, such as clocks of a transport, leave the tree alone. Rows of the same place are taken by
    their fields, so the order of the frame never matters. Places are ranks inside ranges: no task or row holds the list.
    """
    held = rows.select(*(F.col(c).alias(f"_at_{i}") for i, c in enumerate(order)), packed(*fields).alias("_content"))
    places = numbered(held, [*(f"_at_{i}" for i in range(len(order))), "_content"], "_place")
    return grown(places.select(F.lit(0).alias("level"), (F.col("_place") - 1).cast("long").alias("place"), F.sha2(F.concat(F.lit("leaf:"), F.col("_content")), 256).alias("hash")), fan_out)


def ordered_root(nodes: DataFrame, tag: str) -> DataFrame:
    """One row (n, height, root_hash, commitment) of an ordered tree: the commitment is over ``tag``, the number of rows and the top hash."""
    top = root(nodes).join(nodes.agg(F.count_if(F.col("level") == 0).alias("n")))  # one row each
    return top.select("n", "height", F.col("hash").alias("root_hash"), F.sha2(F.concat_ws(":", F.lit(f"{tag}/root"), F.col("n").cast("string"), "hash"), 256).alias("commitment"))


def root(nodes: DataFrame) -> DataFrame:
    """(hash, height): the node above all; of an empty set, the hash of the word ``empty`` and height 0."""
    top = nodes.agg(F.max_by("hash", "level").alias("hash"), F.max("level").alias("height"))
    return top.select(F.coalesce("hash", F.sha2(F.lit("empty"), 256)).alias("hash"), F.coalesce("height", F.lit(0)).alias("height"))


def proof(nodes: DataFrame, place: int | Column, fan_out: int = FAN_OUT) -> DataFrame:
    """The nodes that prove the member at a place: its siblings on every level."""
    at = place if isinstance(place, Column) else F.lit(place)
    parent = F.floor(at / F.pow(F.lit(float(fan_out)), F.col("level") + 1))
    return nodes.filter(F.floor(F.col("place") / fan_out) == parent)


def balanced(items: DataFrame, key: str, content: str, tag: str) -> DataFrame:
    """The nodes of the balanced binary tree over items in the order of ``key`` (32 hex digits with or without dashes; distinct).

    The middle item of a range is its root. A node's hash is over ``tag`` with ``/node``, the key's bytes, the hash of
    ``content``, the hashes of both subtrees (of none: that of ``tag`` with ``/empty``), height, number of items, first and
    last key. (depth, lo, hi, place, key, hash, height, n, first_key, last_key), in place order from 0.

    Depths are hashed from the deepest up: each is one join of a depth with the one below, and depths halve.
    """
    placed = items.select(F.replace(F.lower(F.col(key)), F.lit("-"), F.lit("")).alias("key"), F.sha2(F.col(content), 256).alias("_item"))
    placed = written(ordered_ids(placed, ["key"], "P").select("key", "_item", (F.substring("code", 3, 20).cast("long") - 1).alias("place")), "placed")
    n = placed.count()
    # A place's range is found by halving from the whole: at most as many steps as the tree is high.
    begin = F.struct(F.lit(0).cast("long").alias("lo"), F.lit(n - 1).cast("long").alias("hi"), F.lit(0).alias("depth"))

    def halve(s, _):
        mid = F.call_function("div", s["lo"] + s["hi"], F.lit(2))
        at = F.col("place")
        return F.struct(F.when(at > mid, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(at < mid, mid - 1).otherwise(s["hi"]).alias("hi"), F.when(at == mid, s["depth"]).otherwise(s["depth"] + 1).alias("depth"))

    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length())))
    level = written(placed.withColumn("_s", F.reduce(steps, begin, halve)).select("*", "_s.lo", "_s.hi", "_s.depth").drop("_s"), "ranges")
    empty = F.sha2(F.lit(f"{tag}/empty"), 256)
    below, nodes = None, []
    for depth in range(n.bit_length() - 1, -1, -1):
        here = level.filter(F.col("depth") == depth)
        mid = F.col("place")
        if below is None:
            sides = {f"_{s}_{c}": F.lit(None).cast(t) for s in "lr" for c, t in (("hash", "string"), ("height", "int"), ("n", "long"), ("first", "string"), ("last", "string"))}
            here = here.withColumns(sides)
        else:
            for s, lo, hi in (("l", F.col("lo"), mid - 1), ("r", mid + 1, F.col("hi"))):
                side = below.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("hash").alias(f"_{s}_hash"), F.col("height").alias(f"_{s}_height"), F.col("n").alias(f"_{s}_n"), F.col("first_key").alias(f"_{s}_first"), F.col("last_key").alias(f"_{s}_last"))
                here = here.join(side, (F.col("_lo") == lo) & (F.col("_hi") == hi), "left").drop("_lo", "_hi")
        zero = F.lit(0)
        height = F.greatest(F.coalesce("_l_height", zero), F.coalesce("_r_height", zero)) + 1
        count = F.coalesce("_l_n", zero) + F.coalesce("_r_n", zero) + 1
        first, final = F.coalesce("_l_first", "key"), F.coalesce("_r_last", "key")
        made = F.sha2(F.concat(F.lit(f"{tag}/node").cast("binary"), F.unhex("key"), F.unhex("_item"), F.unhex(F.coalesce("_l_hash", empty)), F.unhex(F.coalesce("_r_hash", empty)), F.unhex(F.lpad(F.hex(height), 4, "0")), F.unhex(F.lpad(F.hex(count), 16, "0")), F.unhex(first), F.unhex(final)), 256)
        below = written(here.select("depth", "lo", "hi", "place", "key", made.alias("hash"), height.alias("height"), count.cast("long").alias("n"), first.alias("first_key"), final.alias("last_key")), "depth")
        nodes.append(below)
    return reduce(DataFrame.unionByName, nodes) if nodes else level.select(F.lit(0).alias("depth"), "lo", "hi", "place", "key", F.lit("").alias("hash"), F.lit(0).alias("height"), F.lit(0).cast("long").alias("n"), F.col("key").alias("first_key"), F.col("key").alias("last_key"))


def balanced_root(nodes: DataFrame, tag: str) -> DataFrame:
    """One row (root_hash, n, first_key, last_key, commitment); an empty set has no keys and the hash of ``tag`` with ``/empty``."""
    top = nodes.filter("depth = 0").agg(*(F.first(c).alias(c) for c in ("hash", "n", "first_key", "last_key")))
    top = top.select(F.coalesce("hash", F.sha2(F.lit(f"{tag}/empty"), 256)).alias("root_hash"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "first_key", "last_key")
    end = lambda c: F.coalesce(F.unhex(F.concat(F.lit("01"), F.col(c))), F.unhex(F.lit("00")))
    whole = F.concat(F.lit(f"{tag}/root").cast("binary"), F.unhex("root_hash"), F.unhex(F.lpad(F.hex("n"), 16, "0")), end("first_key"), end("last_key"))
    return top.withColumn("commitment", F.sha2(whole, 256))


def balanced_proof(nodes: DataFrame, place: int) -> DataFrame:
    """The nodes on the way from the root to a place: as many as the tree is high at most."""
    return nodes.filter(F.lit(place).between(F.col("lo"), F.col("hi")))
