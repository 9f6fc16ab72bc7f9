"""Trees over keys that are changed by revisions: the tree follows from the set, revisions are small, pages prove themselves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import keytree


def plain(items):
    """(hash, height, number of nodes) of the root by the definition."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def grown(depth, keys, top=False):
        if len(keys) == 1 and not top:
            return keys[0], 1, sha(f"leaf:{keys[0]}:{items[keys[0]]}"), 0, 0
        while not top and len({k[: depth + 2] for k in keys}) == 1:
            depth += 2
        groups = {}
        for k in keys:
            groups.setdefault(k[: depth + 2], []).append(k)
        below = [grown(depth + 2, g) for _, g in sorted(groups.items())]
        prefix = keys[0][:depth] if keys else ""
        text = f"node:{prefix}/" + "/".join(f"{p}:{n}:{h}" for p, n, h, *_ in below)
        return prefix, len(keys), sha(text), 1 + max((b[3] for b in below), default=0), 1 + sum(b[4] for b in below)

    _, n, digest, height, nodes = grown(0, sorted(items), True)
    return n, digest, height, nodes


def changed(spark, changes):
    return spark.createDataFrame(list(changes.items()), "key string, content string")


def test_tree_follows_from_the_set(spark):
    rng = random.Random(3)
    # Few digits, so that keys share long prefixes and nodes come and go.
    pool = ["".join(rng.choice("01") for _ in range(8)) for _ in range(40)]
    items, nodes = {}, None
    for revision in range(6):
        batch = {k: rng.choice([None, "a", "b"]) for k in rng.sample(pool, rng.randint(1, 12))}
        if revision == 4:
            batch = dict.fromkeys(pool)  # all go
        added = keytree.revised(nodes, changed(spark, batch), "key", "content", revision)
        nodes = added if nodes is None else nodes.unionByName(added)
        items = {k: v for k, v in (items | batch).items() if v is not None}
        n, digest, _, count = plain(items)
        assert tuple(keytree.root(nodes).first()) == (n, digest)
        assert keytree.at_revision(nodes).count() == count
        if revision == 3:
            kept = digest
            again = keytree.revised(nodes, changed(spark, items), "key", "content", 4)
            assert again.count() == 0  # nothing new
    assert keytree.root(nodes, 3).first()["hash"] == kept


def test_revisions_and_pages_are_small(spark):
    """10,026 members: what a change adds and what a page reads is bounded by the height."""
    keys = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(10_026))
    nodes = keytree.revised(None, changed(spark, dict.fromkeys(keys, "x")), "key", "content", 0)
    n, digest, height, _ = plain(dict.fromkeys(keys, "x"))
    assert tuple(keytree.root(nodes).first()) == (n, digest) == (10_026, digest)
    for after, size in ((None, 100), (keys[4999], 100), (keys[-3], 100), (keys[10], 1)):
        begin = 0 if after is None else keys.index(after) + 1
        found = keytree.page(nodes, digest, after, size)
        assert [k for k, _ in found.members] == keys[begin : begin + size] and found.more == (begin + size < len(keys))
        assert found.height <= height and found.reads <= size + 1 + 2 * (height + 2)
    one = hashlib.md5(b"new").hexdigest()
    for revision, change in ((1, {one: "x"}), (2, {keys[77]: None}), (3, {keys[78]: "y"})):
        added = keytree.revised(nodes, changed(spark, change), "key", "content", revision)
        assert 0 < added.count() <= 4 * height + 4
        nodes = nodes.unionByName(added)
    last = {k: "x" for k in keys if k != keys[77]} | {one: "x", keys[78]: "y"}
    assert keytree.root(nodes).first()["hash"] == plain(last)[1]
    # An earlier revision is still read as it was.
    assert [k for k, _ in keytree.page(nodes, digest, keys[76], 2, revision=0).members] == keys[77:79]
    with pytest.raises(keytree.Broken):
        keytree.page(nodes, digest, keys[76], 2)
    with pytest.raises(keytree.Broken):
        keytree.page(nodes, plain(last)[1], keys[77], 2)


def test_changed_nodes_are_noticed(spark):
    keys = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(400))
    nodes = keytree.revised(None, changed(spark, dict.fromkeys(keys, "x")), "key", "content", 0)
    digest = keytree.root(nodes).first()["hash"]
    other = F.transform("children", lambda c: F.struct(c["prefix"].alias("prefix"), c["n"].alias("n"), F.when(c["prefix"] == keys[0], "0").otherwise(c["hash"]).alias("hash")))
    for forged in (nodes.withColumn("children", other), nodes.filter(F.col("prefix") != keys[0][:2])):
        for after in (None, keys[0]):
            with pytest.raises(keytree.Broken):
                keytree.page(forged, digest, after, 5)
    # Nodes beside the page aren't read.
    assert len(keytree.page(nodes.filter(F.col("prefix") != keys[-1][:2]), digest, None, 5).members) == 5


def test_empty_sets_and_null_keys(spark):
    none = changed(spark, {"aa": None}).unionByName(spark.createDataFrame([(None, "x")], "key string, content string"))
    nodes = keytree.revised(None, none, "key", "content", 0)
    assert tuple(keytree.root(nodes).first()) == plain({})[:2]
    found = keytree.page(nodes, plain({})[1], None, 3)
    assert (found.members, found.more) == ([], False)
    nodes = nodes.unionByName(keytree.revised(nodes, changed(spark, {"AA-bb": "x"}), "key", "content", 1))
    assert tuple(keytree.root(nodes).first()) == plain({"aabb": "x"})[:2]


def test_each_key_is_grouped_where_it_parts_from_others(spark, monkeypatch):
    """Not once a length of prefix: keys that share four digits or more with a neighbour come in once."""
    made, plain = [], keytree.written
    monkeypatch.setattr(keytree, "written", lambda df, name: made.append((name, plain(df, name))) or made[-1][1])
    n = 5000
    keys = spark.range(n).selectExpr("concat(lpad(hex(id % 50), 4, '0'), md5(cast(id AS string))) AS key", "'x' AS content").withColumn("key", F.lower("key"))
    nodes = keytree.revised(None, keys, "key", "content", 0)
    grouped = sum(df.filter("NOT made").count() for name, df in made if name == "keytree")
    assert keytree.root(nodes).first()["n"] == n
    assert grouped < n / 10
