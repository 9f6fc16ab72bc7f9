"""Previews, guards, decisions, commitments and streams."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import commitment, overlay, preview, reconcile, report
from tessera.sources import files
from tessera.streaming import ledger

FIELDS = [preview.Field("codigo", required=True, most=5), preview.Field("data", "date"), preview.Field("valor", "decimal"), preview.Field("duracao", "duration")]


def test_preview(spark):
    rows = spark.createDataFrame(
        [("row:2", ["A", "2024-02-29", "1,20", "59:59"]), ("row:3", [" ", "2024-02-30", "1.2,3", "1:60"]), ("row:4", ["=123456", "", "", ""]), ("row:5", ["=1"]), ("row:6", None)],
        "locator string, cells array<string>",
    )
    got = {r["locator"]: r for r in preview.preview(rows, {0: "codigo", 1: "data", 2: "valor", 3: "duracao"}, FIELDS, 4, ("codigo",)).collect()}
    assert (got["row:2"]["status"], got["row:2"]["payload"], got["row:2"]["scales"], got["row:2"]["attributes"]) == ("valid", {"codigo": "A", "data": "2024-02-29", "valor": "1.20", "duracao": "59:59"}, {"valor": 2}, {"codigo": "A"})
    assert got["row:3"]["errors"] == ["REQUIRED_FIELD:codigo", "INVALID_DATE:data", "INVALID_DECIMAL:valor", "INVALID_DURATION:duracao"]
    assert got["row:4"]["errors"] == ["FIELD_TOO_LONG:codigo"] and got["row:4"]["payload"]["codigo"] is None
    assert got["row:5"]["errors"] == ["FIELD_COUNT:_row", "FORMULA:codigo"]
    assert got["row:6"]["status"] == "rejected"
    assert len({r["row_hash"] for r in got.values()}) == 5


def test_mappings_and_policies():
    ok = {0: "codigo", 2: "valor"}
    preview.check_mapping(["codigo", "curso", "valor"], ok, FIELDS)
    for headers, mapping, code in ((["a", "a"], {0: "codigo"}, "HEADER_COLLISION"), (["a"], {}, "HEADER_MAPPING_INVALID"), (["a", "b"], {0: "codigo", 1: "codigo"}, "HEADER_MAPPING_INVALID"), (["curso"], {0: "codigo"}, "HEADER_MAPPING_INVALID"), (["a"], {0: "valor"}, "REQUIRED_FIELD_MISSING"), (["a", "b"], {0: "codigo"}, "HEADER_UNMAPPED")):
        with pytest.raises(preview.MappingError, match=code):
            preview.check_mapping(headers, mapping, FIELDS)
    preview.check_policy(["referencia"])
    for bad in (["a", "a"], ["valor"], ["row_id"], ["Curso"], ["trilha"], ["1a"]):
        with pytest.raises(ValueError):
            preview.check_policy(bad)


def test_requests_and_revisions(spark):
    requests = spark.createDataFrame([(1, "k1", "f1", False), (2, "k1", "f2", False), (3, "k9", "f1", True), (4, "k9", "f9", True), (5, "k8", "f8", False)], "request_id int, idempotency_key string, fingerprint string, expired boolean")
    known = spark.createDataFrame([("k1", "f1")], "idempotency_key string, fingerprint string")
    assert {r[0]: r[1] for r in preview.settle_requests(requests, known).collect()} == {1: "reused", 2: "conflict", 3: "reused", 4: "expired", 5: "applied"}
    current = spark.createDataFrame([(1, 3, "a", "s"), (2, 0, "b", "b"), (3, 2**63 - 1, "c", "c")], "k long, revision long, v string, source_v string")
    asked = spark.createDataFrame([(1, 1, 3, False, "z"), (2, 1, 2, False, "z"), (3, 1, 3, True, "z"), (4, 1, 3, True, "s"), (5, 2, 0, False, "b"), (6, 9, 0, False, "b"), (7, 3, 2**63 - 1, False, None)], "request_id long, k long, expected_revision long, restore boolean, v string")
    none = spark.createDataFrame([], "request_id long, hash string")
    verdicts = {r[0]: r[1] for r in preview.revision_guard(asked, current, "k", ["v"], none).collect()}
    assert verdicts == {1: "applied", 2: "conflict", 3: "not_source", 4: "applied", 5: "unchanged", 6: "missing", 7: "overflow"}
    hashed = asked.filter("request_id = 1").select("request_id", F.sha2(F.to_json(F.struct("v"), {"ignoreNullFields": "false"}), 256))
    twice = asked.filter("request_id = 1").unionByName(asked.filter("request_id = 2").withColumn("request_id", F.lit(1).cast("long")).withColumn("v", F.lit("other")))
    assert sorted(r[1] for r in preview.revision_guard(twice, current, "k", ["v"], hashed).collect()) == ["conflict", "reused"]


def batch(spark, n=3):
    lines = spark.createDataFrame([(i, {"a": str(i)}) for i in range(1, n + 1)], "line long, payload map<string,string>").withColumn("provenance", F.lit(None).cast("map<string,string>"))
    matches = spark.createDataFrame([(1, "unique", 10), (2, "unique", 10), (3, "none", None)], "line long, match string, record long")
    records = spark.createDataFrame([(10, {"a": "0"}, 1, "active"), (11, {"a": "0"}, 1, "disregarded")], "record long, payload map<string,string>, layer int, state string").withColumn("provenance", F.lit(None).cast("map<string,string>"))
    return lines, matches, records


def test_decisions_fold_in_order(spark):
    lines, matches, records = batch(spark)
    decided = lambda *rows: spark.createDataFrame(rows, "decision_id long, line long, outcome string, record long, revision int")
    state = lambda decisions, last: {r["line"]: (r["category"], r["conflict"]) for r in reconcile.fold_decisions(lines, decisions, records, matches, last).collect()}
    waiting = {1: ("conflict", "DUPLICATE_TARGET"), 2: ("conflict", "DUPLICATE_TARGET"), 3: ("conflict", "NO_CANDIDATE")}
    none = decided((0, 1, "reject", None, 9))
    assert state(none, 0) == waiting
    # Rejecting one of two leaves the other waiting until it gets its own decision.
    one = decided((1, 1, "reject", None, 1), (2, 2, "link", 10, 2), (3, 3, "create", None, 3))
    assert state(one, 1) == waiting | {1: ("rejected", None)}
    assert state(one, 3) == {1: ("rejected", None), 2: ("updated", None), 3: ("created", None)}
    # A link to a record that another line waits on stays a conflict; one to a disregarded record, too.
    assert state(decided((1, 1, "link", 10, 1)), 1)[1] == ("conflict", "DUPLICATE_TARGET")
    assert state(decided((1, 3, "link", 11, 1)), 1)[3] == ("conflict", "DISREGARDED")
    done = reconcile.fold_decisions(lines, one, records, matches, 3)
    before = reconcile.fold_decisions(lines, one, records, matches, 0)
    assert reconcile.decision_delta(before, done).count() == 3
    assert all(r["holds"] for r in reconcile.apply_gates(done, 4, 4).collect())
    assert {r["gate"] for r in reconcile.apply_gates(before, 4, 5).collect() if not r["holds"]} == {"nothing_waits", "base_version"}
    made = reconcile.events(done, "b")
    assert reconcile.append_events(made.limit(0), made).count() == made.count()
    assert reconcile.append_events(made, made).count() == 0


def plain_fold(lines, decisions, records, last):
    """``lines``: {line: [category, conflict, target, outcome]}, changed revision by revision; ``records``: {record: state}."""
    allowed = {"PROTECTED_LAYER": "link keep reject", "DISREGARDED": "reject", "NO_CANDIDATE": "link create reject", "MULTIPLE": "link create reject", "DUPLICATE_TARGET": "link create reject"}
    for revision in range(1, last + 1):
        chosen = {}
        for _, line, outcome, record, r in sorted(decisions):
            if r == revision and line in lines:
                chosen[line] = (outcome, record)
        for line, (outcome, record) in chosen.items():
            s = lines[line]
            if s[1] is None or outcome not in allowed[s[1]].split():
                continue
            s[3] = outcome
            s[2] = record if outcome == "link" else None if outcome == "create" else s[2]
            there = records.get(s[2])
            s[0] = {"reject": "rejected", "keep": "kept", "create": "created"}.get(outcome) or ("updated" if there == "active" else "conflict")
            s[1] = None if outcome != "link" else "NO_CANDIDATE" if there is None else "DISREGARDED" if there == "disregarded" else None
        buckets = {}
        for s in lines.values():
            if s[2] is not None and (s[0] in ("unchanged", "updated", "kept") or s[1] == "DUPLICATE_TARGET"):
                buckets.setdefault(s[2], []).append(s)
        for members in buckets.values():
            for s in members if len(members) > 1 else ():
                s[0], s[1] = "conflict", "DUPLICATE_TARGET"
    return {k: tuple(v) for k, v in lines.items()}


@pytest.mark.parametrize("in_task", [10**6, 0])
def test_fold_equals_one_revision_after_the_other(spark, in_task):
    """Random decisions over lines that share few records: parts that advance together end as in plain order."""
    draw = random.Random(5)
    n, last = 160, 9
    records = {r: draw.choice(("active", "active", "disregarded")) for r in range(90)}
    found = {line: draw.choice((None, draw.randrange(100))) for line in range(n)}
    decisions = [(i, draw.randrange(n + 5), (o := draw.choice(("link", "link", "create", "reject", "keep"))), draw.randrange(95) if o == "link" else None, draw.randrange(last + 2)) for i in range(400)]
    payload = F.create_map(F.lit("a"), F.lit("x"))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    held = frame(list(records.items()), "record long, state string").select("record", "state", payload.alias("payload"), F.lit(None).cast("map<string,string>").alias("provenance"), (1 + F.col("record") % 3).cast("int").alias("layer"))
    lines = frame([(k,) for k in range(n)], "line long").select("line", F.create_map(F.lit("a"), F.when(F.col("line") % 2 == 0, "x").otherwise("y")).alias("payload"), F.lit(None).cast("map<string,string>").alias("provenance"))
    matches = frame([(k, "none" if r is None else "unique", r) for k, r in found.items()], "line long, match string, record long")
    given = frame(decisions, "decision_id long, line long, outcome string, record long, revision int")
    fields = ("category", "conflict", "target", "outcome")
    begin = {r["line"]: [r[c] for c in fields] for r in reconcile.fold_decisions(lines, given, held, matches, 0).collect()}
    got = reconcile.fold_decisions(lines, given, held, matches, last, in_task).collect()
    want = plain_fold(begin, decisions, records, last)
    assert len(got) == n and {r["line"]: tuple(r[c] for c in fields) for r in got} == want
    # From the versions of any revision on, the later ones give the same lines.
    versions = reconcile.decision_versions(lines, given, held, matches, last, in_task).cache()
    begin = {r["line"]: [r[c] for c in fields] for r in versions.filter("revision = 0").collect()}
    middle = plain_fold(begin, decisions, records, 4)
    at = reconcile.replayed(versions.filter("revision = 0"), versions.filter("revision > 0"), 4)
    assert {r["line"]: tuple(r[c] for c in fields) for r in at.collect()} == middle
    assert {r["line"]: tuple(r[c] for c in fields) for r in reconcile.replayed(at, versions.filter("revision > 4"), last).collect()} == want
    assert len({v[1] for v in want.values()}) >= 4


def test_connected(spark):
    """Chains, cycles, a hub and repeated edges; the smallest node of each is its root."""
    edges = [(i, i + 1) for i in range(40) if i != 20] + [(100, k) for k in range(101, 140)] + [(300, 301), (301, 302), (302, 300), (300, 301), (400, 400)]
    got = {r["node"]: r["root"] for r in reconcile.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 if k <= 20 else 21 for k in range(41)} | {k: 100 for k in range(100, 140)} | {k: 300 for k in (300, 301, 302)}
    assert reconcile.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 11])
def test_balanced_commitment(spark, n):
    items = sorted((hashlib.md5(str(k).encode()).hexdigest(), f"item {k}") for k in range(n))
    sha = lambda *parts: hashlib.sha256(b"".join(parts)).digest()

    def node(lo, hi):
        if lo > hi:
            return sha(b"t/empty"), 0
        mid = (lo + hi) // 2
        (left, a), (right, b) = node(lo, mid - 1), node(mid + 1, hi)
        key = lambda i: bytes.fromhex(items[i][0])
        return sha(b"t/node", key(mid), sha(items[mid][1].encode()), left, right, (max(a, b) + 1).to_bytes(2, "big"), (hi - lo + 1).to_bytes(8, "big"), key(lo), key(hi)), max(a, b) + 1

    rows = [(f"{k[:8]}-{k[8:12]}-{k[12:16]}-{k[16:20]}-{k[20:]}".upper(), c) for k, c in items]
    nodes = commitment.balanced(spark.createDataFrame(rows, "id string, content string").repartition(3), "id", "content", "t")
    top, root = commitment.balanced_root(nodes, "t").first(), node(0, n - 1)[0]
    ends = b"".join(b"\x01" + bytes.fromhex(items[i][0]) for i in (0, -1)) if n else b"\x00\x00"
    assert (top["root_hash"], top["n"]) == (root.hex(), n)
    assert top["commitment"] == sha(b"t/root", root, n.to_bytes(8, "big"), ends).hex()
    assert nodes.count() == n and (n < 11 or commitment.balanced_proof(nodes, 3).count() <= 4)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 16, 17, 70])
def test_ordered_tree(spark, n):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    rows = [(i // 2, "é" * (i % 3) if i % 5 else None, i % 4) for i in range(n)]
    pack = lambda r: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[1], r[2]))
    level, height = [sha("leaf:" + c) for _, c in sorted((r[0], pack(r)) for r in rows)], 0
    while len(level) > 1:
        level, height = [sha("node:" + ":".join(level[i : i + 4])) for i in range(0, len(level), 4)], height + 1
    top = level[0] if level else sha("empty")

    def got(rows, parts):
        df = spark.createDataFrame([(*r, random.random()) for r in rows], "at int, name string, v int, clock double").repartition(parts)
        return commitment.ordered_root(commitment.ordered_tree(df, ["at"], ["name", "v"], 4), "t").first()

    one, two = got(rows, 3), got(rows[::-1], 2)
    assert tuple(one) == tuple(two) == (n, height, top, sha(f"t/root:{n}:{top}"))
    if n > 2:
        moved = [(10**6 if i == 0 else r[0], *r[1:]) for i, r in enumerate(rows)]
        assert got(moved, 3)["commitment"] != one["commitment"]
        # What is read as fields can't be read as others.
        assert got([(0, "1:2", 3)], 1)["root_hash"] != got([(0, "1", 23)], 1)["root_hash"]


def test_commitment(spark):
    ids = spark.range(300).select((F.col("id") * 7).alias("id"))
    nodes = commitment.tree(ids, "id", 8)
    top = commitment.root(nodes).first()
    assert top["height"] == 3
    assert commitment.root(commitment.tree(ids.union(ids).repartition(7), "id", 8)).first()["hash"] == top["hash"]
    assert commitment.root(commitment.tree(ids.filter("id != 7"), "id", 8)).first()["hash"] != top["hash"]
    assert commitment.root(commitment.tree(ids.limit(0), "id", 8)).first()["height"] == 0
    assert commitment.proof(nodes, 9, 8).groupBy("level").count().orderBy("level").collect()[0]["count"] == 8


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01", 1, "e1", "a", "active", 1), (1, "2024-01-02", 3, "e2", "b", "active", 2), (1, "2024-01-03", 1, "e3", "c", "active", 3), (2, "2024-01-01", 2, "e4", "d", "disregarded", 1)]
    schema = "record int, instant string, precedence int, event_id string, payload string, state string, version int"
    events = spark.createDataFrame(rows, schema).withColumn("instant", F.to_timestamp("instant"))
    for i in range(2):
        events.filter(F.col("record") == i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ledger.event_stream(spark, str(tmp_path / "in"), events)
    ledger.projection(stream).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = {r["record"]: r for r in overlay.reduce_projection(events).collect()}
    got = {r["record"]: r for r in spark.table("seen").collect()}
    assert {k: (r["payload"], r["layer"], r["source_event"], r["n_events"]) for k, r in got.items()} == {k: (r["payload"], r["layer"], r["source_event"], r["n_events"]) for k, r in want.items()} == {1: ("b", 3, "e3", 3), 2: ("d", 2, None, 1)}
    for _ in range(2):
        ledger.maintain_snapshot(stream, str(tmp_path / "ledger"), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    state, version = files.read_snapshot(spark, str(tmp_path / "state"))
    assert version == 1 and {r["record"]: r["payload"] for r in state.collect()} == {1: "b", 2: "d"}
    windows = ledger.windowed_totals(stream.withColumn("v", F.lit(1)), "instant", "v", ["record"])
    windows.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("windows").count() == 4


def test_cursors(spark):
    bound = {"kind": "absence", "leaf": "7", "query": "a.b", "size": "3", "epoch": "1"}
    text = report.cursor(b"s", bound, "12.5")
    assert report.cursor_place(b"s", dict(reversed(bound.items())), text) == "12.5"
    for secret, listing, changed in ((b"t", bound, text), (b"s", bound | {"leaf": "8"}, text), (b"s", bound, text + "0"), (b"s", bound, "é"), (b"s", bound, "")):
        with pytest.raises(ValueError):
            report.cursor_place(secret, listing, changed)
    rows = spark.range(0, 20, 2)
    page = report.member_page(rows, "id", F.lit(4), 3).collect()
    assert [r["id"] for r in page] == [6, 8, 10] and all(r["has_more"] for r in page)
    assert [r["id"] for r in report.member_page(rows, "id", None, 2).collect()] == [0, 2]
    with pytest.raises(ValueError):
        report.member_page(rows, "id", F.lit(5), 3)


def test_compacted_events_project_alike(spark, tmp_path):
    """Events in any order of arrival, compacted batch after batch, add up to what all of them do."""
    rng = random.Random(5)
    schema = "record int, instant int, precedence int, event_id string, payload string, state string, version int"
    rows = [(rng.randrange(12), rng.randrange(20), rng.choice([1, 1, 2, 2, 3]), f"e{i}", f"p{i}", "active", i) for i in range(240)]
    events, kept = spark.createDataFrame(rows, schema), None
    for begin in range(0, 240, 60):
        fresh = events.filter(F.col("version").between(begin, begin + 59)).withColumn("n", F.lit(1).cast("long"))
        whole = fresh if kept is None else fresh.unionByName(kept)
        kept = spark.createDataFrame(overlay.compacted(whole).collect(), f"{schema}, n long")
    want = {r["record"]: r for r in overlay.reduce_projection(events).collect()}
    counts = {r["record"]: r["n"] for r in kept.groupBy("record").agg(F.sum("n").alias("n")).collect()}
    got = {r["record"]: r for r in overlay.reduce_projection(kept).collect()}
    for record, row in want.items():
        assert row.asDict() | {"n_events": 0} == got[record].asDict() | {"n_events": 0} and counts[record] == row["n_events"]
    assert len(got) == len(want) and kept.count() < 200
    # As a stream: four batches, the last one interrupted before its snapshot was done.
    for begin in range(0, 240, 60):
        events.filter(F.col("version").between(begin, begin + 59)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    where = [str(tmp_path / n) for n in ("ledger", "state", "check")]
    stream = ledger.event_stream(spark, str(tmp_path / "in"), events)
    ledger.maintain_snapshot(stream, *where).awaitTermination()
    (tmp_path / "state" / "version=000000000003" / "_SUCCESS").unlink()
    for name in ("3", ".3.crc"):
        (tmp_path / "check" / "commits" / name).unlink()
    assert files.read_snapshot(spark, where[1])[1] == 2
    ledger.maintain_snapshot(stream, *where).awaitTermination()
    state, version = files.read_snapshot(spark, where[1])
    columns = ["record", "payload", "layer", "source_event", "adjustment_event", "decision_event", "n_events"]
    assert version == 3 and sorted(map(tuple, state.select(columns).collect())) == sorted(tuple(r[c] for c in columns) for r in want.values())


def test_sealed_previews(spark):
    rows = [(i, f"row:{i}", ["A", "2024-02-29", "1,20", "1:00"] if i % 3 else ["", "x", "", ""]) for i in range(2, 12)]
    df = spark.createDataFrame(rows, "n int, locator string, cells array<string>")
    seal = lambda d, at="2024-01-01 10:00:00", contract="c", **source: preview.sealed(preview.preview(d, {0: "codigo", 1: "data", 2: "valor", 3: "duracao"}, FIELDS, 4), "n", {"sha256": "s"} | source, contract, "t", F.lit(at)).first()
    one = seal(df)
    assert (one["found"], one["valid"], one["with_error"], one["rejected"]) == (10, 7, 3, 3)
    assert (one["retain_until"] - one["prepared_at"]).days == 30
    assert one == seal(df.repartition(3)) and one["content_hash"] == seal(df, "2024-01-02 10:00:00")["content_hash"]
    assert one["preview_hash"] != seal(df, "2024-01-02 10:00:00")["preview_hash"]
    others = [seal(df, contract="d"), seal(df, sheet="1"), seal(df.withColumn("n", -F.col("n"))), seal(df.withColumn("cells", F.when(F.col("n") == 4, F.array(F.lit("B"))).otherwise(F.col("cells"))))]
    assert len({r["content_hash"] for r in [one, *others]}) == 5
    assert len({r["row_result_hash"] for r in [one, *others]}) == 3
    assert seal(df.limit(0))["found"] == 0
    kept = spark.createDataFrame([("2024-01-31",), ("2024-01-30",), (None,)], "retain_until string").withColumn("retain_until", F.to_timestamp("retain_until"))
    assert [r["expired"] for r in preview.retained(kept, F.lit("2024-01-31").cast("timestamp")).collect()] == [False, True, True]


def test_published_sections(spark):
    rows = spark.createDataFrame([(i, f"n{i % 7}", None if i == 3 else "mail a@example.org") for i in range(1, 1002)], "_o_0 int, _v_title string, _code string")
    section = report.Section("s", rows, ["_v_title", "_o_0"], "EVD", {"title": F.col("_code"), "status": F.col("_o_0")})
    none = report.Section("none", rows.limit(0), ["_o_0"], F.col("_code"), {"title": F.col("_code")})
    got = report.published("P", "v1", [none, section], lambda c: F.regexp_replace(c, "[a-z]+@[a-z.]+", "*"), plain=("status",))
    assert got.columns == ["section_no", "place", *report.PUBLISHED["v1"]]
    want = sorted(rows.collect(), key=lambda r: (r["_v_title"], r["_o_0"]))
    out = got.orderBy("section_no", "place").collect()
    assert [(r["record_code"], r["title"], r["status"]) for r in out] == [(f"EVD-{i:03}", None if w["_o_0"] == 3 else "mail *", str(w["_o_0"])) for i, w in enumerate(want, 1)]
    with pytest.raises(ValueError):
        report.published("P", "v4", [report.Section("s", rows, ["_o_0"], "X", {"amount_cents": F.lit(1)})], lambda c: c)


def test_hot_part_takes_few_rounds(spark, monkeypatch):
    """Many revisions on two records: the rounds follow the decisions that change each other, not all that meet in a bucket."""
    last, n = 80, 480
    payload, none = F.create_map(F.lit("a"), F.lit("x")), F.lit(None).cast("map<string,string>").alias("provenance")
    lines = spark.range(n).select(F.col("id").alias("line"), payload.alias("payload"), none)
    matches = lines.select("line", F.when(F.col("line") % 3 == 0, "unique").otherwise("none").alias("match"), F.when(F.col("line") % 3 == 0, F.col("line") % 2).alias("record"))
    records = spark.range(2).select(F.col("id").alias("record"), payload.alias("payload"), none, F.lit(1).alias("layer"), F.lit("active").alias("state"))
    decisions = spark.range(2 * n).select(F.col("id").alias("decision_id"), F.expr("id * 7 % 480").alias("line"), F.expr("if(id % 5 = 4, 'reject', 'link')").alias("outcome"), F.expr("if(id % 5 = 4, null, id % 2)").alias("record"), F.expr(f"cast(1 + id % {last} AS int)").alias("revision"))
    made, plain = [], reconcile.written
    monkeypatch.setattr(reconcile, "written", lambda df, name: made.append(name) or plain(df, name))
    hot = reconcile.fold_decisions(lines, decisions, records, matches, last, 0)
    assert len(made) < 60
    key = lambda df: sorted(map(tuple, df.select("line", *reconcile.DECIDED).collect()))
    assert key(hot) == key(reconcile.fold_decisions(lines, decisions, records, matches, last))
