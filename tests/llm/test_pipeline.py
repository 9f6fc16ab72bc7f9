"""The pipeline's stages over the smallest tables, each against a plain version of itself."""

import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, decontam, quality
from test_llm_corpus import brute_alignment, linked
from test_llm_text import brute_spans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Real prose cut to short documents, with copies, leaks, secrets, nulls and rows that repeat."""
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("tables")
    prose = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    good = [" ".join(t.split()[:150]) for t in prose if t and 80 <= len(t.split()) <= 2000][:60]
    items = [" ".join(f"item{i}word{j}" for j in range(15)) for i in range(5)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    for i in range(60, 90):
        w = rng.choice(good).split()
        kind = i % 3
        if kind == 0:
            w[rng.randrange(len(w))] = "edited"
        elif kind == 1:
            w[20:20] = rng.choice(items).split()
        else:
            w = [rng.choice(rng.choice(good).split()) for _ in range(120)] + ["password = hunter22x"]
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "too short", "en", "s", 9), rows[0], (None, good[1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_stages_against_plain_versions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, tables)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = before.collect(), docs.collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    assert [name for name, _ in corpus_pipeline.STAGES] == list(seen) and len(seen) == 5

    was, now = seen["quality_rules"]
    judged = quality.judge(spark.createDataFrame(was, spark.read.parquet(f"{tables}/documents.parquet").schema)).filter("kept").select(*columns).collect()
    assert sorted(now, key=key) == sorted(judged, key=key)
    assert not {900, 901, 902} & {r["doc_id"] for r in now} and len(now) > 60

    was, now = seen["near_duplicates"]
    known = sorted({r["doc_id"]: r["text"] for r in was if r["doc_id"] is not None}.items())
    roots = linked([t for _, t in known], 5, 80)
    kept = sorted(known[i][0] for i in {*roots})
    assert sorted(r["doc_id"] for r in now if r["doc_id"] is not None) == kept and sum(r["doc_id"] is None for r in now) == 1
    assert len(kept) < len(known)

    was, now = seen["decontamination"]
    items = [r["text"].split() for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    plain = lambda t: re.sub(r"[^\w ]", " ", t.lower()).split()
    leaking = {r["doc_id"] for r in was if any(brute_alignment(i, plain(r["text"])) >= decontam.THRESHOLD for i in items)}
    assert leaking and {r["doc_id"] for r in now} == {r["doc_id"] for r in was} - leaking

    was, now = seen["secret_redaction"]
    old = {r["doc_id"]: r["text"] for r in was}
    assert sorted(map(str, old)) == sorted(str(r["doc_id"]) for r in now)
    assert any("[SECRET]" in r["text"] for r in now)
    for r in now:
        assert r["n_chars"] == len(r["text"]) and not brute_spans(r["text"].replace("[SECRET]", " "))
        assert ("[SECRET]" in r["text"]) == bool(brute_spans(old[r["doc_id"]]))

    was, now = seen["byte_bpe"]
    reference = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert len(was) == len(now)
    for r in now:
        assert list(r["ids"]) == reference.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"]) and r["decoded_ok"]


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.filter(~F.col("decoded_ok")).isEmpty()
    assert corpus_pipeline.ORACLE_SQL is None and out.count() > 20
