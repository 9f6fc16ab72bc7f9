"""One query for each operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import centroids, ctw, decontam, license_scan, merkle, near_dedup, ngram_join, quality, secret_scan, toxicity, url_rules, warc
from tessera.llm.bpe import Coder
from tessera.llm.common import shared_dir, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    coder = Coder(spark, vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coder.round_trip(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    stored = warc.read_payloads(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    records = warc.with_payloads(warc.read_headers(spark, path), stored)
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 0).alias("bad"))
    judged = url_rules.judge(table(spark, sf_dir, "pages", "page_id", "url"), labels)
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.select("doc_id", *quality.FEATURES, "base_failed", "failed_rules", "kept")


def op6_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = lambda key: F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    model, counts = ctw.train(docs.filter(~held_out(F.col("doc_id"))).select("text"))
    return ctw.score(docs, model, counts).withColumn("held_out", held_out(F.col("doc_id")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    found = license_scan.passages(lines)
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_lines"),
        license_scan.listed(F.col("licenses")).alias("licenses"),
        F.size("passages").cast("long").alias("n_passages"),
        license_scan.listed_passages(F.col("passages")).alias("passages"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = toxicity.fold(F.col("doc_id")) == 0
    model = toxicity.train(docs.filter(~held_out), labels.filter(~held_out))
    scored = model.score(docs).withColumn("held_out", held_out)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"] < secret_scan.BASE)
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{secret_scan.RULES[k].kind}") for k in range(secret_scan.BASE)),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("secret_spans")).alias("spans"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    changed = merkle.changed_case(F.col("doc_id"), F.col("text"))
    return merkle.manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"text": changed})


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents", "doc_id", "text"), k=2, percent=80)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_warc_archive, op3_ngram_jaccard, op4_url_filter, op5_quality_rules, op6_ctw_score, op7_license_scan, op8_decontamination, op9_toxicity, op10_secret_scan, op11_merkle_manifest, op12_minhash_dedup, op13_centroids)}
ORACLES = {"op2_warc_archive": warc.ORACLE, "op3_ngram_jaccard": ngram_join.oracle(4, 85), "op5_quality_rules": quality.ORACLE, "op7_license_scan": license_scan.ORACLE, "op10_secret_scan": secret_scan.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_minhash_dedup": near_dedup.ORACLE, "op13_centroids": centroids.ORACLE}
