"""The queries op1 to op13 over the training-data tables, and their SQL where it can be said in SQL.

Each takes (spark, sf_dir), runs its operator over the whole table and derives digest columns from its output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, filter_audit, grace_dedup, language_id, mixing, near_dup, packing, quality, secret_scan, spelling, token_store, url_filter, warc
from .common import documents, scratch_path


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_documents(documents(spark, sf_dir))
    mixed = mixing.mix(sized, mixing.rank_schedule(mixing.sources_of(sized)))
    first = F.bround(F.try_element_at("copies", F.lit(1))["position"], 6)
    return mixing.training_order(mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position")), "first_position")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.token_digests(spark, path)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup_groups(documents(spark, sf_dir), width=3, percent=85).drop("text_hash")


def id_fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(id_fold(3) == 1, F.lit(False))
    model = language_id.learn(docs, ~held_out)
    found = language_id.identify(docs, model, carry={"doc_id": F.col("doc_id"), "held_out": held_out})
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_fold(5) == 0, F.lit(False))
    stats = quality.statistics_table(documents(spark, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # of the learning rows, those with remainder 4 calibrate
    model = quality.learn(stats, labels, ~held_out, F.when(id_fold(5) == 4, 0).otherwise(1))
    return quality.score(stats, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir), scratch_path(spark, "ledger"), path_col="doc_id", text_col="text")
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), *[count(r.kind) for r in secret_scan.BASE_RULES], F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read_archives(spark, path, with_payload=False).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marks = labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    rows = filter_audit.judged(documents(spark, sf_dir), marks, ["good", "toxic"])
    return filter_audit.audit(filter_audit.joint_failures(rows, "ABCDE", ["good", "toxic"]), "ABCDE", ["good", "toxic"])


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_store": op2_token_store,
    "op3_near_dedup": op3_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_secret_scan": op6_secret_scan,
    "op7_nearest": op7_nearest,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_url_filter": op12_url_filter,
    "op13_spelling": op13_spelling,
}
