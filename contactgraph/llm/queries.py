"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgraph.llm import embeddings, fingerprints, hard_negatives, licenses, merkle, mixing, packing, quality
from contactgraph.llm import secret_scan, simhash, substrings, toxicity, url_filter
from contactgraph.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]

FINGERPRINTS = dict(radius=3, blocks=6)
SECRET_RATE = 0.05
TOXIC = 0.3
SIMHASH = dict(shingle=4, distance=4)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, ensemble).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_document_fingerprints(spark, sf_dir):
    prints = cut_lineage(fingerprints.fingerprint_edited(_table(spark, sf_dir, "documents")))
    asks = F.pmod("id", F.lit(50)) == 0
    return fingerprints.count_within(prints, asks, **FINGERPRINTS).select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprints.as_hex("fp").alias("fingerprint"),
        fingerprints.as_hex("edited_fp").alias("edited_fingerprint"),
        fingerprints.likeness("fp", "edited_fp").alias("near_edited"),
        fingerprints.likeness("fp", "next_fp").alias("near_next"),
        "n_near",
    )


def op3_embedding_near_dedup(spark, sf_dir):
    found = embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op4_secret_scan(spark, sf_dir):
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), rate=SECRET_RATE)
    return found.select(
        F.col("id").alias("doc_id"),
        *[_count(kind) for kind in secret_scan.PATTERNS],
        F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"),
    )


def op5_substring_dedup(spark, sf_dir):
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_source_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


def op7_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def op8_license_scan(spark, sf_dir):
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("found").cast("bigint").alias("n_found"),
        F.array_join("found.license", ",").alias("licenses"),
        F.round(F.coalesce(F.array_max("found.coverage"), F.lit(0.0)), 6).alias("coverage"),
        F.array_join(
            F.transform("found", lambda f: F.concat_ws(":", f["license"], f["start"], f["end"])), ","
        ).alias("spans"),
    )


def op9_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), **SIMHASH)
    return found.withColumnRenamed("id", "doc_id")


def op10_packing(spark, sf_dir):
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents")))


def op11_url_filter(spark, sf_dir):
    judged = url_filter.judge(_table(spark, sf_dir, "pages"))
    return judged.withColumnRenamed("id", "page_id")


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label_col=moved)


def op13_merkle_manifest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    longer = fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    again = F.when(tampered, merkle.leaf_digest(*longer.values()))
    proven = merkle.prove(docs, merkle.leaf_digest(*fields.values()), again)
    return proven.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_document_fingerprints": op2_document_fingerprints,
        "op3_embedding_near_dedup": op3_embedding_near_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_source_mixing": op6_source_mixing,
        "op7_toxicity": op7_toxicity,
        "op8_license_scan": op8_license_scan,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_packing": op10_packing,
        "op11_url_filter": op11_url_filter,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_merkle_manifest": op13_merkle_manifest,
    }
