"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probewise.llm import decontam, html_text, langid, merkle, mixing, packing, pii, quality, resample, secret_scan, simhash, store, tokens, twins, winnow

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_spec() -> str:
    with open(public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        return f.read()


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.folder(spark, "token-files")
    manifest = tokens.write_token_files(table(spark, sf_dir, "documents"), out, tokenizer_spec(), end_id=1)
    return tokens.read_token_files(spark, out, manifest)


def op2_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.label(docs, langid.learn(docs)).drop("spans")


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.learn(docs))


def op7_benchmark_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_spec(), end_id=2)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.learn(pages))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    own = F.get("sources", 0)
    return mixed.select("doc_id", "size", own["source_size"].alias("source_size"), own["target"].alias("target"), "taken")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    tampered = merkle.leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns])
    made = merkle.manifest(docs, columns, "lang", "doc_id", carry={"tampered": F.when(hit, tampered)})
    made = made.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), "path"))
    return made.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest("path").alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_quality_network": op2_quality_network,
    "op3_personal_data": op3_personal_data,
    "op4_language_spans": op4_language_spans,
    "op5_simhash_groups": op5_simhash_groups,
    "op6_secrets": op6_secrets,
    "op7_benchmark_tiles": op7_benchmark_tiles,
    "op8_packing": op8_packing,
    "op9_main_text": op9_main_text,
    "op10_winnowing": op10_winnowing,
    "op11_source_mixing": op11_source_mixing,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_merkle_manifest": op13_merkle_manifest,
}
SQL: dict[str, str] = {
    "op11_source_mixing": twins.MIXING,
    "op12_importance_resampling": twins.RESAMPLING,
    "op13_merkle_manifest": twins.MERKLE,
}
