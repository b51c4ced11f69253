"""Queries of the numbered operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.llm import ann, binary, collocations, html, langid, lm, mixing, packing, quality, rules, simhash, sortmeans, warc
from citegrain.llm.common import crc_fold, new_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document once for every epoch of its source that takes it, with its place in the permutation."""
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_order").alias("place"))


def op2_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids through Huffman blocks and back."""
    found = binary.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), binary.crc32_of("ids").alias("ids_crc32"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from the folds other than 2 of 4."""
    docs, fold = _table(spark, sf_dir, "documents"), crc_fold("doc_id", 4)
    model = langid.train(docs, training=fold != 2)
    found = docs.select("doc_id", (fold == 2).alias("held_out"), langid.predict(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = _table(spark, sf_dir, "pages").select("page_id", "url", html.extract(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents."""
    found = packing.pieces(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return found.select("doc_id", "piece", "start", "length", binary.crc32_of("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), queries="key % 20 = 0").withColumnRenamed("key", "vec_id")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the folds other than 2 of 7."""
    found = lm.score(_table(spark, sf_dir, "documents"), training=crc_fold("doc_id", 7) != 2)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the folds other than 0 of 5."""
    docs, fold = _table(spark, sf_dir, "documents"), crc_fold("doc_id", 5)
    model = quality.train(docs, _table(spark, sf_dir, "labels"), training=fold != 0)
    found = docs.select("doc_id", (fold == 0).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    return rules.judge(_table(spark, sf_dir, "documents")).select("doc_id", *rules.MEASURES, "base_failed", "kept")


def op11_sortmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector, with the clusters' measures."""
    return sortmeans.cluster(_table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through an archive and back."""
    path = new_table(spark, "archive")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations.mine(_table(spark, sf_dir, "documents")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_binary": op2_binary, "op3_langid": op3_langid, "op4_html": op4_html, "op5_packing": op5_packing, "op6_ann": op6_ann, "op7_lm": op7_lm, "op8_quality": op8_quality, "op9_simhash": op9_simhash, "op10_rules": op10_rules, "op11_sortmeans": op11_sortmeans, "op12_warc": op12_warc, "op13_collocations": op13_collocations}


def oracle_sql() -> dict[str, str]:
    return {"op10_rules": rules.oracle(), "op11_sortmeans": sortmeans.oracle(), "op12_warc": warc.oracle(), "op13_collocations": collocations.oracle()}
