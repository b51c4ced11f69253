"""Corpus pipeline: language, quality, near-duplicates, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of `docs`, with the columns of documents; the last one returns
packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.llm import binary, copies, langid, mixing, packing, quality
from citegrain.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of a text's n-grams that its language holds, and least probability of good quality.
KNOWN, GOOD = 0.25, 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter or of no learned language go, null and empty texts with them.

    Repeated rows are judged each; null ids, sources and languages stay; an empty table gives no rows; columns beyond those of
    documents go. Texts of any length are judged whole. That holds for every stage.
    """
    model = langid.train(docs, training=F.lit(True))
    found = docs.select(*COLUMNS, langid.predict(F.col("text"), model).alias("p"))
    return found.where((F.col("p.lang") != "und") & (F.col("p.score") >= KNOWN)).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, learned from all positive labels. A table without labels keeps all whose score is GOOD or more, by a
    prior of one half."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), training=F.lit(True))
    return docs.select(*COLUMNS, quality.score(F.col("text"), model).alias("s")).where(F.col("s") >= GOOD).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 on five-word shingles), exactly one row: of the least id, a null id only where all are null; of ties any one row."""
    rows = stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = copies.near_copies(rows, key="row").join(rows.select("row", "doc_id"), "row")
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")).select("least.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them; those without words go, a null source is a source of its own."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences; a null text is its end id alone."""
    import public_tokenizers

    found = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "piece", "start", "length", binary.crc32_of("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", one_of_each), ("mixture", mixture), ("packing", packed)]
#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
