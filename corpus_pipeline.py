"""The corpus pipeline: language ID, near-duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a
table that is written as Parquet and read again for the next. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.llm.bpe import encode_documents
from catchment.llm.common import drop_folder, new_folder, short_batches, stored
from catchment.llm.decontaminate import without_leaks
from catchment.llm.langid import fit, in_languages
from catchment.llm.queries import tokenizer_path
from catchment.llm.simhash import simhash_groups


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: Collection[str] | None = None) -> DataFrame:
    """Keeps documents that the network finds to be in a language: any learned one, or one of ``languages``.

    Texts whose words the network gives to no language (codes, random letters, other scripts), and
    null and letterless texts, go.
    """
    short_batches(spark)
    return in_languages(docs, fit(docs), languages)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate group.

    Rows that repeat a doc_id are documents of their own, as are rows without one, which come last;
    ties go to the lesser text, and of equal rows any one stays.
    """
    short_batches(spark)
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if odd.isEmpty():
        keepers = simhash_groups(docs).where("doc_id = component_id").select("doc_id")
        return docs.join(keepers, "doc_id", "left_semi").select(docs.columns)
    row = "_row"
    while row in docs.columns:
        row += "_"
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    groups = simhash_groups(keyed.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text"), F.col(row))
    keepers = keyed.select(row, order.alias("order")).join(groups, row).groupBy("component_id").agg(F.min_by(row, "order").alias(row))
    return keyed.join(keepers, row, "left_semi").select(docs.columns)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    short_batches(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids, n_tokens and the decoded text."""
    short_batches(spark)
    return encode_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", leak_stage),
    ("BPE encoding and decoding", token_stage),
]

#: No stage can be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes once the next one's is written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path, schema = new_folder(spark, "stage"), docs.schema
            docs.write.parquet(path)
            if held:
                drop_folder(held)
            docs, held = spark.read.schema(schema).parquet(path), path
    return docs
