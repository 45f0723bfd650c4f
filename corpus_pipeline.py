"""From raw documents to packed training windows, stage by stage.

Each stage takes the rows that the one before kept, whole and with all of their
columns, and all but the last return the same columns. In every stage:

* null and blank texts: the first stage rejects them, and the others would keep
  none of them but near-dedup, for which they are no duplicates;
* very long texts count whole, and fill windows of their own in the last stage;
* rows with a null doc_id stay where their text does; they are never trusted,
  never labelled, and no duplicates;
* repeated rows count as often as they occur until near-dedup, which leaves one
  row of each doc_id;
* ties: a score or probability equal to its threshold is kept, the lowest
  doc_id of a group of duplicates stays, and equal hashes of the mixture are
  selected together;
* an empty table, or one that nothing is left of, gives an empty result;
* extra columns, whatever their names, pass through unchanged.

The stages' operators say in their modules what else they define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import classifier, frames, mixing, packing, quality_rules, simhash


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose n-grams look like the trusted documents' stay: a mean log ratio of -0.2 or more. Without trusted documents all that have words do."""
    return quality_rules.keep_documents(docs, quality_rules.trusted_ids(spark, sf_dir))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good (a probability of 0.25 or more) stay. With labels of one class that class's share decides for all."""
    return classifier.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the lowest doc_id; rows without a doc_id all stay."""
    return simhash.keep_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents selected to the sources' target weights, once for each copy; those of no source go."""
    return mixing.mixed_documents(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of documents that are lexical neighbours: every token of every document in one window."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", quality),
    ("near-dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", windows),
]

#: Several stages are beyond SQL; tests hold the whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next. The last one's result is windows: window, slot, doc_id, first_token, n_tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = frames.new_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
