"""A training corpus in five steps, from raw documents to packed bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarium.llm import decontam, langid, ngram_join, packing, secrets
from planarium.llm._store import written


#: Columns that a stage adds for itself; rows are told apart by id and text, as ids may be missing and one id may have several texts.
KEY, PRED, SCORE = "__row_key", "__lang_pred", "__lang_score"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def by_key(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with the key in place of the id."""
    return keyed(docs).select(F.col(KEY).alias("doc_id"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with the prediction where `lang` is null; the others (no text, no letter) go.

    A null doc_id and repeated rows stay; without any labelled row nothing can be told, and all rows with a letter stay.
    """
    model = langid.train_hierarchy(docs)
    told = langid.with_language(docs, model, PRED, SCORE)
    if model.members:
        told = told.where(F.col(PRED) != "und").withColumn("lang", F.coalesce("lang", PRED))
    else:
        told = told.where(F.col("text").rlike(r"\p{L}"))
    return told.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id (without one: if no other has one).

    A document without words is in no group and stays; of rows that agree in id and text, one stays.
    """
    groups = written(ngram_join.similar_groups(docs), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash"))
    first = groups.where("group is not null").groupBy("group").agg(best.alias("b"), F.count("*").alias("n")).where("n > 1").select("group", "b")
    same = F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("text_hash") == F.col("b.text_hash"))
    gone = groups.join(first, "group").where(~same).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    kept = docs.withColumn("__hash_", F.xxhash64("text"))
    kept = kept.join(gone, F.col("__id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("__hash") == F.col("__hash_")), "left_anti")
    again = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    again = written(again, "repeated")
    if again.isEmpty():
        return kept.select(docs.columns)
    on = F.col("__id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("__hash") == F.col("__hash_"))
    return kept.join(again, on, "left_anti").unionByName(kept.join(again, on, "left_semi").dropDuplicates(["doc_id", "__hash_"])).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null texts and rows that only share an id with a contaminated one stay; repeated rows stay or go together; without documents
    or without a benchmark nothing goes.
    """
    found = decontam.contaminated(by_key(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias(KEY)).distinct()
    return keyed(docs).join(written(found, "contaminated"), KEY, "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; null texts stay null, every row stays, repeated ones as often as they come."""
    return secrets.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' pieces.

    A null or blank text has one row without a bin, null or repeated ids are packed one by one, equal lengths go in the order of
    doc_id, cluster and source; no documents give no bins.
    """
    return packing.best_fit(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("without_secrets", without_secrets), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next.

    Columns of documents keep their names and order up to the last stage; names that begin with `__` are the stages' own.  An empty
    table gives no bins.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The trained language models and the packing order can't be put in SQL.
ORACLE_SQL = None
