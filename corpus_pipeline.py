"""Corpus pipeline: quality, exact dedup, near dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from navloom.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from navloom.llm.queries import vocabulary
from navloom.llm.texts import table
from navloom.session import cut_lineage, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """Adds `_row`, a number of each row's own: its id, or a fresh one above all ids.

    A fresh one goes to rows without an id and to all but one row of a repeated id (the longest text keeps it). Where
    ids leave no room above them, all rows are numbered anew in the order of their ids.
    """
    counts = docs.groupBy("doc_id").count()
    odd = cut_lineage(counts.where("doc_id is null or count > 1").select(F.col("doc_id").alias("_id")))
    if odd.isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.desc(F.coalesce(F.char_length("text"), F.lit(0))), "text"]
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    if top >= 1 << 62:
        return cut_lineage(docs.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    rest = cut_lineage(docs.join(odd, same, "left_semi").orderBy(*order).withColumn(
        "_place", F.monotonically_increasing_id()))
    owners = rest.where("doc_id is not null").groupBy("doc_id").agg(F.min("_place").alias("_place"))
    owners = owners.withColumn("_owner", F.col("doc_id")).drop("doc_id")
    rest = rest.join(owners, "_place", "left").withColumn(
        "_row", F.coalesce("_owner", F.greatest(F.lit(top), F.lit(0)) + 1 + F.col("_place"))).drop("_owner", "_place")
    plain = docs.join(odd, same, "left_anti").withColumn("_row", F.col("doc_id"))
    return cut_lineage(plain.unionByName(rest))


def kept_documents(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of keyed documents whose number a verdict keeps, in the columns of documents."""
    kept = verdicts.where("kept").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labels of documents that are there."""
    ship_package(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    ship_package(spark)
    rows = keyed(docs)
    return kept_documents(rows, exact_dedup.exact_groups(rows, key="_row"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    ship_package(spark)
    rows = keyed(docs)
    return kept_documents(rows, near_dedup.near_groups(rows, key="_row"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or a passage of one go."""
    ship_package(spark)
    rows = keyed(docs)
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), passages=True, key="_row")
    return rows.join(found.select(F.col("doc_id").alias("_row")), "_row", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences."""
    ship_package(spark)
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("decontamination", benchmark_stage), ("packing", packing_stage)]

#: the packing of real token ids and a trained classifier have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again by the next."""
    rows = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if i < len(STAGES) - 1:
            rows = cut_lineage(rows)
    return rows
