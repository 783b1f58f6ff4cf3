"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the outputs are written
as Parquet and read again in between. All but the last return the columns of ``documents``.

Verdicts hold for rows, not for ids: each stage numbers its input's rows in a written table and joins on the
number. Rows with equal ids, and rows without one, are documents of their own. Where an earlier document has
precedence, rows are ordered by doc_id, null last, then by content. Repeated rows are judged one by one; columns other
than those of ``documents`` go; empty tables give empty ones. What an operator writes is deleted once its verdicts are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.decontaminate import leaked_items
from gaugeflow.llm.near_dedup import near_duplicates
from gaugeflow.llm.packing import pack, token_pieces
from gaugeflow.llm.quality import quality_rules
from gaugeflow.llm.substrings import remove_repeats
from gaugeflow.llm.tokens import public_vocabulary
from gaugeflow.session import Scratch, temporary_tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(scratch: Scratch, docs: DataFrame, in_order: bool = False) -> DataFrame:
    """``COLUMNS`` and ``_row``, a number of its own for each row; with ``in_order`` it follows doc_id, null last, and content."""
    rows = docs.select(*COLUMNS)
    if in_order:
        rows = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "lang", "source", "n_chars")
    return scratch.table(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null texts fail the rules; null languages and sources are groups."""
    scratch = Scratch(spark, "quality-stage")
    rows = _numbered(scratch, docs)
    with temporary_tables():
        verdicts = quality_rules(rows, id_col="_row").where("not kept")
        rejected = scratch.table(verdicts.select(F.col("doc_id").alias("_row")), "rejected")
    return rows.join(rejected, "_row", "left_anti").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest doc_id; a null doc_id comes last. Texts
    without words are in no group and stay."""
    scratch = Scratch(spark, "near-stage")
    rows = _numbered(scratch, docs)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    with temporary_tables():
        groups = near_duplicates(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
        ranked = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id")
        first = scratch.table(ranked.agg(F.min_by("_row", rank).alias("_row")).select("_row"), "first")
    return rows.join(first, "_row", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word sequences that an earlier row has are cut; no row goes, and texts without any keep their spacing. Null
    texts stay null."""
    scratch = Scratch(spark, "repeat-stage")
    rows = _numbered(scratch, docs, in_order=True)
    with temporary_tables():
        removed = remove_repeats(rows, id_col="_row").where("n_removed > 0")
        cut = scratch.table(removed.select(F.col("doc_id").alias("_row"), F.col("text").alias("cut")), "cut")
    joined = rows.join(cut, "_row", "left")
    text = F.coalesce("cut", "text")
    n_chars = F.when(F.col("cut").isNull(), F.col("n_chars")).otherwise(F.length("cut").cast("long"))
    return joined.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none."""
    scratch = Scratch(spark, "leak-stage")
    rows = _numbered(scratch, docs)
    with temporary_tables():
        found = leaked_items(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
        leaked = scratch.table(found.select(F.col("doc_id").alias("_row")).distinct(), "leaked")
    return rows.join(leaked, "_row", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their sequence and place in it."""
    pieces = token_pieces(docs, public_vocabulary()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("packing", packing),
]

#: The robust estimates of the first stage and the packing of the last have no SQL form; tests compare the stages and run() with brute force by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
