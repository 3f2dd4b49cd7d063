"""A cleaning pipeline over documents: each stage works on what its predecessor kept.

Null and empty texts: the quality rules reject them (fewer than 50 words). Repeated rows are documents of their own,
of which the later stages keep one. An empty table passes through. Columns other than those of documents are dropped.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import decontamination, line_dedup, line_quality, packing, simhash
from tidefold.llm.common import read_table, sweep, written
from tidefold.llm.queries import word_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text."""
    changed = docs.withColumns({"text": F.col(text), "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)})
    return changed.select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number that all later reads agree on; ids may repeat."""
    return written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")


def stage(f):
    """A stage first deletes the intermediates that nothing can read any more: those of earlier stages whose results
    have been written and dropped. Results that somebody still holds keep theirs."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, collect=True)
        return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or consist of their host's frequent lines; removes those lines."""
    return with_text(line_quality.line_quality(docs.select(*COLUMNS)).where("kept"), "clean_text")


@stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes blocks that an earlier document has; documents of which nothing is left go."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = F.translate("clean_text", " \t\n\x0b\f\r", "") != ""
    return with_text(cut.where((F.col("n_removed_lines") == 0) | left), "clean_text")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id."""
    rows = numbered(docs)
    groups = simhash.near_duplicates(rows, doc_id="row").select(F.col("doc_id").alias("row"), "component_id")
    groups = written(groups.join(rows.select("row", "doc_id"), "row"), "groups")
    stays = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    goes = groups.join(stays, "component_id").where("row <> first.row").select("row")
    return rows.join(written(goes, "near-copies"), "row", "left_anti").select(*COLUMNS)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    rows = numbered(docs)
    hits = decontamination.contaminated(rows, read_table(spark, sf_dir, "benchmark"), doc_id="row")
    hits = written(hits.select(F.col("doc_id").alias("row")).distinct(), "contaminated")
    return rows.join(hits, "row", "left_anti").select(*COLUMNS)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: SQL cannot express tokens, alignment and fingerprints; the tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = written(out, f"pipeline-stage{k}")
        del out  # so that the next stage can delete its intermediates
