"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, mixing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps of docs, all of it, with the
columns of docs (the last one adds the schedule).  Each result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.decontam import contaminated
from tidemark.llm.mixing import mix
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.pii import pseudonymise
from tidemark.llm.queries import KEY, table
from tidemark.llm.runtime import Scratch, row_key, without_rows


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't among ``rejected``; a doc_id of null stays."""
    return docs.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from all labels, doesn't reject (score below 0.3).

    A row goes by its own text, whatever its doc_id, null or that of others.  Null and empty texts stay; rows that are
    equal share their fate; an empty table gives an empty one; other columns, whatever their names, are kept.
    """
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return without_rows(docs, toxicity.score(docs.select(row_key().alias("doc_id"), "text"), lexicon).where("score >= 0.3"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that with the smallest doc_id.

    Of rows that agree in doc_id and text one stays, and rows with a doc_id of null all do, as texts without words do.  Rows
    that share a doc_id but not the text stay or go together.  An empty table gives an empty one.
    """
    kept = _without(docs, near_duplicates(docs, percent=80).where("NOT kept"))
    repeated = Scratch(spark, "repeated").write(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "ids")
    if repeated.isEmpty():
        return kept
    return _without(kept, repeated).union(kept.join(repeated, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns)).dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items (containment 0.8).

    A row goes by its own text, whatever its doc_id.  Null and empty texts stay; an empty table, or an empty benchmark,
    takes nothing away; other columns are kept.
    """
    return without_rows(docs, contaminated(docs.select(row_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by pseudonyms; n_chars follows the text (null: null).

    Rows are handled one by one; an empty table gives an empty one; other columns are kept whatever their names.
    """
    changed = pseudonymise(docs, KEY, keep=True)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mixture of sources (columns share, block, place, release, deadline, slot, which
    replace those of docs that are called so).  A null source is a source; an empty table gives an empty one."""
    return mix(docs)


STAGES = [("toxicity", clean), ("neardup", distinct), ("decontamination", decontaminated), ("pii", private), ("mixing", mixed)]

#: Toxicity is learned, so the rows of the pipeline aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
