"""The corpus pipeline: five stages from raw documents to a weighted training mix.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. `run` writes each
stage's result to shared storage as Parquet, reads it back for the next one and deletes
what the stage needed on the way. The last stage returns the columns of
documents with each document's domain, rate and number of copies.

Defined cases of all stages: rows with a null id or text pass every stage
that would have to judge them by it (a null text counts as empty, a null id as a
document of its own, whose lines are not cut); repeated rows are judged alike,
and the third stage keeps one of them; empty tables give empty results; long
texts are read whole. The stages return the columns of documents that they are
given, extra ones too, but for columns of the last stage's names, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordforge.functions.names import free_names
from recordforge.llm import chosen_path, latent_decontam, line_templates, toxicity
from recordforge.llm.labelled import labelled_rows
from recordforge.llm.queries import TRAIN_ROWS, mix_by_labels
from recordforge.sources.tables import discard, load, materialise, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; labels teach it."""
    rows = labelled_rows(docs, load(spark, sf_dir, "labels"), F.col("toxic").cast("int"), TRAIN_ROWS)
    score, flag = free_names(docs.columns, "_toxicity", "_toxic")
    scored = toxicity.score(docs, toxicity.fit(rows, "text", "label"), score_col=score, flag_col=flag)
    return scored.filter(F.col(flag) == 0).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; so do documents of which nothing is left."""
    lines, dropped = free_names(docs.columns, "_lines", "_dropped")
    cut = line_templates.drop_recurring(docs, lines_col=lines, dropped_col=dropped).filter((F.col(dropped) == 0) | F.col("text").rlike(r"[^\s]"))
    columns = [F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col(c)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return cut.select(columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the smallest id stays.

    A near copy whose shared lines an earlier stage cut resembles nothing any
    more. So each document is judged by its text as given and as `documents`
    has it; texts of one id are one document here. Of a repeated row one stays.
    """
    later_id, text_hash = free_names(docs.columns, "_later", "_text_hash")
    later = chosen_path.later_ids([docs, load(spark, sf_dir, "documents")], docs.select("doc_id")).toDF(later_id)
    once = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null")
    kept = docs.join(later, F.col("doc_id") == F.col(later_id), "left_anti")
    if once.isEmpty():
        return kept
    return kept.withColumn(text_hash, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text"))).dropDuplicates(["doc_id", text_hash]).drop(text_hash)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items, overlap = free_names(docs.columns, "_found", "_share")
    return latent_decontam.flag(docs, load(spark, sf_dir, "benchmark"), items_col=items, overlap_col=overlap).filter(F.size(items) == 0).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates that bring the expected token totals of the domains to their targets."""
    return mix_by_labels(spark, docs, sf_dir, keep_text=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("jaccard_join", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as paths:
            after = materialise(stage(spark, docs, sf_dir), name)
            paths.pop()
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
