"""Labelled rows without a shuffle of the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordforge.llm.textarrays import bounded_sample, held_out


def labelled_rows(docs: DataFrame, labels: DataFrame, label: Column, most: int, text_col: str = "text", id_col: str = "doc_id", extra: tuple = ()) -> DataFrame:
    """(text, extra columns, label) of about `most` labelled documents, one row for each id.

    The bound is on label rows, so the sampled ids have a proven size and can be
    broadcast; only texts of these ids are shuffled. Of several rows of one id
    the smallest (by text, extra columns and label) counts, so repeated rows do
    not exceed the bound. Null ids and null labels are left out; a null text
    stays null; without labels the result is empty.
    """
    usable = labels.select(F.col(id_col).alias("_labelled"), label.alias("label")).filter("label is not null and _labelled is not null")
    chosen = bounded_sample(usable, "_labelled", most)
    found = docs.select(id_col, text_col, *extra).join(F.broadcast(chosen), F.col(id_col) == F.col("_labelled"))
    row = F.struct(F.col(text_col).alias("text"), *extra, "label")
    return found.groupBy("_labelled").agg(F.min(row).alias("_row")).select("_row.*")


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, parts: int, part: int, most: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The same for a 0/1 label, without the documents that are held out."""
    return labelled_rows(docs, labels.filter(~held_out(id_col, parts, part)), F.col(label_col).cast("int"), most, text_col, id_col)
