"""Line dedup: a log-template tree finds lines that recur across documents.

Each line is parsed as a log message: digit runs become a variable field, then
the line goes down a tree of fixed depth, by its number of tokens and by its
leading tokens. Below a leaf the rest of the line is cut into `SEGMENTS` equal
stretches; a template keeps all stretches but one, which is a variable field.
So a line belongs to one template for each stretch that might vary, and lines
of fewer than `WILD` tokens to the one template of all their tokens. Lines of
fewer than `LEAST` tokens say too little for a variable field: their template is
the line itself, digits and all.

A template recurs if two documents hold it. Its lines stay in the document with
the smallest id and are dropped from all others. Blank lines are never dropped.

Built-in functions only. Templates are 64-bit hashes beside the token count;
texts are shuffled once, to meet the list of their dropped lines. The smallest
id of a template is a partial aggregate; the recurring templates are written
before they are joined, so that Spark splits a template that is in a third of
all documents over many tasks.

Defined cases: rows with a null id or text are returned as they are; repeated
rows (same id and text) count as one document and keep their lines; an empty
text has one empty line; a text whose lines all go becomes empty; extra columns
are kept, and columns of the new names are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordforge.functions.names import free_names
from recordforge.sources.tables import materialise

LEAD, SEGMENTS, LEAST, WILD = 3, 4, 5, 8
#: A line that is not blank.
SOME = r"[^ \t\n\x0B\f\r]"


def template_keys(tokens, n, line):
    """The line's template hashes: one for each stretch that may vary."""
    width = F.ceil((n - LEAD) / SEGMENTS).cast("int")
    wild = [F.xxhash64(F.lit(s), F.slice(tokens, 1, LEAD + width * s), F.slice(tokens, LEAD + 1 + width * (s + 1), F.greatest(F.lit(0), n - LEAD - width * (s + 1)))) for s in range(SEGMENTS)]
    return F.when(n >= WILD, F.array(*wild)).when(n >= LEAST, F.array(F.xxhash64(F.lit(-1), tokens))).otherwise(F.array(F.xxhash64(F.lit(-2), line)))


def dropped_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, hash of the text, positions of the lines to drop) of the documents that lose lines."""
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null and _text is not null")
    lines = known.select("_id", F.xxhash64("_text").alias("_hash"), F.posexplode(F.split("_text", "\n")).alias("_pos", "_line")).withColumn("_line", F.trim("_line")).filter(F.col("_line").rlike(SOME))
    parsed = lines.withColumn("_tokens", F.split(F.regexp_replace("_line", "[0-9]+", "<*>"), "\\s+")).withColumn("_n", F.size("_tokens"))
    keyed = materialise(parsed.select("_id", "_hash", "_pos", "_n", template_keys(F.col("_tokens"), F.col("_n"), F.col("_line")).alias("_keys")), "line-templates")
    keys = keyed.select("_id", "_hash", "_pos", "_n", F.explode("_keys").alias("_key"))
    recurring = materialise(keys.groupBy("_n", "_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_first < _last").drop("_last"), "line-recurring")
    return keys.join(recurring, ["_n", "_key"]).filter("_id > _first").groupBy("_id", "_hash").agg(F.collect_set("_pos").alias("_dropped"))


def drop_recurring(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """Every document without the lines whose template an earlier document holds.

    Adds the numbers of its lines (0 for a null text) and of those dropped.
    """
    kept = docs.drop(lines_col, dropped_col)
    gone_id, gone_hash, gone = free_names(kept.columns, "_gone_id", "_gone_hash", "_gone")
    found = dropped_lines(kept, text_col, id_col).toDF(gone_id, gone_hash, gone)
    lines = F.split(F.col(text_col), "\n")
    joined = kept.join(found, (F.col(id_col) == F.col(gone_id)) & (F.xxhash64(text_col) == F.col(gone_hash)), "left")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(gone, i)), "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in kept.columns], F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).alias(lines_col), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).alias(dropped_col))
