"""Operators on the attempts table.

An attempts row is one call of the generator for one input: `run_id, idx,
attempt, seq, status, output array<struct>, err_str`. Statuses are completed,
duplicate, filtered and failed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from recordforge.functions.names import free_names
from recordforge.operators.inputs import rank_within
from recordforge.sources.tables import materialise

STATUSES = ("completed", "duplicate", "filtered", "failed")
ALIASES = {"duplicated": "duplicate"}


def known_status(status: str) -> str:
    """The status that a name stands for; any unknown name is an error."""
    status = ALIASES.get(status, status)
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}; use one of {STATUSES}")
    return status


def filter_status(attempts: DataFrame, status: str) -> DataFrame:
    return attempts.filter(F.col("status") == known_status(status))


def flatten_outputs(attempts: DataFrame, status: str | None = None) -> DataFrame:
    """One row per output item: idx, attempt, pos, item, err_str.

    A failed attempt gives one row with its error; an empty output gives none.
    """
    rows = attempts if status is None else filter_status(attempts, status)
    failed = F.col("status") == "failed"
    item = rows.schema["output"].dataType.elementType
    one = F.array(F.struct(F.lit(None).cast(item).alias("item"), F.col("err_str").alias("err_str")))
    items = F.transform("output", lambda x: F.struct(x.alias("item"), F.lit(None).cast("string").alias("err_str")))
    return rows.select("idx", "attempt", F.posexplode(F.when(failed, one).otherwise(items)).alias("pos", "_row")).select("idx", "attempt", "pos", "_row.item", "_row.err_str")


def output_index(attempts: DataFrame, status: str = "completed") -> DataFrame:
    """The input's idx, once for every output item."""
    return flatten_outputs(attempts, status).select("idx", "attempt", "pos")


def split_checked(df: DataFrame, format_ok: str, semantic_ok: str) -> DataFrame:
    """Adds ok (both checks hold) and failed_reason (null where ok)."""
    ok = F.coalesce(F.col(format_ok) & F.col(semantic_ok), F.lit(False))
    why = F.when(~F.coalesce(F.col(format_ok), F.lit(False)), "format").otherwise("semantic")
    return df.withColumns({"ok": ok, "failed_reason": F.when(~ok, why)})


def split_verified(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose flag is the text "True", and those with "False"; others are in neither."""
    return df.filter(F.col(flag) == "True"), df.filter(F.col(flag) == "False")


def tag_first_output(df: DataFrame, topic: str, field: str = "topic") -> DataFrame:
    """Puts the topic into output item 0 only."""
    return df.withColumn("output", F.transform("output", lambda x, i: x.withField(field, F.when(i == 0, F.col(topic)))))


def join_back(outputs: DataFrame, inputs: DataFrame, key: str = "idx") -> DataFrame:
    return outputs.join(inputs, key)


def merge_outputs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Item i of one result beside item i of the other, for each idx; the longer list is cut.

    Both have idx, pos and own columns; a column in both is an error.
    """
    if clash := set(a.columns) & set(b.columns) - {"idx", "pos"}:
        raise ValueError(f"columns in both results: {sorted(clash)}")
    return a.join(b, ["idx", "pos"])


def union_results(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def drop_repeated_outputs(outputs: DataFrame, columns: Sequence[str] = ("item",)) -> DataFrame:
    """The same (idx, item) counts once; which of equal rows stays does not matter."""
    return outputs.dropDuplicates(["idx", *columns])


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(idx, side): indexes that only the first run has are missing, only the second, added."""
    a, b = first.select("idx").distinct(), second.select("idx").distinct()
    return a.join(b, "idx", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "idx", "left_anti").withColumn("side", F.lit("added")))


def _counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]


def run_summary(attempts: DataFrame, threshold: int = 3) -> DataFrame:
    """Per run: attempts of each status, all attempts, dead letters."""
    per_input = attempts.groupBy("run_id", "idx").agg(*_counts(), F.count("*").alias("total"))
    dead = F.count_if(F.col("total") - F.col("completed") >= threshold).alias("dead_letters")
    return per_input.groupBy("run_id").agg(*[F.sum(s).alias(s) for s in (*STATUSES, "total")], dead)


def task_counts(records: DataFrame, task: str = "job_id") -> DataFrame:
    return records.groupBy(task).agg(*_counts())


def error_counts(attempts: DataFrame) -> DataFrame:
    """Failures per trimmed, lower-cased error text."""
    err = F.lower(F.trim(F.coalesce("err_str", F.lit("unknown error"))))
    return filter_status(attempts, "failed").groupBy(err.alias("error")).agg(F.count("*").alias("n"))


def success_rate(kept: DataFrame, initial: DataFrame) -> DataFrame:
    """One row: kept rows as a percentage of the initial ones; null if there were none."""
    a, b = kept.agg(F.count("*").alias("kept")), initial.agg(F.count("*").alias("initial"))
    return a.crossJoin(b).withColumn("rate", F.round(F.col("kept") * 100.0 / F.nullif(F.col("initial"), F.lit(0)), 4))


def target_reached(attempts: DataFrame, target: int) -> DataFrame:
    """Per run: completed inputs against the target; target 0 means all inputs."""
    done = F.count_distinct(F.when(F.col("status") == "completed", F.col("idx")))
    counts = attempts.groupBy("run_id").agg(done.alias("completed"), F.count_distinct("idx").alias("inputs"))
    goal = F.lit(target) if target else F.col("inputs")
    return counts.select("run_id", "completed", goal.cast("long").alias("target"), (F.col("completed") >= goal).alias("reached"))


def index_audit(outputs: DataFrame, expected: int) -> DataFrame:
    """(idx, problem, n): indexes that occur more than once, that are absent from 0..expected-1, or lie outside."""
    counts = outputs.groupBy("idx").agg(F.count("*").alias("n"))
    inside = F.col("idx").between(0, expected - 1)
    found = counts.filter((F.col("n") > 1) | ~inside).select("idx", F.when(~inside, "unexpected").otherwise("duplicate").alias("problem"), "n")
    absent = outputs.sparkSession.range(expected).withColumnRenamed("id", "idx").join(counts, "idx", "left_anti")
    return found.unionByName(absent.select("idx", F.lit("missing").alias("problem"), F.lit(0).cast("long").alias("n")))


def dead_letters(attempts: DataFrame, threshold: int = 3) -> DataFrame:
    """(run_id, idx, n, last_seq): inputs whose attempts that did not complete reach the threshold."""
    bad = attempts.filter(F.col("status") != "completed")
    return bad.groupBy("run_id", "idx").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq")).filter(F.col("n") >= threshold)


def stop_point(attempts: DataFrame, n: int = 3, width: int = 100_000) -> DataFrame:
    """(run_id, seq): the first attempt with which the last n results of its run are all not completed.

    Rows that did not complete and follow each other have the same difference of
    their ranks among all rows and among such rows. Ranks are made in slices of
    `width` sequence numbers, so a long run is many tasks' work.
    """
    slices = F.floor(F.col("seq") / width)
    ranked = rank_within(attempts.select("run_id", "seq", "status"), ["run_id"], slices, [F.col("seq")], "_rank")
    bad = rank_within(ranked.filter(F.col("status") != "completed"), ["run_id"], slices, [F.col("seq")], "_bad").withColumn("_stretch", F.col("_rank") - F.col("_bad"))
    long_enough = bad.groupBy("run_id", "_stretch").agg(F.count("*").alias("_n"), F.min("_bad").alias("_first")).filter(F.col("_n") >= n)
    ends = long_enough.groupBy("run_id").agg((F.min("_first") + n - 1).alias("_bad"))
    return bad.join(ends, ["run_id", "_bad"]).select("run_id", "seq")


def mark_duplicates(df: DataFrame, keys: Sequence[str], order: str = "idx") -> DataFrame:
    """Adds duplicate: an earlier row (by `order`) has the same keys.

    The smallest `order` of each key is a partial aggregate over a 128-bit hash
    of the keys and joins back, so a key of very many rows never fills a window.
    Rows that tie for first are all firsts.
    """
    kept = df.drop("duplicate")
    key, first = free_names(kept.columns, "_key", "_first")
    keyed = kept.withColumn(key, F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})))
    # Written, so that both sides of the join are plain exchanges, which Spark splits where a key is hot.
    repeated = materialise(keyed.groupBy(key).agg(F.min(order).alias(first), F.max(order).alias("last")).filter(F.col(first) < F.col("last")).drop("last"), "repeated-keys")
    return keyed.join(repeated, key, "left").withColumn("duplicate", F.coalesce(F.col(order) > F.col(first), F.lit(False))).drop(key, first)


def apply_hooks(df: DataFrame, duplicate: Sequence[Column] = (), filtered: Sequence[Column] = ()) -> DataFrame:
    """Sets status by hook conditions: duplicate beats filtered beats completed; failed rows stay failed."""
    any_of = lambda cs: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cs], F.lit(False))
    status = F.when(F.col("status") == "failed", "failed").when(any_of(duplicate), "duplicate").when(any_of(filtered), "filtered").otherwise("completed")
    return df.withColumn("status", status)


def take_target(attempts: DataFrame, target: int) -> DataFrame:
    """Completed attempts of the `target` completed inputs with the smallest idx."""
    done = filter_status(attempts, "completed")
    chosen = done.select("idx").distinct().orderBy("idx").limit(target)
    return done.join(chosen, "idx", "left_semi")
