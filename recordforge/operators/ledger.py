"""The run ledger as tables: projects, runs, tasks, records and their payload."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from recordforge.sources.tables import discard, materialise

COUNTERS = ("completed", "filtered", "duplicate", "failed")


def upsert_ledger(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Insert or replace by key: the row with the largest version stays; of equal versions the change."""
    # Dealt by key first: keys rarely repeat within a task, so an aggregate before it would sort each task's rows and merge few.
    both = base.withColumn("_from", F.lit(0)).unionByName(changes.withColumn("_from", F.lit(1))).repartition(key)
    row = F.struct(*[c for c in base.columns if c != key])
    newest = both.groupBy(key).agg(F.max_by(row, F.struct(version, "_from")).alias("_row"))
    return newest.select(*[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in base.columns])


def close_rows(rows: DataFrame, summary: DataFrame, key: str, counters: Sequence[str] = COUNTERS) -> DataFrame:
    """Sets status, end_time and the counters of the rows that `summary` names; a null counter there is 0.

    All other rows stay as they are; counters that `rows` does not have start at 0.
    """
    s = summary.select(F.col(key).alias("_named"), F.col("status").alias("_status"), F.col("end_time").alias("_end"), *[F.col(c).alias(f"_{c}") for c in counters])
    joined = rows.join(s, F.col(key) == F.col("_named"), "left")
    named = F.col("_named").isNotNull()
    old = {c: F.col(c) if c in rows.columns else F.lit(0) for c in counters}
    out = {"status": F.when(named, F.coalesce("_status", "status")).otherwise(F.col("status")), "end_time": F.when(named, F.coalesce("_end", "end_time")).otherwise(F.col("end_time"))}
    out |= {c: F.when(named, F.coalesce(f"_{c}", F.lit(0))).otherwise(old[c]) for c in counters}
    return joined.withColumns(out).drop("_named", "_status", "_end", *[f"_{c}" for c in counters])


def count_by_status(records: DataFrame, run: Column, statuses: Sequence[str] | None = None) -> DataFrame:
    """Records per status of the chosen run; absent statuses have no row."""
    rows = records.filter(run)
    return (rows.filter(F.col("status").isin(*statuses)) if statuses else rows).groupBy("status").agg(F.count("*").alias("n"))


def page(df: DataFrame, order: Sequence[Column | str], limit: int | None = None, offset: int = 0, default_limit: int = 1000) -> DataFrame:
    """A page in a total order; an offset without a limit means `default_limit` rows."""
    rows = df.orderBy(*order)
    if offset:
        limit = default_limit if limit is None else limit
        rows = rows.offset(offset)
    return rows if limit is None else rows.limit(limit)


def list_projects(projects: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    return page(projects, ["name", "project_id"], limit, offset)


def list_rows(df: DataFrame, where: Column | None, statuses: Sequence[str], newest: str, key: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Runs, tasks or records: optional filters, newest first, ties by key."""
    if where is not None:
        df = df.filter(where)
    if statuses:
        df = df.filter(F.col("status").isin(*statuses))
    return page(df, [F.desc_nulls_last(newest), F.col(key)], limit, offset)


def after_row(newest: str, key: str, time, last) -> Column:
    """The rows that come after the one with this time and key, newest first and ties by key."""
    if time is None:
        return F.col(newest).isNull() & (F.col(key) > F.lit(last))
    # The first part alone is for the scan, which knows the least and largest time of each file.
    return (F.col(newest).isNull() | (F.col(newest) <= F.lit(time))) & (F.col(newest).isNull() | (F.col(newest) < F.lit(time)) | (F.col(key) > F.lit(last)))


class PagedTable:
    """Ledger rows sorted over files by time, for pages of any depth that read few files.

    Beside the files lies an index of a row for each: its place, its largest and least time and its rows.
    A page begins after the last row of the one before, and reads only files from there on: as many as
    hold enough rows, and twice as many again while filters leave too few.
    """

    def __init__(self, spark: SparkSession, path: str, newest: str, key: str) -> None:
        self.spark, self.path, self.newest, self.key = spark, path, newest, key

    def create(self, df: DataFrame, files: int) -> None:
        """Writes the rows into about so many files, newest first, null times last."""
        order = [F.desc_nulls_last(self.newest), F.col(self.key)]
        df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.path}/rows")
        rows = self.spark.read.parquet(f"{self.path}/rows")
        index = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max(self.newest).alias("top"), F.min(self.newest).alias("low"), F.count("*").alias("n"), F.count_if(F.col(self.newest).isNull()).alias("nulls"))
        index.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index")

    def page(self, limit: int, after: tuple | None = None, where: Column | None = None) -> DataFrame:
        """`limit` rows after the row (time, key) `after`, or the first ones. where: a filter of rows."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        index = self.spark.read.parquet(f"{self.path}/index")
        if after is not None:
            rows = rows.filter(after_row(self.newest, self.key, *after))
            index = index.filter((F.col("nulls") > 0) | (F.col("low") <= F.lit(after[0])) if after[0] is not None else F.col("nulls") > 0)
        rows = rows if where is None else rows.filter(where)
        order = [F.desc_nulls_last(self.newest), F.col(self.key)]
        earlier = Window.orderBy(F.desc_nulls_last("top"), F.desc_nulls_last("low"), "file").rowsBetween(Window.unboundedPreceding, -1)
        held, files, wanted = index.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), index.count(), limit
        while True:
            # The files from here on until they hold so many rows; the first may lie before the page in part.
            chosen = held.filter(F.col("before") <= 2 * wanted).agg(F.min("low").alias("low"), F.sum("nulls").alias("nulls"), F.count("*").alias("files")).first()
            if chosen.files == files or chosen.nulls:
                return rows.orderBy(*order).limit(limit)
            # Times of the last file may go on in the next one, so the bound is part of the page only as a whole.
            found = rows.filter(F.col(self.newest) >= F.lit(chosen.low))
            if found.limit(limit).count() == limit:
                return found.orderBy(*order).limit(limit)
            wanted *= 4


def get_by_id(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == value)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is not null and names no parent."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent"), "left_anti")


def _completed(tasks: DataFrame, run: Column) -> DataFrame:
    return tasks.filter(run & (F.col("status") == "completed")).select("run_config_hash")


def pending_inputs(inputs: DataFrame, tasks: DataFrame, run: Column) -> DataFrame:
    """Inputs without a completed task of the run and their configuration hash."""
    return inputs.join(_completed(tasks, run), "run_config_hash", "left_anti")


def done_inputs(inputs: DataFrame, tasks: DataFrame, run: Column) -> DataFrame:
    return inputs.join(_completed(tasks, run), "run_config_hash", "left_semi")


def restore_outputs(inputs: DataFrame, tasks: DataFrame, records: DataFrame, payload: DataFrame, run: Column) -> DataFrame:
    """(idx, output): payloads of the completed tasks, in the order of their record ids.

    A task without records has an empty output. Of several completed tasks of
    one configuration the one with the smallest id counts, so none comes twice.
    """
    done = tasks.filter(run & (F.col("status") == "completed")).groupBy("run_config_hash").agg(F.min("job_id").alias("job_id"))
    stored = records.select("job_id", "record_uid").join(payload, "record_uid").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("record_uid", "payload"))).alias("_rows"))
    found = inputs.select("idx", "run_config_hash").join(done, "run_config_hash").join(stored, "job_id", "left")
    empty = F.array().cast(T.ArrayType(payload.schema["payload"].dataType))
    return found.select("idx", F.coalesce(F.col("_rows.payload"), empty).alias("output"))


def task_durations(tasks: DataFrame) -> DataFrame:
    """Adds seconds from start to end; null if either is missing."""
    at = lambda c: F.col(c).cast("timestamp").cast("double")
    return tasks.withColumn("seconds", at("end_time") - at("start_time"))


def fan_out(uid: Column) -> tuple[Column, Column]:
    """The two folder levels of a record: characters 1-2 and 3-4, XX for short uids."""
    short = F.length(uid) < 4
    return F.when(short, "XX").otherwise(F.substring(uid, 1, 2)), F.when(short, "XX").otherwise(F.substring(uid, 3, 2))


def write_records(df: DataFrame, path: str, uid: str = "record_uid") -> None:
    """Payload rows, partitioned by the first folder level and sorted within files by the second."""
    p1, p2 = fan_out(F.col(uid))
    df.withColumns({"p1": p1, "p2": p2}).repartition("p1").sortWithinPartitions("p2").write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy("p1").parquet(path)


def read_records(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if prefix is None else df.filter((F.col("p1") == prefix[:2]) & F.col("record_uid").startswith(prefix))


def save_run_snapshot(inputs: DataFrame, config: dict, path: str, state: dict | None = None) -> None:
    """The inputs as Parquet, the configuration and the start values of the state as one JSON row each."""
    inputs.write.mode("overwrite").parquet(f"{path}/inputs")
    for name, values in (("state", state or {}), ("config", config)):
        inputs.sparkSession.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def load_run_snapshot(spark: SparkSession, path: str, with_state: bool = False) -> tuple:
    """(inputs, configuration), and with `with_state` the start values too."""
    rows = spark.read.text(f"{path}/config").take(1)
    if not rows:
        raise ValueError(f"no run at {path}")
    found = spark.read.parquet(f"{path}/inputs"), json.loads(rows[0][0])
    return (*found, json.loads(spark.read.text(f"{path}/state").first()[0])) if with_state else found


def job_id(run_id: Column, idx: Column) -> Column:
    """A task's id: one for each input of a run."""
    return F.sha2(F.concat_ws("\x1f", run_id, idx.cast("string")), 256)


def run_ledger(attempts: DataFrame, inputs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The ledger rows of attempts: tables `runs`, `tasks`, `records` and `payload`.

    A task is an input of a run; it has the status of its completed attempt, else that of its last
    one, and counts its attempts. A record is an output item, or a failed attempt with its error;
    the payload holds the items of completed attempts as JSON. A run with tasks that did not complete
    is `completed_with_errors`. inputs: (idx, run_config_hash), for the tasks; without it the
    hash is the task's id. Attempts of one input need no order; inputs that were never tried have no row.
    """
    rows = attempts.withColumn("job_id", job_id(F.col("run_id"), F.col("idx")))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in COUNTERS]
    last = F.max_by(F.struct("status", "err_str"), F.struct(F.col("status") == "completed", "attempt"))
    tasks = rows.groupBy("job_id").agg(F.first("run_id").alias("master_job_id"), F.first("idx").alias("idx"), last.alias("_last"), F.min("started").alias("start_time"), F.max("ended").alias("end_time"), *counts)
    tasks = tasks.select("job_id", "master_job_id", "idx", F.col("_last.status").alias("status"), "start_time", "end_time", *COUNTERS, F.col("_last.err_str").alias("error_message"))
    if inputs is None:
        tasks = tasks.withColumn("run_config_hash", F.col("job_id"))
    else:
        named = inputs.select(F.col("idx").cast("long").alias("_input"), "run_config_hash")
        tasks = tasks.join(named, F.col("idx") == F.col("_input"), "left").drop("_input")
    done = F.count_if(F.col("status") == "completed")
    runs = tasks.groupBy("master_job_id").agg(F.count("*").alias("tasks"), done.alias("done"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), *[F.sum(c).alias(c) for c in COUNTERS])
    runs = runs.withColumn("status", F.when(F.col("done") == F.col("tasks"), "completed").otherwise("completed_with_errors"))
    one = F.array(F.lit(None).cast(attempts.schema["output"].dataType.elementType))
    items = rows.select("job_id", "attempt", "status", "started", "ended", "err_str", F.posexplode(F.when(F.col("status") == "failed", one).otherwise(F.col("output"))).alias("pos", "item"))
    # In the order of attempts and items, as outputs are put together by record ids.
    uid = F.concat_ws("-", "job_id", F.lpad(F.col("attempt").cast("string"), 4, "0"), F.lpad(F.col("pos").cast("string"), 9, "0"))
    items = items.withColumn("record_uid", uid)
    records = items.select("record_uid", "job_id", "status", F.col("started").alias("start_time"), F.col("ended").alias("end_time"), F.col("err_str").alias("error_message"))
    payload = items.filter("status = 'completed'").select("record_uid", F.to_json("item", {"ignoreNullFields": "false"}).alias("payload"))
    return {"runs": runs, "tasks": tasks, "records": records, "payload": payload}


class BucketedTable:
    """A ledger table in hash buckets of its key, so that a change reads and writes only the buckets it touches.

    Rows with a null key make a bucket of their own. The number of buckets is fixed when the table is first
    written; choose it for buckets of about a file each (larger ones are several). An upsert that is killed leaves every
    bucket as it was or as it is to be, and can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 256) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.coalesce(F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)), F.lit(-1)).cast("int"))

    def _write(self, df: DataFrame) -> None:
        # By bucket, so that most are one file; Spark splits the partitions that are large, so no task's rows grow with the table.
        df.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def create(self, df: DataFrame) -> None:
        """A new table."""
        self._write(self._bucketed(df))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def find(self, value) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        bucket = self._bucketed(self.spark.createDataFrame([(value,)], [self.key]).select(F.col(self.key).cast(self.read().schema[self.key].dataType))).first()["bucket"]
        return self.spark.read.parquet(self.path).filter((F.col("bucket") == bucket) & (F.col(self.key) == value)).drop("bucket")

    def upsert(self, changes: DataFrame, version: str) -> list[int]:
        """`upsert_ledger` on the buckets of the changed keys, whose numbers it returns (no more than there are buckets)."""
        changed = materialise(self._bucketed(changes), "changes")
        touched = sorted(r.bucket for r in changed.select("bucket").distinct().collect())
        if touched:
            base = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(touched)).drop("bucket")
            # Written before it replaces what it is made of.
            merged = materialise(self._bucketed(upsert_ledger(base, changed.drop("bucket"), self.key, version)), "upserted")
            self._write(merged)
            discard(merged)
        discard(changed)
        return touched
