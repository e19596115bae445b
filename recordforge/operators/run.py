"""Running a generator over records: attempts, hooks, retries, dead letters, resume.

`fn` takes a list of input dicts (a batch) and returns, for each, a list of
output dicts or an exception. It runs inside `mapInPandas`; every round's
attempts are written to a log once and read back, so that no plan calls it twice
and a run that was killed goes on after its last whole round.
"""

from __future__ import annotations

import datetime
import json
import queue
import threading
import time
import traceback
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from recordforge.functions.jsonx import parse_replies
from recordforge.operators.attempts import STATUSES, mark_duplicates, stop_point
from recordforge.operators.ledger import done_inputs, load_run_snapshot, pending_inputs, restore_outputs, save_run_snapshot
from recordforge.operators.log import AttemptLog
from recordforge.sources.tables import materialise, scratch_path

#: (a round's attempts, all earlier ones or None, the state) -> the attempts with their status.
Hook = Callable[[DataFrame, DataFrame | None, dict], DataFrame]


class TimedOut(Exception):
    """A call that took longer than its deadline."""


def in_parallel(fn: Callable[[list], list], batches: list[list], timeout: float, concurrency: int) -> list[list]:
    """fn of every batch, up to `concurrency` at a time; exceptions stand in for results.

    Each batch has a deadline of its own, from when it begins. A call that misses
    it is left behind in its own daemon thread and takes up no place.
    """
    out: list[list | None] = [None] * len(batches)
    ended: queue.SimpleQueue = queue.SimpleQueue()
    running: dict[int, float] = {}
    waiting = list(range(len(batches)))[::-1]

    def call(i: int) -> None:
        try:
            got = fn(batches[i])
            if len(got) != len(batches[i]):
                raise ValueError(f"{len(got)} results for {len(batches[i])} inputs")
            ended.put((i, list(got)))
        except Exception as e:
            ended.put((i, [e] * len(batches[i])))

    while waiting or running:
        while waiting and len(running) < concurrency:
            i = waiting.pop()
            running[i] = time.monotonic() + timeout
            threading.Thread(target=call, args=(i,), daemon=True).start()
        try:
            i, got = ended.get(timeout=max(0.001, min(running.values()) - time.monotonic()))
            if running.pop(i, None) is not None:
                out[i] = got
        except queue.Empty:
            now = time.monotonic()
            for i in [i for i, end in running.items() if end <= now]:
                del running[i]
                out[i] = [TimedOut("timed out")] * len(batches[i])
    return out


def _call(fn: Callable[[list], list], inputs: list, places: list[int], out: list, size: int, timeout: float, concurrency: int) -> list[int]:
    """Puts the results of the inputs at `places` into `out`; the places of batches that failed as a whole are returned instead."""
    parts = [places[lo : lo + size] for lo in range(0, len(places), size)]
    alone = []
    for part, got in zip(parts, in_parallel(fn, [[inputs[i] for i in p] for p in parts], timeout, concurrency)):
        if len(part) > 1 and all(isinstance(g, Exception) and g is got[0] for g in got):
            alone += part
        else:
            for i, g in zip(part, got):
                out[i] = g
    return alone


def attempt(fn: Callable[[list], list], inputs: list, retries: int, timeout: float, batch_size: int, concurrency: int) -> list:
    """One result or exception for each input.

    A batch that fails or times out as a whole says nothing about its rows: each
    is called again alone, with a deadline of its own. Rows that fail are called
    up to `retries` more times; a row that times out alone is not. Nothing here refers
    to itself, so the inputs are freed with the call and not when a collection comes round.
    """
    out: list = [None] * len(inputs)
    places = list(range(len(inputs)))
    for _ in range(retries + 1):
        alone = _call(fn, inputs, places, out, batch_size, timeout, concurrency)
        _call(fn, inputs, alone, out, 1, timeout, concurrency)
        places = [i for i, g in enumerate(out) if isinstance(g, Exception) and not isinstance(g, TimedOut)]
        if not places:
            break
    return out


#: Numbers that an input's attempts may take up in `seq`.
MOST_ATTEMPTS = 1024


def _attempts_schema(out: T.StructType, given: T.StructField) -> T.StructType:
    fields = "run_id string, idx long, attempt int, seq long, status string"
    return T.StructType([*T.StructType.fromDDL(fields).fields, T.StructField("output", T.ArrayType(out)), *T.StructType.fromDDL("err_str string, err_trace array<string>, started timestamp, ended timestamp").fields, given])


def _round(pending: DataFrame, fn, schema: T.StructType, run_id: str, retries: int, timeout: float, batch_size: int, concurrency: int) -> DataFrame:
    """One attempt of every row of `pending` (idx, attempt, _input)."""
    names = [f.name for f in schema["output"].dataType.elementType.fields]

    def run(frames):
        for frame in frames:
            raw = frame["_input"].tolist()
            inputs = [x if isinstance(x, dict) else x.asDict() for x in raw]
            rows = []
            began = datetime.datetime.now(datetime.timezone.utc)
            results = attempt(fn, inputs, retries, timeout, batch_size, concurrency)
            ended = datetime.datetime.now(datetime.timezone.utc)
            for idx, k, given, got in zip(frame["idx"].tolist(), frame["attempt"].tolist(), raw, results):
                if isinstance(got, Exception):
                    trace = [line for part in traceback.format_exception(got) for line in part.splitlines()]
                    rows.append((run_id, idx, k, idx * MOST_ATTEMPTS + k - 1, "failed", None, str(got), trace, began, ended, given))
                else:
                    rows.append((run_id, idx, k, idx * MOST_ATTEMPTS + k - 1, "completed", [{n: x.get(n) for n in names} for x in got], None, None, began, ended, given))
            yield pd.DataFrame(rows, columns=schema.names)

    return pending.mapInPandas(run, schema)


def run_records(
    df: DataFrame, fn: Callable[[list[dict]], list], out: T.StructType | str, retries: int = 1, threshold: int = 3, timeout: float = 60, batch_size: int = 64, run_id: str = "run", concurrency: int = 10,
    hooks: Sequence[Hook] = (), state: dict | None = None, updates: dict[str, Column] | None = None, retry_statuses: Sequence[str] = STATUSES[1:], target: int = 0, stop_after: int = 0, wave: int = 0, log: str | None = None,
) -> DataFrame:
    """Attempts (run_id, idx, attempt, seq, status, output, err_str, err_trace, started, ended) of the rows of `df`.

    Rounds. A round makes one attempt for every pending input: up to retries + 1
    calls, of which `concurrency` batches run at a time in a partition. Then each
    hook may call completed attempts duplicate or filtered; what one called
    failed or duplicate, no later one changes, and duplicate beats filtered.
    Inputs whose status is in `retry_statuses`
    are tried again in the next round, `threshold` attempts at the most; what
    has then not completed is a dead letter.

    State. A dict of start values that hooks read; after each round the
    aggregates `updates` of its attempts are added. `run_state` of the result
    gives the last one.

    Stopping. With a `target`, or with `stop_after` n, inputs are worked off in
    waves of `wave` (or the target) in the order of idx. No wave begins once the
    target of completed inputs is reached, or once n attempts in a row of all
    so far have not completed.

    Log. Each round is appended to the folder `log` (by default one of its own) and
    committed with the state. A folder that holds rounds is gone on with: inputs that are
    through are not called again, others go on counting their attempts (a higher threshold gives dead
    letters more of them), hooks see all earlier attempts, and the state is the last one committed.

    idx names an input: a null is an error, and it should not repeat (see `index_audit`; `number_inputs` makes one).
    """
    if not 1 <= threshold <= MOST_ATTEMPTS:
        raise ValueError(f"an input has 1 to {MOST_ATTEMPTS} attempts")
    spark = df.sparkSession
    out = T.StructType.fromDDL(out) if isinstance(out, str) else out
    idx = F.coalesce(F.col("idx").cast("long"), F.raise_error(F.lit("an input without idx")).cast("long"))
    inputs = df.select(idx.alias("idx"), F.struct(*[c for c in df.columns if c != "idx"]).alias("_input"))
    kept = AttemptLog(spark, log or scratch_path(spark, "run"), _attempts_schema(out, inputs.schema["_input"]))
    held = kept.commit()
    state, completed = {**(state or {}), **held["state"]}, held["completed"]
    before = kept.rows()
    for part in _waves(inputs, wave or target) if target or stop_after else [inputs]:
        if kept.last and (target and completed >= target or stop_after and not stop_point(kept.rows(), stop_after).isEmpty()):
            break
        pending = part.select("idx", F.lit(1).alias("attempt"), "_input")
        if before is not None:
            told = before.groupBy(F.col("idx").alias("_idx")).agg(F.max("attempt").alias("_tried"), F.max_by("status", "attempt").alias("_last"))
            open_ = F.col("_last").isNull() | F.col("_last").isin(*retry_statuses) & (F.col("_tried") < threshold)
            pending = part.join(told, F.col("idx") == F.col("_idx"), "left").filter(open_).select("idx", (F.coalesce("_tried", F.lit(0)) + 1).alias("attempt"), "_input")
            if pending.isEmpty():
                continue
        while True:
            called = _round(pending, fn, kept.schema, run_id, retries, timeout, batch_size, concurrency)
            if hooks:
                called, earlier = materialise(called, "calls"), kept.rows()
                for hook in hooks:
                    got = hook(called.withColumn("_before", F.col("status")), earlier, state)
                    status = F.when(F.col("_before").isin("failed", "duplicate") | (F.col("status") == "duplicate"), F.when(F.col("_before") == "failed", "failed").otherwise("duplicate"))
                    called = got.withColumn("status", status.when(F.col("_before") == "filtered", "filtered").otherwise(F.col("status"))).select(kept.schema.names)
            judged = kept.write(called)
            row = judged.agg(F.count_if(F.col("status") == "completed").alias("_completed"), *[c.alias(n) for n, c in (updates or {}).items()]).first()
            state, completed = state | {n: state.get(n, 0) + (row[n] or 0) for n in updates or {}}, completed + row["_completed"]
            kept.close(state, completed)
            again = judged.filter(F.col("status").isin(*retry_statuses) & (F.col("attempt") < threshold))
            if again.isEmpty():
                break
            pending = again.select("idx", (F.col("attempt") + 1).alias("attempt"), "_input")
    rows = kept.rows()
    result = (spark.createDataFrame([], kept.schema) if rows is None else rows).drop("_input")
    result.run_state, result.run_log = state, kept.path
    return result


def _waves(inputs: DataFrame, size: int):
    """The inputs in ranges of idx that hold about `size` rows each."""
    if size < 1:
        raise ValueError("a run that may stop needs a target or the size of a wave")
    first, last, n = inputs.agg(F.min("idx"), F.max("idx"), F.count("*")).first()
    if not n:
        yield inputs
        return
    span = max(1, (last - first + 1) * size // n)
    for lo in range(first, last + 1, span):
        yield inputs.filter(F.col("idx").between(lo, lo + span - 1))


def seen_before(value: Column) -> Hook:
    """A hook: duplicate if an earlier completed attempt, or one of the same round with a smaller idx, has the same value."""

    def hook(rows: DataFrame, earlier: DataFrame | None, state: dict) -> DataFrame:
        fresh = rows.withColumn("_value", F.when(F.col("status") == "completed", value))
        told = mark_duplicates(fresh.filter("_value is not null"), ["_value"])
        if earlier is not None:
            known = earlier.filter("status = 'completed'").select(value.alias("_known")).filter("_known is not null").distinct()
            told = told.join(known, F.col("_value") == F.col("_known"), "left").withColumn("duplicate", F.col("duplicate") | F.col("_known").isNotNull())
        told = told.withColumn("status", F.when(F.col("duplicate"), "duplicate").otherwise(F.col("status")))
        return told.select(rows.columns).unionByName(fresh.filter("_value is null").select(rows.columns))

    return hook


def drop_if(condition: Column) -> Hook:
    """A hook: filtered where the condition holds."""
    return lambda rows, earlier, state: rows.withColumn("status", F.when(F.coalesce(condition, F.lit(False)), "filtered").otherwise(F.col("status")))


def require_output(attempts: DataFrame) -> DataFrame:
    """An error if no attempt completed."""
    if not attempts.filter("status = 'completed'").take(1):
        raise ValueError("no input completed")
    return attempts


#: Rows that a partition takes up at a time to ask a model, as a multiple of those that it asks at once.
AT_ONCE = 2


def ask_model(df: DataFrame, prompt: str, fields: Sequence[dict], model: Callable[[list[str]], list[str]], wrapper: str | None = None, retries: int = 1, timeout: float = 60, batch_size: int = 64, concurrency: int = 10) -> DataFrame:
    """Adds reply, data, parse_status and parse_error; rows with a null prompt get no reply.

    A call that raises, times out or gives too few replies is a failed row with
    that error, after `retries` more calls.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("_error", T.StringType())])
    at, some = df.columns.index(prompt), AT_ONCE * batch_size * concurrency

    def ask(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, some):
                part = batch.slice(lo, some)
                prompts = part.column(at).to_pylist()
                replies: list = [None] * len(prompts)
                errors: list = [None] * len(prompts)
                asked = [i for i, p in enumerate(prompts) if isinstance(p, str)]
                for i, r in zip(asked, attempt(model, [prompts[i] for i in asked], retries, timeout, batch_size, concurrency)):
                    if isinstance(r, Exception):
                        errors[i] = f"model: {r}"
                    else:
                        replies[i] = r
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=schema.names)

    parsed = parse_replies(materialise(df.mapInArrow(ask, schema), "replies"), "reply", fields, wrapper)
    return parsed.withColumn("parse_error", F.coalesce("_error", "parse_error")).drop("_error")


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each step's output is the next one's input."""
    for step in steps:
        df = step(df)
    return df


def initial_state(df: DataFrame, values: dict) -> DataFrame:
    """The start values of a run's state beside every row, as one struct `state`."""
    return df.withColumn("state", F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))


def fold_state(df: DataFrame, updates: dict[str, Column], start: dict | None = None) -> DataFrame:
    """One row of state: aggregates of a round's rows, added to the start values."""
    state = df.agg(*[c.alias(k) for k, c in updates.items()])
    return state.withColumns({k: F.coalesce(F.col(k), F.lit(0)) + F.lit(v) for k, v in (start or {}).items() if k in updates})


def resume_run(inputs: DataFrame, tasks: DataFrame, records: DataFrame, payload: DataFrame, run: Column, again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(idx, output, restored): stored outputs of completed inputs, new ones of all others.

    `again` maps the pending inputs to (idx, output); dead letters are tried again.
    """
    old = restore_outputs(done_inputs(inputs, tasks, run), tasks, records, payload, run).withColumn("restored", F.lit(True))
    new = again(pending_inputs(inputs, tasks, run)).select("idx", "output").withColumn("restored", F.lit(False))
    return old.unionByName(new)


#: What a resumed run may change of its stored configuration.
OVERRIDES = ("target", "concurrency", "timeout", "retries", "threshold", "batch_size", "stop_after", "wave")


def with_overrides(config: dict, **overrides) -> dict:
    """A stored configuration with the values that a resumed run changes; nulls change nothing."""
    if unknown := set(overrides) - set(OVERRIDES):
        raise ValueError(f"cannot override {sorted(unknown)}; use {OVERRIDES}")
    return config | {k: v for k, v in overrides.items() if v is not None}


def start_run(df: DataFrame, fn: Callable[[list[dict]], list], out: T.StructType | str, path: str, hooks: Sequence[Hook] = (), state: dict | None = None, updates: dict[str, Column] | None = None, **config) -> DataFrame:
    """`run_records` with its inputs, configuration, start values and log under `path`, for `continue_run`."""
    out = T.StructType.fromDDL(out) if isinstance(out, str) else out
    save_run_snapshot(df, {**config, "out": out.json()}, path, state)
    return run_records(df, fn, out, hooks=hooks, state=state, updates=updates, log=f"{path}/log", **config)


def run_state(spark: SparkSession, log: str) -> dict:
    """The state of a run after its last committed round."""
    return AttemptLog(spark, log).commit()["state"]


def continue_run(spark: SparkSession, path: str, fn: Callable[[list[dict]], list], hooks: Sequence[Hook] = (), updates: dict[str, Column] | None = None, **overrides) -> DataFrame:
    """All attempts of a run begun by `start_run`, those of this session included.

    Functions are given again; inputs, configuration and state come from `path`, and
    overrides (see `OVERRIDES`) hold for this session. What hooks remember is what the log holds:
    values that completed in an earlier session are seen by `seen_before`.
    """
    inputs, config, state = load_run_snapshot(spark, path, with_state=True)
    out = T.StructType.fromJson(json.loads(config.pop("out")))
    return run_records(inputs, fn, out, hooks=hooks, state=state, updates=updates, log=f"{path}/log", **with_overrides(config, **overrides))
