import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

from recordforge.jobs import base, offline, templates
from recordforge.jobs.queries import CONTRACT
from recordforge.operators import attempts as at, inputs as ins, ledger, run as runs, topics as tp
from recordforge.streaming import streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])
OUT = T.StructType([T.StructField("answer", T.StringType())])


def test_run_records_counts(spark):
    df = spark.range(5).select(F.col("id").alias("idx"), F.concat(F.lit("city"), "id").alias("city"))
    five = lambda rows: [[{"answer": f"{r['city']}_{i}"} for i in range(5)] for r in rows]
    assert at.output_index(runs.run_records(df, five, OUT)).count() == 25


def test_run_records_retries_and_dead_letters(spark):
    df = spark.range(4).select(F.col("id").alias("idx"), F.lit("x").alias("city"))
    bad = lambda rows: [ValueError(" Boom ")] * len(rows)
    done = runs.run_records(df, bad, OUT, threshold=3)
    assert done.count() == 12 and at.dead_letters(done).count() == 4
    assert [(r.error, r.n) for r in at.error_counts(done).collect()] == [("boom", 12)]
    with pytest.raises(ValueError, match="no input completed"):
        runs.require_output(done)


def test_run_records_one_slow_row_fails_alone(spark):
    import time

    def slow(rows):
        for r in rows:
            if int(r["city"]) % 8 == 0:
                time.sleep(3)
        return [[{"answer": r["city"]}] for r in rows]

    df = spark.range(24).coalesce(1).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("city"))
    began = time.time()
    got = runs.run_records(df, slow, OUT, timeout=0.3, threshold=1, batch_size=8, concurrency=4).collect()
    assert sorted(r.idx for r in got if r.status == "failed") == [0, 8, 16] and len(got) == 24
    assert all(r.err_str == "timed out" for r in got if r.status == "failed") and time.time() - began < 30


def test_calls_run_side_by_side_and_too_few_results_fail():
    import time

    began = time.time()
    got = runs.in_parallel(lambda b: time.sleep(0.4) or b, [[i] for i in range(8)], 5, 8)
    assert got == [[i] for i in range(8)] and time.time() - began < 2
    assert all(isinstance(x, ValueError) for x in runs.attempt(lambda b: b[:-1], [1, 2, 3], 0, 5, 2, 2))
    assert runs.attempt(lambda b: b if len(b) == 1 else b[:-1], [1, 2, 3], 0, 5, 2, 2) == [1, 2, 3]


def test_run_records_hooks_requeue_and_state(spark):
    """Filtered until a third attempt would be needed; duplicates of an earlier output; the state counts."""
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "c")], "idx long, city string")
    one = lambda rows: [[{"answer": r["city"]}] for r in rows]
    until = lambda rows, earlier, state: rows.withColumn("status", F.when((F.col("idx") == 2) & F.lit(state["tries"] < 6), "filtered").otherwise(F.col("status")))
    got = runs.run_records(df, one, OUT, hooks=[until, runs.seen_before(F.col("output")[0]["answer"])], state={"tries": 1}, updates={"tries": F.count("*")})
    assert sorted((r.idx, r.attempt, r.status) for r in got.collect()) == [(0, 1, "completed"), (1, 1, "duplicate"), (1, 2, "duplicate"), (1, 3, "duplicate"), (2, 1, "filtered"), (2, 2, "filtered"), (2, 3, "completed"), (3, 1, "completed")]
    assert got.run_state == {"tries": 9}
    assert [r.idx for r in at.dead_letters(got).collect()] == [1]
    only = runs.run_records(df, one, OUT, hooks=[runs.seen_before(F.col("output")[0]["answer"])], retry_statuses=["failed"])
    assert only.count() == 4 and "_input" not in only.columns


def test_run_records_stops(spark):
    df = spark.range(100).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("city"))
    one = lambda rows: [[{"answer": r["city"]}] for r in rows]
    assert runs.run_records(df, one, OUT, target=25, wave=10).count() == 30
    bad = lambda rows: [ValueError("no") if int(r["city"]) >= 20 else [] for r in rows]
    got = runs.run_records(df, bad, OUT, threshold=1, stop_after=5, wave=10).collect()
    assert max(r.idx for r in got) == 29 and sum(r.status == "failed" for r in got) == 10
    assert any("ValueError" in line for r in got if r.status == "failed" for line in r.err_trace)


def test_ask_model_survives_its_model(spark):
    def model(asked):
        if any("bad" in p for p in asked):
            raise RuntimeError("down")
        return offline.model(asked)

    df = spark.createDataFrame([(1, "good one"), (2, "bad"), (3, None), (4, "fine")], "i int, prompt string").coalesce(1)
    got = {r.i: (r.parse_status, r.parse_error) for r in runs.ask_model(df, "prompt", [{"name": "question", "type": "str"}, {"name": "answer", "type": "str"}], model).collect()}
    assert got[1][0] == got[4][0] == "ok" and got[2] == ("failed", "model: down") and got[3] == ("failed", "no JSON found")


def test_overrides():
    assert runs.with_overrides({"target": 3, "x": 1}, target=5, timeout=None) == {"target": 5, "x": 1}
    with pytest.raises(ValueError, match="cannot override"):
        runs.with_overrides({}, x=2)


def test_status_names(spark, sf):
    rows = base.attempts(spark, sf)
    assert at.filter_status(rows, "duplicated").count() == rows.filter("status = 'duplicate'").count()
    with pytest.raises(ValueError, match="unknown status"):
        at.filter_status(rows, "other")


def test_merge_outputs_refuses_a_shared_column(spark):
    a = spark.createDataFrame([(0, 0, "x")], "idx long, pos int, v string")
    with pytest.raises(ValueError, match="both results"):
        at.merge_outputs(a, a)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_stop_point_brute_force(spark, n):
    statuses = ["completed", "failed", "failed", "filtered", "completed", "failed"]
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(statuses)], "run_id string, seq long, status string")
    want = next(i for i in range(n - 1, 6) if all(s != "completed" for s in statuses[i - n + 1 : i + 1]))
    assert at.stop_point(df, n).first().seq == want
    assert at.stop_point(df, n, width=2).first().seq == want


def test_zip_inputs(spark):
    df = spark.createDataFrame([(["a", "b"], [1, 2])], "city array<string>, n array<int>")
    assert [(r.idx, r.city, r.n, r.k) for r in ins.zip_inputs(df, ["city", "n"], {"k": 7}).collect()] == [(0, "a", 1, 7), (1, "b", 2, 7)]
    assert ins.zip_inputs(df, ["city", "n"], {"city": "z"}).first().city == "z"
    bad = spark.createDataFrame([(["a"], [1, 2])], "city array<string>, n array<int>")
    with pytest.raises(Exception, match="unequal"):
        ins.zip_inputs(bad, ["city", "n"]).collect()
    with pytest.raises(ValueError, match="missing"):
        ins.check_columns(df, ["city", "other"])
    with pytest.raises(ValueError, match="unknown"):
        ins.check_columns(df, ["city"])
    with pytest.raises(ValueError, match="no input"):
        ins.read_inputs(spark, [])


def test_plan_distribution_brute_force(spark):
    def plan(t, most=10):
        if t <= most:
            return 1, 1, t, 3
        r = max(x for x in range(1, most + 1) if t % x == 0)
        a = max(d for d in range(1, math.isqrt(t // r) + 1) if (t // r) % d == 0)
        return a, t // r // a, r, 1 + a + t // r

    got = spark.range(1, 600).select("id", *[c.alias(k) for k, c in tp.plan_distribution(F.col("id")).items()]).collect()
    assert all((r.topics, r.subtopics, r.records, r.api_calls) == plan(r.id) for r in got)
    known = {4: (1, 1, 4), 10: (1, 1, 10), 11: (1, 11, 1), 47: (1, 47, 1), 100: (2, 5, 10)}
    assert {r.id: (r.topics, r.subtopics, r.records) for r in got if r.id in known} == known


def _topics(spark, rows):
    return spark.createDataFrame(rows, "pos long, topic string, n long")


@pytest.mark.parametrize(
    "rows, total, per, want",
    [
        ([(0, "t1", 20), (1, "t2", 30)], 100, 25, [("counted", 20), ("counted", 30), ("generated", 25), ("generated", 25)]),
        ([(0, "a", None), (1, "b", None), (2, "c", None)], 10, 5, [("text", 4), ("text", 3), ("text", 3)]),
        ([(0, "a", None), (1, "y", 10)], 30, 5, [("text", 20), ("counted", 10)]),
        ([(0, "a", None), (1, "b", None), (2, "c", None)], None, 15, [("text", 15)] * 3),
        ([(0, "t1", 2)], 13, 3, [("counted", 2), ("generated", 3), ("generated", 3), ("auto", 3), ("auto", 2)]),
    ],
)
def test_plan_topics(spark, rows, total, per, want):
    generated = spark.createDataFrame([(0, "g1"), (1, "g2"), (2, "t1")], "pos long, topic string")
    got = tp.plan_topics(_topics(spark, rows), generated, total, per)
    assert sorted((r.kind, r.n) for r in got.collect()) == sorted(want)


def test_plan_topics_errors(spark):
    none = spark.createDataFrame([], "pos long, topic string")
    with pytest.raises(ValueError, match="total"):
        tp.plan_topics(_topics(spark, [(0, "a", 3)]), none, None, 5)
    with pytest.raises(ValueError, match="more records"):
        tp.plan_topics(_topics(spark, [(0, "a", 30)]), none, 10, 5)


def test_ledger_pages_and_counts(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "project_id int, name string")
    assert ledger.list_projects(df).count() == 5 and ledger.list_projects(df, 2).count() == 2
    assert [r.name for r in ledger.list_projects(df, offset=2).collect()] == ["p2", "p3", "p4"]
    records = spark.createDataFrame([(s,) for s in ["completed"] * 5 + ["failed"] * 3 + ["filtered"] * 2], "status string")
    assert {r.status: r.n for r in ledger.count_by_status(records, F.lit(True)).collect()} == {"completed": 5, "failed": 3, "filtered": 2}


def test_snapshot(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "idx")
    ledger.save_run_snapshot(df, {"target": 3}, str(tmp_path / "run"))
    back, config = ledger.load_run_snapshot(spark, str(tmp_path / "run"))
    assert back.count() == 3 and config == {"target": 3}
    with pytest.raises(Exception):
        ledger.load_run_snapshot(spark, str(tmp_path / "none"))


def test_records_fan_out(spark, tmp_path):
    df = spark.createDataFrame([("abcdef", 1), ("ab", 2)], "record_uid string, v int")
    ledger.write_records(df, str(tmp_path / "r"))
    got = {r.record_uid: (r.p1, r.p2) for r in ledger.read_records(spark, str(tmp_path / "r")).collect()}
    assert got == {"abcdef": ("ab", "cd"), "ab": ("XX", "XX")}
    assert ledger.read_records(spark, str(tmp_path / "r"), "abc").count() == 1


def test_close_rows_leaves_others_alone(spark):
    rows = spark.createDataFrame([(1, "running", None, 7, 2), (2, "running", None, 7, 2)], "run int, status string, end_time int, completed int, failed int")
    summary = spark.createDataFrame([(1, "completed", 9, 5, None)], "run int, status string, end_time int, completed int, failed int")
    got = {r.run: (r.status, r.end_time, r.completed, r.failed) for r in ledger.close_rows(rows, summary, "run", ["completed", "failed"]).collect()}
    assert got == {1: ("completed", 9, 5, 0), 2: ("running", None, 7, 2)}


def test_restore_keeps_tasks_without_records(spark):
    inputs = spark.createDataFrame([(0, "h0"), (1, "h1"), (2, "h2")], "idx long, run_config_hash string")
    tasks = spark.createDataFrame([("h0", "j0", "completed"), ("h0", "j9", "completed"), ("h1", "j1", "completed"), ("h2", "j2", "failed")], "run_config_hash string, job_id string, status string")
    records = spark.createDataFrame([("j0", "r1"), ("j0", "r2"), ("j9", "r3")], "job_id string, record_uid string")
    payload = records.select("record_uid", F.lit("p").alias("payload"))
    again = lambda rows: rows.select("idx", F.array(F.lit("n")).alias("output"))
    got = runs.resume_run(inputs, tasks, records, payload, F.lit(True), again)
    assert {r.idx: r.output for r in got.collect()} == {0: ["p", "p"], 1: [], 2: ["n"]} and at.index_audit(got, 3).count() == 0


def test_resume_any_number_of_times(spark):
    inputs = ins.config_hash(spark.range(100).select(F.col("id").alias("idx"), F.concat(F.lit("c"), F.col("id") % 7).alias("city")), ["idx", "city"])
    tasks = inputs.filter("idx % 3 = 0").select("run_config_hash", F.concat(F.lit("j"), "idx").alias("job_id"), F.lit("completed").alias("status"))
    records = tasks.select("job_id", F.concat("job_id", F.lit("-1")).alias("record_uid"))
    payload = records.select("record_uid", F.lit("p").alias("payload"))
    again = lambda rows: rows.select("idx", F.array(F.lit("n")).alias("output"))
    got = runs.resume_run(inputs, tasks, records, payload, F.lit(True), again)
    assert got.count() == 100 and got.filter("restored").count() == 34
    assert at.index_audit(got, 100).count() == 0


def test_streams_equal_batch(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("t"), F.col("id") % 3).alias("topic"), F.col("id").alias("idx"), (F.col("id") % 5).cast("string").alias("value"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.stream_run(source(), lambda b: b.filter("idx % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "ck"))
    streams.stream_run(source(), lambda b: b.filter("idx % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20

    def collect(df, name):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    firsts = collect(streams.stream_first_rows(source(), ["topic", "value"]), "firsts")
    assert firsts.count() == at.mark_duplicates(rows, ["topic", "value"]).filter("not duplicate").count()
    with streams.rocks_db(spark):
        places = collect(streams.stream_topic_places(source()), "places").collect()
        memory = streams.latest_slices(collect(streams.stream_topic_memory(source(), 4), "memory")).collect()
    assert spark.conf.get(streams.PROVIDER, None) is None or "RocksDB" not in spark.conf.get(streams.PROVIDER)
    full = {r.topic: r.history for r in tp.topic_history(rows).collect()}
    for topic, history in full.items():
        mine = [r for r in places if r.topic == topic]
        assert sorted(r.earlier for r in mine) == list(range(len(history))) and sorted(r.value for r in mine) == sorted(history)
    assert sorted(memory) == sorted(tp.topic_history(rows, 4).collect())


def test_stream_topic_memory_over_batches(spark, tmp_path):
    """Slices that a batch leaves open go on in the next one; null topics and values are values."""
    schema, rows = "topic string, idx long, value string", []
    for lo in (0, 7, 9, 30):
        part = [(("a", None, "b")[i % 3], i, None if i % 5 == 0 else f"v{i}") for i in range(lo, lo + 13)]
        rows += part
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        with streams.rocks_db(spark):
            streams.stream_run(streams.stream_topic_memory(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3), lambda b: b, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.topic, r.slice): r.history for r in streams.latest_slices(spark.read.parquet(str(tmp_path / "out"))).collect()}
    for topic in ("a", None, "b"):
        values = [v for t, _, v in rows if t == topic]
        assert [got[topic, k] for k in range(-(-len(values) // 3))] == [values[i : i + 3] for i in range(0, len(values), 3)]
    last = spark.read.parquet(str(tmp_path / "out")).filter("batch = 3")
    assert last.count() < len(got)


def test_stream_marks_duplicates_of_earlier_batches(spark, tmp_path):
    schema = "idx long, key string, other string"
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {}
    for rows in ([(3, "a"), (1, "b"), (2, "a")], [(0, "a"), (5, None), (6, None), (7, "c")], [(8, None), (9, "d"), (None, "d")], [(10, "d"), (None, "e"), (11, "e")], [(12, "f")]):
        spark.createDataFrame([(*r, "x") for r in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
        with streams.rocks_db(spark):
            streams.stream_run(streams.stream_mark_duplicates(source(), ["key"]), lambda b: b, str(tmp_path / "out"), str(tmp_path / "ck"))
        out = spark.read.parquet(str(tmp_path / "out"))
        got = {(r.idx, r.key): r.duplicate for r in out.collect()}
    assert {k for k, v in got.items() if v} == {(3, "a"), (0, "a"), (6, None), (8, None), (10, "d")} and len(got) == 14 and "other" in out.columns


def test_stream_duplicates_of_a_hot_key(spark, tmp_path):
    """One key's rows in several frames, the first of them in the last."""
    rows = spark.range(30_000).select((30_000 - F.col("id")).alias("idx"), (F.col("id") % 1000 == 7).alias("other"), F.lit("k").alias("_key"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    with streams.rocks_db(spark):
        streams.stream_run(streams.stream_mark_duplicates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["other"]), lambda b: b, str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out"))
    want = at.mark_duplicates(rows, ["other"])
    assert out.drop("batch").exceptAll(want.select(out.drop("batch").columns)).isEmpty() and out.count() == 30_000 and out.filter("not duplicate").count() == 2


def test_histories_in_slices(spark):
    rows = spark.createDataFrame([("t", i, str(i)) for i in range(7)] + [("u", 0, "x")], "topic string, idx long, value string")
    got = sorted((r.topic, r.slice, r.history) for r in tp.topic_history(rows, 3).collect())
    assert got == [("t", 0, ["0", "1", "2"]), ("t", 1, ["3", "4", "5"]), ("t", 2, ["6"]), ("u", 0, ["x"])]


def test_function_call_dataset(spark):
    topics = spark.createDataFrame([("t1",), ("t2",)], "topic string")
    got = templates.function_call_dataset(topics, CONTRACT, offline.scripted, 9, 5).collect()
    assert len(got) == 9 and all(r.ok and r.why is None for r in got)
    assert {("mended" in r.answer) for r in got} == {True, False} and all(("mended" in r.answer) == (offline.bucket(r.subtopic, 3) == 0) for r in got)


def test_generate_by_topic_shows_what_was_generated(spark):
    plan = spark.createDataFrame([(0, "a", 5), (1, "b", 1)], "pos long, topic string, n long")
    fields = [{"name": "question", "type": "str"}, {"name": "answer", "type": "str"}]
    got = templates.generate_by_topic(plan, "On {topic}{% if example %} not {{ example }}{% endif %}", fields, offline.echo).collect()
    first = {r.question for r in got if r.example is None}
    assert len(got) == 6 and sum(r.example is not None for r in got) == 2
    assert all(any(q in r.example for q in first) for r in got if r.example is not None)


def test_verified_reasoning(spark):
    got = templates.verified_reasoning(spark.createDataFrame([(f"t{i}",) for i in range(20)], "topic string"), offline.scripted).collect()
    want = {(f"t{i}/{k}", f"good {k}" if not offline.bucket(f"t{i}/{k}", 2) else "mended") for i in range(20) for k in range(2) if not offline.bucket(f"t{i}/{k}", 2) or offline.bucket(f"t{i}/{k}-again", 4)}
    assert {(r.problem, r.answer) for r in got} == want


def test_sample_exact_and_shuffle(spark):
    df = spark.range(50).withColumnRenamed("id", "idx")
    assert ins.sample_exact(df, 20).count() == 20 and ins.sample_exact(df, 80).count() == 50
    assert [r.idx for r in ins.sample_exact(df, 20, seed=1).collect()] == [r.idx for r in ins.sample_exact(df, 20, seed=1).collect()]
    assert sorted(r.place for r in ins.shuffle_rows(df).collect()) == list(range(1, 51))


# Runs that go on, ledgers, numbers, pages


class Killed(Exception):
    pass


def test_a_killed_run_goes_on(spark, tmp_path):
    """Killed in the second round: the first is kept, its calls are not made again, and the end is that of a run without a break."""
    df = spark.range(30).select(F.col("id").alias("idx"), F.concat(F.lit("c"), F.col("id") % 7).alias("city"))
    flag = tmp_path / "calls"
    flag.mkdir()

    def fn(rows):
        for r in rows:
            (flag / f"{r['city']}-{len(list(flag.iterdir()))}").touch()
        return [ValueError("no") if r["city"] == "c3" else [{"answer": r["city"]}] for r in rows]

    seen = runs.seen_before(F.col("output")[0]["answer"])

    def kill(rows, earlier, state):
        if state["rounds"] == 1:
            raise Killed
        return rows

    how = {"threshold": 3, "batch_size": 4, "updates": {"rounds": F.lit(1).cast("long") * F.max(F.lit(1))}, "state": {"rounds": 0}}
    with pytest.raises(Killed):
        runs.run_records(df.coalesce(1), fn, OUT, hooks=[seen, kill], log=str(tmp_path / "log"), **how)
    called = len(list(flag.iterdir()))
    got = runs.run_records(df.coalesce(1), fn, OUT, hooks=[seen], log=str(tmp_path / "log"), **how)
    want = runs.run_records(df, lambda rows: [ValueError("no") if r["city"] == "c3" else [{"answer": r["city"]}] for r in rows], OUT, hooks=[seen], **how)
    key = lambda rows: sorted((r.idx, r.attempt, r.status) for r in rows.collect())
    assert key(got) == key(want) and got.run_state == want.run_state == runs.run_state(spark, str(tmp_path / "log")) == {"rounds": 3}
    assert called >= 30 and got.select("idx", "attempt").distinct().count() == got.count()
    done = at.flatten_outputs(got.filter("attempt = 1"))
    assert at.index_audit(done, 30).count() == 0
    tables = ledger.run_ledger(got)
    assert tables["tasks"].count() == 30 and tables["tasks"].filter("status = 'failed'").count() == 4 and tables["records"].filter("error_message = 'no'").count() == 12


def test_log_without_its_commit_does_not_count(spark, tmp_path):
    import shutil

    df = spark.range(6).select(F.col("id").alias("idx"), F.lit("x").alias("city"))
    bad = lambda rows: [ValueError("no")] * len(rows)
    first = runs.run_records(df, bad, OUT, threshold=2, log=str(tmp_path / "log"))
    assert first.count() == 12
    (tmp_path / "log" / "commits" / "000002.json").unlink()
    assert runs.AttemptLog(spark, str(tmp_path / "log")).rows().count() == 6
    again = runs.run_records(df, lambda rows: [[{"answer": "a"}] for _ in rows], OUT, threshold=2, log=str(tmp_path / "log"))
    assert sorted((r.idx, r.attempt, r.status) for r in again.collect()) == sorted([(i, 1, "failed") for i in range(6)] + [(i, 2, "completed") for i in range(6)])
    assert runs.run_records(df, bad, OUT, threshold=2, log=str(tmp_path / "log")).count() == 12  # nothing is left to do
    (tmp_path / "log" / "commits" / "000001.json").unlink()
    with pytest.raises(ValueError, match="lacks a round"):
        runs.AttemptLog(spark, str(tmp_path / "log"))
    shutil.rmtree(tmp_path / "log" / "commits")


def test_a_second_session_knows_the_first(spark, tmp_path):
    """Values, state, counts and configuration go on; overrides hold; dead letters get more attempts."""
    df = spark.range(40).select(F.col("id").alias("idx"), F.concat(F.lit("c"), F.col("id") % 20).alias("city"))
    one = lambda rows: [ValueError("no") if r["city"] == "c1" else [{"answer": r["city"]}] for r in rows]
    hooks, updates, path = [runs.seen_before(F.col("output")[0]["answer"])], {"tries": F.count("*")}, str(tmp_path / "run")
    first = runs.start_run(df, one, "answer string", path, hooks, {"tries": 100}, updates, threshold=1, target=10, wave=10)
    assert first.count() == 20 and first.run_state == {"tries": 120}
    same = runs.continue_run(spark, path, one, hooks, updates)
    assert same.count() == 20 and same.run_state == {"tries": 120}  # the target is reached
    second = runs.continue_run(spark, path, one, hooks, updates, target=20)
    rows = {(r.idx, r.attempt): r.status for r in second.collect()}
    assert len(rows) == 40 and second.run_state == {"tries": 140}
    assert all(rows[i, 1] == ("failed" if i % 20 == 1 else "duplicate") for i in range(20, 40))
    third = runs.continue_run(spark, path, lambda rows: [[{"answer": "new " + r["city"]}] for r in rows], hooks, updates, target=0, threshold=2)
    last = {r.idx: (r.attempt, r.status) for r in third.collect() if r.attempt == 2}
    assert last == {**{1: (2, "completed"), 21: (2, "duplicate")}, **{i: (2, "duplicate" if i % 20 == 1 else "completed") for i in range(20, 40)}}


def test_run_refuses_null_idx(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b")], "idx long, city string")
    one = lambda rows: [[{"answer": r["city"]}] for r in rows]
    for how in ({}, {"target": 1}):
        with pytest.raises(Exception, match="without idx"):
            runs.run_records(df, one, OUT, **how).count()
    assert runs.run_records(df.filter("false"), one, OUT).count() == 0


def test_ledger_of_a_run_is_restored(spark):
    df = ins.config_hash(spark.range(12).select(F.col("id").alias("idx"), F.concat(F.lit("c"), "id").alias("city")), ["idx", "city"])
    two = lambda rows: [ValueError("x") if r["city"] == "c5" else [{"answer": r["city"]}, {"answer": None}] for r in rows]
    tables = ledger.run_ledger(runs.run_records(df, two, OUT, threshold=2, run_id="r"), df)
    assert [(r.master_job_id, r.status, r.completed, r.failed) for r in tables["runs"].collect()] == [("r", "completed_with_errors", 11, 2)]
    assert ledger.orphans(tables["records"], tables["tasks"], "job_id", "job_id").isEmpty() and ledger.task_durations(tables["tasks"]).filter("seconds >= 0").count() == 12
    again = lambda rows: rows.select("idx", F.array(F.lit("n")).alias("output"))
    got = runs.resume_run(df, tables["tasks"], tables["records"], tables["payload"], F.lit(True), again).collect()
    assert {r.idx: r.output for r in got} == {i: ["n"] if i == 5 else [f'{{"answer":"c{i}"}}', '{"answer":null}'] for i in range(12)}


def test_attempt_frees_its_inputs_without_a_collection():
    import gc
    import time
    import weakref

    class Input:
        pass

    def call() -> weakref.ref:
        inputs = [Input() for _ in range(5)]
        assert runs.attempt(lambda b: list(range(len(b))), inputs, 1, 5, 2, 2) == [0, 1, 0, 1, 0]
        return weakref.ref(inputs[0])

    gc.collect()
    gc.disable()
    try:
        held = call()
        for _ in range(50):  # the last thread may still be ending
            if held() is None:
                break
            time.sleep(0.01)
        assert held() is None
    finally:
        gc.enable()


def test_asking_a_model_takes_up_few_rows_at_a_time(spark):
    """Replies come as they are asked for: no more prompts than `AT_ONCE` times those asked at once lie between."""
    rows = spark.range(0, 100, 1, 1).select("id", F.when(F.col("id") != 7, F.concat(F.lit("p"), "id")).alias("prompt"), F.array("id").alias("more"))
    got = runs.ask_model(rows, "prompt", [{"name": "question", "type": "str"}], lambda b: [f'[{{"question": "{len(b)}{p}"}}]' for p in b], batch_size=5, concurrency=2).orderBy("id").collect()
    sizes = [int(r.reply.split('"')[3].split("p")[0]) for r in got if r.reply]
    assert len(got) == 100 and got[7].reply is None and sizes[:15] == [5] * 15 and sizes[15:19] == [4] * 4 and set(sizes[19:]) == {5} and [r.more for r in got] == [[i] for i in range(100)]


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    import os

    rows = spark.range(1000).select(F.when(F.col("id") != 3, F.col("id")).alias("uid"), F.lit("a").alias("status"), F.lit(1).alias("v"))
    table = ledger.BucketedTable(spark, str(tmp_path / "t"), "uid", 32)
    table.create(rows)
    times = lambda: {d: max(os.stat(os.path.join(p, f)).st_mtime_ns for f in fs) for p, _, fs in os.walk(tmp_path / "t") if fs and (d := os.path.basename(p)).startswith("bucket=")}
    before = times()
    changes = spark.createDataFrame([(5, "b", 2), (5, "c", 3), (7, "old", 0), (2000, "new", 1)], "uid long, status string, v int")
    touched = table.upsert(changes, "v")
    after = times()
    assert {b for b in after if after[b] != before.get(b)} == {f"bucket={b}" for b in touched} and 1 <= len(touched) <= 3
    assert sorted(map(str, table.read().collect())) == sorted(map(str, ledger.upsert_ledger(rows, changes, "uid", "v").collect()))
    assert [r.status for r in table.find(5).collect()] == ["c"] and table.find(99999).isEmpty() and table.upsert(changes.filter("false"), "v") == []


def test_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 8).select(F.md5(F.col("id").cast("string")).alias("uid"), F.lit("a").alias("status"), F.lit(1).alias("v"))
    table = ledger.BucketedTable(spark, str(tmp_path / "t"), "uid", 2)
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "512k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        table.create(rows)
        created = len(list((tmp_path / "t").rglob("*.parquet")))
        table.upsert(rows.withColumn("v", F.lit(2)), "v")
    finally:
        for k in small:
            spark.conf.unset(k)
    assert created > 2 and len(list((tmp_path / "t").rglob("*.parquet"))) > 2
    assert table.read().agg(F.count("*"), F.countDistinct("uid"), F.min("v")).first()[:] == (200_000, 200_000, 2)


def test_pages_by_key_are_those_by_offset(spark, tmp_path):
    at_ = lambda k: F.when(k % 17 != 0, (k * 7919 % 211).cast("timestamp"))
    rows = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("uid"), at_(F.col("id")).alias("at"), (F.col("id") % 3 == 0).alias("ok"))
    table = ledger.PagedTable(spark, str(tmp_path / "t"), "at", "uid")
    table.create(rows, 12)
    for where, size in ((None, 400), (F.col("ok"), 130)):
        last, offset = None, 0
        while got := table.page(size, last, where).collect():
            want = ledger.list_rows(rows, where, [], "at", "uid", size, offset).collect() if where is None or offset < 600 else got
            assert got == want
            last, offset = (got[-1].at, got[-1].uid), offset + len(got)
        assert offset == rows.filter(F.lit(True) if where is None else where).count()
    deep = ledger.list_rows(rows, None, [], "at", "uid", 1, 1500).first()
    plan = table.page(50, (deep.at, deep.uid))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "IsNotNull(at)" in pushed and "LessThanOrEqual(at" in pushed  # of the lower and of the upper bound


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_positions_do_not_depend_on_how_files_are_read(spark, tmp_path, fmt):
    rows = spark.range(5000).select("id", F.repeat(F.col("id").cast("string"), 20).alias("text"), F.lit("old").alias("idx"))
    rows.repartition(3).write.format(fmt).option("header", "true").save(str(tmp_path / "in"))
    got = []
    for size in ("128m", "40k", "9k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got.append({int(r.id): r.idx for r in ins.number_inputs(spark, str(tmp_path / "in"), fmt).collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == got[1] == got[2] and sorted(got[0].values()) == list(range(5000))


def test_fan_out_of_a_huge_topic(spark):
    topics = spark.createDataFrame([(1, "big", 600_000_000), (2, "small", 3), (3, "none", 0), (4, None, 2)], "pos long, topic string, n long")
    got = tp.fan_out_topics(topics)
    assert got.filter("topic = 'small' or topic is null").orderBy("pos", "k").select("pos", "k").collect() == [(2, 1), (2, 2), (2, 3), (4, 1), (4, 2)]
    few = tp.fan_out_topics(topics.withColumn("n", F.least("n", F.lit(1003))).withColumn("_low", F.lit("x")), 7)
    assert few.filter("topic = 'big'").agg(F.count("*"), F.count_distinct("k"), F.min("k"), F.max("k")).first() == (1003, 1003, 1, 1003) and few.columns[-2:] == ["_low", "k"]
    top = got.filter("topic = 'big'").agg(F.count("*").alias("n"), F.max("k").alias("m")).first()
    assert (top.n, top.m) == (600_000_000, 600_000_000)


def test_names_and_null_topics(spark):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("t", 3, "c")], "topic string, idx long, value string").withColumns({"_rank": F.lit(1), "_topic": F.lit(2)})
    got = {r.idx: r.example for r in tp.earlier_example(rows).collect()}
    assert got == {1: None, 2: "a", 3: None} and "_rank" in tp.earlier_example(rows).columns
    marked = at.mark_duplicates(rows.withColumn("_key", F.lit("mine")).withColumn("_first", F.lit("too")), ["topic"])
    assert {(r.idx, r.duplicate, r["_key"], r["_first"]) for r in marked.collect()} == {(1, False, "mine", "too"), (2, True, "mine", "too"), (3, False, "mine", "too")}
