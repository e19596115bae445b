"""The registered queries of the record-building operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from recordforge.functions import bpe, jsonx, prompts, text
from recordforge.jobs import base, offline, templates
from recordforge.operators import attempts as at, inputs as ins, ledger, run as runs_, topics as tp
from recordforge.sources import files
from recordforge.sources.files import read_html_pages
from recordforge.sources.tables import load, make_folder, move, scratch_path
from recordforge.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return register


A, I = base.ATTEMPTS, base.ITEMS


# Inputs


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def read_inputs(spark, d):
    return ins.read_inputs(spark, f"{d}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_custkey, c_name FROM customer")
def number_inputs(spark, d):
    return ins.number_inputs(spark, f"{d}/customer.parquet").select("idx", "c_custkey", "c_name")


@query("""SELECT CAST(i - 1 AS BIGINT) AS idx, names[i] AS city_name, keys[i] AS n, 'fixed' AS kind, region
  FROM (SELECT list(n_name ORDER BY n_nationkey) AS names, list(n_nationkey ORDER BY n_nationkey) AS keys, n_regionkey AS region FROM nation GROUP BY n_regionkey), LATERAL (SELECT unnest(range(1, len(names) + 1)) AS i)""")
def zip_inputs(spark, d):
    nation = load(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("_l"))
    lists = nation.select("region", F.col("_l.n_name").alias("city_name"), F.col("_l.n_nationkey").alias("n"))
    return ins.zip_inputs(lists, ["city_name", "n"], {"kind": "fixed"}, keep=["region"])


@query("SELECT doc_id AS idx, lang, source FROM documents ORDER BY doc_id LIMIT 1")
def dry_run(spark, d):
    return ins.dry_run(load(spark, d, "documents").select(F.col("doc_id").alias("idx"), "lang", "source"))


@query("SELECT o_orderkey AS idx, sha256('o_custkey=' || coalesce(CAST(o_custkey AS VARCHAR), chr(30)) || chr(31) || 'o_orderkey=' || coalesce(CAST(o_orderkey AS VARCHAR), chr(30)) || chr(31) || 'o_orderpriority=' || coalesce(o_orderpriority, chr(30))) AS run_config_hash FROM orders")
def config_hash(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return ins.config_hash(orders, orders.columns).select(F.col("o_orderkey").alias("idx"), "run_config_hash")


@query("SELECT o_orderkey AS idx FROM orders ORDER BY md5(o_orderkey || '-7'), o_orderkey LIMIT 100")
def sample_exact(spark, d):
    return ins.sample_exact(load(spark, d, "orders").select(F.col("o_orderkey").alias("idx")), 100, seed=7)


@query("SELECT o_orderkey AS idx, row_number() OVER (ORDER BY md5(o_orderkey || '-3'), o_orderkey) AS place FROM orders")
def shuffle_rows(spark, d):
    return ins.shuffle_rows(load(spark, d, "orders").select(F.col("o_orderkey").alias("idx")), seed=3)


@query("SELECT o_orderkey, r_name AS contract FROM orders, (SELECT r_name FROM region WHERE r_regionkey = 0)")
def attach_contract(spark, d):
    contract = load(spark, d, "region").filter("r_regionkey = 0").select(F.col("r_name").alias("contract"))
    return ins.attach_contract(load(spark, d, "orders").select("o_orderkey"), contract)


# Attempts


@query("SELECT idx, attempt, seq FROM attempts WHERE status = 'duplicate'", A)
def filter_status(spark, d):
    return at.filter_status(base.attempts(spark, d), "duplicated").select("idx", "attempt", "seq")


@query("SELECT idx, attempt, CAST(pos AS INTEGER) AS pos, answer, NULL AS err_str FROM items UNION ALL SELECT idx, attempt, 0, NULL, err_str FROM attempts WHERE status = 'failed'", A, I)
def flatten_outputs(spark, d):
    return at.flatten_outputs(base.attempts(spark, d)).select("idx", "attempt", "pos", F.col("item.answer").alias("answer"), "err_str")


@query("SELECT idx, attempt, CAST(pos AS INTEGER) AS pos FROM items WHERE status = 'completed'", A, I)
def output_index(spark, d):
    return at.output_index(base.attempts(spark, d))


@query("SELECT doc_id, coalesce(quality = 1 AND toxic = 0, false) AS ok, CASE WHEN coalesce(quality = 1 AND toxic = 0, false) THEN NULL WHEN NOT coalesce(quality = 1, false) THEN 'format' ELSE 'semantic' END AS failed_reason FROM labels")
def split_checked(spark, d):
    rows = load(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("f"), (F.col("toxic") == 0).alias("s"))
    return at.split_checked(rows, "f", "s").select("doc_id", "ok", "failed_reason")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS part FROM labels WHERE toxic = 0")
def split_verified(spark, d):
    flag = F.when(F.col("toxic") == 1, "unknown").when(F.col("quality") == 1, "True").otherwise("False")
    yes, no = at.split_verified(load(spark, d, "labels").withColumn("verified", flag), "verified")
    return yes.select("doc_id", F.lit("yes").alias("part")).unionByName(no.select("doc_id", F.lit("no").alias("part")))


@query("SELECT idx, attempt, CAST(pos AS INTEGER) AS pos, answer, CASE WHEN pos = 0 THEN run_id END AS topic FROM items", A, I)
def tag_first_output(spark, d):
    tagged = at.tag_first_output(base.attempts(spark, d).filter("status <> 'failed'"), "run_id")
    return tagged.select("idx", "attempt", F.posexplode("output").alias("pos", "x")).select("idx", "attempt", "pos", "x.answer", "x.topic")


@query("SELECT idx, attempt, status, n_chars FROM attempts JOIN documents ON idx = doc_id", A)
def join_back(spark, d):
    source = load(spark, d, "documents").select(F.col("doc_id").alias("idx"), "n_chars")
    return at.join_back(base.attempts(spark, d).select("idx", "attempt", "status"), source)


@query("SELECT a.idx, CAST(a.pos AS INTEGER) AS pos, a.answer AS first_answer, b.answer AS second_answer FROM items a JOIN items b ON a.idx = b.idx AND a.pos = b.pos WHERE a.attempt = 1 AND b.attempt = 2", A, I)
def merge_outputs(spark, d):
    items = at.flatten_outputs(base.attempts(spark, d).filter("status <> 'failed'"))
    side = lambda k, name: items.filter(F.col("attempt") == k).select("idx", "pos", F.col("item.answer").alias(name))
    return at.merge_outputs(side(1, "first_answer"), side(2, "second_answer"))


@query("SELECT idx, attempt, status, NULL AS err_str FROM attempts WHERE status = 'completed' UNION ALL SELECT idx, attempt, status, err_str FROM attempts WHERE status = 'failed'", A)
def union_results(spark, d):
    rows = base.attempts(spark, d)
    return at.union_results(at.filter_status(rows, "completed").select("idx", "attempt", "status"), at.filter_status(rows, "failed").select("idx", "attempt", "status", "err_str"))


@query("SELECT DISTINCT idx, answer FROM items", A, I)
def drop_repeated_outputs(spark, d):
    items = at.flatten_outputs(base.attempts(spark, d).filter("status <> 'failed'")).select("idx", F.col("item.answer").alias("answer"))
    return at.drop_repeated_outputs(items, ["answer"])


@query("""SELECT DISTINCT idx, 'missing' AS side FROM attempts WHERE attempt = 1 AND status = 'completed' AND idx NOT IN (SELECT idx FROM attempts WHERE attempt = 2 AND status = 'completed')
  UNION ALL SELECT DISTINCT idx, 'added' FROM attempts WHERE attempt = 2 AND status = 'completed' AND idx NOT IN (SELECT idx FROM attempts WHERE attempt = 1 AND status = 'completed')""", A)
def compare_runs(spark, d):
    done = at.filter_status(base.attempts(spark, d), "completed")
    return at.compare_runs(done.filter("attempt = 1"), done.filter("attempt = 2"))


@query("""SELECT run_id, CAST(sum(c) AS BIGINT) AS completed, CAST(sum(d) AS BIGINT) AS duplicate, CAST(sum(f) AS BIGINT) AS filtered, CAST(sum(e) AS BIGINT) AS failed, CAST(sum(t) AS BIGINT) AS total, count(*) FILTER (t - c >= 3) AS dead_letters
  FROM (SELECT run_id, idx, count(*) FILTER (status = 'completed') AS c, count(*) FILTER (status = 'duplicate') AS d, count(*) FILTER (status = 'filtered') AS f, count(*) FILTER (status = 'failed') AS e, count(*) AS t FROM attempts GROUP BY run_id, idx) GROUP BY run_id""", A)
def run_summary(spark, d):
    return at.run_summary(base.attempts(spark, d))


@query("SELECT job_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'filtered') AS filtered, count(*) FILTER (status = 'failed') AS failed FROM records GROUP BY job_id", base.RECORDS)
def task_counts(spark, d):
    return at.task_counts(base.records(spark, d))


@query("SELECT lower(trim(err_str)) AS error, count(*) AS n FROM attempts WHERE status = 'failed' GROUP BY 1", A)
def error_counts(spark, d):
    return at.error_counts(base.attempts(spark, d))


@query("SELECT count(*) FILTER (status = 'completed') AS kept, count(*) AS initial, round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 4) AS rate FROM attempts", A)
def success_rate(spark, d):
    rows = base.attempts(spark, d)
    return at.success_rate(at.filter_status(rows, "completed"), rows).withColumn("rate", F.col("rate").cast("double"))


@query("SELECT run_id, count(DISTINCT idx) FILTER (status = 'completed') AS completed, CAST(45 AS BIGINT) AS target, count(DISTINCT idx) FILTER (status = 'completed') >= 45 AS reached FROM attempts GROUP BY run_id", A)
def target_reached(spark, d):
    return at.target_reached(base.attempts(spark, d), 45)


@query("""SELECT idx, CASE WHEN idx >= (SELECT count(*) - 10 FROM documents) THEN 'unexpected' ELSE 'duplicate' END AS problem, count(*) AS n FROM attempts WHERE status = 'completed' GROUP BY idx HAVING count(*) > 1 OR idx >= (SELECT count(*) - 10 FROM documents)
  UNION ALL SELECT range AS idx, 'missing', 0 FROM range((SELECT count(*) - 10 FROM documents)) WHERE range NOT IN (SELECT idx FROM attempts WHERE status = 'completed')""", A)
def index_audit(spark, d):
    return at.index_audit(at.filter_status(base.attempts(spark, d), "completed"), load(spark, d, "documents").count() - 10)


@query("SELECT run_id, idx, count(*) AS n, max(seq) AS last_seq FROM attempts WHERE status <> 'completed' GROUP BY run_id, idx HAVING count(*) >= 3", A)
def dead_letters(spark, d):
    return at.dead_letters(base.attempts(spark, d))


@query("SELECT run_id, min(seq) AS seq FROM (SELECT run_id, seq, sum(CASE WHEN status <> 'completed' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq ROWS 3 PRECEDING) AS bad FROM attempts) WHERE bad = 4 GROUP BY run_id", A)
def stop_point(spark, d):
    return at.stop_point(base.attempts(spark, d), 4)


@query("SELECT doc_id AS idx, doc_id > min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents")
def mark_duplicates(spark, d):
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text")
    return at.mark_duplicates(rows, ["text"]).select("idx", "duplicate")


@query("""SELECT d.doc_id AS idx, CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY d.text) THEN 'duplicate' WHEN coalesce(l.quality = 0, false) THEN 'filtered' ELSE 'completed' END AS status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def apply_hooks(spark, d):
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text").join(load(spark, d, "labels").withColumnRenamed("doc_id", "idx"), "idx", "left")
    marked = at.mark_duplicates(rows, ["text"]).withColumn("status", F.lit("completed"))
    return at.apply_hooks(marked, [F.col("duplicate")], [F.col("quality") == 0]).select("idx", "status")


@query("SELECT idx, attempt FROM attempts WHERE status = 'completed' AND idx IN (SELECT DISTINCT idx FROM attempts WHERE status = 'completed' ORDER BY idx LIMIT 50)", A)
def take_target(spark, d):
    return at.take_target(base.attempts(spark, d), 50).select("idx", "attempt")


# Ledger


@query("""SELECT record_uid, arg_max(status, v) AS status, max(v) AS version FROM (
  SELECT record_uid, status, 1 AS v FROM records UNION ALL SELECT record_uid, 'rerun' AS status, 2 AS v FROM records WHERE quantity > 25) GROUP BY record_uid""", base.RECORDS)
def upsert_ledger(spark, d):
    rows = base.records(spark, d)
    changes = rows.filter("quantity > 25").select("record_uid", F.lit("rerun").alias("status"), F.lit(2).alias("version"))
    return ledger.upsert_ledger(rows.select("record_uid", "status", F.lit(1).alias("version")), changes, "record_uid", "version")


@query("""SELECT record_uid, arg_max(status, v) AS status, max(v) AS version FROM (
  SELECT record_uid, status, 1 AS v FROM records UNION ALL SELECT record_uid, 'rerun' AS status, 2 AS v FROM records WHERE quantity > 49 UNION ALL SELECT 'new-' || job_id, 'added', 2 FROM tasks) GROUP BY record_uid""", base.RECORDS, base.TASKS)
def upsert_buckets(spark, d):
    table = ledger.BucketedTable(spark, scratch_path(spark, "ledger"), "record_uid", 16)
    rows = base.records(spark, d)
    table.create(rows.select("record_uid", "status", F.lit(1).alias("version")))
    table.upsert(rows.filter("quantity > 49").select("record_uid", F.lit("rerun").alias("status"), F.lit(2).alias("version")), "version")
    table.upsert(base.tasks(spark, d).select(F.concat(F.lit("new-"), "job_id").alias("record_uid"), F.lit("added").alias("status"), F.lit(2).alias("version")), "version")
    return table.read().select("record_uid", "status", "version")


@query("""SELECT t.job_id, CASE WHEN s.n IS NULL THEN t.status ELSE 'closed' END AS status, CASE WHEN s.n IS NULL THEN t.end_time ELSE coalesce(s.stop, t.end_time) END AS end_time,
    CASE WHEN s.n IS NULL THEN t.job_id % 7 ELSE s.completed END AS completed, CASE WHEN s.n IS NULL THEN t.job_id % 5 ELSE s.failed END AS failed
  FROM tasks t LEFT JOIN (SELECT job_id, count(*) AS n, max(start_time) AS stop, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM records WHERE job_id % 3 > 0 GROUP BY job_id) s USING (job_id)""", base.TASKS, base.RECORDS)
def close_tasks(spark, d):
    rows = base.records(spark, d).filter("job_id % 3 > 0")
    summary = rows.groupBy("job_id").agg(F.max("start_time").alias("end_time"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed")).withColumn("status", F.lit("closed"))
    before = base.tasks(spark, d).withColumns({"completed": F.col("job_id") % 7, "failed": F.col("job_id") % 5})
    return ledger.close_rows(before, summary, "job_id", ["completed", "failed"]).select("job_id", "status", "end_time", "completed", "failed")


@query("SELECT status, count(*) AS n FROM records WHERE job_id % 2 = 0 GROUP BY status", base.RECORDS)
def count_by_status(spark, d):
    return ledger.count_by_status(base.records(spark, d), F.col("job_id") % 2 == 0)


@query("SELECT n_nationkey AS project_id, n_name AS name FROM nation ORDER BY n_name, n_nationkey LIMIT 10 OFFSET 5")
def list_projects(spark, d):
    return ledger.list_projects(base.projects(spark, d), 10, 5).select("project_id", "name")


@query("SELECT master_job_id, status, creation_time FROM runs WHERE project_id = 3 AND status IN ('pending', 'running') ORDER BY creation_time DESC, master_job_id LIMIT 5 OFFSET 2", base.RUNS)
def list_runs(spark, d):
    return ledger.list_rows(base.runs(spark, d), F.col("project_id") == 3, ["pending", "running"], "creation_time", "master_job_id", 5, 2).select("master_job_id", "status", "creation_time")


@query("SELECT job_id, status, start_time FROM tasks WHERE status = 'failed' ORDER BY start_time DESC, job_id LIMIT 40", base.TASKS)
def list_tasks(spark, d):
    return ledger.list_rows(base.tasks(spark, d), None, ["failed"], "start_time", "job_id", 40).select("job_id", "status", "start_time")


@query("SELECT record_uid, status, start_time FROM records WHERE status IN ('completed', 'failed') ORDER BY start_time DESC, record_uid LIMIT 1000 OFFSET 100", base.RECORDS)
def list_records(spark, d):
    return ledger.list_rows(base.records(spark, d), None, ["completed", "failed"], "start_time", "record_uid", None, 100).select("record_uid", "status", "start_time")


@query("SELECT record_uid, status, start_time FROM records WHERE status IN ('completed', 'failed') ORDER BY start_time DESC, record_uid LIMIT 300 OFFSET 1500", base.RECORDS)
def page_records(spark, d):
    rows, chosen = base.records(spark, d), F.col("status").isin("completed", "failed")
    table = ledger.PagedTable(spark, scratch_path(spark, "pages"), "start_time", "record_uid")
    table.create(rows, 40)
    last = None
    for size in (1000, 500):  # each page begins after the last row of the one before
        place = F.struct(-F.unix_micros(F.col("start_time").cast("timestamp")), "record_uid")
        last = table.page(size, last, chosen).agg(F.max_by(F.struct("start_time", "record_uid"), place).alias("r")).first()["r"]
    return table.page(300, last, chosen).select("record_uid", "status", "start_time")


@query("SELECT master_job_id, name, status FROM runs WHERE master_job_id = 7", base.RUNS)
def get_by_id(spark, d):
    return ledger.get_by_id(base.runs(spark, d), "master_job_id", 7).select("master_job_id", "name", "status")


@query("SELECT r.record_uid, r.job_id FROM records r WHERE r.job_id NOT IN (SELECT job_id FROM tasks WHERE status = 'completed')", base.RECORDS, base.TASKS)
def orphans(spark, d):
    return ledger.orphans(base.records(spark, d), at.filter_status(base.tasks(spark, d), "completed"), "job_id", "job_id").select("record_uid", "job_id")


@query("SELECT idx, run_config_hash FROM inputs WHERE run_config_hash NOT IN (SELECT run_config_hash FROM tasks WHERE status = 'completed')", base.INPUTS, base.TASKS)
def pending_inputs(spark, d):
    return ledger.pending_inputs(base.inputs(spark, d), base.tasks(spark, d), F.lit(True))


@query("SELECT idx, run_config_hash FROM inputs WHERE run_config_hash IN (SELECT run_config_hash FROM tasks WHERE status = 'completed')", base.INPUTS, base.TASKS)
def done_inputs(spark, d):
    return ledger.done_inputs(base.inputs(spark, d), base.tasks(spark, d), F.lit(True))


RESTORED = """SELECT i.idx, coalesce(string_agg(CAST(r.quantity AS INTEGER), ',' ORDER BY r.record_uid), '') AS output
  FROM inputs i JOIN (SELECT run_config_hash, min(job_id) AS job_id FROM tasks WHERE status = 'completed' GROUP BY 1) t USING (run_config_hash) LEFT JOIN records r USING (job_id) GROUP BY i.idx"""


def _restore(spark, d):
    rows = base.records(spark, d)
    payload = rows.select("record_uid", F.col("quantity").cast("int").cast("string").alias("payload"))
    return base.inputs(spark, d), base.tasks(spark, d), rows, payload, F.lit(True)


@query(RESTORED, base.INPUTS, base.TASKS, base.RECORDS)
def restore_outputs(spark, d):
    return ledger.restore_outputs(*_restore(spark, d)).select("idx", F.array_join("output", ",").alias("output"))


@query(f"SELECT idx, output, true AS restored FROM ({RESTORED}) UNION ALL SELECT idx, 'new', false FROM inputs WHERE run_config_hash NOT IN (SELECT run_config_hash FROM tasks WHERE status = 'completed')", base.INPUTS, base.TASKS, base.RECORDS)
def resume_run(spark, d):
    again = lambda rows: rows.select("idx", F.array(F.lit("new")).alias("output"))
    return runs_.resume_run(*_restore(spark, d), again).select("idx", F.array_join("output", ",").alias("output"), "restored")


@query("SELECT job_id, CAST(epoch(end_time) - epoch(start_time) AS DOUBLE) AS seconds FROM tasks", base.TASKS)
def task_durations(spark, d):
    return ledger.task_durations(base.tasks(spark, d)).select("job_id", "seconds")


@query("SELECT record_uid, status, CASE WHEN length(record_uid) < 4 THEN 'XX' ELSE substr(record_uid, 1, 2) END AS p1, CASE WHEN length(record_uid) < 4 THEN 'XX' ELSE substr(record_uid, 3, 2) END AS p2 FROM records", base.RECORDS)
def write_records(spark, d):
    path = scratch_path(spark, "records")
    ledger.write_records(base.records(spark, d), path)
    return ledger.read_records(spark, path).select("record_uid", "status", F.col("p1").cast("string").alias("p1"), "p2")


# Topics and plans


@query("SELECT topic, pos, n FROM first_topics", base.TOPICS, base.FIRST_TOPICS)
def first_topics(spark, d):
    return tp.first_topics(base.topics(spark, d))


@query("SELECT pos, topic, CAST(1000 // k + CASE WHEN rn <= 1000 % k THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT *, row_number() OVER (ORDER BY pos) AS rn, count(*) OVER () AS k FROM first_topics) WHERE 1000 // k + CASE WHEN rn <= 1000 % k THEN 1 ELSE 0 END > 0", base.TOPICS, base.FIRST_TOPICS)
def spread_evenly(spark, d):
    return tp.spread_evenly(tp.first_topics(base.topics(spark, d)), 1000).select("pos", "topic", "n")


@query("SELECT pos, topic, n FROM (SELECT pos, topic, CAST(greatest(0, least(30, 500 - 30 * (row_number() OVER (ORDER BY pos) - 1))) AS BIGINT) AS n FROM first_topics) WHERE n > 0", base.TOPICS, base.FIRST_TOPICS)
def fill_topics(spark, d):
    return tp.fill_topics(tp.first_topics(base.topics(spark, d)), 500, 30).select("pos", "topic", "n")


@query("SELECT pos, topic FROM topics WHERE topic NOT IN (SELECT topic FROM topics WHERE pos % 50 = 0)", base.TOPICS)
def new_topics(spark, d):
    rows = base.topics(spark, d)
    return tp.new_topics(rows, rows.filter("pos % 50 = 0")).select("pos", "topic")


@query("SELECT range AS pos, 'auto_topic' || range AS topic FROM range(1, 1000) WHERE range NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0) ORDER BY range LIMIT 20")
def auto_topics(spark, d):
    known = load(spark, d, "nation").filter("n_nationkey % 3 = 0").select(F.concat(F.lit("auto_topic"), F.col("n_nationkey")).alias("topic"))
    return tp.auto_topics(known, 20)


@query("SELECT pos, topic, unnest(range(1, n + 1)) AS k FROM topics WHERE n > 0", base.TOPICS)
def fan_out_topics(spark, d):
    return tp.fan_out_topics(base.topics(spark, d)).select("pos", "topic", "k")


@query("""SELECT kind, pos, topic, n FROM (
  SELECT 'counted' AS kind, pos, topic, n FROM first_topics WHERE n IS NOT NULL UNION ALL
  SELECT 'text', pos, topic, CAST(r // k + CASE WHEN rn <= r % k THEN 1 ELSE 0 END AS BIGINT) FROM (SELECT pos, topic, row_number() OVER (ORDER BY pos) AS rn, count(*) OVER () AS k, 2000 - (SELECT coalesce(sum(n), 0) FROM first_topics) AS r FROM first_topics WHERE n IS NULL)
) WHERE n > 0""", base.TOPICS, base.FIRST_TOPICS)
def plan_topics(spark, d):
    rows = base.topics(spark, d)
    return tp.plan_topics(rows, rows.select("pos", F.concat("topic", F.lit("x")).alias("topic")), 2000, 5)


@query("SELECT c_nationkey, slice, string_agg(topic, ',' ORDER BY pos) AS exclude FROM (SELECT c_nationkey, c_custkey AS pos, c_name AS topic, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 50 AS slice FROM customer) GROUP BY c_nationkey, slice")
def exclude_text(spark, d):
    return tp.exclude_text(load(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("pos"), F.col("c_name").alias("topic")), ["c_nationkey"], 50)


def _values(spark, d):
    return load(spark, d, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("idx"), F.concat_ws("-", "lang", "n_chars").alias("value"))


VALUES = "vals AS (SELECT source AS topic, doc_id AS idx, lang || '-' || n_chars AS value FROM documents)"


@query("SELECT topic, slice, string_agg(value, '|' ORDER BY idx) AS history FROM (SELECT *, (row_number() OVER (PARTITION BY topic ORDER BY idx) - 1) // 200 AS slice FROM vals) GROUP BY topic, slice", VALUES)
def topic_history(spark, d):
    return tp.topic_history(_values(spark, d), 200).select("topic", "slice", F.array_join("history", "|").alias("history"))


@query("""SELECT a.topic, a.idx, a.value, b.value AS example FROM ranked a LEFT JOIN ranked b ON a.topic = b.topic AND a.rk > 1
  AND b.rk = CAST('0x' || substr(md5(a.idx || '-0'), 1, 8) AS BIGINT) % greatest(a.rk - 1, 1) + 1""", VALUES, "ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY idx) AS rk FROM vals)")
def earlier_example(spark, d):
    return tp.earlier_example(_values(spark, d))


@query("SELECT o_orderkey, CAST(unnest(list_transform(range(0, CAST(ceil((o_orderkey % 23) / 5.0) AS BIGINT)), lambda i: least(5, o_orderkey % 23 - 5 * i))) AS INTEGER) AS want FROM orders WHERE o_orderkey % 23 > 0")
def topic_batches(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.explode(tp.topic_batches(F.col("o_orderkey") % 23)).alias("want"))


@query("""SELECT target, CAST(CASE WHEN target <= 10 THEN 1 ELSE a END AS INTEGER) AS topics, CAST(CASE WHEN target <= 10 THEN 1 ELSE rest // a END AS INTEGER) AS subtopics, CAST(CASE WHEN target <= 10 THEN target ELSE r END AS INTEGER) AS records,
  CAST(CASE WHEN target <= 10 THEN 3 ELSE 1 + a + rest END AS INTEGER) AS api_calls FROM (
  SELECT *, list_max(list_filter(range(1, CAST(floor(sqrt(rest)) AS BIGINT) + 1), lambda x: rest % x = 0)) AS a FROM (
  SELECT *, target // r AS rest FROM (SELECT target, list_max(list_filter(range(1, 11), lambda x: target % x = 0)) AS r FROM (SELECT DISTINCT o_custkey % 3000 + 1 AS target FROM orders))))""")
def plan_distribution(spark, d):
    return load(spark, d, "orders").select((F.col("o_custkey") % 3000 + 1).alias("target")).distinct().withColumns(tp.plan_distribution(F.col("target")))


# Text


PATH = "CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN 'https://www.youtube.com/watch?v=id' || page_id || '&t=1' WHEN 2 THEN '/data/file' || page_id || '.PDF' WHEN 3 THEN 'notes' || page_id || '.txt' WHEN 4 THEN 'x' || page_id || '.bin' WHEN 5 THEN 'https://youtu.be/v' || page_id || '?t=2#x' ELSE 'https://files.example.com/f/' || page_id || '.docx?v=' || page_id END"


def _paths(spark, d):
    return load(spark, d, "pages").select("page_id", F.expr(PATH).alias("path"))


ROUTES = " ".join(f"WHEN contains(path, '{part}') THEN '{name}'" for part, name in text.URL_ROUTES)
NAME = r"""CASE WHEN regexp_matches(path, '^https?://') AND regexp_matches(path, 'youtube\.com|youtu\.be') THEN 'youtube_' || regexp_extract(path, '(?:v=|\.be/)([^&]+)', 1) WHEN regexp_matches(path, '^https?://') THEN replace(regexp_extract(path, '^https?://([^/?#]*)', 1), '.', '_')
  ELSE regexp_extract(path, '([^/.]+)\.[^./]*$', 1) END || '.txt'"""


@query(f"""SELECT page_id, CASE WHEN regexp_matches(path, '^https?://') THEN CASE {ROUTES} ELSE 'html' END
  ELSE CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.pdf' THEN 'pdf' WHEN '.txt' THEN 'txt' ELSE 'unsupported' END END AS route FROM (SELECT page_id, {PATH} AS path FROM pages)""")
def route_documents(spark, d):
    return _paths(spark, d).select("page_id", text.route_documents(F.col("path")).alias("route"))


@query(f"SELECT page_id, {NAME} AS name FROM (SELECT page_id, {PATH} AS path FROM pages)")
def output_name(spark, d):
    return _paths(spark, d).select("page_id", text.output_name(F.col("path")).alias("name"))


# Every page with a description, a type and another charset in turn, in either order of attributes and either kind of quotes.
HEAD = r"""replace(replace(html, '<meta charset="utf-8">', CASE page_id % 3 WHEN 0 THEN "<meta charset='utf-8'>" WHEN 1 THEN '<meta http-equiv="x" content="text/html; charset=latin-1">' ELSE '' END),
  '</title>', '</title><meta ' || CASE page_id % 2 WHEN 0 THEN 'name="description" content="about > ' || page_id || '">' ELSE "content='about > " || page_id || "' name='Description'>" END || CASE WHEN page_id % 5 = 0 THEN '<META content=article property="og:type">' ELSE '' END)"""
META = """SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, 'about > ' || page_id AS description, CASE WHEN page_id % 5 = 0 THEN 'article' END AS type,
  CASE page_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'latin-1' END AS charset, nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '') AS domain, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages"""


@query(META)
def html_meta(spark, d):
    pages = load(spark, d, "pages").withColumn("html", F.expr(HEAD))
    return pages.select("page_id", *[c.alias(k) for k, c in text.html_meta(F.col("html"), F.col("url")).items()])


# Scripts, styles, comments and tags go (an unfinished one at the end, too), then the entities that the pages use.
PAGE_TEXT = "html"
for _pattern in ("(?is)<(script|style)[^>]*>.*?</(script|style)>", "(?s)<!--.*?-->", "(?s)<[a-zA-Z/!][^>]*(>|$)"):
    PAGE_TEXT = f"regexp_replace({PAGE_TEXT}, '{_pattern}', '', 'g')"
for _entity, _sign in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    PAGE_TEXT = f"replace({PAGE_TEXT}, '{_entity}', '{_sign}')"
PAGE_TEXT = f"array_to_string(list_filter(list_transform(flatten(list_transform(string_split({PAGE_TEXT}, chr(10)), lambda line: string_split(trim(line), '  '))), lambda x: trim(x)), lambda x: x <> ''), chr(10))"


@query(f"SELECT page_id, title, domain, text FROM (SELECT page_id, md5({PAGE_TEXT}) AS text FROM pages) JOIN ({META}) USING (page_id)")
def read_html_pages_(spark, d):
    return read_html_pages(load(spark, d, "pages")).select("page_id", "title", "domain", F.md5("text").alias("text"))


QUERIES["read_html_pages"] = QUERIES.pop("read_html_pages_")
ORACLE_SQL["read_html_pages"] = ORACLE_SQL.pop("read_html_pages_")


@query(f"SELECT page_id, {PAGE_TEXT} AS text FROM pages")
def html_to_text(spark, d):
    return load(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


TOKENS = """chunks AS (SELECT doc_id, unnest(range(0, k)) AS pos, toks FROM (SELECT doc_id, toks, greatest(1, CAST(ceil((len(toks) - 400) / 380.0) AS BIGINT) + 1) AS k
  FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '')))"""


@query("SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(array_to_string(toks[pos * 380 + 1:pos * 380 + 400], ' ')) AS chunk FROM chunks", TOKENS)
def split_tokens(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(text.split_tokens(F.col("text"))).alias("pos", "chunk")).withColumn("chunk", F.md5("chunk"))


#: A public vocabulary of byte-pair ranks and the pattern that cuts its texts first.
RANKS, RANKS_PATTERN = "/opt/tokenizers/byte_bpe_50k.tiktoken", r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@query()
def split_bpe(spark, d):
    windows = bpe.split_bpe(spark, F.col("text"), RANKS, RANKS_PATTERN)
    return load(spark, d, "documents").select("doc_id", F.posexplode(windows).alias("pos", "w")).select("doc_id", "pos", "w.n_tokens", F.md5("w.chunk").alias("chunk"))


# The same packing as a fold in SQL: state and paragraphs have one type there.
_TAIL = r"trim(list_reduce(list_prepend({'t': '', 'x': false}, list_transform(list_reverse(list_filter(string_split(regexp_replace(a.held, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')), lambda s: {'t': s, 'x': false})), lambda b, s: CASE WHEN NOT b.x AND length(b.t) + length(s.t) <= 20 THEN {'t': s.t || ' ' || b.t, 'x': false} ELSE {'t': b.t, 'x': true} END).t)"
PACKED = rf"""packed AS (SELECT doc_id, CASE WHEN s.held <> '' AND length(s.held) >= 100 THEN list_append(s.chunks, s.held) ELSE s.chunks END AS chunks FROM (
  SELECT doc_id, list_reduce(list_prepend({{'chunks': CAST([] AS VARCHAR[]), 'held': ''}}, list_transform(list_filter(string_split_regex(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '^\s+|\s+$', '', 'g'), '\n{{2,}}'), lambda p: regexp_matches(p, '\S')), lambda p: {{'chunks': CAST([] AS VARCHAR[]), 'held': p}})),
    lambda a, p: CASE WHEN a.held = '' THEN {{'chunks': a.chunks, 'held': p.held}} WHEN length(a.held) + length(p.held) > 400 AND length(a.held) >= 100 THEN {{'chunks': list_append(a.chunks, a.held), 'held': {_TAIL} || chr(10) || chr(10) || p.held}}
      ELSE {{'chunks': a.chunks, 'held': a.held || chr(10) || chr(10) || p.held}} END) AS s FROM documents WHERE text IS NOT NULL))"""


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, md5(chunks[i]) AS chunk FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM packed)", PACKED)
def split_paragraphs(spark, d):
    spread = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return load(spark, d, "documents").select("doc_id", F.posexplode(text.split_paragraphs(spread)).alias("pos", "chunk")).withColumn("chunk", F.md5("chunk"))


@query("SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5('Write ' || greatest(1, CAST(round_even(8.0 / (count(*) OVER (PARTITION BY doc_id)), 0) AS INTEGER)) || ' question and answer pairs about this text:' || chr(10) || array_to_string(toks[pos * 380 + 1:pos * 380 + 400], ' ')) AS prompt FROM chunks", TOKENS)
def qa_prompts(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(text.qa_prompts(text.split_tokens(F.col("text")), 8)).alias("pos", "prompt")).withColumn("prompt", F.md5("prompt"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN quality = 0 THEN 'low quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), '; ') AS reason FROM labels")
def join_reasons(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("quality") == 0, "low quality"), F.when(F.col("toxic") == 1, "toxic")))
    return load(spark, d, "labels").select("doc_id", text.join_reasons(reasons).alias("reason"))


# Prompts


@query("""SELECT c_custkey, 'Write about ' || c_name || CASE WHEN c_acctbal > 0 THEN ' in ' || c_mktsegment || '.' ELSE '.' END || chr(10) || 'Return exactly 3 records as JSON of this form:' || chr(10) || '[]' AS prompt FROM customer""")
def render_prompt(spark, d):
    rows = load(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    return prompts.render_prompt(rows, "Write about {name}{% if segment %} in {{ segment }}.{% else %}.{% endif %}", "[]", num_records=3).select("c_custkey", "prompt")


@query("""SELECT c_custkey, 'You write records of synthetic data.' || chr(10) || 'Task: about ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'Keep to the topic ' || c_mktsegment || '.' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'Records should be as good as these: ["' || c_name || '"]' ELSE '' END
  || chr(10) || 'Let no two records be alike.' || chr(10) || 'Return exactly 1 records as JSON of this form:' || chr(10) || '[]' AS prompt FROM customer""")
def render_preset(spark, d):
    rows = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("about "), "c_name").alias("user_instruction"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("topic"), F.when(F.col("c_custkey") % 3 == 0, F.array("c_name")).otherwise(F.array().cast("array<string>")).alias("good_examples"))
    return prompts.render_prompt(rows, prompts.complete_preset("data_gen"), "[]").select("c_custkey", "prompt")


@query("""SELECT c_custkey, 'Write about ' || c_name || chr(10) || 'Return exactly 1 records as JSON of this form:' || chr(10) || '[
    {
    "question": ""  // what is asked (required),
    "tags": [  //  (optional)
      // Example items of type string
    ],
    "source": {  // where from (required)
      "page": number  //  (required)
    }
    }
    ...
]

Required fields: question, source' AS prompt FROM customer""")
def render_schema(spark, d):
    fields = [{"name": "question", "type": "str", "description": "what is asked"}, {"name": "tags", "type": "list", "items": {"type": "str"}, "required": False}, {"name": "source", "type": "dict", "description": "where from", "properties": [{"name": "page", "type": "int"}]}]
    return prompts.render_prompt(load(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")), "Write about {name}", fields).select("c_custkey", "prompt")


@query("""SELECT n_regionkey, 'Describe <names>' || '["' || string_agg(n_name, '","' ORDER BY n_name) || '"]</names>' || chr(10) || 'The list names has exactly ' || count(*) || ' elements. Return a JSON array of exactly ' || count(*) || ' results, in the same order, of this form:' || chr(10) || '[]' AS prompt FROM nation GROUP BY n_regionkey""")
def render_list_prompt(spark, d):
    rows = load(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return prompts.render_list_prompt(rows, "Describe {names}", "names", "[]").select("n_regionkey", "prompt")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS n, md5(text) AS last FROM conversations WHERE text IS NOT NULL")
def chat_messages(spark, d):
    rows = load(spark, d, "conversations").filter("text is not null")
    messages = prompts.chat_messages(F.col("text"), F.when(F.col("turn") % 2 == 0, "Be brief.").otherwise(""))
    return rows.select("conv_id", "turn", messages.alias("m")).select("conv_id", "turn", F.size("m").alias("n"), F.md5(F.element_at("m", -1)["content"]).alias("last"))


# JSON


R = base.REPLIES
FOUND = """CASE WHEN idx % 5 IN (0, 1, 2) THEN props WHEN idx % 5 = 3 THEN reply END"""


@query(f"SELECT idx, {FOUND} AS found FROM replies", R)
def extract_json(spark, d):
    return base.replies(spark, d).select("idx", jsonx.extract_json(F.col("reply")).alias("found"))


@query("SELECT idx, CASE WHEN idx % 5 IN (0, 1, 2) THEN props WHEN idx % 5 = 3 THEN reply END AS found FROM replies", R)
def extract_json_loose(spark, d):
    amid = F.when(F.col("idx") % 5 == 3, F.concat(F.lit("Items "), "reply", F.lit(" as {asked)"))).otherwise(F.col("reply"))
    return base.replies(spark, d).select("idx", jsonx.extract_json_loose(amid).alias("found"))


# Each event's type and number in JSON that is broken in one of six ways, one of them beyond repair.
@query("SELECT idx, CASE WHEN idx % 6 < 5 THEN event_type || CASE idx % 6 WHEN 1 THEN ' \\le' WHEN 2 THEN chr(10) || 'next' WHEN 3 THEN ' \\a' || chr(9) || 't' ELSE '' END END AS name, CASE WHEN idx % 6 < 4 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM replies", R)
def repair_json(spark, d):
    rows = load(spark, d, "events").select(F.col("event_id").alias("idx"), "event_type", "props")
    kind, k = F.col("idx") % 6, F.get_json_object(F.col("props"), "$.k")
    name = F.concat("event_type", F.when(kind == 1, " \\le").when(kind == 2, "\nnext").when(kind == 3, " \\a\tt").otherwise(""))
    broken = F.concat(F.lit('{"name": "'), name, F.lit('", "k": '), F.when(kind == 4, "NaN").when(kind == 5, "}").otherwise(k), F.lit("}"))
    mended = F.try_parse_json(jsonx.repair_json(broken))
    return rows.select("idx", F.try_variant_get(mended, "$.name", "string").alias("name"), F.try_variant_get(mended, "$.k", "bigint").alias("k"))


@query("SELECT idx, CASE WHEN idx % 5 = 3 THEN 2 WHEN idx % 5 = 0 THEN 1 END AS n FROM replies", R)
def unwrap_json(spark, d):
    return base.replies(spark, d).select("idx", F.size(jsonx.unwrap_json(F.try_parse_json("reply"))).alias("n"))


FIELDS = [{"name": "k", "type": "int"}, {"name": "other", "type": "str", "required": False}]


@query("SELECT idx, CASE WHEN idx % 5 = 3 THEN '0: type: k is string' WHEN idx % 5 = 0 THEN '' END AS errors FROM replies", R)
def validate_items(spark, d):
    return base.replies(spark, d).select("idx", F.array_join(jsonx.validate_items(jsonx.unwrap_json(F.try_parse_json("reply")), FIELDS, True), "; ").alias("errors"))


@query("SELECT idx, CASE WHEN idx % 5 = 4 THEN 'failed' ELSE 'ok' END AS parse_status, CASE WHEN idx % 5 = 4 THEN 'no JSON found' END AS parse_error, CASE WHEN idx % 5 = 3 THEN 2 WHEN idx % 5 <> 4 THEN 1 END AS n FROM replies", R)
def parse_replies(spark, d):
    return jsonx.parse_replies(base.replies(spark, d), "reply", FIELDS).select("idx", "parse_status", "parse_error", F.size("data").alias("n"))


@query("SELECT idx, CASE WHEN idx % 5 = 4 THEN NULL WHEN idx % 5 = 3 THEN event_type ELSE CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS k FROM replies", R)
def parse_typed(spark, d):
    struct = T.StructType([T.StructField("k", T.StringType())])
    return jsonx.parse_typed(base.replies(spark, d), "reply", struct, ["k"]).select("idx", F.get("typed", F.lit(0))["k"].alias("k"))


CONTRACT = {"name": "get_weather", "description": "weather", "parameters": {"location": {"type": "string", "required": True}, "days": {"type": "integer", "required": False}}}


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'missing parameters: location' WHEN 2 THEN 'unknown parameters: x' WHEN 3 THEN 'name differs from the contract' WHEN 4 THEN 'days should be integer' WHEN 5 THEN 'arguments is no object' ELSE '' END AS reasons, c_custkey % 6 = 0 AS format_ok FROM customer""")
def check_calls(spark, d):
    rows = load(spark, d, "customer").select("c_custkey", F.col("c_name").alias("query"), (F.col("c_custkey") % 6).alias("k"))
    args = F.when(F.col("k") == 1, '{"days": 2}').when(F.col("k") == 2, '{"location": "a", "x": 1}').when(F.col("k") == 4, '{"location": "a", "days": "two"}').when(F.col("k") == 5, "[1]").otherwise('{"location": "a", "days": 2}')
    answer = F.concat(F.lit('[{"name": "'), F.when(F.col("k") == 3, "other").otherwise(" get_weather "), F.lit('", "arguments": '), args, F.lit("}]"))
    return jsonx.check_calls(rows.withColumn("answer", answer), "query", "answer", CONTRACT).select("c_custkey", F.array_join("reasons", "; ").alias("reasons"), "format_ok")


@query("SELECT idx, CASE WHEN idx % 5 = 0 THEN 'a' WHEN idx % 5 IN (1, 2) THEN 'a,b' END AS missing, CASE WHEN idx % 5 = 0 THEN 'c' WHEN idx % 5 IN (1, 2) THEN 'k' END AS unknown FROM replies", R)
def missing_params(spark, d):
    rows = base.replies(spark, d)
    given = F.when(F.col("idx") % 5 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.json_object_keys(jsonx.extract_json(F.col("reply"))))
    return rows.select("idx", *[F.array_join(c, ",").alias(k) for k, c in jsonx.missing_params(given, ["a", "b"], ["a", "b"]).items()])


# Running


def _cities(df: DataFrame, key: str, parts: int) -> DataFrame:
    return df.select(F.col(key).alias("idx"), F.concat(F.lit("c"), (F.col(key) % parts).cast("string")).alias("city"))


# A city's generator fails or answers by its name; the same answer twice is a duplicate, one in ten inputs is filtered; all of these are tried three times.
_FAILS = base.sql_bucket("'c' || (c_custkey % 400) || '-0'", 100) + " < 10"
RUN = f"""SELECT idx, status, n, CAST(unnest(range(1, CASE status WHEN 'completed' THEN 2 ELSE 4 END)) AS INTEGER) AS attempt FROM (
  SELECT idx, CASE WHEN fails THEN 'failed' WHEN idx > first THEN 'duplicate' WHEN {base.sql_bucket("'f' || idx", 10)} = 0 THEN 'filtered' ELSE 'completed' END AS status, CASE WHEN NOT fails THEN items END AS n
  FROM (SELECT c_custkey AS idx, min(c_custkey) OVER (PARTITION BY c_custkey % 400) AS first, {_FAILS} AS fails, {base.sql_bucket("'c' || (c_custkey % 400) || '-0-n'", 3)} + 1 AS items FROM customer))"""


@query(RUN)
def run_records(spark, d):
    hooks = [runs_.seen_before(F.get("output", F.lit(0))["answer"]), runs_.drop_if(base.bucket(F.concat(F.lit("f"), "idx"), 10) == 0)]
    got = runs_.run_records(_cities(load(spark, d, "customer"), "c_custkey", 400), offline.answers, "answer string", hooks=hooks)
    return got.select("idx", "status", F.size("output").alias("n"), "attempt")


# Waves of about 40 inputs in the order of their numbers, until 100 have completed.
@query(f"""SELECT idx, status FROM (SELECT *, sum(done) OVER (ORDER BY wave) - done_in AS before FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY wave ORDER BY idx) = 1 THEN done_in ELSE 0 END AS done FROM (SELECT *, count(*) FILTER (status = 'completed') OVER (PARTITION BY wave) AS done_in FROM (
  SELECT c_custkey AS idx, CASE WHEN {_FAILS} THEN 'failed' ELSE 'completed' END AS status, (c_custkey - low) // greatest(1, (high - low + 1) * 40 // total) AS wave FROM customer, (SELECT min(c_custkey) AS low, max(c_custkey) AS high, count(*) AS total FROM customer))))) WHERE before < 100""")
def run_to_target(spark, d):
    got = runs_.run_records(_cities(load(spark, d, "customer"), "c_custkey", 400), offline.answers, "answer string", threshold=1, target=100, wave=40)
    return got.select("idx", "status")


@query(f"""SELECT idx, status, CAST(CASE WHEN status = 'completed' THEN 1 ELSE 0 END AS BIGINT) AS completed, CAST(CASE WHEN status = 'filtered' THEN 3 ELSE 0 END AS BIGINT) AS filtered,
    CAST(CASE WHEN status = 'duplicate' THEN 3 ELSE 0 END AS BIGINT) AS duplicate, CAST(CASE WHEN status = 'failed' THEN 3 ELSE 0 END AS BIGINT) AS failed, CASE WHEN status = 'failed' THEN 'offline failure' END AS error_message,
    CAST(CASE status WHEN 'completed' THEN n WHEN 'failed' THEN 3 ELSE 3 * n END AS BIGINT) AS n_records, CAST(CASE WHEN status = 'completed' THEN n ELSE 0 END AS BIGINT) AS n_payload
  FROM (SELECT DISTINCT idx, status, n FROM ({RUN}))""")
def run_ledger(spark, d):
    hooks = [runs_.seen_before(F.get("output", F.lit(0))["answer"]), runs_.drop_if(base.bucket(F.concat(F.lit("f"), "idx"), 10) == 0)]
    tables = ledger.run_ledger(runs_.run_records(_cities(load(spark, d, "customer"), "c_custkey", 400), offline.answers, "answer string", hooks=hooks))
    stored = tables["records"].join(tables["payload"], "record_uid", "left").groupBy("job_id").agg(F.count("*").alias("n_records"), F.count("payload").alias("n_payload"))
    return tables["tasks"].join(stored, "job_id").select("idx", "status", *ledger.COUNTERS, "error_message", "n_records", "n_payload")


# A session that stops at 100 completed inputs, and one that goes on without a target; what the first one saw is a duplicate in the second.
@query(f"""SELECT idx, CASE WHEN fails THEN 'failed' WHEN idx > first THEN 'duplicate' ELSE 'completed' END AS status
  FROM (SELECT c_custkey AS idx, min(c_custkey) OVER (PARTITION BY c_custkey % 400) AS first, {_FAILS} AS fails FROM customer)""")
def continue_run(spark, d):
    path, hooks = scratch_path(spark, "continued"), [runs_.seen_before(F.get("output", F.lit(0))["answer"])]
    runs_.start_run(_cities(load(spark, d, "customer"), "c_custkey", 400), offline.answers, "answer string", path, hooks, threshold=1, target=100, wave=40)
    return runs_.continue_run(spark, path, offline.answers, hooks, target=0).select("idx", "status")


QA = [{"name": "question", "type": "str"}, {"name": "answer", "type": "str"}]


@query("SELECT doc_id, 'ok' AS parse_status, 'q-' || substr(md5('Write about ' || lang || ' of ' || n_chars), 1, 8) AS question FROM documents")
def ask_model(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.concat(F.lit("Write about "), "lang", F.lit(" of "), "n_chars").alias("prompt"))
    return runs_.ask_model(rows, "prompt", QA, offline.echo).select("doc_id", "parse_status", F.try_variant_get(F.get("data", F.lit(0)), "$.question", "string").alias("question"))


@query("SELECT topic, n + 1 AS n FROM first_topics WHERE n IS NOT NULL", base.TOPICS, base.FIRST_TOPICS)
def chain(spark, d):
    return runs_.chain(base.topics(spark, d), tp.first_topics, lambda t: t.filter("n is not null"), lambda t: t.select("topic", (F.col("n") + 1).alias("n")))


@query("SELECT count(*) FILTER (status = 'completed') + 10 AS done, CAST(sum(len(output)) AS BIGINT) AS items FROM attempts", A)
def fold_state(spark, d):
    return runs_.fold_state(base.attempts(spark, d), {"done": F.count_if(F.col("status") == "completed"), "items": F.sum(F.size("output"))}, {"done": 10}).select("done", "items")


def _stream(spark, d, name):
    # A pattern, as a plain path must be a folder and a table may be one file.
    return spark.readStream.schema(load(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_progress(spark, d):
    root = scratch_path(spark, "progress")
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    streams.stream_progress(events, f"{root}/out", f"{root}/checkpoint", width="6 hours", time="ts", status="event_type", late="1 day")
    return spark.read.parquet(f"{root}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# Composite jobs


@query("SELECT doc_id, CAST(pos AS INTEGER) AS chunk, 0 AS pos, 'q' || (length(array_to_string(toks[pos * 380 + 1:pos * 380 + 400], ' ')) + 51) AS question FROM chunks", TOKENS)
def document_qa(spark, d):
    return templates.document_qa(load(spark, d, "documents").select("doc_id", "text"), offline.model).select("doc_id", "chunk", "pos", "question")


# Records in the order of md5; a second-round one shows an item of the first round of its topic, drawn by md5.
TOPIC_ROWS = """planned AS (SELECT topic, n FROM first_topics WHERE n IS NOT NULL),
keyed AS (SELECT topic, k, topic || '-' || k AS key FROM (SELECT topic, unnest(range(1, n + 1)) AS k FROM planned)),
placed AS (SELECT topic, k, row_number() OVER (ORDER BY md5(key || '-0'), key) AS idx FROM keyed),
round1 AS (SELECT topic, idx, substr(md5('Write about ' || topic || '.'), 1, 8) AS said, row_number() OVER (PARTITION BY topic ORDER BY idx) AS rk, count(*) OVER (PARTITION BY topic) AS n FROM placed WHERE k % 2 = 1),
round2 AS (SELECT p.topic, p.idx, '{"question":"q-' || r.said || '","answer":"a-' || r.said || '"}' AS example FROM placed p JOIN round1 r ON p.topic = r.topic AND p.k % 2 = 0 AND r.rk = CAST('0x' || substr(md5(p.idx || '-0'), 1, 8) AS BIGINT) % r.n + 1)"""


@query("""SELECT idx, topic, NULL AS example, CAST(0 AS INTEGER) AS pos, 'q-' || said AS question, 'a-' || said AS answer FROM round1 UNION ALL
  SELECT idx, topic, example, 0, 'q-' || said, 'a-' || said FROM (SELECT *, substr(md5('Write about ' || topic || '. Unlike ' || example || '.'), 1, 8) AS said FROM round2)""", base.TOPICS, base.FIRST_TOPICS, TOPIC_ROWS)
def generate_by_topic(spark, d):
    plan = tp.first_topics(base.topics(spark, d)).filter("n is not null")
    return templates.generate_by_topic(plan, "Write about {topic}.{% if example %} Unlike {example}.{% endif %}", QA, offline.echo)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents -> chunks -> prompts -> offline model -> parsed replies -> hooks -> run summary."""
    docs = load(spark, d, "documents").select("doc_id", "text", "source")
    answers = templates.document_qa(docs, offline.model)
    rows = answers.join(load(spark, d, "labels"), "doc_id", "left").join(docs.select("doc_id", "source"), "doc_id")
    order = F.col("doc_id") * 10_000 + F.col("chunk")
    marked = at.mark_duplicates(rows.withColumn("idx", order), ["question"]).withColumn("status", F.lit("completed"))
    hooked = at.apply_hooks(marked, [F.col("duplicate")], [F.col("quality") == 0])
    return at.run_summary(hooked.withColumnRenamed("source", "run_id"))


@query("""SELECT run_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'filtered') AS filtered, CAST(0 AS BIGINT) AS failed, count(*) AS total, CAST(0 AS BIGINT) AS dead_letters FROM (
  SELECT d.source AS run_id, CASE WHEN q.idx > min(q.idx) OVER (PARTITION BY q.n) THEN 'duplicate' WHEN coalesce(l.quality = 0, false) THEN 'filtered' ELSE 'completed' END AS status
  FROM (SELECT doc_id, doc_id * 10000 + pos AS idx, length(array_to_string(toks[pos * 380 + 1:pos * 380 + 400], ' ')) AS n FROM chunks) q JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)) GROUP BY run_id""", TOKENS)
def curate_documents(spark, d):
    return flagship(spark, d)


# Files and snapshots


@query(f"SELECT {NAME} AS name, md5(text) AS text FROM (SELECT {PAGE_TEXT} AS text, {PATH} AS path FROM pages)")
def write_documents(spark, d):
    path = scratch_path(spark, "texts")
    pages = _paths(spark, d).join(load(spark, d, "pages").select("page_id", "html"), "page_id")
    files.write_documents(pages.select(text.output_name(F.col("path")).alias("name"), text.html_to_text(F.col("html")).alias("text")), path)
    return spark.read.parquet(path).select("name", F.md5("text").alias("text"))


@query("SELECT o_orderkey AS idx, o_orderstatus AS status, 'orders' AS source FROM orders")
def save_run_snapshot(spark, d):
    path = scratch_path(spark, "snapshot")
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("status"))
    ledger.save_run_snapshot(rows, {"source": "orders"}, path)
    back, config = ledger.load_run_snapshot(spark, path)
    return back.withColumn("source", F.lit(config["source"]))


@query("SELECT c_custkey AS master_job_id, CASE WHEN o.n IS NULL THEN r.status ELSE 'completed' END AS status, o.stop AS end_time, coalesce(o.n, c_custkey % 11) AS completed FROM (SELECT master_job_id AS c_custkey, status FROM runs) r LEFT JOIN (SELECT master_job_id AS c_custkey, count(*) AS n, max(end_time) AS stop FROM tasks WHERE status = 'completed' GROUP BY 1) o USING (c_custkey)", base.RUNS, base.TASKS)
def close_run(spark, d):
    done = at.filter_status(base.tasks(spark, d), "completed").groupBy("master_job_id").agg(F.max("end_time").alias("end_time"), F.count("*").alias("completed")).withColumn("status", F.lit("completed"))
    open_runs = base.runs(spark, d).select("master_job_id", "status", F.lit(None).cast("timestamp_ntz").alias("end_time"), (F.col("master_job_id") % 11).alias("completed"))
    return ledger.close_rows(open_runs, done, "master_job_id", ["completed"])


# Streams over the given tables


def _worked_off(stream: DataFrame, step=lambda batch: batch) -> DataFrame:
    root = scratch_path(stream.sparkSession, "stream")
    streams.stream_run(stream, step, f"{root}/out", f"{root}/checkpoint")
    return stream.sparkSession.read.parquet(f"{root}/out").drop("batch")


_CITY = "'c' || (event_id % 300) || '-0"


@query(f"""SELECT event_id AS idx, CASE WHEN {base.sql_bucket(_CITY + "'", 100)} < 10 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN {base.sql_bucket(_CITY + "'", 100)} >= 10 THEN {base.sql_bucket(_CITY + "-n'", 3)} + 1 END AS n FROM events""")
def stream_run(spark, d):
    run = lambda batch: runs_.run_records(_cities(batch, "event_id", 300), offline.answers, "answer string", threshold=1)
    return _worked_off(_stream(spark, d, "events"), run).select("idx", "status", F.size("output").alias("n"))


def _arriving(df: DataFrame, step, parts: int = 5) -> DataFrame:
    """What a stream gives whose rows arrive in `parts` portions, in the order of idx, one batch for each."""
    spark, root = df.sparkSession, scratch_path(df.sparkSession, "stream")
    low, high = df.agg(F.min("idx"), F.max("idx")).first()
    for i in range(parts):
        edge = [low + (high + 1 - low) * k // parts for k in (i, i + 1)]
        df.filter(F.col("idx").between(edge[0], edge[1] - 1)).write.parquet(f"{root}/waiting/{i}")
    make_folder(spark, f"{root}/in")
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    with streams.rocks_db(spark), streams.running(step(source), f"{root}/out", f"{root}/checkpoint") as stream:
        for i in range(parts):
            move(spark, f"{root}/waiting/{i}", f"{root}/in/{i}")  # a whole portion appears at once
            stream.processAllAvailable()
    return spark.read.parquet(f"{root}/out")


@query("SELECT doc_id AS idx, doc_id > min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents")
def stream_mark_duplicates(spark, d):
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.md5("text").alias("key"))
    return _arriving(rows, lambda source: streams.stream_mark_duplicates(source, ["key"])).select("idx", "duplicate")


@query("SELECT topic, slice, string_agg(value, '|' ORDER BY idx) AS history FROM (SELECT *, (row_number() OVER (PARTITION BY topic ORDER BY idx) - 1) // 200 AS slice FROM vals) GROUP BY topic, slice", VALUES)
def stream_topic_memory(spark, d):
    slices = _arriving(_values(spark, d), lambda source: streams.stream_topic_memory(source, 200))
    return streams.latest_slices(slices).select("topic", "slice", F.array_join("history", "|").alias("history"))


@query("SELECT source AS topic, count(*) AS n, count(*) - 1 AS longest, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS looked_back, bit_xor(doc_id) AS ids FROM documents GROUP BY source")
def stream_topic_places(spark, d):
    got = _arriving(_values(spark, d), streams.stream_topic_places)
    return got.groupBy("topic").agg(F.count("*").alias("n"), F.max("earlier").alias("longest"), F.sum("earlier").alias("looked_back"), F.bit_xor("idx").alias("ids"))


# Composite jobs with a scripted model


def _brands(spark, d):
    return load(spark, d, "part").select(F.col("p_brand").alias("topic")).distinct()


BRANDS = "brands AS (SELECT DISTINCT p_brand AS topic FROM part)"
SUBTOPICS = "subs AS (SELECT topic, topic || ' ' || part || '-' || unnest(range(0, CASE part WHEN 0 THEN 5 ELSE 2 END)) AS subtopic FROM brands, (SELECT unnest([0, 1]) AS part))"


@query("SELECT topic, subtopic FROM subs", BRANDS, SUBTOPICS)
def subtopics(spark, d):
    return templates.subtopics(_brands(spark, d), 7, offline.scripted)


# The calls about one subtopic in three lack their parameter at first and are mended, knowing why.
CALLS = f"""calls AS (SELECT topic, subtopic, 0 AS pos, 'where is ' || subtopic AS query, true AS ok, '[{{"arguments":{{"location":"' || CASE WHEN {base.sql_bucket("subtopic", 3)} = 0 THEN 'mended ' ELSE '' END || subtopic || '"}},"name":"get_weather"}}]' AS answer FROM subs)"""


@query("SELECT topic, subtopic, query, ok, answer FROM (SELECT *, subtopic || '-' || pos || '-' || query AS key FROM calls) ORDER BY md5(key || '-0'), key LIMIT 100", BRANDS, SUBTOPICS, CALLS)
def function_call_dataset(spark, d):
    return templates.function_call_dataset(_brands(spark, d), CONTRACT, offline.scripted, 100, 7).select("topic", "subtopic", "query", "ok", "answer")


@query(f"""SELECT topic, problem, CASE WHEN bad THEN 'mended' ELSE 'good ' || i END AS answer FROM (SELECT topic, i, topic || '/' || i AS problem, {base.sql_bucket("topic || '/' || i", 2)} = 1 AS bad FROM brands, (SELECT unnest([0, 1]) AS i)) WHERE NOT bad OR {base.sql_bucket("problem || '-again'", 4)} <> 0""", BRANDS)
def verified_reasoning(spark, d):
    return templates.verified_reasoning(_brands(spark, d), offline.scripted).select("topic", "problem", "answer")


# Round trips through files


@query("SELECT record_uid, status FROM records WHERE starts_with(record_uid, '101') AND length(record_uid) >= 4", base.RECORDS)
def read_records(spark, d):
    path = scratch_path(spark, "records")
    ledger.write_records(base.records(spark, d), path)
    return ledger.read_records(spark, path, "101").select("record_uid", "status")


@query("SELECT c_custkey AS idx, c_mktsegment AS segment, CAST(c_custkey % 5 = 0 AS INTEGER) AS target, 9 AS seen FROM customer")
def load_run_snapshot(spark, d):
    path = scratch_path(spark, "snapshot")
    ledger.save_run_snapshot(load(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_mktsegment").alias("segment")), {"every": 5}, path, {"seen": 9})
    back, config, state = ledger.load_run_snapshot(spark, path, with_state=True)
    return back.withColumn("target", (F.col("idx") % config["every"] == 0).cast("int")).withColumn("seen", F.lit(state["seen"]))


@query("SELECT run_id, CAST(100 + count(*) FILTER (status = 'failed') AS BIGINT) AS failed FROM attempts GROUP BY run_id", A)
def initial_state(spark, d):
    begun = runs_.initial_state(base.attempts(spark, d), {"failed": 100})
    return begun.groupBy("run_id").agg((F.max("state.failed") + F.count_if(F.col("status") == "failed")).alias("failed"))


@query("SELECT page_id % 50 AS part, string_agg(url, chr(10) ORDER BY url) || chr(10) AS text FROM pages GROUP BY 1")
def read_text_files(spark, d):
    path = scratch_path(spark, "text")
    lines = load(spark, d, "pages").select((F.col("page_id") % 50).alias("part"), "url")
    lines.repartition("part").sortWithinPartitions("part", "url").write.partitionBy("part").text(path)
    return files.read_text_files(spark, f"{path}/part=*/*.txt").select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part"), "text")


@query("SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '[' || chr(1) || '-' || chr(9) || chr(11) || '-' || chr(31) || chr(65534) || chr(65535) || ']', '', 'g'), chr(10)), lambda p: regexp_matches(p, '\\S')), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def decode_office_files(spark, d):
    # Control characters are no XML.
    plain = load(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.regexp_replace("text", "[\\x00-\\x09\\x0B-\\x1F\\uFFFE\\uFFFF]", "").alias("text"))
    return files.decode_office_files(plain.mapInPandas(offline.as_docx, "path string, content binary")).select(F.col("path").cast("long").alias("doc_id"), "text")
