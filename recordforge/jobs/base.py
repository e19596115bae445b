"""The given tables in the shapes that the operators take, in Spark and in SQL.

Statuses and other choices come from md5 buckets, so that both sides agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordforge.sources.tables import load


def bucket(key: Column, parts: int) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") % parts


def sql_bucket(key: str, parts: int) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 4) AS INTEGER) % {parts})"


def attempts(spark: SparkSession, d: str, tries: int = 3) -> DataFrame:
    """Three attempts for each document."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("idx"), "lang", "source")
    rows = docs.select("*", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("attempt"))
    key = F.concat_ws("-", "idx", "attempt")
    b, n = bucket(key, 100), bucket(F.concat(key, F.lit("-n")), 3) + 1
    status = F.when(b < 60, "completed").when(b < 75, "duplicate").when(b < 85, "filtered").otherwise("failed")
    items = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat("lang", F.lit("_"), i.cast("string")).alias("answer")))
    return rows.select(F.col("source").alias("run_id"), "idx", "attempt", (F.col("idx") * tries + F.col("attempt") - 1).alias("seq"), status.alias("status"), F.when(status != "failed", items).alias("output"), F.when(status == "failed", F.concat(F.lit(" Error "), (b % 5).cast("string"), F.lit(" "))).alias("err_str"))


_KEY = "idx || '-' || attempt"
ATTEMPTS = f"""attempts AS (
  SELECT source AS run_id, idx, attempt, idx * 3 + attempt - 1 AS seq, status,
         CASE WHEN status <> 'failed' THEN list_transform(range(1, n + 1), lambda i: {{'answer': lang || '_' || i}}) END AS output,
         CASE WHEN status = 'failed' THEN ' Error ' || (b % 5) || ' ' END AS err_str
  FROM (SELECT *, CASE WHEN b < 60 THEN 'completed' WHEN b < 75 THEN 'duplicate' WHEN b < 85 THEN 'filtered' ELSE 'failed' END AS status
        FROM (SELECT doc_id AS idx, lang, source, attempt, {sql_bucket("doc_id || '-' || attempt", 100)} AS b, {sql_bucket("doc_id || '-' || attempt || '-n'", 3)} + 1 AS n
              FROM documents, (SELECT unnest([1, 2, 3]) AS attempt)))
)"""
ITEMS = """items AS (
  SELECT idx, attempt, run_id, status, i - 1 AS pos, output[i].answer AS answer
  FROM (SELECT *, unnest(range(1, len(output) + 1)) AS i FROM attempts WHERE status <> 'failed')
)"""


def projects(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"), "n_regionkey")


def runs(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer")
    b = bucket(F.col("c_custkey").cast("string"), 3)
    return rows.select(F.col("c_custkey").alias("master_job_id"), F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("name"), F.when(b == 0, "pending").when(b == 1, "running").otherwise("completed").alias("status"), F.round("c_acctbal", 2).alias("creation_time"))


RUNS = f"""runs AS (
  SELECT c_custkey AS master_job_id, c_nationkey AS project_id, c_name AS name, round(c_acctbal, 2) AS creation_time,
         CASE {sql_bucket("CAST(c_custkey AS VARCHAR)", 3)} WHEN 0 THEN 'pending' WHEN 1 THEN 'running' ELSE 'completed' END AS status FROM customer
)"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders")
    b = bucket(F.col("o_orderkey").cast("string"), 10)
    start = F.col("o_orderdate").cast("timestamp_ntz")
    return rows.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("master_job_id"), F.when(b < 7, "completed").when(b < 9, "failed").otherwise("filtered").alias("status"), F.md5(F.col("o_orderkey").cast("string")).alias("run_config_hash"), start.alias("start_time"), F.when(b != 3, start + F.expr("interval 1 hour") * b).alias("end_time"))


TASKS = f"""tasks AS (
  SELECT job_id, master_job_id, run_config_hash, start_time, CASE WHEN b <> 3 THEN start_time + b * INTERVAL 1 HOUR END AS end_time,
         CASE WHEN b < 7 THEN 'completed' WHEN b < 9 THEN 'failed' ELSE 'filtered' END AS status
  FROM (SELECT o_orderkey AS job_id, o_custkey AS master_job_id, md5(CAST(o_orderkey AS VARCHAR)) AS run_config_hash, CAST(o_orderdate AS TIMESTAMP) AS start_time, {sql_bucket("CAST(o_orderkey AS VARCHAR)", 10)} AS b FROM orders)
)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    uid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return load(spark, d, "lineitem").select(uid.alias("record_uid"), F.col("l_orderkey").alias("job_id"), F.when(F.col("l_returnflag") == "N", "completed").when(F.col("l_returnflag") == "R", "failed").otherwise("filtered").alias("status"), F.col("l_shipdate").cast("timestamp_ntz").alias("start_time"), F.col("l_quantity").alias("quantity"))


RECORDS = """records AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS record_uid, l_orderkey AS job_id, CAST(l_shipdate AS TIMESTAMP) AS start_time, l_quantity AS quantity,
         CASE l_returnflag WHEN 'N' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'filtered' END AS status FROM lineitem
)"""


def inputs(spark: SparkSession, d: str) -> DataFrame:
    """One input for every second order, whose hash is that of its task; some have no task."""
    rows = load(spark, d, "orders").filter("o_orderkey % 2 = 0")
    shift = F.when(F.col("o_orderkey") % 6 == 0, F.lit("x")).otherwise(F.lit(""))
    return rows.select(F.col("o_orderkey").alias("idx"), F.md5(F.concat(F.col("o_orderkey").cast("string"), shift)).alias("run_config_hash"))


INPUTS = "inputs AS (SELECT o_orderkey AS idx, md5(o_orderkey || CASE WHEN o_orderkey % 6 = 0 THEN 'x' ELSE '' END) AS run_config_hash FROM orders WHERE o_orderkey % 2 = 0)"


def topics(spark: SparkSession, d: str) -> DataFrame:
    """The brands of part, each with a number for a third of them; repeats included."""
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("topic"))
    return rows.withColumn("n", F.when(F.col("pos") % 3 == 0, F.col("pos") % 7 + 1))


TOPICS = "topics AS (SELECT p_partkey AS pos, p_brand AS topic, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 + 1 END AS n FROM part)"
FIRST_TOPICS = "first_topics AS (SELECT topic, min(pos) AS pos, arg_min({'n': n}, pos).n AS n FROM topics GROUP BY topic)"


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Model replies around each event's JSON: plain, fenced, in a sentence, wrapped, none."""
    rows = load(spark, d, "events").select(F.col("event_id").alias("idx"), "props", "event_type")
    kind, tick = F.col("idx") % 5, "```"
    reply = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit(f"Here:\n{tick}json\n"), "props", F.lit(f"\n{tick}\nDone"))).when(kind == 2, F.concat(F.lit("The answer is "), "props", F.lit(" as asked."))).when(kind == 3, F.concat(F.lit('[{"k": "'), "event_type", F.lit('"}, '), "props", F.lit("]"))).otherwise(F.lit("no answer"))
    return rows.select("idx", "event_type", reply.alias("reply"))


REPLIES = """replies AS (
  SELECT event_id AS idx, event_type, props, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done'
    WHEN 2 THEN 'The answer is ' || props || ' as asked.' WHEN 3 THEN '[{"k": "' || event_type || '"}, ' || props || ']' ELSE 'no answer' END AS reply FROM events
)"""
