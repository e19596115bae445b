"""Composite jobs: whole datasets from a few parameters. The model is any batch function on texts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from recordforge.functions.jsonx import check_calls
from recordforge.functions.prompts import render_prompt
from recordforge.functions.text import join_reasons, qa_prompts, split_tokens
from recordforge.operators.attempts import split_checked, split_verified, union_results
from recordforge.operators.inputs import rank_within, sample_exact, shuffle_rows
from recordforge.operators.run import ask_model
from recordforge.operators.topics import fan_out_topics, topic_batches
from recordforge.sources.tables import materialise

Model = Callable[[list[str]], list[str]]


def _items(asked: DataFrame, keep: list[str], columns: dict[str, str]) -> DataFrame:
    """The items of good replies as rows with typed columns."""
    rows = asked.filter("parse_status = 'ok'").select(*keep, F.posexplode("data").alias("pos", "_v"))
    return rows.select(*keep, "pos", *[F.try_variant_get("_v", f"$.{c}", t).alias(c) for c, t in columns.items()])


def generate_by_topic(plan: DataFrame, template: str, fields: list[dict], model: Model, seed: int = 0, rounds: int = 2) -> DataFrame:
    """Plan (pos, topic, n) -> shuffled records -> prompts with an earlier example -> replies, topic on item 0.

    The records of a topic are generated in `rounds`: those of a later round
    show what an earlier one generated for the same topic (variable `example`),
    drawn by hash; the first round has no examples.
    """
    rows = materialise(shuffle_rows(fan_out_topics(plan).withColumn("key", F.concat_ws("-", "topic", "k")), "key", seed, "idx").select("idx", "topic", "k"), "topic-rows")
    said = None
    for r in range(rounds):
        mine = rows.filter(F.pmod("k", F.lit(rounds)) == (r + 1) % rounds)
        if said is None:
            shown = mine.withColumn("example", F.lit(None).cast("string"))
        else:
            earlier = rank_within(said.filter("pos = 0").select(F.col("_topic"), F.col("idx").alias("_at"), F.to_json(F.struct(*[f["name"] for f in fields])).alias("example")), ["_topic"], F.floor(F.col("_at") / 100_000), [F.col("_at")], "_rank")
            sizes = earlier.groupBy(F.col("_topic").alias("_of")).agg(F.count("*").alias("_n"))
            h = F.conv(F.substring(F.md5(F.concat(F.col("idx").cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("long")
            drawn = mine.join(sizes, F.col("topic").eqNullSafe(F.col("_of")), "left").withColumn("_pick", h % F.col("_n") + 1)
            shown = drawn.join(earlier, F.col("topic").eqNullSafe(F.col("_topic")) & (F.col("_pick") == F.col("_rank")), "left").select("idx", "topic", "k", "example")
        asked = ask_model(render_prompt(shown, template, json.dumps(fields)), "prompt", fields, model)
        items = materialise(_items(asked, ["idx", "topic", "example"], {f["name"]: "string" for f in fields}).withColumnRenamed("topic", "_topic"), "topic-items")
        said = items if said is None else said.unionByName(items)
    return said.withColumn("topic", F.when(F.col("pos") == 0, F.col("_topic"))).drop("_topic")


def subtopics(topics: DataFrame, n: int, model: Model, size: int = 5) -> DataFrame:
    """(topic, subtopic): n subtopics of each topic, asked for in batches, firsts only."""
    batches = topics.select("topic", F.posexplode(topic_batches(F.lit(n), size)).alias("part", "want"))
    prompts = batches.withColumn("prompt", F.concat(F.lit("Name "), F.col("want").cast("string"), F.lit(" subtopics of "), F.col("topic"), F.lit(" (part "), F.col("part").cast("string"), F.lit(")")))
    items = _items(ask_model(prompts, "prompt", [{"name": "subtopic", "type": "str"}], model), ["topic", "part"], {"subtopic": "string"})
    return items.groupBy("topic", "subtopic").agg(F.min(F.struct("part", "pos")).alias("_at")).select("topic", "subtopic")


def function_call_dataset(topics: DataFrame, contract: dict, model: Model, target: int, n_subtopics: int = 2) -> DataFrame:
    """Queries and calls for a contract, checked; each pair that fails is generated anew once, told the reason; cut to the target.

    Pairs that still fail stay, with ok = false and their reasons.
    """
    fields = [{"name": "query", "type": "str"}, {"name": "answer", "type": "list", "required": False}]

    def ask(rows: DataFrame) -> DataFrame:
        asked = ask_model(rows, "prompt", fields, model).filter("parse_status = 'ok'").select("topic", "subtopic", F.posexplode("data").alias("pos", "_v"))
        got = asked.select("topic", "subtopic", "pos", F.try_variant_get("_v", "$.query", "string").alias("query"), F.to_json(F.try_variant_get("_v", "$.answer", "variant")).alias("answer"))
        checked = check_calls(got, "query", "answer", contract)
        verdict = ask_model(checked.withColumn("prompt", F.when(F.col("needs_model"), F.concat(F.lit("Does the call answer the query? "), F.col("query"), F.lit(" "), F.col("answer")))), "prompt", [{"name": "match", "type": "str"}], model)
        semantic = F.coalesce(F.try_variant_get(F.get("data", F.lit(0)), "$.match", "string") == "Yes", F.lit(False))
        split = split_checked(verdict.withColumn("semantic_ok", semantic).drop("prompt", "reply", "data", "parse_status", "parse_error"), "format_ok", "semantic_ok")
        why = F.when(~F.col("ok"), F.when(F.size("reasons") > 0, join_reasons(F.col("reasons"))).otherwise("the call does not answer the query"))
        return split.withColumn("why", why)

    first = ask(subtopics(topics, n_subtopics, model).withColumn("prompt", F.concat(F.lit(f"Write a query and its calls of {contract['name']} about "), F.col("subtopic"))))
    mend = F.concat(F.lit(f"Mend the calls of {contract['name']} for the query: "), F.col("query"), F.lit(". They were wrong: "), F.col("why"))
    again = ask(first.filter("not ok").withColumn("prompt", mend).select("topic", "subtopic", "prompt"))
    rows = union_results(first.filter("ok"), again)
    return sample_exact(rows.withColumn("key", F.concat_ws("-", "subtopic", "pos", "query")), target, "key").drop("key")


def document_qa(docs: DataFrame, model: Model, pairs: int = 5, size: int = 400, overlap: int = 20) -> DataFrame:
    """(doc_id, chunk, pos, question, answer): each document's chunks share its pairs."""
    prompts = docs.select("doc_id", F.posexplode(qa_prompts(split_tokens(F.col("text"), size, overlap), pairs)).alias("chunk", "prompt"))
    asked = ask_model(prompts, "prompt", [{"name": "question", "type": "str"}, {"name": "answer", "type": "str"}], model)
    return _items(asked, ["doc_id", "chunk"], {"question": "string", "answer": "string"})


def verified_reasoning(topics: DataFrame, model: Model) -> DataFrame:
    """Problems of each topic with reasoning; failed ones are rewritten once; verified ones stay."""
    fields = [{"name": c, "type": "str"} for c in ("problem", "answer", "reasoning")]
    check = [{"name": "verified", "type": "str"}]

    def verify(rows: DataFrame) -> DataFrame:
        prompts = rows.withColumn("prompt", F.concat(F.lit("Is the answer right? "), F.col("problem"), F.lit(" "), F.col("answer")))
        asked = ask_model(prompts, "prompt", check, model)
        return asked.withColumn("verified", F.try_variant_get(F.get("data", F.lit(0)), "$.verified", "string")).select("topic", "pos", "problem", "answer", "reasoning", "verified")

    prompts = topics.withColumn("prompt", F.concat(F.lit("Write problems about "), F.col("topic")))
    good, bad = split_verified(verify(_items(ask_model(prompts, "prompt", fields, model), ["topic"], {f["name"]: "string" for f in fields})), "verified")
    rewrite = bad.withColumn("prompt", F.concat(F.lit("Rewrite the solution of "), F.col("problem"))).select("topic", "prompt")
    second, _ = split_verified(verify(_items(ask_model(rewrite, "prompt", fields, model), ["topic"], {f["name"]: "string" for f in fields})), "verified")
    return union_results(good, second)
