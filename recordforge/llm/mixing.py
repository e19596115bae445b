"""Mixing sources to target weights by soft membership.

A labelled table gives some documents a domain. Naive Bayes on hashed words,
learned from those, predicts every document's posterior over the domains. The
rates of the documents (how often each should be drawn) are nonnegative and
solve the least squares problem

    minimise  sum over domains d of (share_d(rates) - target_d)^2 / natural_d

where share_d is the expected share of tokens in domain d and natural_d that
share at rate 1. Projected gradient starts at rate 1; each step is one
distributed aggregate of D sums, and D numbers go back into the next step. A
document's rate is a fold over these few vectors, so no rates are stored or
shuffled between steps.

Built-in functions only. The word table has `BUCKETS` rows whatever the corpus
holds, so it may be broadcast.

Defined cases: a null or empty text has no tokens, the prior as its posterior
and a rate like any other; labels that are null, or of absent documents, are
not learned from; repeated rows get equal rates; without labels or without
documents the result is empty or has rate 1; columns of the new names are
replaced, all others kept, whatever their names. Targets must name every domain that the labels have.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from recordforge.sources.tables import materialise

BUCKETS = 8192
#: Tokens that a long document counts as, so that posteriors stay soft.
EVIDENCE = 48.0
STEPS, TOLERANCE = 60, 1e-5


def _words(df: DataFrame, keep: list[str]) -> DataFrame:
    """(kept columns, place, bucket) of every word; place 0 is each text's first."""
    words = F.array_remove(F.split(F.lower("_text"), "\\s+"), "")
    return df.select(*keep, F.posexplode(words).alias("_place", "_w")).select(*keep, "_place", F.pmod(F.xxhash64("_w"), F.lit(BUCKETS)).cast("int").alias("_bucket"))


def fit_domains(labelled: DataFrame, text_col: str, domain_col: str) -> tuple[DataFrame | None, list[str], list[float]]:
    """Word table (bucket, log-likelihood of each domain), the domains and their log priors.

    The caller bounds the labelled rows; the table has at most `BUCKETS` rows.
    """
    rows = labelled.select(F.col(text_col).alias("_text"), F.col(domain_col).cast("string").alias("_domain")).filter("_domain is not null")
    priors = {r["_domain"]: r["n"] for r in rows.groupBy("_domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(priors)
    if not domains:
        return None, [], []
    counts = _words(rows, ["_domain"]).groupBy("_bucket").agg(*[F.sum(F.when(F.col("_domain") == d, 1).otherwise(0)).alias(f"_c{i}") for i, d in enumerate(domains)])
    all_buckets = labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("_bucket"))
    counts = materialise(all_buckets.join(counts, "_bucket", "left").na.fill(0), "mixing-words")
    totals = counts.agg(*[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(domains))]).first()
    table = counts.select("_bucket", *[F.log((F.col(f"_c{i}") + 0.1) / (totals[i] + 0.1 * BUCKETS)).alias(f"_l{i}") for i in range(len(domains))])
    n = sum(priors.values())
    return table, domains, [math.log(priors[d] / n) for d in domains]


def posteriors(docs: DataFrame, text_col: str, id_col: str, table: DataFrame, domains: list[str], log_priors: list[float], keep_text: bool = False) -> DataFrame:
    """Adds _tokens and _p0.._pD, each document's tokens and posterior; drops the text unless it is to stay.

    The sums of a document meet its row by id and hash of the text, so the plan
    may run each side of the join on its own. Repeated rows share their sums,
    which are divided by the number of such rows.
    """
    keyed = docs.withColumn("_hash", F.xxhash64(text_col))
    words = _words(keyed.select(F.col(id_col).alias("_id"), "_hash", F.col(text_col).alias("_text")), ["_id", "_hash"])
    k = range(len(domains))
    rows = F.count_if(F.col("_place") == 0)
    sums = words.join(F.broadcast(table), "_bucket").groupBy("_id", "_hash").agg((F.count("*") / rows).cast("long").alias("_tokens"), *[(F.sum(f"_l{i}") / rows).alias(f"_s{i}") for i in k]).withColumnRenamed("_hash", "_hash_of")
    weight = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.col("_tokens"), F.lit(1)))
    logits = [F.lit(log_priors[i]) + F.coalesce(F.col(f"_s{i}") * weight, F.lit(0.0)) for i in k]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    rest = keyed if keep_text else keyed.drop(text_col)
    joined = rest.join(sums, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_hash_of")), "left").withColumn("_tokens", F.coalesce("_tokens", F.lit(0)))
    shifted = joined.select("*", *[F.exp(z - top).alias(f"_e{i}") for i, z in enumerate(logits)])
    total = reduce(lambda a, b: a + b, [F.col(f"_e{i}") for i in k])
    return shifted.select(*[c for c in docs.columns if keep_text or c != text_col], "_tokens", *[(F.col(f"_e{i}") / total).alias(f"_p{i}") for i in k])


def _rate(steps: list[list[float]]):
    """The rate after the given steps, a fold over their vectors."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    dot = lambda g: reduce(lambda a, b: a + b, [F.col(f"_p{i}") * g[i] for i in range(len(steps[0]))])
    return F.aggregate(F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps]), rate, lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


def fit_rates(soft: DataFrame, targets: list[float]) -> tuple[list[list[float]], list[float]]:
    """Step vectors of the projected gradient, and the shares that they reach."""
    k = range(len(targets))
    base = soft.agg(F.sum("_tokens").alias("t"), *[F.sum(F.col("_tokens") * F.col(f"_p{i}")).alias(f"d{i}") for i in k], *[F.sum(F.col("_tokens") * F.col(f"_p{i}") * F.col(f"_p{j}")).alias(f"m{i}_{j}") for i in k for j in k]).first()
    if not base["t"]:
        return [], []
    natural = [max(base[f"d{i}"] / base["t"], 1e-9) for i in k]
    # The largest eigenvalue of the scaled Gram matrix is at most its largest row sum.
    bound = max(sum(base[f"m{i}_{j}"] / base["t"] / math.sqrt(natural[i] * natural[j]) for j in k) for i in k)
    steps: list[list[float]] = []
    shares = natural
    for _ in range(STEPS):
        if max(abs(shares[i] - targets[i]) for i in k) < TOLERANCE:
            break
        steps.append([(shares[i] - targets[i]) / natural[i] / bound for i in k])
        got = soft.select("_tokens", *[f"_p{i}" for i in k], _rate(steps).alias("_r")).agg(*[F.sum(F.col("_tokens") * F.col("_r") * F.col(f"_p{i}")).alias(f"d{i}") for i in k]).first()
        shares = [got[i] / base["t"] for i in k]
    return steps, shares


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text_col: str = "text", id_col: str = "doc_id", domain_col: str = "domain", keep_text: bool = False) -> DataFrame:
    """All columns of `docs`, with n_tokens, domain, posterior, rate and copies; the text only if asked for.

    A warning tells which domains miss their target by more than a thousandth
    (none can be reached of which hardly any document is likely).

    `labelled` has the text and `domain_col`. `copies` rounds the rate up or down
    by a hash of the id, so that its expectation is the rate.
    """
    table, domains, log_priors = fit_domains(labelled, text_col, domain_col)
    new = ["n_tokens", "domain", "posterior", "rate", "copies"]
    docs = docs.drop(*new)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    if not domains:
        return docs.select(*kept, F.coalesce(F.size(F.filter(F.split(text_col, "\\s+"), lambda w: w != "")), F.lit(0)).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    if missing := set(domains) - set(targets):
        raise ValueError(f"no target for {sorted(missing)}")
    total = sum(targets[d] for d in domains)
    # Numbered names on the way, so that any name may be among the given ones.
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    soft = materialise(posteriors(docs.toDF(*inner.values()), inner[text_col], inner[id_col], table, domains, log_priors, keep_text), "mixing-posteriors")
    wanted = [targets[d] / total for d in domains]
    steps, reached = fit_rates(soft, wanted)
    if missed := {d: round(r, 4) for d, w, r in zip(domains, wanted, reached) if abs(r - w) > 1e-3}:
        warnings.warn(f"shares reached instead of their targets: {missed}", stacklevel=2)
    p = [F.col(f"_p{i}") for i in range(len(domains))]
    best = F.greatest(*p) if len(p) > 1 else p[0]
    domain = F.coalesce(*[F.when(p[i] == best, F.lit(d)) for i, d in enumerate(domains)])
    unit = F.pmod(F.xxhash64(F.lit("copies"), F.col(inner[id_col])), F.lit(1_000_003)) / 1_000_003
    mixed = soft.select(*[inner[c] for c in kept], F.col("_tokens").alias("_n"), domain.alias("_domain"), F.array(*p).alias("_posterior"), _rate(steps).alias("_rate"))
    mixed = mixed.withColumn("_copies", F.floor(F.col("_rate") + unit).cast("int"))
    return mixed.toDF(*kept, *new)
