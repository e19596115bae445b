"""Language ID: nearest of several centroids per language, by cosine.

A text, with all but letters made blanks, is a TF-IDF vector over hashed
character n-grams, of unit length. The
document frequencies come from all training texts. The vectors of about
`per_language` distinct training texts of each language, one at least, are clustered by spherical
k-means, in one task a language; a text takes the language of the nearest of
all centroids. A text whose best cosine is below `least` is rejected: too far
from every known language.

Defined cases: a text that is null or has no letter is `und` with score 0;
training rows with a null language or text are not learned from; ties go to
the alphabetically first language; repeated rows are treated alike; an empty
training set makes every answer `und`; an empty table gives an empty result;
columns of the new names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from recordforge.llm import sums
from recordforge.llm.textarrays import append_columns, chunked, encode, letters_only, ngram_buckets, owners, text_slices
from recordforge.sources.tables import materialise

BITS, ORDERS, CENTROIDS, PER_LANGUAGE, LEAST_COSINE = 12, (1, 2, 3), 4, 1500, 0.15
#: Languages that the labels may hold; more would not be languages.
MOST_LANGUAGES = 1000
#: Texts in a dense block of vectors.
ROWS = 256


def _counts(texts: list, bits: int, orders: tuple) -> np.ndarray:
    """Occurrences of every bucket in every text."""
    codes, starts, lens = encode(texts)
    codes = letters_only(codes)
    found = np.zeros(len(texts) << bits, np.int64)
    for n in orders:
        buckets, inside = ngram_buckets(codes, starts, lens, n, bits)
        at = np.flatnonzero(inside)
        found += np.bincount((owners(at, starts) << bits) | buckets[at], minlength=len(found))
    return found.reshape(len(texts), 1 << bits)


def _vectors(texts: list, idf: np.ndarray, bits: int, orders: tuple) -> np.ndarray:
    v = np.log1p(_counts(texts, bits, orders)).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(train: DataFrame, text_col: str, lang_col: str, bits: int = BITS, orders: tuple = ORDERS, centroids: int = CENTROIDS, per_language: int = PER_LANGUAGE) -> dict:
    """Document frequencies of all training rows, and centroids of a bounded sample."""
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    size = 1 << bits

    def count(batches):
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(0), most_rows=ROWS):
                df[:size] += (_counts(texts, bits, orders) > 0).sum(0)
                df[size] += hi - lo
        yield sums.emit(df)

    got = sums.total(rows.select("text").mapInArrow(count, sums.SCHEMA), np.int64)
    df, seen = (np.zeros(size), 0) if got is None else (got[:size], got[size])
    idf = (np.log((1 + seen) / (1 + df)) + 1).astype(np.float32)

    # Distinct texts by their hash, so that copies do not crowd out others; each language keeps one at least.
    hashed = rows.select("lang", F.xxhash64(F.lit("lang"), "text").alias("_hash"))
    distinct = materialise(hashed.distinct(), "language-texts")
    per = distinct.groupBy("lang").agg(F.count("*").alias("n"), F.min("_hash").alias("first")).limit(MOST_LANGUAGES + 1).collect()
    if len(per) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not per:
        return {"idf": idf, "langs": [], "centroids": np.zeros((0, size), np.float32), "bits": bits, "orders": orders}
    scale = 1_000_000_007
    table = lambda of, kind: F.create_map(*[x for r in per for x in (F.lit(r["lang"]), F.lit(of(r)).cast(kind))])
    below = F.pmod(F.col("_hash"), F.lit(scale)) < table(lambda r: min(scale, int(scale * per_language / r["n"])), "long")[F.col("lang")]
    chosen = below | (F.col("_hash") == table(lambda r: r["first"], "long")[F.col("lang")])
    sample = rows.withColumn("_hash", F.xxhash64(F.lit("lang"), "text")).filter(chosen).dropDuplicates(["lang", "_hash"]).select("text", "lang")

    def vectors(batches):
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(0), most_rows=ROWS):
                v = _vectors(texts, idf, bits, orders).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array([x.tobytes() for x in v], pa.binary())], names=["lang", "v"])

    def cluster(table: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(b, np.float16) for b in sorted(table.column("v").to_pylist())]).astype(np.float32)
        rng = np.random.default_rng(3)
        c = x[rng.choice(len(x), min(centroids, len(x)), replace=False)]
        for _ in range(12):
            near = (x @ c.T).argmax(1)
            c = np.stack([x[near == k].sum(0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        return pa.table({"lang": [table.column("lang")[0].as_py()] * len(c), "k": list(range(len(c))), "c": [r.astype(np.float32).tobytes() for r in c]}, schema=pa.schema([("lang", pa.string()), ("k", pa.int32()), ("c", pa.binary())]))

    learned = sorted(sample.mapInArrow(vectors, "lang string, v binary").groupBy("lang").applyInArrow(cluster, "lang string, k int, c binary").collect(), key=lambda r: (r["lang"], r["k"]))
    c = np.stack([np.frombuffer(r["c"], np.float32) for r in learned]) if learned else np.zeros((0, size), np.float32)
    return {"idf": idf, "langs": [r["lang"] for r in learned], "centroids": c, "bits": bits, "orders": orders}


def predict(docs: DataFrame, model: dict, text_col: str = "text", least: float = LEAST_COSINE, lang_col: str = "lang_pred", score_col: str = "score", rejected_col: str = "rejected") -> DataFrame:
    """Adds the nearest language, its cosine, and whether that is too far to be trusted."""

    def make():
        langs, c = model["langs"], model["centroids"]

        def fn(texts):
            names, best = ["und"] * len(texts), np.zeros(len(texts))
            for lo, hi in chunked(texts, most_rows=ROWS) if langs else ():
                cosine = _vectors(texts[lo:hi], model["idf"], model["bits"], model["orders"]) @ c.T
                near = cosine.argmax(1)
                for i, k in enumerate(near):
                    if has_letter(texts[lo + i]):
                        names[lo + i] = langs[k]
                        best[lo + i] = min(1.0, max(0.0, float(cosine[i, k])))
            return names, best, best < least

        return fn

    return append_columns(docs, [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType()), T.StructField(rejected_col, T.BooleanType())], make, text_col)
