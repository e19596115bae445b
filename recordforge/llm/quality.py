"""Quality: supervised subword embeddings with a softmax output.

A document is the average of the learned vectors of its features: its words
(runs of non-blanks, case kept), its pairs of neighbouring words and its
character n-grams. Words, pairs and n-grams are hashed into one table. A linear layer with softmax over the two classes
reads the average. Vectors and layer are trained together by stochastic
gradient descent in numpy (per-row Adagrad steps), one document at a time, in
one task on the caller's bounded sample.

As the output is linear in the average, scoring needs only each feature's
contribution to the logit: one number per table row.

Defined cases: null and empty texts have no features and get the score of the
bias; repeated rows are scored alike; rows with a null label are not learned
from; with one class only, every score is that class's share; an empty table
gives an empty result; columns of the new names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T

from recordforge.llm.textarrays import ODD64, Powers, append_columns, blank_table, chunked, encode, mix, ngram_buckets, owners, text_slices, words

BITS, ORDERS, DIMENSIONS, EPOCHS = 16, (2, 3), 12, 6


def _features(texts: list, bits: int, orders: tuple, table: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(text, table row) of every feature occurrence."""
    codes, starts, lens = encode(texts, lower=False)
    h, begin, _, first = words(codes, starts, lens, table, powers)
    owner = owners(begin, starts)
    rows = (h >> np.uint64(64 - bits)).astype(np.int64)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = mix(h[inner] * np.uint64(ODD64[0]) + h[inner + 1] * np.uint64(ODD64[1]))
    found = [(owner, rows), (owner[inner], (pairs >> np.uint64(64 - bits)).astype(np.int64))]
    for n in orders:
        buckets, inside = ngram_buckets(codes, starts, lens, n, bits)
        at = np.flatnonzero(inside)
        found.append((owners(at, starts), buckets[at]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def fit(sample: DataFrame, text_col: str, label_col: str, bits: int = BITS, orders: tuple = ORDERS, dims: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = 0.2) -> dict:
    """Learns from all rows of `sample`, which the caller has bounded."""
    rows = sample.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1)).repartition(16)

    def features(batches):
        table, powers = blank_table(), Powers()
        for batch in batches:
            ids, shares = [], []
            for lo, hi, texts in text_slices(batch.column(0)):
                owner, row = _features(texts, bits, orders, table, powers)
                pairs, n = np.unique((owner.astype(np.int64) << bits) | row, return_counts=True)
                doc = pairs >> bits
                total = np.bincount(doc, n, minlength=hi - lo)
                cuts = np.searchsorted(doc, np.arange(1, hi - lo))
                ids += np.split((pairs & ((1 << bits) - 1)).astype(np.int32), cuts)
                shares += np.split((n / np.maximum(1, total[doc])).astype(np.float32), cuts)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["label", "ids", "shares"])

    def train(batches):
        rng = np.random.default_rng(7)
        y, ids, shares = [], [], []
        for batch in batches:
            y += batch.column(0).to_pylist()
            cuts = np.cumsum(np.asarray(pa.compute.list_value_length(batch.column(1))))[:-1]
            ids += np.split(np.asarray(batch.column(1).flatten()), cuts)
            shares += np.split(np.asarray(batch.column(2).flatten()), cuts)
        if not y:
            return
        if len(set(y)) < 2:
            share = np.clip(np.mean(y), 1e-4, 1 - 1e-4)
            yield pa.RecordBatch.from_arrays([pa.array([np.zeros(1 << bits, np.float32).tobytes()]), pa.array([float(np.log(share / (1 - share)))])], names=["logit", "bias"])
            return
        e = rng.uniform(-1 / dims, 1 / dims, (1 << bits, dims)).astype(np.float32)
        e2 = np.full(1 << bits, 1e-6, np.float32)
        w, b = np.zeros((dims, 2), np.float32), np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
        w2, b2 = np.full((dims, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in rng.permutation(len(y)):
                u, s = ids[i], shares[i]
                h = s @ e[u] if len(u) else np.zeros(dims, np.float32)
                z = h @ w + b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                gh, gw = w @ p, np.outer(h, p)
                if len(u):
                    e2[u] += (gh @ gh) / dims * s * s
                    e[u] -= step * np.outer(s / np.sqrt(e2[u]), gh)
                w2 += gw * gw
                b2 += p * p
                w -= step * gw / np.sqrt(w2)
                b -= step * p / np.sqrt(b2)
        logit = e @ (w[:, 1] - w[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array([logit.astype(np.float32).tobytes()]), pa.array([float(b[1] - b[0])])], names=["logit", "bias"])

    got = rows.mapInArrow(features, "label int, ids array<int>, shares array<float>").repartition(1).mapInArrow(train, "logit binary, bias double").first()
    if got is None:
        return {"logit": np.zeros(1 << bits, np.float32), "bias": 0.0, "bits": bits, "orders": orders}
    return {"logit": np.frombuffer(got["logit"], np.float32), "bias": got["bias"], "bits": bits, "orders": orders}


def score(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.7, score_col: str = "score", flag_col: str = "predicted") -> DataFrame:
    """Adds the probability of good quality and a 0/1 flag; reads each whole text once."""

    def make():
        table, powers, logit = blank_table(), Powers(), model["logit"]

        def fn(texts):
            z = np.empty(len(texts))
            for lo, hi in chunked(texts):
                owner, row = _features(texts[lo:hi], model["bits"], model["orders"], table, powers)
                n = np.bincount(owner, minlength=hi - lo)
                z[lo:hi] = model["bias"] + np.bincount(owner, logit[row], minlength=hi - lo) / np.maximum(1, n)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return p, (p >= threshold).astype(np.int32)

        return fn

    return append_columns(docs, [T.StructField(score_col, T.DoubleType()), T.StructField(flag_col, T.IntegerType())], make, text_col)
