"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes ratios.

Model. Texts are lower-cased; the hashed character n-grams that occur in a text
are its features (present or not, however long the text is). For each feature
the log-count ratio of naive Bayes between toxic and other training texts is
taken; logistic regression is then fitted on the features multiplied by their
ratios. Features whose counts do not differ between the classes beyond chance
(chi-squared below `min_chi2`) get no weight, so that the many n-grams of a
long text add no noise; of those that do, the `most_features` with the largest
chi-squared get one.

Defined cases: a null text counts as empty; an empty text gets the score of the
bias; repeated rows are scored alike; rows with a null label are not learned
from; with one class only, every score is that class's share; an empty table
gives an empty result; columns of the new names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T

from recordforge.llm.textarrays import append_columns, chunked, encode, ngram_buckets, owners, text_slices

BITS = 19
ORDERS = (3, 4, 5)


def _present(texts: list, selected: np.ndarray, bits: int, orders: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, selected bucket) without repeats, sorted."""
    found = []
    codes, starts, lens = encode(texts)
    for n in orders:
        buckets, inside = ngram_buckets(codes, starts, lens, n, bits)
        at = np.flatnonzero(inside & selected[buckets])
        found.append((owners(at, starts) << bits) | buckets[at])
    pairs = np.unique(np.concatenate(found))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _add_document_counts(df: np.ndarray, labels: np.ndarray, texts: list, bits: int, orders: tuple) -> None:
    """Adds each text's distinct buckets to the counts of its class."""
    codes, starts, lens = encode(texts)
    hashed = [ngram_buckets(codes, starts, lens, n, bits)[0] for n in orders]
    seen = np.zeros(1 << bits, bool)
    for label, start, length in zip(labels, starts, lens):
        for n, buckets in zip(orders, hashed):
            seen[buckets[start : start + max(0, length - n + 1)]] = True
        at = np.flatnonzero(seen)
        df[label, at] += 1
        seen[at] = False


def fit(sample: DataFrame, text_col: str, label_col: str, bits: int = BITS, orders: tuple = ORDERS, min_df: int = 3, min_chi2: float = 15.0, most_features: int = 2048, l2: float = 0.01, steps: int = 300) -> dict:
    """Learns from all rows of `sample`, which the caller has bounded.

    Class counts of the n-grams are summed over partitions; the regression then
    runs in one task, on the selected features of the sample.
    """
    rows = sample.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1)).repartition(16).persist()
    size = 1 << bits

    def count(batches):
        df = np.zeros((2, size), np.int32)
        docs = np.zeros(2, np.int64)
        for batch in batches:
            labels = np.asarray(batch.column(1))
            for lo, hi, texts in text_slices(batch.column(0)):
                _add_document_counts(df, labels[lo:hi], texts, bits, orders)
            docs += np.bincount(labels, minlength=2)
        if docs.any():
            yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()]), pa.array([docs.tobytes()])], names=["df", "docs"])

    def select(batches):
        df, docs = np.zeros(2 * size, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                df += np.frombuffer(a, np.int32)
                docs += np.frombuffer(b, np.int64)
        df = df.reshape(2, size).astype(np.float64)
        n0, n1 = docs
        n, both = n0 + n1, df.sum(0)
        chi2 = n * (df[1] * (n0 - df[0]) - df[0] * (n1 - df[1])) ** 2 / np.maximum(1, both * (n - both) * n0 * n1)
        chi2[both < min_df] = 0
        best = np.argsort(-chi2, kind="stable")[:most_features]
        best = np.sort(best[chi2[best] >= min_chi2])
        ratio = np.log((df[1][best] + 1) / (df[1].sum() + size)) - np.log((df[0][best] + 1) / (df[0].sum() + size))
        yield pa.RecordBatch.from_arrays([pa.array([best.astype(np.int32).tobytes()]), pa.array([ratio.tobytes()]), pa.array([int(n0)]), pa.array([int(n1)])], names=["chosen", "ratio", "n0", "n1"])

    # Selected in a task: the driver sees at most `most_features` of the buckets.
    got = rows.mapInArrow(count, "df binary, docs binary").repartition(1).mapInArrow(select, "chosen binary, ratio binary, n0 long, n1 long").first()
    chosen, ratio, n0, n1 = np.frombuffer(got["chosen"], np.int32), np.frombuffer(got["ratio"], np.float64), got["n0"], got["n1"]
    if not n0 or not n1:
        rows.unpersist()
        share = np.clip(n1 / max(1, n0 + n1), 1e-4, 1 - 1e-4)
        return {"chosen": chosen[:0], "weights": np.zeros(0, np.float32), "bias": float(np.log(share / (1 - share))), "bits": bits, "orders": orders}

    def features(batches):
        place = np.full(size, -1, np.int32)
        place[chosen] = np.arange(len(chosen), dtype=np.int32)
        for batch in batches:
            found = []
            for lo, hi, texts in text_slices(batch.column(0)):
                owner, bucket = _present(texts, place >= 0, bits, orders)
                found += np.split(place[bucket], np.searchsorted(owner, np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["label", "features"])

    def regress(batches):
        y, feature, sizes = [np.zeros(0)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for batch in batches:
            y.append(np.asarray(batch.column(0)).astype(np.float64))
            feature.append(np.asarray(batch.column(1).flatten()))
            sizes.append(np.asarray(pa.compute.list_value_length(batch.column(1))))
        y, feature, sizes = np.concatenate(y), np.concatenate(feature), np.concatenate(sizes)
        seen, owner = len(y), np.repeat(np.arange(len(y)), sizes)
        if not seen:
            return
        w, b = np.zeros(len(chosen)), np.log(n1 / n0)
        grad2_w, grad2_b = np.full(len(chosen), 1e-8), 1e-8
        for _ in range(steps):
            z = b + np.bincount(owner, (ratio * w)[feature], minlength=seen)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g = np.bincount(feature, err[owner], minlength=len(chosen)) * ratio / seen + l2 / len(chosen) * w
            gb = err.mean()
            grad2_w += g * g
            grad2_b += gb * gb
            w -= 0.3 * g / np.sqrt(grad2_w)
            b -= 0.3 * gb / np.sqrt(grad2_b)
        yield pa.RecordBatch.from_arrays([pa.array([(ratio * w).astype(np.float32).tobytes()]), pa.array([float(b)])], names=["w", "b"])

    learned = rows.mapInArrow(features, "label int, features array<int>").repartition(1).mapInArrow(regress, "w binary, b double").first()
    rows.unpersist()
    return {"chosen": chosen, "weights": np.frombuffer(learned["w"], np.float32), "bias": learned["b"], "bits": bits, "orders": orders}


def score(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.3, score_col: str = "score", flag_col: str = "predicted") -> DataFrame:
    """Adds the probability of toxicity and a 0/1 flag; reads each whole text once."""

    def make():
        bits = model["bits"]
        weights = np.zeros(1 << bits, np.float32)
        weights[model["chosen"]] = model["weights"]
        selected = weights != 0

        def fn(texts):
            z = np.full(len(texts), model["bias"])
            for lo, hi in chunked(texts):
                owner, bucket = _present(texts[lo:hi], selected, bits, model["orders"])
                z[lo:hi] += np.bincount(owner, weights[bucket], minlength=hi - lo)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return p, (p >= threshold).astype(np.int32)

        return fn

    return append_columns(docs, [T.StructField(score_col, T.DoubleType()), T.StructField(flag_col, T.IntegerType())], make, text_col)
