"""LM scoring: log-likelihoods of whole documents under a recurrent model.

Tokens are words (runs of other than the six ASCII blanks, A-Z lower-cased) and
one end for each document. Counts cover all training documents and stay a
table; only a head of at most `HEAD` words is sent to tasks, and the tokens
beyond it meet their counts in a join.

Model. The `heads * width` most frequent words have their own slot in the
class-factored softmax. All other words fall into `TAILS` further classes by
their first two bytes; within such a class a word has the probability
(c + 1) / (N + V + 1) of the class's own counts, so that one unseen word per
class has a share too. A gated recurrent network predicts the class and slot
from all earlier tokens of the document. It is warmed up on about `WARM_TOKENS`
tokens of documents drawn from all partitions, in one task;
then every partition of all training documents trains its own copy by truncated
backpropagation, and the copies are averaged by tokens, in two rounds of
partial sums: every training token is learned from, and scores depend a little
on how the documents are dealt over partitions. Scoring carries the state from window to window through the
whole document.

Defined cases: a null text is empty and holds just the end; repeated rows get
equal scores and count as often as they stand there; without training documents
all counts are 0 and both scores come from the single unseen event; an empty
table gives an empty result; columns of the new names are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from recordforge.llm import gru
from recordforge.llm.textarrays import Powers, byte_words, column_slices
from recordforge.sources.tables import materialise

HEAD, HEADS, WIDTH, TAILS, HIDDEN = 131_072, 48, 64, 32, 16
LANES, WINDOW, RATE, WARM_TOKENS = 512, 16, 0.1, 600_000
#: Key of the end token.
END = 0x5D1F3A7792C0E4B1
#: Tokens that are trained on or counted together; bytes of text that are scored, and split into tokens, together.
BATCH, SCORED, SPLIT = 500_000, 5_000_000, 300_000


class Tokenizer:
    """Token hashes of all texts with their ends, the tail class of each, and the tokens per text; works on UTF-8 bytes."""

    def __init__(self) -> None:
        self.powers = Powers()
        self.inside = np.ones(256, bool)
        self.inside[[9, 10, 11, 12, 13, 32]] = False
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32
        self.values = self.lower.astype(np.uint64) + np.uint64(1)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, begin, end, first, raw = byte_words(column, self.inside, self.values, self.powers)
        c0, c1 = self.lower[raw[begin]], np.where(end - begin > 1, self.lower[raw[np.minimum(begin + 1, len(raw) - 1)]], 0).astype(np.uint32)
        tail = (((c0 * np.uint32(0x9E3779B1) + c1 * np.uint32(0x85EBCA77)) >> np.uint32(16)).astype(np.int32) % TAILS).astype(np.int16)
        at = first[1:]
        return np.insert(h, at, np.uint64(END)), np.insert(tail, at, 0), np.diff(first) + 1


def count_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, tail, n) of all texts; tasks add up large batches first."""

    def run(batches):
        tokens = Tokenizer()
        held, size = [], 0

        def flush():
            h = np.concatenate([a for a, _ in held])
            t = np.concatenate([b for _, b in held])
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(t[at], pa.int16()), pa.array(n)], names=["token", "tail", "n"])

        for batch in batches:
            for _, _, part in column_slices(batch.column(0), SPLIT):
                h, t, _ = tokens(part)
                held.append((h, t))
                size += len(h)
                if size > BATCH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token long, tail short, n long").groupBy("token").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> dict:
    """What tasks need of the counts: the head by hash, ranks of its first words, class totals."""
    level = (F.log2("n") * 16).cast("int")
    steps = sorted(((r["k"], r["w"]) for r in counts.groupBy(level.alias("k")).agg(F.count("*").alias("w")).collect()), reverse=True)
    least, held = 1 << 30, 0
    for k, w in steps:
        if held + w > HEAD:
            break
        least, held = k, held + w
    head = counts.filter(level >= least).toPandas()
    head = head.sort_values(["n", "token"], ascending=[False, True], kind="stable")
    by_tail = {r["tail"]: (r["n"], r["v"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    k = HEADS * WIDTH
    slots = head["n"].to_numpy(np.int64)[:k]
    tail_n, tail_v = (np.array([by_tail.get(t, (0, 0))[i] for t in range(TAILS)], np.int64) for i in (0, 1))
    np.subtract.at(tail_n, head["tail"].to_numpy(np.int64)[:k], slots)
    np.subtract.at(tail_v, head["tail"].to_numpy(np.int64)[:k], 1)
    key = head["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    classes = np.concatenate([np.add.reduceat(np.pad(slots, (0, k - len(slots))), np.arange(0, k, WIDTH)), tail_n])
    return {"key": key[order], "n": head["n"].to_numpy(np.int64)[order], "rank": np.where(order < k, order, -1).astype(np.int32), "slots": slots, "classes": classes, "tail_n": tail_n, "tail_v": tail_v, "N": sum(n for n, _ in by_tail.values()), "V": sum(v for _, v in by_tail.values())}


class Head:
    """Looks tokens up among the head: count (0 if not there), model input, class and slot of each.

    Keys are spread evenly, so the place of a key's leading bits is at most a few keys from it.
    """

    def __init__(self, vocab: dict) -> None:
        self.key, self.n, self.rank = (np.append(vocab[k], x) for k, x in (("key", np.uint64(0)), ("n", 0), ("rank", -1)))
        self.shift = np.uint64(64 - max(1, int(len(vocab["key"])).bit_length() + 2))
        lead = (vocab["key"] >> self.shift).astype(np.int64)
        places = np.bincount(lead, minlength=1 << int(np.uint64(64) - self.shift))
        self.first, self.most = (np.cumsum(places) - places).astype(np.int32), int(places.max(initial=0))

    def __call__(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, ...]:
        at, last = self.first[(h >> self.shift).astype(np.int64)], len(self.key) - 1
        found = np.full(len(h), last, np.int32)
        for k in range(self.most):
            here = np.minimum(at + k, last)
            hit = self.key[here] == h
            found[hit] = here[hit]
        n, rank = self.n[found], self.rank[found]
        own = rank >= 0
        return n, np.where(own, rank, HEADS * WIDTH + tail).astype(np.int32), np.where(own, rank // WIDTH, HEADS + tail).astype(np.int32), np.where(own, rank % WIDTH, 0).astype(np.int32)


START = HEADS * WIDTH + TAILS


def _previous(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The model's input for each token: the token before, or the start."""
    x = np.empty_like(ids)
    x[1:] = ids[:-1]
    x[np.cumsum(sizes) - sizes] = START
    return x


def _train_on(batches, vocab: dict, p: dict, past: dict) -> int:
    tokens, look_up, held, size, seen = Tokenizer(), Head(vocab), [], 0, 0

    def go():
        x, c, s = (np.concatenate([h[i] for h in held]) for i in range(3))
        gru.train(p, past, x, c, s, LANES, WINDOW, RATE)
        held.clear()

    for batch in batches:
        for _, _, part in column_slices(batch.column(0), SPLIT):
            h, tail, sizes = tokens(part)
            _, ids, c, s = look_up(h, tail)
            held.append((_previous(ids, sizes), c, s))
            size += len(h)
            seen += len(h)
            if size >= BATCH:
                go()
                size = 0
    if held:
        go()
    return seen


def fit(train: DataFrame, text_col: str, vocab: dict) -> dict:
    """The averaged model; every training document is learned from in its own partition."""
    docs = train.select(F.col(text_col).alias("text"))
    first = gru.new(vocab["slots"], vocab["classes"], HEADS, WIDTH, HIDDEN)

    def warm(batches):
        p, past = {k: v.copy() for k, v in first.items()}, gru.fresh_past(first)
        _train_on(batches, vocab, p, past)
        yield pa.RecordBatch.from_arrays([pa.array([gru.pack(p)]), pa.array([gru.pack(past)])], names=["p", "past"])

    # Rows from all partitions, so many that about WARM_TOKENS tokens come.
    share = F.pmod(F.xxhash64(F.lit("warm"), F.monotonically_increasing_id()), F.lit(1_000_003)) <= int(1_000_003 * WARM_TOKENS / max(1, vocab["N"]))
    got = docs.filter(share).repartition(1).mapInArrow(warm, "p binary, past binary").first()
    if got is None:
        return first
    start, start_past = (gru.unpack(got[k], first) for k in ("p", "past"))
    blocks = 16

    def learn(batches):
        p, past = ({k: v.copy() for k, v in q.items()} for q in (start, start_past))
        n = _train_on(batches, vocab, p, past)
        if n:
            parts = np.array_split(np.frombuffer(gru.pack(p), np.float32).astype(np.float64) * n, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in parts]), pa.array([n] * blocks)], names=["block", "sum", "n"])

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for b, x, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = sums.setdefault(b, [0.0, 0])
                s[0] = s[0] + np.frombuffer(x, np.float32).astype(np.float64)
                s[1] += n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype(np.float32).tobytes() for s, _ in sums.values()]), pa.array([n for _, n in sums.values()])], names=["block", "sum", "n"])

    schema = "block int, sum binary, n long"
    copies = docs.mapInArrow(learn, schema).withColumn("lot", F.spark_partition_id() % 64)
    partial = copies.repartition("block", "lot").select("block", "sum", "n").mapInArrow(add, schema)
    total = sorted(partial.repartition("block").mapInArrow(add, schema).collect(), key=lambda r: r["block"])
    if not total:
        return start
    flat = np.concatenate([np.frombuffer(r["sum"], np.float32).astype(np.float64) / r["n"] for r in total]).astype(np.float32)
    return gru.unpack(flat.tobytes(), first)


def _score_batch(p: dict, ids: np.ndarray, classes: np.ndarray, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log-probability of each document; all advance side by side, the longest first."""
    x = _previous(ids, sizes)
    order = np.argsort(-sizes, kind="stable")
    first, left = (np.cumsum(sizes) - sizes)[order], sizes[order]
    total = np.zeros(len(sizes))
    h = np.zeros((HIDDEN, len(sizes)), np.float32)
    t = 0
    while (active := int(np.searchsorted(-left, -t, "left"))) > 0:
        span = int(min(max(8192 // active, 16), 2048, left[0] - t))
        steps = np.arange(t, t + span)[:, None]
        inside = steps < left[None, :active]
        at = np.where(inside, first[None, :active] + steps, first[None, :active])
        hs, _ = gru.states(p, x[at], h[:, :active])
        h[:, :active] = hs[-1]
        rows, flat = np.flatnonzero(inside.ravel()), at.ravel()
        got = gru.log_probs(p, gru.by_token(hs)[rows], classes[flat[rows]], slots[flat[rows]])
        total[order[:active]] += np.bincount(rows % active, got, minlength=active)
        t += span
    return total


def score(docs: DataFrame, train: Column, text_col: str = "text", held_out_col: str = "held_out") -> DataFrame:
    """Adds held_out, n_tokens, n_known, train_tokens, base_score and score (log10) to every row.

    `train` says which rows are learned from.
    """
    new = [held_out_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*new).withColumn(held_out_col, ~train)
    learn = docs.filter(~F.col(held_out_col))
    counts = materialise(count_tokens(learn, text_col), "lm-counts")
    vocab = vocabulary(counts)
    p = fit(learn, text_col, vocab)
    whole = math.log10(vocab["N"] + vocab["V"] + 1)
    tail_log = np.log10(vocab["tail_n"] + vocab["tail_v"] + 1)

    def run(batches):
        tokens, look_up = Tokenizer(), Head(vocab)
        for batch in batches:
            for lo, hi, texts in column_slices(batch.column(batch.num_columns - 1), SCORED):
                parts = [tokens(q) for _, _, q in column_slices(texts, SPLIT)]
                h, tail, sizes = (np.concatenate([q[i] for q in parts]) for i in range(3))
                n, ids, c, s = look_up(h, tail)
                owner = np.repeat(np.arange(hi - lo), sizes)
                sums = lambda v: np.bincount(owner, v, minlength=hi - lo)  # noqa: B023, E731
                log_n, in_tail = np.log10(n + 1.0), c >= HEADS
                base = sums(log_n) - sizes * whole
                model = _score_batch(p, ids, c, s, sizes) / math.log(10) + sums(np.where(in_tail, log_n - tail_log[tail], 0.0))
                far = np.flatnonzero(n == 0)
                pairs = np.lexsort((h[far], owner[far]))
                fo, fh = owner[far][pairs], h[far][pairs]
                edge = np.ones(len(fo), bool)
                edge[1:] = (fo[1:] != fo[:-1]) | (fh[1:] != fh[:-1])
                at = np.flatnonzero(edge)
                times = np.diff(np.append(at, len(fo))).astype(np.int32)
                cuts = pa.array(np.searchsorted(fo[at], np.arange(hi - lo + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)), pa.array(sizes.astype(np.int64)), pa.array(sums(n > 0).astype(np.int64)), pa.array(base), pa.array(model), pa.ListArray.from_arrays(cuts, pa.array(fh[at].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times))], names=[*batch.schema.names[:-1], "n_tokens", "_near", "_base", "_model", "_far", "_times"])

    others = [c for c in docs.columns if c != text_col]
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).alias("_text"))
    schema = T.StructType([*numbered.schema.fields[:-1], *T.StructType.fromDDL("n_tokens long, _near long, _base double, _model double, _far array<long>, _times array<int>").fields])
    scored = materialise(numbered.mapInArrow(run, schema), "lm-scored")
    far = scored.select("_row", F.explode(F.arrays_zip("_far", "_times")).alias("_f")).select("_row", F.col("_f._far").alias("token"), F.col("_f._times").alias("_times"))
    rest = far.join(counts.select("token", "n"), "token").groupBy("_row").agg(F.sum("_times").alias("_known"), F.sum(F.col("_times") * F.log10(F.col("n") + 1.0)).alias("_log"))
    log = F.coalesce("_log", F.lit(0.0))
    return scored.drop("_far", "_times").join(rest, "_row", "left").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], "n_tokens", (F.col("_near") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(vocab["N"])).cast("long").alias("train_tokens"), (F.col("_base") + log).alias("base_score"), (F.col("_model") + log).alias("score"))
