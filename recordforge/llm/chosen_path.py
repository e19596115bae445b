"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed five-word shingles (lower-cased runs of letters
and digits). Documents with the same words are one set, of some weight. Sets
whose Jaccard similarity is at least `threshold` are linked; a class is a
connected component of the links.

Chosen path. The root of a run splits all sets on a sampled token: a minhash of
the set, so that two sets follow the same path with the probability of their
similarity. A node of up to `SMALL` sets is a leaf. Of a larger one about `SAMPLED`
sets are looked at. If `GROUP` of them are near as many others, the node holds a
group of near copies and is not split, as that would only part similar sets.
Else it is split once more, on every sampled token but those of boilerplate, which
more than `COMMON` of its sets have. Children of up to `SMALL` sets are leaves,
each of those sets to which it is among their rarest: a set goes to one child more
than it may lack equal tokens, those that it shares with no other set counted first,
so that no pair with `least_matches` equal tokens is lost (`_rarest`).
Larger ones are looked at in the same way: a large group of near copies has
children that are little else, and each set goes on to `CHOSEN` of those at the
most; the others hold boilerplate only, and what is similar in them mostly meets in
other children. Runs repeat until the chance that a pair at the
threshold shares no root is below `1 - RECALL`. Only ids and node keys are shuffled.

What is left. A pair that meets in no child which is compared has all its equal
tokens in the others, so both its sets have `least_matches` tokens there or more. All such
sets are kept and, once classes are known, meet exactly: two similar sets share one
of their rarest shingles, of which each set has one more than it may lack. Most
sets have that many shingles that no other has, and drop out before any join; the
shingles of the rest are nodes, and in a node the sets outside its largest class are
compared with all, in blocks as below. So no pair is lost by the bounds on children.

Leaves are brute-forced twice. First on the sampled tokens, 16 bits of each: a
pair needs `least_matches` equal ones, which a pair at the threshold misses with
a chance below 1e-4. What is connected so is a bucket, equal buckets of several
runs are one, and a bucket's shingles are compared exactly, all pairs. A bucket
of up to `LISTED` sets returns all links, a larger one such as connect its sets.

A large node that holds a group is dealt in slices of bounded numbers of sets and
shingles. About `REPRESENTATIVES` of its sets go to every slice and are compared
exactly with all sets there: as many rows as the node has sets, and a few. Sets
that a representative connects are in one class and are not compared with each
other. Only the sets outside the node's largest class so far meet all slices, in
blocks, so a pair of different classes is lost in no node. Every block returns
links that connect its sets, at most one for each set.

`n_links` counts all documents (copies with them) of its class that a document is
similar to. The links above may be fewer, so they are counted once classes are
known: a class's sets are dealt in slices, each pair of slices is a block that is
compared exactly and returns a number for each set, no pairs. So memory is that of
a block; work grows with the square of the different sets of a class, and what is
shuffled with that square over `SLICE`, in as many tasks as there are blocks.

Defined cases: null ids take no part and have no class; a null text, or one
without words, is a class of its own; a text of fewer than five words is one
shingle of all its words; repeated rows are copies and so linked; rows of the
same id and different texts are different documents that share the id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from recordforge.llm.components import components
from recordforge.llm.textarrays import ODD64, Powers, alnum_table, chunked, column_slices, encode, mix, text_slices, words
from recordforge.sources.tables import discard, few_tasks, materialise

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Leaf size; sets that are looked at in a larger node, how near they are to a group's, and its least share; share of a node that boilerplate exceeds.
SMALL, SAMPLED, NEAR, GROUP, COMMON = 512, 64, 0.13, 0.3, 0.4
#: Sampled tokens are as many as runs of so many levels would take; large children that a set of a split node goes on to.
LEVELS, CHOSEN = 4, 4
#: For `few_tasks`: the rows of a few numbers that a row with a list of sampled tokens, or a text, is as much work as; shingles of a set, more than most have.
WIDE, TEXT, LONG = 8, 16, 1024
#: Sets of a bucket whose links are all listed. Of a large node: representatives, sets and shingles of a slice.
LISTED, REPRESENTATIVES, SLICE, SHINGLES = 64, 32, 512, 2_000_000
#: Bits, as a power of two, that tell which texts are not needed.
BITS = 26


def runs_needed(levels: int, similarity: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs after which a pair has stayed together in one with the chance `recall`, at that depth."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**levels))


def least_matches(tokens: int, similarity: float, miss: float = 1e-4) -> int:
    """Equal tokens, of so many sampled, that a pair at that similarity falls short of with a chance below `miss`."""
    below = 0.0
    for m in range(tokens + 1):
        below += math.comb(tokens, m) * similarity**m * (1 - similarity) ** (tokens - m)
        if below >= miss:
            return m
    return tokens


def _shingles(texts: list, table: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each text's word sequence, its number of shingles, and all shingles, one text after the other.

    A text of n words has n - 4 shingles, one if n is 1 to 4, none if it is 0.
    """
    codes, starts, lens = encode(texts)
    h, _, _, first = words(codes, starts, lens, table, powers)
    n = np.diff(first)
    up, down = powers.upto(len(h) + 2)
    pre = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(ODD64[4])) * up[: len(h)], out=pre[1:])
    a, b = first[:-1], first[1:]
    whole = mix(((pre[b] - pre[a]) * down[a]) ^ (n.astype(np.uint64) * np.uint64(ODD64[0])))
    m = max(0, len(h) - WORDS + 1)
    s = np.zeros(m, np.uint64)
    for k in range(WORDS):
        s += h[k : k + m] * np.uint64(ODD64[k])
    s = mix(s)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    if m and (n >= WORDS).all():
        owner = np.repeat(np.arange(len(texts)), n)
        flat = s[owner[: m] == owner[WORDS - 1 :]]
    else:
        flat = np.concatenate([np.zeros(0, np.uint64), *(s[x : y - WORDS + 1] if k >= WORDS else whole[i : i + min(k, 1)] for i, (x, y, k) in enumerate(zip(a.tolist(), b.tolist(), n.tolist())))])
    return whole, count, flat


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _fixed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def signatures(docs: DataFrame, text_col: str, id_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, text_hash, set, size, sig, sketch) of the rows with an id.

    sig: the token that begins each run. sketch: 16 bits of these and of every
    run's token for each deeper level. A text without words has size 0 and zeros.
    """
    runs = runs_needed(LEVELS, threshold)
    every = runs * LEVELS

    def run(batches):
        table, powers = alnum_table(), Powers()
        seeds = mix(np.arange(1, every + 1, dtype=np.uint64) * np.uint64(ODD64[1]))
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(2)):
                whole, count, flat = _shingles(texts, table, powers)
                some = np.flatnonzero(count)
                sig, sketch = np.zeros((hi - lo, runs), np.uint64), np.zeros((hi - lo, every), np.uint16)
                at = np.cumsum(count[some]) - count[some]
                for k in range(every if len(some) else 0):
                    x = (flat ^ seeds[k]) * np.uint64(ODD64[2])
                    x ^= x >> np.uint64(29)
                    x *= np.uint64(ODD64[4])
                    least = np.minimum.reduceat(x, at)
                    sketch[some, k] = least & np.uint64(0xFFFF)
                    if k < runs:
                        sig[some, k] = least
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * runs, pa.int32()), pa.array(_signed(sig.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(_signed(whole)), pa.array(count, pa.int64()), lists, _fixed(sketch)], names=["doc", "text_hash", "set", "size", "sig", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).filter("doc is not null").mapInArrow(run, "doc long, text_hash long, set long, size long, sig array<long>, sketch binary")


class _Found:
    """Tables of one name and schema that are read as one."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def read(self) -> DataFrame | None:
        out = None
        for part in self.parts:
            out = part if out is None else out.unionByName(part)
        return out


def _groups(big: DataFrame, sets: DataFrame, threshold: float, rows: int) -> DataFrame:
    """(key) of the large nodes that hold a group: `GROUP` of the sets drawn are near as many of them. rows: those of `big`, or more."""

    def run(batches):
        held: list[tuple[int, bytes]] = []

        def group() -> bool:
            s = np.frombuffer(b"".join(x for _, x in held), np.uint16).reshape(len(held), -1)
            near = np.array([((s == row).mean(1) >= threshold - NEAR).sum() - 1 for row in s])
            return (near >= max(1, GROUP * (len(s) - 1))).sum() >= GROUP * len(s)

        for batch in batches:
            found = []
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and held[0][0] != row[0]:
                    if group():
                        found.append(held[0][0])
                    held.clear()
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["key"])
        if held and group():
            yield pa.RecordBatch.from_arrays([pa.array([held[0][0]])], names=["key"])

    few = big.filter(F.pmod(F.xxhash64("set", "key", F.lit("drawn")), F.col("n")) < SAMPLED)
    drawn = few.join(sets.select("set", "sketch"), "set").select("key", "sketch").repartition("key")
    return few_tasks(drawn, WIDE * rows * SAMPLED // SMALL).sortWithinPartitions("key").mapInArrow(run, "key long")


def _rarest(split: DataFrame, width: int, cut: int, rows: int) -> DataFrame:
    """(key, set) of the rarest children of each set of a split node, as many as pairs need to meet in one.

    split: (key, set, child, m, w) of small children of `rows` keys and sets, each for `w` with the same sets,
    and rows without a child for the `w` that are not small. Pairs with `cut` equal
    tokens of `width` differ in the others only. In one order of all children, those of
    no other set first, then small ones from the rarest on, the first that both sets
    have is among the first `width - cut + 1` of each, if they share a small one.
    """
    node = Window.partitionBy("key", "set")
    before = F.coalesce(F.sum("w").over(node.orderBy(F.col("child").isNull(), "m", "child").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alone = width - F.sum("w").over(node)
    placed = split.select("key", "set", "child", before.alias("_before"), alone.alias("_alone"))
    return few_tasks(placed, width * rows).filter(F.col("child").isNotNull() & (F.col("_alone") + F.col("_before") <= width - cut)).select(F.col("child").alias("key"), "set")


def grow(sets: DataFrame, threshold: float, scratch: list, left: list | None = None, n: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Leaves (key, set), and large nodes that hold groups, of as many runs as the target recall needs.

    A pair that shares a run's first token is together in a leaf, in a node that
    holds a group, or in one that is split on all tokens. Of the last kind, sets
    that may be similar to others which they meet in no child that is compared
    are appended to `left`, as a table (set); `prefixes` is for them. n: the number of sets.
    """
    leaves, large = _Found(), _Found()

    def keep(df: DataFrame, name: str, rows: int) -> DataFrame:
        scratch.append(materialise(few_tasks(df, rows), name))
        return scratch[-1]

    placed = (sets.count() if n is None else n) * runs_needed(1, threshold)
    roots = sets.select("set", F.posexplode(F.slice("sig", 1, runs_needed(1, threshold))).alias("run", "token")).select("set", F.xxhash64("run", "token").alias("key"))
    # Written before the join, so that both its sides are plain exchanges, which Spark splits where a key is hot.
    sizes = keep(roots.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "path-sizes", placed)
    nodes = keep(roots.join(sizes, "key"), "path-nodes", placed)
    leaves.parts.append(nodes.filter(F.col("n") <= SMALL).select("key", "set"))
    big = nodes.filter(F.col("n") > SMALL)
    if big.isEmpty():
        return leaves.read(), None
    groups = keep(_groups(big, sets, threshold, placed), "path-groups", placed)
    large.parts.append(big.join(groups, "key").select("key", "set"))
    token = lambda i: F.xxhash64("key", i, F.substring("sketch", (i * 2 + 1).cast("int"), F.lit(2)))
    apart = big.join(groups, "key", "left_anti").join(sets.select("set", "sketch"), "set")
    apart = keep(apart.select("key", "set", "n", F.transform(F.sequence(F.lit(0), F.lit(runs_needed(LEVELS, threshold) * LEVELS - 1)), token).alias("children")), "path-apart", WIDE * placed)
    n_apart = apart.count()
    if not n_apart:
        return leaves.read(), large.read()
    width = runs_needed(LEVELS, threshold) * LEVELS
    cut = least_matches(width, threshold)
    tokens = n_apart * width
    children = apart.select("key", "set", "n", F.explode("children").alias("child"))
    who = F.bit_xor(F.xxhash64("set", F.lit("who"))).alias("who")
    sized = keep(children.groupBy("child").agg(F.count("*").alias("m"), F.first("n").alias("_n"), F.first("key").alias("_key"), who).filter("m > 1"), "path-child-sizes", tokens)
    held = sized.filter(F.col("m") <= COMMON * F.col("_n")).select("_key", "child", "m", "who")
    # Similar sets meet in most of their children. Of small ones with the same sets, by a hash of them, one stands for all of its node.
    small = keep(held.filter(F.col("m") <= SMALL).groupBy("_key", "who", "m").agg(F.min("child").alias("child"), F.count("*").alias("w")).select("child", "m", "w"), "path-children-once", tokens)
    wide = keep(held.filter(F.col("m") > SMALL).select("child", F.col("m").alias("n")), "path-children-wide", tokens)
    # At most so many a token as `COMMON` fits into 1, so a list for each node.
    broad = keep(sized.filter(F.col("m") > COMMON * F.col("_n")).groupBy("_key").agg(F.collect_list("child").alias("_broad")), "path-children-broad", n_apart)
    apart = apart.join(broad, F.col("key") == F.col("_key"), "left").withColumn("children", F.coalesce(F.array_except("children", "_broad"), "children"))
    apart = keep(apart.select("key", "set", "n", "children"), "path-apart-open", WIDE * n_apart)
    children = apart.select("key", "set", "n", F.explode("children").alias("child"))
    shut = apart.select("key", "set", (width - F.size("children")).cast("long").alias("w")).filter("w > 0")
    if not wide.isEmpty():
        shut = shut.unionByName(likely(children.select("key", "set", "child"), "child", wide).groupBy("key", "set").agg(F.count("*").alias("w")))
    split = children.select("key", "set", "child").join(small, "child")
    split = keep(split.unionByName(shut, allowMissingColumns=True), "path-children", tokens)
    leaves.parts.append(_rarest(split, width, cut, n_apart))
    chosen = None
    if not wide.isEmpty():
        of = lambda some: children.select("set", F.col("child").alias("key")).join(some.withColumnRenamed("child", "key"), "key")
        groups = keep(_groups(of(wide), sets, threshold, tokens).withColumnRenamed("key", "child"), "path-groups", tokens)
        if not groups.isEmpty():
            # By a hash of the child, the same for all sets that have it: a pair chooses alike at least as often as it is similar.
            chosen = children.join(groups, "child").groupBy("key", "set").agg(F.collect_list(F.struct(F.xxhash64("child", F.lit("chosen")).alias("h"), "child")).alias("_c"))
            chosen = keep(chosen.select("key", "set", F.slice(F.array_sort("_c"), 1, CHOSEN)["child"].alias("_c")), "path-chosen-children", n_apart)
            large.parts.append(chosen.select(F.explode("_c").alias("key"), "set"))
    if left is not None:
        # What meets in no child that is compared has its equal tokens, as many as leaves ask for, in those that are not.
        shut = split.filter("child is null").select("key", "set", F.col("w").alias("shut"))
        if chosen is not None:
            shut = shut.unionByName(chosen.select("key", "set", (-F.size("_c")).cast("long").alias("shut")))
        left.append(keep(shut.groupBy("key", "set").agg(F.sum("shut").alias("shut")).filter(F.col("shut") >= cut).select("set").distinct(), "path-left", n_apart))
    return leaves.read(), large.read()


def _labels(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each row of a symmetric boolean matrix is connected with."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def buckets(leaves: DataFrame, sets: DataFrame, threshold: float, n: int) -> DataFrame:
    """(bucket, set): the connected sets of each leaf by sampled tokens; equal ones of several leaves once. n: the number of sets."""
    width = runs_needed(LEVELS, threshold) * LEVELS
    cut = least_matches(width, threshold)

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.uint16))

        def work(key, ids, sketch):
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            size = np.diff(edge)
            out = []
            two = edge[:-1][size == 2]
            two = two[(sketch[two] == sketch[two + 1]).sum(1) >= cut]
            out.append(np.stack((ids[two], ids[two + 1]), 1).reshape(-1, 2))
            rest: list[np.ndarray] = []
            for a, m in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist()):
                s = sketch[a : a + m]
                same = np.zeros((m, m), np.uint8)
                for column in s.T:
                    same += column[:, None] == column[None, :]
                linked = same >= cut
                np.fill_diagonal(linked, False)
                if linked.any():
                    label = _labels(linked)
                    rest += [ids[a : a + m][label == k] for k in np.flatnonzero(np.bincount(label, minlength=m) > 1)]
            pairs = out[0]
            h = mix(pairs.ravel().view(np.uint64)).reshape(-1, 2)
            bucket = [np.repeat(_signed(mix((h[:, 0] ^ h[:, 1]) + np.uint64(2))), 2)]
            member = [pairs.ravel()]
            for r in rest:
                name = mix(np.bitwise_xor.reduce(mix(r.view(np.uint64))).reshape(1) + np.uint64(len(r)))
                bucket.append(np.repeat(_signed(name), len(r)))
                member.append(r)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(bucket)), pa.array(np.concatenate(member))], names=["bucket", "set"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = (np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, width))
            key, ids, sketch = (np.concatenate(x) for x in zip(held, new))
            last = int(np.searchsorted(key != key[-1], False)) if (key == key[-1]).all() else len(key) - int(np.argmax(key[::-1] != key[-1]))
            if last:
                yield work(key[:last], ids[:last], sketch[:last])
            held = (key[last:], ids[last:], sketch[last:])
        if len(held[0]):
            yield work(*held)

    placed = leaves.join(sets.select("set", "sketch"), "set").select("key", "set", "sketch")
    found = placed.repartition("key").sortWithinPartitions("key", "set").mapInArrow(run, "bucket long, set long").distinct()
    return few_tasks(found, n * runs_needed(1, threshold) * (width - cut + 1))


def _common(sizes: np.ndarray, shingles: list, rows: np.ndarray) -> np.ndarray:
    """Shingles that the sets at `rows` share with every set."""
    m = len(shingles)
    owner = np.repeat(np.arange(m), sizes)
    _, column, n = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    shared = n > 1
    renumber = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], renumber[column[keep]]
    width = int(shared.sum())
    common = np.zeros((len(rows), m), np.float32)
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    span = max(1, 8_000_000 // m)
    for lo in range(0, width, span):
        a, b = np.searchsorted(column, [lo, lo + span])
        dense = np.zeros((m, min(span, width - lo)), np.float32)
        dense[owner[a:b], column[a:b] - lo] = 1
        common += dense[rows] @ dense.T
    return common


def compare(ids: np.ndarray, side: np.ndarray, root: np.ndarray, shingles: list, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) of one block.

    Where all sides are 2: all links, of up to `LISTED` sets. Else links between
    sides 0 or 2 and any set, only such as connect sets that equal roots or
    earlier links do not.
    """
    order = np.lexsort((side, ids))
    order = order[np.concatenate(([True], ids[order][1:] != ids[order][:-1]))]  # a set that stands there twice
    ids, side, root, shingles = ids[order], side[order], root[order], [shingles[i] for i in order]
    rows = np.flatnonzero(side != 1)
    sizes = np.fromiter(map(len, shingles), np.int64, len(ids))
    if not len(rows) or len(ids) < 2:
        return ids[:0], ids[:0]
    common = _common(sizes, shingles, rows)
    linked = common >= threshold * (sizes[rows, None] + sizes[None, :] - common) - 1e-6
    linked[np.arange(len(rows)), rows] = False
    if (side == 2).all() and len(ids) <= LISTED:
        u, v = np.nonzero(np.triu(linked))
        return ids[u], ids[v]
    _, label = np.unique(root, return_inverse=True)
    us, vs = [], []
    for k, i in enumerate(rows):
        near = np.flatnonzero(linked[k] & (label != label[i]))
        if len(near):
            other, first = np.unique(label[near], return_index=True)
            us.append(np.full(len(first), ids[i]))
            vs.append(ids[near[first]])
            label[np.isin(label, other)] = label[i]
    return (np.concatenate(us), np.concatenate(vs)) if us else (ids[:0], ids[:0])


PLACE = "struct<block:bigint,slice:int,slices:int,other:int,others:int,side:int,root:bigint>"


def _place(block: str, slice_, slices, other, others, side: int, root):
    """Where a set is compared: in one slice, or (slice null) in all of them; `other` likewise."""
    as_int = lambda x: (F.lit(x) if x is None or isinstance(x, int) else x).cast("int")
    return F.struct(F.col(block).alias("block"), as_int(slice_).alias("slice"), as_int(slices).alias("slices"), as_int(other).alias("other"), as_int(others).alias("others"), as_int(side).alias("side"), root.cast("long").alias("root"))


def likely(rows: DataFrame, col: str, wanted: DataFrame) -> DataFrame:
    """The rows whose `col` may be in the first column of `wanted`, by one bit of its hash: all that are, and few others.

    The bits are a table of at most 2 ** (BITS - 15) rows of 4 KB, however many
    rows `wanted` has. Where it has far more than 2 ** BITS, more others come
    through; none is lost.
    """
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit("likely")), F.lit(1 << BITS))
    marks = wanted.select(bit(F.col(wanted.columns[0])).alias("_bit")).groupBy(F.shiftright("_bit", 15).alias("_lot")).agg(F.bitmap_construct_agg(F.col("_bit") % 32768).alias("_marks"))
    place = bit(F.col(col)) % 32768
    octet = F.conv(F.hex(F.substring("_marks", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    marked = rows.join(F.broadcast(marks), F.shiftright(bit(F.col(col)), 15) == F.col("_lot"))
    return marked.filter(F.getbit(octet, (place % 8).cast("int")) == 1).select(rows.columns)


def contents(places: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, id_col: str, scratch: list, n: int) -> DataFrame:
    """(set, places, shingles) of the sets that are compared, of `n` sets in all. places: (set, place)."""
    chosen = sets.select("set", "first").join(places.groupBy("set").agg(F.collect_list("place").alias("places")), "set")
    chosen = materialise(few_tasks(chosen.select("first", "set", "places"), WIDE * n), "path-chosen")
    scratch.append(chosen)
    rows = docs.select(F.col(id_col).cast("long").alias("first"), F.col(text_col).alias("text"))
    # The same plan at every size: the texts of these sets, and of few others, are shuffled once.
    texts = likely(rows, "first", chosen).hint("merge").join(chosen, "first").select("text", "set", "places")

    def shingle(batches):
        table, powers, seen = alnum_table(), Powers(), set()
        for batch in batches:
            want = np.asarray(batch.column(1))
            for lo, hi, texts in text_slices(batch.column(0)):
                whole, count, flat = _shingles(texts, table, powers)
                cuts = np.cumsum(count) - count
                right = []
                for i in np.flatnonzero(_signed(whole) == want[lo:hi]).tolist():  # not another text of the same id
                    if (s := int(want[lo + i])) not in seen:
                        seen.add(s)
                        right.append(i)
                part = batch.slice(lo, hi - lo).take(pa.array(right, pa.int64()))
                own = [np.unique(flat[cuts[i] : cuts[i] + count[i]]) for i in right]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([x.tobytes() for x in own], pa.binary())], names=["set", "places", "shingles"])

    return materialise(few_tasks(texts, TEXT * n).mapInArrow(shingle, f"set long, places array<{PLACE}>, shingles binary"), "path-contents")


def verify(content: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links of all blocks, by exact comparison of shingles; one of several blocks stands there for each. content: (set, places, shingles)."""
    every = lambda one, n: F.explode(F.when(F.col(one).isNull(), F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array(one)))
    placed = content.select("set", "shingles", F.explode("places").alias("_p")).select("set", "shingles", "_p.*")
    placed = placed.select("set", "shingles", "block", "side", "root", "other", "others", every("slice", "slices").alias("p")).select("block", "p", every("other", "others").alias("q"), "set", "side", "root", "shingles")
    blocks = placed.repartition("block", "p", "q").sortWithinPartitions("block", "p", "q")

    def run(batches):
        held: list[list] = [[], [], [], []]
        now = None

        def done():
            ids, side, root = (np.array(x, np.int64) for x in held[:3])
            return compare(ids, side, root, [np.frombuffer(x, np.uint64) for x in held[3]], threshold)

        for batch in batches:
            block, p, q = (np.asarray(batch.column(i)) for i in range(3))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            found = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                if a == b:
                    continue
                this = (int(block[a]), int(p[a]), int(q[a]))
                if this != now:
                    if now is not None:
                        found.append(done())
                    now = this
                    for x in held:
                        x.clear()
                for x, i in zip(held, range(3, 7)):
                    x += batch.column(i).slice(a, b - a).to_pylist()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["u", "v"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in done()], names=["u", "v"])

    return materialise(blocks.mapInArrow(run, "u long, v long"), "path-links")


def _dealt(large: DataFrame, sets: DataFrame, scratch: list, most: int) -> DataFrame:
    """(key, set, n, slices) of the sets of large nodes; `most` rows."""
    sized = materialise(few_tasks(large.join(sets.select("set", "size"), "set").select("key", "set", "size"), most), "path-large")
    rows = sized.count()
    shape = materialise(few_tasks(sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("_all")).select("key", "n", F.ceil(F.greatest(F.col("n") / SLICE, F.col("_all") / SHINGLES)).cast("int").alias("slices")), rows), "path-shape")
    dealt = materialise(few_tasks(sized.join(shape, "key").select("key", "set", "n", "slices"), rows), "path-dealt")
    scratch += [sized, shape, dealt]
    return dealt


def _slice_of(slices: str, salt: str):
    return F.pmod(F.xxhash64("set", F.lit(salt)), F.col(slices)).cast("int")


def _stars(dealt: DataFrame) -> DataFrame:
    """(set, place): every set in its slice, the representatives in all slices of their node."""
    chosen = F.pmod(F.xxhash64("set", "key"), F.col("n")) < REPRESENTATIVES
    member = _place("key", _slice_of("slices", "slice"), 1, 0, 1, 1, F.col("set"))
    first = _place("key", None, F.col("slices"), 0, 1, 0, F.col("set"))
    return dealt.select("set", F.explode(F.array_compact(F.array(member, F.when(chosen, first)))).alias("place"))


def _rest(dealt: DataFrame, roots: DataFrame, scratch: list) -> DataFrame:
    """(set, place): the sets outside a node's largest class in blocks, each with every slice of the node."""
    rows = dealt.count()
    rooted = materialise(few_tasks(dealt.join(roots, F.col("set") == F.col("node"), "left").select("key", "set", "n", "slices", F.coalesce("root", "set").alias("root")), rows), "path-rooted")
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    others = parts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.first("n") - F.max("c")).alias("left")).filter(F.col("left") > 0)
    others = materialise(few_tasks(others, rows), "path-left")
    scratch += [rooted, others]
    judged = rooted.join(others, "key").withColumn("blocks", F.ceil(F.greatest(F.col("left") / SLICE, F.col("left") / F.col("n") * F.col("slices"))).cast("int"))
    member = _place("key", _slice_of("slices", "slice"), 1, None, F.col("blocks"), 1, F.col("root"))
    apart = _place("key", None, F.col("slices"), _slice_of("blocks", "block"), 1, 0, F.col("root"))
    return judged.select("set", F.explode(F.array_compact(F.array(member, F.when(F.col("root") != F.col("main"), apart)))).alias("place"))


def prefixes(left: DataFrame, content: DataFrame, roots: DataFrame, threshold: float, scratch: list) -> DataFrame:
    """(key, set): nodes in which all similar sets of `left` meet that have different roots so far.

    Sets that are similar share one of their rarest shingles: of so many as are
    more than those that they may differ in. Each such shingle that several sets
    have is a node. Most sets have too many shingles of their own and go to none;
    a node whose sets are of one class, or are those of another node, is left out.
    """

    many = left.count() * LONG

    def keep(df: DataFrame, name: str) -> DataFrame:
        scratch.append(materialise(few_tasks(df, many), name))
        return scratch[-1]

    def explode(batches):
        for batch in batches:
            for lo, hi, part in column_slices(batch.column(1)):
                own = [np.frombuffer(x, np.int64) for x in part.to_pylist()]
                size = np.fromiter(map(len, own), np.int64, len(own))
                ids = np.asarray(batch.column(0))[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, size)), pa.array(np.repeat(size, size)), pa.array(np.concatenate(own))], names=["set", "size", "shingle"])

    rows = lambda wanted: likely(content.select("set", "shingles"), "set", wanted).mapInArrow(explode, "set long, size long, shingle long")
    least = F.ceil(threshold * F.col("size") - 1e-6)
    # Written before the joins, so that both their sides are plain exchanges, which Spark splits where a key is hot.
    counts = keep(rows(left).groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"), "path-shared")
    able = keep(likely(rows(left), "shingle", counts).groupBy("set").agg(F.count("*").alias("c"), F.first("size").alias("size")).filter(F.col("c") >= least).select("set"), "path-able")
    ordered = rows(able).join(counts, "shingle").groupBy("set").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("_s"))
    # Shingles of no other set are rarer still, so they stand in front of the list.
    first = F.greatest(F.size("_s") - least + 1, F.lit(0)).cast("int")
    listed = ordered.select("set", F.explode(F.slice("_s", 1, first)["shingle"]).alias("shingle")).select(F.xxhash64("shingle", F.lit("prefix")).alias("key"), "set")
    nodes = keep(listed.join(roots, F.col("set") == F.col("node"), "left").select("key", "set", F.coalesce("root", "set").alias("root")), "path-prefixes")
    apart = nodes.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("set", F.lit("who"))).alias("who"), F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a < _b")
    return keep(nodes.select("key", "set").join(keep(apart.groupBy("who", "m").agg(F.min("key").alias("key")).select("key"), "path-prefixes-once"), "key"), "path-prefixes")


def count_links(ids: np.ndarray, side: np.ndarray, weight: np.ndarray, shingles: list, threshold: float) -> np.ndarray:
    """Weights of the sets that each set of a block is similar to: any two of side 2, or one of side 0 and one of side 1."""
    out = np.zeros(len(ids), np.int64)
    rows = np.flatnonzero(side != 1)
    if not len(rows) or len(ids) < 2:
        return out
    sizes = np.fromiter(map(len, shingles), np.int64, len(ids))
    common = _common(sizes, shingles, rows)
    linked = common >= threshold * (sizes[rows, None] + sizes[None, :] - common) - 1e-6
    linked[np.arange(len(rows)), rows] = False
    linked[:, side == 0] = False
    out[rows] = linked @ weight
    ends = side == 1
    out[ends] = weight[rows] @ linked[:, ends]
    return out


def all_links(content: DataFrame, sets: DataFrame, roots: DataFrame, threshold: float, scratch: list, n: int) -> DataFrame:
    """(set, links) of the sets that have links: the weights of all sets of its class that are similar, by exact comparison. n: the number of sets."""
    member = materialise(few_tasks(roots.select(F.col("node").alias("set"), "root").join(sets.select("set", "weight", "size"), "set"), n), "path-members")
    shape = materialise(few_tasks(member.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / SLICE, F.sum("size") / SHINGLES)).cast("int").alias("slices")), n), "path-classes-shape")
    dealt = materialise(few_tasks(member.join(shape, "root").select("set", "root", "weight", "slices", _slice_of("slices", "count").alias("own")), n), "path-counted")
    scratch += [member, shape, dealt]
    meets = content.select("set", "shingles").join(dealt, "set").select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    placed = meets.select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "set", side.cast("long").alias("side"), "weight", "shingles")

    def run(batches):
        held: list[list] = [[], [], [], []]
        now = None

        def done():
            ids, side, weight = (np.array(x, np.int64) for x in held[:3])
            n = count_links(ids, side, weight, [np.frombuffer(x, np.uint64) for x in held[3]], threshold)
            for x in held:
                x.clear()
            return ids[n > 0], n[n > 0]

        for batch in batches:
            at = [np.asarray(batch.column(i)) for i in range(3)]
            cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in at])) + 1
            found = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at[0])]):
                if a == b:
                    continue
                this = tuple(int(x[a]) for x in at)
                if now is not None and this != now:
                    found.append(done())
                now = this
                for x, i in zip(held, range(3, 7)):
                    x += batch.column(i).slice(a, b - a).to_pylist()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["set", "links"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in done()], names=["set", "links"])

    blocks = placed.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")
    return few_tasks(blocks.mapInArrow(run, "set long, links long").groupBy("set").agg(F.sum("links").alias("links")), n)


def classes(docs: DataFrame, text_col: str, id_col: str, threshold: float, ids: DataFrame | None = None, links_too: bool = True) -> tuple[DataFrame, DataFrame]:
    """Signatures of the rows with an id, and (set, first, root, weight, links) of all sets.

    With `ids`, only rows of these ids take part. Without `links_too`, links are null.
    """
    signed = signatures(docs, text_col, id_col, threshold)
    if ids is not None:
        signed = signed.join(ids.select(F.col(id_col).cast("long").alias("doc")).distinct(), "doc", "left_semi")
    signed = materialise(signed, "path-signatures")
    sets = materialise(few_tasks(signed.filter("size > 0").groupBy("set").agg(F.min("doc").alias("first"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")), WIDE * signed.count()), "path-sets")
    n = sets.count()
    scratch: list[DataFrame] = []
    left: list[DataFrame] = []
    leaves, large = grow(sets, threshold, scratch, left, n)
    small = buckets(leaves, sets, threshold, n)
    places = small.select("set", _place("bucket", 0, 1, 0, 1, 2, F.col("set")).alias("place"))
    left = [x for x in left if not x.isEmpty()]
    for x in left:
        places = places.unionByName(x.select("set", F.lit(None).cast(PLACE).alias("place")))  # in no place yet
    dealt = None
    if large is not None and not large.isEmpty():
        dealt = _dealt(large, sets, scratch, n * runs_needed(1, threshold) * (1 + CHOSEN))
        places = places.unionByName(_stars(dealt))
    content = contents(places, sets, docs, text_col, id_col, scratch, n)
    links = verify(content, threshold)
    roots = components(links)
    for x in left:
        nodes = prefixes(x, content, roots, threshold, scratch)
        again = _dealt(nodes, sets, scratch, nodes.count())
        dealt = again if dealt is None else dealt.unionByName(again)
    if dealt is not None:
        rest = materialise(few_tasks(_rest(dealt, roots, scratch).groupBy("set").agg(F.collect_list("place").alias("places")), WIDE * n), "path-rest")
        scratch.append(rest)
        held = likely(content.select("set", "shingles"), "set", rest)
        more = verify(held.join(rest, "set").select("set", "places", "shingles"), threshold)
        scratch.append(more)
        if not more.isEmpty():
            of = lambda df, c, name: df.join(roots, F.col(c) == F.col("node"), "left").withColumn(name, F.coalesce("root", c)).drop("node", "root")
            between = of(of(more, "u", "a"), "v", "b").select(F.col("a").alias("u"), F.col("b").alias("v"))
            parts = components(between)
            scratch += [roots, parts]
            joined = parts.select(F.col("node").alias("old"), F.col("root").alias("new"))
            known = roots.unionByName(joined.select(F.col("old").alias("node"), F.col("old").alias("root"))).distinct()
            roots = materialise(few_tasks(known.join(joined, F.col("root") == F.col("old"), "left").groupBy("node").agg(F.min(F.coalesce("new", "root")).alias("root")), n), "path-roots")
    counted = all_links(content, sets, roots, threshold, scratch, n) if links_too else sets.select("set", F.lit(None).cast("long").alias("links")).limit(0)
    placed = sets.select("set", "first", "weight").join(counted, "set", "left").join(roots, F.col("set") == F.col("node"), "left").select("set", "first", "weight", (F.coalesce("links", F.lit(0)) if links_too else F.col("links")).alias("links"), F.coalesce("root", "set").alias("root"))
    placed = materialise(few_tasks(placed, n), "path-classes")
    for table in [*scratch, sets, content, links, roots]:
        discard(table)
    return signed, placed


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, ids: DataFrame | None = None, links_too: bool = True) -> DataFrame:
    """(id, class_id, n_links) of every row: the smallest id of its class, and how many other rows it is linked to.

    With `ids`, only rows of these ids, and those without one, are there. Without
    `links_too`, links are not counted, and n_links says nothing.
    """
    signed, placed = classes(docs, text_col, id_col, threshold, ids, links_too)
    least = placed.groupBy("root").agg(F.min("first").alias("class_id"))
    by_set = placed.join(least, "root").select("set", "class_id", (F.col("weight") - 1 + F.col("links")).alias("n_links"))
    rows = signed.select("doc", F.when(F.col("size") > 0, F.col("set")).alias("set")).join(by_set, "set", "left").select(F.col("doc").alias(id_col), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = few_tasks(rows, signed.count())
    nothing = docs.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.unionByName(nothing)


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row of `docs` for each class: of the rows with its smallest id, one text, once. Rows without an id stay."""
    signed, placed = classes(docs, text_col, id_col, threshold, links_too=False)
    rows = signed.select("doc", "text_hash", F.when(F.col("size") > 0, F.col("set")).alias("set")).join(placed.select("set", "root"), "set", "left")
    alone = lambda c: F.when(F.col("root").isNull(), F.col(c)).alias(f"_{c}")
    first = rows.groupBy("root", alone("doc"), alone("text_hash")).agg(F.min(F.struct("doc", "text_hash")).alias("_first"))
    kept = first.select(F.col("_first.doc").alias("_doc"), F.col("_first.text_hash").alias("_text_hash"))
    one = docs.join(kept, (F.col(id_col) == F.col("_doc")) & (F.xxhash64(text_col) == F.col("_text_hash"))).dropDuplicates(["_doc", "_text_hash"]).drop("_doc", "_text_hash")
    return one.unionByName(docs.filter(F.col(id_col).isNull()))


def later_ids(tables: list[DataFrame], ids: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc): the ids of each class but the smallest, where each table's texts of `ids` link their ids."""
    edges = None
    for table in tables:
        mine = join(table.select(id_col, text_col), text_col, id_col, threshold, ids, links_too=False).filter(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("u"), F.col("class_id").alias("v"))
        edges = mine if edges is None else edges.unionByName(mine)
    return components(edges).filter("node <> root").select(F.col("node").alias("doc"))
