"""Ranked lexical search: exact top results by NRA over impact-sorted posting lists.

A document's score for an item is the sum of the impacts of the item's terms, repeats
included; an impact is an integer made of a term's weight in the corpus, its number in the document and the
document's length (`impacts`).

A first pass counts documents, terms and the documents of each of the items' terms. In a second one
every task turns its documents into shards of about `SHARD` bytes of text. A shard holds a posting list for
each term, largest impacts first, and answers all items by NRA: it only reads lists from the
front, a longer piece of all lists in each round. A document's lower bound is what was read of
it; its upper bound adds, for each list where it was not met yet, the last impact read. Once no
document that was never met can reach the task's tenth score, the others whose upper bound reaches
it are followed until their bounds agree, so members, ties and scores are exact. The tenth score goes on to
the task's next shard. The best of all tasks meet in a window over each item, of which every task
sends no more than asked for.

Items are the queries: they come in blocks of at most `TERMS` terms (or of the one item that is longer),
each block with two passes over the documents. So the driver and the tasks hold one block's terms and counts. Words
are 64-bit hashes. Documents are never shuffled.

Defined cases: null texts have no terms and do not count as documents; a null document id
takes no part in anything; repeated rows of documents are ranked as rows of their own; a null item id or an
item without terms has no results; of several texts of one item the smallest counts; without
documents or items the result is empty; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from recordforge.llm.textarrays import Powers, byte_words, column_slices
from recordforge.sources.tables import materialise

TOP, TERMS, SHARD = 10, 50_000, 24 << 20
#: Entries of each list that the first round reads, and how many times as deep each next one goes.
DEPTH, DEEPER = 64, 4


class Terms:
    """Terms of texts: runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""

    def __init__(self) -> None:
        self.powers = Powers()
        self.inside = np.zeros(256, bool)
        for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
            self.inside[lo:hi] = True
        self.values = np.arange(1, 257, dtype=np.uint64)
        self.values[65:91] += np.uint64(32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the terms, and each text's first one."""
        h, _, _, first, _ = byte_words(texts, self.inside, self.values, self.powers)
        return h, first

    def counts(self, texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text, and (text, number of a known term, occurrences) of all that occur. known: sorted hashes."""
        h, first = self(texts)
        sizes = np.diff(first)
        at = np.searchsorted(known, h)
        hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h) if len(known) else np.zeros(0, np.int64)
        key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[hit] * max(1, len(known)) + at[hit], return_counts=True)
        return sizes, key // max(1, len(known)), key % max(1, len(known)), tf


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """1000 ln((2N + 2) / (2 df + 1)), rounded down."""
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a document's score: weight, occurrences, terms of the document, documents and terms of the corpus."""
    m = 25 + (75 * n * n_docs) // max(1, n_terms)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Posting lists of some documents, each by falling impact."""

    def __init__(self, docs: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int) -> None:
        order = np.lexsort((docs, -impact, term))
        self.docs, self.impact, self.n_docs = docs[order], impact[order], n_docs
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, times: np.ndarray, floor: int, top: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that reach the top or the floor, exact; some more may come along."""
        if not len(self.docs):
            return self.docs, self.impact
        start, stop = self.start[terms], self.start[terms + 1]
        lower = np.zeros(self.n_docs, np.int64)
        entry, of = np.zeros(0, np.int64), np.zeros(0, np.int64)
        follow = None  # documents that may still be members, once no new one can be
        last = start.copy()
        while True:
            upto = np.minimum(start + depth, stop)
            width = upto - last
            read = np.repeat(last - np.cumsum(width) + width, width) + np.arange(width.sum())
            which = np.repeat(np.arange(len(terms)), width)
            if follow is not None:
                mine = follow[self.docs[read]]
                read, which = read[mine], which[mine]
            np.add.at(lower, self.docs[read], times[which] * self.impact[read])
            entry, of, last = np.concatenate((entry, read)), np.concatenate((of, which)), upto
            # The next entry of a list is at most the last one that was read, and none if there is no next.
            front = np.where(last < stop, times * self.impact[np.maximum(last - 1, 0)], 0)
            least = floor
            if np.count_nonzero(lower) >= top:
                least = max(least, int(np.partition(lower, -top)[-top]))
            missed = np.full(self.n_docs, front.sum(), np.int64)
            np.subtract.at(missed, self.docs[entry], front[of])
            may = (lower > 0) & (lower + missed >= least) & (follow if follow is not None else True)
            if not front.any() or (front.sum() < least and not missed[may].any()):
                break
            if front.sum() < least:
                follow = may
                held = may[self.docs[entry]]
                entry, of = entry[held], of[held]
            depth *= DEEPER
        best = np.flatnonzero(may)
        return best, lower[best]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Lists of (item id, {term hash: times}) with at most `TERMS` terms together."""
    chosen = items.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("item")).agg(F.min(text_col).alias("text"))
    terms, block, held = Terms(), [], 0
    for row in materialise(chosen, "search-items").toLocalIterator():
        times = Counter(terms(pa.array([row.text]))[0].tolist())
        if block and held + len(times) > TERMS:
            yield block
            block, held = [], 0
        if times:
            block.append((row.item, times))
            held += len(times)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item, rank, document, score): each item's best documents with a score above 0, ties by smaller document id.

    Document ids are whole numbers. Columns bear the names of the id columns.
    """
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    item_type = items.schema[item_id].dataType.simpleString()
    found = None
    for block in _blocks(items, item_id, item_text):
        one = _search_block(rows, [times for _, times in block], top).join(F.broadcast(spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"nth int, item {item_type}")), "nth")
        one = materialise(one.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(id_col), "score"), "search-found")
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], f"{item_id} {item_type}, rank int, {id_col} long, score long")


def _search_block(rows: DataFrame, items: list[dict], top: int) -> DataFrame:
    known = np.array(sorted({h for times in items for h in times}), np.uint64)

    def count(batches):
        terms, df, n_docs, n_terms = Terms(), np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for _, _, part in column_slices(batch.column(1)):
                sizes, _, term, _ = terms.counts(part, known)
                df += np.bincount(term, minlength=len(known))
                n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + int(sizes.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, (-1, -2)).astype(np.int32)), pa.array(np.append(df[some], (n_docs, n_terms)))], names=["term", "n"])

    # One row for each term of the block, and two for the corpus.
    sums = {r.term: r.n for r in rows.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_terms = sums.get(-1, 0), sums.get(-2, 0)
    weight = weights(n_docs, np.array([sums.get(i, 0) for i in range(len(known))], np.int64))
    queries = [(np.searchsorted(known, np.array(list(t), np.uint64)), np.array(list(t.values()), np.int64)) for t in items]

    depth = DEPTH

    def rank(batches):
        terms, best = Terms(), [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]

        def flush(parts):
            ids, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            shift = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
            doc = np.concatenate([p[2] + s for p, s in zip(parts, shift)])
            term, tf = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
            shard = Shard(doc, term, impacts(weight[term], tf, sizes[doc], n_docs, n_terms), len(ids), len(known))
            for i, (own, times) in enumerate(queries):
                floor = int(best[i][1][top - 1]) if len(best[i][1]) >= top else 1
                at, score = shard.search(own, times, floor, top, depth)
                at, score = np.concatenate((best[i][0], ids[at])), np.concatenate((best[i][1], score))
                order = np.lexsort((at, -score))[:top]
                best[i] = at[order], score[order]

        parts, held = [], 0
        for batch in batches:
            for lo, hi, part in column_slices(batch.column(1)):
                parts.append((np.asarray(batch.column(0).slice(lo, hi - lo)), *terms.counts(part, known)))
                held += part.nbytes
                if held >= SHARD:
                    flush(parts)
                    parts, held = [], 0
        if parts:
            flush(parts)
        nth = np.repeat(np.arange(len(queries), dtype=np.int32), [len(b[0]) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(nth), *(pa.array(np.concatenate([b[k] for b in best])) for k in (0, 1))], names=["nth", "doc", "score"])

    by = Window.partitionBy("nth").orderBy(F.desc("score"), "doc")
    return rows.mapInArrow(rank, "nth int, doc long, score long").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
