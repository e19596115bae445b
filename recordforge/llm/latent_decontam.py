"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of `WINDOW` words, every `STRIDE` words, of documents, and
the benchmark's items. Their TF-IDF vectors are over the items' terms; other
words count in a passage's norm only. (Passages are so short that a term's
occurrences stand for its passages; they are counted over all documents, in
`BITS`-bit buckets.) A distributed randomised SVD finds the
latent space: every task multiplies its passages with a random matrix and back,
the products are added up, and one small factorisation gives the leading right
singular vectors of all passages (single-pass Nystrom form). A passage whose
cosine with an item, in that space, reaches `COSINE` is a candidate.

A candidate is checked on its words: the longest common subsequence of the item
and the text around the passage, as a share of the item. The document holds the
item if the share is at least `VERBATIM`, or at least `PARAPHRASE` while the
item's answer (its last sentence) is there too. The text around a passage is
the passage and as many words on each side as the item has.

A cosine cannot bound what that check accepts: an edited item may keep its
common words only, and an item far longer or shorter than a window shares little
of its norm with one. So the check also looks wherever enough of an item's words
stand together (`_stretches`). An item of which the share `PARAPHRASE` is kept
loses at most the rest of its words, hence keeps m of its rarest m + rest; text
around a passage with fewer than m of them cannot hold the item. This bound is
exact, for items of any length, and independent of the latent space, which
decides only which passages are checked first.

Windows whose TF-IDF weight is mostly on words outside the benchmark cannot
reach the cosine and are not projected: an exact bound, not a cut.

A benchmark of more than `ITEMS` items has a latent space for each block of that
many; a task reads its texts once for up to `PASS` blocks, so what it holds is
bounded. Nothing is written between blocks.

Defined cases: null and empty texts hold no item; null items are never found;
items of fewer than `LEAST` words, which any text may hold by chance, are found
where they are all the words of a text; repeated rows are judged alike; an empty
benchmark flags nothing; columns of the new names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from recordforge.functions.names import free_names
from recordforge.llm import sums
from recordforge.llm.textarrays import Powers, alnum_table, append_columns, encode, text_slices, words

WINDOW, STRIDE, BITS, RANK, OVERSAMPLE = 32, 16, 18, 192, 16
COSINE, VERBATIM, PARAPHRASE, ANSWER, LEAST, ITEMS, PASS = 0.55, 0.8, 0.6, 0.8, 5, 1024, 4
#: Share of an item that must stand together as its rarest words; word places looked up at once.
RARE, PLACES = 0.15, 1 << 22


def _words(texts: list, table: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, first = words(*encode(texts), table, powers)
    return h, first


def occurrences(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often the words of each hash bucket occur in all texts."""

    def run(batches):
        table, powers, n = alnum_table(), Powers(), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                h, _ = _words(texts, table, powers)
                n += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        yield sums.emit(n)

    got = sums.total(docs.select(text_col).mapInArrow(run, sums.SCHEMA), np.int64)
    return np.zeros(1 << BITS, np.int64) if got is None else got


class Items:
    """What tasks need to know of a block of items: terms, weights, words and answers."""

    def __init__(self, rows: list[tuple[int, str]], counts: np.ndarray) -> None:
        table, powers = alnum_table(), Powers()
        self.ids, self.words, self.answers = [], [], []
        self.short: dict[tuple, list[int]] = {}
        for item, text in rows:
            h, _ = _words([text], table, powers)
            if len(h) >= LEAST:
                last = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s][-1]
                self.ids.append(item)
                self.words.append(h)
                self.answers.append(_words([last], table, powers)[0])
            elif len(h):
                self.short.setdefault(tuple(h.tolist()), []).append(item)
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.idf = np.log(np.maximum(1.0, counts.sum() / (WINDOW * (1.0 + counts)))).astype(np.float32)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *self.words])
        self.places = np.searchsorted(self.terms, flat)
        self.owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        # A word that an item repeats adds up, so the norm is over distinct words.
        cell = self.owner * np.int64(max(1, len(self.terms))) + self.places
        u, back = np.unique(cell, return_inverse=True)
        w = self.weights(flat)
        per_cell = np.bincount(back, w, minlength=len(u))
        norm = np.sqrt(np.bincount(u // max(1, len(self.terms)), per_cell**2, minlength=len(self.ids)))
        self.shares = (w / np.maximum(norm[self.owner], 1e-12)).astype(np.float32)
        self.known = [frozenset(w.tolist()) for w in self.words]
        needed = np.ceil(PARAPHRASE * self.sizes - 1e-9).astype(np.int64)
        self.together = np.minimum(needed, np.maximum(1, np.ceil(RARE * self.sizes).astype(np.int64)))
        rare = [np.unique(np.searchsorted(self.terms, w[np.argsort(-self.weights(w), kind="stable")[:n]])) for w, n in zip(self.words, self.sizes - needed + self.together)]
        self.rare = np.concatenate([np.zeros(0, np.int64), *rare])
        self.rare_first = np.cumsum([0, *map(len, rare)])

    def project(self, basis: np.ndarray) -> np.ndarray:
        """The items' unit vectors (items x terms) times basis."""
        out = np.zeros((len(self.ids), basis.shape[1]), np.float32)
        for i, (a, b) in enumerate(zip(np.cumsum(self.sizes) - self.sizes, np.cumsum(self.sizes))):
            out[i] = self.shares[a:b] @ basis[self.places[a:b]]
        return out

    def spread(self, y: np.ndarray) -> np.ndarray:
        """Their transpose times y."""
        out = np.zeros((len(self.terms), y.shape[1]), np.float32)
        np.add.at(out, self.places, self.shares[:, None] * y[self.owner])
        return out

    def weights(self, h: np.ndarray) -> np.ndarray:
        return self.idf[(h >> np.uint64(64 - BITS)).astype(np.int64)]


def _windows(h: np.ndarray, first: np.ndarray, items: Items, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, text, term indexes and weights (over the passage's norm) of the windows with a share `least` of their norm on item terms.

    A term index is -1 past the window's text and for words of no item.
    """
    n = np.diff(first)
    per = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(n)), per)
    start = first[:-1][text] + STRIDE * (np.arange(len(text)) - (np.cumsum(per) - per)[text])
    end = np.minimum(start + WINDOW, first[1:][text])
    at = np.minimum(np.searchsorted(items.terms, h), len(items.terms) - 1)
    known = items.terms[at] == h
    w = items.weights(h)
    run = lambda x: np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))
    whole, mine = run(w * w), run(np.where(known, w * w, 0))
    norm2 = whole[end] - whole[start]
    keep = np.flatnonzero((norm2 > 1e-6) & (mine[end] - mine[start] >= least**2 * norm2))
    start, end, text = start[keep], end[keep], text[keep]
    place = start[:, None] + np.arange(WINDOW)
    inside = place < end[:, None]
    place = np.where(inside, place, start[:, None])
    terms = np.where(inside & known[place], at[place], -1)
    weights = np.where(terms >= 0, w[place], 0) / np.sqrt(norm2[keep])[:, None]
    return start, text, terms, weights.astype(np.float32)


def _project(terms: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((len(terms), basis.shape[1]), np.float32)
    for k in range(terms.shape[1]):
        out += weights[:, k, None] * basis[terms[:, k]]
    return out


def latent_spaces(docs: DataFrame, text_col: str, blocks: list[Items]) -> list[np.ndarray]:
    """For each block, the leading right singular vectors (terms x rank) of all passages, items among them."""
    randoms = [np.random.default_rng(11).normal(size=(len(x.terms), min(RANK + OVERSAMPLE, len(x.terms)))).astype(np.float32) for x in blocks]

    def add(z, h, first, items, random):
        _, _, terms, weights = _windows(h, first, items, COSINE)
        for a in range(0, len(terms), 2048):
            t, w = terms[a : a + 2048], weights[a : a + 2048]
            y = _project(t, w, random)
            row, col = np.nonzero(t >= 0)
            order = np.argsort(t[row, col], kind="stable")
            row, col = row[order], col[order]
            u, begin = np.unique(t[row, col], return_index=True)
            if len(u):
                z[u] += np.add.reduceat(w[row, col][:, None] * y[row], begin, axis=0)

    def run(batches):
        table, powers, all_z = alnum_table(), Powers(), [np.zeros(r.shape) for r in randoms]
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                h, first = _words(texts, table, powers)
                if len(h):
                    for z, items, random in zip(all_z, blocks, randoms):
                        add(z, h, first, items, random)
        yield sums.emit(np.concatenate([z.ravel() for z in all_z]).astype(np.float32))

    got = sums.total(docs.select(text_col).mapInArrow(run, sums.SCHEMA), np.float32)
    out, at = [], 0
    for items, random in zip(blocks, randoms):
        z = np.zeros(random.shape) if got is None else got[at : at + random.size].reshape(random.shape).astype(np.float64)
        at += random.size
        own = items.spread(items.project(random))
        z += max(1.0, np.abs(z).max() / max(1e-9, np.abs(own).max())) * own
        core = random.T @ z
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > values.max() * 1e-9
        left, _, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
        out.append(left[:, :RANK].astype(np.float32))
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        m = masks.get(y, 0)
        hit = row & m
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _judge(h: np.ndarray, first: int, last: int, start: int, item: np.ndarray, answer: np.ndarray, known: frozenset) -> float:
    """Share of the item in the text around a window; 0 unless it is held. known: the item's words."""
    span = h[max(first, start - len(item)) : min(last, start + WINDOW + len(item))]
    inside = [x in known for x in span.tolist()]
    if sum(inside) < PARAPHRASE * len(item) - 1e-9:
        return 0.0
    span = span[inside]
    share = common(item, span) / len(item)
    if share >= VERBATIM:
        return share
    if share >= PARAPHRASE and common(answer, span) >= ANSWER * len(answer):
        return share
    return 0.0


def _stretches(h: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item, text, start) of every window whose surroundings have enough of the item's rarest words.

    Items are looked up in lots of at most `PLACES` places (or one item), so
    memory does not grow with the benchmark.
    """
    at = np.minimum(np.searchsorted(items.terms, h), len(items.terms) - 1)
    place = np.flatnonzero(items.terms[at] == h)
    term = at[place]
    place = place[np.argsort(term, kind="stable")]
    count = np.bincount(term, minlength=len(items.terms))
    begin = np.cumsum(count) - count
    upto = np.concatenate(([0], np.cumsum(count[items.rare])))[items.rare_first]
    base = np.int64(len(h) + 1)
    lo = 0
    while lo < len(items.ids):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PLACES, "right")) - 1)
        rare = items.rare[items.rare_first[lo] : items.rare_first[hi]]
        n = count[rare]
        which = np.repeat(begin[rare] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner = np.repeat(np.repeat(np.arange(lo, hi), np.diff(items.rare_first[lo : hi + 1])), n)
        item, at = np.divmod(np.sort(owner * base + place[which]), base)
        lo = hi
        a = np.arange(len(at))
        b = a + items.together[item] - 1
        a, b = a[b < len(at)], b[b < len(at)]
        a, b = (x[(item[a] == item[b]) & (at[b] - at[a] < WINDOW + 2 * items.sizes[item[a]])] for x in (a, b))
        text = np.searchsorted(first, at[a], "right") - 1
        same = at[b] < first[text + 1]
        a, b, text = a[same], b[same], text[same]
        item, size = item[a], items.sizes[item[a]]
        # Windows whose surroundings, from `size` words before them to `size` words after, hold both ends.
        final = np.maximum(0, -(-(first[text + 1] - first[text] - WINDOW) // STRIDE))
        low = np.maximum(0, -(-(at[b] + 1 - WINDOW - size - first[text]) // STRIDE))
        high = np.minimum(final, (at[a] + size - first[text]) // STRIDE)
        now, done = (-1, -1), 0
        for k, i, x, y in zip(item.tolist(), text.tolist(), low.tolist(), high.tolist()):
            if (k, i) != now:
                now, done = (k, i), 0
            for w in range(max(x, done), y + 1):
                yield k, i, int(first[i]) + STRIDE * w
            done = max(done, y + 1)


class _Block:
    """A block's items and their latent coordinates."""

    def __init__(self, items: Items, basis: np.ndarray) -> None:
        self.items, self.basis = items, basis
        self.mine = items.project(basis)
        kept = (self.mine**2).sum(1)
        self.mine /= np.maximum(kept[:, None], 1e-12)
        self.least = COSINE * float(np.sqrt(kept.min()))

    def find(self, h: np.ndarray, first: np.ndarray, held: list[list[int]], best: np.ndarray) -> None:
        """Adds the items held by each text, and the largest share."""
        items = self.items

        def judge(i: int, k: int, place: int) -> None:
            if items.ids[k] in held[i]:
                return
            share = _judge(h, int(first[i]), int(first[i + 1]), place, items.words[k], items.answers[k], items.known[k])
            if share:
                held[i].append(items.ids[k])
                best[i] = max(best[i], share)

        start, text, terms, weights = _windows(h, first, items, self.least)
        for a in range(0, len(start), 4096):
            near = _project(terms[a : a + 4096], weights[a : a + 4096], self.basis) @ self.mine.T
            for w, k in zip(*np.nonzero(near >= COSINE)):
                judge(int(text[a + w]), k, int(start[a + w]))
        for k, i, place in _stretches(h, first, items):
            judge(i, k, place)


def _find(docs: DataFrame, blocks: list[_Block], short: dict, text_col: str, names: tuple[str, str]) -> DataFrame:
    def make():
        table, powers = alnum_table(), Powers()

        def fn(texts):
            held: list[list[int]] = [[] for _ in texts]
            best = np.zeros(len(texts))
            h, first = _words(texts, table, powers)
            if len(h):
                for i in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < LEAST)).tolist() if short else ():
                    if found := short.get(tuple(h[first[i] : first[i + 1]].tolist())):
                        held[i] += found
                        best[i] = 1.0
                for b in blocks:
                    b.find(h, first, held, best)
            return pa.array([sorted(set(x)) for x in held], pa.list_(pa.int64())), best

        return fn

    return append_columns(docs, [T.StructField(names[0], T.ArrayType(T.LongType())), T.StructField(names[1], T.DoubleType())], make, text_col)


def flag(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", items_col: str = "items", overlap_col: str = "overlap") -> DataFrame:
    """Adds the ids of the benchmark items held, and the largest share of one (0 if none)."""
    known = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null").distinct()
    n = max(1, -(-known.count() // ITEMS))
    counts = occurrences(docs, text_col)
    out = docs.drop(items_col, overlap_col)
    names = []
    for lo in range(0, n, PASS):
        all_items = [Items(sorted((r["item"], r["text"]) for r in known.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()), counts) for b in range(lo, min(n, lo + PASS))]
        short = _merged([x.short for x in all_items])
        some = [x for x in all_items if x.ids]
        if not some and not short:
            continue
        blocks = [_Block(x, basis) for x, basis in zip(some, latent_spaces(docs, text_col, some))] if some else []
        names.append(free_names(out.columns, "_items", "_overlap"))
        out = _find(out, blocks, short, text_col, names[-1])
    if not names:
        return out.withColumns({items_col: F.array().cast("array<bigint>"), overlap_col: F.lit(0.0)})
    items, overlaps = F.array_sort(F.array_distinct(F.flatten(F.array(*[a for a, _ in names])))), [F.col(b) for _, b in names]
    return out.withColumns({items_col: items, overlap_col: F.greatest(*overlaps) if len(overlaps) > 1 else overlaps[0]}).drop(*[c for pair in names for c in pair])


def _merged(tables: list[dict]) -> dict:
    out: dict = {}
    for t in tables:
        for k, v in t.items():
            out.setdefault(k, []).extend(v)
    return out
