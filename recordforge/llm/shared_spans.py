"""Substring dedup by seed and extend: word stretches that an earlier document holds are removed.

A window is `WINDOW` consecutive words of a document. A word goes if a window that covers
it stands in a document with a smaller id too.

Seeds. Each window's anchor is the unit of `UNIT` words with the least hash in it (the first of
equal ones), so equal windows have equal anchors at equal places, and the windows
around one anchor are neighbours: they form a stretch. Anchors that stand only once are dropped,
after a count of anchors alone; documents meet in a join on the others.

Extension. Occurrences of an anchor are not paired with each other, as a hot anchor may be
in a third of all documents. First, those that agree on the whole stretch to both
sides are one class with its first document; in all others of the class the whole stretch goes. Then
only the classes that share an anchor are extended word by word to both sides: of every
extension to a window's length (l words to the left, the rest to the right) the first document of all
classes is a partial minimum, and a class loses the windows that an earlier document has.
Matches that overlap in a document merge into its maximal repeats.

Windows count as equal if 64-bit hashes of the anchor and of the window both agree.
Every exchange is by anchor, by class or by document, with written inputs of the joins, so
Spark splits hot keys. Texts are shuffled only to meet their own list of stretches, and those that
surely have none are not; lists are as long as their documents at the most.

Defined cases: a null text has no words and stays null; a row with a null id loses no words (no
document is before or after it); rows of one id are one document, none of them before the
other; texts of fewer words than a window lose none; every text is returned with single
blanks between its words; extra columns are kept, and columns of the new names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from recordforge.llm.chosen_path import likely
from recordforge.llm.textarrays import Powers, byte_lane, byte_words, column_slices, kept_text, mix, word_spans
from recordforge.sources.tables import materialise

WINDOW, UNIT = 13, 4
ALL = (1 << 63) - 1


class Stretches:
    """Windows of the texts of an Arrow column, by their anchors."""

    def __init__(self, window: int = WINDOW, unit: int = UNIT) -> None:
        if not 1 <= unit <= window or window - unit >= 62:
            raise ValueError("a unit is a part of a window, and a stretch holds at most 62 windows")
        self.window, self.unit = window, unit
        self.powers, (self.inside, self.values) = Powers(), byte_lane()

    def __call__(self, texts: pa.Array) -> None:
        """Sets the words, and for each stretch: anchor, whole, first window `at`, number of windows `n`, text `owner`."""
        h, self.begin, self.end, self.first, self.raw = byte_words(texts, self.inside, self.values, self.powers)
        self.span = word_spans(h, self.powers)
        starts = np.arange(max(0, len(h) - self.window + 1))
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        starts = starts[owner[starts] == owner[starts + self.window - 1]]
        units = np.arange(max(0, len(h) - self.unit + 1))
        unit = self.span(units, units + self.unit)
        least, width, choices = (unit & np.uint64(0xFFFFFFF000000000)) | units.astype(np.uint64), 1, self.window - self.unit + 1
        while width < choices:  # windows of units, doubled as often as that fits
            step = min(width, choices - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        pick = (least[starts] & np.uint64(0xFFFFFFFFF)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (np.diff(starts) != 1)
        cut = np.flatnonzero(new)
        self.at, self.n = starts[cut], np.diff(np.append(cut, len(starts)))
        self.anchor, self.owner, back = unit[pick[cut]], owner[self.at], pick[cut] - self.at
        shape = (back * (choices + 1) + self.n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.whole = mix(self.span(self.at, self.at + self.n + self.window - 1) + shape)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the chosen stretches: which stretch, the window's place in it and its hash, for every window."""
        n = self.n[chosen]
        which = np.repeat(chosen, n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lo = self.at[which] + nth
        return which, nth, self.span(lo, lo + self.window)


def stretches(docs: DataFrame, text_col: str, id_col: str, window: int, unit: int) -> DataFrame:
    """(anchor, whole, id) of every stretch of every document."""

    def run(batches):
        found = Stretches(window, unit)
        for batch in batches:
            for lo, hi, part in column_slices(batch.column(1)):
                found(part)
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(found.owner))
                yield pa.RecordBatch.from_arrays([pa.array(found.anchor.view(np.int64)), pa.array(found.whole.view(np.int64)), ids], names=["anchor", "whole", "id"])

    known = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return known.mapInArrow(run, "anchor long, whole long, id long")


def _class_windows(docs: DataFrame, wanted: DataFrame, text_col: str, id_col: str, window: int, unit: int) -> DataFrame:
    """(anchor, whole, first, nth, part) of the windows of classes, from the texts of their first documents. wanted: (first, anchor, whole)."""
    lists = materialise(wanted.groupBy("first").agg(F.collect_list("whole").alias("wholes")), "span-firsts")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    texts = likely(rows, "id", lists.select("first")).hint("merge").join(lists, F.col("id") == F.col("first")).select("first", "text", "wholes")

    def run(batches):
        found = Stretches(window, unit)
        for batch in batches:
            for lo, hi, part in column_slices(batch.column(1)):
                found(part)
                cuts = np.searchsorted(found.owner, np.arange(hi - lo + 1))
                chosen = [cuts[i] + np.flatnonzero(np.isin(found.whole[cuts[i] : cuts[i + 1]].view(np.int64), np.asarray(w))) for i, w in enumerate(batch.column(2).slice(lo, hi - lo).to_pylist())]
                which, nth, part_hash = found.windows(np.concatenate(chosen).astype(np.int64))
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(found.owner[which]))
                yield pa.RecordBatch.from_arrays([pa.array(found.anchor[which].view(np.int64)), pa.array(found.whole[which].view(np.int64)), ids, pa.array(nth.astype(np.int32)), pa.array(part_hash.view(np.int64))], names=["anchor", "whole", "first", "nth", "part"])

    return texts.mapInArrow(run, "anchor long, whole long, first long, nth int, part long")


def repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """(id, whole, mask): the stretches of a document that lose windows, one bit for each window."""
    every = stretches(docs, text_col, id_col, window, unit)
    # Counted first, with nothing but the anchor in the shuffle: most stand once.
    seeds = materialise(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "span-seeds")
    met = materialise(every.hint("merge").join(seeds, "anchor"), "span-met")
    classes = materialise(met.groupBy("anchor", "whole").agg(F.min("id").alias("first")), "span-classes")
    shared = classes.groupBy("anchor").agg(F.min("first").alias("a"), F.max("first").alias("b")).filter("a < b").select("anchor")
    wanted = classes.hint("merge").join(materialise(shared, "span-shared"), "anchor").select("first", "anchor", "whole")
    # An equal stretch that stands twice in its first document is one.
    parts = materialise(_class_windows(docs, wanted, text_col, id_col, window, unit).distinct(), "span-windows")
    earliest = parts.groupBy("anchor", "part").agg(F.min("first").alias("a"), F.max("first").alias("b")).filter("a < b").select("anchor", "part", "a")
    lost = parts.hint("merge").join(materialise(earliest, "span-earliest"), ["anchor", "part"]).filter("first > a")
    own = lost.groupBy(F.col("first").alias("id"), "whole").agg(F.expr("bit_or(shiftleft(1L, nth)) as mask"))
    later = met.hint("merge").join(classes, ["anchor", "whole"]).filter("id > first").select("id", "whole", F.lit(ALL).cast("long").alias("mask"))
    return own.unionByName(later)


def drop_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """Every document without the words that a window of an earlier document covers.

    Adds n_words, n_removed and repeats: the maximal removed stretches (start, length) in
    words of the given text. The text keeps the other words, joined by one space.
    """
    new = ("n_words", "n_removed", "repeats")
    kept = docs.select(*[docs[c] for c in docs.columns if c not in new])
    own, masks = (next(n for k in range(len(kept.columns) + 1) if (n := f"{name}{k or ''}") not in kept.columns) for name in ("_own", "_masks"))
    lists = repeats(kept, text_col, id_col, window, unit).groupBy(F.col("id").alias(own)).agg(F.collect_list(F.struct("whole", "mask")).alias(masks))
    joined = kept.join(materialise(lists, "span-lists"), F.col(id_col).cast("long") == F.col(own), "left").drop(own)

    def run(batches):
        found = Stretches(window, unit)
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            rest = [i for i, name in enumerate(batch.schema.names) if name != masks]
            for lo, hi, part in column_slices(batch.column(place)):
                found(part)
                lost = batch.column(batch.schema.get_field_index(masks)).slice(lo, hi - lo)
                flat = lost.flatten()
                text = np.repeat(np.flatnonzero(np.asarray(lost.is_valid())), np.asarray(pa.compute.list_value_length(lost).drop_null()))
                whole, mask = np.asarray(flat.field("whole")), np.asarray(flat.field("mask"))
                edge = np.zeros(len(found.begin) + 1, np.int64)
                # Equal stretches of one text have equal masks: look each stretch up by text and hash.
                keys = np.lexsort((whole, text))
                have = np.rec.fromarrays([text[keys], whole[keys]])
                want = np.rec.fromarrays([found.owner, found.whole.view(np.int64)])
                at = np.searchsorted(have, want) if len(have) else np.zeros(len(want), np.int64)
                hit = np.flatnonzero(at < len(have))
                hit = hit[have[at[hit]] == want[hit]]
                bits = mask[keys][at[hit]]
                which, nth, _ = found.windows(hit)
                gone = (np.repeat(bits, found.n[hit]) >> nth) & 1 == 1
                lo_word = (found.at[which] + nth)[gone]
                np.add.at(edge, lo_word, 1)
                np.add.at(edge, lo_word + window, -1)
                removed = np.cumsum(edge[:-1]) > 0
                sizes = np.diff(found.first)
                total = np.append(0, np.cumsum(removed))
                text_out = kept_text(found.raw, found.begin, found.end, found.first, ~removed)
                if part.null_count:
                    text_out = pa.compute.if_else(part.is_null(), pa.scalar(None, pa.string()), text_out)
                heads = removed.copy()
                heads[1:] &= ~removed[:-1]
                heads[found.first[:-1][sizes > 0]] |= removed[found.first[:-1][sizes > 0]]
                start = np.flatnonzero(heads)
                cuts = np.searchsorted(start, found.first).astype(np.int32)
                owner = np.repeat(np.arange(len(sizes)), np.diff(cuts))
                tails = np.minimum(np.append(start[1:], len(removed)), found.first[owner + 1]) if len(start) else start
                spans = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(start - found.first[owner]), pa.array(total[tails] - total[start])], names=["start", "length"]))
                columns = [text_out if i == place else batch.column(i).slice(lo, hi - lo) for i in rest]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), pa.array(total[found.first[1:]] - total[found.first[:-1]]), spans], names=[*(batch.schema.names[i] for i in rest), *new])

    schema = kept.limit(0).selectExpr("*", "0L n_words", "0L n_removed", "cast(null as array<struct<start:bigint,length:bigint>>) repeats").schema
    return joined.mapInArrow(run, schema)
