"""Periodic run detection: stretches in which a text repeats the same words again and again.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least `TIMES` periods and `LEAST` words, which no neighbouring word
extends with that period.

Periods below `SHORT` are found by direct scans: at each lag, long enough streaks of
words that equal the word one lag before. Longer ones are found by minimizers of several
scales. At the scale P, for periods from P to 2P - 1, the units are stretches of 2P words,
which within a run are equal only at multiples of its period, as they are at least as
long. Of each window of P units the least one is selected. Within a run of four periods
some window and its copy one period later lie whole, and both select the same unit at
places one period apart: so a selected unit and the next one of the same words, at a distance
of the scale, is a seed. Seeds are extended word by word both ways. Units are named
exactly, by pairs of the names of their halves; units that stand only once in a text cannot
be part of a run and are left out, so the scales above the longest repeat cost nothing.

Every text is worked on by itself within its batch, with nothing shuffled. Memory is a
few arrays over the words of about a megabyte of text, or of the one text that is longer;
time grows with the words times the number of scales.

Defined cases: a null text has no words and no runs, and its collapsed text is null; an
empty one collapses to an empty text; null ids, repeated rows and ties matter to no other row;
extra columns are kept, and columns of the new names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recordforge.llm.textarrays import Powers, byte_lane, byte_words, column_slices, kept_text, mix

LEAST, TIMES = 6, 4
#: Periods below are scanned lag by lag; the first scale begins here.
SHORT = 8
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _same(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from `at` on, forwards or backwards, equal the word one lag later."""
    most = len(ids) - lag - at if step > 0 else at + 1
    done, block = 0, 64
    while done < most:
        n = min(block, most - done)
        lo = at + done if step > 0 else at - done - n + 1
        differs = ids[lo : lo + n] != ids[lo + lag : lo + lag + n]
        if differs.any():
            return done + int(np.argmax(differs if step > 0 else differs[::-1]))
        done, block = done + n, block * 2
    return done


def _streaks(ids: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches with this period, where any word repeats."""
    equal = np.zeros(max(0, len(ids) - lag) + 2, np.int8)
    equal[1:-1] = ids[lag:] == ids[: len(ids) - lag] if len(ids) > lag else 0
    step = np.diff(equal)
    start = np.flatnonzero(step == 1)
    return start, np.flatnonzero(step == -1) - start + lag


def _seeds(names: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of selected units and the next selected one of the same words. names: -1 where a unit stands once."""
    place = np.arange(len(names), dtype=np.uint64)
    least = np.where(names >= 0, (mix(names.astype(np.uint64)) & np.uint64(0xFFFFFFF000000000)) | place, NONE)
    width = 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    chosen = np.zeros(len(names), bool)
    chosen[(least[least != NONE] & np.uint64(0xFFFFFFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    at = at[np.argsort(names[at], kind="stable")]
    gap = np.where(names[at[1:]] == names[at[:-1]], at[1:] - at[:-1], 0)
    fits = (gap >= scale) & (gap < 2 * scale)
    return at[:-1][fits], gap[fits]


def find_runs(ids: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, by start and period.

    ids: a number for each word; those of different texts must differ. longest: words
    of the longest text. At least four times the period is what the seeds can promise.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods are not promised by the seeds")
    found: dict[tuple[int, int], int] = {}

    def add(start: int, length: int, period: int) -> None:
        # Equal stretches of several periods: all are multiples of the smallest.
        if length >= max(least, times * period):
            found[start, length] = min(period, found.get((start, length), period))

    for lag in range(1, min(SHORT, longest // times + 1)):
        start, length = _streaks(ids, lag)
        fits = length >= max(least, times * lag)
        for a, n in zip(start[fits].tolist(), length[fits].tolist()):
            add(a, n, lag)
    names, size = ids.astype(np.int64), 1
    while SHORT * times <= longest and times * size // 2 <= longest:
        at = np.flatnonzero(names[: len(names) - size] >= 0)
        at = at[names[at + size] >= 0]
        if not len(at):
            break
        _, name, count = np.unique(names[at] * (int(names.max()) + 1) + names[at + size], return_inverse=True, return_counts=True)
        names, size = np.full(len(names) - size, -1, np.int64), size * 2
        again = count[name] > 1
        names[at[again]] = name[again]
        if size // 2 < SHORT or len(names) < size // 2:
            continue
        seed, period = _seeds(names, size // 2)
        reached: dict[int, int] = {}
        for k in np.lexsort((seed, period)).tolist():
            m, q = int(seed[k]), int(period[k])
            if m + q < reached.get(q, 0):
                continue
            left, right = _same(ids, m - 1, q, -1) if m else 0, _same(ids, m, q, 1)
            reached[q] = m + right + q
            add(m - left, left + right + q, q)
    rows = np.array(sorted((a, q, n) for (a, n), q in found.items()), np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 2], rows[:, 1]


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Adds n_words, runs (start, length, period in words, by start and period) and collapsed.

    The collapsed text holds each run's first period only: a word is dropped if any run
    contains it after that run's first period. Kept words are joined by one space.
    """
    new = ("n_words", "runs", "collapsed")
    kept = docs.select(*[docs[c] for c in docs.columns if c not in new])

    def run(batches):
        inside, values = byte_lane()
        powers = Powers()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi, part in column_slices(texts):
                h, begin, end, first, raw = byte_words(part, inside, values, powers)
                sizes = np.diff(first)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                _, word = np.unique(h, return_inverse=True)
                _, ids = np.unique(owner * (len(h) + 1) + word, return_inverse=True)
                start, length, period = find_runs(ids, int(sizes.max(initial=0)), least, times)
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                text = kept_text(raw, begin, end, first, np.cumsum(edge[:-1]) == 0)
                cuts = np.searchsorted(start, first).astype(np.int32)
                at = start - first[owner[start]] if len(start) else start
                runs = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(x) for x in (at, length, period)], names=["start", "length", "period"]))
                blank = pa.compute.is_null(part)
                text = pa.compute.if_else(blank, pa.scalar(None, pa.string()), text) if part.null_count else text
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(sizes), runs, text], names=[*batch.schema.names, *new])

    schema = kept.limit(0).selectExpr("*", "0L n_words", f"cast(null as {RUNS}) runs", "cast(null as string) collapsed").schema
    return kept.mapInArrow(run, schema)
