"""Texts as numpy arrays: code points, words and hashed character n-grams.

Everything works on chunks of bounded size, so a task's memory depends on the
chunk (or on the one text that is longer than a chunk), never on the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Characters in a chunk. Longer texts are chunks of their own.
CHUNK = 1 << 20
#: Odd multipliers of the hashes; any odd numbers would do.
ODD32 = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491)
ODD64 = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
BASE64 = 0x5851F42D4C957F2D


def chunked(texts: list, limit: int = CHUNK, most_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` characters and at most `most_rows` texts each."""
    lo = held = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > lo and (held + n > limit or i - lo >= most_rows):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(texts):
        yield lo, len(texts)


def text_slices(column: pa.Array, limit: int = CHUNK, most_rows: int = 1 << 30) -> Iterator[tuple[int, int, list]]:
    """The same over an Arrow column: only the texts of one range are decoded at a time."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    lo = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and (held + n > limit or i - lo >= most_rows):
            yield lo, i, column.slice(lo, i - lo).to_pylist()
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes), column.slice(lo).to_pylist()


def encode(texts: list, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, a 0 after each; where each starts; its length."""
    parts = ["" if t is None else t.lower() if lower else t for t in texts]
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(parts), np.int64)
    np.cumsum(lens[:-1] + 1, out=starts[1:])
    return codes, starts, lens


def ngram_buckets(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the character n-gram at each position, and whether it stays in its text."""
    m = max(0, len(codes) - n + 1)
    h = np.full(m, n * 0x1B873593 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h ^= h >> np.uint32(15)
        h += codes[k : k + m]
        h *= np.uint32(ODD32[k])
    h ^= h >> np.uint32(13)
    h *= np.uint32(ODD32[5])
    inside = np.ones(m, bool)
    for k in range(n):
        at = starts + lens - k
        inside[at[(at >= 0) & (at < m)]] = False
    return (h >> np.uint32(32 - bits)).astype(np.int32), inside


def owners(positions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which text each position belongs to."""
    return np.searchsorted(starts, positions, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def alnum_table() -> np.ndarray:
    """Which code points are letters, marks or digits; all beyond the basic plane are."""
    table = np.ones(1 << 16, bool)
    table[:] = [chr(i).isalnum() for i in range(1 << 16)]
    return table


def letters_only(codes: np.ndarray) -> np.ndarray:
    """The code points with every one of the basic plane that is no letter made a blank."""
    kinds = np.unique(codes)
    other = kinds[[i < (1 << 16) and not chr(i).isalpha() for i in kinds.tolist()]]
    table = np.ones(1 << 16, bool)
    table[other] = False
    small = codes < (1 << 16)
    return np.where(table[np.where(small, codes, 65)], codes, np.uint32(32))


def blank_table() -> np.ndarray:
    """True for all code points but the six ASCII blanks."""
    table = np.ones(1 << 16, bool)
    table[[9, 10, 11, 12, 13, 32]] = False
    return table


class Powers:
    """Powers of the hash base and of its inverse, grown when needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.full(size, BASE64, np.uint64)
            self.down = np.full(size, pow(BASE64, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up, self.down


def words(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, table: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words, where each begins and ends, and each text's first word.

    A word is a run of code points for which `table` holds. The last array has
    one entry more than there are texts.
    """
    inside = np.empty(len(codes) + 1, bool)
    inside[-1] = False
    small = codes < (1 << 16)
    inside[:-1] = table[np.where(small, codes, 0)] | ~small
    inside[starts + lens] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    up, down = powers.upto(len(codes) + 1)
    pre = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=pre[1:])
    h = mix((pre[end] - pre[begin]) * down[begin])
    first = np.searchsorted(begin, np.append(starts, len(codes)))
    return h, begin, end, first


def column_slices(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, pa.Array]]:
    """Ranges of rows of about `limit` bytes, as Arrow slices that are not decoded."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    lo = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and held + n > limit:
            yield lo, i, column.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes), column.slice(lo)


def byte_words(column: pa.Array, inside: np.ndarray, values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`words` on the bytes of an Arrow text column: hashes, begins, ends, each text's first word, and the bytes.

    inside, values: for each of the 256 bytes, whether it is part of a word, and
    the number that it counts as. Null texts are empty.
    """
    column = pa.compute.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    some = np.flatnonzero(at[1:] > at[:-1])
    there = inside[raw]
    opens, closes = there.copy(), there.copy()
    opens[1:] &= ~there[:-1]
    closes[:-1] &= ~there[1:]
    opens[at[some]], closes[at[some + 1] - 1] = there[at[some]], there[at[some + 1] - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = powers.upto(len(raw) + 1)
    pre = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=pre[1:])
    return mix((pre[end] - pre[begin]) * down[begin]), begin, end, np.searchsorted(begin, at), raw


def byte_lane(lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For `byte_words`: words are runs of other than the six ASCII blanks, A-Z lower-cased or not."""
    inside = np.ones(256, bool)
    inside[[9, 10, 11, 12, 13, 32]] = False
    values = np.arange(1, 257, dtype=np.uint64)
    if lower:
        values[65:91] += np.uint64(32)
    return inside, values


def word_spans(h: np.ndarray, powers: Powers) -> Callable:
    """A function (begins, ends) -> hashes of the words from begin to end, one mixed number for each stretch."""
    up, down = powers.upto(len(h) + 1)
    pre = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=pre[1:])
    return lambda lo, hi: mix((pre[hi] - pre[lo]) * down[lo])


def kept_text(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space; arguments as `byte_words` returns them."""
    last = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(keep, out=last[1:])
    kept = np.flatnonzero(keep)
    closing = np.zeros(len(begin), bool)  # the last kept word of its text takes no blank along
    some = last[first[1:]] > last[first[:-1]]
    closing[kept[last[first[1:]][some] - 1]] = True
    width = np.where(keep, end - begin + ~closing, 0)
    edge = np.zeros(len(raw) + 2, np.int8)
    edge[begin[kept]] += 1
    edge[(begin + width)[kept]] -= 1
    out = raw[np.cumsum(edge[: len(raw)], dtype=np.int8) > 0]
    out[(out == 32) | ((out >= 9) & (out <= 13))] = 32
    sizes = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(width, out=sizes[1:])
    return pa.Array.from_buffers(pa.string(), len(first) - 1, [None, pa.py_buffer(sizes[first].astype(np.int32)), pa.py_buffer(out)])


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable, text_col: str) -> DataFrame:
    """Adds columns computed by `make()(list of texts) -> list of arrays`, from texts of about a chunk at a time.

    `make` runs once per task. Existing columns of the new names are replaced.
    """
    names = {f.name for f in fields}
    kept = df.select(*[df[c] for c in df.columns if c not in names])
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches):
        fn = make()
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(batch.schema.get_field_index(text_col))):
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *(pa.array(x) for x in fn(texts))], names=[*batch.schema.names, *(f.name for f in fields)])

    return kept.mapInArrow(run, schema)


def held_out(id_col: str | Column, parts: int, part: int) -> Column:
    """crc32 of the id as text leaves the remainder `part`; a null id counts as empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts) == part


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at the most, chosen by a hash of `key`; all rows if there are no more."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000_007)) < int(1_000_000_007 * most / n))
