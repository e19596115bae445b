"""Windows of byte-pair tokens, by a public vocabulary of ranks."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

#: A vocabulary of this many bytes at the most is sent to every task.
MOST_BYTES = 64 << 20
WINDOW = T.ArrayType(T.StructType([T.StructField("chunk", T.StringType()), T.StructField("n_tokens", T.IntegerType())]))


def read_ranks(path: str) -> bytes:
    """A rank file as it stands: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"a vocabulary of more than {MOST_BYTES} bytes")
    return raw


@functools.lru_cache(maxsize=4)
def encoder(ranks: bytes, pattern: str):
    """The encoder of a rank file; once for each worker process."""
    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def windows(tokens: list[int], size: int, overlap: int) -> Iterator[list[int]]:
    """`size` tokens at a time, `size - overlap` apart; the last window reaches the end."""
    for at in range(0, max(1, len(tokens) - overlap), size - overlap):
        if tokens:
            yield tokens[at : at + size]


def split_bpe(spark: SparkSession, text: Column, ranks_path: str, pattern: str, size: int = 400, overlap: int = 20) -> Column:
    """Windows (chunk, n_tokens) of `size` byte-pair tokens of the text.

    A window's chunk is the text of its tokens; a character that a window cuts is a replacement sign
    in both. An empty text has no window, a null one null. ranks_path is read on the driver,
    and its bytes (`MOST_BYTES` at the most) go to the tasks once for each executor.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf(WINDOW)
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        code = encoder(ranks.value, pattern)
        for texts in batches:
            yield pd.Series([None if t is None else [{"chunk": code.decode(w), "n_tokens": len(w)} for w in windows(code.encode_ordinary(t), size, overlap)] for t in texts], dtype=object)

    return split(text)
