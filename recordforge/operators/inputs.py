"""Building and cutting the input records of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from recordforge.functions.names import free_names
from recordforge.sources.tables import materialise


def read_inputs(spark: SparkSession, src, fmt: str = "parquet") -> DataFrame:
    """A record set from a path (parquet, json, csv) or a list of dicts."""
    if isinstance(src, str):
        reader = spark.read.format(fmt)
        return (reader.option("header", "true") if fmt == "csv" else reader).load(src)
    if not src:
        raise ValueError("no input records")
    return spark.createDataFrame(src)


#: Splits whose row numbers are sent to every task; more of them are joined.
MOST_SPLITS = 100_000


def number_inputs(spark: SparkSession, path: str, fmt: str = "parquet", name: str = "idx", schema=None) -> DataFrame:
    """The rows of files with their position as `name`, from 0, in the order of file names and of rows within a file.

    The rows of each split are counted, and the counts added up over files and splits; within
    a split a row's number is its place. So there is no sort of rows, and the numbers do not
    depend on how the files are read: only new files or other names change them. A column
    of this name in the files is replaced.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    rows = (reader.schema(schema) if schema else reader).load(path)
    columns = [c for c in rows.columns if c != name]
    file, block, place, least, before = free_names(rows.columns, "_file", "_block", "_place", "_least", "_before")
    # Within a partition ids follow the order of rows, so those of a split are a range.
    placed = rows.select(*columns, F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(place))
    splits = placed.groupBy(file, block).agg(F.min(place).alias(least), F.count("*").alias("n"))
    earlier = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(splits.select(F.col(file).alias(f"{file}2"), F.col(block).alias(f"{block}2"), least, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before)), "splits")
    known = F.broadcast(offsets) if offsets.count() <= MOST_SPLITS else offsets
    joined = placed.join(known, (F.col(file) == F.col(f"{file}2")) & (F.col(block) == F.col(f"{block}2")))
    return joined.select((F.col(before) + F.col(place) - F.col(least)).cast("long").alias(name), *columns)


def check_columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> None:
    """Errors for a missing required or an unknown column."""
    if missing := set(required) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    if unknown := set(df.columns) - set(required) - set(optional) - {"idx"}:
        raise ValueError(f"unknown columns: {sorted(unknown)}")


def zip_inputs(df: DataFrame, lists: Sequence[str] = (), scalars: dict | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per position of the parallel list columns, with idx from 0 in each row's lists.

    Rows of unequal list lengths raise an error. Later sources win: kept columns,
    then lists, then scalars.
    """
    out = df
    if lists:
        sizes = [F.size(c) for c in lists]
        same = F.lit(True)
        for s in sizes[1:]:
            same = same & (s == sizes[0])
        checked = F.when(same, F.arrays_zip(*lists)).otherwise(F.raise_error(F.lit("parallel lists of unequal length")))
        out = df.select(*[c for c in keep if c not in lists], F.posexplode(checked).alias("idx", "_z")).select(*[c for c in keep if c not in lists], F.col("idx").cast("long"), *[F.col(f"_z.{c}").alias(c) for c in lists])
    for name, value in (scalars or {}).items():
        out = out.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    return out


def config_hash(df: DataFrame, columns: Sequence[str], name: str = "run_config_hash") -> DataFrame:
    """SHA-256 of the row's columns in the order of their names, nulls kept.

    The text that is hashed is `name=value` joined by the unit separator; a null
    is the record separator.
    """
    part = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\x1e")))
    return df.withColumn(name, F.sha2(F.concat_ws("\x1f", *[part(c) for c in sorted(columns)]), 256))


def dry_run(df: DataFrame) -> DataFrame:
    return df.orderBy("idx").limit(1)


def _by_hash(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), F.col(key)]


def sample_exact(df: DataFrame, n: int, key: str = "idx", seed: int = 0) -> DataFrame:
    """A repeatable random cut to n rows (a top-n by hash); fewer rows stay as they are."""
    return df.orderBy(*_by_hash(key, seed)).limit(n)


def shuffle_rows(df: DataFrame, key: str = "idx", seed: int = 0, name: str = "place") -> DataFrame:
    """Adds each row's place (from 1) in a repeatable random order.

    Rows are counted per hash range first, so no single task numbers the table.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    return global_rank(df.withColumn("_h", h), F.substring("_h", 1, 3), [F.col("_h"), F.col(key)], name).drop("_h")


def global_rank(df: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the rank over the whole table by (bucket, order); `bucket` has few, ordered values."""
    return rank_within(df, [], bucket, order, name)


def rank_within(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds each row's rank (from 1) among the rows of its keys, by (bucket, order).

    Buckets are ordered slices of a key's rows. Only their sizes are added up
    per key; rows are numbered within a bucket, so a hot key is many tasks' work.
    """
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_slice"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_bucket").eqNullSafe(F.col("_slice"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    joined = tagged.join(offsets, same)
    return joined.withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_bucket", "_slice", "_before", *[f"_key{i}" for i in range(len(keys))])


def attach_contract(df: DataFrame, contract: DataFrame) -> DataFrame:
    """The one row of `contract` beside every row."""
    one = contract.limit(2)
    if one.count() != 1:
        raise ValueError("a contract is one row")
    return df.crossJoin(F.broadcast(one))
