"""An append-only log of a run's attempts, from which a killed run goes on.

    <path>/attempts/round=<n>   the attempts of a round
    <path>/commits/<n>.json     written last: the run's state after the round, its completed inputs

A round without its commit does not count and is written over by the next one, so readers see
whole rounds only. Rounds are numbered from 1 without gaps.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class AttemptLog:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None) -> None:
        """schema: that of the attempts; None reads it from the files."""
        self.spark, self.path, self.schema = spark, path, schema
        self.last = len(self._commits())

    def _file(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        folder, fs = self._file("commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        found = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        if found != list(range(1, len(found) + 1)):
            raise ValueError(f"the log {self.path} lacks a round")
        return found

    def commit(self) -> dict:
        """What the last commit holds: `state` and `completed`; empty before the first."""
        if not self.last:
            return {"state": {}, "completed": 0}
        return json.loads(self.spark.read.text(f"{self.path}/commits/{self.last:06d}.json", wholetext=True).first()[0])

    def write(self, rows: DataFrame) -> DataFrame:
        """The attempts of the next round, written; it counts once `close` is called."""
        path = f"{self.path}/attempts/round={self.last + 1}"
        rows.write.mode("overwrite").parquet(path)
        self.schema = self.schema or rows.schema
        return self.spark.read.schema(self.schema).parquet(path)

    def close(self, state: dict, completed: int) -> None:
        """Commits the round: the file appears whole or not at all."""
        name = f"{self.last + 1:06d}.json"
        begun, fs = self._file("commits", f".{name}.tmp")
        stream = fs.create(begun, True)
        try:
            stream.write(json.dumps({"state": state, "completed": completed}).encode())
        finally:
            stream.close()
        if not fs.rename(begun, self._file("commits", name)[0]):
            raise OSError(f"round {self.last + 1} of {self.path} could not be committed")
        self.last += 1

    def rows(self) -> DataFrame | None:
        """All attempts of committed rounds; None before the first."""
        if not self.last:
            return None
        reader = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("round", T.IntegerType())])) if self.schema else self.spark.read
        return reader.parquet(f"{self.path}/attempts").filter(F.col("round") <= self.last).drop("round")
