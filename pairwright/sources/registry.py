"""A table that is added to by key, never twice: the keys lie beside it in buckets, so a batch reads only what its own keys can meet."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rewrite import Files

#: Keys in a bucket, on average, at which the registry is dealt out to more buckets.
FULL = 100_000


class Registry:
    """Rows under ``<path>/rows/batch=...``, and hashes of their keys under ``<path>/keys/<generation>/bucket=.../batch=...``.

    A batch has a name. Adding it again, after a restart or by mistake, leaves the table as it was: its rows are written to
    the folder of its name, in place of what an attempt cut short may have left, and only then its keys and its mark.
    A batch reads the keys of its own buckets, never the rows. When buckets are ``full`` on average the keys are
    dealt out to four times as many, as a generation of their own that is published by one rename; so a batch of m keys reads about m
    buckets of at most ``full`` keys, however large the table is. Keys are compared as two 64-bit hashes.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16, full: int = FULL):
        self.spark, self.path, self.key, self.full = spark, path.rstrip("/"), key, full
        self.files = Files(spark, path)
        if not self.files.exists(f"{self.path}/CURRENT"):
            self.files.mark(f"{self.path}/CURRENT", json.dumps({"generation": "g0", "buckets": buckets}))

    def _current(self) -> tuple[str, int]:
        about = json.loads(self.files.text(f"{self.path}/CURRENT"))
        return f"{self.path}/keys/{about['generation']}", about["buckets"]

    def _hashed(self, rows: DataFrame, buckets: int) -> DataFrame:
        h = F.xxhash64(F.col(self.key).cast("string"))
        return rows.withColumns({"_h1": h, "_h2": F.xxhash64(F.lit(1), F.col(self.key).cast("string")), "_bucket": F.pmod(h, F.lit(buckets)).cast("int")})

    def rows(self) -> DataFrame:
        """All rows of finished batches."""
        done = self.files.sizes(f"{self.path}/done") if self.files.exists(f"{self.path}/done") else []
        paths = [f"{self.path}/rows/batch={name}" for name, _, _ in done if not name.startswith(".") and not name.endswith(".part")]
        if not paths:
            raise FileNotFoundError(f"no batch was added to {self.path} yet")
        return self.spark.read.parquet(*paths)

    def known(self, fresh: DataFrame, batch: str) -> DataFrame:
        """(``_h1``, ``_h2``, ``_bucket``) of the keys that other batches have, in the buckets of ``fresh`` only."""
        folder, _ = self._current()
        asked = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # as many as there are buckets, at most
        there = [f"{folder}/bucket={b}" for b in asked if self.files.exists(f"{folder}/bucket={b}")]
        if not there:
            return self.spark.createDataFrame([], "_h1 bigint, _h2 bigint, _bucket int")
        keys = self.spark.read.schema("_h1 bigint, _h2 bigint, bucket int, batch string").option("basePath", folder).parquet(*there)
        return keys.where(F.col("batch") != batch).select("_h1", "_h2", F.col("bucket").alias("_bucket"))

    def add(self, rows: DataFrame, batch: str | int) -> None:
        """Add the rows of a batch whose key no other batch has, each key once (which of its rows is not said). A null key is a key."""
        batch = str(batch)
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("a batch's name is made of letters, digits, '_', '.' and '-'")
        if self.files.exists(f"{self.path}/done/{batch}"):
            return
        folder, buckets = self._current()
        fresh = self._hashed(rows.dropDuplicates([self.key]), buckets)
        new = fresh.join(self.known(fresh, batch), ["_h1", "_h2", "_bucket"], "left_anti").select(rows.columns)
        new.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/batch={batch}")
        keys = self._hashed(written, buckets).select("_h1", "_h2", F.col("_bucket").alias("bucket"), F.lit(batch).alias("batch"))
        keys.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(folder)
        self.files.mark(f"{self.path}/done/{batch}")
        self._grow()

    def _grow(self) -> None:
        folder, buckets = self._current()
        keys = self.spark.read.schema("_h1 bigint, _h2 bigint, bucket int, batch string").parquet(folder) if self.files.exists(folder) else None
        if keys is None or keys.count() <= buckets * self.full:  # counted from the files' footers
            return
        more, generation = buckets * 4, f"g-{uuid.uuid4().hex}"
        dealt = keys.withColumn("bucket", F.pmod("_h1", F.lit(more)).cast("int"))
        dealt.repartition("bucket").write.partitionBy("bucket", "batch").parquet(f"{self.path}/keys/{generation}")
        self.files.mark(f"{self.path}/CURRENT", json.dumps({"generation": generation, "buckets": more}))
        self.files.delete(folder)
