"""Replacing tables whole: a reader finds the old rows or the new ones, and a run that was cut short is finished or undone by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """The Hadoop file system of a path, in the few calls that are needed here."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def rename(self, source: str, target: str) -> None:
        if self.exists(target) or not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def mark(self, path: str, text: str = "") -> None:
        """A small file, there as soon as it has its content."""
        out = self._fs.create(self._path(f"{path}.part"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.delete(path)
        self.rename(f"{path}.part", path)

    def text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def sizes(self, path: str) -> list[tuple[str, int, int]]:
        """(name, bytes, time of change) of the files at or directly under a path."""
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self._fs.listStatus(self._path(path)))


def fingerprint(rows: DataFrame) -> tuple[int, int]:
    """How many rows there are, and a sum of hashes that does not depend on their order."""
    columns = [F.to_json(c) if rows.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in rows.columns]
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return n, int(total or 0)


def _names(path: str) -> tuple[str, str, str]:
    path = path.rstrip("/")
    return f"{path}.staged", f"{path}.previous", f"{path}.commit"


def recover(spark: SparkSession, path: str) -> str:
    """Bring a table into one state after a rewrite that was cut short.

    If the new rows were complete and verified (the commit mark is there), the rewrite is finished; if not, it is undone.
    Says what was done: ``finished``, ``undone`` or ``nothing``. To do it twice is harmless.
    """
    files, (staged, previous, commit) = Files(spark, path), _names(path)
    if files.exists(commit):
        if files.exists(staged):
            if files.exists(path):
                files.delete(previous)
                files.rename(path, previous)
            files.rename(staged, path)
        files.delete(commit)
        return "finished"
    undone = files.exists(staged) or not files.exists(path) and files.exists(previous)
    files.delete(staged)
    if not files.exists(path) and files.exists(previous):
        files.rename(previous, path)
    return "undone" if undone else "nothing"


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame, DataFrame], bool] | None = None, keep_previous: bool = True, after: Callable[[str], None] = lambda phase: None) -> DataFrame:
    """The Parquet table at ``path`` replaced by ``change`` of it, in two phases; returns the new table.

    First the new rows are written beside the old ones, counted and hashed as written and as read back, and held against
    ``check(old, new)``, which must be true; then a mark is set, and from there on the rewrite will be finished, by this run
    or by ``recover`` in the next: the old table is renamed and the new one takes its name. Nothing but renames happens
    while the name is free. The old rows stay as ``<path>.previous`` unless ``keep_previous`` is off; they too are counted
    and hashed, before and after. ``after`` is told of each phase as it ends; tests raise there.
    """
    recover(spark, path)
    files, (staged, previous, commit) = Files(spark, path), _names(path)
    old = spark.read.parquet(path)
    before = fingerprint(old)
    new = change(old)
    new.write.parquet(staged)
    after("written")
    written = spark.read.schema(new.schema).parquet(staged)
    if fingerprint(written) != fingerprint(new):
        files.delete(staged)
        raise OSError(f"rows of {staged} are not those computed")
    if check is not None and not check(old, written):
        files.delete(staged)
        raise ValueError(f"the new rows of {path} fail their check; the table is unchanged")
    files.mark(commit, f"{before}")
    after("verified")
    files.delete(previous)
    files.rename(path, previous)
    after("moved")
    files.rename(staged, path)
    after("replaced")
    files.delete(commit)
    if fingerprint(spark.read.schema(old.schema).parquet(previous)) != before:
        raise OSError(f"rows of {previous} are not those that were there")
    if not keep_previous:
        files.delete(previous)
    return spark.read.schema(new.schema).parquet(path)


def only_blanks_filled(id: str, columns: list[str]) -> Callable[[DataFrame, DataFrame], bool]:
    """A check for ``rewrite``: the same ids as often, and no value changed that was neither null nor blank."""

    def holds(old: DataFrame, new: DataFrame) -> bool:
        kept = [F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")).alias(f"_{k}") for k, c in enumerate(columns)]
        a = old.groupBy(id, *kept).agg(F.count("*").alias("n"))
        b = new.select(F.col(id).alias("_id"), *[F.col(c).cast("string").alias(f"v{k}") for k, c in enumerate(columns)])
        same_rows = old.select(id).exceptAll(new.select(id)).isEmpty() and new.select(id).exceptAll(old.select(id)).isEmpty()
        fits = F.lit(True)
        for k in range(len(columns)):
            fits = fits & (F.col(f"_{k}").isNull() | F.col(f"_{k}").eqNullSafe(F.col(f"v{k}")))
        lost = a.join(b, F.col(id).eqNullSafe(F.col("_id")) & fits, "left_anti")
        return same_rows and lost.isEmpty()

    return holds
