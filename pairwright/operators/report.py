"""Flags rolled up to dimensions and two axes, which are never averaged; what no check reaches is reported as unexamined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which dimension each check answers to, the axes of each dimension, and the weights by situation.
CHECK_DIMENSION = {
    "id_parity": "D2", "numeric_parity": "D2", "entity_check": "D2", "severity_drift": "D3", "claim_inflation": "D3",
    "caveat_parity": "D4", "status_drift": "D4", "negation_flip": "D4",
    "reader_questions": "D1", "prohibited_jargon": "D6", "format_constants": "D8", "format_lint": "D8",
}
AXES = {"D1": ("U",), "D2": ("F",), "D3": ("F",), "D4": ("F",), "D5": ("F", "U"), "D6": ("U",), "D7": ("U",), "D8": ("U",)}
SITUATIONS = tuple(f"S{n:02d}" for n in range(1, 12))
WEIGHTS = {
    "D1": (3, 3, 3, 2, 3, 3, 2, 3, 3, 3, 2),
    "D2": (3, 2, 3, 3, 3, 2, 3, 3, 3, 2, 1),
    "D3": (3, 3, 3, 2, 3, 3, 3, 3, 2, 3, 2),
    "D4": (2, 2, 3, 2, 3, 3, 2, 1, 2, 2, 1),
    "D5": (3, 3, 2, 2, 3, 3, 3, 2, 2, 3, 3),
    "D6": (2, 3, 2, 2, 2, 3, 2, 3, 1, 3, 3),
    "D7": (3, 3, 2, 3, 1, 3, 3, 3, 3, 3, 2),
    "D8": (2, 3, 2, 2, 3, 2, 3, 2, 2, 1, 1),
}


def weight_table(spark: SparkSession) -> DataFrame:
    """(``dimension``, ``situation``, ``weight``), 88 rows."""
    return spark.createDataFrame([(d, s, w) for d, ws in WEIGHTS.items() for s, w in zip(SITUATIONS, ws, strict=True)], "dimension string, situation string, weight int")


def dimensions(judged: DataFrame, id: str, situation: str = "S01", ran: str | None = None) -> DataFrame:
    """A row per judged row and dimension: ``weight``, ``fails``, ``warns``, ``examined``, ``invalidating`` (a fail of weight 3).

    ``ran`` names a column with the checks that ran; without it, all checks that a text pair alone allows.
    """
    if situation not in SITUATIONS:
        raise ValueError(f"unknown situation {situation}")
    ran_checks = F.col(ran) if ran else F.array(*[F.lit(c) for c, d in CHECK_DIMENSION.items() if d not in ("D1", "D6")])
    of = lambda d: F.array(*[F.lit(c) for c, x in CHECK_DIMENSION.items() if x == d])
    count = lambda d, level: F.size(F.filter("flags", lambda f: (f["level"] == level) & F.array_contains(of(d), f["check"]))).cast("bigint")
    at = SITUATIONS.index(situation)
    rows = F.array(*[
        F.struct(
            F.lit(d).alias("dimension"), F.array(*map(F.lit, AXES[d])).alias("axes"), F.lit(WEIGHTS[d][at]).alias("weight"),
            count(d, "fail").alias("fails"), count(d, "warn").alias("warns"),
            (F.arrays_overlap(ran_checks, of(d)) if any(x == d for x in CHECK_DIMENSION.values()) else F.lit(False)).alias("examined"),
        )
        for d in WEIGHTS
    ])
    out = judged.select(id, F.explode(rows).alias("d")).select(id, "d.*")
    return out.withColumn("invalidating", (F.col("fails") > 0) & (F.col("weight") == 3))


def axes(judged: DataFrame, id: str, situation: str = "S01", ran: str | None = None) -> DataFrame:
    """A row per judged row and axis (F fidelity, U usefulness): ``fails``, ``warns``, ``failed`` and ``unexamined`` dimensions, ``invalid``. A dimension on two axes counts on both."""
    long = dimensions(judged, id, situation, ran).withColumn("axis", F.explode("axes"))
    named = lambda condition: F.array_sort(F.collect_list(F.when(condition, F.col("dimension"))))
    return long.groupBy(id, "axis").agg(
        F.sum("fails").alias("fails"), F.sum("warns").alias("warns"), named(F.col("fails") > 0).alias("failed"), named(~F.col("examined")).alias("unexamined"), F.max("invalidating").alias("invalid")
    )
