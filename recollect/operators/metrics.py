"""Latency statistics, objectives, and counts by outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARES = (0.50, 0.95, 0.99)


def latencies(samples: DataFrame, *key: str) -> DataFrame:
    """Count, errors, least, nearest-rank percentiles, most and mean (AGG13)."""
    sums = samples.groupBy(*key).agg(F.count("latency_ms").alias("n"), F.count_if("failed").alias("errors"), F.min("latency_ms").alias("least"), F.max("latency_ms").alias("most"), F.avg("latency_ms").alias("mean"))
    # equal values are added up before they meet, and ranks are running sums over sorted values, which may spill
    values = samples.where("latency_ms is not null").groupBy(*key, "latency_ms").agg(F.count("*").alias("copies"))
    of_key, by = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("latency_ms")
    placed = values.withColumn("_through", F.sum("copies").over(by)).withColumn("_all", F.sum("copies").over(of_key))
    ranks = placed.groupBy(*key).agg(*(F.min(F.when(F.col("_through") >= F.ceil(F.col("_all") * F.lit(p)), F.col("latency_ms"))).alias(f"p{round(p * 100)}") for p in SHARES))
    out = sums.join(ranks, list(key), "left") if key else sums.crossJoin(ranks)  # one row each
    return out.select(*key, "n", "errors", "least", *(f"p{round(p * 100)}" for p in SHARES), "most", "mean")


def verdicts(stats: DataFrame, limits: dict[str, float]) -> DataFrame:
    """ok where there are samples, no errors and no percentile over its limit; equality is within it (AGG14)."""
    ok = (F.col("n") > 0) & (F.col("errors") == 0)
    for name, most in limits.items():
        ok = ok & (F.col(name) <= most)
    return stats.withColumn("ok", ok)


def stage_counts(**stages: DataFrame) -> DataFrame:
    """One row with the number of rows of each stage's table (AGG18)."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    every = each[0]
    for df in each[1:]:
        every = every.unionAll(df)
    return every.groupBy().pivot("stage", list(stages)).agg(F.first("n"))


def throughput(samples: DataFrame, key: str, started: str, ended: str) -> DataFrame:
    """Samples a second from the first start to the last end, 0 for no time at all (AGG13)."""
    took = (F.unix_micros(F.max(ended)) - F.unix_micros(F.min(started))) / 1_000_000
    return samples.groupBy(key).agg(F.count("*").alias("n"), F.when(took > 0, F.count("*") / took).otherwise(0.0).alias("per_second"))


def pivoted(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Counts by key, a column for each of the stated values (AGG15)."""
    return rows.groupBy(key).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def histogram(samples: DataFrame, key: str, bounds: list[float]) -> DataFrame:
    """Samples at or below each bound, cumulative, as metrics are exposed (AGG17)."""
    return samples.groupBy(key).agg(*(F.count_if(F.col("latency_ms") <= b).alias(f"le_{i}") for i, b in enumerate(bounds)), F.count("*").alias("n"))
