"""Paired statistics over (query_id, a, b), or (query_id, system, value)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_ranks(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with their number and their average rank over all rows: counts per value, added up over range partitions."""
    counts = values.groupBy(column).agg(F.count("*").alias("ties")).repartitionByRange(column).withColumn("_p", F.spark_partition_id())
    inner = Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("_p").agg(F.sum("ties").alias("_s"))  # a row for each range
    offsets = sums.withColumn("_o",
        F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    ranked = counts.withColumn("_b", F.coalesce(F.sum("ties").over(inner), F.lit(0))).join(offsets, "_p")
    return ranked.select(column, "ties", (F.col("_o") + F.col("_b") + (F.col("ties") + 1) / 2).alias("rank"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Signed-rank statistic of a - b without zeros: n, w_plus, w_minus, statistic (the lesser), tie_term (sum of t^3 - t)."""
    diffs = pairs.select(F.round(F.col("a") - F.col("b"), 9).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    ranks = average_ranks(diffs, "m")
    both = diffs.groupBy("m").agg(F.sum((F.col("d") > 0).cast("long")).alias("up"),
        F.sum((F.col("d") < 0).cast("long")).alias("down")).join(ranks, "m")
    out = both.agg(
        F.coalesce(F.sum("ties"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.col("up") * F.col("rank")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.col("down") * F.col("rank")), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(F.col("ties").cast("double") * F.col("ties") * F.col("ties") - F.col("ties")), F.lit(0.0)).alias("tie_term"))
    return out.withColumn("statistic", F.least("w_plus", "w_minus"))


def wilcoxon_p(row: DataFrame) -> DataFrame:
    """Adds p_value: exact for up to 50 differences without ties, else the normal approximation with tie correction; 1 for none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p_value=[signed_rank_p(int(n), float(w), float(t)) for n, w, t in zip(b["n"], b["statistic"], b["tie_term"], strict=True)])

    return row.mapInPandas(work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in row.schema) + ", p_value double")


def signed_rank_p(n: int, w: float, tie_term: float) -> float:
    if n == 0:
        return 1.0
    if n <= 50 and tie_term == 0:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    return min(1.0, math.erfc(abs(w - mean) / math.sqrt(2 * var))) if var > 0 else 1.0


def holm(tests: DataFrame, p: str = "p_raw", alpha: float = 0.05) -> DataFrame:
    """Adds p_adjusted and significant. The tests are one family, a few dozen rows: one window."""
    order = Window.orderBy(p, *[c for c in tests.columns if c != p])
    n = F.count("*").over(Window.partitionBy())
    step = F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(order) + 1))
    out = tests.withColumn("_s", step).withColumn("p_adjusted", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    return out.withColumn("significant", F.col("p_adjusted") < alpha)


def winner(delta: Column, significant: Column) -> Column:
    return F.when(~significant, "tie").when(delta > 0, "a").when(delta < 0, "b").otherwise("tie")


def friedman(values: DataFrame) -> DataFrame:
    """Chi-square of systems' ranks within queries, with tie correction: n_queries, n_systems, statistic."""
    own = Window.partitionBy("query_id")
    ranked = values.withColumn("r", F.rank().over(own.orderBy("value")) + (F.count("*").over(Window.partitionBy("query_id", "value")) - 1) / 2)
    ties = values.groupBy("query_id", "value").agg(F.count("*").alias("t")).agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    size = ranked.agg(F.countDistinct("query_id").alias("n_queries"), F.countDistinct("system").alias("n_systems"))
    sums = ranked.groupBy("system").agg(F.sum("r").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("squares"))
    n, k = F.col("n_queries").cast("double"), F.col("n_systems").cast("double")
    chi = (12 / (n * k * (k + 1)) * F.col("squares") - 3 * n * (k + 1)) / (1 - F.col("ties") / (n * k * (k * k - 1)))
    return size.crossJoin(sums).crossJoin(ties).select("n_queries", "n_systems", F.when(k >= 3, F.round(chi, 6)).alias("statistic"))  # one row each


def chi2_tail(x: float, df: int) -> float:
    """The upper tail of the chi-square distribution: a finite sum for even degrees, one with erfc for odd ones."""
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        term = total = math.exp(-h)
        for k in range(1, df // 2):
            term *= h / k
            total += term
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= h / (k + 0.5)
    return min(1.0, total)


def bootstrap(values: DataFrame, column: str, resamples: int = 5000, level: float = 0.95) -> DataFrame:
    """Mean and its percentile interval. Each row counts Poisson(1) times in a resample, by a hash of (key, resample): rows are
    never copied, only sums per resample are shuffled. ``values`` has query_id and ``column``."""
    u = (F.pmod(F.xxhash64("query_id", "b"), F.lit(1_000_000_007)) + 0.5) / 1_000_000_007
    steps, mass, c = [], 0.0, math.exp(-1)
    for k in range(12):
        mass += c / math.factorial(k)
        steps.append(mass)
    weight = sum(((u > s).cast("int") for s in steps), F.lit(0))
    rows = values.select("query_id", F.col(column).alias("v")).withColumn("b",
        F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight)
    means = rows.groupBy("b").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    side = (1 - level) / 2
    limits = means.agg(F.percentile("m", F.lit(side)).alias("low"), F.percentile("m", F.lit(1 - side)).alias("high"))
    return values.agg(F.avg(column).alias("mean")).crossJoin(limits)  # one row each


def pair_groups(systems: DataFrame, backbones: tuple[str, str], strategies: tuple[str, str] = ("E1", "E2")) -> DataFrame:
    """Which systems (backbone, strategy, ranker) are compared: key_a, key_b, grp. A pair of several groups has the first."""
    key = lambda t: F.concat_ws("__", *[F.col(f"{t}.{c}") for c in ("backbone", "strategy", "ranker")])
    a, b = systems.alias("a"), systems.alias("b")
    same = lambda *cs: [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cs]
    def pairs(order: int, name: str, on: list[Column]) -> DataFrame:
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        return a.join(b, cond).select(key("a").alias("key_a"), key("b").alias("key_b"), F.lit(order).alias("o"), F.lit(name).alias("grp"))
    every = pairs(1, "backbone", [*same("strategy", "ranker"), F.col("a.backbone") == backbones[0], F.col("b.backbone") == backbones[1]])
    every = every.unionByName(pairs(2, "strategy", [*same("backbone", "ranker"), F.col("a.strategy") == strategies[0],
        F.col("b.strategy") == strategies[1]]))
    every = every.unionByName(pairs(3, "reranker_vs_attention",
        [*same("backbone", "strategy"), F.col("a.ranker") == "attention", F.col("b.ranker") != "attention"]))
    every = every.unionByName(pairs(4, "score_vs_rank",
        [*same("backbone", "strategy"), F.col("a.ranker").isin("attention", "softmax"), F.col("b.ranker").isin("rrf", "borda")]))
    return every.groupBy("key_a", "key_b").agg(F.min(F.struct("o", "grp")).alias("g")).select("key_a", "key_b", F.col("g.grp").alias("grp"))
