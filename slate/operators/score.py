"""Statistics of results and of predictions. Sums are of whole numbers wherever the measure allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 6) -> Column:
    """Half up at so many places: floor(x * 10^p + 0.5) / 10^p."""
    return F.floor(x * 10**places + F.lit(0.5)) / F.lit(float(10**places))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def records(tg: DataFrame) -> DataFrame:
    """W-L-T record, points and goals per team."""
    return tg.groupBy("team").agg(
        F.count("*").alias("games"),
        F.count_if(F.col("half_points") == 2).alias("wins"),
        F.count_if(F.col("half_points") == 0).alias("losses"),
        F.count_if(F.col("half_points") == 1).alias("ties"),
        F.sum("half_points").alias("points"),
        F.sum("gf").alias("gf"),
        F.sum("ga").alias("ga"),
        F.sum(F.greatest(F.lit(-3), F.least(F.lit(3), F.col("gf") - F.col("ga")))).alias("capped_diff"),
    )


def pythagoras(gf: Column, ga: Column, n: Column, k: float) -> Column:
    a, b = F.pow(gf / n + F.lit(0.5), F.lit(k)), F.pow(ga / n + F.lit(0.5), F.lit(k))
    return a / (a + b)


def schedule_strength(tg: DataFrame) -> DataFrame:
    """Per team: own win share, opponents' share and their opponents' share (own games stay in), weighted by games met.

    Games are first counted per pair of teams, so both joins run over pairs and not over games.
    """
    pairs = tg.groupBy("team", "opp").agg(F.count("*").alias("n"), F.sum("half_points").alias("half"))
    own = pairs.groupBy("team").agg((F.sum("half") / (F.sum("n") * 2)).alias("wp"))
    theirs = own.select(F.col("team").alias("opp"), F.col("wp").alias("opp_wp"))
    second = pairs.join(theirs, "opp").groupBy("team").agg((F.sum(F.col("n") * F.col("opp_wp")) / F.sum("n")).alias("owp"))
    further = second.select(F.col("team").alias("opp"), F.col("owp").alias("opp_owp"))
    third = pairs.join(further, "opp").groupBy("team").agg((F.sum(F.col("n") * F.col("opp_owp")) / F.sum("n")).alias("oowp"))
    return own.join(second, "team").join(third, "team")


def measures(p: Column, half: Column) -> tuple[Column, Column, Column]:
    """Hit (ties and even predictions count half), log-loss (clamped at 1e-6) and squared error of one prediction."""
    y = half / F.lit(2.0)
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    hit = F.when((p == 0.5) | (half == 1), 0.5).when((p > 0.5) == (half == 2), 1.0).otherwise(0.0)
    return hit, -(y * F.ln(q) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - q)), (p - y) * (p - y)


def prediction_scores(rows: DataFrame, p: Column, half: Column, by: list[str]) -> DataFrame:
    """Accuracy (ties and even predictions count half), log-loss (clamped at 1e-6) and Brier score; rows without p are left out."""
    hit, loss, square = measures(p, half)
    return rows.where(p.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(loss).alias("log_loss"), F.avg(square).alias("brier")
    )


def counted_scores(rows: DataFrame, p: Column, outcomes: Column, by: list[str]) -> DataFrame:
    """``prediction_scores`` of rows that stand for several games of one chance: ``outcomes`` is the array of those lost, tied and won."""
    won, tied, lost = outcomes[2], outcomes[1], outcomes[0]
    n = lost + tied + won
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    hits = F.when(p == 0.5, n / 2).otherwise(F.when(p > 0.5, won).otherwise(lost) + tied / 2)
    loss = -((won + tied / 2) * F.ln(q) + (lost + tied / 2) * F.ln(F.lit(1.0) - q))
    squares = lost * p * p + tied * (p - 0.5) * (p - 0.5) + won * (p - 1) * (p - 1)
    sums = rows.where(p.isNotNull()).groupBy(*by).agg(F.sum(n).alias("n"), *[F.sum(c).alias(name) for name, c in (("accuracy", hits), ("log_loss", loss), ("brier", squares))])
    return sums.select(*by, "n", *[(F.col(c) / F.col("n")).alias(c) for c in ("accuracy", "log_loss", "brier")])


def band(value: Column, edges: list[float]) -> Column:
    """Number of the first band [lo, hi) that holds the value; the last takes what is beyond."""
    out = F.lit(len(edges) - 2)
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((value >= edges[i]) & (value < edges[i + 1]), i).otherwise(out)
    return out.cast("long")


def order_statistic(df: DataFrame, value: str, shares: list[float], by: list[str]) -> DataFrame:
    """Per group the sorted value at place min(n - 1, floor(share * n)), neither interpolated nor sampled.

    Values are counted per group first and the place is found in their running counts, so repeated values cost one row.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy(value)
    whole = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    running = counts.withColumn("upto", F.sum("n").over(upto)).join(whole, by)
    picks = [F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.lit(s) * F.col("total"))), F.col(value))).alias(f"q{round(100 * s)}") for s in shares]
    return running.groupBy(*by).agg(F.max("total").alias("n"), *picks)


def centred(df: DataFrame, value: str, by: str) -> DataFrame:
    """The value less its group's mean; means come from a small aggregate that is joined back."""
    means = df.groupBy(by).agg((F.sum(value) / F.count(value)).alias("group_mean"))
    return df.join(means, by).withColumn("centred", F.col(value) - F.col("group_mean"))
