"""What is known strictly before a day: counts, form, rest, streaks.

Rows are first reduced to one per (team, day), so windows run over days, whose number is bounded by the calendar, and not over
games; rows of the day itself never count. ``tg`` is a table of team games (views.team_games).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def _earlier() -> WindowSpec:
    return Window.partitionBy("team").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)


def daily(tg: DataFrame) -> DataFrame:
    return tg.groupBy("team", "day").agg(
        F.count("*").alias("n"),
        F.sum("half_points").alias("half_points"),
        F.sum("gf").alias("gf"),
        F.sum("ga").alias("ga"),
        F.max_by("half_points", "game_id").alias("last_half"),
    )


def before(tg: DataFrame) -> DataFrame:
    """(team, day) with n_before, sums before, last day and last result before; days on which the team plays."""
    sums = [F.coalesce(F.sum(c).over(_earlier()), F.lit(0)).alias(f"{c}_before") for c in ("n", "half_points", "gf", "ga")]
    return daily(tg).select("team", "day", *sums, F.max("day").over(_earlier()).alias("last_day"), F.last("last_half").over(_earlier()).alias("last_half_before"))


def per_game(games: DataFrame, known: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Games with each column twice: for the home and for the away side. ``known`` has (team, day)."""
    out = games
    for side in ("home", "away"):
        own = known.select(F.col("team").alias(side), "day", *[c.alias(f"{side}_{name}") for name, c in columns.items()])
        out = out.join(own, [side, "day"], "left")
    return out


def _numbered(tg: DataFrame) -> DataFrame:
    """Each game with its number in the team's history (days, then ids): from 1."""
    days = daily(tg).select("team", "day", F.coalesce(F.sum("n").over(_earlier()), F.lit(0)).alias("n_before"))
    inside = Window.partitionBy("team", "day").orderBy("game_id")
    return tg.join(days, ["team", "day"]).withColumn("k", F.col("n_before") + F.row_number().over(inside))


def last_n(tg: DataFrame, n: int) -> DataFrame:
    """(team, day) with the number and half points of the last n games of earlier days.

    A game is among the last n for the days that follow within n games; each one is sent to those days by equality on
    (team, block of n games), so the join makes at most 2n rows per day.
    """
    numbered = _numbered(tg)
    blocks = numbered.select("team", F.floor((F.col("k") - 1) / n).alias("block"), "k", "half_points")
    days = numbered.select("team", "day", "n_before").distinct()
    wanted = days.where("n_before > 0").select("team", "day", "n_before", F.explode(F.array_distinct(F.array(F.floor((F.col("n_before") - n) / n), F.floor((F.col("n_before") - 1) / n)))).alias("block"))
    recent = wanted.join(blocks, ["team", "block"]).where(f"k <= n_before AND k > n_before - {n}")
    form = recent.groupBy("team", "day").agg(F.count("*").alias("n_last"), F.sum("half_points").alias("half_last"))
    return days.join(form, ["team", "day"], "left").select("team", "day", F.coalesce("n_last", F.lit(0)).alias("n_last"), F.coalesce("half_last", F.lit(0)).alias("half_last"))


def streaks(tg: DataFrame, chunk: int = 100_000) -> DataFrame:
    """(team, game_id, streak): signed length of the run of equal results that ends with this game; ties are 0.

    A team's history is cut into chunks of so many games, so no task holds a whole history. Runs are counted inside chunks;
    what a chunk's first run continues comes from one summary row per chunk.
    """
    numbered = _numbered(tg).select("team", "game_id", "k", (F.col("half_points") - 1).cast("long").alias("sign"), F.floor((F.col("k") - 1) / chunk).alias("chunk"))
    inside = Window.partitionBy("team", "chunk").orderBy("k")
    marked = numbered.withColumn("new", F.coalesce((F.lag("sign").over(inside) != F.col("sign")).cast("long"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = runs.withColumn("place", F.row_number().over(Window.partitionBy("team", "chunk", "run").orderBy("k")))
    ends = placed.groupBy("team", "chunk").agg(
        F.min_by("sign", "k").alias("first_sign"), F.max_by("sign", "k").alias("last_sign"), F.max_by("place", "k").alias("tail"), (F.max("run") == 1).alias("whole")
    )
    by_chunk = Window.partitionBy("team").orderBy("chunk")
    linked = ends.withColumn("linked", (F.lag("last_sign").over(by_chunk) == F.col("first_sign")).eqNullSafe(F.lit(True)))
    islands = linked.withColumn("island", F.sum((~(F.col("whole") & F.col("linked"))).cast("long")).over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)))
    totals = islands.withColumn("total", F.sum("tail").over(Window.partitionBy("team", "island").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)))
    carried = totals.select("team", "chunk", F.when(F.col("linked"), F.lag("total").over(by_chunk)).otherwise(0).alias("carry"))
    length = F.col("place") + F.when(F.col("run") == 1, F.col("carry")).otherwise(0)
    return placed.join(carried, ["team", "chunk"]).select("team", "game_id", (F.col("sign") * length).cast("long").alias("streak"))
