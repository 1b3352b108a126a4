"""Queries over the catalogue of signals: every signal of every game, every entry's scores, and the entry that is chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.operators import catalogue, score, studies, trees, walk
from slate.plans import views
from slate.session import cut


def _priors(spark: SparkSession) -> DataFrame:
    """Two made-up pre-season ratings, each of a part of the teams, centred by tier."""
    teams = spark.range(views.TEAMS).select(F.col("id").alias("team"), (F.col("id") % 4).alias("tier"))
    last = studies.centred_priors(teams.where("team % 3 <> 0").withColumn("rating", F.col("team") * 7 % 11), teams, "team", "tier")
    outside = studies.centred_priors(teams.where("team % 2 = 0").withColumn("rating", F.col("team") * 5 % 7), teams, "team", "tier")
    known = last.select("team", F.when(F.col("team") % 3 != 0, F.col("prior")).alias("last"))
    return known.join(outside.select("team", F.when(F.col("team") % 2 == 0, F.col("prior")).alias("outside")), "team")


def _known(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The games that were played, and what is known before each pairing of theirs."""
    games = views.games(spark, sf)
    rows = catalogue.played(games, "division", _priors(spark))
    return rows, cut(catalogue.known_games(catalogue.pairings(rows), views.team_games(games)))


def _wide(spark: SparkSession, sf: str, listed: list[catalogue.Candidate]) -> DataFrame:
    """Signals by pairing: games of one day and pair of sides share them."""
    rows, known = _known(spark, sf)
    return cut(catalogue.wide_signals(known, listed, rows))


def metric_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Games, mean and spread of every candidate's signal by division."""
    listed = catalogue.candidates()
    long = _wide(spark, sf, listed).select("league", "n", F.posexplode("x").alias("metric", "value"))
    names = F.array(*[F.lit(c.name) for c in listed])
    n, total, squares = F.sum("n"), F.sum(F.col("n") * F.col("value")), F.sum(F.col("n") * F.col("value") ** 2)
    spread = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), squares - total * total / n) / (n - 1)))
    rows = long.groupBy("metric", "league").agg(n.alias("n"), (total / n).alias("mean"), spread.alias("spread"))
    return rows.select(F.element_at(names, (F.col("metric") + 1).cast("int")).alias("name"), "league", "n", score.rounded(F.col("mean")).alias("mean"), score.rounded(F.col("spread")).alias("spread"))


def metric_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Walk-forward scores of all candidates, baselines, own chances and combos by part; ``chosen`` marks the one that the selection takes."""
    sums = cut(catalogue.evaluated(_wide(spark, sf, catalogue.candidates()), catalogue.candidates(), catalogue.combos()))
    scores = catalogue.table_of(sums)
    one = catalogue.selected(scores).select("name", "kind", F.lit(True).alias("chosen"))
    return scores.join(F.broadcast(one), ["name", "kind"], "left").select(
        "name", "kind", "family", "complexity", "part", "n", *[score.rounded(F.col(c)).alias(c) for c in ("accuracy", "log_loss", "brier")], F.coalesce("chosen", F.lit(False)).alias("chosen")
    )


def _part(*families: str, combos: bool = False):  # noqa: ANN202
    """A query over some families of the catalogue alone, or its combinations; their scores are those that the whole catalogue gives."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        joined = catalogue.combos() if combos else []
        needed = {f for c in joined for f in c.features}
        listed = [c for c in catalogue.candidates() if c.family in families or c.name in needed]
        sums = catalogue.evaluated(_wide(spark, sf, listed), listed, joined)
        return catalogue.table_of(sums, "league").select("name", "kind", "family", "complexity", "league", "part", "n", *[score.rounded(F.col(c)).alias(c) for c in ("accuracy", "log_loss", "brier")])

    return run


#: Signals of the sweep beside the context: pre-season gaps and whether both sides have one, the earlier games of the side with fewer, the division.
# The curated signals.
CURATED = (
    "massey cap 8 ridge 1", "massey prior blend share 0.25 ridge 1 cap 8", "poisson ridge 3", "elo k 48 edge 35 margins log", "bradley-terry ridge 0.3 soft 4", "colley",
    "record points", "record margin cap 99", "record scored", "record conceded", "last points 5", "last capped 5", "streak", "last result", "residual last 5",
    "meetings margin", "meetings result", "rest", "rpi opponents", "kalman drift 0.002 noise 9 start 3 cap 8",
)
# End of the fixed values.
SWEEP = (
    trees.Model("boosting depth 2", 12, 1, 2, 0.2, 5.0, 5.0),
    trees.Model("forest depth 4", 1, 12, 4, 1 / 12, 0.0, 20.0, 0.3, False),
)
RIDGES = {"logistic ridge 10": 10.0, "logistic ridge 100": 100.0}


def model_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by part of boosted trees, a forest and logistic fits over the curated signals and their context, each from games of earlier days only. All of it works on pairings."""
    rows, known = _known(spark, sf)
    listed = [c for c in catalogue.candidates() if c.name in CURATED]
    gap = lambda p: F.coalesce(f"home_{p}", F.lit(0.0)) - F.coalesce(f"away_{p}", F.lit(0.0))
    both = lambda p: (F.col(f"home_{p}").isNotNull() & F.col(f"away_{p}").isNotNull()).cast("double")
    context = known.select("game_id", F.array(gap("last"), both("last"), gap("outside"), both("outside"), F.col("least_n").cast("double"), F.col("league").cast("double")).alias("context"))
    drawn = trees.drawn(rows, list(catalogue.SAME), max(m.trees for m in SWEEP if not m.boosted))
    joined = catalogue.wide_signals(known, listed, rows).join(context, "game_id").join(drawn, "game_id")
    wide = cut(joined.withColumn("x", F.concat("x", "context")).drop("context"))
    grown = trees.chances(wide, list(SWEEP)).select("model", "game_id", "p")
    places = tuple(range(len(listed) + 6))
    entries = [walk.Entry(places, ridge) for ridge in RIDGES.values()]
    names = F.array(*[F.lit(n) for n in RIDGES])
    fits = walk.chances(wide, entries).select(F.element_at(names, (F.col("entry") + 1).cast("int")).alias("model"), "game_id", "p")
    day = catalogue.split_day(wide).first()[0]
    part = F.when(F.col("least_n") < 5, F.array(F.lit("early"))).when(F.col("day") <= F.lit(day), F.array(F.lit("train"), F.lit("eligible"))).otherwise(F.array(F.lit("holdout"), F.lit("eligible")))
    judged = grown.unionByName(fits).join(wide.select("game_id", walk.outcomes_of(wide).alias("outcomes"), F.explode(part).alias("part")), "game_id")
    scores = score.counted_scores(judged, F.col("p"), F.col("outcomes"), ["model", "part"])
    return scores.select("model", "part", "n", *[score.rounded(F.col(c)).alias(c) for c in ("accuracy", "log_loss", "brier")])


QUERIES = {
    "metric_signals": metric_signals, "model_sweep": model_sweep, "metric_catalogue": metric_catalogue,
    "metric_plain": _part("baseline", "home", "record", "recency", "meetings", "schedule"), "metric_massey": _part("massey", "massey with priors", "colley", "momentum"),
    "metric_likelihood": _part("bradley-terry", "poisson"), "metric_in_order": _part("elo", "kalman", "kalman with priors"), "metric_combos": _part(combos=True),
}
SQL: dict[str, str] = {}
