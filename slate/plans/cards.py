"""Scout cards, residual form as of each day, and titles in the order of a collation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slate.operators import models, score
from slate.plans import views
from slate.plans.views import GAMES, TEAM_GAMES
from slate.session import table

#: The day that cards are asked for: games from it on are to come.
TODAY = "1999-06-01"
COMING, LOOKED_AT, SHOWN = 5, 12, 3


def scout_cards(spark: SparkSession, sf: str) -> DataFrame:
    """For each of a team's next games: the games that the opponent has won, lost and tied, its next games before ours, and the earliest meeting of the two.

    One row for each game on a card, so no list grows within a row. Warm-ups are the first three of the opponent's next twelve games that come before ours.
    """
    tg = views.team_games(views.games(spark, sf))
    to_come, played = tg.where(F.col("day") >= F.lit(TODAY).cast("date")), tg.where(F.col("day") < F.lit(TODAY).cast("date"))
    turn = F.row_number().over(Window.partitionBy("team").orderBy("day", "game_id"))
    following = to_come.withColumn("turn", turn).where(F.col("turn") <= LOOKED_AT)
    cards = following.where(F.col("turn") <= COMING).select("team", F.col("game_id").alias("card"), "opp", F.col("day").alias("card_day"))
    by_card = Window.partitionBy("team", "card").orderBy("day", "game_id")
    other = played.select(F.col("team").alias("opp"), F.col("opp").alias("against"), "game_id", "day", "half_points")
    section = F.element_at(F.array(F.lit("lost_to"), F.lit("tied"), F.lit("beaten")), F.col("half_points").cast("int") + 1)
    by_section = Window.partitionBy("team", "card", "section").orderBy("day", "game_id")
    past = cards.join(other, "opp").withColumn("section", section).withColumn("place", F.row_number().over(by_section))
    coming = following.select(F.col("team").alias("opp"), F.col("opp").alias("against"), "game_id", "day")
    warm = cards.join(coming, "opp").where("day < card_day").withColumn("place", F.row_number().over(by_card)).where(F.col("place") <= SHOWN).withColumn("section", F.lit("warm_up"))
    met = cards.join(played.select("team", "opp", "game_id", "day"), ["team", "opp"]).withColumn("place", F.row_number().over(by_card)).where("place = 1")
    met = met.withColumn("section", F.lit("prior")).withColumn("against", F.col("team"))
    columns = ["team", "card", "opp", "section", F.col("place").cast("long").alias("place"), "game_id", "against"]
    return past.select(*columns).unionByName(warm.select(*columns)).unionByName(met.select(*columns))


SCOUT_CARDS = f"""WITH {GAMES}, {TEAM_GAMES},
following AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, game_id) AS turn FROM team_games WHERE day >= DATE '{TODAY}') WHERE turn <= {LOOKED_AT}),
cards AS (SELECT team, game_id AS card, opp, day AS card_day FROM following WHERE turn <= {COMING}),
past AS (SELECT c.team, card, c.opp, CASE g.half_points WHEN 2 THEN 'beaten' WHEN 0 THEN 'lost_to' ELSE 'tied' END AS section, g.game_id, g.opp AS against, g.day
  FROM cards c JOIN team_games g ON g.team = c.opp WHERE g.day < DATE '{TODAY}'),
warm AS (SELECT c.team, card, c.opp, f.game_id, f.opp AS against, row_number() OVER (PARTITION BY c.team, card ORDER BY f.day, f.game_id) AS place FROM cards c JOIN following f ON f.team = c.opp AND f.day < c.card_day),
met AS (SELECT c.team, card, c.opp, g.game_id, row_number() OVER (PARTITION BY c.team, card ORDER BY g.day, g.game_id) AS place FROM cards c JOIN team_games g ON g.team = c.team AND g.opp = c.opp AND g.day < DATE '{TODAY}')
SELECT team, card, opp, section, row_number() OVER (PARTITION BY team, card, section ORDER BY day, game_id) AS place, game_id, against FROM past
UNION ALL SELECT team, card, opp, 'warm_up', place, game_id, against FROM warm WHERE place <= {SHOWN}
UNION ALL SELECT team, card, opp, 'prior', place, game_id, team FROM met WHERE place = 1"""

RESIDUALS = ({"cap": 8, "ridge": 1, "last": 3}, {"cap": 8, "ridge": 1, "last": 5}, {"cap": 8, "ridge": 1, "last": 8})


def residual_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """For every game how far both sides' last 3, 5 and 8 margins were above a fit of games of earlier days, home less away."""

    def each(league: models.League, columns: models.Columns) -> list:
        _, day, home, away, hg, ag, game = columns
        values = league.day([day, home, away, hg, ag])
        return [game, *[pa.array(values[:, i]) for i in range(len(RESIDUALS))]]

    schema = "game_id long, " + ", ".join(f"last_{o['last']} double" for o in RESIDUALS)
    found = models.through_days(models.in_order(views.games(spark, sf), "division"), lambda: [models.Residual(list(RESIDUALS))], schema, each)
    return found.select("game_id", *[score.rounded(F.col(f"last_{o['last']}")).alias(f"last_{o['last']}") for o in RESIDUALS])


def collated_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Places of part names, some with accents or capitals, in the order of a language's readers and not of code points; equal keys share a place."""
    key = F.col("p_partkey") % 4
    name = F.when(key == 1, F.translate("p_name", "aeo", "áêö")).when(key == 2, F.upper("p_name")).when(key == 3, F.initcap("p_name")).otherwise(F.col("p_name"))
    titles = table(spark, sf, "part").select("p_partkey", "p_size", name.alias("title"))
    by_title = Window.partitionBy("p_size").orderBy(F.collate("title", "UNICODE"))
    return titles.select("p_partkey", "p_size", "title", F.rank().over(by_title).cast("long").alias("place"))


COLLATED_TITLES = """WITH t AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 1 THEN translate(p_name, 'aeo', 'áêö') WHEN 2 THEN upper(p_name)
  WHEN 3 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE p_name END AS title FROM part)
SELECT p_partkey, p_size, title, rank() OVER (PARTITION BY p_size ORDER BY icu_sort_key(title, 'en')) AS place FROM t"""

QUERIES = {"scout_cards": scout_cards, "residual_by_day": residual_by_day, "collated_titles": collated_titles}
SQL = {"scout_cards": SCOUT_CARDS, "collated_titles": COLLATED_TITLES}
