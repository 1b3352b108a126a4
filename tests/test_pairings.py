"""Signals and scores by pairing (day and pair of sides) against those of every game."""

import datetime
import random

import pytest

from slate.operators import catalogue, models
from slate.plans import views

LISTED = catalogue.candidates()
SCHEMA = "game_id long, day date, home long, away long, home_goals long, away_goals long, division long"


def made(n=900, seed=4):
    """Some fifteen games a day of few sides, so that pairings have many games."""
    rng, out = random.Random(seed), []
    for i in range(n):
        home, away = rng.sample(range(4), 2)
        out.append((i, datetime.date(2024, 1, 1) + datetime.timedelta(i * 60 // n), home, away, rng.randrange(6), rng.randrange(5), home % 2))
    return out


def frames(spark):
    games = spark.createDataFrame(made(), SCHEMA)
    priors = spark.createDataFrame([(0, 1.5, None), (1, None, -0.5), (2, -1.0, 0.25), (3, None, None)], "team long, last double, outside double")
    return catalogue.played(games, "division", priors).cache(), views.team_games(games)


def test_pairings_have_the_signals_and_scores_of_their_games(spark):
    rows, tg = frames(spark)
    wide = catalogue.wide_signals(catalogue.known_games(rows, tg), LISTED).cache()
    few = catalogue.wide_signals(catalogue.known_games(catalogue.pairings(rows), tg), LISTED, rows).cache()
    one = {(r.league, r.day, r.home, r.away): r.game_id for r in catalogue.pairings(rows).collect()}
    short = {r.game_id: r for r in few.collect()}
    first = {r.game_id: one[r.league, r.day, r.home, r.away] for r in rows.collect()}
    assert len(short) == len(one) < len(first) / 1.5
    for r in wide.collect():
        assert short[first[r.game_id]].x == pytest.approx(r.x, abs=1e-7)
        assert short[first[r.game_id]].least_n == r.least_n
    assert sum(r.n for r in short.values()) == len(first)
    assert catalogue.split_day(few).first() == catalogue.split_day(wide).first()
    names = ("baseline shares", "elo k 8 edge 0 margins none", "streak", catalogue.BASE, "rest")
    places = [i for i, c in enumerate(LISTED) if c.name in names]
    keep = lambda df: df.withColumn("x", catalogue.F.array(*[catalogue.F.col("x")[i] for i in places]))
    listed, joined = [LISTED[i] for i in places], [c for c in catalogue.combos() if c.name in (f"{catalogue.BASE} + rest", f"{catalogue.BASE} by league")]
    by = lambda df: {(r.name, r.kind, r.league, r.part): r for r in catalogue.evaluated(keep(df), listed, joined).collect()}
    whole, summed = by(wide), by(few)
    assert whole.keys() == summed.keys() and len(whole) > 20
    for key, r in whole.items():
        assert summed[key].n == r.n
        assert (summed[key].hits, summed[key].loss, summed[key].squares) == pytest.approx((r.hits, r.loss, r.squares), abs=1e-2 if r.kind != "raw" else 1e-7)


def test_a_pairing_gives_one_row_whatever_its_games(spark):
    rows, _ = frames(spark)
    assert catalogue.fitted_signals(rows, [c for c in LISTED if c.kind in models.BANKS], True).count() == catalogue.pairings(rows).count()
