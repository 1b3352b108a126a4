"""The sweep by pairing (rows of several games with the same signals) against the same fits over every game."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slate.operators import catalogue, models, score, trees, walk

SCHEMA = "game_id long, day date, league long, half long, least_n long, x array<double>"
BOOSTED = trees.Model("boosting", 4, 1, 2, 0.3, 1.0, 2.0)
FOREST = trees.Model("forest", 1, 6, 3, 1 / 6, 0.0, 5.0, 0.7, False)


def frames(spark, n=900):
    """Games, some five of which have the same day and signals, and the same as pairings."""
    rng, out = random.Random(3), []
    for i in range(n):
        day = i * 40 // n
        side = rng.randrange(5)
        x = [float(side), float((day * 7 + side) % 11)]
        out.append((i, datetime.date(2024, 1, 1) + datetime.timedelta(day), 0, 1 if rng.random() < 0.1 else 2 * (rng.random() < (0.8 if side > 2 else 0.3)), 4, x))
    games = spark.createDataFrame(out, SCHEMA)
    paired = games.groupBy("day", "league", "least_n", "x").agg(F.min("game_id").alias("game_id"), F.count("*").alias("n"), F.avg("half").alias("half"), F.count_if(F.col("half") == 1).alias("ties"))
    return games, paired.join(trees.drawn(games, ["day", "x"], FOREST.trees), "game_id")


def test_trees_of_pairings_are_those_of_their_games(spark):
    games, paired = frames(spark)
    by_key = lambda wide: {(r.model, r.day, tuple(r.x)): r.p for r in trees.chances(wide, [BOOSTED, FOREST]).join(wide.select("game_id", "x"), "game_id").collect()}
    whole, summed = by_key(games), by_key(paired)
    assert paired.count() < games.count() / 3
    assert whole.keys() == summed.keys() and len(whole) > 200
    assert summed == pytest.approx(whole, abs=1e-9)
    assert len({round(p, 6) for p in whole.values()}) > 10


def test_forest_over_pairings_needs_the_drawn_weights(spark):
    with pytest.raises(ValueError, match="drawn"):
        trees.chances(frames(spark)[1].drop("drawn"), [FOREST])


def test_scores_of_pairings_are_those_of_their_games(spark):
    rows = spark.createDataFrame([(p, h) for p, halves in ((0.7, (2, 2, 1, 0)), (0.5, (0, 1, 2)), (0.2, (0, 0, 2)), (1.0, (2, 0))) for h in halves], "p double, half long").withColumn("part", F.lit("a"))
    counted = rows.groupBy("part", "p").agg(F.array(*[F.count_if(F.col("half") == h) for h in range(3)]).alias("outcomes"))
    one = score.prediction_scores(rows, F.col("p"), F.col("half"), ["part"]).first()
    assert tuple(score.counted_scores(counted, F.col("p"), F.col("outcomes"), ["part"]).first()) == pytest.approx(tuple(one))


@pytest.mark.parametrize("kind", [k for k, bank in models.BANKS.items() if not bank.ordered])
def test_sums_of_a_pairing_are_learnt_as_its_games(kind):
    """A row for each pair of sides, however many scores its games end in."""
    rng = np.random.default_rng(4)
    options = [c.options for c in catalogue.candidates() if c.kind == kind]
    whole, summed = (models.League([models.BANKS[kind](options)]) for _ in range(2))
    none = [np.full(12, np.nan)] * 4
    for day in range(4):
        pairs = np.array([(h, a) for h in range(4) for a in range(4) if h != a])
        at = np.concatenate((np.arange(12), rng.integers(0, 12, 188)))
        hg, ag = rng.integers(0, 6, 200).astype(float), rng.integers(0, 5, 200).astype(float)
        sums = np.array([np.bincount(at, models.measured(m, hg, ag)) for m in summed.banks[0].measures])
        values, first, _ = whole.pairings([np.full(200, day), *pairs[at].T, hg, ag])
        order = at[first]
        found = summed.summed(day, *pairs.T, none, np.bincount(at), sums)
        assert found[order] == pytest.approx(values, abs=1e-6)


@pytest.mark.parametrize("margins", ["none", "log", "538"])
def test_elo_in_plain_numbers_is_elo(margins):
    rng = np.random.default_rng(2)
    home = rng.integers(0, 6, 400)
    away, hg, ag = (home + rng.integers(1, 6, 400)) % 6, rng.integers(0, 6, 400).astype(float), rng.integers(0, 5, 400).astype(float)
    options = [{"k": 48, "edge": 35, "margins": margins}, {"k": 8, "edge": 0, "margins": "log"}]
    bank = models.Elo(options)
    bank.grow(np.full(6, np.nan), np.full(6, np.nan))
    bank.learn(home, away, hg, ag, 0)
    for i, o in enumerate(options):
        points = [0.0] * 6
        for h, a, margin in zip(home, away, hg - ag, strict=True):
            change = o["k"] * float(models.elo_change(points[h] + o["edge"] - points[a], margin, o["margins"]))
            points[h] += change
            points[a] -= change
        assert bank.points[i] == pytest.approx(points, abs=1e-8)


def test_form_of_a_day_of_many_games_is_that_of_its_games(spark):
    rng = random.Random(5)
    rows = [(0, datetime.date(2024, 1, 1 + i // 30), i, rng.choice((0, 1, 2, 2)) if i % 30 < 20 else 2, rng.randrange(7), rng.randrange(7)) for i in range(120)]
    found = {r.day: r.form for r in catalogue.team_form(spark.createDataFrame(rows, "team long, day date, game_id long, half_points long, gf long, ga long")).collect()}
    for day, form in found.items():
        past = [r for r in rows if r[1] < day]
        want, streak = [], 0
        values = ([r[3] / 2 for r in past], [r[4] - r[5] for r in past], [max(-5, min(5, r[4] - r[5])) for r in past])
        for own, none in zip(values, (0.5, 0.0, 0.0), strict=True):
            for fade in catalogue.FADES:
                weights = 0.5 ** (np.arange(len(own))[::-1] / fade)
                want.append(float(weights @ own / weights.sum()) if own else none)
        for own, none in ((values[0], 0.5), (values[2], 0.0)):
            want += [float(np.mean(own[-n:])) if own else none for n in catalogue.LASTS]
        for h in values[0]:
            sign = int(np.sign(h - 0.5))
            streak = (streak + sign if streak * sign > 0 else sign) if sign else 0
        assert form == pytest.approx([*want, streak, values[0][-1] - 0.5 if past else 0.0])


def test_early_fits_settle_where_a_signal_grows_far():
    """Of early games, counts so far lie close together and far from their mean over all games."""
    rng = np.random.default_rng(6)
    n = 400
    signal, counts = rng.normal(size=n), rng.integers(20, 26, n).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(signal + 0.5 * (counts - 22.5))))).astype(float)
    centre, scale = np.array([0.0, 9000.0]), np.array([1.0, 5000.0])
    plan = walk._Plan([walk.Entry((0, 1), 1.0)], [], [0])
    none = walk._Start(np.zeros((1, 3)), np.zeros((1, 3)), np.zeros((1, 3, 3)), np.zeros((1, 5)))
    days = walk._Days(plan, plan.bundles[0], none, centre, scale, 10_000)
    x = np.column_stack((signal, counts))
    design = walk._design((x - centre) / scale, plan.features(plan.bundles[0]))
    days.learn(design, y, np.ones((1, n)))
    _, p = days.chances(design, np.zeros(n, int), 30, 150)
    z = np.column_stack((np.ones(n), (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)))
    theta = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-z @ theta))
        pull = np.array([0.0, 1.0, 1.0])
        theta -= np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag(pull), z.T @ (q - y) + pull * theta)
    want = 1 / (1 + np.exp(-z @ theta))
    assert p[0] == pytest.approx(want, abs=2e-3)
