"""Worked examples: classes, clocks, duplicates, overlaps, recurrences, as-of windows, ratings."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from slate.functions import text, times
from slate.operators import asof, dedupe, lookup, overlap, ratings, recur, score
from slate.plans import views

TITLES = {
    "Stick & Puck": "stick_puck", "Sticks and Pucks": "stick_puck", "stick n puck": "stick_puck", "Kids Stick and Puck": "stick_puck_kids", "Stick Time U12": "stick_puck_kids",
    "Adult Stick & Puck 18+": "stick_puck_adult", "Family Stick & Puck": "stick_puck_family", "Public Hockey": "public_hockey", "Rat Hockey": "public_hockey", "Coach's Ice": "coach_ice",
    "Open  Ice": "coach_ice", "Freestyle": "freestyle", "Public Skating": "public_skate", "Learn to Skate": "learn_to_skate", "Rink Closed": "closed", "Holiday - Stick & Puck": "stick_puck",
    "Youth Hockey": "private_rental", "éteam rental": "private_rental", "Zephyr": None, "Glacier": None, "": None,
}


def test_title_classes(spark):
    rows = spark.createDataFrame([(t,) for t in TITLES], "title string").select("title", text.title_class(text.normal_title(F.col("title"))).alias("c")).collect()
    assert {r.title: r.c for r in rows} == TITLES


@pytest.mark.parametrize(
    ("written", "minutes"),
    [("3:50P", 950), ("12:00 AM", 0), ("12:30 PM", 750), ("3PM", 900), ("15:50", 950), ("nope", None), ("24:00", None), ("1:75", None), ("13:00 PM", None), ("7", None), ("", None), (None, None)],
)
def test_clock(spark, written, minutes):
    assert spark.createDataFrame([(written,)], "t string").select(times.clock_minutes(F.col("t"))).first()[0] == minutes


def test_offsets_follow_the_zone(spark):
    rows = spark.sql("SELECT timestamp'2026-09-15 18:00:00' a, timestamp'2026-12-15 19:00:00' b, timestamp'2026-09-15 03:30:00' c")
    got = rows.select(times.iso_with_offset(F.col("a")), times.iso_with_offset(F.col("b")), times.local_day(F.col("c"))).first()
    assert tuple(got) == ("2026-09-15T14:00:00-04:00", "2026-12-15T14:00:00-05:00", dt.date(2026, 9, 14))


def test_dates(spark):
    wanted = {"2026-09-15": dt.date(2026, 9, 15), "9/5/2026": dt.date(2026, 9, 5), "09/05/71": dt.date(1971, 9, 5), "9/5/26": dt.date(2026, 9, 5), "Sept 15, 2026": dt.date(2026, 9, 15), "soon": None}
    rows = spark.createDataFrame([(t,) for t in wanted], "t string").select("t", times.date_only(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == wanted


def test_fnv_of_known_strings(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",)], "t string").select(text.fnv1a(F.col("t"))).collect()
    assert [r[0] for r in rows] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


def test_first_wins_and_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, "b", None)], "pos long, k string, s long")
    once = dedupe.keep_first(df, [F.col("k"), F.col("s")], [F.col("pos")])
    assert sorted(r.pos for r in once.collect()) == [1, 3, 4]
    assert sorted(r.pos for r in dedupe.keep_first(once, [F.col("k"), F.col("s")], [F.col("pos")]).collect()) == [1, 3, 4]


def test_upsert_and_insert_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    assert sorted(map(tuple, dedupe.upsert([a, b], ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, dedupe.insert_only(a, b, ["k"], [F.col("v")]).collect())) == [(1, "x"), (2, "y"), (3, "w")]


def test_unique_match_needs_one_candidate(spark):
    rows = spark.createDataFrame([(1, "a elite"), (2, "b"), (3, "c")], "id long, key string")
    theirs = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21)], "key string, v long")
    out = lookup.unique_match(rows, theirs, "key", "v", F.regexp_replace("key", " elite$", "")).collect()
    assert {r.id: r.v for r in out} == {1: 10, 2: None, 3: None}


def _at(h, m=0, day=1):
    return dt.datetime(2024, 1, day, h, m)


def test_greedy_takes_each_class_once(spark):
    schema = "r long, {} long, start_ts timestamp_ntz, end_ts timestamp_ntz"
    slots = spark.createDataFrame([(1, 1, _at(16), _at(16, 50)), (1, 2, _at(16), _at(17)), (1, 3, _at(23), _at(1, 0, 2)), (2, 4, _at(9), _at(10))], schema.format("s"))
    classes = spark.createDataFrame([(1, 7, _at(16, 10), _at(16, 40)), (1, 8, _at(16, 30), _at(17)), (1, 9, _at(0, 30, 2), _at(2, 0, 2)), (2, 10, _at(10), _at(11))], schema.format("c"))
    assert sorted(map(tuple, overlap.greedy(slots, classes, "r", "s", "c").collect())) == [(1, 1, 7), (1, 2, 8), (1, 3, 9)]


def test_greedy_matches_a_plain_loop(spark):
    rows = views.sessions(spark, "/root/testdata/sf0.001").collect()
    a = sorted((r for r in rows if r.ingest_pos % 2 == 0 and not r.all_day), key=lambda r: (r.start_ts, r.ingest_pos))
    b = sorted((r for r in rows if r.ingest_pos % 2), key=lambda r: (r.start_ts, r.ingest_pos))
    taken, wanted = set(), []
    for x in a:
        for y in b:
            if y.rink_id == x.rink_id and y.ingest_pos not in taken and y.start_ts < x.end_ts and y.end_ts > x.start_ts:
                taken.add(y.ingest_pos)
                wanted.append((x.rink_id, x.ingest_pos, y.ingest_pos))
                break
    from slate.plans import feeds

    assert sorted(map(tuple, feeds.overlay_greedy(spark, "/root/testdata/sf0.001").collect())) == sorted(wanted)


def test_rules_count_from_the_start_and_drop_out_of_range(spark):
    rows = [(1, "WEEKLY", 1, _at(9), 60, None, 3), (2, "DAILY", 2, _at(9), 30, _at(9, 0, 6), None), (3, "YEARLY", 1, _at(9, 0, 5), 30, None, None)]
    df = spark.createDataFrame(rows, "event_id long, freq string, step long, start_ts timestamp_ntz, minutes long, until_ts timestamp_ntz, max_count long")
    got = sorted((r.event_id, r.start_ts.day) for r in recur.rules(df, "2024-01-03", "2024-02-01").collect())
    assert got == [(1, 8), (1, 15), (2, 3), (2, 5), (3, 5)]


def test_days_of_the_game_are_not_known(spark):
    rows = [(1, dt.date(2024, 1, 1), 0, 1, 2, 1), (2, dt.date(2024, 1, 1), 0, 2, 0, 1), (3, dt.date(2024, 1, 2), 0, 1, 1, 1)]
    games = spark.createDataFrame(rows, "game_id long, day date, home long, away long, home_goals long, away_goals long")
    known = {(r.team, str(r.day)): (r.n_before, r.half_points_before) for r in asof.before(views.team_games(games)).collect()}
    assert known[0, "2024-01-01"] == (0, 0) and known[0, "2024-01-02"] == (2, 2)


def test_a_later_result_changes_nothing_earlier(spark):
    games = views.games(spark, "/root/testdata/sf0.001")
    last = games.agg(F.max("game_id")).first()[0]
    flipped = games.withColumn("home_goals", F.when(F.col("game_id") == last, F.col("home_goals") + 9).otherwise(F.col("home_goals")))
    day = games.where(F.col("game_id") == last).first().day
    both = [asof.before(views.team_games(g)).where(F.col("day") <= F.lit(day)) for g in (games, flipped)]
    assert both[0].exceptAll(both[1]).count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 7])
def test_streaks_do_not_depend_on_chunks(spark, chunk):
    tg = views.team_games(views.games(spark, "/root/testdata/sf0.001")).cache()
    assert asof.streaks(tg, chunk).exceptAll(asof.streaks(tg)).count() == 0


def test_streaks_by_hand(spark):
    results = [(1, 3), (2, 1), (3, 0), (0, 4), (2, 2), (5, 0), (3, 1)]
    rows = [(k, dt.date(2024, 1, 1 + k), 0, 1, a, b) for k, (a, b) in enumerate(results)]
    tg = views.team_games(spark.createDataFrame(rows, "game_id long, day date, home long, away long, home_goals long, away_goals long"))
    got = {r.game_id: r.streak for r in asof.streaks(tg, 2).where("team = 0").collect()}
    assert got == {0: -1, 1: 1, 2: 2, 3: -1, 4: 0, 5: 1, 6: 2}


def test_places_are_global(spark):
    from slate.operators import order

    rows = order.numbered(spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v")), ["v"]).collect()
    assert all(r.v == r.place for r in rows) and len(rows) == 1000


def _season(margin):
    rows = [(0, i, j, 3 + margin * (j - i) if j > i else 3, 3 if j > i else 3 + margin * (i - j)) for i in range(4) for j in range(4) if i != j]
    return rows


def test_massey_recovers_constant_margins(spark):
    df = spark.createDataFrame([(*r, dt.date(2024, 1, 1), k) for k, r in enumerate(_season(1))], "league long, home long, away long, home_goals long, away_goals long, day date, game_id long")
    fit = {r.team: r.rating for r in ratings.massey(ratings.pair_counts(df, "league"), ridge=1e-6).collect()}
    assert fit[0] - fit[3] == pytest.approx(3, abs=1e-3)
    even = ratings.colley(ratings.pair_counts(df, "league")).agg(F.avg("rating")).first()[0]
    assert even == pytest.approx(0.5)


def test_elo_example_and_kalman(spark):
    df = spark.createDataFrame([(0, k, dt.date(2024, 1, 1 + k), 0, 1, 4, 1) for k in range(20)], "league long, game_id long, day date, home long, away long, home_goals long, away_goals long")
    first = {r.game_id: r for r in ratings.elo(df, "league", k=20, edge=0, margins="none").collect()}
    assert (first[1].home_elo, first[1].away_elo) == (1510, 1490)
    fit = {r.team: r.rating for r in ratings.kalman(df, "league").collect()}
    assert fit[0] - fit[1] > 1


def test_poisson_outcome_sums_to_one():
    assert sum(ratings.outcome(2.3, 1.7)) == pytest.approx(1, abs=1e-9)


def test_logistic_recovers_a_slope():
    x = np.linspace(-3, 3, 200)[:, None]
    fit = ratings.logistic(x, 1 / (1 + np.exp(-(0.3 + 0.8 * x[:, 0]))), np.ones(200), ridge=1e-6)
    assert fit == pytest.approx([0.3, 0.8], abs=1e-3)


def test_ties_get_half_credit(spark):
    df = spark.createDataFrame([(0.8, 2), (0.5, 0), (0.3, 1), (None, 2)], "p double, half long")
    got = score.prediction_scores(df, F.col("p"), F.col("half"), []).first()
    assert got.n == 3 and got.accuracy == pytest.approx((1 + 0.5 + 0.5) / 3)


def test_only_the_entry_knows_the_training_data_modules():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for path in (root / "slate").rglob("*.py"):
        if "llm" not in path.parts:
            assert "slate.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
