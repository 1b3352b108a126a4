"""A catalogue of signals of coming games, each known from games of earlier days only, and their walk-forward scores.

A candidate is a name, its family, its complexity and how it is computed. A game is one row with an array of all its signals, unrounded, and
walk-forward fits (``walk``) see them as they are. Season records and meetings are running sums over days; form and fading sums are read in one ordered pass per
team; fitted ratings are refitted for every day from sums per pair of teams. Ordered passes stream: rows are partitioned and
sorted by Spark, and a task holds one day of one league and the state (teams squared numbers), never a history.

A game without a day, sides or goals is not played and is left out. An empty table gives an empty result.
"""

from __future__ import annotations

import datetime
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.operators import asof, models, score, walk
from slate.operators.models import whole_days
from slate.session import settled

class Candidate(NamedTuple):
    name: str
    family: str
    complexity: int
    kind: str
    options: dict
    raw: bool = False


def _team_names() -> list[str]:
    shares = [f"fade points {x}" for x in FADES] + [f"fade margin {x}" for x in FADES] + [f"fade capped {x}" for x in FADES]
    return [*shares, *[f"last points {n}" for n in LASTS], *[f"last capped {n}" for n in LASTS], "streak", "last result"]


FADES, LASTS = (3, 6, 12), (3, 5, 8)


def candidates() -> list[Candidate]:
    """All candidates and the three baselines, in a fixed order; a candidate's number is its place."""
    out = [
        Candidate("baseline home rate", "baseline", 0, "zero", {}),
        Candidate("baseline even", "baseline", 0, "zero", {}, True),
        Candidate("baseline shares", "baseline", 1, "shares", {}, True),
        Candidate("home constant", "home", 1, "one", {}),
    ]
    add = lambda *args: out.append(Candidate(*args))
    for what in ("points", "wins", "scored", "conceded"):
        add(f"record {what}", "record", 1, "record", {"what": what})
    for cap in CAPS:
        add(f"record margin cap {cap}", "record", 2, "record", {"what": f"margin {cap}"})
    for place, name in enumerate(_team_names()):
        add(name, "momentum" if place >= 15 else "recency", 1 if place >= 15 else 3 if "capped" in name else 2, "form", {"place": place})
    add("meetings result", "meetings", 1, "meetings", {"what": "result"})
    add("meetings margin", "meetings", 1, "meetings", {"what": "margin"})
    add("rest", "rest", 1, "record", {"what": "rest"})
    # Options of the rating methods, which decide what is compared with what.
    pythagoras = [1.0, 1.5, 2.0, 2.5, 3.0]
    rpi = {"rpi": (0.25, 0.5, 0.25), "rpi mostly own": (0.5, 0.35, 0.15), "rpi opponents": (0.0, 1.0, 0.0)}
    sos_caps = [3, 5, np.inf]
    massey: list[dict] = [{"cap": c, "ridge": r} for c in (2, 3, 5, 8, np.inf) for r in (0.3, 1, 3, 10)]
    massey += [{"target": "result", "cap": 1, "ridge": r} for r in (1, 3, 10)]
    massey += [{"cap": 5, "ridge": r, "half_life": life} for life in (30, 60) for r in (1, 3)]
    massey += [{"cap": c, "ridge": r} for c in (6, 10, 12, 15) for r in (0.3, 1)] + [{"cap": 8, "ridge": 0.1}]
    massey += [{"target": "sqrt", "cap": c, "ridge": r} for c in (8, np.inf) for r in (0.3, 1)]
    massey += [{"cap": c, "ridge": 1, "half_life": life} for life in (90, 120) for c in (8, np.inf)]
    bradley_terry = [{"ridge": r} for r in (0.1, 0.3, 1, 3)] + [{"ridge": r, "soft": s} for s in (2, 4) for r in (0.3, 1)] + [{"ridge": 0.3, "soft": s} for s in (6, 8)]
    poisson = [{"ridge": r} for r in (1, 3, 10)] + [{"ridge": 3, "half_life": 90}]
    elo = [{"k": k, "edge": e, "margins": m} for k in (8, 16, 24, 32, 48, 64) for e in (0, 35) for m in ("none", "log", "538")]
    kalman = [{"drift": q, "noise": r, "start": v, "cap": 8} for q in (0, 0.002, 0.005, 0.01, 0.02) for r in (9, 14) for v in (1, 3)]
    massey_priors: list[dict] = [{"prior": m, "share": s, "ridge": r, "cap": 8} for m in ("last", "outside", "blend") for s in (0.25, 0.5, 0.75, 1) for r in (1, 2, 4)]
    massey_priors += [{"prior": "blend", "share": 1, "ridge": r, "scale": s, "cap": 8} for s in (0.5, 0.25) for r in (2, 4)]
    kalman_priors = [{"prior": "blend", "share": s, "prior_variance": v, "drift": q, "noise": 9, "start": 3, "cap": 8} for s in (0.5, 1) for v in (0.5, 1.5) for q in (0, 0.005, 0.01)]
    # End of the fixed values.
    for power in pythagoras:
        add(f"pythagoras {power}", "record", 2, "record", {"what": "power", "power": power})
    for name, weights in rpi.items():
        add(name, "schedule", 2, "schedule", {"weights": weights})
    for cap in sos_caps:
        add(f"sos margin cap {cap}", "schedule", 2, "schedule", {"cap": cap})
    add("colley", "colley", 2, "colley", {})
    for n in LASTS:
        add(f"residual last {n}", "momentum", 4, "residual", {"cap": 8, "ridge": 1, "last": n})
    families = (("massey", "massey", 3, massey), ("bradley_terry", "bradley-terry", 3, bradley_terry), ("poisson", "poisson", 4, poisson), ("elo", "elo", 3, elo), ("kalman", "kalman", 4, kalman),
                ("massey", "massey with priors", 5, massey_priors), ("kalman", "kalman with priors", 6, kalman_priors))
    for kind, family, complexity, options in families:
        for o in options:
            add(f"{family.split()[0]} {_spelt(o)}", family, complexity + bool(o.get("soft")) + bool(o.get("half_life")), kind, o, kind in ("bradley_terry", "poisson", "elo"))
    return out


def _spelt(options: dict) -> str:
    return " ".join(f"{k} {v}" for k, v in options.items())


CAPS = (1, 2, 3, 5, 8, 99)
PASSED = ("game_id", "day", "league", "half", "least_n")


def played(games: DataFrame, group: str, priors: DataFrame) -> DataFrame:
    """Games that count, with whole days, their outcome, the earlier games of the side with fewer, and both sides' ``priors`` (team, last, outside)."""
    whole = games.dropna(subset=["day", "home", "away", "home_goals", "away_goals"])
    margin = F.col("home_goals") - F.col("away_goals")
    rows = whole.select("game_id", "day", F.col(group).alias("league"), "home", "away", "home_goals", "away_goals", (F.signum(margin) + 1).cast("long").alias("half"))
    for side in ("home", "away"):
        known = priors.select(F.col("team").alias(side), F.col("last").cast("double").alias(f"{side}_last"), F.col("outside").cast("double").alias(f"{side}_outside"))
        rows = rows.join(known, side, "left")
    return rows


SAME = ("day", "league", "home", "away")
PRIORS = ("home_last", "home_outside", "away_last", "away_outside")


def pairings(rows: DataFrame) -> DataFrame:
    """``played`` with one row for each day, league and pair of sides: its first game, n games, their mean outcome (half) and ties.

    Signals are what is known before the day, so games of one pairing have the same ones. Pairings are bounded by days and teams squared, games are not.
    """
    return rows.groupBy(*SAME).agg(F.min("game_id").alias("game_id"), *[F.min(p).alias(p) for p in PRIORS], F.count("*").alias("n"), F.avg("half").alias("half"), F.count_if(F.col("half") == 1).alias("ties"))


def _measured(measure: models.Measure) -> Column:
    """``models.measured`` of a game, as a column."""
    kind, number = measure
    if kind in ("home", "away"):
        return F.col(f"{kind}_goals")
    margin = F.col("home_goals") - F.col("away_goals")
    if kind == "soft":
        return 0.5 + 0.5 * (F.tanh(margin / F.lit(number)) if number else F.signum(margin))
    capped = F.greatest(F.lit(-float(number)), F.least(F.lit(float(number)), margin))
    return {"margin": capped, "sqrt": F.signum(capped) * F.sqrt(F.abs(capped)), "result": F.signum(margin)}[kind]


def fitted_signals(rows: DataFrame, chosen: list[Candidate], by_pairing: bool = False) -> DataFrame:
    """(game_id, fitted): an array with the signals of all rating candidates, in their order. ``rows``: ``played``.

    Candidates of one method share a pass over a league, their sums and their solves; what a pass gives is one row a game, or with ``by_pairing`` one for the
    first game of each pairing. Methods that do not need the order of games then get a pairing as one row, with the sums of what they measure.
    """
    kinds = list(dict.fromkeys(c.kind for c in chosen))
    bundles = [[i for i, c in enumerate(chosen) if c.kind == kind] for kind in kinds]
    numbered = [i for bundle in bundles for i in bundle]
    bank = lambda b: models.BANKS[kinds[b]]([chosen[i].options for i in bundles[b]])
    plain = rows.select(
        "league", F.datediff("day", F.lit("1970-01-01")).alias("day"), "game_id", "home", "away",
        *[F.col(c).cast("double").alias(c) for c in ("home_goals", "away_goals")],
        *[F.coalesce(p, F.lit(float("nan"))).alias(p) for p in PRIORS],
    )
    in_order = [b for b, kind in enumerate(kinds) if models.BANKS[kind].ordered or not by_pairing]
    summed = [b for b in range(len(kinds)) if b not in in_order]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * len(bundles))
    dealt = lambda df, some: df.select(F.explode(F.array(*[F.lit(b) for b in some])).alias("bundle"), *df.columns)
    ordered = lambda df, some: dealt(df, some).repartition(parts, "bundle", "league").sortWithinPartitions("bundle", "league", "day", "game_id")

    def passed(signals_of):  # noqa: ANN001, ANN202
        """A pass over the days of each bundle and league; ``signals_of`` gives games and their signals from a league and the columns of its day."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []
            for bundle, league, *columns in whole_days(batches, 3):
                if at != (bundle[0], league[0]):
                    at = (bundle[0], league[0])
                    own = models.League([bank(int(bundle[0]))])
                game, values = signals_of(own, int(bundle[0]), columns)
                held.append((game, np.full(len(game), bundle[0]), values))
                if sum(len(h[0]) for h in held) > 4096:
                    yield _signals(held)
                    held = []
            if held:
                yield _signals(held)

        return run

    def of_games(own: models.League, bundle: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        day, game, *columns = columns
        values, first, place = own.pairings([day, *columns])
        return (game[first], values) if by_pairing else (game, values[place])

    schema = "game_id long, bundle int, signals array<double>"
    made = [ordered(plain, in_order).mapInArrow(passed(of_games), schema)] if in_order else []
    if summed:
        measures = list(dict.fromkeys(m for b in summed for m in bank(b).measures))
        places = {b: [measures.index(m) for m in bank(b).measures] for b in summed}
        sums = F.array(*[F.sum(_measured(m)).cast("double") for m in measures])
        few = plain.groupBy("league", "day", "home", "away").agg(F.min("game_id").alias("game_id"), *[F.min(p).alias(p) for p in PRIORS], F.count("*").alias("n"), sums.alias("sums"))

        def of_sums(own: models.League, bundle: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            day, game, home, away, *priors, n, told = columns
            return game, own.summed(int(day[0]), home, away, priors, n, np.stack(told)[:, places[bundle]].T)

        slim = few.select("league", "day", "game_id", "home", "away", *PRIORS, "n", "sums")
        made.append(ordered(slim, summed).mapInArrow(passed(of_sums), schema))
    both = made[0] if len(made) == 1 else made[0].unionByName(made[1])
    # as many rows a game as there are methods
    whole = settled(both.groupBy("game_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bundle", "signals"))), lambda x: x["signals"])).alias("signals")))
    back = {number: place for place, number in enumerate(numbered)}
    return whole.select("game_id", F.transform(F.array(*[F.lit(back[i] + 1) for i in range(len(chosen))]), lambda i: F.element_at("signals", i)).alias("fitted"))


def _signals(held: list) -> pa.RecordBatch:
    """Rows of one batch; bundles may differ in how many signals they have."""
    games, bundles = (np.concatenate([h[i] for h in held]) for i in range(2))
    return pa.RecordBatch.from_arrays([pa.array(games, pa.int64()), pa.array(bundles, pa.int32()), pa.array([row for h in held for row in h[2].tolist()], pa.list_(pa.float64()))], names=["game_id", "bundle", "signals"])


def team_form(tg: DataFrame) -> DataFrame:
    """(team, day, form): fading and last-n means, streak and last result before each day, in the order of ``_team_names``; one ordered pass per team."""
    parts = int(tg.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = tg.select("team", F.datediff("day", F.lit("1970-01-01")).alias("day"), "game_id", "half_points", (F.col("gf") - F.col("ga")).alias("margin"))
    ordered = slim.repartition(parts, "team").sortWithinPartitions("team", "day", "game_id")
    faded = 0.5 ** (1 / np.array(FADES, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for team, day, _, half, margin in whole_days(batches, 2):
            if team[0] != at:
                at, sums, past, streak = team[0], np.zeros((len(FADES), 4)), deque(maxlen=max(LASTS)), 0
            mean = sums[:, 1:] / np.maximum(sums[:, :1], 1e-300) if past else np.tile([0.5, 0.0, 0.0], (len(FADES), 1))
            points = [np.mean([p[0] for p in list(past)[-n:]]) if past else 0.5 for n in LASTS]
            capped = [np.mean([p[1] for p in list(past)[-n:]]) if past else 0.0 for n in LASTS]
            held.append((team[0], day[0], [*mean.T.ravel().tolist(), *points, *capped, float(streak), past[-1][0] - 0.5 if past else 0.0]))
            # what is left of each game of the day when the day is over
            left = faded[:, None] ** np.arange(len(half) - 1, -1, -1)
            capped_now = np.clip(margin, -5, 5)
            sums = sums * (faded ** len(half))[:, None] + left @ np.column_stack((np.ones(len(half)), half / 2, margin, capped_now))
            past.extend(zip((half[-max(LASTS) :] / 2).tolist(), capped_now[-max(LASTS) :].tolist(), strict=True))
            signs = np.sign(half - 1)
            last = int(signs[-1])
            other = np.flatnonzero(signs != last)
            run_length = len(signs) - 1 - int(other[-1]) if len(other) else len(signs)
            streak = last * run_length + (streak if last and not len(other) and streak * last > 0 else 0)
            if len(held) >= 4096:
                yield _form(held)
                held = []
        if held:
            yield _form(held)

    return ordered.mapInArrow(run, "team long, day int, form array<double>").withColumn("day", F.date_from_unix_date("day"))


def _form(held: list) -> pa.RecordBatch:
    team, day, form = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(team, pa.int64()), pa.array(day, pa.int32()), pa.array(form, pa.list_(pa.float64()))], names=["team", "day", "form"])


def side_sums(tg: DataFrame) -> DataFrame:
    """(team, day) with sums over earlier days: games, half points, wins, goals, and margins by cap."""
    margin = F.col("gf") - F.col("ga")
    capped = {f"m{c}": F.greatest(F.lit(-c), F.least(F.lit(c), margin)) for c in CAPS}
    measures = {"n": F.lit(1), "half": F.col("half_points"), "wins": (F.col("half_points") == 2).cast("long"), "gf": F.col("gf"), "ga": F.col("ga"), **capped}
    days = tg.groupBy("team", "day").agg(*[F.sum(c).alias(k) for k, c in measures.items()])
    earlier = Window.partitionBy("team").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(k) for k in measures]
    return days.select("team", "day", *sums, F.max("day").over(earlier).alias("last_day"))


def _record(what: str, options: dict, side: str) -> Column:
    c = lambda name: F.col(f"{side}_{name}")
    n = c("n")
    mean = lambda top, none: F.when(n > 0, top / n).otherwise(F.lit(none))
    if what == "points":
        return mean(c("half") / 2, 0.5)
    if what == "wins":
        return mean(c("wins"), 0.5)
    if what == "scored":
        return mean(c("gf"), 0.0)
    if what == "conceded":
        return -mean(c("ga"), 0.0)
    if what == "rest":
        return F.least(F.lit(14), F.coalesce(F.datediff("day", c("last_day")), F.lit(14))).cast("double")
    if what == "power":
        scored, conceded = F.pow(mean(c("gf"), 0.0) + F.lit(0.5), F.lit(options["power"])), F.pow(mean(c("ga"), 0.0) + F.lit(0.5), F.lit(options["power"]))
        return scored / (scored + conceded)
    return mean(c("m" + what.split()[1]), 0.0)


def known_games(rows: DataFrame, tg: DataFrame) -> DataFrame:
    """``played`` with both sides' sums, form and the pair's meetings before the day, and least_n."""
    tg = tg.dropna(subset=["team", "opp", "day", "gf", "ga"])
    sums, form = side_sums(tg), team_form(tg)
    known = sums.join(form, ["team", "day"])
    names = [c for c in known.columns if c not in ("team", "day")]
    wide = asof.per_game(rows, known, {c: F.col(c) for c in names})
    days = tg.groupBy("team", "opp", "day").agg(F.count("*").alias("n"), F.sum("half_points").alias("half"), F.sum(F.greatest(F.lit(-5), F.least(F.lit(5), F.col("gf") - F.col("ga")))).alias("margin"))
    earlier = Window.partitionBy("team", "opp").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    met = days.select(F.col("team").alias("home"), F.col("opp").alias("away"), "day", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"met_{c}") for c in ("n", "half", "margin")])
    return wide.join(met, ["home", "away", "day"], "left").withColumn("least_n", F.least("home_n", "away_n").cast("long"))


def _plain(c: Candidate) -> Column:
    """The signal of a candidate that is a column over ``known_games``."""
    if c.kind == "zero":
        return F.lit(0.0)
    if c.kind == "one":
        return F.lit(1.0)
    if c.kind == "meetings":
        top = F.col("met_half") / 2 - F.col("met_n") / 2 if c.options["what"] == "result" else F.col("met_margin").cast("double")
        return F.when(F.col("met_n") > 0, top / F.col("met_n")).otherwise(0.0)
    if c.kind == "form":
        return F.col("home_form")[c.options["place"]] - F.col("away_form")[c.options["place"]]
    own, other = (_record(c.options.get("what", "points"), c.options, side) for side in ("home", "away"))
    if c.kind == "shares":
        own, other = (own + F.lit(0.5)), (other + F.lit(0.5))
        return F.ln(own / other)
    return own - other


def wide_signals(known: DataFrame, listed: list[Candidate], games: DataFrame | None = None) -> DataFrame:
    """``PASSED`` and x, the array of all candidates' signals in their order, for every game. Game ids are distinct.

    Where ``known`` has ``pairings`` instead of games, ``games`` are those that were ``played``; n and ties are passed on.
    """
    passed = [*PASSED, *[c for c in ("n", "ties") if games is not None]]
    plain = [i for i, c in enumerate(listed) if c.kind not in models.BANKS]
    fits = [i for i, c in enumerate(listed) if c.kind in models.BANKS]
    own = F.array(*[_plain(listed[i]).cast("double") for i in plain]) if plain else F.array().cast("array<double>")
    rows = known.select(*passed, own.alias("plain"))
    if fits:
        rows = rows.join(fitted_signals(known if games is None else games, [listed[i] for i in fits], games is not None), "game_id")
    else:
        rows = rows.withColumn("fitted", F.array().cast("array<double>"))
    back = {number: place for place, number in enumerate([*plain, *fits])}
    order = F.array(*[F.lit(back[i] + 1) for i in range(len(listed))])
    both = settled(rows.select(*passed, F.concat("plain", "fitted").alias("all")))
    return both.select(*passed, F.transform(order, lambda i: F.element_at("all", i)).alias("x"))


def signals(known: DataFrame, listed: list[Candidate]) -> DataFrame:
    """(metric, game_id, day, league, half, least_n, value): ``wide_signals`` with a row for each signal; metric is the candidate's place."""
    return wide_signals(known, listed).select(*PASSED, F.posexplode("x").alias("metric", "value"))


class Combo(NamedTuple):
    name: str
    features: tuple[str, ...]
    ridge: float = 1.0
    by_league: bool = False


BASE = "massey cap 8 ridge 1"


def combos() -> list[Combo]:
    """One to eight signals in one fit."""
    # Which signals are joined, and their ridges.
    second = ("meetings margin", "meetings result", "last capped 5", "last points 5", "residual last 3", "residual last 5", "streak", "last result", "rest", "record points",
              "rpi opponents", "elo k 48 edge 35 margins log", "bradley-terry ridge 0.3 soft 4", "poisson ridge 3", "record scored")
    many = (BASE, "meetings margin", "residual last 5", "streak", "rest", "record points", "elo k 48 edge 35 margins log", "poisson ridge 3")
    many_ridges = (1.0, 10.0, 50.0)
    models = (BASE, "elo k 48 edge 35 margins log", "poisson ridge 3", "bradley-terry ridge 0.3 soft 4")
    record = ("record points", "record margin cap 99", "record scored")
    # End of the fixed values.
    out = [Combo(f"{BASE} + {name}", (BASE, name)) for name in second]
    out += [Combo(f"{BASE} by league", (BASE,), by_league=True), Combo(f"{BASE} + home constant by league", (BASE, "home constant"), by_league=True)]
    out += [Combo(f"eight signals ridge {ridge:g}", many, ridge) for ridge in many_ridges]
    out += [Combo("massey + elo + poisson + bradley-terry", models, 10.0), Combo("record only", record), Combo("massey margin + result", (BASE, "massey target result cap 1 ridge 1"))]
    return out


def split_day(known: DataFrame, least: int = 5, share: float = 0.6) -> DataFrame:
    """One row: the last training day, on which so large a share of the games with ``least`` earlier ones is reached. Running sums go over days."""
    days = known.where(F.col("least_n") >= least).groupBy("day").agg(F.sum(walk.games_of(known)).alias("n"))
    running = days.select("day", F.sum("n").over(Window.orderBy("day")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return running.agg(F.min(F.when(F.col("upto") >= F.floor(F.col("total") * share), F.col("day"))).alias("split_day"))


def evaluated(wide: DataFrame, listed: list[Candidate], joined: list[Combo], least: int = 5) -> DataFrame:
    """(name, family, complexity, kind, league, part, n, hits, loss, squares): sums of the scores of every candidate, its own chances where it has them, and
    every combo, by league and part (train, holdout). ``table_of`` makes means of them."""
    day = split_day(wide, least).first()[0]
    last = (day - datetime.date(1970, 1, 1)).days if day else None
    numbers = {c.name: i for i, c in enumerate(listed)}
    entries = [walk.Entry((i,)) for i in range(len(listed))] + [walk.Entry(tuple(numbers[f] for f in c.features), c.ridge, c.by_league) for c in joined]
    fitted = walk.scores(wide, entries, last, least).withColumn("kind", F.when(F.col("entry") < len(listed), "calibrated").otherwise("combo"))
    raw = [i for i, c in enumerate(listed) if c.raw]
    chances = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("entry"), score.sigmoid(F.col("x")[i]).alias("p")) for i in raw])).alias("c") if raw else None
    out = fitted
    if raw:
        part = F.when(F.col("day") <= F.lit(day), "train").otherwise("holdout").alias("part")
        own = wide.where(F.col("least_n") >= least).select("league", F.posexplode(walk.outcomes_of(wide)).alias("half", "games"), part, chances).where("games > 0").select("league", "half", "games", "part", "c.*")
        sums = own.groupBy("entry", "league", "part").agg(F.sum("games").cast("double").alias("n"), *[F.sum(F.col("games") * m).alias(c) for c, m in zip(("hits", "loss", "squares"), score.measures(F.col("p"), F.col("half")), strict=True)])
        out = fitted.unionByName(sums.withColumn("kind", F.lit("raw")))
    complexity = {c.name: c.complexity for c in listed}
    named = [(c.name, c.family, c.complexity) for c in listed] + [(c.name, "combo", sum(complexity[f] for f in c.features) + (2 if c.by_league else 1)) for c in joined]
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("family"), F.lit(x).alias("complexity")) for n, f, x in named])
    return out.withColumn("e", F.element_at(table, (F.col("entry") + 1).cast("int"))).select("e.*", "kind", "league", "part", "n", "hits", "loss", "squares")


def table_of(sums: DataFrame, *by: str) -> DataFrame:
    """Scores of ``evaluated`` by part (train, holdout, all) and the columns ``by``."""
    parted = sums.withColumn("part", F.explode(F.array("part", F.lit("all"))))
    n = F.sum("n")
    return parted.groupBy("name", "family", "complexity", "kind", *by, "part").agg(
        n.cast("long").alias("n"), (F.sum("hits") / n).alias("accuracy"), (F.sum("loss") / n).alias("log_loss"), (F.sum("squares") / n).alias("brier")
    )


def selected(scores: DataFrame, top: int = 10, slack: float = 0.002) -> DataFrame:
    """One row: of the ``top`` entries by training loss, those within ``slack`` of the best on the holdout, and of them the simplest."""
    wide = scores.where("part <> 'all'").groupBy("name", "kind", "complexity").agg(
        F.max(F.when(F.col("part") == "train", F.col("log_loss"))).alias("train"), F.max(F.when(F.col("part") == "holdout", F.col("log_loss"))).alias("holdout")
    )
    best = wide.dropna(subset=["train", "holdout"]).orderBy("train", "name", "kind").limit(top)
    near = best.crossJoin(F.broadcast(best.agg(F.min("holdout").alias("least")))).where(F.col("holdout") <= F.col("least") + slack)
    return near.orderBy("complexity", "holdout", "name", "kind").limit(1).select("name", "kind", "complexity", "train", "holdout")
