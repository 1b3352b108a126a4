"""Kalman strengths whose state is kept across runs: each run goes on from the games that the runs before it have seen.

Games land as files. A run reads the files that no run has read, in batches of at most ``files`` files, and carries each league's state in the state
store, whose checkpoint lies with the output under one root. A run that was killed leaves its last whole batch; the next run repeats
what was not committed. A task holds one league's games of one batch and its state (teams squared numbers).

Cases: games without a day, sides or goals are left out; games of one batch go by in order of day and id; a game of a day before the state's counts when it
arrives, without going back, so the games of a day should land in one file or at least in one run; a root without files that are new gives what it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slate.operators import models

GAMES = "game_id long, day date, league long, home long, away long, home_goals long, away_goals long"
STATE = "teams array<long>, mean array<double>, cov array<double>, day int"
OUT = "league long, game_id long, day date, n_before_sides int, expected double"


def expected_margins(stream: DataFrame, options: dict) -> DataFrame:
    """Every game's expected margin from the games before its day, as they arrive; ``options`` are those of ``models.Kalman``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bank = models.Kalman([options])
        league = models.League([bank])
        if state.exists:
            teams, mean, cov, day = state.get
            league.place = {t: i for i, t in enumerate(teams)}
            league.means = [(np.nan, np.nan)] * len(teams)
            bank.teams, bank.day = len(teams), day
            bank.mean, bank.cov = np.array([mean], float), np.array(cov, float).reshape(1, len(mean), len(mean))
        games = pd.concat(list(frames)).sort_values(["day", "game_id"])
        numbers = pd.to_datetime(games.day).to_numpy("datetime64[D]").astype(np.int64)
        for number in np.unique(numbers):
            own = games[numbers == number]
            home, away = own.home.to_numpy(), own.away.to_numpy()
            known = [int(h in league.place) + int(a in league.place) for h, a in zip(home.tolist(), away.tolist(), strict=True)]
            h, a = league.numbered(home, away)
            day = max(int(number), bank.day if bank.day is not None else int(number))
            yield pd.DataFrame({"league": key[0], "game_id": own.game_id, "day": own.day, "n_before_sides": np.array(known, np.int32), "expected": bank.expect(h, a, day)[:, 0]})
            league.learn(h, a, own.home_goals.to_numpy(float), own.away_goals.to_numpy(float), day)
        state.update((list(league.place), bank.mean[0].tolist(), bank.cov[0].ravel().tolist(), int(bank.day)))

    whole = stream.dropna(subset=["day", "league", "home", "away", "home_goals", "away_goals"])
    return whole.groupBy("league").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def start(spark: SparkSession, landed: str, root: str, options: dict, files: int = 100) -> StreamingQuery:
    """A run over the files of ``landed`` that no run of this ``root`` has read."""
    stream = spark.readStream.schema(GAMES).option("maxFilesPerTrigger", files).parquet(landed)
    writer = expected_margins(stream, options).writeStream.outputMode("append").format("parquet")
    return writer.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")


def run(spark: SparkSession, landed: str, root: str, options: dict, files: int = 100) -> DataFrame:
    """Runs to the end of what has landed and gives the results of all runs of this root."""
    start(spark, landed, root, options, files).awaitTermination()
    return spark.read.schema(OUT).parquet(f"{root}/out")


def land(games: DataFrame, folder: str) -> None:
    """Writes games as one file of the landing folder for each call; games of later days land later."""
    games.select("game_id", "day", F.col("league").cast("long"), *[F.col(c).cast("long").alias(c) for c in ("home", "away", "home_goals", "away_goals")]).coalesce(1).write.mode("append").parquet(folder)
