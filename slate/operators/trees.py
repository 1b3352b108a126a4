"""Walk-forward trees on soft labels: boosting and forests, refitted as games grow, from games of earlier days only.

Refits begin at ``at_least`` games that count and follow whenever these have grown by ``growth``; a game is judged by the last refit before its day. All refits
and all trees of a round grow in lockstep, one job for each level: a task bins its games, follows the trees grown so far
and adds up gradients and weights by (refit, tree, node, signal, bin); these histograms are summed on the executors, and the
driver picks the splits. What is summed and sent depends on refits, trees, nodes, signals and bins, not on the games.

Boosting fits gradients of the log-loss, a tie being half a win; a forest fits the outcome, with Poisson weights by game and tree and a
share of the signals at each node. Bins are equal parts of the mean plus or minus ``SPREADS`` deviations of the earlier games, so no later game has a part in them.

A row may stand for the n games of a pairing, which have the same signals (``walk.outcomes_of``): gradients then count n times, and the sums of the games' Poisson
weights are ``drawn`` before.

Cases: signals that are null, NaN or infinite count as zero; days before the first refit have no chance; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.operators import walk

BINS, SPREADS = 32, 2.5
AT_LEAST, GROWTH = 200, 0.25


class Model(NamedTuple):
    """``rounds`` of ``trees`` trees each; a forest has one round. ``pull`` is the ridge on leaves, ``least`` the least weight of a leaf, ``share`` that of the signals tried at a node."""

    name: str
    rounds: int
    trees: int
    depth: int
    rate: float
    pull: float
    least: float
    share: float = 1.0
    boosted: bool = True


class Grown(NamedTuple):
    """Trees of one round, by refit and tree: signal (-1: none) and bin of the split at inner nodes, in heap order, and values of leaves."""

    signal: np.ndarray
    cut: np.ndarray
    value: np.ndarray


def _binned(x: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((x - low) / width), 0, BINS - 1).astype(np.int64)


def _nodes(bins: np.ndarray, signal: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of each game after so many levels of one tree, from 0 within the level."""
    at = np.zeros(len(bins), np.int64)
    for level in range(levels):
        node = (1 << level) - 1 + at
        s = signal[node]
        at = 2 * at + ((s >= 0) & (bins[np.arange(len(bins)), np.maximum(s, 0)] > cut[node]))
    return at


def margins(bins: np.ndarray, model: Model, rounds: list[Grown], refit: int) -> np.ndarray:
    """Sums of boosted trees, or the mean of a forest's."""
    out = np.zeros(len(bins))
    for grown in rounds:
        for tree in range(model.trees):
            out += model.rate * grown.value[refit, tree][_nodes(bins, grown.signal[refit, tree], grown.cut[refit, tree], model.depth)]
    return out


def chance(bins: np.ndarray, model: Model, rounds: list[Grown], refit: int) -> np.ndarray:
    m = margins(bins, model, rounds, refit)
    return np.clip(1 / (1 + np.exp(-m)) if model.boosted else m, 1e-4, 1 - 1e-4)


def _weights(games: np.ndarray, tree: int) -> np.ndarray:
    """Poisson weights of mean one, the same for a game and tree wherever it is read."""
    with np.errstate(over="ignore"):
        z = (games.astype(np.uint64) + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(32))) >> np.uint64(11)).astype(float) / 2**53
    return np.searchsorted(np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)]), u).astype(float)


def drawn(games: DataFrame, by: list[str], trees: int) -> DataFrame:
    """(game_id, drawn): for the first game of each group, sums over its games of the trees' Poisson weights, then those of the weights times half. ``games``: game_id, half and ``by``."""
    kept = games.select(*by, F.col("game_id").cast("long").alias("game_id"), F.col("half").cast("long").alias("half"))
    passed, names = kept.columns, [f"w{t}" for t in range(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            game = batch.column(len(by)).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(_weights(game, t).astype(np.int8)) for t in range(trees)]], names=[*passed, *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], *[f"{n} tinyint" for n in names]])
    sums = [F.sum(n) for n in names] + [F.sum(F.col(n) * F.col("half")) for n in names]
    return kept.mapInArrow(run, schema).groupBy(*by).agg(F.min("game_id").alias("game_id"), F.array(*[x.cast("double") for x in sums]).alias("drawn")).drop(*by)


def _histograms(rows: DataFrame, model: Model, rounds: list[Grown], now: Grown, level: int, lows: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """(refit, tree, node, signal, bin, 2): sums of gradients and weights over the games before each refit. Refit 0 stands for none."""
    refits, signals = lows.shape
    shape = (refits, model.trees, 1 << level, signals, BINS, 2)
    given = not model.boosted and "drawn" in rows.columns
    slim = rows.select("block", "game_id", "half", F.col("counts") if "counts" in rows.columns else F.lit(1).cast("long").alias("counts"), "x", *["drawn"] * given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            block, game, half, counts = (batch.column(i).to_numpy()[order] for i in range(4))
            x = walk._table(batch.column(4))[order]
            if given:
                told = walk._table(batch.column(5))[order].T
            elif not model.boosted:
                weights = np.array([_weights(game, tree) for tree in range(model.trees)]) * counts
                told = np.concatenate((weights, weights * half))
            upto = np.searchsorted(block, np.arange(refits))
            for refit in range(1, refits):
                n = int(upto[refit])
                if not n:
                    continue
                bins, y = _binned(x[:n], lows[refit], widths[refit]), half[:n] / 2
                if model.boosted:
                    p = 1 / (1 + np.exp(-margins(bins, model, rounds, refit)))
                    pull, weight = counts[:n] * (p - y), counts[:n] * np.maximum(p * (1 - p), 1e-6)
                for tree in range(model.trees):
                    if not model.boosted:
                        weight, pull = told[tree, :n], -told[model.trees + tree, :n] / 2
                    node = _nodes(bins, now.signal[refit, tree], now.cut[refit, tree], level)
                    place = (node[:, None] * signals + np.arange(signals)) * BINS + bins
                    for i, value in enumerate((pull, weight)):
                        sums = np.bincount(place.ravel(), np.repeat(value, signals), (1 << level) * signals * BINS)
                        total[refit, tree, :, :, :, i] += sums.reshape(1 << level, signals, BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(refits), pa.int32()), walk._lists(total.reshape(refits, -1))], names=["bundle", "sums"])

    found = walk._summed(slim.mapInArrow(run, "bundle int, sums array<double>"), refits)
    return np.array([found.get(r, np.zeros(int(np.prod(shape[1:])))) for r in range(refits)]).reshape(shape)


def _split(histogram: np.ndarray, model: Model, rng: np.random.Generator) -> tuple[int, int]:
    """Signal and bin of the best split of one node, -1 where none is better than none."""
    left = histogram.cumsum(axis=1)
    whole = left[0, -1]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + model.pull + 1e-12)
    gain = score(left) + score(right) - score(whole)
    gain[(left[..., 1] < model.least) | (right[..., 1] < model.least)] = -np.inf
    if model.share < 1:
        tried = rng.permutation(len(gain))[: max(1, round(model.share * len(gain)))]
        hidden = np.ones(len(gain), bool)
        hidden[tried] = False
        gain[hidden] = -np.inf
    best = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(best[0]), int(best[1])) if gain[best] > 1e-9 else (-1, 0)


def _leaves(histogram: np.ndarray, signal: np.ndarray, cut: np.ndarray, model: Model) -> np.ndarray:
    """Values of the leaves below the last inner level, from its histograms (nodes, signals, bins, 2)."""
    out = []
    first = (1 << (model.depth - 1)) - 1
    for node, sums in enumerate(histogram):
        s, c = signal[first + node], cut[first + node]
        whole = sums[0].sum(axis=0)
        left = sums[s, : c + 1].sum(axis=0) if s >= 0 else whole
        for side in (left, whole - left if s >= 0 else whole):
            out.append(-side[0] / (side[1] + model.pull) if side[1] > 0 else 0.0)
    return np.array(out)


def fitted(rows: DataFrame, model: Model, lows: np.ndarray, widths: np.ndarray) -> list[Grown]:
    """The rounds of all refits. ``rows``: block, game_id, half, x of the games that count, or of pairings with their counts (n) and, for forests, ``drawn``."""
    refits = len(lows)
    rounds: list[Grown] = []
    for number in range(model.rounds):
        inner, leaves = (1 << model.depth) - 1, 1 << model.depth
        now = Grown(np.full((refits, model.trees, inner), -1), np.zeros((refits, model.trees, inner), np.int64), np.zeros((refits, model.trees, leaves)))
        for level in range(model.depth):
            sums = _histograms(rows, model, rounds, now, level, lows, widths)
            for refit in range(1, refits):
                for tree in range(model.trees):
                    for node in range(1 << level):
                        place = (1 << level) - 1 + node
                        seed = np.random.default_rng((number, refit, tree, place))
                        now.signal[refit, tree, place], now.cut[refit, tree, place] = _split(sums[refit, tree, node], model, seed)
            if level == model.depth - 1:
                for refit in range(1, refits):
                    for tree in range(model.trees):
                        now.value[refit, tree] = _leaves(sums[refit, tree], now.signal[refit, tree], now.cut[refit, tree], model)
        rounds.append(now)
    return rounds


def chances(wide: DataFrame, models: list[Model], at_least: int = AT_LEAST, growth: float = GROWTH) -> DataFrame:
    """(model, game_id, day, half, least_n, p) of every game from the first refit on. ``wide``: game_id, day date, league, half, least_n, x; or pairings with n, ties and ``drawn``."""
    if "n" in wide.columns and "drawn" not in wide.columns and not all(m.boosted for m in models):
        raise ValueError("a forest over pairings needs the weights that were drawn for their games")
    rows = walk.prepared(wide)
    starts = walk._starts(rows, at_least, growth)
    place = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("day"))) - 1
    blocked = rows.withColumn("block", place)
    first = wide.select(F.size("x")).first()
    signals = first[0] if first else 1
    plan = walk._Plan([walk.Entry((i,)) for i in range(signals)], [], starts)
    moments = walk._block_sums(blocked, plan, None, np.zeros(signals), np.ones(signals))
    n, total, squares = np.concatenate([moments[b] for b in range(len(plan.bundles))], axis=1).transpose(2, 0, 1)
    mean = total / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean**2, 0))
    spread = np.where(spread > 1e-9, spread, 1.0)
    lows, widths = mean - SPREADS * spread, 2 * SPREADS * spread / BINS
    slim = blocked.where("counts > 0").select(F.col("block").cast("int"), F.col("game_id").cast("long"), F.col("half").cast("double"), "counts", "x", *["drawn"] * ("drawn" in rows.columns))
    grown = [(model, fitted(slim, model, lows, widths)) for model in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            x = walk._table(batch.column(5)) if batch.num_rows else np.zeros((0, signals))
            for refit in np.unique(block[block > 0]).tolist():
                at = np.flatnonzero(block == refit)
                bins = _binned(x[at], lows[refit], widths[refit])
                taken = batch.take(pa.array(at)).select([1, 2, 3, 4])
                for model, rounds in grown:
                    yield pa.RecordBatch.from_arrays([pa.array([model.name] * len(at)), *taken.columns, pa.array(chance(bins, model, rounds, refit))], names=["model", "game_id", "day", "half", "least_n", "p"])

    sent = blocked.select(F.col("block").cast("int"), F.col("game_id").cast("long"), "day", F.col("half").cast("double"), F.col("least_n").cast("long"), "x")
    return sent.mapInArrow(run, "model string, game_id long, day int, half double, least_n long, p double").withColumn("day", F.date_from_unix_date("day"))
