"""Walk-forward logistic fits of many entries over raw signals, refitted for every day from games of earlier days only.

An entry has some signals, a ridge on its standardised slopes and perhaps a league of its own. Days are cut into blocks, each of
which begins where the games that count have grown by a share (``GROWTH``); before ``EXACT`` games there is one block, so the number of blocks grows
with the logarithm of the games.

* Fits at the starts of blocks: Newton steps of all entries and blocks at once. A step is one job: every task adds up gradients and
  Hessians of its games, which are summed by entry on the executors; the driver solves systems as wide as an entry.
* Fits of the days in a block: blocks are tasks of their own, in parallel. Earlier games stand as the quadratic of their loss at the block's fit; games of
  the block count exactly, until more than ``HELD`` of them are there: then the older ones are added to the quadratic at the fit of the day. The first block has
  no quadratic and holds its games, so fits of fewer than ``EXACT`` games are exact.

A task holds a day, ``EXACT`` games of at most ``WIDTH`` entries and their systems, however many games there are.

Cases: signals that are null, NaN or infinite count as zero; games without a day, league or outcome are left out before; days before ``at_least``
games (``own_least`` of a league of its own; until then the pooled fit stands in) have no chance; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT, GROWTH, HELD, WIDTH = 2000, 0.15, 512, 64
AT_LEAST, OWN_LEAST = 30, 150
STEPS, CLOSE = 40, 3e-4


class Entry(NamedTuple):
    """Places of the signals; with ``by_league`` every league has a fit of its own beside the pooled one."""

    features: tuple[int, ...]
    ridge: float = 1.0
    by_league: bool = False


class _Fit(NamedTuple):
    entry: int
    league: int | None


class _Bundle(NamedTuple):
    """Fits of one width that share tasks; the fits of one entry stay together, the pooled one first."""

    width: int
    fits: list[_Fit]


def _bundles(entries: list[Entry], leagues: list[int]) -> list[_Bundle]:
    out: list[_Bundle] = []
    for width in sorted({len(e.features) for e in entries}):
        now: list[_Fit] = []
        for i, e in enumerate(entries):
            if len(e.features) != width:
                continue
            own = [_Fit(i, None), *([_Fit(i, league) for league in leagues] if e.by_league else [])]
            if now and len(now) + len(own) > WIDTH:
                out.append(_Bundle(width, now))
                now = []
            now = now + own
        out.append(_Bundle(width, now))
    return out


def _starts(rows: DataFrame, exact: int, growth: float) -> list[int]:
    """First days of the blocks, as days since 1970. Only counts of days reach the driver."""
    days = rows.where("counts > 0").groupBy("day").agg(F.sum("counts").alias("n")).orderBy("day").collect()
    out, total, due = [-(1 << 30)], 0, exact
    for day, n in days:
        if total >= due:
            out.append(day)
            due = max(due, total) * (1 + growth)
        total += n
    return out


class _Plan:
    def __init__(self, entries: list[Entry], leagues: list[int], starts: list[int]) -> None:
        self.entries, self.starts = entries, starts
        self.bundles = _bundles(entries, leagues)

    def features(self, bundle: _Bundle) -> np.ndarray:
        """Fits by width: places of signals."""
        return np.array([self.entries[f.entry].features for f in bundle.fits], np.int64).reshape(len(bundle.fits), bundle.width)

    def ridges(self, bundle: _Bundle) -> np.ndarray:
        return np.array([self.entries[f.entry].ridge for f in bundle.fits])

    def weights(self, bundle: _Bundle, counts: np.ndarray, league: np.ndarray) -> np.ndarray:
        """Fits by games: whether a game counts for a fit."""
        out = np.broadcast_to(counts.astype(float), (len(bundle.fits), len(counts))).copy()
        for i, f in enumerate(bundle.fits):
            if f.league is not None:
                out[i] *= league == f.league
        return out


def _clean(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


def _table(column: pa.Array) -> np.ndarray:
    """A list column of one length as rows of numbers."""
    return _clean(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))


def _design(x: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Fits by games by (1, signals)."""
    out = np.ones((len(features), len(x), features.shape[1] + 1))
    out[:, :, 1:] = x[:, features].transpose(1, 0, 2)
    return out


def _chance(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def _losses(x: np.ndarray, theta: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians of the fits' losses over some games, without the ridge."""
    if x.shape[2] == 2:
        own = x[:, :, 1]
        p = _chance(own * theta[:, 1:] + theta[:, :1])
        pull = weights * (p - y)
        bent = weights * np.maximum(p * (1 - p), 1e-9)
        leaning = bent * own
        g = np.stack((pull.sum(1), np.einsum("ij,ij->i", pull, own)), axis=1)
        a, b, c = bent.sum(1), leaning.sum(1), np.einsum("ij,ij->i", leaning, own)
        return g, np.stack((a, b, b, c), axis=1).reshape(-1, 2, 2)
    p = _chance((x @ theta[:, :, None])[:, :, 0])
    pull = weights * (p - y)
    bent = weights * np.maximum(p * (1 - p), 1e-9)
    turned = x.transpose(0, 2, 1)
    return (turned @ pull[:, :, None])[:, :, 0], (turned * bent[:, None, :]) @ x


def _solved(hessian: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    if gradient.shape[1] == 2:
        a, b, c = hessian[:, 0, 0], hessian[:, 0, 1], hessian[:, 1, 1]
        det = a * c - b * b
        return np.stack(((c * gradient[:, 0] - b * gradient[:, 1]) / det, (a * gradient[:, 1] - b * gradient[:, 0]) / det), axis=1)
    return np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]


def _penalties(moments: np.ndarray, ridges: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Matrices of the squared parameters: the ridge times each signal's variance among the games that count, as slopes are of standardised signals, and a trace
    on the intercept where these games have their means, so that it is the same wherever signals are centred.

    ``moments``: fits by (n, sums, sums of squares) of scaled signals."""
    width = scale.shape[1]
    n = moments[:, :1]
    variance = np.maximum(moments[:, 1 + width :] - moments[:, 1 : 1 + width] ** 2 / np.maximum(n, 1), 0) / np.maximum(n - 1, 1)
    flat = np.sqrt(variance) * scale <= 1e-12
    out = np.zeros((len(n), width + 1, width + 1))
    out[:, np.arange(1, width + 1), np.arange(1, width + 1)] = ridges[:, None] * np.where(flat, 1 / scale**2, variance)
    at = np.column_stack((np.ones(len(n)), moments[:, 1 : 1 + width] / np.maximum(n, 1)))
    return out + 1e-6 * at[:, :, None] * at[:, None, :]


def _length(step: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """How far each fit's step goes over the games that count: the slopes of standardised signals, and the intercept at the signals' means.

    Early games of a signal that grows lie far from the mean of all games, so its slope and the intercept move far together and chances hardly at all."""
    width = step.shape[1] - 1
    mean, square = (m / np.maximum(moments[:, :1], 1) for m in (moments[:, 1 : 1 + width], moments[:, 1 + width :]))
    slopes = np.abs(step[:, 1:]) * np.sqrt(np.maximum(square - mean**2, 0))
    return np.maximum(slopes.max(axis=1, initial=0), np.abs(step[:, 0] + (step[:, 1:] * mean).sum(axis=1)))


def _moments(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    own = x[:, :, 1:].transpose(0, 2, 1)
    return np.concatenate((weights.sum(axis=1, keepdims=True), (own @ weights[:, :, None])[:, :, 0], (own**2 @ weights[:, :, None])[:, :, 0]), axis=1)


def _lists(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as a list column, without a Python object for each number."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def _summed(partials: DataFrame, parts: int) -> dict[int, np.ndarray]:
    """Sums of the tasks' arrays (one length for a bundle) by bundle; what the driver gets is as large as the fits' systems, not as the games."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for bundle, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = values.values.to_numpy()
                total[bundle] = total[bundle] + own if bundle in total else own.copy()
        for bundle, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([bundle], pa.int32()), _lists(own[None])], names=["bundle", "sums"])

    rows = partials.repartition(parts, "bundle").mapInArrow(run, "bundle int, sums array<double>").toArrow()
    return dict(zip(rows.column(0).to_pylist(), [v.values.to_numpy() for v in rows.column(1)], strict=True))


def _block_sums(rows: DataFrame, plan: _Plan, states: dict[int, np.ndarray] | None, centre: np.ndarray, scale: np.ndarray) -> dict[int, np.ndarray]:
    """By bundle, blocks by fits by sums over the games before the block: moments of the signals, or with ``states`` gradients and Hessians."""
    blocks = len(plan.starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            # a game counts for all later blocks: games are sorted, and those of a block's sum are the first ones
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            block, league, half = (batch.column(i).to_numpy()[order] for i in range(3))
            counts = batch.column(3).to_numpy(zero_copy_only=False)[order]
            signals = (_table(batch.column(4))[order, : len(centre)] - centre) / scale
            upto = np.searchsorted(block, np.arange(blocks))
            for number, bundle in enumerate(plan.bundles):
                features = plan.features(bundle)
                x, weights = _design(signals, features), plan.weights(bundle, counts, league)
                width = bundle.width
                size = 1 + 2 * width if states is None else (width + 1) * (width + 2)
                own = total.setdefault(number, np.zeros((blocks, len(features), size)))
                for at in range(1, blocks):
                    n = upto[at]
                    if not n:
                        continue
                    if states is None:
                        own[at] += _moments(x[:, :n], weights[:, :n])
                    else:
                        g, h = _losses(x[:, :n], states[number][at], half[:n] / 2, weights[:, :n])
                        own[at] += np.concatenate((g, h.reshape(len(g), -1)), axis=1)
        names = [pa.array(total.keys(), pa.int32()), pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(names, names=["bundle", "sums"])

    slim = rows.select(F.col("block").cast("int"), F.col("league").cast("long"), "half", "counts", "x")
    found = _summed(slim.mapInArrow(run, "bundle int, sums array<double>"), len(plan.bundles))
    out = {}
    for number, bundle in enumerate(plan.bundles):
        size = 1 + 2 * bundle.width if states is None else (bundle.width + 1) * (bundle.width + 2)
        out[number] = found.get(number, np.zeros(blocks * len(bundle.fits) * size)).reshape(blocks, len(bundle.fits), size)
    return out


def _conditions(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Every signal's mean and spread over all games. They condition the systems; the fits do not depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * width)
        for batch in batches:
            if batch.num_rows:
                x = _table(batch.column(0))[:, :width]
                total += np.concatenate(([len(x)], x.sum(axis=0), (x**2).sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["bundle", "sums"])

    sums = _summed(rows.select("x").mapInArrow(run, "bundle int, sums array<double>"), 1).get(0, np.zeros(1 + 2 * width))
    n = max(sums[0], 1)
    centre = sums[1 : 1 + width] / n
    spread = np.sqrt(np.maximum(sums[1 + width :] / n - centre**2, 0))
    return centre, np.where(spread > 1e-9, spread, 1.0)


class _Start(NamedTuple):
    """What a block begins with, by fit: the point of the quadratic, gradient and Hessian of earlier games there, and their moments."""

    theta: np.ndarray
    gradient: np.ndarray
    hessian: np.ndarray
    moments: np.ndarray


def _block_starts(rows: DataFrame, plan: _Plan, centre: np.ndarray, scale: np.ndarray) -> list[list[_Start]]:
    """By bundle and block. All Newton steps of all fits go in lockstep, one job a step."""
    blocks = len(plan.starts)
    moments = _block_sums(rows, plan, None, centre, scale)
    states = {b: np.zeros((blocks, len(bundle.fits), bundle.width + 1)) for b, bundle in enumerate(plan.bundles)}
    sums: dict[int, np.ndarray] = {}
    for _ in range(STEPS if blocks > 1 else 0):
        sums = _block_sums(rows, plan, states, centre, scale)
        moved, now = 0.0, {}
        for b, bundle in enumerate(plan.bundles):
            k = bundle.width + 1
            now[b] = states[b].copy()
            for at in range(1, blocks):
                pen = _penalties(moments[b][at], plan.ridges(bundle), scale[plan.features(bundle)])
                g = sums[b][at][:, :k] + (pen @ states[b][at][:, :, None])[:, :, 0]
                h = sums[b][at][:, k:].reshape(-1, k, k) + pen
                step = _solved(h, g)
                step *= np.minimum(1.0, 4.0 / np.maximum(_length(step, moments[b][at]), 1e-300))[:, None]
                now[b][at] = states[b][at] - step
                moved = max(moved, float(_length(step, moments[b][at]).max()))
        if moved < 1e-4:
            break  # the quadratic at this point has the last step in it
        states = now
    out = []
    for b, bundle in enumerate(plan.bundles):
        k, fits = bundle.width + 1, len(bundle.fits)
        none = np.zeros((blocks, fits, k + k * k))
        own = sums.get(b, none)
        out.append([_Start(states[b][at], own[at][:, :k], own[at][:, k:].reshape(fits, k, k), moments[b][at]) for at in range(blocks)])
    return out


class _Days:
    """The fits of one bundle through the days of one block."""

    def __init__(self, plan: _Plan, bundle: _Bundle, start: _Start, centre: np.ndarray, scale: np.ndarray, held: int) -> None:
        self.plan, self.bundle, self.held = plan, bundle, held
        self.places = plan.features(bundle)
        self.ridges, self.scale = plan.ridges(bundle), scale[self.places]
        self.point, self.gradient, self.hessian, self.moments = (v.copy() for v in start)
        self.theta = self.point.copy()
        k = bundle.width + 1
        self.x, self.y, self.w = np.zeros((len(self.places), 0, k)), np.zeros(0), np.zeros((len(self.places), 0))
        self.stale = True

    def chances(self, x: np.ndarray, league: np.ndarray, at_least: int, own_least: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the bundle, and their chances for some games (NaN where there is no fit yet)."""
        n = self.moments[:, 0]
        if self.stale and n.max(initial=0) >= at_least:
            self._fit()
        p = _chance((x @ self.theta[:, :, None])[:, :, 0])
        p[n < at_least] = np.nan
        entries, out = [], []
        for i, fit in enumerate(self.bundle.fits):
            if fit.league is None:
                entries.append(fit.entry)
                out.append(p[i].copy())
            elif n[i] >= own_least:
                own = (league == fit.league) & ~np.isnan(out[-1])
                out[-1][own] = p[i][own]
        return np.array(entries), np.array(out)

    def _fit(self) -> None:
        pen = _penalties(self.moments, self.ridges, self.scale)
        for _ in range(STEPS):
            g, h = _losses(self.x, self.theta, self.y, self.w)
            g += self.gradient + (self.hessian @ (self.theta - self.point)[:, :, None])[:, :, 0] + (pen @ self.theta[:, :, None])[:, :, 0]
            h += self.hessian + pen
            step = _solved(h, g)
            step *= np.minimum(1.0, 4.0 / np.maximum(_length(step, self.moments), 1e-300))[:, None]
            self.theta = self.theta - step
            if _length(step, self.moments).max(initial=0) < CLOSE:
                break  # what is left is of the order of the step's square
        self.stale = False

    def learn(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        self.moments += _moments(x, w)
        self.x, self.y, self.w = np.concatenate((self.x, x), axis=1), np.append(self.y, y), np.concatenate((self.w, w), axis=1)
        self.stale = True
        if len(self.y) > self.held:
            old = len(self.y) - self.held // 2
            g, h = _losses(self.x[:, :old], self.theta, self.y[:old], self.w[:, :old])
            self.gradient += (self.hessian @ (self.theta - self.point)[:, :, None])[:, :, 0] + g
            self.hessian += h
            self.point = self.theta.copy()
            self.x, self.y, self.w = self.x[:, old:], self.y[old:], self.w[:, old:]


def games_of(wide: DataFrame) -> Column:
    """How many games a row stands for: column n, 1 where there is none."""
    return F.col("n") if "n" in wide.columns else F.lit(1).cast("long")


def outcomes_of(wide: DataFrame) -> Column:
    """Array of a row's games that were lost, tied and won. Rows of n games have their mean ``half`` and their ``ties``."""
    n = games_of(wide)
    ties = F.col("ties") if "ties" in wide.columns else (F.col("half") == 1).cast("long")
    won = F.round((F.col("half") * n - ties) / 2).cast("long")
    return F.array(n - ties - won, ties, won)


def prepared(wide: DataFrame, least: int = 2) -> DataFrame:
    """``wide`` (game_id, day date, league, half, least_n, x array of signals) with whole days and the games that count for fits. A row may stand for n games with
    the same signals, see ``outcomes_of``; losses are linear in the outcome, so fits need no more than its mean."""
    counts = F.when(F.col("least_n") >= least, games_of(wide)).otherwise(0).cast("long")
    lost, tied, won = (outcomes_of(wide)[i].alias(c) for i, c in enumerate(("lost", "tied", "won")))
    return wide.select(F.datediff("day", F.lit("1970-01-01")).alias("day"), "game_id", "league", F.col("half").cast("double").alias("half"), "least_n", counts.alias("counts"), lost, tied, won, "x", *["drawn"] * ("drawn" in wide.columns))


def _days(wide: DataFrame, entries: list[Entry], exact: int, growth: float, held: int, at_least: int, own_least: int, schema: str, emit) -> DataFrame:  # noqa: ANN001
    """Runs all days of all blocks; ``emit(held, entries, p, columns)`` makes the rows of the result, where columns are game_id, day, league, least_n and the games lost, tied and won."""
    rows = prepared(wide)
    leagues = sorted(r[0] for r in rows.select("league").distinct().collect()) if any(e.by_league for e in entries) else []
    plan = _Plan(entries, leagues, _starts(rows, exact, growth))
    width = 1 + max(i for e in entries for i in e.features)
    centre, scale = _conditions(rows, width)
    blocked = rows.withColumn("block", F.size(F.filter(F.array(*[F.lit(s) for s in plan.starts]), lambda s: s <= F.col("day"))) - 1)
    starts = _block_starts(blocked, plan, centre, scale)
    bundles = F.explode(F.sequence(F.lit(0), F.lit(len(plan.bundles) - 1))).alias("bundle")
    used = F.element_at(F.array(*[F.array(*[F.lit(int(i) + 1) for i in sorted(set(plan.features(b).ravel().tolist()))]) for b in plan.bundles]), F.col("bundle") + 1)
    sent = blocked.select("block", bundles, "day", "game_id", "league", "half", "least_n", "counts", "lost", "tied", "won", "x").withColumn("x", F.transform(used, lambda i: F.element_at("x", i)))
    tasks = len(plan.starts) * len(plan.bundles)
    parts = max(int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(tasks, 1000))
    ordered = sent.repartition(parts, "block", "bundle").sortWithinPartitions("block", "bundle", "day", "game_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None
        for columns, x in _whole_days(batches):
            block, number, league, half, counts = int(columns[0][0]), int(columns[1][0]), columns[4], columns[5], columns[7]
            bundle = plan.bundles[number]
            if (block, number) != now:
                if kept is not None:
                    yield from emit(kept, None, None, None)
                now, kept = (block, number), {}
                days = _Days(plan, bundle, starts[number][block], centre, scale, held if block else max(held, exact))
                places = sorted(set(plan.features(bundle).ravel().tolist()))
                local = np.searchsorted(places, plan.features(bundle))
            design = _design((x - centre[places]) / scale[places], local)
            entry, p = days.chances(design, league, at_least, own_least)
            yield from emit(kept, entry, p, [columns[3], columns[2], league, columns[6], *columns[8:11]])
            some = counts.astype(bool)
            days.learn(design[:, some], half[some] / 2, plan.weights(bundle, counts[some], league[some]))
        if kept is not None:
            yield from emit(kept, None, None, None)

    return ordered.mapInArrow(run, schema)


def _whole_days(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The plain columns and signals of one (block, bundle, day) at a time."""
    held: list[tuple[list[np.ndarray], np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        plain = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in plain[:3]], axis=0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            part = [c[a:b] for c in plain]
            if held and any(held[-1][0][i][0] != part[i][0] for i in range(3)):
                yield _put(held)
                held = []
            held.append((part, _table(batch.columns[-1].slice(a, b - a))))
    if held:
        yield _put(held)


def _put(held: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.concatenate(c) for c in zip(*[h[0] for h in held], strict=True)], np.concatenate([h[1] for h in held])


def chances(wide: DataFrame, entries: list[Entry], exact: int = EXACT, growth: float = GROWTH, held: int = HELD, at_least: int = AT_LEAST, own_least: int = OWN_LEAST) -> DataFrame:
    """(entry, game_id, p): every entry's chance of every game that has one."""

    def emit(kept: dict, entry, p, columns) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        if entry is None:
            return
        at = ~np.isnan(p)
        which, game = np.nonzero(at)
        yield pa.RecordBatch.from_arrays([pa.array(entry[which], pa.int64()), pa.array(columns[0][game], pa.int64()), pa.array(p[at])], names=["entry", "game_id", "p"])

    return _days(wide, entries, exact, growth, held, at_least, own_least, "entry long, game_id long, p double", emit)


def scores(wide: DataFrame, entries: list[Entry], split_day: int | None, least: int = 5, exact: int = EXACT, growth: float = GROWTH, held: int = HELD) -> DataFrame:
    """(entry, league, part, n, hits, loss, squares): sums over games with ``least`` earlier ones, where part is train up to ``split_day`` (days since 1970) and holdout after it.

    Tasks add up by entry and league, so the result has a row for each of them, not for each game.
    """

    def emit(kept: dict, entry, p, columns) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        if entry is None:
            rows = [(int(e), *key, *sums) for key, (entries_, table) in kept.items() for e, sums in zip(entries_, table.tolist(), strict=True) if sums[0]]
            kinds = (pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["entry", "league", "part", "n", "hits", "loss", "squares"])
            return
        _, day, league, least_n, lost, tied, won = columns
        part = "train" if split_day is not None and day[0] <= split_day else "holdout"
        n = lost + tied + won
        q = np.clip(p, 1e-6, 1 - 1e-6)
        hits = np.where(p == 0.5, n / 2, np.where(p > 0.5, won, lost) + tied / 2)
        loss = -((won + tied / 2) * np.log(q) + (lost + tied / 2) * np.log(1 - q))
        squares = lost * p**2 + tied * (p - 0.5) ** 2 + won * (p - 1) ** 2
        known = ~np.isnan(p) & (least_n >= least)
        for one in np.unique(league):
            at = known & (league == one)
            if at.any():
                sums = np.stack([np.where(at, v, 0.0).sum(axis=1) for v in (np.broadcast_to(n, p.shape), hits, loss, squares)], axis=1)
                kept.setdefault((int(one), part), (entry, np.zeros_like(sums)))[1][:] += sums

    parts = _days(wide, entries, exact, growth, held, AT_LEAST, OWN_LEAST, "entry long, league long, part string, n double, hits double, loss double, squares double", emit)
    return parts.groupBy("entry", "league", "part").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "loss", "squares")])
