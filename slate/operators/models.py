"""Ratings of teams as of each day: banks of models of one method that learn games day by day.

A bank holds any number of option sets and works on all of them at once: sums that options share are kept once, and their systems are solved
together. Its state has teams squared numbers for each option set at most, and never a history of games. ``through_days`` streams
the days of each group through banks; Spark partitions and sorts the games, so a task holds one day and the banks.

Teams are numbered as they appear. ``grow`` is told the pre-season means (last season, outside) of all teams so far.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Columns = list[np.ndarray]


def whole_days(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[Columns]:
    """The rows of one value of the first ``keys`` columns at a time, as arrays; the input is sorted by them."""
    held: Columns | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = now if held is None else [np.concatenate(pair) for pair in zip(held, now, strict=True)]
        if not len(held[0]):
            continue
        new = np.any([c[1:] != c[:-1] for c in held[:keys]], axis=0)
        ends = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(ends, ends[1:], strict=False):
            yield [c[a:b] for c in held]
        held = [c[ends[-1] :] for c in held]
    if held is not None and len(held[0]):
        yield held


def newton(gradient: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, steps: int, most: float) -> np.ndarray:
    """Newton's method for rows of ``x`` at once; no entry moves by more than ``most`` in a step, so flat starts do not overshoot."""
    for _ in range(steps):
        g, hessian = gradient(x)
        step = np.linalg.solve(hessian, g[:, :, None])[:, :, 0]
        step = step * np.minimum(1.0, most / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-300))
        x = x - step
        if np.abs(step).max(initial=0) < 3e-5:
            break  # what is left is of the order of the step's square
    return x


def prior_of(last: np.ndarray, outside: np.ndarray, options: dict) -> np.ndarray:
    """Pre-season means from last season, an outside rating, or the mean of those that are known; 0 where none is."""
    mode = options.get("prior")
    if mode is None:
        return np.zeros(len(last))
    outside = outside * options.get("scale", 1.0)
    known = {"last": [last], "outside": [outside], "blend": [last, outside]}[mode]
    n = np.sum([~np.isnan(k) for k in known], axis=0)
    return options.get("share", 1.0) * np.sum([np.nan_to_num(k) for k in known], axis=0) / np.maximum(n, 1)


def target_of(options: dict, margin: np.ndarray) -> np.ndarray:
    """What a fit explains of a margin: itself, its root or its sign, within the cap."""
    capped = np.clip(margin, -options.get("cap", np.inf), options.get("cap", np.inf))
    target = options.get("target", "margin")
    return {"margin": capped, "sqrt": np.sign(capped) * np.sqrt(np.abs(capped)), "result": np.sign(margin)}[target]


#: What a bank sums over games beside their number: a target and its cap, a soft result and its scale (0: the plain result), or the goals of a side.
Measure = tuple[str, float]


def measured(measure: Measure, hg: np.ndarray, ag: np.ndarray) -> np.ndarray:
    kind, number = measure
    if kind in ("home", "away"):
        return hg if kind == "home" else ag
    if kind == "soft":
        return 0.5 + 0.5 * (np.tanh((hg - ag) / number) if number else np.sign(hg - ag))
    return target_of({"target": kind, "cap": number}, hg - ag)


class Bank:
    """Games are counted once per half-life: ``design`` sums the products of the columns home - away and edge.

    ``learn`` takes games of a day, or with ``n`` rows that stand for so many equal games each; ``add`` takes a day's pairs of sides with their games n and
    the sums of the bank's ``measures`` over them (measures by pairs). A bank with ``ordered`` set needs every game, in order.
    """

    ordered = False

    def __init__(self, options: list[dict]) -> None:
        self.options, self.teams, self.day = options, 0, None
        needed = [self.measures_of(o) for o in options]
        self.measures: list[Measure] = list(dict.fromkeys(m for some in needed for m in some))
        #: the place of each option's first measure
        self.measure = np.array([self.measures.index(some[0]) if some else 0 for some in needed], int)
        self.lives = list(dict.fromkeys(o.get("half_life") or np.inf for o in options))
        self.life = np.array([self.lives.index(o.get("half_life") or np.inf) for o in options])

    def _faded(self, day: int) -> np.ndarray:
        """By half-life, what is left on this day of sums that were right on the day before it that was asked for."""
        out = 0.5 ** (0 if self.day is None else (day - self.day) / np.array(self.lives, float))
        self.day = day
        return np.broadcast_to(out, (len(self.lives),))

    def fade(self, day: int) -> None:
        """Sums as of the day."""

    def measures_of(self, options: dict) -> list[Measure]:
        return []

    def learn(self, h: np.ndarray, a: np.ndarray, hg: np.ndarray, ag: np.ndarray, day: int, n: np.ndarray | None = None) -> None:
        times = _times(h, n)
        self.add(h, a, times, np.array([measured(m, hg, ag) * times for m in self.measures]), day)

    def add(self, h: np.ndarray, a: np.ndarray, n: np.ndarray, sums: np.ndarray, day: int) -> None:
        raise NotImplementedError


def _rows(h: np.ndarray, a: np.ndarray, teams: int) -> np.ndarray:
    """Games by (teams: home less away, edge)."""
    out = np.zeros((len(h), teams + 1))
    out[np.arange(len(h)), h] += 1
    out[np.arange(len(a)), a] -= 1
    out[:, teams] = 1
    return out


def _times(h: np.ndarray, n: np.ndarray | None) -> np.ndarray:
    return np.ones(len(h)) if n is None else n.astype(float)


def _wider(x: np.ndarray, more: int, axes: int) -> np.ndarray:
    """Room for more teams before the last place (the edge) of the last ``axes`` axes."""
    for axis in range(x.ndim - axes, x.ndim):
        x = np.insert(x, [x.shape[axis] - 1] * more, 0.0, axis=axis)
    return x


class Massey(Bank):
    """Ridge least squares of targets of margins: a rating per team, drawn to its prior, and the home edge."""

    def __init__(self, options: list[dict]) -> None:
        super().__init__(options)
        self.left, self.right = np.zeros((len(self.lives), 1, 1)), np.zeros((len(options), 1))
        # options that share half-life and ridge share a matrix
        systems = [(int(life), float(o["ridge"])) for life, o in zip(self.life, options, strict=True)]
        self.systems = list(dict.fromkeys(systems))
        self.system = np.array([self.systems.index(s) for s in systems])
        self.slot = np.array([int((self.system[:i] == s).sum()) for i, s in enumerate(self.system)])

    def measures_of(self, options: dict) -> list[Measure]:
        return [(options.get("target", "margin"), options.get("cap", np.inf))]

    def grow(self, last: np.ndarray, outside: np.ndarray) -> None:
        more, self.teams = len(last) - self.teams, len(last)
        self.left, self.right = _wider(self.left, more, 2), _wider(self.right, more, 1)
        self.prior = np.array([prior_of(last, outside, o) for o in self.options])

    def fade(self, day: int) -> None:
        faded = self._faded(day)
        self.left, self.right = self.left * faded[:, None, None], self.right * faded[self.life][:, None]

    def add(self, h: np.ndarray, a: np.ndarray, n: np.ndarray, sums: np.ndarray, day: int) -> None:
        self.fade(day)
        x = _rows(h, a, self.teams)
        self.left = self.left + x.T @ (x * n[:, None])
        self.right = self.right + (sums @ x)[self.measure]

    def solved(self) -> np.ndarray:
        """Options by (teams, edge)."""
        k = self.teams
        ridges = np.array([r for _, r in self.systems])
        left = self.left[[life for life, _ in self.systems]]
        left[:, np.arange(k), np.arange(k)] += ridges[:, None]
        left[:, k, k] += 1e-3
        right = self.right.copy()
        right[:, :k] += ridges[self.system][:, None] * self.prior
        stacked = np.zeros((len(self.systems), k + 1, int(self.slot.max()) + 1))
        stacked[self.system, :, self.slot] = right
        return np.linalg.solve(left, stacked)[self.system, :, self.slot]

    def expect(self, h: np.ndarray, a: np.ndarray, day: int) -> np.ndarray:
        self.fade(day)
        x = self.solved()
        return (x[:, h] - x[:, a] + x[:, -1:]).T


class Residual(Massey):
    """How far a team's last margins were above what today's fit expects of those games."""

    ordered = True

    def __init__(self, options: list[dict]) -> None:
        super().__init__(options)
        self.past: list[deque] = []

    def grow(self, last: np.ndarray, outside: np.ndarray) -> None:
        super().grow(last, outside)
        self.past += [deque(maxlen=max(o["last"] for o in self.options)) for _ in range(len(last) - len(self.past))]

    def learn(self, h: np.ndarray, a: np.ndarray, hg: np.ndarray, ag: np.ndarray, day: int, n: np.ndarray | None = None) -> None:
        super().learn(h, a, hg, ag, day)
        for home, away, margin in zip(h.tolist(), a.tolist(), (hg - ag).tolist(), strict=True):
            self.past[home].append((away, 1, margin))
            self.past[away].append((home, -1, -margin))

    def expect(self, h: np.ndarray, a: np.ndarray, day: int) -> np.ndarray:
        self.fade(day)
        x = self.solved()

        def over(team: int) -> list[float]:
            out = []
            for i, o in enumerate(self.options):
                own = list(self.past[team])[-o["last"] :]
                if not own:
                    out.append(0.0)
                    continue
                others, at_home, margins = (np.array(c, float) for c in zip(*own, strict=True))
                out.append(float((target_of(o, margins) - (x[i, team] - x[i, others.astype(int)] + at_home * x[i, -1])).mean()))
            return out

        # a team has one value a day, however many games it plays
        teams, place = np.unique(np.concatenate((h, a)), return_inverse=True)
        values = np.array([over(t) for t in teams.tolist()]).reshape(len(teams), len(self.options))[place]
        return values[: len(h)] - values[len(h) :]


class BradleyTerry(Bank):
    """Logistic ratings with a home edge; with ``soft`` the margin counts through a hyperbolic tangent."""

    def __init__(self, options: list[dict]) -> None:
        super().__init__(options)
        self.games, self.right = np.zeros((0, 0)), np.zeros((len(options), 1))
        self.ridges = np.array([float(o["ridge"]) for o in options])
        self.start = np.zeros((len(options), 1))

    def grow(self, last: np.ndarray, outside: np.ndarray) -> None:
        more, self.teams = len(last) - self.teams, len(last)
        self.games = np.pad(self.games, (0, more))
        self.right, self.start = _wider(self.right, more, 1), _wider(self.start, more, 1)

    def measures_of(self, options: dict) -> list[Measure]:
        return [("soft", float(options.get("soft") or 0))]

    def add(self, h: np.ndarray, a: np.ndarray, n: np.ndarray, sums: np.ndarray, day: int) -> None:
        np.add.at(self.games, (h, a), n)
        self.right += (sums @ _rows(h, a, self.teams))[self.measure]

    def solved(self) -> np.ndarray:
        k = self.teams
        pull = np.concatenate((np.tile(self.ridges[:, None], k), np.full((len(self.ridges), 1), 1e-3)), axis=1)

        def gradient(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-(x[:, :k, None] - x[:, None, :k] + x[:, k:, None])))
            expected = self.games * p
            side = np.concatenate((expected.sum(2) - expected.sum(1), expected.sum((1, 2))[:, None]), axis=1) - self.right + pull * x
            bent = self.games * np.maximum(p * (1 - p), 1e-9)
            both = bent + bent.transpose(0, 2, 1)
            square = np.zeros((len(x), k + 1, k + 1))
            square[:, :k, :k] = -both
            square[:, np.arange(k), np.arange(k)] += both.sum(2) + pull[:, :k]
            square[:, k, :k] = square[:, :k, k] = bent.sum(2) - bent.sum(1)
            square[:, k, k] = bent.sum((1, 2)) + 1e-3
            return side, square

        self.start = newton(gradient, self.start, 40, 2.0)
        return self.start

    def expect(self, h: np.ndarray, a: np.ndarray, day: int) -> np.ndarray:
        x = self.solved()
        return (x[:, h] - x[:, a] + x[:, -1:]).T


class Poisson(Bank):
    """Attack and defence of Poisson goals; the signal is the log-odds of a win, a tie counted one half."""

    def __init__(self, options: list[dict]) -> None:
        super().__init__(options)
        self.games = self.scored = self.let_in = np.zeros((len(self.lives), 0, 0))
        self.ridges = np.array([float(o["ridge"]) for o in options])
        self.start: np.ndarray | None = None

    def grow(self, last: np.ndarray, outside: np.ndarray) -> None:
        more, self.teams = len(last) - self.teams, len(last)
        self.games, self.scored, self.let_in = (np.pad(m, ((0, 0), (0, more), (0, more))) for m in (self.games, self.scored, self.let_in))
        self.start = None

    def measures_of(self, options: dict) -> list[Measure]:
        return [("home", 0.0), ("away", 0.0)]

    def add(self, h: np.ndarray, a: np.ndarray, n: np.ndarray, sums: np.ndarray, day: int) -> None:
        self.fade(day)
        day_sums = [np.zeros((self.teams, self.teams)) for _ in range(3)]
        for total, value in zip(day_sums, (n, *sums), strict=True):
            np.add.at(total, (h, a), value)
        self.games, self.scored, self.let_in = (old + new for old, new in zip((self.games, self.scored, self.let_in), day_sums, strict=True))

    def fade(self, day: int) -> None:
        faded = self._faded(day)[:, None, None]
        self.games, self.scored, self.let_in = (m * faded for m in (self.games, self.scored, self.let_in))

    def solved(self) -> np.ndarray:
        """Options by (attack by team, defence by team, mean, edge)."""
        k, n = self.teams, len(self.options)
        games, scored, let_in = (m[self.life] for m in (self.games, self.scored, self.let_in))
        pull = np.zeros((n, 2 * k + 2))
        pull[:, : 2 * k] = self.ridges[:, None]
        pull[:, -1] = 1e-3
        floor = pull.copy()
        floor[:, -2] = 1e-3
        at = np.arange(k)

        def gradient(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            attack, defence, mean, edge = x[:, :k], x[:, k : 2 * k], x[:, -2, None, None], x[:, -1, None, None]
            home = games * np.exp(attack[:, :, None] - defence[:, None, :] + mean + edge)
            away = games * np.exp(attack[:, None, :] - defence[:, :, None] + mean)
            over, over_away = home - scored, away - let_in
            side = np.concatenate((over.sum(2) + over_away.sum(1), -over.sum(1) - over_away.sum(2), (over.sum((1, 2)) + over_away.sum((1, 2)))[:, None], over.sum((1, 2))[:, None]), axis=1)
            made, lost = home.sum(2) + away.sum(1), home.sum(1) + away.sum(2)
            cross = -(home + away.transpose(0, 2, 1))
            square = np.zeros((n, 2 * k + 2, 2 * k + 2))
            square[:, at, at], square[:, k + at, k + at] = made, lost
            square[:, :k, k : 2 * k], square[:, k : 2 * k, :k] = cross, cross.transpose(0, 2, 1)
            square[:, -2, : 2 * k] = square[:, : 2 * k, -2] = np.concatenate((made, -lost), axis=1)
            square[:, -1, : 2 * k] = square[:, : 2 * k, -1] = np.concatenate((home.sum(2), -home.sum(1)), axis=1)
            whole = home.sum((1, 2))
            square[:, -2, -2] = whole + away.sum((1, 2))
            square[:, -1, -1] = square[:, -2, -1] = square[:, -1, -2] = whole
            places = np.arange(2 * k + 2)
            square[:, places, places] += floor
            return side + pull * x, square

        if self.start is None:
            self.start = np.zeros((n, 2 * k + 2))
            total = games.sum((1, 2))
            self.start[:, -2] = np.log(np.maximum(0.5, (scored.sum((1, 2)) + let_in.sum((1, 2))) / np.maximum(1.0, 2 * total)))
        self.start = newton(gradient, self.start, 40, 2.0)
        return self.start

    def expect(self, h: np.ndarray, a: np.ndarray, day: int) -> np.ndarray:
        from slate.operators.ratings import outcomes

        self.fade(day)
        k, x = self.teams, self.solved()
        home = np.exp(x[:, h] - x[:, k + a] + x[:, -2:-1] + x[:, -1:])
        away = np.exp(x[:, a] - x[:, k + h] + x[:, -2:-1])
        win, tie, _ = outcomes(home.ravel(), away.ravel())
        p = np.clip(win + tie / 2, 1e-6, 1 - 1e-6).reshape(home.shape)
        return np.log(p / (1 - p)).T


class Colley(Bank):
    """Colley's linear system of wins less losses, without a home edge."""

    def __init__(self, options: list[dict]) -> None:
        super().__init__(options)
        self.left, self.right = np.zeros((1, 1)), np.zeros(1)

    def grow(self, last: np.ndarray, outside: np.ndarray) -> None:
        more, self.teams = len(last) - self.teams, len(last)
        self.left, self.right = _wider(self.left, more, 2), _wider(self.right, more, 1)

    def measures_of(self, options: dict) -> list[Measure]:
        return [("result", 1.0)]

    def add(self, h: np.ndarray, a: np.ndarray, n: np.ndarray, sums: np.ndarray, day: int) -> None:
        x = _rows(h, a, self.teams)
        self.left = self.left + x.T @ (x * n[:, None])
        self.right = self.right + sums[0] / 2 @ x

    def solved(self) -> np.ndarray:
        k = self.teams
        return np.linalg.solve(self.left[:k, :k] + 2 * np.eye(k), 1 + self.right[:k])

    def expect(self, h: np.ndarray, a: np.ndarray, day: int) -> np.ndarray:
        x = self.solved()
        return np.repeat((x[h] - x[a])[:, None], len(self.options), axis=1)


class Schedule(Bank):
    """RPI: own share, opponents' share and their opponents' share, weighted; without ``weights`` the goal difference plus that of the opponents."""

    def __init__(self, options: list[dict]) -> None:
        super().__init__(options)
        self.met, self.own = np.zeros((0, 0)), np.zeros((len(options), 0))

    def grow(self, last: np.ndarray, outside: np.ndarray) -> None:
        more, self.teams = len(last) - self.teams, len(last)
        self.met, self.own = np.pad(self.met, (0, more)), np.pad(self.own, ((0, 0), (0, more)))

    def measures_of(self, options: dict) -> list[Measure]:
        return [("soft", 0.0) if "weights" in options else ("margin", options.get("cap", np.inf))]

    def add(self, h: np.ndarray, a: np.ndarray, n: np.ndarray, sums: np.ndarray, day: int) -> None:
        # a share of the away side is what the home side leaves, a margin is the home side's turned
        for one, other, sign in ((h, a, 1), (a, h, -1)):
            np.add.at(self.met, (one, other), n)
            for i, o in enumerate(self.options):
                own = sums[self.measure[i]]
                np.add.at(self.own[i], one, (n - own if sign < 0 else own) if "weights" in o else sign * own)

    def expect(self, h: np.ndarray, a: np.ndarray, day: int) -> np.ndarray:
        n = self.met.sum(1)
        out = []
        for o, total in zip(self.options, self.own, strict=True):
            weights = o.get("weights")
            mean = lambda x: np.where(n > 0, x / np.maximum(n, 1), 0.5 if weights else 0.0)  # noqa: B023, E731
            own = mean(total)
            second = mean(self.met @ own)
            x = own + second if weights is None else weights[0] * own + weights[1] * second + weights[2] * mean(self.met @ second)
            out.append(x[h] - x[a])
        return np.array(out).T


class Elo(Bank):
    """Elo points in game order; the signal is the home side's log-odds."""

    ordered = True

    def __init__(self, options: list[dict]) -> None:
        super().__init__(options)
        self.points = np.zeros((len(options), 0))
        self.k, self.edge = (np.array([float(o[c]) for o in options]) for c in ("k", "edge"))
        self.margins = np.array([o["margins"] for o in options])
        if set(self.margins.tolist()) - {"none", "log", "538"}:
            raise ValueError("margins are none, log or 538")

    def grow(self, last: np.ndarray, outside: np.ndarray) -> None:
        self.points = np.pad(self.points, ((0, 0), (0, len(last) - self.points.shape[1])))

    def gap(self, h: np.ndarray, a: np.ndarray) -> np.ndarray:
        return (self.points[:, h] - self.points[:, a] + self.edge[:, None]).T

    def expect(self, h: np.ndarray, a: np.ndarray, day: int) -> np.ndarray:
        return self.gap(h, a) / 400 * np.log(10)

    def learn(self, h: np.ndarray, a: np.ndarray, hg: np.ndarray, ag: np.ndarray, day: int, n: np.ndarray | None = None) -> None:
        # plain numbers, a pass for each option: a game is too little work for arrays. What depends on the margin alone is made once for each margin
        games = list(zip(h.tolist(), a.tolist(), (hg - ag).tolist(), strict=True))
        for i, (k, edge, margins) in enumerate(zip(self.k.tolist(), self.edge.tolist(), self.margins.tolist(), strict=True)):
            points = self.points[i].tolist()
            told = {m: (k * float(elo_size(m, np.asarray(margins))), 1.0 if m > 0 else 0.0 if m < 0 else 0.5, SLOPE if m >= 0 else -SLOPE) for m in {g[2] for g in games}}
            bent = margins == "538"
            for home, away, margin in games:
                size, won, slope = told[margin]
                gap = points[home] + edge - points[away]
                change = size * (won - 1 / (1 + 10 ** min(-gap / SCALE, 300.0)))
                if bent:
                    change *= FLAT / (gap * slope + FLAT)
                points[home] += change
                points[away] -= change
            self.points[i] = points


# The published Elo scale, and the margin multipliers "log" and "538".
SCALE, FLAT, EVEN, SLOPE = 400, 2.2, 0.5, 0.001
# End of the fixed values.


def elo_size(margin: float, margins: np.ndarray) -> np.ndarray:
    """The part of a change's size that the margin alone decides."""
    return np.where(margins == "none", 1.0, np.log(abs(margin) + 1) or EVEN)


def elo_bend(gap: np.ndarray, margin: float, bent: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` where the multiplier is not "538", else less for a favourite's win."""
    return np.where(bent, size * (FLAT / ((gap if margin >= 0 else -gap) * SLOPE + FLAT)), size)


def elo_change(gap: np.ndarray | float, margin: float, margins: np.ndarray | str) -> np.ndarray:
    """What a game moves the home side's points by, per unit of k. ``gap`` is the home side's lead, edge included."""
    gap, margins = np.asarray(gap, float), np.asarray(margins)
    size = elo_bend(gap, margin, margins == "538", elo_size(margin, margins))
    return size * ((np.sign(margin) + 1) / 2 - 1 / (1 + 10 ** (-gap / SCALE)))


class Kalman(Bank):
    """Strengths as random walks, seen through capped margins; place 0 is the home edge."""

    def __init__(self, options: list[dict]) -> None:
        super().__init__(options)
        self.drift, self.noise, self.start, self.cap = (np.array([float(o[c]) for o in options]) for c in ("drift", "noise", "start", "cap"))
        self.mean, self.cov = np.zeros((len(options), 1)), np.full((len(options), 1, 1), 0.25)

    def grow(self, last: np.ndarray, outside: np.ndarray) -> None:
        old, self.teams = self.teams, len(last)
        more = self.teams - old
        own = np.array([prior_of(last, outside, o)[old:] for o in self.options])
        known = ~(np.isnan(last) & np.isnan(outside))[old:]
        variance = np.array([np.where(known & ("prior" in o), o.get("prior_variance", 0.0), o["start"]) for o in self.options])
        self.mean = np.concatenate((self.mean, own), axis=1)
        self.cov = np.pad(self.cov, ((0, 0), (0, more), (0, more)))
        new = np.arange(old + 1, self.teams + 1)
        self.cov[:, new, new] = variance

    def expect(self, h: np.ndarray, a: np.ndarray, day: int) -> np.ndarray:
        return (self.mean[:, h + 1] - self.mean[:, a + 1] + self.mean[:, :1]).T

    def measures_of(self, options: dict) -> list[Measure]:
        return [("margin", float(options["cap"]))]

    def add(self, h: np.ndarray, a: np.ndarray, n: np.ndarray, sums: np.ndarray, day: int) -> None:
        if self.day is not None and day > self.day:
            at = np.arange(1, self.teams + 1)
            self.cov[:, at, at] += (self.drift * (day - self.day))[:, None]
        self.day = day
        seen = (sums / n)[self.measure]
        if len(h) > self.teams:
            self._learn_at_once(h, a, seen, n)
            return
        for g, (home, away, games) in enumerate(zip((h + 1).tolist(), (a + 1).tolist(), n.tolist(), strict=True)):
            gain = self.cov[:, :, home] - self.cov[:, :, away] + self.cov[:, :, 0]
            total = gain[:, home] - gain[:, away] + gain[:, 0] + self.noise / games
            short = seen[:, g] - self.mean[:, home] + self.mean[:, away] - self.mean[:, 0]
            self.mean += gain * (short / total)[:, None]
            self.cov -= gain[:, :, None] * (gain / total[:, None])[:, None, :]

    def _learn_at_once(self, h: np.ndarray, a: np.ndarray, seen: np.ndarray, times: np.ndarray) -> None:
        """The same update from the sums of a day: strengths do not move within it, so the order of its games is free."""
        x = np.roll(_rows(h, a, self.teams), 1, axis=1)
        counted = x * times[:, None]
        known, told = x.T @ counted / self.noise[:, None, None], seen @ counted / self.noise[:, None]
        told = told - (known @ self.mean[:, :, None])[:, :, 0]
        cov = np.linalg.solve(np.eye(self.teams + 1) + self.cov @ known, self.cov)
        self.cov = (cov + cov.transpose(0, 2, 1)) / 2
        self.mean = self.mean + (self.cov @ told[:, :, None])[:, :, 0]


BANKS: dict[str, type] = {"massey": Massey, "bradley_terry": BradleyTerry, "poisson": Poisson, "colley": Colley, "schedule": Schedule, "residual": Residual, "elo": Elo, "kalman": Kalman}


class League:
    """The banks of one group and the numbers of its teams."""

    def __init__(self, banks: list) -> None:  # noqa: ANN001
        self.banks = banks
        self.place: dict[int, int] = {}
        self.means: list[tuple[float, float]] = []
        self.games = 0

    def numbered(self, home: np.ndarray, away: np.ndarray, priors: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Team numbers of a day's games; new teams grow the banks. ``priors``: home last, home outside, away last, away outside."""
        size = len(self.place)
        none = np.full(2 * len(home), np.nan)
        last, outside = (none, none) if priors is None else (np.concatenate((priors[0], priors[2])), np.concatenate((priors[1], priors[3])))
        teams, first, at = np.unique(np.concatenate((home, away)), return_index=True, return_inverse=True)
        for place in np.sort(first).tolist():
            team = int(home[place] if place < len(home) else away[place - len(home)])
            if team not in self.place:
                self.place[team] = len(self.place)
                self.means.append((float(last[place]), float(outside[place])))
        if len(self.place) > size:
            for bank in self.banks:
                bank.grow(*np.array(self.means).T)
        numbers = np.array([self.place[t] for t in teams.tolist()], int)[at]
        return numbers[: len(home)], numbers[len(home) :]

    def day(self, columns: Columns) -> np.ndarray:
        """Signals of a day's games (day, home, away, goals and perhaps priors), games by options of all banks, which then learn the games."""
        values, _, place = self.pairings(columns)
        return values[place]

    def pairings(self, columns: Columns, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signals of a day's distinct pairs of sides, where each pair is met first, and every row's pair; the banks then learn the rows (``n``: games of a row)."""
        day, home, away, hg, ag, *priors = columns
        h, a = self.numbered(home, away, priors or None)
        _, first, place = np.unique(h * len(self.place) + a, return_index=True, return_inverse=True)
        values = np.concatenate([bank.expect(h[first], a[first], int(day[0])) for bank in self.banks], axis=1)
        self.learn(h, a, hg, ag, int(day[0]), n)
        return values, first, place

    def summed(self, day: int, home: np.ndarray, away: np.ndarray, priors: list[np.ndarray], n: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Signals of a day's distinct pairs of sides, whose n games the banks then learn; ``sums`` are those of the banks' measures in turn, measures by pairs."""
        h, a = self.numbered(home, away, priors)
        values = np.concatenate([bank.expect(h, a, day) for bank in self.banks], axis=1)
        at = 0
        for bank in self.banks:
            bank.add(h, a, n.astype(float), sums[at : at + len(bank.measures)], day)
            at += len(bank.measures)
        self.games += int(n.sum())
        return values

    def learn(self, h: np.ndarray, a: np.ndarray, hg: np.ndarray, ag: np.ndarray, day: int, n: np.ndarray | None = None) -> None:
        for bank in self.banks:
            bank.learn(h, a, hg, ag, day, n)
        self.games += int(_times(h, n).sum())


def in_order(games: DataFrame, group: str, *more: str) -> DataFrame:
    """(group, day, home, away, goals, game_id and ``more``), dealt by group and sorted by day and game, for a stream of days."""
    parts = int(games.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    goals = [F.col(c).cast("double").alias(c) for c in ("home_goals", "away_goals")]
    slim = games.select(F.col(group).cast("long").alias("league"), F.datediff("day", F.lit("1970-01-01")).alias("day"), F.col("home").cast("long"), F.col("away").cast("long"), *goals, "game_id", *more)
    return slim.repartition(parts, "league").sortWithinPartitions("league", "day", "game_id")


def through_days(ordered: DataFrame, make: Callable[[], list], schema: str, each: Callable[[League, Columns], list], last: Callable[[int, League], list] | None = None) -> DataFrame:
    """Runs ``each(league, columns of a day)`` on the days of ``in_order`` and ``last(group, league)`` at the end of a group; both give columns of the result."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, league = None, None
        for columns in whole_days(batches, 2):
            if columns[0][0] != at:
                if league is not None and last is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in last(int(at), league)], names=names)
                at, league = columns[0][0], League(make())
            made = each(league, columns)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=names)
        if league is not None and last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last(int(at), league)], names=names)

    return ordered.mapInArrow(run, schema)
