"""Leak-free replay of a strategy, and the rating strategies.

A strategy is an object with ``predict(row) -> tuple of floats or None`` and ``observe(row)``. Groups are independent
and run in parallel. Within a group every match is two events, its decision at the decision instant and its result at
the instant it is known; events run in the order of instant, kind (decisions first) and match, so a decision sees just
the results known before it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeaxis as T


#: Kinds of events.
RESULT, DECISION, NONE = 0, 1, 2


class Strategy(Protocol):
    def predict(self, row) -> tuple | None: ...

    def observe(self, row) -> None: ...


def replay(matches: DataFrame, make: Callable[..., Strategy], names: list[str], params: list[str] = (), group: str = "grp", carry: list[str] = (), events: bool = False) -> DataFrame:
    """``matches`` with ``decided``, whether a decision falls before the kick-off, and the columns ``names`` of each
    decision (null without one, or if the strategy makes none). ``make`` gets the values of the ``params`` columns,
    which belong to the group; the columns ``carry`` are kept beside. A table without ``kickoff`` is one of unknown kick-offs.

    Spark sorts the events of a group, spilling as it must, and a task walks over them in batches, so that it holds a
    strategy's state and one batch, however long the group. With ``events`` the strategy takes a batch's events at once, by
    its ``walk(events)``, as tuples (kind, home, away, day number, goal difference), and gives what it predicts for each
    decision; a kind is ``RESULT``, ``DECISION`` or ``NONE``, a decision that doesn't fall before the kick-off."""
    keep = ["match_id", "match_date", "home", "away", "home_goals", "away_goals"]
    keys = [group, *params]
    kickoff = matches["kickoff"] if "kickoff" in matches.columns else F.lit(None).cast("timestamp")
    day = matches["match_date"]
    at, known = F.unix_timestamp(T.decision_at(day, kickoff)), F.unix_timestamp(T.result_known_at(day, kickoff))
    event = lambda result, at: F.struct(F.lit(result).alias("_result"), at.alias("_at"))
    x = matches.select(*keys, *keep, *carry, F.unix_timestamp(kickoff).alias("_start"), at.isNotNull().alias("decided"), F.explode(F.array(event(False, at), event(True, known))).alias("_e"))
    x = x.select(*keys, *keep, *carry, "decided", "_start", "_e._result", "_e._at")
    if events:  # day numbers: dates would become objects, which are slow to move and to compare
        x = x.withColumn("match_date", F.unix_date("match_date"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in matches.select(*keys, *keep, *carry).schema), "decided boolean", *(f"{n} double" for n in names)])
    none = (None,) * len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, strategy = None, None
        for pdf in batches:
            found = []
            who = zip(*(pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in keys), strict=True)  # a null is a group too
            for one, result, decided, row in zip(who, pdf["_result"].tolist(), pdf["decided"].tolist(), pdf[keep].itertuples(index=False), strict=True):
                if one != now:
                    now, strategy = one, make(*one[1:])
                if result:
                    strategy.observe(row)
                else:
                    found.append((strategy.predict(row) or none) if decided else none)
            out = pdf.loc[~pdf["_result"], [*keys, *keep, *carry, "decided"]].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(found, columns=names, dtype=float)], axis=1)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, strategy = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            codes = [pd.factorize(pdf[c], use_na_sentinel=False)[0] for c in keys]  # a null is a group too
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1).tolist(), len(pdf)]
            kind = np.where(pdf["_result"], RESULT, np.where(pdf["decided"], DECISION, NONE))
            rows = list(zip(kind.tolist(), pdf["home"].tolist(), pdf["away"].tolist(), pdf["match_date"].tolist(), (pdf["home_goals"] - pdf["away_goals"]).tolist(), strict=True))
            found = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                one = tuple(None if pd.isna(v) else v for c in keys for v in pdf[c].iloc[a: a + 1].tolist())
                if one != now:
                    now, strategy = one, make(*one[1:])
                found += strategy.walk(rows[a:b])
            out = pdf.loc[~pdf["_result"], [*keys, *keep, *carry, "decided"]].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(found, columns=names, dtype=float)], axis=1)

    # Small rows, dear groups: by default few groups would meet in few tasks.
    x = x.repartition(4 * matches.sparkSession.sparkContext.defaultParallelism, *keys)
    order = [F.col("_at").asc_nulls_last(), "_result", F.col("match_date").asc_nulls_first(), F.col("_start").asc_nulls_first(), "match_id"]
    x = x.sortWithinPartitions(*keys, *order)
    if not events:
        return x.mapInPandas(run, schema)
    numbered = schema.replace("match_date date", "match_date int", 1)
    return x.mapInPandas(walk, numbered).withColumn("match_date", F.date_from_unix_date("match_date"))


class SeenResults:
    """Logs instead of forecasting: how many results a decision has seen."""

    def __init__(self) -> None:
        self.n = 0

    def predict(self, row) -> tuple:
        return (float(self.n),)

    def observe(self, row) -> None:
        self.n += 1


class Elo:
    """Ratings with home advantage and goal margin; after a long gap a rating returns towards its group's mean, and a
    newcomer begins below it. Predicts both ratings and the home expectation."""

    def __init__(self, k: float = 20.0, home: float = 60.0, margin: str = "none", regress: float = 0.2, newcomer: float = 50.0, gap_days: int = 60, initial: float = 1500.0):
        self.k, self.home, self.margin, self.regress, self.newcomer, self.gap_days, self.initial = k, home, margin, regress, newcomer, gap_days, initial
        self.ratings, self.seen, self.sum = {}, {}, 0.0

    def _mean(self) -> float:
        return self.sum / len(self.ratings) if self.ratings else self.initial

    def _now(self, team, day) -> float:
        if team not in self.ratings:
            return self._mean() - self.newcomer
        r = self.ratings[team]
        return r + self.regress * (self._mean() - r) if (day - self.seen[team]).days > self.gap_days else r

    def _both(self, row) -> tuple[float, float, float]:
        h, a = self._now(row.home, row.match_date), self._now(row.away, row.match_date)
        return h, a, 1.0 / (1.0 + 10.0 ** (-(h + self.home - a) / 400.0))

    def predict(self, row) -> tuple:
        return self._both(row)

    def _move(self, goals) -> tuple[float, float]:
        """The weight of a goal difference, and what the home side has from it."""
        far = max(abs(goals), 1)
        factor = {"none": 1.0, "linear": 1.0 + (far - 1) * 0.5, "log": 1.0 + math.log(far)}[self.margin]
        return self.k * factor, (goals > 0) + 0.5 * (goals == 0)

    def walk(self, events: list[tuple]) -> list[tuple]:
        """``predict`` and ``observe`` of event after event, in one loop over plain values."""
        ratings, seen, total, moves, out = self.ratings, self.seen, self.sum, {}, []
        home_edge, regress, newcomer, gap_days, initial = self.home, self.regress, self.newcomer, self.gap_days, self.initial
        for kind, i, j, day, goals in events:
            if kind == NONE:
                out.append((None, None, None))
                continue
            h, a = ratings.get(i), ratings.get(j)
            if h is None:
                h = (total / len(ratings) if ratings else initial) - newcomer
            elif day - seen[i] > gap_days:
                h += regress * (total / len(ratings) - h)
            if a is None:
                a = (total / len(ratings) if ratings else initial) - newcomer
            elif day - seen[j] > gap_days:
                a += regress * (total / len(ratings) - a)
            e = 1.0 / (1.0 + 10.0 ** (-(h + home_edge - a) / 400.0))
            if kind == DECISION:
                out.append((h, a, e))
                continue
            move = moves.get(goals)
            if move is None:
                move = moves[goals] = self._move(goals)
            change = move[0] * (move[1] - e)
            h, a = h + change, a - change
            total += h - ratings.get(i, 0.0)
            ratings[i], seen[i] = h, day
            total += a - ratings.get(j, 0.0)
            ratings[j], seen[j] = a, day
        self.sum = total
        return out

    def observe(self, row) -> None:
        h, a, e = self._both(row)
        weight, score = self._move(row.home_goals - row.away_goals)
        change = weight * (score - e)
        for team, value in ((row.home, h + change), (row.away, a - change)):
            self.sum += value - self.ratings.get(team, 0.0)
            self.ratings[team], self.seen[team] = value, row.match_date


class Elos:
    """Several ratings side by side over the same events: the home expectation of each."""

    def __init__(self, configs: list[dict]):
        self.each = [Elo(**c) for c in configs]

    def walk(self, events: list[tuple]) -> list[tuple]:
        return list(zip(*([e for _, _, e in one.walk(events)] for one in self.each), strict=True))


class Scaffold(Elo):
    """The rating that fitted ones are judged against: nothing is fitted, teams don't return towards a mean."""

    def __init__(self):
        super().__init__(margin="linear", regress=0.0, newcomer=0.0)


def quadratic_draw(e: Column, draw: Column) -> Column:
    """(home, draw, away) from a home expectation: a draw takes 4 draw e (1 - e), half from each side."""
    tie = draw * 4.0 * e * (1.0 - e)
    return F.array(e - tie / 2.0, tie, 1.0 - e - tie / 2.0)


def ordered_draw(e: Column, scale: Column, cut: Column, clip: float = 1e-6) -> Column:
    """(home, draw, away) of an ordered logit with cuts at +-cut."""
    c = F.greatest(F.least(e, F.lit(1 - clip)), F.lit(clip))
    eta = scale * F.log(c / (1.0 - c))
    home, away = 1.0 / (1.0 + F.exp(cut - eta)), 1.0 / (1.0 + F.exp(cut + eta))
    return F.array(home, 1.0 - home - away, away)
