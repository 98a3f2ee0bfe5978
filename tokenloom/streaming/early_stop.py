"""Early stopping as keyed state over a stream of log points that may arrive in any order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tokenloom.operators.early_stop import EVALUATION, StopRule

STATE = ("losses array<double>, last_iteration bigint, furthest bigint, best double, best_at bigint, "
         "counter int, stopped boolean, late bigint")
STREAMED = EVALUATION + ", late_points bigint"
#: Regular points of one entry of the state store.
BLOCK_POINTS = 10_000


@dataclass(frozen=True)
class Arrival:
    """How long a run waits for points that are still missing.

    Where points are logged every ``log_interval`` iterations from ``first`` on, a point is walked as
    soon as all before it have been. Without a known interval it is walked at the end of its
    micro-batch, or, with a ``horizon``, once a point so many iterations further has arrived. The
    horizon also ends the wait for a regular point that is missing (None: never), and so does a time
    of ``idle_ms`` without new points of the run (None: never; such timers need a query that keeps
    running, as an ``availableNow`` one would wait for them without end). A point that arrives behind
    one that was walked is late: it is counted, not walked.
    """

    log_interval: int | None = None
    first: int = 0
    horizon: int | None = None
    idle_ms: int | None = None


def _stopper(rule: StopRule, arrival: Arrival, report_late: bool) -> StatefulProcessor:
    """The state machine of one run: last losses, best mean, counter, stop flag and waiting points.

    The classes are local so that they travel by value: the process that prepares a stateful
    query on the driver does not see files shipped to the workers.
    """
    span = BLOCK_POINTS * (arrival.log_interval or 100)
    every, patience, limit, min_delta = rule.checkpoint_interval, rule.patience, rule.limit, rule.min_delta
    interval, first, horizon, idle = arrival.log_interval, arrival.first, arrival.horizon, arrival.idle_ms
    state_schema = STATE
    names = [c.split()[0] for c in STREAMED.split(", ")]

    class Waiting:
        """Waiting points in sorted arrays, each at least twice as long as the next, and the blocks that changed."""

        def __init__(self) -> None:
            self.parts: list[list] = []
            self.changed: set[int] = set()

        def add(self, at: np.ndarray, losses: np.ndarray) -> None:
            self.parts.append([at, losses, 0])
            while len(self.parts) > 1 and len(self.parts[-2][0]) < 2 * len(self.parts[-1][0]):
                rest = [[a[i:], x[i:]] for a, x, i in (self.parts.pop(), self.parts.pop())]
                at, losses = (np.concatenate(c) for c in zip(*rest))
                order = np.argsort(at, kind="stable")
                self.parts.append([at[order], losses[order], 0])

        def has(self, at: np.ndarray) -> np.ndarray:
            found = np.zeros(len(at), bool)
            for known, _, _ in self.parts:
                if len(known):
                    found |= known[np.minimum(np.searchsorted(known, at), len(known) - 1)] == at
            return found

        def first(self) -> int | None:
            return min((int(at[i]) for at, _, i in self.parts if i < len(at)), default=None)

        def pop(self) -> float:
            part = min((p for p in self.parts if p[2] < len(p[0])), key=lambda p: p[0][p[2]])
            at, losses, i = part
            part[2] += 1
            self.changed.add(int(at[i]) // span)
            return float(losses[i])

        def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
            """Points of a block that still wait."""
            found = []
            for at, losses, i in self.parts:
                low, high = np.searchsorted(at, [number * span, (number + 1) * span])
                found.append((at[max(low, i):max(high, i)], losses[max(low, i):max(high, i)]))
            at, losses = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(at, kind="stable")
            return at[order], losses[order]

    class Stopper(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("stop", state_schema)
            #: Points that wait for earlier ones, in blocks of neighbours: an entry for each point took a call
            #: to the store to put, to get and to remove it.
            self.waiting = handle.getMapState("waiting", "block bigint", "iterations binary, losses binary")

        def _load(self) -> None:
            (self.losses, self.seen, self.furthest, self.best, self.best_at, self.counter, self.stopped, self.late) = (
                self.state.get() if self.state.exists() else ([], -1, -1, float("inf"), None, 0, False, 0))
            self.losses, self.points = list(self.losses), Waiting()
            self.stored = [k[0] for k in self.waiting.keys()] if not self.stopped and self.waiting.exists() else []
            for block in self.stored:
                at, losses = self.waiting.getValue((block,))
                self.points.add(np.frombuffer(bytes(at), np.int64), np.frombuffer(bytes(losses), np.float64))

        def _save(self) -> None:
            for block in () if self.stopped else sorted(self.points.changed):
                at, losses = self.points.block(block)
                if len(at):
                    self.waiting.updateValue((block,), (at.tobytes(), losses.tobytes()))
                elif block in self.stored:
                    self.waiting.removeKey((block,))
            self.state.update((self.losses, self.seen, self.furthest, self.best, self.best_at, self.counter, self.stopped, self.late))

        def _next(self) -> int:
            return first if self.seen < 0 else self.seen + interval

        def _due(self, at: int) -> bool:
            """No regular point is missing before this one, or the wait for it is over."""
            if interval is not None and at <= self._next():
                return True
            return self.furthest - at >= horizon if horizon is not None else interval is None

        def _walk(self, run, at: int, loss, out: list) -> None:
            # Checkpoints between two logged points see the losses before the second one.
            due = [] if self.seen < 0 else list(range((self.seen // every + 1) * every, at, every))
            for checkpoint in [*due, at]:
                if checkpoint == at:
                    self.losses, self.seen = [*self.losses, loss][-patience:], at
                    if at % every:
                        continue
                if len(self.losses) < patience or any(x is None for x in self.losses):
                    continue
                # Plain left-to-right addition, as a window sum adds.
                mean = reduce(add, self.losses) / patience
                improved = mean < self.best - min_delta
                self.best, self.best_at, self.counter = (
                    (mean, checkpoint, 0) if improved else (self.best, self.best_at, self.counter + 1))
                self.stopped = self.counter >= limit
                out.append((run, checkpoint, mean, improved, self.best, self.best_at, self.counter, self.stopped, self.late))
                if self.stopped:
                    self.waiting.clear()
                    return

        def _release(self, run, out: list, all_: bool = False) -> None:
            """Walk waiting points in order as far as they are due."""
            while not self.stopped and (at := self.points.first()) is not None and (all_ or at <= self.seen or self._due(at)):
                loss = self.points.pop()
                if at <= self.seen:
                    self._count_late(run, at, out)
                else:
                    self._walk(run, at, loss, out)

        def _count_late(self, run, at: int, out: list) -> None:
            self.late += 1
            if report_late:
                out.append((run, at, None, None, None, None, None, None, self.late))

        def _frame(self, out: list) -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=names)
            return frame.astype({"best_iteration": "Int64", "counter": "Int32", "improved": "boolean", "stopped": "boolean"})

        def handleInputRows(self, key, rows, timerValues):
            self._load()
            run, out = key[0], []
            for batch in rows:
                if self.stopped:
                    continue
                ready = batch.dropna(subset=["iteration"]).sort_values("iteration", kind="stable")
                iterations, early = ready["iteration"].to_numpy(np.int64), {}
                for at, loss, waits in zip(iterations.tolist(), ready["loss"].tolist(), self.points.has(iterations).tolist()):
                    if self.stopped:
                        break
                    self.furthest = max(self.furthest, at)
                    if at <= self.seen or waits or at in early:
                        self._count_late(run, at, out)
                    elif interval is not None and at <= self._next():
                        # The next regular point needs no place in the state.
                        self._walk(run, at, loss, out)
                    else:
                        early[at] = loss
                if early and not self.stopped:
                    added = np.fromiter(early, np.int64, len(early))
                    self.points.add(added, np.fromiter(early.values(), np.float64, len(early)))
                    self.points.changed.update(np.unique(added // span).tolist())
                if interval is not None:
                    self._release(run, out)
                if out:
                    yield self._frame(out)
                    out = []
            self._release(run, out)
            if out:
                yield self._frame(out)
            self._save()
            if idle is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                if not self.stopped and self.points.first() is not None:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self._load()
            out: list = []
            self._release(key[0], out, all_=True)
            self._save()
            if out:
                yield self._frame(out)

        def close(self) -> None:
            pass

    return Stopper()


def stream_early_stopping(points: DataFrame, rule: StopRule = StopRule(), arrival: Arrival = Arrival(),
                          report_late: bool = False) -> DataFrame:
    """Evaluations of every run as its points arrive, with ``late_points``: late points so far.

    A run's state is ``patience`` losses, some numbers and the points that wait for earlier ones,
    which are kept in the state store in blocks of neighbours. While a run's rows of a micro-batch are
    taken, one Arrow batch after the other, its waiting points are in memory, at 16 bytes each. A point whose iteration was walked, or waits already, is late.
    With ``report_late`` every late point is a row of its own too, with its iteration and without
    an evaluation. Points without an iteration are ignored, as are all after a stop. Needs the
    RocksDB state store.
    """
    return (points.select("run", "iteration", "loss").groupBy("run")
            .transformWithStateInPandas(statefulProcessor=_stopper(rule, arrival, report_late), outputStructType=STREAMED,
                                        outputMode="Append", timeMode="None" if arrival.idle_ms is None else "ProcessingTime"))
