"""Live scores: one row for each arriving event, with the state of its run kept by Spark.

Runs are dealt into buckets, each of which is one key of the stream. A batch's
events of a bucket are taken step by step: the next event of all its runs at
once, since a numpy call costs as much for one run as for many.

A run's state has two parts. What has a fixed size (counts, the last two rows
of the edit tables, what each reference shares with the run, verdicts) is one
binary row. What grows with the run (labels, n-grams and fingerprints that the
bank does not have) stands in the run's row while it is little, and else in a
map in the state store, of which an event reads and writes the few entries it
touches; so a run costs the same for each event, however long it is and however
its events are cut into batches.

Events of a run are taken in the order of (ts, event_id) within a
micro-batch; an event that is older than the last one scored is late: it is
dropped and counted. With `expire_ms`, for queries that go on, state goes that
long after a run's last event; without it a query may stop when all is read.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.baselines import START as CONTEXT
from ..operators.distances import bounded
from ..operators.structure import START
from .monitors import PAIR, Monitors, count, jaccard, shared, signature

#: Scores of each event, in the order of the output's columns.
SCORES = (
    "edit_knn", "edit_full_knn", "edit_trunc_knn", "jaccard_knn", "jaccard_prefix_knn", "containment_min", "ngram2_jaccard_knn", "ngram2_jaccard_prefix_knn", "ngram3_jaccard_knn", "cosine_knn",
    "return_rate", "edge_novelty", "cycle_resid", "cycle_absz", "edge_absz", "df_legality", "graph_progress", "dfg_fitness", "ngram0", "ngram1", "step_surprisal",
    "step_count", "error_rate", "error_count", "repeat_rate", "empty_rate", "policy_count", "dcl_viol", "dcl_div",
)
OUTPUT = "run_id string, pos int, act string, " + "".join(f"{c} double, " for c in SCORES) + "late long"
SEPARATOR = "\x1f"
#: Keys of the stream; runs find their state by them, so a query keeps the number it started with.
BUCKETS = 1024
#: Keys that a run's row holds at most.
FEW = 256
#: Cells of the edit tables that a task works on at once.
MOST_CELLS = 250_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30.0, 30.0)))


class Seen:
    """Keys that a run has had and the bank hasn't, with how often.

    Up to FEW stand in the run's row (`few`), others in a map in the state
    store, where they were `moved`. What a batch has read it does not read again.
    """

    def __init__(self, grown: Any, run: str, few: dict[str, int], moved: bool) -> None:
        self.grown, self.run, self.few, self.moved = grown, run, few, moved
        self.known: dict[str, int] = {}

    def times(self, key: str) -> int:
        if key in self.few:
            return self.few[key]
        if not self.moved:
            return 0
        if key not in self.known:
            self.known[key] = self.grown.getValue((self.run, key))[0] if self.grown.containsKey((self.run, key)) else 0
        return self.known[key]

    def add(self, key: str) -> int:
        """Count the key once more; how often it was there before."""
        before = self.times(key)
        self.few[key] = before + 1
        return before

    def note(self, key: str) -> bool:
        """Make sure that the key is there; whether it is new."""
        return not self.times(key) and self.add(key) == 0

    def kept(self) -> tuple[str, bool]:
        """What the run's row holds, after the batch."""
        if len(self.few) > FEW:
            for key, times in self.few.items():
                self.grown.updateValue((self.run, key), (times,))
            self.few, self.moved = {}, True
        return json.dumps(self.few), self.moved


def _of_steps(values: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (n - 1, at least 1e-6) at each step over runs."""
    steps = max(map(len, values), default=0)
    at = [np.array([v[i] for v in values if len(v) > i]) for i in range(steps)]
    return np.array([v.mean(axis=0) for v in at]), np.array([np.maximum(v.std(axis=0, ddof=1) if len(v) > 1 else np.zeros_like(v[0]), 1e-6) for v in at])


class Shared:
    """What the bank's n-grams of one order share with a run: places of first occurrence, reference by reference."""

    def __init__(self, bank: list[list[str]], n: int) -> None:
        grams = [[SEPARATOR.join(r[i - n + 1 : i + 1]) if i >= n - 1 else None for i in range(len(r))] for r in bank]
        self.number = {g: i for i, g in enumerate(sorted({g for r in grams for g in r if g is not None}))}
        self.first = np.zeros((len(self.number) + 1, len(bank)), np.int64)  # the last row is for grams that the bank doesn't have
        steps = max(map(len, bank), default=0)
        self.fresh = np.full((steps + 1, len(bank)), -1, np.int64)  # the gram that is new in a reference at a step; none after the last
        for j, r in enumerate(grams):
            for i, g in enumerate(r):
                if g is not None and not self.first[self.number[g], j]:
                    self.first[self.number[g], j] = i + 1
                    self.fresh[i, j] = self.number[g]
        self.upto = np.concatenate([np.zeros((1, len(bank)), np.int64), np.cumsum(self.fresh[:steps] >= 0, axis=0)])

    def fields(self, n: int) -> list[tuple]:
        return [(f"seen{n}", "?", (len(self.number),)), (f"mine{n}", "i8"), (f"whole{n}", "i8", (self.first.shape[1],)), (f"prefix{n}", "i8", (self.first.shape[1],))]

    def push(self, s: dict[str, np.ndarray], n: int, gram: np.ndarray, strange: np.ndarray, step: np.ndarray) -> None:
        """Take the gram of each run that ends at its `step` (from 1); -1: none that the bank has, `strange` if the run hadn't had it."""
        rows, seen = np.arange(len(gram)), s[f"seen{n}"]
        if not len(self.number):
            s[f"mine{n}"] += strange
            return
        theirs = self.fresh[np.minimum(step, len(self.fresh)) - 1]  # the references' new grams that the run has had before
        s[f"prefix{n}"] += seen[rows[:, None], theirs] & (theirs >= 0)
        known = gram >= 0
        new = known & ~seen[rows, gram]
        seen[rows[new], gram[new]] = True
        first = self.first[np.where(new, gram, -1)]
        s[f"whole{n}"] += first > 0
        s[f"prefix{n}"] += (first > 0) & (first <= step[:, None])
        s[f"mine{n}"] += new | strange

    def jaccard(self, s: dict[str, np.ndarray], n: int, step: np.ndarray | None = None) -> np.ndarray:
        """To whole references, or to their first `step` events."""
        both, theirs = (s[f"whole{n}"], self.upto[-1]) if step is None else (s[f"prefix{n}"], self.upto[np.minimum(step, len(self.upto) - 1)])
        mine = s[f"mine{n}"][:, None]
        return np.where(mine > 0, 1 - both / np.maximum(1, mine + theirs - both), 0.0)


#: What the events of a batch say before they are taken step by step, and the value of places without one.
TOLD = ("run", "code", "before", "context", "g1", "g2", "g3", "new1", "new2", "new3", "times", "left", "rule", "rule_before", "turn", "tool", "error", "errors", "again", "empty", "policy", "late")


class Bank:
    """What a processor knows of the bank and the model, and the state of a run as one numpy record."""

    def __init__(self, bank: list[list[str]], constraints: list[tuple], kappa: int) -> None:
        self.kappa, self.k = kappa, len(bank)
        self.shared = {n: Shared(bank, n) for n in (1, 2, 3)}
        self.names = self.shared[1].number
        self.lengths = np.array([len(r) for r in bank], np.int64)
        self.width = int(max(self.lengths, default=0))
        self.refs = np.full((self.k, self.width), -1, np.int32)
        for j, r in enumerate(bank):
            self.refs[j, : len(r)] = [self.names[a] for a in r]
        labels = len(self.names)
        self.counts = np.zeros((labels + 1, self.k), np.int64)  # the last row is for labels that the bank doesn't have
        for j, r in enumerate(bank):
            for a in r:
                self.counts[self.names[a], j] += 1
        self.norms = (self.counts**2).sum(axis=0)
        # a smoothed model of the bank, without and with the label before: surprisal by code, contexts none (the last) and unknown (before it)
        once, after = Counter(a for r in bank for a in r), Counter((p, a) for r in bank for p, a in zip([CONTEXT, *r], r))
        contexts = Counter(p for r in bank for p in [CONTEXT, *r][:-1])
        named, v = [*self.names, None], len(once) + 1
        surprisal = lambda seen, total: -math.log((seen + 0.5) / (total + 0.5 * v) if total else 1 / v)
        self.once = np.array([surprisal(once[a], once.total()) for a in named])
        self.after = np.array([[surprisal(after[p, a], contexts[p]) for a in named] for p in [*named, CONTEXT]])
        places: dict[str, list[int]] = {}
        for r in bank:
            for i, a in enumerate(r):
                places.setdefault(a, []).append(i + 1)
        self.mean_place = np.array([sum(places[a]) / len(places[a]) for a in self.names] + [0.0])
        graph: dict[str, set[str]] = {}
        for r in bank:
            for p, a in zip([START, *r], r):
                graph.setdefault(a, set()).add(p)
        # of marked ones the smallest gives its token; the start's is the last but one, nothing marks the last
        self.sources = np.full((labels + 1, max(map(len, graph.values()), default=1)), labels + 1, np.int64)
        for a, p in graph.items():
            self.sources[self.names[a], : len(p)] = [self.names.get(x, labels) for x in sorted(p)]
        self.monitors = Monitors(constraints)
        self.record = np.dtype([
            ("n", "i8"), ("now", "i4", (self.k, self.width + 1)), ("before", "i4", (self.k, self.width + 1)), *[f for n, x in self.shared.items() for f in x.fields(n)],
            ("dot", "i8", (self.k,)), ("norm", "i8"), ("times", "i8", (labels + 1,)), ("left", "?", (labels + 1,)), ("marks", "i8", (labels + 2,)), ("missing", "i8"), ("back", "i8"), ("strange", "i8"), ("nll", "f8", (2,)),
            *[(c, "i8") for c in ("tool", "error", "errors", "again", "empty", "policy", "late")], ("pairs", PAIR, (len(self.monitors.pairs),)), ("verdicts", "u1", (self.monitors.size,)), ("active", "?", (self.monitors.size,)),
        ])
        self.plain: dict[tuple[str, str, str], tuple[int, ...]] = {}
        self._replay(bank)

    def start(self, runs: int) -> np.ndarray:
        s = np.zeros(runs, self.record)
        s["now"] = np.arange(self.width + 1)
        s["marks"][:, -2] = 1  # the start's token
        s["pairs"] = self.monitors.start()
        return s

    def _replay(self, bank: list[list[str]]) -> None:
        """Of each step of the references: walk features and surprisal so far over all, signatures one by one."""
        order = np.argsort(-self.lengths, kind="stable")
        told = []
        for row, j in enumerate(order):
            last = [None, None]
            told += [(row, *self.tell(a, last, None), *(0,) * 7) for a in bank[j]]
        self.signatures = np.zeros((self.width, self.k, 3, self.monitors.words), np.uint64)
        walks, totals = ([[] for _ in bank] for _ in range(2))
        s, events = self.opened(self.start(self.k)), _stepwise(told, self.k)
        for i in range(self.width):
            now = self.step(s, events, i)
            walk = np.stack(self.walk(now), axis=1)
            signed = signature(now["verdicts"], now["active"]) if self.monitors.size else None
            for row, j in enumerate(order[: len(walk)]):
                walks[j].append(walk[row])
                totals[j].append(now["nll"][row, 1].copy())
                if signed is not None:
                    self.signatures[i, j] = signed[row]
        self.profile, self.totals = _of_steps(walks), _of_steps(totals)

    def tell(self, act: str, last: list[str | None], rest: Seen | None) -> tuple[int, ...]:
        """What an event says of labels; `last` has the two labels before, `rest` keeps what the bank doesn't have."""
        (before, earlier), names = last, self.names
        last[:] = [act, before]
        if (plain := self.plain.get((earlier, before, act))) is not None:
            return plain
        code, was = names.get(act, -1), names.get(before, -1)
        if before is not None and before != act and was < 0:
            rest.note(f"l{before}")
        grams, new = [code, -1, -1], [0, 0, 0]
        if before is not None:
            two = SEPARATOR.join((before, act))
            grams[1] = self.shared[2].number.get(two, -1)
            if grams[1] < 0:
                new[1] = rest.note(f"2{two}")
        if earlier is not None:
            three = SEPARATOR.join((earlier, before, act))
            grams[2] = self.shared[3].number.get(three, -1)
            if grams[2] < 0:
                new[2] = rest.note(f"3{three}")
        times = left = 0
        if code < 0:
            new[0] = rest.note(f"1{act}")
            times, left = rest.add(f"t{act}"), rest.times(f"l{act}") > 0
        turn = before is not None and before != act
        m = self.monitors
        values = (code, was, was if before else len(names) + 1, *grams, *new, times, left, m.code(act), m.code(before), turn)
        if earlier is not None and min(grams) >= 0:
            self.plain[earlier, before, act] = values  # no more than the bank has places
        return values

    def opened(self, held: np.ndarray) -> dict[str, np.ndarray]:
        """The fields of some runs' records, each in an array of its own."""
        return {c: np.ascontiguousarray(held[c]) for c in self.record.names}

    def step(self, state: dict[str, np.ndarray], events: dict[str, np.ndarray], i: int, tables: bool = False) -> dict[str, np.ndarray]:
        """Take event i of the runs that have it (the first ones) into their state, which is returned; with `tables` also into the edit tables."""
        n = int(np.count_nonzero(events["size"] > i))
        s = {c: x[:n] for c, x in state.items()}
        e = {c: x[:n, i] for c, x in events.items() if x.ndim == 2}
        rows, code, was = np.arange(n), e["code"], e["before"]
        if tables and self.k:
            self._edits(s, code, was)
        known = code >= 0
        turned = (e["turn"] > 0) & (was >= 0)
        s["left"][rows[turned], was[turned]] = True
        s["n"] += 1
        for k, x in self.shared.items():
            x.push(s, k, e[f"g{k}"], e[f"new{k}"] > 0, s["n"])
        times = np.where(known, s["times"][rows, code], e["times"])
        s["times"][rows[known], code[known]] += 1
        s["dot"] += self.counts[code]
        s["norm"] += 2 * times + 1
        s["back"] += np.where(known, s["left"][rows, code], e["left"] > 0)
        s["strange"] += (s["n"] > 1) & (e["g2"] < 0)
        s["nll"][:, 0] += self.once[code]
        s["nll"][:, 1] += self.after[np.where(e["context"] < 0, len(self.names), e["context"]), code]
        sources = self.sources[code]
        marked = s["marks"][rows[:, None], sources] > 0
        any_, source = marked.any(axis=1), sources[rows, marked.argmax(axis=1)]
        s["missing"] += ~any_
        s["marks"][rows[any_], source[any_]] -= 1
        s["marks"][rows[known], code[known]] += 1
        for c in ("tool", "error", "errors", "again", "empty", "policy", "late"):
            s[c] += e[c]
        if self.monitors.size:
            self.monitors.push_many(s["pairs"], s["verdicts"], s["active"], e["rule"], e["rule_before"], s["n"] - 1)
        return s

    def _edits(self, s: dict[str, np.ndarray], code: np.ndarray, was: np.ndarray) -> None:
        """One more row of each edit table; n is still the number of events before."""
        steps, now = np.arange(self.width + 1, dtype=np.int32), s["now"]
        other = self.refs != np.where(code < 0, -2, code)[:, None, None]
        base = np.empty_like(now)
        base[..., 0] = s["n"][:, None] + 1
        np.minimum(now[..., 1:] + 1, now[..., :-1] + other.astype(np.int32), out=base[..., 1:])
        if self.width > 1:
            apart = other[..., :-1] | (self.refs[:, 1:] != np.where(was < 0, -2, was)[:, None, None])
            # where labels aren't swapped, more than any row holds
            np.minimum(base[..., 2:], s["before"][..., :-2] + 1 + (apart.astype(np.int32) << 30), out=base[..., 2:])
        s["before"][:] = now
        base -= steps
        np.minimum.accumulate(base, axis=2, out=now)
        now += steps

    def near(self, d: np.ndarray) -> np.ndarray:
        """The kappa-th nearest of each run (row); 0 for an empty bank."""
        at = min(self.kappa, d.shape[1]) - 1
        return np.partition(d, at, axis=1)[:, at] if d.shape[1] else np.zeros(len(d))

    def walk(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Return rate and edge novelty."""
        n = s["n"]
        return s["back"] / n, np.where(n > 1, s["mine2"] / np.maximum(1, n - 1), 0.0)

    def scores(self, s: dict[str, np.ndarray], code: np.ndarray, step_cap: int) -> np.ndarray:
        """All scores (columns) of some runs after an event."""
        n, one, two, three = s["n"], self.shared[1], self.shared[2], self.shared[3]
        edits = np.zeros((3, len(n)))
        if self.k:
            row, m, at = s["now"], n[:, None], np.arange(self.k)
            inside = np.arange(self.width + 1) <= self.lengths[:, None]
            free = np.where(inside, row, 1 << 30).min(axis=2)
            whole, cut = row[:, at, self.lengths], np.take_along_axis(row, np.minimum(m, self.lengths)[..., None], axis=2)[..., 0]
            edits = [self.near(d) for d in (np.minimum(1.0, free / m), whole / np.maximum(m, self.lengths), np.minimum(1.0, cut / m))]
        cosine = np.where(self.norms > 0, 1 - s["dot"] / np.sqrt(np.maximum(1, self.norms) * s["norm"][:, None].astype(float)), 1.0)
        contained = (1 - s["whole1"] / s["mine1"][:, None]).min(axis=1) if self.k else np.zeros(len(n))
        walk, steps = self.walk(s), len(self.profile[0])
        mean, sd = (x[np.minimum(n, steps) - 1].T for x in self.profile) if steps else (np.zeros((2, 1)), np.ones((2, 1)))
        total, spread = (x[np.minimum(n, steps) - 1] for x in self.totals) if steps else (s["nll"][:, 1], 1.0)
        calls = np.maximum(1, s["tool"])
        violated, apart = np.zeros((2, len(n)))
        if self.monitors.size:
            violated = 1 - np.exp(-(s["verdicts"] == 0).sum(axis=1) / 8)
            some = np.flatnonzero(self.lengths)
            mine, theirs = signature(s["verdicts"], s["active"])[:, None], self.signatures[np.minimum(n[:, None], self.lengths[some]) - 1, some]
            apart = self.near(jaccard(count(shared(mine, theirs)), count(mine[..., 0, :]), count(theirs[..., 0, :])))
        return np.stack([
            *edits, self.near(one.jaccard(s, 1)), self.near(one.jaccard(s, 1, n)), contained, self.near(two.jaccard(s, 2)), self.near(two.jaccard(s, 2, n)), self.near(three.jaccard(s, 3)), self.near(np.clip(cosine, 0, 1)),
            *walk, _sigmoid(walk[0] - mean[0]), *[_sigmoid(np.abs(v - m) / d - 1) for v, m, d in zip(walk, mean, sd)], np.where(n > 1, s["strange"] / np.maximum(1, n - 1), 0.0),
            np.where(code >= 0, _sigmoid((n - self.mean_place[code]) / 5), 0.5), s["missing"] / n, *np.minimum(1.0, s["nll"].T / n / 6), _sigmoid((s["nll"][:, 1] - total) / spread / 2),
            np.minimum(1.0, n / step_cap), s["errors"] / calls, np.minimum(1.0, s["error"] / 5), s["again"] / calls, s["empty"] / calls, np.minimum(1.0, s["policy"] / 2),
            violated, apart,
        ], axis=1)


def _stepwise(told: list[tuple[int, ...]], runs: int) -> dict[str, np.ndarray]:
    """What the events say (run by run) as arrays runs x steps, and the events of each run."""
    columns = np.array(told, np.int64).reshape(-1, len(TOLD)).T
    row = columns[0]
    size = np.bincount(row, minlength=runs)
    step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    events = {c: np.zeros((runs, int(size.max(initial=0))), np.int64) for c in TOLD}
    for c, x in zip(TOLD, columns):
        events[c][row, step] = x
    return events | {"size": size}


class RunScorer(StatefulProcessor):
    """All scores of each event of the runs of a bucket."""

    def __init__(self, bank: list[list[str]], constraints: list[tuple], kappa: int = 3, expire_ms: int | None = None, step_cap: int = 60) -> None:
        self.given, self.expire_ms, self.step_cap = (bank, constraints, kappa), expire_ms, step_cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.bank = handle, Bank(*self.given)
        self.runs = handle.getMapState("runs", "run_id string", "at long, event_id long, last string, earlier string, fixed binary, few string, moved boolean, until long")
        self.grown = handle.getMapState("grown", "run_id string, key string", "times long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        number, ids = pd.factorize(events["run_id"])
        size = np.bincount(number, minlength=len(ids))
        place = np.empty(len(ids), np.int64)
        place[np.argsort(-size, kind="stable")] = np.arange(len(ids))  # runs in falling order of events
        events = events.assign(_run=place[number]).sort_values(["_run", "ts", "event_id"], kind="stable")
        ids, ends = ids[np.argsort(place)], np.cumsum(size[np.argsort(place)])
        columns = [events[c].tolist() for c in ("event_id", "act", "kind", "error", "status", "args_hash")]
        stamps = events["ts"].to_numpy("datetime64[us]").astype(np.int64).tolist()
        until = timerValues.getCurrentProcessingTimeInMs() + self.expire_ms if self.expire_ms is not None else None
        at_once = max(1, MOST_CELLS // max(1, self.bank.k * (self.bank.width + 1)))
        for lo in range(0, len(ids), at_once):
            some = ids[lo : lo + at_once]
            first = int(ends[lo - 1]) if lo else 0
            mine = list(zip(stamps[first : int(ends[lo + len(some) - 1])], *[c[first : int(ends[lo + len(some) - 1])] for c in columns]))
            bounds = [0, *(ends[lo : lo + len(some)] - first).tolist()]
            yield from self._scored(list(some), [mine[a:b] for a, b in zip(bounds, bounds[1:])], until)
        if until is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(until)

    def _scored(self, ids: list[str], given: list[list[tuple]], until: int | None) -> Iterator[pd.DataFrame]:
        """Rows of some runs' events, which become part of their state."""
        held = [self.runs.getValue((r,)) if self.runs.containsKey((r,)) else None for r in ids]
        told: list[list[tuple[int, ...]]] = []
        acts, late, tails = [], [], []
        for r, h, events in zip(ids, held, given):
            at, last = ((h[0], h[1]), [h[2], h[3]]) if h is not None else (None, [None, None])
            rest = Seen(self.grown, r, json.loads(h[5]) if h is not None else {}, h is not None and h[6])
            mine, labels, dropped = [], [], 0
            for ts, event_id, act, kind, error, status, args in events:
                here = (ts, int(event_id))
                if at is not None and here <= at:
                    dropped += 1
                    continue
                at = here
                tool, wrong = kind == "tool", error is not None and error == error and bool(error)
                again = tool and args is not None and args == args and not rest.note(f"h{args}")
                mine.append((*self.bank.tell(act, last, rest), tool, wrong, tool and wrong, again, tool and status == "empty", status in ("policy", "invalid"), dropped))
                labels.append(act)
                dropped = 0
            told.append(mine)
            acts.append(labels)
            late.append(dropped)
            tails.append((*(at or (None, None)), *last, rest))
        # late events may have changed the order of lengths
        order = sorted(range(len(ids)), key=lambda j: -len(acts[j]))
        events = _stepwise([(row, *x) for row, j in enumerate(order) for x in told[j]], len(ids))
        fixed = self.bank.start(len(ids))
        for row, j in enumerate(order):
            if held[j] is not None:
                fixed[row] = np.frombuffer(held[j][4], self.bank.record)[0]
        state, steps = self.bank.opened(fixed), events["code"].shape[1]
        found = np.empty((len(ids), steps, len(SCORES)))
        pos, missed = np.zeros((2, len(ids), steps), np.int64)
        for i in range(steps):
            s = self.bank.step(state, events, i, tables=True)
            n = len(s["n"])
            found[:n, i] = self.bank.scores(s, events["code"][:n, i], self.step_cap)
            pos[:n, i], missed[:n, i] = s["n"] - 1, s["late"]
        state["late"] += np.array([late[j] for j in order], np.int64)
        for c in self.bank.record.names:
            fixed[c] = state[c]
        for row, j in enumerate(order):
            *tail, rest = tails[j]
            self.runs.updateValue((ids[j],), (*tail, fixed[row].tobytes(), *rest.kept(), until))
        there = np.arange(steps) < events["size"][:, None]
        if there.any():
            head = {"run_id": [ids[j] for j in order for _ in acts[j]], "pos": pos[there], "act": [x for j in order for x in acts[j]]}
            yield pd.DataFrame(head | dict(zip(SCORES, found[there].T)) | {"late": missed[there]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """State of the bucket's runs goes that have had no event for so long; the others' is looked at again when the next of them is due."""
        now = max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due = {run: (until, moved) for (run,), (*_, moved, until) in self.runs.iterator()}
        gone = {run for run, (until, _) in due.items() if until is None or until <= now}
        for run in gone:
            self.runs.removeKey((run,))
        if any(due[run][1] for run in gone):
            for run, x in list(self.grown.keys()):
                if run in gone:
                    self.grown.removeKey((run, x))
        if left := [until for run, (until, _) in due.items() if run not in gone]:
            self.handle.registerTimer(min(left))
        yield from ()

    def close(self) -> None:
        pass


def score_stream(events: DataFrame, bank: DataFrame, constraints: DataFrame | None = None, kappa: int = 3, expire_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Streaming rows (run_id, ts, event_id, act, kind, error, status, args_hash) to scores.

    `bank` and `constraints` (a model as `declare.model` makes it) are batch
    tables of few rows. Columns error, status and args_hash may be missing: no
    event is then an error, empty, refused or a repeat; without kind every
    event is a tool's. Without constraints their two scores are 0. A task holds
    a batch's events of one of the `buckets` at a time.
    """
    given = events.columns
    spare = (("kind", F.lit("tool")), ("error", F.lit(None).cast("boolean")), ("status", F.lit(None).cast("string")), ("args_hash", F.lit(None).cast("string")))
    events = events.withColumns({c: x for c, x in spare if c not in given})
    labels = [r.labels for r in bounded(bank).orderBy("bank_idx").select("labels").collect()]
    model = [tuple(r) for r in constraints.orderBy("cid").select("template", "a", "b", "n").collect()] if constraints is not None else []
    return events.withColumn("bucket", F.pmod(F.hash("run_id"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(RunScorer(labels, model, kappa, expire_ms), outputStructType=OUTPUT, outputMode="append", timeMode="None" if expire_ms is None else "ProcessingTime")


def run_once(scored: DataFrame, path: str, checkpoint: str) -> None:
    """Score all that has arrived and stop; a later call goes on from there."""
    spark = scored.sparkSession
    kind = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(kind, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
