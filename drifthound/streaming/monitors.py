"""Constraint monitors for many runs at once: an event wakes only the pairs of labels that it can change.

The verdicts are those of `operators.declare`, from the same running counts
and places of a pair, kept as numbers instead of windows. An event of each run
is taken at a time; the pairs woken in all of them are one row of numbers.
"""

from __future__ import annotations

import numpy as np

from ..operators.declare import BY_SOURCE, BY_TARGET

#: Running values of a pair (a, b); places are -1 before there is one.
PAIR = np.dtype([(c, "i8") for c in ("ca", "cb", "la", "lb", "fa", "fb")] + [(c, "?") for c in ("bad_ar", "bad_ap", "bad_cr", "bad_cp", "had_ab", "had_chain")])
#: Templates that the event after an `a` may change, whatever it is.
AFTER_SOURCE = ("end", "chain_response", "chain_precedence", "chain_succession")


def _else(no: np.ndarray, rest: np.ndarray | int) -> np.ndarray:
    """0 where it is violated for good."""
    return np.where(no, 0, rest)


class Woken:
    """Verdicts of pairs (rows of PAIR), by template; `here`: the event is an a."""

    def __init__(self, p: np.ndarray, here: np.ndarray) -> None:
        self.p, self.here = p, here
        self.one, self.two = p["ca"] > 0, p["cb"] > 0
        la, lb, fa, fb = (p[c] for c in ("la", "lb", "fa", "fb"))
        self.pending = np.where((la >= 0) & ((lb < 0) | (la >= lb)), 1, 2)
        self.late = (fb >= 0) & ((fa < 0) | (fb <= fa))  # a first b without an a before it

    def verdict(self, template: str, n: np.ndarray) -> np.ndarray:
        """0 to 3."""
        p, one, two, here = self.p, self.one, self.two, self.here
        match template:
            case "init":
                return np.where(p["fa"] == 0, 3, 0)
            case "end":
                return np.where(here, 2, 1)
            case "existence":
                return np.where(p["ca"] >= n, 3, 1)
            case "absence":
                return np.where(p["ca"] >= n, 0, 2)
            case "exactly":
                return _else(p["ca"] > n, np.where(p["ca"] == n, 2, 1))
            case "response":
                return self.pending
            case "precedence":
                return _else(self.late, np.where(one, 3, 2))
            case "succession":
                return _else(self.late, self.pending)
            case "alternate_response":
                return _else(p["bad_ar"], self.pending)
            case "alternate_precedence":
                return _else(p["bad_ap"], 2)
            case "chain_response":
                return _else(p["bad_cr"], np.where(here, 1, 2))
            case "chain_precedence":
                return _else(p["bad_cp"], 2)
            case "chain_succession":
                return _else(p["bad_cr"] | p["bad_cp"], np.where(here, 1, 2))
            case "not_succession":
                return _else(p["had_ab"], 2)
            case "not_chain_succession":
                return _else(p["had_chain"], 2)
            case "coexistence":
                return np.where(one & two, 3, 1)
            case "choice":
                return np.where(one | two, 3, 1)
            case "exclusive_choice":
                return _else(one & two, np.where(one | two, 2, 1))
            case "not_coexistence":
                return _else(one & two, 2)
        raise ValueError(f"unknown template {template!r}")

    def activated(self, template: str) -> np.ndarray:
        if template in ("init", "end"):
            return np.ones(len(self.p), bool)
        if template in BY_SOURCE:
            return self.one
        return self.two if template in BY_TARGET else self.one | self.two


class Monitors:
    """A model's constraints (template, a, b, n), their pairs, and which of them a label wakes.

    Labels are numbers; one more than there are stands for all that no
    constraint has, and for none.
    """

    def __init__(self, constraints: list[tuple[str, str, str | None, int | None]]) -> None:
        self.pairs = sorted({(a, b) for _, a, b, _ in constraints}, key=lambda p: (p[0], p[1] or ""))
        at = {p: i for i, p in enumerate(self.pairs)}
        self.size = len(constraints)
        self.words = -(-self.size // 64)
        self.names = {x: i for i, x in enumerate(sorted({x for p in self.pairs for x in p} - {None}))}
        self.a, self.b = (np.array([self.names.get(p[i], -1) for p in self.pairs], np.int64) for i in (0, 1))
        self.touched, self.after = np.zeros((2, len(self.names) + 1, len(self.pairs)), bool)
        #: (template, constraint of each pair or -1, its n): as many of a template as a pair has at most
        self.slots: list[tuple[str, np.ndarray, np.ndarray]] = []
        filled: dict[tuple[str, int], int] = {}
        places: dict[tuple[str, int], int] = {}
        for c, (t, a, b, n) in enumerate(constraints):
            i = at[a, b]
            nth = filled[t, i] = filled.get((t, i), -1) + 1
            if (t, nth) not in places:
                places[t, nth] = len(self.slots)
                self.slots.append((t, np.full(len(self.pairs), -1, np.int64), np.zeros(len(self.pairs), np.int64)))
            _, cid, limit = self.slots[places[t, nth]]
            cid[i], limit[i] = c, n or 0
            for x in {a, b} - {None}:
                self.touched[self.names[x], i] = True
            if t in AFTER_SOURCE:
                self.after[self.names[a], i] = True

    def code(self, label: str | None) -> int:
        return self.names.get(label, len(self.names))

    def start(self, *runs: int) -> np.ndarray:
        p = np.zeros((*runs, len(self.pairs)), PAIR)
        for c in ("la", "lb", "fa", "fb"):
            p[c] = -1
        return p

    def push_many(self, pairs: np.ndarray, verdicts: np.ndarray, active: np.ndarray, act: np.ndarray, prev: np.ndarray, pos: np.ndarray) -> int:
        """Take an event of each run (rows) into its pairs, verdicts and activations; how many pairs woke."""
        woken = self.touched[act] | self.after[prev]
        woken[pos == 0] = True
        r, i = np.nonzero(woken)
        if not len(r):
            return 0
        p, at = pairs[r, i], pos[r]
        here, there, chained = act[r] == self.a[i], act[r] == self.b[i], prev[r] == self.a[i]
        la, lb = p["la"], p["lb"]
        p["bad_ar"] |= here & (la >= 0) & (la >= lb)
        p["bad_ap"] |= there & ((la < 0) | (la < lb))
        p["bad_cp"] |= there & ~chained
        p["had_ab"] |= there & (la >= 0)
        p["had_chain"] |= there & chained
        p["bad_cr"] |= chained & ~there
        for yes, count, last, first in ((here, "ca", "la", "fa"), (there, "cb", "lb", "fb")):
            p[count] += yes
            np.copyto(p[last], at, where=yes)
            np.copyto(p[first], at, where=yes & (p[first] < 0))
        pairs[r, i] = p
        now, kinds = Woken(p, here), {}
        for template, cid, n in self.slots:
            c = cid[i]
            there_is = c >= 0
            if template not in kinds:
                kinds[template] = now.activated(template)
            to = r[there_is], c[there_is]
            verdicts[to] = now.verdict(template, n[i])[there_is]
            active[to] = kinds[template][there_is]
        return len(r)

    def push(self, pairs: np.ndarray, verdicts: np.ndarray, active: np.ndarray, act: str, prev: str | None, pos: int) -> int:
        """Take one event of one run."""
        one = [np.array([x]) for x in (self.code(act), self.code(prev), pos)]
        return self.push_many(pairs[None], verdicts[None], active[None], *one)


def bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    words = -(-flags.shape[1] // 64)
    out = np.zeros((len(flags), words * 8), np.uint8)
    packed = np.packbits(flags, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def signature(verdicts: np.ndarray, active: np.ndarray) -> np.ndarray:
    """in, lo, hi of the `state` signature of each run: runs x 3 x words."""
    return np.stack([bits(active), bits(verdicts & 1), bits(verdicts >> 1)], axis=1)


def shared(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Words of the symbols that signatures (... x 3 x words) have in common."""
    differ = (mine[..., 1, :] ^ theirs[..., 1, :]) | (mine[..., 2, :] ^ theirs[..., 2, :])
    return mine[..., 0, :] & theirs[..., 0, :] & ~differ


def count(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


def jaccard(both: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distance from the number of symbols of both, of one and of the other."""
    union = one + other - both
    return np.where(union > 0, 1 - both / np.maximum(1, union), 0.0)
