"""Declarative constraints: four-valued verdicts, witnesses, activation and scores.

A verdict of every prefix for every constraint is a closed form of running
counts and places, so the grid (run, position, constraint) needs one sort and
no state machine. Constraint models are small and broadcast.

States: 0 violated for good, 1 violated so far, 2 satisfied so far, 3 satisfied
for good.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import run_order, nearest, ratio

#: The templates by kind.
UNARY = ("init", "end", "existence", "absence", "exactly")
ORDERED = ("response", "precedence", "succession", "alternate_response", "alternate_precedence", "chain_response", "chain_precedence", "chain_succession", "not_succession", "not_chain_succession")
UNORDERED = ("coexistence", "choice", "exclusive_choice")
NEGATION = ("not_coexistence",)
TEMPLATES = UNARY + ORDERED + UNORDERED + NEGATION
WITNESSABLE = ("init", "existence", "response", "precedence", "succession", "alternate_response", "alternate_precedence", "chain_response", "chain_precedence", "chain_succession", "coexistence")
COUNTING = ("existence", "absence", "exactly")
DEFAULT_EXCLUDED = ("succession", "chain_succession", "not_coexistence", "end", "choice")
BY_SOURCE = ("existence", "absence", "exactly", "response", "alternate_response", "chain_response", "not_succession", "not_chain_succession")
BY_TARGET = ("precedence", "alternate_precedence", "chain_precedence")

SCHEMA = "cid int, template string, a string, b string, n int, weight double"
FEATURES = ("dcl_pos_viol", "dcl_pos_ratio", "dcl_pos_pend", "dcl_pos_wviol", "dcl_neg_wit", "dcl_neg_wwit", "dcl_both", "dcl_viol_rate")


def model(spark: SparkSession, constraints: list[tuple]) -> DataFrame:
    """A model from (template, a, b, n[, weight])."""
    rows = []
    for i, (template, a, b, n, *w) in enumerate(constraints):
        if template not in TEMPLATES:
            raise ValueError(f"unknown template {template!r}")
        rows.append((i, template, a, b, n, float(w[0]) if w else 1.0))
    return spark.createDataFrame(rows, SCHEMA)


def census(constraints: DataFrame) -> DataFrame:
    """Constraints and total weight by template."""
    return constraints.groupBy("template").agg(F.count("*").alias("constraints"), F.sum("weight").alias("weight"))


def state_sql() -> str:
    """The verdict as SQL over the running columns; engines agree on it."""
    open_, bad_p = "(la IS NOT NULL AND (lb IS NULL OR la >= lb))", "(fb IS NOT NULL AND (fa IS NULL OR fb <= fa))"
    bad = lambda x, rest: f"CASE WHEN {x} THEN 0 {rest} ELSE 2 END"
    forms = {
        "init": "CASE WHEN first_act = a THEN 3 ELSE 0 END", "end": "CASE WHEN act = a THEN 2 ELSE 1 END",
        "existence": "CASE WHEN ca >= n THEN 3 ELSE 1 END", "absence": "CASE WHEN ca >= n THEN 0 ELSE 2 END",
        "exactly": "CASE WHEN ca > n THEN 0 WHEN ca = n THEN 2 ELSE 1 END",
        "response": f"CASE WHEN {open_} THEN 1 ELSE 2 END", "precedence": bad(bad_p, "WHEN ca > 0 THEN 3"),
        "succession": bad(bad_p, f"WHEN {open_} THEN 1"), "alternate_response": bad("bad_ar = 1", f"WHEN {open_} THEN 1"),
        "alternate_precedence": bad("bad_ap = 1", ""), "chain_response": bad("bad_cr = 1", "WHEN act = a THEN 1"),
        "chain_precedence": bad("bad_cp = 1", ""), "chain_succession": bad("bad_cr = 1 OR bad_cp = 1", "WHEN act = a THEN 1"),
        "not_succession": bad("had_ab = 1", ""), "not_chain_succession": bad("had_chain = 1", ""),
        "coexistence": "CASE WHEN ca > 0 AND cb > 0 THEN 3 ELSE 1 END", "choice": "CASE WHEN ca > 0 OR cb > 0 THEN 3 ELSE 1 END",
        "exclusive_choice": "CASE WHEN ca > 0 AND cb > 0 THEN 0 WHEN ca > 0 OR cb > 0 THEN 2 ELSE 1 END",
        "not_coexistence": "CASE WHEN ca > 0 AND cb > 0 THEN 0 ELSE 2 END",
    }
    return "CASE template " + " ".join(f"WHEN '{t}' THEN {s}" for t, s in forms.items()) + " END"


def witness_sql() -> str:
    """Whether a prefix has shown an instance of the constraint."""
    forms = {
        "init": "first_act = a", "existence": "ca >= n", "response": "had_ab = 1", "precedence": "had_ab = 1", "succession": "had_ab = 1",
        "alternate_response": "had_ab = 1 AND a <> b", "alternate_precedence": "had_ab = 1 AND a <> b",
        "chain_response": "had_chain = 1", "chain_precedence": "had_chain = 1", "chain_succession": "had_chain = 1", "coexistence": "ca > 0 AND cb > 0",
    }
    return "CASE template " + " ".join(f"WHEN '{t}' THEN {s}" for t, s in forms.items()) + " ELSE false END"


def activation_sql() -> str:
    src, tgt = ", ".join(f"'{t}'" for t in BY_SOURCE), ", ".join(f"'{t}'" for t in BY_TARGET)
    return f"CASE WHEN template IN ('init', 'end') THEN true WHEN template IN ({src}) THEN ca > 0 WHEN template IN ({tgt}) THEN cb > 0 ELSE ca > 0 OR cb > 0 END"


def running_columns(grid: DataFrame, keys: list[str]) -> DataFrame:
    """The counts and places that verdicts are made of, for rows with act, prev, pos, a, b."""
    by = W.partitionBy(*keys).orderBy("pos")
    now, earlier = by.rowsBetween(W.unboundedPreceding, W.currentRow), by.rowsBetween(W.unboundedPreceding, -1)
    is_a, is_b = F.col("act") == F.col("a"), F.coalesce(F.col("act") == F.col("b"), F.lit(False))
    at = lambda x: F.when(x, F.col("pos"))
    g = grid.select(
        "*", F.sum(is_a.cast("int")).over(now).alias("ca"), F.sum(is_b.cast("int")).over(now).alias("cb"), F.max(at(is_a)).over(now).alias("la"), F.max(at(is_b)).over(now).alias("lb"),
        F.min(at(is_a)).over(now).alias("fa"), F.min(at(is_b)).over(now).alias("fb"), F.max(at(is_a)).over(earlier).alias("pa"), F.max(at(is_b)).over(earlier).alias("pb"),
    )
    ever = lambda x: F.max(F.coalesce(x, F.lit(False)).cast("int")).over(now)
    chained = F.coalesce(F.col("prev") == F.col("a"), F.lit(False))
    return g.select(
        "*", ever(is_a & F.col("pa").isNotNull() & (F.col("pa") >= F.coalesce("pb", F.lit(-1)))).alias("bad_ar"),
        ever(is_b & (F.col("pa").isNull() | (F.col("pa") < F.coalesce("pb", F.lit(-1))))).alias("bad_ap"),
        ever(chained & ~is_b).alias("bad_cr"), ever(is_b & ~chained).alias("bad_cp"),
        ever(is_b & F.col("pa").isNotNull()).alias("had_ab"), ever(is_b & chained).alias("had_chain"),
    )


def verdicts(events: DataFrame, constraints: DataFrame) -> DataFrame:
    """run_id, pos, cid, template, weight, state, activated, witness for every prefix."""
    first = F.first("act").over(W.partitionBy("run_id").orderBy("pos"))
    e = events.select("run_id", "pos", "act", F.lag("act").over(run_order()).alias("prev"), first.alias("first_act"))
    # the columns depend on the labels only: one grid for each pair, which the constraints on it share
    c = constraints.select("cid", "template", F.col("a").alias("_a"), F.col("b").alias("_b"), "n", "weight")
    pairs = constraints.select("a", "b").distinct()
    g = running_columns(e.join(F.broadcast(pairs)), ["run_id", "a", "b"])
    g = g.join(F.broadcast(c), F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b")))
    return g.select("run_id", "pos", "cid", "template", "weight", F.expr(state_sql()).alias("state"), F.expr(activation_sql()).alias("activated"), F.expr(witness_sql()).alias("witness"))


def last_rows(per_prefix: DataFrame, *keys: str) -> DataFrame:
    """The rows of each run's last prefix."""
    last = F.max("pos").over(W.partitionBy("run_id", *keys))
    return per_prefix.withColumn("_last", last).filter("pos = _last").drop("_last")


def satisfied(events: DataFrame, constraints: DataFrame) -> DataFrame:
    """run_id, cid, satisfied for finished runs."""
    return last_rows(verdicts(events, constraints), "cid").select("run_id", "cid", F.col("state").isin(2, 3).alias("satisfied"))


def counters(v: DataFrame) -> DataFrame:
    """Per prefix: constraints by state, pending, activated, witnessed, and their weights."""
    count = lambda x: F.sum(x.cast("int"))
    weigh = lambda x: F.sum(F.when(x, F.col("weight")).otherwise(0.0))
    state = F.col("state")
    return v.groupBy("run_id", "pos").agg(
        count(state == 0).alias("n_perm_viol"), count(state == 1).alias("n_pending"), count(state == 2).alias("n_poss_sat"), count(state == 3).alias("n_perm_sat"),
        count(F.col("activated")).alias("n_activated"), count(F.col("witness")).alias("n_witness"), weigh(state == 0).alias("w_perm_viol"), weigh(F.col("witness")).alias("w_witness"),
        F.count("*").alias("constraints"), F.sum("weight").alias("total_weight"),
    )


#: When a constraint is in a prefix's signature; `state` has it together with its verdict.
SIGNATURES = {"activated": "activated", "state": "activated", "violated": "state = 0", "pending": "state = 1"}


def signature(v: DataFrame, kind: str) -> DataFrame:
    """The symbols of each prefix as rows (run_id, pos, cid, sym)."""
    if kind not in SIGNATURES:
        raise ValueError(f"unknown signature {kind!r}")
    return v.filter(SIGNATURES[kind]).select("run_id", "pos", "cid", (F.col("state") if kind == "state" else F.lit(0)).alias("sym"))


def scores(events: DataFrame, positive: DataFrame | None = None, negative: DataFrame | None = None, wanted: tuple[str, ...] = FEATURES, scale: float = 8.0) -> DataFrame:
    """run_id, pos and one column for each feature wanted."""
    for f in wanted:
        if f not in FEATURES:
            raise ValueError(f"unknown feature {f!r}")
        if f in ("dcl_neg_wit", "dcl_neg_wwit", "dcl_both") and negative is None:
            raise ValueError(f"{f} needs a negative model")
        if f not in ("dcl_neg_wit", "dcl_neg_wwit") and positive is None:
            raise ValueError(f"{f} needs a positive model")
    grid = events.select("run_id", "pos")
    for name, m in (("p", positive), ("n", negative)):
        if m is not None:
            c = counters(verdicts(events, m))
            grid = grid.join(c.select("run_id", "pos", *[F.col(x).alias(f"{name}_{x}") for x in c.columns[2:]]), ["run_id", "pos"], "left")
    grid = grid.fillna(0)
    squash = lambda c: 1 - F.exp(-F.col(c) / scale)
    weight = lambda c, t: F.least(F.lit(1.0), F.col(c) / F.when(F.col(t) == 0, 1.0).otherwise(F.col(t)))
    forms = {
        "dcl_pos_viol": lambda: squash("p_n_perm_viol"), "dcl_pos_ratio": lambda: ratio(F.col("p_n_perm_viol"), F.col("p_n_activated")),
        "dcl_pos_pend": lambda: squash("p_n_pending"), "dcl_pos_wviol": lambda: weight("p_w_perm_viol", "p_total_weight"),
        "dcl_neg_wit": lambda: squash("n_n_witness"), "dcl_neg_wwit": lambda: weight("n_w_witness", "n_total_weight"),
        "dcl_both": lambda: F.least(F.lit(1.0), 0.5 * (F.col("p_n_perm_viol") / F.greatest(F.lit(1), F.col("p_constraints")) + F.col("n_n_witness") / F.greatest(F.lit(1), F.col("n_constraints")))),
        "dcl_viol_rate": lambda: F.least(F.lit(1.0), F.col("p_n_perm_viol") / (F.col("pos") + 1)),
    }
    return grid.select("run_id", "pos", *[forms[f]().alias(f) for f in wanted])


def packed(v: DataFrame, *keys: str, kind: str = "state") -> DataFrame:
    """keys, in, lo, hi: rows of bits of each prefix, constraint by constraint, in arrays of 64-bit words.

    `in` says whether a constraint is in the signature; for kind `state`, lo
    and hi are the two bits of its verdict. `v` is partitioned by run, so
    neither step moves rows.
    """
    bit = F.expr("shiftleft(1L, cast(cid % 64 AS int))")
    either = lambda x: F.bit_or(F.when(x, bit).otherwise(F.lit(0).cast("long")))
    verdict = F.col("state") if kind == "state" else F.lit(0)
    words = v.groupBy(*keys, F.floor(F.col("cid") / 64).alias("_w")).agg(either(F.expr(SIGNATURES[kind])).alias("in"), either(verdict % 2 == 1).alias("lo"), either(verdict >= 2).alias("hi"))
    rows = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_w", "in", "lo", "hi"))).alias("_x"))
    return rows.select(*keys, *[F.col("_x").getField(c).alias(c) for c in ("in", "lo", "hi")])


def _bits(words: int, one: Callable[[Column], Column], upto: int = 32) -> Column:
    """Set bits of `one` summed over the words: a plain sum of few, else a fold."""
    if words <= upto:
        total = F.lit(0)
        for w in range(words):
            total = total + F.bit_count(one(F.lit(w)))
        return total
    return F.aggregate(F.sequence(F.lit(0), F.lit(words - 1)), F.lit(0), lambda acc, w: acc + F.bit_count(one(w)))


def packed_distance(words: int, mask: str | None = None) -> Column:
    """Jaccard distance of the signatures in (in, lo, hi) and (_in, _lo, _hi), over the constraints of `mask` (an array like `in`)."""
    get = lambda c, w: F.get(F.col(c), w)
    kept = (lambda x, w: x.bitwiseAND(get(mask, w))) if mask else (lambda x, w: x)
    differ = lambda w: get("lo", w).bitwiseXOR(get("_lo", w)).bitwiseOR(get("hi", w).bitwiseXOR(get("_hi", w)))
    both = _bits(words, lambda w: kept(get("in", w).bitwiseAND(get("_in", w)).bitwiseAND(F.bitwise_not(differ(w))), w))
    size = lambda c: _bits(words, lambda w: kept(get(c, w), w))
    union = size("in") + size("_in") - both
    return F.when(union > 0, 1 - both / union).otherwise(F.lit(0.0))


def signature_distances(v: DataFrame, bank_v: DataFrame, kind: str = "state", mode: str = "prefix") -> DataFrame:
    """run_id, pos, bank_idx, d: Jaccard distance of each prefix's symbols to each reference's.

    `bank_v` has the verdicts of the references with bank_idx in place of
    run_id. In prefix mode a reference stands at the same step, or its last.
    Signatures are rows of bits, so a pair of them is compared word by word.
    """
    if mode not in ("prefix", "full"):
        raise ValueError(f"unknown mode {mode!r}")
    if kind not in SIGNATURES:
        raise ValueError(f"unknown signature {kind!r}")
    theirs = packed(bank_v, "bank_idx", "pos", kind=kind)
    words = bank_v.agg(F.count_distinct(F.floor(F.col("cid") / 64))).first()[0]
    ends = theirs.groupBy("bank_idx").agg(F.max("pos").alias("last"))
    mine = packed(v, "run_id", "pos", kind=kind).join(F.broadcast(ends))
    at = F.least("pos", "last") if mode == "prefix" else F.col("last")
    t = theirs.select(F.col("bank_idx").alias("_b"), F.col("pos").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("in", "lo", "hi")])
    # references times their steps: as small as the bank
    met = mine.join(F.broadcast(t), (F.col("bank_idx") == F.col("_b")) & (at == F.col("_p")))
    return met.select("run_id", "pos", "bank_idx", packed_distance(words).alias("d"))
