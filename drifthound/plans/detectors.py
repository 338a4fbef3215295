"""Detectors by name, and the sweep that calibrates and judges them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import nearest, nearest_of, ratio, sigmoid
from ..operators import declare, distances, evaluate, mining, structure
from ..operators.bank import ScoreConfig, draw_banks, unusable
from ..operators.baselines import counted_scores, ngram_score, random_score
from ..sources.logs import traces_of
from ..sources.runs import discard, materialised
from ..streaming.monitors import Monitors, bits, count, jaccard, shared, signature

CONFIGS = (
    ScoreConfig("dl", "max_knn", 3, name="dl/max@3"), ScoreConfig("dl_trunc", "max_knn", 3, name="dltr/max@3"), ScoreConfig("dl", "min", name="dl/min"),
    ScoreConfig("dl", "mean_knn", 3, name="dl/mean@3"), ScoreConfig("dl", "quantile", q=0.25, name="dl/q25"), ScoreConfig("jaccard", "max_knn", 3, name="jac/max@3"),
    ScoreConfig("jaccard", "min", name="jac/min"), ScoreConfig("jaccard_prefix", "max_knn", 3, name="jac_pre/max@3"), ScoreConfig("containment", "min", name="cont/min"),
)
SWEPT = (*(c.name for c in CONFIGS), "return_rate", "edge_novelty", "df_legality", "graph_progress", "cycle_absz", "edge_absz", "dcl_viol", "dcl_div", "step_count")
#: Events that a task sorts on average.
MOST_EVENTS = 250_000
QUANTILES, WARMUPS, SIZES = (0.90, 0.95, 0.99), (3, 9), (16, 32, 64)


def _named(df: DataFrame, *cols: str) -> DataFrame:
    """Wide scores to rows (run_id, pos, detector, score)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("detector"), F.col(f"`{c}`").cast("double").alias("score")) for c in cols])
    return df.select("run_id", "pos", F.inline(pairs))


def bank_scores(events: DataFrame, traces: DataFrame, bank: DataFrame, configs: tuple[ScoreConfig, ...] = CONFIGS, leave_out: bool = False) -> DataFrame:
    """Scores from distances to the bank; with `leave_out`, bank runs against the others."""
    own = bank.select(F.col("ref_id").alias("run_id"), F.col("bank_idx").alias("_own"))
    score = lambda c, d: nearest(d, c.aggregator, c.kappa, c.q).alias(c.label())
    found = None
    sets = tuple(sorted({c.distance for c in configs} - set(distances.EDIT_DISTANCES)))
    if sets:
        d = distances.set_distances(events, bank, sets)
        if leave_out:
            d = d.join(F.broadcast(own), "run_id").filter("bank_idx <> _own")
        wide = d.groupBy("run_id", "pos").agg(*[score(c, F.collect_list(c.distance)) for c in configs if c.distance in sets])
        found = _named(wide, *wide.columns[2:])
    edit = [c for c in configs if c.distance in distances.EDIT_DISTANCES]
    if edit:
        asked = traces.join(F.broadcast(own.withColumnRenamed("_own", "own")), "run_id") if leave_out else traces
        wide = distances.edit_scores(asked, bank, {c.label(): (c.distance, c.aggregator, c.kappa, c.q) for c in edit})
        rows = _named(wide, *wide.columns[2:])
        found = rows if found is None else found.unionByName(rows)
    return found


def all_scores(events: DataFrame, bank: DataFrame, model: DataFrame | None = None, leave_out: bool = False) -> DataFrame:
    """run_id, pos, detector, score of every swept detector."""
    refs = structure.as_events(bank)
    traces = traces_of(events)
    out = bank_scores(events, traces, bank, leave_out=leave_out)
    out = out.unionByName(_named(structure.walk_features(events), "return_rate", "edge_novelty"))
    for name, f in (("df_legality", structure.df_legality), ("graph_progress", structure.graph_progress)):
        out = out.unionByName(f(events, bank, leave_out=leave_out).select("run_id", "pos", F.lit(name).alias("detector"), "score"))
    out = out.unionByName(_named(structure.profile_scores(events, refs, leave_out=leave_out), "cycle_absz", "edge_absz"))
    out = out.unionByName(_named(counted_scores(events), "step_count"))
    if model is not None:
        v = declare.verdicts(events, model)
        out = out.unionByName(declare.scores(events, model, wanted=("dcl_pos_viol",)).select("run_id", "pos", F.lit("dcl_viol").alias("detector"), F.col("dcl_pos_viol").alias("score")))
        named = bank.select(F.col("ref_id").alias("run_id"), F.col("bank_idx").alias("_own"))
        bank_v = declare.verdicts(refs, model).join(F.broadcast(named), "run_id").drop("run_id").withColumnRenamed("_own", "bank_idx")
        d = declare.signature_distances(v, bank_v)
        if leave_out:
            d = evaluate.leave_one_out(d, bank)
        out = out.unionByName(d.groupBy("run_id", "pos").agg(nearest(F.collect_list("d"), "max_knn", 3).alias("score")).select("run_id", "pos", F.lit("dcl_div").alias("detector"), "score"))
    return out


def bank_model(bank: DataFrame, support: float = 1.0) -> DataFrame | None:
    """The constraints that at least this share of the bank satisfies, as a model; None without any."""
    m = mining.as_model(mining.mine(structure.as_events(bank), support=support, cumulative=True))
    return m if m.take(1) else None


def _curves(rows: DataFrame, *names: str) -> DataFrame:
    """Rows (run_id, n, success, draw, loo, pos, scores) to whole curves: run_id, n, success, draw, loo, detector, curve."""
    kept = rows.groupBy("run_id", "n", "success", "draw", "loo").agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("_x"))
    each = F.array(*[F.struct(F.lit(n).alias("detector"), F.col("_x").getField(n).cast("array<double>").alias("curve")) for n in names])
    return kept.select("run_id", "n", "success", "draw", "loo", F.inline(each))


def _structure_curves(grid: DataFrame, refs: DataFrame) -> DataFrame:
    """Curves of the walk's scores: `grid` has the events of each run for each draw, `refs` those of the draws' references.

    What a draw knows (edges, places of labels, profiles) is a table of at most
    its references' events; a run's own share is taken off where it is in the draw.
    """
    own = F.when(F.col("loo"), 1).otherwise(0)
    edges = refs.filter("prev IS NOT NULL").groupBy("draw", "prev", "act").agg(F.count_distinct("run_id").alias("_refs"))
    places = refs.groupBy("draw", "act").agg(F.sum(F.col("pos") + 1).alias("_s"), F.count("*").alias("_c"))
    steps = refs.groupBy("draw", F.col("pos").alias("_step")).agg(
        F.count("*").alias("_n"), *[f(x).alias(f"_{k}_{c}") for c in ("return_rate", "edge_novelty") for k, f, x in (("s", F.sum, F.col(c)), ("ss", F.sum, F.col(c) * F.col(c)))])
    ends = refs.groupBy("draw", "run_id").agg(F.max("pos").alias("_end")).groupBy("draw").agg(F.sort_array(F.collect_list("_end"), asc=False).alias("_ends"))  # as many as the bank has references
    met = grid.join(F.broadcast(edges), ["draw", "prev", "act"], "left").join(F.broadcast(places), ["draw", "act"], "left").join(F.broadcast(ends), "draw")
    # the longest of the (other) references
    last = F.when(F.col("loo") & (F.col("n") - 1 == F.get("_ends", F.lit(0))), F.coalesce(F.get("_ends", F.lit(1)), F.lit(-1))).otherwise(F.get("_ends", F.lit(0)))
    met = met.withColumn("_step", F.least(F.col("pos"), last)).join(F.broadcast(steps), ["draw", "_step"], "left")
    run = W.partitionBy("run_id", "draw").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    illegal = (F.col("prev").isNotNull() & (F.coalesce("_refs", F.lit(0)) <= own)).cast("int")
    s, c = F.col("_s") - own * F.col("own_s"), F.col("_c") - own * F.col("own_c")
    at_step = W.partitionBy("run_id", "draw")

    def absz(col: str) -> Column:
        # a run's own value at the step it is held against
        mine = F.max(F.when(F.col("pos") == F.col("_step"), F.col(col))).over(at_step.orderBy("_step").rangeBetween(0, 0))
        n, total, squares = F.col("_n") - own, F.col(f"_s_{col}") - own * mine, F.col(f"_ss_{col}") - own * mine * mine
        sd = F.greatest(F.sqrt(F.greatest(F.lit(0.0), (squares - total * total / n) / F.greatest(n - 1, F.lit(1)))), F.lit(1e-6))
        value = F.when(n > 0, F.abs(F.col(col) - total / n) / sd).otherwise(F.abs(F.col(col)))
        return sigmoid(value - 1)

    scores = met.select(
        "run_id", "n", "success", "draw", "loo", "pos", "return_rate", "edge_novelty", ratio(F.sum(illegal).over(run), F.col("pos")).alias("df_legality"),
        F.when(c > 0, sigmoid((F.col("pos") + 1 - s / c) / 5)).otherwise(0.5).alias("graph_progress"), absz("return_rate").alias("cycle_absz"), absz("edge_novelty").alias("edge_absz"), F.least(F.lit(1.0), (F.col("pos") + 1) / 60).alias("step_count"))
    return _curves(scores, "return_rate", "edge_novelty", "df_legality", "graph_progress", "cycle_absz", "edge_absz", "step_count")


def _named_curves(raw: DataFrame, numbered: list[int], names: list[str]) -> DataFrame:
    """Rows of `distances.CURVES` to one row a curve, with the draws' numbers and the detectors' names."""
    number, each = F.array(*[F.lit(d) for d in numbered]), F.array(*[F.lit(n) for n in names])
    rows = raw.select("run_id", "n", "success", F.get(number, F.col("draw")).alias("draw"), "loo", F.inline(F.arrays_zip(each.alias("detector"), F.col("curves").alias("curve"))))
    return rows.toDF("run_id", "n", "success", "draw", "loo", "detector", "curve")


def _constraint_curves(traces: DataFrame, references: dict[str, list[str]], members: list[list[str]], numbered: list[int], models: DataFrame, warmup: int) -> DataFrame:
    """Curves of dcl_viol and dcl_div: verdicts of all draws' constraints are made once, as rows of bits that each draw masks.

    `models` (draw, cid, key) says which constraints a draw has; they are as
    few as the banks can show. A task takes many runs step by step, and keeps
    no more than their pairs' counts, their verdicts and the curves.
    """
    held = models.select("draw", "cid", *mining.KEY).collect()
    key = {r.cid: tuple(r[c] for c in mining.KEY) for r in held}
    place = {cid: i for i, cid in enumerate(sorted(key))}
    rules = Monitors([key[c] for c in place])
    flags = np.zeros((len(members), rules.size), bool)
    at = {d: i for i, d in enumerate(numbered)}
    for r in held:
        flags[at[r.draw], place[r.cid]] = True
    number = {r: i for i, r in enumerate(references)}
    lengths = np.array([len(l) for l in references.values()], np.int64)
    others = [np.array([number[r] for r in m], np.int64) for m in members]

    def signatures(codes: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Verdicts and signatures of runs in falling order of length, step by step."""
        pairs, verdicts, active = rules.start(len(codes)), np.zeros((len(codes), rules.size), np.uint8), np.zeros((len(codes), rules.size), bool)
        none = np.full(len(codes), rules.code(None))
        for i in range(codes.shape[1]):
            n = int(np.count_nonzero(size > i))
            rules.push_many(pairs[:n], verdicts[:n], active[:n], codes[:n, i], codes[:n, i - 1] if i else none[:n], np.full(n, i))
            yield verdicts[:n], signature(verdicts[:n], active[:n])

    theirs = np.zeros((int(lengths.max()), len(lengths), 3, rules.words), np.uint64)  # step by step, the last for all that follow
    order = np.argsort(-lengths, kind="stable")
    coded = np.zeros((len(order), len(theirs)), np.int64)
    for x, l in enumerate([list(references.values())[j] for j in order]):
        coded[x, : len(l)] = [rules.code(a) for a in l]
    for i, (_, s) in enumerate(signatures(coded, lengths[order])):
        theirs[i:, order[: len(s)]] = s
    shared_ = traces.sparkSession.sparkContext.broadcast((theirs, flags, bits(flags), others, number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs, flags, masks, members, number = shared_.value
        places = np.full((len(members), theirs.shape[1]), -1, np.int64)
        for d, m in enumerate(members):
            places[d, m] = np.arange(len(m))
        for b in batches:
            size, coded = distances.coded_runs(b, rules.code)
            own = np.array([number.get(r, -1) for r in b.column(0).to_pylist()], np.int64)
            order = np.argsort(-size, kind="stable")
            order = order[(size[order] >= warmup) | ((own[order] >= 0) & (size[order] > 0))]
            lo = 0
            while lo < len(order):
                longest = int(size[order[lo]])
                rows = order[lo : lo + max(1, distances.MOST_CELLS // max(theirs[0].size, 8 * len(rules.pairs), rules.size, 2 * longest * len(members)))]
                lo += len(rows)
                mine = np.where(own[rows] >= 0, places[:, own[rows]], -1).T  # runs x draws
                curves = np.empty((len(rows), len(members), 2, longest))
                for i, (verdicts, s) in enumerate(signatures(coded(rows), size[rows])):
                    n, refs = len(s), theirs[min(i, len(theirs) - 1)]
                    both = shared(s[:, None], refs)
                    for d, (m, mask) in enumerate(zip(members, masks)):
                        curves[:n, d, 0, i] = 1 - np.exp(-((verdicts == 0) & flags[d]).sum(axis=1) / 8)
                        apart = jaccard(count(both[:, m] & mask), count(s[:, 0] & mask)[:, None], count(refs[m, 0] & mask))
                        curves[:n, d, 1, i] = nearest_of(apart, mine[:n, d], "max_knn", 3)
                # a draw without constraints has no such scores, nor has a run without other references
                usable = flags.any(axis=1) & (np.array([len(m) for m in members]) > (mine >= 0))
                yield distances.curve_batch(b, rows, size, ((mine >= 0) | (size[rows] >= warmup)[:, None]) & usable, mine >= 0, curves)

    return _named_curves(traces.select("run_id", "labels", "success").mapInArrow(run, distances.CURVES), numbered, ["dcl_viol", "dcl_div"])


def draw_curves(events: DataFrame, banks: DataFrame, draws: list[tuple[int, int, int]], support: float = 1.0, warmup: int = 3, detectors: tuple[str, ...] = SWEPT, made: list[DataFrame] | None = None) -> DataFrame:
    """Curves of every detector asked for, for all draws at once: run_id, n, success, draw, loo, detector, curve.

    `draws` are (number, seed, size) over `banks` (`draw_banks`). A run is
    scored for each draw: if it is in the draw's bank, against the others there
    (`loo`), else, with `warmup` events, against the whole. Tables written on
    the way, which the curves read, are added to `made`.
    """
    made = made if made is not None else []
    spark = events.sparkSession
    k = max(size for *_, size in draws)
    held = [r for r in banks.filter(F.col("bank_idx") < k).orderBy("seed", "bank_idx").collect()]  # seeds times size rows
    references = {r.ref_id: r.labels for r in held}
    members = [[r.ref_id for r in held if r.seed == seed and r.bank_idx < size] for _, seed, size in draws]
    numbered = [d for d, *_ in draws]
    table = spark.createDataFrame([(d, r) for d, m in zip(numbered, members) for r in m], "draw int, run_id string")
    traces = traces_of(events).select("run_id", "labels", "success")
    found = []
    configs = [c for c in CONFIGS if c.label() in detectors]
    if configs:
        raw = distances.draw_curves(traces, references, members, {c.label(): (c.distance, c.aggregator, c.kappa, c.q) for c in configs}, warmup)
        found.append(_named_curves(raw, numbered, [c.label() for c in configs]))
    if set(detectors) - {c.label() for c in configs}:
        # a task sorts no more events when there are more of them in all
        tasks = max(spark.sparkContext.defaultParallelism, -(-events.count() // MOST_EVENTS))
        facts = materialised(structure.walk_facts(events.repartition(tasks, "run_id"), "n", "success"), "facts")
        made.append(facts)
        refs = facts.join(F.broadcast(table), "run_id")
        grid = facts.join(F.broadcast(spark.createDataFrame([(d,) for d in numbered], "draw int"))).join(F.broadcast(table.withColumn("_in", F.lit(True))), ["run_id", "draw"], "left")
        grid = grid.withColumn("loo", F.coalesce("_in", F.lit(False))).drop("_in").filter(F.col("loo") | (F.col("n") >= warmup))
        found.append(_structure_curves(grid, refs).filter(F.col("detector").isin(*detectors)))
        if {"dcl_viol", "dcl_div"} & set(detectors):
            # references mined apart in each draw
            groups = table.select(F.concat_ws("|", "draw", "run_id").alias("run_id"), "draw")
            apart = refs.select(F.concat_ws("|", "draw", "run_id").alias("run_id"), "pos", "act")
            mined = materialised(mining.as_models(mining.mine(apart, support=support, cumulative=True, groups=groups), "draw"), "models")
            made.append(mined)
            if mined.take(1):
                found.append(_constraint_curves(traces, references, members, numbered, mined, warmup).filter(F.col("detector").isin(*detectors)))
    curves = found[0]
    for f in found[1:]:
        curves = curves.unionByName(f)
    return curves


def sweep_draws(events: DataFrame, seeds: tuple[int, ...] = (0,), sizes: tuple[int, ...] = (16,), support: float = 1.0, quantiles: tuple[float, ...] = QUANTILES, warmups: tuple[int, ...] = (1, 3), warmup: int = 3, patience: int = 2, detectors: tuple[str, ...] = SWEPT) -> tuple[DataFrame, dict[tuple[int, int], str]]:
    """seed, k, detector, q, w (so many warm-ups), threshold and metrics for all draws in one plan, and why draws were skipped.

    Curves are made once. Those of the banks' own runs give the thresholds
    (as many rows as the banks have runs); all others meet them, and only
    counts leave the tasks.
    """
    spark = events.sparkSession
    events = materialised(events, "events")
    banks = materialised(draw_banks(traces_of(events), max(sizes), tuple(seeds)), "banks")
    have = {r.seed: r.ends for r in banks.groupBy("seed").agg(F.collect_list(F.struct("bank_idx", "n")).alias("ends")).collect()}
    ends = {r.success: r["count"] for r in events.filter((F.col("pos") == 0) & (F.col("n") >= warmup)).groupBy("success").count().collect()}
    draws, skipped = [], {}
    for seed in seeds:
        for k in sizes:
            bank = [e for e in have.get(seed, []) if e.bank_idx < k]
            why = unusable(len(bank), k, ends.get(False, 0), ends.get(True, 0) - sum(e.n >= warmup for e in bank))
            if why:
                skipped[seed, k] = why
            else:
                draws.append((len(draws), seed, k))
    grid = [(q, w, w * warmup) for q in quantiles for w in warmups]
    empty = "seed int, k int, detector string, q double, w int, threshold double, tp bigint, fp bigint, pos bigint, neg bigint, runs bigint, precision double, recall double, f1 double, fpr double, flag_rate double, earliness_frac double, earliness_step double"
    if not draws:
        return spark.createDataFrame([], empty), skipped
    made = [events, banks]
    curves = draw_curves(events, banks, draws, support, warmup, detectors, made).withColumn("curve", F.transform("curve", lambda x: F.round(x, 9)))
    curves = materialised(curves, "curves")
    discard(*made)
    tests = F.broadcast(spark.createDataFrame(grid, "q double, w int, start int"))
    late = F.array_max(F.slice("curve", F.col("start"), F.greatest(F.col("n") - F.col("start") + 1, F.lit(0))))
    tops = curves.filter("loo").join(tests).withColumn("peak", late).groupBy("draw", "detector", "q", "w", "start").agg(F.array_sort(F.collect_list("peak")).alias("_p"))  # no more than the bank has runs
    at = F.least(F.size("_p") - 1, F.ceil(F.col("q") * (F.size("_p") - 1))).cast("int")
    limit = F.coalesce(F.get("_p", at), F.lit(float("inf"))).alias("threshold")
    limits = tops.select("draw", "detector", F.struct("q", "w", "start", limit).alias("t")).groupBy("draw", "detector").agg(F.collect_list("t").alias("thresholds"))
    met = evaluate.fired_steps(curves.filter(~F.col("loo")).join(F.broadcast(limits), ["draw", "detector"]), "thresholds", patience)
    decided = met.withColumns({"fired": F.col("step").isNotNull(), "frac": F.col("step") / F.col("n")})
    cells = evaluate.metrics_of(decided, ("draw", "detector", "q", "w", "threshold"))
    names = F.broadcast(spark.createDataFrame(draws, "draw int, seed int, k int"))
    cells = materialised(cells.join(names, "draw").select("seed", "k", *[c for c in cells.columns if c != "draw"]), "cells")
    discard(curves)
    return cells, skipped


def sweep(events: DataFrame, k: int = 16, seed: int = 0, **options) -> DataFrame:
    """detector, q, w, threshold and metrics of one draw of the bank."""
    return sweep_draws(events, (seed,), (k,), **options)[0].drop("seed", "k")


def sweep_all(logs: dict[str, DataFrame], seeds: tuple[int, ...] = tuple(range(10)), sizes: tuple[int, ...] = SIZES, **options) -> tuple[DataFrame, dict[tuple, str]]:
    """The sweep over sources, seeds and bank sizes: cells by (source, seed, k, detector, q, w), and why draws were skipped.

    All draws of a source are one plan.
    """
    cells, skipped = None, {}
    for source, events in logs.items():
        found, why = sweep_draws(events, tuple(seeds), tuple(sizes), **options)
        skipped |= {(source, *draw): reason for draw, reason in why.items()}
        found = found.select(F.lit(source).alias("source"), "*")
        cells = found if cells is None else cells.unionByName(found)
    return cells, skipped


BASELINES = {
    "ngram0": lambda e, b: ngram_score(e, b, 0), "ngram1": lambda e, b: ngram_score(e, b, 1), "random": lambda e, b: random_score(e),
    **{n: (lambda e, b, n=n: counted_scores(e).select("run_id", "pos", F.col(n).alias("score"))) for n in ("step_count", "error_rate", "error_count", "repeat_rate", "empty_rate", "policy_count")},
}
