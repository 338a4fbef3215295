"""Operators against independent plain-Python definitions on small random runs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drifthound.functions.expr import nearest, upper_rank
from drifthound.operators import bank as banks
from drifthound.operators import baselines, declare, distances, evaluate, mining, structure


def runs_of(seed, count, letters="abc", most=7):
    rng = random.Random(seed)
    return {f"r{i}": [rng.choice(letters) for _ in range(rng.randint(1, most))] for i in range(count)}


def events_of(spark, runs, success=True):
    rows = [(r, p, a, r, "tool", a == "c", "err" if a == "c" else "ok", a, len(l), success) for r, l in runs.items() for p, a in enumerate(l)]
    return spark.createDataFrame(rows, "run_id string, pos int, act string, task_id string, kind string, error boolean, status string, args_hash string, n int, success boolean")


def bank_of(spark, refs):
    return spark.createDataFrame([(k, i, v, len(v), k) for i, (k, v) in enumerate(refs.items())], "ref_id string, bank_idx int, labels array<string>, n int, task_id string")


def traces_of(spark, runs):
    return spark.createDataFrame([(k, v, len(v), True, k) for k, v in runs.items()], "run_id string, labels array<string>, n int, success boolean, task_id string")


def osa(p, r):
    d = [[0] * (len(r) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) + 1):
        for j in range(len(r) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (p[i - 1] != r[j - 1]))
            if i > 1 and j > 1 and p[i - 1] == r[j - 2] and p[i - 2] == r[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(p)]


def test_edit_distances(spark):
    runs, refs = runs_of(1, 25, "abcd"), runs_of(2, 6, "abce")
    out = distances.edit_distances(traces_of(spark, runs), bank_of(spark, refs)).collect()
    assert len(out) == sum(map(len, runs.values()))
    for row in out:
        p = runs[row.run_id][: row.pos + 1]
        for j, r in enumerate(refs.values()):
            last = osa(p, r)
            assert row.dl[j] == pytest.approx(min(1, min(last) / len(p)))
            assert row.dl_full[j] == pytest.approx(last[len(r)] / max(len(p), len(r)))
            assert row.dl_trunc[j] == pytest.approx(min(1, last[min(len(p), len(r))] / len(p)))
    fold = {(r.run_id, r.bank_idx): r.dl for r in distances.edit_distance_fold(traces_of(spark, runs), bank_of(spark, refs)).collect()}
    for k, p in runs.items():
        for j, r in enumerate(refs.values()):
            assert fold[k, j] == pytest.approx(min(1, min(osa(p, r)) / len(p)))


def test_whole_run_distances_of_odd_banks(spark):
    """Runs without events, references without labels, numbers of the bank with gaps; no fold of lambdas, run by run."""
    runs, refs = {**runs_of(3, 12, "abcd"), "none": []}, {**runs_of(4, 3, "abce"), "empty": []}
    bank = bank_of(spark, refs).withColumn("bank_idx", F.col("bank_idx") * 3 + 2)
    out = distances.edit_distance_fold(traces_of(spark, runs), bank)
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {(k, 3 * j + 2): min(1, min(osa(p, r)[: len(r) + 1]) / len(p)) if p else 0.0 for k, p in runs.items() for j, r in enumerate(refs.values())}
    assert {(r.run_id, r.bank_idx): r.dl for r in out.collect()} == pytest.approx(want)


def test_set_distances(spark):
    runs, refs = runs_of(3, 20), runs_of(4, 5, "abd")
    out = distances.set_distances(events_of(spark, runs), bank_of(spark, refs)).collect()
    assert len(out) == sum(map(len, runs.values())) * len(refs)
    grams = lambda l, n: [tuple(l[i : i + n]) for i in range(len(l) - n + 1)]
    jac = lambda a, b: 0.0 if not a else 1 - len(a & b) / len(a | b)
    for row in out:
        p, r = runs[row.run_id][: row.pos + 1], list(refs.values())[row.bank_idx]
        n = len(p)
        assert row.jaccard == pytest.approx(jac(set(p), set(r)))
        assert row.jaccard_prefix == pytest.approx(jac(set(p), set(r[:n])))
        assert row.containment == pytest.approx(1 - len(set(p) & set(r)) / len(set(p)))
        assert row.ngram2_jaccard == pytest.approx(jac(set(grams(p, 2)), set(grams(r, 2))))
        assert row.ngram3_jaccard == pytest.approx(jac(set(grams(p, 3)), set(grams(r, 3))))
        assert row.ngram2_jaccard_prefix == pytest.approx(jac(set(grams(p, 2)), set(grams(r[:n], 2))))
        dot = sum(p.count(x) * r.count(x) for x in set(p))
        norm = lambda l: math.sqrt(sum(l.count(x) ** 2 for x in set(l)))
        assert row.cosine_count == pytest.approx(max(0, 1 - dot / norm(p) / norm(r)), abs=1e-9)


def test_set_distances_of_a_long_run(spark):
    """50,000 different labels in one run, and references that lag behind it."""
    n = 50_000
    run = spark.range(n).selectExpr("'r' AS run_id", "cast(id AS int) AS pos", "concat('l', id) AS act")
    bank = spark.sql(f"SELECT 'x' AS ref_id, 0 AS bank_idx, transform(sequence(0, 999), i -> concat('l', i * 3)) AS labels, 1000 AS n, 't' AS task_id UNION ALL SELECT 'y', 1, transform(sequence(0, {n - 1}), i -> concat('l', {n} - 1 - i)), {n}, 't'")
    out = {(r.bank_idx, r.pos): r for r in distances.set_distances(run, bank, ("jaccard", "jaccard_prefix", "ngram2_jaccard_prefix")).filter("pos IN (0, 100, 1499, 30000, 49999)").collect()}
    for pos in (0, 100, 1499, 30000, 49999):
        p = {*range(pos + 1)}
        for idx, ref in ((0, [i * 3 for i in range(1000)]), (1, list(range(n - 1, -1, -1)))):
            cut = {*ref[: pos + 1]}
            assert out[idx, pos].jaccard == pytest.approx(1 - len(p & {*ref}) / len(p | {*ref})) and out[idx, pos].jaccard_prefix == pytest.approx(1 - len(p & cut) / len(p | cut))
            assert out[idx, pos].ngram2_jaccard_prefix == (1 if pos else 0)


def test_unknown_names(spark):
    e, b = events_of(spark, {"r": ["a"]}), bank_of(spark, {"x": ["a"]})
    with pytest.raises(ValueError):
        distances.set_distances(e, b, ("nope",))
    with pytest.raises(ValueError):
        declare.model(spark, [("nope", "a", None, None)])
    with pytest.raises(ValueError):
        declare.scores(e, None)


def test_aggregators_and_quantile(spark):
    rng = np.random.default_rng(0)
    values = [[float(x) for x in rng.random(n)] for n in (1, 2, 3, 7)] + [[]]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(v,) for v in values], "d array<double>")
    cols = [nearest(F.col("d"), h, 3, 0.25).alias(h) for h in ("min", "max_knn", "mean_knn", "quantile", "mean")]
    for v, row in zip(values, df.select(*cols, upper_rank(F.col("d"), 0.9).alias("q")).collect()):
        if not v:
            assert row["min"] == row.max_knn == row["mean"] == 0 and row.q == math.inf
            continue
        s = sorted(v)
        assert row["min"] == s[0] and row.max_knn == s[min(3, len(s)) - 1]
        assert row.mean_knn == pytest.approx(np.mean(s[:3])) and row["mean"] == pytest.approx(np.mean(s)) and row["quantile"] == pytest.approx(np.quantile(s, 0.25))
        assert row.q == s[min(len(s) - 1, math.ceil(0.9 * (len(s) - 1)))]


def batch(t, a, b, n, l):
    """Whether a finished run satisfies a constraint, from the definitions over index lists."""
    ia, ib = [i for i, x in enumerate(l) if x == a], [i for i, x in enumerate(l) if x == b]
    resp = all(any(j > i for j in ib) for i in ia)
    prec = all(any(i < j for i in ia) for j in ib)
    return {
        "init": l[0] == a, "end": l[-1] == a, "existence": len(ia) >= (n or 1), "absence": len(ia) < (n or 1), "exactly": len(ia) == (n or 1),
        "response": resp, "precedence": prec, "succession": resp and prec,
        "alternate_response": all(any(i < j and not any(i < k <= j for k in ia) for j in ib) for i in ia),
        "alternate_precedence": all(any(i < j and not any(i <= k < j for k in ib) for i in ia) for j in ib),
        "chain_response": all(i + 1 in ib for i in ia), "chain_precedence": all(j - 1 in ia for j in ib),
        "chain_succession": all(i + 1 in ib for i in ia) and all(j - 1 in ia for j in ib),
        "not_succession": not any(i < j for i in ia for j in ib), "not_chain_succession": not any(i + 1 in ib for i in ia),
        "coexistence": bool(ia and ib), "choice": bool(ia or ib), "exclusive_choice": bool(ia) != bool(ib), "not_coexistence": not (ia and ib),
    }[t]


def test_final_verdicts_match_definitions(spark):
    runs = runs_of(5, 60, "abc", 6)
    cons = [(t, "a", None if t in declare.UNARY else "b", 2 if t in declare.COUNTING else None) for t in declare.TEMPLATES]
    out = declare.satisfied(events_of(spark, runs), declare.model(spark, cons)).collect()
    assert len(out) == len(runs) * len(cons)
    for row in out:
        assert row.satisfied == batch(*cons[row.cid], runs[row.run_id]), (cons[row.cid], runs[row.run_id])


def test_absorbing_states(spark):
    v = declare.verdicts(events_of(spark, runs_of(6, 40)), declare.model(spark, [(t, "a", None if t in declare.UNARY else "b", 1 if t in declare.COUNTING else None) for t in declare.TEMPLATES])).orderBy("run_id", "cid", "pos").collect()
    before = {}
    for row in v:
        k = (row.run_id, row.cid)
        if before.get(k) in (0, 3):
            assert row.state == before[k]
        before[k] = row.state


def seen(t, a, b, n, l):
    """(witnessed, activated) by a prefix, from its places of a and b."""
    ia, ib = [i for i, x in enumerate(l) if x == a], [i for i, x in enumerate(l) if x == b]
    before, next_to = any(i < j for i in ia for j in ib), any(i + 1 in ib for i in ia)
    chain = t.startswith("chain_")
    witnessed = {"init": l[0] == a, "existence": len(ia) >= (n or 1), "coexistence": bool(ia and ib)}.get(t, t in declare.WITNESSABLE and (next_to if chain else before))
    source = ("existence", "absence", "exactly", "response", "alternate_response", "chain_response", "not_succession", "not_chain_succession")
    target = ("precedence", "alternate_precedence", "chain_precedence")
    return witnessed, True if t in ("init", "end") else bool(ia) if t in source else bool(ib) if t in target else bool(ia or ib)


def test_verdicts_of_every_prefix(spark):
    """Four values from what a finished run is: satisfied now, and by some or all of its continuations."""
    texts = ["".join(x) for n in range(1, 5) for x in itertools.product("abx", repeat=n)]
    more = ["".join(x) for n in range(4) for x in itertools.product("abx", repeat=n)]
    cons = [(t, "a", None if t in declare.UNARY else "b", 2 if t in declare.COUNTING else None) for t in declare.TEMPLATES]
    out = declare.verdicts(events_of(spark, {x: list(x) for x in texts}), declare.model(spark, cons)).collect()
    assert len(out) == len(cons) * sum(map(len, texts))
    want = {}
    for x in texts:
        for c in cons:
            now, later = batch(*c, list(x)), [batch(*c, list(x + y)) for y in more]
            want[x, c] = (3 if all(later) else 2) if now else (1 if any(later) else 0), *seen(*c, list(x))
    for row in out:
        c, x = cons[row.cid], row.run_id[: row.pos + 1]
        assert (row.state, row.witness, row.activated) == want[x, c], (c, x)


def test_verdicts_share_columns_of_a_pair(spark):
    """Constraints on one pair, in any order and with others between them, are judged alone."""
    runs = events_of(spark, runs_of(21, 15))
    cons = [("response", "a", "b", None), ("init", "b", None, None), ("precedence", "a", "b", None), ("response", "b", "a", None), ("response", "a", "a", None), ("init", "a", None, None)]
    both = {(r.run_id, r.pos, r.cid): r.state for r in declare.verdicts(runs, declare.model(spark, cons)).collect()}
    for i, c in enumerate(cons):
        alone = declare.verdicts(runs, declare.model(spark, [c])).collect()
        assert alone and all(both[r.run_id, r.pos, i] == r.state for r in alone)


def test_edit_scores_reduce_distances(spark):
    """Scores reduced in the tasks are those of the distances, with and without a run's own place."""
    runs, refs = runs_of(14, 30, "abcd", 12), runs_of(15, 7, "abce")
    how = {f"{d}-{h}": (d, h, 3, 0.25) for d in distances.EDIT_DISTANCES for h in ("min", "max_knn", "mean_knn", "quantile", "mean")}
    bank = bank_of(spark, refs)
    for own in (False, True):
        t = traces_of(spark, runs)
        if own:
            t = t.withColumn("own", F.crc32("run_id") % 8 - 1)
        left = {r.run_id: r.own if own else -1 for r in t.collect()}
        got = {(r.run_id, r.pos): r for r in distances.edit_scores(t, bank, how).collect()}
        for r in distances.edit_distances(t, bank).collect():
            for name, (d, h, k, q) in how.items():
                s = sorted(x for i, x in enumerate(r[d]) if i != left[r.run_id])
                want = {"min": s[0], "max_knn": s[2], "mean_knn": np.mean(s[:3]), "quantile": np.quantile(s, 0.25), "mean": np.mean(s)}[h]
                assert got[r.run_id, r.pos][name] == pytest.approx(want)


def test_block_scores_equal_edit_scores(spark):
    """Banks read in blocks, with references left out by their bounds: all scores, with and without a run's own place."""
    runs, refs = runs_of(41, 25, "abcdx", 12), runs_of(42, 60, "abcde", 10)
    how = {f"{d}-{h}": (d, h, 3, 0.25) for d in distances.EDIT_DISTANCES for h in ("min", "max_knn", "mean_knn", "quantile", "mean")}
    bank = bank_of(spark, refs)
    for own in (False, True):
        t = traces_of(spark, {**runs, "none": []})
        t = t.withColumn("own", F.crc32("run_id") % 60) if own else t
        want = {(r.run_id, r.pos): r for r in distances.edit_scores(t, bank, how).collect()}
        got = distances.block_scores(t, bank, how, block=16, at_once=5).collect()
        assert len(got) == len(want) == sum(map(len, runs.values()))
        for r in got:
            assert r[2:] == pytest.approx(want[r.run_id, r.pos][2:]), (r.run_id, r.pos)
    few = {n: h for n, h in how.items() if h[1] in ("min", "max_knn")}
    assert {tuple(r) for r in distances.block_scores(traces_of(spark, runs), bank, few, at_once=2).collect()} == {tuple(r) for r in distances.edit_scores(traces_of(spark, runs), bank, few).collect()}
    assert all(r.s == 0 for r in distances.block_scores(traces_of(spark, runs), bank.filter("false"), {"s": ("dl", "min", 3, 0.25)}).collect())


def test_bank_of_twenty_thousand(spark):
    """A bank too large to broadcast is read in blocks; distances by reference are refused for it, never cut."""
    rng = random.Random(6)
    refs = {f"b{i}": [rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))] for i in range(20_000)}
    bank, runs = bank_of(spark, refs), runs_of(3, 4, "abcdefghi", 8)
    got = {(r.run_id, r.pos): r.s for r in distances.edit_scores(traces_of(spark, runs), bank, {"s": ("dl", "max_knn", 3, 0.25)}).collect()}
    for r, l in runs.items():
        p = l[:3]
        if len(l) >= 3:
            assert got[r, 2] == pytest.approx(sorted(min(1, min(osa(p, x)) / 3) for x in refs.values())[2])
    assert len(got) == sum(map(len, runs.values()))
    for f in (lambda: distances.edit_distances(traces_of(spark, runs), bank), lambda: distances.set_distances(events_of(spark, runs), bank), lambda: structure.dfg_fitness(traces_of(spark, runs), bank)):
        with pytest.raises(ValueError):
            f()


def test_mining_supports(spark):
    runs = runs_of(7, 12, "abc", 5)
    mined = {(r.template, r.a, r.b, r.n): r for r in mining.mine(events_of(spark, runs), cumulative=True).collect()}
    for (t, a, b, n), row in mined.items():
        if t in declare.COUNTING or t in ("init", "end") or t in declare.UNORDERED + declare.NEGATION:
            holds = sum(batch(t, a, b, n, l) for l in runs.values())
        else:  # only runs with both labels count
            holds = sum(a in l and b in l and (t in ("not_succession", "not_chain_succession") or l.index(a) < len(l) - 1 - l[::-1].index(b)) and batch(t, a, b, n, l) for l in runs.values())
        assert row.matches == holds, (t, a, b, n)


def test_ordered_pairs_need_only_their_events(spark):
    """What a run tells of a pair stands in the events that concern it: the same rows as with all of a run's events."""
    events = events_of(spark, runs_of(17, 60, "abcdef", 14))
    e = events.select("run_id", "pos", "act", F.lag("act").over(mining.run_order()).alias("prev"), F.lead("act").over(mining.run_order()).isNull().alias("ends"))
    acts = e.select("run_id", "act").distinct()
    grid = e.join(acts.select("run_id", F.col("act").alias("a")), "run_id").join(acts.select("run_id", F.col("act").alias("b")), "run_id").cache()
    told = lambda g: {tuple(r) for r in declare.last_rows(declare.running_columns(g.select("run_id", "pos", "act", "prev", "a", "b"), ["run_id", "a", "b"]), "a", "b").collect()}
    few = mining.concerned(grid).cache()
    assert few.count() < 0.7 * grid.count() and told(few) == told(grid)


def test_walk_and_replay(spark):
    runs, refs = runs_of(8, 20), runs_of(9, 4)
    walk = {(r.run_id, r.pos): r for r in structure.walk_features(events_of(spark, runs)).collect()}
    fit = {(r.run_id, r.pos): r.score for r in structure.dfg_fitness(traces_of(spark, runs), bank_of(spark, refs)).collect()}
    pred, first = {}, set()
    for l in refs.values():
        first.add(l[0])
        for a, b in zip(l, l[1:]):
            pred.setdefault(b, set()).add(a)
    for k, l in runs.items():
        left, back, marks, missing = set(), 0, {"<start>": 1}, 0
        for i, x in enumerate(l):
            if i and l[i - 1] != x:
                left.add(l[i - 1])
            back += x in left
            assert walk[k, i].return_rate == pytest.approx(back / (i + 1))
            assert walk[k, i].edge_novelty == pytest.approx(len(set(zip(l[:i], l[1 : i + 1]))) / i if i else 0)
            src = sorted(s for s in pred.get(x, set()) | ({"<start>"} if x in first else set()) if marks.get(s, 0) > 0)
            if src:
                marks[src[0]] -= 1
            else:
                missing += 1
            marks[x] = marks.get(x, 0) + 1
            assert fit[k, i] == pytest.approx(missing / (i + 1))


def test_leave_one_out_profiles(spark):
    refs = runs_of(10, 6, "abc", 9)
    bank = bank_of(spark, refs)
    e = structure.as_events(bank)
    out = {(r.run_id, r.pos): r for r in structure.profile_scores(e, e, leave_out=True).collect()}
    progress = {(r.run_id, r.pos): r.score for r in structure.graph_progress(e, bank, leave_out=True).collect()}
    legal = {(r.run_id, r.pos): r.score for r in structure.df_legality(e, bank, leave_out=True).collect()}
    for k in refs:
        rest = bank_of(spark, {x: l for x, l in refs.items() if x != k})
        mine = e.filter(e.run_id == k)
        for r in structure.profile_scores(mine, structure.as_events(rest)).collect():
            assert out[k, r.pos].cycle_absz == pytest.approx(r.cycle_absz, abs=1e-6) and out[k, r.pos].edge_absz == pytest.approx(r.edge_absz, abs=1e-6)
        for r in structure.graph_progress(mine, rest).collect():
            assert progress[k, r.pos] == pytest.approx(r.score)
        for r in structure.df_legality(mine, rest).collect():
            assert legal[k, r.pos] == pytest.approx(r.score)


def test_decide_patience(spark):
    curves = {"a": [0.9, 0.9, 0.1, 0.9, 0.9], "b": [0.9, 0.1, 0.9, 0.1, 0.9], "c": [0.5, 0.5, 0.5, 0.5, 0.5], "d": [0.1, 0.1, 0.9, 0.9, 0.9]}
    s = spark.createDataFrame([(k, i, x) for k, c in curves.items() for i, x in enumerate(c)], "run_id string, pos int, score double")
    for patience, want in ((1, {"a": 4, "b": 3, "d": 3}), (2, {"a": 5, "d": 4}), (3, {"d": 5})):
        out = {r.run_id: r.step for r in evaluate.decide(s, spark.createDataFrame([(0.5,)], "threshold double"), 3, patience).collect() if r.fired}
        assert out == want


def test_areas(spark):
    rng = random.Random(3)
    rows = [(f"r{i}", rng.choice([0.1, 0.2, 0.5, 0.9]), rng.randint(0, 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "run_id string, score double, label int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert evaluate.auc_roc(df).first()[0] == pytest.approx(want)
    order, tp, ap = sorted(rows, key=lambda r: (-r[1], r[0])), 0, 0.0
    for k, (_, _, y) in enumerate(order, 1):
        tp += y
        ap += tp / k if y else 0
    assert evaluate.auc_pr(df).first()[0] == pytest.approx(ap / len(pos))


def test_order_statistics(spark):
    """Ranks over several partitions: ties, several keys, nulls, no rows."""
    from drifthound.operators.order import running_sums, upper_nearest_rank

    rng = random.Random(17)
    rows = [(rng.choice("xy"), rng.choice([None, *[round(rng.random(), 1)] * 6]), rng.randint(0, 5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, peak double, w long").repartition(5)
    for q in (0.0, 0.5, 0.9, 0.95, 0.99, 1.0):
        got = {r.k: r.peak for r in upper_nearest_rank(df, "peak", q, ("k",)).collect()}
        every = {g: sorted(v for k, v, _ in rows if k == g and v is not None) for g in "xy"}
        assert got == {g: v[math.ceil(q * (len(v) - 1))] for g, v in every.items()}
        assert evaluate.threshold(df, q).first()[0] == sorted(v for _, v, _ in rows if v is not None)[math.ceil(q * (sum(v is not None for _, v, _ in rows) - 1))]
    assert evaluate.threshold(df.filter("false"), 0.9).first()[0] == math.inf and evaluate.threshold(df.filter("false"), 0.9, ("k",)).collect() == []
    unique = spark.createDataFrame([(i % 3, i, i % 7) for i in range(100)], "k int, at int, w long").repartition(6)
    for keys in ((), ("k",)):
        for r in running_sums(unique, ("at",), ("w",), keys).collect():
            same = [i for i in range(100) if not keys or i % 3 == r.k]
            assert (r.w_before, r.w_total) == (sum(i % 7 for i in same if i < r["at"]), sum(i % 7 for i in same))


def test_bank_edits_and_names(spark):
    b = bank_of(spark, {"x": ["a", "b"], "y": ["a"]})
    assert banks.mean_length(banks.add_to_bank(b, traces_of(spark, {"z": ["a"] * 6}))).first() == (3, 3.0)
    assert banks.remove_from_bank(b, "x").count() == 1
    assert banks.ScoreConfig().label() == "dl/max_knn@3" and banks.ScoreConfig("jaccard", "min").label() == "jaccard/min"
    assert banks.ScoreConfig("dl", "quantile", q=0.5).label() == "dl/quantile@0.5" and banks.ScoreConfig("dl", "mean_knn", 4).label() == "dl/mean_knn@4" and banks.ScoreConfig(name="x").label() == "x"
    assert baselines.random_score(events_of(spark, {"r": ["a", "b"]})).select("score").distinct().count() == 1


def streamed(spark, folder, batches, bank, model=None):
    """Rows (run_id, second, event_id, act, kind, error, status, args_hash), batch by batch, through the stream; its output by (run, pos)."""
    from drifthound.streaming import scoring

    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "run_id string, ts long, event_id long, act string, kind string, error boolean, status string, args_hash string")
        df.selectExpr("run_id", "timestamp_seconds(ts) AS ts", "event_id", "act", "kind", "error", "status", "args_hash").write.parquet(str(folder / f"in/{n}"))
        stream = spark.readStream.schema("run_id string, ts timestamp, event_id long, act string, kind string, error boolean, status string, args_hash string").option("recursiveFileLookup", "true").parquet(str(folder / "in"))
        scoring.run_once(scoring.score_stream(stream, bank, model), str(folder / "out"), str(folder / "state"))
    return {(r.run_id, r.pos): r for r in spark.read.parquet(str(folder / "out")).collect()}


def test_live_scores_equal_those_of_whole_runs(spark, tmp_path):
    """All scores, for runs cut over three batches, with labels that the bank doesn't have, messages between tool calls, and late events."""
    runs, refs = runs_of(11, 9, "abcde", 12), runs_of(12, 5, "abcf")
    kinds = {"a": "user", "b": "respond"}
    rows = {r: [(r, i, i, x, kinds.get(x, "tool"), x == "c", {"c": "policy", "d": "empty"}.get(x, "ok"), x if i % 3 else None) for i, x in enumerate(l)] for r, l in runs.items()}
    batches = [[e for l in rows.values() for e in l[len(l) * k // 3 : len(l) * (k + 1) // 3]] for k in range(3)]
    first = next(l for l in rows.values() if len(l) > 6)[0]
    bank = bank_of(spark, refs)
    model = declare.model(spark, [(t, a, None if t in declare.UNARY else b, 2 if t in declare.COUNTING else None) for t in declare.TEMPLATES for a, b in (("a", "b"), ("c", "c"), ("b", "e"), ("f", "a"))])
    got = streamed(spark, tmp_path, [batches[0], [*batches[1], first], batches[2]], bank, model)
    assert len(got) == sum(map(len, runs.values()))
    assert max(r.late for (run, _), r in got.items() if run == first[0]) == 1 and all(r.late == 0 for (run, _), r in got.items() if run != first[0])

    events = spark.createDataFrame([(r, i, x, r, kind, error, status, h, len(l), True) for r, l in rows.items() for _, i, _, x, kind, error, status, h in l], "run_id string, pos int, act string, task_id string, kind string, error boolean, status string, args_hash string, n int, success boolean").cache()
    traces = traces_of(spark, runs)
    third = lambda df, *cols: df.groupBy("run_id", "pos").agg(*[nearest(F.collect_list(c), "min" if c == "containment" else "max_knn", 3).alias(c) for c in cols])
    own = spark.createDataFrame([(k, i) for i, k in enumerate(refs)], "run_id string, bank_idx int")
    ref_events = structure.as_events(bank)
    theirs = declare.verdicts(ref_events, model).join(own, "run_id").drop("run_id")
    names = {"jaccard": "jaccard_knn", "jaccard_prefix": "jaccard_prefix_knn", "containment": "containment_min", "ngram2_jaccard": "ngram2_jaccard_knn", "ngram2_jaccard_prefix": "ngram2_jaccard_prefix_knn", "ngram3_jaccard": "ngram3_jaccard_knn", "cosine_count": "cosine_knn"}
    score = lambda df, name: df.select("run_id", "pos", F.col("score").alias(name))
    tables = [
        third(distances.set_distances(events, bank, tuple(names)), *names).withColumnsRenamed(names),
        distances.edit_scores(traces, bank, {n: (d, "max_knn", 3, 0.25) for n, d in (("edit_knn", "dl"), ("edit_full_knn", "dl_full"), ("edit_trunc_knn", "dl_trunc"))}),
        structure.walk_features(events).drop("act"), structure.profile_scores(events, ref_events), baselines.counted_scores(events),
        score(structure.df_legality(events, bank), "df_legality"), score(structure.graph_progress(events, bank), "graph_progress"), score(structure.dfg_fitness(traces, bank), "dfg_fitness"),
        score(baselines.ngram_score(events, bank, 0), "ngram0"), score(baselines.ngram_score(events, bank, 1), "ngram1"), score(structure.step_surprisal(events, bank, ref_events), "step_surprisal"),
        declare.scores(events, model, wanted=("dcl_pos_viol",)).withColumnRenamed("dcl_pos_viol", "dcl_viol"),
        third(declare.signature_distances(declare.verdicts(events, model), theirs), "d").withColumnRenamed("d", "dcl_div"),
    ]
    from drifthound.streaming import scoring

    compared = set()
    for t in tables:
        for r in t.collect():
            for c in t.columns[2:]:
                assert got[r.run_id, r.pos][c] == pytest.approx(r[c], abs=1e-9), (c, runs[r.run_id][: r.pos + 1])
                compared.add(c)
    assert compared == set(scoring.SCORES)


def test_live_scores_without_attributes_or_bank(spark, tmp_path):
    from drifthound.streaming import scoring

    rows = [("r", i, i, x) for i, x in enumerate("abab")]
    spark.createDataFrame(rows, "run_id string, ts long, event_id long, act string").selectExpr("run_id", "timestamp_seconds(ts) AS ts", "event_id", "act").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, ts timestamp, event_id long, act string").parquet(str(tmp_path / "in"))
    scoring.run_once(scoring.score_stream(stream, bank_of(spark, {"x": ["a"]}).filter("false")), str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()
    assert len(out) == 4 and all(r.error_rate == r.repeat_rate == r.policy_count == r.edit_knn == r.jaccard_knn == r.dcl_viol == 0 for r in out)
    assert [r.return_rate for r in out] == pytest.approx([0, 0, 1 / 3, 1 / 2])


class Kept:
    """A stand-in for what Spark gives a stateful processor: maps that count their calls, and timers."""

    def __init__(self):
        self.maps, self.timers, self.calls, self.now = {}, [], 0, 0

    def getMapState(self, name, *_):  # noqa: N802
        outer, held = self, self.maps.setdefault(name, {})

        def called(f):
            def counted(*a):
                outer.calls += 1
                return f(*a)
            return counted

        return type("Map", (), {k: staticmethod(called(f)) for k, f in {
            "containsKey": held.__contains__, "getValue": held.__getitem__, "updateValue": held.__setitem__, "removeKey": held.pop, "iterator": lambda: iter(list(held.items())), "keys": lambda: iter(list(held))}.items()})

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.now


def test_live_runs_of_a_bucket_are_scored_together(monkeypatch):
    """State is read and written once a run and batch, steps are as many as the longest run has; the scores are those of events that come one by one, also where the keys of a run don't fit its row."""
    import pandas as pd

    from drifthound.streaming import scoring

    runs, refs = runs_of(41, 30, "abcde", 20), list(runs_of(42, 5, "abcf").values())
    model = [(t, a, None if t in declare.UNARY else b, 2 if t in declare.COUNTING else None) for t in declare.TEMPLATES for a, b in (("a", "b"), ("c", "c"), ("b", "e"))]
    rows = pd.DataFrame([(r, pd.Timestamp(i, unit="s"), i, x, "tool", x == "c", "ok", f"{r}{i % 7}") for r, l in runs.items() for i, x in enumerate(l)], columns=["run_id", "ts", "event_id", "act", "kind", "error", "status", "args_hash"])

    def scored(batches, **options):
        kept, steps = Kept(), []
        s = scoring.RunScorer(refs, model, **options)
        s.init(kept)
        step = s.bank.step
        s.bank.step = lambda *a, **b: steps.append(1) or step(*a, **b)
        out = pd.concat([x for b in batches for x in s.handleInputRows((0,), iter([b]), kept)])
        return s, kept, len(steps), out.sort_values(["run_id", "pos"]).reset_index(drop=True)

    _, kept, steps, whole = scored([rows])
    assert len(whole) == sum(map(len, runs.values())) and steps == max(map(len, runs.values())) and kept.calls <= 2 * len(runs) and not kept.maps["grown"]
    monkeypatch.setattr(scoring, "FEW", 4)
    s, kept, _, single = scored([rows[rows.event_id == i] for i in range(20)], expire_ms=1000)
    assert kept.maps["grown"] and all(len(v[5]) < 400 for v in kept.maps["runs"].values())
    pd.testing.assert_frame_equal(whole, single, check_exact=False, atol=1e-12)

    # state goes with its run, and not before
    assert len(kept.timers) == 1
    kept.now, kept.timers = 600, []
    list(s.handleInputRows((0,), iter([rows.assign(event_id=99, ts=pd.Timestamp(99, unit="s"))[rows.run_id == "r3"][:1]]), kept))
    kept.now, kept.timers = 1000, []
    list(s.handleExpiredTimer((0,), kept, kept))
    assert list(kept.maps["runs"]) == [("r3",)] and {r for r, _ in kept.maps["grown"]} <= {"r3"} and kept.timers == [1600]


def test_monitors_wake_only_what_an_event_can_change():
    from drifthound.streaming.monitors import Monitors

    rng, cons = random.Random(4), [(t, a, None if t in declare.UNARY else b, 2 if t in declare.COUNTING else None) for t in declare.TEMPLATES for a, b in itertools.product("abcd", "abcd")]
    m = Monitors(cons)
    pairs, v, active, woken, prev = m.start(), np.zeros(m.size, np.uint8), np.zeros(m.size, bool), [], None
    for i in range(200):
        x = rng.choice("abcdxyz")
        before = v.copy(), active.copy()
        woken.append(m.push(pairs, v, active, x, prev, i))
        touched = [c for c, (_, a, b, _) in enumerate(cons) if x in (a, b) or prev == a]
        if i:
            changed = np.flatnonzero((v != before[0]) | (active != before[1]))
            assert set(changed) <= set(touched)
        prev = x
    assert min(woken) == 0 and max(woken[1:]) < len(m.pairs)


def walks_of(seed, count):
    """Runs over a small graph of labels, so that some constraints hold in all of them."""
    rng, after = random.Random(seed), {"a": "bbc", "b": "cad", "c": "abd", "d": "dab"}
    out = {}
    for i in range(count):
        out[f"r{i}"] = ["a"]
        for _ in range(rng.randint(0, 9)):
            out[f"r{i}"].append(rng.choice(after[out[f"r{i}"][-1]]))
    return out


def test_curves_of_all_draws_equal_those_of_each(spark):
    """Every detector of every draw at once, against the scores of one bank at a time, with and without the run's own part."""
    from drifthound.operators import mining
    from drifthound.plans import detectors

    runs = walks_of(5, 60)
    events = events_of(spark, runs).withColumn("success", F.substring("run_id", 2, 9).cast("int") % 4 != 0).cache()
    traces = detectors.traces_of(events).cache()
    drawn = banks.draw_banks(traces, 8, (0, 1)).cache()
    draws = [(5, 0, 4), (7, 1, 8)]
    got = {(r.draw, r.loo, r.run_id, r.detector): r.curve for r in detectors.draw_curves(events, drawn, draws).collect()}
    for draw, seed, k in draws:
        bank = banks.draw_bank(traces, k, seed).cache()
        ids = [r.ref_id for r in bank.orderBy("bank_idx").collect()]
        assert ids == [r.ref_id for r in drawn.filter(f"seed = {seed} AND bank_idx < {k}").orderBy("bank_idx").collect()]
        model = mining.as_model(mining.mine(structure.as_events(bank), support=1.0, cumulative=True))
        assert model.take(1)
        attributes = {"kind": F.lit("tool"), "error": F.lit(False), "status": F.lit("ok"), "args_hash": F.lit(None).cast("string"), "success": F.lit(True), "task_id": F.lit(None).cast("string")}
        for loo, part in ((False, events.filter(~F.col("run_id").isin(ids))), (True, structure.as_events(bank).withColumns(attributes))):
            want = {}
            for r in detectors.all_scores(part, bank, model, leave_out=loo).collect():
                want.setdefault((draw, loo, r.run_id, r.detector), {})[r.pos] = r.score
            for key, curve in want.items():
                if loo or len(runs[key[2]]) >= 3:
                    assert got.pop(key) == pytest.approx([curve[p] for p in range(len(curve))], abs=1e-6), key
    assert not got


def test_curves_carry_the_ends_of_their_runs(spark):
    """Curves of distances alone come with n and success from the task that makes them: nothing is joined to them."""
    from drifthound.plans import detectors

    runs = walks_of(6, 40)
    events = events_of(spark, runs).withColumn("success", F.substring("run_id", 2, 9).cast("int") % 4 != 0).cache()
    drawn = banks.draw_banks(detectors.traces_of(events), 8, (0,)).cache()
    for wanted in (("jac/max@3",), ("dl/min",), ("jac/min", "dl/min")):
        curves = detectors.draw_curves(events, drawn, [(3, 0, 8)], detectors=wanted)
        assert "Join" not in curves._jdf.queryExecution().optimizedPlan().toString()
        rows = curves.collect()
        assert {(r.run_id, r.detector) for r in rows} == {(k, d) for k, l in runs.items() for d in wanted if r_kept(k, l, rows)}
        assert all(r.n == len(runs[r.run_id]) == len(r.curve) and r.success == (int(r.run_id[1:]) % 4 != 0) for r in rows)


def r_kept(run, labels, rows):
    return len(labels) >= 3 or any(r.run_id == run and r.loo for r in rows)


def test_sweep_of_several_draws(spark):
    """All draws are one plan; a draw without enough good runs, or of one class, is skipped and says why."""
    from drifthound.plans import detectors

    events = events_of(spark, runs_of(13, 30, "abcd", 9))
    mixed = events.withColumn("success", F.substring("run_id", 2, 9).cast("int") % 3 != 0)
    cells, skipped = detectors.sweep_all({"mixed": mixed, "good": events}, seeds=(0, 1), sizes=(4, 64), support=0.5, quantiles=(0.9,))
    assert set(skipped) == {("mixed", 0, 64), ("mixed", 1, 64), *(("good", s, k) for s in (0, 1) for k in (4, 64))} and "class" in skipped["good", 0, 4] and "bank" in skipped["mixed", 0, 64]
    rows = cells.collect()
    assert {(r.source, r.k, r.seed) for r in rows} == {("mixed", 4, 0), ("mixed", 4, 1)} and {r.detector for r in rows} == set(detectors.SWEPT)
    one = {(r.detector, r.q, r.w): r for r in detectors.sweep(mixed, 4, 1, support=0.5, quantiles=(0.9,)).collect()}
    for r in rows:
        if r.seed == 1:
            same = one[r.detector, r.q, r.w]
            assert (r.threshold, r.tp, r.fp, r.pos, r.neg) == (same.threshold, same.tp, same.fp, same.pos, same.neg)
            assert (r.earliness_frac or 0) == pytest.approx(same.earliness_frac or 0)
    assert detectors.sweep_draws(events, sizes=(4,))[0].collect() == []


def test_constraint_curves_equal_verdict_grid(spark, monkeypatch):
    """The sweep's constraint scores, without the grid (run, position, pair), equal those of verdicts; one draw has no constraints, one no other reference."""
    from drifthound.plans import detectors

    runs = {k: v for k, v in runs_of(51, 40, "abcd", 9).items()}
    refs = {k: runs[k] for k in list(runs)[:6]}
    draws = [list(refs)[:4], list(refs)[2:], list(refs)[:3], [list(refs)[0]]]
    cons = [(t, a, None if t in declare.UNARY else b, 2 if t in declare.COUNTING else None) for t in declare.TEMPLATES for a, b in itertools.product("abe", "abd")]
    of_draw = {5: [c for c in range(len(cons)) if c % 3], 7: list(range(0, len(cons), 2)), 8: [], 9: list(range(40))}
    models = spark.createDataFrame([(d, c, *cons[c]) for d, cids in of_draw.items() for c in cids], "draw int, cid int, template string, a string, b string, n int")
    monkeypatch.setattr(declare, "verdicts", lambda *_: pytest.fail("a row for each event and pair"))
    rows = detectors._constraint_curves(traces_of(spark, runs), refs, draws, list(of_draw), models, 3).collect()
    monkeypatch.undo()
    v = declare.verdicts(events_of(spark, runs), declare.model(spark, cons)).collect()
    signed, broken = {}, {}
    for r in v:
        if r.activated:
            signed.setdefault((r.run_id, r.pos), set()).add((r.cid, r.state))
        if r.state == 0:
            broken.setdefault((r.run_id, r.pos), set()).add(r.cid)
    want = {}
    for (d, cids), draw in zip(of_draw.items(), draws):
        held = set(cids)
        of = lambda run, pos: {x for x in signed.get((run, pos), ()) if x[0] in held}  # noqa: B023, E731
        for run, labels in runs.items():
            others = [x for x in draw if x != run]
            if not held or not others or run not in draw and len(labels) < 3:
                continue
            want[run, d, "dcl_viol"] = [1 - math.exp(-len(broken.get((run, i), set()) & held) / 8) for i in range(len(labels))]
            curve = []
            for i in range(len(labels)):
                far = sorted(1 - len(of(run, i) & t) / len(of(run, i) | t) if of(run, i) | t else 0.0 for t in (of(x, min(i, len(refs[x]) - 1)) for x in others))
                curve.append(far[min(3, len(far)) - 1])
            want[run, d, "dcl_div"] = curve
    assert {(r.run_id, r.draw, r.detector) for r in rows} == set(want)
    for r in rows:
        assert r.curve == pytest.approx(want[r.run_id, r.draw, r.detector], abs=1e-12) and r.loo == (r.run_id in draws[list(of_draw).index(r.draw)]) and r.n == len(r.curve)


def test_walk_facts_are_dealt_by_size(spark, monkeypatch):
    """The sweep's walk facts take four sorts, no join, and as many tasks as the events ask for; values by plain Python."""
    from drifthound.plans import detectors

    runs, made = runs_of(61, 60, "abcd", 9), {}
    events = events_of(spark, runs)
    written = detectors.materialised
    monkeypatch.setattr(detectors, "materialised", lambda df, name: made.setdefault(name, df) and written(df, name))
    monkeypatch.setattr(detectors, "MOST_EVENTS", 20, raising=False)
    traces = traces_of(spark, runs)
    detectors.draw_curves(events, banks.draw_banks(traces, 4, (0,)), [(0, 0, 4)], detectors=("return_rate",))
    plan = made["facts"]._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and made["facts"].rdd.getNumPartitions() == -(-events.count() // 20)
    assert made["facts"]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Sort [") <= 4
    for r in made["facts"].collect():
        l = runs[r.run_id]
        assert (r.act, r.prev, r.own_c, r.own_s, r.n) == (l[r.pos], l[r.pos - 1] if r.pos else None, l.count(r.act), sum(i + 1 for i, x in enumerate(l) if x == r.act), len(l))
        back = sum(any(x == l[j] and l[i + 1] != x for i, x in enumerate(l[:j])) for j in range(r.pos + 1))
        assert r.return_rate == pytest.approx(back / (r.pos + 1)) and r.edge_novelty == pytest.approx(len(set(zip(l[: r.pos + 1], l[1 : r.pos + 1]))) / r.pos if r.pos else 0)


def test_fired_steps_equal_decisions(spark):
    rng = random.Random(2)
    curves = {f"r{i}": [rng.choice([0.1, 0.5, 0.9]) for _ in range(rng.randint(1, 12))] for i in range(60)}
    flat = spark.createDataFrame([(k, i, x) for k, c in curves.items() for i, x in enumerate(c)], "run_id string, pos int, score double")
    for patience in (1, 2, 3):
        for start, limit in ((1, 0.1), (3, 0.5), (9, 0.5)):
            want = {r.run_id: r.step for r in evaluate.decide(flat, spark.createDataFrame([(limit,)], "threshold double"), start, patience).collect()}
            whole = spark.createDataFrame([(k, c, [(0.9, 1, start, limit)]) for k, c in curves.items()], "run_id string, curve array<double>, t array<struct<q:double,w:int,start:int,threshold:double>>")
            assert {r.run_id: r.step for r in evaluate.fired_steps(whole, "t", patience).collect()} == want


def test_mining_apart_equals_mining_alone(spark):
    runs = {f"{g}{k}": l for g in "xy" for k, l in runs_of(ord(g), 6, "abc", 5).items()}
    events = events_of(spark, runs)
    groups = spark.createDataFrame([(k, k[0]) for k in runs], "run_id string, side string")
    apart = {tuple(r) for r in mining.mine(events, cumulative=True, groups=groups).collect()}
    alone = {(g, *r) for g in "xy" for r in mining.mine(events.filter(F.col("run_id").startswith(g)), cumulative=True).collect()}
    assert apart == alone


def test_packed_signatures_equal_sets(spark):
    """All kinds, over more constraints than a word has bits, and with gaps in their numbers."""
    runs, refs = runs_of(31, 8, "abc", 6), runs_of(32, 3, "abd", 5)
    cons = [(t, a, None if t in declare.UNARY else b, 2 if t in declare.COUNTING else None) for t in declare.TEMPLATES for a, b in itertools.product("abc", "abd")]
    model = declare.model(spark, cons).filter("cid % 5 <> 1 AND cid NOT BETWEEN 60 AND 140")
    mine, theirs = declare.verdicts(events_of(spark, runs), model).cache(), declare.verdicts(events_of(spark, refs), model).cache()
    own = spark.createDataFrame([(k, i) for i, k in enumerate(refs)], "run_id string, bank_idx int")
    for kind in declare.SIGNATURES:
        sets = lambda v: {k: {(r.cid, r.sym) for r in rows} for k, rows in itertools.groupby(sorted(declare.signature(v, kind).collect()), lambda r: (r.run_id, r.pos))}  # noqa: B023, E731
        a, b = sets(mine), sets(theirs)
        for mode in ("prefix", "full"):
            out = declare.signature_distances(mine, theirs.join(own, "run_id").drop("run_id"), kind, mode).collect()
            assert len(out) == 3 * sum(map(len, runs.values()))
            for r in out:
                name = list(refs)[r.bank_idx]
                last = len(refs[name]) - 1
                p, q = a.get((r.run_id, r.pos), set()), b.get((name, min(r.pos, last) if mode == "prefix" else last), set())
                assert r.d == pytest.approx(1 - len(p & q) / len(p | q) if p | q else 0.0), (kind, mode)
