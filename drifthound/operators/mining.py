"""Mining constraints from runs, and choosing those that tell two classes apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import run_order
from .declare import COUNTING, DEFAULT_EXCLUDED, NEGATION, ORDERED, TEMPLATES, UNORDERED, WITNESSABLE, last_rows, running_columns

KEY = ["template", "a", "b", "n"]


def positional_rows(events: DataFrame) -> DataFrame:
    ends = events.groupBy("run_id").agg(F.min_by("act", "pos").alias("i"), F.max_by("act", "pos").alias("e"))
    rows = F.array(*[F.struct(F.lit(t).alias("template"), F.col(c).alias("a")) for t, c in (("init", "i"), ("end", "e"))])
    return ends.select("run_id", F.inline(rows)).select("run_id", "template", "a", F.lit(None).cast("string").alias("b"), F.lit(None).cast("int").alias("n"))


def existential_rows(events: DataFrame) -> DataFrame:
    c = events.groupBy("run_id", "act").agg(F.count("*").cast("int").alias("c"))
    rows = F.array(*[F.struct(F.lit(t).alias("template"), n.alias("n")) for t, n in (("exactly", F.col("c")), ("existence", F.col("c")), ("absence", F.col("c") + 1))])
    return c.select("run_id", F.col("act").alias("a"), F.inline(rows)).select("run_id", "template", "a", F.lit(None).cast("string").alias("b"), "n")


def concerned(grid: DataFrame) -> DataFrame:
    """The rows of (run_id, a, b) whose event concerns the pair, and each run's last."""
    return grid.filter((F.col("act") == F.col("a")) | (F.col("act") == F.col("b")) | (F.col("prev") == F.col("a")) | F.col("ends")).drop("ends")


def ordered_rows(events: DataFrame) -> DataFrame:
    """Pairs of labels of the same run, tested on that run.

    An event with neither label that follows no `a` changes nothing for the
    pair; such events are left out before the sort, but for a run's last one.
    """
    e = events.select("run_id", "pos", "act", F.lag("act").over(run_order()).alias("prev"), F.lead("act").over(run_order()).isNull().alias("ends"))
    acts = e.select("run_id", "act").distinct()
    pairs = acts.select("run_id", F.col("act").alias("a")).join(acts.select("run_id", F.col("act").alias("b")), "run_id")
    g = last_rows(running_columns(concerned(e.join(pairs, "run_id")), ["run_id", "a", "b"]), "a", "b")
    closed = ~(F.col("lb").isNull() | (F.col("la") >= F.col("lb")))
    first_ok = F.col("fa") < F.col("fb")
    positive = F.col("fa") < F.col("lb")
    tests = {
        "response": positive & closed, "precedence": positive & first_ok, "succession": positive & closed & first_ok,
        "alternate_response": positive & (F.col("bad_ar") == 0) & closed, "alternate_precedence": positive & (F.col("bad_ap") == 0),
        "chain_response": positive & (F.col("bad_cr") == 0) & (F.col("act") != F.col("a")), "chain_precedence": positive & (F.col("bad_cp") == 0),
        "chain_succession": positive & (F.col("bad_cr") == 0) & (F.col("bad_cp") == 0) & (F.col("act") != F.col("a")),
        "not_succession": ~positive, "not_chain_succession": F.col("had_chain") == 0,
    }
    names = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return g.select("run_id", F.explode(names).alias("template"), "a", "b", F.lit(None).cast("int").alias("n"))


def _met(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Join on the groups' columns, or (no groups) with the one row there is."""
    return df.join(F.broadcast(other), on) if on else df.join(F.broadcast(other))


def pair_counts(acts: DataFrame, total: DataFrame, by: list[str]) -> DataFrame:
    """template, a, b, matches for pairs a < b of a group's labels, from how many runs have each or both.

    No run meets a pair that it lacks: runs with neither, one or both labels
    follow from three counts.
    """
    one = acts.groupBy(*by, "act").agg(F.count("*").alias("c"))
    two = acts.select(*by, "run_id", F.col("act").alias("a")).join(acts.select(*by, "run_id", F.col("act").alias("b")), [*by, "run_id"]).filter("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("both"))
    # the alphabet's pairs
    left, right = one.select(*by, F.col("act").alias("a"), F.col("c").alias("ca")), one.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("act").alias("b"), F.col("c").alias("cb"))
    on = F.col("a") < F.col("b")
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    pairs = _met(left.join(right, on).drop(*[f"_{c}" for c in by]).join(two, [*by, "a", "b"], "left").fillna(0, "both"), total, by)
    any_ = F.col("ca") + F.col("cb") - F.col("both")
    rows = F.array(*[F.struct(F.lit(t).alias("template"), m.cast("long").alias("matches")) for t, m in (("coexistence", F.col("both")), ("choice", any_), ("exclusive_choice", any_ - F.col("both")), ("not_coexistence", F.col("all") - F.col("both")))])
    return pairs.select(*by, "a", "b", F.inline(rows)).filter("matches > 0").select(*by, "template", "a", "b", F.lit(None).cast("int").alias("n"), "matches")


def accumulate_existential(counts: DataFrame, present: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """existence and absence as tails of the counts; runs without a label satisfy its absence."""
    up = W.partitionBy(*by, "template", "a").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy(*by, "template", "a").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, W.currentRow)
    c = _met(counts.join(present.select(*by, F.col("act").alias("a"), "runs_with"), [*by, "a"], "left"), runs, by)
    tail = F.when(F.col("template") == "existence", F.sum("matches").over(down)).when(F.col("template") == "absence", F.sum("matches").over(up) + F.col("all") - F.col("runs_with")).otherwise(F.col("matches"))
    return c.select(*by, *KEY, tail.alias("matches"))


def mine(events: DataFrame, templates: tuple[str, ...] | None = None, support: float = 0.0, confidence: float = 0.0, interest: float = 0.0, compat: bool = False, cumulative: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """template, a, b, n, matches, support, confidence, interest of every constraint mined.

    With `groups` (run_id and other columns) the runs of each group are mined
    apart, all in one plan, and the rows start with the group's columns.
    """
    want = set(TEMPLATES if templates is None else templates)
    if unknown := want - set(TEMPLATES):
        raise ValueError(f"unknown templates {sorted(unknown)}")
    by = [c for c in groups.columns if c != "run_id"] if groups is not None else []
    in_group = (lambda df: df.join(F.broadcast(groups), "run_id")) if by else (lambda df: df)
    acts = in_group(events.select("run_id", "act").distinct())
    runs = acts.groupBy(*by).agg(F.count_distinct("run_id").alias("all"))
    present = acts.groupBy(*by, "act").agg(F.count("*").alias("runs_with"))
    per_run = [rows(events) for kinds, rows in ((("init", "end"), positional_rows), (COUNTING, existential_rows), (ORDERED, ordered_rows)) if want & set(kinds)]
    counts = [in_group(r).groupBy(*by, *KEY).agg(F.count("*").alias("matches")) for r in per_run]
    if cumulative:
        counts = [accumulate_existential(c, present, runs, by) for c in counts]
    if want & set(UNORDERED + NEGATION):
        counts.append(pair_counts(acts, runs, by))
    if not counts:
        raise ValueError("no templates")
    found = counts[0]
    for c in counts[1:]:
        found = found.unionByName(c)
    side = lambda k: present.select(*by, F.col("act").alias(k), F.col("runs_with").alias(f"c{k}"))
    met = _met(found.filter(F.col("template").isin(*want)).join(side("a"), [*by, "a"], "left").join(side("b"), [*by, "b"], "left"), runs, by)
    m, n, ca, cb = F.col("matches"), F.col("all"), F.col("ca"), F.col("cb")
    co = n - m
    negative = F.col("template").isin(*NEGATION)
    conf = F.when(F.col("template").isin(*UNORDERED), m / F.sqrt((ca * cb).cast("double"))).when(negative, F.sqrt(((ca - co) / ca) * ((cb - co) / cb))).otherwise(m / ca)
    independent = (ca / n) * (cb / n)
    expected = F.when(negative, 1 - independent).otherwise(independent)
    out = met.select(*by, *KEY, "matches", (m / n).alias("support"), conf.alias("confidence"), F.when(cb.isNotNull() & (expected != 0), (m / n) / expected).alias("interest"))
    kept = (F.col("support") >= support) & F.col("confidence").isNotNull() & (F.col("confidence") >= confidence)
    enough = F.col("interest") >= interest
    return out.filter(kept & (F.coalesce(enough, F.lit(False)) if compat else F.col("interest").isNull() | enough))


def ordered_output(mined: DataFrame) -> DataFrame:
    return mined.orderBy("template", "a", F.col("b").asc_nulls_first(), F.col("n").asc_nulls_first())


def select_discriminative(positive: DataFrame, negative: DataFrame, min_delta: float = 0.2, min_support: float = 0.6, top_k: int = 200, exclude: tuple[str, ...] = DEFAULT_EXCLUDED) -> DataFrame:
    """The constraints whose support differs most: side ('plus' or 'minus'), key, statistics, weight."""
    keep = lambda df, s: df.filter(~F.col("template").isin(*exclude)).select(*[F.col(c).alias(f"{s}{c}") for c in (*KEY, "support", "confidence", "interest")])
    same = [F.col(f"p{c}").eqNullSafe(F.col(f"m{c}")) for c in KEY]
    both = keep(positive, "p").join(keep(negative, "m"), same, "full_outer")
    sp, sm = F.coalesce("psupport", F.lit(0.0)), F.coalesce("msupport", F.lit(0.0))
    pick = lambda c: F.when(F.col("ptemplate").isNotNull(), F.col(f"p{c}")).otherwise(F.col(f"m{c}")).alias(c)
    delta = sp - sm
    side = F.when((sp >= min_support) & (delta >= min_delta), "plus").when((sm >= min_support) & (-delta >= min_delta) & F.coalesce("ptemplate", "mtemplate").isin(*WITNESSABLE), "minus")
    rows = both.select(side.alias("side"), *[pick(c) for c in KEY], F.when(side == "plus", sp).otherwise(sm).alias("support"), pick("confidence"), pick("interest"), F.abs(delta).alias("weight")).filter("side IS NOT NULL")
    # rounded, so that equal weights tie in any engine
    order = [F.desc(F.round("weight", 9)), "template", "a", F.col("b").asc_nulls_first(), F.col("n").asc_nulls_first()]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("side").orderBy(*order))).filter(F.col("rank") <= top_k)


def as_model(mined: DataFrame, exclude: tuple[str, ...] = (*DEFAULT_EXCLUDED, *COUNTING, "init")) -> DataFrame:
    """Mined constraints numbered as a model, without the templates excluded."""
    kept = mined.filter(~F.col("template").isin(*exclude))
    weight = F.col("weight") if "weight" in mined.columns else F.lit(1.0)
    cid = F.row_number().over(W.orderBy("template", "a", F.col("b").asc_nulls_first(), F.col("n").asc_nulls_first())) - 1
    return kept.select(cid.cast("int").alias("cid"), *KEY, weight.alias("weight"))


def as_models(mined: DataFrame, group: str, exclude: tuple[str, ...] = (*DEFAULT_EXCLUDED, *COUNTING, "init")) -> DataFrame:
    """Constraints mined by group, numbered alike in all: group, cid, key, weight."""
    kept = mined.filter(~F.col("template").isin(*exclude)).select(group, *KEY)
    # as many rows as there are different constraints
    named = kept.select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
    named = named.withColumn("cid", (F.row_number().over(W.orderBy("_template", "_a", F.col("_b").asc_nulls_first(), F.col("_n").asc_nulls_first())) - 1).cast("int"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    return kept.join(F.broadcast(named), same).select(group, "cid", *KEY, F.lit(1.0).alias("weight"))
