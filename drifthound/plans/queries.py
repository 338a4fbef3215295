"""The engine's registered queries: name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import nearest
from ..operators import bank as banks
from ..operators import baselines, declare, distances, evaluate, mining, projection, structure
from ..sources.logs import conversation_log, hash_of, order_log, session_log, status_of, traces_of
from ..sources.runs import shared_folder, write_results
from ..streaming import scoring
from . import detectors, oracles, records
from .records import projected, tool_coverage

LOGS = {"session": session_log, "order": order_log, "conversation": conversation_log}
#: Label pairs of the session log that the constraint queries use.
PAIRS = (("view", "click"), ("click", "purchase"), ("error", "error"))
CONSTRAINTS = [
    *[(t, a, None, None, 0.5) for t in ("init", "end") for a, _ in PAIRS],
    *[(t, a, None, n, 1.5) for t in ("existence", "absence", "exactly") for (a, _), n in zip(PAIRS, (1, 2, 3))],
    *[(t, a, b, None, 0.25) for t in declare.TEMPLATES[5:] for a, b in PAIRS],
]

BANK_DETECTORS = tuple(c.label() for c in detectors.CONFIGS)

Query = Callable[[SparkSession, str], DataFrame]


def _session(spark: SparkSession, sf_dir: str, k: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, traces and bank of the session log; the bank's few rows are kept."""
    events = session_log(spark, sf_dir)
    traces = traces_of(events)
    return events, traces, banks.draw_bank(traces, k).cache()


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`").cast("double"), 6) for c in cols})


def _stats(d: Column) -> list[Column]:
    return [F.round(nearest(d, how, 3), 9).alias(name) for how, name in (("min", "d_min"), ("max_knn", "d_max3"), ("mean", "d_mean"))]


def log(which: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return LOGS[which](spark, sf_dir)


def bank_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir)[2].select("ref_id", "bank_idx", "n", F.array_join("labels", " ").alias("labels"))


def bank_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banks.draw_bank_per_task(traces_of(session_log(spark, sf_dir))).select("ref_id", "bank_idx", "n")


def bank_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(banks.mean_length(_session(spark, sf_dir)[2]), "mean_length")


def split_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banks.split(traces_of(session_log(spark, sf_dir)))


def counted(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(detectors.BASELINES[name](session_log(spark, sf_dir), None), "score")


def ngram(order: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _, bank = _session(spark, sf_dir)
    return _round(detectors.BASELINES[f"ngram{order}"](events, bank), "score")


def random_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(detectors.BASELINES["random"](session_log(spark, sf_dir), None), "score")


def walk(col: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(structure.walk_features(session_log(spark, sf_dir)).select("run_id", "pos", F.col(col).alias("score")), "score")


def profile(col: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _, bank = _session(spark, sf_dir)
    return _round(structure.profile_scores(events, structure.as_events(bank)).select("run_id", "pos", F.col(col).alias("score")), "score")


def graph_score(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _, bank = _session(spark, sf_dir)
    return _round(f(events, bank), "score")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, traces, bank = _session(spark, sf_dir)
    return _round(structure.dfg_fitness(traces, bank), "score")


def step_surprisal(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _, bank = _session(spark, sf_dir)
    return _round(structure.step_surprisal(events, bank, structure.as_events(bank)), "score")


def set_distance(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _, bank = _session(spark, sf_dir)
    return distances.set_distances(events, bank, (name,)).groupBy("run_id", "pos").agg(*_stats(F.collect_list(name)))


def edit_distance(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    _, traces, bank = _session(spark, sf_dir)
    return distances.edit_distances(traces, bank, wanted=(name,)).select("run_id", "pos", *_stats(F.col(name)))


def edit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, traces, bank = _session(spark, sf_dir)
    return _round(distances.edit_distance_fold(traces, bank), "dl")


def knn_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: third-nearest edit distance to the bank at every prefix."""
    _, traces, bank = _session(spark, sf_dir)
    return _round(distances.edit_scores(traces, bank, {"score": ("dl", "max_knn", 3, 0.25)}), "score")


def _jaccard(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events, traces, bank = _session(spark, sf_dir)
    return distances.set_distances(events, bank, ("jaccard",)).withColumnRenamed("jaccard", "d"), traces, bank


def knn_aggregators(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _jaccard(spark, sf_dir)[0]
    hows = ("min", "max_knn", "mean_knn", "quantile", "mean")
    return d.groupBy("run_id", "pos").agg(*[F.round(nearest(F.collect_list("d"), h, 3), 6).alias(h) for h in hows])


def knn_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _jaccard(spark, sf_dir)[0].withColumn("d", F.round("d", 9))
    return _round(banks.nearest_references(d, 3), "d").select("run_id", "pos", "rank", "bank_idx", "d")


def knn_per_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _jaccard(spark, sf_dir)[0]
    return _round(declare.last_rows(d, "bank_idx"), "d").select("run_id", "bank_idx", "d")


def knn_empty_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix scores 0 against a bank without runs."""
    events, traces, bank = _session(spark, sf_dir)
    return distances.edit_scores(traces, bank.filter("false"), {"score": ("dl", "max_knn", 3, 0.25)})


def _model(spark: SparkSession) -> DataFrame:
    return declare.model(spark, CONSTRAINTS)


def verdict(template: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of one template's constraints at every prefix."""
    model = _model(spark).filter(F.col("template") == template)
    return declare.verdicts(session_log(spark, sf_dir), model).select("run_id", "pos", "cid", F.col("state").cast("int").alias("state"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declare.verdicts(session_log(spark, sf_dir), _model(spark))


def satisfied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declare.satisfied(session_log(spark, sf_dir), _model(spark))


def witnessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declare.last_rows(_verdicts(spark, sf_dir), "cid").select("run_id", "cid", "witness", "activated")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(declare.counters(_verdicts(spark, sf_dir)), "w_perm_viol", "w_witness", "total_weight")


def declare_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _model(spark)
    return _round(declare.scores(session_log(spark, sf_dir), m, m), *declare.FEATURES)


def signatures(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return declare.last_rows(declare.signature(_verdicts(spark, sf_dir), kind)).groupBy("run_id", "pos").agg(F.count("*").alias("symbols"), F.sum(F.col("cid") * 4 + F.col("sym")).cast("long").alias("checksum"))


def signature_bank(mode: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _, bank = _session(spark, sf_dir)
    own = bank.select(F.col("ref_id").alias("run_id"), "bank_idx")
    theirs = declare.verdicts(structure.as_events(bank), _model(spark)).join(F.broadcast(own), "run_id").drop("run_id")
    return declare.signature_distances(declare.verdicts(events, _model(spark)), theirs, "state", mode).groupBy("run_id", "pos").agg(*_stats(F.collect_list("d")))


def _rated(mined: DataFrame) -> DataFrame:
    return _round(mined, "support", "confidence", "interest")


def mined(spark: SparkSession, sf_dir: str, which: str = "session", **options) -> DataFrame:
    traces = traces_of(LOGS[which](spark, sf_dir))
    return _rated(mining.mine(structure.as_events(banks.draw_bank(traces).cache()), **options))


def mined_families(kinds: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark, sf_dir, templates=kinds)


def discriminative(spark: SparkSession, sf_dir: str, which: str = "session", **options) -> DataFrame:
    e = LOGS[which](spark, sf_dir).filter("n >= 3")
    chosen = mining.select_discriminative(mining.mine(e.filter("success")), mining.mine(e.filter("NOT success")), **options)
    return _round(chosen, "support", "weight").select("side", *mining.KEY, "support", "weight", "rank")


def model_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _session(spark, sf_dir)[2]
    return declare.census(detectors.bank_model(bank, 0.3))


def bank_model(which: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep's model as its default makes it: what every run of the bank satisfies."""
    model = detectors.bank_model(banks.draw_bank(traces_of(LOGS[which](spark, sf_dir))).cache())
    return declare.census(_model(spark).filter("false") if model is None else model)


def _judged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Third-nearest Jaccard scores of evaluated runs, and what is made of them."""
    d, traces, bank = _jaccard(spark, sf_dir)
    score = lambda df: df.groupBy("run_id", "pos").agg(F.round(nearest(F.collect_list("d"), "max_knn", 3), 9).alias("score"))
    ids = F.broadcast(bank.select(F.col("ref_id").alias("run_id")))
    runs = traces.filter("n >= 3").join(ids, "run_id", "left_anti")
    peaks = evaluate.peaks(score(evaluate.leave_one_out(d, bank)), 3)
    threshold = evaluate.threshold(peaks, 0.9)
    decisions = evaluate.decide(score(d).join(runs.select("run_id"), "run_id", "left_semi"), threshold)
    labelled = decisions.join(runs.select("run_id", "success"), "run_id").select("run_id", F.col("peak").alias("score"), (~F.col("success")).cast("int").alias("label"))
    return {"runs": runs, "peaks": peaks, "threshold": threshold, "decisions": decisions, "labelled": labelled}


def loo_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_judged(spark, sf_dir)["peaks"], "peak")


def loo_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_judged(spark, sf_dir)["threshold"], "threshold")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_judged(spark, sf_dir)["decisions"], "frac", "peak")


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of third-nearest Jaccard that a tenth of the trusted runs' peaks exceeds at most."""
    d, traces, bank = _jaccard(spark, sf_dir)
    trusted = traces.filter("n >= 3").join(F.broadcast(bank.select(F.col("ref_id").alias("run_id"))), "run_id", "left_anti")
    scores = d.groupBy("run_id", "pos").agg(F.round(nearest(F.collect_list("d"), "max_knn", 3), 9).alias("score"))
    return _round(evaluate.calibrate(scores, trusted), "threshold")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)
    return _round(evaluate.metrics(j["decisions"], j["runs"]), *evaluate.METRICS)


def roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.auc_roc(_judged(spark, sf_dir)["labelled"]), "auc_roc")


def pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.auc_pr(_judged(spark, sf_dir)["labelled"]), "auc_pr")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.failure_rate(traces_of(session_log(spark, sf_dir))), "failure_rate")


def summary(which: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.corpus_summary(LOGS[which](spark, sf_dir)), "failure_rate")


def sweep(spark: SparkSession, sf_dir: str, which: str = "session", **options) -> DataFrame:
    """All detectors for one draw of the bank."""
    return _round(detectors.sweep(LOGS[which](spark, sf_dir), **options), "threshold", *evaluate.METRICS)


def sweep_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine bank detectors for three seeds and two sizes of the bank, in one plan."""
    cells, _ = detectors.sweep_draws(session_log(spark, sf_dir), (0, 1, 2), (16, 32), detectors=BANK_DETECTORS)
    return _round(cells, "threshold", *evaluate.METRICS)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a small sweep: two logs as environments, three seeds, two sizes of the bank."""
    logs = {"session": session_log(spark, sf_dir), "order": order_log(spark, sf_dir)}
    cells, _ = detectors.sweep_all(logs, (0, 1, 2), (16, 32), quantiles=(0.9, 0.95), warmups=(1,), detectors=oracles.REPORTED)
    return cells.withColumnRenamed("source", "environment")


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over seeds of each environment and setting."""
    keys = ("environment", "k", "detector", "q", "w")
    per = evaluate.over_seeds(_cells(spark, sf_dir), *keys)
    return per.select(*keys, *[F.col(f"{m}.mean").alias(m) for m in evaluate.METRICS])


def environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.per_environment(_settings(spark, sf_dir)), "f1", "earliness_frac", "flag_rate")


def environment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.ranking(evaluate.summarise(evaluate.per_environment(_settings(spark, sf_dir)))), "mean", "sem")


def best_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.best_setting(_settings(spark, sf_dir)), "f1")


def seed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested results with the values of each seed, written as a result file and read back as rows of (setting, metric)."""
    keys = ("environment", "k", "detector", "q", "w")
    place = shared_folder(spark, "results")
    found = evaluate.over_seeds(_cells(spark, sf_dir), *keys)
    write_results(evaluate.nested_results(found, "environment"), place)
    cells = f"array<struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in found.schema if f.name != 'environment')}>>"
    rows = spark.read.schema(f"environment string, cells {cells}").json(place).select("environment", F.inline("cells"))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.mean").alias("mean"), F.col(f"{m}.std").alias("std"), F.col(f"{m}.raw").alias("raw")) for m in evaluate.METRICS])
    text = F.array_join(F.transform("raw", lambda x: F.coalesce(F.format_string("%.6f", x), F.lit("null"))), " ")
    return _round(rows.select(*keys, F.inline(each)), "mean", "std").withColumn("raw", text)


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined constraints as a nested result file, one object a template, written and read back."""
    place = shared_folder(spark, "results")
    found = mined(spark, sf_dir)
    write_results(evaluate.nested_results(mining.ordered_output(found), "template"), place)
    cells = f"array<struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in found.schema if f.name != 'template')}>>"
    return spark.read.schema(f"template string, cells {cells}").json(place).select("template", F.inline("cells"))


def repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluate.mean_std(_cells(spark, sf_dir), "recall", "environment", "k", "detector", "q"), "mean", "std")


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live scores of each user's events, read as a stream; the bank is drawn from whole users; a sign-up is an answer, not a tool call."""
    log_ = session_log(spark, sf_dir, gap_hours=1_000_000)
    bank = banks.draw_bank(traces_of(log_))
    place = shared_folder(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    error = F.col("event_type") == "error"
    rows = arriving.select(F.concat("user_id", F.lit(":1")).alias("run_id"), "ts", "event_id", F.col("event_type").alias("act"), F.when(F.col("event_type") == "signup", "respond").otherwise("tool").alias("kind"), error.alias("error"), status_of(error).alias("status"), hash_of().alias("args_hash"))
    scoring.run_once(scoring.score_stream(rows, bank, _model(spark)), f"{place}/scores", f"{place}/state")
    return _round(spark.read.parquet(f"{place}/scores").select("run_id", "pos", *scoring.SCORES), *scoring.SCORES)


def _all() -> dict[str, tuple[Query, str | None]]:
    """Each query with its SQL; None where SQL has no fair form."""
    o = oracles
    q: dict[str, tuple[Query, str | None]] = {
        "knn_edit_distance": (knn_edit_distance, o.FLAGSHIP),
        **{f"log_{n}": (partial(log, n), o.log(t)) for n, t in (("session", o.SESSION), ("order", o.ORDER), ("conversation", o.TALK))},
        "bank_draw": (bank_draw, o.BANK), "bank_per_task": (bank_per_task, o.BANK_PER_TASK), "bank_size": (bank_size, o.BANK_SIZE), "split_roles": (split_roles, o.SPLIT),
        **{f"score_{n}": (partial(counted, n), o.counted(n)) for n in baselines.COUNTED},
        **{f"score_ngram{n}": (partial(ngram, n), o.ngram(n)) for n in (0, 1)}, "score_random": (random_score, o.RANDOM),
        **{f"score_{n}": (partial(walk, n), o.walk(n)) for n in ("return_rate", "edge_novelty")},
        **{f"score_{n}": (partial(profile, n), o.profile(n)) for n in ("cycle_resid", "cycle_absz", "edge_absz")},
        "score_graph_progress": (partial(graph_score, structure.graph_progress), o.PROGRESS), "score_df_legality": (partial(graph_score, structure.df_legality), o.LEGALITY),
        "score_dfg_fitness": (replay, o.REPLAY), "score_step_surprisal": (step_surprisal, o.SURPRISAL),
        **{f"distance_{n}": (partial(set_distance, n), o.set_distance(n)) for n in distances.SET_DISTANCES},
        **{f"distance_{n}": (partial(edit_distance, n), o.edit_distance(n)) for n in distances.EDIT_DISTANCES}, "distance_dl_fold": (edit_fold, o.FOLD),
        "knn_aggregators": (knn_aggregators, o.AGGREGATED), "knn_nearest": (knn_nearest, o.NEAREST), "knn_per_reference": (knn_per_reference, o.PER_REFERENCE), "knn_empty_bank": (knn_empty_bank, o.EMPTY_BANK),
        **{f"declare_{t}": (partial(verdict, t), o.verdict(t, CONSTRAINTS)) for t in declare.TEMPLATES},
        "declare_satisfied": (satisfied, o.over_verdicts(f"SELECT run_id, cid, state IN (2, 3) AS satisfied FROM vd {o.LAST}", CONSTRAINTS)),
        "declare_witnessed": (witnessed, o.over_verdicts(f"SELECT run_id, cid, witness, activated FROM vd {o.LAST}", CONSTRAINTS)),
        "declare_counters": (counters, o.over_verdicts(o.COUNTERS, CONSTRAINTS)), "declare_scores": (declare_scores, o.over_verdicts(o.SCORES, CONSTRAINTS)),
        **{f"declare_signature_{k}": (partial(signatures, k), o.over_verdicts(
            f"SELECT run_id, pos, count(*) AS symbols, CAST(sum(cid * 4 + {'state' if k == 'state' else '0'}) AS BIGINT) AS checksum FROM vd WHERE {w} GROUP BY run_id, pos {o.LAST}", CONSTRAINTS)) for k, w in declare.SIGNATURES.items()},
        **{f"declare_bank_{m}": (partial(signature_bank, m), o.signature_bank(CONSTRAINTS, m)) for m in ("prefix", "full")},
        **{f"mine_{n}": (partial(mined_families, k), o.mined("template IN (" + ", ".join(f"'{t}'" for t in k) + ")")) for n, k in (
            ("positional", ("init", "end")), ("existential", declare.COUNTING), ("ordered", declare.ORDERED), ("unordered", declare.UNORDERED + declare.NEGATION))},
        "mine_all": (partial(mined, support=0.3, confidence=0.5), o.mined("support >= 0.3 AND confidence >= 0.5")),
        "mine_compat": (partial(mined, interest=1.0, compat=True), o.mined("interest >= 1.0")),
        "mine_cumulative": (partial(mined, cumulative=True), o.mined(cumulative=True)), "mine_orders": (partial(mined, which="order", support=0.3, cumulative=True), o.mined("support >= 0.3", o.ORDER, True)),
        "mine_discriminative": (partial(discriminative, min_delta=0.02, min_support=0.1, top_k=100_000), o.discriminative("0.02", "0.1", 100_000)),
        **{f"mine_discriminative_{w}": (partial(discriminative, which=w), o.discriminative(log_=t)) for w, t in (("session", o.SESSION), ("conversation", o.TALK))},
        "mine_model_census": (model_census, o.census(0.3)), **{f"mine_model_{w}": (partial(bank_model, w), o.census(1.0, t)) for w, t in (("session", o.SESSION), ("conversation", o.TALK))},
        "eval_loo_peaks": (loo_peaks, o.PEAKS), "eval_threshold": (loo_threshold, o.THRESHOLD), "eval_decisions": (decisions, o.DECISIONS), "eval_metrics": (metrics, o.METRICS),
        "eval_auc_roc": (roc, o.ROC), "eval_auc_pr": (pr, o.PR), "eval_failure_rate": (failures, o.FAILURES),
        **{f"summary_{n}": (partial(summary, n), o.sql(o.SUMMARY, t)) for n, t in (("session", o.SESSION), ("order", o.ORDER), ("conversation", o.TALK))},
        "sweep_session": (sweep, o.sweep(o.SESSION, (0,), (16,), detectors.SWEPT, True)), "sweep_draws": (sweep_draws, o.sweep(o.SESSION, (0, 1, 2), (16, 32), BANK_DETECTORS)), "report_seeds": (seed_results, o.SEEDS),
        "sweep_conversation": (partial(sweep, which="conversation"), o.sweep(o.TALK, (0,), (16,), detectors.SWEPT, True)), "sweep_session_support": (partial(sweep, support=0.3), o.sweep(o.SESSION, (0,), (16,), detectors.SWEPT, True, support=0.3)),
        "report_environments": (environments, o.ENVIRONMENTS), "report_summary": (environment_summary, o.REPORT_SUMMARY), "report_best_setting": (best_settings, o.BEST_SETTING), "report_repetitions": (repetitions, o.REPETITIONS),
        "report_nested": (nested, o.mined()), "eval_calibrated": (calibrated, o.CALIBRATED),
        **{f"records_{f}": (partial(records.record_runs, f), records.record_runs_sql(f)) for f in records.READERS}, **{f"records_{f}_traces": (partial(records.record_traces, f), records.record_traces_sql(f)) for f in records.READERS},
        "records_catalogue": (records.record_catalogue, records.RECORD_CATALOGUE), **{f"project_{f}_odd": (partial(records.projected_odd, f), records.projected_odd_sql(f)) for f in records.READERS},
        **{f"project_list_{g}": (partial(projected, g, "list", "fifo" if g == "status" else "id"), o.projected(g, "list")) for g in projection.GRANULARITIES},
        **{f"project_object_{g}": (partial(projected, g, "object", "fifo" if g == "rw_status" else "id"), o.projected(g, "object")) for g in projection.GRANULARITIES},
        "registry_coverage": (tool_coverage, o.COVERAGE), "stream_scores": (stream_scores, o.live(CONSTRAINTS)),
    }
    return q


QUERIES: dict[str, Query] = {n: f for n, (f, _) in _all().items()}
ORACLES: dict[str, str] = {n: s for n, (_, s) in _all().items() if s is not None}
