"""The registered queries in SQL, on the same tables."""

from __future__ import annotations

from ..operators.declare import activation_sql, state_sql, witness_sql

SESSION = """g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 24 HOUR THEN 1 ELSE 0 END AS st
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g),
e0 AS (SELECT concat(user_id, ':', sid) AS run_id, row_number() OVER (PARTITION BY user_id, sid ORDER BY ts, event_id) - 1 AS pos, event_type AS act,
  CAST(user_id AS VARCHAR) AS task_id, event_type = 'error' AS error, 'tool' AS kind,
  CASE WHEN event_type = 'error' AND value < 5 THEN 'policy' WHEN event_type = 'error' THEN 'err' WHEN value < 2 THEN 'empty' ELSE 'ok' END AS status,
  md5(event_type || '|' || props) AS args_hash, event_type <> 'error' AS good FROM s)"""
ORDER = """e0 AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
  o_orderstatus || '-' || o_orderpriority[1] AS act, CAST(o_custkey AS VARCHAR) AS task_id, o_orderstatus = 'F' AS error, 'tool' AS kind,
  CASE WHEN o_orderstatus = 'F' THEN 'err' ELSE 'ok' END AS status, md5(CAST(o_orderkey AS VARCHAR)) AS args_hash, o_orderstatus <> 'F' AS good FROM orders)"""
TALK = """e0 AS (SELECT CAST(conv_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
  CASE WHEN role = 'assistant' THEN 'respond' ELSE 'user' END AS act, CAST(conv_id AS VARCHAR) AS task_id, false AS error,
  CASE WHEN role = 'assistant' THEN 'respond' ELSE 'user' END AS kind, 'ok' AS status, CAST(NULL AS VARCHAR) AS args_hash, role = 'assistant' AS good
  FROM conversations WHERE role <> 'system')"""
RUNS = """ev AS MATERIALIZED (SELECT * EXCLUDE (pos, good), CAST(pos AS INTEGER) AS pos, CAST(count(*) OVER (PARTITION BY run_id) AS INTEGER) AS n,
  last_value(good) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS success FROM e0),
tr AS MATERIALIZED (SELECT run_id, list(act ORDER BY pos) AS labels, n, success, task_id FROM ev GROUP BY run_id, n, success, task_id),
bank AS MATERIALIZED (SELECT run_id AS ref_id, CAST(row_number() OVER (ORDER BY md5('0|' || run_id)) - 1 AS INTEGER) AS bank_idx, labels, n, task_id
  FROM (SELECT * FROM tr WHERE success AND n >= 3 ORDER BY md5('0|' || run_id) LIMIT 16)),
be AS MATERIALIZED (SELECT ref_id, bank_idx, unnest(range(0, n)) AS pos, unnest(labels) AS act FROM bank)"""


def sql(body: str, log: str = SESSION, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([log, RUNS, *ctes]) + "\n" + body


RUNNING = "PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def log(which: str) -> str:
    return sql("SELECT run_id, pos, act, kind, error, status, args_hash, task_id, n, success FROM ev", which)


# ---- bank and splits
BANK = sql("SELECT ref_id, bank_idx, n, array_to_string(labels, ' ') AS labels FROM bank")
BANK_PER_TASK = sql("""SELECT run_id AS ref_id, CAST(row_number() OVER (ORDER BY md5('0|' || task_id)) - 1 AS INTEGER) AS bank_idx, n FROM
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY md5('0|' || run_id)) AS r FROM tr WHERE success) WHERE r = 1 ORDER BY md5('0|' || task_id) LIMIT 16)""")
BANK_SIZE = sql("SELECT count(*) AS size, round(avg(len(labels)), 6) AS mean_length FROM bank")
SPLIT = sql("""SELECT run_id, 'bank' AS role FROM b UNION ALL SELECT run_id, 'calib' FROM t WHERE success AND run_id NOT IN (SELECT run_id FROM b)
  UNION ALL SELECT run_id, 'train_fail' FROM t WHERE NOT success UNION ALL SELECT run_id, 'eval' FROM tr WHERE task_id NOT IN (SELECT task_id FROM tt)""", SESSION,
    "ta AS (SELECT DISTINCT task_id FROM tr)", "tt AS (SELECT task_id FROM ta ORDER BY md5('0|' || task_id) LIMIT (SELECT greatest(16, CAST(round_even(0.4 * count(*), 0) AS BIGINT)) FROM ta))",
    "t AS MATERIALIZED (SELECT * FROM tr WHERE task_id IN (SELECT task_id FROM tt))",
    "b AS MATERIALIZED (SELECT run_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY md5('0|' || run_id)) AS r FROM t WHERE success) WHERE r = 1 ORDER BY md5('0|' || task_id) LIMIT 16)")

# ---- baselines
_CALLS = f"nullif(count(*) FILTER (kind = 'tool') OVER ({RUNNING}), 0)"
COUNTED = {  # rates are of tool events only
    "step_count": "least(1, (pos + 1) / 60)", "error_rate": f"coalesce(count(*) FILTER (error AND kind = 'tool') OVER ({RUNNING}) / {_CALLS}, 0)",
    "error_count": f"least(1, sum(CAST(error AS INTEGER)) OVER ({RUNNING}) / 5)", "repeat_rate": f"coalesce(sum(again) OVER ({RUNNING}) / {_CALLS}, 0)",
    "empty_rate": f"coalesce(count(*) FILTER (status = 'empty' AND kind = 'tool') OVER ({RUNNING}) / {_CALLS}, 0)", "policy_count": f"least(1, sum(CAST(status IN ('policy', 'invalid') AS INTEGER)) OVER ({RUNNING}) / 2)",
}


def counted(name: str) -> str:
    return sql(f"SELECT run_id, pos, round(CAST({COUNTED[name]} AS DOUBLE), 6) AS score FROM a", SESSION, "a AS (SELECT *, CAST(kind = 'tool' AND args_hash IS NOT NULL AND row_number() OVER (PARTITION BY run_id, kind, args_hash ORDER BY pos) > 1 AS INTEGER) AS again FROM ev)")


def _nll(order: int) -> tuple[str, ...]:
    ctx = "coalesce(lag(act) OVER (PARTITION BY {} ORDER BY pos), '<s>')" if order else "''"
    return (
        f"rc AS (SELECT *, {ctx.format('ref_id')} AS ctx FROM be)", "cnt AS (SELECT ctx, act, count(*) AS c FROM rc GROUP BY ALL)", "tot AS (SELECT ctx, sum(c) AS t FROM cnt GROUP BY ctx)",
        "voc AS (SELECT count(DISTINCT act) + 1 AS v FROM be)", f"ec AS (SELECT run_id, pos, act, {ctx.format('run_id')} AS ctx FROM ev)",
        "nll AS MATERIALIZED (SELECT run_id, pos, -ln(CASE WHEN t IS NULL THEN 1 / v ELSE (coalesce(c, 0) + 0.5) / (t + 0.5 * v) END) AS nll FROM ec LEFT JOIN cnt USING (ctx, act) LEFT JOIN tot USING (ctx), voc)",
    )


def ngram(order: int) -> str:
    return sql(f"SELECT run_id, pos, round(least(1, avg(nll) OVER ({RUNNING}) / 6), 6) AS score FROM nll", SESSION, *_nll(order))


RANDOM = sql("SELECT run_id, pos, round(CAST(('0x' || substr(md5('0|' || run_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE, 6) AS score FROM ev")

# ---- structure
SIG = "1 / (1 + exp(-greatest(-30, least(30, {}))))"
WALK = (
    "wl AS (SELECT run_id, pos, act, CAST(coalesce(lead(act) OVER r <> act, false) AS INTEGER) AS leaves, lag(act) OVER r AS prev FROM {src} WINDOW r AS (PARTITION BY run_id ORDER BY pos))",
    "wb AS (SELECT *, CAST(coalesce(sum(leaves) OVER (PARTITION BY run_id, act ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS INTEGER) AS back, CAST(prev IS NOT NULL AND row_number() OVER (PARTITION BY run_id, prev, act ORDER BY pos) = 1 AS INTEGER) AS fresh FROM wl)",
    f"wf AS MATERIALIZED (SELECT run_id, pos, act, sum(back) OVER ({RUNNING}) / (pos + 1) AS return_rate, CASE WHEN pos > 0 THEN sum(fresh) OVER ({RUNNING}) / pos ELSE 0 END AS edge_novelty FROM wb)",
)


def _walk(src: str, tag: str) -> list[str]:
    out = []
    for c in WALK:
        c = c.format(src=src) if "{src}" in c else c
        for name in ("wl", "wb", "wf"):
            c = c.replace(f"{name} AS", f"{name}{tag} AS").replace(f"FROM {name}", f"FROM {name}{tag}")
        out.append(c)
    return out


def walk(col: str) -> str:
    return sql(f"SELECT run_id, pos, round({col}, 6) AS score FROM wf", SESSION, *_walk("ev", ""))


def profile(col: str) -> str:
    feature = "edge_novelty" if col == "edge_absz" else "return_rate"
    z = "(v - mu)" if col == "cycle_resid" else "(abs(v - mu) / sd - 1)"
    return sql(f"SELECT f.run_id, f.pos, round({SIG.format(z)}, 6) AS score FROM (SELECT run_id, pos, {feature} AS v FROM wf) f JOIN p ON p.step = least(f.pos, (SELECT max(step) FROM p))", SESSION,
               *_walk("ev", ""), *_walk("(SELECT ref_id AS run_id, pos, act FROM be)", "b"),
               f"p AS (SELECT pos AS step, avg({feature}) AS mu, greatest(coalesce(stddev_samp({feature}), 0), 1e-6) AS sd FROM wfb GROUP BY pos)")


PROGRESS = sql(f"SELECT run_id, e.pos, round(CASE WHEN mu IS NULL THEN 0.5 ELSE {SIG.format('(e.pos + 1 - mu) / 5')} END, 6) AS score FROM ev e LEFT JOIN (SELECT act, avg(pos + 1) AS mu FROM be GROUP BY act) m USING (act)")
LEGALITY = sql(f"SELECT run_id, pos, round(CASE WHEN pos > 0 THEN sum(CAST(a IS NOT NULL AND known IS NULL AS INTEGER)) OVER ({RUNNING}) / pos ELSE 0 END, 6) AS score FROM x LEFT JOIN k ON a = ka AND act = kb", SESSION,
    "k AS (SELECT DISTINCT a AS ka, act AS kb, 1 AS known FROM (SELECT act, lag(act) OVER (PARTITION BY ref_id ORDER BY pos) AS a FROM be) WHERE a IS NOT NULL)",
    "x AS (SELECT run_id, pos, act, lag(act) OVER (PARTITION BY run_id ORDER BY pos) AS a FROM ev)")
SURPRISAL = sql(f"SELECT run_id, t.pos, round({SIG.format('(t.total - mu) / sd / 2')}, 6) AS score FROM tl t JOIN p ON p.step = least(t.pos, (SELECT max(step) FROM p))", SESSION, *_nll(1),
    f"tl AS MATERIALIZED (SELECT run_id, pos, sum(nll) OVER ({RUNNING}) AS total FROM nll)",
    "p AS (SELECT pos AS step, avg(total) AS mu, greatest(coalesce(stddev_samp(total), 0), 1e-6) AS sd FROM tl WHERE run_id IN (SELECT ref_id FROM bank) GROUP BY pos)")
REPLAY = sql("SELECT run_id, CAST(i - 1 AS INTEGER) AS pos, round(missing / i, 6) AS score FROM rp WHERE i > 0", SESSION,
    "gp AS MATERIALIZED (SELECT act, list_sort(list(DISTINCT a)) AS src FROM (SELECT act, coalesce(lag(act) OVER (PARTITION BY ref_id ORDER BY pos), '<start>') AS a FROM be) GROUP BY act)",
    """rp AS (SELECT run_id, labels, 0 AS i, ['<start>'] AS m, 0 AS missing FROM tr UNION ALL
      SELECT run_id, labels, i + 1, list_append(CASE WHEN f IS NULL THEN m ELSE m[:list_position(m, f) - 1] || m[list_position(m, f) + 1:] END, labels[i + 1]), missing + CASE WHEN f IS NULL THEN 1 ELSE 0 END
      FROM (SELECT rp.*, list_filter(coalesce(src, []), lambda s: list_contains(m, s))[1] AS f FROM rp LEFT JOIN gp ON gp.act = labels[i + 1] WHERE i < len(labels)))""")

# ---- distances
_GRAM = {1: "labels", 2: "[labels[i - 1] || '~' || labels[i] for i in range(2, len(labels) + 1)]", 3: "[labels[i - 2] || '~' || labels[i - 1] || '~' || labels[i] for i in range(3, len(labels) + 1)]"}
STATS = "round(list_sort(list(d))[1], 9) AS d_min, round(list_sort(list(d))[3], 9) AS d_max3, round(avg(d), 9) AS d_mean"


def set_distance(name: str) -> str:
    n = 3 if "ngram3" in name else 2 if "ngram2" in name else 1
    if name == "cosine_count":
        d = "1 - list_sum([len(list_filter(p, lambda y: y = x)) * len(list_filter(r, lambda y: y = x)) for x in list_distinct(p)]) / sqrt(list_sum([len(list_filter(p, lambda y: y = x)) ** 2 for x in list_distinct(p)]) * list_sum([len(list_filter(r, lambda y: y = x)) ** 2 for x in list_distinct(r)]))"
        d = f"greatest(0, least(1, {d}))"
    else:
        r = f"r[:greatest(0, pos + 2 - {n})]" if name.endswith("prefix") else "r"
        inter, p = f"len(list_intersect(p, {r}))", "len(list_distinct(p))"
        under = p if name == "containment" else f"({p} + len(list_distinct({r})) - {inter})"
        d = f"CASE WHEN len(p) = 0 THEN 0 ELSE 1 - {inter} / {under} END"
    return sql(f"SELECT run_id, pos, {STATS} FROM (SELECT run_id, pos, {d} AS d FROM gr) GROUP BY run_id, pos", SESSION,
               f"sy AS (SELECT run_id, n, {_GRAM[n]} AS s FROM tr)", f"rs AS (SELECT bank_idx, {_GRAM[n]} AS r FROM bank)",
               f"gr AS (SELECT run_id, pos, s[:greatest(0, pos + 2 - {n})] AS p, r FROM (SELECT *, CAST(unnest(range(0, n)) AS INTEGER) AS pos FROM sy), rs)")


_DL = """dl AS (SELECT run_id, bank_idx, t.labels, b.labels AS r, 0 AS i, range(0, len(b.labels) + 1) AS cur, CAST([] AS BIGINT[]) AS prv FROM tr t, bank b UNION ALL
  SELECT run_id, bank_idx, labels, r, i + 1, [list_min([base[t + 1] - t for t in range(0, j + 1)]) + j for j in range(0, len(r) + 1)], cur FROM
   (SELECT *, [CASE WHEN j = 0 THEN i + 1 ELSE least(cur[j + 1] + 1, cur[j] + CASE WHEN r[j] = labels[i + 1] THEN 0 ELSE 1 END,
      CASE WHEN i >= 1 AND j >= 2 AND r[j] = labels[i] AND r[j - 1] = labels[i + 1] THEN prv[j - 1] + 1 ELSE 1000000 END) END for j in range(0, len(r) + 1)] AS base FROM dl WHERE i < len(labels)))"""
_READ = {"dl": "least(1, list_min(cur) / i)", "dl_full": "cur[len(r) + 1] / greatest(i, len(r))", "dl_trunc": "least(1, cur[least(i, len(r)) + 1] / i)"}


def edit_distance(name: str) -> str:
    return sql(f"SELECT run_id, CAST(i - 1 AS INTEGER) AS pos, {STATS} FROM (SELECT run_id, i, {_READ[name]} AS d FROM dl WHERE i > 0) GROUP BY run_id, i", SESSION, _DL)


FOLD = sql("SELECT run_id, bank_idx, round(least(1, list_min(cur) / i), 6) AS dl FROM dl WHERE i = len(labels)", SESSION, _DL)
FLAGSHIP = sql("SELECT run_id, CAST(i - 1 AS INTEGER) AS pos, round(list_sort(list(least(1, list_min(cur) / i)))[3], 6) AS score FROM dl WHERE i > 0 GROUP BY run_id, i", SESSION, _DL)
_JAC = ("jc AS MATERIALIZED (SELECT run_id, pos, bank_idx, 1 - len(list_intersect(p, r)) / (len(list_distinct(p)) + len(list_distinct(r)) - len(list_intersect(p, r))) AS d FROM (SELECT run_id, pos, bank_idx, t.labels[:pos + 1] AS p, b.labels AS r FROM (SELECT *, CAST(unnest(range(0, n)) AS INTEGER) AS pos FROM tr) t, bank b))",)
AGGREGATED = sql("SELECT run_id, pos, round(min(d), 6) AS \"min\", round(list_sort(list(d))[3], 6) AS max_knn, round(list_avg(list_sort(list(d))[1:3]), 6) AS mean_knn, round(quantile_cont(d, 0.25), 6) AS \"quantile\", round(avg(d), 6) AS \"mean\" FROM jc GROUP BY run_id, pos", SESSION, *_JAC)
NEAREST = sql("SELECT run_id, pos, rank, bank_idx, round(d, 6) AS d FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, pos ORDER BY round(d, 9), bank_idx) AS INTEGER) AS rank FROM jc) WHERE rank <= 3", SESSION, *_JAC)
PER_REFERENCE = sql("SELECT run_id, bank_idx, round(d, 6) AS d FROM jc SEMI JOIN (SELECT run_id, n - 1 AS pos FROM tr) USING (run_id, pos)", SESSION, *_JAC)
EMPTY_BANK = sql("SELECT run_id, pos, 0.0::DOUBLE AS score FROM ev")


# ---- declarative constraints
def constraints_sql(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "cn(cid, template, a, b, n, weight) AS MATERIALIZED (SELECT CAST(cid AS INTEGER), template, a, CAST(b AS VARCHAR), CAST(n AS INTEGER), CAST(weight AS DOUBLE) FROM (VALUES " + ", ".join(f"({i}, {lit(t)}, {lit(a)}, {lit(b)}, {lit(n)}, {w[0] if w else 1.0})" for i, (t, a, b, n, *w) in enumerate(rows)) + ") v(cid, template, a, b, n, weight))"


def _verdicts(src: str = "ev", model: str = "cn", tag: str = "", key: str = "run_id") -> tuple[str, ...]:
    w = f"WINDOW w AS (PARTITION BY {key}, cid ORDER BY pos), q AS (PARTITION BY {key}, cid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        f"v0{tag} AS (SELECT e.{key}, e.pos, act, c.*, lag(act) OVER w AS prev, first_value(act) OVER w AS first_act FROM {src} e, {model} c WINDOW w AS (PARTITION BY {key}, cid ORDER BY pos))",
        f"""v1{tag} AS (SELECT *, count(*) FILTER (act = a) OVER w AS ca, count(*) FILTER (act = b) OVER w AS cb, max(pos) FILTER (act = a) OVER w AS la, max(pos) FILTER (act = b) OVER w AS lb,
          min(pos) FILTER (act = a) OVER w AS fa, min(pos) FILTER (act = b) OVER w AS fb, max(pos) FILTER (act = a) OVER q AS pa, max(pos) FILTER (act = b) OVER q AS pb FROM v0{tag} {w})""",
        f"""v2{tag} AS (SELECT *, max(CAST(act = a AND pa IS NOT NULL AND pa >= coalesce(pb, -1) AS INTEGER)) OVER w AS bad_ar, max(CAST(coalesce(act = b, false) AND (pa IS NULL OR pa < coalesce(pb, -1)) AS INTEGER)) OVER w AS bad_ap,
          max(CAST(coalesce(prev = a, false) AND NOT coalesce(act = b, false) AS INTEGER)) OVER w AS bad_cr, max(CAST(coalesce(act = b, false) AND NOT coalesce(prev = a, false) AS INTEGER)) OVER w AS bad_cp,
          max(CAST(coalesce(act = b, false) AND pa IS NOT NULL AS INTEGER)) OVER w AS had_ab, max(CAST(coalesce(act = b, false) AND coalesce(prev = a, false) AS INTEGER)) OVER w AS had_chain FROM v1{tag} {w})""",
        f"vd{tag} AS MATERIALIZED (SELECT {key}, pos, cid, template, weight, CAST({state_sql()} AS INTEGER) AS state, {activation_sql()} AS activated, {witness_sql()} AS witness FROM v2{tag})",
    )


def verdict(template: str, rows: list[tuple]) -> str:
    return sql(f"SELECT run_id, pos, cid, state FROM vd WHERE template = '{template}'", SESSION, constraints_sql(rows), *_verdicts())


def over_verdicts(body: str, rows: list[tuple]) -> str:
    return sql(body, SESSION, constraints_sql(rows), *_verdicts())


LAST = "QUALIFY pos = max(pos) OVER (PARTITION BY run_id)"
COUNTERS = """SELECT run_id, pos, count(*) FILTER (state = 0) AS n_perm_viol, count(*) FILTER (state = 1) AS n_pending, count(*) FILTER (state = 2) AS n_poss_sat, count(*) FILTER (state = 3) AS n_perm_sat,
  count(*) FILTER (activated) AS n_activated, count(*) FILTER (witness) AS n_witness, round(coalesce(sum(weight) FILTER (state = 0), 0), 6) AS w_perm_viol, round(coalesce(sum(weight) FILTER (witness), 0), 6) AS w_witness,
  count(*) AS "constraints", round(sum(weight), 6) AS total_weight FROM vd GROUP BY run_id, pos"""
SCORES = """SELECT run_id, pos, round(1 - exp(-v / 8), 6) AS dcl_pos_viol, round(CASE WHEN a > 0 THEN v / a ELSE 0 END, 6) AS dcl_pos_ratio, round(1 - exp(-p / 8), 6) AS dcl_pos_pend, round(least(1, wv / tw), 6) AS dcl_pos_wviol,
  round(1 - exp(-w / 8), 6) AS dcl_neg_wit, round(least(1, ww / tw), 6) AS dcl_neg_wwit, round(least(1, 0.5 * (v / c + w / c)), 6) AS dcl_both, round(least(1, v / (pos + 1)), 6) AS dcl_viol_rate
  FROM (SELECT run_id, pos, count(*) FILTER (state = 0) AS v, count(*) FILTER (state = 1) AS p, count(*) FILTER (activated) AS a, count(*) FILTER (witness) AS w, coalesce(sum(weight) FILTER (state = 0), 0) AS wv,
    coalesce(sum(weight) FILTER (witness), 0) AS ww, sum(weight) AS tw, count(*) AS c FROM vd GROUP BY run_id, pos)"""


def signature_bank(rows: list[tuple], mode: str) -> str:
    at = "least(m.pos, l.last)" if mode == "prefix" else "l.last"
    return sql(f"""SELECT run_id, pos, {STATS} FROM (SELECT m.run_id, m.pos, coalesce(1 - len(list_intersect(m.s, r.s)) / nullif(len(list_distinct(m.s || r.s)), 0), 0) AS d
        FROM sg m, (SELECT bank_idx, max(pos) AS last FROM sb GROUP BY bank_idx) l JOIN sb r ON r.bank_idx = l.bank_idx AND r.pos = {at}) GROUP BY run_id, pos""", SESSION, constraints_sql(rows), *_verdicts(), *_verdicts("be", "cn", "b", "bank_idx"),
        "sg AS MATERIALIZED (SELECT run_id, pos, coalesce(list(cid * 4 + state) FILTER (activated), []) AS s FROM vd GROUP BY ALL)", "sb AS MATERIALIZED (SELECT bank_idx, pos, coalesce(list(cid * 4 + state) FILTER (activated), []) AS s FROM vdb GROUP BY ALL)")


# ---- mining
def _mined(src: str, tag: str = "", cumulative: bool = False) -> tuple[str, ...]:
    """Constraints by the definitions over whole lists, run by run."""
    pos = lambda x: f"[i for i in range(1, len(l) + 1) if l[i] = {x}]"
    tests = {
        "response": "f AND list_max(pb) > list_max(pa)", "precedence": "f AND list_min(pa) < list_min(pb)", "succession": "f AND list_max(pb) > list_max(pa) AND list_min(pa) < list_min(pb)",
        "alternate_response": "f AND len(list_filter(pa, lambda i: len(list_filter(pb, lambda j: j > i AND len(list_filter(pa, lambda h: h > i AND h <= j)) = 0)) = 0)) = 0",
        "alternate_precedence": "f AND len(list_filter(pb, lambda j: len(list_filter(pa, lambda i: i < j AND len(list_filter(pb, lambda h: h >= i AND h < j)) = 0)) = 0)) = 0",
        "chain_response": "f AND len(list_filter(pa, lambda i: NOT list_contains(pb, i + 1))) = 0", "chain_precedence": "f AND len(list_filter(pb, lambda j: NOT list_contains(pa, j - 1))) = 0",
        "chain_succession": "f AND len(list_filter(pa, lambda i: NOT list_contains(pb, i + 1))) = 0 AND len(list_filter(pb, lambda j: NOT list_contains(pa, j - 1))) = 0",
        "not_succession": "NOT f", "not_chain_succession": "len(list_filter(pa, lambda i: list_contains(pb, i + 1))) = 0",
    }
    ordered = ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items())
    tail = f"""CASE template WHEN 'existence' THEN sum(matches) OVER (PARTITION BY template, a ORDER BY n DESC) WHEN 'absence' THEN sum(matches) OVER (PARTITION BY template, a ORDER BY n) + (SELECT count(*) FROM {src}) - (SELECT c FROM pr{tag} WHERE act = a) ELSE matches END""" if cumulative else "matches"
    return (
        f"pr{tag} AS MATERIALIZED (SELECT act, count(*) AS c FROM (SELECT DISTINCT run_id, unnest(l) AS act FROM {src}) GROUP BY act)",
        f"ex{tag} AS (SELECT act AS a, c AS k, count(*) AS m FROM (SELECT run_id, act, count(*) AS c FROM (SELECT run_id, unnest(l) AS act FROM {src}) GROUP BY ALL) GROUP BY ALL)",
        f"op{tag} AS (SELECT run_id, a, b, pa, pb, list_min(pa) < list_max(pb) AS f FROM (SELECT x.run_id, a, b, {pos('a')} AS pa, {pos('b')} AS pb FROM (SELECT run_id, l, unnest(list_distinct(l)) AS a FROM {src}) x JOIN (SELECT run_id, unnest(list_distinct(l)) AS b FROM {src}) y USING (run_id)))",
        f"gp{tag} AS (SELECT p.act AS a, q.act AS b, r.run_id, list_contains(l, p.act) AS ia, list_contains(l, q.act) AS ib FROM pr{tag} p JOIN pr{tag} q ON p.act < q.act, {src} r)",
        f"""mc{tag} AS (SELECT template, a, b, n, count(*) AS matches FROM (
          SELECT 'init' AS template, l[1] AS a, CAST(NULL AS VARCHAR) AS b, CAST(NULL AS INTEGER) AS n FROM {src} UNION ALL SELECT 'end', l[-1], NULL, NULL FROM {src}
          UNION ALL SELECT unnest(list_filter([{ordered}], lambda t: t IS NOT NULL)), a, b, NULL FROM op{tag}
          UNION ALL SELECT unnest(list_filter([CASE WHEN ia AND ib THEN 'coexistence' END, CASE WHEN ia OR ib THEN 'choice' END, CASE WHEN ia <> ib THEN 'exclusive_choice' END, CASE WHEN NOT (ia AND ib) THEN 'not_coexistence' END], lambda t: t IS NOT NULL)), a, b, NULL FROM gp{tag}) GROUP BY ALL
          UNION ALL SELECT unnest(['exactly', 'existence', 'absence']), a, NULL, CAST(unnest([k, k, k + 1]) AS INTEGER), m FROM ex{tag})""",
        f"mt{tag} AS (SELECT template, a, b, n, {tail} AS matches FROM mc{tag})",
        f"""mn{tag} AS MATERIALIZED (SELECT template, a, b, n, CAST(matches AS BIGINT) AS matches, matches / total AS support,
          CASE WHEN template IN ('coexistence', 'choice', 'exclusive_choice') THEN matches / sqrt(x.c * y.c) WHEN template = 'not_coexistence' THEN sqrt(((x.c - (total - matches)) / x.c) * ((y.c - (total - matches)) / y.c)) ELSE matches / x.c END AS confidence,
          CASE WHEN b IS NOT NULL THEN matches / total / nullif(CASE WHEN template = 'not_coexistence' THEN 1 - (x.c / total) * (y.c / total) ELSE (x.c / total) * (y.c / total) END, 0) END AS interest
          FROM mt{tag} JOIN pr{tag} x ON x.act = a LEFT JOIN pr{tag} y ON y.act = b, (SELECT count(*) AS total FROM {src}) t)""",
    )


_STAT = "matches, round(support, 6) AS support, round(confidence, 6) AS confidence, round(interest, 6) AS interest"
_BANKRUNS = "br AS MATERIALIZED (SELECT ref_id AS run_id, labels AS l FROM bank)"


def mined(where: str = "true", log_: str = SESSION, cumulative: bool = False) -> str:
    return sql(f"SELECT template, a, b, n, {_STAT} FROM mn WHERE {where}", log_, _BANKRUNS, *_mined("br", cumulative=cumulative))


def discriminative(delta: str = "0.2", support: str = "0.6", top_k: int = 200, log_: str = SESSION) -> str:
    return sql(f"""SELECT side, template, a, b, n, round(support, 6) AS support, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY side ORDER BY round(weight, 9) DESC, template, a, b NULLS FIRST, n NULLS FIRST) AS INTEGER) AS rank FROM (
  SELECT CASE WHEN sp >= {support} AND sp - sm >= {delta} THEN 'plus' WHEN sm >= {support} AND sm - sp >= {delta} AND template IN ('init', 'existence', 'response', 'precedence', 'succession', 'alternate_response', 'alternate_precedence', 'chain_response', 'chain_precedence', 'chain_succession', 'coexistence') THEN 'minus' END AS side,
    template, a, b, n, CASE WHEN sp >= {support} AND sp - sm >= {delta} THEN sp ELSE sm END AS support, abs(sp - sm) AS weight
  FROM (SELECT coalesce(p.template, m.template) AS template, coalesce(p.a, m.a) AS a, coalesce(p.b, m.b) AS b, coalesce(p.n, m.n) AS n, coalesce(p.support, 0) AS sp, coalesce(m.support, 0) AS sm
    FROM (SELECT * FROM mnp WHERE template NOT IN ('succession', 'chain_succession', 'not_coexistence', 'end', 'choice')) p FULL JOIN (SELECT * FROM mnm WHERE template NOT IN ('succession', 'chain_succession', 'not_coexistence', 'end', 'choice')) m
    ON p.template = m.template AND p.a = m.a AND p.b IS NOT DISTINCT FROM m.b AND p.n IS NOT DISTINCT FROM m.n)) WHERE side IS NOT NULL QUALIFY rank <= {top_k}""", log_,
        "rp AS MATERIALIZED (SELECT run_id, labels AS l FROM tr WHERE success AND n >= 3)", "rm AS MATERIALIZED (SELECT run_id, labels AS l FROM tr WHERE NOT success AND n >= 3)", *_mined("rp", "p"), *_mined("rm", "m"))


def census(support: float, log_: str = SESSION) -> str:
    return sql(f"SELECT template, count(*) AS \"constraints\", CAST(count(*) AS DOUBLE) AS weight FROM mn WHERE support >= {support} AND template NOT IN ('succession', 'chain_succession', 'not_coexistence', 'end', 'choice', 'existence', 'absence', 'exactly', 'init') GROUP BY template", log_, _BANKRUNS, *_mined("br", cumulative=True))


# ---- calibration and evaluation, on third-nearest Jaccard
_EVAL = (*_JAC, "sc AS MATERIALIZED (SELECT run_id, pos, round(list_sort(list(d))[3], 9) AS score FROM jc WHERE run_id NOT IN (SELECT ref_id FROM bank) AND run_id IN (SELECT run_id FROM tr WHERE n >= 3) GROUP BY run_id, pos)",
    "lo AS MATERIALIZED (SELECT j.run_id, pos, round(list_sort(list(d))[3], 9) AS score FROM jc j JOIN bank b ON b.ref_id = j.run_id WHERE j.bank_idx <> b.bank_idx GROUP BY j.run_id, pos)",
    "pk AS (SELECT run_id, max(score) AS peak FROM lo WHERE pos >= 2 GROUP BY run_id)", "th AS MATERIALIZED (SELECT list_sort(list(peak))[1 + CAST(least(count(*) - 1, ceil(0.9 * (count(*) - 1))) AS BIGINT)] AS threshold FROM pk)",
    "ov AS (SELECT *, score > threshold AND pos + 1 >= 3 AS over FROM sc, th)", "o2 AS (SELECT *, over AND coalesce(lag(over) OVER (PARTITION BY run_id ORDER BY pos), false) AS fires FROM ov)",
    "dc AS MATERIALIZED (SELECT run_id, min(CASE WHEN fires THEN pos + 1 END) AS step, max(score) AS peak, max(pos) + 1 AS n FROM o2 GROUP BY run_id)", "dl2 AS (SELECT dc.*, success FROM dc JOIN (SELECT run_id, success FROM tr) USING (run_id))")
PEAKS = sql("SELECT run_id, round(peak, 6) AS peak FROM pk", SESSION, *_EVAL)
THRESHOLD = sql("SELECT round(threshold, 6) AS threshold FROM th", SESSION, *_EVAL)
DECISIONS = sql("SELECT run_id, step IS NOT NULL AS fired, CAST(step AS INTEGER) AS step, round(step / n, 6) AS frac, round(peak, 6) AS peak, CAST(n AS INTEGER) AS n FROM dc", SESSION, *_EVAL)
METRICS = sql("""SELECT tp, fp, pos, neg, runs, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1, round(fp / nullif(neg, 0), 6) AS fpr, round((tp + fp) / runs, 6) AS flag_rate, round(ef, 6) AS earliness_frac, round(es, 6) AS earliness_step
  FROM (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(pos, 0) AS r FROM (SELECT count(*) FILTER (step IS NOT NULL AND NOT success) AS tp, count(*) FILTER (step IS NOT NULL AND success) AS fp, count(*) FILTER (NOT success) AS pos, count(*) FILTER (success) AS neg, count(*) AS runs,
    avg(step / n) FILTER (NOT success) AS ef, avg(step) FILTER (NOT success) AS es FROM dl2))""", SESSION, *_EVAL)
CALIBRATED = sql("SELECT round(list_sort(list(peak))[1 + CAST(least(count(*) - 1, ceil(0.9::DOUBLE * (count(*) - 1))) AS BIGINT)], 6) AS threshold FROM (SELECT run_id, max(score) AS peak FROM sc JOIN tr USING (run_id) WHERE success AND pos >= 2 GROUP BY run_id)", SESSION, *_EVAL)
ROC = sql("""SELECT round((sum(r) FILTER (NOT success) - count(*) FILTER (NOT success) * (count(*) FILTER (NOT success) + 1) / 2) / (count(*) FILTER (NOT success) * count(*) FILTER (success)), 6) AS auc_roc
  FROM (SELECT *, rank() OVER (ORDER BY peak) + (count(*) OVER (PARTITION BY peak) - 1) / 2 AS r FROM dl2)""", SESSION, *_EVAL)
PR = sql("""SELECT round(sum(CASE WHEN NOT success THEN tp / k END) / count(*) FILTER (NOT success), 6) AS auc_pr FROM (SELECT success, row_number() OVER w AS k, sum(CAST(NOT success AS INTEGER)) OVER (ORDER BY peak DESC, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp FROM dl2 WINDOW w AS (ORDER BY peak DESC, run_id))""", SESSION, *_EVAL)
FAILURES = sql("SELECT round(avg(CASE WHEN success THEN 0 ELSE 1 END), 6) AS failure_rate FROM tr")
SUMMARY = "SELECT count(*) AS runs, count(DISTINCT task_id) AS tasks, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, round(avg(CASE WHEN success THEN 0 ELSE 1 END), 6) AS failure_rate, list_sort(list(n))[1 + count(*) // 2] AS length, list_sort(list(n) FILTER (success))[1 + count(*) FILTER (success) // 2] AS length_success, list_sort(list(n) FILTER (NOT success))[1 + count(*) FILTER (NOT success) // 2] AS length_failure, (SELECT count(DISTINCT act) FROM ev) AS alphabet FROM tr"


# ---- the sweep, draws as data: variant '' of a draw is its whole bank, the others leave one reference out
def sweep_cells(log_: str, seeds: tuple[int, ...], sizes: tuple[int, ...], detectors: tuple[str, ...], quantiles: tuple[float, ...] = (0.9, 0.95, 0.99), warmups: tuple[int, ...] = (1, 3), support: float = 1.0) -> tuple[str, ...]:
    """CTEs of which the last, cells, has the metrics of every draw, detector, quantile and warm-up."""
    values = lambda xs: ", ".join(f"({x})" for x in xs)
    third = lambda c: f"list_sort(list({c}))[least(3, count(*))]"
    bank_forms = {
        "dl/max@3": third("dl"), "dltr/max@3": third("dt"), "dl/min": "min(dl)", "dl/mean@3": "list_avg(list_sort(list(dl))[1:3])", "dl/q25": "quantile_cont(dl, 0.25)",
        "jac/max@3": third("jc"), "jac/min": "min(jc)", "jac_pre/max@3": third("jp"), "cont/min": "min(ct)",
    }
    key = "seed, k, v, run_id, success, n, pos"
    ctes = [
        f"dr AS (SELECT seed, k FROM (VALUES {values(seeds)}) x(seed), (VALUES {values(sizes)}) y(k))",
        f"bk AS MATERIALIZED (SELECT seed, run_id AS ref_id, labels, n, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || run_id)) - 1 AS bank_idx FROM tr, (VALUES {values(seeds)}) x(seed) WHERE success AND n >= 3 QUALIFY bank_idx < {max(sizes)})",
        "bd AS MATERIALIZED (SELECT seed, k, ref_id, labels, n, bank_idx FROM bk JOIN dr USING (seed) WHERE bank_idx < k)",
        "vr AS (SELECT seed, k, '' AS v FROM dr UNION ALL SELECT seed, k, ref_id FROM bd)",
        "bv AS MATERIALIZED (SELECT seed, k, v, ref_id, labels, n FROM vr JOIN bd USING (seed, k) WHERE ref_id <> v)",
        "tg AS MATERIALIZED (SELECT seed, k, '' AS v, run_id, success, n FROM dr, tr WHERE n >= 3 AND NOT EXISTS (SELECT 1 FROM bd WHERE bd.seed = dr.seed AND bd.k = dr.k AND ref_id = run_id) UNION ALL SELECT seed, k, ref_id, ref_id, true, n FROM bd)",
        "te AS MATERIALIZED (SELECT tg.*, pos, act, lag(act) OVER (PARTITION BY seed, k, v, run_id ORDER BY pos) AS prev FROM tg JOIN (SELECT run_id, pos, act FROM ev) USING (run_id))",
        "rl AS MATERIALIZED (SELECT DISTINCT ref_id, labels AS r FROM bd)", "rb AS (SELECT seed, k, v, ref_id, unnest(range(0, n)) AS pos, unnest(labels) AS act FROM bv)",
    ]
    curves = []
    wanted = [d for d in bank_forms if d in detectors]
    if wanted:
        edits = any(d.startswith("dl") for d in wanted)
        if edits:
            ctes += [
                _DL.replace("dl AS (SELECT run_id, bank_idx, t.labels, b.labels AS r", "de AS (SELECT run_id, ref_id, t.labels, b.r AS r").replace("len(b.labels)", "len(b.r)").replace("FROM tr t, bank b", "FROM tr t, rl b").replace("SELECT run_id, bank_idx, labels, r", "SELECT run_id, ref_id, labels, r").replace("FROM dl WHERE", "FROM de WHERE"),
                "ed AS MATERIALIZED (SELECT run_id, ref_id, i - 1 AS pos, least(1, list_min(cur) / i) AS dl, least(1, cur[least(i, len(r)) + 1] / i) AS dt FROM de WHERE i > 0)",
            ]
        ctes += [
            "sd AS MATERIALIZED (SELECT run_id, ref_id, pos, 1 - len(list_intersect(p, r)) / len(list_distinct(p || r)) AS jc, 1 - len(list_intersect(p, r[:pos + 1])) / len(list_distinct(p || r[:pos + 1])) AS jp, 1 - len(list_intersect(p, r)) / len(list_distinct(p)) AS ct FROM (SELECT run_id, pos, labels[:pos + 1] AS p, ref_id, r FROM (SELECT run_id, labels, unnest(range(0, n)) AS pos FROM tr), rl))",
            f"bs AS MATERIALIZED (SELECT {key}, " + ", ".join(f'{bank_forms[d]} AS "{d}"' for d in wanted) + f" FROM te JOIN bv b USING (seed, k, v) JOIN sd USING (run_id, ref_id, pos){' JOIN ed USING (run_id, ref_id, pos)' if edits else ''} GROUP BY ALL)".replace("te JOIN bv b", "(SELECT seed, k, v, run_id, success, n, pos FROM te) JOIN (SELECT seed, k, v, ref_id FROM bv)"),
        ]
        curves += [f"SELECT {key}, '{d}' AS detector, \"{d}\" AS score FROM bs" for d in wanted]
    ctes += _walk("ev", "")
    forms = {"return_rate": "return_rate", "edge_novelty": "edge_novelty"}
    curves += [f"SELECT {key}, '{d}', {c} FROM te JOIN (SELECT run_id, pos, return_rate, edge_novelty FROM wf) USING (run_id, pos)" for d, c in forms.items() if d in detectors]
    if "step_count" in detectors:
        curves.append(f"SELECT {key}, 'step_count', least(1, (pos + 1) / 60) FROM te")
    if "df_legality" in detectors:
        ctes.append("lk AS (SELECT DISTINCT seed, k, v, a AS prev, act, 1 AS known FROM (SELECT *, lag(act) OVER (PARTITION BY seed, k, v, ref_id ORDER BY pos) AS a FROM rb) WHERE a IS NOT NULL)")
        curves.append(f"SELECT {key}, 'df_legality', CASE WHEN pos > 0 THEN sum(CAST(prev IS NOT NULL AND known IS NULL AS INTEGER)) OVER (PARTITION BY seed, k, v, run_id ORDER BY pos) / pos ELSE 0 END FROM te LEFT JOIN lk USING (seed, k, v, prev, act)")
    if "graph_progress" in detectors:
        ctes.append("gm AS (SELECT seed, k, v, act, avg(pos + 1) AS mu FROM rb GROUP BY ALL)")
        curves.append(f"SELECT {key}, 'graph_progress', CASE WHEN mu IS NULL THEN 0.5 ELSE {SIG.format('(pos + 1 - mu) / 5')} END FROM te LEFT JOIN gm USING (seed, k, v, act)")
    for d, c in (("cycle_absz", "return_rate"), ("edge_absz", "edge_novelty")):
        if d in detectors:
            ctes.append(f"{d} AS MATERIALIZED (SELECT seed, k, v, pos AS step, avg({c}) AS mu, greatest(coalesce(stddev_samp({c}), 0), 1e-6) AS sd FROM bv JOIN (SELECT run_id AS ref_id, pos, {c} FROM wf) USING (ref_id) GROUP BY seed, k, v, pos)")
            curves.append(f"SELECT {key}, '{d}', {SIG.format(f'(abs({c} - mu) / sd - 1)')} FROM te JOIN (SELECT run_id, pos, {c} FROM wf) USING (run_id, pos) JOIN (SELECT seed, k, v, max(step) AS last FROM {d} GROUP BY ALL) USING (seed, k, v) JOIN {d} p USING (seed, k, v) WHERE p.step = least(pos, last)")
    if {"dcl_viol", "dcl_div"} & set(detectors):
        if len(seeds) * len(sizes) != 1:
            raise ValueError("the SQL mines one draw's model")
        ctes += [
            "br AS MATERIALIZED (SELECT ref_id AS run_id, labels AS l FROM bd)", *_mined("br", cumulative=True),
            f"cn AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY template, a, b) - 1 AS INTEGER) AS cid, template, a, b, n, 1.0 AS weight FROM mn WHERE support >= {support} AND template NOT IN ('succession', 'chain_succession', 'not_coexistence', 'end', 'choice', 'existence', 'absence', 'exactly', 'init'))",
            *_verdicts(), "sg AS MATERIALIZED (SELECT run_id, pos, coalesce(list(cid * 4 + state) FILTER (activated), []) AS s, count(*) FILTER (state = 0) AS broken FROM vd GROUP BY ALL)",
            f"""dv AS (SELECT {', '.join('t.' + c for c in key.split(', '))}, any_value(m.broken) AS broken, {third('coalesce(1 - len(list_intersect(m.s, r.s)) / nullif(len(list_distinct(m.s || r.s)), 0), 0)')} AS div
              FROM te t JOIN sg m ON m.run_id = t.run_id AND m.pos = t.pos JOIN bv b ON b.seed = t.seed AND b.k = t.k AND b.v = t.v JOIN sg r ON r.run_id = b.ref_id AND r.pos = least(t.pos, b.n - 1) GROUP BY ALL)""",
        ]
        curves += [f"SELECT {key}, '{d}', {c} FROM dv" for d, c in (("dcl_viol", "1 - exp(-broken / 8)"), ("dcl_div", "div")) if d in detectors]
    return (
        *ctes, f"cv AS MATERIALIZED (SELECT seed, k, v, run_id, success, n, pos, detector, round(CAST(score AS DOUBLE), 9) AS score FROM ({' UNION ALL '.join(curves)}) c({key}, detector, score))",
        f"ts AS (SELECT CAST(q AS DOUBLE) AS q, CAST(w AS INTEGER) AS w, 3 * w AS start FROM (VALUES {values(quantiles)}) x(q), (VALUES {values(warmups)}) y(w))",
        "pk AS (SELECT seed, k, detector, q, w, start, run_id, max(score) AS peak FROM cv, ts WHERE v <> '' AND pos >= start - 1 GROUP BY ALL)",
        "tp AS (SELECT seed, k, detector, q, w, list_sort(list(peak))[1 + CAST(least(count(*) - 1, ceil(q * (count(*) - 1))) AS BIGINT)] AS threshold FROM pk GROUP BY seed, k, detector, q, w)",
        "th AS MATERIALIZED (SELECT d.*, ts.*, coalesce(threshold, 'inf'::DOUBLE) AS threshold FROM (SELECT DISTINCT seed, k, detector FROM cv) d CROSS JOIN ts LEFT JOIN tp USING (seed, k, detector, q, w))",
        "ov AS (SELECT c.seed, c.k, c.detector, q, w, threshold, run_id, success, n, pos, score > threshold AND pos + 1 >= start AS over FROM cv c JOIN th USING (seed, k, detector) WHERE v = '')",
        "o2 AS (SELECT *, over AND coalesce(lag(over) OVER (PARTITION BY seed, k, detector, q, w, run_id ORDER BY pos), false) AS fires FROM ov)",
        "dc AS (SELECT seed, k, detector, q, w, threshold, run_id, success, n, min(CASE WHEN fires THEN pos + 1 END) AS step FROM o2 GROUP BY ALL)",
        """cells AS MATERIALIZED (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(pos, 0) AS recall, 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(pos, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(pos, 0), 0) AS f1, fp / nullif(neg, 0) AS fpr, (tp + fp) / runs AS flag_rate
          FROM (SELECT CAST(seed AS INTEGER) AS seed, CAST(k AS INTEGER) AS k, detector, q, w, threshold, count(*) FILTER (step IS NOT NULL AND NOT success) AS tp, count(*) FILTER (step IS NOT NULL AND success) AS fp, count(*) FILTER (NOT success) AS pos, count(*) FILTER (success) AS neg,
            count(*) AS runs, avg(step / n) FILTER (NOT success) AS earliness_frac, avg(step) FILTER (NOT success) AS earliness_step FROM dc GROUP BY ALL))""",
    )


_CELL = "detector, q, w, round(threshold, 6) AS threshold, tp, fp, pos, neg, runs, " + ", ".join(f"round({m}, 6) AS {m}" for m in ("precision", "recall", "f1", "fpr", "flag_rate", "earliness_frac", "earliness_step"))


def sweep(log_: str, seeds: tuple[int, ...], sizes: tuple[int, ...], detectors: tuple[str, ...], one: bool = False, **options) -> str:
    return sql(f"SELECT {'' if one else 'seed, k, '}{_CELL} FROM cells", log_, *sweep_cells(log_, seeds, sizes, detectors, **options))


# ---- reports over the cells of a small sweep: two logs, three seeds, two bank sizes, two Jaccard detectors, two quantiles
REPORTED = ("jac/max@3", "jac/min")


def report(body: str) -> str:
    """`per` has the mean over seeds of each environment and setting."""
    parts = " UNION ALL ".join("SELECT '" + name + "' AS environment, * FROM (" + sql("SELECT * FROM cells", log_, *sweep_cells(log_, (0, 1, 2), (16, 32), REPORTED, (0.9, 0.95), (1,))) + ")" for name, log_ in (("session", SESSION), ("order", ORDER)))
    return f"""WITH cells AS MATERIALIZED ({parts}),
per AS (SELECT environment, k, detector, q, w, avg(f1) AS f1, avg(earliness_frac) AS earliness_frac, avg(flag_rate) AS flag_rate FROM cells GROUP BY ALL),
pe AS (SELECT detector, environment, avg(coalesce(f1, 0)) AS f1, avg(earliness_frac) AS earliness_frac, avg(flag_rate) AS flag_rate FROM per GROUP BY ALL)
{body}"""


ENVIRONMENTS = report("SELECT detector, environment, round(f1, 6) AS f1, round(earliness_frac, 6) AS earliness_frac, round(flag_rate, 6) AS flag_rate FROM pe")
REPORT_SUMMARY = report("SELECT detector, round(avg(f1), 6) AS mean, round(coalesce(stddev_samp(f1), 0) / sqrt(count(f1)), 6) AS sem FROM pe GROUP BY detector")
BEST_SETTING = report("SELECT detector, k, q, round(f1, 6) AS f1 FROM (SELECT detector, k, q, avg(coalesce(f1, 0)) AS f1 FROM per GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY detector ORDER BY round(f1, 9) DESC, k, q) = 1")
REPETITIONS = report("SELECT environment, k, detector, q, round(avg(recall), 6) AS mean, round(coalesce(stddev_samp(recall), 0), 6) AS std FROM cells GROUP BY environment, k, detector, q")
#: Every metric of every setting: mean, deviation and the values by seed, as text.
SEEDS = report("SELECT environment, k, detector, q, w, metric, round(avg(value), 6) AS mean, CASE WHEN count(value) > 0 THEN round(coalesce(stddev_samp(value), 0), 6) END AS std, array_to_string(list(coalesce(printf('%.6f', value), 'null') ORDER BY seed), ' ') AS raw FROM (SELECT environment, k, detector, q, w, seed, unnest(['f1', 'flag_rate', 'fpr', 'precision', 'recall', 'earliness_frac', 'earliness_step']) AS metric, unnest([f1, flag_rate, fpr, precision, recall, earliness_frac, earliness_step]) AS value FROM cells) GROUP BY ALL")

# ---- projection: messages made from sessions
def projected(granularity: str, family: str) -> str:
    err = "CASE WHEN act <> 'error' THEN CASE WHEN status = 'empty' THEN 'empty' ELSE 'ok' END WHEN status = 'policy' THEN 'policy' ELSE 'notfound' END"
    known = {"purchase": "write", "signup": "write", "click": "read", "view": "read"}
    rw = "CASE " + " ".join(f"WHEN act = '{a}' THEN '{k}'" for a, k in known.items()) + " ELSE 'unknown' END" if family == "object" else "'read'"
    fixed = "act IN ('respond', 'user', 'end_conversation')"
    user = "(act = 'view' AND sub = 1)" if family == "object" else "false"
    urw = f"CASE WHEN {user} THEN 'u:' ELSE '' END || {rw}"
    tail = f"CASE WHEN {err} = 'ok' THEN '' ELSE '!' || {err} END"
    forms = {
        "tool": "act", "tool_status": "CASE WHEN act = 'error' THEN 'error!err' ELSE act END", "rw": f"CASE WHEN {fixed} THEN act ELSE {urw} END", "role": f"CASE WHEN {fixed} THEN act WHEN {user} THEN 'user_tool' ELSE 'tool' END",
        "calls": "act", "agent": "act", "tool_result": f"CASE WHEN {fixed} THEN act ELSE act || {tail} END", "status": f"CASE WHEN {fixed} THEN act ELSE {err} END", "rw_status": f"CASE WHEN {fixed} THEN act ELSE {urw} || {tail} END",
    }
    keep = {"calls": f"NOT {fixed}", "agent": f"act NOT IN ('user', 'end_conversation') AND NOT {user}"}.get(granularity, "true")
    end = "SELECT run_id, n AS pos, 'end_conversation', 'ok', 2 FROM tr"
    return sql(f"SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY pos, sub) - 1 AS INTEGER) AS pos, {forms[granularity]} AS act FROM m WHERE {keep}", SESSION,
               f"m(run_id, pos, act, status, sub) AS (SELECT run_id, pos, act, status, 1 FROM ev UNION ALL SELECT run_id, pos, 'respond', 'ok', 0 FROM ev WHERE act = 'signup' UNION ALL {end})")


COVERAGE = sql("SELECT act AS tool, count(*) AS calls, count(*) FILTER (act <> 'error') AS ok, count(*) FILTER (act = 'error') AS err, act <> 'error' AS known, act = 'error' AS hallucinated FROM ev GROUP BY act")


def live(rows: list[tuple]) -> str:
    """Each score of the stream, as the same score of whole runs says it; sign-ups are answers there, not tool calls."""
    forms = {
        "edit_knn": (edit_distance("dl"), "d_max3"), "edit_full_knn": (edit_distance("dl_full"), "d_max3"), "edit_trunc_knn": (edit_distance("dl_trunc"), "d_max3"),
        **{f"{n}_knn": (set_distance(n), "d_max3") for n in ("jaccard", "jaccard_prefix", "ngram2_jaccard", "ngram2_jaccard_prefix", "ngram3_jaccard")}, "cosine_knn": (set_distance("cosine_count"), "d_max3"), "containment_min": (set_distance("containment"), "d_min"),
        **{n: (walk(n), "score") for n in ("return_rate", "edge_novelty")}, **{n: (profile(n), "score") for n in ("cycle_resid", "cycle_absz", "edge_absz")}, "df_legality": (LEGALITY, "score"), "graph_progress": (PROGRESS, "score"), "dfg_fitness": (REPLAY, "score"),
        "ngram0": (ngram(0), "score"), "ngram1": (ngram(1), "score"), "step_surprisal": (SURPRISAL, "score"), **{n: (counted(n), "score") for n in COUNTED},
        "dcl_viol": (over_verdicts(SCORES, rows), "dcl_pos_viol"), "dcl_div": (signature_bank(rows, "prefix"), "d_max3"),
    }
    joined = " JOIN ".join(f"(SELECT run_id, pos, {c} AS {n} FROM ({body})){' USING (run_id, pos)' if i else ''}" for i, (n, (body, c)) in enumerate(forms.items()))
    text = "SELECT run_id, pos, " + ", ".join(f"round({n}, 6) AS {n}" for n in forms) + " FROM " + joined
    text = text.replace(STATS, "list_sort(list(d))[1] AS d_min, list_sort(list(d))[3] AS d_max3")  # rounded once
    return text.replace("24 HOUR", "1000000 HOUR").replace("'tool' AS kind", "CASE WHEN event_type = 'signup' THEN 'respond' ELSE 'tool' END AS kind")
