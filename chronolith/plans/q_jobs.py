"""Queries over quality, factors, sources, sinks, streams and usage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronolith.functions import codes, usage
from chronolith.operators import adjust, calendar, factors, pit, quality
from chronolith.plans.q_identity import _DIFF, _STAMP, NOW
from chronolith.plans.registry import query
from chronolith.plans.spec import BAR, FACTOR, LINE
from chronolith.sources import sinks, vendor
from chronolith.streaming.restate import stream_restate, stream_restate_state

NOON = "2024-01-20 12:00:00"
TOP = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY {o}) = 1"
LATEST = "(SELECT * FROM b_line " + TOP.format(k="l_orderkey, l_linenumber", o="knowledge_time DESC, version DESC") + ")"
COLS = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_returnflag"
LIST = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
DAYS = "SELECT DISTINCT trade_date FROM b_calendar WHERE is_open"


def latest(t):
    return pit.storage_latest(t.b_line, LINE)


def open_days(t):
    return t.b_calendar.where("is_open").select("trade_date").distinct()


# quality

query("quality_unique", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")(
    lambda t: quality.unique(t.lineitem, ["l_orderkey", "l_linenumber"]).select(*LIST)
)
query("quality_not_null", "SELECT entity_id, trade_date, close FROM b_bar_b WHERE close IS NULL", "b_bar_b")(lambda t: quality.not_null(t.b_bar_b, ["entity_id", "close"]))
query("quality_range", f"SELECT {COLS} FROM {LATEST} WHERE l_quantity < 3 OR l_quantity > 45", "b_line")(lambda t: quality.in_range(latest(t), "l_quantity", 3, 45).select(*LIST))
query("quality_enum", f"SELECT {COLS} FROM {LATEST} WHERE l_returnflag NOT IN ('A', 'R')", "b_line")(lambda t: quality.in_enum(latest(t), "l_returnflag", ["A", "R"]).select(*LIST))
query("quality_expression", f"SELECT {COLS} FROM {LATEST} WHERE NOT (l_extendedprice / nullif(l_quantity, 0) < 1800 AND l_partkey > 0)", "b_line")(
    lambda t: quality.expression(latest(t), "try_divide(l_extendedprice, l_quantity) < 1800 AND l_partkey > 0").select(*LIST)
)
query("quality_jump", "SELECT entity_id, trade_date, close, previous FROM (SELECT *, lag(close) OVER (PARTITION BY entity_id ORDER BY trade_date) AS previous FROM b_bar1 WHERE trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') WHERE previous <> 0 AND abs(close - previous) / abs(previous) > 2", "b_bar1")(
    lambda t: quality.jump(t.b_bar1.where("trade_date BETWEEN DATE'2024-01-05' AND DATE'2024-01-25'"), "entity_id", "trade_date", "close", 2.0).select("entity_id", "trade_date", "close", "previous")
)
query("quality_reconcile", "SELECT entity_id, trade_date, close FROM b_bar1 b WHERE NOT EXISTS (SELECT 1 FROM b_calendar c WHERE c.is_open AND c.trade_date = b.trade_date)", ("b_bar1", "b_calendar"))(
    lambda t: quality.reconcile(t.b_bar1, t.b_calendar, ["trade_date"]).select("entity_id", "trade_date", "close")
)

_EXPECTED = f"""SELECT entity_id, trade_date FROM (SELECT m.entity_id, d.trade_date, m.status FROM b_market m JOIN ({DAYS}) d ON m.start_date <= d.trade_date AND (m.end_date IS NULL OR m.end_date >= d.trade_date)
    {TOP.format(k='m.entity_id, d.trade_date', o='m.start_date DESC, m.version DESC, m.knowledge_time DESC')}) WHERE status IS NULL OR status <> 'delisted'"""
_MISSING = f"""SELECT e.* FROM ({_EXPECTED}) e WHERE NOT EXISTS (SELECT 1 FROM b_bar b WHERE b.entity_id = e.entity_id AND b.trade_date = e.trade_date)
    AND NOT EXISTS (SELECT 1 FROM b_status s WHERE s.entity_id = e.entity_id AND s.trade_date = e.trade_date AND s.is_suspended)"""
_PAIRS = ("b_market", "b_calendar", "b_bar", "b_status")


def _runs(t):
    """Runs of expected and of missing days."""
    segments = quality.expected_segments(t.b_market, open_days(t))
    return segments, quality.missing_runs(segments, open_days(t), t.b_bar, t.b_status)


query("quality_missing_pairs", _MISSING, _PAIRS)(lambda t: quality.pairs_of(_runs(t)[1], open_days(t)))
query("quality_completeness", f"SELECT expected, missing, round((expected - missing) / expected, 6) AS ratio FROM (SELECT (SELECT count(*) FROM ({_EXPECTED})) AS expected, (SELECT count(*) FROM ({_MISSING})) AS missing)", _PAIRS)(lambda t: quality.coverage(*_runs(t)))
query("quality_break_days", f"SELECT a.trade_date, a.n AS expected, b.n AS missing FROM (SELECT trade_date, count(*) AS n FROM ({_EXPECTED}) GROUP BY 1) a JOIN (SELECT trade_date, count(*) AS n FROM ({_MISSING}) GROUP BY 1) b USING (trade_date) WHERE 1 - b.n / a.n < 0.95", _PAIRS)(
    lambda t: quality.break_days(*_runs(t), open_days(t), 0.95)
)
query(
    "quality_interval_completeness",
    f"""WITH e AS (SELECT x.entity_id, d.trade_date FROM (SELECT DISTINCT entity_id FROM b_market) x CROSS JOIN ({DAYS}) d)
    SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM b_market m WHERE m.entity_id % 3 <> 0 AND m.entity_id = e.entity_id AND m.start_date <= e.trade_date AND (m.end_date IS NULL OR m.end_date >= e.trade_date))""",
    ("b_market", "b_calendar"),
)(lambda t: quality.pairs_of(quality.uncovered_runs(t.b_market, t.b_market.where("entity_id % 3 <> 0"), open_days(t)), open_days(t)))
query("quality_freshness", f"SELECT latest, max(trade_date) AS last_open, count(*) FILTER (WHERE trade_date > latest) AS lag_days FROM (SELECT max(trade_date) AS latest FROM b_bar1 WHERE trade_date < DATE '2024-01-23'), ({DAYS}) GROUP BY latest", ("b_bar1", "b_calendar"))(
    lambda t: quality.freshness(t.b_bar1.where("trade_date < DATE'2024-01-23'"), open_days(t))
)

_COMMON = "SELECT entity_id, trade_date, x.close AS a, y.close AS b, abs(x.close - y.close) AS diff FROM b_bar1 x JOIN b_bar_b y USING (entity_id, trade_date)"
_STATS = """SELECT count(*) AS overlap_rows, count(*) FILTER (WHERE diff IS NULL) AS invalid_rows, count(*) FILTER (WHERE diff IS NULL OR diff > {tol}) AS violations, round(max(diff), 6) AS max_abs_diff, round(avg(diff), 6) AS mean_abs_diff,
    (SELECT count(*) FROM b_bar1) AS rows_a, (SELECT count(*) FROM b_bar_b) AS rows_b, (SELECT count(*) FROM b_bar1) + (SELECT count(*) FROM b_bar_b) - 2 * count(*) AS dropped_rows FROM ({c})"""
_LASTC = "max_by({c}, CASE WHEN {c} IS NOT NULL THEN trade_date END) OVER (PARTITION BY entity_id)"
_NORM = f"SELECT *, abs(a - b) AS diff FROM (SELECT entity_id, trade_date, a / nullif(last_value(a) OVER w, 0) AS a, b / nullif(last_value(b) OVER w, 0) AS b FROM ({_COMMON}) WINDOW w AS (PARTITION BY entity_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_TWO = ("b_bar1", "b_bar_b")
query("xsource_close", _STATS.format(tol="0.01", c=_COMMON), _TWO)(lambda t: quality.compare_sources(t.b_bar1, t.b_bar_b, "close", 0.01))
query("xsource_factor", _STATS.format(tol="0.0001", c=_NORM), _TWO)(lambda t: quality.compare_sources(t.b_bar1, t.b_bar_b, "close", 1e-4, True))
query("xsource_worst", f"SELECT entity_id, trade_date, a, b, round(diff, 6) AS diff FROM (SELECT * FROM ({_COMMON}) WHERE diff IS NULL OR diff > 0.01 ORDER BY diff DESC NULLS FIRST, entity_id, trade_date LIMIT 20)", _TWO)(
    lambda t: quality.worst(t.b_bar1, t.b_bar_b, "close", 0.01)
)

_CHECK = """SELECT '{d}' AS dataset, '{c}' AS check_id, '{f}' AS family, '{s}' AS severity, CASE WHEN v = 0 THEN 'passed' ELSE 'failed' END AS status, DATE '2024-01-01' AS window_start, DATE '2024-01-30' AS window_end, n AS rows_checked, v AS violations,
    CASE WHEN v = 0 THEN '[]' ELSE CAST(to_json((SELECT list(x ORDER BY x) FROM (SELECT {text} AS x FROM {bad} ORDER BY {order} LIMIT 20))) AS VARCHAR) END AS samples, {metrics} AS metrics, CASE WHEN v = 0 THEN 'passed' ELSE concat(v, ' violations') END AS message
    FROM (SELECT (SELECT count(*) FROM {rows}) AS n, (SELECT count(*) FROM {bad}) AS v)"""
_OTHER = "SELECT '{d}', '{c}', '{f}', '{s}', '{status}', DATE '2024-01-01', DATE '2024-01-30', 0, 0, '[]', '{{}}', '{m}'"
_LINES = dict(d="line", f="rule", s="error", rows=LATEST, metrics="'{}'", text="concat('l_orderkey=', l_orderkey, ', l_linenumber=', l_linenumber)", order="l_orderkey, l_linenumber")
_DAYS2 = dict(d="bar", s="error", text="concat('entity_id=', entity_id, ', trade_date=', trade_date)", order="entity_id, trade_date")
_RATIO = f"(SELECT CAST(to_json(struct_pack(expected := e, missing := m, ratio := round((e - m) / e, 6))) AS VARCHAR) FROM (SELECT (SELECT count(*) FROM ({_EXPECTED})) AS e, (SELECT count(*) FROM ({_MISSING})) AS m))"


@query(
    "quality_scan",
    " UNION ALL ".join([
        _CHECK.format(c="range", bad=f"(SELECT * FROM {LATEST} WHERE l_quantity < 0)", **_LINES),
        _CHECK.format(c="enum", bad=f"(SELECT * FROM {LATEST} WHERE l_returnflag NOT IN ('A', 'R'))", **(_LINES | {"s": "warn"})),
        _CHECK.format(c="empty", bad=f"(SELECT * FROM {LATEST} WHERE false)", **(_LINES | {"rows": f"(SELECT * FROM {LATEST} WHERE false)"})),
        _CHECK.format(c="reconcile", f="rule", rows="b_bar1", bad="(SELECT * FROM b_bar1 WHERE trade_date NOT IN (SELECT trade_date FROM b_calendar WHERE is_open))", metrics="'{}'", **_DAYS2),
        _CHECK.format(c="completeness", f="completeness", rows=f"({_EXPECTED})", bad=f"({_MISSING})", metrics=_RATIO, **_DAYS2),
        _OTHER.format(d="line", c="unplanned", f="rule", s="error", status="error", m="UNRESOLVED_COLUMN.WITH_SUGGESTION"), _OTHER.format(d="line", c="divided", f="rule", s="warn", status="error", m="DIVIDE_BY_ZERO"),
        _OTHER.format(d="line", c="no_target", f="rule", s="error", status="skipped", m="no target table"),
    ]), ("b_line", "b_bar1", *_PAIRS),
)
def _(t):
    lines, (segments, missing), bars = latest(t), _runs(t), t.b_bar1
    line = lambda name, severity, rule, checked=lines: quality.Check("line", name, "rule", severity, checked, rule, ["l_orderkey", "l_linenumber"])
    keys = ["entity_id", "trade_date"]
    figures = lambda: quality.coverage(segments, missing).select("expected", "missing", F.round("ratio", 6).alias("ratio"))
    return quality.scan(
        t.spark,
        [
            line("range", "error", lambda: F.col("l_quantity") < 0),
            line("enum", "warn", lambda: ~F.col("l_returnflag").isin("A", "R")),
            line("empty", "error", lambda: F.col("l_quantity") < 0, lines.where("false")),
            quality.Check("bar", "reconcile", "rule", "error", bars, lambda: quality.reconcile(bars, t.b_calendar, ["trade_date"]), keys),
            quality.Check("bar", "completeness", "completeness", "error", segments, lambda: quality.pairs_of(missing, open_days(t)), keys, figures, size=quality.held()),
            line("unplanned", "error", lambda: quality.expression(lines, "no_such_column > 0")),
            line("divided", "warn", lambda: quality.expression(lines, "1 / (l_quantity - l_quantity) > 0")),
            quality.Check("line", "no_target", "rule", "error", lines, None, skip="no target table"),
        ],
        ("2024-01-01", "2024-01-30"),
    )


_GUARD = "SELECT 'bar' AS dataset, '{c}' AS check_id, 'guard' AS family, 'error' AS severity, '{status}' AS status, DATE '2024-01-01' AS window_start, DATE '2024-01-30' AS window_end, {n} AS rows_checked, 0 AS violations, '[]' AS samples, '{{}}' AS metrics, '{m}' AS message"
_REFUSED = ("align_reserved", "align_key", "factor_docstring", "factor_twice", "factor_columns", "factor_cycle")


@query("guard_results", " UNION ALL ".join([_GUARD.format(c="factor_fine", status="passed", n="(SELECT count(*) FROM b_bar1)", m="passed (closes are not negative)"), *[_GUARD.format(c=c, status="error", n=0, m="ValueError") for c in _REFUSED]]), "b_bar1")
def _(t):
    """What alignment and factor registration refuse, as rows of a scan: each guard raises where its rule is planned."""
    bars, days = t.b_bar1, open_days(t)

    def registered(*made):
        registry = factors.Registry()
        for output, inputs, function in made:
            registry.register(output, 1, output, inputs)(function)
        return registry.evaluate(made[0][0], lambda names: bars.select("entity_id", "trade_date", *names), NOW).where(f"{made[0][0]} < 0")

    def plus(inputs, as_of):
        """Formula: the close.  PIT: as read."""
        return next(iter(inputs.values())).select("entity_id", "trade_date", F.lit(0.0).alias("plus")) if "close" not in inputs else inputs["close"].withColumnRenamed("close", "plus")

    def other(inputs, as_of):
        """Formula: the close.  PIT: as read."""
        return next(iter(inputs.values()))

    bare = lambda inputs, as_of: inputs["close"]
    rules = {
        "factor_fine": lambda: registered(("plus", ["close"], plus)),
        "align_reserved": lambda: calendar.align(bars.withColumn("status", F.lit("x")), BAR, days, bars),
        "align_key": lambda: calendar.align(bars, LINE, days, bars),
        "factor_docstring": lambda: registered(("plus", ["close"], bare)),
        "factor_twice": lambda: registered(("plus", ["close"], plus), ("plus", ["close"], plus)),
        "factor_columns": lambda: registered(("plus", ["close"], other)),
        "factor_cycle": lambda: registered(("plus", ["minus"], plus), ("minus", ["plus"], plus)),
    }
    notes = {"factor_fine": "closes are not negative"}
    checks = [quality.Check("bar", name, "guard", "error", bars, rule, note=notes.get(name, "")) for name, rule in rules.items()]
    return quality.scan(t.spark, checks, ("2024-01-01", "2024-01-30"))


_RUN = "(SELECT * FROM b_results WHERE (window_end, run_id) = (SELECT max((window_end, run_id)) FROM b_results))"
query(
    "quality_summary",
    f"""SELECT dataset, count(*) AS total, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'error') AS error,
    count(*) FILTER (WHERE severity = 'warn' AND status IN ('failed', 'error')) AS warnings, CAST(sum(violations) AS BIGINT) AS violations, coalesce(string_agg(DISTINCT CASE WHEN status = 'failed' THEN check_id END, ',' ORDER BY CASE WHEN status = 'failed' THEN check_id END), '') AS failed_checks,
    max(CASE WHEN check_id = 'completeness' THEN CAST(json_extract_string(metrics, '$.ratio') AS DOUBLE) END) AS coverage_ratio, max(CASE WHEN check_id = 'freshness' THEN CAST(json_extract_string(metrics, '$.lag_days') AS DOUBLE) END) AS lag_days FROM {_RUN} GROUP BY dataset""",
    "b_results",
)(lambda t: quality.summary(t.b_results))
query("quality_results", f"SELECT run_id, dataset, check_id, severity, status, violations, metrics, window_end FROM {_RUN} WHERE severity = 'error' ORDER BY dataset, check_id, status, violations LIMIT 12", "b_results")(
    lambda t: quality.latest_run(t.b_results).where("severity = 'error'").orderBy("dataset", "check_id", "status", "violations").limit(12)
)


@query(
    "freshness_board",
    f"""WITH d AS (SELECT DISTINCT event_type AS dataset FROM events UNION SELECT 'never'), m AS (SELECT event_type AS dataset, CAST(max(ts) AS DATE) - 5 AS mark FROM events WHERE event_type <> 'view' GROUP BY 1)
    SELECT d.dataset, CAST(m.mark AS DATE) AS mark, CASE WHEN m.mark IS NOT NULL THEN (SELECT count(*) FROM ({DAYS}) WHERE trade_date > m.mark AND trade_date <= DATE '2024-01-30') END AS lag, r.last_success, q.coverage_ratio, coalesce(q.failures, 0) AS failures
    FROM d LEFT JOIN m USING (dataset) LEFT JOIN (SELECT event_type AS dataset, max(ts) AS last_success FROM events WHERE value > 50 GROUP BY 1) r USING (dataset)
    LEFT JOIN (SELECT dataset, max(CASE WHEN check_id = 'completeness' THEN CAST(json_extract_string(metrics, '$.ratio') AS DOUBLE) END) AS coverage_ratio, count(*) FILTER (WHERE status IN ('failed', 'error')) AS failures FROM {_RUN} GROUP BY 1) q USING (dataset)""",
    ("b_results", "b_calendar"),
)
def _(t):
    events = t.events.withColumnRenamed("event_type", "dataset")
    datasets = events.select("dataset").distinct().union(t.spark.sql("SELECT 'never'"))
    marks = events.where("dataset <> 'view'").groupBy("dataset").agg(F.date_sub(F.to_date(F.max("ts")), 5).alias("mark"))
    runs = events.select("dataset", F.when(F.col("value") > 50, "success").alias("status"), F.col("ts").alias("finished_at"))
    return quality.freshness_board(datasets, marks, calendar.trading_lag(marks, t.b_calendar, "2024-01-30"), runs, t.b_results)


@query("replace_run", "SELECT run_id, dataset, check_id, severity, status, CAST(CASE WHEN run_id = 1 THEN 0 ELSE violations END AS BIGINT) AS violations, metrics, window_end FROM b_results", "b_results")
def _(t):
    path = sinks.shared_folder(t.spark, "quality")
    quality.replace_run(t.b_results, path)
    quality.replace_run(t.b_results.where("run_id = 1").withColumn("violations", F.lit(0).cast("long")), path)
    return t.spark.read.parquet(path)


# factors

ALL_AT = "2024-02-15 00:00:00"
_BARS = "SELECT * FROM b_bar " + TOP.format(k="entity_id, trade_date", o="version DESC, knowledge_time DESC")
_HFQ = f"(SELECT b.entity_id, b.trade_date, b.high * f.adj_factor AS high, b.low * f.adj_factor AS low, b.close * f.adj_factor AS close FROM ({_BARS}) b LEFT JOIN b_factor f USING (entity_id, trade_date))"
_MA = f"SELECT entity_id, trade_date, avg(close) OVER w AS ma20 FROM {_HFQ} WINDOW w AS (PARTITION BY entity_id ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) QUALIFY count(close) OVER w = 20"
_TR = f"""SELECT entity_id, trade_date, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus_dm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus_dm FROM (
    SELECT *, coalesce(lag(close) OVER w, close) AS pc, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM {_HFQ} WINDOW w AS (PARTITION BY entity_id ORDER BY trade_date))"""
_FBAR = ("b_bar", "b_factor")


def source(t):
    read = adjust.read(t.b_bar, t.b_factor, BAR, FACTOR, ALL_AT, ["high", "low", "close"], "hfq")
    return lambda names: read.select("entity_id", "trade_date", *names)


def factor(t, output, **more):
    return factors.REGISTRY.evaluate(output, source(t), ALL_AT, **more)


query("factor_ma20", f"SELECT entity_id, trade_date, round(ma20, 10) AS ma20 FROM ({_MA})", _FBAR, 10)(lambda t: factor(t, "ma20"))
query("factor_tr_dm", f"SELECT entity_id, trade_date, round(tr, 6) AS tr, round(plus_dm, 6) AS plus_dm, round(minus_dm, 6) AS minus_dm FROM ({_TR})", _FBAR)(
    lambda t: factors.directional(adjust.read(t.b_bar, t.b_factor, BAR, FACTOR, ALL_AT, ["high", "low", "close"], "hfq"))
)


def _steps(columns: str, rows: str, period: int, name: str) -> str:
    """Recursive common table expressions of Wilder's smoothing of ``columns`` of ``rows`` (entity_id, trade_date, n)."""
    names = columns.split(", ")
    seed = ", ".join(f"avg({c}) AS {c}" for c in names)
    move = ", ".join(f"s.{c} + (r.{c} - s.{c}) / {period}" for c in names)
    return f"{name}(entity_id, n, {columns}) AS (SELECT entity_id, CAST({period} AS BIGINT), {seed} FROM {rows} WHERE n <= {period} GROUP BY entity_id HAVING count(*) = {period} UNION ALL SELECT r.entity_id, r.n, {move} FROM {name} s JOIN {rows} r ON r.entity_id = s.entity_id AND r.n = s.n + 1)"


_NUM = f"numbered AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY trade_date) AS n FROM ({_TR}))"
query("factor_wilder", f"WITH RECURSIVE {_NUM}, {_steps('tr', 'numbered', 7, 'w')} SELECT w.entity_id, r.trade_date, round(w.tr, 6) AS wilder FROM w JOIN numbered r USING (entity_id, n)", _FBAR)(
    lambda t: factors.wilder(factors.directional(adjust.read(t.b_bar, t.b_factor, BAR, FACTOR, ALL_AT, ["high", "low", "close"], "hfq")), "tr", 7)
)
query(
    "factor_adx",
    f"""WITH RECURSIVE {_NUM}, {_steps('tr, plus_dm, minus_dm', 'numbered', 14, 'w')},
    d AS (SELECT entity_id, n - 13 AS n, CASE WHEN tr <= 0 OR plus_dm + minus_dm <= 0 THEN 0 ELSE 100 * abs(plus_dm - minus_dm) / (plus_dm + minus_dm) END AS dx FROM w), {_steps('dx', 'd', 14, 'a')}
    SELECT a.entity_id, r.trade_date, round(a.dx, 6) AS adx FROM a JOIN numbered r ON r.entity_id = a.entity_id AND r.n = a.n + 13""",
    _FBAR,
)(lambda t: factor(t, "adx"))
_GAP = f"SELECT m.entity_id, m.trade_date, round(h.close / nullif(m.ma20, 0) - 1, 6) AS ma20_gap FROM ({_MA}) m JOIN {_HFQ} h USING (entity_id, trade_date)"
query("factor_chain", _GAP, _FBAR)(lambda t: factor(t, "ma20_gap"))


PRINT = "substring(sha256('ma20@v1'), 1, 16)"


def _kept(t):
    """The current generation of a projection; it is written at the session's first call."""
    return factors.current_projection(t.spark, t.once("derived_ma20", lambda: _materialised(t)))


def _materialised(t):
    """Two generations, of which the second, whose inputs are known later, is the current one."""
    f, path = factors.REGISTRY.factors["ma20"], sinks.shared_folder(t.spark, "derived_ma20")
    early = factors.REGISTRY.evaluate("ma20", lambda names: adjust.read(t.b_bar, t.b_factor, BAR, FACTOR, "2024-01-25 00:00:00", list(names), "hfq"), "2024-01-25 00:00:00")
    factors.materialise(early, f, "2024-01-25 00:00:00", "2024-01-25 01:00:00", factors.REGISTRY.fingerprint("ma20"), path)
    factors.materialise(factor(t, "ma20"), f, ALL_AT, "2024-02-15 01:00:00", factors.REGISTRY.fingerprint("ma20"), path, keep=0)
    return path


query(
    "factor_materialize",
    f"SELECT entity_id, trade_date, round(ma20, 10) AS ma20, 'ma20' AS algorithm_id, 1 AS algorithm_version, TIMESTAMP '{ALL_AT}' AS as_of, TIMESTAMP '2024-02-15 01:00:00' AS computed_at, 2 AS data_generation, {PRINT} AS upstream_fingerprint FROM ({_MA})",
    _FBAR, 10,
)(_kept)


def _refreshed(t):
    """A generation as of the 25th, and one that takes in what became known since."""
    f, path, early = factors.REGISTRY.factors["ma20"], sinks.shared_folder(t.spark, "refreshed_ma20"), "2024-01-25 00:00:00"
    read = lambda at: lambda names: adjust.read(t.b_bar, t.b_factor, BAR, FACTOR, at, list(names), "hfq")
    factors.materialise(factors.REGISTRY.evaluate("ma20", read(early), early), f, early, early, factors.REGISTRY.fingerprint("ma20"), path)
    known = ["entity_id", "knowledge_time"]
    factors.refresh(factors.REGISTRY, "ma20", read(ALL_AT), t.b_bar.select(*known).unionByName(t.b_factor.select(*known)), ALL_AT, "2024-02-15 01:00:00", path, keep=0)
    return path


query(
    "factor_refresh",
    f"SELECT entity_id, trade_date, round(ma20, 10) AS ma20, TIMESTAMP '{ALL_AT}' AS as_of, 2 AS data_generation FROM ({_MA})",
    _FBAR, 10,
)(lambda t: factors.current_projection(t.spark, t.once("refreshed_ma20", lambda: _refreshed(t))).select("entity_id", "trade_date", "ma20", "as_of", "data_generation"))


@query("factor_read", f"WITH m AS ({_MA}) SELECT entity_id, trade_date, round(ma20, 10) AS ma20 FROM m WHERE trade_date >= (SELECT max(trade_date) - 4 FROM m)", _FBAR, 10)
def _(t):
    """The projection's last five days."""
    kept = _kept(t)
    last = kept.agg(F.date_sub(F.max("trade_date"), 4).alias("a"), F.max("trade_date").alias("b")).first()
    window = (last.a, last.b) if last.b is not None else None
    return factors.read_projection(kept, factors.REGISTRY.factors["ma20"], "2024-02-16T00:00:00Z", window, fingerprint=factors.REGISTRY.fingerprint("ma20"))


query("factor_chain_read", _GAP, _FBAR)(lambda t: factor(t, "ma20_gap", projections={"ma20": _kept(t)}))
query("input_coverage", "SELECT 'bars' AS input, max(trade_date) AS latest FROM b_bar WHERE knowledge_time <= TIMESTAMP '2024-01-20 12:00:00' UNION ALL SELECT 'factors', max(trade_date) FROM b_factor WHERE knowledge_time <= TIMESTAMP '2024-01-20 12:00:00'", _FBAR)(
    lambda t: factors.input_coverage({"bars": t.b_bar, "factors": t.b_factor}, "2024-01-20 12:00:00")
)
query("factor_inline", f"SELECT entity_id, trade_date, round(ma20, 10) AS ma20 FROM ({_MA})", _FBAR, 10)(
    lambda t: factors.inline(
        "SELECT entity_id, trade_date, ma20 FROM (SELECT *, avg(close) OVER w AS ma20, count(close) OVER w AS n FROM {bars} WINDOW w AS (PARTITION BY entity_id ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n = 20",
        {"bars": source(t)(["close"])},
    )
)

_NODES = "SELECT DISTINCT event_type AS output, concat(event_type, '@v', user_id % 4) AS id FROM events"
_PRINTS = f"SELECT output, substring(sha256(string_agg(id, '|' ORDER BY id)), 1, 16) AS fingerprint FROM ({_NODES}) GROUP BY output"


def _nodes(t):
    return t.events.select(F.col("event_type").alias("output"), F.concat("event_type", F.lit("@v"), (F.col("user_id") % 4).cast("string")).alias("id"))


query("upstream_fingerprint", _PRINTS)(lambda t: factors.fingerprints(_nodes(t), "output", "id"))


@query(
    "upstream_drift",
    f"""WITH p AS ({_PRINTS}), a AS (SELECT DISTINCT event_type AS output, event_type AS algorithm_id, CASE WHEN event_type < 'd' THEN 1 ELSE 2 END AS version, CASE WHEN event_type > 'p' THEN 'old' ELSE p.fingerprint END AS fingerprint FROM events JOIN p ON p.output = event_type)
    SELECT a.output, a.version AS stored_version, a.fingerprint AS stored_fingerprint, p.fingerprint FROM a JOIN p USING (output) WHERE a.version <> 2 OR a.fingerprint <> p.fingerprint""",
)
def _(t):
    """Projections of version 1 or under an older fingerprint, against version 2 of every output."""
    prints = factors.fingerprints(_nodes(t), "output", "id")
    kind = F.col("output")
    current = prints.select("output", kind.alias("algorithm_id"), F.lit(2).alias("algorithm_version"), "fingerprint")
    audits = t.events.select(F.col("event_type").alias("output")).join(prints, "output").select("output", kind.alias("algorithm_id"), F.when(kind < "d", 1).otherwise(2).alias("algorithm_version"), F.when(kind > "p", "old").otherwise(F.col("fingerprint")).alias("upstream_fingerprint"))
    return factors.drifted(audits, current).select("output", F.col("stored.algorithm_version").alias("stored_version"), F.col("stored.fingerprint").alias("stored_fingerprint"), F.col("current.fingerprint").alias("fingerprint"))


@query(
    "ledger_events",
    """WITH o AS (SELECT DISTINCT concat('a', c_custkey % 200) AS algorithm_id, DATE '2024-01-01' + CAST(c_custkey % 3 AS INTEGER) AS effective_from FROM customer), n AS (SELECT concat('a', c_custkey % 300) AS algorithm_id, CAST(DATE '2024-01-01' + CAST(c_custkey % 4 AS INTEGER) AS DATE) AS effective_from, min(c_name) AS reason FROM customer GROUP BY 1, 2)
    SELECT n.* FROM n WHERE (algorithm_id, effective_from) NOT IN (SELECT (algorithm_id, effective_from) FROM o)""",
)
def _(t):
    row = lambda m, k: t.customer.select(F.concat(F.lit("a"), (F.col("c_custkey") % m).cast("string")).alias("algorithm_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % k).cast("int")).alias("effective_from"), F.col("c_name").alias("reason"))
    return factors.ledger_events(row(200, 3), row(300, 4))


query("ledger_status", "SELECT concat('a', c_custkey) AS algorithm_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'active' ELSE 'deprecated' END AS status FROM customer")(
    lambda t: factors.ledger_status(t.customer.select(F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("algorithm_id")), t.orders.select(F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("algorithm_id")))
)


@query(
    "ledger_upsert",
    """WITH o AS (SELECT concat('a', c_custkey % 200) AS algorithm_id, min(c_name) AS output, CAST(max(c_custkey) AS BIGINT) AS version FROM customer GROUP BY 1), n AS (SELECT concat('a', c_custkey % 300) AS algorithm_id, CASE WHEN c_custkey % 300 % 3 = 0 THEN NULL ELSE concat('new', c_custkey % 300) END AS output, CAST(min(c_custkey) AS BIGINT) AS version FROM customer WHERE c_custkey % 300 > 100 GROUP BY 1, 2)
    SELECT coalesce(n.algorithm_id, o.algorithm_id) AS algorithm_id, coalesce(n.output, o.output) AS output, CASE WHEN n.algorithm_id IS NOT NULL THEN n.version ELSE o.version END AS version FROM o FULL JOIN n ON o.algorithm_id = n.algorithm_id""",
)
def _(t):
    key = F.col("c_custkey")
    name = lambda m: F.concat(F.lit("a"), (key % m).cast("string")).alias("algorithm_id")
    old = t.customer.groupBy(name(200)).agg(F.min("c_name").alias("output"), F.max("c_custkey").alias("version"))
    fresh = t.customer.where(key % 300 > 100).groupBy(name(300), F.when(key % 300 % 3 != 0, F.concat(F.lit("new"), (key % 300).cast("string"))).alias("output")).agg(F.min("c_custkey").alias("version"))
    return factors.ledger_upsert(old, fresh)


# sources

query("scan_contract", "SELECT entity_id, trade_date, open, high, low, close, volume, amount, knowledge_time, publish_time, version, provider FROM b_bar", "b_bar")(lambda t: vendor.contract_scan(t.b_bar, BAR))

_VEN = "upper(trim(regexp_extract(ts_code, '\\.([^.]*)$', 1)))"
_SYM = "upper(trim(regexp_extract(ts_code, '^(.*)\\.', 1)))"
_CODE = f"concat(CASE WHEN {_VEN} IN ('SH', 'SZ', 'BJ', 'OF') THEN lpad({_SYM}, greatest(6, length({_SYM}))::INT, '0') ELSE {_SYM} END, '.', {_VEN})"


@query(
    "normalize_raw",
    f"""SELECT event_id, {_CODE} AS code, CAST(strptime(trade_date, '%Y%m%d') AS DATE) AS trade_date, CAST(make_timestamp(at_ms * 1000) + INTERVAL '8' HOUR AS DATE) AS local_day, round(try_cast(vol AS DOUBLE) * 100, 6) AS volume, try_cast(vol AS BIGINT) AS lots,
    coalesce(try_cast(flag AS DOUBLE) <> 0, false) OR lower(trim(flag)) IN ('true', 't', 'yes', 'y') AS flag, CAST(NULL AS VARCHAR) AS extra, note FROM b_raw""",
    "b_raw",
)
def _(t):
    spec = [("event_id", "event_id", "int", None, True), ("code", "ts_code", "code", None, True), ("trade_date", "trade_date", "date", "yyyyMMdd", True), ("local_day", "at_ms", "date_ms", None, True), ("volume", "vol", "float", 100.0, True), ("lots", "vol", "int", None, True), ("flag", "flag", "bool", None, True), ("extra", "absent", "str", None, False), ("note", "note", "str", None, True)]
    return vendor.normalise(t.b_raw, spec)


_CUR = "CASE WHEN {v} IN ('SH', 'SZ', 'BJ', 'OF', 'TI', 'WI', 'CSI') THEN 'CNY' WHEN {v} = 'HK' THEN 'HKD' WHEN {v} IN ('O', 'N', 'A') THEN 'USD' END"
query("finalize_columns", f"SELECT code, CAST(day AS DATE) AS trade_date, currency FROM (SELECT upper(ts_code) AS code, CAST(strptime(trade_date, '%Y%m%d') AS DATE) AS day, CASE WHEN event_id % 4 = 0 THEN 'EUR' ELSE {_CUR.format(v=_VEN)} END AS currency FROM b_raw)", "b_raw")(
    lambda t: vendor.finalise(t.b_raw.select(F.upper("ts_code").alias("code"), F.to_timestamp("trade_date", "yyyyMMdd").alias("trade_date"), F.when(F.col("event_id") % 4 == 0, "EUR").alias("currency"), "note"), ["code", "trade_date", "currency"])
)

_MADE = "SELECT c_custkey, concat(CASE c_custkey % 4 WHEN 0 THEN '60' WHEN 1 THEN '00' WHEN 2 THEN '159' ELSE '' END, c_custkey % 1000, CASE c_custkey % 5 WHEN 0 THEN '.sh' WHEN 1 THEN '.SZ ' WHEN 2 THEN '.HK' WHEN 3 THEN '.N' ELSE '' END) AS ts_code FROM customer"
_VALID = f"CASE WHEN {_VEN} IN ('SH', 'SZ') THEN regexp_full_match({_SYM}, '[0-9]{{1,6}}') WHEN {_VEN} IN ('HK', 'N') THEN regexp_full_match({_SYM}, '[A-Z0-9]{{1,10}}') ELSE false END"


def _codes(t):
    key = F.col("c_custkey")
    head = F.when(key % 4 == 0, "60").when(key % 4 == 1, "00").when(key % 4 == 2, "159").otherwise("")
    tail = F.when(key % 5 == 0, ".sh").when(key % 5 == 1, ".SZ ").when(key % 5 == 2, ".HK").when(key % 5 == 3, ".N").otherwise("")
    return t.customer.select("c_custkey", F.concat(head, (key % 1000).cast("string"), tail).alias("ts_code"))


_TYPE = f"CASE WHEN NOT ({_VALID}) THEN NULL WHEN {_VEN} = 'N' THEN 'stock' WHEN {_VEN} = 'SH' AND s LIKE '6%' THEN 'stock' WHEN {_VEN} = 'SH' AND (s LIKE '000%' OR s LIKE '950%') THEN 'index' WHEN {_VEN} = 'SH' AND s LIKE '501%' THEN 'lof' WHEN {_VEN} = 'SH' AND s LIKE '5%' THEN 'etf' WHEN {_VEN} = 'SZ' AND (s LIKE '00%' OR s LIKE '30%') THEN 'stock' WHEN {_VEN} = 'SZ' AND s LIKE '15%' THEN 'etf' WHEN {_VEN} = 'SZ' AND s LIKE '16%' THEN 'lof' WHEN {_VEN} = 'SZ' AND s LIKE '39%' THEN 'index' END"
_PAD = f"CASE WHEN {_VEN} IN ('SH', 'SZ') THEN lpad({_SYM}, greatest(6, length({_SYM}))::INT, '0') ELSE {_SYM} END"
query("canonical_code", f"SELECT c_custkey, ts_code, CASE WHEN {_VALID} THEN concat(s, '.', {_VEN}) END AS code, {_TYPE} AS sec_type FROM (SELECT *, {_PAD} AS s FROM ({_MADE}))")(
    lambda t: _codes(t).select("c_custkey", "ts_code", codes.canonical(F.col("ts_code")).alias("code"), codes.security_type(F.col("ts_code")).alias("sec_type"))
)


@query(
    "vendor_code",
    f"""WITH c AS (SELECT c_custkey, concat(s, '.', {_VEN}) AS code, s, CASE {_VEN} WHEN 'SH' THEN 'sh' WHEN 'SZ' THEN 'sz' END AS p FROM (SELECT *, {_PAD} AS s FROM ({_MADE})) WHERE {_VALID})
    SELECT c_custkey, code, CASE WHEN p IS NOT NULL THEN s END AS bare, concat(p || s) AS prefixed, p || '.' || s AS dotted, CASE WHEN p IS NOT NULL THEN code END AS back FROM c""".replace("concat(p || s)", "p || s"),
)
def _(t):
    known = _codes(t).select("c_custkey", codes.canonical(F.col("ts_code")).alias("code")).where("code IS NOT NULL")
    made = known.select("*", *[codes.to_vendor(F.col("code"), s).alias(s) for s in ("bare", "prefixed", "dotted")])
    source_ = F.when(F.col("c_custkey") % 3 == 0, F.col("bare")).when(F.col("c_custkey") % 3 == 1, F.col("prefixed")).otherwise(F.col("dotted"))
    return made.select("*", codes.from_vendor(source_, codes.venue(F.col("code"))).alias("back"))


_RAWV = "CASE WHEN ts_code LIKE '%.%' THEN regexp_extract(ts_code, '\\.([^.]*)$', 1) END"
query("code_currency", f"SELECT c_custkey, ts_code, {_CUR.format(v=_RAWV)} AS currency FROM ({_MADE})")(lambda t: _codes(t).select("c_custkey", "ts_code", codes.currency(F.col("ts_code")).alias("currency")))
query(
    "classify_listing",
    f"SELECT c_custkey, ts_code, CASE WHEN {_VEN} = 'HK' THEN 'hk' WHEN {_VEN} IN ('O', 'N', 'A') THEN 'us' ELSE 'cn' END AS market, CASE WHEN c_custkey % 2 = 0 AND {_VEN} IN ('SH', 'SZ', 'BJ') THEN 'lof' WHEN c_custkey % 2 = 0 THEN 'fund' ELSE 'stock' END AS kind FROM ({_MADE})",
)(lambda t: _codes(t).select("c_custkey", "ts_code", codes.market(F.col("ts_code")).alias("market"), codes.listing_type(F.col("ts_code"), F.when(F.col("c_custkey") % 2 == 0, "fund").otherwise("stock")).alias("kind")))

query("merge_sources", "SELECT entity_id, trade_date, close, NULL::DOUBLE AS volume FROM b_bar_b UNION ALL SELECT entity_id, trade_date, close, volume FROM b_bar1 a WHERE NOT EXISTS (SELECT 1 FROM b_bar_b b WHERE a.entity_id = b.entity_id AND a.trade_date = b.trade_date)", _TWO)(
    lambda t: vendor.merge_sources([t.b_bar_b, t.b_bar1.select("entity_id", "trade_date", "close", "volume")], ["entity_id", "trade_date"])
)
query("field_fill", "SELECT a.entity_id, a.trade_date, a.close, c.volume, b.amount FROM b_bar1 a LEFT JOIN (SELECT entity_id, trade_date, amount FROM b_bar1 WHERE entity_id % 2 = 0) b USING (entity_id, trade_date) LEFT JOIN b_bar1 c USING (entity_id, trade_date)", "b_bar1")(
    lambda t: vendor.fill_fields(
        t.b_bar1.select("entity_id", "trade_date", "close", F.lit(None).cast("double").alias("amount")),
        [t.b_bar1.where("entity_id % 2 = 0").select("entity_id", "trade_date", "amount", F.lit(None).cast("double").alias("volume")), t.b_bar1.select("entity_id", "trade_date", "amount", "volume")], ["amount", "volume"], ["entity_id", "trade_date"],
    )
)
_WIDE = "SELECT CAST(ts AS DATE) AS day, CAST(max(CASE WHEN event_type = 'click' THEN value END) AS VARCHAR) AS click, CASE WHEN day(CAST(ts AS DATE)) % 3 = 0 THEN 'n/a' ELSE CAST(count(*) AS VARCHAR) END AS n, CAST(NULL AS VARCHAR) AS gone FROM events GROUP BY 1"
query("melt_indicators", f"WITH w AS MATERIALIZED ({_WIDE}) SELECT 'click' AS indicator, day AS obs_date, try_cast(click AS DOUBLE) AS value FROM w UNION ALL SELECT 'n', day, try_cast(n AS DOUBLE) FROM w")(
    lambda t: vendor.melt(
        t.events.groupBy(F.to_date("ts").alias("day")).agg(F.max(F.when(F.col("event_type") == "click", F.col("value"))).cast("string").alias("click"), F.count(F.lit(1)).alias("c")).select("day", "click", F.when(F.dayofmonth("day") % 3 == 0, "n/a").otherwise(F.col("c").cast("string")).alias("n"), F.lit(None).cast("string").alias("gone")),
        "day", ["click", "n", "gone"],
    )
)
query(
    "unit_scale",
    "SELECT p_partkey, concat('price', p_size % 3) AS base, p_retailprice * CASE p_partkey % 6 WHEN 0 THEN 1e8 WHEN 1 THEN 1e4 WHEN 2 THEN 1e3 WHEN 3 THEN 1 WHEN 4 THEN 100 ELSE 1 END AS value FROM part",
)(
    lambda t: vendor.scale_units(
        t.part.select("p_partkey", F.concat(F.lit("price"), (F.col("p_size") % 3).cast("string"), F.element_at(F.array(*map(F.lit, ["（单位：亿元）", "(单位: 万元)", "（单位：千元）", " （单位：元/股）", "（单位：手）", ""])), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("header"), F.col("p_retailprice").alias("value")), "header", "value"
    )
)
query(
    "factor_base_row",
    """SELECT entity_id, trade_date, adj_factor FROM b_event WHERE trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-15' UNION ALL SELECT entity_id, DATE '2024-01-05', coalesce(max_by(adj_factor, trade_date) FILTER (WHERE trade_date < DATE '2024-01-05'), 1.0) FROM b_event GROUP BY entity_id HAVING count(*) FILTER (WHERE trade_date = DATE '2024-01-05') = 0""",
    "b_event",
)(lambda t: vendor.factor_window(t.b_event, "2024-01-05", "2024-01-15"))
query("nav_daily_return", "SELECT entity_id, trade_date, close, round((close / nullif(lag(close) OVER (PARTITION BY entity_id ORDER BY trade_date), 0) - 1) * 100, 6) AS daily_return FROM b_bar1", "b_bar1")(
    lambda t: vendor.daily_return(t.b_bar1.select("entity_id", "trade_date", "close"), "close")
)
query("seed_missing_keys", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CASE WHEN n_regionkey % 2 = 0 THEN '1' ELSE '0' END AS is_open, concat('2020-01-', lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0')) AS valid_from FROM nation WHERE n_nationkey % 4 <> 0")(
    lambda t: vendor.seed_missing(
        t.nation.where("n_nationkey % 4 = 0").select(F.col("n_nationkey").cast("string").alias("n_nationkey")),
        t.nation.select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name", F.when(F.col("n_regionkey") % 2 == 0, "1").otherwise("0").alias("is_open"), F.concat(F.lit("2020-01-"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")).alias("valid_from")),
        ["n_nationkey"], ["n_nationkey", "n_name"], ["is_open"], ["valid_from"],
    )
)
query("explode_series", "SELECT CAST(entity_id AS VARCHAR) AS indicator, trade_date AS obs_date, CASE WHEN day(trade_date) % 4 = 0 THEN NULL ELSE close END AS value FROM b_bar1", "b_bar1")(
    lambda t: vendor.explode_series(
        t.b_bar1.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("trade_date", F.when(F.dayofmonth("trade_date") % 4 == 0, "--").otherwise(F.col("close").cast("string")).alias("v")))).alias("r")).select(F.col("entity_id").cast("string").alias("k"), F.col("r.trade_date").alias("days"), F.col("r.v").alias("values")),
        "k", "days", "values",
    )
)
query("snapshot_filter", "SELECT concat('C', c_custkey) AS code, DATE '2024-01-30' AS trade_date, c_acctbal AS close, c_mktsegment AS board FROM customer WHERE c_custkey % 7 = 0")(
    lambda t: vendor.snapshot_filter(t.customer.withColumn("sym", F.lpad(F.col("c_custkey").cast("string"), 8, "0")), t.customer.where("c_custkey % 7 = 0").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("symbol"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code")), "sym", {"c_acctbal": "close", "c_mktsegment": "board"}, "2024-01-30")
)
query(
    "security_info",
    f"""WITH m AS (SELECT c.*, ts_code FROM customer c JOIN ({_MADE}) USING (c_custkey) WHERE ts_code LIKE '%.%'), u AS (SELECT ts_code AS code, c_name AS name, '2024010' || (c_custkey % 9 + 1) AS d, 'L' AS list_status, 0 AS p FROM m WHERE c_custkey % 2 = 0 UNION ALL SELECT ts_code, c_name, NULL, 'D', 1 FROM m)
    SELECT code, name, {_VEN.replace('ts_code', 'code')} AS venue, {_TYPE.replace('ts_code', 'code')} AS sec_type, CAST(strptime(d, '%Y%m%d') AS DATE) AS list_date, list_status FROM (SELECT *, {_PAD.replace('ts_code', 'code')} AS s FROM u) {TOP.format(k='code', o='p, name')}""",
)(
    lambda t: vendor.security_info([
        ((m := t.customer.join(_codes(t), "c_custkey").where("ts_code LIKE '%.%'").select("c_custkey", F.col("ts_code").alias("code"), F.col("c_name").alias("name"))).where("c_custkey % 2 = 0").select("code", "name", F.concat(F.lit("2024010"), (F.col("c_custkey") % 9 + 1).cast("string")).alias("list_date"), F.lit("L").alias("list_status")), "list_status"),
        (m.select("code", "name", F.lit(None).cast("string").alias("list_date"), F.lit("D").alias("status")), "status"),
    ])
)

# sinks and streams


@query("export_parquet", "SELECT entity_id, trade_date, close, knowledge_time, version FROM b_bar", "b_bar")
def _(t):
    path = sinks.shared_folder(t.spark, "export")
    sinks.export_parquet(t.b_bar, BAR, path, ["entity_id", "trade_date", "close", "no_such"], "history")
    return t.spark.read.parquet(path)


query("export_arrow", "SELECT entity_id, trade_date, close FROM b_bar", "b_bar")(
    lambda t: sinks.read_arrow(sinks.export_arrow(t.b_bar.select("entity_id", "trade_date", "close"), 100_000), "entity_id long, trade_date date, close double")
)


@query("write_partitioned", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(version AS BIGINT) AS version, strftime(knowledge_time, '%Y-%m') AS month FROM b_line", "b_line")
def _(t):
    path = sinks.shared_folder(t.spark, "layout")
    sinks.write_partitioned(t.b_line, LINE, path)
    return t.spark.read.parquet(path).select("l_orderkey", "l_linenumber", "version", F.col("month").cast("string").alias("month"))


_STREAM = f"SELECT entity_id, trade_date, close, knowledge_time, version FROM b_bar1 UNION ALL SELECT i.entity_id, i.trade_date, i.close, {_STAMP.rsplit(', CASE', 1)[0]} FROM b_incoming i LEFT JOIN b_bar1 c USING (entity_id, trade_date) WHERE c.version IS NULL OR {_DIFF}"


def _streamed(t, run, deliveries):
    """Files of bars, then of a later delivery, streamed into a version table."""
    folder, keys = sinks.shared_folder(t.spark, "stream"), ["entity_id", "trade_date"]
    columns = [*keys, "open", "high", "low", "close", "volume", "amount"]
    same = dict.fromkeys(columns[2:], "bar")
    schema = "entity_id long, trade_date date, " + ", ".join(f"{c} double" for c in columns[2:])
    for rows in deliveries:
        rows.select(*columns).write.mode("append").parquet(f"{folder}/in")
        run(t.spark, f"{folder}/in", schema, f"{folder}/table", f"{folder}/checkpoint", keys, same, NOW)
    return t.spark.read.parquet(f"{folder}/table").select(*keys, "close", "knowledge_time", "version")


query("stream_restate", _STREAM, ("b_bar1", "b_incoming"))(lambda t: _streamed(t, stream_restate, (t.b_bar1, t.b_incoming)))
query("stream_restate_state", _STREAM, ("b_bar1", "b_incoming"))(lambda t: _streamed(t, stream_restate_state, (t.b_bar1, t.b_incoming)))


BUCKETS = 8


def _laid_out(t):
    """Names of bars and factors as bucketed tables, written at the session's first call, the last versions by an append."""

    def write():
        made = []
        for spec, rows in ((BAR, t.b_bar), (FACTOR, t.b_factor)):
            name = f"chronolith_{spec.name}_{uuid.uuid4().hex}"
            sinks.write_bucketed(rows.where("version = 1"), spec, name, BUCKETS)
            sinks.append_bucketed(rows, spec, name, BUCKETS)
            made.append(name)
        return made

    return sinks.read_bucketed(t.spark, *t.once("bucketed", write))


query("bucketed_as_of", f"SELECT entity_id, trade_date, close, volume FROM (SELECT * FROM b_bar WHERE knowledge_time <= TIMESTAMP '{NOON}' {TOP.format(k='entity_id, trade_date', o='version DESC, knowledge_time DESC')})", "b_bar")(
    lambda t: pit.as_of(_laid_out(t)[0], BAR, NOON, ["close", "volume"])
)


@query(
    "bucketed_adjust",
    f"SELECT entity_id, trade_date, round(b.close * (f.adj_factor / nullif(last_value(f.adj_factor) OVER w, 0)), 6) AS close FROM ({_BARS}) b JOIN b_factor f USING (entity_id, trade_date) WINDOW w AS (PARTITION BY entity_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    _FBAR,
)
def _(t):
    """Forward-adjusted closes: versions, factors and their last days meet within buckets."""
    return adjust.read(*_laid_out(t), BAR, FACTOR, ALL_AT, ["close"], "qfq")


query("bucketed_ma20", f"SELECT entity_id, trade_date, round(ma20, 10) AS ma20 FROM ({_MA})", _FBAR, 10)(
    lambda t: factors.ma20({"close": adjust.read(*_laid_out(t), BAR, FACTOR, ALL_AT, ["close"], "hfq")}, ALL_AT)
)


# usage

_COSTS = [("click", 0.5), ("view.bars", 0.25), ("error", 2.0)]
_USE = "SELECT day, source, CAST(sum(calls) AS BIGINT) AS calls, sum(calls * CASE WHEN source = 'view' AND endpoint = 'bars' THEN 0.25 WHEN source = 'click' THEN 0.5 WHEN source = 'error' THEN 2.0 ELSE 0 END) AS cost FROM b_calls GROUP BY day, source"


def _usage(t):
    return usage.daily(t.b_calls, t.spark.createDataFrame(_COSTS, "name string, unit_cost double"))


query("usage_daily", f"SELECT day, source, calls, CAST(round(cost, 6) AS DOUBLE) AS cost FROM ({_USE})", "b_calls")(_usage)


@query("usage_alerts", f"""WITH u AS ({_USE}), l AS (SELECT source, avg(calls) AS limit_, avg(cost) AS budget FROM u GROUP BY source), m AS (SELECT day, u.source, 'calls' AS metric, CAST(calls AS DOUBLE) AS v, limit_ AS x FROM u JOIN l USING (source) UNION ALL SELECT day, u.source, 'cost', cost, budget FROM u JOIN l USING (source))
    SELECT day, source, metric, CASE WHEN v >= x THEN 'exceeded' ELSE 'warn' END AS level, CAST(round(v / x, 4) AS DOUBLE) AS ratio FROM m WHERE x > 0 AND v >= 0.8 * x""", "b_calls")  # fmt: skip
def _(t):
    used = _usage(t)
    limits = used.groupBy("source").agg(F.avg("calls").alias("calls"), F.avg("cost").alias("cost")).unpivot(["source"], ["calls", "cost"], "metric", "limit")
    return usage.alerts(used, limits)
