"""The driver's tables reshaped to point-in-time form, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from types import SimpleNamespace

SPARK = SimpleNamespace(ts="TIMESTAMP_NTZ", days=lambda a, b: f"datediff({b}, {a})", plus=lambda d, n: f"date_add({d}, CAST({n} AS INT))", text="STRING", fmt=lambda d: f"date_format({d}, 'yyyyMMdd')", ms=lambda t: f"unix_millis(CAST({t} AS TIMESTAMP))", key=lambda c: f"get_json_object({c}, '$.k')")
DUCK = SimpleNamespace(ts="TIMESTAMP", days=lambda a, b: f"datediff('day', {a}, {b})", plus=lambda d, n: f"CAST({d} + CAST({n} AS INTEGER) AS DATE)", text="VARCHAR", fmt=lambda d: f"strftime({d}, '%Y%m%d')", ms=lambda t: f"epoch_ms({t})", key=lambda c: f"json_extract_string({c}, '$.k')")

BINDINGS: dict[str, Callable] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def binding(*needs: str) -> Callable:
    def add(f: Callable) -> Callable:
        BINDINGS[f.__name__], NEEDS[f.__name__] = f, needs
        return f

    return add


def closure(names: Iterable[str]) -> list[str]:
    """The bindings and those that they need, these first."""
    out: list[str] = []
    for n in names:
        out += [m for m in [*closure(NEEDS[n]), n] if m not in out]
    return out


def known(d, day: str, hours: int) -> str:
    return f"CAST({day} AS {d.ts}) + INTERVAL '{hours}' HOUR"


@binding()
def b_bar(d, t):
    first = f"""SELECT user_id AS entity_id, CAST(ts AS DATE) AS trade_date, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low,
        max_by(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, round(sum(value), 4) AS amount FROM {t('events')} GROUP BY user_id, CAST(ts AS DATE)"""
    row = "entity_id, trade_date, open, high, low, {close}, volume, amount, {kt} AS knowledge_time, {kt} AS publish_time, CAST({v} AS BIGINT) AS version, 'feed' AS provider"
    one = row.format(close="close", kt=known(d, "trade_date", 7), v=1)
    two = row.format(close="round(close * 1.01, 6) AS close", kt=known(d, "trade_date", 247), v=2)
    return f"SELECT {one} FROM ({first}) x UNION ALL SELECT {two} FROM ({first}) x WHERE (entity_id + day(trade_date)) % 7 = 0"


@binding("b_bar")
def b_bar1(d, t):
    return "SELECT * FROM b_bar WHERE version = 1"


@binding("b_bar1")
def b_factor(d, t):
    return "SELECT entity_id, trade_date, CAST(1 + 0.1 * floor((day(trade_date) - 1) / 10) + 0.01 * (entity_id % 3) AS DOUBLE) AS adj_factor, knowledge_time, version FROM b_bar1"


@binding("b_factor")
def b_event(d, t):
    """Sparse factor events."""
    return "SELECT entity_id, trade_date, adj_factor FROM b_factor WHERE day(trade_date) IN (1, 11, 21)"


@binding()
def b_calendar(d, t):
    day = f"SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM {t('events')}"
    return f"SELECT 'X1' AS exchange_id, trade_date, {d.days('DATE ' + repr('2024-01-01'), 'trade_date')} % 7 < 5 AS is_open, CAST('2023-12-31' AS {d.ts}) AS knowledge_time, CAST(1 AS BIGINT) AS version FROM ({day}) x"


@binding("b_bar1", "b_calendar")
def b_status(d, t):
    return f"""SELECT e.entity_id, c.trade_date, (b.entity_id IS NULL AND (e.entity_id + day(c.trade_date)) % 3 = 0) AS is_suspended, e.entity_id % 10 = 0 AS is_st,
        {known(d, 'c.trade_date', 7)} AS knowledge_time, CAST(1 AS BIGINT) AS version
        FROM (SELECT DISTINCT entity_id FROM b_bar1 WHERE entity_id % 11 <> 0) e CROSS JOIN b_calendar c
        LEFT JOIN b_bar1 b ON b.entity_id = e.entity_id AND b.trade_date = c.trade_date"""


@binding()
def b_line(d, t):
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate AS event_time, l_shipdate AS knowledge_time,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS version FROM {t('lineitem')}"""


@binding()
def b_orders(d, t):
    return f"""SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, o_orderdate AS knowledge_time,
        CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate - INTERVAL '1' DAY ELSE o_orderdate + INTERVAL '1' DAY END AS publish_time,
        row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS version FROM {t('orders')}"""


@binding()
def b_lifecycle(d, t):
    last = f"SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max_by(o_orderstatus, o_orderkey) AS s FROM {t('orders')} GROUP BY o_custkey, CAST(o_orderdate AS DATE)"
    following = "lead(day) OVER (PARTITION BY o_custkey ORDER BY day)"
    return f"""SELECT o_custkey AS entity_id, CASE s WHEN 'O' THEN 'listed' WHEN 'P' THEN 'suspended' ELSE 'delisted' END AS status, day AS start_date, {d.plus(following, -1)} AS end_date,
        {known(d, 'day', 7)} AS knowledge_time, CAST(1 AS BIGINT) AS version FROM ({last}) x"""


@binding()
def b_entity(d, t):
    base = f"c_custkey AS entity_id, concat('C', CAST(c_custkey AS {d.text})) AS code, {{name}} AS name, c_mktsegment AS entity_type, CASE WHEN c_nationkey % 2 = 0 THEN 'cn' ELSE 'us' END AS market"
    row = lambda name, a, b, kt, v, where: f"SELECT {base.format(name=name)}, {a} AS valid_from, {b} AS valid_to, CAST('{kt}' AS {d.ts}) AS knowledge_time, CAST({v} AS BIGINT) AS version FROM {t('customer')} WHERE {where}"
    old, new, end = "DATE '1992-01-01'", "DATE '1998-01-01'", "CAST(NULL AS DATE)"
    return " UNION ALL ".join([
        row("c_name", old, end, "1992-01-01", 1, "c_custkey % 2 = 1"), row("concat(c_name, ' old')", old, "DATE '1997-12-31'", "1992-01-01", 1, "c_custkey % 2 = 0"),
        row("c_name", new, end, "1998-01-01", 1, "c_custkey % 2 = 0"), row("c_name", "CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-01-01' ELSE DATE '1992-01-01' END", "DATE '1999-06-30'", "1999-07-01", 2, "c_custkey % 5 = 0"),
    ])


@binding("b_entity")
def b_code(d, t):
    return f"SELECT entity_id, concat(code, CASE WHEN valid_from < DATE '1998-01-01' AND valid_to IS NOT NULL THEN '_OLD' ELSE '' END) AS code, valid_from, valid_to, version FROM b_entity"


@binding()
def b_extid(d, t):
    x = f"concat('X', CAST(c_custkey % 500 AS {d.text}))"
    return f"SELECT c_custkey AS entity_id, 'isin' AS id_type, {x} AS id_value, CASE WHEN c_custkey % 3 = 0 THEN DATE '1996-01-01' ELSE DATE '1994-01-01' END AS valid_from, CASE WHEN c_custkey % 4 = 0 THEN DATE '1997-12-31' END AS valid_to, CAST(1 AS BIGINT) AS version FROM {t('customer')}"


@binding()
def b_relation(d, t):
    peer = f"SELECT s_nationkey, min(s_suppkey) AS k FROM {t('supplier')} GROUP BY s_nationkey"
    return f"SELECT c_custkey AS entity_id, k AS related_id, 'tracks' AS relation_type, DATE '1995-01-01' AS valid_from, CASE WHEN c_custkey % 6 = 0 THEN DATE '1999-01-01' END AS valid_to FROM {t('customer')} JOIN ({peer}) s ON s_nationkey = c_nationkey"


@binding("b_bar1")
def b_bar_b(d, t):
    return "SELECT entity_id, trade_date, CASE WHEN entity_id % 23 = 0 THEN NULL WHEN entity_id % 50 = 0 THEN close + 0.02 ELSE close END AS close FROM b_bar1 WHERE entity_id % 17 <> 0"


@binding()
def b_raw(d, t):
    return f"""SELECT event_id, concat(CAST(user_id AS {d.text}), CASE WHEN user_id % 3 = 0 THEN '.sh' WHEN user_id % 3 = 1 THEN '.SZ' ELSE '.HK' END) AS ts_code, {d.fmt('ts')} AS trade_date, {d.ms('ts')} AS at_ms,
        CASE WHEN event_id % 37 = 0 THEN 'n/a' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS {d.text}) END AS vol, CASE WHEN event_id % 5 = 0 THEN 'Yes' WHEN event_id % 5 = 1 THEN '1' ELSE '0' END AS flag, event_type AS note FROM {t('events')}"""


@binding()
def b_calls(d, t):
    return f"SELECT event_type AS source, CASE WHEN CAST({d.key('props')} AS INT) % 2 = 0 THEN 'bars' ELSE 'info' END AS endpoint, CAST(ts AS DATE) AS day, CAST(1 AS BIGINT) AS calls FROM {t('events')}"


@binding("b_bar1")
def b_incoming(d, t):
    """A later delivery of bars: a tenth changed, a twentieth shifted within tolerance, some new entities."""
    return """SELECT entity_id, trade_date, open, high, low, CASE WHEN entity_id % 10 = 3 THEN close + 1 WHEN entity_id % 20 = 7 THEN close + 0.0000000001 ELSE close END AS close, volume, amount FROM b_bar1
        UNION ALL SELECT entity_id + 100000, trade_date, open, high, low, close, volume, amount FROM b_bar1 WHERE entity_id % 9 = 0"""


@binding("b_bar1")
def b_market(d, t):
    """Intervals of the market for the entities that have bars; a seventh is delisted after some days."""
    start = "SELECT entity_id, min(trade_date) AS a FROM b_bar1 GROUP BY entity_id"
    row = "entity_id, '{s}' AS status, {a} AS start_date, {b} AS end_date, " + known(d, "a", 7) + " AS knowledge_time, CAST(1 AS BIGINT) AS version"
    gone = "CASE WHEN entity_id % 7 = 0 THEN {} END"
    listed = row.format(s="listed", a="a", b=gone.format(d.plus("a", 12)))
    return f"SELECT {listed} FROM ({start}) x UNION ALL SELECT {row.format(s='delisted', a=d.plus('a', 13), b='CAST(NULL AS DATE)')} FROM ({start}) x WHERE entity_id % 7 = 0"


@binding()
def b_results(d, t):
    """Quality results: three runs over two report days."""
    found = f"""SELECT CAST(event_id % 3 AS BIGINT) AS run_id, event_type AS dataset, CASE event_id % 4 WHEN 0 THEN 'completeness' WHEN 1 THEN 'freshness' WHEN 2 THEN 'unique' ELSE 'range' END AS check_id,
        CASE WHEN event_id % 5 = 0 THEN 'warn' ELSE 'error' END AS severity, CASE WHEN min(value) > 2 THEN 'passed' WHEN min(value) > 1 THEN 'skipped' WHEN max(value) > 200 THEN 'error' ELSE 'failed' END AS status,
        CAST(count(*) AS BIGINT) AS violations, CAST(round(avg(value), 4) AS DECIMAL(18, 4)) AS figure, CASE WHEN event_id % 3 = 0 THEN DATE '2024-01-29' ELSE DATE '2024-01-30' END AS window_end
        FROM {t('events')} GROUP BY 1, 2, 3, 4, 8"""
    name = "CASE check_id WHEN 'completeness' THEN 'ratio' WHEN 'freshness' THEN 'lag_days' ELSE 'other' END"
    return f"""SELECT run_id, dataset, check_id, severity, status, violations, concat('{{"', {name}, '":', CAST(figure AS {d.text}), '}}') AS metrics, window_end FROM ({found}) x"""
