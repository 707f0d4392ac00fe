"""Queries over identity tables, lifecycle and ingest merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators import calendar, ingest, scd2
from chronolith.plans.registry import query
from chronolith.sources import sinks

DAY, AT, NOW = "1998-06-30", "1998-06-30 12:00:00", "2024-02-15 00:00:00"
TOP = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY {o}) = 1"
COLS = "entity_id, code, name, entity_type, market, valid_from, valid_to, version"
LIST = COLS.split(", ")
CURRENT = f"SELECT {COLS} FROM b_entity " + TOP.format(k="entity_id", o="(valid_to IS NULL) DESC, valid_from DESC, version DESC")
COVERS = "valid_from <= DATE '{d}' AND (valid_to IS NULL OR valid_to >= DATE '{d}')"
COVERING = f"SELECT {COLS} FROM b_entity WHERE {COVERS.format(d=DAY)} " + TOP.format(k="entity_id", o="(valid_to IS NULL) DESC, valid_from DESC, version DESC, knowledge_time DESC")

query("entity_latest", f"SELECT {COLS} FROM b_entity WHERE valid_to IS NULL {TOP.format(k='entity_id', o='version DESC, knowledge_time DESC')}", "b_entity")(lambda t: scd2.entity_latest(t.b_entity).select(*LIST))
query("entity_asof", f"SELECT {COLS} FROM b_entity WHERE knowledge_time <= TIMESTAMP '{AT}' AND {COVERS.format(d=DAY)} {TOP.format(k='entity_id', o='version DESC, knowledge_time DESC')}", "b_entity")(lambda t: scd2.entity_asof(t.b_entity, AT).select(*LIST))
query("entity_current", CURRENT, "b_entity")(lambda t: scd2.entity_current(t.b_entity).select(*LIST))
query("entity_covering", COVERING, "b_entity")(lambda t: scd2.entity_covering(t.b_entity, DAY).select(*LIST))

_ASKS = "SELECT DISTINCT code, CASE WHEN entity_id % 3 = 0 THEN NULL ELSE DATE '1997-06-30' + CAST(entity_id % 900 AS INTEGER) END AS day FROM b_code"


@query(
    "resolve_code",
    f"""WITH asks AS ({_ASKS}), k AS (SELECT * FROM b_code {TOP.format(k='entity_id, code, valid_from', o='version DESC')})
    SELECT a.code, a.day, (SELECT k.entity_id FROM k WHERE k.code = a.code AND (a.day IS NULL OR (k.valid_from <= a.day AND (k.valid_to IS NULL OR k.valid_to >= a.day))) ORDER BY valid_from DESC, version DESC, entity_id LIMIT 1) AS entity_id FROM asks a""",
    "b_code",
)
def _(t):
    codes = t.b_code
    day = F.when(F.col("entity_id") % 3 != 0, F.date_add(F.lit("1997-06-30").cast("date"), (F.col("entity_id") % 900).cast("int")))
    return scd2.resolve_codes(codes, codes.select("code", day.alias("day")))


@query(
    "resolve_external",
    f"""WITH asks AS (SELECT DISTINCT id_type, id_value, CASE WHEN entity_id % 2 = 0 THEN DATE '1997-01-01' END AS day FROM b_extid)
    SELECT a.id_type, a.id_value, a.day, x.entity_id FROM asks a JOIN b_extid x USING (id_type, id_value) WHERE CASE WHEN a.day IS NULL THEN x.valid_to IS NULL ELSE x.valid_from <= a.day AND (x.valid_to IS NULL OR x.valid_to >= a.day) END
    {TOP.format(k='a.id_type, a.id_value, a.day', o='x.valid_from DESC, x.version DESC, x.entity_id')}""",
    "b_extid",
)
def _(t):
    ids = t.b_extid
    return scd2.resolve_external(ids, ids.select("id_type", "id_value", F.when(F.col("entity_id") % 2 == 0, F.lit("1997-01-01").cast("date")).alias("day")))


@query(
    "relations_bidir",
    f"""WITH o AS (SELECT entity_id, related_id, relation_type, valid_from FROM b_relation WHERE valid_to IS NULL), c AS ({CURRENT})
    SELECT o.*, c.code AS peer_code, c.name AS peer_name FROM (SELECT * FROM o UNION ALL SELECT related_id, entity_id, 'tracked_by', valid_from FROM o) o LEFT JOIN c ON c.entity_id = o.related_id""",
    ("b_relation", "b_entity"),
)
def _(t):
    return scd2.relations_both_ways(t.b_relation, {"tracks": "tracked_by"}, t.b_entity).select("entity_id", "related_id", "relation_type", "valid_from", "peer_code", "peer_name")


@query("entity_search", f"SELECT {COLS}, count(*) OVER () AS total FROM (SELECT * FROM b_entity WHERE market = 'cn' AND (code ILIKE '%c1%' OR name ILIKE '%c1%') {TOP.format(k='entity_id', o='(valid_to IS NULL) DESC, valid_from DESC, version DESC')}) ORDER BY entity_type, code, entity_id LIMIT 30 OFFSET 5", "b_entity")
def _(t):
    found = scd2.search(t.b_entity, "c1", market="cn").select(*LIST)
    page = found.orderBy("entity_type", "code", "entity_id").offset(5).limit(30)
    return page.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


@query("entity_search_index", f"SELECT {COLS} FROM b_entity WHERE code ILIKE '%ER#00000001%' OR name ILIKE '%ER#00000001%' {TOP.format(k='entity_id', o='(valid_to IS NULL) DESC, valid_from DESC, version DESC')}", "b_entity")
def _(t):
    """The same search by an index of grams, which is written at the session's first call."""

    def write():
        path = sinks.shared_folder(t.spark, "grams")
        scd2.search_index(t.b_entity).write.parquet(path)
        return path

    return scd2.search(t.b_entity, "er#00000001", index=t.spark.read.parquet(t.once("grams", write))).select(*LIST)


query("entity_history", f"SELECT {COLS} FROM b_entity", "b_entity")(lambda t: scd2.timeline(t.b_entity, *LIST))
query("entity_aliases", "SELECT entity_id, 'code' AS kind, code AS alias, valid_from, valid_to FROM b_code UNION ALL SELECT entity_id, id_type, id_value, valid_from, valid_to FROM b_extid", ("b_code", "b_extid"))(
    lambda t: scd2.aliases(t.b_code, t.b_extid)
)


_WIN = "SELECT * FROM b_lifecycle WHERE {k} start_date <= DATE '1998-06-30' AND (end_date IS NULL OR end_date >= DATE '1998-06-30') " + TOP.format(k="entity_id", o="start_date DESC, version DESC, knowledge_time DESC")
_UNIVERSE = "SELECT w.entity_id, e.code, e.name, w.status FROM ({w}) w JOIN ({c}) e USING (entity_id) WHERE w.status IN ('listed', 'suspended')"
query("pit_universe", _UNIVERSE.format(w=_WIN.format(k=""), c=COVERING), ("b_lifecycle", "b_entity"))(lambda t: scd2.universe(t.b_lifecycle, t.b_entity, DAY))
query("pit_universe_known", _UNIVERSE.format(w=_WIN.format(k="knowledge_time <= TIMESTAMP '1997-12-31' AND"), c=COVERING) + " AND e.market = 'cn'", ("b_lifecycle", "b_entity"))(lambda t: scd2.universe(t.b_lifecycle, t.b_entity, DAY, "1997-12-31 00:00:00", market="cn"))

_LISTINGS = "SELECT o_custkey AS entity_id, CASE WHEN o_custkey % 13 <> 0 THEN min(CAST(o_orderdate AS DATE)) END AS list_date, CASE WHEN o_custkey % 3 = 0 THEN max(CAST(o_orderdate AS DATE)) END AS delist_date, CASE WHEN o_custkey % 7 = 0 THEN 'D' ELSE 'L' END AS list_status FROM orders GROUP BY o_custkey"


@query(
    "lifecycle_intervals",
    f"""WITH l AS (SELECT * FROM ({_LISTINGS}) WHERE list_date IS NOT NULL AND (delist_date IS NULL OR delist_date > list_date) AND NOT (list_status = 'D' AND delist_date IS NULL))
    SELECT entity_id, 'listed' AS status, list_date AS start_date, CAST(delist_date - 1 AS DATE) AS end_date FROM l UNION ALL SELECT entity_id, 'delisted', delist_date, NULL FROM l WHERE delist_date IS NOT NULL""",
)
def _(t):
    day, key = F.to_date("o_orderdate"), F.col("entity_id")
    rows = t.orders.groupBy(F.col("o_custkey").alias("entity_id")).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return scd2.lifecycle_intervals(rows.select("entity_id", F.when(key % 13 != 0, F.col("a")).alias("list_date"), F.when(key % 3 == 0, F.col("b")).alias("delist_date"), F.when(key % 7 == 0, "D").otherwise("L").alias("list_status")))


_TARGET = "SELECT entity_id, CASE WHEN entity_id % 10 = 2 THEN 'suspended' ELSE status END AS status, start_date, end_date FROM b_lifecycle WHERE NOT (entity_id % 10 = 1 AND end_date IS NULL) UNION ALL SELECT DISTINCT entity_id, 'listed', DATE '2003-01-01', CAST(NULL AS DATE) FROM b_lifecycle WHERE entity_id % 10 = 3"
_MERGE = f"""WITH t AS (SELECT *, true AS present FROM ({_TARGET})), j AS (
    SELECT coalesce(p.entity_id, t.entity_id) AS entity_id, coalesce(p.start_date, t.start_date) AS start_date, p.status AS s, p.end_date AS e, p.version AS v, t.status, t.end_date, t.present,
    coalesce(p.entity_id, t.entity_id) IN (SELECT entity_id FROM t) AS spoken FROM b_lifecycle p FULL JOIN t ON p.entity_id = t.entity_id AND p.start_date = t.start_date),
    a AS (SELECT *, CASE WHEN present IS NULL THEN CASE WHEN e IS NULL AND spoken THEN 'retracted' END WHEN v IS NULL THEN 'new' WHEN status IS NOT DISTINCT FROM s AND end_date IS NOT DISTINCT FROM e THEN 'same' ELSE 'revised' END AS action FROM j)
    SELECT entity_id, coalesce(status, s) AS status, start_date, CASE WHEN action = 'retracted' THEN start_date ELSE end_date END AS end_date,
    CASE WHEN action = 'new' THEN CAST(start_date AS TIMESTAMP) + INTERVAL '7' HOUR ELSE TIMESTAMP '{NOW}' END AS knowledge_time, CAST(CASE WHEN action = 'same' THEN v ELSE coalesce(v, 0) + 1 END AS BIGINT) AS version, action FROM a WHERE action IS NOT NULL"""


def _lifecycle(t):
    prior = t.b_lifecycle
    key = F.col("entity_id")
    kept = prior.where(~((key % 10 == 1) & F.col("end_date").isNull())).select("entity_id", F.when(key % 10 == 2, "suspended").otherwise(F.col("status")).alias("status"), "start_date", "end_date")
    more = prior.where(key % 10 == 3).select("entity_id").distinct().select("entity_id", F.lit("listed").alias("status"), F.lit("2003-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return scd2.lifecycle_merge(prior, kept.unionByName(more), NOW)


query("lifecycle_merge", _MERGE, "b_lifecycle")(_lifecycle)
query("lifecycle_merge_counts", f"SELECT action, count(*) AS n FROM ({_MERGE}) GROUP BY action", "b_lifecycle")(lambda t: _lifecycle(t).groupBy("action").agg(F.count(F.lit(1)).alias("n")))

_INCOMING = """SELECT CASE WHEN c_custkey % 50 = 0 THEN concat('N', c_custkey) ELSE concat('C', c_custkey) END AS code, CASE WHEN c_custkey % 4 = 0 THEN concat(c_name, ' new') ELSE c_name END AS name,
    CASE WHEN c_nationkey % 2 = 0 OR c_custkey % 9 = 0 THEN 'cn' ELSE 'us' END AS market, 'seen' AS entity_type, CASE c_custkey % 3 WHEN 0 THEN 'stock' WHEN 1 THEN 'fund' ELSE 'odd' END AS entity_class FROM customer"""


def _incoming(t):
    key = F.col("c_custkey")
    return t.customer.select(
        F.concat(F.when(key % 50 == 0, "N").otherwise("C"), key.cast("string")).alias("code"), F.when(key % 4 == 0, F.concat("c_name", F.lit(" new"))).otherwise(F.col("c_name")).alias("name"),
        F.when((F.col("c_nationkey") % 2 == 0) | (key % 9 == 0), "cn").otherwise("us").alias("market"), F.lit("seen").alias("entity_type"), F.when(key % 3 == 0, "stock").when(key % 3 == 1, "fund").otherwise("odd").alias("entity_class"),
    )


@query(
    "entity_merge",
    f"""WITH c AS ({CURRENT}), j AS (SELECT i.*, c.entity_id, c.name AS n, c.market AS m, c.entity_type AS et, c.valid_from AS vf, c.version AS v FROM ({_INCOMING}) i LEFT JOIN c USING (code)),
    a AS (SELECT *, CASE WHEN entity_id IS NULL THEN 'new' WHEN name IS DISTINCT FROM n OR market IS DISTINCT FROM m THEN 'updated' ELSE 'same' END AS action FROM j)
    SELECT code, entity_id, name, market, coalesce(et, entity_type) AS entity_type, CASE WHEN entity_class IN ('stock', 'fund') THEN entity_class END AS entity_class, coalesce(vf, DATE '1990-01-01') AS valid_from,
    CAST(coalesce(v, 0) + CASE WHEN action = 'same' THEN 0 ELSE 1 END AS BIGINT) AS version, action FROM a""",
    "b_entity",
)
def _(t):
    return scd2.entity_merge(t.b_entity, _incoming(t), ("stock", "fund"))


@query("entity_allocate", f"SELECT code, CAST(greatest((SELECT max(entity_id) FROM b_entity), 10000) + row_number() OVER (ORDER BY code) AS BIGINT) AS entity_id FROM (SELECT DISTINCT code FROM ({_INCOMING}) WHERE code NOT IN (SELECT code FROM b_entity))", "b_entity")
def _(t):
    return scd2.allocate_ids(t.b_entity, _incoming(t))


# one, two or three events of an entity; some overlap, some follow an end, some start before any row of the entity
_EVENTS = """SELECT entity_id, new_name, start, CASE (entity_id + n) % 3 WHEN 0 THEN CAST(start + 150 AS DATE) WHEN 1 THEN CAST(start + 60 AS DATE) END AS "end" FROM (
    SELECT c_custkey AS entity_id, n, concat('Renamed ', c_custkey, ' ', n) AS new_name, CAST(CASE WHEN c_custkey % 12 = 4 THEN DATE '1989-03-01' ELSE DATE '1996-03-01' END + CAST(c_custkey % 700 + 120 * n AS INTEGER) AS DATE) AS start
    FROM customer, (VALUES (0), (1), (2)) v(n) WHERE c_custkey % 6 BETWEEN 1 AND 4 AND n < c_custkey % 6)"""


def _renames(t):
    key = F.col("entity_id")
    rows = t.customer.where("c_custkey % 6 BETWEEN 1 AND 4").select(F.col("c_custkey").alias("entity_id"), F.explode(F.sequence(F.lit(0), F.least(F.lit(3), (F.col("c_custkey") % 6).cast("int")) - 1)).alias("n"))
    first = F.when(key % 12 == 4, F.lit("1989-03-01").cast("date")).otherwise(F.lit("1996-03-01").cast("date"))
    rows = rows.withColumn("start", F.date_add(first, (key % 700 + 120 * F.col("n")).cast("int")))
    end = F.when((key + F.col("n")) % 3 == 0, F.date_add("start", 150)).when((key + F.col("n")) % 3 == 1, F.date_add("start", 60))
    return rows.select("entity_id", F.concat(F.lit("Renamed "), key.cast("string"), F.lit(" "), F.col("n").cast("string")).alias("new_name"), "start", end.alias("end"))


@query(
    "name_change_rows",
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY start, new_name) AS k FROM ({_EVENTS})),
    s(entity_id, k, have, v, made) AS (
        SELECT entity_id, CAST(0 AS BIGINT), list(struct_pack(vf := valid_from, v := version, vt := valid_to, name := name)), max(version), CAST([] AS STRUCT(kind VARCHAR, name VARCHAR, vf DATE, vt DATE, v BIGINT)[])
        FROM b_entity WHERE entity_id IN (SELECT entity_id FROM e) GROUP BY entity_id
        UNION ALL
        SELECT entity_id, k, list_concat(have, list_transform(more, lambda x: struct_pack(vf := x.vf, v := x.v, vt := x.vt, name := x.name))), v + len(more), more FROM (
            SELECT entity_id, k, have, v, list_concat(
                CASE WHEN closes THEN [struct_pack(kind := 'close', name := p.name, vf := p.vf, vt := before, v := v + 1)] ELSE [] END,
                [struct_pack(kind := 'name', name := new_name, vf := start, vt := "end", v := v + 1 + CAST(closes AS BIGINT))],
                CASE WHEN "end" IS NOT NULL THEN [struct_pack(kind := 'resume', name := CASE WHEN p IS NULL THEN c.name ELSE p.name END, vf := CAST("end" + 1 AS DATE), vt := CAST(NULL AS DATE), v := v + 2 + CAST(closes AS BIGINT))] ELSE [] END) AS more
            FROM (SELECT *, coalesce(p IS NOT NULL AND (p.vt IS NULL OR p.vt > before), false) AS closes FROM (
                SELECT s.entity_id, e.k, s.have, s.v, e.new_name, e.start, e."end", CAST(e.start - 1 AS DATE) AS before,
                    list_sort(list_filter(s.have, lambda r: r.vf <= e.start - 1 AND (r.vt IS NULL OR r.vt >= e.start - 1)))[-1] AS p,
                    list_sort(list_transform(s.have, lambda r: struct_pack(o := r.vt IS NULL, vf := r.vf, v := r.v, name := r.name)))[-1] AS c
                FROM s JOIN e ON e.entity_id = s.entity_id AND e.k = s.k + 1))))
    SELECT entity_id, m.kind AS kind, m.name AS name, m.vf AS valid_from, m.vt AS valid_to, m.v AS version FROM (SELECT entity_id, unnest(made) AS m FROM s)""",
    "b_entity",
)
def _(t):
    return scd2.name_changes(t.b_entity, _renames(t))


@query(
    "code_change_rows",
    f"""WITH e AS (SELECT entity_id, concat('Z', new_name) AS new_code, start, row_number() OVER w AS k, lag(concat('Z', new_name)) OVER w AS last_code, lag(start) OVER w AS last_start FROM ({_EVENTS}) WINDOW w AS (PARTITION BY entity_id ORDER BY start, new_name)),
    c AS ({CURRENT}), m AS (SELECT entity_id, max(version) AS top FROM b_entity GROUP BY 1), n AS (SELECT e.*, c.code, c.valid_from, m.top FROM e JOIN c USING (entity_id) JOIN m USING (entity_id))
    SELECT entity_id, 'code' AS "table", b.code, b.valid_from, CAST(e.start - 1 AS DATE) AS valid_to, CAST(b.version + 1 AS BIGINT) AS version FROM e JOIN b_code b USING (entity_id) WHERE b.valid_to IS NULL AND e.k = 1
    UNION ALL SELECT entity_id, 'code', last_code, last_start, CAST(start - 1 AS DATE), 2 FROM e WHERE k > 1
    UNION ALL SELECT entity_id, 'code', new_code, start, NULL, 1 FROM n
    UNION ALL SELECT entity_id, 'identity', CASE WHEN k = 1 THEN code ELSE last_code END, CASE WHEN k = 1 THEN valid_from ELSE last_start END, CAST(start - 1 AS DATE), top + 2 * k - 1 FROM n
    UNION ALL SELECT entity_id, 'identity', new_code, start, NULL, top + 2 * k FROM n""",
    ("b_entity", "b_code"),
)
def _(t):
    events = _renames(t).select("entity_id", F.concat(F.lit("Z"), F.col("new_name")).alias("new_code"), "start")
    return scd2.code_changes(t.b_entity, t.b_code, events)


@query("relation_add", "SELECT DISTINCT i.* FROM (SELECT entity_id, related_id, 'tracks' AS relation_type FROM b_relation UNION ALL SELECT entity_id, related_id + 1, 'tracks' FROM b_relation WHERE entity_id % 5 = 0) i WHERE NOT EXISTS (SELECT 1 FROM b_relation b WHERE b.valid_to IS NULL AND b.entity_id = i.entity_id AND b.related_id = i.related_id AND b.relation_type = i.relation_type)", "b_relation")
def _(t):
    edges = t.b_relation
    more = edges.where("entity_id % 5 = 0").select("entity_id", (F.col("related_id") + 1).alias("related_id"), "relation_type")
    return scd2.add_relations(edges, edges.select("entity_id", "related_id", "relation_type").unionByName(more), ("tracks", "tracked_by"))


# ingest

_BARS6 = ("open", "high", "low", "close", "volume", "amount")
_DIFF = " OR ".join(f"CASE WHEN i.{f} IS NULL OR c.{f} IS NULL THEN NOT (i.{f} IS NULL AND c.{f} IS NULL) ELSE abs(i.{f} - c.{f}) > greatest(1e-9 * greatest(abs(i.{f}), abs(c.{f})), 1e-6) END" for f in _BARS6)
_CURBAR = "SELECT * FROM b_bar " + TOP.format(k="entity_id, trade_date", o="knowledge_time DESC, version DESC")
_STAMP = "CASE WHEN c.version IS NULL THEN CAST(i.trade_date AS TIMESTAMP) + INTERVAL '7' HOUR ELSE TIMESTAMP '" + NOW + "' END AS knowledge_time, CAST(coalesce(c.version, 0) + 1 AS BIGINT) AS version, CASE WHEN c.version IS NULL THEN 'new' ELSE 'revised' END AS action"
RESTATED = f"SELECT i.*, {_STAMP} FROM b_incoming i LEFT JOIN ({_CURBAR}) c USING (entity_id, trade_date) WHERE c.version IS NULL OR {_DIFF}"


def restate_bars(t):
    return ingest.restate(t.b_bar, t.b_incoming, ["entity_id", "trade_date"], dict.fromkeys(_BARS6, "bar"), NOW)


query("restate_bars", RESTATED, ("b_bar", "b_incoming"))(restate_bars)


@query(
    "restate_factors",
    f"""WITH i AS (SELECT entity_id, trade_date, CASE WHEN entity_id % 6 = 0 THEN NULL WHEN entity_id % 6 = 1 THEN adj_factor + 0.5 ELSE adj_factor END AS adj_factor FROM b_factor UNION ALL SELECT entity_id + 100000, trade_date, adj_factor FROM b_factor WHERE entity_id % 9 = 0)
    SELECT i.*, {_STAMP} FROM i LEFT JOIN b_factor c USING (entity_id, trade_date) WHERE i.adj_factor IS NOT NULL AND (c.version IS NULL OR c.adj_factor IS NULL OR abs(i.adj_factor - c.adj_factor) > 1e-9)""",
    "b_factor",
)
def _(t):
    key = F.col("entity_id")
    old = t.b_factor
    changed = old.select("entity_id", "trade_date", F.when(key % 6 == 0, None).when(key % 6 == 1, F.col("adj_factor") + 0.5).otherwise(F.col("adj_factor")).alias("adj_factor"))
    more = old.where(key % 9 == 0).select((key + 100000).alias("entity_id"), "trade_date", "adj_factor")
    return ingest.restate(old, changed.unionByName(more), ["entity_id", "trade_date"], {"adj_factor": "factor"}, NOW, strict_nulls=True)


@query(
    "restate_status",
    f"""WITH i AS (SELECT entity_id, trade_date, CASE WHEN entity_id % 8 = 0 THEN NOT is_suspended ELSE is_suspended END AS is_suspended, is_st FROM b_status)
    SELECT i.*, {_STAMP} FROM i LEFT JOIN b_status c USING (entity_id, trade_date) WHERE c.version IS NULL OR i.is_suspended IS DISTINCT FROM c.is_suspended OR i.is_st IS DISTINCT FROM c.is_st""",
    "b_status",
)
def _(t):
    old = t.b_status
    incoming = old.select("entity_id", "trade_date", F.when(F.col("entity_id") % 8 == 0, ~F.col("is_suspended")).otherwise(F.col("is_suspended")).alias("is_suspended"), "is_st")
    return ingest.restate(old, incoming, ["entity_id", "trade_date"], {"is_suspended": "equal", "is_st": "equal"}, NOW)


_NAMES = "SELECT entity_id, CASE WHEN entity_id % 4 = 0 THEN ' *st x' WHEN entity_id % 4 = 1 THEN 'SST y' ELSE 'Best' END AS name, min(trade_date) AS start_date, CASE WHEN entity_id % 3 = 0 THEN CAST(min(trade_date) + 9 AS DATE) END AS end_date FROM b_bar1 GROUP BY entity_id"
_HALTS = "SELECT entity_id, trade_date, CASE WHEN entity_id % 2 = 0 THEN 'R' ELSE 'S' END AS suspend_type FROM b_bar1 WHERE (entity_id + day(trade_date)) % 5 = 0"


@query(
    "derive_status",
    f"""WITH n AS (SELECT * FROM ({_NAMES}) WHERE upper(trim(name)) LIKE '*ST%' OR upper(trim(name)) LIKE 'ST%' OR upper(trim(name)) LIKE 'S*ST%' OR upper(trim(name)) LIKE 'SST%'), g AS (SELECT e.entity_id, c.trade_date FROM (SELECT DISTINCT entity_id FROM b_bar1) e CROSS JOIN (SELECT DISTINCT trade_date FROM b_calendar WHERE is_open) c)
    SELECT g.entity_id, g.trade_date, EXISTS (SELECT 1 FROM ({_HALTS}) h WHERE h.entity_id = g.entity_id AND h.trade_date = g.trade_date AND h.suspend_type <> 'R') AS is_suspended,
    EXISTS (SELECT 1 FROM n WHERE n.entity_id = g.entity_id AND n.start_date <= g.trade_date AND (n.end_date IS NULL OR n.end_date >= g.trade_date)) AS is_st FROM g""",
    ("b_bar1", "b_calendar"),
)
def _(t):
    bars, key = t.b_bar1, F.col("entity_id")
    first = bars.groupBy("entity_id").agg(F.min("trade_date").alias("start_date"))
    names = first.select("entity_id", F.when(key % 4 == 0, " *st x").when(key % 4 == 1, "SST y").otherwise("Best").alias("name"), "start_date", F.when(key % 3 == 0, F.date_add("start_date", 9)).alias("end_date"))
    halts = bars.where((key + F.dayofmonth("trade_date")) % 5 == 0).select("entity_id", "trade_date", F.when(key % 2 == 0, "R").otherwise("S").alias("suspend_type"))
    return ingest.derive_status(t.b_calendar.where("is_open"), bars, halts, names)


_RUNS = "SELECT event_type AS dataset, CAST(user_id % 5 AS VARCHAR) AS scope, CAST(max(ts) AS DATE) AS end_day, count(*) FILTER (WHERE value > 100) AS rows FROM events GROUP BY 1, 2"


@query("watermark_advance", f"SELECT dataset, scope, max(w) AS watermark_time FROM (SELECT dataset, scope, CASE WHEN end_day = DATE '2024-01-30' AND rows = 0 THEN DATE '2024-01-29' ELSE end_day END AS w FROM ({_RUNS}) UNION ALL SELECT dataset, '0', DATE '2024-02-02' FROM ({_RUNS}) WHERE dataset <> 'view') GROUP BY 1, 2")
def _(t):
    runs = t.events.groupBy(F.col("event_type").alias("dataset"), (F.col("user_id") % 5).cast("string").alias("scope")).agg(F.to_date(F.max("ts")).alias("end_day"), F.count_if(F.col("value") > 100).alias("rows"))
    marks = runs.where("dataset <> 'view'").select("dataset", F.lit("0").alias("scope"), F.lit("2024-02-02").cast("date").alias("watermark_time"))
    return ingest.advance_watermarks(marks, runs, "2024-01-30")


_DUE = "SELECT event_type AS dataset, CASE WHEN event_type < 'd' THEN CAST(min(ts) AS DATE) + CAST(count(*) % 40 AS INTEGER) END AS mark, CASE WHEN event_type > 'p' THEN DATE '2024-01-05' END AS configured_start FROM events GROUP BY event_type"


@query("due_windows", f"SELECT dataset, coalesce(CAST(mark + 1 AS DATE), configured_start) AS start_day, l AS end_day FROM ({_DUE}), (SELECT max(trade_date) AS l FROM b_calendar WHERE is_open AND trade_date <= DATE '2024-01-25') WHERE coalesce(mark + 1, configured_start) <= l", "b_calendar")
def _(t):
    kind = F.col("dataset")
    counted = t.events.groupBy(F.col("event_type").alias("dataset")).agg(F.to_date(F.min("ts")).alias("a"), F.count(F.lit(1)).alias("n"))
    marks = counted.select("dataset", F.when(kind < "d", F.date_add("a", (F.col("n") % 40).cast("int"))).alias("mark"), F.when(kind > "p", F.lit("2024-01-05").cast("date")).alias("configured_start"))
    return ingest.due_windows(marks, calendar.last_closed(t.b_calendar, "2024-01-25 09:00:00"))


@query(
    "empty_window_guard",
    """WITH f AS (SELECT 'bars' AS dataset, entity_id, CAST(min(trade_date) + CAST(entity_id % 7 AS INTEGER) AS DATE) AS start_day, CAST(min(trade_date) + CAST(entity_id % 9 AS INTEGER) AS DATE) AS end_day, count(*) % 3 AS rows FROM b_bar1 GROUP BY entity_id)
    SELECT dataset, entity_id, rows = 0 AND EXISTS (SELECT 1 FROM b_calendar WHERE is_open AND trade_date BETWEEN start_day AND end_day) AND EXISTS (SELECT 1 FROM b_bar1 b WHERE b.entity_id = f.entity_id AND b.trade_date <= f.end_day) AS suspicious FROM f""",
    ("b_bar1", "b_calendar"),
)
def _(t):
    key, bars = F.col("entity_id"), t.b_bar1
    first = bars.groupBy("entity_id").agg(F.min("trade_date").alias("a"), (F.count(F.lit(1)) % 3).alias("rows"))
    fetched = first.select(F.lit("bars").alias("dataset"), "entity_id", F.date_add("a", (key % 7).cast("int")).alias("start_day"), F.date_add("a", (key % 9).cast("int")).alias("end_day"), "rows")
    return ingest.empty_window_guard(fetched, t.b_calendar.where("is_open").select("trade_date").distinct(), bars)


@query("append_idempotent", f"SELECT entity_id, trade_date, close, knowledge_time, version FROM ({RESTATED}) UNION ALL SELECT entity_id, trade_date, close, knowledge_time, version FROM b_bar", ("b_bar", "b_incoming"))
def _(t):
    columns = ["entity_id", "trade_date", "close", "knowledge_time", "version"]
    table, batch = t.b_bar.select(*columns), restate_bars(t).select(*columns)
    fresh = ingest.new_rows(table, batch.unionByName(batch).unionByName(table), ["entity_id", "trade_date", "knowledge_time", "version"])
    return table.unionByName(fresh)
