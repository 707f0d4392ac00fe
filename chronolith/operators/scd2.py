"""Identity tables with validity intervals: both ends count, a null end is open, a null start is the epoch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.pit import first_by

EPOCH = "1990-01-01"


def covers(day: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.coalesce(F.col(start), F.lit(EPOCH).cast("date")) <= day) & (F.col(end).isNull() | (F.col(end) >= day))


def _day(day) -> Column:
    return day if isinstance(day, Column) else F.lit(day).cast("date")


def entity_latest(identity: DataFrame) -> DataFrame:
    """Open rows only, then the highest version, then the latest knowledge, of each entity."""
    return first_by(identity.where("valid_to IS NULL"), ["entity_id"], [F.desc("version"), F.desc("knowledge_time")])


def entity_asof(identity: DataFrame, at) -> DataFrame:
    """As known at a moment, the rows that cover its day; ranked like :func:`entity_latest`."""
    moment = F.lit(at).cast("timestamp_ntz")
    return first_by(identity.where((F.col("knowledge_time") <= moment) & covers(F.to_date(moment))), ["entity_id"], [F.desc("version"), F.desc("knowledge_time")])


def entity_current(identity: DataFrame) -> DataFrame:
    """Open rows first, else the latest closed one."""
    return first_by(identity, ["entity_id"], [F.desc(F.col("valid_to").isNull()), F.desc("valid_from"), F.desc("version")])


def entity_covering(identity: DataFrame, day) -> DataFrame:
    """Each entity's row on a day: of those that cover it, open first, then by start, version and knowledge."""
    order = [F.desc(F.col("valid_to").isNull()), F.desc("valid_from"), F.desc("version"), F.desc("knowledge_time")]
    return first_by(identity.where(covers(_day(day))), ["entity_id"], order)


def resolve_codes(codes: DataFrame, asked: DataFrame) -> DataFrame:
    """(code, day, entity_id) of each asked (code, day): the newest interval that covers the day; a null day takes the newest of all."""
    known = first_by(codes, ["entity_id", "code", "valid_from"], [F.desc("version")])
    met = asked.distinct().join(known, "code", "left").where(F.col("day").isNull() | F.col("entity_id").isNull() | covers(F.col("day")))
    best = first_by(met, ["code", "day"], [F.desc("valid_from"), F.desc("version"), F.asc("entity_id")])
    best = best.select(F.col("code").alias("__c"), F.col("day").alias("__d"), "entity_id")
    return asked.distinct().join(best, F.col("code").eqNullSafe(F.col("__c")) & F.col("day").eqNullSafe(F.col("__d")), "left").select("code", "day", "entity_id")


def resolve_external(ids: DataFrame, asked: DataFrame) -> DataFrame:
    """(id_type, id_value, day, entity_id): the covering row with the latest start and version; a null day takes open rows only."""
    met = asked.distinct().join(ids, ["id_type", "id_value"])
    met = met.where(F.when(F.col("day").isNull(), F.col("valid_to").isNull()).otherwise(covers(F.col("day"))))
    return first_by(met, ["id_type", "id_value", "day"], [F.desc("valid_from"), F.desc("version"), F.asc("entity_id")]).select("id_type", "id_value", "day", "entity_id")


def relations_both_ways(edges: DataFrame, inverse: dict[str, str], identity: DataFrame) -> DataFrame:
    """Open relations of every entity, outgoing as stored and incoming under the inverse word, with the peer's code and name."""
    word = F.create_map(*[F.lit(x) for pair in inverse.items() for x in pair])
    open_ = edges.where("valid_to IS NULL").select("entity_id", "related_id", "relation_type", "valid_from")
    back = open_.select(F.col("related_id").alias("entity_id"), F.col("entity_id").alias("related_id"), F.coalesce(word[F.col("relation_type")], F.col("relation_type")).alias("relation_type"), "valid_from")
    peer = entity_current(identity).select(F.col("entity_id").alias("related_id"), F.col("code").alias("peer_code"), F.col("name").alias("peer_name"))
    return open_.unionByName(back).join(peer, "related_id", "left")


#: Characters of a gram of the search index.
GRAM = 3


def search_index(identity: DataFrame) -> DataFrame:
    """(gram, entity_id): the runs of ``GRAM`` characters of all codes and names, in lower case; to be written and given to
    :func:`search`.  Sorted by gram over all files, so that a search reads few of them."""
    text = F.explode(F.array(F.lower("code"), F.lower("name")))
    grams = F.transform(F.sequence(F.lit(1), F.length("text") - GRAM + 1), lambda at: F.substring("text", at, F.lit(GRAM)))
    each = identity.select("entity_id", text.alias("text")).where(F.length("text") >= GRAM).select("entity_id", F.explode(F.array_distinct(grams)).alias("gram"))
    return each.select("gram", "entity_id").distinct().repartitionByRange("gram").sortWithinPartitions("gram", "entity_id")


def search(identity: DataFrame, text: str | None = None, entity_type: str | None = None, market: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Rows that match (before ranking), then each entity's current one, with the total count; order by type, code, id.

    With ``index`` (of :func:`search_index`, of these rows or more) only entities that have all grams of a word of ``GRAM`` characters or
    more are looked at; what is found is the same.
    """
    found = identity
    if text and index is not None and len(text) >= GRAM:
        grams = sorted({text.lower()[n : n + GRAM] for n in range(len(text) - GRAM + 1)})
        have = index.where(F.col("gram").isin(grams)).groupBy("entity_id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
        found = found.join(have, "entity_id", "left_semi")
    if text:
        found = found.where(F.lower("code").contains(text.lower()) | F.lower("name").contains(text.lower()))
    if entity_type:
        found = found.where(F.col("entity_type") == entity_type)
    if market:
        found = found.where(F.col("market") == market)
    return entity_current(found)


def universe(lifecycle: DataFrame, identity: DataFrame, day, known=None, entity_type: str | None = None, market: str | None = None) -> DataFrame:
    """Entities in the market on a day: the winner of the intervals that cover it, if it is listed or suspended, with an identity then.

    The status is judged after the winner is picked, so a delisting hides an older listing.
    """
    rows = lifecycle if known is None else lifecycle.where(F.col("knowledge_time") <= F.lit(known).cast("timestamp_ntz"))
    winner = first_by(rows.where(covers(_day(day), "start_date", "end_date")), ["entity_id"], [F.desc("start_date"), F.desc("version"), F.desc("knowledge_time")])
    named = entity_covering(identity, day)
    named = named if entity_type is None else named.where(F.col("entity_type") == entity_type)
    named = named if market is None else named.where(F.col("market") == market)
    return winner.where(F.col("status").isin("listed", "suspended")).join(named.select("entity_id", "code", "name"), "entity_id").select("entity_id", "code", "name", "status")


def lifecycle_intervals(rows: DataFrame) -> DataFrame:
    """Listing rows (entity_id, list_date, delist_date, list_status) as intervals: listed, then delisted without end.

    Rows without a listing date, delisted at or before it, or marked D without a date are left out.
    """
    good = rows.where(F.col("list_date").isNotNull() & (F.col("delist_date").isNull() | (F.col("delist_date") > F.col("list_date"))) & ~(F.coalesce(F.col("list_status"), F.lit("")).eqNullSafe("D") & F.col("delist_date").isNull()))
    part = lambda status, a, b: F.struct(F.lit(status).alias("status"), a.alias("start_date"), b.alias("end_date"))
    none = F.lit(None).cast("date")
    listed = part("listed", F.col("list_date"), F.date_sub("delist_date", 1))
    both = F.array(listed, part("delisted", F.col("delist_date"), none))
    return good.select("entity_id", F.explode(F.when(F.col("delist_date").isNotNull(), both).otherwise(F.array(listed))).alias("i")).select("entity_id", "i.*")


def lifecycle_merge(prior: DataFrame, target: DataFrame, now) -> DataFrame:
    """(entity_id, status, start_date, end_date, knowledge_time, version, action) for every interval of either side.

    Against the latest row of each (entity, start): new, revised (status or end differs), same, or retracted: open before and
    gone from the target of an entity that the target knows, closed at zero length.  Only same is not to be appended.
    """
    last = first_by(prior, ["entity_id", "start_date"], [F.desc("knowledge_time"), F.desc("version")])
    last = last.select("entity_id", "start_date", F.col("status").alias("__s"), F.col("end_date").alias("__e"), F.col("version").alias("__v"))
    # one shuffle: the target's entities mark which prior rows it speaks for
    joined = last.join(target.withColumn("__t", F.lit(True)), ["entity_id", "start_date"], "full")
    spoken = F.max(F.coalesce("__t", F.lit(False))).over(Window.partitionBy("entity_id"))
    joined = joined.withColumn("__spoken", spoken)
    clock = F.lit(now).cast("timestamp_ntz")
    gone = F.col("__t").isNull()
    action = (
        F.when(gone & F.col("__e").isNull() & F.col("__spoken"), "retracted").when(gone, None).when(F.col("__v").isNull(), "new")
        .when(F.col("status").eqNullSafe(F.col("__s")) & F.col("end_date").eqNullSafe(F.col("__e")), "same").otherwise("revised")
    )
    first = F.col("start_date").cast("timestamp_ntz") + F.expr("INTERVAL '7' HOUR")
    return joined.withColumn("action", action).where("action IS NOT NULL").select(
        "entity_id", F.coalesce("status", "__s").alias("status"), "start_date", F.when(F.col("action") == "retracted", F.col("start_date")).otherwise(F.col("end_date")).alias("end_date"),
        F.when(F.col("action") == "new", first).otherwise(clock).alias("knowledge_time"), F.when(F.col("action") == "same", F.col("__v")).otherwise(F.coalesce("__v", F.lit(0)) + 1).cast("long").alias("version"), "action",
    )


def entity_merge(identity: DataFrame, incoming: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Incoming (code, name, market, entity_type, entity_class) against current rows by code: new, updated or same.

    The type first seen stays; a class that isn't known becomes null; an update keeps valid_from and raises the version.
    """
    now = entity_current(identity).select("code", "entity_id", F.col("name").alias("__n"), F.col("market").alias("__m"), F.col("entity_type").alias("__t"), "valid_from", F.col("version").alias("__v"))
    joined = incoming.join(now, "code", "left")
    changed = ~F.col("name").eqNullSafe(F.col("__n")) | ~F.col("market").eqNullSafe(F.col("__m"))
    action = F.when(F.col("entity_id").isNull(), "new").when(changed, "updated").otherwise("same")
    return joined.select(
        "code", "entity_id", "name", "market", F.coalesce("__t", "entity_type").alias("entity_type"), F.when(F.col("entity_class").isin(*classes), F.col("entity_class")).alias("entity_class"),
        F.coalesce("valid_from", F.lit(EPOCH).cast("date")).alias("valid_from"), (F.coalesce("__v", F.lit(0)) + F.when(action == "same", 0).otherwise(1)).cast("long").alias("version"), action.alias("action"),
    )


def allocate_ids(identity: DataFrame, codes: DataFrame, floor: int = 10_000, buckets: int = 200) -> DataFrame:
    """(code, entity_id) of the codes that ``identity`` lacks, numbered in order of code from the largest id (at least ``floor``).

    Numbering is cut at a bounded sample of the codes, so that no task holds them all: rows are numbered within a range of
    codes, and ranges start after the counts of those before.
    """
    fresh = codes.select("code").where("code IS NOT NULL").distinct().join(identity.select("code").distinct(), "code", "left_anti")
    cuts = sorted(r.code for r in fresh.orderBy(F.xxhash64("code"), "code").limit(buckets).collect())
    place = F.size(F.filter(F.lit(cuts).cast("array<string>"), lambda c: c <= F.col("code"))) if cuts else F.lit(0)
    placed = fresh.withColumn("__b", place)
    counts = placed.groupBy("__b").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    top = identity.agg(F.greatest(F.coalesce(F.max("entity_id"), F.lit(floor)), F.lit(floor)).alias("__top"))
    numbered = placed.withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy("code"))).join(F.broadcast(counts), "__b").join(F.broadcast(top))
    return numbered.select("code", (F.col("__top") + F.col("__before") + F.col("__n")).cast("long").alias("entity_id"))


def timeline(rows: DataFrame, *columns: str, entities=None) -> DataFrame:
    """All rows of every entity (or of ``entities``), by start and version."""
    found = rows if entities is None else rows.where(F.col("entity_id").isin(list(entities)))
    return found.select(*columns).orderBy("entity_id", "valid_from", "version")


def aliases(codes: DataFrame, external: DataFrame) -> DataFrame:
    """(entity_id, kind, alias, valid_from, valid_to): codes and external identifiers together."""
    own = codes.select("entity_id", F.lit("code").alias("kind"), F.col("code").alias("alias"), "valid_from", "valid_to")
    return own.unionByName(external.select("entity_id", F.col("id_type").alias("kind"), F.col("id_value").alias("alias"), "valid_from", "valid_to"))


def name_changes(identity: DataFrame, events: DataFrame) -> DataFrame:
    """Rows to append for (entity_id, new_name, start, end), any number of events per entity, applied in order of start.

    The row that covers the day before an event (by start, then version) is closed there; the new name holds from start to
    end; after an end the name of the covering row resumes without end.  Where no row covers that day nothing is closed, and
    the current row's name resumes.  Later events meet the rows that earlier ones made.  Versions go on from the entity's
    highest.  An entity without rows is an error.  Further columns of ``events`` (the day of the announcement, attributes) stand
    on the row of the new name and are null on the others.

    An entity's events are folded over its rows, both arrays of one row; of its rows only those that can still matter are kept.
    """
    extra = [f for f in events.schema.fields if f.name not in ("entity_id", "new_name", "start", "end")]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in extra]
    row = lambda a, v, b, name: F.struct(a.alias("valid_from"), v.cast("long").alias("version"), b.alias("valid_to"), name.alias("name"))
    out = lambda kind, name, a, b, v, more=none: F.struct(F.lit(kind).alias("kind"), name.alias("name"), a.alias("valid_from"), b.alias("valid_to"), v.cast("long").alias("version"), *more)
    start = F.coalesce(F.col("valid_from"), F.lit(EPOCH).cast("date"))
    asked = events.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("start", F.col("end"), F.col("new_name").alias("name"), *[f.name for f in extra]))).alias("events"))
    mine = identity.join(events.select("entity_id").distinct(), "entity_id", "left_semi")
    held = mine.groupBy("entity_id").agg(F.collect_list(row(start, F.col("version"), F.col("valid_to"), F.col("name"))).alias("rows"), F.max("version").cast("long").alias("version"))
    known = F.when(F.col("rows").isNull(), F.raise_error(F.lit("a name change of an unknown entity")).cast("boolean")).otherwise(True)

    def fold(state: Column, event: Column) -> Column:
        rows, version, before = state["rows"], state["version"], F.date_sub(event["start"], 1)
        covers_it = lambda r: (r["valid_from"] <= before) & (r["valid_to"].isNull() | (r["valid_to"] >= before))
        found = F.array_max(F.filter(rows, covers_it))
        current = F.array_max(F.transform(rows, lambda r: F.struct(r["valid_to"].isNull(), r["valid_from"], r["version"], r["name"].alias("name"))))
        closes = found.isNotNull() & (found["valid_to"].isNull() | (found["valid_to"] > before))
        n = version + F.when(closes, 1).otherwise(0)
        closed = F.when(closes, F.array(out("close", found["name"], found["valid_from"], before, n)))
        named = F.array(out("name", event["name"], event["start"], event["end"], n + 1, [event[f.name].alias(f.name) for f in extra]))
        resumed = F.when(event["end"].isNotNull(), F.array(out("resume", F.when(found.isNotNull(), found["name"]).otherwise(current["name"]), F.date_add(event["end"], 1), F.lit(None).cast("date"), n + 2)))
        made = F.flatten(F.array_compact(F.array(closed, named, resumed)))
        # no later event starts earlier: rows that ended before it, and open ones behind a later open one, are done with
        latest = F.array_max(F.filter(rows, lambda r: r["valid_to"].isNull() & (r["valid_from"] <= before)))
        kept = F.filter(rows, lambda r: r.eqNullSafe(latest) | F.when(r["valid_to"].isNull(), r["valid_from"] > before).otherwise(r["valid_to"] >= before))
        after = F.concat(kept, F.transform(made, lambda m: row(m["valid_from"], m["version"], m["valid_to"], m["name"])))
        return F.struct(after.alias("rows"), (version + F.size(made)).alias("version"), F.concat(state["made"], made).alias("made"))

    kinds = ", ".join(["kind: string", "name: string", "valid_from: date", "valid_to: date", "version: bigint", *[f"`{f.name}`: {f.dataType.simpleString()}" for f in extra]])
    joined = asked.join(held, "entity_id", "left").where(known)
    begin = F.struct("rows", "version", F.array().cast(f"array<struct<{kinds}>>").alias("made"))
    return joined.select("entity_id", F.inline(F.aggregate("events", begin, fold)["made"]))


def code_changes(identity: DataFrame, codes: DataFrame, events: DataFrame) -> DataFrame:
    """Rows to append for (entity_id, new_code, start), by table, any number of events per entity, in order of start.

    An entity's first event closes its open codes and its current identity the day before and re-opens under the new code;
    each further one does so with what the event before it made.  Identity versions go on from the entity's highest, two for
    each event.
    """
    none, one = F.lit(None).cast("date"), F.lit(1)
    out = lambda df, table, code, a, b, v: df.select("entity_id", F.lit(table).alias("table"), code.alias("code"), a.alias("valid_from"), b.alias("valid_to"), v.cast("long").alias("version"))
    order = Window.partitionBy("entity_id").orderBy("start", "new_code")
    chain = events.select("entity_id", "new_code", "start", F.row_number().over(order).alias("k"), F.lag("new_code").over(order).alias("last_code"), F.lag("start").over(order).alias("last_start"))
    before = F.date_sub("start", 1)
    top = identity.groupBy("entity_id").agg(F.max("version").alias("top"))
    now = entity_current(identity).select("entity_id", "code", F.col("valid_from").alias("since")).join(top, "entity_id").join(chain, "entity_id")
    first, later = F.col("k") == 1, chain.where("k > 1")
    open_ = codes.where("valid_to IS NULL").join(chain.where(first), "entity_id")
    parts = [
        out(open_, "code", F.col("code"), F.col("valid_from"), before, F.col("version") + 1),
        out(later, "code", F.col("last_code"), F.col("last_start"), before, F.lit(2)),
        out(now, "code", F.col("new_code"), F.col("start"), none, one),
        out(now, "identity", F.when(first, F.col("code")).otherwise(F.col("last_code")), F.when(first, F.col("since")).otherwise(F.col("last_start")), before, F.col("top") + 2 * F.col("k") - 1),
        out(now, "identity", F.col("new_code"), F.col("start"), none, F.col("top") + 2 * F.col("k")),
    ]
    return reduce(DataFrame.union, parts)


def add_relations(edges: DataFrame, incoming: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Incoming relations without an open identical one; a word outside the vocabulary is an error."""
    checked = incoming.withColumn("relation_type", F.when(F.col("relation_type").isin(*words), F.col("relation_type")).otherwise(F.raise_error(F.lit("unknown relation"))))
    keys = ["entity_id", "related_id", "relation_type"]
    return checked.join(edges.where("valid_to IS NULL").select(*keys), keys, "left_anti").distinct()
