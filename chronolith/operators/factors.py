"""Derived factors: registered, versioned functions over named inputs, evaluated on demand or kept as projections."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.operators.spans import numbered, over_chunks
from chronolith.sources.store import create_once, delete, names_in

KEYS = ["entity_id", "trade_date"]
#: Most rows of an entity that one step of a scan takes: powers of a decay over so many rows stay within double precision.
STEP = 256


@dataclass(frozen=True)
class Factor:
    """``function``: (inputs by name, as_of) -> entity_id, trade_date, output.  inputs: dataset fields, or outputs of other factors."""

    algorithm_id: str
    version: int
    output: str
    inputs: tuple[str, ...]
    function: Callable[[Mapping[str, DataFrame], object], DataFrame]

    @property
    def identity(self) -> str:
        return f"{self.algorithm_id}@v{self.version}"


@dataclass
class Registry:
    """Factors by output.  The docstring of a factor's function must state Formula and PIT."""

    factors: dict[str, Factor] = field(default_factory=dict)

    def register(self, algorithm_id: str, version: int, output: str, inputs: Sequence[str]) -> Callable:
        def add(function: Callable) -> Callable:
            text = function.__doc__ or ""
            if "Formula" not in text or "PIT" not in text:
                raise ValueError(f"{algorithm_id}: the docstring must state Formula and PIT")
            if output in self.factors:
                raise ValueError(f"{output} is registered already")
            self.factors[output] = Factor(algorithm_id, version, output, tuple(inputs), function)
            return function

        return add

    def evaluate(self, output: str, source: Callable[[Sequence[str]], DataFrame], as_of, projections: Mapping[str, DataFrame] | None = None, memo: dict | None = None, path: tuple = ()) -> DataFrame:
        """The factor's rows; inputs that are factors are evaluated once, or read from their projection if there is one.

        ``source`` reads all dataset fields of a factor at once: they share one frame, so nothing is joined that was never
        apart.  A projection of another algorithm, version or upstream than the registry's is an error (one row is read of
        each that is used).
        """
        memo = {} if memo is None else memo
        if output in path:
            raise ValueError(f"{output} depends on itself")
        if output not in memo:
            factor = self.factors[output]
            fields = [n for n in factor.inputs if n not in self.factors]
            given = dict.fromkeys(fields, source(fields)) if fields else {}
            for name in factor.inputs:
                if name in self.factors and name in (projections or {}):
                    check_current(projections[name], self.factors[name], self.fingerprint(name))
                    given[name] = projections[name].select(*KEYS, name)
                elif name in self.factors:
                    given[name] = self.evaluate(name, source, as_of, projections, memo, (*path, output))
            found = factor.function(given, as_of)
            if set(found.columns) != {*KEYS, output}:
                raise ValueError(f"{factor.identity} must return its keys and {output}")
            memo[output] = found.select(*KEYS, output)
        return memo[output]

    def fingerprint(self, output: str) -> str:
        """Of the identities of a factor and all that it rests on."""
        ids, todo = set(), [output]
        while todo:
            if (name := todo.pop()) in self.factors and self.factors[name].identity not in ids:
                ids.add(self.factors[name].identity)
                todo.extend(self.factors[name].inputs)
        return hashlib.sha256("|".join(sorted(ids)).encode()).hexdigest()[:16]


def together(inputs: Mapping[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """The named inputs in one frame: those that share a frame as they are, others joined by the keys."""
    frames: dict[int, list[str]] = {}
    for name in names:
        frames.setdefault(id(inputs[name]), []).append(name)
    return reduce(lambda a, b: a.join(b, KEYS), [inputs[some[0]].select(*KEYS, *some) for some in frames.values()])


def fingerprints(nodes: DataFrame, by: str, identity: str) -> DataFrame:
    """(by, fingerprint) from rows of each node's own and upstream identities, as :meth:`Registry.fingerprint` makes it."""
    listed = F.array_join(F.array_sort(F.collect_set(identity)), "|")
    return nodes.groupBy(by).agg(F.substring(F.sha2(listed, 256), 1, 16).alias("fingerprint"))


def drifted(audits: DataFrame, current: DataFrame) -> DataFrame:
    """(output, stored, current) of projections whose audit rows (output, algorithm_id, algorithm_version, upstream_fingerprint)
    are not what is ``current`` (output, algorithm_id, algorithm_version, fingerprint); a projection without rows is fine."""
    stored = audits.select("output", F.struct("algorithm_id", F.col("algorithm_version").cast("long").alias("algorithm_version"), F.col("upstream_fingerprint").alias("fingerprint")).alias("stored")).distinct()
    now = current.select("output", F.struct("algorithm_id", F.col("algorithm_version").cast("long").alias("algorithm_version"), "fingerprint").alias("current"))
    return stored.join(now, "output").where(~F.col("stored").eqNullSafe(F.col("current")))


def check_current(projection: DataFrame, factor: Factor, fingerprint: str) -> None:
    """Raise if a row of the projection is of another algorithm, version or upstream."""
    same = (F.col("algorithm_id") == factor.algorithm_id) & (F.col("algorithm_version") == factor.version) & (F.col("upstream_fingerprint") == fingerprint)
    stale = projection.where(~F.coalesce(same, F.lit(False))).select("algorithm_id", "algorithm_version", "upstream_fingerprint").head(1)
    if stale:
        raise ValueError(f"the projection of {factor.identity} is stale: {stale[0].asDict()}, now {fingerprint}")


def inline(sql: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """A factor as SQL over views of its inputs, which it names in braces."""
    return next(iter(inputs.values())).sparkSession.sql(sql, **inputs)


REGISTRY = Registry()


@REGISTRY.register("ma20", 1, "ma20", ["close"])
def ma20(inputs: Mapping[str, DataFrame], as_of, span: int | None = None) -> DataFrame:
    """Formula: the mean of the last 20 closes, where all 20 are known.  PIT: inputs are read as of ``as_of``."""

    def columns(keys: Sequence[str]) -> dict[str, Column]:
        frame = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(-19, 0)
        return {"ma20": F.avg("close").over(frame), "n": F.count("close").over(frame)}

    return over_chunks(inputs["close"], "entity_id", "trade_date", span, 19, columns).where("n = 20").select(*KEYS, "ma20")


def directional(bars: DataFrame, span: int | None = None) -> DataFrame:
    """(keys, tr, plus_dm, minus_dm) of bars (keys, high, low, close); bars with a null price are left out."""

    def columns(keys: Sequence[str]) -> dict[str, Column]:
        order = Window.partitionBy(*keys).orderBy("trade_date")
        return {"pc": F.coalesce(F.lag("close").over(order), "close"), "up": F.col("high") - F.lag("high").over(order), "down": F.lag("low").over(order) - F.col("low")}

    rows = over_chunks(bars.where("high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"), "entity_id", "trade_date", span, 1, columns)
    plus = F.when((F.col("up") > F.col("down")) & (F.col("up") > 0), F.col("up")).otherwise(0.0)
    minus = F.when((F.col("down") > F.col("up")) & (F.col("down") > 0), F.col("down")).otherwise(0.0)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc")))
    return rows.select(*KEYS, true_range.alias("tr"), plus.alias("plus_dm"), minus.alias("minus_dm"))


def stepped(rows: DataFrame, span: int | None) -> DataFrame:
    """``rows`` in steps of at most ``STEP`` rows of an entity: __i, the row's number in its entity, __span, the step, and __before,
    the entity's rows before it.

    Without ``span`` an entity is one partition and its steps are cut by number; with it, spans of so many days (``STEP`` at
    most) are steps, numbered and held apart, so that an entity needs not fit a task.
    """
    if span is not None:
        return numbered(rows, "entity_id", "trade_date", min(span, STEP))
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy("entity_id").orderBy("trade_date")).cast("long"))
    return rows.withColumn("__span", F.floor((F.col("__i") - 1) / STEP)).withColumn("__before", F.col("__span") * STEP)


def scan(rows: DataFrame, columns: Sequence[str], period: int) -> DataFrame:
    """:func:`stepped` rows with each of ``columns`` smoothed as Wilder does: the mean of the first ``period`` values, then moved by
    1 / ``period`` of each further one's distance; earlier rows are left out.

    A row maps the mean before it by s -> q s + x / period, and such maps compose: a step's rows are summed under powers of q by
    a window, steps are folded in turn, once for each entity, and what a step takes in is added to its rows.
    """
    if period == 1:
        return rows
    q, at = 1 - 1 / period, F.greatest(F.col("__i"), F.lit(period))
    # the first values count alike, so time stands still for them
    age = at - F.greatest(F.col("__before"), F.lit(period))
    within = Window.partitionBy("entity_id", "__span").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    own = {f"__{c}": F.sum(F.col(c) / period * F.pow(F.lit(1 / q), "__age")).over(within) * F.pow(F.lit(q), "__age") for c in columns}
    summed = rows.withColumn("__age", age).withColumns(own)
    last = F.max_by(F.struct(F.col("__age").alias("age"), *[F.col(f"__{c}").alias(c) for c in columns]), "__i").alias("x")
    steps = summed.groupBy("entity_id", "__span").agg(last).select("entity_id", F.struct("__span", "x.*").alias("x"))
    start = F.struct(F.array().cast("array<struct<" + ",".join(["__span:bigint", *[f"{c}:double" for c in columns]]) + ">>").alias("out"), *[F.lit(0.0).alias(c) for c in columns])

    def fold(state: Column, step: Column) -> Column:
        taken = F.struct(step["__span"].alias("__span"), *[state[c].alias(c) for c in columns])
        return F.struct(F.concat(state["out"], F.array(taken)).alias("out"), *[(state[c] * F.pow(F.lit(q), step["age"]) + step[c]).alias(c) for c in columns])

    folded = steps.groupBy("entity_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("entity_id", F.explode(F.aggregate("x", start, fold)["out"]).alias("x"))
    taken = folded.select("entity_id", "x.__span", *[F.col(f"x.{c}").alias(f"__in_{c}") for c in columns])
    joined = summed.join(taken, ["entity_id", "__span"], "left").where(F.col("__i") >= period)
    value = lambda c: F.col(f"__{c}") + F.col(f"__in_{c}") * F.pow(F.lit(q), "__age")
    return joined.select(*[value(c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def wilder(rows: DataFrame, column: str, period: int, span: int | None = None) -> DataFrame:
    """(keys, wilder): Wilder's smoothing of a column without nulls; the first period - 1 rows of an entity give none."""
    known = rows.where(F.col(column).isNotNull()).select(*KEYS, F.col(column).cast("double").alias("wilder"))
    return scan(stepped(known, span), ["wilder"], period).select(*KEYS, "wilder")


@REGISTRY.register("adx", 1, "adx", ["high", "low", "close"])
def adx(inputs: Mapping[str, DataFrame], as_of, period: int = 14, span: int | None = None) -> DataFrame:
    """Formula: Wilder's smoothing of DX = 100 |+DI - -DI| / (+DI + -DI), 0 without range.  PIT: inputs are read as of ``as_of``."""
    bars = together(inputs, ["high", "low", "close"])
    rows = scan(stepped(directional(bars, span), span), ["tr", "plus_dm", "minus_dm"], period)
    total = F.col("plus_dm") + F.col("minus_dm")
    index = F.when((F.col("tr") > 0) & (total > 0), 100.0 * F.abs(F.col("plus_dm") - F.col("minus_dm")) / total).otherwise(0.0)
    # the smoothed rows are numbered anew: the first of them is number ``period`` of all
    rest = rows.select(*KEYS, "__span", (F.col("__i") - period + 1).alias("__i"), F.greatest(F.col("__before") - period + 1, F.lit(0)).alias("__before"), index.alias("adx"))
    return scan(rest, ["adx"], period).select(*KEYS, "adx")


@REGISTRY.register("ma20_gap", 1, "ma20_gap", ["ma20", "close"])
def ma20_gap(inputs: Mapping[str, DataFrame], as_of) -> DataFrame:
    """Formula: close over ma20, less 1.  PIT: rests on ma20 and close as of ``as_of``."""
    joined = together(inputs, ["ma20", "close"])
    return joined.select(*KEYS, (F.col("close") / F.when(F.col("ma20") != 0, F.col("ma20")) - 1).alias("ma20_gap"))


def _finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the projection's finished generations."""
    return sorted(int(name) for name in names_in(spark, f"{path.rstrip('/')}/finished") if name.isdigit())


def current_projection(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last generation that was finished at ``path``; none yet is an error."""
    done = _finished(spark, path)
    if not done:
        raise ValueError("the projection was never materialised")
    return spark.read.parquet(f"{path.rstrip('/')}/generation={done[-1]}")


def materialise(rows: DataFrame, factor: Factor, as_of, computed_at, fingerprint: str, path: str, keep: int | None = None) -> DataFrame:
    """Write a factor's rows with their audit columns as the next generation at ``path``, make it the current one, read it.

    A generation is a folder of its own, whose number its writer has claimed by a file that only one can create; it counts only
    once a file with its number is among those of finished ones, which is the last thing written.  So two writers
    make two generations, readers see the whole of one, and a failed write is never seen.  ``keep``: how many of the finished generations before it stay
    (all, if not given); the others are deleted, which readers of the last few don't notice.
    """
    spark, root = rows.sparkSession, path.rstrip("/")
    generation = 1 + max(_finished(spark, path), default=0)
    while not create_once(spark, f"{root}/claims/{generation}"):
        generation += 1
    audit = {
        "algorithm_id": F.lit(factor.algorithm_id), "algorithm_version": F.lit(factor.version).cast("long"), "as_of": F.lit(as_of).cast("timestamp_ntz"), "computed_at": F.lit(computed_at).cast("timestamp_ntz"),
        "data_generation": F.lit(generation).cast("long"), "upstream_fingerprint": F.lit(fingerprint),
    }
    rows.withColumns(audit).write.mode("overwrite").parquet(f"{root}/generation={generation}")
    create_once(spark, f"{root}/finished/{generation}")
    if keep is not None:
        for old in [n for n in _finished(spark, path) if n < generation][: -keep or None]:
            delete(spark, f"{root}/finished/{old}")
            delete(spark, f"{root}/generation={old}")
    return spark.read.parquet(f"{root}/generation={generation}")


def refresh(registry: Registry, output: str, source: Callable[[Sequence[str]], DataFrame], changes: DataFrame, as_of, computed_at, path: str, keep: int | None = None) -> DataFrame:
    """The next generation of a projection at ``path``, in which only entities are evaluated of which something became known since the last one.

    ``changes``: (entity_id, knowledge_time) of all rows of the factor's inputs.  For factors whose rows rest on their own entity's
    inputs alone; the rows of all others are taken over, so the result is that of a full evaluation.  There is one if nothing
    was materialised yet, if the last generation holds no rows, is known later than ``as_of``, or is of another algorithm, version or upstream.
    The semi join by entity goes below the reads' windows, so history of other entities is not shuffled.
    """
    spark, factor, fingerprint = changes.sparkSession, registry.factors[output], registry.fingerprint(output)
    moment = F.lit(as_of).cast("timestamp_ntz")
    previous = current_projection(spark, path) if _finished(spark, path) else None
    if previous is not None:
        same = (F.col("algorithm_id") == factor.algorithm_id) & (F.col("algorithm_version") == factor.version) & (F.col("upstream_fingerprint") == fingerprint)
        row = previous.agg(F.max("as_of").alias("last"), F.every(same & (F.col("as_of") <= moment)).alias("fit")).first()
        previous = previous if row.fit else None
    if previous is None:
        return materialise(registry.evaluate(output, source, as_of), factor, as_of, computed_at, fingerprint, path, keep)
    changed = changes.where((F.col("knowledge_time") > F.lit(row.last).cast("timestamp_ntz")) & (F.col("knowledge_time") <= moment)).select("entity_id").distinct()
    fresh = registry.evaluate(output, lambda names: source(names).join(changed, "entity_id", "left_semi"), as_of)
    kept = previous.join(changed, "entity_id", "left_anti").select(*KEYS, output)
    return materialise(kept.unionByName(fresh), factor, as_of, computed_at, fingerprint, path, keep)


def read_projection(projection: DataFrame, factor: Factor, at, window: tuple | None = None, entities: Sequence | None = None, fingerprint: str | None = None) -> DataFrame:
    """A projection's rows, if it is fit to be read at ``at``: computed before, over all the window, by the current algorithm.

    One aggregate row is read to judge that; moments with an offset are taken in UTC.  An empty projection is legal.
    """
    moment = F.lit(at).cast("timestamp").cast("timestamp_ntz")
    first, last = [F.lit(d).cast("date") for d in window] if window is not None else [F.lit(None).cast("date")] * 2
    row = projection.agg(
        (F.max("computed_at") > moment).alias("later"), ((F.min("trade_date") > first) | (F.max("trade_date") < last)).alias("short"),
        F.collect_set(F.struct("algorithm_id", "algorithm_version", "upstream_fingerprint")).alias("who"),
    ).first()
    if row.later:
        raise ValueError("the projection was computed later")
    if any((w.algorithm_id, w.algorithm_version) != (factor.algorithm_id, factor.version) or (fingerprint and w.upstream_fingerprint != fingerprint) for w in row.who):
        raise ValueError("the projection is of another algorithm")
    if row.short:
        raise ValueError("the projection does not cover the window")
    found = projection if entities is None else projection.where(F.col("entity_id").isin(list(entities)))
    return (found if window is None else found.where(F.col("trade_date").between(first, last))).select(*KEYS, factor.output)


def input_coverage(inputs: Mapping[str, DataFrame], at, entities: Sequence | None = None) -> DataFrame:
    """(input, latest): the last day of each input known at ``at``."""
    out = None
    for name, rows in inputs.items():
        seen = rows.where(F.col("knowledge_time") <= F.lit(at).cast("timestamp_ntz"))
        seen = seen if entities is None else seen.where(F.col("entity_id").isin(list(entities)))
        one = seen.agg(F.max("trade_date").alias("latest")).select(F.lit(name).alias("input"), "latest")
        out = one if out is None else out.unionByName(one)
    return out


def ensure_covered(inputs: Mapping[str, DataFrame], at, end, entities: Sequence | None = None) -> None:
    """Raise if an input ends before ``end``; an empty entity set needs nothing."""
    if entities is not None and not entities:
        return
    stale = [r.input for r in input_coverage(inputs, at, entities).collect() if r.latest is None or str(r.latest) < str(end)]
    if stale:
        raise ValueError(f"stale inputs: {stale}")


def ledger_upsert(ledger: DataFrame, rows: DataFrame, kept: Sequence[str] = ("dataset", "output", "inputs")) -> DataFrame:
    """The ledger with ``rows`` put in by algorithm_id: their values win, but nulls of ``kept`` columns leave the old ones."""
    new = rows.select("algorithm_id", *[F.col(c).alias(f"__{c}") for c in rows.columns if c != "algorithm_id"], F.lit(True).alias("__new"))
    joined = ledger.join(new, "algorithm_id", "full")
    value = lambda c: F.coalesce(f"__{c}", c) if c in kept else F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c))
    return joined.select("algorithm_id", *[value(c).alias(c) for c in ledger.columns if c != "algorithm_id"])


def ledger_events(events: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming events (algorithm_id, effective_from, reason) that ``events`` lacks by id and date, one of each (the first reason)."""
    one = incoming.groupBy("algorithm_id", "effective_from").agg(F.min("reason").alias("reason"))
    return one.join(events.select("algorithm_id", "effective_from"), ["algorithm_id", "effective_from"], "left_anti")


def ledger_status(ledger: DataFrame, referenced: DataFrame) -> DataFrame:
    """The ledger with status: active if an algorithm is among the ``referenced`` (algorithm_id), else deprecated."""
    used = referenced.select("algorithm_id", F.lit(True).alias("__used")).distinct()
    return ledger.join(used, "algorithm_id", "left").withColumn("status", F.when(F.col("__used"), "active").otherwise("deprecated")).drop("__used")
