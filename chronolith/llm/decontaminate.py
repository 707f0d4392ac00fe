"""Benchmark decontamination: token windows of documents against a broadcast hash set of normalised test n-grams.

Items are cut into windows of ten words (a shorter item is one window).  The distinct windows, under their hashes, are the
set; every window of every document is hashed by the same expression and looked up in it, and a hit is verified word by word
in the same join.  The set is broadcast in blocks of a counted size, one pass over the documents for each, so that it has no
bound; what is shuffled are hits and a short row for each document.

Windows that stand in the same items share a number of that set of items, and documents that hit the same numbers share one
list of items, so a window that all items hold is never paired with every document that holds it.

Everything is DataFrame operations.  A document's words lie in one row, so a text may take some hundred megabytes at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import ascii_lower, broadcast_within, checkpointed, text_or_empty

#: What separates the words of a lower-cased text, and of a text as it is.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD, RAW_SEPARATORS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
#: Words of a window.
WINDOW = 10
#: Windows, and bytes of their words, that one pass broadcasts.
BLOCK_WINDOWS, BLOCK_BYTES = 500_000, 64_000_000
#: Rows of fixed size up to which the table of lists of items is broadcast.
BROADCAST_LISTS = 500_000


def words_of(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def _over(words: Column, size: int, made) -> Column:
    """``made(place)`` for the place of every window of ``size`` words; none if there are fewer words."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size))
    return F.transform(F.coalesce(places, F.array().cast("array<int>")), made)


def _hashes(words: Column, size: int) -> Column:
    return _over(words, size, lambda at: _hash(words, at, size))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(size, hash, words, item): the distinct windows of every item.  ``item`` is the id as text, '' for a null id."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_or_empty(text_col)).alias("w"))
    size = F.least(F.size("w"), F.lit(window))
    cut = lambda n: F.when(size == n, _over(F.col("w"), n, lambda at: F.struct(_hash(F.col("w"), at, n).alias("hash"), F.slice(F.col("w"), at + 1, n).alias("words"))))
    made = rows.where(F.size("w") > 0).select("item", F.coalesce(*[cut(n) for n in range(1, window + 1)]).alias("windows"))
    found = made.select("item", F.explode("windows").alias("x")).select(F.size("x.words").alias("size"), "x.hash", "x.words", "item")
    return found.distinct()


def _grams(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (size, hash, words, list_id), and the lists of items (list_id, items) that they stand in."""
    listed = item_windows(benchmark, id_col, text_col, window).groupBy("size", "hash", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = checkpointed(listed)
    lists = checkpointed(listed.select("items").distinct().withColumn("list_id", F.monotonically_increasing_id()))
    return checkpointed(listed.join(lists, "items").drop("items")), lists


def _looked_up(rows: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """One pass: (place, kept columns, n_words, start, stop, list_id) of each hit, and one row without for each document's first window."""
    kept = [c for c in rows.columns if c != "w"]
    n = F.size("w")
    # hashes of all sizes stand one after the other in one array; a size's windows begin where those before it end
    starts, before = {}, F.lit(0)
    for size in sizes:
        starts[size] = before
        before = before + F.greatest(n - size + 1, F.lit(0))
    hashed = rows.select(*kept, "w", F.concat(*[_hashes(F.col("w"), s) for s in sizes]).alias("hashes"))
    # words travel with each window by reference: generator, join and filter are one span of generated code
    each = hashed.select(*kept, "w", F.posexplode_outer("hashes").alias("n", "hash"))
    first = reduce(lambda a, s: F.when(F.col("g.size") == s, starts[s]).otherwise(a), sizes, F.lit(None).cast("int"))
    same = (F.col("d.hash") == F.col("g.hash")) & (F.slice(F.col("d.w"), F.col("d.n") - first + 1, F.col("g.size")) == F.col("g.words"))
    met = each.alias("d").join(F.broadcast(grams).alias("g"), same, "left")
    met = met.where(F.col("g.list_id").isNotNull() | (F.coalesce("d.n", F.lit(0)) == 0))
    start = F.col("d.n") - first
    return met.select(*[f"d.{c}" for c in kept], n.alias("n_words"), start.alias("start"), (start + F.col("g.size")).alias("stop"), "g.list_id")


def _hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, block_windows: int, block_bytes: int) -> DataFrame:
    """(place, id, n_words, n_hit, spans, n_items, items_sha256) of every row; ``place`` comes again if the same partitions do."""
    grams, lists = _grams(benchmark, item_col, item_text, window)
    held = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w))
    count, size, sizes = grams.agg(F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0)), F.sort_array(F.collect_set("size"))).first()
    blocks = max(1, -(-count // block_windows), -(-size // block_bytes))
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).alias("id"), words_of(text_or_empty(text_col)).alias("w"))
    passes = [_looked_up(rows, grams if blocks == 1 else grams.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == b), sizes or [window]) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, passes)
    order = Window.partitionBy("place").orderBy("start", "stop")
    reached = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = found.withColumn("reached", reached).withColumn("span", F.sum(F.when(F.col("start") > F.col("reached"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # merged spans, then one row for each document: both keep the partitioning of the window
    spans = cut.groupBy("place", "span").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_set("list_id").alias("lists"),
    )
    span = F.when(F.col("start").isNotNull(), F.struct("start", "stop"))
    one = spans.groupBy("place").agg(
        F.first("id").alias("id"), F.first("n_words").cast("long").alias("n_words"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.collect_list(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))).alias("lists"),
    )
    one = checkpointed(one.withColumn("sign", F.sha2(F.concat_ws(",", F.col("lists").cast("array<string>")), 256)))
    asked = one.where(F.size("lists") > 0).groupBy("sign").agg(F.first("lists").alias("lists"))
    items = asked.select("sign", F.explode("lists").alias("list_id")).join(lists, "list_id").select("sign", F.explode("items").alias("item"))
    items = items.groupBy("sign").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = checkpointed(items.select("sign", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")))
    joined = one.drop("lists").join(broadcast_within(told, BROADCAST_LISTS), "sign", "left")
    return joined.drop("sign").withColumns({"n_items": F.coalesce("n_items", F.lit(0).cast("long")), "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256))})


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each row of ``docs``: its id, n_words, n_hit, spans (array of start, stop in words, merged), n_items,
    items_sha256 (of the sorted ids of items with occurring windows, joined by commas), contaminated.

    Null texts have no words, on both sides; null and repeated ids and repeated rows are rows like others (items of one id
    are one item, a null id is the item ''); other columns do no harm; an empty table on either side gives no hits.
    If the windows need several blocks, ``docs`` is read once for each and must give the same partitions each time, as files and
    checkpoints do.
    """
    hits = _hits(docs, benchmark, id_col, text_col, item_col, item_text, window, block_windows, block_bytes)
    return hits.select(F.col("id").alias(id_col), "n_words", "n_hit", "spans", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES, max_broadcast: int = 100_000,
) -> DataFrame:
    """The rows of ``docs`` with all their columns, without the documents that hold a window (``remove`` documents), or without
    the words inside windows and what follows each up to the next word (spans).

    Odd rows are dealt with as by :func:`find`; clean documents stay as they are, null texts null.  ``docs`` must give the same partitions
    each time it is read.  Documents with hits go to the others by broadcast only if they and their spans are counted to at most ``max_broadcast``.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove spans or documents")
    hits = _hits(docs, benchmark, id_col, text_col, item_col, item_text, window, block_windows, block_bytes).where("n_hit > 0").select(F.col("place").alias("__place"), F.col("spans").alias("__spans"))
    hits = checkpointed(hits if remove == "spans" else hits.drop("__spans"))
    held = hits.agg(F.count(F.lit(1)), F.lit(0) if remove == "documents" else F.coalesce(F.sum(F.size("__spans")), F.lit(0))).first()
    few = F.broadcast(hits) if held[0] + held[1] <= max_broadcast else hits
    keyed = docs.withColumn("__place", F.monotonically_increasing_id())
    if remove == "documents":
        return keyed.join(few, "__place", "left_anti").drop("__place")
    text = F.col(text_col)
    head, pieces = F.regexp_extract(text, f"^{RAW_SEPARATORS}", 0), F.regexp_extract_all(text, F.lit(f"{RAW_WORD}{RAW_SEPARATORS}"), F.lit(0))
    edges = F.transform("__spans", lambda s, n: F.struct(F.when(n == 0, 0).otherwise(F.get("__spans", n - 1)["stop"]).alias("a"), s["start"].alias("b")))
    edges = F.concat(edges, F.array(F.struct(F.element_at("__spans", -1)["stop"].alias("a"), F.size(pieces).alias("b"))))
    kept = F.flatten(F.transform(edges, lambda e: F.slice(pieces, e["a"] + 1, e["b"] - e["a"])))
    cleaned = F.when(F.col("__spans").isNotNull(), F.concat(head, F.array_join(kept, ""))).otherwise(text)
    return keyed.join(few, "__place", "left").withColumn(text_col, cleaned).select(*docs.columns)
