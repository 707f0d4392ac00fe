import hashlib
import re
import string
from collections import Counter

from chronolith.llm import decontaminate
from tests.llm.test_sql import compared

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
PASSAGE = "One two three, four five six seven eight nine ten eleven twelve thirteen"
ITEMS = [
    (1, PASSAGE), (10, "a b c d e f g h i j k l"), (2, "short ITEM"), (3, None), (4, ""), (5, "?! ..."), (None, "no id here at all"), (None, "short item"), (7, "Ünï cödé Ä1 b2"), (7, "alone"), (8, PASSAGE.upper()), (9, "a b c d e f g h i j x y"),
    (11, "same same same same same same same same same same same"), (12, "k l"),
]
TEXTS = [
    None, "", "  \n", "nothing to see", PASSAGE, "see: " + PASSAGE.replace(" ", "\t--\n") + "! and more", PASSAGE[:50], "a b c d e f g h i j", "x a b c d e f g h i j k l y", "a short, item. short item short", "SHORT\x00ITEM", "Ünï cödé Ä1 b2!", "ünï cödé ä1 b2", "not_alone",
    "alone alone", "same " * 25, "no id here at all 😀 alone", "lead " * 30_000 + PASSAGE + " tail" * 30_000, "k l k l", "a b c d e f g h i j x y " + PASSAGE, "..." + PASSAGE + "...", "[x] one two three four five six seven eight nine ten",
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(texts, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[at : at + n]), set()).add("" if item is None else str(item))
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for at in range(len(w) - n + 1):
                if (g := tuple(w[at : at + n])) in grams:
                    hit |= set(range(at, at + n))
                    found |= grams[g]
        yield len(w), hit, sorted(found)


def frames(spark, texts=TEXTS, items=ITEMS):
    docs = spark.createDataFrame([(n if n % 7 else None, t, "clash", n) for n, t in enumerate(texts * 2)], "doc_id long, text string, words string, place int")
    return docs, spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, hash string")


def test_hits_match_brute_force_in_one_block_or_many(spark):
    docs, items = frames(spark)
    want = Counter((n if n % 7 else None, count, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)) for n, (count, hit, found) in enumerate(brute(TEXTS * 2, ITEMS)))
    for blocks in ({}, {"block_windows": 4}, {"block_bytes": 60}):
        found = decontaminate.find(docs, items, **blocks)
        got = found.collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
        assert all(sum(s.stop - s.start for s in r.spans) == r.n_hit and all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:])) for r in got)


def test_spans_and_documents_are_removed(spark):
    docs, items = frames(spark)
    hits = [hit for _, hit, _ in brute(TEXTS, ITEMS)]
    for broadcast in (0, 100_000):
        kept = decontaminate.decontaminate(docs, items, "documents", max_broadcast=broadcast)
        assert kept.columns == docs.columns
        assert Counter(r.text for r in kept.collect()) == Counter(t for t, hit in zip(TEXTS * 2, hits * 2, strict=True) if not hit)
        cleaned = {r.place: r.text for r in decontaminate.decontaminate(docs, items, "spans", max_broadcast=broadcast).collect()}
        assert len(cleaned) == 2 * len(TEXTS)
        for n, (text, hit) in enumerate(zip(TEXTS * 2, hits * 2, strict=True)):
            assert cleaned[n] == text if not hit else words(cleaned[n]) == [w for k, w in enumerate(words(text)) if k not in hit]
    assert cleaned[TEXTS.index("..." + PASSAGE + "...")] == "..."
    assert cleaned[TEXTS.index("[x] one two three four five six seven eight nine ten")] == "[x] "


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert decontaminate.find(docs.limit(0), items).count() == 0
    found = decontaminate.find(docs, items.limit(0)).collect()
    assert len(found) == 2 * len(TEXTS) and not any(r.contaminated or r.n_items for r in found)
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 2 * len(TEXTS)
    assert decontaminate.decontaminate(docs, items.limit(0), "documents").count() == 2 * len(TEXTS)


def test_a_window_of_all_items_is_not_paired_with_all_documents(spark):
    shared = "choose the best answer from the list of four below "
    docs = spark.createDataFrame([(n, shared + f"w{n}") for n in range(3000)], "doc_id long, text string")
    items = spark.createDataFrame([(n, shared + f"q{n} q") for n in range(2000)], "item_id long, text string")
    found = decontaminate.find(docs, items)
    assert {(r.n_hit, r.n_items) for r in found.collect()} == {(10, 2000)}


def test_sql_on_odd_rows(spark, tmp_path):
    docs, items = frames(spark)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    items.select("item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    compared(spark, tmp_path, "op12_decontaminate")


def test_plan_has_no_python_and_one_scan(spark, tmp_path):
    docs, items = frames(spark)
    docs.write.parquet(f"{tmp_path}/docs")
    grams, _ = decontaminate._grams(items, "item_id", "text", 10)
    rows = spark.read.parquet(f"{tmp_path}/docs").select("doc_id", decontaminate.words_of(decontaminate.text_or_empty()).alias("w"))
    plan = decontaminate._looked_up(rows, grams, [2, 10])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("FileScan") == 1 and not re.search("Python|Arrow|Pandas|hashpartitioning", plan)
