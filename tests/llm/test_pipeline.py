"""The pipeline on a small corpus, stage by stage against brute force, and the list of registered queries."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from chronolith.llm import mixing, simhash, toxicity
from tests.llm.test_duplicates import brute_components
from tests.llm.test_minhash import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        if i % 8 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["moronx", "zcumbag", "vexquid"]))
        line = " ".join(text) if i % 5 else " | ".join(w.upper() + "%%%" for w in text)
        docs.append((i, line, "en", f"s{i % 3}", len(line)))
        labels.append((i, int(i % 5 != 0), int(i % 8 == 0)))
    docs += [(1000 + n, docs[n % 40][1], "en", "copy", 0) for n in range(120)]  # exact copies
    docs += [(2000 + n, docs[41 + n % 3][1].replace(" ", "  ", 1).upper() if n % 2 else docs[41 + n % 3][1] + " end", None, None, None) for n in range(30)]
    docs += [(3000, None, None, None, None), (3001, "", None, None, 0), (None, "no id here", "en", "s1", 10)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    seen["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "bpe" or docs.columns == COLUMNS
        seen[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}

    source = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(source, toxicity.training_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    assert ids["toxicity"] == {r.doc_id for r in toxicity.score(source, model).collect() if not r.predicted}
    bad = {r.doc_id for r in seen["documents"] if r.text and re.search("moronx|zcumbag|vexquid", r.text.lower())}
    assert not bad & ids["toxicity"] and len(ids["toxicity"]) == len(ids["documents"]) - len(bad)

    best = {}
    for r in seen["toxicity"]:
        best[r.text or ""] = max(best.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    assert ids["exact_dedup"] == {r.doc_id for r in seen["toxicity"] if r.doc_id is None or best[r.text or ""] == r.doc_id}

    sets = {r.doc_id: shingles(r.text) for r in seen["exact_dedup"]}
    root = brute_components([i for i in sets if i is not None], lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert ids["simhash"] == {i for i in sets if i is None or root[i] == i}

    labels = mixing.label_domains(spark.read.parquet(f"{folder}/labels.parquet"))
    kept = mixing.mix(spark.read.parquet(str(tmp_path / "simhash")), labels, {"clean": 0.95, "rough": 0.05}, max_rate=1.0).collect()
    assert ids["mixing"] == {r.doc_id for r in kept if r.copies}
    clean = {i for i in ids["simhash"] if i is not None and i < 400 and i % 5}
    assert clean <= ids["mixing"] and len(ids["mixing"]) < len(ids["simhash"])

    tokenizer = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text or "" for r in seen["mixing"]}
    assert {r.doc_id: list(r.ids) for r in seen["bpe"]} == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in text.items()}


def test_run_gives_the_last_stage(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() > 100
    assert found.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, tables without usable labels, very long and repeated texts, null and repeated ids, more columns."""
    schema, labels = "doc_id long, text string, lang string, source string, n_chars long, __place string", "doc_id long, quality int, toxic int"
    rows = [(1, "word " * 60_000, "en", "s", 1, "x"), (1, "word " * 60_000, "en", "s", 1, "y"), (None, None, None, None, None, None), (None, "", "en", None, 0, "z"), (2, "fine words here", "en", "s", 1, "x"), (2, "others of that id", "en", "s", 1, "x")]
    tokenizer = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    for n, (docs, known) in enumerate([([], []), (rows, []), (rows, [(1, None, None), (None, 1, 1), (2, 1, 0)])]):
        folder = str(tmp_path / str(n))
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(known, labels).write.parquet(f"{folder}/labels.parquet")
        table = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:3]:
            stage(spark, table, folder).write.parquet(f"{folder}/{name}")
            table = spark.read.parquet(f"{folder}/{name}")
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars", "__place"]
        assert sorted((r.text or "")[:4] for r in table.collect()) == (["", "fine", "othe", "word"] if docs else [])
        found = Counter((r.doc_id, *r.ids) for r in corpus_pipeline.run(spark, folder).collect())
        encoded = Counter((r.doc_id, *tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in table.collect())
        # without labels all that is distinct stays; with them, mixing may leave out some of it
        assert found <= encoded and (sum(found.values()) > 0 if known else found == encoded)


def test_near_stage_links_by_fingerprints_and_by_shingles(spark, tmp_path):
    """1 and 2 have one fingerprint and few common shingles, 2 and 3 the same shingles and distant fingerprints."""
    line, ends = "alpha beta gamma delta epsilon ", [" ".join(f"{c}{n}" for n in range(10)) for c in "xy"]
    rows = [(1, line * 200 + ends[0]), (2, line * 200 + ends[1]), (3, line * 2 + ends[1]), (4, "quite another text of a few words"), (None, line * 200 + ends[0] + " end"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    prints = {n: simhash.simhash(rows[n - 1][1].encode(), 4) for n in (1, 2, 3)}
    sets = {n: shingles(rows[n - 1][1]) for n in (1, 2, 3)}
    assert (prints[1] ^ prints[2]).bit_count() <= 4 < (prints[2] ^ prints[3]).bit_count()
    assert 5 * len(sets[1] & sets[2]) < 4 * len(sets[1] | sets[2]) and sets[2] == sets[3]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_near(spark, docs, str(tmp_path)).collect()) == ["1", "4", "None"]


def test_one_query_for_each_operator():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_|pipeline", n)]
    assert sorted(re.match(r"op(\d+)|pipeline", n)[0] for n in names) == sorted([f"op{n}" for n in range(1, 14)] + ["pipeline"])
