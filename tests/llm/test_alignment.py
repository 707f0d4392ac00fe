import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from chronolith.llm import alignment

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, n_a string, block int"
TEXTS = [
    None, "", " ", "  two  spaces  ", "The quick brown fox jumps over the lazy dog.", "The quick brown fox jumps over the lazy dog.", "naïve café — Ünïcödé 漢字 😀", "<|endoftext|> and <s> and </s> and <unk>", "a▁b", "▁", "tab\tnew\nline\r\n\x00nul", "internationalization " * 40,
    "don't stop", "ab" * 3000, "é ﬁ ①", "x", "The", " The", "the the the the", "日本語のテキスト", "<0x41>", "  ", "1234567890 3.14",
]


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    return table | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}


def brute(texts):
    a, b = Tokenizer.from_file(paths()[0]), SentencePieceProcessor(model_file=paths()[1])
    a.encode_special_tokens = True
    names, back = {i: t for t, i in json.load(open(paths()[0], encoding="utf-8"))["model"]["vocab"].items()}, byte_of()
    docs = []
    for text in texts:
        groups = []
        if text:
            whole = (" " + text).encode()
            ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
            parts = [[bytes(back[c] for c in names[i]) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], map(b.id_to_piece, ids[1]), strict=True)]]
            if all(b"".join(p) == whole for p in parts):
                ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
                at = [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    upto = [e.index(cut) + 1 for e in ends]
                    groups.append(tuple(tuple(i[x:y]) for i, x, y in zip(ids, at, upto, strict=True)))
                    at = upto
        docs.append(groups)
    links = Counter((x[-1], y[-1]) for groups in docs for x, y in groups)
    within = Counter((x, y, n) for n, groups in enumerate(docs) for x, y in {(x[-1], y[-1]) for x, y in groups})
    most = Counter()
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    rows = []
    for groups in docs:
        ends = [(x[-1], y[-1]) for x, y in groups]
        digest = hashlib.sha256(";".join("|".join(",".join(map(str, side)) for side in g) for g in groups).encode()).hexdigest() if groups else ""
        rows.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(ends), sum(links[e] == most[e[1]] for e in ends), sum(links[e] for e in ends), digest))
    return rows, {pair: (Counter((x, y) for x, y, _ in within)[pair], n) for pair, n in links.items()}


@pytest.mark.parametrize("more", [{}, {"salt_blocks": 2}])
def test_matches_brute_force(spark, monkeypatch, more):
    texts = TEXTS * 2
    rows = [(n if n % 9 else None, t, "clash", n) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6, "block")
    want, pairs = brute(texts)
    got = alignment.align(docs, *paths(), **more).collect()
    assert Counter(tuple(r) for r in got) == Counter((n if n % 9 else None, *w) for n, w in enumerate(want))
    found = alignment.pair_table(docs, *paths(), **more).collect()
    assert {(r.a, r.b): (r.n_docs, r.n_links) for r in found} == pairs and len(found) == len(pairs)
    most = Counter()
    for (_, b), (_, n) in pairs.items():
        most[b] = max(most[b], n)
    assert all(r.best == (r.n_links == most[r.b]) for r in found)


def test_empty_table_and_texts_without_tokens(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), *paths()).count() == 0
    got = alignment.align(spark.createDataFrame([(1, None, "", 0), (2, "", "", 0), (3, "a▁b", "", 0)], SCHEMA), *paths()).collect()
    assert sorted(map(tuple, got)) == [(n, 0, 0, 0, 0, 0, 0, "") for n in (1, 2, 3)]


@pytest.mark.parametrize("n_docs", [1, 5, 70, 3000])
def test_planes_count_documents_and_links(n_docs):
    rng = np.random.default_rng(n_docs)
    counts = rng.poisson(rng.choice([0.02, 0.5, 6.0], size=40)[:, None], (40, n_docs))
    pair, doc = np.nonzero(counts)
    planes = alignment.pack_planes(pair, doc, counts[pair, doc], 40, n_docs)
    docs, links = alignment.count_planes(planes, 40, n_docs)
    assert (docs == (counts > 0).sum(axis=1)).all() and (links == counts.sum(axis=1)).all()


class Counted:
    """An encoder that counts the strings it is given."""

    def __init__(self, inner):
        self.inner, self.given = inner, 0

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, strings, **more):
        self.given += len(strings)
        return self.inner.encode_batch_fast(strings, **more)

    def encode(self, strings, **more):
        self.given += len(strings)
        return self.inner.encode(strings, **more)


def whole(tokens, texts):
    """Ids of each text as both libraries encode it in one piece."""
    return [[e.ids for e in tokens.a.encode_batch([" " + t for t in texts], add_special_tokens=False)], tokens.b.encode(texts)]


def same(tokens, texts):
    for (ids, edges), want in zip(tokens.encode(texts), whole(tokens, texts), strict=True):
        assert [ids[x:y].tolist() for x, y in zip(edges[:-1], edges[1:], strict=True)] == want


def test_words_are_encoded_many_at_once_and_stay_known():
    tokens = alignment.Tokens(*alignment._tokenizers(*paths()))
    blocks = [[" ".join(f"w{n}x" for n in range(at, at + 300)) for at in range(first, first + 60_000, 300)] for first in (0, 60_000)]
    want = [whole(tokens, texts) for texts in blocks]
    tokens.a, tokens.b = Counted(tokens.a), Counted(tokens.b)
    for n in (0, 1, 0):
        before = tokens.a.given, tokens.b.given
        for (ids, edges), each in zip(tokens.encode(blocks[n]), want[n], strict=True):
            assert [ids[x:y].tolist() for x, y in zip(edges[:-1], edges[1:], strict=True)] == each
    assert (tokens.a.given, tokens.b.given) == before and tokens.a.given < 1200


@pytest.mark.parametrize("more", [{}, {"LONG": 6}, {"MOST_KNOWN": 7}, {"RUN": 1}])
def test_words_give_the_ids_of_whole_texts(monkeypatch, more):
    for name, value in more.items():
        monkeypatch.setattr(alignment, name, value)
    tokens, rng = alignment.Tokens(*alignment._tokenizers(*paths())), np.random.default_rng(len(more))
    signs = [" ", " ", " ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "the", "Fox", "'s", "'", ".", "12", "é", "漢字", "😀", "<|endoftext|>", "</s>", "ab" * 5]
    for _ in range(6):
        same(tokens, [t for t in ("".join(rng.choice(signs, n)) for n in rng.integers(1, 30, 200)) if t] + [t for t in TEXTS if t])


def test_words_are_not_joined_where_tokens_could_go_over_their_ends():
    spec, model = alignment._tokenizers(*paths())
    lacking = json.loads(spec)
    lacking["added_tokens"].append({"id": 60_000, "content": "y z", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    tokens = alignment.Tokens(json.dumps(lacking), model)
    ids, edges = tokens.encode(["x y", "z x"])[0]
    assert not tokens.joins and 60_000 not in ids and len(edges) == 3
    tokens = alignment.Tokens(spec, model)
    tokens.sizes[0] = tokens.sizes[0] + 1  # as if bytes were not given back
    same(tokens, [t for t in TEXTS if t])
    assert not tokens.joins
