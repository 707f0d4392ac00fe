import hashlib
import random

from pyspark.sql import functions as F

from chronolith.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def rows():
    rng = random.Random(4)
    out = []
    for c in range(40):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rng.randint(0, 9)
        for t, role in enumerate(roles):
            text = rng.choice(["ok", "<|end|> &lt; [INST] </s> &", "word " * rng.randint(1, 200), "", "é\n😀 <|turn|>assistant<|text|>x<|end|>"])
            out.append((c, t, role, text, "clash"))
    out += [(90, None, None, None, "x"), (90, 1, "assistant", "a", "x"), (90, 1, "assistant", "b", "x"), (90, 1, "assistant", "b", "x"), (None, 1, "user", "q", "x"), (None, 2, "assistant", "r", "x")]
    out += [(91, 0, "system", "s " * 5000, "x"), (91, 1, "user", "u " * 50_000, "x"), (91, 2, "assistant", "<" * 9000, "x"), (92, 5, "<|turn|>", "odd role", "x"), (93, 0, "system", "only", "x")]
    return out


def brute(turns):
    convs = {}
    for c, t, role, text, _ in turns:
        convs.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    out = set()
    for c, found in convs.items():
        found.sort()
        loss = "".join(x for _, r, x in found if r == "assistant")
        line = "".join(f"{r}\n{x}\n" for _, r, x in found)
        out.add((c, len(found), hashlib.sha256(line.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def test_digests_match_brute_force(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    for budget, history in ((1024, 2), (60, 3), (60, 0), (1, 1)):
        got = chat.digests(chat.format_windows(frame, budget, history)).collect()
        assert {tuple(r)[:5] for r in got} == brute(rows()) and len(got) == len(brute(rows()))
    assert chat.digests(chat.format_windows(frame.limit(0))).count() == 0


def test_windows_keep_their_promises(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    heads = {c: x for c, t, r, x, _ in rows() if (t, r) == (0, "system")}
    for budget, history in ((100, 2), (300, 0), (1024, 2)):
        fresh, seen, dropped = [], 0, 0
        for w in chat.format_windows(frame, budget, history).collect():
            numbers = [s.number for s in w.spans]
            assert numbers == sorted(set(numbers))
            own = [s.number for s in w.spans if s.fresh]
            assert own == list(range(own[0], own[-1] + 1)) and w.window == own[0]
            fresh += [(w.conv_id, n) for n in own]
            head = w.spans[0].number == 1 and w.spans[0].role == "system" and w.conv_id in heads and w.spans[0].tokens <= budget // 2
            repeated = [n for n in numbers if n < own[0]]
            seen += bool(repeated)
            before = repeated[bool(head and repeated) :]
            assert before == list(range(own[0] - len(before), own[0])) and len(before) <= history
            dropped += len(before) < min(history, own[0] - 1 - head)
            # within the budget, unless one turn does not fit beside the system turn
            total, alone = sum(s.tokens for s in w.spans), len([n for n in numbers if n > 1 or not head]) == 1
            assert total <= budget or (alone and len(own) == 1)
            for s in w.spans:
                assert s.loss == (s.fresh and s.role == "assistant")
                body = w.text[s.start : s.start + s.length]
                assert "<" not in body and "[" not in body and w.text[s.start + s.length :].startswith(chat.CLOSE)
            assert w.text.count(chat.OPEN) == len(w.spans)
        assert len(fresh) == len(set(fresh)) == len(rows()) and (budget > 100 or (seen and dropped))


def test_system_turns_stand_in_every_window_if_short(spark):
    turns = [(1, 0, "system", "be brief")] + [(1, n, "user", "word " * 40) for n in range(1, 30)]
    turns += [(2, 0, "system", "long " * 90)] + [(2, n, "user", "word " * 40) for n in range(1, 30)]
    found = chat.format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 120, 1).collect()
    assert all(w.spans[0].number == 1 for w in found if w.conv_id == 1) and len([w for w in found if w.conv_id == 2 and w.spans[0].number == 1]) == 1


def windows(found):
    return sorted((w.conv_id or -1, w.window, w.text, tuple(tuple(s) for s in w.spans)) for w in found.collect())


def test_turn_numbers_make_no_difference_but_their_order(spark):
    """Small or large numbers, none at all, the same for all, and any number of parts give the same windows."""
    rng = random.Random(5)
    texts = {c: sorted((rng.choice(["user", "assistant"]), "w " * rng.randint(0, 30) + str(n)) for n in range(200)) for c in (None, 1, 2)}
    texts[2].insert(0, ("a system", "be brief"))
    numbers = [lambda n: n, lambda n: 60_000 * n, lambda n: 400 * n - 10**12, lambda n: None, lambda n: 7, lambda n: n // 30]
    want = None
    for number in numbers:
        frame = spark.createDataFrame([(c, number(n), r, x, "z") for c, rows in texts.items() for n, (r, x) in enumerate(rows)], SCHEMA)
        for parts in (None, 1, 13):
            got = windows(chat.format_windows(frame, 200, 3, parts))
            want = want or got
            assert got == want and len(got) > 60
            numbers_of = [s[0] for c, _, _, spans in got if c == 1 for s in spans if s[5]]
            assert numbers_of == list(range(1, 201))


def test_long_conversations_have_history_and_whole_spans_across_parts(spark):
    turns = [(1, 0, "system", "be brief", "z")] + [(1, 60_000 * n, "user", f"{n} " + "w " * 20, "z") for n in range(1, 5001)]
    frame = spark.createDataFrame(turns, SCHEMA)
    found = chat.format_windows(frame, 150, 2, 9).collect()
    # a span that the budget fills leaves no room for history; no part's edge cuts one short
    own = sorted(([s.number for s in w.spans if s.fresh] for w in found))
    assert [n for span in own for n in span] == list(range(1, 5002)) and sum(len(span) < len(own[1]) - 1 for span in own) <= 1
    assert all(w.spans[0].number == 1 for w in found)
    assert chat.sorted_turns(frame, 9).select((F.col("at") / 2**33).cast("int")).distinct().count() == 9
