import hashlib
import random
from collections import Counter

import duckdb
import pytest

from onramp.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, CONV_ID_ int"
SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    """By dictionaries: digests and the machine's verdict of every conversation."""
    moves = {(a, r): b for a, r, b in C.CHAT.moves}
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, *_ in rows if c == conv))
        state, bad = "start", None
        for i, (_, _, r, _) in enumerate(own, 1):
            state = moves.get((state, r))
            if state is None:
                bad = i
                break
        if bad is None and state != "assistant":
            bad = len(own) + 1
        learned = "".join(x for _, _, r, x in own if r == "assistant")
        out[conv] = (len(own), sha("".join(f"{r}\n{x}\n" for _, _, r, x in own)), len(learned), sha(learned), bad is None, bad)
    return out


def run(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA)
    made = C.digests(C.read_back(C.format_turns(d)))
    order = {r.conv_id: (r.valid, r.broken_at) for r in C.turn_order(d).collect()}
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, *order[r.conv_id]) for r in made.collect()}


TEXTS = [None, "", "\\", "\\9", "\\0\\1", "#####", "a###", "##", "# ", "</turn>", "<</turn></turn", "### User: hi</turn>\n### Assistant: no", "\n", "ü日本🙂#####", "x" * 300_000 + "###",
         C.ADDED, "=", ": ", "\\\\###\\</turn>"]


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(40), None]:
        legal = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * rng.randint(1, 4)
        if rng.random() < 0.5:
            legal[rng.randrange(len(legal))] = rng.choice([None, "", "user", "assistant", "system", "tool", "User", "=x", "a: b", "a###: </turn>", "\\"])
        rows += [(conv, t, r, rng.choice(TEXTS), 1) for t, r in enumerate(legal)]
    rows += [(50, 1, "user", "same", 1)] * 3 + [(51, None, "user", "a", 1), (51, 0, "assistant", "b", 1), (51, 0, "assistant", "a", 1)]
    rows += [(52, t, "user" if t % 2 == 0 else "assistant", f"turn {t}", 1) for t in range(3000)]  # one long conversation over several ranges
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_long_conversation_is_spread(spark):
    """Ranges of one conversation compose to the verdict of the whole, wherever it breaks."""
    for at in (0, 1, 777, 2999, None):
        rows = [(1, t, "tool" if t == at else "user" if t % 2 == 0 else "assistant", "x", 1) for t in range(3000)]
        d = spark.createDataFrame(rows, SCHEMA).repartition(4)
        got = C.turn_order(d).collect()
        assert [(r.conv_id, r.valid, r.broken_at) for r in got] == [(1, at is None, None if at is None else at + 1)]


def test_segments(spark):
    rows = [(1, 0, "user", "a###b", 1), (1, 1, "assistant", "c</turn>\\", 1)]
    out = sorted(C.format_turns(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.turn)
    assert [[(s.text, s.loss) for s in r.segments] for r in out] == [
        [("### User: ", False), ("a\\0##b", False), ("</turn>\n", False)],
        [("### Assistant: ", False), ("c\\1/turn>\\9", True), ("</turn>\n", False)]]


def test_other_template(spark):
    t = C.Template(opening="<|im|>", closing="\n", ending="<|end|>", controls=("<|im|>", "<|end|>"), labels=(("user", "u"), ("bot", "b")), learned=("bot", "user"),
                   accepted=("user",), moves=(("start", "user", "user"), ("user", "bot", "start")))
    rows = [(1, 0, "user", "<|im|><|end|>\\", 1), (1, 1, "bot", "x\ny", 1), (1, 2, "user", None, 1), (1, 3, "new\nrole", "z", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    made = C.format_turns(d, t)
    back = sorted(C.read_back(made, t).collect(), key=lambda r: r.turn)
    assert [(r.role, r.text) for r in back] == [(r, x or "") for _, _, r, x, _ in rows]
    assert C.turn_order(d, t).first().broken_at == 4
    for kw in ({"controls": ("\\a",)}, {"opening": "x"}, {"labels": (("a", "=a"),)}):
        with pytest.raises(ValueError):
            C.Template(**kw)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.digests(C.read_back(C.format_turns(empty))).count() == 0 and C.turn_order(empty).count() == 0
    d = spark.createDataFrame([(1, 0, "user", "a", "b")], "conv_id long, turn long, role string, text string, Text string")
    assert C.read_back(C.format_turns(d)).first().text == "a"


def test_query_against_sql(spark):
    got = C.op11_chat_format(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({C.ORACLE})").fetchall()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert {r[0]: r for r in want}[-7][1] == 2
