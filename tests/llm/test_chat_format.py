import hashlib
import random
from collections import defaultdict

from auditmill.llm import chat_format as C

LOSS = {"assistant"}


def test_reads_back_what_it_was_given(spark):
    rnd = random.Random(1)
    pool = [*C.TEMPLATE.controls, "\\", "\\\\", "[\\INST]", "<\\/s>", " ", "\n", "a", "é🙂", "[", "<", "/s>"]
    rows = []
    for conv in range(80):
        for turn in range(rnd.randrange(1, 7)):
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system", "tool", "[/NAME] x", "", None]), "".join(rnd.choice(pool) for _ in range(rnd.randrange(12))) if rnd.random() < 0.9 else None, 1))
    rows += [(None, 0, "user", "x" * 200_000, 1), (None, None, "user", "y", 1), (80, 0, "user", "same", 1), (80, 0, "user", "same", 1)]
    chats = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int"))
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in C.digests(chats).collect()}
    made = {r.conv_id: r for r in chats.collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r in LOSS)
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == len(made[c].formatted) and made[c].formatted == "".join(s.text for s in made[c].segments)


def machine(roles, t=C.TEMPLATE):
    """(first bad turn, loss flags) by a plain loop."""
    state, bad, loss = t.start, None, []
    for i, r in enumerate(roles):
        to = t.moves.get((state, r))
        if to is None and bad is None:
            bad = i
        state = to or t.anyway.get(r, t.aside)
        loss.append(state in t.learned)
    return (len(roles) if bad is None and state not in t.final else bad), loss


def test_the_machine_decides_loss(spark):
    """Also one that learns only answers to a question, and a conversation longer than a stride."""
    from dataclasses import replace

    rnd = random.Random(3)
    strict = replace(C.TEMPLATE, moves={**C.TEMPLATE.moves, ("asked", "assistant"): "replied", ("replied", "user"): "asked"}, final=("replied",), learned=("replied",), anyway={"user": "asked"})
    for t in (C.TEMPLATE, strict):
        chats = [[rnd.choice(["user", "assistant", "system", "tool"]) for _ in range(n)] for n in (1, 2, 3, 5, 63, 64, 65, 200, 1500)] + [["user", "assistant"] * 100, ["assistant", "user", "assistant"]]
        rows = [(k, i, r, f"t{i}") for k, c in enumerate(chats) for i, r in enumerate(c)]
        got = {r.conv_id: r for r in C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t).collect()}
        for k, c in enumerate(chats):
            bad, loss = machine(c, t)
            assert got[k].bad_turn == bad and [s.loss for s in got[k].segments][2::3] == loss


def test_the_verdict_is_in_the_query(spark):
    made = C.digests(C.format_chats(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")))
    assert "instructed" in made._jdf.queryExecution().optimizedPlan().toString()
    assert (made.first().bad_turn, made.first().valid) == (1, False)


def test_the_machine(spark):
    rows = [(k, i, r, "t") for k, roles in enumerate(["sua", "ua", "uau", "au", "uu", "us", "uaua"]) for i, r in enumerate({"s": "system", "u": "user", "a": "assistant"}[x] for x in roles)]
    got = {r.conv_id: r.bad_turn for r in C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: 3, 3: 0, 4: 1, 5: 1, 6: None}
    assert C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
