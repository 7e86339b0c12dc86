from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tokenloom.llm.chat import CONTROL, Windower, escape, format_windows, read_turns, token_counter, unescape
from tokenloom.llm.q_chat import digests, op9_chat

texts = st.lists(st.sampled_from([*"\\<>|[]/sSYINTturnend \n", "<|", "|>", "</s>", "[INST]", "<<SYS>>", "é"]), max_size=16).map("".join)


@given(texts)
@settings(max_examples=500, deadline=None)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "|>", ""]), texts), max_size=12), st.integers(1, 60), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_windows_cover_each_turn_once(turns, budget, history):
    w = Windower(budget, history, token_counter(None))
    windows = [x for r, t in turns for x in w.add(r, t)] + list(w.close())
    new = [t for x in windows for t in read_turns(x["text"])[x["n_repeated"] :]]
    assert new == turns
    loss = [unescape(x["text"][s["start"] : s["end"]]) for x in windows for s in x["targets"]]
    assert loss == [t for r, t in turns if r == "assistant"]
    for x in windows:
        assert x["n_tokens"] <= budget or x["n_new"] == 1
        if turns[0][0] == "system" and x["window"]:
            assert read_turns(x["text"])[0] == turns[0]
        assert x["n_repeated"] <= history + (turns[0][0] == "system")


def want(turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query_reads_back_what_was_there(spark, sf_dir):
    got = {r.conv_id: r for r in op9_chat(spark, sf_dir).collect()}
    by = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    by[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == by.keys()
    for k, turns in by.items():
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want(turns)
        assert r.formatted_chars >= sum(len(t or "") for _, t in turns)


def test_odd_conversations(spark):
    rows = [(1, 2, "assistant", None), (1, 1, None, "hi"), (1, None, "user", "last"), (1, 1, None, "hi"), (None, 1, "assistant", "x" * 50_000), (2, 1, "user", ""), (3, 1, "system", "s"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    got = {r.conv_id: r for r in digests(format_windows(df, budget=8)).collect()}
    for k, turns in {1: [(None, "hi"), (None, "hi"), ("assistant", None), ("user", "last")], None: [("assistant", "x" * 50_000)], 2: [("user", "")], 3: [("assistant", "a"), ("assistant", "b"), ("system", "s")]}.items():
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want(turns)
    assert digests(format_windows(df.where("false"))).count() == 0
    assert CONTROL.search("plain text") is None
