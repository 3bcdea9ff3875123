"""Quotation linking on small conversations."""

from __future__ import annotations

import random

from gleaner.llm.quotations import link_quotations

SCHEMA = "conv_id long, turn long, role string, text string, thread string, position int"


def _run(spark, rows):
    return {(r["conv_id"], r["turn"], r["role"]): r for r in link_quotations(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}


def test_nested_quotes_link_to_their_originals(spark):
    rows = [
        (1, 0, "a", "How do I sort a table?\n\nIt has two columns."),
        (1, 1, "b", "An unrelated remark of some length."),
        (1, 2, "c", "Al wrote:\n> How do I sort a table?\n>\n>  It has   two columns.\nUse orderBy."),
        (1, 3, "a", "> > How do I sort a table?\n> Use orderBy.\n\nThanks, that works."),
        (1, 4, "d", "> An unrelated REMARK of\n> some length.\nI agree."),
        (2, 0, "e", "> How do I sort a table?\nNobody asked here."),
    ]
    got = _run(spark, rows)
    assert got[1, 2, "c"]["text"] == "Use orderBy."
    assert [(q["level"], q["from_turn"]) for q in got[1, 2, "c"]["quotes"]] == [(1, 0), (1, 0)]
    assert [(q["level"], q["from_turn"]) for q in got[1, 3, "a"]["quotes"]] == [(2, 0), (1, 2)]
    assert {k[1]: v["reply_to"] for k, v in got.items() if k[0] == 1} == {0: None, 1: None, 2: 0, 3: 2, 4: 1}
    assert {k[1]: v["thread"] for k, v in got.items() if k[0] == 1} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1}
    assert [k[1] for k, v in sorted(got.items(), key=lambda x: x[1]["position"]) if k[0] == 1] == [0, 2, 3, 1, 4]
    other = got[2, 0, "e"]
    assert (other["reply_to"], other["max_level"], other["n_quoted_lines"], other["quotes"][0]["from_turn"]) == (None, 1, 1, None)


def test_no_one_quotes_the_future_and_the_first_who_says_it_is_meant(spark):
    rows = [(1, 0, "a", "> said later on, at length\nok"), (1, 1, "b", "said later on, at length"), (1, 2, "c", "said later on, at length"), (1, 3, "d", "> said later on, at length\nyes")]
    got = _run(spark, rows)
    assert got[1, 0, "a"]["reply_to"] is None
    assert got[1, 3, "d"]["reply_to"] == 1


def test_long_chains_of_replies_have_one_root(spark):
    rows = [(7, 0, "a", "message number zero")] + [(7, i, "a", f"> message number {'zero' if i == 1 else i - 1}\nmessage number {i}") for i in range(1, 40)]
    got = _run(spark, rows)
    assert {v["thread"] for v in got.values()} == {0}
    assert [got[7, i, "a"]["position"] for i in range(40)] == list(range(40))


def test_nulls_repeats_and_empty_texts(spark):
    rows = [(None, 1, "a", "hello there everyone"), (None, 2, "b", "> hello there everyone\nhi"), (3, None, "a", None), (3, 5, None, ""), (3, 5, None, ""), (3, 0, "x", "late\n" * 3000)]
    got = _run(spark, rows)
    assert got[None, 2, "b"]["reply_to"] == 1
    assert got[3, 5, None]["copies"] == 2
    assert got[3, None, "a"]["position"] == 2 and got[3, None, "a"]["text"] == ""
    assert len(got) == 5
    assert link_quotations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equals_plain_linking_on_made_up_threads(spark):
    """One hot conversation with a long chain, one of many threads, and messages without a turn."""
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4))
    rows, said = [], {}
    for conv in (1, 2):
        for turn in range(700 if conv == 1 else 60):
            own = line()
            quoted = said[conv][turn - 1 if conv == 1 else rng.randrange(turn)] if turn else None
            said.setdefault(conv, []).append(own)
            rows.append((conv, turn, "r", own if quoted is None else f"> {quoted.upper()}\n{own}"))
    rows += [(2, None, rng.choice("ab"), line()) for _ in range(40)]
    got = link_quotations(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    own = {(c, t): text.split("\n")[-1] for c, t, _, text in rows}
    first = {(c, text): t for (c, t), text in sorted(own.items(), key=lambda x: -x[0][1] if x[0][1] is not None else 1) if t is not None}
    reply = {(c, t): first[c, text.split("\n")[0][2:].lower()] for c, t, _, text in rows if text.startswith(">")}

    def root(c, t):
        while (c, t) in reply:
            t = reply[c, t]
        return t

    for r in got:
        c, t = r["conv_id"], r["turn"]
        if t is not None:
            assert (r["reply_to"], r["thread"], r["text"]) == (reply.get((c, t)), root(c, t), own[c, t])
    for c in (1, 2):
        mine = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine)))
        assert [r["turn"] for r in mine if r["turn"] is not None] == sorted((t for k, t in own if k == c and t is not None), key=lambda t: (root(c, t), t))
        assert all(r["turn"] is None for r in mine[sum(r["turn"] is not None for r in mine) :])
