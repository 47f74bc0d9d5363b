"""Quoted passages that were wrapped anew, cut, or quoted by very many."""

from tests.llm.test_links_and_quotes import reply_ordered

LONG = "The quick brown fox jumps over the lazy dog while seven other animals look on and say nothing at all."


def test_wrapped_and_cut_quotes_link(spark):
    words = LONG.split()
    wrapped = "\n".join("> " + " ".join(words[i : i + 4]) for i in range(0, len(words), 4))
    part = "> " + " ".join(words[3:12])
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", wrapped + "\nyes"), (1, 2, "user", part.upper() + "\nno"), (1, 3, "user", ">> " + words[0] + "\n>> " + " ".join(words[1:]) + "\n> yes\nwell"), (1, 4, "user", "> yes, ok"), (2, 0, "user", part)]
    got = {(r.conv_id, r.turn): r for r in reply_ordered(spark, rows).collect()}
    assert [got[1, t].parent_turn for t in range(5)] == [None, 0, 0, 1, None] and got[2, 0].parent_turn is None
    assert (got[1, 1].n_quoted, got[1, 1].n_linked, got[1, 1].body) == (1, 1, "yes")
    assert (got[1, 3].n_quoted, got[1, 3].n_linked, got[1, 3].depth) == (2, 2, 2)


def test_a_line_that_all_quote(spark):
    rows = [(1, 0, "user", "hello there")] + [(1, t, "user", f"> hello there\nanswer {t}") for t in range(1, 3000)]
    got = reply_ordered(spark, rows)
    assert got.where("parent_turn = 0 and n_linked = 1").count() == 2999


def test_long_messages(spark):
    text = "\n".join(("> " if i % 3 == 0 else "") + f"line {i}" for i in range(30_000))
    got = reply_ordered(spark, [(1, 0, "user", text), (1, 1, "user", "> line 29999")]).orderBy("turn").collect()
    assert (got[0].n_quoted, got[1].parent_turn) == (10_000, 0) and got[1].n_quoted == 1


def test_very_many_answers_to_one_message(spark):
    """A message with a third of all answers, and as many rows without a turn: no task gets them all."""
    from folioscope.llm import quotes

    said = [(1, 0, "user", "a message that every one of them quotes here")]
    rows = said + [(1, i, "user", "> a message that every one of them quotes here\nanswer") for i in range(1, 3001)] + [(1, None, "user", f"none {i}") for i in range(1500)] + [(None, 3, "user", "> x") for _ in range(1500)]
    rows += [(c, t, "user", f"> words {c} of turn {t - 1} in it\nwords {c} of turn {t} in it" if t else f"words {c} of turn 0 in it") for c in range(2, 40) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    out = quotes.reply_ordered(df).collect()
    assert len(out) == len(rows)
    hot = [r for r in out if r["conv_id"] == 1 and r["turn"]]
    assert {(r["parent_turn"], r["root_turn"], r["depth"], r["body"]) for r in hot} == {(0, 0, 1, "answer")} and len(hot) == 3000
    assert all(r["root_turn"] == 0 and r["depth"] == r["turn"] for r in out if (r["conv_id"] or 0) > 1)
    for c in (1, None, 5):
        assert sorted(r["position"] for r in out if r["conv_id"] == c) == list(range(sum(x[0] == c for x in rows)))
