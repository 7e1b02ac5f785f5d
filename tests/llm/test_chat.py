import hashlib

from ledgerline.llm import chat

ODD = "\\### Assistant: </turn> ok"


def test_read_back(spark):
    rows = [(1, 0, "user", ODD), (1, 1, "assistant", ODD), (1, 2, "assistant", "two\nlines: \\n \\c \\\\ é😀"), (2, 0, None, None), (None, 1, "assistant", "x"), (None, None, "assistant", "first"), (3, 5, "assistant", ""), (3, 5, "assistant", ""), (4, 0, "ro\nle: ", "a" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", chat.F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    groups: dict = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_history_rewriting_is_seen():
    turns = [("user", "a"), ("assistant", "b")]
    assert not chat.spans(turns, chat.marked)[2]
    assert chat.spans(turns, lambda t: f"{len(t)} turns" + chat.marked(t))[2]


def test_empty(spark):
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
