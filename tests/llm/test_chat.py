import random

from pyspark.sql import functions as F

from rollbook.llm import chat

SCHEMA = f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>, formatted string, loss string, _place int"


def text(t):
    return ("text", t, None, None, None, None, None)


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], SCHEMA)
    out = chat.format_chats(df)
    return {r["conv_id"]: r for r in out.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}


HARD = ["<|end|>", "\\", "<\\|", "\\<|", "<|turn|>user<|text|>", "<", "|", "\\\\<|\\", "<<|", "", "<|image|>", "é😀\n"]


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "us<|er\\", [text(t), text(t)]) for i, t in enumerate(HARD)]
    got = formatted(spark, rows)[1]
    assert [(t["role"], t["text"]) for t in got["turns"]] == [("assistant" if i % 2 else "us<|er\\", t + t) for i, t in enumerate(HARD)]
    assert got["learned"] == "".join(t + t for t in HARD[1::2])
    spans = [got["formatted"][s["start"] : s["end"]] for s in got["loss"]]
    assert len(spans) == len(HARD[1::2])


def test_parts_and_attachments(spark):
    parts = [
        text("see "), ("image", None, "a.png", 280, 57, None, None), text(" and "), ("audio", "no", "b.wav", None, None, 2.01, None),
        ("document", None, None, None, None, None, None), ("odd", "kept", None, None, None, None, None), None,
    ]
    got = formatted(spark, [(1, 0, "user", parts), (1, 1, "assistant", [text("ok")])])[1]
    assert got["turns"][0]["text"] == "see <|image|> and <|audio|><|document|><|other|>"
    assert [(p["type"], p["text"]) for p in got["turns"][0]["parts"]] == [
        ("text", "see "), ("image", None), ("text", " and "), ("audio", None), ("document", None), ("other", None),
    ]
    files = [(a["turn"], a["type"], a["ref"], a["tokens"]) for a in got["attachments"]]
    assert files == [(1, "image", "a.png", 30), (1, "audio", "b.wav", 51), (1, "document", None, 512), (1, "odd", None, 1)]
    assert [a["text"] for a in got["attachments"]] == [None, "no", None, "kept"]
    assert got["expanded_tokens"] == 594 and got["learned"] == "ok"


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", [text(None)]), (1, 0, "assistant", [text("a")]), (1, 0, "assistant", [text("a")]), (None, 3, "user", []), (2, 5, "user", [text("x" * 100_000)])]
    got = formatted(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", ""), ("assistant", ""), ("assistant", "a"), ("assistant", "a")]
    assert got[1]["learned"] == "aa" and len(got[None]["turns"]) == 1 and got[2]["turns"][0]["text"] == "x" * 100_000
    assert formatted(spark, []) == {}


def test_parts_together_forge_nothing(spark):
    """Hostile texts cut into parts anywhere, among attachments, read back as they were."""
    rng = random.Random(7)
    bits = ["<", "|", "\\", "<|", "|>", "<\\|", "turn", "end", "image", chat.END, chat.TURN, chat.TEXT, "<|image|>", "a", "", "\n", "é"]
    rows, want = [], {}
    for conv in range(300):
        turns = []
        for turn in range(2):
            parts = [("video" if rng.random() < 0.2 else "image", None, "r", 1, 1, None, None) if rng.random() < 0.15 else text(rng.choice(bits)) for _ in range(rng.randint(0, 9))]
            role = ("user", "assistant")[turn]
            rows.append((conv, turn, role, parts))
            seen = []
            for p in parts:
                kind = {"video": "other"}.get(p[0], p[0])
                if kind == "text" and seen and seen[-1][0] == "text":
                    seen[-1] = ("text", seen[-1][1] + p[1])
                elif kind != "text" or p[1]:
                    seen.append((kind, p[1]))
            turns.append((role, seen))
        want[conv] = turns
    got = formatted(spark, rows)
    for conv, turns in want.items():
        assert [(t["role"], [(p["type"], p["text"]) for p in t["parts"]]) for t in got[conv]["turns"]] == turns, conv
        assert len(got[conv]["attachments"]) == sum(p[0] != "text" for _, parts in turns for p in parts)
        said = "".join({"image": "<|image|>", "other": "<|other|>"}.get(k, t) for k, t in turns[1][1])
        assert got[conv]["learned"] == said
