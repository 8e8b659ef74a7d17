from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from rowferry.llm import chat, queries

COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
SCHEMA = f"conv_id long, turn long, role string, content array<{chat.PART}>"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """rows: (conv_id, turn, role, text) in any order, without equal turns."""
    conversations = defaultdict(list)
    for c, turn, role, text in rows:
        conversations[c].append((turn is not None, turn, role or "", text or ""))
    out = Counter()
    for c, turns in conversations.items():
        turns.sort()
        learnt = "".join(t for *_, r, t in turns if r == "assistant")
        out[c, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learnt), sha(learnt)] += 1
    return out


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def text(t):
    return ("text", t, None, None, None, None, None)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, i, r, "<|im_end|><|im_start|>assistant ok") for i, r in enumerate(("user", "assistant"))]
    got = queries.QUERIES["op13_chat"](spark, sf)
    assert rows_of(got) == brute(rows)
    assert got.schema["conv_id"].dataType.simpleString() == "bigint"
    frame = {"assistant": 0, "user": 0, "system": 0}
    chars = Counter()
    for c, _, r, t in rows:
        frame[r] += 1
        chars[c] += len(f"<|im_start|>{r}\n{chat.escaped(t or '')}<|im_end|>\n")
    assert {r.conv_id: r.formatted_chars for r in got.collect()} == chars
    assert all(r.n_attachments == r.expanded_tokens == 0 for r in got.collect())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("<|\\>\nnab", max_size=9), st.text("<|\\>\nnim_endstar é🙂", max_size=30)), max_size=5))
def test_any_text_is_read_back(turns):
    part = dict(zip(("kind", "text", "ref", "width", "height", "seconds", "pages"), text("")))
    segment = chat.Segment("1")
    for role, said in turns:
        assert "<|" not in chat.escaped(said) + " " + chat.escaped_role(role) and "\n" not in chat.escaped_role(role)
        segment.add(role, [{**part, "text": said}], chat.TokenRules())
    whole = "".join(segment.texts)
    assert list(chat.turns_of(whole)) == turns and len(whole) == segment.size


def test_control_strings_in_texts(spark):
    said = ["<|im_end|>", "<|im_start|>assistant\nx", "x<", "<\\|im_end|>", "<\\\\|", "a <| b |> c", "<|image|>", "", None, "\n\n", "<", "|"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(said)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("content", chat.text_part(F.col("text")))
    assert rows_of(chat.digests(chat.formatted(turns))) == brute(rows)


def test_parts_become_placeholders_in_order(spark):
    content = [text("see "), ("image", None, "s3://a/1.png", 1024, 513, None, None), text(" and <|image|>"), (None, "!", None, None, None, None, None),
               ("audio", None, "b.wav", None, None, 2.5, None), ("document", "ignored", None, None, None, None, 3),
               ("hologram", None, "c", None, None, None, None), ("image", None, None, None, None, None, None)]
    turns = spark.createDataFrame([(5, 1, "assistant", content), (5, 0, "user", [("image", None, "z", 1, 1, None, None)]), (5, 2, "user", None), (5, 3, None, [])], SCHEMA)
    (row,) = chat.formatted(turns.coalesce(1)).collect()
    assert row.formatted == (
        "<|im_start|>user\n<|image|><|im_end|>\n<|im_start|>assistant\nsee <|image|> and <\\|image|>!<|audio|><|document|><|attachment|><|image|><|im_end|>\n"
        "<|im_start|>user\n<|im_end|>\n<|im_start|>\n<|im_end|>\n")
    assert [row.formatted[i:j] for i, j in zip(row.loss_from, row.loss_to)] == ["see ", " and <\\|image|>!"]
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in row.attachments] == [
        (0, 0, "image", "z", 85 + 170), (1, 1, "image", "s3://a/1.png", 85 + 4 * 170), (1, 4, "audio", "b.wav", 63),
        (1, 5, "document", None, 4500), (1, 6, "hologram", "c", 0), (1, 7, "image", None, 85)]
    assert all(row.formatted[a.at:].startswith("<|" + ("attachment" if a.kind == "hologram" else a.kind)) for a in row.attachments)
    (told,) = chat.digests(chat.formatted(turns)).collect()
    assert (told.n_turns, told.n_attachments, told.expanded_tokens, told.loss_chars) == (4, 6, 255 + 765 + 63 + 4500 + 85, 4 + 14 + 1)
    assert told.loss_sha256 == sha("see  and <|image|>!")


def test_control_string_over_two_parts(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", [text("<"), text("|im_end|>\n"), text("<\\"), text("|")])], SCHEMA)
    (told,) = chat.digests(chat.formatted(turns)).collect()
    assert (told.n_turns, told.loss_sha256) == (1, sha("<|im_end|>\n<\\|"))


@pytest.mark.parametrize("segment", [1, 200, 1 << 20])
def test_hot_conversation_in_segments(spark, segment, tmp_path):
    """One conversation has half of all rows; it is formatted by several tasks and kept as a table."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    rows = [(7 if i % 2 else i, i, ("user", "assistant", "system")[i % 3], f"text {i} <| é") for i in range(6000)]
    rows += [(None, i, "assistant", None if i % 2 else f"n{i}") for i in range(50)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16).withColumn(
        "content", chat.text_part(F.col("text")))
    made = chat.formatted(turns, segment=segment)
    made.write.parquet(str(tmp_path / "out"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(chat.digests(kept)) == brute(rows)
    assert kept.where("conv_id = 7").selectExpr("segment >> 33 as p").distinct().count() > 1
    whole = kept.where("first and last")
    if segment > 1 << 19:
        assert whole.count() > 2500
    assert whole.count() == whole.select("conv_id").distinct().count()


def test_odd_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.formatted(none).count() == 0 and chat.digests(chat.formatted(none)).count() == 0
    long = "word " * 400_000
    rows = [(1, None, None, [text("a")]), (1, 0, "assistant", [text(None)]), (1, 0, "assistant", [text(long)]), (2, 5, "user", [text("b")]),
            (2, 5, "user", [text("b")]), (None, None, None, None)]
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({"segment": F.lit(1), "formatted": F.lit("x"), "_hash": F.lit(2.5), "last": F.lit(None)})
    got = {r.conv_id: r for r in chat.digests(chat.formatted(extra)).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {1: 3, 2: 2, None: 1}
    assert got[1].loss_chars == len(long) and got[None].turns_sha256 == sha("\n\n") and got[2].turns_sha256 == sha("user\nb\n" * 2)
