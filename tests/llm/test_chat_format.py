"""Chat formatting: exact round trip, merging, loss mask, edge rows."""

import hashlib
import random

from pyspark.sql import functions as F

from retailcast.llm import chat_format as C
from retailcast.llm.queries import op9_chat_format

NASTY = ["</s>", "[INST]", "[/INST]", "[\\INST]", "<\\\\/s>", "ends with [INST", "<", "</", "\\", "[/INST]INST]",
         "INST]", "/s>", "", None, "[[INST]]", "</s></s>[INST][/INST]", "a\nb\x00c", "<<\\/s>>", "\\[INST]\\"]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, pieces string"


def read_back(df):
    out = df.select("conv_id", "formatted", C.read_turns(F.col("formatted")).alias("turns"),
                    C.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss, r.formatted) for r in out}


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], t, "x", "x") for i, t in enumerate(NASTY)]
    rows += [(2, i, t, t, "x", "x") for i, t in enumerate(NASTY)]             # control strings as roles
    rows += [(c + 10, i, ["assistant", "user"][(i >> c) % 2], t, "x", "x") for c in range(4) for i, t in enumerate(NASTY)]
    got = read_back(C.format_conversations(spark.createDataFrame(rows, SCHEMA)))
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert got[conv][0] == own
        assert got[conv][1] == "".join(t for role, t in own if role == "assistant")


def test_adjacent_turns_of_one_role_share_a_block(spark):
    rows = [(1, 0, "user", "a", "", ""), (1, 1, "user", "b", "", ""), (1, 2, "assistant", "c", "", ""),
            (1, 3, "assistant", "d", "", "")]
    got = read_back(C.format_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert got[1][2] == "[INST]user[/INST]a</s>b</s>[INST]assistant[/INST]c</s>d</s>"
    assert got[1][1] == "cd"


def test_nulls_ties_repeats_and_empty_table(spark):
    rows = [(None, 0, "user", "x", "", ""), (1, None, None, None, "", ""), (1, 1, "user", "b", "", ""),
            (1, 1, "user", "a", "", ""), (1, 1, "user", "a", "", "")]
    got = read_back(C.format_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert got[1][0] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None][0] == [("user", "x")]
    assert C.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_reads_back_the_trap(spark):
    row = op9_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    turns = "".join(f"{r}\n{text}\n" for r in ("user", "assistant"))
    assert (row.n_turns, row.loss_chars) == (2, len(text))
    assert row.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(0, 9) for _ in range(n)]) for i, n in enumerate((0, 1, 2, 127, 128, 129, 300, 1000))]
    df = spark.createDataFrame(rows, "i int, x array<bigint>").select("i", C.running_sums(F.col("x")).alias("s"))
    for r in df.collect():
        xs = rows[r.i][1]
        assert r.s == [sum(xs[:k]) for k in range(len(xs))]


def test_spans_of_odd_characters(spark):
    texts = ["﻿mark first", "\U0001f600 astral", "", "é́", "﻿", "[INST] \\ </s>", "日本"]
    rows = [(1, i, "assistant" if i % 2 == 0 else "user", t, "", "") for i, t in enumerate(texts)]
    got = read_back(C.format_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert got[1][1] == "".join(texts[::2])


def test_long_conversations_in_proportion_to_their_turns(spark):
    import time

    def seconds(n, adjacent):
        df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", f"IF(id % {2 * adjacent} < {adjacent}, 'user', "
                                       "'assistant') AS role", "concat('text ', id) AS text")
        start = time.time()
        row = C.format_conversations(df).select(
            C.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
            F.size(C.read_turns(F.col("formatted"))).alias("n")).first()
        assert row.n == n
        assert row.loss == "".join(f"text {i}" for i in range(n) if i % (2 * adjacent) >= adjacent)
        return time.time() - start

    for adjacent in (1, 5000):
        seconds(2000, adjacent)
        short, long = seconds(10000, adjacent), seconds(40000, adjacent)
        assert long < 7 * short + 2, (adjacent, short, long)
