import hashlib
import random

import duckdb
import pandas as pd

from tarnforge.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    out, sha = {}, lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        learnt = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learnt), sha(learnt))
    return out


def check(df, rows):
    made = chat.formatted(df)
    assert all(r.formatted == "".join(s.piece for s in r.segments) for r in made.collect())
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(made).collect()}
    assert got == brute(rows)


def test_conversations_with_injection(spark, sf):
    df = chat.with_injection(spark.read.parquet(f"{sf}/conversations.parquet"))
    check(df, [tuple(r) for r in df.collect()])


def test_escapes_merges_and_edges(spark):
    random.seed(5)
    bits = ["<|", "|>", "\\", "<", "|", "<|im_end|>", "<|im_start|>", "assistant", "<|im_sep|>", "<|im_next|>", "\n", "é😀", "$1", "", "<\\|"]
    rows = [(i % 40, random.randrange(6), random.choice(["user", "assistant", "system", "a<|b", "x\n\\", None]), random.choice([None, "".join(random.choices(bits, k=6))])) for i in range(600)]
    rows += [(None, None, None, None), (100, 1, "assistant", "x" * 100_000), (101, None, "user", "a"), (101, 0, "user", "b"), (101, 0, "user", "b")]
    check(spark.createDataFrame(rows, SCHEMA), rows)
    merged = chat.formatted(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], SCHEMA)).first().formatted
    assert merged == "<|im_start|>user<|im_sep|>a<|im_next|>b<|im_end|><|im_start|>assistant<|im_sep|>c<|im_end|>"
    assert chat.read_back(chat.formatted(spark.createDataFrame([], SCHEMA))).collect() == []


def test_long_conversation_is_linear(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(20_000)]
    check(spark.createDataFrame(rows, SCHEMA), rows)


def test_sql_twin(spark):
    rows = [(1, 0, "user", "a\\<|b"), (1, 1, "user", "b"), (1, 2, "assistant", "<|"), (2, 0, "system", "é😀")]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    want = {tuple(r) for r in duckdb.sql(chat.SQL).fetchall()}
    assert {tuple(r) for r in chat.read_back(chat.formatted(chat.with_injection(spark.createDataFrame(rows, SCHEMA)))).collect()} == want
