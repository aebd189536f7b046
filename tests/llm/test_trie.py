import hashlib
import random
import zlib

import duckdb

from tarnforge.llm import registry, trie, twins

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node by walking every conversation; subtrees by comparing prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = turns if c % 5 == 0 else own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)

    def totals(n):
        leaves, saved, todo = 0, 0, [n]
        while todo:
            x = todo.pop()
            todo += children.get(x, [])
            leaves += x not in children
            saved += (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
        return leaves, saved

    out = []
    for n, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if len(made[c]) == len(n))))
        out.append((min(of), len(n), min(members[n[:-1]]) if n else None, len(of), len(children.get(n, [])), *totals(n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def asked(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(registry, "table", lambda *_: df)
    return sorted(repr(tuple(r)) for r in registry.op11(spark, "").collect())


def test_against_walking(spark, monkeypatch):
    random.seed(11)
    rows = []
    for c in range(230):
        form = random.randrange(12)  # conversations of one form are alike up to a turn
        differ = random.randrange(9)
        rows += [(c, t, ["user", "assistant"][t % 2], f"é{form} {t}" if t < differ else f"{c} {t}") for t in range(random.randrange(1, 9))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1090) for t in range(7)]  # copies of one conversation
    assert asked(spark, monkeypatch, rows) == brute(rows)


def test_edges(spark, monkeypatch):
    rows = [(None, 1, "user", "lost"), (0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, "assistant", "b"), (3, 5, "user", None), (11, 0, "user", "x")]
    rows += [(12, 0, "user", "x"), (20, 0, "u\n", "1:a"), (25, 0, "u", "\n1:a"), (30, 0, "user", "ß" * 200_000), (35, 0, "user", "ß" * 200_000)]
    want = brute(rows)
    assert asked(spark, monkeypatch, rows) == want
    assert asked(spark, monkeypatch, rows[1:2]) == brute(rows[1:2])
    assert asked(spark, monkeypatch, rows[:1]) == asked(spark, monkeypatch, []) == []


def test_extra_columns(spark):
    df = spark.createDataFrame([(0, 0, "user", "a", b"k", 1), (5, 0, "user", "a", b"k", 2)], SCHEMA + ", key binary, turns int")
    got = trie.trie(trie.turn_lists(df).withColumn("parent", trie.F.lit(1))).orderBy("depth").collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.saved_tokens) for r in got] == [(0, 0, 2, 1), (0, 1, 2, 1)]


def test_pieces_of_a_list(spark, monkeypatch):
    """Ids that end at one node come from many tasks; their digest is that of the whole list, in order."""
    rows = [(5 * i, 0, "user", "same") for i in range(3000)] + [(5 * i, 1, "user", "more") for i in range(0, 3000, 3)]
    assert asked(spark, monkeypatch, rows) == brute(rows)
    monkeypatch.setattr(trie, "PIECE", 7)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"key": b"a", "conv_id": i} for i in range(30)] + [{"key": b"b", "conv_id": 4}])
    pieces = [x.select(["key", "ids"]) for x in trie._joined(iter([batch]))]
    assert len(pieces) == 6
    found = {k: v for b in trie._hashed(iter(pieces)) for k, v in zip(*(c.to_pylist() for c in b.columns))}
    assert found == {b"a": hashlib.sha256(",".join(map(str, range(30))).encode()).hexdigest(), b"b": hashlib.sha256(b"4").hexdigest()}


def test_sql_twin(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = c.sql(twins.TRIE)
    got = registry.op11(spark, sf).select(*want.columns)
    rows = sorted(repr(tuple(r)) for r in got.collect())
    assert rows == sorted(map(repr, want.fetchall())) == brute(c.sql("select conv_id, turn, role, text from conversations").fetchall())
