import hashlib
import random

import duckdb
import pytest

from tarnforge.llm import registry, repeats, twins

SCHEMA = "doc_id long, text string"


def brute(rows, size=100):
    """Every string of ``size`` bytes with its earliest place; rows of one id are one document."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: (i is not None, i or 0)
    for i, t in texts:
        for s in range(len(t) - size + 1):
            g, at = t[s : s + size], (rank(i), s)
            if first.get(g, at) >= at:
                first[g] = at
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - size + 1):
            if first[t[s : s + size]] < (rank(i), s):
                gone[s : s + size] = b"\1" * size
        kept = bytes(b for b, x in zip(t, gone) if not x)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def asked(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(registry, "table", lambda *_: df)
    return sorted(repr(tuple(r)) for r in registry.op12(spark, "").collect())


def corpus(seed):
    """Words, shared passages with changed letters, copies, runs of one letter, periods, and many short texts around one passage."""
    random.seed(seed)
    text = lambda n: "".join(random.choices("abcdeé ", k=n))
    passages = [text(random.randrange(90, 400)) for _ in range(12)]
    common = text(130)
    rows = []
    for i in range(160):
        parts = []
        for _ in range(random.randrange(5)):
            p = random.choice(passages)
            if random.random() < 0.4:
                k = random.randrange(len(p))
                p = p[:k] + random.choice(["", "x", "yz"]) + p[k + 1 :]
            parts += [p, text(random.randrange(60))]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, text(random.randrange(30)) + common + text(random.randrange(30))) for i in range(120)]
    rows += [(400 + i, rows[5][1]) for i in range(40)]
    rows += [(500, "z" * 700), (501, "z" * 150 + "q"), (502, "ab" * 300), (503, "é" * 120), (504, "")]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("together", [50_000, 3])
def test_against_all_strings(spark, monkeypatch, together):
    """Crowds of runs around one anchor are compared by window under their own keys, with the same result."""
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rows = corpus(together)
    assert asked(spark, monkeypatch, rows) == brute(rows)


def test_shuffled_places(spark, monkeypatch):
    """Places too many to send to the texts."""
    monkeypatch.setattr(repeats, "SENT_BYTES", 0)
    rows = corpus(9)
    assert asked(spark, monkeypatch, rows) == brute(rows)


def test_edges(spark, monkeypatch):
    random.seed(4)
    a, b = ("".join(random.choices("abcdefgh", k=300)) for _ in range(2))
    rows = [(1, None), (2, ""), (3, "x" * 99), (3, "x" * 99), (4, "x" * 100), (5, a), (5, a), (5, "!" + a), (5, b + a), (None, b), (None, b), (6, b[:150]), (-7, a[:200])]
    assert asked(spark, monkeypatch, rows) == brute(rows)
    assert asked(spark, monkeypatch, rows[:1]) == brute(rows[:1])
    assert asked(spark, monkeypatch, []) == []
    same = [(9, a)] * 50  # repeated rows alone
    assert asked(spark, monkeypatch, same) == brute(same)


def test_long_text_in_pieces(spark, monkeypatch):
    random.seed(6)
    part = "".join(random.choices("abcdefghijk ", k=5000))
    fill = "".join(random.choices("abcdefghijk ", k=repeats.BLOCK - 2500))
    rows = [(1, fill + part), (2, "start " + part[2000:] + " end"), (3, fill[-3000:] + part[:2600])]
    assert asked(spark, monkeypatch, rows) == brute(rows)


def test_family_merges_geometrically(spark):
    """Two arrays of one level become one of the next before a batch comes; batches may come in any order of ids."""
    random.seed(8)
    rows = corpus(8)
    df = spark.createDataFrame(rows, SCHEMA)
    family = repeats.Family(spark, 4)
    levels = []
    for k in (3, 0, 7, 5, 1, 2, 6, 4):
        family.add(df.where(f"doc_id % 8 = {k}"))
        levels.append([level for _, level in family.runs])
    assert levels == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0], [2, 0, 0], [2, 1, 0], [2, 1, 0, 0]]
    found = {(r.doc, x, y) for r in family.repeats(df).collect() for x, y in zip(r.starts, r.stops)}
    family.close()
    want = {(r.doc_id, x, y) for r in repeats.without_repeats(df).collect() for x, y in zip(r.starts, r.stops)}
    assert found == want


def test_no_shuffle_of_the_levels(spark):
    df = spark.createDataFrame(corpus(2), SCHEMA)
    family = repeats.Family(spark, 4)
    family.add(df.where("doc_id < 100"))
    family.add(df.where("doc_id >= 100"))
    plan = family._scanned(2)._jdf.queryExecution().executedPlan().toString()
    family.close()
    assert "Exchange" not in plan and "Bucketed: true" in plan


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "a" * 120, 5, "k", 7)], SCHEMA + ", starts int, doc string, mark int")
    got = repeats.without_repeats(df).first()
    assert (got.doc, got.mark, got.starts, got.stops, bytes(got.kept_bytes)) == ("k", 7, [1], [120], b"a")


def test_sql_twin(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.sql(twins.REPEATS)
    got = registry.op12(spark, sf).select(*want.columns)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want.fetchall()))
