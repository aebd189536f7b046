import math
import re
import struct
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tarnforge.llm import mixing


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def weights(tokens, budget, evenness=mixing.EVENNESS, max_epochs=mixing.MAX_EPOCHS):
    """Weights by source and the exponent, by plain bisection."""
    total = sum(tokens)
    shares = [n / total if total else 0.0 for n in tokens]

    def at(a):
        raised = [s**a if s > 0 else 0.0 for s in shares]
        return [r / sum(raised) if sum(raised) else 0.0 for r in raised]

    goal = (1 - evenness) * entropy(shares) + evenness * math.log(max(sum(n > 0 for n in tokens), 1))

    def too_far(a):
        return entropy(at(a)) > goal or any(x * budget > max_epochs * n for x, n in zip(at(a), tokens, strict=True))

    if not too_far(0.0):
        return at(0.0), 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if too_far(mid) else (low, mid)
    return at(high), high


def found(spark, tokens, budget, **options):
    return mixing.exponent(spark.createDataFrame([(n,) for n in tokens], "tokens long"), budget, **options)


def test_exponent(spark):
    for tokens, budget, options in (
        ([1000, 100, 10, 0], 1110, {"evenness": 0.3, "max_epochs": 100}),
        ([1000, 100, 10, 0], 1110, {"evenness": 1.0}),
        ([7, 30, 500, 500, 2000], 1000, {"evenness": 0.9}),
        ([5, 5], 10, {}),
        ([8], 3, {}),
    ):
        a, z = found(spark, tokens, budget, **options)
        w, want = weights(tokens, budget, **options)
        got = [(n / sum(tokens)) ** a / z if n else 0.0 for n in tokens]
        assert got == pytest.approx(w, abs=1e-9) and (len({*tokens} - {0}) == 1 or a == pytest.approx(want, abs=1e-9))
        assert sum(got) == pytest.approx(1) and all(x * budget <= options.get("max_epochs", 2.0) * n + 1e-6 for x, n in zip(got, tokens))
    assert found(spark, [0], 0) == (1.0, 0.0)
    goal = 0.7 * entropy([1000 / 1110, 100 / 1110, 10 / 1110]) + 0.3 * math.log(3)
    a, z = found(spark, [1000, 100, 10], 1110, max_epochs=100)
    assert entropy([(n / 1110) ** a / z for n in (1000, 100, 10)]) == pytest.approx(goal)


def test_budget_beyond_the_limit(spark):
    with pytest.raises(ValueError):
        found(spark, [1, 3], 20)
    df = spark.createDataFrame([(i, "a b", f"s{i % 2}") for i in range(40)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.mixed(df, budget=161)
    assert {r.copies for r in mixing.mixed(df, budget=160).collect()} == {2}


def check_draws(rows, out):
    """Draws are as many as copies; in each epoch a source's blocks come one after the other, in another order each time."""
    sequence = defaultdict(list)
    for r in out:
        assert len(r.draws) == r.copies and [d.epoch for d in r.draws] == list(range(r.copies))
        assert all(0 <= d.progress <= 1 for d in r.draws)
        for d in r.draws:
            sequence[r.source or "", d.epoch].append((d.progress, d.block))
    orders = defaultdict(set)
    for (s, _), seen in sequence.items():
        seen.sort()
        blocks = [b for k, (_, b) in enumerate(seen) if k == 0 or seen[k - 1][1] != b]
        assert len(blocks) == len(set(blocks))
        orders[s].add(tuple(blocks))
    for s in orders:
        epochs = sorted(e for t, e in sequence if t == s)
        assert all(max(sequence[s, e])[0] <= min(sequence[s, e + 1])[0] for e in epochs[:-1])
        full = [o for o in orders[s] if len(o) == max(map(len, orders[s]))]
        assert len(epochs) < 3 or len(full[0]) < 6 or len(full) > 1


def check(rows, out, budget, longest):
    """Tokens by source meet the weights; every row once or more in each whole pass."""
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total, drawn, weight, copies = defaultdict(int), defaultdict(int), {}, defaultdict(set)
    for i, _, s in rows:
        total[s or ""] += n[i]
    for r in out:
        assert r.n_tokens == n[r.doc_id] and r.kept == (r.copies > 0)
        drawn[r.source or ""] += r.copies * r.n_tokens
        weight[r.source or ""] = r.weight
        if r.n_tokens:
            copies[r.source or ""].add(r.copies)
    want = dict(zip(total, weights(list(total.values()), budget)[0]))
    for s in total:
        assert weight[s] == pytest.approx(want[s])
        assert int(want[s] * budget + 0.5) - longest < drawn[s] <= int(want[s] * budget + 0.5)
        assert len(copies[s]) <= 2 and (not copies[s] or max(copies[s]) - min(copies[s]) <= 1)


def spark_hash(*values):
    """Spark's xxhash64 of longs, ints (given as tuples) and strings."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - 2**64 if h >= 2**63 else h


def brute(rows, budget, seed=3):
    """Copies by doc_id: all documents of a source in the order of their blocks, then their own, until the room is filled."""
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    own = defaultdict(list)
    for i, _, s in rows:
        own[s].append(i)
    total = {s: sum(n[i] for i in ids) for s, ids in own.items()}
    copies = {}
    for s, w in zip(total, weights(list(total.values()), budget)[0]):
        quota = int(w * budget + 0.5)
        epochs, room = divmod(quota, total[s])
        blocks = -(-len(own[s]) // mixing.BLOCK_DOCS)

        def place(i):
            h = spark_hash(i, (seed,))
            return spark_hash(s, h % blocks, epochs, (seed,)), spark_hash(h, epochs, (seed,)), h

        for i in sorted(own[s], key=place):
            room -= n[i]
            copies[i] = epochs + (room >= 0)
            if room < 0:
                room = -math.inf
    return copies


def test_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t, _ in rows]
    for budget in (None, sum(size) // 3, sum(size) * 2 - 5):
        out = mixing.mixed(docs, budget).collect()
        assert len(out) == len(rows)
        check(rows, out, budget or sum(size), max(size) + 1)
        assert {r.doc_id: r.copies for r in out} == brute(rows, budget or sum(size))
        check_draws(rows, out)


def test_many_sources(spark, sf, monkeypatch):
    """A plan that is too long to broadcast gives the same mixture."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    want = sorted(map(tuple, mixing.mixed(docs).select("doc_id", "copies", "draws").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mixed(docs).select("doc_id", "copies", "draws").collect())) == want
    monkeypatch.undo()
    many = spark.range(30_000).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 as int)) as text", "concat('s', id % 25000) as source")
    out = mixing.mixed(many)
    assert out.count() == 30_000 and out.agg({"copies": "max"}).first()[0] <= 2


def test_edges(spark):
    rows = [(i, None if i % 7 == 0 else "w " * (i % 5), None if i % 3 == 0 else f"s{i % 3}") for i in range(200)] + [(500, " ", "empty"), (501, None, "empty")]
    df = spark.createDataFrame([(*r, 1, "x", 5, "y") for r in rows], "doc_id long, text string, source string, weight int, block string, _mix_tokens int, row string")
    out = mixing.mixed(df)
    assert out.columns == ["doc_id", "text", "source", "block", "_mix_tokens", "row", "n_tokens", "weight", "copies", "draws", "kept"]
    check(rows, out.collect(), sum(len((t or "").split()) for _, t, _ in rows), 6)
    assert mixing.mixed(df.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")], "doc_id long, text string, source string")
    assert [r.copies for r in mixing.mixed(twice).collect()] == [1, 1, 1]


def test_same_bits_in_any_order(spark):
    """Rows dealt and ordered otherwise give the same weights, copies and draws, to the last bit."""
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 173}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = set()
    for x in (df, df.repartition(7), df.orderBy(F.desc("doc_id")), df.repartition(3, "source"), df.orderBy(F.xxhash64("doc_id")).coalesce(1), df.repartition(29, F.rand(3))):
        out = mixing.mixed(x)
        seen.add(tuple(sorted((r.doc_id, r.weight.hex(), r.copies, repr(r.draws)) for r in out.collect())))
    assert len(seen) == 1 and len({w for _, w, *_ in next(iter(seen))}) > 50
    shares = [{mixing.exponent(spark.createDataFrame([(n,) for n in order], "tokens long").repartition(k), 10_000) for k in (1, 3, 8)} for order in (range(1, 400), range(399, 0, -1))]
    assert len(shares[0] | shares[1]) == 1
