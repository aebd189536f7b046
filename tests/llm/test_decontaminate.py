import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnforge.llm import decontaminate
from tarnforge.llm.decontaminate import Automaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, own in items:
        k = min(window, len(own))
        if not k:
            continue
        grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                if item is not None:
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", max_size=9), max_size=6), st.text("abcd", max_size=30), st.integers(1, 4))
def test_automaton(items, text, window):
    named = [(str(i), list(x)) for i, x in enumerate(items)]
    spans, found = Automaton(named, window).scan(list(text))
    hit, want = set(), set()
    for name, own in named:
        k = min(window, len(own))
        for i in range(len(text) - k + 1):
            if k and any(list(text[i : i + k]) == own[j : j + k] for j in range(len(own) - k + 1)):
                hit |= set(range(i, i + k))
                want.add(name)
    assert {i for a, b in spans for i in range(a, b)} == hit and found == want
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("max_words", [500_000, 300])
def test_documents(spark, sf, max_words):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(str(r.item_id), words(r.text)) for r in bench.collect()]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, bench, max_words=max_words).collect())
    assert got == sorted((r.doc_id, *brute(r.text, items)) for r in docs.collect())
    assert any(x[-1] for x in got) and not all(x[-1] for x in got)


def test_edges(spark):
    random.seed(3)
    item = " ".join(f"w{i}" for i in range(25))
    bench = [(10, item), (9, "Short item"), (2, ""), (None, "é è ü"), (3, None), (10, item), (7, "one")]
    texts = [None, "", "...", item.upper() + "!", "x short, ITEM y", "É è ü", "é è ü", "w0 w1 w2 w3 w4 w5 w6 w7 w8", " ".join(item.split()[5:16]), "one " * 50_000, "a_one b-one"]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, item, None), (3, item, "k")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = [(None if i is None else str(i), words(t)) for i, t in bench]
    got = sorted(((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(d, b).collect()), key=str)
    assert got == sorted(((i or -1, *brute(t, items)) for i, t, _ in rows), key=str)
    assert decontaminate.contamination(d.limit(0), b).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(d, b.limit(0)).collect())


def test_decontaminated(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rest = " ".join(f"r{i}" for i in range(20))
    rows = [(1, f"A. {item}, b {rest}", 9), (2, item + " x", 9), (3, rest, 9), (4, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.decontaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    clean = f"A. , b {rest}"
    assert out == {1: (clean, len(clean)), 3: (rest, 9), 4: (None, None)}


def test_decontaminated_by_several_automata(spark, sf):
    """Parts of a benchmark in turn give what one automaton gives; null texts, copies and clashing columns included."""
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    odd = spark.createDataFrame([(None, None, None, None, 1), (7, "", None, None, 0), (7, "", None, None, 0)], docs.schema)
    hot = docs.where("text is not null").limit(1).crossJoin(spark.range(300)).drop("id")
    docs = docs.unionByName(odd).unionByName(hot).withColumnsRenamed({"lang": "digest", "source": "spans"})
    whole = sorted(map(tuple, decontaminate.decontaminated(docs, bench).collect()), key=str)
    assert sorted(map(tuple, decontaminate.decontaminated(docs, bench, max_words=300).collect()), key=str) == whole
    assert decontaminate.decontaminated(docs.limit(0), bench, max_words=300).collect() == []
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == docs.count()


def test_parts_hold_all_items(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    groups, parts = decontaminate._groups(bench, 300)
    sizes = groups.groupBy("part").count().collect()
    assert parts > 3 and len(sizes) <= parts and sum(r["count"] for r in sizes) == bench.count()
    assert sum(len(decontaminate._sent(groups, p).value[1]) for p in range(parts)) == bench.count()
