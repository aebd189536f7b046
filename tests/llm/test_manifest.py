import hashlib
import string
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnforge.llm import manifest, registry, twins

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    """The run around a node at each level, and its place in it."""
    out = []
    for level in levels[:-1]:
        out.append((level[i // 16 * 16 : i // 16 * 16 + 16], i % 16))
        i //= 16
    return out


def brute(rows):
    """Rows as doc_id, source, lang, n_chars, text; what the query returns of each."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s, x in by.items()}
    trees = {s: tree([leaf(r) for r in x]) for s, x in order.items()}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(order[s]):
            runs = path(trees[s], i) + path(top, k)
            proof = "".join(x for run, p in runs for x in run[:p] + run[p + 1 :])
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
            at = leaf((*r[:4], text))
            for run, p in runs:
                at = sha(*run[:p], at, *run[p + 1 :])
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(proof), at, at == top[-1][0]))
    return sorted(map(repr, out))


def asked(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(registry, "table", lambda *_: df)
    return sorted(repr(tuple(r)) for r in registry.op13(spark, "").collect())


def test_superblocks_of_a_hot_source(spark, monkeypatch):
    """One source over several superblocks, with a last run of one, and very many small ones."""
    rows = [(i * 7 % 9001, "hot", "en", i, f"Text {i}") for i in range(2 * manifest.SPAN + 1)]
    rows += [(i, f"s{i % 300}", None, None, "É" * (i % 5)) for i in range(700)]
    assert asked(spark, monkeypatch, rows) == brute(rows)


def test_edges(spark, monkeypatch):
    rows = [(1, "a", "en", 1, "X"), (1, "a", "en", 1, "X"), (1, "a", "de", 2, "Y"), (None, "a", None, None, None), (2, None, None, None, ""), (3, "", "", 0, "A" * 200_000)]
    rows += [(-4, "", "en", 1, "Ä"), (0, "é", "en", 1, "-"), (0, "z", "en", 1, "1:a"), (5, "Z", None, 2, "B")]
    assert asked(spark, monkeypatch, rows) == brute(rows)
    assert asked(spark, monkeypatch, rows[:1]) == brute(rows[:1])
    assert asked(spark, monkeypatch, []) == []


def test_extra_columns(spark):
    """Columns of any name come back; those named like the results are replaced."""
    df = spark.createDataFrame([(1, "a", "x", 7, "k", "i", "n", "p")], "doc_id long, source string, leaf string, root long, key string, i string, n string, pack string")
    got = manifest.manifest(df).first()
    assert (got.leaf, got.subroot, got.root, got.key, got.i, got.n, got.pack, got.left) == ("x", "x", "x", "k", "i", "n", "p", [])


def test_proofs_find_changed_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fields = {c: F.col(c) for c in manifest.FIELDS}
    other = fields | {"text": F.concat("text", F.lit("."))}
    found = manifest.manifest(docs.select("doc_id", "source", manifest.leaf(fields).alias("leaf"), manifest.leaf(other).alias("other")))
    good, bad = (found.where(manifest.folded(F.col(c), F.col("left"), F.col("right")) == F.col("root")).count() for c in ("leaf", "other"))
    assert (good, bad) == (docs.count(), 0)


@pytest.mark.parametrize("text", ["0", "7", "12345", "-3"])
def test_crc(text):
    assert duckdb.sql(f"select {twins.crc32(repr(text))}").fetchall()[0][0] == zlib.crc32(text.encode())


def test_sql_twin(spark, sf):
    c = duckdb.connect()
    for p in Path(sf).glob("documents.parquet"):
        c.execute(f"create view documents as select * from '{p}'")
    want = c.sql(twins.MANIFEST)
    got = registry.op13(spark, sf).select(*want.columns)
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want.fetchall()))
