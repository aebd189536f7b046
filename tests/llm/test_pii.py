import hashlib
import random
import re

import numpy as np
import pytest

from tarnforge.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for place, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 14 <= len(d) <= 19 and kind == "card" and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(out)


def check(df, rows):
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in df.collect()), key=str)
    want = []
    for i, t in rows:
        b = brute(t)
        want.append((i, *(sum(x[3] == k for x in b) for k in BASE), hashlib.sha256(",".join(x[2] for x in b).encode()).hexdigest()))
    assert [x[:6] for x in got] == sorted(want, key=str)
    for x in got:
        texts = dict(rows)[x[0]]
        assert {b[2] for b in brute(texts)} <= set(x[6].split(","))
    return {x[0]: x[6] for x in got}


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    spans = check(pii.personal_data(docs), rows)
    for i, t in rows:
        for m in re.finditer(r'token = "([0-9a-f]{40})"', t):
            assert f"secret:{m.start(1)}:{m.end(1)}" in spans[i].split(",")


CASES = [
    "a@b.c@d.e f@g.h-i_x@y.zz a@b a@b.c. x@y..z é@b.co é.q@ü.de",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3.4 999999999999999999999.1.1.1 1.1.1.1.2.2.2.2",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111111 4111  1111",
    "+1 (974) 555-3436 +1234567890123456 ++4930123456789 +1((((0 +12",
    "😀 a@b.cd 😀😀 1.2.3.4 ١٢٣٤ ４111",
    "x" * 50_000 + "@y.z",
    "1" * 30_000,
    "1." * 20_000,
    "a." * 30_000 + "@b" + ".c" * 20_000,
    "+1" + "-" * 30_000 + "2345678901",
    "\x00\x01 a@b.cd \U0010ffff",
    "",
    None,
    "\n a@b.c\n\n1.2.3.4\n",
]


def test_edges(spark):
    rows = list(enumerate(CASES))
    check(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_repeats_nulls_other_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "x"), (1, "a@b.cd", "x"), (None, "1.2.3.4", None)], "doc_id long, text string, _pii_base string")
    assert sorted(r.spans for r in pii.personal_data(df).collect()) == ["email:0:6", "email:0:6", "ip:0:7"]
    assert pii.personal_data(df.limit(0)).collect() == []


def test_redacted_edges(spark):
    """Clashing column names, null ids, repeated rows, long texts and an empty table."""
    rows = [(1, "a@b.cd", "x", 1, "r"), (1, "a@b.cd", "x", 1, "r"), (None, None, None, None, None), (2, "", "y", 2, ""), (3, "w " * 100_000 + "1.2.3.4", "z", 3, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _pii_base string, spans int, row string")
    want = [(1, "<EMAIL>", "x", 1, "r")] * 2 + [(None, None, None, None, None), (2, "", "y", 2, ""), (3, "w " * 100_000 + "<IP>", "z", 3, "s")]
    out = pii.redacted(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert pii.redacted(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, "a@b.cd", "k")], ["doc_id", "text", "a.b"])
    assert tuple(pii.redacted(odd).first()) == (1, "<EMAIL>", "k")


def test_redacted(spark, sf):
    docs = spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4!", "k", 23), (2, None, None, None), (3, "plain", "k", 5), (4, "é 😀 x@y.zz", "k", 10)], "doc_id long, text string, email string, n_chars long")
    out = {r.doc_id: tuple(r) for r in pii.redacted(docs).collect()}
    assert out[1] == (1, "mail <EMAIL> or <IP>!", "k", 21)
    assert out[2] == (2, None, None, None) and out[3][1] == "plain" and out[4] == (4, "é 😀 <EMAIL>", "k", 11)
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    clean = pii.redacted(whole)
    assert clean.schema == whole.schema or clean.columns == whole.columns
    assert all(not brute(r.text) for r in clean.collect())


def test_estimate_tells_good_labelers():
    post = pii.estimate({"card:+++00q": 50, "card:+0+00q": 20, "card:-0000n": 200, "card:-+000n": 60})
    assert post["card:+++00q"] > 0.9 and post["card:-0000n"] < 0.2
    assert pii.estimate({}) == {}
    lookalikes = pii.estimate({"card:++0+2n": 160, "card:-+0+2n": 60, "card:--0+2n": 100, "card:--000n": 900})
    assert lookalikes["card:++0+2n"] > 0.9 and lookalikes["card:-+0+2n"] < 0.5


def brute_estimate(counts):
    """The posteriors of one kind by the formulas, over arrays of votes."""
    keys, n = list(counts), np.array(list(counts.values()), float)
    votes = np.array([["+-0".index(v) for v in k[:4]] for k in keys])
    post = 1 / (1 + np.exp(-1.5 * ((votes == 0).sum(1) - (votes == 1).sum(1))))
    prior = np.array([[1.0, 6.0, 3.0], [6.0, 1.0, 3.0]])  # by class, counts of +, - and 0
    for _ in range(50):
        weight = np.stack([n * (1 - post), n * post])
        rates = np.stack([[prior[c] + [weight[c][votes[:, i] == v].sum() for v in range(3)] for i in range(4)] for c in (0, 1)])
        rates /= rates.sum(-1, keepdims=True)
        share = (2 + weight[1].sum()) / (4 + n.sum())
        z = np.log(share / (1 - share)) + sum(np.log(rates[1, i, votes[:, i]] / rates[0, i, votes[:, i]]) for i in range(4))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    weight = np.stack([n * (1 - post), n * post])
    z = np.full(len(keys), np.log((1 + weight[1].sum()) / (1 + weight[0].sum())))
    for place in range(6):
        own = np.array([k[place] for k in keys])
        seen = sorted(set(own))
        table = np.array([[1 + weight[c][own == v].sum() for v in seen] for c in (0, 1)])
        table /= table.sum(1, keepdims=True)
        z += np.log(table[1] / table[0])[[seen.index(v) for v in own]]
    return dict(zip(keys, 1 / (1 + np.exp(-np.clip(z, -30, 30))), strict=True))


def test_estimate_against_arrays():
    draw = random.Random(4)
    counts = {"".join(draw.choice("+-0") for _ in range(4)) + draw.choice("0123") + draw.choice("qn"): draw.randint(1, 400) for _ in range(60)}
    got = pii.estimate({f"phone:{k}": c for k, c in counts.items()} | {"ssn:+0+00n": 4})
    for k, p in brute_estimate(counts).items():
        assert got[f"phone:{k}"] == pytest.approx(p, abs=1e-9)


def test_decisions_on_planted_spans(spark):
    """Spans beyond the base, true and false ones, over texts in which they are planted."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(3, 8)))
    hexed = lambda n: "".join(draw.choices("0123456789abcdef", k=n))
    true = [lambda: ("secret", 'token = "', hexed(40)), lambda: ("ssn", "social security ", f"{draw.randint(100, 600)}-{draw.randint(10, 99)}-{draw.randint(1000, 9999)}")]
    false = [lambda: ("secret", "", "".join(draw.choices("abcdefghij", k=25))), lambda: ("ssn", "invoice ", f"000-{draw.randint(10, 99)}-{draw.randint(1000, 9999)}")]
    rows, good, bad = [], {}, {}
    for i in range(300):
        kind, lead, span = draw.choice(true if i % 2 else false)()
        before = " ".join(word() for _ in range(6)) + " " + lead
        rows.append((i, f"{before}{span} {word()}"))
        (good if i % 2 else bad)[i] = f"{kind}:{len(before)}:{len(before) + len(span)}"
    spans = {r.doc_id: r.spans.split(",") for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(x in spans[i] for i, x in good.items()) >= 0.95 * len(good) and sum(x in spans[i] for i, x in bad.items()) <= 0.05 * len(bad)


@pytest.mark.parametrize("text", ["token = '0123456789abcdef0123456789abcdef01234567'"])
def test_secret_alone(spark, text):
    assert pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans == "secret:9:49"
