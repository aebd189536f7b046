import re
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
import pytest
import test_decontaminate
import test_mixing
import test_neardup
import test_pii
from tarnforge.llm import common, decontaminate, mixing, neardup, pii, registry, toxicity


def test_stages_in_turn(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "personal data", "mixing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("benchmark", "labels"))
    at, columns = docs, docs.columns
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        at = spark.createDataFrame(stage(spark, at, sf).collect(), (stage(spark, at, sf)).schema)
        seen.append(at)
    toxic, dedup, clean, masked, mixed = seen
    assert all(x.columns == columns for x in seen[:-1])
    assert {r.score < 0.5 for r in toxicity.toxicity(docs, labels).join(toxic.select("doc_id"), "doc_id").collect()} == {True}
    assert neardup.near_duplicates(dedup).where("not kept").count() == 0
    assert decontaminate.contamination(clean, bench).where("contaminated").count() == 0
    assert pii.personal_data(masked).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    want = {r.doc_id: r.copies for r in mixing.mixed(masked).where("kept").collect()}
    assert {r.doc_id: r.copies for r in mixed.collect()} == want
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, mixed.collect()))


def tables(spark, at, docs, labels, bench):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)


LABELS, BENCH = "doc_id long, quality int, toxic int", "item_id long, text string"
EDGES = [
    (1, None, "en", None, None), (2, "", None, "s", 0), (3, " \n\t ", "en", "s", 4), (None, "a b c d e f", "en", "s", 11), (None, None, None, None, None),
    (5, "write to a@b.cd now " * 3000, "en", "s", 60_000), (6, "same words in both of these", "en", "t", 27), (6, "same words in both of these", "en", "t", 27),
    (7, "same words in both of these", "en", "t", 27), (8, "card 4111 1111 1111 1111", "de", "t", 24),
]


@pytest.mark.parametrize("extra", [False, True])
def test_stages_with_nulls_repeats_and_clashing_columns(spark, tmp_path, extra):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        docs = docs.selectExpr("*", "1 as row", "'x' as spans", "2 as digest", "'y' as base", "3 as toxic", "4 as component_id", "5 as hash", "'z' as of")
    sf = tables(spark, tmp_path, docs, spark.createDataFrame([(2, 1, 0), (None, 1, 1), (5, None, None), (5, 1, 0)], LABELS), spark.createDataFrame([(1, None), (None, "no such words here at all"), (2, "")], BENCH))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns, name
        at, _ = common.cut(out)
    texts = sorted(((str(r.doc_id), r.text) for r in at.select("doc_id", "text").collect()), key=str)
    assert [i for i, _ in texts] == ["1", "2", "3", "5", "6", "6", "8", "None", "None"]
    assert dict(texts)["8"] == "card <CARD>" and "@" not in dict(texts)["5"]
    last = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert set(docs.columns) <= set(last.columns) and all(r.copies > 0 for r in last.collect())
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, last.collect()))


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    sf = tables(spark, tmp_path, docs, spark.createDataFrame([], LABELS), spark.createDataFrame([], BENCH))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_two_threads(spark, sf):
    """Runs side by side delete their own tables only."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    run = lambda _: sorted(map(str, neardup.near_duplicates(pii.redacted(docs)).collect()))
    with ThreadPoolExecutor(2) as pool:
        first, second = pool.map(run, range(2))
    assert first == second


def test_run_leaves_little(spark, sf):
    """Of a run's tables only those that its result reads are left."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(common.shared_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {x.getPath().getName() for x in files.listStatus(path)}
    common.cut(spark.range(1))
    before = names()
    corpus_pipeline.run(spark, sf)
    assert {n.split("-")[0] for n in names() - before} <= {"stage", "plan"} and len(names() - before) <= 2


def without_passages(text, items):
    """A text without its runs of hit words, and whether more than half of its words are hit: by definition."""
    plain = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    places = [m.span() for m in test_decontaminate.WORD.finditer(plain)]
    w, hit = [plain[a:b] for a, b in places], set()
    for own in items:
        k = min(10, len(own))
        grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(text[at : places[i][0]])
        at = places[i][1]
    return "".join(out) + text[at:], 2 * len(hit) > len(w)


def masked(text):
    spans = [(int(x[2].split(":")[1]), int(x[2].split(":")[2]), x[3]) for x in test_pii.brute(text)]
    spans += [(m.start(), m.end(), "secret") for m in re.finditer(r"(?<![A-Za-z0-9_+/=-])[0-9a-f]{40}(?![A-Za-z0-9_+/=-])", text)]
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [test_decontaminate.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    run = lambda f, d: spark.createDataFrame(f(spark, d, sf).collect(), docs.schema)

    low = run(corpus_pipeline.drop_toxic, docs)
    unique = run(corpus_pipeline.drop_near_duplicates, low)
    kept = {i for i, *_, k in test_neardup.brute([(r.doc_id, r.text) for r in low.collect()]) if k}
    assert {r.doc_id for r in unique.collect()} == kept and all(rows[r.doc_id] == r for r in unique.collect())

    clean = run(corpus_pipeline.cut_benchmark, unique)
    want = {i: without_passages(rows[i].text, items) for i in kept}
    assert {r.doc_id: r.text for r in clean.collect()} == {i: t for i, (t, most) in want.items() if not most}
    assert all(r.n_chars == (len(r.text) if r.text != rows[r.doc_id].text else rows[r.doc_id].n_chars) for r in clean.collect())

    private = run(corpus_pipeline.mask_personal_data, clean)
    assert {r.doc_id: r.text for r in private.collect()} == {r.doc_id: masked(r.text) for r in clean.collect()}

    drawn = {r.doc_id: r.copies for r in corpus_pipeline.mix_sources(spark, private, sf).collect()}
    left = [(r.doc_id, r.text, r.source) for r in private.collect()]
    copies = test_mixing.brute(left, sum(len(t.split()) for _, t, _ in left))
    assert drawn == {i: n for i, n in copies.items() if n}


def test_registered():
    assert "pipeline" in registry.QUERIES
    assert {int(k[2:].split("_")[0]) for k in registry.QUERIES if k.startswith("op")} == set(range(1, 11))


def test_sql_twins(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in registry.SQL.items():
        df, rel = registry.QUERIES[name](spark, sf), c.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        names = sorted(df.columns)
        assert sorted(map(tuple, df.select(names).collect())) == sorted(map(tuple, rel.select(*names).fetchall())), name
