import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tarnforge.llm import common, tokens


def counts(texts, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(sp.encode(t)) for t in texts]
    return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_documents_and_cache(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    kept = common.fresh(spark, "cache")
    want = sorted((r.doc_id, len(r.text.encode()), n, n > 4096) for r, n in zip(rows, counts([r.text for r in rows], name), strict=True))
    half = docs.where("doc_id % 2 = 0")
    assert sorted(map(tuple, tokens.token_counts(half, public_tokenizers.path(name), kept).collect())) == [x for x in want if x[0] % 2 == 0]
    before = spark.read.parquet(kept).count()
    assert before == len({r.text for r in rows if r.doc_id % 2 == 0})
    assert sorted(map(tuple, tokens.token_counts(docs, public_tokenizers.path(name), kept).collect())) == want
    assert spark.read.parquet(kept).count() == len({r.text for r in rows})


def test_normal_form_keeps_the_count(spark, sf):
    """Texts of one normal form share a row of the cache, and each has the count that the library gives it by itself."""
    texts = ["The  cat", "the cat", "THE CAT", "the cat ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|> The", "a<|EndOfText|>b", "Été", "E\u0301te\u0301", "ﬁ", "fi", "", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        path, kept = public_tokenizers.path(name), common.fresh(spark, "cache")
        got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, path, kept).collect()}
        assert [got[i] for i in range(len(texts))] == counts(texts, name), name
        assert spark.read.parquet(kept).count() == len({tokens._normaliser(path)(t) for t in texts})
    path = public_tokenizers.path("word_bpe_49k.json")
    same = tokens._normaliser(path)
    assert same("The  cat") == same("the cat") and same("<|ENDOFTEXT|>") != same("<|endoftext|>")


def test_hot_digests(spark):
    """Copies that are most of the rows, joined apart from the others, and a cache that holds rows twice."""
    rows = [(i, "copy of one text" if i % 3 else f"text {i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    path, kept = public_tokenizers.path("piece_bpe_32k.model"), common.fresh(spark, "cache")
    out = tokens.token_counts(df, path, kept).collect()
    spark.read.schema(tokens.CACHE_SCHEMA).parquet(kept).limit(50).write.mode("append").partitionBy("version").parquet(kept)
    assert sorted(map(tuple, out)) == sorted(map(tuple, tokens.token_counts(df, path, kept).collect()))
    want = dict(zip([t for _, t in rows], counts([t for _, t in rows], "piece_bpe_32k.model"), strict=True))
    assert {r.doc_id: r.n_tokens for r in out} == {i: want[t] for i, t in rows}


def test_warm_cache_encodes_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    path, kept = public_tokenizers.path("piece_bpe_32k.model"), common.fresh(spark, "cache")
    first = sorted(tokens.token_counts(df, path, kept).collect())
    files = spark.read.parquet(kept).inputFiles()
    assert sorted(tokens.token_counts(df, path, kept).collect()) == first
    assert spark.read.parquet(kept).count() == 2 and set(files) <= set(spark.read.parquet(kept).inputFiles())


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n\t ", 1), (3, " \n\t ", 1), (None, "a <s> </s> <unk> b", 2), (5, "x " * 200_000, 3), (6, "😀é\x00", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    texts = [r[1] or "" for r in rows]
    want = sorted((r[0] or 0, len(t.encode()), n, n > 4096) for r, t, n in zip(rows, texts, counts(texts, "piece_bpe_32k.model"), strict=True))
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert sorted((r[0] or 0, *r[1:]) for r in tokens.token_counts(df, path).collect()) == want
    assert tokens.token_counts(df.limit(0), path).collect() == []
