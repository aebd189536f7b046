"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items build one automaton; each document's words are streamed through it, and the
length of the longest match that ends at each word is tracked. Where it reaches the window, the last
words are an exact passage of some item. Items shorter than a window count as one window of their own.

Workers build the automaton from the items' words, which are all that is broadcast. A benchmark too large for one
automaton is dealt into several, and the documents are read once for each: no process holds two.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.llm import common

#: A-Z to a-z; every other ASCII character but letters and digits to a blank.
_PLAIN = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_RUN = re.compile(rb"[^ ]+")

#: The same words in a text as it came.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Words of all items that one automaton may hold, about: some 400 bytes each in a worker.
MAX_WORDS = 500_000


def _plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)


class Automaton:
    """Generalised suffix automaton over word sequences, with the items of each window-long match."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, str | None]]] = [[]]
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                while len(ends) < len(self.next):
                    ends.append([])
            # Every prefix's state, met again: a split may have moved it.
            at = 0
            for i, w in enumerate(words):
                at = self.next[at][self.vocabulary[w]]
                if i + 1 >= window:
                    ends[at].append((window, item))
            if words and len(words) < window:
                ends[at].append((len(words), item))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: By state: items of the window-long suffix of its matches, which one ancestor or itself stands for.
        whole: list[frozenset] = [frozenset()] * len(self.next)
        gathered = [{x for n, x in e if n == window} for e in ends]
        for s in reversed(order):
            if self.length[self.link[s]] >= window:
                gathered[self.link[s]] |= gathered[s]
        #: By state: shorter items, with their lengths, that end where its matches end.
        self.short: list[tuple[tuple[int, str | None], ...]] = [()] * len(self.next)
        for s in order:
            up = self.link[s]
            whole[s] = whole[up] if self.length[up] >= window else frozenset(gathered[s]) if self.length[s] >= window else frozenset()
            self.short[s] = self.short[up] + tuple({x for x in ends[s] if x[0] < window})
        self.whole = whole

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        twin = self._state(self.length[p] + 1)
        self.next[twin], self.link[twin] = dict(self.next[q]), self.link[q]
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words, as merged ``(start, end)`` by word, and the items whose windows occur."""
        spans: list[list[int]] = []
        items: set = set()
        step, link, length, window, short, whole = self.next, self.link, self.length, self.window, self.short, self.whole
        s = n = 0
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                s = n = 0
                continue
            while s and c not in step[s]:
                s = link[s]
                n = length[s]
            s = step[s].get(c, 0)
            n = n + 1 if s else 0
            wide = 0
            if n >= window:
                wide = window
                items |= whole[s]
            if short[s]:
                for k, item in short[s]:
                    if k <= n:
                        wide = max(wide, k)
                        items.add(item)
            if wide:
                start = i + 1 - wide
                while spans and spans[-1][0] >= start:
                    start = min(start, spans.pop()[0])
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        return [tuple(x) for x in spans], items


#: The automaton that this worker built last, by the name of its items.
_built: dict[str, Automaton] = {}


def _automaton(sent, window: int) -> Automaton:
    name, items = sent.value
    if name not in _built:
        _built.clear()
        _built[name] = Automaton([(i, plain.split()) for i, plain in items], window)
    return _built[name]


def _groups(benchmark: DataFrame, max_words: int) -> tuple[DataFrame, int]:
    """``item_id, text, part`` of the benchmark, dealt by a hash into parts of about ``max_words`` words; and their number."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    words = items.agg(F.sum(F.regexp_count("text", F.lit(_WORD)))).first()[0] or 0
    n = max(1, -(-words // max_words))
    return items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")), n


def _sent(groups: DataFrame, part: int):
    """The items of a part, broadcast as plain text."""
    rows = groups.where(F.col("part") == part).select("item_id", "text").toLocalIterator()
    return groups.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.item_id, _plain(r.text)) for r in rows]))


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = "array<struct<start:long,end:long>>"
_KIND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _hits(docs: DataFrame, groups: DataFrame, parts: int, window: int) -> DataFrame:
    """``digest, spans, items`` of each text of ``docs (digest, text)`` in which windows of a part occur, parts united.

    One pass over the documents for each part; what it finds is written before the next.
    """
    found = None
    for part in range(parts):
        sent = _sent(groups, part)

        def search(batch: pa.RecordBatch, sent=sent):
            digests, spans, items = [], [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, names = _automaton(sent, window).scan(_plain(text).split())
                if own:
                    digests.append(digest)
                    spans.append([{"start": a, "end": b} for a, b in own])
                    items.append(sorted(names - {None}))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(spans, _KIND), pa.array(items, pa.list_(pa.string()))], ["digest", "spans", "items"])

        some = common.map_arrow(docs, search, f"digest binary, spans {_SPANS}, items array<string>")
        some = some.groupBy("digest").agg(F.first(F.struct("spans", "items")).alias("f")).select("digest", "f.*")
        some, _ = common.cut(some, "hits")
        sent.unpersist()
        found = some if found is None else found.unionByName(some)
    whole = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return common.cut(found.groupBy("digest").agg(whole("spans"), F.array_distinct(whole("items")).alias("items")), "hits")[0]


def _result(n: int, spans: list[tuple[int, int]], items: list[str]) -> tuple:
    hit = sum(b - a for a, b in spans)
    digest = hashlib.sha256(",".join(sorted(items)).encode("utf-8", "surrogatepass")).hexdigest()
    return n, hit, len(items), digest, hit > 0, [{"start": a, "end": b} for a, b in spans]


_RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), _KIND]


def _table(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES))], ["doc_id", *_RESULT])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` for every row of ``docs``.

    Words are maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased. ``spans`` are the
    hit words as ``[start, end)`` by word. A benchmark beyond ``max_words`` words is dealt into several
    automata; the documents are read once for each, and what is found for a text is united.

    Null or wordless text: no words, not contaminated. Wordless items have no window. Items with a null
    id hit words but are not named. Null or repeated doc_id: each row is returned by itself. Empty tables
    give an empty result or no hits. Other columns are ignored, whatever their names.
    """
    groups, parts = _groups(benchmark, max_words)
    schema = f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans {_SPANS}"
    texts = docs.select("doc_id", "text")
    if parts == 1:
        sent = _sent(groups, 0)

        def search(batch: pa.RecordBatch):
            out = []
            for text in batch.column(1).to_pylist():
                words = _plain(text).split()
                spans, items = _automaton(sent, window).scan(words)
                out.append(_result(len(words), spans, list(items - {None})))
            yield _table(batch.column(0), out)

        return common.map_arrow(texts, search, schema)

    texts = texts.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    hits = _hits(texts.select("digest", "text"), groups, parts, window)

    def count(batch: pa.RecordBatch):
        n = [len(_plain(t).split()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "digest", "n_words"])

    rows, _ = common.cut(common.map_arrow(texts.select("doc_id", "digest", "text"), count, "doc_id long, digest binary, n_words long"), "words")
    joined = common.join_hot(rows, hits, "digest", "left").select("doc_id", "n_words", "spans", "items")

    def unite(batch: pa.RecordBatch):
        n, spans, items = (batch.column(i).to_pylist() for i in (1, 2, 3))
        yield _table(batch.column(0), [_result(k, _united([(x["start"], x["end"]) for x in s or ()]), i or []) for k, s, i in zip(n, spans, items, strict=True)])

    return common.map_arrow(joined, unite, schema)


def _without(text: str, plain: bytes, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans of its words, each from the first character of its first word to the last of its last."""
    places, raw, rest, done = [m.span() for m in _RUN.finditer(plain)], text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in spans:
        rest.append(raw[done : places[a][0]])
        done = places[b - 1][1]
    return b"".join([*rest, raw[done:]]).decode("utf-8", "surrogatepass")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of ``docs`` without the passages of the benchmark, columns as they are.

    Each hit span is cut from its text, from the first to the last of its words, and ``n_chars``, where there is such
    a column, follows. A document is dropped if more than ``max_coverage`` of its words are hit.

    Rows without hits come back unchanged, null and wordless texts included. Null or repeated doc_id: each row is treated by
    itself. Empty tables: an empty result, or every row as it is. Columns other than text and n_chars play no part,
    whatever their names.
    """
    groups, parts = _groups(benchmark, max_words)
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cleaned(batch: pa.RecordBatch, spans_of) -> pa.RecordBatch:
        texts, keep, changed = batch.column(at).to_pylist(), [], {}
        for i, text in enumerate(texts):
            plain = _plain(text)
            words = plain.split()
            spans = spans_of(i, words)
            keep.append(sum(b - a for a, b in spans) <= max_coverage * len(words))
            if spans and keep[-1]:
                changed[i] = _without(text, plain, spans)
        if changed:
            batch = batch.set_column(at, batch.schema.field(at), pa.array([changed.get(i, t) for i, t in enumerate(texts)], pa.string()))
            if count is not None:
                n = batch.column(count).to_pylist()
                kind = batch.schema.field(count)
                batch = batch.set_column(count, kind, pa.array([len(changed[i]) if i in changed else n[i] for i in range(len(n))], kind.type))
        return batch.filter(pa.array(keep, pa.bool_()))

    if parts == 1:
        sent = _sent(groups, 0)

        def clean(batch: pa.RecordBatch):
            yield cleaned(batch, lambda i, words: _automaton(sent, window).scan(words)[0])

        return common.map_arrow(docs, clean, docs.schema)

    digest, spans = common.unused(docs, "digest", "spans")
    known = docs.withColumn(digest, F.unhex(F.sha2("text", 256)))
    hits = _hits(known.select(F.col(digest).alias("digest"), "text"), groups, parts, window)
    joined = common.join_hot(known, hits.select(F.col("digest").alias(digest), F.col("spans").alias(spans)), digest, "left")

    def clean_by_hits(batch: pa.RecordBatch):
        found = batch.column(len(names)).to_pylist()
        yield cleaned(batch.select(list(range(len(names)))), lambda i, words: _united([(x["start"], x["end"]) for x in found[i] or ()]))

    return common.map_arrow(joined.select(*(F.col(f"`{c}`") for c in names), spans), clean_by_hits, docs.schema)
