"""Exact repeats of long byte strings, by a logarithmic family of sparse suffix arrays.

Of a text's suffixes those are kept that a match of ``LENGTH`` bytes can't avoid: each window of ``LENGTH`` bytes names the leftmost of its
``SEED``-byte strings with the least hash, its anchor; neighbouring windows with one anchor are a run. Equal windows have equal anchors at equal places,
so a run's suffix stands for all of its windows. A suffix array holds runs in the order of what they start with: first the fingerprint of
the anchor's string, then that of the whole run, then the place. Suffixes that share a long match are neighbours in it, though it is not in the order of
the letters: what is compared is fingerprints of longer and longer beginnings, so no text is sorted or moved.

New batches get suffix arrays of their own, which are one run of a table that is bucketed by the anchor's fingerprint, so all
arrays lie in the same order in the same buckets. A merge-scan goes through a bucket of all arrays in order: a run that an earlier one equals is a repeat as a
whole; runs with one anchor that differ may match in part and are looked at again, window by window, with their texts. Before a batch comes,
arrays of one level merge into one of the next, which keeps the earliest of equal runs; so a run is written again only as often as levels are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnforge.llm import common

#: Bytes of a string that counts as repeated, and of the strings that anchors are chosen by.
LENGTH, SEED = 100, 24
#: Bytes of text that a worker looks at together; longer texts are looked at in pieces.
BLOCK = 512 << 10
#: Batches that a whole table is dealt into, by ascending id.
BATCHES = 4
#: Runs with one anchor that are compared in one task; beyond it their windows are dealt out.
TOGETHER = 50_000
#: Bytes of places by document up to which they are sent to the texts; beyond, texts are shuffled to them.
SENT_BYTES = 64 << 20
#: Stands for a null id: before all others.
NULL_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
RUNS = "h long, f long, doc long, at long"
#: ``at``: start, 24 bits of the text's hash, which tell apart texts of one id, and the run's number of windows; of runs that are asked for, a sign that
#: many share the anchor.
_START, _TEXT, _COUNT, _MANY = 32, 8, 0x7F, 0x80


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo ``2 ** 64``."""
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n, x, _U)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


class _Hashes:
    """Hashes of all strings of given lengths in ``data``, from one sum over it."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(1 << max(len(data), BLOCK + LENGTH).bit_length())
        letters = common.mix(np.arange(1, 257, dtype=_U))
        self._sums = np.concatenate([np.zeros(1, _U), np.cumsum(letters[data] * up[: len(data)])])

    def of(self, size: int) -> np.ndarray:
        found = self._sums[size:] - self._sums[:-size]
        return common.mix(found * self._down[: len(found)])


def _ends(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The piece of each byte, and the end of each piece."""
    return np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)


def _runs(pieces: list[bytes]) -> tuple[np.ndarray, ...] | None:
    """``piece, start, windows, h, f`` of all runs of the pieces."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return None
    piece, ends = _ends(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    hashes = _Hashes(data)
    seeds, whole = hashes.of(SEED), hashes.of(LENGTH)
    least = (seeds & ~_U(0xFFFFFFFF)) | np.arange(len(seeds), dtype=_U)
    width, k = LENGTH - SEED + 1, 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if width > k:
        least = np.minimum(least[: k - width], least[width - k :])
    at = np.nonzero(np.arange(n) + LENGTH <= ends[piece[:n]])[0]
    if not len(at):
        return None
    anchor, piece = (least[at] & _U(0xFFFFFFFF)).astype(np.int64), piece[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(at)) - 1
    start, end, anchor, piece = at[first], at[last], anchor[first], piece[first]
    count = end - start + 1
    # First and last window cover the run; where the anchor lies in it is part of the print, so equal prints match place by place.
    f = common.mix(whole[start] * _U(_BASE) + common.mix(whole[end] + (count * LENGTH + anchor - start).astype(_U)))
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return piece, start - (ends - sizes)[piece], count, seeds[anchor].view(np.int64), f.view(np.int64)


def _later(order: np.ndarray, same: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """In ``order``, whether a row's place comes after that of the first of its ``same`` rows."""
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    d, s = doc[order], start[order]
    return (d != d[lead]) | (s != s[lead])


def _spans(owner: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, in order, with those that follow each other without a gap joined: ``owner, start, count``."""
    if not len(start):
        return owner, start, count
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + count[:-1])
    i = np.nonzero(new)[0]
    return owner[i], start[i], np.add.reduceat(count, i)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Rows ``doc, mark, text`` as blocks of pieces ``doc, mark, offset, bytes``; pieces of one text overlap by a window less a byte."""
    block, size = [], 0
    for b in batches:
        for doc, mark, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            whole = text.encode("utf-8", "surrogatepass")
            for i in range(0, max(1, len(whole) - LENGTH + 1), BLOCK):
                piece = whole[i : i + BLOCK + LENGTH - 1] if len(whole) > BLOCK else whole
                block.append((doc, mark, i, piece))
                size += len(piece)
                if size >= BLOCK:
                    yield block
                    block, size = [], 0
    if block:
        yield block


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.binary() if c.dtype == object else pa.int64() for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names.split())


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of texts, each once a block; those that repeat in their block come as spans: no windows in ``at``, their number as ``f``."""
    for block in _texts(batches):
        found = _runs([p for *_, p in block])
        if found is None:
            continue
        piece, start, count, h, f = found
        doc, mark, offset = (np.array(x, np.int64) for x in list(zip(*block, strict=True))[:3])
        start += offset[piece]
        doc, mark = doc[piece], mark[piece]
        order = np.lexsort((mark, start, doc, f, h))
        same = np.zeros(len(order), bool)
        same[1:] = (h[order[1:]] == h[order[:-1]]) & (f[order[1:]] == f[order[:-1]])
        later = _later(order, same, doc, start)
        twin = same & ~later  # of a row with the same id; kept if its text is another
        twin[1:] &= mark[order[1:]] == mark[order[:-1]]
        keep = order[~later & ~twin]
        yield _batch("h f doc at", h[keep], f[keep], doc[keep], start[keep] << _START | mark[keep] << _TEXT | count[keep])
        gone = np.sort(order[later])
        owner, begin, windows = _spans(piece[gone], start[gone], count[gone])
        doc, mark = (np.array(x, np.int64)[owner] for x in list(zip(*block, strict=True))[:2])
        yield _batch("h f doc at", begin * 31 + doc, windows, doc, begin << _START | mark << _TEXT)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows that an earlier one equals, among rows ``key, doc, at, run``, sorted by key; the windows of a key are compared with each other."""

    def compared(rows: pa.Table) -> pa.RecordBatch:
        key, doc, at = (rows.column(c).to_numpy() for c in ("key", "doc", "at"))
        runs = rows.column("run").to_pylist()
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        row, ends = _ends(sizes)
        hashes = _Hashes(np.frombuffer(b"".join(runs), np.uint8)).of(LENGTH)
        here = np.nonzero(np.arange(len(hashes)) + LENGTH <= ends[row[: len(hashes)]])[0]
        row = row[here]
        hashes = common.mix(hashes[here] + common.mix(key.view(_U))[row])
        place = (at >> _START)[row] + here - (ends - sizes)[row]
        order = np.lexsort((place, doc[row], hashes))
        same = np.zeros(len(order), bool)
        same[1:] = hashes[order[1:]] == hashes[order[:-1]]
        gone = np.sort(order[_later(order, same, doc[row], place)])
        owner, start, count = _spans(row[gone], place[gone], np.ones(len(gone), np.int64))
        return _batch("doc at f", doc[owner], start << _START | at[owner] & ((1 << _START) - 1) & ~_COUNT, count)

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        spans = b.filter(pc.is_null(b.column(3)))
        if spans.num_rows:
            yield _batch("doc at f", spans.column(1).to_numpy(), spans.column(2).to_numpy(), spans.column(0).to_numpy())
        b = b.filter(pc.is_valid(b.column(3)))
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= BLOCK:
            rows = pa.Table.from_batches(held)
            keys = rows.column("key").to_numpy()
            whole = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if (keys != keys[-1]).any() else 0
            if whole:
                yield compared(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held)
    if held:
        yield compared(pa.Table.from_batches(held))


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of asked runs of texts: rows ``doc, mark, text, anchors, places``, the runs' ``h`` and ``at``.

    Where many runs share an anchor, each of their windows is a row under its own hash, once a task's slice; those that repeat in it are
    spans: rows without bytes, whose number of windows is their key.
    """
    for b in batches:
        docs, marks, texts, anchors, places = (c.to_pylist() for c in b.columns)
        out: tuple[list, ...] = ([], [], [], [])
        first: dict[bytes, tuple[int, int]] = {}
        many = []
        for doc, mark, text, hs, ats in zip(docs, marks, texts, anchors, places, strict=True):
            whole = text.encode("utf-8", "surrogatepass")
            for h, at in zip(hs, ats, strict=True):
                start, count = at >> _START, at & _COUNT
                if at & _MANY:
                    for s in range(start, start + count):
                        window = whole[s : s + LENGTH]
                        many.append((doc, s, mark, window))
                        first[window] = min(first.get(window, (doc, s)), (doc, s))
                else:
                    for x, value in zip(out, (h, doc, at, whole[start : start + count + LENGTH - 1]), strict=True):
                        x.append(value)
        for doc, s, mark, window in dict.fromkeys(many):
            known = (doc, s) == first[window]
            key = int.from_bytes(window[:8], "little", signed=True) ^ hash_of(window) if known else 1
            for x, value in zip(out, (key, doc, s << _START | mark << _TEXT | int(known), window if known else None), strict=True):
                x.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["key", "doc", "at", "run"])


def hash_of(window: bytes) -> int:
    return int(common.hashes([window]).view(np.int64)[0])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc, mark, spans (start << 32 | windows)`` as disjoint bounds of bytes, in order."""
    for b in batches:
        ends, starts, stops = [0], [], []
        for spans in b.column(2):
            x = np.sort(spans.values.to_numpy())
            start, stop = x >> 32, (x >> 32) + (x & 0xFFFFFFFF) + LENGTH - 1
            reach = np.maximum.accumulate(stop)
            new = np.ones(len(x), bool)
            new[1:] = start[1:] > reach[:-1]
            i = np.nonzero(new)[0]
            starts.append(start[i])
            stops.append(np.append(reach[i[1:] - 1], reach[-1]))
            ends.append(ends[-1] + len(i))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int64())) for x in (starts, stops)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["doc", "mark", "starts", "stops"])


def _start(at: Column) -> Column:
    return F.shiftright(at, _START)


def _mark(at: Column) -> Column:
    return F.shiftright(at, _TEXT).bitwiseAND((1 << (_START - _TEXT)) - 1)


def _texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc, mark, text`` of all rows, and other columns."""
    text = F.coalesce("text", F.lit(""))
    mark = F.xxhash64(text).bitwiseAND((1 << (_START - _TEXT)) - 1)
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("doc"), mark.alias("mark"), text.alias("text"), *more)


def _met(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``texts`` with what ``lists (doc, mark, arrays of longs)``, with one row for each document and mark, has of them."""
    counted = [c for c, kind in lists.dtypes if kind.startswith("array")]
    rows, entries = lists.agg(F.count("*"), F.coalesce(F.sum(sum(F.size(c) for c in counted)), F.lit(0))).first()
    few = rows * 80 + entries * 8 <= SENT_BYTES
    return texts.join(F.broadcast(lists) if few else lists, ["doc", "mark"], how)


class Family:
    """Suffix arrays over all documents that were added: a table bucketed by anchor, with a partition for each array.

    ``runs`` has the arrays as ``(partition, level)``, oldest first. What a merge-scan finds is appended to two tables: ``same``, runs that are repeats as a
    whole, and ``near``, runs with one anchor that differ. Batches may come in any order of ids.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"tarnforge_runs_{uuid.uuid4().hex}"
        self.path, self.same, self.near = (common.fresh(spark, x) for x in ("runs", "same", "near"))
        self.runs: list[tuple[int, int]] = []
        self._next, self.found = 1, ""

    def _append(self, rows: DataFrame) -> None:
        writer = rows.write.mode("append").format("parquet").partitionBy("run").bucketBy(self.buckets, "h").sortBy("h", "f")
        writer.option("path", self.path).saveAsTable(self.name)

    def _held(self, runs: list[int]) -> DataFrame:
        return self.spark.table(self.name).where(F.col("run").isin(runs))

    def _merge(self) -> None:
        """Two newest arrays of one level become one of the next, as long as there are such."""
        while len(self.runs) > 1 and self.runs[-1][1] == self.runs[-2][1]:
            (a, level), (b, _) = self.runs[-2:]
            earliest = Window.partitionBy("h", "f").orderBy("doc", "at")
            lead = F.first(F.struct("doc", _start(F.col("at")).alias("s"))).over(earliest)
            rows = self._held([a, b]).withColumn("lead", lead).where((F.col("doc") == F.col("lead.doc")) & (_start(F.col("at")) == F.col("lead.s")))
            number, self._next = self._next, self._next + 1
            self._append(rows.select("h", "f", "doc", "at", F.lit(number).alias("run")))
            self.runs[-2:] = [(number, level + 1)]
            for old in (a, b):
                self._drop(old)

    def _drop(self, run: int) -> None:
        self.spark.sql(f"alter table {self.name} drop if exists partition (run = {run})")
        common.drop(self.spark, f"{self.path}/run={run}")

    def add(self, docs: DataFrame) -> None:
        """Add a batch ``docs (doc_id, text, ...)``: its suffix array, and what it shares with those before and in itself."""
        if self.runs:
            self._merge()
        number, self._next = self._next, self._next + 1
        found = common.map_tasks(_texts_of(docs), _suffixes, RUNS)
        whole = F.col("at").bitwiseAND(_COUNT) > 0
        self._append(found.repartition(self.buckets, "h").withColumn("run", F.when(whole, number).otherwise(-number)))
        self.runs.append((number, 0))
        spans = self._held([-number]).select("doc", "at", "f")
        scanned = self._scanned(number)
        spans.write.mode("append").parquet(self.same)
        # The scan's rows that matter are few against what it reads: one table of both kinds, read twice.
        scanned, path = common.cut(scanned, "scanned")
        scanned.where("later").select("doc", "at", F.col("at").bitwiseAND(_COUNT).alias("f")).write.mode("append").parquet(self.same)
        scanned.where("not later").select("h", "doc", "at").write.mode("append").parquet(self.near)
        common.drop(self.spark, path)
        self._drop(-number)

    def _scanned(self, number: int) -> DataFrame:
        """The merge-scan: rows that the new array brings into a match, ``later`` if an earlier run equals them, else to be compared window by window."""
        equal = Window.partitionBy("h", "f").orderBy("doc", "at")
        around = Window.partitionBy("h").orderBy("f", "doc", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = self._held([run for run, _ in self.runs]).withColumn("new", F.col("run") == number)
        rows = rows.withColumn("lead", F.first(F.struct("doc", _start(F.col("at")).alias("s"), "new")).over(equal))
        rows = rows.withColumn("later", (F.col("doc") != F.col("lead.doc")) | (_start(F.col("at")) != F.col("lead.s")))
        rows = rows.withColumn("mixed", (F.first("f").over(around) != F.last("f").over(around)) & F.max("new").over(around))
        wanted = F.when(F.col("later"), F.col("new") | F.col("lead.new")).otherwise(F.col("mixed"))
        return rows.where(wanted).select("h", "doc", "at", "later")

    def repeats(self, docs: DataFrame) -> DataFrame:
        """``doc, mark, starts, stops``: the bytes of each document that repeat earlier ones; ``docs`` are all that were added."""
        asked = self.spark.read.schema("h long, doc long, at long").parquet(self.near).distinct()
        asked, _ = common.cut(asked, "asked")
        crowds = asked.groupBy("h").count().where(F.col("count") > TOGETHER).select("h", F.lit(True).alias("many"))
        crowds, _ = common.cut(crowds, "crowds")
        run = F.struct("h", F.col("at").bitwiseOR(F.when(F.col("many"), _MANY).otherwise(0)).alias("at"))
        lists = asked.join(crowds, "h", "left").groupBy("doc", _mark(F.col("at")).alias("mark")).agg(F.collect_list(run).alias("runs"))
        lists, _ = common.cut(lists.select("doc", "mark", F.col("runs.h").alias("anchors"), F.col("runs.at").alias("places")), "lists")
        met = _met(_texts_of(docs), lists, "inner").select("doc", "mark", "text", "anchors", "places")
        bytes_of = common.map_tasks(met, _wanted, "key long, doc long, at long, run binary")
        spread = bytes_of.repartition(self.buckets, F.when(F.col("run").isNull(), F.col("doc")).otherwise(F.col("key"))).sortWithinPartitions("key")
        parts = common.map_tasks(spread, _windows, "doc long, at long, f long")
        spans = self.spark.read.schema("doc long, at long, f long").parquet(self.same).unionByName(parts)
        packed = F.shiftleft(_start(F.col("at")), 32).bitwiseOR(F.col("f"))
        lists = spans.groupBy("doc", _mark(F.col("at")).alias("mark")).agg(F.collect_set(packed).alias("spans"))
        merged, self.found = common.cut(common.map_tasks(lists, _merged, "doc long, mark long, starts array<long>, stops array<long>"), "repeats")
        return merged

    def close(self) -> None:
        """Delete the arrays and what was found; ``repeats`` that were returned stay."""
        self.spark.sql(f"drop table if exists {self.name}")
        common.drop(self.spark, self.path, self.same, self.near)


def _cut_out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The bytes of each text outside of its spans."""
    at = {n: i for i, n in enumerate(batch.schema.names)}
    kept = []
    for text, starts, stops in zip(*(batch.column(at[c]).to_pylist() for c in ("text_of", "starts", "stops")), strict=True):
        whole = text.encode("utf-8", "surrogatepass")
        kept.append(b"".join(whole[a:b] for a, b in zip([0, *stops], [*starts, len(whole)], strict=True)) if starts else whole)
    names = [n for n in batch.schema.names if n != "text_of"]
    yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in names), pa.array(kept, pa.binary())], [*names, "kept_bytes"])


def without_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The rows of ``docs (doc_id, text, ...)`` with ``starts`` and ``stops``, the bounds of removed bytes, and ``kept_bytes``, the others.

    A byte is removed if a string of ``LENGTH`` bytes around it starts earlier too, in a smaller doc_id or before in the same one. Strings are judged on the texts as they are, as UTF-8, so what is kept may
    end inside of a letter. Null text: as empty; texts shorter than ``LENGTH``: kept whole. Null doc_id: as smaller than all others.
    Rows of one doc_id are one document at the same places: they take nothing from each other unless one has it at an earlier place. Empty table: empty result. Texts of any length are looked at whole.
    Columns named like the added ones are replaced; others come back as they are.
    """
    spark = docs.sparkSession
    with common.scratch() as made:
        bounds = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else None
        bounds = sorted(set(bounds or []))
        family = Family(spark)
        for low, high in zip([None, *bounds], [*bounds, None], strict=True):
            here = F.lit(True) if low is None else F.col("doc_id") > low
            if high is not None:
                here &= F.col("doc_id") <= high
            family.add(docs.where(here | F.col("doc_id").isNull() if low is None else here))
        found = family.repeats(docs)
        family.close()
        common.release(spark, made, family.found)
    added = ("starts", "stops", "kept_bytes")
    own = [c for c in docs.columns if c.lower() not in added]
    row = F.struct(*(F.col(f"`{c}`") for c in own)).alias("row")
    texts = _met(_texts_of(docs, row), found, "left")
    none = F.array().cast("array<long>")
    texts = texts.select("row", F.col("text").alias("text_of"), *(F.coalesce(c, none).alias(c) for c in ("starts", "stops")))
    kind = texts.schema["row"].dataType.simpleString()
    done = common.map_arrow(texts, _cut_out, f"row {kind}, starts array<long>, stops array<long>, kept_bytes binary")
    return done.select(*(F.col("row").getField(c).alias(c) for c in own), *added)
