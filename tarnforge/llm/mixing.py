"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent, found by bisection, so that the weights reach a target
entropy without repeating any source more often than allowed. The weights are realised as block permutations: hashes
deal each source's documents into blocks, an epoch is one pass over the blocks in an order of its own, and
documents are taken block by block until the source's token budget is met. Only the block in which the
budget ends is looked at document by document.

Totals, weights and plans by source stay in tables: nothing here grows on the driver with the number of sources. All sums are exact, so
the same rows give the same weights and draws, bit for bit, in whatever order and parts they come.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnforge.llm import common

#: Documents a block, about.
BLOCK_DOCS = 512
#: Sources whose plan is broadcast; a longer one is joined by source and one of ``SALTS`` parts of each source's rows.
BROADCAST_SOURCES, SALTS = 20_000, 64
#: Target: this part of the way from the sources' own entropy to that of equal weights.
EVENNESS = 0.3
#: A source's tokens are drawn at most so often in all.
MAX_EPOCHS = 2.0
#: Exponents that one pass over the totals tries, and passes: the interval shrinks to one of ``GRID ** PASSES`` parts.
GRID, PASSES = 32, 8
#: Sums over the sources are of whole numbers of this part of one: sums of doubles would follow the order of the rows.
UNIT = 1e24
#: Tokens: words ``[^\x20\x09-\x0D]+``.
_WORDS = r"[^\x20\x09-\x0D]+"


def exponent(totals: DataFrame, budget: float, evenness: float = EVENNESS, max_epochs: float = MAX_EPOCHS) -> tuple[float, float]:
    """The exponent for ``totals (tokens, ...)``, one row a source, and the sum of the raised shares.

    It falls from 1 until the entropy of the weights has gone ``evenness`` of the way to the greatest, or until a source
    would be drawn more than ``max_epochs`` times, whichever comes first. Sources without tokens play no part.
    """
    alive = totals.where("tokens > 0")
    n, total, least = alive.agg(F.count("*"), F.sum("tokens").cast("double"), F.min("tokens")).first()
    if not n:
        return 1.0, 0.0
    if budget > max_epochs * total:
        raise ValueError(f"a budget of {budget} tokens draws some of {total:.0f} tokens more than {max_epochs} times")
    share = F.col("tokens") / total

    def tried(points: list[float]) -> list[tuple[float, float, float]]:
        """Sum, entropy and greatest repetition of the weights at each exponent: the smallest source is repeated most."""
        raised = [F.pow(share, F.lit(a)) for a in points]
        exact = [F.sum((x * UNIT).cast("decimal(38,0)")) for r in raised for x in (r, r * F.log(share))]
        sums = [float(x) / UNIT for x in alive.agg(*exact).first()]
        out = []
        for a, z, weighted in zip(points, sums[0::2], sums[1::2], strict=True):
            out.append((z, math.log(z) - a * weighted / z, (least / total) ** a / z * budget / least))
        return out

    (z0, greatest, most), (z1, own, _) = tried([0.0, 1.0])
    goal = (1 - evenness) * own + evenness * greatest
    if greatest <= goal and most <= max_epochs:
        return 0.0, z0
    low, high, sum_high = 0.0, 1.0, z1  # too far at low, or the greatest entropy itself; not at high
    for _ in range(PASSES):
        points = [low + (high - low) * i / GRID for i in range(1, GRID)]
        found = tried(points)
        far = sum(entropy > goal or times > max_epochs for _, entropy, times in found)  # both fall as the exponent grows
        if far < len(points):
            high, sum_high = points[far], found[far][0]
        if far:
            low = points[far - 1]
    return high, sum_high


def _placed(docs: DataFrame, seed: int, row: Column | None = None) -> DataFrame:
    """``row``, and each row's source, tokens and the hash that places it."""
    return docs.select(
        *([row.alias("row")] if row is not None else []),
        F.coalesce("source", F.lit("")).alias("of"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORDS)).cast("long").alias("n"),
        F.xxhash64("doc_id", F.lit(seed)).alias("hash"),
    )


def _turn(epoch: Column, seed: int) -> Column:
    """The place of a row's block in the order of an epoch."""
    return F.xxhash64("of", F.pmod("hash", "blocks"), epoch, F.lit(seed))


def _order(epoch: Column, seed: int) -> Column:
    """A row's own place in its block in an epoch; rows of equal places go by ``hash``."""
    return F.xxhash64("hash", epoch, F.lit(seed))


def _with_plan(placed: DataFrame, plan: DataFrame, sources: int, seed: int) -> DataFrame:
    """``placed`` with its source's plan, the place of its block in the last, partial epoch, and its own in the block."""
    if sources <= BROADCAST_SOURCES:
        known = placed.join(F.broadcast(plan), "of")
    else:
        parts = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        known = placed.withColumn("salt", F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(SALTS)).cast("int")).join(parts, ["of", "salt"]).drop("salt")
    return known.withColumn("turn", _turn(F.col("epochs"), seed)).withColumn("place", _order(F.col("epochs"), seed))


def _planned(docs: DataFrame, budget: int | None, evenness: float, max_epochs: float, seed: int) -> tuple[DataFrame, int, str]:
    """One row a source: its weight, blocks and whole epochs, and where its partial epoch ends; the number of sources; the table's path."""
    slim, _ = common.cut(_placed(docs, seed), "placed")
    totals, _ = common.cut(slim.groupBy("of").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")), "totals")
    sources, total = totals.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    budget = total if budget is None else budget
    a, z = exponent(totals, budget, evenness, max_epochs)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(total or 1), F.lit(a)) / (z or 1.0)).otherwise(0.0)
    plan = totals.select("of", "tokens", weight.alias("weight"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long").alias("blocks"))
    plan = plan.withColumn("quota", F.least(F.floor(F.col("weight") * budget + 0.5), F.floor(F.col("tokens") * max_epochs)))
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0).cast("long"))
    plan = plan.withColumn("room", F.col("quota") - F.col("epochs") * F.col("tokens"))

    # Groups of blocks, then blocks, then documents: each step looks inside the group where the room ends.
    group = F.shiftright("turn", 52).cast("long")
    for inside, keys in (((), ("group",)), (("group",), ("turn",)), (("turn",), ("place", "hash"))):
        plan, _ = common.cut(plan, "plan")
        rows = _with_plan(slim, plan, sources, seed).withColumn("group", group)
        for c in inside:
            rows = rows.where(F.col(c) == F.col(f"{c}_at"))
        sums = rows.groupBy("of", *keys).agg(F.sum("n").alias("n"), F.first("room").alias("room"))
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("of").orderBy(*keys)))
        bar = upto.where("upto > room").groupBy("of").agg(F.min(F.struct(*keys, (F.col("upto") - F.col("n")).alias("ahead"))).alias("b"))
        bar = bar.select("of", *(F.col(f"b.{c}").alias(f"{c}_at") for c in keys), F.col("b.ahead").alias("ahead"))
        plan = plan.join(bar, "of", "left").withColumn("room", F.col("room") - F.coalesce("ahead", F.lit(0))).drop("ahead")
    plan, kept = common.cut(plan, "plan")
    return plan, sources, kept


def mixed(docs: DataFrame, budget: int | None = None, evenness: float = EVENNESS, max_epochs: float = MAX_EPOCHS, seed: int = 3) -> DataFrame:
    """The rows of ``docs (doc_id, text, source, ...)`` with ``n_tokens, weight, copies, draws, kept``.

    ``copies`` says how often a row is drawn: once for each whole pass over its source that the budget
    allows, and once more if the last, partial pass takes it. ``draws`` has one struct for each of them: its ``epoch``, its
    ``block``, the ``progress`` from 0 to 1 through the whole mixture at which the block comes, and the ``place`` by which rows of a block
    are ordered. All draws in the order of progress, block and place are the mixture: each source's blocks in a new
    permutation each epoch, spread evenly over the whole. ``budget`` is in tokens, by default all there are; one that would draw all
    tokens more than ``max_epochs`` times raises ValueError.

    Null text: no tokens; such rows go with their block. Null source: one source, the empty string. Null
    doc_id: those rows share a block. Repeated rows: all are drawn or none. Empty table: empty result.
    Very long texts can exceed what is left of a source's room; they then end its partial pass. Columns named like the added ones are
    replaced by them; others stay as they are, whatever their names.
    """
    with common.scratch() as made:
        plan, sources, kept_at = _planned(docs, budget, evenness, max_epochs, seed)
        common.release(docs.sparkSession, made, kept_at)
    added = ("n_tokens", "weight", "copies", "draws", "kept")
    own = [c for c in docs.columns if c.lower() not in added]
    rows = _with_plan(_placed(docs, seed, F.struct(*(F.col(f"`{c}`") for c in own))), plan, sources, seed)
    before = (F.col("place") < F.col("place_at")) | ((F.col("place") == F.col("place_at")) & (F.col("hash") < F.col("hash_at")))
    taken = F.coalesce((F.col("turn") < F.col("turn_at")) | ((F.col("turn") == F.col("turn_at")) & before), F.lit(False))
    copies = F.col("epochs") + taken.cast("long")
    passes = F.greatest(F.col("quota") / F.greatest("tokens", F.lit(1)), F.lit(1e-9))

    def draw(epoch: Column) -> Column:
        within = (F.shiftright(_turn(epoch, seed), 11) + F.lit(1 << 52)) / float(1 << 53)
        return F.struct(
            epoch.alias("epoch"),
            F.pmod("hash", "blocks").alias("block"),
            F.least((epoch + within) / passes, F.lit(1.0)).alias("progress"),
            _order(epoch, seed).alias("place"),
        )

    draws = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), draw)).otherwise(F.array())
    return rows.select(
        *(F.col("row").getField(c).alias(c) for c in own),
        F.col("n").alias("n_tokens"), "weight", copies.alias("copies"), draws.alias("draws"), (copies > 0).alias("kept"),
    )
