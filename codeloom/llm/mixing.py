"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks; block i of a source of weight w is released at
slot floor(i / w) and due at ceil((i + 1) / w). In each slot the released block
with the earliest deadline goes, so that after any number of slots each source
is within one block of its target, however long the phase. The weights are
exact fractions; their schedule repeats after a period of their common
denominator. When a source runs out, a new phase begins in which the others
share its slots. Each row is placed once.

Every source has its own weight. The driver handles the schedule only: the
sources, and for each phase one period of slots or, where that is long, the
phase's slots, which are not more than its blocks.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

BLOCK_ROWS = 64
PERIOD = 1024
#: Blocks of a class that one key of the join with the schedule covers.
SPAN = 1024


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots of a period by largest remainder, at least one each."""
    total = sum(weights.values())
    ideal = {k: w / total * (period - len(weights)) for k, w in weights.items()}
    out = {k: 1 + int(v) for k, v in ideal.items()}
    for k in sorted(weights, key=lambda k: (int(ideal[k]) - ideal[k], k))[: period - sum(out.values())]:
        out[k] += 1
    return out


def exact(weights: dict[str, float]) -> dict[str, int]:
    """The weights as the least whole numbers of the same ratios: slots in a period that is their sum.

    A float counts as the decimal that it prints as. Classes of weight 0 have
    no slots, unless all are 0: then each has one.
    """
    parts = {k: Fraction(str(w)) for k, w in weights.items()}
    if any(w < 0 for w in parts.values()):
        raise ValueError("a weight of the mix is negative")
    parts = {k: w for k, w in parts.items() if w > 0} or dict.fromkeys(parts, Fraction(1))
    scale = math.lcm(*(w.denominator for w in parts.values()))
    whole = {k: int(w * scale) for k, w in parts.items()}
    least = math.gcd(*whole.values())
    return {k: w // least for k, w in whole.items()}


def in_order(slots: dict[str, int]) -> Iterator[str]:
    """The class of each slot, without end: earliest deadline first. It repeats after the sum of ``slots``."""
    period = sum(slots.values())
    waiting = [(0, k, 0) for k in slots]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for now in itertools.count():
        while waiting and waiting[0][0] <= now:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // slots[k]), k, i))
        _, k, i = heapq.heappop(ready)
        yield k
        heapq.heappush(waiting, ((i + 1) * period // slots[k], k, i + 1))


def one_period(slots: dict[str, int]) -> list[str]:
    """Earliest deadline first over the blocks of one period."""
    return list(itertools.islice(in_order(slots), sum(slots.values())))


def schedule(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> list[tuple]:
    """(class, first block, last block, first slot, slots a period, places) for each class in each phase.

    A period of more than ``period`` slots (and two for each class) isn't kept
    as one: its slots are listed one by one, in parts of ``period`` slots, as
    far as the blocks last.
    """
    left, done, now, rows = {k: n for k, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        slots = exact({k: weights.get(k, 1.0) for k in left})
        size, longest = sum(slots.values()), max(period, 2 * len(left))
        whole = min(left[k] // n for k, n in slots.items()) if size <= longest else 0
        # The slots after the whole periods, until a class lacks a block.
        spare, tail = {k: left[k] - whole * n for k, n in slots.items()}, []
        for k in in_order(slots):
            if not spare[k]:
                break
            spare[k] -= 1
            tail.append(k)
        if whole:
            order = one_period(slots)
            rows += _placed(order, done, now, whole, tail)
            now += whole * size + len(tail)
        else:
            for at in range(0, len(tail), longest):
                rows += _placed(tail[at : at + longest], done, now, 1, [])
                now += len(tail[at : at + longest])
        left = {k: blocks[k] - done[k] for k in left if blocks[k] > done[k]}
    return rows


def _placed(order: list[str], done: dict[str, int], now: int, times: int, tail: list[str]) -> list[tuple]:
    """Rows of ``order``, gone through so many times and then as far as ``tail``; ``done`` counts on."""
    places: dict[str, list[int]] = {}
    for at, k in enumerate(order):
        places.setdefault(k, []).append(at)
    more, rows = Counter(tail), []
    for k, where in places.items():
        took = times * len(where) + more[k]
        rows.append((k, done[k], done[k] + took - 1, now, len(order), where))
        done[k] += took
    return rows


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with the long columns mix_block (its block in its source's class), mix_slot and mix_position.

    Ordered by mix_position the rows interleave by the target weights; sources
    without a weight have 1. Every row is kept: a source that runs out leaves
    its slots to the others; a source of weight 0 goes last; a negative weight is
    a ValueError. Positions are distinct but not gapless (a source's last block
    may be short). Null is a source of its own. Rows with a null or repeated
    doc_id are placed like any other. An empty table gives no rows;
    other columns are carried along unless they have the names of the results,
    which replace them.
    """
    spark = docs.sparkSession
    # Other columns travel in one struct, so no name of theirs can clash with one below.
    kept = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_position")]
    docs = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.struct(*kept).alias("mix_row"))
    # A mark tells names from null, which has a class of its own.
    rows = numbered(docs.withColumn("mix_class", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "mix_class", "doc_id", "mix_number")
    counts = {r["source"]: -(-r["n"] // block_rows) for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    counts = {"" if k is None else f"={k}": n for k, n in counts.items()}
    order = schedule(counts, {f"={k}": w for k, w in (weights or {}).items()})
    plan = spark.createDataFrame(order, "p_class string, first long, last long, from_slot long, period long, places array<int>")
    plan = plan.withColumn("p_span", F.explode(F.sequence(F.floor(F.col("first") / SPAN), F.floor(F.col("last") / SPAN))))
    rows = rows.withColumn("mix_block", F.floor(F.col("mix_number") / block_rows))
    # Bounded: not more rows than blocks of the schedule; each block is in one row of it.
    same = (F.col("mix_class") == F.col("p_class")) & (F.floor(F.col("mix_block") / SPAN) == F.col("p_span"))
    placed = rows.join(F.broadcast(plan), same & F.col("mix_block").between(F.col("first"), F.col("last")))
    index = F.col("mix_block") - F.col("first")
    per = F.size("places")
    slot = F.col("from_slot") + F.floor(index / per) * F.col("period") + F.get("places", (index % per).cast("int"))
    position = F.col("mix_slot") * block_rows + F.col("mix_number") % block_rows
    return placed.withColumn("mix_slot", slot).select(*(F.col(f"mix_row.`{c}`") for c in kept), "mix_block", "mix_slot", position.alias("mix_position"))
