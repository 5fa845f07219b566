"""Near-duplicate vectors by lattice hashing: E8 cells of random projections, probing, exact cosine.

Each table projects a unit vector to eight dimensions and decodes it to the
nearest point of the lattice E8; that point and the nearest of its 240
neighbours around the projection are the cells it is looked up in. A pair is a
candidate when the own cell of one is among the cells of the other. The vectors
of a cell are compared in blocks of bounded size, by cosine in double
precision. Every vector carries all its cells, so that a pair is counted where
it meets first and nowhere else: a block gives the number of new links of each
vector and one tie to its group, never the pairs. Vectors that are equal are
one class from the start.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import small_batches, stage
from .words import mix, series

LEAST_COSINE = 0.93
#: With these, a pair at the threshold is found with a probability of 0.99, one at 0.95 with 0.9997.
TABLES, PROBES, SCALE = 12, 4, 1.0
#: Vectors of a cell that are compared with as many others at once.
BLOCK = 2048
#: Rows of cosines in memory at once, and pairs of blocks whose results are sent at once.
SLICE, SENT = 256, 512
_U = np.uint64


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def decoded(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 for each row: the nearer of those in D8 and in D8 shifted by one half."""

    def even(x: np.ndarray) -> np.ndarray:
        r = np.rint(x)
        rest = x - r
        odd = np.flatnonzero(r.sum(axis=1) % 2)
        worst = np.abs(rest).argmax(axis=1)[odd]
        r[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
        return r

    a, b = even(y), even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def _hashed(points: np.ndarray, salt: int) -> np.ndarray:
    whole = (points * 2).astype(np.int64).view(_U)
    return mix((mix(whole + series(53, 8)) * series(59, 8)).sum(axis=-1, dtype=_U) + _U(salt))


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Cell hashes (vectors, tables, 1 + probes), own cell first."""
    n, dim = unit.shape
    rng = np.random.default_rng(20_000 + dim)
    out = np.empty((n, tables, 1 + probes), _U)
    for t in range(tables):
        y = unit @ rng.standard_normal((dim, 8)) * scale
        own = decoded(y)
        # The nearest neighbours have the largest product of root and remainder.
        nearest = np.argpartition(-((y - own) @ ROOTS.T), probes, axis=1)[:, :probes]
        points = np.concatenate((own[:, None, :], own[:, None, :] + ROOTS[nearest]), axis=1)
        out[:, t] = _hashed(points, t)
    return out


def _by_size(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each length of vector."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.diff(vectors.offsets.to_numpy()))))
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = flat[offsets[rows][:, None] + np.arange(size)].astype(float)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, weight, label, embedding) to rep, weight, label, dim, cells (table by table, own cell first), unit."""
    for batch in batches:
        labels = mix(batch.column(2).to_numpy().view(_U) + _U(77))
        for rows, unit in _by_size(batch.column(3)):
            for at in range(0, len(rows), SLICE):
                some, x = rows[at : at + SLICE], unit[at : at + SLICE]
                keyed = mix(cells(x) + labels[some][:, None, None] + _U(x.shape[1])).view(np.int64).reshape(len(some), -1)
                picked = batch.take(pa.array(some))
                dims = pa.array(np.full(len(some), x.shape[1]))
                yield pa.RecordBatch.from_arrays([*picked.columns[:3], dims, _lists(keyed), _lists(x)], names=["rep", "weight", "label", "dim", "cells", "unit"])


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def _first_meeting(a: int, others: np.ndarray, tab: int, own: np.ndarray, rep: np.ndarray, cells_of: np.ndarray) -> np.ndarray:
    """Whether each pair of a and another meets in no earlier table, and in this one in no cell that counts before."""
    mine, theirs = cells_of[a, : tab + 1], cells_of[others, : tab + 1]
    probed = (theirs[:, :, :1] == mine).any(axis=2)  # a looks into the other's own cell
    probing = (theirs == mine[:, :1]).any(axis=2)
    met = (probed | probing)[:, :tab].any(axis=1)
    # Two that probe each other's own cell meet in both; that of the smaller number counts.
    twice = probed[:, tab] & probing[:, tab] & ~(own[a] & own[others])
    return ~met & (~twice | ((rep[others] > rep[a]) == own[a]))


def _compared(key: tuple, side: np.ndarray, own: np.ndarray, rep: np.ndarray, weight: np.ndarray, cells_of: np.ndarray, unit: np.ndarray) -> list[np.ndarray]:
    """Two blocks of a cell to (rep, a member of its group, number of links first met here)."""
    _, tab, _, _, first, second = key
    cells_of = cells_of.reshape(len(rep), TABLES, 1 + PROBES)
    left, right = np.flatnonzero(side == first), np.flatnonzero(side == second)
    linked, group = np.zeros(len(rep), np.int64), np.arange(len(rep))
    facing = unit[right].T
    for at in range(0, len(left), SLICE):
        some = left[at : at + SLICE]
        near = (unit[some] @ facing >= LEAST_COSINE) & (own[some][:, None] | own[right])
        if first == second:
            near &= right > some[:, None]
        for k in np.flatnonzero(near.any(axis=1)):
            a, others = some[k], right[near[k]]
            others = others[_first_meeting(a, others, tab, own, rep, cells_of)]
            if len(others):
                linked[a] += weight[others].sum()
                linked[others] += weight[a]
                groups = np.unique(group[np.append(others, a)])
                if len(groups) > 1:
                    group[np.isin(group, groups)] = groups[0]
    out = np.flatnonzero(linked)
    return [rep[out], rep[group[out]], linked[out]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, tab, label, dim, i, j), with side, own, rep, weight, cells and unit, to links by vector."""
    at, held, found = None, [], []

    def close() -> None:
        if sum(len(part[0]) for part in held) > 1:
            found.append(_compared(at, *(np.concatenate(c) for c in zip(*held, strict=True))))

    def sent() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["u", "v", "linked"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(6)], axis=1)
        rest = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6, 10)]
        known = batch.column(10).flatten().to_numpy().reshape(len(keys), -1)
        dims = keys[:, 3]
        starts = np.concatenate(([0], np.cumsum(dims)))
        flat = batch.column(11).flatten().to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in itertools.pairwise(cuts):
            key = tuple(keys[lo].tolist())
            if key != at:
                close()
                at, held = key, []
                if len(found) >= SENT:
                    yield sent()
                    found.clear()
            held.append((*(c[lo:hi] for c in rest), known[lo:hi], flat[starts[lo] : starts[hi]].reshape(hi - lo, -1)))
    close()
    yield sent()


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label are linked when the cosine is 0.93 or more. A null
    label or vec_id, and a vector that is null, empty, zero, or has null or
    non-finite components, is linked with nothing: n_links 0, component_id its
    vec_id, kept. So are vectors of different lengths with each other. Rows
    that repeat a vec_id and its vector are one vector. Different vectors of
    one vec_id are vectors of their own, each with its own n_links, in one
    component. An empty table gives no rows; other columns are ignored.
    """
    small_batches(vectors.sparkSession, 2000)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))
    # Two independent hashes: the second doesn't go on from the first, as it begins with another value.
    key = ["label", "low", "high"]
    hashed = rows.select("vec_id", "label", F.when(usable, F.xxhash64("embedding")).alias("low"), F.when(usable, F.xxhash64(F.lit(1), "embedding")).alias("high"))
    keyed = stage(hashed, "keyed")
    named = keyed.where("low is not null").distinct()
    # A set is a label and a vector; its number is fixed once written.
    sets = named.groupBy(*key).agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")).withColumn("rep", F.monotonically_increasing_id())
    sets = stage(sets, "sets")
    named = stage(named.join(sets.select(*key, "rep"), key), "named")
    firsts = sets.select("rep", "weight", *key, F.col("first").alias("vec_id"))
    whole = rows.where(usable).withColumns({"low": F.xxhash64("embedding"), "high": F.xxhash64(F.lit(1), "embedding")}).join(firsts, ["vec_id", *key])
    whole = whole.select("rep", "weight", "label", "embedding").dropDuplicates(["rep"])
    whole = stage(whole.mapInArrow(_placed, "rep long, weight long, label long, dim long, cells array<long>, unit array<double>"), "whole")
    placed = whole.select("rep", F.posexplode("cells").alias("pos", "cell"))
    placed = placed.select("rep", "cell", F.floor(F.col("pos") / (1 + PROBES)).alias("tab"), (F.col("pos") % (1 + PROBES) == 0).alias("own"))
    shared = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own").select("cell", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    dealt = placed.join(stage(shared, "shared"), "cell").withColumn("side", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("cell", "tab", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "own", "rep").join(whole, "rep")
    order = ["cell", "tab", "label", "dim", "i", "j"]
    dealt = dealt.select(*order, "side", "own", "rep", "weight", "cells", "unit").repartition("cell", "tab", "i", "j").sortWithinPartitions(*order)
    links = stage(dealt.mapInArrow(_blocks, "u long, v long, linked long"), "links")
    counted = links.groupBy(F.col("u").alias("rep")).agg(F.sum("linked").alias("linked"))
    # Sets that share a vec_id are tied through the first of them.
    several = named.groupBy("vec_id").agg(F.min("rep").alias("u"), F.max("rep").alias("last")).where("u <> last").select("vec_id", "u")
    ties = named.join(several, "vec_id").select("u", F.col("rep").alias("v")).where("u <> v")
    classes = components(links.select("u", "v").unionByName(ties))
    rooted = stage(sets.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "first", "weight", F.coalesce("root", "rep").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    per_set = rooted.join(least, "root").join(counted, "rep", "left").select("rep", "component_id", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    result = stage(named.join(stage(per_set, "per_set"), "rep").select("vec_id", *key, "n_links", "component_id"), "result")
    out = keyed.join(result, ["vec_id", *key], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
