"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

Sketch: in round i each shingle is thrown into one of t bins (rounds 0 to t-1:
a hashed bin; rounds t to 2t-1: all into bin i-t) with the value i + hash, and a
bin keeps its least value. A text is done when all its bins are filled, so
every coordinate fills after at most 2t rounds and two sets agree in a
coordinate with their Jaccard similarity as probability, with concentration as
for t independent coordinates.

Banding: 45 bands of 5 coordinates. A pair at the threshold of 0.75 misses all
of them with a probability of 5e-6.

Verification never lists the pairs of a bucket. Sets that are equal are one
class from the start. Each round, as long as the last one found enough links,
picks a leader in each bucket and compares
every other member with the leader it shares most bands with; what passes is
contracted. Members of a bucket whose classes still differ are then compared in
blocks of bounded size, each pair in its first common bucket only: where sizes
fit and the sketches' estimate is within five deviations of the threshold, the
sets are compared. Only links leave a block, never candidate pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, few_components
from .shared import small_batches, stage
from .words import hashed_words, mix, series, shingles

BANDS, ROWS = 45, 5
WIDTH = 5
#: Similarity as a fraction: 75 / 100.
NUMERATOR, DENOMINATOR = 75, 100
#: Leader rounds before pairs across classes are compared one by one.
ROUNDS = 3
#: A round after which fewer than one in so many comparisons was a link is the last: blocks do the rest.
WORTH = 20
#: Rows of a bucket in a block; larger buckets are compared block by block.
BLOCK = 512
#: Coordinates that must agree before a pair is verified: at 0.75 of 225, five deviations of 6.5 less.
AGREE = 135
#: Members of one leader that one task compares.
MEMBERS = 64
#: Links up to which one task finds the classes (2 MB of them); more take rounds of shuffles.
FEW = 100_000

_U = np.uint64


def sketch(elements: np.ndarray, offsets: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """Sketches of many sets at once, one row of t values each; an empty set has all bits set.

    ``elements`` holds the sets' distinct 64-bit hashes one after the other,
    ``offsets`` where each begins.
    """
    n = len(offsets) - 1
    out = np.full(n * t, ~_U(0), _U)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    seeds = series(37, 2 * t)
    x = elements
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x ^ seeds[i])
        place = (((h >> _U(32)) * _U(t)) >> _U(32)).astype(np.int64) if i < t else np.full(len(x), i - t)
        np.minimum.at(out, owner * t + place, (_U(i) << _U(32)) | (h & _U(0xFFFFFFFF)))
        if i >= 1:
            unfilled = (out.reshape(n, t) == ~_U(0)).any(axis=1)
            keep = unfilled[owner]
            x, owner = x[keep], owner[keep]
    return out.reshape(n, t)


def _band_keys(rows: np.ndarray) -> np.ndarray:
    weights = series(41, ROWS)
    shaped = rows.reshape(len(rows), BANDS, ROWS)
    total = np.zeros((len(rows), BANDS), _U)
    for j in range(ROWS):
        total += shaped[:, :, j] * weights[j]
    return mix(total + series(43, BANDS)[None, :]).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, hashes, offsets in hashed_words(batch.column(1)):
            sets, ends = shingles(hashes, offsets, WIDTH)
            n = np.diff(ends)
            low = np.array([int(sets[a:b].sum(dtype=_U)) for a, b in zip(ends[:-1], ends[1:], strict=True)], _U)
            high = np.array([int(np.bitwise_xor.reduce(mix(sets[a:b] + _U(1)))) if b > a else 0 for a, b in zip(ends[:-1], ends[1:], strict=True)], _U)
            rows = sketch(sets, ends)
            keys, bytes_ = _band_keys(rows), mix(rows).astype(np.uint8)
            full = n > 0
            starts = np.concatenate(([0], np.cumsum(np.where(full, BANDS, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(n)), pa.array(n.astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.ListArray.from_arrays(pa.array(starts), pa.array(keys[full].ravel())), pa.array([x.tobytes() for x in bytes_], pa.binary())],
                names=["doc_id", "n", "low", "high", "bands", "sketch"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n, low, high, bands, sketch): set size, a 128-bit key of the set, 45 band keys (none for an empty set), a byte of each coordinate."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_signatures, "doc_id long, n long, low long, high long, bands array<long>, sketch binary")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by leader and part, the leader's own row first; yields the pairs that are similar enough."""
    at_leader, held = None, np.zeros(0, _U)
    for batch in batches:
        leader, part, is_member, member = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        found_u, found_v = [], []
        for at, hashes, offsets in hashed_words(batch.column(4)):
            sets, ends = shingles(hashes, offsets, WIDTH)
            for k in range(len(ends) - 1):
                row, own = at + k, sets[ends[k] : ends[k + 1]]
                if not is_member[row]:
                    at_leader, held = (leader[row], part[row]), own
                elif at_leader == (leader[row], part[row]) and len(own) and len(held):
                    common = _common(held, own)
                    if DENOMINATOR * common >= NUMERATOR * (len(own) + len(held) - common):
                        found_u.append(member[row])
                        found_v.append(leader[row])
        yield pa.RecordBatch.from_arrays([pa.array(found_u, pa.int64()), pa.array(found_v, pa.int64())], names=["u", "v"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The staged (leader, member) pairs whose shingle sets are similar enough, as (u, v) links.

    A leader's text goes once to each task that compares up to ``MEMBERS`` of
    its members, so a hot leader is spread over tasks.
    """
    hot = stage(pairs.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS), "hot")
    parts = F.coalesce(F.ceil(F.col("n") / MEMBERS), F.lit(1))
    pairs = pairs.join(hot, "leader", "left").select("leader", "member", F.pmod(F.xxhash64("member"), parts).cast("int").alias("part"))
    leaders = pairs.select("leader", "part").distinct().join(texts.withColumnRenamed("doc_id", "leader"), "leader").select("leader", "part", F.lit(False).alias("is_member"), F.col("leader").alias("member"), "text")
    members = pairs.join(texts.withColumnRenamed("doc_id", "member"), "member").select("leader", "part", F.lit(True).alias("is_member"), "member", "text")
    dealt = leaders.unionByName(members).repartition("leader", "part").sortWithinPartitions("leader", "part", "is_member")
    return dealt.mapInArrow(_compare, "u long, v long")


def _classes(links: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(node, root) by staged (u, v) links and by the classes so far, which stand for the links before."""
    edges = links
    if classes is not None:
        edges = classes.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links)
    return stage(few_components(edges) if edges.count() <= FEW else components(edges), "classes")


def _best(rows: DataFrame) -> DataFrame:
    """Of (leader, member) rows, one a shared band, the leader that each member shares most bands with."""
    shared = rows.groupBy("leader", "member").agg(F.count("*").alias("n"))
    return shared.groupBy("member").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))


def _fits(a: str, b: str):
    """Sizes that allow the similarity."""
    return (DENOMINATOR * F.least(a, b)) >= (NUMERATOR * F.greatest(a, b))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their sets of five-word
    shingles is 0.75 or more; component_id is the smallest doc_id reachable
    over links; kept is true for that document.

    Null text: as empty. Empty texts and texts without words: n_shingles 0,
    linked with nothing. Rows that share a doc_id count as one document and
    give one row each. Null doc_id: linked with nothing, component_id null,
    kept true. Other columns are ignored. An empty table gives no rows.
    """
    sig = stage(signatures(docs), "signatures")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = ["low", "high", "n"]
    full = sig.where("doc_id is not null and n > 0")
    sets = stage(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "sets")
    reps = full.join(sets.select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"], "left_semi")
    banded = reps.select("doc_id", "n", F.explode("bands").alias("band"))
    many = stage(banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band"), "buckets")
    members = stage(banded.join(many, "band"), "members")
    texts = stage(texts.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "candidates")

    classes = None
    for k in range(ROUNDS):
        rooted, mixed = _open(members, classes, k)
        rows = rooted.join(mixed, "band").where(F.col("root") != F.col("lead.root")).withColumn("lead_n", F.col("lead.n")).where(_fits("n", "lead_n"))
        pairs = _best(rows.select(F.col("lead.doc_id").alias("leader"), F.col("doc_id").alias("member")))
        pairs = stage(pairs.select("leader", "member"), "round")
        compared = pairs.count()
        if not compared:
            break
        links = stage(verified(pairs, texts), "links")
        classes = _classes(links, classes)
        if k == ROUNDS - 1 or links.count() < compared / WORTH:
            rooted, mixed = _open(members, classes, k + 1)
            break
    sketches = reps.select("doc_id", "sketch", "bands").dropDuplicates(["doc_id"])
    # Rows that share a doc_id tie their sets together.
    tied = full.join(sets.where("rep <> last"), key).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    classes = _classes(stage(_across(rooted, mixed, sketches, texts).unionByName(tied), "links"), classes)
    named = stage(sets.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("root", "rep").alias("component_id")), "named")
    out = sig.select("doc_id", *key).join(named, key, "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _open(members: DataFrame, classes: DataFrame | None, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows of buckets with the class of each, and the buckets whose rows aren't all of one: (band, m rows, lead of round ``k``)."""
    rooted = members.withColumn("root", F.col("doc_id"))
    if classes is not None:
        rooted = stage(members.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "rooted")
    lead = F.min_by(F.struct("doc_id", "n", "root"), F.xxhash64("doc_id", F.lit(k)) if k else F.col("doc_id"))
    buckets = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m"), lead.alias("lead"))
    return rooted, stage(buckets.where("a <> b").select("band", "m", "lead"), "mixed")


class _Block:
    """Rows of two blocks of a bucket; ``links`` gives the pairs that are similar enough."""

    def __init__(self, key: tuple, rows: list[tuple]) -> None:
        self.key, self.rows = key, rows
        self.side, self.doc, self.n, self.root = (np.array([r[k] for r in rows]) for k in range(4))
        self.marks = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        self.bands = np.array([r[5] for r in rows], np.int64)
        self.sets: dict[int, np.ndarray] = {}

    def set_of(self, i: int) -> np.ndarray:
        if i not in self.sets:
            _, hashes, offsets = next(hashed_words(pa.array([self.rows[i][6]], pa.string())))
            self.sets[i] = shingles(hashes, offsets, WIDTH)[0]
        return self.sets[i]

    def links(self) -> list[tuple[int, int]]:
        band, first, second = self.key
        left, right = np.flatnonzero(self.side == first), np.flatnonzero(self.side == second)
        found = []
        for i in left:
            others = right[self.root[right] != self.root[i]]
            others = others[DENOMINATOR * np.minimum(self.n[others], self.n[i]) >= NUMERATOR * np.maximum(self.n[others], self.n[i])]
            if first == second:
                others = others[others > i]
            others = others[(self.marks[others] == self.marks[i]).sum(axis=1) >= AGREE]
            same = self.bands[others] == self.bands[i]
            for o in others[self.bands[i][same.argmax(axis=1)] == band] if len(others) else []:
                a, b = self.set_of(i), self.set_of(o)
                common = _common(a, b)
                if DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common):
                    found.append((int(self.doc[i]), int(self.doc[o])))
        return found


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted, distinct, non-empty arrays share."""
    where = np.searchsorted(a, b)
    where[where == len(a)] = 0
    return int((a[where] == b).sum())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, i, j) to links (u, v)."""
    at, held = None, []

    def links() -> pa.RecordBatch:
        found = _Block(at, held).links() if len(held) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        band, i, j, *rest = (batch.column(k).to_pylist() for k in range(10))
        for key, row in zip(zip(band, i, j, strict=True), zip(*rest, strict=True), strict=True):
            if key != at:
                yield links()
                at, held = key, []
            held.append(row)
    yield links()


def _across(rooted: DataFrame, mixed: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between rows of one bucket whose classes differ."""
    rows = stage(rooted.join(mixed.select("band", F.ceil(F.col("m") / BLOCK).alias("blocks")), "band"), "open")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    whole = stage(sketches.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").join(texts, "doc_id"), "whole")
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "n", "root").join(whole, "doc_id")
    dealt = dealt.select("band", "i", "j", "own", "doc_id", "n", "root", "sketch", "bands", "text").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(_blocks, "u long, v long")
