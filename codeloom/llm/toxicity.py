"""Toxicity scores by a convolutional text classifier trained in numpy.

A word's embedding is the sum of those of its hash and of the hashes of its
prefixes of 3 to 8 bytes, so that inflected forms share what is learnt of their
stem. Hashes that occur in several texts of the training sample have an
embedding (found by hash place, checked by a fingerprint), all others are zero. Filters of widths 1, 2 and 3 run over the
whole text, each is max-pooled, and a logistic layer on the pooled values gives
the score, which is then calibrated on sample rows kept back from training.

The sample is bounded by ``Limits``: so many labelled texts of each class,
picked by a hash of their id among rows outside the held-out fold. A sample
text may have up to ``sample_chars`` characters; what is scored has no limit.
One task trains on it: the driver sees neither the texts nor the gradients, only
the arrays of the model.
The threshold of a language is calibrated on all its labelled rows outside the
held-out fold that the classifier wasn't trained on, of any length, by counts
of their scores. The counts of all languages together have a small weight in
each, so that one with few labelled rows leans on them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, stage
from .words import NOT_ALNUM, hashed_words

FOLDS = 5
WIDTHS = (1, 2, 3)
PREFIXES = (3, 4, 5, 6, 7, 8)
FILTERS, SIZE = 8, 8
TABLE_BITS = 18
_U = np.uint64


@dataclass(frozen=True)
class Limits:
    """Bounds of the training sample, and the training schedule."""

    per_class: int = 2000
    sample_chars: int = 20_000
    least_texts: int = 3
    epochs: int = 5
    least_steps: int = 800
    batch: int = 64
    rate: float = 0.02
    kept_back: int = 5
    places: int = 1000
    pooled_rows: float = 10.0


@dataclass
class Model:
    """Hash table of words, weights, calibration. ``filters[w][j]`` has place j of the filters of the w-th width."""

    slots: np.ndarray = field(default_factory=lambda: np.zeros(1 << TABLE_BITS, np.int32))
    prints: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint32))
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((1, SIZE), np.float32))
    filters: list = field(default_factory=list)
    bias: list = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    scale: float = 1.0
    shift: float = 0.0

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        slot = self.slots[(hashes >> _U(64 - TABLE_BITS)).astype(np.int64)]
        return np.where(self.prints[slot] == (hashes & _U(0xFFFFFFFF)).astype(np.uint32), slot, 0)


def fold(column: str = "doc_id") -> Column:
    """The fold of a document; 0 is held out. A null id is in fold 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS, F.lit(1))


def _kept_back(limits: Limits) -> Column:
    """Whether a labelled row is for calibration even if the sample holds it: one in ``kept_back``."""
    return F.pmod(F.xxhash64("doc_id", F.lit("back")), F.lit(limits.kept_back)) == 0


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): one row for each labelled document outside the held-out fold."""
    return stage(labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold() != 0), "known")


def picked_ids(known: DataFrame, limits: Limits) -> DataFrame:
    """The labelled documents of the sample, at most ``per_class`` of each class."""
    some = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limits.per_class) for label in (0, 1)]
    return stage(some[0].unionByName(some[1]), "picked")


def sample(docs: DataFrame, picked: DataFrame, limits: Limits) -> DataFrame:
    """At most ``2 * per_class`` rows (toxic, text, kept back) for training, in order and in one partition."""
    small_batches(docs.sparkSession)
    # Bounded: at most 2 * per_class rows of two integers.
    rows = docs.where(F.length("text") <= limits.sample_chars).join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text", _kept_back(limits).alias("back"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * limits.per_class).select("toxic", "text", "back").coalesce(1)


def fitted(rows: DataFrame, limits: Limits) -> bytes:
    """The model of the sample ``rows``, as pickled plain arrays."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(train(held, limits)))], pa.binary())], names=["model"])

    # One row of a few MB; an empty sample may have no task.
    found = rows.mapInArrow(fit, "model binary").collect()
    return bytes(found[0]["model"]) if found else pickle.dumps(vars(train([], limits)))


def _words(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(hashes of each distinct word and its prefixes, the texts as numbers of these words)."""
    rows, numbers, ends = [], [], [0]
    for _, hashes, offsets in hashed_words(pa.array(texts, pa.string()), NOT_ALNUM, PREFIXES):
        _, first, inverse = np.unique(hashes[:, 0], return_index=True, return_inverse=True)
        numbers.append(inverse.astype(np.int32) + sum(map(len, rows)))
        rows.append(hashes[first])
        ends.extend(ends[-1] + np.diff(offsets).cumsum())
    every = np.concatenate(rows) if rows else np.zeros((0, 1 + len(PREFIXES)), _U)
    _, first, inverse = np.unique(every[:, 0], return_index=True, return_inverse=True)
    numbers = inverse.astype(np.int32)[np.concatenate(numbers)] if numbers else np.zeros(0, np.int32)
    return every[first], [numbers[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _vocabulary(words: np.ndarray, texts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, prints): words and prefixes of at least ``least`` texts; of two with one hash place the more frequent stays."""
    keys, numbers = np.unique(words, return_inverse=True)
    numbers = numbers.astype(np.int32).reshape(words.shape)
    counts = np.zeros(len(keys), np.int32)
    for t in texts:
        counts[np.unique(numbers[np.unique(t)])] += 1
    counts[keys == 0] = 0
    order = np.argsort(counts, kind="stable")
    keys = keys[order][counts[order] >= least]
    slots = np.zeros(1 << TABLE_BITS, np.int32)
    slots[(keys >> _U(64 - TABLE_BITS)).astype(np.int64)] = np.arange(1, len(keys) + 1, dtype=np.int32)
    return slots, np.concatenate(([0], (keys & _U(0xFFFFFFFF)).astype(np.uint32))).astype(np.uint32)


def _flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of several texts, raised by one, with zeros before each and at the end, and where each begins with its zeros.

    A window that begins in the zeros before a text covers these and its first
    words, one that begins at its last words the zeros that follow: none
    reaches another text.
    """
    gap = np.zeros(max(WIDTHS), np.int32)
    starts = np.cumsum([0] + [len(t) + len(gap) for t in texts])
    starts[-1] += len(gap)
    return np.concatenate([x for t in texts for x in (gap, t + 1)] + [gap]), starts


def _pooled(x: np.ndarray, filters: list, flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Sums of each window, by width; the last places of ``flat`` are gaps."""
    n = len(flat)
    out = []
    for parts in filters:
        total = (x @ parts[0])[flat]
        for j in range(1, len(parts)):
            total[: n - j] += (x @ parts[j])[flat[j:]]
        out.append(total)
    return out


def _logits(model: Model, words: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Raw scores of texts given as numbers of rows of ``words``."""
    x = np.concatenate((np.zeros((1, SIZE), np.float32), model.embedding[model.lookup(words)].sum(axis=1)))
    flat, starts = _flat(texts)
    pooled = [np.maximum(np.maximum.reduceat(t, starts[:-1], axis=0) + b, 0) for t, b in zip(_pooled(x, model.filters, flat, starts), model.bias, strict=True)]
    return np.concatenate(pooled, axis=1) @ model.out[:-1] + model.out[-1]


def train(rows: list, limits: Limits = Limits(), seed: int = 7) -> Model:
    """Fit embeddings, filters and the output layer by Adam on (toxic, text, kept back) rows, then calibrate on those kept back."""
    rng = np.random.default_rng(seed)
    y = np.array([r[0] for r in rows], np.float32)
    model = Model()
    if len(rows) < 10 or y.min() == y.max():
        model.filters = [[np.zeros((SIZE, FILTERS), np.float32)] * w for w in WIDTHS]
        model.bias = [np.zeros(FILTERS, np.float32)] * len(WIDTHS)
        model.out = np.zeros(FILTERS * len(WIDTHS) + 1, np.float32)
        model.shift = float(4 if len(y) and y.mean() == 1 else -4)
        return model
    words, texts = _words([r[1] for r in rows])
    aside = np.array([bool(r[2]) for r in rows])
    use = np.flatnonzero(~aside) if not aside.all() else np.arange(len(rows))
    back = np.flatnonzero(aside)
    model.slots, model.prints = _vocabulary(words, [texts[i] for i in use], limits.least_texts)
    features = np.concatenate((np.zeros((1, 1 + len(PREFIXES)), np.int64), model.lookup(words)))
    shapes = {"E": (len(model.prints), SIZE), "o": (FILTERS * len(WIDTHS) + 1,)} | {f"b{w}": (FILTERS,) for w in WIDTHS} | {f"W{w}": (w, SIZE, FILTERS) for w in WIDTHS}
    p = {k: (rng.standard_normal(s) * (0.02 if k == "E" else 0.4 if k[0] in "Wo" else 0)).astype(np.float32) for k, s in shapes.items()}
    p["E"][0] = 0
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, rounds = 0, max(limits.epochs, min(60, -(-limits.least_steps * limits.batch // len(use))))
    for _ in range(rounds):
        rng.shuffle(use)
        for at in range(0, len(use), limits.batch):
            step += 1
            some = use[at : at + limits.batch]
            for k, g in _gradients(p, features, [texts[i] for i in some], y[some]).items():
                where, g = g if k == "E" else (slice(None), g)
                first[k][where] = first[k][where] * 0.9 + 0.1 * g
                second[k][where] = second[k][where] * 0.999 + 0.001 * g * g
                p[k][where] -= limits.rate * (1 if k == "E" else 0.5) * (first[k][where] / (1 - 0.9**step)) / (np.sqrt(second[k][where] / (1 - 0.999**step)) + 1e-6)
    model.embedding, model.filters = p["E"], [list(p[f"W{w}"]) for w in WIDTHS]
    model.bias, model.out = [p[f"b{w}"] for w in WIDTHS], p["o"]
    _calibrate(model, words, [texts[i] for i in back], y[back])
    return model


def _gradients(p: dict, features: np.ndarray, texts: list[np.ndarray], y: np.ndarray) -> dict:
    """Gradients of the log loss over one batch; those of the embedding as (rows, values)."""
    flat, starts = _flat(texts)
    held, flat = np.unique(flat, return_inverse=True)
    x = p["E"][features[held]].sum(axis=1)
    n = len(flat)
    pooled, best = [], []
    for total, w in zip(_pooled(x, [list(p[f"W{w}"]) for w in WIDTHS], flat, starts), WIDTHS, strict=True):
        at = np.stack([a + total[a:b].argmax(axis=0) for a, b in zip(starts[:-1], starts[1:], strict=True)])
        best.append(at)
        pooled.append(np.take_along_axis(total, at, axis=0) + p[f"b{w}"])
    pre = np.concatenate(pooled, axis=1)
    act = np.maximum(pre, 0)
    score = 1 / (1 + np.exp(-np.clip(act @ p["o"][:-1] + p["o"][-1], -30, 30)))
    err = (score - y) / len(y)
    grads = {"o": np.append(act.T @ err, err.sum()) + 1e-4 * p["o"]}
    back = np.outer(err, p["o"][:-1]) * (pre > 0)
    where, deltas = [], []
    for i, w in enumerate(WIDTHS):
        g, at = back[:, i * FILTERS : (i + 1) * FILTERS], best[i]
        grads[f"b{w}"] = g.sum(axis=0)
        grads[f"W{w}"] = np.zeros_like(p[f"W{w}"])
        for j in range(w):
            place = flat[np.minimum(at + j, n - 1)]
            grads[f"W{w}"][j] = np.einsum("df,dfs->sf", g, x[place])
            where.append(features[held[place]].reshape(-1, features.shape[1]))
            deltas.append((g[:, :, None] * p[f"W{w}"][j].T[None]).reshape(-1, SIZE))
    where, deltas = np.concatenate(where), np.concatenate(deltas)
    live = (deltas != 0).any(axis=1)
    rows, inverse = np.unique(where[live], return_inverse=True)
    total = np.zeros((len(rows), SIZE), np.float32)
    for c in range(where.shape[1]):
        np.add.at(total, inverse.reshape(-1, where.shape[1])[:, c], deltas[live])
    total[rows == 0] = 0
    grads["E"] = rows, total
    return grads


def _calibrate(model: Model, words: np.ndarray, texts: list, y: np.ndarray) -> None:
    """Fit scale and shift of the logit by Newton steps with a prior toward the raw logit."""
    z = np.concatenate([_logits(model, words, texts[i : i + 256]) for i in range(0, len(texts), 256)] or [np.zeros(0)]).astype(float)
    at = np.array([1.0, 0.0])

    def cost(ab: np.ndarray) -> float:
        v = ab[0] * z + ab[1]
        return float((np.logaddexp(0, v) - y * v).sum() + 2 * (ab[0] - 1) ** 2 + 0.1 * ab[1] ** 2)

    for _ in range(25):
        s = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -30, 30)))
        v = s * (1 - s)
        slope = np.array([((s - y) * z).sum() + 4 * (at[0] - 1), (s - y).sum() + 0.2 * at[1]])
        bend = np.array([[(v * z * z).sum() + 4, (v * z).sum()], [(v * z).sum(), v.sum() + 0.2]])
        move = np.linalg.solve(bend, slope)
        while cost(at - move) > cost(at) and abs(move).max() > 1e-6:
            move = move / 2
        at = at - move
    a, b = at
    model.scale, model.shift = float(max(a, 0.05)), float(b)


def thresholds(counts: list[tuple], limits: Limits = Limits()) -> dict[str, float]:
    """The threshold of each language with the fewest errors, from (language, toxic, place of the score, rows) counts.

    All languages' counts together weigh as much as ``pooled_rows`` rows in
    each, and as many more are evenly spread on the right sides of 0.5, where a
    calibrated score has its threshold. Of several best ones it is the middle one.
    """
    tries = np.linspace(0.1, 0.9, 33)
    every: dict[str, np.ndarray] = {}
    for lang, toxic, place, n in counts:
        every.setdefault(lang, np.zeros((2, len(tries) + 1)))[toxic, np.searchsorted(tries * limits.places, place + 0.5, side="right")] += n
    pooled = sum(every.values(), np.zeros((2, len(tries) + 1)))
    half = (len(tries) + 1) // 2
    prior = np.zeros_like(pooled)
    prior[0, :half] = prior[1, half:] = limits.pooled_rows / 2 / half
    out = {}
    for lang, own in every.items():
        clean, toxic = own + pooled * (limits.pooled_rows / pooled.sum()) + prior
        # Clean rows at or over each threshold, and toxic ones below it.
        errors = clean[::-1].cumsum()[::-1][1:] + toxic.cumsum()[:-1]
        out[lang] = float(np.median(tries[errors <= errors.min() + 1e-9]))
    return out


def scores(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, lang_threshold, flagged.

    ``flagged`` compares the score with the threshold of the row's language,
    ``predicted`` with 0.5. The score depends on the text alone. Null and empty
    texts get the score of a text without words; a language without labelled
    rows has the threshold 0.5, a null one is a language of its own; rows that
    repeat get one row each; labels that are null or neither 0 nor 1 are
    ignored, of several the largest counts. Without labels of both classes all
    scores are the same. Empty tables give no rows; of other columns those
    named in ``extra`` are carried along.
    """
    spark = docs.sparkSession
    extra = tuple(c for c in extra if c != "doc_id")
    asked = F.struct("doc_id", *extra).alias("row")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    own = docs.select(asked, lang.alias("lang"), F.col("text").cast("string").alias("text"))
    known = known_labels(labels)
    picked = picked_ids(known, limits)
    # Plain arrays: workers need no class of this package to read them.
    model = spark.sparkContext.broadcast(fitted(sample(docs, picked, limits), limits))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**pickle.loads(model.value))
        for batch in batches:
            for at, hashes, offsets in hashed_words(batch.column(2), NOT_ALNUM, PREFIXES):
                _, first, inverse = np.unique(hashes[:, 0], return_index=True, return_inverse=True)
                texts = [inverse[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                z = np.clip(m.scale * _logits(m, hashes[first], texts).astype(float) + m.shift, -30, 30)
                s = 1 / (1 + np.exp(-z))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(s)), batch.column(1).slice(at, len(s)), pa.array(s)], names=["row", "lang", "score"])

    kind = own.schema["row"].dataType.simpleString()
    scored = stage(own.mapInArrow(score, f"row {kind}, lang string, score double"), "scored")
    trained = picked.where(~_kept_back(limits)).select("doc_id")
    rest = known.join(F.broadcast(trained), "doc_id", "left_anti")
    place = F.floor(F.col("score") * limits.places)
    counts = scored.select(F.col("row.doc_id").alias("doc_id"), "lang", place.alias("place")).join(rest, "doc_id").groupBy("lang", "toxic", "place").agg(F.count("*").alias("n"))
    # Bounded: languages times two labels times ``places``.
    found = thresholds([tuple(r) for r in counts.collect()], limits)
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in found.items() for x in pair)), F.col("lang")), F.lit(0.5)) if found else F.lit(0.5)
    out = scored.withColumn("lang_threshold", limit)
    verdict = [(F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("flagged")]
    return out.select("row.doc_id", (fold("row.doc_id") == 0).alias("held_out"), "score", *verdict, *(f"row.{c}" for c in extra))
