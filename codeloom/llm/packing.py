"""Best-fit packing of tokenised documents into sequences of fixed length.

Each task packs its rows as they come with a bounded number of open bins. A
bitset has bit f set when some open bin has f tokens free, so the best fit for
a piece of n tokens is the lowest set bit at or above n, found with two bit
operations. When a new bin is needed and all are open, the fullest one closes.
Bins that are still open when a task ends are packed again, whole, across
tasks, by the same rule on their lengths, in ever fewer tasks.

Tokens are those of a public tokenizer whose file is a parameter. It never joins
tokens across white space, so ids are looked up by blank-separated chunk in a
bounded cache, and the tokenizer runs only on chunks that aren't in it; where it
folds case, Latin-1 texts are folded first. Texts
with special tokens in them or with control characters on which the notions of
white space differ go to the tokenizer whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, stage

LENGTH = 2048
OPEN_BINS = 64
#: Distinct chunks whose ids a task holds at most.
CACHE = 300_000
#: Tasks' leftovers that one task of the next round packs.
FAN_IN = 16
END = b"\x00\x00\x00\x00"
# What a special token begins with, and characters that str.split takes for white space but the tokenizer doesn't.
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: A word of Latin-1 letters with ASCII marks around it, no apostrophe: the tokenizer cuts it just there.
_PLAIN = re.compile("([!-&(-/:-@\\[-_{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-_{-~]*)")


class BestFit:
    """Bounded-space online best-fit: ``put`` returns (bin number, offset)."""

    def __init__(self, length: int, bins: int) -> None:
        self.length, self.bins = length, bins
        self.by_free: dict[int, list[int]] = {}
        self.bits = 0
        self.count = 0
        self.made = 0

    def _add(self, free: int, name: int) -> None:
        self.by_free.setdefault(free, []).append(name)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        names = self.by_free[free]
        name = names.pop()
        if not names:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return name

    def put(self, n: int) -> tuple[int, int]:
        fitting = self.bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            name = self._take(free)
        else:
            if self.count >= self.bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, name = self.length, self.made
            self.made += 1
        if free > n:
            self._add(free - n, name)
        return name, self.length - free

    def open(self) -> dict[int, int]:
        """Free space of the bins that are still open."""
        return {name: free for free, names in self.by_free.items() for name in names}


class Recent:
    """What was looked up lately, in two plain dictionaries; when ``newer`` is full, it becomes ``older``, which goes."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def lacking(self, keys: set) -> list:
        """Those of ``keys`` that aren't known; the others are in ``newer`` afterwards."""
        out = keys.difference(self.newer)
        if len(self.newer) + len(out) > self.most:
            self.older, self.newer, out = self.newer, {}, keys
        found = [k for k in out if k in self.older]
        self.newer.update((k, self.older[k]) for k in found)
        return list(out.difference(found))


def folded(text: str | None) -> str:
    """Lower case where Python and the tokenizer agree on it, character by character: texts of Latin-1."""
    if text and not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return (text or "").lower()


def token_source(path: str) -> Callable[[], Callable[[list], list[bytes]]]:
    """A maker, for workers, of a function from texts to their ids as little-endian 32-bit bytes, each with id 0 at the end."""

    def make() -> Callable[[list], list[bytes]]:
        import os
        import sys
        import types

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        # A worker serves task after task; what it has looked up stays with the process.
        kept = sys.modules.setdefault("_codeloom_tokens", types.ModuleType("_codeloom_tokens"))
        if getattr(kept, "path", None) != path:
            from tokenizers import Tokenizer

            kept.path, kept.tokenizer, kept.whole = path, Tokenizer.from_file(path), Tokenizer.from_file(path)
            # Words that go to the tokenizer are new to it: its own cache would only cost time.
            getattr(kept.tokenizer.model, "_resize_cache", int)(0)
            normal = kept.whole.normalizer
            kept.folds = normal is not None and all(normal.normalize_str(x) == normal.normalize_str(x.lower()) for x in map(chr, range(256)))
            names = kept.tokenizer.get_vocab()
            kept.last = np.zeros(max(names.values()) + 1, bool)
            kept.last[[i for name, i in names.items() if name.endswith("</w>")]] = True
            kept.chunks = Recent(CACHE)
        known = kept.chunks

        def encode(texts: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for i in range(0, len(texts), 10_000) for e in kept.whole.encode_batch_fast(texts[i : i + 10_000], add_special_tokens=False)]

        def encode_plain(parts: list[str]) -> list[bytes]:
            """Ids of parts that the tokenizer doesn't cut: many in one text, told apart by their last tokens."""
            out = []
            for i in range(0, len(parts), 1000):
                some = parts[i : i + 1000]
                ids = np.array(kept.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
                last = np.flatnonzero(kept.last[ids]) + 1
                if len(last) != len(some):
                    out.extend(encode(some))
                    continue
                data, at = ids.tobytes(), 0
                for end in (last * 4).tolist():
                    out.append(data[at:end])
                    at = end
            return out

        def learn(chunks: set) -> None:
            """A plain chunk's ids are those of its parts, so a word is looked up once for all marks around it."""
            words, plain, cuts, whole, parts = [], [], [], [], set()
            for chunk in known.lacking(chunks):
                if chunk.isascii() and chunk.isalpha():
                    words.append(chunk)
                    continue
                cut = _PLAIN.fullmatch(chunk)
                if cut:
                    plain.append(chunk)
                    cuts.append(cut.groups())
                    parts.update(cuts[-1])
                else:
                    whole.append(chunk)
            ids = {part: known.newer.get(part) or known.older.get(part) for part in parts.difference(words)}
            ids[""] = b""
            words.extend([part for part, found in ids.items() if found is None])
            ids.update(zip(words, encode_plain(words), strict=True))
            known.newer.update(ids)
            known.newer.update((chunk, ids[x] + ids[y] + ids[z]) for chunk, (x, y, z) in zip(plain, cuts, strict=True))
            known.newer.update(zip(whole, encode(whole), strict=True))

        def many(texts: list) -> list[bytes]:
            out: list[bytes] = []
            waiting: list[list[str] | None] = []
            together: set = set()

            def flush() -> None:
                """Look up all that waits at once; what was learnt last can't have left the cache yet."""
                learn(together)
                known_ids = known.newer.__getitem__
                at = len(out)
                out.extend(encode([texts[at + i]])[0] + END if chunks is None else b"".join(map(known_ids, chunks)) + END for i, chunks in enumerate(waiting))
                waiting.clear()
                together.clear()

            for text in texts:
                odd = text and any(x in text for x in _ODD)
                waiting.append(None if odd else (folded(text) if kept.folds else text or "").split())
                together.update(waiting[-1] or ())
                if len(together) > CACHE // 8:
                    flush()
            flush()
            return out

        return many

    return make


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, bin long, offset long, open boolean"


def _packer(make: Callable, length: int, bins: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, fit, ids_of = TaskContext.get().partitionId(), BestFit(length, bins), None
        held: dict[int, list] = {}
        for batch in batches:
            ids_of = ids_of or make()
            done = []
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist()), strict=True):
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, length)):
                    part = ids[start * 4 : (start + length) * 4]
                    n = len(part) // 4
                    name, offset = fit.put(n)
                    held.setdefault(name, []).append((doc, piece, start, n, zlib.crc32(part), task, name, offset))
            still = fit.open()
            for name in [x for x in held if x not in still]:
                done.extend((*row, False) for row in held.pop(name))
            yield _rows(done)
        yield _rows([(*row, True) for rows in held.values() for row in rows])

    return pack


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.bool_())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _PIECE.split(", ")])


def _repacker(length: int, bins: int) -> Callable:
    """Packs whole open bins (task, bin, used) of several tasks into new ones: adds (to_task, to_bin, shift, open)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, fit, rows = TaskContext.get().partitionId(), BestFit(length, bins), []
        for batch in batches:
            for task, name, used in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows.append((task, name, here, *fit.put(used)))
        still = fit.open()
        rows = [(*r, r[3] in still) for r in rows]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (*[pa.int64()] * 5, pa.bool_()), strict=True)], names=["task", "bin", "to_task", "to_bin", "shift", "open"])

    return pack


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the tokenizer's ids, then id 0; null and empty texts are id 0
    alone. Only longer documents are cut, into pieces of ``length`` tokens, the
    last of which may be shorter; a row's pieces are numbered from 0. Sequences
    are gapless from offset 0. Rows are packed in the order they are read in;
    rows that repeat, or have a null doc_id, are packed like any other. An
    empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession, 500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stage(docs.mapInArrow(_packer(token_source(tokenizer), length, open_bins), _PIECE), "pieces")
    level, left = 0, pieces.where("open").groupBy("task", "bin").agg(F.sum("length").alias("used"))
    left = stage(left, "open_bins")
    tasks = pieces.agg(F.max("task")).first()[0]
    tasks = 0 if tasks is None else tasks + 1
    names = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).alias("level"), "task", "bin", "offset", "open")
    while tasks > 1 and not left.isEmpty():
        level, tasks = level + 1, -(-tasks // FAN_IN)
        # Leftovers are at most ``open_bins`` rows of a task; the fullest come first.
        dealt = left.repartition(tasks, F.floor(F.col("task") / FAN_IN)).sortWithinPartitions(F.desc("used"), "task", "bin")
        moved = stage(dealt.mapInArrow(_repacker(length, FAN_IN * open_bins), "task long, bin long, to_task long, to_bin long, shift long, open boolean"), "moved")
        held = names.where("open").join(moved.withColumnRenamed("open", "still"), ["task", "bin"])
        held = held.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(level).alias("level"), F.col("to_task").alias("task"), F.col("to_bin").alias("bin"), (F.col("offset") + F.col("shift")).alias("offset"), F.col("still").alias("open"))
        names = names.where("not open").unionByName(held)
        left = stage(names.where("open").groupBy("task", "bin").agg(F.sum("length").alias("used")), "open_bins")
    number = (F.col("level").cast("long") * (1 << 28) + F.col("task")) * (1 << 32) + F.col("bin")
    return names.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")
