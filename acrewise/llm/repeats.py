"""Which windows of ``length`` symbols stand in a corpus more than once.

A sample of positions (anchors) is chosen by content, so that two equal
windows always hold a sampled position at the same offset: in every window,
the position whose k-mer has the smallest hash. That is the property a
difference cover has for positions; here the cover holds about two in
``length - k + 2`` positions.

* Anchors with an equal k-mer fall into classes by their whole context, that
  is all the symbols any window around them can reach. Members of one class
  agree in every window around the anchor, so a class is settled as a whole.
* Where one k-mer has several classes (a repeat begins or ends nearby), one
  member of each class spells out its windows, and equal windows meet by hash.

Every task first settles what it holds itself: of each class only one member
leaves the task, so a passage that stands in a third of all texts sends one
row from each task and not one from each text. Nothing is paired up; each
step sorts or counts.

A document is a distinct (id, text); rows equal in both are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrewise.llm import symbols
from acrewise.llm.common import freed, numbered, on_arrow, partitions, scratch, stored

LAST = 2**63 - 1  # stands for a null id
INDEX_BITS = 23


@dataclass(frozen=True)
class Repeats:
    """length: symbols of a window; k: of an anchor; values: how a batch of
    texts becomes symbols; every: mark all occurrences of a repeated window,
    else all but the first by (id, start)."""

    length: int
    k: int
    values: Callable
    every: bool

    # ---- per batch -----------------------------------------------------

    def scan(self, column: pa.Array) -> Iterator[tuple]:
        """For each bounded group of pieces: prefix sums, rows' numbers and
        bounds, and for every owned window its start and its anchor."""
        data, ends = symbols.text_bytes(column)
        for first, last in symbols.stretches(ends):
            codes, offsets = self.values(data[ends[first]:ends[last]], ends[first:last + 1] - ends[first])
            for s, kmers, row, *rest in self.scan_some(codes, offsets):
                yield s, kmers, row + first, *rest

    def scan_some(self, codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        """The same for a bounded stretch of rows."""
        reach = self.length - self.k
        for group in symbols.pieces(offsets, 2 * self.length):
            row, lo, hi, own_lo, own_hi = (np.array(x, np.int64) for x in zip(*group))
            v = np.concatenate([codes[a:b] for a, b in zip(lo, hi)])
            v = symbols.BYTE[v] if v.dtype == np.uint8 else v
            base = np.concatenate([[0], np.cumsum(hi - lo)])
            if len(v) < self.length:
                continue
            s = symbols.prefix_sums(v)
            at = np.arange(len(v) - self.k + 1)
            kmers = symbols.span_hash(s, at, at + self.k)
            m = (kmers >> np.uint64(INDEX_BITS) << np.uint64(INDEX_BITS)) | at.astype(np.uint64)
            step, width = 1, reach + 1
            while 2 * step <= width:
                m = np.minimum(m[:-step], m[step:])
                step *= 2
            if width > step:
                m = np.minimum(m[:step - width], m[width - step:])
            # windows that a piece owns and that end within its text
            edge = np.zeros(len(v) + 1, np.int32)
            first, last = base[:-1] + own_lo - lo, np.minimum(base[:-1] + own_hi - lo, base[1:] - self.length + 1)
            good = last > first
            np.add.at(edge, first[good], 1)
            np.add.at(edge, last[good], -1)
            start = np.flatnonzero(np.cumsum(edge[:len(m)]) > 0)
            anchor = (m[start] & np.uint64((1 << INDEX_BITS) - 1)).astype(np.int64)
            yield s, kmers, row, lo - offsets[row], base, start, anchor

    def anchors(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """(row, position in the row, k-mer hash, context hash, hashes of the
        nearer half of the context on both sides) of all anchors."""
        out, reach = [], self.length - self.k
        half, low = (reach + 1) // 2, np.uint64(0xFFFF)
        for s, kmers, row, shift, base, _, anchor in self.scan(column):
            a = np.unique(anchor)
            piece = np.searchsorted(base, a, "right") - 1
            lo, hi = np.maximum(a - reach, base[piece]), np.minimum(a + self.length, base[piece + 1])
            context = symbols.span_hash(s, lo, hi) ^ symbols.mixed(((a - lo) << 32 | (hi - a)).astype(np.uint64))
            near, far = np.maximum(a - half, lo), np.minimum(a + self.k + half, hi)
            left = symbols.span_hash(s, near, a) + (a - near).astype(np.uint64)
            right = symbols.span_hash(s, a + self.k, far) + (far - a).astype(np.uint64)
            out.append((row[piece], a - base[piece] + shift[piece], kmers[a], context, (left & low) << np.uint64(16) | (right & low)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 3
        keep = np.unique(cols[0] << 40 | cols[1], return_index=True)[1]  # two parts of a long text may share an anchor
        return tuple(c[keep] for c in cols)

    def windows(self, column: pa.Array, wanted: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(row, start, hash) of the windows whose anchor is wanted for the
        side that they reach to."""
        out, reach = [], self.length - self.k
        half = (reach + 1) // 2
        for s, _, row, shift, base, start, anchor in self.scan(column):
            piece = np.searchsorted(base, start, "right") - 1
            mark = np.zeros(len(s), np.uint8)
            for p in range(len(row)):
                at, side = (wanted[row[p]] >> 2) - shift[p], (wanted[row[p]] & 3).astype(np.uint8)
                own = (at >= 0) & (at < base[p + 1] - base[p])
                np.bitwise_or.at(mark, base[p] + at[own], side[own])
            sides, before = mark[anchor], anchor - start
            keep = ((sides & 1) > 0) & (before >= half) | ((sides & 2) > 0) & (reach - before >= half)
            start, piece = start[keep], piece[keep]
            out.append((row[piece], start - base[piece] + shift[piece], symbols.span_hash(s, start, start + self.length)))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    # ---- tasks ---------------------------------------------------------

    def find_anchors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, fp, text) -> one row for each class of the task (settled
        false) and one for each member that the task settles itself."""
        parts = []
        for b in batches:
            ids, fps = (b.column(k).to_numpy() for k in (0, 1))
            row, pos, kmer, context, halves = self.anchors(b.column(2))
            parts.append((kmer.view(np.int64), context.view(np.int64), halves.view(np.int64), ids[row], fps[row], pos))
        if parts:
            yield from settle([np.concatenate(c) for c in zip(*parts)], 2, self.every, ["a", "c", "h", "id", "fp", "pos"])

    def find_windows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, fp, text, at) -> the same for single windows."""
        parts = []
        for b in batches:
            ids, fps = (b.column(k).to_numpy() for k in (0, 1))
            wanted = [np.asarray(x, np.int64) for x in b.column(3).to_pylist()]
            row, start, h = self.windows(b.column(2), wanted)
            parts.append((h.view(np.int64), ids[row], fps[row], start))
        if parts:
            yield from settle([np.concatenate(c) for c in zip(*parts)], 1, self.every, ["a", "id", "fp", "pos"])

    # ---- the job -------------------------------------------------------

    def marks(self, docs: DataFrame) -> DataFrame:
        """docs (id, fp, text) without nulls -> (id, fp, spans): for each
        document with marked symbols the ranges [lo, hi) as a flat list;
        ranges may overlap and reach beyond the text."""
        folder, n = scratch(docs.sparkSession), partitions(docs.sparkSession)
        docs = once(docs)
        rows = on_arrow(docs, self.find_anchors, "a long, c long, h long, id long, fp long, pos long, settled boolean")
        rows = stored_by(rows, folder, "anchors", n, ["a", "c", "id", "fp", "pos"], classes(self.every),
                         "a long, h long, id long, fp long, pos long, split boolean")
        whole = self.ranges(rows.where("NOT split").select(F.col("a").alias("node"), "id", "fp", "pos"), folder)
        # two classes share a window only if the nearer half of their contexts
        # is equal on one side at least; then only windows that reach that far
        # to that side are spelled out (at: 4 * position + 1 for left, 2 for right)
        split = rows.where("split").withColumns({"left": F.shiftright("h", 16), "right": F.col("h").bitwiseAND(0xFFFF)})
        alike = [split.join(split.groupBy("a", side).agg(F.count(F.lit(1)).alias("c")).where("c > 1"), ["a", side], "left_semi")
                 .select("id", "fp", (4 * F.col("pos") + bit).alias("at")) for bit, side in ((1, "left"), (2, "right"))]
        wanted = alike[0].union(alike[1]).groupBy("id", "fp").agg(F.collect_set("at").alias("at"))
        spelled = docs.join(wanted, ["id", "fp"]).dropDuplicates(["id", "fp"]).select("id", "fp", "text", "at")
        single = on_arrow(spelled, self.find_windows, "a long, id long, fp long, pos long, settled boolean")
        single = stored_by(single, folder, "windows", n, ["a", "id", "fp", "pos"], equal_windows(self.every), "id long, fp long, pos long")
        ranges = whole.union(single.select("id", "fp", F.col("pos").alias("lo"), (F.col("pos") + self.length).alias("hi")))
        return ranges.groupBy("id", "fp").agg(F.flatten(F.collect_list(F.array("lo", "hi"))).alias("spans"))


    def ranges(self, whole: DataFrame, folder: str) -> DataFrame:
        """Settled anchors (node, id, fp, pos) -> what their contexts cover
        (id, fp, lo, hi)."""
        return whole.select("id", "fp", (F.col("pos") - (self.length - self.k)).alias("lo"), (F.col("pos") + self.length).alias("hi"))


def node(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One number for a class."""
    return symbols.mixed(a.view(np.uint64) * symbols.BASE ^ c.view(np.uint64)).view(np.int64)


def settle(cols: list[np.ndarray], keys: int, every: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sort a task's rows; the first of each key goes on, the others (and, if
    every occurrence counts, the first of several) are settled here."""
    cols = [c[o] for o in [np.lexsort(cols[::-1])] for c in cols]
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:keys]]) if len(new) else []
    done = ~new
    if every:
        done[:-1] |= ~new[1:]
    for settled, at in ((False, np.flatnonzero(new)), (True, np.flatnonzero(done))):
        for k in range(0, len(at), 100_000):
            some = at[k:k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in cols] + [pa.array(np.full(len(some), settled))], names + ["settled"])


def stored_by(rows: DataFrame, folder: str, name: str, n: int, order: list[str], fn, schema: str) -> DataFrame:
    """Open rows sorted by key and streamed through ``fn``; settled rows go
    along, dealt out evenly, and pass through. Written, as the result is read
    more than once."""
    deal = F.when(F.col("settled"), F.xxhash64("id", "fp", "pos")).otherwise(F.col("a"))
    out = stored(on_arrow(rows.repartition(n, deal).sortWithinPartitions("settled", *order), fn, schema), folder, name)
    freed(rows.sparkSession)
    return out


def columns(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Per batch the columns of the open rows, and all but the first ``keys``
    columns of the settled ones (none: all)."""
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        n = int((~cols[-1]).sum())
        yield [c[:n] for c in cols[:-1]], [c[n:] for c in cols[keys:-1]]


def classes(every: bool):
    """Sorted (a, c, h, id, fp, pos) -> members settled by their class (split
    false; a is then the class's node, if every occurrence counts), and one
    member of each class where a has several (split true, with a and h)."""
    out = ["a", "h", "id", "fp", "pos", "split"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held = None  # the row before; the first row of a's only class so far
        for (a, c, h, ids, fps, pos), done in columns(batches, 0):
            one = (a, h, ids, fps, pos)
            if len(done[0]):
                none = np.zeros(len(done[0]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node(*done[:2]) if every else none, none, *done[3:], none > 0)], out)
            if not len(a):
                continue
            nodes = node(a, c) if every else np.zeros(len(a), np.int64)
            new_a, new_c = np.ones(len(a), bool), np.ones(len(a), bool)
            new_a[1:] = a[1:] != a[:-1]
            if last is not None:
                new_a[0] = a[0] != last[1]
            new_c[1:] = c[1:] != c[:-1]
            if last is not None:
                new_c[0] = c[0] != last[0]
            new_c |= new_a
            whole, split = ~new_c, new_c & ~new_a
            extra = []
            if every:
                whole[:-1] |= ~new_c[1:]
                if last is not None and not new_c[0]:
                    extra.append((nodes[0], 0, *last[3:], False))  # its class goes on here
            run_of = np.cumsum(new_a)  # 0: the run that began in an earlier batch
            several = np.bincount(run_of[split], minlength=run_of[-1] + 1) > 0
            if held is not None and several[0]:
                extra.append((*held, True))
                held = None
            split |= new_a & several[run_of]
            if run_of[-1] > 0:
                i = np.flatnonzero(new_a)[-1]
                held = None if several[-1] else tuple(x[i] for x in one)
            last = (c[-1], *(x[-1] for x in one))
            at = np.concatenate([np.flatnonzero(whole), np.flatnonzero(split)])
            kind = np.repeat([False, True], [int(whole.sum()), int(split.sum())])
            cols = [np.concatenate([x[at], np.array([e[k] for e in extra], np.int64)]) for k, x in enumerate(one)]
            cols[0][:len(at)] = np.where(kind, a[at], nodes[at])
            kind = np.concatenate([kind, np.array([e[5] for e in extra], bool)])
            cols[1] = np.where(kind, cols[1], 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, kind)], out)
    return run


def equal_windows(every: bool):
    """Sorted (a, id, fp, pos) -> the occurrences to mark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for (a, ids, fps, pos), done in columns(batches, 1):
            if len(done[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in done], ["id", "fp", "pos"])
            if not len(a):
                continue
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            if last is not None:
                new[0] = a[0] != last[0]
            mark, extra = ~new, []
            if every:
                mark[:-1] |= ~new[1:]
                if last is not None and not new[0]:
                    extra.append(last[1:])
            last = (a[-1], ids[-1], fps[-1], pos[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[mark], np.array([e[k] for e in extra], np.int64)])) for k, x in enumerate((ids, fps, pos))],
                                             ["id", "fp", "pos"])
    return run


def documents(df: DataFrame, key: str, text: str, number: str | None = None) -> DataFrame:
    """(id, fp, text) with nulls filled in; fp tells documents of one id apart
    (``number`` of df if it is there already)."""
    if number is None:
        df, number = numbered(df, key, text)
    return df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("id"), F.col(number).alias("fp"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def once(docs: DataFrame) -> DataFrame:
    """Each document once. Only rows with a number can be repeated; where all
    numbers are the constant 0, Catalyst drops the second branch."""
    return docs.where("fp = 0").union(docs.where("fp <> 0").dropDuplicates(["id", "fp"]))


def marked(n: int, spans) -> np.ndarray:
    """Which of n symbols the ranges cover."""
    edge = np.zeros(n + 1, np.int32)
    if spans is not None and len(spans):
        lo, hi = np.clip(np.asarray(spans, np.int64).reshape(-1, 2), 0, n).T
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
    return np.cumsum(edge[:n]) > 0
