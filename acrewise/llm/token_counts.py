"""Op 6, token counts by a compiled finite-state tokenizer.

The tokenizer file is compiled into a deterministic transducer that reads a
normalized text code point by code point and annotates its transitions with
numbers of tokens emitted:

* the outer machine splits the text into pieces. Its transitions depend on
  the class of the code point (letter, digit, blank, other), on the class
  before it and, at an apostrophe, on the two that follow, so the places
  where a piece starts are found for a whole batch at once;
* within a piece the state is the piece read so far, kept as the residue of
  a polynomial. Reading a code point is an affine map s -> s * B + c of the
  residue; maps compose associatively, so residues of all pieces come from
  one segmented prefix scan over the batch instead of a loop over characters;
* the transition that ends a piece carries the piece's token count. It is
  compiled once for each distinct piece, by the merge rules of the file, and
  kept for the life of the Python worker.

Long texts are cut into chunks of bounded size. A chunk ends where a piece
starts, so its map is one number (tokens emitted), and the maps of a text's
chunks compose by addition.

Special tokens inside a text are handled as the library does by default: each
occurrence in the raw text is one token and splits the text.

Defined cases: null and empty texts have no tokens; equal rows get equal
counts; null ids stay; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from acrewise.llm.common import on_arrow, table

LIMIT = 2048
CHUNK = 1 << 19            # code points scanned at once
CACHED_PIECES = 1_000_000  # compiled transitions a worker keeps before it starts anew
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
LETTER, DIGIT, OTHER, BLANK = 1, 2, 3, 0


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))
        if c[0] == "L":
            out[i] = LETTER
        elif c[0] == "N":
            out[i] = DIGIT
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return out


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Transducer:
    """The compiled form of a tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path))
        model = spec["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {tuple(p): i for i, p in enumerate(pairs)}
        self.end = model["end_of_word_suffix"] or ""
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.bytes = byte_symbols()
        self.emits: dict[int, int] = {}

    def piece(self, text: str) -> int:
        """Tokens emitted by the transition that ends a piece: merges in
        order of rank, leftmost first. The neighbours of each part are kept
        as links and the possible merges in a heap, so a very long piece
        costs n log n."""
        parts = [self.bytes[b] for b in text.encode()]
        parts[-1] += self.end
        n, rank = len(parts), self.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if j < 0 or (parts[i], parts[j]) != pair:
                continue  # one of the two has been merged since
            parts[i], parts[j] = pair[0] + pair[1], ""
            right[i], n = right[j], n - 1
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (parts[x], parts[y]) in rank:
                    p = (parts[x], parts[y])
                    heapq.heappush(heap, (rank[p], x, p))
        return n

    def normal(self, text: str) -> str:
        """Canonical composition, then lower case letter by letter (no
        special form of a final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def parts(self, text: str) -> tuple[list[str], int]:
        """Stretches of text between special tokens; number of those."""
        if "<|" not in text:
            return [text], 0
        cut = self.special.split(text)
        return cut, len(cut) - 1

    def scan(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces in an array of code points, and their tokens."""
        cls = classes()[points]
        before = np.empty_like(cls)
        before[0], before[1:] = BLANK, cls[:-1]
        start = (cls != BLANK) & ((cls != before) | (cls == DIGIT))
        quote = np.flatnonzero((points == 39) & (before != OTHER))
        if len(quote):
            p = np.concatenate([points, np.zeros(2, points.dtype)])
            a, b = p[quote + 1], p[quote + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ~one & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            for q, n in ((quote[one], 2), (quote[two], 3)):
                start[q + 1] = False
                after = q + n
                after = after[after < len(points)]
                start[after] |= cls[after] != BLANK
        at = np.flatnonzero(start)
        if not len(at):
            return at, at
        # segmented scan of the affine maps; blanks add nothing
        inside = cls != BLANK
        sizes = np.diff(np.append(at, len(points)))
        offset = np.arange(len(points)) - np.repeat(at, sizes) if at[0] == 0 else np.arange(at[0], len(points)) - np.repeat(at, sizes)
        c, m = points[at[0]:].astype(np.uint64) + np.uint64(1), inside[at[0]:]
        state = np.add.reduceat(np.where(m, c * powers(int(offset.max()) + 1)[offset], np.uint64(0)), at - at[0])
        state = (state ^ (state >> np.uint64(29))) * MIX
        found, back = np.unique(state, return_inverse=True)
        tokens = np.empty(len(found), np.int64)
        where = np.empty(len(found), np.int64)
        where[back] = np.arange(len(at))
        if len(self.emits) > CACHED_PIECES:
            self.emits.clear()
        emits = self.emits
        for k, s in enumerate(found.tolist()):
            n = emits.get(s)
            if n is None:
                i = where[k]
                piece = points[at[i]:at[i] + sizes[i]]
                n = emits[s] = self.piece(piece[classes()[piece] != BLANK].tobytes().decode("utf-32-le"))
            tokens[k] = n
        return at, tokens[back]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        pending, owners, size = [], [], 0

        def flush():
            nonlocal pending, owners, size
            if pending:
                points = np.frombuffer("\n".join(pending).encode("utf-32-le"), np.uint32)
                ends = np.cumsum([len(p) + 1 for p in pending])
                at, n = self.scan(points)
                np.add.at(out, np.asarray(owners)[np.searchsorted(ends, at, "right")], n)
            pending, owners, size = [], [], 0
        for i, text in enumerate(texts):
            stretches, special = self.parts(text)
            out[i] += special
            for s in stretches:
                for chunk in chunks(self.normal(s)):
                    pending.append(chunk)
                    owners.append(i)
                    size += len(chunk)
                    if size >= CHUNK:
                        flush()
        flush()
        return out


def chunks(text: str) -> Iterator[str]:
    """Cuts of a text at blanks (where every piece ends), about CHUNK long."""
    while len(text) > 2 * CHUNK:
        m = re.compile(r"\s").search(text, CHUNK)
        if not m:
            break
        yield text[:m.start()]
        text = text[m.start():]
    if text:
        yield text


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 1024), BASE)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


@lru_cache(4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = t.count(texts)
            size = np.fromiter((len(x.encode()) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > LIMIT)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(df, path: str, key: str = "doc_id", text: str = "text"):
    """doc_id, n_bytes, n_tokens, over_limit of every row of df."""
    return on_arrow(df.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string")),
                    counter(path), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6(spark, sf_dir):
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


SQL = None  # SQL has no merge loop; tests compare with the tokenizer library
