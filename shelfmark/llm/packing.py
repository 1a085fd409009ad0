"""Packing token sequences into windows of a fixed capacity.

Documents are tokenised where they are read and packed there, in loads of a fixed number of windows and of
documents, so nothing is shuffled and a task holds one load at a time. In each load the pieces are spread over k
windows by Karmarkar-Karp multiway differencing; k rises while a window exceeds the capacity. The
emptiest windows are then cut up to fill the room left in the others, and what is left over is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import os
import re
import sys
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, ranges
from .quality_rules import batches_by_size

#: The pre-tokenisation of the word-end vocabulary (fixed by its file).
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


#: The same for texts of the characters below, with the faster re module: there its word characters
#: are just the letters, the decimal digits and the underscore, and its white space is Unicode's.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_SPACE = regex.compile(r"\p{White_Space}+")
_PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]*")


def _shown_bytes() -> dict[int, str]:
    """Printable stand-ins of the bytes in vocabulary files (fixed by the format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit integers. No part of the pre-tokenisation holds white
    space, so texts are cut there, and each distinct run is cut into its parts and encoded once; at most
    about max_words runs and parts are remembered. A text with a special token's string goes through the
    tokenizer whole."""

    def __init__(self, path: str, max_words: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tok, self.max_words = _tokenizer(path), max_words
        self.known: dict[str, bytes] = {}  # ids of runs and of their parts: a part alone is a run of one part
        self.model = Tokenizer(self.tok.model)  # for parts, which need no more normalising and cutting
        self.shown = _shown_bytes()
        self.special = [a.content for a in self.tok.get_added_tokens_decoder().values()]

    def _bytes(self, encodings: list) -> list[bytes]:
        ids = [array("I", e.ids) for e in encodings]
        if sys.byteorder == "big":
            for a in ids:
                a.byteswap()
        return [a.tobytes() for a in ids]

    def _learn(self, runs: list[str], plain: bool) -> None:
        """The runs' ids; plain: all are of the characters that _FAST takes."""
        known, cut, parts = self.known, _FAST.findall if plain else _WORDS.findall, {}
        for r in runs:  # most are letters alone, or with one mark at the end
            if plain and not r.isalpha():
                parts[r] = (r[:-1], r[-1]) if r[:-1].isalpha() and r[-1] in ".,;:!?" else cut(r)
            elif not plain:
                parts[r] = cut(r)
        whole = [r for r in runs if r not in parts]
        new = list(dict.fromkeys(chain(whole, (w for w in chain.from_iterable(parts.values()) if w not in known))))
        shown = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.shown) for w in new]
        known.update(zip(new, self._bytes(self.model.encode_batch_fast(shown, add_special_tokens=False)), strict=True))
        known.update([(r, b"".join([known[w] for w in ws])) for r, ws in parts.items()])

    def _joined(self, cut: pa.ListArray, plain: bool) -> list[bytes]:
        """The ids of texts cut into runs."""
        words = cut.flatten().dictionary_encode()
        distinct, codes = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        if len(self.known) > self.max_words:
            self.known.clear()
        self._learn([r for r in distinct if r not in self.known], plain)
        found = list(map(self.known.__getitem__, distinct))
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, at = np.frombuffer(b"".join(found), "<u4"), ranges(n)
        n = n[codes]
        end = ranges(n)
        raw = flat[np.repeat(at[codes] - end[:-1], n) + np.arange(end[-1])].tobytes()
        edge = (4 * end[cut.offsets.to_numpy()]).tolist()
        return [raw[s:e] for s, e in zip(edge, edge[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain: tuple[list, list] = ([], [])
        other: tuple[list, list] = ([], [])
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = self._bytes([self.tok.encode(t, add_special_tokens=False)])[0]
                continue
            # the final sigma rule of str.lower isn't the tokenizer's, which lowers each letter by itself
            low = unicodedata.normalize("NFC", t).replace("Σ", "σ").lower()
            at, rows = plain if _PLAIN.fullmatch(low) else other
            at.append(i)
            rows.append(low if rows is plain[1] else [w for w in _SPACE.split(low) if w])
        for at, cut in ((plain[0], pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array(plain[1], pa.string())))), (other[0], pa.array(other[1], pa.list_(pa.string())))):
            if at:
                for i, ids in zip(at, self._joined(cut, at is plain[0]), strict=True):
                    out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return WordEncoder(path)


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The part, 0 to k-1, of each size by Karmarkar-Karp differencing over k parts. A partial
    partition holds the sums of its parts, largest first, less its least sum; the two with the greatest
    imbalance merge, the fullest part of one with the emptiest of the other, until one is left."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    # Nodes 0..n-1 are single sizes in part 0; a merged node knows where its children's parts went.
    sums: dict[int, np.ndarray] = {}
    for i, s in enumerate(sizes):
        sums[i] = np.zeros(k, np.int64)
        sums[i][0] = s
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-total, kind="stable")
        place = np.empty(k, np.int32)
        place[order] = np.arange(k, dtype=np.int32)  # where part p of a goes
        node = n + len(made)
        made.append((a, b, place, place[::-1].copy()))  # part p of b was laid on part k-1-p of a
        total = total[order]
        sums[node] = total - total[-1]
        heapq.heappush(heap, (-int(sums[node][0]), node))
    where: dict[int, np.ndarray] = {n + len(made) - 1: np.arange(k, dtype=np.int32)} if made else {0: np.arange(k, dtype=np.int32)}
    for node in range(n + len(made) - 1, n - 1, -1):
        a, b, pa_, pb = made[node - n]
        here = where.pop(node)
        where[a], where[b] = here[pa_], here[pb]
    return np.array([where[i][0] for i in range(n)], np.int64)


def pack_load(sizes: list[int], capacity: int = 4096) -> list[list[tuple[int, int, int]]]:
    """Sequences of (index, start, length) that hold each unit of each size once. All sequences are full
    but the last few, whose lengths are powers of two."""
    whole: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for i, s in enumerate(sizes):
        full = s // capacity
        whole.extend([(i, j * capacity, capacity)] for j in range(full))
        if s % capacity:
            rest.append((i, full * capacity, s % capacity))
    total = sum(r[2] for r in rest)
    if not total:
        return whole
    k = -(-total // capacity)
    while True:
        part = differencing([r[2] for r in rest], k)
        loads = np.bincount(part, weights=[r[2] for r in rest], minlength=k).astype(np.int64)
        if loads.max() <= capacity:
            break
        k += max(1, -(-int((loads - capacity).clip(0).sum()) // capacity))
    windows: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    for r, p in zip(rest, part.tolist(), strict=True):
        windows[p].append(r)
    # The fullest windows stay; the others' pieces are cut into the room that is left.
    order = np.argsort(-loads, kind="stable").tolist()
    stay = total // capacity
    kept, loose = [windows[p] for p in order[:stay]], [r for p in order[stay:] for r in windows[p]]
    room = [capacity - int(loads[p]) for p in order[:stay]]
    tail, w = [], 0
    for i, start, length in loose:
        while length and w < stay:
            if not room[w]:
                w += 1
                continue
            n = min(length, room[w])
            kept[w].append((i, start, n))
            room[w] -= n
            start, length = start + n, length - n
        if length:
            tail.append((i, start, length))
    left = sum(r[2] for r in tail)
    for bit in range(left.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            need, seq = 1 << bit, []
            while need:
                i, start, length = tail.pop(0)
                n = min(length, need)
                seq.append((i, start, n))
                need -= n
                if n < length:
                    tail.insert(0, (i, start + n, length - n))
            kept.append(seq)
    return whole + kept


def pack_rows(sizes: list[int], capacity: int = 4096) -> list[list[tuple[int, int, int]]]:
    """pack_load of documents of any size: short ones that follow each other, up to a sixteenth of the capacity
    together, are one size for the differencing and lie in order where it is laid, so its work follows the
    ids and not the documents."""
    least, groups, open_, total = capacity // 16, [], [], 0
    for i, n in enumerate(sizes):
        if n >= least:
            groups.append([i])
            continue
        open_.append(i)
        total += n
        if total >= least:
            groups.append(open_)
            open_, total = [], 0
    if open_:
        groups.append(open_)
    ends = [list(accumulate(sizes[i] for i in g)) for g in groups]
    out = []
    for pieces in pack_load([e[-1] for e in ends], capacity):
        seq = []
        for g, start, n in pieces:
            k = bisect_right(ends[g], start)
            while n:
                i, first = groups[g][k], ends[g][k] - sizes[groups[g][k]]
                take = min(n, ends[g][k] - start)
                if take:
                    seq.append((i, start - first, take))
                start, n, k = start + take, n - take, k + 1
        out.append(seq)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocab_path: str, end_id: int = 2, capacity: int = 4096, windows_per_load: int = 128, rows_per_load: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length (in the document's ids, its end id included), the crc32
    of the piece's ids, doc_tokens, and the sequence and offset where the piece lies.

    Every document, empty and null texts included, has at least its end id and so at least one piece.
    Rows with the same doc_id are packed as documents of their own. Texts of any length are cut.
    sequence_id is partition * 2^32 + a counter: a task that is run again gives the same rows. Each
    partition ends with at most log2(capacity) short sequences, all of power-of-two length; an empty
    table gives no rows; other columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocab_path), int(end_id).to_bytes(4, "little")
        limit, seq = windows_per_load * capacity, TaskContext.get().partitionId() << 32
        held: list[tuple[int, bytes, int, int]] = []  # doc_id, its ids from `first` on, first, all its tokens
        size = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, size, seq
            out = []
            packed = pack_rows([len(h[1]) // 4 for h in held], capacity)
            spare: dict[int, int] = {}
            for pieces in packed:
                if not last and sum(p[2] for p in pieces) < capacity:
                    for i, start, _ in pieces:
                        spare[i] = min(start, spare.get(i, start))
                    continue
                at = 0
                for i, start, n in pieces:
                    doc, ids, first, tokens = held[i]
                    out.append((doc, first + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens, seq, at))
                    at += n
                seq += 1
            held = [(held[i][0], held[i][1][4 * s :], held[i][2] + s, held[i][3]) for i, s in spare.items()]
            size = sum(len(h[1]) // 4 for h in held)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], [x.split(" ")[0] for x in PIECES.split(", ")])

        for b in batches:
            for docs_, texts in batches_by_size(b, 6_000_000):
                for doc, ids in zip(docs_, encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    # of a very long document all but the end goes at once, in full windows
                    held.append((doc, ids, 0, n))
                    size += n
                    if size >= limit or len(held) >= rows_per_load:
                        yield flush(False)
        if held:
            yield flush(True)

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)
