"""Byte-level BPE encoding and decoding by speculation and verification.

Each distinct word is first cut greedily into the longest vocabulary entries. A cut is the one that
merging by rank would reach exactly if each of its adjacent token pairs is compatible, i.e. if merging
the two tokens' joined bytes yields the same two tokens; all pairs of a batch of words are tested at
once with array operations that undo merges down the two tokens' facing edges. Words with a failing
pair, and only those, are merged exactly; of a long word only what stands around its failing pairs, as
far as the pairs at its borders then fit. Texts never leave the row's task: there is no shuffle.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import id_text, ranges
from .quality_rules import batches_by_size

#: The pre-tokenisation of byte-level BPE vocabularies (fixed by the format), with the Unicode
#: property White_Space spelled out, since the regex module's \s holds four more characters.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same for texts of the characters below, with the faster re module: there its word characters
#: are just the letters, the decimal digits and the underscore, and its white space is Unicode's.
FAST_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]*")

#: A space that isn't followed by a letter, a digit or another mark.
_LOOSE = re.compile(r" (?:\s|\Z)")
_NONE = np.zeros(0, np.int32)
_NEVER = 1 << 62
#: Words of more bytes are dealt with one by one, this many starting points at a time.
LONG, STARTS = 1 << 10, 1 << 16


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the bytes in vocabulary files (fixed by the format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary of a byte-level BPE file. Inside, tokens are numbered by their rank: the 256 bytes,
    then the results of the merges in order; `ids` has the file's ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = _byte_alphabet(), spec["model"]["vocab"]
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {raw(s): i for s, i in vocab.items() if s not in self.special}
        self.token: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        left, right, codes, made = list(range(256)), list(range(256)), [], []
        for m in spec["model"]["merges"]:
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            if a + b not in self.token:
                self.token[a + b] = len(left)
                left.append(self.token[a])
                right.append(self.token[b])
            codes.append(self.token[a] << 32 | self.token[b])
            made.append(self.token[a + b])
        self.left, self.right = np.array(left), np.array(right)
        self.width = np.fromiter(map(len, self.token), np.int64, len(self.token))
        order = np.argsort(np.array(codes, np.int64), kind="stable")
        self.codes, self.made = np.array(codes, np.int64)[order], np.array(made, np.int64)[order]
        self.merge = dict(zip(codes, made, strict=True))
        self.ids = [plain[t] for t in self.token]
        self.id_of = np.array(self.ids, np.int32)
        bytes_of = {i: t for t, i in zip(self.token, self.ids, strict=True)} | {i: s.encode() for s, i in self.special.items()}
        in_order = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.n_bytes = np.fromiter(map(len, in_order), np.int64, len(in_order))
        self.first_byte, self.all_bytes = ranges(self.n_bytes)[:-1], np.frombuffer(b"".join(in_order), np.uint8)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # A token that its own bytes don't merge to can't be proposed.
        splits = [(i, a, b) for i, (a, b) in enumerate(zip(left, right, strict=True)) if i > 255]
        n, a, b = (np.array(x) for x in zip(*splits, strict=True))
        ok = self.compatible(a, b, n)
        bad = set(n[~ok].tolist())
        self.proposable = {t: i for t, i in self.token.items() if i not in bad}

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray]:
        """A row for each node of the trie of the entries, with the next node by byte, 0 for none; and
        each node's entry, -1 for none."""
        nodes, entry = {b"": 0}, [-1]
        for t in self.proposable:
            for k in range(1, len(t) + 1):
                if t[:k] not in nodes:
                    nodes[t[:k]] = len(entry)
                    entry.append(self.proposable.get(t[:k], -1))
        after = np.zeros((len(entry), 256), np.int32)
        for t, i in nodes.items():
            if t:
                after[nodes[t[:-1]], t[-1]] = i
        return after, np.array(entry, np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For each pair, whether no merge of rank under the later of the two tokens joins bytes
        across their border. `below` sets a first bound on the rank."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max) if below is None else below.astype(np.int64)
        while len(live):
            code = a << 32 | b
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            clash = (self.codes[at] == code) & (self.made[at] < limit)
            out[live[clash]] = False
            # Undo the later merge of the two: the left token's if it ranks higher, or if the right one is a byte.
            ends = (a < 256) & (b < 256)
            go = ~clash & ~ends
            live, a, b, limit = live[go], a[go], b[go], limit[go]
            undo_a = (a > b) & (a > 255)
            undo_a |= b < 256
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def propose(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each word's cut into longest entries, one word after the other, and the word that
        each is of. All words take their next token together, walking down the trie of the entries."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join([*raw, b"\0"]), np.uint8)
        edge = ranges(size)
        word, at = np.flatnonzero(size), edge[:-1][size > 0]
        after, entry = self.trie
        tokens, owners = [], []
        while len(word):
            stop, best, end = edge[word + 1], text[at].astype(np.int64), at + 1
            node, here, live = after[0, best], at + 1, np.arange(len(word))
            while len(live):
                live, node, here = (x[here < stop[live]] for x in (live, node, here))
                node = after[node, text[here]]
                live, node, here = (x[node > 0] for x in (live, node, here + 1))
                t = entry[node]
                hit = t >= 0
                best[live[hit]], end[live[hit]] = t[hit], here[hit]
            tokens.append(best)
            owners.append(word)
            go = end < stop
            word, at = word[go], end[go]
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return (np.concatenate(tokens) if tokens else owner)[order], owner[order]

    def propose_long(self, raw: bytes) -> np.ndarray:
        """The tokens of one long word's cut into longest entries. The longest entry is found at many
        places together, and the cut then goes from place to place."""
        after, entry = self.trie
        tokens, at = [], 0
        while at < len(raw):
            n = min(STARTS, len(raw) - at)
            text = np.frombuffer(raw[at : at + n + int(self.width.max())], np.uint8)
            best, node, here = text[:n].astype(np.int64), after[0, text[:n]], np.arange(1, n + 1)
            live = np.arange(n)
            while len(live):
                live, node, here = (x[here < len(text)] for x in (live, node, here))
                node = after[node, text[here]]
                live, node, here = (x[node > 0] for x in (live, node, here + 1))
                t = entry[node]
                hit = t >= 0
                best[live[hit]] = t[hit]
            end, k, path = (np.arange(n) + self.width[best]).tolist(), 0, []
            while k < n:
                path.append(k)
                k = end[k]
            tokens.append(best[path])
            at += k
        return np.concatenate(tokens)

    def encode_long(self, raw: bytes) -> np.ndarray:
        """The tokens of one long word: proposed, all pairs verified; the tokens around each failing pair are
        merged exactly, and as long as a pair still fails there, twice as many. Time and memory grow with
        the word where pairs that fail stand apart."""
        tok, around = self.propose_long(raw), 4
        while True:
            distinct, back = np.unique(tok[:-1] << 32 | tok[1:], return_inverse=True)
            bad = np.flatnonzero(~self.compatible(distinct >> 32, distinct & 0xFFFFFFFF)[back]) + 1
            if not len(bad):
                return tok
            lo, hi = np.maximum(bad - around, 0), np.minimum(bad + around, len(tok))
            cut = np.flatnonzero(lo[1:] > hi[:-1]) + 1
            lo, hi = lo[np.append(0, cut)], hi[np.append(cut - 1, len(hi) - 1)]
            edge = ranges(self.width[tok])
            mended = self.exact([raw[s:e] for s, e in zip(edge[lo].tolist(), edge[hi].tolist(), strict=True)])
            parts, done = [], 0
            for s, e, new in zip(lo.tolist(), hi.tolist(), mended, strict=True):
                parts += [tok[done:s], new]
                done = e
            tok, around = np.concatenate([*parts, tok[done:]]).astype(np.int64), 2 * around

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair merges to, _NEVER if to nothing; tokens under 0 stand for none."""
        code = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0) & (b >= 0), self.made[at], _NEVER)

    def exact(self, raw: list[bytes], longest: int = 48, rows: int = 1 << 14) -> list[np.ndarray]:
        """The words' tokens by merges in order of rank, leftmost first. Words of like length make each
        their next merge together; a long word is merged by itself."""
        out: list[np.ndarray] = [_NONE] * len(raw)
        order = sorted((i for i in range(len(raw)) if len(raw[i]) <= longest), key=lambda i: len(raw[i]))
        for at in range(0, len(order), rows):
            mine = order[at : at + rows]
            n = len(raw[mine[-1]])
            tok = np.full((len(mine), n + 1), -1, np.int64)
            size = np.array([len(raw[i]) for i in mine])
            tok[np.arange(n + 1) < size[:, None]] = np.frombuffer(b"".join(raw[i] for i in mine), np.uint8)
            rank, col, live = self._rank(tok[:, :-1], tok[:, 1:]), np.arange(n), np.arange(len(mine))
            while len(live):
                i = rank[live].argmin(1)
                made = rank[live, i]
                live, i, made = (x[made != _NEVER] for x in (live, i, made))
                t, r, k = tok[live], rank[live], np.arange(len(live))
                t[:, :-1] = np.where(col > i[:, None], t[:, 1:], t[:, :-1])
                r[:, :-1] = np.where(col[:-1] > i[:, None], r[:, 1:], r[:, :-1])
                t[:, -1] = -1
                r[:, -1] = _NEVER
                t[k, i] = made
                r[k, i] = self._rank(made, t[k, i + 1])
                some = i > 0
                r[k[some], i[some] - 1] = self._rank(t[k[some], i[some] - 1], made[some])
                tok[live], rank[live] = t, r
            for i, row, n in zip(mine, tok, (tok >= 0).sum(1).tolist(), strict=True):
                out[i] = row[:n]
        for i, w in enumerate(raw):
            if len(w) > longest:
                out[i] = np.array(self._exact_long(w))
        return out

    def _exact_long(self, word: bytes) -> list[int]:
        """With a heap over a linked list of tokens."""
        tok, n, merge = list(word), len(word), self.merge
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, tok[i], tok[i + 1]) for i in range(n - 1) if (m := merge.get(tok[i] << 32 | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (k := merge.get(m << 32 | tok[nxt[i]])) is not None:
                    heapq.heappush(heap, (k, i, m, tok[nxt[i]]))
            if (p := prv[i]) >= 0 and (k := merge.get(tok[p] << 32 | m)) is not None:
                heapq.heappush(heap, (k, p, tok[p], m))
        return [t for t in tok if t >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each distinct word as 32-bit integers: proposed, verified together, merged exactly where
        that fails."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        long = [i for i, w in enumerate(raw) if len(w) > LONG]
        whole = [self.id_of[self.encode_long(raw[i])].tobytes() for i in long]
        for i in long:
            raw[i] = b""
        flat, owner = self.propose(raw)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pair = flat[inner] << 32 | flat[inner + 1]
        distinct, back = np.unique(pair, return_inverse=True)
        good = self.compatible(distinct >> 32, distinct & 0xFFFFFFFF)[back]
        ids = self.id_of[flat].tobytes()
        edge = (4 * ranges(np.bincount(owner, minlength=len(words)))).tolist()
        out = [ids[s:e] for s, e in zip(edge, edge[1:])]
        failing = np.unique(owner[inner[~good]]).tolist()
        for i, tokens in zip(failing, self.exact([raw[i] for i in failing]), strict=True):
            out[i] = self.id_of[tokens].tobytes()
        for i, ids in zip(long, whole, strict=True):
            out[i] = ids
        return out

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """The texts of consecutive runs of ids, which start and end at the edges."""
        n = self.n_bytes[ids]
        end = ranges(n)
        raw = self.all_bytes[np.repeat(self.first_byte[ids] - end[:-1], n) + np.arange(end[-1])].tobytes()
        edge = end[edges].tolist()
        return [raw[s:e].decode("utf-8", "replace") for s, e in zip(edge, edge[1:])]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


class Encoder:
    """Encodes batches of texts. A text is cut before each space that a letter, digit or other mark
    follows, where every pre-tokenisation has a border; each distinct run is cut into its words and
    encoded once. At most about max_words runs, and as many words, are remembered."""

    def __init__(self, path: str, max_words: int = 1 << 18):
        self.bpe, self.max_words, self.words, self.runs = load(path), max_words, {}, {}

    def _learn(self, runs: list[str], plain: bool) -> None:
        words = self.words
        if len(words) > self.max_words:
            words.clear()
        cut = list(map((FAST_SPLIT if plain else SPLIT).findall, runs))
        new = [w for w in set(chain.from_iterable(cut)) if w not in words]
        words.update(zip(new, self.bpe.encode_words(new), strict=True))
        self.runs.update((r, words[c[0]] if len(c) == 1 else b"".join(map(words.__getitem__, c))) for r, c in zip(runs, cut, strict=True))

    def _gather(self, runs: list[str], codes: np.ndarray, edges: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after the other, and their edges. Text i is runs[codes[edges[i]:edges[i + 1]]]."""
        if len(self.runs) > self.max_words:
            self.runs.clear()
        self._learn([r for r in dict.fromkeys(runs) if r not in self.runs], plain)
        found = list(map(self.runs.__getitem__, runs))
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, at = np.frombuffer(b"".join(found), np.int32), ranges(n)
        n = n[codes]
        end = ranges(n)
        return flat[np.repeat(at[codes] - end[:-1], n) + np.arange(end[-1])], end[edges]

    def _spaced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of plain texts in which each space stands before something else."""
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        words, edges = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        distinct, codes = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
        codes[edges[:-1]] = len(distinct) + np.arange(len(texts))  # the first run has no space before it
        return self._gather([" " + d for d in distinct] + [t.split(" ", 1)[0] for t in texts], codes, edges, True)

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of other texts, cut into words one by one."""
        words = [SPLIT.findall(t) for t in texts]
        edges = ranges(np.fromiter(map(len, words), np.int64, len(words)))
        codes: dict[str, int] = {}
        at = np.fromiter((codes.setdefault(w, len(codes)) for ws in words for w in ws), np.int64, int(edges[-1]))
        return self._gather(list(codes), at, edges, False)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        special, marks = self.bpe.special, self.bpe.marks
        out: list[list[np.ndarray]] = [[] for _ in texts]
        todo: tuple[list, list] = ([], [])
        for i, text in enumerate(texts):
            for part in marks.split(text) if marks is not None and any(s in text for s in special) else (text,):
                if part in special:
                    out[i].append(np.array([special[part]], np.int32))
                    continue
                out[i].append(_NONE)
                todo[PLAIN.fullmatch(part) is None or _LOOSE.search(part) is not None].append((i, len(out[i]) - 1, part))
        for parts, encode in zip(todo, (self._spaced, self._cut), strict=True):
            if parts:
                ids, edges = encode([p for _, _, p in parts])
                for (i, k, _), s, e in zip(parts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    out[i][k] = ids[s:e]
        return [o[0] if len(o) == 1 else np.concatenate(o) for o in out]

    def together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their edges."""
        found = self(texts)
        return np.concatenate([_NONE, *found]), ranges(np.fromiter(map(len, found), np.int64, len(found)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def bpe_encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of each whole text, as adding no special tokens gives them; a special
    token's own string in a text becomes its id. Null and empty texts give an empty list; repeated rows
    give repeated rows; an empty table gives no rows; other columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab_path)
        for b in batches:
            for docs_, texts in batches_by_size(b):
                ids, edges = encode.together(texts)
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocab_path: str, rows: int = 1000) -> DataFrame:
    """The encoded frame (doc_id, ids) with `decoded`, the text of the ids, special tokens kept; bytes
    that are no UTF-8 become replacement characters. A null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                lists = part.column(1)
                edges = ranges(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                text = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False), edges)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def bpe_round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: bpe_encode and bpe_decode one after the other in the same task, so the ids
    don't travel between two workers. Odd rows are treated as they are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab_path)
        for b in batches:
            for docs_, texts in batches_by_size(b):
                ids, edges = encode.together(texts)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), lists, pa.array(encode.bpe.decode(ids, edges), pa.string())], ["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
