"""Quality rules: lines labelled as content or boilerplate by a conditional random field.

A linear-chain CRF reads the lines of a text (shape, symbols, capitals, repetition, stock phrases) and
Viterbi decoding marks each as content or boilerplate; the share of the words that lie in content lines
decides whether the document stays. The field is trained on the driver from lines that a small generator
labels, a fixed number of them: prose, verse, lists, recipes and dialogue beside menus, adverts, notices,
code, tables of numbers and junk; its weights are a few kilobytes and go with the task's closure.
Repetition is counted exactly: five-word windows are numbered by pairwise factorisation, not by hashes.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import crf
from .common import id_text, keep_rows, ranges

CONTENT, BOILERPLATE = 0, 1
SYMBOLS = "#*$%&|<>"
WINDOW = 5
_ODD = str.maketrans(dict.fromkeys("\t\x0b\x0c\r", " "))
_STOCK = ("license", "licence", "copyright", "©", "all rights reserved", "cookie", "click here", "subscribe", "sign in", "login", "log in", "terms of", "privacy", "share this", "read more", "http:", "https:", "www.", "@")
_OFFER = ("buy now", "order now", "order today", "shop now", "add to cart", "checkout", "free shipping", "free delivery", "% off", "discount", "sale", "best price", "lowest price", "limited time", "special offer", "call now", "don't miss", "hurry", "deal", "guarantee", "in stock", "coupon")


class Lines:
    """The lines and words of some texts, and what they count to."""

    def __init__(self, texts: list[str]):
        self.n_docs = len(texts)
        words: list[str] = []
        per_line: list[int] = []
        lines_of: list[int] = []
        later: list[bool] = []
        stock: list[bool] = []
        offer: list[bool] = []
        for text in texts:
            seen: set[str] = set()
            if "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text:
                pairs = zip(text.split("\n"), text.translate(_ODD).split("\n"), strict=True)
            else:
                pairs = ((x, x) for x in text.split("\n"))
            n = 0
            for raw, line in pairs:
                ws = [w for w in line.split(" ") if w]
                if not ws:
                    seen.add(raw)
                    continue
                words += ws
                per_line.append(len(ws))
                later.append(raw in seen)
                seen.add(raw)
                low = raw.lower()
                stock.append(any(x in low for x in _STOCK))
                offer.append(any(x in low for x in _OFFER))
                n += 1
            lines_of.append(n)
        self.per_line, self.lines_of = np.array(per_line, np.int64), np.array(lines_of, np.int64)
        self.later, self.stock = np.array(later, bool), np.array(stock, bool)
        self.offer = np.array(offer, bool)
        self.line_at, self.doc_at = ranges(self.per_line), ranges(self.lines_of)
        self.words_of = self.line_at[self.doc_at[1:]] - self.line_at[self.doc_at[:-1]]
        codes, kinds = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), [])
        self.codes, self.kinds = codes.astype(np.int64), kinds

    def per_doc(self, line_values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(line_values)])
        return total[self.doc_at[1:]] - total[self.doc_at[:-1]]

    def repeated_words(self) -> np.ndarray:
        """Per document, the words that lie in a window of five found twice or more in it."""
        n = len(self.codes)
        doc = np.repeat(np.arange(self.n_docs), self.words_of)
        if n < WINDOW:
            return np.zeros(self.n_docs, np.int64)
        inside = doc[WINDOW - 1 :] == doc[: n - WINDOW + 1]
        key = doc[: n - WINDOW + 1]
        for k in range(WINDOW):
            nth = self.codes[k : n - WINDOW + 1 + k]
            key = pd.factorize(key * (len(self.kinds) + 1) + nth)[0].astype(np.int64)
        key = key[inside]
        twice = np.flatnonzero(inside)[np.bincount(key, minlength=1)[key] > 1] if len(key) else np.zeros(0, np.int64)
        edge = np.bincount(twice, minlength=n + 1)[: n + 1] - np.bincount(twice + WINDOW, minlength=n + 1)[: n + 1]
        covered = np.cumsum(edge)[:n] > 0
        total = np.concatenate([[0], np.cumsum(covered)])
        at = ranges(self.words_of)
        return total[at[1:]] - total[at[:-1]]

    def _told(self, codes: np.ndarray, of: Callable[[str], str]) -> list[str]:
        """What `of` says of the words with these codes, each asked once."""
        some, at = np.unique(codes, return_inverse=True)
        return np.array([of(self.kinds[c]) for c in some])[at].tolist()

    def features(self) -> list[list[str]]:
        """The binary features of each line, all of them shares and shapes, none of them words."""
        if not len(self.codes):
            return []
        at, n = self.line_at[:-1], self.per_line
        shape = np.array([_shape(w) for w in self.kinds], np.float64)[self.codes]
        same = np.zeros(len(self.codes))
        same[1:] = self.codes[1:] == self.codes[:-1]
        same[self.line_at[:-1]] = 0
        share = np.add.reduceat(np.column_stack([shape, same]), at, axis=0) / n[:, None]
        doc_lines = np.repeat(np.searchsorted([2, 4, 9], self.lines_of, side="right"), self.lines_of)
        ends = self._told(self.codes[self.line_at[1:] - 1], lambda w: "stop" if w[-1:] in _STOPS else "comma" if w[-1:] in _COMMAS else "open")
        begins = self._told(self.codes[at], lambda w: "cap" if w[:1].isupper() else "low" if w[:1].islower() else "other" if w[:1] > "\xff" and w[:1].isalpha() else "sign")
        size = np.searchsorted([2, 4, 8, 16, 32], n, side="right")
        long = np.searchsorted([3, 5, 8, 14], share[:, 6], side="right")
        bins = np.searchsorted([1e-9, 0.1, 0.3, 0.6], share, side="left")
        names = ("symbol", "bang", "upper", "bar", "digit", "bracket", None, "cap", "same")
        out = []
        for i in range(len(n)):
            f = [f"n{size[i]}", f"w{long[i]}", ends[i], f"begins-{begins[i]}", f"n{size[i]}-{ends[i]}-cap{bins[i, 7]}", f"lines{doc_lines[i]}"]
            f += [f"{x}{bins[i, j]}" for j, x in enumerate(names) if x]
            if self.stock[i]:
                f.append(f"stock-n{size[i]}")
            if self.offer[i]:
                f.append(f"offer-n{size[i]}")
            if self.later[i]:
                f.append("again")
            out.append(f)
        return out


#: What is no letter with its marks, digit or punctuation of ordinary prose in any script: of punctuation
#: outside Latin-1 and the general block all is ordinary.
_SIGN = regex.compile(r"[^\w\s\p{M}\p{P}\u200c\u200d]|(?=[\x00-\xff\u2000-\u206f])[\p{P}--[.,;:!?¡¿'\"()\[\]\-–—…/‘’“”«»]]", regex.VERSION1)
#: The same for words of ASCII, with the faster re module.
_ASCII_SIGN = re.compile(r"[^\w\s.,;:!?'\"()\[\]\-/]|_", re.ASCII)
_STOPS = ".!?…।॥。！？．｡؟۔։።។"
_COMMAS = ",;:、，；：،؛"


def _shape(w: str) -> tuple[int, ...]:
    core = w.rstrip(".,")
    if core.isalpha():
        return (False, False, len(core) > 1 and core.isupper(), False, False, False, min(len(w), 40), core[0].isupper())
    letters = [c for c in w if c.isalpha()]
    sign = _ASCII_SIGN if w.isascii() else _SIGN
    return (bool(sign.search(w)), w.endswith("!!"), len(letters) > 1 and w.isupper(), w == "|", any(c.isdigit() for c in w), any(c in "{}[]=;\\" for c in w), min(len(w), 40), bool(letters) and letters[0].isupper())


def training_documents(n: int = 500, seed: int = 7) -> list[list[tuple[str, int]]]:
    """Generated documents as labelled lines of made-up words, in runs of one kind: prose, verse, lists, recipes,
    dialogue and letters are content; menus, notices, adverts, code, tables of numbers, shouting, words
    stuck together by signs and words repeated over and over are not."""
    rnd = random.Random(seed)
    pick = rnd.choice
    vowels, cons = "aeiouéèêöüáíóа", "bcdfghlmnprstvzçñßк"

    def word(lo: int = 1, hi: int = 4) -> str:
        return "".join(pick(cons) * (rnd.random() < 0.8) + pick(vowels) + pick(cons) * (rnd.random() < 0.3) for _ in range(rnd.randint(lo, hi)))

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rnd.randint(lo, hi)))

    def sentence() -> str:
        ws = [(word().capitalize() if rnd.random() < 0.06 else word()) + "," * (rnd.random() < 0.08) for _ in range(pick([1, 2, 3, 5, 8, 12, 18]))]
        return ws[0].capitalize().rstrip(",") + "".join(" " + w for w in ws[1:]).rstrip(",") + pick("....?!")

    def prose() -> list[str]:
        out = []
        for _ in range(rnd.randint(1, 6)):
            text = " ".join(sentence() for _ in range(pick([1, 1, 2, 3, 6, 12, 25])))
            if rnd.random() < 0.12:
                text += pick([" 12", " 3.5 %", " (2019).", " A & B.", f" {word()}@{word()}.org", " <b>", " $5.", f" ({word().upper()})"])
            out.append(text if rnd.random() < 0.85 else text.rstrip("."))
        return out

    def verse() -> list[str]:
        upper = rnd.random() < 0.6
        lines = [words(3, 9) + pick([",", ",", ".", ";", "", ""]) for _ in range(rnd.randint(2, 10))]
        return [x.capitalize() if upper or i == 0 else x for i, x in enumerate(lines)]

    def heading() -> list[str]:
        text = words(1, 8)
        return [pick([text.capitalize(), text.title(), text.capitalize() + ":"])]

    def recipe() -> list[str]:
        amounts = [f"{rnd.randint(1, 500)} {pick(['g', 'ml', 'cups', '', 'kg'])} {words(1, 4)}".replace("  ", " ") for _ in range(rnd.randint(2, 7))]
        return heading() + amounts + [pick(["", f"{i + 1}. "]) + sentence() for i in range(rnd.randint(1, 5))]

    def listing() -> list[str]:
        mark = pick(["- ", "* ", "• ", "", "1) "])
        return [mark + pick([sentence(), words(2, 9), words(2, 9).capitalize()]) for _ in range(rnd.randint(2, 7))]

    def dialogue() -> list[str]:
        who = [word().capitalize() for _ in range(2)]
        return [f"{pick(who)}: {sentence()}" if rnd.random() < 0.6 else f'"{sentence()}" {words(1, 4)}.' for _ in range(rnd.randint(2, 8))]

    def letter() -> list[str]:
        return [f"{word().capitalize()} {word().capitalize()},", *prose(), words(2, 4).capitalize() + ",", f"{word().capitalize()} {word().capitalize()}"]

    def menu() -> list[str]:
        names = [words(1, 3).title() if rnd.random() < 0.7 else words(1, 2).capitalize() for _ in range(rnd.randint(4, 12))]
        return names if rnd.random() < 0.6 else [pick([" | ", " > ", " » ", " / ", " · "]).join(names)]

    def notice() -> list[str]:
        said = ["Click here to {}", "Copyright © 2020 {}. All rights reserved.", "Subscribe to {}", "We use cookies for {}.", "Licensed under {} 2.0.", "Sign in to {}", "Share this {}", "Read more: https://{}.com", "Privacy and terms of {}"]
        return [pick(said).format(word()) for _ in range(rnd.randint(1, 4))]

    def advert() -> list[str]:
        said = ["{0} {1} for only ${2}.99!", "Buy now and save {2} % on {0}.", "Free shipping on all {0} {1}.", "{0} sale: up to {2}% off {1}!", "Order today, limited time offer on {0} {1}!", "Best price for {0} {1}, guaranteed.", "Call now: {2}-{2}-{2}", "Add to cart", "Special offer: {0} {1} with a discount of {2} %."]
        return [pick(said).format(word().capitalize(), word(), rnd.randint(5, 90)) for _ in range(rnd.randint(2, 6))]

    def code() -> list[str]:
        said = ["{} = [{}];", "if ({}) {{ {} }}", "<{} {}=1>", "#{} {{ {}: 0 }}", "return {}.{}();", "{}: {{ \"{}\": 1 }},", "var {} = {};"]
        return [pick(said).format(word(), word()) for _ in range(rnd.randint(1, 8))]

    def numbers() -> list[str]:
        sign = pick([" ", "\t", ", ", " | ", ";"])
        return [sign.join(str(rnd.randint(0, 9999)) if rnd.random() < 0.85 else word() for _ in range(rnd.randint(3, 12))) for _ in range(rnd.randint(1, 8))]

    def spoilt(change) -> list[str]:
        """Lines of prose or of words alone with something done to each of their words."""
        lines = prose() if rnd.random() < 0.6 else [words(2, pick([4, 12, 60, 150])) + pick(["", "", "."]) for _ in range(rnd.randint(1, 3))]
        return [change(x.split(" ")) for x in lines]

    def signs() -> list[str]:
        share, some, gap = pick([1, 1, 0.9, 0.7]), rnd.sample("#*$%&|<>~^=_+", rnd.randint(1, 6)), pick(["", "", "", " "])
        return spoilt(lambda ws: " ".join(w + (gap + pick(some) * rnd.randint(1, 4) if rnd.random() < share else "") for w in ws))

    def shouting() -> list[str]:
        mark, share = pick(["!!", "!!!", "!", "!!!!"]), pick([1, 0.7, 0.3])
        return spoilt(lambda ws: " ".join(w.upper() + (mark if rnd.random() < share else "") for w in ws))

    def bars() -> list[str]:
        return spoilt(lambda ws: pick([" | ", " | ", " / ", " > "]).join(ws) + pick(["", " |"]))

    def repeated() -> list[str]:
        return [" ".join(" ".join([word()] * rnd.randint(5, 20)) for _ in range(rnd.randint(1, 12)))]

    good, bad = [prose, prose, prose, prose, verse, heading, recipe, listing, dialogue, letter], [menu, notice, advert, code, numbers, signs, signs, shouting, bars, repeated]
    out = []
    for _ in range(n):
        doc: list[tuple[str, int]] = []
        lean = pick([0.15, 0.6, 0.9])
        if rnd.random() < 0.2:  # a text with a notice under it, or over it
            doc = [(x, CONTENT) for x in prose()[:3]]
            doc.insert(pick([0, len(doc), len(doc)]), (notice()[0], BOILERPLATE))
        for _ in range(0 if doc else rnd.randint(1, 4)):
            kind = pick(good) if rnd.random() < lean else pick(bad)
            doc += [(x, CONTENT if kind in good else BOILERPLATE) for x in kind()]
        if rnd.random() < 0.15:
            doc.append(doc[0])
        out.append(doc)
    return out


#: Some letters, and marks that follow them, of scripts; their stop and comma; whether words are
#: set apart by spaces.
SCRIPTS = [
    ("कखगचजटडतदनपबमयरलवसहअआइउए", "ािीुूेैोौंँः", "।", ",", True),  # Devanagari
    ("কখগচজটডতদনপবমযরলসহঅআই", "ািীুূেৈোৌং", "।", ",", True),  # Bengali
    ("கஙசஞடணதநபமயரலவழளறனஅஆஇ", "ாிீுூெேைொ்", ".", ",", True),  # Tamil
    ("กขคงจชซดตถทนบปพมยรลวสหอ", "ะัาิีึืุู่้", "", "", False),  # Thai
    ("ابتثجحخدذرزسشصطعغفقكلمنهوي", "", ".", "،", True),  # Arabic
    ("אבגדהוזחטיכלמנסעפצקרשת", "", ".", ",", True),  # Hebrew
    ("აბგდევზთიკლმნოპრსტუფქ", "", ".", ",", True),  # Georgian
    ("አበገደሀወዘሐጠየከለመነሰፈ", "", "።", "፣", True),  # Ethiopic
    ("абвгдежзиклмнопрстуфхцч", "", ".", ",", True),  # Cyrillic
    ("αβγδεζηθικλμνξοπρστυφχ", "\u0301", ".", ",", True),  # Greek, decomposed
    ("aeioubcdfghlmnprstv", "\u0301\u0300\u0302\u0308\u0327", ".", ",", True),  # Latin, decomposed
    ("가나다라마바사아자차카타파하고노도", "", ".", ",", True),  # Hangul
    ("天地人山水大小中上下日月火木金土年生学国", "", "。", "，", False),  # Han
    ("あいうえおかきくけこさしすせそたちつてとのはをん", "", "。", "、", False),  # Kana
]


def documents_in_other_scripts(n: int = 170, seed: int = 11) -> list[list[tuple[str, int]]]:
    """As training_documents, of prose in the letters of other scripts, with spoilt lines of the same letters
    beside it, and of messages in lower case without punctuation."""
    rnd = random.Random(seed)
    pick = rnd.choice

    def prose(script: tuple) -> str:
        letters, marks, stop, comma, spaced = script

        def word() -> str:
            if rnd.random() < 0.05:
                return str(rnd.randint(1, 2030))
            return "".join(pick(letters) + (pick(marks) if marks and rnd.random() < 0.5 else "") for _ in range(rnd.randint(1, 5)))

        def sentence() -> str:
            ws = [word() + comma * (rnd.random() < 0.1) for _ in range(pick([3, 5, 8, 12, 18]))]
            if letters[0].upper() != letters[0]:
                ws[0] = ws[0].capitalize()
            said = (" " if spaced else "").join(ws) + pick([stop, stop, stop, "?", "!"])
            return said if spaced or rnd.random() < 0.3 else said + " "

        return (" " if spaced else "").join(sentence() for _ in range(pick([1, 2, 3, 6, 12]))).strip()

    out = []
    for k in range(n):
        doc: list[tuple[str, int]] = []
        script = SCRIPTS[k % len(SCRIPTS)]
        if rnd.random() < 0.15:
            letters = "aeioubcdfghlmnprstv"
            message = lambda: " ".join("".join(pick(letters) for _ in range(rnd.randint(1, 8))) for _ in range(rnd.randint(6, 30)))
            doc = [(message(), CONTENT) for _ in range(rnd.randint(1, 4))]
        for _ in range(0 if doc else rnd.randint(1, 4)):
            line = prose(script)
            if rnd.random() < 0.25:
                sign = pick("#*$%&|<>~^=_+")
                doc.append((" ".join(w + sign * rnd.randint(1, 3) for w in line.split(" ")) if " " in line else sign.join(line[:60]), BOILERPLATE))
            else:
                doc.append((line, CONTENT))
        out.append(doc)
    return out


@lru_cache(maxsize=1)
def model() -> crf.Crf:
    sequences, gold = [], []
    for doc in training_documents() + documents_in_other_scripts():
        lines = Lines(["\n".join(x for x, _ in doc)])
        sequences.append(lines.features())
        gold.append([label for _, label in doc])
    return crf.train(sequences, gold, l2=0.1, rounds=200, rate=1.0)


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, base_failed boolean, kept boolean"


def judge(texts: list[str], field: crf.Crf, min_share: float) -> list[np.ndarray]:
    """The columns of RESULT after the id, for some texts."""
    lines = Lines(texts)
    n = lines.words_of
    lengths = np.array([len(w) for w in lines.kinds], np.int64)
    chars = np.concatenate([[0], np.cumsum(lengths[lines.codes])]) if len(n) and len(lines.codes) else np.zeros(len(lines.codes) + 1, np.int64)
    at = ranges(n)
    repeats = lines.repeated_words()
    label = field.viterbi(lines.lines_of, field.emissions(lines.features()))
    content = lines.per_doc(np.where(label == CONTENT, lines.per_line, 0))
    failed = (n < 10) | (100 * repeats > 20 * n)
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    return [n, chars[at[1:]] - chars[at[:-1]], symbols, lines.per_doc(lines.later.astype(np.int64)), repeats, content, failed, ~failed & (content >= min_share * n)]


def batches_by_size(batch: pa.RecordBatch, chars: int = 2_000_000) -> Iterator[tuple[list[int], list[str]]]:
    """The rows (id, text) of a batch in runs of about so many characters."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        ids.append(i)
        texts.append(t)
        size += len(t) + 50
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def quality_rules(docs: DataFrame, min_content_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of its whole text, content_words (words in lines that the field marks
    as content), base_failed (fewer than 10 words, or over 20 % of them repeated) and kept (base passed,
    and the content share reaches min_content_share).

    Of words longer than 40 signs the field knows no more than that. A line without a word has no label and
    counts nowhere. Null and empty texts fail; repeated rows give
    repeated results; texts of any length are read whole; an empty table gives no rows; other columns,
    whatever their names, are dropped."""
    field = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RESULT.split(", ")]
        for b in batches:
            for ids, texts in batches_by_size(b):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, judge(texts, field, min_content_share))], names)

    return id_text(docs, id_col, text_col).mapInArrow(run, RESULT)


def kept_documents(docs: DataFrame, min_content_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that quality_rules keeps, all columns as they are."""
    field = model()
    return keep_rows(docs, lambda: lambda texts: judge(texts, field, min_content_share)[-1], text_col)
