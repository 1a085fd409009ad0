"""BPE and packing against the tokenizers library, chat formatting, quality rules and the classifiers."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from shelfmark.llm import bpe, chat_format, html_extract, packing, quality_classifier, quality_rules, toxicity
from shelfmark.llm.common import py_crc_mod
from shelfmark.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


def library(name):
    t = tokenizers.Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts(seed, n):
    rnd = random.Random(seed)
    marks = [chr(c) for c in range(0x250)] + list("Σσςİıſẞ​　  漢字한글ก٣²½Ⅷ_’'\U0001f600") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", " ", "  ", "\n", " the", "ing"]
    return ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["".join(rnd.choice(["a", "the", " ", " ", "\n", "\t", ",", "'s", "9", "\x1c", "\x85"]) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_bpe_equals_the_library(spark):
    texts = odd_texts(5, 1500) + ["", "word " * 20000, "x" * 5000, "pneumonoultramicroscopic" * 9]
    t, path = library("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.json")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.bpe_round_trip(rows, path).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["ids"] == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded"] == t.decode(r["ids"], skip_special_tokens=False)
    apart = bpe.bpe_decode(bpe.bpe_encode(rows, path), path).collect()
    assert sorted(map(repr, apart)) == sorted(map(repr, got))


def test_bpe_verification_finds_what_greedy_cuts_wrongly():
    b = bpe.load(vocabulary("byte_bpe_50k.json"))
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghinorst") for _ in range(rnd.randint(1, 60))).encode() for _ in range(400)]
    flat, owner = b.propose(words)
    exact = b.exact(words)
    together = b.encode_words([w.decode() for w in words])
    wrong = 0
    for i, e in enumerate(exact):
        assert together[i] == b.id_of[e].tobytes()
        assert e.tolist() == b._exact_long(words[i])
        wrong += flat[owner == i].tolist() != e.tolist()
    assert wrong  # else the test shows nothing


@pytest.mark.parametrize("starts", [7, 1 << 16])
def test_bpe_long_words_are_mended_where_pairs_fail(monkeypatch, starts):
    monkeypatch.setattr(bpe, "STARTS", starts)
    b, rnd = bpe.load(vocabulary("byte_bpe_50k.json")), random.Random(8)
    alphabets = ["ab", "the in", "abcdefghinorst", "-=", "0123", "éßaü", "\n ", "x"]
    words = ["".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randint(1, 90))).encode() for _ in range(300)] + ["".join(rnd.choice(a) for _ in range(3000)).encode() for a in alphabets]
    for w in words:
        assert b.propose_long(w).tolist() == b.propose([w])[0].tolist()
        assert b.encode_long(w).tolist() == b._exact_long(w)


def test_bpe_of_a_very_long_word_equals_the_library():
    t, encode, rnd = library("byte_bpe_50k.json"), bpe.encoder(vocabulary("byte_bpe_50k.json")), random.Random(9)
    for word in ("".join(rnd.choice("abcdefghinorst") for _ in range(200_000)), "nan" * 40_000, "<|endoftext|>" + "漢字" * 20_000):
        assert encode([word])[0].tolist() == t.encode(word, add_special_tokens=False).ids


def test_bpe_nulls_repeats_and_empty_tables(spark):
    schema, path = "doc_id long, text string, ids string, decoded string", vocabulary("byte_bpe_50k.json")
    got = bpe.bpe_round_trip(spark.createDataFrame([(1, None, "x", "y"), (None, "a", None, None), (None, "a", None, None)], schema), path).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, [got[0], got[1], got[1]])) and [len(r["ids"]) for r in got] == [0, 1, 1]
    assert bpe.bpe_round_trip(spark.createDataFrame([], schema), path).count() == 0


def test_packing_holds_each_id_once(spark):
    texts = odd_texts(6, 600) + ["", None, "lorem ipsum " * 30000]
    t = library("word_bpe_49k.json")
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in enumerate(texts)}
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), vocabulary("word_bpe_49k.json"), windows_per_load=4).collect()
    at, used = Counter(), Counter()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(v) for i, v in want.items()}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]] and r["length"] > 0
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096 and all(n == 4096 or n & (n - 1) == 0 for n in used.values())


def test_packing_many_short_documents(spark):
    """Work and memory follow the ids: 65,536 documents of an id or two take no more than a few megabytes."""
    import tracemalloc

    rnd = random.Random(3)
    for sizes in ([1] * 65_536, [rnd.choice([1, 2, 3, 40, 255, 256, 300, 5000]) for _ in range(4000)], [], [1], [4096, 1, 8192]):
        tracemalloc.start()
        packed = packing.pack_rows(sizes)
        assert tracemalloc.get_traced_memory()[1] < 60_000_000
        tracemalloc.stop()
        cut = {}
        for seq in packed:
            n = sum(p[2] for p in seq)
            assert n <= 4096 and all(p[2] > 0 for p in seq) and (n == 4096 or n & (n - 1) == 0)
            for i, start, length in seq:
                cut.setdefault(i, []).append((start, length))
        assert set(cut) == set(range(len(sizes)))
        for i, pieces in cut.items():
            pieces.sort()
            assert [p[0] for p in pieces] == [sum(p[1] for p in pieces[:k]) for k in range(len(pieces))] and sum(p[1] for p in pieces) == sizes[i]
    rows = packing.pack(spark.range(200_000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text").coalesce(1), vocabulary("word_bpe_49k.json"))
    told = rows.groupBy("sequence_id").agg(F.count("*").alias("n"), F.max("offset").alias("last")).collect()
    assert rows.select("doc_id").distinct().count() == 200_000 and sum(r["n"] for r in told) == 200_000
    assert all(r["last"] == r["n"] - 1 for r in told) and sum(r["n"] < 4096 for r in told) <= 12


def test_packing_beside_columns_of_the_same_names(spark):
    names = "start length ids_crc32 doc_tokens sequence_id offset".split()
    docs = [(i % 3, "one two three " * i) for i in range(40)]
    rows = spark.createDataFrame([(*d, *"abcdef") for d in docs], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).coalesce(1)
    path = vocabulary("word_bpe_49k.json")
    got = packing.pack(rows, path)
    assert got.columns == ["doc_id", *names]
    assert sorted(got.collect()) == sorted(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), path).collect())


def test_packing_nulls_and_empty_tables(spark):
    schema, path = "doc_id long, text string, start string", vocabulary("word_bpe_49k.json")
    got = packing.pack(spark.createDataFrame([(None, None, "x"), (4, "", None), (4, "", None)], schema), path).collect()
    assert [r["length"] for r in got] == [1, 1, 1]
    assert packing.pack(spark.createDataFrame([], schema), path).count() == 0


def test_differencing_is_near_equal():
    rnd = random.Random(2)
    sizes = [rnd.randint(1, 900) for _ in range(300)]
    load = np.bincount(packing.differencing(sizes, 16), weights=sizes, minlength=16)
    assert load.sum() == sum(sizes) and load.max() - load.min() <= 8


def test_chat_round_trip(spark):
    rnd = random.Random(3)
    marks = ["<s>", "</s>", "[INST] ", " [/INST]", "[/SYS]", "[ROLE a] ", "[/ROLE]", "\\", "<\\/s>", "x", " ", "\n", "]"]
    turns = [(c, k, rnd.choice(["system", "user", "assistant", "tool]\\", None]), "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 9))) or None, "z") for c in range(120) for k in range(rnd.randint(1, 5))]
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, rendered string"))).collect()}
    for c in {t[0] for t in turns}:
        mine = [(t[2] or "", t[3] or "") for t in turns if t[0] == c]
        loss = "".join(x for r, x in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_of_odd_rows(spark):
    long = "</s>[INST] no [/INST] " * 40_000
    rows = [(None, 1, "assistant", "a"), (None, 0, "user", "b"), (1, None, "user", "first"), (1, 0, "user", "y"), (1, 0, "user", "x"), (1, 0, "assistant", "z"), (1, 0, "assistant", "z"), (2, 0, "user", long), (2, 1, "assistant", long)]
    frame = spark.createDataFrame([(*r, 9, "s") for r in rows], "conv_id long, turn long, role string, text string, start long, rendered string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(frame)).collect()}
    want = {None: [("user", "b"), ("assistant", "a")], 1: [("user", "first"), ("assistant", "z"), ("assistant", "z"), ("user", "x"), ("user", "y")], 2: [("user", long), ("assistant", long)]}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def rules_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def test_quality_rules_base_counts(spark):
    rnd = random.Random(7)
    texts = ["", None, "\n\x0b\n", "a b c d e " * 40] + ["".join(rnd.choice(["ab", "c#", "d", " ", " ", "\n", "\t", "é|", " x", "\x1c"]) for _ in range(rnd.randint(0, 160))) for _ in range(300)]
    got = quality_rules.quality_rules(spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == rules_brute(texts[r["doc_id"]] or "")
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_extracts_the_article_only(spark):
    page = '<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href=x>Home page</a></li></ul></nav><article><h1>A title &amp; more</h1><p>First  <b>bold</b>\nsentence of the text, which goes on for a while.</p><p>Second sentence of the same text.</p></article><div class="comments"><p>I disagree.</p></div><footer>&copy; someone</footer></body></html>'
    rows = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, None), (3, "v", "", "y")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(rows).collect()}
    assert got == {1: "A title & more First bold sentence of the text, which goes on for a while. Second sentence of the same text.", 2: "", 3: ""}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("operator, label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_documents(spark, operator, label):
    rnd = random.Random(9)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(600):
        y = i % 2
        words = rnd.choices(good if y else bad, k=12) + rnd.choices(good + bad, k=6)
        rnd.shuffle(words)
        docs.append((i, " ".join(words), 0.5, str(y)))
        labels.append((i, y, y))
    docs += [(1000, None, None, None), (None, "good1", None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double, quality string")
    model = operator.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = operator.score(d, model).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["held_out"]]
    assert all(r["held_out"] == (py_crc_mod(r["doc_id"], 5) == 0) for r in got if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 for r in got) and len(held) > 60
    assert sum((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in held) >= 0.95 * len(held)
    assert operator.score(spark.createDataFrame([], d.schema), model).count() == 0
