"""Tokenization, its operators and their queries against the untouched library."""

from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from onomast.llm import base, counts, packing, queries, tokenbin, word_cache
from onomast.llm.word_cache import CachedEncoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "x", "a  b", "tab\tend ", "don't, it's; A's", "é ́x, Ünï.", "\x1c a", "1,2.3 日本, 語.", "<|endoftext|> a", "word " * 50, "a\n\nb c", "İ. x ſ's"]
ODD += [" \x85b", "a \n <|endoftext|>  z", " q", "A.\n b", "Σ ΑΣ, ΑΣ.", "ª µ ß, ÿ.", "​z", "  x", "x;́ y", "<|EndOfText|> é", "｜ ;", "\t\tx", " \n x"]
BITS = ["the", "Ab,", "x.\ny", " ", "\n", "\t", "", "\x1f", "\x85", "don't", "'s", "12", "日本", "é", "<|endoftext|>", "!!", "a\n\nb", "É.\nü", "́"]


def plain(path, as_text=False):
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = as_text
    return lambda t: library.encode(t or "", add_special_tokens=False).ids


def mixed(n, longest):
    return " ".join(random.choice(BITS) for _ in range(random.randint(0, longest))) if n % 2 else "".join(random.choice([x or "" for x in ODD] + BITS) for _ in range(random.randint(0, 20)))


@pytest.mark.parametrize("path", [WORDS, BYTES])
@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("most", [50, word_cache.MAX_UNITS])
def test_ids_are_the_librarys(path, as_text, most):
    random.seed(3)
    code, ids = CachedEncoder(path, as_text), plain(path, as_text)
    code._after.most = code._heads.most = most
    for t in ODD + [mixed(n, 40) for n in range(600)] + ODD:
        assert code.ids(t).tolist() == ids(t), repr(t)
    assert len(code._after) <= most


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_a_text_with_more_words_than_the_table(path):
    code, ids = CachedEncoder(path), plain(path)
    code._after.most = 50
    text = " ".join(f"w{k}x{chr(97 + k % 26)}," for k in range(700)) + " " + "q" * 5000
    other = code.raw([text, text + " z"])
    assert np.frombuffer(next(other), "<u4").tolist() == ids(text)
    assert code.ids("some other words").tolist() == ids("some other words")  # used by another while the first is not done
    assert np.frombuffer(next(other), "<u4").tolist() == ids(text + " z")
    assert max(map(len, code._after)) <= word_cache.MAX_UNIT_CHARS


@pytest.mark.parametrize("path", [WORDS, BYTES])
@pytest.mark.parametrize("most", [50, 10_000])
def test_tree_under_edits(path, most):
    random.seed(1)
    code, ids = CachedEncoder(path), plain(path)
    code._after.most = code._heads.most = most
    for _ in range(100):
        t = " ".join(random.choice(BITS) for _ in range(random.choice([0, 1, 3, 40, 300])))
        tree = counts.CountTree(t, code)
        for _ in range(8):
            a = random.randint(0, len(t))
            b = random.randint(a, min(len(t), a + random.choice([0, 1, 2, 20, 200, 2000])))
            new = random.choice(["", "q", " ", "a b", "\n", "  z ", "<|endoftext|>", "the " * 100, " \n "])
            tree.edit(a, b, new)
            t = t[:a] + new + t[b:]
            assert (tree.text(), tree.chars, tree.tokens) == (t, len(t), len(ids(t)))
    with pytest.raises(ValueError):
        tree.edit(0, len(t) + 1, "")


def test_edits_at_one_place_stay_small():
    tree, ids = counts.CountTree("some words here " * 4000, CachedEncoder(BYTES)), plain(BYTES)
    assert max(tree.edit(30_000, 30_010, "zz yy xx some other words here") for _ in range(300)) < 1500
    assert max(tree.edit(100, 130, "") for _ in range(300)) < 1500
    assert tree.tokens == len(ids(tree.text()))


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{FOLDER}/documents.parquet'").fetchall())


def test_packing_query(spark, documents):
    ids = plain(WORDS)
    want = {k: [*ids(t), 0] for k, t in documents.items()}
    rows = queries.op1_best_fit_packing(spark, FOLDER).collect()
    pieces = {}
    for r in rows:
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and r["length"] == min(2048, len(want[r["doc_id"]]) - r["start"])
        assert r["ids_crc32"] == zlib.crc32(np.asarray(part, dtype="<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append(r["piece"])
    assert {k: sorted(v) for k, v in pieces.items()} == {k: list(range(-(-len(v) // 2048))) for k, v in want.items()}
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert len(places) <= 1.05 * sum(map(len, want.values())) / 2048 + 1


def test_token_count_query(spark, documents):
    ids = plain(BYTES)
    rows = queries.op4_token_counts(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        t = documents[r["doc_id"]]
        n, new = len(t), t[:16][::-1]
        assert (r["n_chars"], r["n_tokens"]) == (n, len(ids(t)))
        for k in (1, 2):
            t = t[: n * k // 3] + new + t[min(n, n * k // 3 + 16) :]
        assert (r["edited_chars"], r["edited_tokens"]) == (len(t), len(ids(t)))


def test_token_file_query(spark, documents):
    ids, at = plain(BYTES), 0
    rows = {r["doc_id"]: r for r in queries.op7_token_files(spark, FOLDER).collect()}
    assert len(rows) == len(documents)
    for k in sorted(documents):
        own = np.asarray([*ids(documents[k]), 2], dtype="<u4")
        assert (rows[k]["start"], rows[k]["n_tokens"], rows[k]["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_tasks_with_full_tables(spark, monkeypatch):
    """Each operator with a table that overflows within one text, null and repeated doc_ids."""
    monkeypatch.setattr(word_cache, "MAX_UNITS", 50)
    word_cache.release()
    texts = [" ".join(f"u{k}v{j}" for k in range(300)) for j in range(20)] + [None, "", "<|endoftext|> z"]
    rows = [(None if j % 3 == 0 else j % 7, t) for j, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words, bytes_ = plain(WORDS), plain(BYTES)
    key = lambda i, n: (i is None, i or 0, n)
    packed = packing.pack_documents(docs, WORDS, 512)
    got = sorted((r["doc_id"], r["start"], r["length"]) for r in packed.where("doc_id is not null").collect())
    assert got == sorted((i, a, min(512, len(words(t)) + 1 - a)) for i, t in rows if i is not None for a in range(0, len(words(t)) + 1, 512))
    assert packed.where("doc_id is null").selectExpr("sum(length)").first()[0] == sum(len(words(t)) + 1 for i, t in rows if i is None)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in counts.count_tokens(docs, BYTES).collect()), key=lambda x: key(*x))
    assert got == sorted(((i, len(bytes_(t))) for i, t in rows), key=lambda x: key(*x))
    folder = base.scratch(spark, "t")
    tokenbin.write(docs, folder, BYTES, 50_257)
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in tokenbin.read(spark, folder).collect()), key=lambda x: key(*x))
    assert got == sorted(((i, len(bytes_(t)) + 1) for i, t in rows), key=lambda x: key(*x))


def test_encoder_holds_as_many_units_as_asked(monkeypatch):
    """op7's tables are larger than those of operators that share a worker's memory; the bound is set at each call."""
    monkeypatch.setattr(word_cache, "MAX_UNITS", 50)
    word_cache.release()
    made = []
    code = word_cache.encoder(BYTES, 200)
    unit = code._unit
    monkeypatch.setattr(code, "_unit", lambda u, table: made.append(u) or unit(u, table))
    text = " ".join(f"word{k}x" for k in range(150))
    want = plain(BYTES)(text)
    assert code.ids(text).tolist() == want and made
    made.clear()
    assert code.ids(text).tolist() == want and not made
    assert word_cache.encoder(BYTES) is code and code.ids(text + " more").tolist() == plain(BYTES)(text + " more")
    assert len(code._after) <= 50
    assert tokenbin.UNITS > 500_000  # sf0.1 has about 500,000 distinct units, which emptied tables of 400,000 again and again
    word_cache.release()
