"""The corpus operators against brute force, exact round trips and held-out accuracy, with awkward inputs."""

from __future__ import annotations

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from onomast.llm import base, capfilters, counts, digest, langid, minhash, mixing, packing, quality, tokenbin, warc

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, queue string, rep long"
ODD = [None, "", " ", "\n\n", "x", "a  b", "tab\tend ", "don't, it's; A's", "é ́x, Ünï.", "\x1c a", "1,2.3 日本, 語.", "<|endoftext|> a", "word " * 5000, "a\n\nb c", "İ. x ſ's"]


def docs_of(spark, texts):
    """Documents with columns whose names the operators use inside."""
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, 0, "q", -1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD + ["same text here", "same text here"])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_best_fit():
    b, placed = packing.BestFit(10, 3), []
    for n in (6, 5, 7, 4, 10, 3, 9, 5):
        placed.append((*b.place(n), n))
    bins = {}
    for number, offset, n in placed:
        assert offset == bins.get(number, 0)
        bins[number] = offset + n
    assert max(bins.values()) <= 10 and bins[0] == 10  # 4 goes to the bin of 6, the fullest with room
    with pytest.raises(ValueError):
        b.place(11)


def test_packing(spark, odd, nothing):
    p = packing.pack_documents(odd, WORDS, 64, with_ids=True)
    rows = p.collect()
    code = Tokenizer.from_file(WORDS)
    ids = {k: [*code.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(ODD + ["same text here"] * 2)}
    whole = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        got = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == len(whole.setdefault(r["doc_id"], [])) and r["length"] == len(got) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        whole[r["doc_id"]] += got
    assert whole == ids
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.sequences(p).count() == len(places)
    assert packing.pack_documents(nothing, WORDS).count() == 0


def test_mixing(spark, odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r["size"] for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    left, target, free = 1.5 * sum(size.values()), {}, set(sources)
    while free:  # the rule as it is said: shares by weight, the excess shared anew
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    for s in sources:
        own = [r for r in rows if r["source"] == s]
        assert abs(own[0]["target"] - target[s]) < 1e-3 and abs(sum(r["taken"] for r in own) - target[s]) <= 1
    placed = [r["first_position"] for r in rows if r["first_position"] is not None]
    assert placed == sorted(placed) and all(0 <= x <= 1 for x in placed)
    assert mixing.mix(nothing).count() == 0
    taken = mixing.apply_mix(odd, mixing.mix(odd))
    assert taken.columns == odd.columns and taken.select(F.sum(F.regexp_count("text", F.lit(base.WORD)))).first()[0] == sum(r["taken"] for r in rows)


def test_mixing_rows_of_one_id(spark):
    """Rows without a doc_id and copies are a queue of their own rows: as many rows come out, and targets are met."""
    rows = [(None, f"w{k % 5} " * (k % 5), "s") for k in range(200)] + [(7, "a b c", "s")] * 90 + [(8, "x", None)] * 3
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(1))).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((i or -1, len(t.split())) for i, t, _ in rows)
    for s in ("s", None):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and all(r["taken"] <= 2 * r["size"] for r in own)


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(n)]


def test_near_duplicates(spark, nothing):
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n", "A b", "a B", "one"]
    for _ in range(6):
        first = [random.choice(vocabulary) for _ in range(80)]
        texts.append(" ".join(first))
        for _ in range(14):
            edited = list(first)
            for _ in range(random.randint(0, 6)):
                edited[random.randrange(80)] = random.choice(vocabulary)
            texts.append(" ".join(edited) + random.choice(["", " "]))
    sets = [shingles(t, 3) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components_of(len(texts), links)
    rows = minhash.near_duplicates(docs_of(spark, texts), 3, 85).collect()
    got = {r["doc_id"]: r for r in rows}
    assert [got[k]["component_id"] for k in range(len(texts))] == want and [got[k]["n_shingles"] for k in range(len(texts))] == [len(s) for s in sets]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert minhash.near_duplicates(nothing, 3, 85).count() == 0


def test_estimates_are_corrected():
    rng = np.random.default_rng(0)
    common, own, other = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (850, 75, 75))
    a, b = (minhash.pack_bits(minhash.minima(np.concatenate([common, x]), 2048)).view(np.uint64) for x in (own, other))
    assert abs(float(minhash.estimates(a, b)) - 0.85) < 0.04


def test_components(spark):
    random.seed(2)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(0, k) for k in range(200, 290)]
    want = components_of(300, links)
    got = {r["node"]: r["component"] for r in base.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == want[k] for x in links for k in x if x[0] != x[1])


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 64))
    rows = [(k, (centres[k % 40] + 0.08 * (k % 7) / 7 * rng.standard_normal(64)).astype(np.float32).tolist(), k % 3 if k % 11 else None) for k in range(600)]
    rows += [(600, rows[1][1], rows[1][2]), (601, [0.0] * 64, 1), (602, None, 1), (603, [float("nan")] * 64, 1), (604, [1.0, None], 1), (605, [], 1), (606, [3 * v for v in rows[1][1]], rows[1][2])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in capfilters.near_duplicates(d).collect()}
    ok = [r for r in rows[:601] + rows[606:] if r[2] is not None]
    x = np.array([r[1] for r in ok], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos, label = x @ x.T, np.array([r[2] for r in ok])
    link = (cos >= 0.98) & (label[:, None] == label[None, :])
    ids = [r[0] for r in ok]
    sure = np.abs(cos - 0.98).min(axis=1) > 1e-9
    found = sum(got[i]["n_links"] for i in ids)
    assert found <= link.sum() - len(ok) and found >= 0.995 * (link.sum() - len(ok)) and sure.any()
    for k in (601, 602, 603, 604, 605, 0):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert len(got) == len(rows) and capfilters.near_duplicates(d.where("false")).count() == 0


def test_token_counts(spark, odd, nothing):
    code = Tokenizer.from_file(BYTES)
    for r in counts.count_tokens(odd, BYTES).collect():
        t = (ODD + ["same text here"] * 2)[r["doc_id"]] or ""
        n = len(t)
        assert (r["n_chars"], r["n_tokens"]) == (n, len(code.encode(t, add_special_tokens=False).ids))
        new = t[:16][::-1]
        for k in (1, 2):
            at = n * k // 3
            t = t[:at] + new + t[min(n, at + 16) :]
        assert (r["edited_chars"], r["edited_tokens"]) == (len(t), len(code.encode(t, add_special_tokens=False).ids))
    assert counts.count_tokens(nothing, BYTES).count() == 0


def test_token_files(spark, odd, nothing):
    folder = base.scratch(spark, "t")
    m = tokenbin.write(odd, folder, BYTES, 50_257)
    code, at = Tokenizer.from_file(BYTES), 0
    for r in sorted(tokenbin.read(spark, folder, with_ids=True).collect(), key=lambda r: r["doc_id"]):
        ids = np.asarray([*code.encode((ODD + ["same text here"] * 2)[r["doc_id"]] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (at, len(ids), ids.tolist(), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert m["type"] == "<u2" and tokenbin.document(folder, m, m["parts"][0]["part"], 0).tolist() == [2]
    none = base.scratch(spark, "t")
    tokenbin.write(nothing, none, BYTES, 50_257)
    assert tokenbin.read(spark, none).count() == 0


def test_language(spark, nothing):
    random.seed(5)
    sounds = {"en": ["the", "ing", "and", "wh", "sh"], "de": ["sch", "ung", "ei", "der", "ü"], "fr": ["eau", "é", "que", "ou"], "es": ["ción", "ñ", "os", "ll"]}
    rows = [(k, " ".join("".join(random.choices(sounds[x], k=3)) for _ in range(30)), x) for k, x in ((k, random.choice(list(sounds))) for k in range(600))]
    rows += [(1000, None, "en"), (1001, "12 !!", "en"), (1002, "", None), (None, "the shing", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit("clash"))
    got = langid.identify(d).collect()
    truth = {r[0]: r[2] for r in rows[:600]}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {"und"} and len(got) == len(rows)
    assert langid.identify(nothing).count() == 0
    long = "the shing and " * 100_000
    assert np.allclose(langid.ngrams([long]), langid.ngrams([long[:14_000]]), atol=2e-2)


def test_boosted_trees():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.BoostedTrees(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    row = x[2000]  # the flat arrays, walked by hand
    total = model.start
    for t in range(len(model.feature)):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + 1 + (row[model.feature[t, node]] > model.cut[t, node])
        total += model.leaf[t, node - (2**model.depth - 1)]
    assert abs(model.score(x[2000:2001])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_quality(spark, nothing):
    random.seed(6)
    good = lambda: " ".join(random.choice(["word", "other", "thing", "place"]) + random.choice(["", "", "."]) for _ in range(40))
    rows = [(k, good() if k % 3 else " | ".join(["JUNK!!"] * 30)) for k in range(400)] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(5))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(400)] + [(None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_quality(d, labels).collect()}
    assert all(got[k]["predicted"] == int(k % 3 > 0) for k in range(400)) and len(got) == len(rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())
    assert quality.score_quality(nothing, labels).count() == 0 and quality.score_quality(d, labels.where("false")).first()["score"] == 0.5


def test_warc(spark, nothing):
    random.seed(8)
    html = [None, "", "a", "a", "é" * 30_000, "é" * 30_000, "x\r\n0\r\n\r\n" * 10, "".join(random.choices("ab<> \n", k=60_000))]
    rows = [(10 - k, f"http://x/{k} y\n", h) for k, h in enumerate(html)] + [(None, None, "a")]
    folder = base.scratch(spark, "w")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).repartition(3)
    assert warc.write(pages, folder).agg(F.sum("records")).first()[0] > len(rows)  # some are segmented
    got = {r["page_id"]: r for r in warc.read(spark, folder, with_payload=True).collect()}
    for page_id, _, h in rows:
        data = (h or "").encode()
        first = min((p for p, _, o in rows if (o or "").encode() == data and p is not None), default=None)
        r = got[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.digest_of(data))
        if page_id is None or page_id == first:
            assert r["record_type"] == "response" and bytes(r["payload"]) == data and r["refers_to"] is None
        else:
            assert (r["record_type"], r["refers_to"]) == ("revisit", first)
    assert warc.dechunked(warc.chunked(b"z" * 10_001)) == b"z" * 10_001
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab")
    empty = base.scratch(spark, "w")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), empty).count()
    assert warc.read(spark, empty).count() == 0


def test_batches_to_python_are_bounded_in_bytes(spark):
    """Long texts go to Python in small batches, in the session that queries use."""
    own = base.own_session(spark)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    long = own.range(0, 200, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
    got = long.mapInArrow(run, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 200 and max(r["bytes"] for r in got) <= base.BATCH_BYTES + 200_000


def test_fingerprints(spark, nothing):
    random.seed(9)
    texts = ODD + ["Same  TEXT here", "same text\nhere", "ｓａｍｅ text here"] + ["".join(random.choices("ab é", k=random.randint(0, 50))) for _ in range(60)]
    rows = sorted(digest.fingerprints(docs_of(spark, texts), ranges=11).collect(), key=lambda r: -r["doc_id"])
    t = [x or "" for x in reversed(texts)]
    assert len(rows) == len(texts)
    for k, r in enumerate(rows):
        own, following = t[k], t[(k + 1) % len(t)]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + following[:cut]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest(), digest.digest(own), digest.digest(edited))
        assert (r["near_edited"], r["near_next"]) == (float(digest.canonical(own) == digest.canonical(edited)), float(digest.canonical(own) == digest.canonical(following)))
    assert digest.digest("Same  TEXT here") == digest.digest("ｓａｍｅ text here ")
    assert digest.fingerprints(nothing).count() == 0
    one = digest.fingerprints(docs_of(spark, ["abcdef"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


@pytest.mark.parametrize("most", [500_000, 1])
def test_only_repeated_texts_leave_the_workers(spark, monkeypatch, most):
    """The comparison of bytes gets each repeated text of a batch once; beyond MOST_DIGESTS all, and the join keeps the repeated."""
    monkeypatch.setattr(digest, "MOST_DIGESTS", most)
    sent, real = [], type(spark.range(0)).mapInArrow

    def spied(self, f, schema, *a, **b):
        out = real(self, f, schema, *a, **b)
        if "canonical" in schema:
            sent.append(out)
        return out

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", spied)
    texts = [f"alone {k}" for k in range(30)] + ["Copy", "copy "] * 20 + ["other", "OTHER"]
    assert digest.buckets(docs_of(spark, texts).coalesce(1)).count() == 0
    got = sorted(r["canonical"] for r in sent[0].collect())
    assert got == (["copy", "other"] if most > 1 else sorted([f"alone {k}" for k in range(30)] + ["copy", "other"]))


def test_unlike_texts_in_a_bucket(spark, monkeypatch):
    """With digests that collide, fingerprints still are equal for equal canonical texts alone."""
    hasher = lambda data, seed: f"{len(data) % 4 if seed == 0 else data[:1].hex()}"
    texts = ["a", "b", "c", "dd", "ee", "A ", "ff", None, "ggg", "hhh", "b", "dddd"]
    t = [x or "" for x in reversed(texts)]
    canon = [digest.canonical(x) for x in t]
    assert digest.buckets(docs_of(spark, texts), 1, hasher).count() == 6
    for most, length in ((1000, 3), (3, 4)):  # told of the unlike texts, or widened by a second seed
        monkeypatch.setattr(digest, "MOST_UNLIKE", most)
        rows = sorted(digest.fingerprints(docs_of(spark, texts), hasher=hasher).collect(), key=lambda r: -r["doc_id"])
        for a, x in enumerate(canon):
            for b, y in enumerate(canon):
                assert (rows[a]["fingerprint"] == rows[b]["fingerprint"]) == (x == y)
            edited = t[a][: len(t[a]) - len(t[a]) // 3] + t[(a + 1) % len(t)][: len(t[a]) // 3]
            same = digest.canonical(edited) == x
            assert (rows[a]["near_edited"], rows[a]["fingerprint"] == rows[a]["edited_fingerprint"]) == (float(same), same)
            assert rows[a]["near_next"] == float(canon[(a + 1) % len(t)] == x)
        assert max(len(r["fingerprint"]) for r in rows) <= length
    monkeypatch.setattr(digest, "MOST_UNLIKE", 1)
    with pytest.raises(RuntimeError):
        digest.fingerprints(docs_of(spark, texts), hasher=lambda data, seed: "0")


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_estimates_by_bits(bits):
    rng = np.random.default_rng(bits)
    common, own, other = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    a, b = (minhash.pack_bits(minhash.minima(np.concatenate([common, x]), 4096), bits).view(np.uint64) for x in (own, other))
    assert abs(float(minhash.estimates(a, b, bits)) - 0.8) < 0.04 and float(minhash.estimates(a, a, bits)) == 1
