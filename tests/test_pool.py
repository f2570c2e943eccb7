"""The pool's kernel over chunks of names and blocks of entries equals brute force, and makes no row of a pair that it drops."""

import random

import numpy as np
import pytest

from onomast.operators import pooling, retrieval

SIZE = 7


def brute(looked, posted):
    """{query: [(entry, score)]} in order, by every pair of a lookup and a posting."""
    scores, firsts = {}, {}
    for q, seq, channel, key, weight in looked:
        for c, k, e in posted:
            if (c, k) == (channel, key):
                scores[q, e] = scores.get((q, e), 0) + weight
                firsts[q, e] = min(firsts.get((q, e), seq), seq)
    return {q: [(e, scores[q, e]) for e in sorted((e for p, e in scores if p == q), key=lambda e: (-scores[q, e], firsts[q, e], e))[:SIZE]] for q in {x[0] for x in looked} if any(p == q for p, _ in scores)}


@pytest.mark.parametrize(("chunk", "block", "twice"), [(40_000, 2_000_000, False), (30, 60, False), (30, 60, True)])
def test_pool_equals_brute_force(spark, monkeypatch, chunk, block, twice):
    monkeypatch.setattr(retrieval, "CHUNK_LOOKUPS", chunk)
    monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", block)
    r = random.Random(5)
    keys = [("norm", "a:b"), ("norm", "b"), ("compact", "b"), *(("bigram", x) for x in "abcdefgh"), *(("tr", x) for x in "ab")]
    posted = [(c, k, e * 4096) for e in range(60) for n, (c, k) in enumerate(keys) if r.random() < (1, 0.8, 0.5, 0.1)[n % 4]]
    posted += posted[::9] if twice else []
    looked = [(q, s, *r.choice(keys), r.choice([1, 2, 5, 900])) for q in range(25) for s in range(r.randint(1, 9))] + [(99, 0, "bigram", "nowhere", 3)]
    got = retrieval.pool(spark.createDataFrame(looked, "query_id long, lookup_seq int, channel string, key string, weight int"), spark.createDataFrame(posted, "channel string, key string, entry_ord long"), SIZE)
    found = {}
    for x in sorted(got.collect(), key=lambda x: (x["query_id"], x["pool_rank"])):
        found.setdefault(x["query_id"], []).append((x["entry_ord"], x["retrieval_score"]))
    assert found == brute(looked, posted)


def test_pool_joins_no_pairs(spark, capsys):
    looked = spark.createDataFrame([(1, 0, "bigram", "ab", 1)], "query_id long, lookup_seq int, channel string, key string, weight int")
    retrieval.pool(looked, spark.createDataFrame([("bigram", "ab", 0)], "channel string, key string, entry_ord long")).explain()
    plan = capsys.readouterr().out
    assert "HashJoin" not in plan and "SortMergeJoin" not in plan


def test_entries_with_common_keys_only_are_left_out():
    n, rare = 1000, 10  # key 0 is in every entry, key 1 in all but one, keys 2 and 3 in every tenth
    rows = [np.arange(n), np.arange(1, n), np.arange(0, n, rare), np.arange(0, n, rare)]
    block = pooling.Block(np.arange(n), np.repeat(np.arange(4), [len(x) for x in rows]), np.concatenate(rows), 4)
    asked = []
    worthy = block._worthy
    block._worthy = lambda *a: asked.append(worthy(*a)) or asked[-1]
    at, score, first = block.best([3, 2, 1, 0], [1, 1, 1, 5], [3, 2, 1, 0], SIZE)
    assert sorted(at.tolist()) == [k * rare for k in range(1, SIZE + 1)] and set(score.tolist()) == {8} and set(first.tolist()) == {0}
    assert len(asked[0]) == n // rare
