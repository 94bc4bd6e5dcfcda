import hashlib
import random

import numpy as np
import pytest
from fathomlake.llm.suffix_dedup import WIDTH, common_prefixes, removable, suffix_array, suffix_dedup


def brute(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, sha) by a table of all strings."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - WIDTH + 1):
            s = b[i : i + WIDTH]
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - WIDTH + 1):
            if first[b[i : i + WIDTH]] < d:
                gone[i : i + WIDTH] = [True] * WIDTH
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["in", "of", "the", "ö", "tion", "ß", "🙂", "and", "heit"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [make(rng.randint(8, 40)) for _ in range(6)] + ["a" * 80, "ab" * 60]
    rows = []
    for i in rng.sample(range(1000), 60):
        t = "".join(rng.choice([make(rng.randint(0, 30)), rng.choice(passages), rng.choice(passages)[3:60]]) for _ in range(rng.randint(0, 5)))
        rows.append((i, t))
    rows += [(2000 + i, rng.choice(rows)[1]) for i in range(8)] + [(3000, None), (3001, ""), (3002, "x" * 49), (3003, "x" * 51), (3004, "x" * 500), (3005, "\0" * 120), (3006, "\0" * 90)]
    return rows


@pytest.mark.parametrize("seed,shard", [(1, 1 << 20), (2, 300), (3, 5000)])
def test_against_all_strings(spark, seed, shard):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, shard_bytes=shard).collect()}
    assert got == brute(rows)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    data[100:180] = data[200:280]
    order, _ = suffix_array(data, 512)
    suffixes = [data[i:].tobytes() for i in order]
    assert suffixes == sorted(suffixes)
    lcp = common_prefixes(data, order, np.array([0, 37, 150, 400]), 30)
    for k in range(1, 400):
        a, b = data[order[k - 1] :].tobytes(), data[order[k] :].tobytes()
        n = 0
        while n < min(len(a), len(b), 30) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n


def test_shards_are_merged():
    contexts = [bytes([65 + i % 3]) * 60 for i in range(30)]
    docs = np.arange(30)
    whole, parts = (sorted(removable(contexts, docs, size)) for size in (1 << 20, 100))
    assert whole == parts and {c for c, _ in whole} == set(range(3, 30))


def test_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id bigint, text string, kept string")).collect() == []


def _many_anchors():
    rng = np.random.default_rng(3)
    contexts, docs, anchors = [], [], []
    for a in range(5000):
        word, side = rng.bytes(20), [rng.bytes(30) for _ in range(3)]
        for k in range(8):
            contexts.append(side[k % 3] + word + side[k % 2])
            docs.append(a * 8 + k)
            anchors.append(a)
    return contexts, np.array(docs), np.array(anchors)


def test_unrelated_anchors_are_not_searched(monkeypatch):
    from fathomlake.llm import suffix_dedup as module

    contexts, docs, anchors = _many_anchors()
    searched = []
    monkeypatch.setattr(module, "find_strings", lambda rows, own: searched.append(len(own)) or np.full(len(own), -1))
    parts = list(module.removable_by_anchor(contexts[:4000], docs[:4000], anchors[:4000], 8 * 80 * 50))
    assert len(parts) == 10 and not searched
    found = {(c, p) for which, place in parts for c, p in zip(which.tolist(), place.tolist())}
    assert found == set(removable(contexts[:4000], docs[:4000], 1 << 30))


def test_comparison_holds_little_memory():
    import tracemalloc

    from fathomlake.llm import suffix_dedup as module

    contexts, docs, anchors = _many_anchors()
    tracemalloc.start()
    found = sum(len(which) for which, _ in module.removable_by_anchor(contexts, docs, anchors))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 200e6
