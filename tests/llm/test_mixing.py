import random

import pytest
from fathomlake.llm.mixing import mix_sources

SCHEMA = "doc_id bigint, source string, text string, size int"


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cap, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.remove(s)


@pytest.mark.parametrize("seed,rows", [(1, 300), (2, 1), (3, 40)])
def test_targets_and_taken_words(spark, seed, rows):
    rng = random.Random(seed)
    docs = []
    for i in range(rows):
        source = rng.choice(["a"] * 6 + ["b", "c", "é", "Z", None])
        docs.append((i, source, " ".join(["w"] * rng.choice([0, 1, 3, 20, 50])) if rng.random() > 0.05 else None, 9))
    got = mix_sources(spark.createDataFrame(docs, SCHEMA), bin_rows=10).collect()
    sizes = {}
    for _, s, t, _ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    assert len(got) == rows
    taken = {s: 0 for s in sizes}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 50
    again = {(r.doc_id, r.taken) for r in mix_sources(spark.createDataFrame(docs[::-1], SCHEMA).repartition(5), bin_rows=10).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_empty_and_weightless(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = mix_sources(spark.createDataFrame([(1, "a", "", 1), (1, "a", "", 1), (None, None, None, 1)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3


def test_odds_prefer_documents(spark):
    docs = [(i, "ab"[i % 2], "w w", 100 if i % 10 < 4 else 1) for i in range(1000)]
    rows = mix_sources(spark.createDataFrame(docs, SCHEMA), odds_col="size").collect()
    part = [r for r in rows if r.source == "b"]
    base = min(r.copies for r in part)
    rich, poor = ([r.copies - base for r in part if (r.doc_id % 10 < 4) is x] for x in (True, False))
    assert sum(rich) / len(rich) > 2 * sum(poor) / len(poor)


def test_a_document_that_does_not_fit_is_passed_over(spark):
    """One text holds most of its source: whatever the order, the others fill the target."""
    docs = [(0, "a", "w " * 8000, 1)] + [(i, "a", "w " * 20, 1) for i in range(1, 100)] + [(i, "b", "w " * (100 + i % 7), 1) for i in range(100, 220)] + [(300, "c", "w " * 400, 1)]
    for seed in ("s1", "s2", "s3"):
        rows = mix_sources(spark.createDataFrame(docs, SCHEMA).repartition(4), seed=seed, by_size=True).collect()
        taken, target = {}, {}
        for r in rows:
            taken[r.source] = taken.get(r.source, 0) + r.taken
            target[r.source] = r.target
            assert r.taken <= 3 * r.size
        for s in target:
            left = [r.size for r in rows if r.source == s and r.copies == min(x.copies for x in rows if x.source == s)]
            assert taken[s] <= target[s] + 1e-6 and target[s] - taken[s] <= min(left)
