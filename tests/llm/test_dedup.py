import hashlib
import random

import pytest
from fathomlake.llm.exact_dedup import chunk_pattern, exact_dedup
from fathomlake.llm.line_dedup import line_dedup
from fathomlake.llm.ngram_join import Bands, CountTree, group_counts, keys_of, ngram_join
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, recipe string, id int"


def corpus(seed, lines=True):
    rng = random.Random(seed)
    words = ["a", "bé", "c.", "der", "e", "🙂", "kept", "\t"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    blocks = ["\n".join(line() for _ in range(5)) for _ in range(4)]
    rows = []
    for i in rng.sample(range(500), 80):
        rows.append((i, "\n".join(rng.choice([line(), rng.choice(blocks)]) for _ in range(rng.randint(0, 8))), None, 0))
    rows += [(900 + i, rng.choice(rows)[1], "x", i) for i in range(30)]
    return rows + [(1000, None, None, 1), (1001, "", None, 1), (1002, "word " * 30_000, None, 1), (1003, "word " * 30_000, None, 1), (1003, "word " * 30_000, None, 1)]


@pytest.mark.parametrize("identify", [F.xxhash64, lambda c: F.length(c) % 3], ids=["hash", "colliding"])
def test_exact_dedup(spark, identify):
    rows = corpus(1)
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4), pattern=chunk_pattern(4, 16), identify=identify).collect()
    groups = {}
    for d, t, _, _ in rows:
        groups.setdefault(t or "", []).append(d)
    want = sorted((d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _, _ in rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = [r for r in corpus(seed) if r[0] != 1003] + [(1003, "x\n\n\n\n\n\ny\n\n\n\n", None, 0)]
    seen, want = {}, {}
    for d, t, _, _ in sorted(rows, key=lambda r: r[0]):
        lines, gone = (t or "").split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" \t\r\v\f") for x in w) and seen.setdefault(w, (d, p)) != (d, p):
                gone |= {p, p + 1, p + 2}
        want[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    got = line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == want
    assert sum(x[2] for x in want.values()) > 10
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_line_dedup_of_repeated_doc_ids_and_many_runs(spark):
    """Different texts of one doc_id lose their own lines only; a text with many separate runs takes time in proportion."""
    shared = "one\ntwo\nthree"
    rows = [(1, shared, None, 0), (5, f"own a\n{shared}\nown b", None, 0), (5, "quite\nanother\ntext\nhere", None, 0), (5, f"own a\n{shared}\nown b", None, 0)]
    long = "\n".join(f"{shared}\nline {i}" for i in range(5000))
    got = line_dedup(spark.createDataFrame(rows + [(9, long, None, 0)], SCHEMA).repartition(3)).collect()
    texts = sorted((r.doc_id, r.text, r.n_removed) for r in got)
    assert texts[:4] == [(1, shared, 0), (5, "own a\nown b", 3), (5, "own a\nown b", 3), (5, "quite\nanother\ntext\nhere", 0)]
    assert texts[4][2] == 15_000 and texts[4][1].startswith("line 0\nline 1\n")


def near_corpus(seed):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)]
    bases = [[rng.choice(vocab) for _ in range(n)] for n in (1, 2, 3, 12, 40, 90, 200, 200)]
    rows = []
    for i in rng.sample(range(10_000), 120):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1])] = [rng.choice(vocab)]
        rows.append((i, rng.choice([" ", "\n", "\x0b"]).join(x.upper() if rng.random() < 0.2 else x for x in w), None, 1))
    return rows + [(20_000, None, "a", 2), (20_001, "", "a", 2), (20_002, " \n", "a", 2), (20_003, "one", "a", 2), (20_004, "ONE", "a", 2), (20_005, "É", "a", 2), (20_006, "é", "a", 2)]


@pytest.mark.parametrize("width,num,tile", [(3, 90, 10_000_000), (5, 80, 300), (3, 60, 2000)])
def test_ngram_join(spark, width, num, tile):
    rows = near_corpus(width)
    sets = {}
    for d, t, _, _ in rows:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\x0b", " ").split(" ") for x in x.split("\n") if x]
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = ngram_join(spark.createDataFrame(rows, SCHEMA).repartition(5), width, num, 100, tile=tile).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), find(d)) for d, s in sets.items()}
    assert len({find(d) for d in sets}) < len(sets) - 20
    if tile == 300:
        assert ngram_join(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("one_task", [0, 1 << 20], ids=["rounds", "one task"])
def test_components(spark, one_task):
    """Chains, stars, loops and repeats against a walk."""
    from fathomlake.llm.components import connected_components

    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(400, 480)] + [(7, 7), (7, 8), (8, 7), (8, 7)] + [(rng.randint(-50, 90), rng.randint(-50, 90)) for _ in range(60)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def least(x):
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return min(seen)

    got = connected_components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(4), one_task=one_task).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, least(x)) for x in near if least(x) != x)
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint"), one_task=one_task).collect() == []


def test_linked_sets_share_a_key_and_pass_the_tree():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (8, 15, 60, 400):
        for num in (80, 90):
            bands = Bands(num, 100)
            for _ in range(60):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                drop = rng.integers(0, int(len(a) * (100 - num) / 100) + 1)
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, 1).astype(np.uint64)]) if rng.random() < 0.3 else a[drop:])
                both = len(np.intersect1d(a, b))
                if 100 * both >= num * (len(a) + len(b) - both) and len(a) != both:
                    assert len(np.intersect1d(keys_of(a, bands), keys_of(b, bands)))
    sets = [np.unique(rng.integers(0, 300, rng.integers(20, 60)).astype(np.uint64)) for _ in range(3000)]
    tree = CountTree(group_counts(sets), 60, 100)
    for i in range(0, 3000, 300):
        near = set(tree.near(i).tolist())
        for j, s in enumerate(sets):
            both = len(np.intersect1d(sets[i], s))
            if 100 * both >= 60 * (len(sets[i]) + len(s) - both):
                assert j in near
