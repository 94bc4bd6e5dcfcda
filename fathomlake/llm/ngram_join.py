"""N-gram Jaccard join: sets of word shingles, linked from a similarity on; nothing is lost.

1. A text becomes its set of shingles (64-bit hashes). Equal sets are one node from here on.
2. Shingles are hashed into groups, and a set is the point of its group counts: the summed minima of two points'
   coordinates bound the overlap of the sets.
3. Candidates meet exactly: the hash range is cut into more segments than two linked sets can differ in, so the
   contents of ``spare`` + 1 segments or more are the same in both; each content is a key. Keys are ordered by how many
   nodes have them (exact counts), and a node leaves out its ``spare`` most frequent ones: of the common keys of two linked
   nodes the last in that order stays in both. So a passage that thousands of texts share ties none of them. Pairs that
   meet in a key of few nodes must pass the bound on their points; nodes that keep a frequent key are tied to the
   least of them, at first inside a task. Components of these ties hold every link.
4. In a candidate component, an R-tree over the points bounds the overlap of a set with all sets of a tree node;
   pairs that pass the bound are verified on the sets, unless links found so far join them already.
   A large component is cut into tiles, and each pair of tiles is one task.
5. Verified links give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, release, stored, text_of, tidy
from .components import connected_components, star_ties
from .tokens import whole

U = np.uint64
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Growth from one band of set sizes to the next.
BAND_GROWTH = 1.25
#: Coordinates of a count vector in the tree, and points in a leaf of the tree.
GROUPS, LEAF = 128, 32
#: Coordinates of a count vector that meets others by a key: those of the last size that a set reaches.
POINT_GROUPS = ((0, 128), (1024, 512), (8192, 2048))
#: Shingles, and nodes, in a tile of a candidate component.
TILE_SHINGLES, TILE_NODES = 2_000_000, 20_000
#: Keys that a task holds before it hands them on.
KEYS_HELD = 4_000_000
KEY_BUCKETS = 1024
#: A key of so many nodes is frequent; one of so many in what a task holds is hot: its nodes aren't sent to be counted.
FREQUENT, HOT = 4, 256
#: Bands that a key can tell apart by its low bits.
SLOTS = 16
HOT_COUNT = 1 << 40


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * M2
    x = (x ^ (x >> U(27))) * M3
    return x ^ (x >> U(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer words than ``width`` are one shingle, none are none."""
    low = pc.ascii_lower(whole(texts))
    for c in "\t\n\v\f\r":
        low = pc.replace_substring(low, c, " ")
    lists = pc.split_pattern(low, " ")
    words = lists.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), U, len(names))
    index = words.indices.to_numpy()
    real = np.fromiter((w != "" for w in names), bool, len(names))[index] if len(names) else np.zeros(0, bool)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(real)])[offsets - (offsets[0] if len(offsets) else 0)]
    h = mix(known[index[real]]) if len(names) else np.zeros(0, U)
    full = np.zeros(0, U)
    if len(h) >= width:
        full = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            full = mix(full * M1 + h[k : len(h) - width + 1 + k])
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            s = h[a : a + 1].copy()
            for k in range(a + 1, b):
                s = mix(s * M1 + h[k : k + 1])
            out.append(mix(s + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def node_of(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Bands:
    """Bands of set sizes. Sets that can be linked and lie in neighbouring bands both give keys in the upper one."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def _reach(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * BAND_GROWTH)))
        return int(np.searchsorted(self.low, n, "right")) - 1

    def plan(self, n: int) -> list[tuple[int, int, int]]:
        """(band, segments, segments that may differ) for a set of n shingles; none where only equal sets can be linked."""
        b, out = self._reach(n), []
        most = n * self.den // self.num
        for k in range(b, self._reach(max(n, most)) + 1):
            t = 2 * (self.den - self.num) * (self.low[k + 1] - 1) // (self.den + self.num)
            if t:
                out.append((k, t + 1 + self.spare(t), self.spare(t)))
        return out

    @staticmethod
    def spare(t: int) -> int:
        return 1 + -(-t // 8)


def band_keys(s: np.ndarray, bands: Bands) -> list[tuple[int, np.ndarray, int]]:
    """(slot, keys, keys that may be left out) of a set for each of its bands; the low bits of a key are its slot.

    With ``spare`` segments more than needed, spare + 1 segments are equal in linked sets. In the order in which keys may be
    left out those of empty segments are the first: they are left out here, as many as may be.
    """
    out = []
    scrambled = np.concatenate([np.zeros(1, U), np.cumsum(mix(s ^ M1), dtype=U)])
    for band, segments, spare in bands.plan(len(s)):
        seg = ((s >> U(32)) * U(segments)) >> U(32)
        bounds = np.searchsorted(seg, np.arange(segments + 1, dtype=U))
        sums = scrambled[bounds[1:]] - scrambled[bounds[:-1]]
        sizes = np.diff(bounds).astype(U)
        keys = mix(sums + sizes * M2 + mix(np.arange(segments, dtype=U) + U(band << 32)))
        keys = (keys & ~U(SLOTS - 1)) | U(band % SLOTS)
        full = np.unique(keys[sizes > 0])
        empty = np.sort(keys[sizes == 0])
        out.append((band % SLOTS, np.concatenate([full, empty[spare:]]), max(0, spare - len(empty))))
    return out


def keys_of(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a set: linked sets have one in common, whatever each of them leaves out."""
    out = [keys for _, keys, _ in band_keys(s, bands)]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def point_of(s: np.ndarray) -> bytes:
    """Group counts of a set: a byte for the bytes of a number, then the numbers."""
    groups = next(g for n, g in reversed(POINT_GROUPS) if len(s) >= n)
    counts = np.bincount((mix(s) % U(groups)).astype(np.int64), minlength=groups)
    size = 1 if counts.max(initial=0) < 256 else 2 if counts.max() < 65536 else 4
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def read_point(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """At least the size of the intersection: summed minima; the finer point is folded to the coarser one's groups."""
    g = min(len(a), len(b))
    a, b = (x if len(x) == g else x.reshape(-1, g).sum(0) for x in (a, b))
    return int(np.minimum(a, b).sum(dtype=np.int64))


class CountTree:
    """R-tree over group counts, packed by size and then by coordinates; leaves and inner nodes keep coordinate maxima."""

    def __init__(self, points: np.ndarray, num: int, den: int):
        self.num, self.den, self.points, self.sizes = num, den, points, points.sum(1, dtype=np.int64)
        order = np.argsort(self.sizes, kind="stable")
        slab = LEAF * LEAF
        parts = [order[i : i + slab] for i in range(0, len(order), slab)]
        self.order = np.concatenate([p[np.lexsort(points[p][:, :3].T)] for p in parts])
        self.levels = []
        top, small, large = points[self.order], self.sizes[self.order], self.sizes[self.order]
        while len(top) > LEAF:
            at = np.arange(0, len(top), LEAF)
            top, small, large = np.maximum.reduceat(top, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)
            self.levels.append((top, small, large))

    def _pass(self, q: np.ndarray, n: int, top: np.ndarray, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        fits = (large * self.den >= n * self.num) & (small * self.num <= n * self.den)
        bound = np.minimum(top, q).sum(1, dtype=np.int64)
        return fits & (bound * (self.den + self.num) >= self.num * (n + np.maximum(small, -(-n * self.num // self.den))))

    def near(self, i: int) -> np.ndarray:
        """Points whose overlap with point i can reach the similarity, itself among them."""
        q, n, at = self.points[i], int(self.sizes[i]), None
        for top, small, large in reversed(self.levels):
            at = np.arange(len(top)) if at is None else at
            at = at[self._pass(q, n, top[at], small[at], large[at])]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            below = len(self.order) if top is self.levels[0][0] else len(self.levels[self._depth(top) - 1][0])
            at = at[at < below]
        found = self.order if at is None else self.order[at]
        return found[self._pass(q, n, self.points[found], self.sizes[found], self.sizes[found])]

    def _depth(self, top: np.ndarray) -> int:
        return next(k for k, x in enumerate(self.levels) if x[0] is top)


def group_counts(sets: list[np.ndarray]) -> np.ndarray:
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    counts = np.bincount(which * GROUPS + (mix(np.concatenate(sets)) % U(GROUPS)).astype(np.int64), minlength=len(sets) * GROUPS).reshape(-1, GROUPS)
    return counts.astype(np.int32)


def spanning_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Verified links (positions) that join what all links of the sets would join."""
    points = group_counts(sets)
    tree, root = CountTree(points, num, den), np.arange(len(sets))
    members = {}  # of each root that has more than itself
    mean = points.mean(0)
    links = []
    for i in np.argsort(np.abs(points - mean).sum(1), kind="stable").tolist():  # the most central first: it joins most
        others = tree.near(i)
        others = others[root[others] != root[i]]
        mine = sets[i]
        for at in range(0, len(others), 64):
            part = others[at : at + 64]
            part = part[root[part] != root[i]]
            if not len(part):
                continue
            sizes = np.array([len(sets[j]) for j in part])
            flat = np.concatenate([sets[j] for j in part])
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
            for j in part[both * den >= num * (sizes + len(mine) - both)].tolist():
                x, y = int(root[i]), int(root[j])
                if x != y:
                    links.append((i, j))
                    more, less = members.setdefault(x, [x]), members.setdefault(y, [y])
                    if len(more) < len(less):
                        x, y, more, less = y, x, less, more
                    root[less] = x  # each set changes its root a logarithm of times
                    more += less
                    del members[y]
    return links


def shingle_table(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n, node, point, first_slot, spares (keys that the node may leave out, by band); null without words."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = shingle_sets(b.column(1).slice(at, 500), width)
                plans = [[(k, keep) for k, _, keep in band_keys(s, bands)] for s in sets]
                columns = (
                    (pa.int64(), [len(s) for s in sets]),
                    (pa.int64(), [node_of(s) if len(s) else None for s in sets]),
                    (pa.binary(), [point_of(s) if p else None for s, p in zip(sets, plans)]),
                    (pa.int32(), [p[0][0] if p else None for p in plans]),
                    (pa.list_(pa.int32()), [[x for _, x in p] if p else None for p in plans]),
                )
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 500), *[pa.array(v, t) for t, v in columns]], names=["doc_id", "n", "node", "point", "first_slot", "spares"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(tidy(sizes), "doc_id bigint, n bigint, node bigint, point binary, first_slot int, spares array<int>")


def meetings(docs: DataFrame, width: int, num: int, den: int, buckets: int = KEY_BUCKETS, hot: int = HOT) -> DataFrame:
    """u, v, key, nodes: pairs of nodes that meet in a key of few nodes (key null), and nodes with a frequent key (v null) and its count.

    A key that is hot in some task counts as ``HOT_COUNT``: more than any that is counted.
    """
    buckets = max(buckets, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, keys, nodes, held, seen = Bands(num, den), [], [], 0, set()

        def out() -> pa.RecordBatch:
            k, n = np.concatenate(keys), np.concatenate(nodes)
            order = np.lexsort((n, k))
            k, n = k[order], n[order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            many = np.diff(np.append(first, len(k))) >= hot
            hot_keys, mine = k[first[many]], np.repeat(many, np.diff(np.append(first, len(k))))
            rows = [(-1, k[mine].tobytes(), n[mine].tobytes(), b"")] * bool(len(hot_keys))
            k, n = k[~mine], n[~mine]
            of = [((x >> U(32)) * U(buckets) >> U(32)).astype(np.int64) for x in (k, hot_keys)]
            at = [np.searchsorted(x, np.arange(buckets + 1)) for x in of]
            for b in np.flatnonzero((np.diff(at[0]) > 0) | (np.diff(at[1]) > 0)).tolist():
                rows.append((b, k[at[0][b] : at[0][b + 1]].tobytes(), n[at[0][b] : at[0][b + 1]].tobytes(), hot_keys[at[1][b] : at[1][b + 1]].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))], names=["bucket", "a", "b", "hot"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for s in shingle_sets(batch.column(0).slice(at, 500), width):
                    node = node_of(s)
                    own = keys_of(s, bands) if node not in seen else ()
                    if len(own):
                        seen.add(node)
                        keys.append(own)
                        nodes.append(np.full(len(own), node, np.int64))
                        held += len(own)
                if held >= KEYS_HELD:
                    yield out()
                    keys, nodes, held, seen = [], [], 0, set()
        if held:
            yield out()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come sorted, so the rows of one are neighbours."""
        now, rows = None, []

        def table(u: np.ndarray, v: np.ndarray | None, key: np.ndarray | None, nodes: np.ndarray | None) -> pa.RecordBatch:
            columns = [pa.nulls(len(u), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (u, v, key, nodes)]
            return pa.RecordBatch.from_arrays(columns, names=["u", "v", "key", "nodes"])

        def out() -> Iterator[pa.RecordBatch]:
            k, n = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            known = np.unique(np.concatenate([r[2] for r in rows]))
            order = np.lexsort((n, k))
            k, n = k[order], n[order]
            new = np.append(True, (k[1:] != k[:-1]) | (n[1:] != n[:-1]))[: len(k)]
            k, n = k[new], n[new]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
            size = np.diff(np.append(first, len(k)))
            is_hot = np.isin(k[first], known)
            count = np.repeat(np.where(is_hot, HOT_COUNT, size), size)
            few = [(n[:-d][m], n[d:][m]) for d in range(1, FREQUENT - 1) if len(k) > d for m in ((k[d:] == k[:-d]) & (count[d:] < FREQUENT),)]
            if few:
                yield table(*_distinct(np.concatenate([x for x, _ in few]), np.concatenate([y for _, y in few])), None, None)
            often = count >= FREQUENT
            if often.any():
                yield table(n[often], None, k[often].view(np.int64), count[often])

        for batch in batches:
            for bucket, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = (np.frombuffer(a, U), np.frombuffer(b, np.int64), np.frombuffer(c, U))
                if bucket < 0:
                    yield table(own[1], None, own[0].view(np.int64), np.full(len(own[0]), HOT_COUNT))
                    continue
                if rows and bucket != now:
                    yield from out()
                    rows = []
                now = bucket
                rows.append(own)
        if rows:
            yield from out()

    rows = docs.select(text_of(docs).alias("text")).mapInArrow(tidy(keyed), "bucket int, a binary, b binary, hot binary")
    # what is hot in a task (bucket -1) is dealt by its content
    dealt = rows.repartition(F.col("bucket"), F.when(F.col("bucket") < 0, F.xxhash64("a")).otherwise(0)).sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(counted), "u bigint, v bigint, key bigint, nodes bigint")


def candidate_ties(met: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: nodes that may be linked, or are tied to the least node of a frequent key that they keep. ``nodes`` has a row for each node."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, n, m, p, q = (b.column(i) for i in range(6))
            n, m = n.to_numpy(), m.to_numpy()
            fits = (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (u.to_numpy() != v.to_numpy())
            p, q = p.to_pylist(), q.to_pylist()
            for i in np.flatnonzero(fits).tolist():
                fits[i] = overlap_bound(read_point(p[i]), read_point(q[i])) * (den + num) >= num * (int(n[i]) + int(m[i]))
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(fits)) for x in (u, v)], names=["u", "v"])

    # nodes grow with the corpus: merge joins at every size
    at = lambda side: nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("point").alias(f"p_{side}")).hint("merge")
    pairs = met.filter("key is null").select("u", "v").distinct().join(at("u"), "u").join(at("v"), "v")
    pairs = pairs.select("u", "v", "n_u", "n_v", "p_u", "p_v").mapInArrow(tidy(bounded), "u bigint, v bigint")
    own = nodes.select(F.col("node").alias("u"), "first_slot", "spares").hint("merge")
    slot = F.pmod(F.col("key").bitwiseAND(F.lit(SLOTS - 1)) - F.col("first_slot"), F.lit(SLOTS)).cast("int")
    often = met.filter("key is not null").select("u", "key", "nodes").join(own, "u").select("u", "key", "nodes", slot.alias("slot"), F.get("spares", slot).alias("spare"))
    order = F.row_number().over(Window.partitionBy("u", "slot").orderBy(F.col("nodes").desc(), "key"))
    kept = often.withColumn("place", order).filter("place > spare").select("key", F.col("u").alias("node"))
    return pairs.union(star_ties(kept))


def _distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, v = u[u != v], v[u != v]
    if not len(u):
        return u, v
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    keep = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))
    return u[keep], v[keep]


def ngram_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, tile: int = TILE_SHINGLES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    Two rows are linked when den * intersection >= num * union of their shingle sets. ``component_id`` is the least
    doc_id that links reach, its own included. Null and empty texts have no shingles and no links. Rows that repeat a
    doc_id share a class if their texts do; a null doc_id never names a class of others (alone: null). No rows give none;
    other columns are ignored.
    """
    spark = docs.sparkSession
    table = stored(shingle_table(docs, width, num, den), "sets")
    met = stored(meetings(docs, width, num, den), "met")
    release(spark)  # the keys' shuffle files
    # rows of one node have one point and the same spares
    nodes = table.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), *[F.max(c).alias(c) for c in ("n", "point", "first_slot", "spares")])
    nodes = stored(nodes, "nodes")
    reps = nodes.select("node", "rep", "n")
    found = connected_components(candidate_ties(met, nodes, num, den))
    members = found.union(found.select("component", "component").distinct()).toDF("node", "part")
    members = stored(members.join(reps.filter("rep is not null").hint("merge"), "node"), "members")
    size = F.greatest(F.sum("n") / tile, F.count(F.lit(1)) / TILE_NODES)
    parts = members.groupBy("part").agg(F.ceil(size).cast("int").alias("tiles"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    placed = members.join(parts.hint("merge"), "part").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("rep", "node", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_of(docs).alias("text"))

    def verify(p: pd.DataFrame) -> pd.DataFrame:
        sets, names, seen = [], [], set()
        for at in range(0, len(p), 500):
            part = p.iloc[at : at + 500]
            for s, node, rep in zip(shingle_sets(pa.array(part["text"], pa.large_string()), width), part["node"], part["rep"]):
                if len(s) and node_of(s) == node and node not in seen:
                    seen.add(node)
                    sets.append(s)
                    names.append(rep)
        links = spanning_links(sets, num, den) if len(sets) > 1 else []
        return pd.DataFrame({"u": [names[a] for a, _ in links], "v": [names[b] for _, b in links]}, dtype="int64")

    # candidates grow with the corpus: a merge join at every size, never a broadcast
    links = texts.join(placed.hint("merge"), "rep").groupBy("part", "i", "j").applyInPandas(verify, "u bigint, v bigint")
    classes = connected_components(links)
    named = reps.join(classes, reps["rep"] == classes["node"], "left").select(reps["node"], F.coalesce("component", "rep").alias("component"))
    named = stored(named, "named")  # read back, so that both sides of the join below are exchanged and a hot node can be split
    out = table.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), width=3, num=90, den=100)
