"""Connected components by alternating stars, as DataFrames.

A large star ties the larger neighbours of a node to the least node it knows, a small star the smaller ones;
edges never grow in number and components come out as stars around their least node after few rounds. At first each
task replaces the edges of a batch by stars of their own components. The least neighbours are stored before they are
joined: both sides of the join are then exchanged, and adaptive execution can split a star's centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, stored, tidy

EDGES = "u bigint, v bigint"
#: Up to so many edges (16 bytes each) are joined in one task of an executor; more of them go through star rounds, with the same result.
ONE_TASK = 2_000_000


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the least of its component, and that least node."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    least = np.arange(len(names))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, least[a], low)  # the old least nodes move too: whole trees are hooked at once
        np.minimum.at(new, least[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == least).all():
            break
        least = new
    far = np.flatnonzero(least != np.arange(len(names)))
    return names[far], names[least[far]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in local_stars(b.column(0).to_numpy(), b.column(1).to_numpy())], names=["u", "v"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        u, v = local_stars(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def star_ties(keyed: DataFrame) -> DataFrame:
    """u, v: nodes tied to the least node that has one of their keys. ``keyed`` has key and node (bigint, not null).

    Keys are sorted inside tasks, which tie the nodes of a key in a batch and send the least of them on.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            head = np.append(True, k[1:] != k[:-1])
            least = n[head][np.cumsum(head) - 1]
            far = least != n
            u, v = np.concatenate([n[far], n[head]]), np.concatenate([least[far], np.zeros(int(head.sum()), np.int64)])
            ties = np.arange(len(u)) < int(far.sum())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=~ties), pa.array(np.concatenate([np.zeros(int(far.sum()), np.int64), k[head]]), mask=ties)], names=["u", "v", "key"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least = None, 0
        for b in batches:
            k, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            head = np.append(k[0] != now, k[1:] != k[:-1])
            run = np.cumsum(head)
            to = np.concatenate([[least], n[head]])[run]
            now, least = k[-1], to[-1]
            yield pa.RecordBatch.from_arrays([pa.array(n[to != n]), pa.array(to[to != n])], names=["u", "v"])

    dealt = stored(keyed.select("key", "node").sortWithinPartitions("key", "node").mapInArrow(tidy(first), f"{EDGES}, key bigint"), "meets")
    heads = dealt.filter("key is not null").select("key", "u").repartition("key").sortWithinPartitions("key", "u")
    return dealt.filter("key is null").select("u", "v").union(heads.mapInArrow(tidy(second), EDGES))


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(stored(least, "least").hint("merge"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = _with_least(down, least)
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, component (least node that can be reached) for every node of ``edges`` (u, v: bigint, not null) with a smaller one."""
    now = stored(edges.select("u", "v").filter("u != v").mapInArrow(tidy(_contracted), EDGES).distinct(), "edges")
    state = _state(now)
    if state[0] <= one_task:
        return stored(now.coalesce(1).mapInArrow(tidy(_joined), EDGES), "edges").toDF("node", "component")
    while True:
        large = stored(_large_star(now), "edges")
        new = stored(_small_star(large), "edges")
        last, state = state, _state(new)
        discard(large)
        discard(now)
        now = new
        if state == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
