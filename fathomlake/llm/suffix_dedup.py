"""Substring deduplication over bytes with suffix arrays.

A byte goes when a WIDTH-byte string that covers it also starts in a document with a smaller doc_id.

1. Anchors. Every WIDTH-byte string holds at least one winnowed GRAM-byte anchor (the least hash of its grams), the
   same wherever the string stands. An anchor's context is all bytes of the WIDTH-byte strings that hold it.
2. Equal contexts need no suffix array: all their bytes go in all documents but the first. This is settled
   inside each task first, so a passage that fills a third of the corpus sends one row for each task.
3. Where an anchor has several contexts, one document for each context sends its bytes. They are sharded by anchor.
   A WIDTH-byte string that holds the anchor goes on for HALF bytes before it or behind it, so a context whose bytes
   there no other document's context shares is done. The others of a shard get a suffix array by Larsson-Sadakane
   refinement and common prefixes by Kasai's walk. Shards end where an anchor's contexts end, as no string has to be
   sought beyond its anchor; only an anchor with more contexts than a shard holds has several suffix arrays, merged
   by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, release, stored, text_of, tidy

U = np.uint64
WIDTH, GRAM = 50, 20
BEFORE = WIDTH - GRAM
HALF = BEFORE // 2
BUCKETS = 1024
#: Bytes of text hashed at once; a longer document is hashed alone.
CHUNK_BYTES = 2 << 20
#: Anchors that a task settles among themselves before it sends them on.
ANCHORS_HELD = 2_000_000
#: Bytes of contexts in one suffix array.
SHARD_BYTES = 1 << 20
#: Bytes of contexts that are looked through at once for those that share a half.
LOOK_BYTES = 4 << 20
FACTORS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * FACTORS[4]
    x = (x ^ (x >> U(32))) * FACTORS[5]
    return x ^ (x >> U(31))


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (maximum) of each ``width`` values from a place on; shorter by width - 1."""
    pick, size = (np.minimum if least else np.maximum), 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, place in it, anchor hash and context hash of every anchor; ``bounds`` parts ``data`` into documents."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none.astype(U), none.astype(U)
    h = _mix(data.astype(U) + U(1))
    by = {1: h}
    for k, size in enumerate((1, 2, 4, 8)):
        h = by[size]
        by[2 * size] = h[:-size] * FACTORS[k] + h[size:]
    grams = n - GRAM + 1
    hashes = _mix(by[16][:grams] * FACTORS[4] + by[4][16 : 16 + grams]) | U(1)
    sizes = np.diff(bounds)
    left = np.repeat(bounds[1:], sizes) - np.arange(n)  # bytes from a place to the end of its document
    hashes[left[:grams] < GRAM] = ~U(0)
    least = _slide(hashes, BEFORE + 1, True)
    least[left[: len(least)] < WIDTH] = U(0)
    widened = np.concatenate([np.zeros(BEFORE, U), least, np.zeros(BEFORE, U)])
    at = np.flatnonzero(_slide(widened, BEFORE + 1, False)[:grams] == hashes)
    doc = np.searchsorted(bounds, at, "right") - 1
    place = at - bounds[doc]
    context = np.zeros(len(at), U)
    inner = (place >= BEFORE) & (left[at] >= WIDTH)
    p16, mid = by[16], at[inner] - BEFORE
    for k in range(0, BEFORE + WIDTH, 16):
        context[inner] = _mix(context[inner] * FACTORS[0] + p16[mid + k])
    for i in np.flatnonzero(~inner).tolist():
        a, b = at[i] - min(BEFORE, place[i]), at[i] + min(WIDTH, left[at[i]])
        context[i] = xxhash.xxh64_intdigest(data[a:b].tobytes(), seed=int(min(BEFORE, place[i])) + 1)
    return doc, place, hashes[at], context


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes or more, and each suffix's rank (what ends is less than what goes on).

    Groups of suffixes with equal first h bytes are refined by the ranks of the suffixes h further on; groups of one are left alone.
    """
    n = len(data)
    padded = np.concatenate([data.astype(U) + U(1), np.zeros(7, U)])
    key = np.zeros(n, U)
    for k in range(7):
        key = (key << U(9)) | padded[k : k + n]
    order = np.argsort(key)
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 7
    while h < depth:
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        places = order[slots]
        ahead = np.where(places + h < n, rank[np.minimum(places + h, n - 1)], -1)
        both = rank[places] * (n + 1) + ahead + 1
        by = np.argsort(both)
        order[slots] = places[by]
        both = both[by]
        new[slots] = np.append(True, both[1:] != both[:-1])
        rank[order[slots]] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, lanes: np.ndarray, most: int) -> np.ndarray:
    """Kasai's walk: common prefix (``most`` at most) of each sorted suffix with the one before it.

    Each lane of the text (``lanes`` has their bounds) walks on its own; numpy steps all lanes at once. The next
    suffix of the text shares all but one of the bytes that the last one shared.
    """
    n = len(data)
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    padded = np.concatenate([data, np.zeros(most, np.uint8)]).astype(np.int16)
    padded[n:] = -1
    out = np.zeros(n, np.int64)
    start, sizes = lanes[:-1], np.diff(lanes)
    by_size = np.argsort(-sizes, kind="stable")
    start, sizes = start[by_size], sizes[by_size]
    h = np.zeros(len(start), np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, "left"))
        i = start[:live] + t
        slot = place_of[i]
        j = order[np.maximum(slot - 1, 0)]
        k = np.maximum(h[:live] - 1, 0)
        go = np.flatnonzero(slot > 0)
        k[slot == 0] = 0
        while len(go):
            go = go[k[go] < most]
            go = go[padded[i[go] + k[go]] == padded[np.minimum(j[go] + k[go], n + most - 1)]]
            k[go] += 1
        h[:live] = k
        out[slot] = k
    return out


def repeated_starts(contexts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct WIDTH-byte strings of the contexts with the least document of each; and for every start of a
    string: its context, its place there, and the number of its string."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data, lanes = np.frombuffer(b"".join(contexts), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    order, _ = suffix_array(data, len(data))  # wholly sorted, as Kasai's walk supposes
    prefix = common_prefixes(data, order, lanes, WIDTH)
    group = np.cumsum(prefix < WIDTH) - 1
    lane = np.searchsorted(lanes, order, "right") - 1
    whole = lanes[lane + 1] - order >= WIDTH
    group, lane, at = group[whole], lane[whole], order[whole]
    names, number = np.unique(group, return_inverse=True)
    first = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(first, number, docs[lane])
    head = np.zeros(len(names), np.int64)
    head[number[::-1]] = at[::-1]
    strings = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[head] if len(names) else np.zeros((0, WIDTH), np.uint8)
    return np.ascontiguousarray(strings).view(f"V{WIDTH}").ravel(), first, np.stack([lane, at - lanes[lane]], 1), number


def _sortable(strings: np.ndarray) -> np.ndarray:
    """Strings as rows of numbers that sort and compare as the bytes do."""
    raw = strings.view(np.uint8).reshape(-1, WIDTH)
    return np.concatenate([raw, np.zeros((len(raw), 56 - WIDTH), np.uint8)], 1).view(">u8").astype(U)


def find_strings(sorted_rows: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Place of each of ``rows`` in ``sorted_rows``, or -1: binary search for all rows at once."""
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(sorted_rows), np.int64)
    while len(rows) and (open_ := low < high).any():
        mid = (low + high) // 2
        theirs = sorted_rows[np.minimum(mid, len(sorted_rows) - 1)]
        differs = theirs != rows
        col = differs.argmax(1)
        pick = np.arange(len(rows))
        less = differs.any(1) & (theirs[pick, col] < rows[pick, col])
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    at = np.minimum(low, max(0, len(sorted_rows) - 1))
    return np.where((sorted_rows[at] == rows).all(1), at, -1) if len(sorted_rows) else np.full(len(rows), -1)


def removable(contexts: list[bytes], docs: np.ndarray, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int]]:
    """(context, place) of every WIDTH-byte string that also starts in a smaller document's context."""
    shards, at, size = [], 0, 0
    for i, c in enumerate(contexts):
        size += len(c)
        if size >= shard_bytes or i == len(contexts) - 1:
            shards.append((at, *repeated_starts(contexts[at : i + 1], docs[at : i + 1])))
            at, size = i + 1, 0
    rows = [_sortable(s[1]) for s in shards] if len(shards) > 1 else []
    out = []
    for k, (base, _, first, starts, number) in enumerate(shards):
        least = first.copy()
        for m in range(len(rows)):
            if m != k:
                found = find_strings(rows[m], rows[k])
                hit = found >= 0
                least[hit] = np.minimum(least[hit], shards[m][2][found[hit]])
        gone = least[number] < docs[base + starts[:, 0]]
        out += [(base + a, b) for a, b in starts[gone].tolist()]
    return out


def removable_by_anchor(contexts: list[bytes], docs: np.ndarray, anchors: np.ndarray, shard_bytes: int = SHARD_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``removable`` (contexts, places) for neighbouring whole anchors at a time, ``shard_bytes`` or a little more; contexts are sorted by anchor."""
    if not contexts:
        return
    ends = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(contexts))
    upto = np.cumsum(np.fromiter(map(len, contexts), np.int64, len(contexts)))[ends - 1]
    a = size = 0
    while a < len(contexts):
        k = min(int(np.searchsorted(upto, size + shard_bytes)), len(ends) - 1)
        b, size = int(ends[k]), int(upto[k])
        found = np.array(removable(contexts[a:b], docs[a:b], shard_bytes), np.int64).reshape(-1, 2)
        yield found[:, 0] + a, found[:, 1]
        a = b


def share_half(contexts: list[bytes], leads: np.ndarray, anchors: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """True where another document's context has the same anchor and the same HALF bytes before it, or behind it.

    ``leads`` are the bytes before the anchor, ``anchors`` any name of it.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"".join(contexts) + bytes(64), np.uint8)
    at = np.cumsum(sizes) - sizes + leads
    keep = np.zeros(len(contexts), bool)
    width = -(-(GRAM + HALF) // 8) * 8
    for side, (start, fits) in enumerate(((at - HALF, leads >= HALF), (at, sizes - leads >= GRAM + HALF))):
        which = np.flatnonzero(fits)
        rows = np.zeros((len(which), width), np.uint8)
        rows[:, : GRAM + HALF] = data[start[which, None] + np.arange(GRAM + HALF)]
        name = _mix(anchors[which].astype(np.int64).view(U) + FACTORS[side])
        for word in rows.view(U).T:
            name = _mix(name * FACTORS[2] + word)
        order = np.argsort(name, kind="stable")
        name, doc = name[order], docs[which][order]
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))[: len(name)]
        if len(first):
            several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
            keep[which[order]] |= np.repeat(several, np.diff(np.append(first, len(name))))
    return keep


def _rows(names: list[str], types: list, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, bytes and bounds of a few documents at a time."""
    ids, texts, size, held = [], [], 0, batch.column(1)
    for i, doc in enumerate(batch.column(0).to_pylist()):
        raw = held[i].as_py()
        if doc is None or len(raw) < WIDTH:
            continue
        ids.append(doc)
        texts.append(raw)
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield ids, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            ids, texts, size = [], [], 0
    if ids:
        yield ids, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _per_doc(docs: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order].astype("<i4")
    cut = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(docs)).tolist()):
        yield int(docs[a]), places[a:b].tobytes()


MARKS = "doc_id bigint, same binary, open binary"


def anchor_marks(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, same, open (places, int32): anchors whose context a smaller document has, and anchors whose context must be compared."""
    names, types = ["bucket", "anchor", "context", "doc", "place"], [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            parts = [list(x) for x in zip(*held)]
            held.clear()
            for k in range(4):  # one column at a time, so that no two copies of all are held
                parts[k] = np.concatenate(parts[k])
            order = np.lexsort((parts[1], parts[0], parts[3], parts[2]))
            for k in range(4):
                parts[k] = parts[k][order]
            doc, place, anchor, context = parts
            del parts, order
            first = np.append(True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]))
            mine = doc == doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]
            late = (doc[~mine], place[~mine])
            doc, place, anchor, context = doc[mine], place[mine], anchor[mine], context[mine]
            bucket = ((anchor >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            rows = []
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(doc)).tolist()):
                o = a + np.lexsort((place[a:b], doc[a:b]))  # sorted by document, which packs well
                rows.append((int(bucket[a]), anchor[o].tobytes(), context[o].tobytes(), doc[o].tobytes(), place[o].astype("<i4").tobytes()))
            if len(late[0]):
                rows += [(-1, b"", b"", np.int64(d).tobytes(), p) for d, p in _per_doc(*late)]
            yield _rows(names, types, zip(*rows))

        for batch in batches:
            for ids, data, bounds in _chunks(batch):
                doc, place, anchor, context = anchors_of(data, bounds)
                held.append((np.asarray(ids, np.int64)[doc], place.astype(np.int32), anchor, context))
                count += len(doc)
                if count >= ANCHORS_HELD:
                    yield from out()
                    count = 0
        if count:
            yield from out()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def out() -> Iterator[pa.RecordBatch]:
            anchor, context, doc, place = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((place, doc, context, anchor))
            anchor, context, doc, place = anchor[order], context[order], doc[order], place[order]
            new_anchor = np.append(True, anchor[1:] != anchor[:-1])
            new = new_anchor | np.append(True, context[1:] != context[:-1])
            group, family = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
            least = doc[new]  # of each context
            mine = doc == least[group]
            heads = family[new]
            small = np.full(heads[-1] + 1, np.iinfo(np.int64).max)
            large = np.full(heads[-1] + 1, np.iinfo(np.int64).min)
            np.minimum.at(small, heads, least)
            np.maximum.at(large, heads, least)
            compare = mine & (small < large)[family]
            rows = [(d, p, None) for d, p in _per_doc(doc[~mine], place[~mine])] + [(d, None, p) for d, p in _per_doc(doc[compare], place[compare])]
            if rows:
                yield _rows(["doc_id", "same", "open"], [pa.int64(), pa.binary(), pa.binary()], zip(*rows))

        for batch in batches:
            late = []
            for bucket, a, c, d, p in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if bucket < 0:
                    late.append((int(np.frombuffer(d, np.int64)[0]), p, None))
                    continue
                if parts and bucket != now:
                    yield from out()
                    parts = []
                now = bucket
                parts.append((np.frombuffer(a, U), np.frombuffer(c, U), np.frombuffer(d, np.int64), np.frombuffer(p, "<i4")))
            if late:
                yield _rows(["doc_id", "same", "open"], [pa.int64(), pa.binary(), pa.binary()], zip(*late))
        if parts:
            yield from out()

    sent = texts.mapInArrow(tidy(send), "bucket int, anchor binary, context binary, doc binary, place binary")
    dealt = sent.repartition(F.col("bucket"), F.when(F.col("bucket") < 0, F.xxhash64("doc")).otherwise(0)).sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(settle), MARKS)


def suffix_dedup(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES, look_bytes: int = LOOK_BYTES, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left; null without ``with_text``).

    Null text is empty; texts under WIDTH bytes lose nothing. Rows that repeat a doc_id don't count against each other, and
    must have one text (their marks are by doc_id); a null doc_id neither gives nor loses bytes. No rows give none; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs, text_col).cast("binary").alias("text"))
    marks = stored(anchor_marks(texts), "marks")
    release(docs.sparkSession)  # the anchors' shuffle files
    open_ = marks.filter("open is not null").groupBy("doc_id").agg(F.collect_list("open").alias("open"))
    same = marks.filter("same is not null").select("doc_id", F.lit("same").alias("kind"), F.col("same").alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for doc, text, open_ in zip(*(batch.column(i).slice(at, 200).to_pylist() for i in range(3))):
                    for p in np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in open_])).tolist():
                        a = max(0, p - BEFORE)
                        rows.append((xxhash.xxh64_intdigest(text[p : p + GRAM]) - (1 << 63), doc, a, p - a, text[a : p + WIDTH]))
                if rows:
                    yield _rows(["anchor", "doc_id", "at", "lead", "bytes"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], zip(*rows))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts come sorted by anchor; those of an anchor stay together."""
        held, size, last = [], 0, None

        def out() -> Iterator[pa.RecordBatch]:
            anchors, docs, at, leads = (np.array([x[k] for x in held], np.int64) for k in range(4))
            kept = np.flatnonzero(share_half([x[4] for x in held], leads, anchors, docs))
            if not len(kept):
                return
            docs, at = docs[kept], at[kept]
            found = list(removable_by_anchor([held[i][4] for i in kept.tolist()], docs, anchors[kept], shard_bytes))
            which, place = (np.concatenate(x) for x in zip(*found))
            if len(which):
                rows = [(d, "starts", p) for d, p in _per_doc(docs[which], at[which] + place)]
                yield _rows(["doc_id", "kind", "places"], [pa.int64(), pa.string(), pa.binary()], zip(*rows))

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= look_bytes and row[0] != last:
                    yield from out()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield from out()

    contexts = texts.hint("merge").join(open_, "doc_id").mapInArrow(tidy(cut), "anchor bigint, doc_id bigint, at int, lead int, bytes binary")
    starts = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(compare), "doc_id bigint, kind string, places binary")
    found = same.union(starts).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "places")).alias("found"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for doc, text, found in zip(*(batch.column(i).slice(at, 500).to_pylist() for i in range(3))):
                    n, removed, spans, kept = len(text), 0, 0, text
                    if found and n >= WIDTH:
                        same, starts = (np.frombuffer(b"".join(x["places"] for x in found if x["kind"] == k), "<i4").astype(np.int64) for k in ("same", "starts"))
                        a, b = np.concatenate([np.maximum(same - BEFORE, 0), starts]), np.minimum(np.concatenate([same, starts]) + WIDTH, n)
                        gone = np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1))[:n] > 0
                        removed, spans = int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())
                        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    rows.append((doc, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                yield _rows(names, types, zip(*rows))

    joined = texts.hint("merge").join(found, "doc_id", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(tidy(digest), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), with_text=False).drop("kept")
