"""Tokenizing Arrow columns: each distinct head of a piece between spaces is encoded once, and remembered.

The tokenizer drops white space and no rule of it looks across a space, so a text's ids are those of its
pieces, one after another. Letters in front of a run of punctuation are no less apart: such a piece is a head and a
tail. Arrow numbers the pieces of a slice of texts, looks heads and tails up among those it knows, and numpy puts
their ids together; Python walks over words that are new alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
#: Heads and tails that a worker remembers; beyond it those stay that were met again, or none if they are too many.
REMEMBERED = 700_000
#: A control character that is one token of its own; it marks the ends of pieces.
MARK = "\x01"
#: Punctuation of ASCII: a run of it is split from the letters before it.
POINTS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of ASCII and Latin letters that have one lower case and no composition of their own, and perhaps a tail.
PLAIN = r"\A[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+[!-/:-@\[-`{-~]*\z"


def _byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it can be seen, else one from 256 on."""
    seen = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    hidden = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(hidden) if b != 32}


BYTE_LETTERS = _byte_letters()
#: Code points of the letters by byte.
LETTERS = np.array([BYTE_LETTERS.get(b, b) for b in range(256)], "<u4")
#: Bytes of text that are split at once; a longer text is split alone.
SLICE_BYTES = 8 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def whole(texts: pa.Array) -> pa.Array:
    """A copy as large strings from offset 0, null as empty: Arrow's string kernels misread some slices."""
    return pc.take(pc.fill_null(texts, "").cast(pa.large_string()), pa.array(np.arange(len(texts))))


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts of about ``size`` bytes together, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, to
        at = to


def _spread(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for sizes[0] places, then start[1], ..."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat((start - (ends - sizes)).astype(np.int32), sizes) + np.arange(total, dtype=np.int32)


def _cut(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes between neighbouring bounds as strings."""
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64, copy=False)), pa.py_buffer(data))


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and bounds of large strings."""
    _, bounds, data = strings.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(bounds, np.int64)[strings.offset : strings.offset + len(strings) + 1]


def _mask(flags: pa.Array) -> np.ndarray:
    return flags.to_numpy(zero_copy_only=False)


class PieceTokenizer:
    """Whole texts to ids (uint32) by way of remembered pieces."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # A second front for plain words: white space only, since they are lower-cased and mapped to byte letters here.
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        (self.mark,) = self.tok.encode(MARK, add_special_tokens=False).ids
        self.remembered = remembered
        self._clear()

    def _clear(self) -> None:
        """Of what is known: strings, their ids one after another, how many each has, and whether a second slice had it. The empty tail comes first."""
        self.known = pa.array([""], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.length = np.zeros(1, np.int32)
        self.again = np.ones(1, bool)

    def _shrink(self) -> None:
        keep = self.again
        if 2 * keep.sum() > self.remembered:
            return self._clear()
        self.known, self.ids, self.length = self.known.filter(pa.array(keep)), self.ids[np.repeat(keep, self.length)], self.length[keep]
        self.again = np.arange(len(self.length)) == 0

    def _odd(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has: pieces are encoded in long lines, with a mark between them."""
        if any(MARK in x for x in fresh):
            found = [np.asarray(e.ids, np.uint32) for e in self.tok.encode_batch_fast(fresh, add_special_tokens=False)]
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        line = np.asarray(self.tok.encode_batch_fast([f" {MARK} ".join(fresh) + f" {MARK}"], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(line == self.mark)
        return line[line != self.mark], np.diff(ends, prepend=-1) - 1

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain small letters: each ends with the first id that ends a word."""
        line = LETTERS[np.frombuffer(" ".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.asarray(self.plain.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _learn(self, words: pa.Array, odd: pa.Array) -> None:
        ids, sizes = [self.ids], [self.length]
        for fresh, encode, step in (words, self._plain, 2_000), (odd, self._odd, 1_000):
            for at in range(0, len(fresh), step):
                found, n = encode(fresh.slice(at, step).to_pylist())
                ids.append(found)
                sizes.append(n.astype(np.int32))
        self.known, self.ids, self.length = pa.concat_arrays([self.known, words, odd]), np.concatenate(ids), np.concatenate(sizes)
        self.again = np.append(self.again, np.zeros(len(words) + len(odd), bool))

    def _numbers(self, parts: pa.Array, plain: np.ndarray) -> np.ndarray:
        """Number of each part among those known; new ones are learned, plain words by the short way."""
        found = pc.index_in(parts, value_set=self.known)
        new = _mask(pc.is_null(found))
        which = pc.fill_null(found, 0).to_numpy().copy()
        self.again[which[~new]] = True
        if new.any():
            first = len(self.known)
            words, odd = (pc.unique(parts.filter(pa.array(new & x))) for x in (plain, ~plain))
            self._learn(words, odd)
            which[new] = first + pc.index_in(parts.filter(pa.array(new)), value_set=pa.concat_arrays([words, odd])).to_numpy()
        return which

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text. Null is empty."""
        texts = whole(texts)
        parts = [self._encode(whole(texts.slice(a, b - a))) for a, b in slices(texts)]
        return np.concatenate([np.zeros(0, np.uint32), *[x for x, _ in parts]]), np.concatenate([np.zeros(0, np.int64), *[n for _, n in parts]])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, bounds = _bytes(texts)
        data = np.where(data == ord("\n"), np.uint8(ord(" ")), data)[: bounds[-1]]
        ends = np.zeros(len(data) + 1, bool)  # a piece ends behind its space, and at a text's end
        ends[1:] = data == ord(" ")
        ends[bounds] = ends[0] = True
        ends = np.flatnonzero(ends)
        pieces = _cut(data, ends).dictionary_encode()
        ids, sizes = self._table(pc.ascii_rtrim(pieces.dictionary, " "))
        which = pieces.indices.to_numpy()
        counts = sizes[which]
        flat = ids[_spread((np.cumsum(sizes) - sizes)[which], counts)]
        upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[np.searchsorted(ends, bounds)]
        return flat, np.diff(upto)

    def _table(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has."""
        if len(self.known) > self.remembered:
            self._shrink()
        plain = _mask(pc.match_substring_regex(names, PLAIN))
        low = pc.if_else(pa.array(plain), pc.utf8_lower(names), names)  # plain letters keep their bytes' number
        data, bounds = _bytes(low)
        size = np.diff(bounds)
        head = np.where(plain, np.diff(_bytes(pc.ascii_rtrim(low, POINTS))[1]), size)
        both = np.empty(2 * len(size) + 1, np.int64)
        both[0::2], both[1::2] = bounds, bounds[:-1] + head
        which = self._numbers(_cut(data, both), np.repeat(plain, 2) & (np.arange(2 * len(size)) % 2 == 0))
        start, sizes = np.cumsum(self.length) - self.length, self.length[which]
        return self.ids[_spread(start[which], sizes)], sizes[0::2] + sizes[1::2]


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def piece_tokenizer(path: str) -> PieceTokenizer:
    """The tokenizer of this worker process; what it remembers serves the worker's later tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


def forget() -> None:
    """Drop the tokenizers of this worker process, for steps after the last that tokenizes."""
    _TOKENIZERS.clear()
