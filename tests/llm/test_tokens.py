import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from fathomlake.llm.packing import hilbert_key, pack
from fathomlake.llm.rans import decode_segment, encode_segment, read_token_files, write_token_files
from fathomlake.llm.tokens import PieceTokenizer, piece_tokenizer, tokenizer_path

TEXTS = [None, "", " ", "Foo, foo. FOO ..", "ÀÉß. ÞÿŸ İstanbul ΣΑΣ", "It's I'LL 4٣", "<|endoftext|> x<|startoftext|>y", "á ́", "x\x01y \x01", "🙂‍🧠 \x00", "word " * 30_000, "Foo, foo. FOO ..", "tab\there\r\nthere \xa0end"]
SCHEMA = "doc_id bigint, text string, key string, ids string"


def expected(end):
    tok = piece_tokenizer(tokenizer_path()).tok
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in TEXTS]


def rows():
    return [(3 * i, t, "k", "i") for i, t in enumerate(TEXTS)]


def test_pieces_give_the_tokenizers_ids():
    ids, counts = piece_tokenizer(tokenizer_path()).encode(pa.array(TEXTS + TEXTS[:3]).slice(0, len(TEXTS)))
    want = [e[:-1] for e in expected(1)]
    assert counts.tolist() == [len(w) for w in want] and np.array_equal(ids, np.concatenate(want))


class Counting:
    """A tokenizer that counts the characters it is given."""

    def __init__(self, tok):
        self.tok, self.n = tok, 0

    def encode_batch_fast(self, lines, **kw):
        self.n += sum(map(len, lines))
        return self.tok.encode_batch_fast(lines, **kw)


def test_heads_and_tails_are_encoded_once():
    """Before, each of the 2,000 pieces that end with something else than one full stop or comma was encoded."""
    tok = PieceTokenizer(tokenizer_path())
    tails = ["", "***", "&&&", "%%%.", "_", "'", "''", "<|", '"),', "\\"]
    text = " ".join(f"{head}{tail}" for i in range(200) for head in [f"Ma{chr(97 + i % 26)}{chr(97 + i // 26)}ré"] for tail in tails)
    want = tok.tok.encode(text, add_special_tokens=False).ids
    tok.tok, tok.plain = Counting(tok.tok), Counting(tok.plain)
    ids, _ = tok.encode(pa.array([text]))
    assert ids.tolist() == want and tok.tok.n + tok.plain.n < len(text) / 5


def test_a_full_memory_keeps_what_was_met_again():
    small, whole = PieceTokenizer(tokenizer_path(), remembered=40), PieceTokenizer(tokenizer_path())
    name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    for i in range(30):
        texts = pa.array(["the Storm, <|endoftext|>x of " + " ".join(f"{name(k)}.. {k}" for k in range(8 * i, 8 * i + (200 if i == 20 else 8))), None, "THE storm"])
        (a, n), (b, m) = small.encode(texts), whole.encode(texts)
        want = [whole.tok.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
        assert a.tolist() == b.tolist() == sum(want, []) and n.tolist() == m.tolist() == [len(w) for w in want]
        assert i == 20 or len(small.known) < 80
    assert "storm" in small.known.to_pylist()


def test_odd_cuts_of_arrays():
    tok = PieceTokenizer(tokenizer_path())
    for texts in [pa.array([], pa.string()), pa.array([None, ""], pa.string()), pa.array(["\n \n", " a", "a ", "b\n"]), pa.array(["xx", "B a.", None, "a\nb"], pa.large_string()).slice(1)]:
        ids, n = tok.encode(texts)
        want = [tok.tok.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("n,high", [(1, 1), (31, 2), (1000, 5), (70_000, 49_000), (40_000, 1)])
def test_rans_round_trip(n, high):
    ids = (np.random.default_rng(n).random(n) ** 3 * high).astype(np.uint32)
    row = encode_segment(ids)
    assert np.array_equal(decode_segment(row), ids)
    blocks = len(row["block_crc32"]) // 4
    assert np.array_equal(decode_segment(row, [blocks - 1]), ids[(blocks - 1) * row["steps"] * 32 :])
    if high == 49_000:
        bad = bytearray(row["words"])
        bad[100] ^= 255
        with pytest.raises(ValueError, match="checksum"):
            decode_segment(row | {"words": bytes(bad)})


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame(rows()[::-1], SCHEMA).repartition(4)
    write_token_files(docs, str(tmp_path / "t"), segment_ids=50)
    got, start = sorted(read_token_files(spark, str(tmp_path / "t")).collect()), 0
    for r, (d, *_), want in zip(got, rows(), expected(1), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (d, start, len(want), zlib.crc32(want.tobytes()), want.tobytes())
        start += len(want)
    write_token_files(docs.limit(0), str(tmp_path / "e"))
    assert read_token_files(spark, str(tmp_path / "e")).collect() == []


@pytest.mark.parametrize("length", [8, 4096])
def test_pack(spark, length):
    want = {d: e for (d, *_), e in zip(rows(), expected(2))}
    got = pack(spark.createDataFrame(rows(), SCHEMA).repartition(3), length=length).collect()
    parts, sequences = {}, {}
    for r in got:
        assert bytes(r.ids) == want[r.doc_id][r.start : r.start + r.length].tobytes() and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(want[r.doc_id])
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places, total in [(parts[d], len(e)) for d, e in want.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for a, n in sorted(places):
            assert a == at
            at += n
        assert at == total if total else at <= length and (at == length or at & (at - 1) == 0)
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hilbert_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_pipeline_stages(spark, tmp_path):
    base = [" ".join(f"w{(i * 7 + j * j) % 97}x{j % 13}" for j in range(120 + i)) for i in range(12)]
    near = base[0].split()
    near[60] = "changed"
    texts = [*base, base[3], " ".join(near), "### $$$ " * 40, "short text", None]
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(14)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append(sorted(r.doc_id for r in docs.collect()))
    assert ids[0] == list(range(14))
    assert ids[1] == [0, 1, 2, *range(4, 14)]
    assert ids[2] == [0, 1, 2, *range(4, 13)]
    assert set(ids[3]) <= set(ids[2]) and ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(set(ids[3]))


def test_pipeline_edges(spark, tmp_path):
    """Null, repeated and clashing: every stage returns its input's columns, rows that share a doc_id stay or go together, and no rows give none."""
    clash = "doc_id bigint, text string, source string, __chosen int, __copies int, __copy int, copies string, node bigint, size int"
    long = [" ".join(f"u{i}v{j}" for j in range(90)) for i in range(4)]
    rows = [(1, long[0], "a", 7, 8, 9, "x", 1, 2), (1, long[1], "a", 7, 8, 9, "x", 1, 2), (2, long[2], None, None, None, None, None, None, None), (None, long[3], "b", 1, 1, 1, "y", 3, 4), (None, None, "b", 1, 1, 1, "y", 3, 4), (3, "", "a", 1, 1, 1, "z", 5, 6)]
    docs = spark.createDataFrame(rows, clash)
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= set(rows), name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text) == sorted([(1, long[0]), (1, long[1]), (2, long[2]), (0, long[3])])
    last = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in last(spark, docs, str(tmp_path)).collect()} == {1, 2, 3, None} and last(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_forget_drops_the_tokenizers():
    from fathomlake.llm import tokens

    tokens.piece_tokenizer(tokens.tokenizer_path())
    tokens.forget()
    assert not tokens._TOKENIZERS
