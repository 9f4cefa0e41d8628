"""op3: exact round trips."""

import zlib

import numpy as np
import pytest

from altscore.llm import codec as C
from altscore.llm import token_files as T
from altscore.llm import tokens as K
from fixtures import edge_docs, no_docs


@pytest.mark.parametrize("n,length,top", [(1, 1, 10), (1, 700, 3), (7, 300, 49408), (40, 200, 50)])
def test_blocks_round_trip(n, length, top):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.2, size=(n, length)) % top).astype("<u2")
    blobs = C.encode(ids)
    assert np.array_equal(C.decode(blobs, length), ids)
    # blocks are independent: any of them can be read alone
    assert np.array_equal(C.decode(blobs[-1:], length), ids[-1:])


def test_repetition_is_cheap():
    ids = np.tile(np.arange(100, dtype="<u2") * 37, (4, 20))
    assert sum(map(len, C.encode(ids))) * 8 / ids.size < 4


def _library_ids(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    return np.frombuffer(b"\1\0\0\0".join(K.PieceEncoder(T.TOKENIZER).encode(texts)), "<u4").astype("<u2")


def test_smaller_than_deflate_and_static_frequencies(spark):
    ids = _library_ids(spark)
    blocks = ids[:len(ids) // C.BLOCK * C.BLOCK].reshape(-1, C.BLOCK)
    coded = C.encode(blocks)
    assert np.array_equal(C.decode(coded, C.BLOCK), blocks)
    bits = sum(map(len, coded)) * 8 / blocks.size
    deflated = sum(len(zlib.compress(b.tobytes(), 9)) for b in blocks) * 8 / blocks.size
    share = np.bincount(blocks.ravel()) / blocks.size
    static = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert bits < 0.85 * deflated and bits < static


def test_frequencies_never_reach_zero():
    """A digit after any number of others has a place left."""
    a, b = np.full(6000, 65535, "<u2"), np.full(6000, 0, "<u2")
    ids = np.stack([np.r_[a, b, a[:5]], np.r_[b, a, b[:5]], np.resize(np.r_[a[:1], b[:1]], 12005)])
    assert np.array_equal(C.decode(C.encode(ids), ids.shape[1]), ids)


def test_ids_beyond_16_bits_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="16 bits"):
        T.write(no_docs(spark), str(tmp_path / "ids"), end_id=70000)


def test_crc_join():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 4000):
        a, b = r.bytes(13), r.bytes(n)
        assert C.crc_join(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def _expected(rows):
    tok, out, at = K.load_tokenizer(K.tokenizer_path(T.TOKENIZER)), [], 0
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    for r in rows:
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((r.doc_id, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    return out


@pytest.mark.parametrize("size,blocks", [(4096, 1024), (100, 3), (7, 1)])
def test_files_give_the_library_ids(spark, tmp_path, size, blocks):
    d = edge_docs(spark).where("text is null or length(text) < 5000 or doc_id = 9") if size < 100 else edge_docs(spark)
    path = str(tmp_path / "ids")
    T.write(d, path, size=size, blocks=blocks)
    got = [tuple(r) for r in T.documents_of(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == _expected(d.collect())


def test_broken_block_is_noticed(spark, tmp_path):
    path, bad = str(tmp_path / "ids"), str(tmp_path / "bad")
    T.write(edge_docs(spark).where("doc_id = 7"), path)
    spark.read.parquet(path).selectExpr("part", "block", "first", "n_ids", "steps", "crc32 + 1 as crc32", "payload", "docs").write.parquet(bad)
    with pytest.raises(Exception, match="CorruptBlock"):
        T.documents_of(spark, bad).collect()


def test_empty(spark, tmp_path):
    T.write(no_docs(spark), str(tmp_path / "ids"))
    assert T.documents_of(spark, str(tmp_path / "ids")).count() == 0
