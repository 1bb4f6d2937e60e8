import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quillon.llm import bpe, media
from quillon.llm.queries import op5_media  # noqa: F401

SCHEMA = "doc_id long, text string, ids string, media string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def cases():
    rnd = random.Random(1)
    alphabet = "abcdehinorst'  \n!<|>0189éß日🙂 　\x1c\x85"
    fixed = ["", "a" * 5000, "ab" * 4000, " " * 3000, "x  y\t\n\n z" * 500, "日本語" * 900, "don't'll" * 700, "<|endoftext|>" * 3 + "a<|endof", "!!!'s" * 900, "1234567890" * 300]
    return fixed + ["".join(rnd.choices(alphabet, k=rnd.randint(1, 3000))) for _ in range(120)] + ["".join(rnd.choices("etaoinshrd", k=rnd.randint(1, 4000))) for _ in range(40)]


@pytest.mark.parametrize("leaf,run", [(1, 1), (2, 8), (7, 8), (64, 32), (1024, 4096)])
def test_tree_concatenation_is_the_library(library, leaf, run):
    tree = bpe.TreeBPE(P.path(bpe.VOCABULARY), leaf, run)
    texts = cases()
    for text, ids, want in zip(texts, tree.encode_all(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids
        assert tree.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
    assert tree.joins > 100 and (leaf > 100 or tree.run_joins > 10)


def test_tree_at_production_parameters(library):
    """Whole documents, most of which are cut and joined."""
    tree = bpe.TreeBPE(P.path(bpe.VOCABULARY))
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    for ids, want in zip(tree.encode_all(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids
    assert tree.joins > 1000


@pytest.mark.parametrize("text", ["abcdefgh" * 125_000, "etaoin" * 170_000, "日本語の文。" * 60_000, " " * 300_000, "!?" * 200_000, "don't'll" * 40_000])
def test_text_without_a_space(library, text):
    tree = bpe.TreeBPE(P.path(bpe.VOCABULARY))
    began = time.time()
    ids = tree.encode(text)
    assert time.time() - began < 60 and tree.joins > 200
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and tree.decode(ids) == text


def test_encode_and_decode(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate([*cases()[:20], "words of a long text " * 20000, "x" * 100000])] + [(None, "null id", None, None), (3, None, None, None), (4, "again", "x", "y"), (4, "again", "x", "y")]
    got = bpe.decode(bpe.encode(spark.createDataFrame(rows, SCHEMA))).collect()
    want = sorted((r[0] is None, r[0] or 0, np.array(library.encode(r[1] or "", add_special_tokens=False).ids, "<u4").tobytes(), r[1] or "") for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.decoded) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 168, 169, 170, 182, 184, 4095, 4096, 4097, 70000, 200001])
def test_transport_stream(n):
    rnd = random.Random(n)
    payload = media.padded(bytes(rnd.getrandbits(8) for _ in range(n)))
    stream = media.mux(payload)
    got = media.demux(stream)
    assert len(payload) % 64 == 0 and len(payload) > 0 and got["payload"] == payload
    assert got["discontinuities"] == got["crc_errors"] == 0
    assert got["stamps"] == [k * media.TICK for k in range(got["units"])] and got["access"] == list(range(0, got["units"], media.GOP))


def test_transport_stream_faults():
    stream = media.mux(bytes(range(256)) * 64)
    lost = stream[: 188 * 5] + stream[188 * 6 :]
    assert media.demux(lost)["discontinuities"] == 1
    broken = bytearray(stream)
    broken[12] ^= 1
    assert media.demux(bytes(broken))["crc_errors"] == 1
    with pytest.raises(ValueError):
        media.demux(stream[:-1])
    assert media.crc_mpeg(b"123456789") == 0x0376E6E7


def test_media_columns(spark):
    rows = [(1, "text é", "x", "y"), (2, "", None, None), (3, None, None, None), (None, "z" * 100000, None, None), (1, "text é", "x", "y")]
    got = media.from_media(media.to_media(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == 5
    for r in got:
        text = ((dict((x[0], x[1]) for x in rows))[r.doc_id] or "").encode()
        payload = media.padded(text)
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.mux(payload)), hashlib.sha256(media.mux(payload)).hexdigest())
    assert media.from_media(media.to_media(spark.createDataFrame([], SCHEMA))).collect() == []
