import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assay.llm import tokenbin
from assay.llm.tokenbin import Encoder, Frequencies, decode_block, encode_block, op8_token_ids, read, write

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\x1c", "\xa0", "　", ",", "?!", "Wörter", "ª", "ǅ", "ʰ", "’s", "\x85", "a", "word", "É", "7", ".", "'s", "<|endoftext|>", "日本", "🙂"]), max_size=14).map("".join), max_size=4))
def test_pieces_give_the_ids_of_the_whole(texts):
    got = [np.frombuffer(b, np.uint16).tolist() for b in Encoder.at(PATH).encode(texts)]
    assert got == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 129, 5000, 100001])
def test_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, 999)
    f, first, symbol = Frequencies(np.bincount(ids, minlength=1000)).tables()
    b = encode_block(ids, f, first, lanes=32, every=16)
    assert np.array_equal(decode_block(b, f, first, symbol), ids)
    k = len(b["points"])
    parts = [decode_block(b, f, first, symbol, i, i + 1) for i in range(k + 1)]
    assert np.array_equal(np.concatenate(parts), ids)
    if n > 5000:
        assert k > 3 and len(b["words"]) < 1.02 * n * 8 / 8
        for broken in (b | {"words": b["words"][:-1] + bytes([b["words"][-1] ^ 1])}, b | {"ids_crc32": b["ids_crc32"] ^ 1}):
            with pytest.raises(ValueError):
                decode_block(broken, f, first, symbol)


def test_frequencies_leave_no_id_out():
    counts = np.array([10**9, 0, 1, 1, 5])
    assert Frequencies(counts).slots.sum() == 1 << tokenbin.PRECISION and (Frequencies(counts).slots > 0).tolist() == (counts > 0).tolist()
    assert not Frequencies(np.zeros(3)).slots.any()
    assert Frequencies(np.ones(50_257)).slots.min() >= 1


def want(rows):
    out, start = [], 0
    for d, t in rows:
        ids = WHOLE.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_odd_rows(spark, tmp_path):
    rows = [(9, "zero ! zero"), (1, None), (3, ""), (2, "a  b   c \n d "), (5, "word " * 60000), (-4, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as block")
    write(df, str(tmp_path / "x"), PATH)
    got = [(r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(r.ids)) for r in read(spark, str(tmp_path / "x")).collect()]
    assert sorted(got) == want(sorted(rows))
    write(df.limit(0), str(tmp_path / "y"), PATH)
    assert read(spark, str(tmp_path / "y")).collect() == []
    twice = spark.createDataFrame([(None, "b"), (None, "b"), (1, "x"), (1, "y")], "doc_id long, text string")
    write(twice, str(tmp_path / "z"), PATH)
    got = sorted((r.start, r.doc_id) for r in read(spark, str(tmp_path / "z")).collect())
    assert got == [(0, None), (2, None), (4, 1), (6, 1)]


def test_query_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, op8_token_ids(spark, sf).collect())) == want(rows)


def test_several_parts_and_blocks(spark, tmp_path, monkeypatch):
    """Ids, their starts and their order over blocks of a few documents in many parts, with repeated and null ids between."""
    monkeypatch.setattr(tokenbin, "BLOCK", 500)
    rows = [(r.doc_id * 7 % 1000 - 300, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, "first"), (10**12, "last"), (-(10**12), "before")]
    monkeypatch.setattr(tokenbin, "PART", 30_000)
    monkeypatch.setattr(tokenbin, "LOT", 2_000)
    write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), str(tmp_path / "x"), PATH)
    blocks = spark.read.parquet(str(tmp_path / "x" / "blocks")).groupBy("part").count().collect()
    assert len(blocks) > 8 and max(r["count"] for r in blocks) > 3
    got = [(r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(r.ids)) for r in read(spark, str(tmp_path / "x")).collect()]
    exact = want(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert len({r[0] for r in rows}) == len(rows)
    assert sorted(got, key=lambda r: r[1]) == exact


@pytest.mark.parametrize("remembered", [0, 30, 10_000])
def test_memory_of_words(monkeypatch, remembered):
    monkeypatch.setattr(tokenbin, "REMEMBERED", remembered)
    encoder = Encoder(PATH)
    for k in range(12):
        texts = [f"same words, here and other{k // 2}x{i} ones; again" for i in range(10)] + ["", " ", "\n"]
        assert [np.frombuffer(b, np.uint16).tolist() for b in encoder.encode(texts)] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.words) == len(encoder.known) <= max(remembered, 17)


def test_pieces_are_asked_in_parts(monkeypatch):
    monkeypatch.setattr(tokenbin, "ASKED", 7)
    texts = [f"same words here and other{k} ones,  again {'x' * k}\n {k}" for k in range(60)] + [""]
    assert [np.frombuffer(b, np.uint16).tolist() for b in Encoder(PATH).encode(texts)] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]
