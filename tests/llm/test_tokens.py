import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm import batches, bpe, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "a", "Hello  wörld's <|endoftext|>x\x1cy\x85z᠎ İΣ Σ", "x" * 3000, "ab" * 2000 + "!", "it's we'll 12345 ½ ́é é",
    "tab\tnew\nline\x0bvt\x0cff\rcr\xa0nb em　id", "日本語のテキスト 한국어 😀😀", "<|startoftext|><|endoftext|> <|endoftext", "ÀÉÎ ŒUVRE ẞ ﬁ K Å",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_segment_tree_encodes_as_the_library(library):
    ours, rng = bpe.WordBpe(PATH), random.Random(5)
    alphabet = "abcdeéèthéionñß'.,;12 \ńΣσİIi<|>"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == want, t[:80]
        assert ours.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_query_rows(spark, library):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.encode_documents(df, PATH).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), PATH).collect() == []
    twice = bpe.encode_documents(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string"), PATH).collect()
    assert sorted(str(r.doc_id) for r in twice) == ["7", "7", "None"] and len({r.ids_sha256 for r in twice}) == 1


def test_dac_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.integers(0, 1 << rng.integers(1, 33, n), n).astype(np.uint32)
        code = token_files.Dac(token_files.dac_encode(ids))
        places = rng.permutation(n)
        assert (code.gather(places) == ids[places]).all()
        for a, b in [(0, n), *(sorted(rng.integers(0, n + 1, 2).tolist()) for _ in range(50))]:
            assert (code.read(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        code[5000]


def test_a_token_is_read_without_the_others():
    ids = np.random.default_rng(2).integers(0, 1 << 17, 40_000).astype(np.uint32)
    raw = token_files.dac_encode(ids)
    chunks = token_files.Dac(raw).levels[0][0]
    base = raw.index(chunks.tobytes())
    for place in (0, 777, 39_999):
        spoilt = bytearray(raw)
        for k in range(len(chunks)):  # every other first chunk is overwritten
            if k != place:
                spoilt[base + k] ^= 255
        code = token_files.Dac(bytes(spoilt))
        assert code[place] == ids[place] and code.read(place, place + 1)[0] == ids[place]


def test_places_of_a_file_set(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 50)
    rows = [(i, f"the year {i} of the plan " * (i % 5)) for i in range(60)]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), PATH, 2)
    want = [x for _, t in rows for x in (*library.encode(t, add_special_tokens=False).ids, 2)]
    asked = [0, 1, 49, 50, 51, 333, len(want) - 1, 333, None, len(want), -1]
    got = token_files.read_places(spark, str(tmp_path / "t"), spark.createDataFrame([(a,) for a in asked], "place long")).collect()
    assert sorted((r.place, r.id if r.id is not None else -1) for r in got) == sorted((a, want[a] if 0 <= a < len(want) else -1) for a in set(asked) - {None})


def test_repeated_rows_null_ids_and_clashing_columns(spark, tmp_path):
    rows = [(5, "a b", 1, 2), (5, "a b", 1, 2), (None, "c", 1, 2), (1, None, 1, 2)]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string, start long, ids int"), str(tmp_path / "t"), PATH, 2)
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 1), (5, 3, 3), (5, 6, 3)]


def test_token_files(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 50)
    df = spark.createDataFrame([(100 - 7 * i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    token_files.write_token_files(df, str(tmp_path / "t"), PATH, 2)
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).collect())
    start = 0
    for r, (i, t) in zip(got, sorted((100 - 7 * i, t or "") for i, t in enumerate(TEXTS)), strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)
    token_files.write_token_files(df.limit(0), str(tmp_path / "e"), PATH, 2)
    empty = token_files.read_token_files(spark, str(tmp_path / "e"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]


def test_worker_holds_one_slice_of_a_batch():
    """The rows of a large batch come out whole and in order, in slices; decoded texts only where wanted."""
    texts = [f"Word{k} of a text, " * 40 for k in range(5000)] + [None, "", "x" * (3 << 20), "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(batches.text_slices(batch, 1))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == texts
    assert max(p.num_rows for p in parts) <= 1024
    assert max(sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) for p in parts) < 1 << 20
    assert list(batches.text_slices(batch.slice(0, 0), 1)) == []
    small = batch.slice(0, 3000)
    encoder = bpe.WordBpe(bpe.default_vocabulary())
    out = list(bpe.encode_batches(iter([small]), encoder, decoded=False))
    assert len(out) > 2 and out[0].schema.names == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    whole = encoder.encode_texts([t.encode() for t in texts[:3000]])
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc_id"], r["ids"], r["decoded_sha256"]) for r in rows] == [(k, i, hashlib.sha256(d).hexdigest()) for k, (i, d) in enumerate(whole)]
