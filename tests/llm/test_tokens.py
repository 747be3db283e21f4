"""BPE against the tokenizers library, and token shards against plain lists."""

import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("catchment.llm")
from catchment.llm import bpe, wavelet
from catchment.llm.queries import tokenizer_path
from tests.llm.conftest import TEXTS

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_same_ids_as_the_library(spark, library):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [x or "" for _, x in TEXTS] + ["don't WE'LL I'd a's", "x" * 3000, "日本語 テキスト", "🙂🙂 a🙂b", "ǅ ﬁ ß", "".join(map(chr, range(1, 256))) * 2, "Éa²³ ½ü\xa0ª_×÷ÿ\x85ß\x1cx\x1fy µm ¿Qué?", "naïve œuvre — Ça", "<|startoftext|><|endoftext|> <|end"]
    mine = bpe.ForcedBoundaryBPE(PATH)
    for text, ids in zip(texts, mine.encode_all(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert mine.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_other_files_are_rejected():
    with pytest.raises(ValueError, match="normaliser"):
        bpe.ForcedBoundaryBPE(tokenizer_path("byte_bpe_50k.json"))


def test_rows_that_repeat_a_doc_id_have_an_order(spark):
    rows = [(7, "b c d"), (7, "a"), (7, None), (7, "b c d"), (1, "z")]
    got = [{(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.token_files(spark.createDataFrame(x, "doc_id long, text string"), PATH).collect()} for x in (rows, rows[::-1])]
    assert got[0] == got[1] and sorted(x[1] for x in got[0]) == [0, 2, 3, 5, 9]


def test_forced_boundaries_are_certain():
    mine = bpe.ForcedBoundaryBPE(PATH)
    letters = bpe.byte_letters()
    code = {c: k for k, c in enumerate(letters)}
    for token in list(mine.vocab)[::97]:
        spelt = [code[c] for c in token.removesuffix(mine.end)]
        assert all(mine.inside[a, b] for a, b in zip(spelt, spelt[1:]))
    assert not mine.inside.all()


def test_small_tables_give_the_same(monkeypatch):
    texts = ["one two three four five six"] * 3 + ["six five four"] * 2
    whole = bpe.ForcedBoundaryBPE(PATH)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 2)
    small = bpe.ForcedBoundaryBPE(PATH)
    for x in texts:
        assert small.encode(x).tolist() == whole.encode(x).tolist()


def test_digests(odd_docs, no_docs, library):
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.token_digests(odd_docs, PATH).collect())
    want = []
    for k, x in TEXTS:
        ids = library.encode(x or "", add_special_tokens=False).ids
        want.append((k or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.token_digests(no_docs, PATH).count() == 0


def test_encode_keeps_columns(odd_docs, no_docs):
    got = bpe.encode_documents(odd_docs, PATH)
    assert got.columns == ["doc_id", "text", "score", "token_ids", "n_tokens", "decoded"] and got.count() == len(TEXTS)
    assert got.where("size(token_ids) <> n_tokens").isEmpty() and bpe.encode_documents(no_docs, PATH).isEmpty()


def test_matrix_access(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", 1 << 9)
    ids = np.random.default_rng(0).zipf(1.3, 3000).clip(0, 49407).astype(np.uint16)
    blob = wavelet.pack([5, None, 7], [1000, 0, 2000], ids)
    m = wavelet.WaveletMatrix(lambda at, n: blob[at : at + n])
    assert (m.decode() == ids).all() and m.directory()[0] == [5, None, 7]
    assert [m.access(k) for k in range(0, 3000, 31)] == ids[::31].tolist()
    for v in (1, 2, 40, 49407):
        where = np.flatnonzero(ids == v)
        assert m.count(v) == len(where) and m.count(v, 777) == (where < 777).sum()
        assert [m.select(v, j) for j in range(0, len(where), 7)] == where[::7].tolist()
    with pytest.raises(IndexError):
        m.access(3000)


def test_token_files(odd_docs, no_docs, library):
    for shard in (1 << 22, 5):
        got = wavelet.token_files(odd_docs, PATH, shard_tokens=shard).orderBy("start").collect()
        start = 0
        for r, (k, x) in zip(got, sorted(TEXTS, key=lambda z: z[0] or 0)):
            ids = library.encode(x or "", add_special_tokens=False).ids + [1]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert wavelet.token_files(no_docs, PATH).count() == 0
