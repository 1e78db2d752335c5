"""Kernels without Spark: encoders against the libraries, the coder, the index, the loser tree, sketches."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

import public_tokenizers
from weftline.llm import fingerprint, warc
from weftline.llm.bytebpe import ByteBPE
from weftline.llm.common import text_buffers
from weftline.llm.fm_index import FMIndex, WaveletMatrix
from weftline.llm.id_coder import BLOCK, decode_chunk, encode_chunk
from weftline.llm.piece_bpe import BacktrackEncoder

ODD = ["", "a  b", " a", "it's we'll I'd 's !'s x'S  'tis don't", "\n\n a\n\nb \n", "日本語 é 12 34abc", "  ", "'", "<|endoftext|>hi", "tab\t\tx", "\U0001f600 ok", "▁a ▁", None, "a" * 300, "\x00\x1c"]


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def piece():
    return BacktrackEncoder(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _ids(encoder, texts):
    ids, at = encoder.encode(*text_buffers(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_byte_bpe_is_the_library(bpe):
    assert _ids(bpe, ODD) == [bpe.tokenizer.encode(t or "", add_special_tokens=False).ids for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_byte_bpe_on_any_text(bpe, texts):
    assert _ids(bpe, texts) == [bpe.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_are_the_library(piece, sp):
    texts = [t or "" for t in ODD]
    assert _ids(piece, ODD) == sp.encode(texts)
    assert [piece.decode(i + [2]).decode() for i in _ids(piece, ODD)] == [sp.decode(sp.encode(t) + [2]) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aehtinrs .é\n▁", max_size=60), min_size=1, max_size=3))
def test_backtracking_is_exact(piece, sp, texts):
    assert _ids(piece, texts) == sp.encode(texts)


@pytest.mark.parametrize("seed", range(6))
def test_coder_round_trip(seed):
    r = np.random.default_rng(seed)
    for ids in (np.zeros(0, int), np.array([7]), r.integers(0, 65536, 5000), np.tile(r.integers(0, 50000, 37), 300), r.zipf(1.3, 20000) % 50257, np.zeros(3 * BLOCK, int)):
        data = encode_chunk(ids)
        assert (decode_chunk(data) == ids).all()
    assert (decode_chunk(data, [1]) == ids[BLOCK : 2 * BLOCK]).all()


def test_coder_follows_the_language():
    """Ids of two languages in turns cost far less than their common order 0."""
    r = np.random.default_rng(4)
    ids = np.concatenate([r.integers(1000 * (k % 2), 1000 * (k % 2) + 200, 3000) for k in range(60)])
    data = encode_chunk(ids)
    assert (decode_chunk(data) == ids).all()
    assert 8 * len(data) / len(ids) < np.log2(200) + 0.5 < np.log2(400)


def test_coder_finds_damage():
    r = np.random.default_rng(0)
    data = encode_chunk(r.zipf(1.4, 5000) % 300)
    places = [*range(80), *r.integers(0, len(data), 60).tolist(), len(data) - 1]
    for k in places:
        bad = bytearray(data)
        bad[k] ^= 1 << (k % 8)
        with pytest.raises(ValueError):
            decode_chunk(bytes(bad))
    for k in (0, 3, 20, 50, 200, len(data) - 1):
        with pytest.raises(ValueError):
            decode_chunk(data[:k])
    with pytest.raises(ValueError):
        decode_chunk(data + b"x")
    for ids in ([70000], [-1]):
        with pytest.raises(ValueError):
            encode_chunk(np.array(ids))


def test_index_finds_all_occurrences():
    r = np.random.default_rng(5)
    for _ in range(20):
        runs = [r.integers(1, 4, r.integers(1, 30)) for _ in range(r.integers(1, 12))]
        runs += runs[:3]
        symbols = np.concatenate([np.append(x, 0) for x in runs])
        index = FMIndex(symbols, 3)
        patterns = np.array([r.integers(1, 4, 3) for _ in range(12)])
        got = {}
        for who, at in index.locate(*index.search(patterns)):
            for w, a in zip(who.tolist(), at.tolist()):
                got.setdefault(w, []).append(a)
        for k, p in enumerate(patterns):
            want = [i for i in range(len(symbols) - 2) if (symbols[i : i + 3] == p).all()]
            assert sorted(got.get(k, [])) == want


def test_wavelet_rank():
    v = np.random.default_rng(1).integers(0, 9, 300)
    w = WaveletMatrix(v, 4)
    for c in range(9):
        assert (w.rank(np.full(301, c), np.arange(301)) == np.concatenate([[0], np.cumsum(v == c)])).all()


def test_loser_tree():
    random.seed(2)
    for k in range(9):
        rows = [sorted(random.randint(0, 9) for _ in range(random.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(rows, lambda x: x)) == sorted(sum(rows, []))


def test_sketches_estimate():
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 1 << 48, 4000)).astype(np.uint64)
    a = r.permutation(a)
    b = np.concatenate([a[:3000], np.unique(r.integers(0, 1 << 48, 1000)).astype(np.uint64)])
    x, y = fingerprint.bottom(a), fingerprint.bottom(b)
    assert abs(fingerprint.resemblance(x, y) - 0.6) < 0.15
    assert abs(fingerprint.containment(x, y) - 0.75) < 0.15
    assert abs(fingerprint.distinct(x) / 4000 - 1) < 0.3
    assert (fingerprint.merge(x, y) == fingerprint.bottom(np.concatenate([a, b]))).all()
    assert (fingerprint.read(fingerprint.write(x))[1] == x).all()
    none = np.zeros(0, np.uint64)
    assert fingerprint.resemblance(none, none) == 1.0 and fingerprint.resemblance(none, x) == 0.0


def test_damaged_archive():
    import gzip

    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def test_pairs_of_a_long_list_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    from weftline.llm.jaccard_join import ENTRY_BITS, _Lists

    n = 1024
    some = np.random.default_rng(1).integers(0, 256, (n // 2, ENTRY_BITS // 8), dtype=np.uint8)
    columns = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), np.full(n, 200 << 32), np.arange(n)]
    lists = _Lists(pa.table([*map(pa.array, columns), pa.array([x.tobytes() for x in [*some, *some]], pa.binary())], names=list("abcdef")), 80)
    tracemalloc.start()
    found = {tuple(p) for pairs in lists.pairs() for p in pairs.tolist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == {(i, i + n // 2) for i in range(n // 2)}
    assert peak < 64 << 20


def test_other_operators_drop_a_worker_s_encoder():
    import gc
    import weakref

    from weftline.llm import bytebpe, decontaminate, jaccard_join, piece_bpe, toxicity

    texts = pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["some words here"])], names=["key", "text"])
    for use in (
        lambda: jaccard_join._sets(texts.column(1), 5),
        lambda: list(toxicity._contexts([texts])),
        lambda: list(decontaminate._shards([texts], 1)),
        lambda: bytebpe.opened(public_tokenizers.path("byte_bpe_50k.json")),
    ):
        held = weakref.ref(piece_bpe.opened(public_tokenizers.path("piece_bpe_32k.model")))
        assert piece_bpe.opened(public_tokenizers.path("piece_bpe_32k.model")) is held()
        use()
        gc.collect()
        assert held() is None


def test_coded_bytes_stay_as_they_were():
    import zlib

    # Some 70 blocks with repeats, for which order 0 has eight tables; bytes as round 2's coder wrote them.
    i = np.arange(70 * BLOCK + 77, dtype=np.int64)
    ids = ((i * i >> 7) % 97 + 300 * (i >> 14) + (i % 13 == 0) * (i >> 3) % 5000).astype(np.int32)
    coded = encode_chunk(ids)
    assert (len(coded), zlib.crc32(coded)) == (150077, 411552627)
    assert (decode_chunk(coded) == ids).all()
    assert (decode_chunk(coded, [3, 70]) == np.concatenate([ids[3 * BLOCK : 4 * BLOCK], ids[70 * BLOCK :]])).all()


def test_a_worker_s_encoder_and_shingles_take_little_memory():
    import tracemalloc

    from weftline.llm import jaccard_join, piece_bpe

    r = np.random.default_rng(3)
    texts = pa.array([" ".join("".join(chr(97 + c) for c in r.integers(0, 26, 9)) for _ in range(60)) for _ in range(3000)])
    coder = piece_bpe.BacktrackEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    for use, most in ((lambda: coder.encode(*text_buffers(texts)), 96 << 20), (lambda: jaccard_join._sets(texts, 5), 14 << 20)):
        tracemalloc.start()
        use()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most, peak >> 20


def test_pairs_of_tokens_share_the_vocabulary_s_strings():
    from weftline.llm import piece_bpe

    coder = piece_bpe.opened(public_tokenizers.path("piece_bpe_32k.model"))
    coder.encode(*text_buffers(pa.array(["unfathomable zyxwv qwertz words of several tokens, " * 3])))
    assert coder.fits and all(coder.tokens.get(x, x) is x for pair in coder.fits for x in pair)


def test_a_smaller_bound_of_batches_stays():
    from types import SimpleNamespace

    from weftline.llm.common import ARROW_BATCH_BYTES, bound_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for own, bounds, left in ((None, [0, 2 << 20, 0], 2 << 20), (None, [2 << 20, 0], 2 << 20), (None, [0], ARROW_BATCH_BYTES), ("123", [0, 2 << 20], 123)):
        conf = {} if own is None else {key: own}
        spark = SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__))
        for b in bounds:
            bound_batches(spark, b or ARROW_BATCH_BYTES)
        assert int(conf[key]) == left
