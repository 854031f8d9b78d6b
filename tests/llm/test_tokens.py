"""Encoding and packing against the public libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from stichos.llm import bpe, packing

TEXTS = ["", None, "a", "  two  blanks ", "line\n\nline\n x", "it's 12½ Ⅷ <|endoftext|> é日本", "z" * 3000, "ab" * 400 + " end", "x\x85y \x1c z w", "word " * 3000]
MULTI = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(MULTI, P.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab \n\t's1½é日! \x85AZ\U0001f600"), max_size=60))
def test_ids_equal_the_library(encoder, reference, text):
    ids = encoder.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_pieces_longer_than_a_row(encoder, reference):
    for piece in ("a" * 1000, "lorem" * 300, "!?" * 500, "日本" * 200):
        assert np.frombuffer(encoder.encode([piece])[0], "<u4").tolist() == reference.encode_ordinary(piece)


def test_full_memory_forgets_and_stays_right(encoder, reference):
    from stichos.llm.chunks import ChunkTokenizer
    small = ChunkTokenizer(encoder.encode_chunks, entries=5)
    for n in range(30):
        texts = [f"w{n} the w{n + k}, end" for k in range(4)]
        assert small(texts) == [np.array(reference.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_encode_documents(documents, reference):
    rows = list(enumerate(TEXTS)) + [(3, "again"), (None, "no id")]
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(documents(rows), MULTI, P.PATTERN).collect())
    want = []
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want.append((i is None, i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_encode_ids_and_empty_table(documents, reference):
    assert bpe.encode_ids(documents([(1, "some text")]), MULTI, P.PATTERN).first().ids == reference.encode_ordinary("some text")
    assert bpe.encode_documents(documents([]), MULTI, P.PATTERN).count() == 0


def test_packing_is_gapless(documents):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = list(enumerate(TEXTS)) + [(100 + i, f"topic {i % 7} words about topic {i % 7} number {i} " * (i % 40)) for i in range(120)] + [(None, "no id")]
    pieces = packing.pack_documents(documents(rows), path, P.PATTERN, window=64).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    full = sum(sum(p.length for p in ps) == 64 for ps in by_sequence.values())
    assert len(by_sequence) - full <= 8                               # one open sequence for each partition


def test_packing_prefers_neighbours():
    documents = [np.array([1, 2, 3, 4]), np.array([9, 8, 7, 6]), np.array([1, 2, 3, 5]), np.array([9, 8, 7, 5])]
    scores = packing.bm25(documents)
    assert set(scores[0].argsort()[-2:]) == {0, 2} and set(scores[1].argsort()[-2:]) == {1, 3}
    assert packing.order_by_neighbours(scores, [4, 4, 4, 4], 8, 0) == [0, 2, 3, 1]


def test_bm25_equals_its_formula():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 30, int(rng.integers(1, 60))) for _ in range(40)]
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(30)}
    want = np.array([[sum(np.log1p((n - df[t] + .5) / (df[t] + .5)) * (tf := (d == t).sum()) * 2.2 / (tf + 1.2 * (.25 + .75 * len(d) / mean))
                          for t in set(q.tolist()) & set(d.tolist())) for d in docs] for q in docs])
    assert np.allclose(packing.bm25(docs), want, rtol=1e-4)


def test_packing_of_nothing(documents):
    assert packing.pack_documents(documents([]), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_merging_by_rank_equals_the_tokenizer():
    """Words of the given texts, made-up words, odd characters."""
    import pyarrow.parquet as pq
    path = P.path("byte_bpe_50k.json")
    tokenizer, chunks = Tokenizer.from_file(path), packing.chunk_tokenizer(path, P.PATTERN)
    assert packing.merge_ranks(path)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("ab1.,'\"-s ²é́日ⅷ\n\t<|>"), int(rng.integers(0, 16)))) for _ in range(4000)] + ["<|endoftext|> x<|endoftext|>y"]
    assert chunks(texts) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
