"""Cutting, token files and vector codes against brute force."""

import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stichos.llm import fill_middle as fm, token_store as ts, vector_codes as vc

WORDS = P.path("word_bpe_49k.json")
TEXTS = ["", None, "one line", "\n", "\n\n\n", "a\nb\n", "a\nb", "é日本\n\U0001f600x\r\ny z\n", "holds <S> in it\nx\n", "x" * 5000 + "\n" + "y\n" * 3000, "a\nb"]


# ---- fill in the middle ------------------------------------------------------------------------------------

def cut_by_hand(doc_id, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(documents):
    rows = [*enumerate(TEXTS), (3, "again\nand\nagain"), (None, "no\nid"), (None, "no\nid"), *((100 + k, "a\nbc\ndef\ng") for k in range(60))]
    out = fm.fill_in_middle(documents(rows)).withColumn("back", fm.restored("output", "form")).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=key) == sorted((cut_by_hand(*r) for r in rows), key=key)
    assert Counter((r.doc_id, r.back) for r in out) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fm.fill_in_middle(documents([])).collect() == []


def test_fill_in_middle_rate_and_sentinels(documents):
    rows = [(k, f"line {k}\nof\ntext") for k in range(200)]
    out = fm.fill_in_middle(documents(rows), rate=50, spm_rate=0, sentinels=("[pre]", "[suf]", "[mid]")).collect()
    forms = Counter(r.form for r in out)
    assert set(forms) == {"plain", "psm"} and 60 < forms["plain"] < 140
    with pytest.raises(ValueError):
        fm.fill_in_middle(documents(rows), sentinels=("<", "<>", "<"))
    with pytest.raises(ValueError):
        fm.fill_in_middle(documents(rows), sentinels=("aba", "x", "y"))


@settings(max_examples=100, deadline=None)
@given(steps=st.lists(st.integers(0, 400), min_size=1, max_size=300), error=st.integers(1, 200))
def test_rank_index_is_exact(steps, error):
    values = np.cumsum(steps)
    index = fm.RankIndex(values, error)
    assert index[np.arange(len(values))].tolist() == values.tolist()
    assert np.abs(index.residuals.astype(int)).max() <= error + 1


def test_rank_index_takes_few_segments():
    rng = np.random.default_rng(1)
    values = np.cumsum(rng.integers(1, 200, 100_000))
    index = fm.RankIndex(values)
    assert len(index.first) < 20 and index.residuals.dtype == np.int16
    assert (index[np.arange(100_000)] == values).all()


# ---- token files -------------------------------------------------------------------------------------------

def shard_of(ids, lengths=None):
    out = io.BytesIO()
    ts.write_shard(out, np.array(ids, np.uint32), [None, *range(1, len(lengths or [1]))], lengths or [len(ids)])
    data = out.getvalue()
    return ts.Shard(lambda start, length: data[start:start + length]), len(data)


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 70_000), min_size=1, max_size=80), many=st.integers(1, 3))
def test_wavelet_matrix(ids, many):
    ids = ids * many
    shard, _ = shard_of(ids)
    assert shard.tokens(np.arange(len(ids))).tolist() == ids == shard.all_tokens().tolist()
    for token in {*ids[:5], 2, 80_000, 1 << 20}:
        where = [i for i, x in enumerate(ids) if x == token]
        assert shard.places(token).tolist() == where and shard.count(token) == len(where)
        assert shard.places(token, 1, 2).tolist() == where[1:2]
        for start, stop in ((0, len(ids) // 2), (len(ids) // 3, len(ids))):
            assert shard.count(token, start, stop) == ids[start:stop].count(token)


def test_wavelet_matrix_of_many_blocks():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 20 * ts.BLOCK + 17), 49_000).astype(np.uint32)
    shard, size = shard_of(ids)
    assert (shard.tokens(np.arange(len(ids))) == ids).all() and (shard.all_tokens() == ids).all()
    assert size < 2 * len(ids)
    read = []
    inner = shard.read
    shard.read = lambda start, length: read.append(length) or inner(start, length)
    del shard._planes
    some = np.array([0, 1, ts.BLOCK - 1, ts.BLOCK, len(ids) - 1])
    assert (shard.tokens(some) == ids[some]).all()
    for token in (1, 2, 48_999, 49_000):
        assert (shard.places(token) == np.flatnonzero(ids == token)).all()
    read.clear()
    assert shard.count(7, 100, 390_000) == int((ids[100:390_000] == 7).sum())
    assert sum(read) < size / 4                                       # a look-up reads its blocks, not the file


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abS.,'!\"-1 \n\tstÀßĳ×»…\x1c\x0b\u00a0ªµ́é日ΣİQ ½<|>\U0001f600\x85"), max_size=40))
def test_words_equal_the_library(library, text):
    assert np.frombuffer(ts.word_tokenizer(WORDS)([text])[0], "<u4").tolist() == library(text)


def test_small_memory_stays_right(library):
    small = ts.WordTokenizer(WORDS, entries=8)
    for n in range(30):
        texts = [f"Word{n}, the w{n + k}... END." for k in range(3)] + ["x" * 3000, "<|endoftext|>"]
        assert [np.frombuffer(x, "<u4").tolist() for x in small(texts)] == [library(t) for t in texts]


def test_other_tokenizers_read_whole_texts():
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["two  blanks", " lead", "a\n\nb", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in ts.WordTokenizer(path)(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_store_round_trip(documents, library):
    rows = [*enumerate(TEXTS), (3, "again"), (3, "again"), (None, "no id"), (None, None), *((1000 - k, f"word {k} the end") for k in range(300))]
    files = ts.write_shards(documents(rows), WORDS, shard_tokens=400)
    read = sorted(ts.read_documents(files).collect(), key=lambda r: r.start)
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in read]
    assert files.count() > 3 and [r.n_tokens for r in read] == list(map(len, ids))
    assert [r.start for r in read] == [sum(map(len, ids[:k])) for k in range(len(ids))]
    assert [-1 if r.doc_id is None else r.doc_id for r in read] == sorted(-1 if i is None else i for i, _ in rows)
    assert Counter((r.doc_id, tuple(x)) for r, x in zip(read, ids)) == Counter((i, (*library(t or ""), 2)) for i, t in rows)
    flat = [x for y in ids for x in y]
    common = library("the")[0]
    assert {r.token: r.n for r in ts.count_tokens(files, [common, 2, 60_000]).collect()} == {common: flat.count(common), 2: len(rows), 60_000: 0}
    places = ts.occurrences(files, common).collect()
    assert sorted(r.corpus_place for r in places) == [k for k, x in enumerate(flat) if x == common]
    begins = {k: r.start for r in read for k in range(r.start, r.start + r.n_tokens)}
    assert all(r.place == r.corpus_place - begins[r.corpus_place] for r in places)
    assert ts.read_documents(ts.write_shards(documents([]), WORDS)).collect() == []


def test_crc_is_of_all_ids(documents, library):
    r = ts.read_documents(ts.write_shards(documents([(5, "Some words, and 12.")]), WORDS)).select("start", "n_tokens", F.crc32("ids").alias("crc")).first()
    ids = [*library("Some words, and 12."), 2]
    assert (r.start, r.n_tokens, r.crc) == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


# ---- vector codes ------------------------------------------------------------------------------------------

def lloyd_by_hand(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, ints). Codes in row order and the codebooks."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    piece = lambda v, p: v[p * width:(p + 1) * width]
    books = [[piece(v, p) for _, v in rows[:entries]] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min(range(len(books[p])), key=lambda e: (d(piece(v, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = [near(p, v) for _, v in rows]
            for e in range(len(books[p])):
                of = [piece(v, p) for (_, v), m in zip(rows, mine) if m == e]
                if of:
                    books[p][e] = [sum(c) // len(of) for c in zip(*of)]
    code = Counter((i, bytes(near(p, v) for p in range(parts)), sum(d(piece(v, p), books[p][near(p, v)]) for p in range(parts))) for i, v in rows)
    return code, books


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, x, "other", 1.0) for i, v, x in rows], "vec_id long, embedding array<double>, label int, part string, error double")


def ints(v, scale=4096):
    return [int(np.floor(x * scale)) for x in v]


@pytest.mark.parametrize("kind", ["clusters", "ties", "large"])
def test_codes_equal_brute_force(vectors, kind):
    rng = np.random.default_rng(5)
    if kind == "clusters":
        centres = rng.normal(size=(6, 24))
        data = centres[rng.integers(0, 6, 400)] + rng.normal(scale=0.05, size=(400, 24))
        data[100:250] = data[100]                                     # a group of equal vectors
    elif kind == "ties":
        data = rng.integers(-2, 3, (300, 16)) / 4096
    else:
        data = rng.normal(scale=10_000, size=(120, 8))
    rows = [(int(i), data[i].tolist(), int(i % 3) or None) for i in rng.permutation(len(data))]
    bad = [(1000, None, 1), (-1, [float("nan")] * data.shape[1], 1), (-2, [None] * data.shape[1], 1), (-3, [float("-inf")] * data.shape[1], 1), (2000, [1.0], 1)]
    extra = [rows[0], (None, data[3].tolist(), None)]
    out = vc.compress_vectors(vectors(rows + bad + extra).repartition(3), chunk=64)
    code, books = lloyd_by_hand([(i, ints(v)) for i, v, _ in rows + extra])
    assert out.codebooks.tolist() == books
    got = out.table.collect()
    assert Counter((r.vec_id, bytes(r.code), r.error) for r in got) == code
    assert Counter((r.vec_id, r.label) for r in got) == Counter((i, x) for i, _, x in rows + extra)


def test_few_odd_and_no_vectors(vectors):
    out = vc.compress_vectors(vectors([(2, [0.5] * 9, 1), (1, [0.25] * 9, 1)]))
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in out.table.collect()) == [(1, bytes(8), 0), (2, bytes([1] * 5 + [0] * 3), 0)]
    assert out.codebooks.shape == (8, 2, 2)
    empty = vc.compress_vectors(vectors([(1, None, 1)]))
    assert empty.table.collect() == [] and empty.codebooks.shape[1] == 0
    none = vc.compress_vectors(vectors([(1, [], 1), (2, [], None)]))
    assert [(bytes(r.code), r.error) for r in none.table.collect()] == [(bytes(8), 0)] * 2
    huge = vc.compress_vectors(vectors([(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1)]))
    assert [r.error for r in huge.table.collect()] == [0, 0]


def test_restored_vector_is_near():
    books = np.arange(8 * 4 * 2).reshape(8, 4, 2)
    assert vc.restore(bytes([0, 1, 2, 3, 0, 1, 2, 3]), books, 1).tolist() == [x for p, c in enumerate([0, 1, 2, 3] * 2) for x in books[p][c].tolist()]


def test_cover_tree_covers_and_separates():
    rng = np.random.default_rng(2)
    points = rng.integers(-1000, 1000, (700, 3))
    t = vc.cover_tree(points)
    far = lambda a, b: np.sqrt(((points[a] - points[b]) ** 2).sum(axis=-1))
    assert sorted(t.order.tolist()) == list(range(700))
    for k in range(len(t.low)):
        members = t.order[t.low[k]:t.high[k]]
        assert far(members, members[0]).max() <= t.radius[k]
        kids = range(t.child[k], t.child[k] + t.children[k])
        assert sum(t.high[c] - t.low[c] for c in kids) == (len(members) if len(kids) else 0)
        heads = t.order[t.low[list(kids)]] if len(kids) else []
        for i, a in enumerate(heads):
            assert all(far(a, b) > t.radius[k] / 2 for b in heads[:i])


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(4)
    centres = rng.integers(-100_000, 100_000, (16, 8))
    points = centres[rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (4000, 8))
    t = vc.cover_tree(points)
    low, high, whole, places, single = vc.assign(t, points[t.order], centres)
    assert (high - low).sum() + len(places) == 4000 and len(places) == 0 and len(low) < 400
    assert (vc.codes(t, points[t.order], centres) == vc.squared(points[t.order], centres).argmin(axis=1)).all()
