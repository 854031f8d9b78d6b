"""Exact, near and substring duplicates against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stichos.llm import exact_dedup, near_dedup, suffix_dedup


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base, passage = words(rng, 80), " ".join(words(rng, 40))
    rows = []
    for i in range(60):                                               # near copies of a text that is not there itself
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(i, " ".join(words(rng, rng.randrange(1, 60)))) for i in range(60)]
    rows += [(200 + i, f"{' '.join(words(rng, 20))} {passage} {' '.join(words(rng, 10))}") for i in range(20)]
    rows += [(300 + i, "the same text again and again " * 6) for i in range(30)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, "one"), (404, "ONE"), (405, "one two"), (405, "one two"), (406, "x" * 5000), (407, "ab" * 300), (408, "é" * 200)]
    rows += [(None, "no id at all " * 20), (None, "the same text again and again " * 6), (500, rows[60][1])]
    return rows


def test_exact(documents, corpus):
    groups = {}
    for i, t in corpus:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_duplicates(documents(corpus)).collect()
    assert len(got) == len(corpus)
    for (i, t), r in zip(sorted(corpus, key=str), sorted(got, key=lambda r: str((r.doc_id, next(t for j, t in corpus if j == r.doc_id and hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256))))):
        ids = [j for j in groups[t or ""] if j is not None]
        keep = max(ids) if ids else None
        assert (r.doc_id, r.keep_id, r.group_size, r.kept) == (i, keep, len(groups[t or ""]), i == keep)
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_on_nothing_and_without_ids(documents):
    assert exact_dedup.exact_duplicates(documents([])).collect() == [] and exact_dedup.one_of_each(documents([])).collect() == []
    long_text = "long " * 200_000
    rows = [(None, "same")] * 40 + [(3, "same"), (7, "same"), (None, "alone"), (None, "alone"), (1, long_text), (2, long_text), (4, long_text + "x")]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(documents(rows)).collect())
    assert got == {(None, 7, 42, False): 40, (3, 7, 42, False): 1, (7, 7, 42, True): 1, (None, None, 2, True): 2, (1, 2, 2, False): 1, (2, 2, 2, True): 1, (4, 4, 1, True): 1}


def test_very_long_texts(documents):
    rng = random.Random(12)
    text = " ".join(words(rng, 60_000, 50_000))
    rows = [(1, text), (2, text + " end"), (3, " ".join(words(rng, 60_000, 50_000)))]
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(rows)).collect()} == {1: 1, 2: 1, 3: 3}
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(documents(rows)).collect()}
    assert removed[2] == (len(text) + 4, len(text)) and removed[1][1] == removed[3][1] == 0


def test_exact_rows_that_stay(documents, corpus):
    left = exact_dedup.one_of_each(documents(corpus)).collect()
    assert Counter(r.text or "" for r in left) == Counter({**{t or "": 1 for _, t in corpus}, "one two": 2})
    assert left[0].k1 == "x" and left[0].n_words == 7


def shingle_set(text, k):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, threshold):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t, k))
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= threshold * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("k,threshold", [(3, 85), (5, 80)])
def test_near(documents, corpus, k, threshold):
    want, sets = brute_components(corpus, k, threshold)
    got = near_dedup.near_duplicates(documents(corpus), k, threshold).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def test_near_of_a_doc_id_with_two_texts(documents):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (1, "zzz other words here"), (2, text + " tail"), (3, text), (4, "zzz other words here too far off"), (5, "zzz other words here"), (None, text), (9, None)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.near_duplicates(documents(rows)).collect()}
    assert got == {(1, 198): 1, (1, 2): 1, (2, 199): 1, (3, 198): 1, (4, 5): 4, (5, 2): 1, (None, 198): None, (9, 0): 9}


def test_near_of_many_alike_but_unlinked(documents):
    # half of each text is shared: far below the threshold, and many bands are, too
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base + [f"x{i}_{j}" for j in range(rng.integers(20, 30))])) for i in range(300)] + [(1000 + i, " ".join(base + [f"x{i}_{j}" for j in range(15)])) for i in range(0, 300, 30)]
    want, _ = brute_components(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(rows)).collect()}
    assert got == want


def test_bands_leave_few_pairs_out():
    for threshold, rows in ((80, 5), (85, 6)):
        assert near_dedup.band_rows(threshold, 192) == rows
        assert (1 - (threshold / 100) ** rows) ** (192 // rows) < 1e-6


def test_near_on_nothing(documents):
    assert near_dedup.near_duplicates(documents([])).count() == 0
    assert [r.component_id for r in near_dedup.near_duplicates(documents([(5, None), (6, "")])).orderBy("doc_id").collect()] == [5, 6]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    factors, masks = near_dedup.permutations(400)
    both = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = near_dedup.mixed(both[:700]), near_dedup.mixed(both[200:])
    same = (near_dedup.signature(a, factors, masks) == near_dedup.signature(b, factors, masks)).mean()
    assert abs(same - 500 / 900) < 0.06


def test_components_of_a_chain(spark):
    rows = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def brute_removed(rows, width):
    seen, out = {}, {}
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    for has, i, t in docs:
        d = t.encode()
        edge = np.zeros(len(d) + 1, int)
        for p in range(len(d) - width + 1):
            if d[p:p + width] in seen:
                edge[p] += 1
                edge[p + width] -= 1
            seen[d[p:p + width]] = True
        gone = np.cumsum(edge)[:-1] > 0
        left = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out[has, i, t] = (len(d), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest())
    return out


def test_repeats(documents, corpus):
    rows = [r for r in corpus if r[0] is not None] + [(None, "no id at all " * 20)]
    want = brute_removed(rows, 100)
    got = suffix_dedup.remove_repeats(documents(rows)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) \
        == sorted((i is not None, i or 0, *want[i is not None, i or 0, t or ""]) for i, t in rows)


def test_repeats_of_a_row_listed_twice(documents):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (2, "few words " + text), (3, " ".join(f"other{i}" for i in range(60)))]
    want = brute_removed(rows, 100)
    for parts in (1, 5):                                              # both rows in one slice, or in slices of different tasks
        got = suffix_dedup.remove_repeats(documents(rows + rows).repartition(parts)).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) \
            == sorted((i, *want[True, i, t]) for i, t in rows + rows)


def test_repeats_in_many_rows_without_doc_id(documents, spark):
    rng = random.Random(11)
    text = lambda n: " ".join(words(rng, n, 10_000))
    shared = text(40)
    rows = [(None, f"{text(20)} {shared} {i}") for i in range(60)] + [(i, f"{text(20)} {shared if i % 5 == 0 else text(30)}") for i in range(120)]
    keys = suffix_dedup.keyed(documents(rows)).filter("doc_id IS NULL").select("k1").distinct().count()
    assert keys == 60
    got = suffix_dedup.remove_repeats(documents(rows)).collect()
    free = [r for r in got if r.doc_id is None]
    # the first of them keeps the passage, all others lose it
    assert sum(r.n_removed < len(shared) - 100 for r in free) == 1
    assert all((r.n_removed >= len(shared) - 100) == (r.doc_id % 5 == 0) for r in got if r.doc_id is not None)


def test_filter_of_hot_anchors():
    held = [5, 1 << 63, (1 << 64) - 1]
    f = suffix_dedup.HotAnchors(np.array([h >> 43 for h in held]))
    assert all(h in f for h in held) and (1 << 50) not in f and f and not suffix_dedup.HotAnchors(np.empty(0, np.int64))
    assert f.held.nbytes == 1 << 21


@pytest.mark.parametrize("hot", [1, 12])
def test_repeats_around_hot_anchors(documents, corpus, hot):
    rng, line = random.Random(8), "a line of the template that many pages have"
    rows = [r for r in corpus if r[0] is not None] + [(None, "no id at all " * 20)]
    rows += [(600 + i, f"{' '.join(words(rng, 30))} {line} {' '.join(words(rng, 30, 3))}") for i in range(40)]
    want = brute_removed(rows, 100)
    got = suffix_dedup.remove_repeats(documents(rows), hot=hot).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) \
        == sorted((i is not None, i or 0, *want[i is not None, i or 0, t or ""]) for i, t in rows)


def test_a_hot_anchor_is_spread_over_buckets():
    rng, line = random.Random(8), "a line of the template that many pages have"
    rows, hashes = [], []
    for i in range(300):
        text = f"{' '.join(words(rng, 30, 10 ** 6))} {line} {' '.join(words(rng, 30, 10 ** 6))}"
        data = np.frombuffer(text.encode(), np.uint8)
        _, place, first, last, h = suffix_dedup.anchors(data, np.array([len(data)]), 100, 32)
        hashes.append(set(h.tolist()))
        rows.append((i, text, place, first, last, h))
    often = {h for h, n in Counter(x for s in hashes for x in s).items() if n > 100}
    batch = pa.RecordBatch.from_pylist([{"k1": i, "k2": 7, "text": text, "anchors": [int(p << 16 | (p - f) << 8 | (p - e))
                                         for p, f, e, x in zip(place, first, last, h) if x in often]} for i, text, place, first, last, h in rows])

    def largest(*more):
        sizes = [sum(map(len, suffix_dedup.unpack(r["blob"]))) for b in suffix_dedup.context_blobs(iter([batch]), 100, 32, 64, *more) for r in b.to_pylist()]
        return max(sizes) / sum(sizes)
    assert often and largest() > 0.4 and largest(frozenset(often)) < 0.05
    counted = [r for b in suffix_dedup.anchor_counts(iter([batch]), 100, 32, 101) for r in b.to_pylist()]
    assert {r["h"] & (1 << 64) - 1 for r in counted} == often


def test_a_row_listed_twice_within_and_across_slices():
    text = " ".join(f"word{i}" for i in range(60))
    data = np.frombuffer(text.encode(), np.uint8)
    _, place, first, last, _ = suffix_dedup.anchors(data, np.array([len(data)]), 100, 32)
    found = ((place << 16) | (place - first) << 8 | (place - last)).tolist()

    def runs(*slices_):
        batches = [pa.RecordBatch.from_pylist([{"k1": 1, "k2": 7, "text": text, "anchors": found}] * n) for n in slices_]
        dealt = sorted((row for batch in suffix_dedup.context_blobs(iter(batches), 100, 32, 4) for row in batch.to_pylist()), key=lambda r: r["bucket"])
        return sum(b.num_rows for b in suffix_dedup.repeated_runs(iter([pa.RecordBatch.from_pylist(dealt)]), 100))
    assert runs(2) == runs(1, 1) == runs(2, 1) == 0


def test_rows_without_repeats(documents):
    text = " ".join(f"word{i}" for i in range(60))
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(documents([(1, text), (2, "new " + text + " end"), (3, "ß" * 120), (4, None)])).collect()}
    assert got[1].text == text and got[2].text.startswith("new") and got[2].text.endswith("end") and len(got[2].text) < 30
    assert got[2].n_chars == len(got[2].text) and got[2].k1 == "x" and got[4].text == ""
    assert set(got[3].text) <= {"ß"}


def test_repeats_of_nothing(documents):
    assert suffix_dedup.remove_repeats(documents([])).count() == 0
    assert suffix_dedup.remove_repeats(documents([(1, ""), (2, None), (3, "short")])).agg({"n_removed": "sum"}).first()[0] == 0


def test_suffix_classes():
    rng = np.random.default_rng(3)
    for k in range(40):
        buf = rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(200, 3000))).astype(np.uint8)
        if k % 3 == 0:
            buf = np.tile(buf[:int(rng.integers(1, 90))], 50)[:len(buf)]
        if k % 5 == 0:                                                # many strings that differ late
            buf = np.concatenate([np.concatenate([buf[:40], rng.integers(0, 5, 70).astype(np.uint8)]) for _ in range(60)])
        if len(buf) < 150:
            continue
        at = np.unique(rng.integers(0, len(buf) - 99, 400))
        strings = [buf[i:i + 100].tobytes() for i in at]
        rank = {s: i for i, s in enumerate(sorted(set(strings)))}
        assert suffix_dedup.classes_of(buf, at).tolist() == [rank[s] for s in strings]


def test_cover_meets_every_difference():
    for v in (8, 32, 57):
        cover = suffix_dedup.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
