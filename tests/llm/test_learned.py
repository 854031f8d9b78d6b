"""Learned operators on held-out rows, statistics against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stichos.llm import html_blocks, mil_quality, pitman_yor, quality_rules, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def brute_statistics(text):
    w = (text or "").encode().split()
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    return (len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_statistics(documents, labels, tables):
    rows = [(r.doc_id, r.text) for r in tables[0].limit(150).collect()] + [(None, "a b"), (9001, None), (9002, ""), (9003, "a b c d e f g h " * 40), (9004, "|é|\x85 # <x>\nl\nl\n \nl")]
    got = quality_rules.quality_rules(documents(rows), labels([])).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got))) \
        == sorted(map(str, ((i, *brute_statistics(t)) for i, t in rows)))
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)


def test_rules_on_nothing_and_on_a_very_long_text(documents, labels):
    assert quality_rules.quality_rules(documents([]), labels([])).collect() == [] and quality_rules.keep_documents(documents([]), labels([])).collect() == []
    text = "\n".join(" ".join(f"w{i * 7 + j}" for j in range(7)) for i in range(30_000))
    r = quality_rules.quality_rules(documents([(1, text)]), labels([])).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(text) and r.kept


def test_rules_keep_clean_documents(tables):
    docs, labels = tables
    rules = quality_rules.learn_from_labels(docs, labels)
    assert rules and all(r.conditions for r in rules)
    got = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r for r in got if r.quality == 1]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in bad) >= 0.6 * len(bad)
    kept = quality_rules.keep_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality_rules.quality_rules(docs, labels).filter("kept").count()


def test_covering_finds_the_conjunction():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = quality_rules.learn_rules(x, bad)
    hit = np.logical_or.reduce([r.of(x) for r in rules])
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * len(bad)


def auc(rows):
    order = sorted(rows)
    rank = {i: k for k, i in enumerate(range(len(order)))}
    ones = [k for k, (_, y) in enumerate(order) if y]
    return (sum(rank[k] for k in ones) - len(ones) * (len(ones) - 1) / 2) / (len(ones) * (len(order) - len(ones)))


@pytest.mark.parametrize("score,label,modulus,rest,least", [(mil_quality.score_quality, "quality", 4, 2, 0.93), (toxicity.score_toxicity, "toxic", 5, 0, 0.8)])
def test_held_out_accuracy(tables, score, label, modulus, rest, least):
    docs, labels = tables
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == rest) for i, r in got.items())
    rows = [(got[r.doc_id].score, r[label]) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert auc(rows) > least and all(0 <= s <= 1 for s, _ in rows)


@pytest.mark.parametrize("score", [mil_quality.score_quality, toxicity.score_toxicity])
def test_scores_of_odd_rows(documents, labels, score):
    docs = documents([(1, None), (2, ""), (2, "twice"), (None, "no id"), (3, "word " * 20000)])
    assert [len(score(d, labels([])).collect()) for d in (docs, documents([]))] == [5, 0]
    assert all(0 <= r.score <= 1 for r in score(docs, labels([(1, 1, 0), (2, 0, 1), (3, 1, 0)])).collect())


def test_attention_gradients():
    rng, model = np.random.default_rng(0), mil_quality.Model()
    x, count, y, weight = rng.random((9, mil_quality.WIDTH)), np.array([4, 1, 4]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        p = model.forward(x, count)[0]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / 3
    grads = model.gradients(x, count, y, weight)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, model.p[k] = model.p[k], model.p[k].copy()
        model.p[k][at] += 1e-6
        up = loss()
        model.p[k][at] -= 2e-6
        assert math.isclose((up - loss()) / 2e-6, g[at], rel_tol=1e-3), k
        model.p[k] = old


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_equal_edit_distance():
    rng, terms = random.Random(1), ["idiot", "moron", "scum", "clowns", "worthless"]
    lexicon = toxicity.Lexicon(terms, ["blörg"], ["idiom"])
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.randrange(2)] = rng.choice(["", "a", "o", "x"])
        w = "".join(w)
        want = toxicity.EXACT if w in terms else toxicity.FUZZY if any(len(t) >= toxicity.FUZZY_LENGTH and distance(w, t) == 1 for t in terms) else 0
        assert lexicon.match(w) == want, w
    assert lexicon.match("blörgend") == toxicity.STEMMED and lexicon.match("idiom") == 0


def test_quotation_counts_apart():
    m = toxicity.Matches(toxicity.Lexicon(["idiot"]))
    assert toxicity.features_of("you idiot !", m)[0] > 0 and toxicity.features_of('he said "idiot" to me', m)[0] == 0
    assert toxicity.features_of('he said "idiot" to me', m)[3] > 0 and toxicity.features_of("a clean text", m) == [0.0] * toxicity.FEATURES


def test_misspelled_terms_count(tables, documents, labels):
    """Learned from the given tables, tried on texts made for it: terms, misspelled terms, none."""
    docs, marks = tables
    clean = [r.text for r in docs.join(marks.filter("toxic = 0 and quality = 1"), "doc_id").filter("lang = 'en' and length(text) between 500 and 3000").orderBy("doc_id").limit(3).collect()]
    put = lambda text, words: " ".join(x + (" " + words[i // 9 % len(words)] if i % 9 == 4 else "") for i, x in enumerate(text.split(" ")))
    rows = [(10**6 + 4 * i + j, t) for i, c in enumerate(clean) for j, t in enumerate((c, put(c, ["idiot", "moron", "trash"]), put(c, ["idot", "mor0n", "trassh"])))]
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs.select("doc_id", "text").unionByName(documents(rows).select("doc_id", "text")), marks).collect()}
    assert [[got[10**6 + 4 * i + j] for j in range(3)] for i in range(3)] == [[0, 1, 1]] * 3


def test_lexicon_counts_texts_that_share_common_words(spark):
    common = " ".join(f"word{i}" for i in range(30))
    rows = [(f"{common} toxic{i} blarghed" + (" blarqhed" if i < 3 else ""), 1) for i in range(8)] + [(f"{common} clean{i} blarghen", 0) for i in range(9)]
    rows += [(f"{common} clean9 blarqhed", 0)] + [(f"{common}  ONE  gnurfled", 1), (f"{common} one gnurfled", 1)] * 4       # copies count once
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, _label int"))
    assert lexicon.match("blarghed") in (toxicity.EXACT, toxicity.STEMMED) and lexicon.match("gnurfled") == 0
    assert lexicon.match("blarqhed") == toxicity.FUZZY and lexicon.match("blarghen") == 0


def brute_base(rows):
    tok = [["".join(c.lower() if c.isascii() else c for c in t or "").encode().split() + [None] for _, t in rows]][0]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for t, h in zip(tok, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in t), 6)) for (i, _), t, h in zip(rows, tok, held)]


def test_language_model(documents):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a b c", "d e", "F g", f"r{rng.randrange(200)}"]) for _ in range(rng.randrange(60)))) for i in range(200)] + [(900, None), (901, ""), (None, "a b"), (5, "a b"), (5, "a b")]
    got = pitman_yor.score_documents(documents(rows)).collect()
    assert sorted(map(str, ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got))) == sorted(map(str, brute_base(rows)))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert [r.score for r in got if r.doc_id == 5 and r.n_tokens == 3] == [next(r.score for r in got if r.doc_id == 5 and r.n_tokens == 3)] * 2


def test_language_model_with_hot_tokens(documents):
    """Whichever tokens are dealt as hot ones, every document has the same scores."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a b c", "the", "the", f"r{rng.randrange(200)}"]) for _ in range(rng.randrange(60)))) for i in range(200)] + [(900, None), (901, "")]
    docs = documents(rows).repartition(5).cache()
    key = lambda r: (r.doc_id, r.n_tokens)
    want = sorted(pitman_yor.score_documents(docs).collect(), key=key)
    for share, least in ((4, 20), (10 ** 9, 1)):                      # the most frequent ones; all
        got = sorted(pitman_yor.score_documents(docs, share=share, least=least).collect(), key=key)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-6)


def test_no_bucket_has_all_occurrences_of_a_hot_token():
    import pyarrow as pa

    texts = [f"the x{i} the y{i % 7}" for i in range(40_000)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t, "held_out": i % 5 == 0} for i, t in enumerate(texts)])
    rows = [r for _ in range(8) for b in pitman_yor.occurrence_blobs(iter([batch.slice(0, 5000)] * 4), 64) for r in b.to_pylist() if r["bucket"] >= 0]
    the = pitman_yor.Hashes()[b"the"]
    seen = Counter()
    for r in rows:
        if r["kind"] != pitman_yor.COUNTS:
            token = pitman_yor.occurrences(r["blob"])[0]
            seen[r["bucket"]] += int((token == the).sum())
    assert sum(seen.values()) == 8 * 4 * 10_000 and max(seen.values()) <= sum(seen.values()) // 2
    home = [r for r in rows if r["bucket"] == the % 64 and r["kind"] == pitman_yor.PAIRS]
    assert not any((pitman_yor.occurrences(r["blob"])[0] == the).any() for r in home)
    b = pitman_yor.Bucket(the % 64, [r["slice"] for r in home], [r["blob"] for r in home],
                          [r["blob"] for r in rows if r["bucket"] == the % 64 and r["kind"] == pitman_yor.COUNTS])
    assert b.token_count[b.types == the].tolist() == [8 * 4 * 8000] and len(b.count) < 3 * pitman_yor.CONTEXTS


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1:]]
        yield [[items[0]], *rest]


def test_weights_of_all_seatings():
    d = 0.35
    weights = pitman_yor.log_stirling(7, d)
    for c in range(1, 8):
        total = Counter()
        for tables in partitions(list(range(c))):
            total[len(tables)] += math.prod(math.prod(k - d for k in range(1, len(x))) for x in tables)
        assert [math.exp(w) for w in weights[c, 1:c + 1]] == pytest.approx([total[t] for t in range(1, c + 1)])


def one_by_one(c, others, chance, d, rounds, rng):
    """Tables of a dish by a Gibbs sampler that removes one customer at a time and seats it again."""
    tables, found = [c], Counter()
    for step in range(rounds):
        sizes = np.array(tables, dtype=float)
        k = rng.choice(len(tables), p=sizes / sizes.sum())
        tables[k] -= 1
        tables = [x for x in tables if x]
        new = (pitman_yor.STRENGTH + d * (others + len(tables))) * chance
        p = np.array([x - d for x in tables] + [new])
        k = rng.choice(len(p), p=p / p.sum())
        if k == len(tables):
            tables.append(1)
        else:
            tables[k] += 1
        if step > 200:
            found[len(tables)] += 1
    return np.array([found[t] for t in range(1, c + 1)]) / sum(found.values())


@pytest.mark.parametrize("c,others,chance,d", [(2, 0, 0.5, 0.5), (7, 3, 0.2, 0.6), (12, 40, 0.01, 0.8)])
def test_seats_follow_a_sampler_of_single_customers(c, others, chance, d):
    rng = np.random.default_rng(3)
    n = 20_000
    drawn = pitman_yor.seat(np.full(n, c), np.full(n, others), np.full(n, chance), d, rng)
    share = np.bincount(drawn, minlength=c + 1)[1:] / n
    assert np.abs(share - one_by_one(c, others, chance, d, 30_000, rng)).max() < 0.025


@pytest.mark.parametrize("c,others,chance,d", [(70, 50, 0.02, 0.7), (400, 5, 0.3, 0.5), (1000, 10_000, 0.005, 0.8), (1000, 100_000, 0.004, 0.5), (3000, 1000, 0.001, 0.8)])
def test_seats_of_many_customers(c, others, chance, d):
    """Against the weights themselves, summed up for all numbers of tables."""
    n, t = 4000, np.arange(1, c + 1)
    drawn = pitman_yor.seat(np.full(n, c), np.full(n, others), np.full(n, chance), d, np.random.default_rng(2))
    w = pitman_yor.log_stirling(c, d)[c, 1:] + np.cumsum(np.log(pitman_yor.STRENGTH + d * (others + np.arange(c)))) + t * np.log(chance)
    w = np.exp(w - w.max())
    w /= w.sum()
    mean, spread = (w * t).sum(), np.sqrt((w * t * t).sum() - (w * t).sum() ** 2)
    assert drawn.mean() == pytest.approx(mean, rel=0.06) and drawn.std() == pytest.approx(spread, rel=0.12)


def test_seats_of_none_and_one():
    assert pitman_yor.seat(np.array([1, 0, 1]), np.zeros(3), np.full(3, 0.1), 0.5, np.random.default_rng(1)).tolist() == [1, 0, 1]


def test_language_model_on_a_very_long_text(documents):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(40))) for i in range(30)] + [(500, " ".join(rng.choice(["the", "a", "b", f"r{rng.randrange(9000)}"]) for _ in range(150_000)))]
    got = pitman_yor.score_documents(documents(rows)).collect()
    assert sorted(map(str, ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got))) \
        == sorted(map(str, ((*r[:5], round(r[5], 4)) for r in brute_base(rows))))


def test_language_model_on_nothing(documents):
    assert pitman_yor.score_documents(documents([])).count() == 0
    r = pitman_yor.score_documents(documents([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1), "all held out")])).first()
    assert (r.n_known, r.train_tokens) == (0, 0) and abs(r.base_score) < 1e-9 and abs(r.score) < 1e-9


def test_predictive_probabilities_sum_to_one():
    """Over all known tokens and the unknown one, in every context, for one bucket that holds all tokens."""
    rng, known = np.random.default_rng(0), pitman_yor.Hashes()
    token, context, _ = pitman_yor.tokens_of([" ".join(f"w{x}" for x in rng.integers(0, 12, 60)) for _ in range(20)], known)
    order = np.argsort(token, kind="stable")
    types, times = np.unique(token, return_counts=True)
    contexts = np.unique(context)
    # every pair once more as an occurrence that is not learned from, so that all chances come out
    rows = [(t, c, 1) for t, c in zip(token[order], context[order])] + [(t, c, 0) for t in types for c in contexts]
    rows.sort(key=lambda r: r[0])
    u, n = np.unique(np.array([r[0] for r in rows], np.uint64), return_counts=True)
    held = [[u.tobytes(), n.astype(np.uint32).tobytes(), np.array([r[1] | r[2] << 12 for r in rows], np.uint16).tobytes(), np.zeros(len(rows), np.uint16).tobytes()]]
    b = pitman_yor.Bucket(0, [0], held)
    t = pitman_yor.Totals(len(token), len(types), 0.5, 0.4, np.bincount(b.pair_context, b.count, pitman_yor.CONTEXTS))
    state = b.first_state()
    for sweep in range(3):
        if sweep:
            state = b.sweep(state, t, sweep - 1)
        t.tables.append(np.bincount(b.pair_context, state[0], pitman_yor.CONTEXTS))
        t.root.append((float(state[1].sum()), float(state[2].sum())))
        chance = b.chances(state, t, sweep)
        total = np.bincount(b.pair_context, chance, pitman_yor.CONTEXTS)[contexts]
        unknown = (pitman_yor.STRENGTH + t.root_discount * t.root[-1][1]) / (t.n_types + 1) / (pitman_yor.STRENGTH + t.root[-1][0])
        below = (pitman_yor.STRENGTH + t.discount * t.tables[-1][contexts]) / (pitman_yor.STRENGTH + t.customers[contexts]) * unknown
        assert np.allclose(total + below, 1)


ARTICLE = "<h1>A title here</h1><p>First paragraph of the text, with <b>bold</b> &amp; more.</p><p>Second one\n\t goes on and on for some words.<br>after a break</p>"
PAGE = ("<html><head><title>x</title><style>p{}</style></head><body><header class='site-header'><p>Some site name</p></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies here</div><main><article>%s</article></main><aside class='sidebar'><p>Read more of these</p></aside>"
        "<div class='comments'><p>A reader wrote this comment.</p></div><form><label>Your mail</label></form><script>var a='<p>';</script><footer>&copy; all rights</footer></body></html>")
TEXT = "A title here\nFirst paragraph of the text, with bold & more.\nSecond one goes on and on for some words.\nafter a break"


def test_pages(spark):
    given = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in given.collect()] + [(9001, None, PAGE % ARTICLE), (9002, "u", None), (9003, "u", ""), (None, "u", "<p>"), (9001, "again", PAGE % ARTICLE)]
    got = html_blocks.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' text", "1 n_chars"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id == 9001] == [TEXT] * 2
    assert all(r.text == "" for r in out if r.page_id in (9002, 9003) or r.page_id is None)
    import html
    import re
    for r, (_, _, page) in zip(sorted(out[:250], key=lambda r: r.page_id), sorted(rows[:250])):
        blocks = re.split(r"<(?:/?p|/?h1|br)>", page[page.index("<article>") + 9:page.index("</article>")])
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in blocks]
        assert r.text == "\n".join(b for b in blocks if b)


def test_no_pages(spark):
    assert html_blocks.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def random_pages(lengths, seed=4):
    rng = np.random.default_rng(seed)
    paths = [("html", "body", t) for t in ("p", "div", "li li.menu", "article", "nav")]
    return [[html_blocks.Leaf(paths[int(rng.integers(5))], " ".join(["word"] * int(rng.integers(1, 9))) + str(i), 0.0) for i in range(n)] for n in lengths]


def test_blocks_of_steps_score_as_whole_pages(monkeypatch):
    pages, vectors = random_pages([1, 3, 40, 41, 200, 0, 7]), html_blocks.Vectors()
    model = html_blocks.Labeller()
    whole = []
    for page in pages:
        if page:
            x, mask = model._padded([vectors.of(page)])
            whole.append(model._run(x, mask)[0][0])
        else:
            whole.append(np.empty(0))
    for cells in (1, 16, 90, 16_384):
        monkeypatch.setattr(html_blocks, "CELLS", cells)
        for got, want in zip(model(pages, vectors), whole):
            assert got.shape == want.shape and np.abs(got - want).max(initial=0) < 1e-4


def test_memory_does_not_grow_with_a_page():
    import tracemalloc
    pages = random_pages([60_000, *[1] * 63])
    model = html_blocks.Labeller()
    tracemalloc.start()
    got = model(pages, html_blocks.Vectors())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(g) for g in got] == [len(p) for p in pages] and peak < 120 << 20


def test_odd_and_unclosed_elements():
    texts = lambda page: [leaf.text for leaf in html_blocks.leaves(page)]
    assert texts("<p>a<button>no</button>b</p><p>c") == ["a", "b", "c"]
    assert texts("<title>no</title><p>a<button>b<p>c") == ["a", "b", "c"]
    assert texts("<p>a</p><select><option>b<p>c") == ["a", "b", "c"]
    assert texts("<title>a<p>b</p>") == ["a", "b"]
    assert texts("<button-bar>a</button-bar><p>b</p><title-x>c") == ["a", "b", "c"]
    assert texts("<svg><title>no</title></svg><p>a") == ["a"]
    assert texts("<script>no<p>no") == []
    assert texts("<BUTTON class='x'>no</Button >a<select>no</select>") == ["a"]
    assert texts("<p>a</button>b</p>") == ["a", "b"]
    assert texts("<button>" * 3000 + "a") == ["a"]
