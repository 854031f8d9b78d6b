"""Near-duplicates by min-max hashing, links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stichos.llm.common import cut, salted_left_join, slices, texts_of

SHINGLE, THRESHOLD = 3, 85
PERMUTATIONS, MISSED = 96, 1e-6
CENTRE_ROUNDS, MEMBERS, BLOCK = 2, 256, 512
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M2
    return h ^ (h >> np.uint64(29))


def shingles(text: str, k: int, known: WordHashes) -> np.ndarray:
    """Hashes of the distinct k-word shingles in order; of fewer words, the whole sequence is the one shingle.

    A-Z are lower-cased; words are what stands between blanks and the characters 9-13.
    """
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    size = min(n, k)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        h = mixed(h * M1 + w[j:n - size + 1 + j])
    return np.unique(h)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and masks."""
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def signature(hashes: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Minima of all permutations, then their maxima: two samples of the set for one hash evaluation."""
    low, high = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(factors), np.uint64)
    for at in range(0, len(hashes), 1024):
        v = (hashes[at:at + 1024, None] ^ masks) * factors
        np.minimum(low, v.min(axis=0), out=low)
        np.maximum(high, v.max(axis=0), out=high)
    return np.concatenate([low, high])


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each `rows` values, different for each band."""
    v = values[:len(values) // rows * rows].reshape(-1, rows)
    h = np.arange(1, len(v) + 1, dtype=np.uint64) * M1
    for j in range(rows):
        h = mixed(h * M1 + v[:, j])
    return h.view(np.int64)


def band_rows(threshold: int, values: int) -> int:
    """The most values per band with which a pair at the threshold shares no band with a chance of MISSED at most."""
    rows = 1
    while (1 - (threshold / 100) ** (rows + 1)) ** (values // (rows + 1)) <= MISSED:
        rows += 1
    return rows


def keyed_texts(docs: DataFrame) -> DataFrame:
    """Texts with a hash that tells the texts of one doc_id apart."""
    return texts_of(docs).withColumn("key", F.xxhash64("text"))


def sketches(docs: DataFrame, k: int, count: int, rows: int) -> DataFrame:
    """Per row: key of its text, size and digest of its shingle set, and its band hashes (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (factors, masks) = WordHashes(), permutations(count)
        for part in slices(batches):
            size, digest, band = [], [], []
            for text in part.column("text").to_pylist():
                s = shingles(text, k, known)
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                band.append(bands(signature(s, factors, masks), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                                              pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "digest", "bands"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, key long, n_shingles long, digest binary, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= threshold * union.

    The text of a meets at most MEMBERS texts b in one run of rows, so a much linked a is spread over many runs.
    """
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("_runs"))
    dealt = salted_left_join(pairs, runs, ["a"], "b").withColumn("_run", F.pmod(F.xxhash64("b"), F.col("_runs")).cast("int"))
    members = salted_left_join(dealt.select("a", "_run", "b"), texts.withColumnRenamed("node", "b"), ["b"], "a", 4)
    heads = dealt.select("a", "_run").distinct()
    heads = salted_left_join(heads, texts.withColumnRenamed("node", "a"), ["a"], "_run", 4).withColumn("b", F.lit(None).cast("binary"))
    rows = members.unionByName(heads).repartition("a", "_run").sortWithinPartitions("a", "_run", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, head = WordHashes(), np.empty(0, np.uint64)
        for part in slices(batches):
            a, b, found = part.column("a").to_pylist(), part.column("b").to_pylist(), []
            for i, text in enumerate(part.column("text").to_pylist()):
                s = shingles(text, k, known)
                if b[i] is None:
                    head = s
                    continue
                if 100 * min(len(s), len(head)) < threshold * max(len(s), len(head)):
                    continue
                both = np.concatenate([s, head])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= threshold * (len(both) - common):
                    found.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.binary()) for j in (0, 1)], names=["a", "b"])

    return rows.select("a", "_run", "b", "text").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes with an edge, by alternating stars.

    A large star hangs the greater neighbours of a node, a small star its other neighbours, on the least one, until nothing changes.
    """

    def settled(e: DataFrame) -> DataFrame:
        return cut(e.filter("u <> v").distinct(), few=True)

    e = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_left_join(both, least, ["u"], "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_left_join(large, least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settled(small.unionByName(least.select("u", F.col("m").alias("v"))))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")) \
                .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = now


def confirm_across(nodes: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """All links between nodes of one cluster that lie in different components.

    A cluster is dealt to blocks of about BLOCK nodes; a task holds two blocks, counts the common shingles of all their pairs as a
    matrix product over the shingles that two of them share, and gives out only pairs that are linked.
    """
    size = nodes.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    own = salted_left_join(nodes, size, ["cluster"], "node").withColumn("_i", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = own.join(texts, "node").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))) \
        .select("cluster", F.least("_i", "_j").alias("_low"), F.greatest("_i", "_j").alias("_high"), "_i", "node", "component", "text") \
        .repartition("cluster", "_low", "_high").sortWithinPartitions("cluster", "_low", "_high", "_i", "node")

    def linked(sets: list[np.ndarray], node: list[bytes], component: list[bytes], side: list[int], crossed: bool) -> list[tuple[bytes, bytes]]:
        n, sizes, comp, first = len(sets), np.array([len(s) for s in sets]), np.unique(np.array([c.hex() for c in component]), return_inverse=True)[1], np.array(side) == min(side)
        if n < 2 or len(set(component)) < 2:
            return []
        every, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        doc, column = np.repeat(np.arange(n), sizes), np.cumsum(times > 1) - 1
        keep = times[inverse] > 1
        doc, column = doc[keep], column[inverse[keep]]
        order = np.argsort(column, kind="stable")
        doc, column, common = doc[order], column[order], np.zeros((n, n), dtype=np.float32)
        for at in range(0, int((times > 1).sum()), 4096):
            low, high = np.searchsorted(column, (at, at + 4096))
            has = np.zeros((n, 4096), dtype=np.float32)
            has[doc[low:high], column[low:high] - at] = 1
            common += has @ has.T
        total = sizes[:, None] + sizes - common
        hit = np.triu((100 * common >= threshold * total) & (comp[:, None] != comp), 1)
        if crossed:
            hit &= first[:, None] != first
        return [(node[x], node[y]) for x, y in zip(*np.nonzero(hit))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, held = WordHashes(), None, []
        for part in slices(batches):
            found, columns = [], part.to_pydict()
            for *key, i, node, component, text in zip(*(columns[c] for c in ("cluster", "_low", "_high", "_i", "node", "component", "text"))):
                if key != now:
                    if held:
                        found += linked(*map(list, zip(*held)), crossed=now[1] != now[2])
                    now, held = key, []
                held.append((shingles(text, k, known), node, component, i))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.binary()) for j in (0, 1)], names=["a", "b"])
        if held:
            found = linked(*map(list, zip(*held)), crossed=now[1] != now[2])
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.binary()) for j in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD, count: int = PERMUTATIONS, rows: int | None = None) -> DataFrame:
    """Classes of documents joined by links of 100 * |A & B| >= threshold * |A | B| between their sets of k-word shingles.

    Texts with the same set are one node, named by the digest of that set, so a node has one set whatever doc_id its rows carry. Each permutation gives its
    minimum and its maximum; `rows` of these values make a band (as many as leave a pair at the threshold without a common band with a chance of one
    in a million at most: 6 at 85 per cent, 5 at 80), and nodes that share a band are candidates. The members
    of a bucket are first compared with one of them, not with each other: with its least node, then with one chosen by a hash, across
    classes that are still apart. Nodes of buckets that still hold several classes are then compared across these in blocks, so no
    candidate pair is left undecided; pairs within a class need no further link. Every link is confirmed on full sets.

    Result: doc_id, n_shingles, component_id (least doc_id of the class), kept (whether that is its own). Documents without words are
    linked with nothing. Rows that share a doc_id are one document: the sets of its texts are linked, too, and all its rows are in one class. A row without doc_id is linked with nothing: its
    component_id is null and it is kept. Other columns are not read.
    """
    found = cut(sketches(docs, k, count, rows or band_rows(threshold, 2 * count)))
    usable = found.filter(F.col("bands").isNotNull() & F.col("doc_id").isNotNull())
    nodes = cut(usable.groupBy(F.col("digest").alias("node")).agg(F.min(F.struct("doc_id", "key")).alias("row"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")))
    member = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count("*").alias("_members")).filter("_members > 1").select("band", F.lit(True).alias("_shared"))
    member = cut(salted_left_join(member, shared, ["band"], "node").filter("_shared").select("band", "node", "n"))
    wanted = nodes.join(member.select("node").distinct(), "node", "left_semi").select("row.*", "node")
    texts = cut(keyed_texts(docs).join(wanted, ["doc_id", "key"]).groupBy("node").agg(F.max("text").alias("text")))

    # the texts of one doc_id are one document
    listed = usable.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("_z")).filter("a <> _z").select("doc_id", "a")
    links = usable.select("doc_id", F.col("digest").alias("b")).join(listed, "doc_id").filter("a <> b").select("a", "b").distinct()
    apart = member.withColumn("component", F.col("node"))
    for step in range(CENTRE_ROUNDS):
        rank = F.xxhash64("node") if step else F.col("node")
        centre = apart.groupBy("band").agg(F.min(F.struct(rank.alias("_rank"), "node", "n", "component")).alias("c"))
        pairs = salted_left_join(apart, centre, ["band"], "node").filter(F.col("c.component") != F.col("component")) \
            .filter(100 * F.least("c.n", "n") >= threshold * F.greatest("c.n", "n")) \
            .select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
        links = links.unionByName(confirm(cut(pairs, few=True), texts, k, threshold))
        classes = components(links)
        links = classes.select(F.col("component").alias("a"), F.col("node").alias("b"))
        apart = salted_left_join(member, classes, ["node"], "band").withColumn("component", F.coalesce("component", "node"))
        split = apart.groupBy("band").agg((F.min("component") < F.max("component")).alias("_split")).filter("_split")
        apart = cut(salted_left_join(apart, split, ["band"], "node").filter("_split").select("band", "node", "n", "component"), few=True)
    centre = apart.groupBy("band").agg(F.min("node").alias("b"))
    together = components(salted_left_join(apart, centre, ["band"], "node").select(F.col("node").alias("a"), "b"))
    left = apart.select("node", "component").distinct().join(together.withColumnRenamed("component", "cluster"), "node")
    classes = components(links.unionByName(confirm_across(left, texts, k, threshold)))

    place = nodes.select("node", F.col("row.doc_id").alias("_doc")).join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = place.groupBy("component").agg(F.min("_doc").alias("_least"))
    place = salted_left_join(place, least, ["component"], "node").select(F.col("node").alias("digest"), F.col("_least").alias("component"))
    out = salted_left_join(found.select("doc_id", "n_shingles", "digest"), place, ["digest"], "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each_class(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose document is the least of its class.

    Rows without doc_id, without words or with a null text stay; an empty table stays empty.
    """
    gone = near_duplicates(docs, k, threshold).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
