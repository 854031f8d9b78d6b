"""Removing repeated byte strings: suffixes sorted bucket by bucket, long ties resolved by difference-cover ranks."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from stichos.llm.common import NULL_ID, parallelism, ship, slices

WIDTH, GRAM, COVER = 100, 32, 32
SLICE, BUCKETS_PER_PARTITION = 1 << 20, 16
FILTER_BITS = 21
HOT, LEAST = 1 << 13, 4                                               # places of an anchor from which it is split; counts of a task that are summed up
POSITION_BITS = 28
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


# ---- anchors: which strings can repeat at all ------------------------------------------------

def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` (a power of two) bytes from each position on."""
    h, factor, size = buf.astype(np.uint64) + np.uint64(1), int(M1), 1
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor, size = factor * factor % (1 << 64), size * 2
    h = (h ^ (h >> np.uint64(30))) * M2
    return h ^ (h >> np.uint64(29))


def anchors(buf: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """The place of least hash (leftmost of several) of every window of `width` bytes that lies in one document.

    buf holds documents one after another, ends their ends. Returns, for each place and run of windows that share it: document,
    place, first and last window, hash at the place. Equal strings have their places at equal offsets and with equal hashes.
    """
    empty = np.empty(0, np.int64)
    if len(buf) < width:
        return empty, empty, empty, empty, empty.view(np.uint64)
    h = gram_hashes(buf, gram)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    least = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    span, size = width - gram + 1, 1
    while size * 2 <= span:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if span > size:
        least = np.minimum(least[:len(least) - (span - size)], least[span - size:])
    start = np.arange(len(least))
    doc = np.searchsorted(ends, start, side="right")
    start = start[start + width <= ends[doc]]
    place = (least[start] & mask).astype(np.int64)
    if not len(start):
        return empty, empty, empty, empty, empty.view(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    place = place[new]
    return doc[start[new]], place, start[new], start[last], h[place]


# ---- suffix order ----------------------------------------------------------------------------

def difference_cover(v: int) -> list[int]:
    """Residues such that every difference modulo v is one between two of them (greedy)."""
    cover, open_ = [0], set(range(1, v))
    while open_:
        best = max(range(v), key=lambda x: (len(open_ & ({(x - c) % v for c in cover} | {(c - x) % v for c in cover})), -x))
        open_ -= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    return sorted(cover)


def shifts(v: int, cover: list[int]) -> np.ndarray:
    """For residues a, b the least l with (a + l) and (b + l) both in the cover."""
    inside = np.isin(np.arange(2 * v) % v, cover)
    out = np.zeros((v, v), dtype=np.int64)
    for a in range(v):
        for b in range(v):
            out[a, b] = int(np.flatnonzero(inside[a:a + v] & inside[b:b + v])[0])
    return out


COVER_SET = difference_cover(COVER)
SHIFTS = shifts(COVER, COVER_SET)


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0, equal for equal keys."""
    order = np.argsort(keys)
    s = keys[order]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])) if len(s) else 0
    return out


def ranks_of(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the positions by the `depth` 8-byte words from each on; only ties are looked at again."""
    rank = dense(words[at])
    for d in range(1, depth):
        tied = np.flatnonzero(np.bincount(rank)[rank] > 1)
        if not len(tied):
            break
        step = dense(words[at[tied] + 8 * d])
        finer = dense(rank[tied] * (int(step.max()) + 1) + step)
        rank = rank * (len(tied) + 1)
        # counted from the least finer rank of its old class, so that classes keep their order
        order = np.argsort(finer, kind="stable")
        old = rank[tied][order]
        firsts = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        start = np.repeat(finer[order][firsts], np.diff(np.append(firsts, len(old))))
        rank[tied[order]] = old + finer[order] - start
        rank = dense(rank)
    return rank


def classes_of(buf: np.ndarray, at: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Class of the `width` bytes from each position on, numbered in the order of the suffixes.

    Suffixes are sorted by their first COVER bytes; ties by ranks of the sampled suffixes (positions with residues in the difference cover,
    themselves sorted to `width` bytes), compared at the one shift at which both suffixes of a pair meet the sample. Tied groups are
    split around a pivot, all groups at once. Neighbours in this order that agree in `width` bytes are then one class.
    """
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(width + 4 * COVER + 16, np.uint8)]).astype(np.uint64)
    words = np.zeros(n + width + 4 * COVER, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k:k + len(words)]
    edge = np.zeros(n + COVER + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + COVER, -1)
    need = np.cumsum(edge)[:-1] > 0                                   # sample ranks are asked for within COVER bytes of a suffix
    sample = np.flatnonzero(need & np.isin(np.arange(len(need)) % COVER, COVER_SET))
    rank_at = np.zeros(len(need), dtype=np.int64)
    rank_at[sample] = ranks_of(words, sample, -(-width // 8))
    rank = ranks_of(words, at, COVER // 8)
    sizes = np.bincount(rank)
    final = (np.cumsum(sizes) - sizes)[rank]                          # place in the order; members of a class share it
    open_ = np.flatnonzero(sizes[rank] > 1)
    while len(open_):
        open_ = open_[np.argsort(final[open_], kind="stable")]
        low = final[open_]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        size = np.diff(np.append(first, len(low)))
        group = np.repeat(np.arange(len(first)), size)
        pivot, here = at[open_[first + size // 2]][group], at[open_]
        shift = SHIFTS[pivot % COVER, here % COVER]
        side = np.sign(rank_at[here + shift] - rank_at[pivot + shift])
        less, equal = (np.bincount(group[where], minlength=len(first)) for where in (side < 0, side == 0))
        final[open_] = low + np.where(side < 0, 0, np.where(side == 0, less[group], less[group] + equal[group]))
        rest = np.where(side < 0, less[group], size[group] - less[group] - equal[group])
        open_ = open_[(side != 0) & (rest > 1)]
    cls = dense(final)
    # representatives of neighbouring classes that agree in all bytes compared (they differ only further on)
    lead = np.zeros(int(cls.max()) + 1 if len(cls) else 0, dtype=np.int64)
    lead[cls] = at
    differs = np.zeros(max(len(lead) - 1, 0), dtype=bool)
    for offset in [*range(0, width - 7, 8), width - 8]:
        differs |= words[lead[1:] + offset] != words[lead[:-1] + offset]
    return np.concatenate([[0], np.cumsum(differs)])[cls] if len(cls) else cls


# ---- packed rows between the steps -------------------------------------------------------------

@lru_cache(maxsize=1)
def codecs() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(p) for p in parts], dtype="<u4").tobytes()
    return codecs()[0].compress(bytes([len(parts)]) + head + b"".join(parts))


def unpack(blob: bytes) -> list[bytes]:
    data = codecs()[1].decompress(blob)
    sizes, at, out = np.frombuffer(data, "<u4", data[0], 1), 1 + 4 * data[0], []
    for size in sizes.tolist():
        out.append(data[at:at + size])
        at += size
    return out


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    """The unpacked blobs of one bucket at a time, from rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(unpack(blob))
    if held:
        yield held


def blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                      names=["bucket", "blob"])


def gathered(df: DataFrame, partitions: int) -> DataFrame:
    return df.repartition(partitions, "bucket").sortWithinPartitions("bucket")


def anchor_blobs(batches: Iterator[pa.RecordBatch], width: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors by bucket of their hash. Of an anchor found several times in a slice, one goes there, marked; the others need no answer."""
    for part in slices(batches, limit=SLICE):
        texts = [t.encode() for t in part.column("text").to_pylist()]
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        doc, place, first, last, h = anchors(np.frombuffer(b"".join(texts), np.uint8), ends, width, gram)
        if not len(doc):
            continue
        key = np.array(part.column("k1").to_pylist(), dtype=np.int64)[doc]
        packed = (place - starts[doc]) << 16 | (place - first) << 8 | (place - last)
        order = np.argsort(h, kind="stable")
        h, key, packed = h[order], key[order], packed[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        many = np.concatenate([h[1:] == h[:-1], [False]]) & new
        bucket, rows = (h[new] % np.uint64(buckets)).astype(np.int64), []
        firsts, repeated = np.flatnonzero(new), np.flatnonzero(~new)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            at = firsts[order[bounds[b]:bounds[b + 1]]]
            own = repeated[b::buckets]                                # known to repeat: carried along by any bucket
            if len(at) or len(own):
                at = at[np.argsort(key[at], kind="stable")]
                rows.append((b, pack(h[at] >> np.uint64(8), key[at], packed[at], many[at], key[own], packed[own])))
        yield blobs(rows)


def repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in by_bucket(batches):
        h, key, packed, many, key2, packed2 = (np.frombuffer(b"".join(x[i] for x in held), kind) for i, kind in
                                               enumerate((np.uint64, np.int64, np.int64, np.bool_, np.int64, np.int64)))
        order = np.argsort(h)
        s = h[order]
        same = s[1:] == s[:-1]
        hit = many.copy()
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[hit], key2])), pa.array(np.concatenate([packed[hit], packed2]))],
                                         names=["k1", "anchor"])


def anchor_counts(batches: Iterator[pa.RecordBatch], width: int, gram: int, least: int) -> Iterator[pa.RecordBatch]:
    """How often a task meets each anchor, if `least` times or more. Of very many anchors those met once are let go on the way."""
    found, times = np.empty(0, np.uint64), np.empty(0, np.int64)
    held: list[np.ndarray] = []

    def added() -> tuple[np.ndarray, np.ndarray]:
        h, of = np.unique(np.concatenate([found, *held]), return_inverse=True)
        n = np.bincount(of[len(found):], minlength=len(h))
        n[of[:len(found)]] += times
        return h, n

    for part in slices(batches, limit=SLICE):
        texts = [t.encode() for t in part.column("text").to_pylist()]
        held.append(anchors(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), width, gram)[-1])
        if sum(map(len, held)) > 1 << 20:
            found, times = added()
            held = []
            if len(found) > 1 << 20:
                found, times = found[times > 1], times[times > 1]
    found, times = added()
    often = times >= least
    yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often])], names=["h", "n"])


class HotAnchors:
    """A filter over hashes of 2^bits places: one that was put in is always found, others by chance. Its size is the same for any corpus."""

    def __init__(self, places: np.ndarray, bits: int = FILTER_BITS):
        self.shift, self.held = 64 - bits, np.zeros(1 << bits, bool)
        self.held[places] = True
        self.any = bool(len(places))

    def __bool__(self) -> bool:
        return self.any

    def __contains__(self, h: int) -> bool:
        return bool(self.held[h >> self.shift])


def hot_anchors(docs: DataFrame, width: int, gram: int, hot: int) -> HotAnchors:
    """Anchors met about `hot` times or more, as a filter: the driver receives places in it, at most 2^FILTER_BITS however many rows there are.

    A task leaves out counts below LEAST, so an anchor thinly spread over all tasks may be met up to LEAST times a task more often before it
    is listed. The filter only says how strings are dealt: the result is the same with any, and an anchor found in it by chance costs a few more rows.
    """
    least = min(LEAST, hot)
    rows = docs.select("text").mapInArrow(lambda it: anchor_counts(it, width, gram, least), "h long, n long") \
        .groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot)
    places = rows.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int").alias("place")).distinct().collect()
    return HotAnchors(np.array([r.place for r in places], dtype=np.int64))


def starts_of(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of one start each, in order, joined where they follow one another."""
    out: list[tuple[int, int, int, int]] = []
    for k1, k2, start, n in runs:
        if out and out[-1][:2] == (k1, k2) and out[-1][2] + out[-1][3] == start:
            out[-1] = (k1, k2, out[-1][2], out[-1][3] + n)
        else:
            out.append((k1, k2, start, n))
    return out


def context_blobs(batches: Iterator[pa.RecordBatch], width: int, gram: int, buckets: int, hot: HotAnchors | frozenset[int] = frozenset()) -> Iterator[pa.RecordBatch]:
    """Text around each anchor that repeats, by bucket of the anchor. Of equal contexts in a slice the first one goes there; all strings of the
    others start earlier too, which is carried along. Around a hot anchor each string goes out by itself, as a digest of 128 bits and by bucket
    of it, again once a slice; so equal strings meet, but the places of one anchor are spread over all buckets."""
    for part in slices(batches, limit=4 * SLICE):
        columns, seen = [part.column(c).to_pylist() for c in ("k1", "k2", "text", "anchors")], {}
        groups, single, known, strings = defaultdict(list), defaultdict(list), [], {}
        for k1, k2, text, found in sorted(zip(*columns), key=lambda r: r[:2]):
            data = text.encode()
            for packed in sorted(set(found)):
                place, first = packed >> 16, (packed >> 16) - (packed >> 8 & 255)
                count = (packed >> 8 & 255) - (packed & 255) + 1
                context = data[first:first + count - 1 + width]
                if len(context) < count - 1 + width:
                    continue                                          # of another text under the same doc_id
                if context in seen:
                    if seen[context] != (k1, k2, first):              # else it meets itself: the row is listed twice
                        known.append((k1, k2, first, count))
                    continue
                seen[context] = (k1, k2, first)
                if hot and int(gram_hashes(np.frombuffer(data, np.uint8, gram, place), gram)[0]) in hot:
                    again = []
                    for start in range(first, first + count):
                        digest = hashlib.blake2b(data[start:start + width], digest_size=16).digest()
                        lead = strings.setdefault(digest, (k1, k2, start))
                        if lead != (k1, k2, start):
                            again.append((k1, k2, start, 1))
                        else:
                            single[int.from_bytes(digest[:8], "little") % buckets].append((k1, k2, start, digest))
                    known += starts_of(again)
                    continue
                groups[xxhash.xxh3_64_intdigest(data[place:place + gram]) % buckets].append((k1, k2, first, count, context))
        rows, names = [], list(groups.keys() | single.keys()) or [0]
        for j, bucket in enumerate(names):
            own = known[j::len(names)]
            columns = list(zip(*groups[bucket])) or [[]] * 5
            carried, alone = list(zip(*own)) or [[]] * 4, list(zip(*single[bucket])) or [[]] * 4
            rows.append((bucket, pack(*(np.array(columns[i], np.int64) for i in range(4)), b"".join(columns[4]),
                                      *(np.array(c, np.int64) for c in carried), *(np.array(alone[i], np.int64) for i in range(3)), b"".join(alone[3]))))
        if groups or single or known:
            yield blobs(rows)


def repeated_singles(held: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of one start, of the strings around hot anchors in a bucket that start earlier, too."""
    k1, k2, start = (np.frombuffer(b"".join(x[i] for x in held), np.int64) for i in range(9, 12))
    high, low = np.frombuffer(b"".join(x[12] for x in held), np.uint64).reshape(-1, 2).T
    if not len(k1):
        return [k1, k2, start, start]
    order = np.lexsort((start, k2, k1, low, high))
    high, low, k1, k2, start = (x[order] for x in (high, low, k1, k2, start))
    lead = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    of = np.repeat(lead, np.diff(np.append(lead, len(k1))))
    later = (k1 != k1[of]) | (k2 != k2[of]) | (start != start[of])
    return [k1[later], k2[later], start[later], np.ones(int(later.sum()), np.int64)]


def repeated_runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Runs of starts at which a string begins that also starts earlier, from the sorted suffixes of one bucket after the other."""
    for held in by_bucket(batches):
        k1, k2, first, count = (np.frombuffer(b"".join(x[i] for x in held), np.int64) for i in range(4))
        text = b"".join(x[4] for x in held)
        out = [np.frombuffer(b"".join(x[i] for x in held), np.int64) for i in range(5, 9)]
        if len(k1):
            # of equal contexts the first is sorted; all strings of the others start earlier, in it
            ends, lead, again, order = np.cumsum(count - 1 + width).tolist(), {}, [], np.lexsort((first, k2, k1)).tolist()
            begins = [0, *ends]
            for i in order:
                if lead.setdefault(text[begins[i]:ends[i]], i) != i:
                    again.append(i)
            keep = np.array(list(lead.values()), dtype=np.int64)
            buf = np.frombuffer(b"".join(lead), np.uint8)
            of = np.array([lead[text[begins[i]:ends[i]]] for i in again], dtype=np.int64)
            again = np.array(again, dtype=np.int64)
            later = (k1[again] != k1[of]) | (k2[again] != k2[of]) | (first[again] != first[of])
            out = [np.concatenate([x, a[again[later]]]) for x, a in zip(out, (k1, k2, first, count))]
            k1, k2, first, count = k1[keep], k2[keep], first[keep], count[keep]
            begin = np.cumsum(count - 1 + width) - (count - 1 + width)
            context = np.repeat(np.arange(len(k1)), count)
            offset = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
            cls, start = classes_of(buf, begin[context] + offset, width), first[context] + offset
            shared = np.flatnonzero(np.bincount(cls)[cls] > 1)
            order = shared[np.lexsort((start[shared], k2[context[shared]], k1[context[shared]], cls[shared]))]
            c, a, b, s = cls[order], k1[context[order]], k2[context[order]], start[order]
            lead = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
            of = np.repeat(lead, np.diff(np.append(lead, len(c))))
            later = np.sort(order[(a != a[of]) | (b != b[of]) | (s != s[of])])
            if len(later):
                new = np.flatnonzero(np.concatenate([[True], (np.diff(later) != 1) | (context[later][1:] != context[later][:-1])]))
                runs = np.diff(np.append(new, len(later)))
                at = later[new]
                out = [np.concatenate(x) for x in zip(out, (k1[context[at]], k2[context[at]], start[at], runs))]
        out = [np.concatenate(x) for x in zip(out, repeated_singles(held))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["k1", "k2", "start", "n"])


def repeated_strings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Every row of docs (doc_id, k1, k2, text, perhaps rest) with its runs: starts of `width`-byte strings that also start earlier (null: none).

    1. Each string of `width` bytes is led by one anchor, the place of least hash of `gram` bytes in it; equal strings have equal anchors
       at equal offsets. Anchors are gathered by bucket of their hash (once for each slice of text), and those found twice in the corpus go
       back to their documents: all other strings occur once.
    2. The text around these anchors, again once for each slice, goes to the bucket of its anchor: all copies of a string meet there.
    3. A task sorts one bucket's suffixes at a time. The first (doc_id, start) of each class stays.

    Equal texts around an anchor are summed up within a slice before the shuffle and within a bucket before sorting, so a passage
    found in any share of the rows arrives once a slice and is sorted once. Anchors met about `hot` times or more are counted first: a short
    string with differing neighbours makes a context a place, so each string around it is dealt by itself.
    """
    spark = docs.sparkSession
    ship(spark)
    partitions = parallelism(docs)
    buckets = partitions * BUCKETS_PER_PARTITION
    blob, often = "bucket int, blob binary", hot_anchors(docs, width, gram, hot)
    found = gathered(docs.select("k1", "text").mapInArrow(lambda it: anchor_blobs(it, width, gram, buckets), blob), partitions)
    by_doc = found.mapInArrow(repeated_anchors, "k1 long, anchor long").groupBy("k1").agg(F.collect_list("anchor").alias("anchors"))
    near = docs.join(by_doc, "k1").select(*docs.columns, "anchors")      # the same columns as below, so that they are dealt once
    contexts = gathered(near.mapInArrow(lambda it: context_blobs(it, width, gram, buckets, often), blob), partitions)
    runs = contexts.mapInArrow(lambda it: repeated_runs(it, width), "k1 long, k2 long, start long, n long") \
        .groupBy("k1").agg(F.collect_list(F.struct("k2", "start", "n")).alias("runs"))
    return docs.join(runs, "k1", "left")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, its place in the order (k1; none is first), k2 to tell texts with one doc_id apart, text, further columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # rows without doc_id have keys of their own; never null to Spark, so that no filter keeps both joins by k1 from sharing one shuffle
    own = F.lit(NULL_ID) + F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), own).alias("k1"),
                       F.xxhash64(text).alias("k2"), text.alias("text"), *more)


def kept_bytes(data: bytes, runs: list[dict] | None, k2: int, width: int) -> tuple[bytes, int]:
    """What is left of a text, and the number of maximal removed runs of bytes."""
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    for run in runs or ():
        if run["k2"] == k2:
            edge[run["start"]] += 1
            edge[run["start"] + run["n"] - 1 + width] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return (np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data), spans


def remove_repeats(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """Removes each byte covered by a string of `width` bytes that also starts earlier (smaller doc_id, or earlier in the document).

    One row per document: size, removed bytes, maximal removed runs, digest of what is left. Strings are judged on the whole input texts as UTF-8
    and never cross documents; a null text is empty; a text shorter than `width` loses nothing. A row without doc_id comes before all others;
    texts that share a doc_id are ordered by a hash; a row listed twice is one document and both rows get its result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for k2, text, runs in zip(*(part.column(c).to_pylist() for c in ("k2", "text", "runs"))):
                data = text.encode()
                left, spans = kept_bytes(data, runs, k2, width)
                rows.append((len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_strings(keyed(docs), width, hot=hot).select("doc_id", "k2", "text", "runs") \
        .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs with what is left of their texts, and n_chars, if there is one, counted anew; other columns as they are.

    Bytes of a character that was cut in two go with it, so texts stay valid; a text of which nothing is left is empty, as is a null text.
    Rows without doc_id come before all others; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.withColumns({"rest": F.struct(*(F.col(c) for c in rest))}) if rest else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [kept_bytes(t.encode(), runs, k2, width)[0].decode(errors="ignore")
                     for k2, t, runs in zip(*(part.column(c).to_pylist() for c in ("k2", "text", "runs")))]
            more = [part.column("rest")] if rest else []
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), *more], names=["doc_id", "text", "rest"][:2 + len(more)])

    types = "doc_id long, text string" + (f", rest {packed.schema['rest'].dataType.simpleString()}" if rest else "")
    found = repeated_strings(keyed(packed, *(["rest"] if rest else [])), width)
    out = found.select("doc_id", "k2", "text", "runs", *(["rest"] if rest else [])).mapInArrow(run, types)
    value = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    for c in rest:
        value[c] = F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("rest")[c]
    return out.select(*(value[c].alias(c) for c in docs.columns))
