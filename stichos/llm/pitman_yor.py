"""Language-model scores from a hierarchical Pitman-Yor model of words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stichos.llm.common import cut, held_out, parallelism, slices, texts_of
from stichos.llm.suffix_dedup import pack, unpack

CONTEXT_BITS, SAMPLES, STRENGTH, SEED = 15, 2, 1.0, 17
CONTEXTS = 1 << CONTEXT_BITS                                          # with the mark of a row to learn from, a context takes 16 bits
EXACT_CUSTOMERS, MOST_CUSTOMERS, SPARE, CELLS = 64, 1024, 16, 1 << 20
ROWS, BUCKETS_PER_PARTITION = 50_000, 4
HOT_SHARE, HOT_LEAST, SALTS = 1024, 512, 16                           # a token is hot in a slice with 1/HOT_SHARE of its tokens, and HOT_LEAST
PAIRS, COUNTS, HOT = 0, 1, 2                                          # kinds of blobs: occurrences, counts of hot tokens, occurrences of hot tokens
HELD_PAIRS = 1 << 20
HELD_SUMS = 2_000_000                                                 # sums by document that a task adds up over buckets before it sends them
SUMS = (np.float64, np.float64, np.uint32)                            # partial sums of a document: score, base score, known tokens
END, START = 0x5E5E5E5E5E5E5E5E, 0x1717171717171717
M1 = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def tokens_of(texts: list[str], known: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts one after another (A-Z lower-cased, then one end each), contexts, tokens of each text.

    The context of a token is the hash of the one before (or of the start) folded to CONTEXTS restaurants.
    """
    parts, count = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        count[i] = len(words) + 1
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        parts.append(np.array([END], np.uint64))
    token = np.concatenate(parts)
    before = np.concatenate([[np.uint64(START)], token[:-1]])
    before[np.cumsum(count) - count] = START
    return token, ((before * M1) >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64), count


def hot_bucket(token: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    """Where the occurrences of a hot token in the slices of one salt go."""
    return (((token ^ np.uint64((1 + salt) * int(M1) % (1 << 64))) * M1 >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def occurrence_blobs(batches: Iterator[pa.RecordBatch], buckets: int, share: int = HOT_SHARE, least: int = HOT_LEAST) -> Iterator[pa.RecordBatch]:
    """For each slice of text, its occurrences by bucket of the token (context, whether to learn from it, document), and under a negative bucket
    the table of its documents. Tokens of a slice are sent once each, however often they occur in it.

    Of tokens that are hot in the slice the bucket gets counts by context; their occurrences are dealt by token and salt of the slice.
    """
    known, base, number = Hashes(), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
    for batch in slices(batches):
        for at in range(0, batch.num_rows, ROWS):
            part, rows = batch.slice(at, ROWS), []
            token, context, count = tokens_of(part.column("text").to_pylist(), known)
            train = ~np.array(part.column("held_out").to_pylist(), dtype=bool)
            doc = np.repeat(np.arange(len(count)), count)
            order = np.argsort(token, kind="stable")
            token, mark, doc = token[order], (context | train[doc].astype(np.int64) << CONTEXT_BITS).astype(np.uint16)[order], doc[order].astype(np.uint16)
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            unique, times = token[first], np.diff(np.append(first, len(token)))
            hot = times >= max(least, len(token) / share)
            if hot.any():
                at, of = np.repeat(hot, times), np.repeat(np.cumsum(hot) - 1, times)
                pair, inverse = np.unique(of[at] * CONTEXTS + (mark[at] & CONTEXTS - 1), return_inverse=True)
                learned = np.bincount(inverse, mark[at] >> CONTEXT_BITS, len(pair)).astype(np.uint32)
                key, before = unique[hot][pair // CONTEXTS], (pair % CONTEXTS).astype(np.uint16)
                home = (key % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(home).tolist():
                    rows.append((b, COUNTS, pack(key[home == b], before[home == b], learned[home == b])))
            salted = hot_bucket(unique, ((base >> 32) + number) % SALTS, buckets)
            for kind, which in ((PAIRS, ~hot), (HOT, hot)):
                chosen = np.flatnonzero(which)
                bucket = ((unique % np.uint64(buckets)).astype(np.int64) if kind == PAIRS else salted)[chosen]
                by = np.argsort(bucket, kind="stable")
                place = np.flatnonzero(np.repeat(which, times))
                each = place[np.argsort(np.repeat(bucket, times[chosen]), kind="stable")]
                bounds = np.searchsorted(bucket[by], np.arange(buckets + 1))
                ends = np.concatenate([[0], np.cumsum(times[chosen][by])])[bounds]
                for b in np.flatnonzero(np.diff(bounds)).tolist():
                    u, o = chosen[by[bounds[b]:bounds[b + 1]]], each[ends[b]:ends[b + 1]]
                    rows.append((b, kind, pack(unique[u], times[u].astype(np.uint32), mark[o], doc[o])))
            ids = part.column("doc_id")
            valid = np.array(ids.is_valid().to_pylist(), dtype=bool)
            rows.append((-1 - (base + number) % buckets, PAIRS, pack(np.array(ids.fill_null(0).to_pylist(), np.int64), valid, train, count)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([base + number] * len(rows), pa.int64()),
                                              pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                                             names=["bucket", "slice", "kind", "blob"])
            number += 1


@lru_cache(maxsize=4)
def log_stirling(n: int, discount: float) -> np.ndarray:
    """Logarithms of the weights S(c, t) of all ways to seat c customers of one dish at t tables, c and t up to n: a table of k customers weighs
    (1 - discount) (2 - discount) ... (k - 1 - discount)."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(n):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = out[c, 1:c + 2] + np.log(np.maximum(c - t * discount, 0))
        out[c + 1, 1:c + 2] = np.logaddexp(out[c, :c + 1], stay)
    return out


def seat(customers: np.ndarray, others: np.ndarray, chance: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn given all other dishes: its customers leave their restaurant and are seated again together.

    `others` are the tables of the restaurant's other dishes, `chance` is the probability of the dish at a new table. t tables weigh
    S(c, t) chance^t (STRENGTH + discount others) (STRENGTH + discount (others + 1)) ... (t factors), and the draw is from these weights. Where customers are
    many (over EXACT_CUSTOMERS, and over SPARE for each table expected; always over MOST_CUSTOMERS), the weights no longer depend on their
    number: t - 1 is then negative binomial, with STRENGTH / discount + others + 1 successes of probability 1 - chance.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    chance = np.minimum(chance, 1 - 1e-9)
    successes = STRENGTH / discount + others + 1
    many = (customers > EXACT_CUSTOMERS) & ((SPARE * (1 + successes * chance / (1 - chance)) < customers) | (customers > MOST_CUSTOMERS))
    tables[many] = np.minimum(1 + rng.negative_binomial(successes[many], 1 - chance[many]), customers[many])
    rest = np.flatnonzero((customers > 1) & ~many)
    rest = rest[np.argsort(customers[rest], kind="stable")]
    sizes, starts = np.unique(customers[rest], return_index=True)
    if not len(sizes):
        return tables
    weights = log_stirling(EXACT_CUSTOMERS if sizes[-1] <= EXACT_CUSTOMERS else MOST_CUSTOMERS, discount)
    for c, low, high in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(rest)]):
        rows = max(1, CELLS // c)
        for at in range(low, high, rows):
            pick = rest[at:min(high, at + rows)]
            steps = np.log(STRENGTH + discount * (others[pick][:, None] + np.arange(c))) + np.log(chance[pick])[:, None]
            tables[pick] = (np.cumsum(steps, axis=1) + weights[c, 1:c + 1] + rng.gumbel(size=steps.shape)).argmax(axis=1) + 1
    return tables


@dataclass
class Totals:
    """What all buckets share: restaurants' customers and tables, the root's, and the sizes of the corpus."""

    n_tokens: int = 0
    n_types: int = 0
    discount: float = 0.5
    root_discount: float = 0.5
    customers: np.ndarray = field(default_factory=lambda: np.zeros(CONTEXTS))
    tables: list[np.ndarray] = field(default_factory=list)            # by context, after each sweep
    root: list[tuple[float, float]] = field(default_factory=list)     # customers and tables of the root after each sweep


def occurrences(blob: bytes | list[bytes]) -> tuple[np.ndarray, ...]:
    """Tokens, contexts, whether to learn from it and documents of the occurrences in a blob, or in its parts."""
    parts = unpack(blob) if isinstance(blob, bytes) else blob
    unique, times, mark, doc = (np.frombuffer(x, k) for x, k in zip(parts, (np.uint64, np.uint32, np.uint16, np.uint16)))
    return np.repeat(unique, times), (mark % CONTEXTS).astype(np.int64), mark >> CONTEXT_BITS, doc.astype(np.int64)


def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Token, context, count, hot of each pair once, sorted by token and context."""
    token, context, count, hot = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((context, token))
    token, context, count, hot = (x[order] for x in (token, context, count, hot))
    first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (context[1:] != context[:-1])]))
    return token[first], context[first], np.add.reduceat(count, first), np.logical_or.reduceat(hot, first)


class Bucket:
    """Counts of the pairs of token and context of one bucket; its occurrences, none of a hot token, stay compressed and are read slice by slice."""

    def __init__(self, number: int, slice_ids: list[int], held: list[bytes | list[bytes]], counts: list[bytes] = ()):
        self.number, self.parts = number, list(zip(slice_ids, held))
        sums_, size = [], 0
        for kind, blob in [*((COUNTS, c) for c in counts), *((PAIRS, x) for x in held)]:
            if kind == COUNTS:
                token, context, count = (np.frombuffer(x, k) for x, k in zip(unpack(blob), (np.uint64, np.uint16, np.uint32)))
            else:
                token, context, count, _ = occurrences(blob)
            sums_.append((token, context.astype(np.int64), count.astype(np.int64), np.full(len(token), kind == COUNTS)))
            size += len(token)
            if size > HELD_PAIRS + 2 * len(sums_[0][0]):
                sums_ = [summed(sums_)]
                size = len(sums_[0][0])
        token, self.pair_context, self.count, hot = summed(sums_)
        self.types, self.pair_token = np.unique(token, return_inverse=True)
        self.pair = self.pair_token * CONTEXTS + self.pair_context
        self.hot = np.bincount(self.pair_token, hot, len(self.types)) > 0
        self.token_count = np.bincount(self.pair_token, self.count, len(self.types)).astype(np.int64)

    def first_state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One table for each dish of each restaurant: tables, customers and tables of the root."""
        tables = np.minimum(self.count, 1)
        root = np.bincount(self.pair_token, tables, len(self.token_count)).astype(np.int64)
        return tables, root, np.minimum(root, 1)

    def root_chance(self, root: np.ndarray, root_tables: np.ndarray, t: Totals, sweep: int) -> np.ndarray:
        customers, tables = t.root[sweep]
        return (np.maximum(root - t.root_discount * root_tables, 0)
                + (STRENGTH + t.root_discount * tables) / (t.n_types + 1)) / (STRENGTH + customers)

    def sweep(self, state: tuple[np.ndarray, ...], t: Totals, sweep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One Gibbs sweep: every dish is seated again, given the tables of all others after the sweep before and without its own.

        All dishes move at once, given the same totals, as buckets are worked through apart. The same seed gives the same seats wherever it runs.
        """
        rng = np.random.default_rng([SEED, sweep, self.number])
        tables, root, root_tables = state
        root_customers, all_root_tables = t.root[sweep]
        mine = root[self.pair_token] - tables                          # the dish's customers in the root, without those of this restaurant
        theirs = np.minimum(root_tables[self.pair_token], mine)
        chance = (np.maximum(mine - t.root_discount * theirs, 0) + (STRENGTH + t.root_discount * all_root_tables) / (t.n_types + 1)) \
            / (STRENGTH + root_customers - tables)
        tables = seat(self.count, np.maximum(t.tables[sweep][self.pair_context] - tables, 0), chance, t.discount, rng)
        root = np.bincount(self.pair_token, tables, len(self.token_count)).astype(np.int64)
        uniform = np.full(len(root), 1 / (t.n_types + 1))
        return tables, root, seat(root, np.maximum(all_root_tables - root_tables, 0), uniform, t.root_discount, rng)

    def states(self, t: Totals) -> list[tuple[np.ndarray, ...]]:
        out = [self.first_state()]
        for sweep in range(len(t.tables)):
            out.append(self.sweep(out[-1], t, sweep))
        return out

    def chances(self, state: tuple[np.ndarray, ...], t: Totals, sweep: int) -> np.ndarray:
        """Predictive probability of each pair of token and context."""
        tables, root, root_tables = state
        customers, all_tables = t.customers[self.pair_context], t.tables[sweep][self.pair_context]
        below = self.root_chance(root, root_tables, t, sweep)[self.pair_token]
        return (self.count - t.discount * tables + (STRENGTH + t.discount * all_tables) * below) / (STRENGTH + customers)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    """Bucket after bucket of rows sorted by bucket, each with its slices, kinds and blobs as they come."""
    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("bucket", "slice", "kind", "blob"))))
    for bucket, group in groupby(rows, key=lambda r: r[0]):
        yield bucket, (r[1:] for r in group)


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    for number, group in groups_of(batches):
        slice_ids, held, counts = [], [], []
        for slice_id, kind, blob in group:
            if kind == COUNTS:
                counts.append(blob)
            else:
                slice_ids.append(slice_id)
                held.append(blob)
        yield Bucket(number, slice_ids, held, counts)


def sums(parts: DataFrame, t: Totals | None) -> dict[int, tuple[float, float]]:
    """Totals over all buckets after the last sweep: by context (customers, tables); under -1 the root's; without t also corpus sizes under -2 to -4.

    At most CONTEXTS + 4 rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers, tables, more = np.zeros(CONTEXTS), np.zeros(CONTEXTS), {k: np.zeros(2) for k in (-1, -2, -3, -4)}
        for b in buckets_of(batches):
            state = (b.states(t) if t else [b.first_state()])[-1]
            customers += np.bincount(b.pair_context, b.count, CONTEXTS)
            tables += np.bincount(b.pair_context, state[0], CONTEXTS)
            more[-1] += state[1].sum(), state[2].sum()
            more[-2] += b.token_count.sum(), (b.token_count > 0).sum()
            more[-3] += (b.count == 1).sum(), (b.count == 2).sum()
            more[-4] += (state[1] == 1).sum(), (state[1] == 2).sum()
        key = [*range(CONTEXTS), *more]
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array([*customers, *(m[0] for m in more.values())]),
                                          pa.array([*tables, *(m[1] for m in more.values())])], names=["key", "a", "b"])

    rows = parts.mapInArrow(run, "key int, a double, b double").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    return {r.key: (r.a, r.b) for r in rows}


def learn(parts: DataFrame, samples: int) -> Totals:
    """Counts of the corpus, then one pass for each Gibbs sweep; discounts from the numbers of dishes with one and two customers."""
    got, t = sums(parts, None), Totals()
    pair = lambda k: got.get(k, (0.0, 0.0))
    by_context = lambda j: np.array([pair(k)[j] for k in range(CONTEXTS)])
    discount = lambda once, twice: float(np.clip(once / max(once + 2 * twice, 1), 0.05, 0.95))
    t.n_tokens, t.n_types = int(pair(-2)[0]), int(pair(-2)[1])
    t.discount, t.root_discount = discount(*pair(-3)), discount(*pair(-4))
    t.customers = by_context(0)
    for sweep in range(samples + 1):
        if sweep:
            got = sums(parts, t)
        t.tables.append(by_context(1))
        t.root.append(pair(-1))
    return t


def score_documents(docs: DataFrame, samples: int = SAMPLES, share: int = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """Log probabilities (base 10) of every document under the model and under smoothed token counts, one row per document.

    Learned from all documents that are not held out. Restaurants of contexts (the token before, folded by a hash to CONTEXTS restaurants) share the
    restaurant of all tokens as their parent, whose own base is uniform over the known tokens and one for all unknown ones. Occurrences are gathered
    by token, so the seats of a token and its tables in the parent are drawn in one task; only the restaurants' totals (bounded by CONTEXTS) are
    shared, from sweep to sweep. Of a token that is hot in a slice only counts by context are gathered, which seating needs; its occurrences are dealt by
    token and SALTS, and the probabilities of its pairs are sent to each of them. The score averages the predictive probabilities of `samples` sweeps.

    A null or empty text is its end token alone. Rows with the same doc_id, or none, are each scored (a row without doc_id is learned from); other columns
    are not read. Without documents to learn from every token has the probability of the one unknown token.
    """
    partitions = parallelism(docs)
    buckets = partitions * BUCKETS_PER_PARTITION
    given = texts_of(docs).withColumn("held_out", held_out(5, 1))
    schema = "bucket int, slice long, kind int, blob binary"
    dealt = given.mapInArrow(lambda it: occurrence_blobs(it, buckets, share, least), schema).repartition(partitions, "bucket") \
        .sortWithinPartitions("bucket", "slice", "kind")
    table = cut(dealt, one_group=True)                                # a bucket stays in one file, a file in one task
    parts, hot = table.filter(f"bucket >= 0 and kind <> {HOT}"), table.filter(f"bucket >= 0 and kind = {HOT}")
    t = learn(parts, samples)
    used = range(1, samples + 1)

    def chances_of(b: Bucket, before: Totals) -> tuple[np.ndarray, np.ndarray]:
        states = b.states(before)
        chance = np.log10(sum(b.chances(states[s], t, s) for s in used) / len(used))
        return chance, np.log10((b.token_count + 0.5) / (t.n_tokens + 0.5 * (t.n_types + 1)))

    class Sent:
        """Sums by slice and document, sent whenever there are many."""

        def __init__(self):
            self.held, self.entries = defaultdict(list), 0

        def add(self, slice_id: int, doc: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
            place, of = np.unique(doc, return_inverse=True)
            self.held[slice_id].append((place.astype(np.uint16), *(np.bincount(of, w, len(place)) for w in values)))
            self.entries += len(place)
            if self.entries > HELD_SUMS:
                yield from self.flush()

        def flush(self) -> Iterator[pa.RecordBatch]:
            rows = []
            for slice_id, parts in self.held.items():
                doc, *columns = (np.concatenate(c) for c in zip(*parts))
                doc, of = np.unique(doc, return_inverse=True)
                rows.append((0, slice_id, 1, pack(doc, *(np.bincount(of, c, len(doc)).astype(k) for c, k in zip(columns, SUMS)))))
            self.held.clear()
            self.entries = 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                                          names=["bucket", "slice", "kind", "blob"])

    def hot_chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the occurrences of hot tokens need, for each salt (before them, as kind COUNTS)."""
        before = Totals(t.n_tokens, t.n_types, t.discount, t.root_discount, t.customers, t.tables[:-1], t.root[:-1])
        for b in buckets_of(batches):
            if not b.hot.any():
                continue
            chance, plain = chances_of(b, before)
            of = b.pair_token
            for salt in range(SALTS):
                to = np.where(b.hot, hot_bucket(b.types, salt, buckets), -1)
                for bucket in np.unique(to[b.hot]).tolist():
                    at = np.flatnonzero(to[of] == bucket)
                    yield batch_of([(bucket, -1, COUNTS, pack(b.types[of[at]], b.pair_context[at].astype(np.uint16), chance[at], plain[of[at]], b.token_count[of[at]] > 0))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, sent = Totals(t.n_tokens, t.n_types, t.discount, t.root_discount, t.customers, t.tables[:-1], t.root[:-1]), Sent()
        for b in buckets_of(batches):
            chance, plain = chances_of(b, before)
            for slice_id, blob in b.parts:
                token, context, _, doc = occurrences(blob)
                token = np.searchsorted(b.types, token)
                at = np.searchsorted(b.pair, token * CONTEXTS + context)
                yield from sent.add(slice_id, doc, chance[at], plain[token], b.token_count[token] > 0)
        yield from sent.flush()

    def score_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent()
        for _, group in groups_of(batches):
            given_, table_ = [], None
            for slice_id, kind, blob in group:
                if kind == COUNTS:
                    given_.append([np.frombuffer(x, k) for x, k in zip(unpack(blob), (np.uint64, np.uint16, np.float64, np.float64, np.bool_))])
                    continue
                if table_ is None:
                    key, pair_context, *values = (np.concatenate(c) for c in zip(*given_))
                    types, of = np.unique(key, return_inverse=True)
                    # a token of this bucket under two salts comes twice, with the same values
                    pair, first = np.unique(of * CONTEXTS + pair_context, return_index=True)
                    table_ = [v[first] for v in values]
                token, context, _, doc = occurrences(blob)
                at = np.searchsorted(pair, np.searchsorted(types, token) * CONTEXTS + context)
                yield from sent.add(slice_id, doc, *(v[at] for v in table_))
        yield from sent.flush()

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, total = None, None

        def result() -> pa.RecordBatch:
            ids, valid, train, count = (np.frombuffer(x, k) for x, k in zip(table_, (np.int64, np.bool_, np.bool_, np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=~valid), pa.array(~train), pa.array(count), pa.array(total[2].astype(np.int64)),
                                               pa.array(np.full(len(ids), t.n_tokens)), pa.array(total[1]), pa.array(total[0])], names=names)

        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
                if kind == 0:
                    if table_ is not None:
                        yield result()
                    table_ = unpack(blob)
                    total = np.zeros((3, len(table_[1])))
                else:
                    doc, *columns = (np.frombuffer(x, k) for x, k in zip(unpack(blob), (np.uint16, *SUMS)))
                    for j in range(3):
                        total[j, doc] += columns[j]
        if table_ is not None:
            yield result()

    known = parts.mapInArrow(hot_chances, schema)
    dealt_hot = known.unionByName(hot).repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind", "slice")
    scored = parts.mapInArrow(score, schema).unionByName(dealt_hot.mapInArrow(score_hot, schema)).select("slice", "blob", F.lit(1).alias("kind"))
    tables = table.filter("bucket < 0").select("slice", "blob", F.lit(0).alias("kind"))
    return tables.unionByName(scored).repartition(partitions, "slice").sortWithinPartitions("slice", "kind", F.xxhash64("blob")) \
        .mapInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
