"""Byte-level BPE encoding and decoding over padded matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stichos.llm.chunks import ChunkTokenizer
from stichos.llm.common import slices, texts_of

NONE = np.iinfo(np.int32).max
WIDEST = 256
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairTable:
    """Rank of the token that two adjacent tokens make, by an open-addressing hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        k, v = np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(k)) * 4))))
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        slot, rest = self._slot(k), np.arange(len(k))
        while len(rest):
            free = self.values[slot[rest]] == NONE
            take, at = np.unique(slot[rest[free]], return_index=True)
            won = rest[free][at]
            self.keys[take], self.values[take] = k[won], v[won]
            rest = rest[~np.isin(rest, won)]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is no token; negative ids are padding."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        real = np.nonzero((left >= 0) & (right >= 0))
        keys = left[real].astype(np.uint64) << np.uint64(32) | right[real].astype(np.uint64)
        slot, found, rest = self._slot(keys), np.full(len(keys), NONE, dtype=np.int32), np.arange(len(keys))
        while len(rest):
            at = slot[rest]
            hit = self.keys[at] == keys[rest]
            found[rest[hit]] = self.values[at[hit]]
            rest = rest[~hit & (self.values[at] != NONE)]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
        out[real] = found
        return out


class Encoder:
    """Encodes pieces of text; a vocabulary file has a base64 token and its rank on each line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs, self.pattern = PairTable(self.ranks), regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.chunks = ChunkTokenizer(self.encode_chunks)

    def encode_matrix(self, pieces: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of pieces; each round merges the leftmost pair of least rank in every row that still has one."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        length = np.array([len(p) for p in pieces], dtype=np.int64)
        for low, high in ((1, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 48), (48, 96), (96, WIDEST)):
            rows = np.flatnonzero((length > low if low > 1 else length >= low) & (length <= high))
            for at in range(0, len(rows), 8192):
                self._merge_rows(rows[at:at + 8192], pieces, length, out)
        for i in np.flatnonzero(length > WIDEST):
            out[i] = self._merge_long(pieces[i])
        return out

    def _merge_rows(self, rows: np.ndarray, pieces: Sequence[bytes], length: np.ndarray, out: list) -> None:
        if not len(rows):
            return
        n = length[rows]
        width = int(n.max())
        ids = np.full((len(rows), width), -1, dtype=np.int32)
        filled = np.arange(width) < n[:, None]
        ids[filled] = self.single[np.frombuffer(b"".join([pieces[i] for i in rows]), dtype=np.uint8)]
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if ids.shape[1] > 1:
                at = rank.argmin(axis=1)
                least = rank[np.arange(len(rows)), at]
                done = least == NONE
            else:
                done = np.ones(len(rows), dtype=bool)
            if done.any():
                for row, left in zip(rows[done], ids[done]):
                    out[row] = left[left >= 0]
                keep = ~done
                rows, ids = rows[keep], ids[keep]
                if not len(rows):
                    return
                rank, at, least = rank[keep], at[keep], least[keep]
            every = np.arange(len(rows))
            ids[every, at] = least
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            if ids.shape[1] < 2:
                continue
            columns = np.arange(ids.shape[1] - 1)
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), axis=1)
            for shift in (-1, 0):
                where = np.flatnonzero((at + shift >= 0) & (at + shift < rank.shape[1]))
                rank[where, at[where] + shift] = self.pairs(ids[where, at[where] + shift], ids[where, at[where] + shift + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order for one very long piece: a row of its own would be merged once a round."""
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        first = self.pairs(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        bytes_of, ranks = self.token, self.ranks
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n and (r := ranks.get(bytes_of[ids[a]] + bytes_of[ids[b]])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return np.array([x for x, ok in zip(ids, alive) if ok], dtype=np.int32)

    def encode_chunks(self, chunks: Sequence[str], whole: bool) -> list[bytes]:
        """Packed ids (unsigned, 32 bits, little-endian) of texts, each split by the pattern."""
        split = [self.pattern.findall(c) for c in chunks]
        rest, seen = [], {}
        for piece in {p for pieces in split for p in pieces}:
            rank = self.ranks.get(piece.encode())
            if rank is None:
                rest.append(piece)
            else:
                seen[piece] = rank.to_bytes(4, "little")
        for piece, ids in zip(rest, self.encode_matrix([p.encode() for p in rest])):
            seen[piece] = ids.astype("<u4").tobytes()
        return [b"".join([seen[p] for p in pieces]) for pieces in split]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        return self.chunks(texts)

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary in a worker."""
    return Encoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count and digests of the ids and of the bytes that the ids decode to, one row per document.

    A narrow pass: nothing is shuffled. A null or empty text has no ids (the digests are those of no bytes); rows with
    the same doc_id, or none, are each encoded; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for part in slices(batches):
            ids = enc.encode(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                 pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids themselves, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for part in slices(batches):
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in enc.encode(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")
