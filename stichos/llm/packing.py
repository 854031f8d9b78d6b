"""Packing documents into token windows with lexically similar neighbours."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stichos.llm.chunks import ChunkTokenizer
from stichos.llm.common import slices, texts_of

WINDOW = 1024
SHARD_BYTES, SHARD_ROWS = 1 << 20, 512
K1, B = 1.2, 0.75
DENSE, CHUNKS = 16, 700_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Tokens and ids of a byte-level tokenizer file, if its ids are the order of its merges (None if not)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]      # bytes written as themselves; the others follow from 256 on
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocabulary, size = model["vocab"], len(letters)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocabulary.get(a + b) != size + i for i, (a, b) in enumerate(merges)) or any(vocabulary.get(c, size) >= size for c in letters):
        return None
    return {bytes(letters[c] for c in token): rank for token, rank in vocabulary.items() if rank < size + len(merges)}


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str, pattern: str) -> ChunkTokenizer:
    """Ids as the tokenizer file gives them. Where its ids are the order of its merges, unseen chunks are merged by rank, which
    gives the same ids faster; chunks with an added token go to the tokenizer itself, as do all if the ids are no ranks."""
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"                    # Spark runs a task on each core
    tokenizer, ranks = Tokenizer.from_file(path), merge_ranks(path)
    merged = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def packed(text: str) -> np.ndarray:
        if merged is None or "<|" in text:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(merged.encode_ordinary(text), dtype="<u4")

    feed = int(packed("\n")[0])

    def encode(chunks: Sequence[str], whole: bool) -> list[bytes]:
        """Chunks are encoded as the lines of longer texts and told apart by its line feeds; those with an added token, and whole texts, alone."""
        if whole:
            return [packed(c).tobytes() for c in chunks]
        out: list[bytes] = []
        for at in range(0, len(chunks), 500):
            part = chunks[at:at + 500]
            line = "\n".join(part)
            if "<|" in line or line.count("\n") >= 500:
                out += [packed(c).tobytes() for c in part]
                continue
            ids = packed(line)
            text, start = ids.tobytes(), 0
            for end in [*np.flatnonzero(ids == feed).tolist(), len(ids)]:
                out.append(text[4 * start:4 * end])
                start = end + 1
        return out

    return ChunkTokenizer(encode, CHUNKS)


def bm25(documents: Sequence[np.ndarray], k1: float = K1, b: float = B) -> np.ndarray:
    """Scores of every document of a shard for every document as query, from the shard's inverted index.

    Terms are token ids. Postings of common terms are multiplied as columns of a matrix; those of the others are paired term by term.
    """
    n = len(documents)
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    scores = np.zeros((n, n), dtype=np.float32)
    if not lengths.sum():
        return scores
    key, tf = np.unique(np.concatenate(documents).astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
    _, term, df = np.unique(key // n, return_inverse=True, return_counts=True)
    doc = key % n
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    weight = (idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / lengths.mean()))).astype(np.float32)
    common = np.flatnonzero(df > DENSE)
    for at in range(0, len(common), 2048):
        column = np.full(len(df), -1)
        column[common[at:at + 2048]] = np.arange(len(common[at:at + 2048]))
        here = column[term] >= 0
        has = np.zeros((n, min(2048, len(common) - at)), dtype=np.float32)
        worth = has.copy()
        has[doc[here], column[term[here]]] = 1
        worth[doc[here], column[term[here]]] = weight[here]
        scores += has @ worth.T
    first, cells, values = np.concatenate([[0], np.cumsum(df)])[:-1], [], []
    for size in range(2, DENSE + 1):
        at = first[df == size]
        if len(at):
            posting = at[:, None] + np.arange(size)
            cells.append((doc[posting][:, :, None] * n + doc[posting][:, None, :]).ravel())
            values.append(np.broadcast_to(weight[posting][:, None, :], (len(at), size, size)).ravel())
    if cells:
        scores += np.bincount(np.concatenate(cells), np.concatenate(values), n * n).reshape(n, n).astype(np.float32)
    return scores


class Windows:
    """The open window of a partition, its number and what is filled."""

    def __init__(self, size: int, base: int):
        self.size, self.base, self.number, self.filled = size, base, 0, 0
        self.out: list[tuple] = []

    def put(self, doc_id: int | None, ids: bytes, total: int) -> None:
        start = 0
        while start < total:
            length = min(self.size - self.filled, total - start)
            crc = zlib.crc32(memoryview(ids)[4 * start:4 * (start + length)])
            self.out.append((doc_id, start, length, crc, total, self.base + self.number, self.filled))
            start, self.filled = start + length, self.filled + length
            if self.filled == self.size:
                self.number, self.filled = self.number + 1, 0


def order_by_neighbours(scores: np.ndarray, tokens: Sequence[int], window: int, filled: int) -> list[int]:
    """Order in which windows take the documents: a seed, then its best unused neighbours until the window is full.

    The document that reaches the end of a window is cut there and is the next seed. Ties go to the earlier document.
    """
    free = np.ones(len(tokens), dtype=bool)
    order: list[int] = []
    following, seed, left = 0, -1, window - filled
    while len(order) < len(tokens):
        if seed < 0:
            while not free[following]:
                following += 1
            ranked = iter([following])
        else:
            near = np.flatnonzero(free)
            ranked = iter(near[np.argsort(-scores[seed][near], kind="stable")].tolist())
        for i in ranked:
            free[i] = False
            order.append(i)
            over = tokens[i] >= left
            left = left - tokens[i] if not over else window - (tokens[i] - left) % window
            if over or seed < 0:
                seed = i
                break
    return order


def pack_documents(docs: DataFrame, path: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """Pieces of documents in sequences of `window` tokens; each document's ids end with id 0. `pattern` is that of the tokenizer file at `path`.

    Texts are dealt by range of a hash of their least line hash, so that likely neighbours (near copies share it with a chance that grows
    with their share of equal lines) come into one shard, and by doc_id, so that one hash may hold any share of the rows. A partition is worked
    through in shards of bounded bytes and rows, each with its own inverted index: the seed's unused neighbours fill its window
    in the order of their BM25 scores; the last is cut at the end of the window and its rest seeds the next one. Only the last
    sequence of a partition may be padded. Terms of the index are token ids.

    A null or empty text has the id 0 alone; rows with the same doc_id, or none, are packed as documents of their own.
    """
    d = texts_of(docs).withColumn("_key", F.xxhash64(F.array_min(F.transform(F.split("text", "\n"), lambda w: F.xxhash64(w)))))
    dealt = d.repartitionByRange("_key", "doc_id").sortWithinPartitions("_key", "doc_id", F.length("text"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = chunk_tokenizer(path, pattern), TaskContext.get()
        windows = Windows(window, (context.partitionId() if context else 0) << 32)
        for part in slices(batches, limit=SHARD_BYTES):
            for at in range(0, part.num_rows, SHARD_ROWS):
                shard = part.slice(at, SHARD_ROWS)
                texts, doc_ids = shard.column("text").to_pylist(), shard.column("doc_id").to_pylist()
                ids = [x + bytes(4) for x in encode(texts)]
                tokens = [len(x) // 4 for x in ids]
                for i in order_by_neighbours(bm25([np.frombuffer(x, dtype="<u4") for x in ids]), tokens, window, windows.filled):
                    windows.put(doc_ids[i], ids[i], tokens[i])
                columns = list(zip(*windows.out))
                windows.out = []
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return dealt.select("doc_id", "text").mapInArrow(run, SCHEMA)
