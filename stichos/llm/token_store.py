"""Token ids of a corpus in files that can be searched: a wavelet matrix per shard.

A shard file holds the ids of a run of documents, in ascending order of doc_id, as the bit planes of a wavelet matrix. Planes are cut
into blocks that are compressed one by one; a directory gives the ones before each block. So the id at a place, the count of
an id in a range and the places of an id are all answered from the file, reading only the blocks that they touch.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stichos.llm.common import cut, parallelism, shared_folder, slices, texts_of

MAGIC = b"WMS1"
BLOCK = 1 << 15                                                       # bits
SHARD_TOKENS = 1 << 22
WORDS = 500_000
MANIFEST = "task int, shard int, path string, n_docs long, n_tokens long, before long"


# ---- the wavelet matrix ------------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def _compressor():
    import zstandard
    return zstandard.ZstdCompressor(level=1)


def _packed(data: bytes) -> bytes:
    return _compressor().compress(data)


def _unpacked(data: bytes, size: int) -> bytes:
    import zstandard
    return data if len(data) == size else zstandard.ZstdDecompressor().decompress(data, max_output_size=size)


def write_shard(out: io.IOBase, ids: np.ndarray, doc_ids: Sequence[int | None], lengths: Sequence[int]) -> None:
    """One shard: the ids of documents behind each other, and the ids and lengths of the documents."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    sections, header = [], {"tokens": len(ids), "documents": len(doc_ids), "bits": bits, "block": BLOCK, "planes": []}
    row = np.asarray(ids, dtype=np.uint16 if bits <= 16 else np.uint32)
    for k in reversed(range(bits)):
        plane = (row & row.dtype.type(1 << k)).astype(bool)
        raw = np.packbits(plane, bitorder="little").tobytes()
        blocks = [raw[at:at + BLOCK // 8] for at in range(0, len(raw), BLOCK // 8)]
        ones = np.concatenate([[0], np.cumsum([int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum(dtype=np.int64)) for b in blocks])])
        small = [min(b, _packed(b), key=len) for b in blocks]           # a block of its full size is not compressed
        header["planes"].append({"zeros": int(len(row) - plane.sum())})
        sections += [(header["planes"][-1], "ones", ones.astype("<i8").tobytes(), True),
                     (header["planes"][-1], "ends", np.cumsum([0, *map(len, small)]).astype("<i8").tobytes(), True),
                     (header["planes"][-1], "data", b"".join(small), False)]
        row = np.concatenate([np.compress(~plane, row), np.compress(plane, row)])
    known = np.array([i is not None for i in doc_ids], dtype=np.uint8)
    sections += [(header, "doc_ids", np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes(), True),
                 (header, "known", known.tobytes(), True), (header, "lengths", np.asarray(lengths, dtype="<i8").tobytes(), True)]
    at, parts = 0, []
    for place, name, data, squeeze in sections:
        stored = _packed(data) if squeeze else data
        place[name] = [at, len(stored), len(data)]
        at += len(stored)
        parts.append(stored)
    head = json.dumps(header).encode()
    out.write(MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts))


class _Plane:
    """Rank and select on one bit plane, by blocks of the file."""

    def __init__(self, shard: Shard, place: dict):
        self.zeros, self.n = place["zeros"], shard.n
        self.ones, self.ends = (np.frombuffer(shard.section(place[name]), "<i8") for name in ("ones", "ends"))
        self.at, self.shard = place["data"][0], shard

    def stored(self, first: int, last: int) -> list[bytes]:
        """Bytes of the blocks first ... last - 1, read as one run."""
        ends = self.ends[first:last + 1].tolist()
        data = self.shard.read(self.at + ends[0], ends[-1] - ends[0])
        sizes = [min(BLOCK, self.n - k * BLOCK) + 7 >> 3 for k in range(first, last)]
        return [_unpacked(data[a - ends[0]:b - ends[0]], size) for a, b, size in zip(ends, ends[1:], sizes)]

    def bits(self, first: int, last: int) -> np.ndarray:
        raw = np.frombuffer(b"".join(self.stored(first, last)), np.uint8)
        return np.unpackbits(raw, count=min(last * BLOCK, self.n) - first * BLOCK, bitorder="little")

    def _by_block(self, block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(block, kind="stable")
        keys, at = np.unique(block[order], return_index=True)
        for key, here in zip(keys.tolist(), np.split(order, at[1:])):
            yield key, here

    def look(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each place and the ones before it (a place may be the end, whose bit counts as 0)."""
        if 4 * len(places) >= self.n and self.n:
            bits = np.append(self.bits(0, len(self.ends) - 1), np.uint8(0))
            before = np.cumsum(bits, dtype=np.int64) - bits
            return bits[places], before[places]
        bit, before = np.zeros(len(places), np.uint8), np.full(len(places), self.ones[-1])
        inside = np.flatnonzero(places < self.n)
        for block, here in self._by_block(places[inside] // BLOCK):
            bits = self.bits(block, block + 1)
            counts, at = np.cumsum(bits, dtype=np.int64) - bits, places[inside[here]] - block * BLOCK
            bit[inside[here]], before[inside[here]] = bits[at], self.ones[block] + counts[at]
        return bit, before

    def select(self, ranks: np.ndarray, bit: int) -> np.ndarray:
        """Places of the ones (or zeros) of the given ranks."""
        starts = np.minimum(np.arange(len(self.ones)) * BLOCK, self.n)
        before = self.ones if bit else starts - self.ones
        out = np.empty(len(ranks), np.int64)
        for block, here in self._by_block(np.searchsorted(before, ranks, side="right") - 1):
            out[here] = block * BLOCK + np.flatnonzero(self.bits(block, block + 1) == bit)[ranks[here] - before[block]]
        return out


class Shard:
    """A shard file, opened through `read(start, length)`; sections and blocks are read as they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        magic, size = struct.unpack("<4sI", read(0, 8))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.read = lambda start, length: read(8 + size + start, length)
        header = json.loads(read(8, size))
        self.n, self.bits, self.header = header["tokens"], header["bits"], header

    def section(self, place: list[int]) -> bytes:
        import zstandard
        return zstandard.ZstdDecompressor().decompress(self.read(place[0], place[1]), max_output_size=place[2]) if place[2] else b""

    @property
    def planes(self) -> list[_Plane]:
        if not hasattr(self, "_planes"):
            self._planes = [_Plane(self, p) for p in self.header["planes"]]
        return self._planes

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_ids and the first place of each document, with the end of the last."""
        ids, known, lengths = (np.frombuffer(self.section(self.header[k]), t) for k, t in (("doc_ids", "<i8"), ("known", "u1"), ("lengths", "<i8")))
        return [i if k else None for i, k in zip(ids.tolist(), known.tolist())], np.concatenate([[0], np.cumsum(lengths)])

    def tokens(self, places: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at, out = np.asarray(places, np.int64), np.zeros(len(places), np.uint32)
        for plane in self.planes:
            bit, ones = plane.look(at)
            out = (out << np.uint32(1)) | bit
            at = np.where(bit, plane.zeros + ones, at - ones)
        return out

    def all_tokens(self) -> np.ndarray:
        """All ids in order, from the last plane up: each plane deals the rows below it out to its zeros and ones."""
        ids = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            ones = plane.bits(0, len(plane.ends) - 1).view(bool)
            above = np.empty_like(ids)
            above[np.flatnonzero(~ones)] = ids[:plane.zeros]
            above[np.flatnonzero(ones)] = ids[plane.zeros:] | ids.dtype.type(1 << k)
            ids = above
        return ids

    def _range(self, token: int, start: int, stop: int) -> np.ndarray:
        """Where the occurrences of an id in [start, stop) stand behind the last plane."""
        ends = np.array([start, stop], np.int64)
        if token < 0 or token >> self.bits:
            return np.zeros(2, np.int64)
        for k, plane in enumerate(self.planes):
            ones = plane.look(ends)[1]
            ends = plane.zeros + ones if token >> (self.bits - 1 - k) & 1 else ends - ones
        return ends

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id occurs at the places start ... stop - 1."""
        first, last = self._range(token, start, self.n if stop is None else stop).tolist()
        return last - first

    def places(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ascending places of the occurrences first ... last - 1 of an id."""
        low, high = self._range(token, 0, self.n).tolist()
        at = np.arange(low + first, high if last is None else min(high, low + last), dtype=np.int64)
        for k, plane in reversed(list(enumerate(self.planes))):
            bit = token >> (self.bits - 1 - k) & 1
            at = plane.select(at - plane.zeros if bit else at, bit)
        return at


# ---- tokenising --------------------------------------------------------------------------------------------

# How a tokenizer of words cuts a text (after lowering it): fixed values of its file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
# Characters for which the same is said by ranges: ASCII, Latin letters that stay one letter in lower case, common punctuation.
LATIN = "À-ÖØ-öø-įı-ɏ"
MARKS = "¡«»¿‐-‧"
ODD = re.compile(rf"[^\x00-\x7f{LATIN}{MARKS}]")
PIECE = re.compile(rf"[a-z{LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t\n\x0b\x0c\r 0-9a-z{LATIN}]+")


class WordTokenizer:
    """Ids of texts by a tokenizer file, as packed little-endian 32-bit numbers.

    A tokenizer of words lowers a text, cuts it into runs of letters, single digits and runs of other characters, and drops white space; each
    piece ends in a token that marks the end of a word. So pieces met before are looked up, and new ones are encoded as one long text and told
    apart by those marks. Words with characters outside of ODD's ranges, and texts for tokenizers of another form, go to the tokenizer as they
    are. Two generations of at most `entries` pieces are kept, so memory is bounded. Names of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, entries: int = WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"                # Spark runs a task on each core
        self.tokenizer, self.entries = Tokenizer.from_file(path), entries
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, vocabulary = spec["model"].get("end_of_word_suffix"), spec["model"]["vocab"]
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [(p.get("pattern") or {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.words = bool(suffix) and normal == WORD_NORMALIZERS and cuts[:1] == [WORD_PATTERN]
        if self.words:
            self.ends = np.zeros(1 + max(vocabulary.values()), bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            # pieces are cut and lowered already
            self.merger = Tokenizer.from_file(path)
            self.merger.encode_special_tokens, self.merger.normalizer = True, None
            self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def _ids(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _pieces_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, encoded a thousand at a time as one text."""
        out: list[bytes] = []
        parts = [pieces[at:at + 1000] for at in range(0, len(pieces), 1000)]
        for part, encoded in zip(parts, self.merger.encode_batch_fast([" ".join(part) for part in parts], add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(part):
                packed = ids.tobytes()
                out += [packed[4 * a:4 * b] for a, b in zip([0, *ends], ends)]
            else:
                out += self._ids(part)
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Takes in all pieces of some texts."""
        known = self.known
        missing = pieces - known.keys()
        if len(known) + len(missing) > self.entries:
            self.known, self.elder, missing = {}, known, pieces
            known = self.known
        elder, new, odd = self.elder, [], []
        for p in missing:
            if p in elder:
                known[p] = elder[p]
            else:
                (odd if ODD.search(p) else new).append(p)
        known.update(zip(new, self._pieces_ids(new)))
        known.update(zip(odd, self._ids(odd)))

    def _cut(self, text: str) -> list[str]:
        if text.isascii() or not ODD.search(text):
            return PIECE.findall(text.lower())
        out: list[str] = []
        for word in text.replace("\n", " ").split(" "):
            if ODD.search(word):
                out.append(word)
            else:
                out += PIECE.findall(word.lower())
        return out

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        if not self.words:
            return self._ids(texts)
        parts = list(map(self._cut, texts))
        self._learn(set().union(*parts))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in parts]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


# ---- files -------------------------------------------------------------------------------------------------

def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path of Spark and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        path = rest if colon else uri
        return pafs.LocalFileSystem(), "/" + path.lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def open_shard(path: str) -> Shard:
    store, place = _open(path)
    file = store.open_input_file(place)

    def read(start: int, length: int) -> bytes:
        file.seek(start)
        return file.read(length)

    return Shard(read)


def write_shards(docs: DataFrame, path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> DataFrame:
    """Encodes all whole texts, appends the end id to each, and writes shard files; returns their manifest (a table that is written, too).

    Manifest: path, n_docs, n_tokens, start (ids of all shards before), task, shard. Documents are in ascending order of doc_id over
    the shards of a task and over the tasks; null ids come first, equal ids in the order of the hash of their texts. A null text is
    empty and has the end id alone; an empty table has no shard. A shard ends with the document that takes it to `shard_tokens`. A file is written
    under a name of its own and then renamed, so a task that runs again replaces its files by equal ones.
    """
    texts = texts_of(docs).withColumn("_tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc()]
    folder = folder or f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard, before = TaskContext.get().partitionId(), 0, 0
        store, place = _open(folder)
        tokenizer, end = word_tokenizer(path), np.array([end_id], "<u4").tobytes()
        ids, names, lengths, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            name = f"{place}/shard-{task:06d}-{shard:06d}.wm"
            store.create_dir(place, recursive=True)
            own = f"{name}.{uuid.uuid4()}"
            with store.open_output_stream(own) as out:
                write_shard(out, np.frombuffer(b"".join(ids), "<u4"), names, lengths)
            store.move(own, name)
            row = task, shard, f"{folder}/shard-{task:06d}-{shard:06d}.wm", len(names), held, before
            return pa.RecordBatch.from_pylist([dict(zip(FIELDS, row))], MANIFEST_SCHEMA)

        for part in slices(batches):
            for doc_id, packed in zip(part.column("doc_id").to_pylist(), tokenizer(part.column("text").to_pylist())):
                ids.append(packed + end)
                names.append(doc_id)
                lengths.append(len(packed) // 4 + 1)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield close()
                    shard, before, ids, names, lengths, held = shard + 1, before + held, [], [], [], 0
        if names:
            yield close()

    spread = texts.repartitionByRange(parallelism(docs), *order).sortWithinPartitions(*order, "text").drop("_tie")
    shards = cut(spread.mapInArrow(run, MANIFEST))
    # one row a task: as many as the shuffle has partitions, however large the input
    tasks = shards.groupBy("task").agg(F.sum("n_tokens").alias("_n"))
    tasks = tasks.select("task", (F.sum("_n").over(Window.orderBy("task")) - F.col("_n")).alias("_start"))
    return shards.join(tasks, "task").select("path", "n_docs", "n_tokens", (F.col("_start") + F.col("before")).alias("start"), "task", "shard")


FIELDS = [f.split(" ")[0] for f in MANIFEST.split(", ")]
MANIFEST_SCHEMA = pa.schema([(f.split(" ")[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split(" ")[1]]) for f in MANIFEST.split(", ")])


def _per_shard(manifest: DataFrame, rows: Callable[[Shard, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                yield from rows(open_shard(path), start)

    return manifest.select("path", "start").repartition(parallelism(manifest), "path").mapInArrow(run, schema)


def read_documents(manifest: DataFrame, rows_at_once: int = 500) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids (packed little-endian 32-bit numbers)."""
    def rows(shard: Shard, base: int) -> Iterator[pa.RecordBatch]:
        names, starts = shard.documents()
        ids = shard.all_tokens().astype("<u4")
        for at in range(0, len(names), rows_at_once):
            here = range(at, min(at + rows_at_once, len(names)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at:here.stop], pa.int64()), pa.array(base + starts[at:here.stop], pa.int64()), pa.array(np.diff(starts[at:here.stop + 1]), pa.int64()),
                 pa.array([ids[starts[i]:starts[i + 1]].tobytes() for i in here], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return _per_shard(manifest, rows, "doc_id long, start long, n_tokens long, ids binary")


def count_tokens(manifest: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """How often each of the given ids occurs: (token, n); no ids are decoded."""
    def rows(shard: Shard, base: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], ["token", "n"])

    return _per_shard(manifest, rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(manifest: DataFrame, token: int) -> DataFrame:
    """Every occurrence of an id: (doc_id, place in its document, place in the corpus); only blocks on its way are read."""
    def rows(shard: Shard, base: int) -> Iterator[pa.RecordBatch]:
        places = shard.places(token)
        if len(places):
            names, starts = shard.documents()
            doc = np.searchsorted(starts, places, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in doc.tolist()], pa.int64()), pa.array(places - starts[doc], pa.int64()), pa.array(base + places, pa.int64())],
                                             ["doc_id", "place", "corpus_place"])

    return _per_shard(manifest, rows, "doc_id long, place long, corpus_place long")
