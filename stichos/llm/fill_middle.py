"""Fill-in-the-middle: a text is cut at two of its line borders and its parts change places.

The borders of all texts of a slice are one ascending sequence of byte offsets. A learned rank index stores it as few linear
segments of bounded error and one small residual a border; a cut is the border of a rank, predicted by its segment and set
right by its residual.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stichos.llm.common import slices, texts_of

PLAIN, PSM, SPM = "plain", "psm", "spm"
SENTINELS = ("<P>", "<S>", "<M>")
ERROR = 30_000                                                        # residuals then fit 16 bits
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class RankIndex:
    """Ascending integers by rank: linear segments whose predictions are off by `error` at most, and the residual of each rank.

    A segment grows as long as one slope through its first point passes all its points within the error: each point leaves
    a range of slopes, and the segment ends where the ranges of its points no longer meet.
    """

    def __init__(self, values: np.ndarray, error: int = ERROR):
        values = np.asarray(values, dtype=np.int64)
        first, slope, at = [], [], 0
        while at < len(values):
            low, high, end, step = -np.inf, np.inf, at + 1, 256
            while end < len(values):
                stop = min(len(values), end + step)
                run, rise = np.arange(end - at, stop - at), values[end:stop] - values[at]
                lows = np.maximum.accumulate(np.maximum((rise - error) / run, low))
                highs = np.minimum.accumulate(np.minimum((rise + error) / run, high))
                apart = np.flatnonzero(lows > highs)
                fit = int(apart[0]) if len(apart) else stop - end
                if fit:
                    low, high = lows[fit - 1], highs[fit - 1]
                end += fit
                if len(apart):
                    break
                step *= 2
            first.append(at)
            slope.append((low + high) / 2 if end > at + 1 else 0.0)
            at = end
        self.first, self.slope = np.array(first, dtype=np.int64), np.array(slope)
        self.base = values[self.first]
        residuals = values - self.predict(np.arange(len(values)))
        self.residuals = residuals.astype(np.int16 if error < (1 << 15) - 2 else np.int64)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[segment] + np.floor(self.slope[segment] * (ranks - self.first[segment])).astype(np.int64)

    def __getitem__(self, ranks) -> np.ndarray:
        ranks = np.asarray(ranks, dtype=np.int64)
        return self.predict(ranks) + self.residuals[ranks]


def borders(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All line borders of the texts data[start:end], the rank of each text's first one, and its number of lines.

    A line is `[^\\n]*\\n|[^\\n]+`; a text of n lines has n + 1 borders, its start and end among them. Texts follow each other without gaps.
    """
    base = int(starts[0]) if len(starts) else 0
    feeds = np.flatnonzero(data[base:int(ends[-1]) if len(ends) else 0] == 10) + base
    before, behind = np.searchsorted(feeds, starts), np.searchsorted(feeds, ends)
    tail = ends > starts
    tail[tail] = data[ends[tail] - 1] != 10
    n = behind - before + tail
    first = np.cumsum(n + 1) - n - 1
    out = np.empty(int((n + 1).sum()), dtype=np.int64)
    out[first] = starts
    text = np.searchsorted(ends, feeds, side="right")
    out[first[text] + 1 + np.arange(len(feeds)) - before[text]] = feeds + 1
    out[(first + n)[tail]] = ends[tail]
    return out, first, n


def _letters(piece: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((piece & 0xC0) != 0x80))


def _rearranged(batch: pa.RecordBatch, seed: int, rate: int, spm_rate: int, sentinels: tuple[str, str, str]) -> pa.RecordBatch:
    texts = batch.column("text").cast(pa.large_binary())
    _, places, values = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    starts, ends = offsets[:-1], offsets[1:]
    found, first, n = borders(data, starts, ends)
    index = RankIndex(found)
    ids = batch.column("doc_id").to_pylist()
    draws = np.empty((len(ids), 4), dtype=np.int64)
    for i, doc_id in enumerate(ids):
        digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        draws[i] = np.frombuffer(digest[:16], ">u4")
    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    cuts = np.stack([index[first + np.minimum(one, two)], index[first + np.maximum(one, two)]], axis=1)
    prefix_tag, suffix_tag, middle_tag = tags = [s.encode() for s in sentinels]
    forms, prefix_chars, middle_chars, outputs = [], [], [], []
    for i in range(len(ids)):
        start, (a, b), end = int(starts[i]), cuts[i].tolist(), int(ends[i])
        text = data[start:end].tobytes()
        if not text or draws[i, 2] % 100 >= rate or any(tag in text for tag in tags):
            forms.append(PLAIN)
            prefix_chars.append(None)
            middle_chars.append(None)
            outputs.append(text)
            continue
        prefix, middle, suffix = text[:a - start], text[a - start:b - start], text[b - start:]
        if draws[i, 3] % 100 < spm_rate:
            forms.append(SPM)
            outputs.append(b"".join((suffix_tag, suffix, prefix_tag, prefix, middle_tag, middle)))
        else:
            forms.append(PSM)
            outputs.append(b"".join((prefix_tag, prefix, suffix_tag, suffix, middle_tag, middle)))
        prefix_chars.append(_letters(data[start:a]))
        middle_chars.append(_letters(data[a:b]))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix_chars, pa.int64()),
         pa.array(middle_chars, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50,
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per document its rearranged text: doc_id, n (lines), form, prefix_chars, middle_chars, output. Narrow, one row in, one row out.

    Four numbers drawn from the sha256 of seed and doc_id give both cuts, whether the text is rearranged at all (`rate` per cent) and the
    order (`spm_rate` per cent suffix first). A null text is empty; an empty text, and one that holds a sentinel, stays plain with null
    sizes. A null doc_id draws as the empty string; rows listed twice give equal rows; an empty table gives an empty one.
    """
    if len(set(sentinels)) < 3 or any(not s or any(s[:k] == s[-k:] for k in range(1, len(s))) for s in sentinels):
        raise ValueError("sentinels must differ, and none may begin as it ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield _rearranged(part, seed, rate, spm_rate, sentinels)

    return texts_of(docs).mapInArrow(run, SCHEMA)


def restored(output: str | Column, form: str | Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from the output and its form alone. No sentinel occurs in a rearranged text, so each occurs once."""
    out, kind = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    prefix_tag, suffix_tag, middle_tag = sentinels

    def parts(opening: str, second: str) -> tuple[Column, Column, Column]:
        head = F.substr(F.split_part(out, F.lit(second), F.lit(1)), F.lit(len(opening) + 1))
        rest = F.split_part(out, F.lit(second), F.lit(2))
        return head, F.split_part(rest, F.lit(middle_tag), F.lit(1)), F.split_part(rest, F.lit(middle_tag), F.lit(2))

    prefix, suffix, middle = parts(prefix_tag, suffix_tag)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(suffix_tag, prefix_tag)
    return F.when(kind == PSM, psm).when(kind == SPM, F.concat(prefix, middle, suffix)).otherwise(out)
