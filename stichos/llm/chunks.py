"""Tokenising whole texts by way of chunks that recur.

A byte-level pre-tokenising pattern that lets one blank lead a word never joins characters across a blank or line
feed that stands alone between two other characters. So a text in which all white space of that sort stands alone is the
sequence of its chunks (a word with its leading blank, or a line feed with the first word of a line), and a chunk met
before is only looked up. Nor does such a pattern join a letter or digit with punctuation behind it (apostrophes apart), so a word with
punctuation at its end is the word and that. Any other text (such white space in runs or at an end) is tokenised as one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

ENTRIES = 400_000
WHOLE = 0                                                             # stands for a chunk that cannot be tokenised alone
PUNCTUATION, TAILS = ".,!?;:*#$%&|()\"-", 20_000


class ChunkTokenizer:
    """Token ids of texts as packed bytes; `encode` gives the packed ids of each chunk, or of each whole text if its second argument is true.

    Chunks are kept in two generations of at most `entries`: when the younger is full it becomes the elder, whose entries are
    taken over again as they are met, so frequent chunks stay and memory is bounded.
    """

    def __init__(self, encode: Callable[[Sequence[str], bool], list[bytes]], entries: int = ENTRIES):
        self.encode, self.entries, self.feed = encode, entries, encode(["\n"], True)[0]
        self.known: dict[str, bytes | int] = {}
        self.elder: dict[str, bytes | int] = {}
        self.tails: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.entries:
            self.known, self.elder = {}, self.known
        if len(self.tails) > TAILS:
            self.tails = {}
        known, elder, tails = self.known, self.elder, self.tails
        alone, first, tailed = set(), [], []
        for w in words:
            if w in elder:
                known[w] = elder[w]
            elif not w or w.strip() != w:
                known[w] = WHOLE
                if w[:1] == "\n" and len(w) > 1 and w.strip() == w[1:]:
                    first.append(w)
            else:
                core = w.rstrip(PUNCTUATION)
                if core is not w and core and core[-1].isalnum():
                    tailed.append((w, core))
                    w = core
                    if w in elder:
                        known[w] = elder[w]
                if w not in known:
                    alone.add(w)
        new = list(alone)
        known.update(zip(new, self.encode([" " + w for w in new], False)))
        new = list({w[len(c):] for w, c in tailed} - tails.keys())
        tails.update(zip(new, self.encode(new, False)))
        for w, core in tailed:
            known[w] = known[core] + tails[w[len(core):]]
        feed = self.feed
        known.update([(w, feed + ids) for w, ids in zip(first, self.encode([w[1:] for w in first], False))])

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        parts, found, missing = [], [], set()
        get = self.known.get
        for text in texts:
            words = ("\n" + text.replace("\n", " \n")).split(" ")
            got = list(map(get, words))
            parts.append(words)
            found.append(got)
            if None in got:
                missing.update([w for w, ids in zip(words, got) if ids is None])
        if missing:
            self._learn(missing)
        get, out, whole, skip = self.known.get, [], [], len(self.feed)
        for i, (words, got) in enumerate(zip(parts, found)):
            if None in got:
                got = [get(w) if ids is None else ids for w, ids in zip(words, got)]
            try:
                out.append(b"".join(got)[skip:])
            except TypeError:
                whole.append(i)
                out.append(b"")
        for i, ids in zip(whole, self.encode([texts[i] for i in whole], True) if whole else ()):
            out[i] = ids
        return out
