"""Main text of web pages: a bidirectional LSTM labels the sequence of a page's leaf blocks."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stichos.llm.common import ship, slices

SAMPLE, VARIANTS, EPOCHS, BATCH, RATE, HIDDEN = 300, 4, 10, 32, 0.01, 24
PATH_DIMS, WORD_DIMS, SCALARS = 256, 48, 8
WIDTH = PATH_DIMS + WORD_DIMS + SCALARS

CELLS = 16_384                                                        # leaves that are scored at once
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|iframe)(?=[\s/>]).*?(?:</\1\s*>|\Z)"
                   r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S | re.I)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Za-z]+")
# elements inside a line of text; all others begin and end blocks (fixed values of the HTML standard)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# elements whose content is no text of the page, if they are closed at all
CONTAINED = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("title", "textarea", "template", "svg", "select", "button")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())

# places of text that is no part of an article, and of articles: what weak labels and varied pages are made from
BOILERPLATE = ("nav", "header", "footer", "aside", "form", "menu", "ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "cookie", "consent",
               "notice", "popup", "modal", "newsletter", "subscribe", "signup", "sidebar", "widget", "related", "recommended", "share", "social", "breadcrumb",
               "breadcrumbs", "pagination", "tags", "comment", "comments", "replies", "disqus", "login", "search", "masthead", "navbar", "topbar", "copyright", "legal")
CONTAINERS = ((), ("div",), ("article",), ("main",), ("main", "article"), ("div.content",), ("div.post",), ("div.entry",), ("div.article",), ("section.content",), ("div.main",), ("div.story",))
INNER = (("p",), ("p",), ("p",), ("h1",), ("h2",), ("h3",), ("ul", "li"), ("ol", "li"), ("blockquote",), ("blockquote", "p"), ("table", "tr", "td"), ("pre",), ("div",), ("div", "p"))
ELEMENTS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "menu": "menu"}


@dataclass
class Leaf:
    path: tuple[str, ...]
    text: str
    linked: float


def _tokens(page: str) -> Iterator[tuple[re.Match, bool]]:
    """The tokens of a page, and whether one begins an element that is passed over as a whole: one of CONTAINED that is closed further on.

    One that is never closed is an element like others; whether any closing tag is left is looked up once for each name.
    """
    ends: dict[str, int] = {}
    at = 0
    while m := TOKEN.search(page, at):
        at, name = m.end(), (m.group(3) or "").lower()
        if name not in CONTAINED or m.group(2):
            yield m, False
            continue
        if name not in ends:
            ends[name] = max((c.start() for c in CONTAINED[name].finditer(page, at)), default=-1)
        hidden = ends[name] >= at
        if hidden:
            at = CONTAINED[name].search(page, at).end()
        yield m, hidden


def leaves(page: str) -> list[Leaf]:
    """Blocks of text in page order with the path of open elements (names, and names with each word of class, id and role)."""
    stack: list[tuple[str, str]] = []
    out: list[Leaf] = []
    held: list[str] = []
    links, in_link = 0, 0

    def close() -> None:
        nonlocal links
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Leaf(tuple(e for _, e in stack), text, min(1.0, links / len(text))))
            held.clear()
        links = 0

    for m, hidden in _tokens(page):
        name = m.group(3)
        if name is None:
            raw = m.group()
            if raw[0] != "<" or raw == "<":
                held.append(raw)
                if in_link:
                    links += len(raw)
            elif m.group(1) is not None:
                close()
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = 0 if m.group(2) else 1
            continue
        close()
        in_link = 0
        if name in VOID or hidden:
            continue
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in CLOSES_ITSELF)):
            stack.pop()
        words = [w.lower() for a in NAMES.finditer(m.group(4)) for w in WORD.findall(a.group(2) or a.group(3) or a.group(4) or "")] if m.group(4) else []
        stack.append((name, " ".join([name, *(f"{name}.{w}" for w in words)])))
    close()
    return out


# ---- vectors -----------------------------------------------------------------------------------

class Vectors:
    """Vectors of leaves: hashed tag path (nearer elements weigh more), hashed words, sizes."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        v = self.paths.get(path)
        if v is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            v = np.zeros(PATH_DIMS)
            for depth, element in enumerate(reversed(path)):
                for part in element.split():
                    name, _, word = part.partition(".")
                    for key in ([f"tag {name}"] if not word else [f"word {word}"]):
                        v[zlib.crc32(key.encode()) % PATH_DIMS] += 1.0 if depth == 0 else 0.7
            self.paths[path] = v = np.minimum(v, 2)
        return v

    def bucket(self, word: str) -> int:
        b = self.words.get(word)
        if b is None:
            if len(self.words) > 200_000:
                self.words.clear()
            b = self.words[word] = zlib.crc32(word.encode()) % WORD_DIMS
        return b

    def of(self, page: list[Leaf], start: int = 0, stop: int | None = None) -> np.ndarray:
        """Vectors of the leaves start ... stop - 1 of a page."""
        part = page[start:stop]
        x = np.zeros((len(part), WIDTH), dtype=np.float32)
        for row, leaf in enumerate(part):
            i, words = start + row, leaf.text.split(" ")
            x[row, :PATH_DIMS] = self.path(leaf.path)
            x[row, PATH_DIMS:PATH_DIMS + WORD_DIMS] = np.bincount([self.bucket(w) for w in words], minlength=WORD_DIMS) / len(words) ** 0.5 / 4
            n = len(leaf.text)
            x[row, PATH_DIMS + WORD_DIMS:] = (np.log1p(n) / 8, np.log1p(len(words)) / 6, leaf.linked, leaf.text[-1] in ".!?:", len(leaf.path) / 8,
                                            i / len(page), i == 0, i == len(page) - 1)
        return x


# ---- network -------------------------------------------------------------------------------------

def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One LSTM over padded sequences (batch, steps, width); gates in the order input, forget, output, candidate."""

    def __init__(self, rng: np.random.Generator, width: int, hidden: int):
        self.p = {"W": rng.standard_normal((width, 4 * hidden)) / width ** 0.5, "U": rng.standard_normal((hidden, 4 * hidden)) / hidden ** 0.5,
                  "b": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])}
        self.hidden = hidden

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h, c = np.zeros((n, self.hidden)), np.zeros((n, self.hidden))
        given, out, kept, k = x @ self.p["W"] + self.p["b"], np.zeros((n, steps, self.hidden)), [], self.hidden
        for t in range(steps):
            z = given[:, t] + h @ self.p["U"]
            g, a = sigmoid(z[:, :3 * k]), np.tanh(z[:, 3 * k:])
            new = g[:, k:2 * k] * c + g[:, :k] * a
            tanh, m = np.tanh(new), mask[:, t:t + 1]
            kept.append((h, c, g, a, tanh, m))
            c, h = m * new + (1 - m) * c, m * g[:, 2 * k:] * tanh + (1 - m) * h
            out[:, t] = h
        return out, kept

    def scan(self, x: np.ndarray, mask: np.ndarray, state: tuple, top: np.ndarray) -> tuple[np.ndarray, tuple]:
        """What the steps of a block add to the scores, and the state behind them; nothing else is kept."""
        (h, c), k = state, self.hidden
        w, u, b = (self.p[name].astype(np.float32) for name in "WUb")
        given, out = x @ w + b, np.empty(x.shape[:2], np.float32)
        for t in range(x.shape[1]):
            z = given[:, t] + h @ u
            g, m = sigmoid(z[:, :3 * k]), mask[:, t:t + 1]
            new = g[:, k:2 * k] * c + g[:, :k] * np.tanh(z[:, 3 * k:])
            c, h = m * new + (1 - m) * c, m * g[:, 2 * k:] * np.tanh(new) + (1 - m) * h
            out[:, t] = h @ top
        return out, (h, c)

    def backward(self, x: np.ndarray, kept: list, dout: np.ndarray) -> dict[str, np.ndarray]:
        k, dz_all = self.hidden, np.zeros((*x.shape[:2], 4 * self.hidden))
        dh, dc, du = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0]), np.zeros_like(self.p["U"])
        for t in range(x.shape[1] - 1, -1, -1):
            h, c, g, a, tanh, m = kept[t]
            dh = dh + dout[:, t]
            i, f, o = g[:, :k], g[:, k:2 * k], g[:, 2 * k:]
            dn = m * (dc + dh * o * (1 - tanh ** 2))
            dz = np.concatenate([dn * a * i * (1 - i), dn * c * f * (1 - f), m * dh * tanh * o * (1 - o), dn * i * (1 - a ** 2)], axis=1)
            dz_all[:, t] = dz
            du += h.T @ dz
            dh, dc = dz @ self.p["U"].T + (1 - m) * dh, dn * f + (1 - m) * dc
        flat = dz_all.reshape(-1, 4 * k)
        return {"W": x.reshape(-1, x.shape[2]).T @ flat, "U": du, "b": flat.sum(axis=0)}


class Labeller:
    """Probability of each leaf to be main text, from both directions over the whole page."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.both = (Direction(rng, WIDTH, HIDDEN), Direction(rng, WIDTH, HIDDEN))
        self.top = {"w": rng.standard_normal(2 * HIDDEN) / HIDDEN ** 0.5, "d": np.zeros(1)}

    def _padded(self, pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p) for p in pages)
        x, mask = np.zeros((len(pages), steps, WIDTH)), np.zeros((len(pages), steps))
        for i, p in enumerate(pages):
            x[i, :len(p)], mask[i, :len(p)] = p, 1
        return x, mask

    def _run(self, x: np.ndarray, mask: np.ndarray) -> tuple:
        ahead, kept1 = self.both[0].forward(x, mask)
        back, kept2 = self.both[1].forward(x[:, ::-1], mask[:, ::-1])
        h = np.concatenate([ahead, back[:, ::-1]], axis=2)
        return sigmoid(h @ self.top["w"] + self.top["d"]), h, kept1, kept2

    def __call__(self, pages: list[list[Leaf]], vectors: Vectors) -> list[np.ndarray]:
        """Scores of the leaves of pages. Pages of like length are run together, CELLS leaves at most, and long ones in blocks of steps: a
        direction hands its state from block to block, so memory does not grow with a page but for one number a leaf."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            # the longest page decides how many run together
            size = max(1, min(64, CELLS // len(pages[order[-1]])))
            pick, order = order[-size:], order[:-size]
            z = self._scores([pages[i] for i in pick], vectors)
            for row, i in enumerate(pick):
                out[i] = sigmoid(z[row, :len(pages[i])] + self.top["d"])
        return out

    def _scores(self, pages: list[list[Leaf]], vectors: Vectors) -> np.ndarray:
        n, steps = len(pages), max(map(len, pages))
        block, z = max(1, CELLS // n), np.zeros((n, steps), np.float32)
        starts = range(0, steps, block)
        for direction, top, order in ((self.both[0], self.top["w"][:HIDDEN], starts), (self.both[1], self.top["w"][HIDDEN:], reversed(starts))):
            state = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for at in order:
                stop = min(at + block, steps)
                x, mask = np.zeros((n, stop - at, WIDTH), np.float32), np.zeros((n, stop - at), np.float32)
                for row, page in enumerate(pages):
                    part = vectors.of(page, at, stop)
                    x[row, :len(part)], mask[row, :len(part)] = part, 1
                step = 1 if direction is self.both[0] else -1
                added, state = direction.scan(x[:, ::step], mask[:, ::step], state, top.astype(np.float32))
                z[:, at:stop] += added[:, ::step]
        return z

    def fit(self, pages: list[np.ndarray], marks: list[np.ndarray], seed: int = 9) -> None:
        rng, params = np.random.default_rng(seed), {**{f"0{k}": (self.both[0].p, k) for k in "WUb"}, **{f"1{k}": (self.both[1].p, k) for k in "WUb"},
                                                   **{k: (self.top, k) for k in "wd"}}
        m, v, step = {k: 0.0 for k in params}, {k: 0.0 for k in params}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(pages))
            order = np.concatenate([sorted(block, key=lambda i: len(pages[i])) for block in np.array_split(order, max(1, len(order) // 512))])
            batches = [order[at:at + BATCH] for at in range(0, len(order), BATCH)]
            for b in rng.permutation(len(batches)):
                pick = batches[b]
                x, mask = self._padded([pages[i] for i in pick])
                target = np.zeros(mask.shape)
                for row, i in enumerate(pick):
                    target[row, :len(marks[i])] = marks[i]
                y, h, kept1, kept2 = self._run(x, mask)
                dy = (y - target) * mask / mask.sum()
                dh = dy[:, :, None] * self.top["w"]
                grads = {"w": (h * dy[:, :, None]).sum(axis=(0, 1)), "d": np.array([dy.sum()])}
                grads |= {f"0{k}": g for k, g in self.both[0].backward(x, kept1, dh[:, :, :HIDDEN]).items()}
                grads |= {f"1{k}": g for k, g in self.both[1].backward(x[:, ::-1], kept2, dh[:, ::-1, HIDDEN:]).items()}
                step += 1
                for k, g in grads.items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    holder, name = params[k]
                    holder[name] = holder[name] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)


# ---- weak labels -----------------------------------------------------------------------------------

def words_of(path: tuple[str, ...]) -> set[str]:
    return {w for element in path for part in element.split() for w in part.split(".")}


def weak_marks(page: list[Leaf]) -> np.ndarray:
    """1 for leaves in an article or main element (of pages without: outside of all others) that no boilerplate place encloses."""
    within = [words_of(leaf.path) for leaf in page]
    plain = [not (w & set(BOILERPLATE)) for w in within]
    inside = [bool(w & {"article", "main"}) for w in within]
    return np.array([p and (i or not any(inside)) for p, i in zip(plain, inside)], dtype=float)


def varied(page: list[Leaf], marks: np.ndarray, pool: list[str], rng: np.random.Generator) -> tuple[list[Leaf], np.ndarray]:
    """The same article in another page: another container and other tags, with boilerplate places around and within it.

    Their texts are runs of words of other pages, so that the place and what stands around it tell, not the words.
    """
    pick = lambda items: items[int(rng.integers(len(items)))]

    def place(within: tuple[str, ...]) -> list[tuple[Leaf, float]]:
        word = pick(BOILERPLATE)
        tag = ELEMENTS.get(word) or pick(("div", "section", "ul", "aside", "p"))
        element = tag if word in ELEMENTS and rng.random() < 0.5 else f"{tag} {tag}.{word}"
        found = []
        for _ in range(int(rng.integers(1, 6))):
            inner = pick(((), ("ul", "li"), ("div", "h3"), *INNER))
            words = pick(pool).split(" ")
            start = int(rng.integers(len(words)))
            text = " ".join(words[start:start + int(rng.integers(1, 40))])
            found.append((Leaf((*within, element, *inner), text, float(rng.random() < 0.4)), 0.0))
        return found

    base, container = ("html", "body", *pick(((), ("div",), ("div div.page",), ("div div.wrapper",)))), pick(CONTAINERS)
    container = tuple(f"{e.split('.')[0]} {e}" if "." in e else e for e in container)
    out: list[tuple[Leaf, float]] = []
    for _ in range(int(rng.integers(0, 4))):
        out += place(base)
    article = [leaf for leaf, mark in zip(page, marks) if mark]
    for i, leaf in enumerate(article):
        tag = leaf.path[-1].split()[0] if leaf.path else "p"
        inner = pick(INNER) if rng.random() < 0.5 or tag in ("article", "main", "body", "html") else (tag,)
        text = leaf.text if rng.random() < 0.6 else " ".join(leaf.text.split(" ")[:int(rng.integers(1, 15))])
        out.append((Leaf((*base, *container, *inner), text, leaf.linked * float(rng.random() < 0.5)), 1.0))
        if i and rng.random() < 0.12:
            out += place((*base, *container))
    for _ in range(int(rng.integers(0, 3))):
        out += place((*base, *container))
    for _ in range(int(rng.integers(0, 4))):
        out += place(base)
    return [leaf for leaf, _ in out], np.array([mark for _, mark in out])


def learn_labeller(pages: DataFrame, rows: int = SAMPLE) -> Labeller | None:
    """A labeller from at most `rows` pages (those with the least hash of page_id, each with at most 400 blocks) and VARIANTS varied forms of each."""
    picked = pages.filter(F.col("html").isNotNull()).select(F.col("html").alias("text"), F.xxhash64("page_id", "html").alias("_rank")) \
        .orderBy("_rank").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [leaves(t)[:400] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("_rank"), pa.array([[" > ".join(x.path) for x in p] for p in found], pa.list_(pa.string())),
                                              pa.array([[x.text for x in p] for p in found], pa.list_(pa.string())),
                                              pa.array([[x.linked for x in p] for p in found], pa.list_(pa.float64()))], names=["rank", "path", "text", "linked"])

    got = picked.mapInArrow(run, "rank long, path array<string>, text array<string>, linked array<double>").collect()
    known = [[Leaf(tuple(p.split(" > ")) if p else (), t, a) for p, t, a in zip(r.path, r.text, r.linked)] for r in sorted(got, key=lambda r: r.rank)]
    known = [p for p in known if p]
    if not known:
        return None
    rng, vectors = np.random.default_rng(1), Vectors()
    pool, sequences, marks = [leaf.text for p in known for leaf in p], [], []
    for page in known:
        own = weak_marks(page)
        forms = [(page, own)]
        if own.any():
            forms += [varied(page, own, pool, rng) for _ in range(VARIANTS)]
        for leaves_, mark in forms:
            sequences.append(vectors.of(leaves_))
            marks.append(mark)
    model = Labeller()
    model.fit(sequences, marks)
    return model


def extract_text(pages: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Main text of every page: its blocks labelled as such, in page order, joined by a line feed.

    The labeller is learned from a bounded sample; then one narrow pass reads each whole page. Scripts, styles, titles, comments and other markup
    are no blocks; a title, menu list, button or drawing that is never closed is an element like others. A null or empty page, or one without main text, has an empty text; rows with the same page_id, or none, are each extracted; other
    columns are not read.
    """
    ship(pages.sparkSession)
    model = learn_labeller(pages, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for part in slices(batches, "html"):
            found = [leaves(t) for t in part.column("html").to_pylist()]
            scores = model(found, vectors) if model else [np.zeros(len(p)) for p in found]
            texts = ["\n".join([leaf.text for leaf, s in zip(p, y) if s >= 0.5]) for p, y in zip(found, scores)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
