"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: the text between block-level tags, in page order, each with the path of open elements. A block's
vector holds hashed tags of its path, hashed words of the classes and ids on it, hashed words of its text, and its length,
link share and punctuation. A bidirectional LSTM in numpy reads the vectors of the whole page, so that each block is
classified with all others in view. It is fitted once in a process, to pages that a fixed random generator writes in many
layouts with known labels; no page of the input is used, and no rule but the label decides what stays.
"""

from __future__ import annotations

import html as entities
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html_samples import sample_pages
from .kernel import WORDY, Words, view
from .rows import column, extend
from .scratch import table

COLUMNS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_main", T.LongType())])
#: Elements that begin and end blocks.
BREAKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video xmp noembed noframes".split())
#: A start tag of the first closes an open element of the second, up to an element of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_MARK = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]*")
_SPACE = re.compile(r"[ \t\n\r\f\v  -     　 \u0085]+")


class Block:
    __slots__ = ("linked", "names", "tags", "text")

    def __init__(self, text: str, tags: tuple[str, ...], names: tuple[str, ...], linked: int):
        self.text, self.tags, self.names, self.linked = text, tags, names, linked


def blocks(page: str | None) -> list[Block]:
    """The blocks with any text, in page order; scripts, styles and comments have none."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = in_link = 0
    at, size = 0, len(page)

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece)

    def close() -> None:
        nonlocal linked
        if parts:
            joined = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if joined:
                out.append(Block(joined, tuple(t for t, _ in stack), tuple(n for _, ns in stack for n in ns), linked))
            parts.clear()
        linked = 0

    while at < size:
        m = _MARK.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        end, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not end:
            if not rest.endswith("/") or name not in ("svg", "math"):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else size
            continue
        if name == "a":
            in_link = 0 if end else 1
        if name == "br":
            text(" ")
        if name not in BREAKS:
            continue
        close()
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if name in CLOSES:
            ends, limits = CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in limits:
                    break
                if stack[i][0] in ends:
                    del stack[i:]
                    break
        if name not in VOID:
            names = tuple(w.lower() for a in _ATTRIBUTE.findall(rest) for w in _NAME.findall(a[1] or a[2] or a[3])) if rest else ()
            stack.append((name, names))
    close()
    return out


PATH, NAMES, WORDS_, EXTRA = 64, 64, 48, 10
SIZE = PATH + NAMES + WORDS_ + EXTRA


@cache
def _slot(kind: str, word: str, size: int) -> int:
    h = 2166136261
    for c in f"{kind}:{word}".encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % size


def vectors(page: list[Block]) -> np.ndarray:
    """A row for each block."""
    x = np.zeros((len(page), SIZE), np.float32)
    if not page:
        return x
    for i, b in enumerate(page):
        for t in b.tags:
            x[i, _slot("t", t, PATH)] = 1
        if b.tags:
            x[i, _slot("last", b.tags[-1], PATH)] += 1
        for w in b.names:
            x[i, PATH + _slot("n", w, NAMES)] = 1
        n = len(b.text)
        x[i, -EXTRA:] = (
            min(n, 2000) ** 0.5 / 20,
            min(1.0, b.linked / n),
            sum(map(b.text.count, ".!?;")) / n * 20,
            b.text.count(",") / n * 20,
            n < 20,
            n > 80,
            i / len(page),
            i == 0,
            i == len(page) - 1,
            len(b.tags) / 10,
        )
    w = Words(*view(pa.array([b.text for b in page])), WORDY)
    if len(w):
        row = w.row_of()
        bag = np.bincount(row * WORDS_ + (w.hashes() % np.uint64(WORDS_)).astype(np.int64), minlength=len(page) * WORDS_).reshape(len(page), WORDS_)
        x[:, PATH + NAMES : PATH + NAMES + WORDS_] = 0.25 * bag / np.maximum(1, np.diff(w.rows))[:, None]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for every block."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.p = {"x": rng.normal(0, 0.1, (SIZE, 8 * h)), "f": rng.normal(0, 0.15, (h, 4 * h)), "b": rng.normal(0, 0.15, (h, 4 * h)), "bias": np.zeros(8 * h), "out": rng.normal(0, 0.2, 2 * h), "end": np.zeros(1)}
        self.p["bias"][h : 2 * h] = self.p["bias"][5 * h : 6 * h] = 1.0  # gates that keep start open

    def _run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: page, block, vector. Probabilities, and the states if they are to be kept."""
        n, t, _ = x.shape
        h = self.hidden
        z = (x.reshape(n * t, -1) @ self.p["x"] + self.p["bias"]).reshape(n, t, 8 * h)
        states = np.zeros((n, t, 2 * h))
        saved = {}
        for side, steps, w in ((0, range(t), self.p["f"]), (1, range(t - 1, -1, -1), self.p["b"])):
            s, c = np.zeros((n, h)), np.zeros((n, h))
            for k in steps:
                g = z[:, k, 4 * h * side : 4 * h * (side + 1)] + s @ w
                i, f, o, u = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h]), _sigmoid(g[:, 2 * h : 3 * h]), np.tanh(g[:, 3 * h :])
                m = mask[:, k, None]
                before = s, c
                c = (f * c + i * u) * m
                tc = np.tanh(c)
                s = o * tc * m
                states[:, k, h * side : h * (side + 1)] = s
                if keep:
                    saved[side, k] = (*before, i, f, o, u, tc)
        p = _sigmoid(states @ self.p["out"] + self.p["end"])
        return (p, states, saved) if keep else p

    def _gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        n, t, _ = x.shape
        h = self.hidden
        p, states, saved = self._run(x, mask, keep=True)
        total = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
        d = (p - y) * mask / total
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["end"] = np.einsum("nt,nth->h", d, states), np.array([d.sum()])
        ds = d[:, :, None] * self.p["out"]
        dz = np.zeros((n, t, 8 * h))
        for side, steps, key in ((0, range(t - 1, -1, -1), "f"), (1, range(t), "b")):
            s_next, c_next = np.zeros((n, h)), np.zeros((n, h))
            for k in steps:
                s0, c0, i, f, o, u, tc = saved[side, k]
                m = mask[:, k, None]
                s = (ds[:, k, h * side : h * (side + 1)] + s_next) * m
                c = (s * o * (1 - tc * tc) + c_next) * m
                a = np.concatenate((c * u * i * (1 - i), c * c0 * f * (1 - f), s * tc * o * (1 - o), c * i * (1 - u * u)), 1)
                dz[:, k, 4 * h * side : 4 * h * (side + 1)] = a
                g[key] += s0.T @ a
                s_next, c_next = a @ self.p[key].T, c * f
        flat = dz.reshape(n * t, -1)
        g["x"], g["bias"] = x.reshape(n * t, -1).T @ flat, flat.sum(0)
        return loss, g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 10, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Labeller:
        """Adam over batches of pages of like sizes. pages: vectors and labels."""
        rng = np.random.default_rng(seed)
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        lots = [pages[i : i + batch] for i in range(0, len(pages), batch)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for r in range(rounds):
            for i in rng.permutation(len(lots)):
                x, mask = padded([p[0] for p in lots[i]])
                y = padded([p[1][:, None] for p in lots[i]])[0][:, :, 0]
                _, g = self._gradient(x, mask, y)
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * 0.8**r * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def label(self, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """Probability of main text for each block. Pages of like sizes are run together, of at most ``cells`` blocks with padding."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            lot: list[int] = []
            while order and (not lot or (len(lot) + 1) * len(pages[order[0]]) <= cells):
                lot.append(order.pop(0))
            x, mask = padded([pages[i] for i in lot])
            p = self._run(x, mask)
            for i, row in zip(lot, p, strict=True):
                out[i] = row[: len(pages[i])]
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x, mask = np.zeros((len(rows), longest, rows[0].shape[1]), np.float32), np.zeros((len(rows), longest), np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, 1
    return x, mask


def labelled(pages: list[tuple[str, set[str]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of generated pages: (html, texts of the main blocks)."""
    out = []
    for page, main in pages:
        found = blocks(page)
        out.append((vectors(found), np.array([b.text in main for b in found], np.float32)))
    return out


@cache
def trained(pages: int = 1200, seed: int = 11) -> Labeller:
    model = Labeller().fit(labelled(sample_pages(pages, seed)))
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    return model


def main_text(pages: DataFrame, html: str = "html", drop: tuple[str, ...] = ()) -> DataFrame:
    """pages with text (main blocks joined by an empty line; empty if none), n_blocks and n_main. Null html is empty."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def make():
        model = shared.value

        def row(b: pa.RecordBatch) -> list:
            col = column(b, html)
            texts, counts, mains = [], [], []
            for a in range(0, len(col), 64):
                found = [blocks(x) for x in col.slice(a, 64).to_pylist()]
                for page, p in zip(found, model.label([vectors(x) for x in found]), strict=True):
                    main = [x.text for x, q in zip(page, p, strict=True) if q >= 0.5]
                    texts.append("\n\n".join(main))
                    counts.append(len(page))
                    mains.append(len(main))
            return [texts, counts, mains]

        return row

    return extend(pages, COLUMNS, make, drop)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), drop=("html",))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_main")
