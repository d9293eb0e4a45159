"""Toxic spans by a linear-chain conditional random field.

Tokens are tagged plain or toxic. A token's features are hashed: the word, prefixes and a suffix of it, and the words before
and after. Labels are given for documents only, so the labelled tokens are made from them: in a document marked toxic, the
tokens whose word or prefix is much more frequent in toxic than in clean documents are tagged toxic; all others are plain.
The field is fitted to these by gradient descent with forward-backward marginals. A document's score is a logistic function
of its largest and summed marginals, fitted to the document labels; its spans are the runs of tokens with a marginal of 0.5
or more, as code point offsets.

The model is fitted on the driver to a bounded sample (``fit_docs`` labelled documents of each class, of ``fit_bytes`` at
most); scoring covers every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import WORDY, Words, code_points, groups, mix, trim, view
from .rows import column, extend
from .scratch import table

SLOTS = 1 << 20
PREFIXES, SUFFIX = (4, 5, 6), 4
N_WORD, N_CONTEXT = 1 + len(PREFIXES) + 1, 2
COLUMNS = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("toxic_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))),
    ]
)


class Tokens:
    """Feature slots of each word and the sentences (chains) that the words form."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        w = self.words = Words(data, off, WORDY)
        n = len(w)
        own = [w.hashes()]
        own += [w.range_hash(w.start, np.minimum(w.end, w.start + k)) for k in PREFIXES]
        own += [w.range_hash(np.maximum(w.start, w.end - SUFFIX), w.end)]
        # A chain ends with its row, and where a line or sentence does.
        stops = np.concatenate(([0], np.cumsum(np.isin(data, np.frombuffer(b"\n.!?", np.uint8)))))
        new = np.zeros(n, bool)
        new[w.rows[:-1][np.diff(w.rows) > 0]] = True
        new[1:] |= stops[w.start[1:]] > stops[w.end[:-1]]
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.concatenate((self.first, [n])))
        before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        if n > 1:
            inner = ~new[1:]
            before[1:][inner] = own[0][:-1][inner]
            after[:-1][inner] = own[0][1:][inner]
        self.slots = [(mix(x + np.uint64(i * 7919 + 1)) >> np.uint64(44)).astype(np.int32) for i, x in enumerate([*own, before, after])]
        self.rows = w.rows

    def __len__(self) -> int:
        return len(self.slots[0])

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    @classmethod
    def of(cls, texts: list[str]) -> Tokens:
        """Tokens of many texts without the texts themselves, made group by group."""
        data, off = view(pa.array(texts, pa.large_string()))
        parts = [cls(data[off[a] : off[z]], off[a : z + 1] - off[a]) for a, z in groups(off, 1 << 17)]
        for x in parts:
            x.words = None
        out = cls.__new__(cls)
        base = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        out.words = None
        out.slots = []
        for _ in range(N_WORD + N_CONTEXT):
            out.slots.append(np.concatenate([x.slots.pop(0) for x in parts]))
        out.first = np.concatenate([x.first + b for x, b in zip(parts, base, strict=False)])
        out.size = np.concatenate([x.size for x in parts])
        out.rows = np.concatenate([[0], *(x.rows[1:] + b for x, b in zip(parts, base, strict=False))])
        return out


def marginals(emission: np.ndarray, first: np.ndarray, size: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Forward-backward over all chains at once. emission: score of toxic less that of plain.

    moves: scores of start (toxic), plain to toxic, toxic to plain, toxic to toxic (others are 0). Returns each token's
    probability of toxic, the log of each chain's partition sum, and with pairs the expected counts of moves.
    """
    n = len(emission)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    a0, a1 = np.zeros(n), np.zeros(n)
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # chains with more than t tokens
    start, pt, tp, tt = moves
    for t in range(longest):
        at = first[: live[t]] + t
        if t:
            p0, p1 = a0[at - 1], a1[at - 1]
            a0[at] = np.logaddexp(p0, p1 + tp)
            a1[at] = np.logaddexp(p0 + pt, p1 + tt) + emission[at]
        else:
            a1[at] = start + emission[at]
    b0, b1 = np.zeros(n), np.zeros(n)
    for t in range(longest - 2, -1, -1):
        at = first[: live[t + 1]] + t
        e1 = emission[at + 1] + b1[at + 1]
        b0[at] = np.logaddexp(b0[at + 1], pt + e1)
        b1[at] = np.logaddexp(tp + b0[at + 1], tt + e1)
    with np.errstate(over="ignore"):
        p = 1 / (1 + np.exp(np.clip(a0 + b0 - a1 - b1, -700, 700)))
    if not pairs:
        return p, None, None
    ends = first + size - 1
    z = np.logaddexp(a0[ends], a1[ends])
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    of = np.zeros(n)
    of[first] = z
    chain = np.repeat(of[np.sort(first)], np.diff(np.concatenate((np.sort(first), [n]))))[at]
    e1 = emission[at] + b1[at] - chain
    counts = np.array([p[first].sum(), np.exp(a0[at - 1] + pt + e1).sum(), np.exp(a1[at - 1] + tp + b0[at] - chain).sum(), np.exp(a1[at - 1] + tt + e1).sum()])
    return p, z, counts


def all_marginals(emission: np.ndarray, first: np.ndarray, size: np.ndarray, moves: np.ndarray, most: int = 1 << 18):
    """Probabilities and counts of moves of marginals(), some chains (in order of their places) at a time, which bounds the arrays in use."""
    p, counts = np.zeros(len(emission)), np.zeros(4)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(first, first[at] + most)))
        a, z = int(first[at]), int(first[to - 1] + size[to - 1])
        p[a:z], _, have = marginals(emission[a:z], first[at:to] - a, size[at:to], moves, pairs=True)
        counts += have
        at = to
    return p, counts


def emissions(tokens: Tokens, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(tokens))
    for s in tokens.slots:
        out += weights[s]
    return out


def tag(tokens: Tokens, toxic: np.ndarray, ratio: float = 3.0, least: int | None = None) -> np.ndarray:
    """Toxic tokens, from the labels of documents: in toxic documents those whose word or prefix is e**ratio times as frequent in them.

    A word counts once for each pair of words that it stands between, so that copies of a document don't add up. least: how
    often it must count; by default a fiftieth of the toxic documents, within 4 and 12.
    """
    row = tokens.row_of()
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    least = least or max(4, min(12, n1 // 50))
    out = np.zeros(len(tokens), bool)
    context = tokens.slots[-2].astype(np.int64) * SLOTS + tokens.slots[-1]
    in_toxic = toxic[row]
    for s in tokens.slots[: N_WORD - 1]:
        places = np.unique(mix((context[in_toxic] * 31 + 7).astype(np.uint64)) >> np.uint64(20) | s[in_toxic].astype(np.uint64) << np.uint64(44))
        x1 = np.minimum(np.bincount((places >> np.uint64(44)).astype(np.int64), minlength=SLOTS), _documents(s, row, in_toxic))
        x0 = _documents(s, row, ~in_toxic)
        good = (x1 >= least) & (np.log((x1 + 0.5) / n1) - np.log((x0 + 0.5) / n0) >= ratio)
        out |= good[s]
    return out & in_toxic


def _documents(slots: np.ndarray, row: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Documents with each slot."""
    return np.bincount(np.unique(row[some].astype(np.int64) * SLOTS + slots[some]) % SLOTS, minlength=SLOTS)


class Model:
    """weights: of the feature slots; moves: of the chain; final: of the document score."""

    def __init__(self):
        self.weights, self.moves, self.final = np.zeros(SLOTS, np.float32), np.array([-3.0, -3.0, 0.0, 0.0]), np.array([-6.0, 8.0, 0.5])

    def fit(self, texts: list[str], toxic: list[int], rounds: int = 30, rate: float = 0.5) -> Model:
        """Adagrad on the likelihood of the tags, then Newton steps for the document score."""
        y = np.array(toxic, bool)
        if not y.any() or y.all():
            return self
        tokens = Tokens.of(texts)
        tags = tag(tokens, y)
        moved = np.full(4, 1e-6)
        used = np.zeros(SLOTS, bool)
        for s in tokens.slots:
            used[s] = True
        slots = np.flatnonzero(used)
        place = np.zeros(SLOTS, np.int32)
        place[slots] = np.arange(len(slots))
        # In the place of the slots, so that the driver holds them once.
        local = tokens.slots
        for k, s in enumerate(local):
            local[k] = place[s]
        weights, seen = np.zeros(len(slots)), np.full(len(slots), 1e-6)
        head = np.zeros(len(tokens), bool)
        head[tokens.first] = True
        last, now = tags[:-1][~head[1:]], tags[1:][~head[1:]]
        want = np.array([tags[head].sum(), (~last & now).sum(), (last & ~now).sum(), (last & now).sum()], float)
        for _ in range(rounds):
            e = np.zeros(len(tokens))
            for s in local:
                e += weights[s]
            p, have = all_marginals(e, tokens.first, tokens.size, self.moves)
            rest = tags - p
            g = np.zeros(len(slots))
            for s in local:
                g += np.bincount(s, rest, minlength=len(slots))
            g -= 0.3 * weights
            seen += g * g
            weights += rate * g / np.sqrt(seen)
            h = want - have
            moved += h * h
            self.moves = self.moves + rate * h / np.sqrt(moved)
        self.weights[slots] = weights
        e, weights = np.zeros(len(tokens)), weights.astype(np.float32)
        for s in local:
            e += weights[s]
        x = self.evidence(tokens, all_marginals(e, tokens.first, tokens.size, self.moves)[0])
        # A prior holds the threshold at a largest marginal of one half, since the sample's own marginals are too clear-cut.
        prior, held = np.array([-4.0, 8.0, 0.0]), np.diag([4.0, 4.0, 4.0])
        b = prior
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            b = b + np.clip(np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + held, x.T @ (y - q) - held @ (b - prior)), -2, 2)
        self.final = b
        return self

    def evidence(self, tokens: Tokens, p: np.ndarray | None = None) -> np.ndarray:
        """Per document: 1, the largest marginal, the log of 1 + their sum."""
        if p is None:
            p = marginals(emissions(tokens, self.weights), tokens.first, tokens.size, self.moves)[0]
        rows = tokens.rows
        some = np.flatnonzero(np.diff(rows) > 0)
        out = np.zeros((len(rows) - 1, 3))
        out[:, 0] = 1
        if len(some):
            out[some, 1] = np.maximum.reduceat(p, rows[some])
            out[some, 2] = np.log1p(np.add.reduceat(p, rows[some]))
        return out

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        tokens = Tokens(data, off)
        p = marginals(emissions(tokens, self.weights), tokens.first, tokens.size, self.moves)[0]
        score = 1 / (1 + np.exp(-np.clip(self.evidence(tokens, p) @ self.final, -30, 30)))
        spans: list[list[dict]] = [[] for _ in range(len(off) - 1)]
        hot = np.flatnonzero(p >= 0.5)
        if len(hot):
            chars, w = code_points(data), tokens.words
            row = np.searchsorted(w.rows, hot, "right") - 1
            chain = np.searchsorted(tokens.first, hot, "right")
            ends = np.flatnonzero(np.concatenate(((np.diff(hot) > 1) | (np.diff(chain) > 0), [True])))
            at = 0
            for z in ends.tolist():
                a, b, r = hot[at], hot[z], row[at]
                base = chars[off[r]]
                spans[r].append({"start": int(chars[w.start[a]] - base), "end": int(chars[w.end[b]] - base), "p": float(p[a : b + 1].max())})
                at = z + 1
        return score, spans


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = 1200, fit_bytes: int = 1 << 15) -> Model:
    """A model from at most fit_docs labelled documents of each class of at most fit_bytes bytes, taken in order of a hash of their ids.

    labels: doc_id, toxic; rows with a null in either are left out, and of several the largest label counts.
    """
    spark = docs.sparkSession
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for y in (0, 1):
        part = labels.filter((F.col("toxic") > 0) if y else (F.col("toxic") <= 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
        chosen = part if chosen is None else chosen.union(part)
    chosen = [(r[0], int(r[1] > 0)) for r in chosen.collect()]
    if not chosen:
        return Model()
    ids = spark.createDataFrame(chosen, "doc_id long, toxic int")  # at most 2 * fit_docs rows
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= fit_bytes).join(F.broadcast(ids), "doc_id").collect()
    rows = {r["text"]: r["toxic"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))}
    model = Model().fit(list(rows), list(rows.values()))
    del rows
    trim()
    return model


def toxicity(docs: DataFrame, model: Model, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with score (0 to 1) and toxic_spans (code point offsets, largest marginal). Null text is empty and has the score of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.moves, model.final))

    def make():
        m = Model()
        m.weights, m.moves, m.final = shared.value

        def row(b: pa.RecordBatch) -> list:
            data, off = view(column(b, "text"))
            score, spans = [], []
            for a, z in groups(off, 1 << 20):
                s, x = m.score(data[off[a] : off[z]], off[a : z + 1] - off[a])
                score.append(s)
                spans += x
            return [np.concatenate(score) if score else np.zeros(0), spans]

        return row

    return extend(docs, COLUMNS, make, drop)


def held_out(ident) -> F.Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fit(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, _model(spark, docs, sf_dir), drop=("text",))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"), "toxic_spans"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that aren't scored as toxic."""
    return toxicity(docs, _model(spark, docs, sf_dir)).filter("score < 0.5").drop(*COLUMNS.fieldNames())
