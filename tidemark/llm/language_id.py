"""Language identification by a byte convolutional network in NumPy.

A text is lower-cased and cut into windows of ``LENGTH`` bytes, each with the first bytes of the next
one, so that no byte run is lost at a border. Bytes are embedded, filters of two, three and four
bytes slide over a window, the greatest answer of each filter is kept, and a softmax layer gives the
probabilities of the labels. A document's probabilities are those of its windows, weighted by bytes.

Training runs on the driver on a bounded sample: about ``PER_LABEL`` documents of each label, chosen by a
hash of id and text, at most ``WINDOWS`` windows of each, spread over the whole text. For prediction the
filters are turned into sums over byte pairs, so a position costs two table rows and one addition.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
# Bounds of the training sample and of the number of labels.
PER_LABEL = 600
WINDOWS = 3
MOST_LABELS = 256
EPOCHS = 6
BATCH = 64
RATE = 0.01
SEED = 42
NONE = "und"
_TAPS = max(WIDTHS)
_SIDE = 32
_LETTER = regex.compile(r"\p{L}")
_ADDED = ["lang_pred", "score"]


def encoded(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8"), dtype=np.uint8)


def windows(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Rows of ``LENGTH`` bytes and the next ones a filter needs, zero behind the end; all, or those numbered ``at``."""
    number = max(1, -(-len(data) // LENGTH))
    padded = np.zeros(number * LENGTH + _TAPS - 1, dtype=np.uint8)
    padded[: len(data)] = data
    cut = np.lib.stride_tricks.sliding_window_view(padded, LENGTH + _TAPS - 1)[::LENGTH]
    return cut if at is None else cut[at]


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> Network:
        n = FILTERS * len(WIDTHS)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(labels, draw(256, EMBEDDING, scale=0.5), draw(_TAPS, EMBEDDING, n, scale=0.3) * _reach()[:, None, :], np.zeros(n, np.float32), draw(n, len(labels), scale=0.1), np.zeros(len(labels), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.out_bias]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the byte pair at a position, and the pair two further on, add to every filter."""
        tap = np.einsum("be,tef->tbf", self.embedding, self.filters)
        return tuple((tap[i][:, None, :] + tap[i + 1][None, :, :]).reshape(1 << 16, -1) for i in (0, 2))

    def pooled(self, rows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Greatest answers of the filters per window and, for training, all answers."""
        pair = (rows[:, :-1].astype(np.intp) << 8) | rows[:, 1:]
        answers = tables[0][pair[:, :LENGTH]]
        answers += tables[1][pair[:, 2 : 2 + LENGTH]]
        return answers.max(axis=1) + self.bias, answers

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _reach() -> np.ndarray:
    """Which taps a filter uses: 1 or 0 per (tap, filter)."""
    widths = np.repeat(WIDTHS, FILTERS)
    return (np.arange(_TAPS)[:, None] < widths[None, :]).astype(np.float32)


def _gradient(net: Network, rows: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
    pooled, answers = net.pooled(rows, net.tables())
    best = answers.argmax(axis=1)
    p = net.probabilities(pooled)
    p[np.arange(len(p)), truth] -= 1
    p /= len(p)
    live = np.maximum(pooled, 0)
    back = (p @ net.out.T) * (pooled > 0)
    # Only the bytes under each filter's greatest answer take part.
    under = rows[np.arange(len(rows))[:, None, None], best[:, :, None] + np.arange(_TAPS)]
    d_filters = np.einsum("nf,nfte->tef", back, net.embedding[under]) * _reach()[:, None, :]
    d_embedding = np.zeros_like(net.embedding)
    np.add.at(d_embedding, under, back[:, :, None, None] * net.filters.transpose(2, 0, 1)[None])
    return [d_embedding, d_filters, back.sum(axis=0), live.T @ p, p.sum(axis=0)]


def train(rows: np.ndarray, truth: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Fit by Adam on windows (``rows``) and label numbers; labels count alike, however many windows each has."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(labels, rng)
    if len(labels) < 2:
        return net
    by_label = [np.flatnonzero(truth == i) for i in range(len(labels))]
    most = max(map(len, by_label))
    mean, square = [[np.zeros_like(x) for x in net.parts()] for _ in range(2)]
    steps = max(1, most * len(labels) // BATCH)
    for step in range(1, epochs * steps + 1):
        at = np.array([rng.choice(by_label[i]) for i in rng.integers(len(labels), size=BATCH)])
        rate = RATE * (1 - step / (epochs * steps + 1))
        for x, g, m, v in zip(net.parts(), _gradient(net, rows[at], truth[at]), mean, square):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def sampled_windows(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_label: int = PER_LABEL) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, label numbers and labels of a bounded sample of the rows of ``docs`` with text and label.

    The share of a label follows from its number of rows; rows of equal id and text count once.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    none = np.empty((0, LENGTH + _TAPS - 1), np.uint8), np.empty(0, np.int64), []
    if not counts:
        return none
    place = F.xxhash64(F.col(key).cast("string"), F.col(text))
    cut = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1 << 30, (per_label << 30) // n))])
    chosen = rows.select(F.col(lang).alias("l"), place.alias("h"), F.col(text).alias("t"))
    chosen = chosen.filter(F.pmod("h", F.lit(1 << 30)) < cut[F.col("l")]).groupBy("l", "h").agg(F.first("t").alias("t"))

    def make(texts: list[str | None]) -> list[pa.Array]:
        held = []
        for t in texts:
            data = encoded(t)
            number = max(1, -(-len(data) // LENGTH))
            held.append([w.tobytes() for w in windows(data, np.unique(np.arange(WINDOWS) * number // WINDOWS))])
        return [pa.array(held, pa.list_(pa.binary()))]

    found = sorted((r["l"], r["h"], [bytes(w) for w in r["w"]]) for r in common.map_texts(chosen, "t", ["l", "h"], make, "w array<binary>").collect())
    if not found:
        return none
    labels = sorted({l for l, _, _ in found})
    data = np.frombuffer(b"".join(w for _, _, ws in found for w in ws), np.uint8).reshape(-1, LENGTH + _TAPS - 1)
    return data, np.array([labels.index(l) for l, _, ws in found for _ in ws]), labels


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_label: int = PER_LABEL) -> Network:
    """A network for the labels of ``docs``; without a labelled row it knows no label."""
    return train(*sampled_windows(docs, text, lang, key, per_label))


def held_out(key: Column) -> Column:
    """Rows that no training sees: the CRC-32 of the id as text leaves 1 modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def judge(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and probability of every text; no letter or no label known: ``und`` and 0."""
    able = [i for i, t in enumerate(texts) if t and net.labels and _LETTER.search(t)]
    labels, scores = [NONE] * len(texts), [0.0] * len(texts)
    if not able:
        return labels, scores
    tables = _tables(net)
    sums = np.zeros((len(texts), len(net.labels)))
    queue, of, share = [], [], []

    def flush() -> None:
        rows = np.concatenate(queue)
        owner, weight = np.repeat([o for o, _ in of], [n for _, n in of]), np.concatenate(share)
        for a in range(0, len(rows), _SIDE):
            p = net.probabilities(net.pooled(rows[a : a + _SIDE], tables)[0])
            np.add.at(sums, owner[a : a + _SIDE], p * weight[a : a + _SIDE, None])
        queue.clear(), of.clear(), share.clear()

    held = 0
    for i in able:
        data = encoded(texts[i])
        rows = windows(data)
        weight = np.full(len(rows), LENGTH, dtype=np.float64)
        weight[-1] = len(data) - LENGTH * (len(rows) - 1)
        queue.append(rows), of.append((i, len(rows))), share.append(weight / len(data))
        held += len(rows)
        if held > 1 << 13:
            flush()
            held = 0
    if queue:
        flush()
    for i in able:
        best = int(sums[i].argmax())
        labels[i], scores[i] = net.labels[best], round(min(1.0, float(sums[i, best])), 6)
    return labels, scores


def _tables(net: Network) -> tuple[np.ndarray, np.ndarray]:
    """The pair tables of a network; one worker keeps those of the last."""
    return common.kept("byte pairs", hashlib.md5(b"".join(x.tobytes() for x in net.parts())).hexdigest(), net.tables)


def identify(docs: DataFrame, net: Network, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default: all but the text) with ``lang_pred`` and ``score``.

    Whole texts are read; columns named like a result are replaced. Null text and text without letters get ``und`` and 0.
    Rows are independent, so repeated ids and an empty table need no care.
    """
    carried = common.without(docs.select(*[c for c in (columns if columns is not None else docs.columns) if c != text]), _ADDED).columns

    def make(texts: list[str | None]) -> list[pa.Array]:
        labels, scores = judge(net, texts)
        return [pa.array(labels, pa.string()), pa.array(scores, pa.float64())]

    return common.map_texts(docs, text, carried, make, "lang_pred string, score double")
