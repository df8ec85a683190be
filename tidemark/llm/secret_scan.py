"""Secret scan: patterns propose candidates, a character convolutional network judges every one in its context.

The three base kinds are always reported. Wider candidates (runs of 16 or more key characters that hold a
digit or an upper-case letter behind a lower-case one, and touch no base span) are reported where the network's
calibrated probability reaches the threshold of their shape. The network sees a long candidate in
pieces, all of it, and the highest piece decides. A threshold is the highest that keeps the wanted recall on
held-out secrets of its shape, where a secret that yields no candidate counts as missed. The network is trained
on the driver on at most ``MOST_LABELLED`` labelled findings (by hash) and sent to the workers as a few arrays.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "model")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WIDE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_KEYLIKE = re.compile("[0-9]|[a-z][A-Z]")
_HINTS = ("passw", "secret", "token", "key")

# What the network sees at a time: characters before, of and after a piece of a candidate.
BEFORE, PIECE, AFTER = 24, 48, 8
SEEN = BEFORE + PIECE + AFTER
SHAPES = ("short", "plain", "marked")
WIDTHS, FILTERS = (3, 7), 24
MOST_LABELLED = 20_000
RECALL = 0.98
_ALPHABET = "".join(chr(c) for c in range(32, 127)) + "\n"
_CODE = np.full(0x250, len(_ALPHABET) + 1, dtype=np.uint8)  # 0 is padding, the last code any other character
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i + 1
CODES = len(_ALPHABET) + 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind: leftmost non-overlapping matches of each kind that are long enough."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """The base spans and the wide runs that touch none of them."""
    base = base_spans(text)
    wide = []
    for m in _WIDE.finditer(text):
        s, e = m.span()
        if _KEYLIKE.search(text, s, e) and not any(s < b and a < e for a, b, _ in base):
            wide.append((s, e, "model"))
    return sorted([*base, *wide], key=lambda s: (s[0], KINDS.index(s[2]))) if wide else base


def shape(span: str) -> str:
    """Under 20 characters, else letters and digits only, else with other characters."""
    return "short" if len(span) < 20 else "plain" if span.isalnum() else "marked"


def view(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a piece (at most ``PIECE`` characters) and its surroundings, padded to ``SEEN``."""
    parts = (
        text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"),
        text[start:end].ljust(PIECE, "\0"),
        text[end : end + AFTER].ljust(AFTER, "\0"),
    )
    points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4")
    codes = _CODE[np.minimum(points, len(_CODE) - 1)]
    codes[points == 0] = 0
    return codes


def views(text: str, start: int, end: int) -> list[np.ndarray]:
    """All pieces of a candidate; the last one ends with it."""
    begins = [*range(start, end - PIECE, PIECE), max(start, end - PIECE)]
    return [view(text, b, min(end, b + PIECE)) for b in begins]


@dataclass(frozen=True)
class Network:
    """Convolutions over one-hot characters, one per width; maximum over positions; logistic output, calibrated."""

    kernels: tuple[np.ndarray, ...]  # per width: (width, CODES, FILTERS)
    biases: tuple[np.ndarray, ...]
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    offset: float = 0.0
    thresholds: tuple[float, ...] = (0.5,) * len(SHAPES)

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        values, places = [], []
        for kernel, bias in zip(self.kernels, self.biases):
            positions = codes.shape[1] - len(kernel) + 1
            z = np.zeros((len(codes), positions, kernel.shape[2]), dtype=np.float32) + bias
            for k in range(len(kernel)):
                z += kernel[k][codes[:, k : k + positions]]
            at = z.argmax(axis=1)
            places.append(at)
            values.append(np.maximum(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0], 0))
        return np.concatenate(values, axis=1), places

    def logits(self, codes: np.ndarray, chunk: int = 2048) -> np.ndarray:
        parts = [self.pooled(codes[i : i + chunk])[0] @ self.out + self.out_bias for i in range(0, len(codes), chunk)]
        return np.concatenate(parts).astype(np.float64) if parts else np.empty(0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.offset, -40, 40)))

    def scores(self, pieces: list[list[np.ndarray]]) -> np.ndarray:
        """The highest probability among the pieces of every candidate."""
        if not pieces:
            return np.empty(0)
        first = np.cumsum([0, *map(len, pieces[:-1])])
        return np.maximum.reduceat(self.probabilities(np.array([v for p in pieces for v in p])), first)

    def reports(self, span: str, score: float) -> bool:
        return score >= self.thresholds[SHAPES.index(shape(span))]


def _step(state: list[list[np.ndarray]], values: list[np.ndarray], slopes: list[np.ndarray], t: int, rate: float) -> None:
    """One step with moments of first and second order, in place."""
    for (m, v), x, g in zip(state, values, slopes):
        m *= 0.9
        m += 0.1 * g
        v *= 0.999
        v += 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def train(codes: np.ndarray, labels: np.ndarray, epochs: int = 10, batch: int = 128, rate: float = 0.01, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    kernels = [rng.normal(0, 0.1, (w, CODES, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32)
    out_bias = np.zeros(1, dtype=np.float32)
    values = [*kernels, *biases, out, out_bias]
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in values]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for begin in range(0, len(order), batch):
            pick = order[begin : begin + batch]
            x, y = codes[pick], labels[pick]
            net = Network(tuple(kernels), tuple(biases), out, float(out_bias[0]))
            pooled, places = net.pooled(x)
            error = ((1 / (1 + np.exp(-np.clip(pooled @ out + out_bias, -40, 40))) - y) / len(y)).astype(np.float32)
            inner = error[:, None] * out * (pooled > 0)
            kernel_slopes, bias_slopes = [], []
            for i, (kernel, at) in enumerate(zip(kernels, places)):
                part = inner[:, i * FILTERS : (i + 1) * FILTERS]
                slope = np.zeros_like(kernel)
                filters = np.broadcast_to(np.arange(FILTERS), at.shape)
                for k in range(len(kernel)):
                    np.add.at(slope[k], (np.take_along_axis(x, at + k, axis=1), filters), part)
                kernel_slopes.append(slope)
                bias_slopes.append(part.sum(axis=0))
            t += 1
            _step(state, values, [*kernel_slopes, *bias_slopes, pooled.T @ error, error.sum(keepdims=True)], t, rate)
    return Network(tuple(kernels), tuple(biases), out, float(out_bias[0]))


def calibrated(net: Network, codes: np.ndarray, labels: np.ndarray, rounds: int = 50) -> Network:
    """Fit slope and offset of the logits on held-out pieces; targets keep off 0 and 1, so that separable pieces have a finite fit."""
    z, secrets = net.logits(codes), float(labels.sum())
    labels = np.where(labels == 1, (secrets + 1) / (secrets + 2), 1 / (len(labels) - secrets + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - labels) * z).sum() + 1e-3 * (a - 1), (p - labels).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - 0.5 * np.linalg.solve(h, g)
    return replace(net, slope=float(a), offset=float(b))


def hits(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Candidates that hold at least half of a labelled span."""
    return [c for c in candidates(text) if 2 * (min(end, c[1]) - max(start, c[0])) >= end - start]


def constrained(net: Network, findings: list[tuple[str, int, int, int]], recall: float = RECALL) -> Network:
    """The highest threshold per shape (at most 0.98) that reports the ``recall`` of its secrets.

    Secrets that a base kind reports do not count. A secret without a candidate is a miss that no threshold mends:
    it uses up what may be missed. A shape without secrets takes 0.5.
    """
    found: dict[str, list[float]] = {s: [] for s in SHAPES}
    for text, s, e, secret in findings:
        near = hits(text, s, e) if secret else []
        if secret and not any(k in BASE for *_, k in near):
            scores = net.scores([views(text, b, c) for b, c, _ in near])
            found[shape(text[s:e])].append(float(scores.max()) if near else 0.0)
    lowest = lambda p: min(sorted(p)[int((1 - recall) * len(p))], 0.98) if p else 0.5
    return replace(net, thresholds=tuple(lowest(found[s]) for s in SHAPES))


def labelled_findings(rows: int = 12_000, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """(text, start, end, secret 0/1): findings in context, made by a seeded rule.

    Secrets are random keys of several shapes, named or not, from 16 characters on. Others are what looks similar:
    slugs, file names, paths, versions, long numbers, rulers, placeholders, joined words with a digit or capitals.
    """
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = upper + "abcdefghijklmnopqrstuvwxyz"
    chars = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    ends = ("er", "on", "th", "en", "at", "ing", "tion", "ly", "re", "st", "ou", "ea", "an", "ble", "que", "sch")
    word = lambda: "".join(pick(ends) for _ in range(1 + int(rng.integers(4))))
    made = []
    for i in range(rows):
        secret = i % 2
        size = 16 + int(rng.integers(20 if i % 3 else 100))
        if secret:
            body = pick((chars(hexa, size), chars(mixed, size), chars(mixed + "+/", size) + pick(("", "=", "==")), chars(mixed + "_-", size)))
            body = pick(("", "", "", "AKIA", "sk_live_", "ghp_", "key-", "pk_", "eyJ", "xoxb-")) + body
            lead = pick(("token = \"", "secret: ", "api_key=", "Authorization: Bearer ", "password='", "export KEY=", "", " ", "\n", "id="))
        else:
            year = str(1990 + int(rng.integers(40)))
            body = pick(
                (
                    "-".join([word() for _ in range(5)] + [year]),
                    "_".join([word() for _ in range(4)] + [year, "v2"]),
                    "/".join(["", pick(("en", "de", "fr")), year, "05", word(), word() + "-" + word()]),
                    chars("0123456789", size),
                    pick(("", "4", "5")) + chars("0123456789", 15 + int(rng.integers(5))),
                    pick(("4", "5", "3", "6")) + chars("0123456789", 15),
                    chars("0123456789", 8) + pick(("-", "_", "T")) + chars("0123456789", 8),
                    "-".join(chars("0123456789", 4) for _ in range(6)),
                    pick("=-_") * size + "1",
                    "your_token_here_" + pick("123456789") + pick(("", "_replace_me")),
                    "x" * size + "0",
                    "".join(word() for _ in range(8)) + str(int(rng.integers(100))),
                    word() + "=" + year + "/" + word() + "=" + word() + "_" + word(),
                    word() + "".join(word().capitalize() for _ in range(4)),
                    "".join(word().capitalize() for _ in range(5)),
                    pick("-_/").join(word().capitalize() for _ in range(5)),
                    "https/" + word() + "/" + "".join(word().capitalize() for _ in range(3)) + "/" + year,
                    "-".join(word() for _ in range(2)) + "-" + pick(("19", "20", "3")) + pick(("th", "")) + "-" + word(),
                )
            )
            body = body.ljust(16, pick("e0"))
            lead = pick((" ", "\n", "see ", "https://example.com", "file ", "id ", "token = \"", "api_key=", ""))
        left = " ".join(word() for _ in range(8)) + pick((" ", ". ", "\n")) + lead
        right = pick(("\" ", " ", ".\n", "; ", "'\n", "")) + " ".join(word() for _ in range(4))
        made.append((left + body + right, len(left), len(left) + len(body), secret))
    return made


def fit(findings: list[tuple[str, int, int, int]] | None = None, recall: float = RECALL) -> Network:
    """Train on the candidates of two thirds of the labelled findings, calibrate and set thresholds on the rest.

    Of more than ``MOST_LABELLED`` findings the first by hash are taken, so their order does not matter; a
    candidate is a secret where it holds half of one.
    """
    mark = lambda f: zlib.crc32(f"{f[1]}:{f[2]}:{f[0]}".encode("utf-8", "surrogatepass"))
    rows = sorted(findings if findings is not None else labelled_findings(), key=lambda f: (mark(f), f))[:MOST_LABELLED]
    codes, labels, owner = [], [], []
    for i, (text, s, e, secret) in enumerate(rows):
        near = hits(text, s, e)
        for b, c, _ in candidates(text):
            pieces = views(text, b, c)
            codes += pieces
            labels += [float(secret and any((b, c) == n[:2] for n in near))] * len(pieces)
            owner += [i] * len(pieces)
    x, y, held = np.array(codes).reshape(-1, SEEN), np.array(labels, dtype=np.float32), np.array(owner, dtype=int) % 3 == 2
    return constrained(calibrated(train(x[~held], y[~held]), x[held], y[held]), rows[2::3], recall)


def scan(docs: DataFrame, net: Network, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default: all) with ``findings``: ``kind, start, end, score, kept`` by start, then kind.

    Positions are code points, the end is exclusive. Every candidate is scored; base spans are always
    ``kept``, others (``model``) from the threshold of their shape on. Null and empty texts have no findings. Rows are scanned one
    by one, whole; a column named ``findings`` is replaced.
    """
    carried = common.without(docs.select(*(columns or docs.columns)), ["findings"]).columns
    shared = docs.sparkSession.sparkContext.broadcast(  # a few hundred kB, whatever the corpus
        (net.kernels, net.biases, net.out, net.out_bias, net.slope, net.offset, net.thresholds)
    )

    def make(texts: list[str | None]) -> list[pa.Array]:
        own = Network(*shared.value)
        spans, ends, pieces, texts_of = [], [0], [], []
        for t in texts:
            for s, e, kind in candidates(t) if t else ():
                spans.append((s, e, kind))
                pieces.append(views(t, s, e))
                texts_of.append(t)
            ends.append(len(spans))
        scores = own.scores(pieces)
        kept = [kind in BASE or own.reports(t[s:e], p) for t, (s, e, kind), p in zip(texts_of, spans, scores.tolist())]
        rows = pa.StructArray.from_arrays(
            [
                pa.array([k for *_, k in spans], pa.string()),
                pa.array([s for s, _, _ in spans], pa.int64()),
                pa.array([e for _, e, _ in spans], pa.int64()),
                pa.array(scores, pa.float64()),
                pa.array(kept, pa.bool_()),
            ],
            names=["kind", "start", "end", "score", "kept"],
        )
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)]

    schema = "findings array<struct<kind:string,start:bigint,end:bigint,score:double,kept:boolean>>"
    return common.map_texts(docs, text, carried, make, schema)


def explode_findings(found: DataFrame) -> DataFrame:
    """One row per finding that is kept."""
    others = [c for c in found.columns if c != "findings"]
    return found.select(*others, F.explode("findings").alias("_f")).filter("_f.kept").select(*others, "_f.*")
