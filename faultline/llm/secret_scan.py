"""Secret scans: patterns first, then a character convolutional network over every candidate and its context.

Patterns give the base spans (``assign``, ``access``, ``hex``), each kind leftmost and without overlaps. A candidate is
a long run of token characters with a digit. The network sees its characters and what stands around it; it is trained
on findings that the patterns label, with the left context hidden half of the time so that it also learns what the
secret itself looks like. Scores are calibrated on findings kept out of training, and the threshold is the most
precise one that recalls the wanted share of them. Candidates over the threshold that touch no base span are added as
``cnn``; base spans always stay.

A candidate longer than the window is scored in overlapping windows and keeps its highest score. NULL text counts as
empty; texts are searched whole, offsets are code points, ends exclusive. Repeated rows get equal results. Without
findings of both labels there is no network and nothing is added. Other columns pass through; columns with the names
of results are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from faultline.llm.textbytes import LOWER, small_batches, spans, text_slices

TRAIN_DOCS = 40_000
TRAIN_FINDINGS = 6_000
RECALL = 0.95
LEFT, BODY, RIGHT = 24, 40, 8
STRIDE = 24
WIDTH = LEFT + BODY + RIGHT
TAPS, FILTERS = 5, 24
KINDS = ("assign", "access", "hex", "cnn")
KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST = {"access": 20, "hex": 24, "cnn": 12}

#: The patterns of the base spans, and the characters of a candidate.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"

Span = tuple[int, int, str]


def _byte_set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_HEX, _TOKEN, _DIGIT = _byte_set("0123456789abcdef"), _byte_set(TOKEN_CHARS), _byte_set("0123456789")


def base_spans(text: str) -> list[Span]:
    """Pattern matches in order of start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if any(c.isdigit() for c in m[0])]


def _worth_reading(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which documents of a slice can hold base spans and which can hold candidates, seen from their bytes."""
    count = len(docs) - 1
    base, maybe = np.zeros(count, bool), np.zeros(count, bool)
    raw, low = data.tobytes(), LOWER[data].tobytes()
    for word, where in [*((k, low) for k in KEYS), ("AKIA", raw)]:
        at, word = where.find(word.encode()), word.encode()
        while at >= 0:
            base[np.searchsorted(docs, at, side="right") - 1] = True
            at = where.find(word, at + 1)
    starts, ends, _ = spans(_HEX[data], docs)
    hits = starts[ends - starts >= LEAST["hex"]]
    base[np.searchsorted(docs, hits, side="right") - 1] = True
    starts, ends, _ = spans(_TOKEN[data], docs)
    long = ends - starts >= LEAST["cnn"]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    hits = starts[long & (digits[ends] > digits[starts])]
    maybe[np.searchsorted(docs, hits, side="right") - 1] = True
    return base, maybe


def _windows(text: str, start: int, end: int) -> list[str]:
    """Context and candidate in fixed width: left context, body, right context, padded with spaces that no text has."""
    out = []
    for at in range(start, max(end - BODY, start) + STRIDE, STRIDE):
        if at >= end:
            break
        body = text[at : min(end, at + BODY)]
        left, right = text[max(0, at - LEFT) : at], text[at + len(body) : at + len(body) + RIGHT]
        out.append(left.rjust(LEFT, "\0") + body.ljust(BODY, "\0") + right.ljust(RIGHT, "\0"))
    return out


def _codes(windows: list[str]) -> np.ndarray:
    """Character classes: printable ASCII, white space and other characters; 0 is padding."""
    codes = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, WIDTH)
    out = np.where((codes > 32) & (codes < 127), codes - 31, np.where(codes == 0, 0, np.where(codes <= 32, 1, 96)))
    return out.astype(np.int64)


CLASSES = 97


@dataclass
class Network:
    """One convolution over characters, the maximum per filter in each of three regions, one output."""

    taps: np.ndarray  # tap x class x filter
    shift: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    base: float = 0.0
    threshold: float = 1.0

    def hidden(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros((len(codes), WIDTH - TAPS + 1, FILTERS), np.float32) + self.shift
        for k in range(TAPS):
            total += self.taps[k][codes[:, k : k + WIDTH - TAPS + 1]]
        return total

    def logits(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        for a in range(0, len(codes), 512):
            h = np.maximum(self.hidden(codes[a : a + 512]), 0)
            out[a : a + 512] = np.concatenate([h[:, r].max(axis=1) for r in REGIONS], axis=1) @ self.out + self.bias
        return out

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.base, -40, 40)))


REGIONS = (slice(0, LEFT - TAPS + 1), slice(LEFT - TAPS + 1, LEFT + BODY - TAPS + 1), slice(LEFT + BODY - TAPS + 1, WIDTH - TAPS + 1))


def fit(codes: np.ndarray, labels: np.ndarray, epochs: int = 12, seed: int = 3, recall: float = RECALL) -> Network | None:
    """Train on seven tenths of the findings, calibrate and choose the threshold on the rest, with and without left context."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    cut = max(1, len(labels) * 7 // 10)
    train, held = order[:cut], order[cut:]
    if min(labels[train].sum(), (1 - labels[train]).sum(), labels[held].sum(), (1 - labels[held]).sum()) < 1:
        return None
    net = Network(
        rng.normal(0, 0.1, (TAPS, CLASSES, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.2, 3 * FILTERS).astype(np.float32), 0.0,
    )
    weight = np.where(labels == 1, 0.5 / labels[train].mean(), 0.5 / (1 - labels[train].mean()))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.taps, net.shift, net.out, np.zeros(1, np.float32))]
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            step += 1
            x = codes[part].copy()
            x[np.ix_(rng.random(len(part)) < 0.5, range(LEFT))] = 0
            grads = _gradients(net, x, labels[part], weight[part])
            params = [net.taps, net.shift, net.out, np.array([net.bias], np.float32)]
            for p, g, m in zip(params, grads, moments, strict=True):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                p -= 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
            net.bias = float(params[3][0])
    hidden = codes[held].copy()
    hidden[:, :LEFT] = 0
    _calibrate(net, np.concatenate([codes[held], hidden]), np.concatenate([labels[held], labels[held]]), recall)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    raw = net.hidden(x)
    h = np.maximum(raw, 0)
    tops = [h[:, r].argmax(axis=1) + r.start for r in REGIONS]
    rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
    pooled = np.concatenate([h[rows, t, filters] for t in tops], axis=1)
    push = weight * (1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -40, 40))) - y) / len(x)
    taps, shift = np.zeros_like(net.taps), np.zeros_like(net.shift)
    for i, t in enumerate(tops):  # only the place of each maximum gets a gradient
        g = push[:, None] * net.out[None, i * FILTERS : (i + 1) * FILTERS] * (raw[rows, t, filters] > 0)
        shift += g.sum(axis=0)
        for k in range(TAPS):
            flat = x[rows, t + k] * FILTERS + filters
            taps[k] += np.bincount(flat.ravel(), g.ravel(), CLASSES * FILTERS).reshape(CLASSES, FILTERS)
    return [taps, shift, (pooled.T @ push).astype(np.float32), np.array([push.sum()], np.float32)]


def _calibrate(net: Network, codes: np.ndarray, labels: np.ndarray, recall: float) -> None:
    """Platt scaling by Newton steps with smoothed targets, then the most precise threshold with the wanted recall."""
    z, good = net.logits(codes), labels.sum()
    goal = np.where(labels == 1, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    theta, design = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        curve = design.T @ (design * np.maximum(p * (1 - p), 1e-6)[:, None]) + 1e-4 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(curve, design.T @ (p - goal)), -2, 2)
    net.slope, net.base = float(theta[0]), float(theta[1])
    score = design @ theta
    found = np.sort(score[labels == 1])
    limit = found[int(np.floor((1 - recall) * len(found)))]
    below = score[(labels == 0) & (score < limit)]
    limit = (limit + below.max()) / 2 if len(below) else limit  # as precise, and not tight against the known findings
    net.threshold = float(1 / (1 + np.exp(-np.clip(limit, -40, 40))))


def _overlaps(start: int, end: int, found: list[Span]) -> bool:
    return any(a < end and start < b for a, b, _ in found)


def train(df: DataFrame, text: str = "text", key: str = "doc_id", docs: int = TRAIN_DOCS, findings: int = TRAIN_FINDINGS, seed: int = 13) -> Network | None:
    """Fit on at most ``findings`` candidates per label from about ``docs`` documents, both picked by hash."""
    rows = df.where(F.col(text).isNotNull()).select(key, text)
    share = min(1.0, docs / max(rows.count(), 1))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < share * 1_000_000).select(text)

    def read(batches):
        for part, data, offsets in text_slices(batches, text):
            base, maybe = _worth_reading(data, offsets)
            values = part.column(text)
            windows, labels = [], []
            for i in np.flatnonzero(maybe):
                value = values[int(i)].as_py()
                known = base_spans(value) if base[i] else []
                for a, b in candidates(value):
                    made = _windows(value, a, b)[:1]
                    windows += made
                    labels += [int(_overlaps(a, b, known))] * len(made)
            yield pa.RecordBatch.from_pydict({"window": pa.array(windows, pa.string()), "label": pa.array(labels, pa.int32())})

    found = small_batches(sample).mapInArrow(read, "window string, label int").distinct()
    picked = [found.where(F.col("label") == y).orderBy(F.xxhash64("window"), "window").limit(findings) for y in (0, 1)]
    got = picked[0].unionByName(picked[1]).collect()  # bounded by findings
    got.sort()
    if not got:
        return None
    return fit(_codes([r.window for r in got]), np.array([r.label for r in got]))


def scan(df: DataFrame, network: Network | None, text: str = "text", redact: str | None = None) -> DataFrame:
    """Add ``secrets``: every span with its kind, its place in the text and, for ``cnn``, the calibrated score.

    With ``redact`` the spans are replaced by that mark in the text, overlapping ones together.
    """
    piece = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
    keep = [f for f in df.schema.fields if f.name != "secrets"]
    schema = StructType([*keep, StructField("secrets", ArrayType(piece))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for part, data, offsets in text_slices(batches, text):
            base, maybe = _worth_reading(data, offsets)
            values, found, asked = part.column(text), [[] for _ in range(part.num_rows)], []
            for i in np.flatnonzero(base | maybe).tolist():
                value = values[i].as_py() or ""
                found[i] = base_spans(value) if base[i] else []
                if network is not None and maybe[i]:
                    asked += [(i, a, b, w) for a, b in candidates(value) if not _overlaps(a, b, found[i]) for w in _windows(value, a, b)]
            best: dict[tuple[int, int, int], float] = {}
            if asked:
                for (i, a, b, _), p in zip(asked, network.probability(_codes([w for *_, w in asked])), strict=True):
                    best[i, a, b] = max(best.get((i, a, b), 0.0), float(p))
            extra = [(i, a, b, p) for (i, a, b), p in best.items() if p >= network.threshold] if best else []
            out = [[{"kind": k, "start": a, "end": b, "score": None} for a, b, k in known] for known in found]
            for i, a, b, p in extra:
                out[i].append({"kind": "cnn", "start": a, "end": b, "score": p})
            out = [sorted(x, key=lambda s: (s["start"], KINDS.index(s["kind"]))) for x in out]
            columns = {f.name: part.column(f.name) for f in keep}
            if redact is not None and any(out):
                hidden = [_hidden(values[i].as_py(), out[i], redact) if out[i] else None for i in range(len(out))]
                columns[text] = pc.coalesce(pa.array(hidden, values.type), values)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(out, arrow)], names=schema.names)

    return small_batches(df).mapInArrow(run, schema)


def _hidden(value: str, found: list[dict], mark: str) -> str:
    """The text with its spans replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in found):
        if merged and s[0] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s[1])
        else:
            merged.append(list(s))
    for a, b in merged:
        out += [value[at:a], mark]
        at = b
    return "".join([*out, value[at:]])
