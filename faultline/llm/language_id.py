"""Language identification of mixed text: script ranges, per-word scores, Viterbi labels.

A word is a run of letters. Its script leaves only the languages that write that script, its letter trigrams and the
word itself score each of them (naive Bayes over hashed features), and a Viterbi path over the words of a document,
with a penalty for each switch, labels them. Neighbouring words with one label form a span. The document's language
is the one with most letters, its score that language's share of the letters.

Long documents are cut into chunks that are solved for every state before the chunk and then joined, so the path is
that of the whole text. NULL, empty and letterless texts are ``und`` with score 0 and no spans. Repeated rows get the
same answer; ties go to the language that sorts first. Without any training row everything is ``und``. Other columns
pass through, and a column with the name of a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from faultline.llm.textbytes import mix, segment_sums, small_batches, spans, text_slices

BUCKET_BITS = 16
TRAIN_DOCS = 2_000
PENALTY = 10.0
CHUNK = 128
SLICE = 1 << 19
UNKNOWN = "und"
IMPOSSIBLE = np.float32(-1e6)
NO_LETTER, OTHER_SCRIPT = 255, 0

#: Code point ranges of scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))),
)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Script and lower-case form of every code point."""
    script = np.full(0x110000, NO_LETTER, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            script[code] = OTHER_SCRIPT
            low = char.lower()
            if low != char and len(low) == 1:
                lower[code] = ord(low)
    for i, (_, ranges) in enumerate(SCRIPTS, 1):
        for a, b in ranges:
            part = script[a : b + 1]
            part[part == OTHER_SCRIPT] = i
    return script, lower


@dataclass(frozen=True)
class Words:
    """Words of a slice: spans in its code points, their offsets per document, script, and hashed features."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    scripts: np.ndarray
    features: np.ndarray
    feature_offsets: np.ndarray
    doc_starts: np.ndarray


def words_of(texts: list[str]) -> Words:
    script, lower = _tables()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    docs = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = script[codes]
    starts, ends, offsets = spans(kinds != NO_LETTER, docs)
    lengths = ends - starts
    if not len(starts):
        return Words(starts, ends, offsets, np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(1, np.int64), docs)
    # every word is laid out with one boundary mark behind it; the marks of its neighbour stand before it
    at = np.arange(len(starts)) + np.cumsum(lengths) - lengths
    row = np.zeros(int(lengths.sum()) + len(starts) + 2, np.uint64)
    inside = np.ones(len(row) - 2, bool)
    inside[at + lengths] = False
    row[2:][inside] = lower[codes[kinds != NO_LETTER]]
    before = row[:-2].copy()
    before[at] = 0
    second = at[lengths > 0] + 1
    before[second] = 0
    tri = mix((before << np.uint64(42)) ^ (row[1:-1] << np.uint64(21)) ^ row[2:])
    tri[at] = mix(row[2:][at] + np.uint64(1 << 60))
    whole = mix(segment_sums(mix(row[2:] + (np.arange(len(row) - 2) - np.repeat(at, lengths + 1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.append(at, len(row) - 2)))
    shift = np.uint64(64 - BUCKET_BITS)
    features = np.empty(len(tri) + len(starts), np.int64)
    places = at + np.arange(len(starts))
    keep = np.ones(len(features), bool)
    keep[places] = False
    features[keep] = (tri >> shift).astype(np.int64)
    features[places] = (whole >> shift).astype(np.int64)
    return Words(starts, ends, offsets, kinds[starts], features, np.append(places, len(features)), docs)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language, log probabilities
    allowed: np.ndarray  # script x language


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = TRAIN_DOCS, seed: int = 11) -> Model:
    """Fit on about ``per_language`` labelled documents of each language, picked by a hash of the key."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)
    found = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    languages = sorted(found)
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, per_language / found[name]))])
    sample = rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < share[F.col(lang)] * 1_000_000).select(text, lang)
    size, scripts = 1 << BUCKET_BITS, len(SCRIPTS) + 1

    def count(batches):
        totals = np.zeros((len(languages), size), np.int64)
        letters = np.zeros((len(languages), scripts), np.int64)
        for part, _, _ in text_slices(batches, text, SLICE):
            labels = np.array([languages.index(x) for x in part.column(lang).to_pylist()])
            words = words_of([t or "" for t in part.column(text).to_pylist()])
            label = np.repeat(labels, np.diff(words.offsets))
            of = np.repeat(label, np.diff(words.feature_offsets))
            totals += np.bincount(of * size + words.features, minlength=totals.size).reshape(totals.shape)
            letters += np.bincount(label * scripts + words.scripts, weights=words.ends - words.starts, minlength=letters.size).reshape(letters.shape).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"totals": [totals.astype("<i8").tobytes()], "letters": [letters.astype("<i8").tobytes()]})

    parts = small_batches(sample).coalesce(16).mapInArrow(count, "totals binary, letters binary").collect()  # 16 rows of fixed size
    totals = sum(np.frombuffer(p.totals, "<i8").reshape(len(languages), size) for p in parts) + 0.1
    letters = sum(np.frombuffer(p.letters, "<i8").reshape(len(languages), scripts) for p in parts)
    weights = np.log(totals / totals.sum(axis=1, keepdims=True)).T
    shares = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    allowed = (shares >= 0.01).T
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, np.ascontiguousarray(weights, np.float32), allowed)


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY, chunk: int = CHUNK) -> np.ndarray:
    """Best state of every word; documents are the segments between ``offsets``."""
    total, states = scores.shape
    label = np.int8 if states <= 128 else np.int32
    out = np.zeros(total, label)
    if not total:
        return out
    counts = np.diff(offsets)
    pieces = -(-counts // chunk)
    first = np.cumsum(pieces) - pieces
    number = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    begin = np.repeat(offsets[:-1], pieces) + number * chunk
    length = np.minimum(chunk, np.repeat(offsets[1:], pieces) - begin)
    order = np.argsort(-length, kind="stable")
    begin_s, length_s = begin[order], length[order]
    active = [int(np.searchsorted(-length_s, -t, side="left")) for t in range(int(length_s[0]))]
    value = np.full((len(order), states, states), np.float32(-1e30))
    value[:, np.arange(states), np.arange(states)] = 0
    for t, n in enumerate(active):  # the best way from every state before the chunk to every state in it
        v = value[:n]
        np.maximum(v, v.max(axis=2, keepdims=True) - penalty, out=v)
        v += scores[begin_s[:n] + t][:, None, :]
    through = np.empty_like(value)
    through[order] = value
    best = np.zeros((len(counts), states), np.float32)
    came = np.zeros((len(number), states), label)
    for k in range(int(pieces.max())):
        docs = np.flatnonzero(pieces > k)
        ways = best[docs][:, :, None] + through[first[docs] + k]
        came[first[docs] + k] = ways.argmax(axis=1)
        best[docs] = ways.max(axis=1)
    state = best.argmax(axis=1)
    before, last = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    for k in range(int(pieces.max()) - 1, -1, -1):
        docs = np.flatnonzero(pieces > k)
        piece = first[docs] + k
        last[piece] = state[docs]
        state[docs] = before[piece] = came[piece, state[docs]]
    before, last = before[order], last[order]
    value = np.full((len(order), states), np.float32(-1e30))
    value[np.arange(len(order)), before] = 0
    switched, top = np.zeros((total, states), bool), np.zeros(total, label)
    for t, n in enumerate(active):  # again, from the one state that the whole path has before the chunk
        v, at = value[:n], begin_s[:n] + t
        high = v.max(axis=1) - penalty
        top[at] = v.argmax(axis=1)
        switched[at] = v < high[:, None]
        np.maximum(v, high[:, None], out=v)
        v += scores[at]
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at, now = begin_s[:n] + t, last[:n]
        out[at] = now
        last[:n] = np.where(switched[at, now], top[at], now)
    return out


def label_words(words: Words, model: Model, penalty: float = PENALTY) -> np.ndarray:
    """The language index of every word."""
    scores = segment_sums(model.weights[words.features], words.feature_offsets)
    scores = np.where(model.allowed[words.scripts], scores, IMPOSSIBLE)
    return viterbi(scores - scores.max(axis=1, keepdims=True, initial=IMPOSSIBLE), words.offsets, penalty)


def identify(df: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY, with_spans: bool = True) -> DataFrame:
    """Add ``lang_pred``, ``score`` and, if asked for, ``spans`` (start, end in code points, lang)."""
    added = [StructField("lang_pred", StringType(), False), StructField("score", DoubleType(), False)]
    piece = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("lang", StringType())])
    if with_spans:
        added.append(StructField("spans", ArrayType(piece)))
    keep = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    schema = StructType([*keep, *added])
    names = [*model.languages, UNKNOWN]
    count = len(model.languages)

    def run(batches):
        for part, _, _ in text_slices(batches, text, SLICE):
            words = words_of([t or "" for t in part.column(text).to_pylist()])
            n = part.num_rows
            labels = label_words(words, model, penalty) if count else np.zeros(0, np.int8)
            letters = np.zeros((n, max(count, 1)))
            doc = np.repeat(np.arange(n), np.diff(words.offsets))
            if count:
                letters = np.bincount(doc * count + labels, weights=words.ends - words.starts, minlength=n * count).reshape(n, count)
            total = letters.sum(axis=1)
            pick = np.where(total > 0, letters.argmax(axis=1), count)
            columns = [pa.array([names[i] for i in pick], pa.string()), pa.array(letters.max(axis=1) / np.maximum(total, 1))]
            if with_spans:
                columns.append(_span_column(words, labels, doc, names, n, schema["spans"].dataType))
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in keep], *columns], names=schema.names)
        pa.default_memory_pool().release_unused()

    return small_batches(df).mapInArrow(run, schema)


def _span_column(words: Words, labels: np.ndarray, doc: np.ndarray, names: list[str], n: int, _kind) -> pa.Array:
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(labels)) - 1 if len(heads) else heads
    base = words.doc_starts[doc[heads]]
    values = pa.StructArray.from_arrays(
        [pa.array(words.starts[heads] - base), pa.array(words.ends[tails] - base), pa.array([names[i] for i in labels[heads]], pa.string())],
        ["start", "end", "lang"],
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[heads], np.arange(n + 1)).astype(np.int32)), values)
