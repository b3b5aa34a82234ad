"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence is a bag of hashed lower-cased words and word beginnings (so inflected forms of a stem share evidence); its
logit is the sum of their weights and a bias. A document is toxic
if any sentence is (noisy-or), so with ``a`` the sum of softplus(logit) over its sentences the document's score is
``1 - exp(-a)``. Weights are trained from document labels alone; the sentences that carry a document's score are then
located in its text.

NULL and empty texts have no sentences and the score of an empty noisy-or plus the learned leak. Labels that are NULL
are not used; repeated rows count as often as they come. Without rows of both labels every score is the share of label
1 (0 if there are none). Other columns pass through; columns with the names of results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from faultline.llm.textbytes import LOWER, hash_spans, mix, segment_sums, small_batches, spans, text_slices
from faultline.session import materialize

BUCKET_BITS = 20
BEGINNINGS = (4, 5, 6)
EVIDENCE = 3.5
TRAIN_DOCS = 3_000
ROUNDS = 120
LEAST_DOCS = 3
SPARSITY = 5e-5
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 63]] = True


@dataclass(frozen=True)
class Sentences:
    features: np.ndarray  # word x kind of feature
    word_starts: np.ndarray
    word_ends: np.ndarray
    offsets: np.ndarray  # of words per sentence
    doc_offsets: np.ndarray  # of sentences per document


def sentences_of(data: np.ndarray, docs: np.ndarray) -> Sentences:
    """Sentences with at least one word, for a slice of documents in bytes."""
    low = LOWER[data]
    starts, ends, per_doc = spans(_LETTER[data], docs)
    shift = np.uint64(64 - BUCKET_BITS)
    features = np.empty((len(starts), 1 + len(BEGINNINGS)), np.int64)
    features[:, 0] = hash_spans(low, starts, ends) >> shift
    for i, length in enumerate(BEGINNINGS, 1):
        features[:, i] = mix(hash_spans(low, starts, np.minimum(starts + length, ends)) + np.uint64(i)) >> shift
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    doc = np.repeat(np.arange(len(docs) - 1), np.diff(per_doc))
    place = stops[starts] + doc
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    return Sentences(features, starts, ends, np.append(heads, len(starts)), np.searchsorted(heads, per_doc))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    leak: float


def constant(share: float) -> Model:
    """The model that gives every document the same score."""
    amount = -np.log1p(-min(max(share, 1e-12), 1 - 1e-12))
    return Model(np.zeros(1 << BUCKET_BITS, np.float32), -60.0, float(np.log(np.expm1(amount))))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def speaking(hot: np.ndarray, seen: np.ndarray, good: int, bad: int) -> np.ndarray:
    """Features that documents of label 1 hold more often by ``EVIDENCE`` standard errors, from counts of documents."""
    share = np.clip(seen / (good + bad), 1e-9, 1 - 1e-9)
    gap = (hot / good - (seen - hot) / bad) / np.sqrt(share * (1 - share) * (1 / good + 1 / bad))
    return (seen >= LEAST_DOCS) & (gap >= EVIDENCE)


def fit(labels: np.ndarray, importance: np.ndarray, ids: np.ndarray, lengths: np.ndarray, rich: np.ndarray, plain: np.ndarray, used: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Minimise the weighted log loss of the noisy-or over all given documents; an L1 penalty keeps chance features at 0.

    ``ids`` are the used features of the sentences that have any, ``lengths`` their number per sentence, ``rich`` the
    number of such sentences per document and ``plain`` that of the others, which are alike and only counted.
    """
    docs, width, count, size = len(labels), int(used.sum()), len(lengths), len(used)
    sentence, doc_of_sentence = np.repeat(np.arange(count), lengths), np.repeat(np.arange(docs), rich)
    theta = np.zeros(width + 2)  # word weights, bias, leak
    theta[-2:] = -6.0
    scale = importance / importance.sum()
    reach = np.ones_like(theta)
    reach[-2:] = 0.03  # the bias stands in every sentence, so it moves in smaller steps
    penalty = np.full_like(theta, SPARSITY)
    penalty[-2:] = 0

    def loss(at: np.ndarray, slope: bool = False):
        z = at[-2] + np.bincount(sentence, at[ids], count)
        amount = np.bincount(doc_of_sentence, _softplus(z), docs) + plain * _softplus(at[-2]) + _softplus(at[-1])
        amount = np.maximum(amount, 1e-12)
        value = float(scale @ np.where(labels == 1, -np.log(-np.expm1(-amount)), amount))
        if not slope:
            return value
        push = scale * np.where(labels == 1, -1 / np.expm1(np.minimum(amount, 500)), 1.0)
        gz = push[doc_of_sentence] * _sigmoid(z)
        return value, np.concatenate([np.bincount(ids, gz[sentence], width), [gz.sum() + (push @ plain) * _sigmoid(at[-2]), push.sum() * _sigmoid(at[-1])]])

    step, ahead, speed = 64.0, theta, 1.0
    for _ in range(rounds):  # accelerated proximal gradient with backtracking
        value, grad = loss(ahead, slope=True)
        while True:
            new = ahead - step * reach * grad
            new = np.sign(new) * np.maximum(np.abs(new) - step * reach * penalty, 0)
            move = new - ahead
            if loss(new) <= value + grad @ move + (move * move / reach).sum() / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead = new + (speed - 1) / faster * (new - theta)
        if grad @ (new - theta) > 0:
            ahead, faster = new, 1.0  # overshot: start the momentum anew
        theta, speed, step = new, faster, step * 1.5
    weights = np.zeros(size, np.float32)
    weights[used] = theta[:width]
    return Model(weights, float(theta[-2]), float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", per_label: int = TRAIN_DOCS, seed: int = 5) -> Model:
    """Fit on about ``per_label`` documents of label 1 and twice as many of label 0, picked by a hash of the key.

    The picked labels are a bounded table, so they are broadcast and no text is shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("y"))
    found = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(found.values())
    if len(found) < 2:
        return constant(found.get(1, 0) / max(total, 1))
    rate = {0: min(1.0, 2 * per_label / found[0]), 1: min(1.0, per_label / found[1])}
    chance = F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])
    picked = known.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < chance * 1_000_000)
    sample = materialize(docs.select(key, text).join(F.broadcast(picked), key).select(text, "y"), "toxicity-sample").coalesce(8)
    small_batches(sample)
    size = 1 << BUCKET_BITS

    def count(batches):
        seen = np.zeros((2, size), np.int32)
        for part, data, offsets in text_slices(batches, text):
            s = sentences_of(data, offsets)
            words = np.diff(s.offsets[s.doc_offsets])
            doc = np.repeat(np.arange(part.num_rows), words)
            held = np.unique(s.features + doc[:, None] * size)
            label = part.column("y").to_numpy()[held // size]
            for y in (0, 1):
                seen[y] += np.bincount(held[label == y] % size, minlength=size).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"seen": [seen.astype("<i4").tobytes()]})

    seen = np.zeros((2, size), np.int64)
    for row in sample.mapInArrow(count, "seen binary").collect():  # 8 rows of fixed size
        seen += np.frombuffer(row.seen, "<i4").reshape(2, size)
    present = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(present) < 2:
        return constant(found[1] / total)
    used = speaking(seen[1], seen.sum(axis=0), present[1], present[0])
    local = (np.cumsum(used) - 1).astype(np.int32)

    def read(batches):
        for part, data, offsets in text_slices(batches, text):
            s = sentences_of(data, offsets)
            keep = used[s.features]
            per_word = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])
            ids, at = local[s.features[keep]], per_word[s.offsets]
            lengths = np.diff(at)
            rows = []
            for d in range(part.num_rows):
                a, b = s.doc_offsets[d], s.doc_offsets[d + 1]
                mine = lengths[a:b]
                rows.append((ids[at[a] : at[b]].tobytes(), mine[mine > 0].astype("<i4").tobytes(), int((mine == 0).sum())))
            packed, counts, plain = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(packed, pa.binary()), pa.array(counts, pa.binary()), pa.array(plain, pa.int64())], names=["y", "ids", "lengths", "plain"])

    got = sample.mapInArrow(read, "y int, ids binary, lengths binary, plain long").collect()  # bounded by per_label
    labels = np.array([r.y for r in got])
    each = [np.frombuffer(r.lengths, "<i4") for r in got]
    ids = np.concatenate([np.frombuffer(r.ids, np.int32) for r in got]).astype(np.int64)
    importance = np.where(labels == 1, 1 / rate[1], 1 / rate[0])
    return fit(labels, importance, ids, np.concatenate(each), np.array([len(x) for x in each]), np.array([r.plain for r in got]), used)


def score(df: DataFrame, model: Model, text: str = "text", with_spans: bool = True) -> DataFrame:
    """Add ``score``, ``predicted`` and, if asked for, ``toxic_spans``: sentences with a score of 0.5 or more, as code points.

    The first sentence is the one with the highest score where none reaches 0.5 but the document does.
    """
    added = [StructField("score", DoubleType(), False), StructField("predicted", IntegerType(), False)]
    if with_spans:
        piece = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])
        added.append(StructField("toxic_spans", ArrayType(piece)))
    keep = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    schema = StructType([*keep, *added])

    def run(batches):
        for part, data, docs in text_slices(batches, text):
            s = sentences_of(data, docs)
            z = (model.bias + segment_sums(model.weights[s.features].sum(axis=1, dtype=np.float64), s.offsets)) if len(s.features) else np.zeros(0)
            amount = segment_sums(_softplus(z), s.doc_offsets) + _softplus(np.float64(model.leak))
            value = -np.expm1(-amount)
            columns = [pa.array(value), pa.array((value >= 0.5).astype(np.int32))]
            if with_spans:
                columns.append(_spans(s, z, value, data, docs))
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in keep], *columns], names=schema.names)

    return small_batches(df).mapInArrow(run, schema)


def _spans(s: Sentences, z: np.ndarray, value: np.ndarray, data: np.ndarray, docs: np.ndarray) -> pa.Array:
    """Offending sentences of documents that score 0.5 or more."""
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = []
    for d in range(len(docs) - 1):
        a, b = s.doc_offsets[d], s.doc_offsets[d + 1]
        if value[d] < 0.5 or a == b:
            out.append([])
            continue
        hits = [i for i in range(a, b) if z[i] >= 0] or [a + int(np.argmax(z[a:b]))]
        base = points[docs[d]]
        out.append([
            {"start": int(points[s.word_starts[s.offsets[i]]] - base), "end": int(points[s.word_ends[s.offsets[i + 1] - 1]] - base), "score": float(1 / (1 + np.exp(-z[i])))}
            for i in hits
        ])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
