"""Toxicity by subword bags: word vectors are sums of character n-gram vectors, averaged over a document into a
linear softmax, all trained together.

Every word is the bag of the byte n-grams (3 to 6) of `<word>`, hashed into `2**BITS` vectors, so a misspelt or never
seen word still has the vectors of the n-grams it shares with known words. Vectors and softmax weights are trained
jointly with Adam in numpy on the driver, from a bounded sample of labelled documents (MAX_EACH of either label).
The model that goes to the executors is one number a bucket - the vector's margin between the classes - because a
mean of means is linear; its size is fixed.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexing as lx
from .shared import text_batches

BITS, DIM = 18, 6
SIZES = (3, 4, 5, 6)
#: Labelled documents of each label that training takes at most, by hash of their id, and bytes of their texts.
MAX_EACH, MAX_BYTES = 2500, 32 << 20
EPOCHS, BATCH, RATE, DECAY = 6, 50, 0.02, 1e-5
SHARPNESS = 30.0
#: Neutral words that every document is averaged with, so that a few words alone do not decide.
NEUTRAL = 30
#: Bytes of text scored at once: the n-grams of its words take some forty times as much.
CHUNK_BYTES = 1 << 19


def buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, bounds): the n-grams of word k are bounds[k]:bounds[k + 1]."""
    size = ends - starts
    wide = size + 2
    first = np.concatenate([[0], np.cumsum(wide)])
    flat = np.full(int(first[-1]), 0x3C, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(first[:-1] + 1, size) + inside] = data[np.repeat(starts, size) + inside]
    flat[first[1:] - 1] = 0x3E
    view = lx.loads(flat)
    word = np.repeat(np.arange(len(size)), wide)
    left = np.repeat(first[1:], wide) - np.arange(len(flat))
    keys, owner = [], []
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        keys.append(((view[at] & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n)) * lx.M1 >> np.uint64(64 - BITS))
        owner.append(word[at])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    count = np.bincount(owner_all, minlength=len(size))
    return np.concatenate(keys)[order].astype(np.int64), np.concatenate([[0], np.cumsum(count)])


def bag(data: np.ndarray, offs: np.ndarray):
    """(different words' buckets and bounds, each word's place among them, document bounds) of one chunk."""
    low = lx.LOWER[data]
    starts, ends, bounds = lx.words(low, offs, lx.ALNUM)
    h = lx.word_hashes(low, starts, ends)
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    grams, gram_bounds = buckets(low, starts[first], ends[first])
    return grams, gram_bounds, place, bounds


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Means of the runs of values; an empty run gives zero."""
    count = np.diff(bounds)
    out = np.zeros((len(count), *values.shape[1:]), np.float32)
    full = np.flatnonzero(count)
    if len(full):
        sums = np.add.reduceat(values, bounds[full], axis=0)
        out[full] = sums / count[full].reshape(-1, *[1] * (values.ndim - 1))
    return out


def train(texts: list[str], toxic: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """(margin of each bucket, bias). Without both labels the margin is zero and the score the share of toxic rows."""
    toxic = np.asarray(toxic, np.int64)
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return np.zeros(1 << BITS, np.float32), 0.0 if len(toxic) == 0 else (20.0 if toxic[0] else -20.0)
    rng = np.random.default_rng(seed)
    column = pa.array(texts, pa.large_string())
    docs: list[tuple[np.ndarray, np.ndarray]] = []  # (words as ids, their counts)
    vocabulary: dict[bytes, int] = {}
    for _, _, data, offs in lx.chunks(column):
        low = lx.LOWER[data]
        raw = low.tobytes()
        starts, ends, bounds = lx.words(low, offs, lx.ALNUM)
        h = lx.word_hashes(low, starts, ends)
        _, first, place = np.unique(h, return_index=True, return_inverse=True)
        ids = np.array([vocabulary.setdefault(raw[starts[k] : ends[k]], len(vocabulary)) for k in first], np.int64)
        for d in range(len(offs) - 1):
            docs.append(np.unique(ids[place[bounds[d] : bounds[d + 1]]], return_counts=True))
    joined = np.frombuffer(b"".join(vocabulary), np.uint8)
    length = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
    stop = np.cumsum(length)
    parts = [buckets(joined, stop[i : i + 20_000] - length[i : i + 20_000], stop[i : i + 20_000]) for i in range(0, len(length), 20_000)]
    grams = np.concatenate([g.astype(np.int32) for g, _ in parts])
    gram_bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])
    del parts, vocabulary, joined
    vectors = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
    weights, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    m1, m2 = np.zeros_like(vectors), np.zeros_like(vectors)
    w1, w2 = np.zeros_like(weights), np.zeros_like(weights)
    b1, b2 = np.zeros_like(bias), np.zeros_like(bias)
    there, places = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int64)
    tick = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            tokens = np.concatenate([docs[d][0] for d in own])
            share = np.concatenate([docs[d][1] / (NEUTRAL + docs[d][1].sum()) for d in own]).astype(np.float32)
            owner = np.repeat(np.arange(len(own)), [len(docs[d][0]) for d in own])
            words, place = np.unique(tokens, return_inverse=True)
            count = gram_bounds[words + 1] - gram_bounds[words]
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(gram_bounds[words], count)
            own_grams = grams[at]
            there[own_grams] = True
            used = np.flatnonzero(there)
            there[used] = False
            places[used] = np.arange(len(used))
            slot = places[own_grams]
            wb = np.concatenate([[0], np.cumsum(count)])
            own_vectors = vectors[used]
            word_vec = _means(own_vectors[slot], wb)
            doc_vec = np.zeros((len(own), DIM), np.float32)
            for c in range(DIM):
                doc_vec[:, c] = np.bincount(owner, weights=word_vec[place, c] * share, minlength=len(own))
            logits = SHARPNESS * doc_vec @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), toxic[own]] -= 1
            p /= len(own)
            g_doc = SHARPNESS * p @ weights.T
            g_word = np.zeros((len(words), DIM), np.float32)
            g_gram = np.zeros((len(used), DIM), np.float32)
            for c in range(DIM):
                g_word[:, c] = np.bincount(place, weights=g_doc[owner, c] * share, minlength=len(words)) / np.maximum(1, count)
                g_gram[:, c] = np.bincount(slot, weights=np.repeat(g_word[:, c], count), minlength=len(used))
            tick += 1
            fix1, fix2 = 1 - 0.9**tick, 1 - 0.99**tick
            g_gram += DECAY * own_vectors
            first, second = 0.9 * m1[used] + 0.1 * g_gram, 0.99 * m2[used] + 0.01 * g_gram**2
            m1[used], m2[used] = first, second
            vectors[used] = own_vectors - RATE * (first / fix1) / (np.sqrt(second / fix2) + 1e-6)
            for x, g, a, b in ((weights, SHARPNESS * doc_vec.T @ p, w1, w2), (bias, p.sum(axis=0), b1, b2)):
                a[:] = 0.9 * a + 0.1 * g
                b[:] = 0.99 * b + 0.01 * g**2
                x -= RATE * (a / fix1) / (np.sqrt(b / fix2) + 1e-6)
    seen = m2.any(axis=1)
    vectors[~seen] = 0
    return (SHARPNESS * vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def chunk_scores(model: tuple[np.ndarray, float], data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    margin, bias = model
    grams, gram_bounds, place, bounds = bag(data, offs)
    word = _means(margin[grams], gram_bounds) if len(gram_bounds) > 1 else np.zeros(0, np.float32)
    n = np.diff(bounds)
    x = _means(word[place].astype(np.float64), bounds) * (n / (n + NEUTRAL)) + bias
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_each: int = MAX_EACH, max_bytes: int = MAX_BYTES) -> tuple[list[str], np.ndarray]:
    """Of either label at most max_each labelled ids, and texts of max_bytes in all, those of least id hash. Null ids,
    texts or labels are left out; of clashing labels of one id 1 counts; texts of one id all get its label."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_l")).agg(F.max(label_col).cast("int").alias("_y"))
    picked = known.where("_y = 0").orderBy(F.xxhash64("_l"), "_l").limit(max_each).unionByName(known.where("_y = 1").orderBy(F.xxhash64("_l"), "_l").limit(max_each))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_l"), F.col(text_col).alias("_t"))
    # ids and sizes first, so that only texts within the bound come to the driver; at most 2 * max_each rows
    sizes = texts.join(F.broadcast(picked), "_l").groupBy("_l", "_y").agg(F.sum(F.octet_length("_t")).alias("b")).withColumn("h", F.xxhash64("_l")).collect()
    taken = []
    for y in (0, 1):
        own = sorted((r["h"], r["_l"], r["b"]) for r in sizes if r["_y"] == y)
        taken += [(i, y) for (_, i, _), total in zip(own, accumulate(b for *_, b in own), strict=True) if total <= max_bytes]
    if not taken:
        return [], np.zeros(0, np.int64)
    chosen = spark.createDataFrame(taken, f"_l {docs.schema[id_col].dataType.simpleString()}, _y int")
    rows = texts.join(F.broadcast(chosen), "_l").select("_l", "_t", "_y").collect()
    rows = sorted({(r["_l"], r["_t"], r["_y"]) for r in rows})
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_each: int = MAX_EACH) -> tuple[np.ndarray, float]:
    """Train on the sample; the two labels' shares among all labelled rows set the prior that the bias carries."""
    texts, y = sample(docs, labels, id_col, text_col, label_col, max_each)
    margin, bias = train(texts, y)
    lx.trim()
    if len(y) and 0 < y.sum() < len(y):
        share = labels.where(F.col(label_col).isin(0, 1)).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
        bias += float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return margin, bias


def scores(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row, from its whole text, however long.

    Null and empty texts, and texts without words, get the score of the bias alone. Equal texts score the same; rows
    may repeat, each gets its own result; an empty table gives an empty result; other columns are not read, whatever
    their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = [chunk_scores(sent.value, data, offs) for _, _, data, offs in lx.chunks(b.column(1), CHUNK_BYTES)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(lx.trimmed(run), f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score `threshold` or more; all columns stay and no row moves. A row that scores the
    threshold itself goes. Null and empty texts score the bias alone; an empty table stays empty. A model that has seen no
    label keeps every row."""
    if not model[1] and not model[0].any():
        return docs
    sent, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            found = [chunk_scores(sent.value, data, offs) for _, _, data, offs in lx.chunks(b.column(where), CHUNK_BYTES)]
            yield b.filter(pa.array(np.concatenate(found) < threshold if found else np.zeros(0, bool)))

    return text_batches(docs).mapInArrow(lx.trimmed(run), docs.schema)
