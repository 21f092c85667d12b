"""Language identification by prediction by partial matching over bytes.

For each language a context tree of order 3 counts which byte follows which bytes (A-Z as a-z); escape probabilities
are those of method C. The statistics are frozen after training, so every (context, byte) has one code length: the
longest context that has seen the byte codes it, and each longer known context adds an escape. A text's code length
in a language is the sum over its bytes, in units of 1/1024 bit; the language of the shortest code wins, of equal
ones the first by name.

The trees are compiled into sparse tables: orders 0 and 1 are arrays, and what orders 2 and 3 have seen is found by
hashing, so nothing depends on the number of languages but the work, which grows with it. A model takes some 1.5 MB a language.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexing as lx
from .shared import text_batches

ORDER, SYMBOLS = 3, 256
UNIT = 1024
#: Languages whose costs stand in one table.
GROUP = 4
#: Training documents of a language at most, by hash of their id, and their bytes. Longer texts are not learned from.
MAX_DOCS, MAX_BYTES = 400, 4 << 20


class Index:
    """Places of keys (uint32, each once) in an array, by open addressing; many are looked up at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.shift = np.uint32(32 - max(1, (2 * len(keys) + 1).bit_length()))
        self.mask = (1 << (32 - int(self.shift))) - 1
        self.keys, self.rows = np.zeros(self.mask + 1, np.uint32), np.full(self.mask + 1, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.rows[at[left]] < 0)
            _, first = np.unique(at[left[free]], return_index=True)
            put = left[free[first]]
            self.keys[at[put]], self.rows[at[put]] = keys[put], put
            left = left[self.rows[at[left]] != left]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761) >> self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not there."""
        at = self._slot(keys)
        out = self.rows[at]
        left = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            out[left] = self.rows[at]
            more = (self.keys[at] != keys[left]) & (out[left] >= 0)
            left, at = left[more], at[more]
        return out


def _grams(data: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """The `order` bytes before each byte and the byte, as one number; before a document stand spaces."""
    low = lx.LOWER[data]
    out = low.astype(np.uint32)
    first = offs[:-1]
    for k in range(1, order + 1):
        before = np.full(len(low), 0x20, np.uint32)
        before[k:] = low[:-k] if k < len(low) else []
        for j in range(k):
            at = first + j
            before[at[at < len(low)]] = 0x20
        out |= before << np.uint32(8 * k)
    return out


def _tree(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seen keys, bits of a hit, contexts, bits of an escape) of one order of a language's tree."""
    seen, count = np.unique(keys, return_counts=True)
    contexts, of, kinds = np.unique(seen >> np.uint32(8), return_inverse=True, return_counts=True)
    total = np.bincount(of, weights=count)
    return seen, np.log2((total + kinds)[of]) - np.log2(count), contexts, np.log2(total + kinds) - np.log2(kinds)


class Tables:
    """Code lengths of a few languages, compiled."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        n = len(texts)
        trees = []
        for own in texts:
            data = np.frombuffer(b"".join(own), np.uint8)
            offs = np.concatenate([[0], np.cumsum([len(t) for t in own], dtype=np.int64)]).astype(np.int64)
            trees.append([_tree(_grams(data, offs, k)) for k in range(ORDER + 1)])
        cost = np.full((SYMBOLS, n), np.log2(SYMBOLS))  # order -1: all symbols alike
        for j in range(n):
            self._fill(cost, np.arange(SYMBOLS, dtype=np.uint32), trees[j][0], j, np.full(SYMBOLS, np.log2(SYMBOLS)))
        dense = np.arange(SYMBOLS**2, dtype=np.uint32)
        cost, shorter = np.zeros((len(dense), n)), cost
        for j in range(n):
            self._fill(cost, dense, trees[j][1], j, shorter[dense & 0xFF, j])
        self.one = cost
        self.seen, self.contexts, self.costs, self.escapes = [], [], [], []
        for k in (2, 3):
            keys = np.unique(np.concatenate([t[k][0] for t in trees]))
            contexts = np.unique(keys >> np.uint32(8))
            low = keys & np.uint32((1 << 8 * k) - 1)
            shorter = self._bits(low, k - 1)
            cost, escape = np.zeros((len(keys), n)), np.zeros((len(contexts), n))
            for j in range(n):
                self._fill(cost, keys, trees[j][k], j, shorter[:, j])
                escape[np.searchsorted(contexts, trees[j][k][2]), j] = trees[j][k][3]
            self.seen.append(Index(keys))
            self.contexts.append(Index(contexts))
            self.costs.append(cost)
            self.escapes.append(escape)
        self.one, self.costs, self.escapes = (_units(self.one), [_units(c) for c in self.costs], [_units(e) for e in self.escapes])

    @staticmethod
    def _fill(cost: np.ndarray, keys: np.ndarray, tree: tuple, j: int, shorter: np.ndarray) -> None:
        seen, hit, contexts, escape = tree
        at = np.minimum(np.searchsorted(contexts, keys >> np.uint32(8)), len(contexts) - 1)
        known = contexts[at] == keys >> np.uint32(8) if len(contexts) else np.zeros(len(keys), bool)
        cost[:, j] = shorter + (np.where(known, escape[at], 0.0) if len(contexts) else 0.0)
        cost[np.searchsorted(keys, seen), j] = hit

    def _bits(self, keys: np.ndarray, order: int) -> np.ndarray:
        """The code lengths of (context, byte) pairs, a column for each language."""
        if order == 1:
            return self.one[keys]
        k = order - 2
        row = self.seen[k].find(keys)
        out = self.costs[k][row]
        new = np.flatnonzero(row < 0)
        if len(new):
            context = self.contexts[k].find(keys[new] >> np.uint32(8))
            out[new] = np.where(context[:, None] >= 0, self.escapes[k][context], 0) + self._bits(keys[new] & np.uint32((1 << 8 * order) - 1), order - 1)
        return out


def _units(bits: np.ndarray) -> np.ndarray:
    return np.rint(bits * UNIT).astype(np.int32)


class Model:
    def __init__(self, languages: list[str], tables: list[Tables]) -> None:
        self.languages, self.tables = languages, tables

    def bits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each document (rows) in each language, in units of 1/UNIT bit."""
        out = np.zeros((len(offs) - 1, len(self.languages)), np.int64)
        full = np.flatnonzero(np.diff(offs))
        if len(full):
            keys = _grams(data, offs, ORDER)
            out[full] = np.concatenate([np.add.reduceat(t._bits(keys, ORDER), offs[full], axis=0, dtype=np.int64) for t in self.tables], axis=1)
        return out


def train(samples: dict[str, list[str]]) -> Model | None:
    """samples: language -> texts. None if there is no language."""
    raw = {k: [t.encode() for t in v] for k, v in sorted(samples.items()) if any(v)}
    if not raw:
        return None
    texts = list(raw.values())
    return Model(list(raw), [Tables(texts[i : i + GROUP]) for i in range(0, len(texts), GROUP)])


def _has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    low = lx.LOWER[data]
    total = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])
    has = total[offs[1:]] > total[offs[:-1]]
    for d in np.flatnonzero(~has):
        has[d] = any(map(str.isalpha, data[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace")))
    return has


def chunk_predictions(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
    bits = model.bits(data, offs)
    best = bits.argmin(axis=1)
    with np.errstate(under="ignore"):
        share = 1 / np.exp2(-np.minimum((bits - bits.min(axis=1, keepdims=True)) / UNIT, 1000)).sum(axis=1)
    has = _has_letter(data, offs)
    return [model.languages[k] if h else "und" for k, h in zip(best, has, strict=True)], np.where(has, share, 0.0)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> dict[str, list[str]]:
    """language -> at most max_docs texts of max_bytes in all, those of least id hash.

    Null and empty texts and null languages are left out, as are texts of more than max_bytes; a language that has only
    such gives none. What the driver is sent is about twice that much at most, whatever the input.
    """
    size = F.octet_length(F.col(text_col))
    rows = docs.where(F.col(lang_col).isNotNull() & size.between(1, max_bytes)).select(F.col(lang_col).alias("l"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t"), size.alias("b"))
    counts = {r["l"]: (r["n"], r["b"]) for r in rows.groupBy("l").agg(F.count("*").alias("n"), F.sum("b").alias("b")).collect()}
    if not counts:
        return {}
    # twice the wanted number is expected below the threshold, so that fewer are unlikely
    share = F.create_map(*[x for k, (n, b) in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * min(max_docs / n, max_bytes / b) + 20 / n)))])
    picked = rows.where(F.pmod("h", F.lit(1 << 40)) < share[F.col("l")] * float(1 << 40)).collect()
    out: dict[str, list[str]] = {}
    for lang in counts:
        own = [t for _, t in sorted((r["h"] % (1 << 40), r["t"]) for r in picked if r["l"] == lang)][:max_docs]
        sizes = list(accumulate(len(t.encode()) for t in own))
        out[lang] = [t for t, s in zip(own, sizes, strict=True) if s <= max_bytes]
    return {k: v for k, v in out.items() if v}


def predictions(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score): the language of the whole text's shortest code, and its share among the languages'
    2**-bits.

    A null text, or one without a letter, gives und and 0, as does a model without languages; of equal codes the first
    language by name wins. Very long texts are scored whole. Rows may repeat, each gets its own result; an empty table
    gives an empty result; other columns are not read, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            names, share = [], []
            for i, j, data, offs in lx.chunks(b.column(1), 1 << 20):
                if sent.value is None:
                    names += ["und"] * (j - i)
                    share.append(np.zeros(j - i))
                    continue
                got, own = chunk_predictions(sent.value, data, offs)
                names += got
                share.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(share) if share else np.zeros(0))], names=["_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(lx.trimmed(run), f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)
