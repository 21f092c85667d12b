"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams against windows of training words.

Words are runs of digits, letters a-z after lower-casing A-Z, and non-ASCII characters. Every window of `n` words of
an item is a gram; an item of fewer words is one gram of its own length. A document word is hit if it lies in any
occurrence of a gram. Hash hits are verified on the words' bytes.

The gram set is broadcast when its measured size is within MAX_GRAMS. A larger benchmark is joined instead: document
windows go through a bitmap of fixed size built from the grams, those that pass are shuffled and joined with the gram
table, and the hits come back by document.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexing as lx
from .shared import cut, text_batches, unused

N = 10
#: Grams (about 150 bytes each) that are broadcast at most.
MAX_GRAMS = 400_000
BITS = 22


def _words(data: np.ndarray, offs: np.ndarray):
    low = lx.LOWER[data]
    starts, ends, bounds = lx.words(low, offs, lx.ALNUM)
    return low, starts, ends, bounds, lx.word_hashes(low, starts, ends)


def item_grams(texts: pa.Array, n: int = N):
    """(item row, length in words, hash, words joined by one space) of every gram of a batch of items."""
    for i, _, data, offs in lx.chunks(texts):
        low, starts, ends, bounds, h = _words(data, offs)
        win, raw = lx.Windows(h), low.tobytes()
        for d in range(len(offs) - 1):
            a, b = int(bounds[d]), int(bounds[d + 1])
            length = min(n, b - a)
            for s in range(a, b - length + 1) if length else ():
                key = int(win.at(np.array([s]), length)[0])
                yield i + d, length, key, b" ".join(raw[starts[k] : ends[k]] for k in range(s, s + length))


def grams_table(items: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """(item string, len int, key long, gram binary), one row for each different gram of an item."""

    def make(batches):
        for b in batches:
            ids, rows = b.column(0).to_pylist(), list(item_grams(b.column(1), n))
            yield pa.RecordBatch.from_arrays([pa.array([ids[r[0]] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array(np.array([r[2] for r in rows], np.uint64).view(np.int64), pa.int64()), pa.array([r[3] for r in rows], pa.binary())], names=["item", "len", "key", "gram"])

    return items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(lx.trimmed(make), "item string, len int, key bigint, gram binary").distinct()


class GramSet:
    """The grams of one length class, as sorted hashes with a bitmap before them."""

    def __init__(self, rows: list[tuple[str | None, int, int, bytes]]) -> None:
        self.items: dict[tuple[int, bytes], list[str | None]] = defaultdict(list)
        keys: dict[int, set[int]] = defaultdict(set)
        for item, length, key, gram in rows:
            self.items[(length, gram)].append(item)
            keys[length].add(key)
        self.keys = {n: np.sort(np.array(list(k), np.int64).view(np.uint64)) for n, k in keys.items()}
        self.maps = {}
        for n, k in self.keys.items():
            self.maps[n] = np.zeros(1 << BITS, bool)
            self.maps[n][k & np.uint64((1 << BITS) - 1)] = True

    def passed(self, bounds: np.ndarray, win: lx.Windows):
        """(length, window starts, hashes) of the windows whose hash is in the set."""
        for n, keys in self.keys.items():
            at = lx.window_starts(bounds, n)
            h = win.at(at, n)
            near = self.maps[n][h & np.uint64((1 << BITS) - 1)]
            at, h = at[near], h[near]
            ok = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
            yield n, at[ok], h[ok]


def _hit_rows(grams: GramSet, data: np.ndarray, offs: np.ndarray):
    """For each document of a chunk: (words, hit mask or None, items)."""
    low, starts, ends, bounds, h = _words(data, offs)
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    who: dict[int, set] = defaultdict(set)
    raw = None
    for n, at, _ in grams.passed(bounds, lx.Windows(h)):
        raw = raw if raw is not None or not len(at) else low.tobytes()
        for s in at.tolist():
            gram = b" ".join(raw[starts[k] : ends[k]] for k in range(s, s + n))
            if (n, gram) in grams.items:
                d = int(np.searchsorted(bounds, s, "right")) - 1
                found[d].append((s - int(bounds[d]), n))
                who[d].update(x for x in grams.items[(n, gram)] if x is not None)
    for d in range(len(offs) - 1):
        size = int(bounds[d + 1] - bounds[d])
        mask = None
        if d in found:
            a = np.array(found[d])
            mask = lx.covered(size, a[:, 0], a[:, 0] + a[:, 1])
        yield size, mask, who.get(d, ())


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N, max_grams: int = MAX_GRAMS) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts, on either side, have no words; an item without words matches nothing; an item given twice counts as one
    item of that id. The words of an item with a null id are hit like others, but it is in neither n_items nor the
    digest. Rows may repeat: each gets its own result. Very long texts are scanned whole. No documents, or no items,
    give no hits. Further columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    table = cut(grams_table(items, item_col, item_text, n))
    if table.count() > max_grams:
        return _joined(docs, table, id_col, text_col)
    sent = spark.sparkContext.broadcast(GramSet([(r["item"], r["len"], r["key"], bytes(r["gram"])) for r in table.collect()]))

    def scan(batches):
        for b in batches:
            out = [[], [], [], []]
            for _, _, data, offs in lx.chunks(b.column(1)):
                for size, mask, who in _hit_rows(sent.value, data, offs):
                    for col, v in zip(out, (size, 0 if mask is None else int(mask.sum()), len(who), digest(who)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], names=[b.schema.names[0], "n_words", "n_hit", "n_items", "items_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(lx.trimmed(scan), f"`{id_col}` {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string").withColumn("contaminated", F.col("n_hit") > 0)


def _joined_spans(keyed: DataFrame, table: DataFrame) -> DataFrame:
    """(_e, at, who) of the hit rows of keyed (_e, _t): spans (at, len) and items, by a shuffled join."""
    spark = keyed.sparkSession
    bits, lengths = 26, [r["len"] for r in table.select("len").distinct().collect()]
    slot = F.col("key").bitwiseAND((1 << bits) - 1)
    words = table.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("m")).toPandas()
    seen = np.zeros(1 << (bits - 6), np.uint64)  # a bit for each slot, 8 MB whatever the benchmark
    seen[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(seen)

    def windows(batches):
        packed = sent.value
        for b in batches:
            for i, _, data, offs in lx.chunks(b.column(1)):
                low, starts, ends, bounds, h = _words(data, offs)
                win, raw = lx.Windows(h), low.tobytes()
                for n in lengths:
                    at = lx.window_starts(bounds, n)
                    k = win.at(at, n)
                    slot = k & np.uint64((1 << bits) - 1)
                    near = (packed[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
                    at, k = at[near], k[near]
                    d = np.searchsorted(bounds, at, "right") - 1
                    gram = [b" ".join(raw[starts[x] : ends[x]] for x in range(s, s + n)) for s in at.tolist()]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + d)), pa.array(at - bounds[d]), pa.array(np.full(len(at), n, np.int32)), pa.array(k.view(np.int64)), pa.array(gram, pa.binary())], names=["_e", "at", "len", "key", "gram"])

    found = keyed.select("_e", "_t").mapInArrow(windows, "_e bigint, at bigint, len int, key bigint, gram binary").join(table, ["len", "key", "gram"])
    return found.groupBy("_e").agg(F.collect_set(F.struct("at", "len")).alias("at"), F.array_sort(F.collect_set("item")).alias("who"))


def _joined(docs: DataFrame, table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """hits() by a shuffled join, for a benchmark whose grams are not to be broadcast."""
    keyed = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).withColumn("_e", F.monotonically_increasing_id()))
    by_doc = _joined_spans(keyed.select("_e", "_t"), table)

    def finish(batches):
        import pandas as pd  # here alone, as every worker would hold it otherwise

        for pdf in batches:
            n_words, n_hit = [], []
            for t, at in zip(pdf["_t"], pdf["at"], strict=True):
                raw = (t or "").encode()
                _, starts, _, _, _ = _words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                n_words.append(len(starts))
                a = np.array([(x["at"], x["len"]) for x in at] if at is not None else [], np.int64).reshape(-1, 2)
                n_hit.append(int(lx.covered(len(starts), a[:, 0], a[:, 0] + a[:, 1]).sum()))
            yield pd.DataFrame({"_id": pdf["_id"], "n_words": n_words, "n_hit": n_hit, "who": pdf["who"]})

    kind = docs.schema[id_col].dataType.simpleString()
    out = keyed.join(by_doc, "_e", "left").select("_id", "_t", "at", F.coalesce("who", F.array().cast("array<string>")).alias("who")).mapInPandas(finish, f"_id {kind}, n_words bigint, n_hit bigint, who array<string>")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_hit", F.size("who").cast("long").alias("n_items"), F.sha2(F.array_join("who", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def cleaned(docs: DataFrame, items: DataFrame, text_col: str = "text", n: int = N, most_hit: float = 0.0, max_grams: int = MAX_GRAMS) -> DataFrame:
    """docs without contaminated rows: a row goes when more than `most_hit` of its words are hit. All columns stay.

    Null and empty texts stay; rows that repeat stay or go together; a null item_id makes no difference. An empty table
    on either side is no special case.

    The decision is made inside the scan, so no row moves. With a benchmark too large to broadcast rows are numbered,
    and those that hits() finds by its join go by their numbers.
    """
    table = cut(grams_table(items, "item_id", "text", n))
    if table.count() > max_grams:
        row = unused(docs, "_row")
        rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
        gone = _joined(rows, table, row, text_col).where(F.col("n_hit") > most_hit * F.col("n_words")).select(row)
        return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    sent = docs.sparkSession.sparkContext.broadcast(GramSet([(r["item"], r["len"], r["key"], bytes(r["gram"])) for r in table.collect()]))
    where = docs.columns.index(text_col)

    def scan(batches):
        for b in batches:
            keep = [mask is None or mask.sum() <= most_hit * size for _, _, data, offs in lx.chunks(b.column(where)) for size, mask, _ in _hit_rows(sent.value, data, offs)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return text_batches(docs).mapInArrow(lx.trimmed(scan), docs.schema)


def _without(raw: np.ndarray, mask: np.ndarray) -> str:
    """The text (as bytes) without the words of the mask."""
    _, starts, ends, _, _ = _words(raw, np.array([0, len(raw)]))
    out, at = [], 0
    for k in np.flatnonzero(mask):
        out.append(raw[at : starts[k]].tobytes())
        at = ends[k]
    return b"".join([*out, raw[at:].tobytes()]).decode()


def _removed_joined(docs: DataFrame, table: DataFrame, text_col: str) -> DataFrame:
    """removed_spans() by a shuffled join."""
    row = unused(docs, "_e")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    spans = _joined_spans(rows.select(F.col(row).alias("_e"), F.col(text_col).alias("_t")), table).select(F.col("_e").alias(row), "at")
    where = docs.columns.index(text_col)

    def scan(batches):
        for b in batches:
            texts = b.column(where).to_pylist()
            for i, at in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if at:
                    raw = np.frombuffer(texts[i].encode(), np.uint8)
                    a = np.array([(x["at"], x["len"]) for x in at], np.int64)
                    size = len(_words(raw, np.array([0, len(raw)]))[1])
                    texts[i] = _without(raw, lx.covered(size, a[:, 0], a[:, 0] + a[:, 1]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == where else c for k, c in enumerate(b.columns[:-1])], names=b.schema.names[:-1])

    joined = rows.join(spans, row, "left").select(*[rows[c] for c in docs.columns], spans["at"].alias(unused(docs, "_at")))
    return text_batches(joined).mapInArrow(lx.trimmed(scan), docs.schema)


def removed_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", n: int = N, max_grams: int = MAX_GRAMS) -> DataFrame:
    """docs with hit words cut out of the text instead of rows dropped; the text around a cut is kept as it is."""
    table = cut(grams_table(items, "item_id", "text", n))
    if table.count() > max_grams:
        return _removed_joined(docs, table, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(GramSet([(r["item"], r["len"], r["key"], bytes(r["gram"])) for r in table.collect()]))
    where = docs.columns.index(text_col)

    def scan(batches):
        for b in batches:
            texts = b.column(where).to_pylist()
            for i, _, data, offs in lx.chunks(b.column(where)):
                for d, (_, mask, _) in enumerate(_hit_rows(sent.value, data, offs)):
                    if mask is None:
                        continue
                    texts[i + d] = _without(data[offs[d] : offs[d + 1]], mask)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == where else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return text_batches(docs).mapInArrow(lx.trimmed(scan), docs.schema)
