"""Substring dedup by recompression: repeated passages are found through symbols that equal texts must share.

Levels of recompression rename a text's words: first each run of one symbol gets a name, then each pair whose left
symbol falls in one half of the alphabet and whose right symbol falls in the other, until symbols reach half a window. Names and halves are hashes of the symbols alone, so a name means the same everywhere and naming needs no
exchange; whether a name is shared is settled by Spark rounds over all documents. A symbol depends on a known stretch
of words around it, its context; wherever these words stand, the same symbol stands.

Each window of `window` words elects the highest symbol of which it holds half a window of words from its context's
first on, of equal ones that of greatest hash, of those the first. Equal windows elect the same symbol at the same
place. So a window can repeat only if its symbol, named with these words, is shared:

1. naming round: elected symbols, each with the range of windows that elected it and a 128-bit digest (BLAKE2b) of the
   words under them, its span, go through one count by name; names seen once end there;
2. verifying round: a shared name's spans are compared by the digests of their words. A span that stands in two places
   repeats as a whole: passages copied many times are settled here, a row a symbol;
3. extending round: where one name has different spans, the windows of one place of each span are digested and
   counted: these are the repeats that end inside a span;
4. repeated windows are merged to ranges, which come back by document, and each document is cut in one pass.

Nothing is held equal by the hash of a symbol alone, and a clash of names costs work but no result. Counts are combined before
their shuffles. What comes back to documents is a join by document, broadcast only when its counted size is small.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lexing as lx
from .shared import cut, matching, maybe_broadcast, release, text_batches

WINDOW = 35
_FAR = 1 << 40
_LOW = np.uint64(0xFFFFFFFF)
#: Windows of a document that are merged to ranges at once.
ISLAND = 1 << 16


def symbols(h: np.ndarray, bounds: np.ndarray, longest: int):
    """(level, first word, name, context's first word, word after its last) of the symbols of a chunk, level after level,
    as long as any context holds `longest` words at most. Level 0 has the words themselves."""
    n = len(h)
    name, lo, hi = h.copy(), np.arange(n), np.arange(n) + 1
    start = np.arange(n)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    yield 0, start, name, lo, hi
    level = 0
    while len(name) > 1:
        level += 1
        # runs: a symbol that stays single depends on both its neighbours too
        same = np.zeros(len(name), bool)
        same[1:] = (name[1:] == name[:-1]) & (of[1:] == of[:-1])
        first = np.flatnonzero(~same)
        length = np.diff(np.append(first, len(name)))
        last = first + length - 1
        left, right = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
        has_l, has_r = (first > 0) & (of[left] == of[first]), (last + 1 < len(name)) & (of[right] == of[last])
        lo, hi = np.where(has_l, np.minimum(lo[left], lo[first]), -_FAR), np.where(has_r, np.maximum(hi[right], hi[last]), _FAR)
        run = length > 1
        name = np.where(run, lx._mix(name[first] ^ (length.astype(np.uint64) << np.uint64(32)) ^ np.uint64(level)), name[first])
        start, of = start[first], of[first]
        # pairs: left half then right half; two such pairs never overlap
        half = (lx._mix(name ^ np.uint64(0xA0761D6478BD642F + level)) >> np.uint64(63)).astype(bool)
        nxt = np.zeros(len(name), bool)
        nxt[:-1] = of[1:] == of[:-1]
        pair = half & nxt
        pair[:-1] &= ~half[1:]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        keep = np.flatnonzero(~second)
        paired, lean = pair[keep], half[keep]  # a single symbol of the left half saw its right neighbour, one of the right half its left
        after, before = np.minimum(keep + 1, len(name) - 1), np.maximum(keep - 1, 0)
        has_after, has_before = nxt[keep], (keep > 0) & nxt[before]
        new_hi = np.where(lean, np.where(has_after, np.maximum(hi[keep], hi[after]), _FAR), hi[keep])
        new_lo = np.where(paired, np.minimum(lo[keep], lo[after]), np.where(lean, lo[keep], np.where(has_before, np.minimum(lo[keep], lo[before]), -_FAR)))
        name = np.where(paired, lx._mix(name[keep] * lx.M1 + name[after] * lx.M2 + np.uint64(level)), name[keep])
        lo, hi, start, of = new_lo, new_hi, start[keep], of[keep]
        fits = (hi - lo <= longest) & (lo >= bounds[of]) & (hi <= bounds[of + 1])
        if not fits.any():
            return
        new = fits & (paired | run[keep])
        yield level, start[new], name[new], lo[new], hi[new]


def elected(h: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, first windows, windows after the last): one row for each elected symbol of a chunk, windows by start."""
    n, at, half = len(h), lx.window_starts(bounds, window), window // 2 + 1
    z = np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), z, z
    # best[k][s] holds for the windows s to s + 2**k - 1
    best = [np.zeros(n, np.uint64) for _ in range((window - half + 1).bit_length())]
    named: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    d0, d1 = bounds[:-1], bounds[1:] - window
    for level, start, name, lo, _ in symbols(h, bounds, half):
        level = min(level, 31)
        rank = np.uint64(level) << np.uint64(59) | (lx._mix(name ^ np.uint64(level)) >> np.uint64(37)) << np.uint64(32) | (_LOW - start.astype(np.uint64))
        named.append((start, name, lo))
        of = np.searchsorted(bounds, lo, "right") - 1
        a, b = np.maximum(lo + half - window, d0[of]), np.minimum(lo, d1[of])
        ok = a <= b
        a, b, rank = a[ok], b[ok], rank[ok]
        k = np.frexp(b - a + 1)[1] - 1
        for j in range(len(best)):
            own = k == j
            np.maximum.at(best[j], a[own], rank[own])
            np.maximum.at(best[j], b[own] - (1 << j) + 1, rank[own])
    for j in range(len(best) - 1, 0, -1):
        step = 1 << (j - 1)
        np.maximum(best[j - 1], best[j], out=best[j - 1])
        if step < n:
            np.maximum(best[j - 1][step:], best[j][:-step], out=best[j - 1][step:])
    chosen = best[0][at]
    edge = np.ones(len(at), bool)
    edge[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(edge)
    stop = np.append(first[1:], len(at))
    level, own = (chosen[first] >> np.uint64(59)).astype(np.int64), (_LOW - (chosen[first] & _LOW)).astype(np.int64)
    names, since = np.zeros(len(first), np.uint64), np.zeros(len(first), np.int64)
    for j, (start, name, lo) in enumerate(named):
        here = np.flatnonzero(level == min(j, 31))
        if len(here) and len(start):
            k = np.minimum(np.searchsorted(start, own[here]), len(start) - 1)
            hit = start[k] == own[here]
            names[here[hit]], since[here[hit]] = name[k[hit]], lo[k[hit]]
    return lx._mix(names ^ lx.Windows(h).at(since, half)), at[first], at[stop - 1] + 1


def _digests(text: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[pa.Array]:
    """128-bit digests of stretches of the joined words, in two halves."""
    digest, raw = hashlib.blake2b, text.data
    found = np.frombuffer(b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]), np.int64)
    return [pa.array(found[0::2]), pa.array(found[1::2])]


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_batches(docs).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumns({"_k": F.xxhash64("_id", "_t"), "_k2": F.hash(F.lit(1), "_t", "_id")})


def _elect(window: int):
    def run(batches):
        for b in batches:
            k, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, _, data, offs in lx.chunks(b.column(2)):
                starts, ends, bounds = lx.words(data, offs, lx.NOT_SPACE)
                if bounds[-1] < window:
                    continue
                name, lo, hi = elected(lx.word_hashes(data, starts, ends), bounds, window)
                flat, at = lx.joined(data, starts, ends)
                d = np.searchsorted(bounds, lo, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *_digests(flat, at[lo], at[hi + window - 1] - 1), pa.array(k[i + d]), pa.array(k2[i + d]), pa.array(lo - bounds[d]), pa.array(hi - bounds[d])], names=["name", "s1", "s2", "_k", "_k2", "lo", "hi"])

    return run


def _digest_windows(window: int):
    def run(batches):
        for b in batches:
            k, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ranges = b.column(3)
            flat = ranges.flatten()
            lo, hi, alone = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "alone"))
            cuts = np.asarray(ranges.offsets) - ranges.offsets[0].as_py()
            for i, j, data, offs in lx.chunks(b.column(2)):
                starts, ends, bounds = lx.words(data, offs, lx.NOT_SPACE)
                own = np.arange(cuts[i], cuts[j])
                size = hi[own] - lo[own]
                at = np.repeat(np.repeat(bounds[:-1], np.diff(cuts[i : j + 1])) + lo[own], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                text, where = lx.joined(data, starts, ends)
                d = np.searchsorted(bounds, at, "right") - 1
                only = np.repeat(alone[own], size)
                for a in range(0, len(at), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([*_digests(text, where[at[part]], where[at[part] + window] - 1), pa.array(k[i + d[part]]), pa.array(k2[i + d[part]]), pa.array((at - bounds[d])[part]), pa.array(only[part])], names=["w1", "w2", "_k", "_k2", "at", "alone"])

    return run


def islands(windows: DataFrame) -> DataFrame:
    """(_k, _k2, lo, hi): ranges of windows (_k, _k2, at) that follow each other, cut at multiples of ISLAND."""
    block = F.floor(F.col("at") / ISLAND)
    place = F.row_number().over(Window.partitionBy("_k", "_k2", "_b").orderBy("at"))
    return windows.withColumn("_b", block).withColumn("_g", F.col("at") - place).groupBy("_k", "_k2", "_b", "_g").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi")).select("_k", "_k2", "lo", "hi")


def _merge_ranges(batches):
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    for b in batches:
        ranges = b.column(2)
        flat = ranges.flatten()
        lo, hi = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
        of = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(ranges.offsets)))
        order = np.lexsort((lo, of))
        lo, hi, of = lo[order], hi[order], of[order]
        width = int(hi.max(initial=0)) + 1
        reach = np.maximum.accumulate(hi + of * width)  # rows do not meet, as each has its own stretch of numbers
        first = np.ones(len(lo), bool)
        first[1:] = lo[1:] + of[1:] * width > reach[:-1]
        first[1:] |= of[1:] != of[:-1]
        at = np.flatnonzero(first)
        stop = reach[np.append(at[1:], len(lo)) - 1] - of[at] * width if len(at) else at
        merged = pa.StructArray.from_arrays([pa.array(lo[at]), pa.array(stop)], ["lo", "hi"])
        offsets = np.searchsorted(of[at], np.arange(b.num_rows + 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), merged).cast(kind)], names=["_k", "_k2", "ranges"])


def _by_document(docs: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """docs with their ranges; these are broadcast if the counted size is small."""
    size = ranges.agg(F.count("*"), F.sum(F.size("ranges"))).first()
    return docs.join(maybe_broadcast(ranges, 1, 64 * size[0] + 32 * (size[1] or 0)), ["_k", "_k2"], how)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(_k, _k2, ranges): for each document with repeated windows its key and the ranges (lo, hi) of their first words."""
    base = _keys(docs, id_col, text_col)
    tables: list[DataFrame] = []

    def held(df: DataFrame) -> DataFrame:
        tables.append(cut(df))
        return tables[-1]

    try:
        marks = held(base.select("_k", "_k2", "_t").mapInArrow(lx.trimmed(_elect(window)), "name bigint, s1 bigint, s2 bigint, _k bigint, _k2 int, lo bigint, hi bigint"))
        shared = held(marks.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"))
        common = held(matching(marks, shared, ["name"], 24))
        release(marks, shared)
        spans = held(common.groupBy("name", "s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("_k", "_k2", "lo", "hi")).alias("one")))
        whole = matching(common, spans.where("n > 1"), ["name", "s1", "s2"], 40).select("_k", "_k2", "lo", "hi")
        several = held(spans.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"))
        apart = matching(spans, several, ["name"], 24).select("one.*", (F.col("n") == 1).alias("alone"))
        places = held(apart.groupBy("_k", "_k2").agg(F.collect_list(F.struct("lo", "hi", "alone")).alias("ranges")))
        found = held(_by_document(base, places, "inner").select("_k", "_k2", "_t", "ranges").mapInArrow(lx.trimmed(_digest_windows(window)), "w1 bigint, w2 bigint, _k bigint, _k2 int, at bigint, alone boolean"))
        release(places)
        twice = held(found.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"))
        parts = islands(found.where("alone").join(maybe_broadcast(twice, twice.count(), 48), ["w1", "w2"]).select("_k", "_k2", "at"))
        return cut(whole.union(parts).groupBy("_k", "_k2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")).mapInArrow(_merge_ranges, "_k bigint, _k2 int, ranges array<struct<lo: bigint, hi: bigint>>"))
    finally:
        release(*tables)


def _cut_texts(window: int, keep_text: bool):
    def run(batches):
        for b in batches:
            ranges = b.column(2)
            flat = ranges.flatten()
            lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
            size = np.diff(np.asarray(ranges.offsets))
            if ranges.null_count:
                size = np.where(np.asarray(ranges.is_null()), 0, size)
            cuts = np.concatenate([[0], np.cumsum(size)])
            n_words, n_kept, sha, kept_text = [], [], [], []
            for i, j, data, offs in lx.chunks(b.column(1)):
                starts, ends, bounds = lx.words(data, offs, lx.NOT_SPACE)
                own = slice(cuts[i], cuts[j])
                first = np.repeat(bounds[:-1], size[i:j])
                kept = ~lx.covered(int(bounds[-1]), first + lo[own], first + hi[own] + window - 1)
                flat, at = lx.joined(data, starts[kept], ends[kept])
                place = np.concatenate([[0], np.cumsum(kept)])[bounds]
                n_words.append(np.diff(bounds))
                n_kept.append(np.diff(place))
                for a, z in zip(at[place[:-1]].tolist(), at[place[1:]].tolist(), strict=True):
                    text = flat.data[a : max(a, z - 1)]
                    sha.append(hashlib.sha256(text).hexdigest())
                    if keep_text:
                        kept_text.append(str(text, "utf-8", "replace"))
            words, left = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_words, n_kept))
            more = [pa.array(kept_text, pa.string())] if keep_text else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(words - left, pa.int64()), pa.array(sha, pa.string()), *more], names=["_id", "n_words", "n_removed", "kept_sha256", *["text"] * keep_text])

    return run


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, kept_sha256, and the kept words if keep_text.

    A word goes if it lies in a window of `window` words whose sequence starts anywhere else too, in this document or
    another. Null and empty texts have no words. Documents shorter than the window keep everything; very long ones are
    one row of arrays of their words' numbers. Rows that repeat an id and a text are repeats of each other. An empty
    table gives an empty result. Other columns are not read, whatever their names.
    """
    base = _keys(docs, id_col, text_col)
    found = repeats(docs, id_col, text_col, window)
    joined = _by_document(base, found, "left").select("_id", "_t", "ranges")
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", text string" if keep_text else ""
    return joined.mapInArrow(lx.trimmed(_cut_texts(window, keep_text)), f"_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string{more}").withColumnRenamed("_id", id_col)
