"""SimHash near-duplicates by a hierarchical index over Gray-ordered fingerprints.

A document's fingerprint sums the XXH64 hashes of its word shingles bit by bit. Different fingerprints are indexed
once each. At the top of the index stand masks: the 64 bits are cut into m segments, and fingerprints that differ in
at most k bits agree in at least m - k whole segments, so every link lies inside one group of fingerprints that share
some mask's bits. m grows with the number of fingerprints, which keeps groups small. A group is sorted by Gray rank,
so that neighbours differ in few bits, and gets a tree: a node holds the bit pattern that all fingerprints below it
share, and the mask of those bits. Two nodes are joined from the roots down; differences in bits that both share
accumulate, and a pair of nodes with more than k of them is dropped with everything below.

Inside a group links are merged as they are found: two nodes whose fingerprints are all in one class already are
passed over, and only (fingerprint, least of its class) leaves the group, never all pairs.
"""

from __future__ import annotations

from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexing as lx
from .components import components
from .shared import cut, delete, keep_rows, matching, maybe_broadcast, release, text_batches

SHINGLE, SEED, BITS = 4, 42, 4
#: Fingerprints that a group should hold on average, at most.
GROUP_ROWS = 2048
LEAF, FAN = 16, 8
#: Fingerprints of one group that a task joins at once, at most; a larger group is joined block by block.
GROUP_MOST = 1 << 17
#: Node pairs handled at once.
FRONT = 1 << 16
_LANES = np.uint64(0x0101010101010101)


def chunk_fingerprints(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprints (uint64) of one chunk's documents."""
    raw = data.tobytes().lower()
    texts = [raw[offs[d] : offs[d + 1]].split() for d in range(len(offs) - 1)]
    flat = list(chain.from_iterable(texts))
    out = np.zeros(len(texts), np.uint64)
    if not flat:
        return out
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    joined = b" ".join(flat)
    n_words = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    n_sh = np.where(n_words == 0, 0, np.maximum(1, n_words - shingle + 1))
    first = np.concatenate([[0], np.cumsum(n_sh)])
    at = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], n_sh)
    stop = at + np.repeat(np.minimum(shingle, n_words), n_sh) - 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts[at].tolist(), ends[stop].tolist())), repeat(seed)), np.uint64, len(at))
    full = np.flatnonzero(n_sh)
    out[full] = majority(h, first[full], n_sh[full])
    return out


def majority(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each run of `size` hashes from `first` on, the bits set in over half of them; the runs follow each other."""
    # up to 255 hashes are summed in the eight byte lanes of one word
    n_blocks = -(-size // 255)
    block0 = np.concatenate([[0], np.cumsum(n_blocks)])
    blocks = np.repeat(first, n_blocks) + 255 * (np.arange(block0[-1]) - np.repeat(block0[:-1], n_blocks))
    counts = np.zeros((len(blocks), 8, 8), np.int64)
    for s in range(8):
        counts[:, :, s] = np.add.reduceat((h >> np.uint64(s)) & _LANES, blocks).view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts.reshape(-1, 64), block0[:-1], axis=0)
    bits = (2 * total > size[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(_id, _fp): one row per document; the fingerprint's 64 bits as a long. Null text counts as empty."""

    def make(batches):
        for b in batches:
            found = [chunk_fingerprints(data, offs, shingle, seed) for _, _, data, offs in lx.chunks(b.column(1))]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["_id", "_fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(lx.trimmed(make), f"_id {kind}, _fp bigint")


def masks(n: int, k: int = BITS, group_rows: int = GROUP_ROWS) -> list[int]:
    """Masks such that two words within k bits agree on at least one: m - k of m segments, m as n needs it."""
    for m in range(k + 1, 2 * k + 3):
        bits = 64 * (m - k) // m
        if n >> bits <= group_rows or m == 2 * k + 2:
            edges = [64 * i // m for i in range(m + 1)]
            parts = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(m)]
            return [sum(parts[i] for i in keep) for keep in combinations(range(m), m - k)]
    raise AssertionError


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray order."""
    r = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class Classes:
    """Disjoint sets over array positions, joined many pairs at a time; the label is the least position."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


class Tree:
    """Nodes over codes in group and Gray order. Level 0 has runs of LEAF codes, each further level FAN nodes a node."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray) -> None:
        """groups: first position of each group, and the number of codes at the end."""
        self.codes = codes
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (child bounds, pattern, shared bits)
        bounds, fan, pattern, shared = groups, LEAF, codes, np.full(len(codes), ~np.uint64(0))
        while True:
            size = np.diff(bounds)
            n = -(-size // fan)
            node0 = np.concatenate([[0], np.cumsum(n)])
            start = np.repeat(bounds[:-1], n) + fan * (np.arange(node0[-1]) - np.repeat(node0[:-1], n))
            child = np.append(start, bounds[-1])
            own = pattern[start]
            count = np.diff(child)
            differ = np.bitwise_or.reduceat((pattern ^ np.repeat(own, count)) | ~shared, start)
            self.levels.append((child, own, ~differ))
            bounds, fan, pattern, shared = node0, FAN, own, ~differ
            if (n <= 1).all():
                return

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level the class of each node's codes, -1 if they are in several."""
        out, below = [], label
        for child, _, _ in self.levels:
            lo, hi = np.minimum.reduceat(below, child[:-1]), np.maximum.reduceat(below, child[:-1])
            below = np.where((lo == hi) & (lo >= 0), lo, -1)
            out.append(below)
        return out


def _expand(child: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of a and a child of b; for a == b each unordered pair once, a child with itself included."""
    na, nb = child[a + 1] - child[a], child[b + 1] - child[b]
    n = na * nb
    first = np.cumsum(n) - n
    k = np.arange(int(n.sum())) - np.repeat(first, n)
    wide = np.repeat(nb, n)
    x, y = np.repeat(child[a], n) + k // wide, np.repeat(child[b], n) + k % wide
    ok = (x <= y) | np.repeat(a != b, n)
    return x[ok], y[ok]


def link_groups(codes: np.ndarray, groups: np.ndarray, k: int = BITS) -> np.ndarray:
    """For each code (group after group, each in Gray order) the least position it is linked to inside its group."""
    classes = Classes(len(codes))
    if len(codes) < 2:
        return classes.label
    tree = Tree(codes, groups)
    near = np.arange(len(codes) - 1)  # Gray neighbours first: they merge most of a dense group
    apart = np.zeros(len(codes), bool)
    apart[groups[:-1]] = True
    near = near[~apart[1:] & (np.bitwise_count(codes[1:] ^ codes[:-1]) <= k)]
    classes.join(near, near + 1)
    uniform = tree.uniform(classes.label)
    roots = np.arange(len(groups) - 1)
    stack = [(len(tree.levels) - 1, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > FRONT:
            stack += [(level, a[i : i + FRONT], b[i : i + FRONT]) for i in range(0, len(a), FRONT)][::-1]
            continue
        merged = (uniform[level][a] >= 0) & (uniform[level][a] == uniform[level][b])
        a, b = a[~merged], b[~merged]
        child = tree.levels[level][0]
        if len(a) == 0:
            continue
        if level:
            _, pattern, shared = tree.levels[level - 1]
            for i in range(0, len(a), FRONT // 16):
                x, y = _expand(child, a[i : i + FRONT // 16], b[i : i + FRONT // 16])
                ok = np.bitwise_count((pattern[x] ^ pattern[y]) & shared[x] & shared[y]) <= k
                stack.append((level - 1, x[ok], y[ok]))
        else:
            for i in range(0, len(a), FRONT // 64):
                x, y = _expand(child, a[i : i + FRONT // 64], b[i : i + FRONT // 64])
                ok = (np.bitwise_count(codes[x] ^ codes[y]) <= k) & (x != y)
                classes.join(x[ok], y[ok])
            if len(a) > 4096:
                uniform = tree.uniform(classes.label)
    return classes.label


def links(different: DataFrame, n: int, k: int = BITS, group_rows: int = GROUP_ROWS, group_most: int = GROUP_MOST) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints (column _fp, each once) within k bits of each other.

    A group of more than group_most fingerprints is cut into blocks by hash, and every two blocks are joined by a task
    of their own, so that no task holds a whole hot group.
    """
    family = masks(n, k, group_rows)
    signed = [m - (1 << 64) if m >> 63 else m for m in family]
    keyed = different.select("_fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("_fp").bitwiseAND(F.lit(m)).alias("v")) for t, m in enumerate(signed)])).alias("g")).select(F.col("g.t").alias("_t"), F.col("g.v").alias("_v"), "_fp")
    rank = F.col("_fp")
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    spark = different.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(family) * n // 2_000_000)
    hot = cut(keyed.groupBy("_t", "_v").agg(F.count("*").alias("_n")).where(F.col("_n") > group_most)) if n > group_most else None
    if hot is None or not (n_hot := hot.count()):
        dealt = keyed.withColumns({"_i": F.lit(0), "_j": F.lit(0)})
    else:
        blocks = F.ceil(F.col("_n") * 2 / group_most).cast("int")
        parts = max(parts, hot.agg(F.sum(blocks.cast("long") * blocks)).first()[0] // 4)
        side = F.pmod(F.xxhash64("_fp", F.lit(1)), blocks).cast("int")
        spread = keyed.join(maybe_broadcast(hot, n_hot, 32), ["_t", "_v"], "left").withColumn("_b", F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))))
        dealt = spread.withColumns({"_i": F.coalesce(F.least("_b", side), F.lit(0)), "_j": F.coalesce(F.greatest("_b", side), F.lit(0))})
    dealt = dealt.select("_t", "_v", (F.col("_i").cast("long") * (1 << 31) + F.col("_j")).alias("_p"), "_fp")
    dealt = dealt.repartition(parts, "_t", "_v", "_p").sortWithinPartitions("_t", "_v", "_p", rank)

    def join(batches):
        held: list[tuple[np.ndarray, ...]] = []
        rows, enough = 0, 200_000

        def run(t, v, p, codes):
            new = np.flatnonzero((t[1:] != t[:-1]) | (v[1:] != v[:-1]) | (p[1:] != p[:-1])) + 1
            groups = np.concatenate([[0], new, [len(t)]])
            alone = np.diff(groups) == 1
            keep = np.repeat(~alone, np.diff(groups))
            codes = codes[keep]
            groups = np.concatenate([[0], np.cumsum(np.diff(groups)[~alone])])
            if len(codes) == 0:
                return
            label = link_groups(codes, groups, k)
            own = np.flatnonzero(label != np.arange(len(codes)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(codes[own].view(np.int64)), pa.array(codes[label[own]].view(np.int64))], names=["a", "b"])

        for b in batches:
            t, v, p, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(t):
                continue
            held.append((t, v, p, fp.view(np.uint64)))
            rows += len(t)
            if rows < enough:
                continue
            t, v, p, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            other = np.flatnonzero((t != t[-1]) | (v != v[-1]) | (p != p[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield from run(t[:last], v[:last], p[:last], codes[:last])
            held, rows = [(t[last:], v[last:], p[last:], codes[last:])], len(t) - last
            enough = max(200_000, 2 * rows)  # a long group is copied a few times only
        if held:
            yield from run(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.mapInArrow(lx.trimmed(join), "a bigint, b bigint")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, k: int = BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id (least id that links reach).

    Documents link if their fingerprints differ in k bits at most. Null and empty texts have fingerprint zero and link
    like others. Null ids never are a component's least id unless it has no other. Rows that repeat an id keep a
    fingerprint each; equal texts are one node of the index. Very long texts are read whole. An empty table gives an
    empty result. Other columns are not read, whatever their names.
    """
    held = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(held.groupBy("_fp").agg(F.min("_id").alias("_min"), F.count("*").alias("_n")))
    n = classes.count()
    edges = components(links(classes.select("_fp"), n, k, group_rows))
    rooted = classes.join(edges.select(F.col("a").alias("_fp"), F.col("b").alias("_root")), "_fp", "left").select("_fp", "_min", "_n", F.coalesce("_root", "_fp").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_min").alias("component_id"), F.sum("_n").alias("_size"))
    named = cut(rooted.join(least.where("_size > 1"), "_root").select("_fp", "component_id"))
    out = held.join(maybe_broadcast(named, named.count(), 40), "_fp", "left")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "_id").alias("component_id"))


#: Near copies: words of a shingle, shingles of a sample, and the levels of samples (2**level a document).
NEAR_SHINGLE, SAMPLE, LEVELS, SAMPLE_BITS = 5, 7, 5, 2
#: Jaccard similarity of near copies, at least.
NEAR = 0.8
#: Documents of fewer shingles find their copies by prefixes, without samples.
SHORT = 60
#: Shingles of so many short documents come last in the order of prefixes; so many of them are broadcast at most.
FREQUENT, FREQUENT_MOST = 1000, 1 << 22
#: A class is compared within itself in blocks of about so many documents and bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 2048, 8 << 20


def shingle_hashes(data: np.ndarray, offs: np.ndarray, shingle: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the different shingles of one chunk's documents, in this order."""
    low = lx.LOWER[data]
    starts, ends, bounds = lx.words(low, offs, lx.NOT_SPACE)
    win = lx.Windows(lx.word_hashes(low, starts, ends))
    at = lx.window_starts(bounds, shingle)
    doc, h = np.searchsorted(bounds, at, "right") - 1, win.at(at, shingle)
    n_words = np.diff(bounds)
    for size in range(shingle):  # too short for a shingle: the whole sequence
        few = np.flatnonzero(n_words == size)
        doc = np.concatenate([doc, few])
        h = np.concatenate([h, win.at(bounds[few], size) if size else np.zeros(len(few), np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def prefix_length(size: np.ndarray, least: float = NEAR) -> np.ndarray:
    """Of any order that two sets share, each one's first so many members hold one of the other's, if they are similar."""
    return size - np.ceil(least * size - 1e-9).astype(np.int64) + 1


def chunk_prefixes(doc: np.ndarray, h: np.ndarray, n_docs: int, least: float = NEAR, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the first shingles of each document: two similar documents have one in common. Shingles stand
    in the order of their hashes, frequent ones (sorted hashes) after all others."""
    if frequent is not None and len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
        order = np.lexsort((h, often, doc))
        doc, h = doc[order], h[order]
    size = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(size) - size
    picked = np.arange(len(h)) - first[doc] < prefix_length(size, least)[doc]
    return doc[picked], h[picked]


def frequent_shingles(texts: DataFrame, shingle: int, similarity: float, least: int = FREQUENT, most: int = FREQUENT_MOST) -> np.ndarray:
    """Sorted hashes of the shingles that `least` short documents (text _t) or more hold; where these are more than
    `most`, of those that twice as many hold, and so on."""

    def run(batches):
        for b in batches:
            for _, _, data, offs in lx.chunks(b.column(0)):
                doc, h = shingle_hashes(data, offs, shingle)
                short = np.bincount(doc, minlength=len(offs) - 1)[doc] * similarity < SHORT
                own, n = np.unique(h[short], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["h", "n"])

    counted = cut(texts.mapInArrow(lx.trimmed(run), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    while counted.where(F.col("n") >= least).count() > most:
        least *= 2
    found = counted.where(F.col("n") >= least).select("h").toPandas()["h"].to_numpy().astype(np.int64).view(np.uint64)
    delete(counted)
    return np.sort(found)


def chunk_samples(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, fingerprint) of the shingle samples of one chunk, from its different shingles.

    A document's different shingles are dealt by hash into 2**level samples, each the SAMPLE least hashes of its part;
    level follows the number of shingles, and two neighbouring levels are made, so that texts of nearly equal length
    share one.
    """
    level = np.floor(np.log2(np.maximum(1, np.bincount(doc, minlength=n_docs) / SAMPLE))).astype(np.int64)
    docs, fps = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in (0, 1):
        own = np.minimum(level + k, LEVELS)
        use = np.repeat(True, len(h)) if k == 0 else (level < LEVELS)[doc]  # the same level twice is made once
        d, x = doc[use], h[use]
        if not len(x):
            continue
        bits = own[d].astype(np.uint64)
        part = np.where(bits > 0, x >> (np.uint64(64) - np.maximum(bits, np.uint64(1))), np.uint64(0))
        edge = np.ones(len(x), bool)
        edge[1:] = (d[1:] != d[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(edge)
        rank = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        picked = rank < SAMPLE
        d, x, edge = d[picked], x[picked], edge[picked]
        first = np.flatnonzero(edge)
        docs.append(d[first])
        fps.append(majority(x, first, np.diff(np.append(first, len(x)))))
    return np.concatenate(docs), np.concatenate(fps)


def _similar(shingle: int, least: float):
    """Keep (_node, _hub, text, hub's text) rows whose sets of word shingles are similar enough."""

    def shingles(text: str) -> set[tuple[bytes, ...]]:
        w = text.encode().lower().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}

    def run(batches):
        for b in batches:
            near = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = shingles(x), shingles(y)
                both = len(p & q)
                near.append(both >= least * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def link_similar(doc: np.ndarray, h: np.ndarray, label: np.ndarray, side: np.ndarray | None = None, least: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): pairs of similar documents that join all documents which similar pairs connect, given their different
    shingles (document, hash) in order of document and the classes (label) they are in already. With `side`, only
    pairs across.

    Nothing is left out but pairs in one class already, and pairs that lengths or prefixes (rarest shingles first)
    prove to be less similar. Documents with the commonest shingles come first, as they connect most.
    """
    n, label = len(label), label.copy()
    size = np.bincount(doc, minlength=n)
    first = np.cumsum(size) - size
    _, token = np.unique(h, return_inverse=True)
    often = np.bincount(token)
    common = np.add.reduceat(often[token], first) / size
    token = token[np.lexsort((token, often[token], doc))]
    lead = prefix_length(size, least)
    place = np.flatnonzero((np.arange(len(token)) - first[doc] < lead[doc]) & (often[token] > 1))
    place = place[np.argsort(token[place], kind="stable")]
    lists, ends = doc[place], np.searchsorted(token[place], np.arange(len(often) + 1))
    done, mark = np.zeros(n, bool), np.zeros(len(often), bool)
    xs, ys = [], []
    for x in np.argsort(-common, kind="stable").tolist():
        done[x] = True
        own = token[first[x] : first[x] + size[x]]
        lead_x = own[: lead[x]]
        lead_x = lead_x[often[lead_x] > 1]
        if not len(lead_x):
            continue
        met = np.zeros(n, bool)
        for t in lead_x.tolist():
            met[lists[ends[t] : ends[t + 1]]] = True
        met &= ~done & (label != label[x])
        if side is not None:
            met &= side != side[x]
        found = np.flatnonzero(met)
        found = found[(size[found] >= least * size[x] - 1e-9) & (size[x] >= least * size[found] - 1e-9)]
        mark[own] = True
        for i in range(0, len(found), 1024):
            y = found[i : i + 1024]
            m = size[y]
            to = np.cumsum(m) - m
            both = np.add.reduceat(mark[token[np.arange(int(m.sum())) + np.repeat(first[y] - to, m)]].astype(np.int64), to)
            y = y[both >= least * (size[x] + m - both)]
            y = y[np.unique(label[y], return_index=True)[1]]
            y = y[label[y] != label[x]]
            if len(y):
                xs.append(np.full(len(y), x))
                ys.append(y)
                label[np.isin(label, label[y])] = label[x]
        mark[own] = False
        if (label == label[0]).all():
            break
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _links_inside(shingle: int, least: float):
    """Edges (a, b) of (_class, _i, _j, _side, _node, _root, text) rows that come class after class and block after block."""

    def run(rows: pa.Table):
        node, root = (rows.column(c).to_numpy() for c in ("_node", "_root"))
        side = rows.column("_side").to_numpy() if rows.column("_i")[0] != rows.column("_j")[0] else None
        parts = [(i, *shingle_hashes(data, offs, shingle)) for i, _, data, offs in lx.chunks(rows.column("_t").combine_chunks())]
        x, y = link_similar(np.concatenate([i + d for i, d, _ in parts]), np.concatenate([h for *_, h in parts]), np.unique(root, return_inverse=True)[1], side, least)
        return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

    def links(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and key != tuple(keys[:, lo]):
                    yield run(pa.Table.from_batches(held))
                    held = []
                key = tuple(keys[:, lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield run(pa.Table.from_batches(held))

    return links


def _open_members(classed: DataFrame, groups: DataFrame) -> DataFrame:
    """(_class, _node, _root, _n): the members of classes that the groups (a, b) so far leave in more than one part. A
    class of two has been compared; of classes with the same members one is taken."""
    rooted = classed.join(groups.select(F.col("a").alias("_node"), F.col("b").alias("_root")), "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    kinds = rooted.groupBy("_class").agg(F.count("*").alias("_n"), F.sum(F.xxhash64("_node").cast("decimal(38,0)")).alias("_sum"), F.min("_root").alias("_lo"), F.max("_root").alias("_hi"))
    open_ = kinds.where("_n > 2 and _lo <> _hi").groupBy("_n", "_sum").agg(F.min("_class").alias("_class")).select("_class", "_n")
    return rooted.join(open_, "_class").select("_class", "_node", "_root", "_n")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = NEAR, block_docs: int = BLOCK_DOCS, frequent: int = FREQUENT) -> DataFrame:
    """(_key_id, _key_text, kept): one row per document; of each group of near copies the least id is kept.

    One fingerprint of a whole text tells copies apart that share 80 % of their shingles, so here a document has the
    fingerprints of up to 2**LEVELS samples of its five-word shingles. Documents are candidates if they have samples
    in one class of the index: of 7,200 random pairs at the border (similarity 0.8, 60 to 2,000 shingles) all but one
    had such samples. Samples of short texts are too few for that, so a document of fewer than SHORT shingles,
    and all that one can be similar to, forms a class with those that share one of its first shingles, in an order in
    which shingles of many documents come last: of two similar texts none is missed, and a line that many documents
    hold makes no class of them. A class's documents are first compared with the least of them, exactly, as Jaccard
    similarity of the whole texts' shingle sets. A class that this leaves in several groups is compared within itself,
    every pair that is not in one group already (link_similar, on 64-bit shingle hashes); a large one block by block,
    so that no task holds more than two blocks. Groups are the components of all pairs that pass.

    Null and empty texts are empty and similar to each other; null ids come last; of rows that repeat an id and a text
    one counts. Very long texts are read whole. An empty table gives an empty result. Other columns are not read.
    """
    keyed = text_batches(docs).select(F.col(id_col).alias("_key_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_key_text", F.xxhash64("_t")).withColumn("_node", F.xxhash64("_key_id", "_t"))

    often = docs.sparkSession.sparkContext.broadcast(frequent_shingles(keyed.select("_t"), shingle, similarity, frequent))

    def run(batches):
        for b in batches:
            node = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offs in lx.chunks(b.column(1)):
                doc, h = shingle_hashes(data, offs, shingle)
                size = np.bincount(doc, minlength=len(offs) - 1)[doc]
                long, short = size >= SHORT, size * similarity < SHORT  # the latter are all that a shorter one is similar to
                for prefix, (d, x) in ((False, chunk_samples(doc[long], h[long], len(offs) - 1)), (True, chunk_prefixes(doc[short], h[short], len(offs) - 1, similarity, often.value))):
                    yield pa.RecordBatch.from_arrays([pa.array(node[i + d]), pa.array(x.view(np.int64)), pa.array(np.full(len(d), prefix))], names=["_node", "_fp", "_prefix"])

    made: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(df)
        return df

    def held(df: DataFrame) -> DataFrame:
        return keep(cut(df))

    try:
        samples = held(keyed.select("_node", "_t").mapInArrow(lx.trimmed(run), "_node bigint, _fp bigint, _prefix boolean").distinct())
        different = held(samples.where("not _prefix").groupBy("_fp").agg(F.count("*").alias("_n")))
        same = keep(components(links(different.select("_fp"), different.count(), SAMPLE_BITS)))
        sampled = samples.where("not _prefix").join(same.select(F.col("a").alias("_fp"), F.col("b").alias("_class")), "_fp", "left").select("_node", F.coalesce("_class", "_fp").alias("_class"))
        classed = held(sampled.union(samples.where("_prefix").select("_node", "_fp")).distinct())
        hubs = held(classed.groupBy("_class").agg(F.min("_node").alias("_hub"), F.count("*").alias("n")).where("n > 1"))
        pairs = held(matching(classed, hubs, ["_class"], 32, ("_hub",)).where("_node <> _hub").select("_node", "_hub").distinct())
        delete(different)
        release(samples)
        ends = held(pairs.select("_node").union(pairs.select("_hub")).distinct())
        texts = held(keyed.select("_node", "_t").join(maybe_broadcast(ends, ends.count(), 24), "_node").dropDuplicates(["_node"]).withColumn("_bytes", F.octet_length("_t")))
        both = pairs.join(texts.drop("_bytes"), "_node").join(texts.select(F.col("_node").alias("_hub"), F.col("_t").alias("_h")), "_hub").select("_node", "_hub", "_t", "_h")
        groups = keep(components(both.mapInArrow(lx.trimmed(_similar(shingle, similarity)), "a bigint, b bigint")))
        members = held(_open_members(classed, groups).join(texts.select("_node", "_bytes"), "_node"))
        if not members.isEmpty():
            blocks = held(members.groupBy("_class").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("_bytes") / BLOCK_BYTES)).cast("int").alias("_blocks"), F.count("*").alias("n")))
            placed = matching(members, blocks, ["_class"], 32, ("_blocks",)).withColumn("_side", F.expr("cast(pmod(xxhash64(_node, 1), _blocks) as int)")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            spread = placed.select("_class", F.least("_side", "_other").alias("_i"), F.greatest("_side", "_other").alias("_j"), "_side", "_node", "_root").join(texts.select("_node", "_t"), "_node")
            dealt = spread.select("_class", "_i", "_j", "_side", "_node", "_root", "_t").repartition("_class", "_i", "_j").sortWithinPartitions("_class", "_i", "_j")
            groups = keep(components(groups.union(dealt.mapInArrow(lx.trimmed(_links_inside(shingle, similarity)), "a bigint, b bigint"))))
        groups = groups.select(F.col("a").alias("_node"), F.col("b").alias("_root"))
        delete(classed, pairs, ends, texts, members)
        rooted = cut(keyed.drop("_t").join(maybe_broadcast(groups, groups.count(), 40), "_node", "left").withColumn("_root", F.coalesce("_root", "_node")))
    finally:
        release(*made)
    first = rooted.groupBy("_root").agg(F.min(F.struct(F.col("_key_id").isNull().alias("n"), F.col("_key_id").alias("id"), F.col("_node").alias("node"))).alias("first"), F.count("*").alias("_n")).where("_n > 1").select("_root", F.col("first.node").alias("_first"))
    return rooted.join(first, "_root", "left").select("_key_id", "_key_text", (F.coalesce("_first", "_node") == F.col("_node")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, the one of least id; all columns stay."""
    decisions = near_groups(docs.select(id_col, text_col), id_col, text_col)
    return keep_rows(docs, {"_key_id": F.col(id_col), "_key_text": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}, decisions)
