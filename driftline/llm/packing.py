"""Best-fit packing by a configuration linear program over the length histogram.

1. Token ids are made once a document, cut into pieces of at most `capacity`, and only (id, piece, start, length,
   crc32) is kept.
2. The driver gets the histogram of piece lengths: at most `capacity` numbers, whatever the input.
3. A configuration is a multiset of lengths that fits one sequence. The covering program "least number of
   configurations that hold all pieces" is solved by multiplicative weights. Lengths carry prices, at first their share
   of a sequence. In a round a knapsack dynamic program prices every room; the configurations that it names, within
   SLACK of the greatest price, are used until all but the last LAST of the pieces are covered, and covered lengths get
   cheaper on the way. Then each price is multiplied by how far the configurations that took its length stayed below
   the greatest price: lengths that leave room become dearer and pick their partners first in the next round.
   Prices over the greatest price are a dual solution, so each round also proves a lower bound.
4. Rounding: a use is a whole number of sequences from the start (a STEP of its scarcest length, at least one), so what
   a round covers needs no more rounding. The last pieces, at most LAST of the sequences or one a length, and those of
   the emptiest REOPENED of the sequences, are packed longest first, each sequence filled by an exact subset-sum
   program. The round with the fewest sequences wins; rounds end when a bound is met or nothing gets better.
5. Pieces get ranks within their length, block by block, so that no task holds all pieces of one length; rank ranges
   map to (sequence, offset) through the plan, whose size depends on the histogram and not on the input.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lexing as lx
from .shared import cut, maybe_broadcast, text_batches
from .wordbpe import Tables, WordBpe

CAPACITY = 2048
#: Rows of one length that one task ranks, at most.
BLOCK_ROWS = 1 << 18
#: Rounds at most, and dynamic programs in all of them.
ROUNDS, PROGRAMS = 16, 1200
#: Largest part of a length's pieces that one use covers; uses between two dynamic programs.
STEP, USES = 1 / 8, 96
#: How far a configuration may stay below the greatest price, in rounds by turns.
SLACK = (1e-2, 2e-3)
#: Exponent by which a covered length gets cheaper, and the part of all sequences left to the last step.
ETA, LAST = 0.1, 0.04
#: Part of all sequences, those with most room, that the last step packs anew.
REOPENED = 0.03
#: Rounds end at this gap to the lower bound.
GAP = 5e-4
PIECES = "_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


#: Encoders of this worker by tokenizer path; the tables behind them are broadcast.
_encoders: dict[str, WordBpe] = {}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(_id, piece, start, length, ids_crc32) of every document: its ids and then end_id, cut after each `capacity`."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity
    sent = docs.sparkSession.sparkContext.broadcast(Tables(tokenizer))

    def split(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordBpe(sent.value)
        ids = _encoders[tokenizer]
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, _, data, offs in lx.chunks(b.column(1), 1 << 20):
                found, bounds = ids.encode(data, offs)
                for d in range(len(offs) - 1):
                    whole = found[bounds[d] : bounds[d + 1]].astype("<u4").tobytes() + end
                    for k, at in enumerate(range(0, len(whole), step)):
                        part = whole[at : at + step]
                        row.append(i + d)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(lx.trimmed(split), PIECES.format(id=kind))


def worths(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest price that fits each room from 0 to capacity: unbounded knapsack, lengths ascending."""
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        if k := fits[c]:
            best[c] = (prices[:k] + best[c - lengths[:k]]).max()
    return best


def configuration(best: np.ndarray, prices: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int, slack: float) -> tuple[list[int], float]:
    """(positions of the lengths of one configuration, how far it stays below the greatest price): the longest lengths
    that keep it within slack, of those with pieces left."""
    room, config, lost, left = capacity, [], 0.0, left.copy()
    while room >= lengths[0]:
        k = int(np.searchsorted(lengths, room, "right"))
        loss = best[room] - prices[:k] - best[room - lengths[:k]]
        there = left[:k] > 0
        good = there & (loss <= slack - lost)
        if good.any():
            j = k - 1 - int(good[::-1].argmax())
        elif there.any():
            j = int(np.where(there, loss, np.inf).argmin())
        else:
            break
        lost += max(0.0, float(loss[j]))
        config.append(j)
        left[j] -= 1
        room -= int(lengths[j])
    return config, lost + float(best[room])


@dataclass
class Cover:
    """One round: [(positions of lengths, sequences)] of the program and of the last step, and the round's bound."""

    uses: list[tuple[list[int], int]]
    last: list[tuple[list[int], int]]
    bound: float
    greatest: float  # price of a configuration
    programs: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.uses) + sum(n for _, n in self.last)


def cover(lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int, slack: float) -> Cover:
    """Cover all pieces once, by the prices."""
    left, m = counts.copy(), len(counts)
    total = float((lengths * counts).sum()) / capacity
    uses: list[tuple[list[int], int]] = []
    bound, greatest, programs = 0.0, 1.0, 0
    while float((lengths * left).sum()) / capacity > max(2.0, min(m, LAST * total)):
        open_ = np.flatnonzero(left)
        size = lengths[open_]
        price = prices[open_] * np.exp(-ETA * (1 - left[open_] / counts[open_]))
        best = worths(price, size, capacity)
        if not programs:
            greatest = float(best[capacity])
            bound = float((counts * price).sum()) / greatest
        programs += 1
        tol = slack * best[capacity]
        for k in range(USES):
            config, lost = configuration(best, price, size, left[open_], capacity, tol)
            if not config or (k and lost > 4 * tol):
                break
            mult = Counter(config)
            times = min(min(max(1, int(STEP * counts[open_[j]] / a)), int(left[open_[j]] // a)) for j, a in mult.items())
            for j, a in mult.items():
                left[open_[j]] -= a * times
            uses.append(([int(open_[j]) for j in config], times))
    room = [capacity - int(lengths[config].sum()) for config, _ in uses]
    reopened, n = set(), 0
    for i in sorted(range(len(uses)), key=lambda i: -room[i]):
        if room[i] and n + uses[i][1] <= REOPENED * total:
            reopened.add(i)
            n += uses[i][1]
            np.add.at(left, uses[i][0], uses[i][1])
    uses = [u for i, u in enumerate(uses) if i not in reopened]
    last, rest, sizes = [], left.tolist(), lengths.tolist()
    while any(rest):
        config = fill(sizes, rest, capacity)
        times = min(rest[j] // n for j, n in config.items())
        for j, n in config.items():
            rest[j] -= n * times
        last.append((list(config.elements()), times))
    return Cover(uses, last, bound, greatest, programs)


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[Cover, float]:
    """(the round with the fewest sequences, the greatest lower bound), by multiplicative weights on the lengths."""
    prices = lengths / capacity
    bound = float((lengths * counts).sum()) / capacity
    won, since, programs = None, 0, 0
    for r in range(rounds):
        found = cover(lengths, counts, prices, capacity, SLACK[r % 2])
        programs += found.programs
        bound, since = max(bound, found.bound), since + 1
        if won is None or found.sequences < won.sequences:
            won, since = found, 0
        if won.sequences <= np.ceil(bound - 1e-6) or won.sequences <= bound * (1 + GAP) or since > 8 or programs > PROGRAMS:
            break
        below, taken = np.zeros(len(counts)), np.zeros(len(counts))
        for config, times in found.uses + found.last:
            at = np.array(config)
            np.add.at(below, at, -times * np.log(prices[at].sum() / found.greatest))
            np.add.at(taken, at, times)
        prices = prices * np.exp(below / taken)
    return won, bound


def fill(lengths: list[int], left: list[int], capacity: int) -> Counter:
    """One sequence for the longest piece left (lengths ascending), filled as full as the pieces left allow."""
    j = max(k for k, n in enumerate(left) if n)
    out = Counter({j: 1})
    room = capacity - lengths[j]
    reach, full, trail = 1, (1 << (room + 1)) - 1, []
    for k in range(j, -1, -1):
        n = left[k] - (k == j)
        take = 1
        while n > 0 and lengths[k] <= room and not reach >> room & 1:
            m = min(take, n)
            grown = (reach | reach << (m * lengths[k])) & full
            if grown != reach:
                trail.append((k, m, reach))
                reach = grown
            n -= m
            take *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for k, m, before in reversed(trail):
        if not before >> at & 1:
            out[k] += m
            at -= m * lengths[k]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(length, first rank, pieces, first sequence, offset)], sequences): piece first rank + i of that length goes to
    sequence first sequence + i."""
    lengths = sorted(k for k in histogram if k < capacity and histogram[k])
    uses: list[tuple[list[int], int]] = []
    if alone := histogram.get(capacity, 0):
        uses.append(([capacity], alone))
    if lengths:
        won, _ = solve(np.array(lengths), np.array([histogram[k] for k in lengths], np.int64), capacity, rounds)
        uses += [([lengths[j] for j in config], times) for config, times in won.uses + won.last]
    rows: list[tuple[int, int, int, int, int]] = []
    rank: Counter = Counter()
    sequence = 0
    for config, times in uses:
        at = 0
        for length in config:
            rows.append((length, rank[length], times, sequence, at))
            rank[length] += times
            at += length
        sequence += times
    return rows, sequence


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The pieces (a stable table with `_id`, `piece`, `start`, `length`) with sequence_id and offset.

    Rows that repeat an id are packed each for itself; null ids are ids like others; equal lengths are ranked by id. An
    empty table gives an empty result. Columns named _block, _before or _rank are not allowed.
    """
    spark = cut_pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, _ = plan(histogram, capacity, rounds)
    rows.sort()
    keys = np.array([(r[0] << 44) + r[1] for r in rows], np.int64)
    sent = spark.sparkContext.broadcast((keys, np.array([r[1] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)))
    # a length that many pieces have is ranked in many blocks
    share = -(-sum(histogram.values()) // int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = [-(-histogram.get(k, 0) // max(1, min(block_rows, share))) or 1 for k in range(1, capacity + 1)]
    of = F.element_at(F.split(F.lit(",".join(map(str, blocks))), ","), F.col("length").cast("int")).cast("int")
    hashed = cut_pieces.withColumn("_block", F.pmod(F.xxhash64("_id", "piece", "start", "length"), of).cast("int"))
    order = ["_id", "piece", *[c for c in cut_pieces.columns if c not in ("_id", "piece", "length")]]
    sizes = hashed.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("_n")
    ranked = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_block").orderBy(*order)).cast("long") - 1)
    ranked = ranked.join(maybe_broadcast(before, sum(blocks), 40), ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_block")

    def place(batches):
        keys, firsts, seqs, offs = sent.value
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            r = b.column(b.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            k = np.searchsorted(keys, (length << 44) + r, "right") - 1
            at = b.schema.get_field_index("_rank")
            own = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(seqs[k] + r - firsts[k]), pa.array(offs[k])], names=[*(n for n in b.schema.names if n != "_rank"), "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty: one piece of the end id alone. Very long texts are cut into many pieces. Rows that repeat an
    id or a text, and null ids, are packed each for itself. An empty table gives an empty result. Other columns are
    not read, whatever their names.
    """
    held = cut(pieces(docs, tokenizer, id_col, text_col, capacity))
    return pack(held, capacity).select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
