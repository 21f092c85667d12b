"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

1. Each document becomes a thin entry (hash of the normalised text, digest, id). The entries are written to the
   shared folder once; that table is the index file.
2. The directory starts with one slot. While a bucket holds more than `bucket_rows` entries of more than one hash,
   the directory doubles: only entries of overfull buckets are counted again, deeper, STEP_BITS doublings at once. The
   driver holds one count a bucket, and buckets grow with the table, so that these are some 2**TABLE_BITS at most. A
   bucket of one hash cannot be split: it is a long chain.
3. Owner tasks process key ranges: directory slots in hash order are packed into ranges of about `bucket_rows`
   entries and each range goes to one task, which finds the chain heads. Long chains are combined inside each task
   before the shuffle, so one of them moves a row a task.
4. Chains of two or more entries are compared byte by byte with their head. Members of a long chain are cut into
   segments of `chain_rows`, each joined with its own copy of the head, so that no task gets a whole hot chain.
   Where an entry collides with its head without being equal, the entries of that hash form chains by hash and
   SHA-256 of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, keep_rows, local_rows, maybe_broadcast, text_or_empty

#: Entries that a bucket may hold before its directory slot doubles.
BUCKET_ROWS = 1 << 15
#: Members of one chain that one task compares.
CHAIN_ROWS = 20_000
#: Bits by which the directory doubles at once, and its greatest depth as a table.
STEP_BITS, TABLE_BITS = 4, 16


def normalised(text: str) -> Column:
    """The text with each run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(text_or_empty(text), "[\\x20\\x09-\\x0D]+", " ")


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("_h", 64 - depth) if depth else F.lit(0).cast("long")


def directory(index: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(leaves, chains) over column `_h`: leaves [(prefix, depth, entries)]; chains, the hashes of more than
    bucket_rows entries, of which there are at most entries / bucket_rows."""
    spark = index.sparkSession
    leaves: list[tuple[int, int, int]] = []
    chains: list[int] = []
    depth, rows = 0, index
    while True:
        full = []
        for r in rows.groupBy(_slot(depth).alias("s")).agg(F.count("*").alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi")).collect():
            if r["n"] <= bucket_rows:
                leaves.append((r["s"], depth, r["n"]))
            elif r["lo"] == r["hi"]:
                chains.append(r["lo"])
            else:
                full.append((r["s"],))
        if not full:
            return leaves, chains
        rows = index.join(F.broadcast(local_rows(spark, "s long", full)), _slot(depth) == F.col("s"), "left_semi")
        depth = min(depth + STEP_BITS, 64)


def owners(leaves: list[tuple[int, int, int]], bucket_rows: int = BUCKET_ROWS) -> tuple[int, list[tuple[int, int]]]:
    """(depth, [(slot, owner)]): the directory as a table, its slots in hash order dealt in ranges to owner tasks."""
    depth = min(TABLE_BITS, max((d for _, d, _ in leaves), default=0))
    held = [0.0] * (1 << depth)
    for prefix, d, n in leaves:
        if d >= depth:
            held[prefix >> (d - depth)] += n
        else:
            width = 1 << (depth - d)
            for slot in range(prefix * width, (prefix + 1) * width):
                held[slot] += n / width
    table, owner, inside = [], 0, 0.0
    for slot, n in enumerate(held):
        if inside and inside + n > bucket_rows:
            owner, inside = owner + 1, 0.0
        inside += n
        table.append((slot, owner))
    return depth, table


def chain_heads(index: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(_h, head, size) of every hash: its first entry and its number of entries."""
    leaves, chains = directory(index.select("_h"), bucket_rows)
    depth, slots = owners(leaves, bucket_rows)
    head = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_e").alias("e"), F.col("_sha").alias("sha"))).alias("head")
    spark = index.sparkSession
    long_chains = F.broadcast(local_rows(spark, "_h long", [(h,) for h in chains]))
    dealt = index.join(long_chains, "_h", "left_anti") if chains else index
    dealt = dealt.withColumn("_s", _slot(depth)).join(F.broadcast(local_rows(spark, "_s long, _o int", slots)), "_s")
    heads = dealt.repartition(max(1, slots[-1][1] + 1), "_o").groupBy("_o", "_h").agg(head, F.count("*").alias("size")).drop("_o")
    if chains:  # these are combined in each task before the shuffle
        heads = heads.unionByName(index.join(long_chains, "_h", "left_semi").groupBy("_h").agg(head, F.count("*").alias("size")))
    return heads


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[Column], Column] = F.xxhash64, bucket_rows: int = BUCKET_ROWS, chain_rows: int = CHAIN_ROWS) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Null text is empty. Of rows with equal normalised text the smallest id stays (null ids come last); of rows that
    repeat an id and a text one stays, the others count in group_size. Very long texts are compared whole. An empty
    table gives an empty result. Other columns are not read, whatever their names.
    """
    norm = normalised(text_col)
    raw = docs.select(F.col(id_col).alias("_id"), norm.alias("_t")).withColumn("_h", key(F.col("_t")))
    index = cut(raw.select("_id", "_h", F.unhex(F.sha2("_t", 256)).alias("_sha")).withColumn("_e", F.monotonically_increasing_id()))
    bucket_rows = max(bucket_rows, index.count() >> TABLE_BITS)
    heads = cut(chain_heads(index, bucket_rows).where("size > 1"))
    stats = heads.agg(F.count("*"), F.max("size")).first()
    chains, longest = stats[0], stats[1] or 0

    # bytes of the members against bytes of their head, in segments
    segments = F.greatest(F.lit(1), F.ceil(F.col("size") / chain_rows).cast("int"))
    thin = heads.select("_h", F.col("head.id").alias("_hid"), F.col("head.sha").alias("_hsha"), segments.alias("_seg"))
    members = raw.join(maybe_broadcast(thin, chains, 80), "_h").withColumn("_s", F.pmod(F.xxhash64("_id"), F.col("_seg").cast("long")).cast("int"))
    members = cut(members)
    head_text = members.where(F.col("_id").eqNullSafe(F.col("_hid")) & (F.unhex(F.sha2("_t", 256)) == F.col("_hsha"))).dropDuplicates(["_h"])
    head_text = head_text.select("_h", F.col("_t").alias("_ht"), F.explode(F.sequence(F.lit(0), F.col("_seg") - 1)).alias("_s"))
    differ = cut(members.join(head_text, ["_h", "_s"]).where(F.col("_t") != F.col("_ht")).select("_id", "_h", "_t"))

    out = index.join(maybe_broadcast(heads, chains, 120), "_h", "left")
    if differ.isEmpty():
        resolved = out.select("_id", F.coalesce("head.id", "_id").alias("_keep"), F.when(F.col("head.e").isNull(), True).otherwise(F.col("head.e") == F.col("_e")).alias("kept"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), "_sha")
    else:
        # chains with collisions: their entries are grouped by hash and text digest of verified bytes
        mixed = differ.select("_h").distinct()
        plain = out.join(mixed, "_h", "left_anti").select("_id", F.coalesce("head.id", "_id").alias("_keep"), F.when(F.col("head.e").isNull(), True).otherwise(F.col("head.e") == F.col("_e")).alias("kept"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), "_sha")
        again = index.join(mixed, "_h", "left_semi")
        firsts = again.groupBy("_h", "_sha").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_e").alias("e"))).alias("head"), F.count("*").alias("size"))
        chained = again.join(firsts, ["_h", "_sha"]).select("_id", F.col("head.id").alias("_keep"), (F.col("head.e") == F.col("_e")).alias("kept"), F.col("size").alias("group_size"), "_sha")
        resolved = plain.unionByName(chained)
    return resolved.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose normalised text a row of smaller id has; all columns stay."""
    found = duplicates(docs.select(id_col, text_col), id_col, text_col)
    decisions = found.select(F.col(id_col).alias("_key_id"), F.col("text_sha256").alias("_key_text"), "kept")
    return keep_rows(docs, {"_key_id": F.col(id_col), "_key_text": F.sha2(normalised(text_col), 256)}, decisions)
