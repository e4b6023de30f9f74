"""Problem 4: records that share most of their content, over a collection too large for all pairs.

Method: multi-index Hamming join over b-bit signatures. The signature of a record is a row of
CHUNKS * CHUNK min-hash symbols of 16 bits over its three-token shingles. It is split into
chunks; within a chunk ERRORS symbols may differ, and each way to leave out that many gives a
lookup key. Pigeonhole: two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols
have a chunk with at most ERRORS differing ones and so share a key; every such pair is found.
Shingles that half a percent of all records share (set phrases) are left out of these signatures,
else a collection of set phrases has candidates in proportion to its square; they count in full
when a pair is verified. Two further kinds of keys serve pairs that need set phrases to reach the
threshold: a record of which they are OWN or more has a second signature whose chunks hold three
symbols of its common shingles and one of its own, without errors (two records that share most
of their template and some of the rest), and a record of which they are half or more has keys
over all its shingles.
Candidates whose two-bit signatures are too far apart are dropped, the rest is verified on the
full shingle sets.

Keys are made and joined in up to FAMILIES families of chunks, one after the other, so that the
scratch space of a large collection is that of one family. Keys of one class are of no use and go before the join; a key of more than
HOT classes is split into blocks, and each pair of blocks is a task's work of its own.

Records with the same shingle set are one class: only a class takes part, so a group of copies,
however large, costs one signature. Pairs of records come from the classes at the very end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import shingles as S
from tidewire.session import Scratch, small_side

SHINGLE = 3
CHUNKS, CHUNK, ERRORS = 16, 4, 1
SYMBOLS = CHUNKS * CHUNK
#: Symbols whose two lowest bits may differ in a candidate: at a similarity of 0.5, 24 of 64 do on average, with a deviation of 3.9.
FAR = 42
THRESHOLD = 0.5
#: Shingles that this share of all records (and at least so many) have say little and are left out of signatures; they are counted by slots.
COMMON, LEAST_COMMON, SLOT_BITS = 0.005, 50, 22
SLOTS = 1 << SLOT_BITS
#: Share of common shingles from which a record has mixed keys. Of two records of similarity 0.5 whose common share is under it, what is
#: signed has a similarity of at least (0.5 - 0.075) / (1 - 0.075) = 0.46, and the chunks meet with probability 0.99.
OWN = 0.1
#: Symbols of common shingles in a mixed chunk; one symbol of an own shingle follows.
TEMPLATE = 3
FAMILIES = 4
#: Keys up to which further families are made in the same pass.
PASS_KEYS = 4_000_000
#: Classes under one key that are joined as they are; the blocks of a larger key hold about so many.
HOT = 1000
_RNG = np.random.default_rng(4)
_XOR = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MUL = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COMMON_XOR = _RNG.integers(0, 1 << 63, CHUNKS * TEMPLATE, dtype=np.uint64)
_COMMON_MUL = _RNG.integers(1, 1 << 63, CHUNKS * TEMPLATE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

RECORDS = "id bigint, class bigint, n int, sketch_a bigint, sketch_b bigint, grams binary"
_RECORDS = pa.schema([("id", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("sketch_a", pa.int64()), ("sketch_b", pa.int64()), ("grams", pa.binary())])


def signatures(values: np.ndarray, n: np.ndarray, xor: np.ndarray = _XOR, mul: np.ndarray = _MUL) -> np.ndarray:
    """16-bit symbols, one row per record; n must be positive."""
    out = np.empty((len(n), len(xor)), np.uint64)
    for j in range(len(xor)):
        out[:, j] = S.per_record(np.minimum, (values ^ xor[j]) * mul[j], n)
    return S.mixed(out) >> np.uint64(48)


def sketches(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two lowest bits of each symbol, packed into two numbers."""
    half = SYMBOLS // 2
    places = np.arange(half, dtype=np.uint64) * np.uint64(2)
    two = sig & np.uint64(3)
    return tuple((x << places).sum(axis=1, dtype=np.uint64).view(np.int64) for x in (two[:, :half], two[:, half:]))


def chunk_keys(sig: np.ndarray, first: int = 0) -> np.ndarray:
    """The lookup keys of a row of chunks, one row per record: 48 bits of symbols, then which chunk (from first on) and which symbols were left out."""
    kept = list(combinations(range(CHUNK), CHUNK - ERRORS))
    keys = []
    for c in range(sig.shape[1] // CHUNK):
        for k, places in enumerate(kept):
            key = np.zeros(len(sig), np.uint64)
            for p in places:
                key = (key << np.uint64(16)) | sig[:, c * CHUNK + p]
            keys.append((key << np.uint64(8)) | np.uint64((first + c) * len(kept) + k))
    return np.stack(keys, axis=1).view(np.int64)


def mixed_keys(common: np.ndarray, own: np.ndarray, first: int = 0) -> np.ndarray:
    """One key a chunk: its TEMPLATE symbols of common shingles and one of own ones."""
    keys = []
    for c in range(own.shape[1]):
        key = own[:, c]
        for p in range(TEMPLATE):
            key = (key << np.uint64(16)) | common[:, c * TEMPLATE + p]
        keys.append((S.mixed(key) << np.uint64(8)) | np.uint64(192 + first + c))
    return np.stack(keys, axis=1).view(np.int64)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RECORDS of (id, title, text); further columns are passed on."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            flat, counts = S.token_hashes(part.column(1).to_pylist(), part.column(2).to_pylist())
            values, n = S.distinct_sorted(*S.grams(flat, counts, SHINGLE))
            has = n > 0
            if not has.any():
                continue
            n = n[has]
            # two independent sums over the set, mixed one after the other: sets of a single shingle differ as well
            same = S.mixed(S.mixed(S.per_record(np.add, values, n)) + S.per_record(np.add, S.mixed(values ^ _XOR[0]), n) * _MUL[0])
            a, b = sketches(signatures(values, n))
            short = (values >> np.uint64(32)).astype(np.uint32)  # sorted as well
            ends = np.cumsum(n)
            raw = [short[e - k : e].tobytes() for e, k in zip(ends, n)]
            kept, *more = (part.column(i).filter(pa.array(has)) for i in (0, *range(3, part.num_columns)))
            yield pa.RecordBatch.from_arrays(
                [kept, pa.array(same.view(np.int64)), pa.array(n, pa.int32()), pa.array(a), pa.array(b), pa.array(raw, pa.binary()), *more], names=[*_RECORDS.names, *part.schema.names[3:]]
            )


def _slots(share: float):
    """(slot, n): slots of shingles that `share` of the records of a task have; slot -1 counts the records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, records = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            records += batch.num_rows
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32)
            counts += np.bincount(raw >> np.uint32(32 - SLOT_BITS), minlength=SLOTS)
        often = np.flatnonzero(counts >= max(1, np.ceil(records * share)))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(often, -1)), pa.array(np.append(counts[often], records))], names=["slot", "n"])

    return run


def _slot_counts(slots):
    """(slot, n) of the given slots in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32)
            counts += np.bincount(raw >> np.uint32(32 - SLOT_BITS), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(slots.value), pa.array(counts[slots.value])], names=["slot", "n"])

    return run


def common_slots(records: DataFrame, share: float = COMMON) -> np.ndarray:
    """Slots of shingles that at least `share` of all records (and LEAST_COMMON) have, at most SLOTS.

    What is that frequent over all is so in at least one task; those slots are then counted in
    all tasks, so the result doesn't depend on how the records are split.
    """
    sc = records.sparkSession.sparkContext
    first = records.select("grams").mapInArrow(_slots(share), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = first.column("slot").to_numpy(), first.column("n").to_numpy()
    total, slot = int(n[slot < 0].sum()), np.sort(slot[slot >= 0])
    if not len(slot):
        return slot
    counted = records.select("grams").mapInArrow(_slot_counts(sc.broadcast(slot)), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    return np.sort(counted.where(F.col("n") >= max(LEAST_COMMON, total * share)).select("slot").toArrow().column("slot").to_numpy())


def families(records: int) -> list[range]:
    """Chunks by pass for a collection of so many records: the fewer the records, the fewer the passes."""
    n = min(FAMILIES, max(1, -(-records * 5 * CHUNKS // PASS_KEYS)))  # about five keys a chunk
    return [range(f * CHUNKS // n, (f + 1) * CHUNKS // n) for f in range(n)]


def _keys(common, chunks: range):
    """Keys of some chunks of the classes of a partition, once each: copies within the partition give no further rows."""
    at, template = slice(chunks.start * CHUNK, chunks.stop * CHUNK), slice(chunks.start * TEMPLATE, chunks.stop * TEMPLATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        frequent = np.zeros(SLOTS, bool)
        frequent[common.value] = True
        schema = pa.schema([("key", pa.int64()), ("class", pa.int64())])

        def rows(keys: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(classes, keys.shape[1]))], schema=schema)

        for batch in batches:
            fresh = []
            for i, c in enumerate(batch.column(0).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    fresh.append(i)
            for start in range(0, len(fresh), 4096):
                part = batch.take(pa.array(fresh[start : start + 4096]))
                raw = [np.frombuffer(x, np.uint32) for x in part.column(1).to_pylist()]
                n = np.array([len(x) for x in raw])
                classes, values = part.column(0).to_numpy(), np.concatenate(raw)
                record = np.repeat(np.arange(len(n)), n)
                own = ~frequent[values >> np.uint32(32 - SLOT_BITS)]
                rare = np.bincount(record[own], minlength=len(n))
                values = S.mixed(values.astype(np.uint64))  # 32 bits name the shingle; mixed, they serve the min-hashes as 64 bits would
                sig = np.zeros((len(n), at.stop - at.start), np.uint64)
                if (has := rare > 0).any():
                    sig[has] = signatures(values[own], rare[has], _XOR[at], _MUL[at])
                    yield rows(chunk_keys(sig[has], chunks.start), classes[has])
                if (some := has & (n - rare >= n * OWN)).any():
                    use = ~own & some[record]
                    shared = signatures(values[use], (n - rare)[some], _COMMON_XOR[template], _COMMON_MUL[template])
                    yield rows(mixed_keys(shared, sig[some, ::CHUNK], chunks.start), classes[some])
                if (few := rare * 2 <= n).any():
                    whole = signatures(values[few[record]], n[few], _XOR[at], _MUL[at])
                    yield rows(chunk_keys(whole, CHUNKS + chunks.start), classes[few])

    return run


def class_keys(records: DataFrame, common, chunks: range = range(CHUNKS)) -> DataFrame:
    """(key, class) of some chunks. common: broadcast slots of common shingles."""
    return records.select("class", "grams").mapInArrow(_keys(common, chunks), "key bigint, class bigint")


def met_pairs(scratch: Scratch, keys: DataFrame, name: str, hot: int = HOT) -> DataFrame:
    """(x, y), x < y: classes that share a key, once for each key they share. What is shared is written once and then joined."""
    once = keys.repartition("key").dropDuplicates(["key", "class"])
    k = scratch.write(once.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1"), name)
    few = k.where(F.col("m") <= hot)
    pairs = few.select("key", F.col("class").alias("x")).join(few.select("key", F.col("class").alias("y")), "key").where("x < y").select("x", "y")
    blocks = F.ceil(F.col("m") / F.lit(hot)).cast("int")
    many = k.where(F.col("m") > hot).withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int"))
    left = many.select("key", F.col("class").alias("x"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    right = many.select("key", F.col("class").alias("y"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), F.col("block").alias("j"))
    return pairs.unionByName(left.join(right, ["key", "i", "j"]).where("x < y").select("x", "y"))


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            like = np.array([S.overlap(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)) for a, b in zip(x, y)], float)
            keep = pa.array(like >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(like).filter(keep)], names=["x", "y", "similarity"])

    return run


def differing(a: str, b: str, c: str, d: str) -> F.Column:
    """Symbols in which the two-bit signatures (a, b) and (c, d) differ."""
    return F.expr(" + ".join(f"bit_count((({p} ^ {q}) | shiftrightunsigned({p} ^ {q}, 1)) & 6148914691236517205L)" for p, q in ((a, c), (b, d))))


def shingled(items: DataFrame) -> DataFrame:
    """RECORDS of items (id, title, text); records with fewer than three tokens are left out, repeated rows stay."""
    return items.where(F.col("id").isNotNull()).select(F.col("id").cast("bigint").alias("id"), "title", "text").mapInArrow(_records, RECORDS)


def near_candidates(met: DataFrame, records: DataFrame, threshold: float, far: int = FAR) -> DataFrame:
    """The pairs (x, y) of classes whose sizes allow the threshold and whose two-bit signatures are within reach."""
    short = records.groupBy("class").agg(F.first("n").alias("n"), F.first("sketch_a").alias("sa"), F.first("sketch_b").alias("sb"))
    sx, sy = (short.select(F.col("class").alias(k), F.col("n").alias(f"n{k}"), F.col("sa").alias(f"a{k}"), F.col("sb").alias(f"b{k}")) for k in "xy")
    possible = F.least("nx", "ny") >= F.greatest("nx", "ny") * threshold
    return met.join(sx, "x").join(sy, "y").where(possible & (differing("ax", "bx", "ay", "by") <= far)).select("x", "y")


def verified(near: DataFrame, records: DataFrame, threshold: float) -> DataFrame:
    """(x, y, similarity) of the classes (x, y) whose shingle sets are similar enough. near: a written table; records may hold a class many times."""
    needed = near.select(F.explode(F.array("x", "y")).alias("class")).distinct()
    held = records.select("class", "grams").join(small_side(needed, near.count() * 2), "class", "left_semi").groupBy("class").agg(F.first("grams").alias("grams"))
    x, y = (held.select(F.col("class").alias(k), F.col("grams").alias(f"g{k}")) for k in "xy")
    return near.join(x, "x").join(y, "y").select("x", "y", "gx", "gy").mapInArrow(_verify(threshold), "x bigint, y bigint, similarity double")


def similar_classes(spark: SparkSession, items: DataFrame, threshold: float = THRESHOLD, far: int = FAR) -> tuple[DataFrame, DataFrame]:
    """members (id, class), each id once, and pairs (x, y, similarity) of different classes, x < y."""
    scratch = Scratch(spark, "neardup")
    records = scratch.write(shingled(items), "records")
    common = spark.sparkContext.broadcast(common_slots(records))
    met = None
    passes = families(records.count())
    for i, chunks in enumerate(passes):
        own = scratch.write(met_pairs(scratch, class_keys(records, common, chunks), f"keys{i}").distinct(), f"met{i}")
        scratch.drop(f"keys{i}")
        met = own if met is None else met.unionByName(own)
        if len(passes) > 1:
            scratch.release()
    near = scratch.write(near_candidates(met.distinct(), records, threshold, far), "near")
    pairs = scratch.write(verified(near, records, threshold), "pairs")
    scratch.drop(*[f"met{i}" for i in range(len(passes))], "near")
    return records.select("id", "class").distinct(), pairs


def similar_pairs(spark: SparkSession, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_a, item_b, similarity), item_a < item_b: every pair of records, copies within a class included.

    Null titles and texts are empty; records with fewer than three tokens have no pairs; an empty
    table gives no rows; other columns are ignored.
    """
    members, pairs = similar_classes(spark, items, threshold)
    mx, my = (members.select(F.col("class").alias(k), F.col("id").alias(f"i{k}")) for k in "xy")
    across = pairs.join(mx, "x").join(my, "y").select("ix", "iy", "similarity")
    within = mx.join(my, F.col("x") == F.col("y")).where("ix < iy").select("ix", "iy", F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select(F.least("ix", "iy").alias("item_a"), F.greatest("ix", "iy").alias("item_b"), "similarity")


def similar_groups(spark: SparkSession, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, class_id, links, group_id): each record once; copies are not expanded into pairs.

    class_id: the least id with the same shingles; links: different classes similar to it; group_id:
    the least id linked directly or indirectly. Records with fewer than three tokens are their own.
    """
    from tidewire.llm.components import connected_groups

    members, pairs = similar_classes(spark, items, threshold)
    scratch = Scratch(spark, "neardup-groups")
    named = scratch.write(members.join(members.groupBy("class").agg(F.min("id").alias("class_id")), "class"), "named")
    rep = named.groupBy("class").agg(F.first("class_id").alias("class_id"))
    rx, ry = (rep.select(F.col("class").alias(k), F.col("class_id").alias(f"c{k}")) for k in "xy")
    edges = scratch.write(pairs.join(rx, "x").join(ry, "y").select(F.col("cx").alias("a"), F.col("cy").alias("b")), "edges")
    links = edges.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    groups = connected_groups(spark, edges).select(F.col("v").alias("class_id"), "group_id")
    known = named.join(links, "class_id", "left").join(groups, "class_id", "left").select(
        F.col("id").alias("item_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id")
    )
    ids = items.where(F.col("id").isNotNull()).select(F.col("id").cast("bigint").alias("item_id")).distinct()
    return ids.join(known, "item_id", "left").select(
        "item_id", F.coalesce("class_id", "item_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "item_id").alias("group_id")
    )
