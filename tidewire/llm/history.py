"""Problem 3: new batches against all accepted history.

Method: partitioned Bloom filters over content fingerprints, a persistent fingerprint store,
verification by shared shingles, update of both. The store is a folder that can be opened again:

- prints/batch=B/part=K: (key, class), sorted by key, split by key;
- filters/batch=B: Bloom filter segments, one or more a part and batch;
- records/batch=B: (id, class, n, sketches, shingles);
- common: which shingles are set phrases, as counted over the first history and kept since;
- meta/B.json: parts and prints, written last, so that a batch that broke off counts as never accepted.

The fingerprints of a record are the minima of its shingles under fixed orders, three or four
packed into one key: the keys of the multi-index join (see neardup). Fingerprints winnowed by
position were built first and given up: runs of eight tokens lost pairs that are edited evenly
(a word in ten), and runs short enough to keep these (a window of four shingles of three tokens)
met 10 billion pairs of 200,000 posts by their set phrases. A key of minima is shared in
proportion to a power of the similarity, wherever the edits are.

A batch's keys meet the filters first; what no filter knows is new and goes no further. The rest
is looked up in the parts of the store that hold it, and candidates are verified on their full
shingle sets. Only the keys and the candidates' shingles are read again, never a text. When the
parts have grown to GROWN times their size, the store splits itself into more of them, so that
a part, and what a small batch reads, stays of one size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import neardup, shingles as S
from tidewire.session import Scratch, get_json, put_json, small_side

#: Keys that a part of the store is made for; 10 bits and 5 hashes a key, 1 % false positives.
PER_PART, BITS, ROUNDS = 1_000_000, 10, 5
#: Times PER_PART that a part may hold before the store is split anew.
GROWN = 4
THRESHOLD = neardup.THRESHOLD
PRINTS = "key bigint, class bigint, batch int, part int"
FILTERS = "part int, bits bigint, field binary, batch int"
RECORDS = neardup.RECORDS + ", batch int"


def _positions(keys: np.ndarray, bits: int) -> np.ndarray:
    h = S.mixed(keys.view(np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(r) * step) % np.uint64(bits) for r in range(ROUNDS)])


def _build_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bloom filter segments (part, bits, field) of (part, key): one for each part and run of PER_PART keys in a task."""
    held: dict[int, list[np.ndarray]] = {}

    def segment(part: int, keys: np.ndarray) -> pa.RecordBatch:
        bits = max(1024, len(keys) * BITS)
        marks = np.zeros(bits, bool)
        marks[_positions(keys, bits)] = True
        field = np.packbits(marks, bitorder="little")
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits], pa.int64()), pa.array([field.tobytes()], pa.binary())], names=["part", "bits", "field"])

    for batch in batches:
        parts, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for p in np.unique(parts):
            own = held.setdefault(int(p), [])
            own.append(keys[parts == p])
            if sum(map(len, own)) >= PER_PART:
                yield segment(int(p), np.unique(np.concatenate(held.pop(int(p)))))
    for p, own in held.items():
        yield segment(p, np.unique(np.concatenate(own)))


def _screen(new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The rows of a part's keys that some segment of its filter may know."""
    hit = np.zeros(len(new), bool)
    keys = new["key"].to_numpy(np.int64)
    for bits, field in zip(filters["bits"], filters["field"]):
        f = np.frombuffer(field, np.uint8)
        at = _positions(keys, int(bits))
        hit |= ((f[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
    return new[hit].drop_duplicates()  # copies within the batch: all rows of a key are here


class FingerprintStore:
    """The accepted history in a folder that all executors share. A batch is staged, matched and accepted, in this order."""

    def __init__(self, spark: SparkSession, path: str, common: np.ndarray, parts: int, batches: int, threshold: float = THRESHOLD) -> None:
        self.spark, self.path, self.threshold, self.parts, self.batches, self.held = spark, path.rstrip("/"), threshold, parts, batches, 0
        self.common = spark.sparkContext.broadcast(common)
        self.scratch = Scratch(spark, "history")

    @classmethod
    def create(cls, spark: SparkSession, path: str, history: DataFrame, threshold: float = THRESHOLD, per_part: int = PER_PART) -> FingerprintStore:
        """A new store of (id, title, text) rows; common shingles are those of this history."""
        store = cls(spark, path, np.empty(0, np.int64), 8, 0, threshold)
        records = store.stage(history)
        n, common = records.count(), neardup.common_slots(records)
        spark.createDataFrame([(int(x),) for x in common], "slot bigint").coalesce(1).write.mode("overwrite").parquet(f"{store.path}/common")
        store.common = spark.sparkContext.broadcast(common)
        store.parts = max(8, -(-n * 5 * neardup.CHUNKS // per_part))  # about five keys a chunk
        store.accept(records)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, threshold: float = THRESHOLD) -> FingerprintStore:
        """A store as its last accepted batch left it."""
        at = path.rstrip("/")
        common = np.sort(spark.read.schema("slot bigint").parquet(f"{at}/common").toArrow().column("slot").to_numpy())
        store = cls(spark, at, common, 0, 0, threshold)
        while meta := get_json(spark, store._meta(store.batches)):
            store.parts, store.held, store.batches = meta["parts"], meta["held"], store.batches + 1
        return store

    def _meta(self, batch: int) -> str:
        return f"{self.path}/meta/{batch}.json"

    def _read(self, what: str, schema: str) -> DataFrame:
        """A table of the store, accepted batches only."""
        df = self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}")
        return df.where(F.col("batch") < self.batches)

    def _part(self) -> F.Column:
        """The part of a key: also the task that holds it after repartition(parts, key)."""
        return F.pmod(F.hash("key"), F.lit(self.parts)).cast("int")

    def _write_prints(self, prints: DataFrame, at: str) -> None:
        once = prints.repartition(self.parts, "key").dropDuplicates(["key", "class"])
        once.withColumn("part", self._part()).sortWithinPartitions("part", "key").write.mode("append").partitionBy("part").parquet(at)

    def _write_filters(self, batch: int) -> None:
        prints = self.spark.read.schema("key bigint, class bigint, part int").parquet(f"{self.path}/prints/batch={batch}")
        prints.select("part", "key").mapInArrow(_build_filters, "part int, bits bigint, field binary").write.mode("overwrite").parquet(f"{self.path}/filters/batch={batch}")

    def stage(self, items: DataFrame) -> DataFrame:
        """The fingerprinted records of the next batch, of (id, title, text) rows: the only pass over its texts."""
        at = f"{self.path}/records/batch={self.batches}"
        fingerprinted(items).write.mode("overwrite").parquet(at)
        return self.spark.read.schema(neardup.RECORDS).parquet(at)

    def accept(self, records: DataFrame) -> None:
        """Adds staged records as the next batch."""
        at = f"{self.path}/prints/batch={self.batches}"
        self.scratch._delete(at)  # of an attempt that broke off
        n = records.count()
        for chunks in (passes := neardup.families(n)):
            self._write_prints(neardup.class_keys(records, self.common, chunks), at)
            if len(passes) > 1:
                self.scratch.release()
        self._write_filters(self.batches)
        self.held += n * 5 * neardup.CHUNKS  # about five keys a chunk
        put_json(self.spark, self._meta(self.batches), {"parts": self.parts, "held": self.held})
        self.batches += 1
        if self.held > GROWN * PER_PART * self.parts:
            self.split(-(-self.held // PER_PART))

    def split(self, parts: int) -> None:
        """Writes prints and filters anew in so many parts: one pass over them each time the store has grown GROWN times."""
        prints, self.parts = self._read("prints", PRINTS), parts
        for b in range(self.batches):
            own = self.scratch.write(prints.where(F.col("batch") == b).select("key", "class"), "split")
            self.scratch._delete(f"{self.path}/prints/batch={b}")
            self._write_prints(own, f"{self.path}/prints/batch={b}")
            self._write_filters(b)
            put_json(self.spark, self._meta(b), {"parts": parts, "held": self.held})
            self.scratch.release()

    def candidates(self, records: DataFrame, name: str) -> DataFrame:
        """(x, y): classes of a fingerprinted batch and of the history that share a key."""
        keys = neardup.class_keys(records, self.common)
        filters = self._read("filters", FILTERS).select("part", "bits", "field")
        screened = keys.withColumn("part", self._part()).groupBy("part").cogroup(filters.groupBy("part")).applyInPandas(_screen, "key bigint, class bigint, part int")
        positive = self.scratch.write(screened.select("key", F.col("class").alias("x"), "part"), f"{name}/positive")
        n, stored = positive.count(), self._read("prints", PRINTS)
        if n < 4 * self.parts:  # else nearly every part is met
            known = positive.select("part").distinct().toArrow().column("part").to_pylist()
            stored = stored.where(F.col("part").isin(known))
        met = stored.select("key", F.col("class").alias("y")).join(small_side(positive.select("key", "x"), n), "key")
        return self.scratch.write(met.select("x", "y").distinct(), f"{name}/met")

    def match(self, records: DataFrame, name: str = "look") -> DataFrame:
        """(id, old_id, similarity): the staged records with every similar accepted record."""
        met = self.candidates(records, name)
        wanted = met.select(F.col("y").alias("class")).distinct()
        old = self._read("records", RECORDS).join(small_side(wanted, met.count()), "class", "left_semi")
        columns = ("class", "n", "sketch_a", "sketch_b", "grams")
        both = records.select(*columns).unionByName(old.select(*columns))
        near = self.scratch.write(neardup.near_candidates(met.where("x <> y"), both, self.threshold), f"{name}/near")
        close = neardup.verified(near, both, self.threshold).unionByName(met.where("x = y").select("x", "y", F.lit(1.0).alias("similarity")))
        mine = records.select(F.col("class").alias("x"), "id").distinct()
        theirs = old.select(F.col("class").alias("y"), F.col("id").alias("old_id")).distinct()
        return self.scratch.write(close.join(mine, "x").join(theirs, "y").select("id", "old_id", "similarity"), f"{name}/matched")

    def forget(self, name: str) -> None:
        """Drops the intermediate tables of a match."""
        self.scratch.drop(*[f"{name}/{x}" for x in ("positive", "met", "near")])
        self.scratch.release()


def fingerprinted(items: DataFrame) -> DataFrame:
    """RECORDS of (id, title, text); rows without id or with fewer than three tokens are left out."""
    return neardup.shingled(items)


def earlier_copies(spark: SparkSession, history: DataFrame, incoming: DataFrame, threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """(old_id, new_id, batch_id, similarity): each record of incoming with every similar record of history or of a smaller batch.

    Batches are taken in the order of batch_id: each is looked up and then accepted. path: folder
    of the store that is made of history and left there; without one it goes with the process.
    Records with fewer than three tokens have no pairs; rows without id or batch_id are ignored;
    rows delivered twice count once; an empty history or batch gives no rows.
    """
    store = FingerprintStore.create(spark, path or Scratch(spark, "store").path("at"), history, threshold)
    store.scratch.release()
    known = incoming.where(F.col("batch_id").isNotNull() & F.col("id").isNotNull())
    numbers = [r[0] for r in known.select("batch_id").distinct().orderBy("batch_id").collect()]
    found = None
    for b in numbers:
        records = store.stage(known.where(F.col("batch_id") == b))
        own = store.match(records, f"look{b}").select("old_id", F.col("id").alias("new_id"), F.lit(b).cast("int").alias("batch_id"), "similarity")
        found = own if found is None else found.unionByName(own)
        store.forget(f"look{b}")
        if b != numbers[-1] or path:
            store.accept(records)
    if found is None:
        return spark.createDataFrame([], "old_id bigint, new_id bigint, batch_id int, similarity double")
    pairs = found.where("old_id < new_id").groupBy("old_id", "new_id")
    return pairs.agg(F.min("batch_id").alias("batch_id"), F.max("similarity").alias("similarity"))
