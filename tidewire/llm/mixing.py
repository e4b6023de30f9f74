"""Problem 9: sources mixed to target weights.

Method: soft-membership mixing. Each document has a membership in the domains (the sources with
a target): documents with a source belong to it, for a label leaves nothing to predict; for those
without one a naive Bayes classifier, fitted on a bounded sample of labelled rows, predicts the
posterior of every domain and of "none of them", and that posterior is their membership. They
stand for their likeliest domain, whose cap holds for them. Nonnegative document rates are fitted by
distributed projected gradient descent on the squared relative gaps between expected domain
tokens and their targets. Each step is one pass over the documents that returns one sum per
domain; a document's rate follows from the steps so far, so rates are never stored or moved.

A rate is the expected number of uses, between 0 and the source's max_repeats. Uses are whole:
the whole part, and one more for the documents of a source whose hash falls below a bound, chosen
per size class so that the source's tokens come closest to its target.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import tokenizer
from tidewire.llm.shingles import HASHES
from tidewire.session import Scratch

#: Labelled rows per class on which the classifier is fitted at most, and its number of hashed features.
FIT_ROWS, FEATURES = 2_000, 1 << 13
STEPS, TOLERANCE, RATE = 60, 1e-5, 0.7
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
#: Size classes (powers of two of tokens) and bins of the hash by which uses are made whole.
SIZES, BIN_BITS = 20, 12
_WORD = re.compile(r"\w+")


def _features(text: str | None) -> np.ndarray:
    tokens = set(_WORD.findall((text or "").lower()))
    return np.fromiter((HASHES[t] % FEATURES for t in tokens), np.int64, len(tokens))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, feature, n) of a task; feature -1 counts the documents."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = held.setdefault(label, np.zeros(FEATURES + 1, np.int64))
            own[_features(text)] += 1
            own[-1] += 1
    for label, own in held.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label, np.int32)), pa.array(np.where(at == FEATURES, -1, at).astype(np.int32)), pa.array(own[at])], names=["label", "feature", "n"])


class Classifier:
    """Naive Bayes over the distinct words of a text."""

    def __init__(self, classes: int, rows: list) -> None:
        counts = np.zeros((classes, FEATURES), np.float64)
        documents = np.zeros(classes)
        for label, feature, n in rows:
            if feature < 0:
                documents[label] = n
            else:
                counts[label, feature] = n
        self.weights = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * FEATURES))
        self.prior = np.log((documents + 1) / (documents.sum() + classes))

    temperature = 1.0

    def scores(self, text: str | None) -> np.ndarray:
        return self.weights[:, _features(text)].sum(axis=1)

    def posterior(self, text: str | None, temperature: float | None = None) -> np.ndarray:
        score = self.prior + self.scores(text) / (temperature or self.temperature)
        p = np.exp(score - score.max())
        return p / p.sum()


def _fit(spark: SparkSession, labelled: DataFrame, classes: int, fit_rows: int) -> Classifier:
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bound = F.element_at(F.array(*[F.lit(min(1.0, fit_rows / sizes.get(c, 1))) for c in range(classes)]), F.col("label") + 1)
    at = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    counted = labelled.where(at < bound * 0.75).select("label", "text").mapInArrow(_counts, "label int, feature int, n bigint").groupBy("label", "feature").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # at most classes x features rows
    model = Classifier(classes, list(zip(*(rows.column(i).to_pylist() for i in range(3)))))
    # words aren't independent: the temperature is the one under which held-out labels are likeliest
    shared = spark.sparkContext.broadcast(model)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERATURES))
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                scores = shared.value.scores(text)
                for k, t in enumerate(TEMPERATURES):
                    x = shared.value.prior + scores / t
                    total[k] -= x[label] - x.max() - np.log(np.exp(x - x.max()).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["t", "loss"])

    held_out = labelled.where((at >= bound * 0.75) & (at < bound)).select("label", "text").mapInArrow(losses, "t int, loss double")
    loss = {r["t"]: r["loss"] for r in held_out.groupBy("t").agg(F.sum("loss").alias("loss")).collect()}
    model.temperature = TEMPERATURES[min(loss, key=loss.get)] if loss else 1.0
    return model


def _rates(history: np.ndarray, members: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Rates after the steps so far: each moves along its membership's gap, then back between 0 and cap."""
    rate = np.zeros(len(cap))
    for gap in history:
        rate = np.clip(rate - RATE * (members @ gap), 0, cap)
    return rate


def _expected(history: np.ndarray, domains: int):
    """Sums over a task of rate x tokens x membership, one per domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(domains)
        for batch in batches:
            tokens, cap = batch.column(0).to_numpy().astype(float), batch.column(1).to_numpy().astype(float)
            if len(tokens):
                members = batch.column(2).flatten().to_numpy().reshape(len(tokens), domains)
                total += (_rates(history, members, cap) * tokens) @ members
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(domains), pa.int32()), pa.array(total)], names=["domain", "tokens"])

    return run


class Mix:
    """The fitted mix: documents() gives the uses, shares() the report."""

    def __init__(
        self, spark: SparkSession, documents: DataFrame, targets: DataFrame, vocabulary: str = tokenizer.VOCABULARY,
        fit_rows: int = FIT_ROWS, total_tokens: float | None = None,
    ) -> None:
        self.spark, self.scratch = spark, Scratch(spark, "mixing")
        # targets are a parameter table: one row per source
        wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("cap"))
        self.wanted = {r["source"]: (r["share"], r["cap"]) for r in wanted.orderBy("source").collect()}
        self.names = list(self.wanted)
        d = len(self.names)
        once = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.when(F.trim("source") != "", F.col("source")).alias("source"), "text")
        number = F.create_map(*[x for i, n in enumerate(self.names) for x in (F.lit(n), F.lit(i))])[F.col("source")] if d else F.lit(None).cast("int")
        domain = once.withColumn("label", F.when(F.col("source").isNotNull(), F.coalesce(number, F.lit(d))).cast("int"))
        labelled, unknown = domain.where("label is not null"), domain.where("label is null")
        classifier = _fit(spark, labelled, d + 1, fit_rows)
        shared = spark.sparkContext.broadcast(classifier)

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = [shared.value.posterior(t)[:d] for t in batch.column(1).to_pylist()] if d else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(0, len(p)), pa.array([int(np.argmax(x)) for x in p], pa.int32()), pa.array([list(map(float, x)) for x in p], pa.list_(pa.float64())), batch.column(1).slice(0, len(p))],
                    names=["doc_id", "domain", "members", "text"],
                )

        one_hot = F.transform(F.sequence(F.lit(0), F.lit(max(d - 1, 0))), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0))
        own = labelled.where(F.col("label") < d).select("doc_id", F.col("label").alias("domain"), one_hot.alias("members"), F.lit(True).alias("known"), "text")
        guessed = unknown.select("doc_id", "text").mapInArrow(predict, "doc_id bigint, domain int, members array<double>, text string").withColumn("known", F.lit(False))
        rows = tokenizer.counted(own.unionByName(guessed), "text", vocabulary).where("tokens > 0")
        caps = F.element_at(F.array(*[F.lit(float(self.wanted[n][1])) for n in self.names] or [F.lit(0.0)]), F.col("domain") + 1)
        self.rows = self.scratch.write(rows.dropDuplicates(["doc_id"]).withColumn("cap", caps), "rows")
        held = {r["domain"]: r["tokens"] for r in self.rows.where("known").groupBy("domain").agg(F.sum("tokens").alias("tokens")).collect()}
        self.available = np.array([float(held.get(i, 0)) for i in range(d)])
        share = np.array([self.wanted[n][0] for n in self.names])
        cap = np.array([float(self.wanted[n][1]) for n in self.names])
        can = (self.available > 0) & (cap > 0)
        self.reachable = share * can
        # the largest total at which every source that has documents reaches its share
        most = np.min((self.available * cap)[can] / self.reachable[can]) * self.reachable.sum() if can.any() else 0.0
        total = min(most, total_tokens) if total_tokens else most
        self.goal = total * self.reachable / max(self.reachable.sum(), 1e-12)
        self.history = self._descend()

    def _descend(self) -> np.ndarray:
        d, base = len(self.names), np.maximum(self.available, 1.0)
        history = np.zeros((0, d))
        for _ in range(STEPS if d else 0):
            got = np.zeros(d)
            if len(history):
                sums = self.rows.select("tokens", "cap", "members").mapInArrow(_expected(history, d), "domain int, tokens double")
                for r in sums.groupBy("domain").agg(F.sum("tokens").alias("tokens")).collect():
                    got[r["domain"]] = r["tokens"]
            gap = (got - self.goal) / base
            if np.max(np.abs(got - self.goal) / np.maximum(self.goal, 1.0)) < TOLERANCE:
                break
            history = np.vstack([history, gap])
        return history

    def documents(self) -> DataFrame:
        """(doc_id, source, copies, tokens, rate): the documents in the mix, with the source they stand for; copies is at least 1."""
        history, d = self.history, len(self.names)

        def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                members = batch.column(4).flatten().to_numpy().reshape(n, d) if n else np.zeros((0, d))
                rate = _rates(history, members, batch.column(3).to_numpy().astype(float)) if n else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1, 2, 5)], pa.array(rate)], names=["doc_id", "domain", "tokens", "known", "rate"])

        rows = self.rows.select("doc_id", "domain", "tokens", "cap", "members", "known").mapInArrow(rated, "doc_id bigint, domain int, tokens bigint, known boolean, rate double")
        rate = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-3, F.round("rate")).otherwise(F.col("rate"))
        split = self.scratch.write(
            rows.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("bigint")).withColumn("part", F.col("rate") - F.floor("rate")).withColumn("at", F.pmod(F.xxhash64("doc_id", F.lit(90)), F.lit(1 << 30))).withColumn("size", F.least(F.log2("tokens"), F.lit(SIZES - 1)).cast("int")), "rated"
        )
        bounds = self._bounds(split)
        bound = F.element_at(F.array(*[F.lit(int(b)) for own in bounds for b in own] or [F.lit(0)]), F.col("domain") * SIZES + F.col("size") + 1)
        extra = F.when(F.col("part") == 0, False).otherwise(F.col("at") < bound)
        name = F.element_at(F.array(*[F.lit(n) for n in self.names] or [F.lit(None).cast("string")]), F.col("domain") + 1)
        return split.select("doc_id", name.alias("source"), (F.col("whole") + extra.cast("int")).cast("int").alias("copies"), "tokens", "known", "rate").where("copies > 0")

    def _bounds(self, split: DataFrame) -> list[list[int]]:
        """Per domain and size class, the hash below which a document gets one more use.

        Size classes go from the longest documents to the shortest, and each hands on what it has
        left open, so that the shortest ones even out what the longest leave.
        """
        d = len(self.names)
        fixed = split.groupBy("domain").agg(F.sum(F.col("whole") * F.col("tokens")).alias("tokens")).collect()
        left = self.goal.copy()
        for r in fixed:
            left[r["domain"]] -= r["tokens"]
        # at most domains x SIZES x BINS rows
        bins = split.where("part > 0").groupBy("domain", "size", F.shiftright("at", 30 - BIN_BITS).alias("bin")).agg(F.sum("tokens").alias("tokens")).collect()
        table = np.zeros((d, SIZES, 1 << BIN_BITS))
        for r in bins:
            table[r["domain"], r["size"], r["bin"]] = r["tokens"]
        bounds = [[0] * SIZES for _ in range(d)]
        for i in range(d):
            open_ = table[i].sum()
            for size in range(SIZES - 1, -1, -1):
                own = table[i, size].sum()
                if not own or left[i] <= 0:
                    continue
                sums = np.cumsum(table[i, size])
                aim = left[i] * own / open_
                full = int(np.searchsorted(sums, aim, "right"))
                if full < len(sums) and sums[full] - aim < aim - (sums[full - 1] if full else 0.0):
                    full += 1  # the nearest, so that a source of few long documents gets its share of them
                left[i] -= sums[full - 1] if full else 0.0
                open_ -= own
                bounds[i][size] = min(full, len(sums)) << (30 - BIN_BITS)
        return bounds

    def shares(self, mix: DataFrame) -> DataFrame:
        """(source, target_share, max_repeats, documents, uses, mixed_tokens, actual_share): one row per source with a target."""
        done = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("uses"), F.max("copies").alias("most"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"))
        wanted = self.spark.createDataFrame([(n, float(s), int(c)) for n, (s, c) in self.wanted.items()], "source string, target_share double, max_repeats int")
        all_ = wanted.join(done, "source", "left").fillna(0)
        total = mix.agg(F.sum(F.col("copies") * F.col("tokens")).alias("all_tokens"))
        return all_.join(F.broadcast(total.withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).select(
            "source", "target_share", "max_repeats", "documents", "uses", F.col("most").alias("most_uses"), "mixed_tokens", (F.col("mixed_tokens") / F.col("all_tokens")).alias("actual_share")
        )


def mixed(spark: SparkSession, documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(doc_id, source, copies, tokens): how often each document is used, so that each source reaches its target share of all tokens.

    Documents of sources without a target are left out; of repeated doc_ids one counts; null and
    empty texts have no tokens and no row. Targets that are null or not positive are ignored. A
    source with a target but no documents can't be reached; the others keep their proportions.
    """
    return Mix(spark, documents, targets, **options).documents().select("doc_id", "source", "copies", "tokens")


def mixed_shares(spark: SparkSession, documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    mix = Mix(spark, documents, targets, **options)
    return mix.shares(mix.scratch.write(mix.documents(), "mix"))
