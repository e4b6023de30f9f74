"""Grouping within events, and order-dependent folds over arrivals.

The folds take rows one after the other and depend on their order, so each key is one fold:
exact, as their definition asks, and bounded by the rows of a key. Keys spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def independent_sources(items: DataFrame, most: int = 6, blank_counts: bool = True) -> DataFrame:
    """A5: (event_id, independent): sources of an event that no copy links.

    items: (event_id, source_id, content_hash, simhash, forwarded_from, source_name). Two sources
    are linked by an equal hash, simhashes within `most` bits, the same origin of forwarding, or a
    forward of one from the other. Null values link nothing. blank_counts=False leaves out items
    whose simhash is 0, as blank posts have.
    """
    columns = ["event_id", "source_id", "content_hash", "simhash", "forwarded_from", "source_name"]

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        event = rows["event_id"].iloc[0]
        if not blank_counts:
            rows = rows[rows["simhash"].fillna(0) != 0]
        parent = {s: s for s in rows["source_id"].unique()}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def link(group) -> None:
            own = list(group)
            for other in own[1:]:
                parent[find(other)] = find(own[0])

        norm = lambda s: s.str.strip().str.lower().replace("", None)
        forwarded, name = norm(rows["forwarded_from"].astype("object")), norm(rows["source_name"].astype("object"))
        for key in (rows["content_hash"], forwarded):
            for _, group in rows["source_id"].groupby(key):
                link(group)
        by_name = dict(zip(name, rows["source_id"]))
        for f, s in zip(forwarded, rows["source_id"]):
            if f is not None and f in by_name:
                link([by_name[f], s])
        # one signature of each value and source is enough
        signed = rows.dropna(subset=["simhash"]).drop_duplicates(["source_id", "simhash"])
        bits, sources = signed["simhash"].to_numpy(np.int64).view(np.uint64), signed["source_id"].to_list()
        for i in range(len(bits)):
            for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= most) + i + 1:
                link([sources[i], sources[j]])
        return pd.DataFrame({"event_id": [event], "independent": [len({find(x) for x in parent})]})

    return items.where(F.col("event_id").isNotNull() & F.col("source_id").isNotNull()).select(*columns).groupBy("event_id").applyInPandas(count, "event_id bigint, independent int")


class _Open:
    """The clusters of one key that may still be open, for vectors of one length.

    Rows come in blocks: one product of matrices has a block's cosines with all clusters, and after
    each row only the column of the cluster it changed is computed again. These cosines only screen:
    what lies within CLOSE of the greatest is computed once more, the same way at any place.
    """

    CLOSE = 1e-9

    def __init__(self, length: int, threshold: float, within: int) -> None:
        self.threshold, self.within, self.n = threshold, within, 0
        self.centroid, self.unit = np.empty((0, length)), np.empty((0, length))
        self.norm, self.count, self.last, self.first = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object)

    def _keep(self, since: int, more: int) -> None:
        """Lets go of clusters closed before `since`, in their order, and makes room for more."""
        live = np.flatnonzero(self.last[: self.n] >= since)
        if len(live) == self.n and self.n + more <= len(self.norm):
            return
        for name in ("centroid", "unit", "norm", "count", "last", "first"):
            old = getattr(self, name)
            new = np.empty((len(live) + max(more, len(live) // 2), *old.shape[1:]), old.dtype)
            new[: len(live)] = old[live]
            setattr(self, name, new)
        self.n = len(live)

    def _put(self, j: int, v: np.ndarray) -> None:
        norm = float(np.sqrt(v @ v))
        self.centroid[j], self.norm[j] = v, norm
        self.unit[j] = v / norm if norm else 0.0

    def take(self, at: np.ndarray, ids: list, v: np.ndarray) -> tuple[list, list]:
        """The clusters and cosines of a block of rows in the order of their arrival."""
        self._keep(int(at[0]) - self.within, len(v))
        norms = np.sqrt(np.einsum("ij,ij->i", v, v))
        told = np.isfinite(norms) & (norms > 0)
        unit = np.divide(v, norms[:, None], out=np.zeros_like(v), where=told[:, None])
        cos = np.empty((len(v), self.n + len(v)))
        cos[:, : self.n] = unit @ self.unit[: self.n].T
        cos[np.isnan(cos)] = -np.inf
        cluster, cosine = [], []
        for k in range(len(v)):
            which, best = None, 1.0
            while told[k] and self.n:
                row = cos[k, : self.n]
                top = row.max()
                if not top >= self.threshold - self.CLOSE:
                    break
                near = np.flatnonzero(row >= top - self.CLOSE)
                closed = near[at[k] - self.last[near] > self.within]
                if len(closed):
                    cos[k:, closed] = -np.inf
                    continue
                exact = [float(self.centroid[j] @ v[k]) / (self.norm[j] * norms[k]) if self.norm[j] else 0.0 for j in near]
                best = max(exact)
                if best >= self.threshold:
                    which = int(near[exact.index(best)])
                break
            if which is None:
                which, best, self.n = self.n, 1.0, self.n + 1
                self.count[which], self.first[which] = 1, ids[k]
                self._put(which, v[k])
            else:
                n = self.count[which]
                self._put(which, (self.centroid[which] * n + v[k]) / (n + 1))
                self.count[which] = n + 1
            self.last[which] = at[k]
            again = unit[k + 1 :] @ self.unit[which]
            cos[k + 1 :, which] = np.where(np.isnan(again), -np.inf, again)
            cluster.append(self.first[which])
            cosine.append(float(best))
        return cluster, cosine


def greedy_clusters(rows: DataFrame, key: str, threshold: float = 0.83, hours: float = 48.0, block: int = 256) -> DataFrame:
    """T4, T5: (key, id, cluster_id, cosine): each vector joins the nearest open cluster of its key, or opens one.

    rows: (key, id, at, vector), taken in the order of at, id. A cluster is open for `hours` after
    its last member; its centroid is the running mean; among equals the earliest cluster wins.
    cluster_id is the id of its first member. Rows without vector or time are left out; a vector of
    length 0 or that holds nulls opens a cluster which no other joins. A key is one task, which
    reads its rows in order and holds its open clusters alone.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_ = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, at, vectors = batch.column(0), batch.column(1).to_pylist(), batch.column(2).cast(pa.int64()).to_numpy(), batch.column(3)
            values, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes := pc.list_value_length(vectors).to_numpy())
            names = keys.to_pylist()
            new = np.flatnonzero((sizes[1:] != sizes[:-1]) | np.array([x != y for x, y in zip(names, names[1:])], bool)) + 1
            cluster, cosine = [], []
            for begin, end in zip([0, *new], [*new, len(ids)]):
                if held is None or held[0] != names[begin]:
                    held, open_ = (names[begin],), {}
                size = int(sizes[begin])
                clusters = open_.get(size) or open_.setdefault(size, _Open(size, threshold, round(hours * 3_600_000_000)))
                v = values[ends[begin] - size : ends[end - 1]].reshape(end - begin, size)
                for k in range(0, end - begin, block):
                    c, x = clusters.take(at[begin + k : min(begin + k + block, end)], ids[begin + k : min(begin + k + block, end)], v[k : k + block])
                    cluster += c
                    cosine += x
            yield pa.RecordBatch.from_arrays([keys, batch.column(1), pa.array(cluster, pa.int64()), pa.array(cosine, pa.float64())], names=["key", "id", "cluster_id", "cosine"])

    kept = rows.where(F.col("vector").isNotNull() & F.col("at").isNotNull()).select(F.col(key).cast("string").alias("key"), F.col("id").cast("bigint").alias("id"), "at", F.col("vector").cast("array<double>").alias("vector"))
    return kept.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(fold, "key string, id bigint, cluster_id bigint, cosine double")


def merged_facts(facts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Facts of an event that say the same become one, in the order of their ids.

    facts: (event_id, id, text, value, source_id, vector). A fact joins the first merged fact of the
    greatest cosine of at least threshold. confirmed_by counts distinct sources; divergent when the
    rounded values differ.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in pdf.sort_values("id").itertuples():
            v = np.asarray(r.vector, float)
            n = np.linalg.norm(v)
            best, which = threshold, None
            for k in kept:
                m = np.linalg.norm(k["vector"]) * n
                c = float(k["vector"] @ v / m) if m else 0.0
                if c > best or (which is None and c >= best):
                    best, which = c, k
            if which is None:
                which = {"vector": v, "text": r.text, "sources": [], "values": [], "variants": []}
                kept.append(which)
            if r.source_id not in which["sources"]:
                which["sources"].append(r.source_id)
            if r.value is not None and not np.isnan(r.value) and round(r.value, 2) not in which["values"]:
                which["values"].append(round(r.value, 2))
            if r.text not in which["variants"]:
                which["variants"].append(r.text)
        event = pdf["event_id"].iloc[0]
        return pd.DataFrame([(event, k["text"], len(k["sources"]), k["values"], len(k["values"]) > 1, k["variants"]) for k in kept], columns=["event_id", "text", "confirmed_by", "values", "divergent", "variants"])

    return facts.where(F.col("vector").isNotNull()).groupBy("event_id").applyInPandas(fold, "event_id bigint, text string, confirmed_by int, values array<double>, divergent boolean, variants array<string>")


def repeat_share(rows: DataFrame, key: str, most: int = 6) -> DataFrame:
    """(key, n, repeats): rows within `most` bits of an earlier kept one, in the order of their ids; a repeat isn't kept itself."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = np.empty(0, np.uint64)
        repeats = 0
        for h in pdf.sort_values("id")["simhash"].to_numpy(np.int64).view(np.uint64):
            if len(seen) and (np.bitwise_count(seen ^ h) <= most).any():
                repeats += 1
            else:
                seen = np.append(seen, h)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n": [len(pdf)], "repeats": [repeats]})

    kept = rows.where(F.col("simhash").isNotNull()).select(F.col(key).cast("string").alias("key"), "id", "simhash")
    return kept.groupBy("key").applyInPandas(fold, "key string, n bigint, repeats bigint")
