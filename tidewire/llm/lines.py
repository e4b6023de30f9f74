"""Problem 5: lines that one source repeats in its documents.

Method: content-defined chunking. A rolling hash over WINDOW characters cuts wherever its value
has a fixed form, so the same wording gives the same chunks wherever it stands, and a text
without line feeds is cut all the same. Distinct documents are counted per source and chunk, and
chunks repeated excessively are cut. A line feed ends a chunk as well: a repeated line must come
out as a whole, however short it is.

repeated_lines(): a line that stands in n documents of a source has all its chunks in at least n
of them. So the lines whose witness chunk (the one of least hash) is repeated often enough are a
superset of the repeated lines, and only these are counted exactly.

cleaned(): repeated lines go as they are; within the other lines the runs of words that lie in
repeated chunks are cut. A chunk ends anywhere in a word, so a run is first taken to whole words
and then led on, word by word to either side, as long as enough documents of the source go on
alike: what is cut is wording that the source repeats, up to its first and last word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.shingles import mixed
from tidewire.session import Scratch, small_side

WINDOW = 8
#: One character in so many ends a chunk on average.
AVERAGE = 32
LEAST_DOCUMENTS, LEAST_SHARE = 5, 0.05
#: Characters that a run of repeated words within a line has at least, and words by which it is led on to either side at most (more than two chunks).
LEAST_RUN, REACH = 64, 16
#: Documents of a source that one task cleans at most, about.
SPREAD = 50_000
_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)


def lines_of(text: str | None) -> list[str]:
    """The lines of a text, lower-cased, white space made one blank, empty ones dropped."""
    return [y for x in (text or "").split("\n") if (y := " ".join(x.lower().split()))]


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines joined by line feeds: chunk ends, chunk hashes, and the line each chunk belongs to (counted over all texts).

    A line's first and last chunk are bounded by its line feeds; the rolling hash starts anew in
    each line, so chunks depend on the line's own characters only.
    """
    raw = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = len(raw)
    if not size:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    feed = raw == 10
    value = mixed(raw + np.uint64(1))
    line = np.cumsum(feed) - feed
    starts = np.concatenate([[0], np.flatnonzero(feed)[:-1] + 1])
    rolling = np.zeros(size, np.uint64)
    power = 1
    since = np.arange(size) - starts[line]
    for j in range(WINDOW):
        moved = np.zeros(size, np.uint64)
        moved[j:] = value[: size - j]
        moved[since < j] = 0
        rolling += moved * np.uint64(power)
        power = power * _B % (1 << 64)
    cut = feed | ((mixed(rolling) % np.uint64(AVERAGE) == 0) & ~np.concatenate([feed[1:], [False]]))
    ends = np.flatnonzero(cut) + 1
    begins = np.concatenate([[0], ends[:-1]])
    # polynomial hash of any span from prefix sums: B is odd, so its powers have inverses
    powers = np.cumprod(np.full(size, np.uint64(_B)))
    inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(_INVERSE))])) if size > 1 else np.ones(1, np.uint64)
    body = np.where(feed, np.uint64(0), value)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(body * powers)])
    return ends, mixed((sums[ends] - sums[begins]) * inverses[begins]), line[ends - 1]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct chunks of each document: (source, chunk)."""
    schema = pa.schema([("source_id", pa.int64()), ("chunk", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            texts = [lines_of(t) for t in part.column(1).to_pylist()]
            document = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
            _, hashes, line = chunks([x for t in texts for x in t])
            if not len(hashes):
                continue
            owner = document[line]
            order = np.lexsort((hashes, owner))
            h, o = hashes[order], owner[order]
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            sources = np.array(part.column(0).to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sources[o[keep]]), pa.array(h[keep].view(np.int64))], schema=schema)


def _witnessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct lines of each document with their witness chunk: (source, id, line, witness)."""
    schema = pa.schema([("source_id", pa.int64()), ("id", pa.int64()), ("line", pa.string()), ("witness", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            texts = [list(dict.fromkeys(lines_of(t))) for t in part.column(2).to_pylist()]
            each = [len(x) for x in texts]
            flat = [x for t in texts for x in t]
            _, hashes, line = chunks(flat)
            if not len(hashes):
                continue
            first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            witness = np.minimum.reduceat(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(part.column(i).to_pylist(), np.int64), each)) for i in (0, 1)] + [pa.array(flat, pa.string()), pa.array(witness.view(np.int64))], schema=schema
            )


def _known(items: DataFrame) -> DataFrame:
    return items.where(F.col("source_id").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("source_id").cast("bigint").alias("source_id"), F.col("id").cast("bigint").alias("id"), "text"
    )


def _thresholds(items: DataFrame, least: int, share: float) -> DataFrame:
    """(source_id, most, needed): documents with text of each source, and how many of them make a line repeated."""
    blank = F.regexp_replace("text", r"(?U)[\s\x1c-\x1f\x85]+", "") == ""
    counts = items.where(~blank).groupBy("source_id").agg(F.countDistinct("id").alias("documents"))
    return counts.select("source_id", "documents", F.greatest(F.lit(least), F.ceil(F.col("documents") * F.lit(share) - 1e-9)).alias("needed"))


def _counted(scratch: Scratch, rows: DataFrame, least: int, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, hot, needed): repeated lines, repeated chunks, and the bounds per source, of known rows."""
    needed = scratch.write(_thresholds(rows, least, share), "needed")
    counts = rows.select("source_id", "text").mapInArrow(_chunked, "source_id bigint, chunk bigint").groupBy("source_id", "chunk").agg(F.count("*").alias("n"))
    hot = scratch.write(counts.join(needed, "source_id").where("n >= needed").select("source_id", F.col("chunk").alias("witness")), "hot")
    # at most 1 / share times a source's chunks per document, counted before it is broadcast
    seen = (
        rows.select("source_id", "id", "text")
        .mapInArrow(_witnessed, "source_id bigint, id bigint, line string, witness bigint")
        .join(small_side(hot, hot.count()), ["source_id", "witness"], "left_semi")
    )
    found = seen.groupBy("source_id", "line").agg(F.countDistinct("id").alias("documents"))
    found = found.join(needed.select("source_id", "needed"), "source_id").where("documents >= needed").select(F.col("source_id").cast("int").alias("source_id"), "line", "documents")
    return found, hot, needed


def repeated_lines(spark: SparkSession, items: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE) -> DataFrame:
    """(source_id, line, documents): lines in at least `least` documents of a source and at least `share` of its documents with text.

    A line counts once a document, a document (id) once. Rows without source, id or text are
    ignored; blank texts don't count; an empty table gives no rows.
    """
    # repeated rows may count a chunk twice here: that only makes the superset larger
    return _counted(Scratch(spark, "lines"), _known(items), least, share)[0]


class _Patterns:
    """What a source repeats: whole lines, chunks, and how runs go on."""

    def __init__(self) -> None:
        self.lines: set[str] = set()
        self.chunks: list[int] = []
        self.going_on: set[int] = set()

    def add(self, kind: int, key: int | None, line: str | None) -> None:
        if kind == 0:
            self.lines.add(line)
        elif kind == 1:
            self.chunks.append(key)
        else:
            self.going_on.add(key)

    def runs(self, texts: list[str]) -> Iterator[tuple[int, int, list[str], list[tuple[int, int]]]]:
        """(document, line, words, runs) of lines that aren't repeated as a whole but have runs (first word, end) of repeated chunks."""
        at, forms = [], []
        for d, text in enumerate(texts):
            for k, raw in enumerate(text.split("\n")):
                if len(raw) >= LEAST_RUN and (form := " ".join(raw.lower().split())) and form not in self.lines:
                    at.append((d, k, raw.split()))
                    forms.append(form)
        if not forms or not self.chunks:
            return
        ends, hashes, line = chunks(forms)
        begins = np.concatenate([[0], ends[:-1]])
        hot = np.isin(hashes.view(np.int64), np.array(self.chunks, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(f) + 1 for f in forms])])
        for n in np.unique(line[hot]):
            covered = np.zeros(len(forms[n]) + 2, np.int64)
            for c in np.flatnonzero(hot & (line == n)):
                covered[begins[c] - offsets[n] : ends[c] - offsets[n]] = 1
            sums, where, words = np.concatenate([[0], np.cumsum(covered)]), 0, forms[n].split(" ")
            spans = []
            for w in words:
                spans.append((where, where + len(w)))
                where += len(w) + 1
            inside = [sums[e] - sums[b] == e - b for b, e in spans]
            found, i = [], 0
            while i < len(words):
                j = i
                while j < len(words) and inside[j]:
                    j += 1
                if j > i and spans[j - 1][1] - spans[i][0] >= LEAST_RUN:
                    found.append((i, j))
                i = max(j, i + 1)
            if found and len(words) == len(at[n][2]):
                yield (*at[n][:2], at[n][2], found)


def _contexts(words: list[str], run: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
    """(side, words, key) of what stands beside a run, for 1, 2, ... words, until the line ends."""
    i, j = run
    low = [w.lower() for w in words]
    for k in range(1, min(REACH, i) + 1):
        yield 0, k, xxhash.xxh3_64_intdigest("0 " + " ".join(low[i - k : i + 3])) - (1 << 63)
    for k in range(1, min(REACH, len(words) - j) + 1):
        yield 1, k, xxhash.xxh3_64_intdigest("1 " + " ".join(low[j - 3 : j + k])) - (1 << 63)


def _cut(text: str, patterns: _Patterns, runs: dict[int, tuple[list[str], list[tuple[int, int]]]]) -> str:
    """text without its source's repeated lines and runs."""
    kept = []
    for k, raw in enumerate(text.split("\n")):
        if " ".join(raw.lower().split()) in patterns.lines:
            continue
        if k in runs:
            words, found = runs[k]
            gone = set()
            for i, j in found:
                more = [0, 0]
                for side, n, key in _contexts(words, (i, j)):
                    if n == more[side] + 1 and key in patterns.going_on:
                        more[side] = n
                gone |= set(range(i - more[0], j + more[1]))
            pieces, where = [], 0
            for n, w in enumerate(words):
                start = raw.index(w, where)
                if n not in gone:
                    pieces.append((raw[where:start] if pieces and n - 1 not in gone else " " if pieces else "") + w)
                where = start + len(w)
            if not pieces:
                continue
            raw = "".join(pieces)
        kept.append(raw)
    return "\n".join(kept)


_MERGED = "source_id bigint, salt int, kind int, key bigint, line string, id bigint, text string"


def _by_source(clean: bool):
    """Over rows of _MERGED, a source's patterns before its documents: the contexts (source_id, key) of each document's runs, or the cleaned documents."""

    def segment(source: int, patterns: _Patterns, docs: list[tuple[int, str]]) -> tuple[list, ...]:
        runs: dict[int, dict] = {}
        for d, k, words, found in patterns.runs([t for _, t in docs]):
            runs.setdefault(d, {})[k] = (words, found)
        if clean:
            return [source] * len(docs), [i for i, _ in docs], [_cut(t, patterns, runs.get(d, {})) for d, (_, t) in enumerate(docs)]
        keys = [key for own in runs.values() for key in {key for words, found in own.values() for run in found for _, _, key in _contexts(words, run)}]
        return [source] * len(keys), keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("source_id", pa.int64()), ("id", pa.int64()), ("cleaned", pa.string())] if clean else [("source_id", pa.int64()), ("key", pa.int64())]
        held, patterns, docs = None, _Patterns(), []
        out: list[list] = [[] for _ in types]

        def flush() -> None:
            for column, more in zip(out, segment(held[0], patterns, docs)):
                column.extend(more)

        for batch in batches:
            for source, salt, kind, key, line, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (source, salt) != held:
                    if docs:
                        flush()
                    held, patterns, docs = (source, salt), _Patterns(), []
                if kind < 3:
                    patterns.add(kind, key, line)
                else:
                    docs.append((i, text))
            if docs:
                flush()
                docs = []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, types)], schema=pa.schema(types))
            out = [[] for _ in types]

    return run


def cleaned(spark: SparkSession, items: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE) -> DataFrame:
    """(id, source_id, text, removed_chars): each document once, its text freed of its source's repeated lines and of repeated runs within its lines.

    What is kept has its own form; null texts, and texts without a source, stay as they are; a text
    of repeated lines only becomes empty. Documents meet the patterns of their source in tasks of
    about SPREAD documents, patterns first; neither side is broadcast.
    """
    scratch = Scratch(spark, "clean")
    once = scratch.write(items.where(F.col("id").isNotNull()).select("id", "source_id", "text").dropDuplicates(["id"]), "once")
    rows = _known(once)
    found, hot, needed = _counted(scratch, rows, least, share)
    found = scratch.write(found, "found")
    most = needed.agg(F.max("documents")).first()[0] or 0
    salts = -(-most // SPREAD) or 1
    none = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in _MERGED.split(", ")}

    def merged(patterns: DataFrame) -> DataFrame:
        spread = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        docs = rows.select("source_id", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), F.lit(3).alias("kind"), none["key"].alias("key"), none["line"].alias("line"), "id", "text")
        both = spread.select("source_id", F.col("salt").cast("int").alias("salt"), "kind", "key", "line", none["id"].alias("id"), none["text"].alias("text")).unionByName(docs)
        return both.repartition("source_id", "salt").sortWithinPartitions("source_id", "salt", "kind")

    lines = found.select(F.col("source_id").cast("bigint").alias("source_id"), F.lit(0).alias("kind"), none["key"].alias("key"), "line")
    patterns = lines.unionByName(hot.select("source_id", F.lit(1).alias("kind"), F.col("witness").alias("key"), none["line"].alias("line")))
    contexts = merged(patterns).mapInArrow(_by_source(False), "source_id bigint, key bigint").groupBy("source_id", "key").agg(F.count("*").alias("n"))
    going_on = contexts.join(needed, "source_id").where("n >= needed").select("source_id", F.lit(2).alias("kind"), "key", none["line"].alias("line"))
    patterns = patterns.unionByName(scratch.write(going_on, "going_on"))
    done = merged(patterns).mapInArrow(_by_source(True), "source_id bigint, id bigint, cleaned string").select("id", "cleaned")
    text = F.coalesce("cleaned", "text")
    whole = once.join(done, "id", "left")
    return whole.select("id", "source_id", text.alias("text"), (F.length("text") - F.length(text)).alias("removed_chars"))
