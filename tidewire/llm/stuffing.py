"""Problem 10: pages of keywords, links or product tags instead of sentences.

Method: a text becomes a sequence of function words (each its own class) and word classes (form
and ending of a word, numbers, links, tags, marks). A class n-gram model is trained on the prose
of the corpus: the segments that end as sentences do and hold a function word, no link, no tag
and few repeated words, counted over all documents. A segment whose perplexity under this model is abnormally high
or low, against prose of its length, is no prose; a document is flagged when such segments make
up more than half of its characters.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.shingles import mixed
from tidewire.session import Scratch

# Frequent function words of the three languages.
FUNCTION_WORDS = {
    "uk": "і й та а але або чи що щоб як коли якщо бо тому адже проте однак хоча нібито мов ніж в у на з із зі до від по за під над при про для без через після перед між серед біля поблизу попри крім щодо протягом упродовж внаслідок унаслідок завдяки не ні ще вже лише тільки навіть також теж саме цей ця це ці той та те ті який яка яке які він вона воно вони ми ви я його її їх їхній свій бути є був була було були буде будуть має мають може можуть треба потрібно можна водночас раніше зокрема утім тим часом де там тут так щойно після же ж б би".split(),
    "en": "the a an and or but if that which who whom whose this these those it its he she they we you i his her their our your of in on at by for from to with without under over after before between during against about into near as than not no nor is are was were be been being has have had will would can could may might must should do does did there here when while where because so however also only even more most some any all each other such up out off down until since despite according".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn dass ob weil als wie in im an am auf aus bei beim mit nach von vom vor zu zum zur über unter zwischen während wegen trotz gegen durch für ohne um bis seit laut nicht kein keine noch schon nur auch sogar er sie es wir ihr ich sein seine ihre ist sind war waren wird werden wurde wurden hat haben hatte hätten kann können muss müssen soll sollen sei seien habe werde man sich so dabei jedoch doch zudem damit binnen rund".split(),
}
MARKS = ".,:;!?…-–—\"'«»„“”‘’()[]{}/|\\*•★·+=#@&%№₴$€£_~<>^"
CURRENCY = frozenset("грн uah usd eur gbp ₴ $ € £".split())
_TOKEN = re.compile(r"<a\s[^>]*>|</?[a-zA-Z][^<>]{0,200}>|(?:https?://|www\.)[^\s<>\"]+|[#@]\w+|\d+(?:[.,:]\d+)*|\w+(?:['’ʼ-]\w+)*|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"»”“’)]*\s+")
_MARKUP = re.compile(r"</?(?!a[\s>])[a-zA-Z][^<>]{0,200}>")
#: Characters that show nothing (soft hyphen, zero-width ones, marks of direction, byte order mark).
_INVISIBLE = dict.fromkeys([0xAD, 0x2060, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F)])
CLASSES = 512
#: Slots of the hashed trigram table: the model is of a fixed size, whatever the corpus.
SLOTS = 1 << 20
SHORTEST, LONGEST = 8, 40
#: Content words among which a repeated one counts as repeated, and the class it then has.
NEAR, AGAIN = 25, 63
LENGTHS = 12
#: Deviations from the mean perplexity of prose of the same length beyond which a segment is no prose.
ABOVE, BELOW = 3.0, 4.5


class Classes(dict):
    """Token to its class (the low 9 bits) and a hash of it (the others), kept per worker; emptied when it has grown to `most` tokens."""

    most = 500_000

    def __init__(self) -> None:
        super().__init__()
        words = sorted({w for own in FUNCTION_WORDS.values() for w in own})
        self.function = {w: 64 + i for i, w in enumerate(words)}
        self.first_suffix = 64 + len(words)
        self.marks = {m: 8 + i for i, m in enumerate(MARKS[:50])}

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[token] = (xxhash.xxh3_64_intdigest(token.lower()) >> 11 << 9) | self.of(token)
        return value

    def of(self, token: str) -> int:
        first = token[0]
        if token[:2] == "<a" or token.startswith(("http://", "https://", "www.")):
            return 1
        if first == "<" and len(token) > 1:
            return 2
        if first in "#@" and len(token) > 1:
            return 3
        low = token.lower()
        if low in CURRENCY:
            return 4
        if first.isdigit():
            return 5
        if len(token) == 1 and not token.isalnum():
            return self.marks.get(token, 6)
        if low in self.function:
            return self.function[low]
        if len(token) > 2 and token.isupper():
            return 7
        # endings: the last two letters, hashed to a fixed number of classes; capitalised words apart
        room = CLASSES - self.first_suffix
        titled = room // 4
        h = sum(ord(c) * f for c, f in zip(low[-2:], (131, 7)))
        return self.first_suffix + (h % titled if first.isupper() else titled + h % (room - titled))


CLASSIFY = Classes()
_REPEATED = np.arange(CLASSES) == AGAIN
_RAISED = np.zeros(CLASSES, bool)
_RAISED[7] = True
_RAISED[CLASSIFY.first_suffix : CLASSIFY.first_suffix + (CLASSES - CLASSIFY.first_suffix) // 4] = True
_LINKED = np.zeros(CLASSES, bool)
_LINKED[[1, 3, 4]] = True
_FUNCTION = np.zeros(CLASSES, bool)
_FUNCTION[64 : CLASSIFY.first_suffix] = True
_WORD = np.zeros(CLASSES, bool)
_WORD[[7, AGAIN]] = True
_WORD[64:] = True


def _read_again(text: str) -> str:
    """UTF-8 that was read as Windows-1252. Bytes that were lost are guessed: they stand for a few letters only."""
    raw = bytearray()
    for at, c in enumerate(text):
        code = ord(c)
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if code < 256:
                raw.append(code)
            elif raw and raw[-1] == 0xD1:  # of the letters with a lost second byte, one is frequent within words, another at their ends
                raw.append(0x81 if text[at + 1 : at + 2] in ("Ñ", "Ð") else 0x8F)
            elif raw and raw[-1] == 0xD0:
                raw.append(0x9D)
    return raw.decode("utf-8", "ignore")


def repaired(text: str) -> str:
    """A text read in the wrong encoding is read again; entities are resolved; invisible marks and tags other than links go."""
    if text.count("Ð") + text.count("Ñ") + text.count("Ã") > len(text) // 15:
        again = _read_again(text)
        if len(again) > len(text) // 4:
            text = again
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = text.translate(_INVISIBLE)
    return _MARKUP.sub(" ", text) if "<" in text else text


def segments(text: str) -> list[list[str]]:
    """Tokens of each segment: a line's sentences, the shortest of them joined, the longest cut into about equal parts."""
    out: list[list[str]] = []
    for line in text.split("\n"):
        held: list[str] = []
        for s in _SENTENCE.split(line):
            held += _TOKEN.findall(s)
            n = len(held)
            if n > LONGEST:
                parts = -(-n // LONGEST)
                out += [held[k * n // parts : (k + 1) * n // parts] for k in range(parts)]
                held = []
            elif n >= SHORTEST:
                out.append(held)
                held = []
        if held:
            out.append(held)
    return out


def _values(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens, tokens of each segment, characters of each segment."""
    found = segments(text)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    flat = [t for s in found for t in s]
    values = np.fromiter(map(CLASSIFY.__getitem__, flat), np.int64, len(flat))
    sizes = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
    chars = np.add.reduceat(sizes, np.cumsum(lengths) - lengths) if len(flat) else sizes
    return values, lengths, chars


def _sequence(text: str | None) -> tuple[bytes, bytes, bytes]:
    text = repaired(text or "")
    values, lengths, chars = _values(text)
    classes = values & (CLASSES - 1)
    words = _WORD[classes]
    if words.sum() and _RAISED[classes].sum() > 0.6 * (words & ~_FUNCTION[classes]).sum():  # all capitals, or each word capitalised
        values, lengths, chars = _values(text.lower())
        classes = values & (CLASSES - 1)
        words = _WORD[classes]
    # a content word that stood among the NEAR content words before it is of the class "again"
    content = np.flatnonzero(words & ~_FUNCTION[classes] | (classes == 3))
    ids = values[content] >> 9
    order = np.argsort(ids, kind="stable")
    near = np.zeros(len(content), bool)
    near[order[1:]] = (ids[order[1:]] == ids[order[:-1]]) & (order[1:] - order[:-1] <= NEAR)
    classes[content[near]] = AGAIN
    return classes.astype(np.uint16).tobytes(), lengths.astype(np.uint16).tobytes(), chars.astype(np.uint32).tobytes()


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, classes, lengths, chars): class sequences of a document, tokens and characters of each segment."""
    for batch in batches:
        rows = [_sequence(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))], names=["doc_id", "classes", "lengths", "chars"])


@dataclass
class _Grams:
    """The tokens of a batch of segments, each with its two predecessors and an end mark of class 0."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    starts: np.ndarray
    n: np.ndarray
    prose: np.ndarray
    document: np.ndarray
    chars: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Grams | None:
        lengths = [np.frombuffer(x, np.uint16) for x in batch.column(2).to_pylist()]
        n = np.concatenate(lengths).astype(np.int64) if lengths else np.empty(0, np.int64)
        if not len(n):
            return None
        flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).astype(np.int64)
        chars = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).astype(np.int64)
        ends = np.cumsum(n)
        starts = ends - n
        c = np.zeros(len(flat) + len(n), np.int64)
        at = np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)
        c[at] = flat
        starts2 = starts + np.arange(len(n))
        b = np.concatenate([[0], c[:-1]])
        b[starts2] = 0
        a = np.concatenate([[0], b[:-1]])
        a[starts2] = 0
        count = lambda mask: np.add.reduceat(mask[flat].astype(np.int64), starts)
        last = flat[ends - 1]
        closing = np.isin(last, [CLASSIFY.marks[m] for m in ".!?…»”\""])
        words = count(_WORD)
        prose = closing & (words >= 6) & (count(_FUNCTION) >= 1) & (count(_LINKED) == 0) & (count(_REPEATED) * 4 <= words)
        return cls(a, b, c, starts2, n + 1, prose, np.repeat(np.arange(batch.num_rows), [len(x) for x in lengths]), chars)

    def slots(self) -> np.ndarray:
        return (mixed(((self.a * CLASSES + self.b) * CLASSES + self.c).view(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class bigrams (keys below CLASSES squared) and hashed trigrams (keys above) of the prose in a task."""
    two, three = np.zeros(CLASSES * CLASSES, np.int64), np.zeros(SLOTS, np.int64)
    for batch in batches:
        if (g := _Grams.of(batch)) is None:
            continue
        use = np.repeat(g.prose, g.n)
        two += np.bincount((g.b * CLASSES + g.c)[use], minlength=CLASSES * CLASSES)
        three += np.bincount(g.slots()[use], minlength=SLOTS)
    both = np.concatenate([two, three])
    at = np.flatnonzero(both)
    for k in range(0, len(at), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000]), pa.array(both[at[k : k + 50_000]])], names=["key", "n"])


class Model:
    """An interpolated trigram model of classes; of fixed size."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        both = np.zeros(CLASSES * CLASSES + SLOTS, np.float32)
        both[keys] = counts
        self.two, self.three = both[: CLASSES * CLASSES].reshape(CLASSES, CLASSES), both[CLASSES * CLASSES :]
        one = self.two.sum(axis=0) + 1
        self.one = one / one.sum()
        self.seen = self.two.sum(axis=1)

    def log_probabilities(self, g: _Grams) -> np.ndarray:
        before = self.two[g.a, g.b]
        # Witten-Bell like weights: a context counts as far as it was seen
        p2 = (self.two[g.b, g.c] + 8 * self.one[g.c]) / (self.seen[g.b] + 8)
        p3 = (self.three[g.slots()] + 8 * p2) / (np.maximum(before, self.three[g.slots()]) + 8)
        return np.log(p3)


def _scores(shared):
    """(doc_id, prose, bucket, chars, score) of each segment; the score is the mean log probability, the log of 1 / perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                if (g := _Grams.of(part)) is None:
                    continue
                score = np.add.reduceat(model.log_probabilities(g), g.starts) / g.n
                bucket = np.minimum(np.log2(g.n) * 2, LENGTHS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(g.document)), pa.array(g.prose), pa.array(bucket), pa.array(g.chars), pa.array(score.astype(np.float64))], names=["doc_id", "prose", "bucket", "chars", "score"]
                )

    return run


def scored_segments(spark: SparkSession, scratch: Scratch, documents: DataFrame) -> DataFrame:
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    sequences = scratch.write(rows.mapInArrow(_sequences, "doc_id bigint, classes binary, lengths binary, chars binary"), "sequences")
    counts = sequences.mapInArrow(_count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    # at most CLASSES squared + SLOTS rows: 1.3 million numbers, at any size of the corpus
    shared = spark.sparkContext.broadcast((counts.column("key").to_numpy(), counts.column("n").to_numpy()))
    return scratch.write(sequences.mapInArrow(_scores(shared), "doc_id bigint, prose boolean, bucket int, chars bigint, score double"), "scores")


def stuffing_scores(spark: SparkSession, documents: DataFrame, above: float = ABOVE, below: float = BELOW) -> DataFrame:
    """(doc_id, chars, stuffed_chars, share): characters of a document in segments that are no prose.

    doc_id is unique; of repeated rows all segments count, which leaves the share as it is. Null
    and blank texts have no row. An empty table gives no rows.
    """
    scratch = Scratch(spark, "stuffing")
    scored = scored_segments(spark, scratch, documents)
    usual = scored.where("prose").groupBy("bucket").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"))
    # one row per length bucket; lengths of which there is no prose are judged like those nearest to them
    held = {r["bucket"]: (r["mean"], max(r["deviation"], 0.05)) for r in usual.collect()}
    if not held:
        return scored.groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.lit(0).cast("bigint").alias("stuffed_chars"), F.lit(0.0).alias("share"))
    limits = {b: held[min(held, key=lambda k: abs(k - b))] for b in range(LENGTHS)}
    low = F.element_at(F.array(*[F.lit(m - above * s) for m, s in limits.values()]), F.col("bucket") + 1)
    high = F.element_at(F.array(*[F.lit(m + below * s) for m, s in limits.values()]), F.col("bucket") + 1)
    odd = (F.col("score") < low) | (F.col("score") > high)
    total = scored.groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.sum(F.when(odd, F.col("chars")).otherwise(0)).alias("stuffed_chars"))
    return total.withColumn("share", F.col("stuffed_chars") / F.col("chars"))


def stuffed_documents(spark: SparkSession, documents: DataFrame, share: float = 0.5) -> DataFrame:
    return stuffing_scores(spark, documents).where(F.col("share") > share).select("doc_id")
