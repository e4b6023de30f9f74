"""Sources and sinks: feeds, page metadata, configuration rows, snapshots and logs."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import col

ENTRY = "external_id string, url string, title string, text string, lang string, published string, media array<struct<kind:string,url:string,width:int,size_bytes:bigint>>"
#: Parts of image addresses that stand for no image of the post.
PLACEHOLDERS = ("default.jpg", "default.png", "placeholder", "no_image", "noimage", "no-image", "blank.")
#: Page metadata that names an image, best first.
OG_KEYS = ("og:image", "og:image:url", "og:image:secure_url", "twitter:image", "twitter:image:src")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _number(x: str | None) -> int | None:
    return int(x) if x and x.isdigit() else None


def _kind(mime: str | None, url: str) -> str:
    if (mime or "").startswith("video") or re.search(r"\.(mp4|webm|mov)(\?|$)", url, re.I):
        return "video"
    return "image"


def _bare(x: str | None) -> str | None:
    """Without markup and entities."""
    return html.unescape(re.sub(r"<[^>]+>", "", x or "")).strip() or None


def parse_feed(raw: bytes | None, default_lang: str | None = None, placeholders: tuple[str, ...] = PLACEHOLDERS) -> list[dict]:
    """Entries of an RSS or Atom feed. Entries without an id, guid or link are skipped; what is no feed gives none.

    Media come from enclosures, media:content and thumbnails; the first of an address counts, and
    placeholders (parts of addresses) are left out. Titles and texts lose their markup. No external entity is ever resolved.
    """
    if not raw or b"<!ENTITY" in raw[:4096]:
        return []
    try:
        root = ET.fromstring(raw)
    except (ET.ParseError, ValueError):
        return []
    lang = next((e.text.strip() for e in root.iter() if _local(e.tag) == "language" and e.text), None) or root.get("{http://www.w3.org/XML/1998/namespace}lang") or default_lang
    out = []
    for entry in (e for e in root.iter() if _local(e.tag) in ("item", "entry")):
        first: dict[str, str] = {}
        media: dict[str, dict] = {}
        for e in entry.iter():
            tag, text = _local(e.tag), (e.text or "").strip()
            link = e.get("href") if tag == "link" and e.get("rel", "alternate") == "alternate" else None
            if text or link:
                first.setdefault(tag, link or text)
            url, mime = e.get("url") or e.get("href"), e.get("type")
            if url and (tag in ("enclosure", "thumbnail") or tag == "content" and "}" in e.tag and e.get("url") or tag == "link" and e.get("rel") == "enclosure"):
                if not any(p in url.lower() for p in placeholders):
                    media.setdefault(url, {"kind": _kind(mime, url), "url": url, "width": _number(e.get("width")), "size_bytes": _number(e.get("length") or e.get("fileSize"))})
        key = first.get("id") or first.get("guid") or first.get("link")
        if key:
            out.append(
                {
                    "external_id": key, "url": first.get("link"), "title": _bare(first.get("title")), "text": _bare(first.get("encoded") or first.get("content") or first.get("summary") or first.get("description")),
                    "lang": lang, "published": first.get("pubdate") or first.get("published") or first.get("updated"), "media": list(media.values()),
                }
            )
    return out


def feeds(raw: DataFrame, source: str = "source_id", data: str = "content", default_lang: str | None = None) -> DataFrame:
    """(source_id, then ENTRY): a row per entry of each feed's bytes. A feed that can't be read gives no rows and stops no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        media = pa.list_(pa.struct([("kind", pa.string()), ("url", pa.string()), ("width", pa.int32()), ("size_bytes", pa.int64())]))
        names = ["external_id", "url", "title", "text", "lang", "published", "media"]
        for batch in batches:
            found = [(s, e) for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for e in parse_feed(b, default_lang)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in found], pa.int64()), *[pa.array([e[n] for _, e in found], media if n == "media" else pa.string()) for n in names]], names=[source, *names]
            )

    return raw.select(F.col(source).cast("bigint").alias(source), data).mapInArrow(run, f"{source} bigint, {ENTRY}")


def published_at(text: str | Column) -> Column:
    """S3: ISO times by built-ins, mail dates by their usual forms; anything else is null."""
    c = col(text)
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss zzz")
    bare = F.regexp_replace(c, "^[A-Za-z]{3}, ", "")
    return F.coalesce(c.try_cast("timestamp"), *[F.try_to_timestamp(bare, F.lit(f)) for f in forms])


def og_image(page: str | Column) -> Column:
    """The image named by a page's metadata, in whatever order its attributes stand; null if there is none."""
    metas = F.regexp_extract_all(F.coalesce(col(page), F.lit("")), F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(0))
    key = lambda m: F.lower(F.regexp_extract(m, r"(?is)\b(?:property|name)\s*=\s*[\"']([^\"']+)[\"']", 1))
    content = lambda m: F.trim(F.regexp_extract(m, r"(?is)\bcontent\s*=\s*[\"']([^\"']+)[\"']", 1))

    def of(name: str) -> Column:
        urls = F.filter(F.transform(_keyed(metas, key, name), content), lambda u: u != "")
        return F.try_element_at(urls, F.lit(1))

    return F.coalesce(*[of(k) for k in OG_KEYS])


def _keyed(metas: Column, key: Callable[[Column], Column], name: str) -> Column:
    return F.filter(metas, lambda m: key(m) == name)


def source_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Configured sources, checked: known kind, origin and tier, a positive poll interval, no kind and handle twice. A bad row raises."""
    kinds, origins, tiers = {"rss", "telegram", "site", "x", "threads"}, {"ua", "world"}, {"official", "media", "aggregator", "leak", "anonymous"}
    seen = set()
    for r in rows:
        for name, words in (("kind", kinds), ("origin", origins), ("tier", tiers)):
            if r.get(name) not in words:
                raise ValueError(f"{r.get('handle_or_url')}: {name} {r.get(name)!r} is not one of {sorted(words)}")
        interval = r.get("poll_interval", 300)
        if isinstance(interval, bool) or not isinstance(interval, int) or interval <= 0:
            raise ValueError(f"{r.get('handle_or_url')}: poll_interval must be a positive whole number")
        key = (r["kind"], str(r.get("handle_or_url", "")).strip().lower())
        if not key[1] or key in seen:
            raise ValueError(f"{key}: missing or repeated handle")
        seen.add(key)
    return spark.createDataFrame(
        [(r["kind"], r["handle_or_url"], r.get("name"), r["origin"], r.get("lang"), r["tier"], r.get("poll_interval", 300)) for r in rows],
        "kind string, handle_or_url string, name string, origin string, lang string, tier string, poll_interval int",
    )


def append_snapshots(df: DataFrame, path: str, at: str = "measured_at") -> None:
    """Appended, by day, so that readers of a few days read a few folders."""
    df.withColumn("day", F.to_date(at)).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def write_log(df: DataFrame, path: str) -> None:
    """Each row as one line of JSON; nulls are left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def read_additive(spark: SparkSession, path: str) -> DataFrame:
    """Files of older and newer schemas together; columns added later are null in older rows."""
    return spark.read.option("mergeSchema", "true").parquet(path)
