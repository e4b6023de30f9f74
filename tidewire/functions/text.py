"""Text normalisation, identity hashes, predicates and renderers, as column expressions.

uregex() is the only way to a pattern: Java folds case and knows word characters by Unicode only
under (?U). Null inputs give what each function states; no function raises on any text.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
TOKEN = r"[0-9a-zA-Zа-яА-ЯіІїЇєЄґҐ']+"
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def uregex(pattern: str, ignorecase: bool = False) -> str:
    return "(?U)" + ("(?i)" if ignorecase else "") + pattern


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_text(x: str | Column) -> Column:
    """White space to single blanks, trimmed, lower-cased; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), _SPACE, " ")))


def content_hash(title: str | Column, text: str | Column) -> Column:
    """Sha-256 of normalised title, line feed, normalised text."""
    return F.sha2(F.concat(normalize_text(title), F.lit("\n"), normalize_text(text)), 256)


def tokens(x: str | Column) -> Column:
    """Tokens of the lower-cased text; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit(TOKEN), F.lit(0))


def hamming(a: str | Column, b: str | Column) -> Column:
    """Differing bits of two 64-bit numbers; null if either is."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def _simhash(title: str | None, text: str | None) -> int:
    found = re.findall(TOKEN, f"{title or ''} {text or ''}".lower())
    if not found:
        return 0
    raw = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=8).digest() for t in found), ">u8")
    bits = (raw[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    positive = bits.sum(axis=0).astype(np.int64) * 2 > len(found)
    return int((positive.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def _simhashes(title: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([_simhash(a, b) for a, b in zip(title, text)], dtype="int64")


def simhash(title: str | Column, text: str | Column) -> Column:
    """64-bit similarity hash, each token's blake2b counted as often as it occurs; without tokens 0."""
    return F.pandas_udf(_simhashes, T.LongType())(col(title), col(text))


def strip(x: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def md5_simhash(words: str | Column) -> Column:
    """X3 with built-ins only: 60 bits from the first 15 hex digits of each token's md5; an empty or null list gives 0."""
    hashes = F.transform(F.coalesce(col(words), F.array().cast("array<string>")), lambda w: F.conv(F.substring(F.md5(w), 1, 15), 16, 10).cast("bigint"))
    def votes(i: int) -> Column:
        return F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.when(F.getbit(h, F.lit(i)) == 1, 1).otherwise(-1))

    set_ = [votes(i) for i in range(60)]
    total = F.lit(0).cast("bigint")
    for i, s in enumerate(set_):
        total = total + F.when(s > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    return total


def _unescape(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else html.unescape(s))


def unescape(x: Column) -> Column:
    return F.pandas_udf(_unescape, T.StringType())(x)


def strip_html(x: str | Column, entities: bool = True) -> Column:
    """Tags dropped, entities resolved, trimmed; empty is null."""
    bare = F.regexp_replace(col(x), r"<[^>]+>", "")
    return F.nullif(strip(unescape(bare) if entities else bare), F.lit(""))


def first_nonempty(*parts: str | Column) -> Column:
    """The first part that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(p), F.lit("")) for p in parts])


def is_recent(published: str | Column, as_of: Column, max_age_hours: float) -> Column:
    """An unknown date is kept, a limit of 0 or less is none, the boundary counts."""
    if max_age_hours <= 0:
        return F.lit(True)
    p = col(published)
    return p.isNull() | (p >= as_of - F.expr(f"make_dt_interval(0, 0, 0, {max_age_hours * 3600})"))


def matched_categories(x: str | Column, patterns: dict[str, str]) -> Column:
    """sorted names of the categories whose pattern the text matches; null matches none."""
    t = F.coalesce(col(x), F.lit(""))
    hits = [F.when(t.rlike(uregex(p)), F.lit(name)) for name, p in sorted(patterns.items())]
    return F.array_sort(F.array_compact(F.array(*hits))) if hits else F.array().cast("array<string>")


def any_match(x: str | Column, patterns: list[str], ignorecase: bool = False, exclude: list[str] | None = None) -> Column:
    """Some pattern matches and no excluded one does; without patterns false."""
    if not patterns:
        return F.lit(False)
    t = F.coalesce(col(x), F.lit(""))
    one = lambda ps: t.rlike(uregex("(?:" + "|".join(f"(?:{p})" for p in ps) + ")", ignorecase))
    return one(patterns) & ~one(exclude) if exclude else one(patterns)


def found_spans(x: str | Column, patterns: dict[str, str]) -> Column:
    """all matches of all patterns, as an array of (category, span)."""
    t = F.coalesce(col(x), F.lit(""))

    def of(name: str, p: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(uregex(f"({p})")), F.lit(0)), lambda s: F.struct(F.lit(name).alias("category"), s.alias("span")))

    return F.flatten(F.array(*[of(name, p) for name, p in sorted(patterns.items())]))


#: F5, from worst to least.
ACTIONS = ("block", "needs_official", "review")


def stoplist_hits(x: str | Column, side: str | Column, rules: list[tuple[str, str, str, str]]) -> Column:
    """(name, action) of the rules (name, pattern, scope, action) that match within their scope: all, ua_side (ua or unknown) or ru_side."""
    t, s = F.coalesce(col(x), F.lit("")), F.coalesce(col(side), F.lit("unknown"))
    scopes = {"all": F.lit(True), "ua_side": s.isin("ua", "unknown"), "ru_side": s == "ru"}
    return F.array_compact(F.array(*[F.when(scopes[scope] & t.rlike(uregex(p)), F.struct(F.lit(n).alias("name"), F.lit(a).alias("action"))) for n, p, scope, a in rules]))


def worst_action(hits: str | Column) -> Column:
    """the worst action among the hits; null if there is none."""
    named = F.transform(col(hits), lambda x: x["action"])
    return F.coalesce(*[F.when(F.array_contains(named, a), F.lit(a)) for a in ACTIONS])


def slugify(x: str | Column, default: str = "story", limit: int = 80) -> Column:
    """Lower-cased letters and digits of both scripts, all else a hyphen; empty gives the default."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(col(x), F.lit("")))), "[^0-9a-zа-яіїєґ]+", "-")
    s = F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(limit))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def normalize_path(x: str | Column, limit: int = 5) -> Column:
    """The first labels, white space made one blank, lower-cased, empty ones dropped; null is empty."""
    return F.filter(F.transform(F.slice(F.coalesce(col(x), F.array().cast("array<string>")), 1, limit), normalize_text), lambda s: s != "")


def clip_for_embedding(x: str | Column, limit: int = 8000) -> Column:
    """Trimmed and cut, never empty."""
    return F.coalesce(F.nullif(F.left(strip(F.coalesce(col(x), F.lit(""))), F.lit(limit)), F.lit("")), F.lit(" "))


def key_of(x: str | Column) -> Column:
    """Trimmed and lower-cased; empty is null."""
    return F.nullif(F.lower(F.trim(col(x))), F.lit(""))


def media_key(item: str | Column, media: str | Column, url: str | Column) -> Column:
    """Sha-256 of item, media and url, under two leading hex digits."""
    h = F.sha2(F.concat_ws(":", col(item).cast("string"), col(media).cast("string"), F.coalesce(col(url), F.lit(""))), 256)
    return F.concat(F.substring(h, 1, 2), F.lit("/"), h)


def image_mime(data: str | Column) -> Column:
    """By magic bytes; what is unknown or null counts as jpeg."""
    h = F.hex(F.substring(col(data), 1, 12))
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "image/png")
        .when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif")
        .when(h.startswith("52494646") & h.endswith("57454250"), "image/webp")
        .otherwise("image/jpeg")
    )


def escape_html(x: str | Column) -> Column:
    """The ampersand first, then angle brackets."""
    return F.replace(F.replace(F.replace(col(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def fill_prompt(template: str | Column, values: dict[str, str | Column]) -> Column:
    """{name} replaced by its value; other braces stay."""
    out = col(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col(v).cast("string"), F.lit("")))
    return out


def split_text(text: str | None, limit: int = 4096) -> list[str]:
    """Trimmed pieces of at most limit characters.

    A piece ends at the last blank line or line feed of its second half, else at the last blank
    anywhere in it; only a run without any is cut hard.
    """
    rest, out = (text or "").strip(), []
    while len(rest) > limit:
        late = (at for mark in ("\n\n", "\n") if (at := rest.rfind(mark, 0, limit)) >= limit // 2)
        cut = next(late, None) or rest.rfind(" ", 0, limit)
        piece, rest = (rest[:cut], rest[cut:]) if cut > 0 else (rest[:limit], rest[limit:])
        out.append(piece.strip())
        rest = rest.strip()
    return [piece for piece in (*out, rest) if piece]


def _chunked(x: pd.Series) -> pd.Series:
    return x.map(lambda s: [] if s is None else split_text(s))


def chunked(x: str | Column) -> Column:
    return F.pandas_udf(_chunked, T.ArrayType(T.StringType()))(col(x))


def phash_pixels(pixels: np.ndarray) -> str:
    """32 x 32 grey values to 16 hex digits: which of the low 8 x 8 cosine terms exceed their median."""
    n = 32
    k, i = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    basis = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))
    low = (basis @ np.asarray(pixels, float).reshape(n, n) @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def _phash(pixels: pd.Series) -> pd.Series:
    return pixels.map(lambda p: phash_pixels(np.asarray(p)) if p is not None and len(p) == 1024 else None)


def phash(pixels: str | Column) -> Column:
    """X15 over arrays of 1024 grey values; anything else gives null."""
    return F.pandas_udf(_phash, T.StringType())(col(pixels))


def phash_number(x: str | Column) -> Column:
    """Hex digits to a signed number; anything else is null."""
    return F.when(col(x).rlike("^[0-9a-fA-F]{1,16}$"), F.conv(col(x), 16, -10).cast("bigint"))
