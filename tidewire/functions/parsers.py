"""Structured answers of external models, parsed with built-ins.

Invalid JSON, or JSON of another shape, gives null, so that the caller asks again (a ranking holds
everything, groups are empty); unknown vocabulary falls back to the cautious value; nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import col, strip

# The vocabularies of the answers.
SIDES = ("ua", "ru", "unknown")
VERDICTS = ("true", "false", "misleading", "unverifiable")
STANCES = ("supports", "refutes", "neutral")
UPDATES = ("new_fact", "confirmation", "refutation", "reaction", "consequence", "minor")
ALWAYS_POSTED = ("new_fact", "refutation")
SUMMARY_ONLY = ("confirmation", "reaction", "minor")
TWINS = ("duplicate", "update", "separate")
CALLBACKS = ("retract", "review_publish", "review_drop")


def _within(x: Column, words: tuple[str, ...], default: str | None) -> Column:
    v = F.lower(strip(F.coalesce(x, F.lit(""))))
    return F.when(v.isin(*words), v).otherwise(F.lit(default))


def _kind(raw: str | Column) -> Column:
    """"object", "array", another kind of JSON, or null where it is none."""
    c = strip(col(raw))
    start = F.left(c, F.lit(1))
    return F.when(F.try_parse_json(c).isNotNull(), F.when(start == "{", "object").when(start == "[", "array").otherwise("value"))


def _text(x: Column) -> Column:
    return strip(F.coalesce(x, F.lit("")))


def _texts(x: Column, lower: bool = False) -> Column:
    """The non-empty trimmed texts of an array; null is empty."""
    each = lambda t: F.lower(strip(t)) if lower else strip(t)
    return F.filter(F.transform(F.array_compact(F.coalesce(x, F.array().cast("array<string>"))), each), lambda t: t != "")


def _truth(x: Column) -> Column:
    """What counts as true of a JSON value read as text."""
    return F.coalesce(~F.lower(strip(x)).isin("", "false", "0", "0.0", "null", "[]", "{}"), F.lit(False))


def _number(x: Column) -> Column:
    return F.when(~F.lower(strip(x)).isin("true", "false"), strip(x).try_cast("double"))


def _objects(raw: str | Column, name: str) -> Column:
    """The items of {name: [...]} or of a bare list, each as text; null for anything else."""
    c, kind = strip(col(raw)), _kind(raw)
    listed = F.when(kind == "object", F.get_json_object(c, f"$.{name}")).when(kind == "array", c)
    return F.when(F.left(strip(listed), F.lit(1)) == "[", F.from_json(listed, "array<string>"))


def classification(raw: str | Column) -> Column:
    """Rubrics and topic_path (lower-cased, at most 5 labels), side, at most 10 keywords, and the flags is_event, is_first_source, is_rumor."""
    s = F.from_json(col(raw), "is_event string, rubrics array<string>, side string, is_first_source string, is_rumor string, keywords array<string>, topic_path array<string>")
    return F.when(
        _kind(raw) == "object",
        F.struct(
            _truth(s["is_event"]).alias("is_event"), _texts(s["rubrics"], lower=True).alias("rubrics"), _within(s["side"], SIDES, "unknown").alias("side"),
            _truth(s["is_first_source"]).alias("is_first_source"), _truth(s["is_rumor"]).alias("is_rumor"),
            F.slice(_texts(s["keywords"]), 1, 10).alias("keywords"), F.slice(_texts(s["topic_path"], lower=True), 1, 5).alias("topic_path"),
        ),
    )


def facts(raw: str | Column) -> Column:
    """Facts (text, kind, number, unit) of {"facts": [...]} or a bare list; texts may stand alone; a number that is none is null."""
    field = lambda x, name: F.when(x.startswith("{"), F.get_json_object(x, f"$.{name}"))
    made = F.transform(
        F.array_compact(_objects(raw, "facts")),
        lambda x: F.struct(
            strip(F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x)).alias("text"), F.coalesce(F.nullif(F.lower(_text(field(x, "kind"))), F.lit("")), F.lit("fact")).alias("kind"),
            _number(field(x, "number")).alias("number"), F.nullif(_text(field(x, "unit")), F.lit("")).alias("unit"),
        ),
    )
    return F.filter(made, lambda f: f["text"].isNotNull() & (f["text"] != ""))


def claims(raw: str | Column) -> Column:
    """Claims (text, claim_type) of {"claims": [...]} or a bare list; texts may stand alone."""
    made = F.transform(
        F.array_compact(_objects(raw, "claims")),
        lambda x: F.struct(
            strip(F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x)).alias("text"),
            F.lower(_text(F.when(x.startswith("{"), F.get_json_object(x, "$.claim_type")))).alias("claim_type"),
        ),
    )
    return F.filter(made, lambda f: f["text"].isNotNull() & (f["text"] != ""))


def verdict(raw: str | Column, evidence: str | Column) -> Column:
    """Verdict (unverifiable outside its vocabulary), confidence within 0..1, explanation, and one stance per piece of evidence, padded with neutral; all stances where evidence is 0."""
    s = F.from_json(col(raw), "verdict string, confidence string, explanation string, stances array<string>")
    n = F.coalesce(col(evidence).cast("int"), F.lit(0))
    given = F.transform(F.coalesce(s["stances"], F.array().cast("array<string>")), lambda x: _within(x, STANCES, "neutral"))
    padded = F.when(n > 0, F.slice(F.concat(given, F.array_repeat(F.lit("neutral"), n)), F.lit(1), F.greatest(n, F.lit(1)))).otherwise(given)
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(_number(s["confidence"]), F.lit(0.0))))
    return F.when(
        _kind(raw) == "object",
        F.struct(_within(s["verdict"], VERDICTS, "unverifiable").alias("verdict"), confidence.alias("confidence"), _text(s["explanation"]).alias("explanation"), padded.alias("stances")),
    )


def update(raw: str | Column) -> Column:
    """P5: (update_type, significant, summary, position_changed); an unknown type is minor."""
    s = F.from_json(col(raw), "update_type string, significant string, summary string, position_changed string")
    return F.when(
        _kind(raw) == "object",
        F.struct(
            _within(s["update_type"], UPDATES, "minor").alias("update_type"), _truth(s["significant"]).alias("significant"), _text(s["summary"]).alias("summary"), _truth(s["position_changed"]).alias("position_changed")
        ),
    )


def route_update(update_type: str | Column, significant: str | Column) -> Column:
    """New facts and refutations are posted, consequences if significant; the rest only updates the summary."""
    t = col(update_type)
    posted = t.isin(*ALWAYS_POSTED) | ((t == "consequence") & F.coalesce(col(significant), F.lit(False)))
    return F.when(posted, "post").otherwise("summary_update")


def ranking(raw: str | Column, ids: str | Column) -> Column:
    """A map from each known id to publish or hold, from {"decisions": [{id, decision}]} or a bare list; the last decision of an id counts; all else holds."""
    field = lambda x, name: F.get_json_object(x, f"$.{name}")
    rows = F.filter(F.coalesce(_objects(raw, "decisions"), F.array().cast("array<string>")), lambda x: x.startswith("{"))
    named = F.transform(rows, lambda x: F.struct(strip(field(x, "id")).try_cast("bigint").alias("id"), _within(field(x, "decision"), ("publish", "hold"), None).alias("d")))
    known = F.filter(named, lambda x: x["id"].isNotNull() & x["d"].isNotNull())
    return F.map_from_arrays(
        col(ids), F.transform(col(ids), lambda i: F.coalesce(F.try_element_at(F.transform(F.filter(known, lambda x: x["id"] == i), lambda x: x["d"]), F.lit(-1)), F.lit("hold")))
    )


def groups(raw: str | Column, ids: str | Column) -> Column:
    """Groups of known, distinct ids, of two at least, in the order given, from {"groups": [...]} or a bare list; none if unreadable."""
    lists = F.filter(F.coalesce(_objects(raw, "groups"), F.array().cast("array<string>")), lambda g: F.coalesce(g.startswith("["), F.lit(False)))
    numbers = F.transform(lists, lambda g: F.transform(F.from_json(g, "array<string>"), lambda x: strip(x).try_cast("bigint")))
    known = F.transform(numbers, lambda g: F.array_distinct(F.filter(g, lambda x: F.array_contains(col(ids), x))))
    return F.filter(known, lambda g: F.size(g) >= 2)


def twin(raw: str | Column) -> Column:
    """(decision, confidence, reason): an unknown decision is null, which isn't "separate"; reasons are cut at 300 characters."""
    s = F.from_json(col(raw), "decision string, confidence string, reason string")
    d = _within(s["decision"], TWINS, None)
    return F.when(
        (_kind(raw) == "object") & d.isNotNull(),
        F.struct(d.alias("decision"), F.coalesce(_number(s["confidence"]), F.lit(0.0)).alias("confidence"), F.left(_text(s["reason"]), F.lit(300)).alias("reason")),
    )


def draft(raw: str | Column) -> Column:
    """(headline, body, watching, rubrics): `lead` is the old name of body; null without either, or where the body repeats the headline."""
    s = F.from_json(col(raw), "headline string, body string, lead string, watching string, rubrics array<string>")
    head, body = _text(s["headline"]), _text(F.coalesce(F.nullif(s["body"], F.lit("")), s["lead"]))
    return F.when(
        (_kind(raw) == "object") & (head != "") & (body != "") & (F.lower(head) != F.lower(body)),
        F.struct(head.alias("headline"), body.alias("body"), _text(s["watching"]).alias("watching"), _texts(s["rubrics"], lower=True).alias("rubrics")),
    )


def is_publishable(headline: str | Column, body: str | Column, fallback: str | Column, least: int = 12) -> Column:
    """real content: no fallback, a body of at least `least` characters that isn't the headline again."""
    b = _text(col(body))
    return ~F.coalesce(col(fallback), F.lit(False)) & (F.length(b) >= least) & (F.lower(b) != F.lower(_text(col(headline))))


def image_verdict(raw: str | Column) -> Column:
    """P10: (blocked, labels, reason): what doesn't say blocked is blocked."""
    s = F.from_json(col(raw), "blocked string, labels array<string>, reason string")
    return F.when(_kind(raw) == "object", F.struct(F.when(s["blocked"].isNull(), True).otherwise(_truth(s["blocked"])).alias("blocked"), _texts(s["labels"], lower=True).alias("labels"), _text(s["reason"]).alias("reason")))


def evidence_hits(hits: str | Column, floor: float = 0.0, most: int = 3) -> Column:
    """Of hits array<struct<url, stance, score>> the evidence (stance, external_ref, score): scored hits first and best first, others in their order; the floor applies to scored hits only."""
    usable = F.filter(col(hits), lambda x: F.coalesce(x["url"] != "", F.lit(False)) & (x["score"].isNull() | (x["score"] >= floor)))
    placed = F.transform(usable, lambda x, i: F.struct(x["score"].isNull().alias("bare"), (-F.coalesce(x["score"], F.lit(0.0))).alias("minus"), i.alias("at"), x.alias("hit")))
    ranked = F.transform(F.array_sort(placed), lambda x: x["hit"])
    return F.slice(F.transform(ranked, lambda x: F.struct(F.coalesce(F.nullif(x["stance"], F.lit("")), F.lit("refutes")).alias("stance"), x["url"].alias("external_ref"), x["score"].alias("score"))), 1, most)


def command(raw: str | Column) -> Column:
    """(name, args) of "/name@bot args"; anything else is null."""
    c = strip(col(raw))
    head = F.substring_index(c, " ", 1)
    name = F.lower(strip(F.substring_index(F.substr(head, F.lit(2)), "@", 1)))
    return F.when(c.startswith("/") & (name != ""), F.struct(name.alias("name"), strip(F.substr(c, F.length(head) + 1)).alias("args")))


def callback(raw: str | Column) -> Column:
    """(kind, publication_id) of a button's data: stop, resume, or one of CALLBACKS with a number; all else is unknown."""
    c = _text(col(raw))
    prefix, rest = F.substring_index(c, ":", 1), F.regexp_extract(c, r"^[a-z_]+:(.*)$", 1)
    number = F.when(c.contains(":") & prefix.isin(*CALLBACKS) & rest.rlike(r"^\s*[+-]?\d+\s*$"), strip(rest).try_cast("bigint"))
    return F.struct(F.when(c.isin("stop", "resume"), c).when(number.isNotNull(), prefix).otherwise("unknown").alias("kind"), number.alias("publication_id"))
