"""Case tables: functions over literal rows, with the results they must give, as SQL.

Results that are structures are compared as JSON text without null fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import parsers, scores, text
from tidewire.sources import readers

BOTH: dict = {}


def _quoted(x: object) -> str:
    return "NULL" if x is None else f"'{str(x).replace(chr(39), chr(39) * 2)}'"


def case_table(name: str, schema: str, cases: list[tuple[tuple, object]], result: Callable[[], Column]) -> None:
    """Registers the query `name` over (inputs, wanted result) cases, with columns case_no and result (text)."""

    def run(spark, d):
        rows = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(cases)], f"case_no int, {schema}")
        out = result()
        shown = rows.select("case_no", out.alias("result"))
        kind = shown.schema["result"].dataType.typeName()
        return shown if kind == "string" else shown.select("case_no", (F.to_json("result") if kind in ("struct", "array", "map") else F.col("result").cast("string")).alias("result"))

    run.__doc__ = f"{len(cases)} cases of {name}."
    BOTH[name] = (run, "SELECT CAST(no AS INT) AS case_no, result FROM (VALUES " + ", ".join(f"({i}, {_quoted(want)})" for i, (_, want) in enumerate(cases)) + ") AS t(no, result)")


_PLAIN = '{"is_event":false,"rubrics":[],"side":"unknown","is_first_source":false,"is_rumor":false,"keywords":[],"topic_path":[]}'
case_table(
    "parse_p1_classification", "raw string",
    [
        (('{"is_event": true, "rubrics": [" War ", ""], "side": "UA", "is_first_source": true, "keywords": ["a", " ", "b"], "topic_path": ["X", " y "]}',), '{"is_event":true,"rubrics":["war"],"side":"ua","is_first_source":true,"is_rumor":false,"keywords":["a","b"],"topic_path":["x","y"]}'),
        (('{"side": "moon", "topic_path": ["1","2","3","4","5","6"]}',), _PLAIN.replace('"topic_path":[]', '"topic_path":["1","2","3","4","5"]')),
        (("{}",), _PLAIN), (("no json",), None), (("",), None), ((None,), None), (("[1]",), None), (("3",), None),
    ],
    lambda: parsers.classification("raw"),
)
case_table(
    "parse_p2_facts", "raw string",
    [
        (('{"facts": [{"text": " five hurt ", "kind": "Number", "number": 5, "unit": "people"}, {"text": ""}]}',), '[{"text":"five hurt","kind":"number","number":5.0,"unit":"people"}]'),
        (('["one", {"text": "two", "number": "3.5"}, {"text": "three", "number": true}, ""]',), '[{"text":"one","kind":"fact"},{"text":"two","kind":"fact","number":3.5},{"text":"three","kind":"fact"}]'),
        (('{"facts": "x"}',), None), (("{}",), None), (("oops",), None), (("[]",), "[]"), ((None,), None),
    ],
    lambda: parsers.facts("raw"),
)
case_table(
    "parse_p3_claims", "raw string",
    [
        (('{"claims": [{"text": "a", "claim_type": " Who "}, {"claim_type": "x"}, "b"]}',), '[{"text":"a","claim_type":"who"},{"text":"b","claim_type":""}]'),
        (("[" + ",".join(f'"c{i}"' for i in range(14)) + "]",), "[" + ",".join(f'{{"text":"c{i}","claim_type":""}}' for i in range(14)) + "]"),
        (('{"claims": 3}',), None), (("x",), None), (("[]",), "[]"),
    ],
    lambda: parsers.claims("raw"),
)
case_table(
    "parse_p4_verdict", "raw string, evidence int",
    [
        (('{"verdict": "TRUE", "confidence": 0.8, "explanation": " e ", "stances": ["supports", "odd"]}', 3), '{"verdict":"true","confidence":0.8,"explanation":"e","stances":["supports","neutral","neutral"]}'),
        (('{"verdict": "probably", "confidence": 7, "stances": ["refutes", "refutes"]}', 1), '{"verdict":"unverifiable","confidence":1.0,"explanation":"","stances":["refutes"]}'),
        (('{"verdict": "misleading", "confidence": "x", "stances": ["refutes"]}', 0), '{"verdict":"misleading","confidence":0.0,"explanation":"","stances":["refutes"]}'),
        (("{}", 2), '{"verdict":"unverifiable","confidence":0.0,"explanation":"","stances":["neutral","neutral"]}'), (("[]", 1), None), (("", 1), None),
    ],
    lambda: parsers.verdict("raw", "evidence"),
)
case_table(
    "parse_p5_update", "raw string",
    [
        (('{"update_type": "Consequence", "significant": true, "summary": " s ", "position_changed": false}',), '{"update_type":"consequence","significant":true,"summary":"s","position_changed":false}'),
        (('{"update_type": "new"}',), '{"update_type":"minor","significant":false,"summary":"","position_changed":false}'),
        (('{"update_type": "confirmation", "position_changed": true}',), '{"update_type":"confirmation","significant":false,"summary":"","position_changed":true}'), (("[1]",), None), (("?",), None),
    ],
    lambda: parsers.update("raw"),
)
case_table(
    "parse_p6_ranking", "raw string, ids array<bigint>",
    [
        (('{"decisions": [{"id": 1, "decision": "Publish"}, {"id": "2", "decision": "digest"}, {"id": 9, "decision": "publish"}]}', [1, 2, 3]), '{"1":"publish","2":"hold","3":"hold"}'),
        (('[{"id": 2, "decision": "publish"}, {"id": 2, "decision": "hold"}, {"id": 3, "decision": "publish"}, 4]', [2, 3]), '{"2":"hold","3":"publish"}'),
        (("not json", [1, 2]), '{"1":"hold","2":"hold"}'), ((None, [5]), '{"5":"hold"}'), (('{"decisions": {"1": "publish"}}', [1]), '{"1":"hold"}'),
    ],
    lambda: parsers.ranking("raw", "ids"),
)
case_table(
    "parse_p7_groups", "raw string, ids array<bigint>",
    [
        (('{"groups": [[3, 1, 1, 9], [2]]}', [1, 2, 3]), "[[3,1]]"), (('[[1, "2"], [3, 4], "x", ["a", 3, 1]]', [1, 2, 3]), "[[1,2],[3,1]]"),
        (('{"groups": 3}', [1]), "[]"), (("bad", [1, 2]), "[]"), ((None, [1, 2]), "[]"), (("{}", [1]), "[]"),
    ],
    lambda: parsers.groups("raw", "ids"),
)
case_table(
    "parse_p8_twin", "raw string",
    [
        (('{"decision": " Duplicate", "confidence": 0.9, "reason": " same "}',), '{"decision":"duplicate","confidence":0.9,"reason":"same"}'),
        (('{"decision": "hold"}',), None), (('{"decision": "maybe"}',), None), (('{"decision": "update", "confidence": "x"}',), '{"decision":"update","confidence":0.0,"reason":""}'),
        (('{"decision": "separate", "reason": "' + "r" * 400 + '"}',), '{"decision":"separate","confidence":0.0,"reason":"' + "r" * 300 + '"}'), (("[]",), None),
    ],
    lambda: parsers.twin("raw"),
)
case_table(
    "parse_p9_draft", "raw string",
    [
        (('{"headline": " H ", "body": "text of it", "watching": "w", "rubrics": ["War", ""]}',), '{"headline":"H","body":"text of it","watching":"w","rubrics":["war"]}'),
        (('{"headline": "A", "lead": "older name"}',), '{"headline":"A","body":"older name","watching":"","rubrics":[]}'),
        (('{"headline": "Same", "body": " same "}',), None), (('{"headline": "", "body": "b"}',), None), (('{"headline": "h"}',), None), (("x",), None),
    ],
    lambda: parsers.draft("raw"),
)
case_table(
    "parse_p10_image", "raw string",
    [
        (('{"blocked": false, "labels": [" Ok ", ""], "reason": " r "}',), '{"blocked":false,"labels":["ok"],"reason":"r"}'), (("{}",), '{"blocked":true,"labels":[],"reason":""}'),
        (('{"blocked": true}',), '{"blocked":true,"labels":[],"reason":""}'), (("[]",), None), (("",), None),
    ],
    lambda: parsers.image_verdict("raw"),
)
case_table(
    "parse_p11_hits", "hits array<struct<url:string,stance:string,score:double>>",
    [
        (([("a", None, None), ("b", "supports", 0.1), ("c", None, 0.9), ("", None, 1.0), ("d", None, 0.5)],), '[{"stance":"refutes","external_ref":"c","score":0.9},{"stance":"refutes","external_ref":"d","score":0.5},{"stance":"supports","external_ref":"b","score":0.1}]'),
        (([("a", None, None), ("b", None, -1.0)],), '[{"stance":"refutes","external_ref":"a"}]'), (([],), "[]"),
    ],
    lambda: parsers.evidence_hits("hits"),
)
case_table(
    "parse_p12_command", "raw string",
    [
        (("/Top@bot  5 ",), '{"name":"top","args":"5"}'), (("/sql select 1",), '{"name":"sql","args":"select 1"}'), (("/stats",), '{"name":"stats","args":""}'), (("hello",), None), (("/",), None), (("/@bot x",), None), ((None,), None),
    ],
    lambda: parsers.command("raw"),
)
case_table(
    "parse_p12_callback", "raw string",
    [
        (("retract:12",), '{"kind":"retract","publication_id":12}'), (("review_drop: 3",), '{"kind":"review_drop","publication_id":3}'), ((" stop ",), '{"kind":"stop"}'), (("resume",), '{"kind":"resume"}'),
        (("retract:x",), '{"kind":"unknown"}'), (("other:1",), '{"kind":"unknown"}'), ((None,), '{"kind":"unknown"}'), (("retract",), '{"kind":"unknown"}'),
    ],
    lambda: parsers.callback("raw"),
)

_GATE = {"confirmed": "official or first-hand source", "rumor": "labelled as a rumor"}


def _gate(status: str, reason: str | None = None) -> str:
    return f'{{"status":"{status}","publishable":{"false" if status == "signal" else "true"},"reason":"{reason or _GATE[status]}"}}'


case_table(
    "x11_gate", "level string, n int, official boolean, first boolean, trusted boolean, rumor boolean",
    [
        (("critical", 0, True, False, False, True), _gate("rumor")), (("low", 0, False, False, False, True), _gate("rumor")), (("critical", 1, True, False, False, False), _gate("confirmed")),
        (("high", 0, False, True, False, None), _gate("confirmed")), (("high", 2, False, False, False, False), _gate("reported", "independent sources")), (("critical", 1, False, False, True, False), _gate("signal", "needs a second or first-hand source")),
        (("low", 5, False, False, False, False), _gate("signal", "needs a trusted source")), (("low", 1, False, False, True, False), _gate("reported", "trusted source")), (("low", None, False, True, None, False), _gate("confirmed")),
    ],
    lambda: scores.gate_decision("level", "n", "official", "first", "trusted", "rumor"),
)
case_table(
    "x13_route_update", "kind string, significant boolean",
    [(("new_fact", False), "post"), (("refutation", None), "post"), (("consequence", True), "post"), (("consequence", False), "summary_update"), (("reaction", True), "summary_update"), (("minor", True), "summary_update"), ((None, True), "summary_update")],
    lambda: parsers.route_update("kind", "significant"),
)
case_table(
    "f19_publishable", "headline string, body string, fallback boolean",
    [(("H", "a body long enough", False), "true"), (("H", "short", False), "false"), (("A body long enough", " a body LONG enough ", False), "false"), (("H", "a body long enough", True), "false"), (("H", None, None), "false"), ((None, "a body long enough", None), "true")],
    lambda: parsers.is_publishable("headline", "body", "fallback"),
)
case_table("x14_band", "x double", [((None,), "—"), ((0.0,), "—"), ((0.1,), "low"), ((0.33,), "medium"), ((0.65,), "medium"), ((0.66,), "high"), ((1.0,), "high")], lambda: scores.band_label("x"))
case_table(
    "x30_split_cases", "t string",
    [
        (("ab cdefghijklmnop",), '["ab","cdefghij","klmnop"]'), (("  abc  ",), '["abc"]'), (("",), "[]"), ((None,), "[]"), (("abc def ghi",), '["abc def","ghi"]'), (("abcde\n\nfg hi",), '["abcde","fg hi"]'), (("abcdefghijkl",), '["abcdefgh","ijkl"]'),
    ],
    lambda: F.pandas_udf(lambda s: s.map(lambda x: text.split_text(x, 8)), "array<string>")("t"),
)
_META = '<meta property="og:image:secure_url" content="https://s"/><META content=" https://o " name=\'og:image\'>'
case_table(
    "s16_og_image", "page string",
    [((_META,), "https://o"), (('<meta name="twitter:image" content="t"><meta content="u" property="og:image:url">',), "u"), (('<meta property="og:title" content="x">',), None), ((None,), None), (('<meta property="og:image" content=" "><meta property="og:image" content="second">',), "second")],
    lambda: readers.og_image("page"),
)
case_table(
    "x18_image_mime", "data binary",
    [((bytearray(b"\x89PNG\r\n\x1a\n12"),), "image/png"), ((bytearray(b"\xff\xd8\xff\xe0aaaa"),), "image/jpeg"), ((bytearray(b"GIF89a......"),), "image/gif"), ((bytearray(b"RIFF0000WEBPVP8 "),), "image/webp")],
    lambda: text.image_mime("data"),
)
