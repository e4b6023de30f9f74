"""Guarded read-only SQL and fixed-width reports."""

from __future__ import annotations

import json
import re
import threading
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

ROWS, SECONDS, CELL = 50, 5.0, 26
#: Functions that reach files, other systems or the JVM.
FORBIDDEN = ("java_method", "reflect", "try_reflect", "read_files", "input_file_name", "current_user", "session_user")
_STRINGS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.S)


def _relations(plan) -> list[list[str]]:
    """Name parts of the relations that a parsed plan reads, subqueries included, from its JSON form."""
    found: list[list[str]] = []

    def walk(x) -> None:
        if isinstance(x, dict):
            if str(x.get("class", "")).endswith("UnresolvedRelation"):
                parts = x.get("multipartIdentifier") or []
                found.append(parts.strip("[]").split(", ") if isinstance(parts, str) else list(parts))
            for y in x.values():
                walk(y)
        elif isinstance(x, list):
            for y in x:
                walk(y)

    walk(json.loads(plan.toJSON()))
    return found


def is_readonly(spark: SparkSession, sql: str | None) -> bool:
    """One SELECT or WITH statement that reads registered tables only: no second statement, no command, no file, no forbidden function.

    The text is tested without its literals and comments, then its parsed, not yet resolved plan is
    tested for commands, and for relations of more than one name part whose first part is no
    database: those are read as files of a format, in whatever quotes. Null, empty and unparsable text is refused.
    """
    if not sql or not sql.strip():
        return False
    bare = _STRINGS.sub(" ", sql).strip()
    if ";" in bare or not re.match(r"(?is)\(*\s*(select|with)\b", bare) :
        return False
    if any(re.search(rf"(?i)\b{f}\s*\(", bare) for f in FORBIDDEN):
        return False
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:
        return False
    if any(len(parts) > 1 and not spark.catalog.databaseExists(parts[0].strip("`")) for parts in _relations(plan)):
        return False
    return not re.search(r"(?i)\b(insert|create|drop|delete|update|merge|command|overwrite)\w*", plan.nodeName()) and "InsertIntoStatement" not in plan.toString()


def run_readonly(spark: SparkSession, sql: str, rows: int = ROWS, seconds: float = SECONDS) -> tuple[list[Row], bool]:
    """At most `rows` rows, and whether there are more; a query that runs longer than `seconds` is cancelled."""
    if not is_readonly(spark, sql):
        raise ValueError("only a single read-only SELECT or WITH statement is allowed")
    group = f"console-{uuid.uuid4().hex[:8]}"
    spark.sparkContext.setJobGroup(group, "read-only SQL", True)
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup(group))
    timer.start()
    try:
        got = spark.sql(sql).limit(rows + 1).collect()
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got[:rows], len(got) > rows


def as_text(rows: list[Row], cell: int = CELL) -> str:
    """Rows as fixed-width text, cells cut at `cell` characters; no rows give an empty text."""
    if not rows:
        return ""
    table = [list(rows[0].__fields__), *[["" if v is None else str(v).replace("\n", " ") for v in r] for r in rows]]
    table = [[c if len(c) <= cell else c[: cell - 1] + "…" for c in r] for r in table]
    widths = [max(len(r[i]) for r in table) for i in range(len(table[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in table)


def bounded_int(text: str | None, default: int, low: int, high: int) -> int:
    """A whole number within bounds; anything else is the default."""
    try:
        return max(low, min(high, int((text or "").strip())))
    except ValueError:
        return default


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Makes tables known to the console by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
