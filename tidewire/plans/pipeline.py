"""Stages that need an external model or service: everything around the call, with the call as a parameter.

A model is a function from a list of inputs to a list of raw answers, wrapped as an Arrow UDF; it
is asked once per distinct input, and what it can't answer gets the cautious value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import parsers
from tidewire.functions.text import any_match, matched_categories

Model = Callable[[list[str]], list[str | None]]


def asked(model: Model, attempts: int = 2):
    """A column function that asks the model in batches, again for what came back empty, at most `attempts` times; a failing call gives null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            inputs = [x or "" for x in batch]
            answers: list[str | None] = [None] * len(inputs)
            for _ in range(attempts):
                open_ = [i for i, a in enumerate(answers) if a is None]
                if not open_:
                    break
                try:
                    got = model([inputs[i] for i in open_])
                except Exception:  # the service's failure is the row's, not the job's
                    continue
                for i, a in zip(open_, got):
                    answers[i] = a
            yield pd.Series(answers, dtype="object")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType()).asNondeterministic()


def asked_once(df: DataFrame, key: str, model: Model, answer: str = "answer") -> DataFrame:
    """Df with the model's answer on its key; each distinct key is asked once and joined back."""
    distinct = df.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(distinct.withColumn(answer, asked(model)(F.col(key))), key, "left")


def triaged(items: DataFrame, noise: dict[str, str], alert: list[str], no_alert: list[str]) -> DataFrame:
    """T7, first stages: items (id, title, text) with their noise categories, whether they are an alert, and the stage's verdict."""
    blob = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    found = items.withColumn("noise", matched_categories(blob, noise)).withColumn("is_alert", any_match(blob, alert, exclude=no_alert))
    return found.withColumn("verdict", F.when(F.size("noise") > 0, "filtered_out").when(F.col("is_alert"), "alert").otherwise("accepted"))


def classified(items: DataFrame, model: Model) -> DataFrame:
    """Accepted items with rubrics, side, keywords and path; an unreadable answer leaves an event of no rubric, which gets the strictest sourcing."""
    blob = F.concat_ws("\n", "title", "text")
    rows = asked_once(items.where("verdict = 'accepted'").withColumn("blob", blob), "blob", model)
    none = F.array().cast("array<string>")
    return rows.withColumn("c", parsers.classification("answer")).select(
        "id", F.coalesce("c.is_event", F.lit(True)).alias("is_event"), F.coalesce("c.rubrics", none).alias("rubrics"), F.coalesce("c.side", F.lit("unknown")).alias("side"),
        F.coalesce("c.keywords", none).alias("keywords"), F.coalesce("c.topic_path", none).alias("path"),
    )


def judged_pairs(pairs: DataFrame, model: Model | None, unjudged: str = "unresolved") -> DataFrame:
    """Pairs (id, other_id, same_hash, question): equal hashes are duplicates without a question; without a judge, or an answer, the rest is `unjudged`.

    T15, at publishing, gives "separate" where there is no judge and "hold_review" where the judge's answer can't be read.
    """
    auto = pairs.where("same_hash").select("id", "other_id", F.lit("duplicate").alias("decision"), F.lit("auto").alias("mode"))
    rest = pairs.where("not same_hash or same_hash is null")
    if model is None:
        open_ = rest.select("id", "other_id", F.lit(unjudged).alias("decision"), F.lit("unavailable").alias("mode"))
    else:
        answered = asked_once(rest, "question", model).withColumn("t", parsers.twin("answer"))
        open_ = answered.select("id", "other_id", F.coalesce("t.decision", F.lit(unjudged)).alias("decision"), F.when(F.col("t").isNull(), "unavailable").otherwise("llm").alias("mode"))
    return auto.unionByName(open_)


def publish_verdicts(pairs: DataFrame, model: Model | None) -> DataFrame:
    """judged_pairs as at publishing."""
    return judged_pairs(pairs, model, "separate" if model is None else "hold_review")


def drafted(events: DataFrame, model: Model) -> DataFrame:
    """Events (id, prompt) with headline, body and status: a draft that can't be published as it is stays on hold."""
    rows = asked_once(events, "prompt", model).withColumn("d", parsers.draft("answer"))
    fine = F.col("d").isNotNull() & parsers.is_publishable("d.headline", "d.body", F.lit(False))
    return rows.select("id", F.col("d.headline").alias("headline"), F.col("d.body").alias("body"), F.when(F.coalesce(fine, F.lit(False)), "draft").otherwise("hold").alias("status"))
