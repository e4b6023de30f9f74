"""Chains longer than any fixed number of doublings."""

from tidewire.operators import relational


def test_chains_are_followed_to_their_ends(spark):
    rows = [(i + 1, i) for i in range(1, 101)] + [(501, 500), (501, 400), (7, 9), (None, 3), (600, None)]
    df = spark.createDataFrame(rows, "event_id bigint, canonical_id bigint")
    got = {tuple(r) for r in relational.resolve_chains(df, "event_id", "canonical_id").collect()}
    assert got == {(i + 1, 1) for i in range(1, 101)} | {(501, 400)}
    assert relational.resolve_chains(df.where("false"), "event_id", "canonical_id").count() == 0
