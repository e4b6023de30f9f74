"""S5 and S14 over all rows."""

import html
import re

from oracle import connect

from tidewire.plans import queries


def test_strip_html_resolves_entities_of_all_posts(spark, sf, tmp_path):
    fixture = [(1, "<b>A &amp; B</b> &lt;i&gt;"), (2, " &nbsp; "), (3, None), (4, "R&D &copy; &#8217; &unknown; &amp;amp;"), (5, "plain")]
    spark.createDataFrame(fixture, "id bigint, text string").write.parquet(str(tmp_path / "news_items.parquet"))
    rows = connect(sf).sql("SELECT DISTINCT id, text FROM news_items").fetchall()
    bare = lambda x: None if x is None else html.unescape(re.sub("<[^>]+>", "", x)).strip() or None
    for at, posts in ((str(tmp_path), fixture), (sf, rows)):
        assert {r["id"]: r["bare"] for r in queries.QUERIES["s05_strip_html"](spark, at).collect()} == {i: bare(x) for i, x in posts}


def test_new_subscriptions_know_all_sources(spark, tmp_path):
    spark.createDataFrame([("@Odd",), ("even",), ("New",), (" ",), (None,)], "source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "odd"), (2, "@EVEN"), (3, None)], "id bigint, handle_or_url string").write.parquet(str(tmp_path / "sources.parquet"))
    assert [r["handle"] for r in queries.QUERIES["s14_new_subscriptions"](spark, str(tmp_path)).collect()] == ["new"]
