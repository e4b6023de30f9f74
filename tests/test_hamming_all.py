"""J7 over all rows against brute force."""

from oracle import connect

from tidewire.plans import queries


def test_hamming_pairs_across_sources(spark, sf):
    rows = connect(sf).sql("SELECT DISTINCT id, simhash FROM news_items WHERE id IS NOT NULL AND simhash IS NOT NULL").fetchall()
    rows.sort()
    mask = (1 << 64) - 1
    far = lambda x, y: ((x ^ y) & mask).bit_count()
    want = {(a, b, far(x, y)) for k, (a, x) in enumerate(rows) for b, y in rows[k + 1 :] if far(x, y) <= 6}
    assert {tuple(r) for r in queries.QUERIES["j07_hamming_all"](spark, sf).collect()} == want
    assert any(n > 3 for _, _, n in want)
