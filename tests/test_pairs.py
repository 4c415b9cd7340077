from collections import Counter

from lorebase.operators import pairs


def test_byte_pairs_against_a_loop(spark, monkeypatch):
    texts = [None, "", "a", "ab", "abab", "Zürich \u20ac", "aaaa", "ab", "x" * 1000, "\x00\x00"]
    want = Counter()
    for t in texts:
        b = (t or "").encode()
        want.update(f"{x:02X}{y:02X}" for x, y in zip(b, b[1:]))
    d = spark.createDataFrame([(t, 1) for t in texts], "text string, place int")
    for chunk in (pairs.CHUNK, 1, 3):
        monkeypatch.setattr(pairs, "CHUNK", chunk)
        got = pairs.byte_pairs(d, "text").collect()
        assert len(got) == len(want) and {r["pair"]: r["n"] for r in got} == want
    assert pairs.byte_pairs(d.limit(0), "text").collect() == []
