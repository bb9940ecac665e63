"""Phrases are looked up under the part that the fewest documents have."""

from folioflow.operators import joins
from folioflow import session


def test_two_words_meet_under_the_longer_one(spark, monkeypatch):
    rows = [(i, f"c{i}x of garden c{i}y") for i in range(200)] + [(200, "see abcdefgh cat"), (201, "abcdefgh dog"), (202, "xabcdefgh\nc"), (200, "abcdefgh c"), (None, "abcdefgh c")]
    stored = {}

    def spy(df, name="stored"):
        got = session.cut_lineage(df, name)
        stored[name] = got.count()
        return got

    monkeypatch.setattr(joins, "cut_lineage", spy)
    docs = spark.createDataFrame(rows, "d int, t string")
    phrases = spark.createDataFrame([(0, "abcdefgh c"), (0, "abcdefgh c"), (1, " of g"), (2, "f garden c1"), (None, "see abcdefgh"), (3, "\nc")], "p int, s string")
    got = sorted((r["d"], -1 if r["p"] is None else r["p"]) for r in joins.phrase_hits(docs, "d", "t", phrases, "p", "s").collect())
    want = sorted((d, -1 if p is None else p) for d, t in rows for p, s in {(0, "abcdefgh c"), (1, " of g"), (2, "f garden c1"), (None, "see abcdefgh"), (3, "\nc")} if d is not None and s in t)
    assert got == want
    # "abcdefgh c" has two words under its first part, and some 400 under its last one; only "\nc" must take these
    assert stored["anchors"] < 450
