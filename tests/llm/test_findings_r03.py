"""What round 3 found: contexts that were dropped, and work that grew too fast."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import ppm, scoring
from test_text_operators import WORDS, slow_bits, slow_tree


def _texts():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    return [*texts, *("".join(rng.choice("abcdefé雨") for _ in range(200)) for _ in range(20)), "", None, "rain never \x01\x02 seen ZZZ 静か"]


@pytest.mark.parametrize("contexts", [0, 5, 60_000])
def test_scores_do_not_depend_on_the_contexts_held(spark, contexts):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "panel long, content string")
    got = {r["panel"]: r["score"] for r in scoring.score_scripts(df, F.col("panel") % 4 != 0, contexts=contexts, block_rows=9).collect()}
    lower = [(t or "").lower().encode() for t in texts]
    counts = slow_tree([t for i, t in enumerate(lower) if i % 4])
    assert [got[i] for i in range(len(texts))] == pytest.approx([-slow_bits(counts, t) * math.log10(2) for t in lower], rel=1e-5)


def test_contexts_beside_the_tree_are_whole(spark):
    texts = [(t or "").encode() for t in _texts()]
    df = spark.createDataFrame([(t.decode(),) for t in texts], "t string")
    counts, rest = ppm.split_contexts(df, F.col("t"), 7)
    assert len(np.unique(counts[1][counts[0] == 3] >> 8)) == 7
    slow = {c: n for c, n in slow_tree(texts).items() if len(c) == 3}
    beside = {}
    for r in rest.collect():
        beside.setdefault(r["ctx"], {})[r["key"] & 255] = r["n"]
    assert len(beside) == len(slow) - 7
    assert all(slow[(c >> 16, c >> 8 & 255, c & 255)] == n for c, n in beside.items())
    assert ppm.split_contexts(df, F.col("t"), 60_000)[1] is None
