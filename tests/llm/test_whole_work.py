"""Work that must be done whole: each case was cut short before."""

import random

import numpy as np

from folioflow.llm import descent, lines, minhash, multiindex

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def edited(rng, line, share):
    """The line with so many letters changed at random places."""
    out = list(line)
    for i in rng.sample([i for i, x in enumerate(line) if x != " "], max(1, int(share * len(line)))):
        out[i] = rng.choice([x for x in LETTERS if x != out[i]])
    return "".join(out)


def linked(spark, pairs):
    """How many second lines of the pairs go."""
    df = spark.createDataFrame([(2 * i + j, p[j]) for i, p in enumerate(pairs) for j in (0, 1)], "panel long, content string")
    gone = {r["panel"] for r in lines.drop_repeated_lines(df).collect() if r["n_dropped"]}
    assert all(g % 2 for g in gone)
    return len(gone)


def test_lines_with_a_changed_word_meet(spark):
    rng = random.Random(11)
    pairs = []
    for n in (11, 20, 40, 100):
        for _ in range(40):
            w = words(rng, n)
            i = rng.randrange(n)
            pairs.append((" ".join(w), " ".join(w[:i] + [edited(rng, w[i], 0.2)] + w[i + 1:])))
    for _ in range(40):  # a script without blanks
        line = "".join(words(rng, 12))
        pairs.append((line, edited(rng, line, 0.01)))
    assert linked(spark, pairs) >= 198  # of 200


def test_all_lines_of_a_bucket_are_compared(spark):
    rng = random.Random(12)
    head = " ".join(words(rng, 14))
    texts = []
    for _ in range(12):  # a template with many variants, each there twice with a letter changed
        tail = " ".join(words(rng, 12))
        texts += [f"{head} {tail}", f"{head} {edited(rng, tail, 0.05)}"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "panel long, content string")
    assert sum(r["n_dropped"] for r in lines.drop_repeated_lines(df).collect()) == 12


def test_pairs_in_a_family_of_unlike_scripts_are_found(spark):
    rng = random.Random(13)
    shared = words(rng, 200)
    texts = [" ".join(shared + words(rng, 60)) for _ in range(60)] + [" ".join(shared + words(rng, 18)) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "panel long, content string")
    got = {r["panel"]: r["component_id"] for r in minhash.near_duplicate_scripts(df).collect()}
    assert got == {**{i: i for i in range(61)}, 61: 60}


def test_long_other_words_are_no_repeats(spark):
    """Lines that differ in one word of 40 letters, over 70 such words: never within a tenth of their letters."""
    rng = random.Random(31)
    head = " ".join(words(rng, 10))
    tails = ["".join(rng.choice(LETTERS) for _ in range(40)) for _ in range(70)]
    rows = [(i, f"{head} {t}") for i, t in enumerate(tails)] + [(100, f"{head} {tails[0][:-2]}zz")]
    got = {r["panel"]: r["n_dropped"] for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "panel long, content string")).collect()}
    assert got == {**{i: 0 for i in range(70)}, 100: 1}


def test_each_text_of_a_key_counts(spark):
    rng = random.Random(21)
    one, two = ([f"w{rng.randrange(10 ** 6)}" for _ in range(200)] for _ in range(2))
    near = one[:100] + ["other"] + one[101:]
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(near)), (0, " ".join(two[:50] + ["x"] + two[51:])), (5, "zz"), (None, " ".join(one))]
    got = sorted(map(tuple, minhash.near_duplicate_scripts(spark.createDataFrame(rows, "panel long, content string"), words=2).collect()), key=str)
    assert got == sorted([(0, 199, 0, True), (1, 199, 0, False), (1, 199, 0, False), (2, 199, 0, False), (5, 1, 5, True), (None, 199, None, True)], key=str)


def test_tight_groups_that_fill_their_lists_still_join(spark):
    rng = np.random.default_rng(14)
    a, other = np.eye(32)[0], np.eye(32)[1]
    b = 0.95 * a + (1 - 0.95 ** 2) ** 0.5 * other
    m = np.concatenate([c + 0.01 * rng.standard_normal((30, 32)) for c in (a, b)])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    assert near[:30, 30:].all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "panel long, embedding array<double>")
    got = {r["panel"]: (r["n_links"], r["component_id"]) for r in descent.near_duplicate_vectors(df).collect()}
    assert got == {i: (int(near[i].sum()) - 1, 0) for i in range(60)}


def test_a_vector_of_another_length_is_left_out(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(50)] + [(50, rng.standard_normal(7).tolist())]
    df = spark.createDataFrame(rows, "panel long, embedding array<double>")
    got = multiindex.nearest(df, df.where("panel in (0, 50)"), "panel", "embedding").collect()
    assert {r["query_id"] for r in got} == {0} and all(r["vec_id"] not in (0, 50) for r in got) and len(got) > 0
