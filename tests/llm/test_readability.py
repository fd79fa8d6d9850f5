import random

import numpy as np

from lexmill.llm import readability as R

WORDS = {1: "cat dog hat box run red".split(), 2: "machine button glove report cabinet shift".split(), 3: "torque calibrate runout pressure tolerance gasket".split(), 4: "heteroscedasticity stochastic spectral eigenmode posterior".split()}
COMMON = "the a of and to is in".split()


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        level = i % 4 + 1
        text = []
        for s in range(10):
            own = level if s % 5 else max(1, min(4, level + rng.choice((-1, 1))))
            text.append(" ".join(rng.choices(WORDS[own], k=5) + rng.sample(COMMON, 3)).capitalize() + ".")
        rows.append((i, " ".join(text), level))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1, 240)
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id bigint, text string, words string")
    rng = random.Random(2)
    given = [(i, level if rng.random() > 0.05 else max(1, level - 1)) for i, _, level in rows[:60]]
    labels = spark.createDataFrame(given, "key bigint, level int")
    got = {r["doc_id"]: r["reading_level"] for r in R.ReadingLevels(df, labels).levels().collect()}
    assert len(got) == 240
    assert sum(got[i] == level for i, _, level in rows[60:]) >= 0.97 * 180


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "too short"), (4, "1234567890 " * 10), (5, "cat dog hat box. " * 8), (6, "電磁閥請確認" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(5, 1), (5, 1), (99, 3)], "key bigint, level int")
    got = {r["doc_id"]: r["reading_level"] for r in R.ReadingLevels(df, labels).levels().collect()}
    assert set(got) == {4, 5, 6} and got[5] in (1, 2) and got[4] == 2
    assert R.ReadingLevels(df, labels.limit(0)).levels().count() == 0
    assert R.ReadingLevels(df.limit(0), labels).levels().count() == 0


def test_short_sentences_count(spark):
    rows = [(i, ". ".join(random.Random(i).choices(WORDS[i % 4 + 1], k=20)) + ".") for i in range(80)]  # one word each
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 4 + 1) for i in range(40)], "key bigint, level int")
    got = {r["doc_id"]: r["reading_level"] for r in R.ReadingLevels(df, labels).levels().collect()}
    assert all(got[i] == i % 4 + 1 for i in range(40, 80))


def test_words_do_not_depend_on_their_neighbours_texts():
    a = R.words_of(["One two three four.", "Five six seven eight."])
    b = R.words_of(["Five six seven eight."])
    assert a[0][4:].tolist() == b[0].tolist() and a[2].tolist() == [0, 1]


def test_words_are_fitted_to_what_is_expected():
    """The Newton steps end where expected and observed counts and level sums agree (up to the prior)."""
    words = R.Words(0.5 + np.arange(33) / 8, spread=50.0)
    histogram = np.zeros(33)
    histogram[[4, 12, 20, 28]] = (9000, 12000, 8000, 5000)  # words at levels 1 to 4
    slope, intercept = np.array([-1.2, 0.0, 0.9]), np.array([-6.0, -3.0, -7.0])
    p = 1 / (1 + np.exp(-(slope[:, None] * (words.grid - words.middle) + intercept[:, None])))
    counts, levels = np.zeros(R.BUCKETS), np.zeros(R.BUCKETS)
    counts[:3], levels[:3] = p @ histogram, (p * histogram) @ words.grid
    words.fit(counts, levels, histogram)
    assert np.allclose(words.slope[:3], slope, atol=0.02) and np.allclose(words.intercept[:3], intercept, atol=0.02)
    assert words.difficulty()[2] > words.difficulty()[0] and not words.known[3:].any()
    shares = words.sentences(np.array([0, 0, 2, 2, 1]), np.array([2, 2, 1]))
    assert shares[0].argmax() < shares[1].argmax() and np.allclose(shares.sum(1), 1)
