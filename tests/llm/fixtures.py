"""Rows that every operator must take: nulls, blanks, ties, repeats, long texts, extra columns with clashing names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copies long, _size int, node string, digest string, rank int"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = sentence(rng, 60)
    near = base.split()
    near[30] = "changed"
    return [
        None, "", " \t\n", "one", "two words", "a b c d", "A B c d", base, base, " ".join(near), base.upper(), sentence(rng, 12), "word " * 5000, "x" * 30_000,
        "MIT License\nMIT license, cc by-nc 4.0 and CC  BY", "line one here\nline one here\nthird | row | of | a | table", "é " * 40 + "<|endoftext|>", "1 2 3 4 5 6 7 8 9 10 11",
    ]


def documents(spark, seed=1):
    rows = [(i, t, "en", None if i % 4 == 3 else f"s{i % 3}", None, 0.5, 7, 1, "n", "d", 1) for i, t in enumerate(texts(seed))]
    rows.append(rows[7])  # a repeated row
    rows.append((None, "a row without an id but with words", None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
