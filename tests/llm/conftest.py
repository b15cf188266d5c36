import numpy as np
import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Hard cases: nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long_line = "a very long line of words " * 4000
    rows = [
        (1, "Shared line, long enough\nown line of one\n  shared LINE, long enough \t", "en", "a"),
        (2, "shared line, long enough\nanother own line\nshort", "en", "b"),
        (3, None, "en", None),
        (4, "", "en", "a"),
        (5, "\n\n", None, "b"),
        (6, long_line + "\nshared line, long enough", "en", "a"),
        (6, long_line + "\nshared line, long enough", "en", "a"),
        (7, "É shared line, long enough\nshort", "fr", "b"),
        (None, "shared line, long enough\ntail of the nameless", "en", "a"),
        (8, "É shared line, long enough\r\nshort", "fr", "\U0001f600"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "length(text) AS n_chars", "1 AS _doc", "2 AS _text", "3 AS _keep", "4 AS size", "5 AS copies", "6 AS kept")


@pytest.fixture(scope="session")
def near_copies(spark):
    """Groups of copies with a few words changed, among texts that share nothing but a boilerplate passage."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    rows, n = [], 0
    passage = " ".join(word() for _ in range(25))
    for group in range(12):
        base = [word() for _ in range(int(rng.integers(30, 160)))]
        for _ in range(int(rng.integers(1, 25))):
            words = list(base)
            for k in rng.choice(len(words), size=int(rng.integers(0, 4)), replace=False):
                words[k] = word()
            rows.append((n, " ".join(words) + (" " + passage if group % 3 == 0 else "")))
            n += 1
    rows += [(n, "two words"), (n + 1, "Two\twords "), (n + 2, None), (n + 3, " \n"), (None, "two words"), (0, rows[0][1])]
    return spark.createDataFrame(rows, "doc_id long, text string")
