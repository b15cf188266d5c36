import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tideloom.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, least=10):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[lower(line.strip(SPACE))].add(doc)
    order = lambda d: (d is None, d or 0)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [len(k := lower(x.strip(SPACE))) >= least and min(holders[k], key=order) != doc for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((doc, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_hard_cases(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = line_dedup.dedup_lines(documents.drop("kept")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_clashing_columns_are_carried(documents):
    out = line_dedup.dedup_lines(documents.drop("kept"))
    assert out.select("_doc", "_text", "_keep").distinct().collect() == [(1, 2, 3)]


@pytest.mark.parametrize("least", [64])
def test_hot_line(spark, least):
    rows = [(i, f"the line that everybody has\nown line number {i} of its own") for i in range(300)]
    rows += [(900, "\n".join(f"line {k} of a long document" for k in range(500)) + "\nthe line that everybody has")]
    rows += [(901, "\n".join(f"line {k} of a long document" for k in range(0, 500, 3)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty_table(documents):
    assert line_dedup.dedup_lines(documents.drop("kept").limit(0)).count() == 0
