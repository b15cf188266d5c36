import re
from pathlib import Path

import numpy as np
import pytest

from tideloom.llm import near_dedup


def word_sets(rows, width=5):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return sets


def joined(rows, sets, links):
    """Rows of the result from the places of linked rows."""
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, j in links:
        x, y = top(rows[i][0]), top(rows[j][0])
        parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else top(d), d is None or top(d) == d) for (d, _), s in zip(rows, sets)), key=repr)


def brute(rows, width=5, part=75, whole=100):
    sets = word_sets(rows, width)
    usable = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    near = lambda i, j: whole * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j])
    return joined(rows, sets, [(i, j) for i in usable for j in usable if j < i and near(i, j)])


def exact_join(rows, part=75, whole=100):
    """Every pair that shares a shingle, by counting through an inverted index; equal sets stand together."""
    sets = word_sets(rows)
    first, links, holders = {}, [], {}
    for i, (d, _) in enumerate(rows):
        if d is None or not sets[i]:
            continue
        if (same := first.setdefault(frozenset(sets[i]), i)) != i:
            links.append((i, same))
            continue
        counts = {}
        for shingle in sets[i]:
            for j in holders.setdefault(shingle, []):
                counts[j] = counts.get(j, 0) + 1
            holders[shingle].append(i)
        links += [(i, j) for j, both in counts.items() if whole * both >= part * (len(sets[i]) + len(sets[j]) - both)]
    return joined(rows, sets, links)


def test_equal_to_an_exact_join(spark):
    """Whole documents of a fixture with planted copies."""
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no fixture tables")
    docs = spark.read.parquet(str(path)).select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, near_dedup.link(docs).collect()), key=repr) == exact_join(rows)


def test_against_all_pairs(near_copies):
    rows = [(r["doc_id"], r["text"]) for r in near_copies.collect()]
    got = near_dedup.link(near_copies).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_hard_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted(map(tuple, near_dedup.link(documents).collect()), key=repr) == brute(rows)


def test_drop_keeps_one_of_each(near_copies):
    rows = [(r["doc_id"], r["text"]) for r in near_copies.collect()]
    kept = near_dedup.drop_near_copies(near_copies)
    assert kept.columns == near_copies.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((d for d, _, _, k in brute(rows) if k), key=repr)


def test_empty_tables(near_copies):
    assert near_dedup.link(near_copies.limit(0)).count() == 0
    assert near_dedup.link(near_copies.where("text IS NULL")).count() == 1


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_any_partitioning(spark, near_copies, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(r["doc_id"], r["text"]) for r in near_copies.collect()]
        assert sorted(map(tuple, near_dedup.link(near_copies.repartition(7)).collect()), key=repr) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def crowd():
    """200 pairs of similarity 146/194 = 0.753 in a crowd whose other pairs have 140/200 = 0.7."""
    rng = np.random.default_rng(5)
    words = lambda n: ["".join(rng.choice(list("abcdefghijklmnop"), 8)) for _ in range(n)]
    core, rows = words(144), []
    for pair in range(200):
        shared = words(6)
        rows += [(2 * pair + k, " ".join(core + shared + words(24))) for k in range(2)]
    return [rows[i] for i in rng.permutation(len(rows))]


def test_crowded_regions_are_finished(spark, crowd):
    got = near_dedup.link(spark.createDataFrame(crowd, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: d - d % 2 for d, _ in crowd}


def test_blocks_of_a_region(spark, crowd, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 30)
    got = near_dedup.link(spark.createDataFrame(crowd, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: d - d % 2 for d, _ in crowd}


def test_few_equal_hashes_are_enough(spark, crowd):
    """Pairs that share 1 to 5 of the 32 regions are linked like any other."""
    texts = dict(crowd)
    sets = list(near_dedup.shingle_sets([texts[d] for d in sorted(texts)], 5))
    hashes = near_dedup.region_hashes(sets)
    equal = (hashes[::2] == hashes[1::2]).sum(1)
    few = [2 * int(p) for p in np.flatnonzero((equal >= 1) & (equal <= 5))]
    assert few
    got = near_dedup.link(spark.createDataFrame(crowd, "doc_id long, text string"))
    component = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert [d for d in few if component[d] != component[d + 1]] == []
