import pytest

from tideloom.llm import source_mix


def water_fill(sizes, weights, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * unit > most * sizes[s]]
        if not over:
            return out | {s: w[s] * unit for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_targets_and_sums(spark):
    rows = [(i, "word " * (1 + i * 7 % 50), s) for s, n in (("a", 900), ("b", 60), ("c", 200), ("d", 40), (None, 300)) for i in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report = source_mix.mix_report(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, source = water_fill(sizes, (5, 2, 1)), {k: s for k, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in report:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60, (s, taken[s], want[s])
    assert sorted(map(tuple, source_mix.mix_report(df).collect())) == sorted(map(tuple, report))


def test_mixed_rows_are_the_reported_copies(spark, documents):
    report = source_mix.mix_report(documents)
    mixed = source_mix.mix(documents)
    assert mixed.columns == documents.columns
    assert mixed.count() == sum(r["copies"] for r in report.collect()) and report.count() == documents.count()


def test_empty_table_and_no_words(spark, documents):
    assert source_mix.mix_report(documents.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [r["taken"] for r in source_mix.mix_report(blank).collect()] == [0, 0]
