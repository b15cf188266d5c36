import tracemalloc
import types

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tideloom.llm import common, quality
from tideloom.llm.queries import quality_model


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 7)))
    vocabulary = [word() for _ in range(800)]
    rows = []
    for i in range(900):
        kind = i % 3
        words = [vocabulary[k] for k in rng.integers(0, 800, 60)]
        if kind == 0:
            words[int(rng.integers(60))] = "vilewretch"
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(kind != 1), int(kind == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    model = quality_model(df, df.where("doc_id < 600").select("doc_id", "quality", "toxic"))
    scored = quality.score(df.where("doc_id >= 600"), model).join(df.select("doc_id", "quality", "toxic"), "doc_id")
    kept = {r["g"]: r["k"] for r in scored.groupBy(quality.grade_of(F.col("quality"), F.col("toxic")).alias("g")).agg(F.avg((F.col("tail_probability") >= quality.LEAST).cast("int")).alias("k")).collect()}
    assert kept[2] > 0.97 and kept[1] < 0.05 and kept[0] < 0.1
    grades = scored.select("expected_grade").toPandas()["expected_grade"]
    assert grades.between(0, 2).all()


def test_select_keeps_columns_and_agrees_with_score(spark, documents):
    model = quality_model(documents, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 1), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int"))
    out = quality.select(documents, model)
    want = quality.score(documents, model).where(F.col("tail_probability") >= quality.LEAST).count()
    assert out.columns == documents.columns and out.count() == want and quality.score(documents, model).count() == documents.count()


def test_one_grade_none_and_empty(spark, documents):
    for labels in ([(1, 1, 0)], []):
        model = quality_model(documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert quality.score(documents, model).select("tail_probability").distinct().count() == 1
    assert quality.score(documents.limit(0), model).count() == 0


def test_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    docs = [np.unique(rng.integers(448, 5000, 30)).astype(np.int32) for _ in range(200)]
    assert (np.diff(quality.fit(docs, rng.integers(0, 4, 200), 4, 13).thresholds) > 0).all()


def naive_fit(docs, grades, n_grades, rounds, noise=1.0, rate=0.3):
    """Document by document and feature by feature, in dictionaries."""
    n, sig = len(docs), lambda x: 1 / (1 + np.exp(-x))
    held = {}
    for d in docs:
        for f in d:
            held[f] = held.get(f, 0) + 1
    known = [f for f in held if held[f] >= 3]
    worth = lambda f: quality.BAND_VALUE if f < quality.MEASURED else 1.0
    cuts = [np.log(s / (1 - s)) for s in (np.clip(np.mean([g <= j for g in grades]), 0.01, 0.99) for j in range(n_grades - 1))]
    base, steps = cuts[0], [np.log(max(b - a, 0.05)) for a, b in zip(cuts, cuts[1:])]
    w, g2, t2 = dict.fromkeys(known, 0.0), dict.fromkeys(known, 1e-12), np.full(n_grades - 1, 1e-12)
    for _ in range(rounds):
        cut = [base + sum(np.exp(s) for s in steps[:j]) for j in range(n_grades - 1)]
        gradient, d_cut = dict.fromkeys(known, 0.0), np.zeros(n_grades - 1)
        for d, y in zip(docs, grades):
            score = sum(w[f] * worth(f) for f in d if f in w)
            high = sig(cut[y] - score) if y < n_grades - 1 else 1.0
            low = sig(cut[y - 1] - score) if y else 0.0
            p = max(high - low, 1e-9)
            for f in d:
                if f in w:
                    gradient[f] += (high * (1 - high) - low * (1 - low)) / p * worth(f) / n
            if y < n_grades - 1:
                d_cut[y] -= high * (1 - high) / p / n
            if y:
                d_cut[y - 1] += low * (1 - low) / p / n
        for f in known:
            g2[f] += gradient[f] ** 2
            step = rate / np.sqrt(g2[f])
            moved = w[f] - step * gradient[f]
            w[f] = np.sign(moved) * max(abs(moved) - step * noise * np.sqrt(held[f]) / n, 0.0)
        slope = np.array([d_cut.sum(), *[np.exp(s) * d_cut[j + 1 :].sum() for j, s in enumerate(steps)]])
        t2 += slope**2
        move = 0.2 * slope / np.sqrt(t2)
        base, steps = base - move[0], [s - m for s, m in zip(steps, move[1:])]
    return w, [base + sum(np.exp(s) for s in steps[:j]) for j in range(n_grades - 1)]


def test_fit_agrees_with_a_naive_one():
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 3, 90)
    docs = [np.unique(np.concatenate((rng.integers(0, 60, 4), 448 + rng.integers(0, 40, 12), 500 + 10 * g + rng.integers(0, 6, 3)))).astype(np.int32) for g in grades]
    weights, cuts = naive_fit([d.tolist() for d in docs], grades, 3, 12)
    model = quality.fit(list(docs), grades, 3, 12, rounds=12, each=7)
    assert np.allclose(model.thresholds, cuts, atol=1e-6)
    got = {int(f): model.weights[f] for f in np.flatnonzero(model.weights)}
    assert set(got) == {f for f, v in weights.items() if v} and all(abs(got[f] - weights[f]) < 1e-5 for f in got)
    scores = [sum(weights.get(int(f), 0.0) * (quality.BAND_VALUE if f < quality.MEASURED else 1.0) for f in d) for d in docs]
    assert np.allclose(model.scores(docs), scores, atol=1e-4)


def naive_features(text, bits):
    """Tokens by regular expression, hashes byte by byte, measures by counting."""
    import re

    from tideloom.llm.shingles import _BASE, mix

    data = (text or "").encode()
    tokens = [m.group() for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", data)]
    value = lambda t: sum((c + 1) * pow(int(_BASE), i, 1 << 64) for i, c in enumerate(t)) % (1 << 64)
    finish = lambda x: int(mix(np.array([x % (1 << 64)], dtype=np.uint64))[0])
    span, out = (1 << bits) - quality.MEASURED, set()
    for t in (t.lower() for t in tokens):
        out.add(finish(value(t) + len(t)))
        out |= {finish(value(t[:k]) + (1 << (40 + k))) for k in quality.STEMS}
    own = {h % span + quality.MEASURED for h in out}
    size, n = max(1, len(data)), len(tokens)
    share = lambda test: sum(map(test, data)) / size
    upper, lower, digit = share(lambda c: 65 <= c <= 90), share(lambda c: 97 <= c <= 122), share(lambda c: 48 <= c <= 57)
    mark = share(lambda c: 33 <= c < 128) - upper - lower - digit
    measures = [20 * upper**0.5, 20 * digit**0.5, 20 * max(0.0, mark) ** 0.5, 40 * share(lambda c: c == 10) ** 0.5]
    measures += [8 * len(own) / max(1, n), 2 * (sum(map(len, tokens)) / n if n else 0), np.log2(n + 1)]
    return own | {(k << 6) + min(63, int(m)) for k, m in enumerate(measures)}


def test_features_agree_with_naive_ones():
    texts = ["Plain words, and MORE words: 12 of them!", "", None, "  \n\n x", "naïve café 日本 -- ??", "a1b2 " * 4000 + "END", "One\ttab\rreturn"]
    got = [set(f.tolist()) for f in quality.features(texts, 20)]
    assert got == [naive_features(t, 20) for t in texts]


def test_repeated_rated_documents_stay_within_the_sample(spark):
    docs = spark.createDataFrame([(1, f"first text {i}") for i in range(50)] + [(2, "second")], "doc_id long, text string")
    ratings = spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, grade int")
    lists, grades = quality._rated(docs, ratings, 10, 20)
    assert len(lists) == len(grades) == 10


def test_scoring_holds_the_features_of_few_documents():
    """4,000 documents in one Arrow batch: all their features at once are 40 MB, and several times that with weights and values."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 100_000, 800)) for _ in range(4_000)]
    model = quality.Model(20, rng.normal(size=1 << 20), np.array([-1.0, 1.0]))
    score = quality._scorer(types.SimpleNamespace(value=model), "text")
    next(score(iter([pd.DataFrame({"text": texts[:10]})])))  # tables of powers grow once
    tracemalloc.start()
    got = next(score(iter([pd.DataFrame({"text": texts})])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    some = [0, 255, 256, 257, 3_999]
    alone = [model.tails(model.scores([f]))[0] for f in quality.features([texts[i] for i in some], 20)]
    assert np.array_equal(got["tail_probability"].to_numpy()[some], [t[-1] for t in alone])
    assert len(got) == 4_000 and len(model.scores([])) == 0


def test_free_memory_goes_back_when_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    task = common.lean(lambda batches: (2 * b for b in batches))
    assert list(task(iter([1, 2]))) == [2, 4] and calls == [1]
    early = task(iter([1, 2]))
    assert next(early) == 2 and calls == [1]
    early.close()  # a consumer that needs no more
    assert calls == [1, 1]
    monkeypatch.undo()
    common.give_back()
