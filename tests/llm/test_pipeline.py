import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tideloom.llm import packing, quality
from tideloom.llm.queries import quality_model


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "minhash_near_dedup", "source_mix", "best_fit_packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(lambda: stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns
        seen[name] = docs.count()
    assert 0 < seen["quality_classifier"] <= n and seen["line_dedup"] == seen["quality_classifier"] >= seen["minhash_near_dedup"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.where("piece = 0").count() == docs.count()


def test_stages_on_hard_and_empty_documents(spark, sf_dir, documents):
    for docs in (documents, documents.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.settle(lambda: stage(spark, docs, sf_dir), "test-stage")
            assert out.columns == columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()
    kept = corpus_pipeline.drop_repeated_lines(spark, documents, sf_dir)
    assert kept.select("kept", "size", "_keep").distinct().collect() == [(6, 4, 3)]


# --- every stage, and the whole, against plain Python -------------------------------------------------------------


def naive_quality(docs, model):
    from test_quality import naive_features

    def keeps(text):
        features = np.array(sorted(naive_features(text, model.bits)))
        score = (model.weights[features] * np.where(features < quality.MEASURED, quality.BAND_VALUE, 1.0)).sum()
        return 1 / (1 + np.exp(model.thresholds[-1] - score)) >= quality.LEAST

    return [r for r in docs if keeps(r["text"])]


def naive_lines(docs):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    lines = {r["doc_id"]: (r["text"] or "").split("\n") for r in docs}
    owner, holders = {}, {}
    for d in sorted(lines):
        for line in lines[d]:
            owner.setdefault(key(line), d)
            holders.setdefault(key(line), set()).add(d)
    gone = lambda d, k: len(k) >= 10 and len(holders[k]) > 1 and owner[k] != d
    out = []
    for r in docs:
        text = "\n".join(x for x in lines[r["doc_id"]] if not gone(r["doc_id"], key(x)))
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def naive_copies(docs, weights=(5, 2, 1)):
    """Copies of each row by systematic sampling, its line laid out as the operator says."""
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    digits = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    rows = [{"r": r, "size": words(r["text"]), "h": digits(f"{r['doc_id']}:{r['text'] or ''}")} for r in docs]
    for x in rows:
        bits = x["size"].bit_length()
        x["cls"] = x["size"] if x["size"] < 16 else 16 + (bits - 5) * 8 + (x["size"] >> (bits - 4) & 7)
    by_class = Counter((x["r"]["source"], x["cls"]) for x in rows)
    subs = max(1, -(-max(by_class.values()) // 256))
    totals = Counter()
    for x in rows:
        totals[x["r"]["source"]] += x["size"]
    names = sorted(totals)
    weight = {s: float(weights[i % 3]) for i, s in enumerate(names)}
    target, budget, free = {}, 1.5 * sum(totals.values()), set(names)
    while True:
        total = sum(weight[s] for s in free)
        full = {s for s in free if budget * weight[s] / total >= 2 * totals[s]}
        if not full:
            break
        target |= {s: 2.0 * totals[s] for s in full}
        budget, free = budget - sum(2.0 * totals[s] for s in full), free - full
    target |= {s: budget * weight[s] / sum(weight[t] for t in free) for s in free}
    out = []
    for s in names:
        own = sorted((x for x in rows if x["r"]["source"] == s), key=lambda x: (x["cls"], x["h"] % subs, x["size"], x["r"]["doc_id"]))
        rate, offset = target[s] / totals[s] if totals[s] else 0.0, digits("mix-1:" + s) / 2.0**32
        for rank, x in enumerate(own, 1):
            out += [x["r"]] * min(2, math.floor(rate * rank + offset) - math.floor(rate * (rank - 1) + offset))
    return out


def plain(df):
    return [r.asDict() for r in df.collect()]


def rows_of(docs):
    return sorted(repr(sorted(r.items())) for r in docs)


def test_stages_and_run_against_plain_python(spark, sf_dir):
    from test_near_dedup import exact_join

    stages, df = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, model = plain(df), quality_model(df, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def after(name, df, want):
        got = corpus_pipeline.settle(lambda: stages[name](spark, df, sf_dir), "test-stage")
        assert rows_of(plain(got)) == rows_of(want), name
        return got

    docs = naive_quality(docs, model)
    df = after("quality_classifier", df, docs)
    docs = naive_lines(docs)
    df = after("line_dedup", df, docs)
    kept = {d for d, _, _, keep in exact_join([(r["doc_id"], r["text"]) for r in docs]) if keep}
    docs = [r for r in docs if r["doc_id"] in kept]
    df = after("minhash_near_dedup", df, docs)
    docs = naive_copies(docs)
    df = after("source_mix", df, docs)

    slow = Tokenizer.from_file(packing.default_vocabulary())
    want = []
    for r in docs:
        ids = np.array([*slow.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(r["doc_id"], k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(ids, 2048))]
    for pieces in (stages["best_fit_packing"](spark, df, sf_dir), corpus_pipeline.run(spark, sf_dir)):
        rows = pieces.collect()
        assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
        filled = {}
        for r in rows:
            filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in filled.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
        least = max(-(-sum(r["length"] for r in rows) // 2048), sum(r["length"] > 1024 for r in rows))
        assert len(filled) <= 1.05 * least + 1


def test_run_leaves_only_what_it_still_reads(spark, sf_dir):
    from tideloom.llm import common

    before = set(common._made)
    corpus_pipeline.run(spark, sf_dir).count()
    assert len({p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._made - before}) <= 2  # the last stage's documents, and its pieces
