import re
import unicodedata
import zlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tideloom.llm import packing


def check(rows, texts, capacity):
    """Pieces rebuild the documents' ids, and sequences have no gap, overlap or excess."""
    slow = Tokenizer.from_file(packing.default_vocabulary())
    ids = {d: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for d, t in texts}
    placed, at = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at.get(r["doc_id"], 0) and len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == capacity
        at[r["doc_id"]] = r["start"] + r["length"]
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {d: len(x) for d, x in ids.items()}
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(placed)


def test_pieces_and_places(spark):
    rng = np.random.default_rng(3)
    texts = [(i, "wörd and other words, 12!\n\n  " * int(rng.integers(0, 30))) for i in range(150)] + [(900, None), (901, ""), (902, "long text " * 3000), (903, "<|endoftext|> inside")]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, length int")
    rows = packing.pack(df, capacity=128).collect()
    n = check(rows, texts, 128)
    assert n <= 1.05 * -(-sum(r["length"] for r in rows) // 128) + 1


def test_fixture_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs).collect()
    n = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 2048)
    assert n <= 1.05 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_repeated_rows_and_empty_table(spark, documents):
    rows = packing.pack(documents).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack(documents.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40))
def test_plan_places_every_piece(histogram):
    plan = packing.make_plan(histogram, 64)
    seen, fill = {}, {}
    for length, first, n, sequence, offset in sorted(map(tuple, plan.tolist())):
        assert seen.get(length, 0) == first
        seen[length] = first + n
        for s in range(sequence, sequence + n):
            fill.setdefault(s, []).append((offset, length))
    assert seen == histogram
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(k * v for k, v in histogram.items())
    # no packing takes fewer: all ids fill so many sequences, and two pieces of over half a sequence never share one
    least = max(-(-total // 64), sum(n for k, n in histogram.items() if k > 32))
    assert len(fill) <= 1.5 * least + 1


@pytest.fixture(scope="module")
def both():
    path = packing.default_vocabulary()
    return packing.Encoder(path), Tokenizer.from_file(path)


def test_ids_of_pieces_are_those_of_whole_texts(both, sf_dir):
    import pyarrow.parquet as pq

    own, slow = both
    assert own.by_pieces
    rng = np.random.default_rng(5)
    texts = ["It's 12,000 – naïve…  \n\n\t x", "日本語テキスト \U0001f600", "<|endoftext|> in a text", "a" * 5000, " " * 3000 + "x", "é \u200b\u3000 ½ Ⅷ ١٢", "", "''s '' 's!'s", "\x1c\x1d\x85\xa0 x"]
    texts += ["".join(chr(c) for c in rng.integers(1, 0x30000, int(rng.integers(1, 60))) if not 0xD800 <= c < 0xE000) for _ in range(3000)]
    texts += [t or "" for t in pq.read_table(sf_dir + "/documents.parquet", columns=["text"])["text"].to_pylist()]
    for text in texts:
        assert own(text) == packing._packed(slow.encode(text, add_special_tokens=False).ids), repr(text[:80])


def test_every_known_code_point_is_split_alike(both):
    """All assigned code points among letters, digits, marks and spaces; the others go through the whole-text way."""
    own, slow = both
    known = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    for at in range(0, len(known), 512):
        text = "\n".join(f"a{c}b {c}1{c}{c}  {c}" for c in known[at : at + 512])
        assert [m.span() for m in regex.finditer(packing.SPLIT, text)] == [span for _, span in slow.pre_tokenizer.pre_tokenize_str(text)], hex(ord(known[at]))
    unknown = re.compile(packing.unknown_code_points())
    assert not unknown.search("".join(c for c in known if c < "\U00010000")) and all(unknown.match(chr(c)) for c in (0x378, 0x88F, 0x1DF90, 0x3D000, 0x10FFFF))


def test_few_pieces_are_remembered(both, monkeypatch):
    own, slow = both
    monkeypatch.setattr(packing, "PIECES_HELD", 3)
    own._pieces.clear()
    text = "one two three four five six " + "x" * 100
    assert own(text) == packing._packed(slow.encode(text, add_special_tokens=False).ids) and len(own._pieces) <= 3


def test_files_of_another_kind_go_whole():
    kind = lambda **more: {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {}} | more
    assert packing.splits_alike(kind())
    for other in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"model": {"dropout": 0.1}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        assert not packing.splits_alike(kind(**other))
