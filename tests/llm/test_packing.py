import zlib

import numpy as np
import public_tokenizers
from helpers import ODD, frame
from tokenizers import Tokenizer

from textloom.llm import packing as P

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def check(rows, texts, size=2048):
    """Pieces hold each document's ids once, in order; sequences have no gaps; returns the share of padding."""
    whole = Tokenizer.from_file(PATHS[0])
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
    return 1 - sum(r.length for r in rows) / (size * len(by_sequence))


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert check(P.pack(docs, *PATHS).collect(), texts) < 0.01


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED_AT_ONCE", 3)
    texts = [(100 + i, t) for i, (_, t) in enumerate(ODD)] + [(1, "a <|endoftext|> b"), (2, "x" * 30_000), (3, "word " * 40_000)]
    got = P.pack(frame(spark, texts), *PATHS, with_ids=True).collect()
    check(got, texts)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    twice = P.pack(frame(spark, [(5, "same"), (5, "same"), (None, None)]), *PATHS).collect()
    assert len(twice) == 3 and sum(r.length for r in twice) == 5
    assert P.pack(frame(spark, []), *PATHS).count() == 0


def test_tokenizers_agree():
    slow, fast = P.tokenizer(PATHS[0], ""), P.tokenizer(*PATHS)
    texts = ["", " a  b\n\n c\t", "don't we'll", "été 123 ４５ ½", "\u00a0x\u2003y", "\U0001f600\u200d", "<|endoftext|>x", "a" * 5000, "\r\n \r\n"]
    assert slow(texts) == fast(texts)


def test_patterns_meet_the_demand():
    r = np.random.default_rng(1)
    demand = np.bincount(r.integers(1, 65, 5000), minlength=65)
    patterns = P.solve(demand, 64)
    assert (sum(p * n for p, n in patterns) == demand).all()
    assert all((p * np.arange(65)).sum() <= 64 for p, _ in patterns)
    assert sum(n for _, n in patterns) <= 1.005 * (demand * np.arange(65)).sum() / 64 + 5
    assert P.solve(np.zeros(9, dtype=np.int64), 8) == []


def test_knapsack():
    value = np.array([0, 1.0, 3.0, 0, 0, 0])
    best, n = P.best_pattern(value, 5)
    assert best == 7 and n[1] == 1 and n[2] == 2
