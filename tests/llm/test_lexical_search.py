import math
import re
from collections import Counter

import numpy as np
from helpers import ODD, frame, low, words

from textloom.llm.lexical_search import Vocabulary, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, limit=50):
    bags = [(i, TERM.findall(low(t or ""))) for i, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        want, scores = set(TERM.findall(low(text or ""))), []
        for i, b in bags:
            if not b:
                continue
            m, tf = 50 + (50 * len(b) * n) // total, Counter(b)
            score = sum(weight[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in want if t in tf)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k, x[2], -x[0]) for k, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:limit], 1)]
    return sorted(out, key=str)


def result(spark, docs, items, limit=50):
    found = search(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), limit)
    return sorted(map(tuple, found.collect()), key=str)


def test_matches_brute_force_with_many_copies_and_ties(spark):
    pool = words(1, 60)
    docs = [(i, " ".join(pool[(i * 7 + j * (1 + i % 5)) % 60] for j in range(1 + i % 40))) for i in range(300)]
    docs += [(1000 - i, f"{pool[3].upper()}, {pool[4]}; {pool[3]}") for i in range(200)]  # one large class, ids descending
    docs += [(2000 + i, f"{pool[4]}! {pool[3]} {pool[3]}") for i in range(30)]  # the same bag in other words' order
    items = [(k, " ".join(pool[k : k + 6]) + " " + pool[k].upper()) for k in range(0, 50, 3)] + [(77, "unheard of"), (78, None), (79, "--"), (80, pool[3]), (80, pool[3])]
    assert result(spark, docs, items) == brute(docs, items)
    assert result(spark, docs, items, limit=7) == brute(docs, items, 7)


def test_odd_rows(spark):
    long = " ".join(words(2, 60_000))
    docs = [*ODD, (9, long), (10, long + " word"), (11, "Äöü äöü ÜBER"), (None, "word")]
    items = [(1, "WORD one äöü"), (2, long[:3000]), (3, "x y z"), (4, "Äöü")]
    assert result(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a")]) == []
    assert result(spark, [(1, "a")], []) == []
    assert result(spark, [(1, None), (2, "")], [(1, "a")]) == []


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    from textloom.llm import lexical_search

    pool = words(3, 80)
    docs = [(i, " ".join(pool[(i * 11 + j) % 80] for j in range(3 + i % 9))) for i in range(150)]
    items = [(k, " ".join(pool[k : k + 5])) for k in range(40)]
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 9)
    monkeypatch.setattr(lexical_search, "GATHERED", 20)
    monkeypatch.setattr(lexical_search, "CELLS", 300)
    assert result(spark, docs, items, limit=4) == brute(docs, items, 4)


def test_equal_hashes_are_told_apart():
    vocabulary = Vocabulary.of([b"abc", b"abd", b"x"])
    alike = Vocabulary(vocabulary.hashes * 0 + vocabulary.hashes[0], vocabulary.raw, vocabulary.at, 3)
    raw = np.frombuffer(b"abc abd x zzz", dtype=np.uint8)
    start, end = np.array([0, 4, 8, 10]), np.array([3, 7, 9, 13])
    for v in (vocabulary, alike):
        which, number = v.find(raw, start, end)
        found = {raw[start[i] : end[i]].tobytes(): v.raw[v.at[j] : v.at[j + 1]].tobytes() for i, j in zip(which, number, strict=True)}
        assert all(a == b for a, b in found.items())
    assert set(found) <= {b"abc", b"abd", b"x"}
