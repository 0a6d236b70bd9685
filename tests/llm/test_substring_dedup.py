import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, frame, words

from textloom.llm import substring_dedup as S
from textloom.llm.entries import op7_run_length_index


def brute(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                hit[i : i + n] = b"\1" * n
        out.append((len(t), bytes(x for x, h in zip(t, hit, strict=True) if not h)))
    return out


def corpus(seed):
    r, vocabulary = random.Random(seed), words(seed, alphabet="abcé")
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, rows = [text(60) for _ in range(6)], []
    for i in range(90):
        parts = [text(r.randint(5, 30))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            at = r.randrange(len(s) // 2)
            parts += [s[at : at + r.randint(10, len(s))], text(r.randint(1, 20))]
        rows.append((100 + i, " ".join(parts)))
    return [*rows, (500, rows[0][1]), (501, "ab" * 300), (502, "x" * 400), *ODD]


@pytest.mark.parametrize("hot", [2000, 4])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_REGIONS", hot)
    rows = corpus(1)
    got = S.remove_repeats(frame(spark, rows), 60).collect()
    want = brute([(t or "").encode() for _, t in rows], 60)
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.kept)) for r in got) == sorted((str(d), n, k) for (d, _), (n, k) in zip(rows, want, strict=True))
    for r in got:
        assert r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_passages_equal_brute_force(spark):
    r, vocabulary = random.Random(3), words(3)
    text = lambda n: r.choices(vocabulary, k=n)
    rows = []
    for i in range(60):
        shared = text(r.choice((49, 50, 51, 52, 70)))
        for j in range(2):
            rows.append((10 * i + j, " ".join([*text(r.randint(0, 40)), *shared, *text(r.randint(0, 40))]).replace(" ", "\n", 1)))
        if i % 5 == 0:
            rows.append((10 * i + 5, rows[-1][1]))
        rows.append((10 * i + 7, " ".join([*(own := text(60)), "x", *own])))
    rows += [(None, rows[0][1]), (rows[3][0], rows[3][1]), *ODD]
    seen = {}
    for k in set(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", k[1] or "")
        for s in range(len(w) - 50):
            seen.setdefault(tuple(w[s : s + 51]), set()).add(k)
    want = {k for v in seen.values() if len(v) > 1 for k in v}
    got = S.remove_repeats(frame(spark, rows), 400).select("doc_id", "n_bytes", "repeats_passage").collect()
    assert sorted(map(str, ((x.doc_id, x.n_bytes, x.repeats_passage) for x in got))) == sorted(str((k[0], len((k[1] or "").encode()), k in want)) for k in rows)
    assert 60 < len(want) < 150


def test_long_texts_are_cut_into_slices(monkeypatch, spark):
    monkeypatch.setattr(S, "SLICE_BYTES", 1000)
    monkeypatch.setattr(S.nptext, "CHUNK_BYTES", 1500)
    raw = " ".join(random.Random(5).choices(words(5), k=900)).encode()
    import numpy as np

    whole = np.frombuffer(raw, dtype=np.uint8)
    found = [(int(p + s), int(p + e)) for part, cuts, rows, places in S._slices(whole, np.array([0, len(whole)]), 60) for p, s, e in zip(places[S.regions_of(part, cuts, 60)[0]], *S.regions_of(part, cuts, 60)[1:3], strict=True)]
    covered = [w for s, e in found for w in range(s, e + 1)]
    assert sorted(covered) == list(range(len(raw) - 59))


def test_query_equals_brute_force(spark):
    """At the query's 400 bytes, on a table with copies, repeated lines and passages."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = brute([(r.text or "").encode() for r in docs], 400)
    got = {r.doc_id: r for r in op7_run_length_index(spark, "/root/testdata/sf0.001").collect()}
    for r, (n, kept) in zip(docs, want, strict=True):
        x = got[r.doc_id]
        assert (x.n_bytes, x.n_removed, x.kept_sha256) == (n, n - len(kept), hashlib.sha256(kept).hexdigest())
    assert sum(x.n_removed > 0 for x in got.values()) > 5


def test_index_streams_matching_statistics():
    texts = [b"abracadabra", b"cadabrab", b"zz"]
    hits = S.repeated_windows(texts, 4)
    seen = Counter(t[i : i + 4] for t in texts for i in range(len(t) - 3))
    assert [list(h) for h in hits] == [[seen[t[i : i + 4]] > 1 for i in range(len(t) - 3)] for t in texts]


def test_matches_too_short_to_count_are_not_measured():
    raw = S.np.frombuffer(b"\xff".join([b"abracadabra", b"cadabrab", b"zz"]) + b"\xff", dtype=S.np.uint8)
    whole, index = S.RunLengthIndex(raw, 40), S.RunLengthIndex(raw, 40, 4)
    for a, b in ((whole.head_shared, index.head_shared), (whole.tail_shared, index.tail_shared)):
        assert [x if x >= 4 else 0 for x in a] == list(b) and 0 < max(b) and min(x for x in a if x) < 4


def test_places_are_sorted_alike_packed_or_not():
    x = S.np.random.default_rng(1).integers(0, 1 << 40, 5000)
    for bits in (40, 64):
        by, values = S.sorted_places(x, bits)
        assert (x[by] == S.np.sort(x)).all() and (values == S.np.sort(x)).all()


def test_empty_table(spark):
    assert S.remove_repeats(frame(spark, [])).count() == 0


def test_numbers_of_a_piece_fit_in_a_cache():
    """Short texts are hashed in small pieces, whatever the batch, with the same regions as at once."""
    r = random.Random(5)
    texts = ["".join(r.choices("abcdef ", k=900)).encode() for _ in range(600)]
    raw, at = np.frombuffer(b"".join(texts), dtype=np.uint8), np.arange(601) * 900
    pieces = list(S._slices(raw, at, 400))
    assert max(len(part) for part, *_ in pieces) <= 1 << 17
    found = [int(h) for part, cuts, *_ in pieces for h in S.regions_of(part, cuts, 400)[4]]
    assert found == [int(h) for h in S.regions_of(raw, at, 400)[4]]


def test_suffixes_are_sorted_by_many_letters_first(monkeypatch):
    """Few different bytes take few bits each: repeats of 12 letters are told apart by the first sort alone."""
    r = random.Random(6)
    raw = np.frombuffer("".join(r.choices("ab", k=3000)).encode(), dtype=np.uint8)
    calls, sort = [], S.sorted_places
    monkeypatch.setattr(S, "sorted_places", lambda x, bits: calls.append(len(x)) or sort(x, bits))
    order, _ = S.RunLengthIndex._sorted(raw)
    text = raw.tobytes()
    assert list(order) == sorted(range(len(text)), key=lambda i: text[i:])
    assert len(calls) == 1 or sum(calls[1:]) < 50, calls
