import random
import re

from helpers import ODD, frame, low, words

from textloom.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, items, n):
    windows = {}
    for item, text in items:
        w = WORD.findall(low(text or ""))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item) if item is not None else "")
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        w, hit, names = WORD.findall(low(text or "")), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    names |= found
        out.append((str(doc), len(w), len(hit), sorted(names)))
    return sorted(out)


def fixture():
    r, vocabulary = random.Random(4), [*words(4, 60), "the", "of", "été"]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, text(r.randint(1, 40))) for i in range(30)] + [(30, None), (31, ""), (None, text(20)), (32, "the"), (0, text(15))]
    rows = [(i, text(r.randint(1, 60)) + ". " + (r.choice(items)[1] or "").upper() + "! " + text(5)) for i in range(20, 80)]
    return rows + ODD, items


def test_equals_brute_force(spark, monkeypatch):
    rows, items = fixture()
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, terms string")
    want = brute(rows, items, 13)
    for block in (1_000_000, 100):
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        got = D.find_items(frame(spark, rows), table).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids)) for r in got) == want


def test_shared_rows_and_empty_tables(spark):
    rows, items = fixture()
    table = spark.createDataFrame(items, "item_id long, text string")
    assert D.find_items(frame(spark, []), table).count() == 0
    none = D.find_items(frame(spark, rows), table.where("false")).collect()
    assert len(none) == len(rows) and all(r.n_hit == 0 and r.item_ids == [] for r in none)


def test_proximity(spark):
    docs = frame(spark, [(1, "x alpha y beta z"), (2, "alpha a b c d e f g h i j k beta"), (3, "beta alpha"), (4, None)])
    items = spark.createDataFrame([("i", "alpha q beta")], "item_id string, text string")
    assert sorted(map(tuple, D.find_near_items(docs, items, 3).collect())) == [(1, "i"), (3, "i")]


def test_very_long_texts(spark):
    r, vocabulary = random.Random(7), words(7, 300)
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(1, text(30)), (2, text(1000))]
    rows = [(1, text(30_000) + " " + items[0][1] + " " + text(10)), (2, items[1][1]), (3, text(20_000))]
    got = D.find_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, list(x.item_ids)) for x in got) == brute(rows, items, 13)
