"""Benchmark decontamination by a distributed positional inverted index.

The index has a posting (term, document, positions) of every test term that some window looks up. A window of test words
is sought by its two rarest terms, by their counts over all documents: their position lists, each shifted by the term's
offset in the item, are intersected, and what is left is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import nptext
from textloom.llm.common import KEY, cut, keyed, small_side

#: Bytes that end a word once A-Z are lower-cased; all others, those of non-ASCII letters too, belong to words.
IS_WORD = ~nptext.table_of([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Test words that are looked up at once; larger test sets are worked off in blocks, each against all documents.
BLOCK_WORDS = 1_000_000
CANDIDATE_BROADCAST_ROWS = 200_000


def _hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return nptext.word_hashes(nptext.LOWER[raw], at, IS_WORD)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = nptext.utf8(batch.column("text"))
        h, first = _hashes(raw, at)
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(nptext.signed(h)))
        yield pa.RecordBatch.from_arrays([batch.column("item"), lists], ["item", "terms"])


def _among(sought: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are in the sorted array, and each one's place there."""
    place = np.minimum(np.searchsorted(sought, h), len(sought) - 1)
    return sought[place] == h, place


def _count_rows(sought: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sought), dtype=np.int64)
        for batch in batches:
            for _, _, part, cuts in nptext.chunks(*nptext.utf8(batch.column("text"))):
                found, place = _among(sought, _hashes(part, cuts)[0])
                total += np.bincount(place[found], minlength=len(sought))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(nptext.signed(sought[some])), pa.array(total[some])], ["term", "n"])

    return run


def _posting_rows(sought: np.ndarray):
    """One row per document: its word count and its postings of the sought terms, positions ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = nptext.utf8(batch.column("text"))
            for lo, hi, part, cuts in nptext.chunks(raw, at):
                h, first = _hashes(part, cuts)
                found, place = _among(sought, h) if len(sought) else (np.zeros(len(h), dtype=bool), h)
                word = np.flatnonzero(found)
                row = np.searchsorted(first, word, side="right") - 1
                order = np.lexsort((word, place[word], row))
                word, row = word[order], row[order]
                term = h[word]
                new = np.ones(len(word), dtype=bool)
                new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
                start = np.flatnonzero(new)
                positions = pa.ListArray.from_arrays(pa.array(np.append(start, len(word)).astype(np.int32)), pa.array((word - first[row]).astype(np.int32)))
                postings = pa.StructArray.from_arrays([pa.array(nptext.signed(term[start])), positions], ["term", "positions"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[start], np.arange(hi - lo + 1)).astype(np.int32)), postings)
                piece = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("k_id"), piece.column("k_text"), pa.array(np.diff(first)), lists], ["doc_id", *KEY, "n_words", "postings"])

    return run


def _confirmed_rows(terms: list[np.ndarray], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = nptext.utf8(batch.column("text"))
            for lo, hi, part, cuts in nptext.chunks(raw, at):
                h, first = _hashes(part, cuts)
                out = []
                for row in range(hi - lo):
                    words, hits = h[first[row] : first[row + 1]], []
                    for c in batch.column("seeds")[lo + row].as_py():
                        sought = terms[c["item_no"]]
                        n = min(window, len(sought))
                        for start in c["starts"]:
                            p = c["shift"] + start
                            if p >= 0 and np.array_equal(words[p : p + n], sought[start : start + n]):
                                hits.append((c["item_no"], p, p + n))
                    out.append([{"item_no": i, "start": s, "end": e} for i, s, e in hits])
                piece = batch.slice(lo, hi - lo)
                kind = pa.list_(pa.struct([("item_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([piece.column("k_id"), piece.column("k_text"), pa.array(out, kind)], [*KEY, "hits"])

    return run


def rarest_terms(terms: list[np.ndarray], counts: dict[int, int], window: int) -> list[tuple[int, int, int, int]]:
    """(item number, window start, offsets in the item of the window's rarest and second rarest word), ties to the left."""
    out = []
    for i, t in enumerate(terms):
        n = np.array([counts.get(int(x), 0) for x in t], dtype=np.int64)
        for start in range(max(1, len(t) - window + 1) if len(t) else 0):
            order = np.argsort(n[start : start + window], kind="stable")
            out.append((i, start, start + int(order[0]), start + int(order[min(1, len(order) - 1)])))
    return out


def _block_hits(docs: DataFrame, index: DataFrame, terms: list[np.ndarray], seeks: list[tuple[int, int, int, int]], window: int) -> DataFrame:
    """(k_id, k_text, hits) of the documents in which windows of one block occur."""
    spark = docs.sparkSession
    offsets = sorted({(i, p) for i, _, a, b in seeks for p in (a, b)})
    anchors = pa.table({"term": pa.array([int(nptext.signed(terms[i])[p]) for i, p in offsets], pa.int64()), "item_no": pa.array([i for i, _ in offsets], pa.int32()), "offset": pa.array([p for _, p in offsets], pa.int32())})
    by_item: dict[int, list[dict]] = {}
    for i, start, a, b in seeks:
        by_item.setdefault(i, []).append({"start": start, "a": a, "b": b})
    kind = pa.list_(pa.struct([("start", pa.int32()), ("a", pa.int32()), ("b", pa.int32())]))
    windows = pa.table({"item_no": pa.array(list(by_item), pa.int32()), "windows": pa.array(list(by_item.values()), kind)})
    lists = index.select(*KEY, F.explode("postings").alias("p")).select(*KEY, "p.term", "p.positions")
    lists = lists.join(F.broadcast(spark.createDataFrame(anchors)), "term")
    shifted = lists.select(*KEY, "item_no", "offset", F.explode("positions").alias("at")).withColumn("shift", F.col("at") - F.col("offset"))
    both = shifted.groupBy(*KEY, "item_no", "shift").agg(F.collect_set("offset").alias("found"))
    both = both.join(F.broadcast(spark.createDataFrame(windows)), "item_no")
    met = F.filter("windows", lambda w: F.array_contains("found", w["a"]) & F.array_contains("found", w["b"]))
    seeds = both.select(*KEY, "item_no", "shift", F.transform(met, lambda w: w["start"]).alias("starts")).where(F.size("starts") > 0)
    seeds = cut(seeds.groupBy(*KEY).agg(F.collect_list(F.struct("item_no", "shift", "starts")).alias("seeds")))
    texts = docs.select(*KEY, "text").join(small_side(seeds, CANDIDATE_BROADCAST_ROWS), KEY)
    hits = texts.mapInArrow(_confirmed_rows(terms, window), "k_id long, k_text long, hits array<struct<item_no:int,start:bigint,end:bigint>>")
    return hits.where(F.size("hits") > 0).dropDuplicates(KEY)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, terms) of items (item_id, text): word hashes in order. Null ids and texts count as empty."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(_item_rows, "item string, terms array<long>").where(F.size("terms") > 0)


def find_items(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """One row per row of docs: doc_id, k_id, k_text (see common.keyed), n_words, hits, n_hit, item_ids.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Words are runs of letters, digits and non-ASCII
    characters, A-Z lower-cased. A window is ``window`` consecutive words of an item; an item of fewer words, but not
    none, is one window. hits: (item_id, start, end) in words of the document, one for each window that occurs; n_hit:
    words that lie in hits; item_ids: the items that have some, sorted as strings. A null or empty text has no words and
    no hits; a null item id counts as the empty string; repeated items and documents are each judged alike.
    Empty tables give no hits or no rows. Words are compared by 64-bit hashes.

    Only the test set is broadcast, in blocks of at most BLOCK_WORDS words (or one item).
    """
    docs = keyed(docs)
    sought = cut(item_terms(items))
    n_blocks = -(-int(sought.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // BLOCK_WORDS)
    found, stats = None, None
    for block in range(n_blocks):
        mine = sought.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).toArrow()
        if not len(mine):
            continue
        names = mine.column("item").to_pylist()
        terms = [np.array(t, dtype=np.int64).view(np.uint64) for t in mine.column("terms").to_pylist()]
        vocabulary = np.unique(np.concatenate(terms))
        counts = docs.select("text").mapInArrow(_count_rows(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        counts = dict(zip(np.array(counts.column("term"), dtype=np.int64).view(np.uint64).tolist(), counts.column("n").to_pylist(), strict=True))
        seeks = rarest_terms(terms, counts, window)
        looked_up = np.unique(np.array([terms[i][p] for i, _, a, b in seeks for p in (a, b)], dtype=np.uint64))
        index = cut(docs.mapInArrow(_posting_rows(looked_up), "doc_id long, k_id long, k_text long, n_words long, postings array<struct<term:bigint,positions:array<int>>>"))
        stats = index.select("doc_id", *KEY, "n_words") if stats is None else stats
        hits = _block_hits(docs, index, terms, seeks, window)
        ids = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"item_no": pa.array(range(len(names)), pa.int32()), "item_id": names})))
        hits = hits.select(*KEY, F.explode("hits").alias("h")).select(*KEY, "h.item_no", "h.start", "h.end").join(ids, "item_no")
        hits = hits.select(*KEY, F.struct("item_id", "start", "end").alias("hit"))
        found = hits if found is None else found.union(hits)
    if stats is None:
        none = "doc_id long, k_id long, k_text long, n_words long, postings array<struct<term:bigint,positions:array<int>>>"
        stats = docs.mapInArrow(_posting_rows(np.zeros(0, dtype=np.uint64)), none).select("doc_id", *KEY, "n_words")
    empty = F.expr("cast(array() as array<struct<item_id:string,start:bigint,end:bigint>>)")
    if found is None:
        out = stats.withColumn("hits", empty)
    else:
        found = found.groupBy(*KEY).agg(F.array_sort(F.collect_list("hit")).alias("hits"))
        out = stats.join(found, KEY, "left").withColumn("hits", F.coalesce("hits", empty))
    spans = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("s"), h["end"].alias("e"))))
    reach = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(a["to"], x["s"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
        lambda a: a["n"],
    )
    return out.withColumns({"n_hit": reach, "item_ids": F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))})


def is_contaminated(n_hit, n_words):
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def find_near_items(docs: DataFrame, items: DataFrame, slop: int = 5) -> DataFrame:
    """Proximity matches: (doc_id, item_id) of documents that have the two rarest words of an item, of those that occur
    and by their counts over all documents, at a distance that differs from that in the item by at most ``slop`` words. Items of one word need that
    word. Inputs are as in find_items; documents without a match give no rows, and repeated rows are listed once.

    The test set is broadcast in blocks as in find_items; shifted positions are joined within stretches of slop + 1 words.
    """
    docs = keyed(docs)
    sought = cut(item_terms(items))
    n_blocks = -(-int(sought.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // BLOCK_WORDS)
    out = docs.select("doc_id", F.lit("").alias("item_id")).limit(0)
    for block in range(n_blocks):
        mine = sought.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).toArrow()
        if not len(mine):
            continue
        terms = [np.array(t, dtype=np.int64).view(np.uint64) for t in mine.column("terms").to_pylist()]
        vocabulary = np.unique(np.concatenate(terms))
        counts = docs.select("text").mapInArrow(_count_rows(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        counts = dict(zip(np.array(counts.column("term"), dtype=np.int64).view(np.uint64).tolist(), counts.column("n").to_pylist(), strict=True))
        rows = []
        for name, t in zip(mine.column("item").to_pylist(), terms, strict=True):
            order = sorted(range(len(t)), key=lambda p: (counts.get(int(t[p])) or float("inf"), p))
            rows += [(int(nptext.signed(t)[p]), name, int(p), first) for p, first in ((order[0], True), (order[min(1, len(t) - 1)], False))]
        anchors = pa.table(dict(zip(("term", "item_id", "at", "first"), zip(*rows, strict=True), strict=True)))
        looked_up = np.unique(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))
        index = docs.mapInArrow(_posting_rows(looked_up), "doc_id long, k_id long, k_text long, n_words long, postings array<struct<term:bigint,positions:array<int>>>")
        lists = index.select("doc_id", *KEY, F.explode("postings").alias("p")).join(F.broadcast(docs.sparkSession.createDataFrame(anchors)), F.col("p.term") == F.col("term"))
        shifted = lists.select("doc_id", *KEY, "item_id", "first", F.explode("p.positions").alias("place"), "at").withColumn("shift", F.col("place") - F.col("at")).drop("place", "at")
        part = F.floor(F.col("shift") / (slop + 1))
        a = shifted.where("first").select("doc_id", *KEY, "item_id", "shift", part.alias("part"))
        b = shifted.where(~F.col("first")).select(*KEY, "item_id", F.col("shift").alias("other"), F.explode(F.array(part - 1, part, part + 1)).alias("part"))
        near = a.join(b, [*KEY, "item_id", "part"]).where(F.abs(F.col("shift") - F.col("other")) <= slop)
        out = out.union(near.select("doc_id", "item_id"))
    return out.distinct()
