"""Ranked lexical search with bag deduplication.

Documents are restricted to the words of the items; those that hold the same of these words equally often and have the
same length weight are one class. Classes are made by a hash of the bag and the bag itself, so that equal hashes alone
merge nothing. Each class is scored once, and only the best classes of an item are expanded to their documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import nptext
from textloom.llm.common import bounded_batches, discard, stored

#: Digits, letters and all bytes of non-ASCII characters.
IS_TERM = nptext.table_of([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Words and items of a block, about: what each task holds of the items.
BLOCK_WORDS, BLOCK_ITEMS = 32_768, 256
#: Numbers of the matrix of bags that is multiplied at once.
CELLS = 4_000_000
#: Rows of (item, class) that a task gathers before it keeps each item's best alone.
GATHERED = 200_000
_LAST = np.iinfo(np.int64).max
_BEST = "item_no int, h long, m long, least long, score long"


@dataclass(frozen=True)
class Vocabulary:
    """Different words, ordered by their hashes; ``raw[at[i]:at[i + 1]]`` are a word's bytes. Equal hashes are told apart."""

    hashes: np.ndarray
    raw: np.ndarray
    at: np.ndarray
    most_alike: int

    @staticmethod
    def of(words: list[bytes]) -> Vocabulary:
        raw, at = nptext.utf8(pa.array(words, pa.binary()))
        h = nptext.span_hash(nptext.prefix_hash(raw), at[:-1], at[1:]) if len(words) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        raw, at = nptext.utf8(pa.array([words[i] for i in order], pa.binary()))
        alike = np.unique(h, return_counts=True)[1]
        return Vocabulary(h[order], raw, at, int(alike.max(initial=0)))

    def find(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words raw[start:end] are in the vocabulary, their numbers), compared byte by byte."""
        h = nptext.span_hash(nptext.prefix_hash(raw), start, end)
        first = np.searchsorted(self.hashes, h)
        which, number = [], []
        for k in range(self.most_alike):
            place = np.minimum(first + k, len(self.hashes) - 1)
            i = np.flatnonzero((self.hashes[place] == h) & (first + k < len(self.hashes)))
            j = place[i]
            i, j = (x[(self.at[j + 1] - self.at[j]) == (end - start)[i]] for x in (i, j))
            length = (end - start)[i]
            ends = np.cumsum(length)
            step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
            same = raw[np.repeat(start[i], length) + step] == self.raw[np.repeat(self.at[j], length) + step]
            right = np.logical_and.reduceat(same, ends - length) if len(i) else np.zeros(0, dtype=bool)
            which.append(i[right])
            number.append(j[right])
        if not which:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(which), np.concatenate(number)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All (word, count) pairs of packed bags, as int64, and each row's first pair (n + 1 offsets)."""
    raw, at = nptext.utf8(column)
    return np.frombuffer(raw.tobytes(), dtype="<i4").astype(np.int64).reshape(-1, 2), at // 8


def _bag_rows(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = nptext.utf8(batch.column("text"))
            for lo, hi, part, where in nptext.chunks(raw, at):
                part = nptext.LOWER[part]
                start, end, first = nptext.words(part, where, IS_TERM)
                i, term = vocabulary.find(part, start, end)
                row = np.searchsorted(first, i, side="right") - 1
                keys, counts = np.unique(row * max(1, len(vocabulary.hashes)) + term, return_counts=True)
                row, term = np.divmod(keys, max(1, len(vocabulary.hashes)))
                pairs = np.stack([term, counts], axis=1).astype("<i4")
                offsets = np.searchsorted(row, np.arange(hi - lo + 1)) * 8
                bags = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(pairs.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), bags.cast(pa.binary())], ["doc_id", "n", "bag"])

    return run


def _df_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, dtype=np.int64)
        for batch in batches:
            n += np.bincount(_lists(batch.column("bag"))[0][:, 0], minlength=size)
        term = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n[term])], ["term", "n"])

    return run


def _score_rows(weights: np.ndarray, limit: int):
    """Scores classes against all items of a block (weights: words x items); each task returns each item's best."""
    exact = np.float64 if weights.sum(axis=0).max(initial=0) * 1_000_000 < 2**53 else np.int64

    def best(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts, axis=1)
        rows = rows[:, np.lexsort((rows[3], -rows[4], rows[0]))]
        return rows[:, np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0]) < limit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, floor = weights.astype(exact), np.ones(weights.shape[1], dtype=np.int64)
        kept, gathered = [np.zeros((5, 0), dtype=np.int64)], 0
        step = max(1, CELLS // max(1, len(table)))
        for batch in batches:
            pairs, at = _lists(batch.column("bag"))
            h, m, least = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "m", "least"))
            for lo in range(0, batch.num_rows, step):
                hi = min(lo + step, batch.num_rows)
                (term, tf), row = pairs[at[lo] : at[hi]].T, np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                bags = np.zeros((hi - lo, len(table)), dtype=exact)
                bags[row, term] = (1_000_000_000 * tf) // (1000 * tf + 20 * m[lo:hi][row])
                scores = (bags @ table).astype(np.int64)
                i, item = np.nonzero(scores >= floor)
                kept.append(np.stack([item, h[lo:hi][i], m[lo:hi][i], least[lo:hi][i], scores[i, item]]))
                gathered += len(i)
                if gathered > GATHERED:
                    kept = [best(kept)]
                    full = kept[0][:, np.bincount(kept[0][0], minlength=len(floor))[kept[0][0]] >= limit]
                    np.maximum.at(floor, full[0], 1)
                    least_of = np.full(len(floor), _LAST)
                    np.minimum.at(least_of, full[0], full[4])
                    floor, gathered = np.where(least_of < _LAST, least_of, floor), 0
        rows = best(kept)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x) for x in rows[1:])], ["item_no", "h", "m", "least", "score"])

    return run


def _block(docs: DataFrame, names: list[str | None], texts: list[str], limit: int) -> DataFrame:
    raw, at = nptext.utf8(pa.array(texts, pa.string()))
    raw = nptext.LOWER[raw]
    start, end, first = nptext.words(raw, at, IS_TERM)
    whole = raw.tobytes()
    words = [whole[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    vocabulary = Vocabulary.of(sorted(set(words)))
    spans = vocabulary.find(raw, start, end)
    number = np.zeros(len(words), dtype=np.int64)
    number[spans[0]] = spans[1]

    bags = stored(docs.mapInArrow(_bag_rows(vocabulary), "doc_id long, n long, bag binary").where("n > 0"))
    n_docs, n_terms = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = bags.mapInArrow(_df_rows(len(vocabulary.hashes)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    weight = np.zeros(len(vocabulary.hashes), dtype=np.int64)
    for term, n in zip(df.column("term").to_pylist(), df.column("n").to_pylist(), strict=True):
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
    weights = np.zeros((len(weight), len(texts)), dtype=np.int64)
    for i in range(len(texts)):
        own = number[first[i] : first[i + 1]]
        weights[own, i] = weight[own]

    m = F.expr(f"50L + (50L * n * {n_docs}L) div {max(1, n_terms)}L")
    with_class = bags.where(F.octet_length("bag") > 0).select("doc_id", m.alias("m"), F.xxhash64("bag").alias("h"), "bag")
    classes = with_class.groupBy("h", "m", "bag").agg(F.coalesce(F.min("doc_id"), F.lit(_LAST)).alias("least"))
    scored = classes.mapInArrow(_score_rows(weights, limit), _BEST)
    place = Window.partitionBy("item_no").orderBy(F.desc("score"), "least")
    winners = stored(scored.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit).drop("place"))

    # At most ``limit`` classes an item: their keys are small. A class gives its ``limit`` least ids, told apart by the bag itself.
    members = with_class.join(F.broadcast(winners.select("h", "m").distinct()), ["h", "m"])
    own_id = F.coalesce("doc_id", F.lit(_LAST))
    by_id = Window.partitionBy("h", "m", "bag").orderBy(own_id).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = members.withColumns({"nth": F.row_number().over(by_id), "least": F.first(own_id).over(by_id)}).where(F.col("nth") <= limit)
    found = winners.join(members.select("h", "m", "least", "doc_id"), ["h", "m", "least"])
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    items = pa.table({"item_no": pa.array(range(len(names)), pa.int32()), "item_id": pa.array(names, pa.int64())})
    out = stored(ranked.join(F.broadcast(docs.sparkSession.createDataFrame(items)), "item_no").select("item_id", "rank", "doc_id", "score"))
    discard(bags, winners)
    return out


def search(docs: DataFrame, items: DataFrame, limit: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``limit`` documents of docs (doc_id, text) with the highest scores above 0 for
    each row of items (item_id, text); other columns are ignored.

    Terms are runs of digits, letters and non-ASCII characters, A-Z lower-cased. The score sums, over an item's different
    terms, floor(1000 ln((2N + 2) / (2 df + 1))) times (10**9 tf) div (1000 tf + 20 m), where m is 50 + (50 n N) div L; N
    counts the documents with terms, L all terms, n a document's. Equal scores rank by ascending doc_id, null ids last.
    Null and empty texts have no terms: such documents are found by no item, such items find nothing. Repeated documents
    are ranked each on its own; repeated items are answered each. Empty tables give no rows.

    Items go in blocks of about BLOCK_WORDS words and BLOCK_ITEMS items (or one long item), which is all that is broadcast.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_blocks = max(-(-n // BLOCK_ITEMS), -(-n_bytes // (5 * BLOCK_WORDS)))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).toArrow()
        if len(mine):
            out = out.union(_block(docs, mine.column("item_id").to_pylist(), mine.column("text").to_pylist(), limit))
    return out
