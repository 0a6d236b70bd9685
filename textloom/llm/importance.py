"""Quality selection by importance resampling.

Texts are bags of hashed unigrams and bigrams. Two generative models, of target texts and of all raw texts, give each
document the log ratio of its likelihoods; with Gumbel noise added, the documents with the largest keys are a sample
without replacement in proportion to those ratios.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import nptext
from textloom.llm.common import cut, keyed, small_side

#: Buckets of hashed n-grams: the size of either model.
BUCKETS = 10_000
SMOOTHING = 1.0
TARGET_BROADCAST_ROWS = 1_000_000
#: ASCII letters and digits and all non-ASCII characters make words; each other visible ASCII character is left out.
IS_WORD = ~nptext.table_of([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Ways that a step of the selection splits a range of keys.
WAYS = 1 << 16


def bag(raw: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text and each text's first one (n + 1 offsets): its words, then its pairs of words."""
    w, first = nptext.word_hashes(nptext.LOWER[raw], at, IS_WORD)
    count = np.diff(first)
    pairs = np.maximum(count - 1, 0)
    begin = np.concatenate(([0], np.cumsum(count + pairs)))
    out = np.empty(begin[-1], dtype=np.uint64)
    place = np.arange(len(w)) + np.repeat(begin[:-1] - first[:-1], count)
    out[place] = w
    if len(w) > 1:
        left = np.ones(len(w), dtype=bool)
        left[first[1:][first[1:] > first[:-1]] - 1] = False
        left = np.flatnonzero(left)
        row = np.searchsorted(first, left, side="right") - 1
        out[begin[row] + count[row] + left - first[row]] = nptext.mix(w[left] * np.uint64(nptext.BASE) + w[left + 1])
    return (out % np.uint64(buckets)).astype(np.int64), begin


def _count_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, part, cuts in nptext.chunks(*nptext.utf8(batch.column("text"))):
                b, begin = bag(part, cuts, buckets)
                total[0] += np.bincount(b, minlength=buckets)
                total[1] += np.bincount(b[np.repeat(target[lo:hi], np.diff(begin))], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total[0]), pa.array(total[1])], ["bucket", "raw", "target"])

    return run


def _score_rows(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = nptext.utf8(batch.column("text"))
            for lo, hi, part, cuts in nptext.chunks(raw, at):
                b, begin = bag(part, cuts, len(ratio))
                sums = np.concatenate(([0.0], np.cumsum(ratio[b])))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "k_id", "k_text")), pa.array(np.diff(begin)), pa.array(sums[begin[1:]] - sums[begin[:-1]])], ["doc_id", "k_id", "k_text", "n_grams", "log_ratio"])

    return run


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise that depends on the row's key alone."""
    u = (F.pmod(F.xxhash64("k_id", "k_text", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def top_threshold(keys: DataFrame, column: str, k: int, low: float, high: float) -> float:
    """The k-th largest value of a column of doubles between low and high, by histograms of fixed size: no sort, no task
    with all rows. Minus infinity if there are no more than k."""
    inside, above = keys.where(F.col(column).isNotNull()).select(column), 0
    while True:
        step = (high - low) / WAYS
        if not step > 0 or low + step <= low:
            return low
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)), F.lit(WAYS - 1)).cast("long")
        rows = inside.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).collect()
        for r in sorted(rows, key=lambda r: -r["place"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        else:
            return float("-inf")
        if r["least"] == r["most"] or above + r["n"] == k:
            return r["least"]
        low, high = r["least"], r["most"]
        inside = inside.where((F.col(column) >= low) & (F.col(column) <= high))


def resample(docs: DataFrame, target_ids: DataFrame, share: float = 0.5, buckets: int = BUCKETS, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, n_grams, log_ratio, key (log_ratio plus Gumbel noise), selected.

    docs: doc_id, text; target_ids: doc_id of the target texts; other columns are ignored. Both models count all their
    texts. selected: the ``share`` of the rows that have n-grams with the largest keys (rounded up; rows whose key equals
    the last one's are selected too, repeated rows alike). A null, empty or wordless text has no n-grams, log_ratio 0, a
    null key and is not selected. Without target texts all ratios are near 0, and the noise alone decides. An empty table
    gives no rows. Texts of any length count by the sum over their n-grams.
    """
    docs = keyed(docs)
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("target")).where("doc_id is not null").distinct()
    wanted = small_side(cut(wanted), TARGET_BROADCAST_ROWS)
    marked = docs.select("doc_id", "text").join(wanted, "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = marked.mapInArrow(_count_rows(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = counts.column("bucket").to_numpy()
    raw[at], target[at] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()
    ratio = np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * buckets)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * buckets))
    scored = docs.mapInArrow(_score_rows(ratio), "doc_id long, k_id long, k_text long, n_grams long, log_ratio double")
    scored = cut(scored.withColumn("key", F.when(F.col("n_grams") > 0, F.col("log_ratio") + gumbel(seed))))
    size = scored.agg(F.count("key").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).first()
    k = int(np.ceil(size["n"] * share))
    last = top_threshold(scored, "key", k, size["low"], size["high"]) if k else float("inf")
    return scored.select("doc_id", "n_grams", "log_ratio", "key", F.coalesce(F.col("key") >= last, F.lit(False)).alias("selected"))
