"""Near duplicates by circulant MinHash.

One permutation (sigma) places a shingle in a universe of 2**32 places; one more (pi), circularly shifted by k, gives the
k-th signature coordinate: min over the shingles of pi(sigma(s) + k). So two permutations serve all coordinates. Bands of
coordinates make candidate buckets; links are confirmed by the exact Jaccard similarity of the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import nptext
from textloom.llm.common import KEY, discard, keyed, small_side, stored
from textloom.llm.linking import central_members, link_buckets, shared_buckets

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, *range(0x09, 0x0E))
IS_WORD = ~nptext.table_of(SPACES)
ROWS, BANDS = 5, 32
#: Finer bands for the few texts whose buckets hold different groups: 256, of so many rows that a pair at the similarity
#: is missed with a chance of about 1e-7, while pairs well below it seldom meet.
FINE_BANDS, FINE_MEET = 256, 0.061
#: Longs of a parity sketch: each element of a set flips one of its bits, so that two sketches differ in no more bits than
#: the sets in elements. Pairs that differ in too many bits can't be links.
SKETCH_LONGS = 32
SEARCH_BROADCAST_ROWS = 1_000_000


def shingle_hashes(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text and each text's first shingle (n + 1 offsets). A text of fewer words than
    ``size``, but not none, has the whole sequence as its one shingle."""
    w, first = nptext.word_hashes(nptext.LOWER[raw], at, IS_WORD)
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(n)))
    if not begin[-1]:
        return np.zeros(0, dtype=np.uint64), begin
    start = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
    width = np.repeat(np.minimum(count, size), n)
    out = width.astype(np.uint64)
    for j in range(size):
        here = width > j
        out[here] = nptext.mix(out[here] * np.uint64(nptext.BASE) + w[start[here] + j])
    return out, begin


def distinct(h: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    return [np.unique(h[begin[i] : begin[i + 1]]) for i in range(len(begin) - 1)]


def signatures(h: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket for each text with shingles and band."""
    full = np.flatnonzero(np.diff(begin))
    place = (nptext.mix(h + np.uint64(0x51ED270B)) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(begin) - 1, bands), dtype=np.uint64)
    for band in range(bands if len(full) else 0):
        key = np.full(len(full), band, dtype=np.uint64)
        for k in range(band * rows, band * rows + rows):
            x = place + np.uint32(k)
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE35)
            x ^= x >> np.uint32(16)
            least = np.minimum.reduceat(x, begin[full]).astype(np.uint64)
            key = nptext.mix(key * np.uint64(nptext.BASE) + least)
        out[full, band] = key
    return out


def parities(sets: list[np.ndarray], longs: int) -> np.ndarray:
    """The parity sketch of each set of distinct hashes."""
    out = np.zeros((len(sets), longs), dtype=np.uint64)
    for i, s in enumerate(sets):
        odd = np.bincount((nptext.mix(s) % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
        out[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return out


def linked(n: Column, apart: Column, similarity: int) -> Column:
    """Whether sets of n elements in sum that differ in ``apart`` elements have the similarity (hundredths), exactly."""
    return apart * (100 + similarity) <= n * (100 - similarity)


def _signed_rows(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = nptext.utf8(batch.column("text"))
            for lo, hi, part, cuts in nptext.chunks(raw, at):
                h, begin = shingle_hashes(part, cuts, size)
                sets = distinct(h, begin)
                node = np.array([len(s) * nptext.BASE + int(nptext.mix(s).sum(dtype=np.uint64)) & (2**64 - 1) for s in sets], dtype=np.uint64)
                keys = signatures(h, begin, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(nptext.signed(keys.reshape(-1))))
                piece = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("k_id"), piece.column("k_text"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nptext.signed(nptext.mix(node))), lists],
                    ["doc_id", *KEY, "n_shingles", "node", "bands"],
                )

    return run


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, _, part, cuts in nptext.chunks(*nptext.utf8(column)):
        yield from distinct(*shingle_hashes(part, cuts, size))


def _pair_rows(size: int, similarity: int):
    """The pairs (a, b) of texts whose full sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_sets(batch.column("ta"), size), _sets(batch.column("tb"), size), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _apart_rows(size: int):
    """What the sets of a text and its bucket's leader do not share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart, n, lead_n = [], [], []
            for x, y in zip(_sets(batch.column("text"), size), _sets(batch.column("lead_text"), size), strict=True):
                apart.append(nptext.signed(np.setxor1d(x, y, assume_unique=True)))
                n.append(len(x))
                lead_n.append(len(y))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, apart)]).astype(np.int32)), pa.array(np.concatenate([*apart, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lead", "lead_root", "id", "root")), pa.array(n, pa.int64()), pa.array(lead_n, pa.int64()), lists], ["lead", "lead_root", "id", "root", "n", "lead_n", "apart"])

    return run


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a table of 64-bit words."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(nptext.signed(x.reshape(-1))))


def _fine_rows(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part, cuts in nptext.chunks(*nptext.utf8(batch.column("text"))):
                sets = distinct(*shingle_hashes(part, cuts, size))
                begin = np.cumsum([0, *map(len, sets)])
                keys, sketch = signatures(np.concatenate(sets), begin, bands, rows), parities(sets, SKETCH_LONGS)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), _lists(keys), _lists(sketch)], ["node", "n", "bands", "sketch"])

    return run


def pairs_near_leads(apart: DataFrame, similarity: int) -> DataFrame:
    """Distinct pairs (a, b) of texts that share a leader, in different groups, among which are all links.

    apart: (lead, lead_root, id, root, n, lead_n, apart): groups so far, set sizes, and the elements in which a text's set
    differs from its leader's.
    Two sets differ in as many elements as their lists do, so a link of lists of x and y elements has at least
    o = (x + y - most) / 2 of them in common, ``most`` being what two sets of their sizes may differ in. Texts linked to
    the leader are in one group with it. Any other link has an end whose list is longer than that allows, so the other
    end shares one of its first elements with it, rarest first: a prefix join, bounded by place and by length.
    Elements that only one group has, or only texts linked to the leader, make no such pair: they come before all others
    and are left out, so that a large group costs what its members differ in from other groups alone.
    """
    near = apart.withColumns({"d": F.size("apart").cast("long")})
    near = near.withColumn("linked", linked(F.col("n") + F.col("lead_n"), F.col("d"), similarity))
    rows = near.select("lead", "id", "root", "n", "lead_n", "d", "linked", F.explode("apart").alias("e"))
    counts = rows.groupBy("lead", "e").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_or(~F.col("linked")).alias("far"))
    placed = rows.join(counts.where("lo <> hi and far").select("lead", "e", "c"), ["lead", "e"])
    own = Window.partitionBy("lead", "id")
    at = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "e")) - 1
    placed = stored(placed.select("lead", "e", "id", "root", "n", "lead_n", "d", "linked", at.cast("long").alias("at")))
    more, less = F.lit(100 + similarity), F.lit(100 - similarity)
    probe = placed.where(~F.col("linked")).select("lead", "e", *[F.col(c).alias(f"p_{c}") for c in ("id", "root", "n", "d", "at")])
    index = placed.where(more * (2 * F.col("at") - F.col("d")) < less * (F.col("n") - F.col("lead_n")))
    both = F.col("n") + F.col("p_n")
    fits = (more * (2 * F.col("at") - F.col("d") + F.col("p_d")) <= less * both) & (more * (2 * F.col("p_at") - F.col("p_d") + F.col("d")) <= less * both)
    other = (F.col("root") != F.col("p_root")) & (F.col("linked") | (F.col("id") < F.col("p_id")))
    far = index.join(probe, ["lead", "e"]).where(fits & other).select(F.col("id").alias("x"), F.col("p_id").alias("y"))
    direct = near.where(F.col("linked") & (F.col("root") != F.col("lead_root"))).select(F.col("id").alias("x"), F.col("lead").alias("y"))
    return far.union(direct).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, k_id, k_text (see common.keyed), n_shingles, component_id, kept, and group: a
    number that the rows of a group share, null for rows that are alone.

    docs: doc_id, text; other columns are ignored. Words are runs of non-space bytes with A-Z lower-cased; two texts are
    linked if the Jaccard similarity of their sets of ``shingle`` words is at least ``similarity`` hundredths.
    A null or empty text, or one without words, has n_shingles 0 and is linked with nothing. component_id is the least
    doc_id of the group, kept tells whether the row has it; a row without links is its own group, and a null doc_id is
    kept, with component_id null unless its group has another. Repeated rows are alike. An empty table gives none.

    Texts with equal sets are one node from the start, so that copies cost nothing further. The 160 coordinates in 32
    bands of 5 miss a pair at 0.85 with a chance of 7e-9 and at 0.8 with 3e-6. Sets are of 64-bit shingle hashes.
    """
    docs = keyed(docs)
    signed = stored(docs.mapInArrow(_signed_rows(shingle, bands, rows), "doc_id long, k_id long, k_text long, n_shingles long, node long, bands array<long>"))
    nodes = stored(signed.where("n_shingles > 0").select(*KEY, "node", "bands").dropDuplicates(["node"]))
    members = shared_buckets(nodes.select(F.explode("bands").alias("bucket"), F.col("node").alias("id")))
    wanted = stored(nodes.select(*KEY, "node").join(members.select(F.col("id").alias("node")).distinct(), "node"))
    texts = stored(docs.join(small_side(wanted, SEARCH_BROADCAST_ROWS), KEY).select("node", "text"))
    if texts.count() > wanted.count():  # repeated rows
        again, texts = texts, stored(texts.dropDuplicates(["node"]))
        discard(again)
    discard(nodes, wanted)

    def with_text(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.join(texts.select(F.col("node").alias(column), F.col("text").alias(name)), column)

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = with_text(with_text(pairs, "a", "ta"), "b", "tb")
        return pairs.select("a", "b", "ta", "tb").mapInArrow(_pair_rows(shingle, similarity), "a long, b long")

    def refine(ids: DataFrame) -> tuple[DataFrame, Column]:
        own = texts.join(ids.withColumnRenamed("id", "node"), "node").select("node", "text")
        fine_rows = max(1, int(math.log(FINE_MEET) / math.log(similarity / 100)))
        own = stored(own.mapInArrow(_fine_rows(shingle, FINE_BANDS, fine_rows), "node long, n long, bands array<long>, sketch array<long>"))
        fine = shared_buckets(own.select(F.explode("bands").alias("bucket"), F.col("node").alias("id")))
        sketches = own.select(F.col("node").alias("id"), "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_LONGS)])
        bits = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"lead_s{i}"))) for i in range(1, SKETCH_LONGS)), F.bit_count(F.col("s0").bitwiseXOR(F.col("lead_s0"))))
        return fine.join(sketches, "id"), linked(F.col("n") + F.col("lead_n"), bits.cast("long"), similarity)

    def finish(rest: DataFrame) -> DataFrame:
        rest = rest.select("bucket", "id", "root")
        leads = central_members(rest.select("bucket", "id")).join(rest.select("bucket", F.col("id").alias("lead"), F.col("root").alias("lead_root")), ["bucket", "lead"])
        near = rest.join(leads, "bucket").select("lead", "lead_root", "id", "root").distinct()
        near = with_text(with_text(near, "lead", "lead_text"), "id", "text").select("lead", "lead_root", "id", "root", "text", "lead_text")
        apart = stored(near.mapInArrow(_apart_rows(shingle), "lead long, lead_root long, id long, root long, n long, lead_n long, apart array<long>"))
        return pairs_near_leads(apart, similarity)

    roots = link_buckets(members, confirm, refine=refine, finish=finish)
    # Most documents are alone; the component's least id is joined to those that aren't.
    counted = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named = counted.join(roots.withColumnRenamed("v", "node"), "node", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "node"))
    named = stored(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    member = stored(named.join(least, "root").select("node", "component_id", F.col("root").alias("group")))
    out = signed.select("doc_id", *KEY, "n_shingles", "node").join(small_side(member, SEARCH_BROADCAST_ROWS), "node", "left")
    out = out.withColumn("group", F.when(F.col("n_shingles") > 0, F.col("group")))
    out = out.withColumn("component_id", F.when(F.col("group").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", *KEY, "n_shingles", "component_id", "group", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull()).alias("kept"))
