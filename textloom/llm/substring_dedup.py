"""Repeated substrings by run-length indexes.

A window of ``length`` bytes that occurs twice has the same least k-gram at the same place in both copies. So windows are
gathered in regions (consecutive windows with one anchor, their least k-gram), and only regions with equal anchors are
compared. Regions that recur whole are settled by counting. The rest go, shard by shard, into a run-length index: the
runs of the Burrows-Wheeler transform of the shard's regions, with the suffix positions at both ends of each run, the
neighbours in suffix order and the lengths they share there. From these samples come, for every position that is
streamed, its neighbours in suffix order and so its matching statistic: the longest string there that occurs elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import nptext
from textloom.llm.common import KEY, discard, keyed, small_side, stored
from textloom.llm.near_dedup import IS_WORD

K = 32
#: Bits of a window's place in a slice; texts are read in slices of less than 2**24 bytes.
PLACE_BITS = 24
SLICE_BYTES = 1 << 23
#: A second base for hashes of 128 bits.
BASE2 = 0xD6E8FEB86659FD93
INVERSE2 = pow(BASE2, -1, 1 << 64)
#: Bytes of regions in a shard and of texts hashed at a time: so few that the arrays of numbers for each byte lie in a cache.
SHARD_BYTES, HASHED_BYTES = 1 << 18, 1 << 17
#: An anchor with more different regions than this is split by counting, see _split_hot; no task gets them all.
HOT_REGIONS = 2000
MARK_BROADCAST_ROWS = 200_000
#: Words of a passage, more than fifty, and of the grams that anchor its windows.
PASSAGE_WORDS, PASSAGE_GRAM = 51, 8
PASSAGE_BROADCAST_ROWS = 1_000_000


class Spans:
    """128-bit hashes of spans of some bytes."""

    def __init__(self, raw: np.ndarray):
        self.n, self.a = len(raw), nptext.prefix_hash(raw)
        self.b = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * nptext.powers(BASE2, self.n), out=self.b[1:])

    def first(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return nptext.span_hash(self.a, start, end)

    def second(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return nptext.mix((self.b[end] - self.b[start]) * nptext.powers(INVERSE2, self.n + 1)[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``; len(x) - width + 1 of them."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def regions_of(raw: np.ndarray, at: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, ...]:
    """Text number, first and last window start (in raw), anchor and two hashes of each region of some texts."""
    k = min(k, length)
    if len(raw) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    spans = Spans(raw)
    i = np.arange(len(raw) - k + 1)
    grams = spans.first(i, i + k)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min((grams & ~low) | i.astype(np.uint64), length - k + 1)
    anchor = (least & low).astype(np.int64)
    window = np.arange(len(least))
    row = np.searchsorted(at, window, side="right") - 1
    window = window[window + length <= at[row + 1]]
    row, anchor = row[window], anchor[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(window)) - 1
    start, end = window[s], window[e] if len(window) else window
    return row[s], start, end, grams[anchor[s]], spans.first(start, end + length), spans.second(start, end + length)


def _slices(raw: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, row numbers and places in the text of runs of texts; a very long text comes in slices that overlap
    by length - 1 bytes, so that each window starts in just one."""
    for lo, hi, part, cuts in nptext.chunks(raw, at, min(HASHED_BYTES, nptext.CHUNK_BYTES)):
        if len(part) <= SLICE_BYTES:
            yield part, cuts, np.arange(lo, hi), np.zeros(hi - lo, dtype=np.int64)
        else:
            for s in range(0, len(part), SLICE_BYTES):
                piece = part[s : s + SLICE_BYTES + length - 1]
                yield piece, np.array([0, len(piece)]), np.array([lo]), np.array([s])


def _region_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = nptext.utf8(batch.column("text"))
            for part, cuts, rows, places in _slices(raw, at, length):
                row, s, e, anchor, h1, h2 = regions_of(part, cuts, length)
                shift = places[row] - cuts[row] if len(row) else row
                take = pa.array(rows[row] if len(row) else row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k_id").take(take), batch.column("k_text").take(take), *(pa.array(x) for x in (s + shift, e + shift, nptext.signed(anchor), nptext.signed(h1), nptext.signed(h2)))],
                    [*KEY, "s", "e", "anchor", "h1", "h2"],
                )

    return run


def _cut_rows(length: int):
    """The bytes of the wanted regions of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = nptext.utf8(batch.column("text"))
            for row in range(len(at) - 1):
                wanted = batch.column("wanted")[row].as_py()
                own = raw[at[row] : at[row + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(k)[row].as_py()] * len(wanted), pa.int64()) for k in KEY]
                    + [pa.array([w[k] for w in wanted], pa.int64()) for k in ("s", "e", "anchor", "n", "many")]
                    + [pa.array([own[w["s"] : w["e"] + length].tobytes() for w in wanted], pa.binary())],
                    [*KEY, "s", "e", "anchor", "n", "many", "bytes"],
                )

    return run


def sorted_places(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the values, of so many bits, stand in rising order, and the values in it. Where value and place fit in 64 bits
    they are sorted as one number, which is several times as fast as sorting places by values."""
    place = len(x).bit_length()
    if bits + place > 64:
        by = np.argsort(x)
        return by, x[by]
    both = (x.astype(np.uint64) << np.uint64(place)) | np.arange(len(x), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << place) - 1)).astype(np.int64), both >> np.uint64(place)


class RunLengthIndex:
    """The runs of the Burrows-Wheeler transform of some bytes, with samples at their ends. ``longest``: no string that
    occurs twice has more bytes. ``least``: shorter matches aren't asked for, and may be given as none."""

    def __init__(self, raw: np.ndarray, longest: int = 1 << 13, least: int = 1):
        n, self.longest, self.least = len(raw), longest, least
        order, rank = self._sorted(raw)
        bwt = np.empty(n, dtype=np.int16)
        bwt[:] = raw[order - 1]
        bwt[order == 0] = -1
        heads = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.runs = bwt[np.append(0, heads)]
        self.run_starts = np.append(0, heads)
        before, after = order[heads - 1], order[heads]
        shared = self._shared(raw, before, after)
        # The first suffix has no neighbour before it and the last none after it: samples that share nothing.
        after, at_head = np.append(after, order[0]), np.append(shared, 0)
        before, at_tail = np.append(before, order[-1]), np.append(shared, 0)
        by = np.argsort(after)
        self.head, self.head_shared = after[by], at_head[by]
        by = np.argsort(before)
        self.tail, self.tail_shared = before[by], at_tail[by]

    @staticmethod
    def _sorted(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        # Bytes are numbered from 1 among those that are there: more of them fit in 64 bits beside a place.
        code = np.cumsum(np.bincount(raw, minlength=256) > 0).astype(np.uint64)
        bits = int(code[-1]).bit_length() or 1
        h = max(1, (64 - n.bit_length()) // bits)
        padded = np.concatenate((code[raw], np.zeros(h, dtype=np.uint64)))
        key = np.zeros(n, dtype=np.uint64)
        for j in range(h):
            key = (key << np.uint64(bits)) | padded[j : j + n]
        order, sorted_key = sorted_places(key, bits * h)
        new = np.ones(n, dtype=bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        while True:
            # Only places that share their rank with a neighbour are sorted again, by the rank h further on.
            tied = ~new
            tied[:-1] |= ~new[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            own = order[at]
            ahead = own + h
            later = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
            both = rank[own].astype(np.int64) * (n + 1) + later + 1
            by, both = sorted_places(both, 2 * (n + 1).bit_length())
            own = own[by]
            order[at] = own
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = both[1:] != both[:-1]
            new[at] = fresh
            rank[own] = np.maximum.accumulate(np.where(fresh, at, 0))
            h *= 2
        return order, rank

    def _shared(self, raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common, by bisection over 128-bit hashes; 0 for fewer than ``least``,
        which most are told by their first bytes."""
        spans, n = Spans(raw), len(raw)
        shared = np.zeros(len(a), dtype=np.int64)

        def agree(rows: np.ndarray, done: np.ndarray, step: int) -> np.ndarray:
            x, y = a[rows] + done, b[rows] + done
            fits = np.flatnonzero(np.maximum(x, y) + step <= n)
            x, y = x[fits], y[fits]
            same = spans.first(x, x + step) == spans.first(y, y + step)
            same[same] = spans.second(x[same], x[same] + step) == spans.second(y[same], y[same] + step)
            return fits[same]

        every = np.arange(len(a))
        far = every[agree(every, 0, self.least)]
        out, step = np.full(len(far), self.least, dtype=np.int64), 1 << self.longest.bit_length()
        while step:
            out[agree(far, out, step)] += step
            step >>= 1
        shared[far] = out
        return shared

    def matching(self, positions: np.ndarray) -> np.ndarray:
        """For each position: length of the longest string there that also starts elsewhere."""
        best = np.zeros(len(positions), dtype=np.int64)
        for sample, shared in ((self.head, self.head_shared), (self.tail, self.tail_shared)):
            if len(sample):
                i = np.searchsorted(sample, positions, side="right") - 1
                got = shared[i] - (positions - sample[i])
                best = np.maximum(best, np.where(i >= 0, got, 0))
        return best


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` bytes occur elsewhere among the texts too."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)  # no UTF-8 text has this byte
    # What occurs twice has no whole text between two others in it, as the texts differ.
    index = RunLengthIndex(raw, 2 * int(sizes.max(initial=0)) + 2, length)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
    n = np.maximum(sizes - length + 1, 0)
    start = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    hit = index.matching(start) >= length
    return np.split(hit, np.cumsum(n)[:-1])


def marked_runs(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans of bytes that consecutive repeated windows cover."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1 + length) for a, b in edge.reshape(-1, 2)]


def _shard_marks(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        hits = repeated_windows(list(pdf["bytes"]), length)
        for k_id, k_text, s, n, hit in zip(pdf["k_id"], pdf["k_text"], pdf["s"], pdf["n"], hits, strict=True):
            if n == 1:
                out += [(k_id, k_text, s + a, s + b) for a, b in marked_runs(hit, length)]
        return pd.DataFrame(out, columns=[*KEY, "s", "e"]).astype("int64")

    return run


def _blocks(lo: int, hi: int, anchor: int, width: int) -> list[tuple[int, int, int]]:
    """First and last window of each block of lo to hi, and where the block, aligned to the anchor, would begin."""
    out = []
    while lo <= hi:
        begin = lo - (lo - anchor) % width
        end = min(hi, begin + width - 1)
        out.append((lo, end, begin))
        lo = end + 1
    return out


def _block_rows(length: int, width: int):
    """Hashes of the blocks of at most ``width`` windows that the open stretches of a region consist of: of the bytes that
    all windows of an aligned block share, and of all the bytes of its windows here."""
    k = min(K, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = np.frombuffer(batch.column("bytes")[row].as_py(), dtype=np.uint8)
                spans, i = Spans(raw), np.arange(len(raw) - k + 1)
                anchor = int(np.argmin(spans.first(i, i + k) >> np.uint64(PLACE_BITS)))
                cuts = [(*x, o["n"]) for o in batch.column("open")[row].as_py() for x in _blocks(o["lo"], o["hi"], anchor, width)]
                lo, hi, begin, n = (np.array(x, dtype=np.int64) for x in zip(*cuts, strict=True))
                core, whole = (begin + width - 1, begin + length), (lo, hi + length)
                cols = [lo, hi, *(nptext.signed(f(a, b)) for a, b in (core, whole) for f in (spans.first, spans.second))]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("id")[row].as_py()] * len(cuts), pa.int64()), pa.array(n), *map(pa.array, cols)], ["id", "n", "lo", "hi", "c1", "c2", "f1", "f2"])

    return run


def _split_hot(regions: DataFrame, length: int) -> DataFrame:
    """(k_id, k_text, s, e) of repeated windows of regions (k_id, k_text, s, n, bytes) with very frequent anchors.

    Exact, by counting only: windows are cut, aligned to the anchor, into blocks of 64, then 8, then 1. A block whose
    bytes all recur is marked. Blocks that have the bytes in common which all their windows share, but not all bytes, go
    on to smaller blocks, equal ones as one with their number. Other blocks hold no further repeat. Every count is summed
    before the shuffle, so a group's size doesn't matter.
    """
    regions = stored(regions.withColumn("id", F.xxhash64(*KEY, "s")))
    last = (F.octet_length("bytes") - length).cast("long")
    open_ = regions.select("id", F.array(F.struct(F.lit(0).cast("long").alias("lo"), last.alias("hi"), "n")).alias("open"))
    texts, places, marks = regions.select("id", "bytes"), regions.select("id", *KEY, "s"), None
    for width in (w for w in (64, 8, 1) if w == 1 or 2 * w <= length):
        rows = stored(texts.join(open_, "id").mapInArrow(_block_rows(length, width), "id long, n long, lo long, hi long, c1 long, c2 long, f1 long, f2 long"))
        kinds = stored(rows.groupBy("c1", "c2", "f1", "f2").agg(F.sum("n").alias("nf"), *(F.first(c).alias(c) for c in ("id", "lo", "hi"))))
        again = kinds.where("nf > 1").select("c1", "c2", "f1", "f2")
        done = rows.where("n = 1").join(again, ["c1", "c2", "f1", "f2"]).join(places, "id")
        done = done.select(*KEY, (F.col("s") + F.col("lo")).alias("s"), (F.col("s") + F.col("hi") + length).alias("e"))
        marks = done if marks is None else marks.union(done)
        mixed = kinds.groupBy("c1", "c2").agg(F.count("*").alias("many"), F.min("nf").alias("least")).where("many > 1 and least = 1")
        open_ = kinds.join(mixed.select("c1", "c2"), ["c1", "c2"]).groupBy("id").agg(F.collect_list(F.struct("lo", "hi", F.col("nf").alias("n"))).alias("open"))
    return marks


def _removed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = nptext.utf8(batch.column("text"))
        kept, spans = [], []
        for row, marks in enumerate(batch.column("marks").to_pylist()):
            own, runs, out, to = raw[at[row] : at[row + 1]].tobytes(), [], [], 0
            for m in sorted(marks or [], key=lambda m: m["s"]):
                if runs and m["s"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], m["e"])
                else:
                    runs.append([m["s"], m["e"]])
            for s, e in runs:
                out.append(own[to:s])
                to = e
            kept.append(b"".join([*out, own[to:]]))
            spans.append([{"start": s, "end": e} for s, e in runs])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(spans, kind), pa.array(kept, pa.binary()), batch.column("repeats_passage")], ["doc_id", "n_bytes", "spans", "kept", "repeats_passage"])


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return nptext.word_hashes(raw, at, IS_WORD)


def _passage_rows(length: int):
    """The regions of the texts as sequences of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, _, part, cuts in nptext.chunks(*nptext.utf8(batch.column("text"))):
                for piece, ends, rows, places in _slices(*_words(part, cuts), length):
                    row, s, e, anchor, h, _ = regions_of(piece, ends, length, PASSAGE_GRAM)
                    shift = places[row] - ends[row] if len(row) else row
                    take = pa.array(top + rows[row] if len(row) else row)
                    yield pa.RecordBatch.from_arrays([batch.column("d").take(take), *(pa.array(x) for x in (s + shift, e + shift, nptext.signed(anchor), nptext.signed(h)))], ["d", "s", "e", "anchor", "h"])

    return run


def _window_rows(length: int):
    """128-bit hashes of the windows of the wanted regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, part, cuts in nptext.chunks(*nptext.utf8(batch.column("text"))):
                h, first = _words(part, cuts)
                spans = Spans(h)
                for row in range(len(first) - 1):
                    at = np.unique(np.concatenate([np.arange(w["s"], w["e"] + 1) for w in batch.column("wanted")[lo + row].as_py()])) + first[row]
                    d = pa.array([batch.column("d")[lo + row].as_py()] * len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays([d, pa.array(nptext.signed(spans.first(at, at + length))), pa.array(nptext.signed(spans.second(at, at + length)))], ["d", "w1", "w2"])

    return run


def repeated_passages(docs: DataFrame, length: int = PASSAGE_WORDS) -> DataFrame:
    """(d: hash of common.KEY, one row each) of the keyed docs that have ``length`` words in a row which another document
    has too. Words are what stands between white space. Documents alike in id and text count as one.

    Exact, by counting only, as for bytes: regions that recur whole in another document settle their documents. Of regions
    that share only their anchor with another document's, where a document is still unsettled, all windows are counted.
    """
    docs = docs.where("text is not null").select(F.xxhash64(*KEY).alias("d"), "text")
    regions = stored(docs.mapInArrow(_passage_rows(length), "d long, s long, e long, anchor long, h long"))
    ends = (F.min("d").alias("lo"), F.max("d").alias("hi"))
    kinds = stored(regions.groupBy("anchor", "h").agg(*ends))
    whole = stored(kinds.where("lo <> hi").select("anchor", "h"))
    done = stored(regions.join(small_side(whole, PASSAGE_BROADCAST_ROWS), ["anchor", "h"]).select("d").distinct())
    mixed = stored(kinds.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 1").select("anchor"))
    discard(kinds, whole)
    open_ = regions.join(small_side(mixed, PASSAGE_BROADCAST_ROWS), "anchor")
    open_ = stored(open_.join(small_side(done, MARK_BROADCAST_ROWS).withColumn("done", F.lit(True)), "d", "left").select("d", "s", "e", "anchor", "done"))
    unsettled = open_.where("done is null").select("anchor").distinct()
    wanted = stored(open_.join(unsettled, "anchor").groupBy("d").agg(F.collect_list(F.struct("s", "e")).alias("wanted")))
    discard(regions, mixed, open_)
    windows = docs.join(small_side(wanted, MARK_BROADCAST_ROWS), "d").select("d", "text", "wanted")
    windows = stored(windows.mapInArrow(_window_rows(length), "d long, w1 long, w2 long"))
    again = windows.groupBy("w1", "w2").agg(*ends).where("lo <> hi").select("w1", "w2")
    return done.union(windows.join(again, ["w1", "w2"]).select("d")).distinct()


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (start, end of each maximal removed run, in bytes), kept (binary), and
    repeats_passage: whether the text has PASSAGE_WORDS words in a row which another document has too (see
    repeated_passages), however many bytes they have.

    docs: doc_id, text; other columns are ignored. A text is its UTF-8 bytes, a null one is empty. Removed is each byte
    covered by a string of ``length`` bytes that also starts anywhere else, in the same text or in another; strings are
    judged on the input and never cross texts. A text of fewer bytes is kept whole; repeated rows are copies of each
    other, also with the same doc_id. An empty table gives no rows. Bytes are compared by 128-bit hashes and, in the
    index, by the suffix order itself.
    """
    docs = keyed(docs)
    passages = stored(repeated_passages(docs).withColumn("repeats_passage", F.lit(True)))
    found = stored(docs.mapInArrow(_region_rows(length), "k_id long, k_text long, s long, e long, anchor long, h1 long, h2 long"))
    kinds = found.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in (*KEY, "s", "e")))
    kinds = stored(kinds)
    again = kinds.where("n > 1").select("h1", "h2")
    marks = found.join(again, ["h1", "h2"]).select(*KEY, "s", (F.col("e") + length).alias("e"))
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("many"), F.min("n").alias("least")).where("many > 1 and least = 1")
    wanted = kinds.join(mixed.select("anchor", "many"), "anchor")
    wanted = stored(wanted.groupBy(*KEY).agg(F.collect_list(F.struct("s", "e", "anchor", "n", "many")).alias("wanted")))
    pieces = docs.select(*KEY, "text").join(small_side(wanted, MARK_BROADCAST_ROWS), KEY)
    pieces = stored(pieces.mapInArrow(_cut_rows(length), "k_id long, k_text long, s long, e long, anchor long, n long, many long, bytes binary").dropDuplicates([*KEY, "s"]))
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    shards = -(-int(total) // SHARD_BYTES) or 1
    calm = pieces.where(F.col("many") <= HOT_REGIONS).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    marks = marks.union(calm.groupBy("shard").applyInPandas(_shard_marks(length), "k_id long, k_text long, s long, e long"))
    hot = pieces.where(F.col("many") > HOT_REGIONS)
    if not hot.isEmpty():
        marks = marks.union(_split_hot(hot, length))
    marks = stored(marks.groupBy(*KEY).agg(F.collect_list(F.struct("s", "e")).alias("marks")))
    joined = docs.join(small_side(marks, MARK_BROADCAST_ROWS), KEY, "left").withColumn("d", F.xxhash64(*KEY))
    joined = joined.join(small_side(passages, MARK_BROADCAST_ROWS), "d", "left").select("doc_id", "text", "marks", F.coalesce("repeats_passage", F.lit(False)).alias("repeats_passage"))
    return joined.mapInArrow(_removed_rows, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary, repeats_passage boolean")
