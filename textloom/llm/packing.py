"""Packing of tokenised documents into sequences by column generation for the cutting-stock problem.

Documents are cut into full sequences and one rest; the rests' lengths, rounded up to a grain, make a histogram of fixed
size. A linear program over patterns (how many rests of each length fill a sequence) is solved on that histogram: its
columns are priced by the knapsack's dynamic program, its solution is rounded down, and the few rests left over get
patterns of their own. Ranked within their length, all rests then find their place from the patterns alone.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import KEY, cut, keyed

SEQUENCE = 2048
GRAIN = 8
#: Pieces of one length that are ranked in one task, about.
RANKED_AT_ONCE = 20_000
END_ID = 1
#: The linear program is solved once no pattern is worth more than this above one sequence: the same share of padding.
GAP = 1e-3
#: Text that the tokenizer takes for its special token wherever it stands.
SPECIAL = "<|endoftext|>"


@functools.cache
def tokenizer(path: str, ranks: str):
    """texts -> lists of ids of the tokenizer in ``path`` (a tokenizers file), without special tokens added.

    The same vocabulary as ranks, if given, is used for texts without special tokens: the ids are the same and come
    four times as fast.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    if not ranks:
        return lambda texts: [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)]
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return lambda texts: [whole.encode(t, add_special_tokens=False).ids if SPECIAL in t else fast.encode_ordinary(t) for t in texts]


def _piece_rows(path: str, ranks: str, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, ranks)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                row, start, length, check, total, own = [], [], [], [], [], []
                for i, ids in enumerate(encode(texts)):
                    ids = np.array([*ids, END_ID], dtype="<u4")
                    for s in range(0, len(ids), size):
                        piece = ids[s : s + size]
                        row.append(i)
                        start.append(s)
                        length.append(len(piece))
                        check.append(zlib.crc32(piece))
                        total.append(len(ids))
                        own.append(piece.tobytes() if with_ids else None)
                cols = [part.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", *KEY)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, *(pa.array(x, pa.int64()) for x in (start, length, check, total)), pa.array(own, pa.binary())],
                    ["doc_id", *KEY, "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return run


def best_pattern(value: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Most value that lengths 1 ... len(value) - 1 (each any number of times) can put into ``size``, and the numbers."""
    best, choice = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    n = len(value) - 1
    for c in range(1, size + 1):
        m = min(c, n)
        got = best[c - m : c][::-1] + value[1 : m + 1]
        i = int(np.argmax(got))
        if got[i] > best[c - 1]:
            best[c], choice[c] = got[i], i + 1
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(n + 1, dtype=np.int64), size
    while c > 0:
        if choice[c]:
            out[choice[c]] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[size]), out


def solve(demand: np.ndarray, size: int, most: int = 5000) -> list[tuple[np.ndarray, int]]:
    """(pattern, how often) that together hold each length as often as ``demand`` says (index: length, 0 unused), in few
    sequences of ``size``. Revised simplex over generated columns, then rounding down with what is left put longest first;
    ``most`` iterations at most (the basis is a solution at any time, and the counts are exact in any case)."""
    lengths = np.flatnonzero(demand)
    k = len(lengths)
    out: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    if k:
        # Start: each length alone, as often as it fits.
        basis = np.zeros((len(demand), k), dtype=np.int64)
        basis[lengths, np.arange(k)] = size // lengths
        inverse = np.diag(1.0 / (size // lengths))
        x = (inverse * demand[lengths]).sum(axis=1)
        for _ in range(most):
            price = inverse.sum(axis=0)
            value = np.zeros(len(demand))
            value[lengths] = price
            worth, column = best_pattern(value, size)
            if worth <= 1 + GAP:
                break
            d = (inverse * column[lengths]).sum(axis=1)
            ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
            r = int(np.argmin(ratio))
            if not np.isfinite(ratio[r]):
                break
            theta = ratio[r]
            basis[:, r] = column
            x = x - theta * d
            x[r] = theta
            x = np.maximum(x, 0)
            inverse[r] /= d[r]
            d[r] = 0
            inverse -= np.outer(d, inverse[r])
        for j in np.argsort(-x, kind="stable"):
            pattern = basis[:, j]
            used = np.flatnonzero(pattern)
            times = min(int(x[j] + 1e-6), int((left[used] // pattern[used]).min()))
            if times > 0:
                out.append((pattern.copy(), times))
                left -= pattern * times
    # What is left is less than one sequence for each pattern: longest first into the fullest that has room.
    bins: list[np.ndarray] = []
    room: list[int] = []
    for length in range(len(demand) - 1, 0, -1):
        for _ in range(int(left[length])):
            fit = [(r, i) for i, r in enumerate(room) if r >= length]
            if fit:
                i = min(fit)[1]
            else:
                bins.append(np.zeros(len(demand), dtype=np.int64))
                room.append(size)
                i = len(bins) - 1
            bins[i][length] += 1
            room[i] -= length
    return [*out, *((b, 1) for b in bins)]


class Places:
    """Where the r-th piece of a length goes: a table of fixed size, made from the patterns."""

    def __init__(self, patterns: list[tuple[np.ndarray, int]], size: int):
        base = 0
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        upto = np.zeros(size + 1, dtype=np.int64)
        for pattern, times in patterns:
            before = 0
            for length in np.flatnonzero(pattern)[::-1]:
                n = int(pattern[length])
                rows.setdefault(int(length), []).append((int(upto[length]), n, base, before))
                upto[length] += n * times
                before += n
            base += times
        self.rows = {k: np.array(v, dtype=np.int64) for k, v in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence, and the piece's number in it."""
        sequence, slot = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        for k in np.unique(length):
            own = np.flatnonzero(length == k)
            table = self.rows[int(k)]
            t = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
            since = rank[own] - t[:, 0]
            sequence[own] = t[:, 2] + since // t[:, 1]
            slot[own] = t[:, 3] + since % t[:, 1]
        return sequence, slot


def _place_rows(places: Places):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            sequence, slot = places.find(pdf.pop("grains").to_numpy(), pdf.pop("rank").to_numpy())
            yield pdf.assign(sequence_id=sequence, slot=slot)

    return run


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str = "", size: int = SEQUENCE, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32 (of its ids as little-endian 32 bits),
    doc_tokens, sequence_id, offset, and ids (the same bytes) if with_ids.

    docs: doc_id, text; other columns are ignored. A document's ids are its text's, then END_ID; a null text counts as
    empty, so that each document has a piece. Each id lies in just one piece; the pieces of a sequence lie one behind the
    other from 0 on and have at most ``size`` ids, what is missing is padding. Repeated rows and null ids are documents of
    their own. An empty table gives no rows.

    The driver gets a histogram of size / grain lengths; patterns and places are of fixed size too.
    """
    spark = docs.sparkSession
    kind = "doc_id long, k_id long, k_text long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces = keyed(docs).mapInArrow(_piece_rows(tokenizer_path, ranks_path, size, with_ids), kind)
    pieces = cut(pieces.withColumn("grains", F.ceil(F.col("length") / grain).cast("long")))
    counts = {int(r["grains"]): int(r["n"]) for r in pieces.groupBy("grains").agg(F.count("*").alias("n")).collect()}
    demand = np.zeros(size // grain + 1, dtype=np.int64)
    for k, n in counts.items():
        demand[k] = n
    places = Places(solve(demand, size // grain), size // grain)
    # Ranks: numbers within parts of a length, which are dealt by hash, then the parts' sums.
    salts = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, -(-n // RANKED_AT_ONCE))]) if counts else F.create_map(F.lit(0), F.lit(1))
    salt = F.pmod(F.xxhash64(*KEY, "start"), salts[F.col("grains").cast("int")])
    pieces = pieces.withColumn("salt", salt.cast("long"))
    sums = pieces.groupBy("grains", "salt").agg(F.count("*").alias("n"))
    sums = sums.select("grains", "salt", (F.sum("n").over(Window.partitionBy("grains").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = pieces.drop("ids").withColumn("own", F.row_number().over(Window.partitionBy("grains", "salt").orderBy(*KEY, "start")))
    ranked = ranked.join(sums, ["grains", "salt"]).withColumn("rank", F.col("own") + F.col("before") - 1).drop("own", "before", "salt")
    ranked = ranked.select("doc_id", *KEY, "start", "length", "ids_crc32", "doc_tokens", "grains", "rank")
    placed = ranked.mapInPandas(_place_rows(places), "doc_id long, k_id long, k_text long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    behind = Window.partitionBy("sequence_id").orderBy("slot")
    out = placed.withColumn("offset", F.sum("length").over(behind) - F.col("length"))
    if with_ids:
        ids = pieces.select(*KEY, "start", "ids").dropDuplicates([*KEY, "start"])
        return out.join(ids, [*KEY, "start"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
