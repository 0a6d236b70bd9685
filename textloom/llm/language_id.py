"""Language identification by interpolated Kneser-Ney character models.

A model of order five is trained for each language; the probabilities of all languages stand side by side in sorted hash
arrays, one for each order, so that one search serves every language. A text goes to the language with the lowest
cross-entropy per character; a text whose cross-entropy is far above what held-out training texts of that language have
at its length is rejected.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from textloom.llm import nptext
from textloom.llm.common import bounded_batches, shared_value

ORDER = 5
#: Labelled texts of a language that are learned from at most, chosen by hash: the bound on what the driver gets.
TRAIN_DOCS = 3000
#: Of these, every eighth is kept out of the counts to calibrate the rejection.
CALIBRATE = 8
#: The discount of an order in which no gram stands once or twice.
DISCOUNT = 0.75
SPACE = 32
CHUNK_CHARS = 1 << 19
#: A text is rejected if its cross-entropy lies further above the mean, in standard deviations, than that of any held-out
#: text of its language, by so much; and by LEAST at least. With fewer held-out texts than ENOUGH nothing is rejected.
BEYOND, LEAST, ENOUGH = 1.25, 4.0, 10

#: Columns that ``identify`` adds.
JUDGED = ("lang_pred", "score", "entropy", "rejected")

_weights = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


@functools.cache
def letters() -> np.ndarray:
    """True for the code points of letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def normal(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of others as one space, one at the end and ORDER - 1 in front;
    empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = letters()[c] if len(c) else np.zeros(0, dtype=bool)
    if not is_letter.any():
        return np.zeros(0, dtype=np.uint32)
    c = np.where(is_letter, c, np.uint32(SPACE))
    c = np.concatenate(([np.uint32(SPACE)], c, [np.uint32(SPACE)])).astype(np.uint32)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE)
    return np.concatenate((np.full(ORDER - 2, SPACE, dtype=np.uint32), c[keep]))


def gram_hashes(c: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters that end at each place; places before order - 1 take in fewer."""
    x = np.full(len(c), order, dtype=np.uint64)
    for j in range(order):
        x[j:] += (c[: len(c) - j].astype(np.uint64) + np.uint64(1)) * _weights[j]
    return nptext.mix(x)


class HashArray:
    """Sorted 64-bit hashes with one row of values each; a search begins at the hash's leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.bits = max(1, min(22, int(len(keys)).bit_length()))
        heads = self.keys >> np.uint64(64 - self.bits)
        self.starts = np.searchsorted(heads, np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.probes = int(np.diff(self.starts).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where there is none."""
        out = np.full(len(h), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        head = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[head], self.starts[head + 1]
        open_ = np.arange(len(h))
        for _ in range(self.probes):
            more = at < end
            open_, at, end = open_[more], at[more], end[more]
            if not len(open_):
                break
            same = self.keys[at] == h[open_]
            out[open_[same]] = at[same]
            open_, at, end = open_[~same], at[~same] + 1, end[~same]
        return out


@dataclass
class Models:
    """Log probabilities of grams by order (rows of a HashArray, one column a language), weights of contexts for grams
    unseen in every language, and for each language mean, variance and variance per character of held-out texts, and how many
    standard deviations above the mean a text is rejected."""

    langs: list[str]
    grams: list[HashArray]
    contexts: list[HashArray]
    unknown: np.ndarray
    usual: np.ndarray

    def log_probabilities(self, c: np.ndarray) -> np.ndarray:
        """One row for each place, one column for each language."""
        out = np.empty((len(c), len(self.langs)), dtype=np.float32)
        out[:] = self.unknown
        todo = np.arange(len(c))
        more = np.zeros((len(c), len(self.langs)), dtype=np.float32)
        for order in range(len(self.grams), 0, -1):
            h = gram_hashes(c, order)[todo] if len(todo) else np.zeros(0, dtype=np.uint64)
            at = self.grams[order - 1].find(h)
            hit = at >= 0
            out[todo[hit]] = self.grams[order - 1].values[at[hit]] + more[todo[hit]]
            todo = todo[~hit]
            if order > 1 and len(todo):
                # The weight that the context, one place to the left, leaves to the shorter gram.
                before = np.concatenate(([np.uint64(0)], gram_hashes(c, order - 1)[:-1]))[todo]
                at = self.contexts[order - 1].find(before)
                known = at >= 0
                more[todo[known]] += self.contexts[order - 1].values[at[known]]
        out[todo] += more[todo]
        return out

    def entropies(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character under each language, and each text's characters; zeros for empty texts."""
        pad = ORDER - 1
        n = np.array([max(0, len(t) - pad) for t in texts], dtype=np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        run: list[int] = []
        for i in [*np.flatnonzero(n), -1]:
            if run and (i < 0 or n[run].sum() + n[i] > CHUNK_CHARS):
                c, begin = np.concatenate([texts[j] for j in run]), np.concatenate(([0], np.cumsum(n[run] + pad)[:-1]))
                p = self.log_probabilities(c)
                p[(begin[:, None] + np.arange(pad)).ravel()] = 0
                out[run] = -np.add.reduceat(p, begin, axis=0, dtype=np.float64)
                run = []
            if i >= 0 and n[i] > CHUNK_CHARS:
                # A very long text comes in pieces, each with the characters before it as context.
                for at in range(pad, len(texts[i]), CHUNK_CHARS):
                    out[i] -= self.log_probabilities(texts[i][at - pad : at + CHUNK_CHARS])[pad:].sum(axis=0, dtype=np.float64)
            elif i >= 0:
                run.append(int(i))
        return out / np.maximum(n, 1)[:, None], n

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, entropy and rejection of each text; ``und``, 0 and rejected without a letter or a language."""
        codes = [normal(t or "") for t in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        h, n = self.entropies(codes)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        # Neighbouring characters depend on each other: the evidence counts as that of the root of so many.
        odds = np.exp(-np.minimum((h - low[:, None]) * np.sqrt(np.maximum(n, 1))[:, None], 50))
        score = np.where(n > 0, 1 / odds.sum(axis=1), 0.0)
        mean, var, per_char, limit = self.usual[best].T
        rejected = (n == 0) | ((low - mean) / np.sqrt(var + per_char / np.maximum(n, 1)) > limit)
        return [self.langs[b] if m else "und" for b, m in zip(best, n, strict=True)], score, np.where(n > 0, low, 0.0), rejected


def discount(n: np.ndarray) -> float:
    """What is taken off each count: estimated from how many grams stand once and twice."""
    once, twice = int((n == 1).sum()), int((n == 2).sum())
    return once / (once + 2 * twice) if once and twice else DISCOUNT


def kneser_ney(counts: dict[tuple[str, str], int], langs: list[str]) -> Models:
    """Models from (language, gram of ORDER characters) -> count. Lower orders count the different characters before a gram."""
    strings = {lang: {} for lang in langs}
    for (lang, gram), n in counts.items():
        strings[lang][gram] = n
    # table[order][lang]: sorted codes -> count, codes as rows of characters
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for lang in langs:
        own = strings[lang]
        rows = np.frombuffer("".join(own).encode("utf-32-le"), dtype=np.uint32).reshape(-1, ORDER) if own else np.zeros((0, ORDER), np.uint32)
        n = np.array(list(own.values()), dtype=np.int64)
        levels[ORDER - 1].append((rows, n))
        for order in range(ORDER - 1, 0, -1):
            rows, n = np.unique(rows[:, 1:], axis=0, return_counts=True)
            levels[order - 1].append((rows, n.astype(np.int64)))
    size = max(2, len(np.unique(np.concatenate([rows[:, 0] for rows, _ in levels[0]])))) + 1 if langs else 2
    grams, contexts = [], [HashArray(np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32))]
    lower: HashArray | None = None
    for order in range(1, ORDER + 1):
        every = np.unique(np.concatenate([rows for rows, _ in levels[order - 1]]), axis=0)
        keys = _row_hashes(every)
        p = np.zeros((len(every), len(langs)))
        heads = np.unique(every[:, :-1], axis=0) if order > 1 else np.zeros((1, 0), np.uint32)
        head_keys = _row_hashes(heads) if order > 1 else np.zeros(1, np.uint64)
        weight = np.ones((len(heads), len(langs)))
        by, head_by = np.argsort(keys), np.argsort(head_keys)
        below = np.exp(lower.values[lower.find(_row_hashes(every[:, 1:]))].astype(float)) if order > 1 else np.full((len(every), len(langs)), 1 / size)
        head_of = head_by[np.searchsorted(head_keys, _row_hashes(every[:, :-1]), sorter=head_by)] if order > 1 else np.zeros(len(every), np.int64)
        for j, (rows, n) in enumerate(levels[order - 1]):
            if not len(rows):
                p[:, j] = below[:, j]
                continue
            own = by[np.searchsorted(keys, _row_hashes(rows), sorter=by)]
            seen = np.zeros(len(every))
            seen[own] = n
            total = np.bincount(head_of, seen, minlength=len(heads))
            kinds = np.bincount(head_of, seen > 0, minlength=len(heads))
            off = discount(n)
            with np.errstate(divide="ignore", invalid="ignore"):
                weight[:, j] = np.where(total > 0, off * kinds / total, 1.0)
                p[:, j] = np.where(total[head_of] > 0, np.maximum(seen - off, 0) / total[head_of], 0) + weight[head_of, j] * below[:, j]
        lower = HashArray(keys, np.log(np.maximum(p, 1e-12)).astype(np.float32))
        grams.append(lower)
        if order > 1:
            contexts.append(HashArray(head_keys, np.log(weight).astype(np.float32)))
        else:
            unknown = np.log(weight[0] / size)
    return Models(langs, grams, contexts, unknown.astype(np.float32), np.tile([0.0, 1.0, 0.0, math.inf], (len(langs), 1)))


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """gram_hashes of rows of characters."""
    order = rows.shape[1]
    x = np.full(len(rows), order, dtype=np.uint64)
    for j in range(order):
        x += (rows[:, order - 1 - j].astype(np.uint64) + np.uint64(1)) * _weights[j]
    return nptext.mix(x)


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, dict[str, int]] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            c = normal(text or "")
            s = c.tobytes().decode("utf-32-le")
            own = total.setdefault(lang, {})
            for i in range(len(s) - ORDER + 1):
                g = s[i : i + ORDER]
                own[g] = own.get(g, 0) + 1
    rows = [(lang, g, n) for lang, own in total.items() for g, n in own.items()]
    cols = list(zip(*rows, strict=True)) if rows else ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "gram", "n"])


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Models:
    """Models of the languages of labelled (doc_id, text, lang). Rows without lang, or whose text is null or has no
    letter, teach nothing. At most about ``train_docs`` rows of a language are used, chosen by hash; their whole texts are
    counted on the executors, and the driver gets the counted grams."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"))
    rows = rows.where("lang is not null and text rlike '\\\\p{L}'")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Models([], [], [], np.zeros(0), np.zeros((0, 4)))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_docs / sizes[lang]))])
    chosen = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    aside = F.pmod(F.shiftright("h", 24), F.lit(CALIBRATE)) == 0
    counts = chosen.where(~aside).select("lang", "text").mapInArrow(_gram_rows, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    models = kneser_ney(dict(zip(zip(counts.column("lang").to_pylist(), counts.column("gram").to_pylist(), strict=True), counts.column("n").to_pylist(), strict=True)), langs)
    shared = labelled.sparkSession.sparkContext.broadcast(models)

    def own_entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shared.value.langs.index(x) for x in batch.column("lang").to_pylist()]
            h, n = shared.value.entropies([normal(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(h[np.arange(len(h)), own]), pa.array(n)], ["lang", "h", "n"])

    got = chosen.where(aside).select("lang", "text").mapInArrow(own_entropy, "lang long, h double, n long").toPandas()
    for j in range(len(langs)):
        h, n = got.loc[got["lang"] == j, "h"].to_numpy(), np.maximum(got.loc[got["lang"] == j, "n"].to_numpy(), 1)
        if len(h) < ENOUGH:
            continue
        mean = np.average(h, weights=n)
        off = (h - mean) ** 2
        per_char = float(np.median(off * n)) / 0.455  # the median of a squared standard normal value
        var, per_char = float(np.median(off)) / 0.455, max(per_char, 1.0)
        furthest = float(((h - mean) / np.sqrt(var + per_char / n)).max())
        models.usual[j] = (mean, var, per_char, max(LEAST, BEYOND * furthest))
    shared.destroy()
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """docs with lang_pred, score (0 to 1), entropy (nats per character) and rejected.

    docs: a text column; other columns are kept unless they have one of these names. Whole texts are judged, by the text
    alone. A null text, or one without letters, has ``und``, score 0 and is rejected; so is every text if there are no
    models. Equal texts are judged alike; ties go to the first language by name. An empty table gives no rows.
    """
    shared = shared_value(docs.sparkSession, models)
    docs = bounded_batches(docs.drop(*JUDGED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                langs, score, entropy, rejected = shared.value.judge(part.column(part.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], [*part.schema.names, "lang_pred", "score", "entropy", "rejected"])

    out = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("entropy", DoubleType()).add("rejected", BooleanType())
    return docs.mapInArrow(run, out)


def held_out(doc_id):
    """crc32 of the id as text leaves 2 modulo 4; no null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
