"""Byte-level BPE by prefix dynamic programming.

Merges are never replayed over a text. For each prefix of a piece there is exactly one token with which its encoding ends:
the token that ends there and that merging leaves beside the last token of what comes before it. Stored for each byte,
these tokens give any prefix's encoding, go on from an appended text, and show behind an edit where the old ones hold again.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches

#: Characters that a match of the pattern looks at: from its start, and beyond its end.
FROM_START, BEYOND = 3, 1
#: Characters that are split at once; pieces and pairs of tokens that are remembered, and a piece's characters at most.
WINDOW, REMEMBERED, SHORT = 1 << 18, 1 << 18, 48
#: Pieces of several texts that are looked up together, about.
TOGETHER = 400_000
#: Pairs of tokens whose fit is remembered side by side, and the bits of a token in such a pair.
PAIRS, PAIR_BITS = 1 << 20, 20
_NONE = 1 << 62
#: Stands for newer characters while texts are cut: neither letter, number nor space in any version of the tables.
STAND_IN = 0xFDD0


@functools.cache
def newer_characters() -> str:
    """Letters and numbers by the Unicode tables of regex that the BPE library's tables, of another version, lack. A
    character is asked for behind one of its class: with tokens for all their prefixes, a match of both gives one id.
    Both are taken to know what Python's own tables know."""
    import public_tokenizers
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = []
    for lead, kind in (("a", r"\p{L}"), ("1", r"\p{N}")):
        known = [c for c in regex.findall(kind, every) if unicodedata.category(c) == "Cn"]
        tokens = dict.fromkeys([bytes([b]) for b in range(256)] + [(lead + c).encode()[:n] for c in known for n in range(2, 2 + len(c.encode()))])
        library = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        out += [c for c in known if len(library.encode_ordinary(lead + c)) > 1]
    return "".join(out)


@dataclass(frozen=True)
class Code:
    """A text's bytes, the offset of each piece, and the last token of each prefix of each piece (one a byte)."""

    raw: bytes
    starts: array
    last: array


class Bpe:
    """Ranks of byte strings and the pattern that cuts texts into pieces. Every byte is a token, and pieces leave no gap."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.newer = np.zeros(0x110000, dtype=bool)
        self.newer[[ord(c) for c in newer_characters()]] = True
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.longest = max(map(len, ranks), default=1)
        self.lengths = [len(t) for t in self.bytes_of]
        self.ends = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.ends.add_word(token.decode("latin-1"), (i, len(token)))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self._trie = self._forward_trie()
        self._pair_keys, self._pair_fits = np.array([-1]), np.array([False])
        self.halves = functools.lru_cache(None)(self._halves)
        self.alone = functools.lru_cache(REMEMBERED)(self._alone)
        self._known: dict[str, bytes] = {}
        self._known_before: dict[str, bytes] = {}

    def _merged(self, raw: bytes, most: int = 1) -> list[bytes]:
        """What merging by rank leaves of a few bytes, or its state when ``most`` parts are left."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > most:
            rank, i = min((self.ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes a token of several bytes."""
        left, right = self._merged(self.bytes_of[token], 2)
        return self.ranks[left], self.ranks[right]

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens gives these two again. Their merges are undone from the last: at no time
        may the tokens at the border have a merge that comes before the one undone. Of equal ranks the left comes first."""
        ranks, bytes_of, lengths, limit = self.ranks, self.bytes_of, self.lengths, _NONE
        while True:
            if ranks.get(bytes_of[a] + bytes_of[b], _NONE) < limit:
                return False
            if lengths[a] > 1 and (lengths[b] == 1 or a > b):
                limit, a = a, self.halves(a)[1]
            elif lengths[b] > 1:
                limit, b = b + 1, self.halves(b)[0]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        fit = self.pairs[a << PAIR_BITS | b] = self._fits(a, b)
        return fit

    def _alone(self, token: int) -> bool:
        """Whether merging makes the token from its bytes."""
        return self.lengths[token] == 1 or len(self._merged(self.bytes_of[token])) == 1

    def prefixes(self, piece: bytes, known: array | None = None, old: array | None = None, changed: int = 0) -> array:
        """The last token of each prefix of a piece. ``known`` are those of its first bytes. ``old`` are the ones of another
        piece that ends alike: from byte ``changed`` on, counted from both ends, the bytes are the same; once as many of
        them agree as the longest token has bytes, the rest does."""
        n, done, agreed = len(piece), len(known or ()) - 1, 0
        last = [*(known or ()), *[-1] * (n - done - 1)]
        lo = max(0, done + 1 - self.longest)
        shift = len(old) - n if old is not None else 0
        get, bits = self.pairs.get, PAIR_BITS
        for end, (token, length) in self.ends.iter((piece[lo:] if lo else piece).decode("latin-1")):
            if (end := end + lo) <= done:
                continue
            start = end - length
            if start < 0:
                if start < -1 or not self.alone(token):
                    continue
            elif (fit := get(last[start] << bits | token)) is None:
                if not self.fits(last[start], token):
                    continue
            elif not fit:
                continue
            last[end], done = token, end
            if old is not None and end >= changed:
                agreed = agreed + 1 if old[end + shift] == token else 0
                if agreed >= self.longest:
                    last[end + 1 :] = old[end + 1 + shift :]
                    break
        return array("i", last)

    def _forward_trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All prefixes of tokens as nodes: sorted keys (node * 256 + byte), the nodes they lead to, each node's token or -1."""
        edges: dict[int, int] = {}
        token_at = [-1]
        for token, i in self.ranks.items():
            node = 0
            for byte in token:
                following = edges.setdefault(node << 8 | byte, len(token_at))
                if following == len(token_at):
                    token_at.append(-1)
                node = following
            token_at[node] = i
        keys = np.array(sorted(edges), dtype=np.int64)
        return keys, np.array([edges[k] for k in keys.tolist()], dtype=np.int64), np.array(token_at, dtype=np.int64)

    def _fit_together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fits for many pairs."""
        keys = a << PAIR_BITS | b
        place = np.minimum(np.searchsorted(self._pair_keys, keys), len(self._pair_keys) - 1)
        known = self._pair_keys[place] == keys
        if not known.all():
            new = np.unique(keys[~known])
            mask = (1 << PAIR_BITS) - 1
            fit = np.fromiter((self._fits(k >> PAIR_BITS, k & mask) for k in new.tolist()), dtype=bool, count=len(new))
            if len(self._pair_keys) >= PAIRS:
                self._pair_keys, self._pair_fits = np.array([-1]), np.array([False])
                return np.concatenate([self._fit_together(a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)])
            at = np.searchsorted(self._pair_keys, new)
            self._pair_keys, self._pair_fits = np.insert(self._pair_keys, at, new), np.insert(self._pair_fits, at, fit)
            place = np.searchsorted(self._pair_keys, keys)
        return self._pair_fits[place]

    def prefixes_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(last tokens of all prefixes of all pieces, offset of each piece and the end): ``prefixes`` for many pieces side by
        side, one length of prefix after the other."""
        keys, leads, token_at = self._trie
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        at = np.zeros(len(pieces) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in pieces], out=at[1:])
        piece = np.repeat(np.arange(len(pieces)), np.diff(at))
        # Every token at every place: from each byte forwards as long as tokens go on.
        start, node, ends, tokens, starts = np.arange(len(raw)), np.zeros(len(raw), dtype=np.int64), [], [], []
        for k in range(self.longest):
            inside = start + k < at[piece[start] + 1]
            start, node = start[inside], node[inside]
            if not len(start):
                break
            step = node << 8 | raw[start + k]
            place = np.minimum(np.searchsorted(keys, step), len(keys) - 1)
            alive = keys[place] == step
            start, node = start[alive], leads[place[alive]]
            token = token_at[node]
            ends.append((start + k)[token >= 0])
            tokens.append(token[token >= 0])
            starts.append(start[token >= 0])
        if not ends:
            return np.zeros(0, dtype=np.int64), at
        end, token, start = map(np.concatenate, (ends, tokens, starts))
        depth = end - at[piece[end]]
        order = np.lexsort((start, end, depth))  # at each end the longest first
        end, token, start, depth = end[order], token[order], start[order], depth[order]
        last = np.full(len(raw), -1, dtype=np.int64)
        bounds = np.searchsorted(depth, np.arange(int(depth[-1]) + 2))
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            e, t, s = end[lo:hi], token[lo:hi], start[lo:hi]
            first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            stop = np.r_[first[1:], hi - lo]
            while len(first):  # each end's next candidate, until one fits
                i = first
                alone = s[i] == at[piece[e[i]]]
                good = np.empty(len(i), dtype=bool)
                good[~alone] = self._fit_together(last[s[i[~alone]] - 1], t[i[~alone]])
                good[alone] = [self.alone(x) for x in t[i[alone]].tolist()]
                last[e[i[good]]] = t[i[good]]
                first, stop = first[~good] + 1, stop[~good]
                first, stop = first[first < stop], stop[first < stop]
        return last, at

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pieces, read from their prefixes backwards."""
        last, at = self.prefixes_of(pieces)
        lengths = np.array(self.lengths, dtype=np.int64)
        place, row = at[1:].copy(), np.arange(len(pieces))
        row, place = row[place > at[:-1]], place[place > at[:-1]]
        rows, tokens, n = [], [], 0
        while len(row):
            token = last[place - 1]
            rows.append(row)
            tokens.append(token)
            place = place - lengths[token]
            row, place = row[place > at[row]], place[place > at[row]]
            n += 1
        if not rows:
            return [b""] * len(pieces)
        step = np.repeat(np.arange(n), [len(r) for r in rows])
        rows_, tokens_ = np.concatenate(rows), np.concatenate(tokens)
        order = np.lexsort((-step, rows_))
        flat = tokens_[order].astype("<u4").tobytes()
        bounds = (np.searchsorted(rows_[order], np.arange(len(pieces) + 1)) * 4).tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _tokens(self, last: array, lo: int, hi: int) -> list[int]:
        out = []
        while hi > lo:
            out.append(last[hi - 1])
            hi -= self.lengths[out[-1]]
        return out[::-1]

    def piece_ids(self, piece: bytes, last: array, lo: int, hi: int) -> list[int]:
        """A piece that is a token as it stands is that token, whatever merging makes of it."""
        return [self.ranks[piece]] if piece in self.ranks else self._tokens(last, lo, hi)

    def pieces(self, text: str, window: int = WINDOW) -> Iterator[list[str]]:
        """The matches of the pattern in order, in lists. A window's last matches are made again with what follows them."""
        at, size = 0, window
        while at < len(text):
            part = text[at : at + size]
            points = np.frombuffer(b"" if part.isascii() else part.encode("utf-32-le"), dtype="<u4")
            young = self.newer[points]
            if not young.any():
                found = self.pattern.findall(part)
            else:
                plain = np.where(young, STAND_IN, points).astype("<u4").tobytes().decode("utf-32-le")
                ends = [0, *(m.end() for m in self.pattern.finditer(plain))]
                found = [part[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            if at + len(part) < len(text):
                end, safe = 0, 0
                ends = []
                for x in found:
                    ends.append(end + len(x))
                    end = ends[-1]
                while safe < len(found) and ends[safe] + BEYOND <= len(part) and ends[safe] - len(found[safe]) + FROM_START <= len(part):
                    safe += 1
                if not safe:
                    size *= 2
                    continue
                found, at, size = found[:safe], at + ends[safe - 1], window
            else:
                at = len(text)
            yield found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` for several texts; pieces that aren't remembered are looked up side by side."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        n = 0
        for i, text in enumerate(texts):
            for found in self.pieces(text):
                waiting.append((i, found))
                n += len(found)
                if n > TOGETHER:
                    self._settle(waiting, out)
                    waiting, n = [], 0
        self._settle(waiting, out)
        return [b"".join(x) for x in out]

    def _settle(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        known, before, unmet = self._known, self._known_before, {}
        for x in dict.fromkeys(x for _, found in waiting for x in found):
            if x not in known:
                if x in before:
                    known[x] = before[x]
                else:
                    unmet[x] = x.encode()
        short = [x for x, raw in unmet.items() if len(raw) <= SHORT]
        known.update(zip(short, self.ids_of([unmet[x] for x in short]), strict=True))
        long = [x for x, raw in unmet.items() if len(raw) > SHORT]
        for x in long:
            known[x] = array("I", self._tokens(self.prefixes(unmet[x]), 0, len(unmet[x]))).tobytes()
        known.update((x, array("I", [self.ranks[raw]]).tobytes()) for x, raw in unmet.items() if raw in self.ranks)
        for i, found in waiting:
            out[i].append(b"".join(map(known.__getitem__, found)))
        for x in long:
            del known[x]
        if len(known) > REMEMBERED:  # what was met since the last time stays for as long again
            self._known_before, self._known = known, {}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def code(self, text: str) -> Code:
        """The stored prefixes of a whole text."""
        starts, last, raw = array("q"), array("i"), text.encode()
        for found in self.pieces(text):
            for x in found:
                starts.append(len(last))
                last.extend(self.prefixes(x.encode()))
        return Code(raw, starts, last)

    def ids(self, code: Code) -> bytes:
        out: list[int] = []
        for lo, hi in zip(code.starts, [*code.starts[1:], len(code.raw)], strict=False):  # no pieces, no ids
            out += self.piece_ids(code.raw[lo:hi], code.last, lo, hi)
        return np.array(out, dtype="<u4").tobytes()

    def edited(self, code: Code, at: int, removed: int, added: bytes) -> Code:
        """The code after ``removed`` bytes from ``at`` gave way to ``added`` (both whole characters). Pieces that the edit
        can't reach stay; after it, pieces are cut anew until a cut falls where an old one was."""
        at = max(0, min(at, len(code.raw)))
        removed = max(0, min(removed, len(code.raw) - at))
        raw = code.raw[:at] + added + code.raw[at + removed :]
        ends = [*code.starts[1:], len(code.raw)]
        kept = int(np.searchsorted(np.array(code.starts, dtype=np.int64), at))
        while kept and (ends[kept - 1] + 4 * BEYOND > at or code.starts[kept - 1] + 4 * FROM_START > at):
            kept -= 1
        begin = ends[kept - 1] if kept else 0
        delta, old_starts = len(added) - removed, set(code.starts[kept:])
        starts, last, place = code.starts[:kept], code.last[:begin], begin
        for found in self.pieces(raw[begin:].decode(), 256):
            for x in found:
                if place >= at + len(added) and place - delta in old_starts:
                    rest = code.starts.index(place - delta)
                    starts.extend(s + delta for s in code.starts[rest:])
                    last.extend(code.last[place - delta :])
                    return Code(raw, starts, last)
                piece = x.encode()
                known = old = None
                if place in old_starts and place < at:  # the same piece up to the edit
                    known = code.last[place : min(at, ends[code.starts.index(place)], place + len(piece))]
                if place + len(piece) > at + len(added) and (place + len(piece) - delta in old_starts or place + len(piece) == len(raw)):
                    behind = int(np.searchsorted(np.array(code.starts, dtype=np.int64), place + len(piece) - delta)) - 1
                    if behind >= 0 and code.starts[behind] <= at + removed:
                        old = code.last[code.starts[behind] : place + len(piece) - delta]
                starts.append(place)
                last.extend(self.prefixes(piece, known, old, max(0, at + len(added) - place)))
                place += len(piece)
        return Code(raw, starts, last)


@functools.cache
def bpe(path: str, pattern: str) -> Bpe:
    """The coder of a rank file (a line for each token: base64, rank), once a process."""
    with open(path, "rb") as lines:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def _encoded_rows(path: str, pattern: str, with_prefixes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                texts = [t or "" for t in part.column("text").to_pylist()]
                codes = [coder.code(t) for t in texts] if with_prefixes else []
                ids = [coder.ids(c) for c in codes] if with_prefixes else coder.encode_all(texts)
                columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if with_prefixes:
                    columns += [pa.array([c.raw for c in codes], pa.binary()), pa.array([c.starts.tobytes() for c in codes], pa.binary()), pa.array([c.last.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "raw", "starts", "last"][: len(columns)])

    return run


_STATE = "doc_id long, n_tokens long, ids binary, raw binary, starts binary, last binary"


def encode(docs: DataFrame, path: str, pattern: str, with_prefixes: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of docs (doc_id, text), one row for each; other columns are ignored. ids: little-endian
    unsigned 32-bit integers, those of the rank file in ``path`` for each match of ``pattern``, without special tokens.
    With prefixes also raw (the text's bytes), starts (offsets of pieces, 64 bits) and last (the last token of each
    prefix of a piece, 32 bits a byte), from which ``edit`` goes on.

    A null or empty text has no ids; null ids and repeated rows stay. Time grows with a text's length, for one endless
    piece too. A table without rows gives none."""
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encoded_rows(path, pattern, with_prefixes), _STATE if with_prefixes else "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) and decoded, the bytes that the ids stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = pa.array([coder.decode(x or b"") for x in part.column("ids").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_tokens", "ids")), texts], ["doc_id", "n_tokens", "ids", "decoded"])

    return bounded_batches(encoded).select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def edit(encoded: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded (as by ``encode`` with prefixes) after the edits (doc_id, at, removed, added): ``removed`` bytes from byte ``at``
    on give way to the text ``added``; an ``at`` beyond the end, or null, appends. Only what lies near an edit is encoded
    again. Several edits of a document apply from its end backwards, so that all places are those before any edit; ties
    apply in the order of removed and added. Documents without an edit stay; edits of unknown or null ids do nothing, and
    repeated rows of an id are all edited. Places must be those of whole characters and removed stretches apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                for x in batch.slice(lo, 64).to_pylist():
                    code = Code(x["raw"], array("q", x["starts"]), array("i", x["last"]))
                    for e in x["edits"] or []:
                        code = coder.edited(code, e["at"], e["removed"], (e["added"] or "").encode())
                    ids = coder.ids(code)
                    rows.append((x["doc_id"], len(ids) // 4, ids, code.raw, code.starts.tobytes(), code.last.tobytes()))
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_tokens", "ids", "raw", "starts", "last"])

    end = F.lit(2**62)
    one = F.struct(F.coalesce(F.col("at").cast("long"), end).alias("at"), F.coalesce(F.col("removed").cast("long"), F.lit(0)).alias("removed"), F.col("added").cast("string").alias("added"))
    by_doc = edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_list(one), asc=False).alias("edits"))
    return bounded_batches(encoded).join(by_doc, "doc_id", "left").select("doc_id", "raw", "starts", "last", "edits").mapInArrow(run, _STATE)
