import base64
import random

import public_tokenizers
import tiktoken
from helpers import ODD, frame, words

from textloom.llm.byte_bpe import Code, bpe, decode, edit, encode, newer_characters

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = "aabcdeeétté ßÄöñ  \n\t'srvml0123½。你好мир\U0001f600́ 　 \x1c\x1f.,-'\"\r"


def plain():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


PLAIN = plain()


def ids(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def texts(seed, n, most):
    r = random.Random(seed)
    for _ in range(n):
        kind = r.random()
        if kind < 0.4:
            yield "".join(r.choice(ALPHABET) for _ in range(r.randint(0, most)))
        elif kind < 0.7:
            yield "".join(PLAIN.decode([r.randrange(50_000)]) for _ in range(r.randint(0, most // 4)))
        elif kind < 0.85:
            yield r.choice(["a", "ab", " ", "\n", "0", "=", "é", "ha"]) * r.randint(0, 3 * most)
        else:
            yield "".join(chr(r.choice([r.randrange(0x20, 0xD800), r.randrange(0x20, 0x600), r.randrange(0xE000, 0x20000)])) for _ in range(r.randint(0, most)))


def test_ids_are_those_of_the_library():
    coder = bpe(PATH, PATTERN)
    for text in texts(1, 3000, 60):
        assert ids(coder.encode(text)) == PLAIN.encode_ordinary(text), repr(text)
        assert coder.ids(coder.code(text)) == coder.encode(text)
        assert coder.decode(coder.encode(text)) == text.encode()


def test_tokens_and_characters_of_all_kinds():
    coder = bpe(PATH, PATTERN)
    for i in range(0, 50_256, 7):
        text = coder.bytes_of[i].decode("utf-8", "ignore")
        assert ids(coder.encode(text)) == PLAIN.encode_ordinary(text), repr(text)
    characters = [*newer_characters()[::9], *map(chr, [*range(0x3000), *range(0x3000, 0xD800, 61), *range(0xE000, 0x110000, 97)])]
    for lo in range(0, len(characters), 512):
        for lead in (" x", "1", "!"):
            text = lead.join(characters[lo : lo + 512])
            assert ids(coder.encode(text)) == PLAIN.encode_ordinary(text), (lead, lo)


def test_windows_cut_where_matches_do():
    coder = bpe(PATH, PATTERN)
    for text in texts(2, 400, 80):
        for window in (1, 2, 3, 5, 17):
            assert [x for found in coder.pieces(text, window) for x in found] == [x for found in coder.pieces(text) for x in found]


def test_appends_and_edits_equal_encoding_anew():
    coder, r = bpe(PATH, PATTERN), random.Random(3)
    for text, added in zip(texts(4, 1500, 120), texts(5, 1500, 12), strict=True):
        at = r.randint(0, len(text))
        removed = r.choice([0, 0, 1, 3, 20])
        code = coder.code(text)
        head, gone = text[:at], text[at : at + removed]
        got = coder.edited(code, len(head.encode()), len(gone.encode()), added.encode())
        want = coder.code(head + added + text[at + removed :])
        assert (got.raw, got.starts, got.last) == (want.raw, want.starts, want.last), (text, at, removed, added)
        grown = coder.edited(code, 1 << 62, 0, added.encode())
        assert grown == coder.code(text + added)


def test_edits_near_the_end_of_a_long_piece_touch_little(monkeypatch):
    coder = bpe(PATH, PATTERN)
    text = "abcab" * 40_000
    code, seen = coder.code(text), []
    fits = coder.fits
    monkeypatch.setattr(coder, "fits", lambda a, b: seen.append(1) or fits(a, b))
    got = coder.edited(code, 100_000, 1, b"zz")
    assert len(seen) < 5000
    assert got == coder.code(text[:100_000] + "zz" + text[100_001:])


def test_each_prefix_ends_in_its_last_token():
    coder = bpe(PATH, PATTERN)
    piece = "Donaudampfschifffahrtsgesellschaft".encode()
    last = coder.prefixes(piece)
    for n in range(1, len(piece) + 1):
        assert [coder.bytes_of[t] for t in coder._tokens(last, 0, n)] == coder._merged(piece[:n])


def test_frames_with_odd_rows_and_long_texts(spark):
    long = " ".join(words(8, 80_000)) + "x" * 300_000
    rows = [*ODD, (9, long), (10, "a" * 50_000)]
    coded = encode(frame(spark, rows), PATH, PATTERN)
    got = sorted(((x.doc_id, x.n_tokens, bytes(x.ids), bytes(x.decoded)) for x in decode(coded, PATH, PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        tokens = [] if t is None else PLAIN.encode_ordinary(t[:1_000]) if len(t) < 1_000 else ids(bpe(PATH, PATTERN).encode(t))
        want.append((i, len(tokens), b"".join(x.to_bytes(4, "little") for x in tokens), (t or "").encode()))
    assert got == sorted(want, key=str)
    assert encode(frame(spark, []), PATH, PATTERN).collect() == []
    assert PLAIN.decode(ids(bpe(PATH, PATTERN).encode(long))) == long


def test_edits_of_a_table(spark):
    rows = [(1, "one two three"), (2, None), (3, "äö"), (4, "stays")]
    coded = encode(frame(spark, rows), PATH, PATTERN, with_prefixes=True)
    edits = spark.createDataFrame([(1, 4, 3, "2"), (1, None, 0, " four"), (2, 0, 0, "new"), (3, 2, 2, None), (9, 0, 0, "x"), (None, 0, 0, "x")], "doc_id long, at long, removed long, added string")
    got = {x.doc_id: (bytes(x.raw).decode(), ids(x.ids)) for x in edit(coded, edits, PATH, PATTERN).collect()}
    want = {1: "one 2 three four", 2: "new", 3: "ä", 4: "stays"}
    assert got == {i: (t, PLAIN.encode_ordinary(t)) for i, t in want.items()}
    assert Code(b"", *(bpe(PATH, PATTERN).code("").__dict__[k] for k in ("starts", "last"))) == bpe(PATH, PATTERN).code("")
