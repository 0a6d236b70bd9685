import hashlib
import zlib

from helpers import ODD, frame

from textloom.llm import transport_stream as T


def test_round_trip(spark):
    rows = [*ODD, (9, "x" * 63), (10, "y" * 64), (11, "é" * 100_000)]
    for r in T.from_streams(T.to_streams(frame(spark, rows))).collect():
        text = next(t for i, t in rows if i == r.doc_id and len((t or "").encode()) == r.n_bytes)
        own = {(t or "").encode() for i, t in rows if i == r.doc_id}
        want = {b.ljust(max(1, -(-len(b) // 64)) * 64, b"\0") for b in own}
        assert bytes(r.payload) in want and len(r.payload) % 64 == 0
        assert len(r.media) % T.PACKET == 0 and r.counter_errors == 0
        assert "programs=1;streams=256:6" in r.feature
        assert len(r.points) == -(-len(r.payload) // T.UNIT_BYTES)
        assert [p.pts for p in r.points] == [i * T.UNIT_TICKS for i in range(len(r.points))]
        assert text is None or r.n_bytes == len(text.encode())


def test_every_length_around_a_packet():
    for n in (0, 1, 150, 151, 161, 162, 163, 175, 176, 177, 345, 346, 347, 348, 183 * 3, 184 * 4, T.UNIT_BYTES, T.UNIT_BYTES + 1):
        data = bytes(i * 7 % 251 for i in range(n))
        got = T.read_stream(T.write_stream(data))
        assert got["payload"] == data and got["counter_errors"] == 0, n


def test_faults_are_counted():
    media = T.write_stream(bytes(5000))
    lost = media[: 188 * 6] + media[188 * 7 :]
    assert T.read_stream(lost)["counter_errors"] >= 1
    repeated = media[: 188 * 7] + media[188 * 6 : 188 * 7] + media[188 * 7 :]
    assert T.read_stream(repeated)["payload"] == bytes(5000) and T.read_stream(repeated)["counter_errors"] == 0
    bad = bytearray(media)
    bad[188 * 6] = 0
    assert T.read_stream(bytes(bad))["counter_errors"] >= 1
    bad = bytearray(media)
    bad[12] ^= 1
    assert T.read_stream(bytes(bad))["programs"] == []
    assert T.read_stream(b"")["payload"] == b"" and T.read_stream(b"abc")["counter_errors"] == 1


def test_checksum_and_digests(spark):
    assert T.section_crc(b"123456789") == 0x0376E6E7
    import textloom.llm.entries as E

    rows = E.op4_transport_stream(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        b = texts[r.doc_id].encode()
        p = b.ljust(-(-len(b) // 64) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_empty_table(spark):
    assert T.from_streams(T.to_streams(frame(spark, []))).count() == 0
