"""Raw files read in many parts."""

import csv
import random
from pathlib import Path

import pytest

from textloom.sources.raw import blocks, csv_lines, csv_records
from textloom.sources.tables import json_document

PARTS = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"


@pytest.fixture(params=[37, 200, 1 << 20])
def small_parts(spark, request):
    old = {k: spark.conf.get(k, None) for k in PARTS}
    spark.conf.set(PARTS[0], str(request.param))
    spark.conf.set(PARTS[1], "0")
    spark.conf.set(PARTS[2], "1")
    yield request.param
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_blocks_over_parts(spark, small_parts, tmp_path):
    r, want = random.Random(1), []
    for f in range(2):
        text = "noise\n"
        for i in range(25):
            body = f"file {f} block {i}\n" + "".join(r.choice("ab>\n é") for _ in range(r.randint(0, 90))) + "\nend\n"
            text += ">>>MARK<<<\n" + body
            want.append(body)
        Path(tmp_path, f"{f}.log").write_text(text)
    rows = blocks(spark, str(tmp_path), ">>>MARK<<<").collect()
    assert sorted(x.block for x in rows if not x.block.startswith("noise")) == sorted(want)
    if small_parts == 37:
        assert len({(x.path, x.split_start) for x in rows}) > 10


def test_records_over_lines_and_parts(spark, small_parts, tmp_path):
    r, want = random.Random(2), []
    for f in range(3):
        with open(tmp_path / f"{f}.csv", "w", newline="") as out:
            rows = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
            rows.writerow(["id", "a", "b"])
            for i in range(40):
                field = lambda n: "".join(r.choice(['x', '"', ",", "\n", "é", " ", "y\nz"]) for _ in range(r.randint(0, n)))
                row = (1000 * f + i, "q" + field(6), "w" + field(400 if i == 7 else 12))
                rows.writerow(row)
                want.append(row)
    got = [tuple(x) for x in csv_records(spark, str(tmp_path), "id int, a string, b string", header="id,a,b").collect()]
    assert sorted(got) == sorted(want)


def test_open_fields_and_empty_files(spark, small_parts, tmp_path):
    Path(tmp_path, "a.csv").write_text('1,"never\nclosed\n2,b\n')
    Path(tmp_path, "b.csv").write_text("")
    Path(tmp_path, "c.csv").write_text('3,"x"\n\n4,y')
    got = sorted(x.record for x in csv_lines(spark, str(tmp_path)).collect())
    assert got == ["", '1,"never\nclosed\n2,b', '3,"x"', "4,y"]


def test_whole_documents(spark):
    rows = spark.createDataFrame([('{"a": [1]}',), ("",), ("  ",), (None,)], "t string")
    assert [x[0] for x in rows.select(json_document(rows.t).cast("string")).collect()] == ['{"a":[1]}', None, None, None]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        spark.createDataFrame([("{broken",)], "t string").select(json_document(rows.t)).collect()


def test_files_are_cut_once(spark, tmp_path):
    """Spark may cut files otherwise when it reads them again, as it does when cores come or go: no later step reads them."""
    Path(tmp_path, "a.csv").write_text('1,"x\ny"\n2,z\n')
    rows = csv_lines(spark, str(tmp_path))
    assert "a.csv" not in " ".join(rows.inputFiles()) and sorted(x.record for x in rows.collect()) == ['1,"x\ny"', "2,z"]


def test_nulls_and_odd_characters_in_fields(spark, tmp_path):
    """A field of two quotes is an empty text and none at all a null; NULs before quotes and private characters stay."""
    texts = ["", "\0", '\0"\0', 'x\\\0"y', "", "n", "-", "\0-", "a\r\nb", "\r", '"', "x" * 1_200_000, "plain"]
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    with open(tmp_path / "a.csv", "w", newline="") as out:
        out.write("".join(f"{i},{quoted(t)},w\n" for i, t in enumerate(texts)) + ',"no id",w\n98,,w\n99,"x",\n')
    got = {x.id: (x.a, x.b) for x in csv_records(spark, str(tmp_path), "id int, a string, b string").collect()}
    assert got == {i: (t, "w") for i, t in enumerate(texts)} | {None: ("no id", "w"), 98: (None, "w"), 99: ("x", None)}


def test_csv_query_on_odd_documents(spark, tmp_path):
    import hashlib

    from textloom.plans import run

    odd = [None, "", "a,b", 'a"b', " en ", "e\nn", "en"]
    rows = [(i, "t\nu", lang, "s") for i, lang in enumerate(odd)] + [(10, "", "en", "s"), (11, "t", "en", None), (12, "t", "en", 'q"\n'), (None, "t", None, None), (13, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, lang, hashlib.md5(t.encode()).hexdigest(), None if s is None else f'x, "{s}"') for i, t, lang, s in rows if t is not None]
    got = map(tuple, run(spark, "csv_multiline", str(tmp_path)).collect())
    assert sorted(got, key=repr) == sorted(want, key=repr)
