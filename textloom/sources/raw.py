"""Raw files that are larger than a task: logs of blocks between marks, and delimited files whose fields hold line ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from textloom.sources.scratch import written


def blocks(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """(path, split_start, block) of log files: what stands behind each line that is ``mark``, up to the next one. Files are
    split wherever Spark cuts them, and a block that begins in one task's part is read to its end by that task. What comes
    before the first mark of a file is left out, and so are blocks without text."""
    rows = spark.read.option("lineSep", f"{mark}\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split_start"), F.col("value").alias("block"))
    return rows.where((F.trim("block") != ""))


_LINES = "path string, split_start long, n long, line string, before boolean, after boolean"


def _numbered_lines(quote: str):
    """Lines with n, their number in the part of the file, and whether the part has an odd number of quotes before and after
    each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, odd, n = None, False, 0
        for batch in batches:
            path, start = (batch.column(c).to_pylist() for c in ("path", "split_start"))
            quotes = np.array(pc.count_substring(batch.column("line"), quote).fill_null(0), dtype=np.int64)
            number, before, after = [], [], []
            for p, s, q in zip(path, start, quotes.tolist(), strict=True):
                if (p, s) != at:
                    at, odd, n = (p, s), False, 0
                number.append(n)
                before.append(odd)
                odd ^= bool(q & 1)
                after.append(odd)
                n += 1
            columns = [batch.column("path"), batch.column("split_start"), pa.array(number, pa.int64()), batch.column("line"), pa.array(before, pa.bool_()), pa.array(after, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "split_start", "n", "line", "before", "after"])

    return run


def csv_lines(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(path, record) of delimited files: each record's text, which goes over several lines where a quoted field holds line
    feeds. Any part of a file can be read by itself: the parity of quotes in each part, put together in the order of the
    parts, says whether the next begins inside a field. The files are read once and their lines stored with their part, as
    Spark may cut files otherwise when it reads them again (parts depend on the cores there are). Records on one line stay
    where they are read; only the lines of others are shuffled, by record. A field that is never closed ends with the file.
    Lines ends are line feeds."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split_start"), F.col("value").alias("line"))
    lines = written(lines.mapInArrow(_numbered_lines(quote), _LINES))
    parts = lines.groupBy("path", "split_start").agg(F.max_by(F.col("after").cast("int"), "n").alias("odd"))  # one row for each part of a file
    before = Window.partitionBy("path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("path", "split_start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # The parts' table has a row for every hundred megabytes or so: the join keeps the lines where they were read. opens and
    # whole: whether a record begins, and ends, with the line.
    marked = lines.join(F.broadcast(parts), ["path", "split_start"])
    marked = marked.select("path", "split_start", "n", "line", (F.col("before") == F.col("inside")).alias("opens"), (F.col("after") == F.col("inside")).alias("whole"))
    alone = marked.where("opens and whole").select("path", F.col("line").alias("record"))
    # Lines of longer records: the record is named by the place of its first line, the last one that opens so far; where that
    # lies in an earlier part, the parts' own last openings tell.
    some = marked.where("not (opens and whole)")
    place = F.struct("split_start", "n")
    so_far = Window.partitionBy("path", "split_start").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    own = some.withColumn("first", F.last(F.when(F.col("opens"), place), ignorenulls=True).over(so_far))
    last = some.groupBy("path", "split_start").agg(F.max(F.when(F.col("opens"), place)).alias("last"))
    carried = last.select("path", "split_start", F.last("last", ignorenulls=True).over(before).alias("carried"))
    own = own.join(carried, ["path", "split_start"], "left").withColumn("first", F.coalesce("first", "carried"))
    longer = own.groupBy("path", "first").agg(F.array_sort(F.collect_list(F.struct("split_start", "n", "line"))).alias("parts"))
    return alone.union(longer.select("path", F.array_join(F.transform("parts", lambda x: x["line"]), "\n").alias("record")))


#: A character for private use that stands before another one: for a NUL, which Spark's parser takes for no character, for
#: itself, and for a field that isn't there.
_MARK, _NUL, _SELF, _NOTHING = "\ue000", "\ue000n", "\ue000m", "\ue000-"


def csv_records(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", quote: str = '"', header: str | None = None) -> DataFrame:
    """The fields of delimited files whose quoted fields may hold separators, doubled quotes and line feeds, see csv_lines;
    records equal to ``header`` and empty ones are left out. A field without any characters is null, one of two quotes is an
    empty text."""
    types = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = csv_lines(spark, path, quote).where(F.col("record") != "")
    rows = rows if header is None else rows.where(F.col("record") != header)
    odd = F.col("record").contains("\0") | F.col("record").contains(_MARK)
    safe = F.replace(F.replace("record", F.lit(_MARK), F.lit(_SELF)), F.lit("\0"), F.lit(_NUL))
    rows = rows.select(odd.alias("odd"), F.when(odd, safe).otherwise(F.col("record")).alias("record"))
    options = {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true", "nullValue": _NOTHING}
    rows = rows.select("odd", F.from_csv("record", types.simpleString(), options).alias("f"))
    plain = lambda c: F.replace(F.replace(c, F.lit(_NUL), F.lit("\0")), F.lit(_SELF), F.lit(_MARK))
    field = lambda c: F.col("f").getField(c.name)
    return rows.select(*[(F.when(F.col("odd"), plain(field(c))).otherwise(field(c)) if c.dataType == StringType() else field(c)).alias(c.name) for c in types])
