"""Queries on JSON: paths, selections, slurps, streams of values."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType


def path(record: Column, where: str, kind: str = "string") -> Column:
    """A path of a VARIANT as a type; null where it is missing or doesn't fit."""
    return F.try_variant_get(record, where, kind)


def slurp(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """All values of a key as one array, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(key).agg(F.transform(pairs, lambda x: x[value]).alias("values"))


READ = StructType().add("items", ArrayType(StringType())).add("complete", BooleanType())


@pandas_udf(READ)
def json_values(texts: pd.Series) -> pd.DataFrame:
    """The JSON values that stand one behind the other in each text, compact, keys in their order; complete: whether only
    white space was left. Reading stops where no JSON follows."""
    decoder = json.JSONDecoder()

    def one(text: str | None) -> tuple[list[str], bool]:
        out, at, text = [], 0, text or ""
        while True:
            while at < len(text) and text[at].isspace():
                at += 1
            if at >= len(text):
                return out, True
            try:
                value, at = decoder.raw_decode(text, at)
            except ValueError:
                return out, False
            out.append(json.dumps(value, separators=(",", ":"), ensure_ascii=False))

    return pd.DataFrame([one(t) for t in texts], columns=["items", "complete"])


def stream_values(df: DataFrame, text: str) -> DataFrame:
    """df's other columns with pos (from 1) and value of each JSON value in ``text``, and complete, see json_values."""
    own = df.select(*[c for c in df.columns if c != text], json_values(F.col(text)).alias("_read"))
    others = [c for c in own.columns if c != "_read"]
    return own.select(*others, F.posexplode("_read.items").alias("pos", "value"), F.col("_read.complete").alias("complete")).withColumn("pos", F.col("pos") + 1)
