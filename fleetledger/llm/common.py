"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.session import scratch

#: The characters that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: later steps start from that copy.

    The table survives lost executors and is computed once, however often it is used.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where df has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def split_matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """The texts between the matches (one more than matches), and the matches, leftmost and non-overlapping."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans_of(text: Column, pattern: str, context: int = 0) -> Column:
    """array<struct<s,e,m,pre,post>>: the code points where each match starts and ends, the match, what stands around it.

    Both lists come from one left-to-right pass each, so positions are running sums of their lengths. A null text has
    no spans.
    """
    gaps, found = split_matches(text, pattern)
    kind = "struct<at:int,out:array<struct<s:int,e:int,m:string,pre:string,post:string>>>"
    zipped = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    after = F.zip_with(zipped, F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))), lambda z, g: F.struct(z["g"].alias("g"), z["m"].alias("m"), g.alias("n")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), (F.right(x["g"], F.lit(context)) if context else F.lit("")).alias("pre"), (F.left(x["n"], F.lit(context)) if context else F.lit("")).alias("post"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")).cast(kind)

    zero = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)
    return F.coalesce(F.aggregate(F.filter(after, lambda x: x["m"].isNotNull()), zero, add)["out"], F.array().cast("array<struct<s:int,e:int,m:string,pre:string,post:string>>"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches, which Spark bounds in bytes, in parts of at most so many rows, which bounds what Python makes of them at one time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
