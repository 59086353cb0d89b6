"""Files that hold one JSON array: read record by record, written with the published number format.

Reading. Spark's text reader cuts the file at closing braces, so a record is a row as soon as it is read: no file is held
in memory, gzipped files of any size are streamed, and plain ones are read in parallel. Between two braces stand
commas, white space, brackets and nulls, then at most one flat record. Null records are skipped and not counted, as is
white space anywhere. Records are flat: one with an object inside, or a brace inside a string, comes out as text that does not
parse, with nulls in all fields, and never as something else.

Writing. Elements are built as text by column expressions from the schema, whatever it is: numbers with at most ten decimal places,
zeros trimmed, whole ones below 10^15 without a point; nulls written out; strings escaped as JSON wants it. Files are
compact or indented by tabs. Each element ends with a line break, the files in order of their names are the array, and
``single`` makes it one file, by one task that streams what others computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.selection import kept, sent


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``position`` (of records that are not null, from 0; plus 2^32 for every file before by name) and the fields of ``schema``.

    Positions are those of the files' bytes: parts of a file are counted apart and added up in the order of their offsets.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")
    )
    whole = F.concat(F.substring("text", F.instr("text", "{"), F.length("text")), F.lit("}"))
    records = pieces.where(F.contains("text", F.lit("{"))).select("file", "block", "at", F.from_json(whole, schema).alias("record"))
    blocks = kept(records.groupBy("file", "block").agg(F.min("at").alias("first"), (F.max("at") - F.min("at") + 1).alias("n")))  # a row for each part of a file
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.select("file").distinct().withColumn("number", F.row_number().over(Window.orderBy("file")) - 1)
    starts = blocks.join(files, "file").select("file", "block", "first", (F.coalesce(F.sum("n").over(within), F.lit(0)) + F.shiftleft(F.col("number").cast("long"), 32)).alias("start"))
    # pieces of a part follow each other in one task; all but the last of a part, which has no record, have one
    return records.join(sent(starts), ["file", "block"]).select((F.col("start") + F.col("at") - F.col("first")).alias("position"), "record.*")


def number(x: Column) -> Column:
    """A double as text: at most ten places, trailing zeros and point trimmed."""
    ten = F.rtrim(F.rtrim(F.format_string("%.10f", x), F.lit("0")), F.lit("."))
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.format_string("%.0f", x)).otherwise(ten)


def json_text(x: Column, kind: T.DataType, pretty: bool = False, depth: int = 0) -> Column:
    """``x``, of type ``kind``, as JSON. Numbers that are none (NaN, infinite) are null."""
    if isinstance(kind, T.StructType):
        name = lambda f: F.lit(f'{chr(9) * (depth + 1) if pretty else ""}"{f.name}":{chr(9) if pretty else ""}')
        members = [F.concat(name(f), json_text(x[f.name], f.dataType, pretty, depth + 1)) for f in kind.fields]
        line, end = ("\n", "\n" + "\t" * depth) if pretty else ("", "")
        text = F.when(x.isNotNull(), F.concat(F.lit("{" + line), F.concat_ws("," + line, *members), F.lit(end + "}")))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(x, lambda v: json_text(v, kind.elementType, pretty, depth + 1))
        text = F.concat(F.lit("["), F.array_join(items, ", " if pretty else ","), F.lit("]"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        value = x.cast("double")
        text = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), number(value))
    elif isinstance(kind, T.TimestampType):
        text = F.concat(F.lit('"'), F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        text = x.cast("string")
    else:
        quoted = F.to_json(F.array(x.cast("string")))
        text = F.when(x.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return F.coalesce(text, F.lit("null"))


def write_array(rows: DataFrame, path: str, pretty: bool = False, compression: str = "none", single: bool = True) -> None:
    """All rows as one JSON array under ``path``; an empty table gives an empty array."""
    text = json_text(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), rows.schema, pretty, 1 if pretty else 0)
    made = kept(rows.select(text.alias("text"))).withColumn("at", F.monotonically_increasing_id())
    ends = made.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    if ends["first"] is None:
        out = rows.sparkSession.range(1).select(F.lit("[]").alias("value"))
    else:
        before = F.when(F.col("at") == ends["first"], "[").otherwise(", " if pretty else ",")
        out = made.select(F.concat(before, F.col("text"), F.when(F.col("at") == ends["last"], "]").otherwise("")).alias("value"))
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").option("compression", compression).text(path)
