"""Text, SequenceFile and Parquet readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinion_spark.functions.text import strict_long

# The record classes of the SequenceFiles.
WRITABLES = {
    "bigint": "org.apache.hadoop.io.LongWritable",
    "int": "org.apache.hadoop.io.IntWritable",
    "double": "org.apache.hadoop.io.DoubleWritable",
    "string": "org.apache.hadoop.io.Text",
}


# How SequenceFiles are compressed.
COMPRESSED = {
    "mapreduce.output.fileoutputformat.compress": "true",
    "mapreduce.output.fileoutputformat.compress.type": "BLOCK",
    "mapreduce.output.fileoutputformat.compress.codec": "org.apache.hadoop.io.compress.DefaultCodec",
    "zlib.compress.level": "BEST_SPEED",
}


def _paths(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def read_sequence(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Two-column table from SequenceFiles or folders of them.

    Records go from the input format to rows inside the JVM, split where the files have sync marks;
    no Python process sees them. A record of another class than the schema says reads as null.
    """
    struct = T._parse_datatype_string(schema)
    kinds = [f.dataType.simpleString() for f in struct.fields]
    where = ",".join(_paths(path))
    records = spark.sparkContext.sequenceFile(where, *(WRITABLES[k] for k in kinds))
    rows = spark._jvm.SerDeUtil.toJavaArray(records._to_java_object_rdd())
    return DataFrame(spark._jsparkSession.applySchemaToPythonRDD(rows.rdd(), struct.json()), spark)


def write_sequence(df: DataFrame, path: str) -> None:
    """Two-column table to SequenceFiles that the batch jobs can read.

    The record classes follow the column types, a bigint is a LongWritable whatever its size. Rows
    become records inside the JVM and Hadoop's committer moves whole task files, so a task that is lost
    leaves nothing. A null has no record class and fails the job. Records are compressed in blocks with the
    codec every reader of SequenceFiles has; the files still split between blocks.
    """
    jvm, (key, value) = df.sparkSession._jvm, df.dtypes
    encoders = jvm.org.apache.spark.sql.Encoders
    encoder = {"bigint": encoders.LONG, "int": encoders.INT, "double": encoders.DOUBLE, "string": encoders.STRING}
    pairs = getattr(df._jdf, "as")(encoders.tuple(encoder[key[1]](), encoder[value[1]]())).rdd()
    python = jvm.org.apache.spark.api.python
    writable = python.JavaToWritableConverter()
    records = python.PythonHadoopUtil.convertRDD(pairs, writable, writable)
    classes = [_java_class(jvm, WRITABLES[kind]) for kind in (key[1], value[1])]
    tags = [_companion(jvm.scala.reflect, "ClassTag").apply(c) for c in classes]
    output = _java_class(jvm, "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat")
    options = jvm.org.apache.hadoop.conf.Configuration(df.sparkSession._jsc.hadoopConfiguration())
    for name, setting in COMPRESSED.items():
        options.set(name, setting)
    pairs = jvm.org.apache.spark.api.java.JavaPairRDD.fromRDD(records, *tags)
    pairs.saveAsNewAPIHadoopFile(path, *classes, output, options)


def _java_class(jvm, name: str):
    return jvm.java.lang.Class.forName(name)


def _companion(package, name: str):
    return getattr(getattr(package, name + "$"), "MODULE$")


def read_records(
    spark: SparkSession, path: str | list[str], schema: str, fmt: str = "parquet"
) -> DataFrame:
    """Records in one of the supported layouts: ``parquet``, ``sequence`` or ``tsv``."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(*_paths(path))
    if fmt == "sequence":
        return read_sequence(spark, path, schema)
    if fmt == "tsv":
        return read_tsv(spark, path, schema)
    raise ValueError(f"unknown layout {fmt!r}")


def _typed(token: Column, kind: str) -> Column:
    if kind in ("bigint", "int"):
        return strict_long(token).try_cast(kind)
    return token.try_cast(kind)


def read_tsv(spark: SparkSession, path: str | list[str], schema: str, sep: str = "\t") -> DataFrame:
    """Lines with exactly the fields of ``schema``; other lines and bad numbers are left out."""
    fields = T._parse_datatype_string(schema).fields
    tokens = F.split("value", re.escape(sep))
    lines = spark.read.text(_paths(path)).where(F.size(tokens) == len(fields))
    typed = lines.select(
        *[
            _typed(tokens[i], f.dataType.simpleString()).alias(f.name)
            for i, f in enumerate(fields)
        ]
    )
    return typed.dropna()


def write_tsv(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    """``key <tab> value`` lines, unquoted, lists as CSV, in key order with ``order_by``."""
    ordered = df.orderBy(*order_by) if order_by else df
    as_text = [
        F.array_join(F.col(c).cast("array<string>"), ",")
        if kind.startswith("array")
        else F.col(c).cast("string")
        for c, kind in df.dtypes
    ]
    fields = [F.coalesce(c, F.lit("")) for c in as_text]
    ordered.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)


#: Names the parts of a sorted output in order, ``name <tab> first byte <tab> bytes`` each; readers skip it.
ORDER = "_order"


def write_sorted(df: DataFrame, path: str, order_by: list[str]) -> None:
    """``write_tsv`` in key order, with a list of the parts: joined as listed they are the one sorted file.

    Rows are dealt by range, so no task sorts or writes everything. The list is written last and
    renamed into place. A run that finds it does nothing, one that finds parts without it begins anew.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    order = spark._jvm.org.apache.hadoop.fs.Path(folder, ORDER)
    if files.exists(order):
        return
    files.delete(folder, True)
    write_tsv(df, path, order_by)
    found = sorted((s.getPath().getName(), s.getLen()) for s in files.listStatus(folder))
    lines, at = [], 0
    for name, size in found:
        if name.startswith("part-") and size:
            lines.append(f"{name}\t{at}\t{size}\n")
            at += size
    fresh = spark._jvm.org.apache.hadoop.fs.Path(folder, ORDER + ".new")
    out = files.create(fresh, True)
    out.write(bytearray("".join(lines).encode()))
    out.close()
    files.rename(fresh, order)


def sorted_parts(spark: SparkSession, path: str) -> list[str]:
    """The parts of a sorted output in order; an unfinished one fails."""
    order = spark._jvm.org.apache.hadoop.fs.Path(path, ORDER)
    stream = order.getFileSystem(spark._jsc.hadoopConfiguration()).open(order)
    lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()  # one a part
    stream.close()
    return [f"{path.rstrip('/')}/{line.split('\t')[0]}" for line in lines]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)`` of a sorted output, numbered from 1 as in the one sorted file.

    Lines are numbered within their part, which one task wrote; only the number of lines of each part
    is summed over parts.
    """
    parts = sorted_parts(spark, path)
    if not parts:
        return spark.createDataFrame([], "line bigint, value string")
    places = [(part.rsplit("/", 1)[1], i) for i, part in enumerate(parts)]
    order = spark.createDataFrame(places, "name string, part int")
    lines = spark.read.text(parts).select(
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),  # rises within a block
        "value",
    )
    sizes = lines.groupBy("name").agg(F.count("*").alias("lines")).join(order, "name")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    starts = sizes.select("name", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(W.partitionBy("name").orderBy("block", "at"))
    numbered = lines.withColumn("within", within).join(starts, "name")
    return numbered.select((F.col("start") + F.col("within")).alias("line"), "value")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """``(term)``: keyword file, one term per line."""
    return spark.read.text(path).select(F.col("value").alias("term"))


def side_list(pairs: DataFrame) -> DataFrame:
    """``(user_id, value)`` with one row per user; of several values the largest stays."""
    return pairs.groupBy("user_id").agg(F.max("value").alias("value"))
