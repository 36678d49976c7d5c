"""Sources whose rows depend on the files they come from, and binary records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered, running_sums
from ..storage import scratch as scratch  # noqa: PLC0414  part of this module's interface
from . import audio


def table(spark: SparkSession, path: str, columns: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Some columns of CSV files with a header, under new names; columns declares name and type of those wanted."""
    wanted = spark.createDataFrame([], columns).schema
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(f.name).cast(f.dataType).alias((rename or {}).get(f.name, f.name)) for f in wanted])


def with_origin(df: DataFrame, name: str = "origin") -> DataFrame:
    """The name of the file that each row comes from; to be called on the read itself."""
    return df.withColumn(name, F.element_at(F.split(F.input_file_name(), "/"), -1))


def attribute_of_file(spark: SparkSession, paths: list[str], pattern: str, schema: str = "key string") -> DataFrame:
    """Key, attribute: what a pattern finds in the name of the file that lists the key; of several files the last wins."""
    out = None
    for at, path in enumerate(paths):
        df = spark.read.schema(schema).csv(path).select("key", F.lit(at).alias("at"), F.regexp_extract(F.input_file_name(), pattern, 1).alias("attribute"))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("key").agg(F.max_by("attribute", "at").alias("attribute"))


def sampled_metadata(df: DataFrame, label: str, key: str, seed: str, per_label: int, *metadata: Column) -> DataFrame:
    """Label, key and metadata of so many rows a label, those of least hash; only their metadata is read."""
    rows = df.withColumn("_u", F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long"))
    return numbered(rows, [label], "_u", [key]).where(F.col("position") <= per_label).select(label, key, *metadata)


def packed(rows: DataFrame, key: str, values: str) -> DataFrame:
    """Key, record, n: arrays of 0 to 255 as bytes."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
            sizes = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary()), pa.array(sizes.astype(np.int32))], [key, "record", "n"])

    return rows.select(key, F.coalesce(F.col(values), F.array()).cast("array<int>").alias(values)).mapInArrow(run, f"{key} {kind}, record binary, n int")


def unpacked(rows: DataFrame, key: str, record: str = "record") -> DataFrame:
    """Key, values: the bytes of a record as an array of 0 to 255."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            parts = b.column(1).to_pylist()
            sizes = np.array([len(x or b"") for x in parts], np.int32)
            flat = np.frombuffer(b"".join(x or b"" for x in parts), np.uint8).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))], [key, "values"])

    return rows.select(key, record).mapInArrow(run, f"{key} {kind}, values array<int>")


def indexed(records: DataFrame, key: str, chunk: str) -> DataFrame:
    """Adds offset, where each record begins in its chunk's blob in the order of the key."""
    sums = running_sums(records, [chunk], key, {"upto": F.octet_length("record").cast("long")})
    return sums.withColumn("offset", F.col("upto") - F.octet_length("record")).drop("upto", "upto_total")


def blobs(index: DataFrame, key: str, chunk: str) -> DataFrame:
    """Chunk, blob: the records of a chunk one after another. A chunk is one value and has to fit in one."""
    cells = F.array_sort(F.collect_list(F.struct("offset", "record")))
    return index.groupBy(chunk).agg(cells.alias("cells")).select(chunk, F.unhex(F.array_join(F.transform("cells", lambda c: F.hex(c["record"])), "")).alias("blob"))


def read_records(index: DataFrame, blob: DataFrame, key: str, chunk: str) -> DataFrame:
    """Key, record: read back by offset and length."""
    both = index.select(key, chunk, "offset", F.octet_length("record").alias("n")).join(blob, chunk)
    return both.select(key, F.expr("substring(blob, cast(offset as int) + 1, n)").alias("record"))


def verified(records: DataFrame, again: DataFrame, key: str, rate: float = 0.1) -> DataFrame:
    """n_checked, n_equal: records of a sample (by crc32 of the key) against records made anew, byte for byte."""
    drawn = F.crc32(F.col(key).cast("string").cast("binary")) % 1000 < int(rate * 1000)
    both = records.where(drawn).select(key, "record").join(again.select(key, F.col("record").alias("_again")), key, "left")
    return both.agg(F.count("*").alias("n_checked"), F.coalesce(F.sum(F.col("record").eqNullSafe(F.col("_again")).cast("long")), F.lit(0)).alias("n_equal"))


def append_missing(spark: SparkSession, rows: DataFrame, path: str, key: str, by: str) -> int:
    """Adds the rows whose key the store lacks, partitioned by a column, and returns the store's rows; a run that was cut
    short is taken up where it stopped."""
    try:
        there = spark.read.parquet(path).select(key)
        rows = rows.join(there, key, "left_anti")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").partitionBy(by).parquet(path)
    return spark.read.parquet(path).count()


def summary(df: DataFrame, path: str, by: str, **parts: list[str]) -> None:
    """For each row a JSON object with the columns in nested objects."""
    nested = [F.struct(*columns).alias(name) for name, columns in parts.items()]
    df.select(F.to_json(F.struct(by, *nested))).coalesce(1).write.mode("overwrite").text(path)


def wav(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """Path, rate, samples (mono, -1 to 1), error of PCM files at their own rate; audio.files reads FLAC too, and resamples."""
    return audio.files(spark, path, pattern, None)


def markdown(df: DataFrame, title: str, digits: int = 4, most: int = 10_000) -> str:
    """A small result as a Markdown table; one of more rows than that is refused."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    found = df.take(most + 1)
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no report's table")
    rows = [[show(v) for v in r] for r in found]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([f"## {title}", "", line(df.columns), line(["---"] * len(df.columns)), *map(line, rows), ""])
