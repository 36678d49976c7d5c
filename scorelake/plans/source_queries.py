"""Queries that write files with the sinks and read them back with the sources, and SQL over the tables they were made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model
from ..sources import files, text
from ..streaming import batches
from .metric_queries import BASE, with_
from .sql import duckdb


def q_protocol_parse(s, d):
    """Header-less files of two origins, read as one and tagged."""
    path = files.scratch(s, "protocol")
    c = model.read(s, d, "customer")
    line = lambda df: df.select(F.concat_ws(" ", F.concat(F.lit("S"), F.col("c_nationkey")), "c_name", F.lit("e1"), F.lit("-"), "c_mktsegment"))
    for origin, part in (("train.trn.txt", "c_acctbal >= 0"), ("dev.trl.txt", "c_acctbal < 0")):
        line(c.where(part)).write.text(f"{path}/{origin}")
    df = text.protocol(s, [f"{path}/train.trn.txt", f"{path}/dev.trl.txt"], "speaker_id string, filename string, env_id string, attack_id string, label string", source="2019")
    origin = F.regexp_extract(F.input_file_name(), r"/([a-z]+)\.tr[nl]\.txt/", 1)
    return df.withColumn("split", origin)


def q_enrollment_explode(s, d):
    """Ragged lines; a row a file."""
    path = files.scratch(s, "enrolment")
    c = model.read(s, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("c_name")), ",").alias("names"))
    c.select(F.concat(F.lit("SPK_"), F.col("c_nationkey"), F.lit("_ENV "), "names", F.lit("\n"))).write.text(path)
    return text.enrolment(s, path)


def q_score_txt_roundtrip(s, d):
    """K03, S08."""
    path = files.scratch(s, "scores")
    text.write_scores(model.read(s, d, "events"), path, "event_id", "value")
    return text.scores(s, path)


def q_csv_table(s, d):
    """Three columns of a CSV table, renamed."""
    path = files.scratch(s, "table")
    text.write_table(model.read(s, d, "part"), path)
    return files.table(s, path, "p_partkey long, p_brand string, p_retailprice double", {"p_retailprice": "price"})


def q_json_summary(s, d):
    """Nested objects, written and read again."""
    path = files.scratch(s, "summary")
    o = model.read(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("most"))
    files.summary(o, path, "o_orderpriority", counts=["n"], prices=["mean", "most"])
    kind = "o_orderpriority string, counts struct<n:bigint>, prices struct<mean:double,most:double>"
    return s.read.text(path).select(F.from_json("value", kind).alias("v")).select("v.o_orderpriority", "v.counts.n", "v.prices.mean", "v.prices.most")


def q_aligned_zip(s, d):
    """Two files by line number."""
    path = files.scratch(s, "zip")
    p = model.read(s, d, "part").orderBy("p_partkey")  # files by name keep the order
    p.select("p_name").write.text(f"{path}/a")
    p.select(F.col("p_retailprice").cast("string")).write.text(f"{path}/b")
    z = text.zipped(s, f"{path}/a", f"{path}/b")
    return z.select("n", F.col("left").alias("name"), F.col("right").cast("double").alias("price"))


def q_attribute_of_file(s, d):
    """An attribute from the name of the file that lists the key; the last file wins."""
    path = files.scratch(s, "lists")
    c = model.read(s, d, "customer")
    c.where("c_custkey % 2 = 0").select("c_name").write.csv(f"{path}/spk_female.lst")
    c.where("c_custkey % 3 = 0").select("c_name").write.csv(f"{path}/spk_male.lst")
    return files.attribute_of_file(s, [f"{path}/spk_female.lst", f"{path}/spk_male.lst"], r"spk_(\w+)\.lst")


def q_sampled_metadata(s, d):
    """Lengths of a stratified sample of documents."""
    return files.sampled_metadata(model.read(s, d, "documents").where("lang is not null"), "lang", "doc_id", ":meta", 25, F.col("n_chars"), (F.col("n_chars") * 0.016).alias("seconds"))


def quantised(s, d):
    v = F.expr("transform(embedding, v -> cast(least(greatest(rint((cast(v as double) * 100 - 40 + 80) / 80 * 255), 0D), 255D) as int))")
    return model.read(s, d, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("chunk"), v.alias("values"))


def q_records(s, d):
    """Arrays as bytes in blobs with an index, read back by offset."""
    q = quantised(s, d)
    index = files.indexed(files.packed(q, "vec_id", "values").join(q.select("vec_id", "chunk"), "vec_id"), "vec_id", "chunk")
    back = files.unpacked(files.read_records(index, files.blobs(index, "vec_id", "chunk"), "vec_id", "chunk"), "vec_id")
    total = F.aggregate("values", F.lit(0), lambda a, b: a + b)
    out = back.select("vec_id", F.size("values").alias("n"), total.alias("total"), F.get("values", F.lit(5)).alias("sixth"))
    return out.join(index.select("vec_id", "chunk", "offset"), "vec_id")


def q_verified_records(s, d):
    """A sample of records made anew, byte for byte."""
    r = files.packed(quantised(s, d), "vec_id", "values")
    path = files.scratch(s, "records")
    r.write.parquet(path)
    return files.verified(s.read.parquet(path), r, "vec_id", 0.2)


def q_frame_store(s, d):
    """A store that takes up where a run stopped."""
    path = files.scratch(s, "frames")
    e = model.read(s, d, "embeddings").select("vec_id", "label", F.size("embedding").alias("n"))
    files.append_missing(s, e.where("vec_id % 5 < 2"), path, "vec_id", "label")
    files.append_missing(s, e, path, "vec_id", "label")
    return s.read.parquet(path).groupBy("label").agg(F.count("*").alias("n_records"), F.sum("n").alias("n_frames"))


def q_resumable_scoring(s, d):
    """Batches scored once, failures as data, in two runs."""
    path = files.scratch(s, "batches")
    e = model.read(s, d, "events").select(F.col("event_id").alias("filename"), "value")
    score = lambda df: df.withColumn("score", F.sqrt("value")).withColumn("error", F.when(F.col("value") > 200, "too large"))
    for part in ("filename % 2 = 0", "filename % 2 = 1"):
        e.where(part).repartition(3).write.mode("append").parquet(f"{path}/in")
        batches.run_available(s, f"{path}/in", "filename long, value double", score, f"{path}/out", f"{path}/state", accept_failures=True, files_per_batch=2)
    done = s.read.parquet(f"{path}/out/scored").select("filename", F.lit(True).alias("ok"), F.round("score", 6).alias("score"))
    failed = s.read.parquet(f"{path}/out/failed").select("filename", F.lit(False).alias("ok"), F.lit(None).cast("double").alias("score"))
    return done.unionByName(failed)


QUANTISED = "q AS (SELECT vec_id, vec_id % 7 AS chunk, list_transform(embedding, lambda v: CAST(LEAST(GREATEST(round_even((CAST(v AS DOUBLE) * 100 - 40 + 80) / 80 * 255, 0), 0), 255) AS INT)) AS x FROM embeddings)"
Q = {
    "q_protocol_parse": (q_protocol_parse, "SELECT 'S' || c_nationkey AS speaker_id, c_name AS filename, 'e1' AS env_id, '-' AS attack_id, c_mktsegment AS label, '2019' AS source, CASE WHEN c_acctbal >= 0 THEN 'train' ELSE 'dev' END AS split FROM customer"),
    "q_enrollment_explode": (q_enrollment_explode, "SELECT 'SPK_' || c_nationkey AS speaker_id, 'ENV' AS env_id, c_name AS filename FROM customer"),
    "q_score_txt_roundtrip": (q_score_txt_roundtrip, "SELECT CAST(event_id AS VARCHAR) AS filename, CAST(printf('%.6f', value) AS DOUBLE) AS score FROM events WHERE value IS NOT NULL"),
    "q_csv_table": (q_csv_table, "SELECT p_partkey, p_brand, p_retailprice AS price FROM part"),
    "q_json_summary": (q_json_summary, "SELECT o_orderpriority, COUNT(*) AS n, ROUND(AVG(o_totalprice), 4) AS mean, MAX(o_totalprice) AS most FROM orders GROUP BY 1"),
    "q_aligned_zip": (q_aligned_zip, "SELECT ROW_NUMBER() OVER (ORDER BY p_partkey) - 1 AS n, p_name AS name, p_retailprice AS price FROM part"),
    "q_attribute_of_file": (q_attribute_of_file, "SELECT c_name AS key, CASE WHEN c_custkey % 3 = 0 THEN 'male' ELSE 'female' END AS attribute FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"),
    "q_sampled_metadata": (q_sampled_metadata, "SELECT lang, doc_id, n_chars, n_chars * CAST(0.016 AS DOUBLE) AS seconds FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY {{U32:concat({{STR:doc_id}}, ':meta')}}, doc_id) AS r FROM documents WHERE lang IS NOT NULL) x WHERE r <= 25"),
    "q_records": (q_records, f"WITH {QUANTISED} SELECT vec_id, CAST(len(x) AS INT) AS n, CAST(list_sum(x) AS INT) AS total, x[6] AS sixth, chunk, CAST(SUM(len(x)) OVER (PARTITION BY chunk ORDER BY vec_id) - len(x) AS BIGINT) AS \"offset\" FROM q"),
    "q_frame_store": (q_frame_store, "SELECT label, COUNT(*) AS n_records, CAST(SUM(len(embedding)) AS BIGINT) AS n_frames FROM embeddings GROUP BY label"),
    "q_resumable_scoring": (q_resumable_scoring, "SELECT event_id AS filename, NOT coalesce(value > 200, false) AS ok, CASE WHEN coalesce(value > 200, false) THEN NULL ELSE ROUND(SQRT(value), 6) END AS score FROM events"),
}
QUERIES = {k: v[0] for k, v in Q.items()} | {"q_verified_records": q_verified_records}
ORACLE_SQL = {k: duckdb(v[1]) for k, v in Q.items()}
