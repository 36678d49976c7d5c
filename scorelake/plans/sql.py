"""SQL templates for two engines: one text, with tables in [name] and what the engines spell differently in {{NAME:args}}."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: What each engine calls things: (Spark, DuckDB); %1, %2 are arguments.
SPELLED = {
    "K": ("cast(get_json_object(props, '$.k') as int)", "cast(json_extract_string(props, '$.k') as int)"),
    "U32": ("cast(conv(substr(md5(%1), 1, 8), 16, 10) as bigint)", "cast('0x' || substr(md5(%1), 1, 8) as bigint)"),
    "STR": ("cast(%1 as string)", "cast(%1 as varchar)"),
    "JOINED": ("listagg(%1, ',') WITHIN GROUP (ORDER BY %2)", "string_agg(%1, ',' ORDER BY %2)"),
    "MAP": ("transform(%1, %2 -> %3)", "list_transform(%1, lambda %2: %3)"),
    "SUM": ("aggregate(%1, cast(0 as double), (a, b) -> a + b)", "list_sum(%1)"),
    "CUT": ("slice(%1, %2 + 1, %3)", "(%1)[%2 + 1:%2 + %3]"),
    "SEQ": ("sequence(0, %1 - 1)", "range(%1)"),
    "TILE": ("flatten(array_repeat(%1, %2))", "flatten(list_transform(range(%2), lambda i: %1))"),
    "CAT": ("concat(%1, %2)", "list_concat(%1, %2)"),
    "ZEROS": ("array_repeat(cast(0 as double), %1)", "list_transform(range(%1), lambda zz: cast(0 as double))"),
    "RINT": ("rint(%1)", "round_even(%1, 0)"),
    "ARR": ("array(%1)", "[%1]"),
    "TXT": ("string", "varchar"),
    "PCT": ("percentile(%1, %2)", "quantile_cont(%1, %2)"),
    "PAD": ("format_string('%05d', cast(%1 as int))", "printf('%05d', cast(%1 as int))"),
    "FIX6": ("format_string('%.6f', %1)", "printf('%.6f', %1)"),
    "AT": ("get(%1, %2)", "%1[%2 + 1]"),
    "LEN": ("size(%1)", "len(%1)"),
    "EXPL": ("explode(%1)", "unnest(%1)"),
}


def spelled(text: str, engine: int) -> str:
    def one(m):
        name, _, args = m[1].partition(":")
        out = SPELLED[name][engine]
        for i, a in enumerate(re.split(r"(?<!\|)\|(?!\|)", args), 1):
            out = out.replace(f"%{i}", a) if a else out
        return out

    while "{{" in text:
        text = re.sub(r"\{\{((?:(?!\{\{|\}\}).)*)\}\}", one, text)
    return text


def duckdb(text: str) -> str:
    return re.sub(rf"\[({'|'.join(TABLES)})\]", r"\1", spelled(text, 1))


def spark(text: str):
    """A query function that runs the text over a folder's tables."""
    text = spelled(text, 0)
    used = sorted(set(re.findall(rf"\[({'|'.join(TABLES)})\]", text)))
    text = re.sub(rf"\[({'|'.join(TABLES)})\]", r"{\1}", text)

    def run(session: SparkSession, sf_dir: str) -> DataFrame:
        return session.sql(text, **{t: session.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    return run
