"""Fill-in-middle: texts cut at two seeded unit boundaries and laid out anew, from an index of the distinct texts.

A unit is a word with the white space before it, or the white space at the text's end. index() groups identical texts (the grouping
compares whole texts; copies are combined on the map side, so a text on a third of all rows costs one row a task) and computes each
one's unit boundaries once, as an Elias-Fano list: about 2 + log2(characters / units) bits a unit, in which any boundary can be
selected without unpacking the others. The list is joined back to the documents by the text's SHA-256 and byte length; texts that
share both but differ are refused, so a list is never used for another text. fill_in_middle() selects the two cuts of each document
from its list and puts the parts together with DataFrame functions; Python sees each distinct text once, and the lists after that.

The cuts and the form of a document follow from the SHA-256 of "seed:doc_id". `plain` keeps the text, `psm` is
<P>prefix<S>suffix<M>middle, `spm` <S>suffix<P>prefix<M>middle. Texts that hold a mark stay plain, so the marks of an output are its
own and restored() is exact.

Defined cases: a null text is empty; empty texts stay plain; a null doc_id draws as the empty string; rows with equal doc_id are cut at
the same units of their own texts; repeated rows give repeated rows; very long texts are cut whole; an empty table gives an empty table; other
columns stay, and added names that are taken get an underscore in front.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, shuffles_freed, stored, table

SEED = 42
#: Of 100 texts, how many are cut; of 100 that are cut, how many have the suffix first.
RATE, SPM = 50, 80
MARK = "<[PSM]>"
HEADER = "<qqB"


def ends_of(text: str):
    """Where the units of a text end, in code points."""
    import numpy as np

    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    last = ~space
    last[:-1] &= space[1:]
    last[-1] = True
    return np.cumsum((raw & 0xC0) != 0x80)[last]


def packed(ends) -> bytes:
    """An Elias-Fano list of increasing numbers: their upper parts in unary, the lower bits as they are."""
    import numpy as np

    n, upto = len(ends), int(ends[-1]) if len(ends) else 0
    low = max(0, (upto // n).bit_length() - 1) if n else 0
    high = np.zeros(n + (upto >> low) + 1, np.uint8)
    high[(ends >> low) + np.arange(n)] = 1
    bits = (ends[:, None] >> np.arange(low) & 1).astype(np.uint8).ravel()
    upper = np.packbits(high, bitorder="little").tobytes()
    return struct.pack(HEADER, n, len(upper), low) + upper + np.packbits(bits, bitorder="little").tobytes()


def select(blob: bytes, places: list[int]) -> list[int]:
    """The numbers at these places of a list, from 1; place 0 holds 0."""
    import numpy as np

    n, size, low = struct.unpack_from(HEADER, blob)
    raw = np.frombuffer(blob, np.uint8, offset=struct.calcsize(HEADER))
    upper, lower = raw[:size], raw[size:]
    ones = np.cumsum(np.bitwise_count(upper), dtype=np.int64)
    out = []
    for k in places:
        if not 0 <= k <= n:
            raise IndexError(f"place {k} of {n}")
        if k == 0:
            out.append(0)
            continue
        byte = int(np.searchsorted(ones, k))
        before = int(ones[byte - 1]) if byte else 0
        at = byte * 8 + int(np.flatnonzero(np.unpackbits(upper[byte : byte + 1], bitorder="little"))[k - before - 1])
        first = (k - 1) * low
        own = np.unpackbits(lower[first // 8 : (first + low + 7) // 8], bitorder="little")[first % 8 : first % 8 + low]
        out.append((at - (k - 1) << low) + int((own.astype(np.int64) << np.arange(low)).sum()))
    return out


def key_of(body) -> F.Column:
    return F.concat(F.unhex(F.sha2(body, 256)), F.to_binary(F.octet_length(body).cast("string"), F.lit("utf-8")))


def index(docs: DataFrame, text: str = "text") -> DataFrame:
    """key, n, ends: a row for each distinct text, written to the shared folder."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lists = [ends_of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array([packed(x) for x in lists], pa.binary())], ["key", "n", "ends"])

    body = F.coalesce(F.col(text), F.lit(""))
    with shuffles_freed(docs.sparkSession):
        out = stored(docs.select(key_of(body).alias("key"), body.alias("body")).dropDuplicates(["key", "body"]).mapInArrow(run, "key binary, n long, ends binary"))
    if out.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("different texts share a SHA-256 and a length")
    return out


def chosen(ends, first, second):
    """The code points at which two places of each list lie; null where the list is."""
    import pyarrow as pa

    pairs = [None if e.as_py() is None else select(e.as_py(), [i.as_py(), j.as_py()]) for e, i, j in zip(ends, first, second)]
    return pa.array([p and {"a": p[0], "b": p[1]} for p in pairs], pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with n_units, form, prefix_chars, middle_chars (null if plain) and output added, as its last five columns."""
    cols = docs.columns
    names = fresh(docs, "n_units", "form", "prefix_chars", "middle_chars", "output")
    own = fresh(docs, "_key", "_h", "_body", "_n", "_ends", "_cut")
    k, h, body, n, ends, cut = own
    n_units, form, prefix_chars, middle_chars, output = names
    lists = index(docs, text).toDF(k, n, ends)
    draw = lambda i: F.conv(F.substring(h, 8 * i - 7, 8), 16, 10).cast("long")
    df = docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))).withColumn(k, key_of(F.col(body))).join(lists, k)
    df = df.withColumn(h, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256))
    plain = (F.col(body) == "") | F.col(body).rlike(MARK) | (draw(3) % 100 >= rate)
    df = df.withColumn(form, F.when(plain, "plain").when(draw(4) % 100 < spm, "spm").otherwise("psm"))
    cuts = F.arrow_udf(chosen, "a long, b long")
    places = [f(draw(1) % (F.col(n) + 1), draw(2) % (F.col(n) + 1)) for f in (F.least, F.greatest)]
    df = df.withColumn(cut, cuts(F.when(F.col(form) != "plain", F.col(ends)), *places))
    a, b, t = F.col(f"{cut}.a").cast("int"), F.col(f"{cut}.b").cast("int"), F.col(body)
    prefix, middle, suffix = F.substring(t, F.lit(1), a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, F.lit(2**31 - 1))
    laid = F.when(F.col(form) == "psm", F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle))
    laid = laid.when(F.col(form) == "spm", F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle)).otherwise(t)
    added = [F.col(n).alias(n_units), F.col(form), a.cast("long").alias(prefix_chars), (b - a).cast("long").alias(middle_chars), laid.alias(output)]
    return df.select(*[F.col(f"`{c}`") for c in cols], *added)


def restored(output: str, form: str) -> F.Column:
    """The text that an output was made from."""
    parts = F.split(F.col(output), MARK, -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).when(F.col(form) == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col(output))


def op13_distinct_text_index(spark, sf_dir: str) -> DataFrame:
    """All documents, cut and laid out."""
    df = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, body, regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS x FROM d
), c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(x[1] % (len(units) + 1), x[2] % (len(units) + 1)) AS p, greatest(x[1] % (len(units) + 1), x[2] % (len(units) + 1)) AS m,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), t AS (
  SELECT *, coalesce(array_to_string(units[1:p], ''), '') AS a, coalesce(array_to_string(units[p + 1:m], ''), '') AS b, coalesce(array_to_string(units[m + 1:n], ''), '') AS z FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || b ELSE body END) AS output_sha256,
  sha256(a || b || z) AS restored_sha256
FROM t
"""
