"""Secret scans: fixed patterns, and a battery of randomness tests; DataFrame functions only.

The patterns find assignments, access keys and hexadecimal runs. The battery takes every run of 20 or more characters of
the base64 alphabets that holds a digit and a letter (padded ones of fewer, too), infers its encoding (hexadecimal, base32,
letters and digits, base64) and tests it against uniform draws from that alphabet: chi-squared of the symbol counts, runs
above and below the middle, serial correlation at lag 1. Three times the least p-value is the run's p-value.

A discovery is a run marked `random`; a false one is a run that is none. Random runs have uniform p-values, others small
ones, so within each encoding and band of lengths the runs with p above a middle value tell how many random ones there are
(as in Storey's estimate): R. The middle is 0.35 for runs under 28 characters, on which the tests have less power, else 0.2. Of the M runs with p above a cut, M - R x (share of uniform p-values above it) are false, by
estimate. The cut is the lowest at which these are at most the level FDR of M, or no more than R's standard error; at the middle none is
false by estimate. What looks uniform to all three tests can't be told apart: of short runs of letters in changing case and digits,
some that are not random are marked.
P-values are kept in 1/1000 steps of their logarithm, so the estimate needs a table of counts whose size does not depend on
the number of rows; the marks need the table's counts, so the battery runs in two passes over the texts.

Defined cases: a null text is empty; texts without finds give counts 0, an empty span list and its digest; rows with equal
doc_id are each scanned; very long texts are scanned whole; an empty table gives an empty table; extra columns are kept by
scan(), which names its own column `secrets`, with underscores in front if there is one, and by redact(); report() ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, staged, table

#: Fixed patterns; the kinds in the order in which equal starts are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RUN = r"(?:[A-Za-z0-9+/_-]{20,}={0,6}|[A-Za-z0-9+/_-]{14,19}={1,6})"
KINDS = ("assign", "access", "hex", "random")
#: Least lengths: of an assigned value, of the other matches.
LEAST = {"assign": 6, "access": 20, "hex": 24, "random": 20}
#: What a text must hold, in lower case, for an assignment to be there.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Encodings in the order tried: name, alphabet, pattern.
ENCODINGS = (
    ("hex", "0123456789abcdef", r"^[0-9a-f]+$"),
    ("HEX", "0123456789ABCDEF", r"^[0-9A-F]+$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+=*$"),
    ("alnum", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", r"^[A-Za-z0-9]+=*$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[A-Za-z0-9+/]+=*$"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^[A-Za-z0-9_-]+=*$"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", r"^[A-Za-z0-9+/_-]+=*$"),
)
#: The level of false discoveries; where bands of lengths begin; up to which length runs are short.
FDR, BANDS, SHORT = 0.05, (20, 24, 28, 40, 64, 128), 28
#: Steps below which a run counts for R: p above 0.35 for short runs, above 0.2 for others.
MIDDLE = (456, 699)
#: Independent tests there would have to be for the combined p-value of uniform runs; measured on runs of 20 to 64 characters.
TESTS = 3.5
#: Prefix sums go by blocks of so many matches.
BLOCK = 512
NONE = "cast(array() as array<struct<start:int,kind:int,end:int,piece:string>>)"


def spans(text: str, pattern: str, kind: str, value: bool = False) -> F.Column:
    """Structs (start, kind, end, piece) of the leftmost non-overlapping matches, in code points.

    The text is split into gaps and matches in one linear pass each; ends are prefix sums of their lengths.
    """
    cut = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    gaps, found, held = (F.regexp_extract_all(F.col(text), cut, F.lit(i)) for i in (1, 2, 3 if value else 2))
    cells = F.transform(F.arrays_zip(gaps, found, held), lambda p: F.struct((F.char_length(p["0"]) + F.char_length(p["1"])).alias("n"), F.char_length(p["1"]).alias("m"), F.char_length(p["2"]).alias("v"), p["1"].alias("piece")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    sizes = lambda c, start, n: F.aggregate(F.slice(c, start, n), F.lit(0), lambda s, x: s + x["n"])
    block = lambda i: F.floor(i / BLOCK).cast("int")

    def place(c, before):
        at = lambda x, i: F.get(before, block(i)) + sizes(c, block(i) * BLOCK + 1, i % BLOCK + 1)
        ends = F.transform(c, lambda x, i: F.struct(at(x, i).alias("end"), x["m"].alias("m"), x["v"].alias("v"), x["piece"].alias("piece")))
        kept = F.filter(ends, lambda x: (x["m"] > 0) & (x["v"] >= LEAST[kind]))
        return F.transform(kept, lambda x: F.struct((x["end"] - x["m"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["piece"].alias("piece")))

    blocks = lambda c: F.transform(F.sequence(F.lit(0), block(F.size(c))), lambda b: sizes(c, b * BLOCK + 1, F.lit(BLOCK)))
    sums = lambda b: F.transform(b, lambda _, i: total(F.slice(b, F.lit(1), i)))
    return staged(
        F.struct(cells.alias("c")),
        lambda s: F.struct(s["c"].alias("c"), blocks(s["c"]).alias("b")),
        lambda s: F.struct(s["c"].alias("c"), sums(s["b"]).alias("b")),
        lambda s: place(s["c"], s["b"]),
    )


def phi(z: F.Column) -> F.Column:
    """The normal distribution function, by the logistic approximation of Bowling and others (2009)."""
    return 1 / (1 + F.exp(-F.least(F.lit(300.0), F.greatest(F.lit(-300.0), 1.5976 * z + 0.07056 * z * z * z))))


def with_fields(s: F.Column, names: str, **new: F.Column) -> F.Column:
    return F.struct(*[s[n].alias(n) for n in names.split()], *[c.alias(n) for n, c in new.items()])


def chi_squared(s: F.Column) -> F.Column:
    """Upper tail for symbol counts with a sum of squares against a equally likely symbols (Wilson and Hilferty)."""
    chi, free = F.greatest(s["squares"] * s["a"] / s["n"] - s["n"], F.lit(0.0)), s["a"] - 1
    return 1 - phi((F.pow(chi / free, 1 / 3) - (1 - F.lit(2.0) / (9 * free))) / F.sqrt(F.lit(2.0) / (9 * free)))


def runs_test(s: F.Column) -> F.Column:
    """Two-sided Wald-Wolfowitz test of the runs above and below the alphabet's middle; 0 where one side is empty."""
    m = 2 * s["high"] * (s["n"] - s["high"]) / s["n"] + 1
    return F.when(m <= 2, F.lit(0.0)).otherwise(2 * (1 - phi(F.abs(s["runs"] - m) / F.sqrt(F.greatest((m - 1) * (m - 2) / F.greatest(s["n"] - 1, F.lit(1.0)), F.lit(1e-9))))))


def serial_test(s: F.Column) -> F.Column:
    """Two-sided test of the correlation of neighbours, with the uniform draw's mean and variance."""
    return 2 * (1 - phi(F.abs(s["pairs"] / (s["n"] * (s["a"] * s["a"] - 1) / 12)) * F.sqrt(s["n"])))


def tested(runs: F.Column) -> F.Column:
    """The spans for which an encoding fits, with band (encoding and band of lengths), middle (the step below which it counts
    for R) and bin (the step of the p-value's logarithm) added."""
    own = "start kind end piece "
    fit = lambda r: F.coalesce(*[F.when(r["piece"].rlike(rx), F.struct(F.lit(name).alias("enc"), F.lit(letters).alias("letters"))) for name, letters, rx in ENCODINGS])
    after = lambda v: F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1)))
    steps = (
        lambda r: with_fields(r, own, e=fit(r), c=F.split(F.regexp_replace(r["piece"], "=+$", ""), "")),
        lambda r: with_fields(r, own + "e c", v=F.transform(r["c"], lambda y: (F.instr(r["e"]["letters"], y) - 1).cast("double")), n=F.size(r["c"]).cast("double"), a=F.char_length(r["e"]["letters"]).cast("double")),
        lambda r: with_fields(r, own + "e v n a", squares=F.aggregate(F.array_distinct(r["c"]), F.lit(0.0), lambda s, x: s + F.pow(F.size(F.filter(r["c"], lambda y: y == x)), 2))),
        lambda r: with_fields(
            r, own + "e n a squares",
            high=F.size(F.filter(r["v"], lambda x: x >= r["a"] / 2)).cast("double"),
            runs=(F.size(F.filter(after(r["v"]), lambda i: (F.get(r["v"], i) >= r["a"] / 2) != (F.get(r["v"], i - 1) >= r["a"] / 2))) + 1).cast("double"),
            pairs=F.coalesce(F.aggregate(after(r["v"]), F.lit(0.0), lambda s, i: s + (F.get(r["v"], i) - (r["a"] - 1) / 2) * (F.get(r["v"], i - 1) - (r["a"] - 1) / 2)), F.lit(0.0)),
        ),
        lambda r: with_fields(r, own + "e n", p=3 * F.least(chi_squared(r), runs_test(r), serial_test(r))),
        lambda r: with_fields(
            r, own,
            middle=F.when(r["n"] < SHORT, MIDDLE[0]).otherwise(MIDDLE[1]),
            band=F.concat_ws(":", r["e"]["enc"], sum((r["n"] >= b).cast("int") for b in BANDS)),
            bin=F.floor(-1000 * F.log10(F.least(F.lit(1.0), F.greatest(r["p"], F.lit(1e-12))))).cast("int"),
        ),
    )
    out = F.filter(runs, lambda r: fit(r).isNotNull())
    for step in steps:
        out = F.transform(out, step)
    return out


def thresholds(runs: DataFrame, fdr: float = FDR) -> DataFrame:
    """band, reject_from: the step from which runs are not marked; steps grow as p-values fall. Its input is counted by band
    and step first: 49 x 12,001 rows at most, whatever the table's size."""
    counts = runs.groupBy("band", "middle", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("band").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    above = lambda step: F.pow(1 - F.pow(F.lit(10.0), -step / 1000) / TESTS, F.lit(3.0))  # noqa: E731  the share of uniform runs below a step
    ranked = counts.withColumn("marked", F.sum("n").over(down)).withColumn("upper", F.coalesce(F.sum(F.when(F.col("bin") < F.col("middle"), F.col("n"))).over(Window.partitionBy("band")), F.lit(0)))
    random, error = (x / above(F.col("middle")) for x in (F.col("upper"), F.sqrt("upper")))
    return ranked.where(F.col("marked") - random * above(F.col("bin") + 1) <= F.greatest(fdr * F.col("marked"), error)).groupBy("band").agg((F.max("bin") + 1).alias("reject_from"))


def runs_of(text: str) -> F.Column:
    """The candidate runs of a text, tested."""
    return tested(F.filter(spans(text, RUN, "random"), lambda s: s["piece"].rlike("[0-9]") & s["piece"].rlike("[A-Za-z]")))


def scan(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """The table with `secrets` (or the next free name, the last column) added: structs (start, kind, end, piece) of all
    spans, by start, then kind."""
    out, own = fresh(docs, "secrets", "_text")
    body = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    low = F.lower(F.col(own))
    some = F.col(own).rlike(RUN)
    limits = thresholds(body.where(some).select(F.explode_outer(runs_of(own)).alias("r")).select("r.band", "r.middle", "r.bin").where("bin is not null"), fdr).collect()  # 49 rows at most
    froms = F.create_map(*[F.lit(x) for r in limits for x in (r.band, r.reject_from)]) if limits else None
    from_band = lambda band: F.coalesce(F.try_element_at(froms, band), F.lit(0)) if limits else F.lit(0)
    marked = F.transform(F.filter(runs_of(own), lambda s: s["bin"] < from_band(s["band"])), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["piece"].alias("piece")))
    none = F.expr(NONE)
    word = F.lit(False)
    for w in WORDS:
        word = word | low.contains(w)
    return body.withColumn(
        out,
        F.array_sort(
            F.concat(
                F.when(word, spans(own, ASSIGN, "assign", True)).otherwise(none),
                F.when(F.col(own).contains("AKIA"), spans(own, ACCESS, "access")).otherwise(none),
                F.when(F.col(own).rlike("[0-9a-f]{24}"), spans(own, HEX, "hex")).otherwise(none),
                F.when(some, marked).otherwise(none),
            )
        ),
    ).drop(own)


def listed(found: F.Column) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    df = scan(docs.select("doc_id", "text")).select("doc_id", "secrets")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] < KINDS.index("random"))
    return df.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), n("random"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The table with every span of its texts replaced by a mark; overlapping spans become one."""
    cols, df = docs.columns, scan(docs, text)
    found = df.columns[-1]
    # spans come by start: a span that begins before the last one's end extends it
    last = lambda a: F.get(a, F.size(a) - 1)
    span = lambda s, e: F.array(F.struct(s.alias("s"), e.alias("e")))
    grow = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), span(last(a)["s"], F.greatest(last(a)["e"], x["end"])))
    merged = F.aggregate(found, F.expr("cast(array() as array<struct<s:int,e:int>>)"), lambda a, x: F.when((F.size(a) > 0) & (x["start"] <= last(a)["e"]), grow(a, x)).otherwise(F.concat(a, span(x["start"], x["end"]))))
    ended = lambda m, i: F.coalesce(F.get(m, i - 1)["e"], F.lit(0))
    kept = lambda m: F.array_join(F.transform(m, lambda x, i: F.substring(F.col(text), ended(m, i) + 1, x["s"] - ended(m, i))), mark)
    cleaned = staged(merged, lambda m: F.concat(kept(m), F.lit(mark), F.substring(F.col(text), last(m)["e"] + 1, F.lit(2**31 - 1))))
    return df.withColumn(text, F.when(F.size(found) > 0, cleaned).otherwise(F.col(text))).select(*cols)


def op7_random_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return report(table(spark, sf_dir, "documents"))
