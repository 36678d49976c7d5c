"""Personal data: fixed patterns, and identifiers learned from the words around them; DataFrame functions only.

The patterns find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers. They are the seeds. Every token with an @ or
four digits (with the groups of digits that follow it) is an instance; the word before it, the two words before it and the word after
it are the lexical patterns it stands in. The graph of patterns and instances is scored in ROUNDS rounds: a pattern's confidence for a
kind is the sum of its instances' scores over *all* occurrences of its words in the corpus, wherever they stand, plus one; an instance that is no seed
scores 1 - product(1 - confidence) over its patterns. A pattern counts from a confidence of HIGH and a score sum of SUPPORT different
instances, so neither copies of one passage nor common words ("the", after which an address may stand) make one. Instances that stand in a pattern that counts are
reported as `context` spans, with the kind they are like.

One pass over the texts finds seeds and instances; what follows handles these only, but for one count of the words of candidate
patterns: they are sent to all tasks if they are small (BROADCAST_BYTES, measured), otherwise words are counted first and
joined. Edges are combined by (pattern, instance) before they are shuffled; a hot pattern or value is summed on the map side.

Defined cases: a null text is empty; a match that fails its check is dropped, not tried again; contexts are cut to CONTEXT characters;
rows with equal doc_id are each scanned; very long texts are scanned whole; an empty table gives an empty table; scan() keeps all columns and names its own
`personal`, with underscores in front if there is one.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, staged, stored, table

KINDS = ("email", "ip", "card", "phone", "context")
#: Fixed patterns. Groups repeat possessively, which matches the same and needs no stack; an address can only begin where a run of
#: its characters or the search does.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token with a digit or an @, and the groups of digits after it.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[().0-9-]++(?![^\x20\x09-\x0D]))*+"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SPACE = r"[\x20\x09-\x0D]+"
#: Characters of context looked at; confidence and instances from which a pattern counts; rounds of scoring.
CONTEXT, HIGH, SUPPORT, ROUNDS = 80, 0.5, 5, 3
BROADCAST_BYTES = 32 << 20
#: Prefix sums go by blocks of so many matches.
BLOCK = 512
SPANS = "array<struct<start:int,kind:int,end:int,piece:string,like:int>>"


def matches(text: str, pattern: str) -> F.Column:
    """Structs (start, end, piece, left, right) of the leftmost non-overlapping matches, in code points; left and right are what
    stands between a match and its neighbours, CONTEXT characters at most. One linear pass splits the text into gaps and matches."""
    split = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    gaps, found = (F.regexp_extract_all(F.col(text), split, F.lit(i)) for i in (1, 2))
    cell = lambda p: F.struct((F.char_length(p["0"]) + F.char_length(p["1"])).alias("n"), F.right(p["0"], F.lit(CONTEXT)).alias("left"), F.left(p["0"], F.lit(CONTEXT)).alias("head"), p["1"].alias("piece"))
    sizes = lambda c, start, n: F.aggregate(F.slice(c, start, n), F.lit(0), lambda s, x: s + x["n"])
    block = lambda i: F.floor(i / BLOCK).cast("int")

    def place(c, before):
        at = lambda i: F.get(before, block(i)) + sizes(c, block(i) * BLOCK + 1, i % BLOCK + 1)
        ends = F.transform(c, lambda x, i: F.struct(at(i).alias("end"), x["piece"].alias("piece"), x["left"].alias("left"), F.get(c, i + 1)["head"].alias("right")))
        real = F.filter(ends, lambda x: x["piece"] != "")
        return F.transform(real, lambda x: F.struct((x["end"] - F.char_length(x["piece"])).alias("start"), x["end"].alias("end"), x["piece"].alias("piece"), x["left"].alias("left"), x["right"].alias("right")))

    blocks = lambda c: F.transform(F.sequence(F.lit(0), block(F.size(c))), lambda b: sizes(c, b * BLOCK + 1, F.lit(BLOCK)))
    sums = lambda b: F.transform(b, lambda _, i: F.aggregate(F.slice(b, F.lit(1), i), F.lit(0), lambda s, x: s + x))
    return staged(
        F.struct(F.transform(F.arrays_zip(gaps, found), cell).alias("c")),
        lambda s: F.struct(s["c"].alias("c"), blocks(s["c"]).alias("b")),
        lambda s: F.struct(s["c"].alias("c"), sums(s["b"]).alias("b")),
        lambda s: place(s["c"], s["b"]),
    )


def base(text: str) -> F.Column:
    """The spans of the fixed patterns, by start, then kind."""
    own, none = F.col(text), F.expr(f"cast(array() as {SPANS})")
    digits = lambda p: F.char_length(F.regexp_replace(p, "[^0-9]", ""))
    valid = {
        "email": (EMAIL, own.contains("@"), None),
        "ip": (IP, own.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), lambda p: p.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": (CARD, own.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), lambda p: digits(p).between(14, 19) & F.call_function("luhn_check", F.regexp_replace(p, "[^0-9]", ""))),
        "phone": (PHONE, own.rlike(r"\+[0-9]"), lambda p: digits(p).between(10, 15)),
    }

    def of(kind, pattern, some, check):
        number = F.lit(KINDS.index(kind))
        found = matches(text, pattern)
        kept = F.filter(found, lambda s: check(s["piece"])) if check else found
        full = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end"), s["piece"].alias("piece"), number.alias("like")))
        return F.when(some, full).otherwise(none)

    return F.array_sort(F.concat(*[of(kind, *rest) for kind, rest in valid.items()]))


def lowered(text) -> F.Column:
    """Lower case, every digit 0: what contexts are compared by."""
    return F.translate(F.lower(text), "123456789", "000000000")


def instances(text: str, known: str) -> F.Column:
    """Structs (start, end, piece, value, seed, p) of the tokens that may be identifiers: value is a hash of the lowered token,
    seed the kind of the span of the column `known` that it meets (null: none), p its patterns, structs (side, unit)."""
    lead, trail = r"^[\p{Punct}&&[^@+(]]+", r"[\p{Punct}&&[^)]]+$"
    words = lambda t: F.split(F.regexp_replace(lowered(t), rf"^{SPACE}|{SPACE}$", ""), SPACE)
    bare = lambda s: F.struct(
        (s["end"] - F.char_length(F.regexp_replace(s["piece"], lead, ""))).alias("start"),
        (s["end"] - F.char_length(s["piece"]) + F.char_length(F.regexp_replace(s["piece"], trail, ""))).alias("end"),
        F.regexp_replace(F.regexp_replace(s["piece"], trail, ""), lead, "").alias("piece"),
        words(s["left"]).alias("l"),
        F.get(words(s["right"]), F.lit(0)).alias("r"),
    )
    word = lambda w: (w != "") & w.isNotNull()
    before = lambda s, i: F.get(s["l"], F.size(s["l"]) - i)
    pattern = lambda side, on, *w: F.when(on, F.struct(F.lit(side).alias("side"), F.xxhash64(*w).alias("unit")))
    patterns = lambda s: F.filter(
        F.array(
            pattern("before", word(before(s, 1)), before(s, 1)),
            pattern("before2", word(before(s, 2)) & word(before(s, 1)), before(s, 2), before(s, 1)),
            pattern("after", word(s["r"]), s["r"]),
        ),
        lambda p: p.isNotNull(),
    )
    full = lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["piece"].alias("piece"), F.xxhash64(F.lower(s["piece"])).alias("value"),
        F.get(F.filter(F.col(known), lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])), F.lit(0))["kind"].alias("seed"), patterns(s).alias("p"),
    )
    like = lambda s: s["piece"].rlike("[^@]@[^@]|(?:[0-9][^0-9]*){4}")
    some = F.when(F.col(text).rlike("[0-9@]"), F.filter(matches(text, TOKEN), like))
    return F.transform(F.filter(F.transform(some, bare), like), full)


def edges_of(found: DataFrame) -> DataFrame:
    """side, unit, value, n, seed: how often each instance stands in each pattern."""
    return found.select("value", "seed", F.explode("p").alias("p")).groupBy("p.side", "p.unit", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))


def occurrences(docs: DataFrame, units: DataFrame, text: str = "text") -> DataFrame:
    """unit, total: how often each of these word sequences (of one or two words) stands in all texts."""
    words = docs.select(F.split(lowered(F.col(text)), SPACE).alias("w"))
    ones = F.transform("w", lambda w: F.xxhash64(w))
    twos = F.transform("w", lambda w, i: F.when(i > 0, F.xxhash64(F.get(F.col("w"), i - 1), w)))
    each = words.select(F.explode(F.concat(ones, twos)).alias("unit"))
    units = cut(units)
    if 16 * units.count() <= BROADCAST_BYTES:
        each = each.join(F.broadcast(units), "unit", "left_semi")
        return each.groupBy("unit").agg(F.count("*").alias("total"))
    return each.groupBy("unit").agg(F.count("*").alias("total")).join(units, "unit", "left_semi")


def learned(docs: DataFrame, found: DataFrame, text: str = "text", high: float = HIGH, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """side, unit, kind, confidence of the patterns that count; found: value, seed, p of every instance in the table."""
    edges = cut(edges_of(found))
    wide = edges.groupBy("side", "unit").agg(F.count("*").alias("values")).where(F.col("values") >= support).select("side", "unit")
    edges = cut(edges.join(wide, ["side", "unit"], "left_semi"))
    totals = cut(occurrences(docs, edges.select("unit").distinct(), text))
    seeds = cut(edges.where("seed is not null").groupBy("value").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0)))
    open_edges = edges.join(seeds, "value", "left_anti")
    scores, out = seeds, None
    for _ in range(rounds):
        hits = edges.join(scores, "value").groupBy("side", "unit", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.sum("score").alias("mass"))
        total = F.greatest(F.coalesce("total", F.lit(0)), F.col("hits"))
        out = cut(hits.where(F.col("mass") >= support).join(totals, "unit", "left").withColumn("confidence", F.col("hits") / (total + 1)).where(F.col("confidence") >= high).select("side", "unit", "kind", "confidence"))
        if not out.limit(1).count():
            break
        doubt = F.sum(F.log(1 - F.col("confidence")))
        met = open_edges.join(out, ["side", "unit"]).groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"))
        best = met.groupBy("value").agg(F.max(F.struct("score", -F.col("kind"))).alias("m")).select("value", (-F.col("m")["col2"]).alias("kind"), F.col("m.score").alias("score"))
        scores = cut(seeds.unionByName(best.select("value", "kind", "score")))
    return out


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, **learning) -> DataFrame:
    """The table's columns (or those to keep) with `personal` (or the next free name, the last column) added: structs (start, kind,
    end, piece, like) of all spans, by start, then kind."""
    out, body, row, tokens = fresh(docs, "personal", "_body", "_row", "_tokens")
    cols = docs.columns if keep is None else keep
    full = docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))).withColumn(out, base(body))
    full = stored(full.withColumn(tokens, instances(body, out)).select(F.monotonically_increasing_id().alias(row), *[F.col(f"`{c}`") for c in cols], out, tokens))
    found = full.select(row, F.explode(tokens).alias("i")).select(row, "i.*")
    patterns = learned(docs, found, text, **learning)
    new = found.where("seed is null").select(row, "start", "end", "piece", F.explode("p").alias("p")).join(patterns, [F.col("p.side") == patterns["side"], F.col("p.unit") == patterns["unit"]])
    new = new.groupBy(row, "start", "end", "piece").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("m"))
    span = F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end", "piece", (-F.col("m")["col2"]).alias("like"))
    new = new.groupBy(row).agg(F.collect_list(span).alias(tokens))
    none = F.expr(f"cast(array() as {SPANS})")
    return full.drop(tokens).join(new, row, "left").withColumn(out, F.array_sort(F.concat(out, F.coalesce(tokens, none)))).select(*[F.col(f"`{c}`") for c in cols], out)


def listed(found: F.Column) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, **learning) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context."""
    df = scan(docs.select("doc_id", "text"), keep=["doc_id"], **learning)
    n = lambda kind: F.size(F.filter("personal", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    fixed = F.filter("personal", lambda s: s["kind"] < KINDS.index("context"))
    return df.select("doc_id", *[n(k) for k in KINDS[:4]], F.sha2(F.encode(listed(fixed), "UTF-8"), 256).alias("base_sha256"), listed(F.col("personal")).alias("spans"), n("context"))


def op12_contextual_extraction(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return report(table(spark, sf_dir, "documents"))
