"""Conversation prefix trie: the tree of all turn sequences with which conversations begin.

A node is a distinct sequence of first turns (role, text); it belongs to the least conv_id that begins so, its owner. A
conversation that owns a depth owns all deeper ones, so first_owned() finds each one's first owned depth by binary search: a
round takes one probe a conversation, joined with the conversation's prefix digest at that depth and with the digests' owners. The owned
depths form chains; a chain hangs under the node before its first depth, whose owner the last failed probe has named. Chains are
summed bottom-up by doubling: in a round every chain adds its sum to the ancestor it points to, then points to that one's
ancestor, so a tree of height h takes log2(h) rounds; node values are then running sums along each chain.

Sequences are compared by digests: sums of hashes of (depth, role, text), four 32-bit parts each, folded to 128 bits. Sums can be made in
blocks, so a conversation of any length is spread over many tasks: turns are numbered in two levels beyond LONG rows and summed by
blocks of BLOCK turns. Popular prefixes (a first turn on a third of all conversations) are counted on the map side, and joins meet
them with one row each. The list of conversations that end at a node is written in pieces of at most PIECE and hashed as a stream.

Defined cases: turns are ordered by turn (null first), then role, then text; a null role or text is empty; repeated rows are turns of
their own (rows of one long conversation that share a turn number are numbered in one task); rows without conv_id belong to no conversation; an empty
table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators import ordering

from .common import cut, stored, table

#: Rows from which a conversation's turns are numbered in slices; turns summed in one task; conversations in one piece of a list.
LONG, BLOCK, PIECE = 100_000, 4096, 4096
WORD = r"[^\x20\x09-\x0D]+"
#: Rebuilding: conversations take first turns from the one at the multiple of DONOR before them, fewer than HEADS.
DONOR, HEADS = 20, 4
SUMS = ("s1", "s2", "s3", "s4")


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), a, b (the turn's hash), words; stored."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text")).where("conv_id is not null")
    counts = rows.groupBy("conv_id").count()
    long = cut(counts.where(F.col("count") > LONG).select("conv_id"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    number = lambda df: df.withColumn("place", F.row_number().over(order))
    if long.limit(1).count():
        few = number(rows.join(long, "conv_id", "left_anti"))
        many = ordering.numbered(rows.join(long, "conv_id", "left_semi"), ["conv_id"], "turn", ["role", "text"], name="place")
        numbered = few.unionByName(many.select(*few.columns))
    else:
        numbered = number(rows)
    own = lambda i: F.xxhash64(F.lit(i), "role", "text")
    return stored(numbered.select("conv_id", F.col("place").cast("long"), own(1).alias("a"), own(2).alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their first turns taken from another: the turns (conv_id, depth, a, b, words), and all conversations
    (conv_id, length), turnless ones too."""
    taken = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % HEADS
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    donors = counts.select(F.col("conv_id").alias("donor"), F.col("own").alias("there"))
    ids = counts.withColumn("taken", taken).withColumn("donor", F.col("conv_id") - F.col("conv_id") % DONOR).join(donors, "donor", "left")
    ids = cut(ids.withColumn("got", F.least("taken", F.coalesce("there", F.lit(0)))).select("conv_id", "donor", "own", "taken", "got"))
    heads = turns.where(F.col("place") < HEADS).withColumnsRenamed({"conv_id": "donor", "place": "depth"})
    first = ids.where("got > 0").join(heads, "donor").where("depth <= got").select("conv_id", "depth", "a", "b", "words")
    rest = turns.where(F.col("place") > taken).join(ids.select("conv_id", "taken", "got"), "conv_id")
    rest = rest.select("conv_id", (F.col("place") - F.col("taken") + F.col("got")).alias("depth"), "a", "b", "words")
    return first.unionByName(rest), ids.select("conv_id", (F.col("got") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))).alias("length"))


def along(df: DataFrame, place: str, names: tuple[str, ...], ascending: bool = True) -> DataFrame:
    """Replaces the columns by their sums along each conversation, up to the row in the order of place; a task sums one block."""
    df = df.withColumn("_block", F.floor(F.col(place) / BLOCK))
    way = lambda c: F.col(c) if ascending else F.col(c).desc()
    blocks = df.groupBy("conv_id", "_block").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.partitionBy("conv_id").orderBy(way("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "_block", *[F.sum(n).over(before).alias(f"_{n}") for n in names]).where(f"_{names[0]} is not null")
    own = Window.partitionBy("conv_id", "_block").orderBy(way(place)).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({n: F.sum(n).over(own) for n in names}).join(blocks, ["conv_id", "_block"], "left")
    return df.withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in names}).drop("_block", *[f"_{n}" for n in names])


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2 (the prefix's digest), words (of its last turn): every conversation's prefixes, the empty one too; stored."""
    mixed = lambda i: F.xxhash64(F.lit(i), "depth", "a", "b")
    high, low = (lambda x: F.shiftrightunsigned(x, 32)), (lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))
    parts = dict(zip(SUMS, (high(mixed(1)), low(mixed(1)), high(mixed(2)), low(mixed(2)))))
    summed = along(turns.withColumns(parts).select("conv_id", "depth", "words", *SUMS), "depth", SUMS)
    key = lambda i: F.xxhash64(F.lit(i), "depth", *SUMS).alias(f"k{i}")
    empty = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("words"))
    return stored(summed.select("conv_id", "depth", key(1), key(2), "words").unionByName(empty))


def first_owned(paths: DataFrame, owners: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, length, first (the first owned depth; length + 1 if none), above (the owner of the depth before it, null for the root's)."""
    state = cut(ids.select("conv_id", "length", F.lit(0).cast("long").alias("first"), (F.col("length") + 1).alias("last"), F.lit(None).cast("long").alias("above")))
    done = state.where("first >= last")
    while state.limit(1).count():
        probes = state.withColumn("depth", F.floor((F.col("first") + F.col("last")) / 2))
        met = probes.join(paths.select("conv_id", "depth", "k1", "k2"), ["conv_id", "depth"]).join(owners.select("depth", "k1", "k2", "owner"), ["depth", "k1", "k2"])
        mine = F.col("owner") == F.col("conv_id")
        state = cut(
            met.select(
                "conv_id", "length",
                F.when(mine, F.col("first")).otherwise(F.col("depth") + 1).alias("first"),
                F.when(mine, F.col("depth")).otherwise(F.col("last")).alias("last"),
                F.when(mine, F.col("above")).otherwise(F.col("owner")).alias("above"),
            )
        )
        done, state = done.unionByName(state.where("first = last")), state.where("first < last")
    return cut(done.drop("last"))


def totals(chains: DataFrame) -> DataFrame:
    """conv_id, leaves, saved: each chain's own values (conv_id, above, leaves, saved) plus those of all chains below it."""
    state = chains.withColumnRenamed("above", "up")
    while state.where("up is not null").limit(1).count():
        given = state.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        further = state.select(F.col("conv_id").alias("up"), F.col("up").alias("up2")).where("up2 is not null")
        state = state.join(given, "conv_id", "left").join(further, "up", "left")
        state = cut(state.select("conv_id", F.col("up2").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    return state.drop("up")


def digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes at which conversations (conv_id, depth, ending) end."""
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("ending")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("conv_id", "depth", F.floor(F.col("ending") / PIECE).alias("slice")).agg(piece.alias("piece"))

    def run(batches):
        import pyarrow as pa

        node, digest = None, None
        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
        for b in batches:
            out = []
            for c, d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if node == (c, d):
                    digest.update(b",")
                else:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (c, d), hashlib.sha256()
                digest.update(p.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, digest.hexdigest()), schema)], schema=schema)

    sorted_pieces = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "slice")
    return sorted_pieces.select("conv_id", "depth", "piece").mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (from 1, without gaps), a, b, words; ids: conv_id, length of all conversations.
    """
    ids = cut(ids)
    paths = prefixes(turns, ids)
    owners = stored(paths.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words")))
    found = first_owned(paths, owners, ids)
    chains = found.where("first <= length")
    hung = chains.where("above is not null").select("conv_id", F.col("above").alias("at"), (F.col("first") - 1).alias("depth"))
    nodes = owners.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    # a chain's last node is a leaf unless another chain hangs there
    shaded = hung.select(F.col("at").alias("conv_id"), F.col("depth").alias("length"), F.lit(0).cast("long").alias("leaf")).distinct()
    own = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    values = chains.join(shaded, ["conv_id", "length"], "left").join(own, "conv_id").select("conv_id", "above", F.coalesce("leaf", F.lit(1)).cast("long").alias("leaves"), "saved")
    sums = totals(cut(values))
    below = hung.join(sums, "conv_id").groupBy(F.col("at").alias("conv_id"), "depth").agg(F.count("*").alias("hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("more"))
    full = nodes.join(below, ["conv_id", "depth"], "left").join(chains, "conv_id")
    none = lambda c: F.coalesce(c, F.lit(0))
    last = F.col("depth") == F.col("length")
    full = stored(
        full.select(
            "conv_id", "depth", "n_convs",
            F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("first"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            (none("hung") + F.when(last, 0).otherwise(1)).alias("n_children"),
            (none("leaves") + F.when(last & F.col("hung").isNull(), 1).otherwise(0)).alias("n_leaves"),
            (F.col("saved") + none("more")).alias("saved_tokens"),
        )
    )
    full = along(full, "depth", ("n_leaves", "saved_tokens"), ascending=False)
    owned = F.col("first") <= F.col("length")
    ends = digests(found.select(F.when(owned, F.col("conv_id")).otherwise(F.col("above")).alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("ending")))
    out = full.join(ends, ["conv_id", "depth"], "left")
    whole = [F.col(c).cast("long") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return out.select(*whole, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns = ordered(conversations)
    return trie(turns.withColumnRenamed("place", "depth"), turns.groupBy("conv_id").agg(F.count("*").alias("length")))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    turns, ids = rebuilt(ordered(table(spark, sf_dir, "conversations")))
    return trie(turns, ids)


OP11_SQL = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS tab
), o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor,
    CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o), steps
), r AS (
  SELECT ids.conv_id, place, role, text FROM ids JOIN o ON o.conv_id = ids.donor AND place <= h
  UNION ALL SELECT ids.conv_id, place, role, text FROM ids JOIN o ON o.conv_id = ids.conv_id AND place > h
), d AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, role, text FROM r
), seqs AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY depth) AS whole FROM d GROUP BY conv_id
), all_seqs AS (
  SELECT ids.conv_id, coalesce(whole, list_value({'role': '', 'text': ''})[2:]) AS whole FROM ids LEFT JOIN seqs USING (conv_id)
), pre AS (
  SELECT conv_id, depth, whole[1:depth] AS prefix FROM (SELECT conv_id, whole, unnest(range(len(whole) + 1)) AS depth FROM all_seqs)
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) END AS words FROM pre GROUP BY prefix, depth
), kids AS (
  SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), n AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (prefix, depth)
), up AS (
  SELECT prefix[1:a] AS prefix, a AS depth, n_children, n_convs, words FROM (SELECT *, unnest(range(depth + 1)) AS a FROM n)
), sums AS (
  SELECT prefix, depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM up GROUP BY prefix, depth
), ends AS (
  SELECT whole AS prefix, len(whole) AS depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS members FROM all_seqs GROUP BY whole
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(members, '')) AS ends_sha256
FROM n JOIN sums USING (prefix, depth) LEFT JOIN ends USING (prefix, depth)
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""
