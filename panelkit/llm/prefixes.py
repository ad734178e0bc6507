"""A prefix trie of conversations, built by van Emde Boas recursion over a table of turns.

A trie of height 2^k is cut at half its height. The names of the cut prefixes are the leaves of the upper trie and the roots
of the lower forests; all tries of one height, upper and lower ones alike, are cut in the same Spark job, so the depth of
the work is the logarithm of the longest sequence. Going up, the names of two neighbouring blocks of turns make the name of
the block twice as long; going down, the name of a block's start and the name of its first half make the name of the cut
prefix. So every join and group holds two rows, however long a sequence is and however many sequences share a prefix.

Totals of subtrees are grafted upward in the same recursion: first each node collects the trie of height 2^k below it, from
half as high tries; then the totals of lower forests, whole by then, are added to the leaves of the upper trie.
"""

from collections.abc import Iterator
from functools import reduce
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.llm.common import ship
from panelkit.session import settle

ROW_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit
#: Turns a conversation borrows at most, and how many conversations follow one base.
BORROWED, FAMILY = 5, 100
#: Ids joined to one piece of a node's list; the pieces of a list are digested one after another.
PIECE = 1 << 16
ROOT = bytes(16)


def name_of(*parts: Column) -> Column:
    """Sixteen bytes of a SHA-256 digest: different contents have different names but for a chance of 2^-64 in 2^32 names."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def numbered(turns: DataFrame) -> DataFrame:
    """``(seq, place, symbol, weight)`` of the turns ``(conv_id, turn, role, text)``: place from 1 in the order of ``turn``, null
    first; equal turns in the order of their symbol, the digest of role and text; weight: the code points of the text.

    Null roles and texts are empty. Rows without a conversation id belong to none and are left out. A conversation is sorted
    across partitions, so one that holds a third of all rows is many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    symbol = name_of(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = settle(turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("seq"), "turn", symbol.alias("symbol"), F.length(text).cast("long").alias("weight")))
    tagged = settle(rows.orderBy("seq", F.col("turn").asc_nulls_first(), "symbol").select("seq", "symbol", "weight", F.monotonically_increasing_id().alias("at"))
                    .withColumn("part", F.shiftright("at", ROW_BITS)))
    pieces = tagged.groupBy("seq", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("seq").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.select("seq", "part", (F.col("first") - before).alias("start"))  # one row a sequence and partition
    return settle(tagged.join(starts, ["seq", "part"]).select("seq", (F.col("at") - F.col("start") + 1).alias("place"), "symbol", "weight"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations of ``numbered`` rows, as ``(seq, size)`` and ``(seq, place, symbol, weight, last)``.

    Conversation c starts with the first h turns of conversation c - c % 100 (all if there are fewer, none if it is absent) and
    goes on with its own behind the first h; h is the crc32 of c's digits modulo 6.
    """
    own = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    heads = (rows.filter((F.col("place") <= BORROWED) & (F.col("seq") % FAMILY == 0)).groupBy(F.col("seq").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("place", "symbol", "weight"))).alias("head")))  # BORROWED turns at most
    h = (F.crc32(F.col("seq").cast("string")) % (BORROWED + 1)).cast("int")
    plan = own.select("seq", "n", h.alias("h"), (F.col("seq") - F.col("seq") % FAMILY).alias("base")).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    plan = settle(plan.select("seq", "h", head.alias("head")).join(own, "seq").withColumn("p", F.size("head")).withColumn(
        "size", F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    borrowed = plan.select("seq", "size", F.explode("head").alias("t")).select("seq", "size", "t.place", "t.symbol", "t.weight")
    kept = (rows.join(plan.select("seq", "size", "h", "p"), "seq").filter("place > h")
            .select("seq", "size", (F.col("place") - F.col("h") + F.col("p")).alias("place"), "symbol", "weight"))
    turns = borrowed.unionByName(kept).select("seq", "place", "symbol", "weight", (F.col("place") == F.col("size")).alias("last"))
    return plan.select("seq", "size"), turns


def _blocks(turns: DataFrame, height: int) -> list[DataFrame]:
    """For each k from 1 to ``height`` the blocks of 2^k turns ``(seq, block, first, second)``: the names of the two halves, null
    for a half that is not full. Those of two turns also hold each turn's weight and whether it is the last."""
    odd = F.col("block").bitwiseAND(F.lit(1).cast("long")) == 1
    rows = turns.select("seq", (F.col("place") - 1).alias("block"), F.col("symbol").alias("name"), "weight", "last")
    more = ["weight", "last"]
    out = []
    for k in range(1, height + 1):
        halves = [F.max(F.when(odd == side, F.col(c))).alias(f"{half}{'' if c == 'name' else '_' + c}")
                  for half, side in (("first", False), ("second", True)) for c in ["name", *more]]
        out.append(settle(rows.groupBy("seq", F.shiftright("block", 1).alias("half")).agg(*halves).withColumnRenamed("half", "block")))
        rows = out[-1].select("seq", "block", F.when(F.col("second").isNotNull(), name_of(F.lit(bytes([k])), F.col("first"), F.col("second"))).alias("name"))
        more = []
    return out


def _paths(blocks: list[DataFrame]) -> DataFrame:
    """``(seq, depth, name, up, weight, last)`` for every turn of every sequence: the name of the prefix that ends with it, and
    ``up``, the names of the prefixes it was cut from: the one 2^j turns shorter for each j from that of the lowest bit of
    ``depth`` down to 0, so the last of them is the parent."""
    none = F.lit(None).cast("array<binary>")
    spans = blocks[-1].select("seq", "block", F.lit(ROOT).alias("start"), F.lit(None).cast("binary").alias("end"), none.alias("up"))
    for k in range(len(blocks), 0, -1):
        cut = F.when(F.col("first").isNotNull(), name_of(F.lit(b"cut"), F.col("start"), F.col("first")))
        halved = spans.join(blocks[k - 1], ["seq", "block"]).withColumn("cut", cut)
        lower = F.when(F.col("end").isNotNull(), F.concat("up", F.array("cut")))
        more = [["first_weight", "first_last"], ["second_weight", "second_last"]] if k == 1 else [[], []]
        fields = lambda block, start, end, up, extra: F.struct(
            block.alias("block"), start.alias("start"), end.alias("end"), up.alias("up"), *[F.col(c).alias(c.split("_")[1]) for c in extra])
        twice = F.shiftleft("block", 1)
        halves = F.array(fields(twice, F.col("start"), F.col("cut"), F.when(F.col("cut").isNotNull(), F.array("start")), more[0]),
                         fields(twice + 1, F.col("cut"), F.col("end"), lower, more[1]))
        spans = halved.select("seq", F.explode(halves).alias("s")).select("seq", "s.*").filter("start IS NOT NULL")
        spans = settle(spans.filter("end IS NOT NULL") if k == 1 else spans)
    return spans.select("seq", (F.col("block") + 1).alias("depth"), F.col("end").alias("name"), "up", "weight", "last")


def _totals(nodes: DataFrame, height: int) -> DataFrame:
    """``(name, saved, leaves)``: sums over each node's subtree of ``nodes (name, up, depth, saved, leaves)``."""
    part = settle(nodes.select("name", "up", "depth", "saved", "leaves"))
    sums = [F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")]
    done = []
    for k in range(height):  # what lies less than 2^(k+1) below each node whose depth this divides
        odd = F.shiftright("depth", k).bitwiseAND(F.lit(1).cast("long")) == 1
        done.append(part.filter(odd))
        owner = F.when(odd, F.element_at("up", 1)).otherwise(F.col("name")).alias("name")
        kept = [F.when(~odd, F.col(c)).alias(c) for c in ("up", "depth")]
        part = settle(part.select(owner, *kept, "saved", "leaves").groupBy("name").agg(F.max("up").alias("up"), F.max("depth").alias("depth"), *sums))
    whole = [part]  # the root alone
    for k in range(height - 1, -1, -1):
        known = reduce(DataFrame.unionByName, whole).filter("depth > 0")
        # the upper trie's leaves: the lower forests' roots, 2^k below the node that the total is for
        grafts = known.select(F.element_at("up", -1 - k).alias("name"), F.lit(None).cast("array<binary>").alias("up"), F.lit(None).cast("long").alias("depth"), "saved", "leaves")
        both = done[k].unionByName(grafts).groupBy("name").agg(F.max("up").alias("up"), F.max("depth").alias("depth"), *sums)
        whole.append(settle(both))
    return reduce(DataFrame.unionByName, whole).select("name", "saved", "leaves")


def list_digests(ends: DataFrame) -> DataFrame:
    """``(name, digest)``: the SHA-256 of each node's ids ``(name, seq)``, ascending and joined by commas.

    The ids of a node are sorted and joined across partitions; only the digest itself, which has to read a list from its
    start, goes through a list's pieces in one task, holding one piece at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, ids = None, 0, []

        def made():
            return pa.RecordBatch.from_pydict({"name": pa.array([name], pa.binary()), "first": [first], "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for n, seq in zip(batch.column("name").to_pylist(), batch.column("seq").to_pylist()):
                if ids and (n != name or len(ids) >= PIECE):
                    yield made()
                    ids = []
                if not ids:
                    name, first = n, seq
                ids.append(seq)
        if ids:
            yield made()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            names, values = [], []
            for n, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if state is not None and n == name:
                    state.update(b",")
                else:
                    if state is not None:
                        names.append(name)
                        values.append(state.hexdigest())
                    name, state = n, hashlib.sha256()
                state.update(ids.encode())
            if names:
                yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.binary()), "digest": values})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"name": pa.array([name], pa.binary()), "digest": [state.hexdigest()]})

    ship(ends.sparkSession)
    joined = ends.repartitionByRange("name", "seq").sortWithinPartitions("name", "seq").mapInArrow(pieces, "name binary, first long, ids string")
    return joined.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digests, "name binary, digest string")


def prefix_trie(sequences: DataFrame, turns: DataFrame) -> DataFrame:
    """The distinct prefixes of sequences: ``name, depth, parent, low, members, children, leaves, saved, digest``.

    ``sequences (seq, size)`` are all of them, empty ones too; ``turns (seq, place, symbol, weight, last)`` their places from 1 to
    ``size``. ``low`` is the smallest sequence that starts with the prefix and ``members`` how many do; ``leaves`` and ``saved``
    are sums over the subtree, of childless nodes and of (members - 1) * weight of a node's last turn; ``digest`` that of the
    sequences that end there. The root (the empty prefix) has a null parent; without sequences there is no node.
    """
    top = sequences.agg(F.max("size").alias("size")).first()["size"]
    height = int(top or 0).bit_length()  # 2^height is more than the longest sequence
    empty = sequences.filter("size = 0").select("seq", F.lit(ROOT).alias("name"))
    root = sequences.groupBy().agg(F.min("seq").alias("low"), F.count(F.lit(1)).alias("members")).filter("members > 0").select(
        F.lit(ROOT).alias("name"), F.lit(0).cast("long").alias("depth"), F.array().cast("array<binary>").alias("up"), "low", "members",
        F.lit(0).cast("long").alias("weight"))
    if height:
        paths = _paths(_blocks(turns, height))
        inner = paths.groupBy("name", "depth", "up", "weight").agg(F.min("seq").alias("low"), F.count(F.lit(1)).alias("members"))
        ends = paths.filter("last").select("seq", "name").unionByName(empty)
        nodes = settle(inner.select(*root.columns).unionByName(root))
    else:
        nodes, ends = settle(root), empty
    parent = F.when(F.size("up") > 0, F.element_at("up", -1)).alias("parent")
    children = nodes.select(parent).filter("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("children"))
    known = settle(nodes.join(children, "name", "left").withColumn("children", F.coalesce("children", F.lit(0).cast("long"))))
    totals = _totals(known.withColumn("saved", (F.col("members") - 1) * F.col("weight")).withColumn("leaves", (F.col("children") == 0).cast("long")), height)
    digest = F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("digest")
    return (known.join(totals, "name").join(list_digests(settle(ends)), "name", "left")
            .select("name", "depth", parent, "low", "members", "children", "leaves", "saved", digest))


def trie_report(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; a node goes by its depth and its smallest member."""
    nodes = settle(prefix_trie(*rebuilt(numbered(turns))))
    names = nodes.filter("children > 0").select(F.col("name").alias("parent"), F.col("low").alias("parent_conv_id"))
    return nodes.join(names, "parent", "left").select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("digest").alias("ends_sha256"))


#: The same by the whole lists of turns. DuckDB has no crc32, so it is worked out bit by bit.
SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'role': role, 'text': text} ORDER BY i) AS l FROM t GROUP BY c),
sums AS (SELECT c, l, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, x: list_reduce(list_prepend(xor(s, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda r, y: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT) % 6 AS h FROM own),
made AS (SELECT a.c, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM sums a LEFT JOIN own b ON b.c = a.c - a.c % 100),
rows AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM made),
pre AS (SELECT c, d, l[1:d] AS p, CASE WHEN d > 0 THEN l[1:d - 1] END AS up, d = len(l) AS ends FROM rows),
node AS (SELECT p, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM pre GROUP BY p),
kids AS (SELECT up, count(*) AS n FROM node WHERE depth > 0 GROUP BY up),
own_value AS (SELECT node.*, coalesce(n, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(node.p[depth].text) ELSE 0 END AS saved
  FROM node LEFT JOIN kids ON kids.up = node.p),
above AS (SELECT p, n_children, saved, unnest(range(0, depth + 1)) AS d FROM own_value),
below AS (SELECT p[1:d] AS p, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM above GROUP BY 1)
SELECT o.conv_id, o.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs, o.n_children::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, o.ends_sha256
FROM own_value o JOIN below b ON b.p = o.p LEFT JOIN node u ON u.p = o.up
"""
