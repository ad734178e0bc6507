"""Benchmark decontamination: passages of benchmark items found in documents, in SQL functions alone.

A window is as many word shingles as an item has. One that shares no shingle with any item has similarity 0, and moving a
window to its first shared shingle cannot lower its similarity, so windows are laid at the shared shingles. Each is
SimHashed. Two fingerprints within ``RADIUS`` bits differ in at most two bits in one of their eight bytes at least: items
are indexed under all bytes within two bits of theirs, and every such pair is found. Pairs within the radius are then
compared exactly: the sum of the smaller over the sum of the larger multiplicities of all shingles of window and item.

An item of more than ``PART`` words is not cut either, but its windows are not written out: a run of places in a document
counts for the windows that begin in an interval, and running sums over the intervals' borders give the shared shingles of
every window at once, without fingerprints.

Benchmarks are broadcast in blocks of about ``BLOCK`` shingles and ``ITEMS`` items at most; a larger one takes several passes over the documents.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelkit.session import settle

SHINGLE, SIMILARITY = 5, 0.8
#: Two bits in each of eight bytes, and all but one of them more: 8 * 3 - 1.
RADIUS, NEAR = 23, 2
#: Shingles of benchmark items broadcast at once, and words of an item whose windows are written out and fingerprinted.
BLOCK, PART = 500_000, 4096
#: Items of one block: each has 296 rows in the broadcast index.
ITEMS = 5_000
SPACES = " \t\n\u000b\f\r"


def words(text: Column | str) -> Column:
    """Lower-cased words between white space; none for a null or blank text."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+"))


def shingles(parts: Column, size: int) -> Column:
    """All runs of ``size`` words, joined by one space."""
    count = F.size(parts) - size + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(parts, i, size), " "))
                  ).otherwise(F.array().cast("array<string>"))


def numbered(values: Column) -> Column:
    """Repeats told apart (``value``, ``value|1``, ...), so that a multiset becomes a set."""

    def told_apart(all_: Column) -> Column:
        repeats = F.transform(all_, lambda v, i: F.concat_ws("\u0000", v, F.size(F.filter(
            F.slice(all_, 1, i), lambda u: u == v)).cast("string")))
        plain = F.transform(all_, lambda v: F.concat(v, F.lit("\u00000")))
        return F.when(F.size(F.array_distinct(all_)) == F.size(all_), plain).otherwise(repeats)

    return _bound(values, told_apart)


def simhash(values: Column) -> Column:
    """SimHash of an array of strings: bit k is set if it is set in over half the XXH64 values. Repeats have values of their
    own, so that the share of differing bits follows the similarity of multisets.

    Sixteen numbers hold four 16-bit counters each; multiplying spreads the bits of half a byte over four counters.
    """
    return _bound(_bound(F.transform(values, lambda v: F.xxhash64(v)), _apart), _simhash)


def _apart(hashes: Column) -> Column:
    """The second and later ones of equal hashes hashed again with their number."""

    def repeats(ordered: Column) -> Column:
        return F.transform(ordered, lambda h, i: _bound(i + 1 - F.array_position(ordered, h), lambda k: F.when(
            k == 0, h).otherwise(F.xxhash64(h, k))))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(_bound(F.sort_array(hashes), repeats))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _simhash(hashes: Column) -> Column:
    spread, low = F.lit(0x0000200040008001), F.lit(0x0001000100010001)
    names = [f"c{k}" for k in range(16)]
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])
    counts = F.aggregate(hashes, zero, lambda s, h: F.struct(*[
        (s[n] + (F.shiftrightunsigned(h, 4 * k).bitwiseAND(F.lit(15).cast("long")) * spread).bitwiseAND(low)).alias(n)
        for k, n in enumerate(names)]))

    def gathered(c: Column) -> Column:
        bits = [F.when(F.shiftrightunsigned(c[n], 16 * j).bitwiseAND(F.lit(0xFFFF).cast("long")) * 2 > F.size(hashes),
                       F.shiftleft(F.lit(1).cast("long"), 4 * k + j)).otherwise(F.lit(0).cast("long"))
                for k, n in enumerate(names) for j in range(4)]
        return reduce(Column.bitwiseOR, bits)

    return _bound(counts, gathered)


def _byte(c: Column, k: int) -> Column:
    return F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255).cast("long"))


def _first_near(differ: Column) -> Column:
    """The first byte of ``differ`` with at most two bits set, so that a pair met under several bytes counts once."""
    out = F
    for k in range(8):
        out = out.when(F.bit_count(_byte(differ, k)) <= NEAR, F.lit(k))
    return out


def items(benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """``(item_id, part, size, n, shingles, print)``: ``part`` numbers the rows, ``size`` words are in a shingle (five, or all of
    a shorter item); items of more than ``PART`` words have no fingerprint."""
    some = benchmark.select(F.col(f"`{item}`").alias("item_id"), words(F.col(f"`{text}`")).alias("w")).filter(F.size("w") > 0)
    parts = some.withColumn("part", F.monotonically_increasing_id())
    sized = parts.withColumn("size", F.least(F.size("w"), F.lit(SHINGLE)))
    made = sized.withColumn("shingles", reduce(
        lambda out, k: out.when(F.col("size") == k, shingles(F.col("w"), k)), range(2, SHINGLE + 1),
        F.when(F.col("size") == 1, F.col("w"))))
    return made.select("item_id", "part", "size", F.size("shingles").alias("n"), "shingles",
                       F.when(F.size("w") <= PART, simhash(F.col("shingles"))).alias("print"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column behind a generator, so that filters on it do not compute it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _in_block(documents: DataFrame, some: DataFrame, size: int) -> DataFrame:
    """Matches of the items ``some``, all with shingles of ``size`` words; ``some`` is small enough to broadcast."""
    word = lambda parts, at: [F.get(parts, F.lit(at) + k) for k in range(size)]
    places = (some.select("n", F.explode("shingles").alias("shingle")).select("n", F.split("shingle", " ").alias("w"))
              .groupBy(F.xxhash64(*word("w", 0)).alias("hash")).agg(F.collect_set("n").alias("sizes")))
    cut = documents.select("doc_id", words(F.col("text")).alias("w"))
    starts = F.when(F.size("w") >= size, F.sequence(F.lit(0), F.size("w") - size))
    at = cut.select("doc_id", "w", F.explode(starts).alias("place"))
    met = at.withColumn("hash", F.xxhash64(*[F.get("w", F.col("place") + k) for k in range(size)])).join(F.broadcast(places), "hash")
    laid = met.select("doc_id", "place", F.explode("sizes").alias("n"), "w").select(
        "doc_id", "place", "n", F.slice("w", F.col("place") + 1, F.col("n") + (size - 1)).alias("w"))
    # a window cut short by the document's end can reach the similarity only with that share of the item's shingles
    laid = laid.filter(F.size("w") - (size - 1) >= SIMILARITY * F.col("n"))
    # written once: else filters that reach below the fingerprint would compute it again
    found = settle(laid.withColumn("p", simhash(shingles(F.col("w"), size))))
    in_bytes = lambda c: F.posexplode(F.array(*[_byte(F.col(c), k) for k in range(8)]))
    asked = found.select("doc_id", "place", "n", "w", "p", in_bytes("p").alias("byte", "value"))
    near = [m for m in range(256) if bin(m).count("1") <= NEAR]
    index = some.select("item_id", "part", "n", "print", in_bytes("print").alias("byte", "own"))
    index = index.select("*", F.explode(F.array(*[F.lit(m).cast("long") for m in near])).alias("m")).select(
        "item_id", "part", "n", "print", "byte", F.col("own").bitwiseXOR(F.col("m")).alias("value"))
    differ = F.col("p").bitwiseXOR(F.col("print"))
    pairs = asked.join(F.broadcast(index), ["n", "byte", "value"]).filter(
        (F.bit_count(differ) <= RADIUS) & (_first_near(differ) == F.col("byte")))
    mine = some.select("part", numbered(F.col("shingles")).alias("marks"))
    pairs = _once(pairs.select("doc_id", "item_id", "part", "place", "n", "w"), "s", shingles(F.col("w"), size))
    both = pairs.join(F.broadcast(mine), "part")
    exact = _once(both, "shared", F.size(F.array_intersect(numbered(F.col("s")), F.col("marks")))).withColumn(
        "similarity", F.col("shared") / (F.size("s") + F.col("n") - F.col("shared")))
    return exact.filter(F.col("similarity") >= SIMILARITY).select("doc_id", "item_id", "place", "similarity")


def _in_long(documents: DataFrame, some: DataFrame) -> DataFrame:
    """Matches of long items, small enough to broadcast. Of an item's ``c`` copies of a shingle, a window counts the place of
    one in the document if the ``c``-th place of it before that lies before the window."""
    split = lambda c: [F.get(F.split(c, " "), F.lit(k)) for k in range(SHINGLE)]
    own = some.select("part", "item_id", "n", F.explode("shingles").alias("s")).groupBy("part", "item_id", "n", "s").agg(
        F.count(F.lit(1)).cast("int").alias("c")).withColumn("hash", F.xxhash64(*split("s")))
    cut = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    at = cut.select("row", "doc_id", "w", F.explode(F.when(F.size("w") >= SHINGLE, F.sequence(F.lit(0), F.size("w") - SHINGLE))).alias("place"))
    met = at.withColumn("hash", F.xxhash64(*[F.get("w", F.col("place") + k) for k in range(SHINGLE)])).join(F.broadcast(own), "hash")
    same = F.array_join(F.slice("w", F.col("place") + 1, SHINGLE), " ") == F.col("s")
    total = (F.size("w") - (SHINGLE - 1)).alias("total")
    pair = ["row", "doc_id", "part", "item_id", "n", "total"]
    found = met.filter(same).select("row", "doc_id", "part", "item_id", "n", total, "s", "c", "place")
    places = found.groupBy(*pair, "s", "c").agg(F.sort_array(F.collect_list("place")).alias("places")).select(
        *pair, "c", "places", F.posexplode("places").alias("i", "q"))
    first = F.greatest(F.col("q") - F.col("n") + 1, F.coalesce(F.get("places", F.col("i") - F.col("c")), F.lit(-1)) + 1)
    mark = lambda at, step, start: F.struct(at.alias("place"), F.lit(step).alias("step"), F.lit(start).alias("start"))
    marks = F.explode(F.array(mark(first, 1, 0), mark(F.col("q") + 1, -1, 0), mark(F.col("q"), 0, 1))).alias("m")
    steps = places.select(*pair, marks).groupBy(*pair, "m.place").agg(F.sum("m.step").alias("step"), F.max("m.start").alias("start"))
    before = Window.partitionBy(*pair).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = steps.withColumn("shared", F.sum("step").over(before)).filter("start = 1")
    length = F.least(F.col("n"), F.col("total") - F.col("place"))
    return shared.withColumn("similarity", F.col("shared") / (length + F.col("n") - F.col("shared"))).filter(
        F.col("similarity") >= SIMILARITY).select("doc_id", "item_id", "place", "similarity")


def contaminated(documents: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_windows)``: one row per document and item with a window of at least
    0.8 weighted-shingle similarity: the best one's value and first place, and how many windows reach it.

    Null, empty and blank texts match nothing, on either side. Items of under five words are one shingle. Rows with one
    document id count as one document. Empty tables give an empty result; other columns are not read.
    """
    rows = documents.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = settle(items(benchmark, item_text, item))
    long = F.col("print").isNull()
    loads = known.groupBy("size", long.alias("long")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("many")).collect()
    found = []
    for size, is_long, total, many in sorted((r["size"], r["long"], r["total"], r["many"]) for r in loads):
        blocks = max(-(-total // BLOCK), -(-many // ITEMS))
        for block in range(blocks):
            mine = known.filter((F.col("size") == size) & (long == is_long) & (F.pmod(F.xxhash64("part"), F.lit(blocks)) == block))
            found.append(_in_long(rows, mine) if is_long else _in_block(rows, mine, size))
    if not found:
        return rows.limit(0).select("doc_id", F.lit(None).cast(known.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("similarity"),
                                    F.lit(0).alias("first_word"), F.lit(0).cast("long").alias("n_windows"))
    return (reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id")
            .agg(F.max("similarity").alias("similarity"),
                 F.max_by("place", F.struct("similarity", -F.col("place"))).alias("first_word"),
                 F.count(F.lit(1)).alias("n_windows")))


#: The same by brute force: every window that begins at a shingle of the item, without fingerprints.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             '[\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS s, len(w) - 4 AS total
       FROM d, unnest(range(len(w) - 4)) AS t(p) WHERE len(w) >= 5),
b AS (SELECT item_id, regexp_split_to_array(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             '[\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT item_id, array_to_string(w[p + 1:p + 5], ' ') AS s, len(w) - 4 AS n
       FROM b, unnest(range(len(w) - 4)) AS t(p) WHERE len(w) >= 5),
bc AS (SELECT item_id, n, s, count(*) AS c FROM bs GROUP BY ALL),
starts AS (SELECT ds.doc_id, bc.item_id, bc.n, ds.p, least(bc.n, ds.total - ds.p) AS m FROM ds JOIN bc USING (s)),
wc AS (SELECT st.doc_id, st.item_id, st.n, st.p, st.m, ds.s, count(*) AS c
       FROM starts st JOIN ds ON ds.doc_id = st.doc_id AND ds.p >= st.p AND ds.p < st.p + st.m GROUP BY ALL),
sims AS (SELECT wc.doc_id, wc.item_id, wc.p, sum(least(wc.c, bc.c)) AS shared, any_value(wc.m + wc.n) AS sizes
         FROM wc JOIN bc ON bc.item_id = wc.item_id AND bc.s = wc.s GROUP BY ALL),
hits AS (SELECT doc_id, item_id, p, shared / (sizes - shared) AS similarity FROM sims WHERE shared / (sizes - shared) >= 0.8)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_max(p, similarity * 1000000 - p / 1000000.0) AS INT) AS first_word,
       count(*) AS n_windows
FROM hits GROUP BY doc_id, item_id
"""
