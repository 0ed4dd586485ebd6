"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only.

A document leaks an item if one of its windows, as many words long as the item, has a weighted-shingle similarity (bags of
five-word shingles, sum of minima over sum of maxima) of at least ``threshold`` with the item.

* A qualifying window shares shingles with the item. All rolling shingles of the documents are joined with the items' shingles;
  of each run of matches on one diagonal only the first (the leader) goes on, with the words around it. Whenever some
  window qualifies, so does one that contains a leader, hence only windows that contain leaders are looked at.
* Windows that hold too few shingles of the item to reach the threshold go (a bound, no estimate); the others get a SimHash. Both
  counts roll: from one window to the next one shingle goes and one comes. They start anew every ``STEP`` windows.
* Fingerprints are cut into 8 blocks of 8 bits. Two that differ in at most ``RADIUS`` = 23 bits differ in at most 2 bits of some
  block, and the item index holds all values within 2 bits of each of its blocks: no pair within the radius is lost.
  At the threshold fingerprints differ in about 10 bits, with a standard deviation of 3.
* Candidates within the radius are verified exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetext.llm.common import table
from kinetext.llm.licenses import WORD, gram_rows

SHINGLE, THRESHOLD = 5, 0.8
BLOCKS, BLOCK_BITS, NEAR = 8, 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Windows whose counts roll in one row, and shingles from which counters have 32 bits (one more than the window's is counted for a moment).
STEP, WIDE = 256, 0x7FFF
#: Items, and words of them, whose tables are broadcast at a time; more of them are looked for in several passes.
MOST_ITEMS, MOST_WORDS = 5_000, 200_000


def words(text: Column) -> Column:
    """The words of a text, lower-cased (null: none)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(w: Column, k: int = SHINGLE) -> Column:
    """Hashes of all k-word shingles of an array of words."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, k), " ")))


def fingerprint(hashes: Column) -> Column:
    """The 64 bits that are set in over half of the hashes; counters of 16 bits lie four to a long, those of over 32,767 shingles have 32 bits (the uppermost must not reach the sign)."""
    return F.when(F.size(hashes) <= 0x7FFF, _fingerprint(hashes, 16, 0x0001000100010001)).otherwise(_fingerprint(hashes, 32, 0x0000000100000001))


def _lanes(acc: Column, h: Column, ones: int) -> Column:
    return F.transform(acc, lambda a, j: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(ones)))


def _zero(wide: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), wide)


def _bits(lanes: Column, n: Column, wide: int) -> Column:
    """The bits that over half of ``n`` hashes have, of their packed counters."""
    def finish(x: Column) -> Column:
        def fold(f: Column, b: Column) -> Column:
            count = F.call_function("shiftrightunsigned", F.get(x["lanes"], b % wide), (b / wide).cast("int") * wide).bitwiseAND(F.lit((1 << wide) - 1))
            return f.bitwiseOR(F.when(count * 2 > x["n"], F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), fold)

    # an array of one element carries the counters into the fold, so that they are counted once
    return F.get(F.transform(F.array(F.named_struct(F.lit("lanes"), lanes, F.lit("n"), n)), finish), 0)


def _fingerprint(hashes: Column, wide: int, ones: int) -> Column:
    return _bits(F.aggregate(hashes, _zero(wide), lambda acc, h: _lanes(acc, h, ones)), F.size(hashes), wide)


def _member(flags: Column, i: Column) -> Column:
    return F.coalesce(F.get(flags, i), F.lit(False)).cast("int")


def _rolling(n: Column, last: Column, flags: Column) -> Column:
    """The largest number of flags in any window of ``n`` places that starts at 0 ... ``last``."""
    first = F.size(F.filter(F.slice(flags, 1, n), lambda x: x))
    state = F.struct(first.alias("now"), first.alias("most"))

    def step(x: Column, i: Column) -> Column:
        now = x["now"] + _member(flags, i + n) - _member(flags, i)
        return F.struct(now.alias("now"), F.greatest(x["most"], now).alias("most"))

    return F.when(last < 1, first).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), state, step, lambda x: x["most"]))


def _prints(s: Column, flags: Column, n: Column, last: Column, bound: Column, wide: int, ones: int) -> Column:
    """(at, fp) of the windows of ``n`` shingles that start at 0 ... ``last`` and hold at least ``bound`` flags."""
    lanes = F.aggregate(F.slice(s, 1, n), _zero(wide), lambda acc, h: _lanes(acc, h, ones))
    none = F.array().cast("array<struct<at:int,fp:bigint>>")
    state = F.struct(lanes.alias("lanes"), F.size(F.filter(F.slice(flags, 1, n), lambda x: x)).alias("now"), none.alias("out"))

    def step(x: Column, i: Column) -> Column:
        own = F.struct(i.alias("at"), _bits(x["lanes"], F.least(n, F.size(s)), wide).alias("fp"))
        moved = F.transform(x["lanes"], lambda a, j: a + F.coalesce(F.call_function("shiftrightunsigned", F.get(s, i + n), j).bitwiseAND(F.lit(ones)), F.lit(0)) - F.call_function("shiftrightunsigned", F.get(s, i), j).bitwiseAND(F.lit(ones)))
        now = x["now"] + _member(flags, i + n) - _member(flags, i)
        return F.struct(moved.alias("lanes"), now.alias("now"), F.when(x["now"] >= bound, F.concat(x["out"], F.array(own))).otherwise(x["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), last), state, step, lambda x: x["out"])


def held(s: Column, bag: Column) -> Column:
    """For each shingle of ``s`` whether ``bag`` holds it; the shingles they share are looked up in about half the root of their number of groups."""
    def look(x: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), x["k"] - 1), lambda g: F.filter(x["both"], lambda y: F.pmod(y, x["k"]) == g))
        return F.get(F.transform(F.array(groups), lambda gs: F.transform(x["s"], lambda y: F.array_contains(F.get(gs, F.pmod(y, x["k"]).cast("int")), y))), 0)

    both = F.array_intersect(bag, s)
    facts = F.get(F.transform(F.array(both), lambda c: F.named_struct(F.lit("both"), c, F.lit("k"), F.ceil(F.sqrt(F.size(c) + 1) / 2).cast("int"), F.lit("s"), s)), 0)
    return F.get(F.transform(F.array(facts), look), 0)


def block(fp: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, (b * BLOCK_BITS).cast("int")).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def repeated(a: Column) -> Column:
    """The shingles that a bag holds more than once."""
    return F.get(F.transform(F.array(F.array_sort(a)), lambda o: F.array_distinct(F.filter(o, lambda x, i: (i > 0) & (F.get(o, i - 1) == x)))), 0)


def similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of two bags of shingles: their common set, and what more both hold of repeated ones."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    more = F.aggregate(F.array_intersect(repeated(a), repeated(b)), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)) - 1)
    return F.get(F.transform(F.array(F.size(F.array_intersect(a, b)) + more), lambda both: both / (F.size(a) + F.size(b) - both)), 0)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): each item that a document leaks, its best similarity and the best window's first word.

    Items of fewer than five words have one shingle, their whole sequence. Null or empty texts on either side never match;
    null ids stay null; repeated rows of one doc_id give one row per item; ties take the smallest first word;
    other columns are dropped first; empty tables give no rows. A document shorter than the item is one window.
    """
    it = items.select("item_id", words(F.col("text")).alias("t")).filter(F.size("t") > 0).distinct()
    it = it.withColumn("size", F.size("t"))
    facts = it.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.collect_set(F.when(F.col("size") < SHINGLE, F.col("size"))).alias("short")).first()
    passes = max(1, -(-facts.items // MOST_ITEMS), -(-facts.words // MOST_WORDS))
    base = docs.select("doc_id", words(F.col("text")).alias("w"))
    found = [x for n in range(passes) for x in _pass(base, it.filter(F.pmod(F.xxhash64("t"), F.lit(passes)) == n) if passes > 1 else it, sorted(facts.short), threshold)]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max_by("pos", F.struct("similarity", -F.col("pos"))).cast("long").alias("first_word"))


def _pass(base: DataFrame, it: DataFrame, short: list[int], threshold: float) -> list[DataFrame]:
    """Matches with a bounded part of the items, which is broadcast."""
    out = [_long(base, it.filter(F.col("size") >= SHINGLE), threshold)]
    for k in short:  # an item of fewer words is found as a whole
        own = it.filter(F.col("size") == k).select("item_id", F.xxhash64(*[F.col("t")[i] for i in range(k)]).alias("gram"), *[F.col("t")[i].alias(f"t{i}") for i in range(k)])
        rows = base.select("doc_id", F.posexplode(gram_rows(F.col("w"), k)).alias("pos", "g")).select("doc_id", "pos", *[F.col(f"g.w{i}").alias(f"w{i}") for i in range(k)])
        same = F.xxhash64(*[f"w{i}" for i in range(k)]) == F.col("gram")
        for i in range(k):
            same &= F.col(f"w{i}") == F.col(f"t{i}")
        out.append(rows.join(F.broadcast(own), same).select("doc_id", "item_id", F.lit(1.0).alias("similarity"), "pos"))
    return out


def _long(base: DataFrame, it: DataFrame, threshold: float) -> DataFrame:
    k = SHINGLE
    # Each shingle of the items, with the word before it: a match whose words before agree too is no leader.
    grams = it.select("item_id", "size", "t", F.posexplode(gram_rows(F.col("t"), k)).alias("tpos", "g")).filter(F.col(f"g.w{k - 1}").isNotNull())
    grams = grams.select(*[F.col(f"g.w{i}").alias(f"t{i}") for i in range(k)], F.struct("item_id", "size", "tpos", F.when(F.col("tpos") > 0, F.get("t", F.col("tpos") - 1)).alias("before")).alias("place"))
    grams = grams.groupBy(*[f"t{i}" for i in range(k)]).agg(F.collect_list("place").alias("places")).withColumn("gram", F.xxhash64(*[f"t{i}" for i in range(k)]))
    rows = base.select("doc_id", "w", F.posexplode(gram_rows(F.col("w"), k)).alias("pos", "g")).select("doc_id", "w", "pos", *[F.col(f"g.w{i}").alias(f"w{i}") for i in range(k)])
    same = (F.xxhash64(*[f"w{i}" for i in range(k)]) == F.col("gram")) & F.col(f"w{k - 1}").isNotNull()
    for i in range(k):
        same &= F.col(f"w{i}") == F.col(f"t{i}")
    hits = rows.join(F.broadcast(grams), same).select("doc_id", "w", "pos", F.inline("places"))
    leads = hits.filter(F.col("before").isNull() | (F.col("pos") == 0) | (F.get("w", F.col("pos") - 1) != F.col("before")))

    # The words around a leader: all windows that contain it.
    n = F.col("size") - (k - 1)
    low = F.greatest(F.lit(0), F.least(F.col("pos") - n + 1, F.size("w") - F.col("size")))
    ends = F.least(F.size("w"), F.col("pos") + F.col("size"))
    around = leads.select("doc_id", "item_id", "size", "pos", low.alias("low"), F.slice("w", low + 1, ends - low).alias("c"))
    around = around.select("doc_id", "item_id", "size", "low", shingles(F.col("c")).alias("s"), F.greatest(F.lit(0), F.size("c") - F.col("size")).alias("last"))
    known = F.broadcast(it.select("item_id", shingles(F.col("t")).alias("bag")))
    # Flags tell which shingles are the item's; leaders with too few of them around go at once.
    bound = threshold / (1 + threshold) * (F.least(n, F.size("s")) + F.size("bag")) - 1e-9
    around = around.join(known, "item_id").withColumn("flags", held(F.col("s"), F.col("bag"))).filter(F.size(F.filter("flags", lambda x: x)) >= bound)
    steps = around.select("doc_id", "size", "low", "s", "flags", "bag", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("from"))
    cut = lambda c: F.slice(c, F.col("from") + 1, n + STEP - 1).alias(c)
    steps = steps.select("doc_id", "size", (F.col("low") + F.col("from")).alias("low"), cut("s"), cut("flags"), "bag", F.least(F.col("last") - F.col("from"), F.lit(STEP - 1)).alias("last"))
    steps = steps.filter(_rolling(n, F.col("last"), F.col("flags")) >= bound)
    of = lambda wide, ones: _prints(F.col("s"), F.col("flags"), n, F.col("last"), bound, wide, ones)
    prints = F.when(n < WIDE, of(16, 0x0001000100010001)).otherwise(of(32, 0x0000000100000001))
    windows = steps.select("doc_id", "size", "low", "s", F.explode(prints).alias("x"))
    windows = windows.select("doc_id", "size", (F.col("low") + F.col("x.at")).alias("pos"), F.slice("s", F.col("x.at") + 1, n).alias("s"), F.col("x.fp").alias("fp"))
    windows = windows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("v", block(F.col("fp"), F.col("b")))

    spread = [0] + [m for m in range(1, 1 << BLOCK_BITS) if bin(m).count("1") <= NEAR]
    index = it.select("item_id", "size", fingerprint(shingles(F.col("t"))).alias("item_fp"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("b"))
    index = index.select("item_id", "size", "item_fp", "b", F.explode(F.transform(F.array(*map(F.lit, spread)), lambda m: block(F.col("item_fp"), F.col("b")).bitwiseXOR(m.cast("long")))).alias("v"))
    pairs = windows.join(F.broadcast(index), ["size", "b", "v"])
    off = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # A pair that meets in several blocks counts in its first.
    earlier = F.exists(F.filter(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda j: j < F.col("b")), lambda j: F.bit_count(block(off, j)) <= NEAR)
    pairs = pairs.filter((F.bit_count(off) <= RADIUS) & ~earlier).join(known, "item_id")
    return pairs.select("doc_id", "item_id", similarity(F.col("s"), F.col("bag")).alias("similarity"), "pos").filter(F.col("similarity") >= threshold)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
