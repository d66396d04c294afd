"""Line dedup by an exact set-similarity join, with built-in DataFrame functions only.

A line is the set of its lower-cased words, as 64-bit hashes, which are made once and stored. Words are ordered by
rarity (levels, four to a doubling, of the counts in 2^18 hash classes, so the order takes a fixed size whatever the
vocabulary; any one order gives exact results). Two sets of Jaccard similarity THRESHOLD or more share a word among the
first n - ceil(THRESHOLD * n) + 1 of each. Lines with equal sets are one set from then on, numbered in order of first
occurrence. Pairs come from a join on prefix words under the length and positional filters and one by signatures of
BITS bits, and are verified on all words. Words of many prefixes are first joined with the earliest of their sets only:
sets that this finds matched need no other partner, which spares the pairs within large families of variants.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

THRESHOLD = 0.85
CLASS_BITS = 18
#: Files whose classes one task counts, where there are enough files for all cores.
COUNTED = 4
#: Sets of a prefix word from which its earliest set is tried first, and rows up to which a side is broadcast.
FAMILY, BROADCAST_ROWS = 16, 500_000
#: Words of 64 bits of a signature; bits of a key that are not its level.
WIDE, HASH_BITS = 2, 56
#: Bits of the number of a line within its document, in the number of its set.
LINE_BITS = 31
#: Parts that the join on prefix words is run in, one after the other, by the words; two took no less disk.
PARTS = 1
SIG = [f"w{i}" for i in range(WIDE)]
#: A dictionary of this many bytes holds the words of all lines, which then take a few bytes a word.
DICTIONARY = {"parquet.dictionary.page.size": str(16 << 20), "parquet.size.statistics.enabled": "false", "parquet.column.statistics.enabled": "false", "parquet.compression.codec.zstd.level": "1"}
#: Words of fewer lines are written as they are: to look each up in a dictionary and count it takes longer than all else of a write.
PLAIN = {"parquet.enable.dictionary": "false", "parquet.size.statistics.enabled": "false", "parquet.column.statistics.enabled": "false", "parquet.compression.codec.zstd.level": "1"}


#: Groups that the generated code of an aggregation holds in its own map (as a power of two), 2^16 by default: others
#: take several times as long, and classes of words, and rows of a task, are more than that.
MAP_BITS = ("spark.sql.codegen.aggregate.fastHashMap.capacityBit", "19")


def _large_maps(made: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """With MAP_BITS set while the function runs, and set back afterwards."""

    @wraps(made)
    def run(docs: DataFrame) -> DataFrame:
        conf = docs.sparkSession.conf
        before = conf.get(MAP_BITS[0])
        conf.set(*MAP_BITS)
        try:
            return made(docs)
        finally:
            conf.set(MAP_BITS[0], before)

    return run


def _lowered(text: Column) -> Column:
    """Lower case, with one kind of blank between words; only texts that have others are searched for each."""
    blank, others = text, F.lit(False)
    for c in "\t\x0b\x0c\r":
        blank, others = F.replace(blank, F.lit(c), F.lit(" ")), others | F.contains(text, F.lit(c))
    return F.lower(F.when(others, blank).otherwise(text))


def _tokens(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """row, doc_id, text_hash, no (from 1), words (distinct hashes) of the lines that have words."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(_lowered(text), "\n", -1)).alias("no", "line"))
    words = F.array_except(F.transform(F.split("line", " ", -1), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))
    lines = lines.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", (F.col("no") + 1).alias("no"), words.alias("words"))
    return scratch.save(lines.where(F.size("words") > 0), "tokens", **DICTIONARY)


def _names(tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash and d (from 0, in order, null doc_id last) of the documents that have words."""
    names = tokens.select("doc_id", "text_hash").distinct().orderBy(F.col("doc_id").isNull(), "doc_id", "text_hash")
    names = scratch.save(names.select("doc_id", "text_hash", F.monotonically_increasing_id().alias("i")), "names")
    names = names.select("doc_id", "text_hash", F.shiftright("i", 33).alias("part"), F.col("i").bitwiseAND((1 << 33) - 1).alias("i"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = names.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    return names.join(F.broadcast(parts), "part").select("doc_id", "text_hash", (F.col("before") + F.col("i")).alias("d"))


def _levels(tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """One row: the level of each class of words, in the upper bits of a key. Gathered in two steps, so that no task sorts all classes.

    A task counts several files, as each passes on a row for nearly every class.
    """
    size, part = 1 << CLASS_BITS, 1 << (CLASS_BITS // 2)
    tasks = max(tokens.sparkSession.sparkContext.defaultParallelism, len(tokens.inputFiles()) // COUNTED)
    counts = tokens.coalesce(tasks).select(F.explode("words").alias("h")).select(F.col("h").bitwiseAND(size - 1).alias("c")).groupBy("c").count()
    every = tokens.sparkSession.range(size).join(counts, F.col("id") == F.col("c"), "left")
    level = F.shiftleft(F.least(F.lit(127), F.floor(4 * F.log2(F.coalesce("count", F.lit(0)) + 1))).cast("long"), HASH_BITS)
    in_order = lambda x, by: F.transform(F.sort_array(F.collect_list(F.struct(by, x))), lambda s: s[x])
    parts = every.select("id", level.alias("level"), F.floor(F.col("id") / part).alias("part")).groupBy("part").agg(in_order("level", "id").alias("levels"))
    return scratch.save(parts.agg(F.flatten(in_order("levels", "part")).alias("levels")), "levels")


def _keys(words: Column, levels: Column) -> Column:
    """Words by rarity: the level of the class, then the upper bits of the hash. Keys are never null, and Spark is told
    so: it then sorts plain numbers."""
    size = (1 << CLASS_BITS) - 1

    def key(h: Column) -> Column:
        level = F.get(levels, h.bitwiseAND(size).cast("int"))
        return F.coalesce(level.bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS)), F.lit(0).cast("long"))

    return F.sort_array(F.transform(words, key))


def _prefix(n: Column) -> Column:
    return (n - F.ceil(n * THRESHOLD - 1e-9) + 1).cast("int")


def _short(n: Column) -> Column:
    """Words of the prefix of a set that is compared with sets of its length and longer ones only."""
    return (n - F.ceil(n * (2 * THRESHOLD / (1 + THRESHOLD)) - 1e-9) + 1).cast("int")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _signatures(tokens: DataFrame) -> DataFrame:
    """Of each row, a bit of WIDE * 64 for each of its words."""
    h = F.col("h")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    place = F.shiftrightunsigned(h, 32) % WIDE
    each = tokens.select("row", F.explode("words").alias("h")).select("row", place.alias("place"), bit.alias("bit"))
    return each.groupBy("row").agg(*[F.bit_or(F.when(F.col("place") == i, F.col("bit")).otherwise(0)).alias(c) for i, c in enumerate(SIG)])


def _only(k: str, other: str) -> Column:
    """Words that one set has and the other has not, at least: bits that only its signature has."""
    return sum((F.bit_count(F.col(f"{k}{c}").bitwiseAND(F.bitwise_not(F.col(f"{other}{c}")))) for c in SIG), F.lit(0))


def _bound(a: str, b: str) -> Column:
    """What two sets have in common, at most, by their signatures."""
    return F.least(F.col(f"{a}n") - _only(a, b), F.col(f"{b}n") - _only(b, a))


def _fits(a: str, b: str) -> Column:
    """What length, position and signatures allow of two sets at the first word that their prefixes share: nothing is
    common before that word."""
    a_n, b_n = F.col(f"{a}n"), F.col(f"{b}n")
    need = F.lit(THRESHOLD / (1 + THRESHOLD)) * (a_n + b_n) - 1e-9
    after = F.least(a_n - F.col(f"{a}pos"), b_n - F.col(f"{b}pos"))
    return (F.least(a_n, b_n) >= THRESHOLD * F.greatest(a_n, b_n) - 1e-9) & (after >= need) & (_bound(a, b) >= need)


def _verified(pairs: DataFrame, rows: DataFrame, tokens: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """b (number of the later set) of the pairs (a, b, bound) that are similar on all words."""
    pairs = scratch.save(pairs, f"pairs-{name}")
    scratch.tidy()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = scratch.save(rows.join(ids, rows["set"] == ids["id"], "left_semi").select("set", F.col("row").alias("own")), f"held-{name}")
    full = tokens.select("row", "words").join(_small(held, held.count()), F.col("row") == F.col("own")).select("set", "words")
    full = scratch.save(full, f"full-{name}", **PLAIN)
    scratch.tidy()

    def confirmed(some: DataFrame, step: str) -> DataFrame:
        x, y = (full.select(F.col("set").alias(k), F.col("words").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        held = some.join(x, "a").join(y, "b").select("b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
        alike = F.col("common") >= THRESHOLD * (F.col("m") + F.col("n") - F.col("common")) - 1e-9
        return scratch.save(held.where(alike).select("b").distinct(), f"matched-{step}-{name}")

    # One partner is enough for a set, and mostly the likeliest is one; only where it is not, the others are tried.
    best = scratch.save(pairs.groupBy("b").agg(F.max(F.struct("bound", "a")).alias("m")).select("b", F.col("m.a").alias("a")), f"best-{name}")
    some = confirmed(best, "best")
    left = pairs.join(_small(some.withColumnRenamed("b", "gone"), some.count()), F.col("b") == F.col("gone"), "left_anti")
    left = left.join(best.withColumnsRenamed({"b": "tried", "a": "with"}), (F.col("b") == F.col("tried")) & (F.col("a") == F.col("with")), "left_anti")
    rest = confirmed(left.select("a", "b"), "rest")
    scratch.drop(*(f"{x}-{name}" for x in ("pairs", "held", "full", "best")))
    scratch.tidy()
    return some.unionByName(rest)


@_large_maps
def removed_lines(docs: DataFrame) -> DataFrame:
    """One row per document with lines that have a similar line before them: doc_id, text_hash, gone (their numbers from
    1, in order).

    Before means in order of doc_id (null last), text_hash and number; equal lines are similar. docs: doc_id, text;
    other columns are not read. Lines without words are never removed and match nothing. Rows alike in doc_id and text
    are one document. Null and empty texts have no lines. No rows give none.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    tokens = _tokens(docs, scratch)
    names = _names(tokens, scratch)
    papers = names.count()
    levels = _levels(tokens, scratch)
    n = F.size("keys")
    lines = tokens.withColumn("levels", levels.scalar()).select("row", "doc_id", "text_hash", "no", _keys(F.col("words"), F.col("levels")).alias("keys"))
    lines = lines.select("row", "doc_id", "text_hash", "no", F.xxhash64("keys").alias("s"), F.xxhash64(F.lit(1), "keys").alias("t"), n.alias("n"), F.slice("keys", 1, _prefix(n)).alias("prefix"))
    lines = scratch.save(lines, "lines", **PLAIN)
    scratch.tidy()
    named = _small(names.withColumnsRenamed({"doc_id": "id", "text_hash": "h"}), papers)
    placed = lines.select("row", "doc_id", "text_hash", "no", "s", "t").join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h")))
    placed = scratch.save(placed.select(F.shiftleft("d", LINE_BITS).bitwiseOR(F.col("no")).alias("at"), "row", "s", "t"), "keys")
    # A set has the number of its first line; all that is gathered are plain numbers, so nothing is sorted.
    firsts = placed.groupBy("s", "t").agg(F.min("at").alias("set"), F.min_by("row", "at").alias("row"), F.count(F.lit(1)).alias("times"))
    firsts = scratch.save(firsts.select("set", "row", "s", "t", "times"), "firsts")
    scratch.tidy()
    rows = firsts.select("set", "row")
    sets = lines.select("row", "n", "prefix").join(rows, "row").join(_signatures(tokens), "row")
    sets = scratch.save(sets.select("set", "n", *SIG, "prefix"), "sets", **PLAIN)
    scratch.drop("lines")
    scratch.tidy()
    postings = sets.select("set", "n", *SIG, F.posexplode("prefix").alias("pos", "word"))

    wide = sets.select("set", F.explode(F.slice("prefix", 1, _short(F.col("n")))).alias("word")).groupBy("word").agg(F.min("set").alias("head"), F.count(F.lit(1)).alias("df")).where(F.col("df") > FAMILY)
    wide = scratch.save(wide.select("word", "head"), "wide")
    side = lambda k: [F.col(c).alias(f"{k}_{c}") for c in ("set", "n", "pos", *SIG)]
    few = wide.count()
    leading = wide.select(F.col("head").alias("set")).distinct()
    leading = sets.join(_small(leading, few), "set", "left_semi").select("set", "n", *SIG, F.posexplode("prefix").alias("pos", "word"))
    heads = leading.select("word", *side("a")).join(_small(wide.withColumnRenamed("word", "w"), few), (F.col("word") == F.col("w")) & (F.col("head") == F.col("a_set"))).drop("word", "head")
    heads = scratch.save(heads, "heads")
    scratch.tidy()
    near = postings.select("word", *side("b")).join(_small(heads, few), (F.col("word") == F.col("w")) & (F.col("a_set") < F.col("b_set")) & _fits("a_", "b_"))
    pair = lambda df: df.groupBy(F.col("a_set").alias("a"), F.col("b_set").alias("b")).agg(F.max(_bound("a_", "b_")).alias("bound"))
    first = _verified(pair(near), rows, tokens, scratch, "first")

    # Matched sets are marked by a negative number. x is the shorter set of a pair (of equal ones the earlier), so a short
    # prefix of it is enough. What else it has is left out after the exchange, which both sides share; Spark would move
    # a plain condition before it, and one for what might be null.
    marked = sets.join(_small(first, first.count()), F.col("set") == F.col("b"), "left")
    known = lambda c: F.coalesce(c, F.lit(0))
    mark = known(F.when(F.col("b").isNull(), F.col("set")).otherwise(-1 - F.col("set")))
    marked = marked.select(mark.alias("set"), known(F.col("n")).alias("n"), *[known(F.col(c)).alias(c) for c in SIG], F.posexplode("prefix").alias("pos", "word"))
    own = lambda c: F.when(F.col(c) < 0, -1 - F.col(c)).otherwise(F.col(c))
    a, b = own("a_set"), own("b_set")
    parts: list[DataFrame] = []
    for part in range(PARTS):
        dealt = marked.where(F.pmod("word", F.lit(PARTS)) == part).repartition("word")
        x = dealt.where(F.when(F.monotonically_increasing_id() >= 0, F.col("pos") < _short(F.col("n")))).select(F.col("word").alias("a_word"), *side("a"))
        y = dealt.select(F.col("word").alias("b_word"), *side("b"))
        order = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (a < b))
        wanted = F.when(a > b, F.col("a_set")).otherwise(F.col("b_set")) >= 0
        met = x.join(y, (F.col("a_word") == F.col("b_word")) & order & wanted & _fits("a_", "b_"))
        met = met.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(_bound("a_", "b_")).alias("bound"))
        parts.append(scratch.save(met, f"met-{part}"))
        scratch.tidy()
    second = _verified(reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.max("bound").alias("bound")), rows, tokens, scratch, "second")

    scratch.drop("sets", "tokens", *(f"met-{part}" for part in range(PARTS)))
    matched = first.unionByName(second).distinct()
    flagged = firsts.join(matched, F.col("set") == F.col("b"), "left").where((F.col("times") > 1) | F.col("b").isNotNull())
    flagged = flagged.select(F.col("s").alias("fs"), F.col("t").alias("ft"), "set", F.col("b").isNotNull().alias("matched"))
    out = placed.join(flagged, (F.col("s") == F.col("fs")) & (F.col("t") == F.col("ft"))).where(F.col("matched") | (F.col("at") != F.col("set")))
    no = F.col("at").bitwiseAND((1 << LINE_BITS) - 1).cast("int")
    out = out.groupBy(F.shiftright("at", LINE_BITS).alias("of")).agg(F.sort_array(F.collect_set(no)).alias("gone"))
    return out.join(_small(names, papers), F.col("of") == F.col("d")).select("doc_id", "text_hash", "gone")


def _with_removed(docs: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    scratch = Scratch(docs.sparkSession, "removed")
    gone = scratch.save(removed_lines(docs).withColumnsRenamed({"doc_id": "__id", "text_hash": "__h", "gone": "__gone"}), "gone")
    lines = gone.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("__gone")), F.lit(0))).first()[0]
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return hashed, _small(gone, lines // 4), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__h"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines (a null text has none), n_removed, removed (numbers, comma-joined)."""
    own = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    hashed, gone, same = _with_removed(docs)
    narrow = hashed.select("doc_id", "__text_hash", own.alias("n_lines"))
    out = narrow.join(gone, same, "left")
    numbers = F.coalesce(F.col("__gone"), F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(numbers).cast("long").alias("n_removed"), F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",").alias("removed"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines out of text, and n_chars, if it is there, as of the new text.

    Documents of which no word stays are dropped; documents without words to begin with stay as they are.
    """
    hashed, gone, same = _with_removed(docs)
    joined = hashed.join(gone, same, "left")
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("__gone"), i + 1))
    left = joined.withColumn("__new", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    left = left.where(F.col("__gone").isNull() | F.col("__new").rlike(r"[^\x20\x09-\x0D]"))
    put = {"text": F.col("__new").alias("text"), "n_chars": F.coalesce(F.length("__new"), F.lit(0)).cast(dict(docs.dtypes).get("n_chars", "long")).alias("n_chars")}
    return left.select(*[put.get(c, F.col(c)) for c in docs.columns])
