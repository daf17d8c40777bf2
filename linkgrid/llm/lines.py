"""Line dedup by an exact set-similarity join; DataFrame operations only.

A line is what stands between line breaks, if it has a word; its set is its distinct words, each
as a code of 58 bits of its hash and its length. A line is removed if an earlier line, by
(doc_id, line number), has a word Jaccard similarity of 4/5 or more, whether or not that line is
itself removed.

1. Lines with equal sets (by a 128-bit key) form a class, known by its earliest line. Classes are
   numbered in the order of these lines, so that a place is one long.
2. Sets that are similar share neighbours. The words of a set stand in the order of their codes;
   a word that only this set has parts two pairs of neighbours in it, one that only the other has
   parts one. With p and q such words, 5 p + 4 q <= n, so at most 2 p + q pairs are lost, and among
   so many and one more pairs of each set that come first in any one order, one is common. Long
   words are rare, so pairs with many letters come first; no counts of words are needed.
3. Classes that share a pair must pass the length filter and a parity filter: equal words cancel
   in the exclusive or of two parity marks of 128 bits, so the bits left are at most the number
   of words in which the sets differ.
4. What passes is verified on the sets, made again from the text of just those lines: by parity
   marks of 512 bits, then by the whole sets.

No group of lines that share neighbours is expanded into all its pairs: the first round takes
each class with the earliest class there; only classes that it does not settle are joined
with the other earlier ones. Counts are combined before shuffles; both joins on neighbours can be
split by adaptive skew handling. Broadcast tables have a fixed number of rows. Neighbours are taken
in PARTS parts by their hash, one after the other, so that the shuffle files of one part only
are on disk at a time; tables that nothing reads any more are deleted.

Edge cases: null and empty texts have no lines; a line repeated within a document is removed
after its first; lines at the same place of rows that repeat a doc_id do not remove each other;
rows without doc_id keep all lines; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgrid.llm.common import kept, release, text_of

WANTED_BITS = 1 << 23
PARTS = 4
#: The low bits of a word's code hold its length in bytes, or this if it is longer.
LONG = 63
#: What a word is not made of besides a space and a line break.
BLANKS = "\t\x0b\x0c\r"
#: The parity marks that rows carry, and how many there are of a line that is verified.
MARKS = ("mark0", "mark1")
WIDE = 8


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    split = rows.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.where(F.btrim("line", F.lit(" \n" + BLANKS)) != "")


def _codes(line: str = "line") -> Column:
    """The set of a line in ascending order: 58 bits of a word's hash, then its length."""
    def code(word: Column) -> Column:
        size = F.least(F.octet_length(word), F.lit(LONG)).cast("bigint")
        return F.xxhash64(word).bitwiseAND(F.lit(~LONG)).bitwiseOR(size)

    given = F.col(line)
    other = reduce(Column.__or__, [given.contains(c) for c in BLANKS])
    spaced = F.when(other, F.translate(given, BLANKS, " " * len(BLANKS))).otherwise(given)
    # What a plain split leaves between two spaces is the only code of length 0.
    codes = F.array_distinct(F.transform(F.split(spaced, " "), code))
    return F.sort_array(F.array_remove(codes, code(F.lit(""))))


def line_sets(docs: DataFrame) -> DataFrame:
    """Per line: doc_id, line_no, two keys of its set, n, neighbours it is met by, two marks."""
    rows = _lines(docs).select("doc_id", "line_no", _codes().alias("codes")).withColumn(
        "n", F.size("codes"))
    n = F.col("n")

    def pair(x: Column, y: Column) -> Column:
        """The lengths in the high bits, 52 bits of a hash in the others."""
        size = x.bitwiseAND(F.lit(LONG)) + y.bitwiseAND(F.lit(LONG))
        return F.shiftleft(size, 52).bitwiseOR(F.shiftrightunsigned(F.xxhash64(x, y), 12))

    pairs = F.zip_with(F.slice("codes", 1, n - 1), F.slice("codes", 2, n - 1), pair)
    lost = 2 * F.floor(n / 5).cast("int") + F.when(n % 5 == 4, 1).otherwise(0)
    return rows.select(
        "doc_id", "line_no", *_keys(F.col("codes")), "n",
        # Sets of up to three words are similar to equal ones only.
        F.when(n > 3, F.slice(F.sort_array(pairs, asc=False), 1, lost + 1))
        .otherwise(F.array().cast("array<bigint>")).alias("pairs"),
        *_marks("codes", 2),
    )


def _marks(codes: str, count: int) -> list[Column]:
    """Parity marks of 64 bits each; a word stands in one of ``count``, a power of two."""
    def mark(of: int) -> Column:
        def bit(c: Column) -> Column:
            here = F.shiftright(c, 12).bitwiseAND(F.lit(count - 1)) == of
            at = F.shiftright(c, 6).bitwiseAND(F.lit(63)).cast("int")
            return F.call_function("shiftleft", here.cast("bigint"), at)
        return F.aggregate(codes, F.lit(0).cast("bigint"), lambda m, c: m.bitwiseXOR(bit(c)))

    return [mark(of).alias(f"mark{of}") for of in range(count)]


def _apart(a: list[Column], b: list[Column]) -> Column:
    """At most the number of words in which two sets with these marks differ."""
    return reduce(Column.__add__, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])


def _keys(codes: Column) -> list[Column]:
    """Two 64-bit hashes of a set; what leads seeds the rest, so neither follows from the other."""
    return [F.xxhash64(codes).alias("key"), F.xxhash64(F.lit(1), codes).alias("key2")]


def _bits(spots: DataFrame) -> DataFrame:
    """(word, bits) with a bit set for each ``spot``; at most as many rows as there are words."""
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.pmod("spot", F.lit(64)).cast("int"))
    return spots.groupBy(F.floor(F.col("spot") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _in_bits(rows: DataFrame, bits: DataFrame, spot: Column) -> DataFrame:
    rows = rows.withColumn("spot", spot).withColumn("word", F.floor(F.col("spot") / 64))
    hit = F.call_function(
        "shiftright", F.col("bits"), F.pmod("spot", F.lit(64)).cast("int")).bitwiseAND(F.lit(1))
    return rows.join(F.broadcast(bits), "word").where(hit == 1).drop("spot", "word", "bits")


def _possible(a: dict, b: dict) -> Column:
    """Length and parity filters of two sets."""
    low, high = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    marks = ([of[m] for m in MARKS] for of in (a, b))
    # Similarity of 4/5: 9 * apart <= both.
    return (5 * low >= 4 * high) & (9 * _apart(*marks) <= a["n"] + b["n"])


def _verified(docs: DataFrame, places: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``later`` classes of pairs (later, earlier) of places that are similar."""
    wanted = pairs.select(F.col("later").alias("place")).union(pairs.select("earlier")).distinct()
    wanted = kept(places.join(wanted, "place", "left_semi"), "line-places")
    spot = lambda *at: F.pmod(F.xxhash64(*at), F.lit(WANTED_BITS))
    of_docs, of_lines = (
        kept(_bits(wanted.select(spot(*at).alias("spot"))), "line-wanted")
        for at in (["doc_id"], ["doc_id", "line_no"]))
    near = _in_bits(docs, of_docs, spot("doc_id"))
    near = _in_bits(_lines(near), of_lines, spot("doc_id", "line_no"))
    codes = near.select("doc_id", "line_no", _codes().alias("codes"))
    sets = kept(
        codes.select("doc_id", "line_no", "codes", *_keys(F.col("codes")))
        .join(wanted, ["doc_id", "line_no", "key", "key2"]).dropDuplicates(["place"])
        .select("place", F.struct("doc_id", "line_no").alias("at"), "codes"), "line-words")
    # Longer marks first, so that few pairs carry whole sets through a shuffle.
    marks = kept(
        sets.select("place", "at", F.size("codes").alias("n"), *_marks("codes", WIDE)), "line-marks")
    wide = [f"mark{i}" for i in range(WIDE)]
    a, b = (marks.select(F.col("place").alias(role), *[
        F.col(c).alias(f"{c}_{role}") for c in ("at", "n", *wide)]) for role in ("later", "earlier"))
    apart = _apart(*([F.col(f"{c}_{role}") for c in wide] for role in ("later", "earlier")))
    close = kept(
        pairs.join(a, "later").join(b, "earlier").where(
            (F.col("at_later") > F.col("at_earlier"))
            & (9 * apart <= F.col("n_later") + F.col("n_earlier"))).select("later", "earlier"),
        "line-close")
    x = sets.select(F.col("place").alias("later"), F.col("codes").alias("x"))
    y = sets.select(F.col("place").alias("earlier"), F.col("codes").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    same = close.join(x, "later").join(y, "earlier").where(
        9 * common >= 4 * (F.size("x") + F.size("y")))
    return same.select(F.col("later").alias("place")).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, removed) of every line with a word."""
    docs = docs.select("doc_id", "text")
    lines = kept(line_sets(docs), "line-sets")
    # Sorted by ranges, so that the number of a row follows its order.
    places = kept(
        lines.groupBy("key", "key2").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
        .select("at.doc_id", "at.line_no", "key", "key2").orderBy("doc_id", "line_no")
        .withColumn("place", F.monotonically_increasing_id()), "line-heads")
    classes = kept(
        lines.where("n > 3").join(places, ["doc_id", "line_no", "key", "key2"])
        .select("place", "n", *MARKS, "pairs"), "line-classes")
    keys = kept(lines.select("doc_id", "line_no", "key", "key2"), "line-keys")
    release(lines)
    rows = classes.select(F.explode("pairs").alias("token"), "place", "n", *MARKS)

    def side(prefix: str) -> dict:
        return {c: F.col(f"{prefix}{c}") for c in ("place", "n", *MARKS)}

    own, lead = side(""), side("lead_")
    near = (own["place"] > lead["place"]) & _possible(own, lead)

    def shared_pairs(part: int) -> DataFrame:
        """Rows of the neighbours of a part that several classes hold; lead where it may be similar.

        ``more``: others than the lead hold it too. Rows that neither join reads are left out.
        """
        some = rows.where(F.pmod("token", F.lit(PARTS)) == part)
        leads = some.groupBy("token").agg(
            F.min("place").alias("lead_place"), F.min_by("n", "place").alias("lead_n"),
            *[F.min_by(m, "place").alias(f"lead_{m}") for m in MARKS], F.count("*").alias("size"))
        return some.join(leads.where("size > 1"), "token").select(
            "token", "place", "n", *MARKS, F.when(near, F.col("lead_place")).alias("lead"),
            (F.col("size") > 2).alias("more"),
        ).where(F.col("more") | F.col("lead").isNotNull())

    shared = [kept(shared_pairs(part), "line-shared") for part in range(PARTS)]
    led = kept(
        reduce(DataFrame.union, [t.select("place", "lead") for t in shared])
        .where(F.col("lead").isNotNull())
        .select(F.col("place").alias("later"), F.col("lead").alias("earlier")).distinct(),
        "line-led",
    )
    first = kept(led.groupBy("later").agg(F.min("earlier").alias("earlier")), "line-first")
    settled = kept(_verified(docs, places, first), "line-settled")
    a, b = side("a_"), side("b_")

    def other_pairs(words: DataFrame) -> DataFrame:
        words = words.where("more")
        left = words.join(settled, "place", "left_anti").select(
            "token", *[F.col(c).alias(f"a_{c}") for c in ("place", "n", *MARKS)])
        right = words.select("token", *[F.col(c).alias(f"b_{c}") for c in ("place", "n", *MARKS)])
        return (
            left.join(right, "token").where((a["place"] > b["place"]) & _possible(a, b))
            .select(a["place"].alias("later"), b["place"].alias("earlier")).distinct()
        )

    found = []
    for words in shared:
        found.append(kept(other_pairs(words), "line-pairs"))
        release(words)
    open_led = led.join(settled.withColumnRenamed("place", "later"), "later", "left_anti")
    second = kept(
        reduce(DataFrame.union, [open_led, *found]).distinct()
        .join(first, ["later", "earlier"], "left_anti"),
        "line-second",
    )
    release(*found)
    gone = kept(settled.union(_verified(docs, places, second)).distinct(), "line-gone")
    marked = places.select(
        "place", "key", "key2", F.struct("doc_id", "line_no").alias("at")).join(
        gone.withColumn("gone", F.lit(True)), "place", "left")
    here = F.struct("doc_id", "line_no")
    return keys.join(marked, ["key", "key2"]).select(
        "doc_id", "line_no",
        ((here > F.col("at")) | F.coalesce("gone", F.lit(False))).alias("removed"))


def line_report(docs: DataFrame) -> DataFrame:
    """Per doc_id: n_lines (with a word), n_removed, removed (line numbers from 0)."""
    found = removed_lines(docs).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("removed").cast("bigint")).alias("n_removed"),
        F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("line_no")))).alias("removed"))
    none = F.lit(0).cast("bigint")
    return docs.select("doc_id").distinct().join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("n_lines", none).alias("n_lines"),
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_lines(docs: DataFrame, report: DataFrame) -> DataFrame:
    """``docs`` with the removed lines of ``report`` taken out of ``text``; null stays null.

    The report names lines by doc_id, so rows of a doc_id that comes with different texts keep
    all of theirs: no line is taken out for what another text holds at its place.
    """
    key = F.sha2(text_of().cast("binary"), 256)
    several = docs.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where(
        "low <> high").select("doc_id")
    report = report.join(several, "doc_id", "left_anti")
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    cut = report.select(F.col("doc_id").alias("cut_id"), F.col("removed").alias("cut"))
    joined = row.join(cut, F.col("row.doc_id") == F.col("cut_id"), "left")
    lines = F.split("row.text", "\n", -1)
    left = F.filter(lines, lambda line, i: ~F.coalesce(
        F.array_contains("cut", i), F.lit(False)))
    return joined.select(*[
        F.array_join(left, "\n").alias(c) if c == "text" else F.col(f"row.{c}")
        for c in docs.columns])
