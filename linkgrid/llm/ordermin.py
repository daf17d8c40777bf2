"""Document fingerprints by Order MinHash; DataFrame operations only.

The symbols of a text are its words. Each of its k-mers (k words in a row) is numbered by how
often it occurred before, so that repeats count. A digest of k-mer and number deals them into
64 disjoint bins and orders each bin at random; the ``least`` smallest of a bin are taken,
put back into their order in the text, and hashed as a tuple. Two fingerprints agree in a bin
only if the texts share the same smallest k-mers there in the same order, so, unlike with plain
MinHash, moving passages about lowers the likeness just as edits do. Bins in place of
independent permutations let one sort serve all parts of a fingerprint.

A fingerprint is a string with eight characters for each bin that is not empty, in order: two
name the bin, six are the hash. Likeness is the number of equal bins over the number of bins
that are not empty on both or either side (1 if there is none).

Scale: everything of one text happens in its row; no k-mer is shuffled. Occurrence numbers come
from one sort per text and run lengths, in n log n. For the next document, texts are grouped by
``doc_id`` in slices of at most 2^``slice_bits`` consecutive ids, one exchange; the last of each
slice meets the head of the slice before it, of which there is one per slice. No slice can be
hot unless one doc_id comes very often. The order of slices is found on slice numbers alone,
by ranges.

Edge cases: null text is empty, its fingerprint is empty; with fewer than k words the whole
sequence is the one k-mer; the document after the least doc_id is the one with the largest; one
document alone is next to itself; null doc_ids come last, in one slice; rows with the same
doc_id are ordered by the SHA-256 of their text; an empty table gives an empty table. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgrid.llm.common import kept, text_of

BREAK = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Print:
    k: int = 3
    least: int = 2
    slice_bits: int = 9


#: A packed long: six bits of bin and 34 of hash, or of k-mer, above the place in the text.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
HASH_BITS = 34
HASH = (1 << HASH_BITS) - 1
BIN_SHIFT = PLACE_BITS + HASH_BITS


def _packed(hash_: Column, place: Column) -> Column:
    place = F.least(place, F.lit(PLACE)).cast("bigint")
    return hash_.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(PLACE)).cast("int")


def _bin(packed: Column) -> Column:
    return F.shiftright(packed, BIN_SHIFT)


def _indexes(array: str, wanted) -> Column:
    """The indexes of ``array`` for which ``wanted(element, element before)`` holds, and 0."""
    at = F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.filter(at, lambda i: (i == 0) | wanted(
        F.get(F.col(array), i), F.get(F.col(array), i - 1)))


def with_fingerprint(df: DataFrame, text: str, name: str, settings: Print = Print()) -> DataFrame:
    """``df`` with the fingerprint of the string column ``text`` as the column ``name``."""
    k, first, own = settings.k, settings.least, df.columns
    # One projection for each array that the next one reads more than once.
    step = df.select(*own, F.filter(F.split(text, BREAK), lambda w: w != "").alias("_words"))
    n = F.size("_words")
    grams = F.transform(
        F.slice("_words", F.lit(1), F.greatest(n - (k - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(F.col("_words"), i + j) for j in range(1, k)]))
    step = step.select(*own, F.when(n >= k, grams).when(
        n > 0, F.array(F.xxhash64("_words"))).otherwise(
            F.array().cast("array<bigint>")).alias("_grams"))
    # Equal k-mers side by side, in the order of the text; where each run of them starts.
    step = step.select(*own, "_grams", F.sort_array(
        F.transform("_grams", lambda g, i: _packed(g, i))).alias("_sorted"))
    step = step.select(*own, "_grams", "_sorted", _indexes("_sorted", lambda x, y: F.shiftright(
        x, PLACE_BITS) != F.shiftright(y, PLACE_BITS)).alias("_starts"))

    def run(start: Column, i: Column) -> Column:
        length = F.coalesce(F.get(F.col("_starts"), i + 1), F.size("_sorted")) - start
        return F.when(length == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), length - 1))

    unique = F.size("_starts") == F.size("_sorted")
    step = step.select(*own, "_grams", "_sorted", F.when(~unique, F.flatten(
        F.transform("_starts", run))).alias("_numbers"))

    def ranked(x: Column, number: Column) -> Column:
        return _packed(F.xxhash64(F.get(F.col("_grams"), _place(x)), number), _place(x))

    step = step.select(*own, F.sort_array(F.when(
        F.col("_numbers").isNull(), F.transform("_sorted", lambda x: ranked(x, F.lit(0)))
    ).otherwise(F.zip_with("_sorted", "_numbers", ranked))).alias("_ranked"))
    # The smallest of each bin: no entry of the same bin stands ``least`` places before.
    taken = F.filter("_ranked", lambda x, i: (i < first) | (
        _bin(F.get(F.col("_ranked"), i - first)) != _bin(x)))
    step = step.select(*own, F.sort_array(F.transform(taken, lambda x: F.shiftleft(
        _bin(x), BIN_SHIFT).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(PLACE)), HASH_BITS))
        .bitwiseOR(F.shiftright(x, PLACE_BITS).bitwiseAND(F.lit(HASH))))).alias("_taken"))
    step = step.select(*own, "_taken", _indexes(
        "_taken", lambda x, y: _bin(x) != _bin(y)).alias("_heads"))

    def part(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col("_heads"), i + 1), F.size("_taken"))
        hashes = F.transform(F.slice(F.col("_taken"), start + 1, end - start),
                             lambda x: x.bitwiseAND(F.lit(HASH)))
        bin_ = F.pmod(_bin(F.get(F.col("_taken"), start)), F.lit(64))
        mark = F.pmod(F.xxhash64(hashes), F.lit(1 << 24))
        return F.lower(F.concat(F.lpad(F.hex(bin_), 2, "0"), F.lpad(F.hex(mark), 6, "0")))

    return step.select(*own, F.array_join(F.transform("_heads", part), "").alias(name))


def likeness(a: str, b: str) -> Column:
    """Share of the bins filled on either side that are equal."""

    def parts(column: str, width: int) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.length(column), F.lit(8)),
            lambda i: F.substring(F.col(column), i, F.lit(width)))

    equal = F.size(F.array_intersect(parts(a, 8), parts(b, 8)))
    filled = F.size(F.array_union(parts(a, 2), parts(b, 2)))
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return (
        F.when(F.col(a) == F.col(b), 1.0).when(empty, 0.0).otherwise(equal / filled))


def _slices(rows: DataFrame) -> DataFrame:
    """(slice, before): each slice and the one that comes before it, in a ring."""
    parts = kept(
        rows.select("slice").distinct().repartitionByRange(F.desc("slice"))
        .withColumn("part", F.spark_partition_id()), "print-slices")
    # A row per partition: the head of the next one follows its least slice.
    ends = parts.groupBy("part").agg(F.min("slice").alias("least"))
    ends = kept(ends.select("part", "least", F.lag("least").over(Window.orderBy("part")).alias(
        "follows")), "print-ends")
    least = ends.agg(F.min("least")).first()[0]
    own = Window.partitionBy("part").orderBy(F.desc("slice"))
    return parts.join(ends.select("part", "follows"), "part").select("slice", F.coalesce(
        F.lag("slice").over(own), "follows", F.lit(least).cast("bigint")).alias("before"))


def _edit(rows: DataFrame, settings: Print) -> DataFrame:
    """``rows`` with text and next_text: the end of the text gives way to the start of the next."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = rows.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    edited = edited.withColumn("n_chars", n.cast("bigint")).drop("next_text")
    done = with_fingerprint(edited, "edited", "edited_fingerprint", settings)
    return done.withColumn(
        "edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")


def fingerprint_report(docs: DataFrame, settings: Print = Print()) -> DataFrame:
    """Per document, against the next one and against a text whose end is the next one's start.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Documents follow each other by falling doc_id, the first one after the last.
    """
    doc_id = F.col("doc_id").cast("bigint")
    last = F.lit(-(1 << 62)).cast("bigint")
    rows = docs.select(
        doc_id.alias("doc_id"), text_of().alias("text"),
        F.coalesce(F.shiftright(doc_id, settings.slice_bits), last).alias("slice"))
    printed = with_fingerprint(rows, "text", "fingerprint", settings)
    order = Window.partitionBy("slice").orderBy(
        F.desc_nulls_last("doc_id"), F.sha2(F.col("text").cast("binary"), 256))
    placed = printed.select(
        "*", F.lead("text").over(order).alias("next_text"),
        F.lead("fingerprint").over(order).alias("next_fingerprint"),
        F.lag(F.lit(True)).over(order).isNull().alias("is_head"))
    done = _edit(placed, settings)
    # Texts are kept of the ends of slices only.
    is_tail = F.col("next_fingerprint").isNull()
    done = kept(done.withColumn("text", F.when(F.col("is_head") | is_tail, F.col("text"))),
                "print-placed")
    heads = done.where("is_head").select(
        "slice", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")
    ).join(_slices(done), "slice").select(
        F.col("before").alias("slice"), "next_text", "next_fingerprint")
    tails = done.where(is_tail).select("doc_id", "slice", "text", "fingerprint").join(heads, "slice")
    own = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    both = [*own, "next_fingerprint"]
    whole = done.where(~is_tail).select(both).unionByName(_edit(tails, settings).select(both))
    return whole.select(
        *own, likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"))
