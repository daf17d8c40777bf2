"""Exact dedup by distributed most-significant-digit radix partitioning.

Every round splits the groups that are left by their next bytes: rows are counted by (group,
digit) with map-side combine, and each row learns the new group by a join on the same key.
A group is finished when it holds one row, or when its texts ended inside the digit; then they
are identical byte for byte, so no digest is compared. Digits grow fourfold from round to
round, so a text of n bytes takes O(log n) rounds, and finished rows take no part in later ones.

Scale: only groups of two rows or more are joined back, as a distinct-key table written to the
shared folder; a hot group (copies in any number) is one row of it, and its many rows on the
other side can be split by adaptive skew handling since nothing above the join needs them
together. No group is ever collected. Rounds are written to the shared folder, so a lost
executor costs the tasks of one round.

Edge cases: null counts as an empty text, and all empty texts are equal; of rows that repeat
doc_id and text one stays; a null doc_id ranks below all others; an empty table gives an empty
table. Column names of the input are kept apart from those used here.

Where no doc_id repeats, rounds carry only texts whose group is not settled, and all their tables
are deleted before the rows that stay are looked up by doc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgrid.llm.common import kept, release, text_of, utf8


def exact_groups(docs: DataFrame, carry: list[str] | None = None, carry_text: bool = False,
                 first_digit: int = 256, growth: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, and what is carried.

    ``carry`` names further columns; they come back in one struct ``carried``. With
    ``carry_text`` that struct also has the text. Of equal texts the row with the largest
    doc_id is kept.
    """
    return _grouped(docs, carry, carry_text, first_digit, growth)[0]


def _grouped(docs: DataFrame, carry: list[str] | None = None, carry_text: bool = False,
             first_digit: int = 256, growth: int = 4) -> tuple[DataFrame, list[DataFrame]]:
    """What ``exact_groups`` returns, and the tables it reads."""
    carried = F.struct(
        F.col("text").isNull().alias("null_text"), *[F.col(c) for c in carry or []]
    )
    state = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.lit(0).cast("bigint").alias("bin"),
        utf8().alias("bytes"),
        carried.alias("carried"),
    )
    start, width, rounds, tables = 0, first_digit, [], []
    while True:
        split = state.withColumn("digit", F.substring("bytes", start + 1, width))
        heads = kept(
            split.groupBy("digit", "bin")
            .agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("size"))
            .where(F.col("size") > 1),
            "radix-heads",
        )
        found = split.join(heads.hint("shuffle_hash"), ["digit", "bin"], "left")
        size = F.coalesce("size", F.lit(1).cast("bigint"))
        done = (size == 1) | (F.length("digit") < width)
        left = F.col("bytes") if carry_text else F.when(~done, F.col("bytes"))
        state = kept(
            found.select(
                "doc_id",
                "row",
                F.coalesce("top.row", "row").alias("bin"),
                F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id"))
                .alias("keep_id"),
                size.alias("group_size"),
                done.alias("done"),
                left.alias("bytes"),
                "carried",
            ),
            "radix-round",
        )
        release(heads)
        tables.append(state)
        rounds.append(state.where("done"))
        state = state.where(~F.col("done"))
        if state.isEmpty():
            break
        state = state.select("doc_id", "row", "bin", "bytes", "carried")
        start, width = start + width, width * growth
    whole = reduce(DataFrame.unionByName, rounds)
    text = F.when(~F.col("carried.null_text"), F.col("bytes").cast("string"))
    out = [F.col(f"carried.{c}").alias(c) for c in carry or []]
    return whole.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("bin")).alias("kept"),
        F.struct(*out, *([text.alias("text")] if carry_text else [])).alias("carried")
        if out or carry_text else F.lit(None).alias("carried"),
    ), tables


def exact_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256 (of the text as it is)."""
    rows = docs.select("doc_id", "text", F.sha2(text_of(), 256).alias("text_sha256"))
    groups = exact_groups(rows, carry=["text_sha256"])
    return groups.select("doc_id", "keep_id", "group_size", "kept", "carried.text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each distinct text, all columns as they were."""
    repeated = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1)
    if repeated.isEmpty():
        groups, tables = _grouped(docs.select("doc_id", "text"))
        gone = kept(groups.where("NOT kept").select("doc_id"), "radix-gone")
        release(*tables)
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    packed = docs.select(
        "doc_id", "text",
        F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("others"),
    )
    groups = exact_groups(packed, carry=["others"], carry_text=True).where("kept")
    return groups.select(*[
        F.col("carried.text" if c == "text" else f"carried.others.{c}").alias(c)
        for c in docs.columns
    ])
