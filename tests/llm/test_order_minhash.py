"""Order MinHash fingerprints against a plain version, and their edge cases."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from linkgrid.llm import ordermin
from linkgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _hash(data: bytes, seed: int) -> int:
    return xxhash.xxh64(data, seed=seed).intdigest()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plain_print(text, k=3, least=2):
    """A fingerprint by counting, without sorting or packing; hashes as xxHash64 of Spark."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]

    def of_words(some):
        seed = 42
        for w in some:
            seed = _hash(w.encode(), seed)
        return seed

    grams = [of_words(words[i : i + k]) for i in range(len(words) - k + 1)]
    if words and len(words) < k:
        grams = [of_words(words)]
    seen, bins = {}, {}
    for at, gram in enumerate(grams):
        number = seen.setdefault(gram, 0)
        seen[gram] += 1
        x = _hash(number.to_bytes(4, "little"), _hash(gram.to_bytes(8, "little"), 42))
        bins.setdefault(_signed(x) >> 58, []).append((x >> 24 & (1 << 34) - 1, at))
    out = []
    for name, entries in sorted(bins.items()):
        seed = 42
        for _, mark in sorted((at, mark) for mark, at in sorted(entries)[:least]):
            seed = _hash(mark.to_bytes(8, "little"), seed)
        out.append(f"{name % 64:02x}{_signed(seed) % (1 << 24):06x}")
    return "".join(out)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    one, two = ({p[i : i + 8] for i in range(0, len(p), 8)} for p in (a, b))
    return len(one & two) / len({x[:2] for x in one | two}) if one and two else 0.0


def plain_report(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0),
                                       hashlib.sha256((r[1] or "").encode()).hexdigest()))
    texts, out = [r[1] or "" for r in rows], []
    for i, (doc, _) in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(plain_print, (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b,
                    plain_likeness(a, b), plain_likeness(a, c)))
    return out


def by_key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_matches_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert by_key(QUERIES["op11_order_minhash"](spark, SF).collect()) == by_key(plain_report(docs))


WORDS = " ".join(f"w{i % 97}" for i in range(40_000))
ROWS = [(5, "a b c d"), (5, "a b c d"), (5, "other text with five words"), (4, None), (3, ""),
        (None, "no id here at all"), (None, None), (2000, "one"), (10**15, " \n\t "),
        (-7, "\U0001f600 été 日本 \U0001f600 été 日本 \U0001f600 été"), (1, WORDS),
        (1 << 61, "x" * 50_000), (6, "a a a a a a a a"), (-(1 << 61), "c d a b")]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["slice", "part", "_words", "_grams", "fingerprint", "edited", "next_text", "n_chars"]
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in extra})


@pytest.mark.parametrize("bits", [0, 2, 9])
def test_edge_cases_in_slices_of_any_size(docs, bits):
    got = ordermin.fingerprint_report(docs, ordermin.Print(slice_bits=bits)).collect()
    # Rows of one doc_id and of no doc_id are ordered by their digests, as here.
    assert by_key(got) == by_key(plain_report(ROWS))


def test_one_document_and_none(docs):
    only = ordermin.fingerprint_report(docs.where("doc_id = 6")).collect()
    assert by_key(only) == by_key(plain_report([ROWS[12]]))
    assert only[0].near_next == 1.0
    assert ordermin.fingerprint_report(docs.where("false")).collect() == []


def test_order_counts(spark):
    """The same sentences in another order are less alike than to themselves with one edit."""
    parts = [" ".join(f"p{i}w{j}" for j in range(40)) for i in range(20)]
    text, moved = " ".join(parts), " ".join(reversed(parts))
    edited = text.replace("p3w7", "other")
    rows = spark.createDataFrame([(text, moved, edited)], "a string, b string, c string")
    for name in "abc":
        rows = ordermin.with_fingerprint(rows, name, f"{name}_print")
    found = rows.select(ordermin.likeness("a_print", "b_print").alias("moved"),
                        ordermin.likeness("a_print", "c_print").alias("edited")).first()
    assert found.edited > 0.9 > 0.8 > found.moved


def test_no_python_in_the_plan(spark):
    frame = QUERIES["op11_order_minhash"](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
