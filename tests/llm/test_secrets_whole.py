"""Secrets among very many harmless runs."""

import random

from pyspark.sql import functions as F

from linkgrid.llm import secrets


def _keys(length, number, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(secrets.BASE64_DIGITS, k=length)) for _ in range(number)]


def _found(spark, keys, harmless):
    """n_random of one document per key, next to documents with ``harmless`` as their text."""
    own = [(-1 - i, f"see {key} here") for i, key in enumerate(keys)]
    docs = spark.createDataFrame(own + harmless, "doc_id long, text string")
    rows = secrets.secret_report(docs).where("doc_id < 0").collect()
    return {r.doc_id: r.n_random for r in rows}


def test_few_keys_among_copies_of_one_run(spark):
    keys = _keys(24, 4, 5)
    alone = _found(spark, keys, [])
    assert sum(alone.values()) >= 3
    copies = [(i, " ".join(["-" * 24] * 100)) for i in range(40)]
    assert _found(spark, keys, copies) == alone


def test_one_key_among_two_million_distinct_runs(spark):
    settings = secrets.Battery()
    span = F.struct(F.lit(0).alias("start"), F.lit(3).alias("kind"), F.lit(64).alias("end"))
    token = F.lit(_keys(64, 1, 6)[0])
    key = spark.range(1).select(
        secrets._tested(span, secrets.battery(token), settings).alias("t")).select("t.*")
    counts = key.select("band", "bin", F.lit(1).alias("count")).union(
        key.selectExpr("band", "0", "2000000"))
    row = key.first()
    assert row.random
    assert secrets.thresholds(counts, settings) == {row.band: row.bin}


def test_runs_of_padding_and_dashes(spark):
    runs = ["=" * 20, "=" * 300, "a" + "=" * 19, "-" * 20, "_" * 40, "-" * 19 + "=", "ab" + "=" * 20]
    tokens = spark.createDataFrame([(t,) for t in runs], "token string")
    tests = tokens.select(secrets.battery(F.col("token")).alias("t")).select("t.*").collect()
    assert [r.n for r in tests] == [0, 0, 1, 20, 40, 19, 2]
    assert all(r.z_chi == 99 and r.p_words == 1 for r in tests[:3])
    assert all(r.z_serial == 99 for r in tests[:6])
    docs = [(i, f"Title\n{t}\n") for i, t in enumerate(runs)]
    out = secrets.secret_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_random, r.spans) for r in out) == [
        (i, 0, "") for i in range(len(runs))]
