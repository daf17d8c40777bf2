from pyspark.sql import functions as F

from linkgrid.llm import lines

M = 2**64 - 1
P1, P2, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5


def _turn(x, by):
    return (x << by | x >> (64 - by)) & M


def test_second_key_tells_sets_apart_that_collide_in_the_first(spark):
    a, b, other = 11, 12, 13
    # xxhash64 of a long is one to one, so for any first value a second one collides.
    seeds = spark.range(1).select(
        F.xxhash64(F.lit(a).cast("long")), F.xxhash64(F.lit(other).cast("long"))).first()
    one, two = ((h + P5 + 8) & M for h in seeds)
    mixed = _turn(b * P2 & M, 31) * P1 & M ^ one ^ two
    last = _turn(mixed * pow(P1, -1, 2**64) & M, 33) * pow(P2, -1, 2**64) & M
    last -= (last >> 63) << 64
    rows = spark.createDataFrame([([a, b],), ([other, last],)], "codes array<long>")
    x, y = rows.select(*lines._keys(F.col("codes"))).collect()
    assert x.key == y.key
    assert x.key2 != y.key2


def test_rows_that_share_a_doc_id_lose_no_text(spark):
    rows = [(1, "alpha beta gamma", 1), (2, "alpha beta gamma", 2), (2, "unique words here", 3),
            (3, "alpha beta gamma\nown line", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    found = lines.without_lines(docs, lines.line_report(docs)).collect()
    assert {r.n: r.text for r in found} == {
        1: "alpha beta gamma", 2: "alpha beta gamma", 3: "unique words here", 4: "own line"}


def test_similar_sets_share_a_pair_of_neighbours_and_meet_in_it(spark):
    import random

    rng = random.Random(8)
    texts = []
    for n in [*range(4, 40), 75, 150, 301]:
        base = [f"w{rng.randrange(10**6)}" * rng.choice([1, 1, 9]) for _ in range(n)]
        for lost, more in ((n // 5, 0), (0, n // 4), (n // 9, n // 9)):
            kept = rng.sample(base, n - lost)
            texts += [" ".join(base), " ".join(kept + [f"x{rng.randrange(10**6)}" for _ in range(more)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = {r.doc_id: set(r.pairs) for r in lines.line_sets(docs).collect()}
    words = [set(t.split()) for t in texts]
    similar = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    met = [bool(pairs[d] & pairs[d + 1]) for d in range(0, len(texts), 2)
           if similar(words[d], words[d + 1]) and words[d] != words[d + 1]]
    assert all(met) and len(met) > 90


def test_long_lines_of_frequent_words_are_not_candidates(spark, monkeypatch):
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(1500)]
    docs = spark.createDataFrame(
        [(d, " ".join(rng.sample(words, 150))) for d in range(200)], "doc_id long, text string")
    found = {}
    write = lines.kept

    def kept(df, name):
        out = write(df, name)
        found[name] = found.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(lines, "kept", kept)
    assert not any(r.removed for r in lines.removed_lines(docs).collect())
    assert found["line-first"] + found["line-second"] < 50


def test_lines_of_rows_with_one_doc_id_are_verified_as_they_are(spark):
    base = "a b c d e f g h i j"
    rows = [(1, base), (2, base + " k"), (2, "q r s t u v w x y z"), (3, base + " l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.removed) for r in lines.removed_lines(docs).collect()]
    assert sorted(found) == [(1, False), (2, False), (2, True), (3, True)]
