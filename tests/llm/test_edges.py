"""Every operator and stage on nulls, empty and long texts, repeats, clashes, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkgrid.llm import (
    language,
    lines,
    mixing,
    ngram_join,
    pieces,
    quality,
    radix,
    repetition,
    secrets,
    segmentation,
    tokencount,
)
from linkgrid.llm.queries import PIECES, QUERIES, TARGETS, domain_of

LONG = ("lorem ipsum dolor sit amet " * 12_000) + "x" * 30_000 + " deadbeefdeadbeef"
ROWS = [
    (1, "a b c d e f g\na b c d e f g", "en", "src1"),
    (2, "a b c d e f g\na b c d e f g", "en", "src1"),
    (2, "a b c d e f g\na b c d e f g", "en", "src1"),
    (3, None, None, None),
    (None, "text without an id", "de", "src2"),
    (None, None, None, None),
    (4, "", "en", "src0"),
    (5, " \n\t ", "en", "src0"),
    (6, LONG, "fr", "src9"),
    (7, "été à l'école 日本 \U0001f600 password=abcdefghijkl1", None, "src0"),
    (8, "1 2 3 ! ?", "en", None),
]
CLASHING = ["row", "digit", "bin", "bytes", "carried", "key", "n", "u", "v", "id", "rules", "tokens",
            "encoded", "language", "quality_score", "quality", "copies", "copy", "domain", "border",
            "component_id", "sig", "at", "removed", "cut", "x", "y", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return rows.withColumns({c: F.lit(c) for c in CLASHING}).withColumn("null", F.lit(None).cast("int"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1), (2, 0), (2, None), (3, 0), (None, 1), (6, 1), (99, 0)], "doc_id long, quality int")


REPORTS = {
    "mixing": lambda d, _: mixing.mix_report(d, TARGETS, domain_of()),
    "ngram": lambda d, _: ngram_join.link_components(d),
    "tokens": lambda d, _: tokencount.token_counts(d, pieces.load(PIECES)),
    "pieces": lambda d, _: segmentation.encoded_documents(d, pieces.load(PIECES)),
    "secrets": lambda d, _: secrets.secret_report(d),
    "quality": lambda d, m: quality.quality_report(d, m),
    "radix": lambda d, _: radix.exact_report(d),
    "lines": lambda d, _: lines.line_report(d),
    "language": lambda d, _: language.language_report(d),
    "repetition": lambda d, _: repetition.repetition_report(d),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports(docs, labels, name):
    rows = REPORTS[name](docs, labels).collect()
    assert len(rows) == (len({r[0] for r in ROWS}) if name == "lines" else len(ROWS))
    by_id = {r["doc_id"]: r for r in rows}
    if name == "tokens":
        assert by_id[3].n_tokens == by_id[4].n_tokens == 0 and by_id[6].n_tokens > 60_000
    if name == "pieces":
        assert by_id[7].restored and by_id[6].restored and by_id[4].ids == []
        assert sum(len(r.alternatives) == 2 for r in rows) >= 5
    if name == "ngram":
        assert by_id[1].component_id == by_id[2].component_id == 1
        assert by_id[3].n_shingles == by_id[5].n_shingles == 0 and by_id[None].component_id is None
    if name == "radix":
        assert sum(r.kept for r in rows) == len({r[1] or "" for r in ROWS})
    if name == "secrets":
        assert by_id[6].n_hex == 1 and by_id[7].n_assign == 1 and by_id[3].spans == ""
    if name == "quality":
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "lines":
        assert by_id[1].removed == [1] and by_id[2].removed == [0, 1]


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_of_empty_tables(docs, labels, name):
    none = docs.where("false")
    assert REPORTS[name](none, labels.where("false")).collect() == []


@pytest.mark.parametrize("position", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, labels, position, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stage"))
    labels.write.parquet(f"{folder}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[position]
    out = stage(spark, docs, folder)
    rows = out.collect()
    if position < 4:
        assert out.columns == docs.columns
        given = {(r[0], r[1]) for r in ROWS}
        assert {(r["doc_id"], r["text"]) for r in rows} <= given
    if name == "exact_dedup":
        assert len(rows) == len({r[1] or "" for r in ROWS})
    assert stage(spark, docs.where("false"), folder).collect() == []


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op6_quality_classifier"](spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 40
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_calibration_is_monotone():
    import numpy as np

    rng = np.random.default_rng(1)
    raw = np.sort(rng.normal(size=200))
    knots, levels = quality._pooled(raw, np.full(200, 3), rng.binomial(3, 1 / (1 + np.exp(-raw))))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all()
    flat = quality._pooled(np.array([0.0, 1.0]), np.array([1, 1]), np.array([1, 0]))
    assert flat[1].tolist() == [0.5]


def test_pipeline_stage_by_stage(spark):
    """Each stage of run() against a plain version of it, on its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        from linkgrid.llm.common import kept

        steps.append(kept(stage(spark, steps[-1], sf), "test-stage"))
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = quality.quality_report(docs, labels).where("predicted = 1").select("doc_id").collect()
    assert set(rows[1]) == {r.doc_id for r in scores}
    largest = {}
    for doc, r in rows[1].items():
        largest[r.text] = max(doc, largest.get(r.text, doc))
    assert set(rows[2]) == set(largest.values())
    from test_set_operators import brute_links

    links = brute_links([(d, r.text) for d, r in rows[2].items()])
    assert set(rows[3]) == {d for d, (_, c) in links.items() if d == c}
    report = mixing.mix_report(steps[3], corpus_pipeline.MIX, domain_of())
    assert set(rows[4]) == {r.doc_id for r in report.where("copies = 1").collect()}
    words = {d: len(r.text.split()) for d, r in rows[3].items()}
    assert sum(words[d] for d in rows[4]) >= 0.78 * sum(words.values())
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(rows[4])
    tool = segmentation.Segmenter(pieces.load(PIECES))
    assert all(tool.decode(r.ids) == rows[4][r.doc_id].text for r in out)
