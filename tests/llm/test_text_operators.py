"""Token counts, segmentation, repetition and languages against other implementations."""

import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer, decoders, models, normalizers

from linkgrid.llm import language, pieces, repetition, segmentation, tokencount
from linkgrid.llm.queries import PIECES

WORDS = ["the", "of", "naïve", "Straße", "12.5", "x" * 70, "a,b", "日本", "\U0001f600", "tokenize"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PIECES)


def texts(seed, count=150):
    rng = random.Random(seed)
    out = ["", " ", "  a", "a  ", "\n", "a\n\nb", "▁x ▁", "\t a\x00b", " a   b "]
    for _ in range(count):
        gaps = rng.choices([" ", "  ", "\n", " \n ", "\t"], [8, 1, 1, 1, 1], k=30)
        words = ["".join(rng.choices("abcdefghinorst", k=rng.randint(1, 9))) for _ in range(20)]
        words += rng.sample(WORDS, 5)
        rng.shuffle(words)
        out.append("".join(w + g for w, g in zip(words, gaps)))
    return out


@pytest.fixture(scope="module")
def unigram(vocabulary):
    """The vocabulary as a unigram tokenizer of an independent library."""
    items = dict(zip(vocabulary.pieces, vocabulary.scores))
    listed = [("<unk>", 0.0)] + [(p, s) for p, s in items.items()]
    listed += [(f"<0x{b:02X}>", -2e9) for b in range(256)]
    tool = Tokenizer(models.Unigram(listed, unk_id=0, byte_fallback=True))
    tool.normalizer = normalizers.Sequence(
        [normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    tool.decoder = decoders.ByteFallback()
    return tool


def plain_best(text, vocabulary):
    """Viterbi as plainly as possible: score, and pieces with earliest-start ties."""
    text = "▁" + text.replace(" ", "▁") if text else ""
    scores = dict(zip(vocabulary.pieces, vocabulary.scores))
    best, came = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            piece = text[start:end]
            if piece in scores:
                value = best[start] + scores[piece]
            elif len(piece) == 1:
                value = best[start] + vocabulary.unknown_score
            else:
                continue
            if value > best[end]:
                best[end], came[end] = value, start
    out, end = [], len(text)
    while end:
        out.append(text[came[end] : end])
        end = came[end]
    return best[len(text)], out[::-1]


def expanded(parts, vocabulary):
    known = dict(zip(vocabulary.pieces, vocabulary.ids))
    out = []
    for part in parts:
        out += [known[part]] if part in known else [vocabulary.byte_ids[b] for b in part.encode()]
    return out


def test_counts_and_ids_match_plain_viterbi(vocabulary):
    counter = tokencount.CountViterbi(vocabulary)
    tool = segmentation.Segmenter(vocabulary, 2)
    for text in texts(1):
        score, parts = plain_best(text, vocabulary)
        want = expanded(parts, vocabulary)
        assert counter.count(text) == (len(want), score)
        ids, got, _ = tool.encode(text)
        assert ids.tolist() == want and got == score


def test_counts_match_an_independent_unigram_tokenizer(vocabulary, unigram):
    counter = tokencount.CountViterbi(vocabulary)
    for text in texts(2):
        if not text or any(c not in " abcdefghijklmnopqrstuvwxyz" for c in text):
            continue
        assert counter.count(text)[0] == len(unigram.encode(text, add_special_tokens=False).ids)


def test_segments_score_as_sentencepiece_in_unigram_mode(vocabulary):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    other = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    tool = segmentation.Segmenter(vocabulary, 4)
    scores = {i: s for i, s in zip(vocabulary.ids, vocabulary.scores)}
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choices("abcdeinorst", k=rng.randint(2, 8)))
        ids, score, others = tool.encode(text)
        assert score == sum(scores[i] for i in other.encode(text))
        want = [sum(scores[i] for i in row) for row in other.nbest_encode_as_ids(text, 4)]
        assert [score, *[o["score"] for o in others]] == pytest.approx(want)
        for o in others:
            changed = segmentation.apply_changes(ids.tolist(), o["changes"])
            assert len(changed) == o["n_pieces"] and changed != ids.tolist()
            assert sum(scores[i] for i in changed) == o["score"]
            assert tool.decode(changed) == text


def all_paths(text, vocabulary):
    text = "▁" + text.replace(" ", "▁")
    scores = dict(zip(vocabulary.pieces, vocabulary.scores))
    rows = [[(0.0, ())]]
    for end in range(1, len(text) + 1):
        rows.append([
            (s + scores[text[start:end]], (*p, text[start:end]))
            for start in range(end) if text[start:end] in scores for s, p in rows[start]
        ])
    return sorted((-s for s, _ in rows[-1]))


def test_n_best_of_several_words_is_exact(vocabulary):
    tool = segmentation.Segmenter(vocabulary, 5)
    for text in ["ab an ab", "the in the", "on a on", "to be", "ere an"]:
        want = [-s for s in all_paths(text, vocabulary)[:5]]
        ids, score, others = tool.encode(text)
        assert [score, *[o["score"] for o in others]] == want
        seen = {tuple(ids.tolist())}
        seen |= {tuple(segmentation.apply_changes(ids.tolist(), o["changes"])) for o in others}
        assert len(seen) == 5


def test_round_trip(vocabulary):
    tool = segmentation.Segmenter(vocabulary)
    for text in texts(4):
        assert tool.decode(tool.encode(text)[0].tolist()) == text.replace("▁", " ")


def test_memo_keeps_two_generations():
    memo = pieces.Memo(lambda s: (s,), size=3, longest=4)
    for s in ["a", "b", "c", "d", "longer", "a"]:
        assert memo.find(s) == (s,)
    assert len(memo.young) + len(memo.old) <= 6 and "longer" not in memo.young
    assert memo.find_all({"x", "y", "a"}) == {"x": ("x",), "y": ("y",), "a": ("a",)}


def plain_rules(text):
    words = [w for w in text.encode().split()]
    words = [w.decode() for w in words]
    lines = [x for x in text.split("\n") if x.encode().split()]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(triples)
    inside = {i + k for i, t in enumerate(triples) if times[t] > 1 for k in range(3)}
    return [
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(inside),
    ]


def test_repetition_counts():
    rng = random.Random(5)
    cases = texts(6, 60) + [" ".join(rng.choices(["a", "bé", "c#"], k=200)) for _ in range(40)]
    cases += ["same line\nsame line\n\n \nsame line", " x y \x1c z", "a\r\nb\r\na"]
    for text in cases:
        assert repetition.measure(text.encode())[:5] == plain_rules(text), text


def test_repetition_shares():
    sentence = "one two three four five six seven eight nine ten eleven"
    row = dict(zip(repetition.BASE + repetition.RATIOS, repetition.measure(
        f"{sentence} x {sentence}".encode())))
    chars = len(sentence.replace(" ", ""))
    for n in range(5, 11):
        assert row[f"dup_{n}"] == pytest.approx(chars / (2 * chars + 1))
    pairs = [len(a + b) for a, b in zip(sentence.split(), sentence.split()[1:])]
    assert row["top_2"] == pytest.approx(2 * max(pairs) / (2 * chars + 1))


def test_repetition_verdict(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    looped = " ".join(["spam ham eggs"] * 40)
    rows = [(1, clean), (2, looped), (3, "short"), (4, None), (5, clean + "\n" + clean)]
    out = {r.doc_id: r for r in repetition.repetition_report(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].kept for i in range(1, 6)] == [True, False, False, False, False]
    assert out[4].n_words == 0 and out[4].base_failed


def test_codewords_are_distinct_and_no_bit_is_constant():
    for n in (2, 3, 4, 5, 9, 40):
        codes = language.codewords(n, 1)
        assert len(np.unique(codes, axis=0)) == n
        assert (np.abs(codes.sum(axis=0)) < n).all()
    assert language.codewords(4, 1).shape[1] == 7


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.language_report(docs).where("held_out").join(docs, "doc_id")
    rows = out.select("lang_pred", "lang").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98


def test_language_edge_cases(spark):
    rows = [(1, "abc abd", "x"), (2, "xyz xyw", "y"), (3, None, "x"), (4, "12 !", None),
            (5, "", "y"), (6, "日本語", None), (7, "abd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, language.Settings(folds=1))
    assert model.languages == ("x", "y")
    said = {r.doc_id: r.language for r in language.with_language(docs, model).collect()}
    assert [said[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3
    assert said[7].lang_pred == "x" and said[6].lang_pred in ("x", "y")
    assert all(0 <= s.score <= 1 for s in said.values())
    none = language.train(docs.where("false"))
    assert {r.language.lang_pred for r in language.with_language(docs, none).collect()} == {"und"}
    one = language.train(docs.where("lang = 'x'"), language.Settings(folds=1))
    assert language.predict(b"abc", one)[:2] == ("x", 1.0)
