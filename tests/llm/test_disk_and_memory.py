"""What a query leaves on disk while it runs, and what an idle Python worker keeps."""

import gc
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from linkgrid.llm import components, lines, ngram_join, radix, segmentation
from linkgrid.llm.common import release
from linkgrid.llm.pieces import Memo, load
from linkgrid.llm.queries import PIECES


def test_line_tables_are_deleted_once_read(spark, monkeypatch):
    texts = [" ".join(f"w{(d * 7 + i) % 23}" for i in range(12)) + f" own{d % 40}" for d in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made, gone = [], []
    write, drop = lines.kept, lines.release
    monkeypatch.setattr(lines, "kept", lambda df, name: made.append(name) or write(df, name))
    monkeypatch.setattr(
        lines, "release", lambda *t: gone.extend(x.kept_at.split("/")[-1] for x in t) or drop(*t))
    rows = {r["doc_id"]: r["removed"] for r in lines.removed_lines(docs).collect()}
    words = [set(t.split()) for t in texts]
    similar = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    assert rows == {d: any(similar(words[d], words[e]) for e in range(d)) for d in range(120)}
    assert made.count("line-shared") == lines.PARTS > 1
    for name in ("line-sets", "line-shared", "line-pairs"):
        assert sum(g.startswith(name) for g in gone) == made.count(name)


def test_a_full_memo_takes_little(spark):
    numbers = iter(range(10**9))
    result = lambda key: ((next(numbers), next(numbers), next(numbers)), 1.5 * len(key), 0.1, True)
    tracemalloc.start()
    memo = Memo(result, size=segmentation.SEGMENTS_KEPT)
    for i in range(300_000):
        memo.find(f"segment{i}")
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 50e6


def test_encoding_seldom_looks_for_cycles():
    tool = segmentation.Segmenter(load(PIECES), 3)
    before = gc.get_threshold()
    looks = lambda: sum(g["collections"] for g in gc.get_stats())
    with segmentation.rare_collection():
        began = looks()
        rows = [tool.encode(" ".join(f"w{i * 300 + j}en" for j in range(300))) for i in range(40)]
        assert looks() - began <= 3
    assert len(rows) == 40 and gc.get_threshold() == before


def tables(monkeypatch, module):
    made, write = [], module.kept
    monkeypatch.setattr(module, "kept", lambda df, name, *a: made.append(name) or write(df, name, *a))
    return made


@pytest.mark.parametrize("chunk", [1 << 17, 60])
def test_few_links_need_no_rounds(spark, monkeypatch, chunk):
    made = tables(monkeypatch, components)
    monkeypatch.setattr(components, "CHUNK", chunk)
    links = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 90)] + [(5, 5)]
    got = components.components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(90)}
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert (len(made) == 2) == (chunk > 1000)


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG_BLOCK", 8)
    monkeypatch.setattr(ngram_join, "CELL", 2)
    rng = random.Random(3)
    longs = ngram_join.MARK_LONGS
    known = {}
    for id_ in range(120):
        marks = [rng.choice([-1, 0, 1, 1 << 62, -(1 << 63)]) for _ in range(longs)] if id_ % 3 else [-1] * longs
        known[id_] = (rng.choice([40, 45, 90]), id_ % 50, rng.choice([0, 0, 8, 20]), marks)
    placed = [(sig, id_, known[id_][1], known[id_][0]) for sig in range(4) for id_ in range(120)
              if (id_ + sig) % 4]
    probed = [(sig, id_) for sig, id_, *_ in placed if rng.random() < 0.6]
    columns = ", ".join(f"m{i} bigint" for i in range(longs))
    got = ngram_join._open_pairs(
        spark.createDataFrame(placed, "sig bigint, id bigint, component bigint, n bigint"),
        spark.createDataFrame(probed, "sig bigint, id bigint"),
        spark.createDataFrame(
            [(i, own, *marks) for i, (_, _, own, marks) in known.items()], f"id bigint, own bigint, {columns}")
    ).collect()
    want = set()
    for sig, u in probed:
        for v in (id_ for s, id_, *_ in placed if s == sig):
            (n, of, own, x), (m, to, more, y) = known[u], known[v]
            apart = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(x, y))
            if of != to and 4 * min(n, m) >= 3 * max(n, m) and 7 * (own + more) <= n + m and 7 * apart <= n + m:
                want.add((min(u, v), max(u, v)))
    assert len(got) == len(set(got)) and {(r.u, r.v) for r in got} == want and len(want) > 50


def test_signatures_travel_in_parts():
    """Together the parts send what one pass would; wide segments of two parts are told apart."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for n in (1, 4, 15, 16, 21, 64, 85, 700, 5000)]

    def segments(sig, code, owner):
        found = {}
        for s, c, i in zip(sig.tolist(), code.tolist(), owner.tolist()):
            found.setdefault((i, c // 2) if c > 1 else (i, c, s), set()).add((s, c % 2))
        return sorted(sorted(x) for x in found.values())

    whole = ngram_join.signatures_of(sets)
    for parts in (2, 3):
        made = [ngram_join.signatures_of(sets, part, parts) for part in range(parts)]
        sig, code, owner = (np.concatenate(x) for x in zip(*made))
        assert sorted(zip(owner.tolist(), sig.tolist())) == sorted(
            zip(whole[2].tolist(), whole[0].tolist()))
        assert max(len(m[0]) for m in made) < 0.7 * len(sig)
        assert segments(sig, code, owner) == segments(*whole)


def test_signatures_of_a_large_table_take_few_bytes():
    """A set's digest must not travel with each of its signatures, nor all signatures at once."""
    texts = [" ".join(f"d{d}w{i}" for i in range(360)) for d in range(400)]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(400)), "data": pa.array([t.encode() for t in texts], pa.binary())})
    parts = getattr(ngram_join, "PASSES", 1)
    ranges = 12 * (864 << 20) // ngram_join.RANGE_BYTES  # those of 6 GB
    sent = max(
        sum(len(zlib.compress(row[n], 1))
            for out in ngram_join._emit(ranges, *([part, parts] if parts > 1 else []))([batch])
            for row in out.to_pylist() if row["kind"] == "sets" for n in "abcd")
        for part in range(parts))
    assert sent < 5 * sum(len(ngram_join.shingle_set(t.encode())) for t in texts), sent


@pytest.mark.parametrize("matched", [1 << 19, 50])
def test_a_range_is_matched_in_turns(monkeypatch, matched):
    rng = random.Random(6)
    monkeypatch.setattr(ngram_join, "MATCHED", matched)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[: rng.randint(60, 200)] + [f"d{d}x{i}" for i in range(rng.randint(0, 30))])
             for d in range(40)]
    texts += texts[:5]
    held, rows = {}, []
    for at in range(0, 45, 9):  # several tasks
        batch = pa.RecordBatch.from_pydict({
            "doc_id": pa.array(range(at, at + 9)),
            "data": pa.array([t.encode() for t in texts[at : at + 9]], pa.binary())})
        rows += [out for part in (0, 1) for out in ngram_join._emit(2, part, 2)([batch])]
    for t in set(texts):
        tokens = ngram_join.shingle_set(t.encode())
        for s in set(ngram_join.signatures(tokens)[0].tolist()):
            held.setdefault(s, set()).add(ngram_join.digest_of(tokens))
    table, lists = pa.Table.from_batches(rows), {}
    for at in range(4):
        use = [r == at and k == "sets" for r, k in
               zip(table["range"].to_pylist(), table["kind"].to_pylist())]
        out = ngram_join._match(table.filter(pa.array(use)))
        assert out.num_rows > (1 if matched == 50 else 0)
        for entries in ngram_join._unpack_sets(out.to_batches()):
            for e in entries.to_pylist():
                lists.setdefault(e["sig"], []).append(e)
    want = sorted(sorted(ids) for ids in held.values() if len(ids) > 1)
    assert want and sorted(sorted({e["id"] for e in x}) for x in lists.values()) == want
    for entries in lists.values():
        ids = [e["id"] for e in entries if e["first"]]
        assert len(ids) == len(set(ids)) == len({e["id"] for e in entries})
        assert {e["count"] for e in entries} == {len(ids)}


def test_exact_dedup_leaves_only_ids_on_disk(spark, monkeypatch):
    """The rows that stay are read from the input again, so later stages pay for no copy of it."""
    left, write, drop = {}, radix.kept, release
    monkeypatch.setattr(radix, "kept", lambda df, name: left.setdefault(
        (made := write(df, name)).kept_at, made))
    monkeypatch.setattr(
        radix, "release", lambda *t: [left.pop(x.kept_at) for x in t] and drop(*t), raising=False)
    texts = [("same " * 300) + f"end{d % 30}" for d in range(60)] + [f"own {d} " * 40 for d in range(40)]
    docs = spark.createDataFrame(
        [(d, t, f"s{d}") for d, t in enumerate(texts)], "doc_id long, text string, source string")
    out = radix.drop_copies(docs)
    assert [x.columns for x in left.values()] == [["doc_id"]]
    last = {t: d for d, t in enumerate(texts)}
    assert sorted(map(tuple, out.collect())) == sorted((d, t, f"s{d}") for t, d in last.items())
    # Where a doc_id repeats or is null texts are carried, and of equal rows one stays.
    more = docs.union(docs.where("doc_id in (70, 59)")).union(spark.createDataFrame(
        [(70, "other", "s"), (None, "other", "t"), (None, "third", "t")], docs.schema))
    assert sorted(map(tuple, radix.drop_copies(more).collect()), key=str) == sorted(
        [*((d, t, f"s{d}") for t, d in last.items()), (70, "other", "s"), (None, "third", "t")], key=str)
