import random
import time

import pytest
from conftest import SF
from llm_helpers import brute_repeats

from framestride.llm import line_dedup


def check(rows, got):
    want = brute_repeats(rows)
    for d, text in rows:
        lines, gone = text.split("\n"), set(got[d]["deleted_lines"])
        assert got[d]["n_lines"] == len(lines)
        assert got[d]["text"] == "\n".join(x for i, x in enumerate(lines) if i not in gone)
        assert want[d][0] <= gone <= want[d][1], d
    return sum(len(must) for must, _ in want.values())


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(tuple(r) for r in docs.collect())
    assert check(rows, {r["doc_id"]: r for r in line_dedup.dedup(docs).collect()}) > 50
    own = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r["doc_id"]: r for r in line_dedup.cleaned(own.withColumn("n_lines", own["n_chars"])).collect()}
    assert left and all(r["n_chars"] in (len(r["text"]), r["n_lines"]) for r in left.values())


@pytest.mark.parametrize("seed", range(4))
def test_scattered_lines(spark, seed):
    """Whole lines between edited ones: no run of 50 words, but 50 words in all; and pairs that share fewer."""
    rng = random.Random(seed)
    line = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(8, 14)))
    pool, rows = [line() for _ in range(12)], []
    for d in range(60):
        body = [x for x in rng.sample(pool, rng.randint(0, 9)) for x in (x, line())]
        rows.append((d, "\n".join(body)))
    assert check(rows, {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}) > 20


@pytest.mark.parametrize("seed", range(3))
def test_shared_and_moved_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(line_dedup, "RUN", 5)
    rng = random.Random(seed)
    line = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passages = [[line(rng.randint(5, 30)) for _ in range(6)] for _ in range(4)] + [[line(80)]]
    common = [line(4), "", line(9)]
    rows = []
    for d in range(40):
        body = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            body += p[a:] + [rng.choice(common)] + [line(rng.randint(1, 40))]
        rows.append((d, "\n".join(body)))
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check(rows, {r["doc_id"]: r for r in got})


def test_patience_diff():
    a, b = list("abcxyzde"), list("abcde")
    assert line_dedup.align(a, b) == [(0, 0, 3), (6, 3, 2)]
    assert line_dedup.align([], [1]) == [] and line_dedup.align([1], [2]) == []
    assert line_dedup.align([1, 1, 1, 2], [1, 1, 2]) == [(0, 0, 2), (3, 2, 1)]
    swapped = line_dedup.repeated([1, 2], [60, 60], [2, 1], [60, 60])
    assert swapped == [0, 1]


def test_repeated_lines_take_time_near_their_number():
    rng = random.Random(2)
    a, b = ([rng.randint(0, 3) for _ in range(50_000)] for _ in range(2))
    began = time.process_time()
    blocks = line_dedup.align(a, b)
    assert time.process_time() - began < 5 and sum(n for _, _, n in blocks) > 10_000
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks)


def test_string_ids(spark):
    text = "\n".join(f"line number {i} of a passage that is shared by them" for i in range(8))
    got = line_dedup.dedup(spark.createDataFrame([("b", text), ("a", text), ("aa", text), (None, text)], "doc_id string, text string")).collect()
    assert {r["doc_id"]: len(r["deleted_lines"]) for r in got} == {"a": 0, "aa": 8, "b": 8, None: 8}


def test_edge_cases(spark):
    big, small = "word " * 60 + "end", "too few words to matter"
    rows = [(1, big + "\n" + small), (2, small + "\n" + big), (3, None), (4, ""), (5, "\n\n"), (None, big), (6, big), (6, "x\n" + big), (7, big + "\ntail"), (7, big + "\ntail"), (8, ("one line " * 40 + "\n") * 3000)]
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id bigint, text string, n_lines int, gone string")
    got = line_dedup.dedup(docs)
    assert got.columns == ["doc_id", "text", "gone", "n_lines", "deleted_lines"]
    seen = [(r["doc_id"], r["n_lines"], r["deleted_lines"], None if r["doc_id"] == 8 else r["text"]) for r in got.collect()]
    want = [
        (1, 2, [], big + "\n" + small), (2, 2, [1], small), (3, 0, [], None), (4, 1, [], ""), (5, 3, [], "\n\n"), (None, 1, [0], ""), (6, 1, [0], ""), (6, 2, [1], "x"),
        (7, 2, [0], "tail"), (7, 2, [0], "tail"), (8, 3001, [], None),
    ]
    assert sorted(map(repr, seen)) == sorted(map(repr, want))
    assert line_dedup.dedup(docs.limit(0)).count() == 0
