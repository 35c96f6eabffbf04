import base64

import public_tokenizers as P
import tiktoken
from conftest import SF

from framestride.llm import shared, token_counts

CHANGES = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def rows(df):
    return sorted((repr(r["source"]), r["lang"], r["tokenizer"], r["docs"], r["tokens"]) for r in df.collect())


def test_documents_against_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["byte_bpe_50k", "byte_bpe_multi_50k"]
    got = token_counts.maintained(docs, [(n, P.path(f"{n}.tiktoken")) for n in names], P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in docs.collect():
        d, t = want.get((r["source"], r["lang"]), (0, 0))
        want[(r["source"], r["lang"])] = (d + 1, t + len(library.encode_ordinary(r["text"])))
    assert rows(got) == sorted((repr(s), g, names[1], d, t) for (s, g), (d, t) in want.items())


def test_signed_batches_commit_once(spark):
    folder = shared.scratch(spark, "rollup")
    make = lambda *x: spark.createDataFrame(list(x), CHANGES)
    rollup = token_counts.Rollup(spark, folder)
    assert rollup.totals().count() == 0
    assert rollup.apply("a", make(("s", "en", "v1", 1, 10), ("s", "en", "v1", 1, 5), (None, "en", "v1", 1, 7), ("t", None, "v1", 1, None)))
    assert not rollup.apply("a", make(("s", "en", "v1", 100, 100)))
    assert rollup.apply("b", make(("s", "en", "v1", -1, -5), ("s", "en", "v1", 0, 2), (None, "en", "v1", -1, -7)))
    again = token_counts.Rollup(spark, folder)
    assert not again.apply("b", make(("s", "en", "v1", -1, -5)))
    assert rows(again.totals()) == [("'s'", "en", "v1", 1, 12), ("'t'", None, "v1", 1, 0)]
    assert again.apply("nothing", make()) and rows(again.totals()) == rows(rollup.totals())


def test_an_unfinished_commit_is_not_seen(spark, monkeypatch):
    rollup = token_counts.Rollup(spark, shared.scratch(spark, "rollup"))
    batch = spark.createDataFrame([("s", "en", "v1", 1, 10)], CHANGES)
    monkeypatch.setattr(token_counts.json, "dumps", lambda _: 1 / 0)
    try:
        rollup.apply("a", batch)
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    assert rollup.totals().count() == 0 and rollup.apply("a", batch) and rollup.totals().first()["tokens"] == 10


def test_revisions_move_documents(spark):
    old = spark.createDataFrame([(1, "s", "en", "v1", 10), (2, "s", "en", "v1", 20)], "doc_id bigint, source string, lang string, tokenizer string, tokens bigint")
    new = spark.createDataFrame([(1, "s", "de", "v2", 11), (2, "s", "en", "v2", 21)], old.schema)
    rollup = token_counts.Rollup(spark, shared.scratch(spark, "rollup"))
    rollup.apply("a", token_counts.inserts(old))
    rollup.apply("b", token_counts.revised(old, new))
    assert rows(rollup.totals()) == [("'s'", "de", "v2", 1, 11), ("'s'", "en", "v2", 1, 21)]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 1), (1, "", None, None, 2), (None, "a b", "en", "s", 3)], "doc_id bigint, text string, lang string, source string, docs int")
    got = token_counts.counted(docs, "v", P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((repr(r["doc_id"]), r["tokens"]) for r in got) == [("1", 0), ("1", 0), ("None", 2)]
    assert token_counts.maintained(docs.limit(0), [("v", P.path("byte_bpe_50k.tiktoken"))], P.PATTERN).count() == 0


def test_marks_make_up_for_a_lost_one_and_old_versions_go(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    rows = lambda n: spark.createDataFrame([("s", "en", "t", 1, n)], token_counts.SCHEMA)
    for i in range(4):
        assert rollup.apply(f"batch {i}", rows(10**i))
    # As if the writer had died after it published the last version: its mark and a draft's remains.
    rollup.fs.delete(rollup._mark("batch 3"), False)
    (tmp_path / "r" / "draft-lost").write_text("{}")
    again = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert not any(again.apply(f"batch {i}", rows(5)) for i in range(4))
    assert again.apply("batch 4", rows(10**4)) and again.fs.exists(rollup._mark("batch 3"))
    assert again.totals().first()["tokens"] == 11111 and again.totals().first()["docs"] == 5
    left = [x.name for x in (tmp_path / "r").iterdir() if not x.name.startswith(".")]
    assert sum(n.startswith("version-") for n in left) == 2 and sum(n.startswith("table-") for n in left) == 2 and "draft-lost" not in left


def test_long_texts_are_counted_whole(spark):
    import public_tokenizers as P

    docs = spark.createDataFrame([(1, "word " * 300_000, None, None, 9), (2, None, "en", "s", 9), (2, "", "en", "s", 9)], "doc_id bigint, text string, lang string, source string, tokens int")
    got = token_counts.counted(docs, "b", P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((r["doc_id"], r["tokens"]) for r in got) == [(1, 300_001), (2, 0), (2, 0)]
