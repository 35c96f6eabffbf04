import pytest
from conftest import SF
from llm_helpers import brute_classes, brute_repeats, check_packed

import corpus_pipeline
from framestride.llm import language_id

IDENTIFY, LINES, NEAR, PACK = (f for _, f in corpus_pipeline.STAGES)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "packing"]


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for stage in (IDENTIFY, LINES, NEAR):
        steps.append(spark.createDataFrame(stage(spark, steps[-1], SF).collect(), docs.schema))
        assert steps[-1].columns == docs.columns and steps[-1].count() > 0
    rows = [sorted(map(tuple, x.collect())) for x in steps]
    # Language ID keeps the rows that the operator does not reject, as they are.
    stay = language_id.documents(docs).where("not lang_rejected").select(*docs.columns).collect()
    assert rows[1] == sorted(map(tuple, stay)) and len(rows[1]) == len(rows[0])
    # Line dedup deletes what must go and nothing that may not.
    want, left = brute_repeats([(r[0], r[1]) for r in rows[1]]), {r[0]: r for r in rows[2]}
    for doc_id, text, *_ in rows[1]:
        lines, (must, may) = text.split("\n"), want[doc_id]
        kept = [] if doc_id not in left else left[doc_id][1].split("\n")
        assert [x for i, x in enumerate(lines) if i not in may] == [x for x in kept if x not in {lines[i] for i in may - must}] or len(kept) <= len(lines) - len(must)
        if not may:
            assert left[doc_id][1] == text
        if doc_id not in left:
            assert not "".join(x for i, x in enumerate(lines) if i not in may).strip()
    assert all(r[4] == len(r[1]) for r in rows[2])
    # Near-dedup keeps the first document of each class of its own input, as it is.
    first = {c for _, c in brute_classes([(r[0], r[1]) for r in rows[2]])}
    assert rows[3] == [r for r in rows[2] if r[0] in first]
    check_packed(steps[3].collect(), PACK(spark, steps[3], SF).collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


BODY = "\n".join(f"Line {i} of the passage that they all share is here and goes on." for i in range(9))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and then runs away from the house. " * 3), (1, "The quick brown fox jumps over the lazy dog and then runs away from the house. " * 3), (2, None), (3, ""), (4, " \n "), (None, "He said that it was the best of times and the worst of times for all of them."),
    (5, BODY), (6, BODY), (7, "Own start of this one, and then the rest.\n" + BODY), (8, "word and more words of the text. " * 20_000), (9, "xq zzk qqv kkx vvq xzq kqz vxk zqx kvz qzv xkq zvk qkx vzx kzq"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns named as the operators name theirs."""
    rows = [(i, t, "en" if n % 2 else None, None if n % 3 else "web", None if t is None else len(t), n, "k", [n]) for n, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines int, k string, lang_id array<int>")


def test_language_id_on_odd_rows(spark, odd):
    kept = IDENTIFY(spark, odd, SF)
    assert kept.columns == odd.columns
    own = {r["n_lines"]: tuple(r) for r in odd.collect()}
    got = {r["n_lines"]: tuple(r) for r in kept.collect()}
    # Nothing to judge by goes; all else stays as it was, repeated rows both.
    assert all(own[n] == r for n, r in got.items()) and {0, 1, 5, 6, 7, 8, 9} <= set(got) and not {2, 3, 4} & set(got)


def test_line_dedup_on_odd_rows(spark, odd):
    kept = LINES(spark, odd, SF)
    assert kept.columns == odd.columns
    got = {r["n_lines"]: r for r in kept.collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 8, 9, 10}, "only the whole repeat goes"
    assert got[8]["text"] == "Own start of this one, and then the rest." and got[8]["n_chars"] == len(got[8]["text"])
    assert all(got[n]["text"] == ROWS[n][1] and got[n]["k"] == "k" and got[n]["lang_id"] == [n] for n in got if n != 8)


def test_near_dedup_on_odd_rows(spark, odd):
    kept = NEAR(spark, odd, SF)
    assert kept.columns == odd.columns
    got = sorted(r["n_lines"] for r in kept.collect())
    # One of the two equal rows, the first of equal and of near texts; the null text and the null id stay.
    assert got[0] in (0, 1) and got[1:] == [2, 3, 4, 5, 6, 9, 10]


def test_packing_of_odd_rows(spark, odd):
    got = PACK(spark, odd, SF).collect()
    assert sum(r["start"] == 0 for r in got) == len(ROWS) and sum(r["doc_id"] is None for r in got) == 1
    alone = odd.where("n_lines != 1")
    check_packed(alone.collect(), PACK(spark, alone, SF).collect())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_tables(spark, odd, stage):
    assert stage(spark, odd.limit(0), SF).count() == 0
