"""Line dedup by pairwise alignment: rare line keys, patience diff, and deletion from the later document.

A document's lines are what lies between its line feeds. Its keys are the hashes of its single lines
of LINE words or more (shorter ones are common, and no keys), each of which counts for its words; and,
for passages of shorter lines, the hash of the shortest run of LEAST words or more from each line,
which counts for LEAST. Each document is paired, for each of its keys, with the earliest document that
has the key, so a key of any number of documents gives one pair for each. Pairs whose keys count for
LEAST words in sum are aligned; a line that is common to many documents makes none of its own.

A pair's lines are aligned by patience diff: lines that occur once in both are chained in order, and
the gaps between them are worked through likewise. Aligned blocks of LINE words or more are repeats;
what is left is aligned again without them, so that moved blocks are found too, and runs of LEAST
words that no alignment orders are found by their keys. If a pair's repeats hold LEAST words or more
in all, they are deleted from the later document; else they stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, shingles

#: Words that a pair must share for anything to be deleted, and words of a line that is a key, or of a block that is deleted.
LEAST, LINE = 50, 8
#: Followers that meet one copy of their leader's lines, about.
RUN = 128
#: Levels of gaps within gaps that anchors of unique lines are sought in, and alignments of what is left of a pair.
DEEP, ROUNDS = 16, 8


def keys(lines: list[int], words: list[int], least: int = LEAST) -> tuple[list[int], list[int], list[int]]:
    """(starts, ends, hashes) of the shortest run of `least` words or more from each line that has a word and such a run."""
    h, n = np.array(lines, np.int64).view(np.uint64), len(lines)
    if not n:
        return [], [], []
    total = np.concatenate([[0], np.cumsum(words)])
    stop = np.searchsorted(total, total[:-1] + least)
    start = np.flatnonzero((stop <= n) & (np.array(words) > 0))
    run = np.zeros(n + 1, np.uint64)
    up, down = shingles.powers(n + 1)
    np.cumsum(shingles.mix(h) * up[:n], out=run[1:])
    size = (stop[start] - start).astype(np.uint64)
    return start.tolist(), stop[start].tolist(), shingles.mix((run[stop[start]] - run[start]) * down[start] + size).view(np.int64).tolist()


def align(a: list, b: list) -> list[tuple[int, int, int]]:
    """Patience diff: (start in a, start in b, lines) of the aligned blocks, in order.

    A gap without a line that is unique on both sides, or one that lies DEEP gaps deep, is anchored
    by the longest chain of equal occurrences (the first with the first, and so on), and what is left
    of it is only compared from its ends; so time stays near the number of lines, however they repeat.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        a0, a1, b0, b1, deep = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1 or deep > DEEP:
            continue
        common = []
        if deep < DEEP:
            once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
            common = sorted((i, once_b[x]) for x, i in once_a.items() if x in once_b)
        if not common:
            common, deep = _occurrences(a, a0, a1, b, b0, b1), DEEP
        last = (a0, b0)
        for i, j in [*_rising(common), (a1, b1)]:
            todo.append((last[0], i, last[1], j, deep + 1))
            if i < a1 and j < b1:
                pairs.append((i, j))
                last = (i + 1, j + 1)
    out: list[tuple[int, int, int]] = []
    for i, j in sorted(pairs):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


def _once(x: list[int], at: int, to: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for i in range(at, to):
        seen[x[i]] = -1 if x[i] in seen else i
    return {h: i for h, i in seen.items() if i >= 0}


def _occurrences(a, a0, a1, b, b0, b1) -> list[tuple[int, int]]:
    """The n-th occurrence of each line on one side with its n-th on the other, in order."""
    at: dict = {}
    for j in range(b1 - 1, b0 - 1, -1):
        at.setdefault(b[j], []).append(j)
    return [(i, at[a[i]].pop()) for i in range(a0, a1) if at.get(a[i])]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain that rises in both members."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(ends, j)
        before[k] = at[p - 1] if p else -1
        if p == len(ends):
            ends.append(j)
            at.append(k)
        else:
            ends[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def repeated(early: list[int], early_words: list[int], late: list[int], words: list[int], least: int = LEAST, line: int = LINE) -> list[int]:
    """Lines of late to delete: blocks of `line` words or more that it shares with early, if they hold `least` in all."""
    gone: set[int] = set()
    held = set(early)
    for _ in range(ROUNDS):
        # A deleted line becomes one that nothing equals, so that blocks never close over it.
        rest = [x if i not in gone and x in held else None for i, x in enumerate(late)]
        new: set[int] = set()
        for _, j, n in align(early, rest):
            if sum(words[j : j + n]) >= line:
                new |= set(range(j, j + n))
        if not new:
            break
        gone |= new
    # What patience could not order in so many rounds is still shared: whole lines, and every run whose key early has.
    gone |= {i for i, x in enumerate(late) if words[i] >= line and x in held}
    have = set(keys(early, early_words, least)[2])
    for start, stop, key in zip(*keys(late, words, least), strict=True):
        if key in have:
            gone |= set(range(start, stop))
    return sorted(gone) if sum(words[i] for i in gone) >= least else []


def weights(lines: list[int], words: list[int], least: int = LEAST, line: int = LINE) -> dict[int, int]:
    """The keys of a document and the words that each counts for."""
    out = dict.fromkeys(keys(lines, words, least)[2], least)
    for x, n in zip(lines, words, strict=True):
        if n >= line:
            # A line that is repeated here may be deleted as often.
            out[x] = min(least, out.get(x, 0) + n)
    return out


def _lines(least: int, line: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").to_pylist()
            for a, b in shingles.batches(texts):
                h, w, k = [], [], []
                for text in texts[a:b]:
                    lines = text.split("\n")
                    h.append([xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x in lines])
                    w.append([len(x.split()) for x in lines])
                    k.append([{"key": x, "n": n} for x, n in weights(h[-1], w[-1], least, line).items()])
                kind = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(part.column(c).slice(a, b - a) for c in ("doc_id", "k")), *(pa.array(x, pa.list_(pa.int64())) for x in (h, w)), pa.array(k, kind)], ["doc_id", "k", "lines", "words", "keys"])

    return run


def _compare(least: int, line: int):
    """Rows come sorted by (leader, salt), the leader's own row first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, early = None, ([], [])
        for part in parts:
            out = []
            for i in range(part.num_rows):
                row = {c: part.column(c)[i].as_py() for c in ("a", "salt", "doc", "lines", "words")}
                if row["doc"] is None:
                    key, early = (row["a"], row["salt"]), (row["lines"], row["words"])
                elif key == (row["a"], row["salt"]) and (gone := repeated(*early, row["lines"], row["words"], least, line)):
                    out.append((row["doc"], gone))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["doc", "gone"])

    return run


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for text, g in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
        drop = set(g or ())
        out.append(None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
    return pa.array(out, pa.string())


def _order(doc_id, kind: str):
    """Bytes that order documents as their ids do, null last: numbers by value, all else by its string."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.unhex(F.lpad(F.hex(doc_id.cast("bigint").bitwiseXOR(F.lit(-(2**63)).cast("bigint"))), 16, "0")), F.unhex(F.lit("ff" * 8)))
    return F.coalesce(F.concat(doc_id.cast("string").cast("binary"), F.unhex(F.lit("00"))), F.unhex(F.lit("ff")))


def _repeats(docs: DataFrame, least: int, line: int) -> DataFrame:
    """(id, id_k, gone): the lines to delete of each document that has some; id_k is the text's MD5."""
    kind = dict(docs.dtypes)["doc_id"]
    base = docs.select("doc_id", F.unhex(F.md5(F.col("text"))).alias("k"), "text").where("text is not null")
    pair = "array<struct<key: bigint, n: bigint>>"
    lined = base.mapInArrow(shared.tidy(_lines(least, line)), f"doc_id {kind}, k binary, lines array<bigint>, words array<bigint>, keys {pair}")
    # doc orders documents by doc_id (null last) and then by their text's digest.
    lined = shared.cut(lined.withColumn("doc", F.concat(_order(F.col("doc_id"), kind), F.col("k"))), "line-docs")
    spread = lined.select("doc", F.explode("keys").alias("key")).select("doc", "key.key", "key.n")
    # A table of its own, so that the join below has an exchange on either side, whose hot keys can be split.
    first = shared.cut(spread.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a != z").select("key", "a"), "line-keys")
    # Repeated rows count twice here, which only means that a pair more is aligned.
    pairs = spread.join(first, "key").where("doc != a").groupBy("a", "doc").agg(F.sum("n").alias("n"))
    pairs = shared.cut(pairs.where(F.col("n") >= least).select("a", "doc"), "line-pairs")
    dealt = shared.dealt(pairs, "a", "doc", RUN)
    ask = dealt.select(F.col("doc").alias("of"), "a", "salt", "doc").unionAll(dealt.select(F.col("a").alias("of"), "a", "salt", F.lit(None).cast("binary").alias("doc")).distinct())
    wanted = shared.cut(pairs.select(F.explode(F.array("a", "doc")).alias("of")).distinct(), "line-wanted")
    body = shared.apart(lined.select(F.col("doc").alias("of"), "lines", "words"), wanted, "of")[1].dropDuplicates(["of"])
    rows = ask.join(body, "of").select("a", "salt", "doc", "lines", "words").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("doc").isNotNull())
    gone = rows.mapInArrow(shared.tidy(_compare(least, line)), "doc binary, gone array<bigint>").groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    return shared.cut(lined.select(F.col("doc_id").alias("id"), F.col("k").alias("id_k"), "doc").distinct().join(gone, "doc").select("id", "id_k", "gone"), "line-gone")


def _rows(docs: DataFrame, least: int, line: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, gone, text): docs as one value each, and the new text. First those from which nothing goes, which never move."""
    gone = _repeats(docs, least, line)
    # The document is one value here, so that none of its names meets those of the join.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("id"), F.unhex(F.md5(F.col("row.text"))).alias("id_k"))
    whole, maybe = shared.apart(rows, gone, "id", "id_k")
    gone = gone.withColumnsRenamed({"id": "of", "id_k": "of_k"})
    maybe = maybe.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("id_k") == F.col("of_k")), "left")
    rest = F.arrow_udf(_without, "string")(F.when(F.col("gone").isNotNull(), F.col("row.text")), F.col("gone"))
    none = F.lit(None).cast("array<bigint>")
    maybe = maybe.select("row", "gone", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(rest).alias("text"))
    return whole.select("row", none.alias("gone"), F.col("row.text").alias("text")), maybe


def dedup(docs: DataFrame, least: int = LEAST, line: int = LINE) -> DataFrame:
    """docs with each text's repeated lines deleted, and columns n_lines, deleted_lines (their numbers from 0).

    Of two documents the later has the larger doc_id (numbers by value, other ids as strings), or, for
    rows that repeat a doc_id, the larger MD5 of its text; a null doc_id is last. Rows equal in doc_id
    and text are one document, and each gets the same result. A null text stays null with n_lines 0;
    an empty text is one empty line and stays. A text all of whose lines go is empty. A very long text
    is one document like any other. White space within a line matters. Every other column stays as it
    is, whatever its name, except that n_lines and deleted_lines are replaced. No documents give none.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "deleted_lines")]
    held = F.col("row.text")
    n = F.when(held.isNull(), F.lit(0)).otherwise(F.length(held) - F.length(F.replace(held, F.lit("\n"), F.lit(""))) + 1)
    deleted = F.coalesce("gone", F.array().cast("array<bigint>"))
    whole, rest = (x.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names), n.cast("bigint").alias("n_lines"), deleted.alias("deleted_lines")) for x in _rows(docs, least, line))
    return whole.unionAll(rest)


def cleaned(docs: DataFrame, least: int = LEAST, line: int = LINE) -> DataFrame:
    """docs with their own columns alone and each text's repeated lines deleted; every case as in dedup().

    A document that loses lines and has nothing but white space left goes; a column n_chars of one
    that stays is counted anew. A null or empty text from which nothing is deleted stays as it is.
    """
    whole, rest = _rows(docs, least, line)
    fresh = lambda c: F.when(F.col("gone").isNull(), F.col("row")[c]).otherwise(F.length("text").cast(dict(docs.dtypes)[c])).alias(c)
    of = lambda c: F.col("text") if c == "text" else fresh(c) if c == "n_chars" else F.col("row")[c].alias(c)
    return whole.select("row.*").unionAll(rest.where("gone is null or length(trim(text)) > 0").select(*map(of, docs.columns)))
