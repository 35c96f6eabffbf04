"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Each of a text's five-word shingles is hashed once; the hash picks one of BINS bins, and each bin
keeps its least hash. An empty bin takes the value of the first non-empty bin on its own fixed
sequence of probes, the same for every text (optimal densification). BITS low-order bits of each bin
are kept, packed. Two bins that hold different shingles agree in those bits by chance with
probability 2 ** -BITS, for which likeness() corrects.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, shingles

BINS, BITS = 512, 4
#: Characters of the documents of a run, about; a run is read as a stream by one task. Runs' edges are picked from
#: EDGES sampled ids a run, which the driver holds (3 million of them for 100 TB).
RUN, EDGES = 32 << 20, 20
#: Characters that are fingerprinted at once, about.
BATCH = 1 << 20
_U = np.uint64


@lru_cache(maxsize=64)
def _probe(turn: int, bins: int) -> np.ndarray:
    """Where each bin looks in its turn-th probe."""
    z = shingles.mix(np.arange(bins, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U((turn + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
    return (z % _U(bins)).astype(np.int64)


def fingerprints(texts: list[str | None], bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(packed low-order bits, bins * bits / 8 bytes per text; whether the text has a word, else its bytes are 0)."""
    h, at = shingles.shingles(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(at))
    h = shingles.mix(h + _U(0xA0761D6478BD642F))
    none = _U(0xFFFFFFFFFFFFFFFF)
    least = np.full(n * bins, none)
    np.minimum.at(least, doc * bins + (h >> _U(40)).astype(np.int64) % bins, h)
    has = np.diff(at) > 0
    empty = np.flatnonzero((least == none) & np.repeat(has, bins))
    found, turn = least.copy(), 0
    while len(empty):
        got = least[empty // bins * bins + _probe(turn, bins)[empty % bins]]
        full = got != none
        found[empty[full]] = got[full]
        empty, turn = empty[~full], turn + 1
    low = (found & _U((1 << bits) - 1)).astype(np.uint8).reshape(n, bins)
    low[~has] = 0
    unpacked = (low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(unpacked.reshape(n, bins * bits).astype(bool), axis=1), has


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity per row, corrected for agreement by chance, from 0 to 1.

    Texts without a word: 1 with one another, 0 with any other.
    """
    other = np.unpackbits(a ^ b, axis=1).reshape(len(a), bins, bits).any(2)
    same, chance = 1 - other.mean(1), 2.0**-bits
    out = np.clip((same - chance) / (1 - chance), 0, 1)
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(np.float64), out)


def edited(text: str, following: str) -> str:
    """text with its last third (in code points, rounded down) replaced by as much of the start of following."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by run in falling order; the last of each run (guest) only follows its predecessor."""
    kept: list[tuple] = []
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(rows: list[tuple], ids: pa.DataType) -> Iterator[pa.RecordBatch]:
        texts = [r[2] or "" for r in rows]
        pair = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][3]]
        alone = [edited(texts[i], texts[i + 1]) for i in pair]
        (own, has), (new, has_new) = fingerprints(texts), fingerprints(alone)
        at = np.array(pair, np.int64)
        edge, step = likeness(own[at], new, ~has[at], ~has_new), likeness(own[at], own[at + 1], ~has[at], ~has[at + 1])
        yield pa.RecordBatch.from_arrays([
            pa.array([rows[i][1] for i in pair], ids), pa.array([len(texts[i]) for i in pair], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in alone], pa.string()),
            pa.array([own[i].tobytes().hex() for i in pair], pa.string()), pa.array([x.tobytes().hex() for x in new], pa.string()), pa.array(edge, pa.float64()), pa.array(step, pa.float64()),
        ], names)

    for part in parts:
        kind = part.column("doc_id").type
        rows = list(zip(*(part.column(c).to_pylist() for c in ("run", "doc_id", "text", "guest")), strict=True))
        for lo, hi in shingles.batches([r[2] for r in rows], BATCH):
            kept += rows[lo:hi]
            yield from work(kept, kind)
            kept = kept[-1:]


def _rank(docs: DataFrame):
    """A number that never falls as doc_id rises: numbers themselves, else the 8 bytes of the string after what all ids begin with."""
    kind = dict(docs.dtypes)["doc_id"]
    low = F.lit(-(2**63)).cast("bigint")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col("doc_id").cast("bigint"), low)
    if kind != "string":
        raise TypeError(f"doc_id is {kind}; documents are put in order by integers or strings")
    ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    same = len(os.path.commonprefix([(x or "").encode() for x in ends]))
    eight = F.rpad(F.hex(F.substring(F.encode("doc_id", "UTF-8"), same + 1, 8)), 16, "0")
    # The upper and the lower half, so that the sign bit turns without an overflow.
    half = lambda at: F.conv(F.substring(eight, at, 8), 16, 10).cast("bigint")
    return F.coalesce(F.shiftleft(half(1) - F.lit(2**31), 32) + half(9), low)


def _edges(ranked: DataFrame, runs: int, sharp: bool) -> list[tuple[int, int]]:
    """(r, h) from which each run but the first goes on, in rising order, from a sample by hash; r alone counts unless sharp."""
    if runs == 1:
        return []
    rows = shared.pick(ranked.select("r", "h"), runs * EDGES, "h", "r").collect()
    rows = sorted((x["r"], x["h"] if sharp else -(2**63)) for x in rows)
    return sorted({rows[len(rows) * i // runs] for i in range(1, runs)}) if rows else []


def _numbered(edges: list[tuple[int, int]]):
    """The number of the run that holds (r, h)."""
    r, h = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))

    def run(rank: pa.Array, text: pa.Array) -> pa.Array:
        own, sharp = rank.to_numpy(), text.to_numpy()
        low, high = np.searchsorted(r, own, "left"), np.searchsorted(r, own, "right")
        # Where a run begins within the rows of one id, these are told apart by their texts' hashes.
        for i in np.flatnonzero(low < high):
            low[i] += np.searchsorted(h[low[i] : high[i]], sharp[i], "right")
        return pa.array(low.astype(np.int32))

    return F.arrow_udf(run, "int")


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of docs.

    The next document is that of the next smaller doc_id (an integer, or a string in the order of its
    bytes); the first one follows the last. A null text is empty; a null doc_id is smaller than any.
    Rows of equal doc_id stand in the order of their texts' hashes; of rows that are equal altogether
    each follows the other. A single document is its own next one. A very long text is one row like any
    other. Other columns are not read, whatever their names; no documents give no rows.
    """
    spark, schema = docs.sparkSession, f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count, size = base.agg(F.count("*"), F.sum(F.length("text") + 1)).first()
    if not count:
        return spark.createDataFrame([], schema)
    ranked = base.select(_rank(docs).alias("r"), F.xxhash64("text").alias("h"), "doc_id", "text")
    # As many runs as their size asks for, and on small tables as there are tasks to be had.
    runs = max(-(-size // RUN), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BATCH)))
    edges = _edges(ranked, max(1, min(count, runs)), dict(docs.dtypes)["doc_id"] != "string")
    run = _numbered(edges)(F.col("r"), F.col("h")) if edges else F.lit(0)
    dealt = ranked.select("r", "h", "doc_id", "text", run.alias("run"), F.lit(False).alias("guest"))
    # The first row of each run is also the guest at the end of the run above it.
    kind = "r bigint, h bigint, own int, to int"
    tops = dealt.groupBy("run").agg(F.max(F.struct("doc_id", "h", "r")).alias("top")).select("run", "top.*").collect()
    own = sorted(x["run"] for x in tops)
    above = dict(zip(own, [*own[1:], own[0]], strict=True))
    tops = spark.createDataFrame([(x["r"], x["h"], x["run"], above[x["run"]]) for x in tops], kind)
    guest = ranked.join(F.broadcast(tops), ["r", "h"]).dropDuplicates(["to"]).select("r", "h", "doc_id", "text", F.col("to").alias("run"), F.lit(True).alias("guest"))
    rows = dealt.unionAll(guest).repartitionById(len(edges) + 1, "run").sortWithinPartitions("run", "guest", F.desc("doc_id"), F.desc("h"))
    return rows.select("run", "doc_id", "text", "guest").mapInArrow(shared.tidy(_digest), schema)
