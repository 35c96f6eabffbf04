"""MinHash near-dedup of weighted word shingles by ProbMinHash, banding and verification.

Each text is the weighted set of its five-word shingles (weight: how often a shingle occurs). Every
shingle sends out a Poisson process of arrivals whose rate is its weight; each arrival falls into one
of REGISTERS registers, which keeps its earliest arrival's shingle. A shingle stops as soon as its
next arrival is later than every register's earliest one. Two texts agree in a register with a
probability that equals their probability Jaccard similarity J_P. ROWS registers make a band; texts
that share a band are candidates, and candidates are verified by their exact J_P.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, shingles

REGISTERS, ROWS = 96, 4
BANDS = REGISTERS // ROWS
THRESHOLD = 0.8
#: Pairs whose signatures agree in fewer registers are not verified: five standard errors below 0.8.
LEAST_AGREED = int(REGISTERS * THRESHOLD - 5 * (REGISTERS * THRESHOLD * (1 - THRESHOLD)) ** 0.5)
#: Followers that meet one copy of their leader's text, about.
RUN = 128
#: Registers of the sharper signature by which the rest of a bucket is compared, and its least agreement
#: (four standard errors below 0.8).
SHARP, LEAST_SHARP = 1024, 768
#: Texts (and their characters) that are held in memory as a stretch of the bucket streams past, and texts of a stretch.
BLOCK, HELD, STRETCH = 256, 16 << 20, 512
#: Bytes of weighted shingles that a worker remembers in comparing.
REMEMBER = 32 << 20

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def weighted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, weights, offsets): the distinct shingles of each text in rising order, with counts."""
    h, at = shingles.shingles(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return h[first], np.diff(np.append(first, len(h))).astype(np.float64), np.searchsorted(doc[first], np.arange(len(texts) + 1))


def signatures(h: np.ndarray, w: np.ndarray, at: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Per text the shingle that arrives first in each register; 0 throughout where a text has none."""
    n = len(at) - 1
    time = np.full(n * registers, np.inf)
    sig = np.zeros(n * registers, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(at))
    seed, clock, turn = h.copy(), np.zeros(len(h)), 0
    while len(seed):
        turn += 1
        z = shingles.mix(seed + _U(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        clock = clock - np.log(((z >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        slot = doc * registers + (shingles.mix(z ^ _GOLD) % _U(registers)).astype(np.int64)
        np.minimum.at(time, slot, clock)
        won = time[slot] == clock
        sig[slot[won]] = seed[won]
        open_ = np.unique(doc)
        last = np.zeros(n)
        last[open_] = time.reshape(n, registers)[open_].max(1)
        stay = clock < last[doc]
        seed, clock, w, doc = seed[stay], clock[stay], w[stay], doc[stay]
    return sig.reshape(n, registers)


def bands(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), np.uint64)
    for j in range(ROWS):
        out = shingles.mix(out * _U(31) + sig[:, j::ROWS] + np.arange(BANDS, dtype=np.uint64))
    return out


def prob_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Exact J_P of two weighted sets with rising hashes: sum over d of 1 / sum over e of max(x_e/x_d, y_e/y_d)."""
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    c = int(both.sum())
    if not c:
        return 0.0
    if wa.max() == wa.min() and wb.max() == wb.min():
        return c / (len(ha) + len(hb) - c)
    x, y = wa / wa.sum(), wb / wb.sum()
    alone = np.ones(len(hb), bool)
    alone[at[both]] = False
    xs = np.concatenate([x, np.zeros(int(alone.sum()))])
    ys = np.concatenate([np.where(both, y[at], 0.0), y[alone]])
    with np.errstate(divide="ignore"):
        ratio = xs / ys
    order = np.argsort(ratio, kind="stable")
    ratio, xs, ys = ratio[order], xs[order], ys[order]
    mine = np.flatnonzero((xs > 0) & (ys > 0))
    least = np.searchsorted(ratio, ratio[mine], "left")
    above = np.append(np.cumsum(xs[::-1])[::-1], 0.0)[least]
    below = np.append(0.0, np.cumsum(ys))[least]
    return float((1.0 / (above / xs[mine] + below / ys[mine])).sum())


def _sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        ids, keys, texts = part.column(0), part.column(1), part.column(2).to_pylist()
        for a, b in shingles.batches(texts):
            h, w, at = weighted(texts[a:b])
            sig = signatures(h, w, at)
            has = np.diff(at) > 0
            band = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(has, BANDS, 0))), pa.int32()), pa.array(bands(sig[has]).view(np.int64).ravel()))
            low = sig.astype(np.uint16)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), keys.slice(a, b - a), band, pa.array([low[i].tobytes() if has[i] else None for i in range(b - a)], pa.binary()), pa.array([len(t) for t in texts[a:b]], pa.int64())], ["doc_id", "k", "bands", "low", "chars"])


def _agreed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose signatures agree in LEAST_AGREED registers at least."""
    for part in parts:
        a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("low_a", "low_b"))
        yield part.filter(pa.array((a == b).sum(1) >= LEAST_AGREED)).select(["a", "b"])


def _verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, salt), the leader's own row first; a run of rows holds one leader in memory."""
    key, leader = None, None
    for part in parts:
        texts, heads, runs, bs = part.column("text").to_pylist(), part.column("a").to_pylist(), part.column("salt").to_pylist(), part.column("b").to_pylist()
        out = []
        for lo, hi in shingles.batches(texts):
            h, w, at = weighted(texts[lo:hi])
            for i in range(lo, hi):
                s = slice(at[i - lo], at[i - lo + 1])
                if bs[i] is None:
                    key, leader = (heads[i], runs[i]), (h[s].copy(), w[s].copy())
                elif key == (heads[i], runs[i]) and prob_jaccard(*leader, h[s], w[s]) >= THRESHOLD - 1e-12:
                    out.append((heads[i], bs[i]))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.binary()) for j in (0, 1)], ["a", "b"])


def _sharpen(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        texts = part.column("text").to_pylist()
        for a, b in shingles.batches(texts):
            sig = signatures(*weighted(texts[a:b]), SHARP).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(part.column(c).slice(a, b - a) for c in ("k", "text")), pa.array([x.tobytes() for x in sig], pa.binary())], ["k", "text", "sharp"])


class _Shingles:
    """Weighted shingles of texts by key, the latest REMEMBER bytes of them."""

    def __init__(self):
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.bytes = 0

    def get(self, k: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        got = self.known.pop(k, None)
        if got is None:
            got = weighted([text])[:2]
            self.bytes += 16 * len(got[0])
            while self.known and self.bytes > REMEMBER:
                self.bytes -= 16 * len(self.known.pop(next(iter(self.known)))[0])
        self.known[k] = got
        return got


def _compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, block, stretch), those of the block (away) first; then the stretch streams past.

    Pairs that agree enough, in the first band that they share, are verified here, unless links of
    this block and stretch join them already. So what is emitted is a forest: fewer links than texts.
    """
    key, held, root, known = None, None, {}, _Shingles()

    def find(x: bytes) -> bytes:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def unpack(part: pa.RecordBatch, at: int, to: int) -> tuple:
        own = part.slice(at, to - at)
        bands_ = np.array(own.column("bands").to_pylist(), np.int64)
        sharp = np.frombuffer(b"".join(own.column("sharp").to_pylist()), np.uint8).reshape(-1, SHARP)
        return own.column("k").to_pylist(), own.column("root").to_pylist(), np.array(own.column("is_main").to_pylist(), bool), bands_, sharp, own.column("text").to_pylist()

    for part in parts:
        tile = np.stack([part.column(c).to_numpy() for c in ("bucket", "block", "stretch")])
        away, out = np.array(part.column("away").to_pylist(), bool), []
        turn = np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(0) | (away[1:] != away[:-1])) + 1
        for at, to in zip(np.append(0, turn), np.append(turn, len(away)), strict=True):
            if at == to:
                continue
            rows = unpack(part, at, to)
            if key != tuple(tile[:, at]):
                key, held, root = tuple(tile[:, at]), None, {}
            if away[at]:
                held = rows if held is None else tuple(x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(held, rows, strict=True))
                continue
            if held is None:
                continue
            for i in range(len(held[0])):
                for j in np.flatnonzero((held[4][i] == rows[4]).sum(1) >= LEAST_SHARP):
                    same = np.flatnonzero(held[3][i] == rows[3][j])
                    first = held[3][i][same[0]] == key[0] if len(same) else False
                    if not first or not (rows[2][j] or held[0][i] < rows[0][j]) or (x := find(held[1][i])) == (y := find(rows[1][j])):
                        continue
                    if prob_jaccard(*known.get(held[0][i], held[5][i]), *known.get(rows[0][j], rows[5][j])) >= THRESHOLD - 1e-12:
                        root[max(x, y)] = min(x, y)
                        out.append((held[0][i], rows[0][j]))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.binary()) for j in (0, 1)], ["a", "b"])


def _held(ks: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """(k, text) of the keys of a table: each text once, however many rows have it. Only texts that may be wanted move."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    _, wanted = shared.apart(texts.select("k", name, "text"), ks, "k")
    first = signed.select("k", name).join(ks, "k", "left_semi")
    return wanted.join(first, ["k", "name"]).dropDuplicates(["k", "name"]).select("k", "text")


def _verified(pairs: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of distinct texts that reach THRESHOLD; pairs is a table."""
    # A leader's followers are dealt over as many runs as keep any run short; each run has the leader's text.
    dealt = shared.dealt(pairs, "a", "b", RUN)
    ask = dealt.select(F.col("b").alias("k"), "a", "salt", "b").unionAll(dealt.select(F.col("a").alias("k"), "a", "salt", F.lit(None).cast("binary").alias("b")).distinct())
    ks = shared.cut(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "near-wanted")
    # Each text is sent once to its key, where one row per wanted pair or leader run takes it on.
    rows = ask.join(_held(ks, signed, texts), "k").select("a", "salt", "b", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull())
    return rows.mapInArrow(shared.tidy(_verify), "a binary, b binary")


def _likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    low = signed.select("k", "low")
    likely = pairs.join(low.select(F.col("k").alias("a"), F.col("low").alias("low_a")), "a").join(low.select(F.col("k").alias("b"), F.col("low").alias("low_b")), "b")
    return shared.cut(likely.mapInArrow(_agreed, "a binary, b binary"), "near-likely")


def _rest(member: DataFrame, root: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join the components which share a bucket, by the sharper signature and exact comparison."""
    rooted = member.select("k", "bucket", "chars").join(root.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    # A bucket's largest component needs no pairs of its own; every other text meets all but its own component.
    by = rooted.groupBy("bucket", "root").agg(F.count("*").alias("m"), F.sum("chars").alias("chars"))
    main = by.groupBy("bucket").agg(F.max(F.struct("m", "root", "chars")).alias("main"), F.count("*").alias("parts"), F.sum("m").alias("all"), F.sum("chars").alias("chars")).where("parts > 1")
    blocks = F.greatest(F.ceil((F.col("all") - F.col("main.m")) / BLOCK), F.ceil((F.col("chars") - F.col("main.chars")) / HELD))
    main = main.select("bucket", F.col("main.root").alias("main"), blocks.alias("blocks"), F.ceil(F.col("all") / STRETCH).alias("stretches"))
    mixed = shared.cut(rooted.join(main, "bucket").withColumn("is_main", F.col("root") == F.col("main")).drop("main", "chars"), "near-mixed")
    ks = shared.cut(mixed.select("k").distinct(), "near-wanted")
    sharp = _held(ks, signed, texts).mapInArrow(shared.tidy(_sharpen), "k binary, text string, sharp binary")
    full = mixed.join(sharp.join(signed.select("k", "bands"), "k"), "k")
    # A tile is a block against a stretch of the bucket: the block's texts come first.
    column = ["bucket", "block", "stretch", "away", "k", "root", "is_main", "bands", "sharp", "text"]
    own = lambda n: F.pmod(F.xxhash64("k"), n)
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    past = F.transform(every("blocks"), lambda i: F.struct(i.alias("block"), own("stretches").alias("stretch"), F.lit(False).alias("away")))
    here = F.transform(every("stretches"), lambda i: F.struct(own("blocks").alias("block"), i.alias("stretch"), F.lit(True).alias("away")))
    rows = full.select("*", F.explode(F.when(F.col("is_main"), past).otherwise(F.concat(past, here))).alias("at")).select("*", "at.*").select(*column)
    rows = rows.repartition("bucket", "block", "stretch").sortWithinPartitions("bucket", "block", "stretch", F.desc("away"))
    return rows.mapInArrow(shared.tidy(_compare), "a binary, b binary")


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept, k) per row of docs (doc_id, text); k is the MD5 of the text: classes of texts linked by J_P >= 0.8.

    class_id is the smallest doc_id of the class; the row that has it is kept. Equal texts have
    similarity 1, empty ones too. A null text links with nothing: its class is its own row, which is
    kept. Rows that repeat a doc_id with other text get classes by text; of several rows that are
    equal in doc_id and text, which are one document, each says the same. A null doc_id is larger
    than any other. Texts of fewer than five words have one shingle, of all words; texts without a
    word equal only themselves. Other columns are not read.

    Copies of a text are one node. In every band bucket all texts are compared with one leader, that
    whose buckets are largest in sum, which is near the middle of a group of near copies. Then every
    text outside a bucket's largest component is compared with all texts of the bucket, by a sharper
    signature and in blocks past which the bucket streams; pairs that agree are verified on the spot,
    and only links that join components are emitted. So no candidate pair between different classes
    is left out however large a bucket is, and rows never grow with the square of a group.
    """
    base = docs.select("doc_id", "text").where("text is not null")
    keyed = base.select("doc_id", F.unhex(F.md5(F.col("text"))).alias("k"), "text")
    signed = keyed.mapInArrow(shared.tidy(_sign), f"doc_id {dict(base.dtypes)['doc_id']}, k binary, bands array<bigint>, low binary, chars bigint")
    signed = shared.cut(signed.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("low").alias("low"), F.first("chars").alias("chars")), "near-signed")

    spread = signed.select("k", "chars", F.explode("bands").alias("bucket"))
    size = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # Back to one row a text, of BANDS buckets at most, for the sum of their sizes.
    own = spread.join(size, "bucket").groupBy("k").agg(F.sum("n").alias("near"), F.first("chars").alias("chars"), F.collect_list("bucket").alias("buckets"))
    member = shared.cut(own.select("k", "near", "chars", F.explode("buckets").alias("bucket")), "near-member")
    head = member.groupBy("bucket").agg(F.max(F.struct("near", "k")).alias("head")).select("bucket", F.col("head.k").alias("a"))
    pairs = member.join(head, "bucket").where("k != a").select("a", F.col("k").alias("b")).distinct()
    links = shared.cut(_verified(_likely(pairs, signed), signed, keyed), "near-links")
    root = shared.components(links)
    more = shared.cut(_rest(member, root, signed, keyed), "near-more")
    if not more.isEmpty():
        root = shared.components(links.unionAll(more))

    named = signed.select("k", "doc_id").join(root.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    # A table of its own, so that the join has an exchange on either side, whose hot classes can be split.
    least = shared.cut(named.groupBy("root").agg(F.min("doc_id").alias("class_id")), "near-least")
    named = shared.cut(named.join(least, "root").select("k", "class_id"), "near-classes")
    out = docs.select("doc_id", F.unhex(F.md5(F.col("text"))).alias("k")).join(named, "k", "left")
    own = F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", own.alias("class_id"), (F.col("k").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"), "k")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) per row of docs; see _classes for every case."""
    return _classes(docs).drop("k")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that classes() keeps, one of each class, with all their columns.

    Rows that repeat a kept document in doc_id and text are one document: one of them stays. Nulls,
    empty and very long texts, ties and empty tables are as in _classes(); columns of any name stay as
    they are. Only rows that may go are moved.
    """
    by = _classes(docs).groupBy("doc_id", "k").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    told = shared.cut(by.where("not kept or n > 1").select(F.col("doc_id").alias("id"), F.col("k").alias("id_k"), "kept"), "near-gone")
    # The document is one value here, so that none of its names meets those of the join.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("id"), F.unhex(F.md5(F.col("row.text"))).alias("id_k"))
    stay, maybe = shared.apart(rows, told, "id", "id_k")
    told = told.withColumnsRenamed({"id": "of", "id_k": "of_k"})
    maybe = maybe.join(told, F.col("id").eqNullSafe(F.col("of")) & F.col("id_k").eqNullSafe(F.col("of_k")), "left")
    alone, again = maybe.where("kept is null"), maybe.where("kept").dropDuplicates(["id", "id_k"])
    return stay.select("row.*").unionAll(alone.select("row.*")).unionAll(again.select("row.*"))
