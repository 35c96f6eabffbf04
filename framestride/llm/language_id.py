"""Language ID by Bayesian fusion of text, declared markup language, address suffix and host priors.

Text: log-likelihoods of hashed byte trigrams of lower-case letters under one multinomial per
language, fitted on a bounded sample of the labelled rows of every language, tempered because neighbouring trigrams are
not independent. Declared language and address suffix: P(value | language), estimated over the whole
corpus from what the texts alone say. Host: counts of text-only decisions by grouped aggregation,
smoothed from host to domain to corpus, without the row's own count. A row's posterior is the product of all
that it has. A text is unknown if even its best language makes it nearly as unlikely as random
trigrams, measured against held-out texts; rows that are unknown or have no evidence are rejected.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, shingles

#: Labelled rows that the text model is fitted on, at most, and how many characters of each are read.
SAMPLE, LONGEST = 3000, 20_000
BUCKETS = 1 << 16
TEMPER = 0.1
#: How far a text's mean may be on the way from held-out texts' median to random trigrams' before it is unknown.
STRANGE = 0.6
#: Pseudo-counts that the next wider level of a host prior weighs.
SMOOTH = 5.0
#: Least posterior of a decision.
SURE = 0.5
#: Hosts up to this number are broadcast (below 10 MB); more are joined by shuffle.
SMALL = 50_000
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
for _b in (*range(97, 123), *range(128, 256)):
    _FOLD[_b] = _b
    if _b < 128:
        _FOLD[_b - 32] = _b
_MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def strip_markup(page: str) -> str:
    return html.unescape(_MARKUP.sub(" ", page))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): hashed trigrams of each text that have no two spaces in a row."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    raw = _FOLD[np.frombuffer(b"  ".join(parts) + b"  ", np.uint8)]
    space = raw == 32
    code = raw.astype(np.uint32)
    index = ((code[:-2] * np.uint32(2654435761)) ^ (code[1:-1] * np.uint32(40503 * 65537)) ^ (code[2:] * np.uint32(0x85EBCA6B))) >> np.uint32(16)
    use = ~((space[:-2] & space[1:-1]) | (space[1:-1] & space[2:]))
    begin = np.concatenate([[0], np.cumsum([len(p) + 2 for p in parts])])[:-1]
    count = np.concatenate([[0], np.cumsum(use)])
    return index[use], np.append(count[begin], count[-1])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    #: Least mean log-likelihood per trigram of a known text.
    floor: float
    accuracy: float

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood per language, number of trigrams) of each text."""
        total, many = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for a, b in shingles.batches(texts):
            index, at = trigrams(texts[a:b])
            for c in range(0, len(index), shingles.BLOCK):
                part = self.weights[index[c : c + shingles.BLOCK]]
                own = np.clip(at - c, 0, len(part))
                full = np.flatnonzero(np.diff(own))
                total[a + full] += np.add.reduceat(part, own[full], axis=0, dtype=np.float64)
            many[a:b] = np.diff(at)
        return total, many


def train(rows: list[tuple[str, str]]) -> Model:
    """Fit on four fifths of each language's rows; the floor and the accuracy are from the last fifth.

    A language of fewer than 10 rows is fitted on all of them. Without any rows there is one language, 'und', and every row is rejected.
    """
    if not rows:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.inf, 0.0)
    languages = sorted({lang for _, lang in rows})
    size, seen = Counter(lang for _, lang in rows), Counter()
    hold, fit = [], []
    for r in rows:
        (hold if size[r[1]] >= 10 and seen[r[1]] % 5 == 0 else fit).append(r)
        seen[r[1]] += 1
    hold = hold or fit
    count = np.full((BUCKETS, len(languages)), 0.02)
    for j, lang in enumerate(languages):
        texts = [t for t, own in fit if own == lang]
        for a, b in shingles.batches(texts):
            count[:, j] += np.bincount(trigrams(texts[a:b])[0], minlength=BUCKETS)
    model = Model(languages, np.log(count / count.sum(0)).astype(np.float32), -np.inf, 0.0)
    total, many = model.score([t for t, _ in hold])
    known = many >= 20
    mean = total.max(1)[known] / many[known]
    # The floor lies nearer to what trigrams at random would get than to a held-out text of the middle.
    floor = float(np.median(mean) + STRANGE * (model.weights.mean() - np.median(mean))) if len(mean) else -np.inf
    right = np.mean([languages[j] == lang for j, (_, lang) in zip(total.argmax(1), hold, strict=True)]) if hold else 0.0
    return Model(languages, model.weights, floor, float(right))


def sample(labelled: DataFrame, limit: int = SAMPLE) -> list[tuple[str, str]]:
    """At most `limit` rows of labelled (doc_id, text, lang) for train(), and one of each language at least.

    The languages are those of all rows with a text. Each has the same quota, and what small ones leave
    goes to the others. A language's rows are those of least hash, equal ones once, and the first
    LONGEST characters of each. Only the languages and the sample reach the driver.
    """
    rows = labelled.where("lang is not null and length(text) > 0").select(F.xxhash64("doc_id", "text").alias("h"), "text", "lang")
    many = sorted((r["n"], r["lang"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect())
    if not many:
        return []
    plan, left = [], limit
    for i, (n, lang) in enumerate(many):
        quota = max(1, left // (len(many) - i))
        # More pass the threshold than the quota asks for, by more than chance and the estimate of n can take away.
        share = (1.3 * quota + 6 * quota**0.5 + 20) / n
        plan.append((lang, quota, 2**63 - 1 if share >= 1 else int(-(2**63) + 2**64 * share)))
        left -= min(n, quota)
    quotas = labelled.sparkSession.createDataFrame(plan, "lang string, quota int, least bigint")
    rows = rows.join(F.broadcast(quotas), "lang").where("h <= least").groupBy("lang", "quota", "h").agg(F.min(F.substring("text", 1, LONGEST)).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = rows.withColumn("rank", rank).where("rank <= quota").select("h", "text", "lang").collect()
    return [(r["text"], r["lang"]) for r in sorted(picked, key=lambda r: (r["h"], r["text"], r["lang"]))]


def host(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _scores(model: Model, markup: bool):
    def run(texts: pa.Array) -> pa.Array:
        own = [t or "" for t in texts.to_pylist()]
        total, many = model.score([strip_markup(t) for t in own] if markup else own)
        flat = np.concatenate([total, many[:, None].astype(np.float64)], axis=1)
        shared.trim()
        return pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float64()))

    # Not deterministic to Spark, so that no filter on what follows from a score computes it again.
    return F.arrow_udf(run, "array<double>").asNondeterministic()


def _posterior(model: Model, rows: DataFrame) -> DataFrame:
    """rows with text_lang: what the text alone says; null if it says nothing or is unlike all languages."""
    n = len(model.languages)
    best = F.array_max(F.slice("_score", 1, n))
    many = F.element_at("_score", n + 1)
    known = (many > 0) & ((many < 20) | (best / many >= F.lit(model.floor)))
    rows = rows.withColumn("_known", known)
    return rows.withColumn("_text", F.when(known, F.array_position(F.slice("_score", 1, n), best).cast("int")))


_IP = r"^[0-9.]*$|:"


def decide(rows: DataFrame, model: Model, keys: list, text: str = "text", declared=None, url=None, place=None, markup: bool = False) -> DataFrame:
    """(keys.., lang_id, lang_posterior, lang_rejected) per row of rows; keys are named columns.

    declared, url and place (a host, if there is no url) are column expressions or None. Each text is
    scored once, into a table that holds the keys and the evidence alone; texts never move. A numeric
    address has no suffix and is a domain of its own. For all else see identify().
    """
    languages, n = model.languages, len(model.languages)
    where = host(url) if url is not None else (F.lower(place.cast("string")) if place is not None else F.lit(None).cast("string"))
    told = F.lower(F.substring(declared, 1, 2)) if declared is not None else F.lit(None).cast("string")
    rows = rows.select(F.struct(*keys).alias("_row"), F.nullif(where, F.lit("")).alias("_host"), told.alias("_told"), _scores(model, markup)(F.col(text)).alias("_score"))
    numeric = F.col("_host").rlike(_IP)
    suffix = F.when((F.instr("_host", ".") > 0) & ~numeric, F.substring_index("_host", ".", -1)) if url is not None else F.lit(None).cast("string")
    rows = rows.withColumns({"_told": F.when(F.col("_told").isin(languages), F.col("_told")), "_suffix": suffix, "_domain": F.when(numeric, F.col("_host")).otherwise(F.substring_index("_host", ".", -2))})
    rows = _posterior(model, shared.cut(rows, "lang-evidence"))

    # One aggregation over the corpus; what the driver gets is bounded by languages.
    counts = rows.where("_text is not null").groupBy("_host", "_domain", "_suffix", "_told", "_text").agg(F.count("*").alias("n"))
    counts = shared.cut(counts, "lang-counts")
    told = _given(counts, "_told", n)
    total = {r["_text"]: r["n"] for r in counts.groupBy("_text").agg(F.sum("n").alias("n")).collect()}
    corpus = [(total.get(j + 1, 0) + 1.0) / (sum(total.values()) + n) for j in range(n)]

    by = lambda key: counts.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(F.when(F.col("_text") == j + 1, F.col("n")).otherwise(0)).cast("double").alias(f"c{j}") for j in range(n)])
    pack = lambda name: F.array(*[F.col(f"c{j}") for j in range(n)]).alias(name)
    hosts = by("_host").select(F.col("_host").alias("_h"), pack("_hc"))
    domains = by("_domain").select(F.col("_domain").alias("_d"), pack("_dc"))
    small = lambda t: F.broadcast(t) if t.limit(SMALL + 1).count() <= SMALL else t
    # Rows without a host are dealt out by a name that no host has.
    spread = lambda c: F.coalesce(F.col(c), F.concat(F.lit(" "), F.pmod(F.xxhash64("_row"), F.lit(9973)).cast("string")))
    rows = rows.join(small(hosts), spread("_host") == F.col("_h"), "left").join(small(domains), spread("_domain") == F.col("_d"), "left")
    if url is not None:
        # log P(suffix | language) as in _given(), for every suffix there is.
        tails = by("_suffix")
        size = tails.agg(F.count("*"), *[F.sum(f"c{j}") for j in range(n)]).first()
        given = F.array(*[F.ln((F.col(f"c{j}") + 1.0) / F.lit(float((size[j + 1] or 0) + size[0]))) for j in range(n)])
        rows = rows.join(small(tails.select(F.col("_suffix").alias("_s"), given.alias("_tail"))), F.col("_suffix") == F.col("_s"), "left")
    else:
        rows = rows.withColumn("_tail", F.lit(None).cast("array<double>"))

    none = F.array(*[F.lit(0.0)] * n)
    own = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.when(F.col("_text") == j, 1.0).otherwise(0.0))
    base = F.array(*map(F.lit, corpus))

    def smooth(counted, prior):
        rest = F.zip_with(F.coalesce(counted, none), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
        all_ = F.aggregate(rest, F.lit(0.0), lambda s, x: s + x) + F.lit(SMOOTH)
        return F.zip_with(rest, prior, lambda a, p: (a + F.lit(SMOOTH) * p) / all_)

    log = lambda table, column: F.coalesce(F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col(column)), none) if table else none
    rows = rows.withColumn("_domain_prior", F.when(F.col("_d").isNotNull(), smooth(F.col("_dc"), base)).otherwise(base))
    rows = rows.withColumn("_prior", F.when(F.col("_h").isNotNull(), smooth(F.col("_hc"), F.col("_domain_prior"))).otherwise(F.col("_domain_prior")))
    text_log = F.when(F.col("_known"), F.transform(F.slice("_score", 1, n), lambda x: x * TEMPER)).otherwise(none)
    sum_ = F.zip_with(F.zip_with(text_log, F.transform("_prior", lambda p: F.ln(p)), lambda a, b: a + b), F.zip_with(log(told, "_told"), F.coalesce("_tail", none), lambda a, b: a + b), lambda a, b: a + b)
    rows = rows.withColumn("_sum", sum_).withColumn("_top", F.array_max("_sum"))
    rows = rows.withColumn("_sure", 1.0 / F.aggregate(F.transform("_sum", lambda x: F.exp(x - F.col("_top"))), F.lit(0.0), lambda s, x: s + x))
    strange = (F.element_at("_score", n + 1) > 0) & ~F.col("_known")
    evidence = F.col("_known") | F.col("_told").isNotNull() | F.col("_h").isNotNull()
    if url is None and place is not None:
        # A source is a hint for a text, not in place of one.
        evidence = F.col("_known") | F.col("_told").isNotNull()
    rejected = strange | ~evidence | (F.col("_sure") < SURE) | F.lit(languages == [UNKNOWN])
    name = F.element_at(F.array(*map(F.lit, languages)), F.array_position("_sum", F.col("_top")).cast("int"))
    return rows.select("_row.*", F.when(rejected, F.lit(UNKNOWN)).otherwise(name).alias("lang_id"), F.when(rejected, F.lit(0.0)).otherwise(F.col("_sure")).alias("lang_posterior"), rejected.alias("lang_rejected"))


def _key(*columns):
    """128 bits that tell rows apart by some columns, nulls included."""
    return F.unhex(F.md5(F.concat_ws(",", *(F.coalesce(F.md5(c.cast("string").cast("binary")), F.lit("null")) for c in columns))))


def identify(rows: DataFrame, model: Model, text: str = "text", declared=None, url=None, place=None, markup: bool = False) -> DataFrame:
    """rows with columns lang_id, lang_posterior and lang_rejected, which replace any of these names.

    declared, url and place (a host, if there is no url) are column expressions or None. lang_id is
    'und' for a rejected row. A null or empty text is no evidence, and neither is a null, empty or
    unknown declared language, suffix or host; a row without any evidence is rejected, as is one whose
    text is long enough to judge and unlike every language. Very long texts are scored in pieces, as a
    whole. Ties go to the language that comes first in the alphabet. Every row is decided on its own,
    so repeated rows and ids do not matter; an empty table gives none.
    """
    keep = [c for c in rows.columns if c not in ("lang_id", "lang_posterior", "lang_rejected")]
    k = _key(*(c for c in (F.col(text), declared, url, place) if c is not None))
    done = decide(rows, model, [k.alias("of")], text, declared, url, place, markup).groupBy("of").agg(*(F.first(c).alias(c) for c in ("lang_id", "lang_posterior", "lang_rejected")))
    # The row is one value here, so that none of its names meets those of the join.
    whole = rows.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), k.alias("k")).join(done, F.col("k") == F.col("of"))
    return whole.select(*(F.col("row")[c].alias(c) for c in keep), "lang_id", "lang_posterior", "lang_rejected")


def _given(counts: DataFrame, column: str, n: int) -> dict[str, list[float]]:
    """log P(value | language) of a column's values, each smoothed by one count spread over the languages' values."""
    got = counts.where(F.col(column).isNotNull()).groupBy(column, "_text").agg(F.sum("n").alias("n")).collect()
    values = sorted({r[column] for r in got})
    of = {(r[column], r["_text"]): r["n"] for r in got}
    size = [sum(of.get((v, j + 1), 0) for v in values) for j in range(n)]
    return {v: [float(np.log((of.get((v, j + 1), 0) + 1.0) / (size[j] + len(values)))) for j in range(n)] for v in values}


def declared_language(page):
    """The lang attribute of a page's html element."""
    return F.regexp_extract(page, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2})", 1)


def pages(page_rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """(page_id, lang_id, lang_posterior, lang_rejected) for page_rows (page_id, url, html), with a model of labelled (doc_id, text, lang).

    Nulls, empty and very long pages, ties, repeated rows and empty tables are as in identify(). A
    null or empty html is a page without text, and one without a lang attribute declares nothing.
    Other columns are not read, whatever their names. Without labelled rows every page is rejected.
    """
    model = train(sample(labelled))
    return decide(page_rows, model, [F.col("page_id")], "html", declared_language(F.col("html")), F.col("url"), markup=True)


def documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """identify() for docs (doc_id, text, lang, source), whose lang labels the sample and whose source is their host."""
    model = train(sample(labelled if labelled is not None else docs))
    return identify(docs, model, "text", place=F.col("source"))


def known(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of docs that documents() does not reject, with their own columns, whatever their names.

    A row with a null or empty text is no evidence of a language, so it goes. Rows that repeat one
    another stay or go together; an empty table stays empty. Only rows that may go are moved.
    """
    model = train(sample(labelled if labelled is not None else docs))
    k = _key(F.col("text"), F.col("source"))
    gone = shared.cut(decide(docs, model, [k.alias("k")], place=F.col("source")).where("lang_rejected").select("k").distinct(), "lang-rejected")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), k.alias("k"))
    stay, maybe = shared.apart(rows, gone, "k")
    return stay.unionAll(maybe.join(gone, "k", "left_anti").select("row", "k")).select("row.*")
