import hashlib
import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from framestride.llm import fingerprints


def shingle_set(text):
    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got):
    """rows in falling order of doc_id; got by doc_id."""
    off = []
    for i, (d, t) in enumerate(rows):
        r, following = got[d], rows[(i + 1) % len(rows)][1] or ""
        t = t or ""
        new = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        off += [r["near_edited"] - jaccard(t, new), r["near_next"] - jaccard(t, following)]
    return np.array(off)


def test_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    found = []
    for run in (1 << 20, 5000):
        monkeypatch.setattr(fingerprints, "RUN", run)
        got = {r["doc_id"]: r for r in fingerprints.neighbours(docs).collect()}
        off = check(rows, got)
        assert abs(off.mean()) < 0.01 and np.abs(off).max() < 0.2 and off.std() < 0.03
        found.append({d: (r["fingerprint"], r["edited_fingerprint"]) for d, r in got.items()})
    assert found[0] == found[1]


def test_likeness_is_not_biased_by_chance():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 400)) for _ in range(60)]
    prints, has = fingerprints.fingerprints(texts)
    assert prints.shape == (60, fingerprints.BINS * fingerprints.BITS // 8) and has.all()
    assert fingerprints.likeness(prints[:30], prints[30:], ~has[:30], ~has[30:]).mean() < 0.02
    assert (fingerprints.likeness(prints, prints, ~has, ~has) == 1).all()


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_hot_ids_and_strings(spark, monkeypatch, kind):
    """One id, and null, with a third of the rows each: runs part their rows by the texts' hashes."""
    monkeypatch.setattr(fingerprints, "RUN", 400)
    ids = [7] * 60 + [None] * 60 + list(range(100, 160))
    ids = [None if i is None else i if kind == "bigint" else f"document-{i:012d}" for i in ids]
    docs = spark.createDataFrame([(i, f"text of {n} " * 3) for n, i in enumerate(ids)], f"doc_id {kind}, text string")
    rows = docs.withColumn("h", F.xxhash64("text")).collect()
    low = -1 if kind == "bigint" else ""
    rows.sort(key=lambda r: (low if r["doc_id"] is None else r["doc_id"], r["h"]), reverse=True)
    want = set()
    for a, b in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(a["text"]) // 3
        want.add((a["doc_id"], hashlib.sha256((a["text"][: len(a["text"]) - n] + b["text"][:n]).encode()).hexdigest()))
    assert {(r["doc_id"], r["edited_sha256"]) for r in fingerprints.neighbours(docs).collect()} == want


def test_edge_cases(spark):
    long = "so many words here " * 100_000
    rows = [(9, long), (8, long), (7, None), (6, ""), (5, "..."), (4, "one"), (3, "one"), (2, "é" * 10), (None, "no id")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, run int")
    got = fingerprints.neighbours(docs)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[9]["fingerprint"] == by[8]["fingerprint"] and by[9]["near_next"] == 1 and by[4]["fingerprint"] == by[3]["fingerprint"]
    assert by[7]["n_chars"] == 0 and by[7]["near_next"] == 1 and by[6]["near_next"] == 1 and by[5]["near_next"] == 0
    assert by[2]["edited_sha256"] == hashlib.sha256(("é" * 7 + "no ").encode()).hexdigest()
    check([(d, t) for d, t in rows], by)
    one = fingerprints.neighbours(docs.where("doc_id = 4")).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"ono").hexdigest()
    twice = fingerprints.neighbours(docs.where("doc_id = 4").unionAll(docs.where("doc_id = 4"))).collect()
    assert len(twice) == 2 and fingerprints.neighbours(docs.limit(0)).count() == 0
