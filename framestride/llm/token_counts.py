"""Token counts: rollups by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes (inserts, deletes, revised counts) is reduced to one signed row per key and added
to the totals. Each commit writes a whole new version of the totals with the batch's name, in a
folder of its own, and then publishes it by an atomic rename of a small pointer file. Every batch
that has been published has a mark of its own name, so that it is not applied again, at the same
cost however many there are; files of a failed commit are never read, and those of versions before
the last two are removed. Totals are additive, so they depend on neither the order of batches nor
their size. The folder must be on a file system whose renames are atomic, as HDFS's and local ones are.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, shared, shingles

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens"]
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


class Rollup:
    """Totals below a folder; open the same folder again to go on.

    Null sources and languages are keys of their own. Keys whose documents and tokens have come to
    nothing leave the totals. One writer at a time: of two that commit at once, one fails at the rename.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def _names(self, prefix: str) -> list[str]:
        return sorted(n for x in self.fs.listStatus(self._path()) if (n := x.getPath().getName()).startswith(prefix))

    def _read(self, name: str) -> dict:
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.folder}/{name}").collect()))

    def _state(self) -> dict:
        """The last published version: its table's folder, and its batch."""
        versions = self._names("version-")
        return self._read(versions[-1]) if versions else {"version": 0, "table": None, "batch": None}

    def totals(self) -> DataFrame:
        state = self._state()
        if not state["table"]:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{state['table']}/totals").where("docs != 0 or tokens != 0")

    def _mark(self, batch: str):
        name = hashlib.sha256(batch.encode()).hexdigest()
        return self._path("batches", name[:2], name)

    def committed(self, batch: str, state: dict | None = None) -> bool:
        """Whether a published version is of this batch: its mark is there, or it is the last one, whose mark may be missing."""
        return (state or self._state())["batch"] == batch or self.fs.exists(self._mark(batch))

    def _tidy(self, state: dict) -> None:
        """Remove what is older than the version before this one, and drafts: only a commit that failed left any."""
        old = [(n, self._read(n)["table"]) for n in self._names("version-")[:-2]]
        for name in [x for pair in old for x in pair] + self._names("draft-"):
            self.fs.delete(self._path(name), True)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes (source, lang, tokenizer, docs, tokens), signed; False if it was already.

        Null counts are 0. An empty batch is committed too.
        """
        state = self._state()
        if self.committed(batch, state):
            return False
        if state["batch"] is not None:
            # A commit may have died between its publication and its mark; the next one makes up for it.
            self.fs.create(self._mark(state["batch"]), True).close()
        # A hot key is summed within each task before it is shuffled.
        delta = changes.select(*KEYS, *(F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in SUMS))
        if state["table"]:
            delta = delta.unionAll(self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{state['table']}/totals"))
        table = f"table-{uuid.uuid4().hex}"
        delta.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).write.parquet(f"{self.folder}/{table}/totals")
        new = {"version": state["version"] + 1, "table": table, "batch": batch}
        draft, name = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"version-{new['version']:012d}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self.fs.exists(name) or not self.fs.rename(draft, name):
            raise RuntimeError(f"version {new['version']} was published by another writer")
        self.fs.create(self._mark(batch), True).close()
        self._tidy(new)
        return True


def counted(docs: DataFrame, tokenizer: str, path: str, pattern: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens) per row of docs (doc_id, text, lang, source).

    A null or empty text has no tokens; a very long one is counted whole, and special tokens' strings
    are ordinary text. Rows that repeat one another, or an id, are counted each; null ids, sources and
    languages stay null. Other columns are not read, whatever their names; no documents give no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.tokenizer(path, pattern)[0]
        for part in parts:
            texts = part.column("text").to_pylist()
            n = [len(enc.encode_ordinary(t or "")) for a, b in shingles.batches(texts) for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "tokenizer", "tokens"])

    return docs.select("doc_id", "text", "source", "lang").mapInArrow(run, f"doc_id {kind}, source string, lang string, tokenizer string, tokens bigint")


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).alias("docs"), "tokens")


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The signed changes from old counts to new ones; both may move documents between keys."""
    return deletes(old).unionAll(inserts(new))


def maintained(docs: DataFrame, versions: list[tuple[str, str]], pattern: str) -> DataFrame:
    """Totals of docs after a life of batches, from the last tokenizer of versions (name, path).

    Every document is inserted with the first tokenizer's count; then each further tokenizer revises
    all counts, and each batch is sent twice, as after a lost acknowledgement. Nulls, empty and very
    long texts, repeated rows and other columns are as in counted(); null sources and languages are
    keys of their own; there are no ties to break, and no documents give no totals.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, shared.scratch(spark, "rollup"))
    old = None
    for name, path in versions:
        new = shared.cut(counted(docs, name, path, pattern), "token-counts")
        batch = inserts(new) if old is None else revised(old, new)
        for _ in range(2):
            rollup.apply(f"tokenizer {name}", batch)
        old = new
    return rollup.totals()
