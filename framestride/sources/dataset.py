"""Reading a dataset: metadata relations, pruned frame scans, video routes and their cache.

Routes stay DataFrames. The driver holds the parsed info document, the list of data and video files
(one entry a file) and the results of one validating aggregation a component, and keeps them per
root until info.json changes or a refresh is asked for.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DatasetError
from ..scratch import ranked
from . import info as meta
from . import paths

#: Readers of table formats by storage name: (spark, path) -> DataFrame. Empty unless an application adds one.
TABLE_SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The setting of how many tasks, at most, look up the files of a reader.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
TASKS = T.StructType([T.StructField("task_index", T.LongType()), T.StructField("task", T.StringType())])
STATS = T.StructType([T.StructField("feature", T.StringType()), T.StructField("stats", T.StringType())])


@dataclass
class _Files:
    spark: SparkSession

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def text(self, path: str) -> str:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise DatasetError(f"no file '{path}'")
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def sign(self, path: str) -> tuple[int, int] | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        s = fs.getFileStatus(p)
        return s.getLen(), s.getModificationTime()

    def below(self, path: str, suffix: str) -> list[str]:
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        out, found = [], fs.listFiles(p, True)
        while found.hasNext():
            name = found.next().getPath().toString()
            if name.endswith(suffix):
                out.append(name)
        return sorted(out)


@dataclass
class _Entry:
    sign: tuple[int, int]
    info: meta.Info
    data: dict[tuple[int, int], str] | None = None
    video: dict[tuple[str, int, int], str] | None = None


_cache: dict[str, _Entry] = {}


def canonical(values: Iterable | None, what: str, whole: bool = True) -> list:
    """A list argument, sorted and without repeats; null, null members and bad members are errors."""
    if values is None:
        raise DatasetError(f"{what} must not be NULL")
    out = list(values)
    if any(v is None for v in out):
        raise DatasetError(f"{what} must not contain NULL")
    if whole:
        out = [int(v) for v in out]
        if any(v < 0 for v in out):
            raise DatasetError("episode indices must be non-negative" if what == "episode_indices" else f"{what} must be non-negative")
    elif any(v == "" for v in out):
        raise DatasetError(f"{what} must not contain an empty key")
    return sorted(set(out))


def _flag(value: bool | None, what: str) -> bool:
    if value is None:
        raise DatasetError(f"{what} must not be NULL")
    return bool(value)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def any_of(column: Column, values: list) -> Column:
    return column.isin(values) if values else F.lit(False)


def binary_as_string(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.BinaryType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(binary_as_string(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(binary_as_string(kind.keyType), binary_as_string(kind.valueType), kind.valueContainsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, binary_as_string(f.dataType), f.nullable) for f in kind])
    return kind


@dataclass
class Dataset:
    """A dataset below a root; opening it reads nothing."""

    spark: SparkSession
    root: str
    search_path: list[str] | str | None = None
    files: _Files = field(init=False, repr=False)

    def __post_init__(self):
        self.root = paths.normal_root(self.root)
        self.files = _Files(self.spark)

    @property
    def place(self) -> str:
        return paths.resolve_root(self.root, self.search_path)

    # Metadata and cache

    def _fresh(self, refresh: bool | None) -> None:
        if _flag(refresh, "refresh"):
            _cache.pop(self.place, None)

    def _entry(self) -> _Entry:
        """The cached entry of the root, or a new one that is not yet kept."""
        place = self.place
        sign = self.files.sign(f"{place}/meta/info.json")
        if sign is None:
            raise DatasetError(f"no dataset at '{place}': meta/info.json is missing")
        held = _cache.get(place)
        return held if held and held.sign == sign else _Entry(sign, self.meta())

    def meta(self) -> meta.Info:
        return meta.parse(self.files.text(f"{self.place}/meta/info.json"))

    def cache_info(self) -> DataFrame:
        """(root, component, cached, entries, bytes) of the data and the video component; reads no storage."""
        held = _cache.get(self.place)
        rows = []
        for name, kept in (("data", held.data if held else None), ("video", held.video if held else None)):
            rows.append((self.root, name, kept is not None, int(kept is not None), sum(200 + len(p) for p in kept.values()) + 1 if kept is not None else 0))
        return self.spark.createDataFrame(rows, "root string, component string, cached boolean, entries bigint, bytes bigint")

    # Relations

    def info(self, *, refresh: bool = False) -> DataFrame:
        """The info document as one row, not validated."""
        self._fresh(refresh)
        return self.spark.read.option("multiLine", True).json(f"{self.place}/meta/info.json")

    def _parquet(self, files: list[str], union_by_name: bool, as_string: bool, filename: bool | str, row_number: bool) -> DataFrame:
        for value, what in ((union_by_name, "union_by_name"), (as_string, "binary_as_string"), (filename, "filename"), (row_number, "file_row_number")):
            if value is None:
                raise DatasetError(f"{what} must not be NULL")
        schema = self._listed(self.spark.read.option("mergeSchema", bool(union_by_name)), files if union_by_name else files[:1]).schema
        return self._dress(self._listed(self.spark.read.schema(schema), files), as_string, filename, row_number, True)

    def _listed(self, reader: DataFrameReader, files: list[str]) -> DataFrame:
        """The files, whose states are looked up by no more tasks than a shuffle has: else by one a file, which the driver keeps a record of."""
        before = int(self.spark.conf.get(LISTING))
        self.spark.conf.set(LISTING, min(before, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)))
        try:
            return reader.parquet(*files)
        finally:
            self.spark.conf.set(LISTING, before)

    def _dress(self, df: DataFrame, as_string: bool, filename: bool | str, row_number: bool, stored: bool) -> DataFrame:
        own = [f.name for f in df.schema]
        out = [col(f.name).cast(binary_as_string(f.dataType)).alias(f.name) if as_string else col(f.name) for f in df.schema]
        extra = []
        if filename:
            path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))) if stored else F.lit(None).cast("string")
            extra.append(("filename" if filename is True else str(filename), F.regexp_replace(path, "^file:/+", "/")))
        if row_number:
            extra.append(("file_row_number", F.col("_metadata.row_index") if stored else F.lit(None).cast("bigint")))
        for name, _ in extra:
            if name.lower() in map(str.lower, own):
                raise DatasetError(f"option adds column '{name}', which the files already have")
        return df.select(*out, *(c.alias(n) for n, c in extra))

    def _empty(self, schema: T.StructType, union_by_name, as_string, filename, row_number) -> DataFrame:
        for value, what in ((union_by_name, "union_by_name"), (as_string, "binary_as_string"), (filename, "filename"), (row_number, "file_row_number")):
            if value is None:
                raise DatasetError(f"{what} must not be NULL")
        return self._dress(self.spark.createDataFrame([], schema), as_string, filename, row_number, False)

    def _episode_files(self) -> list[str]:
        found = self.files.below(f"{self.place}/meta/episodes", ".parquet")
        if not found:
            raise DatasetError(f"no episode metadata at '{self.place}/meta/episodes'")
        return found

    def episodes(self, *, refresh: bool = False, union_by_name: bool = False, binary_as_string: bool = False, filename: bool | str = False, file_row_number: bool = False) -> DataFrame:
        self._fresh(refresh)
        info = self.meta()
        if not info.episodes:
            return self._empty(info.episode_schema(), union_by_name, binary_as_string, filename, file_row_number)
        return self._parquet(self._episode_files(), union_by_name, binary_as_string, filename, file_row_number)

    def tasks(self, *, refresh: bool = False) -> DataFrame:
        self._fresh(refresh)
        if not self.meta().tasks:
            return self.spark.createDataFrame([], TASKS)
        return self.spark.read.parquet(f"{self.place}/meta/tasks.parquet")

    def stats(self, *, refresh: bool = False) -> DataFrame:
        """(feature, stats) with the statistics as JSON text, whose numbers keep their digits."""
        self._fresh(refresh)
        if not self.meta().episodes:
            return self.spark.createDataFrame([], STATS)
        told = self.spark.read.option("wholetext", True).text(f"{self.place}/meta/stats.json")
        return self.spark.sql("SELECT v.key AS feature, to_json(v.value) AS stats FROM {told}, LATERAL variant_explode(parse_json(value)) v", told=told)

    # Routes

    def routes(self) -> DataFrame:
        """(episode_index, length, chunk_index, file_index) per episode; checked when the data component loads."""
        df = self._listed(self.spark.read, self._episode_files())
        return df.select(*(col(a).cast("bigint").alias(b) for a, b in (("episode_index", "episode_index"), ("length", "length"), ("data/chunk_index", "chunk_index"), ("data/file_index", "file_index"))))

    def data_files(self) -> dict[tuple[int, int], str]:
        """The authoritative data file of each (chunk, file) that an episode names. Validates the episodes."""
        entry = self._entry()
        if entry.data is None:
            entry.data = self._load_data(entry.info)
            _cache[self.place] = entry
        return entry.data

    def _load_data(self, info: meta.Info) -> dict[tuple[int, int], str]:
        if not info.episodes:
            return {}
        routes = self.routes()
        null = F.greatest(*(F.col(c).isNull().cast("int") for c in routes.columns))
        found = routes.agg(
            F.max(null).alias("null"), F.min("episode_index").alias("least"), F.min("length").alias("shortest"), F.count("*").alias("rows"),
            F.sum(F.col("length").cast("decimal(38,0)")).alias("frames"), F.min("chunk_index").alias("chunk"), F.min("file_index").alias("file"),
        ).first()
        if found["null"]:
            raise DatasetError("episode routing columns must not contain NULL")
        if found["least"] < 0:
            raise DatasetError("episode indices must be non-negative")
        if found["shortest"] <= 0:
            raise DatasetError("episode length must be positive")
        if twice := routes.groupBy("episode_index").count().where("count > 1").first():
            raise DatasetError(f"Duplicate episode_index {twice['episode_index']} in episode metadata")
        if found["rows"] != info.episodes:
            raise DatasetError(f"info.json declares {info.episodes} episodes, but episode metadata contains {found['rows']} rows")
        if int(found["frames"]) != info.frames:
            raise DatasetError(f"info.json declares {info.frames} frames, but episode metadata contains {found['frames']} frames")
        if info.in_table:
            return {(0, 0): f"{self.place}/frames.{info.storage}"}
        names = routes.select("chunk_index", "file_index").distinct().orderBy("chunk_index", "file_index").collect()  # one row a file
        return {(r[0], r[1]): paths.locate(self.place, info.data_path, r[0], r[1]) for r in names}

    def _video_rows(self, info: meta.Info) -> DataFrame:
        """(episode_index, length, video_key, chunk_index, file_index, from_timestamp, to_timestamp): wide to long, before checks."""
        df = self._listed(self.spark.read, self._episode_files())
        kinds = (("chunk_index", "bigint"), ("file_index", "bigint"), ("from_timestamp", "double"), ("to_timestamp", "double"))
        routes = F.array(*(F.struct(F.lit(f.name).alias("video_key"), *(col(f"videos/{f.name}/{c}").cast(t).alias(c) for c, t in kinds)) for f in info.videos))
        long = df.select(col("episode_index").cast("bigint").alias("episode_index"), col("length").cast("bigint").alias("length"), F.explode(routes).alias("r"))
        return long.select("episode_index", "length", "r.*")

    def video_files(self) -> dict[tuple[str, int, int], str]:
        """The media file of each (key, chunk, file) that a route names. Validates all video routes."""
        self.data_files()
        entry = self._entry()
        if entry.video is None:
            entry.video = self._load_video(entry.info)
            _cache[self.place] = entry
        return entry.video

    def _load_video(self, info: meta.Info) -> dict[tuple[str, int, int], str]:
        if not info.episodes or not info.videos:
            return {}
        if info.in_table:
            raise DatasetError(f"videos of a '{info.storage}' dataset need a table source")
        rows = self._video_rows(info)
        four = ("chunk_index", "file_index", "from_timestamp", "to_timestamp")
        nulls = sum((F.col(c).isNull().cast("int") for c in four), F.lit(0))
        where = F.concat(F.lit(" for episode "), "episode_index", F.lit(" and key '"), "video_key", F.lit("'"))
        fine = lambda c: ~F.isnan(c) & (F.abs(c) < math.inf)
        problem = (
            F.when(nulls == 4, None).when(nulls > 0, F.concat(F.lit("video route"), where, F.lit(" is partially NULL")))
            .when((F.col("chunk_index") < 0) | (F.col("file_index") < 0), F.lit("video chunk and file indices must be non-negative"))
            .when(~(fine("from_timestamp") & fine("to_timestamp") & (F.col("from_timestamp") >= 0) & (F.col("to_timestamp") >= F.col("from_timestamp"))), F.concat(F.lit("Invalid video timestamp range"), where))
        )
        if bad := rows.select(problem.alias("p")).where("p is not null").first():
            raise DatasetError(bad["p"])
        there = rows.where("chunk_index is not null")
        if twice := there.groupBy("episode_index", "video_key").count().where("count > 1").first():
            raise DatasetError(f"Duplicate video route for episode {twice['episode_index']} and key '{twice['video_key']}'")
        out: dict[tuple[str, int, int], str] = {}
        owner: dict[str, str] = {}
        for key, chunk, file in there.select("video_key", "chunk_index", "file_index").distinct().orderBy("video_key", "chunk_index", "file_index").collect():  # one row a file
            path = paths.locate(self.place, info.video_path, chunk, file, key, "video_path")
            if owner.setdefault(path, key) != key:
                raise DatasetError(f"video path '{path}' is shared by feature keys '{owner[path]}' and '{key}'")
            out[(key, chunk, file)] = path
        return out

    def video_route_table(self, video_keys: list[str] | None = None) -> DataFrame:
        """All routes: (episode_index, length, video_key, video_path, chunk_index, file_index, from_timestamp, to_timestamp, fps)."""
        info = self.meta()
        self.video_files()
        keys = [f.name for f in info.videos] if video_keys is None else video_keys
        for k in keys:
            info.video(k)
        if not info.episodes or not info.videos:
            return self.spark.createDataFrame([], "episode_index bigint, length bigint, video_key string, video_path string, chunk_index bigint, file_index bigint, from_timestamp double, to_timestamp double, fps bigint")
        rows = self._video_rows(info).where(F.col("chunk_index").isNotNull() & any_of(F.col("video_key"), keys))
        path = F.concat(F.lit(f"{self.place}/"), paths.expand_column(info.video_path, F.col("chunk_index"), F.col("file_index"), F.col("video_key"), "video_path"))
        return rows.select("episode_index", "length", "video_key", path.alias("video_path"), "chunk_index", "file_index", "from_timestamp", "to_timestamp", F.lit(info.fps).cast("bigint").alias("fps"))

    def video_routes(self, episode_indices: Iterable[int], *, video_keys: Iterable[str] | None = None, refresh: bool = False) -> DataFrame:
        """Where each requested episode's cameras are, by episode and key; unknown episodes are left out."""
        episodes = canonical(episode_indices, "episode_indices")
        self._fresh(refresh)
        keys = None if video_keys is None else canonical(video_keys, "video_keys", whole=False)
        rows = self.video_route_table(keys).where(any_of(F.col("episode_index"), episodes)).drop("length")
        return rows.orderBy("episode_index", "video_key")

    # Frames

    def scan(self, episode_indices: Iterable[int] | None = None, *, refresh: bool = False, union_by_name: bool = False, binary_as_string: bool = False, filename: bool | str = False, file_row_number: bool = False) -> DataFrame:
        """The frames of all or of the requested episodes, from the data files that hold them alone."""
        wanted = None if episode_indices is None else canonical(episode_indices, "episode_indices")
        self._fresh(refresh)
        info, options = self.meta(), (union_by_name, binary_as_string, filename, file_row_number)
        if not info.episodes:
            df = self._empty(info.frame_schema(), *options)
            return df
        files = self.data_files()
        if info.in_table:
            if any(options):
                raise DatasetError(f"Parquet options do not apply to a '{info.storage}' dataset")
            df = self._table_frames(info, files[(0, 0)])
            return df if wanted is None else df.where(any_of(col("episode_index"), wanted))
        chosen = sorted(files.values())
        if wanted is not None:
            named = self.routes().where(any_of(F.col("episode_index"), wanted)).select("chunk_index", "file_index").distinct().collect() if wanted else []
            chosen = sorted({files[(r[0], r[1])] for r in named})
            if not chosen:
                first = sorted(files.values()) if union_by_name else [files[min(files)]]
                return self._parquet(first, *options).where(F.lit(False))
        df = self._parquet(chosen, *options)
        return df if wanted is None else df.where(any_of(col("episode_index"), wanted))

    def _table_frames(self, info: meta.Info, path: str) -> DataFrame:
        read = TABLE_SOURCES.get(info.storage)
        if read is None:
            raise DatasetError(f"storage format '{info.storage}' needs a table source, and none is registered for it")
        df = read(self.spark, path)
        if (n := df.count()) != info.frames:
            raise DatasetError(f"info.json declares {info.frames} frames, but the frame table contains {n}")
        names = meta.table_names(info)
        return df.select(*(col(names[f.name]).cast(f.spark_type()).alias(f.name) for f in info.features if f.dtype != "video"))

    def frame_times(self, episode_indices: list[int] | None = None) -> DataFrame:
        """(episode_index, frame_index, timestamp) of all or of some episodes' frames, not yet cast or checked."""
        if not self.meta().episodes:
            return self.spark.createDataFrame([], "episode_index bigint, frame_index bigint, timestamp double")
        return self.scan(episode_indices).select(col("episode_index"), col("frame_index"), col("timestamp"))


def first_seen(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(index, value) of each distinct value, numbered from 0 by where it first comes."""
    at = df.groupBy(value).agg(F.min(F.struct(*order)).alias("at"))
    return ranked(at, ["at"], "first-seen").select(F.col("_rank").alias("task_index"), F.col(value).alias("task"))


def stats_json(stats: dict) -> str:
    return json.dumps(stats, allow_nan=False)
