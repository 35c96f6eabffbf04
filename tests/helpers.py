"""Datasets made of files, for the tests."""

import json
import os
import random
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq


def write(path, columns, types=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    table = pa.table({k: pa.array(v, (types or {}).get(k)) for k, v in columns.items()})
    pq.write_table(table, path)


def info(root, **fields):
    os.makedirs(f"{root}/meta", exist_ok=True)
    told = {"codebase_version": "v3.0", "data_path": "data/file-{file_index:03d}.parquet", "video_path": None, "fps": 10, "total_episodes": 1, "total_frames": 1, "total_tasks": 0, "features": {}}
    with open(f"{root}/meta/info.json", "w") as f:
        json.dump(told | fields, f)


@dataclass
class Made:
    """A dataset from a seed, and plain-Python rows of what it holds."""

    root: str
    fps: int
    length: dict = field(default_factory=dict)
    shard: dict = field(default_factory=dict)
    #: (episode, frame, timestamp, value)
    frames: list = field(default_factory=list)
    #: (episode, key) to (chunk, file, from, to)
    routes: dict = field(default_factory=dict)
    tasks: list = field(default_factory=list)

    def path(self, chunk, file):
        return f"{self.root}/rows/{chunk}/n{file:05d}.parquet"

    def episode_columns(self):
        es = list(self.length)
        out = {"episode_index": es, "length": [self.length[e] for e in es], "data/chunk_index": [self.shard[e][0] for e in es], "data/file_index": [self.shard[e][1] for e in es]}
        for key in KEYS:
            for i, c in enumerate(("chunk_index", "file_index", "from_timestamp", "to_timestamp")):
                out[f"videos/{key}/{c}"] = [self.routes.get((e, key), [None] * 4)[i] for e in es]
        return out

    def save_episodes(self, **change):
        write(f"{self.root}/meta/episodes/one.parquet", self.episode_columns() | change)


KEYS = ("left.eye", "rear")


def made(root, seed, gaps=False):
    """Random episodes over shards of two chunks, one with a column of its own; and files that nothing names."""
    rng = random.Random(seed)
    out = Made(str(root), rng.choice([8, 16, 32]))
    ids = sorted(rng.sample(range(40), 7)) if gaps else list(range(7))
    for i, e in enumerate(ids):
        out.length[e] = rng.randint(1, 5)
        out.shard[e] = (i // 4, i % 4 // 2)
        out.frames += [(e, f, f / out.fps, rng.randint(0, 999)) for f in range(out.length[e])]
        for key in KEYS:
            if key == KEYS[0] or rng.random() < 0.6:
                out.routes[(e, key)] = (i // 4, i % 4, i * 2.5, i * 2.5 + out.length[e] / out.fps)
    out.tasks = [(i, f"task of seed {seed}, number {i}") for i in range(3)]
    told = {k: {"dtype": "video"} for k in KEYS} | {"value": {"dtype": "int64", "shape": [1]}}
    info(out.root, data_path="rows/{chunk_index}/n{file_index:05d}.parquet", video_path="film/{video_key}/{chunk_index}-{file_index}.bin", fps=out.fps, total_episodes=len(ids), total_frames=len(out.frames), total_tasks=3, features=told)
    out.save_episodes()
    write(f"{out.root}/meta/tasks.parquet", {"task_index": [i for i, _ in out.tasks], "task": [t for _, t in out.tasks]})
    for chunk, file in sorted(set(out.shard.values())):
        rows = [r for r in out.frames if out.shard[r[0]] == (chunk, file)]
        more = {"extra": [f"x{r[3]}" for r in rows]} if chunk else {}
        write(out.path(chunk, file), {c: [r[i] for r in rows] for i, c in enumerate(("episode_index", "frame_index", "timestamp", "value"))} | more)
    write(out.path(7, 7), {"episode_index": ids[:1], "frame_index": [10**6], "timestamp": [0.5], "value": [-1]})
    write(f"{out.root}/rows/other.parquet", {"unlike": ["these"]})
    return out


def filmed(root, times=((0, 0, 0.0), (0, 1, 0.5), (1, 0, 0.0)), suffix=".raw", start=10.0):
    """One camera at 2 frames a second; no media file."""
    root = str(root)
    lengths = {}
    for e, _, _ in times:
        lengths[e] = lengths.get(e, 0) + 1
    info(root, fps=2, video_path="videos/{video_key}/file-{file_index:03d}" + suffix, total_episodes=len(lengths), total_frames=len(times), features={"front": {"dtype": "video", "shape": [6, 8, 3]}})
    keys = sorted(lengths)
    write(f"{root}/meta/episodes/e.parquet", {"episode_index": keys, "length": [lengths[k] for k in keys], "data/chunk_index": [0] * len(keys), "data/file_index": [0] * len(keys), "videos/front/chunk_index": [0] * len(keys), "videos/front/file_index": [0] * len(keys), "videos/front/from_timestamp": [start * i for i, _ in enumerate(keys)], "videos/front/to_timestamp": [start * i + 5 for i, _ in enumerate(keys)]})
    write(f"{root}/data/file-000.parquet", {"episode_index": [t[0] for t in times], "frame_index": [t[1] for t in times], "timestamp": [t[2] for t in times]})
    return root
