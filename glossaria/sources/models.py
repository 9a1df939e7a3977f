"""Model files: found or fetched under one of several names, and brought to the executors."""

from __future__ import annotations

import json
import math
import os
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark import SparkFiles
from pyspark.sql import SparkSession


def ensure_model(path: str, names: Iterable[str], fetch: Callable[[str, str], str] | None = None) -> str:
    """path, if there is a file that isn't empty; else what fetch(name, folder) gives for the first of the names (and then
    ``model.bin``) that it can get, moved to path. Raises if there is no fetch, or if no name can be got."""
    if os.path.exists(path) and os.path.getsize(path) > 0:
        return path
    if fetch is None:
        raise FileNotFoundError(f"no model at {path}")
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    errors = []
    for name in dict.fromkeys([*filter(None, names), "model.bin"]):
        try:
            got = fetch(name, folder)
            if os.path.getsize(got) == 0:
                raise OSError("empty file")  # noqa: TRY301
        except Exception as e:  # noqa: BLE001
            errors.append(f"{name}: {e!r}")
            continue
        if got != path:
            os.replace(got, path)
        return path
    raise RuntimeError("no usable model: " + "; ".join(errors))


def distribute(spark: SparkSession, path: str, mode: str = "files") -> str:
    """What executors pass to local_path(): the path itself where all see it (direct), or the name of a file sent to them (files)."""
    if mode == "direct":
        return path
    if mode != "files":
        raise ValueError(f"unknown mode {mode!r}")
    spark.sparkContext.addFile("file://" + os.path.abspath(path))
    return "sent:" + os.path.basename(path)


def local_path(told: str) -> str:
    """The path of a distributed model on this machine."""
    return SparkFiles.get(told.removeprefix("sent:")) if told.startswith("sent:") else told


class ModelCache:
    """The models of one process, so that its tasks share them: by kind, path, size and time of the last change.

    A file that has changed is loaded anew and its old model goes; beyond ``most`` bytes of files those used least recently go,
    but for the one just asked for. Spark's Python workers are processes that are used again (spark.python.worker.reuse), so a
    model is loaded once for each worker and not once for each task.
    """

    def __init__(self, most: int = 4 << 30) -> None:
        self.most, self.loads, self.models = most, 0, OrderedDict()

    def get(self, kind: Callable[[str], object], told: str) -> object:
        path = local_path(told)
        state = os.stat(path)
        name = (f"{kind.__module__}.{kind.__qualname__}", path)
        version = (state.st_size, state.st_mtime_ns)
        if name in self.models and self.models[name][0] == version:
            self.models.move_to_end(name)
            return self.models[name][1]
        self.models.pop(name, None)
        model = kind(told)
        self.loads += 1
        self.models[name] = (version, model)
        while len(self.models) > 1 and sum(v[0] for v, _ in self.models.values()) > self.most:
            self.models.popitem(last=False)
        return model


#: The cache of this process; a worker has its own.
PROCESS = ModelCache()


@dataclass(frozen=True)
class SharedModel:
    """What run_model() takes as ``load``: a kind of model (its class) and what distribute() told; loaded through the cache."""

    kind: Callable[[str], object]
    told: str

    def __call__(self) -> object:
        return PROCESS.get(self.kind, self.told)


class WordListFile:
    """A language model in a JSON file: words of each label; scores are shares of matched words."""

    def __init__(self, told: str) -> None:
        with open(local_path(told), encoding="utf-8") as f:
            self.label = {}
            for label, words in json.load(f).items():
                for w in words:
                    self.label.setdefault(w, []).append(label)

    def predict(self, texts: list[str], k: int) -> list[list[tuple[str, float]]]:
        out = []
        for t in texts:
            n = Counter(x for w in "".join(c if c.isalpha() else " " for c in t).split() for x in self.label.get(w, ()))
            total = sum(n.values())
            out.append([(x, math.floor(c / total * 1_000_000 + 0.5) / 1_000_000) for x, c in sorted(n.items(), key=lambda e: (-e[1], e[0]))[:k]])
        return out
