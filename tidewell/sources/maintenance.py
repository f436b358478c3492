"""Files and state around builds: export folders, storage, locks, resumable stages, caches, fingerprints."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sink import is_portable_path

STALE_SECONDS = 3600


class LocalStorage:
    """exists, get, put, delete, move, files below a root; paths with a scheme are refused."""

    def __init__(self, root: str):
        self.root = root

    def _at(self, path: str) -> str:
        full = os.path.normpath(os.path.join(self.root, path.lstrip("/")))
        if not is_portable_path(path) or not (full + "/").startswith(os.path.normpath(self.root) + "/"):
            raise ValueError(f"{path!r} is outside of the storage")
        return full

    def exists(self, path: str) -> bool:
        return os.path.exists(self._at(path))

    def get(self, path: str) -> bytes:
        with open(self._at(path), "rb") as f:
            return f.read()

    def put(self, path: str, data: bytes) -> None:
        full = self._at(path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full + ".new", "wb") as f:
            f.write(data)
        os.replace(full + ".new", full)

    def delete(self, path: str) -> None:
        full = self._at(path)
        if os.path.isdir(full):
            shutil.rmtree(full)
        elif os.path.exists(full):
            os.remove(full)

    def move(self, path: str, to: str) -> None:
        os.makedirs(os.path.dirname(self._at(to)), exist_ok=True)
        os.replace(self._at(path), self._at(to))

    def files(self, suffix: str = "") -> list[str]:
        found = (os.path.relpath(os.path.join(d, n), self.root) for d, _, names in os.walk(self.root) for n in names)
        return sorted(f for f in found if f.endswith(suffix))


def count_html(storage: LocalStorage) -> int:
    return len(storage.files(".html"))


def manifest(storage: LocalStorage) -> dict[str, str]:
    """Item id of each exported file."""
    out = {}
    for path in storage.files(".html"):
        m = re.search(rb'<body id="([^"]*)"', storage.get(path))
        out[path] = m[1].decode() if m else ""
    return out


def delete_exported(storage: LocalStorage, ids: set[str] = frozenset(), paths: set[str] = frozenset()) -> int:
    gone = [p for p, i in manifest(storage).items() if i in ids or p in paths]
    for p in gone:
        storage.delete(p)
    return len(gone)


class BuildLock:
    """One writer at a time; a lock is stale after an hour or when its process is gone."""

    def __init__(self, path: str, stale: float = STALE_SECONDS):
        self.path, self.stale = path, stale

    def acquire(self) -> bool:
        for _ in range(2):
            try:
                fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                if not self._is_stale():
                    return False
                os.remove(self.path)
                continue
            with os.fdopen(fd, "w") as f:
                json.dump({"pid": os.getpid(), "at": time.time()}, f)
            return True
        return False

    def _is_stale(self) -> bool:
        try:
            held = json.load(open(self.path))
            if time.time() - held["at"] > self.stale:
                return True
            os.kill(held["pid"], 0)
        except (ValueError, KeyError, ProcessLookupError):
            return True
        except PermissionError:
            return False
        return False

    def release(self) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)


class Stages:
    """Named stages written as tables; a build that is started again reads what is finished."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def done(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def run(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.done(name):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")


class MemoryCache:
    """get and set with a time to live."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock, self.held = clock, {}

    def get(self, key: str):
        value, until = self.held.get(key, (None, 0))
        return value if until is None or until > self.clock() else None

    def set(self, key: str, value, ttl: float | None = None) -> None:
        self.held[key] = (value, None if ttl is None else self.clock() + ttl)


class NoCache:
    def get(self, key: str):
        return None

    def set(self, key: str, value, ttl: float | None = None) -> None:
        pass


def should_build(fingerprint: str, storage: LocalStorage, name: str = "fingerprint") -> bool:
    """Whether the corpus differs from the one last recorded."""
    return not storage.exists(name) or storage.get(name).decode() != fingerprint


def record_build(fingerprint: str, storage: LocalStorage, name: str = "fingerprint") -> None:
    storage.put(name, fingerprint.encode())
