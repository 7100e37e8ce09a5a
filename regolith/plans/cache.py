"""Answers that stay for a while: written tables under a key, with the time until which they hold."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Seconds that a dashboard's, a search's and the thresholds' answers hold.
DASHBOARD, SEARCH, THRESHOLDS = 10, 30, 60


def default_key(name: str, *args, **named) -> str:
    """The name and a hash of all arguments."""
    body = json.dumps([args, sorted(named.items())], default=str)
    return f"{name}-{hashlib.sha256(body.encode()).hexdigest()[:32]}"


class Answers:
    """Answers in a shared folder, so that sessions share them; what is polled is computed once in `seconds`.

    key: (name, *args, **named) -> the folder's name, `default_key` by default. An answer's folder is named after the time at
    which it expires, and appears when it is whole.
    """

    def __init__(self, spark: SparkSession, root: str, seconds: float, key: Callable[..., str] = default_key, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.seconds, self.key, self.clock = spark, root.rstrip("/"), seconds, key, clock
        self._java = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, name: str):
        return self._java.Path(f"{self.root}/{name}" if name else self.root)

    def _listed(self, name: str) -> list[str]:
        path = self._path(name)
        fs = path.getFileSystem(self._conf)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def _drop(self, name: str) -> None:
        path = self._path(name)
        path.getFileSystem(self._conf).delete(path, True)

    def _held(self, key: str) -> str | None:
        now = self.clock() * 1000
        held = sorted((n for n in self._listed(key) if n.split("-")[0].isdecimal() and int(n.split("-")[0]) > now), key=lambda n: int(n.split("-")[0]))
        return held[-1] if held else None

    def get(self, name: str, build: Callable[..., DataFrame], *args, **named) -> DataFrame:
        """The answer that holds, else `build(*args, **named)`, written."""
        key = self.key(name, *args, **named)
        held = self._held(key)
        if held is None:
            for old in self._listed(key):
                if old.split("-")[0].isdecimal():
                    self._drop(f"{key}/{old}")
            aside = f"{key}/.{uuid.uuid4().hex}"
            build(*args, **named).write.parquet(f"{self.root}/{aside}")
            held = f"{int((self.clock() + self.seconds) * 1000)}-{uuid.uuid4().hex}"
            source = self._path(aside)
            source.getFileSystem(self._conf).rename(source, self._path(f"{key}/{held}"))
        return self.spark.read.parquet(f"{self.root}/{key}/{held}")

    def invalidate(self, prefix: str = "") -> int:
        """Forget the answers whose keys begin so; returns how many keys went."""
        gone = [k for k in self._listed("") if k.startswith(prefix)]
        for k in gone:
            self._drop(k)
        return len(gone)
