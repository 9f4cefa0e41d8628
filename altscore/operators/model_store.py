"""Versions of stored artefacts, committed one by one.

``root/<artefact>/`` holds what was saved; ``root/_versions/<number>`` names it.
The number's file is created only if it is not there, which the shared file system
does for one writer alone; a writer that comes second takes the next number.  The
newest version is the highest number that names an artefact: nothing is ever
overwritten, so whoever stops between saving and committing leaves the version
before in place, and a number whose file was left empty names nothing.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import SparkSession


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._folder = self._hadoop.fs.Path(self.root + "/_versions")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    @staticmethod
    def new_name() -> str:
        return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:12]

    def _path(self, number: int):
        return self._hadoop.fs.Path(self._folder, f"{number:08d}")

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def highest(self) -> int:
        """The highest number that was taken, committed or not."""
        return (self._numbers() or [0])[-1]

    def _read(self, number: int) -> dict | None:
        stream = self._fs.open(self._path(number))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return json.loads(text) | {"version": number}
        except json.JSONDecodeError:
            return None

    def versions(self) -> list[dict]:
        """All committed versions, oldest first."""
        return [v for v in map(self._read, self._numbers()) if v is not None]

    def latest(self) -> dict | None:
        for n in reversed(self._numbers()):
            v = self._read(n)
            if v is not None:
                return v
        return None

    def find(self, key: str) -> dict | None:
        """The first version committed under ``key``."""
        return next((v for v in self.versions() if v["key"] == key), None)

    def commit(self, artefact: str, key: str | None = None, **notes) -> int:
        """Makes an artefact that is wholly saved the newest version."""
        number = self.highest() + 1
        while not self.commit_at(number, {"artefact": artefact, "key": key, **notes}):
            number += 1
        return number

    def commit_at(self, number: int, notes: dict) -> bool:
        """Whether this writer got the number."""
        return self._put(number, json.dumps(notes, sort_keys=True))

    def folders(self, below: str) -> list[str]:
        path = self._hadoop.fs.Path(f"{self.root}/{below}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._hadoop.fs.Path(f"{self.root}/{name}"), True)

    def _put(self, number: int, text: str) -> bool:
        """Writes the number's file if it is not there."""
        path = self._path(number)
        if self._fs.exists(path):
            return False
        try:
            stream = self._fs.create(path, False)
        except Exception:
            if self._fs.exists(path):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True
