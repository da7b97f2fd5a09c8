"""Answers of paid calls, kept as they come: a call that was answered once is never made again.

Each answer is a small file in a folder that all executors reach, named by a digest of
the call: who is asked, for what, and with which arguments.  A task that runs again, and
a job that is started anew, find the answers there; of two tasks that ask at the same
time both may pay.  Files are written beside their place and moved, so none is half
there.  Failed calls leave nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


class Journal:
    """A folder by its URI (file, hdfs, s3 and what else pyarrow.fs opens)."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    def _place(self, key: str) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.uri)
        return system, f"{root}/{key[:2]}/{key}.json"

    def get(self, key: str) -> dict | None:
        system, path = self._place(key)
        if system.get_file_info(path).type != fs.FileType.File:
            return None
        with system.open_input_stream(path) as f:
            return json.loads(f.read())

    def put(self, key: str, entry: dict) -> None:
        system, path = self._place(key)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        beside = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(beside) as f:
            f.write(json.dumps(entry).encode())
        system.move(beside, path)

    def table(self, spark: SparkSession) -> DataFrame:
        """(key, provider, call, answer): all answers so far; answer is JSON."""
        return spark.read.schema("key string, provider string, call string, answer string").json(f"{self.uri}/*/*.json")


class Journaled:
    """A live provider whose answers are kept in a journal."""

    CALLS = ("analyze", "extract_structure", "convert_page", "convert_window", "summarize", "chat", "classify_image", "validate_connection")

    def __init__(self, provider, journal: Journal):
        self.provider, self.journal, self.name, self.native_pages = provider, journal, provider.name, provider.native_pages

    def __getattr__(self, call: str):
        if call not in Journaled.CALLS:
            raise AttributeError(call)

        def ask(*args):
            key = hashlib.sha256(json.dumps([self.name, call, args], sort_keys=True, default=_plain).encode()).hexdigest()
            known = self.journal.get(key)
            if known is None:
                known = {"key": key, "provider": self.name, "call": call, "answer": json.dumps(getattr(self.provider, call)(*args))}
                self.journal.put(key, known)
            return json.loads(known["answer"])

        return ask

    def __getstate__(self):
        return self.__dict__

    def __setstate__(self, state):
        self.__dict__.update(state)


def _plain(x):
    """Values that JSON does not know: pictures as digests, arrays as lists."""
    return hashlib.sha256(bytes(x)).hexdigest() if isinstance(x, (bytes, bytearray, memoryview)) else x.tolist() if hasattr(x, "tolist") else str(x)
