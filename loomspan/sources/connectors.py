"""Connectors: paged remote listings and SQLite files as Spark data sources, and their content hashes."""

from __future__ import annotations

import base64
import hashlib
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Block of the block hash.
HASH_BLOCK = 4 << 20


def block_hash(data: bytes, block: int = HASH_BLOCK) -> str:
    """SHA-256 of the joined SHA-256 of each block, as hex."""
    return hashlib.sha256(b"".join(hashlib.sha256(data[i : i + block]).digest() for i in range(0, len(data), block))).hexdigest()


def quick_xor_hash(data: bytes) -> str:
    """The published 160-bit hash: byte i is XORed in at bit 11 i, the length into the last 64 bits; base64."""
    register = 0
    folded = bytearray(160)
    for start in range(0, len(data), 160):
        for i, b in enumerate(data[start : start + 160]):
            folded[i] ^= b
    for i, b in enumerate(folded):
        at = i * 11 % 160
        wide = b << at
        register ^= (wide & ((1 << 160) - 1)) | (wide >> 160)
    register ^= len(data) << 96
    return base64.b64encode((register & ((1 << 160) - 1)).to_bytes(20, "little")).decode()


class Pages:
    """A paged listing service. ``page(cursor)`` returns entries (path, rev, size) and the next cursor or null; ``hash`` is asked for one entry at a time, by the tasks."""

    def page(self, cursor: str | None) -> tuple[list[tuple[str, str, int]], str | None]:
        raise NotImplementedError

    def hash(self, path: str) -> str:
        raise NotImplementedError


class FolderPages(Pages):
    """A stand-in for a remote service: a local folder, walked once and listed page by page."""

    def __init__(self, root: str, size: int = 100):
        self.root, self.size, self.names = root, size, None

    def page(self, cursor):
        if self.names is None:
            self.names = sorted(os.path.join(d, f) for d, _, fs in os.walk(self.root) for f in fs)
        start = int(cursor or 0)
        entries = [(os.path.relpath(p, self.root), str(int(os.path.getmtime(p))), os.path.getsize(p)) for p in self.names[start : start + self.size]]
        return entries, str(start + self.size) if start + self.size < len(self.names) else None

    def hash(self, path):
        with open(os.path.join(self.root, path), "rb") as f:
            return block_hash(f.read())


class RemoteSource(DataSource):
    """``spark.read.format("remote").option("root", ...)``: one row an entry of a paged listing."""

    @classmethod
    def name(cls) -> str:
        return "remote"

    def schema(self) -> str:
        return "path string, rev string, size long, hash string"

    def reader(self, schema):
        return _RemoteReader(self.options)


class _RemoteReader(DataSourceReader):
    """Pages are listed once, by the driver; each is a partition, whose task asks for the contents' hashes."""

    def __init__(self, options):
        self.root, self.size = options["root"], int(options.get("page", 100))

    def partitions(self):
        pages, cursor, out = FolderPages(self.root, self.size), None, []
        while True:
            entries, cursor = pages.page(cursor)
            out.append(InputPartition(entries))
            if cursor is None:
                return out

    def read(self, partition) -> Iterator[tuple]:
        pages = FolderPages(self.root, self.size)
        for path, rev, size in partition.value:
            yield path, rev, size, pages.hash(path)


class SqliteSource(DataSource):
    """``format("sqlite").option("path", ...)``: a row a table with its count; with ``table``, that table's rows as text."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        if "table" not in self.options:
            return "name string, rows long"
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            names = [r[1] for r in db.execute(f'PRAGMA table_info("{self.options["table"]}")')]
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema):
        return _SqliteReader(self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table, self.parts = options["path"], options.get("table"), int(options.get("partitions", 4))

    def _open(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        if not self.table:
            return [InputPartition(None)]
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [InputPartition((0, 0))]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [InputPartition((a, a + step)) for a in range(low, high + 1, step)]

    def read(self, partition) -> Iterator[tuple]:
        with self._open() as db:
            if self.table:
                for row in db.execute(f'SELECT * FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', partition.value):
                    yield tuple(None if v is None else str(v) for v in row)
                return
            for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY 1").fetchall():
                yield name, db.execute(f'SELECT count(*) FROM "{name}"').fetchone()[0]


def is_message_store(tables: set[str]) -> bool:
    """Whether a database holds chats: it has the tables of threads, messages and handles."""
    return {"chat", "message", "handle"} <= tables


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RemoteSource)
    spark.dataSource.register(SqliteSource)
