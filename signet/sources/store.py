"""A store of results by content, as a data source that Spark reads and writes: ``spark.read.format("results")``.

A write is one batch.  Tasks put rows into segments of up to SEGMENT bytes; when all are
done, the driver lists the segments with their sizes and digests in one file, which a
rename makes visible at once.  What no list names isn't there: half-written batches and
repeated task attempts leave files that nobody reads.  A batch that is listed already
isn't written again, so a job that is run twice adds nothing.

A read takes one partition for each segment.  A segment that is gone, shorter or altered
is a miss, not an error; so is a row whose payload isn't the one that was stored, or whose
key doesn't begin with the digest of the content it was made from.  Filters on ``key``
leave out segments by their first and last key, so keys are best written in ranges (``put``).

Dropping is a list too: it hides keys of the batches that stood then; later batches can
store them anew.  Null keys, sources and payloads aren't stored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

NAME, SCHEMA, SEGMENT = "results", "key string, source string, payload string", 64 << 20
_ARROW = pa.schema([("key", pa.string()), ("source", pa.string()), ("payload", pa.string())])
_STORED = _ARROW.append(pa.field("digest", pa.string()))


@dataclass(frozen=True)
class Segment:
    """A file of rows as its batch lists it."""

    name: str
    size: int
    digest: str
    rows: int
    first: str
    last: str


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _named(key: str, source: str) -> bool:
    return key == source or key.startswith(f"{source}__")


class _Place:
    """The store's folder on whatever file system its path names."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))

    def write(self, name: str, data: bytes) -> None:
        self.fs.create_dir(f"{self.root}/{name.rpartition('/')[0]}", recursive=True)
        with self.fs.open_output_stream(f"{self.root}/{name}") as out:
            out.write(data)

    def read(self, name: str) -> bytes | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{name}") as file:
                return file.read()
        except (FileNotFoundError, OSError):
            return None

    def has(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.root}/{name}").type != pafs.FileType.NotFound

    def show(self, name: str, data: bytes) -> None:
        """Writes aside and renames, so that readers see all of it or nothing."""
        aside = f"aside/{uuid.uuid4().hex}"
        self.write(aside, data)
        self.fs.create_dir(f"{self.root}/{name.rpartition('/')[0]}", recursive=True)
        self.fs.move(f"{self.root}/{aside}", f"{self.root}/{name}")

    def remove(self, names: Sequence[str]) -> None:
        for name in names:
            if self.has(name):
                self.fs.delete_file(f"{self.root}/{name}")

    def lists(self) -> dict[str, dict]:
        """Every list by its name; one that can't be read counts as not written."""
        found = {}
        for info in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/lists", allow_not_found=True)):
            try:
                found[info.base_name.removesuffix(".json")] = json.loads(self.read(f"lists/{info.base_name}") or b"")
            except ValueError:
                continue
        return found


@dataclass
class _Wrote(WriterCommitMessage):
    segments: list[Segment]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str, segment: int):
        self.path, self.batch, self.most = path, batch, segment

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        place, made, held, size = _Place(self.path), [], [], 0

        def close() -> None:
            nonlocal held, size
            rows = [r for batch in held for r in batch.to_pylist() if None not in r.values()]
            held, size = [], 0
            for r in rows:
                if not _named(r["key"], r["source"]):
                    raise ValueError(f"a key must begin with the digest of its content: {r['key'][:80]}")
                r["digest"] = _sha(r["payload"].encode())
            if rows:
                out = pa.BufferOutputStream()
                pq.write_table(pa.Table.from_pylist(rows, _STORED), out, compression="zstd")
                data, keys = out.getvalue().to_pybytes(), [r["key"] for r in rows]
                name = f"segments/{self.batch}-{uuid.uuid4().hex}.parquet"
                place.write(name, data)
                made.append(Segment(name, len(data), _sha(data), len(rows), min(keys), max(keys)))

        for batch in iterator:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part.select(_ARROW.names))
                size += part.nbytes
                if size >= self.most:
                    close()
        close()
        return _Wrote(made)

    def commit(self, messages: list[_Wrote | None]) -> None:
        place, segments = _Place(self.path), [s for m in messages if m for s in m.segments]
        if place.has(f"lists/{self.batch}.json"):  # the batch is there: what was written again goes
            place.remove([s.name for s in segments])
        else:
            place.show(f"lists/{self.batch}.json", json.dumps({"segments": [asdict(s) for s in segments]}).encode())

    def abort(self, messages: list[_Wrote | None]) -> None:
        _Place(self.path).remove([s.name for m in messages if m for s in m.segments])


@dataclass
class _Part(InputPartition):
    segment: Segment
    hidden: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Notes what can leave out whole segments; Spark still filters rows."""
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("key",):
                self.wanted.append(("prefix", f.value) if isinstance(f, StringStartsWith) else ("any", f.value if isinstance(f, In) else (f.value,)))
            yield f

    def partitions(self) -> list[_Part]:
        lists = _Place(self.path).lists()
        drops = [x for x in lists.values() if "prefix" in x]
        found = []
        for batch, one in lists.items():
            hidden = tuple(d["prefix"] for d in drops if batch in d["batches"])
            found += [_Part(s, hidden) for s in (Segment(**x) for x in one.get("segments", ())) if self._may_hold(s)]
        return found or [_Part(Segment("", 0, "", 0, "", ""), ())]

    def _may_hold(self, s: Segment) -> bool:
        return all(
            s.last >= value and s.first[: len(value)] <= value if kind == "prefix" else any(k is not None and s.first <= k <= s.last for k in value)
            for kind, value in self.wanted
        )

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        own = partition.segment
        data = _Place(self.path).read(own.name) if own.rows else None
        if data is None or len(data) != own.size or _sha(data) != own.digest:
            return
        for batch in pq.ParquetFile(pa.BufferReader(data)).iter_batches(4096):
            rows = [r for r in batch.to_pylist() if _named(r["key"], r["source"]) and _sha(r["payload"].encode()) == r["digest"] and not r["key"].startswith(partition.hidden)]
            yield from pa.Table.from_pylist([{k: r[k] for k in _ARROW.names} for r in rows], _ARROW).to_batches()


class ResultStore(DataSource):
    """Options: ``path``; for writing ``batch`` (a name for the whole write) and ``segment`` (bytes)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite or "batch" not in self.options:
            raise ValueError("results are appended, each write with a name for its batch")
        if not {"key", "source", "payload"} <= set(schema.names):
            raise ValueError(f"results have {SCHEMA}")
        return _Writer(self.options["path"], self.options["batch"], int(self.options.get("segment", SEGMENT)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResultStore)


def put(results: DataFrame, path: str, batch: str, segment: int = SEGMENT) -> None:
    """Stores ``results`` (key, source, payload) as one batch, in ranges of keys; nothing happens if the batch is there."""
    register(results.sparkSession)
    if not _Place(path).has(f"lists/{batch}.json"):
        rows = results.select("key", "source", "payload").repartitionByRange("key")
        rows.write.format(NAME).mode("append").options(path=path, batch=batch, segment=segment).save()


def load(spark: SparkSession, path: str) -> DataFrame:
    """(key, source, payload): what is stored and sound; of several batches that stored a key, all rows."""
    register(spark)
    return spark.read.format(NAME).option("path", path).load()


def found(inputs: DataFrame, path: str) -> DataFrame:
    """``inputs`` (key, ...) with ``payload``: of what is stored under its key the least, or null."""
    one = load(inputs.sparkSession, path).groupBy("key").agg(F.min("payload").alias("payload"))
    return inputs.join(one, "key", "left")


def drop(path: str, prefix: str = "") -> None:
    """Hides the keys that begin with ``prefix`` in all batches that are there now."""
    place = _Place(path)
    batches = [name for name, one in place.lists().items() if "segments" in one]
    place.show(f"lists/drop-{uuid.uuid4().hex}.json", json.dumps({"prefix": prefix, "batches": batches}).encode())
