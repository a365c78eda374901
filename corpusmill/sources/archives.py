"""Tar archives, written in bounded sizes by many tasks and read by ranges.

An archive is indexed by its headers alone, seeking from one to the next, so the index of even a huge
one is little reading; its members are then read by ranges of RANGE_BYTES, each range wherever a
task is free.  A compressed archive can't be read from its middle: it is one task.
"""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
ARCHIVE_BYTES = 128 << 20


def _opened(uri: str):
    # Spark writes file:/x, Arrow wants file:///x
    files, path = pyarrow.fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return files, path


def write_tar(members: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> int:
    """Write members (name, bytes) to archives of about `most` bytes in `folder` (a URI); returns how many members there are.

    An archive gets its name when it is whole; a task that is run again replaces its own.
    """
    folder = folder if "://" in folder or folder.startswith("file:") else "file://" + folder

    def run(batches):
        files, base = _opened(folder)
        task, number, written = TaskContext.get().partitionId(), 0, 0
        raw = archive = None

        def close():
            archive.close()
            raw.close()
            files.move(f"{base}/.part-{task:05d}-{number:04d}", f"{base}/part-{task:05d}-{number:04d}.tar")

        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                if raw is None:
                    raw = files.open_output_stream(f"{base}/.part-{task:05d}-{number:04d}", compression=None)
                    archive, size = tarfile.open(fileobj=raw, mode="w|"), 0
                info = tarfile.TarInfo(name)
                info.size = len(data or b"")
                archive.addfile(info, io.BytesIO(data or b""))
                size, written = size + 512 + info.size, written + 1
                if size >= most:
                    close()
                    raw, number = None, number + 1
        if raw is not None:
            close()
        yield pa.RecordBatch.from_pydict({"n": [written]})

    files, base = _opened(folder)
    files.create_dir(base, recursive=True)
    return members.select("name", F.col("bytes").cast("binary").alias("bytes")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def tar_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, at, size): the regular members of the archives in a folder and below it; at is null in a compressed one."""
    names = ["path", "name", "at", "size"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, own = _opened(uri)
                packed = not own.endswith(".tar")
                with files.open_input_stream(own, compression=None) if packed else files.open_input_file(own) as raw:
                    rows = []
                    with tarfile.open(fileobj=raw, mode="r|*" if packed else "r:") as archive:
                        for m in archive:
                            archive.members = []  # the headers that it has read so far aren't needed
                            if m.isfile():
                                rows.append((uri, m.name, None if packed else m.offset_data, m.size))
                            if len(rows) >= 4096:
                                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                                rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # no contents
    found = found.where(F.col("path").rlike(r"\.(tar|tgz|tar\.[a-z0-9]+)$"))
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "path string, name string, at long, size long")


def read_tar(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(instance_id, label, bytes): the regular members of the archives in a folder; the id is a member's name, the class the folder it is in, whole."""
    index = tar_index(spark, path)
    # members of a range are read one after the other; those of a compressed archive in one pass
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = index.withColumn("range", F.floor(F.col("at") / range_bytes)).repartition(tasks, "path", "range").sortWithinPartitions("path", "at")

    def members(rows):
        """(name, bytes) of index rows, an open archive for as long as its rows last."""
        uri = raw = None
        for own, name, at, size in rows:
            if own != uri:
                if raw is not None:
                    raw.close()
                uri, (files, place) = own, _opened(own)
                raw = files.open_input_file(place)
                if at is None:
                    raw.close()
                    raw = None
                    with files.open_input_stream(place, compression=None) as packed, tarfile.open(fileobj=packed, mode="r|*") as archive:
                        for m in archive:
                            archive.members = []
                            if m.isfile():
                                yield m.name, archive.extractfile(m).read()
            if at is not None:
                raw.seek(at)
                yield name, raw.read(size)
        if raw is not None:
            raw.close()

    def run(batches):
        out, held = [], 0
        for name, data in members(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            out.append((name, name.rpartition("/")[0], data))
            held += len(data)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.binary()))], ["instance_id", "label", "bytes"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.binary()))], ["instance_id", "label", "bytes"])

    return ranged.select("path", "name", "at", "size").mapInArrow(run, "instance_id string, label string, bytes binary")
