"""The archive converter on input that comes in another order each time it is read."""

import gzip
import hashlib
import random

import pyarrow.fs
from pyspark.sql import functions as F

from corpusmill.llm import op1_sharding
from corpusmill.llm import op7_warc as op

SCHEMA = "page_id long, url string, html string"


def pages(n):
    rng = random.Random(2)
    bodies = ["<p>" + " ".join(str(rng.randrange(10**6)) for _ in range(40)) for _ in range(n // 3)]
    return [(i, f"http://x/{i}", rng.choice(bodies) if i % 4 else f"{i}") for i in range(n)]


def test_shuffled_input(spark, monkeypatch):
    monkeypatch.setattr(op, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(op, "WARC_FILE_BYTES", 30_000)
    rows = pages(600)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7).orderBy(F.rand())  # another order each time
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    got = op.archive_pages(frame).collect()
    assert len(got) == 600 and sum(r.record_type == "revisit" for r in got) > 200
    by = {i: h for i, _, h in rows}
    for r in got:
        data = by[r.page_id].encode()
        revisit = len(data) >= 100 and first[by[r.page_id]] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first[by[r.page_id]]) if revisit else ("response", None))


def test_files_hold_both_versions_and_only_listed_ones_are_read(spark, tmp_path):
    folder = f"file://{tmp_path}/arc"
    manifest = op.as_archives(spark.createDataFrame(pages(50), SCHEMA).repartition(2), folder)
    names = {r.file for r in manifest.collect()}
    files = {p.name: p for p in (tmp_path / "arc").iterdir()}
    assert names == set(files) and len(names) == 4
    versions = sorted(int(gzip.open(f).read().split(b"\n")[1].split(b" ")[0]) for f in files.values())
    assert versions == [1, 1, 2, 2]
    (tmp_path / "arc" / "of-a-lost-task.arc.gz").write_bytes(b"half a fi")
    assert op.parsed(folder, manifest).count() == 50
    assert isinstance(pyarrow.fs.FileSystem.from_uri(folder)[0], pyarrow.fs.LocalFileSystem)


def test_sharding_keeps_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, 2, 3, {"a": 1}, "x"), (None, 5, 6, None, "y")], "doc_id long, _slot int, _owner int, slot map<string,int>, `a.b` string")
    got = op1_sharding.assign_shards(frame, op1_sharding.shard_names(4), 101)
    assert got.columns == [*frame.columns, "shard"] and sorted(tuple(r)[1:3] for r in got.collect()) == [(2, 3), (5, 6)]
