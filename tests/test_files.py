"""Text sinks that are read back, and sources that read large files in parts."""

import glob
import gzip
import io
import random
import subprocess
import sys
import tarfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import features as fm
from corpusmill.sources import archives as ar
from corpusmill.sources import lines as ln
from corpusmill.sources import readers as rd
from corpusmill.sources import writers as wr


@pytest.fixture
def small_blocks(spark):
    for k, v in (("maxPartitionBytes", "512"), ("openCostInBytes", "64")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join("wörd"[: rng.randrange(1, 5)] for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(n)]


def test_lines_are_numbered_across_blocks(spark, small_blocks, tmp_path):
    files = {"a.txt": texts(700, 1), "b.txt": texts(5, 2), "sub/c.txt": texts(300, 3), "d.gz": texts(400, 4)}
    (tmp_path / "sub").mkdir()
    for name, lines in files.items():
        data = ("\n".join(lines) + "\n").encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    got = ln.numbered_lines(spark, str(tmp_path))
    assert spark.read.option("recursiveFileLookup", "true").text(str(tmp_path)).rdd.getNumPartitions() > 40
    whole = {(name.rsplit("/", 1)[-1], i): x for name, lines in files.items() for i, x in enumerate(lines)}
    assert {(r.path.rsplit("/", 1)[-1], r.line): r.value for r in got.collect()} == whole
    by = {r.instance_id: (r.label, r.text) for r in rd.read_lines_by_class(spark, str(tmp_path)).collect()}
    assert by == {f"{n.removesuffix('.gz')}-{i}": (n.removesuffix(".gz"), x) for (n, i), x in whole.items() if x}


def test_jsonl_ids_and_labels(spark, small_blocks, tmp_path):
    lines = ['{"t": "é", "c": "x"}', "", '{"t": "two\\nlines", "c": ["x", "y"]}', '{"t": "none"}'] * 60
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    found, classes = rd.read_jsonl(spark, str(tmp_path), "t", "c")
    got = {r.instance_id: r.text for r in found.collect()}
    assert got == {f"in.jsonl-{i}": {0: "é", 2: "two\nlines", 3: "none"}[i % 4] for i in range(240) if i % 4 != 1}
    assert sorted((r.instance_id, r.label) for r in classes.collect()) == sorted((f"in.jsonl-{i}", x) for i in range(240) for x in {0: "x", 2: "xy"}.get(i % 4, ""))


def test_records_of_many_lines_are_read_by_their_end(spark, small_blocks, tmp_path):
    bodies = ["\n".join(texts(9, i)) for i in range(120)]
    record = '<REUTERS newid="{}" lewissplit="{}">\n<TOPICS><D>a</D><D>b c</D></TOPICS>\n<TEXT TYPE="x">{}</TEXT>\n</REUTERS>\n'
    (tmp_path / "one.sgm").write_text("<!DOCTYPE x>\n" + "".join(record.format(i, ("TRAIN", "TEST", "NOT-USED")[i % 3], b) for i, b in enumerate(bodies)))
    found, classes, split = rd.read_tagged(spark, str(tmp_path))
    assert {r.instance_id: r.text for r in found.collect()} == {str(i): b for i, b in enumerate(bodies)}
    assert classes.count() == 240 and split.groupBy("role").count().orderBy("role").collect() == [("test", 40), ("train", 40)]


def tables(spark, n, width, share):
    rng = random.Random(n)
    names = [f"f{k:03d}'\\ x" for k in range(width)]
    cells = [(i, names[k], rng.randrange(1, 9)) for i in range(n) for k in range(width) if rng.random() < share]
    cells += [(n, name, 1) for name in names]  # every feature occurs
    features = spark.createDataFrame(cells, "instance_id long, feature string, value long")
    instances = spark.range(n + 2).withColumnRenamed("id", "instance_id")  # the last has no cells
    labels = instances.selectExpr("instance_id", "if(instance_id % 3 = 0, 'no', 'yes') AS label")
    return instances, features, fm.index_features(features), labels, names, {(i, names.index(f)): float(v) for i, f, v in cells}


@pytest.mark.parametrize("share,sparse", [(0.02, True), (0.5, False)])
def test_arff_is_dense_or_sparse(spark, tmp_path, share, sparse):
    instances, features, space, labels, names, cells = tables(spark, 90, 40, share)
    wr.write_arff(instances, features, space, labels, labels.select("label").distinct(), f"{tmp_path}/x")
    lines = rd.sorted_lines(spark, f"{tmp_path}/x").orderBy("line").collect()
    assert [r.line for r in lines] == list(range(len(lines))) and lines[0].value == "@RELATION 'corpus'" and lines[2].value == "@ATTRIBUTE class {no,yes}"
    assert lines[-1].value.startswith("{") == sparse
    attributes, rows = rd.read_arff(rd.sorted_lines(spark, f"{tmp_path}/x"))
    assert [r.name for r in attributes.orderBy("idx").collect()] == names
    rows = rows.collect()
    assert {r.line: r.label for r in rows} == {i: "no" if i % 3 == 0 else "yes" for i in range(92)}
    assert {(r.line, c.idx): c.value for r in rows for c in r.cells} == cells


def test_one_label_only(spark, tmp_path):
    instances, features, space, labels, _, _ = tables(spark, 4, 3, 0.5)
    for bad in (labels.union(labels.limit(1)), labels.where("instance_id > 0")):
        with pytest.raises(Exception, match="exactly one label"):
            wr.write_arff(instances, features, space, bad, labels.select("label").distinct(), f"{tmp_path}/{random.random()}")
    with pytest.raises(Exception, match="no whole number"):
        wr.bow_rows(features.withColumn("value", F.lit(0.5)), space, labels).collect()


def test_svm_and_vw_lines_come_back(spark, tmp_path):
    instances, features, space, labels, _, cells = tables(spark, 300, 12, 0.4)
    classes = spark.createDataFrame([("no", 0), ("yes", 1)], "label string, idx long")
    both = labels.where("instance_id % 5 > 0").union(labels.where("instance_id % 5 = 1").selectExpr("instance_id", "if(label = 'no', 'yes', 'no')"))
    wr.write_sorted(wr.libsvm_rows(instances, features, space, both, classes), f"{tmp_path}/svm", ["instance_id"])
    rows = rd.read_libsvm(rd.sorted_lines(spark, f"{tmp_path}/svm")).collect()
    assert {(r.line, c.idx): c.value for r in rows for c in r.cells} == cells
    assert {r.line: r.labels for r in rows} == {i: [] if i % 5 == 0 else [0, 1] if i % 5 == 1 else [int(i % 3 > 0)] for i in range(302)}
    wr.write_sorted(wr.vw_rows(instances, features, space, labels.where("instance_id % 5 > 0"), classes), f"{tmp_path}/vw", ["instance_id"])
    rows = rd.read_vw(rd.sorted_lines(spark, f"{tmp_path}/vw")).collect()
    assert {(r.line, c.idx): c.value for r in rows for c in r.cells} == cells
    assert {r.line: r.label for r in rows} == {i: None if i % 5 == 0 else int(i % 3 > 0) for i in range(302)}


def test_a_long_thread_is_many_rows(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("if(id % 1000 = 0, id, 7) AS thread_id", "id AS pos", "id % 10 AS n", "'x' AS label").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else Spark joins such small ranges
    wr.write_sorted(wr.sequence_rows(rows, ["n"], "label"), f"{tmp_path}/s", ["thread_id", "end", "pos"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [sum(1 for _ in open(f)) for f in sorted(glob.glob(f"{tmp_path}/s/part-*"))]
    assert len(parts) > 1 and max(parts) < 15_000  # no task writes most of the long thread
    got = [r.value for r in rd.sorted_lines(spark, f"{tmp_path}/s").orderBy("line").collect()]
    want, by = [], {}
    for i in range(20_000):
        by.setdefault(i if i % 1000 == 0 else 7, []).append(i)
    for thread in sorted(by):
        want += [f"{i % 10} x" for i in by[thread]] + [""]
    assert got == want


def test_tar_is_read_by_ranges(spark, tmp_path):
    rng = random.Random(5)
    members = {f"a/{'deep/' * (i % 40)}m{i}é.txt": bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 511, 512, 513, 4000]))) for i in range(300)}
    members["top.txt"] = b"no folder"
    frame = spark.createDataFrame(list(members.items()), "name string, bytes binary").repartition(3)
    assert ar.write_tar(frame, f"{tmp_path}/many", 30_000) == len(members)
    archives = glob.glob(f"{tmp_path}/many/*.tar")
    assert len(archives) > 6 and all(tarfile.open(a).getmembers() for a in archives)
    # one archive for all, one compressed, and things that are no archives or no files
    (tmp_path / "one").mkdir()
    for name, mode in (("whole.tar", "w"), ("packed.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / "one" / name, mode) as t:
            folder = tarfile.TarInfo("folder")
            folder.type = tarfile.DIRTYPE
            t.addfile(folder)
            for n, data in members.items():
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    (tmp_path / "one" / "notes.txt").write_text("no archive")
    want = sorted((n, n.rpartition("/")[0], d) for n, d in members.items())
    read = lambda where: sorted((r.instance_id, r.label, bytes(r.bytes)) for r in ar.read_tar(spark, f"{tmp_path}/{where}", 10_000).collect())
    assert read("many") == want
    assert read("one") == sorted(want + want)
    index = ar.tar_index(spark, f"{tmp_path}/one").where("at IS NOT NULL")
    assert index.selectExpr("floor(at / 10000) AS r").distinct().count() > 20  # one archive, many ranges


def test_stored_tables_go_with_the_driver(tmp_path):
    """What queries store lies in one folder of the shared one; it is gone when the driver has ended, and nothing else is."""
    code = f"""
import os
from pyspark.sql import SparkSession
from corpusmill.shared import shared_dir, stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
spark.range(3).write.parquet({str(tmp_path / "result")!r})
assert stored(spark.range(5)).count() == 5 and shared_dir(spark) == shared_dir(spark)
print("stored in", [f for f in os.listdir({str(tmp_path)!r}) if f.startswith("corpusmill-")])
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=Path(__file__).parent.parent)
    assert done.returncode == 0 and "stored in ['corpusmill-" in done.stdout, done.stderr[-2000:]
    # the JVM ends shortly after Python
    for _ in range(100):
        if not list(tmp_path.glob("corpusmill-*")):
            break
        time.sleep(0.2)
    assert not list(tmp_path.glob("corpusmill-*")) and (tmp_path / "result").is_dir()
