"""The pipeline's stages on awkward columns, and all five in a row against their operators on plain lists."""

import random

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from corpusmill.llm import op1_sharding, op3_mixing, op8_quality, op10_decontaminate
from tests.conftest import SMALL


def test_columns_of_any_name_and_kind(spark):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(30).collect()
    rows = [(r.doc_id, r.text, "en", rng.choice("ab"), 3, 7, 8, 9, {"k": r.doc_id}, bytes([1, 2]), "x", "y") for r in docs]
    # rows that share a doc_id: equal ones, and one that differs in a map only
    rows += [rows[3], (rows[4][0], *rows[4][1:8], {"k": -1}, *rows[4][9:]), (rows[5][0], "other text", *rows[5][2:])]
    kind = "doc_id long, text string, lang string, source string, n_chars long, _fp int, _slot int, _owner int, m map<string,long>, b binary, _row string, `a.b c` string"
    frame = spark.createDataFrame(rows, kind)
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, frame, SMALL)
        assert out.columns == [*frame.columns, *(["shard"] if name == "sharding" else [])], name
        kept[name] = out.collect()
        assert all((r._fp, r._slot, r._owner, r["a.b c"]) == (7, 8, 9, "y") for r in kept[name])
    near = kept["SimHash near-dedup"]
    assert len({(r.doc_id, r.text) for r in near}) == len(near)
    assert stage(spark, frame.limit(0), SMALL).count() == 0


def test_near_dedup_broadcasts_no_keys(spark, monkeypatch):
    plans, settle = [], cp.op6_simhash.components

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return settle(edges)

    monkeypatch.setattr(cp.op6_simhash, "components", seen)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert 0 < cp.near_dedup(spark, docs, SMALL).count() < docs.count()
    assert len(plans) == 1 and "MapInArrow" in plans[0] and "Broadcast" not in plans[0]


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_five_stages_in_a_row(spark):
    """Each stage by its definition: SimHash groups pair by pair, the others by their operators' verdicts on what is left."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    verdicts = {r.doc_id for r in op8_quality.assess(docs).where("kept").collect()}
    left = sorted(verdicts)
    fps = {i: fingerprint(rows[i].text) for i in left}
    group = {i: i for i in left}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for x, i in enumerate(left):
        for j in left[:x]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    left = [i for i in left if find(i) == i]
    frame = spark.createDataFrame([rows[i] for i in left], docs.schema)
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    leaks = {r.doc_id for r in op10_decontaminate.contaminated(frame, items).collect()}
    frame = frame.where(~F.col("doc_id").isin(list(leaks)))
    plan = op3_mixing.mix(frame, op3_mixing.weights(), op3_mixing.slopes()).collect()
    want = sorted(r.doc_id for r in plan for _ in range(r.passes))
    got = cp.run(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == want and want
    shard = {r.doc_id: r.shard for r in op1_sharding.assign_shards(docs.select("doc_id"), op1_sharding.shard_names()).collect()}
    assert all(r.shard == shard[r.doc_id] and r.text == rows[r.doc_id].text for r in got)
