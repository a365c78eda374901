"""Sequences: threads (thread_id, pos, instance_id) and edges (parent, child)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_dir, stored
from .ranking import row_numbers


def to_edges(threads: DataFrame) -> DataFrame:
    """(parent, child) for neighbours; a thread of one instance is an error."""
    w = Window.partitionBy("thread_id").orderBy("pos")
    rows = threads.select("instance_id", F.lead("instance_id").over(w).alias("child"), F.count("*").over(Window.partitionBy("thread_id")).alias("n"))
    checked = rows.withColumn("parent", F.when(F.col("n") > 1, F.col("instance_id")).otherwise(F.raise_error(F.lit("a sequence has one instance")).cast(threads.schema["instance_id"].dataType)))
    return checked.where("child IS NOT NULL").select("parent", "child")


def to_threads(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(root, pos, instance_id) of chains, by pointer doubling: each round doubles the steps that are known.

    A parent with two children, or a child with two parents, is an error, and so is a cycle.
    """
    if edges.groupBy("parent").count().where("count > 1").limit(1).count() or edges.groupBy("child").count().where("count > 1").limit(1).count():
        raise ValueError("not a set of chains: it branches")
    return _chains(edges, max_rounds).select("root", "pos", "instance_id")


def _chains(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(instance_id, root, pos) of edges that are chains, by pointer doubling; a cycle is an error."""
    nodes = links.select(F.explode(F.array("parent", "child")).alias("instance_id")).distinct()
    up = nodes.join(links.select(F.col("child").alias("instance_id"), "parent"), "instance_id", "left")
    # a node's pointer goes to an ancestor, pos steps up; at a root it stays
    state = stored(up.select("instance_id", F.coalesce("parent", "instance_id").alias("root"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("pos")))
    total = None
    for _ in range(max_rounds):
        above = state.select(F.col("instance_id").alias("root"), F.col("root").alias("root2"), F.col("pos").alias("pos2"))
        state = stored(state.join(above, "root").select("instance_id", F.col("root2").alias("root"), (F.col("pos") + F.col("pos2")).alias("pos")))
        now = state.agg(F.sum(F.col("pos").cast("decimal(38,0)")).alias("total"), F.max("pos").alias("most"), F.count("*").alias("n")).first()
        if now.n and now.most >= now.n:
            break
        before, total = total, now.total
        if total == before:
            return state
    raise ValueError("a cycle")


def topological_levels(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(instance_id, level): longest way from a root; parents come before children.  A cycle is an error.

    Nodes that follow each other with no other edge between them are contracted first, by doubling,
    so a long thread is one node.  What is left is taken off level by level: a round stores its
    frontier and what its children still wait for, and reads what earlier rounds have stored.
    Rounds go with the branching on the longest way, not with its length.
    """
    edges = stored(edges.select("parent", "child").distinct())
    if edges.where(F.col("parent") == F.col("child")).limit(1).count():
        raise ValueError("a cycle")
    only_child = edges.groupBy("parent").agg(F.count("*").alias("n")).where("n = 1").select("parent")
    only_parent = edges.groupBy("child").agg(F.count("*").alias("n")).where("n = 1").select("child")
    links = stored(edges.join(only_child, "parent", "left_semi").join(only_parent, "child", "left_semi").select("parent", "child"))
    chains = _chains(links)
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("instance_id")).distinct()
    member = stored(nodes.join(chains, "instance_id", "left").select("instance_id", F.coalesce("root", "instance_id").alias("root"), F.coalesce("pos", F.lit(0)).cast("long").alias("pos")))
    # edges between chains: from the root of one, over its length, to the root of another
    out = edges.join(links, ["parent", "child"], "left_anti")
    out = out.join(member.withColumnRenamed("instance_id", "parent"), "parent").select(F.col("root").alias("u"), F.col("child").alias("v"), (F.col("pos") + 1).alias("w"))
    out = stored(out.groupBy("u", "v").agg(F.max("w").alias("w")))
    waits = out.groupBy("v").agg(F.count("*").alias("need"))
    roots = member.select(F.col("root").alias("v")).distinct()
    waiting = stored(roots.join(waits, "v", "left").select("v", F.coalesce("need", F.lit(0)).alias("need"), F.lit(0).cast("long").alias("level")))
    spark = edges.sparkSession
    path = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    schema = waiting.select("v", "level").schema
    for k in range(max_rounds):
        waiting.where("need = 0").select("v", "level").write.parquet(f"{path}/round={k}")
        free = spark.read.schema(schema).parquet(f"{path}/round={k}")
        left = waiting.where("need > 0")
        if not left.limit(1).count():
            break
        told = out.join(free.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.count("*").alias("got"), F.max(F.col("level") + F.col("w")).alias("least"))
        if not told.limit(1).count():
            raise ValueError("a cycle")
        waiting = stored(left.join(told, "v", "left").select("v", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"), F.greatest("level", F.coalesce("least", F.lit(0))).alias("level")))
    else:
        raise ValueError("more levels than max_rounds")
    found = spark.read.schema(schema).parquet(*[f"{path}/round={i}" for i in range(k + 1)]).withColumnRenamed("v", "root")
    return member.join(found, "root").select("instance_id", (F.col("level") + F.col("pos")).cast("int").alias("level"))


def slice_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among `ids` (instance_id)."""
    return edges.join(ids.select(F.col("instance_id").alias("parent")), "parent", "left_semi").join(ids.select(F.col("instance_id").alias("child")), "child", "left_semi").select("parent", "child")


def markov_features(threads: DataFrame, class_map: DataFrame, order: int = 1) -> DataFrame:
    """(instance_id, feature, value): the gold classes of the `order` instances before, as features prev<k>:<label>."""
    w = Window.partitionBy("thread_id").orderBy("pos")
    rows = threads.join(class_map, "instance_id")
    before = F.array(*[F.concat(F.lit(f"prev{k}:"), F.coalesce(F.lag("label", k).over(w), F.lit("START"))) for k in range(1, order + 1)])
    return rows.select("instance_id", before.alias("before")).select("instance_id", F.explode("before").alias("feature")).select("instance_id", "feature", F.lit(1).cast("long").alias("value"))


def graph_markov_features(features: DataFrame, edges: DataFrame, class_map: DataFrame, instances: DataFrame, order: int = 1) -> DataFrame:
    """(instance_id, feature, value) of `instances` on any acyclic graph.

    own:<feature>; above:<feature>, summed over the predecessors; prev<k>:<label>, how many of the
    predecessors k steps before have the class, or prev<k>:START where there is none.  `class_map`
    holds gold classes when training, predicted ones when classifying; predecessors without a class count nowhere.
    """
    ids = instances.select("instance_id").distinct()
    own = features.join(ids, "instance_id", "left_semi").select("instance_id", F.concat(F.lit("own:"), "feature").alias("feature"), F.col("value").cast("long").alias("value"))
    up = edges.select(F.col("child").alias("instance_id"), F.col("parent").alias("before")).distinct()
    at = up.join(ids, "instance_id", "left_semi")
    above = at.join(features.withColumnRenamed("instance_id", "before"), "before").groupBy("instance_id", "feature").agg(F.sum("value").cast("long").alias("value"))
    out = own.unionByName(above.select("instance_id", F.concat(F.lit("above:"), "feature").alias("feature"), "value"))
    for k in range(1, order + 1):
        if k > 1:
            at = at.join(up.toDF("before", "_b"), "before").select("instance_id", F.col("_b").alias("before")).distinct()
        counts = at.join(class_map.select(F.col("instance_id").alias("before"), "label"), "before").groupBy("instance_id", "label").agg(F.count("*").alias("value"))
        first = ids.join(at.select("instance_id").distinct(), "instance_id", "left_anti").select("instance_id", F.lit(f"prev{k}:START").alias("feature"), F.lit(1).cast("long").alias("value"))
        out = out.unionByName(counts.select("instance_id", F.concat(F.lit(f"prev{k}:"), "label").alias("feature"), "value")).unionByName(first)
    return out


def markov_classify(features: DataFrame, edges: DataFrame, instances: DataFrame, classify, order: int = 1) -> DataFrame:
    """(instance_id, label): instances in topological order, each with the *predicted* classes of those before it as features.

    `classify` takes features (instance_id, feature, value) and returns (instance_id, label).  All
    instances of a level are classified in one pass; a level's predictions are stored, and the next ones read them.
    """
    spark = features.sparkSession
    alone = instances.select("instance_id").distinct()
    inside = slice_edges(edges, alone)
    levels = stored(alone.join(topological_levels(inside), "instance_id", "left").select("instance_id", F.coalesce("level", F.lit(0)).alias("level")))
    path = f"{shared_dir(spark)}/markov-{uuid.uuid4().hex}"
    done = levels.select("instance_id", F.lit("").alias("label")).limit(0)
    schema = done.schema
    for k in range((levels.agg(F.max("level")).first()[0] or 0) + 1):
        own = levels.where(F.col("level") == k)
        classify(graph_markov_features(features, inside, done, own, order)).select("instance_id", "label").write.parquet(f"{path}/level={k}")
        done = spark.read.schema(schema).parquet(*[f"{path}/level={i}" for i in range(k + 1)])
    return done


def _before(steps: DataFrame, n: int, block: int = 256) -> DataFrame:
    """(thread_id, rn, state): what the functions of the rows before make of state n, for rows (thread_id, rn from 0, f).

    f is an array: the state after a row, by the state before.  Blocks of rows are composed to one
    function each, the blocks' functions go the same way, and then each block is walked from its first
    state.  So a thread of any length is rows, and rounds go with the logarithm of its length.
    """
    item = F.struct("rn", "f")
    blocks = stored(steps.groupBy("thread_id", F.floor(F.col("rn") / block).alias("b")).agg(F.array_sort(F.collect_list(item)).alias("xs")))  # `block` rows at most
    start = blocks.select("thread_id", "b", "xs", F.lit(n).alias("s"))
    if blocks.where("b > 0").limit(1).count():
        same = F.lit(list(range(n + 1)))
        whole = F.aggregate("xs", same, lambda g, x: F.transform(g, lambda v: F.get(x["f"], v)))
        inner = _before(blocks.select("thread_id", F.col("b").alias("rn"), whole.alias("f")), n, block)
        start = blocks.join(inner.withColumnRenamed("rn", "b"), ["thread_id", "b"]).select("thread_id", "b", "xs", F.col("state").alias("s"))
    walk = F.aggregate(
        "xs", F.struct(F.col("s").alias("now"), F.array().cast("array<int>").alias("all")),
        lambda a, x: F.struct(F.get(x["f"], a["now"]).alias("now"), F.concat(a["all"], F.array(a["now"])).alias("all")), lambda a: a["all"],
    )
    return start.select("thread_id", F.explode(F.arrays_zip(F.col("xs.rn").alias("rn"), walk.alias("state"))).alias("r")).select("thread_id", "r.rn", "r.state")


def markov_decode(scores: DataFrame, transitions: dict[tuple[str, str], float], labels: list[str]) -> DataFrame:
    """(instance_id, label): classes in thread order, each scored with the predicted class before it; ties by label.

    `scores`: (thread_id, pos, instance_id, label, score).  What is decided at a place depends on
    the decision before only, so each place is a function from class to class, and those are
    composed by blocks; no task or row holds a thread.
    """
    steps = scores.groupBy("thread_id", "pos", "instance_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("s"))
    numbered = row_numbers(steps, [F.col("pos"), F.col("instance_id")], ["thread_id"]).withColumn("rn", F.col("rn") - 1)
    own = [F.coalesce(F.try_element_at("s", F.lit(x)), F.lit(-1e300)) for x in labels]

    def after(before: str):
        options = [F.struct((-(v + float(transitions.get((before, x), 0.0)))).alias("cost"), F.lit(x).alias("label"), F.lit(i).alias("i")) for i, (x, v) in enumerate(zip(labels, own))]
        return F.array_min(F.array(*options))["i"]

    f = F.array(*[after(x) for x in [*labels, "START"]])
    rows = stored(numbered.select("thread_id", "rn", "instance_id", f.alias("f")))
    states = _before(rows.select("thread_id", "rn", "f"), len(labels))
    return rows.join(states, ["thread_id", "rn"]).select("instance_id", F.get(F.lit(labels), F.get("f", F.col("state"))).alias("label"))
