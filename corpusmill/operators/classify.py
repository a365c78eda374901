"""Learners: each makes model tables from (features, class_map, split) and scores (instance_id, label, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .splits import chance, hash_rank

#: numbers in a model that is broadcast
MOST_BROADCAST = 1 << 22


def nb_counts(features: DataFrame, class_map: DataFrame, fold_of: DataFrame, boolean: bool = False) -> DataFrame:
    """(test_fold, label, feature, n): what naive Bayes learns from each fold's instances, once for all folds."""
    return nb_counts_of_both(in_folds(features, fold_of), class_map).select("test_fold", "label", "feature", F.col("b" if boolean else "n").alias("n"))


def in_folds(features: DataFrame, fold_of: DataFrame) -> DataFrame:
    """Features with test_fold, the fold that tests their instance; where they have it already, as they are."""
    return features if "test_fold" in features.columns else features.join(fold_of, "instance_id")


def nb_counts_of_both(features: DataFrame, class_map: DataFrame) -> DataFrame:
    """(test_fold, label, feature, n, b) of in_folds(): counts for multinomial and for boolean naive Bayes, in one pass."""
    return features.join(class_map, "instance_id").groupBy("test_fold", "label", "feature").agg(F.sum("value").alias("n"), F.sum(F.least(F.col("value"), F.lit(1))).alias("b"))


def naive_bayes_cv(features: DataFrame, class_map: DataFrame, fold_of: DataFrame, boolean: bool = False, uniform_prior: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Cross-validated multinomial naive Bayes: (fold, instance_id, label, score), a row for each used class.

    score = prior + sum_f x_f ln(1 + N_fc) - |d| ln(V + N_c), all from one table of counts: training
    counts of fold k are the totals less fold k's own.  The model has one row for each feature, with
    two arrays: totals by class, and counts by fold and class.  So features are joined once, by
    feature alone, and a row's terms of all classes are added up without being multiplied out.
    V: features of the whole space.  Several learners on one table share in_folds() and nb_counts_of_both(), stored, as `features` and `counts`.
    """
    fold_of = stored(fold_of)
    cells = stored(counts if counts is not None else nb_counts(features, class_map, fold_of, boolean))
    folds = fold_of.select(F.col("test_fold").alias("fold")).distinct()
    labelled = class_map.join(fold_of, "instance_id")
    n_docs = labelled.groupBy("label", "test_fold").agg(F.count("*").alias("d"))
    n_words = cells.groupBy("label", "test_fold").agg(F.sum("n").alias("w"))
    size = cells.select("feature").distinct().agg(F.count("*").alias("v"))
    both = n_docs.join(n_words, ["label", "test_fold"], "full")
    every = folds.crossJoin(both.groupBy("label").agg(F.sum("d").alias("td"), F.coalesce(F.sum("w"), F.lit(0)).alias("tw")))
    own = both.select("label", F.col("test_fold").alias("fold"), "d", "w")
    classes = every.join(own, ["label", "fold"], "left").select("fold", "label", (F.col("td") - F.coalesce("d", F.lit(0))).alias("d"), (F.col("tw") - F.coalesce("w", F.lit(0))).alias("w")).where("d > 0")
    prior = F.lit(0.0) if uniform_prior else F.ln("d")
    classes = classes.crossJoin(size).select("fold", "label", prior.alias("prior"), F.ln(F.col("v") + F.col("w")).alias("norm"))
    # classes and folds are small closed spaces
    labels = sorted(r.label for r in class_map.select("label").distinct().collect() if r.label is not None)
    places = sorted(r.fold for r in folds.collect())
    class_at = F.array_position(F.lit(labels), F.col("label")) - 1
    fold_at = (F.array_position(F.lit(places), F.col("test_fold")) - 1) * len(labels)
    model = cells.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct((fold_at + class_at).cast("int"), "n"))).alias("m"))
    per_fold = F.transform(F.sequence(F.lit(0), F.lit(len(places) * len(labels) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    model = model.select("feature", per_fold.alias("own"))
    totals = F.array(*[sum((F.get("own", F.lit(k * len(labels) + c)) for k in range(1, len(places))), F.get("own", F.lit(c))) for c in range(len(labels))])
    model = model.select("feature", "own", totals.alias("total"))
    x = in_folds(features, fold_of).select("instance_id", "feature", F.col("value").cast("double").alias("x"), "test_fold")
    # each class's training count: the total less the own fold's
    terms = [F.col("x") * F.ln(1 + F.get("total", F.lit(c)) - F.get("own", fold_at.cast("int") + c)) for c in range(len(labels))]
    # a small model goes to the cells, else the cells to the model
    if size.first().v * len(labels) * (len(places) + 1) <= MOST_BROADCAST:
        model = F.broadcast(model)
    sums = x.join(model, "feature", "left").groupBy(F.col("test_fold").alias("fold"), "instance_id").agg(F.sum("x").alias("len"), *[F.sum(t).alias(f"s{c}") for c, t in enumerate(terms)])
    rows = sums.select("fold", "instance_id", "len", F.explode(F.map_from_arrays(F.lit(labels), F.array(*[F.coalesce(f"s{c}", F.lit(0.0)) for c in range(len(labels))]))).alias("label", "s"))
    return rows.join(F.broadcast(classes), ["fold", "label"]).select("fold", "instance_id", "label", (F.col("prior") + F.col("s") - F.col("len") * F.col("norm")).alias("score"))


def nb_model(features: DataFrame, class_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model tables of one training set: (feature, label, l) and (label, prior, norm)."""
    # one pass over the features: what instances without a class have counts for the space only
    every = stored(features.join(class_map.withColumn("_own", F.lit(True)), "instance_id", "left").groupBy("label", "_own", "feature").agg(F.sum("value").alias("n")))
    cells = every.where("_own").drop("_own")
    size = every.select("feature").distinct().agg(F.count("*").alias("v"))
    docs = class_map.groupBy("label").agg(F.count("*").alias("d"))
    words = cells.groupBy("label").agg(F.sum("n").alias("w"))
    classes = docs.join(words, "label", "left").crossJoin(size).select("label", F.ln("d").alias("prior"), F.ln(F.col("v") + F.coalesce("w", F.lit(0))).alias("norm"))
    return cells.select("feature", "label", F.ln(1.0 + F.col("n")).alias("l")), classes


def nb_predict(model: tuple[DataFrame, DataFrame], features: DataFrame) -> DataFrame:
    """(instance_id, label, score); features that the model doesn't know are dropped, and count for nothing.

    The model has one row for each feature, with an array by class, so features are joined once, and a small model goes to them.
    """
    cells, classes = model
    # classes are a small closed space
    labels = sorted(r.label for r in classes.select("label").collect() if r.label is not None)
    place = (F.array_position(F.lit(labels), F.col("label")) - 1).cast("int") if labels else F.lit(None).cast("int")
    wide = cells.where("label IS NOT NULL").groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("c"), "l"))).alias("m"))
    wide = stored(wide.select("feature", *[F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)).alias(f"l{c}") for c in range(len(labels))], F.lit(True).alias("known")))
    if wide.count() * (len(labels) + 1) <= MOST_BROADCAST:
        wide = F.broadcast(wide)
    x = features.join(wide, "feature", "left")
    sums = x.groupBy("instance_id").agg(F.sum(F.when(F.col("known"), F.col("value"))).alias("len"), *[F.sum(F.col("value") * F.col(f"l{c}")).alias(f"s{c}") for c in range(len(labels))])
    sums = sums.select("instance_id", "len", F.array(*[F.col(f"s{c}") for c in range(len(labels))]).cast("array<double>").alias("s"))
    grid = sums.crossJoin(F.broadcast(classes.select("label", "prior", "norm", place.alias("c"))))  # a row for each class
    return grid.select(
        "instance_id", "label", (F.col("prior") + F.coalesce(F.get("s", F.col("c")), F.lit(0.0)) - F.coalesce("len", F.lit(0)) * F.col("norm")).alias("score")
    )


def nb_nodes(train: DataFrame, class_map: DataFrame, branches: DataFrame, test: DataFrame, at: DataFrame) -> DataFrame:
    """(instance_id, node, branch, score): naive Bayes for many small tasks at once, each the choice of a branch at a node.

    `branches`: (node, label, branch), a small table: which branch instances of a class train at a
    node; classes that it lacks there don't train it.  `at`: (instance_id, node) to be scored.
    V counts the features of the whole training part; features that a node doesn't know are dropped.
    """
    size = train.select("feature").distinct().agg(F.count("*").alias("v"))
    rows = class_map.join(F.broadcast(branches), "label").select("instance_id", "node", "branch").distinct()
    docs = rows.groupBy("node", "branch").agg(F.count("*").alias("d"))
    cells = train.join(rows, "instance_id").groupBy("node", "branch", "feature").agg(F.sum("value").alias("n"))
    words = cells.groupBy("node", "branch").agg(F.sum("n").alias("w"))
    classes = docs.join(words, ["node", "branch"], "left").crossJoin(F.broadcast(size)).select("node", "branch", F.ln("d").alias("prior"), F.ln(F.col("v") + F.coalesce("w", F.lit(0))).alias("norm"))
    # branches are a small table: the model has one row for each feature, with a number for each of them, so test features are joined
    # once, by feature alone, and summed up for all nodes in one row of an instance
    pairs = sorted({(r.node, r.branch) for r in branches.select("node", "branch").collect()})
    nodes = sorted({n for n, _ in pairs})
    place = (F.array_position(F.lit([f"{n}\x00{b}" for n, b in pairs]), F.concat_ws("\x00", "node", "branch")) - 1).cast("int")
    model = cells.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("p"), F.ln(1 + F.col("n")).alias("l")))).alias("m"))
    model = stored(model.select("feature", *[F.try_element_at("m", F.lit(p)).alias(f"l{p}") for p in range(len(pairs))]))
    if model.count() * (len(pairs) + 1) <= MOST_BROADCAST:
        model = F.broadcast(model)
    known = {n: F.coalesce(*[F.col(f"l{p}") for p, (own, _) in enumerate(pairs) if own == n]).isNotNull() for n in nodes}
    sums = test.join(model, "feature").groupBy("instance_id").agg(
        *[F.sum(F.col("value") * F.col(f"l{p}")).alias(f"s{p}") for p in range(len(pairs))], *[F.sum(F.when(known[n], F.col("value"))).alias(f"n{i}") for i, n in enumerate(nodes)],
    )
    sums = sums.select("instance_id", F.array(*[f"s{p}" for p in range(len(pairs))]).alias("s"), F.array(*[F.col(f"n{i}").cast("double") for i in range(len(nodes))]).alias("lens"))
    at_node = (F.array_position(F.lit(nodes), F.col("node")) - 1).cast("int")
    grid = at.join(sums, "instance_id", "left").join(F.broadcast(classes.withColumn("_p", place)), "node")
    score = F.col("prior") + F.coalesce(F.get("s", F.col("_p")), F.lit(0.0)) - F.coalesce(F.get("lens", at_node), F.lit(0.0)) * F.col("norm")
    return grid.select("instance_id", "node", "branch", score.alias("score"))


def tree_branches(tree: dict, root: str = "root") -> list[tuple[int, str, str, str]]:
    """(level, node, label, branch) of a tree of nested dicts whose leaves are lists of labels; a branch is a node's name or a label."""
    rows = []

    def leaves(part):
        return sorted(part) if not isinstance(part, dict) else sorted(x for own in part.values() for x in leaves(own))

    def walk(level, node, part):
        if isinstance(part, dict):
            for name, own in part.items():
                rows.extend((level, node, label, name) for label in leaves(own))
                walk(level + 1, name, own)
        else:
            rows.extend((level, node, label, label) for label in part)

    walk(0, root, tree)
    return rows


def class_tree(train: DataFrame, class_map: DataFrame, test: DataFrame, tree: dict, root: str = "root") -> DataFrame:
    """(instance_id, node): every node and, last, the leaf that each test instance is routed to, by naive Bayes at each node.

    One pass for each level of the tree: all of its nodes are trained at once, by grouping on the
    node, and instances move on to the branch with the highest score (ties by name).
    """
    spark, rows = train.sparkSession, tree_branches(tree, root)
    inner = sorted({r[1] for r in rows})
    at = test.select("instance_id").distinct().select("instance_id", F.lit(root).alias("node"))
    every = at
    for level in range(1 + max(r[0] for r in rows)):
        branches = spark.createDataFrame([r[1:] for r in rows if r[0] == level], "node string, label string, branch string")
        scores = nb_nodes(train, class_map, branches, test, at)
        best = scores.groupBy("instance_id", "node").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "branch")).alias("b"))
        moved = stored(best.select("instance_id", F.col("b.branch").alias("node")))
        every = every.unionByName(moved)
        at = moved.where(F.col("node").isin(inner))
    return every


def node_analysis(gold: DataFrame, routed: DataFrame) -> DataFrame:
    """(node, n_gold, n_routed, n_both) from two tables (instance_id, node)."""
    both = gold.withColumn("g", F.lit(1)).join(routed.withColumn("r", F.lit(1)), ["instance_id", "node"], "full")
    return both.groupBy("node").agg(F.count("g").alias("n_gold"), F.count("r").alias("n_routed"), F.count(F.when(F.col("g").isNotNull() & F.col("r").isNotNull(), 1)).alias("n_both"))


def probabilities(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Scores as shares: softmax over the classes of an instance."""
    w = Window.partitionBy(*keys)
    e = scores.withColumn("_e", F.exp(F.col("score") - F.max("score").over(w)))
    return e.withColumn("score", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def kl_prototype(train: DataFrame, class_map: DataFrame, test: DataFrame) -> DataFrame:
    """(instance_id, label, dist): divergence of the class's smoothed distribution from the test text's, the lowest is best.

    Theta, the global distribution, is learned on the training part.  A text or class with N words
    of which h occur once gives away alpha = min(max(h, 1) / N, 1/2) to unseen features, shared in
    proportion to theta.  Sparse form: only features of the text are joined.
    """
    space = train.groupBy("feature").agg(F.sum("value").cast("double").alias("t"))
    theta = space.crossJoin(space.agg(F.sum("t").alias("all_t"))).select("feature", (F.col("t") / F.col("all_t")).alias("theta"))

    def smoothed(table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        rows = table.join(theta, "feature")
        total = rows.groupBy(key).agg(
            F.sum("value").cast("double").alias("n"), F.sum(F.when(F.col("value") == 1, 1).otherwise(0)).alias("once"), (1 - F.sum("theta")).alias("u"),
        )
        rest = F.when(F.col("u") > 1e-12, F.least(F.greatest("once", F.lit(1)) / F.col("n"), F.lit(0.5))).otherwise(0.0)
        total = total.select(key, "n", F.greatest("u", F.lit(0.0)).alias("u"), rest.alias("a"))
        return rows.select(key, "feature", "theta", F.col("value").cast("double").alias("x")), total

    sums = train.join(class_map, "instance_id").groupBy("label", "feature").agg(F.sum("value").alias("value"))
    c, tc = smoothed(sums, "label")
    d, td = smoothed(test, "instance_id")
    p = c.join(tc, "label").select("label", "feature", "theta", ((1 - F.col("a")) * F.col("x") / F.col("n")).alias("p"), "a", "u")
    # sum_f p_f ln p_f, unseen ones in closed form; and sum_f p_f ln theta_f
    unseen_theta = theta.agg(F.sum(F.col("theta") * F.ln("theta")).alias("all_tl"))
    own = p.groupBy("label").agg(
        F.sum(F.col("p") * F.ln("p")).alias("h"), F.sum(F.col("p") * F.ln("theta")).alias("pl"), F.sum(F.col("theta") * F.ln("theta")).alias("seen_tl"),
        F.max("a").alias("a"), F.max("u").alias("u"), F.sum("p").alias("mass"),
    ).crossJoin(unseen_theta)
    scale = F.when(F.col("u") > 1e-12, F.col("a") / F.col("u")).otherwise(0.0)
    unseen = F.col("all_tl") - F.col("seen_tl")
    own = own.select(
        "label", scale.alias("k"),
        (F.col("h") + scale * unseen + F.when(scale > 0, F.col("a") * F.ln(scale)).otherwise(0.0)).alias("entropy"),
        (F.col("pl") + scale * unseen).alias("base"),
    )
    q = d.join(td, "instance_id").select(
        "instance_id", "feature", "theta", ((1 - F.col("a")) * F.col("x") / F.col("n")).alias("q"), F.when(F.col("u") > 1e-12, F.col("a") / F.col("u")).otherwise(0.0).alias("kd")
    )
    gain = F.ln("q") - F.ln("theta") - F.when(F.col("kd") > 0, F.ln("kd")).otherwise(0.0)
    rows = q.select("instance_id", "feature", "theta", gain.alias("g"))
    # p of a feature that the class lacks is theta times k
    lacking = rows.groupBy("instance_id").agg(F.sum(F.col("theta") * F.col("g")).alias("tg"))
    shared = rows.join(p.select("label", "feature", "p"), "feature").groupBy("instance_id", "label").agg(
        F.sum(F.col("p") * F.col("g")).alias("pg"), F.sum(F.col("theta") * F.col("g")).alias("tg_shared")
    )
    grid = lacking.join(td.select("instance_id", F.when(F.col("u") > 1e-12, F.col("a") / F.col("u")).otherwise(0.0).alias("kd")), "instance_id").crossJoin(F.broadcast(own))
    got = grid.join(shared, ["instance_id", "label"], "left")
    cross = F.col("base") + F.when(F.col("kd") > 0, F.ln("kd")).otherwise(0.0) + F.coalesce("pg", F.lit(0.0)) + F.col("k") * (F.col("tg") - F.coalesce("tg_shared", F.lit(0.0)))
    return got.select("instance_id", "label", (F.col("entropy") - cross).alias("dist"))


def class_shares(class_map: DataFrame) -> DataFrame:
    """(label, share) of memberships."""
    n = class_map.groupBy("label").agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("_all"))).select("label", (F.col("n") / F.col("_all")).alias("share"))


def uniform(test: DataFrame, class_space: DataFrame) -> DataFrame:
    k = class_space.agg(F.count("*").alias("k"))
    return test.select("instance_id").crossJoin(F.broadcast(class_space.select("label").crossJoin(k))).select("instance_id", "label", (1 / F.col("k")).alias("score"))


def prior(test: DataFrame, class_map: DataFrame) -> DataFrame:
    return test.select("instance_id").crossJoin(F.broadcast(class_shares(class_map))).select("instance_id", "label", F.col("share").alias("score"))


def majority(test: DataFrame, class_map: DataFrame, n: int = 1) -> DataFrame:
    """(instance_id, label) of the n most frequent classes for every test instance."""
    top = class_map.groupBy("label").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "label").limit(n)
    return test.select("instance_id").crossJoin(F.broadcast(top.select("label")))


def random_label(test: DataFrame, class_map: DataFrame, seed: str = "random") -> DataFrame:
    """(instance_id, label): the labels of a training instance drawn by hash."""
    ids = class_map.select("instance_id").distinct()
    ranked = hash_rank(ids.withColumn("_g", F.lit(1)), ["_g"], chance(seed, "instance_id"), "instance_id").select(F.col("instance_id").alias("train_id"), (F.col("rn") - 1).alias("place"))
    n = ids.agg(F.count("*").alias("n_train"))
    drawn = test.select("instance_id", F.conv(F.substring(chance(seed + "-draw", "instance_id"), 1, 8), 16, 10).cast("long").alias("_h")).crossJoin(n)
    drawn = drawn.select("instance_id", (F.col("_h") % F.col("n_train")).alias("place")).join(ranked, "place")
    return drawn.join(class_map.withColumnRenamed("instance_id", "train_id"), "train_id").select("instance_id", "label")
