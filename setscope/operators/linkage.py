"""Complete-linkage trees over model centroids, their cuts and leaf orders.

Several trees are built in one run, told apart by key columns (for example
``analysis_type``). A tree grows in rounds of reciprocal nearest neighbours:
complete linkage is reducible, so all pairs of clusters that are each other's
nearest neighbour can merge in one round, and the tree is the one of
one-at-a-time merging. Ties are broken by the total order (distance, smaller
id, larger id), so each round merges at least one pair of every unfinished
tree. The state of a round is one small table of the pairs left and the merges
made, written once under ``spark.checkpoint.dir``; the number of pairs left is
observed while it is written.

Merges are numbered like a standard linkage matrix: leaves are 0..n-1, the
merge at step s creates node n + s, steps are sorted by height, and the left
child is the smaller node id.

The pair table holds n(n-1)/2 rows per tree. It is distributed and has no
bound of its own; the jobs feed a model's centroids (n = k).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from setscope.session import materialize, scratch_folder


def centroid_frame(spark: SparkSession, centers, **tags) -> DataFrame:
    """(tags..., node, vector array<double>) of a model's cluster centres."""
    rows = [(*tags.values(), i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, ", ".join([*(f"{t} string" for t in tags), "node int, vector array<double>"]))


def _euclid(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda s, v: s + v))


def _written(df: DataFrame, path: str, by: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Write ``df`` once and read it back, with its number of open rows (kind 0, or all)."""
    seen = Observation()
    open_rows = F.count(F.when(F.col("kind") == 0, 1)) if "kind" in df.columns else F.count(F.lit(1))
    df.observe(seen, open_rows.alias("n")).write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def complete_linkage(points: DataFrame, n: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., step, left, right, height, size): merges of complete linkage on every tree's points.

    ``points`` is (keys..., node int 0..n-1, vector array<double>), the same
    n for all trees; a tree of one point has no merges.
    """
    spark = points.sparkSession
    if n is None:
        n = points.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    by = ["tree"]
    pts = points.select(F.struct(*keys, F.lit(0).alias("_")).alias("tree"), F.col("node").cast("int").alias("node"), "vector")
    # every unordered pair once: each node lists the larger ids, then fetches their vectors
    pairs = (pts.filter(F.col("node") < n - 1)
             .select("tree", F.col("node").alias("a"), F.col("vector").alias("va"),
                     F.explode(F.sequence(F.col("node") + 1, F.lit(n - 1))).alias("b"))
             .join(pts.select("tree", F.col("node").alias("b"), F.col("vector").alias("vb")), ["tree", "b"])
             .select(F.lit(0).alias("kind"), "tree", "a", "b", _euclid(F.col("va"), F.col("vb")).alias("d"),
                     F.lit(1).alias("sa"), F.lit(1).alias("sb")))
    base = f"{scratch_folder(spark, 'linkage')}"
    state, left = _written(pairs, f"{base}/round=0")
    rounds = 0
    while left:
        rounds += 1
        open_pairs = state.filter("kind = 0").drop("kind")
        state, left = _written(_round(open_pairs, by), f"{base}/round={rounds}")
    merges = spark.read.option("basePath", base).parquet(base).filter("kind = 1").select(
        "tree", "round", F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("d").alias("height"),
        F.col("sa").alias("size"))
    return _number_merges(merges, n).select(*[F.col("tree")[k].alias(k) for k in keys],
                                            "step", "left", "right", "height", "size")


def _round(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs left (kind 0) and merges (kind 1) after all reciprocal nearest neighbours of ``pairs`` merge.

    A cluster is named by its smallest leaf; pair rows carry both sizes.
    """
    sides = pairs.select("tree", "d", F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v"), (F.col("sa") + F.col("sb")).alias("size")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v"), (F.col("sa") + F.col("sb")).alias("size")))).alias("s"))
    near = sides.groupBy("tree", F.col("s.u").alias("u")).agg(F.min(F.struct(
        "d", F.least("s.u", "s.v").alias("lo"), F.greatest("s.u", "s.v").alias("hi"), F.col("s.size").alias("size"))).alias("m"))
    # both ends of a merging pair name it as their nearest one
    steps = (near.groupBy("tree", F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"))
             .agg(F.count(F.lit(1)).alias("ends"), F.first("m").alias("m")).filter("ends = 2")
             .select("tree", "lo", "hi", "m.d", "m.size"))
    moves = steps.select("tree", F.explode(F.array("lo", "hi")).alias("from"), F.col("lo").alias("to"), "size")
    ma, mb = moves.select("tree", F.col("from").alias("a"), F.col("to").alias("ta"), F.col("size").alias("za")), \
        moves.select("tree", F.col("from").alias("b"), F.col("to").alias("tb"), F.col("size").alias("zb"))
    moved = (pairs.join(ma, [*by, "a"], "left").join(mb, [*by, "b"], "left")
             .select("tree", F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), "d",
                     F.coalesce("za", "sa").alias("sa"), F.coalesce("zb", "sb").alias("sb"))
             .filter("a <> b"))
    ordered = F.col("a") < F.col("b")
    kept = (moved.select("tree", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d",
                         F.when(ordered, F.col("sa")).otherwise(F.col("sb")).alias("sa"),
                         F.when(ordered, F.col("sb")).otherwise(F.col("sa")).alias("sb"))
            .groupBy("tree", "a", "b").agg(F.max("d").alias("d"), F.max("sa").alias("sa"), F.max("sb").alias("sb")))
    return kept.select(F.lit(0).alias("kind"), "tree", "a", "b", "d", "sa", "sb").unionByName(
        steps.select(F.lit(1).alias("kind"), "tree", F.col("lo").alias("a"), F.col("hi").alias("b"), "d",
                     F.col("size").alias("sa"), F.lit(0).alias("sb")))


def _number_merges(merges: DataFrame, n: int) -> DataFrame:
    """Sort each tree's merges by height (children first on ties) and give node ids n + step."""
    tree = Window.partitionBy("tree")
    steps = merges.withColumn("step", (F.row_number().over(tree.orderBy("height", "round", "ra")) - 1).cast("int"))
    # the node of a representative: the last merge it led before this one, else its leaf
    led = Window.partitionBy("tree", "ra").orderBy("step")
    last = steps.groupBy("tree", F.col("ra").alias("rb")).agg(F.max("step").alias("last_b"))
    return (steps.withColumn("last_a", F.lag("step").over(led)).join(last, ["tree", "rb"], "left")
            .withColumn("ca", F.coalesce(F.col("last_a") + n, F.col("ra")))
            .withColumn("cb", F.coalesce(F.col("last_b") + n, F.col("rb")))
            .select("tree", "step", F.least("ca", "cb").cast("int").alias("left"),
                    F.greatest("ca", "cb").cast("int").alias("right"), F.col("height").cast("double").alias("height"),
                    F.col("size").cast("int").alias("size")))


def tree_members(merges: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., node, step, is_right): every leaf with the merges above it, and the side it lies on.

    The ancestor relation is closed by joining it with itself, which doubles
    the height it covers, so a tree of height h takes about log2(h) rounds.
    """
    keys = list(keys)
    edges = materialize(merges.select(*keys, F.explode(F.array(
        F.struct(F.col("left").alias("child"), F.lit(False).alias("is_right")),
        F.struct(F.col("right").alias("child"), F.lit(True).alias("is_right")))).alias("e"),
        "step", (F.col("step") + n).alias("parent")).select(*keys, "e.child", "e.is_right", "step", "parent"), "edges")
    spark = merges.sparkSession
    base = scratch_folder(spark, "ancestors")
    above, count = _written(edges.select(*keys, F.col("child").alias("x"), F.col("parent").alias("y")), f"{base}/0")
    before, rounds = -1, 0
    while count != before:
        before, rounds = count, rounds + 1
        further = above.join(above.select(*keys, F.col("x").alias("y"), F.col("y").alias("z")), [*keys, "y"])
        above, count = _written(above.unionByName(further.select(*keys, "x", F.col("z").alias("y"))).distinct(),
                                f"{base}/{rounds}")
    # a leaf lies under a merge on the side of the child it is, or is below
    own = edges.select(*keys, F.col("child").alias("x"), F.col("child").alias("y"))
    return (above.unionByName(own).filter(F.col("x") < n)
            .join(edges.select(*keys, F.col("child").alias("y"), "step", "is_right"), [*keys, "y"])
            .select(*keys, F.col("x").cast("int").alias("node"), "step", "is_right"))


def cut_trees(merges: DataFrame, n: int, ts: Sequence[int], keys: Sequence[str] = (),
              members: DataFrame | None = None) -> DataFrame:
    """(keys..., t, node, cluster): flat clusters 1..c of the leaves, at most ``t`` groups, for every t.

    The threshold of a cut is the smallest merge height that leaves at most t
    groups; every merge at or below it is applied, so equal heights may leave
    fewer than t. With t >= n each leaf is its own group. Groups are numbered
    by their smallest leaf. A leaf's group is named by the last applied merge
    above it, so all cuts come from the step order in one aggregate.
    ``members`` are the ``tree_members``, if the caller has them.
    """
    keys = list(keys)
    spark = merges.sparkSession
    ts = sorted({int(t) for t in ts})
    members = tree_members(merges, n, keys) if members is None else members
    # without keys the one tree is keyed by a value that is 0 for every step, so the join stays an equi join
    one = keys or ["_tree"]
    heights = merges.select(*keys, "step", "height", *([] if keys else [F.pmod(F.xxhash64("step"), F.lit(1)).alias("_tree")]))
    cuts = heights.select(*one, "height", F.explode(F.filter(
        F.array(*map(F.lit, ts)), lambda t: F.lit(n - 1) - t == F.col("step"))).alias("t")).groupBy(*one).agg(
        F.collect_list(F.struct("t", F.col("height").alias("most"))).alias("cuts"))
    placed = members.join(heights, [*keys, "step"]).join(cuts, one)
    applied = placed.select(*keys, "node", "step", F.explode(F.filter(
        "cuts", lambda c: c["most"] >= F.col("height"))["t"]).alias("t"))
    last = applied.groupBy(*keys, "t", "node").agg(F.max("step").alias("last"))
    trees = merges.select(*keys).distinct() if keys else spark.range(1)
    leaves = trees.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("node")).select(
        *keys, "node", F.explode(F.array(*map(F.lit, ts))).alias("t"))
    rooted = leaves.join(last, [*keys, "t", "node"], "left").withColumn(
        "root", F.coalesce(F.col("last") + n, F.col("node")))
    first = rooted.groupBy(*keys, "t", "root").agg(F.min("node").alias("first"))
    numbered = first.withColumn("cluster", F.row_number().over(Window.partitionBy(*keys, "t").orderBy("first")).cast("int"))
    return rooted.join(numbered, [*keys, "t", "root"]).select(*keys, "t", "node", "cluster")


def cut_tree(merges: DataFrame, n: int, t: int) -> DataFrame:
    """(node, cluster) for one cut of one tree; see ``cut_trees``."""
    return cut_trees(merges, n, [t]).drop("t")


def leaf_order(merges: DataFrame, n: int, keys: Sequence[str] = (), members: DataFrame | None = None) -> DataFrame:
    """(keys..., position, node): leaves in dendrogram order, left (smaller id) subtree first.

    A leaf's position is the sum, over the merges it lies in on the right, of
    the leaves on the left.
    """
    keys = list(keys)
    spark = merges.sparkSession
    if n == 1:
        return spark.createDataFrame([(0, 0)], "position int, node int")
    members = tree_members(merges, n, keys) if members is None else members
    left = members.groupBy(*keys, "step").agg(F.count(F.when(~F.col("is_right"), 1)).alias("before"))
    return (members.join(left, [*keys, "step"]).groupBy(*keys, "node")
            .agg(F.sum(F.when(F.col("is_right"), F.col("before")).otherwise(0)).cast("int").alias("position"))
            .select(*keys, "position", "node"))
