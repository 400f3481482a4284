"""Trees as tables: the nodes of a fitted forest, and an evaluator that walks them with column expressions.

A node table (tree, node, feature, cut, left, right, value) has nodes 0, 1, 2, ... in each tree, 0 the root; a leaf has feature -1. A row goes left where its
feature is at most the cut. The evaluator knows nothing of how the trees were fitted, so it checks what fitted models say of each row.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickscope.sources.workdir import new_path

NODE_COLUMNS = ("node", "feature", "cut", "left", "right", "value")
NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, value double"
#: What is shipped to every task at most.
MOST_NODES = 1 << 20


def saved_nodes(spark: SparkSession, forest) -> DataFrame:
    """Nodes of a fitted classifier with two classes, from the table that Spark saves; the value of a leaf is its share of class 1."""
    path = new_path(spark, "forest")
    forest.write().save(path)
    n = F.col("nodeData")
    share = F.try_divide(n["impurityStats"][1], F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x))
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"),
        F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("cut"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        share.alias("value"), n["gain"].alias("gain"), n["rawCount"].alias("rows"))


def importances(nodes: DataFrame, impurity_rows: str = "rows") -> DataFrame:
    """(feature, importance): gains weighted by the rows of their nodes, shares per tree, then of all trees."""
    gain = nodes.where("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col(impurity_rows)).alias("g"))
    whole = gain.groupBy("tree").agg(F.sum("g").alias("t"))
    each = gain.join(whole, "tree").groupBy("feature").agg(F.sum(F.try_divide("g", "t")).alias("s"))
    return each.select("feature", (F.col("s") / each.agg(F.sum("s")).scalar()).alias("importance"))


def walk(rows: DataFrame, nodes: DataFrame, x: Column, key: str, depth: int) -> DataFrame:
    """(key, value): mean over all trees of the value where the row with features ``x`` (an array) ends.

    Every row meets every tree, whose nodes come as one array; ``depth`` is at least that of the deepest tree. The node table is shipped to the tasks, so it
    is counted first.
    """
    names = [r["tree"] for r in nodes.groupBy("tree").count().orderBy("tree").limit(MOST_NODES + 1).collect()]
    if nodes.count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    table = nodes.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct(*NODE_COLUMNS))).alias("_nodes"))
    each = rows.select(key, x.alias("_x"), F.explode(F.lit(names)).alias("tree")).join(F.broadcast(table), "tree")

    def step(at: Column) -> Column:
        here = F.get("_nodes", at)
        down = F.when(F.get("_x", here["feature"]) <= here["cut"], here["left"]).otherwise(here["right"])
        return F.when(here["feature"] >= 0, down).otherwise(at)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda at, _: step(at))
    return each.select(key, F.get("_nodes", end)["value"].alias("value")).groupBy(key).agg(F.avg("value").alias("value"))


def midpoint_forest(train: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """A forest without chance: tree i cuts columns 2i and 2i + 1 in the middle of their range in ``train``; a leaf's value is the share of label 1 in it, a half
    where it is empty. A baseline that every engine fits alike."""
    pairs = [(i, columns[2 * i], columns[2 * i + 1]) for i in range(len(columns) // 2)]
    cut = train.agg(*[((F.min(c) + F.max(c)) / 2).alias(c) for c in columns]).first()
    sides = F.array(*[F.struct(F.lit(i).alias("tree"), (F.when(F.col(a) <= cut[a], 0).otherwise(2) + F.when(F.col(b) <= cut[b], 0).otherwise(1)).alias("leaf"))
                      for i, a, b in pairs])
    shares = {(r["tree"], r["leaf"]): r["share"] for r in train.select(label, F.inline(sides)).groupBy("tree", "leaf").agg(F.avg(F.col(label).cast("double")).alias("share")).collect()}
    nodes = []
    for i, a, b in pairs:
        nodes += [(i, 0, 2 * i, cut[a], 1, 2, None), (i, 1, 2 * i + 1, cut[b], 3, 4, None), (i, 2, 2 * i + 1, cut[b], 5, 6, None)]
        nodes += [(i, 3 + leaf, -1, None, -1, -1, float(shares.get((i, leaf), 0.5))) for leaf in range(4)]
    return train.sparkSession.createDataFrame(nodes, NODE_SCHEMA)
