"""The repository graph: overlap edges, folding, neighbours, clusters, components, paths and rings."""

from __future__ import annotations

import functools
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.bots import is_bot_sql
from weftline.operators import tiles as T
from weftline.operators.filters import restrict, unused


def _count():
    return F.count(F.lit(1))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage between rounds with a reliable checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own if all run in this machine's one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_weftline_folder", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-weftline-")
        spark.sparkContext._weftline_folder = folder
    return folder.rstrip("/")


def passing_folder(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder; what is written there goes when the application ends."""
    folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(passing_folder(spark, "checkpoints"))


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: read again, it is pruned and filtered at the scan."""
    folder = passing_folder(df.sparkSession, what)
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table._folder = folder
    return table


def removed(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._folder)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stands(table: DataFrame) -> bool:
    """Whether the folder of a table of ``written`` is still there."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


#: Side of a tile of the self-join, of whose square it has as many pairs, about; blocks at most, for so often are links shuffled; links of a block at most, for two
#: are in a task's memory, so beyond blocks are more.
BLOCK, MOST, LINKS = 8192, 32, 1 << 21


def tile_edges(links: DataFrame, min_shared: int = 1, block: int = BLOCK, weighted: bool = False) -> DataFrame:
    """(src < dst, shared) of ``links(repo_id, owner_login)``, read twice: a login gives a pair of its repositories 1, or the product of their counts ``n`` if ``weighted``.

    Repositories are dealt into blocks by hash; a pair of blocks is a tile, and a task. Each login's list of a block goes to the tiles of the blocks
    in which it has others, so what is shuffled is at most the links times the blocks, and of logins of few repositories one entry a pair. Pairs are made and
    counted where a tile lies, a piece at a time (``tiles.edges_of_tile``), so a task holds the links of two blocks and never a tile's pairs.
    Blocks are as many as make ``block`` squared pairs a tile, on average, but ``MOST`` where links fit: shuffled data then grow with the links.
    """
    spark = links.sparkSession
    T.ship(spark)
    each = links.groupBy("owner_login").agg(_count().alias("k"))
    n, pairs = each.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.expr("k * (k - 1D) / 2")), F.lit(0.0))).head()
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(pairs) >> 14)  # small inputs: no fewer than there are tasks, if worth one
    blocks = max(min(math.ceil(math.sqrt(2 * max(pairs / block**2, tasks, 1))), MOST), math.ceil(n / LINKS))
    own = F.pmod(F.xxhash64("repo_id"), F.lit(blocks)).cast("int").alias("own")
    lists = links.groupBy("owner_login", own).agg(F.collect_list(F.struct("repo_id", "n") if weighted else "repo_id").alias("xs"))
    others = lists.groupBy("owner_login").agg(F.collect_list("own").alias("others"))
    met = lists.join(others, "owner_login").select("owner_login", "own", "xs", F.explode("others").alias("other")).where("own <> other OR size(xs) > 1")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    sent = met.select(((high * (high + 1)) / 2 + low).cast("int").alias("tile"), "own", "owner_login", "xs")
    laid = sent.repartitionById(blocks * (blocks + 1) // 2, "tile")
    made = laid.mapInArrow(T.edges_of_tile(min_shared, weighted), "x long, shared long, ys array<long>").select("x", F.explode("ys").alias("y"), "shared")
    return made.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "shared")


def overlap_edges(contributions: DataFrame, min_shared: int = 1, block: int = BLOCK) -> DataFrame:
    """(src < dst, shared): repositories with contributors, bots apart, in common.

    Pairs are made and counted tile by tile (``tile_edges``) and never shuffled.
    """
    links = written(contributions.where(~is_bot_sql("owner_login")).where("owner_login IS NOT NULL AND repo_id IS NOT NULL").select("repo_id", "owner_login"), "links")
    return tile_edges(links, min_shared, block)


def counted_edges(links: DataFrame, min_shared: int = 1, block: int = BLOCK) -> DataFrame:
    """(src < dst, shared) of ``links(owner_login, repo_id, n)``, one row for each login and repository: a login gives a pair the product of its counts.

    Tile by tile like ``overlap_edges``; counts go with the repositories only where some are not 1. Read twice, so ``links`` are best a table.
    """
    return tile_edges(links, min_shared, block, not links.where("n <> 1").isEmpty())


def fold_edges(links: DataFrame, nodes: DataFrame, min_shared: int = 1, cap: int | None = 400, who: int = 12) -> DataFrame:
    """(src < dst, shared, who): the fold within the pile; people of fewer than two or more than ``cap`` of its repositories, if there is a cap, are skipped.

    ``who`` holds the first carriers in order. Pairs are made and shuffled once; an edge's are ranked and counted where they
    lie sorted, and only the first are gathered, so a heavy edge stays small.
    """
    inside = restrict(links, nodes.select("id"), "repo_id").select("repo_id", "owner_login").distinct()
    spread = inside.groupBy("owner_login").agg(_count().alias("k")).where((F.col("k") >= 2) if cap is None else F.col("k").between(2, cap))
    some = restrict(inside, spread.select("owner_login"), "owner_login")
    a, b = some.withColumnRenamed("repo_id", "src"), some.withColumnRenamed("repo_id", "dst")
    edge = Window.partitionBy("src", "dst").orderBy("owner_login")
    ranked = a.join(b, "owner_login").where("src < dst").withColumn("r", F.row_number().over(edge))
    last = F.lead("r").over(edge).isNull()  # an edge's last rank is its count
    kept = ranked.withColumn("shared", F.when(last, F.col("r"))).where((F.col("r") <= who) | F.col("shared").isNotNull())
    names = F.array_sort(F.collect_list(F.when(F.col("r") <= who, F.col("owner_login")))).alias("who")
    return kept.groupBy("src", "dst").agg(F.max("shared").cast("long").alias("shared"), names).where(F.col("shared") >= min_shared)


def graph_nodes(repos: DataFrame) -> DataFrame:
    return repos.select("id", "full_name", "primary_language", "stars")


def graph(repos: DataFrame, contributions: DataFrame, min_shared: int = 1) -> dict[str, DataFrame]:
    """Nodes and overlap edges; for the edges links are written at once."""
    return {"nodes": graph_nodes(repos), "edges": overlap_edges(contributions, min_shared)}


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, nbr, w): every edge from both ends."""
    both = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr")))
    return edges.select(F.explode(both).alias("e"), F.col("shared").alias("w")).select("e.id", "e.nbr", "w")


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree) of every node with an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(_count().alias("degree"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 9, trace: list[int] | None = None) -> DataFrame:
    """(id, label): synchronous weighted label propagation from each node's own id.

    A round's label is the one of greatest weight among the neighbours, then the node's own, then the smallest; it
    ends after ``rounds`` or when nothing moves. Neighbours outside ``nodes`` are ignored. Weights are whole numbers.

    Votes are kept: only who moved writes to its neighbours, taking its weight from its old label and giving it to the new,
    and only who is written to counts again. (Another's votes are the same, and its own label already led them.) ``trace`` gets the messages of each round.
    """
    ids = nodes.select("id")
    inner = written(restrict(restrict(adjacency(edges), ids, "id"), ids, "nbr"), "adjacency")
    # at first a node's vote is its own id, so the adjacency is the votes
    votes = [inner.select("id", F.col("nbr").alias("vote"), F.col("w").cast("long").alias("score"), F.lit(1).alias("voters"))]
    labels, told = cut(ids.select("id", F.col("id").alias("label"))), None
    for k in range(rounds):
        heard = [v if told is None else restrict(v, told, "id") for v in votes]
        counted = functools.reduce(DataFrame.unionAll, heard).groupBy("id", "vote").agg(F.sum("score").alias("score"), F.sum("voters").alias("voters")).where("voters > 0")
        best = counted.join(labels, "id").groupBy("id", "label").agg(F.max_by("vote", F.struct("score", F.col("vote") == F.col("label"), -F.col("vote"))).alias("new"))
        moved = written(best.where("new <> label"), "moved")
        if moved.isEmpty():
            removed(moved)
            break
        labels = cut(labels.join(moved.select("id", "new"), "id", "left").select("id", F.coalesce("new", "label").alias("label")))
        if k + 1 < rounds:
            change = F.explode(F.array(*[F.struct(F.col(c).alias("vote"), F.lit(sign).alias("sign")) for c, sign in (("label", -1), ("new", 1))])).alias("c")
            sent = inner.join(moved.select(F.col("id").alias("nbr"), change), "nbr")
            votes.append(written(sent.groupBy("id", "c.vote").agg(F.sum(F.col("w") * F.col("c.sign")).cast("long").alias("score"), F.sum("c.sign").cast("int").alias("voters")), "votes"))
            told = votes[-1].select("id").distinct()
            if trace is not None:
                trace.append(inner.join(moved, inner.nbr == moved.id, "left_semi").count())
        removed(moved)
    removed(inner, *votes[1:])
    return labels


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with each row's place from 0 in an order without ties, without one task that sorts them all."""
    part = unused("part", df)
    parts = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "parts")
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = parts.groupBy(part).agg(_count().alias("n")).select(part, before.alias("ahead"))  # a row for each partition
    own = parts.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return own.join(F.broadcast(ahead), part).withColumn(name, F.col(name) + F.col("ahead")).drop(part, "ahead")


def number_clusters(labels: DataFrame) -> DataFrame:
    """(id, cluster, cluster_size): clusters of several nodes numbered by falling size, then label; single nodes are -1."""
    sizes = labels.groupBy("label").agg(_count().alias("cluster_size"))
    places = numbered(sizes.where("cluster_size > 1"), "cluster", F.desc("cluster_size"), "label")
    return labels.join(places, "label", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"))


def contracted(edges: DataFrame, trace: list[int] | None = None) -> DataFrame | None:
    """(id, root): vertices of ``edges(u, v)`` with one of their component; none without edges. ``trace`` gets the edges of each round.

    In a round each vertex goes to the vertex of least random rank among itself and its neighbours, and edges are drawn anew between where their
    ends went. About half of the vertices remain, whatever the shape, and so fewer edges are joined in each round. What a round
    decided is written; roots are looked up from the last round back, each round's vertices once.
    """
    pair = lambda a, b: [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]
    left, went = written(edges.where("u <> v").select(*pair("u", "v")).distinct(), "edges"), []
    while n := left.count():
        if trace is not None:
            trace.append(n)
        rank = lambda c, k=len(went): F.struct(F.xxhash64(F.lit(k), c).alias("r"), F.col(c).alias("x"))
        ends = left.select("u", "v").unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        goal = written(ends.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(rank("u"), "m")["x"].alias("goal")), "goals")
        a, b = goal.withColumnRenamed("goal", "gu"), goal.select(F.col("u").alias("v"), F.col("goal").alias("gv"))
        drawn = written(left.join(a, "u").join(b, "v").where("gu <> gv").select(*pair("gu", "gv")).distinct(), "edges")
        removed(left)
        left = drawn
        went.append(goal)
    removed(left)
    roots = None
    for goal in reversed(went):
        if roots is None:
            roots = goal.select(F.col("u").alias("id"), F.col("goal").alias("root"))
        else:
            later = roots.withColumnRenamed("id", "goal")
            roots = written(goal.join(later, "goal", "left").select(F.col("u").alias("id"), F.coalesce("root", "goal").alias("root")), "roots")
    removed(*went[:-1])
    return roots


def component_labels(nodes: DataFrame, edges: DataFrame, trace: list[int] | None = None) -> DataFrame:
    """(id, component): the smallest id that each node reaches. Edges that leave ``nodes`` are ignored."""
    ids = nodes.select("id")
    ends = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    roots = contracted(restrict(restrict(ends, ids, "u"), ids, "v"), trace)
    if roots is None:
        return ids.select("id", F.col("id").alias("component"))
    # written, so that the join can be split where one component holds many nodes
    least = written(roots.groupBy("root").agg(F.min("id").alias("component")), "least")
    return ids.join(roots.join(least, "root").select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: number of components and size of the largest, null if there is none."""
    sizes = component_labels(nodes, edges).groupBy("component").agg(_count().alias("n"))
    return sizes.agg(_count().alias("components"), F.max("n").alias("largest"))


def ego_network(edges: DataFrame, center: int | None, hops: int = 3) -> DataFrame:
    """(id, ring) of what lies within some hops of a node; the node itself is ring 0. Without a node there is no row."""
    near = adjacency(edges).select("id", "nbr")
    seen = near.sparkSession.range(1).select(F.lit(center).cast("long").alias("id"), F.lit(0).alias("ring")).where("id IS NOT NULL")
    front = seen
    for ring in range(1, hops + 1):
        reached = near.join(front.select("id"), "id").select(F.col("nbr").alias("id")).distinct()
        front = cut(reached.join(seen, "id", "left_anti").select("id", F.lit(ring).alias("ring")))
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen


def default_center(edges: DataFrame) -> int | None:
    """The node of most neighbours, the smallest of equals."""
    row = degree(edges).orderBy(F.desc("degree"), "id").limit(1).head()
    return row["id"] if row else None


def shortest_path(edges: DataFrame, a: int, b: int) -> DataFrame:
    """(hop, src, dst, carrier): the hops of a shortest path, with the first carrier of each; no rows without one or if a = b.

    Of equal parents the smallest is taken. Rings are added until one holds the target or is empty; what a ring reaches lies in
    it, in the one before or in the next, so only those two are left out. The path is rebuilt from the rings' parents.
    """
    spark = edges.sparkSession
    near = cut(adjacency(edges).select("id", "nbr"))
    schema = "hop int, src long, dst long, carrier string"
    if a == b:
        return spark.createDataFrame([], schema)
    front = spark.range(1).select(F.lit(a).cast("long").alias("id"))
    last, rings = front, []
    while True:
        reached = near.join(front, "id").groupBy(F.col("nbr").alias("x")).agg(F.min("id").alias("parent"))
        ring = cut(reached.join(last.unionByName(front).withColumnRenamed("id", "x"), "x", "left_anti"))
        rings.append(ring)
        last, front = front, ring.select(F.col("x").alias("id"))
        if not ring.where(F.col("x") == b).isEmpty():
            break
        if ring.isEmpty():
            return spark.createDataFrame([], schema)
    steps, at = [], b
    for hop in range(len(rings), 0, -1):
        parent = rings[hop - 1].where(F.col("x") == at).head()["parent"]
        steps.append((hop, parent, at))
        at = parent
    path = spark.createDataFrame(steps, "hop int, src long, dst long")
    named = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.get("who", F.lit(0)).alias("carrier"))
    both = F.broadcast(path)
    return named.join(both, (F.least("src", "dst") == F.col("u")) & (F.greatest("src", "dst") == F.col("v"))).select("hop", "src", "dst", "carrier")


def net_stats(nodes: DataFrame, edges: DataFrame, components: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row on the net: size, density, degrees, components, isolates and clusters. Without nodes maxima are null, ratios not a number."""
    degrees = degree(edges)
    e = edges.agg(_count().alias("edges"))
    d = degrees.agg(_count().alias("linked"), F.max("degree").alias("max_degree"))
    c = clusters.where("cluster >= 0").agg(F.countDistinct("cluster").alias("clusters"), F.max("cluster_size").alias("largest_cluster"))
    return stats_row(nodes.agg(_count().alias("nodes")).crossJoin(e).crossJoin(d).crossJoin(components).crossJoin(c))


def stats_row(row: DataFrame) -> DataFrame:
    """The columns of ``net_stats`` from a row of counts."""
    n, m, nan = F.col("nodes"), F.col("edges"), F.lit(float("nan"))
    return row.select(
        "nodes", "edges", F.round(F.when(n > 1, 100.0 * 2 * m / (n * (n - 1))).otherwise(nan), 6).alias("density_pct"),
        F.round(F.when(n > 0, 2.0 * m / n).otherwise(nan), 6).alias("mean_degree"), "max_degree", "components", "largest",
        F.round(F.when(n > 0, 100.0 * F.col("largest") / n), 6).alias("largest_pct"), (n - F.col("linked")).alias("isolates"), "clusters", "largest_cluster",
    )


def adjacency_matrix(edges: DataFrame, clusters: DataFrame, limit: int = 70) -> DataFrame:
    """(row, col, v, share): the best-connected nodes in the order of cluster and degree, both halves."""
    top = degree(edges).orderBy(F.desc("degree"), "id").limit(limit).join(clusters, "id")
    order = Window.orderBy(F.col("cluster") < 0, "cluster", F.desc("degree"), "id")
    placed = top.withColumn("place", F.row_number().over(order) - 1).select("id", "place")  # at most ``limit`` rows
    a, b = placed.select(F.col("id").alias("src"), F.col("place").alias("row")), placed.select(F.col("id").alias("dst"), F.col("place").alias("col"))
    half = edges.join(F.broadcast(a), "src").join(F.broadcast(b), "dst").select("row", "col", F.col("shared").alias("v"))
    both = half.unionByName(half.select(F.col("col").alias("row"), F.col("row").alias("col"), "v"))
    return both.crossJoin(F.broadcast(half.agg(F.max("v").alias("most")))).select("row", "col", "v", F.round(F.col("v") / F.col("most"), 6).alias("share"))
