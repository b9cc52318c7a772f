"""Link graphs: weighted edges between domains, strongly connected components, induced subgraphs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Graphs of at most so many edges are solved on the driver; larger ones by rounds of joins.
DRIVER_EDGES = 200_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="checkpoints")
        sc.setCheckpointDir(where)
    return df.checkpoint()


def link_graph(crawl: DataFrame) -> DataFrame:
    """src, dst, weight: the share of the source domain's pages that link to dst, for domains that are sources themselves.

    crawl: url, status, links (a JSON array of urls). Only pages with a status of 200 to 299 count; links of a page count once.
    """
    pages = crawl.where((F.col("status") >= 200) & (F.col("status") < 300)).withColumn("dom", text.link_domain(F.col("url"))).where(F.col("dom").isNotNull())
    pages = pages.withColumn("page", F.monotonically_increasing_id()).select("page", "dom", F.array_distinct(F.transform(F.from_json("links", "array<string>"), text.link_domain)).alias("targets"))
    size = pages.groupBy("dom").agg(F.count(F.lit(1)).alias("pages"))
    links = pages.select("dom", F.explode("targets").alias("dst")).where(F.col("dst").isNotNull()).groupBy("dom", "dst").agg(F.count(F.lit(1)).alias("n"))
    known = size.select(F.col("dom").alias("dst"))
    return links.join(known, "dst", "left_semi").join(size, "dom").select(F.col("dom").alias("src"), "dst", (F.col("n") / F.col("pages")).alias("weight"))


def induced(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges with both ends among the nodes."""
    a, b = (nodes.select(F.col(node).alias(c)).distinct() for c in ("src", "dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def _tarjan(edges: list[tuple]) -> dict:
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index, low, on, stack, comp = {}, {}, set(), [], {}
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    least = min(members)
                    for w in members:
                        comp[w] = least
    return comp


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's greatest label among those that reach it. labels: node, label; edges go from src to dst."""
    while True:
        best = edges.join(labels, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("label").alias("m"))
        new = checkpointed(labels.join(best, F.col("node") == F.col("dst"), "left").select("node", F.greatest("label", F.coalesce("m", "label")).alias("label"), (F.col("m") > F.col("label")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def _rounds(edges: DataFrame) -> DataFrame:
    """Components of more than one node, by trimming and colouring: each colour's root gathers what reaches it within the colour."""
    done = None
    while True:
        while True:  # nodes without a way in or out are components of their own
            ends = edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").withColumnRenamed("src", "node")
            kept = checkpointed(induced(edges, ends))
            small = kept.count() == edges.count()
            edges = kept
            if small:
                break
        if edges.isEmpty():
            return done
        nodes = edges.select(F.col("src").alias("node")).distinct()
        colour = _spread(nodes.select("node", F.col("node").alias("label")), edges)
        ca, cb = colour.select(F.col("node").alias("src"), F.col("label").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("label").alias("cb"))
        back = checkpointed(edges.join(ca, "src").join(cb, "dst").where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        seen = _spread(colour.select("node", F.when(F.col("node") == F.col("label"), F.lit(1)).otherwise(0).alias("label")), back).where("label = 1")
        found = checkpointed(seen.select("node").join(colour, "node").select("node", "label"))
        done = found if done is None else done.unionAll(found)
        edges = checkpointed(induced(edges, nodes.join(found, "node", "left_anti")))


def scc(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """node, component (its smallest node), size: strongly connected components of more than one node. edges: src, dst."""
    spark = edges.sparkSession
    edges = checkpointed(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    kind = dict(edges.dtypes)["src"]
    if edges.limit(driver_edges + 1).count() <= driver_edges:
        comp = _tarjan([(r["src"], r["dst"]) for r in edges.collect()])
        got = spark.createDataFrame(sorted(comp.items()), f"node {kind}, component {kind}")
    else:
        got = _rounds(edges)
        if got is None:
            got = spark.createDataFrame([], f"node {kind}, component {kind}")
        else:
            least = got.groupBy("label").agg(F.min("node").alias("component"))
            got = got.join(least, "label").select("node", "component")
    sizes = got.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return got.join(sizes, "component").select("node", "component", "size")
