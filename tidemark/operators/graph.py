"""Property-graph queries by iterative joins over an edge table. Each round is
written, so that no plan grows with the hops and no round is computed twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.stage import written

WIDE = 100_000


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def within(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop) of every node at most `hops` steps from a seed. Only the frontier joins each round."""
    links = undirected(edges)
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for h in range(1, hops + 1):
        step = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(h)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Edges between nodes at most `hops` steps from a seed."""
    nodes = within(edges, seeds, hops).select("node")
    return edges.join(nodes, edges["src"] == nodes["node"], "left_semi").join(nodes, edges["dst"] == nodes["node"], "left_semi")


def shortest_paths(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop, path): one shortest path from the seeds to each node, the smallest in order of names."""
    links = undirected(edges)
    seen = seeds.select("node").distinct().select("node", F.lit(0).alias("hop"), F.array("node").alias("path"))
    frontier = seen
    for h in range(1, hops + 1):
        step = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("node").agg(F.min("path").alias("path"))
        frontier = written(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(h).alias("hop"), "path"), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def network_stats(edges: DataFrame) -> DataFrame:
    """One row: edges, reciprocity, largest degrees, share of edges of the top tenth of leaders."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = e.join(back, ["src", "dst"], "left_semi").agg(F.count("*").alias("mutual"))
    lead = e.groupBy("src").agg(F.count("*").alias("n")).withColumns({"r": F.row_number().over(Window.orderBy(F.col("n").desc(), "src")), "leaders": F.count("*").over(Window.partitionBy(F.lit(0)))})
    top = lead.agg(F.sum("n").alias("edges"), F.max("n").alias("max_out"), F.sum(F.when(F.col("r") <= F.ceil(F.col("leaders") * 0.1), F.col("n"))).alias("top"))
    into = e.groupBy("dst").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_in"))
    return top.crossJoin(mutual).crossJoin(into).select("edges", (F.col("mutual") / F.col("edges")).alias("reciprocity"), "max_out", "max_in", (F.col("top") / F.col("edges")).alias("top_10pct_share"))


def lineage(parents: DataFrame, depth: int = 20) -> DataFrame:
    """(node, ancestor, distance) along first parents (node, parent), up to a depth."""
    chain = parents.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    out, up = chain, parents.select(F.col("node").alias("ancestor"), F.col("parent").alias("next")).where("next is not null")
    for d in range(2, depth + 1):
        chain = written(chain.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(d).alias("distance")), "lineage")
        if chain.limit(1).count() == 0:
            break
        out = out.unionByName(chain)
    return out


def ancestors(parents: DataFrame, depth: int = 50, wide: int = WIDE) -> DataFrame:
    """(node, ancestor, distance): every ancestor of every node with its least distance, where nodes may have
    several parents. parents: node, parent (repeats and nulls are harmless, a cycle ends where it closes).

    Nodes are taken in generations, each after all its parents: a node's ancestors are its parents and theirs, so every
    node is worked out once, from one map a parent. What has no generation within the depth (cycles, longer chains), more than
    32 parents or whose parents' maps hold more than `wide` entries, and what descends from them, is walked step by step."""
    up = written(parents.where("parent is not null and node <> parent").select("node", "parent").distinct(), "parents")
    kind = up.schema["node"].dataType.simpleString()
    none = F.map_from_arrays(F.array().cast(f"array<{kind}>"), F.array().cast("array<int>"))
    done = up.limit(0).select("node", none.alias("above"), F.lit(0).alias("n"))
    left = up
    for _ in range(depth):
        known = left.select(F.col("node").alias("parent")).distinct().select("parent", F.lit(True).alias("late"), F.lit(0).alias("n"))
        known = known.unionByName(done.select(F.col("node").alias("parent"), F.lit(False).alias("late"), "n"))
        each = Window.partitionBy("node")
        waits = F.max(F.coalesce("late", F.lit(False))).over(each) | (F.count("*").over(each) > 32) | (F.sum(F.coalesce("n", F.lit(0)) + 1).over(each) > wide)
        state = written(left.join(known, "parent", "left").select("node", "parent", waits.alias("waits")), "generation")
        ready, left = state.where("not waits"), state.where("waits").select("node", "parent")
        if ready.isEmpty():
            break
        theirs = done.select(F.col("node").alias("parent"), F.transform_values("above", lambda _, v: v + 1).alias("above"))
        own = F.create_map("parent", F.lit(1))
        maps = ready.join(theirs, "parent", "left").select("node", F.coalesce(F.map_concat("above", own), own).alias("above")).repartition("node")
        merged = F.reduce(F.collect_list("above"), none, lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.least(x, y)))  # at most 32 maps
        done = done.unionByName(written(maps.groupBy("node").agg(merged.alias("above")).withColumn("n", F.size("above")), "ancestors"))
    found = done.select("node", F.explode("above").alias("ancestor", "distance"))
    return found if left.isEmpty() else found.unionByName(walked(left, up, depth))


def walked(starts: DataFrame, up: DataFrame, depth: int) -> DataFrame:
    """(node, ancestor, distance) above the nodes of `starts` (all their edges), by steps along `up`.

    Each round goes one step further from what the last one found new, so a diamond is walked once."""
    found = frontier = starts.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    for d in range(2, depth + 1):
        step = frontier.join(up.select(F.col("node").alias("ancestor"), F.col("parent").alias("next")), "ancestor").where("node <> next")
        step = step.select("node", F.col("next").alias("ancestor"), F.lit(d).alias("distance")).distinct()
        frontier = written(step.join(found, ["node", "ancestor"], "left_anti"), "ancestors")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def descend(genes: DataFrame, births: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Revisions for new genes that replace their parents, and the births that cannot be.

    genes: gene_id, version, generation, status, parents, children (latest revisions). births: child_id, parents, notes; one
    parent is a mutation, several a merge. A child is one generation after its latest parent. Each parent gets one new
    revision: REPLACED, with its children of this batch added in order. A birth with an unknown or no parent, or of an
    id that exists, is returned with its reason instead."""
    named = births.withColumn("parents", F.array_distinct("parents"))
    each = named.select("child_id", F.explode_outer("parents").alias("gene_id")).join(genes.select("gene_id", "generation"), "gene_id", "left")
    checked = each.groupBy("child_id").agg(F.count("gene_id").alias("asked"), F.count("generation").alias("known"), (F.max("generation") + 1).alias("generation"))
    taken = genes.select(F.col("gene_id").alias("child_id"), F.lit(True).alias("taken"))
    checked = checked.join(taken, "child_id", "left")
    reason = F.when(F.col("asked") == 0, "no parent").when(F.col("known") < F.col("asked"), "unknown parent").when(F.col("taken"), "the gene exists")
    named = written(named.join(checked.select("child_id", "generation", reason.alias("reason")), "child_id"), "births")
    good = named.where("reason is null")
    none = F.array().cast("array<string>")
    born = good.select(F.col("child_id").alias("gene_id"), F.lit(1).alias("version"), "generation", F.lit("PROMOTED").alias("status"), "parents", none.alias("children"))
    new = good.select("child_id", F.explode("parents").alias("gene_id")).groupBy("gene_id").agg(F.array_sort(F.collect_list("child_id")).alias("new"))  # the children of one parent in this batch
    replaced = genes.join(new, "gene_id").select("gene_id", (F.col("version") + 1).alias("version"), "generation", F.lit("REPLACED").alias("status"), "parents", F.concat("children", "new").alias("children"))
    return born.unionByName(replaced), named.where("reason is not null").select("child_id", "parents", "reason")


def leader_shares(edges: DataFrame, shares: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """One row: edges, nodes, shares of the edges that the top part of the leaders has, the median of a leader,
    the largest degrees and the pairs with edges both ways. edges: src (leader), dst (follower); repeats count for degrees.

    Top leaders follow from the histogram of their degrees, which has at most sqrt(2 * edges) rows."""
    lead = written(edges.groupBy("src").agg(F.count("*").alias("n")), "leaders")
    into = edges.groupBy("dst").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_in_degree"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count("*").alias("nodes"))
    pair = edges.select("src", "dst").distinct()
    mutual = pair.join(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").agg((F.count("*") / 2).cast("long").alias("reciprocal_pairs"))
    whole = lead.agg(F.count("*").alias("leaders"), F.sum("n").alias("edges"), F.percentile("n", F.lit(0.5)).alias("median_leader"), F.max("n").alias("max_out_degree"))
    steps = lead.groupBy("n").agg(F.count("*").alias("k"))
    steps = steps.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).crossJoin(F.broadcast(whole.select("leaders")))  # one row
    part = lambda f: F.sum(F.col("n") * F.greatest(F.lit(0), F.least(F.col("k"), F.greatest(F.lit(1), F.ceil(F.col("leaders") * f)) - F.col("before"))))
    tops = steps.agg(*[part(f).alias(f"top{i}") for i, f in enumerate(shares)])
    one = whole.crossJoin(tops).crossJoin(into).crossJoin(nodes).crossJoin(mutual)  # one row each
    named = [(F.col(f"top{i}") / F.col("edges")).alias(f"top_{round(100 * f)}pct_share") for i, f in enumerate(shares)]
    return one.select("edges", "nodes", *named, "median_leader", "max_out_degree", "max_in_degree", "reciprocal_pairs")


def permuted_max_in_degree(edges: DataFrame, permutations: int = 200, seed: int = 42) -> DataFrame:
    """One row: the largest number of followers' edges observed, and under counterparts drawn at random.

    Each permutation gives every edge a counterpart from all nodes, by a checksum of seed, permutation and edge; a draw of the
    leader itself is drawn once more. All permutations run side by side: draws are counted before they
    shuffle, and only maxima are kept. p_value is (1 + permutations at or above the observed) / (1 + permutations).
    edges: src, dst, each once."""
    from .outcomes import numbered

    nodes = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    places = written(numbered(nodes, ["node"]).select("node", (F.col("_r") - 1).alias("place")), "places")
    total = places.agg(F.count("*").alias("total"))
    rows = edges.join(places.withColumnRenamed("node", "src"), "src").crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumn("permutation", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "permutation", "src", "dst", F.lit(str(k)))), 1, 8), 16, 10).cast("long") % F.col("total")
    drawn = rows.select("permutation", F.when(draw(1) == F.col("place"), draw(2)).otherwise(draw(1)).alias("drawn"))
    maxima = drawn.groupBy("permutation", "drawn").agg(F.count("*").alias("n")).groupBy("permutation").agg(F.max("n").alias("m"))
    seen = edges.groupBy("dst").agg(F.count("*").alias("n")).agg(F.max("n").alias("observed"))
    both = maxima.crossJoin(F.broadcast(seen))  # one row
    return both.agg(
        F.count("*").alias("permutations"), F.max("observed").alias("observed"), F.avg("m").alias("null_mean"), F.percentile("m", F.lit(0.95)).alias("null_p95"),
        ((F.count_if(F.col("m") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p_value"),
    )
