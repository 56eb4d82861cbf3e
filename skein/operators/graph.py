"""Graph operators over edge tables.

Joins by key say so (``merge``): a plan guesses sizes from the files that rows were made from, and where these are small it
would send edges, which are many more, through the driver to every executor.

Defined results: repeated edges count once; edges with a null end lead nowhere; of equally short ways the one by the
least node counts; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.shared import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage ended by a checkpoint in the folder that the cluster shares."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def reached(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): least number of hops from ``seeds(node)`` over ``edges(source, target)``."""
    edges = cut(edges.select("source", "target"))
    found = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = found
    for k in range(1, depth + 1):
        step = front.join(edges.hint("merge"), front.node == edges.source).select(F.col("target").alias("node")).distinct()
        front = cut(step.join(found.hint("merge"), "node", "left_anti").withColumn("depth", F.lit(k)))
        found = found.union(front)
    return found


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(node, rank) with ranks that sum to one; nodes without targets give to all alike.

    Rounds end when all ranks together change by ``tolerance`` at most, or after ``iterations``.
    """
    links = edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct()
    links = cut(links)
    nodes = links.select(F.col("source").alias("node")).union(links.select("target")).distinct()
    nodes = cut(nodes)
    n = nodes.count()
    degree = links.groupBy("source").agg(F.count("*").alias("degree"))
    degree = cut(degree)
    spread = cut(links.join(degree.hint("merge"), "source"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(iterations):
        given = spread.join(ranks.hint("merge"), spread.source == ranks.node).groupBy("target").agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        lost = ranks.join(degree.hint("merge"), ranks.node == degree.source, "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = nodes.join(given.hint("merge"), nodes.node == given.target, "left").crossJoin(F.broadcast(lost))  # one row
        new = given.select("node", ((1 - damping) / max(n, 1) + damping * (F.coalesce("given", F.lit(0.0)) + F.col("lost") / max(n, 1))).alias("rank"))
        new = cut(new.join(ranks.withColumnRenamed("rank", "was").hint("merge"), "node"))
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        ranks = new.drop("was")
        if change <= tolerance:
            break
    return ranks


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """Two-node cycles, each once."""
    a, b = edges.alias("a"), edges.alias("b")
    return a.join(b, (F.col("a.source") == F.col("b.target")) & (F.col("a.target") == F.col("b.source"))).where("a.source < a.target").select(F.col("a.source").alias("one"), F.col("a.target").alias("other")).distinct()


def expanded_order(agents: DataFrame) -> list[str]:
    """Names of enabled ``agents(ord, name, enabled, dependencies)``, each after what it depends on, else in their order.

    A configuration has few agents, so the walk is made where the result is read. Dependencies that are disabled or
    unknown come too. A circle is an error.
    """
    rows = sorted(agents.select("ord", "name", "enabled", "dependencies").collect(), key=lambda r: r["ord"])
    needs = {r["name"]: r["dependencies"] or [] for r in reversed(rows)}
    done, open_, order = set(), set(), []

    def visit(name: str) -> None:
        if name in open_:
            raise ValueError(f"circular dependency at {name}")
        if name in done:
            return
        open_.add(name)
        for other in needs.get(name, []):
            visit(other)
        open_.discard(name)
        done.add(name)
        order.append(name)

    for r in rows:
        if r["enabled"]:
            visit(r["name"])
    return order


def resolved_imports(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = (".ts", ".tsx", ".js", ".py", "/index.ts", "/index.js", "/__init__.py")) -> DataFrame:
    """Edges (source, target) of ``imports(path, module)`` to the files of the repository that they name.

    A module that begins with a dot is looked for beside the file, any other from the root; the first extension
    that a file has counts.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    joined = F.when(F.col("module").startswith("."), F.concat(folder, "module")).otherwise(F.regexp_replace("module", r"\.", "/"))
    parts = F.split(F.regexp_replace(joined, r"^(\./)+", ""), "/")
    # ``..`` takes back the part before it
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when((x == ".") | (x == ""), done).when((x == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(x))))
    base = F.array_join(walked, "/")
    tries = imports.select(F.col("path").alias("source"), "module", F.posexplode(F.array(base, *[F.concat(base, F.lit(e)) for e in extensions])).alias("nth", "target"))
    # many imports name one file, so files are looked up and imports pass by unsorted
    found = tries.join(files.select(F.col("path").alias("target")).distinct().hint("shuffle_hash"), "target")
    return found.groupBy("source", "module").agg(F.min_by("target", "nth").alias("target")).select("source", "target").distinct()


def repomap(files: DataFrame) -> DataFrame:
    """Of ``files(path, size)``: a rank by size and kind, and the centrality made from it."""
    dotted = F.regexp_extract("path", r"\.([^./]*)$", 1)
    weight = F.when(dotted.isin("py", "ts", "js", "java"), 1.5).when(dotted.isin("md", "txt", "json"), 0.5).otherwise(1.0)
    rank = (F.least(F.col("size") / 1000, F.lit(100.0)) / 100 + weight) / 2.5
    return files.select("path", rank.alias("rank"), (rank * 0.8).alias("centrality"))


#: Hops between two checks whether anything still changes: a checkpoint each costs more than a hop too many.
HOPS_A_ROUND = 3
#: A table that grows by a part a round is written anew after so many.
ROUNDS_A_CUT = 8
#: The component of one node is searched for while there are so many edges and a search takes off such a share of them; ends
#: that drop less than this share a round are left for later then.
MANY_EDGES = 10_000
LEAST_SHARE = 0.05


def _reaches(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, root) of all that ``start(node, root)`` reaches over ``edges(source, other, within)`` of its own ``root``.

    A round starts from what the one before it has found new, so no edge is passed in every round.
    """
    found, front, rounds = start, start, 0
    while True:
        step, more = front, None
        for _ in range(HOPS_A_ROUND):
            met = step.hint("shuffle_hash").join(edges, (F.col("node") == F.col("source")) & (F.col("root") == F.col("within")))
            step = met.select(F.col("other").alias("node"), "root").distinct()
            more = step if more is None else more.union(step)
        front = cut(more.distinct().join(found.hint("merge"), ["node", "root"], "left_anti"))
        if front.isEmpty():
            return found
        rounds += 1
        found = found.union(front) if rounds % ROUNDS_A_CUT else cut(found.union(front))


def _between(links: DataFrame) -> DataFrame:
    """Edges whose ends both have a way in and a way out."""
    ends = links.select(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.select("target", F.lit(0), F.lit(1)))
    inner = ends.groupBy("node").agg(F.max("out").alias("out"), F.max("into").alias("into")).where("out = 1 AND into = 1").select("node")
    return links.join(inner, links.source == inner.node, "left_semi").join(inner.withColumnRenamed("node", "other"), F.col("target") == F.col("other"), "left_semi")


def _largest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The component (node, root) of the node with most ways through it, and the edges that may be inside other ones.

    Nodes that it reaches and that reach it are its component. Other components have all of their nodes or none among those
    that it reaches, and so among those that reach it.
    """
    degree = lambda end, name: links.groupBy(F.col(end).alias("node")).agg(F.count("*").cast("double").alias(name))
    most = degree("source", "out").join(degree("target", "into").hint("merge"), "node").orderBy(F.desc(F.col("out") * F.col("into")), "node").limit(1)
    ways = links.select("source", F.col("target").alias("other"), F.lit(1).alias("within")).union(links.select("target", "source", F.lit(2)))
    found = _reaches(cut(ways), cut(most.select("node", F.explode(F.array(F.lit(1), F.lit(2))).alias("root"))))
    sides = cut(found.groupBy("node").agg(F.sum("root").alias("side")))
    own = sides.where("side = 3").select("node")
    own = own.crossJoin(F.broadcast(own.agg(F.min("node").alias("root"))))  # one row
    of = lambda node, side: sides.select(F.col("node").alias(node), F.col("side").alias(side)).hint("merge")
    left = links.join(of("source", "a"), "source", "left").join(of("target", "b"), "target", "left")
    return own, left.where("coalesce(a, 0) = coalesce(b, 0) AND coalesce(a, 0) < 3").select("source", "target")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size): nodes that reach one another share the least of them as component.

    Each round first drops nodes without a way in or out, which are components of their own. While there are many edges, the
    component of one node is taken off whole, as most graphs have a large one. Else the least node that
    reaches a node goes along the edges until nothing changes, and among the nodes that share one, those that reach it
    are its component. What is left goes into the next round, with the edges inside it. Null ends are no nodes.
    """
    pairs = edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct()
    nodes = cut(pairs.select(F.col("source").alias("node")).union(pairs.select("target")).distinct())
    links = cut(pairs.where("source != target"))
    done, size, searching = None, links.count(), True
    while True:
        while size:
            for _ in range(HOPS_A_ROUND):
                links = _between(links)
            links = cut(links)
            before, size = size, links.count()
            if size == before or (searching and size >= MANY_EDGES and before - size < LEAST_SHARE * before):
                break
        if not size:
            break
        if searching and size >= MANY_EDGES:
            found, links = _largest(links)
            done = found if done is None else done.union(found)
            links = cut(links)
            before, size = size, links.count()
            searching = before - size >= LEAST_SHARE * before
            continue
        label = cut(links.select(F.col("source").alias("node")).union(links.select("target")).distinct().withColumn("root", F.col("node")))
        while True:
            label = label.select("node", "root", F.col("root").alias("was"))
            for _ in range(HOPS_A_ROUND):
                given = links.join(label, links.source == label.node).groupBy("target").agg(F.min("root").alias("given"))
                label = label.join(given, label.node == given.target, "left").select("node", F.least("root", "given").alias("root"), "was")
            label = cut(label)
            still = label.where("root != was").isEmpty()
            label = label.drop("was")
            if still:
                break
        ends = label.withColumnRenamed("root", "target_root").withColumnRenamed("node", "end")
        own = links.join(label, links.source == label.node).join(ends, F.col("target") == F.col("end")).where("root = target_root")
        back = cut(own.select(F.col("target").alias("source"), F.col("source").alias("other"), F.col("root").alias("within")))
        found = _reaches(back, label.where("node = root").select("node", "root"))
        done = found if done is None else done.union(found)
        gone = found.select("node")
        links = cut(links.join(gone, links.source == gone.node, "left_anti").join(gone.withColumnRenamed("node", "other"), F.col("target") == F.col("other"), "left_anti"))
        size = links.count()
    if done is None:
        component = nodes.withColumn("component", F.col("node"))
    else:
        component = nodes.join(done, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    sizes = component.groupBy("component").agg(F.count("*").alias("size"))
    return component.join(sizes, "component").select("node", "component", "size")


def circles(edges: DataFrame) -> DataFrame:
    """(component, size, ...) of circular dependencies: components of several nodes, and nodes with an edge to themselves."""
    parts = strong_components(edges)
    itself = edges.where("source = target").select(F.col("source").alias("node")).distinct().withColumn("itself", F.lit(True))
    return parts.join(itself, "node", "left").where("size > 1 OR itself").groupBy("component").agg(F.max("size").alias("size"), F.sort_array(F.collect_list("node")).alias("nodes"))


def reached_by(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth, parent): least number of hops from ``seeds(node)``, and the least node one hop nearer; none for seeds."""
    found = seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent"))
    front = found
    for k in range(1, depth + 1):
        step = front.join(edges.hint("merge"), front.node == edges.source).groupBy(F.col("target").alias("node")).agg(F.min("source").alias("parent"))
        front = cut(step.join(found.hint("merge"), "node", "left_anti").select("node", F.lit(k).alias("depth"), "parent"))
        found = found.union(front)
    return found


def shortest_paths(found: DataFrame, depth: int) -> DataFrame:
    """``reached_by`` with ``path``, the nodes from a seed to each node, rebuilt from the parents."""
    found = cut(found)
    up = found.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    out = found.withColumn("path", F.array("node")).withColumn("_next", F.col("parent"))
    for _ in range(depth):
        out = out.join(up.hint("merge"), out._next == up._node, "left")
        out = out.withColumn("path", F.when(F.col("_next").isNotNull(), F.concat(F.array("_next"), "path")).otherwise(F.col("path"))).withColumn("_next", F.col("_parent")).drop("_node", "_parent")
    return out.drop("_next")
