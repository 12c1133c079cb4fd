"""Communities of a graph by modularity, level by level, each of a bounded size."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from correspond.operators.tables import Scratch

#: Nodes of a community at most. Fixed value.
LIMIT = 15
#: Links that lie in one part.
LINKS = 1_000_000


def _wishes(nodes: DataFrame, edges: DataFrame, twice: float, limit: int) -> DataFrame:
    """nodes(id, h, k, size, comm), edges(src, dst, w) both ways -> (src, size, own, to, held, by) of nodes that would raise modularity by moving: to the community with room that raises it most, the smaller of equals. by orders the wishes, the highest first; no two are equal."""
    # A full community is seen by its own members alone: nobody else can join it.
    members = F.when(F.sum("size") >= limit, F.collect_list("id"))
    sums = nodes.groupBy("comm").agg(F.sum("k").alias("tot"), F.sum("size").alias("held"), members.alias("members"))
    at = nodes.join(sums, "comm")
    there = at.select(F.col("id").alias("dst"), "comm", "tot", "held", "members").hint("shuffle_hash")
    links = edges.join(there, "dst").where("members is null or array_contains(members, src)").select("src", "comm", "w", "tot", "held")
    # Dealt out once: the sums and the choice of a node are made where its links are.
    near = links.repartition("src").groupBy("src", "comm").agg(F.sum("w").alias("w"), F.max("tot").alias("tot"), F.max("held").alias("held"))
    own = at.select(F.col("id").alias("src"), "h", "k", "size", F.col("comm").alias("own"), (F.col("k") * (F.col("tot") - F.col("k")) / twice).alias("kept")).hint("shuffle_hash")
    inside, fits = F.col("comm") == F.col("own"), F.col("held") + F.col("size") <= limit
    seen = near.join(own, "src").where(inside | fits)
    loss = F.rint((F.col("k") * F.col("tot") / twice - F.col("w")) * 1e9) / 1e9  # nine digits; the same as F.round, which makes a decimal of every value
    best = F.min(F.when(~inside & fits, F.struct(loss.alias("loss"), F.col("comm").alias("to"), F.col("held").alias("held"))))
    chosen = seen.groupBy("src").agg(*(F.max(c).alias(c) for c in ("h", "size", "own", "kept")), F.coalesce(F.max(F.when(inside, F.col("w"))), F.lit(0.0)).alias("w_own"), best.alias("best"))
    rise = F.round(F.col("kept") - F.col("w_own") - F.col("best.loss"), 9)
    return chosen.where("best is not null").select("src", "size", "own", F.col("best.to").alias("to"), F.col("best.held").alias("held"), F.struct(rise.alias("rise"), "h", "src").alias("by")).where("by.rise > 0")


def _moves(wishes: DataFrame, limit: int) -> DataFrame:
    """Wishes that are granted together: (id, to).

    A community whose best wish to leave it is higher than the best wish to join it loses nodes in this turn, and any other gains
    them; so what a wish was worked out from holds but for those who join together, and the highest wish of all is always granted. Of
    those who would join a community, the best come first until it is full, or twice as large.
    """
    leaving = wishes.groupBy(F.col("own").alias("comm")).agg(F.max("by").alias("leave"))
    joining = wishes.groupBy(F.col("to").alias("comm")).agg(F.max("by").alias("join"))
    roles = leaving.join(joining, "comm", "full").select("comm", F.coalesce(F.col("leave") > F.col("join"), F.col("join").isNull()).alias("gives"))
    role = lambda c, flag: roles.where(flag).select(F.col("comm").alias(c))
    apt = wishes.join(role("own", F.col("gives")), "own", "left_semi").join(role("to", ~F.col("gives")), "to", "left_semi")
    turns = Window.partitionBy("to").orderBy(F.desc("by"))
    first = apt.withColumn("_n", F.row_number().over(turns)).where(F.col("_n") <= limit)
    full = first.withColumn("_upto", F.col("held") + F.sum("size").over(turns.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return full.where((F.col("_upto") <= limit) & ((F.col("_n") == 1) | (F.col("_upto") <= 2 * F.col("held")))).select(F.col("src").alias("id"), "to")


def communities(links: DataFrame, limit: int = LIMIT, turns: int = 24, levels: int = 8) -> DataFrame:
    """links(source, target, weight) -> (node, level, community): at each level the community of every node, named by its smallest node.

    At level 0 nodes move between communities for as long as that raises modularity, `turns` turns at most; at the next level the
    communities found are the nodes of a smaller graph, and so on until nothing moves. None has more than `limit` nodes. Links
    have no direction; those of the same ends add up, a missing weight is 1, a weight of 0 or less is no link, and a link of a node with itself counts inside it. Ties are
    broken by order, so reruns agree. All tables stay distributed. Inside, nodes are numbers in the order of their names, and links
    lie by their end, so that a turn deals them out once.
    """
    t = Scratch(links.sparkSession, "communities")
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    ends = links.where("source is not null and target is not null").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), weight.alias("w")).where("w > 0").groupBy("a", "b").agg(F.sum("w").alias("w"))
    whole = t.written(ends, "links")
    total, n_links = whole.agg(F.sum("w"), F.count("*")).first()
    twice = 2 * (total or 0.0)
    degree = t.written(whole.select(F.explode(F.array("a", "b")).alias("name"), "w").groupBy("name").agg(F.sum("w").alias("k")), "degree")
    names = t.written(degree.orderBy("name").select(F.monotonically_increasing_id().alias("id"), "name", F.xxhash64("name").alias("h"), "k"), "names")
    number = lambda c: names.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id")).hint("shuffle_hash")
    both = t.written(whole.where("a <> b").join(number("a"), "a").join(number("b"), "b").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "w"), "both")
    parts = max(links.sparkSession.sparkContext.defaultParallelism, 2 * n_links // LINKS + 1)
    laid = lambda e: e.repartition(parts, "dst").persist(StorageLevel.DISK_ONLY)
    edges = laid(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    nodes = t.written(names.select("id", "h", "k", F.lit(1).cast("long").alias("size"), F.col("id").alias("comm")), "nodes")
    members = t.written(nodes.select(F.col("id").alias("node"), F.col("id").alias("at")), "members")
    found = None
    for level in range(levels):
        any_moved = False
        for _ in range(turns):
            wishes = t.written(_wishes(nodes, edges, twice, limit), "wishes")
            if wishes.isEmpty():
                break
            any_moved = True
            nodes = t.written(nodes.join(_moves(wishes, limit), "id", "left").select("id", "h", "k", "size", F.coalesce("to", "comm").alias("comm")), "nodes")
        if not any_moved and found is not None:
            break
        groups = nodes.groupBy("comm").agg(F.min("id").alias("name"), F.sum("size").alias("held"))
        named = t.written(nodes.join(groups, "comm").select("id", "h", "k", "size", "name", "held"), "named")
        name = f"level{level}"
        members = t.written(members.join(named.select(F.col("id").alias("at"), "name"), "at").select("node", F.lit(level).alias("level"), F.col("name").alias("community")), name)
        found = members if found is None else found.unionByName(members)
        members = members.select("node", F.col("community").alias("at"))
        if not any_moved:
            break
        to = lambda c: named.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"), F.col("held").alias(f"{c}_held")).hint("shuffle_hash")  # noqa: E731, B023
        # Links of communities that are too large together are of no use from here on: their nodes never meet in one.
        joined = edges.join(to("dst"), "dst").where(F.col("dst_held") < limit).join(to("src"), "src").where((F.col("src_held") + F.col("dst_held") <= limit) & (F.col("src_name") != F.col("dst_name")))
        less = t.written(joined.groupBy(F.col("src_name").alias("src"), F.col("dst_name").alias("dst")).agg(F.sum("w").alias("w")), "less")
        edges.unpersist()
        edges = laid(less)
        nodes = t.written(named.groupBy(F.col("name").alias("id")).agg(F.min_by("h", "id").alias("h"), F.sum("k").alias("k"), F.sum("size").alias("size")).withColumn("comm", F.col("id")), "nodes")
    edges.unpersist()
    t.keep("names", *(n for n in t.paths if n.startswith("level")))
    of = lambda c: names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    return found.join(of("node"), "node").join(of("community"), "community").select(F.col("node_name").alias("node"), "level", F.col("community_name").alias("community"))


def modularity(links: DataFrame, members: DataFrame) -> float:
    """Of links(source, target, weight) under members(node, community), all of whose nodes have one."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    ends = links.select("source", "target", w.alias("w")).where("w > 0")
    of = lambda c: members.select(F.col("node").alias(c), F.col("community").alias(f"{c}_in"))
    named = ends.join(of("source"), "source").join(of("target"), "target")
    degree = named.select(F.explode(F.array("source_in", "target_in")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k"))
    total, inside = named.agg(F.sum("w"), F.sum(F.when(F.col("source_in") == F.col("target_in"), F.col("w")))).first()
    return (inside or 0.0) / total - degree.agg(F.sum(F.col("k") * F.col("k"))).first()[0] / (2 * total) ** 2


def common_level(members: DataFrame) -> DataFrame:
    """(node, level, community) -> (level, n): the level of the most communities, the lowest of equals."""
    return members.select("level", "community").distinct().groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level").limit(1)
