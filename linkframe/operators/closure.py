"""Reachability over edges: closures, cycles, first-parent chains, common ancestors."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one round of a search follows.
HOPS = 3
#: Rounds of a search forwards before chains are folded: enough for graphs as deep as the logarithm of their size.
NEAR = 9
#: Rounds in which ways that never part are followed edge by edge.
FOLLOWED = 15
#: A chain of first parents is thinned until the table has at most so many links, in at most so many rounds.
CHAIN_ROWS = 1_000_000
THIN_ROUNDS = 64


def saved(df: DataFrame) -> DataFrame:
    """A table written once, in the folder the cluster names or, on a local master, one of our own.

    It is read back from Parquet files, so Spark knows its size as it is. A checkpoint hands on what was estimated of the plan before it: joins in rounds
    multiply that, to numbers with twice as many digits each round, and its last stage runs twice.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="linkframe-")
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def meet(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input: neither is sent whole by way of the driver, however small Spark takes it to be."""
    return a.join(b.hint("merge"), on, how)


def _clean(edges: DataFrame) -> DataFrame:
    return saved(edges.select("src", "dst").where("src is not null and dst is not null").distinct())


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), parts)


def _steps(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, dst) of a step of the first kind and one of the second after it."""
    return meet(first.select("src", F.col("dst").alias("via")), second.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of every path of one edge or more; a node on a cycle reaches itself.

    By doubling: pairs at up to 2n steps are those at up to n, and n steps exactly before those. So the number of rounds follows the
    logarithm of the longest path. Known pairs aren't written again, those of exactly n steps are, each round.
    """
    exact = _clean(edges)
    known = [exact]
    while True:
        new = saved(meet(_steps(exact, _union(known)), _union(known), ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return _union(known)
        known.append(new)
        exact = saved(_steps(exact, exact))


def jumped(pointers: DataFrame) -> DataFrame:
    """(id, to, low): where the pointers of ``pointers(id, to)`` lead in the end, by pointer jumping: log n rounds for the longest chain or ring of n.

    ``to`` is the first node on the way that has no pointer, or null for pointers that go round; ``low`` is the least node passed, of a ring the least
    of all. Two stretches of a way that never ends share a node only where it goes round: when the next stretch has the same least node, it does.
    """
    now = pointers.select("id", "to", F.col("id").alias("low"), F.lit(False).alias("ring"), F.lit(True).alias("on"))
    while True:
        far = now.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("low").alias("further_low"), F.col("ring").alias("far_ring"))
        ring = F.col("ring") | F.coalesce(F.col("far_ring") | (F.col("low") == F.col("further_low")), F.lit(False))
        on = F.col("further").isNotNull() & ~ring
        now = meet(now, far, "to", "left").select("id", F.when(~ring, F.coalesce("further", "to")).alias("to"), F.least("low", "further_low").alias("low"), ring.alias("ring"), on.alias("on"))
        now = saved(now)
        if now.where("on").isEmpty():
            return now.select("id", "to", "low")


def _folded(edges: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges without the nodes that have but one way on and aren't ``ends``, and where these lead (id, to); None where there are none.

    Edges to nodes without a way on go too, unless those are ends, and so does all that only goes round.
    """
    open_ = edges.select(F.col("src").alias("dst")).union(ends.select(F.col("id").alias("dst"))).distinct()
    live = meet(edges, open_, "dst", "left_semi").select("src", "dst")
    single = live.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1").select(F.col("src").alias("id"), "to")
    single = saved(meet(single, ends, "id", "left_anti"))
    if single.isEmpty():
        return edges, None
    lead = jumped(single)
    rest = meet(live, single.select(F.col("id").alias("src")), "src", "left_anti")
    rest = meet(rest, lead.select(F.col("id").alias("dst"), "to", F.lit(True).alias("led")), "dst", "left")
    rest = rest.select("src", F.when(F.col("led"), F.col("to")).otherwise(F.col("dst")).alias("dst")).where("dst is not null").distinct()
    return saved(rest), lead.select("id", "to").where("to is not null")


def _back(found: DataFrame, edges: DataFrame) -> DataFrame:
    return meet(edges, found.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(id): the nodes from which an edge or more lead to some target; a search backwards, which never builds pairs.

    Chains are folded first, by pointer jumping, whatever joins them on the way: a node with one way on leads where that one leads. So rounds
    follow the logarithm of a chain's length, and only nodes with several ways on are searched, ``HOPS`` edges a round.
    """
    edges = _clean(edges)
    ends = [saved(targets.select("id").where("id is not null").distinct())]
    found, folds = [], []
    while True:
        edges, fold = _folded(edges, _union(ends))
        if fold is not None:
            folds.append(fold)
        hit = hop = _back(_union(ends), edges)
        for _ in range(HOPS - 1):
            hop = _back(hop, edges)
            hit = hit.union(hop)
        hit = saved(hit.distinct())
        if hit.isEmpty():
            break
        found.append(hit)
        ends.append(hit)
        edges = saved(meet(edges, hit.select(F.col("id").alias("src")), "src", "left_anti"))
    for fold in reversed(folds):  # what a later fold took away is known by now
        more = saved(meet(fold, _union(ends).select(F.col("id").alias("to")).distinct(), "to", "left_semi").select("id"))
        found.append(more)
        ends.append(more)
    return _union(found) if found else ends[0].limit(0)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): what each root reaches, by the edges, itself included.

    Where no node has several ways on, they are followed (``_followed``). Else ``NEAR`` rounds of a search come first. Where they don't get to the end, nodes
    that can be come to by one edge alone are folded into where that comes from (``reaching`` with edges turned round), so the search goes from junction to
    junction; what was folded follows by a join.
    """
    edges = edges.select("src", "dst").where("src <> dst")
    start = saved(roots.select("id").where("id is not null").distinct())
    ways = saved(edges.groupBy("src").agg(F.min("dst").alias("dst"), F.max("dst").alias("last")))
    if ways.where("dst <> last").isEmpty():
        return _followed(ways.select("src", "dst"), start)
    edges = _clean(edges)
    known, done = _search(edges, start, NEAR)
    if done:
        return _union(known)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    folds = []
    while True:
        turned, fold = _folded(turned, start)
        if fold is None:
            break
        folds.append(fold)
    known, _ = _search(turned.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)
    for fold in reversed(folds):
        known.append(saved(meet(_union(known), fold.select("id", F.col("to").alias("node")), "node").select("root", F.col("id").alias("node"))))
    return _union(known)


def _followed(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``reachable`` where each node has one way on at most. Ways from one root never part, so no pair is found twice, and none is compared with those
    that are known, unless a way goes round: rings are taken out, ways end where they come to one, and its other nodes follow by a join.

    ``HOPS`` edges a round, from the ends that the round before came to. What goes on after ``FOLLOWED`` rounds is followed by doubling.
    """
    new = start.select(F.col("id").alias("root"), F.col("id").alias("node"))
    known = [new]
    if edges.isEmpty():
        return new
    step = edges.select(F.col("src").alias("node"), "dst")
    for _ in range(FOLLOWED):
        hops = [new]
        for _ in range(HOPS):
            hops.append(meet(hops[-1], step, "node").select("root", F.col("dst").alias("node")))
        far = saved(_union([hop.withColumn("hop", F.lit(i)) for i, hop in enumerate(hops) if i]))
        known.append(far.select("root", "node"))
        new = far.where(F.col("hop") == HOPS).select("root", "node")
        if new.isEmpty():
            return _union(known)
    jumps, most = [edges], edges.count()
    while not jumps[-1].isEmpty() and 2 ** (len(jumps) - 1) <= most:
        jumps.append(saved(_ahead(jumps[-1])))
    if not jumps[-1].isEmpty():  # as many steps as there are edges, and it still goes on: the way goes round
        ring = saved(cycles(meet(edges, jumps[-1].select("src"), "src", "left_semi")))
        ways = _followed(saved(meet(edges, ring.select(F.col("id").alias("src")), "src", "left_anti")), start)
        come = meet(ways, ring.select(F.col("id").alias("node"), "cycle"), "node")
        return ways.union(meet(come, ring.select("id", "cycle"), "cycle").where("id <> node").select("root", F.col("id").alias("node")))
    deep = [new]
    for jump in jumps[:-1]:
        deep.append(saved(meet(_union(deep), jump.select(F.col("src").alias("node"), "dst"), "node").select("root", F.col("dst").alias("node"))))
    return _union(known + deep[1:])


def _ahead(jump: DataFrame) -> DataFrame:
    """(src, dst) twice as far, where each node has one way on at most."""
    return meet(jump.select("src", F.col("dst").alias("via")), jump.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")


def _search(edges: DataFrame, start: DataFrame, rounds: int | None = None) -> tuple[list[DataFrame], bool]:
    """Tables of (root, node), which share no pair, and whether the search came to its end within ``rounds``. No pair is written twice."""
    new = start.select(F.col("id").alias("root"), F.col("id").alias("node"))
    known = [new]
    if edges.isEmpty():
        return known, True
    while rounds is None or len(known) <= rounds:
        hop, hops = new, []
        for i in range(HOPS):
            hop = meet(hop, edges.select(F.col("src").alias("node"), "dst"), "node").select("root", F.col("dst").alias("node")).distinct()
            hops.append(hop.withColumn("hop", F.lit(i + 1)))
        far = _union(hops).groupBy("root", "node").agg(F.min("hop").alias("hop"))
        far = saved(meet(far, _union(known), ["root", "node"], "left_anti"))
        if far.isEmpty():
            return known, True
        known.append(far.select("root", "node"))
        new = far.where(F.col("hop") == HOPS).select("root", "node")  # the others' ways on were followed in this round
        if new.isEmpty():
            return known, True
    return known, False


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the greatest label that leads to each node. A label's own label leads on as well, so labels jump. Input: (id, label), (src, dst)."""
    while True:
        near = meet(edges, labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("label").alias("near"))
        step = meet(labels, near, "id", "left").select("id", "label", F.greatest("label", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("further"))
        now = saved(meet(step, jump, "to", "left").select("id", F.col("label").alias("old"), F.greatest("to", "further").alias("label")))
        labels = now.select("id", "label")
        if now.where("old <> label").isEmpty():
            return labels


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those from nodes that none leads to, or to nodes that none leaves, as often as that takes a quarter of them."""
    size = None
    while True:
        edges = saved(meet(meet(edges, edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = edges.count()
        if size is not None and 4 * now > 3 * size or not now:
            return edges
        size = now


def cycles(edges: DataFrame) -> DataFrame:
    """(id, cycle): the nodes that reach themselves, with a node of their strongly connected component that names it.

    First what can't be on a cycle goes (no edge in, or none out), and runs of nodes with one edge in and one out become one edge (pointer
    jumping), as often as that leaves less. Then colours: the greatest node that leads to each node; inside each colour the greatest that it leads to.
    Where both are the same node, that is the component. Others go on without edges between colours. No pairs of nodes are built.
    """
    edges = _clean(edges)
    loops = [edges.where("src = dst").select(F.col("src").alias("id"))]
    edges = edges.where("src <> dst")
    runs, rings, size = [], [], None
    while True:
        edges = _trimmed(edges)
        ways = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst"), F.lit(0), F.lit(1)))
        plain = saved(ways.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 and i = 1").select("id"))
        if not plain.isEmpty():
            on = jumped(meet(edges, plain.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("to")))
            back = jumped(meet(edges, plain.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("to")))
            rings.append(on.where("to is null").select("id", F.col("low").alias("cycle")))
            runs.append(meet(on.where("to is not null").select("id", F.col("to").alias("b")), back.select("id", F.col("to").alias("a")), "id").select("id", "a", "b"))
            rest = meet(meet(edges, plain.select(F.col("id").alias("src")), "src", "left_anti"), on.select(F.col("id").alias("dst"), "to"), "dst", "left")
            rest = saved(rest.select("src", F.coalesce("to", "dst").alias("dst")).distinct())
            loops.append(rest.where("src = dst").select(F.col("src").alias("id")))
            edges = rest.where("src <> dst")
        now = edges.count()
        if now == size:
            break
        size = now
    known = []
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        colour = _spread(saved(nodes.select("id", F.col("id").alias("label"))), edges)
        of = lambda end, name: colour.select(F.col("id").alias(end), F.col("label").alias(name))
        edges = saved(meet(meet(edges, of("src", "x"), "src"), of("dst", "y"), "dst").where("x = y").select("src", "dst"))
        turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        goal = _spread(saved(nodes.select("id", F.col("id").alias("label"))), turned)
        done = saved(meet(colour, goal.select("id", F.col("label").alias("goal")), "id").where("label = goal").select("id", F.col("label").alias("cycle")))
        known.append(done)
        edges = saved(meet(meet(edges, done.select(F.col("id").alias("src")), "src", "left_anti"), done.select(F.col("id").alias("dst")), "dst", "left_anti"))
    found = list(rings)
    if known:
        every = _union(known)
        several = every.groupBy("cycle").agg(F.count("*").alias("n")).where("n > 1")
        found.append(saved(meet(every, several, "cycle", "left_semi").select("id", "cycle")))
    loop = saved(_union(loops).distinct())
    named = saved(_named(found, loop)) if found else loop.select("id", F.col("id").alias("cycle"))
    for run in reversed(runs):  # a node inside a run is on a cycle with both its ends
        of = lambda end: named.select(F.col("id").alias(end), F.col("cycle").alias(f"c{end}"))
        inside = meet(meet(run, of("a"), "a"), of("b"), "b").where("ca = cb").select("id", F.col("ca").alias("cycle"))
        named = saved(inside.union(meet(named, inside.select("id"), "id", "left_anti")))
    return named


def _named(found: list[DataFrame], loops: DataFrame) -> DataFrame:
    """Nodes with their cycle; those that only have an edge to themselves are one each."""
    every = _union([x.select("id", "cycle") for x in found])
    return every.union(meet(loops, every, "id", "left_anti").select("id", F.col("id").alias("cycle")))


def on_cycle(edges: DataFrame) -> DataFrame:
    """(id): nodes that reach themselves."""
    return cycles(edges).select("id")


def _thinned(links: DataFrame, head: str, salt: int) -> DataFrame:
    """Links (commit, to, n) without about a quarter of their starts: those that a coin picks while it doesn't pick their ends. Links to them lead on to
    these ends; ``via`` is the commit that such a link passes now, ``via_n`` steps behind its start, null in other links."""
    coin = lambda c: F.xxhash64(F.lit(salt), c) % 2 == 0
    out = coin("commit") & ~coin("to") & (F.col("commit") != head)
    far = links.where(out).select(F.col("commit").alias("to"), F.col("to").alias("further"), F.col("n").alias("further_n"))
    led = meet(links.where(coin("to")), far, "to", "left")
    led = led.select("commit", F.coalesce("further", "to").alias("to"), (F.col("n") + F.coalesce("further_n", F.lit(0))).alias("n"), F.when(F.col("further").isNotNull(), F.col("to")).alias("via"), F.col("n").alias("via_n"))
    past = links.where(~coin("to") & ~out).select("commit", "to", "n", F.lit(None).cast(links.schema["to"].dataType).alias("via"), F.col("n").alias("via_n"))
    return saved(led.union(past))


def first_parent(commits: DataFrame, head: str) -> DataFrame:
    """(commit, hops) from a head through each first parent, newest first: log n rounds.

    ``commits``: commit, parent (the first one, or null). More than ``CHAIN_ROWS`` links are thinned first, each round to about three quarters; what is
    left is followed by doubling, and what was taken out comes back round by round. So all rounds together meet a few times the rows of the table.
    """
    jump = commits.where("parent is not null").select("commit", F.col("parent").alias("to"), F.lit(1).cast("long").alias("n"))
    thinned = []
    while len(thinned) < THIN_ROUNDS and jump.count() > CHAIN_ROWS:
        thinned.append(_thinned(jump, head, len(thinned)))
        jump = thinned[-1].select("commit", "to", "n")
    found = saved(commits.where(F.col("commit") == head).select("commit", F.lit(0).cast("long").alias("hops")))
    size = found.count()
    while True:
        more = meet(found, jump, "commit").select(F.col("to").alias("commit"), (F.col("hops") + F.col("n")).alias("hops"))
        found = saved(found.union(more))  # twice as many as before, so all that is written is twice the chain
        before, size = size, found.count()
        if size == before:
            break
        far = jump.select(F.col("commit").alias("to"), F.col("to").alias("further"), F.col("n").alias("further_n"))
        jump = saved(meet(jump, far, "to").select("commit", F.col("further").alias("to"), (F.col("n") + F.col("further_n")).alias("n")))
    parts = [found]
    for links in reversed(thinned):
        back = links.where("via is not null").select("commit", "via", "via_n")
        parts.append(saved(meet(_union(parts), back, "commit").select(F.col("via").alias("commit"), (F.col("hops") + F.col("via_n")).alias("hops"))))
    return _union(parts).orderBy("hops")


def merge_base(parents: DataFrame, a: str, b: str) -> DataFrame:
    """The best common ancestors of two commits: those that no other common ancestor descends to. ``parents``: src (commit), dst (a parent)."""
    roots = parents.sparkSession.createDataFrame([(a,), (b,)], "id string")
    seen = reachable(parents, roots)
    common = seen.where(F.col("root") == a).select("node").intersect(seen.where(F.col("root") == b).select("node"))
    common = saved(common)
    within = meet(parents, common.select(F.col("node").alias("src")), "src", "left_semi").select("dst")
    return meet(common, within.select(F.col("dst").alias("node")), "node", "left_anti").select(F.col("node").alias("commit"))


def check_history(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """Commits that name a parent which isn't there."""
    known = commits.select(F.col("commit").alias("dst"))
    return parents.where("dst is not null").join(known, "dst", "left_anti").select(F.col("src").alias("commit"), F.col("dst").alias("missing_parent"))
