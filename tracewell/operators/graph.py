"""Version-scoped labelled multigraphs: nodes(entity_key, entity_type, name) and edges(subject, predicate, object, fact_key, ...).

`by` names the columns of the facts that scope a graph, such as the version: all their graphs are one job.  Without it the
facts are one graph.  write(df) stores a table in the shared folder and returns what it reads back, so that the plan of an
iteration does not grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

By = tuple[str, ...]
# The types under which a bare id is looked up, in this order.
ID_TYPES = ("component", "interface", "port", "signal", "dependency", "functional_flow")
UNREGISTERED = "unregistered"


def ends(facts: DataFrame, by: By = ()) -> DataFrame:
    return facts.select(*by, F.explode(F.array("subject", "object")).alias("entity_key"))


def in_each(entities: DataFrame, facts: DataFrame, by: By = ()) -> DataFrame:
    """The registry once for each graph that the facts have: nodes are rows a graph, so the output is as large."""
    return entities.join(F.broadcast(facts.select(*by).distinct()), F.lit(True)) if by else entities


GRAPHS = 64  # graphs whose nodes are the bits of one number


def _graphs(facts: DataFrame, by: By) -> DataFrame:
    n = F.row_number().over(Window.orderBy(*by)) - 1
    return facts.select(*by).distinct().withColumn("n", n).select(*by, F.floor(F.col("n") / GRAPHS).cast("int").alias("span"), (F.col("n") % GRAPHS).cast("int").alias("bit"))


def presence(facts: DataFrame, by: By) -> tuple[DataFrame, DataFrame]:
    """entity_key, span, bits: in which graphs facts name a key; and the graphs (by, span, bit), a row each.

    Bits are combined before anything is exchanged: a key is a row a span of graphs, in however many facts it stands.
    """
    graphs = F.broadcast(_graphs(facts, by))
    pairs = facts.select(*[F.col(c).alias(f"__{c}") for c in by], "subject", "object")
    same = reduce(lambda a, b: a & b, (F.col(f"__{c}").eqNullSafe(F.col(c)) for c in by))
    at = pairs.join(graphs, same).select(F.explode(F.array("subject", "object")).alias("entity_key"), "span", F.expr("shiftleft(1L, bit)").alias("mask"))
    return at.groupBy("entity_key", "span").agg(F.bit_or("mask").alias("bits")), graphs


def implicit_nodes(facts: DataFrame, entities: DataFrame, by: By = (), write=lambda df: df) -> DataFrame:
    """Keys that facts name and the registry does not hold."""
    if not by:
        return ends(facts, by).distinct().join(entities, "entity_key", "left_anti")
    seen, graphs = presence(facts, by)
    return write(seen.join(entities.select("entity_key"), "entity_key", "left_anti")).join(graphs, "span").where(HAS_BIT).select(*by, "entity_key")


def untouched(facts: DataFrame, entities: DataFrame, by: By) -> DataFrame:
    """Rows of the registry (one for all graphs) in each graph whose facts do not name them; the registry is exchanged once."""
    seen, graphs = presence(facts, by)
    spans = F.broadcast(graphs.select("span").distinct())
    placed = entities.join(spans, F.lit(True)).join(seen, ["entity_key", "span"], "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))
    return placed.join(graphs, "span").where(f"not ({HAS_BIT})").select(*by, *entities.columns)


def build_nodes(facts: DataFrame, entities: DataFrame, by: By = (), write=lambda df: df) -> DataFrame:
    """entity_key, entity_type, name, confidence, source: registered nodes, then those only facts name (confidence 0)."""
    confidence = F.col("confidence") if "confidence" in entities.columns else F.lit(1.0)
    known = in_each(entities, facts, by).select(*by, "entity_key", "entity_type", "name", confidence.alias("confidence"), F.lit("registry").alias("source"))
    unknown = implicit_nodes(facts, entities, by, write).select(*by, "entity_key", key_type(F.col("entity_key")).alias("entity_type"), F.substring_index("entity_key", ":", -1).alias("name"), F.lit(0.0).alias("confidence"), F.lit(UNREGISTERED).alias("source"))
    return known.unionByName(unknown)


def clean_attributes(attributes: Column) -> Column:
    """A map of attributes without the empty ones."""
    return F.map_filter(attributes, lambda _, v: F.coalesce(v, F.lit("")) != "")


def ordered_edges(facts: DataFrame, by: By = ()) -> DataFrame:
    return facts.select(*by, "subject", "predicate", "object", "fact_key", "confidence").orderBy(*by, "subject", "predicate", "object", "fact_key")


def degrees(facts: DataFrame, by: By = ()) -> DataFrame:
    """entity_key, in_degree, out_degree, degree; a loop counts twice."""
    marked = facts.select(*by, F.explode(F.array(F.struct(F.col("subject").alias("k"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("object").alias("k"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return marked.groupBy(*by, F.col("x.k").alias("entity_key")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def adjacency(facts: DataFrame, by: By = ()) -> DataFrame:
    """Both directions: node, neighbour, predicate, fact_key, direction."""
    out = facts.select(*by, F.col("subject").alias("node"), F.col("object").alias("neighbour"), "predicate", "fact_key", F.lit("out").alias("direction"))
    return out.unionByName(facts.select(*by, F.col("object").alias("node"), F.col("subject").alias("neighbour"), "predicate", "fact_key", F.lit("in").alias("direction")))


def neighbors(facts: DataFrame, by: By = (), direction: str | None = None) -> DataFrame:
    """node, neighbour: distinct adjacent keys, of out edges ('out', successors), in edges ('in', predecessors) or both."""
    steps = adjacency(facts, by)
    return (steps.where(F.col("direction") == direction) if direction else steps).select(*by, "node", "neighbour").distinct()


def touching(facts: DataFrame, entities: DataFrame, keys: DataFrame, by: By = ()) -> DataFrame:
    """node, predicate, direction, fact_key, neighbour, neighbour_type, neighbour_name of all edges at the given keys."""
    near = adjacency(facts, by).where("not (direction = 'in' and node = neighbour)").join(keys.select(F.col("entity_key").alias("node")), "node")
    named = entities.select(F.col("entity_key").alias("neighbour"), F.col("entity_type").alias("neighbour_type"), F.col("name").alias("neighbour_name"))
    return near.join(named, "neighbour", "left").select(*by, "node", "predicate", "direction", "fact_key", "neighbour", "neighbour_type", "neighbour_name")


def related(facts: DataFrame, entities: DataFrame, keys: DataFrame, by: By = ()) -> DataFrame:
    """The edges at the given keys per predicate and direction: n_edges, neighbours (sorted, joined by commas)."""
    return touching(facts, entities, keys, by).groupBy(*by, "node", "predicate", "direction").agg(F.count(F.lit(1)).alias("n_edges"), F.array_join(F.array_sort(F.collect_set("neighbour")), ",").alias("neighbours"))


def entity_detail(facts: DataFrame, nodes: DataFrame, key: str, by: By = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The node of a key, its outgoing edges and its incoming ones, in order."""
    order = [*by, "predicate", "subject", "object", "fact_key"]
    return nodes.where(F.col("entity_key") == key), facts.where(F.col("subject") == key).orderBy(*order), facts.where(F.col("object") == key).orderBy(*order)


def search_entities(entities: DataFrame, query: str) -> DataFrame:
    """Entities whose key or name holds the query, whatever the case; all for an empty query."""
    wanted = query.strip().lower()
    found = entities.where(F.contains(F.lower(F.concat_ws(" ", "entity_key", "name")), F.lit(wanted))) if wanted else entities
    return found.orderBy("entity_key")


def facts_of_id(facts: DataFrame, ident: str) -> DataFrame:
    """Facts with an end whose key ends in `:ident`, whatever the case."""
    tail = f":{ident.strip().lower()}"
    return facts.where(F.lower("subject").endswith(tail) | F.lower("object").endswith(tail)).orderBy("fact_key")


def resolve_keys(idents: DataFrame, entities: DataFrame) -> DataFrame:
    """ident -> entity_key: the exact key, else type:ID in any case, else the id under the types of ID_TYPES in order, else
    the name that only one entity has; null if there is none.  An ident with a colon is never a name."""
    trimmed = idents.withColumn("__i", F.trim("ident"))
    keys = entities.select("entity_key").distinct()
    colon = F.contains("__i", F.lit(":"))
    typed = F.when(colon, F.concat(F.lower(F.substring_index("__i", ":", 1)), F.lit(":"), F.upper(F.expr("substring(__i, locate(':', __i) + 1)"))))
    found = trimmed.join(keys.select(F.col("entity_key").alias("__i"), F.col("entity_key").alias("exact")), "__i", "left")
    found = found.withColumn("__t", typed).join(keys.select(F.col("entity_key").alias("__t"), F.col("entity_key").alias("typed")), "__t", "left")
    rank = F.array_position(F.array(*map(F.lit, ID_TYPES)), key_type(F.col("entity_key")))
    ids = keys.where(rank > 0).select(F.expr("substring(entity_key, locate(':', entity_key) + 1)").alias("__u"), rank.alias("r"), "entity_key").groupBy("__u").agg(F.min_by("entity_key", "r").alias("by_id"))
    name = entities.select(F.lower("name").alias("__l"), "entity_key").groupBy("__l").agg(F.min("entity_key").alias("by_name"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    found = found.withColumn("__u", F.when(~colon, F.upper("__i"))).join(ids, "__u", "left").withColumn("__l", F.when(~colon, F.lower("__i"))).join(name, "__l", "left")
    return found.select("ident", F.coalesce("exact", "typed", "by_id", "by_name").alias("entity_key"))


def k_hop(facts: DataFrame, seeds: DataFrame, hops: int, by: By = (), entity_type: str | None = None, write=lambda df: df) -> DataFrame:
    """seed, node, depth: the nodes within `hops` undirected steps of each seed, at their least depth.

    With a type, a step only reaches nodes of it.  Seeds carry the columns of `by`, or start in every graph that has them.
    Only edges that begin at a type of the frontier are exchanged (`_from_types`); what repeats goes once, with what was
    reached before.
    """
    if hops < 0:
        raise ValueError("hops must not be negative")
    pairs = facts.where("subject <> object")
    steps = pairs.select(*by, F.col("subject").alias("node"), F.col("object").alias("neighbour")).unionByName(pairs.select(*by, F.col("object").alias("node"), F.col("subject").alias("neighbour")))
    steps = steps.where(key_type(F.col("neighbour")) == entity_type) if entity_type else steps
    seen = frontier = write(_starts(facts, seeds, by).withColumn("depth", F.lit(0)))
    for depth in range(1, hops + 1):
        reached = frontier.join(_from_types(steps, frontier), [*by, "node"]).select(*by, "seed", F.col("neighbour").alias("node"), F.lit(depth).alias("depth"))
        if depth > 1:  # one exchange: of a row the least depth, where it is this one
            reached = reached.unionByName(seen)
        least = reached.groupBy(*by, "seed", "node").agg(F.min("depth").alias("depth"))
        frontier = least.where(F.col("depth") == depth)
        frontier = write(frontier) if depth < hops else frontier
        seen = seen.unionByName(frontier)
    return seen


TYPES = 64  # types of a frontier that are told apart


def _from_types(steps: DataFrame, frontier: DataFrame) -> DataFrame:
    """The steps that begin at a node of a type that the frontier has; all if it has many types."""
    kinds = [r[0] for r in frontier.select(key_type(F.col("node"))).distinct().limit(TYPES + 1).collect()]
    return steps.where(key_type(F.col("node")).isin(kinds)) if len(kinds) <= TYPES else steps


def _starts(facts: DataFrame, seeds: DataFrame, by: By) -> DataFrame:
    if all(c in seeds.columns for c in by):
        found = seeds.select(*by, "entity_key")
    else:
        found = ends(facts, by).join(seeds.select("entity_key"), "entity_key", "left_semi").select(*by, "entity_key")
    return found.distinct().select(*by, F.col("entity_key").alias("seed"), F.col("entity_key").alias("node"))


def _node_id(seed: int, by: By, key: str) -> Column:
    """A 64-bit name of a node of a graph; `numbered` finds a seed under which no two nodes share one."""
    return F.xxhash64(F.lit(seed), *[x for c in (*by, key) for x in (F.col(c).isNull(), F.col(c))])


def numbered(facts: DataFrame, write, by: By = (), names=_node_id) -> tuple[DataFrame, int]:
    """The nodes of all graphs (by, entity_key, id) and the seed that makes their ids unique.

    Iterations exchange ids; names are hashes that were checked, so that no two nodes are taken for one.
    """
    seed = 0
    while True:
        each = ends(facts, by).select(*by, "entity_key", names(seed, by, "entity_key").alias("id"))
        nodes = write(each.groupBy("id", *by, "entity_key").agg(F.lit(1).alias("one")).drop("one"))
        if nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return nodes, seed
        seed += 1


def _id_steps(facts: DataFrame, seed: int, by: By, directed: bool, backward: bool = False, names=_node_id) -> DataFrame:
    """a, b: each step from a node to another, as ids.  A step that repeats changes nothing."""
    pairs = facts.where("subject <> object").select(names(seed, by, "subject").alias("a"), names(seed, by, "object").alias("b"))
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return (turned if backward else pairs) if directed else pairs.union(turned)


SEEDS = 64  # seeds whose searches share a number


def _dealt(seeds: DataFrame, by: By) -> DataFrame:
    """Seeds (by, entity_key, id) dealt to blocks of SEEDS a graph: block, bit."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("entity_key")) - 1
    return seeds.withColumn("n", n).select(*by, "entity_key", "id", F.floor(F.col("n") / SEEDS).cast("int").alias("block"), (F.col("n") % SEEDS).cast("int").alias("bit"))


def _search(seeds: DataFrame, steps: DataFrame, write, both_ways: bool, enough=lambda level: False) -> list[DataFrame]:
    """Breadth-first searches from all seeds at once: a table a level of block, id, bits, the seeds whose search first
    reaches the node there.

    What 64 searches reach is one number a node, so a level exchanges the steps and a row a node of its frontier.  Steps that
    go both ways lead to nodes that are new or stand in the last two levels; other ones are held against all levels.
    """
    mask = F.expr("shiftleft(1L, bit)")
    levels = [write(seeds.groupBy("block", "id").agg(F.bit_or(mask).alias("bits")))]
    while not levels[-1].isEmpty() and not enough(levels):
        reached = levels[-1].join(steps, levels[-1]["id"] == steps["a"]).select("block", F.col("b").alias("id"), "bits", F.lit(0).cast("long").alias("past"))
        held = levels[-2:] if both_ways else levels
        past = reduce(DataFrame.union, (x.select("block", "id", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("past")) for x in held))
        all_ = reached.union(past).groupBy("block", "id").agg(F.bit_or("bits").alias("bits"), F.bit_or("past").alias("past"))
        levels.append(write(all_.select("block", "id", F.expr("bits & ~past").alias("bits")).where("bits <> 0")))
    return levels


def _levels(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, (x.select("block", "id", "bits", F.lit(n).cast("long").alias("length")) for n, x in enumerate(levels)))


HAS_BIT = "shiftright(bits, bit) & 1L = 1L"


def shortest_lengths(facts: DataFrame, seeds: DataFrame, write, by: By = (), directed: bool = False) -> DataFrame:
    """seed, node, length of all nodes that steps reach from a seed, however many.

    The searches run over ids, 64 seeds to a number (`_search`), until nothing is new; names are joined to what they found.
    """
    nodes, seed = numbered(facts, write, by)
    on = [c for c in by if c in seeds.columns] + ["entity_key"]
    begin = write(_dealt(nodes.join(seeds.select(*on).distinct(), on, "left_semi"), by))
    levels = _search(begin, write(_id_steps(facts, seed, by, directed)), write, not directed)
    if len(levels) == 1:
        levels = levels * 2  # no seed
    found = _levels(levels).where("length > 0").join(nodes, "id").select(*by, "block", F.col("entity_key").alias("node"), "bits", "length")
    named = begin.select(*by, "block", "bit", F.col("entity_key").alias("seed"))
    return found.join(named, [*by, "block"]).where(HAS_BIT).select(*by, "seed", "node", "length")


def shortest_paths(facts: DataFrame, pairs: DataFrame, write, by: By = (), directed: bool = True) -> DataFrame:
    """source, target, length, path (array of keys) for every pair (source, target) that steps join.

    Of paths of equal length the one whose keys come first in order is returned; a path from a node to itself has length
    0.  The search starts at the targets, 64 to a number, and ends when every source is met or nothing is new; from each
    source the first key that is one step nearer is taken, once for all pairs that come by a node on their way to a target.
    """
    nodes, seed = numbered(facts, write, by)
    key = lambda name: nodes.select(*by, F.col("entity_key").alias(name), F.col("id").alias(f"{name}_id"))
    asked = pairs.select(*by, "source", "target").distinct().join(key("source"), [*by, "source"]).join(key("target"), [*by, "target"])
    asked = write(asked)
    ends_at = asked.select(*by, F.col("target").alias("entity_key"), F.col("target_id").alias("id")).distinct()
    begin = write(_dealt(ends_at, by))
    wanted = write(asked.join(begin.select(F.col("id").alias("target_id"), "block", "bit"), "target_id"))
    n = wanted.count()
    seen = [0]

    def met(levels):
        at = levels[-1].withColumnRenamed("id", "source_id")
        seen[0] += wanted.join(at, ["block", "source_id"]).where(HAS_BIT).count()
        return seen[0] >= n

    levels = _search(begin, write(_id_steps(facts, seed, by, directed, backward=True)), write, not directed, met)
    far = _levels(levels)
    steps = write(_id_steps(facts, seed, by, directed))
    start = wanted.join(far.withColumnRenamed("id", "source_id"), ["block", "source_id"]).where(HAS_BIT)
    walk = write(start.select(*by, "source", "target", "block", "bit", "length", F.col("length").alias("left"), F.col("source_id").alias("at"), F.array("source").alias("path")))
    done = [walk.where("left = 0")]
    for _ in range(len(levels) - 1):
        going = walk.where("left > 0")
        here = going.select("block", "bit", "at", "left").distinct()
        near = here.join(steps, here["at"] == steps["a"]).select("block", "bit", "at", F.col("b").alias("id"), (F.col("left") - 1).alias("length"))
        nearer = near.join(far, ["block", "id", "length"]).where(HAS_BIT).join(nodes.select("id", "entity_key"), "id")
        first = nearer.groupBy("block", "bit", "at").agg(F.min("entity_key").alias("key"), F.min_by("id", "entity_key").alias("next"))
        # a block and a bit name a target within its graph, a node belongs to one graph
        walk = write(going.join(first, ["block", "bit", "at"]).select(*by, "source", "target", "block", "bit", "length", (F.col("left") - 1).alias("left"), F.col("next").alias("at"), F.concat("path", F.array("key")).alias("path")))
        done.append(walk.where("left = 0"))
    return reduce(DataFrame.union, done).select(*by, "source", "target", "length", "path")


FEW = 1 << 16  # edges that are joined up on the driver, where a round of jobs costs more than the work


def _merged(edges: list) -> list[tuple[int, int]]:
    """Each end of the edges and the one that stands for its component."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        up[top(a)] = top(b)
    return [(x, top(x)) for x in list(up)]


def weak_components(facts: DataFrame, write, rounds: int = 40, by: By = ()) -> DataFrame:
    """entity_key, component (the smallest key), by contraction.

    In a round every node merges into the one of its neighbours and itself that comes first in an order drawn for the round;
    edges between what is merged go, the rest join what is left.  About half the nodes at least go in a round, so the first
    rounds are nearly all the work; the last FEW edges are joined up on the driver.  Where each node went is composed at the end, from the smallest table to the largest.
    """
    nodes, seed = numbered(facts, write, by)
    edges, went = write(_id_steps(facts, seed, by, True)), []
    for n in range(rounds):
        if edges.isEmpty():
            break
        rest = edges.take(FEW + 1) if n else []
        if n and len(rest) <= FEW:
            went.append(write(facts.sparkSession.createDataFrame(_merged(rest), "a long, b long")))
            edges = edges.limit(0)
            break
        drawn = lambda c: F.xxhash64(F.lit(n), F.col(c))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min_by("b", drawn("b")).alias("b"))
        into = write(least.select("a", F.when(drawn("b") < drawn("a"), F.col("b")).otherwise(F.col("a")).alias("b")))
        went.append(into)
        moved = edges.join(into.withColumnRenamed("b", "x"), "a").join(into.select(F.col("a").alias("b"), F.col("b").alias("y")), "b").where("x <> y")
        edges = write(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        if not edges.isEmpty():
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    placed = nodes.withColumn("root", F.col("id"))
    if went:
        root = went[-1]
        for into in went[-2::-1]:
            root = into.join(root.select(F.col("a").alias("b"), F.col("b").alias("top")), "b", "left").select("a", F.coalesce("top", "b").alias("b"))
        placed = nodes.join(root.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = write(placed.select(*by, "entity_key", "root"))
    smallest = write(placed.groupBy("root").agg(F.min("entity_key").alias("component")))
    return placed.join(smallest, "root").select(*by, "entity_key", "component")


def component_sizes(components: DataFrame, min_size: int = 1, by: By = ()) -> DataFrame:
    """component, size of those with at least `min_size` nodes, the largest first, then by the smallest key."""
    sized = components.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return sized.orderBy(*by, F.col("size").desc(), "component")


def filter_graph(facts: DataFrame, nodes: DataFrame | None, entity_type: str | None = None, predicate: str | None = None, min_confidence: float | None = None, node: str | None = None, depth: int = 0, by: By = (), endpoints_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that pass all filters given.

    A type keeps its nodes, or with `node` limits each step from it; `node` and `depth` keep what undirected steps reach.
    Edges need both ends, the predicate and the confidence; nodes without such an edge stay unless `endpoints_only`.
    Without `nodes` those around `node` are told by the facts alone.
    """
    if nodes is None:
        if node is None:
            raise ValueError("nodes are needed where no node is given")
        nodes = ends(facts, by).where(F.col("entity_key") == node)
        near = k_hop(facts, nodes.select("entity_key").distinct(), depth, by, entity_type).select(*by, F.col("node").alias("entity_key"))
        kept = near.distinct()
        if nodes.isEmpty():
            raise ValueError(f"node {node!r} not in graph")
    elif node is not None:
        seed = nodes.where(F.col("entity_key") == node).select("entity_key").distinct()
        if seed.isEmpty():
            raise ValueError(f"node {node!r} not in graph")
        near = k_hop(facts, seed, depth, by, entity_type).select(*by, F.col("node").alias("entity_key"))
        kept = nodes.join(near.distinct(), [*by, "entity_key"], "left_semi") if depth else nodes.where(F.col("entity_key") == node)
    else:
        kept = nodes.where(F.col("entity_type") == entity_type) if entity_type else nodes
    edges = facts
    if predicate is not None:
        edges = edges.where(F.col("predicate") == predicate)
    if min_confidence is not None:
        edges = edges.where(F.col("confidence") >= min_confidence)
    if entity_type or node is not None:
        keys = kept.select(*[c for c in by if c in kept.columns], "entity_key").distinct()
        on = [c for c in by if c in kept.columns]
        for end in ("subject", "object"):
            edges = edges.join(keys.withColumnRenamed("entity_key", end), [*on, end], "left_semi")
    if endpoints_only:
        kept = kept.join(ends(edges, by).distinct(), [*[c for c in by if c in kept.columns], "entity_key"], "left_semi")
    return kept, edges


# Which types a predicate joins.
DOMAIN_RANGE = (
    ("provides", "component", "interface"),
    ("requires", "component", "interface"),
    ("depends_on", "component", "component"),
    ("carries", "interface", "signal"),
    ("implements", "port", "interface"),
    ("participates_in", "component", "functional_flow"),
)


def key_type(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def domain_range_violations(facts: DataFrame, rules=DOMAIN_RANGE, by: By = ()) -> DataFrame:
    """Facts whose ends are of types that their predicate does not join; of an unknown predicate all."""
    allowed = reduce(lambda a, b: a | b, ((F.col("predicate") == p) & (key_type(F.col("subject")) == s) & (key_type(F.col("object")) == o) for p, s, o in rules), F.lit(False))
    return facts.where(~allowed).select(*by, "fact_key", key_type(F.col("subject")).alias("subject_type"), "predicate", key_type(F.col("object")).alias("object_type"))


RULES = ("empty_end", "predicate", "confidence_range", "domain_range", "fact_key", "duplicate_fact", "provenance", "node_key", "unregistered", "orphan", "dependency_orphan")
ERRORS = RULES[:7]  # the rest are warnings


def validate(facts: DataFrame, entities: DataFrame, by: By = (), rules=DOMAIN_RANGE, write=lambda df: df) -> DataFrame:
    """rule, n: how many rows break each integrity rule, in every graph, rules that hold included.

    Errors: ends, known predicates, confidences in [0, 1], types that a predicate joins, a fact key, each once, and the
    document in the provenance where facts have one.  Warnings: keys without a type or of another type than the node, ends
    that the registry lacks, nodes without an edge (dependencies, which never have one, apart).
    """
    nodes = build_nodes(facts, entities, by, write)
    keys = entities.select("entity_key").distinct()  # a node that only facts name has an edge
    lone = untouched(facts, keys, by) if by else keys.join(ends(facts).distinct(), "entity_key", "left_anti")
    dependency = F.col("entity_key").startswith("dependency:")
    blank = (F.col("subject") == "") | (F.col("object") == "") | F.col("subject").isNull() | F.col("object").isNull()
    known = F.col("predicate").isin(*{p for p, _, _ in rules})
    unnamed = F.coalesce(F.col("provenance.document_name"), F.lit("")) == "" if "provenance" in facts.columns else F.lit(False)
    misshapen = ~F.col("entity_key").rlike("^[^:\\s]+:.+") | (key_type(F.col("entity_key")) != F.when(F.col("entity_key").startswith("autosar:"), "autosar").otherwise(F.col("entity_type")))
    broken = {
        "empty_end": facts.where(blank),
        "predicate": facts.where(~known),
        "confidence_range": facts.where(~F.col("confidence").between(0, 1)),
        "domain_range": domain_range_violations(facts.where(known), rules, by),
        "fact_key": facts.where(F.coalesce("fact_key", F.lit("")) == ""),
        "duplicate_fact": facts.groupBy(*by, "fact_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "provenance": facts.where(unnamed),
        "node_key": nodes.where(misshapen),
        "unregistered": nodes.where(F.col("source") == UNREGISTERED),
        "orphan": lone.where(~dependency),
        "dependency_orphan": lone.where(dependency),
    }
    found = reduce(DataFrame.union, (df.select(*by, F.lit(rule).alias("rule")) for rule, df in broken.items())).groupBy(*by, "rule").agg(F.count(F.lit(1)).alias("n"))
    every = facts.sparkSession.createDataFrame([(r,) for r in RULES], "rule string")
    every = in_each(every, facts, by)
    return every.join(found, [*by, "rule"], "left").select(*by, "rule", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def dangling_references(facts: DataFrame, entities: DataFrame, by: By = ()) -> DataFrame:
    """Facts with an end that the registry lacks."""
    missing = implicit_nodes(facts, entities, by)
    each = facts.select(*by, "fact_key", F.explode(F.array("subject", "object")).alias("entity_key"))
    return each.join(missing, [*by, "entity_key"], "left_semi").select(*by, "fact_key").distinct()


def statistics(facts: DataFrame, nodes: DataFrame, by: By = ()) -> DataFrame:
    """kind, name, n: nodes by type and edges by predicate."""
    on = [c for c in by if c in nodes.columns]
    n = nodes.groupBy(*on, F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(*on, F.lit("node").alias("kind"), "name", "n")
    return n.unionByName(facts.groupBy(*by, F.col("predicate").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.lit("edge").alias("kind"), "name", "n"))


def export_json(facts: DataFrame, nodes: DataFrame, by: By = ()) -> DataFrame:
    """One JSON line per node and per edge (a node-link document by lines; no task gathers the graph)."""
    n = nodes.select(*by, F.lit("node").alias("kind"), F.to_json(F.struct("entity_key", "entity_type", "name")).alias("line"))
    return n.union(facts.select(*by, F.lit("edge").alias("kind"), F.to_json(F.struct("subject", "predicate", "object", "fact_key")).alias("line")))


def node_link(facts: DataFrame, nodes: DataFrame, by: By = ()) -> DataFrame:
    """One node-link JSON document a graph, nodes and edges in order.  A graph must fit a row; `export_json` has no such limit."""
    n = nodes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("entity_key").alias("id"), "entity_type", "name"))).alias("nodes"))
    e = facts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("subject").alias("source"), "predicate", F.col("object").alias("target"), F.col("fact_key").alias("key"), "confidence"))).alias("edges"))
    both = n.join(e, list(by), "left") if by else n.join(e, F.lit(True))
    document = F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), F.size("nodes").alias("node_count"), F.coalesce(F.size("edges"), F.lit(0)).alias("edge_count"), "nodes", "edges"))
    return both.select(*by, document.alias("document"))


class Graph:
    """The graphs of facts over a registry, with all that can be asked of them."""

    def __init__(self, facts: DataFrame, entities: DataFrame, write=lambda df: df, by: By = ()):
        self.facts, self.entities, self.write, self.by = facts, entities, write, by
        self.nodes = build_nodes(facts, entities, by)

    def validate(self) -> DataFrame:
        return validate(self.facts, self.entities, self.by)

    def filter(self, **filters) -> Graph:
        nodes, edges = filter_graph(self.facts, self.nodes, by=self.by, **filters)
        out = Graph(edges, self.entities, self.write, self.by)
        out.nodes = nodes
        return out

    def related(self, key: str) -> DataFrame:
        return touching(self.facts, self.entities, self.facts.sparkSession.createDataFrame([(key,)], "entity_key string"), self.by)

    def shortest_path(self, source: str, target: str, directed: bool = True) -> list[str] | None:
        pair = self.facts.sparkSession.createDataFrame([(source, target)], "source string, target string")
        if self.by:
            raise ValueError("a path is asked of one graph")
        row = shortest_paths(self.facts, pair, self.write, directed=directed).first()
        return row["path"] if row else None

    def resolve(self, ident: str) -> str | None:
        return resolve_keys(self.facts.sparkSession.createDataFrame([(ident,)], "ident string"), self.nodes).first()["entity_key"]

    def statistics(self) -> DataFrame:
        return statistics(self.facts, self.nodes, self.by)

    def edge_records(self) -> DataFrame:
        return ordered_edges(self.facts, self.by)

    def export_json(self) -> DataFrame:
        return export_json(self.facts, self.nodes, self.by)
