"""Clusters by complete linkage: components of the edge graph, a greedy kernel within each, and the filters after it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..runtime import cut, with_position
from ..schema import Config
from . import blocking
from .blocking import DEFAULT

#: A component with more edges than this isn't one task of the kernel; linked_in_rounds() links it.
KERNEL_EDGES = 200_000
TEST_IMPORTS = ("testing", *(f"github.com/stretchr/testify/{x}" for x in ("assert", "mock", "require", "suite")))


def components(links: DataFrame) -> DataFrame:
    """(fn_id, component): connected components of links (i, j), named by their least id.

    Every round a vertex takes the least label around it and then the label of that label, so a chain of n takes about log n
    rounds. Each round is kept in the shared folder, which bounds the plan.
    """
    both = cut(links.select(F.col("i").alias("a"), F.col("j").alias("b")).union(links.select("j", "i")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("l")))
    while True:
        around = both.join(labels.select(F.col("v").alias("b"), "l"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        low = labels.join(around, "v").select("v", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("v").alias("m"), F.col("l").alias("to"))
        new = cut(low.join(jump, "m").select("v", F.least("m", "to").alias("l"), (F.least("m", "to") < F.col("l")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select(F.col("v").alias("fn_id"), F.col("l").alias("component"))
        labels = new.drop("moved")


def agglomerate(edges: list[tuple[int, int, float]], n: int, threshold: float, merge_floor: float | None = None) -> list[list[int]]:
    """Groups of 2 or more of the vertices 0..n-1, members in the order in which merging appended them.

    Edges are walked from the highest score down (ties by i, then j). Two groups merge if every pair across them has a score of
    at least ``threshold``; the smaller is appended to the larger. Edges under ``merge_floor`` start no merge.
    """
    score = {(i, j): s for i, j, s in edges}
    group, members = list(range(n)), {v: [v] for v in range(n)}
    for i, j, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if merge_floor is not None and s < merge_floor:
            break
        a, b = group[i], group[j]
        if a == b or any(score.get((min(x, y), max(x, y)), 0.0) < threshold for x in members[a] for y in members[b]):
            continue
        if len(members[a]) < len(members[b]):
            a, b = b, a
        for v in members[b]:
            group[v] = a
        members[a] += members.pop(b)
    return [m for m in members.values() if len(m) > 1]


def linked_in_rounds(edges: DataFrame, merge_floor: float = 0.0) -> DataFrame:
    """(component, g, v, pos): agglomerate()'s groups, of components of any size: v is a vertex, g the group's least.

    edges: (component, a, b, score) with a < b, of pairs that may be in one group; vertices are numbers in the order that breaks ties.

    Two groups can merge only if every pair across them is an edge, and once they can't they never will. So pairs of groups are kept
    with the first of their edges, and dropped when one is missing. In each round all pairs merge whose edge comes before all
    others at both groups: no other merge can happen to either before, so the order of merges is the greedy one's. Edges under
    ``merge_floor`` start no merge.
    """
    lo, hi = edges.select("component", F.col("a").alias("v")), edges.select("component", F.col("b").alias("v"))
    of = cut(lo.union(hi).distinct().select("component", "v", F.col("v").alias("g"), F.lit(0).alias("pos"), F.lit(1).alias("size")))
    pairs = cut(edges.select("component", F.col("a").alias("x"), F.col("b").alias("y"), F.struct((-F.col("score")).alias("s"), F.col("a").alias("i"), F.col("b").alias("j")).alias("first"), F.lit(1).alias("xs"), F.lit(1).alias("ys")))
    starts = F.col("first.s") <= -merge_floor
    while not pairs.where(starts).isEmpty():
        ends = pairs.select("component", F.col("x").alias("g"), "first").union(pairs.select("component", "y", "first")).groupBy("component", "g").agg(F.min("first").alias("best"))
        m = pairs.join(ends.select("component", F.col("g").alias("x"), F.col("best").alias("bx")), ["component", "x"]).join(ends.select("component", F.col("g").alias("y"), F.col("best").alias("by")), ["component", "y"])
        m = m.where("first = bx and first = by").where(starts)
        at = of.select(F.col("component").alias("c"), F.col("v").alias("w"), F.col("g").alias("gi"))
        m = m.join(at, (F.col("component") == F.col("c")) & (F.col("first.i") == F.col("w"))).drop("c", "w")
        # the larger stays in front; of equal ones that of the edge's first vertex
        front = F.when(F.col("xs") > F.col("ys"), F.col("x")).when(F.col("ys") > F.col("xs"), F.col("y")).otherwise(F.col("gi"))
        m = m.withColumn("front", front).select("component", F.least("x", "y").alias("to"), F.explode(F.array(
            F.struct(F.col("x").alias("g"), F.when(F.col("front") == F.col("x"), 0).otherwise(F.col("ys")).alias("shift"), (F.col("xs") + F.col("ys")).alias("now")),
            F.struct(F.col("y").alias("g"), F.when(F.col("front") == F.col("y"), 0).otherwise(F.col("xs")).alias("shift"), (F.col("xs") + F.col("ys")).alias("now")),
        )).alias("e"))
        moved = cut(m.select("component", "to", "e.g", "e.shift", "e.now"))
        of = cut(of.join(moved, ["component", "g"], "left").select("component", "v", F.coalesce("to", "g").alias("g"), (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), F.coalesce("now", "size").alias("size")))
        for k in "xy":
            to = moved.select("component", F.col("g").alias(k), F.col("to").alias("to"), F.col("now").alias("now"))
            pairs = pairs.join(to, ["component", k], "left").withColumns({f"{k}s": F.coalesce("now", f"{k}s"), f"{k}n": F.when(F.col("to").isNull(), 1).otherwise(2), k: F.coalesce("to", k)}).drop("to", "now")
        pairs = pairs.where("x <> y").select("component", "first", "xn", "yn", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.when(F.col("x") < F.col("y"), F.col("xs")).otherwise(F.col("ys")).alias("xs"), F.when(F.col("x") < F.col("y"), F.col("ys")).otherwise(F.col("xs")).alias("ys"))
        pairs = pairs.groupBy("component", "x", "y").agg(F.count("*").alias("n"), F.max(F.col("xn") * F.col("yn")).alias("all"), F.min("first").alias("first"), F.max("xs").alias("xs"), F.max("ys").alias("ys"))
        pairs = cut(pairs.where("n = all").drop("n", "all"))
    return of.where("size > 1").select("component", "g", "v", "pos")


def groups(links: DataFrame, fns: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, cluster_id, fn_id, member_pos): complete-linkage groups of 2 or more; cluster_id is the least fn_id in it.

    links: (*by, component, i, j, geo). Components are independent: merges follow edges, and the gate reads only scores of pairs
    inside a component. So each is one group of the kernel, ordered by the functions' names as the whole corpus would be. Components
    of more than KERNEL_EDGES edges are linked in rounds instead, with the same result.
    """
    keys = [*by, "component"]
    large = cut(links.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > KERNEL_EDGES).drop("n"))
    if large.isEmpty():
        return _kernel_groups(links, fns, cfg, by)
    mark = large.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    rest = _kernel_groups(links.join(mark, same, "left_anti"), fns, cfg, by)
    e = links.join(mark, same, "left_semi").where(F.col("geo") >= cfg.identify_threshold).withColumn("component", F.struct(*keys))
    order = fns.select(F.col("fn_id").alias("v"), F.concat_ws("/", "package", "name").alias("key"), "file_path", "start_line")
    place = with_position(order.join(e.select(F.col("i").alias("v")).union(e.select("j")).distinct(), "v").select("v", F.struct("key", "file_path", "start_line", "v").alias("o")), [F.col("o")]).select("v", "position")
    for k in "ij":
        e = e.join(place.select(F.col("v").alias(k), F.col("position").alias(f"p{k}")), k)
    e = e.select("component", F.least("pi", "pj").alias("a"), F.greatest("pi", "pj").alias("b"), F.col("geo").alias("score"))
    done = linked_in_rounds(e, 0.75 if cfg.compat else 0.0).join(place.select(F.col("position").alias("v"), F.col("v").alias("fn_id")), "v")
    least = done.groupBy("component", "g").agg(F.min("fn_id").alias("cluster_id"))
    done = done.join(least, ["component", "g"]).select(*[F.col(f"component.{k}").alias(k) for k in by], "cluster_id", "fn_id", F.col("pos").cast("int").alias("member_pos"))
    return rest.unionByName(done)


def _kernel_groups(links: DataFrame, fns: DataFrame, cfg: Config, by: tuple[str, ...]) -> DataFrame:
    """groups() by agglomerate(), a task for each component."""
    named = fns.select("fn_id", F.concat_ws("/", "package", "name").alias("key"), "file_path", "start_line")
    e = links.select(*by, "component", "i", "j", "geo")
    for k in "ij":
        e = e.join(named.select(F.col("fn_id").alias(k), *[F.col(x).alias(f"{x}_{k}") for x in ("key", "file_path", "start_line")]), k)
    threshold, floor, keys = cfg.identify_threshold, 0.75 if cfg.compat else None, list(by)
    kinds = {f.name: f.dataType.simpleString() for f in links.schema.fields}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ends = pd.concat([part[[f"{x}_{k}" for x in ("key", "file_path", "start_line")] + [k]].set_axis(["key", "path", "line", "id"], axis=1) for k in "ij"]).drop_duplicates("id")
        ids = ends.sort_values(["key", "path", "line", "id"])["id"].tolist()
        place = {v: n for n, v in enumerate(ids)}
        local = [(min(place[i], place[j]), max(place[i], place[j]), s) for i, j, s in zip(part["i"], part["j"], part["geo"], strict=True)]
        rows = [(min(ids[v] for v in g), ids[v], pos) for g in agglomerate(local, len(ids), threshold, floor) for pos, v in enumerate(g)]
        out = pd.DataFrame(rows, columns=["cluster_id", "fn_id", "member_pos"])
        for x in keys:
            out[x] = part[x].iloc[0]
        return out[[*keys, "cluster_id", "fn_id", "member_pos"]]

    schema = ", ".join([*(f"{x} {kinds[x]}" for x in keys), "cluster_id long, fn_id long, member_pos int"])
    return e.groupBy(*by, "component").applyInPandas(run, schema)


def link_groups(edges: DataFrame, fns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """groups() of edges (i, j, geo)."""
    of = components(edges)
    return groups(edges.join(of.withColumnRenamed("fn_id", "i"), "i"), fns, cfg)


def kept(grouped: DataFrame, fns: DataFrame, n_rows: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """The groups that are clusters: not too small, not as common as a primitive, not mostly tests, not all named init.

    n_rows: (*by, n), the number of all input rows, eligible or not; the primitive bound is a share of it.
    """
    tests = F.array(*[F.lit(x) for x in TEST_IMPORTS])
    m = grouped.join(fns.select("fn_id", "name", F.arrays_overlap("direct_imports", tests).alias("test")), "fn_id")
    stats = m.groupBy(*by, "cluster_id").agg(F.count("*").alias("size"), F.count_if("test").alias("tests"), F.bool_and(F.col("name") == "init").alias("init"))
    stats = stats.join(F.broadcast(n_rows), list(by)) if by else stats.crossJoin(F.broadcast(n_rows))  # a row for each run
    good = (F.col("size") >= cfg.identify_min_size) & (F.col("size") < F.col("n") * cfg.primitive_threshold) & (F.col("tests") <= F.floor(F.col("size") / 2)) & ~F.col("init")
    return grouped.join(stats.where(good).select(*by, "cluster_id"), [*by, "cluster_id"]).select(*by, "cluster_id", "fn_id", "member_pos")


def orphans(below: DataFrame, grouped: DataFrame, fns: DataFrame) -> DataFrame:
    """(fn_id): functions that almost joined something, joined nothing, and aren't named init."""
    named = fns.where("name <> 'init'").select("fn_id")
    return below.join(named, "fn_id").join(grouped.select("fn_id"), "fn_id", "left_anti").distinct()


def exact_groups(fns: DataFrame, least: int = 2) -> DataFrame:
    """(cluster_id, fn_id, member_pos): functions of the same token sequence; a stand-in for clusters that SQL can check."""
    from ..functions.scalars import seq_key

    w = W.partitionBy("k")
    d = fns.where(F.size("token_seq") > 0).select("fn_id", seq_key(F.col("token_seq")).alias("k"))
    d = d.select(F.min("fn_id").over(w).alias("cluster_id"), "fn_id", (F.row_number().over(w.orderBy("fn_id")) - 1).alias("member_pos"), F.count("*").over(w).alias("n"))
    return d.where(F.col("n") >= least).drop("n")


def cluster_all(fns: DataFrame, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """Everything from function rows to clusters: index, pairs, edges, members, dropped groups and orphans, by name."""
    able = blocking.eligible(fns, cfg)
    index = blocking.postings(able)
    scored = blocking.compared(blocking.candidates(able, cfg), able, cfg)
    e = blocking.edges(scored, cfg)
    grouped = cut(link_groups(e, fns, cfg))
    members = cut(kept(grouped, fns, fns.agg(F.count("*").alias("n")), cfg))
    below = blocking.scored_below(scored, cfg)
    if cfg.compat:
        below = below.union(blocking.self_scored_below(index, able, cfg)).distinct()
    return {"postings": index, "scored": scored, "edges": e, "groups": grouped, "members": members, "orphans": orphans(below, grouped, fns)}
