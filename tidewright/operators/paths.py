"""Cheapest paths, floods and forests over edges that stay distributed. Rounds are joins and aggregates; nothing but a bound of costs
comes to the driver."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.angles import col
from tidewright.operators.graphs import back_trace, checkpointed, stored

#: Metres in a degree of latitude.
DEGREE_M = 6_371_000.0 * math.pi / 180
#: Cells within which a coast makes a way dearer, and by how much beside it.
COAST, DEARER = 4, 0.4
#: Edges of a chart up to which one group has them all, and searches that are dealt together.
EDGES, SEARCHES = 2_000_000, 8


def cheapest_paths(sources: DataFrame, edges: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """search, id, cost, parent: the least cost at which each search reaches an id, and the id before it, the least of several that
    cost the same; null at a source. All searches run side by side.

    sources: search, id, cost (what it costs to begin there). edges: a, b, cost, one way each; costs are positive, rows with a null or
    from a node to itself are no edges. goals (search, id): a search ends soon after it has reached all of its goals, so that
    other nodes may be missing; without them it runs to the end.

    A round settles every label that nothing can better, whichever search it is of: one no dearer than the least cost plus least way out
    among the open labels, or than their least cost plus its own least way in. Only what is settled in a round goes through the edges,
    once, and a node that is settled is not opened again."""
    kind = edges.schema["cost"].dataType
    moves = edges.where("a is not null and b is not null and a <> b and cost is not null").groupBy("a", "b").agg(F.min("cost").alias("cost"))
    ways_out = moves.groupBy(F.col("a").alias("id")).agg(F.min("cost").alias("out"))
    ways_in = moves.groupBy(F.col("b").alias("id")).agg(F.min("cost").alias("into"))
    ends = ways_out.join(ways_in, "id", "full")
    # laid out by their first node once, so that no round shuffles the edges
    slots = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moves = checkpointed(moves.join(ends.withColumnRenamed("id", "b"), "b").repartition(slots, "a").sortWithinPartitions("a"))
    if not moves.where(~(F.col("cost") > 0)).isEmpty():
        raise ValueError("an edge has a cost that is not positive")
    begun = stored(sources.where("id is not null and cost is not null").groupBy("search", "id").agg(F.min(F.col("cost").cast(kind)).alias("cost")))
    open_ = stored(begun.join(ends, "id", "left").select("search", "id", "cost", "out", "into"))
    ordered = lambda df: checkpointed(df.repartition(slots, "search", "id").sortWithinPartitions("search", "id"))
    settled = recent = open_.select("search", "id", "cost").where("false")
    for n in count(1):
        low, near = open_.agg(F.min("cost"), F.min(F.col("cost") + F.col("out"))).first()
        if low is None:
            break
        final = F.col("into").isNull() | (F.col("cost") <= F.lit(low) + F.col("into"))
        final = F.lit(True) if near is None else final | (F.col("cost") <= F.lit(near))
        ready = open_.where(final).select("search", "id", "cost")
        recent = recent.unionByName(ready)
        if n % 8 == 0:  # what is settled is laid out anew each time it may have doubled, and lies as the offers do
            recent = stored(recent)
            if n & (n - 1) == 0:
                settled, recent = ordered(settled.unionByName(recent)), recent.where("false")
        ahead = ready.withColumnsRenamed({"id": "a", "cost": "_so_far"}).join(moves, "a")
        offers = ahead.select("search", F.col("b").alias("id"), (F.col("_so_far") + F.col("cost")).cast(kind).alias("cost"), "out", "into")
        left = open_.where(~final).unionByName(offers).groupBy("search", "id").agg(F.min("cost").alias("cost"), F.first("out").alias("out"), F.first("into").alias("into"))
        for known in (settled, recent):
            left = left.join(known.select("search", "id"), ["search", "id"], "left_anti")
        if goals is not None and n % 4 == 0:
            wanted = goals
            for known in (settled, recent):
                wanted = wanted.join(known, ["search", "id"], "left_anti")
            left = left.join(wanted.select("search").distinct(), "search", "left_semi")
        open_ = stored(left)
    settled = settled.unionByName(recent)
    return _with_parents(stored(settled), begun, moves)


def _with_parents(settled: DataFrame, begun: DataFrame, moves: DataFrame) -> DataFrame:
    """settled (search, id, cost: the least) with `parent`, as cheapest_paths() has it."""
    kind = settled.schema["cost"].dataType
    reached = settled.withColumnsRenamed({"id": "a", "cost": "_so_far"}).join(moves.select("a", "b", "cost"), "a")
    reached = reached.select("search", F.col("b").alias("id"), (F.col("_so_far") + F.col("cost")).cast(kind).alias("cost"), "a")
    parents = reached.join(settled, ["search", "id", "cost"]).groupBy("search", "id").agg(F.min("a").alias("parent"))
    starts = begun.withColumnRenamed("cost", "_own")
    found = settled.join(parents, ["search", "id"], "left").join(starts, ["search", "id"], "left")
    return found.select("search", "id", "cost", F.when(F.col("_own").isNull() | (F.col("_own") > F.col("cost")), F.col("parent")).alias("parent"))


def traced(labels: DataFrame, goals: DataFrame) -> DataFrame:
    """search, goal, seq, id, cost: the ids on the way to each goal (search, id) that was reached, from its source, which is seq 0. labels:
    what cheapest_paths() gives."""
    node = lambda c: F.struct(F.col("search").alias("search"), F.col(c).alias("id"))
    steps = labels.select(node("id").alias("id"), F.when(F.col("parent").isNotNull(), node("parent")).alias("parent"))
    ends = goals.select("search", "id").distinct().join(labels.select("search", "id"), ["search", "id"], "left_semi").select(node("id").alias("id"))
    back = back_trace(steps, ends)
    last = F.max("seq").over(Window.partitionBy("path"))
    found = back.select(F.col("path.search").alias("search"), F.col("path.id").alias("goal"), (last - F.col("seq")).alias("seq"), F.col("id.id").alias("id"))
    return found.join(labels.select("search", "id", "cost"), ["search", "id"]).select("search", "goal", "seq", "id", "cost")


def _spreading(out: pa.Schema) -> Callable:
    """For a group of edges of one chart and labels of its places: the labels that get better by these edges and those that are open."""

    def spread(legs: pa.Table, labels: pa.Table) -> pa.Table:
        is_open = labels["open"].to_numpy()
        if not is_open.any():
            return out.empty_table()
        m, kind = legs.num_rows, labels.schema.field("place").type
        places = pa.chunked_array([*legs["a"].chunks, *legs["b"].chunks, *labels["place"].chunks], kind).combine_chunks().dictionary_encode()
        code, names = places.indices.to_numpy(), places.dictionary
        order = np.argsort(code[:m], kind="stable")
        begin = np.searchsorted(code[:m][order], np.arange(len(names) + 1))
        b, w, at = code[m : 2 * m][order], legs["cost"].to_numpy()[order], code[2 * m :]
        searches = labels["search"].combine_chunks().dictionary_encode()
        own, cost = searches.indices.to_numpy(), labels["cost"].to_numpy()
        by_search = np.argsort(own, kind="stable")
        found = []
        for rows in np.split(by_search, np.flatnonzero(np.diff(own[by_search])) + 1):
            best = np.full(len(names), np.iinfo(np.int64).max)
            had, new = rows[~is_open[rows]], rows[is_open[rows]]
            np.minimum.at(best, at[had], cost[had])
            before, to, so_far = best.copy(), at[new], cost[new]
            while (better := so_far < best[to]).any():
                to, so_far = to[better], so_far[better]
                np.minimum.at(best, to, so_far)
                front = np.unique(to)
                n = begin[front + 1] - begin[front]
                edge = np.repeat(begin[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
                to, so_far = b[edge], np.repeat(best[front], n) + w[edge]
            got = np.flatnonzero(best < before)
            found.append((np.full(len(got), own[rows[0]]), got, best[got]))
        search, got, best = (np.concatenate(x) for x in zip(*found, strict=True))
        first = pa.array(np.zeros(len(got), "int64"))
        same = {k: labels[k].take(first) for k in ("chart", "_n", "_at")}
        return pa.table({"search": searches.dictionary.take(pa.array(search)), "place": names.take(pa.array(got)), "cost": best} | same).select(out.names).cast(out)

    return spread


def _charted(sources: DataFrame, legs: DataFrame, able: DataFrame, goals: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Places (search, place, changes, cost) and stays on a chart (search, place, chart, changes, cost), each with its fewest changes and the
    least cost with these.

    First all that is reached without a change, then with one, and so on: a chart is searched by itself, from all places where it
    is newly used. A chart is a group, so that its ways take one round whatever their steps; one with more than EDGES edges is dealt into
    several by place, which tell each other what crosses until nothing does."""
    block = lambda place: F.pmod(F.xxhash64(place), F.col("_n")).cast("int")
    slices = max(1, math.ceil(sources.select("search").distinct().count() / SEARCHES))
    sizes = stored(legs.groupBy("chart").agg(F.ceil(F.count("*") / EDGES).cast("int").alias("_n")))
    split = not sizes.where("_n > 1").isEmpty()
    laid = stored(legs.join(sizes, "chart").withColumn("_at", block("a")).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))
    able = stored(able.join(sizes, "chart", "left").withColumn("_n", F.coalesce("_n", F.lit(1))))
    group, label = ["chart", "_at", "_slice"], ["search", "place", "chart", "_n"]
    told = lambda df, is_open: df.select(*label, "cost", block("place").alias("_at"), F.pmod(F.xxhash64("search"), F.lit(slices)).cast("int").alias("_slice"), F.lit(is_open).alias("open"))
    newest = places = stored(sources.select("search", "place").distinct().withColumns({"changes": F.lit(0).cast("long"), "cost": F.lit(0).cast("long")}))
    stays = newest.join(able, "place").select(*label, "changes", "cost").where("false")
    for k in count():
        open_ = stored(newest.join(able, "place").select(*label, "cost").join(stays.select("search", "place", "chart"), ["search", "place", "chart"], "left_anti"))
        if open_.isEmpty():
            return places, stays.drop("_n")
        like = open_.withColumn("_at", F.lit(0)).limit(0)
        spread = _spreading(like.toArrow().schema)
        level = None
        while True:
            # what was reached with fewer changes is not to be reached again
            had = told(stays.withColumn("cost", F.lit(-1).cast("long")), False)
            had = had if level is None else had.unionByName(told(level, False))
            fed = told(open_, True).unionByName(had)
            out = stored(laid.groupBy(*group).cogroup(fed.groupBy(*group)).applyInArrow(spread, like.schema))
            here = out.where(F.col("_at") == block("place")).select(*label, "cost")
            level = here if level is None else stored(level.unionByName(here).groupBy(*label).agg(F.min("cost").alias("cost")))
            if not split:
                break
            open_ = stored(out.where(F.col("_at") != block("place")).groupBy(*label).agg(F.min("cost").alias("cost")))
            if open_.isEmpty():
                break
        stays = stays.unionByName(level.withColumn("changes", F.lit(k).cast("long")))
        reached = level.groupBy("search", "place").agg(F.min("cost").alias("cost")).withColumn("changes", F.lit(k).cast("long"))
        newest = stored(reached.join(places.select("search", "place"), ["search", "place"], "left_anti").select("search", "place", "changes", "cost"))
        places = places.unionByName(newest)
        if goals is not None:
            wanted = goals.select("search", "place").join(places, ["search", "place"], "left_anti").select("search").distinct()
            newest = newest.join(wanted, "search", "left_semi")


def fewest_changes(sources: DataFrame, edges: DataFrame, usable: DataFrame, goals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The ways with fewest changes of chart, and of these the cheapest; of ties, the one whose node before is least (place, then chart).

    sources: search, place. edges: a, b, chart, cost (whole numbers), one way each. usable: place, chart; an edge counts where its chart can
    be used at both ends, and a chart is changed only at a place both charts can be used at. goals: search, place.
    Gives (search, place, changes, cost) and the labels of the search in the product of places and charts, for traced(): an id is a
    struct of place and charts, of one chart, or none where it is being changed.

    Charts meet at a node of the place that has none, so a place with n charts has 2n changes, not n squared. In the labels a change costs
    more than all edges together, so one number orders the ways."""
    whole = "decimal(38,0)"
    able = usable.where("place is not null and chart is not null").select("place", "chart").distinct()
    at = lambda place, *charts: F.struct(col(place).alias("place"), (F.array(*charts) if charts else F.filter(F.array("chart"), lambda _: F.lit(False))).alias("charts"))
    legs = edges.where("a <> b and cost is not null")
    for end in ("a", "b"):
        legs = legs.join(able.withColumnRenamed("place", end), [end, "chart"], "left_semi")
    kind = usable.schema["place"].dataType
    legs = stored(legs.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "chart", F.col("cost").cast("long").alias("cost")))
    total, least = legs.agg(F.sum(F.col("cost").cast(whole)), F.min("cost")).first()
    if least is not None and least <= 0:
        raise ValueError("an edge has a cost that is not positive")
    change = (total or 0) + 1
    places, stays = _charted(sources.select("search", F.col("place").cast(kind).alias("place")), legs, able, goals)
    # each stay on a chart costs 1 to begin and `change` to end; a place where a search begins is left out of charts from the start
    ends = F.lit(change + 1).cast(whole)
    chart = F.lit(None).cast(usable.schema["chart"].dataType)
    bare = lambda df: df.withColumn("chart", chart).select("search", at("place").alias("id"), "cost")
    begun = bare(sources.select("search", F.col("place").cast(kind).alias("place")).distinct().withColumn("cost", F.lit(0).cast(whole)))
    on = stays.select("search", at("place", "chart").alias("id"), (F.col("changes") * ends + F.col("cost") + 1).cast(whole).alias("cost"))
    off = bare(places.withColumn("cost", ((F.col("changes") + 1) * ends + F.col("cost")).cast(whole))).join(begun.select("search", "id"), ["search", "id"], "left_anti")
    arcs = legs.select(at("a", "chart").alias("a"), at("b", "chart").alias("b"), F.col("cost").cast(whole).alias("cost"))
    leave = able.select(at("place", "chart").alias("a"), at("place").alias("b"), F.lit(change).cast(whole).alias("cost"))
    enter = able.select(at("place").alias("a"), at("place", "chart").alias("b"), F.lit(1).cast(whole).alias("cost"))
    return places, _with_parents(on.unionByName(off).unionByName(begun), begun, arcs.unionByName(leave).unionByName(enter))


def cell_id(row: str = "row", column: str = "col") -> Column:
    """The number grids give a cell."""
    return F.col(row).cast("long") * 1048576 + F.col(column)


def coast_cells(water: DataFrame, around: int | None = None, most: int = COAST) -> DataFrame:
    """water (row, col) with `coast`: rows or columns to the nearest cell that is not water, most + 1 beyond `most`. What is not listed is
    not water. around: columns of a grid that runs around the globe."""
    cells = water.select("row", "col").distinct().withColumn("_own", F.lit(True))
    if around is not None:
        near = cells.where((F.col("col") < most) | (F.col("col") >= around - most))
        cells = cells.unionByName(near.select("row", F.when(F.col("col") < most, F.col("col") + around).otherwise(F.col("col") - around).alias("col"), F.lit(False).alias("_own")))
    coast = F.lit(most + 1)
    for k in range(most, 0, -1):
        along = Window.partitionBy("row").orderBy("col").rangeBetween(-k, k)
        down = Window.partitionBy("col").orderBy("row").rangeBetween(-k, k)
        cells = cells.withColumn("_n", F.count("*").over(along)).withColumn(f"_n{k}", F.sum("_n").over(down))
        coast = F.when(F.col(f"_n{k}") < (2 * k + 1) ** 2, F.lit(k)).otherwise(coast)
    return cells.withColumn("coast", coast).where("_own").select("row", "col", "coast")


def water_moves(water: DataFrame, south: float, res: float, unit: float = 0.1, around: int | None = None) -> DataFrame:
    """a, b, cost: moves between water cells (row, col) with corners to the four sides, and over a corner where both cells beside it are
    water. The cost, in whole units of `unit` metres, is the distance between centres by the mean latitude, dearer towards a coast."""
    cells = stored(coast_cells(water, around))
    steps = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc))
    out = cells.select("row", "col", F.explode(steps).alias("s")).select("row", "col", (F.col("row") + F.col("s.dr")).alias("to_row"), (F.col("col") + F.col("s.dc")).alias("to_col"), F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc"))
    wrapped = lambda c: F.pmod(F.col(c), F.lit(around)) if around else F.col(c)
    out = out.withColumn("to_col", wrapped("to_col"))
    met = out.join(cells.withColumnsRenamed({"row": "to_row", "col": "to_col"}), ["to_row", "to_col"])
    here = cells.select("row", "col")
    slant = F.col("dr") * F.col("dc") != 0
    beside = met.where(slant)
    for r, c in (("row", "to_col"), ("to_row", "col")):
        beside = beside.join(here.withColumnsRenamed({"row": r, "col": c}), [r, c], "left_semi")
    kept = met.where(~slant).unionByName(beside)
    cos = F.cos(F.radians(south + (F.col("row") + 0.5 + F.col("dr") / 2) * res))
    metres = F.sqrt(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc") * cos * cos) * (res * DEGREE_M)
    factor = F.when(F.col("coast") > COAST, 1.0).otherwise(1 + DEARER * (COAST + 1 - F.col("coast")) / COAST)
    return kept.select(cell_id().alias("a"), cell_id("to_row", "to_col").alias("b"), F.floor(metres * factor / unit + 0.5).cast("long").alias("cost"))


def highest_forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """low, high, a, b, w: the maximum spanning forest of edges (a, b, w), each edge with the two peaks it joins: of nodes (id, value) that are
    linked by wider edges, the highest on either side (of equal ones, the least id); `low` is the lower one, which no longer counts
    beyond. low and high are structs of value and id.

    In a round every part takes its widest way out, and joins what lies there if its peak is higher; a lower one joins by its own widest way
    or waits. A part's other ways are no wider than the one it joined by, so they lead to the higher peak as well as to its own."""
    peak = F.struct("value", (-F.col("id")).alias("_id"))
    known = nodes.where("id is not null and value is not null").select("id", peak.alias("peak"))
    links = edges.where("a <> b and w is not null").select("a", "b", "w")
    links = links.join(known.withColumnsRenamed({"id": "a", "peak": "pa"}), "a").join(known.withColumnsRenamed({"id": "b", "peak": "pb"}), "b")
    links = stored(links.select("pa", "pb", "w", "a", "b"))
    forest = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("pb").alias("pa"), F.col("pa").alias("pb"), "w", F.col("b").alias("a"), F.col("a").alias("b")))
        widest = both.groupBy("pa").agg(F.max(F.struct("w", "pb", "a", "b")).alias("m"))
        hooks = stored(widest.where(F.col("m.pb") > F.col("pa")).select(F.col("pa").alias("low"), F.col("m.pb").alias("high"), F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.w").alias("w")))
        forest = hooks if forest is None else forest.unionByName(hooks)
        roots = hooks.select("low", "high")
        while True:  # three doublings at a time: most chains of hooks are short
            for _ in range(3):
                roots = roots.join(roots.select(F.col("low").alias("high"), F.col("high").alias("_top")), "high", "left").select("low", F.coalesce("_top", "high").alias("high"))
            roots = stored(roots)
            if roots.join(hooks.select(F.col("low").alias("high")), "high", "left_semi").isEmpty():
                break
        for side in ("pa", "pb"):
            links = links.join(roots.select(F.col("low").alias(side), F.col("high").alias("_root")), side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
        pairs = links.where("pa <> pb").select(F.greatest("pa", "pb").alias("pa"), F.least("pa", "pb").alias("pb"), "w", F.when(F.col("pa") > F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("pa") > F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("b"))
        links = stored(pairs.groupBy("pa", "pb").agg(F.max(F.struct("w", "a", "b")).alias("m")).select("pa", "pb", "m.w", "m.a", "m.b"))
    if forest is None:
        forest = links.select(F.col("pa").alias("low"), F.col("pb").alias("high"), "a", "b", "w")
    named = lambda c: F.struct(F.col(f"{c}.value").alias("value"), (-F.col(f"{c}._id")).alias("id"))
    return forest.select(named("low").alias("low"), named("high").alias("high"), "a", "b", "w")


def chokepoints(cells: DataFrame, edges: DataFrame, most: float, ratio: float, more: float, basin: float) -> DataFrame:
    """cell, clear, basin, basin_clear, beyond: the narrowest cells between two basins of water. cells: id, clear; edges: a, b that are open.
    A passage is at most `most` clear, and the lesser basin at least `ratio` times that, `more` above it, and `basin`."""
    clear = cells.select("id", "clear")
    links = edges.select("a", "b").join(clear.withColumnsRenamed({"id": "a", "clear": "ca"}), "a").join(clear.withColumnsRenamed({"id": "b", "clear": "cb"}), "b")
    forest = highest_forest(clear.withColumnRenamed("clear", "value"), links.select("a", "b", F.least("ca", "cb").alias("w")))
    lesser = F.col("low.value")
    found = forest.where((F.col("w") <= most) & (lesser >= ratio * F.col("w")) & (lesser >= F.col("w") + more) & (lesser >= basin))
    ends = found.join(clear.withColumnsRenamed({"id": "a", "clear": "ca"}), "a").join(clear.withColumnsRenamed({"id": "b", "clear": "cb"}), "b")
    at = F.when((F.col("ca") < F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("a") < F.col("b"))), F.col("a")).otherwise(F.col("b"))
    return ends.select(at.alias("cell"), F.col("w").alias("clear"), F.col("low.id").alias("basin"), lesser.alias("basin_clear"), F.col("high.id").alias("beyond"))
