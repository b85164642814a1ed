"""Operators on grids in long form: (row, col, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coarse(df: DataFrame, k: int, water: str) -> DataFrame:
    """k x k blocks: any_water, land_fraction, and whether water touches water over the east and north edge."""
    block = {"brow": F.floor(F.col("row") / k).cast("int"), "bcol": F.floor(F.col("col") / k).cast("int")}
    cells = df.select("row", "col", F.col(water).alias("w")).withColumns(block)
    own = cells.groupBy("brow", "bcol").agg(F.max("w").alias("any_water"), F.avg((~F.col("w")).cast("int")).alias("land_fraction"))

    def edge(dr: int, dc: int, name: str) -> DataFrame:
        at = (F.col("col") % k == k - 1) if dc else (F.col("row") % k == k - 1)
        here = cells.where(at & F.col("w")).select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), "brow", "bcol")
        return here.join(cells.where("w").select("row", "col"), ["row", "col"], "left_semi").select("brow", "bcol").distinct().withColumn(name, F.lit(True))

    out = own.join(edge(0, 1, "east"), ["brow", "bcol"], "left").join(edge(1, 0, "north"), ["brow", "bcol"], "left")
    return out.select("brow", "bcol", "any_water", "land_fraction", F.coalesce("east", F.lit(False)).alias("east"), F.coalesce("north", F.lit(False)).alias("north"))


def coarse_max(df: DataFrame, k: int, value: str) -> DataFrame:
    """Largest value of k x k blocks and the cell that has it, first by row and column."""
    best = F.min(F.struct((-F.col(value)).alias("_v"), "row", "col"))
    return df.groupBy(F.floor(F.col("row") / k).cast("int").alias("brow"), F.floor(F.col("col") / k).cast("int").alias("bcol")).agg(best.alias("_b")).select("brow", "bcol", (-F.col("_b._v")).alias("clear"), F.col("_b.row").alias("at_row"), F.col("_b.col").alias("at_col"))


def _frame(keys: str, order: str, k: int):
    return Window.partitionBy(keys).orderBy(order).rangeBetween(-k, k)


def window_max(df: DataFrame, value: str, k_rows: int, k_cols: int, out: str = "most") -> DataFrame:
    """Largest value within k_rows and k_cols of each cell: a frame along the columns, then one along the rows."""
    along = df.withColumn("_m", F.max(value).over(_frame("row", "col", k_cols)))
    return along.withColumn(out, F.max("_m").over(_frame("col", "row", k_rows))).drop("_m")


def dilate(df: DataFrame, flag: str, k_rows: int, k_cols: int) -> DataFrame:
    return window_max(df.withColumn("_f", F.col(flag).cast("int")), "_f", k_rows, k_cols, "_d").withColumn("dilated", F.col("_d") == 1).drop("_f", "_d")


def window_stats(df: DataFrame, value: str, k: int) -> DataFrame:
    """`low`, `high` and `mean` over the (2k + 1) square around each cell, as far as it is on the grid."""
    w = _frame("row", "col", k)
    part = df.withColumns({"_lo": F.min(value).over(w), "_hi": F.max(value).over(w), "_s": F.sum(value).over(w), "_n": F.count(value).over(w)})
    w = _frame("col", "row", k)
    return part.withColumns({"low": F.min("_lo").over(w), "high": F.max("_hi").over(w), "mean": F.sum("_s").over(w) / F.sum("_n").over(w)}).drop("_lo", "_hi", "_s", "_n")


def gaussian(df: DataFrame, value: str, rows: int, cols: int, sigma: float = 1.0, out: str = "blurred") -> DataFrame:
    """Separable Gaussian of a full grid, edges held. Each pass sends a cell's weighted value to the cells within 4 sigma and sums."""
    reach = int(4 * sigma + 0.5)
    kernel = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    kernel = [k / sum(kernel) for k in kernel]

    def blur(d: DataFrame, along: str, n: int) -> DataFrame:
        other = "col" if along == "row" else "row"
        # beyond the edge the edge's value counts: its cell also sends what the places outside would
        i = F.col(along)
        to = F.transform(F.sequence(F.greatest(F.lit(0), i - reach), F.least(F.lit(n - 1), i + reach)), lambda x: F.struct(x.alias("to"), _weight(x, i, n).alias("w")))
        return d.select(other, "_v", i.alias("_from"), F.inline(to)).groupBy(other, F.col("to").alias(along)).agg(F.sum(F.col("_v") * F.col("w")).alias("_v"))

    def _weight(to: Column, at: Column, n: int) -> Column:
        k = F.array(*map(F.lit, kernel))
        inside = F.element_at(k, (at - to + reach + 1).cast("int"))
        below = F.when(at == 0, F.aggregate(F.slice(k, F.lit(1), F.greatest(F.lit(0), F.lit(reach) - to)), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
        above = F.when(at == n - 1, F.aggregate(F.slice(F.reverse(k), F.lit(1), F.greatest(F.lit(0), F.lit(reach) - (n - 1 - to))), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
        return inside + below + above

    return blur(blur(df.select("row", "col", F.col(value).cast("double").alias("_v")), "col", cols), "row", rows).select("row", "col", F.col("_v").alias(out))


def contour_segments(df: DataFrame, value: str, level: float) -> DataFrame:
    """Marching squares: row, col, code of the four corners over the level, and the segments' ends as (x, y) in cells. The
    ambiguous codes 5 and 10 are told apart by the cell's mean."""
    w = Window.partitionBy("row").orderBy("col")
    pairs = df.select("row", "col", F.col(value).alias("a"), F.when(F.lead("col").over(w) == F.col("col") + 1, F.lead(value).over(w)).alias("b"))
    w = Window.partitionBy("col").orderBy("row")
    quads = pairs.withColumns({c: F.when(F.lead("row").over(w) == F.col("row") + 1, F.lead(o).over(w)) for c, o in (("d", "a"), ("c", "b"))}).where("a is not null and b is not null and c is not null and d is not null")
    code = sum(((F.col(k) >= level).cast("int") * n for k, n in (("a", 1), ("b", 2), ("c", 4), ("d", 8))), F.lit(0))
    cut = lambda p, q: (level - F.col(p)) / (F.col(q) - F.col(p))
    sides = {
        "s": F.struct((F.col("col") + cut("a", "b")).alias("x"), F.col("row").cast("double").alias("y")),
        "e": F.struct((F.col("col") + 1.0).alias("x"), (F.col("row") + cut("b", "c")).alias("y")),
        "n": F.struct((F.col("col") + cut("d", "c")).alias("x"), (F.col("row") + 1.0).alias("y")),
        "w": F.struct(F.col("col").cast("double").alias("x"), (F.col("row") + cut("a", "d")).alias("y")),
    }
    seg = lambda *p: F.array(*(F.struct(sides[x[0]].alias("p"), sides[x[1]].alias("q")) for x in p))
    mean_over = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 >= level
    c = F.col("code")
    lines = F.when(c.isin(1, 14), seg("ws")).when(c.isin(2, 13), seg("se")).when(c.isin(3, 12), seg("we")).when(c.isin(4, 11), seg("en")).when(c.isin(6, 9), seg("sn")).when(c.isin(7, 8), seg("wn"))
    lines = lines.when(((c == 5) & mean_over) | ((c == 10) & ~mean_over), seg("wn", "se")).when(c.isin(5, 10), seg("ws", "en"))
    return quads.withColumn("code", code).where("code > 0 and code < 15").select("row", "col", "code", F.explode(lines).alias("l")).select("row", "col", "code", F.col("l.p.x").alias("x0"), F.col("l.p.y").alias("y0"), F.col("l.q.x").alias("x1"), F.col("l.q.y").alias("y1"))


def contour_lines(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, xs, ys: segments (x0, y0, x1, y1) joined end to end; closed lines end where they begin. A group is one level's lines."""
    import pandas as pd

    kinds = ", ".join(f"{k} {segments.schema[k].dataType.simpleString()}" for k in keys)

    def join(part: pd.DataFrame) -> pd.DataFrame:
        ends: dict[tuple, list[int]] = {}
        legs = [((round(a, 9), round(b, 9)), (round(c, 9), round(d, 9))) for a, b, c, d in part[["x0", "y0", "x1", "y1"]].itertuples(index=False)]
        for i, leg in enumerate(legs):
            for p in leg:
                ends.setdefault(p, []).append(i)
        used, lines = set(), []
        odd = [i for p, at in ends.items() if len(at) == 1 for i in at]  # open lines first, from an end
        for first in [*odd, *range(len(legs))]:
            if first in used:
                continue
            a, b = legs[first]
            line = [b, a] if len(ends[b]) == 1 else [a, b]
            used.add(first)
            while (nxt := next((i for i in ends[line[-1]] if i not in used), None)) is not None:
                used.add(nxt)
                a, b = legs[nxt]
                line.append(b if a == line[-1] else a)
            lines.append(line)
        head = [part[k].iloc[0] for k in keys]
        return pd.DataFrame([[*head, n, [p[0] for p in line], [p[1] for p in line]] for n, line in enumerate(lines)], columns=[*keys, "line", "xs", "ys"])

    return segments.groupBy(*keys).applyInPandas(join, f"{kinds}, line int, xs array<double>, ys array<double>")


def pressure_extrema(df: DataFrame, value: str, rows: int, cols: int, near: int = 4, far: int = 9, least: float = 1.0) -> DataFrame:
    """Highs and lows: extreme in the (2 near + 1) square, and `least` away from the mean of the (2 far + 1) one; never on a border."""
    close, wide = window_stats(df, value, near), window_stats(df, value, far).select("row", "col", F.col("mean").alias("around"))
    met = close.join(wide, ["row", "col"]).where((F.col("row") > 0) & (F.col("row") < rows - 1) & (F.col("col") > 0) & (F.col("col") < cols - 1))
    v = F.col(value)
    kind = F.when((v >= F.col("high")) & (v - F.col("around") >= least), "high").when((v <= F.col("low")) & (F.col("around") - v >= least), "low")
    return met.select("row", "col", v.alias("v"), kind.alias("kind")).where("kind is not null")


def components(df: DataFrame, open_: str, most: int = 60) -> DataFrame:
    """row, col, component: the least row * 2^20 + col of the open cells connected by their sides. Rounds of least neighbour and
    pointer jumping, each written to the checkpoint folder, until nothing changes."""
    from tidewright.operators.graphs import connected

    cells = df.where(F.col(open_)).select((F.col("row").cast("long") * 1048576 + F.col("col")).alias("id"))
    steps = F.explode(F.array(F.lit(1).cast("long"), F.lit(1048576).cast("long")))
    edges = cells.withColumn("_step", steps).select("id", (F.col("id") + F.col("_step")).alias("to")).join(cells.select(F.col("id").alias("to")), "to", "left_semi").select(F.col("id").alias("a"), F.col("to").alias("b"))
    found = connected(cells.select("id"), edges, most)
    return found.select(F.shiftright("id", 20).cast("int").alias("row"), F.col("id").bitwiseAND(1048575).cast("int").alias("col"), "component")
