"""Exact quantiles (linear interpolation) without gathering a group.

Spark's exact ``percentile`` keeps a map of every distinct value of a group
and merges it in one task; at scale a hot group or a continuous column
breaks that.  Here a sketch guesses and a count proves:

1. one pass builds a KLL sketch per group (a few kilobytes, merged from partial
   ones), with n, min and max.  For each order statistic needed (ranks
   ``floor((n-1)p)`` and ``ceil((n-1)p)``) the sketch gives a bracket of two values
   that holds it, but for rare bad luck;
2. one pass counts the group's values below, at, inside and at the upper end
   of each bracket.  The counts say where the rank lies.  At an end, the value is
   found (columns of few values finish here); outside, the bracket was wrong and
   the part it left out is searched instead;
3. the values inside a bracket, about 1.5 % of the group, are counted by value and
   ranked by a running sum, where they are at most ``final_rows``; larger parts are
   written and searched by the same steps.  Each round is smaller by a factor of some
   sixty, so the sum of all passes stays near two.

Every size takes this path.  The input is written once, pruned to group keys
and value, and the passes scan that copy.

The quantile between two order statistics is ``lo + (hi - lo) * frac``, and
``lo`` where the rank is whole.  Between two equal infinities that is NaN, as
in pandas, and so between both; between a finite value and an infinity it is
the infinity.

Every task sees bounded state whatever the skew: a sketch per group, and at most
``final_rows`` values of a bracket.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.predicates import drop_null_key
from vitrine.session import reliable_checkpoint

#: Steps of the grid of ranks that is read off a sketch.
GRID = 400


_RANKS = ", ".join(f"{i / GRID}D" for i in range(GRID + 1))


def _sketches(data: DataFrame, keys: list[str], sketch_k: int) -> DataFrame:
    """Per group: n, least and greatest value, and the sketch's values at a grid of ranks."""
    sketched = data.groupBy(*keys).agg(F.expr("count(1) AS _n"), F.expr("min(_v) AS _min"), F.expr("max(_v) AS _max"),
                                       F.expr(f"kll_sketch_agg_double(_v, {sketch_k}) AS _sketch"))
    return sketched.selectExpr(*keys, "_n", "_min", "_max",
                               f"kll_sketch_get_quantile_double(_sketch, array({_RANKS})) AS _grid")


def _ends(pairs: int, sketch_k: int) -> list[str]:
    """Columns ``_lo``, ``_hi`` of each pair of ranks in ``_ks``: the bracket they share.

    It reaches beyond the sketch's rank by several times the error that such a sketch exceeds in
    one case of a hundred (0.75 % of the group against 0.2 % for 1600).
    """
    reach = min(12.0 / sketch_k, 0.1)  # a small sketch errs more, but must still narrow
    return [e for t in range(pairs) for e in (
        f"_grid[CAST(greatest(floor((_ks[{2 * t}] / _n - {reach}D) * {GRID}), 0) AS INT)] AS _lo{t}",
        f"_grid[CAST(least(ceil(((_ks[{2 * t + 1}] + 1) / _n + {reach}D) * {GRID}), {GRID}) AS INT)] AS _hi{t}")]


_COUNTS = (("< _lo", "_below"), ("<= _lo", "_upto"), ("< _hi", "_before"), ("<= _hi", "_all"))


def _order_statistics(data: DataFrame, keys: list[str], ranked: DataFrame, pairs: int,
                      final_rows: int, sketch_k: int) -> DataFrame:
    """Values of given ranks: keys, ``_t``, ``_val``.

    ``data``: keys, ``_v``.  ``ranked``: a written row per group with ``_n``, ``_ks`` (``pairs`` times
    two neighbouring or equal 0-based ranks) and their :func:`_ends`.  ``_t`` is the place in ``_ks``.
    """
    brackets = ranked.select(*keys, "_n", "_ks", *[f"{e}{t}" for t in range(pairs) for e in ("_lo", "_hi")])
    counts = [F.expr(f"count_if(_v {op}{t}) AS {name}{t}") for t in range(pairs) for op, name in _COUNTS]
    counted = data.join(brackets.drop("_n", "_ks"), keys).groupBy(*keys).agg(*counts).join(brackets, keys)
    each = ", ".join(
        f"named_struct('_t', {u}, '_k', _ks[{u}], '_lo', _lo{u // 2}, '_hi', _hi{u // 2}, '_below', _below{u // 2}, "
        f"'_upto', _upto{u // 2}, '_before', greatest(_before{u // 2}, _upto{u // 2}), '_upper', _all{u // 2})"
        for u in range(2 * pairs))
    # The part of the group that holds the rank, both ends left out, and the rank in it.
    found = counted.selectExpr(*keys, "_n", f"inline(array({each}))").selectExpr(
        *keys, "_t",
        "CASE WHEN _k >= _below AND _k < _upto THEN _lo WHEN _k >= _before AND _k < _upper THEN _hi END AS _val",
        "CASE WHEN _k < _below THEN NULL WHEN _k >= _upper THEN _hi ELSE _lo END AS _from",
        "CASE WHEN _k < _below THEN _lo WHEN _k >= _upper THEN NULL ELSE _hi END AS _to",
        "_k - CASE WHEN _k < _below THEN 0 WHEN _k >= _upper THEN _upper ELSE _upto END AS _r",
        "CASE WHEN _k < _below THEN _below WHEN _k >= _upper THEN _n - _upper ELSE _before - _upto END AS _size")
    found = reliable_checkpoint(found, "order-statistics")
    small, large = f"_val IS NULL AND _size <= {final_rows}", f"_val IS NULL AND _size > {final_rows}"
    n_small, n_large = found.agg(F.expr(f"count_if({small})"), F.expr(f"count_if({large})")).first()

    def part(which: str) -> DataFrame:
        """The values of those parts, by group and place of the rank."""
        return data.join(found.where(which).select(*keys, "_t", "_from", "_to", "_r"), keys).where(
            "(_from IS NULL OR _v > _from) AND (_to IS NULL OR _v < _to)")

    out = found.where("_val IS NOT NULL").select(*keys, "_t", "_val")
    if n_small:
        upto = (Window.partitionBy(*keys, "_t").orderBy("_v")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        values = part(small).groupBy(*keys, "_t", "_r", "_v").agg(F.expr("count(1) AS _c"))
        values = values.withColumn("_upto", F.sum("_c").over(upto))
        out = out.unionByName(values.where("_r < _upto AND _r >= _upto - _c").select(*keys, "_t", F.col("_v").alias("_val")))
    if n_large:
        sub = [*keys, "_t"]
        again = reliable_checkpoint(part(large).select(*sub, "_v"), "quantile-part")
        deeper = _sketches(again, sub, sketch_k).join(
            found.where(large).select(*sub, F.array("_r", "_r").alias("_ks")), sub)
        deeper = deeper.selectExpr(*sub, "_n", "_ks", *_ends(1, sketch_k))
        up = f"_t{len(keys)}"
        deeper = _order_statistics(again.withColumnRenamed("_t", up), [*keys, up],
                                   reliable_checkpoint(deeper.withColumnRenamed("_t", up), "sketches"),
                                   1, final_rows, sketch_k).where("_t = 0")
        out = out.unionByName(deeper.select(*keys, F.col(up).alias("_t"), "_val"))
    return out


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
                    final_rows: int = 100_000, written: bool = False, sketch_k: int = 1600) -> DataFrame:
    """Per group, the linear-interpolated quantiles of ``value`` at ``probs``.

    ``value`` is a numeric column (NULL and NaN skipped); rows with a NULL
    group key are dropped.  Output: [by...], ``n``, ``min``, ``max``,
    ``q0``..``q{k-1}`` in the order of ``probs``.  Groups without values are
    absent.  ``final_rows`` bounds the values ranked together, ``sketch_k`` is the size of
    the sketches; neither changes the result.  ``written``: ``df`` already is a written table of just the keys
    and the value.
    """
    keys = list(by or [])
    v = F.col(value).cast("double")
    gk = keys or ["_one"]
    data = df if keys else df.withColumn("_one", F.lit(0))
    data = drop_null_key(data.select(*gk, v.alias("_v")), *keys)
    data = data.where(F.col("_v").isNotNull() & ~F.isnan(F.col("_v")))
    if not written:
        data = reliable_checkpoint(data, "quantile-input")

    # For each probability the ranks floor((n-1)p) and ceil((n-1)p).
    ks = ", ".join(f"CAST({f}((_n - 1) * {float(p)}D) AS BIGINT)" for p in probs for f in ("floor", "ceil"))
    sketched = _sketches(data, gk, sketch_k)
    sketched = sketched.selectExpr("*", f"array({ks}) AS _ks").selectExpr("*", *_ends(len(probs), sketch_k))
    ranked = reliable_checkpoint(sketched.drop("_grid"), "sketches")
    found = _order_statistics(data, gk, ranked, len(probs), final_rows, sketch_k)
    # In one aggregation the two order statistics of each probability.
    per = found.groupBy(*gk).agg(*[F.expr(f"max(CASE WHEN _t = {t} THEN _val END) AS _x{t}")
                                   for t in range(2 * len(probs))])
    inf = "CAST('infinity' AS DOUBLE)"
    qs = []
    for i, p in enumerate(probs):
        lo, hi = f"_x{2 * i}", f"_x{2 * i + 1}"
        frac = f"((_n - 1) * {float(p)}D - floor((_n - 1) * {float(p)}D))"
        qs.append(f"CASE WHEN {frac} = 0 OR ({lo} = -{inf} AND abs({hi}) <> {inf}) THEN {lo} "
                  f"ELSE {lo} + ({hi} - {lo}) * {frac} END AS q{i}")
    return ranked.join(per, on=gk, how="inner").selectExpr(
        *keys, "_n AS n", "_min AS min", "_max AS max", *qs)


def column_quantiles(data: DataFrame, columns: list[str], probs: list[float], more: list[str] | None = None,
                     final_rows: int = 100_000, sketch_k: int = 1600) -> list[dict]:
    """The quantiles of whole columns (doubles without NaN; NULLs skipped), by the steps of :func:`exact_quantiles`.

    Without groups there is one sketch a column, so brackets go into the plan as numbers and every
    pass is one aggregation over all columns, without a join.  Per column a dict: n, min, max, q (a value per
    probability; None for a column without values) and the aggregates ``more``, SQL with ``{c}`` for the column.  The driver holds a
    grid a column.
    """
    more = more or []
    name = [f"`{c}`" for c in columns]
    first = data.agg(*[F.expr(x) for i, c in enumerate(name) for x in (
        f"count({c}) AS n{i}", f"min({c}) AS min{i}", f"max({c}) AS max{i}",
        *[f"{m.format(c=c)} AS more{i}_{j}" for j, m in enumerate(more)])]).first()
    grids = data.agg(*[F.expr(f"kll_sketch_agg_double({c}, {sketch_k}) AS s{i}") for i, c in enumerate(name) if first[f"n{i}"]] or [F.lit(0)])
    grids = grids.selectExpr("0 AS _", *[f"kll_sketch_get_quantile_double(s{i}, array({_RANKS})) AS grid{i}"
                                         for i in range(len(name)) if first[f"n{i}"]]).first()
    reach = min(12.0 / sketch_k, 0.1)  # a small sketch errs more, but must still narrow
    out, want = [], []
    for i in range(len(columns)):
        n = first[f"n{i}"]
        out.append({"n": n, "min": first[f"min{i}"], "max": first[f"max{i}"], "q": None,
                    "more": [first[f"more{i}_{j}"] for j in range(len(more))]})
        grid = grids[f"grid{i}"] if n else None
        for t, p in enumerate(probs if n else []):
            ks = [math.floor((n - 1) * p), math.ceil((n - 1) * p)]
            lo = grid[int(max(math.floor((ks[0] / n - reach) * GRID), 0))]
            hi = grid[int(min(math.ceil(((ks[1] + 1) / n + reach) * GRID), GRID))]
            want.append((i, t, ks, lo, hi))
    if not want:
        return out
    counts = data.agg(*[F.expr(f"count_if({name[i]} {op[:-3]}{_number(x)}) AS {what}_{w}")
                        for w, (i, _, _, lo, hi) in enumerate(want) for op, what in _COUNTS
                        for x in [lo if op.endswith("_lo") else hi]]).first()
    value: dict[tuple, float] = {}
    parts: dict[tuple, tuple[int, list]] = {}  # (column, from, to) -> values there, ranks wanted
    for w, (i, t, ks, lo, hi) in enumerate(want):
        below, upto, before, upper = (counts[f"{what}_{w}"] for _, what in _COUNTS)
        before = max(before, upto)
        for u, k in enumerate(ks):
            if below <= k < upto:
                value[i, t, u] = lo
            elif before <= k < upper:
                value[i, t, u] = hi
            elif k < below:
                parts.setdefault((i, None, lo), (below, []))[1].append((k, (i, t, u)))
            elif k >= upper:
                parts.setdefault((i, hi, None), (out[i]["n"] - upper, []))[1].append((k - upper, (i, t, u)))
            else:
                parts.setdefault((i, lo, hi), (before - upto, []))[1].append((k - upto, (i, t, u)))
    number = {part: k for k, part in enumerate(parts)}

    def cut(some: list[tuple]) -> DataFrame:
        """(_p, _v): the values of those parts; of each column those within its parts alone are read on."""
        frames = []
        for i in sorted({i for i, _, _ in some}):
            test = {number[p]: " AND ".join([f"_v > {_number(p[1])}"] * (p[1] is not None) + [f"_v < {_number(p[2])}"] * (p[2] is not None))
                    for p in some if p[0] == i}
            rows = data.selectExpr(f"{name[i]} AS _v").where(" OR ".join(f"({x})" for x in test.values()))
            of = ", ".join(f"CASE WHEN {x} THEN {k} END" for k, x in test.items())
            frames.append(rows.selectExpr(f"explode(filter(array({of}), p -> p IS NOT NULL)) AS _p", "_v"))
        return reduce(DataFrame.unionByName, frames)

    small = [p for p, (size, _) in parts.items() if size <= final_rows]
    if small:
        upto = Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = cut(small).groupBy("_p", "_v").agg(F.expr("count(1) AS _c")).withColumn("_upto", F.sum("_c").over(upto))
        hit = " OR ".join(f"(_p = {number[p]} AND _upto > {k} AND _upto - _c <= {k})" for p in small for k, _ in parts[p][1])
        for r in ranked.where(hit).collect():
            for p in small:
                for k, at in parts[p][1]:
                    if number[p] == r["_p"] and r["_upto"] - r["_c"] <= k < r["_upto"]:
                        value[at] = r["_v"]
    large = [p for p, (size, _) in parts.items() if size > final_rows]
    if large:
        again = reliable_checkpoint(cut(large), "quantile-part")
        # Every part with as many pairs of ranks; the last one stands in for those it lacks.
        pairs = max(len(parts[p][1]) for p in large)
        wanted = [(number[p], [k for j in range(pairs) for k in [parts[p][1][min(j, len(parts[p][1]) - 1)][0]] * 2]) for p in large]
        wanted = data.sparkSession.createDataFrame(wanted, "_p int, _ks array<long>")
        deeper = _sketches(again, ["_p"], sketch_k).join(wanted, "_p").selectExpr("_p", "_n", "_ks", *_ends(pairs, sketch_k))
        by_number = {number[p]: parts[p][1] for p in large}
        for r in _order_statistics(again, ["_p"], reliable_checkpoint(deeper, "sketches"), pairs, final_rows, sketch_k).collect():
            if r["_t"] // 2 < len(by_number[r["_p"]]):
                value[by_number[r["_p"]][r["_t"] // 2][1]] = r["_val"]
    for i, o in enumerate(out):
        if o["n"]:
            o["q"] = [_between(value[i, t, 0], value[i, t, 1], (o["n"] - 1) * p) for t, p in enumerate(probs)]
    return out


def _number(x: float) -> str:
    """A double as SQL."""
    return f"{x!r}D" if math.isfinite(x) else f"CAST('{x}' AS DOUBLE)"


def _between(lo: float, hi: float, position: float) -> float:
    frac = position - math.floor(position)
    if frac == 0 or (lo == -math.inf and not math.isinf(hi)):
        return lo
    return lo + (hi - lo) * frac
