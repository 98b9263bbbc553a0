"""Reports over factors: strips of style, horizons, pools, costs, curves, exposures, sweeps, reviews and market breadth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cs
from ..functions.ts import SYM, T, line
from ..sources.shared import ensure_checkpoint_dir
from . import backtest as bt
from . import evaluation as ev


def strip_variants(rows: DataFrame, f: str, styles: list[str], industry: str, least: int = 200) -> DataFrame:
    """What is left of the factor's ranks: ``a`` without styles and industry means, ``b`` without styles, ``c`` without industry means."""
    ranked = rows.select(SYM, T, industry, cs.ordinal_rank(F.col(f)).alias("__f"), *[cs.ordinal_rank(F.col(s)).alias(s) for s in styles])
    left = ev.many_regressor_residual(ranked, "__f", styles, least).select(SYM, T, F.col("residual").alias("b"))
    out = ranked.select(SYM, T, industry, "__f").join(left, [SYM, T], "left")
    return out.select(SYM, T, cs.cs_demean(F.col("b"), industry).alias("a"), "b", cs.cs_demean(F.col("__f"), industry).alias("c"))


def restricted(rows: DataFrame, member: Column, f: str = "f") -> DataFrame:
    """The factor inside a pool only: others become missing, members are ranked among themselves."""
    inside = rows.withColumn(f, F.when(F.coalesce(member, F.lit(False)), F.col(f)))
    return inside.withColumn(f, cs.cs_rank(F.col(f)))


def net_of_cost(shape: DataFrame, stab: DataFrame, cost: float, step: int = 5, year: int = 252) -> DataFrame:
    """Yearly figures of a decile shape before and after costs.  Costs go by the turnover of the first bucket, and where that is unknown
    by 1 - ``stab``, the mean rank stability (one row, column ``stab``)."""
    times = year / step
    rows = shape.crossJoin(stab)
    turn = 1 - F.col("stab")
    fee, fee_top = 2 * cost * turn * times, 2 * cost * F.coalesce("turn_top", turn) * times
    net, net20 = F.col("d1") * times - fee, F.col("top20") * times - fee_top
    ratio = lambda x, sd: F.when(F.col(sd) > 0, F.try_divide(x, F.col(sd) * F.sqrt(F.lit(times))))
    return rows.select(
        "stab", turn.alias("turn_est"), "turn_top", "d1", "d10", "sd_top", (F.col("d1") * times).alias("top_ann"), ((F.col("d1") - F.col("d10")) * times).alias("spread_ann"), net.alias("net_ann"),
        ratio(net, "sd_top").alias("net_sharpe"), "top20", "sd_top20", (F.col("top20") * times).alias("top20_ann"), net20.alias("net20_ann"), ratio(net20, "sd_top20").alias("net20_sharpe"),
    )


def net_neutral(rows: DataFrame, styles: list[str], stab: DataFrame, cost: float, step: int = 5, year: int = 252, least: int = 100, least_in_bucket: int = 5) -> DataFrame:
    """What the factor's best bucket earns of the part of the return that ``styles`` don't explain: per period, yearly net of costs, its ratio to the
    deviation, and the absolute mean IC with that part.  Costs go by the turnover of the bucket itself, or by 1 - ``stab`` where it is unknown."""
    left = ev.neutralize_rows(ev.on_grid(rows, step), "r", styles, "__r", min(least, 50)).withColumn("r", F.col("__r"))
    shape = ev.decile_shape(left, step, least=least, least_in_bucket=least_in_bucket).select(F.col("d1").alias("d1_n"), F.col("sd_top").alias("sd_top_n"), "turn_top")
    ic = ev.batch_ic(left, ["f"], min(least, 50)).agg(F.max(F.abs("ic")).alias("ic_n"))
    times = year / step
    turn = F.coalesce("turn_top", 1 - F.col("stab"))
    net = F.col("d1_n") * times - 2 * cost * turn * times
    ratio = F.when(F.col("sd_top_n") > 0, F.try_divide(net, F.col("sd_top_n") * F.sqrt(F.lit(times))))
    return shape.crossJoin(stab).crossJoin(ic).select("d1_n", "sd_top_n", net.alias("net_n_ann"), ratio.alias("net_n_sharpe"), "ic_n")


def thinned(rows: DataFrame, keys: list[str], order: str, points: int) -> DataFrame:
    """Of each curve ``points`` rows at equal steps, its ends among them; shorter curves stay whole."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy(*keys))})
    # row i is kept if it is floor(j (n - 1) / (points - 1)) for some j: the smallest j that reaches i gives it
    last = F.greatest(F.col("__n") - 1, F.lit(1))
    j = F.ceil(F.col("__i") * (points - 1) / last)
    kept = (F.col("__n") <= points) | (F.floor(j * last / (points - 1)) == F.col("__i"))
    return rows.where(kept).drop("__i", "__n")


def long_short(rows: DataFrame, step: int = 5, least: int = 100, least_in_bucket: int = 5) -> DataFrame:
    """Net asset values of the top and the bottom bucket and of their difference."""
    per = ev.decile_periods(rows, step, least, least_in_bucket)
    per = per.groupBy(T).agg(
        F.max(F.when(F.col("d") == 1, F.col("ret"))).alias("top"), F.max(F.when(F.col("d") == 10, F.col("ret"))).alias("bottom"),
    ).where("top is not null and bottom is not null")
    order = Window.orderBy(T).rowsBetween(Window.unboundedPreceding, 0)
    nav = lambda c: F.exp(F.sum(F.log1p(c)).over(order))
    return per.select(
        T, nav(F.col("top")).alias("nav_top"), nav(F.col("bottom")).alias("nav_bottom"),
        nav((F.col("top") - F.col("bottom")) / 2).alias("nav_spread"),
    )


def decile_curves(rows: DataFrame, step: int = 5, least: int = 100, least_in_bucket: int = 5) -> DataFrame:
    """Per rebalancing date and decile the net asset value so far, and the date's plain (Pearson) IC."""
    per = ev.decile_periods(rows, step, least, least_in_bucket)
    nav = F.exp(F.sum(F.log1p("ret")).over(Window.partitionBy("d").orderBy(T).rowsBetween(Window.unboundedPreceding, 0)))
    pairs = ev.on_grid(rows, step).where("f is not null and r is not null")
    plain = pairs.groupBy(T).agg(F.when(F.count("*") >= least, ev._corr("f", "r")).alias("pearson"))
    return per.withColumn("nav", nav).join(plain, T, "left").select(T, "d", "nav", "pearson")


def style_years(rows: DataFrame, styles: list[str], least: int = 100, least_days: int = 10, least_years: int = 4) -> DataFrame:
    """The rank correlation with each style in blocks of years (those with ``least_days`` dates): t over the yearly means, and the share of
    years of the prevailing sign.  Blocks stand up to the slow change of such correlations."""
    ranked = rows.select(T, "date", cs.ordinal_rank(F.col("f")).alias("x"), *[cs.ordinal_rank(F.col(s)).alias(s) for s in styles])
    long = ranked.select(
        T, "date", "x", F.expr("stack({}, {}) as (style, y)".format(len(styles), ", ".join(f"'{s}', {s}" for s in styles))),
    )
    days = long.where("x is not null and y is not null").groupBy("style", T).agg(
        F.count("*").alias("n"), F.max("date").alias("date"), ev._corr("x", "y").alias("c"),
    ).where((F.col("n") >= least) & F.col("c").isNotNull())
    years = days.groupBy("style", bt._year().alias("year")).agg(
        F.count("*").alias("n"), F.avg("c").alias("c"),
    ).where(F.col("n") >= least_days)
    sd = F.stddev_pop("c")
    t = F.when((F.count("*") >= least_years) & (sd > 1e-12), F.try_divide(F.avg("c"), sd) * F.sqrt(F.count("*")))
    share = lambda test: F.avg(test.cast("int"))
    return years.groupBy("style").agg(
        F.count("*").alias("years"), t.alias("t_year"), F.greatest(share(F.col("c") > 0), share(F.col("c") < 0)).alias("win_year"),
    )


def first_of_runs(rows: DataFrame, keys: list[str], order: list[str], gap: int) -> DataFrame:
    """The rows that come first, or more than ``gap`` (of the first column in ``order``) after the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    since = F.col(order[0]) - F.lag(order[0]).over(w)
    return rows.withColumn("__gap", since).where(F.col("__gap").isNull() | (F.col("__gap") > gap)).drop("__gap")


def tail(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    return rows.withColumn(
        "__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())),
    ).where(F.col("__k") <= n).drop("__k")


def exposures(rows: DataFrame, styles: list[str], step: int = 5, share: float = 0.9) -> DataFrame:
    """Mean standardised style values of the top names at each rebalancing date."""
    grid = ev.on_grid(rows, step).select(SYM, T, cs.cs_rank(F.col("f")).alias("p"), *[cs.cs_zscore(F.col(s)).alias(s) for s in styles])
    return grid.where(F.col("p") > share).groupBy(T).agg(F.count("*").alias("n"), *[F.avg(s).alias(s) for s in styles])


def style_profile(rows: DataFrame, styles: list[str], least: int = 100) -> DataFrame:
    """Correlation of the factor's rank with each style per date, summarised: mean, absolute mean, ratio, t and AR(1)-adjusted t, wins."""
    ranked = rows.select(T, cs.ordinal_rank(F.col("f")).alias("x"), *[cs.ordinal_rank(F.col(s)).alias(s) for s in styles])
    long = ranked.select(T, "x", F.expr("stack({}, {}) as (style, y)".format(len(styles), ", ".join(f"'{s}', {s}" for s in styles))))
    days = long.where("x is not null and y is not null").groupBy("style", T).agg(
        F.count("*").alias("n"), ev._corr("x", "y").alias("c"),
    ).where(F.col("n") >= least)
    days = days.withColumn("p", F.lag("c").over(Window.partitionBy("style").orderBy(T)))
    c = F.when(F.col("p").isNotNull(), F.col("c"))
    den = F.sqrt(F.var_pop(c) * F.var_pop("p"))
    out = days.groupBy("style").agg(
        F.count("c").alias("n"), F.avg("c").alias("mean"), F.avg(F.abs("c")).alias("abs_mean"), F.stddev_samp("c").alias("sd"),
        F.avg((F.col("c") > 0).cast("int")).alias("win"), F.when(den > 1e-12, F.try_divide(F.covar_pop(c, F.col("p")), den)).alias("rho"),
    )
    ratio = F.when(F.col("sd") > 1e-12, F.try_divide("mean", "sd"))
    kept = F.when(F.abs("rho") < 0.999, F.col("n") * (1 - F.col("rho")) / (1 + F.col("rho")))
    return out.select(
        "style", "n", "mean", "abs_mean", ratio.alias("ir"), (ratio * F.sqrt("n")).alias("t_plain"), (ratio * F.sqrt(kept)).alias("t_ar1"),
        "win",
    )


def style_profiles(rows: DataFrame, styles: list[str], kinds: dict[str, list[str]], least: int = 100) -> DataFrame:
    """:func:`style_profile` of the factor and of what is left of its ranks without some styles, a kind each; all kinds come from one pass of sums."""
    ensure_checkpoint_dir(rows.sparkSession)
    ranked = rows.select(SYM, T, cs.ordinal_rank(F.col("f")).alias("__f"), *styles, *[cs.ordinal_rank(F.col(s)).alias(f"__{s}") for s in styles])
    left = ev.nested_residuals(ranked, "__f", {k: [f"__{s}" for s in held] for k, held in kinds.items()}, least).checkpoint()
    out = None
    for kind in kinds:
        made = style_profile(left.select(SYM, T, F.col(kind).alias("f"), *styles), styles, least).select(F.lit(kind).alias("kind"), "*")
        out = made if out is None else out.unionByName(made)
    return out


def sweep(traded: dict[int, DataFrame], costs: list[float], **least: int) -> DataFrame:
    """Metrics for every horizon (its own trades) and cost."""
    parts = []
    for step, rows in traded.items():
        per = bt.periods(rows, step=step, cost=0.0, **least)
        for cost in costs:
            at = per.withColumn("excess", F.col("top_ret") - F.col("turn") * cost - F.col("pool_ret"))
            parts.append(bt.metrics(at, step=step).select(F.lit(step).alias("horizon"), F.lit(cost).alias("cost"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def picks(rows: DataFrame, at: int, n: int, member: Column | None = None, limit: float = 0.1) -> DataFrame:
    """The n best names at a date that are in the pool and can be bought at the next row, with their size rank among such names and,
    for the tilt of the picks, the median of these ranks (0.5 is none)."""
    day = bt.with_tradability(rows, limit).withColumn("can", F.coalesce(F.lead("buyable", 1).over(line()), F.lit(False)))
    day = day.where((F.col(T) == at) & F.col("f").isNotNull() & F.col("can"))
    day = day.where(member) if member is not None else day
    day = day.withColumn("size_pct", cs.cs_rank(F.col("mktcap")))
    day = day.withColumn("place", F.row_number().over(cs.section().orderBy(F.col("f").desc(), F.col(SYM)))).where(F.col("place") <= n)
    return day.withColumn("tilt", F.percentile("size_pct", F.lit(0.5)).over(cs.section())).select(SYM, T, "place", "size_pct", "tilt")


def combo_check(rows: DataFrame, pools: dict[str, Column], limit: float = 0.1, k: int = 3, **how) -> DataFrame:
    """A factor in several pools, ranked inside each: its figures against the even and the weighted market, the size tilt, how many of ``k``
    segments are positive, and whether it decays (the last segment below 0.6 of the first)."""
    ensure_checkpoint_dir(rows.sparkSession)
    step, year, least_periods = how.get("step", bt.FWD), how.pop("year", bt.YEAR), how.pop("least_periods", 30)
    # pools differ in the factor alone, so trades are made once, and kept for the rebalancing dates
    traded = ev.on_grid(bt.trades(rows, step, limit).withColumns({f"__in{i}": m for i, m in enumerate(pools.values())}), step)
    traded = traded.select(SYM, T, "date", "f", "can", "ret", "cap", *[f"__in{i}" for i in range(len(pools))]).checkpoint()
    out = None
    for i, name in enumerate(pools):
        per = bt.periods(restricted(traded, F.col(f"__in{i}")), weight="cap", **how)
        part = bt.segments(per, k).agg(
            F.count(F.when(F.col("excess") > 0, 1)).alias("positive"),
            (
                F.max(F.when(F.col("segment") == k, F.col("excess"))) < 0.6 * F.max(F.when(F.col("segment") == 1, F.col("excess")))
            ).alias("decays"),
        )
        found = bt.figures_of(per, step, year, least_periods).select(
            F.lit(name).alias("pool"), "ann_ex", "ann_ex_cw", "tilt", "calmar", "calmar_cw", "sharpe", "dd", "turn",
        ).crossJoin(part)
        out = found if out is None else out.unionByName(found)
    return out


def crowding(rows: DataFrame, crowd: str, buckets: int = 5) -> DataFrame:
    """Forward market return by quantile of a crowding figure over dates."""
    days = rows.groupBy(T).agg(F.avg(crowd).alias("c"), F.avg("r").alias("m")).where("c is not null and m is not null")
    days = days.withColumn("bucket", F.ntile(buckets).over(Window.orderBy("c", T)))
    return days.groupBy("bucket").agg(F.count("*").alias("days"), F.avg("m").alias("ret"), F.avg((F.col("m") > 0).cast("int")).alias("win"))


def crowding_years(days: DataFrame, high: float = 0.95, low: float = 0.2) -> DataFrame:
    """By year: how many dates (t, date, crowd, ret) are crowded or empty by their percentile over all dates, the forward return after
    each, after all dates, and the spread; one row per date is ranked, so the window needs no key."""
    order = Window.orderBy("crowd")
    same = F.count(F.lit(1)).over(Window.partitionBy("crowd"))
    known = days.where(F.col("crowd").isNotNull())
    ranked = known.withColumn("pct", (F.rank().over(order) + (same - 1) / 2) / F.count(F.lit(1)).over(Window.partitionBy()))
    mean = lambda test: F.avg(F.when(test, F.col("ret")))
    hot, cold = F.col("pct") >= high, F.col("pct") <= low
    out = ranked.groupBy(bt._year().alias("year")).agg(
        F.count(F.when(hot, 1)).alias("n_high"), mean(hot).alias("ret_high"), F.count(F.when(cold, 1)).alias("n_low"),
        mean(cold).alias("ret_low"), F.avg("ret").alias("ret"),
    )
    return out.where("n_high + n_low > 0").withColumn("spread", F.col("ret_high") - F.col("ret_low"))


def breadth(panel: DataFrame, w: int = 20) -> DataFrame:
    """Share of names above their own mean, of rising names, and of names at their highest of ``w`` rows."""
    over = line().rowsBetween(-(w - 1), 0)
    rows = panel.select(
        T, (F.col("close") > F.avg("close").over(over)).cast("int").alias("above"),
        (F.col("close") > F.lag("close").over(line())).cast("int").alias("up"),
        (F.col("close") >= F.max("close").over(over)).cast("int").alias("high"),
    )
    return rows.groupBy(T).agg(
        F.count("above").alias("n"), F.avg("above").alias("above"), F.avg("up").alias("up"), F.avg("high").alias("high"),
    )


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reached): smallest neighbour labels are passed on until none changes.

    ``nodes`` (id) and ``links`` (a, b) are factors and their similarities, so the tables are short and few rounds are needed.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    state = nodes.select("id", F.col("id").alias("component"))
    before = None
    while True:
        near = both.join(state, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("m"))
        state = state.join(near, F.col("id") == F.col("a"), "left").select(
            "id", F.least("component", F.coalesce("m", F.col("component"))).alias("component"),
        ).checkpoint()
        now = state.agg(F.sum(F.xxhash64("component").cast("decimal(38,0)"))).head()[0]
        if now == before:
            return state
        before = now


def review(nodes: DataFrame, pairs: DataFrame, score: str, least: float = 0.7) -> DataFrame:
    """Factors that say the same (similarity >= ``least``, also through others) and the best one of each group."""
    linked = pairs.where(F.col("similarity") >= least).select("a", "b")
    found = components(nodes, linked)
    w = Window.partitionBy("component").orderBy(F.col(score).desc_nulls_last(), "id")
    return nodes.join(found, "id").withColumns(
        {"size": F.count("*").over(Window.partitionBy("component")), "keep": F.row_number().over(w) == 1}
    ).select("id", "component", "size", "keep")
