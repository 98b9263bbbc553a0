"""Portfolio simulation over rebalancing periods, and the metrics of the return streams it gives.

A period starts at a date d of the rebalancing grid: the top bucket by factor is bought at the next row's close where that can be
bought, and sold at the first row from d + 1 + F on where it can be sold.  All of it is windows along each symbol, and two
aggregations per period: one for the returns, and, among the periods that have enough names,
one for what stays from the period before.  Only the path of period returns is ordered; it has one row per rebalancing date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cs
from ..functions.ts import SYM, T, line
from ..sources.shared import ensure_checkpoint_dir
from .evaluation import FWD, YEAR, on_grid


def with_tradability(panel: DataFrame, limit: float = 0.1) -> DataFrame:
    """``buyable``: traded (a positive price, and a positive ``turnover`` where the panel has it) and did not close at the upper
    limit; ``next_sell``: the first row from this one on that can be sold (the last row of the panel where there is none;
    ``never_sold`` tells those), and ``next_price``, its close.  Limits are the columns ``limit_up`` and ``limit_down``, or ``limit`` around the last close."""
    pc = F.lag("close").over(line())
    given = {"limit_up", "limit_down"} <= set(panel.columns)
    high, low = (F.col("limit_up"), F.col("limit_down")) if given else (pc * (1 + limit), pc * (1 - limit))
    there = F.coalesce(F.col("close") > 0, F.lit(False))
    if "turnover" in panel.columns:
        there = there & F.coalesce(F.col("turnover") > 0, F.lit(False))
    up, down = F.coalesce(F.col("close") >= high - 1e-6, F.lit(False)), F.coalesce(F.col("close") <= low + 1e-6, F.lit(False))
    sellable = F.when(there & ~down, F.struct(F.col(T).alias("t"), F.col("close").alias("close")))
    # from the last row backwards the next row that can be sold is the last one met
    back = Window.partitionBy(SYM).orderBy(F.desc(T)).rowsBetween(Window.unboundedPreceding, 0)
    first = F.last(sellable, ignorenulls=True).over(back)
    panel = panel.withColumns({"buyable": there & ~up, "__next": first, "__end": F.first(F.struct(F.col(T).alias("t"), F.col("close").alias("close"))).over(back)})
    found = F.coalesce("__next", "__end")
    return panel.withColumns(
        {"next_sell": found["t"], "next_price": found["close"], "never_sold": F.col("__next").isNull()}
    ).drop("__next", "__end")


def trades(panel: DataFrame, step: int = FWD, limit: float = 0.1, delay: bool = True, ban: bool = True) -> DataFrame:
    """Per symbol and date: ``can`` (it can be bought at the next row), ``ret`` (return of that and of selling F rows later; NULL
    where it can't be bought) and, where the panel has market values, ``cap``, that of the buying row.

    ``delay`` waits for a row that can be sold, ``ban`` refuses what can't be bought; both off is the idealised trade.
    """
    frame = with_tradability(panel, limit)
    due = F.lead("next_sell", 1 + step).over(line()) if delay else F.when(F.lead(T, 1 + step).over(line()).isNotNull(), F.col(T) + 1 + step)
    can = F.coalesce(F.lead("buyable", 1).over(line()), F.lit(False)) if ban else F.lit(True)
    sold = F.lead("next_price" if delay else "close", 1 + step).over(line())
    frame = frame.withColumns({"buy": F.lead("close", 1).over(line()), "can": can & due.isNotNull(), "sell_at": due, "sold": sold}).drop("next_price")
    if "mktcap" in panel.columns:
        frame = frame.withColumn("cap", F.lead("mktcap", 1).over(line()))
    return frame.withColumn("ret", F.when(F.col("can") & (F.col("buy") > 0), F.try_divide("sold", "buy") - 1))


def chosen(rows: DataFrame, step: int = FWD, least: int = 100, by_pct: bool = False, share: float = 0.1) -> DataFrame:
    """Rows of the rebalancing dates with enough names, and which of them are ``top``: the last equal-count bucket, or with ``by_pct``
    all above the percentile, ties together."""
    pool = on_grid(rows, step).where("f is not null")
    pool = pool.withColumn("n", F.count("*").over(cs.section())).where(F.col("n") >= least)
    top = cs.cs_rank(F.col("f")) > 1 - share if by_pct else cs.bucket_qcut(F.col("f")) == 9
    return pool.withColumn("top", top)


def periods(
    rows: DataFrame, step: int = FWD, cost: float = 0.004, least: int = 100, least_top: int = 10, least_pool: int = 50, by_pct: bool = False,
    weight: str | None = None, cash: float = 1.0, actual: bool = False,
) -> DataFrame:
    """Per accepted period: returns of the top bucket and of the pool, turnover, and the excess net of costs.

    Rows are (sym, t, f, can, ret).  A period is accepted with ``least`` names, of which ``least_top`` of the top and ``least_pool``
    in all can be bought.  Turnover is 1 - overlap / size of the top set of the last accepted period (1 at first), of the names
    meant to be held, or with ``actual`` of those that could be bought.  ``cash`` is the share invested; ``weight`` adds the pool's
    return weighted by that column, and the excess over it.
    """
    return _of_pool(_kept(rows, step, least, by_pct, weight), cost, least_top, least_pool, weight, cash, actual)


def _kept(rows: DataFrame, step: int, least: int, by_pct: bool, weight: str | None) -> DataFrame:
    """The :func:`chosen` rows, which are a part of all, kept at once: what is made of them more than once doesn't make the panel again."""
    ensure_checkpoint_dir(rows.sparkSession)
    more = [c for c in dict.fromkeys(("date", weight)) if c in rows.columns]
    return chosen(rows.select(SYM, T, "f", "can", "ret", *more), step, least, by_pct).checkpoint()


def _of_pool(
    pool: DataFrame, cost: float = 0.004, least_top: int = 10, least_pool: int = 50, weight: str | None = None, cash: float = 1.0, actual: bool = False,
) -> DataFrame:
    held = F.col("top") & F.col("can") if actual else F.col("top")
    count = lambda c: F.count(F.when(c, F.lit(1)))
    aggs = [
        count(F.col("top")).alias("n_top"), count(held).alias("n_held"), count(F.col("top") & F.col("can")).alias("n_top_can"), count(F.col("can")).alias("n_can"),
        F.avg(F.when(F.col("top"), F.col("ret"))).alias("top_ret"), F.avg("ret").alias("pool_ret"),
    ]
    if weight:
        both = F.col(weight).isNotNull() & F.col("ret").isNotNull()
        total = F.sum(F.when(both, F.col(weight)))
        aggs.append(F.when(total > 0, F.try_divide(F.sum(F.when(both, F.col(weight) * F.col("ret"))), total)).alias("pool_ret_w"))
    if "date" in pool.columns:
        aggs.append(F.max("date").alias("date"))
    per = pool.groupBy(T).agg(*aggs)
    per = per.where(
        (F.col("n_top_can") >= least_top) & (F.col("n_can") >= least_pool) & F.col("top_ret").isNotNull() & F.col("pool_ret").isNotNull()
    )
    order = Window.orderBy(T)
    per = per.withColumns({"before": F.lag(T).over(order), "n_before": F.lag("n_held").over(order)})
    # what stays: the symbol's last row among accepted top sets is the period before
    names = pool.where(held).select(SYM, T).join(per.select(T, "before"), T)
    stays = F.lag(T).over(Window.partitionBy(SYM).orderBy(T)) == F.col("before")
    kept = names.withColumn("stays", F.coalesce(stays, F.lit(False)).cast("long")).groupBy(T).agg(F.sum("stays").alias("n_kept"))
    per = per.join(kept, T, "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    per = per.withColumn("turn", F.coalesce(1 - F.try_divide("n_kept", "n_before"), F.lit(1.0))).drop("before", "n_before")
    per = per.withColumns({"net": F.col("top_ret") * cash - F.col("turn") * cost, "market": F.col("pool_ret") * cash})
    per = per.withColumn("excess", F.col("net") - F.col("market"))
    return per.withColumns(
        {"market_w": F.col("pool_ret_w") * cash, "excess_w": F.col("net") - F.col("pool_ret_w") * cash}
    ) if weight else per


def _summary(frame: DataFrame, cols: list[str], order: list[str], scale: float, years: Column | None = None) -> DataFrame:
    """One row with ``{c}_ann, {c}_dd, {c}_mean, {c}_sd`` for each stream; all of them share one ordered pass.  A drawdown is measured
    from the highest value after any period so far."""
    over = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    frame = frame.withColumns({f"__v{c}": F.exp(F.sum(F.log1p(F.col(c))).over(over)) for c in cols})
    frame = frame.withColumns({f"__d{c}": F.col(f"__v{c}") / F.max(f"__v{c}").over(over) - 1 for c in cols})
    aggs = [
        x for c in cols for x in (
            F.exp(F.sum(F.log1p(F.col(c)))).alias(f"__e{c}"), F.min(f"__d{c}").alias(f"{c}_dd"), F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_sd"),
        )
    ]
    out = frame.agg(F.count("*").alias("periods"), *aggs, *([F.avg("turn").alias("turn")] if "turn" in frame.columns else []))
    span = years if years is not None else F.col("periods") * scale
    return out.withColumns(
        {f"{c}_ann": F.pow(f"__e{c}", F.try_divide(F.lit(1.0), span)) - 1 for c in cols}
    ).drop(*[f"__e{c}" for c in cols])


def _calmar(ann: str, dd: str) -> Column:
    return F.when(F.col(dd) < 0, F.try_divide(F.col(ann), F.abs(dd)))


def _sharpe(c: str, per_year: float) -> Column:
    return F.when(F.col(f"{c}_sd") > 1e-12, F.try_divide(f"{c}_mean", f"{c}_sd") * F.sqrt(F.lit(per_year)))


def metrics(per: DataFrame, col: str = "excess", step: int = FWD, year: int = YEAR, least_periods: int = 0) -> DataFrame:
    """Annual return, deepest drawdown, Calmar and Sharpe ratios and mean turnover of an ordered stream of period returns; no row with
    fewer than ``least_periods``."""
    out = _summary(per.where(F.col(col).isNotNull()), [col], [T], step / year).where(F.col("periods") >= least_periods)
    return out.select(
        "periods", F.col(f"{col}_ann").alias("ann_ex"), F.col(f"{col}_dd").alias("dd"), _calmar(f"{col}_ann", f"{col}_dd").alias("calmar"),
        _sharpe(col, year / step).alias("sharpe"), "turn",
    )


def path(per: DataFrame, col: str = "excess") -> DataFrame:
    """Net asset value and drawdown after each period."""
    order = Window.orderBy(T).rowsBetween(Window.unboundedPreceding, 0)
    frame = per.withColumn("nav", F.exp(F.sum(F.log1p(F.col(col))).over(order)))
    return frame.withColumn("drawdown", F.col("nav") / F.max("nav").over(order) - 1)


def _year() -> Column:
    return F.when(F.col("date") < 1_000_000, F.floor(F.col("date") / 100)).otherwise(F.floor(F.col("date") / 10_000)).cast("int")


def yearly(per: DataFrame, col: str = "excess") -> DataFrame:
    """Compounded excess per calendar year, from rows with ``date`` (YYYYMM or YYYYMMDD)."""
    return per.groupBy(_year().alias("year")).agg((F.exp(F.sum(F.log1p(F.col(col)))) - 1).alias("excess"), F.count("*").alias("periods"))


def segments(per: DataFrame, k: int = 3, col: str = "excess") -> DataFrame:
    """Compounded excess of k consecutive parts, the first ones one period longer where they don't divide evenly."""
    return per.withColumn("segment", F.ntile(k).over(Window.orderBy(T))).groupBy("segment").agg(
        (F.exp(F.sum(F.log1p(F.col(col)))) - 1).alias("excess"), F.count("*").alias("periods"),
    )


def daily_marks(panel: DataFrame, per: DataFrame, members: DataFrame, step: int = FWD, cost: float = 0.004, cash: float = 1.0) -> DataFrame:
    """Each period day by day: the excess (``mark``) and the portfolio itself (``own``), scaled so that their products are the period's
    own figures; ``raw`` is the unscaled excess.

    ``members`` are (t, sym, top, can); only what could be bought is marked.  Day j of a period is the return of row t + 1 + j on the
    row before; the costs fall on the first day.  The anchoring factor is the n-th root of what the period gives over what the days give.
    """
    ret = panel.select(SYM, F.col(T).alias("day"), (F.col("close") / F.lag("close").over(line()) - 1).alias("dret"))
    days_of = F.explode(F.transform(F.sequence(F.lit(2), F.lit(1 + step)), lambda j: F.col(T) + j)).alias("day")
    held = members.where("can").join(per.select(T), T).select(SYM, "top", T, days_of)
    days = held.join(ret, [SYM, "day"]).groupBy(T, "day").agg(
        F.avg(F.when(F.col("top"), F.col("dret"))).alias("mt"), F.avg("dret").alias("mm"),
    )
    days = days.where("mt is not null and mm is not null").join(per.select(T, "excess", "net", "turn"), T)
    paid = F.when(F.row_number().over(Window.partitionBy(T).orderBy("day")) == 1, F.col("turn") * cost).otherwise(0.0)
    days = days.withColumns({"raw": (F.col("mt") - F.col("mm")) * cash - paid, "raw_own": F.col("mt") * cash - paid})
    whole = Window.partitionBy(T)
    anchored = lambda raw, to: F.exp(F.log1p(raw) + (F.log1p(to) - F.sum(F.log1p(raw)).over(whole)) / F.count("*").over(whole)) - 1
    return days.withColumns(
        {"mark": anchored("raw", "excess"), "own": anchored("raw_own", "net")}
    ).select(T, "day", "raw", "mark", "own", "excess", "net")


def daily_figures(marks: DataFrame, year: int = YEAR) -> DataFrame:
    """Drawdown and Sharpe ratio of the daily excess and of the daily portfolio: ``dd_d, sharpe_d, dd_top_d, sharpe_top_d``."""
    out = _summary(marks.select(T, "day", "mark", "own"), ["mark", "own"], [T, "day"], 1 / year)
    return out.select(
        F.col("mark_dd").alias("dd_d"), _sharpe("mark", year).alias("sharpe_d"), F.col("own_dd").alias("dd_top_d"),
        _sharpe("own", year).alias("sharpe_top_d"),
    )


def record(
    rows: DataFrame, step: int = FWD, cost: float = 0.004, cash: float = 1.0, year: int = YEAR, least_periods: int = 30, weight: str | None = "cap", daily: bool = True,
    by_pct: bool = False, actual: bool = False, **least: int,
) -> DataFrame:
    """All figures of one factor in one row (none with fewer than ``least_periods`` accepted periods): the excess, the portfolio itself,
    the market, the excess over the weighted market and its ``tilt``, the last two years, and the daily risk of excess and portfolio.

    ``rows`` come from :func:`trades`, with ``date``.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    names = least.pop("least", 100)
    if daily:
        rows = rows.select(SYM, T, "f", "can", "ret", "close", "date", *([weight] if weight else [])).checkpoint()
    pool = _kept(rows, step, names, by_pct, weight)
    per = _of_pool(pool, cost, weight=weight, cash=cash, actual=actual, **least)
    out = figures_of(per, step, year, least_periods, weight)
    if daily:
        out = out.crossJoin(daily_figures(daily_marks(rows, per, pool, step, cost, cash), year))
        out = out.withColumns({"calmar_d": _calmar("ann_ex", "dd_d"), "calmar_top_d": _calmar("ann_top", "dd_top_d")})
    return out


def figures_of(per: DataFrame, step: int = FWD, year: int = YEAR, least_periods: int = 30, weight: str | None = "cap") -> DataFrame:
    """:func:`record` of given :func:`periods`, without the daily risk."""
    cols = ["excess", "net", "market"] + (["excess_w", "market_w"] if weight else [])
    out = _summary(per.select(T, "turn", *cols), cols, [T], step / year).where(F.col("periods") >= least_periods)
    figures = [
        "periods", F.col("net_ann").alias("ann_top"), F.col("net_dd").alias("dd_top"), _calmar("net_ann", "net_dd").alias("calmar_top"),
        _sharpe("net", year / step).alias("sharpe_top"),
    ]
    figures += [
        F.col("market_ann").alias("ann_mkt"), F.col("excess_ann").alias("ann_ex"), F.col("excess_dd").alias("dd"),
        _calmar("excess_ann", "excess_dd").alias("calmar"), _sharpe("excess", year / step).alias("sharpe"), "turn",
    ]
    if weight:
        figures += [
            F.col("excess_w_ann").alias("ann_ex_cw"), F.col("excess_w_dd").alias("dd_cw"),
            _calmar("excess_w_ann", "excess_w_dd").alias("calmar_cw"), _sharpe("excess_w", year / step).alias("sharpe_cw"),
        ]
        figures += [(F.col("excess_w_ann") - F.col("excess_ann")).alias("tilt"), F.col("market_w_ann").alias("ann_mkt_cw")]
    out = out.select(*figures)
    years = yearly(per).agg(F.sort_array(F.collect_list(F.struct("year", "excess")), asc=False).alias("y"))
    last = F.get("y", F.lit(0))["excess"]
    return out.crossJoin(
        years.select(
            last.alias("last_yr"), F.coalesce(F.get("y", F.lit(1))["excess"], last).alias("last2_yr"),
            F.size(F.filter("y", lambda x: x["excess"] <= -0.02)).alias("bad_years"),
        )
    )
