"""The operators an expression may use.  An operator is declared once, here; users may add their own with :func:`register`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cs, scalar, ts


@dataclass(frozen=True)
class Operator:
    name: str
    arity: int
    #: "row" (element-wise), "time" (per symbol) or "section" (per date), which build a column from columns; "rolling" adds columns to a frame
    #: (see :func:`ts.regressions`, :func:`ts.correlations`); "scan" names a kind of :class:`scan.Scan`, all of which share one pass; "series" maps
    #: a symbol's whole ordered series (pandas) to another.
    axis: str
    build: Callable | str
    window: int | None = None


OPERATORS: dict[str, Operator] = {}


def register(name: str, arity: int, axis: str, build: Callable[..., Column] | str, window: int | None = None) -> None:
    if name in OPERATORS:
        raise ValueError(f"operator {name} exists")
    OPERATORS[name] = Operator(name, arity, axis, build, window)


def _scanned(prefix: str, windows: tuple[int, ...], kind: str) -> None:
    for w in windows:
        register(f"{prefix}{w}", 1, "scan", kind, w)


def _windowed(prefix: str, windows: tuple[int, ...], build: Callable[..., Column], arity: int = 1, axis: str = "time") -> None:
    for w in windows:
        register(f"{prefix}{w}", arity, axis, (lambda *x, w=w: build(*x, w)), w)


_scanned("ts_mean", (5, 10, 20, 60, 100, 120, 150, 200), "mean")
_scanned("ts_std", (20, 60, 100, 150, 200), "std")
_scanned("ts_sum", (20, 100), "sum")
_scanned("ts_max", (20, 100), "max")
_scanned("ts_min", (20, 100), "min")
_scanned("ts_rank", (10, 20, 60, 100, 200), "rank")
_windowed("ts_delay", (1,), ts.ts_delay)
_windowed("ts_delta", (5, 10, 20, 60, 120), ts.ts_delta)
_scanned("ema", (5, 12, 20, 26, 60), "ema")
for _kind in ("slope", "rsqr", "resi"):
    for _w in (5, 10, 20, 60):
        register(f"ts_{_kind}{_w}", 1, "rolling", ts.regressions, _w)
_scanned("ts_skew", (20, 60), "skew")
_scanned("ts_kurt", (20, 60), "kurt")
for _w in (20, 60, 100, 200):
    register(f"corr{_w}", 2, "rolling", ts.correlations, _w)
register("cs_rank", 1, "section", cs.cs_rank)
register("cs_demean", 1, "section", cs.cs_demean)
register("cs_scale", 1, "section", cs.cs_scale)
register("log", 1, "row", scalar.safe_log)
register("abs", 1, "row", F.abs)
register("neg", 1, "row", lambda x: -x)
register("sign", 1, "row", F.signum)
register("add", 2, "row", lambda a, b: a + b)
register("sub", 2, "row", lambda a, b: a - b)
register("mul", 2, "row", lambda a, b: a * b)
register("div", 2, "row", scalar.safe_div)
register("min", 2, "row", scalar.lower_of)
register("max", 2, "row", scalar.higher_of)

# The leaf fields by family, with the dimension each carries (price, volume, amount, market value, ratio, log).
_MONEY = [f"mf_{size}_{side}" for size in ("s", "m", "l", "x") for side in ("buy", "sell", "bqty", "sqty")]
STYLES = tuple(
    f"barra_{s}" for s in (
        "beta", "momentum", "size", "earnings_yield", "residual_volatility", "growth", "book_to_price", "leverage", "liquidity",
        "non_linear_size", "comovement",
    )
)
FINANCIALS = tuple(
    f"fa_{s}" for s in (
        "np_yoy", "rev_yoy", "op_yoy", "ocf_yoy", "gm", "np_margin", "roe", "lev", "accrual", "asset_turn", "gw", "inv_turn", "recv_turn",
        "sell_exp", "ocf_ta", "pb", "fcf_yield",
    )
)
ALTERNATIVE = ("mg_bal_ratio", "mg_buy_ratio", "lhb_net_ratio", "lhb_inst_ratio", "block_vol_ratio")
LEAVES: dict[str, str] = {
    "close": "P", "open": "P", "high": "P", "low": "P", "volume": "V", "turnover": "A", "mktcap": "M",
    "vwap": "P", "ret": "R", "turn_ratio": "R", "ln_mktcap": "L", "ln_volume": "L", "overnight": "R", "intraday": "R", "amplitude": "R", "up_shadow": "R", "down_shadow": "R", "hl_ratio": "R", "true_range": "R",
    **{f: ("V" if f.endswith("qty") else "A") for f in _MONEY}, **{f: "R" for f in (*STYLES, *FINANCIALS, *ALTERNATIVE)},
}


def entries() -> list[dict]:
    """The operators and leaves as plain rows, to be stored or shown: kind, name, arity, axis, window, dimension."""
    ops = [{"kind": "operator", "name": o.name, "arity": o.arity, "axis": o.axis, "window": o.window, "dimension": None} for o in OPERATORS.values()]
    return ops + [{"kind": "leaf", "name": k, "arity": 0, "axis": None, "window": None, "dimension": d} for k, d in LEAVES.items()]
