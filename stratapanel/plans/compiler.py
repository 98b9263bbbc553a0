"""Compile a batch of expressions to one DataFrame plan.

All nodes of all expressions form one graph in which equal subtrees are one node.  Nodes are computed in rounds: those along time
together (one exchange by symbol), then those across symbols together (one exchange by date), and so on; element-wise nodes are
inlined where they are needed.  So the number of exchanges is the number of changes of axis, not of operators.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan, ts
from ..functions.ts import SYM, T
from .expr import Node, bare
from .registry import OPERATORS


def evaluate(panel: DataFrame, expressions: dict[str, Node], keep: tuple[str, ...] = ()) -> DataFrame:
    """``sym, t``, the columns in ``keep``, and one column per expression."""
    needed = {leaf for e in expressions.values() for leaf in e.leaves}
    # a kept column may also be a leaf
    frame = panel.select(SYM, T, *sorted((needed | set(keep)) - {SYM, T}))
    done: dict[Node, str] = {}
    names = {n: f"__n{i}" for i, n in enumerate(sorted({n for e in expressions.values() for n in e.walk() if n.args}, key=str))}

    def column(n: Node) -> Column | None:
        """The node over what is there already, or None if it still needs a window."""
        if not n.args:
            return F.col(n.op)
        if n in done:
            return F.col(done[n])
        if OPERATORS[n.op].axis == "row":
            inner = [column(a) for a in n.args]
            return None if None in [x if x is None else True for x in inner] else OPERATORS[n.op].build(*inner)
        return None

    waiting = [n for n in names if OPERATORS[n.op].axis != "row"]
    axis = "time"
    while waiting:
        now = ("time", "series", "rolling", "scan") if axis == "time" else (axis,)
        ready = [n for n in waiting if OPERATORS[n.op].axis in now and all(column(a) is not None for a in n.args)]
        if not ready:
            axis = "section" if axis == "time" else "time"
            continue
        # inputs that are expressions get a column of their own, so that each is computed once however many windows read it
        inputs = {a: f"{names[a]}" for n in ready for a in n.args if a.args and a not in done}
        if inputs:
            frame = frame.withColumns({c: column(a) for a, c in inputs.items()})
            done |= inputs
        plain = [n for n in ready if OPERATORS[n.op].axis in ("time", "section")]
        if plain:
            frame = frame.withColumns({names[n]: OPERATORS[n.op].build(*[column(a) for a in n.args]) for n in plain})
        frame = _rolling(frame, {names[n]: (n, [done.get(a, a.op) for a in n.args]) for n in ready if OPERATORS[n.op].axis == "rolling"})
        scanned = {names[n]: scan.scan(OPERATORS[n.op].build, done.get(n.args[0], n.args[0].op), OPERATORS[n.op].window) for n in ready if OPERATORS[n.op].axis == "scan"}
        if scanned:
            frame = scan.scans(frame, scanned)
        series = [n for n in ready if OPERATORS[n.op].axis == "series"]
        if series:
            frame = _over_series(frame, {names[n]: (n, done.get(n.args[0], n.args[0].op)) for n in series})
        done |= {n: names[n] for n in ready}
        waiting = [n for n in waiting if n not in done]
    return frame.select(SYM, T, *[c for c in keep if c not in (SYM, T)], *[column(e).alias(k) for k, e in expressions.items()])


def _rolling(frame: DataFrame, nodes: dict[str, tuple[Node, list[str]]]) -> DataFrame:
    """Operators that share sums over sliding windows: one pass for each input and window."""
    regressions: dict[tuple[str, int], dict[str, str]] = {}
    for out, (n, sources) in nodes.items():
        if len(sources) == 2:
            frame = OPERATORS[n.op].build(frame, *sources, OPERATORS[n.op].window, out)
        else:
            regressions.setdefault((sources[0], OPERATORS[n.op].window), {})[bare(n.op).removeprefix("ts_")] = out
    for (source, w), out in regressions.items():
        frame = ts.regressions(frame, source, w, out)
    return frame


def _over_series(frame: DataFrame, nodes: dict[str, tuple[Node, str]]) -> DataFrame:
    """Operators that need a symbol's whole ordered series: one pass over it in pandas, next to the columns that are needed anyway."""
    builds = {c: (OPERATORS[n.op].build, src) for c, (n, src) in nodes.items()}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + "".join(f", `{c}` double" for c in builds)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(T, ignore_index=True)
        return rows.assign(**{c: build(rows[src].astype(float)) for c, (build, src) in builds.items()})

    return frame.groupBy(SYM).applyInPandas(run, schema)
