"""Chat formatting with typed content parts (DataFrame operations only).

A turn's content is a list of parts (kind, text, ref, tokens).  A visitor maps each part by its kind: text is escaped, an image,
audio or document part becomes its placeholder, in order; attachments keep the reference and the token count the placeholder
expands to.  The template is::

    <|turn|>role\\n content <|end|>\\n        for every turn

Control strings inside roles and texts are escaped reversibly: the escape mark is doubled, and one mark is put behind the first
character of each control string, so that the marks of the template occur nowhere else.  The loss mask is kept as runs
(length in code points, in the loss or not), which add up to the length of the output.

Cases: null texts and roles count as empty; turns are ordered by turn number (null first), ties by their formatted text;
repeated rows are repeated turns; a row without a conversation id is a conversation of its own; an unknown kind of part is
formatted as text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens that a placeholder expands to where the part doesn't say.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}
CONTROL = (TURN, END, *PLACEHOLDERS.values(), "</s>", "<s>", "[INST]", "[/INST]")
MARK = "␛"
_LINE = MARK + "n"


def escape(text: Column) -> Column:
    """Reversible: see :func:`unescape`."""
    marked = F.replace(text, F.lit(MARK), F.lit(MARK + MARK))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + MARK + s[1:])), CONTROL, marked)


def unescape(text: Column, also: tuple[tuple[str, str], ...] = ()) -> Column:
    """The text before :func:`escape`.  Doubled marks are told from left to right first, so that no half of one is taken for another mark.

    ``also`` are further pairs (escaped, plain), each with one mark.
    """
    pairs = [*((s[0] + MARK + s[1:], s) for s in CONTROL), *also]
    plain = lambda part: reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, part)
    return F.array_join(F.transform(F.split(text, MARK + MARK, -1), plain), MARK)


def text_parts(text: str) -> Column:
    """A plain text column as one text part."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"), none.cast("string").alias("ref"),
            none.cast("int").alias("tokens"),
        )
    )


def _visit(part: Column) -> Column:
    shown = F.when(part["kind"] == "image", PLACEHOLDERS["image"])
    for kind in ("audio", "document"):
        shown = shown.when(part["kind"] == kind, PLACEHOLDERS[kind])
    return shown.otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _expanded(part: Column) -> Column:
    words = F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(r"\S+"))
    tokens = F.when(part["kind"] == "image", DEFAULT_TOKENS["image"])
    for kind in ("audio", "document"):
        tokens = tokens.when(part["kind"] == kind, DEFAULT_TOKENS[kind])
    return F.when(part["kind"].isin(*PLACEHOLDERS), F.coalesce(part["tokens"], tokens)).otherwise(words)


def format_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str | Column = "parts",
) -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_runs``, ``attachments`` and ``expanded_tokens``.

    Attachments are structs (turn, position among the turn's parts, kind, ref, tokens) in the order of their placeholders.
    """
    parts = F.col(parts) if isinstance(parts, str) else parts
    lone = F.when(F.col(conv).isNull(), F.monotonically_increasing_id())
    rows = turns.select(
        F.col(conv).alias("__conv"), lone.alias("__lone"), F.col(turn).alias("__turn"), F.coalesce(F.col(role), F.lit("")).alias("__role"),
        F.coalesce(parts, F.array()).alias("__parts"),
    )
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("__role")), F.lit("\n"), F.lit(_LINE)), F.lit("\n"))
    rows = rows.withColumns({"__head": head, "__body": F.array_join(F.transform("__parts", _visit), "")})
    held = F.filter(
        F.transform(
            "__parts", lambda p,
            i: F.struct(
                F.col("__turn").alias("turn"), i.alias("position"), p["kind"].alias("kind"), p["ref"].alias("ref"),
                _expanded(p).cast("long").alias("tokens"),
            ),
        ),
        lambda x: x["kind"].isin(*PLACEHOLDERS),
    )
    spent = F.aggregate("__parts", F.lit(0).cast("long"), lambda n, p: n + _expanded(p))
    loss = F.col("__role") == "assistant"
    rows = rows.select(
        "__conv",
        "__lone",
        F.struct(
            F.col("__turn").alias("turn"),
            F.concat("__head", "__body", F.lit(END + "\n")).alias("piece"),
            F.array(
                F.struct(F.length("__head").cast("long").alias("chars"), F.lit(False).alias("loss")),
                F.struct(F.length("__body").cast("long").alias("chars"), loss.alias("loss")),
                F.struct(F.lit(len(END) + 1).cast("long").alias("chars"), F.lit(False).alias("loss")),
            ).alias("runs"),
            held.alias("held"),
            spent.alias("tokens"),
        ).alias("__t"),
    )
    grouped = rows.groupBy("__conv", "__lone").agg(F.array_sort(F.collect_list("__t")).alias("__t"))
    return grouped.select(
        F.col("__conv").alias(conv),
        F.array_join(F.transform("__t", lambda t: t["piece"]), "").alias("formatted"),
        F.flatten(F.transform("__t", lambda t: t["runs"])).alias("loss_runs"),
        F.flatten(F.transform("__t", lambda t: t["held"])).alias("attachments"),
        F.aggregate("__t", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("expanded_tokens"),
    )


def _pieces(formatted: Column) -> Column:
    """The turns of an output as they are written, without the mark at their ends."""
    pieces = F.split(formatted, rf"\Q{END}\E\n", -1)
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def parse(formatted: Column) -> Column:
    """The turns of an output, read back: an array of structs (role, text), unescaped."""

    def turn(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(TURN) + 1), at - len(TURN) - 1)
        return F.struct(unescape(role, ((_LINE, "\n"),)).alias("role"), unescape(F.substring(piece, at + 1, F.length(piece))).alias("text"))

    return F.transform(_pieces(formatted), turn)


def _cut(text: Column, at: Column, run: Column) -> Column:
    return F.when(run["loss"], unescape(F.substring(text, at.cast("int") + 1, run["chars"].cast("int")))).otherwise(F.lit(""))


def under_loss(formatted: Column, runs: Column) -> Column:
    """What lies under the loss mask of an output, unescaped: cut from it at the running sums of the runs' lengths.

    Where the runs of each turn add up to its length, as they do in what :func:`format_turns` makes, the cuts are made turn by turn, which
    takes time in proportion to the text; other masks are cut from the whole.
    """
    pieces = F.transform(_pieces(formatted), lambda p: F.concat(p, F.lit(END + "\n")))
    three = lambda i: [F.element_at(runs, i.cast("int") * 3 + k) for k in (1, 2, 3)]
    fits = F.transform(pieces, lambda p, i: F.length(p) == sum((r["chars"] for r in three(i)), F.lit(0)))

    def of_turn(piece: Column, i: Column) -> Column:
        a, b, c = three(i)
        return F.concat(_cut(piece, F.lit(0), a), _cut(piece, a["chars"], b), _cut(piece, a["chars"] + b["chars"], c))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate(
        runs, start, lambda acc, r: F.struct((acc["at"] + r["chars"]).alias("at"), F.concat(acc["out"], F.array(_cut(formatted, acc["at"], r))).alias("out")),
        lambda acc: acc["out"],
    )
    aligned = F.when(F.size(runs) == 3 * F.size(pieces), F.forall(fits, lambda x: x)).otherwise(F.lit(False))
    return F.array_join(F.when(aligned, F.transform(pieces, of_turn)).otherwise(walked), "")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the output holds, read back from it: turns, their digest, the text under the loss mask and its digest, the length."""
    rows = formatted.select(conv, "formatted", "loss_runs", parse(F.col("formatted")).alias("__turns"))
    rows = rows.withColumn("__loss", under_loss(F.col("formatted"), F.col("loss_runs")))
    whole = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        conv, F.size("__turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
