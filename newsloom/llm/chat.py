"""Chat formatting of reply trees.

Messages point to the message they answer. Self-joins over doubled distances (1, 2, 4 ... steps towards the root) give
each message its depth and the score of its path; the branches of a tree are ranked by the mean score of their messages,
and the same joins, read backwards, enumerate the paths of the chosen leaves. A path of n messages takes about log2(n)
joins. Each chosen path becomes one text in a template that marks turns and escapes its own marks inside texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.shared import free_name, map_arrow, written

#: The template: what stands before and after a turn's text. Other roles are named in their mark.
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
BEGIN = "<s>"
OTHER = ("<<ROLE {}>> ", " <</ROLE>>")
#: What follows the first character of each control string. In texts, backslashes after that character are one more.
_CONTROL = r"(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|<ROLE|</ROLE>>)"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_OPEN = re.compile(r"\[INST\] |<<SYS>> |<<ROLE ([^>]*)>> | ")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the stretches of it whose tokens bear the loss: the assistant's texts."""
    out, at, spans = [BEGIN], len(BEGIN), []
    for role, text in turns:
        before, after = TURNS.get(role) or (OTHER[0].format(quote(role, safe="")), OTHER[1])
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the inverse of :func:`format_turns`."""
    turns, at = [], len(BEGIN)
    while at < len(formatted):
        opened = _OPEN.match(formatted, at)
        mark = opened[0]
        if opened[1] is not None:
            role, after = unquote(opened[1]), OTHER[1]
        else:
            role, after = next((r, b) for r, (a, b) in TURNS.items() if a == mark)
        # Escaped texts hold no control string, but one may begin with the space that precedes the closing mark.
        end = formatted.index(after, opened.end())
        turns.append((role, unescape(formatted[opened.end() : end])))
        at = end + len(after)
    return turns


def chosen_paths(
    messages: DataFrame,
    tree: str = "tree",
    node: str = "node",
    parent: str = "parent",
    score: str | None = None,
    best: int = 1,
) -> DataFrame:
    """The messages on the ``best`` branches of each tree: the columns of ``messages``, ``path`` (rank) and ``position``.

    Branches are ranked by the mean score of their messages, then by the id of their leaf. A null score counts as 0; a
    message that answers none of its tree's messages is a root. Nodes must be unique and not null within a tree. Messages
    that answer each other in a circle have no root and are left out. An empty table gives an empty result. A column of the
    messages called ``path`` or ``position`` gets an underscore behind its name.
    """
    added = ["path", "position"]
    names = messages.columns
    messages = messages.select(*[F.col(f"`{c}`").alias(free_name(c, added, names)) for c in names])
    tree, node, parent = (free_name(c, added, names) for c in (tree, node, parent))
    score = free_name(score, added, names) if score else None
    own = messages.select(
        F.col(tree).alias("t"),
        F.col(node).alias("n"),
        F.col(parent).alias("p"),
        (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("s"),
    )
    known = own.select("t", F.col("n").alias("p"), F.lit(True).alias("there"))
    step = own.join(known, ["t", "p"], "left").select("t", "n", F.when(F.col("there"), F.col("p")).alias("up"), "s", F.lit(1).cast("long").alias("len"))
    steps = [written(step, "steps")]
    left = None
    while True:
        now = steps[-1]
        open_ = now.where("up is not null").count()
        if not open_ or (open_ == left and len(steps) > 40):
            break
        left = open_
        above = now.select("t", F.col("n").alias("up"), F.col("up").alias("up2"), F.col("s").alias("s2"), F.col("len").alias("len2"))
        doubled = now.join(above, ["t", "up"], "left").select(
            "t", "n", F.col("up2").alias("up"), (F.col("s") + F.coalesce("s2", F.lit(0.0))).alias("s"), (F.col("len") + F.coalesce("len2", F.lit(0))).alias("len")
        )
        steps.append(written(doubled, "steps"))
    whole = steps[-1].where("up is null")
    answered = steps[0].where("up is not null").select("t", F.col("up").alias("n")).distinct()
    leaves = whole.join(answered, ["t", "n"], "left_anti")
    ranked = leaves.withColumn("path", F.row_number().over(Window.partitionBy("t").orderBy(F.desc(F.col("s") / F.col("len")), "n")))
    # From the leaves, and with each level's distance from all reached so far, every message above is reached once.
    reached = written(ranked.where(F.col("path") <= best).select("t", "n", "path"), "reached")
    for level in reversed(steps[:-1]):
        ups = reached.join(level.select("t", "n", "up"), ["t", "n"]).where("up is not null")
        reached = written(reached.unionByName(ups.select("t", F.col("up").alias("n"), "path")).distinct(), "reached")
    placed = reached.join(whole.select("t", "n", F.col("len").alias("position")), ["t", "n"])
    return messages.join(
        placed.select(F.col("t").alias(tree), F.col("n").alias(node), "path", "position"), [tree, node]
    )


FORMATTED = "formatted string, spans array<struct<begin:long,end:long>>"


def format_paths(paths: DataFrame, keys: list[str], role: str = "role", text: str = "text") -> DataFrame:
    """One formatted conversation per path: ``keys``, the text and the stretches under the loss mask, in code points.

    A null role is an empty one, a null text is empty. ``paths`` needs a ``position``.
    """
    turn = F.struct(F.col("position"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gathered = paths.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kinds = {f.name: f.dataType.simpleString() for f in paths.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [FORMATTED])
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in part.column(len(keys)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keys))]
                    + [pa.array([m[0] for m in made], pa.string()), pa.array([[{"begin": a, "end": b} for a, b in m[1]] for m in made], span)],
                    [*keys, "formatted", "spans"],
                )

    return map_arrow(gathered, run, schema)


def as_chain(rows: DataFrame, tree: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """Rows of linear conversations as reply trees in which each message answers the one before it.

    Rows are ordered by turn (null first), role and text; rows that are equal in all of these are separate turns.
    """
    order = Window.partitionBy("tree").orderBy(F.col(turn), F.col(role), F.col(text))
    named: Column = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    numbered = rows.select(F.col(tree).alias("_conversation"), named.alias("tree"), turn, role, text).withColumn("node", F.row_number().over(order))
    return numbered.select("_conversation", "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"))


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame, id_column: str) -> DataFrame:
    """What the formatted texts say when they are read back: turns, and the text under the loss mask."""
    kind = formatted.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]],
                [id_column, *[c.split()[0] for c in DIGESTS.split(", ")]],
            )

    return map_arrow(formatted.select(id_column, "formatted", "spans"), run, f"`{id_column}` {kind}, {DIGESTS}")
