"""The trie of all conversations' prefixes, by van Emde Boas recursion.

A sequence is a conversation's turns, each a digest of role and text with its number of words. Equal sequences are one from
the start. Then, with ``m`` going from half the greatest depth down to one:

*Cutting.* A piece is a part of the trie of height 2m below one node. Sequences longer than m are cut: what comes before
the cut stays in the upper piece, where equal prefixes become one and get a name; what comes after goes to the lower piece
below that name. A node's name is its depth and the least conversation that has it, so it is the same in whatever piece it is
found. All pieces of a height are cut in one step, and after about log2(depth) steps a piece is one turn: a node.

*Grafting.* Every lower piece sums up its nodes' values, under the name it hangs from. From the greatest m down, the sum of
a piece is passed on to the path that leads to it through its upper piece, as a whole: paths are halved as the pieces were,
until they are nodes.

Both passes take a number of steps that grows with the logarithm of the depth, and move rows by key. A conversation's turns
are gathered into an array of 20 bytes a turn; no other group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import map_arrow, written

#: Conversations are borrowed from within blocks of this many ids; of this many turns' choices.
BLOCK, MOST = 20, 4
#: Parts of a crowded prefix.
SALTS = 64
#: Ids that are put together before they move, by ranges of as many ids.
ID_RANGE = 1024
#: Grafting steps between two written tables.
STEPS = 4


# --- sequences --------------------------------------------------------------------------------------------------------


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, seq) of (conv_id, turn, role, text): a conversation's turns in order, as (digest, words).

    Null turns come first; repeated turns are ordered by role and the text's digest. Null roles and texts are empty. Rows
    with a null ``conv_id`` belong to no conversation and are left out. Other columns are not read.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The role's length keeps (role, text) apart from any other split of the same letters.
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    n_words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    turn = F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), n_words.alias("words"))
    known = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    inner = F.transform(F.array_sort(F.collect_list("t"), _by_turn), lambda t: F.struct(t["digest"], t["words"]))
    return known.groupBy("conv_id").agg(inner.alias("seq"))


def _by_turn(a: Column, b: Column) -> Column:
    """Order of turns: null first, then by turn, role and digest."""
    key = lambda t: F.struct(t["turn"].isNotNull(), t["turn"], t["role"], t["digest"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation with its beginning taken from the first of its block of ``BLOCK`` ids.

    The number of turns taken is the checksum of the id modulo ``MOST``; those turns of its own it loses. The first of a negative
    id's block is the one next to zero.
    """
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % BLOCK
    heads = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("first"), F.slice("seq", 1, MOST - 1).alias("head"))
    asked = own.select("conv_id", "seq", n.alias("n"), first.alias("first"))
    none = F.array().cast(own.schema["seq"].dataType)
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("n"))
    rest = F.slice("seq", F.col("n") + 1, F.greatest(F.size("seq") - F.col("n"), F.lit(0)))
    return asked.join(heads, "first", "left").select("conv_id", F.concat(head, rest).alias("seq"))


# --- cutting ----------------------------------------------------------------------------------------------------------


def _named(rows: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``name`` by ``keys``. Crowded keys are spread: names go to the parts of a key that have rows, and to no other."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    salted = rows.withColumn("salt", salt)
    parts = salted.select(*keys, "salt").distinct()
    return salted.join(parts.join(names, keys), [*keys, "salt"]).drop("salt")


def _cut(pieces: DataFrame, m: int) -> DataFrame:
    """Pieces of height 2m to pieces of height m.

    A row is a path in its piece: ``at``, the depth of the piece's top, and ``top``, its name; ``seq``; ``id``, the least
    conversation that has it, and ``n``, how many have it; ``end``, the sequence that ends with it, if one does; ``tops``, the names
    of the lower pieces it is in, the greatest first.
    """
    keys = ["at", "top", "tops", "seq"]
    # Only paths of m turns and more can be equal as far as the cut.
    short = pieces.where(F.size("seq") < m)
    reach = written(pieces.where(F.size("seq") >= m).withColumn("rest", F.expr(f"slice(seq, {m + 1}, size(seq))")).withColumn("seq", F.slice("seq", 1, m)), "trie-cut")
    upper = written(reach.groupBy(*keys).agg(F.min("id").alias("id"), F.sum("n").alias("n"), F.max(F.when(F.size("rest") == 0, F.col("end"))).alias("end")), "trie-upper")
    below = reach.where(F.size("rest") > 0)
    lower = _named(below, upper.select(*keys, F.col("id").alias("name")), keys).select(
        (F.col("at") + m).alias("at"), F.col("name").alias("top"), F.concat("tops", F.array(F.struct((F.col("at") + m).alias("depth"), F.col("name").alias("id")))).alias("tops"),
        F.col("rest").alias("seq"), "id", "n", "end",
    )
    return short.unionByName(upper).unionByName(lower)


def nodes_of(units: DataFrame, height: int, root: int) -> DataFrame:
    """The nodes below the root: (depth, id, parent, n, words, end, tops) of (id, n, seq); ``height`` is a power of two, at least the longest."""
    none = F.array().cast("array<struct<depth:int,id:bigint>>")
    pieces = units.where(F.size("seq") > 0).select(
        F.lit(0).alias("at"), F.lit(root).cast("long").alias("top"), none.alias("tops"), "seq", "id", "n", F.col("id").alias("end")
    )
    m = height // 2
    while m:
        pieces = written(_cut(pieces, m), "trie-pieces")
        m //= 2
    return pieces.select((F.col("at") + 1).alias("depth"), "id", F.col("top").alias("parent"), "n", F.col("seq")[0]["words"].alias("words"), "end", "tops")


# --- grafting ---------------------------------------------------------------------------------------------------------


def _grafted(nodes: DataFrame, height: int) -> DataFrame:
    """(depth, id, leaves, saved): what all lower pieces add to each node above them. ``nodes`` have their own values and ``tops``."""
    hung = nodes.select("leaves", "saved", F.explode("tops").alias("t")).groupBy(F.col("t.depth").alias("depth"), F.col("t.id").alias("id"))
    sums = written(hung.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-sums")
    tops = nodes.select("depth", "id", "tops")
    paths: DataFrame | None = None
    m, step = height // 2, 0
    while m:
        # Lower pieces of height m hang from depths whose lowest bit is m.
        fresh = sums.where(F.col("depth").bitwiseAND(F.lit(2 * m - 1)) == m)
        if paths is not None:
            # A path of 2m turns that ends in a node: its upper half ends at the cut, which is among the node's tops.
            cut = F.filter("tops", lambda t: t["depth"] == F.col("depth") - m)[0]["id"]
            both = paths.join(tops, ["depth", "id"]).select(
                F.explode(F.array(F.struct("depth", "id"), F.struct((F.col("depth") - m).alias("depth"), cut.alias("id")))).alias("p"), "leaves", "saved"
            )
            fresh = fresh.unionByName(both.select("p.depth", "p.id", "leaves", "saved"))
            fresh = fresh.groupBy("depth", "id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        step += 1
        paths = written(fresh, "trie-paths") if step % STEPS == 0 else fresh
        m //= 2
    return paths if paths is not None else sums


# --- ends -------------------------------------------------------------------------------------------------------------


def _ends(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of each sequence's conversations, numerically ascending and joined by commas.

    Ids are joined by ranges where they are; a checksum is one stream, so the ranges of a sequence then pass through one
    task in order, without being held.
    """
    block = F.floor(F.col("conv_id") / ID_RANGE).alias("block")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    ranges = members.groupBy("key", block).agg(joined)
    ordered = ranges.repartition("key").sortWithinPartitions("key", "block").select("key", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, hashlib.sha256()
        for batch in batches:
            keys, digests = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == current:
                    state.update(b",")
                else:
                    if current is not None:
                        keys.append(current)
                        digests.append(state.hexdigest())
                    current, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    return map_arrow(ordered, run, "key binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of (conv_id, seq), the root included; see the columns of the result.

    conv_id       the least conversation that begins with the node's turns; with ``depth`` it names the node
    parent_conv_id  the same of the parent; null for the root
    n_convs, n_children, n_leaves  conversations, children, and childless nodes below or at the node
    saved_tokens  (n_convs - 1) x words of the last turn, summed over the node and all below
    ends_sha256   digest of the ids of the conversations that end here

    Conversations without turns belong to the root. An empty table has no node. Other columns are not read.
    """
    key = F.unhex(F.md5(F.concat(F.size("seq").cast("string").cast("binary"), F.array_join(F.transform("seq", lambda t: F.hex(t["digest"])), "").cast("binary"))))
    members = written(conversations.select("conv_id", "seq", key.alias("key")), "trie-sequences")
    units = written(members.groupBy("key", "seq").agg(F.min("conv_id").alias("id"), F.count(F.lit(1)).alias("n")), "trie-units")
    totals = units.agg(F.min("id").alias("id"), F.sum("n").alias("n"), F.max(F.size("seq")).alias("depth"), F.min(F.when(F.size("seq") == 0, F.col("id"))).alias("turnless")).first()
    root = totals["id"] if totals["id"] is not None else 0
    height = 1
    while height < (totals["depth"] or 1):
        height *= 2
    raw = written(nodes_of(units, height, root), "trie-nodes")
    children = raw.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    valued = written(
        raw.join(children, ["depth", "id"], "left").select(
            *raw.columns,
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
            ((F.col("n") - 1) * F.col("words")).alias("saved"),
        ),
        "trie-values",
    )
    more = _grafted(valued, height).withColumnsRenamed({"leaves": "more_leaves", "saved": "more_saved"})
    whole = valued.join(more, ["depth", "id"], "left").select(
        "depth", "id", "parent", "n", "n_children", "end",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
    )
    whole = written(whole, "trie-totals")
    # The root: one row, of sums over its children.
    top = whole.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    one = top.where(F.lit(totals["id"] is not None)).select(
        F.lit(0).alias("depth"), F.lit(root).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(totals["n"] or 0).cast("long").alias("n"),
        "n_children", F.lit(totals["turnless"]).cast("long").alias("end"), F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"),
    )
    every = whole.unionByName(one)
    digests = _ends(members.select("key", "conv_id")).join(units.select("key", F.col("id").alias("end")), "key").drop("key")
    return every.join(digests, "end", "left").select(
        F.col("id").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
