"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles, banded and verified.

1. Document frequencies of all shingles are counted over all documents; only those of a thousandth of the documents or
   more are kept (at most a thousand times the mean shingles of a document, whatever the number of documents).
2. Each document gets ``BANDS`` x ``ROWS`` samples by improved consistent weighted sampling: a shingle of weight w gets
   t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r, with r and c from Gamma(2, 1) and b from (0, 1)
   drawn by hash; the least ln a and its t are the sample. Two documents agree on a sample with the probability of
   their weighted Jaccard similarity.
3. Documents with equal text are one from here on. Those that share a band are compared with pivots of the band; links
   are verified over the whole texts. Linked documents are joined, and a few further rounds take other pivots for
   documents that share a band but not yet a class.
4. Bands that still hold several classes are finished exactly: small ones all with all, the texts of the others by a join
   over their rarest shingles, one of which any two texts similar enough have in common.
5. Classes are the connected components of the links, by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.arrays import Words, batches_of, mix, shingles, words
from newsloom.llm.blocks import BLOCKS, add_up, as_batch, blocks, merge, pack_block
from newsloom.llm.shared import map_arrow, written

SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
#: Shingles of more than this share of the documents weigh less, down to ``LEAST`` for one in every document.
SHARE, LEAST = 0.001, 0.75
#: Pivots of a band in each round, and the most rounds before the exact end; each round's pivots are others.
PIVOTS, ROUNDS = 2, 2
#: In the end, texts of a band compared all with all, and texts of a shingle that meet all others of it in one task.
SMALL, MEET = 8, 64
#: Texts meet by buckets of the logarithm of their weights, of this width.
BUCKET = 0.05
#: Ids are broadcast up to this number (8 bytes each); beyond it they are joined by shuffle.
BROADCAST_IDS = 4_000_000
#: Shingle occurrences a task holds before it sends their counts.
BUFFER = 1 << 19

_KEY = np.uint64(0xFFFFFFFF)
#: Upper bits of a key that pick one of 2^20 counters.
_COUNTER, _COUNTER_SHIFT = np.uint64(0xFFFFF000), np.uint64(12)
_ODD = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


# --- weights ----------------------------------------------------------------------------------------------------------


def _counted(texts: DataFrame, least: float, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Keys (bits of the shingles' hashes) that more than ``least`` of the texts have, ascending, with their numbers."""
    shards = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = add_up(np.concatenate(held))
            return as_batch(list(blocks((keys * np.uint64(shards)) >> np.uint64(32), keys, counts)))

        for batch in batches:
            for a, b in batches_of(batch.column(0)):
                s = shingles(words(batch.column(0).slice(a, b - a)), SIZE)
                once = np.unique((s.rows.astype(np.uint64) << np.uint64(32)) | (s.hashes & mask))
                held.append(once & _KEY)
                n += len(once)
            if n > BUFFER:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def frequent(table: pa.Table) -> pa.Table:
        keys, counts = merge(table.column("block").to_pylist())
        kept = counts > least
        return pa.table({"block": pa.array([pack_block(keys[kept], counts[kept])], pa.binary())})

    # Packed: the driver would hold a Python object for each key of a row.
    rows = map_arrow(texts, count, BLOCKS).groupBy("shard").applyInArrow(frequent, "block binary").collect()
    return merge([bytes(r["block"]) for r in rows]) if rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _frequencies(texts: DataFrame, n_docs: int) -> dict[str, np.ndarray]:
    """Shingles (lower 32 bits of their hashes) of more than ``SHARE`` of the documents, and their weights."""
    least = SHARE * n_docs
    keys, counts = _counted(texts, least, _KEY)
    commonness = np.log(counts / max(least, 1e-9)) / np.log(1 / SHARE)
    weights = (1 - (1 - LEAST) * np.clip(commonness, 0, 1)).astype(np.float32)
    return {"keys": keys, "weights": weights}


def _idf(frequent: dict[str, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """The weight of each shingle: 1 but for frequent ones."""
    out = np.ones(len(hashes), dtype=np.float32)
    keys = frequent["keys"]
    if len(keys) and len(hashes):
        low = hashes & _KEY
        at = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
        hit = keys[at] == low
        out[hit] = frequent["weights"][at[hit]]
    return out


def _bag(s: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: row, hash, occurrences; rows ascending."""
    rows = s.rows
    order = np.lexsort((s.hashes, rows))
    rows, hashes = rows[order], s.hashes[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


# --- samples ----------------------------------------------------------------------------------------------------------


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of 65,536 draws: r and ln c from Gamma(2, 1), b from (0, 1). Two independent 16-bit indexes pick a draw."""
    u = (mix(np.arange(1, 5 * 65536 + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
    u = np.clip(u, 1e-12, 1 - 1e-12).reshape(5, 65536)
    return (-np.log(u[0] * u[1])).astype(np.float32), u[2].astype(np.float32), np.log(-np.log(u[3] * u[4])).astype(np.float32)


_R, _B, _LN_C = _draws()
#: ln a - ln c of a shingle of weight 1, for which t is 0.
_UNIT = -_R * (1 - _B)


def samples(hashes: np.ndarray, weights: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples for each row that has shingles; ``first`` is where these rows begin. Shape (n, rows)."""
    out = np.empty((n, len(first)), dtype=np.uint64)
    odd = np.flatnonzero(weights != 1)
    ln_w = np.log(weights[odd])
    identity = mix(hashes) & _KEY
    with np.errstate(over="ignore"):
        for k in range(n):
            v = hashes * _ODD[k]
            i, j = (v >> np.uint64(48)).astype(np.int32), ((v >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)
            ln_a = _LN_C[j] + _UNIT[i]
            which = identity
            if len(odd):
                r, b = _R[i[odd]], _B[i[odd]]
                t = np.floor(ln_w / r + b)
                ln_a[odd] = _LN_C[j[odd]] - r * (t - b) - r
                which = identity.copy()
                which[odd] ^= mix(t.astype(np.int64).astype(np.uint64)) & _KEY
                which[odd[t == 0]] = identity[odd[t == 0]]
            # Floats as integers of the same order, above the identity of the shingle, which also decides ties.
            bits = ln_a.view(np.uint32)
            ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
            out[k] = np.minimum.reduceat((ordered << np.uint64(32)) | which, first) & _KEY
    return out


def signatures(docs: DataFrame, frequent: object, id_column: str, text_column: str) -> DataFrame:
    """One row per document: id, digest of the text, total weight, and a key for each band (null without shingles)."""
    names = [f"b{i}" for i in range(BANDS)]
    schema = "id long, digest string, weight double, " + ", ".join(f"{b} long" for b in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of(batch.column(2)):
                part = batch.slice(a, b - a)
                rows, hashes, n = _bag(shingles(words(part.column(2)), SIZE))
                weights = n.astype(np.float32) * _idf(frequent.value, hashes)
                present, first = np.unique(rows, return_index=True)
                total = np.bincount(rows, weights=weights, minlength=part.num_rows)
                keys = np.zeros((BANDS, part.num_rows), dtype=np.int64)
                with np.errstate(over="ignore"):
                    if len(present):
                        drawn = samples(hashes, weights, first, BANDS * ROWS)
                        for band in range(BANDS):
                            key = np.full(len(present), band + 1, dtype=np.uint64)
                            for row in drawn[band * ROWS : (band + 1) * ROWS]:
                                key = mix(key * _ODD[7] + row)
                            keys[band, present] = key.view(np.int64)
                none = np.ones(part.num_rows, dtype=bool)
                none[present] = False
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(total, pa.float64()), *[pa.array(k, pa.int64(), mask=none) for k in keys]],
                    ["id", "digest", "weight", *names],
                )

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    read = docs.select(F.col(id_column).cast("long").alias("id"), F.md5(text).alias("digest"), text.alias("text"))
    return map_arrow(read, run, schema)


# --- links ------------------------------------------------------------------------------------------------------------


def _pairs(banded: DataFrame, classes: DataFrame | None, round_: int) -> DataFrame:
    """Distinct pairs (a < b) of each document with the pivots of its bands; later only across classes.

    A pivot is the id next to a number in the sense of exclusive or: any member may be it, and finding it is a minimum.
    """
    seeds = [0] if round_ == 0 else [int(x) >> 24 for x in mix(np.arange(PIVOTS, dtype=np.uint64) + np.uint64(1000 * round_ + 7))]
    if classes is not None:
        known = banded.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    else:
        known = banded.withColumn("class", F.col("id"))
    # A pivot brings its weight and class along, so that it need not be looked up.
    near = [F.min(F.struct(F.col("id").bitwiseXOR(F.lit(s)).alias("x"), "id", "weight", "class")).alias(f"p{i}") for i, s in enumerate(seeds)]
    bands = known.groupBy("band").agg(*near, F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").drop("lo", "hi")
    joined = known.select("band", F.struct("id", "weight", "class").alias("m")).join(bands, "band")
    pairs = joined.select("m", F.explode(F.array(*[f"p{i}" for i in range(len(seeds))])).alias("p"))
    return (
        pairs.where("m.class != p.class").where(_alike_in_weight("m.weight", "p.weight"))
        .select(F.least("m.id", "p.id").alias("a"), F.greatest("m.id", "p.id").alias("b"))
        .distinct()
    )


def similarity(a: pa.Array, b: pa.Array, frequent: dict[str, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of the TF-IDF shingles of two columns of texts, row by row."""
    sides = []
    for column in (a, b):
        rows, hashes, n = _bag(shingles(words(column), SIZE))
        weights = _idf(frequent, hashes).astype(np.float64)
        with np.errstate(over="ignore"):
            sides.append((mix(hashes + mix(rows.astype(np.uint64) + np.uint64(1))), n, weights, rows))
    (ka, na, wa, ra), (kb, nb, wb, rb) = sides
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    count = len(a)
    common = np.bincount(ra[ia], weights=np.minimum(na[ia], nb[ib]) * wa[ia], minlength=count)
    all_ = np.bincount(ra, weights=na * wa, minlength=count) + np.bincount(rb, weights=nb * wb, minlength=count)
    union = all_ - common
    return np.where(union > 0, common / np.maximum(union, 1e-300), 1.0)


def _verified(pairs: DataFrame, docs: DataFrame, frequent: object, id_column: str, text_column: str) -> DataFrame:
    """The pairs whose whole texts are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    texts = written(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "candidates")
    sided = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in batches_of(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                alike = similarity(part.column(2), part.column(3), frequent.value) >= THRESHOLD - 1e-9
                yield part.select(["a", "b"]).filter(pa.array(alike))

    return map_arrow(sided.select("a", "b", "text_a", "text_b"), run, "a long, b long").distinct()


# --- the exact end ----------------------------------------------------------------------------------------------------


def _alike_in_weight(a: str, b: str) -> str:
    return f"least({a}, {b}) >= greatest({a}, {b}) * {THRESHOLD - 1e-5:.6f}"


def _rare(texts: DataFrame, frequent: object, common: object) -> DataFrame:
    """The rarest shingles of each text: (id, class, weight, shingle, rest), rest being the weight from this shingle on.

    A shingle is given while the rest is at least ``THRESHOLD`` of the text. Weight that two texts have in common is in the
    rest of both from the first common shingle on, so similar texts both give that one. Shingles of one text only are left
    out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in batches_of(batch.column(2)):
                part = batch.slice(a, b - a)
                rows, hashes, n = _bag(shingles(words(part.column(2)), SIZE))
                weights = n * _idf(frequent.value, hashes).astype(np.float64)
                number = common.value[(hashes & _KEY) >> _COUNTER_SHIFT]
                order = np.lexsort((hashes, number, rows))
                rows, hashes, weights, number = rows[order], hashes[order], weights[order], number[order]
                total = np.bincount(rows, weights=weights, minlength=part.num_rows)
                rest = np.cumsum(total)[rows] - np.cumsum(weights) + weights
                given = np.flatnonzero((rest >= total[rows] * (THRESHOLD - 1e-5)) & (number > 1))
                at = pa.array(rows[given])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at),
                        part.column(1).take(at),
                        pa.array(total[rows[given]].astype(np.float32)),
                        pa.array(hashes[given].view(np.int64)),
                        pa.array(rest[given].astype(np.float32)),
                    ],
                    ["id", "class", "weight", "shingle", "rest"],
                )

    return map_arrow(texts.select("id", "class", "text"), run, "id long, class long, weight float, shingle long, rest float")


def _bucket(weight: Column) -> Column:
    return F.floor(F.log(weight) / F.lit(BUCKET)).cast("int")


def _by_rare_shingles(rare: DataFrame) -> DataFrame:
    """Pairs (a < b) across classes that have a rare shingle in common and may be similar by what follows it.

    Texts as similar as wanted have ``THRESHOLD / (1 + THRESHOLD)`` of their weights' sum in common, all of it in the rests of both from
    the first common shingle on. So a row is given for every bucket of weights that a partner may have and its rest still
    serves, and only rows of the same shingle and the same two buckets meet, the heavier text on the left. What shares a
    common passage and little else is left out before the join.

    The largest class of a key doesn't meet itself. A text of the left side stands in one cell of its key and those of the right
    come to every cell, so that no task gets all pairs of a common shingle.
    """
    least = THRESHOLD - 1e-5
    share = THRESHOLD / (1 + THRESHOLD) - 1e-5
    own, other = _bucket(F.col("weight")), F.col("other")
    edge = F.exp(other * F.lit(BUCKET))
    text = F.struct("id", "class", "weight", "rest")
    lighter = F.sequence(_bucket(F.col("weight") * F.lit(least)), own)
    heavier = F.sequence(own, _bucket(F.col("weight") / F.lit(least)))
    enough = lambda partner: F.col("rest") >= (F.col("weight") + partner) * F.lit(share)
    left = rare.select("*", F.explode(lighter).alias("other")).where(enough(F.greatest(edge, F.col("weight") * F.lit(least))))
    left = written(left.select("shingle", own.alias("heavy"), other.alias("light"), text.alias("l")), "heavier")
    right = rare.select("*", F.explode(heavier).alias("other")).where(enough(F.greatest(edge, F.col("weight"))))
    right = written(right.select("shingle", other.alias("heavy"), own.alias("light"), text.alias("r")), "lighter")
    keys = ["shingle", "heavy", "light"]
    sides = left.groupBy(*keys, F.col("l.class").alias("class")).count()
    sides = sides.unionByName(right.groupBy(*keys, F.col("r.class").alias("class")).agg(F.lit(0).cast("long").alias("count")))
    groups = sides.groupBy(*keys).agg(
        F.max(F.struct("count", "class")).alias("main"), F.sum("count").alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")
    )
    cells = lambda n: F.ceil(n / F.lit(MEET)).cast("int")
    groups = groups.where("lo < hi").select(
        *keys, F.col("main.class").alias("main"), cells(F.col("main.count")).alias("own"), cells(F.col("n") - F.col("main.count")).alias("others")
    )
    groups = written(groups, "groups")
    place = F.when(F.col("l.class") == F.col("main"), F.pmod(F.xxhash64("l.id"), "own")).otherwise(-1 - F.pmod(F.xxhash64("l.id"), "others"))
    placed = left.join(groups, keys).select(*keys, place.cast("int").alias("cell"), "l")
    # Cells -others..-1 hold other classes, 0..own-1 the main one.
    first, last = -F.col("others"), F.when(F.col("r.class") == F.col("main"), 0).otherwise(F.col("own"))
    every = F.filter(F.sequence(first, F.greatest(first, last)), lambda c: c < last)
    coming = right.join(groups, keys).select(*keys, F.explode(every).alias("cell"), "r")
    met = placed.join(coming, [*keys, "cell"]).where("(l.weight > r.weight or l.weight = r.weight and l.id > r.id) and l.class != r.class")
    met = met.where(_alike_in_weight("l.weight", "r.weight")).where(F.least("l.rest", "r.rest") >= (F.col("l.weight") + F.col("r.weight")) * F.lit(share))
    return met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


def _rest(banded: DataFrame, classes: DataFrame | None, tried: list[DataFrame], docs: DataFrame, frequent: object, id_column: str, text_column: str) -> DataFrame:
    """All pairs (a < b) that the pivots left out: across classes of a band, and not ruled out by weights or rare shingles."""
    spark = banded.sparkSession
    if classes is not None:
        known = banded.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    else:
        known = banded.withColumn("class", F.col("id"))
    bands = known.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    bands = written(bands.select("band", "n"), "bands")
    few = known.join(bands.where(F.col("n") <= SMALL), "band").select("band", F.struct("id", "weight", "class").alias("m"))
    pairs = few.withColumnRenamed("m", "l").join(few.withColumnRenamed("m", "r"), "band").where("l.id < r.id and l.class != r.class")
    pairs = pairs.where(_alike_in_weight("l.weight", "r.weight")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    ids = written(known.join(bands.where(F.col("n") > SMALL).select("band"), "band").select("id", "class").distinct(), "unsettled")
    n = ids.count()
    if n:
        texts = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
        texts = texts.join(F.broadcast(ids) if n <= BROADCAST_IDS // 2 else ids, "id")
        texts = written(texts, "unsettled-texts")
        keys, counts = _counted(texts.select("text"), 1, _COUNTER)
        common = np.zeros(1 << (32 - int(_COUNTER_SHIFT)), dtype=np.uint32)
        common[keys >> _COUNTER_SHIFT] = counts
        pairs = pairs.unionByName(_by_rare_shingles(_rare(texts, frequent, spark.sparkContext.broadcast(common))))
    pairs = pairs.distinct()
    for before in tried:
        pairs = pairs.join(before, ["a", "b"], "left_anti")
    return pairs


# --- components -------------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(id, class) of each linked id, where class is the least id reachable, by alternating large and small stars."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        out = out.where("u != v")
        return out if large else out.distinct()  # the small star that follows takes repeated edges as one

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    while True:
        edges = written(star(star(edges, True), False), "stars")
        # Stars: every end has one centre and no centre is an end. Then each component is one star, with its least id as centre.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("ends"), F.lit(0).alias("centre"))
        roles = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("ends"), F.lit(1).alias("centre")))
        roles = roles.groupBy("x").agg(F.sum("ends").alias("ends"), F.max("centre").alias("centre"))
        if roles.where("ends > 1 or ends = 1 and centre = 1").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("class")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct()
            )


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``class_id``, the least id among its near-duplicates.

    Texts of fewer than five words have one shingle, all their words. Texts without words are alike if they are equal;
    a null text counts as empty. Rows of one id are one document. A row with a null id is no one's duplicate and its
    class is null. An empty table gives an empty result; other columns don't matter, whatever their names.
    """
    spark: SparkSession = docs.sparkSession
    source = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("body"))
    n_docs = source.count()
    frequent = spark.sparkContext.broadcast(_frequencies(source.select(F.col("body").cast("string").alias("text")), n_docs))
    signed = written(signatures(source, frequent, "doc", "body"), "signatures")
    bands = [F.first(f"b{i}", ignorenulls=True).alias(f"b{i}") for i in range(BANDS)]
    texts = written(signed.where("id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("weight").alias("weight"), *bands), "texts")
    banded = texts.where("b0 is not null").select("id", "weight", F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("band"))
    found: DataFrame | None = None
    joined: DataFrame | None = None
    idle = False
    tried: list[DataFrame] = []
    for round_ in range(ROUNDS + 1):
        last = round_ == ROUNDS
        if not last and round_ > 1 and idle:
            continue
        pairs = _rest(banded, joined, tried, source, frequent, "doc", "body") if last else _pairs(banded, joined, round_)
        pairs = written(pairs, "pairs")
        idle = pairs.isEmpty()
        if idle:
            continue
        tried.append(pairs)
        fresh = written(_verified(pairs, source, frequent, "doc", "body"), "links")
        idle = fresh.isEmpty()
        if idle:
            continue
        found = fresh if joined is None else written(fresh.select("a", "b").unionByName(joined.select(F.col("id").alias("a"), F.col("class").alias("b"))), "links")
        joined = components(found)
    own = texts.select("digest", "id")
    if joined is not None:
        own = own.join(joined, "id", "left").select("digest", F.coalesce("class", "id").alias("class"))
    else:
        own = own.withColumnRenamed("id", "class")
    result = signed.select("id", "digest").join(own, "digest", "left")
    kind: Column = F.col("id").cast(docs.schema[id_column].dataType)
    return result.select(kind.alias(id_column), F.when(F.col("id").isNotNull(), F.col("class")).alias("class_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the document with the least id, all columns as they are.

    Of repeated rows of that id one stays. Rows with a null id stay.
    """
    known = written(classes(docs, id_column, text_column).where(F.col(id_column).isNotNull()), "classes")
    key = F.col(id_column)
    lost = known.where("{0} != class_id".format(f"`{id_column}`")).select(F.col(id_column).cast("long").alias("_id")).distinct()
    repeated = known.where(f"`{id_column}` = class_id").groupBy(F.col(id_column).cast("long").alias("_id")).count().where("count > 1").select("_id")
    hint = (lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df)
    lost, repeated = written(lost, "lost"), written(repeated, "repeated")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.cast("long").alias("_id"))
    kept = row.join(hint(lost), "_id", "left_anti")
    if not repeated.isEmpty():
        once = kept.join(hint(repeated), "_id", "left_semi").groupBy("_id").agg(F.first("row").alias("row"))
        kept = kept.join(hint(repeated), "_id", "left_anti").select("_id", "row").unionByName(once.select("_id", "row"))
    return kept.select("row.*")
