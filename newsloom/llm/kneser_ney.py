"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted arrays, memory-mapped for scoring.

Counting is three rounds of map, shuffle and merge. Tasks cut words in arrays, add up equal keys and send what is left
in blocks, one for each shard, so that a frequent word weighs no more than any other; shards follow from the corpus'
own counts. The merged shards are sorted arrays in the shared folder:

- ``words``: 64-bit word hashes in ascending order, cut by their leading bits, with counts; a word's id is its place;
- ``pairs``: (id of the word before, id of the word) as one 64-bit number, cut by a hash of it, with counts;
- ``stats``: for each id, what follows it (total, distinct followers seen once, twice, more) and how many words it follows.

Scoring tasks map these files and look words and pairs up by binary search: memory follows the batch, not the model.
The order is 2: the keys of longer orders don't fit the disk that the checks allow (README).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrays import Words, batches_of, mix, words
from newsloom.llm.blocks import BLOCKS, add_up, as_batch, blocks, merge, unpack_block
from newsloom.llm.shared import free_name, map_arrow, mapped, new_folder, put, written

#: The hash of the end that closes each text; no word's hash is known to be equal.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Keys of a shard of the model, about.
SHARD_WORDS, SHARD_PAIRS = 1 << 19, 1 << 20
#: Pairs that a task holds before it sends them.
BUFFER = 1 << 21
_LOW = np.uint64(0xFFFFFFFF)


# --- the model --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that go with them."""

    folder: str
    tokens: int
    word_shards: int
    word_bits: int
    offsets: tuple[int, ...]
    pair_shards: int
    stat_size: int
    kinds: int  # distinct pairs
    lower: tuple[float, float, float]
    upper: tuple[float, float, float]
    lower_ones: tuple[int, int, int]  # words that follow one, two, more words

    @property
    def distinct(self) -> int:
        return self.offsets[-1]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more. Without counts to go by: half, one, one and a half."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.0), float(i)) for i, d in enumerate(found, 1))


def with_end(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a batch, each text closed by its end, and where each text begins."""
    rows = len(w.first) - 1
    first = w.first + np.arange(rows + 1)
    out = np.empty(int(first[-1]), dtype=np.uint64)
    ends = first[1:] - 1
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside] = w.hashes
    out[ends] = END
    return out, first


def _word_shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


class _Files:
    """The mapped files of a model, opened when first needed."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._open: dict[tuple[str, int], np.ndarray] = {}

    def get(self, name: str, shard: int, dtype: type) -> np.ndarray:
        key = (name, shard)
        if key not in self._open:
            if len(self._open) > 4096:
                self._open.clear()
            self._open[key] = mapped(f"{self.model.folder}/{name}-{shard}", dtype)
        return self._open[key]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (0: unknown) and counts of word hashes in ascending order."""
        ids, counts = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        m = self.model
        if not m.distinct:
            return ids, counts
        shard = _word_shard(hashes, m.word_bits)
        for s in np.unique(shard).tolist():
            at = np.arange(*np.searchsorted(shard, [s, s + 1]))
            held = self.get("words", s, np.uint64)
            if len(held):
                place = np.minimum(np.searchsorted(held, hashes[at]), len(held) - 1)
                hit = held[place] == hashes[at]
                ids[at[hit]] = m.offsets[s] + place[hit] + 1
                counts[at[hit]] = self.get("counts", s, np.int64)[place[hit]]
        return ids, counts

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of pair keys in ascending order."""
        out = np.zeros(len(keys), np.int64)
        shard = _pair_shard(keys, self.model.pair_shards)
        order = np.argsort(shard, kind="stable")
        ids, first = np.unique(shard[order], return_index=True)
        for s, a, b in zip(ids.tolist(), first, [*first[1:], len(order)]):
            at = order[a:b]
            held = self.get("pairs", s, np.uint64)
            if len(held):
                place = np.minimum(np.searchsorted(held, keys[at]), len(held) - 1)
                hit = held[place] == keys[at]
                out[at[hit]] = self.get("seen", s, np.uint32)[place[hit]]
        return out

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """Rows (total, once, twice, more, follows) of ids in ascending order."""
        out = np.zeros((len(ids), 5), np.int64)
        size = self.model.stat_size
        part = ids // size
        for s in np.unique(part).tolist():
            at = np.arange(*np.searchsorted(part, [s, s + 1]))
            held = self.get("stats", s, np.int64).reshape(-1, 5)
            if len(held):
                out[at] = held[ids[at] - s * size]
        return out


def _pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys) % np.uint64(shards)).astype(np.int64)


@lru_cache(maxsize=2)
def _files(model: Model) -> _Files:
    return _Files(model)


def _word_ids(files: _Files, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(hashes, return_inverse=True)
    ids, counts = files.ids(distinct)
    return ids[back], counts[back]


def _pair_keys(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each token after the one before it in its text; before a text stands 0, and so does an unknown word."""
    before = np.zeros(len(ids), dtype=np.uint64)
    before[1:] = ids[:-1].astype(np.uint64)
    before[first[:-1]] = 0
    return (before << np.uint64(32)) | ids.astype(np.uint64)


def fit(docs: DataFrame, text_column: str = "text") -> Model:
    """Count all texts of ``docs`` and write the model to the shared folder.

    Null and empty texts count as their end alone; without rows the model gives each token the same probability.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_column).cast("string").alias("text"))
    folder = new_folder(spark, "kneser-ney")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # Words: task sums, then sums by hash.
    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, n = add_up(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            return as_batch(list(blocks((keys >> np.uint64(48)).astype(np.int64) % width, keys, n)))

        for batch in batches:
            for a, b in batches_of(batch.column(0), 1 << 21):
                held.append(add_up(with_end(words(batch.column(0).slice(a, b - a)))[0]))
            if sum(len(k) for k, _ in held) > BUFFER:
                yield out()
        if held:
            yield out()

    def sum_words(table: pa.Table) -> pa.Table:
        keys, n = merge(table.column("block").to_pylist())
        return pa.table({"hash": pa.array(keys.view(np.int64)), "n": pa.array(n)})

    counted = written(
        map_arrow(texts, count_words, BLOCKS).groupBy("shard").applyInArrow(sum_words, "hash long, n long"), "words"
    )
    size = counted.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    distinct, tokens = int(size["v"]), int(size["n"])
    if distinct >= 1 << 32:
        raise ValueError("ids of more than 4,294,967,295 distinct words don't fit a 64-bit pair")
    bits = max(0, (max(1, distinct) - 1).bit_length() - (SHARD_WORDS.bit_length() - 1))

    def store_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys = table.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        put(f"{folder}/words-{shard}", keys[order].tobytes())
        put(f"{folder}/counts-{shard}", table.column("n").to_numpy()[order].tobytes())
        return pa.table({"shard": pa.array([shard], pa.int32()), "size": pa.array([len(keys)], pa.int64())})

    shard = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)
    sizes = {
        r["shard"]: r["size"]
        for r in counted.withColumn("shard", shard)
        .groupBy("shard")
        .applyInArrow(store_words, "shard int, size long")
        .collect()  # one row for each shard
    }
    offsets = tuple(int(x) for x in np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(1 << bits)])]))
    pair_shards = max(width, tokens // SHARD_PAIRS + 1)
    stat_size = min(SHARD_WORDS, -(-(distinct + 1) // width))
    model = Model(folder, tokens, 1 << bits, bits, offsets, pair_shards, stat_size, 0, (0,) * 3, (0,) * 3, (0,) * 3)

    # Pairs: task sums in blocks, merged by shard into files; each shard reports on the words of its pairs.
    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, n = _files(model), [], 0
        for batch in batches:
            for a, b in batches_of(batch.column(0), 1 << 21):
                tokens_, first = with_end(words(batch.column(0).slice(a, b - a)))
                held.append(_pair_keys(_word_ids(files, tokens_)[0], first))
                n += len(tokens_)
            if n > BUFFER:
                keys, counts = add_up(np.concatenate(held))
                yield as_batch(list(blocks(_pair_shard(keys, pair_shards), keys, counts)))
                held, n = [], 0
        if n:
            keys, counts = add_up(np.concatenate(held))
            yield as_batch(list(blocks(_pair_shard(keys, pair_shards), keys, counts)))

    def store_pairs(table: pa.Table) -> pa.Table:
        shard_ = table.column("shard")[0].as_py()
        keys, counts = merge(table.column("block").to_pylist())
        put(f"{folder}/pairs-{shard_}", keys.tobytes())
        put(f"{folder}/seen-{shard_}", np.minimum(counts, 0xFFFFFFFF).astype(np.uint32).tobytes())
        rows = []
        before = keys >> np.uint64(32)
        told = [(0, before, counts), (4, *add_up(keys & _LOW))]
        told += [(k, before[x], None) for k, x in ((1, counts == 1), (2, counts == 2), (3, counts > 2))]
        for kind, ids, n in told:
            ids, n = add_up(ids, n)
            if len(ids):
                rows += blocks((ids // np.uint64(stat_size)).astype(np.int64), ids, n, kind)
        ones = np.array([len(keys), *[(counts == i).sum() for i in range(1, 5)]], dtype="<i8")
        rows.append((9, -1, ones.tobytes()))
        return pa.Table.from_batches([as_batch(rows)])

    told = written(
        map_arrow(texts, count_pairs, BLOCKS)
        .groupBy("shard")
        .applyInArrow(store_pairs, BLOCKS),
        "pairs",
    )

    def store_stats(table: pa.Table) -> pa.Table:
        part = table.column("shard")[0].as_py()
        out = np.zeros((stat_size, 5), np.int64)
        for kind, block in zip(table.column("kind").to_pylist(), table.column("block").to_pylist()):
            ids, n = unpack_block(block)
            out[ids.astype(np.int64) - part * stat_size, kind] += n
        put(f"{folder}/stats-{part}", out.tobytes())
        follows = out[:, 4]
        numbers = [int((follows == i).sum()) for i in range(1, 5)] + [int((follows > 2).sum())]
        return pa.table({"n": pa.array([numbers], pa.list_(pa.int64()))})

    summed = lambda rows, n: [sum(r[i] for r in rows) for i in range(n)]
    pairs = [np.frombuffer(r["block"], "<i8").tolist() for r in told.where("kind = 9").select("block").collect()]
    lower = [
        r["n"]
        for r in told.where("kind < 9").groupBy("shard").applyInArrow(store_stats, "n array<long>").collect()
    ]
    kinds, *upper = summed(pairs, 5)
    *ones, more = summed(lower, 5)
    found = asdict(model) | {
        "kinds": kinds,
        "upper": discounts(*upper),
        "lower": discounts(*ones),
        "lower_ones": (ones[0], ones[1], more),
    }
    put(f"{folder}/model.json", json.dumps(found).encode())
    return Model(**found)


# --- scoring ----------------------------------------------------------------------------------------------------------


def _off(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def log_probabilities(model: Model, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability after the one before it, and the token's count in training."""
    files = _files(model)
    ids, counts = _word_ids(files, hashes)
    keys = _pair_keys(ids, first)
    floor = 1.0 / (model.distinct + 1)
    kinds = max(model.kinds, 1)
    seen_ids, back = np.unique(ids, return_inverse=True)
    stats = files.stats(seen_ids) if model.tokens else np.zeros((len(seen_ids), 5), np.int64)
    follows = np.where(seen_ids > 0, stats[:, 4], 0)
    lower_rest = sum(d * n for d, n in zip(model.lower, model.lower_ones)) / kinds if model.kinds else 1.0
    lower = ((follows - _off(follows, model.lower)) / kinds + lower_rest * floor)[back]
    if not model.tokens:
        return np.log10(lower), counts
    at = np.searchsorted(seen_ids, (keys >> np.uint64(32)).astype(np.int64))
    start = np.zeros(len(ids), dtype=bool)
    start[first[:-1]] = True
    # What stands before: nothing (id 0 in the counts), a known word, or an unknown one, about which nothing is known.
    zero = files.stats(np.zeros(1, np.int64))[0]
    before = np.where(start[:, None], zero[None, :], stats[np.minimum(at, len(stats) - 1)])
    unknown = ~start & (keys >> np.uint64(32) == 0)
    before[unknown] = 0
    distinct, again = np.unique(keys, return_inverse=True)
    both = files.pairs(distinct)[again]
    both[unknown | (ids == 0)] = 0
    total = before[:, 0]
    rest = before[:, 1:4] @ np.array(model.upper)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (both - _off(both, model.upper) + rest * lower) / total
    return np.log10(np.where(total > 0, p, lower)), counts


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Score the whole texts; the other columns of ``docs`` are kept, one called like one of ``SCORES`` with an underscore behind it.

    A null or empty text is its end alone. Repeated rows get repeated, equal rows. An empty table gives an empty result.
    """
    kept = [f.name for f in docs.schema.fields if f.name != text_column]
    scores = [c.split()[0] for c in SCORES.split(", ")]
    named = [free_name(c, scores, kept) for c in kept]
    schema = ", ".join([f"`{new}` {docs.schema[c].dataType.simpleString()}" for new, c in zip(named, kept)] + [SCORES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column))
            for a, b in batches_of(texts, 1 << 21):
                hashes, first = with_end(words(texts.slice(a, b - a)))
                logs, counts = log_probabilities(model, hashes, first)
                base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.distinct + 1)))
                begin, n = first[:-1], np.diff(first)
                total = np.add.reduceat(logs, begin)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in kept]
                    + [
                        pa.array(n, pa.int64()),
                        pa.array(np.add.reduceat((counts > 0).astype(np.int64), begin)),
                        pa.array(np.full(len(n), model.tokens), pa.int64()),
                        pa.array(np.add.reduceat(base, begin)),
                        pa.array(total),
                        pa.array(10.0 ** np.minimum(-total / n, 300.0)),
                    ],
                    [*named, *scores],
                )

    return map_arrow(docs.withColumn(text_column, F.col(text_column).cast("string")), run, schema)


def held_out(id_column: Column) -> Column:
    """A tenth of the documents, by a checksum of the id; a null id is trained on."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 10 == 0, F.lit(False))
