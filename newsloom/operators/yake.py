"""YAKE keywords (Campos et al. 2020): statistical features of words inside one text, lower scores are better."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import SENTENCE_BREAK
from newsloom.operators.terms import STOP, spread
from newsloom.session import map_arrow

DEDUP_LIMIT = 0.9
POOL = 20
#: Bytes of text whose words are counted together.
AT_ONCE = 1 << 20


def marked(text: Column) -> Column:
    """A text with ``|`` for punctuation between its words and ``.`` for the ends of its sentences."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N} .!?\n]+", " | "), SENTENCE_BREAK, " . ")


def _distinct(*parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct tuples of whole numbers in ascending order, and the place of every given tuple among them."""
    sizes = [int(p.max(initial=0)) + 1 for p in parts[1:]]
    code = parts[0].astype(np.int64)
    for part, size in zip(parts[1:], sizes):
        code = code * size + part
    code, place = np.unique(code, return_inverse=True)
    found = []
    for size in reversed(sizes):
        code, last = np.divmod(code, size)
        found.append(last)
    return code, *reversed(found), place


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, ...]:
    """Words of marked texts: spellings, then per word its spelling, text, sentence and whether the next one adjoins.

    Sentences without a word are not counted; they are numbered through all texts.
    """
    cut = pc.ascii_split_whitespace(texts)
    coded = cut.flatten().dictionary_encode()
    spellings, code = coded.dictionary, coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy())
    is_empty, is_end, is_mark = (pc.equal(spellings, c).to_numpy(False) for c in ("", ".", "|"))
    some = ~is_empty[code]
    code, text = code[some], text[some]
    starts = np.diff(text, prepend=-1) != 0
    at = np.flatnonzero(~(is_end | is_mark)[code])
    _, sentence = np.unique(np.cumsum(is_end[code] | starts)[at], return_inverse=True)
    adjoins = (np.diff(at, append=-1) == 1) & (np.diff(text[at], append=-1) == 0)
    return spellings, code[at], text[at], sentence, adjoins


def score_texts(texts: pa.Array, key: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Candidates of marked texts as (key, keyword, tf, score), by ascending keys, which are numbers, and best first.

    A word's score has its casing, position, frequency, neighbourhood and spread. Texts of one key count as one text.
    """
    spellings, spelling, text, sentence, adjoins = _words(texts)
    lower = pa.array([w.lower() for w in spellings.to_pylist()], pa.string()).dictionary_encode()
    words = lower.dictionary
    usable = pc.and_(pc.greater_equal(pc.utf8_length(words), 3), pc.match_substring_regex(words, r"\p{L}"))
    usable = pc.and_not(usable, pc.is_in(words, pa.array(STOP))).to_numpy(False)
    acronym, capital = (pc.match_substring_regex(spellings, p).to_numpy(False)[spelling] for p in (r"^\p{Lu}{2,}$", r"^\p{Lu}"))
    capital &= np.diff(sentence, prepend=-1) == 0
    # One row per word of a key: its counts.
    doc, word, at = _distinct(key[text], lower.indices.to_numpy()[spelling])
    size = len(doc)
    tf = np.bincount(at, minlength=size)
    case = np.maximum(*(np.bincount(at[f], minlength=size) for f in (acronym, capital))) / (1 + np.log(tf))
    # Sentences are numbered within their text, and texts of one key share those with equal numbers of equally long texts.
    in_text = np.bincount(text, minlength=len(texts))
    first_word = np.cumsum(in_text) - in_text
    number = sentence - sentence[first_word[text]] if size else sentence
    last = np.where(in_text > 0, first_word + in_text - 1, 0)
    n_sentences = number[last[text]] + 1 if size else number
    of_word, found_in, out_of, _ = _distinct(at, number, n_sentences)
    places = np.bincount(of_word, minlength=size)
    start = np.cumsum(places) - places
    median = (found_in[start + (places - 1) // 2] + found_in[start + places // 2]) / 2
    diff = places / np.maximum.reduceat(out_of, start) if size else median
    left, right, pair = _distinct(at[:-1][adjoins[:-1]], at[1:][adjoins[:-1]])
    n = np.bincount(pair, minlength=len(left))
    diversity = sum(np.bincount(s, minlength=size) / np.maximum(np.bincount(s, n, size), 1) for s in (left, right))
    # Figures of all words of a key.
    n_docs, good = int(key.max(initial=-1)) + 1, usable[word]
    most = np.zeros(n_docs, np.int64)
    np.maximum.at(most, doc, tf)
    count, total, squares = (np.bincount(doc[good], w, n_docs) for w in (None, tf[good], tf[good] * tf[good]))
    count = np.maximum(count, 1)
    usual = total / count + np.sqrt(np.maximum((squares - total * total / count) / count, 0.0))
    rel = 1 + diversity * (tf / most[doc])
    with np.errstate(divide="ignore"):
        freq = tf / usual[doc]  # infinite for keys without a usable word, which have no candidates
    score = np.log(np.log(3 + median)) * rel / (case + freq / rel + diff / rel)
    kept = good[left] & good[right]
    left, right, n = left[kept], right[kept], n[kept]
    both = pc.binary_join_element_wise(words.take(pa.array(word[left])), words.take(pa.array(word[right])), " ")
    one, a, b = score[good], score[left], score[right]
    scores = np.concatenate([one / (tf[good] * (1 + one)), a * b / (n * (1 + a + b))])
    doc = np.concatenate([doc[good], doc[left]])
    keyword = pa.concat_arrays([words.take(pa.array(word[good])), both])
    keys = pa.table({"doc": doc, "rounded": np.round(scores, 8), "keyword": keyword})
    order = pc.sort_indices(keys, [(name, "ascending") for name in keys.column_names])
    at = order.to_numpy()
    return doc[at], keyword.take(order), np.concatenate([tf[good], n])[at], scores[at]


def _score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, texts) to (key, found); so many keys at once that their texts come to about ``AT_ONCE`` bytes."""
    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())])
        lengths = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(1).flatten()).to_numpy())])
        _, begins = np.unique(lengths[ends[:-1]] // AT_ONCE, return_index=True)
        for begin, end in zip(begins, [*begins[1:], batch.num_rows]):
            part = batch.slice(begin, end - begin)
            row = np.repeat(np.arange(part.num_rows), np.diff(ends[begin : end + 1]))
            doc, keyword, tf, score = score_texts(part.column(1).flatten(), row)
            entries = pa.StructArray.from_arrays([keyword, pa.array(tf, pa.int64()), pa.array(score)], ["keyword", "tf", "score"])
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([part.column(0), found], [part.schema.names[0], "found"])


def scored(docs: DataFrame, key: str, text: str) -> DataFrame:
    """All candidates of each text in one array, best first: (key, found). Each text is cut into words once, and words never move.

    The words of a text are some hundred rows; counted in Arrow batches they cost a fraction of what rows do.
    """
    texts = spread(docs, key, text).select(key, marked(F.col("text")).alias("text")).groupBy(key).agg(F.collect_list("text").alias("texts"))
    kind = texts.schema[key].dataType.simpleString()
    return map_arrow(texts, _score_batches, f"`{key}` {kind}, found array<struct<keyword: string, tf: bigint, score: double>>")


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every one- and two-word candidate of each text: (key, keyword, tf, score)."""
    return scored(docs, key, text).select(key, F.inline("found"))


def _similar(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def distinct_enough(ordered: Column, limit: float = DEDUP_LIMIT, pool: int = POOL) -> Column:
    """Walk candidates from best to worst and keep those unlike all kept so far, until ``pool`` are kept."""

    def step(kept: Column, candidate: Column) -> Column:
        repeat = F.exists(kept, lambda k: _similar(k["keyword"], candidate["keyword"]) > limit)
        return F.when((F.size(kept) >= pool) | repeat, kept).otherwise(F.concat(kept, F.array(candidate)))

    empty = F.slice(ordered, 1, 0)
    return F.aggregate(ordered, empty, step)


def _rows(lists: DataFrame, key: str, entries: Column) -> DataFrame:
    return lists.select(key, F.posexplode(entries).alias("at", "k")).select(
        key, (F.col("at") + 1).cast("long").alias("rank"), F.col("k.keyword").alias("keyword"), F.col("k.score").alias("score")
    )


def yake(docs: DataFrame, key: str, text: str, n: int = 10) -> DataFrame:
    """Best ``n`` keywords per text after near-duplicates are dropped: (key, rank, keyword, score).

    The candidates of one text meet in one array, which is never larger than the text they come from.
    """
    pool = max(POOL, n)
    # The first few candidates mostly fill the pool; the walk over all of them is for the other texts.
    first = scored(docs, key, text).withColumn("first", distinct_enough(F.slice("found", 1, 3 * pool), pool=pool))
    is_full = F.size("first") >= pool
    pools = first.select(key, F.when(is_full, F.col("first")).otherwise(distinct_enough(F.col("found"), pool=pool)).alias("kept"))
    return _rows(pools, key, F.slice("kept", 1, n))


def best_candidates(docs: DataFrame, key: str, text: str, n: int = POOL) -> DataFrame:
    """Best ``n`` candidates per text before near-duplicates are dropped: (key, rank, keyword, score)."""
    return _rows(scored(docs, key, text), key, F.slice("found", 1, n))
