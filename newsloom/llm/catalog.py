"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    chat,
    fingerprints,
    kneser_ney,
    language_id,
    main_text,
    neardup,
    packing,
    prefix_trie,
    quality,
    spelling,
    token_files,
    url_filter,
    viterbi,
)
from newsloom.llm.shared import new_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"), url_filter.fit(url_filter.labelled_seed(spark)))


@query
def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op3_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    # The address travels with the page's id, which need not be unique.
    keyed = pages.select(F.struct("page_id", "url").alias("page"), "html")
    texts = main_text.extract(keyed, main_text.fit(pages), "page")
    return texts.select(
        "page.page_id", "page.url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars")
    )


@query
def op4_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", kneser_ney.held_out(F.col("doc_id")).alias("held_out"), "text")
    model = kneser_ney.fit(docs.where("not held_out"))
    return kneser_ney.score(docs, model)


@query
def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(table(spark, sf, "documents")), quality.STANDARD)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"), "kept", "failed",
    )


@query
def op6_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text")
    decoded = viterbi.decode(viterbi.encode(docs, path), path)
    return decoded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("text", 256).eqNullSafe(F.col("text_sha256")).alias("round_trip")
    )


@query
def op7_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    nasty = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", nasty), (-1, 1, "assistant", nasty)], rows.schema)
    chain = chat.as_chain(rows.unionByName(extra), "conv_id", "turn").withColumnRenamed("_conversation", "conv_id")
    paths = chat.chosen_paths(written(chain, "chain"))
    return chat.digests(chat.format_paths(paths, ["tree", "path", "conv_id"]), "conv_id")


@query
def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    model = language_id.fit_text(table(spark, sf, "documents"))
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    keyed = pages.select(
        F.struct("page_id", "url", F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z-]+)", 1).alias("declared")).alias("page"), "html"
    )
    texts = main_text.extract(keyed, main_text.Weights(), "page")
    return language_id.identify(
        texts, model, [F.col("page.page_id").alias("page_id")], F.col("main_text"), F.col("page.declared"), F.col("page.url"),
        url_filter.host(F.col("page.url")),
    )


@query
def op9_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf, "documents"))


@query
def op10_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.classes(table(spark, sf, "documents"))


@query
def op11_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    token_files.write(table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.documents(token_files.read(spark, path))


@query
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf, "documents")))


@query
def op13_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(written(prefix_trie.sequences(table(spark, sf, "conversations")), "sequences")))


# White space between words, as RE2 wants it.
_SPACE = r"[ \t\n\x0B\f\r]"

ORACLE_SQL["op5_quality_rules"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l,
           length(text) - length(regexp_replace(text, '{_SPACE}', '', 'g')) AS spaces FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM a WHERE len(w) > 2),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
p AS (SELECT DISTINCT doc_id, i + d AS at FROM k, (VALUES (0), (1), (2)) AS v(d) WHERE n > 1),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM p GROUP BY doc_id),
m AS (
    SELECT a.doc_id, len(w)::BIGINT AS n_words, (length(text) - spaces)::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
           length(text) - length(regexp_replace(text, '[A-ZÀÂÄÇÉÈÊËÎÏÑÓÔÖÙÛÜÍÚÁ]', '', 'g')) AS n_upper,
           length(text) - length(replace(text, '!', '')) AS n_exclaimed
    FROM a LEFT JOIN r USING (doc_id)),
f AS (SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {quality.BITS[name]} ELSE 0 END" for name, rule in quality.RULES)} AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (bits & {quality.BASE.mask}) <> 0 AS base_failed, (bits & {quality.STANDARD.mask}) = 0 AS kept, bits::BIGINT AS failed
FROM f"""

_ESCAPED = r"""regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|<ROLE|</ROLE>>)', '\1\\\2\3', 'g')"""

ORACLE_SQL["op7_chat_formatting"] = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, {_ESCAPED} AS body FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length(body) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17 END))::BIGINT AS formatted_chars
FROM x GROUP BY conv_id"""


# CRC-32 by its table of 256 values; bytes of letters up to U+00FF in UTF-8.
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS t"""


def _crc32(text: str) -> str:
    """SQL for the checksum of a text of such letters; ``t`` is the table."""
    letters = f"string_split({text}, '')"
    utf8 = "CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [(192 + unicode(c) // 64)::UBIGINT, (128 + unicode(c) % 64)::UBIGINT] END"
    every = f"list_prepend(4294967295::UBIGINT, flatten(list_transform({letters}, lambda c: {utf8})))"
    return f"xor(4294967295::UBIGINT, list_reduce({every}, lambda a, b: xor(t[((xor(a, b) & 255) + 1)::BIGINT], a >> 8)))"


ORACLE_SQL["op12_spelling_variants"] = f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
r AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
    GROUP BY ALL HAVING length(run) >= 6),
h AS (SELECT run, k, {_crc32("doc_id || ':' || run")} AS h FROM r, tab),
e AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k
    FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
    SELECT x.word, y.word AS other FROM d x JOIN d y ON x.i = y.i AND x.less = y.less AND x.word <> y.word
    UNION SELECT d.word, w.word FROM d JOIN w ON d.less = w.word
    UNION SELECT w.word, d.word FROM d JOIN w ON d.less = w.word),
best AS (SELECT near.word, count(*) AS n_near, min((-o.n, o.word)) AS b FROM near JOIN w o ON near.other = o.word GROUP BY near.word),
f AS (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b[1] >= 5 * w.n THEN b[2] END AS form,
           CASE WHEN -b[1] >= 5 * w.n THEN -b[1] END::BIGINT AS form_n
    FROM w LEFT JOIN best USING (word)),
walk AS (
    SELECT word, word AS here, 0 AS step FROM f
    UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON walk.here = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, (SELECT arg_max(here, step) FROM walk WHERE walk.word = f.word) AS root, f.n, f.n_near, f.form_n FROM f"""

ORACLE_SQL["op13_conversation_trie"] = f"""
WITH tab AS ({_CRC_TABLE}),
own AS (
    SELECT conv_id, list(coalesce(role, '') || chr(0) || coalesce(text, '') ORDER BY turn NULLS FIRST, role, text) AS seq
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, seq, ({_crc32("conv_id::VARCHAR")} % 4)::BIGINT AS h FROM own, tab),
re AS (
    SELECT h.conv_id, list_concat(coalesce(o.seq, [])[1:h.h], h.seq[h.h + 1:]) AS seq
    FROM h LEFT JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 20),
pre AS (SELECT conv_id, d::BIGINT AS depth, seq[1:d] AS path, len(seq) = d AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM re)),
node AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
           CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(split_part(path[-1], chr(0), 2), '[^ \t\n\x0B\f\r]+')) END AS words
    FROM pre GROUP BY path, depth),
child AS (SELECT path[1:-2] AS path, count(*)::BIGINT AS n_children FROM node WHERE depth > 0 GROUP BY 1),
val AS (SELECT node.*, coalesce(n_children, 0)::BIGINT AS n_children, (n_convs - 1) * words AS saved FROM node LEFT JOIN child USING (path)),
above AS (SELECT conv_id, unnest(range(0, depth + 1)) AS up, path, n_children, saved FROM val),
total AS (
    SELECT path[1:up] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0)::BIGINT AS n_leaves FROM above GROUP BY 1)
SELECT val.conv_id, val.depth, p.conv_id AS parent_conv_id, val.n_convs, val.n_children, total.n_leaves, total.saved_tokens, val.ends_sha256
FROM val JOIN total USING (path) LEFT JOIN node p ON val.depth > 0 AND p.depth = val.depth - 1 AND p.path = val.path[1:-2]"""
