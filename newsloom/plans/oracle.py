"""DuckDB SQL with the results of the catalogue's queries, written independently of the Spark expressions.

DuckDB's regular expressions have neither look-around nor back-references, and the given tables hold only part of what
the functions accept, so the SQL covers the tables; the unit tests cover the rest.
"""

from __future__ import annotations

from newsloom.functions.html import BLOCK_TAGS, CODE_TAGS, NOISE_TAGS
from newsloom.functions.text import ACCENTED, PLAIN
from newsloom.functions.urls import TRACKING_PARAMS
from newsloom.operators.terms import STOP
from newsloom.operators.text_index import STEMS
from newsloom.operators.yake import DEDUP_LIMIT, POOL

WORD = r"[\p{L}\p{N}]+"
URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
NL = "chr(10)"
STOP_LIST = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
TRACKING_LIST = "(" + ", ".join(f"'{p}'" for p in TRACKING_PARAMS) + ")"


def sub(x: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({x}, '{pattern}', {to}, 'g')"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def clean_text(x: str) -> str:
    return strip(sub(sub(x, r"\n+", NL), " +", "' '"))


def decode(x: str) -> str:
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def without(x: str, tags: list[str]) -> str:
    for tag in tags:
        x = sub(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>")
    return x


def remove_code(x: str) -> str:
    return without(sub(x, "(?s)<!--.*?-->"), CODE_TAGS)


def clean_html(x: str) -> str:
    return without(x, NOISE_TAGS)


def text_nodes(x: str) -> str:
    return decode(sub(remove_code(x), "(?s)<[^>]*>", f"{NL} || {NL}"))


def main_block(x: str) -> str:
    free = remove_code(x)
    article = f"regexp_extract({free}, '(?is)<article\\b[^>]*>(.*?)</article\\b', 1)"
    return f"CASE WHEN regexp_matches({free}, '(?i)<article\\b') THEN {article} ELSE {body(free)} END"


def body(x: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({x}, '(?is)<body\\b[^>]*>(.*)', 1), ''), "
        f"{sub(x, '(?is)<head' + chr(92) + 'b.*?</head' + chr(92) + 's*>')})"
    )


def stripped(x: str) -> str:
    return strip(text_nodes(main_block(clean_html(x))))


def rendered(x: str) -> str:
    broken = sub(remove_code(x), rf"(?is)</?(?:{BLOCK_TAGS}|br)\b[^>]*>", NL)
    bare = sub(sub(broken, "(?s)<[^>]*>"), r"[ \t\r]+", "' '")
    return strip(sub(decode(bare), r" ?\n[ \n]*", NL))


def squeeze(x: str) -> str:
    bare = sub(sub(x, r"(?is)<br\b[^>]*>", "' '"), "(?s)<[^>]*>")
    return strip(sub(bare, r"[ \t\r\n]+", "' '"))


def density(x: str) -> str:
    marked = sub(body(remove_code(clean_html(x))), rf"(?is)(</?(?:{BLOCK_TAGS})\b[^>]*>)", r"chr(1) || '\1'")
    linked = r"array_to_string(regexp_extract_all(b, '(?is)<a\b[^>]*>(.*?)</a\s*>', 1), ' ')"
    kept = (
        f"list_filter(string_split({marked}, chr(1)), lambda b: NOT regexp_matches(b, '(?is)^<h[1-6]\\b') "
        f"AND length({squeeze('b')}) > 0 AND length({squeeze(linked)}) <= length({squeeze('b')}) * 0.5)"
    )
    return decode(f"array_to_string(list_transform({kept}, lambda b: {squeeze('b')}), {NL} || {NL})")


def title(x: str) -> str:
    return strip(decode(f"regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1)"))


def declared_language(x: str) -> str:
    return f"lower(regexp_extract({x}, '(?is)<html\\b[^>]*?\\slang\\s*=\\s*[\"'']?([A-Za-z]{{2}})', 1))"


def part(x: str, i: int) -> str:
    return f"regexp_extract({x}, '{URL_PARTS}', {i})"


def encode(x: str) -> str:
    return f"replace(url_encode(url_decode(replace({x}, '+', ' '))), '%20', '+')"


def normal(u: str) -> str:
    kept = (
        f"list_filter(string_split({part(u, 4)}, '&'), lambda x: regexp_matches(x, '=.') "
        f"AND split_part(x, '=', 1) NOT IN {TRACKING_LIST})"
    )
    pairs = f"list_transform({kept}, lambda x: {encode(_key)} || '=' || {encode(_value)})"
    query = f"coalesce('?' || nullif(array_to_string({pairs}, '&'), ''), '')"
    return (
        f"CASE WHEN {part(u, 2)} <> '' THEN lower({part(u, 1)}) || '://' || {part(u, 2)} || {part(u, 3)} || {query} END"
    )


_key = "split_part(x, '=', 1)"
_value = "substr(x, strpos(x, '=') + 1)"


def site(u: str) -> str:
    return f"{part(u, 1)} || '://' || {part(u, 2)}"


def domain(u: str) -> str:
    return f"regexp_replace({part(u, 2)}, '^www\\.', '')"


def display_domain(u: str) -> str:
    return f"regexp_replace(lower({part(u, 2)}), 'www\\.', '')"


def fold(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


def has_word(x: str, *wanted: str) -> str:
    return f"regexp_matches({x}, '(^|[^\\p{{L}}\\p{{N}}])({'|'.join(wanted)})([^\\p{{L}}\\p{{N}}]|$)')"


def fragments(x: str) -> str:
    parts = f"list_transform(string_split_regex({x}, '[^\\p{{L}}\\p{{N}} ]+'), lambda p: list_filter(string_split(p, ' '), lambda w: w <> ''))"
    return f"list_filter({parts}, lambda p: len(p) > 0)"


def content_terms(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{WORD}'), lambda w: length(w) >= 2 AND w NOT IN {STOP_LIST})"


DAY = "strftime(DATE '2024-06-30' - CAST(page_id % 400 AS INTEGER), '%Y-%m-%d')"

VIEW = f"""view AS (
    SELECT md5(url) AS _id, page_id, url, {title('html')} AS title,
           {clean_text(text_nodes(clean_html('html')))} AS content,
           {declared_language('html')} AS language, {domain('url')} AS source_domain, {DAY} AS publication_date
    FROM pages)"""

REQUESTS = """bare AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS b, url FROM pages),
requests AS (
    SELECT b || CASE WHEN contains(b, '?') THEN '&' ELSE '?' END || 'utm_source=mail' AS url FROM bare
    UNION ALL SELECT regexp_replace(url, '^[a-z]+://[^/]*', '') FROM pages
    UNION ALL SELECT regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/missing/' || page_id FROM pages)"""

KEYED = f"""keyed AS (
    SELECT {normal('url')} AS url, max(page_id) AS page_id, arg_max(html, page_id) AS html FROM pages GROUP BY 1)"""

LINKS = f"""hrefs AS (
    SELECT page_id, url, list_filter(regexp_extract_all({remove_code('html')}, '(?is)<a\\b[^>]*\\shref="([^"]*)"[^>]*>', 1),
                                     lambda h: h <> '') AS l FROM pages),
links AS (SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos FROM hrefs),
resolved AS (
    SELECT page_id, url, pos,
           CASE WHEN href LIKE '/%' THEN {site('url')} || href
                ELSE {site('url')} || regexp_replace({part('url', 3)}, '[^/]*$', '') || href END AS link FROM links)"""

PUBDATE = f"""CASE page_id % 5 WHEN 0 THEN {DAY} || 'T10:20:30Z' WHEN 1 THEN {DAY} WHEN 2 THEN {DAY} || ' 08:15'
              WHEN 3 THEN {DAY} || 'T07:00' END"""

IS_RECENT = f"page_id % 5 < 4 AND {DAY} >= '2024-01-02'"

SENTENCES = r"""list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda s: trim(s)),
                lambda s: regexp_matches(s, '[\p{L}\p{N}]+'))"""

DATE_PATTERNS = [
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%dT%H:%M",
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%B %d, %Y",
    "%d %B %Y", "%Y/%m/%d",
]


def _rank(select: str, source: str, order: str, n: int = 10) -> str:
    return f"""SELECT {select} FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {n}"""


RAKE = f"""phrases AS (
    SELECT doc_id, unnest(list_filter(list_transform(string_split(array_to_string(list_transform(
        string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}} ]+', ' | ', 'g'), ' +'),
        lambda w: CASE WHEN w IN {STOP_LIST} THEN '|' ELSE w END), ' '), '|'), lambda p: trim(p)), lambda p: p <> '')) AS keyword
    FROM documents WHERE text <> ''),
found AS (SELECT doc_id, keyword, count(*) AS times FROM phrases GROUP BY ALL),
parts AS (SELECT doc_id, keyword, times, len(string_split(keyword, ' ')) AS length, unnest(string_split(keyword, ' ')) AS word
          FROM found),
stats AS (SELECT doc_id, word, sum(times) AS freq, sum(times * length) AS degree FROM parts GROUP BY ALL),
scored AS (SELECT doc_id, keyword, sum(round(degree::DOUBLE * 1000000 / freq::DOUBLE)::BIGINT) AS points
           FROM parts JOIN stats USING (doc_id, word) GROUP BY ALL)"""

YAKE = f"""split AS (
    SELECT doc_id, list_filter(string_split_regex(text, '[.!?\\n]+'), lambda x: regexp_matches(x, '{WORD}')) AS ss
    FROM documents WHERE text <> ''),
sents AS (SELECT doc_id, len(ss) AS n_sentences, unnest(ss) AS body, generate_subscripts(ss, 1) - 1 AS sentence FROM split),
frags AS (SELECT doc_id, n_sentences, sentence, {fragments('body')} AS ps FROM sents),
pieces AS (SELECT doc_id, n_sentences, sentence, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS part_no FROM frags),
placed AS (SELECT *, unnest(p) AS token, generate_subscripts(p, 1) - 1 AS spot FROM pieces),
words AS (SELECT doc_id, n_sentences, sentence, part_no = 0 AND spot = 0 AS is_first, token, lower(token) AS word,
                 lower(p[spot]) AS before, lower(p[spot + 2]) AS after FROM placed),
marked AS (SELECT *, word NOT IN {STOP_LIST} AND length(word) >= 3 AND regexp_matches(word, '\\p{{L}}') AS ok,
                  coalesce(after NOT IN {STOP_LIST} AND length(after) >= 3 AND regexp_matches(after, '\\p{{L}}'), false) AS ok2
           FROM words),
stats AS (
    SELECT doc_id, word, any_value(ok) AS ok, max(n_sentences) AS n_sentences, count(*) AS tf,
           count(*) FILTER (WHERE regexp_matches(token, '^\\p{{Lu}}{{2,}}$')) AS tf_a,
           count(*) FILTER (WHERE regexp_matches(token, '^\\p{{Lu}}') AND NOT is_first) AS tf_c,
           count(DISTINCT sentence) AS places, median(DISTINCT sentence) AS med,
           count(before) AS nb, count(DISTINCT before) AS db, count(after) AS na, count(DISTINCT after) AS da
    FROM marked GROUP BY doc_id, word),
totals AS (SELECT doc_id, max(tf) AS max_tf, count(*) FILTER (WHERE ok) AS n, sum(tf) FILTER (WHERE ok)::DOUBLE AS s1,
                  sum(tf * tf) FILTER (WHERE ok)::DOUBLE AS s2 FROM stats GROUP BY doc_id),
feats AS (
    SELECT doc_id, word, greatest(tf_a, tf_c)::DOUBLE / (1 + ln(tf)) AS w_case, ln(ln(3 + med)) AS w_pos,
           tf / (s1 / n + sqrt(greatest((s2 - s1 * s1 / n) / n, 0))) AS w_freq,
           1 + (coalesce(db::DOUBLE / nullif(nb, 0), 0) + coalesce(da::DOUBLE / nullif(na, 0), 0)) * (tf::DOUBLE / max_tf) AS w_rel,
           places::DOUBLE / n_sentences AS w_diff
    FROM stats JOIN totals USING (doc_id) WHERE ok),
ws AS (SELECT doc_id, word, w_pos * w_rel / (w_case + w_freq / w_rel + w_diff / w_rel) AS s FROM feats),
cands AS (
    SELECT doc_id, word AS l, NULL AS r, count(*) AS tf FROM marked WHERE ok GROUP BY ALL
    UNION ALL SELECT doc_id, word, after, count(*) FROM marked WHERE ok AND ok2 GROUP BY ALL),
scored AS (
    SELECT c.doc_id, concat_ws(' ', c.l, c.r) AS keyword,
           a.s * coalesce(b.s, 1) / (c.tf * (1 + a.s + coalesce(b.s, 0))) AS score
    FROM cands c JOIN ws a ON c.doc_id = a.doc_id AND c.l = a.word
                 LEFT JOIN ws b ON c.doc_id = b.doc_id AND c.r = b.word)"""

#: Tables that tell the language of ``source(doc_id, lang, text, train)`` by a model of its rows for training.
LANGUAGE = r"""spelled AS (
    SELECT doc_id, lang, train, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM source),
uses AS (SELECT doc_id, lang, train, word, count(*) AS n FROM spelled GROUP BY ALL),
vocab AS (SELECT word, regexp_extract_all(word, '(?s).') AS c, regexp_extract_all('_' || word || '_', '(?s).') AS p
          FROM (SELECT DISTINCT word FROM uses)),
cut AS (
    SELECT word, unnest(list_concat(c, list_transform(range(1, len(p)), lambda i: p[i] || p[i + 1]),
                  list_transform(range(1, len(p) - 1), lambda i: p[i] || p[i + 1] || p[i + 2]))) AS gram FROM vocab),
cut_counts AS (SELECT word, gram, count(*) AS k FROM cut GROUP BY ALL),
lang_words AS (SELECT lang, word, sum(n) AS n FROM uses WHERE lang IS NOT NULL AND train GROUP BY ALL),
counts AS (SELECT lang, gram, sum(n * k) AS n FROM lang_words JOIN cut_counts USING (word) GROUP BY ALL),
chosen AS (SELECT DISTINCT gram FROM (
    SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM counts) WHERE r <= 1000),
totals AS (SELECT lang, sum(n) AS total FROM counts JOIN chosen USING (gram) GROUP BY lang),
model AS (
    SELECT t.lang AS l, c.gram,
           round(ln((coalesce(k.n, 0) + 1)::DOUBLE / (t.total + (SELECT count(*) FROM chosen))::DOUBLE) * 1000000)::BIGINT AS p
    FROM totals t CROSS JOIN chosen c LEFT JOIN counts k ON k.lang = t.lang AND k.gram = c.gram),
word_scores AS (SELECT word, l, sum(k * p) AS p FROM cut_counts JOIN model USING (gram) GROUP BY ALL),
doc_scores AS (SELECT doc_id, l, sum(n * p) AS p FROM uses JOIN word_scores USING (word) GROUP BY ALL),
best AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, l) AS r FROM doc_scores)"""


def stemmed(term: str, language: str | None = None) -> str:
    """SQL for a term without its language's ending; ``language`` fixes the language, which else is the column ``language``."""
    cases = []
    for code, rules in STEMS.items():
        if language in (None, code):
            steps = " ".join(
                f"WHEN regexp_matches({term}, '{pattern}') THEN regexp_replace({term}, '{pattern}', '{kept.replace('$1', chr(92) + '1')}')" for pattern, kept in rules
            )
            cases.append(f"WHEN {f'language = {code!r}' if language is None else 'true'} THEN CASE {steps} ELSE {term} END")
    return f"CASE {' '.join(cases)} ELSE {term} END"


POSITIONS = f"""each_field AS (SELECT _id, language, 'title' AS field, title AS t FROM view UNION ALL SELECT _id, language, 'content', content FROM view),
    cut_words AS (SELECT _id, language, field, unnest(w) AS word, unnest(range(len(w))) AS place
                  FROM (SELECT *, regexp_extract_all({fold('t')}, '{WORD}') AS w FROM each_field)),
    placed AS (SELECT _id, field, place, {stemmed('word')} AS term FROM cut_words)"""


def oracle_queries() -> dict[str, str]:
    from newsloom.plans.catalog import SEARCH_WORDS

    q: dict[str, str] = {}
    q["url_normalize"] = f"SELECT page_id, {normal('url')} AS url_normalized FROM pages"
    q["url_resolve"] = f"WITH {LINKS} SELECT page_id, pos, link FROM resolved"
    image = f"{site('n')} || '/img/' || page_id || '.png'"
    thumb = f"{site('n')} || regexp_replace(nullif({part('n', 3)}, ''), '[^/]*$', '') || 'thumb.png'"
    pictures = f"{image} || '|' || coalesce({thumb}, {site('n')} || '/thumb.png')"
    q["image_url_list"] = f"SELECT page_id, {pictures} AS image_urls FROM (SELECT page_id, url AS n FROM pages)"
    q["extract_domain"] = f"SELECT page_id, {domain('url')} AS source_domain FROM pages"
    q["article_id"] = "SELECT page_id, md5(url) AS _id FROM pages"
    invalid = "SELECT url, 'Error: Invalid URL: ' || url AS error, 'scrape' AS stage FROM requests WHERE NOT regexp_matches(url, '^[a-z]+://[^/?#]')"
    q["invalid_urls"] = f"WITH {REQUESTS} {invalid}"
    q["url_list_parse"] = "SELECT unnest([url, url || '?again']) AS url FROM pages"

    shape = "CASE o_orderkey % 15 " + " ".join(
        f"WHEN {i} THEN strftime(o_orderdate, '{p}')" for i, p in enumerate(DATE_PATTERNS)
    ) + " END"
    listed = ", ".join(f"'{p}'" for p in DATE_PATTERNS)
    q["parse_date"] = f"""WITH d AS (SELECT o_orderkey, {shape} AS publication_date FROM orders)
        SELECT o_orderkey, publication_date, try_strptime(publication_date, [{listed}]) AS parsed FROM d"""
    q["iso_render"] = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
        CASE WHEN microsecond(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END AS ts_iso FROM events"""
    q["recency_filter"] = f"WITH {VIEW} SELECT _id, publication_date FROM view WHERE publication_date >= '2024-01-02'"
    q["clean_text"] = f"SELECT doc_id, {clean_text('text')} AS cleaned FROM documents"
    q["model_input"] = f"""WITH {VIEW} SELECT _id, substr('summarize: ' || content, 1, 512) AS summary_input,
        substr(concat_ws(' ', title, content), 1, 512) AS classifier_input FROM view"""

    columns = {
        "extract_title": title("html"),
        "clean_html": clean_html("html"),
        "extract_text": clean_text(text_nodes("html")),
        "extract_main_text": stripped("html"),
        "extract_selector": rendered(main_block("html")),
        "extract_blocks": density("html"),
        "pubdate_extract": PUBDATE,
        "logo_extract": """CASE page_id % 4 WHEN 0 THEN '/favicon-' || page_id || '.png'
            WHEN 1 THEN 'https://cdn.example.com/' || page_id || '.png' WHEN 2 THEN '/og/' || page_id || '.jpg' END""",
        "image_extract": """'/img/' || page_id || '.png?utm_source=x' ||
            CASE WHEN page_id % 200 > 100 THEN '|thumb.png' ELSE '' END""",
    }
    for name, expression in columns.items():
        q[name] = f"SELECT page_id, {expression} AS value FROM pages"

    cascade = "CASE WHEN d <> '' THEN d WHEN s <> '' THEN s WHEN r <> '' THEN r END"
    strategy = "CASE WHEN d <> '' THEN 'paragraph_density' WHEN s <> '' THEN 'tag_strip' WHEN r <> '' THEN 'selector' END"
    texts = f"{density('html')} AS d, {stripped('html')} AS s, {rendered(main_block('html'))} AS r"
    q["extract_cascade"] = f"""WITH source AS (SELECT page_id, 0 AS kind, html FROM pages
            UNION ALL SELECT page_id, 1, '<html><body><article><h1><a href=''/''>' || {title('html')} || '</a></h1></article></body></html>' FROM pages
            UNION ALL SELECT page_id, 2, regexp_extract(html, '(?is)(<script\\b[^>]*>.*?</script>)', 1) FROM pages),
        tried AS (SELECT page_id, kind, {texts} FROM source)
        SELECT page_id, kind::BIGINT AS kind, {strategy} AS strategy, {cascade} AS content FROM tried"""
    q["logo_fallback"] = f"""WITH s AS (SELECT page_id, {site('url')} AS site,
            CASE page_id % 4 WHEN 0 THEN '/favicon-' || page_id || '.png'
            WHEN 1 THEN 'https://cdn.example.com/' || page_id || '.png' WHEN 2 THEN '/og/' || page_id || '.jpg' END AS logo
            FROM pages),
        roots AS (SELECT site, arg_max(logo, page_id) FILTER (WHERE logo IS NOT NULL) AS logo FROM s GROUP BY site)
        SELECT page_id, CASE WHEN s.site LIKE 'https:%' THEN s.site || '/favicon.ico' ELSE roots.logo END AS logo_url
        FROM s JOIN roots USING (site)"""
    q["page_lookup"] = f"""WITH {REQUESTS}, {KEYED}, keys AS (
            SELECT DISTINCT {normal('url')} AS url FROM requests)
        SELECT keys.url, page_id, page_id IS NOT NULL AS found FROM keys LEFT JOIN keyed USING (url) WHERE keys.url IS NOT NULL"""
    q["listing_fanout"] = f"""WITH {LINKS},
        firsts AS (SELECT page_id, link, min(pos) AS pos FROM resolved GROUP BY ALL),
        ranked AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos,
                   count(*) OVER (PARTITION BY page_id) AS n FROM firsts)
        SELECT page_id, true AS is_listing, pos, link AS url FROM ranked WHERE n > 1 AND pos < 10
        UNION ALL SELECT page_id, false, 0, {normal('url')} FROM pages
        WHERE page_id NOT IN (SELECT page_id FROM ranked WHERE n > 1)"""

    q["upsert_articles"] = """SELECT _id, ts, event_id, event_type, value, props FROM (
        SELECT md5(CAST(user_id AS VARCHAR)) AS _id, *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
        FROM events) WHERE r = 1"""
    q["upsert_fields"] = """WITH w AS (SELECT md5(CAST(user_id AS VARCHAR)) AS _id, *, event_type = 'click' AS c FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY _id, c ORDER BY ts DESC, event_id DESC) AS n FROM w),
        ids AS (SELECT DISTINCT _id FROM w)
        SELECT ids._id, o.event_type, o.value, k.props FROM ids
        LEFT JOIN r o ON o._id = ids._id AND NOT o.c AND o.n = 1 LEFT JOIN r k ON k._id = ids._id AND k.c AND k.n = 1"""
    q["get_by_id"] = f"WITH {VIEW} SELECT _id, url, title FROM view WHERE _id = (SELECT min(md5(url)) FROM pages)"
    q["get_by_url"] = f"WITH {VIEW} SELECT _id, url, title FROM view WHERE url = (SELECT max(url) FROM pages)"
    q["recent_articles"] = f"""WITH {VIEW} SELECT _id, publication_date, title FROM view
        WHERE publication_date >= '2024-01-02T00:00:00' ORDER BY publication_date DESC, _id LIMIT 100"""
    q["recent_articles_ts"] = f"""WITH {VIEW} SELECT _id, CAST(publication_date AS TIMESTAMP) AS published_ts, title FROM view
        WHERE CAST(publication_date AS TIMESTAMP) >= TIMESTAMP '2024-01-02' ORDER BY published_ts DESC, _id LIMIT 100"""
    folded = fold("title || chr(10) || content")
    words = [w for w in fold_words(SEARCH_WORDS) if w not in STOP]
    q["text_search"] = f"""WITH {VIEW}, f AS (SELECT _id, title, {folded} AS t FROM view)
        SELECT _id, title FROM f WHERE {has_word('t', 'thea')} AND contains(t, 'on the') AND NOT {has_word('t', 'spam')}
        ORDER BY _id LIMIT 10 OFFSET 5"""
    q["text_search_index"] = f"""WITH {VIEW}, f AS (SELECT _id, title, {folded} AS t FROM view)
        SELECT _id, title FROM f WHERE {has_word('t', *words)}"""
    q["search_meta"] = f"""WITH {VIEW}, f AS (SELECT {folded} AS t FROM view), n AS (
            SELECT count(*) AS total FROM f WHERE {has_word('t', *words)})
        SELECT total, CAST(3 AS BIGINT) AS page, CAST(ceil(total / 10) AS BIGINT) AS total_pages FROM n"""
    q["search_deep_page"] = f"""WITH {VIEW}, f AS (SELECT _id, title, {folded} AS t FROM view)
        SELECT _id, title FROM f WHERE {has_word('t', *words)} ORDER BY _id LIMIT 10 OFFSET 30"""
    q["search_after"] = f"""WITH {VIEW}, f AS (SELECT _id, title, {folded} AS t FROM view)
        SELECT _id, title FROM f WHERE {has_word('t', *words)} AND _id > '8' ORDER BY _id LIMIT 10"""
    q["index_positions"] = f"""WITH {VIEW}, {POSITIONS}
        SELECT term, _id, field, count(*) AS tf, string_agg(place::VARCHAR, ',' ORDER BY place) AS positions FROM placed GROUP BY term, _id, field"""
    asked = "term IN (SELECT unnest([" + ", ".join(f"[{', '.join(stemmed(repr(w), code) for code in STEMS)}, '{w}']" for w in ("thea", "ingshly")) + "]::VARCHAR[][], recursive := true))"
    q["index_search"] = f"""WITH {VIEW}, {POSITIONS},
        near AS (SELECT _id, field, term, lead(term) OVER (PARTITION BY _id, field ORDER BY place) AS following FROM placed)
        SELECT _id FROM placed WHERE {asked} INTERSECT SELECT _id FROM near WHERE term = 'of' AND following = 'the'
        EXCEPT SELECT _id FROM placed WHERE term = 'zzz'"""
    q["postings"] = f"""WITH {VIEW}, f AS (SELECT _id, 'title' AS field, title AS t FROM view UNION ALL
            SELECT _id, 'content', content FROM view),
        w AS (SELECT _id, field, unnest(regexp_extract_all({fold('t')}, '{WORD}')) AS term FROM f)
        SELECT term, _id, field, count(*) AS tf FROM w WHERE term NOT IN {STOP_LIST} GROUP BY ALL"""

    first = "substr(md5(doc_id::VARCHAR), 1, 1) < '8'"
    q["language_id"] = " UNION ALL ".join(
        f"""SELECT * FROM (WITH source AS (SELECT doc_id, lang, text, {other} AS train FROM documents), {LANGUAGE}
        SELECT d.doc_id, coalesce(b.l, 'en') AS language
        FROM (SELECT doc_id FROM documents WHERE {fold}) d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.r = 1)"""
        for fold, other in ((first, f"NOT ({first})"), (f"NOT ({first})", first))
    )
    silent = f"page_id % 3 = 0 OR {declared_language('html')} = ''"
    q["page_language"] = f"""WITH source AS (
            SELECT doc_id, lang, text, true AS train FROM documents
            UNION ALL SELECT -1 - page_id, NULL, {stripped('html')}, false FROM pages WHERE {silent}), {LANGUAGE}
        SELECT page_id, CASE WHEN {silent} THEN coalesce(b.l, 'en') ELSE {declared_language('html')} END AS value
        FROM pages LEFT JOIN best b ON b.doc_id = -1 - page_id AND b.r = 1"""
    rake = "points DESC, keyword DESC"
    q["keywords_rake"] = f"WITH {RAKE} " + _rank(
        "doc_id, rank, keyword, round(points::DOUBLE / 1000000, 6) AS score", "scored", rake
    )
    q["keyword_lists"] = f"WITH {RAKE}, top AS (" + _rank("doc_id, rank, keyword", "scored", rake, 5) + (
        ") SELECT doc_id, string_agg(keyword, '|' ORDER BY rank) AS keywords FROM top GROUP BY doc_id"
    )
    q["keywords_tfidf"] = f"""WITH t AS (SELECT doc_id, {content_terms('text')} AS w FROM documents WHERE text <> ''),
        e AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
        c AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY ALL),
        n AS (SELECT count(*) AS n_docs FROM documents),
        v AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM c GROUP BY term
              HAVING count(*) >= 2 AND count(*) <= 0.85 * (SELECT n_docs FROM n) ORDER BY ctf DESC, term LIMIT 200),
        w AS (SELECT doc_id, term AS keyword, tf * (ln((1 + n_docs)::DOUBLE / (1 + df)) + 1) AS weight
              FROM c JOIN v USING (term) CROSS JOIN n),
        z AS (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS norm FROM w)
        {_rank('doc_id, rank, keyword, round(weight / norm, 6) AS score', 'z', 'weight DESC, keyword')}"""
    runs = f"""list_transform({fragments('s')}, lambda p, i: array_to_string(list_transform(
        CASE WHEN i = 1 THEN p[2:] ELSE p END, lambda w: CASE WHEN regexp_matches(w, '^\\p{{Lu}}') THEN w ELSE '|' END), ' '))"""
    q["keywords_entities"] = f"""WITH ss AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?\\n]+')) AS s
            FROM documents WHERE text <> ''),
        uses AS (SELECT unnest(regexp_extract_all(s, '{WORD}')[2:]) AS written FROM ss),
        names AS (SELECT lower(written) AS word FROM uses GROUP BY 1
            HAVING count(*) FILTER (WHERE regexp_matches(written, '^\\p{{Lu}}')) >= 0.5 * count(*)
               AND count(*) FILTER (WHERE regexp_matches(written, '^\\p{{Lu}}')) > 0 AND lower(written) NOT IN {STOP_LIST}),
        found AS (SELECT doc_id, trim(unnest(string_split(array_to_string({runs}, '|'), '|'))) AS keyword FROM ss),
        c AS (SELECT doc_id, keyword, count(*) AS times FROM found WHERE keyword <> '' GROUP BY ALL),
        x AS (SELECT doc_id, keyword, times, unnest(string_split(lower(keyword), ' ')) AS word FROM c),
        k AS (SELECT doc_id, keyword, times FROM x LEFT JOIN names USING (word) GROUP BY ALL
              HAVING count(names.word) = count(*))
        {_rank('doc_id, rank, keyword, times', 'k', 'times DESC, keyword')}"""
    q["yake_candidates"] = f"WITH {YAKE} " + _rank(
        "doc_id, rank, keyword, round(score, 6) AS score", "scored", "round(score, 8), keyword", 20
    )
    alike = "1 - levenshtein(k.keyword, x[1].keyword)::DOUBLE / greatest(length(k.keyword), length(x[1].keyword))"
    q["keywords_yake"] = f"""WITH {YAKE}, lists AS (
            SELECT doc_id, list([{{'keyword': keyword, 'score': score}}] ORDER BY round(score, 8), keyword) AS l FROM scored GROUP BY doc_id),
        kept AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN len(a) >= {POOL}
                OR len(list_filter(a, lambda k: {alike} > {DEDUP_LIMIT})) > 0 THEN a ELSE a || x END)[1:10] AS l FROM lists)
        SELECT doc_id, i AS rank, l[i].keyword AS keyword, round(l[i].score, 6) AS score
        FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM kept)"""
    together = " UNION ".join(f"SELECT doc_id, keyword FROM ({q[f'keywords_{name}']})" for name in ("yake", "rake", "entities"))
    q["keywords_combined"] = f"WITH pool AS ({together}) " + _rank("doc_id, rank, keyword", "pool", "length(keyword), keyword")
    q["summary_extractive"] = f"""WITH s AS (SELECT doc_id, {SENTENCES} AS l FROM documents WHERE text <> ''),
        u AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS spot FROM s),
        t AS (SELECT doc_id, spot, unnest({content_terms('sentence')}) AS term FROM u),
        f AS (SELECT doc_id, spot, count(*) OVER (PARTITION BY doc_id, term) AS freq FROM t),
        w AS (SELECT doc_id, spot, sum(freq)::DOUBLE / count(*) AS worth FROM f GROUP BY ALL),
        j AS (SELECT u.doc_id, u.spot, sentence, len(regexp_extract_all(sentence, '{WORD}')) AS n, coalesce(worth, 0) AS worth
              FROM u LEFT JOIN w ON u.doc_id = w.doc_id AND u.spot = w.spot),
        b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY worth DESC, spot
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef FROM j),
        k AS (SELECT doc_id, spot, CASE WHEN bef + n <= 150 THEN sentence
                     ELSE array_to_string(string_split_regex(sentence, ' +')[1:150 - bef], ' ') END AS shown
              FROM b WHERE bef + n <= 150 OR bef < 40)
        SELECT doc_id, string_agg(shown, ' ' ORDER BY spot) AS summary, count(*) AS n_sentences FROM k GROUP BY doc_id"""

    dated = f"""{KEYED}, tried AS (SELECT url AS n, page_id, {title('html')} AS title, {declared_language('html')} AS lang,
            {texts} FROM keyed)"""
    q["scrape_articles"] = f"""WITH {dated} SELECT md5(n) AS _id, n AS url, title, d AS content, lang AS language,
            {PUBDATE} AS publication_date, {pictures} AS image_urls, {domain('n')} AS source_domain
        FROM tried WHERE d <> '' AND {IS_RECENT}"""
    q["stream_ingest"] = f"""WITH {dated} SELECT md5(n) AS _id, n AS url, title, {cascade} AS content,
            CASE WHEN d <> '' THEN coalesce(nullif(lang, ''), 'en') ELSE 'en' END AS language
        FROM tried WHERE {cascade} <> ''"""
    missing = f"""SELECT DISTINCT u AS url, 'Error: No page for URL: ' || u AS error, 'scrape' AS stage
        FROM (SELECT {normal('url')} AS u FROM requests) WHERE u IS NOT NULL AND u NOT IN (SELECT url FROM keyed)"""
    q["stream_requests"] = f"""WITH k AS (SELECT {normal('url')} AS url, page_id, html FROM pages),
        c AS (SELECT url, arg_max(html, page_id) AS html FROM k WHERE page_id % 7 <> 0 GROUP BY url),
        tried AS (SELECT url, {title('html')} AS title, {texts} FROM c),
        m AS (SELECT url FROM k WHERE url NOT IN (SELECT url FROM c)
              UNION SELECT 'http://gone.example.com/' || page_id FROM pages WHERE page_id % 3 = 0)
        SELECT url, 'article' AS outcome, title AS detail FROM tried WHERE {cascade} <> ''
        UNION ALL SELECT url, 'error', 'Error: No page for URL: ' || url FROM m
        UNION ALL SELECT DISTINCT 'page ' || page_id, 'error', 'Error: Invalid URL: page ' || page_id FROM pages
        WHERE page_id % 50 = 0"""
    q["listing_left_out"] = f"""WITH {LINKS} SELECT page_id, greatest(count(DISTINCT link) - 3, 0)::BIGINT AS n_left_out
        FROM pages LEFT JOIN (SELECT page_id, link FROM resolved) USING (page_id) GROUP BY page_id"""
    q["error_report"] = f"WITH {REQUESTS}, {KEYED} {invalid} UNION ALL ({missing})"
    q["run_stats"] = f"""WITH {REQUESTS}, {KEYED}, e AS ({invalid} UNION ALL ({missing})),
        c AS (SELECT count(*) FILTER (WHERE {IS_RECENT}) AS a, count(*) AS n FROM keyed), x AS (SELECT count(*) AS e FROM e)
        SELECT a AS n_articles, e AS n_errors, a + e AS n_reported, CAST(0 AS BIGINT) AS n_dropped_silently,
               n - a AS n_not_recent, CAST(0 AS BIGINT) AS n_left_out, n + e AS n_inputs FROM c CROSS JOIN x"""
    q["article_preview"] = f"""WITH {VIEW} SELECT _id, title,
            CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END AS content_preview,
            CASE WHEN page_id % 7 <> 0 THEN publication_date ELSE 'Unknown' END AS publication_date,
            upper(language) AS language FROM view"""
    q["article_slim"] = f"WITH {VIEW} SELECT title, content, publication_date, url, language FROM view"
    q["domain_groups"] = f"SELECT {display_domain('url')} AS domain, count(*) AS n_articles FROM pages GROUP BY 1"
    q["domain_members"] = f"""SELECT {display_domain('url')} AS domain, page_id, url,
        count(*) OVER (PARTITION BY {display_domain('url')}) AS n_articles FROM pages"""
    return q


def fold_words(text: str) -> list[str]:
    return text.lower().translate(str.maketrans(ACCENTED, PLAIN)).split()
