"""The same results as the registered queries, in DuckDB SQL.

Written independently of the Spark code: other regexes, joins for gap
filling, plain cross joins for neighbours. They only need to be right.
"""

from __future__ import annotations

from opinionlake.plans.catalog import CAPS, LATIN_STOPWORDS, SEEN_BEFORE
from opinionlake.profiles import (
    COLLECT_TARGETS,
    CORPUS_CAP,
    HIT_FIELDS,
    NA_TOKENS,
    NO_HITS_MESSAGE,
    STOPWORDS,
    SUBJECT_FIELD_DEFAULT,
    SUBJECT_LABELS,
    SUBJECT_MISSING_MESSAGE,
)

AS_OF = "DATE '2026-01-01'"
# The shops' kept characters, rating ranges, least lengths and term models, as in the profiles.
KEEP = {
    "aladin": r"""[^0-9A-Za-z가-힣\s.,!?:;\-()\[\]"''/]""",
    "kyobo": r"[^0-9A-Za-z가-힣\s]",
    "yes24": r"[^0-9A-Za-z가-힣\s.,!?…]",
}
RANGE = {"aladin": (1, 5), "kyobo": (0, 10), "yes24": (1, 5)}
MIN_LEN = {"aladin": 5, "kyobo": 1, "yes24": 5}


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def cleaned(column: str, site: str) -> str:
    return f"trim(regexp_replace(regexp_replace({column}, '{KEEP[site]}', ' ', 'g'), '\\s+', ' ', 'g'))"


NA = quoted(NA_TOKENS)
BY_SITE = "CASE site " + " ".join(f"WHEN '{s}' THEN {cleaned('content', s)}" for s in KEEP) + " END"
IN_RANGE = "(" + " OR ".join(f"(site = '{s}' AND rating BETWEEN {a} AND {b})" for s, (a, b) in RANGE.items()) + ")"
LONG_ENOUGH = "(" + " OR ".join(f"(site = '{s}' AND content_len >= {n})" for s, n in MIN_LEN.items()) + ")"

MOMENT = "coalesce(try_cast(date AS TIMESTAMP), try_strptime(date, '%Y%m%d'))"
DAY = f"CAST({MOMENT} AS DATE)"
RAW = """
base AS (
  SELECT d.doc_id,
         CASE d.doc_id % 3 WHEN 0 THEN 'aladin' WHEN 1 THEN 'kyobo' ELSE 'yes24' END AS site,
         CASE WHEN d.doc_id % 17 = 0 THEN 'n/a'
              WHEN d.doc_id % 3 = 1 THEN CAST(CAST(FLOOR(e.value) AS BIGINT) % 12 AS VARCHAR)
              ELSE CAST(1 + CAST(FLOOR(e.value) AS BIGINT) % 6 AS VARCHAR) END AS rating,
         CASE WHEN d.doc_id % 19 = 0 THEN 'not-a-date'
              WHEN d.doc_id % 23 = 0 THEN '2999-01-01'
              WHEN d.doc_id % 37 = 0 THEN strftime(o.o_orderdate, '%Y-%m-%d 09:30')
              WHEN d.doc_id % 41 = 0 THEN strftime(o.o_orderdate, '%Y-%-m-%-dT00:00:00.5Z')
              WHEN d.doc_id % 43 = 0 THEN strftime(o.o_orderdate, '%Y%m%d')
              ELSE CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) END AS date,
         CASE WHEN d.doc_id % 29 = 0 THEN NULL ELSE d.text END AS content
  FROM documents d
  JOIN events e ON d.doc_id = e.event_id
  JOIN orders o ON d.doc_id = o.o_orderkey),
raw_reviews AS (
  SELECT 2 * doc_id AS review_seq, site, rating, date, content FROM base
  UNION ALL
  SELECT 2 * doc_id + 1, site, rating, date, content FROM base WHERE doc_id % 31 = 0)"""

NULLED = f"""{RAW},
nulled AS (
  SELECT review_seq, site,
         CASE WHEN rating IN ({NA}) THEN NULL ELSE rating END AS rating,
         CASE WHEN date IN ({NA}) THEN NULL ELSE date END AS date,
         CASE WHEN content IN ({NA}) THEN NULL ELSE content END AS content
  FROM raw_reviews)"""

TYPED = f"""{NULLED},
typed AS (
  SELECT review_seq, site, try_cast(rating AS DOUBLE) AS rating, {DAY} AS date, content,
         rating AS rating_text, date AS date_text
  FROM nulled)"""

BASIC = f"""{TYPED},
basic AS (
  SELECT * FROM (
    SELECT review_seq, site, rating, date, content, content_clean, length(content_clean) AS content_len
    FROM (SELECT *, {BY_SITE} AS content_clean FROM typed
          WHERE content IS NOT NULL AND {IN_RANGE} AND date <= {AS_OF}))
  WHERE {LONG_ENOUGH})"""

WORDS = "length(content_clean) - length(replace(content_clean, ' ', '')) + 1"


def processed_from(source: str, prefix: str = "") -> str:
    """CTEs <prefix>aladin, <prefix>kyobo, <prefix>yes24, <prefix>processed over ``source``."""
    p = prefix
    return f"""
{p}aladin AS (SELECT *, {WORDS} AS word_len FROM {source} WHERE site = 'aladin'),
{p}kyobo AS (
  SELECT * FROM (
    SELECT *, {WORDS} AS word_len FROM {source} WHERE site = 'kyobo'
    QUALIFY row_number() OVER (PARTITION BY date, rating, content_clean ORDER BY review_seq) = 1)
  WHERE word_len >= 2 AND content_len <= 3000),
{p}yes24 AS (
  SELECT *, {WORDS} AS word_len FROM {source} WHERE site = 'yes24'
  AND content_len <= (SELECT quantile_cont(content_len, 0.99) FROM {source} WHERE site = 'yes24')),
{p}processed AS (
  SELECT * FROM {p}aladin UNION ALL SELECT * FROM {p}kyobo UNION ALL SELECT * FROM {p}yes24)"""


PROCESSED = f"{BASIC},{processed_from('basic')}"

MODEL = {  # fixed values: lowercase, stopwords, bigrams, min_df, max_features
    "aladin": (False, (), True, 1, 200),
    "kyobo": (True, (), False, 2, 1000),
    "yes24": (True, STOPWORDS, True, 2, 1000),
}


def token_list(text: str, site: str) -> str:
    lower, stop, _, _, _ = MODEL[site]
    folded = f"lower({text})" if lower else text
    wanted = "length(x) >= 2" + (f" AND x NOT IN ({quoted(stop)})" if stop else "")
    return f"list_filter(string_split({folded}, ' '), lambda x: {wanted})"


def counts(source: str, site: str, name: str, key: str = "review_seq") -> str:
    """CTE <name>(key, term, tf)."""
    grams = (
        "list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))" if MODEL[site][2] else "k"
    )
    return f"""
{name} AS (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest({grams}) AS term FROM (
      SELECT {key}, {token_list('content_clean', site)} AS k FROM {source}))
  GROUP BY ALL)"""


def model(site: str, source: str | None = None, key: str = "review_seq") -> str:
    """CTEs <site>_tf, <site>_stats, <site>_vocab, <site>_w over a cleaned source."""
    source = source or site
    _, _, _, min_df, most = MODEL[site]
    return f"""{counts(source, site, f'{site}_tf', key)},
{site}_stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM {site}_tf GROUP BY term),
{site}_vocab AS (
  SELECT term, df, ctf, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + df)) + 1 AS idf
  FROM {site}_stats WHERE df >= {min_df} ORDER BY ctf DESC, term LIMIT {most}),
{weights(f'{site}_tf', f'{site}_vocab', f'{site}_w', key)}"""


def weights(tf: str, vocab: str, name: str, key: str) -> str:
    return f"""
{name} AS (
  SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS tfidf
  FROM (SELECT {key}, term, tf * idf AS w FROM {tf} JOIN {vocab} USING (term)))"""


def sums(site: str) -> str:
    return f"""
SELECT r.*, coalesce(s.tfidf_sum, 0.0) AS tfidf_sum, coalesce(s.tfidf_nonzero_cnt, 0) AS tfidf_nonzero_cnt
FROM {site} r LEFT JOIN (
  SELECT review_seq, sum(tfidf) AS tfidf_sum, count(*) AS tfidf_nonzero_cnt FROM {site}_w GROUP BY review_seq) s
USING (review_seq)"""


def on(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


SITES = ("aladin", "kyobo", "yes24")


def all_sites(select: str, sites=SITES) -> str:
    return "\nUNION ALL\n".join(select.replace("$site", s) for s in sites)


MODELS = ",".join(model(s) for s in SITES)

MONTHS = """
counted AS (
  SELECT site, CAST(date_trunc('month', date) AS DATE) AS m, count(*) AS n, avg(rating) AS r
  FROM processed GROUP BY ALL),
spine AS (
  SELECT site, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m
  FROM (SELECT site, min(m) AS lo, max(m) AS hi FROM counted GROUP BY site)),
monthly AS (
  SELECT s.site, last_day(s.m) AS month, coalesce(c.n, 0) AS n_reviews, c.r AS mean_rating
  FROM spine s LEFT JOIN counted c USING (site, m))"""


def histogram(column: str, bins: int) -> str:
    return f"""
WITH {PROCESSED},
x AS (SELECT site, CAST({column} AS DOUBLE) AS v FROM processed),
lim AS (
  SELECT site, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
         CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi
  FROM x GROUP BY site),
hit AS (
  SELECT site, CAST(least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}) AS BIGINT) AS bin, count(*) AS n
  FROM x JOIN lim USING (site) GROUP BY ALL),
spine AS (SELECT site, lo, (hi - lo) / {bins} AS w, unnest(range(0, {bins})) AS bin FROM lim)
SELECT site, bin, round(lo + bin * w, 6) AS bin_low, round(lo + (bin + 1) * w, 6) AS bin_high, coalesce(n, 0) AS n
FROM spine LEFT JOIN hit USING (site, bin)"""


KEYED = f"""{NULLED},
keyed AS (
  SELECT review_seq, site, rating, date, content,
         sha256(site || '||' || coalesce(date, 'nan') || '||' ||
                coalesce(CAST(try_cast(rating AS DOUBLE) AS VARCHAR), rating, 'nan') || '||' ||
                coalesce(content, 'nan')) AS raw_id
  FROM nulled),
seen AS (SELECT * FROM keyed WHERE {DAY} < DATE '{SEEN_BEFORE}')"""

PROCESSED_ID = (
    "sha256(site || '||' || strftime(date, '%Y-%m-%d') || '||' || CAST(rating AS VARCHAR) || '||' || content_clean)"
)


def basic_of(source: str, name: str) -> str:
    """CTE ``name``: row-wise cleaning of keyed rows in ``source``."""
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, length(content_clean) AS content_len FROM (
      SELECT *, {BY_SITE} AS content_clean FROM (
        SELECT review_seq, raw_id, site, try_cast(rating AS DOUBLE) AS rating, {DAY} AS date, content
        FROM {source})
      WHERE content IS NOT NULL AND {IN_RANGE} AND date <= {AS_OF}))
  WHERE {LONG_ENOUGH})"""


USERS = """
users AS (
  SELECT 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
         'pw' || CAST(c_custkey % 97 AS VARCHAR) AS password, c_name AS username
  FROM customer),
changes AS (
  SELECT o_orderkey AS seq,
         CASE o_orderkey % 4 WHEN 0 THEN 'register' WHEN 1 THEN 'login' WHEN 2 THEN 'update' ELSE 'delete' END AS op,
         'user' || CAST(o_custkey AS VARCHAR) ||
           CASE WHEN o_orderkey % 13 = 0 THEN 'example.com' WHEN o_orderkey % 7 = 0 THEN '@example.org'
                ELSE '@example.com' END AS email,
         CASE WHEN o_orderkey % 3 = 0 THEN 'pw' || CAST(o_custkey % 97 AS VARCHAR)
              ELSE 'new' || CAST(o_orderkey % 89 AS VARCHAR) END AS password,
         'name' || CAST(o_orderkey % 11 AS VARCHAR) AS username
  FROM orders)"""


UPSERTS = """
upserts AS (SELECT seq % 3 AS batch, email, arg_max(password, seq) AS password, arg_max(username, seq) AS username
            FROM changes WHERE op IN ('register', 'update') GROUP BY ALL)"""


def presence(op: str, present: str, absent: str) -> str:
    return on(USERS, f"""
SELECT seq, email, CASE WHEN email IN (SELECT email FROM users) THEN '{present}' ELSE '{absent}' END AS status
FROM changes WHERE op = '{op}'""")


QUESTIONS = """
questions AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS query_id,
         CASE role WHEN 'user' THEN text ELSE 'zzqqx' || CAST(conv_id AS VARCHAR) END AS asked
  FROM conversations WHERE role IN ('user', 'system'))"""


def word_counts(source: str, key: str, text: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT {key}, term, count(*) AS tf
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source})
  GROUP BY ALL)"""


def lexical(source: str, key: str, text: str) -> str:
    """CTE hits(query_id, rank, doc_id, score): all words of ``source``, no vocabulary limit."""
    return f"""{word_counts(source, key, text, 'held')},
idf AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + count(*))) + 1 AS idf FROM held GROUP BY term),
{weights('held', 'idf', 'held_w', key)},{word_counts('questions', 'query_id', 'asked', 'asked_tf')},
{weights('asked_tf', 'idf', 'asked_w', 'query_id')},
scored AS (
  SELECT query_id, {key} AS doc_id, round(sum(a.tfidf * d.tfidf), 6) AS score
  FROM asked_w a JOIN held_w d USING (term) GROUP BY ALL),
hits AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0 QUALIFY rank <= 4)"""


CORPUS = """
corpus AS (
  SELECT review_seq AS doc_id, trim(coalesce(nullif(content_clean, ''), content)) AS page_content,
         'preprocessed_reviews_' || site || '.csv' AS source_file, rating, strftime(date, '%Y-%m-%d') AS date, site
  FROM processed)"""

SIGNED = f"""{RAW},
signed AS (
  SELECT *, md5(coalesce(date, '') || '|' || coalesce(rating, '') || '|' || coalesce(content, '')) AS signature
  FROM raw_reviews)"""

SAFE = (
    "coalesce(nullif(trim(regexp_replace(translate(term, '.$', '__'), '[\\s\\p{Z}]+', '_', 'g'), '_'), ''), '_')"
)
NAMED = """
$site_named AS (
  SELECT term, safe || CASE WHEN rn = 1 THEN '' ELSE '_' || CAST(rn AS VARCHAR) END AS name
  FROM (SELECT term, safe, row_number() OVER (PARTITION BY safe ORDER BY term) AS rn
        FROM (SELECT term, """ + SAFE + """ AS safe FROM $site_vocab)))"""


def first_of(*found: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({f}, '')" for f in found) + ")"


CARDS = """
cards AS (
  SELECT doc_id AS page_id, CASE doc_id % 3 WHEN 0 THEN 'aladin' WHEN 1 THEN 'kyobo' ELSE 'yes24' END AS site, text,
         CASE WHEN doc_id % 19 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
         CAST(printf('%.1f', (CAST(floor(value * 10) AS BIGINT) % 1001) / 10.0 / 10) AS DOUBLE) AS ten
  FROM documents JOIN events ON doc_id = event_id JOIN orders ON doc_id = o_orderkey),
reviews AS (
  SELECT page_id, site, day AS date,
         CASE site WHEN 'kyobo' THEN CAST(ten AS VARCHAR) WHEN 'yes24' THEN CAST(page_id % 11 // 2 AS VARCHAR)
              ELSE CASE WHEN page_id % 6 > 0 THEN CAST(page_id % 6 AS VARCHAR) WHEN page_id % 4 = 0 THEN '3' ELSE '' END END AS rating,
         trim(regexp_replace(CASE site WHEN 'aladin' THEN 'A & B''s in tail café &lt; 5€ © ß– ' ELSE 'A & B in tail ' END || text, '[\\s\\x0b\\p{Z}]+', ' ', 'g')) AS content
  FROM cards WHERE site <> 'kyobo' OR day <> '')"""


def run_documents(source: str, run: str) -> str:
    """Documents that a run makes of raw rows, with weights fitted on them alone."""
    each = all_sites(f"""
SELECT p.site, '{run}' AS run, p.review_seq, p.raw_id, {PROCESSED_ID} AS processed_id, p.content_len,
       strftime(p.date, '%Y-%m') AS year_month, round(coalesce(w.tfidf_sum, 0.0), 6) AS tfidf_sum,
       coalesce(w.n, 0) AS tfidf_nonzero_cnt, w.weights
FROM $site p LEFT JOIN (
  SELECT review_seq, sum(tfidf) AS tfidf_sum, count(*) AS n,
         array_to_string(list_sort(list(name || '=' || printf('%.6f', tfidf))), ';') AS weights
  FROM $site_w JOIN $site_named USING (term) GROUP BY review_seq) w USING (review_seq)""")
    named = ",".join(NAMED.replace("$site", s) for s in SITES)
    return f"WITH {basic_of(source, 'basic')},{processed_from('basic')},{MODELS},{named}\n{each}"


TWO_RUNS = f"""{KEYED},
store AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY review_seq) = 1),
early AS (SELECT * FROM store WHERE coalesce({DAY} < DATE '{SEEN_BEFORE}', FALSE)),
late AS (SELECT * FROM store WHERE raw_id NOT IN (SELECT raw_id FROM early)),
made AS (
  SELECT *, 0 AS nth FROM ({run_documents('early', 'first')})
  UNION ALL SELECT *, 1 AS nth FROM ({run_documents('late', 'second')})),
documents_out AS (
  SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY processed_id ORDER BY nth, review_seq) = 1)"""


ORACLES: dict[str, str] = {
    "na_tokens": on(NULLED, "SELECT review_seq, site, rating, date, content FROM nulled"),
    **{
        f"clean_{s}": on(PROCESSED, f"SELECT review_seq, rating, date, content_clean, content_len, word_len FROM {s}")
        for s in SITES
    },
    "rating_bounds": on(TYPED, f"SELECT review_seq, site, rating FROM typed WHERE {IN_RANGE}"),
    "future_filter": on(TYPED, f"SELECT review_seq, site, date FROM typed WHERE date <= {AS_OF}"),
    "text_fallback": on(f"""{RAW},
c AS (SELECT review_seq, content,
        CASE WHEN site = 'kyobo' THEN {BY_SITE} END AS a, CASE WHEN site = 'aladin' THEN {BY_SITE} END AS b
      FROM raw_reviews)""", """
SELECT review_seq, coalesce(nullif(a, ''), nullif(b, ''), content) AS cleaned_first,
       coalesce(nullif(b, ''), nullif(a, ''), content) AS clean_first,
       coalesce(nullif(a, ''), content) AS cleaned_or_raw
FROM c"""),
    "len_p99": on(BASIC, "SELECT site, round(quantile_cont(content_len, 0.99), 6) AS p99 FROM basic GROUP BY site"),
    "len_p99_filter": on(BASIC, """
SELECT review_seq, site, content_len
FROM (SELECT *, quantile_cont(content_len, 0.99) OVER (PARTITION BY site) AS p FROM basic) WHERE content_len <= p"""),
    "len_p99_clip": on(BASIC, """
SELECT review_seq, site, content_len, round(least(CAST(content_len AS DOUBLE), p), 6) AS clipped_len
FROM (SELECT *, quantile_cont(content_len, 0.99) OVER (PARTITION BY site) AS p FROM basic)"""),
    "rating_p99_exact": "SELECT event_type, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "filter_report": on(f"""{PROCESSED},
steps AS (
  SELECT site, rating_text IS NOT NULL AND date_text IS NOT NULL AND content IS NOT NULL AS complete, rating, date FROM typed),
flags AS (
  SELECT site, complete, complete AND rating IS NOT NULL AND date IS NOT NULL AS typed_ok,
         complete AND date IS NOT NULL AND coalesce({IN_RANGE}, FALSE) AS ranged,
         complete AND coalesce({IN_RANGE}, FALSE) AND coalesce(date <= {AS_OF}, FALSE) AS past
  FROM steps),
counted AS (
  SELECT site, count(*) AS rows_before, count_if(complete) AS rows_complete, count_if(typed_ok) AS rows_typed,
         count_if(ranged) AS rows_in_range, count_if(past) AS rows_not_future FROM flags GROUP BY site),
uniq AS (
  SELECT * FROM basic WHERE site <> 'kyobo' UNION ALL
  SELECT * FROM basic WHERE site = 'kyobo'
  QUALIFY row_number() OVER (PARTITION BY date, rating, content_clean ORDER BY review_seq) = 1),
under AS (
  SELECT site FROM uniq WHERE site <> 'yes24' OR content_len <=
    (SELECT quantile_cont(content_len, 0.99) FROM uniq WHERE site = 'yes24'))""", """
SELECT c.site, rows_before, CAST(rows_complete AS BIGINT) AS rows_complete, CAST(rows_typed AS BIGINT) AS rows_typed,
       CAST(rows_in_range AS BIGINT) AS rows_in_range, CAST(rows_not_future AS BIGINT) AS rows_not_future,
       (SELECT count(*) FROM basic b WHERE b.site = c.site) AS rows_long_enough,
       (SELECT count(*) FROM uniq u WHERE u.site = c.site) AS rows_unique,
       (SELECT count(*) FROM under u WHERE u.site = c.site) AS rows_under_quantile,
       (SELECT count(*) FROM processed p WHERE p.site = c.site) AS rows_kept,
       rows_before - (SELECT count(*) FROM processed p WHERE p.site = c.site) AS rows_removed
FROM counted c"""),
    "iso_and_null": on(RAW, f"""
SELECT review_seq, try_cast(rating AS DOUBLE) AS rating,
       strftime({MOMENT}, '%Y-%m-%dT%H:%M:%S') AS date_iso
FROM raw_reviews"""),
    "date_features": on(BASIC, """
SELECT review_seq, year(date) AS year, month(date) AS month, isodow(date) - 1 AS weekday,
       ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(date)] AS weekday_name,
       CAST(isodow(date) >= 6 AS BIGINT) AS is_weekend, strftime(date, '%Y-%m') AS year_month
FROM basic"""),
    "length_features": on(BASIC, """
SELECT review_seq, site, content_len, CAST(len(string_split(content_clean, ' ')) AS BIGINT) AS word_len FROM basic"""),
    "stopword_filter": on(BASIC, f"""
SELECT review_seq, CAST(len(k) AS BIGINT) AS n_tokens, array_to_string(k, ' ') AS tokens
FROM (SELECT review_seq, list_filter(string_split(lower(content_clean), ' '),
        lambda x: length(x) >= 2 AND x NOT IN ({quoted(LATIN_STOPWORDS)})) AS k FROM basic)"""),
    "length_backfill": on(BASIC, f"SELECT review_seq, site, content_len, CAST({WORDS} AS BIGINT) AS word_len FROM basic"),
    "plain_values": """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS number, 'a_b' AS names, value AS field,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at
FROM events""",
    "rating_rescaled": on(PROCESSED, """
SELECT review_seq, site, rating, CASE WHEN site = 'kyobo' THEN rating / 2 ELSE rating END AS rating_5
FROM processed"""),
    "dedupe_reviews": on(BASIC, """
SELECT review_seq, site, rating FROM basic
QUALIFY row_number() OVER (PARTITION BY site, date, rating, content_clean ORDER BY review_seq) = 1"""),
    "dedupe_content": on(RAW, """
SELECT min(review_seq) AS review_seq, site FROM raw_reviews WHERE content IS NOT NULL GROUP BY site, content"""),
    "dedupe_signature": on(SIGNED, """
SELECT min(review_seq) AS review_seq, site, signature FROM signed GROUP BY site, signature"""),
    "collect_capped": on(RAW, f"""
SELECT review_seq, site, position FROM (
  SELECT review_seq, site, row_number() OVER (PARTITION BY site ORDER BY review_seq) AS position FROM (
    SELECT min(review_seq) AS review_seq, site FROM raw_reviews WHERE content IS NOT NULL GROUP BY site, content))
WHERE position <= CASE site {' '.join(f"WHEN '{s}' THEN {n}" for s, n in CAPS.items())} END"""),
    "priority_fill": on(SIGNED, f"""
SELECT review_seq, site, signature, priority FROM (
  SELECT *, CASE site WHEN 'kyobo' THEN CAST(0 AS BIGINT) ELSE 1 END AS priority FROM signed WHERE site IN ('kyobo', 'yes24'))
QUALIFY row_number() OVER (PARTITION BY signature ORDER BY priority, review_seq) = 1
ORDER BY priority, review_seq LIMIT {COLLECT_TARGETS['kyobo']}"""),
    "corpus_capped": on(f"{PROCESSED},{CORPUS}", f"""
SELECT doc_id, page_content, source_file, rating, date FROM (
  SELECT * FROM corpus WHERE page_content IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY site ORDER BY doc_id) <= {CORPUS_CAP // 20})
WHERE page_content <> ''"""),
    "site_summary": on(PROCESSED, """
SELECT site, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
       min(rating) AS min_rating, max(rating) AS max_rating
FROM processed GROUP BY site"""),
    "monthly_count": on(f"{PROCESSED},{MONTHS}", "SELECT site, month, n_reviews FROM monthly"),
    "monthly_mean_rating": on(
        f"{PROCESSED},{MONTHS}", "SELECT site, month, round(mean_rating, 6) AS mean_rating FROM monthly"
    ),
    "monthly_rolling": on(f"{PROCESSED},{MONTHS}", """
SELECT site, month, n_reviews, round(avg(n_reviews) OVER (
  PARTITION BY site ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling_mean
FROM monthly"""),
    "hist_rating": histogram("rating", 5),
    "hist_length": histogram("content_len", 30),
    "length_density": on(f"""{PROCESSED},
shape AS (
  SELECT site, count(*) AS total, min(content_len) AS lo, max(content_len) AS hi,
         stddev_samp(content_len) * pow(count(*), -0.2) AS h
  FROM processed GROUP BY site),
grid AS (SELECT *, unnest(range(0, 50)) AS point FROM shape),
placed AS (SELECT *, lo + (hi - lo) * point / 49.0 AS x FROM grid)""", """
SELECT g.site, point, round(any_value(x), 6) AS x,
       round(sum(exp(-(x - p.content_len) * (x - p.content_len) / (2 * h * h)) / (total * h * sqrt(2 * pi()))), 9) AS density
FROM placed g JOIN processed p ON p.site = g.site GROUP BY g.site, point"""),
    "token_freq_10k": """
WITH t AS (SELECT source, unnest(regexp_extract_all(text, '\\p{L}{2,}')) AS token FROM documents),
c AS (SELECT source, token, count(*) AS n FROM t GROUP BY ALL)
SELECT source, token, n, round(n * 10000.0 / sum(n) OVER (PARTITION BY source), 6) AS rate FROM c""",
    **{
        f"tfidf_{s}": on(
            f"{PROCESSED},{model(s)}", f"SELECT review_seq, term, round(tfidf, 6) AS tfidf FROM {s}_w"
        )
        for s in SITES
    },
    "term_stats": on(f"{PROCESSED},{MODELS}", all_sites("SELECT term, df, ctf, '$site' AS site FROM $site_stats")),
    "vocab_cap": on(
        f"{PROCESSED},{MODELS}",
        all_sites("SELECT '$site' AS site, term, df, ctf, round(idf, 6) AS idf FROM $site_vocab"),
    ),
    "tfidf_doc_stats": on(
        f"{PROCESSED},{model('kyobo')},{model('yes24')},\nk AS ({sums('kyobo')}),\ny AS ({sums('yes24')})",
        """
SELECT review_seq, site, round(tfidf_sum, 6) AS tfidf_sum, tfidf_nonzero_cnt FROM k
UNION ALL SELECT review_seq, site, round(tfidf_sum, 6), tfidf_nonzero_cnt FROM y""",
    ),
    "top_terms": on(f"{PROCESSED},{MODELS}", all_sites("""
SELECT * FROM (
  SELECT '$site' AS site, term, round(sum(tfidf) / (SELECT count(*) FROM $site), 6) AS mean_tfidf
  FROM $site_w GROUP BY term ORDER BY mean_tfidf DESC, term LIMIT 20)""")),
    "features_full": on(
        f"{PROCESSED},{MODELS}," + ",".join(f"\n{s}_fe AS ({sums(s)})" for s in SITES),
        f"""
SELECT review_seq, site, rating, date, content_len, word_len, year(date) AS year, month(date) AS month,
       isodow(date) - 1 AS weekday,
       ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(date)] AS weekday_name,
       CAST(isodow(date) >= 6 AS BIGINT) AS is_weekend, strftime(date, '%Y-%m') AS year_month,
       round(tfidf_sum, 6) AS tfidf_sum, tfidf_nonzero_cnt
FROM ({all_sites('SELECT * FROM $site_fe')})""",
    ),
    "sanitized_terms": on(
        f"{PROCESSED},{MODELS}," + ",".join(NAMED.replace("$site", s) for s in SITES),
        all_sites("SELECT '$site' AS site, term, name FROM $site_named"),
    ),
    "tfidf_map": on(f"{PROCESSED},{model('yes24')},{NAMED.replace('$site', 'yes24')}", """
SELECT review_seq, array_to_string(list_sort(list(name || '=' || printf('%.6f', tfidf))), ';') AS weights
FROM yes24_w JOIN yes24_named USING (term) GROUP BY review_seq"""),
    "seed_raw_keys": on(KEYED, "SELECT review_seq, site, raw_id FROM keyed"),
    "content_keys": on(PROCESSED, f"SELECT review_seq, site, {PROCESSED_ID} AS processed_id FROM processed"),
    "insert_only_merge": on(KEYED, """
SELECT site, count(*) AS batch_rows,
       count(DISTINCT CASE WHEN raw_id NOT IN (SELECT raw_id FROM seen) THEN raw_id END) AS inserted,
       count(*) - count(DISTINCT CASE WHEN raw_id NOT IN (SELECT raw_id FROM seen) THEN raw_id END) AS matched
FROM keyed GROUP BY site"""),
    "insert_only_table": on(KEYED, """
SELECT review_seq, site, raw_id, rating, date, content FROM keyed
QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY review_seq) = 1"""),
    "incremental_new": on(KEYED, """
SELECT review_seq, site, raw_id FROM keyed WHERE raw_id NOT IN (SELECT raw_id FROM seen)"""),
    "incremental_run": on(TWO_RUNS, """
SELECT site, (SELECT count(*) FROM store x WHERE x.site = s.site) AS raw_count,
       (SELECT count(*) FROM late x WHERE x.site = s.site) AS to_process_count,
       (SELECT count(*) FROM made x WHERE x.site = s.site AND nth = 1) AS processed_rows,
       (SELECT count(*) FROM documents_out x WHERE x.site = s.site AND nth = 1) AS inserted_new,
       (SELECT count(*) FROM made x WHERE x.site = s.site AND nth = 1) -
       (SELECT count(*) FROM documents_out x WHERE x.site = s.site AND nth = 1) AS matched_existing
FROM (SELECT DISTINCT site FROM store) s"""),
    "incremental_documents": on(TWO_RUNS, "SELECT * EXCLUDE (nth) FROM documents_out"),
    "incremental_ledger": on(TWO_RUNS, """
SELECT site, CASE WHEN raw_id IN (SELECT raw_id FROM early) THEN 'first' ELSE 'second' END AS run, raw_id,
       CASE WHEN raw_id IN (SELECT raw_id FROM made) THEN 'kept' ELSE 'rejected' END AS outcome
FROM store"""),
    "incremental_rerun": on(TWO_RUNS, """
SELECT site, count(*) AS raw_count, CAST(0 AS BIGINT) AS to_process_count, CAST(0 AS BIGINT) AS inserted_new,
       (SELECT count(*) FROM documents_out d WHERE d.site = s.site) AS documents
FROM store s GROUP BY site"""),
    "user_get": on(USERS, """
SELECT email, password, username, username IS NOT NULL AS found
FROM (SELECT DISTINCT email FROM changes WHERE op = 'login') LEFT JOIN users USING (email)"""),
    "user_login_status": on(USERS, """
SELECT c.seq, c.email, CASE WHEN u.email IS NULL THEN 'not_found' WHEN u.password = c.password THEN 'ok'
  ELSE 'invalid' END AS status
FROM changes c LEFT JOIN users u ON u.email = c.email WHERE op = 'login'"""),
    "user_register_status": presence("register", "exists", "created"),
    "user_update_status": presence("update", "updated", "not_found"),
    "user_delete_status": presence("delete", "deleted", "not_found"),
    "user_register": on(USERS, """
SELECT * FROM users UNION ALL
SELECT email, arg_max(password, seq), arg_max(username, seq) FROM changes
WHERE op = 'register' AND email NOT IN (SELECT email FROM users) GROUP BY email"""),
    "user_update": on(USERS, """
SELECT u.email, coalesce(c.p, u.password) AS password, u.username
FROM users u LEFT JOIN (SELECT email, arg_max(password, seq) AS p FROM changes WHERE op = 'update' GROUP BY email) c
USING (email)"""),
    "user_upsert": on(f"""{USERS},
last AS (SELECT email, arg_max(password, seq) AS password, arg_max(username, seq) AS username
         FROM changes WHERE op IN ('register', 'update') GROUP BY email)""", """
SELECT * FROM last UNION ALL SELECT * FROM users WHERE email NOT IN (SELECT email FROM last)"""),
    "user_delete": on(USERS, """
SELECT * FROM users WHERE email NOT IN (SELECT email FROM changes WHERE op = 'delete')"""),
    "user_table_upserted": on(f"""{USERS},{UPSERTS},
first AS (SELECT email, password, username FROM upserts WHERE batch = 0
          UNION ALL SELECT * FROM users WHERE email NOT IN (SELECT email FROM upserts WHERE batch = 0)),
set_anew AS (SELECT email, arg_max(password, seq) AS p FROM changes WHERE op = 'update' AND seq % 3 = 1 GROUP BY email),
second AS (SELECT email, coalesce(p, password) AS password, username FROM first LEFT JOIN set_anew USING (email))""", """
SELECT email, password, username FROM upserts WHERE batch = 2
UNION ALL SELECT * FROM second WHERE email NOT IN (SELECT email FROM upserts WHERE batch = 2)"""),
    "user_table_deleted": on(f"""{USERS},{UPSERTS},
gone AS (SELECT email, seq % 3 AS batch FROM changes WHERE op = 'delete'),
added AS (SELECT email, password, username FROM upserts WHERE batch = 1),
held AS (SELECT * FROM added UNION ALL
         SELECT * FROM users WHERE email NOT IN (SELECT email FROM gone WHERE batch = 0) AND email NOT IN (SELECT email FROM added))""", """
SELECT * FROM held WHERE email NOT IN (SELECT email FROM gone WHERE batch = 2)"""),
    "user_valid_email": on(USERS, """
SELECT seq, email, position('@' IN email) > 0 AS valid FROM changes"""),
    "vector_topk": """
WITH d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_sum(list_transform(range(1, 65),
           lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)) ** 2)), 6) AS score
  FROM embeddings q CROSS JOIN embeddings c)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank, doc_id, score
FROM d QUALIFY rank <= 4""",
    "lexical_topk": on(
        f"{QUESTIONS},{lexical('documents', 'doc_id', 'text')}", "SELECT query_id, rank, doc_id, score FROM hits"
    ),
    "rag_context": on(
        f"""{PROCESSED},{CORPUS},{QUESTIONS},
docs AS (SELECT * FROM corpus WHERE page_content <> ''),{lexical('docs', 'doc_id', 'page_content')},
lines AS (
  SELECT query_id, count(*) AS n, string_agg('[' || rank || '] (' || source_file || ', {HIT_FIELDS[0]}=' || rating ||
           ', {HIT_FIELDS[1]}=' || date || ') ' || page_content, chr(10) ORDER BY rank) AS context
  FROM hits JOIN corpus USING (doc_id) GROUP BY query_id)""",
        f"""
SELECT query_id, coalesce(n, 0) AS n_hits, coalesce(context, '{NO_HITS_MESSAGE}') AS context
FROM questions LEFT JOIN lines USING (query_id)""",
    ),
    "index_build": on(f"{PROCESSED},{CORPUS}", """
SELECT doc_id, source_file, rating, date, CAST(length(page_content) AS DOUBLE) AS chars,
       CAST(length(page_content) - length(replace(page_content, 'e', '')) AS DOUBLE) AS marks
FROM corpus WHERE page_content <> ''"""),
    "index_reuse": on(f"{PROCESSED},{CORPUS}", """
SELECT source_file, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS doc_count, 'reviews 0' AS built_from
FROM corpus WHERE page_content <> '' GROUP BY source_file"""),
    "conversation_history": """
SELECT conv_id, turn, role, role || ': ' || text AS line,
       row_number() OVER w AS position,
       CAST(sum(length(role || ': ' || text) + 1) OVER w - 1 AS BIGINT) AS history_chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "route_labels": """
SELECT CASE role WHEN 'user' THEN 'rag_review' WHEN 'system' THEN 'subject_info' ELSE 'chat' END AS route,
       count(*) AS n
FROM conversations GROUP BY 1""",
    "site_names": on(RAW, """
SELECT CASE WHEN review_seq % 7 <> 0 AND review_seq % 11 <> 0 THEN site END AS site, count(*) AS n
FROM raw_reviews GROUP BY 1"""),
    "subject_lookup": f"""
SELECT c_custkey, key, CASE WHEN n_nationkey IS NULL THEN '{SUBJECT_MISSING_MESSAGE}' ELSE
  '{SUBJECT_LABELS["title"]}: ' || n_name || chr(10) ||
  '{SUBJECT_LABELS["author"]}: ' || CASE WHEN n_regionkey = 0 THEN '{SUBJECT_FIELD_DEFAULT}' ELSE 'region ' || n_regionkey END || chr(10) ||
  '{SUBJECT_LABELS["summary"]}: ' || CASE WHEN n_regionkey = 1 THEN '{SUBJECT_FIELD_DEFAULT}' ELSE 'about ' || n_name END ||
  CASE WHEN n_regionkey = 2 THEN '' ELSE chr(10) || '{SUBJECT_LABELS["keywords"]}: ' || n_name || ', r' || n_regionkey END END AS response
FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'none' ELSE CAST(c_nationkey AS VARCHAR) END AS key FROM customer)
LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = key""",
    "index_meta": "SELECT count(*) AS doc_count, 'embeddings' AS built_from FROM embeddings",
    "page_blocks": """
SELECT page_id, CAST(unnest(range(0, len(b))) AS BIGINT) AS block_no, unnest(b) AS block
FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS b FROM pages)""",
    "url_params": f"""
SELECT page_id, coalesce({first_of("regexp_extract(url, '[?&]page=([^&#]*)', 1)")}, '1') AS page,
       {first_of("regexp_extract(url, '[?&]ref=([^&#]*)', 1)")} AS ref,
       coalesce({first_of("regexp_extract(url, '/([0-9]+)', 1)")}, '0') AS number
FROM pages""",
    "extract_number_date": on(CARDS, """
SELECT page_id, CASE site WHEN 'aladin' THEN CAST(page_id AS VARCHAR) END AS number,
       CASE WHEN site <> 'kyobo' AND day <> '' THEN day ELSE '1999-09-09' END AS date,
       CASE site WHEN 'kyobo' THEN ten ELSE 0.0 END AS rating
FROM cards"""),
    "pattern_count": on(CARDS, """
SELECT page_id, CASE WHEN site <> 'aladin' THEN NULL WHEN lit > 0 THEN CAST(lit AS VARCHAR) WHEN page_id % 4 = 0 THEN '3' END AS rating,
       CASE site WHEN 'yes24' THEN CAST(page_id % 11 // 2 AS VARCHAR) ELSE '5' END AS suffix_rating
FROM (SELECT *, page_id % 6 + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS lit FROM cards)"""),
    "page_reviews": on(CARDS, """
SELECT page_id, CAST(1 AS BIGINT) AS card_no, site, rating, date, content,
       CASE site WHEN 'aladin' THEN CAST(page_id AS VARCHAR) ELSE md5(date || '|' || rating || '|' || content) END AS review_id
FROM reviews"""),
    "page_collect": on(CARDS, f"""
SELECT page_id, CAST(page_id AS VARCHAR) AS review_id, row_number() OVER (ORDER BY page_id) AS position
FROM reviews WHERE site = 'aladin' QUALIFY position <= {CAPS['aladin']}"""),
    "stream_daily": """
SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""",
    "stream_daily_late": """
SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""",
    "stream_monthly": """
SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n, round(avg(value), 6) AS mean_value
FROM events GROUP BY 1""",
    "stream_dedupe_daily": """
SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS event_day FROM events""",
    "stream_late_keys": """
SELECT user_id, event_type, event_day,
       CAST(min(CASE WHEN day(event_day) >= 21 THEN 0 WHEN day(event_day) >= 11 THEN 1 ELSE 2 END) AS BIGINT) AS delivery
FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS event_day FROM events) GROUP BY ALL""",
}
