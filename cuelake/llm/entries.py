"""The registered queries of this package, and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.licenses import license_report

    return license_report(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.simhash import near_duplicate_report

    return near_duplicate_report(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.language import language_report

    return language_report(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.pii import personal_data_report

    return personal_data_report(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.htmltext import page_report

    return page_report(table(spark, sf_dir, "pages"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.repeats import repeat_report

    return repeat_report(table(spark, sf_dir, "documents"))


def op9_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.unigram import round_trip_report

    return round_trip_report(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.decontam import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuelake.llm.warc import archive_report

    return archive_report(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_top_k": op4_top_k,
    "op5_quality": op5_quality,
    "op6_personal_data": op6_personal_data,
    "op7_main_text": op7_main_text,
    "op8_repeats": op8_repeats,
    "op9_unigram": op9_unigram,
    "op10_decontamination": op10_decontamination,
    "op11_lexical_search": op11_lexical_search,
    "op12_phrases": op12_phrases,
    "op13_warc": op13_warc,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE_SQL: dict[str, str] = {
    "op4_top_k": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
ip AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM i),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM ip),
dn AS (SELECT d.doc_id, d.w, l.n FROM d, (SELECT DISTINCT n FROM i) l WHERE len(d.w) >= l.n),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dn),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM dp),
h AS (SELECT dw.doc_id, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items, coalesce(hi.s, sha256('')) AS items_sha256,
       coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id""",
    "op11_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d),
c AS (SELECT doc_id, n, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM i) GROUP BY doc_id, n, t),
v AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM c, s GROUP BY t, nn),
k AS (SELECT doc_id, t, wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) AS part FROM c JOIN v USING (t), s),
r AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM i JOIN k USING (t) GROUP BY item_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10""",
    "op12_phrases": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
c AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 10),
x AS (SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS t FROM f WHERE k > 1),
y AS (SELECT x.*, fl.f AS l, fr.f AS r, CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(fl.f AS HUGEINT) * fr.f) AS BIGINT) AS score
      FROM x JOIN f fl ON fl.lang = x.lang AND fl.phrase = array_to_string(t[1:cut], ' ')
      JOIN f fr ON fr.lang = x.lang AND fr.phrase = array_to_string(t[cut + 1:], ' ')),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM y),
e AS (SELECT lang, string_split(phrase, ' ') AS t, f AS a, unnest([1, 2]) AS p FROM f WHERE k = 3),
o AS (SELECT lang, array_to_string(t[p:p + 1], ' ') AS phrase, max(a) AS longer FROM e GROUP BY 1, 2),
q AS (SELECT z.lang, z.phrase, a, l, r, score FROM z LEFT JOIN o ON o.lang = z.lang AND o.phrase = z.phrase
      WHERE best = 1 AND (longer IS NULL OR 100 * longer < 50 * a)),
v AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT v.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM v JOIN c ON c.lang = v.lang WHERE rank <= 2000""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
k AS (SELECT t, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY t)
SELECT page_id, n AS payload_bytes, sha1(p.t) AS payload_digest,
       CASE WHEN kept IS NULL OR page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM p LEFT JOIN k ON p.t = k.t""",
}
