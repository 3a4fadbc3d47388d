"""The operators' queries, one for each, over their whole tables; and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .conversations import repair_report
from .decontaminate import contamination
from .divergence import audit
from .exact_dedup import exact_dedup_report
from .jaccard_join import jaccard_components
from .language import language_report
from .lm_score import lm_scores
from .pieces import pieces_report
from .quality import quality_report
from .sharding import shard_rows
from .toxicity import toxicity_report
from .urlfilter import LISTED, url_report
from .warc import warc_report


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_report(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_report(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_report(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 16)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_report(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality, op2_language, op3_exact_dedup, op4_jaccard_join, op5_warc, op6_toxicity, op7_pieces, op8_sharding, op9_lm_score, op10_decontamination, op11_conversations, op12_divergence,
        op13_url_filter,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The CRC-32 of an ASCII text, eight steps a character.
_CRC32 = (
    "xor(4294967295, list_reduce(list_transform(string_split({}, ''), lambda ch: ord(ch)::BIGINT), "
    "lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT))"
)
_KEY = r"regexp_replace(regexp_replace(lower(coalesce(url, '')), '#.*$', ''), '^[a-z][a-z0-9+.-]*://', '')"

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
        SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op5_warc": rf"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest, {_KEY} AS u FROM pages),
        k AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(u, '^([^/?]*)', 1), '^.*@', ''), '(^www[0-9]*\.)|(:[0-9]+$)', '', 'g') AS host, regexp_extract(u, '^[^/?]*(.*)$', 1) AS rest,
            CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
        SELECT page_id, size AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to,
            CASE WHEN host = '' THEN rest ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END END AS url_key,
            strftime(make_timestamp((1704067200 + page_id % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM k""",
    "op10_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT item_id, least(len(w), 13) AS k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda j: array_to_string(w[j:j + least(len(w), 13) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
        ks AS (SELECT DISTINCT k FROM iw),
        dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS pos, w FROM d, ks WHERE len(w) >= k),
        h AS (SELECT DISTINCT doc_id, dw.k, pos, item_id FROM dw JOIN iw ON iw.k = dw.k AND iw.g = array_to_string(dw.w[pos:pos + dw.k - 1], ' ')),
        hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS place FROM h) t GROUP BY doc_id),
        it AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    # the cheapest way to each (place, state) grows row by row, inserts before a row first; of equal costs the least letters stay
    "op11_conversations": rf"""
        WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm FROM conversations),
        g AS (SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(range(CASE harm WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE harm <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
            regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM g),
        f AS (SELECT *, final = '' AS blank, final <> '' AND nth > 1 AS twice, final <> '' AND nth = 1 AND final NOT IN ('.', '!', '?') AS cut, substr(role, 1, 1) AS a FROM r),
        n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(twice) AS duplicate, count_if(cut) AS truncated FROM f GROUP BY conv_id),
        il AS (SELECT conv_id, count_if(p || a NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, a, lag(a) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM f) t WHERE p IS NOT NULL GROUP BY conv_id),
        ins(s, t, e, c, said) AS (VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 5, ['user:']), (0, 3, 'II', 10, ['user:', 'assistant:']),
            (1, 2, 'I', 5, ['user:']), (1, 3, 'II', 10, ['user:', 'assistant:']), (2, 3, 'I', 5, ['assistant:']), (3, 2, 'I', 5, ['user:'])),
        mv(s, initial, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        o AS (SELECT conv_id, i, s, s AS t, 'D' AS e, 2 AS c, []::VARCHAR[] AS said FROM f, (VALUES (0), (1), (2), (3)) x(s)
            UNION ALL SELECT conv_id, i, s, t, 'K', CASE WHEN cut THEN 5 ELSE 0 END, [role || ':' || text] FROM f JOIN mv ON initial = a WHERE NOT blank AND NOT twice
            UNION ALL SELECT conv_id, i, s, t, 'R', CASE WHEN cut THEN 6 ELSE 1 END, [CASE initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM f, mv WHERE initial <> 's' AND NOT blank AND NOT twice),
        st AS (SELECT o.conv_id, o.i, ins.s, o.t, ins.e || o.e AS e, ins.c + o.c AS c, list_concat(ins.said, o.said) AS said FROM o JOIN ins ON ins.t = o.s),
        w AS (SELECT conv_id, 0::BIGINT AS i, 0 AS t, 0 AS c, '' AS e, []::VARCHAR[] AS said FROM n
            UNION ALL SELECT conv_id, i, t, b.c, b.e, b.said FROM (SELECT w.conv_id, st.i, st.t, min(struct_pack(c := w.c + st.c, e := w.e || st.e, said := list_concat(w.said, st.said))) AS b
                FROM w JOIN st ON st.conv_id IS NOT DISTINCT FROM w.conv_id AND st.i = w.i + 1 AND st.s = w.t GROUP BY ALL) q),
        z AS (SELECT w.conv_id, min(struct_pack(c := w.c + ins.c, e := w.e || ins.e, said := list_concat(w.said, ins.said))) AS b FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i
            JOIN ins ON ins.s = w.t AND ins.t IN (0, 3) GROUP BY w.conv_id)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(array_to_string(b.said, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN il ON il.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op12_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
        v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        c AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total, v
            FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
        p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (total + v) AS p FROM c),
        q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (total + v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n, sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT AS total, any_value(v) AS v FROM c GROUP BY lang, term) x),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
        terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
            UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM terms)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op13_url_filter": """
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        rules(h, s, v) AS (VALUES """
    + ", ".join(f"('{h}', '{s}', '{v}')" for h, s, v in LISTED)
    + """), fit AS (SELECT host, path, max(struct_pack(n := length(h || s), blocks := v = 'block', rule := h || s, v := v)) AS m FROM (SELECT DISTINCT host, path FROM p) u
            JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY host, path)
        SELECT page_id, p.host, p.path, m.rule AS rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN fit ON fit.host = p.host AND fit.path = p.path""",
    "op3_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
}
