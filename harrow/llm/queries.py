"""Registered queries of the corpus operators and their DuckDB oracles."""
from __future__ import annotations

from .common import read


def op3_toxicity(spark, sf_dir):
    from .toxicity import toxicity
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op1_minhash_dedup(spark, sf_dir):
    from .minhash import near_duplicates
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    from .linededup import dedup_lines
    return dedup_lines(read(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    from .warc import round_trip
    return round_trip(read(spark, sf_dir, "pages"))


def op5_embedding_dedup(spark, sf_dir):
    from .flatgraph import near_vectors
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op6_lm_score(spark, sf_dir):
    from .pitmanyor import lm_scores
    return lm_scores(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    from .packing import packed
    return packed(read(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    from .tokencount import token_counts
    return token_counts(read(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    from .decontaminate import leak_report
    return leak_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_html_text(spark, sf_dir):
    from .htmltext import main_text
    return main_text(read(spark, sf_dir, "pages"))


def op11_sentencepiece(spark, sf_dir):
    from .piecetable import digests
    return digests(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark, sf_dir):
    from .cykrepair import conversation_repair
    return conversation_repair(read(spark, sf_dir, "conversations"))


def op13_collocations(spark, sf_dir):
    from .stripes import collocations
    return collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_lm_score": op6_lm_score,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_html_text": op10_html_text,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_collocations": op13_collocations,
}

# SHA-1 in hexadecimal to base32: 5 digits are 20 bits, that is 4 letters.
_BASE32 = """array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5))::BIGINT
        >> CAST(5 * (3 - i % 4) AS INT)) & 31 AS INT), 1)), '')"""

ORACLES = {
    "op4_warc": f"""
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        b AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to, url
        FROM p JOIN b USING (h)""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        usable AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
            AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        least_of AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
        n AS (SELECT x, count(*) AS k FROM links GROUP BY x)
        SELECT v.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, m AS component_id, v.vec_id = m AS kept
        FROM v JOIN least_of ON least_of.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id""",
    # The pages hold one article each, of headings and paragraphs; their references are &amp and &quot, some cut short.
    "op10_html_text": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
        b AS (SELECT page_id, url, list_filter(list_transform(
            string_split(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?(p|h1)>', chr(1), 'g'), chr(1)),
            lambda t: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
                                          '\s+', ' ', 'g'))), lambda t: t <> '') AS l FROM a),
        c AS (SELECT page_id, url, coalesce(array_to_string(l, chr(10)), '') AS text FROM b)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c""",
    # Equal rows of a turn are in the order of the hashes of role and text; the crc32 is that of the key's ASCII text.
    "op12_conversation_repair": r"""
        WITH n AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, coalesce(CAST(turn AS VARCHAR), ' ') AS t,
            coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
        bytes AS (SELECT *, list_transform(range(strlen(c || ':' || t)), lambda i: ascii(substr(c || ':' || t, CAST(i + 1 AS INT), 1))) AS b FROM n),
        k AS (SELECT conv_id, turn, c, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda crc, x:
            xor(crc >> 8, list_reduce(list_prepend((xor(crc, x) & 255)::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))), 4294967295) % 20 AS k FROM bytes),
        d AS (SELECT conv_id, turn, c, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
            CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(role || ':' || text), copy) AS i FROM d),
        f AS (SELECT *, left(role, 1) AS a, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
            row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
            lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM o),
        g AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
        s AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (before IS NOT NULL AND before || a NOT IN ('su', 'ua', 'au')) AS illegal,
            list([a, fault] ORDER BY i) AS steps FROM g GROUP BY c),
        -- Best way into each state (start, after s, after u, after a), as its cost in nine digits and its audit; '~' for none.
        x AS (SELECT *, list_reduce(list_prepend(['000000000', '~', '000000002I', '000000004II'], steps), lambda best, r:
            list_transform([list_transform([0, 1, 2, 3], lambda q: list_min(list_concat(
                CASE WHEN best[q + 1] <> '~' THEN [printf('%09d', CAST(left(best[q + 1], 9) AS INT) + 3) || substr(best[q + 1], 10) || 'D'] ELSE ['~'] END,
                CASE WHEN r[2] IN ('blank', 'duplicate') THEN ['~'] ELSE list_concat(list_transform(
                    CASE q WHEN 1 THEN [best[1]] WHEN 2 THEN [best[1], best[2], best[4]] WHEN 3 THEN [best[3]] ELSE [] END, lambda b:
                        CASE WHEN b = '~' OR r[1] <> substr('_sua', CAST(q + 1 AS INT), 1) THEN '~'
                            ELSE printf('%09d', CAST(left(b, 9) AS INT) + CASE r[2] WHEN 'truncated' THEN 1 ELSE 0 END) || substr(b, 10) || 'K' END),
                    list_transform(CASE q WHEN 2 THEN [best[1], best[2], best[4]] WHEN 3 THEN [best[3]] ELSE [] END, lambda b:
                        CASE WHEN b = '~' THEN '~' ELSE printf('%09d', CAST(left(b, 9) AS INT) + 2 + CASE r[2] WHEN 'truncated' THEN 1 ELSE 0 END) || substr(b, 10) || 'R' END)) END)))],
            -- Insertions after the row: one u, one a, or both.
            lambda e: [e[1], e[2],
                least(e[3], CASE WHEN e[1] = '~' THEN '~' ELSE printf('%09d', CAST(left(e[1], 9) AS INT) + 2) || substr(e[1], 10) || 'I' END,
                    CASE WHEN e[2] = '~' THEN '~' ELSE printf('%09d', CAST(left(e[2], 9) AS INT) + 2) || substr(e[2], 10) || 'I' END,
                    CASE WHEN e[4] = '~' THEN '~' ELSE printf('%09d', CAST(left(e[4], 9) AS INT) + 2) || substr(e[4], 10) || 'I' END),
                least(e[4], CASE WHEN e[1] = '~' THEN '~' ELSE printf('%09d', CAST(left(e[1], 9) AS INT) + 4) || substr(e[1], 10) || 'II' END,
                    CASE WHEN e[2] = '~' THEN '~' ELSE printf('%09d', CAST(left(e[2], 9) AS INT) + 4) || substr(e[2], 10) || 'II' END,
                    CASE WHEN e[3] = '~' THEN '~' ELSE printf('%09d', CAST(left(e[3], 9) AS INT) + 2) || substr(e[3], 10) || 'I' END)])[1]) AS best FROM s),
        y AS (SELECT *, least(best[1], best[4]) AS won FROM x),
        z AS (SELECT *, CAST(left(won, 9) AS BIGINT) AS cost, substr(won, 10) AS audit FROM y),
        letters AS (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS j, unnest(string_split(audit, '')) AS e FROM z WHERE audit <> ''),
        placed AS (SELECT c, j, e, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w - 1 AS place,
            count(*) FILTER (e <> 'D') OVER (PARTITION BY c) % 2 AS s FROM letters WINDOW w AS (PARTITION BY c ORDER BY j)),
        lines AS (SELECT p.c, p.place, CASE p.e WHEN 'K' THEN g.role ELSE CASE WHEN (p.place - p.s) % 2 = 0 THEN 'user' ELSE 'assistant' END END
            || ':' || CASE p.e WHEN 'I' THEN '' ELSE g.text END AS line FROM placed AS p LEFT JOIN g ON g.c = p.c AND g.i = p.i WHERE p.e <> 'D'),
        whole AS (SELECT c, string_agg(line, chr(10) ORDER BY place) AS t FROM lines GROUP BY c)
        SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
            coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
            coalesce(audit, '') AS audit, sha256(coalesce(whole.t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, c FROM n) AS ids LEFT JOIN z ON z.c = ids.c LEFT JOIN whole ON whole.c = ids.c""",
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^ \x09]+') AS w FROM p),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k),
        f AS MATERIALIZED (SELECT lang, k, phrase, lang || chr(10) || phrase AS id, count(*) AS f FROM g GROUP BY ALL HAVING k = 1 OR count(*) >= 10),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        longer AS (SELECT lang || chr(10) || phrase AS id, max(a) AS m FROM (
            SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
            UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
        cut AS MATERIALIZED (SELECT lang, phrase, a, i, lang || chr(10) || array_to_string(w[1:i], ' ') AS x,
            lang || chr(10) || array_to_string(w[i + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
        half AS MATERIALIZED (SELECT cut.*, f.f AS l FROM cut JOIN f ON f.id = cut.x),
        cuts AS MATERIALIZED (SELECT half.*, f.f AS r, (1000000::HUGEINT * a * a) // (l::HUGEINT * f.f) AS score FROM half JOIN f ON f.id = half.y),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
        kept AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
            FROM best AS b LEFT JOIN longer AS g ON g.id = b.lang || chr(10) || b.phrase WHERE g.m IS NULL OR 100 * g.m < 50 * a)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept JOIN n USING (lang) WHERE rank <= 2000""",
}
