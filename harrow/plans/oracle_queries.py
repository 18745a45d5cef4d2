"""DuckDB oracle SQL for every catalog query."""
from __future__ import annotations

from .. import config as C
from ..config import TEST
from ..operators.extract import FIELD_ORDER
from . import oracle as O
from .catalog import CAP_SMALL, FOLLOWING, PROG_COLS, RUN_DATE, RUN_TS

q = O.q


STATUS = "(CASE WHEN page_id % 11 = 5 THEN 404 WHEN page_id % 13 = 6 THEN 503 ELSE 200 END)"
KIND = ("(CASE WHEN page_id % 7 = 3 THEN 'application/pdf' WHEN page_id % 5 = 1 THEN 'Application/XHTML+xml' "
        "WHEN page_id % 17 = 2 THEN NULL ELSE 'text/html; charset=utf-8' END)")
FAILURE = f"(CASE WHEN page_id % 13 = 6 THEN '503 Server Error' WHEN {STATUS} >= 400 THEN 'HTTP status ' || {STATUS} END)"
IS_HTML = (f"({FAILURE} IS NULL AND (contains(lower(coalesce({KIND}, '')), 'text/html') "
           f"OR contains(lower(coalesce({KIND}, '')), 'application/xhtml')))")


LIMITED = TEST.with_(**C.CRAWL_LIMITS)


def _content_cte(src: str = "pages", name: str = "content", cfg=TEST) -> str:
    """Parsed + scored pages, URL normalised (all rows of ``src``)."""
    sc = O.score_cols("title", "url", "text", cfg)
    return f"""
{name}_n AS (SELECT page_id, {O.normalise_url('url')} AS url, html FROM {src}),
{name}_l AS (SELECT page_id, url, html, {O.lexical('html')} AS lex FROM {name}_n),
{name}_c AS (SELECT *, {O.cleaned('lex')} AS clean FROM {name}_l),
{name}_p AS (SELECT page_id, url, coalesce(length(html), 0) > 0 AS has_html,
    {O.title_text(O.inner('clean', 'title'))} AS title, {O.heading('lex')} AS heading,
    {O.markup_text('clean')} AS text, {O.links('clean', 'url')} AS links FROM {name}_c),
{name} AS (SELECT *, sc.candidate_score AS candidate_score, sc.matched AS matched_keywords,
    sc.candidate_type AS candidate_type, sc.reason AS reason FROM (SELECT *, {sc} AS sc FROM {name}_p))"""


def _targets_cte() -> str:
    nurl = O.normalise_url("url")
    return f"""
sites AS (SELECT site, min(url) AS seed_url FROM (SELECT url, lower({O.part(nurl, 2)}) AS site,
    {O.scheme(nurl)} AS sch FROM pages) WHERE sch IN ('http', 'https') GROUP BY site),
targets_raw AS (SELECT n AS target_idx, CASE WHEN n % 3 = 1 THEN ' Site ' || site || chr(9) ELSE 'Site ' || site END AS name,
    'Testland' AS country, seed_url, CASE WHEN n % 3 = 1 THEN ' ' ELSE {O.normalise_domain('seed_url')} END AS allowed_domain, '' AS notes
    FROM (SELECT *, (row_number() OVER (ORDER BY site) - 1)::BIGINT AS n FROM sites)),
targets AS (SELECT target_idx, coalesce({O.ustrip('name')}, '') AS name, coalesce({O.ustrip('country')}, '') AS country,
    coalesce({O.ustrip('seed_url')}, '') AS seed_url,
    CASE WHEN coalesce({O.ustrip('allowed_domain')}, '') <> '' THEN {O.ustrip('allowed_domain')}
         ELSE {O.normalise_domain('seed_url')} END AS allowed_domain,
    coalesce({O.ustrip('notes')}, '') AS notes FROM targets_raw)"""


def _edges_cte(following: int = 0) -> str:
    """Seed -> each k-th capture of the site, and these -> the captures up to the next; k is the rounded up root of the number.

    Also each capture -> ``following`` captures after it.
    """
    chain = "".join(f" UNION ALL\n    SELECT url, lead(url, {i}) OVER (PARTITION BY site ORDER BY page_id) FROM pg1" for i in range(1, following + 1))
    queued = O.should_enqueue("nurl", "dom", TEST)
    return f"""
pg0 AS (SELECT page_id, url, {O.normalise_url('url')} AS nurl FROM pages),
pg1 AS (SELECT *, lower({O.part('nurl', 2)}) AS site, {O.normalise_domain('nurl')} AS dom, {O.scheme('nurl')} IN ('http', 'https') AS web FROM pg0),
pg2 AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN {queued} THEN 0 ELSE 1 END, page_id) - 1 AS rk,
    ceil(sqrt(count(*) OVER (PARTITION BY site)))::BIGINT AS k, min(url) FILTER (web) OVER (PARTITION BY site) AS seed FROM pg1),
edges_raw AS (SELECT seed AS src, url AS dst FROM pg2 WHERE rk % k = 0 AND seed IS NOT NULL UNION ALL
    SELECT last_value(CASE WHEN rk % k = 0 THEN url END IGNORE NULLS) OVER (PARTITION BY site ORDER BY rk) AS src,
        CASE WHEN rk % k <> 0 THEN url END AS dst FROM pg2{chain}),
edges AS (SELECT {O.normalise_url('src')} AS src, {O.normalise_url('dst')} AS dst FROM edges_raw WHERE dst IS NOT NULL)"""


def _job_ctes(cap: int | None = None, fallback: bool = False, robots: bool = False, cfg=TEST, following: int = 0) -> str:
    cap = cap or cfg.max_pages
    l = O.v()
    enq_l = O.should_enqueue(l, "domain", TEST)
    enq_e = O.should_enqueue("e.dst", "p.domain", TEST)
    detail_src = "content"
    extra = ""
    if fallback:
        nurl = O.normalise_url("url")
        extra = f""",
site_rank AS (SELECT site, (dense_rank() OVER (ORDER BY site) - 1) AS rk FROM (SELECT DISTINCT lower({O.part(nurl, 2)}) AS site FROM pages)),
pages_emptied AS (SELECT p.page_id, p.url, CASE WHEN s.rk % 3 = 0 THEN '' ELSE p.html END AS html
    FROM pages p JOIN site_rank s ON lower({O.part(O.normalise_url('p.url'), 2)}) = s.site),
{_content_cte('pages_emptied', 'dcontent', cfg)[1:]}"""
        detail_src = "dcontent"
    levels = []
    prev_vis = "vis0"
    prev_lvl = "v0"
    for depth in range(1, C.CRAWL_DEPTH_LIMIT + 1):
        levels.append(f"""
par{depth} AS (SELECT v.target_idx, v.domain, v.url, v.visit_rank AS parent_rank, c.links
    FROM {prev_lvl} v JOIN jc c ON v.url = c.url WHERE c.is_html{f" AND {_allowed('v.')}" if robots else ""}),
fr{depth} AS (SELECT target_idx, domain, parent_rank, unnest(list_filter(links, lambda {l}: {enq_l})) AS url FROM par{depth}
    UNION ALL SELECT p.target_idx, p.domain, p.parent_rank, e.dst AS url FROM par{depth} p JOIN edges e ON p.url = e.src
    WHERE {enq_e}),
fresh{depth} AS (SELECT target_idx, domain, url, min(parent_rank) AS parent_rank FROM fr{depth} f
    WHERE NOT EXISTS (SELECT 1 FROM {prev_vis} x WHERE x.target_idx = f.target_idx AND x.url = f.url)
    GROUP BY target_idx, domain, url),
base{depth} AS (SELECT target_idx, max(visit_rank) AS b FROM {prev_vis} GROUP BY target_idx),
v{depth} AS (SELECT * FROM (SELECT f.target_idx, f.domain, f.url, {depth} AS depth,
    (b.b + row_number() OVER (PARTITION BY f.target_idx ORDER BY f.parent_rank, f.url))::INTEGER AS visit_rank
    FROM fresh{depth} f JOIN base{depth} b ON f.target_idx = b.target_idx){f" WHERE visit_rank <= {cap}" if cap else ""}),
vis{depth} AS (SELECT * FROM {prev_vis} UNION ALL SELECT * FROM v{depth})""")
        prev_vis, prev_lvl = f"vis{depth}", f"v{depth}"
    fields = ",\n    ".join(f"{O.first_match('detail_text', TEST.field_patterns.get(f, []), cfg.match_chars)} AS {f}" for f in FIELD_ORDER)
    review = [("Programme Name", "nm.name"), ("Programme Dates", "programme_dates"),
              ("Application Deadline", "application_deadline"), ("Programme Fee", "programme_fee"),
              ("Housing", "housing"), ("Eligibility", "eligibility"), ("Source URL", "url")]
    missing = "list_filter([" + ", ".join(
        f"CASE WHEN {O.is_missing(c)} THEN {q(n)} END" for n, c in review) + "], lambda m: m IS NOT NULL)"
    kw = O.contains_count("lower(detail_text)", TEST.high_keywords)
    unknown_cols = ", ".join(f"'Unknown' AS {c}" for c in [
        "programme_type", "target_students", "language", "duration_period", "programme_dates",
        "application_deadline", "programme_fee", "housing", "credits_certificate", "main_contents", "eligibility"])
    fb_name = O.infer_name("page_title", "''", "url", cfg)
    return f"""
{_content_cte(cfg=cfg)[1:]},
{_targets_cte()[1:]},
{_edges_cte(following)[1:]}{extra},{_robots_ctes()[1:] + "," if robots else ""}
scope_keys AS (SELECT DISTINCT c.url, c.page_id FROM content c, (SELECT DISTINCT {O.normalise_domain('allowed_domain')} AS d FROM targets) t
    WHERE {O.scheme('c.url')} IN ('http', 'https') AND {O.host_suffix_match(f"regexp_replace({O.host('c.url')}, '^www\\.', '', 'g')", 't.d')}),
winners AS (SELECT url, min(page_id) AS page_id FROM scope_keys GROUP BY url),
jc AS (SELECT c.*, {FAILURE.replace('page_id', 'c.page_id') if robots else 'NULL'} AS failure,
    {IS_HTML.replace('page_id', 'c.page_id') if robots else 'TRUE'} AS is_html FROM content c JOIN winners w ON c.url = w.url AND c.page_id = w.page_id),
dscope AS (SELECT DISTINCT c.url, c.page_id FROM {detail_src} c, (SELECT DISTINCT {O.normalise_domain('allowed_domain')} AS d FROM targets) t
    WHERE {O.scheme('c.url')} IN ('http', 'https') AND {O.host_suffix_match(f"regexp_replace({O.host('c.url')}, '^www\\.', '', 'g')", 't.d')}),
dwin AS (SELECT url, min(page_id) AS page_id FROM dscope GROUP BY url),
dc AS (SELECT c.* FROM {detail_src} c JOIN dwin w ON c.url = w.url AND c.page_id = w.page_id),
tt AS (SELECT target_idx, name, country, {O.normalise_domain('allowed_domain')} AS domain, {O.normalise_url('seed_url')} AS url FROM targets),
v0 AS (SELECT target_idx, domain, url, 0 AS depth, 1 AS visit_rank FROM tt WHERE NOT {O.should_skip('url', TEST)} AND {O.is_allowed('url', 'domain')}),
vis0 AS (SELECT * FROM v0),{','.join(levels)},
visits AS (SELECT * FROM {prev_vis}),
outcomes AS (SELECT v.*, c.page_id, c.title, c.candidate_score, c.matched_keywords, c.candidate_type, c.reason,
    {_allowed('v.') if robots else 'TRUE'} AS allowed, c.page_id IS NOT NULL AS captured, c.failure,
    coalesce(c.is_html, FALSE) AND {_allowed('v.') if robots else 'TRUE'} AS fetched
    FROM visits v LEFT JOIN jc c ON v.url = c.url),
cands AS (SELECT o.target_idx, t.name AS university_name, t.country, o.url, o.title AS page_title, o.candidate_score,
    o.matched_keywords, o.candidate_type, o.reason, 'Yes' AS needs_review, o.visit_rank,
    row_number() OVER (PARTITION BY o.target_idx ORDER BY o.candidate_score DESC, o.visit_rank) AS candidate_rank
    FROM outcomes o JOIN targets t ON o.target_idx = t.target_idx WHERE o.fetched AND o.candidate_score >= {C.MIN_CANDIDATE_SCORE}),
reads AS (SELECT k.*, d.page_id IS NOT NULL AS read_ok, coalesce(d.page_id IS NOT NULL AND d.has_html, FALSE) AS detail_has_html,
    d.title AS detail_title, d.heading AS detail_heading, d.text AS detail_text FROM cands k LEFT JOIN dc d ON k.url = d.url),
h0 AS (SELECT *, CASE WHEN detail_title <> '' THEN detail_title ELSE page_title END AS stitle FROM reads WHERE detail_has_html),
h1 AS (SELECT *, {O.infer_name('stitle', 'detail_heading', 'url', cfg)} AS nm,
    {O.programme_type('detail_text', 'url', TEST)} AS programme_type, {O.language('detail_text', TEST)} AS language,
    {O.housing('detail_text', TEST)} AS housing,
    {fields},
    {kw} AS kw FROM h0),
h2 AS (SELECT *, {missing} AS miss FROM h1),
h3 AS (SELECT *, {len(review)} - len(miss) AS present FROM h2),
heur AS (SELECT target_idx, university_name, country, nm.name AS programme_name, programme_type, target_students, language,
    duration_period, programme_dates, application_deadline, programme_fee, housing, credits_certificate, main_contents,
    eligibility, url AS source_url, stitle AS source_page_title,
    least(100, greatest(0, candidate_score + CASE WHEN nm.inferred THEN -8 ELSE 12 END + present * 8 + least(10, kw * 2)))::INTEGER AS confidence_score,
    array_to_string(miss, ', ') AS missing_fields,
    CASE WHEN candidate_score < {C.MIN_CANDIDATE_SCORE} OR (present <= 2 AND kw <= 1) THEN 'Low confidence'
         WHEN url <> '' AND nm.inferred AND len(miss) > 0 THEN 'Needs human review'
         WHEN nm.name <> '' AND url <> '' AND present >= 5 THEN 'Likely valid'
         ELSE 'Needs human review' END AS review_status,
    {q(RUN_DATE)} AS last_checked, 'heuristic' AS extraction_method,
    CASE WHEN nm.inferred THEN {q(C.INFERRED_NOTE)} ELSE '' END AS notes, candidate_rank FROM h3),
fb AS (SELECT target_idx, university_name, country, ({fb_name}).name AS programme_name, {unknown_cols},
    url AS source_url, page_title AS source_page_title, least(candidate_score, {C.FALLBACK_CONFIDENCE_CAP})::INTEGER AS confidence_score,
    {q(', '.join(C.FALLBACK_MISSING))} AS missing_fields, 'Needs human review' AS review_status, {q(RUN_DATE)} AS last_checked,
    'fallback' AS extraction_method, {q(C.FALLBACK_NOTE)} AS notes, candidate_rank
    FROM cands WHERE target_idx NOT IN (SELECT DISTINCT target_idx FROM heur){f' AND candidate_rank <= {cfg.fallback_top}' if cfg.fallback_top else ''}),
rows0 AS (SELECT *, row_number() OVER (ORDER BY target_idx, candidate_rank) AS row_idx FROM (SELECT * FROM heur UNION ALL BY NAME SELECT * FROM fb)),
rows1 AS (SELECT *, {O.name_key('programme_name')} AS nkey,
    CASE WHEN coalesce(source_url, '') <> '' THEN {O.normalise_url('source_url')} ELSE '' END AS ukey FROM rows0),
rows2 AS (SELECT *, {O.part('ukey', 2)} AS bnet, {O.block_path('ukey')} AS bpath, (nkey <> '' AND ukey <> '') AS elig FROM rows1),
{O.leader_ctes('rows2', C.DUPLICATE_RATIO, 'g')[1:]},{O.marks('gleader', 'rows4')},
marked AS (SELECT * EXCLUDE (review_status, nkey, ukey, bnet, bpath, elig, leader, group_no, gsize),
    CASE WHEN gsize > 1 THEN printf('DUP-%03d', group_no) ELSE '' END AS duplicate_group,
    CASE WHEN gsize = 1 THEN 'Unique' WHEN row_idx = leader THEN 'Primary' ELSE 'Duplicate' END AS duplicate_status,
    CASE WHEN gsize > 1 AND row_idx <> leader THEN 'Needs human review' ELSE review_status END AS review_status FROM rows4),
warn AS (SELECT o.target_idx, 1 AS phase, o.visit_rank AS rnk, t.name || ': ' || o.url || ': ' ||
    CASE WHEN o.captured THEN o.failure ELSE 'page not captured' END AS text
    FROM outcomes o JOIN targets t ON o.target_idx = t.target_idx WHERE o.allowed AND (NOT o.captured OR o.failure IS NOT NULL)
    UNION ALL SELECT r.target_idx, 2, r.candidate_rank, t.name || ': extraction failed for ' || r.url || ': page not captured'
    FROM reads r JOIN targets t ON r.target_idx = t.target_idx WHERE NOT r.read_ok
    UNION ALL SELECT t.target_idx, 0, 0, t.name || ': seed skipped: ' || t.seed_url || ' is not in the allowed domain or is on the skip list'
    FROM targets t WHERE target_idx NOT IN (SELECT target_idx FROM v0))"""


def _allowed(p: str) -> str:
    """Whether the robots rules let the visit be read (``p`` prefixes its columns)."""
    path = f"({O.part(p + 'url', 3)} || CASE WHEN {O.part(p + 'url', 4)} <> '' THEN '?' || {O.part(p + 'url', 4)} ELSE '' END)"
    return (f"coalesce((SELECT arg_min(r.allow, r.rule_pos) FROM rrules r WHERE r.target_idx = {p}target_idx "
            f"AND starts_with(CASE WHEN {path} = '' THEN '/' ELSE {path} END, r.rule_path)), TRUE)")


def _with(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes[1:] if ctes.startswith(chr(10)) else ctes}\n{body}"


def _job_query(body: str, **kw) -> str:
    return _with(_job_ctes(**kw), body)


def _run_log_sql(warnings: str) -> str:
    ts = RUN_TS.strftime("%Y-%m-%d %H:%M:%S UTC")
    return f"""SELECT {q(ts)} AS start_time, {q(ts)} AS end_time,
    (SELECT count(*) FROM targets)::BIGINT AS universities_processed,
    (SELECT count(DISTINCT target_idx) FROM cands)::BIGINT AS universities_with_candidates,
    (SELECT count(DISTINCT target_idx) FROM marked)::BIGINT AS universities_with_extracted_programmes,
    (SELECT count(*) FROM visits)::BIGINT AS total_pages_visited,
    (SELECT count(*) FROM cands)::BIGINT AS total_candidate_pages,
    (SELECT count(*) FROM reads WHERE read_ok)::BIGINT AS candidate_pages_read,
    (SELECT count(*) FROM marked)::BIGINT AS total_programme_rows,
    (SELECT count(*) FROM marked WHERE extraction_method = 'fallback')::BIGINT AS fallback_rows,
    (SELECT count(*) FROM marked WHERE duplicate_status = 'Duplicate')::BIGINT AS duplicate_rows,
    CASE WHEN (SELECT count(*) FROM warn) > 0 THEN 'Completed with warnings' ELSE 'Completed' END AS status,
    {warnings} AS warnings, '' AS errors"""


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    cnt = _content_cte()
    out["pages_normalised"] = (f"SELECT url, min(page_id) AS page_id FROM (SELECT page_id, {O.normalise_url('url')} AS url "
                               f"FROM pages) GROUP BY url")
    out["captures"] = f"SELECT page_id, {FAILURE} AS failure, {IS_HTML} AS is_html FROM pages"
    raw_text = f"""WITH l AS (SELECT page_id, html, {O.lexical('html')} AS lex FROM pages),
c AS (SELECT *, {O.cleaned('lex')} AS clean FROM l)"""
    out["page_text"] = raw_text + f"\nSELECT page_id, {O.title_text(O.inner('clean', 'title'))} AS title, {O.markup_text('clean')} AS text FROM c"
    out["page_heading"] = raw_text + f"\nSELECT page_id, {O.heading('lex')} AS heading FROM c"
    out["page_links"] = _with(cnt, "SELECT page_id, array_to_string(links, ' ') AS links, len(links) AS n_links FROM content")
    out["page_scores"] = _with(cnt, "SELECT page_id, url, candidate_score, array_to_string(matched_keywords, ', ') AS matched_keywords, "
                                    "candidate_type, reason FROM content")
    points = (f"least(100, high * {C.HIGH_WEIGHT} + low * {C.LOW_WEIGHT} + urls * {C.URL_WEIGHT})")
    tier = "CASE WHEN high > 0 THEN {0} WHEN low > 0 OR urls > 0 THEN {1} ELSE {2} END"
    out["page_scores_lexicon"] = _with(cnt, f"""
, words AS (SELECT unnest(regexp_split_to_array(lower(title), '[^\\p{{L}}]+')) AS term FROM content),
lex AS (SELECT DISTINCT 'high' AS kind, term FROM words WHERE length(term) >= 8
    UNION SELECT 'low', term FROM words WHERE length(term) BETWEEN 5 AND 7
    UNION SELECT 'url', lower({O.part('url', 2)}) FROM content
    UNION SELECT 'action', lower(right(title, 2)) FROM content WHERE length(title) > 40),
hay AS (SELECT page_id, lower(concat_ws(' ', coalesce(title, ''), url, coalesce(text, ''))) AS h, lower(url) AS u FROM content),
hit AS (SELECT page_id, kind, term FROM hay JOIN lex ON contains(CASE WHEN kind = 'url' THEN u ELSE h END, term)),
n AS (SELECT page_id, count(*) FILTER (kind = 'high') AS high, count(*) FILTER (kind = 'low') AS low, count(*) FILTER (kind = 'url') AS urls,
    count(*) FILTER (kind = 'action') AS act, string_agg(term, ', ' ORDER BY kind, term) FILTER (kind IN ('high', 'low')) AS terms FROM hit GROUP BY page_id),
p AS (SELECT hay.page_id, coalesce(high, 0) AS high, coalesce(low, 0) AS low, coalesce(urls, 0) AS urls, coalesce(act, 0) AS act, coalesce(terms, '') AS terms
    FROM hay LEFT JOIN n ON n.page_id = hay.page_id)
SELECT page_id, (CASE WHEN act > 0 THEN least(100, {points} + {C.ACTION_BONUS}) ELSE {points} END)::INTEGER AS candidate_score,
    terms AS matched_keywords, {tier.format(*[q(k[0]) for k in (C.STRONG, C.POSSIBLE, C.LOW)])} AS candidate_type,
    {tier.format(*[q(k[1]) for k in (C.STRONG, C.POSSIBLE, C.LOW)])} AS reason FROM p""")
    ex = cnt + ",\nex AS (SELECT page_id, url, unnest(links) AS link FROM content)"
    out["url_skip"] = _with(ex, f"SELECT page_id, link, {O.should_skip('link', TEST)} AS skip FROM ex")
    out["frontier_filter"] = _with(ex, f"SELECT page_id, link, {O.should_enqueue('link', O.normalise_domain('url'), TEST)} AS enqueue FROM ex")
    own = O.normalise_domain("url")
    out["domain_allowed"] = (f"SELECT page_id, {O.is_allowed('url', 'own')} AS allowed_own, "
                             f"{O.is_allowed('url', "regexp_replace(own, '^[^.]+\\.', '')")} AS allowed_parent, "
                             f"{O.is_allowed('url', O.normalise_domain(O.q('www.Example.com')))} AS allowed_example_com "
                             f"FROM (SELECT page_id, url, {own} AS own FROM pages)")
    out["targets_clean"] = _with(_targets_cte(), "SELECT * FROM targets")
    out["pages_per_target"] = _with(_targets_cte(), f"""SELECT t.target_idx, p.page_id FROM
    (SELECT page_id, regexp_replace({O.host(O.normalise_url('url'))}, '^www\\.', '', 'g') AS h FROM pages) p
    JOIN (SELECT target_idx, {O.normalise_domain('allowed_domain')} AS d FROM targets) t ON {O.host_suffix_match('p.h', 't.d')}""")
    out["programme_name"] = _with(cnt, f"SELECT page_id, nm.name AS programme_name, nm.inferred AS inferred FROM "
                                       f"(SELECT page_id, {O.infer_name('title', 'heading', 'url', TEST)} AS nm FROM content)")
    out["first_match"] = _with(cnt, "SELECT page_id, " + ", ".join(
        f"{O.first_match('text', TEST.field_patterns[f])} AS {f}" for f in FIELD_ORDER) + " FROM content")
    out["language_flag"] = _with(cnt, f"SELECT page_id, {O.language('text', TEST)} AS language FROM content")
    out["housing_flag"] = _with(cnt, f"SELECT page_id, {O.housing('text', TEST)} AS housing FROM content")
    out["programme_type"] = _with(cnt, f"SELECT page_id, {O.programme_type('text', 'url', TEST)} AS programme_type FROM content")
    docs = "(SELECT doc_id, text AS name, 'https://' || source AS url FROM documents)"
    out["dup_name_key"] = f"SELECT doc_id, {O.name_key('name')} AS name_key FROM {docs}"
    bk = O.normalise_url("url")
    out["dup_block_key"] = (f"SELECT page_id, CASE WHEN k <> '' THEN {O.part('k', 2)} END AS block_netloc, "
                            f"CASE WHEN k <> '' THEN {O.block_path('k')} END AS block_path FROM "
                            f"(SELECT page_id, CASE WHEN coalesce(url, '') <> '' THEN {bk} ELSE '' END AS k FROM pages)")
    out["near_dup_exact"] = f"""WITH d AS (SELECT doc_id AS row_idx, {O.name_key('name')} AS nkey,
    CASE WHEN coalesce(url, '') <> '' THEN {O.normalise_url('url')} ELSE '' END AS ukey FROM {docs}),
d2 AS (SELECT *, {O.part('ukey', 2)} AS bnet, {O.block_path('ukey')} AS bpath, (nkey <> '' AND ukey <> '') AS elig FROM d),
d3 AS (SELECT *, CASE WHEN elig THEN min(row_idx) OVER (PARTITION BY elig, bnet, bpath, nkey) ELSE row_idx END AS leader FROM d2),
ld AS (SELECT row_idx AS leader, row_number() OVER (ORDER BY row_idx) AS group_no FROM d3 WHERE leader = row_idx),
d4 AS (SELECT d3.*, ld.group_no, count(*) OVER (PARTITION BY d3.leader) AS gsize FROM d3 JOIN ld ON d3.leader = ld.leader)
SELECT row_idx AS doc_id, CASE WHEN gsize > 1 THEN printf('DUP-%03d', group_no) ELSE '' END AS duplicate_group,
    CASE WHEN gsize = 1 THEN 'Unique' WHEN row_idx = leader THEN 'Primary' ELSE 'Duplicate' END AS duplicate_status FROM d4"""
    out["crawl_visits"] = _job_query("SELECT target_idx, visit_rank, depth, url FROM visits")
    out["crawl_visits_limit4"] = _job_query("SELECT target_idx, visit_rank, depth, url FROM visits", cap=CAP_SMALL)
    out["crawl_visits_robots"] = _job_query("SELECT target_idx, visit_rank, depth, url FROM visits", robots=True, following=FOLLOWING)
    out["warnings"] = _job_query("SELECT target_idx, phase, rnk::BIGINT AS rank, text FROM warn", robots=True, following=FOLLOWING)
    near = f""",
named AS (SELECT page_id AS row_idx, ({O.infer_name('title', 'heading', 'url', TEST)}).name AS name,
    regexp_extract(url, '^([a-z]+://[^/]*(?:/[^/?#]*)?)', 1) AS addr FROM content),
named1 AS (SELECT row_idx, {O.name_key('name')} AS nkey, CASE WHEN addr <> '' THEN {O.normalise_url('addr')} ELSE '' END AS ukey FROM named),
named2 AS (SELECT *, {O.part('ukey', 2)} AS bnet, {O.block_path('ukey')} AS bpath, (nkey <> '' AND ukey <> '') AS elig FROM named1),
{O.leader_ctes('named2', C.DUPLICATE_RATIO, 'g')[1:]},{O.marks('gleader', 'numbered')}"""
    out["near_dup_difflib"] = _with(cnt + near, """SELECT row_idx AS page_id,
    CASE WHEN gsize > 1 THEN printf('DUP-%03d', group_no) ELSE '' END AS duplicate_group,
    CASE WHEN gsize = 1 THEN 'Unique' WHEN row_idx = leader THEN 'Primary' ELSE 'Duplicate' END AS duplicate_status FROM numbered""")
    out["candidates"] = _job_query("SELECT target_idx, candidate_rank, url, candidate_score, visit_rank FROM cands")
    out["candidate_report"] = _job_query(
        "SELECT target_idx, candidate_rank, university_name, country, url, page_title, candidate_score, "
        "array_to_string(matched_keywords, ', ') AS matched_keywords, candidate_type, reason, needs_review FROM cands")
    cols = ", ".join(PROG_COLS)
    out["programmes"] = _job_query(f"SELECT {cols} FROM marked")
    out["programme_rows"] = _job_query(f"SELECT {cols} FROM marked", fallback=True)
    out["fallback_rows"] = _job_query(
        "SELECT row_idx, target_idx, programme_name, source_url, confidence_score, review_status, notes FROM marked "
        "WHERE extraction_method = 'fallback'", fallback=True)
    colours = " ".join(f"WHEN cls = {q(n)} THEN {q(h)}" for n, h in C.HIGHLIGHT_COLOURS)
    out["row_highlight"] = _job_query(
        f"SELECT row_idx, CASE WHEN colour IS NOT NULL THEN cls END AS row_highlight, colour AS highlight_colour FROM "
        f"(SELECT row_idx, cls, CASE {colours} END AS colour FROM (SELECT row_idx, CASE WHEN duplicate_status = 'Duplicate' "
        f"THEN 'Duplicate' ELSE review_status END AS cls FROM marked))", fallback=True)
    out["target_summary"] = _job_query("""SELECT t.target_idx, t.name AS university_name,
    coalesce(v.n, 0)::BIGINT AS pages_visited, coalesce(c.n, 0)::BIGINT AS candidate_pages,
    coalesce(r.n, 0)::BIGINT AS programme_rows, coalesce(r.f, 0)::BIGINT AS fallback_rows FROM targets t
    LEFT JOIN (SELECT target_idx, count(*) AS n FROM visits GROUP BY 1) v ON t.target_idx = v.target_idx
    LEFT JOIN (SELECT target_idx, count(*) AS n FROM cands GROUP BY 1) c ON t.target_idx = c.target_idx
    LEFT JOIN (SELECT target_idx, count(*) AS n, sum(CASE WHEN extraction_method = 'fallback' THEN 1 ELSE 0 END) AS f
               FROM marked GROUP BY 1) r ON t.target_idx = r.target_idx""", following=FOLLOWING)
    out["run_log"] = _job_query(_run_log_sql("""CASE WHEN (SELECT count(*) FROM warn) > 0
        THEN (SELECT count(*) FROM warn) || ' in the warnings table' ELSE '' END"""))
    limits = {"cfg": LIMITED, "fallback": True, "robots": True}
    out["limited_visits"] = _job_query("SELECT target_idx, visit_rank, depth, url FROM visits", **limits)
    out["limited_candidates"] = _job_query(
        "SELECT target_idx, candidate_rank, university_name, country, url, page_title, candidate_score, "
        "array_to_string(matched_keywords, ', ') AS matched_keywords, candidate_type, reason, needs_review FROM cands", **limits)
    out["limited_rows"] = _job_query(f"SELECT {cols} FROM marked", **limits)
    out["limited_run_log"] = _job_query(_run_log_sql(f"""coalesce((SELECT string_agg(text, ' | ' ORDER BY target_idx, phase, rnk)
        FROM (SELECT * FROM warn ORDER BY target_idx, phase, rnk LIMIT {LIMITED.warnings_kept})), '')"""), **limits)
    out["targets_csv"] = _with(_targets_cte(), """SELECT target_idx, trim(name, ' ' || chr(9)) AS name, country, seed_url, allowed_domain,
    'a "note", Site ' || split_part(trim(name, ' ' || chr(9)), ' ', 2) || chr(10) || 'in two lines' AS notes FROM targets""")
    out.update(build_robots())
    return out


def _robots_ctes() -> str:
    from ..sources.robots import LINE_BREAKS

    nurl = O.normalise_url("url")
    sec = f"regexp_extract({nurl}, '^[a-z]+://[^/]+(/[^/?#]*)', 1)"
    body = ("'# robots' || chr(10) || 'User-agent: OtherBot' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || "
            "'User-agent: *' || chr(10) || 'Allow: ' || first_sec || chr(10) || 'Disallow: ' || last_sec || chr(10)")
    n = "' || chr(10) || '"
    several = (f"'Disallow: /orphan{n}{n}User-agent: OtherBot{n}User-agent: HARROW # this one{n}Crawl-delay: 3{n}Disallow: ' || last_sec || "
               f"' # note{n}Allow: ' || first_sec || '{n}Sitemap: https://x.test/s{n}{n}{n}User-agent: *{n}Disallow: /{n}User-agent: late{n}Allow: /{n}'")
    body = f"CASE WHEN target_idx % 4 = 1 THEN {several} ELSE {body} END"
    token = TEST.user_agent.split("/")[0].lower()
    stripped = "trim(regexp_replace(regexp_replace(raw, '#.*$', ''), '^\\s+|\\s+$', '', 'g'))"
    return f"""
rsite AS (SELECT site, arg_min(sec, page_id) AS first_sec, arg_max(sec, page_id) AS last_sec FROM
    (SELECT page_id, lower({O.part(nurl, 2)}) AS site, {sec} AS sec FROM pages) GROUP BY site),
tsite AS (SELECT target_idx, lower({O.part(O.normalise_url('seed_url'), 2)}) AS site FROM targets),
robots AS (SELECT t.target_idx, CASE WHEN t.target_idx % 5 = 4 THEN 404 ELSE 200 END AS status, {body} AS body
    FROM tsite t JOIN rsite r ON t.site = r.site),
rlines AS (SELECT target_idx, i - 1 AS pos, arr[i] AS raw FROM (SELECT target_idx, arr, unnest(range(1, len(arr) + 1)) AS i
    FROM (SELECT target_idx, regexp_split_to_array(body, {q(LINE_BREAKS)}) AS arr FROM robots WHERE status < 400 AND body IS NOT NULL))),
rtyped0 AS (SELECT target_idx, pos, raw, {stripped} AS st FROM rlines),
rtyped AS (SELECT target_idx, pos, kind, key, value FROM (SELECT target_idx, pos,
    lower(trim(split_part(st, ':', 1))) AS key, trim(regexp_extract(st, '^[^:]*:(.*)$', 1)) AS value,
    CASE WHEN raw = '' THEN 'blank'
         WHEN strpos(st, ':') > 0 AND lower(trim(split_part(st, ':', 1))) = 'user-agent' THEN 'agent'
         WHEN strpos(st, ':') > 0 AND lower(trim(split_part(st, ':', 1))) IN ('allow', 'disallow') THEN 'rule'
         WHEN strpos(st, ':') > 0 AND lower(trim(split_part(st, ':', 1))) IN ('crawl-delay', 'request-rate') THEN 'meta'
         ELSE 'skip' END AS kind FROM rtyped0) WHERE kind <> 'skip'),
rb AS (SELECT *, (kind = 'blank' OR (kind = 'agent' AND coalesce(lag(kind) OVER (PARTITION BY target_idx ORDER BY pos) IN ('rule', 'meta'), FALSE)))::INTEGER AS bnd FROM rtyped),
rseg AS (SELECT *, sum(bnd) OVER (PARTITION BY target_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM rb),
rseg2 AS (SELECT *, sum((kind = 'agent')::INTEGER) OVER (PARTITION BY target_idx, seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS agents_before FROM rseg),
rgroups AS (SELECT target_idx, seg,
    max(CASE WHEN kind = 'agent' AND value = '*' THEN 1 ELSE 0 END) AS is_default,
    max(CASE WHEN kind = 'agent' AND value <> '*' AND contains({q(token)}, lower(value)) THEN 1 ELSE 0 END) AS applies,
    max(CASE WHEN kind IN ('rule', 'meta') AND agents_before > 0 THEN 1 ELSE 0 END) AS added
    FROM rseg2 GROUP BY target_idx, seg HAVING added = 1),
rchoice AS (SELECT g.target_idx, g.seg, CASE WHEN g.is_default = 1 THEN 1 ELSE 0 END AS prio FROM rgroups g
    WHERE g.applies = 1 OR (g.is_default = 1 AND g.seg = (SELECT min(seg) FROM rgroups d WHERE d.target_idx = g.target_idx AND d.is_default = 1))),
rchosen AS (SELECT target_idx, seg FROM (SELECT *, row_number() OVER (PARTITION BY target_idx ORDER BY prio, seg) AS rn FROM rchoice) WHERE rn = 1),
rrules AS (SELECT s.target_idx, s.pos AS rule_pos, regexp_replace(s.value, '\\?$', '') AS rule_path,
    (s.key = 'allow' OR s.value = '') AS allow FROM rseg2 s JOIN rchosen c ON s.target_idx = c.target_idx AND s.seg = c.seg
    WHERE s.kind = 'rule' AND s.agents_before > 0)"""


def build_robots() -> dict[str, str]:
    rules_only = _with(_targets_cte() + "," + _robots_ctes(), "SELECT * FROM rrules")
    gate = _job_query(f"SELECT v.target_idx, v.url, {_allowed('v.')} AS allowed FROM visits v", following=FOLLOWING)
    gate = gate.replace("\nSELECT v.target_idx", "," + _robots_ctes() + "\nSELECT v.target_idx", 1)
    return {"robots_rules": rules_only, "robots_gate": gate}
