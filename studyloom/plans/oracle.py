"""The queries as DuckDB SQL over the same tables, written from their definitions, not from the plans."""

from __future__ import annotations

from ..operators import classify, cost, formatting, fusion, graph_build, history, spelling, tags
from . import queries as q

ORACLE_SQL: dict[str, str] = {}


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fuzzy(x: str, t: str) -> str:
    """The fuzzy rule, word for word."""
    near = f"5 * len([i FOR i IN range(1, length({t})) IF contains({x}, substr({t}, CAST(i AS BIGINT), 2))]) >= 3 * length({t})"
    return f"coalesce((length({t}) >= 3 AND contains({x}, {t})) OR (length({t}) >= 4 AND length({x}) > 0 AND {near}), false)"


def with_(*parts: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"
CHUNKS = r"""w AS (SELECT doc_id, source, lang, text, regexp_extract_all(lower(text), '\p{L}{5,}')[1:5] AS w FROM documents),
chunks AS (SELECT w.doc_id AS chunk_id, source AS video_id, CAST(w.doc_id % 7 + 1 AS INTEGER) AS part_no, source || ' ' || lang AS video_title, lang AS collection,
  w[1] AS short_title, substr(text, 1, 200) AS text_preview, w[1:3] AS topics, w[4:5] AS patterns, coalesce(quality = 1, false) AS has_brand_signal, coalesce(toxic = 1, false) AS has_warning
  FROM w LEFT JOIN labels USING (doc_id))"""
DAYS = "h AS (SELECT event_id AS id, user_id, event_type AS query, props AS diagnosis, event_type AS diagnosis_summary, value AS cost, ts AS created_at FROM events)"
QUARTERS = "o AS (SELECT o_orderkey AS id, o_custkey // 10 AS user_id, o_orderstatus || ' ' || o_orderpriority AS query, o_totalprice AS cost, o_orderdate AS created_at FROM orders)"
PERIOD = "(year(created_at) || '-Q' || quarter(created_at))"
OLD = f"created_at < TIMESTAMP '{q.AS_OF_QUARTERS}' - INTERVAL 90 DAY"
PROFILES = """users AS (SELECT c_custkey AS user_id, c_mktsegment AS grade, 'school ' || c_nationkey AS school, c_name AS name FROM customer),
profiles AS (SELECT c_custkey AS user_id, [c_mktsegment] AS weak, CASE WHEN c_acctbal > 5000 THEN ['basics'] END AS mastered, CASE WHEN c_acctbal > 4000 THEN 'pass' END AS goals FROM customer WHERE c_acctbal >= 2000)"""

# scans and filters
ORACLE_SQL["scan_project_default"] = """SELECT doc_id, substr(text, 1, 30) AS head, CAST(length(text) AS INTEGER) AS n, coalesce(quality, -1) AS quality,
  coalesce(nullif(nullif(lang, 'en'), ''), 'default') AS lang FROM documents LEFT JOIN labels USING (doc_id)"""
ORACLE_SQL["filter_eq_range"] = f"""SELECT 'recent' AS part, event_id AS id FROM events WHERE ts >= TIMESTAMP '{q.AS_OF_DAYS}' - INTERVAL 7 DAY AND event_type = 'click'
UNION ALL SELECT 'month', o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{q.MONTH}-01' AND o_orderdate < TIMESTAMP '{q.MONTH}-01' + INTERVAL 1 MONTH
UNION ALL SELECT 'old', o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' - INTERVAL 90 DAY"""
ORACLE_SQL["fuzzy_contains"] = f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}{{5,}}')[1] AS target FROM documents)
SELECT item_id AS query_id, count(*) AS n, min(doc_id) AS first_doc, CAST(sum(doc_id) AS DOUBLE) AS sum_doc FROM benchmark b JOIN t ON {fuzzy("b.text", "t.target")} GROUP BY 1"""


def any_of(words: list[str]) -> str:
    return " OR ".join(f"contains(text, {text(w)})" for w in words)


_complexity = "CASE " + " ".join(f"WHEN {any_of(classify.COMPLEXITY[k])} THEN '{k}'" for k in ("diagnostic", "complex", "simple")) + f" WHEN length(text) < {classify.SHORT} THEN 'simple' ELSE 'normal' END"
_hits = {g: " + ".join(f"CAST(contains(text, {text(w)}) AS INTEGER)" for w in ws) for g, ws in classify.GRADES.items()}
_grade = f"CASE WHEN greatest({', '.join(_hits.values())}) = 0 THEN 'unknown' " + " ".join(f"WHEN {h} = greatest({', '.join(_hits.values())}) THEN '{g}'" for g, h in _hits.items()) + " END"
ORACLE_SQL["keyword_any_case"] = f"SELECT doc_id, {_complexity} AS complexity FROM documents"
ORACLE_SQL["grade_argmax"] = f"SELECT doc_id, {_grade} AS grade FROM documents"

# vectors
DOT = "round(list_sum([CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE) FOR p IN list_zip({a}, {b})]), 6)"
ORACLE_SQL["knn_topk"] = f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {DOT.format(a="a.embedding", b="b.embedding")} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id IN (SELECT item_id FROM benchmark)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 30"""
ORACLE_SQL["vector_index_clusters"] = "SELECT count(*) AS n_vectors, count(DISTINCT vec_id) AS n_pos, CAST(0 AS BIGINT) AS n_wrong FROM embeddings"
ORACLE_SQL["l2_normalize"] = """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) * 2 FOR x IN embedding] AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum([x * x FOR x IN e])) AS norm FROM v)
SELECT vec_id, round(norm, 5) AS norm, round(e[1] / norm, 5) AS first, CAST(1.0 AS DOUBLE) AS unit_norm FROM n"""

# lexical channel
TFIDF = r"""terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
dw AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id),
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM benchmark),
qw AS (SELECT query_id, term, count(*) * any_value(idf) AS w FROM qt JOIN idf USING (term) GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY query_id),
lx0 AS (SELECT query_id, doc_id AS chunk_id, round(sum(qw.w * dw.w) / (any_value(qn.norm) * any_value(dn.norm)), 6) AS score FROM qw JOIN dw USING (term) JOIN qn USING (query_id) JOIN dn USING (doc_id) GROUP BY ALL),
lx AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS INTEGER) AS rank FROM lx0 WHERE score > 0 QUALIFY rank <= 10)"""
TFIDF = TFIDF.replace("ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*)))", "ln(CAST(1 + (SELECT count(*) FROM documents) AS DOUBLE) / (1 + count(*)))")
ORACLE_SQL["tfidf_topk"] = with_(TFIDF, body="SELECT query_id, chunk_id, score, rank FROM lx")

ORACLE_SQL["lexical_lexicon"] = with_(
    TFIDF, body="SELECT term, count(*) AS df, round(any_value(idf), 6) AS idf, round(max(w / norm), 6) AS top FROM dw JOIN dn USING (doc_id) JOIN idf USING (term) GROUP BY term"
)

# tag channel
P = tags.POINTS
TAGS = f"""tg AS (SELECT chunk_id, 'topic' AS kind, unnest(topics) AS tag FROM chunks UNION ALL SELECT chunk_id, 'pattern', unnest(patterns) FROM chunks),
nd AS (SELECT t AS node_id, coalesce(min(p), '') AS cause, coalesce(max(p), '') AS symptom FROM (SELECT unnest(topics) AS t, patterns[1] AS p FROM chunks) GROUP BY t),
pt AS (SELECT p AS pattern_id, coalesce(min(t), '') AS name FROM (SELECT unnest(patterns) AS p, topics[1] AS t FROM chunks) GROUP BY p),
aims AS (SELECT DISTINCT tag AS target FROM tg UNION SELECT cause FROM nd UNION SELECT symptom FROM nd UNION SELECT name FROM pt),
near AS (SELECT query_id, target FROM queries JOIN aims ON {fuzzy("queries.text", "aims.target")}),
mn AS (SELECT DISTINCT query_id, node_id FROM nd JOIN near ON target IN (node_id, cause, symptom)), mp AS (SELECT DISTINCT query_id, pattern_id FROM pt JOIN near ON target IN (pattern_id, name)),
pts AS (SELECT query_id, chunk_id, {P["topic"]} AS p FROM tg JOIN mn ON kind = 'topic' AND tag = node_id UNION ALL SELECT query_id, chunk_id, {P["pattern"]} FROM tg JOIN mp ON kind = 'pattern' AND tag = pattern_id
  UNION ALL SELECT query_id, chunk_id, CASE kind WHEN 'topic' THEN {P["near_topic"]} ELSE {P["near_pattern"]} END FROM tg JOIN near ON tag = target),
tc0 AS (SELECT query_id, chunk_id, CAST(sum(p) AS BIGINT) AS score FROM pts GROUP BY ALL),
tc AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM tc0 QUALIFY rank <= 30)"""
ORACLE_SQL["tag_score_topk"] = with_(QUERIES, CHUNKS, TAGS, body="SELECT query_id, chunk_id, score, rank FROM tc")

# fusion, rerank
VECTOR = f"""vc0 AS (SELECT query_id, b.vec_id AS chunk_id, {DOT.format(a="a.embedding", b="b.embedding")} AS score FROM queries JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON true),
vc AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM vc0 QUALIFY rank <= 30)"""
WT = fusion.WEIGHTS


def fused(where: str = "true") -> str:
    only = f"WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE {where})"
    return f"""hits AS (SELECT query_id, chunk_id, rank, 0 AS nr, 'vector' AS channel, {WT["vector"]} AS weight FROM vc {only} UNION ALL SELECT query_id, chunk_id, rank, 1, 'tag', {WT["tag"]} FROM tc {only}
  UNION ALL SELECT query_id, chunk_id, rank, 2, 'tfidf', {WT["tfidf"]} FROM lx {only}),
fu0 AS (SELECT query_id, chunk_id, round(sum(CAST(weight AS DOUBLE) / ({fusion.K} + rank)), 9) AS rrf_score, min(nr) AS nr, arg_min(rank, nr) AS place, arg_min(channel, nr) AS first_channel FROM hits GROUP BY ALL),
fu AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, nr, place) AS INTEGER) AS fused_rank FROM fu0),
rr0 AS (SELECT fu.*, c.* EXCLUDE (chunk_id), queries.text AS qt, array_to_string(coalesce(c.topics, []), ' ') AS kts FROM fu LEFT JOIN chunks c USING (chunk_id) JOIN queries USING (query_id)),
rr1 AS (SELECT *, round(CASE WHEN coalesce(has_brand_signal, false) THEN 0.05 ELSE 0 END + CASE WHEN coalesce(has_warning, false) THEN 0.03 ELSE 0 END + CASE WHEN {fuzzy("qt", "text_preview")} THEN 0.02 ELSE 0 END
  + CASE WHEN {fuzzy("kts", "qt")} OR {fuzzy("qt", "kts")} THEN 0.02 ELSE 0 END, 2)::DOUBLE AS rerank_bonus FROM rr0),
rr AS (SELECT *, round(rrf_score + rerank_bonus, 9) AS final_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score + rerank_bonus, 9) DESC, fused_rank) AS INTEGER) AS final_rank FROM rr1)"""


CHANNELS = (QUERIES, CHUNKS, TFIDF, TAGS, VECTOR)
# for fusion all hits count, also those without a chunk
ALL = fused().replace("WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE true)", "")
ORACLE_SQL["rrf_fusion"] = with_(*CHANNELS, ALL, body="SELECT query_id, chunk_id, first_channel, rrf_score, fused_rank FROM fu")
ORACLE_SQL["rerank_bonus"] = with_(*CHANNELS, ALL, body="SELECT query_id, chunk_id, rrf_score, rerank_bonus, final_score, final_rank FROM rr")
ORACLE_SQL["hybrid_retrieve"] = with_(*CHANNELS, ALL, body="SELECT query_id, chunk_id, first_channel, final_score, final_rank, video_id, part_no FROM rr WHERE final_rank <= 10")
ORACLE_SQL["hybrid_retrieve_filtered"] = with_(*CHANNELS, fused("collection = 'en'"), body="SELECT query_id, chunk_id, first_channel, final_score, final_rank FROM rr WHERE final_rank <= 10")

# lookups
ORACLE_SQL["lookup_left_default"] = "SELECT p_partkey AS hit, coalesce(n_name, '') AS category FROM part LEFT JOIN nation ON n_nationkey = p_size % 30"
ORACLE_SQL["first_match_inner"] = """WITH f AS (SELECT n_regionkey, arg_min(n_name, n_nationkey) AS name FROM nation GROUP BY 1) SELECT p_partkey AS hit, name FROM part JOIN f ON n_regionkey = p_size % 7"""

# graph
EDGES = """ed AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS place FROM (SELECT p_partkey AS k, unnest([p_partkey // 2, p_partkey // 3, p_partkey - 7]) AS p, unnest([1, 2, 3]) AS i FROM part) WHERE p > 0)"""
ORACLE_SQL["bfs_prereqs"] = with_(
    EDGES,
    """walk AS (SELECT p_partkey AS query_id, p_partkey AS node_id, 0 AS depth, CAST([] AS BIGINT[]) AS path FROM part
  UNION ALL SELECT query_id, p, depth + 1, list_append(path, place) FROM walk JOIN ed ON node_id = k WHERE depth < 3)""",
    "best AS (SELECT query_id, node_id, depth, path, row_number() OVER (PARTITION BY query_id, node_id ORDER BY depth, path) AS nr FROM walk WHERE depth > 0 AND node_id <> query_id)",
    body="SELECT query_id, node_id, depth, array_to_string(path, '/') AS path FROM best WHERE nr = 1",
)

# diagnosis: all of the above
_top = """{n} AS (SELECT query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT query_id, vec_id, {key} AS key, {dot} AS score
  FROM queries JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON true JOIN {table} ON {on} = b.vec_id))"""
_dot = DOT.format(a="a.embedding", b="b.embedding").replace("vec_id", "b.vec_id")


def _near(name: str, table: str, on: str, key: str) -> str:
    return _top.format(n=name, key=key, dot=_dot, table=table, on=on).replace("SELECT query_id, vec_id,", "SELECT query_id, b.vec_id AS vec_id,")


ORACLE_SQL["diagnose_full"] = with_(
    *CHANNELS,
    ALL,
    EDGES,
    _near("nh", "part", "p_partkey", "p_partkey"),
    _near("ph", "nation", "n_nationkey", "n_name"),
    _near("th", "region", "r_regionkey", "r_name"),
    f"qs AS (SELECT query_id, {_grade} AS grade, {_complexity} AS complexity FROM queries)",
    "lim AS (SELECT *, CASE grade WHEN 'first' THEN 1 WHEN 'third' THEN 3 ELSE 2 END AS most FROM qs)",
    "roots AS (SELECT query_id, key AS node_id, rank - 1 AS root_at FROM nh WHERE rank <= 3)",
    """walk AS (SELECT r.query_id, r.node_id, 0 AS depth, [CAST(root_at AS BIGINT)] AS path FROM roots r
  UNION ALL SELECT walk.query_id, p, depth + 1, list_append(path, place) FROM walk JOIN ed ON node_id = k JOIN lim ON lim.query_id = walk.query_id WHERE depth < most)""",
    """seen AS (SELECT w.query_id, w.node_id, w.depth, w.path, row_number() OVER (PARTITION BY w.query_id, w.node_id ORDER BY w.depth, w.path) AS nr FROM walk w LEFT JOIN roots r ON r.query_id = w.query_id AND r.node_id = w.node_id
  WHERE w.depth > 0 AND (r.node_id IS NULL OR (w.depth = 1 AND w.path[1] < r.root_at)))""",
    "chain AS (SELECT query_id, list(node_id ORDER BY depth, path) AS c FROM seen WHERE nr = 1 GROUP BY query_id)",
    "top8 AS (SELECT * FROM rr WHERE final_rank <= 8)",
    "vids AS (SELECT query_id, least(count(DISTINCT video_id || '#' || part_no), 5) AS n FROM top8 WHERE coalesce(video_id, '') <> '' GROUP BY 1)",
    body="""SELECT lim.query_id, grade, complexity,
  coalesce((SELECT string_agg(CAST(key AS VARCHAR), ',' ORDER BY rank) FROM nh WHERE nh.query_id = lim.query_id AND rank <= 3), '') AS related_nodes,
  coalesce(array_to_string(c[1:CASE grade WHEN 'first' THEN 2 ELSE 3 END], ','), '') AS missing_prereqs, CAST(coalesce(len(c), 0) AS INTEGER) AS n_chain,
  coalesce((SELECT string_agg(key, ',' ORDER BY rank) FROM ph WHERE ph.query_id = lim.query_id AND rank <= 2), '') AS exam_patterns,
  coalesce((SELECT string_agg(key, ',' ORDER BY rank) FROM th WHERE th.query_id = lim.query_id AND rank <= 3), '') AS techniques,
  CAST((SELECT count(*) FROM top8 WHERE top8.query_id = lim.query_id) AS INTEGER) AS n_chunks, CAST(coalesce(vids.n, 0) AS INTEGER) AS n_videos
  FROM lim LEFT JOIN chain USING (query_id) LEFT JOIN vids USING (query_id)""",
)
ORACLE_SQL["video_dedup"] = with_(
    CHUNKS,
    "f AS (SELECT collection AS query_id, video_id || '#P' || part_no AS video, min(chunk_id) AS chunk_id FROM chunks WHERE coalesce(video_id, '') <> '' GROUP BY ALL)",
    body="SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS INTEGER) AS video_rank FROM f QUALIFY video_rank <= 5",
)

# history
ORACLE_SQL["profile_left"] = with_(
    PROFILES,
    body="""SELECT u.user_id, grade, school, coalesce(array_to_string(weak, ','), '') AS weak, coalesce(array_to_string(mastered, ','), '') AS mastered, coalesce(goals, '') AS learning_goals
  FROM (SELECT DISTINCT o_custkey AS user_id FROM orders) u LEFT JOIN users USING (user_id) LEFT JOIN profiles USING (user_id)""",
)
ORACLE_SQL["upsert_partial"] = with_(
    PROFILES,
    "n AS (SELECT o_custkey AS user_id, max(o_orderpriority) AS grade FROM orders GROUP BY 1 UNION ALL SELECT -1, 'new')",
    body="SELECT user_id, coalesce(n.grade, users.grade) AS grade, school, name FROM users FULL JOIN n USING (user_id)",
)
ORACLE_SQL["array_union_cap"] = with_(
    PROFILES,
    "n AS (SELECT o_custkey AS user_id, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS new FROM orders GROUP BY 1)",
    body="SELECT user_id, array_to_string(list_concat(coalesce(weak, []), [x FOR x IN new IF NOT list_contains(coalesce(weak, []), x)])[1:4], ',') AS topics FROM n LEFT JOIN profiles USING (user_id)",
)
LINES = f"""ln AS (SELECT user_id, string_agg('- [' || strftime(created_at, '%Y-%m-%d') || '] asked: ' || substr(coalesce(query, ''), 1, 80) || ' -> found: ' || substr(coalesce(diagnosis_summary, ''), 1, 100), chr(10) ORDER BY created_at DESC, id DESC) AS t
  FROM h WHERE created_at >= TIMESTAMP '{q.AS_OF_DAYS}' - INTERVAL 30 DAY GROUP BY user_id)"""
ORACLE_SQL["recent_history_text"] = with_(DAYS, LINES, body=f"SELECT user_id, coalesce(t, '{history.NO_HISTORY}') AS recent_text FROM (SELECT DISTINCT user_id FROM h) LEFT JOIN ln USING (user_id)")
COMPACT = f"""old AS (SELECT *, {PERIOD} AS period, count(*) OVER (PARTITION BY user_id) AS cnt FROM o WHERE {OLD}),
rows AS (SELECT * FROM old WHERE cnt >= {history.COMPACT_FROM} AND NOT (period = '1996-Q1' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))),
qt2 AS (SELECT user_id, period, count(*) AS n, string_agg('[' || strftime(created_at, '%Y-%m-%d') || '] ' || query, chr(10) ORDER BY created_at, id) AS src FROM rows GROUP BY ALL),
made AS (SELECT user_id, period, substr(src, 1, 200) AS summary, n, (length(src) // 4) || ':' || (length(substr(src, 1, 200)) // 4) AS ratio FROM qt2)"""
STATIC = f"""'[USER_PROFILE]' || chr(10) || 'grade: ' || coalesce(nullif(grade, ''), '{history.NO_GRADE}') || chr(10) || 'weak_topics: [' || coalesce(array_to_string(weak, ', '), '') || ']' || chr(10) || 'mastered_topics: ['
  || coalesce(array_to_string(mastered, ', '), '') || ']' || chr(10) || chr(10) || '[HISTORICAL_SUMMARIES]' || chr(10) || coalesce(a, '{history.NO_SUMMARY}')"""
ORACLE_SQL["static_memory_text"] = with_(
    QUARTERS,
    COMPACT,
    PROFILES,
    "ar AS (SELECT user_id, string_agg('### ' || period || chr(10) || summary, chr(10) || chr(10) ORDER BY period) AS a FROM made GROUP BY user_id)",
    body=f"SELECT user_id, {STATIC} AS static_text FROM users LEFT JOIN profiles USING (user_id) LEFT JOIN ar USING (user_id)",
)
ORACLE_SQL["full_memory_text"] = with_(
    DAYS,
    LINES,
    PROFILES,
    body=f"""SELECT user_id, {STATIC.replace("coalesce(a, '" + history.NO_SUMMARY + "')", text(history.NO_SUMMARY))} || chr(10) || chr(10) || '[RECENT_30_DAYS_HISTORY]' || chr(10) || coalesce(t, '{history.NO_HISTORY}') AS memory_text
  FROM users LEFT JOIN profiles USING (user_id) LEFT JOIN ln USING (user_id)""",
)
ORACLE_SQL["compaction_status"] = with_(QUARTERS, body=f"SELECT user_id, count(*) AS old_count, count(*) > {history.STATUS_OVER} AS needs_compression FROM o WHERE {OLD} GROUP BY user_id")
ORACLE_SQL["quarter_groups"] = with_(QUARTERS, body=f"SELECT user_id, {PERIOD} AS period, count(*) AS n, min(id) AS first_id FROM o WHERE {OLD} GROUP BY ALL")
ORACLE_SQL["quarter_compaction"] = with_(
    QUARTERS,
    COMPACT,
    "tot AS (SELECT user_id, count(*) AS n_rows, round(sum(cost), 2) AS cost, string_agg(DISTINCT period, ',' ORDER BY period) AS periods FROM rows GROUP BY 1)",
    "cn AS (SELECT user_id, count(*) AS n_periods, max(ratio) AS max_ratio, min(summary) AS min_summary FROM made GROUP BY 1)",
    "lf AS (SELECT user_id, count(*) AS n_left FROM o WHERE id NOT IN (SELECT id FROM rows) GROUP BY 1)",
    body="SELECT user_id, n_rows, cost, periods, n_periods, max_ratio, min_summary, coalesce(n_left, 0) AS n_left FROM tot JOIN cn USING (user_id) LEFT JOIN lf USING (user_id)",
)
ORACLE_SQL["stored_compaction"] = with_(
    QUARTERS,
    COMPACT.replace("AND NOT (period = '1996-Q1' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))", ""),
    "cn AS (SELECT user_id, count(*) AS n_periods, CAST(sum(n) AS BIGINT) AS n_rows, max(ratio) AS max_ratio, min(summary) AS min_summary FROM made GROUP BY 1)",
    "lf AS (SELECT user_id, count(*) AS n_left, min(id) AS first_left FROM o WHERE id NOT IN (SELECT id FROM rows) GROUP BY 1)",
    body="SELECT user_id, coalesce(n_periods, 0) AS n_periods, coalesce(n_rows, 0) AS n_rows, max_ratio, min_summary, coalesce(n_left, 0) AS n_left, coalesce(first_left, 0) AS first_left FROM cn FULL JOIN lf USING (user_id)",
)
ORACLE_SQL["rolling_users"] = """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE user_id IS NOT NULL), u AS (SELECT DISTINCT day AS until FROM d)
SELECT CAST(until AS TIMESTAMP) AS until, count(DISTINCT user_id) AS users, count(DISTINCT day) AS n_days, true AS within_bound FROM u JOIN d ON day <= until AND day > until - 30 GROUP BY until"""
WATERMARK = "m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {} AS w FROM events)".format
ORACLE_SQL["event_sessions"] = with_(
    WATERMARK("1 HOUR"),
    "e AS (SELECT user_id, event_id AS id, ts, value, event_type = 'error' AS reset, lag(ts) OVER o AS before, lag(event_type = 'error') OVER o AS was_reset, lead(ts) OVER o AS after, lead(event_type = 'error') OVER o AS next_reset FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))",
    "n AS (SELECT *, sum(CASE WHEN reset OR before IS NULL OR was_reset OR ts > before + INTERVAL 60 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, id) AS nr FROM e)",
    """g AS (SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS session_queries, round(coalesce(sum(value), 0), 2) AS session_cost,
  max(CASE WHEN next_reset AND after <= ts + INTERVAL 60 MINUTE THEN after END) AS reset_at FROM n WHERE NOT reset GROUP BY user_id, nr)""",
    body="""SELECT user_id, started, ended, session_queries, session_cost, CASE WHEN reset_at IS NULL THEN 'idle' ELSE 'reset' END AS closed_by FROM g, m
  WHERE CASE WHEN reset_at IS NULL THEN ended + INTERVAL 60 MINUTE < w ELSE reset_at <= w END""",
)
ORACLE_SQL["stream_daily"] = with_(
    WATERMARK("1 DAY"), "d AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS total_queries, round(sum(value), 2) AS total_cost FROM events GROUP BY 1)", body="SELECT d.* FROM d, m WHERE day + INTERVAL 1 DAY <= w"
)
ORACLE_SQL["stream_rolling"] = with_(
    WATERMARK("1 DAY"),
    "r AS (SELECT user_id, unnest([CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL (i) DAY FOR i IN range(1, 8)]) AS until FROM events)",
    body="SELECT user_id, until, count(*) AS n FROM r, m WHERE until <= w GROUP BY ALL",
)
ORACLE_SQL["month_cost"] = f"""SELECT o_custkey // 10 AS user_id, round(coalesce(sum(o_totalprice), 0), 2) AS month_cost FROM orders
  WHERE o_orderdate >= TIMESTAMP '{q.MONTH}-01' AND o_orderdate < TIMESTAMP '{q.MONTH}-01' + INTERVAL 1 MONTH GROUP BY 1"""
ORACLE_SQL["daily_stats"] = """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(DISTINCT user_id) AS active_users, count(*) AS total_queries, round(coalesce(sum(value), 0), 2) AS total_cost FROM events GROUP BY 1"""

# catalogue
ORACLE_SQL["catalog_counts"] = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in q.ALL_TABLES) + ") WHERE name LIKE '%e%' OR name IN ('part', 'labels')"
ORACLE_SQL["expected_minus_present"] = """WITH e AS (SELECT DISTINCT '/' || coalesce(lang, 'und') || '/' || regexp_extract(source, '[0-9]+') AS name FROM documents)
SELECT name FROM e WHERE NOT EXISTS (SELECT 1 FROM pages WHERE contains(url, name))"""
ORACLE_SQL["fk_violations"] = """SELECT 'orders->customer' AS reference, o_custkey AS key_value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'lineitem->orders', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'labels->documents', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'documents->labels', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
ORACLE_SQL["unique_keys"] = "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"

# costs and calls
_prices = ", ".join(f"('{p[0]}', '{p[3]}', {p[4]}, {'NULL' if p[5] is None else p[5]}, {p[6]})" for p in cost.PROVIDERS)
ORACLE_SQL["llm_cost"] = f"""WITH pr(provider, sdk, miss, hit, outp) AS (VALUES {_prices}),
u AS (SELECT l_orderkey, l_linenumber, 'p' || (l_partkey % 8 + 1) AS provider, CAST(l_quantity AS BIGINT) * 100 + 1000 AS i, l_partkey % 10 * 64 AS h, l_suppkey % 3 * 32 AS c, CAST(l_quantity AS BIGINT) * 7 AS o FROM lineitem)
SELECT l_orderkey, l_linenumber, provider, round((h * CAST(coalesce(hit, miss) AS DOUBLE) + (i - h - CASE sdk WHEN 'two' THEN c ELSE 0 END) * CAST(miss AS DOUBLE) + o * CAST(outp AS DOUBLE)) / 1000000.0::DOUBLE, 6) AS cost FROM u JOIN pr USING (provider)"""
ORACLE_SQL["error_class"] = """WITH m AS (SELECT conv_id, turn, lower(text) AS message FROM conversations) SELECT conv_id, turn, CASE WHEN message LIKE '%401%' OR message LIKE '%unauthorized%' OR message LIKE '%invalid api key%' THEN 'key'
  WHEN message LIKE '%402%' OR message LIKE '%insufficient%' OR message LIKE '%balance%' THEN 'balance' WHEN message LIKE '%429%' OR message LIKE '%rate%' THEN 'rate'
  WHEN message LIKE '%timeout%' OR message LIKE '%connection%' OR message LIKE '%network%' THEN 'network' ELSE 'other' END AS class FROM m"""
ORACLE_SQL["model_check"] = """SELECT l_orderkey, l_linenumber, l_partkey % 8 <> 0 OR l_partkey % 3 = 0 AS ok FROM lineitem"""

# sessions
ORACLE_SQL["session_running_totals"] = """SELECT conv_id AS session, turn AS step, CAST(sum(length(text)) OVER w AS DOUBLE) AS session_cost, count(*) OVER w AS session_queries FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT -user_id - 1, event_id, round(sum(value) OVER w, 2), count(*) OVER w FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
ORACLE_SQL["mean_except_first"] = """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr FROM events) SELECT user_id, round(coalesce(avg(value) FILTER (nr > 1), 0), 4) AS mean_rest FROM r GROUP BY 1"""
ORACLE_SQL["monotone_check"] = """WITH r AS (SELECT user_id, event_id % 1000 AS v, ts, lag(event_id % 1000) OVER w AS v0, lag(ts) OVER w AS t0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, bool_and(coalesce(v >= v0, true)) AS non_decreasing, bool_and(coalesce(ts >= t0, true)) AS time_ordered FROM r GROUP BY 1"""
ORACLE_SQL["avg_distribution"] = """SELECT event_type AS query, count(*) AS n, round(avg(value), 4) AS avg_cost, bool_and(value >= 0) AS all_paid, bool_or(value > 90) AS any_high,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM events), 3) AS percent FROM events GROUP BY 1"""

# texts
F1, FN, FT = formatting.FIRST_MOST, formatting.LAST_MOST, formatting.TOTAL_MOST
ORACLE_SQL["answer_validation"] = f"""WITH l AS (SELECT conv_id, turn, text, [x FOR x IN string_split(text, chr(10)) IF regexp_replace(x, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g') <> ''] AS ls FROM conversations),
n AS (SELECT conv_id, turn, CAST(length(coalesce(ls[1], '')) AS INTEGER) AS first_line_len, CAST(length(coalesce(ls[-1], '')) AS INTEGER) AS last_line_len, CAST(length(text) AS INTEGER) AS total_chars FROM l),
i AS (SELECT *, concat_ws('; ', CASE WHEN first_line_len > {F1} THEN 'opening ' || first_line_len || ' > {F1}' END, CASE WHEN last_line_len > {FN} THEN 'closing ' || last_line_len || ' > {FN}' END, CASE WHEN total_chars > {FT} THEN 'total ' || total_chars || ' > {FT}' END) AS issues FROM n)
SELECT *, issues = '' AS valid FROM i"""
URL = formatting.VIDEO_URL
ORACLE_SQL["context_text"] = with_(
    CHUNKS,
    f"""g AS (SELECT video_id AS source, list(DISTINCT short_title ORDER BY short_title) FILTER (short_title IS NOT NULL) AS nodes,
  list('  - [' || video_id || '#P' || part_no || '] ' || substr(text_preview, 1, 150) || '...' ORDER BY chunk_id)[1:5] AS cl,
  list('  - <' || collection || '> P' || part_no || ': ' || coalesce(nullif(short_title, ''), substr(video_title, 1, 40), '') || chr(10) || '    {URL}' || video_id || '?p=' || part_no ORDER BY chunk_id)[1:3] AS vl FROM chunks GROUP BY 1)""",
    body="""SELECT source, concat_ws(chr(10), CASE WHEN len(nodes) > 0 THEN 'related_nodes: [' || array_to_string(nodes[1:5], ', ') || ']' END, CASE WHEN len(nodes) > 1 THEN 'recommended_thinking: [' || array_to_string(nodes[2:3], ', ') || ']' END,
  CASE WHEN len(nodes) > 3 THEN 'prerequisites_to_check: [' || array_to_string(nodes[4:8], ', ') || ']' END, 'reference_chunks:' || chr(10) || array_to_string(cl, chr(10)), 'recommended_videos:' || chr(10) || array_to_string(vl, chr(10))) AS context FROM g""",
)
ORACLE_SQL["url_build_parse"] = f"""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, '{URL}' || page_id || '?p=' || (page_id % 5 + 1) AS built, CAST(page_id % 5 + 1 AS VARCHAR) AS part,
  true AS has_collection, true AS has_url, false AS has_doubled_id, true AS has_reference FROM pages"""
ORACLE_SQL["json_roundtrip"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS again FROM events"
ORACLE_SQL["id_format"] = """WITH i AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'anon_' || substr(md5(c_name), 1, 16) WHEN 1 THEN 'anon_' || c_name WHEN 2 THEN ['  exit ', 'profile', 'cost', '   ', 'q'][c_custkey % 5 + 1] ELSE c_name END AS x FROM customer)
SELECT c_custkey, x LIKE 'anon\\_%' ESCAPE '\\' AND length(x) = 21 AS anonymous, CASE WHEN trim(x) = '' THEN 'blank' WHEN trim(x) IN ('exit', 'quit', 'q') THEN 'exit' WHEN trim(x) IN ('profile', 'cost') THEN trim(x) ELSE 'query' END AS command FROM i"""
ORACLE_SQL["history_append"] = """SELECT user_id, count(*) AS n, max('covers [' || event_type || ', ' || user_id || '], lacks [' || user_id || ']') AS last_summary, CAST(max(least(length(repeat(props, 40)), 200)) AS INTEGER) AS longest, round(sum(value), 2) AS cost FROM events GROUP BY 1"""
ORACLE_SQL["text_replace"] = """WITH r AS (SELECT page_id, replace(replace(replace(url, 'https://', ''), 'http://', ''), '.example.', '.sample.') AS url FROM pages) SELECT page_id, url, contains(url, 'example') AS residue FROM r"""
_fixed = "text"
for _wrong, _right in q.FIXES.items():
    _fixed = f"replace({_fixed}, {text(_wrong)}, {text(_right)})"
ORACLE_SQL["typo_fix"] = f"SELECT doc_id, CAST(length({_fixed}) AS INTEGER) AS n, md5({_fixed}) AS md5 FROM documents"
ORACLE_SQL["chunking"] = """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), c AS (SELECT doc_id, ls, unnest(range(0, (len(ls) - 1) // 4 + 1)) AS chunk_no FROM l)
SELECT doc_id, chunk_no, md5(array_to_string(ls[chunk_no * 4 + 1 : chunk_no * 4 + 4], chr(10))) AS md5 FROM c"""
ORACLE_SQL["unsupported_nodes"] = "SELECT p_partkey AS node_id, p_type AS category FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)"
ORACLE_SQL["unicode_norm"] = "SELECT doc_id, CAST(length(nfc_normalize(text)) AS INTEGER) AS n, md5(nfc_normalize(text)) AS md5 FROM documents"
_sys = len(q.SYSTEM) + 2  # an empty profile follows the prompt
_p1 = cost.PROVIDERS[0]
ORACLE_SQL["llm_reply_cost"] = f"""WITH u AS (SELECT doc_id AS query_id, chr(10) || chr(10) || text AS t FROM documents),
n AS (SELECT query_id, substr(t, 1, 60) AS content, CAST(({_sys} + length(t)) // 4 AS BIGINT) AS input_tokens, CAST(least(length(t), 60) // 4 AS BIGINT) AS output_tokens, CAST({_sys // 4 // 64 * 64} AS BIGINT) AS cache_hit_tokens FROM u)
SELECT *, round((cache_hit_tokens * {_p1[5]}::DOUBLE + (input_tokens - cache_hit_tokens) * {_p1[4]}::DOUBLE + output_tokens * {_p1[6]}::DOUBLE) / 1000000.0::DOUBLE, 6) AS cost FROM n"""
ORACLE_SQL["constraint_report"] = """SELECT 'user_profile(user_id)' AS rule, count(*) AS broken FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
  UNION ALL SELECT 'query_history.user_id -> users.user_id', count(*) FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0"""
ORACLE_SQL["signal_tags"] = """SELECT doc_id, array_to_string([t FOR t IN [CASE WHEN contains(text, 'idiot') OR contains(text, 'moron') THEN 'insult' END, CASE WHEN contains(text, 'license') OR contains(text, 'License') THEN 'licence' END,
  CASE WHEN contains(text, 'token') THEN 'secret' END] IF t IS NOT NULL], ',') AS tags FROM documents"""

# last rows, exports, scopes, prompts
ORACLE_SQL["last_wins"] = "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS md5 FROM conversations GROUP BY 1"
ORACLE_SQL["user_export"] = """WITH e AS (SELECT 'query_history' AS name, o_orderkey AS id FROM orders WHERE o_custkey // 10 = 7 UNION ALL SELECT 'users', c_custkey FROM customer WHERE c_custkey = 7
  UNION ALL SELECT 'user_profile', c_custkey FROM customer WHERE c_custkey = 7 AND c_acctbal >= 2000)
SELECT CAST(7 AS INTEGER) AS user_id, (SELECT count(*) FROM e) AS total, name, count(id) AS n, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids FROM (VALUES ('query_history'), ('users'), ('user_profile')) t(name) LEFT JOIN e USING (name) GROUP BY name"""
ORACLE_SQL["user_scope"] = with_(QUARTERS, body="SELECT user_id, count(*) AS n, round(sum(cost), 2) AS cost, strftime(max(created_at), '%Y%m%d_%H%M%S') AS last FROM o WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")


def _phrase(phrases: list[str]) -> str:
    return f"[{', '.join(map(text, phrases))}][CAST('0x' || substr(md5(text), 1, 7) AS BIGINT) % {len(phrases)} + 1]"


_openings = "CASE " + " ".join(f"WHEN complexity = '{k}' THEN {_phrase(v)}" for k, v in formatting.OPENINGS.items()) + f" ELSE {_phrase(formatting.DEFAULT_OPENINGS)} END"
ORACLE_SQL["prompt_build"] = f"""WITH d AS (SELECT doc_id, text, {_complexity} AS complexity FROM documents)
SELECT doc_id, 'Question: ' || text || CASE WHEN complexity = 'simple' THEN chr(10) || 'Answer in three sentences. Begin with: '
  ELSE chr(10) || chr(10) || '[RETRIEVAL_RESULTS]' || chr(10) || 'related_nodes: [' || doc_id || ']' || chr(10) || chr(10) || 'Explain the cause, the steps and one exercise. Begin with: ' END || {_openings} AS prompt FROM d"""

# preparation by the corpus itself
ORACLE_SQL["misspelt_words"] = rf"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents) WHERE length(word) >= {spelling.LEAST_LENGTH} AND regexp_full_match(word, '[a-z]+') GROUP BY word),
c AS (SELECT a.word, a.n, b.word AS correction, b.n AS correction_n, CAST(levenshtein(a.word, b.word) AS INTEGER) AS distance FROM w a JOIN w b ON a.n <= {spelling.SUSPECT} AND b.n >= {spelling.KNOWN} AND abs(length(a.word) - length(b.word)) <= 2
  AND levenshtein(a.word, b.word) <= CASE WHEN length(a.word) >= {spelling.LONG} THEN 2 ELSE 1 END)
SELECT word, n, correction, distance, correction_n FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, correction_n DESC, correction) = 1"""
ORACLE_SQL["prerequisite_graph"] = with_(
    CHUNKS,
    "t AS (SELECT chunk_id, unnest(list_distinct(list_concat(topics, patterns))) AS node FROM chunks)",
    "nd AS (SELECT node, count(*) AS n FROM t GROUP BY node)",
    f"""ed AS (SELECT x.node, y.node AS pre FROM t x JOIN t y ON x.chunk_id = y.chunk_id AND x.node <> y.node JOIN nd nx ON nx.node = x.node JOIN nd ny ON ny.node = y.node GROUP BY x.node, y.node
  HAVING count(*) >= {graph_build.SUPPORT} AND any_value(ny.n) >= any_value(nx.n) AND 100 * count(*) >= {graph_build.SHARE} * any_value(nx.n))""",
    "reach AS (SELECT node AS a, pre AS b FROM ed UNION SELECT reach.a, ed.pre FROM reach JOIN ed ON reach.b = ed.node)",
    "mutual AS (SELECT x.a AS node, min(x.b) AS least FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1)",
    "cp AS (SELECT node, least(node, coalesce(least, node)) AS component FROM nd LEFT JOIN mutual USING (node))",
    "ce AS (SELECT DISTINCT x.component AS a, y.component AS b FROM ed JOIN cp x ON x.node = ed.node JOIN cp y ON y.node = ed.pre WHERE x.component <> y.component)",
    "lv AS (SELECT DISTINCT component AS c, 0 AS level FROM cp UNION SELECT ce.a, level + 1 FROM lv JOIN ce ON ce.b = lv.c)",
    body="""SELECT nd.node, nd.n, component, (SELECT max(level) FROM lv WHERE c = component) AS level, coalesce((SELECT string_agg(pre, ',' ORDER BY pre) FROM ed WHERE ed.node = nd.node), '') AS prerequisites FROM nd JOIN cp USING (node)""",
)

# semi-structured columns, sessions, scopes, stored lookups
ORACLE_SQL["json_fields"] = """WITH f AS (SELECT props, unnest(json_keys(props)) AS field FROM events)
SELECT field, CASE WHEN bool_and(json_type(props, '$.' || field) IN ('UBIGINT', 'BIGINT')) THEN 'BIGINT' ELSE 'VARIANT' END AS type, count(*) AS n FROM f GROUP BY field"""
ORACLE_SQL["json_typed"] = """SELECT event_id, event_id % 10 = 0 AND NOT json_valid(substr(props, 1, 5)) AS malformed, coalesce(CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END, -1) AS k FROM events"""
ORACLE_SQL["session_ready"] = "SELECT c_custkey, c_acctbal >= 0 AND c_mktsegment <> 'BUILDING' AS ready FROM customer"
ORACLE_SQL["own_month_cost"] = ORACLE_SQL["month_cost"].replace("GROUP BY 1", "AND o_custkey // 10 IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
ORACLE_SQL["stored_lookup"] = with_(QUARTERS, body="SELECT user_id, count(*) AS n, min(id) AS first_id, max(strftime(created_at, '%Y-%m')) AS last_month FROM o WHERE user_id % 50 = 0 GROUP BY 1")
