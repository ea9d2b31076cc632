"""DuckDB SQL for the registered queries, written from the definitions and not from the plans."""

from __future__ import annotations

from lorespark.functions.scrub import SECRETS
from lorespark.functions.text import CONCEPT_STOPWORDS, SENTENCE_STOPWORDS

_P = "CASE {0} % 5 WHEN 0 THEN ['group:exec'] WHEN 1 THEN ['group:exec', 'user:ali'] ELSE ['group:all'] END"
_SEEN = "list_has_any(allowed_principals, ['group:all'])"

_ITEMS = f"""items AS (
    SELECT doc_id AS seq, source, cast(doc_id AS VARCHAR) AS source_id, 'ws' || (doc_id % 4) AS workspace, text, lang,
           {_P.format("doc_id")} AS allowed_principals
    FROM documents)"""

_SECRET = f"""secrets AS (
    SELECT doc_id AS seq, source, 'ws' || (doc_id % 4) AS workspace, cast(doc_id AS VARCHAR) AS source_id,
           text || CASE WHEN doc_id % 17 = 0 THEN ' key AKIA' || upper(md5(cast(doc_id AS VARCHAR))[1:16]) ELSE '' END
                || CASE WHEN doc_id % 19 = 0 THEN ' token ghp_' || md5(cast(doc_id AS VARCHAR)) || 'abcd' ELSE '' END
                || CASE WHEN doc_id % 23 = 0 THEN ' id 123-45-' || lpad(cast(doc_id % 10000 AS VARCHAR), 4, '0') ELSE '' END AS text, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS occurred_at, {_P.format('doc_id')} AS allowed_principals
    FROM documents)"""

_MEM = f"""mem AS (
    SELECT event_id AS id, 'ws' || (user_id % 4) AS workspace,
           (['security','eng','sales','hr','finance','person','misc'])[user_id % 7 + 1] || ':' || user_id AS entity_key,
           event_type || ' by user ' || user_id AS content,
           CASE WHEN event_type IN ('purchase','signup') THEN 'human' WHEN event_type = 'error' THEN 'system' ELSE 'agent' END AS source_type,
           event_type AS source_id, cast((cast(floor(value) AS INT) % 100) / 100.0 AS FLOAT) AS confidence,
           (['working','episodic','semantic','procedural'])[event_id % 4 + 1] AS tier,
           event_id % 6 AS reference_count, ts AS created_at, ts AS last_referenced_at, {_P.format("event_id")} AS allowed_principals,
           CASE WHEN event_type IN ('purchase','signup') THEN 3.0 WHEN event_type = 'error' THEN 2.0 ELSE 1.0 END AS rank
    FROM events)"""

_CONV = """conv AS (
    SELECT conv_id * 1000 + turn AS id, 'ws' || (conv_id % 4) AS workspace, 'topic:conv-' || conv_id AS entity_key, text AS content,
           CASE role WHEN 'user' THEN 'human' WHEN 'system' THEN 'system' ELSE 'agent' END AS source_type, role AS source_id,
           CASE WHEN turn % 3 = 0 THEN ['group:all', 'group:exec'] ELSE ['group:all'] END AS allowed_principals
    FROM conversations)"""

_AGE = "(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(last_referenced_at)) / 1e6"
_HALF = "CASE tier WHEN 'working' THEN 21600 WHEN 'episodic' THEN 1209600 WHEN 'semantic' THEN 15552000 WHEN 'procedural' THEN 31536000 END"
_FLOOR = "CASE tier WHEN 'working' THEN 0.1 WHEN 'episodic' THEN 0.3 WHEN 'semantic' THEN 0.6 WHEN 'procedural' THEN 0.7 END::DOUBLE"
_EFF = f"greatest({_FLOOR}, cast(confidence AS DOUBLE) * pow(0.5, greatest({_AGE}, 0) / {_HALF}))"
_STALE = f"((tier = 'working' AND {_AGE} > 86400 AND {_EFF} < 0.15) OR (tier = 'episodic' AND {_AGE} > 2592000 AND {_EFF} < 0.35))"

# One write after another: the greatest so far, and for a row that was it the next one that is.
_FOLD = f"""{_MEM},
    best AS (SELECT *, max(struct_pack(a := rank, c := confidence, i := id)) OVER (PARTITION BY workspace, entity_key ORDER BY id ROWS UNBOUNDED PRECEDING) AS best FROM mem),
    rec AS (SELECT *, best.i = id AS is_record FROM best),
    fold AS (SELECT *, CASE WHEN NOT is_record THEN best.i ELSE
             min(CASE WHEN is_record THEN id END) OVER (PARTITION BY workspace, entity_key ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS superseded_by FROM rec)"""

_STRIP = "trim({0}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
# Sections begin at headings; paragraphs of a section are packed from left to right while they fit.
_CHUNKS = f"""flatten(list_transform(
    list_filter(string_split(regexp_replace({{text}}, '(?m)^(#{{{{1,6}}}}\\s)', chr(1) || '\\1', 'g'), chr(1)), lambda s: {_STRIP.format("s")} <> ''),
    lambda s: list_transform([list_reduce(
        list_transform(list_filter(list_transform(string_split_regex(s, '\\n\\s*\\n'), lambda p: {_STRIP.format("p")}), lambda p: p <> ''), lambda p: {{{{'done': []::VARCHAR[], 'buf': p}}}}),
        lambda a, p: CASE WHEN length(a.buf) + length(p.buf) + 2 <= 1200 THEN {{{{'done': a.done, 'buf': a.buf || chr(10) || chr(10) || p.buf}}}}
                          ELSE {{{{'done': list_append(a.done, a.buf), 'buf': p.buf}}}} END)], lambda r: list_append(r.done, r.buf))[1]))"""
_HASH = """sha256(trim(array_to_string(list_filter(list_transform(string_split_regex({0}, '\\r\\n|[\\n\\r\\x0b\\x0c]'),
    lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))))"""


def _chunk_rows(source: str, name: str = "ch") -> str:
    """A CTE of the chunks of a CTE that has text: its columns, chunk_index from 0, chunk, content_hash."""
    return f"""{name} AS (SELECT *, {_HASH.format("chunk")} AS content_hash FROM (
        SELECT * EXCLUDE (text, l), unnest(l) AS chunk, generate_subscripts(l, 1) - 1 AS chunk_index FROM (SELECT *, {_CHUNKS.format(text="coalesce(text, '')")} AS l FROM {source})))"""


_CH = f"{_ITEMS}, {_chunk_rows('items')}"
_AT = "{'s': seq, 'c': chunk_index}"
ACL_VISIBLE = f"WITH {_CH} SELECT workspace, count(DISTINCT content_hash) AS n_chunks, min(seq) AS first_seq, max(seq) AS last_seq FROM ch WHERE {_SEEN} GROUP BY workspace"
CHUNK_DEDUP = f"WITH {_CH} SELECT content_hash, length(arg_min(chunk, {_AT})) AS n_chars FROM ch GROUP BY content_hash"
INGEST_STATS = f"WITH {_CH} SELECT (SELECT count(*) FROM items) AS items, count(*) AS chunks, count(DISTINCT content_hash) AS computed, count(*) - count(DISTINCT content_hash) AS reused, 0 AS scrubbed_chars FROM ch"
FIRST_SEEN_ACL = f"WITH {_CH} SELECT content_hash, workspace, array_to_string(arg_min(allowed_principals, {_AT}), ',') AS principals FROM ch GROUP BY ALL"
CHUNK_PACK = f"""WITH {_ITEMS}, structured AS (
    SELECT * REPLACE (CASE WHEN seq % 2 = 0 THEN '# ' || source || chr(10) || chr(10) ELSE '' END || replace(text, chr(10), chr(10) || chr(10)) AS text) FROM items), {_chunk_rows("structured")}
    SELECT seq, chunk_index, content_hash, length(chunk) AS n_chars FROM ch"""
RAW_EVENT_LATEST = f"WITH {_ITEMS} SELECT source, cast(seq % 100 AS VARCHAR) AS source_id, workspace, max(seq) AS event_id FROM items GROUP BY ALL"
DEDUP_GATE = f"WITH {_CH}, f AS (SELECT workspace, row_number() OVER (PARTITION BY content_hash ORDER BY seq, chunk_index) = 1 AS c FROM ch) SELECT workspace, count(*) FILTER (WHERE c) AS computed, count(*) FILTER (WHERE NOT c) AS reused FROM f GROUP BY workspace"
NORMALIZED_LENGTHS = """SELECT doc_id AS seq, length(n) AS n_chars, sha256(n) AS content_hash FROM (
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
        lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS n FROM documents)"""

_KINDS = """fired AS (
    SELECT seq, source, workspace, source_id, 'aws_access_key' AS kind, len(regexp_extract_all(text, '\\bAKIA[0-9A-Z]{16}\\b')) AS n FROM secrets
    UNION ALL SELECT seq, source, workspace, source_id, 'github_token', len(regexp_extract_all(text, '\\bgh[posu]_[A-Za-z0-9]{36}\\b')) FROM secrets)"""
_FIRED = f"{_SECRET}, {_KINDS}"
REDACTION_COUNTS = f"WITH {_FIRED} SELECT kind, sum(n) AS total FROM fired WHERE n > 0 GROUP BY kind"
REDACTION_REPORT = f"WITH {_FIRED} SELECT kind, workspace, source, sum(n) AS total FROM fired WHERE n > 0 GROUP BY ALL"
RECENT_REDACTIONS = f"WITH {_FIRED} SELECT source_id, kind, n FROM fired WHERE n > 0 ORDER BY seq DESC, source_id, kind LIMIT 50"
SCRUB_EMAIL_SSN = f"WITH {_SECRET} SELECT seq, sha256(regexp_replace(regexp_replace(text, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b', '[REDACTED:ssn]', 'g'), '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}\\b', '[REDACTED:email]', 'g')) AS text_sha256 FROM secrets"
REDACTIONS_SINCE = f"WITH {_FIRED} SELECT kind, source, source_id, workspace, sum(n) AS total FROM fired JOIN (SELECT seq, occurred_at FROM secrets) USING (seq) WHERE n > 0 AND occurred_at >= TIMESTAMP '2024-01-01 03:00:00' GROUP BY ALL"


def _scrubbed(text: str) -> str:
    for kind, pattern in SECRETS:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '[REDACTED:{kind}]', 'g')"
    return text


_CLEAN = f"{_SECRET}, clean AS (SELECT * REPLACE ({_scrubbed('text')} AS text) FROM secrets), {_chunk_rows('clean')}"
INGEST_FULL = f"""WITH {_CLEAN}, acl AS (SELECT DISTINCT content_hash, workspace FROM ch)
    SELECT acl.workspace, count(DISTINCT content_hash) AS chunks, count(*) AS links FROM acl JOIN ch USING (content_hash) GROUP BY acl.workspace"""
INGEST_SCRUBBED = f"""WITH {_CLEAN}, {_KINDS}
    SELECT (SELECT count(*) FROM secrets) AS items, count(*) AS chunks, count(DISTINCT content_hash) AS computed, count(*) - count(DISTINCT content_hash) AS reused,
           (SELECT coalesce(sum(n * CASE kind WHEN 'aws_access_key' THEN 20 ELSE 40 END), 0) FROM fired) AS scrubbed_chars FROM ch"""
CARD_LUHN = """WITH c AS (SELECT regexp_replace(unnest(regexp_extract_all(text, '\\b(?:\\d[ -]?){12,18}\\d\\b')), '[ -]', '', 'g') AS d FROM documents),
    v AS (SELECT d, list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 1
        THEN (CASE WHEN cast(d[i] AS INT) > 4 THEN cast(d[i] AS INT) * 2 - 9 ELSE cast(d[i] AS INT) * 2 END) ELSE cast(d[i] AS INT) END)) AS s FROM c)
    SELECT count(*) AS n_cards FROM v WHERE s % 10 = 0 AND len(d) BETWEEN 13 AND 19"""

CLASSIFY = f"""WITH {_MEM}, {_CONV}, k AS (SELECT entity_key FROM mem UNION SELECT entity_key FROM conv)
    SELECT entity_key, CASE WHEN split_part(entity_key, ':', 1) = 'security' THEN 'security'
        WHEN split_part(entity_key, ':', 1) IN ('eng', 'engineering') THEN 'engineering'
        WHEN split_part(entity_key, ':', 1) IN ('sales', 'account') THEN 'sales'
        WHEN split_part(entity_key, ':', 1) IN ('hr', 'finance') THEN split_part(entity_key, ':', 1)
        WHEN split_part(entity_key, ':', 1) = 'person' THEN 'people' ELSE 'general' END AS kind FROM k"""
EFFECTIVE = f"WITH {_MEM} SELECT id, round({_EFF}, 6) AS effective_confidence FROM mem"
EVICT_PREVIEW = f"WITH {_MEM} SELECT t.tier, count(m.id) AS n FROM (VALUES ('working'), ('episodic')) t(tier) LEFT JOIN (SELECT * FROM mem WHERE {_STALE}) m ON t.tier = m.tier GROUP BY t.tier"
EVICT_SURVIVORS = f"WITH {_MEM} SELECT workspace, tier, count(*) AS n, min(id) AS first_id FROM mem WHERE NOT {_STALE} GROUP BY ALL"
EVICT_EXAMPLES = f"WITH {_MEM} SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY last_referenced_at, id) AS rn, id FROM mem WHERE {_STALE} QUALIFY rn <= 5"
PROMOTE = f"WITH {_MEM} SELECT id, workspace, entity_key FROM mem WHERE tier = 'episodic' AND {_AGE} >= 604800 AND {_EFF} >= 0.3 AND reference_count >= 3"
FOLD = f"WITH {_FOLD} SELECT id, superseded_by FROM fold"
RECALL = f"""WITH {_FOLD}, live AS (SELECT *, {_EFF} AS eff FROM fold WHERE superseded_by IS NULL)
    SELECT workspace, entity_key, id, round(eff, 6) AS effective_confidence FROM live
    QUALIFY row_number() OVER (PARTITION BY workspace, entity_key ORDER BY rank DESC, eff DESC, id DESC) = 1"""
RECALL_READS = f"""WITH {_FOLD}, live AS (SELECT *, {_EFF} AS eff FROM fold WHERE superseded_by IS NULL),
    chosen AS (SELECT id FROM live QUALIFY row_number() OVER (PARTITION BY workspace, entity_key ORDER BY rank DESC, eff DESC, id DESC) = 1)
    SELECT workspace, tier, count(b.id) AS n_read, sum(reference_count) + count(b.id) AS n_references FROM mem m LEFT JOIN chosen b ON m.id = b.id GROUP BY ALL"""
REMEMBER = f"WITH {_FOLD} SELECT id, superseded_by IS NULL AS is_current FROM fold WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00'"
REMEMBERED = FOLD
_ELIGIBLE = "(SELECT workspace, entity_key FROM mem WHERE tier = 'working' GROUP BY ALL HAVING count(*) >= 3)"
_UP = f"""up AS (SELECT id, workspace, entity_key, 'working' AS from_tier, 'episodic' AS to_tier FROM mem WHERE tier = 'working' AND (workspace, entity_key) IN {_ELIGIBLE}
    UNION ALL SELECT id, workspace, entity_key, 'episodic', 'semantic' FROM mem WHERE tier = 'episodic' AND {_AGE} >= 604800 AND {_EFF} >= 0.3 AND reference_count >= 3)"""
PROMOTE_ALL = f"WITH {_MEM}, {_UP} SELECT workspace, entity_key, from_tier, to_tier, count(*) AS n, min(id) AS first_id FROM up GROUP BY ALL"
AFTER_PROMOTION = f"""WITH {_MEM}, {_UP} SELECT CASE WHEN to_tier = 'semantic' THEN 'semantic' ELSE tier END AS tier, coalesce(from_tier = 'working', false) AS compressed, count(*) AS n
    FROM mem LEFT JOIN up USING (id) GROUP BY ALL"""
HISTORY = f"WITH {_FOLD} SELECT entity_key, id, superseded_by IS NULL AS is_current FROM fold WHERE workspace = 'ws1' AND {_SEEN}"
DAG = f"WITH {_FOLD}, seen AS (SELECT * FROM fold WHERE {_SEEN}) SELECT id AS from_id, superseded_by AS to_id FROM seen WHERE superseded_by IN (SELECT id FROM seen)"
ENTITIES = f"WITH {_FOLD} SELECT workspace, entity_key, count(*) AS n_rows, bool_or(superseded_by IS NULL) AS has_current FROM fold WHERE {_SEEN} GROUP BY ALL"
REINFORCE = f"""WITH {_MEM}, reads AS (SELECT id % 500 AS id, max(created_at) AS read_at, count(*) AS n FROM mem WHERE id % 3 = 0 GROUP BY 1)
    SELECT m.id, cast(reference_count + coalesce(n, 0) AS INT) AS reference_count,
           strftime(greatest(last_referenced_at, coalesce(read_at, last_referenced_at)), '%Y-%m-%d %H:%M:%S') AS last_read
    FROM mem m LEFT JOIN reads r ON m.id = r.id"""

_CATALOGUE = """role(id, workspace, source_type, name, base) AS (VALUES (1,'ws0','human','purchase',4.0),(2,'default','human','signup',3.0),(3,'ws1','human','lead',4.5),(4,'default','agent','view',1.5),(5,'ws2','system','monitor',2.0)),
    policy(id, workspace, entity_kind, role_id, authority) AS (VALUES (1,'ws0','security',1,5.0),(2,'ws0','*',1,3.5),(3,'default','*',2,3.0),(4,'default','general',2,3.5),(5,'ws1','engineering',3,5.0),(6,'default','*',4,1.0)),
    writer(workspace, source_type, source_id, role_id) AS (VALUES ('ws1','human','purchase',3),('default','system','error',5))"""
_KIND = "CASE split_part(entity_key, ':', 1) WHEN 'eng' THEN 'engineering' WHEN 'person' THEN 'people' WHEN 'misc' THEN 'general' ELSE split_part(entity_key, ':', 1) END"
_AUTH = f"""{_MEM}, {_CATALOGUE},
    w AS (SELECT DISTINCT workspace, source_type, source_id, {_KIND} AS entity_kind, rank FROM mem),
    r AS (SELECT w.*, coalesce(
        (SELECT role_id FROM writer x WHERE x.workspace = w.workspace AND x.source_type = w.source_type AND x.source_id = w.source_id),
        (SELECT role_id FROM writer x WHERE x.workspace = 'default' AND x.source_type = w.source_type AND x.source_id = w.source_id),
        (SELECT id FROM role x WHERE x.workspace = w.workspace AND x.source_type = w.source_type AND x.name = w.source_id),
        (SELECT id FROM role x WHERE x.workspace = 'default' AND x.source_type = w.source_type AND x.name = w.source_id)) AS role_id FROM w),
    auth AS (SELECT workspace, source_type, source_id, entity_kind,
           cast(coalesce((SELECT max(authority) FROM policy p WHERE p.role_id = r.role_id AND p.workspace IN (r.workspace, 'default') AND p.entity_kind IN (r.entity_kind, '*')),
                    (SELECT base FROM role x WHERE x.id = r.role_id), rank) AS DOUBLE) AS authority, role_id IS NOT NULL AS governed FROM r)"""
AUTHORITY = f"WITH {_AUTH} SELECT * FROM auth"
# One write after another: all live rows of the entity and the new one are judged, whichever stay are the next step's.
_GOVERNED = f"""RECURSIVE {_AUTH},
    o AS (SELECT m.workspace, m.entity_key, m.id, row_number() OVER (PARTITION BY m.workspace, m.entity_key ORDER BY m.id) AS k,
                 {{'a': authority, 'c': cast(confidence AS DOUBLE), 'i': m.id, 'g': governed}} AS x
          FROM (SELECT *, {_KIND} AS entity_kind FROM mem) m JOIN auth USING (workspace, source_type, source_id, entity_kind)),
    step AS (
        SELECT workspace, entity_key, k, [x] AS live, []::STRUCT(a DOUBLE, c DOUBLE, i BIGINT, g BOOLEAN)[] AS gone, x AS win FROM o WHERE k = 1
        UNION ALL
        SELECT workspace, entity_key, k, list_filter(l, lambda r: r.i = win.i OR (abs(r.a - win.a) <= 0.05 AND (r.g OR win.g))),
               list_filter(l, lambda r: r.i <> win.i AND NOT (abs(r.a - win.a) <= 0.05 AND (r.g OR win.g))), win
        FROM (SELECT o.workspace, o.entity_key, o.k, list_append(s.live, o.x) AS l, list_max(list_append(s.live, o.x)) AS win
              FROM step s JOIN o ON o.workspace = s.workspace AND o.entity_key = s.entity_key AND o.k = s.k + 1)),
    lost AS (SELECT unnest(gone).i AS id, win.i AS superseded_by FROM step),
    tied AS (SELECT DISTINCT workspace, entity_key, least(r.i, win.i) AS row_a, greatest(r.i, win.i) AS row_b,
                    CASE WHEN r.i < win.i THEN r.a ELSE win.a END AS authority_a, CASE WHEN r.i < win.i THEN win.a ELSE r.a END AS authority_b
             FROM (SELECT workspace, entity_key, unnest(live) AS r, win FROM step) WHERE r.i <> win.i)"""
GOVERNED_FOLD = f"WITH {_GOVERNED} SELECT id, superseded_by FROM lost"
GOVERNED_CONFLICTS = f"WITH {_GOVERNED} SELECT *, 'pending' AS status FROM tied"
PENDING_CONFLICTS = f"""WITH {_GOVERNED}, seen AS (SELECT id, content FROM mem WHERE {_SEEN})
    SELECT workspace, row_a, row_b, a.content AS content_a, b.content AS content_b, '2024-02-01 00:00:00' AS detected
    FROM tied JOIN seen a ON a.id = row_a JOIN seen b ON b.id = row_b WHERE row_a % 2 <> 0"""
RESOLVED = f"""WITH {_GOVERNED}, closed AS (SELECT row_a AS id, min(row_b) AS winner FROM tied WHERE row_a % 2 = 0 GROUP BY row_a)
    SELECT m.id, coalesce(l.superseded_by, c.winner) AS superseded_by FROM mem m LEFT JOIN lost l ON l.id = m.id LEFT JOIN closed c ON c.id = m.id"""
POLICIES = f"WITH {_CATALOGUE} SELECT p.workspace, entity_kind, name AS role, source_type, cast(authority AS FLOAT) AS authority FROM policy p JOIN role r ON p.role_id = r.id"

_A = "[" + ",".join(f"'{w}'" for w in SENTENCE_STOPWORDS) + "]"
_B = "[" + ",".join(f"'{w}'" for w in CONCEPT_STOPWORDS) + "]"
_SENT = f"""{_CONV}, cut AS (
    SELECT workspace, entity_key, id, generate_subscripts(s, 1) AS pos, unnest(s) AS sentence FROM (
        SELECT *, list_filter(list_transform(string_split(regexp_replace(trim(content, chr(32) || chr(9) || chr(10) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS s FROM conv)),
    sent AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY id, pos) - 1 AS idx FROM cut)"""
_SCORE = f"""{_SENT}, sets AS (
    SELECT *, list_distinct(list_filter(regexp_extract_all(lower(sentence), '[a-z0-9]+'), lambda w: len(w) > 1 AND NOT list_contains({_A}, w))) AS w FROM sent),
    scored AS (SELECT a.entity_key, a.idx, a.id, a.sentence, round(coalesce(sum(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w))) FILTER (WHERE len(a.w) > 0 AND len(b.w) > 0), 0), 9) AS score
               FROM sets a LEFT JOIN sets b ON a.entity_key = b.entity_key AND a.idx <> b.idx GROUP BY ALL),
    picked AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY score DESC, idx) AS rn, count(*) OVER (PARTITION BY entity_key) AS total FROM scored
               QUALIFY rn <= least(5, greatest(1, ceil(total * 0.25))))"""
COMPRESS_ELIGIBLE = f"WITH {_CONV} SELECT workspace, entity_key, count(*) AS n_rows FROM conv GROUP BY ALL HAVING count(*) >= 3"
SENTENCE_SPLIT = f"WITH {_SENT} SELECT entity_key, count(*) AS n_sentences, sum(length(sentence)) AS n_chars FROM sent GROUP BY entity_key"
CENTRALITY = f"WITH {_SCORE} SELECT entity_key, idx, round(score, 6) AS score FROM scored"
TOPK_SUMMARY = f"WITH {_SCORE} SELECT entity_key, sha256(string_agg(sentence, ' ' ORDER BY idx)) AS content_sha256, count(*) AS n_sentences FROM picked GROUP BY entity_key"
LINEAGE = f"WITH {_SCORE} SELECT entity_key, row_number() OVER (PARTITION BY entity_key ORDER BY idx) - 1 AS sentence_index, id AS source_row_id FROM picked"
SUMMARY_FACTS = f"""WITH {_SCORE}, content AS (SELECT entity_key, length(string_agg(sentence, ' ' ORDER BY idx)) AS n FROM picked GROUP BY entity_key)
    SELECT c.entity_key, round(avg(cast(cast(0.5 + (turn % 5) / 10.0 AS FLOAT) AS DOUBLE)), 6) AS confidence, count(*) AS n_rows, round(any_value(n) / sum(length(c.content)), 6) AS ratio
    FROM (SELECT *, id % 1000 AS turn FROM conv) c JOIN content USING (entity_key) GROUP BY c.entity_key"""
COMPRESSION_VIEW = f"""WITH {_SCORE}, lines AS (SELECT workspace, entity_key, row_number() OVER (PARTITION BY entity_key ORDER BY idx) - 1 AS sentence_index, sentence, id AS source_row_id
        FROM picked JOIN (SELECT DISTINCT workspace, entity_key FROM conv) USING (entity_key))
    SELECT l.workspace, l.entity_key, sentence_index, sha256(sentence) AS sentence_sha256, source_row_id, length(c.content) AS source_chars
    FROM lines l LEFT JOIN conv c ON c.id = source_row_id AND list_has_any(c.allowed_principals, ['group:exec'])"""
ACL_INTERSECTION = f"WITH {_CONV}, n AS (SELECT entity_key, count(*) AS n FROM conv GROUP BY 1), p AS (SELECT entity_key, unnest(allowed_principals) AS p, id FROM conv) SELECT entity_key, string_agg(p, ',' ORDER BY p) AS principals FROM (SELECT entity_key, p FROM p JOIN n USING (entity_key) GROUP BY entity_key, p, n HAVING count(DISTINCT id) = n) GROUP BY entity_key"
INVALIDATION = f"WITH {_SCORE} SELECT DISTINCT cast(split_part(entity_key, '-', 2) AS BIGINT) AS id FROM picked WHERE id % 7 = 0"

_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_VEC = f"SELECT cast(vec_id AS VARCHAR) AS id, 1 - list_cosine_similarity(cast(embedding AS DOUBLE[]), cast({_Q} AS DOUBLE[])) AS distance FROM embeddings"
VECTOR_TOPK = f"SELECT id, round(distance, 5) AS distance FROM ({_VEC}) ORDER BY round(distance, 9), id LIMIT 20"
_LEX = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_RANK = "len(list_filter(lex, lambda w: list_contains({0}, w))) / (1 + ln(greatest(len(lex), 1)))"
FTS_MATCH = f"SELECT doc_id AS seq FROM documents WHERE list_has_all({_LEX.format('text')}, ['ti', 'es'])"
_PLURAL = "CASE WHEN regexp_matches(w, '(^|[^ea])ies$') THEN w[:-4] || 'y' WHEN regexp_matches(w, '(^|[^aeo])es$') THEN w[:-3] || 'e' WHEN regexp_matches(w, '(^|[^us])s$') THEN w[:-2] ELSE w END"
FTS_ENGLISH = f"""WITH {_CONV}, l AS (SELECT id, list_transform({_LEX.format('content')}, lambda w: {_PLURAL}) AS lex FROM conv)
    SELECT id, len(list_distinct(lex)) AS n_lexemes, sha256(array_to_string(list_sort(lex), ' ')) AS lexemes_sha256 FROM l WHERE len(list_filter(lex, lambda w: w LIKE '%e')) > 0"""
_FTS = f"""fts AS (SELECT cast(seq AS VARCHAR) AS id, {_RANK.format("{words}")} AS rank FROM (SELECT *, {_LEX.format("text")} AS lex FROM items WHERE {_SEEN}) WHERE {{match}})"""
FTS_TOPK = f"WITH {_ITEMS}, {_FTS.format(words=['ing'], match='''list_contains(lex, 'ing')''')} SELECT id, round(rank, 6) AS rank FROM fts ORDER BY round(rank, 9) DESC, id LIMIT 20"
_MEMLEX = f"""ml AS (SELECT 'mem:' || id AS id, {_LEX.format("content")} AS lex, {_EFF} AS eff FROM fold WHERE superseded_by IS NULL AND {_SEEN})"""
MEMORY_TOPK = f"""WITH {_FOLD}, {_MEMLEX} SELECT id, round({_RANK.format("['purchase', 'user']")}, 6) AS rank, round(eff, 6) AS effective_confidence FROM ml
    WHERE list_has_all(lex, ['purchase', 'user']) ORDER BY round({_RANK.format("['purchase', 'user']")}, 9) DESC, round(eff, 9) DESC, id LIMIT 20"""
_THREE = ["ing", "purchase", "user"]
_ANY = "(list_contains(lex, 'ing') OR list_has_all(lex, ['purchase', 'user']))"
RRF = f"""WITH {_ITEMS}, {_FOLD}, {_MEMLEX}, {_FTS.format(words=_THREE, match=_ANY)},
    v AS (SELECT id, row_number() OVER (ORDER BY round(distance, 9), id) AS n FROM ({_VEC}) WHERE id IN (SELECT cast(seq AS VARCHAR) FROM items WHERE {_SEEN}) QUALIFY n <= 40),
    f AS (SELECT id, row_number() OVER (ORDER BY round(rank, 9) DESC, id) AS n FROM fts QUALIFY n <= 40),
    m AS (SELECT id, eff, row_number() OVER (ORDER BY round({_RANK.format(_THREE)}, 9) DESC, round(eff, 9) DESC, id) AS n FROM ml WHERE {_ANY} QUALIFY n <= 40),
    u AS (SELECT id, n, 1.0 AS w, 'vector' AS arm FROM v UNION ALL SELECT id, n, 1.0, 'fulltext' FROM f UNION ALL SELECT id, n, eff, 'memory' FROM m)
    SELECT id, round(sum(w / (60 + n)), 6) AS score, string_agg(arm, ',' ORDER BY arm) AS arms FROM u GROUP BY id ORDER BY round(sum(w / (60 + n)), 9) DESC, id LIMIT 20"""
_BUCKETS = f"list_transform({_LEX}, lambda w: cast('0x' || md5(w)[1:8] AS BIGINT) % 256)"
SEARCH_INGESTED = f"""WITH {_CLEAN}, acl AS (SELECT content_hash, workspace, arg_min(allowed_principals, {_AT}) AS allowed_principals FROM ch GROUP BY ALL),
    texts AS (SELECT content_hash, arg_min(chunk, {_AT}) AS text FROM ch GROUP BY ALL),
    seen AS (SELECT content_hash, text, {_BUCKETS.format("text")} AS b FROM acl JOIN texts USING (content_hash) WHERE workspace = 'ws2' AND {_SEEN}),
    asked AS (SELECT b, count(*) AS n FROM (SELECT unnest({_BUCKETS.format("'ing und que les token'")}) AS b) GROUP BY b),
    held AS (SELECT content_hash, b, count(*) AS n FROM (SELECT content_hash, unnest(b) AS b FROM seen) GROUP BY ALL),
    near AS (SELECT content_hash, sum(h.n * coalesce(a.n, 0)) / (sqrt(sum(h.n * h.n)) * (SELECT sqrt(sum(n * n)) FROM asked)) AS cosine FROM held h LEFT JOIN asked a USING (b) GROUP BY content_hash),
    scored AS (SELECT content_hash AS id, round(1 - coalesce(cosine, 0), 5) AS distance, length(text) AS n_chars FROM seen LEFT JOIN near USING (content_hash))
    SELECT id, distance, n_chars FROM scored ORDER BY distance, id LIMIT 20"""
EMBED_MD5 = f"""WITH {_CONV}, t AS (SELECT id, cast('0x' || md5(unnest({_LEX.format("content")}))[1:8] AS BIGINT) % 16 AS bucket FROM conv),
    n AS (SELECT id, bucket, count(*) AS n FROM t GROUP BY ALL)
    SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS x FROM n"""

_GRAMS = f"""{_CONV}, tok AS (SELECT id, workspace, entity_key, source_type, regexp_extract_all(lower(content), '[a-z][a-z0-9]+') AS t FROM conv),
    grams AS (SELECT id, workspace, source_type, array_to_string(g, ' ') AS name FROM (
        SELECT id, workspace, source_type, unnest(list_transform(range(1, len(t) - n + 2), lambda i: t[i : i + n - 1])) AS g FROM tok, (SELECT unnest([{{sizes}}]) AS n))
        WHERE NOT list_contains({_B}, g[1]) AND NOT list_contains({_B}, g[-1]))"""
_G24 = _GRAMS.format(sizes="2, 3, 4")
NGRAMS = f"WITH {_G24} SELECT c.id, count(g.name) AS n, sha256(coalesce(string_agg(g.name, '|' ORDER BY g.name), '')) AS terms_sha256 FROM conv c LEFT JOIN grams g ON c.id = g.id GROUP BY c.id"
_TENANT = f"{_G24}, tenant AS (SELECT workspace, name, count(*) AS local_count FROM grams GROUP BY ALL HAVING count(*) >= 2), concept AS (SELECT name, sum(local_count) AS global_count, count(*) AS tenant_count FROM tenant GROUP BY name)"
TENANT_CONCEPTS = f"WITH {_TENANT} SELECT * FROM tenant"
GLOBAL_CONCEPTS = f"WITH {_TENANT} SELECT * FROM concept"
TOP_CONCEPTS = f"WITH {_TENANT} SELECT * FROM concept ORDER BY tenant_count DESC, global_count DESC, name LIMIT 20"
_SYN = f"""{_TENANT}, voc AS (SELECT t.*, tenant_count FROM tenant t JOIN concept USING (name) WHERE tenant_count >= 2),
    syn AS (SELECT a.name AS concept_a, b.name AS concept_b, count(*) AS cooccurrence_tenants, least(1.0, count(*) / greatest(least(any_value(a.tenant_count), any_value(b.tenant_count)), 1)) AS confidence
            FROM voc a JOIN voc b ON a.workspace = b.workspace AND a.name < b.name GROUP BY ALL
            HAVING count(*) >= 2 AND bool_or(a.local_count >= 3 AND b.local_count >= 3))"""
CONCEPTS_VIEW = f"""WITH {_SYN},
    g AS (SELECT 'global' AS part, name, NULL::VARCHAR AS other, cast(tenant_count AS BIGINT) AS count, cast(global_count AS DOUBLE) AS weight FROM concept ORDER BY tenant_count DESC, global_count DESC, name LIMIT 30),
    l AS (SELECT 'local', name, NULL::VARCHAR, cast(local_count AS BIGINT), NULL::DOUBLE FROM tenant WHERE workspace = 'ws2' ORDER BY local_count DESC, name LIMIT 30),
    y AS (SELECT 'synonym', concept_a, concept_b, cast(cooccurrence_tenants AS BIGINT), round(confidence, 6) FROM syn ORDER BY round(confidence, 9) DESC, cooccurrence_tenants DESC, concept_a, concept_b LIMIT 30)
    FROM g UNION ALL FROM l UNION ALL FROM y"""
SEARCH_EXPANDED = f"""WITH {_SYN}, asked AS (SELECT name FROM concept ORDER BY tenant_count DESC, global_count DESC, name LIMIT 1),
    asked_t AS (SELECT regexp_extract_all(name, '[a-z][a-z0-9]+') AS t FROM asked),
    held_q AS (SELECT DISTINCT array_to_string(g, ' ') AS name FROM (SELECT unnest(list_transform(range(1, len(t) - n + 2), lambda i: t[i : i + n - 1])) AS g FROM asked_t, (SELECT unnest([1, 2, 3, 4]) AS n))
        WHERE NOT list_contains({_B}, g[1]) AND NOT list_contains({_B}, g[-1])),
    sides AS (SELECT concept_a AS name, concept_b AS term FROM syn UNION ALL SELECT concept_b, concept_a FROM syn),
    terms AS (SELECT DISTINCT term FROM sides JOIN held_q USING (name) WHERE term NOT IN (SELECT name FROM held_q) ORDER BY term LIMIT 3),
    sets AS (SELECT list_distinct(list_filter({_LEX.format("q")}, lambda w: NOT list_contains({_A}, w))) AS w FROM (SELECT name AS q FROM asked UNION ALL SELECT term FROM terms)),
    flat AS (SELECT list_distinct(flatten(list(w))) AS every, list(w) FILTER (WHERE len(w) > 0) AS ws FROM sets),
    rows_ AS (SELECT id, {_LEX.format("content")} AS lex, greatest(0.1, cast(cast(0.5 + ((id % 1000) % 5) / 10.0 AS FLOAT) AS DOUBLE) * pow(0.5, 86400 / 21600)) AS eff FROM conv WHERE {_SEEN}),
    hit AS (SELECT 'mem:' || id AS id, {_RANK.format("every")} AS rank, eff FROM rows_, flat WHERE len(list_filter(ws, lambda s: list_has_all(lex, s))) > 0)
    SELECT id, round(rank, 6) AS rank, 1 AS reference_count FROM hit ORDER BY round(rank, 9) DESC, round(eff, 9) DESC, id LIMIT 20"""
CHUNK_VOCABULARY = f"""WITH {_CH}, own AS (SELECT DISTINCT workspace, content_hash FROM ch), texts AS (SELECT content_hash, arg_min(chunk, {_AT}) AS text FROM ch GROUP BY ALL),
    tok AS (SELECT workspace, regexp_extract_all(lower(text), '[a-z][a-z0-9]+') AS t FROM own JOIN texts USING (content_hash)),
    g AS (SELECT workspace, unnest(list_transform(range(1, len(t) - n + 2), lambda i: t[i : i + n - 1])) AS g FROM tok, (SELECT unnest([2, 3, 4]) AS n))
    SELECT workspace, array_to_string(g, ' ') AS name, count(*) AS local_count FROM g WHERE NOT list_contains({_B}, g[1]) AND NOT list_contains({_B}, g[-1]) GROUP BY ALL HAVING count(*) >= 20"""
SYNONYMS = f"WITH {_SYN} SELECT concept_a, concept_b, cooccurrence_tenants, round(confidence, 6) AS confidence FROM syn"
EXPANSION = f"""WITH {_SYN}, held AS (SELECT DISTINCT id AS query_id, array_to_string(g, ' ') AS name FROM (
        SELECT id, unnest(list_transform(range(1, len(t) - n + 2), lambda i: t[i : i + n - 1])) AS g FROM tok, (SELECT unnest([1, 2, 3, 4]) AS n)
        )
        WHERE NOT list_contains({_B}, g[1]) AND NOT list_contains({_B}, g[-1])),
    both_ AS (SELECT concept_a AS name, concept_b AS term FROM syn UNION ALL SELECT concept_b, concept_a FROM syn),
    found AS (SELECT DISTINCT query_id, term FROM held JOIN both_ USING (name) WHERE (query_id, term) NOT IN (SELECT (query_id, name) FROM held))
    SELECT query_id, term FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY term) <= 3"""
AUDIT = f"""WITH {_SYN}, single AS (SELECT name FROM concept WHERE tenant_count < 2)
    SELECT (SELECT count(*) FROM concept) AS concept_total, (SELECT count(*) FROM single) AS concept_single_tenant, (SELECT count(*) FROM syn) AS synonym_total,
           (SELECT count(*) FROM syn WHERE concept_a IN (FROM single) OR concept_b IN (FROM single)) AS single_tenant_synonyms,
           (SELECT coalesce(string_agg(name, '|' ORDER BY name), '') FROM (SELECT name FROM tenant WHERE workspace = 'ws1' AND name IN (FROM single) ORDER BY name LIMIT 50)) AS review_needed,
           (SELECT count(*) = 0 FROM syn WHERE concept_a IN (FROM single) OR concept_b IN (FROM single)) AS ok"""

_ALIAS = """alias AS (SELECT c_custkey * 2 AS identity_id, cast(c_nationkey AS VARCHAR) AS workspace, 'crm' AS source, c_name AS x, 1 + c_custkey % 3 AS evidence FROM customer
    UNION ALL SELECT s_suppkey * 2 + 1, cast(s_nationkey AS VARCHAR), 'erp', s_name, 1 + s_suppkey % 3 FROM supplier)"""
_PAIR = f"""{_ALIAS}, pair AS (SELECT a.identity_id AS a, b.identity_id AS b, a.evidence AS ea, b.evidence AS eb, a.x = b.x AS same,
    1 - levenshtein(lower(a.x), lower(b.x)) / greatest(length(a.x), length(b.x)) AS s
    FROM alias a JOIN alias b ON a.workspace = b.workspace AND a.identity_id < b.identity_id)"""
ALIAS_SIMILARITY = f"WITH {_PAIR} SELECT a, b, round(s, 6) AS similarity FROM pair"
SIGNALS = f"WITH {_PAIR} SELECT a, b, 0.0::DOUBLE AS exact_email, CASE WHEN same THEN 0.9 ELSE 0.0 END::DOUBLE AS exact_handle, round(s, 6) AS handle_similarity, round(s, 6) AS name_similarity, 0.0::DOUBLE AS co_occurrence FROM pair"
DECISIONS = f"""WITH {_PAIR}, c AS (SELECT a, b, CASE WHEN s > 0.3 THEN (0.5 * s + 0.6 * s + CASE WHEN same THEN 0.63 ELSE 0 END) / (1.1 + CASE WHEN same THEN 0.7 ELSE 0 END) ELSE 0 END AS m,
    CASE WHEN s > 0.3 THEN 2 ELSE 0 END + CASE WHEN same THEN 1 ELSE 0 END AS n_fired FROM pair)
    SELECT a, b, round(m, 6) AS combined, n_fired, CASE WHEN round(m, 9) >= 0.95 AND n_fired >= 2 THEN 'auto' WHEN round(m, 9) >= 0.7 THEN 'propose' ELSE 'none' END AS decision FROM c"""
WINNER = f"WITH {_PAIR} SELECT a, b, CASE WHEN ea >= eb THEN a ELSE b END AS winner, CASE WHEN ea >= eb THEN b ELSE a END AS loser FROM pair"
CLUSTER = f"WITH {_ALIAS} SELECT 'identity:' || identity_id AS from_node, 'alias:' || source || ':' || x AS to_node, evidence AS weight FROM alias"
IDENTITIES_VISIBLE = f"WITH {_MEM} SELECT workspace, entity_key FROM mem GROUP BY ALL HAVING bool_or(list_has_any(allowed_principals, ['user:ali']))"
# Events of a source one after another: what is stored already only gains evidence; else the last hour's stored aliases of the workspace decide.
_INTAKE = """RECURSIVE ev AS (SELECT event_id AS alias_id, CASE WHEN user_id % 10 = 0 THEN 'ws1' ELSE 'ws0' END AS ws, event_type AS source, 'u' || (user_id * 7 + event_id % 7) AS ext, user_id,
        date_trunc('day', ts) AS ts, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts), event_id) AS k FROM events),
    told AS (
        SELECT alias_id, ws, source, ext, user_id, k, 'stored' AS outcome, 0 AS in_hour, 0 AS prior, 0.7::DOUBLE AS confidence, [ext] AS held, [{'w': ws, 't': ts}] AS log FROM ev WHERE k = 1
        UNION ALL
        SELECT alias_id, ws, source, ext, user_id, k, outcome, in_hour, prior, CASE WHEN outcome = 'stored' AND prior <= 1 THEN 0.7 ELSE 0.9 END::DOUBLE,
               CASE WHEN outcome = 'stored' THEN list_append(held, ext) ELSE held END, CASE WHEN outcome = 'stored' THEN list_append(log, {'w': ws, 't': ts}) ELSE log END
        FROM (SELECT *, CASE WHEN list_contains(held, ext) THEN 'bumped' WHEN in_hour >= 50 THEN 'refused' ELSE 'stored' END AS outcome
              FROM (SELECT ev.*, t.held, t.log, len(list_filter(t.log, lambda x: x.w = ev.ws AND x.t > ev.ts - INTERVAL 1 HOUR)) AS in_hour, len(list_filter(t.log, lambda x: x.w = ev.ws)) AS prior
                    FROM told t JOIN ev ON ev.source = t.source AND ev.k = t.k + 1)))"""
ALIAS_INTAKE = f"WITH {_INTAKE} SELECT alias_id, outcome, in_hour, prior, confidence FROM told"
ALIAS_TABLES = f"""WITH {_INTAKE}, st AS (SELECT *, 'person:user-' || user_id AS entity_key FROM told WHERE outcome = 'stored'),
    day AS (SELECT event_id AS alias_id, date_trunc('day', ts) AS ts FROM events),
    ids AS (SELECT ws, entity_key, arg_min(alias_id, {{'t': ts, 'i': alias_id}}) AS identity_id FROM st JOIN day USING (alias_id) GROUP BY ALL),
    seen AS (SELECT source, ext, count(*) FILTER (WHERE outcome <> 'refused') AS n FROM told GROUP BY ALL)
    SELECT identity_id, entity_key, 'User ' || user_id AS canonical_name, source, ext AS external_id, n AS evidence_count FROM st JOIN ids USING (ws, entity_key) JOIN seen USING (source, ext)"""
_SEVERAL = f"""{_ALIAS}, several AS (SELECT * FROM alias
    UNION ALL SELECT identity_id, workspace, 'chat', '@' || lower(replace(x, '#0000', '.')), evidence FROM alias WHERE identity_id % 3 <> 0
    UNION ALL SELECT identity_id, workspace, 'mail', 'user' || (identity_id // 8) || '@corp.example', 1 FROM alias WHERE identity_id % 2 = 0)"""
_LOCAL = "lower(string_split(ltrim(x, '@'), '@')[1])"
_NEAR = "CASE WHEN {0} = '' OR {1} = '' THEN 0 ELSE 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) END"
ALIAS_SIGNALS = f"""WITH {_SEVERAL}, full_ AS (SELECT s.identity_id, s.workspace, s.x, {_LOCAL} AS h, lower(n.name) AS name, evidence FROM several s JOIN (SELECT identity_id, x AS name FROM alias) n USING (identity_id)),
    notes AS (SELECT cast(c_nationkey AS VARCHAR) AS workspace, lower(c_name) AS p, lower(s_name) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey),
    hits AS (SELECT workspace, p, q, count(*) AS n FROM notes GROUP BY ALL),
    met AS (SELECT a.workspace, a.identity_id AS a, b.identity_id AS b, a.x AS xa, b.x AS xb, a.h AS ha, b.h AS hb, a.name AS na, b.name AS nb, a.evidence AS ea, b.evidence AS eb FROM full_ a JOIN full_ b ON a.workspace = b.workspace AND a.identity_id < b.identity_id),
    best AS (SELECT a, b, max(CASE WHEN contains(xa, '@c') AND lower(xa) = lower(xb) THEN 1.0 ELSE 0.0 END)::DOUBLE AS exact_email, max(CASE WHEN ha = hb THEN 0.9 ELSE 0.0 END)::DOUBLE AS exact_handle,
             round(max({_NEAR.format("ha", "hb")}), 6) AS handle_similarity, round(max({_NEAR.format("na", "nb")}), 6) AS name_similarity, coalesce(max(n), 0) AS hits, greatest(1, least(min(ea), min(eb))) AS evidence
             FROM met LEFT JOIN hits ON hits.workspace = met.workspace AND ((p = lower(xa) AND q = lower(xb)) OR (p = lower(xb) AND q = lower(xa))) GROUP BY a, b)
    SELECT a, b, exact_email, exact_handle, handle_similarity, name_similarity, round(least(1.0, hits / evidence), 6) AS co_occurrence FROM best"""
_DECIDED = f"""{_PAIR}, decided AS (SELECT *, CASE WHEN ea >= eb THEN a ELSE b END AS winner, CASE WHEN ea >= eb THEN b ELSE a END AS loser,
    round(CASE WHEN s > 0.3 THEN (1.1 * s + CASE WHEN same THEN 0.63 ELSE 0 END) / (1.1 + CASE WHEN same THEN 0.7 ELSE 0 END) ELSE 0 END, 9) AS m FROM pair)"""
# Merges link whole groups; the smallest that never lost stands for its group.
_GROUPS = """near AS (SELECT winner AS x, loser AS y FROM merges UNION SELECT loser, winner FROM merges),
    reach(x, y) AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x),
    groups AS (SELECT x, min(y) FILTER (WHERE y NOT IN (SELECT loser FROM merges)) AS root, min(y) AS least_ FROM (SELECT x, y FROM reach UNION SELECT x, x FROM near) GROUP BY x)"""
MERGE_CHAIN = f"""WITH RECURSIVE {_DECIDED}, merges AS (SELECT winner, loser FROM decided WHERE m >= 0.7), {_GROUPS}
    SELECT identity_id, coalesce(root, least_, identity_id) AS canonical_id FROM alias LEFT JOIN groups ON groups.x = identity_id"""
_PROPOSED = f"""{_DECIDED}, prop AS (SELECT *, a * 1000000 + b AS proposal_id FROM decided
    WHERE m >= 0.7 AND NOT ((a + b) % 7 < 3 AND ((a + b) % 2 <> 0)))"""
PROPOSALS = f"WITH {_PROPOSED} SELECT proposal_id, x.x AS name_a, y.x AS name_b, round(m, 6) AS combined FROM prop JOIN alias x ON x.identity_id = a JOIN alias y ON y.identity_id = b"
RESOLUTIONS = f"""WITH {_PROPOSED} SELECT CASE (a + b) % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, count(*) AS n FROM prop GROUP BY 1
    UNION ALL SELECT 'denied', count(*) FROM prop WHERE (a + b) % 3 = 1 UNION ALL SELECT 'merged', count(*) FROM prop WHERE (a + b) % 3 = 0"""
AFTER_MERGES = f"""WITH RECURSIVE {_PROPOSED}, merges AS (SELECT winner, loser FROM prop WHERE (a + b) % 3 = 0 AND loser % 5 <> 0), {_GROUPS},
    own AS (SELECT coalesce(root, least_, identity_id) AS identity_id, count(*) AS n_rows, count(DISTINCT source || ':' || x_) AS n_aliases
            FROM (SELECT identity_id, source, x AS x_ FROM alias) LEFT JOIN groups ON groups.x = identity_id GROUP BY 1)
    SELECT identity_id, n_aliases, n_rows FROM own"""
IDENTITY_LIST = f"""WITH {_SEVERAL} SELECT identity_id, n.name AS canonical_name, count(*) AS n_aliases, string_agg(source || ':' || x, ',' ORDER BY source, x) AS aliases
    FROM several JOIN (SELECT identity_id, x AS name FROM alias) n USING (identity_id) GROUP BY ALL"""
HANDLES = f"""WITH {_SEVERAL} SELECT identity_id, source, contains(x, '@') AND contains(x[strpos(x, '@') + 1 :], '.') AS is_email, {_LOCAL} AS handle, 'person:' || replace(lower(n.name), '#', '-') AS entity_key
    FROM several JOIN (SELECT identity_id, x AS name FROM alias) n USING (identity_id)"""

WORKSPACES = f"WITH {_MEM} SELECT 'ws' || (doc_id % 4) AS workspace FROM documents UNION SELECT workspace FROM mem"
WORKSPACES_ACL = f"WITH {_CH}, {_MEM} SELECT workspace FROM ch UNION SELECT workspace FROM mem"
IDENTITY_DETAIL = f"""WITH {_FOLD}, seen AS (SELECT *, {_EFF} AS eff FROM fold WHERE {_SEEN}),
    chosen AS (SELECT workspace, entity_key, id FROM seen WHERE superseded_by IS NULL QUALIFY row_number() OVER (PARTITION BY workspace, entity_key ORDER BY rank DESC, eff DESC, id DESC) = 1)
    SELECT workspace, entity_key, count(*) AS n_rows, count(*) FILTER (WHERE superseded_by IS NULL) AS n_live, any_value(b.id) AS current_id
    FROM seen LEFT JOIN chosen b USING (workspace, entity_key) GROUP BY ALL"""
JSON_ROWS = f"""WITH {_FOLD} SELECT '{{"workspace":"' || workspace || '","entity_key":"' || entity_key || '","n_rows":' || count(*) || '}}' AS json FROM fold WHERE {_SEEN} GROUP BY workspace, entity_key"""
TOKENS = "SELECT 'c' || c_custkey || '@corp.example' AS email, 'human' AS source_type FROM customer WHERE sha256('token-' || c_custkey) = sha256('token-7')"
SCOPES = """SELECT * FROM (SELECT 'c' || c_custkey || '@corp.example' AS email,
    array_to_string(list_sort(list_intersect(CASE WHEN c_nationkey % 2 = 0 THEN ['ws0', 'ws2'] ELSE ['ws1'] END, ['ws1', 'ws2'])), ',') AS workspaces,
    array_to_string(list_sort(list_intersect(['group:all', 'group:' || CASE c_custkey % 3 WHEN 0 THEN 'exec' WHEN 1 THEN 'sales' ELSE 'eng' END], ['group:exec', 'group:sales'])), ',') AS principals FROM customer)
    WHERE workspaces <> '' AND principals <> ''"""
PIPELINE_STATS = f"""WITH {_CH}, {_MEM}, acl AS (SELECT content_hash, workspace, arg_min(allowed_principals, {_AT}) AS allowed_principals FROM ch GROUP BY ALL),
    seen AS (SELECT * FROM acl WHERE workspace = 'ws1' AND {_SEEN})
    SELECT 'raw_events' AS metric, count(*) AS value FROM items WHERE workspace = 'ws1'
    UNION ALL SELECT 'chunks_in_workspace', count(*) FROM seen
    UNION ALL SELECT 'unique_content_hashes', count(DISTINCT content_hash) FROM seen
    UNION ALL SELECT 'embeddings', count(DISTINCT content_hash) FROM ch
    UNION ALL SELECT 'memory_rows', count(*) FROM mem WHERE workspace = 'ws1' AND {_SEEN}
    UNION ALL SELECT 'source:' || source, count(*) FROM items WHERE workspace = 'ws1' GROUP BY source"""
HYDRATE = """SELECT cast(doc_id AS VARCHAR) AS id, length(text) AS n_chars FROM documents WHERE doc_id IN (1, 5, 7, 42, 99)
    UNION ALL SELECT 'mem:' || event_id, length(event_type || ' by user ' || user_id) FROM events WHERE event_id IN (3, 8)"""
