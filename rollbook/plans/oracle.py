"""For every registered query, SQL over the provided tables that must give the same rows.

Written for DuckDB and independent of the Spark code: the folds, for example, are stated with running
windows over single events rather than with aggregates per key.
"""

from __future__ import annotations

# --- the record tables as SQL --------------------------------------------------------------------

VIEWS = {
    "class": """
SELECT CAST(n_nationkey AS BIGINT) AS class_uid, n_name AS class_name,
       CASE WHEN n_nationkey % 12 = 11 THEN 0 ELSE 1 END AS status,
       DATE '2020-01-01' + CAST(n_nationkey % 7 AS INT) AS created FROM nation""",
    "teacher": """
SELECT s_suppkey AS teacher_uid, s_name AS teacher_name, lower(s_name) AS username FROM supplier""",
    "student": """
SELECT c_custkey AS student_uid, c_name AS student_name, lower(c_name) AS username,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(16 + c_custkey % 10 AS INT) END AS age,
       CAST(c_nationkey AS BIGINT) AS class_uid,
       CASE WHEN c_custkey % 20 = 0 THEN 0 ELSE 1 END AS status,
       DATE '2020-01-01' + CAST(c_custkey % 365 AS INT) AS created FROM customer""",
    "course": """
SELECT p_partkey AS course_uid, p_name AS course_name, p_partkey % 10 AS teacher_uid,
       CAST(p_size % 27 AS BIGINT) AS class_uid,
       CASE WHEN p_partkey % 20 = 0 THEN 0 ELSE 1 END AS status,
       DATE '2020-01-01' + CAST(p_partkey % 365 AS INT) AS created FROM part""",
    "score_change": """
SELECT l_partkey AS course_uid, o_custkey AS student_uid, l_quantity AS score,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS status,
       l_shipdate AS ts, l_orderkey AS seq1, l_linenumber AS seq2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "score": """
SELECT course_uid, student_uid, score, status, created, updated FROM (
  SELECT *, row_number() OVER (PARTITION BY course_uid, student_uid
                               ORDER BY ts DESC, seq1 DESC, seq2 DESC, score DESC) AS rn,
         min(ts) OVER (PARTITION BY course_uid, student_uid) AS created, ts AS updated
  FROM score_change) t WHERE rn = 1""",
    "numbered_event": """
SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""",
    "score_event": """
SELECT CAST(seq1 * 1000 + seq2 * 100 + CAST(score AS BIGINT) AS BIGINT) AS event_id, ts,
       CASE WHEN seq2 % 3 = 0 THEN 'patch' ELSE 'create' END AS op,
       course_uid, student_uid, score, status
FROM score_change""",
    "score_state": """
SELECT course_uid, student_uid, score, status, created, ts AS updated,
       ts AS applied_ts, event_id AS applied_id FROM (
  SELECT *, row_number() OVER (PARTITION BY course_uid, student_uid
                               ORDER BY ts DESC, event_id DESC, score DESC, status DESC) AS rn,
         min(ts) OVER (PARTITION BY course_uid, student_uid) AS created
  FROM score_event WHERE ts < TIMESTAMP '1998-06-01') t WHERE rn = 1""",
    "score_run": """
SELECT f.*, s.course_uid IS NOT NULL AS known,
       max(CASE WHEN f.op = 'create' THEN 1 ELSE 0 END) OVER (
         PARTITION BY f.course_uid, f.student_uid ORDER BY f.ts, f.event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS born
FROM score_event f LEFT JOIN score_state s
  ON f.course_uid = s.course_uid AND f.student_uid = s.student_uid
WHERE f.ts >= TIMESTAMP '1998-06-01'""",
    "student_state": """
SELECT CAST(student_uid AS VARCHAR) AS student_uid, student_name, username, age,
       CAST(class_uid AS VARCHAR) AS class_uid, status, CAST(created AS TIMESTAMP) AS created,
       CASE WHEN student_uid % 3 = 0 THEN TIMESTAMP '2024-01-10' END AS updated,
       CASE WHEN student_uid % 3 = 0 THEN TIMESTAMP '2024-01-10' END AS applied_ts,
       CASE WHEN student_uid % 3 = 0 THEN CAST(0 AS BIGINT) END AS applied_id FROM student""",
    "student_feed": """
SELECT event_id, ts, op,
       CASE WHEN op <> 'create' THEN CAST(user_id * 11 AS VARCHAR) END AS student_uid,
       CASE WHEN op = 'create' AND k % 10 <> 9 THEN 'Pupil ' || CAST(user_id % 40 AS VARCHAR)
            WHEN event_type = 'click' AND k % 2 = 0 THEN 'Renamed ' || CAST(k AS VARCHAR)
            ELSE '' END AS student_name,
       CASE WHEN op = 'create' AND k % 4 = 1 OR event_type = 'click' AND k % 5 = 1
              THEN 'customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0')
            WHEN op = 'create' AND k % 4 > 1 OR event_type = 'click' AND k % 5 = 0
              THEN 'pupil' || CAST(user_id % 50 AS VARCHAR) || '_' || CAST(k % 20 AS VARCHAR)
            ELSE '' END AS username,
       CASE WHEN (op = 'create' OR event_type = 'purchase') AND k % 3 > 0
              THEN CAST(k % 30 AS INT) END AS age,
       CASE WHEN op = 'create' OR k % 7 = 0 THEN CAST(k % 25 AS VARCHAR) END AS class_uid
FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'patch'
             WHEN 'purchase' THEN 'patch' WHEN 'error' THEN 'delete' ELSE event_type END AS op
      FROM numbered_event) t""",
    # one row per event: seq is the global order, uid the row it is about
    "student_event": """
SELECT f.event_id, f.ts, f.op, row_number() OVER (ORDER BY f.ts, f.event_id) AS seq,
       CASE WHEN op = 'create' THEN md5(concat_ws(':', CAST(event_id AS VARCHAR), name))
            ELSE student_uid END AS uid,
       nullif(student_name, '') AS student_name, nullif(name, '') AS name, age,
       nullif(class_uid, '') AS class_uid
FROM (SELECT *, CASE WHEN op = 'create' AND username = '' THEN student_name ELSE username END AS name
      FROM student_feed) f""",
    "student_claim": """
SELECT e.*, s.student_uid IS NOT NULL AS known,
       s.student_uid IS NOT NULL AND coalesce(
         (e.ts < s.applied_ts OR e.ts = s.applied_ts AND e.event_id <= s.applied_id), false) AS late,
       o.student_uid AS owner
FROM student_event e LEFT JOIN student_state s ON e.uid = s.student_uid
LEFT JOIN student_state o ON e.name = o.username""",
    # names, event by event: each step sees the rows as all earlier events left them
    "student_walk": """
WITH RECURSIVE ask AS (
  SELECT row_number() OVER (ORDER BY seq) AS n, seq, op, uid, name FROM student_claim
  WHERE NOT late AND name IS NOT NULL AND (op = 'create' AND student_name IS NOT NULL OR op = 'patch')),
step AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, '' AS outcome,
         (SELECT list({'uid': student_uid, 'name': username}) FROM student_state) AS rows
  UNION ALL
  SELECT n, seq, outcome, CASE WHEN outcome IN ('born', 'moved')
           THEN list_append(list_filter(rows, lambda x: x.uid <> uid), {'uid': uid, 'name': name}) ELSE rows END
  FROM (SELECT a.*, s.rows, CASE
          WHEN op = 'create' THEN CASE WHEN len(list_filter(s.rows, lambda x: x.name = a.name)) > 0 THEN 'held' ELSE 'born' END
          WHEN len(list_filter(s.rows, lambda x: x.name = a.name AND x.uid <> a.uid)) > 0 THEN 'taken'
          WHEN len(list_filter(s.rows, lambda x: x.uid = a.uid)) = 0 THEN 'absent'
          WHEN len(list_filter(s.rows, lambda x: x.uid = a.uid AND x.name = a.name)) > 0 THEN 'same' ELSE 'moved' END AS outcome
        FROM step s JOIN ask a ON a.n = s.n + 1) t)
SELECT seq, outcome FROM step""",
    "student_verdict": """
SELECT c.*, outcome, CASE
    WHEN op NOT IN ('create', 'patch', 'delete') THEN 'unknown_op'
    WHEN op = 'create' AND student_name IS NULL THEN 'no_name'
    WHEN late THEN 'late'
    WHEN op = 'create' THEN CASE outcome WHEN 'born' THEN 'born' ELSE 'name_taken' END
    WHEN outcome = 'taken' THEN 'name_taken'
    WHEN op = 'patch' AND student_name IS NULL AND name IS NULL AND age IS NULL
         AND class_uid IS NULL THEN 'nothing'
    WHEN NOT known THEN 'no_match' ELSE 'ok' END AS verdict
FROM student_claim c LEFT JOIN student_walk USING (seq)""",
    "course_state": """
SELECT CAST(course_uid AS VARCHAR) AS course_uid, course_name,
       CAST(teacher_uid AS VARCHAR) AS teacher_uid, CAST(class_uid AS VARCHAR) AS class_uid, status,
       CAST(created AS TIMESTAMP) AS created,
       CASE WHEN course_uid % 3 = 0 THEN TIMESTAMP '2024-01-10' END AS updated,
       CASE WHEN course_uid % 3 = 0 THEN TIMESTAMP '2024-01-10' END AS applied_ts,
       CASE WHEN course_uid % 3 = 0 THEN CAST(0 AS BIGINT) END AS applied_id FROM course""",
    "course_feed": """
SELECT event_id, ts, op,
       CASE WHEN op <> 'create' THEN CAST(target AS VARCHAR) END AS course_uid,
       CASE WHEN op <> 'create' AND k % 4 = 0 THEN 'none'
            ELSE CAST(target % 10 AS VARCHAR) END AS teacher_uid,
       CASE WHEN event_type = 'signup' AND k % 2 = 0 THEN '9' || CAST(k % 3 AS VARCHAR)
            WHEN op = 'create' THEN CAST(p_size % 27 AS VARCHAR)
            WHEN op = 'patch' AND k % 3 = 0 THEN CAST(k % 27 AS VARCHAR) ELSE '' END AS class_uid,
       CASE WHEN op = 'create' THEN p_name
            WHEN event_type = 'click' THEN 'patched ' || CAST(k AS VARCHAR) ELSE '' END AS course_name
FROM (SELECT *, user_id * 10 + k AS target,
             CASE WHEN event_type IN ('signup', 'error') THEN 'create'
                  WHEN event_type IN ('click', 'view') THEN 'patch' ELSE 'delete' END AS op
      FROM numbered_event) t LEFT JOIN part ON target = p_partkey""",
    "course_event": """
SELECT f.*, row_number() OVER (ORDER BY f.ts, f.event_id) AS seq,
       f.op = 'create' AND (f.class_uid IS NULL OR f.course_name IS NULL) AS no_name,
       coalesce((f.ts < s.applied_ts OR f.ts = s.applied_ts AND f.event_id <= s.applied_id), false) AS late
FROM course_feed f LEFT JOIN course_state s
  ON f.op <> 'create' AND f.course_uid = s.course_uid AND f.teacher_uid = s.teacher_uid""",
    "course_walk": """
WITH RECURSIVE ask AS (
  SELECT row_number() OVER (ORDER BY seq) AS n, seq, op, teacher_uid AS t, nullif(class_uid, '') AS c,
         nullif(course_name, '') AS m,
         CASE WHEN op = 'create' THEN md5(concat_ws(':', CAST(event_id AS VARCHAR), course_name)) ELSE course_uid END AS uid
  FROM course_event WHERE NOT late AND NOT no_name
    AND (op <> 'patch' OR class_uid <> '' OR course_name <> '')),
step AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, '' AS holder, '' AS op,
         (SELECT list({'u': course_uid, 't': teacher_uid, 'c': class_uid, 'm': course_name, 'off': status <> 1})
          FROM course_state) AS rows
  UNION ALL
  SELECT n, seq, holder, op, CASE
      WHEN op = 'create' AND holder = uid THEN list_append(rows, {'u': uid, 't': t, 'c': c, 'm': m, 'off': false})
      ELSE list_transform(rows, lambda x: CASE WHEN x.u <> holder OR x.t <> t THEN x
        ELSE {'u': x.u, 't': x.t, 'c': CASE WHEN op = 'patch' THEN coalesce(c, x.c) ELSE x.c END,
              'm': CASE WHEN op = 'patch' THEN coalesce(m, x.m) ELSE x.m END,
              'off': CASE op WHEN 'create' THEN false WHEN 'delete' THEN true ELSE x.off END} END) END
  FROM (SELECT a.*, s.rows, CASE WHEN a.op <> 'create' THEN a.uid ELSE coalesce(list_sort(list_transform(
          list_filter(s.rows, lambda x: x.t = a.t AND x.c = a.c AND x.m = a.m),
          lambda x: {'off': x.off, 'u': x.u}))[1].u, a.uid) END AS holder
        FROM step s JOIN ask a ON a.n = s.n + 1) z)
SELECT seq, holder FROM step WHERE op = 'create'""",
    "course_target": """
SELECT e.* EXCLUDE (course_uid), CASE WHEN op <> 'create' THEN course_uid ELSE holder END AS course_uid,
       op = 'create' AND holder = md5(concat_ws(':', CAST(event_id AS VARCHAR), course_name)) AS birth
FROM course_event e LEFT JOIN course_walk USING (seq) WHERE NOT no_name""",
    # events that reach a row, with the status the row has just before each of them
    "course_run": """
SELECT t.*, s.course_uid IS NOT NULL AS known,
       coalesce(lag(CASE op WHEN 'create' THEN 1 WHEN 'delete' THEN 0 END IGNORE NULLS) OVER (
         PARTITION BY t.course_uid ORDER BY seq), s.status) AS status_before
FROM course_target t LEFT JOIN course_state s
  ON t.course_uid = s.course_uid AND t.teacher_uid = s.teacher_uid
WHERE (s.course_uid IS NOT NULL OR op = 'create')
  AND NOT coalesce((t.ts < s.applied_ts OR t.ts = s.applied_ts AND t.event_id <= s.applied_id), false)""",
    "class_state": """
SELECT CAST(class_uid AS VARCHAR) AS class_uid, class_name, status,
       CAST(created AS TIMESTAMP) AS created,
       CASE WHEN class_uid % 3 = 0 THEN TIMESTAMP '2024-01-10' END AS updated,
       CASE WHEN class_uid % 3 = 0 THEN TIMESTAMP '2024-01-10' END AS applied_ts,
       CASE WHEN class_uid % 3 = 0 THEN CAST(0 AS BIGINT) END AS applied_id FROM class""",
    "class_feed": """
SELECT event_id, ts,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'rename'
            WHEN 'error' THEN 'delete' ELSE event_type END AS op,
       CASE WHEN event_type <> 'signup' THEN CAST(user_id % 30 AS VARCHAR) END AS class_uid,
       CASE WHEN event_type = 'click' AND k % 9 = 0 THEN ''
            WHEN event_type = 'click' THEN 'NATION_' || CAST((user_id * 7 + k) % 90 AS VARCHAR)
            WHEN event_type = 'signup' THEN 'NATION_' || CAST(k % 40 AS VARCHAR) END AS class_name
FROM numbered_event""",
    "class_event": """
SELECT f.event_id, f.ts, f.op, nullif(f.class_name, '') AS name,
       row_number() OVER (ORDER BY f.ts, f.event_id) AS seq,
       CASE WHEN op = 'create' THEN md5(concat_ws(':', CAST(event_id AS VARCHAR), f.class_name))
            ELSE f.class_uid END AS uid,
       s.class_uid IS NOT NULL AS known, o.class_uid AS owner,
       coalesce((f.ts < s.applied_ts OR f.ts = s.applied_ts AND f.event_id <= s.applied_id), false) AS late
FROM class_feed f LEFT JOIN class_state s ON f.op <> 'create' AND f.class_uid = s.class_uid
LEFT JOIN class_state o ON f.class_name = o.class_name""",
    "class_walk": """
WITH RECURSIVE ask AS (
  SELECT row_number() OVER (ORDER BY seq) AS n, seq, op, uid, name FROM class_event
  WHERE NOT late AND name IS NOT NULL AND op IN ('create', 'rename')),
step AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, '' AS outcome, '' AS holder,
         (SELECT list({'uid': class_uid, 'name': class_name}) FROM class_state) AS rows
  UNION ALL
  SELECT n, seq, outcome, holder, CASE WHEN outcome IN ('born', 'moved')
           THEN list_append(list_filter(rows, lambda x: x.uid <> uid), {'uid': uid, 'name': name}) ELSE rows END
  FROM (SELECT a.*, s.rows, coalesce(list_filter(s.rows, lambda x: x.name = a.name)[1].uid, a.uid) AS holder, CASE
          WHEN op = 'create' THEN CASE WHEN len(list_filter(s.rows, lambda x: x.name = a.name)) > 0 THEN 'held' ELSE 'born' END
          WHEN len(list_filter(s.rows, lambda x: x.uid = a.uid)) = 0 THEN 'absent'
          WHEN len(list_filter(s.rows, lambda x: x.uid = a.uid AND x.name = a.name)) > 0 THEN 'same'
          WHEN len(list_filter(s.rows, lambda x: x.name = a.name)) > 0 THEN 'taken' ELSE 'moved' END AS outcome
        FROM step s JOIN ask a ON a.n = s.n + 1) t)
SELECT seq, outcome, holder FROM step""",
    "class_verdict": """
SELECT e.*, outcome, holder, CASE WHEN op NOT IN ('create', 'rename', 'delete') THEN 'unknown_op'
               WHEN op = 'create' THEN CASE outcome WHEN 'born' THEN 'born' ELSE 'ok' END
               WHEN late THEN 'late'
               WHEN op = 'rename' AND name IS NULL THEN 'nothing'
               WHEN NOT known THEN 'no_match'
               WHEN outcome = 'taken' THEN 'name_taken' ELSE 'ok' END AS verdict
FROM class_event e LEFT JOIN class_walk USING (seq)""",
    # accepted events, with the target row
    "class_run": """
SELECT *
FROM (SELECT v.*, CASE WHEN op = 'create' THEN holder ELSE uid END AS target
      FROM class_verdict v WHERE verdict IN ('ok', 'born')) a
WHERE NOT EXISTS (SELECT 1 FROM class_state s WHERE s.class_uid = a.target
                  AND (a.ts < s.applied_ts OR a.ts = s.applied_ts AND a.event_id <= s.applied_id))""",
}

# Which views each view reads, in the order they must be defined.
NEEDS = {
    "score": ["score_change"],
    "score_event": ["score_change"],
    "score_state": ["score_event"],
    "score_run": ["score_state"],
    "student_state": ["student"],
    "student_feed": ["numbered_event"],
    "student_event": ["student_feed"],
    "student_claim": ["student_event", "student_state"],
    "student_walk": ["student_claim", "student_state"],
    "student_verdict": ["student_claim", "student_walk"],
    "course_state": ["course"],
    "course_feed": ["numbered_event"],
    "course_event": ["course_feed", "course_state"],
    "course_walk": ["course_event", "course_state"],
    "course_target": ["course_event", "course_walk"],
    "course_run": ["course_target", "course_state"],
    "class_state": ["class"],
    "class_feed": ["numbered_event"],
    "class_event": ["class_feed", "class_state"],
    "class_walk": ["class_event", "class_state"],
    "class_verdict": ["class_event", "class_walk"],
    "class_run": ["class_verdict"],
}


def _ordered(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _ordered(NEEDS.get(name, []), seen)
            seen.append(name)
    return seen


def sql(views: str, body: str) -> str:
    """The body with the named views (and what they need) in front of it."""
    named = [f"{name} AS ({VIEWS[name].strip()})" for name in _ordered(views.split(), [])]
    return ("WITH " + ",\n".join(named) + "\n" if named else "") + body.strip()


PAGED = """user_id % 4 AS page, event_id % 9 + 2 AS size,
    CASE WHEN user_id % 3 = 0 THEN 'desc' WHEN user_id % 3 = 1 THEN 'asc' WHEN user_id % 7 = 2 THEN 'up' ELSE 'asc' END AS way"""
ASKED = f"""
, asked AS (SELECT event_id AS request_id, event_id * user_id % 1500 AS course_uid, {PAGED} FROM events)"""
SCOPED = f"""
, request AS (SELECT event_id AS request_id, CASE WHEN event_id % 2 = 0 THEN 'student' ELSE 'teacher' END AS identity, user_id AS user_uid,
    CASE event_type WHEN 'click' THEN 'course' WHEN 'view' THEN 'own_score' WHEN 'error' THEN 'class' ELSE 'grades' END AS resource, {PAGED} FROM events),
judged AS (SELECT *, resource = 'own_score' AND identity = 'student' OR resource IN ('course', 'class') AND identity = 'teacher' AS allowed FROM request)"""
MATCHED = """
, asked AS (SELECT event_id, user_id, event_type FROM events WHERE NOT (event_type = 'error' AND user_id % 10 = 0)),
matched AS (
  SELECT event_type, user_id, event_id, student_uid FROM asked JOIN student ON
    CASE event_type WHEN 'signup' THEN username LIKE '%' || CAST(user_id % 20 AS VARCHAR) || '%' ELSE class_uid = user_id % 26 END
    AND (event_type <> 'click' OR age IN (16 + event_id % 10, 16 + user_id % 7))
    AND (event_type NOT IN ('click', 'view') OR status = 1)
    AND (event_type <> 'view' OR student_name LIKE '%' || CAST(user_id % 20 AS VARCHAR) || '%' OR username LIKE '%' || CAST(user_id % 20 AS VARCHAR) || '%'))"""

ORACLE: dict[str, str] = {
    # --- scans, filters ---
    "scan_student": sql("", """
SELECT c_custkey AS student_uid, c_name AS student_name, lower(c_name) AS username FROM customer"""),
    "choose_database": sql("", """
SELECT 'users' AS db, c_custkey AS uid, c_name AS name FROM customer UNION ALL SELECT 'staff', s_suppkey, s_name FROM supplier"""),
    "filter_compare": sql("student", """
SELECT * FROM student WHERE age >= 18 AND age < 24 AND class_uid <> 7 AND status = 1
  AND student_name NOT LIKE '%9%' AND regexp_matches(username, '[0-7]$')"""),
    "filter_in": sql("course", "SELECT * FROM course WHERE class_uid IN (1, 3, 26) AND course_uid NOT IN (class_uid, 5)"),
    "filter_not_in": sql("student class", """
SELECT * FROM student WHERE age NOT IN (17, 19)
  AND class_uid NOT IN (SELECT class_uid FROM class WHERE status = 0)"""),
    "filter_between": sql("score", "SELECT * FROM score WHERE score BETWEEN 10 AND 20"),
    "filter_and_or": sql("student", """
SELECT * FROM student WHERE class_uid = 3 OR age > 20 AND (student_name LIKE '%1%' OR status = 0)"""),
    "filter_kwargs": sql("student", """
SELECT * FROM student WHERE class_uid IN (1, 2, 3) AND status = 1"""),
    "keyword_search": sql("course", """
SELECT * FROM course WHERE status = 1 AND course_name LIKE '%w_d%'"""),
    "keyword_multi": sql("student", """
SELECT * FROM student
WHERE (student_name LIKE '%r#0%1%' OR username LIKE '%r#0%1%') AND status = 1"""),
    "scoped_read": sql("course score class", """
, request AS (SELECT event_id AS request_id,
    CASE WHEN event_id % 2 = 0 THEN 'student' ELSE 'teacher' END AS identity, user_id AS user_uid,
    CASE event_type WHEN 'click' THEN 'course' WHEN 'view' THEN 'own_score'
         WHEN 'signup' THEN 'course_score' WHEN 'error' THEN 'class' ELSE 'grades' END AS resource
  FROM events),
taught AS (SELECT teacher_uid, count(*) AS n FROM course WHERE status = 1 GROUP BY teacher_uid),
scored AS (SELECT student_uid, count(*) AS n FROM score WHERE status = 1 GROUP BY student_uid),
judged AS (SELECT *, resource = 'own_score' AND identity = 'student'
    OR resource IN ('course', 'course_score', 'class') AND identity = 'teacher' AS allowed FROM request)
SELECT request_id, identity, user_uid, resource, allowed,
  CAST(CASE WHEN NOT allowed THEN 0 WHEN resource = 'course' THEN coalesce(t.n, 0)
       WHEN resource = 'own_score' THEN coalesce(s.n, 0)
       WHEN resource = 'class' THEN (SELECT count(*) FROM class WHERE status = 1)
       ELSE (SELECT count(*) FROM score WHERE status = 1) END AS BIGINT) AS visible
FROM judged LEFT JOIN taught t ON user_uid = teacher_uid LEFT JOIN scored s ON user_uid = student_uid
"""),
    "scoped_pages": sql("course score class", SCOPED + """
, ranked AS (
  SELECT 'course' AS resource, teacher_uid AS owner, course_uid AS uid, course_name AS value, way,
         row_number() OVER (PARTITION BY way, teacher_uid ORDER BY CASE way WHEN 'asc' THEN created END NULLS LAST, CASE way WHEN 'desc' THEN created END DESC, course_uid) AS pos
  FROM course, (VALUES ('asc'), ('desc')) w(way) WHERE status = 1
  UNION ALL SELECT 'own_score', student_uid, course_uid, CAST(CAST(score AS BIGINT) AS VARCHAR), way,
         row_number() OVER (PARTITION BY way, student_uid ORDER BY CASE way WHEN 'asc' THEN score ELSE -score END, course_uid)
  FROM score, (VALUES ('asc'), ('desc')) w(way) WHERE status = 1
  UNION ALL SELECT 'class', NULL, class_uid, class_name, way,
         row_number() OVER (PARTITION BY way ORDER BY CASE way WHEN 'asc' THEN created END NULLS LAST, CASE way WHEN 'desc' THEN created END DESC, class_uid)
  FROM class, (VALUES ('asc'), ('desc')) w(way) WHERE status = 1)
SELECT request_id, r.resource, pos, uid, value FROM judged j
JOIN ranked r ON r.resource = j.resource AND r.way = j.way AND (j.resource = 'class' OR owner = user_uid) AND pos BETWEEN (page - 1) * size + 1 AND page * size
WHERE allowed AND page >= 1"""),
    "scoped_refused": sql("course score class", SCOPED + """
SELECT request_id, resource, CASE WHEN NOT allowed THEN 'forbidden' WHEN way NOT IN ('asc', 'desc') THEN 'direction' ELSE 'page' END AS reason
FROM judged WHERE NOT allowed OR way NOT IN ('asc', 'desc') OR page < 1"""),
    # --- listings, counts, groups ---
    "requested_pages": sql("score", ASKED + """
, ranked AS (SELECT course_uid, student_uid, score, way,
         row_number() OVER (PARTITION BY way, course_uid ORDER BY CASE way WHEN 'asc' THEN score ELSE -score END, student_uid) AS pos
  FROM score, (VALUES ('asc'), ('desc')) w(way) WHERE status = 1)
SELECT request_id, course_uid, page, pos, student_uid, score FROM asked JOIN ranked USING (course_uid, way)
WHERE page >= 1 AND pos BETWEEN (page - 1) * size + 1 AND page * size"""),
    "requested_totals": sql("score", ASKED + """
, n AS (SELECT course_uid, count(*) AS total FROM score WHERE status = 1 GROUP BY course_uid)
SELECT request_id, coalesce(total, 0) AS total, CAST(ceil(coalesce(total, 0) / size) AS BIGINT) AS total_page
FROM asked LEFT JOIN n USING (course_uid) WHERE page >= 1 AND way IN ('asc', 'desc')"""),
    "rejected_page_requests": sql("", ASKED.lstrip().removeprefix(",").join(["WITH", ""]) + """
SELECT request_id, CASE WHEN way NOT IN ('asc', 'desc') THEN 'direction' ELSE 'page' END AS reason FROM asked WHERE page < 1 OR way NOT IN ('asc', 'desc')"""),
    "keyword_batch": sql("course", r"""
, word AS (SELECT p_size AS z, p_name AS n, substr(p_name, p_size % 6 + 1, p_size % 7 + 1) AS part FROM part),
keyword AS (SELECT DISTINCT replace(CASE WHEN z % 5 = 0 THEN translate(part, 'ae', '__') WHEN z % 11 = 0 THEN substr(n, 1, 2) || '%' || right(n, 2) ELSE part END, ' ', '') AS keyword FROM word)
SELECT keyword, count(*) AS matches, min(course_uid) AS first_uid
FROM keyword JOIN course ON course_name LIKE '%' || keyword || '%' WHERE status = 1 AND keyword <> '' GROUP BY keyword"""),
    "filters_counted": sql("student", f"""
{MATCHED}
SELECT event_id AS filter_id, count(student_uid) AS matches
FROM asked LEFT JOIN matched USING (event_type, user_id, event_id) GROUP BY event_id"""),
    "filters_matched": sql("student", f"""
{MATCHED}
SELECT student_uid, count(*) AS filters, min(event_id) AS first_filter, max(event_id) AS last_filter FROM matched GROUP BY student_uid"""),
    "filters_refused": """
SELECT event_id AS filter_id, 'unknown_column' AS reason FROM events WHERE event_type = 'error' AND user_id % 10 = 0""",
    "pages_course_scores": sql("score student", """
SELECT t.course_uid, t.student_uid, t.score, (pos - 1) // 20 + 1 AS page, pos,
       coalesce(student_name, '') AS student_name
FROM (SELECT *, row_number() OVER (PARTITION BY course_uid ORDER BY score DESC, student_uid) AS pos
      FROM score WHERE status = 1) t LEFT JOIN student USING (student_uid)"""),
    "pages_hot_scores": sql("score", """
SELECT course_uid, student_uid, score, (pos - 1) // 20 + 1 AS page, pos
FROM (SELECT *, row_number() OVER (PARTITION BY course_uid ORDER BY score DESC, student_uid) AS pos
      FROM score WHERE status = 1) t"""),
    "pages_students": sql("student", """
SELECT class_uid, student_uid, student_name, age, username, (pos - 1) // 20 + 1 AS page, pos
FROM (SELECT *, row_number() OVER (PARTITION BY class_uid ORDER BY created DESC, student_uid) AS pos
      FROM student WHERE status = 1 AND student_name LIKE '%#0%') t"""),
    "pages_courses": sql("course class", """
SELECT t.teacher_uid, t.course_uid, t.course_name, t.class_uid, (pos - 1) // 20 + 1 AS page, pos,
       coalesce(class_name, '') AS class_name
FROM (SELECT *, row_number() OVER (PARTITION BY teacher_uid ORDER BY created DESC, course_uid) AS pos
      FROM course WHERE status = 1) t LEFT JOIN class USING (class_uid)"""),
    "pages_student_scores": sql("score course", """
SELECT t.student_uid, t.course_uid, t.score, (pos - 1) // 20 + 1 AS page, pos,
       coalesce(course_name, '') AS course_name
FROM (SELECT *, row_number() OVER (PARTITION BY student_uid ORDER BY created DESC, course_uid) AS pos
      FROM score WHERE status = 1) t LEFT JOIN course USING (course_uid)"""),
    "pages_classes": sql("class", """
SELECT class_uid, class_name, (pos - 1) // 10 + 1 AS page, pos
FROM (SELECT *, row_number() OVER (ORDER BY created DESC, class_uid) AS pos
      FROM class WHERE status = 1) t"""),
    "order_page": sql("student", """
SELECT student_uid, student_name, age FROM student
WHERE class_uid IN (1, 2, 3, 4) AND status = 1
ORDER BY age ASC NULLS FIRST, created DESC NULLS LAST, student_uid LIMIT 20 OFFSET 20"""),
    "key_page": sql("student", """
SELECT student_uid, username FROM student WHERE status = 1 ORDER BY student_uid LIMIT 25 OFFSET 50"""),
    "deep_page": sql("score_change", """
SELECT course_uid, student_uid, score, seq1, seq2 FROM score_change
ORDER BY ts DESC, abs(score - 25), seq1, seq2 LIMIT 500 OFFSET 3000"""),
    "first_row": sql("student", """
SELECT class_uid, student_uid, student_name, created
FROM (SELECT *, row_number() OVER (PARTITION BY class_uid ORDER BY created, student_uid) AS rn
      FROM student) t WHERE rn = 1"""),
    "count_active": sql("student", """
SELECT class_uid, count(*) AS total FROM student WHERE status = 1 GROUP BY class_uid"""),
    "page_counts": sql("score", """
SELECT course_uid, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_page
FROM score WHERE status = 1 GROUP BY course_uid"""),
    "query_counts": sql("course", """
SELECT count(*) AS total, CAST(ceil(count(*) / 7.0) AS BIGINT) AS total_page
FROM course WHERE status = 1 AND class_uid = 5"""),
    "group_agg": sql("student", """
SELECT class_uid, status, count(*) AS students, avg(age) AS mean_age, max(created) AS newest
FROM student GROUP BY class_uid, status"""),
    "group_having": sql("score", """
SELECT course_uid, count(*) AS scores, max(score) AS best FROM score GROUP BY course_uid
HAVING count(*) >= 30 AND max(score) = 50"""),
    # --- lookups ---
    "lookup_course_class": sql("course class", """
SELECT course_uid, course_name, class_uid, coalesce(class_name, '') AS class_name
FROM course LEFT JOIN class USING (class_uid)"""),
    "lookup_score_course": sql("score course", """
SELECT student_uid, course_uid, score, coalesce(course_name, '') AS course_name
FROM score LEFT JOIN course USING (course_uid)"""),
    "lookup_score_student": sql("score student", """
SELECT course_uid, student_uid, score, coalesce(student_name, '') AS student_name
FROM score LEFT JOIN student USING (student_uid)"""),
    "profiles": sql("student teacher class", """
SELECT 'student' AS identity, student_uid AS user_uid,
       coalesce(class_name, '') || ' ' || student_name AS name
FROM student s LEFT JOIN class c ON s.class_uid = c.class_uid AND s.student_uid % 9 <> 0
UNION ALL SELECT 'teacher', teacher_uid, teacher_name FROM teacher"""),
    "semi_keys": sql("course score", """
SELECT course_uid, course_name FROM course
WHERE course_uid IN (SELECT course_uid FROM score WHERE score >= 49)"""),
    "exists_check": sql("score", """
SELECT event_id, event_id % 2500 AS course_uid, user_id AS student_uid,
       EXISTS (SELECT 1 FROM score s WHERE s.course_uid = event_id % 2500 AND s.student_uid = user_id)
         AS "exists"
FROM events"""),
    # --- writes ---
    "append_rows": sql("student teacher", """
SELECT student_uid, student_name, username, age, class_uid, status, created FROM student
UNION ALL SELECT teacher_uid + 1000000000, teacher_name, username, NULL, NULL, 1, NULL FROM teacher"""),
    "append_written": sql("student teacher", """
SELECT student_uid, student_name, username, age, class_uid, status, created FROM student
UNION ALL SELECT teacher_uid + 1000000000, teacher_name, username, NULL, NULL, 1, NULL FROM teacher"""),
    "upsert_explicit": sql("student", """
, incoming AS (SELECT user_id * 11 AS student_uid, 'New ' || event_type AS student_name,
    CAST(event_id % 30 AS INT) AS age, ts, count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
first AS (SELECT * FROM incoming WHERE rn = 1), last AS (SELECT * FROM incoming WHERE rn = n)
SELECT student_uid, coalesce(s.student_name, f.student_name) AS student_name,
  CASE WHEN l.student_uid IS NULL THEN s.age WHEN s.student_uid IS NOT NULL OR l.n > 1 THEN l.age
       ELSE f.age END AS age,
  CASE WHEN l.student_uid IS NULL THEN s.status WHEN s.student_uid IS NOT NULL OR l.n > 1 THEN 2
       ELSE 1 END AS status,
  CASE WHEN l.student_uid IS NULL THEN CAST(s.created AS TIMESTAMP)
       WHEN s.student_uid IS NOT NULL OR l.n > 1 THEN l.ts END AS updated
FROM student s FULL JOIN (SELECT student_uid, l.n, l.age, l.ts FROM last l) l USING (student_uid)
LEFT JOIN first f USING (student_uid)"""),
    "patch_update": sql("student", """
SELECT student_uid, student_name, username, CASE WHEN hit THEN age + 1 ELSE age END AS age,
  CASE WHEN hit THEN 2 ELSE class_uid END AS class_uid, status, created
FROM (SELECT *, class_uid IN (1, 5, 9) AND status = 1 AS hit FROM student) t"""),
    "affected_counts": sql("student", """
SELECT event_id, class_uid, status, affected, affected > 0 AS accepted
FROM (SELECT event_id, user_id % 30 AS class_uid, CAST(event_id % 2 AS INT) AS status,
        (SELECT count(*) FROM student s WHERE s.class_uid = user_id % 30
                                          AND s.status = event_id % 2) AS affected FROM events) t"""),
    "soft_delete": sql("course", """
SELECT course_uid, course_name, teacher_uid, class_uid,
  CASE WHEN d.ts IS NULL THEN status ELSE 0 END AS status, created, d.ts AS updated
FROM course LEFT JOIN (SELECT user_id * 17 AS course_uid, user_id % 10 AS teacher_uid, max(ts) AS ts
  FROM events WHERE event_type = 'error' GROUP BY ALL) d USING (course_uid, teacher_uid)"""),
    "soft_delete_missed": sql("course", """
SELECT user_id * 17 AS course_uid, user_id % 10 AS teacher_uid, max(ts) AS ts, 'no_match' AS reason
FROM events WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM course c
  WHERE c.course_uid = user_id * 17 AND c.teacher_uid = user_id % 10) GROUP BY ALL"""),
    "upsert_scores": sql("score_run", """
, applied AS (SELECT *, row_number() OVER (PARTITION BY course_uid, student_uid
                                           ORDER BY ts DESC, event_id DESC) AS rn,
    first_value(ts) OVER (PARTITION BY course_uid, student_uid ORDER BY ts, event_id) AS first_ts,
    count(*) OVER (PARTITION BY course_uid, student_uid) AS n FROM score_run WHERE known OR born),
last AS (SELECT a.* FROM applied a WHERE rn = 1)
SELECT course_uid, student_uid, coalesce(l.score, s.score) AS score,
  CASE WHEN l.born THEN 1 ELSE s.status END AS status, coalesce(s.created, l.first_ts) AS created,
  CASE WHEN l.known OR l.n > 1 THEN l.ts ELSE s.updated END AS updated,
  coalesce(l.ts, s.applied_ts) AS applied_ts, coalesce(l.event_id, s.applied_id) AS applied_id
FROM score_state s FULL JOIN last l USING (course_uid, student_uid)"""),
    "rejected_scores": sql("score_run", """
SELECT event_id, ts, op, 'no_match' AS reason FROM score_run WHERE NOT known AND NOT born"""),
    "upsert_students": sql("student_verdict", """
, run AS (SELECT * FROM student_verdict WHERE verdict IN ('ok', 'born')),
final AS (SELECT uid, min(ts) FILTER (verdict = 'born') AS born,
    arg_max(student_name, seq) FILTER (student_name IS NOT NULL) AS student_name,
    arg_max(name, seq) FILTER (name IS NOT NULL) AS name,
    arg_max_null(age, seq) FILTER (verdict = 'born' OR op = 'patch' AND age IS NOT NULL) AS age,
    arg_max_null(class_uid, seq)
      FILTER (verdict = 'born' OR op = 'patch' AND class_uid IS NOT NULL) AS class_uid,
    bool_or(op = 'delete') AS gone, max(seq) AS last_seq,
    max(ts) FILTER (verdict <> 'born') AS stamp, arg_max(ts, seq) AS applied_ts,
    arg_max(event_id, seq) AS applied_id FROM run GROUP BY uid)
SELECT coalesce(student_uid, uid) AS student_uid, coalesce(f.student_name, s.student_name) AS student_name,
  coalesce(f.name, s.username) AS username, coalesce(f.age, s.age) AS age,
  coalesce(f.class_uid, s.class_uid) AS class_uid,
  CASE WHEN gone THEN 0 ELSE coalesce(s.status, 1) END AS status, coalesce(s.created, born) AS created,
  coalesce(stamp, s.updated) AS updated, coalesce(f.applied_ts, s.applied_ts) AS applied_ts,
  coalesce(f.applied_id, s.applied_id) AS applied_id
FROM student_state s FULL JOIN final f ON student_uid = uid"""),
    "rejected_students": sql("student_verdict", """
SELECT event_id, ts, op, verdict AS reason FROM student_verdict
WHERE verdict NOT IN ('ok', 'born', 'nothing')"""),
    "upsert_courses": sql("course_run", """
, final AS (SELECT course_uid, teacher_uid, min(ts) FILTER (birth) AS born,
    arg_max(nullif(course_name, ''), seq) FILTER (birth OR op = 'patch' AND course_name <> '')
      AS course_name,
    arg_max(nullif(class_uid, ''), seq) FILTER (birth OR op = 'patch' AND class_uid <> '') AS class_uid,
    arg_max(CASE op WHEN 'create' THEN 1 ELSE 0 END, seq) FILTER (op <> 'patch') AS status,
    max(ts) FILTER (op <> 'create' OR status_before = 0) AS stamp,
    arg_max(ts, seq) AS applied_ts, arg_max(event_id, seq) AS applied_id
  FROM course_run GROUP BY course_uid, teacher_uid)
SELECT course_uid, coalesce(f.course_name, s.course_name) AS course_name, teacher_uid,
  coalesce(f.class_uid, s.class_uid) AS class_uid, coalesce(f.status, s.status) AS status,
  coalesce(s.created, born) AS created, coalesce(stamp, s.updated) AS updated,
  coalesce(f.applied_ts, s.applied_ts) AS applied_ts, coalesce(f.applied_id, s.applied_id) AS applied_id
FROM course_state s FULL JOIN final f USING (course_uid, teacher_uid)"""),
    "rejected_courses": sql("course_event course_state", """
SELECT event_id, ts, op, reason FROM (
  SELECT e.event_id, e.ts, e.op, CASE WHEN no_name THEN 'no_name' WHEN e.op = 'create' THEN NULL
      WHEN s.course_uid IS NULL THEN 'no_match'
      WHEN (e.ts < s.applied_ts OR e.ts = s.applied_ts AND e.event_id <= s.applied_id) THEN 'late' END AS reason
  FROM course_event e LEFT JOIN course_state s
    ON e.course_uid = s.course_uid AND e.teacher_uid = s.teacher_uid) t WHERE reason IS NOT NULL"""),
    "upsert_classes": sql("class_run", """
, final AS (SELECT target, min(ts) FILTER (verdict = 'born') AS born,
    arg_max(name, seq) FILTER (op = 'rename' OR verdict = 'born') AS name,
    arg_max(CASE op WHEN 'create' THEN 1 ELSE 0 END, seq) FILTER (op <> 'rename') AS status,
    max(ts) FILTER (op = 'delete' OR outcome = 'moved') AS stamp,
    arg_max(ts, seq) AS applied_ts, arg_max(event_id, seq) AS applied_id FROM class_run GROUP BY target)
SELECT coalesce(class_uid, target) AS class_uid, coalesce(name, class_name) AS class_name,
  coalesce(f.status, s.status, 1) AS status, coalesce(created, born) AS created,
  coalesce(stamp, updated) AS updated, coalesce(f.applied_ts, s.applied_ts) AS applied_ts,
  coalesce(f.applied_id, s.applied_id) AS applied_id
FROM class_state s FULL JOIN final f ON class_uid = target"""),
    "rejected_classes": sql("class_verdict", """
SELECT event_id, ts, op, verdict AS reason FROM class_verdict
WHERE verdict NOT IN ('ok', 'born', 'nothing')"""),
    "rename_conflicts": sql("class_event class_state", """
, asked AS (SELECT row_number() OVER (ORDER BY seq) AS n, * FROM class_event WHERE op = 'rename'),
played AS (
  WITH RECURSIVE step AS (
    SELECT CAST(0 AS BIGINT) AS n, '' AS verdict, (SELECT list({'uid': class_uid, 'name': class_name}) FROM class_state) AS rows
    UNION ALL
    SELECT n, verdict, CASE WHEN verdict = 'ok'
      THEN list_append(list_filter(rows, lambda x: x.uid <> uid), {'uid': uid, 'name': name}) ELSE rows END
    FROM (SELECT a.n, a.uid, a.name, s.rows, CASE
            WHEN a.name IS NULL OR len(list_filter(s.rows, lambda x: x.uid = a.uid AND x.name = a.name)) > 0 THEN 'noop'
            WHEN len(list_filter(s.rows, lambda x: x.name = a.name)) > 0 THEN 'taken'
            WHEN NOT a.known THEN 'no_match' ELSE 'ok' END AS verdict
          FROM step s JOIN asked a ON a.n = s.n + 1) t)
  SELECT n, verdict FROM step)
SELECT event_id, ts, uid AS class_uid, coalesce(name, '') AS class_name, verdict FROM asked JOIN played USING (n)"""),
    # --- jobs ---
    "validate_requests": sql("numbered_event", """
, request AS (SELECT event_id, event_id % 8 AS c, CAST(k AS VARCHAR) AS k, event_type,
    event_type IN ('signup', 'purchase', 'click') AS fits FROM numbered_event)
SELECT event_id,
  CASE WHEN c IN (0, 1, 2, 4, 7) THEN CAST(k AS BIGINT) END AS k,
  CASE WHEN c < 5 THEN event_type WHEN c = 7 THEN '5' END AS kind,
  concat_ws('; ', CASE WHEN c = 6 THEN 'malformed' END, CASE WHEN c = 5 THEN 'k: required' END,
    CASE WHEN c = 3 THEN 'k: not an integer' END, CASE WHEN c = 5 THEN 'kind: required' END,
    CASE WHEN c = 7 THEN 'kind: wrong type' END,
    CASE WHEN c = 7 OR c < 5 AND NOT fits THEN 'kind: value not allowed' END,
    CASE WHEN c = 4 THEN 'zz: unknown' END) AS reasons
FROM request"""),
    "change_requests": sql("student_feed", """
SELECT event_id, ts, op, student_uid, student_name, username, age,
       CASE WHEN event_id % 19 > 0 THEN class_uid END AS class_uid FROM student_feed
WHERE op IN ('create', 'patch', 'delete') AND event_id % 17 > 0 AND event_id % 13 > 0
  AND event_id % 10 > 0"""),
    "rejected_requests": sql("student_feed", """
SELECT event_id, ts, CASE WHEN op <> 'view' THEN op END AS op, concat_ws('; ',
    CASE WHEN event_id % 13 = 0 THEN 'malformed' END, CASE WHEN event_id % 10 = 0 THEN 'forbidden' END,
    CASE WHEN op = 'view' THEN 'unknown method' END,
    CASE WHEN event_id % 17 = 0 AND event_id % 13 > 0 THEN 'age: not a number' END) AS reasons
FROM student_feed WHERE op = 'view' OR event_id % 17 = 0 OR event_id % 13 = 0 OR event_id % 10 = 0"""),
    "render_rows": sql("student", """
SELECT student_uid, coalesce(CAST(age AS VARCHAR), '') AS age, strftime(created, '%Y-%m-%d') AS created,
  CASE WHEN status = 1 THEN username ELSE '' END AS username,
  CAST(trunc(CAST(student_uid / 7 - 50 AS DECIMAL(12, 3))) AS BIGINT) AS balance,
  CAST(CAST(trunc(CAST(student_uid / -3 AS DECIMAL(12, 2))) AS BIGINT) AS VARCHAR) AS credit,
  strftime(created, '%Y-%m-%d') AS since,
  coalesce(CAST(age AS VARCHAR), '') || ',' || CAST(status AS VARCHAR) AS marks
FROM student"""),
    "token_audit": sql("", """
WITH made AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'student' ELSE 'teacher' END AS identity,
    CAST(user_id AS VARCHAR) AS user_uid, 1704067200 + event_id * 100 AS expiry FROM events),
signed AS (SELECT *, concat_ws(':', identity, user_uid, CAST(expiry AS VARCHAR)) AS head,
    md5(concat_ws(':', identity, user_uid, CAST(expiry AS VARCHAR), 'salt')) AS digest FROM made)
SELECT event_id,
  CASE WHEN event_id % 7 = 0 THEN 'student:' || user_uid WHEN event_id % 5 = 0 THEN head || ':bad'
       ELSE head || ':' || digest END AS token,
  CASE WHEN event_id % 7 > 0 THEN identity END AS identity,
  CASE WHEN event_id % 7 > 0 THEN user_uid END AS user_uid,
  CASE WHEN event_id % 7 > 0 THEN expiry END AS expiry,
  CASE WHEN event_id % 7 = 0 THEN 'malformed' WHEN expiry > 1704567200 THEN 'ok'
       ELSE 'expired' END AS verdict,
  event_id % 7 > 0 AND event_id % 5 > 0 AS digest_ok
FROM signed"""),
    "sign_params": sql("numbered_event", """
SELECT event_id, md5('1704067200' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || md5(
    ',USER=' || CAST(user_id AS VARCHAR)
    || CASE WHEN event_id % 3 > 0 THEN ',NUMBER=' || CAST(k AS VARCHAR) ELSE '' END
    || ',KIND=' || upper(event_type) || CASE WHEN event_id % 4 > 0 THEN ',ZONE=NORTH' ELSE '' END)
  || 'internal') AS signature
FROM numbered_event"""),
    "expiry_strings": sql("", """
SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS now_str,
  strftime(ts + to_seconds(event_id % 5000 * 60), '%Y%m%d%H%M%S') AS expire_str FROM events"""),
    "request_log": sql("", """
WITH made AS (SELECT *, '[7305][' || CASE WHEN event_type = 'error' THEN '-100' ELSE ' 200' END || ']:['
    || CASE WHEN event_id % 2 = 0 THEN ' GET' ELSE 'DELETE' END || ']:[/' || event_type || ']::[uid:'
    || CAST(user_id AS VARCHAR) || ']:[' || CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR)
    || 'ms]:[1]:[success]--[uid=' || CAST(user_id AS VARCHAR) || ']' AS whole,
    event_id % 11 > 0 AS parsed FROM events)
SELECT event_id, CASE WHEN parsed THEN whole ELSE substr(whole, 1, 20) END AS line, parsed,
  CASE WHEN parsed THEN 7305 END AS port,
  CASE WHEN NOT parsed THEN NULL WHEN event_type = 'error' THEN -100 ELSE 200 END AS http_code,
  CASE WHEN NOT parsed THEN NULL WHEN event_id % 2 = 0 THEN 'GET' ELSE 'DELETE' END AS method,
  CASE WHEN parsed THEN '/' || event_type END AS path,
  CASE WHEN parsed THEN CAST(user_id AS VARCHAR) END AS uid,
  CASE WHEN parsed THEN CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) END AS ms,
  CASE WHEN parsed THEN 1 END AS code, CASE WHEN parsed THEN 'success' END AS msg,
  CASE WHEN parsed THEN 'uid=' || CAST(user_id AS VARCHAR) END AS args
FROM made"""),
    "time_buckets": sql("", """
SELECT way, bucket, count(*) AS rows FROM (
  SELECT 'month' AS way, strftime(ts, '%Y%m') AS bucket FROM events
  UNION ALL SELECT 'day', strftime(ts, '%Y%m%d') FROM events
  UNION ALL SELECT 'hour', strftime(ts, '%Y%m%d%H') FROM events) t GROUP BY way, bucket"""),
}

# The stream ends at the same table as one batch over the whole feed.
ORACLE["change_stream"] = ORACLE["upsert_scores"]

# Counts kept up to date are those of a recount.
ORACLE["log_stream"] = f"""
WITH log AS (SELECT * FROM ({ORACLE['request_log']}) t),
told AS (
  SELECT log.line, coalesce(http_code = -100, FALSE) AS error, CASE WHEN event_id % 997 <> 0 THEN ts END AS ts,
    least(3, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END
             + CASE WHEN event_id % 25 = 0 THEN 1 ELSE 0 END) AS part
  FROM log JOIN events USING (event_id)),
mark AS (SELECT max(ts) FILTER (WHERE part = 1) - INTERVAL 36 HOUR AS one, max(ts) FILTER (WHERE part < 3) - INTERVAL 36 HOUR AS two,
                max(ts) - INTERVAL 36 HOUR AS three FROM told),
judged AS (
  SELECT line, error, ts, CASE WHEN ts IS NULL THEN 'no_ts'
      WHEN date_trunc('day', ts) + INTERVAL 1 DAY <= CASE part WHEN 2 THEN one WHEN 3 THEN two END THEN 'late'
      WHEN date_trunc('day', ts) + INTERVAL 1 DAY <= three THEN 'closed' END AS verdict
  FROM told, mark)
SELECT verdict, strftime(ts, '%Y%m%d') AS bucket, count(*) AS lines, count(*) FILTER (WHERE error) AS errors, CAST(sum(length(line)) AS BIGINT) AS signs
FROM judged WHERE verdict IS NOT NULL GROUP BY 1, 2"""
ORACLE["live_counts"] = f"SELECT course_uid, count(*) AS total FROM ({ORACLE['upsert_scores']}) t WHERE status = 1 GROUP BY course_uid"
