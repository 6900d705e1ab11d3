"""Queries of the general problems and their SQL."""

from __future__ import annotations

from ridgevec.operators import changefeed, orphans, skew

QUERIES = {
    "p2_found": skew.p2_found,
    "p2_lists": skew.p2_lists,
    "p4_found": orphans.p4_found,
    "p4_report": orphans.p4_report,
    "p5_found": changefeed.p5_found,
    "p5_batches": changefeed.p5_batches,
}

_CUR = """cur AS (
  SELECT list_id FROM (
    SELECT list_id, row_number() OVER (PARTITION BY internal_id ORDER BY assigned_at DESC NULLS LAST, list_id DESC NULLS LAST) AS rn
    FROM assignments WHERE internal_id IS NOT NULL) WHERE rn = 1 AND list_id IS NOT NULL AND list_id <> -1),
sizes AS (SELECT list_id, count(*) AS n FROM cur GROUP BY list_id)"""

_ORPHANS = """st AS (
  SELECT lower(trim(snapshot_id)) AS sid, arg_max(lower(trim(status)), recorded_at) AS status, min(recorded_at) AS first_at
  FROM snapshots WHERE trim(snapshot_id) <> '' GROUP BY 1),
refs AS (
  SELECT 'vector_chunks' AS ref_table, lower(trim(snapshot_id)) AS sid, chunk_index, written_at FROM vector_chunks WHERE trim(snapshot_id) <> ''
  UNION ALL
  SELECT 'id_maps', lower(trim(snapshot_id)), -1, written_at FROM id_maps WHERE trim(snapshot_id) <> ''),
orph AS (
  SELECT DISTINCT ref_table, strftime(written_at, '%Y-%m') AS period, refs.sid AS snapshot_id, chunk_index,
    CASE WHEN st.sid IS NULL THEN 'missing' WHEN status = 'deleted' THEN 'deleted' WHEN status = 'writing' THEN 'unfinished'
         WHEN first_at > written_at THEN 'late' END AS reason
  FROM refs LEFT JOIN st ON refs.sid = st.sid)"""

SQL = {
    "p2_found": f"WITH {_CUR} SELECT list_id FROM sizes WHERE n * 100 >= 4 * (SELECT sum(n) FROM sizes)",
    "p2_lists": f"""WITH {_CUR}, s AS (SELECT sum(n)::BIGINT AS v, count(*) AS u, max(n) AS m, sum(n * n)::DOUBLE AS sq FROM sizes)
SELECT v AS vectors, u AS lists_used, m AS largest, round(m / (v / 128.0::DOUBLE), 6) AS list_imbalance,
  round(sqrt(greatest(0.0::DOUBLE, sq / 128.0::DOUBLE - (v / 128.0::DOUBLE) * (v / 128.0::DOUBLE))), 6) AS list_std FROM s""",
    "p4_found": f"WITH {_ORPHANS} SELECT * FROM orph WHERE reason IS NOT NULL",
    "p4_report": f"""WITH {_ORPHANS} SELECT ref_table, period, reason, count(*) AS orphans, count(DISTINCT snapshot_id) AS snapshots
FROM orph WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
    "p5_found": """WITH st AS (
  SELECT lower(trim(snapshot_id)) AS sid, arg_max(lower(trim(status)), recorded_at) AS status FROM snapshots GROUP BY 1),
base AS (
  SELECT db_name, sid, snapshot_seq FROM (
    SELECT db_name, lower(trim(snapshot_id)) AS sid, snapshot_seq,
      row_number() OVER (PARTITION BY db_name ORDER BY created_at DESC, snapshot_seq DESC, lower(trim(snapshot_id)) DESC) AS rn
    FROM snapshots WHERE lower(trim(snapshot_id)) IN (SELECT sid FROM st WHERE status = 'complete')) WHERE rn = 1),
upto AS (SELECT db_name, arg_max(last_seq, updated_at) AS upto FROM meta_states GROUP BY 1),
img AS (
  SELECT db_name, unnest(int_to_ext) AS id, snapshot_seq AS seq, 'upsert' AS op FROM id_maps JOIN base ON lower(trim(snapshot_id)) = sid
  UNION ALL
  SELECT j.db_name, j.id, j.seq, lower(trim(j.op)) FROM journal j JOIN upto u ON j.db_name = u.db_name LEFT JOIN base b ON j.db_name = b.db_name
  WHERE j.id <> '' AND lower(trim(j.op)) IN ('upsert', 'delete') AND j.seq <= u.upto AND (b.snapshot_seq IS NULL OR j.seq > b.snapshot_seq)),
fold AS (SELECT db_name, id, arg_max(op, seq) AS op, max(seq) AS seq FROM img WHERE id IS NOT NULL GROUP BY 1, 2)
SELECT db_name, id, seq::INT AS last_seq FROM fold WHERE op = 'upsert'""",
}
SQL["p5_batches"] = SQL["p5_found"]
