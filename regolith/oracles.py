"""SQL of the registered queries, for an independent engine."""

from __future__ import annotations

import re

BASE = """
WITH ubids AS (
  SELECT c_custkey AS ubid, CASE WHEN c_custkey % 5 <> 0 THEN 'ABCPK' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F' END AS pan,
    CASE WHEN c_custkey % 3 = 0 THEN '29ABCPK' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F1Z5' END AS gstin,
    c_custkey % 50 <> 49 AS is_canonical, CAST(DATE '2023-01-01' + CAST(c_custkey % 365 AS INTEGER) AS DATE) AS created_on, CAST(DATE '2023-01-01' + CAST(c_custkey % 365 + c_custkey % 90 AS INTEGER) AS DATE) AS updated_on FROM customer
), raw_records AS (
  SELECT o_orderkey AS raw_id, o_custkey AS owner, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'tax' WHEN '2' THEN 'municipal' WHEN '3' THEN 'labor' WHEN '4' THEN 'pollution' WHEN '5' THEN 'water' ELSE 'other' END AS source_system,
    o_orderdate AS extracted_at, CASE WHEN o_orderkey % 40 <> 7 THEN 'Customer ' || CAST(o_custkey AS VARCHAR) END AS payload_name, CASE WHEN o_orderkey % 6 <> 1 THEN 'Plot ' || CAST(o_orderkey % 90 AS VARCHAR) || ', MG Road, ' || CAST(o_orderkey % 25 + 560000 AS VARCHAR) END AS payload_address,
    upper(substr(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'tax' WHEN '2' THEN 'municipal' WHEN '3' THEN 'labor' WHEN '4' THEN 'pollution' WHEN '5' THEN 'water' ELSE 'other' END, 1, 3)) || '-' || CAST(o_orderkey AS VARCHAR) AS source_record_id FROM orders
), normalized AS (
  SELECT raw_id, lower(c_name) AS normalized_name, CAST(c_nationkey + 560000 AS VARCHAR) AS pincode, c_mktsegment AS sector FROM raw_records JOIN customer ON owner = c_custkey
), links AS (
  SELECT o_orderkey AS raw_id, o_custkey AS ubid, CAST(0.5 AS DOUBLE) + CAST(o_orderkey % 50 AS DOUBLE) / 100.0 AS confidence, CASE WHEN o_orderkey % 20 = 0 THEN o_orderdate END AS unlinked_at, o_orderdate AS linked_at, CASE WHEN o_orderkey % 3 = 0 THEN 'auto_link' ELSE 'reviewer_approved' END AS decision_type FROM orders
), ev AS (
  SELECT event_id, user_id AS ubid, CASE event_type WHEN 'view' THEN 'inspection' WHEN 'purchase' THEN 'renewal' WHEN 'click' THEN 'utility_reading' WHEN 'signup' THEN 'compliance_filing' WHEN 'error' THEN 'closure_declaration' END AS event_type,
    CAST(ts AS DATE) AS event_date, json_extract_string(props, '$.k') AS outcome, ts AS ingested_at FROM events
), taxonomy(event_type, weight, half_life) AS (
  VALUES ('inspection', CAST(0.4 AS DOUBLE), 30), ('renewal', CAST(0.5 AS DOUBLE), 60), ('utility_reading', CAST(0.1 AS DOUBLE), 15), ('closure_declaration', CAST(-0.9 AS DOUBLE), 90)
), sums AS (
  SELECT ubid, sum(weight * exp(-ln(CAST(2 AS DOUBLE)) * greatest(0, date_diff('day', event_date, DATE '2024-01-31')) / half_life)) AS s, count(*) AS n_events FROM ev JOIN taxonomy USING (event_type) GROUP BY ubid
), activity AS (
  SELECT ubids.ubid, round(coalesce(s, 0), 4) AS score, CASE WHEN coalesce(s, 0) >= 1.5 THEN 'Active' WHEN coalesce(s, 0) >= 0 THEN 'Dormant' ELSE 'Closed' END AS status, CAST(coalesce(n_events, 0) AS BIGINT) AS n_events FROM ubids LEFT JOIN sums USING (ubid)
), registry AS (
  SELECT u.ubid, coalesce(min(r.payload_name), min(n.normalized_name), 'Unknown Business') AS business_name,
    coalesce(min(CASE WHEN n.sector IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') THEN n.sector END), min(n.sector), 'Unknown') AS sector, min(n.pincode) AS pin_code, min(u.pan) AS pan, min(u.gstin) AS gstin,
    coalesce(min(a.status), 'Unknown') AS status, min(a.score) AS activity_score, max(l.confidence) AS confidence_score, count(DISTINCT r.raw_id) AS record_count, count(DISTINCT r.source_system) AS source_count, min(u.created_on) AS created_on, min(u.updated_on) AS updated_on
  FROM ubids u LEFT JOIN activity a ON a.ubid = u.ubid LEFT JOIN links l ON l.ubid = u.ubid AND l.unlinked_at IS NULL LEFT JOIN raw_records r ON r.raw_id = l.raw_id LEFT JOIN normalized n ON n.raw_id = r.raw_id
  WHERE u.is_canonical GROUP BY u.ubid
), source_records AS (
  SELECT r.raw_id, r.source_system, coalesce(r.payload_name, n.normalized_name) AS raw_name, n.pincode, n.sector, l.ubid, l.confidence, r.extracted_at
  FROM raw_records r LEFT JOIN normalized n USING (raw_id) LEFT JOIN links l ON l.raw_id = r.raw_id AND l.unlinked_at IS NULL
), rp AS (
  SELECT p_partkey AS record, p_brand, p_name AS name, p_brand || ' ' || p_type AS address, CASE WHEN p_partkey % 3 <> 0 THEN 'ABCPK00' || lpad(CAST(p_partkey % (CASE WHEN p_partkey % 4 = 0 THEN 70 ELSE 25 END) AS VARCHAR), 2, '0') || 'F' END AS pan,
    CASE WHEN p_partkey % 6 < 3 THEN 'G' || lpad(CAST(p_partkey % 25 AS VARCHAR), 2, '0') END AS gstin, '5600' || lpad(CAST(p_partkey % (CASE WHEN p_partkey % 8 = 0 THEN 40 ELSE 5 END) AS VARCHAR), 2, '0') AS pincode, p_type AS sector FROM part
), rq AS (
  SELECT a.record AS id, a.record AS record_a, b.record AS record_b, CAST(0.5 AS DOUBLE) + CAST(a.record % 50 AS DOUBLE) / 100.0 AS confidence, CAST(a.record % 50 + 50 AS INTEGER) AS priority,
    CASE WHEN a.record % 5 = 0 THEN 'resolved' WHEN a.record % 7 = 0 THEN 'locked' ELSE 'pending' END AS status, CAST(DATE '2024-01-01' + CAST(a.record % 30 AS INTEGER) AS DATE) AS queued_at
  FROM rp a JOIN rp b ON b.record = a.record + 25 AND b.p_brand = a.p_brand
), act AS (
  SELECT id, CASE id % 3 WHEN 0 THEN 'confirm_match' WHEN 1 THEN 'confirm_non_match' ELSE 'defer' END AS decision FROM rq WHERE id % 5 = 0
), rl AS (
  SELECT record, 'U' || CAST(record % 100 AS VARCHAR) AS entity, DATE '2024-01-01' + CAST(record % 30 AS INTEGER) AS linked_at FROM rp WHERE record % 4 = 0
), ids AS (
  SELECT o_orderkey AS raw_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'ABCPK' || lpad(CAST((o_custkey + 1) % 10000 AS VARCHAR), 4, '0') || 'F' ELSE 'ABCPK' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || 'F' END AS pan,
    CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN '29ABCPK' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || 'F1Z5' END AS gstin,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(12.9 AS DOUBLE) + CAST(o_orderkey % 10 AS DOUBLE) / 100 END AS latitude, CASE WHEN o_orderkey % 3 = 0 THEN CAST(77.5 AS DOUBLE) + CAST(o_orderkey % 7 AS DOUBLE) / 100 END AS longitude FROM orders
), wide AS (
  SELECT r.raw_id, r.source_system, r.source_record_id, r.payload_name AS raw_name, r.payload_address AS raw_address, r.extracted_at, n.normalized_name, n.pincode, n.sector, i.pan, i.gstin, i.latitude, i.longitude, l.ubid, l.confidence, l.decision_type, l.linked_at
  FROM raw_records r LEFT JOIN normalized n USING (raw_id) LEFT JOIN ids i USING (raw_id) LEFT JOIN links l ON l.raw_id = r.raw_id AND l.unlinked_at IS NULL
), pairs AS (
  SELECT *, CASE WHEN reviewer_decision IS NOT NULL THEN 'resolved' WHEN a % 70 = 0 THEN 'locked' ELSE 'pending' END AS review_status, CASE WHEN a % 40 = 0 THEN 'separate' ELSE 'review_queue' END AS decision_type
  FROM (SELECT x.o_orderkey AS pair_id, x.o_orderkey AS a, x.o_orderkey + 5 AS b, CASE WHEN x.o_orderkey % 20 = 0 THEN 'pan_exact' ELSE 'phonetic' END AS strategy, CAST(0.5 AS DOUBLE) + CAST(x.o_orderkey % 50 AS DOUBLE) / 100.0 AS score,
    CASE x.o_orderkey % 30 WHEN 0 THEN 'confirm_match' WHEN 10 THEN 'confirm_non_match' END AS reviewer_decision FROM orders x JOIN orders y ON y.o_orderkey = x.o_orderkey + 5 WHERE x.o_orderkey % 10 = 0)
), overrides AS (
  SELECT c_custkey AS ubid, CASE WHEN c_custkey % 2 = 0 THEN 'Active' ELSE 'Closed' END AS override FROM customer WHERE c_custkey % 29 = 5
), base AS (
  SELECT u.ubid, u.pan AS anchor_pan, u.gstin AS anchor_gstin, coalesce(o.override, a.status) AS status, a.score, o.override FROM ubids u JOIN activity a ON a.ubid = u.ubid LEFT JOIN overrides o ON o.ubid = u.ubid
), audits AS (
  SELECT o_orderkey AS id, o_custkey AS ubid, CASE WHEN o_orderkey % 2 = 0 THEN 'record_linked' ELSE 'decision_made' END AS action, 'system' AS actor, 'ubid' AS entity_type, CAST(o_orderdate AS DATE) AS created_at FROM orders WHERE o_orderkey % 3 = 0
)
"""
LIST = "ubid, business_name, sector, pin_code, status, confidence_score, pan, gstin"

SQL = {
    "v_registry": "SELECT * FROM registry",
    "v_source_records": "SELECT * FROM source_records",
    "v_activity_events": "SELECT ev.event_id, ev.ubid, ev.event_type, ev.event_date, ev.outcome, ubids.ubid IS NOT NULL AS is_known, ev.ingested_at FROM ev LEFT JOIN ubids ON ubids.ubid = ev.ubid",
    "d14_activity": "SELECT ubid, score, status, n_events FROM activity",
    "q1_pan": f"SELECT {LIST} FROM registry WHERE pan = 'ABCPK0042F' ORDER BY business_name, ubid LIMIT 50",
    "q2_gstin": f"SELECT {LIST} FROM registry WHERE gstin = '29ABCPK0042F1Z5' ORDER BY business_name, ubid LIMIT 50",
    "q3_stale_inspections": "SELECT r.ubid, business_name, sector, pin_code, status, max(event_date) AS last_inspection FROM registry r LEFT JOIN ev ON ev.ubid = r.ubid AND event_type = 'inspection' WHERE sector IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') AND status IN ('Active', 'Dormant') GROUP BY ALL HAVING max(event_date) IS NULL OR max(event_date) < DATE '2024-01-25'",
    "q4_pan_without_gstin": "SELECT ubid, business_name, pan, pin_code FROM registry WHERE pan IS NOT NULL AND pan <> '' AND (gstin IS NULL OR gstin = '')",
    "q6_status_by_pin": "SELECT pin_code, count(*) AS businesses, round(avg(confidence_score), 3) AS avg_confidence FROM registry WHERE status IN ('Active') GROUP BY pin_code",
    "q7_status_by_sector": "SELECT sector, count(*) AS businesses, round(avg(confidence_score), 3) AS avg_confidence FROM registry WHERE status IN ('Closed', 'Dormant') GROUP BY sector",
    "q8_sector_status": "SELECT sector, status, count(*) AS businesses, round(avg(confidence_score), 3) AS avg_confidence FROM registry GROUP BY sector, status",
    "q9_departments": 'SELECT source_system, count(*) AS records, count(DISTINCT ubid) AS businesses, count(ubid) AS linked, round(avg(confidence), 3) AS avg_confidence FROM source_records GROUP BY source_system',
    "q10_list": f"SELECT {LIST} FROM registry WHERE status IN ('Active') ORDER BY confidence_score DESC NULLS LAST, ubid LIMIT 25",
    "r1_metrics": "SELECT *, round((1 - ubids / greatest(records, 1)) * 100, 1) AS dedupe_rate, round(least(100, active / greatest(ubids, 1) * 100), 1) AS active_percent, round(least(100, dormant / greatest(ubids, 1) * 100), 1) AS dormant_percent, round(least(100, closed / greatest(ubids, 1) * 100), 1) AS closed_percent FROM (SELECT count(*) AS ubids, count_if(status = 'Active') AS active, count_if(status = 'Dormant') AS dormant, count_if(status = 'Closed') AS closed, count(pan) AS with_pan, count(gstin) AS with_gstin, count_if(sector IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE')) AS industrial FROM registry), (SELECT count(*) AS records, count_if(unlinked_at IS NULL) AS linked FROM links), (SELECT count_if(status IN ('pending', 'locked')) AS pending_review FROM rq), (SELECT count(*) AS pending_events FROM ev WHERE ubid NOT IN (SELECT ubid FROM ubids))",
    "r1_bands": "SELECT CASE WHEN confidence >= CAST(0.95 AS DOUBLE) THEN 'Auto-link ready' WHEN confidence >= CAST(0.75 AS DOUBLE) THEN 'Human review band' ELSE 'Keep separate' END AS band, count(*) AS links FROM links WHERE unlinked_at IS NULL GROUP BY 1",
    "r1_coverage": "SELECT source_system, count(*) AS records, count(ubid) AS linked, round(avg(confidence), 3) AS avg_confidence FROM source_records GROUP BY 1",
    "r1_hotspots": "SELECT pin_code, count(*) AS businesses, count_if(status = 'Active') AS active, count_if(status = 'Dormant') AS dormant, count_if(status = 'Closed') AS closed FROM registry GROUP BY pin_code ORDER BY businesses DESC, pin_code NULLS FIRST LIMIT 8",
    "r3_page": "SELECT * FROM source_records WHERE source_system = 'tax' AND ubid IS NOT NULL AND raw_name ILIKE '%customer 1%' ORDER BY extracted_at DESC, raw_id LIMIT 25 OFFSET 25",
    "r3_facets": "SELECT facet, value, records FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY records DESC, value) AS place FROM (SELECT facet, value, count(*) AS records FROM (SELECT unnest([{'facet': 'source', 'value': source_system}, {'facet': 'sector', 'value': coalesce(sector, 'Unknown')}, {'facet': 'pincode', 'value': coalesce(pincode, 'Unknown')}, {'facet': 'status', 'value': coalesce(status, 'Unlinked')}], recursive := true) FROM source_records s LEFT JOIN activity a ON a.ubid = s.ubid) GROUP BY facet, value)) WHERE facet <> 'pincode' OR place <= 25",
    "r9_unlinked": "SELECT * FROM (WITH lost AS (SELECT i.raw_id, i.pan FROM ids i LEFT JOIN (SELECT raw_id FROM links WHERE unlinked_at IS NULL) l ON l.raw_id = i.raw_id WHERE l.raw_id IS NULL) SELECT total, single_pan, no_pan, separated, greatest(0, total - single_pan - no_pan - separated) AS other FROM (SELECT (SELECT count(*) FROM lost) AS total, (SELECT count(*) FROM (SELECT pan FROM lost WHERE pan IS NOT NULL AND pan <> '' GROUP BY pan HAVING count(*) = 1)) AS single_pan, (SELECT count(*) FROM lost WHERE pan IS NULL OR pan = '') AS no_pan, (SELECT count(DISTINCT lost.raw_id) FROM lost JOIN pairs ON pairs.a = lost.raw_id OR pairs.b = lost.raw_id WHERE pairs.decision_type = 'separate') AS separated))",
}

#: Queries that stand alone.
PLAIN = {
    "f_pseudonym": "SELECT c_custkey, 'BIZ-' || substr(sha256(lower(trim(c_name))), 1, 8) AS biz FROM customer",
    "f_ubid_code": """SELECT k AS c_custkey, 'UBID-KA-29-2024-' || six || '-' || CAST((10 - list_sum([CASE WHEN (12 - i) % 2 = 1 THEN (CASE WHEN CAST(b[i] AS INT) > 4 THEN CAST(b[i] AS INT) * 2 - 9 ELSE CAST(b[i] AS INT) * 2 END) ELSE CAST(b[i] AS INT) END FOR i IN range(1, 13)]) % 10) % 10 AS VARCHAR) AS code
      FROM (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS six, '292024' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS b FROM customer)""",
    "s_jaccard": """SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) AS jaccard, CAST(2 * len(list_intersect(x, y)) AS DOUBLE) / (len(x) + len(y)) AS dice
      FROM (SELECT p_partkey, p_brand, list_distinct(list_filter(string_split_regex(lower(p_name), '\\s+'), lambda w: w <> '')) AS x FROM part) a JOIN (SELECT p_partkey, p_brand, list_distinct(list_filter(string_split_regex(lower(p_name), '\\s+'), lambda w: w <> '')) AS y FROM part) b ON a.p_brand = b.p_brand AND b.p_partkey = a.p_partkey + 25""",
}


#: Evidence of a pair: words first, then what they and the identifiers say.
EVIDENCE = """
, w AS (
  SELECT rq.id, rq.confidence, a.pan AS pan_a, b.pan AS pan_b, a.gstin AS gstin_a, b.gstin AS gstin_b, coalesce(a.pan = b.pan, false) AS same_pan, coalesce(a.gstin = b.gstin, false) AS same_gstin, a.pincode = b.pincode AS same_pincode, a.sector = b.sector AS same_sector,
    {na} AS na, {nb} AS nb, {aa} AS aa, {ab} AS ab FROM rq JOIN rp a ON a.record = record_a JOIN rp b ON b.record = record_b WHERE status IN ('pending', 'locked')
), o AS (
  SELECT *, CAST(round_even(CAST(len(list_intersect(na, nb)) AS DOUBLE) / len(list_distinct(list_concat(na, nb))) * 100, 0) AS INTEGER) AS name_overlap, CAST(round_even(CAST(len(list_intersect(aa, ab)) AS DOUBLE) / len(list_distinct(list_concat(aa, ab))) * 100, 0) AS INTEGER) AS address_overlap,
    pan_a IS NOT NULL AND pan_b IS NOT NULL AS pans, gstin_a IS NOT NULL AND gstin_b IS NOT NULL AS gstins FROM w
), f AS (
  SELECT *, same_pan AND same_pincode AND name_overlap >= 70 AS strong, concat_ws(', ', CASE WHEN same_pan THEN 'same PAN' END, CASE WHEN same_pincode THEN 'same PIN code' END, CASE WHEN same_sector THEN 'same business type' END, CASE WHEN name_overlap >= 80 THEN 'very similar business name' WHEN name_overlap >= 50 THEN 'partly similar business name' END) AS pro,
    concat_ws(', ', CASE WHEN address_overlap < 40 THEN 'addresses do not fully match' END, CASE WHEN NOT gstins THEN 'GSTIN is missing' END) AS con FROM o
)
SELECT id, name_overlap, address_overlap, array_to_string(list_sort(list_intersect(na, nb)), ' ') AS shared_tokens, same_pan, same_gstin, same_pincode, same_sector,
  CASE WHEN strong THEN 'Likely same, verify' WHEN confidence >= CAST(0.85 AS DOUBLE) THEN 'Good match' WHEN confidence >= CAST(0.70 AS DOUBLE) THEN 'Needs officer check' WHEN confidence >= CAST(0.55 AS DOUBLE) THEN 'Needs more proof' ELSE 'Likely separate' END AS band,
  concat_ws(' ', CASE WHEN same_pan THEN 'Same PAN is present in both records.' END, CASE WHEN same_gstin THEN 'Same GSTIN is present in both records.' END, CASE WHEN name_overlap >= 70 THEN 'Business names look very similar.' END, CASE WHEN same_pincode THEN 'PIN code matches.' END, CASE WHEN same_sector THEN 'Business type matches.' END) AS signals,
  concat_ws(' ', CASE WHEN same_pan THEN NULL WHEN pans THEN 'PAN values are different. Keep separate unless a senior officer approves.' ELSE 'PAN is missing on at least one record.' END, CASE WHEN same_gstin THEN NULL WHEN gstins THEN 'GSTIN values differ.' ELSE 'GSTIN is missing, so verify using other documents.' END,
    CASE WHEN name_overlap < 70 THEN 'Business names are not very similar.' END, CASE WHEN address_overlap < 40 THEN 'Addresses are not a strong match.' END, CASE WHEN NOT same_pincode THEN 'PIN code does not match or is missing.' END, CASE WHEN NOT same_sector THEN 'Business type differs or is unavailable.' END) AS cautions,
  CASE WHEN strong THEN 'approve' ELSE 'separate' END AS recommendation,
  'These records show ' || CASE WHEN pro = '' THEN 'limited matching information' ELSE pro END || '. Please note: ' || CASE WHEN con = '' THEN 'no major warning sign is visible' ELSE con END || '. Recommended action: ' || CASE WHEN strong AND confidence >= CAST(0.6 AS DOUBLE) THEN 'approve if documents look genuine' ELSE 'keep separate unless more proof is available' END || '.' AS summary
FROM f
"""
WORDS = "list_distinct(list_filter(string_split_regex(upper({}), '[^A-Z0-9]+'), lambda t: t <> ''))"
LINKS = """
, m AS (SELECT * FROM rq JOIN act USING (id) WHERE decision = 'confirm_match'), g AS (SELECT record_a AS record, record_a AS grp, confidence FROM m UNION ALL SELECT record_b, record_a, confidence FROM m
), e AS (SELECT grp, coalesce(arg_min(entity, linked_at + to_days(0) + to_milliseconds(CAST(g.record AS BIGINT))), 'new:' || CAST(grp AS VARCHAR)) AS entity FROM g LEFT JOIN rl USING (record) GROUP BY grp
), n AS (SELECT DISTINCT unnest([record_a, record_b]) AS record FROM rq JOIN act USING (id) WHERE decision = 'confirm_non_match')
SELECT record, entity, 'reviewer_approved' AS decision_type, confidence FROM g JOIN e USING (grp)
UNION ALL SELECT record, 'new:' || CAST(record AS VARCHAR), 'reviewer_separate', CAST(1 AS DOUBLE) FROM n WHERE record NOT IN (SELECT record FROM rl) AND record NOT IN (SELECT record FROM g)
UNION ALL SELECT record, entity, 'kept', CAST(NULL AS DOUBLE) FROM rl WHERE record NOT IN (SELECT record FROM g)
"""
NEAREST = """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
  FROM embeddings q JOIN embeddings b ON b.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)"""

SQL |= {
    "q5_review": "SELECT id, confidence, priority, status, queued_at FROM rq WHERE status IN ('pending', 'locked') ORDER BY priority DESC, queued_at, id LIMIT 50",
    "d15_evidence": EVIDENCE.format(na=WORDS.format("a.name"), nb=WORDS.format("b.name"), aa=WORDS.format("a.address"), ab=WORDS.format("b.address")),
    "d17_queue": "SELECT id, CASE decision WHEN 'defer' THEN 'deferred' WHEN 'confirm_match' THEN 'resolved' WHEN 'confirm_non_match' THEN 'resolved' ELSE status END AS status FROM rq LEFT JOIN act USING (id)",
    "d17_links": LINKS,
    "d17_audit": "SELECT CASE decision WHEN 'confirm_match' THEN 'review_merge_approved' ELSE 'review_pair_kept_separate' END AS action, CASE decision WHEN 'confirm_match' THEN 'ubid' ELSE 'candidate_pair' END AS entity_type, CAST(id AS VARCHAR) AS entity_id FROM act WHERE decision <> 'defer'",
    "d20_labels": "SELECT id, record_a, record_b, CAST(decision = 'confirm_match' AS INTEGER) AS label, CASE decision WHEN 'confirm_match' THEN 'auto_link' ELSE 'separate' END AS decision_type FROM rq JOIN act USING (id) WHERE decision <> 'defer'",
    "q14_hints": " UNION ALL ".join(f"SELECT * FROM (SELECT DISTINCT '{name}' AS column, {c} AS value FROM {t} WHERE {c} <> '' ORDER BY value LIMIT 20)" for t, c, name in (("registry", "status", "status"), ("registry", "sector", "sector"), ("source_records", "source_system", "source_system"), ("ev", "event_type", "event_type"), ("rq", "status", "review_status"))),
    "q20_governed": "SELECT pin_code, count(*) AS businesses FROM registry WHERE sector IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') GROUP BY pin_code",
    "q21_answer": "SELECT pin_code, count(*) AS business_count, round(avg(confidence_score), 3) AS average_match_confidence FROM registry WHERE status = 'Active' AND pin_code IS NOT NULL GROUP BY pin_code ORDER BY business_count DESC, pin_code LIMIT 50",
    "r2_map": "SELECT ubid, coalesce(name, 'Unknown Business') AS business_name, coalesce(status, 'Unknown') AS status, round(coalesce(CASE WHEN own_lng IS NOT NULL THEN own_lat END, CAST(12.9 AS DOUBLE) + n_nationkey * CAST(0.01 AS DOUBLE)) + (i % 9 - 4) * CAST(0.0015 AS DOUBLE), 6) AS lat, round(coalesce(CASE WHEN own_lat IS NOT NULL THEN own_lng END, CAST(77.5 AS DOUBLE) + n_nationkey * CAST(0.01 AS DOUBLE)) + (i // 9 % 9 - 4) * CAST(0.0015 AS DOUBLE), 6) AS lng FROM (SELECT *, row_number() OVER (ORDER BY ubid) - 1 AS i FROM (SELECT w.ubid, a.status, min(normalized_name) AS name, min(pincode) AS pin, avg(latitude) AS own_lat, avg(longitude) AS own_lng FROM wide w JOIN activity a ON a.ubid = w.ubid GROUP BY w.ubid, a.status ORDER BY w.ubid LIMIT 500)) LEFT JOIN nation ON n_nationkey + 560000 = CAST(pin AS INTEGER) WHERE own_lat IS NOT NULL OR n_nationkey IS NOT NULL",
    "r3_summary": "SELECT count(*) AS total, count(ubid) AS linked, count_if(ubid IS NULL) AS unlinked, count(pan) AS with_pan, count(gstin) AS with_gstin, round(avg(confidence) * 100, 2) AS avg_confidence FROM source_records LEFT JOIN (SELECT ubid, pan, gstin FROM ubids) USING (ubid)",
    "r6_lookup": "SELECT raw_id, source_system, raw_name, ubid, confidence FROM source_records WHERE raw_id = 42 OR raw_name ILIKE '%42%' ORDER BY CASE WHEN raw_id = 42 THEN 0 ELSE 1 END, extracted_at DESC, raw_id LIMIT 25",
    "t7_streamed_activity": SQL["d14_activity"],
}
PLAIN |= {
    "s_cosine_topk": f"SELECT query_id, id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM ({NEAREST}) WHERE rank <= 10",
    "d5_routing": f"SELECT query_id, id AS best_id, CASE WHEN s < 0.30 THEN 'new_ubid' WHEN query_id % 7 = 0 OR s < 0.40 THEN 'review_queue' ELSE 'auto_match' END AS decision FROM ({NEAREST}) WHERE rank = 1",
}


#: Dates are compared as text.
DATES = {"v_registry": ("created_on", "updated_on"), "v_activity_events": ("event_date",), "q3_stale_inspections": ("last_inspection",), "q5_review": ("queued_at",)}


def whole(name: str, sql: str, dates: tuple[str, ...] = ()) -> str:
    sql = re.sub(r"count_if\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"CAST(count_if(\1) AS BIGINT)", sql)
    if dates:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in dates)}) FROM ({sql})"
    return BASE + sql


def oracle_sql() -> dict[str, str]:
    return {k: whole(k, v, DATES.get(k, ())) for k, v in SQL.items()} | PLAIN
