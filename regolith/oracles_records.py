"""SQL of the queries on records, pairs, entities and screens, for an independent engine."""

from __future__ import annotations

from functools import reduce

from regolith.functions.text import ADDRESS_WORDS, ALPHABET, CODES, LOCALITIES, NAME_PREFIXES, NAME_SUFFIXES
from regolith.oracles import LINKS, NEAREST, whole

UNNAMED = "Unknown Business"


def name_sql(x: str) -> str:
    out = rf"regexp_replace(lower(trim({x})), '[^a-z0-9\s]', ' ', 'g')"
    out = reduce(lambda s, p: rf"regexp_replace({s}, '\b{p}\b', ' ', 'g')", NAME_SUFFIXES, out)
    out = reduce(lambda s, p: rf"regexp_replace({s}, '^{p}', '')", NAME_PREFIXES, out)
    return rf"nullif(trim(regexp_replace({out}, '\s+', ' ', 'g')), '')"


def address_sql(x: str) -> str:
    out = rf"regexp_replace(lower(trim({x})), '[,.;:/\\-]', ' ', 'g')"
    out = reduce(lambda s, p: rf"regexp_replace({s}, '\b{p[0]}\b', '{p[1]}', 'g')", ADDRESS_WORDS, out)
    out = reduce(lambda s, p: f"replace({s}, '{p[0]}', '{p[1]}')", LOCALITIES, out)
    return rf"nullif(trim(regexp_replace({out}, '\s+', ' ', 'g')), '')"


def locality_sql(flat: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({flat}, '{a}') THEN '{b}'" for a, b in LOCALITIES) + f" ELSE {flat} END"


def phonetic_sql(name: str) -> str:
    letters = "regexp_replace(lower(w), '[^a-z]', '', 'g')"
    code = f"list_transform([{letters}], lambda l: list_transform([translate(l, '{ALPHABET}', '{CODES}')], lambda d: CASE WHEN l <> '' THEN rpad(upper(l[1]) || array_to_string(list_transform(list_filter(range(2, length(l) + 1), lambda i: d[i] <> d[i - 1] AND d[i] <> '0'), lambda i: d[i]), ''), 4, '0') END)[1])[1]"
    codes = rf"list_filter(list_transform(list_filter(string_split_regex({name}, '\s+'), lambda w: w <> ''), lambda w: {code}), lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({codes}) > 0 THEN 'SX:' || array_to_string({codes}, ' ') END"


def tokens_sql(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower(coalesce({x}, '')), '\s+'), lambda t: t <> ''))"


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) ELSE CAST(0 AS DOUBLE) END"


def dice_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST(2 * len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b})) ELSE CAST(0 AS DOUBLE) END"


def codes_sql(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(regexp_replace(coalesce({x}, ''), 'DM:|SX:', '', 'g'), '[|\s]+'), lambda t: t <> ''))"


def exact_sql(a: str, b: str) -> str:
    return f"coalesce(upper(trim({a})) = upper(trim({b})) AND trim({a}) <> '', false)"


def conflict_sql(a: str, b: str) -> str:
    return f"coalesce(trim({a}) <> '' AND trim({b}) <> '' AND upper(trim({a})) <> upper(trim({b})), false)"


def vector_sql(x: str, n: int) -> str:
    """Signed counts of hashed words."""
    h = rf"list_transform(list_filter(string_split_regex(lower({x}), '\s+'), lambda t: t <> ''), lambda t: [CAST(('0x' || substr(md5(t), 1, 4)) AS INTEGER) % {n}, CASE WHEN CAST(('0x' || substr(md5(t), 5, 1)) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END])"
    return f"list_transform(range(0, {n}), lambda i: coalesce(list_sum(list_transform(list_filter({h}, lambda q: q[1] = i), lambda q: q[2])), 0))"


RAW = """
pay AS (
  SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal, c_name,
    CASE c_custkey % 6 WHEN 0 THEN 'M/s ' || c_mktsegment || ' Traders Pvt. Ltd.' WHEN 1 THEN 'Shri ' || c_mktsegment || ' & Co' WHEN 2 THEN 'The ' || c_mktsegment || ' Works ' || CAST(c_custkey AS VARCHAR) WHEN 3 THEN '4x ' || c_mktsegment || ' Enterprises' WHEN 5 THEN c_mktsegment || ' Industries Limited' END AS name,
    CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey % 90 AS VARCHAR) || ', Brigade Road, 56' || lpad(CAST(c_custkey % 100 AS VARCHAR), 4, '0') WHEN 1 THEN 'Plot 5, Peenya Industrial Area,  Bengaluru 560058' WHEN 2 THEN '' END AS address,
    CASE WHEN c_custkey % 7 = 0 THEN 'ABCDK0042F' WHEN c_custkey % 3 <> 0 THEN ' abcpk ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ' f' END AS pan,
    CASE c_custkey % 4 WHEN 0 THEN '27aapfu0939f1zv' WHEN 2 THEN '27AAPFU0939F1ZW' END AS gstin, CASE WHEN c_custkey % 5 = 0 THEN 'Smt. Asha ' || CAST(c_custkey AS VARCHAR) END AS owner
  FROM customer
)"""
NORM = f"""
{RAW}, flat AS (SELECT *, {name_sql('name')} AS nn, CASE WHEN coalesce(address, '') <> '' THEN {address_sql('address')} END AS raw, {name_sql('owner')} AS prop FROM pay)"""
#: Records under review, normalised, as both sides of a pair.
SIDES = f"""
nr AS (SELECT record, {name_sql('name')} AS name, {address_sql('address')} AS raw, pan, gstin, pincode FROM rp), ns AS (SELECT *, {locality_sql('raw')} AS locality, {phonetic_sql('name')} AS phonetic FROM nr)"""
NEAR = f"""
{SIDES}, near AS (SELECT query_id AS new_id, id AS best_id, s AS similarity FROM ({NEAREST}) WHERE rank = 1
), ee AS (
  SELECT new_id, best_id, similarity, round(similarity, 4) AS semantic_similarity, {exact_sql('a.pan', 'b.pan')} AS pan_match, {exact_sql('a.gstin', 'b.gstin')} AS gstin_match,
    round({jaccard_sql(tokens_sql("a.raw || ' ' || a.locality"), tokens_sql("b.raw || ' ' || b.locality"))}, 4) AS address_overlap, round({jaccard_sql(tokens_sql('a.name'), tokens_sql('b.name'))}, 4) AS token_overlap,
    round({jaccard_sql(codes_sql('a.phonetic'), codes_sql('b.phonetic'))}, 4) AS phonetic_similarity, round({jaccard_sql(tokens_sql('a.name'), tokens_sql('b.name'))}, 4) AS fuzzy_name_similarity, {exact_sql('a.pincode', 'b.pincode')} AS pincode_match,
    {conflict_sql('a.pan', 'b.pan')} AS pan_conflict, {conflict_sql('a.gstin', 'b.gstin')} AS gstin_conflict, array_to_string(list_sort(list_intersect({tokens_sql('a.name')}, {tokens_sql('b.name')})), ' ') AS matched_tokens
  FROM near JOIN ns a ON a.record = new_id % 200 JOIN ns b ON b.record = best_id % 200
), e AS (
  SELECT *, CASE WHEN pan_conflict OR gstin_conflict THEN 'identifier_conflict_blocks_auto_match' END AS guardrail,
    CASE WHEN similarity < CAST(0.3 AS DOUBLE) THEN 'new_ubid' WHEN pan_conflict OR gstin_conflict OR similarity < CAST(0.4 AS DOUBLE) THEN 'review_queue' ELSE 'auto_match' END AS decision FROM ee
), held AS (
  SELECT least(a, b) AS low, greatest(a, b) AS high, min(pair_id) AS pair_id FROM (SELECT vec_id + 1 AS a, vec_id AS b, 'P' || CAST(vec_id AS VARCHAR) AS pair_id FROM embeddings WHERE vec_id % 40 = 0 UNION ALL SELECT best_id, new_id, 'H' || CAST(new_id AS VARCHAR) FROM e WHERE new_id % 40 = 0) GROUP BY 1, 2
), mg AS (
  SELECT e.*, coalesce(held.pair_id, 'new:' || CAST(least(new_id, best_id) AS VARCHAR) || '-' || CAST(greatest(new_id, best_id) AS VARCHAR)) AS pair_id, held.pair_id IS NULL AS is_new
  FROM e LEFT JOIN held ON low = least(new_id, best_id) AND high = greatest(new_id, best_id)
)"""
LINK = f"""
pt AS (
  SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS id, {name_sql("p_name || ' ' || p_brand")} AS name, '5600' || lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0') AS pincode, CASE WHEN p_partkey % 3 = 0 THEN 'ABCPK' || lpad(CAST(p_partkey % 700 AS VARCHAR), 4, '0') || 'F' END AS pan,
    {address_sql("'Plot ' || CAST(p_partkey % 30 AS VARCHAR) || ', ' || p_type || ' Road'")} AS raw FROM part
), pr AS (SELECT *, {phonetic_sql('name')} AS phonetic, substr(replace(name, ' ', ''), 1, 6) AS six, {locality_sql('raw')} AS locality FROM pt
), ks AS (
  SELECT id, 0 AS rank, pan AS key, 100 AS cap FROM pr WHERE pan IS NOT NULL UNION ALL SELECT id, 2, pincode || '::' || six, 30 FROM pr WHERE six <> '' UNION ALL SELECT id, 3, phonetic, 25 FROM pr WHERE phonetic IS NOT NULL
), cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rank, key ORDER BY id) AS rn FROM ks) WHERE rn <= cap
), so AS (SELECT id, substr(replace(name, ' ', ''), 1, 4) AS four, row_number() OVER (ORDER BY coalesce(name, ''), id) AS place FROM pr
), ap AS (
  SELECT x.id AS a, y.id AS b, x.rank FROM cp x JOIN cp y ON x.rank = y.rank AND x.key = y.key AND x.id < y.id
  UNION ALL SELECT least(x.id, y.id), greatest(x.id, y.id), 4 FROM so x JOIN so y ON y.place BETWEEN x.place + 1 AND x.place + 5 AND x.four = y.four AND x.four <> ''
), bl AS (SELECT a, b, CASE min(rank) WHEN 0 THEN 'pan_exact' WHEN 1 THEN 'gstin_exact' WHEN 2 THEN 'pincode_name' WHEN 3 THEN 'phonetic' ELSE 'sorted_neighborhood' END AS strategy FROM ap GROUP BY a, b)"""
SCORES = f"""
{LINK}, f AS (
  SELECT bl.a, bl.b, strategy, round(coalesce(list_cosine_similarity(CAST({vector_sql('x.name', 16)} AS DOUBLE[]), CAST({vector_sql('y.name', 16)} AS DOUBLE[])), 0), 4) AS embedding_similarity,
    round({dice_sql(tokens_sql('x.name'), tokens_sql('y.name'))}, 4) AS name_similarity, {jaccard_sql(codes_sql('x.phonetic'), codes_sql('y.phonetic'))} AS ph, round({dice_sql(tokens_sql('x.locality'), tokens_sql('y.locality'))}, 4) AS address_overlap,
    CAST({exact_sql('x.pan', 'y.pan')} AS DOUBLE) AS anchor, CAST({exact_sql('x.pincode', 'y.pincode')} AS DOUBLE) AS pin, coalesce(x.pan, '') = '' AND coalesce(y.pan, '') = '' AS spread, {conflict_sql('x.pan', 'y.pan')} AS conflict
  FROM bl JOIN pr x ON x.id = bl.a JOIN pr y ON y.id = bl.b
), g AS (SELECT *, CASE WHEN spread THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS m FROM f
), h AS (SELECT *, embedding_similarity * CAST(0.2 AS DOUBLE) * m + name_similarity * CAST(0.1 AS DOUBLE) * m + address_overlap * CAST(0.1 AS DOUBLE) * m + ph * CAST(0.05 AS DOUBLE) * m + pin * CAST(0.05 AS DOUBLE) * m + CASE WHEN spread THEN 0 ELSE anchor * CAST(0.5 AS DOUBLE) END AS raw FROM g
), sc AS (SELECT *, round(greatest(0, least(1, CASE WHEN conflict THEN least(raw, CAST(0.4 AS DOUBLE)) ELSE raw END)), 4) AS score FROM h)
SELECT a, b, strategy, embedding_similarity, name_similarity, round(ph, 6) AS phonetic_match, address_overlap, round(name_similarity * CAST(0.1 AS DOUBLE) * m, 4) AS name_share, score, conflict,
  CASE WHEN conflict THEN 'separate' WHEN score >= CAST(0.92 AS DOUBLE) THEN 'auto_link' WHEN score >= CAST(0.75 AS DOUBLE) THEN 'review_queue' ELSE 'separate' END AS decision,
  CASE WHEN conflict THEN 'conflicting_anchor_identifier' WHEN score >= CAST(0.92 AS DOUBLE) THEN 'above_auto_threshold' WHEN score >= CAST(0.75 AS DOUBLE) THEN 'in_review_band' ELSE 'below_review_threshold' END AS reason FROM sc"""
ASKED = "(upper(source_record_id) = '{q}' OR upper(coalesce(pan, '')) = '{q}' OR upper(coalesce(gstin, '')) = '{q}')"
FOUND = ASKED + " OR contains(upper(coalesce(normalized_name, '')), '{q}') OR contains(upper(coalesce(raw_name, '')), '{q}') OR contains(upper(coalesce(raw_address, '')), '{q}')"
MATCHES = "SELECT * FROM wide WHERE " + FOUND + " ORDER BY CASE WHEN upper(source_record_id) = '{q}' THEN 0 ELSE 1 END, extracted_at DESC, raw_id LIMIT 25"
MEANT = "SELECT ubid FROM wide WHERE ubid IS NOT NULL AND (" + ASKED + " OR contains(upper(coalesce(normalized_name, '')), '{q}')) ORDER BY ubid LIMIT 1"
LINKED = f"""SELECT ubid, raw_id, coalesce(raw_name, normalized_name, '{UNNAMED}') AS name, coalesce(nullif(raw_address, ''), nullif(pincode, '')) AS address, pan, CAST(round_even(confidence * 100, 0) AS INTEGER) AS confidence, decision_type, strftime(linked_at, '%Y-%m-%d') AS linked_at, source_system
  FROM wide WHERE ubid IN ({MEANT})"""
PAIRS = f"SELECT pair_id, strategy, CAST(round_even(score * 100, 0) AS INTEGER) AS confidence, a, b, review_status, reviewer_decision FROM pairs WHERE a IN (SELECT raw_id FROM ({MATCHES})) OR b IN (SELECT raw_id FROM ({MATCHES})) ORDER BY score DESC, pair_id LIMIT 20"
SEEN = "(SELECT ubid, list({c} ORDER BY o) AS {m} FROM (SELECT ubid, {c}, min(o) AS o FROM w WHERE coalesce({c}, '') <> '' GROUP BY ubid, {c}) GROUP BY ubid) l_{m}"
LISTS = {"names": "name", "addresses": "address", "sectors": "sector", "pincodes": "pincode", "pans": "pan", "gstins": "gstin", "departments": "source_system"}
PROFILE = f"""SELECT * FROM (WITH w AS (
  SELECT *, coalesce(raw_name, normalized_name, '{UNNAMED}') AS name, coalesce(nullif(raw_address, ''), nullif(pincode, '')) AS address, row_number() OVER (PARTITION BY ubid ORDER BY confidence DESC, extracted_at DESC, raw_id) AS o FROM wide WHERE ubid IS NOT NULL
), n AS (SELECT ubid, count(*) AS source_records, avg(latitude) AS lat, avg(longitude) AS lng FROM w GROUP BY ubid)
SELECT u.ubid, coalesce(names[1], '{UNNAMED}') AS name, coalesce(status, 'Unknown') AS status, round(coalesce(score, 0), 3) AS score, coalesce(source_records, 0) AS source_records, coalesce(addresses[1], 'N/A') AS address, coalesce(anchor_pan, pans[1]) AS pan, coalesce(anchor_gstin, gstins[1]) AS gstin,
  coalesce(sectors[1], 'Unknown') AS sector, array_to_string(pincodes, ' ') AS pincodes, array_to_string(pans, ' ') AS pan_values, array_to_string(departments, ' ') AS source_systems, CAST(coalesce(len(departments), 0) AS INTEGER) AS linked_departments, coalesce(len(pans), 0) > 1 AS pan_conflict, coalesce(len(gstins), 0) > 1 AS gstin_conflict,
  override, round(lat, 6) AS lat, round(lng, 6) AS lng FROM base u LEFT JOIN n USING (ubid) {' '.join('LEFT JOIN ' + SEEN.format(c=c, m=m) + ' USING (ubid)' for m, c in LISTS.items())})"""
TITLE = "array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
TIMELINE = f"""SELECT *, CAST(row_number() OVER (PARTITION BY ubid ORDER BY on_date DESC, type, title, description, source) AS INTEGER) AS place FROM (
  SELECT ubid, 'computed' AS type, '2024-01-31' AS on_date, 'Status computed' AS title, 'Activity status is ' || coalesce(status, 'Unknown') || ' with score ' || CAST(CAST(CAST(coalesce(score, 0) AS DECIMAL(18, 4)) AS DECIMAL(18, 2)) AS VARCHAR) || '.' AS description, 'activity_classifier' AS source FROM base
  UNION ALL SELECT ev.ubid, 'signal', CAST(event_date AS VARCHAR), event_type, 'Evidence used in the ' || coalesce(status, 'Unknown') || ' activity decision.', 'registry' FROM ev JOIN taxonomy USING (event_type) JOIN base ON base.ubid = ev.ubid
  UNION ALL SELECT ubid, 'signal', CAST(event_date AS VARCHAR), {TITLE.format(x="coalesce(event_type, 'Activity event')")}, coalesce(outcome, 'Event ' || CAST(event_id AS VARCHAR) || ' was reported.'), 'events' FROM ev
  UNION ALL SELECT ubid, 'link', strftime(linked_at, '%Y-%m-%d'), 'Department record linked', source_system || ' record ' || source_record_id || ' is linked by ' || coalesce(decision_type, 'matching') || ' at ' || CAST(CAST(round_even(confidence * 100, 0) AS INTEGER) AS VARCHAR) || '% confidence.', source_system FROM wide WHERE ubid IS NOT NULL
) QUALIFY place <= 50"""
CODE = "'UBID-KA-29-2024-' || lpad(CAST({k} AS VARCHAR), 6, '0') || '-' || CAST((10 - list_sum(list_transform(range(1, 13), lambda i: list_transform([CAST(('292024' || lpad(CAST({k} AS VARCHAR), 6, '0'))[i] AS INTEGER)], lambda d: CASE WHEN (12 - i) % 2 = 1 THEN (CASE WHEN d > 4 THEN d * 2 - 9 ELSE d * 2 END) ELSE d END)[1])) % 10) % 10 AS VARCHAR)"
SHOWN = f"""(SELECT w.*, a.status, coalesce(raw_name, normalized_name, '') AS shown_name, coalesce(confidence, 0) AS known_confidence, CASE WHEN w.ubid IS NOT NULL THEN {CODE.format(k='w.ubid')} END AS ubid_code FROM wide w LEFT JOIN activity a ON a.ubid = w.ubid)"""
PAGE = """SELECT source_record_id AS id, source_system AS source, CASE WHEN shown_name <> '' THEN shown_name ELSE 'Unknown' END AS name, coalesce(nullif(raw_address, ''), nullif(pincode, ''), 'N/A') AS address, coalesce(pan, 'N/A') AS pan, coalesce(gstin, 'N/A') AS gstin, coalesce(sector, 'Unknown') AS sector, coalesce(pincode, 'N/A') AS pincode,
  ubid_code AS ubid, coalesce(status, 'Unlinked') AS status, ubid IS NOT NULL AS linked, CAST(round_even(confidence * 100, 0) AS INTEGER) AS confidence, coalesce(decision_type, 'Unlinked') AS decision_type, strftime(extracted_at, '%Y-%m-%d') AS date FROM ({rows})"""
LIKE = " OR ".join(f"coalesce({c}, '') ILIKE '%tomer 1%'" for c in ("source_record_id", "shown_name", "raw_address", "pan", "gstin", "ubid_code"))
REVIEW = """SELECT id, priority, CAST(queued_at AS VARCHAR) AS queued_at, CAST(round_even(confidence * 100, 0) AS INTEGER) AS confidence_percent, name_overlap, address_overlap, same_pan,
  CASE WHEN strong THEN 'Likely same, verify' WHEN confidence >= CAST(0.85 AS DOUBLE) THEN 'Good match' WHEN confidence >= CAST(0.70 AS DOUBLE) THEN 'Needs officer check' WHEN confidence >= CAST(0.55 AS DOUBLE) THEN 'Needs more proof' ELSE 'Likely separate' END AS band, CASE WHEN strong THEN 'approve' ELSE 'keep_separate' END AS recommendation,
  'Model confidence=' || CAST(CAST(round_even(confidence * 100, 0) AS INTEGER) AS VARCHAR) || ':warning; Name model score=' || CAST(CASE WHEN name_overlap <= 1 THEN name_overlap * 100 ELSE name_overlap END AS VARCHAR) || CASE WHEN name_overlap >= 70 THEN ':success' ELSE ':warning' END
    || '; Address overlap=' || CAST(CASE WHEN address_overlap <= 1 THEN address_overlap * 100 ELSE address_overlap END AS VARCHAR) || CASE WHEN address_overlap >= 50 THEN ':success' ELSE ':warning' END AS scores
FROM (SELECT *, same_pan AND same_pincode AND name_overlap >= 70 AS strong FROM (
  SELECT rq.*, coalesce(a.pan = b.pan, false) AS same_pan, a.pincode = b.pincode AS same_pincode, CAST(round_even(CAST(len(list_intersect({na}, {nb})) AS DOUBLE) / len(list_distinct(list_concat({na}, {nb}))) * 100, 0) AS INTEGER) AS name_overlap,
    CAST(round_even(CAST(len(list_intersect({aa}, {ab})) AS DOUBLE) / len(list_distinct(list_concat({aa}, {ab}))) * 100, 0) AS INTEGER) AS address_overlap FROM rq JOIN rp a ON a.record = record_a JOIN rp b ON b.record = record_b WHERE {where} ORDER BY {order}))"""
UP = "list_distinct(list_filter(string_split_regex(upper({}), '[^A-Z0-9]+'), lambda t: t <> ''))"
_REVIEW = {"na": UP.format("a.name"), "nb": UP.format("b.name"), "aa": UP.format("a.address"), "ab": UP.format("b.address")}
COVER = "CASE WHEN coalesce({x}, '') = '' THEN {x} ELSE '{m}-' || CASE WHEN length({x}) >= {n} THEN right({x}, {n}) ELSE repeat('X', {n}) END END"
BIZ = "CASE WHEN coalesce(trim({x}), '') = '' THEN 'BIZ-unknown' ELSE 'BIZ-' || substr(sha256(lower(trim({x}))), 1, 8) END"

#: Queries over the base tables; WITH begins where a query adds its own.
SQL = {
    "v1_ubid_registry": "SELECT ubid, business_name, pan AS pan_anchor, gstin AS gstin_anchor, status, sector, pin_code, CAST(NULL AS VARCHAR) AS district, confidence_score, CAST(record_count AS BIGINT) AS source_record_count, source_count AS department_count, created_on AS assigned_on, updated_on AS last_updated FROM registry",
    "v2_source_records": f"SELECT raw_id AS id, ubid, source_system, source_record_id, coalesce(raw_name, normalized_name, '{UNNAMED}') AS raw_name, raw_address, pincode AS pin_code, sector, pan, gstin, confidence AS link_confidence, decision_type AS link_type, linked_at, extracted_at FROM wide",
    "v3_activity_events": "SELECT event_id AS id, u.ubid, 'events' AS source_system, event_type, event_date, outcome AS event_outcome, ingested_at FROM ev LEFT JOIN ubids u ON u.ubid = ev.ubid",
    "v4_audit_log": "SELECT id, ubid, action, actor, entity_type, created_at FROM audits",
    "d14_override": "SELECT u.ubid, round(coalesce(s, 0), 4) AS score, coalesce(o.override, st) AS status, CAST(coalesce(n, 0) AS BIGINT) AS n_events, st AS computed_status, o.override FROM (SELECT u.ubid, s, n, CASE WHEN coalesce(s, 0) >= 1.5 THEN 'Active' WHEN coalesce(s, 0) >= 0 THEN 'Dormant' ELSE 'Closed' END AS st FROM ubids u LEFT JOIN (SELECT ubid, sum(weight * exp(-ln(CAST(2 AS DOUBLE)) * greatest(0, date_diff('day', event_date, DATE '2024-01-31')) / half_life)) AS s, count(*) AS n FROM ev JOIN taxonomy USING (event_type) WHERE event_id % 50 <> 7 GROUP BY ubid) USING (ubid)) u LEFT JOIN overrides o ON o.ubid = u.ubid",
    "w5_timeline": "SELECT ubid, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(event_date AS VARCHAR) || '/' || CAST(event_id AS VARCHAR), ' ' ORDER BY event_date DESC, event_id DESC) AS events FROM ev JOIN taxonomy USING (event_type) GROUP BY ubid",
    "r1_sectors": "SELECT coalesce(sector, 'Unknown') AS sector, count(*) AS businesses, count_if(status = 'Active') AS active, count_if(status = 'Dormant') AS dormant, count_if(status = 'Closed') AS closed, count(DISTINCT pin_code) AS pin_codes, round(avg(confidence_score), 3) AS avg_confidence, CAST(sum(record_count) AS BIGINT) AS linked_records FROM registry GROUP BY 1 ORDER BY businesses DESC, sector LIMIT 8",
    "s3_refreshed": "SELECT * FROM registry",
    "j10_recall": f"SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS reached FROM ({NEAREST}) WHERE rank <= 10",
    "r8_cursor": "SELECT ubid, business_name, confidence_score FROM registry ORDER BY confidence_score DESC NULLS LAST, ubid LIMIT 25 OFFSET 50",
    "a3_sketches": "SELECT source_system, count(*) AS links, count(DISTINCT ubid) AS businesses, true AS close FROM links JOIN raw_records USING (raw_id) GROUP BY source_system",
    "w5_newest": "SELECT ubid, max(n) AS n_total, string_agg(CAST(event_date AS VARCHAR) || '/' || CAST(event_id AS VARCHAR), ' ' ORDER BY event_date DESC, event_id DESC) AS events FROM (SELECT *, count(*) OVER (PARTITION BY ubid) AS n, row_number() OVER (PARTITION BY ubid ORDER BY event_date DESC, event_id DESC) AS place FROM ev JOIN taxonomy USING (event_type)) WHERE place <= 3 GROUP BY ubid",
    "t7_changes": "SELECT ubid, day, CASE WHEN coalesce(s, 0) >= 1.5 THEN 'Active' WHEN coalesce(s, 0) >= 0 THEN 'Dormant' ELSE 'Closed' END AS status FROM (SELECT ubid, day FROM ubids, (VALUES ('2024-01-08'), ('2024-01-15'), ('2024-01-24')) d(day)) LEFT JOIN (SELECT ubid, day, sum(weight * exp(-ln(CAST(2 AS DOUBLE)) * date_diff('day', event_date, CAST(day AS DATE)) / half_life)) AS s FROM ev JOIN taxonomy USING (event_type) JOIN (VALUES ('2024-01-08'), ('2024-01-15'), ('2024-01-24')) d(day) ON event_date <= CAST(day AS DATE) GROUP BY ubid, day) USING (ubid, day)",
    "t1_closed_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events) WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY 1, 2",
    "t3_late": "SELECT event_id, arrived IS NOT NULL AS is_bound, CAST(CASE WHEN arrived IS NULL THEN 5 ELSE ceil(greatest(0, epoch(arrived) - epoch(CAST(ingested_at AS TIMESTAMP))) / CAST(172800 AS DOUBLE)) END AS INTEGER) AS retry_count FROM ev LEFT JOIN (SELECT c_custkey AS ubid, TIMESTAMP '2023-12-20' + to_days(CAST(c_custkey % 60 AS INTEGER)) + to_hours(c_custkey % 24) AS arrived FROM customer WHERE c_custkey % 3 <> 1) i ON i.ubid = ev.ubid AND arrived <= CAST(ingested_at AS TIMESTAMP) + INTERVAL 10 DAY",
    "d11_merged": "SELECT id, record_a, record_b, CASE WHEN id % 3 <> 0 THEN confidence ELSE CAST(0.1 AS DOUBLE) END AS confidence, priority, CASE WHEN id % 3 <> 0 THEN status ELSE 'pending' END AS status FROM rq WHERE id % 5 <> 0 AND (id % 2 = 0 OR id % 3 <> 0)",
    "r1_cards": "SELECT 'stale_inspections' AS card, top AS subject, count_if(u.ubid IS NOT NULL AND (last IS NULL OR last < DATE '2024-01-25')) AS value FROM (SELECT coalesce((SELECT pin_code FROM registry WHERE pin_code IS NOT NULL GROUP BY pin_code ORDER BY count(*) DESC, pin_code LIMIT 1), '560058') AS top) LEFT JOIN registry u ON u.pin_code = top AND u.status = 'Active' AND u.sector IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') LEFT JOIN (SELECT ubid, max(event_date) AS last FROM ev WHERE event_type = 'inspection' GROUP BY ubid) e ON e.ubid = u.ubid GROUP BY top UNION ALL SELECT 'identifier_gap', 'pan without gstin', count(pan) - count(gstin) FROM registry UNION ALL SELECT 'review_queue', 'pending', count_if(status IN ('pending', 'locked')) FROM rq",
    "r3_screen": PAGE.format(rows=f"SELECT * FROM {SHOWN} WHERE source_system = 'tax' AND coalesce(status, 'Unlinked') = 'Dormant' AND pan IS NOT NULL AND pan <> '' AND ({LIKE}) ORDER BY known_confidence DESC, extracted_at DESC, raw_id LIMIT 25 OFFSET 5").replace("ORDER BY known_confidence DESC, extracted_at DESC, raw_id", "ORDER BY known_confidence DESC, extracted_at DESC, raw_id"),
    "r3_by_name": PAGE.format(rows=f"SELECT * FROM {SHOWN} WHERE ubid IS NULL ORDER BY shown_name, raw_id LIMIT 50"),
    "r3_screen_summary": f"SELECT count(*) AS total, count_if(ubid IS NOT NULL) AS linked, count_if(ubid IS NULL) AS unlinked, count_if(coalesce(pan, '') <> '') AS with_pan, count_if(coalesce(gstin, '') <> '') AS with_gstin, CAST(round_even(round(avg(known_confidence), 3) * 100, 0) AS INTEGER) AS avg_confidence FROM {SHOWN} WHERE coalesce(sector, 'Unknown') = 'MACHINERY' AND coalesce(gstin, '') = ''",
    "r8_directory": f"SELECT ubid, business_name, status, sector, pin_code, pan AS pan_anchor, gstin AS gstin_anchor, confidence_score, CAST(created_on AS VARCHAR) AS assigned_on, CAST(record_count AS BIGINT) AS linked_record_count, 2 AS page FROM registry WHERE (business_name ILIKE '%er 1%' OR {CODE.format(k='ubid')} ILIKE '%er 1%' OR coalesce(pan, '') ILIKE '%er 1%' OR coalesce(gstin, '') ILIKE '%er 1%') AND coalesce(pan, '') <> '' AND coalesce(gstin, '') = '' ORDER BY confidence_score DESC NULLS LAST, ubid LIMIT 25 OFFSET 25",
    "r6_raw": "SELECT raw_id, source_record_id, raw_name, raw_address, pan, ubid FROM (" + MATCHES.format(q="CUSTOMER 42") + ")",
    "r6_pairs": PAIRS.format(q="CUSTOMER 42"),
    "r6_linked": "SELECT * EXCLUDE source_system FROM (" + LINKED.format(q="TAX-42") + ")",
    "r6_summary": f"SELECT 'customer 42' AS searched_query, raw_matches > 0 OR ubid IS NOT NULL AS found, CASE WHEN ubid IS NOT NULL THEN 'canonical_ubid_found' WHEN confirmed_pairs > 0 THEN 'review_confirmed_linkage_pending' ELSE 'raw_record_unlinked' END AS trace_status, CASE WHEN ubid IS NOT NULL THEN 'Linked' WHEN raw_matches > 0 THEN 'Linkage Pending' ELSE 'Not Found' END AS shown_status, * FROM (SELECT max(ubid) AS ubid FROM ({MEANT.format(q='CUSTOMER 42')})), (SELECT count(*) AS raw_matches FROM ({MATCHES.format(q='CUSTOMER 42')})), (SELECT count(*) AS candidate_pairs, count_if(reviewer_decision = 'confirm_match') AS confirmed_pairs, count_if(review_status IN ('pending', 'locked')) AS pending_reviews FROM ({PAIRS.format(q='CUSTOMER 42')})), (SELECT count(*) AS linked_records, count(DISTINCT source_system) AS departments FROM ({LINKED.format(q='CUSTOMER 42')}))",
    "r7_profile": PROFILE,
    "r7_timeline": TIMELINE,
    "r11_explanation": "SELECT u.ubid, coalesce(status, 'Unknown') AS status, event_id, event_type, event_date, outcome FROM base u LEFT JOIN ev ON ev.ubid = u.ubid WHERE u.ubid = 13 ORDER BY event_date DESC NULLS LAST, event_id LIMIT 50",
    "r10_semantic": f"SELECT query_id, id, business_name, round(s, 6) AS similarity FROM ({NEAREST}) JOIN registry ON registry.ubid = id WHERE rank <= 10 AND s > CAST(0.3 AS DOUBLE)",
    "a13_modes": """SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS p FROM (SELECT "column", value, count(*) AS n FROM (SELECT 'pin_code' AS "column", pin_code AS value FROM registry UNION ALL SELECT 'sector', sector FROM registry UNION ALL SELECT 'status', status FROM registry) WHERE value <> '' GROUP BY 1, 2)) WHERE p <= 3""",
    "o8_latest": "SELECT raw_id AS id, linked_at FROM links ORDER BY linked_at DESC, raw_id LIMIT 100",
    "d13_batch": "SELECT raw_id AS id, extracted_at FROM raw_records WHERE raw_id NOT IN (SELECT raw_id FROM links WHERE unlinked_at IS NULL) ORDER BY extracted_at, raw_id LIMIT 50",
    "w7_sequence": "SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS number FROM customer",
    "s2_commit": "SELECT ubid, pan, n_links FROM ubids LEFT JOIN (SELECT ubid, count(*) AS n_links FROM links GROUP BY ubid) USING (ubid)",
    "s9_csv": """SELECT CAST(ubid AS VARCHAR) AS "UBID", business_name AS "Business Name", status AS "Status", sector AS "Sector", coalesce(pan, 'N/A') AS "PAN", coalesce(gstin, 'N/A') AS "GSTIN", coalesce(pin_code, 'N/A') AS "Pin Code", CAST(record_count AS VARCHAR) AS "Linked Records", CAST(confidence_score AS VARCHAR) AS "Confidence"
      FROM registry WHERE status = 'Dormant' ORDER BY registry.confidence_score DESC NULLS LAST, registry.ubid LIMIT 100""",
    "t5_queue": "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1",
    "q16_report": "SELECT 'count of closed businesses by sector' AS question, count(*) || ' sectors; ' || arg_min(sector, o) || ' leads with ' || arg_min(n, o) || ' businesses.' AS report FROM (SELECT sector, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sector) AS o FROM registry WHERE status = 'Closed' GROUP BY sector)",
    "q15_relaxed": "SELECT 'no_exact_match_with_related' AS mode, 'PIN codes with matching businesses' AS title, pin_code, count(*) AS business_count, count_if(status = 'Active') AS active_count FROM registry WHERE status = 'Active' AND pin_code IS NOT NULL GROUP BY pin_code ORDER BY business_count DESC, pin_code LIMIT 25",
    "q20_written": "SELECT pin_code, max(confidence_score) AS best FROM registry WHERE sector IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') GROUP BY pin_code",
    "t1_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "t2_duplicates": "SELECT event_id % 300 AS dedup_key, CAST(1 AS BIGINT) AS n FROM events GROUP BY 1",
    "t3_bound": "SELECT event_id, is_bound, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END + CASE WHEN is_bound THEN 0 ELSE 1 END AS retry_count FROM (SELECT event_id, ubid IN (SELECT ubid FROM ubids WHERE ubid % 3 <> 1) AS is_bound FROM ev)",
    "t4_ingest": "SELECT source_record_id FROM raw_records WHERE raw_id % 3 <> 0",
    "r4_review": REVIEW.format(**_REVIEW, where="status = 'pending'", order="priority DESC, queued_at, id LIMIT 100"),
    "r5_item": "SELECT id, recommendation, 'rule_summary' AS source FROM (" + REVIEW.format(**_REVIEW, where="true", order="id LIMIT 1") + ")",
    "d18_ended_links": "SELECT rl.record, rl.entity, '2024-01-31' AS unlinked_at FROM rl JOIN (SELECT record, entity FROM ({LINKS}) WHERE decision_type = 'reviewer_approved') n ON n.record = rl.record AND n.entity <> rl.entity",
    "d17_decisions": "SELECT id, record_a, record_b, CASE decision WHEN 'confirm_match' THEN 'auto_link' WHEN 'confirm_non_match' THEN 'separate' ELSE 'review_queue' END AS decision_type, decision, confidence FROM rq JOIN act USING (id)",
    "d17_locks": "SELECT id, CASE WHEN status = 'pending' AND id % 2 = 0 THEN 'locked' ELSE status END AS status, CASE WHEN status = 'pending' AND id % 2 = 0 THEN 'early' END AS locked_by FROM rq",
    "d22_audit": "SELECT 'review_decision' AS action, 'review_queue' AS entity_type, CAST(id AS VARCHAR) AS entity_id, 'officer' AS actor FROM act WHERE decision <> 'defer' UNION ALL SELECT 'decision_made', 'candidate_pair', CAST(pair_id AS VARCHAR), 'system' FROM pairs UNION ALL SELECT 'ubid_created', 'ubid', CAST(ubid AS VARCHAR), 'system' FROM ubids UNION ALL SELECT 'threshold_config_changed', 'threshold_config', 'v2', 'admin' UNION ALL SELECT 'ml_weights_deployed', 'ml_model_weights', 'w7', 'admin'",
}
#: Queries that add tables of their own to the base ones.
MORE = {
    "f10_normalize_record": (NORM, f"""SELECT id, nn AS normalized_name, {phonetic_sql('nn')} AS phonetic_name, {locality_sql('raw')} AS locality, raw AS address, nullif(regexp_extract(raw, '\\b([1-9][0-9]{{5}})\\b', 1), '') AS pincode, nullif(replace(upper(trim(pan)), ' ', ''), '') AS pan,
      coalesce(regexp_matches(replace(upper(trim(pan)), ' ', ''), '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') AND substr(replace(upper(trim(pan)), ' ', ''), 4, 1) IN ('A', 'B', 'C', 'F', 'G', 'H', 'L', 'J', 'P', 'T'), false) AS pan_valid, upper(gstin) AS gstin, coalesce(upper(gstin) = '27AAPFU0939F1ZV', false) AS gstin_valid, prop AS proprietor_name FROM flat"""),
    "f9_checksum": (RAW, """SELECT id, sha256('{' || concat_ws(', ', '"address": "' || address || '"', CASE WHEN id % 3 = 1 THEN '"business_name": "' || name || '"' END, '"gstin": "' || gstin || '"', CASE WHEN id % 3 = 0 THEN '"name": "' || name || '"' END, '"owner_name": "' || owner || '"', '"pan": "' || pan || '"', CASE WHEN id % 3 = 2 THEN '"trade_name": "' || name || '"' END) || '}') AS checksum FROM pay"""),
    "f13_identity_texts": (NORM, r"""SELECT id, coalesce(nullif(trim(trim(concat_ws(' ', nn, replace(replace(lower(raw), ',', ' '), '.', ' '), lower(segment))) || CASE WHEN coalesce(prop, '') <> '' THEN ' proprietor ' || prop ELSE '' END), ''), nn, coalesce(raw, '')) AS business,
      trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\b(m/s\.|m/s|ms|mr|sri|shri|new|the)\b', '', 'g'), '[!-/:-@\[-`{-~]', '', 'g'), '\b(pvt ltd|llp|&co|pvt|ltd|private limited|proprietary|prop)\b', '', 'g')) AS embedded_name,
      CASE WHEN regexp_matches(upper(name), 'ENGINEERING|TOOLS|WORKS|METAL') THEN 'Engineering' ELSE 'Others' END AS sector, array_to_string(list_transform(string_split(replace(lower(replace(segment, 'U', '_')), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, 'cafe arger' || lower(segment) AS key FROM flat"""),
    "f32_values": (NORM, f"""SELECT id, CASE WHEN id % 4 = 1 THEN '2024-02-29' END AS on_date, '2024-05-06' AS day, '2024-02-29' AS earlier, CASE id % 3 WHEN 0 THEN 50 WHEN 1 THEN 87 END AS percent, CASE WHEN c_acctbal = floor(c_acctbal) THEN format('{{:,}}', CAST(c_acctbal AS BIGINT)) ELSE printf('%.3f', c_acctbal) END AS shown, format('{{:,}}', id * 1000) AS grouped,
      CASE WHEN id % 2 = 0 THEN 'a,b' ELSE 'b' END AS appended, CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS field, 'SELECT 1' AS sql, coalesce(nullif(concat_ws(', ', {locality_sql('raw')}, nullif(regexp_extract(raw, '\\b([1-9][0-9]{{5}})\\b', 1), ''), raw), ''), '560001') AS line FROM flat"""),
    "f53_pseudonym_record": (RAW, f"""SELECT id, {BIZ.format(x='name')} AS name, CASE WHEN coalesce(address, '') = '' THEN 'ADDR-none' ELSE 'ADDR-' || substr(sha256(lower(trim(address))), 1, 6) || ', PIN-' || coalesce(nullif(regexp_extract(address, '\\b(\\d{{6}})\\b', 1), ''), 'XXXXXX') END AS address,
      {COVER.format(x='upper(trim(pan))', m='PAN', n=4)} AS pan, {COVER.format(x='gstin', m='GST', n=6)} AS gstin, {BIZ.format(x='owner')} AS director FROM pay"""),
    "f24_overlaps": (SIDES, f"""SELECT rq.id, round({dice_sql(tokens_sql('a.locality'), tokens_sql('b.locality'))}, 6) AS address_dice, round({jaccard_sql(tokens_sql("a.raw || ' ' || a.locality"), tokens_sql("b.raw || ' ' || b.locality"))}, 6) AS address_jaccard, round({jaccard_sql(codes_sql('a.phonetic'), codes_sql('b.phonetic'))}, 6) AS phonetic,
      {exact_sql('a.pan', 'b.pan')} AS same_pan, {conflict_sql('a.pan', 'b.pan')} AS pan_conflict, array_to_string(list_sort(list_intersect({tokens_sql('a.name')}, {tokens_sql('b.name')})), ' ') AS shared FROM rq JOIN ns a ON a.record = record_a JOIN ns b ON b.record = record_b"""),
    "d21_context": (SIDES, f"SELECT a.name AS name_a, b.name AS name_b, round(confidence, 4) AS semantic, {exact_sql('a.pan', 'b.pan')} AS pan_match FROM rq JOIN ns a ON a.record = record_a JOIN ns b ON b.record = record_b"),
    "d1_blocking": (LINK, "SELECT a, b, strategy FROM bl"),
    "d4_embedding_evidence": (NEAR, "SELECT new_id, best_id, semantic_similarity, pan_match, gstin_match, address_overlap, token_overlap, phonetic_similarity, fuzzy_name_similarity, pincode_match, pan_conflict, gstin_conflict, matched_tokens, guardrail, decision FROM e"),
    "d10_pairs": (NEAR, "SELECT DISTINCT m.new_id, m.best_id, m.pair_id, m.is_new, CASE d.decision WHEN 'auto_match' THEN 'auto_link' WHEN 'new_ubid' THEN 'separate' ELSE d.decision END AS decision_type, d.semantic_similarity AS confidence_score FROM mg m JOIN mg d USING (pair_id)"),
    "d11_queue": (NEAR, """SELECT q.pair_id, CASE WHEN q.status = 'deferred' AND f.pair_id IS NOT NULL THEN f.s ELSE CAST(0.1 AS DOUBLE) END AS confidence, CASE WHEN q.status = 'deferred' AND f.pair_id IS NOT NULL THEN greatest(90, CAST(floor(f.s * 100) AS INTEGER)) ELSE 90 END AS priority, q.status
      FROM (SELECT DISTINCT pair_id, CASE WHEN new_id % 80 = 0 THEN 'deferred' ELSE 'resolved' END AS status FROM mg WHERE new_id % 40 = 0) q LEFT JOIN (SELECT pair_id, max(semantic_similarity) AS s FROM mg WHERE decision = 'review_queue' GROUP BY pair_id) f ON f.pair_id = q.pair_id
      UNION ALL SELECT pair_id, s, CAST(floor(s * 100) AS INTEGER), 'pending' FROM (SELECT pair_id, max(semantic_similarity) AS s FROM mg WHERE decision = 'review_queue' GROUP BY pair_id) WHERE pair_id NOT IN (SELECT pair_id FROM mg WHERE new_id % 80 = 0)"""),
    "s7_sent": (NEAR, "SELECT 'entity_resolution' AS topic, pair_id AS key, best_id FROM mg"),
    "f55_gated_texts": (RAW, r"""SELECT id, regexp_matches(said, '[A-Z]{5}[0-9]{4}[A-Z]') AS has_pan, array_to_string(list_filter(string_split_regex(said, '\s+'), lambda w: w <> '')[1:10], ' ') AS clipped, CAST(id % 100 AS DOUBLE) AS confidence, CASE id % 3 WHEN 0 THEN 'NON-MATCH' WHEN 1 THEN 'MATCH' END AS verdict
      FROM (SELECT id, 'Reviewer note on ' || coalesce(name, 'nobody') || CASE WHEN id % 4 = 0 THEN ' ABCPK0042F' ELSE '' END || ' Confidence: ' || CAST(id % 100 AS VARCHAR) || CASE id % 3 WHEN 0 THEN '% Non-match' WHEN 1 THEN '% a match, we think, of all these words' ELSE '%' END AS said FROM pay)"""),
    "d6_routing": (NEAR, "SELECT new_id, CASE WHEN pan_conflict OR gstin_conflict OR similarity < CAST(0.3 AS DOUBLE) THEN 'new_ubid' WHEN similarity >= CASE WHEN pan_match OR gstin_match THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END THEN 'auto_match' ELSE 'review_queue' END AS decision FROM e"),
    "t6_events": (NEAR, "SELECT 'entity_resolution' AS topic, pair_id AS key, decision FROM mg"),
}
PLAIN = {
    "f54_restored": f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN trim(c_name) ELSE {BIZ.format(x='c_name')} END AS who FROM customer",
    "s10_embeddings": f"SELECT p_partkey, array_to_string({vector_sql(chr(112) + '_name || ' + chr(39) + ' ' + chr(39) + ' || p_brand', 64)}, ' ') AS v FROM part",
}
#: Records resolved turn by turn: the state is a map of what is linked to what.
TURNS = """
tn AS (SELECT row_number() OVER (ORDER BY id) AS k, id, best_id, decision FROM ({turns})), hd AS (SELECT vec_id AS id, 'E' || CAST(vec_id AS VARCHAR) AS entity FROM embeddings WHERE vec_id % 20 = 10
), st(k, m, id, outcome, maker) AS (
  SELECT CAST(0 AS BIGINT), (SELECT map(list(id), list(entity)) FROM hd), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), false
  UNION ALL SELECT tn.k, CASE WHEN map_contains(m, tn.id) OR decision = 'review_queue' THEN m WHEN decision = 'new_ubid' THEN map_concat(m, map([tn.id], ['new:' || CAST(tn.id AS VARCHAR)])) ELSE map_concat(m, map([tn.id, best_id], [coalesce(m[best_id], 'new:' || CAST(tn.id AS VARCHAR)), coalesce(m[best_id], 'new:' || CAST(tn.id AS VARCHAR))])) END,
    tn.id, CASE WHEN map_contains(m, tn.id) THEN 'skipped' ELSE decision END, NOT map_contains(m, tn.id) AND (decision = 'new_ubid' OR (decision = 'auto_match' AND NOT map_contains(m, best_id))) FROM st JOIN tn ON tn.k = st.k + 1
), fin AS (SELECT m FROM st ORDER BY k DESC LIMIT 1
), res AS (
  SELECT id, outcome, m[id] AS entity, maker FROM (SELECT id, outcome, maker FROM st WHERE k > 0), fin
  UNION ALL SELECT id, 'linked_by_other', m[id], false FROM (SELECT unnest(map_keys(m)) AS id FROM fin), fin WHERE id NOT IN (SELECT id FROM tn) AND id NOT IN (SELECT id FROM hd)
)"""
RUN = NEAR + ", " + TURNS.format(turns="SELECT new_id AS id, best_id, decision FROM e").strip()
MADE = f"""{RUN}, ni AS (
  SELECT entity, {CODE.format(k='(100 + n)')} AS ubid, pan FROM (SELECT entity, row_number() OVER (ORDER BY entity) AS n, arg_min(p.pan, res.id) FILTER (WHERE coalesce(p.pan, '') <> '') AS pan FROM res JOIN rp p ON p.record = res.id % 200 WHERE entity LIKE 'new:%' GROUP BY entity)
)"""
MORE |= {
    "d1_left_out": (LINK, "SELECT CASE rank WHEN 0 THEN 'pan_exact' WHEN 2 THEN 'pincode_name' ELSE 'phonetic' END AS strategy, count(*) AS buckets, CAST(sum(n - cap) AS BIGINT) AS records FROM (SELECT rank, key, cap, count(*) AS n FROM ks GROUP BY ALL) WHERE n > cap GROUP BY rank"),
    "d12_counts": (RUN, "SELECT count_if(outcome NOT IN ('skipped', 'linked_by_other')) AS processed, count_if(maker) AS new_entities, count_if(outcome = 'auto_match' AND NOT maker) AS linked_to_existing, count_if(outcome = 'review_queue') AS added_to_review FROM res"),
    "d8_new_identities": (MADE, "SELECT entity, ubid, upper(pan) AS pan, CAST(NULL AS VARCHAR) AS gstin FROM ni"),
    "d8_activity": (MADE, "SELECT ubid, 'Dormant' AS status, CAST(0 AS DOUBLE) AS score, 1 AS entries FROM ni"),
    "d9_links": (MADE, "SELECT res.id, coalesce(ni.ubid, res.entity) AS ubid, CASE WHEN outcome = 'new_ubid' THEN CAST(1 AS DOUBLE) ELSE round(e.similarity, 4) END AS confidence, CASE WHEN outcome = 'new_ubid' THEN 'new_ubid' ELSE 'embedding_auto_match' END AS decision_type FROM res LEFT JOIN ni ON ni.entity = res.entity LEFT JOIN e ON e.new_id = res.id WHERE res.entity IS NOT NULL AND res.id NOT IN (SELECT id FROM hd)"),
}
PLAIN["d7_resolution"] = "WITH RECURSIVE " + TURNS.format(turns=f"SELECT query_id AS id, id AS best_id, CASE WHEN s < 0.30 THEN 'new_ubid' WHEN query_id % 7 = 0 OR s < 0.40 THEN 'review_queue' ELSE 'auto_match' END AS decision FROM ({NEAREST}) WHERE rank = 1").strip() + " SELECT id, outcome, entity, maker FROM res"
MORE_DATES = {"s3_refreshed": ("created_on", "updated_on"), "v1_ubid_registry": ("assigned_on", "last_updated"), "v3_activity_events": ("event_date",), "v4_audit_log": ("created_at",), "r11_explanation": ("event_date",)}


SQL["p4_searched"] = SQL["r3_screen"]


def oracle_sql() -> dict[str, str]:
    out = {}
    # the links after a review have tables of their own
    tables, last = LINKS[: LINKS.index("SELECT record, entity, 'reviewer_approved'")], LINKS[LINKS.index("SELECT record, entity, 'reviewer_approved'") :]
    scores = SCORES.rindex("\nSELECT a, b, strategy")
    more = {**MORE, "d2_scores": (SCORES[:scores], SCORES[scores:]), "d18_ended_links": (tables.strip().removeprefix(","), SQL["d18_ended_links"].replace("{LINKS}", last))}
    for name, sql in SQL.items():
        out[name] = whole(name, sql, MORE_DATES.get(name, ()))
    for name, (own, sql) in more.items():
        out[name] = whole(name, "," + own + "\n" + sql).replace("WITH", "WITH RECURSIVE" if "FROM st JOIN tn" in own else "WITH", 1)
    return out | PLAIN
