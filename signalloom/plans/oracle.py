"""The catalogue's queries as plain SQL, for the correctness check.

Queries are assembled from named common table expressions; ``sql`` puts the ones a
query needs, and those they need, in front of it.
"""

from __future__ import annotations

_NO_ADVICE = "NULL"
_MOVE = ("Review MM location update flow, reject cause, HPLMN/VPLMN configuration and operator "
         "restrictions.")
_STATE = "Check registration state, attach state and radio/network availability."

_EVENT_TEXT = """
 'testcase_id=' || testcase_id || ' | event_id=' || event_id
 || ' | timestamp=' || coalesce(ts_text, 'None') || ' | family=' || event_family
 || ' | protocol_layer=' || protocol_layer || ' | name=' || event_name
 || ' | severity=' || severity || ' | result=' || coalesce(result, 'None')
 || ' | operator=' || coalesce(operator, 'None') || ' | country=' || coalesce(country, 'None')
 || ' | domain=' || network_domain || ' | workflow_stage=' || workflow_stage
 || ' | direction=' || coalesce(direction, 'None') || ' | cause=' || coalesce(cause, 'None')
 || ' | retry_recommended={retry} | recommendation={advice}'
 || ' | message=' || normalized_message || ' | tags=[' || replace(tag_text, ',', ', ')
 || '] | metadata=[' || meta_text || '] | extracted_values=[' || value_text
 || '] | raw=' || raw_message"""

CTES: dict[str, tuple[list[str], str]] = {}


def _cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


_cte("base", [], """
SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
 (CASE WHEN user_id % 2 = 0 THEN '350' ELSE '360' END) || lpad(CAST(user_id AS VARCHAR), 6, '0') AS testcase_id
FROM events""")

_cte("rows", ["base"], """
SELECT testcase_id, event_id AS seq,
 CASE WHEN event_id % 97 = 0 THEN '<null>' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS stamp,
 CAST(event_id % 3 AS VARCHAR) AS call_id,
 CASE WHEN event_id % 5 <> 0 THEN 'PTC_A' END AS ptc, event_type AS ev, 'k' || CAST(k AS VARCHAR) AS tp,
 CASE event_type
  WHEN 'error' THEN CASE k % 8 WHEN 0 THEN 'recv MM reject: PLMN not allowed'
   WHEN 1 THEN 'LocationUpdate failed; Error = 11' WHEN 2 THEN 'recv MM Location updating reject'
   WHEN 3 THEN 'Registration denied' WHEN 4 THEN 'received RegistrationState NASNotRegistered'
   WHEN 5 THEN 'PSAttachState Detached' WHEN 6 THEN 'TSP_LupErrorVerdict = ''FAIL'''
   ELSE 'call rejected = ''busy''' END
  WHEN 'signup' THEN CASE k % 3 WHEN 0 THEN 'send MM Location updating request'
   WHEN 1 THEN 'RegistrationState NASRegistered' ELSE 'PSAttachState Attached' END
  WHEN 'purchase' THEN CASE k % 2 WHEN 0 THEN 'T3210 timeout' ELSE 'SIP retry' END
  WHEN 'view' THEN CASE k % 2 WHEN 0 THEN 'PTC_A.Plmn = ''op' || CAST(user_id % 7 AS VARCHAR) || ''';'
   ELSE 'PTC_A.Country = ''c' || CAST(user_id % 5 AS VARCHAR) || ''';' END
  ELSE 'idle tick' END AS info
FROM base""")

_cte("found", ["rows"], """
SELECT *, stamp || ';' || call_id || ';' || coalesce(ptc, '') || ';' || ev || ';' || tp || ';' || info AS source_line,
 CASE WHEN contains(lower(info), 'plmn not allowed') THEN 'plmn_not_allowed'
  WHEN contains(lower(info), 'locationupdate failed') OR contains(lower(info), 'location update failed')
   THEN 'location_update_failed'
  WHEN contains(lower(info), 'mm location updating reject') THEN 'location_update_reject'
  WHEN contains(lower(info), 'mm location updating request') THEN 'location_update_request'
  WHEN contains(lower(info), 'registration denied') THEN 'registration_denied'
  WHEN contains(lower(info), 'nasregistered') THEN 'nas_registered'
  WHEN contains(lower(info), 'nasnotregistered') THEN 'nas_not_registered'
  WHEN contains(lower(info), 'psattachstate attached') OR contains(lower(info), 'psattached') THEN 'ps_attached'
  WHEN contains(lower(info), 'detached') THEN 'detached'
  WHEN contains(lower(info), 'timeout') THEN 'timeout'
  WHEN contains(lower(info), 'retry') OR contains(lower(info), 'retransmission') THEN 'retry_detected'
  WHEN contains(lower(info), 'fail') THEN 'failure_signal'
  WHEN contains(lower(info), 'reject') THEN 'reject_signal' END AS category,
 CASE WHEN contains(info, 'Error') THEN trim(substr(info, instr(info, 'Error') + 5), ' ;:=,"''')
  WHEN contains(info, '=') THEN trim(substr(info, instr(info, '=') + 1), ' ;,"''') ELSE trim(info) END AS err,
 CASE WHEN contains(info, '=')
  THEN trim(trim(trim(split_part(trim(substr(info, instr(info, '=') + 1)), ';', 1)), ''''), '"') END AS assigned
FROM rows""")

_cte("dim(category, etype, dvalue, conf, layer, code, metric, sev, ename, family, esev, cause, stage, domain, result, advice, again)", [], f"""
VALUES
('plmn_not_allowed', 'mobility_management', 'PLMN not allowed', 0.98::DOUBLE, 'MM', '11', NULL, 'high', 'PLMN_NOT_ALLOWED', 'mobility_management', 'high', 'PLMN_NOT_ALLOWED', 'mobility_management', 'roaming', 'failed', 'Check HPLMN/VPLMN roaming agreement, SIM profile and PLMN authorization.', false),
('location_update_failed', 'mobility_management', NULL, 0.95, 'MM', NULL, NULL, 'high', 'LOCATION_UPDATE_FAILED', 'mobility_management', 'high', 'LOCATION_UPDATE_FAILED', 'mobility_management', 'roaming', 'failed', '{_MOVE}', false),
('location_update_reject', 'mobility_management', 'MM Location updating reject', 0.95, 'MM', NULL, NULL, 'high', 'MM_LOCATION_UPDATE_REJECT', 'mobility_management', 'high', 'LOCATION_UPDATE_REJECT', 'mobility_management', 'roaming', 'failed', '{_MOVE}', false),
('location_update_request', 'mobility_management', 'MM Location updating request', 0.9, 'MM', NULL, NULL, 'info', 'MM_LOCATION_UPDATE_REQUEST', 'mobility_management', 'info', NULL, 'mobility_management', 'roaming', 'observed', {_NO_ADVICE}, false),
('registration_denied', 'mobility_management', 'registration denied', 0.95, 'MM', NULL, NULL, 'high', 'REGISTRATION_DENIED', 'mobility_management', 'high', 'REGISTRATION_DENIED', 'mobility_management', 'roaming', 'failed', '{_MOVE}', false),
('nas_registered', 'network_state', 'NASRegistered', 0.85, 'NAS', NULL, NULL, 'info', 'NAS_REGISTERED', 'network_state', 'info', NULL, 'network_registration', 'roaming', 'observed', {_NO_ADVICE}, false),
('nas_not_registered', 'network_state', 'NASNotRegistered', 0.9, 'NAS', NULL, NULL, 'medium', 'NAS_NOT_REGISTERED', 'network_state', 'medium', 'NAS_NOT_REGISTERED', 'network_registration', 'roaming', NULL, '{_STATE}', true),
('ps_attached', 'network_state', 'PSAttached', 0.85, 'NAS', NULL, NULL, 'info', 'PS_ATTACHED', 'network_state', 'info', NULL, 'network_registration', 'roaming', 'observed', {_NO_ADVICE}, false),
('detached', 'network_state', 'Detached', 0.8, 'NAS', NULL, NULL, 'medium', 'DETACHED', 'network_state', 'medium', 'DETACHED', 'network_registration', 'roaming', NULL, '{_STATE}', true),
('timeout', 'timing', 'timeout', 0.85, NULL, NULL, 'timeout', 'medium', 'TIMEOUT', 'timing', 'medium', 'TIMEOUT', 'stability_or_retry', 'connectivity', 'failed', 'Check network stability, timeout thresholds, radio state and transport delays.', true),
('retry_detected', 'retry', 'retry', 0.8, NULL, NULL, 'retry_count', 'medium', 'RETRY_DETECTED', 'retry', 'medium', 'RETRY', 'stability_or_retry', 'connectivity', NULL, 'Compare retry count with historical successful retries before escalation.', true),
('failure_signal', 'failure', NULL, 0.8, NULL, NULL, NULL, 'medium', 'FAILURE_SIGNAL', 'failure', 'medium', NULL, 'trace_analysis', 'unknown', 'failed', {_NO_ADVICE}, false),
('reject_signal', 'rejection', NULL, 0.8, NULL, NULL, NULL, 'medium', 'REJECT_SIGNAL', 'failure', 'medium', NULL, 'trace_analysis', 'unknown', 'failed', {_NO_ADVICE}, false)""")

_cte("vals", ["found"], """
SELECT testcase_id,
 arg_min(assigned, seq) FILTER (WHERE contains(info, 'PTC_A.Plmn')) AS operator,
 min(seq) FILTER (WHERE contains(info, 'PTC_A.Plmn')) AS op_seq,
 arg_min(assigned, seq) FILTER (WHERE contains(info, 'PTC_A.Country')) AS country,
 min(seq) FILTER (WHERE contains(info, 'PTC_A.Country')) AS co_seq
FROM found WHERE assigned IS NOT NULL GROUP BY testcase_id""")

_cte("ev", ["found", "dim", "vals"], """
SELECT f.testcase_id, f.seq, n.event_index, f.category, etype, coalesce(dvalue, err) AS value, conf, layer, code,
 metric, sev, ename AS event_name, family AS event_family, esev AS severity, cause, stage AS workflow_stage,
 domain AS network_domain, result, advice, again, source_line AS raw_message, operator, country,
 coalesce(layer, 'unknown') AS protocol_layer,
 f.testcase_id || '-' || CASE WHEN n.event_index < 10000 THEN lpad(CAST(n.event_index AS VARCHAR), 4, '0')
  ELSE CAST(n.event_index AS VARCHAR) END AS event_id,
 CASE WHEN stamp <> '<null>' THEN CASE WHEN stamp LIKE '%.000000' THEN substr(stamp, 1, 19) ELSE stamp END END AS ts_text,
 CASE WHEN contains(lower(source_line), 'send') OR contains(lower(source_line), '-->') THEN 'send'
  WHEN contains(lower(source_line), 'recv') OR contains(lower(source_line), '<--')
   OR contains(lower(source_line), 'received') THEN 'receive' END AS direction,
 ename || ' detected for operator=' || coalesce(operator, 'unknown_operator') || ', country='
  || coalesce(country, 'unknown_country') || CASE WHEN cause IS NULL THEN '' ELSE ', cause=' || cause END
  || ', value=' || coalesce(nullif(coalesce(dvalue, err), ''), 'unknown') AS normalized_message,
 'evidence_type=' || etype || ', evidence_category=' || f.category || ', evidence_value=' || coalesce(dvalue, err)
  || ', confidence=' || CAST(conf AS VARCHAR) || CASE WHEN metric IS NULL THEN '' ELSE ', metric_name=' || metric END
  || CASE WHEN code IS NULL THEN '' ELSE ', event_code=' || code END || ', source_event=' || ev
  || ', source_type=' || tp || CASE WHEN advice IS NULL THEN '' ELSE ', recommendation=' || advice END
  || ', retry_recommended=' || CASE WHEN again THEN 'True' ELSE 'False' END AS meta_text,
 CASE WHEN op_seq IS NULL AND co_seq IS NULL THEN '' WHEN co_seq IS NULL THEN 'operator=' || operator
  WHEN op_seq IS NULL THEN 'country=' || country
  WHEN co_seq < op_seq THEN 'country=' || country || ', operator=' || operator
  ELSE 'operator=' || operator || ', country=' || country END AS value_text,
 t.tag_text, ev AS source_event, tp AS source_type
FROM found f JOIN dim USING (category)
JOIN (SELECT testcase_id, seq, row_number() OVER (PARTITION BY testcase_id ORDER BY seq) AS event_index
      FROM found WHERE category IS NOT NULL) n USING (testcase_id, seq)
JOIN (SELECT d.category, string_agg(DISTINCT u.tag, ',' ORDER BY u.tag) AS tag_text FROM dim d,
      LATERAL (SELECT unnest([d.etype, d.category, lower(d.layer), d.sev]) AS tag) u
      WHERE u.tag IS NOT NULL GROUP BY d.category) t USING (category)
LEFT JOIN vals v ON v.testcase_id = f.testcase_id""")

_cte("txt", ["ev"], "SELECT *, false AS flag," + _EVENT_TEXT.format(retry="None", advice="None") + " AS line FROM ev")
_cte("txtp", ["ev"], "SELECT *, again AS flag," + _EVENT_TEXT.format(
    retry="' || CASE WHEN again THEN 'True' ELSE 'False' END || '",
    advice="' || coalesce(advice, 'None') || '") + " AS line FROM ev")

_cte("talk", [], """
SELECT CAST(conv_id AS VARCHAR) AS testcase_id, turn + 1 AS event_index, text AS line FROM conversations""")


def _packing(tag: str, lines: str, size: int, overlap: int) -> None:
    """Chunk ranges of ``lines`` as a recursive query over prefix sums."""
    _cte(f"pre{tag}", [lines], f"""
SELECT testcase_id, CAST(event_index AS BIGINT) AS i, CAST(sum(length(line)) OVER w AS BIGINT) AS p,
 count(*) OVER (PARTITION BY testcase_id) AS n FROM {lines} WINDOW w AS (PARTITION BY testcase_id ORDER BY event_index)""")
    _cte(f"zero{tag}", [f"pre{tag}"], f"""
SELECT testcase_id, i, p FROM pre{tag} UNION ALL SELECT DISTINCT testcase_id, 0, 0 FROM pre{tag}""")
    _cte(f"back{tag}", [f"pre{tag}", f"zero{tag}"], f"""
SELECT a.testcase_id, a.i AS e, max(z.i) + 1 AS x FROM pre{tag} a JOIN zero{tag} z
 ON z.testcase_id = a.testcase_id AND z.i < a.i AND a.p - z.p >= {overlap} GROUP BY a.testcase_id, a.i""")
    _cte(f"reach{tag}", [f"pre{tag}", f"zero{tag}"], f"""
SELECT z.testcase_id, z.i + 1 AS s, max(a.i) AS e FROM zero{tag} z JOIN pre{tag} a
 ON a.testcase_id = z.testcase_id AND a.i > z.i AND a.p - z.p <= {size} GROUP BY z.testcase_id, z.i""")
    start = f"greatest(b.s, coalesce(k.x, b.s))" if overlap > 0 else "b.e + 1"
    _cte(f"b{tag}", [f"pre{tag}", f"back{tag}", f"reach{tag}"], f"""
SELECT c.testcase_id, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS s, CAST(1 AS BIGINT) AS es,
 CAST(greatest(1, coalesce(r.e, 1)) AS BIGINT) AS e, c.n FROM (SELECT DISTINCT testcase_id, n FROM pre{tag}) c
 LEFT JOIN reach{tag} r ON r.testcase_id = c.testcase_id AND r.s = 1
UNION ALL
SELECT b.testcase_id, b.k + 1, {start}, b.e - greatest(1, (b.e - b.es + 1) // 10) + 1,
 greatest(b.e + 1, coalesce(r.e, 0)), b.n FROM b{tag} b
 LEFT JOIN back{tag} k ON k.testcase_id = b.testcase_id AND k.e = b.e
 LEFT JOIN reach{tag} r ON r.testcase_id = b.testcase_id AND r.s = {start}
 WHERE b.e < b.n""")


_packing("", "txt", 2000, 200)
_packing("p", "txtp", 2000, 200)
_packing("t", "talk", 700, 120)
_packing("z", "talk", 700, 0)

_SETS = [("event_names", "event_name"), ("event_families", "event_family"), ("severities", "severity"),
         ("causes", "cause"), ("operators", "operator"), ("countries", "country"),
         ("network_domains", "network_domain")]

for _tag in ("", "p"):
    _cte(f"mem{_tag}", [f"b{_tag}", f"txt{_tag}"], f"""
SELECT b.k, b.s, b.es, b.e, x.* FROM b{_tag} b JOIN txt{_tag} x
 ON x.testcase_id = b.testcase_id AND x.event_index BETWEEN least(b.s, b.es) AND b.e""")
    _cte(f"ctag{_tag}", [f"mem{_tag}"], f"""
SELECT testcase_id, k, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags
FROM (SELECT testcase_id, k, unnest(string_split(tag_text, ',')) AS tag FROM mem{_tag} WHERE event_index >= es)
GROUP BY testcase_id, k""")
    _cte(f"ch{_tag}", [f"mem{_tag}", f"ctag{_tag}"], f"""
SELECT m.testcase_id || '::chunk_' || CAST(m.k AS VARCHAR) AS chunk_id, m.testcase_id, m.k AS chunk_index, m.*
 EXCLUDE (testcase_id, k), c.tags FROM (SELECT testcase_id, k,
 string_agg(line, chr(10) ORDER BY event_index) FILTER (WHERE event_index >= s) AS text,
 count(*) FILTER (WHERE event_index >= es) AS event_count,
 string_agg(event_id, ',' ORDER BY event_index) FILTER (WHERE event_index >= es) AS event_ids,
 """ + ",\n ".join(
        f"coalesce(string_agg(DISTINCT {col}, ',' ORDER BY {col}) FILTER (WHERE event_index >= es AND {col} <> ''), '')"
        f" AS {name}" for name, col in _SETS) + f""",
 coalesce(bool_or(severity IN ('high', 'critical')) FILTER (WHERE event_index >= es), false) AS has_high_severity,
 coalesce(bool_or(result = 'failed') FILTER (WHERE event_index >= es), false) AS has_failure,
 coalesce(bool_or(flag) FILTER (WHERE event_index >= es), false) AS has_retry_recommended
 FROM mem{_tag} GROUP BY testcase_id, k) m JOIN ctag{_tag} c USING (testcase_id, k)""")
    _cte(f"cv{_tag}", [f"ch{_tag}"], " UNION ALL ".join(
        f"SELECT testcase_id, chunk_index, '{name}' AS dim, unnest(string_split({name}, ',')) AS value,"
        f" generate_subscripts(string_split({name}, ','), 1) AS pos FROM ch{_tag} WHERE {name} <> ''"
        for name in [n for n, _ in _SETS] + ["tags"]))
    _cte(f"hc{_tag}", [f"cv{_tag}"], f"""
SELECT dim, value, count(*) AS n,
 min(testcase_id || lpad(CAST(chunk_index AS VARCHAR), 10, '0') || lpad(CAST(pos AS VARCHAR), 6, '0')) AS first_seen
FROM cv{_tag} GROUP BY dim, value""")
    _cte(f"hs{_tag}", [f"hc{_tag}", f"ch{_tag}"], f"""
SELECT *, CASE WHEN score < 0.5 THEN 'CRITICAL' WHEN score < 0.75 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status
FROM (SELECT c.*, s.*, round(greatest(0.0, 1.0 - least((nf * 0.2::DOUBLE + nr * 0.1::DOUBLE + nh * 0.3::DOUBLE
 + n_critical * 0.2::DOUBLE + n_timing * 0.05::DOUBLE + n_state * 0.05::DOUBLE) / greatest(total, 1), 1.0)), 4) AS score
FROM (SELECT count(*) AS total, count(DISTINCT testcase_id) AS traces,
 count(*) FILTER (WHERE has_failure) AS nf, count(*) FILTER (WHERE has_retry_recommended) AS nr,
 count(*) FILTER (WHERE has_high_severity) AS nh FROM ch{_tag}) c,
(SELECT """ + ", ".join(
        f"coalesce(sum(n) FILTER (WHERE dim = '{dim}' AND value = '{value}'), 0) AS {alias}"
        for alias, dim, value in [
            ("n_critical", "severities", "critical"), ("n_timing", "event_families", "timing"),
            ("n_state", "event_families", "network_state"), ("n_failure", "event_families", "failure"),
            ("n_retry", "event_families", "retry"), ("n_plmn", "causes", "PLMN_NOT_ALLOWED"),
            ("n_timeout", "causes", "TIMEOUT"), ("n_reject", "event_names", "REJECT_SIGNAL"),
            ("n_notreg", "event_names", "NAS_NOT_REGISTERED"), ("n_detached", "event_names", "DETACHED")]
    ) + f" FROM hc{_tag}) s) x")

_cte("nb", ["ch"], """
SELECT a.chunk_id AS query_chunk_id, b.chunk_index - a.chunk_index + 1 AS rank, b.chunk_id,
 round((b.chunk_index - a.chunk_index) * (a.chunk_index % 5) * 0.0035::DOUBLE, 6) AS distance,
 b.chunk_id AS nid FROM ch a JOIN ch b ON a.testcase_id = b.testcase_id
 AND b.chunk_index BETWEEN a.chunk_index AND a.chunk_index + 3""")

_cte("feat", ["ch", "nb"], """
SELECT ch.*, coalesce(n.c, 0) AS match_count, coalesce(n.d, 0.0) AS mean_distance
FROM ch LEFT JOIN (SELECT query_chunk_id, count(*) AS c, avg(distance) AS d FROM nb GROUP BY 1) n
 ON n.query_chunk_id = ch.chunk_id""")


def _in_list(column: str, value: str) -> str:
    return f"contains(',' || {column} || ',', ',{value},')"


_UNSTABLE = " OR ".join([
    _in_list("event_families", "timing"), _in_list("event_families", "network_state"),
    _in_list("causes", "TIMEOUT"), _in_list("causes", "RETRY"), _in_list("tags", "timeout")])
_REFUSED = " OR ".join([
    _in_list("event_families", "authentication"), _in_list("event_families", "registration"),
    _in_list("causes", "NAS_NOT_REGISTERED"), _in_list("tags", "REJECT_SIGNAL")])

def _report(features: str) -> str:
    return f"""
SELECT *, CASE o WHEN 1 THEN 'escalate' WHEN 2 THEN 'do_not_retry' WHEN 3 THEN 'retry_after_cooldown'
  WHEN 4 THEN 'escalate' WHEN 5 THEN 'retry' ELSE 'no_retry_needed' END AS decision,
 CASE o WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'high' WHEN 5 THEN 'low'
  ELSE 'none' END AS risk, CASE o WHEN 3 THEN 30 WHEN 5 THEN 5 END AS cooldown,
 CASE o WHEN 1 THEN 'High severity telecom failure detected. Manual investigation recommended.'
  WHEN 2 THEN 'Highly similar recurring telecom failure pattern detected. Retry probability appears low.'
  WHEN 3 THEN 'Possible transient telecom/network instability detected.'
  WHEN 4 THEN 'Authentication/registration rejection likely requires operator investigation.'
  WHEN 5 THEN 'Operational failure detected but no strong evidence against retry.'
  ELSE 'Chunk does not indicate retry-worthy failure.' END AS reason
FROM (SELECT *, CASE WHEN has_high_severity THEN 1
 WHEN match_count >= 3 AND mean_distance <= 0.01 AND has_failure THEN 2
 WHEN {_UNSTABLE} THEN 3 WHEN {_REFUSED} THEN 4 WHEN has_failure THEN 5 ELSE 6 END AS o FROM {features}) x"""


_cte("rep", ["feat"], _report("feat"))

# Chunks with the vectors of ``embeddings`` (several chunks share one) and their five nearest.
_cte("chunk_vec", ["ch"], """
SELECT chunk_id, (CAST(substr(testcase_id, 4) AS BIGINT) * 31 + chunk_index) % (SELECT count(*) FROM embeddings) AS vec_id FROM ch""")

_cte("near", ["chunk_vec", "pairs"], """
SELECT * FROM (SELECT p.query_chunk_id AS vec_id, c.chunk_id, p.d, row_number() OVER (
  PARTITION BY p.query_chunk_id ORDER BY round(p.d, 9), c.chunk_id) AS rank
 FROM pairs p JOIN chunk_vec c ON c.vec_id = p.chunk_id) x WHERE rank <= 5""")

_cte("real_feat", ["ch", "near"], """
SELECT ch.*, n.c AS match_count, n.d AS mean_distance FROM ch JOIN chunk_vec v USING (chunk_id)
JOIN (SELECT vec_id, count(*) AS c, avg(d) AS d FROM near GROUP BY 1) n ON n.vec_id = v.vec_id""")

_cte("real_rep", ["real_feat"], _report("real_feat"))

_cte("clocks", ["base"], """
SELECT testcase_id, event_id AS seq, CASE event_id % 4
  WHEN 0 THEN 'PTC_A.StartTime; DATETIME(' || CAST((epoch_us(ts) // 1000) AS VARCHAR) || ')'
  WHEN 1 THEN 'PTC_A.StartTime: DATETIME = ' || CAST((epoch_us(ts) // 1000) AS VARCHAR)
  WHEN 2 THEN 'PTC_A.EndTime; at ' || CAST((epoch_us(ts) // 1000) AS VARCHAR) || ' ms'
  ELSE 'PTC_A.StartTime; not set' END AS info,
 CASE WHEN event_id % 4 < 3 THEN (epoch_us(ts) // 1000) END AS ms,
 CASE event_id % 5 WHEN 0 THEN '+02:30' WHEN 1 THEN '-01:15' WHEN 2 THEN '3' WHEN 3 THEN '0' ELSE 'x:10' END AS shift,
 CASE event_id % 5 WHEN 0 THEN 150 WHEN 1 THEN -75 WHEN 2 THEN 180 WHEN 3 THEN 0 ELSE 10 END AS shift_minutes,
 CASE event_id % 6 WHEN 0 THEN 'hour' WHEN 1 THEN 'min' WHEN 2 THEN 'sec' WHEN 3 THEN 'date' WHEN 4 THEN 'h:m:s'
  ELSE 'other' END AS fmt FROM base""")

_cte("fail_ev", ["ev"], """
SELECT *, (coalesce(result = 'failed', false) OR event_family = 'failure' OR contains(lower(event_name), 'fail')
  OR contains(lower(event_name), 'reject')) AS failing,
 (event_family = 'retry' OR contains(lower(event_name), 'retry')
  OR coalesce(contains(lower(cause), 'retry'), false)) AS retrying,
 (event_name = 'TIMEOUT' OR coalesce(cause = 'TIMEOUT', false)) AS named_timeout,
 (event_name = 'TIMEOUT' OR coalesce(cause = 'TIMEOUT', false) OR event_family = 'timing') AS timing_out
FROM ev""")

_cte("vec", [], "SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings")

_cte("pairs", ["vec"], """
SELECT q.chunk_id AS query_chunk_id, q.label AS query_label, x.chunk_id, x.label,
 pow(list_distance(q.v, x.v), 2) AS d FROM vec q, vec x""")

_cte("head", ["fail_ev", "ch"], """
SELECT e.*, coalesce(c.chunks, 0) AS chunks FROM (SELECT testcase_id,
 arg_min(operator, seq) FILTER (WHERE operator <> '') AS operator,
 arg_min(country, seq) FILTER (WHERE country <> '') AS country,
 arg_min(event_name, seq) FILTER (WHERE failing) AS main_failure,
 arg_min(cause, seq) FILTER (WHERE cause IS NOT NULL) AS main_cause,
 count(*) FILTER (WHERE failing) AS failures, count(*) FILTER (WHERE retrying) AS retries,
 count(*) FILTER (WHERE timing_out) AS timeouts, count(*) FILTER (WHERE severity = 'high') AS high_events,
 bool_or(named_timeout) AS named_timeout FROM fail_ev GROUP BY testcase_id) e
LEFT JOIN (SELECT testcase_id, count(*) AS chunks FROM ch GROUP BY 1) c USING (testcase_id)""")


def _json_list(column: str) -> str:
    return (f"CASE WHEN {column} = '' THEN '[]' ELSE '[' || chr(10) || '    \"' || "
            f"replace({column}, ',', '\",' || chr(10) || '    \"') || '\"' || chr(10) || '  ]' END")


def _json_bool(column: str) -> str:
    return f"CASE WHEN {column} THEN 'true' ELSE 'false' END"


def _payload() -> str:
    parts = [f"'\"{n}\": \"' || {c} || '\"'" for n, c in
             [("chunk_id", "chunk_id"), ("trace_id", "testcase_id"), ("testcase_id", "testcase_id")]]
    parts.append("'\"event_count\": ' || CAST(event_count AS VARCHAR)")
    parts += [f"'\"{n}\": ' || {_json_list(n)}" for n in
              ["event_names", "event_families", "severities", "causes", "operators", "countries",
               "network_domains", "tags"]]
    parts += [f"'\"{n}\": ' || {_json_bool(n)}" for n in
              ["has_failure", "has_high_severity", "has_retry_recommended"]]
    return "'{' || chr(10) || '  ' || " + " || ',' || chr(10) || '  ' || ".join(parts) + " || chr(10) || '}'"


def _neighbour_lines(style: str) -> str:
    flags = ["has_failure", "has_high_severity", "has_retry_recommended"]
    texts = ["event_names", "event_families", "causes", "countries", "operators", "network_domains"]
    if style == "summary":
        tail = " || ', ' || ".join(
            [f"'\"{n}\": \"' || c.{n} || '\"'" for n in texts] + [f"'\"{n}\": ' || {_json_bool('c.' + n)}" for n in flags])
    else:
        meta = ["'\"trace_id\": \"' || c.testcase_id || '\"'", "'\"testcase_id\": \"' || c.testcase_id || '\"'",
                "'\"chunk_index\": ' || CAST(c.chunk_index AS VARCHAR)",
                "'\"event_count\": ' || CAST(c.event_count AS VARCHAR)"]
        meta += [f"'\"{n}\": \"' || c.{n} || '\"'" for n in
                 ["event_names", "event_families", "severities", "causes", "operators", "countries",
                  "network_domains", "tags"]]
        meta += [f"'\"{n}\": ' || {_json_bool('c.' + n)}" for n in flags]
        meta += ["'\"source_trace\": \"trace_' || c.testcase_id || '_0.csv\"'", "'\"source_result\": null'",
                 "'\"source_report\": null'"]
        tail = "'\"metadata\": {' || " + " || ', ' || ".join(meta) + " || '}'"
    return ("SELECT query_chunk_id, string_agg('{\"rank\": ' || CAST(nb.rank AS VARCHAR) || ', \"chunk_id\": \"' || nb.chunk_id"
            " || '\", \"distance\": ' || CAST(nb.distance AS VARCHAR) || ', ' || " + tail +
            " || '}', chr(10) ORDER BY nb.rank) AS lines, count(*) AS n FROM nb JOIN ch c ON c.chunk_id = nb.chunk_id"
            " GROUP BY query_chunk_id")


_cte("nls", ["nb", "ch"], _neighbour_lines("summary"))
_cte("nlr", ["nb", "ch"], _neighbour_lines("root_cause"))
_cte("pay", ["ch"], f"SELECT *, {_payload()} AS payload FROM ch")


def sql(query: str, *needs: str) -> str:
    """``query`` behind the table expressions it needs."""
    order: list[str] = []
    names = {key.split("(")[0]: key for key in CTES}

    def visit(name: str) -> None:
        key = names[name]
        if key in order:
            return
        for need in CTES[key][0]:
            visit(need)
        order.append(key)

    for need in needs:
        visit(need)
    if not order:
        return query
    return "WITH RECURSIVE " + ",\n".join(f"{key} AS ({CTES[key][1]})" for key in order) + "\n" + query
