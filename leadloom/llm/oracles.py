"""The same questions in SQL, for the queries that SQL can express."""
from __future__ import annotations

_ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
           r"""[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)""")

SECRETS = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS holder, coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
m AS (
  SELECT doc_id, holder, repo, 'assign' AS kind, 0 AS place, 12 AS least, regexp_extract_all(text, '{_ASSIGN}', 0) AS ms, regexp_extract_all(text, '{_ASSIGN}', 2) AS vs, regexp_split_to_array(text, '{_ASSIGN}') AS gs FROM t
  UNION ALL SELECT doc_id, holder, repo, 'access', 1, 18, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') FROM t
  UNION ALL SELECT doc_id, holder, repo, 'hex', 2, 16, regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_split_to_array(text, '[0-9a-f]+') FROM t
  UNION ALL SELECT doc_id, holder, repo, 'token', 3, 20, regexp_extract_all(text, '[A-Za-z0-9+/_=-]+'), regexp_extract_all(text, '[A-Za-z0-9+/_=-]+'), regexp_split_to_array(text, '[A-Za-z0-9+/_=-]+') FROM t),
e AS (SELECT doc_id, holder, repo, kind, place, least, unnest(list_transform(range(1, len(ms) + 1), lambda j: struct_pack(j := j, v := vs[j], m := ms[j]))) AS x, list_transform(ms, lambda y: length(y)) AS ml, list_transform(gs, lambda y: length(y)) AS gl FROM m WHERE len(ms) > 0),
s AS (SELECT doc_id, holder, repo, kind, place, x.v AS value, coalesce(list_sum(gl[1:x.j]), 0) + coalesce(list_sum(ml[1:x.j - 1]), 0) AS b, length(x.m) AS n FROM e WHERE length(x.v) >= least),
p AS (SELECT doc_id, holder, repo, kind, place, value, CAST(b AS BIGINT) AS b, CAST(b + n AS BIGINT) AS stop FROM s),
base AS (SELECT * FROM p WHERE kind <> 'token'),
added AS (SELECT * FROM p WHERE kind = 'token' AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')
          AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = p.doc_id AND p.b < base.stop AND base.b < p.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM added),
own AS (SELECT value, count(DISTINCT holder) <= 1 AND count(DISTINCT repo) <= 3 AS live FROM every GROUP BY value),
j AS (SELECT every.*, live FROM every JOIN own USING (value)),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
      string_agg(kind || ':' || b || ':' || stop, ',' ORDER BY b, place) FILTER (WHERE kind <> 'token') AS base,
      string_agg(kind || ':' || b || ':' || stop, ',' ORDER BY b, place) FILTER (WHERE kind <> 'token' OR live) AS spans,
      count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied FROM j GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM t LEFT JOIN g USING (doc_id)
""".replace('\\"', '"')

#: All windows that share a shingle with an item, by exact similarity alone.
CONTAMINATION = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS p, w FROM d WHERE len(w) >= 5),
dg AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM ds),
ix AS (SELECT item_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS o, w FROM i WHERE len(w) >= 5),
ig AS (SELECT item_id, n, o, array_to_string(w[o + 1:o + 5], ' ') AS s FROM ix),
a AS (SELECT DISTINCT dg.doc_id, ig.item_id, ig.n, greatest(least(dg.p - ig.o, len(d.w) - ig.n), 0) AS b FROM dg JOIN ig USING (s) JOIN d ON d.doc_id = dg.doc_id),
wg AS (SELECT a.doc_id, a.item_id, a.n, a.b, dg.s, count(*) AS c FROM a JOIN dg ON dg.doc_id = a.doc_id AND dg.p BETWEEN a.b AND a.b + a.n - 5 GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS c FROM ig GROUP BY ALL),
m AS (SELECT wg.doc_id, wg.item_id, wg.n, wg.b, sum(least(wg.c, ic.c)) AS common FROM wg JOIN ic USING (item_id, s) GROUP BY ALL),
v AS (SELECT doc_id, item_id, CAST(common AS DOUBLE) / (2 * (n - 4) - CAST(common AS DOUBLE)) AS similarity, b AS first_word, n AS n_words FROM m)
SELECT doc_id, item_id, similarity, first_word, n_words FROM v WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first_word) = 1
"""

#: The crc32 of the text in {0}: bytes from hexadecimal digits, eight shifts by the reversed polynomial for each.
_CRC = ("xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, strlen({0}) + 1), lambda k: CAST(CAST('0x' || substr(hex(encode({0})), CAST(2 * k - 1 AS BIGINT), 2) AS INTEGER) AS BIGINT)), "
        "lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda z: CAST(0 AS BIGINT)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))")

RESAMPLING = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
f AS (SELECT k, doc_id, unnest(ws) AS w FROM d),
g AS (SELECT unnest(ws) AS w FROM b),
words AS (SELECT DISTINCT w FROM (SELECT w FROM f UNION ALL SELECT w FROM g)),
crc AS MATERIALIZED (SELECT w, {_CRC.format('w')} % 10000 AS bucket FROM words),
own AS (SELECT bucket, count(*) AS s FROM f JOIN crc USING (w) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM g JOIN crc USING (w) GROUP BY bucket),
sums AS (SELECT CAST((SELECT count(*) FROM f) + 10000 AS DOUBLE) AS s_all, CAST((SELECT count(*) FROM g) + 10000 AS DOUBLE) AS t_all),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * s_all / ((s + 1.0::DOUBLE) * t_all))) AS BIGINT) AS gain FROM own LEFT JOIN wanted USING (bucket), sums),
total AS (SELECT k, count(*) AS n, sum(gain) AS total FROM f JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY k),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight,
    CAST(coalesce(floor(total / n), 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN total USING (k)),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n DESC, weight DESC) AS place FROM scored WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM placed) THEN place END AS BIGINT) AS rank FROM placed
UNION ALL SELECT doc_id, CAST(n AS BIGINT), weight, score, NULL FROM scored WHERE n < 20
"""

_WAY = "struct_pack(cost := CAST({cost} AS BIGINT), audit := {audit}, lines := {lines})"


def _ways() -> str:
    """The cheapest ways on from the four grammar states before a row, from those after it in ``v``."""
    leads = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    forced = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
    columns = []
    for q in range(4):
        ways = [_WAY.format(cost=f"2 + v[{q + 1}].cost", audit=f"'D' || v[{q + 1}].audit", lines=f"v[{q + 1}].lines")]
        for initial, to in leads[q].items():
            kept = _WAY.format(cost=f"5 * truncated + v[{to + 1}].cost", audit=f"'K' || v[{to + 1}].audit", lines=f"[role || ':' || text] || v[{to + 1}].lines")
            ways.append(f"CASE WHEN NOT must AND role[1] = '{initial}' THEN {kept} END")
        role, to = forced[q]
        rerole = _WAY.format(cost=f"1 + 5 * truncated + v[{to + 1}].cost", audit=f"'R' || v[{to + 1}].audit", lines=f"['{role}:' || text] || v[{to + 1}].lines")
        ways.append(f"CASE WHEN NOT must THEN {rerole} END")
        columns.append(f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))")
    return f"[{', '.join(columns)}]"


def _inserts() -> str:
    """``b``, and turns put in before going on."""
    def put(role: str, way: str) -> str:
        return _WAY.format(cost=f"5 + {way}.cost", audit=f"'I' || {way}.audit", lines=f"['{role}:'] || {way}.lines")
    user, answer = put("user", "b[3]"), put("assistant", "b[4]")
    both = _WAY.format(cost="10 + b[4].cost", audit="'II' || b[4].audit", lines="['user:', 'assistant:'] || b[4].lines")
    return f"[list_min([b[1], {user}, {both}]), list_min([b[2], {user}, {both}]), list_min([b[3], {answer}]), list_min([b[4], {user}])]"


CONVERSATIONS = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
c AS MATERIALIZED (SELECT conv_id, turn, role, text, {_CRC.format('name')} % 20 AS code FROM t),
r AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE code <> 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS short FROM r),
m AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, blank, again AND NOT blank AS duplicate, blank OR again AS must, CAST(short AND NOT blank AND NOT again AS INTEGER) AS truncated,
    coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal FROM p),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, sum(truncated) AS truncated, count_if(illegal) AS illegal, max(i) AS n
  FROM m GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT every.conv_id, coalesce(n, 0) AS i, [struct_pack(cost := CAST(0 AS BIGINT), audit := '', lines := CAST([] AS VARCHAR[])), struct_pack(cost := CAST(10 AS BIGINT), audit := 'II', lines := ['user:', 'assistant:']),
    struct_pack(cost := CAST(5 AS BIGINT), audit := 'I', lines := ['assistant:']), struct_pack(cost := CAST(0 AS BIGINT), audit := '', lines := CAST([] AS VARCHAR[]))] AS v
  FROM every LEFT JOIN s ON every.conv_id IS NOT DISTINCT FROM s.conv_id
  UNION ALL
  SELECT conv_id, i, {_inserts()} FROM (SELECT walk.conv_id, walk.i - 1 AS i, {_ways()} AS b FROM walk JOIN m ON walk.conv_id IS NOT DISTINCT FROM m.conv_id AND walk.i = m.i))
SELECT w.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, v[1].cost AS cost, v[1].audit AS audit, sha256(array_to_string(v[1].lines, chr(10))) AS repaired_sha256
FROM walk w LEFT JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id WHERE w.i = 0
"""
