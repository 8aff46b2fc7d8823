"""SQL of the registered queries, for DuckDB. op7, op12 and the pipeline have none: a fitted model isn't SQL."""

from __future__ import annotations

import struct

from . import media
from .repair import ROW_CELLS
from .secrets import EXAMPLE_OWNERS, EXAMPLE_PART, EXAMPLE_REPOSITORIES, KINDS

#: CRC-32 of a list of bytes; it needs the table `crc_table`.
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def _crc32(hexed: str) -> str:
    """CRC-32 of what a text of hex digits spells."""
    listed = f"list_transform(regexp_extract_all({hexed}, '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"CAST(xor(4294967295, list_reduce(list_concat([4294967295], {listed}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS BIGINT)"


# XXH64 in unsigned 128-bit numbers. Fixed values of the hash: its five primes, the turns of its lanes and steps.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
LANE_TURNS = (1, 7, 12, 18)
FULL = (1 << 64) - 1


def _big(x) -> str:
    return f"CAST({x} AS UHUGEINT)"


def _mod(x: str) -> str:
    return f"(({x}) & {_big(FULL)})"


def _mul(a: str, b: int) -> str:
    return _mod(f"({a}) * {_big(b)}")


def _turn(x: str, bits: int) -> str:
    """Rotated to the left; the list names x, so that it is worked out once."""
    return f"list_transform([{x}], lambda y: {_mod(f'y << {bits}')} | (y >> {64 - bits}))[1]"


def _fold(x: str, bits: int) -> str:
    return f"list_transform([{x}], lambda y: xor(y, y >> {bits}))[1]"


def _round(v: str, lane: str) -> str:
    return _mul(_turn(_mod(f"{v} + {_mul(lane, P2)}"), 31), P1)


def _step(h: str, word: str, bits: int, a: int, b: int) -> str:
    return _mod(f"{_mul(_turn(f'xor({h}, {word})', bits), a)} + {_big(b)}")


def _word(at: str, n: int) -> str:
    """n bytes of `pairs` (hex digits of bytes) from `at` on, the first least."""
    return _big(f"CAST('0x' || array_to_string(list_reverse(pairs[{at} + 1:{at} + {n}]), '') AS UBIGINT)")


def _xxh64(seed: int = 42) -> str:
    """Tables up to hashed (s, h) of the texts s of the table shingles."""
    starts = [(seed + P1 + P2) & FULL, (seed + P2) & FULL, seed, (seed - P1) & FULL]
    lanes = ", ".join(f"list_reduce(list_transform(range(0, o // 32), lambda i: {_word(f'(32 * i + {8 * k})', 8)}), lambda v, x: {_round('v', 'x')}, {_big(starts[k])}) AS v{k}" for k in range(4))
    joined = _mod(" + ".join(_turn(f"v{k}", bits) for k, bits in enumerate(LANE_TURNS)))
    mixed = _mod(f"{_mul(f'xor(h, {_round(_big(0), chr(118))})', P1)} + {_big(P4)}")
    byte = _mul(_turn(f"xor(a.v, {_mul('u.v', P5)})", 11), P1)
    return f"""
spelled AS (SELECT s, regexp_extract_all(hex(encode(s)), '..') AS pairs FROM (SELECT DISTINCT s FROM shingles)),
measured AS (SELECT *, len(pairs) AS n, len(pairs) // 32 * 32 AS o FROM spelled),
laned AS (SELECT *, {lanes} FROM measured),
begun AS (SELECT *, CASE WHEN n < 32 THEN {_big((seed + P5) & FULL)} ELSE list_reduce([v0, v1, v2, v3], lambda h, v: {mixed}, {joined}) END AS h FROM laned),
ended AS (
  SELECT s, list_reduce(list_concat(
      list_transform(range(0, (n - o) // 8), lambda i: {{'k': 8, 'v': {_word('(o + 8 * i)', 8)}}}),
      list_transform(range(0, (n - o) % 8 // 4), lambda i: {{'k': 4, 'v': {_word('(n - (n - o) % 8)', 4)}}}),
      list_transform(range(n - (n - o) % 4, n), lambda i: {{'k': 1, 'v': {_word('i', 1)}}})),
    lambda a, u: {{'k': 0, 'v': CASE u.k WHEN 8 THEN {_step("a.v", _round(_big(0), "u.v"), 27, P1, P4)} WHEN 4 THEN {_step("a.v", _mul("u.v", P1), 23, P2, P3)} ELSE {byte} END}},
    {{'k': 0, 'v': {_mod("h + " + _big("n"))}}}).v AS h FROM begun),
hashed AS (SELECT s, CAST({_fold(_mul(_fold(_mul(_fold("h", 33), P2), 29), P3), 32)} AS UBIGINT) AS h FROM ended)"""


# The parts of an audio stream that are the same in all.
AUDIO = media.parse_header(media.HEADER)
FRAME_HEAD = media.HEADER + media.crc16(media.HEADER[2:] + media.SIDE).to_bytes(2) + media.SIDE
FRAME_REST = bytes(AUDIO.length - len(FRAME_HEAD) - media.UNIT)
TAG = bytes.fromhex("494433040000" + "0000000f" + "54495432" + "00000005" + "0000" + "0374657874")
INFO = FRAME_HEAD + b"Info" + struct.pack(">I", 7)
SEEK = bytes(256 * k // media.SEEK_POINTS for k in range(media.SEEK_POINTS))
INFO_REST = bytes(AUDIO.length - len(INFO) - 8 - len(SEEK))

def _kind_sql(rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, {rank} AS rank, start, start + length(hit) AS stop, start + length(hit) - length(v) AS v_start, v FROM (
    SELECT doc_id, source, hits[i] AS hit, regexp_extract(hits[i], '{p}', {group}) AS v,
      list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, source, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits FROM docs WHERE regexp_matches(t, '{p}')))) WHERE length(v) >= {least}"""


#: Least capacities for 2 to 8 shards by dynamic programming over all groups: best of the first j groups in k shards.
CAPACITIES = "".join(
    f""",
d{k} AS (SELECT b.j, min(greatest(a.best, b.p - a.p)) AS best, any_value(b.p) AS p FROM d{k - 1} a JOIN ends b ON a.j < b.j GROUP BY b.j UNION ALL SELECT 0, 0, 0)"""
    for k in range(2, 9)
)

SQL = {
    "op3_simhash_neardup": f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT row, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [array_to_string(w, ' ')] END) AS s FROM docs WHERE len(w) > 0),{_xxh64()},
votes AS (SELECT row, count(*) AS n, {", ".join(f"sum((h >> {k}) & 1) AS b{k}" for k in range(64))} FROM shingles JOIN hashed USING (s) GROUP BY row),
fps AS (
  SELECT doc_id, coalesce(fp, 0) AS fp FROM docs LEFT JOIN (SELECT row, CAST({" + ".join(f"CASE WHEN 2 * b{k} > n THEN {_big(1 << k)} ELSE 0 END" for k in range(64))} AS UBIGINT) AS fp FROM votes) USING (row)),
nodes AS (SELECT DISTINCT fp FROM fps),
near AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON bit_count(CAST(xor(a.fp, b.fp) AS HUGEINT)) <= 2),
reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b)
SELECT doc_id, lpad(lower(to_hex(f.fp)), 16, '0') AS fingerprint, component_id
FROM fps f JOIN (SELECT a, min(doc_id) AS component_id FROM reach JOIN fps ON fps.fp = b GROUP BY a) c ON c.a = f.fp
""",
    "op6_html_wrappers": r"""
WITH inner_html AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS x FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM inner_html),
decoded AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS x FROM plain)
SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM decoded
""",
    "op8_mpeg_audio": f"""
WITH {CRC_TABLE},
docs AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n, coalesce(hex(encode(text)), '') AS x FROM documents),
padded AS (SELECT doc_id, n, greatest(1, (n + {media.UNIT - 1}) // {media.UNIT}) AS frames, x || repeat('20', CAST(greatest(1, (n + {media.UNIT - 1}) // {media.UNIT}) * {media.UNIT} - n AS INTEGER)) AS p FROM docs),
made AS (
  SELECT *, '{TAG.hex()}{INFO.hex()}' || format('{{:08x}}', frames) || format('{{:08x}}', {AUDIO.length} * (frames + 1)) || '{SEEK.hex()}{INFO_REST.hex()}' ||
    array_to_string(list_transform(regexp_extract_all(p, '.{{{2 * media.UNIT}}}'), lambda c: '{FRAME_HEAD.hex()}' || c || '{FRAME_REST.hex()}'), '') AS media,
    {len(TAG)} + {AUDIO.length} AS first, 3 * frames // gcd(3 * frames, 125) || '/' || 125 // gcd(3 * frames, 125) AS seconds FROM padded)
SELECT doc_id, n AS n_bytes, CAST({media.UNIT} * frames AS BIGINT) AS payload_bytes, sha256(unhex(p)) AS payload_sha256,
  {_crc32('right(p, 32)')} AS tail_crc32,
  CAST(strlen(media) // 2 AS BIGINT) AS media_bytes, sha256(unhex(media)) AS media_sha256,
  'frames=' || frames || ';seconds=' || seconds || ';crc=' || frames || '/' || frames || ';skipped=0;table=' || frames || ',' || {AUDIO.length} * (frames + 1) || ';first=' || first || ';last=' || (first + {AUDIO.length} * (frames - 1)) || ';seek=' ||
    left(sha256(unhex(array_to_string(list_transform(range(0, frames), lambda i: format('{{:016x}}', first + {AUDIO.length} * i)), ''))), 16) AS feature
FROM made, crc_table
""",
    "op4_sharding": f"""
WITH RECURSIVE {CRC_TABLE},
docs AS (
  SELECT row_number() OVER () AS row, doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, coalesce(sha256(text), repeat('0', 64)) AS key,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {_crc32('hex(encode(text))')} END AS text_crc32
  FROM documents, crc_table),
groups AS (SELECT key, CAST(sum(size) AS BIGINT) AS bytes FROM docs GROUP BY key),
ranked AS (SELECT *, row_number() OVER w - 1 AS r, coalesce(sum(bytes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(bytes) OVER () AS total FROM groups WINDOW w AS (ORDER BY bytes DESC, key)),
judged AS (SELECT *, r < 7 AND coalesce(bool_and(bytes * (8 - r) > total - above) OVER (ORDER BY r), false) AS own FROM ranked),
sums AS (SELECT key, CAST(sum(bytes) OVER (ORDER BY key) AS BIGINT) AS p, row_number() OVER (ORDER BY key) AS j FROM judged WHERE NOT own),
ends AS (SELECT j, p FROM sums UNION ALL SELECT 0, 0),
d1 AS (SELECT j, p AS best, p FROM ends){CAPACITIES},
found AS ({" UNION ALL ".join(f"SELECT {k} AS m, best, p FROM d{k}" for k in range(1, 9))}),
cap AS (SELECT 8 - (SELECT count(*) FROM judged WHERE own) AS m, coalesce(max(p), 0) AS t FROM ends),
best AS (SELECT cap.m, cap.t, min(best) AS c FROM cap JOIN found f ON f.m <= cap.m AND f.p = cap.t GROUP BY 1, 2),
early AS (
  SELECT m AS k, t AS e FROM best
  UNION ALL SELECT k - 1, CASE WHEN e > c THEN (SELECT min(p) FROM ends WHERE p >= e - c) ELSE 0 END FROM early, best WHERE k > 1),
cuts AS (
  SELECT 0 AS k, CAST(0 AS BIGINT) AS c0
  UNION ALL
  SELECT k, cut FROM (
    SELECT s.k, x.cut, row_number() OVER (ORDER BY abs(x.cut - s.share), x.cut) AS nth
    FROM (SELECT cuts.k + 1 AS k, c0, c, e, c0 + (t - c0) // (m - cuts.k) AS share FROM cuts, best JOIN early ON early.k = cuts.k + 1 WHERE cuts.k + 1 < m) s,
      LATERAL (SELECT unnest([(SELECT max(p) FROM ends WHERE p <= s.share), (SELECT min(p) FROM ends WHERE p >= s.share), s.e]) AS cut) x
    WHERE x.cut BETWEEN greatest(s.e, s.c0) AND s.c0 + s.c) WHERE nth = 1),
places AS (
  SELECT key, r AS shard FROM judged WHERE own
  UNION ALL SELECT key, 8 - m + (SELECT count(DISTINCT c0) FROM cuts WHERE c0 > 0 AND c0 < p) FROM sums, best),
dealt AS (
  SELECT d.*, CAST(shard AS INTEGER) AS shard, CAST('0x' || substr(md5(concat_ws('#', CAST(doc_id AS VARCHAR), key)), 1, 8) AS BIGINT) % greatest(1, (SELECT count(*) FROM docs) // 20000) AS cell
  FROM docs d JOIN places USING (key))
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, key, row) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt
""",
    "op2_mixing": r"""
WITH sized AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws('#', coalesce(CAST(doc_id AS VARCHAR), md5(text)), '42')) AS turn FROM documents),
weighed AS (
  SELECT source, z, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM sized GROUP BY source)),
ratios AS (SELECT *, CAST(3 * z AS DOUBLE) / w AS ratio FROM weighed),
levels AS (
  SELECT *, CAST((SELECT sum(z) FROM weighed) - (sum(3 * z) OVER o - 3 * z) AS DOUBLE) / CAST(sum(w) OVER () - (sum(w) OVER o - w) AS DOUBLE) AS own
  FROM ratios WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT source, z, CASE WHEN z = 0 OR level IS NULL OR ratio < level THEN CAST(3 * z AS DOUBLE) ELSE w * level END AS target
  FROM (SELECT *, (SELECT max(own) FROM levels WHERE ratio >= own) AS level FROM levels)),
streams AS (
  SELECT row, doc_id, turn, coalesce('=' || s.source, '') AS stream, size, z, target,
    CAST(sum(size) OVER (PARTITION BY s.source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS first
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, first + k * z AS start FROM (SELECT *, unnest([0, 1, 2]) AS k FROM streams) WHERE size > 0 AND first + k * z < target),
packets AS (
  SELECT *, unnest(range(0, CASE WHEN start + size <= target THEN 1 ELSE least(size, 256) END)) AS i, CASE WHEN start + size <= target THEN 1 ELSE least(size, 256) END AS n FROM copies),
queue AS (SELECT *, size * (i + 1) // n - size * i // n AS words, start + size * (i + 1) // n AS upto FROM packets),
placed AS (
  SELECT *, CAST(sum(words) OVER (ORDER BY CAST(upto AS DOUBLE) / target, stream, turn, doc_id, size, upto ROWS UNBOUNDED PRECEDING) AS BIGINT) - words AS place FROM queue),
mixed AS (
  SELECT row, sum(kept) AS taken, min(place) AS first_at, count(DISTINCT k) AS copies
  FROM (SELECT *, least(words, (SELECT sum(z) FROM weighed) - place) AS kept FROM placed) WHERE kept > 0 GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, z AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_at, coalesce(copies, 0) AS copies
FROM streams LEFT JOIN mixed USING (row)
""",
    "op5_secret_scan": f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_kind_sql(k, p, g, n) for k, (_, p, g, n) in enumerate(KINDS))}),
every AS (SELECT owner, count(*) AS of_owner FROM (SELECT t, min(coalesce('=' || source, '')) AS owner FROM docs GROUP BY t) GROUP BY owner),
owned AS (
  SELECT v, owners, repositories, owners >= {EXAMPLE_OWNERS} OR repositories >= {EXAMPLE_REPOSITORIES} AND repositories * {EXAMPLE_PART} >= of_owner AS example
  FROM (SELECT v, count(DISTINCT owner) AS owners, count(*) AS repositories, min(owner) AS owner
    FROM (SELECT v, t, min(coalesce('=' || d.source, '')) AS owner FROM found JOIN docs d USING (doc_id) GROUP BY v, t) GROUP BY v) JOIN every USING (owner)),
judged AS (
  SELECT f.*, ['{"', '".join(k for k, *_ in KINDS)}'][rank + 1] AS kind, CASE WHEN example THEN 'example' WHEN length(v) >= 12 AND 8 * list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: len(list_filter(string_split(v, ''), lambda x: x = c)) ** 2)) <= length(v) ** 2
    AND length(regexp_replace(regexp_replace(regexp_replace(v, '[^0-9A-Za-z]', '', 'g'), '[0-9]+', '0', 'g'), '[A-Za-z]+', 'a', 'g')) >= 4
    AND 2 * len(list_filter(range(1, length(v)), lambda i: abs(ascii(v[i + 1]) - ascii(v[i])) <= 1)) < length(v) THEN 'live' ELSE 'weak' END AS verdict
  FROM found f JOIN owned USING (v)),
spans AS (
  SELECT doc_id, start, rank, stop, kind || ':' || start || ':' || stop AS span FROM judged
  UNION ALL SELECT doc_id, v_start, 3, stop, 'live:' || v_start || ':' || stop FROM judged WHERE verdict = 'live'),
listed AS (
  SELECT doc_id, string_agg(span, ',' ORDER BY start, rank, stop) AS spans, string_agg(span, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base FROM spans GROUP BY doc_id),
counts AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in KINDS)}, {", ".join(f"count(*) FILTER (verdict = '{v}') AS n_judged_{v}" for v in ("example", "live", "weak"))}
  FROM judged GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  {", ".join(f"coalesce(n_judged_{v}, 0) AS n_judged_{v}" for v in ("example", "live", "weak"))}
FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN counts USING (doc_id)
""",
    "op1_decontamination": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS t, len(w[i:i + 12]) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, s.n, item_id FROM spots s JOIN windows USING (t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op9_perspective_rotation": r"""
WITH said0 AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said FROM conversations),
long AS (SELECT conv_id FROM said0 GROUP BY conv_id HAVING count(*) > 65536 OR sum(strlen(role) + strlen(said) + 64) > 16777216),
said AS (
  SELECT s.*, l.conv_id IS NOT NULL OR s.conv_id IS NULL AND (SELECT count(*) FROM long WHERE conv_id IS NULL) > 0 AS is_long,
    CASE WHEN l.conv_id IS NOT NULL OR s.conv_id IS NULL AND (SELECT count(*) FROM long WHERE conv_id IS NULL) > 0 THEN coalesce(CAST(floor(turn / 512) AS BIGINT), -1) ELSE 0 END AS part
  FROM said0 s LEFT JOIN long l ON s.conv_id = l.conv_id),
pieces AS (
  SELECT conv_id, part, turn, before // 512 + before_bytes // 16777216 AS first, CAST(greatest(CASE WHEN n > 65536 THEN ceil(n / 512) ELSE 1 END, ceil(bytes / 16777216)) AS BIGINT) AS pieces
  FROM (
    SELECT *, sum(n) OVER (PARTITION BY conv_id, part) AS every, sum(bytes) OVER (PARTITION BY conv_id, part) AS every_bytes,
      CAST(sum(n) OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS before,
      CAST(sum(bytes) OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) - bytes AS before_bytes
    FROM (SELECT conv_id, part, turn, count(*) AS n, CAST(sum(strlen(role) + strlen(said) + 64) AS BIGINT) AS bytes FROM said WHERE is_long GROUP BY ALL)) WHERE every > 65536 OR every_bytes > 16777216),
lots AS (
  SELECT *, CASE WHEN is_long THEN least(512, n - lot * 512) ELSE n END AS times
  FROM (SELECT *, unnest(range(0, CASE WHEN is_long THEN (n - 1) // 512 + 1 ELSE 1 END)) AS lot FROM (SELECT conv_id, is_long, part, turn, role, said, count(*) AS n FROM said GROUP BY ALL))),
placed AS (
  SELECT l.*, coalesce(first + CAST('0x' || substr(md5(role || '|' || said || '|' || lot), 1, 8) AS BIGINT) % pieces, 0) AS piece
  FROM lots l LEFT JOIN pieces p ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.part = p.part AND l.turn IS NOT DISTINCT FROM p.turn),
shown AS (
  SELECT *, '<|' || name || '|>' AS narrated, '<|user name=' || name || '|>' AS named, regexp_replace(said, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS rest
  FROM (SELECT *, regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') AS name, unnest(range(0, times)) AS copy FROM placed)),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM placed WHERE role <> 'system'),
seen AS (
  SELECT s.*, speaker, CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN narrated ELSE named END AS head
  FROM shown s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id)
SELECT conv_id, speaker, part, piece, CAST(sum(sum(length(head || rest))) OVER (PARTITION BY conv_id, speaker ORDER BY part, piece) - sum(length(head || rest)) AS BIGINT) AS before, count(*) AS n_turns,
       string_agg(head || rest, '' ORDER BY turn NULLS FIRST, role, said) AS text,
       string_agg(length(head) || ':0,' || length(rest) || CASE WHEN role = speaker THEN ':1' ELSE ':0' END, ',' ORDER BY turn NULLS FIRST, role, said) AS mask,
       CAST(sum(CASE WHEN role = speaker THEN length(rest) ELSE 0 END) AS BIGINT) AS n_trained
FROM seen GROUP BY conv_id, speaker, part, piece
""",
    "op10_warc_fixity": r"""
WITH made AS (
  SELECT page_id, CAST(178 + strlen(CAST(page_id AS VARCHAR)) + strlen(coalesce(url, '')) + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + strlen(coalesce(html, '')) AS BIGINT) AS length
  FROM pages WHERE page_id % 50 = 0)
SELECT page_id, CASE WHEN page_id % 200 = 0 THEN 'missing' ELSE 'changed' END AS fault, length,
       CASE WHEN page_id % 200 = 0 THEN NULL ELSE length END AS other_length
FROM made
""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, 5) r(k)),
counts AS (SELECT lang, w[i:i + k - 1] AS w, k, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM counts WHERE k > 1),
scored AS (
  SELECT c.lang, c.w, c.k, c.f AS a, cut, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.f AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON c.lang = x.lang AND c.w[1:cut] = x.w JOIN counts y ON c.lang = y.lang AND c.w[cut + 1:] = y.w),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
inner_runs AS (SELECT lang, w, a, k, j, unnest(range(1, k - j + 2)) AS i FROM worst, range(2, 4) r(j) WHERE j < k),
around AS (SELECT lang, w[i:i + j - 1] AS w, max(a) AS around FROM inner_runs GROUP BY ALL),
kept AS (
  SELECT s.lang, array_to_string(s.w, ' ') AS phrase, a, l, r, score FROM worst s LEFT JOIN around o ON s.lang = o.lang AND s.w = o.w
  WHERE around IS NULL OR 100 * CAST(around AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes ON kept.lang = sizes.lang
QUALIFY rank <= 2000
""",
    "op13_structure_repair": rf"""
WITH RECURSIVE {CRC_TABLE},
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("hex(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
rows_ AS (SELECT *, row_number() OVER () AS id FROM damaged),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id) AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id) AS before,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM rows_),
faulty AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '' END AS initial,
         CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
edits(initial, fault, p, q, cost, audit) AS (VALUES {", ".join(f"('{i}', '{f or ''}', {p}, {q}, {cost}, '{audit}')" for (i, f), cell in ROW_CELLS.items() for (p, q), (cost, audit) in cell.items())}),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS best FROM faulty
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.q, min({{'cost': w.best.cost + e.cost, 'audit': w.best.audit || e.audit}})
  FROM walk w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1 JOIN edits e ON f.initial = e.initial AND f.fault = e.fault AND w.q = e.p
  GROUP BY ALL),
totals AS (
  SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
chosen AS (SELECT t.conv_id, min(best) AS best FROM totals t JOIN walk w ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n WHERE q IN (0, 3) GROUP BY t.conv_id),
steps AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, unnest(range(1, length(best.audit) + 1)) AS k FROM chosen WHERE best.audit <> ''),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i FROM steps),
kept AS (
  SELECT s.conv_id, edit, k, CASE WHEN edit <> 'I' THEN f.role END AS role, CASE WHEN edit <> 'I' THEN f.text ELSE '' END AS text,
         row_number() OVER (PARTITION BY s.conv_id ORDER BY k) AS j, first_value(edit = 'K' AND initial = 's') OVER (PARTITION BY s.conv_id ORDER BY k) AS led
  FROM placed s LEFT JOIN faulty f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.i = f.i WHERE edit <> 'D'),
said AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS hash
  FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN totals t ON o.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN chosen c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
""",
}
