"""SQL fragments for the queries' counterparts, as chains of common table expressions."""

from graphmere.functions import ranking as R
from graphmere.functions import text as T
from graphmere.operators import retrieval as A

KEY = r"nullif(nfc_normalize(regexp_replace(regexp_replace(regexp_replace({c}, '(?s)[#|].*$', ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '\.md$', '')), '')"
FOLD = f"regexp_replace(translate(lower({{c}}), '{T.ACCENTED}', '{T.PLAIN}'), '[\\x{{{{300}}}}-\\x{{{{36f}}}}]', '', 'g')"
TOKENS = "coalesce(regexp_extract_all(" + FOLD + ", '[\\p{{L}}\\p{{N}}]+'), [])"
RELATION = "translate(lower(trim({c})), '_', '-')"

LAST = """
last AS (SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, row_no DESC) = 1),
live AS (SELECT * FROM last WHERE removed_at IS NULL),
pages AS (SELECT id, coalesce(path, id || '.md') AS path, title, type, description, body, trust, volatile, freshness, resource, source, authored, write_actor FROM live
  UNION ALL SELECT id, id || '.md', min(title), 'entity', NULL, '', 'trusted', FALSE, NULL, NULL, NULL, NULL, 'unknown' FROM entities
  WHERE removed_at IS NULL AND id IS NOT NULL AND id NOT IN (SELECT id FROM live) GROUP BY id)"""
EDGES = f"""
written AS (SELECT edge_id, {KEY.format(c="source")} AS source, {RELATION.format(c="coalesce(type, 'related_to')")} AS type, {KEY.format(c="target")} AS target, coalesce(weight, 1.0) AS weight FROM edges),
links AS (SELECT source, type, target, arg_min(weight, edge_id) AS weight FROM written WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL)"""
CHUNKS = """
parts AS (SELECT chunk_id, page_id, ord, embedding::DOUBLE[] AS v FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY page_id, ord ORDER BY chunk_id) = 1)
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
heads AS (SELECT page_id, v FROM parts WHERE ord = 0)"""
ASKED = """
asked AS (SELECT item_seq::VARCHAR AS qid, title AS query, id AS page FROM memory_items WHERE item_seq % 100 = 0 AND title IS NOT NULL),
vectors AS (SELECT qid, v FROM asked JOIN heads ON page_id = page)"""
ASKED_PAGES = """
asked AS (SELECT id AS qid FROM live WHERE row_no % 100 = 0),
vectors AS (SELECT qid, v FROM asked JOIN heads ON page_id = qid)"""
TERMS = f"""
qterms AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({TOKENS.format(c="query")}) AS term FROM asked) WHERE length(term) >= 2 GROUP BY ALL)"""
POSTINGS = f"""
tok AS (SELECT id, {TOKENS.format(c="title")} AS t, {TOKENS.format(c="description")} AS s, {TOKENS.format(c="body")} AS b FROM pages),
dl AS (SELECT id, t, s, b, len(t) + len(s) + len(b) AS dl FROM tok),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
flat AS (SELECT id, dl, unnest(t) AS term, 10.0 AS w FROM dl UNION ALL SELECT id, dl, unnest(s), 3.0 FROM dl UNION ALL SELECT id, dl, unnest(b), 1.0 FROM dl),
post AS (SELECT term, id, dl, sum(w) AS wtf FROM flat WHERE term IN (SELECT term FROM qterms) GROUP BY ALL)"""
BM25 = f"""
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE {A.LEAST_IDF} END AS idf FROM df, corpus),
bm AS (SELECT qid, id, round(sum(times * idf * wtf * {A.K1 + 1} / (wtf + {A.K1} * ({1 - A.B} + {A.B} * dl / avgdl))), 9) AS score
  FROM post JOIN qterms USING (term) JOIN idf USING (term), corpus GROUP BY ALL),
fts AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rnk FROM bm) WHERE rnk < 20)"""
VEC = """
sims AS (SELECT qid, page_id, ord, round(list_cosine_similarity(q.v, c.v), 9) AS similarity FROM vectors q, parts c),
topv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, page_id, ord) AS place FROM sims) WHERE place <= 60),
firstv AS (SELECT * FROM topv QUALIFY row_number() OVER (PARTITION BY qid, page_id ORDER BY place) = 1),
vec AS (SELECT * FROM (SELECT qid, page_id AS id, similarity, row_number() OVER (PARTITION BY qid ORDER BY place) - 1 AS rnk FROM firstv) WHERE rnk < 20)"""
SEEDS = """
seeds AS (SELECT qid, id, min(rnk) AS best FROM (SELECT qid, id, rnk FROM fts UNION ALL SELECT qid, id, rnk FROM vec) GROUP BY ALL HAVING min(rnk) < 5)"""
OUT = f"""
walk AS (SELECT * FROM (SELECT seed, cand, row_number() OVER (PARTITION BY seed ORDER BY cand) AS i FROM
  (SELECT DISTINCT source AS seed, target AS cand FROM links WHERE source IN (SELECT id FROM seeds) AND target IN (SELECT id FROM pages))) WHERE i <= {A.CAP_OUT}),
outs AS (SELECT qid, cand AS id, 1 / (1 + best)::DOUBLE AS score FROM walk JOIN seeds ON seed = seeds.id)"""
IN = f"""
indeg AS (SELECT target AS id, count(DISTINCT source) AS deg FROM links GROUP BY 1), outdeg AS (SELECT source AS id, count(DISTINCT target) AS deg FROM links GROUP BY 1),
fit AS (SELECT qid, s.id, best, deg FROM seeds s JOIN indeg d ON s.id = d.id WHERE deg BETWEEN 1 AND {A.HUB}),
back AS (SELECT * FROM (SELECT seed, cand, row_number() OVER (PARTITION BY seed ORDER BY cand) AS i FROM
  (SELECT DISTINCT target AS seed, source AS cand FROM links WHERE target IN (SELECT id FROM fit) AND source IN (SELECT id FROM pages))) WHERE i <= {A.CAP_IN}),
ins AS (SELECT qid, cand AS id, {A.IN_WEIGHT} / (1 + best) / log2(2 + fit.deg) / log2(2 + o.deg) AS score FROM back JOIN fit ON seed = fit.id JOIN outdeg o ON o.id = cand)"""

# Written times by DuckDB's own calendar and zone rules. A local time is tried with the offsets of a day before and after.
WRITTEN = r"""
cells AS (SELECT item_seq, write_actor, 'authored' AS field, authored AS written FROM memory_items WHERE authored IS NOT NULL
  UNION ALL SELECT item_seq, write_actor, 'freshness', freshness FROM memory_items WHERE freshness IS NOT NULL),
trimmed AS (SELECT *, regexp_replace(written, '^[\s\p{Z}"''“”‘’`]+|[\s\p{Z}"''“”‘’`]+$', '', 'g') AS s FROM cells),
number AS (SELECT *, CASE WHEN regexp_matches(s, '^\d{10}$') THEN s::BIGINT * 1000000 WHEN regexp_matches(s, '^\d{13}$') THEN s::BIGINT * 1000 WHEN regexp_matches(s, '^\d{16}$') THEN s::BIGINT
  WHEN regexp_matches(s, '^\d{10}[.,]\d+$') THEN s[1:10]::BIGINT * 1000000 + rpad(s[12:17], 6, '0')::BIGINT END AS epoch_us FROM trimmed),
dashed AS (SELECT *, CASE WHEN regexp_matches(s, '^\d{8}$') THEN s[1:4] || '-' || s[5:6] || '-' || s[7:8]
  WHEN regexp_matches(s, '^\d{8}[Tt ]\d{2}:?\d{2}') THEN s[1:4] || '-' || s[5:6] || '-' || s[7:8] || ' ' || regexp_replace(s[10:], '^(\d{2}):?(\d{2}):?(\d{2})?', CASE WHEN regexp_matches(s[10:], '^\d{2}:?\d{2}:?\d{2}') THEN '\1:\2:\3' ELSE '\1:\2' END)
  ELSE s END AS w FROM number),
cut AS (SELECT *, regexp_extract(w, '^(.*?)(?:(?:[Tt]|,? )(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?(?: ?([AaPp])[Mm])?(| ?[+-]\d{2}(?::?\d{2})?| ?[A-Za-z]{1,5}| ?[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)(?: ?\[([A-Za-z0-9_/+-]+)\])?)?$',
  ['day', 'hour', 'minute', 'second', 'fraction', 'half', 'zone', 'region']) AS x FROM dashed WHERE length(s) <= 100),
named AS (SELECT *, trim(x.zone) AS zone_text, regexp_replace(x.day, '^(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un)[a-z]*,? ', '') AS day FROM cut),
parts AS (SELECT *, CASE WHEN regexp_matches(day, '^\d{4}-\d{2}-\d{2}$') THEN regexp_extract(day, '^(\d+)-(\d+)-(\d+)$', ['y', 'm', 'd'])
  WHEN regexp_matches(day, '^\d{1,2}\.\d{1,2}\.\d{4}$') THEN regexp_extract(day, '^(\d+)\.(\d+)\.(\d+)$', ['d', 'm', 'y'])
  WHEN regexp_matches(day, '^\d{1,2}/\d{1,2}/\d{4}$') THEN regexp_extract(day, '^(\d+)/(\d+)/(\d+)$', ['m', 'd', 'y'])
  WHEN regexp_matches(day, '^\d{1,2} [A-Za-z]{3,9}\.? \d{4}$') THEN regexp_extract(day, '^(\d+) ([A-Za-z]+)\.? (\d+)$', ['d', 'm', 'y'])
  WHEN regexp_matches(day, '^[A-Za-z]{3,9}\.? \d{1,2},? \d{4}$') THEN regexp_extract(day, '^([A-Za-z]+)\.? (\d+),? (\d+)$', ['m', 'd', 'y']) END AS p FROM named),
dated AS (SELECT *, try_cast(printf('%04d-%02d-%02d', try_cast(p.y AS INT), CASE WHEN regexp_matches(p.m, '^\d+$') THEN try_cast(p.m AS INT) ELSE
  list_position(list_transform(['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december'],
    lambda n: starts_with(n, lower(p.m)) AND (length(p.m) <= 4 OR n = lower(p.m))), true) END, try_cast(p.d AS INT)) AS DATE) AS date,
  CASE WHEN x.half = '' THEN try_cast(x.hour AS INT) WHEN try_cast(x.hour AS INT) BETWEEN 1 AND 12 THEN try_cast(x.hour AS INT) % 12 + CASE WHEN lower(x.half) = 'p' THEN 12 ELSE 0 END END AS h FROM parts WHERE p IS NOT NULL AND x.hour <> ''
  UNION ALL SELECT *, try_cast(printf('%04d-%02d-%02d', try_cast(p.y AS INT), CASE WHEN regexp_matches(p.m, '^\d+$') THEN try_cast(p.m AS INT) ELSE
  list_position(list_transform(['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december'],
    lambda n: starts_with(n, lower(p.m)) AND (length(p.m) <= 4 OR n = lower(p.m))), true) END, try_cast(p.d AS INT)) AS DATE), NULL FROM parts WHERE p IS NOT NULL AND x.hour = ''),
clocked AS (SELECT *, epoch_us(date::TIMESTAMP) + CASE WHEN x.hour = '' THEN 0 WHEN h <= 23 AND try_cast(x.minute AS INT) <= 59 AND coalesce(try_cast(x.second AS INT), 0) <= 59
  THEN (h * 3600 + try_cast(x.minute AS INT) * 60 + coalesce(try_cast(x.second AS INT), 0))::BIGINT * 1000000 + try_cast(rpad(x.fraction[1:6], 6, '0') AS BIGINT) END AS local_us FROM dated),
zones AS (SELECT DISTINCT name FROM pg_timezone_names()),
homes AS (SELECT write_actor AS actor, min(home_zone) AS home FROM actors WHERE write_actor IS NOT NULL GROUP BY 1),
shifted AS (SELECT *, CASE WHEN x.hour = '' THEN 0
  WHEN regexp_matches(zone_text, '^[+-]') THEN CASE WHEN try_cast(zone_text[2:3] AS INT) <= 18 AND coalesce(try_cast(replace(zone_text[4:], ':', '') AS INT), 0) < 60
    THEN (CASE WHEN zone_text[1] = '-' THEN -1 ELSE 1 END) * (try_cast(zone_text[2:3] AS INT) * 60 + coalesce(try_cast(replace(zone_text[4:], ':', '') AS INT), 0)) END
  WHEN upper(zone_text) IN ('Z', 'UTC', 'GMT', 'UT') THEN 0 WHEN upper(zone_text) IN ('CET', 'MEZ') THEN 60 WHEN upper(zone_text) IN ('CEST', 'MESZ') THEN 120
  WHEN upper(zone_text) = 'EDT' THEN -240 WHEN upper(zone_text) IN ('EST', 'CDT') THEN -300 WHEN upper(zone_text) IN ('CST', 'MDT') THEN -360
  WHEN upper(zone_text) IN ('MST', 'PDT') THEN -420 WHEN upper(zone_text) IN ('PST', 'AKDT') THEN -480 WHEN upper(zone_text) = 'AKST' THEN -540 WHEN upper(zone_text) = 'HST' THEN -600 END AS minutes,
  CASE WHEN contains(zone_text, '/') THEN zone_text WHEN zone_text = '' AND x.region <> '' THEN x.region END AS given FROM clocked),
placed_zone AS (SELECT c.*, CASE WHEN c.minutes IS NULL THEN z.name END AS zone FROM shifted c LEFT JOIN homes ON actor = write_actor LEFT JOIN zones z ON z.name = coalesce(c.given, home)),
offsets AS (SELECT *, epoch_us(make_timestamptz(local_us - 86400000000) AT TIME ZONE zone) - (local_us - 86400000000) AS o1, epoch_us(make_timestamptz(local_us + 86400000000) AT TIME ZONE zone) - (local_us + 86400000000) AS o2 FROM placed_zone),
tried AS (SELECT *, epoch_us(make_timestamptz(local_us - o1) AT TIME ZONE zone) = local_us AS v1, epoch_us(make_timestamptz(local_us - o2) AT TIME ZONE zone) = local_us AS v2 FROM offsets),
judged AS (SELECT item_seq, field, CASE WHEN local_us IS NULL OR (zone_text <> '' AND minutes IS NULL AND given IS NULL) OR (given IS NOT NULL AND minutes IS NULL AND zone IS NULL) THEN 'invalid' WHEN minutes IS NOT NULL THEN 'offset'
  WHEN zone IS NULL THEN 'utc' WHEN o1 <> o2 AND v1 AND v2 THEN 'ambiguous' WHEN v1 OR v2 THEN 'zone' ELSE 'nonexistent' END AS status,
  CASE WHEN minutes IS NOT NULL THEN local_us - minutes::BIGINT * 60000000 WHEN zone IS NULL THEN local_us WHEN v1 AND v2 THEN least(local_us - o1, local_us - o2)
  WHEN v2 THEN local_us - o2 ELSE local_us - o1 END AS us FROM tried),
instants AS (SELECT n.item_seq, n.field, CASE WHEN n.epoch_us IS NOT NULL THEN 'offset' ELSE coalesce(j.status, 'invalid') END AS status,
  CASE WHEN n.epoch_us IS NOT NULL THEN n.epoch_us WHEN j.status <> 'invalid' THEN j.us END AS utc_us FROM number n LEFT JOIN judged j ON j.item_seq = n.item_seq AND j.field = n.field)"""


def graph_list(found: str) -> str:
    return f"""
graph AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rnk FROM
  (SELECT qid, id, round(max(score), 9) AS score FROM ({found}) f WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.qid = f.qid AND s.id = f.id) GROUP BY ALL)) WHERE rnk < 20)"""


def fuse(k: int) -> str:
    part = lambda arm, n: f"SELECT qid, id, {n} AS arm, 1.0::DOUBLE / ({k} + rnk + 1) AS s FROM {arm}"
    return f"""
fused AS (SELECT qid, id, list_sum(list(s ORDER BY arm)) AS score FROM ({part("fts", 0)} UNION ALL {part("vec", 1)} UNION ALL {part("graph", 2)}) GROUP BY ALL)"""


FOLDERS = "string_split(path, '/')[:-2]"
ZONE = f"""CASE WHEN {FOLDERS}[1] = 'raw' OR len(list_filter({FOLDERS}, lambda x: starts_with(x, 'in_'))) > 0 THEN 'incoming'
  WHEN {FOLDERS}[1] = 'out' OR len(list_filter({FOLDERS}, lambda x: starts_with(x, 'out_'))) > 0 THEN 'output' ELSE 'wiki' END"""
ADJUSTED = f"""
rows AS (SELECT f.qid, f.id, f.score, path, title, trust, volatile, freshness, description, resource, source, authored, write_actor, {ZONE} AS zone, query FROM fused f JOIN pages p ON p.id = f.id JOIN asked a ON a.qid = f.qid),
adj AS (SELECT qid, id, path, title, trust, volatile, freshness, description, resource, source, authored, write_actor, zone, round(score, 9) AS score, round(score
  * CASE trust WHEN 'trusted' THEN 1.0 WHEN 'derived' THEN 0.95 ELSE 0.85 END
  * CASE zone WHEN 'output' THEN CASE WHEN list_contains({FOLDERS}, 'out_distill') THEN {R.DISTILLED} ELSE 0.7 END WHEN 'incoming' THEN 0.8 ELSE 1.0 END
  * CASE WHEN trim(query) <> '' AND (lower(trim(query)) = lower(trim(coalesce(title, ''))) OR lower(trim(query)) = lower(string_split(id, '/')[-1])) THEN 1.5 ELSE 1.0 END, 12) AS adj FROM rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY adj DESC, score DESC, id) AS pos FROM adj)"""
COLLAPSED = """
grp AS (SELECT *, CASE WHEN volatile AND freshness IS NOT NULL THEN floor(freshness / 86400) END AS day, lower(trim(coalesce(title, ''))) AS key FROM placed),
win AS (SELECT *, min(pos) OVER g AS slot, count(*) OVER g AS n, first_value(day) OVER (g ORDER BY pos) AS head, max(day) OVER g AS top FROM grp WINDOW g AS (PARTITION BY qid, coalesce(trust, 'untrusted'), zone, key)),
kept AS (SELECT * FROM win WHERE CASE WHEN head IS NULL THEN pos = slot ELSE day = top END QUALIFY row_number() OVER (PARTITION BY qid, coalesce(trust, 'untrusted'), zone, key ORDER BY pos) = 1)"""
TIED = f"""
nr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY slot) AS i FROM kept),
runs AS (SELECT qid, i, adj AS head, 1 AS run FROM nr WHERE i = 1 UNION ALL
  SELECT n.qid, n.i, CASE WHEN abs(r.head - n.adj) > {R.TIE} THEN n.adj ELSE r.head END, r.run + CASE WHEN abs(r.head - n.adj) > {R.TIE} THEN 1 ELSE 0 END FROM runs r JOIN nr n ON n.qid = r.qid AND n.i = r.i + 1),
mixed AS (SELECT nr.*, run, max(coalesce(volatile, FALSE)::INT) OVER (PARTITION BY nr.qid, run) AS mixed FROM nr JOIN runs USING (qid, i)),
final AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY run, CASE WHEN mixed = 1 THEN freshness END DESC NULLS LAST, slot) AS place FROM mixed)"""
SHAPE = """SELECT qid, place::INT AS rank, id, path, title, round(score, 6) AS score, coalesce(trust, 'untrusted') AS trust, CASE WHEN volatile THEN TRUE END AS volatile,
  strftime(to_timestamp(floor(freshness)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS freshness, CASE WHEN n > 1 THEN n - 1 END::INT AS duplicates,
  description, resource, source, strftime(make_timestamp(floor(authored * 1000)::BIGINT * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS authored, write_actor FROM final WHERE place <= 5"""


def chain(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + "\n"


TO_TERMS = (LAST, CHUNKS, ASKED, TERMS)
TO_FTS = (*TO_TERMS, POSTINGS, BM25)
TO_SEEDS = (*TO_FTS, VEC, SEEDS, EDGES)
TO_FUSED = (*TO_SEEDS, OUT, graph_list("SELECT * FROM outs"), fuse(A.RRF_K))
TO_FINAL = (*TO_FUSED, ADJUSTED, COLLAPSED, TIED)
