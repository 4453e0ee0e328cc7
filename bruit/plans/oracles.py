"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from bruit.sources.views import sql

ORACLES: dict[str, str] = {}


def add(name: str, body: str, more: str = "") -> None:
    ORACLES[name] = sql(body, more)


EPOCH = "CAST(epoch({}) AS BIGINT)"
TOTAL = "round(list_sum({}), 6)"

# --- sources and sinks
add("scan_tweets", "SELECT id, time, round(lon, 6) AS lon, round(lat, 6) AS lat, exact, uid, text FROM tweets_v")
add("stream_ingest", "SELECT id, uid, text FROM tweets_v WHERE lon BETWEEN -130 AND -65 AND lat BETWEEN 20 AND 55")
TOKENS = """
known AS (SELECT token, list_transform(range(1, 9), lambda k: ((length(token) * k + ascii(token)) % 17) / CAST(17 AS DOUBLE)) AS vector
          FROM (SELECT DISTINCT unnest(words) AS token FROM words_v) WHERE length(token) % 5 <> 0),
occur AS (SELECT id, unnest(words) AS token, unnest(range(len(words))) AS pos FROM words_v),
vecs AS (SELECT o.id, CAST(o.pos AS INT) AS pos, o.token, coalesce(k.vector, [0.0, 0, 0, 0, 0, 0, 0, 0]) AS v FROM occur o LEFT JOIN known k USING (token))
"""
add("load_token_vectors", f"SELECT token, {TOTAL.format('vector')} AS total, 8 AS n FROM known", TOKENS)
add("parse_json_vector", f"SELECT id, len(vector) AS n, {TOTAL.format('vector')} AS total FROM tweets_v")
add("load_seed_vectors", f"SELECT seed_idx, len(vector) AS n, {TOTAL.format('vector')} AS total FROM seeds_v")
add("pending_batch", "SELECT id, 1 AS status, count(*) OVER () AS pending FROM tweets_v WHERE id % 2 = 0")
add("export_labelled", "SELECT id, text FROM tweets_v JOIN props_v ON tweet_id = id WHERE crowdflower IS NOT NULL")
HIT = "list_has_any(words, ['the', 'der', 'que', 'les'])"
add("score_votes", f"SELECT id AS tweet_id, '0.0.0.0' AS user_ip, {HIT} AS disaster FROM words_v WHERE len(words) > 0")
add("positives", f"SELECT id, text FROM words_v WHERE len(words) > 0 AND {HIT}")
add("tagger_batch", "SELECT tweet_id, 'tagger' AS model_id, text FROM (SELECT tweet_id FROM props_v WHERE tagger_train ORDER BY tweet_id LIMIT 100) JOIN tweets_v ON id = tweet_id")

# --- filters and projections
add("bbox_filter", "SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM tweets_v WHERE lon BETWEEN -120 AND -80 AND lat BETWEEN 25 AND 45")
add("time_slice", "SELECT id, time FROM tweets_v WHERE time >= TIMESTAMP '2024-01-01 12:00:00' AND time < TIMESTAMP '2024-01-02 12:00:00'")
add("nonempty_words", "SELECT id, len(words) AS n FROM words_v WHERE len(words) > 0")
add("retention", "SELECT id, time FROM tweets_v WHERE epoch((SELECT max(time) FROM tweets_v)) - epoch(time) < 86400")
add("training_set", "SELECT id, crowdflower AS label FROM tweets_v JOIN props_v ON tweet_id = id WHERE random_forest_train AND crowdflower IS NOT NULL")
add("geo_project", "SELECT id, printf('POINT(%.6f %.6f)', lon, lat) AS wkt, round(lon, 6) AS x, round(lat, 6) AS y FROM tweets_v")
add("allowed_votes", "SELECT seq, tweet_id, user_ip, property FROM votes_v WHERE tweet_id <> 0 AND user_ip IN ('0.0.0.0', '1.1.1.1', '10.0.0.2', '10.0.0.3', '10.0.0.6')")
CELLS = "cells AS (SELECT *, CAST(floor((lon + CAST(180 AS DOUBLE)) / CAST(0.2 AS DOUBLE)) AS BIGINT) AS x, CAST(floor((lat + CAST(90 AS DOUBLE)) / CAST(0.2 AS DOUBLE)) AS BIGINT) AS y FROM words_v)"
add("grid_cell", "SELECT id, x, y FROM cells", CELLS)
add("cell_region", "SELECT x, y, (least(x + 5, 1799) - greatest(x - 5, 0) + 1) * (least(y + 5, 899) - greatest(y - 5, 0) + 1) AS n, greatest(x - 5, 0) AS x0, least(y + 5, 899) AS y1 FROM (SELECT DISTINCT x, y FROM cells)", CELLS)
add("final_rows", "SELECT tweet_id, crowdflower FROM props_v WHERE tagger_train AND NOT spam")

# --- joins
add("tweets_with_props", "SELECT id, crowdflower, spam, random_forest_train FROM tweets_v LEFT JOIN props_v ON tweet_id = id")
add("feed_breaking", "SELECT id, text FROM tweets_v JOIN state_v ON tweet_id = id WHERE user_ip = '0.0.0.0' AND disaster ORDER BY id DESC LIMIT 20")
QUEUE = """queue AS (SELECT t.* FROM tweets_v t JOIN state_v c ON c.tweet_id = t.id AND c.user_ip = '1.1.1.1'
  LEFT JOIN state_v m ON m.tweet_id = t.id AND m.user_ip = '10.0.0.2' WHERE m.submit IS NULL OR NOT m.submit)"""
add("to_tag_queue", "SELECT id, text FROM queue ORDER BY id DESC LIMIT 20", QUEUE)
add("to_tag_count", "SELECT count(*) AS n FROM queue", QUEUE)
PAIRS = CELLS + """,
occ AS MATERIALIZED (SELECT DISTINCT id, unnest(words) AS word FROM cells),
wid AS MATERIALIZED (SELECT word, CAST(row_number() OVER () AS INT) AS w FROM (SELECT DISTINCT word FROM occ)),
sets AS MATERIALIZED (SELECT id, x, y, vector, ws FROM cells LEFT JOIN (SELECT id, list(w) AS ws FROM occ JOIN wid USING (word) GROUP BY id) USING (id)),
place AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM (SELECT id, x, y FROM sets) a JOIN (SELECT id, x, y FROM sets) b
         ON a.id < b.id AND abs(a.x - b.x) <= 5 AND abs(a.y - b.y) <= 5),
cand AS (SELECT p.a, p.b, s.vector AS va, t.vector AS vb FROM place p JOIN sets s ON s.id = p.a JOIN sets t ON t.id = p.b WHERE list_has_any(s.ws, t.ws))"""
add("candidate_pairs", "SELECT a, b FROM cand", PAIRS)
add("seed_candidates", "SELECT seed_idx, id FROM seeds_v CROSS JOIN tweets_v")
add("token_vectors", "SELECT id, pos, token, round(v[1], 6) AS v0, round(v[8], 6) AS v7 FROM vecs", TOKENS)
add("vote_upsert", "SELECT * FROM state_v")
add("props_upsert", """SELECT coalesce(p.tweet_id, c.tweet_id) AS tweet_id, CASE WHEN p.tweet_id IS NOT NULL THEN p.crowdflower ELSE c.given END AS crowdflower,
  c.tweet_id IS NOT NULL OR coalesce(p.random_forest_train, false) AS random_forest_train
FROM props_v p FULL JOIN (SELECT tweet_id, value AS given FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY seq) AS rn
  FROM votes_v WHERE user_ip = '1.1.1.1' AND property = 'disaster') WHERE rn = 1) c ON c.tweet_id = p.tweet_id""")
add("orphans", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT id FROM tweets_v)")
add("cascade_delete", "SELECT seq, tweet_id FROM votes_v WHERE tweet_id NOT IN (SELECT id FROM tweets_v WHERE id % 10 = 0)")
add("set_null", "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type FROM events")
add("rename_source", "SELECT doc_id, CASE WHEN source LIKE '%1' THEN 'feed-' || source ELSE source END AS source FROM documents")
LATEST = """latest AS (SELECT tweet_id, user_ip, property, value FROM (SELECT *, row_number() OVER
  (PARTITION BY tweet_id, user_ip, property ORDER BY seq DESC) AS rn FROM votes_v) WHERE rn = 1)"""
add("vote_descriptions", "SELECT tweet_id, user_ip, property, CASE WHEN value THEN property || ': yes' WHEN NOT value THEN property || ': no' END AS description FROM latest", LATEST)

# --- aggregates
add("high_water", f"SELECT {EPOCH.format('max(time)')} - 1 AS high_water FROM tweets_v")
add("label_counts", "SELECT crowdflower, count(*) AS n FROM props_v GROUP BY crowdflower")
TOK = "tok AS (SELECT id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS w FROM texts_v)"
add("corpus_stats", "SELECT (SELECT count(*) FROM x) AS tokens, (SELECT count(DISTINCT w) FROM x) AS vocabulary, (SELECT max(len(w)) FROM tok) AS longest", TOK + ", x AS (SELECT unnest(w) AS w FROM tok)")
add("length_histogram", """SELECT CAST(k AS INT) AS bin, round(lo + (hi - lo) * k / 10.0, 6) AS low, round(lo + (hi - lo) * (k + 1) / 10.0, 6) AS high,
  (SELECT count(*) FROM tok WHERE least(floor((len(w) - lo) / ((hi - lo) / CAST(10 AS DOUBLE))), 9) = k) AS n
FROM (SELECT min(len(w)) AS lo, max(len(w)) AS hi FROM tok) CROSS JOIN (SELECT unnest(range(10)) AS k)""", TOK)
add("tfidf", """SELECT id, word, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)), 6) AS weight
FROM (SELECT f.id, f.word, f.tf * (ln((1 + (SELECT count(*) FROM texts_v)) / (1 + CAST(df AS DOUBLE))) + 1) AS raw
      FROM f JOIN (SELECT word, count(*) AS df FROM f GROUP BY word) USING (word))""",
    """f AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS word FROM texts_v)
      WHERE length(word) >= 2 GROUP BY id, word)""")
RATE = """per AS (SELECT *, CAST(floor(epoch(time) / 21600) AS BIGINT) AS period, CAST(floor((lon + CAST(180 AS DOUBLE)) / 2.0::DOUBLE) AS BIGINT) AS x,
               CAST(floor((lat + CAST(90 AS DOUBLE)) / 2.0::DOUBLE) AS BIGINT) AS y FROM words_v),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, uid ORDER BY time DESC, id DESC) AS rn FROM per) WHERE rn = 1),
cc AS (SELECT period, x, y, count(*) AS n FROM one GROUP BY ALL),
wc AS (SELECT period, x, y, word, count(*) AS n FROM (SELECT period, x, y, unnest(list_distinct(words)) AS word FROM one) GROUP BY ALL),
r AS (SELECT period, x, y, word, wc.n / CAST(cc.n AS DOUBLE) AS local_rate, g.hits / CAST(g.total AS DOUBLE) AS global_rate
      FROM wc JOIN cc USING (period, x, y) JOIN (SELECT period, word, sum(n) AS hits, any_value(total) AS total
        FROM wc JOIN (SELECT period, sum(n) AS total FROM cc GROUP BY period) USING (period) GROUP BY period, word) g USING (period, word)),
h0 AS (SELECT *, period - (SELECT min(period) FROM r) AS k, coalesce(sum(local_rate) OVER w, 0) AS s, coalesce(sum(local_rate * local_rate) OVER w, 0) AS q
       FROM r WINDOW w AS (PARTITION BY word, x, y ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CASE WHEN k > 0 THEN s / k END AS mean, CASE WHEN k > 0 THEN sqrt(greatest(q / k - (s / k) * (s / k), 0)) END AS sd FROM h0),
st AS (SELECT i, j, (2 - abs(i)) * (2 - abs(j)) / CAST(16 AS DOUBLE) AS w FROM (SELECT unnest([-1, 0, 1]) AS i) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS j))"""
add("one_per_user", "SELECT period, uid, id FROM one", RATE)
add("cell_counts", "SELECT * FROM cc", RATE)
add("word_cell_counts", "SELECT * FROM wc", RATE)
add("word_rates", "SELECT period, x, y, word, round(local_rate, 6) AS local_rate, round(global_rate, 6) AS global_rate FROM r", RATE)
add("word_history", "SELECT period, x, y, word, round(mean, 6) AS mean, round(sd, 6) AS sd FROM h", RATE)
add("grid_blur", "SELECT x + i AS x, y + j AS y, round(sum(n * w), 6) AS n FROM (SELECT x, y, sum(n) AS n FROM cc GROUP BY x, y) CROSS JOIN st GROUP BY x + i, y + j", RATE)
add("burst_events", """SELECT h.period, h.x, h.y, h.word, round(local_rate, 6) AS local_rate, round(global_rate, 6) AS global_rate, round(mean, 6) AS mean, round(sd, 6) AS sd, round(blurred, 6) AS blurred
FROM h JOIN (SELECT period, word, x + i AS x, y + j AS y, sum(local_rate * w) AS blurred FROM r CROSS JOIN st GROUP BY ALL) b USING (period, word, x, y)
JOIN (SELECT period, word, stddev_pop(local_rate) AS space_sd FROM r GROUP BY ALL) s USING (period, word)
WHERE local_rate > greatest(mean * 1.1::DOUBLE, mean + sd) AND blurred > greatest(global_rate * 1.1::DOUBLE, global_rate + 3 * space_sd) AND mean IS NOT NULL""", RATE)
CONS = LATEST + ", cons AS (SELECT tweet_id, property, value, count(*) AS votes FROM latest WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) > 3)"
add("label_consensus", "SELECT * FROM cons", CONS)
add("user_points", """SELECT user_ip, CAST(sum(1 + CASE WHEN y.votes IS NOT NULL THEN 1 ELSE 0 END - CASE WHEN n.votes IS NOT NULL THEN 1 ELSE 0 END)
  * CASE WHEN length(user_ip) % 3 >= 1 THEN 2 ELSE 1 END AS BIGINT) AS points
FROM latest l LEFT JOIN cons y ON y.tweet_id = l.tweet_id AND y.property = l.property AND y.value = l.value
LEFT JOIN cons n ON n.tweet_id = l.tweet_id AND n.property = l.property AND n.value <> l.value WHERE l.value IS NOT NULL GROUP BY user_ip""", CONS)
add("whitelist_after_lock", """SELECT user_ip, tweet_id, property FROM (SELECT DISTINCT user_ip, tweet_id FROM votes_v) CROSS JOIN
  (SELECT unnest(['spam', 'disaster', 'event', 'informative', 'submit']) AS property) p
WHERE NOT EXISTS (SELECT 1 FROM cons c WHERE c.tweet_id = votes_v.tweet_id AND c.property = p.property)""".replace("FROM (SELECT DISTINCT user_ip, tweet_id FROM votes_v)", "FROM (SELECT DISTINCT user_ip, tweet_id FROM votes_v) votes_v"), CONS)

# --- feeds
add("latest_texts", "SELECT id, text FROM tweets_v ORDER BY id DESC LIMIT 100")
add("feed_all", "SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, text FROM tweets_v ORDER BY id DESC LIMIT 50")
add("feed_events", """SELECT 'all' AS source, id, round(lon, 6) AS lon, round(lat, 6) AS lat, 0 AS count FROM (SELECT * FROM tweets_v ORDER BY id DESC LIMIT 50)
UNION ALL SELECT 'breaking', id, round(lon, 6), round(lat, 6), 0 FROM (SELECT t.* FROM tweets_v t JOIN state_v ON tweet_id = id WHERE user_ip = '0.0.0.0' AND disaster ORDER BY id DESC LIMIT 20)
UNION ALL SELECT 'crowdflower', id, round(lon, 6), round(lat, 6), (SELECT count(*) FROM queue) FROM (SELECT * FROM queue ORDER BY id DESC LIMIT 20)""", QUEUE)
add("queue_page", "SELECT id, text FROM tweets_v WHERE id > 20 AND id NOT IN (SELECT tweet_id FROM votes_v WHERE user_ip = '10.0.0.2') ORDER BY id LIMIT 20")

# --- scalar functions
add("clean_words", r"""SELECT doc_id, array_to_string(list_filter(string_split(trim(lower(regexp_replace(regexp_replace(text, '((\B@)|(\bhttps?:\/\/))[^\s]+', ' ', 'g'),
  '[^\w]+', ' ', 'g'))), ' '), lambda w: w <> ''), ' ') AS words FROM documents""")
add("word_set", "SELECT id, array_to_string(list_sort(list_distinct(words)), ' ') AS words FROM words_v")
from bruit.functions.text import FOLD_FROM, FOLD_TO  # noqa: E402

FOLD = "regexp_replace(translate(replace(replace(replace({}, 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '" + FOLD_FROM + "', '" + FOLD_TO + r"'), '[^\x00-\x7F]', '', 'g')"
add("ascii_fold", f"SELECT id, {FOLD.format('text')} AS folded FROM texts_v")
add("epoch_roundtrip", f"SELECT id, {EPOCH.format('time')} AS epoch, CAST(time AS TIMESTAMP) AS back FROM tweets_v")
DIST = "round(greatest(1 - list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))), 0), 9)"
add("cosine_distance", f"SELECT t.id, seed_idx, round({DIST.format('t.vector', 's.vector')}, 6) AS dist FROM seeds_v s CROSS JOIN tweets_v t")
MEANS = ", ".join(f"round(coalesce(avg(v[{k + 1}]), 0), 6) AS v{k}" for k in range(8))
add("doc_vectors", f"SELECT t.id, {MEANS} FROM texts_v t LEFT JOIN vecs USING (id) GROUP BY t.id", TOKENS)


# --- density
def graph(eps: float, seeded: bool = True) -> str:
    seed = f"UNION ALL SELECT CAST(-seed_idx - 1 AS BIGINT), t.id, {DIST.format('s.vector', 't.vector')} FROM seeds_v s CROSS JOIN tweets_v t" if seeded else ""
    return PAIRS + f""",
near AS MATERIALIZED (SELECT * FROM (SELECT a, b, {DIST.format('va', 'vb')} AS dist FROM cand {seed}) WHERE dist <= {eps}),
edge AS MATERIALIZED (SELECT a AS src, b AS dst, dist FROM near UNION ALL SELECT b, a, dist FROM near),
core AS MATERIALIZED (SELECT t.id, coalesce(k.dist, CAST({eps} AS DOUBLE) + 1) AS core FROM tweets_v t LEFT JOIN (SELECT src, dist FROM
  (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM edge WHERE src >= 0) WHERE rn = 3) k ON k.src = t.id),
other AS (SELECT e.src, e.dst, e.dist, CASE WHEN e.dst < 0 THEN 0 ELSE c.core END AS oc FROM edge e LEFT JOIN core c ON c.id = e.dst AND c.core <= {eps}
          WHERE e.src >= 0 AND (e.dst < 0 OR c.id IS NOT NULL)),
reach AS MATERIALIZED (SELECT t.id, coalesce(r, CAST({eps} AS DOUBLE) + 1) AS reach FROM tweets_v t LEFT JOIN (SELECT src, min(greatest(dist, oc)) AS r FROM other GROUP BY src) o ON o.src = t.id),
cores AS MATERIALIZED (SELECT id FROM core WHERE core <= {eps}),
ce AS MATERIALIZED (SELECT src, dst FROM edge WHERE src IN (SELECT id FROM cores) AND dst IN (SELECT id FROM cores)),
lab AS (SELECT id, id AS label FROM cores UNION SELECT ce.dst, lab.label FROM lab JOIN ce ON ce.src = lab.id),
comp AS MATERIALIZED (SELECT id, min(label) AS label FROM lab GROUP BY id),
touch AS (SELECT src AS id, -dst - 1 AS s FROM edge WHERE dst < 0),
owned AS MATERIALIZED (SELECT c.id, o.s FROM comp c JOIN (SELECT label, min(s) AS s FROM comp JOIN touch USING (id) GROUP BY label) o USING (label)),
mem AS MATERIALIZED (SELECT id, s FROM owned UNION ALL SELECT id, min(s) FROM (SELECT * FROM touch UNION ALL SELECT e.src, o.s FROM edge e JOIN owned o ON o.id = e.dst WHERE e.src >= 0)
        WHERE id NOT IN (SELECT id FROM cores) GROUP BY id)"""


def clustered(eps: float) -> str:
    cut = min(eps, 0.45)
    return graph(eps) + f""",
m AS MATERIALIZED (SELECT mem.id, s FROM mem JOIN reach USING (id) WHERE reach BETWEEN 0 AND 0.45),
node AS MATERIALIZED (SELECT m.id, s, c.core <= {cut} AS ic FROM m JOIN core c USING (id) UNION ALL SELECT DISTINCT -s - 1, s, true FROM m),
ie AS MATERIALIZED (SELECT e.src, e.dst, a.ic AS c1, b.ic AS c2 FROM edge e JOIN node a ON a.id = e.src JOIN node b ON b.id = e.dst AND b.s = a.s WHERE e.dist <= {cut}),
l2 AS (SELECT id, id AS label FROM node WHERE ic UNION SELECT ie.dst, l2.label FROM l2 JOIN ie ON ie.src = l2.id AND c1 AND c2),
c2 AS MATERIALIZED (SELECT id, min(label) AS label FROM l2 GROUP BY id),
clus AS MATERIALIZED (SELECT id, CAST(s AS INT) AS seed_idx, label FROM m JOIN (SELECT id, label FROM c2 WHERE id >= 0 UNION ALL
   SELECT src, min(label) FROM ie JOIN c2 ON c2.id = ie.dst WHERE ie.c2 AND NOT ie.c1 GROUP BY src) USING (id)),
acc AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seed_idx, label) - 1 AS event_id FROM (SELECT seed_idx, label, count(*) AS size, count(DISTINCT uid) AS users
   FROM clus JOIN tweets_v USING (id) GROUP BY seed_idx, label HAVING count(*) >= 4 AND count(DISTINCT uid) >= 2)),
summ AS MATERIALIZED (SELECT event_id, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, min(time) AS start_time, max(time) AS end_time, count(DISTINCT uid) AS users
   FROM clus JOIN acc USING (seed_idx, label) JOIN tweets_v USING (id) GROUP BY event_id)"""


add("neighbor_edges", "SELECT src, dst, round(dist, 6) AS dist FROM edge", graph(0.2))
add("core_distance", "SELECT id, round(core, 6) AS core FROM core", graph(0.2))
add("reachability", "SELECT id, round(reach, 6) AS reach FROM reach", graph(0.2))
add("reachability_as_written", """SELECT t.id, round(coalesce(r, CAST(0.2 AS DOUBLE) + 1), 6) AS reach FROM tweets_v t LEFT JOIN
  (SELECT o.src, min(CASE WHEN dist > oc THEN dist ELSE c.core END) AS r FROM other o JOIN core c ON c.id = o.src GROUP BY o.src) x ON x.src = t.id""", graph(0.2))
add("non_noise", "SELECT id FROM reach WHERE reach <= 0.2", graph(0.2))
add("seed_membership", "SELECT id, CAST(s AS INT) AS seed_idx FROM mem", graph(0.2))
add("seed_membership_wide", "SELECT id, CAST(s AS INT) AS seed_idx FROM mem", graph(0.85))
add("clusters", "SELECT id, seed_idx, label FROM clus", clustered(0.2))
add("clusters_wide", "SELECT id, seed_idx, label FROM clus", clustered(0.85))
add("clusters_unseeded", """SELECT id, label FROM comp UNION ALL SELECT src, min(label) FROM edge JOIN comp ON comp.id = edge.dst
  WHERE src NOT IN (SELECT id FROM cores) GROUP BY src""", graph(0.2, seeded=False))
add("accepted_clusters", "SELECT event_id, seed_idx, size, users FROM acc", clustered(0.2))
add("event_summary", "SELECT * FROM summ", clustered(0.2))
add("publish_events", "SELECT * FROM summ", clustered(0.2))
add("event_tweets", """SELECT event_id, t.id AS tweet_id, t.time, s.lat, s.lon, t.exact, t.text FROM clus JOIN acc USING (seed_idx, label) JOIN summ s USING (event_id)
  JOIN tweets_v t ON t.id = clus.id""", clustered(0.2))
add("incremental_update", "SELECT id, round(core, 6) AS core FROM core WHERE id % 10 <> 2", graph(0.2, seeded=False).replace("FROM tweets_v t LEFT JOIN (SELECT src", "FROM (SELECT * FROM tweets_v WHERE id % 10 <> 2) t LEFT JOIN (SELECT src").replace("ON a.id < b.id", "ON a.id % 10 <> 2 AND b.id % 10 <> 2 AND a.id < b.id"))

# --- streams
add("stream_word_counts", "SELECT start, x, y, word, count(*) AS n FROM (SELECT CAST(date_trunc('day', time) AS TIMESTAMP) AS start, x, y, unnest(list_distinct(words)) AS word FROM per) GROUP BY ALL", RATE)
add("stream_scored", f"SELECT id, spam, {HIT} AS disaster FROM words_v LEFT JOIN props_v ON tweet_id = id")
RECENTLY = "tweets_v AS (SELECT * FROM every_v WHERE epoch((SELECT max(time) FROM every_v)) - epoch(time) < 172800),\nwords_v AS ("
ORACLES["stream_events"] = ORACLES["event_summary"].replace("tweets_v AS (", "every_v AS (", 1).replace("words_v AS (", RECENTLY, 1)
ORACLES["stream_events_kept"] = ORACLES["stream_events"]
ORACLES["vote_state"] = ORACLES["vote_upsert"]
# A row of a batch is late against the newest time of all batches before; ids come again only in the batch after.
add("stream_late_rows", """SELECT batch, CASE WHEN time < mark THEN 'late' WHEN again AND seen THEN 'duplicate' ELSE 'accepted' END AS kind, id, 1 AS n
FROM (SELECT b.*, mark, CASE b.batch WHEN 1 THEN true WHEN 2 THEN b.time >= first_mark ELSE false END AS seen
  FROM sent b CROSS JOIN (SELECT max(mark) FILTER (WHERE batch = 1) AS first_mark FROM marks) LEFT JOIN marks m ON m.batch = b.batch)""",
    """sent AS (SELECT 0 AS batch, id, time, false AS again FROM tweets_v WHERE id % 6 < 2 UNION ALL
  SELECT 1, id, time, id % 6 = 1 FROM tweets_v WHERE id % 6 IN (1, 2, 3) UNION ALL SELECT 2, id, time, id % 6 = 3 FROM tweets_v WHERE id % 6 > 2),
marks AS (SELECT k AS batch, (SELECT max(time) - INTERVAL 1 DAY FROM sent WHERE sent.batch < k) AS mark FROM (SELECT unnest([1, 2]) AS k))""")
add("stream_word_windows", """SELECT CAST(start AS TIMESTAMP) AS start, x, y, word, count(*) AS n FROM (SELECT x, y, time, unnest(list_distinct(words)) AS word FROM per) w
  JOIN (SELECT DISTINCT date_trunc('day', time) - k * INTERVAL 1 DAY AS start FROM per CROSS JOIN (SELECT unnest([0, 1]) AS k)) s ON time >= start AND time < start + INTERVAL 2 DAY
WHERE start + INTERVAL 2 DAY <= (SELECT max(time) FROM per) - INTERVAL 1 HOUR GROUP BY ALL""", RATE)
