"""Registered queries of sweeps, verification, pixels, logs and keyed state, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from timelens import bindings as b
from timelens.functions import text as tx
from timelens.operators import delivery, deepscan, statechange, verify
from timelens.plans import planner
from timelens.queries import _FUSED, _Q, _WATCH, _score, QUERY, _pool, query
from timelens.session import checkpoint
from timelens.sources import media, migrations, trace, uris, vendor_log, versions
from timelens.streaming import watch

# Deep scan

#: What stands for a captioner and a normaliser in the queries: labels by arithmetic.
TARGET = "the girl's dress (color and style)"
LABELS = ("red silk dress", "red dress", "blue coat", "none", "Striped shirt.")
STATES = {"red silk dress": "red dress", "Striped shirt.": "OTHER"}


def _captioner():
    def label(r: dict) -> str | None:
        n = 31 * int(r["video_id"]) + int(r["timestamp"])
        return None if n % 13 == 0 else f" {LABELS[n % 5]}\n"

    return lambda rows: [label(r) for r in rows]


def _normaliser():
    return lambda subject, labels, timeline: {k: v for k, v in STATES.items() if k in labels} if "blue coat" in labels else {}


def _clips(s, d):
    return b.load(s, d, "documents").select(F.col("doc_id").alias("video_id"), F.col("source").alias("local_path"), (F.col("n_chars") / 7.3 + 0.0011).alias("duration_seconds"))


def _cuts(s, d):
    """Every third clip has no segments."""
    return b.segments(s, d).filter("video_id % 3 <> 0").withColumn("end_time", F.col("start_time") + F.col("end_time") / 5)


def _cached(s, d):
    """Clips of one language were swept before."""
    wanted = deepscan.keyed(_clips(s, d).withColumn("scan_target", F.lit(TARGET)), "stub")
    seen = b.load(s, d, "documents").filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("video_id"))
    return seen.join(wanted, "video_id").select("video_id", "prompt_key", F.lit(1.0).alias("timestamp"), F.lit("swept before").alias("text"))


def _swept(s, d):
    clips = _clips(s, d)
    wanted = deepscan.keyed(clips.withColumn("scan_target", F.lit(TARGET)), "stub")
    held, fresh = deepscan.sweep(wanted, _cached(s, d), deepscan.frame_times(clips, _cuts(s, d)), clips, _captioner)
    return wanted, held, fresh


_SWEPT = f"""{b.SEGMENTS}, cuts AS (SELECT video_id, start_time, start_time + end_time / 5 AS end_time FROM segments WHERE video_id % 3 <> 0),
clips AS (SELECT doc_id AS video_id, n_chars / 7.3::DOUBLE + 0.0011::DOUBLE AS seconds, lang IS NOT DISTINCT FROM 'en' AS cached FROM documents),
stamps AS (SELECT DISTINCT video_id, round(unnest(CASE WHEN end_time - start_time <= 15 THEN [(start_time + end_time) / 2]
  ELSE list_filter(list_transform(range(0, ceil((end_time - start_time) / 4)::BIGINT + 1), lambda i: start_time + 2.0::DOUBLE + i * 4.0::DOUBLE), lambda t: t < end_time) END), 2) AS timestamp FROM cuts),
placed AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM stamps),
times AS (SELECT video_id, timestamp FROM placed WHERE n <= 120 OR list_contains(list_transform(range(0, 120), lambda k: floor(k * n / 120)::BIGINT), i)
  UNION ALL SELECT video_id, round(unnest(range(0, floor(seconds / step)::BIGINT + 1)) * step, 2) FROM (SELECT *, greatest(1.0::DOUBLE, CASE WHEN seconds > 0 THEN seconds / 120 ELSE 1.0 END) AS step FROM clips WHERE video_id % 3 = 0)),
swept AS (SELECT video_id::VARCHAR AS video_id, timestamp, ['red silk dress', 'red dress', 'blue coat', 'none', 'Striped shirt.'][(31 * video_id + floor(timestamp)::BIGINT) % 5 + 1] AS text, false AS cached
  FROM times JOIN clips USING (video_id) WHERE NOT cached AND (31 * video_id + floor(timestamp)::BIGINT) % 13 <> 0
  UNION ALL SELECT video_id::VARCHAR, 1.0::DOUBLE, 'swept before', true FROM clips WHERE cached)"""


@query("f19_sweep", f"WITH {_SWEPT} SELECT video_id, left(sha1('v5|dre-girl|120|1.0|stub'), 16) AS prompt_key, timestamp, text, cached FROM swept")
def f19_sweep(s, d):
    _, held, fresh = _swept(s, d)
    return held.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))


_STATE_OF = "CASE WHEN bool_or(text = 'blue coat') OVER (PARTITION BY video_id) THEN CASE text WHEN 'red silk dress' THEN 'red dress' WHEN 'Striped shirt.' THEN 'OTHER' ELSE text END ELSE text END"


@query("f20_states", f"WITH {_SWEPT} SELECT video_id, timestamp, {_STATE_OF} AS text FROM swept")
def f20_states(s, d):
    wanted, held, fresh = _swept(s, d)
    seen = checkpoint(held.unionByName(fresh))
    return deepscan.with_states(seen, deepscan.normalised(seen, wanted, _normaliser)).select("video_id", "timestamp", "text")


def _folded(with_: str, seen: str) -> str:
    """Runs of a timeline ``seen`` (video_id, timestamp, text) as a recursive fold: equal labels, then alike ones, then flicker."""
    return f"""WITH RECURSIVE {with_}, seen AS ({seen}),
visible AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS state FROM seen WHERE NOT regexp_matches(text, '^\\s*(none|n/?a|other|not visible|no \\w+)\\s*\\.?\\s*$', 'i')),
c1 AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY video_id ORDER BY timestamp, text) THEN 0 ELSE 1 END AS fresh FROM visible),
c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY timestamp, text ROWS UNBOUNDED PRECEDING) AS run FROM c1),
runs AS (SELECT video_id, run::BIGINT AS run, state, list_distinct(list_filter(string_split(state, ' '), lambda w: w <> '')) AS words, min(timestamp) AS t0, max(timestamp) AS t1 FROM c2 GROUP BY 1, 2, 3),
alike AS (SELECT video_id, run, [{{'s': state, 'w': words, 'a': t0, 'b': t1}}] AS st FROM runs WHERE run = 1 UNION ALL
  SELECT f.video_id, r.run, CASE WHEN len(list_distinct(list_concat(st[len(st)].w, r.words))) > 0 AND len(list_intersect(st[len(st)].w, r.words)) / len(list_distinct(list_concat(st[len(st)].w, r.words))) >= 0.6
    THEN list_append(st[1:len(st) - 1], {{'s': st[len(st)].s, 'w': st[len(st)].w, 'a': st[len(st)].a, 'b': r.t1}}) ELSE list_append(st, {{'s': r.state, 'w': r.words, 'a': r.t0, 'b': r.t1}}) END
  FROM alike f JOIN runs r ON r.video_id = f.video_id AND r.run = f.run + 1),
merged AS (SELECT * FROM alike QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY run DESC) = 1),
steady AS (SELECT video_id, run, st AS rest, 2 AS pos, [st[1]] AS st FROM merged UNION ALL
  SELECT video_id, run, rest, pos + 1, CASE WHEN len(st) >= 2 AND st[len(st)].a = st[len(st)].b AND st[len(st) - 1].s = rest[pos].s
    THEN list_append(st[1:len(st) - 2], {{'s': st[len(st) - 1].s, 'w': st[len(st) - 1].w, 'a': st[len(st) - 1].a, 'b': rest[pos].b}}) ELSE list_append(st, rest[pos]) END
  FROM steady WHERE pos <= len(rest)),
final AS (SELECT video_id, run, st FROM steady QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY pos DESC) = 1)"""


@query("f19_counted", f"""{_folded(_SWEPT, f"SELECT video_id, timestamp, {_STATE_OF} AS text FROM swept")},
f AS (SELECT video_id, count(*) AS frames, min(timestamp) AS time_start, max(timestamp) AS time_end, bool_and(cached) AS cached, bool_or(text = 'blue coat') AND bool_or(text IN ('red silk dress', 'Striped shirt.')) AS normalized FROM swept GROUP BY 1)
SELECT clips.video_id::VARCHAR AS video_id, coalesce(time_start, 0) AS time_start, coalesce(time_end, 0) AS time_end, coalesce(frames, 0) AS frames_scanned, coalesce(len(st) - 1, 0) AS changes_low, coalesce(run - 1, 0) AS changes_high,
  coalesce(len(list_distinct(list_transform(st, lambda x: x.s))), 0) AS distinct_states, coalesce(len(st), 0) AS total_episodes, coalesce(f.cached, false) AS cached, coalesce(normalized, false) AS normalized
FROM clips LEFT JOIN f ON f.video_id = clips.video_id::VARCHAR LEFT JOIN final ON final.video_id = clips.video_id::VARCHAR""")
def f19_counted(s, d):
    wanted, held, fresh = _swept(s, d)
    seen = checkpoint(held.unionByName(fresh))
    items = deepscan.scan_items(seen, wanted, deepscan.normalised(seen, wanted, _normaliser), held)
    facts = F.from_json("attributes", "frames_scanned bigint, changes_low bigint, changes_high bigint, distinct_states bigint, total_episodes bigint, cached boolean, normalized boolean")
    return items.filter("modality = 'deep_scan_count'").select("video_id", "time_start", "time_end", facts.alias("x")).select("video_id", "time_start", "time_end", "x.*")


@query("f19_requests", f"""WITH {b.VIDEOS}, votes AS (SELECT o_custkey AS question_id, o_orderkey % 90 AS video_id, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2),
most AS (SELECT question_id, arg_max(video_id, {{'n': n, 'first': -first}}) AS voted FROM votes GROUP BY 1),
asked AS (SELECT c_custkey AS question_id, coalesce(voted, CASE WHEN c_nationkey < 12 THEN c_nationkey END) AS video_id, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS scan_target FROM customer LEFT JOIN most ON question_id = c_custkey),
judged AS (SELECT question_id, a.video_id, scan_target, CASE WHEN v.video_id IS NULL OR v.ingest_status <> 'done' THEN 'no target video resolvable'
  WHEN coalesce(profile, CASE WHEN source_type = 'nvr_recorded' THEN 'security' ELSE 'generic' END) = 'security' THEN 'the video''s footage profile gates deep scans off'
  WHEN scan_target IS NULL THEN 'no scan target derivable from the query' END AS skipped FROM asked a LEFT JOIN videos v USING (video_id))
SELECT question_id, CASE WHEN skipped IS NULL THEN video_id END AS video_id, scan_target, skipped FROM judged""")
def f19_requests(s, d):
    questions = b.load(s, d, "customer").select(F.col("c_custkey").alias("question_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("scan_target"), F.when(F.col("c_nationkey") < 12, F.col("c_nationkey")).cast("bigint").alias("primary_video_id"))
    items = b.load(s, d, "orders").select(F.col("o_custkey").alias("question_id"), (F.col("o_orderkey") % 90).alias("video_id"), F.col("o_orderkey").alias("position"))
    videos = b.videos(s, d).withColumn("local_path", F.when(F.col("ingest_status") == "done", F.lit("clip.mp4")))
    return deepscan.scan_requests(questions, items, videos, off=("security",))


_WORDED = "SELECT video_id, timestamp, event_type || CASE WHEN event_id % 2 = 0 THEN ' state' ELSE ' state, Shown' END AS text FROM (SELECT event_id, video_id, object_class AS event_type, timestamp FROM detections)"


@query("r2_alike_states", f"""{_folded(b.DETECTIONS, _WORDED)} SELECT video_id::VARCHAR AS video_id, (len(st) - 1)::INTEGER AS changes_low, (run - 1)::INTEGER AS changes_high,
  len(list_distinct(list_transform(st, lambda x: x.s)))::INTEGER AS distinct_states FROM final""")
def r2(s, d):
    label = F.concat("object_class", F.when(F.col("event_id") % 2 == 0, " state").otherwise(" state, Shown"))
    seen = b.detections(s, d).select("video_id", F.lit("state").alias("prompt_key"), "timestamp", label.alias("text"))
    return statechange.analyze_timelines(seen).select("video_id", "changes_low", "changes_high", "distinct_states")


# Verification


@query("t9_verified", """WITH hits AS (SELECT o_orderkey, o_custkey, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS score, o_orderkey % 5 <> 0 AS readable, o_orderkey % 3 = 0 AS accepted FROM orders),
placed AS (SELECT *, score >= 0.1 AS above,
  count(*) FILTER (readable AND score >= 0.1) OVER w AS checked_before, count(*) FILTER (readable AND score >= 0.1 AND accepted) OVER w AS accepted_before FROM hits
  WINDOW w AS (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, above AND readable AND checked_before < 4 AND accepted_before < 2 AS checked FROM placed)
SELECT o_custkey, o_orderkey, score, checked FROM judged WHERE NOT checked OR accepted""")
def t9_verified(s, d):
    key = F.col("o_orderkey")
    hits = b.load(s, d, "orders").select("o_custkey", "o_orderkey", (key * 7919 % 1000 / 1000.0).alias("score"))
    answer = F.when(key % 5 != 0, key % 3 == 0)
    return verify.verify_hits(hits, "o_custkey", lambda frames: frames.withColumn("accepted", answer), ["o_orderkey"], checks=4, accepts=2)


@query("f21_presence", f"""WITH {b.VIDEOS}, {b.SEGMENTS}, middles AS (SELECT video_id, (start_time + end_time) / 2 AS t, row_number() OVER (PARTITION BY video_id ORDER BY start_time) - 1 AS i FROM segments),
times AS (SELECT video_id, t FROM middles JOIN videos USING (video_id) UNION ALL
  SELECT video_id, duration_seconds * ((unnest(range(10)) + 0.5::DOUBLE) / 10) FROM videos WHERE video_id NOT IN (SELECT video_id FROM middles))
SELECT v.video_id, count(*) FILTER ((floor(t * 10)::BIGINT + video_id) % 3 = 0) AS present FROM videos v LEFT JOIN times USING (video_id) GROUP BY 1""")
def f21(s, d):
    label = lambda frames: frames.withColumn("label", F.when((F.floor(F.col("timestamp") * 10) + F.col("video_id")) % 3 == 0, "yes").otherwise("unsure"))
    return verify.verified_presence(b.videos(s, d), b.segments(s, d), label)


# Traces: each user's events written as the lines of a run's file


def _trace_lines(s, d):
    e = b.load(s, d, "events").select("event_id", "event_type", F.concat(F.lit("ask-"), F.col("user_id").cast("string"), F.lit(".trace")).alias("path"), F.col("user_id").cast("string").alias("user"))
    head = e.select("path", "user").distinct().select("path", F.posexplode(F.array(F.concat(F.lit("# trace · ask · run-"), "user", F.lit(" · 2024-01-01T00:00:00+00:00")), F.lit(trace.LEGEND), F.lit(""))).alias("n", "value"))
    mark = F.when(F.col("event_type") == "error", "✗ ").when(F.col("event_type") == "purchase", "! ").otherwise("")
    number = F.col("event_id").cast("string")
    first = F.concat(F.lit("["), number, F.lit("] "), mark, F.lit("role/"), "event_type", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" · number "), number)).otherwise(""))
    small = F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit('     {"value": '), number, F.lit("}")))).when(F.col("event_id") % 3 == 1, F.array(F.lit("     {"), F.concat(F.lit('       "value": '), number), F.lit("     }"))).otherwise(F.array(F.lit("  {never closed"), F.lit("not indented")))
    block = F.when(F.col("event_type") == "error", F.array(F.lit("----- traceback -----"), F.lit("[01] not/an event"), F.lit("  {"), F.lit("----- end traceback -----"))).otherwise(F.array().cast("array<string>"))
    body = e.select("path", "event_id", F.posexplode(F.concat(F.array(first), small, block)).alias("at", "value"))
    every = head.select("path", F.col("n").cast("bigint").alias("n"), "value").union(body.select("path", (F.lit(10) + F.col("event_id") * 16 + F.col("at")).cast("bigint"), "value"))
    return every.withColumn("block", F.lit(0).cast("bigint"))


@query("sc24_trace_events", """SELECT 'ask-' || user_id || '.trace' AS path, 'run-' || user_id AS run_id, 'ask' AS kind, '2024-01-01T00:00:00+00:00' AS ts, event_id::INTEGER AS seq,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' ELSE 'info' END AS level, 'role' AS role, event_type AS action, CASE WHEN event_id % 2 = 0 THEN 'number ' || event_id ELSE '' END AS summary,
  '{' || array_to_string(list_filter([CASE WHEN event_type = 'error' THEN '"traceback": "[01] not/an event\\n  {"' END, CASE WHEN event_id % 3 < 2 THEN '"value": ' || event_id END], lambda x: x IS NOT NULL), ', ') || '}' AS details FROM events""")
def sc24(s, d):
    return trace.parse_lines(_trace_lines(s, d))


_RUNS = "SELECT 'run-' || user_id AS run_id, 'ask' AS kind, '2024-01-01T00:00:00+00:00' AS ts, count(*) + count(*) FILTER (event_type = 'error') AS events, count(*) FILTER (event_type IN ('error', 'purchase')) AS warnings, 'ask-' || user_id || '.trace' AS path FROM events GROUP BY user_id"


@query("sc25_runs", _RUNS)
def sc25(s, d):
    return trace.list_runs(_trace_lines(s, d))


@query("j13_ingest_links", f"WITH runs AS ({_RUNS}), asked AS (SELECT DISTINCT o_custkey % 200 AS video_id FROM orders) SELECT video_id, 'run-' || (video_id % 170) AS last_ingest_run_id, path, kind, events, warnings FROM asked LEFT JOIN runs ON run_id = 'run-' || (video_id % 170) WHERE video_id % 9 <> 0")
def j13(s, d):
    asked = b.load(s, d, "orders").select((F.col("o_custkey") % 200).alias("video_id"))
    videos = s.range(400).select(F.col("id").alias("video_id"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("run-"), (F.col("id") % 170).cast("string"))).alias("last_ingest_run_id"))
    return trace.ingest_links(asked, videos, trace.list_runs(_trace_lines(s, d)))


# Colour masks: 8 x 8 pixels of each vector's components


def _frames(s, d):
    shade = lambda k: F.transform(F.slice("embedding", 1, 64), lambda x: F.floor(F.abs(x.cast("double")) * k).cast("int") % 256)
    return b.load(s, d, "embeddings").select(F.col("vec_id").alias("video_id"), F.lit(0.0).alias("timestamp"), F.lit(8).alias("width"), shade(2100).alias("r"), shade(1300).alias("g"), shade(900).alias("b"))


@query("ud5_color_boxes", """WITH px AS (SELECT vec_id, i, floor(abs(embedding[i + 1]::DOUBLE) * 2100)::INTEGER % 256 AS r, floor(abs(embedding[i + 1]::DOUBLE) * 1300)::INTEGER % 256 AS g, floor(abs(embedding[i + 1]::DOUBLE) * 900)::INTEGER % 256 AS b
  FROM (SELECT vec_id, embedding, unnest(range(least(64, len(embedding)))) AS i FROM embeddings)),
pal(name, pr, pg, pb) AS (VALUES ('green', 30, 180, 30), ('black', 15, 15, 15), ('red', 220, 30, 30)),
met AS (SELECT vec_id, name, i % 8 AS x, i // 8 AS y FROM px, pal WHERE (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) < 3600)
SELECT vec_id AS video_id, 0.0::DOUBLE AS timestamp, name AS object_class, least(1.0, 0.5 + count(*) / 64.0::DOUBLE) AS confidence, min(x) / 8.0::DOUBLE AS bbox_x, min(y) / 8.0::DOUBLE AS bbox_y, (max(x) - min(x) + 1) / 8.0::DOUBLE AS bbox_w, (max(y) - min(y) + 1) / 8.0::DOUBLE AS bbox_h FROM met GROUP BY vec_id, name""")
def ud5(s, d):
    return media.color_boxes(_frames(s, d), ["green", "Black", "red", "car"])


# Tables in versions


def _scratch(s) -> str:
    """A folder of its own for a query that writes tables: in the shared folder where there is one."""
    at = s.sparkContext._jsc.sc().getCheckpointDir()
    shared = at.get() if at.isDefined() else s.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tables-")
    return f"{shared}/{uuid.uuid4().hex}"


@query("sk18_versions", """SELECT o_custkey::VARCHAR AS video_id, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS text, o_totalprice AS start_time FROM orders WHERE o_custkey % 7 <> 0 AND NOT (o_custkey % 3 = 0 AND o_orderkey % 2 = 0)""")
def sk18(s, d):
    held = versions.Versioned(s, f"{_scratch(s)}/transcripts", "transcripts")
    orders = b.load(s, d, "orders").withColumn("video_id", F.col("o_custkey").cast("string"))
    rows = lambda text: orders.select("video_id", "o_orderkey", F.col("o_totalprice").cast("double").alias("start_time"), F.col(text).alias("text"))
    held.replace(rows("o_orderstatus"))
    some = orders.filter("o_custkey % 3 = 0")
    held.replace(rows("o_orderpriority").filter("CAST(video_id AS BIGINT) % 3 = 0 AND o_orderkey % 2 = 1"), some)
    held.drop(orders.filter("o_custkey % 7 = 0"))
    held.stage(rows("o_orderstatus"))  # never committed
    return held.read(checked=True).select("video_id", "text", "start_time")


# Delivery: a clip is twelve vectors, each a grey image of 7 x 8; the first ones are another camera's


@query("ud15_delivery", """WITH own AS (SELECT vec_id // 12 AS clip_id, vec_id % 12 AS fi, vec_id, embedding FROM embeddings),
grids AS (SELECT a.clip_id, a.fi, a.fi / 4.0::DOUBLE AS t, CASE WHEN a.fi < a.clip_id % 11 THEN a.embedding ELSE coalesce(c.embedding, a.embedding) END AS g FROM own a LEFT JOIN own c ON c.clip_id = a.clip_id AND c.fi = 11),
hashes AS (SELECT clip_id, fi, t, list_sum(list_transform(range(49), lambda i: CASE WHEN g[(i // 7) * 8 + i % 7 + 1] > g[(i // 7) * 8 + i % 7 + 2] THEN 1::BIGINT << (48 - i)::INTEGER ELSE 0 END))::BIGINT AS h FROM grids),
clips AS (SELECT clip_id, count(*) / 4.0::DOUBLE AS seconds FROM hashes GROUP BY 1),
b1 AS (SELECT clip_id, arg_min(h, {'far': abs(t - least(seconds / 2, greatest(seconds - 0.1, 0))), 'fi': fi}) AS body FROM hashes JOIN clips USING (clip_id) GROUP BY 1),
h1 AS (SELECT clip_id, t, bit_count(xor(h, body)) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY fi) AS n FROM hashes) JOIN b1 USING (clip_id) WHERE n <= 8),
l1 AS (SELECT clip_id, max(t) FILTER (distance > 20) AS last FROM h1 GROUP BY 1), t1 AS (SELECT clip_id, any_value(last) AS last, min(t) FILTER (t > last) AS trim FROM h1 JOIN l1 USING (clip_id) GROUP BY 1),
v1 AS (SELECT clip_id, seconds, CASE WHEN clip_id % 13 = 5 THEN 'reject' WHEN last IS NOT NULL AND trim IS NULL THEN 'reject' WHEN coalesce(trim, 0) <= 0 THEN 'accept' WHEN seconds - trim < 1 THEN 'reject' ELSE 'trim' END AS action, trim FROM clips LEFT JOIN t1 USING (clip_id)),
rest AS (SELECT clip_id, fi, t - trim AS t, h, seconds - trim AS seconds FROM hashes JOIN v1 USING (clip_id) WHERE action = 'trim' AND t >= trim),
b2 AS (SELECT clip_id, arg_min(h, {'far': abs(t - least(greatest(seconds / 2, 0), greatest(seconds - 0.1, 0))), 'fi': fi}) AS body FROM rest GROUP BY 1),
clean AS (SELECT clip_id, max(bit_count(xor(h, body))) <= 20 AS clean FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY fi) AS n FROM rest) JOIN b2 USING (clip_id) WHERE n <= 8 GROUP BY 1),
done AS (SELECT clip_id, CASE WHEN action = 'trim' AND NOT coalesce(clean, false) THEN 'reject' ELSE action END AS action, trim FROM v1 LEFT JOIN clean USING (clip_id))
SELECT clip_id, action, CASE WHEN action = 'trim' THEN trim ELSE 0.0 END AS trim_before, 1000.0::DOUBLE * clip_id + CASE WHEN action = 'trim' THEN trim ELSE 0.0 END AS start_epoch FROM done""")
def ud15(s, d):
    own = b.load(s, d, "embeddings").select(F.floor(F.col("vec_id") / 12).alias("clip_id"), (F.col("vec_id") % 12).alias("frame_index"), "embedding")
    last = own.filter("frame_index = 11").select("clip_id", F.col("embedding").alias("body"))
    grid = F.when(F.col("frame_index") < F.col("clip_id") % 11, F.col("embedding")).otherwise(F.coalesce("body", "embedding"))
    frames = own.join(last, "clip_id", "left").select("clip_id", "frame_index", (F.col("frame_index") / 4.0).alias("t"), grid.alias("grid"))
    resolution = F.when(F.col("clip_id") % 13 == 5, "352x240").when(F.col("clip_id") % 13 == 6, "unknown").otherwise("2688x1520")
    clips = own.groupBy("clip_id").agg((F.count("*") / 4.0).alias("duration")).select("clip_id", (1000.0 * F.col("clip_id")).alias("start_epoch"), F.col("duration").alias("window_len"), "duration", resolution.alias("resolution"), F.lit(19.98).alias("rate"))
    at = F.col("frame_index") / 4.0
    clock = own.select("clip_id", at.alias("t"), (1000.0 * F.col("clip_id") + at + 1).alias("observed_epoch"))
    return delivery.verified_clips(clips, frames, clock, [(2688, 1520, 20)], size=7)


# Text forms

_ANSWERS = ("Yes", "no.", "NOPE", "maybe yes", " None of", "false", "Yeah", "correct", "true", "sure,", "not", "nothing", "it is unclear from", "Unknown", "cannot be confirmed:", "not enough")


@query("s31_s32_answers", f"""WITH said AS (SELECT p_partkey, [{", ".join(f"'{a}'" for a in _ANSWERS)}][p_partkey % {len(_ANSWERS)} + 1] || ' ' || p_name AS answer FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(answer, '^\\s*(no|nope|not|none|negative|false)\\b', 'i') THEN 'no' WHEN regexp_matches(answer, '^\\s*(yes|yeah|yep|correct|true|sure)\\b', 'i') THEN 'yes' ELSE 'unsure' END AS label,
  regexp_matches(answer, 'insufficien|not enough|cannot (be )?(determin|count|tell|confirm|verif)|can''t (determine|tell|count)|unable to|no (relevant )?evidence|unclear from|unknown', 'i') AS insufficient FROM said""")
def s31_s32(s, d):
    answer = F.concat(F.get(F.array(*map(F.lit, _ANSWERS)), F.col("p_partkey") % len(_ANSWERS)), F.lit(" "), "p_name")
    return b.load(s, d, "part").select("p_partkey", tx.verdict(answer).alias("label"), tx.insufficient(answer).alias("insufficient"))


@query("s15_s16_names", """WITH t AS (SELECT doc_id, text, replace(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS flat, substr(coalesce(text, ''), 1, 45) AS title, CASE WHEN doc_id % 3 = 0 THEN 'sha256:' || sha256(coalesce(text, '')) WHEN doc_id % 3 = 1 THEN 'nvr:ch' || doc_id || ':1-2' ELSE '?:!' END AS key FROM documents)
SELECT doc_id, CASE WHEN length(flat) <= 50 THEN flat ELSE regexp_replace(regexp_replace(flat[1:50], ' [^ ]*$', ''), '\\s+$', '') || '…' END AS snippet,
  coalesce(nullif(rtrim(left(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 32), '-'), ''), 'video') AS slug,
  coalesce(nullif(left(regexp_replace(substr(key, strpos(key, ':') + 1), '[^A-Za-z0-9_-]', '', 'g'), 16), ''), 'unknown') AS key16 FROM t""")
def s15_s16(s, d):
    n = F.col("doc_id")
    key = F.when(n % 3 == 0, F.concat(F.lit("sha256:"), F.sha2(F.coalesce("text", F.lit("")), 256))).when(n % 3 == 1, F.concat(F.lit("nvr:ch"), n.cast("string"), F.lit(":1-2"))).otherwise("?:!")
    return b.load(s, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"), tx.slug(F.substring(F.coalesce("text", F.lit("")), 1, 45)).alias("slug"), tx.key16(key).alias("key16"))


@query("sc9_stream_profiles", """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 2 - (p_size = 20 AND p_partkey % 2 = 1)::BIGINT END AS profiles, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS width, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN 15 END AS fps FROM part""")
def sc9(s, d):
    size = F.col("p_size").cast("string")
    spec = F.when(F.col("p_partkey") % 5 == 0, F.lit(" ")).otherwise(F.concat(size, F.lit("x"), size, F.when(F.col("p_partkey") % 2 == 0, "@14.6").otherwise(""), F.lit(", 20X20,")))
    found = b.load(s, d, "part").select("p_partkey", uris.stream_profiles(spec).alias("p"))
    return found.select("p_partkey", F.when(F.col("p").isNotNull(), F.size("p")).cast("bigint").alias("profiles"), F.col("p")[0]["w"].alias("width"), F.col("p")[0]["fps"].alias("fps"))


# Paged logs: each user's events are a search, an event a page; a purchase is a page without items


@query("sc20_searched_pages", f"""WITH {b.EV}, numbered AS (SELECT video_id, event_id, event_type, row_number() OVER (PARTITION BY video_id ORDER BY epoch, event_id) AS n FROM ev),
ends AS (SELECT *, event_type = 'purchase' OR event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY video_id ORDER BY n) OR n > 6 AS stops FROM numbered),
stop AS (SELECT video_id, min(n) FILTER (stops) AS stop FROM ends GROUP BY 1)
SELECT video_id::VARCHAR AS session, n::INTEGER AS page, event_type AS kind FROM ends JOIN stop USING (video_id) WHERE stop IS NULL OR n < stop""")
def sc20(s, d):
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("epoch", "event_id"))
    text = F.when(F.col("event_type") == "purchase", "found=0").otherwise(F.concat(F.lit("found=1\nitems[0].Type="), "event_type"))
    pages = b.raw_events(s, d).select(F.col("video_id").cast("string").alias("session"), n.alias("page"), text.alias("text"))
    return vendor_log.searched(pages, 6).select("session", "page", F.regexp_extract("text", "Type=(.*)", 1).alias("kind"))


@query("sk21_migrated", "SELECT c_custkey::VARCHAR AS id, c_name AS title, NULL::VARCHAR AS last_ingest_run_id, NULL::VARCHAR AS camera_id, NULL::DOUBLE AS start_epoch FROM customer")
def sk21(s, d):
    workdir = _scratch(s)
    b.load(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title")).write.parquet(f"{workdir}/videos")
    migrations.migrate(s, workdir)
    return migrations.read(s, workdir, "videos").select("id", "title", "last_ingest_run_id", "camera_id", "start_epoch")


# Retrieval


@query("f10_planned", f"{_FUSED} SELECT modality, video_id, time_start, round(fused_score, 6) AS fused_score FROM fused WHERE CASE WHEN modality = 'visual' THEN score >= 0.1 ELSE rerank_score >= 0.5 END ORDER BY fused.fused_score DESC, score DESC, time_start, video_id, modality, content LIMIT 40")
def f10_planned(s, d):
    pool = _pool(s, d).drop("position")
    gatherers = {"visual": lambda p: pool.filter("modality = 'visual'"), "transcript_search": lambda p: pool.filter("modality = 'transcript'"), "ocr_search": lambda p: pool.filter("no_such_column")}
    found = planner.QueryPlan(QUERY, needs_caption_search=False, needs_transcript_search=True, search_terms=QUERY)
    return planner.retrieve(found, gatherers, (0.5, 0.1)).items.select("modality", "video_id", "time_start", F.round("fused_score", 6).alias("fused_score"))


_LENGTH = sum(x * x for x in _Q) ** 0.5


@query("f7_semantic", f"""WITH {b.VECTORS}, said AS (SELECT *, CASE vec_id % 4 WHEN 0 THEN 'the thanea' WHEN 1 THEN 'and' ELSE 'label ' || video_id END AS content, list_dot_product(embedding, {[x / _LENGTH for x in _Q]}::DOUBLE[]) AS score FROM vecs WHERE modality IN ('caption', 'transcript')),
top AS (SELECT *, {_score('content')} AS rerank_score FROM said ORDER BY score DESC, video_id, timestamp, modality, content LIMIT 50),
n AS (SELECT *, min(score) OVER () AS lo, max(score) OVER () AS hi, min(rerank_score) OVER () AS rlo, max(rerank_score) OVER () AS rhi FROM top)
SELECT modality, video_id::VARCHAR AS video_id, timestamp AS time_start, content, round(0.6::DOUBLE * CASE WHEN rhi - rlo < 1e-9 THEN 0.5 ELSE (rerank_score - rlo) / (rhi - rlo) END + 0.4::DOUBLE * CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE (score - lo) / (hi - lo) END, 6) AS fused_score FROM n""")
def f7_semantic(s, d):
    label = F.when(F.col("vec_id") % 4 == 0, "the thanea").when(F.col("vec_id") % 4 == 1, "and").otherwise(F.concat(F.lit("label "), F.col("video_id").cast("string")))
    rows = b.vectors(s, d).select(F.lit("text").alias("space"), F.lit("hash").alias("embedder"), F.lit(64).alias("dim"), "embedding", "modality", "video_id", F.col("timestamp").alias("time_start"), F.col("timestamp").alias("time_end"), label.alias("text"))
    index = planner.TextIndex(rows, "text", "hash", 64, lambda terms: _Q, k=50)
    found = planner.QueryPlan(QUERY, needs_caption_search=True, needs_transcript_search=True, search_terms=QUERY)
    got = planner.retrieve(found, {"caption_search": lambda p: rows.filter("no_such_column"), "transcript_search": lambda p: rows.filter("no_such_column")}, cap=50, text=index)
    return got.items.select("modality", "video_id", "time_start", "content", F.round("fused_score", 6).alias("fused_score"))


# Catching up with open events and instants

_OPEN = b.MOTION.replace("epoch + value AS end_epoch", "CASE WHEN event_id % 3 = 0 THEN epoch ELSE epoch + value END AS end_epoch, event_id % 4 = 0 AS open")


@query("st_open_events", f"""{_WATCH.replace(b.MOTION, _OPEN).replace("end_epoch <= start_epoch", "(open OR end_epoch <= start_epoch)")}, cams AS (SELECT range::VARCHAR AS source_ref, 'cam-' || range AS camera_id FROM range(6))
SELECT camera_id, source_ref, greatest({b.T0}, CASE WHEN coalesce(every, true) THEN least({b.T1} - 120, deferred_start) WHEN upto IS NOT NULL THEN least(upto, deferred_start) END)::DOUBLE AS last_processed_epoch,
  NOT coalesce(every, true) AS truncated, deferred_start, coalesce((SELECT count(*) FILTER (reached) FROM placed p WHERE p.camera_id = cams.camera_id), 0) AS windows FROM cams LEFT JOIN state USING (camera_id) LEFT JOIN held USING (camera_id)""")
def st_open(s, d):
    cameras = s.range(6).select(F.concat(F.lit("cam-"), "id").alias("camera_id"), F.col("id").cast("string").alias("source_ref"), F.lit(b.T0).alias("last_processed_epoch"))
    e = b.raw_events(s, d).filter("event_type = 'error'")
    events = e.select((F.col("video_id") % 6).cast("string").alias("camera_ref"), F.col("epoch").alias("start_epoch"), F.when(F.col("event_id") % 3 == 0, F.col("epoch")).otherwise(F.col("epoch") + F.col("value")).alias("end_epoch"), (F.col("event_id") % 4 == 0).alias("open"))
    plan = watch.catch_up(cameras, events, b.T1, watch.WatchRules(max_windows=600))
    return plan.cameras.join(plan.windows.groupBy("camera_id").agg(F.count("*").alias("windows")), "camera_id", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
