"""Sources, sinks, filters, sampling, caches, windows of signals, pooling and documents."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import cache_key, genus, rating_kept, safe_double
from ..functions.vector import l2_normalize, pad_or_crop, text_form
from ..operators import pool, represent, sample, segment
from ..sources import records, sinks
from ..sources.scratch import work_path
from . import derive, oracle

SEGMENTS, VT = oracle.SEGMENTS, oracle.vector_text
_SIGNALS = "sig AS (SELECT user_id, list(CAST(value AS DOUBLE) ORDER BY ts, event_id) AS v, count(*) AS n FROM events GROUP BY user_id)"
WIN, HOP = 16, 6


def scan_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recordings: rows whose label file is there, with a known or no rating, typed."""
    docs, labels = derive.table(spark, sf_dir, "documents"), derive.table(spark, sf_dir, "labels")
    rows = docs.select(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(".ogg ")).alias("filename"),
        F.col("lang").alias("primary_label"), F.col("source").alias("scientific_name"),
                       F.lit(None).cast("string").alias("common_name"),
                       F.when(F.col("doc_id") % 7 == 0, "n/a").otherwise((F.col("doc_id") % 6).cast("string")).alias("rating"))
    members = labels.select(F.concat(F.lit(f"{records.FOLDER}/"), F.col("doc_id").cast("string"), F.lit(".ogg")).alias("member"))
    return records.records(records.existing(rows, members), 3.0)


def safe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = derive.table(spark, sf_dir, "part")
    return part.select("p_partkey", safe_double(F.element_at(F.split("p_brand", "#"), -1)).alias("brand_no"),
        safe_double(F.col("p_name")).alias("name_no"))


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derive.table(spark, sf_dir, "documents")
    return docs.select("doc_id", cache_key(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")), F.col("n_chars"),
        F.col("doc_id"), F.lit("logmel"), F.lit("none"), F.lit("fixed")).alias("key"))


def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents' embeddings are cached (those with a label stand for the cached ones)."""
    keys = cache_rows(spark, sf_dir)
    cached = keys.join(derive.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("key")
    return records.cache_probe(keys, cached).select("doc_id", "cached")


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = derive.table(spark, sf_dir, "nation")
    return sinks.json_rows(nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")), ["key", "name"])


def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file written and read again."""
    path = work_path(spark, "nation")
    sinks.write_csv(derive.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return spark.read.schema("n_nationkey long, n_name string, n_regionkey long").option("header", True).csv(path)


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.table(spark, sf_dir, "documents").where("doc_id = 7").select("doc_id", "lang", "source", "n_chars")


def rating_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = derive.table(spark, sf_dir, "part").withColumn("rating", (F.col("p_size") % 6).cast("double"))
    return part.where(rating_kept(F.col("rating"), 3.0)).select("p_partkey", "rating")


def strat_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.stratified_sample(derive.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 50)


def strat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = derive.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"))
    return sample.stratified_split(customers, "c_custkey", "label", 0.2).select("c_custkey", "label", "part")


def genus_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.table(spark, sf_dir, "part").select("p_partkey", genus(F.concat_ws(" ", "p_type", "p_brand")).alias("genus"))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels to the recordings that their documents come from: three of them at most, in order, and how many there are."""
    _, corpus = derive.queries_and_corpus(spark, sf_dir)
    each = corpus.groupBy("label", "item_id").agg(F.count("*").alias("n_segments"))
    ids = F.array_sort(F.collect_list("item_id"))
    return each.groupBy("label").agg(F.array_join(F.slice(ids, 1, 3), ",").alias("first_records"), F.count("*").alias("n_records"),
        F.sum("n_segments").alias("n_segments"))


def compare_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of systems side by side."""
    orders = derive.table(spark, sf_dir, "orders")
    runs = orders.groupBy(F.col("o_orderstatus").alias("system")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"),
        F.round(F.max("o_totalprice"), 4).alias("max_price"))
    return sinks.comparison(runs, "system", ["mean_price", "max_price"], ["F", "O", "P"]).select("metric", F.col("F").alias("f"),
        F.col("O").alias("o"), F.col("P").alias("p"))


def _windows(df: DataFrame) -> DataFrame:
    total = F.aggregate("audio", F.lit(0.0), lambda a, x: a + x)
    return df.select("user_id", "seg_idx", "start_sample", "end_sample", F.size("audio").cast("long").alias("size"), F.round(total, 4).alias("total"))


def seg_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(segment.fixed(derive.signals(spark, sf_dir), WIN))


def seg_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(segment.overlapping(derive.signals(spark, sf_dir), WIN, HOP))


def seg_multiscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segment.multi_scale(derive.signals(spark, sf_dir), [8, 16, 32])
    return _windows(rows).withColumn("scale", F.lit(0.0)).drop("scale").join(rows.select("user_id", "seg_idx",
        "start_sample", "end_sample", "scale"), ["user_id", "seg_idx", "start_sample", "end_sample"])


def seg_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(segment.energy(derive.signals(spark, sf_dir), WIN, 4))


def seg_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(segment.event(derive.signals(spark, sf_dir), WIN, 2, min_gap=8))


def frame_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.frame_rms(derive.signals(spark, sf_dir), 8).withColumn("rms", F.round("rms", 6))


def min_gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derive.table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = segment.min_gap_events(events.withColumn("s", F.col("us") / 1e6), "user_id", "s", 86400.0)
    return out.select("user_id", F.round("kept_s", 3).alias("kept_s"))


def win_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derive.table(spark, sf_dir, "events")
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours"), "event_type").agg(F.count("*").alias("n"),
        F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n", "total")


def win_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derive.table(spark, sf_dir, "events")
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours", "3 hours"), "event_type").agg(F.count("*").alias("n"),
        F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n", "total")


def _pooled(name: str, **params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        segs = derive.segments(spark, sf_dir).withColumn("idx", F.col("seg_idx"))
        return pool.AGGREGATORS[name](segs, ["item_id"], **params).select("item_id", text_form(F.col("pooled"), 5).alias("pooled"))
    return run


def _docs(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = represent.REPRESENTATIONS[kind](derive.segments(spark, sf_dir).select("item_id", "seg_idx", "label", "embedding"))
        join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        return docs.select("doc_id", "label", text_form(F.col("vector"), 5).alias("vector"), join("source_record_ids").alias("records"),
            join("source_segment_ids").alias("segments"))
    return run


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    return derive.table(spark, sf_dir, "embeddings").select("vec_id", text_form(l2_normalize(scaled), 5).alias("unit"))


def pad_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.signals(spark, sf_dir).select("user_id", text_form(pad_or_crop(F.col("samples"), 64), 2).alias("samples"))


_POOL = """each AS (SELECT item_id, i, {how} AS v FROM (SELECT item_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM {rows}) GROUP BY item_id, i),
pooled AS (SELECT item_id, list(v ORDER BY i) AS m FROM each GROUP BY item_id)"""


def _pool_sql(how: str, rows: str = "segs") -> str:
    return f"WITH {SEGMENTS}, {_POOL.format(how=how, rows=rows)} SELECT item_id, {VT(oracle.unit('m'), 5)} AS pooled FROM pooled"


def _centre(key: str) -> str:
    return f"""centre AS (SELECT {key}, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12)) AS c FROM (
  SELECT {key}, list(v ORDER BY i) AS m FROM (SELECT {key}, i, avg(embedding[i]) AS v FROM (SELECT {key}, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM segs) GROUP BY {key}, i) GROUP BY {key}))"""


def _window_sql(starts: str, end: str, win: str = "16", extra: str = "") -> str:
    return f"""WITH {_SIGNALS} SELECT user_id, seg_idx, start_sample, {end} AS end_sample, {win} AS size, round(coalesce(list_sum(v[start_sample + 1 : start_sample + {win}]), 0), 4) AS total{extra} FROM (
  SELECT user_id, v, n, s AS start_sample, row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS seg_idx FROM (SELECT user_id, v, n, unnest({starts}) AS s FROM sig))"""


def _placed_sql(starts: str, keeps: str) -> str:
    """Starts in order, each if ``keeps`` allows it beside those kept before, eight at most."""
    return f"list_reduce(list_transform({starts}, lambda s: [s]), lambda a, x: CASE WHEN len(a) < 8 AND {keeps} THEN list_concat(a, x) ELSE a END)"


# Loudness of frames of four, those over the 60th percentile, loudest first.
_ENERGY_SQL = f"""WITH {_SIGNALS},
loud AS (SELECT user_id, v, n, list_transform(range(0, n // 4), lambda k: sqrt(list_reduce(list_transform(v[k * 4 + 1 : k * 4 + 4], lambda x: x * x), lambda a, b: a + b) / 4)) AS f FROM sig WHERE n > 16),
least_ AS (SELECT *, list_sort(f) AS o, (len(f) - 1) * 60 / 100 AS p60 FROM loud),
floor_ AS (SELECT *, o[CAST(floor(p60) AS BIGINT) + 1] + (o[least(CAST(floor(p60) AS BIGINT) + 2, len(f))] - o[CAST(floor(p60) AS BIGINT) + 1]) * (p60 - floor(p60)) AS t FROM least_),
peaks AS (SELECT user_id, v, n, list_transform(list_sort(list_transform(list_filter(range(1, len(f) + 1), lambda i: f[i] >= t), lambda i: {{'loud': -f[i], 'k': i - 1}})), lambda x: greatest(0, least(n - 16, x.k * 4 + 2 - 8))) AS starts FROM floor_),
every AS (SELECT user_id, v, n, list_sort({_placed_sql('starts', 'len(list_filter(a, lambda o: abs(o - x[1]) < 16)) = 0')}) AS placed FROM peaks UNION ALL SELECT user_id, v, n, [0] FROM sig WHERE n BETWEEN 1 AND 16)
SELECT user_id, seg_idx, start_sample, start_sample + 16 AS end_sample, 16 AS size, round(coalesce(list_sum(v[start_sample + 1 : start_sample + 16]), 0), 4) AS total
FROM (SELECT user_id, v, s AS start_sample, row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS seg_idx FROM (SELECT user_id, v, unnest(placed) AS s FROM every))"""
# Rises of the energy of frames of two.
_EVENT_SQL = f"""WITH {_SIGNALS},
level AS (SELECT user_id, v, n, list_transform(range(0, n // 2), lambda k: ln(1 + v[2 * k + 1] * v[2 * k + 1] + v[2 * k + 2] * v[2 * k + 2])) AS f FROM sig WHERE n > 16),
rises AS (SELECT *, list_transform(range(1, len(f) + 1), lambda i: CASE WHEN i = 1 THEN 0.0 ELSE greatest(0, f[i] - f[i - 1]) END) AS r FROM level),
peaks AS (SELECT user_id, v, n, list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i] > list_avg(r) AND r[i] >= coalesce(r[i + 1], 0) AND r[i] > CASE WHEN i = 1 THEN 0 ELSE r[i - 1] END), lambda i: greatest(0, least(n - 16, (i - 2) * 2 - 4))) AS starts FROM rises),
every AS (SELECT user_id, v, n, CASE WHEN len(starts) = 0 THEN [greatest(0, n // 2 - 8)] ELSE {_placed_sql('starts', 'x[1] - a[len(a)] >= 8')} END AS placed FROM peaks UNION ALL SELECT user_id, v, n, [0] FROM sig WHERE n BETWEEN 1 AND 16)
SELECT user_id, seg_idx, start_sample, start_sample + 16 AS end_sample, 16 AS size, round(coalesce(list_sum(v[start_sample + 1 : start_sample + 16]), 0), 4) AS total
FROM (SELECT user_id, v, s AS start_sample, row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS seg_idx FROM (SELECT user_id, v, unnest(placed) AS s FROM every))"""

_TUMBLE = "SELECT CAST(epoch(time_bucket(INTERVAL '{step} hours', ts, TIMESTAMP '1970-01-01')) AS BIGINT) - {back} AS start_s, event_type, value FROM events"

QUERIES = {
    "scan_semi_join": scan_semi_join, "safe_parse": safe_parse, "cache_key": cache_rows, "cache_probe": cache_probe,
    "json_report": json_report, "sink_roundtrip": sink_roundtrip, "point_lookup": point_lookup,
    "rating_filter": rating_filter, "strat_sample": strat_sample, "strat_split": strat_split, "genus": genus_names, "lineage": lineage,
    "compare_pivot": compare_pivot,
    "seg_fixed": seg_fixed, "seg_overlap": seg_overlap, "seg_multiscale": seg_multiscale, "seg_energy": seg_energy, "seg_event": seg_event,
    "frame_rms": frame_rms, "min_gap_events": min_gap_events,
    "win_tumbling": win_tumbling, "win_sliding": win_sliding, "l2_normalize": normalised, "pad_crop": pad_crop,
    "pool_mean": _pooled("mean"), "pool_max": _pooled("max"), "pool_median": _pooled("median"), "pool_topk_mean": _pooled("topk_mean", k=2),
    "pool_attention": _pooled("attention"), "pool_spe": _pooled("spe"),
    "doc_segment": _docs("segment"), "doc_audio": _docs("audio"), "doc_species": _docs("species"), "doc_prototype": _docs("prototype"),
    "doc_cluster": _docs("cluster"),
}
ORACLE = {
    "scan_semi_join": f"""SELECT lang AS primary_label, source AS scientific_name, '' AS common_name, rating, '{records.FOLDER}/' || doc_id || '.ogg' AS rel_path FROM (
  SELECT *, CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE CAST(doc_id % 6 AS DOUBLE) END AS rating FROM documents) WHERE doc_id IN (SELECT doc_id FROM labels) AND NOT (rating > 0 AND rating < 3)""",
    "safe_parse": "SELECT p_partkey, coalesce(TRY_CAST(string_split(p_brand, '#')[-1] AS DOUBLE), 0) AS brand_no, coalesce(TRY_CAST(p_name AS DOUBLE), 0) AS name_no FROM part",
    "cache_key": "SELECT doc_id, sha1(concat_ws('|', source || '/' || doc_id, n_chars, doc_id, 'logmel', 'none', 'fixed')) AS key FROM documents",
    "cache_probe": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS cached FROM documents",
    "json_report": """SELECT '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' AS json FROM nation""",
    "sink_roundtrip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "point_lookup": "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7",
    "rating_filter": "SELECT p_partkey, CAST(p_size % 6 AS DOUBLE) AS rating FROM part WHERE NOT (p_size % 6 > 0 AND p_size % 6 < 3)",
    "strat_sample": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) ORDER BY r, md5(lang), doc_id LIMIT 50",
    "strat_split": """SELECT c_custkey, label, CASE WHEN n > 1 AND r <= greatest(1, least(CAST(round_even(n * 0.2, 0) AS BIGINT), n - 1)) THEN 'test' ELSE 'train' END AS part FROM (
  SELECT c_custkey, c_mktsegment AS label, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)""",
    "genus": "SELECT p_partkey, lower(split_part(trim(p_type || ' ' || p_brand), ' ', 1)) AS genus FROM part",
    "lineage": f"WITH {SEGMENTS} SELECT label, array_to_string(list(item_id ORDER BY item_id)[1:3], ',') AS first_records, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_segments FROM (SELECT label, item_id, count(*) AS n FROM corpus GROUP BY ALL) GROUP BY label",
    "compare_pivot": """SELECT 'mean_price' AS metric, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS f, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS o, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS p FROM orders
UNION ALL SELECT 'max_price', round(max(o_totalprice) FILTER (o_orderstatus = 'F'), 4), round(max(o_totalprice) FILTER (o_orderstatus = 'O'), 4), round(max(o_totalprice) FILTER (o_orderstatus = 'P'), 4) FROM orders""",
    "seg_fixed": _window_sql("range(0, n, 16)", "start_sample + 16"),
    "seg_overlap": _window_sql("CASE WHEN n <= 16 THEN [0] ELSE list_concat(range(0, n - 15, 6), CASE WHEN (n - 16) // 6 * 6 + 16 < n THEN [n - 16] ELSE [] END) END", "start_sample + 16"),
    "seg_multiscale": " UNION ALL ".join(f"({_window_sql(f'range(0, n, {w})', f'start_sample + {w}', str(w), f', CAST({w} AS DOUBLE) AS scale')})" for w in (8, 16, 32)),
    "seg_energy": _ENERGY_SQL, "seg_event": _EVENT_SQL,
    "frame_rms": f"WITH {_SIGNALS} SELECT user_id, k AS frame_idx, round(sqrt(list_dot_product(v[k * 8 + 1 : k * 8 + 8], v[k * 8 + 1 : k * 8 + 8]) / 8), 6) AS rms FROM (SELECT user_id, v, unnest(range(0, n // 8)) AS k FROM sig)",
    "min_gap_events": """WITH RECURSIVE t AS (SELECT user_id, epoch_us(ts) / 1e6 AS s FROM events),
g AS (SELECT user_id, min(s) AS s FROM t GROUP BY user_id UNION ALL SELECT g.user_id, (SELECT min(t.s) FROM t WHERE t.user_id = g.user_id AND t.s - g.s >= 86400) FROM g WHERE g.s IS NOT NULL)
SELECT user_id, round(s, 3) AS kept_s FROM g WHERE s IS NOT NULL""",
    "win_tumbling": f"SELECT start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ({_TUMBLE.format(step=6, back=0)}) GROUP BY ALL",
    "win_sliding": f"SELECT start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ({_TUMBLE.format(step=3, back=0)} UNION ALL {_TUMBLE.format(step=3, back=10800)}) GROUP BY ALL",
    "l2_normalize": f"WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS m FROM embeddings) SELECT vec_id, {VT(oracle.unit('m'), 5)} AS unit FROM e",
    "pad_crop": f"WITH {_SIGNALS}, c AS (SELECT user_id, CASE WHEN n >= 64 THEN v[(n - 64) // 2 + 1 : (n - 64) // 2 + 64] ELSE list_concat(v, list_transform(range(64 - n), lambda x: CAST(0 AS DOUBLE))) END AS s FROM sig) SELECT user_id, {VT('s', 2)} AS samples FROM c",
    "pool_mean": _pool_sql("avg(embedding[i])"), "pool_max": _pool_sql("max(embedding[i])"), "pool_median": _pool_sql("median(embedding[i])"),
    "pool_topk_mean": _pool_sql("avg(embedding[i])",
    "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sqrt(list_dot_product(embedding, embedding)), 6) DESC, seg_idx) AS r FROM segs) WHERE r <= 2)"),
    "pool_attention": f"""WITH {SEGMENTS}, {_centre('item_id')},
s AS (SELECT item_id, embedding, list_dot_product(embedding, c) / 0.1 AS s FROM segs JOIN centre USING (item_id)),
e AS (SELECT item_id, embedding, exp(s - max(s) OVER (PARTITION BY item_id)) AS e FROM s),
w AS (SELECT item_id, embedding, e / (sum(e) OVER (PARTITION BY item_id) + 1e-12) AS w FROM e),
pooled AS (SELECT item_id, list(v ORDER BY i) AS m FROM (SELECT item_id, i, sum(embedding[i] * w) AS v FROM (SELECT item_id, embedding, w, unnest(range(1, len(embedding) + 1)) AS i FROM w) GROUP BY item_id, i) GROUP BY item_id)
SELECT item_id, {VT(oracle.unit('m'), 5)} AS pooled FROM pooled""",
    "pool_spe": f"""WITH {SEGMENTS}, r AS (SELECT item_id, embedding, row_number() OVER (PARTITION BY item_id ORDER BY seg_idx) - 1 AS r, count(*) OVER (PARTITION BY item_id) AS n FROM segs),
cells AS (SELECT k AS lev, c AS cell FROM (SELECT unnest([1, 2, 4]) AS k), (SELECT unnest(range(0, 4)) AS c) WHERE c < k),
x AS (SELECT item_id, embedding, lev, cell, r, n, CAST(round_even(n * cell / CAST(lev AS DOUBLE), 0) AS BIGINT) AS lo, CAST(round_even(n * (cell + 1) / CAST(lev AS DOUBLE), 0) AS BIGINT) AS hi FROM r, cells),
y AS (SELECT item_id, embedding, lev, cell FROM x WHERE (r >= lo AND r < hi) OR (hi <= lo AND r = n - 1)),
pooled AS (SELECT item_id, list(v ORDER BY lev, cell, i) AS m FROM (SELECT item_id, lev, cell, i, avg(embedding[i]) AS v FROM (SELECT item_id, lev, cell, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM y) GROUP BY ALL) GROUP BY item_id)
SELECT item_id, {VT(oracle.unit('m'), 5)} AS pooled FROM pooled""",
    "doc_segment": f"WITH {SEGMENTS} SELECT row_number() OVER (ORDER BY item_id, seg_idx) - 1 AS doc_id, label, {VT('embedding', 5)} AS vector, CAST(item_id AS VARCHAR) AS records, CAST(seg_idx AS VARCHAR) AS segments FROM segs",
    "doc_audio": f"""WITH {SEGMENTS}, {_centre('item_id')}, l AS (SELECT item_id, any_value(label) AS label, string_agg(item_id, ',' ORDER BY seg_idx) AS records, string_agg(seg_idx, ',' ORDER BY seg_idx) AS segments FROM segs GROUP BY item_id)
SELECT row_number() OVER (ORDER BY item_id) - 1 AS doc_id, label, {VT('c', 5)} AS vector, records, segments FROM l JOIN centre USING (item_id)""",
    "doc_species": f"""WITH {SEGMENTS}, {_centre('label')}, l AS (SELECT label, min(item_id) AS f, string_agg(item_id, ',' ORDER BY item_id, seg_idx) AS records, string_agg(seg_idx, ',' ORDER BY item_id, seg_idx) AS segments FROM segs GROUP BY label)
SELECT row_number() OVER (ORDER BY f, label) - 1 AS doc_id, label, {VT('c', 5)} AS vector, records, segments FROM l JOIN centre USING (label)""",
    "doc_prototype": f"""WITH {SEGMENTS}, {_centre('label')}, b AS (SELECT segs.label AS label, item_id, seg_idx, embedding AS m, min(item_id) OVER (PARTITION BY segs.label) AS f, row_number() OVER (PARTITION BY segs.label ORDER BY round(list_dot_product(embedding, c), 9) DESC, item_id, seg_idx) AS r FROM segs JOIN centre ON centre.label = segs.label)
SELECT row_number() OVER (ORDER BY f, label) - 1 AS doc_id, label, {VT(oracle.unit('m'), 5)} AS vector, CAST(item_id AS VARCHAR) AS records, CAST(seg_idx AS VARCHAR) AS segments FROM b WHERE r = 1""",
}
