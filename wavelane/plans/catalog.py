"""Named queries over the driver's tables and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavelane.functions import arrays as A, ecg, estimators as E, signal as S
from wavelane.operators import align, folds, labels, metrics, networks, segments, training, windows as W
from wavelane.plans.fixtures import DEVICE_OF, DEVICES, HOUR, SAMPLES_SQL, samples, scratch, scratch_csv, table, windows64
from wavelane.sources import archives, readers, sinks
from wavelane.sources.readers import ecg_epoch, participant_id, pulse_column
from wavelane.streaming import ordered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

P = ["participant"]
GAP_A, GAP_B, WIDTH = 10 * HOUR, 48 * HOUR, 48 * HOUR
LENGTH, STRIDE, SPAN = 8, 2, (6 * HOUR, 60 * HOUR)


def query(sql: str | None = None):
    """Registers a query under its function's name, and its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _runs(role: str, gap: int, name: str) -> str:
    """SQL for gap-free runs of one role: common tables <name>_rows (with run) and <name> (segments)."""
    where = f" WHERE role = '{role}'" if role else ""
    return f"""{name}_d AS (SELECT *, t - lag(t) OVER (PARTITION BY participant ORDER BY t, ord) AS dt FROM samples{where}),
{name}_rows AS (SELECT *, sum(CASE WHEN dt > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY participant ORDER BY t, ord ROWS UNBOUNDED PRECEDING) AS run FROM {name}_d),
{name} AS (SELECT participant, CAST(run AS BIGINT) AS segment, min(t) AS s, max(t) AS e, count(*) AS n FROM {name}_rows GROUP BY participant, run)"""


def _role(spark, sf_dir, role):
    return samples(spark, sf_dir).where(F.col("role") == role)


def _segments(spark, sf_dir, role, gap=GAP_B):
    return segments.gap_segments(_role(spark, sf_dir, role), P, "t", "ord", gap)


# -- segments and intervals ------------------------------------------------------------------------------------------


@query(f"WITH {SAMPLES_SQL}, {_runs('', GAP_A, 'g')} SELECT participant, segment, s AS start_us, e AS end_us, CAST(n AS BIGINT) AS n FROM g")
def gap_segments(spark, sf_dir):
    out = segments.gap_segments(samples(spark, sf_dir), P, "t", "ord", GAP_A)
    return out.select("participant", "segment", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n")


@query(ORACLES["gap_segments"])
def gap_segments_bucketed(spark, sf_dir):
    """As gap_segments, in two steps that spread a large key over buckets of time."""
    out = segments.gap_segments(samples(spark, sf_dir), P, "t", "ord", GAP_A, bucket=7 * 24 * HOUR)
    return out.select("participant", "segment", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n")


def _streamed(spark, sf_dir, apply, name: str):
    """Results of a stream over the samples in files by quarter, with late rows within a file, that ends when all is read. A last row of no participant, years
    later, moves the watermark past all others."""
    folder, out = scratch(spark, f"{name}-in"), scratch(spark, f"{name}-out")
    rows = samples(spark, sf_dir).select("participant", "ord", "t", F.timestamp_micros("t").alias("ts"))
    rows.withColumn("part", F.date_format("ts", "yyyyQ")).repartition("part").sortWithinPartitions("part", "ord").write.partitionBy("part").parquet(folder)
    end = rows.agg((F.max("t") + 4000 * 24 * HOUR).alias("t")).select(F.lit(-1).cast(rows.schema["participant"].dataType).alias("participant"), F.lit(0).cast(rows.schema["ord"].dataType).alias("ord"), "t", F.timestamp_micros("t").alias("ts"))
    end.write.parquet(f"{folder}/part=99991")
    session = ordered.with_state_tables(spark)
    stream = session.readStream.schema(rows.schema).parquet(folder)
    query = apply(stream).writeStream.format("parquet").option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out).where("participant >= 0")


@query(f"WITH {SAMPLES_SQL}, {_runs('', GAP_A, 'g')} SELECT participant, s AS start_us, e AS end_us, CAST(n AS BIGINT) AS n FROM g")
def streamed_segments(spark, sf_dir):
    """Gap segments of a stream by state with timers."""
    out = _streamed(spark, sf_dir, lambda s: ordered.segment_stream(s, "participant", "ts", "t", "ord", GAP_A, "1 hour"), "segments")
    return out.select("participant", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n")


_NESTED = f"""{_runs("click", GAP_B, "b")},
inside AS (SELECT a.*, b.segment AS b_segment, b.s AS b_start, b.e AS b_end, count(*) OVER (PARTITION BY a.participant, b.segment) AS k FROM samples a JOIN b ON a.participant = b.participant AND a.t BETWEEN b.s AND b.e WHERE a.role = 'view'),
nd AS (SELECT *, t - lag(t) OVER (PARTITION BY participant, b_segment ORDER BY t, ord) AS dt FROM inside WHERE k >= 2),
nested AS (SELECT *, sum(CASE WHEN dt > {GAP_B} THEN 1 ELSE 0 END) OVER (PARTITION BY participant, b_segment ORDER BY t, ord ROWS UNBOUNDED PRECEDING) AS run FROM nd)"""


@query(f"WITH {SAMPLES_SQL}, {_NESTED} SELECT participant, b_segment, b_start, b_end, CAST(run AS BIGINT) AS run, min(t) AS start_us, max(t) AS end_us, CAST(count(*) AS BIGINT) AS n FROM nested GROUP BY ALL")
def region_segments(spark, sf_dir):
    out = segments.region_segments(_role(spark, sf_dir, "view"), _segments(spark, sf_dir, "click"), P, "t", "ord", GAP_B, WIDTH)
    return out.withColumnsRenamed({"start": "start_us", "end": "end_us"})


_OVERLAP = f"""{_runs("view", GAP_B, "a")}, {_runs("click", GAP_B, "b")},
regions AS (SELECT a.participant, a.segment AS a_segment, b.segment AS b_segment, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM a JOIN b ON a.participant = b.participant AND a.s <= b.e AND b.s <= a.e WHERE least(a.e, b.e) > greatest(a.s, b.s))"""


@query(f"WITH {SAMPLES_SQL}, {_OVERLAP} SELECT participant, a_segment, b_segment, s AS start_us, e AS end_us FROM regions")
def overlap_regions(spark, sf_dir):
    out = segments.overlaps(_segments(spark, sf_dir, "view"), _segments(spark, sf_dir, "click"), P, WIDTH)
    return out.withColumnsRenamed({"start": "start_us", "end": "end_us"})


@query(f"""WITH {SAMPLES_SQL}, i AS (SELECT participant, t AS a, t + CAST(round(x * 1000) AS BIGINT) * 1000000 AS b FROM samples WHERE round(x * 1000) > 0),
r AS (SELECT *, max(b) OVER (PARTITION BY participant ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY participant ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM r),
m AS (SELECT participant, k, min(a) AS a, max(b) AS b FROM g GROUP BY participant, k) SELECT participant, CAST(sum(b - a) AS BIGINT) AS covered_us, CAST(count(*) AS BIGINT) AS n_merged FROM m GROUP BY participant""")
def coverage_seconds(spark, sf_dir):
    i = samples(spark, sf_dir).withColumn("b", F.col("t") + F.round(F.col("x") * 1000).cast("long") * 1_000_000)
    return segments.coverage(i, P, "t", "b").select("participant", F.col("covered").cast("long").alias("covered_us"), "n_merged")


# -- windows ---------------------------------------------------------------------------------------------------------

_W3 = f"""{_runs("", GAP_A, "g")},
o AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY participant, run) AS k, lead(t, {LENGTH - 1}) OVER w AS t1 FROM g_rows WINDOW w AS (PARTITION BY participant, run ORDER BY t, ord)),
w3 AS (SELECT participant, CAST(run AS BIGINT) AS run, CAST(i AS BIGINT) AS i, t AS t0, t1 FROM o WHERE i % {STRIDE} = 0 AND i + {LENGTH} <= k AND t1 - t BETWEEN {SPAN[0]} AND {SPAN[1]})"""


def _w3(spark, sf_dir):
    return W.gap_restart_windows(samples(spark, sf_dir), P, "t", "ord", GAP_A, LENGTH, STRIDE, SPAN)


@query(f"WITH {SAMPLES_SQL}, {_W3} SELECT * FROM w3")
def gap_restart_windows(spark, sf_dir):
    return _w3(spark, sf_dir)


@query(ORACLES["gap_restart_windows"])
def gap_restart_windows_bucketed(spark, sf_dir):
    """The same windows where a participant's rows are numbered in buckets of a week."""
    return W.gap_restart_windows(samples(spark, sf_dir), P, "t", "ord", GAP_A, LENGTH, STRIDE, SPAN, bucket=7 * 24 * HOUR)


@query(f"WITH {SAMPLES_SQL}, {_W3} SELECT participant, t0, t1 FROM w3")
def streamed_windows(spark, sf_dir):
    """Windows that restart after gaps, of a stream by state with timers."""
    out = _streamed(spark, sf_dir, lambda s: ordered.window_stream(s, "participant", "ts", "t", "ord", GAP_A, LENGTH, STRIDE, "1 hour"), "windows")
    span = F.col("t1") - F.col("t0")
    return out.where((span >= SPAN[0]) & (span <= SPAN[1])).select("participant", "t0", "t1")


@query(f"WITH {SAMPLES_SQL}, {_W3} SELECT w.participant, w.t0, w.t1, CAST(count(s.t) AS BIGINT) AS n_slice FROM w3 w LEFT JOIN samples s ON s.participant = w.participant AND s.role = 'click' AND s.t BETWEEN w.t0 AND w.t1 GROUP BY ALL")
def interval_slice_counts(spark, sf_dir):
    return W.slice_counts(_w3(spark, sf_dir).select("participant", "t0", "t1"), _role(spark, sf_dir, "click"), P, "t", WIDTH, ["participant", "t0", "t1"])


@query(f"""WITH {SAMPLES_SQL}, {_W3}, s AS (SELECT w.participant, w.t0, w.t1, list(s.x ORDER BY s.t, s.ord) AS x FROM w3 w JOIN samples s ON s.participant = w.participant AND s.role = 'click' AND s.t BETWEEN w.t0 AND w.t1 GROUP BY ALL)
SELECT participant, t0, t1, CAST(len(x) AS BIGINT) AS valid_len, CASE WHEN len(x) <= 3 THEN 3 END AS padded_len, CASE WHEN len(x) <= 3 THEN round(x[1], 6) END AS first_x, CASE WHEN len(x) <= 3 THEN round(CASE WHEN len(x) = 3 THEN x[3] ELSE 0 END, 6) END AS last_x, len(x) > 3 AS rejected FROM s""")
def padded_slices(spark, sf_dir):
    rows = W.slice_arrays(_w3(spark, sf_dir), _role(spark, sf_dir, "click"), P, "t", "ord", "x", WIDTH, ["participant", "t0", "t1"])
    rows = rows.withColumn("p", W.padded(F.col("slice"), 3))
    return rows.select("participant", "t0", "t1", F.size("slice").cast("long").alias("valid_len"), F.when(F.col("p").isNotNull(), F.size("p")).alias("padded_len"), F.round(F.element_at("p", 1), 6).alias("first_x"), F.round(F.element_at("p", -1), 6).alias("last_x"), F.col("p").isNull().alias("rejected"))


L4, S4, SPAN4 = 3, 1, (HOUR, 96 * HOUR)
_W4 = f"""{_NESTED}, o4 AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY participant, b_segment, run) AS kk, lead(t, {L4 - 1}) OVER w AS t1 FROM nested WINDOW w AS (PARTITION BY participant, b_segment, run ORDER BY t, ord)),
w4 AS (SELECT participant, b_segment, CAST(run AS BIGINT) AS run, CAST(i AS BIGINT) AS i, t AS t0, t1 FROM o4 WHERE i % {S4} = 0 AND i + {L4} <= kk AND t1 - t BETWEEN {SPAN4[0]} AND {SPAN4[1]})"""


def _w4(spark, sf_dir):
    return W.continuous_windows(_role(spark, sf_dir, "view"), _segments(spark, sf_dir, "click"), P, "t", "ord", GAP_B, L4, S4, SPAN4, WIDTH)


@query(f"WITH {SAMPLES_SQL}, {_W4} SELECT * FROM w4")
def continuous_windows(spark, sf_dir):
    return _w4(spark, sf_dir)


@query(ORACLES["continuous_windows"])
def continuous_windows_bucketed(spark, sf_dir):
    """The same windows where a region's rows are numbered in buckets of four days."""
    return W.continuous_windows(_role(spark, sf_dir, "view"), _segments(spark, sf_dir, "click"), P, "t", "ord", GAP_B, L4, S4, SPAN4, WIDTH, bucket=4 * 24 * HOUR)


_REGION_W = f"""regions_n AS (SELECT a.participant, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM v a JOIN b ON a.participant = b.participant AND a.s <= b.e AND b.s <= a.e WHERE least(a.e, b.e) > greatest(a.s, b.s)),
ri AS (SELECT x.*, r.s AS region FROM samples x JOIN regions_n r ON x.participant = r.participant AND x.t BETWEEN r.s AND r.e WHERE x.role = 'view'),
rd AS (SELECT *, t - lag(t) OVER (PARTITION BY participant, region ORDER BY t, ord) AS dt FROM ri),
rr AS (SELECT *, sum(CASE WHEN dt > {GAP_B} THEN 1 ELSE 0 END) OVER (PARTITION BY participant, region ORDER BY t, ord ROWS UNBOUNDED PRECEDING) AS run FROM rd),
ro AS (SELECT *, row_number() OVER w - 1 AS i, lead(t, {L4 - 1}) OVER w AS t1 FROM rr WINDOW w AS (PARTITION BY participant, region, run ORDER BY t, ord)),
w5 AS (SELECT participant, t AS t0, t1 FROM ro WHERE i % {S4} = 0 AND t1 IS NOT NULL AND t1 - t BETWEEN {SPAN4[0]} AND {SPAN4[1]})"""


@query(f"WITH {SAMPLES_SQL}, {_W4}, {_runs('view', GAP_B, 'v')}, {_REGION_W}, long4 AS (SELECT participant, t0, t1 FROM w4 WHERE t1 - t0 >= {60 * HOUR}) SELECT participant, t0, t1, false AS fallback FROM long4 UNION ALL SELECT participant, t0, t1, true FROM w5 WHERE participant NOT IN (SELECT participant FROM long4)")
def windows_with_fallback(spark, sf_dir):
    """Long windows where both signals run on; for participants without any, windows of the overlaps."""
    first = _w4(spark, sf_dir).where(F.col("t1") - F.col("t0") >= 60 * HOUR).select("participant", "t0", "t1")
    regions = segments.overlaps(_segments(spark, sf_dir, "view"), _segments(spark, sf_dir, "click"), P, WIDTH).select("participant", F.col("start").alias("region"), "start", "end")
    second = W.region_windows(_role(spark, sf_dir, "view"), regions, P, "t", "ord", GAP_B, L4, S4, SPAN4, WIDTH).select("participant", "t0", "t1")
    return W.with_fallback(first, second, P)


@query(f"""WITH {SAMPLES_SQL}, {_runs("", GAP_A, "g")}, o AS (SELECT *, row_number() OVER (PARTITION BY participant, run ORDER BY t, ord) - 1 AS i, count(*) OVER (PARTITION BY participant, run) AS k FROM g_rows),
s AS (SELECT a.participant, a.run, a.i, a.t AS t0, count(*) AS n, max(b.t) AS t1, sum(b.x * (b.i - a.i + 1)) AS dot, arg_min(b.x, b.i) AS first_x, arg_max(b.x, b.i) AS last_x FROM o a JOIN o b ON a.participant = b.participant AND a.run = b.run AND b.i BETWEEN a.i AND a.i + {LENGTH - 1} WHERE a.i % {STRIDE} = 0 AND a.i + {LENGTH} <= a.k GROUP BY ALL)
SELECT participant, CAST(run AS BIGINT) AS run, CAST(i AS BIGINT) AS i, t0, t1, CAST(n AS BIGINT) AS n, round(first_x, 6) AS first_x, round(last_x, 6) AS last_x, round(dot, 4) AS dot FROM s""")
def window_arrays(spark, sf_dir):
    rows = segments.with_runs(samples(spark, sf_dir), P, "t", "ord", GAP_A)
    return _window_dots(W.window_arrays(rows, ["participant", "run"], "t", "ord", ["x"], LENGTH, STRIDE))


def _window_dots(w):
    dot = F.aggregate(F.transform("x_window", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return w.select("participant", "run", F.col("i").cast("long").alias("i"), "t0", "t1", F.size("x_window").cast("long").alias("n"), F.round(F.element_at("x_window", 1), 6).alias("first_x"), F.round(F.element_at("x_window", -1), 6).alias("last_x"), F.round(dot, 4).alias("dot"))


@query(ORACLES["window_arrays"])
def window_arrays_bucketed(spark, sf_dir):
    """The same arrays of rows that know their places in runs from buckets."""
    rows = segments.bucketed_runs(samples(spark, sf_dir), P, "t", "ord", GAP_A, 7 * 24 * HOUR)
    return _window_dots(W.window_arrays(rows, ["participant", "run"], "t", "ord", ["x"], LENGTH, STRIDE))


@query("""WITH s AS (SELECT vec_id, unnest([0, 1, 2, 3]) AS k, unnest([0, 16, 32, 40]) AS p, embedding FROM embeddings WHERE len(embedding) = 64), t AS (SELECT vec_id, k, unnest(range(0, 24)) AS j, p, embedding FROM s) SELECT vec_id, CAST(k AS INT) AS k, CAST(j AS INT) AS j, round(CAST(embedding[p + j + 1] AS DOUBLE), 6) AS x FROM t""")
def sub_windows(spark, sf_dir):
    """Windows of 24 at stride 16 inside each window of 64, and one at the tail, with all their samples."""
    rows = windows64(spark, sf_dir).select("vec_id", F.posexplode(W.sub_windows(F.col("w"), 24, 16)).alias("k", "s"))
    return rows.select("vec_id", "k", F.posexplode("s").alias("j", "x")).withColumn("x", F.round("x", 6))


@query("SELECT vec_id, CAST(k AS INT) AS k, round(list_sum(CAST(embedding[k * 10 + 1 : k * 10 + 20] AS DOUBLE[])), 6) AS total FROM (SELECT vec_id, embedding, unnest(range(0, 5)) AS k FROM embeddings WHERE len(embedding) = 64)")
def sliding_windows(spark, sf_dir):
    rows = windows64(spark, sf_dir).select("vec_id", F.posexplode(W.sliding(F.col("w"), 20, 10)).alias("k", "s"))
    return rows.select("vec_id", "k", F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# -- alignment -------------------------------------------------------------------------------------------------------

_DEVICE_SQL = "CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DEVICE_OF.items()) + " END"
_RANK_SQL = "CASE device " + " ".join(f"WHEN '{d}' THEN {k}" for k, d in enumerate(DEVICES, 1)) + " END"
TOLERANCE = 24 * HOUR
_DEV = f"""dev AS (SELECT participant, {_DEVICE_SQL} AS device, ord, t FROM samples WHERE {_DEVICE_SQL} IS NOT NULL),
counts AS (SELECT participant, device, count(*) AS n, {_RANK_SQL} AS rank FROM dev GROUP BY ALL),
full_ AS (SELECT participant FROM counts GROUP BY participant HAVING count(*) = 4),
base AS (SELECT participant, arg_min(device, n * 10 + rank) AS base, min(n) AS n_windows FROM counts WHERE participant IN (SELECT participant FROM full_) GROUP BY participant)"""


def _devices(spark, sf_dir):
    role = F.col("role")
    device = F.coalesce(*(F.when(role == k, v) for k, v in DEVICE_OF.items()))
    return samples(spark, sf_dir).withColumn("device", device).where(F.col("device").isNotNull())


@query(f"WITH {SAMPLES_SQL}, {_DEV} SELECT participant FROM full_")
def complete_participants(spark, sf_dir):
    return align.complete_participants(_devices(spark, sf_dir), "participant", "device", DEVICES)


@query(f"WITH {SAMPLES_SQL}, {_DEV} SELECT participant, base, CAST(n_windows AS BIGINT) AS n_windows FROM base")
def base_device(spark, sf_dir):
    return align.base_device(_devices(spark, sf_dir), "participant", "device", DEVICES)


@query(f"""WITH {SAMPLES_SQL}, {_DEV}, l AS (SELECT d.participant, b.base, d.ord AS base_ord, d.t AS t0 FROM dev d JOIN base b ON d.participant = b.participant AND d.device = b.base),
n AS (SELECT l.*, d.device, d.ord, row_number() OVER (PARTITION BY l.participant, l.base_ord, d.device ORDER BY abs(d.t - l.t0), d.t, d.ord) AS r FROM l JOIN dev d ON d.participant = l.participant AND abs(d.t - l.t0) <= {TOLERANCE})
SELECT participant, base, base_ord, t0, {", ".join(f"max(CASE WHEN device = '{d}' THEN ord END) AS {d}_ord" for d in DEVICES)} FROM n WHERE r = 1 GROUP BY ALL HAVING count(*) = 4""")
def nearest_tolerance_align(spark, sf_dir):
    return align.nearest_align(_devices(spark, sf_dir), "participant", "device", "t", "ord", DEVICES, TOLERANCE)


_KEYED = """k AS (SELECT participant, role, ord, CAST(round_even(t / 3600000000.0 / 12, 0) AS BIGINT) AS k0, x FROM samples),
ref AS (SELECT participant, ord AS ref_ord, k0, x FROM k WHERE role = 'view'), src AS (SELECT participant, k0, max(ord) AS src_ord, arg_max(x, ord) AS src_x FROM k WHERE role = 'click' GROUP BY ALL)"""


def _half_days(spark, sf_dir, role):
    half = F.col("t") / F.lit(3600000000.0) / 12
    return _role(spark, sf_dir, role).select("participant", "ord", half.alias("t0"), half.alias("t1"), "x")


@query(f"WITH {SAMPLES_SQL}, {_KEYED} SELECT r.participant, r.k0 AS t0_key, r.ref_ord, s.src_ord, round(s.src_x, 6) AS x, s.src_ord IS NULL AS missing FROM ref r LEFT JOIN src s ON r.participant = s.participant AND r.k0 = s.k0")
def keyed_realign(spark, sf_dir):
    out = align.keyed_realign(_half_days(spark, sf_dir, "view"), _half_days(spark, sf_dir, "click"), P, "ord")
    return out.select("participant", "t0_key", "ref_ord", "src_ord", F.round("x", 6).alias("x"), "missing")


_DAYS = """v AS (SELECT user_id AS participant, event_type AS role, epoch_us(ts) // 3600000000 // 24 AS day, max(event_id) AS ord, arg_max(value, event_id) AS x FROM events GROUP BY ALL), a AS (SELECT * FROM v WHERE role = 'view'), b AS (SELECT * FROM v WHERE role = 'click')"""


def _days(spark, sf_dir, role):
    """The last event of a role on each day of a participant, as a window: two roles are the two channels."""
    day = F.floor(F.col("t") / (24 * HOUR)).cast("double")
    rows = _role(spark, sf_dir, role).groupBy("participant", day.alias("t0")).agg(F.max("ord").alias("ord"), F.max_by("x", "ord").alias("x"))
    return rows.withColumn("t1", F.col("t0") + 1).withColumn("mark", F.col("t0") % 7 + F.when(F.col("x") > 0.5, 1).otherwise(0))


_MARK = "CASE WHEN {0}.x > 0.5 THEN 1 ELSE 0 END"


@query(f"WITH {_DAYS} SELECT a.participant, CAST(a.day AS BIGINT) AS t0_key, a.ord, round(a.x, 6) AS a_x, round(b.x, 6) AS b_x, {_MARK.format('a')} = {_MARK.format('b')} AS same FROM a JOIN b ON a.participant = b.participant AND a.day = b.day")
def channel_merge(spark, sf_dir):
    out = align.merge_channels(_days(spark, sf_dir, "view"), _days(spark, sf_dir, "click"), P, ["mark"], ["x"], [])
    return out.select("participant", "t0_key", "ord", F.round("a_x", 6).alias("a_x"), F.round("b_x", 6).alias("b_x"), "same")


@query(f"WITH {_DAYS}, j AS (SELECT coalesce(a.participant, b.participant) AS participant, a.day AS ad, b.day AS bd, {_MARK.format('a')} <> {_MARK.format('b')} AS differs FROM a FULL JOIN b ON a.participant = b.participant AND a.day = b.day) SELECT participant, CAST(count(*) FILTER (bd IS NULL) AS BIGINT) AS only_a, CAST(count(*) FILTER (ad IS NULL) AS BIGINT) AS only_b, CAST(count(*) FILTER (ad IS NOT NULL AND bd IS NOT NULL AND differs) AS BIGINT) AS differing FROM j GROUP BY participant")
def channel_merge_check(spark, sf_dir):
    return align.merge_problems(_days(spark, sf_dir, "view"), _days(spark, sf_dir, "click"), P, ["mark"])


# -- labels ----------------------------------------------------------------------------------------------------------

_WEEK = 7 * 24 * HOUR
_LABELLED_SQL = f"""g AS (SELECT participant, t // {_WEEK} AS week, count(*) AS n, max(CASE WHEN ord % 97 = 0 THEN 1 ELSE 0 END) AS bad, min(ord) % 13 = 0 AS poor FROM samples GROUP BY ALL),
d AS (SELECT participant, t // {_WEEK} AS week, (t - lag(t) OVER (PARTITION BY participant, t // {_WEEK} ORDER BY t, ord)) / 36000000000.0 AS rr FROM samples),
s AS (SELECT participant, week, median(rr) AS m, stddev_pop(rr) / avg(rr) AS cv, bool_or(rr < 0.05 OR rr > 3.0) AS wild, count(rr) AS k FROM d WHERE rr IS NOT NULL GROUP BY ALL),
l AS (SELECT g.participant, g.week, g.n AS n_peaks, s.m, s.cv, CASE WHEN g.bad = 1 THEN 'contains_nan' WHEN g.n < 3 THEN 'too_short' WHEN g.n < 4 THEN 'too_few_beats' WHEN coalesce(s.k, 0) = 0 THEN 'no_rr' WHEN 60 / s.m < 40 OR 60 / s.m > 180 THEN 'implausible_hr' WHEN s.wild THEN 'implausible_rr' WHEN s.cv > 0.9 THEN 'rr_too_irregular' WHEN g.poor THEN 'poor_quality' ELSE 'ok' END AS reason FROM g LEFT JOIN s ON g.participant = s.participant AND g.week = s.week)"""


def _labelled(spark, sf_dir):
    """Weeks of a participant as windows, events as beats, ten hours as a second."""
    rows = samples(spark, sf_dir).withColumn("week", F.floor(F.col("t") / _WEEK).cast("long"))
    w = rows.groupBy("participant", "week").agg(F.array_sort(F.collect_list("t")).alias("p"), F.count("*").alias("n"), F.max(F.col("ord") % 97 == 0).alias("bad"), (F.min("ord") % 13 == 0).alias("poor"))
    return labels.label_cascade(w, F.col("n"), F.col("bad"), F.col("p"), 36000000000.0, F.when(F.col("poor"), "Unacceptable").otherwise(""), min_samples=3, min_beats=4, rr_band=(0.05, 3.0), max_cv=0.9)


@query(f"WITH {SAMPLES_SQL}, {_LABELLED_SQL} SELECT participant, week, CAST(n_peaks AS BIGINT) AS n_peaks, reason, reason = 'ok' AS valid, round(CASE WHEN reason = 'ok' THEN 60 / m END, 6) AS hr FROM l")
def label_cascade(spark, sf_dir):
    return _labelled(spark, sf_dir).select("participant", "week", "n_peaks", "reason", "valid", F.round("hr", 6).alias("hr"))


@query(f"WITH {SAMPLES_SQL}, {_LABELLED_SQL} SELECT participant, week, CAST(n_peaks AS BIGINT) AS n_peaks, round(60 / m, 6) AS hr FROM l WHERE reason = 'ok'")
def valid_labels(spark, sf_dir):
    return labels.keep_valid(_labelled(spark, sf_dir)).select("participant", "week", "n_peaks", F.round("hr", 6).alias("hr"))


@query(f"WITH {SAMPLES_SQL}, {_LABELLED_SQL} SELECT participant, CAST(count(*) AS BIGINT) AS total_windows_before, printf('%d (%.1f%%)', count(*) FILTER (reason = 'ok'), 100.0 * count(*) FILTER (reason = 'ok') / count(*)) AS kept_valid_windows, printf('%d (%.1f%%)', count(*) FILTER (reason <> 'ok'), 100.0 * count(*) FILTER (reason <> 'ok') / count(*)) AS dropped_invalid_windows FROM l GROUP BY participant")
def filter_summary(spark, sf_dir):
    return sinks.filter_summary(_labelled(spark, sf_dir), P)


@query(f"WITH {SAMPLES_SQL}, {_LABELLED_SQL} SELECT participant, CAST(count(*) AS BIGINT) AS n_windows, CAST(count(*) FILTER (reason = 'ok') AS BIGINT) AS n_kept, CAST(count(*) FILTER (reason <> 'ok') AS BIGINT) AS n_dropped, {', '.join(f'CAST(count(*) FILTER (reason = {chr(39)}{r}{chr(39)}) AS BIGINT) AS n_{r}' for r in labels.REASONS)} FROM l GROUP BY participant")
def label_summary(spark, sf_dir):
    return labels.label_summary(_labelled(spark, sf_dir), P)


@query(f"WITH {SAMPLES_SQL}, {_W3}, c AS (SELECT w.participant, w.t0, count(s.t) AS n FROM w3 w LEFT JOIN samples s ON s.participant = w.participant AND s.role = 'click' AND s.t BETWEEN w.t0 AND w.t1 GROUP BY ALL) SELECT participant, CAST(count(*) AS BIGINT) AS n_windows, CAST(count(*) FILTER (n >= 2) AS BIGINT) AS n_valid, round(count(*) FILTER (n >= 2) / count(*), 6) AS valid_ratio FROM c GROUP BY participant")
def valid_window_ratio(spark, sf_dir):
    """Windows with enough samples of the other signal, by participant."""
    out = metrics.valid_ratio(interval_slice_counts(spark, sf_dir), P, F.col("n_slice") >= 2)
    return out.withColumn("valid_ratio", F.round("valid_ratio", 6))


@query(f"""WITH {SAMPLES_SQL}, {_W3}, c AS (SELECT w.participant, w.t0, w.t1, count(s.t) AS n FROM w3 w LEFT JOIN samples s ON s.participant = w.participant AND s.role = 'click' AND s.t BETWEEN w.t0 AND w.t1 GROUP BY ALL),
i AS (SELECT *, max(t1) OVER (PARTITION BY participant ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE t1 > t0),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY participant ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS k FROM i),
m AS (SELECT participant, sum(e - s) / {HOUR} AS sec FROM (SELECT participant, k, min(t0) AS s, max(t1) AS e FROM k GROUP BY participant, k) GROUP BY participant),
n AS (SELECT participant, count(*) AS n_windows, count(*) FILTER (n >= 2) AS n_valid FROM c GROUP BY participant)
SELECT n.participant, CAST(n_windows AS BIGINT) AS n_windows, round(coalesce(sec, 0), 6) AS effective_s, printf('%02d:%02d:%02d', CAST(floor(coalesce(sec, 0)) AS BIGINT) // 3600, CAST(floor(coalesce(sec, 0)) AS BIGINT) // 60 % 60, CAST(floor(coalesce(sec, 0)) AS BIGINT) % 60) AS effective, printf('%d/%d (%.1f%%)', n_valid, n_windows, 100.0 * n_valid / n_windows) AS valid_hr FROM n LEFT JOIN m ON n.participant = m.participant""")
def run_summary(spark, sf_dir):
    """What a run of the windowing pipeline reports: windows, time covered without double counting (an hour as a second) and valid labels."""
    w = interval_slice_counts(spark, sf_dir)
    out = sinks.run_summary(w, P, "t0", "t1", F.col("n_slice") >= 2, float(HOUR))
    return out.withColumn("effective_s", F.round("effective_s", 6))


# -- metrics and folds -----------------------------------------------------------------------------------------------


def _metric_sql(keys: str, zero: bool, source: str) -> str:
    r = "CASE WHEN stddev_pop(y) > 0 AND stddev_pop(x) > 0 THEN covar_pop(y, x) / (stddev_pop(y) * stddev_pop(x)) END"
    r = f"coalesce({r}, 0.0)" if zero else r
    return f"SELECT {keys}, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS valid, round(avg(abs(y - x)), 5) AS mae, round(sqrt(avg((y - x) * (y - x))), 5) AS rmse, round({r}, 5) AS r, 100.0::DOUBLE AS valid_pct FROM {source} GROUP BY ALL"


def _rounded(df):
    return df.withColumns({c: F.round(c, 5) for c in ("mae", "rmse", "r")})


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_quantity")).withColumn("x", F.col("l_extendedprice") / 2000)


_PAIRS_SQL = "(SELECT *, l_quantity AS y, l_extendedprice / 2000 AS x FROM lineitem)"


@query(_metric_sql("l_returnflag, l_linestatus", False, _PAIRS_SQL))
def error_metrics(spark, sf_dir):
    return _rounded(metrics.error_metrics(_pairs(spark, sf_dir), ["l_returnflag", "l_linestatus"], "y", "x"))


@query(_metric_sql("l_suppkey", True, _PAIRS_SQL))
def error_metrics_zero_r(spark, sf_dir):
    return _rounded(metrics.error_metrics(_pairs(spark, sf_dir), ["l_suppkey"], "y", "x", zero_r=True))


@query(f"""WITH f AS ({_metric_sql("l_suppkey", True, _PAIRS_SQL)}) SELECT CAST(count(*) AS BIGINT) AS n_folds, {", ".join(f"round(avg({m}), 4) AS {m}_mean, round(stddev_pop({m}), 4) AS {m}_std" for m in ("mae", "rmse", "r"))} FROM f""")
def loso_macro_metrics(spark, sf_dir):
    out = metrics.macro_metrics(error_metrics_zero_r(spark, sf_dir), ["mae", "rmse", "r"])
    return out.select("n_folds", *(F.round(c, 4).alias(c) for c in out.columns if c != "n_folds"))


@query("""WITH r AS (SELECT event_type AS participant, event_id FROM events), t AS (SELECT DISTINCT participant AS target FROM r),
f AS (SELECT target, participant, CASE WHEN participant = target THEN 'test' WHEN substr(md5(concat_ws('|', target, participant, CAST(event_id AS VARCHAR))), 1, 8) < '33333333' THEN 'val' ELSE 'train' END AS split, event_id FROM r, t)
SELECT target, participant, split, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM f GROUP BY ALL""")
def loso_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("participant"), "event_id")
    out = folds.loso_folds(rows, "participant", ["participant", "event_id"])
    return out.groupBy("target", "participant", "split").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT c_nationkey, CASE WHEN h < '1999999a' THEN 'test' WHEN h < '40000000' THEN 'val' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, substr(md5(concat_ws('|', '7', CAST(c_custkey AS VARCHAR))), 1, 8) AS h FROM customer) GROUP BY ALL")
def three_way_split(spark, sf_dir):
    return folds.three_way(table(spark, sf_dir, "customer"), ["c_custkey"], 0.15, 0.1, seed=7).groupBy("c_nationkey", "split").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT unnest([0.0, 0.2, 0.5, 0.999, 1.0]) AS test, unnest(['00000000', '33333333', '80000000', 'ffbe76c9', 'g']) AS edge), h AS (SELECT c_custkey, substr(md5(concat_ws('|', '3', CAST(c_custkey AS VARCHAR))), 1, 8) AS h FROM customer)
SELECT test::DOUBLE AS test, CAST(count(*) FILTER (h < edge) AS BIGINT) AS n_test, CAST(coalesce(sum(c_custkey) FILTER (h < edge), 0) AS BIGINT) AS keys FROM s, h GROUP BY test""")
def two_way_split(spark, sf_dir):
    """Splits at five shares of test rows, from none to all."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    parts = [folds.two_way(rows, ["c_custkey"], t, seed=3).withColumn("test", F.lit(t)) for t in (0.0, 0.2, 0.5, 0.999, 1.0)]
    test = F.col("split") == "test"
    return folds.pooled(parts).groupBy("test").agg(F.count_if(test).alias("n_test"), F.coalesce(F.sum(F.when(test, F.col("c_custkey"))), F.lit(0)).alias("keys"))


@query(f"WITH {SAMPLES_SQL}, d AS (SELECT participant, t - lag(t) OVER (PARTITION BY participant ORDER BY t, ord) AS d FROM samples) SELECT participant, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN median(d) > 0 THEN 3600000000.0 / median(d) END, 6) AS fs FROM d GROUP BY participant")
def fs_estimate(spark, sf_dir):
    out = metrics.sampling_rate(samples(spark, sf_dir), P, "t", "ord", float(HOUR))
    return out.withColumn("fs", F.round("fs", 6))


@query(ORACLES["fs_estimate"])
def fs_estimate_bucketed(spark, sf_dir):
    """The same rates from buckets of a week."""
    out = metrics.sampling_rate(samples(spark, sf_dir), P, "t", "ord", float(HOUR), bucket=7 * 24 * HOUR)
    return out.withColumn("fs", F.round("fs", 6))


@query("WITH c AS (SELECT event_type, event_id // 500 AS c, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL) SELECT event_type, round(median(lo), 6) AS least, round(median(hi), 6) AS greatest FROM c GROUP BY event_type")
def chunk_extremes(spark, sf_dir):
    out = metrics.chunk_extremes(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value", 500)
    return out.select("event_type", F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"))


@query(ORACLES["chunk_extremes"])
def chunk_extremes_spread(spark, sf_dir):
    """The same by selection of the middle instead of a buffer of all chunks."""
    out = metrics.chunk_extremes(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value", 500, spread=True)
    return out.select("event_type", F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(median(CAST(l_extendedprice AS DOUBLE) * (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END)), 4) AS median FROM lineitem GROUP BY ALL")
def hot_key_median(spark, sf_dir):
    """Medians of few keys with many rows each, of both signs."""
    x = F.col("l_extendedprice").cast("double") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    out = metrics.exact_median(table(spark, sf_dir, "lineitem").withColumn("x", x), ["l_returnflag", "l_linestatus"], "x")
    return out.withColumn("median", F.round("median", 4))


@query("SELECT event_type AS role, event_id AS ord, round(value, 6) AS x FROM events")
def archive_rows(spark, sf_dir):
    """Samples as archives by device, written by many tasks and read back by the members that are asked for; times are left unread."""
    path = scratch(spark, "archives")
    archives.write_archives(samples(spark, sf_dir).select("role", "ord", "t", "x"), path, ["role"], ["ord"])
    return archives.read_archives(spark, path, "role string, ord long, x double", required="ord,x").withColumn("x", F.round("x", 6))


@query("SELECT event_type, round(min(value), 6) AS least, round(max(value), 6) AS greatest FROM events GROUP BY event_type")
def value_range(spark, sf_dir):
    out = metrics.value_range(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"))


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / ((SELECT stddev_pop(c_acctbal) FROM customer) + 1e-6), 6) AS c_acctbal FROM customer")
def column_zscore(spark, sf_dir):
    out = metrics.column_zscore(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT vec_id, e.label, round((SELECT count(*) FROM embeddings) / ((SELECT count(*) FROM n) * n), 6) AS weight FROM embeddings e JOIN n ON e.label = n.label")
def class_weights(spark, sf_dir):
    out = metrics.class_weights(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label")
    return out.select("vec_id", "label", F.round("weight", 6).alias("weight"))


# -- sources ---------------------------------------------------------------------------------------------------------


@query("WITH f AS (SELECT event_type AS source_file, user_id AS participant, event_id, epoch_us(ts) AS t, arg_min(epoch_us(ts), event_id) OVER (PARTITION BY user_id, event_type) AS first_t FROM events) SELECT participant, source_file, event_id, CAST(first_t // 1000 + (t - first_t) // 1000 AS BIGINT) AS epoch_ms FROM f")
def ecg_epoch_recompute(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("participant"), F.col("event_type").alias("source_file"), F.col("event_id").alias("ord"), F.col("ts"))
    first = F.min_by(F.unix_micros(F.col("ts").cast("timestamp")), "ord").over(segments.Window.partitionBy("participant", "source_file"))
    e = e.withColumn("rel_time_ms", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - first) / 1000).cast("double")).withColumn("phone_time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return ecg_epoch(e).select("participant", "source_file", F.col("ord").alias("event_id"), F.floor("ecg_epoch_ms").cast("long").alias("epoch_ms"))


@query("SELECT c_custkey, 'P' || CAST(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS VARCHAR) AS participant FROM customer")
def participant_id_normalise(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = F.regexp_extract("c_name", "([0-9]+)$", 1)
    return c.select("c_custkey", participant_id(F.when(F.col("c_custkey") % 2 == 0, raw).otherwise(F.concat(F.lit("p"), raw))).alias("participant"))


_BY_MONTH = "f AS (SELECT *, row_number() OVER m AS ord, first_value(ts) OVER m AS first_ts, first_value(event_type) OVER m AS site FROM events WINDOW m AS (PARTITION BY year(ts), month(ts) ORDER BY event_id))"
_MONTH = "date_format(ts, 'yyyyMM') AS month"


@query(f"WITH {_BY_MONTH} SELECT 'P7' AS participant, ord, round(epoch_us(ts) / 1000.0, 3) AS t_ms, site, round(value, 6) AS ppg, round(epoch_us(ts) / 1000.0 + 3600000, 3) AS phone_ms FROM f")
def device_csv_rows(spark, sf_dir):
    """Events as headerless CSV files by month of a device whose clock is an hour behind the phone's, read back in both time axes."""
    ts = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("double").alias("uptime"), (F.unix_micros(ts) / 1000).alias("epoch_ms"), F.date_format(ts + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("s"), "event_type", F.col("value").cast("double").alias("v"), "event_id", F.expr(_MONTH))
    path = scratch_csv(e, "month", "event_id")
    plain = readers.device_csv(spark, path, "P7")
    phone = readers.device_csv_phone_time(spark, path, "P7").select("ord", F.round("t_ms", 3).alias("phone_ms"), F.round(F.col("t_ms") - 3_600_000, 3).alias("_t"))
    rows = plain.select("participant", "ord", F.round("t_ms", 3).alias("_t"), "site", F.round("ppg", 6).alias("ppg"))
    return rows.join(phone, ["ord", "_t"]).select("participant", "ord", F.col("_t").alias("t_ms"), "site", "ppg", "phone_ms")


@query(f"WITH {_BY_MONTH} SELECT 'P8' AS participant, ord, round(epoch_us(first_ts) / 1000.0 + event_id * 8.0, 3) AS ecg_epoch_ms, event_id * 8.0::DOUBLE AS ecg_rel_ms, round(value, 6) AS ecg_uv FROM f")
def polar_csv_rows(spark, sf_dir):
    """Events as semicolon CSV files by month of an ECG strap: the first phone time plus the relative time."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("phone_time"), F.lit(0.0).alias("sensor_ns"), (F.col("event_id") * 8.0).alias("rel_time_ms"), F.col("value").cast("double").alias("ecg_uv"), "event_id", F.expr(_MONTH))
    out = readers.polar_csv(spark, scratch_csv(e, "month", "event_id", sep=";", header=True), "P8")
    return out.select("participant", "ord", F.round("ecg_epoch_ms", 3).alias("ecg_epoch_ms"), "ecg_rel_ms", F.round("ecg_uv", 6).alias("ecg_uv"))


@query("WITH f AS (SELECT *, 'P' || (user_id % 16) AS participant, arg_min(epoch_us(ts), event_id) OVER (PARTITION BY user_id % 16, event_type) AS f FROM events) SELECT participant, event_type AS source_file, event_id * 8.0::DOUBLE AS ecg_rel_ms, round(f / 1000.0 + event_id * 8.0, 3) AS recomputed_ms, round(epoch_us(ts) / 1000.0, 3) AS trusted_ms, round(value, 6) AS ecg_uv FROM f")
def merged_csv_rows(spark, sf_dir):
    """Events as merged ECG CSVs by participant, of several source files each, their times recomputed by file and taken as they are."""
    ts = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("phone_time"), (F.unix_micros(ts) / 1000).alias("time_ms"), F.lit(0.0).alias("sensor_time_ns"), (F.col("event_id") * 8.0).alias("rel_time_ms"), F.col("value").cast("double").alias("ecg_uv"), F.col("event_type").alias("source_file"), "event_id", F.concat(F.lit("P"), F.col("user_id") % 16).alias("participant"))
    path = scratch_csv(e, "participant", "event_id", header=True)
    a = readers.read_ecg(spark, path, None).select("participant", "ord", "source_file", "ecg_rel_ms", F.round("ecg_epoch_ms", 3).alias("recomputed_ms"), F.round("ecg_uv", 6).alias("ecg_uv"))
    b = readers.merged_csv(spark, path, None, recompute=False).select("participant", "ord", F.round("ecg_epoch_ms", 3).alias("trusted_ms"))
    return a.join(b, ["participant", "ord"]).select("participant", "source_file", "ecg_rel_ms", "recomputed_ms", "trusted_ms", "ecg_uv")


@query("WITH c AS (SELECT CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS participant, event_type AS role, count(*) AS n, min('/data/' || CAST(event_id AS VARCHAR)) AS path FROM events GROUP BY ALL) SELECT participant, role, path FROM c WHERE n = 1")
def discovered_files(spark, sf_dir):
    """Files by participant and device, where a device has one; an event is a file, and a user's day a participant."""
    day = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd")
    files = samples(spark, sf_dir).select(F.concat_ws("/", F.col("participant").cast("string"), day).alias("participant"), "role", F.concat(F.lit("/data/"), F.col("ord")).alias("path"))
    lone = files.groupBy("participant", "role").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return readers.discover(files.join(lone, ["participant", "role"]))


@query("SELECT DISTINCT user_id AS participant, row_number() OVER (ORDER BY user_id) AS place FROM (SELECT DISTINCT user_id FROM events)")
def participants_in_order(spark, sf_dir):
    """Distinct participants by name; the place of each is counted over the few of them."""
    names = readers.aligned_participants(samples(spark, sf_dir))
    return names.withColumn("place", F.row_number().over(segments.Window.orderBy("participant")).cast("long"))


@query("WITH a AS (SELECT user_id AS participant, min(epoch_us(ts)) / 1000.0 AS least FROM events GROUP BY ALL) SELECT event_id, round(1000 + epoch_us(ts) / 1000.0 - least, 3) AS t_ms FROM events e JOIN a ON e.user_id = a.participant")
def phone_time(spark, sf_dir):
    """Samples moved to another time axis by an anchor for each participant."""
    rows = samples(spark, sf_dir).select("participant", "ord", (F.col("t") / 1000).alias("t_ms"))
    anchors = rows.groupBy("participant").agg(F.lit(1000.0).alias("start_ms"), F.min("t_ms").alias("least_ms"))
    return readers.with_phone_time(rows, anchors, P).select(F.col("ord").alias("event_id"), F.round("t_ms", 3).alias("t_ms"))


# -- sinks -----------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, 'P' || CAST(label % 4 AS VARCHAR) AS participant, CASE WHEN vec_id % 2 = 0 THEN 'Ring' ELSE 'Watch' END AS role, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def windows_written(spark, sf_dir):
    """Windows written by participant and role, one role again on its own, and read back."""
    w = windows64(spark, sf_dir).select("vec_id", F.concat(F.lit("P"), F.col("label") % 4).alias("participant"), F.when(F.col("vec_id") % 2 == 0, "Ring").otherwise("Watch").alias("role"), "w")
    path = scratch(spark, "windows")
    sinks.write_windows(w, path)
    sinks.write_windows(w.where("role = 'Ring'"), path)
    out = spark.read.parquet(path)
    return out.select("vec_id", "participant", "role", F.size("w").cast("long").alias("n"), F.round(F.element_at("w", 1), 6).alias("first"))


@query("SELECT event_type AS channel, event_id, round(value, 6) AS hr_est FROM events")
def results_written(spark, sf_dir):
    path = scratch(spark, "results")
    sinks.write_results(table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), "event_id", F.round("value", 6).alias("hr_est")), path)
    return spark.read.csv(path, header=True, schema="channel string, event_id long, hr_est double")


@query("SELECT CAST(user_id AS VARCHAR) AS participant, CAST(printf('%.3f', CAST(event_id AS DOUBLE) / 8) AS DOUBLE) AS ground_truth_bpm, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 2 = 0) GROUP BY ALL")
def predictions_written(spark, sf_dir):
    """Predictions written, some of them again in appending mode, and read back with three decimals."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("participant"), (F.col("event_id") / 8).alias("ground_truth_bpm"), F.col("value").alias("predicted_bpm"), "event_id")
    path = scratch(spark, "predictions")
    sinks.write_predictions(e, path)
    sinks.write_predictions(e.where("event_id % 2 = 0"), path, append=True)
    return sinks.read_predictions(spark, path).groupBy("participant", "ground_truth_bpm").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT l_returnflag, avg(abs(l_quantity - l_extendedprice / 2000)) AS mae, sqrt(avg(pow(l_quantity - l_extendedprice / 2000, 2))) AS rmse FROM lineitem GROUP BY l_returnflag) SELECT 'mae' AS metric, printf('MAE: %.4f ± %.4f', avg(mae), stddev_pop(mae)) AS line FROM f UNION ALL SELECT 'rmse', printf('RMSE: %.4f ± %.4f', avg(rmse), stddev_pop(rmse)) FROM f")
def summary_lines(spark, sf_dir):
    return sinks.summary_lines(metrics.error_metrics(_pairs(spark, sf_dir), ["l_returnflag"], "y", "x"), ["mae", "rmse"])


@query(f"""WITH e AS (SELECT l_returnflag AS channel, l_linestatus AS algorithm, count(*) AS n, avg(abs(y - x)) AS mae, sqrt(avg((y - x) * (y - x))) AS rmse, covar_pop(y, x) / (stddev_pop(y) * stddev_pop(x)) AS r FROM {_PAIRS_SQL} GROUP BY ALL)
SELECT channel, algorithm, unnest([printf('%s: valid %d/%d (%.1f%%)', algorithm, n, n, 100.0), printf('  MAE: %.3f', mae), printf('  RMSE: %.3f', rmse), printf('  R: %.3f', r)]) AS line FROM e""")
def run_log(spark, sf_dir):
    e = metrics.error_metrics(_pairs(spark, sf_dir), ["l_returnflag", "l_linestatus"], "y", "x")
    return sinks.run_log(e.withColumnsRenamed({"l_returnflag": "channel", "l_linestatus": "algorithm"}), "%.3f")


# -- array functions -------------------------------------------------------------------------------------------------

_PLACES = "p AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE len(embedding) = 64)"


@query(f"WITH {_PLACES}, m AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s FROM p GROUP BY vec_id) SELECT p.vec_id, CAST(i AS INT) AS i, round((x - m) / (s + 1e-6), 5) + 0.0 AS z FROM p JOIN m ON p.vec_id = m.vec_id")
def window_zscore(spark, sf_dir):
    return windows64(spark, sf_dir).select("vec_id", F.posexplode(A.zscore(F.col("w"))).alias("i", "z")).withColumn("z", F.round("z", 5))


@query(f"WITH {_PLACES}, f AS (SELECT vec_id, regr_slope(x, i) AS b, regr_intercept(x, i) AS a FROM p GROUP BY vec_id) SELECT p.vec_id, CAST(i AS INT) AS i, round(x - a - b * i, 6) + 0.0 AS y FROM p JOIN f ON p.vec_id = f.vec_id")
def window_detrend(spark, sf_dir):
    return windows64(spark, sf_dir).select("vec_id", F.posexplode(A.detrend(F.col("w"))).alias("i", "y")).withColumn("y", F.round("y", 6))


@query(f"WITH {_PLACES} SELECT a.vec_id, CAST(a.i AS INT) AS i, round(a.x, 6) AS a, round(b.x, 6) AS b, round(c.x, 6) AS c FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i = a.i + 20 JOIN p c ON a.vec_id = c.vec_id AND c.i = a.i + 44 WHERE a.i < 20")
def channel_stack(spark, sf_dir):
    """Three channels of 24, 24 and 20 samples: the shortest gives the length."""
    stacked = A.stack_channels(F.slice("w", 1, 24), F.slice("w", 21, 24), F.slice("w", 45, 20))
    s = windows64(spark, sf_dir).select("vec_id", F.posexplode(stacked).alias("i", "s"))
    return s.select("vec_id", "i", *(F.round(F.element_at("s", k + 1), 6).alias(c) for k, c in enumerate("abc")))


@query(f"""WITH {_PLACES}, g AS (SELECT CASE vec_id % 4 WHEN 3 THEN 1.2e-5 ELSE (vec_id % 4) * 4e-6 END AS k, * FROM p)
SELECT vec_id, bool_and(abs(x - x * (1 + k)) <= 1e-8 + 1e-5 * abs(x * (1 + k))) AS alike FROM g GROUP BY vec_id""")
def arrays_alike(spark, sf_dir):
    """Windows against copies that are scaled a little, within and beyond the tolerance."""
    scale = F.when(F.col("vec_id") % 4 == 3, F.lit(1.2e-5)).otherwise((F.col("vec_id") % 4) * 4e-6)
    return windows64(spark, sf_dir).select("vec_id", A.allclose(F.col("w"), F.transform("w", lambda x: x * (1 + scale))).alias("alike"))


@query(f"WITH {_PLACES} SELECT vec_id, CAST(count(DISTINCT floor(x * 20)) AS INT) AS n, CAST(unnest(list_sort(list(DISTINCT CAST(floor(x * 20) AS BIGINT)))) AS BIGINT) AS v FROM p GROUP BY vec_id")
def distinct_levels(spark, sf_dir):
    levels = A.sorted_distinct(F.transform("w", lambda x: F.floor(x * 20).cast("long")))
    return windows64(spark, sf_dir).select("vec_id", F.size(levels).alias("n"), F.explode(levels).alias("v"))


@query(f"""WITH RECURSIVE {_PLACES}, t AS (SELECT a.vec_id, a.i, a.x FROM p a JOIN p l ON a.vec_id = l.vec_id AND l.i = a.i - 1 JOIN p r ON a.vec_id = r.vec_id AND r.i = a.i + 1 WHERE a.x > l.x AND a.x > r.x),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS k FROM t),
m AS (SELECT vec_id, k, [i] AS kept, x FROM k WHERE k = 1 UNION ALL
SELECT m.vec_id, k.k, CASE WHEN k.i - m.kept[-1] >= 4 THEN list_append(m.kept, k.i) WHEN k.x > m.x THEN list_append(m.kept[1:len(m.kept) - 1], k.i) ELSE m.kept END, CASE WHEN k.i - m.kept[-1] >= 4 OR k.x > m.x THEN k.x ELSE m.x END FROM m JOIN k ON k.vec_id = m.vec_id AND k.k = m.k + 1)
SELECT vec_id, CAST(unnest(arg_max(kept, k)) AS INT) AS peak FROM m GROUP BY vec_id""")
def peaks_apart(spark, sf_dir):
    """Local maxima at least four samples apart; of closer ones the higher."""
    at = lambda i: F.element_at("w", i + 1)
    tops = F.filter(F.sequence(F.lit(1), F.size("w") - 2), lambda i: (at(i) > at(i - 1)) & (at(i) > at(i + 1)))
    return windows64(spark, sf_dir).where(F.size("w") > 2).select("vec_id", F.explode(A.merge_close(tops, F.col("w"), 4)).alias("peak"))


@query("SELECT vec_id, round(CAST(embedding[3] AS DOUBLE), 6) AS ppg_necklace_ir, round(CAST(embedding[4] AS DOUBLE), 6) AS ppg_necklace_green, round(CAST(embedding[1] AS DOUBLE), 6) AS ppg_ring_ir, round(CAST(embedding[2] AS DOUBLE), 6) AS ppg_ring_green FROM embeddings")
def device_subset(spark, sf_dir):
    """The picked devices' channels of a table that has those of all devices."""
    devices, kinds = ["ring", "necklace", "watch"], ["ir", "green"]
    every = A.subset_columns(devices, kinds, [0, 1, 2])
    wide = windows64(spark, sf_dir).select("vec_id", *(F.round(F.element_at("w", k + 1), 6).alias(c) for k, c in enumerate(every)))
    return wide.select("vec_id", *A.subset_columns(devices, kinds, [1, 0]))


@query("SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN -value ELSE value END, 6) AS ppg_green, round(-value, 6) AS ppg_ir FROM events")
def channel_fallback(spark, sf_dir):
    """A channel where the table has it, and else the plain pulse column."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("ppg_green"), (-F.col("value")).alias("ppg"))
    return e.select("event_id", F.round(pulse_column(e, "ppg_green"), 6).alias("ppg_green"), F.round(pulse_column(e, "ppg_ir"), 6).alias("ppg_ir"))


@query("SELECT vec_id, CAST(60 + 10 * label AS DOUBLE) AS hr_gt, label % 4 AS role FROM embeddings WHERE 60 + 10 * label BETWEEN 30 AND 140 AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END), 'sum') = 0")
def model_input_filter(spark, sf_dir):
    w = windows64(spark, sf_dir).withColumn("hr_gt", (60 + 10 * F.col("label")).cast("double"))
    return w.where(A.model_input(F.col("hr_gt"), [F.col("w")], 30, 140)).select("vec_id", "hr_gt", (F.col("label") % 4).alias("role"))


@query("SELECT c_custkey, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS clock, CAST(round_even(c_acctbal, 0) AS BIGINT) AS key FROM (SELECT *, CAST(floor(abs(c_acctbal) * 37) AS BIGINT) AS s FROM customer)")
def clock_and_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", A.clock(F.abs("c_acctbal") * 37).alias("clock"), align.window_key("c_acctbal").alias("key"))


@query("SELECT DISTINCT event_type, lower(replace(event_type || '_2', '_', '')) || '_ir' AS run_label, CASE WHEN trim(CASE WHEN event_type = 'error' THEN '' ELSE event_type END) = '' THEN 'unknown' ELSE event_type END AS quality FROM events")
def text_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type").distinct()
    return e.select("event_type", A.run_label(F.concat("event_type", F.lit("_2")), F.lit("ppg_ir")).alias("run_label"), labels.quality_text(F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))).alias("quality"))


# -- estimators ------------------------------------------------------------------------------------------------------

_HANN = "h AS (SELECT vec_id, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS w FROM p)"


_FFT = f"""{_HANN}, bins AS (SELECT unnest(range(511, 3074)) AS k), d AS (SELECT vec_id, k, sqrt(pow(sum(w * cos(2 * pi() * k * i / 8192)), 2) + pow(sum(w * sin(2 * pi() * k * i / 8192)), 2)) AS m FROM h, bins GROUP BY vec_id, k),
fb AS (SELECT vec_id, arg_max(k, m) AS k FROM d WHERE k BETWEEN 512 AND 3072 GROUP BY vec_id),
fv AS (SELECT fb.vec_id, fb.k, max(CASE WHEN d.k = fb.k - 1 THEN m END) AS l, max(CASE WHEN d.k = fb.k THEN m END) AS c, max(CASE WHEN d.k = fb.k + 1 THEN m END) AS r FROM fb JOIN d ON fb.vec_id = d.vec_id AND d.k BETWEEN fb.k - 1 AND fb.k + 1 GROUP BY ALL),
fft AS (SELECT vec_id, 60 * (k + CASE WHEN abs(l - 2 * c + r) > 1e-10 THEN greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * c + r))) ELSE 0 END) * 8 / 8192 AS hr FROM fv)"""
_LAGS = f"""lags AS (SELECT unnest(range(2, 18)) AS k), ar AS (SELECT a.vec_id, k, sum(a.w * b.w) AS r FROM h a JOIN lags ON true JOIN h b ON a.vec_id = b.vec_id AND b.i = a.i + k GROUP BY a.vec_id, k),
ab AS (SELECT vec_id, arg_max(k, r) AS k FROM ar WHERE k BETWEEN 3 AND 16 GROUP BY vec_id),
av AS (SELECT ab.vec_id, ab.k, max(CASE WHEN ar.k = ab.k - 1 THEN r END) AS l, max(CASE WHEN ar.k = ab.k THEN r END) AS c, max(CASE WHEN ar.k = ab.k + 1 THEN r END) AS rr FROM ab JOIN ar ON ab.vec_id = ar.vec_id AND ar.k BETWEEN ab.k - 1 AND ab.k + 1 GROUP BY ALL),
autocorr AS (SELECT vec_id, 60 * 8 / (k + CASE WHEN abs(l - 2 * c + rr) > 1e-10 THEN greatest(-0.5, least(0.5, 0.5 * (l - rr) / (l - 2 * c + rr))) ELSE 0 END) AS hr FROM av)"""
# Sub-windows of 48 samples at 0 and 16; a place that tops its neighbours at all scales up to the one with most tops, moved to the largest of its three.
_SCALES = f"""sw AS (SELECT vec_id, s, i - s AS j, x FROM p, (SELECT unnest([0, 16]) AS s) WHERE i - s BETWEEN 0 AND 47),
top AS (SELECT m.vec_id, m.s, k, m.j, m.x > l.x AND m.x > r.x AS top FROM sw m JOIN (SELECT unnest(range(1, 24)) AS k) ON m.j BETWEEN k AND 47 - k JOIN sw l ON l.vec_id = m.vec_id AND l.s = m.s AND l.j = m.j - k JOIN sw r ON r.vec_id = m.vec_id AND r.s = m.s AND r.j = m.j + k),
best AS (SELECT vec_id, s, arg_min(k, k - 100 * n) AS k FROM (SELECT vec_id, s, k, count(*) FILTER (top) AS n FROM top GROUP BY ALL) GROUP BY ALL),
pk AS (SELECT top.vec_id, top.s, top.j FROM top JOIN best ON best.vec_id = top.vec_id AND best.s = top.s AND top.k <= best.k GROUP BY top.vec_id, top.s, top.j, best.k HAVING count(*) FILTER (top) = best.k),
near AS (SELECT DISTINCT pk.vec_id, pk.s + arg_max(sw.j, sw.x * 1e9 - sw.j * 1e-3) AS place FROM pk JOIN sw ON sw.vec_id = pk.vec_id AND sw.s = pk.s AND abs(sw.j - pk.j) <= 1 GROUP BY pk.vec_id, pk.s, pk.j),
gaps AS (SELECT vec_id, (place - lag(place) OVER (PARTITION BY vec_id ORDER BY place)) / 8.0 AS g FROM near),
msptd AS (SELECT w.vec_id, g.hr FROM (SELECT DISTINCT vec_id FROM p) w LEFT JOIN (SELECT vec_id, 60 / avg(g) AS hr FROM gaps WHERE g BETWEEN 0.3 AND 2 GROUP BY vec_id) g ON w.vec_id = g.vec_id)"""
_BAND = "CASE WHEN hr BETWEEN 30 AND {} THEN hr END"


@query(f"WITH {_PLACES}, {_FFT} SELECT vec_id, round({_BAND.format(180)}, 4) AS hr_fft FROM fft")
def hr_fft(spark, sf_dir):
    return windows64(spark, sf_dir).select("vec_id", F.round(E.heart_rate("fft", F.col("w"), 8.0), 4).alias("hr_fft"))


@query(f"WITH {_PLACES}, {_HANN}, {_LAGS} SELECT vec_id, round({_BAND.format(180)}, 4) AS hr_autocorr FROM autocorr")
def hr_autocorr(spark, sf_dir):
    return windows64(spark, sf_dir).select("vec_id", F.round(E.heart_rate("autocorr", F.col("w"), 8.0), 4).alias("hr_autocorr"))


@query(f"WITH {_PLACES}, {_SCALES} SELECT vec_id, round({_BAND.format(200)}, 4) AS hr_msptd FROM msptd")
def hr_msptd(spark, sf_dir):
    return windows64(spark, sf_dir).select("vec_id", F.round(E.heart_rate("msptd", F.col("w"), 8.0), 4).alias("hr_msptd"))


def _estimator(name: str):
    def run(spark, sf_dir):
        return windows64(spark, sf_dir).select("vec_id", E.heart_rate(name, F.col("w"), 8.0).alias(f"hr_{name}"))

    run.__name__ = f"hr_{name}"
    return query()(run)


for _name in ("pwd", "qppgfast", "neurokit", "heartpy"):
    _estimator(_name)


@query(f"""WITH {_PLACES}, {_FFT}, {_LAGS}, {_SCALES}, e AS (SELECT vec_id, 'fft' AS algorithm, {_BAND.format(180)} AS x FROM fft UNION ALL SELECT vec_id, 'autocorr', {_BAND.format(180)} FROM autocorr UNION ALL SELECT vec_id, 'msptd', {_BAND.format(200)} FROM msptd),
y AS (SELECT algorithm, 60.0 + 10 * label AS y, x FROM e JOIN embeddings USING (vec_id))
SELECT 'ppg_ir' AS channel, algorithm, CAST(count(*) AS BIGINT) AS n, CAST(count(x) AS BIGINT) AS valid, round(avg(abs(y - x)), 4) AS mae, round(sqrt(avg((y - x) * (y - x))), 4) AS rmse, round(corr(x, y), 4) AS r, round(100.0 * count(x) / count(*), 4) AS valid_pct FROM y GROUP BY algorithm""")
def estimates_long(spark, sf_dir):
    """Every estimator's answer beside the label, and its metrics by algorithm; some windows have no answer."""
    w = windows64(spark, sf_dir).withColumn("ppg_ir", F.col("w")).withColumn("hr_gt", 60.0 + 10 * F.col("label"))
    est = E.estimates(w, ["vec_id", "hr_gt"], ["ppg_ir", "ppg_green"], ["fft", "autocorr", "msptd"], 8.0)
    out = metrics.error_metrics(est, ["channel", "algorithm"], "hr_gt", "hr_est")
    return out.withColumns({c: F.round(c, 4) for c in ("mae", "rmse", "r", "valid_pct")})


@query()
def ecg_labels(spark, sf_dir):
    """Embeddings read as ECG windows at 30 Hz: labels by beats and quality."""
    return ecg.label_windows(windows64(spark, sf_dir).select("vec_id", "w"), "w", 30.0).drop("w")


def _filter_sql(source: str) -> str:
    """Common tables that end in ``filtered`` (vec_id, i, y): rows (vec_id, i, x) of 64 samples through the pulse band, forwards and
    backwards, step by step. The rows are prolonged by 15 samples at each end, turned about the end's own."""
    b, a = S.butterworth_band(0.7, 3.5, 8.0)
    zi = S.steady_state(b, a)
    wide = f"""ends AS (SELECT vec_id, max(CASE WHEN i = 0 THEN x END) AS first, max(CASE WHEN i = 63 THEN x END) AS last FROM {source} GROUP BY vec_id),
wide AS (SELECT vec_id, i + 15 AS k, x FROM {source} UNION ALL SELECT s.vec_id, 15 - i, 2 * first - x FROM {source} s JOIN ends USING (vec_id) WHERE i BETWEEN 1 AND 15 UNION ALL SELECT s.vec_id, 78 + 63 - i, 2 * last - x FROM {source} s JOIN ends USING (vec_id) WHERE i BETWEEN 48 AND 62)"""

    def run(name: str, rows: str) -> str:
        n = lambda v: format(float(v), ".17g")
        y = f"{n(b[0])} * {{x}} + {{z0}}"
        begin = [f"{n(zi[m])} * x" for m in range(4)]
        first = y.format(x="x", z0=f"({begin[0]})")
        step = y.format(x="w.x", z0="f.z0")
        state = lambda x, out, z: ", ".join(f"{n(b[m + 1])} * {x} + {z[m + 1] if m < 3 else '0'} - {n(a[m + 1])} * ({out}) AS z{m}" for m in range(4))
        start = f"SELECT vec_id, 0 AS k, {first} AS y, {state('x', first, [f'({z})' for z in begin])} FROM {rows} WHERE k = 0"
        return f"{name} AS ({start} UNION ALL SELECT w.vec_id, w.k, {step} AS y, {state('w.x', step, [f'f.z{m}' for m in range(4)])} FROM {name} f JOIN {rows} w ON w.vec_id = f.vec_id AND w.k = f.k + 1)"

    return f"{wide}, {run('once', 'wide')}, back AS (SELECT vec_id, 93 - k AS k, y AS x FROM once), {run('twice', 'back')}, filtered AS (SELECT vec_id, 78 - k AS i, y FROM twice WHERE k BETWEEN 15 AND 78)"


@query(f"WITH RECURSIVE {_PLACES}, {_filter_sql('p')} SELECT vec_id, CAST(i AS INT) AS i, round(y, 5) + 0.0 AS y FROM filtered")
def bandpass(spark, sf_dir):
    return windows64(spark, sf_dir).select("vec_id", F.posexplode(S.bandpass(F.col("w"), 8.0)).alias("i", "y")).withColumn("y", F.round("y", 5))


@query(f"WITH RECURSIVE {_PLACES}, f AS (SELECT vec_id, regr_slope(x, i) AS b, regr_intercept(x, i) AS a FROM p GROUP BY vec_id), straight AS (SELECT p.vec_id, i, x - a - b * i AS x FROM p JOIN f ON p.vec_id = f.vec_id), {_filter_sql('straight')} SELECT vec_id, CAST(i AS INT) AS i, round(y, 5) + 0.0 AS y, true AS ppg_preprocessed FROM filtered")
def pulse_preprocess(spark, sf_dir):
    out = S.preprocess_channels(windows64(spark, sf_dir).select("vec_id", F.col("w").alias("ppg")), 8.0)
    return out.select("vec_id", F.posexplode("ppg").alias("i", "y"), "ppg_preprocessed").withColumn("y", F.round("y", 5))


@query(f"""WITH {_PLACES}, j AS (SELECT unnest(range(0, 200)) AS j), k AS (SELECT unnest(range(1, 32)) AS k),
d AS (SELECT i, j, (1 + 2 * sum(cos(2 * pi() * k * (j / 200.0 - i / 64.0))) + (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * cos(2 * pi() * 32 * j / 200.0)) / 64 AS d FROM (SELECT unnest(range(0, 64)) AS i), j, k GROUP BY i, j)
SELECT vec_id, CAST(j AS INT) AS j, round(sum(x * d), 5) + 0.0 AS y FROM p JOIN d ON p.i = d.i GROUP BY vec_id, j""")
def resample200(spark, sf_dir):
    return windows64(spark, sf_dir).select("vec_id", F.posexplode(S.resample(F.col("w"), 200)).alias("j", "y")).withColumn("y", F.round("y", 5))


# -- models ----------------------------------------------------------------------------------------------------------


def _rated(spark, sf_dir):
    """Windows of eight participants with a label in beats a minute, and mean and mean square as features."""
    rows = windows64(spark, sf_dir).withColumns({"participant": F.concat(F.lit("P"), F.col("vec_id") % 8), "hr": 60.0 + 10 * F.col("label")})
    total = lambda f: F.aggregate(F.transform("w", f), F.lit(0.0), lambda a, b: a + b) / 64
    return rows.withColumn("features", F.array(total(lambda v: v), total(lambda v: v * v)))


@query("""WITH r AS (SELECT vec_id, 'P' || CAST(vec_id % 8 AS VARCHAR) AS participant, 60.0::DOUBLE + 10 * label AS y, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
f AS (SELECT vec_id, participant, y, list_sum(w) / 64 AS x, list_sum(list_transform(w, lambda v: v * v)) / 64 AS z FROM r),
s AS (SELECT participant, count(*) AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy FROM f GROUP BY participant),
t AS (SELECT sum(n) AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(xx) AS xx, sum(xz) AS xz, sum(zz) AS zz, sum(xy) AS xy, sum(zy) AS zy FROM s),
o AS (SELECT s.participant, t.n - s.n AS n, t.x - s.x AS x, t.z - s.z AS z, t.y - s.y AS y, t.xx - s.xx AS xx, t.xz - s.xz AS xz, t.zz - s.zz AS zz, t.xy - s.xy AS xy, t.zy - s.zy AS zy FROM s, t),
c AS (SELECT participant, n, x, z, y, xx - x * x / n + 1 AS a, xz - x * z / n AS b, zz - z * z / n + 1 AS d, xy - x * y / n AS p, zy - z * y / n AS q FROM o),
w AS (SELECT participant, n, x, z, y, (p * d - b * q) / (a * d - b * b) AS u, (a * q - b * p) / (a * d - b * b) AS v FROM c)
SELECT f.vec_id, f.participant, f.y AS hr, round((w.y - u * w.x - v * w.z) / n + u * f.x + v * f.z, 6) AS predicted_bpm FROM f JOIN w ON f.participant = w.participant""")
def loso_ridge(spark, sf_dir):
    """A ridge regression for each participant from the others' sums of products, all folds in one pass."""
    out = training.leave_one_out_ridge(_rated(spark, sf_dir), "participant", "features", "hr", 2)
    return out.select("vec_id", "participant", "hr", F.round("predicted_bpm", 6).alias("predicted_bpm"))


@query()
def loso_ridge_metrics(spark, sf_dir):
    """Errors by fold of ridge regressions on whole windows."""
    rows = _rated(spark, sf_dir).withColumn("x", A.zscore(F.col("w")))
    out = training.leave_one_out_ridge(rows, "participant", "x", "hr", 64)
    return metrics.error_metrics(out, P, "hr", "predicted_bpm", zero_r=True)


@query()
def probe_metrics(spark, sf_dir):
    """Errors by fold of a two-layer probe on whole windows, trained for all folds at once by data-parallel steps."""
    rows = _rated(spark, sf_dir).withColumn("x", A.zscore(F.col("w")))
    run = training.Training(training.TwoLayers(64, 16), scratch(spark, "probe"), rate=5e-3, epochs=6, batches=2)
    fitted = run.fit(rows, "participant", ["vec_id"], "x", "hr")
    return metrics.error_metrics(run.predictions(rows, fitted, "participant", "x"), P, "hr", "predicted_bpm", zero_r=True)


def _network_metrics(spark, sf_dir, model):
    rows = _rated(spark, sf_dir).withColumn("x", A.zscore(F.col("w")))
    run = training.Training(model, scratch(spark, "network"), rate=5e-3, epochs=3, batches=2)
    fitted = run.fit(rows, "participant", ["vec_id"], "x", "hr")
    return metrics.error_metrics(run.predictions(rows, fitted, "participant", "x"), P, "hr", "predicted_bpm", zero_r=True)


@query()
def convolution_metrics(spark, sf_dir):
    """Errors by fold of convolutions on whole windows."""
    return _network_metrics(spark, sf_dir, networks.Convolutions(64, (8, 16, 16)))


@query()
def recurrent_metrics(spark, sf_dir):
    """Errors by fold of two recurrent layers on whole windows."""
    return _network_metrics(spark, sf_dir, networks.Recurrent(64, hidden=16))


@query()
def attention_metrics(spark, sf_dir):
    """Errors by fold of attention over patches of whole windows."""
    return _network_metrics(spark, sf_dir, networks.Attention(64, width=16, depth=2))
