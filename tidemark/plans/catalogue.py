"""The queries over the codec operators, and the same in SQL.

Every query runs over whole tables. Round trips return decoded rows; their SQL selects the
originals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bits, digits, rounding, varint, vocabulary
from tidemark.operators import cascade, codec, entropy, metrics, positions, predictors, scaling, text_codec, tokens, windows
from tidemark.operators.series import events_by_type, events_by_user, orders_by_customer, table
from tidemark.sources import container, readers, writers
from tidemark.shipping import new_path
from tidemark.streaming import residuals

HEAD, L, S, BATCH = 16, 16, 4, 8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_USER = """s AS (
    SELECT user_id AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
           CAST(round_even(value * 100, 0) AS BIGINT) AS v, value
    FROM events WHERE value IS NOT NULL
)"""
_TYPE = _USER.replace("user_id", "event_type")
_CUSTOMER = """s AS (
    SELECT o_custkey AS series_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS pos,
           CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS v
    FROM orders WHERE o_totalprice IS NOT NULL
)"""
_CASCADE = (
    _USER
    + """, p AS (
    SELECT *, lag(v) OVER w AS p0, 2 * lag(v) OVER w - lag(v, 2) OVER w AS p1,
           CASE WHEN pos >= 16 THEN CAST(round_even(sum(v) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) / 16.0, 0) AS BIGINT) END AS p2
    FROM s WINDOW w AS (PARTITION BY series_id ORDER BY pos)
), t AS (
    SELECT *, 3 * coalesce(stddev_pop(v - p0) OVER (PARTITION BY series_id), 1.0) AS thr FROM p WHERE pos >= 16
)"""
)
_H2 = (
    _CASCADE
    + """, h AS (
    SELECT series_id, pos, v,
           CASE WHEN abs(v - p0) <= thr THEN 0 WHEN abs(v - p1) <= thr THEN 1
                WHEN abs(v - p0) <= abs(v - p1) THEN 0 ELSE 1 END AS method, p0, p1, p2
    FROM t
)"""
)
_H3 = (
    _CASCADE
    + """, h AS (
    SELECT series_id, pos, v,
           CASE WHEN abs(v - p0) <= thr THEN 0 WHEN abs(v - p1) <= thr THEN 1 WHEN abs(v - p2) <= thr THEN 2
                WHEN abs(v - p0) <= least(abs(v - p1), abs(v - p2)) THEN 0 WHEN abs(v - p1) <= abs(v - p2) THEN 1 ELSE 2 END AS method, p0, p1, p2
    FROM t
)"""
)


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# cascade


@query(f"WITH {_H2} SELECT method, count(*) AS n_rows, count(DISTINCT series_id) AS n_series FROM h GROUP BY method")
def hybrid_method_counts(spark, sf_dir):
    return cascade.method_counts(cascade.hybrid_rows(events_by_user(spark, sf_dir), HEAD))


@query(f"WITH {_H2} SELECT series_id, pos, v, method, v - CASE method WHEN 0 THEN p0 ELSE p1 END AS residual FROM h")
def hybrid_rows(spark, sf_dir):
    return cascade.hybrid_rows(events_by_user(spark, sf_dir), HEAD)


@query(f"WITH {_H3} SELECT series_id, pos, v, method, v - CASE method WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS residual FROM h")
def hybrid_rows_3tier(spark, sf_dir):
    return cascade.hybrid_rows(events_by_user(spark, sf_dir), HEAD, tiers=3)


def _residual(series: DataFrame, forecast) -> DataFrame:
    return series.select("series_id", "pos", (F.col("v") - forecast).alias("residual")).where("residual IS NOT NULL")


@query(f"WITH {_CASCADE} SELECT series_id, pos, v - p0 AS residual FROM p WHERE p0 IS NOT NULL")
def naive_residual(spark, sf_dir):
    return _residual(events_by_user(spark, sf_dir), predictors.naive())


@query(f"WITH {_CASCADE} SELECT series_id, pos, v - p1 AS residual FROM p WHERE p1 IS NOT NULL")
def linear_residual(spark, sf_dir):
    return _residual(events_by_user(spark, sf_dir), predictors.linear())


@query(f"WITH {_CASCADE} SELECT series_id, pos, v - p2 AS residual FROM p WHERE p2 IS NOT NULL")
def window_mean_residual(spark, sf_dir):
    return _residual(events_by_user(spark, sf_dir), predictors.window_mean(16))


@query(f"WITH {_CUSTOMER} SELECT * FROM (SELECT series_id, pos, v - lag(v) OVER (PARTITION BY series_id ORDER BY pos) AS residual FROM s) WHERE residual IS NOT NULL")
def orders_naive_residual(spark, sf_dir):
    return _residual(orders_by_customer(spark, sf_dir), predictors.naive())


@query(
    f"""WITH {_USER}, e AS (SELECT series_id, pos, v - lag(v) OVER (PARTITION BY series_id ORDER BY pos) AS e FROM s),
    g AS (SELECT series_id, coalesce(stddev_pop(e) FILTER (WHERE pos >= 16), 1.0) AS sigma FROM e GROUP BY series_id)
    SELECT series_id, round(sigma, 6) AS sigma, round(3 * sigma, 6) AS threshold FROM g"""
)
def series_sigma(spark, sf_dir):
    made = cascade.series_sigma(events_by_user(spark, sf_dir), HEAD)
    return made.select("series_id", F.round("sigma", 6).alias("sigma"), F.round("threshold", 6).alias("threshold"))


@query(
    f"""WITH {_USER} SELECT series_id, pos, CAST(v AS DOUBLE) / 100 AS value, round_even(value * 10, 0) / 10 AS rounded,
    CAST(trunc(value) AS BIGINT) AS cut, CAST(round_even(value, 0) AS BIGINT) AS whole FROM s"""
)
def half_even_rounding(spark, sf_dir):
    x = F.col("value")
    return events_by_user(spark, sf_dir).select(
        "series_id", "pos", (F.col("v").cast("double") / 100).alias("value"), rounding.half_even(x, 1).alias("rounded"), rounding.truncated(x).alias("cut"), rounding.rounded(x).alias("whole")
    )


# scalers

_BASIC = "b AS (SELECT series_id, 0.0::DOUBLE AS shift, greatest(quantile_cont(abs(value), 0.95), 0.01) AS q FROM s GROUP BY series_id)"
_AFFINE = """m AS (SELECT series_id, min(value) - 0.3 * (max(value) - min(value)) AS shift, quantile_cont(value, 0.95) AS p FROM s GROUP BY series_id),
    b AS (SELECT series_id, shift, CASE WHEN p - shift = 0 THEN 1.0 ELSE p - shift END AS q FROM m)"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


@query(f"WITH {_USER}, {_BASIC} SELECT series_id, round(shift, 6) AS shift, round(q, 6) AS q FROM b")
def quantile_scaler_basic(spark, sf_dir):
    return _rounded(scaling.quantile_scaler(events_by_user(spark, sf_dir), basic=True), "shift", "q")


@query(f"WITH {_USER}, {_AFFINE} SELECT series_id, round(shift, 6) AS shift, round(q, 6) AS q FROM b")
def quantile_scaler_affine(spark, sf_dir):
    return _rounded(scaling.quantile_scaler(events_by_user(spark, sf_dir)), "shift", "q")


def _scaled(spark, sf_dir) -> DataFrame:
    rows = events_by_user(spark, sf_dir)
    both = rows.join(scaling.quantile_scaler(rows), "series_id")
    return both.withColumn("z", digits.scale(F.col("value"), F.col("shift"), F.col("q")))


@query(f"WITH {_USER}, {_AFFINE} SELECT series_id, pos, round((value - shift) / q, 6) AS z FROM s JOIN b USING (series_id)")
def scaled_values(spark, sf_dir):
    return _scaled(spark, sf_dir).select("series_id", "pos", F.round("z", 6).alias("z"))


@query(f"WITH {_USER} SELECT series_id, pos, v FROM s")
def scaler_roundtrip(spark, sf_dir):
    back = digits.unscale(F.col("z"), F.col("shift"), F.col("q"))
    return _scaled(spark, sf_dir).select("series_id", "pos", rounding.scaled(back, 2).alias("v"))


# windows

_LAYOUT = """l AS (SELECT series_id, count(*) AS n, CAST(greatest(0, ceil((count(*) - 16) / 4.0)) AS BIGINT) AS windows FROM s GROUP BY series_id)"""
_PADDED = (
    _LAYOUT
    + """, pad AS (
    SELECT series_id, pos, v FROM s
    UNION ALL SELECT series_id, CAST(unnest(range(n, windows * 4 + 16)) AS BIGINT), 0 FROM l WHERE windows > 0
)"""
)


@query(f"WITH {_USER}, {_LAYOUT} SELECT series_id, n, windows, CASE WHEN windows > 0 THEN windows * 4 - (n - 16) ELSE 0 END AS rem FROM l")
def window_layout(spark, sf_dir):
    return windows.layout(events_by_user(spark, sf_dir), L, S)


@query(f"WITH {_USER}, {_PADDED} SELECT series_id, pos, v FROM pad")
def padded_series(spark, sf_dir):
    return windows.padded(events_by_user(spark, sf_dir), L, S)


@query(
    f"""WITH {_USER}, {_PADDED}, w AS (SELECT series_id, unnest(range(windows)) AS win FROM l)
    SELECT w.series_id, CAST(win AS BIGINT) AS win, CAST(pad.pos - win * 4 AS INTEGER) AS k, v FROM w JOIN pad
    ON pad.series_id = w.series_id AND pad.pos BETWEEN win * 4 AND win * 4 + 19"""
)
def strided_windows(spark, sf_dir):
    made = windows.strided(windows.padded(events_by_user(spark, sf_dir), L, S), L, S)
    return made.select("series_id", "win", F.posexplode(F.concat("ctx", "tgt")).alias("k", "v"))


@query(
    f"""WITH {_USER}, {_PADDED}, w AS (SELECT series_id, unnest(range(windows)) AS win FROM l)
    SELECT w.series_id, CAST(win AS BIGINT) AS win, CAST(sum(v) FILTER (WHERE pad.pos < win * 4 + 16) AS BIGINT) AS ctx_sum,
           CAST(sum(v) FILTER (WHERE pad.pos >= win * 4 + 16) AS BIGINT) AS tgt_sum FROM w JOIN pad
    ON pad.series_id = w.series_id AND pad.pos BETWEEN win * 4 AND win * 4 + 19 GROUP BY ALL"""
)
def window_xy(spark, sf_dir):
    made = windows.strided(windows.padded(events_by_user(spark, sf_dir), L, S), L, S)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return made.select("series_id", "win", total("ctx").alias("ctx_sum"), total("tgt").alias("tgt_sum"))


@query(
    f"""WITH {_USER}, {_PADDED}, w AS (SELECT series_id, unnest(range(windows)) AS win FROM l),
    m AS (SELECT w.series_id, win, round_even(avg(v), 0) AS p FROM w JOIN pad ON pad.series_id = w.series_id AND pad.pos BETWEEN win * 4 AND win * 4 + 15 GROUP BY ALL)
    SELECT m.series_id, pad.pos, v - CAST(p AS BIGINT) AS residual FROM m JOIN pad
    ON pad.series_id = m.series_id AND pad.pos BETWEEN win * 4 + 16 AND win * 4 + 19"""
)
def model_window_residuals(spark, sf_dir):
    made = windows.strided(windows.padded(events_by_user(spark, sf_dir), L, S), L, S)
    return predictors.window_residuals(predictors.predict_windows(made, lambda: predictors.WindowMean(S)), L, S)


@query(
    f"""WITH {_USER}, l AS (SELECT series_id, CAST(ceil((count(*) - 16) / 4.0) AS BIGINT) AS windows FROM s GROUP BY series_id HAVING count(*) > 16),
    w AS (SELECT series_id, unnest(range(windows)) AS win FROM l), x AS (
        SELECT w.series_id, win, a.value AS last FROM w JOIN s a ON a.series_id = w.series_id AND a.pos = win * 4 + 15
    ) SELECT x.series_id, s.pos, round_even((s.value - last) * 100, 0) / 100 AS residual FROM x JOIN s ON s.series_id = x.series_id AND s.pos BETWEEN win * 4 + 16 AND win * 4 + 19"""
)
def model_float_residuals(spark, sf_dir):
    rows = events_by_user(spark, sf_dir).select("series_id", "pos", F.col("value").alias("v"))
    made = predictors.predict_windows(windows.strided(windows.padded(rows, L, S), L, S), lambda: predictors.LastValue(S))
    return windows.stripped(predictors.window_residuals(made, L, S, decimals=2), windows.layout(rows, L, S))


def _plugged(spark, sf_dir) -> DataFrame:
    rows = events_by_user(spark, sf_dir)
    return cascade.hybrid_rows(rows, HEAD, forecasts=predictors.model_forecasts(rows, lambda: predictors.WindowMean(S), L, S))


@query(
    f"""WITH {_CASCADE}, {_PADDED}, w AS (SELECT series_id, unnest(range(windows)) AS win FROM l),
    m AS (SELECT w.series_id, win, CAST(round_even(avg(v), 0) AS BIGINT) AS f FROM w JOIN pad ON pad.series_id = w.series_id AND pad.pos BETWEEN win * 4 AND win * 4 + 15 GROUP BY ALL),
    x AS (SELECT t.series_id, t.pos, t.v, thr, p0, p1, f FROM t JOIN m ON m.series_id = t.series_id AND m.win = (t.pos - 16) // 4),
    h AS (
        SELECT *, CASE WHEN abs(v - p0) <= thr THEN 0 WHEN abs(v - p1) <= thr THEN 1 WHEN abs(v - f) <= thr THEN 2
                  WHEN abs(v - p0) <= least(abs(v - p1), abs(v - f)) THEN 0 WHEN abs(v - p1) <= abs(v - f) THEN 1 ELSE 2 END AS method
        FROM x
    )
    SELECT series_id, pos, v, method, v - CASE method WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE f END AS residual FROM h"""
)
def hybrid_plugin_rows(spark, sf_dir):
    return _plugged(spark, sf_dir)


@query(f"WITH {_USER} SELECT series_id, pos, v FROM s")
def hybrid_plugin_roundtrip(spark, sf_dir):
    heads = events_by_user(spark, sf_dir).where(F.col("pos") < HEAD)
    return codec.decode_hybrid(codec.encode_hybrid(_plugged(spark, sf_dir), heads), factory=lambda: predictors.WindowMean(S), length=L, step=S)


@query(f"WITH {_USER} SELECT series_id, pos, v FROM s")
def strip_padding(spark, sf_dir):
    rows = events_by_user(spark, sf_dir)
    return windows.stripped(windows.padded(rows, L, S), windows.layout(rows, L, S))


@query(f"WITH {_USER} SELECT series_id, pos, v FROM s")
def model_residual_roundtrip(spark, sf_dir):
    rows = events_by_user(spark, sf_dir)
    sizes = windows.layout(rows, L, S)
    padded = windows.padded(rows, L, S)
    made = predictors.predict_windows(windows.strided(padded, L, S), lambda: predictors.WindowMean(S))
    back = codec.decode_residuals(rows.where(F.col("pos") < L), predictors.window_residuals(made, L, S), lambda: predictors.WindowMean(S), L, S)
    return windows.stripped(back, sizes).select("series_id", "pos", "v")


def _long(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("value").isNotNull()).select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")
    placed = positions.long_positions(rows, "series_id", ["ts", "event_id"], F.to_date("ts"))
    return placed.select("series_id", "pos", rounding.scaled(F.col("value"), 2).alias("v"))


@query(f"WITH {_TYPE} SELECT series_id, pos, v FROM s")
def long_positions(spark, sf_dir):
    return _long(spark, sf_dir)


@query(f"WITH {_TYPE} SELECT series_id, pos, v FROM s")
def long_series_roundtrip(spark, sf_dir):
    streams = positions.cut_streams(_long(spark, sf_dir), 1024)
    coded = codec.encode_hybrid(cascade.hybrid_rows(streams, HEAD, tiers=3), streams.where(F.col("pos") < HEAD))
    return positions.join_streams(codec.decode_hybrid(coded), 1024)


@query(
    f"""WITH {_TYPE}, l AS (SELECT series_id, CAST(ceil((count(*) - 16) / 4.0) AS BIGINT) AS windows FROM s GROUP BY series_id HAVING count(*) > 16),
    c AS (SELECT series_id, windows, windows // 8 AS per, CASE WHEN windows % 8 > 0 THEN 8 ELSE 7 END AS streams FROM l),
    r AS (SELECT *, unnest(range(streams + 1)) AS k FROM c),
    q AS (SELECT *, CASE WHEN k < streams THEN per WHEN windows % 8 > 0 THEN windows % 8 ELSE per END AS own FROM r)
    SELECT series_id, CAST(k AS BIGINT) AS stream_id, k = streams AS is_final, CAST(k * per AS BIGINT) AS first_window, CAST(own AS BIGINT) AS windows,
           CAST(CASE WHEN k = streams THEN own ELSE greatest(0, own - 4) END AS BIGINT) AS coded_windows FROM q WHERE own > 0"""
)
def stream_layout(spark, sf_dir):
    made = windows.stream_layout(windows.layout(events_by_type(spark, sf_dir), L, S), L, S, BATCH)
    return made.select("series_id", "stream_id", "is_final", "first_window", "windows", F.col("coded_windows").cast("bigint").alias("coded_windows"))


@query(f"WITH {_USER} SELECT series_id, pos, v FROM s")
def prefix_decode_naive(spark, sf_dir):
    rows = events_by_user(spark, sf_dir)
    residual = F.col("v") - F.coalesce(predictors.naive(), F.lit(0))
    return cascade.prefix_decode(rows.select("series_id", "pos", residual.alias("residual")))


# methods: frequencies and coding

_FREQS = """f AS (
    SELECT c.series_id, m AS method, 1 + (SELECT count(*) FROM h WHERE h.series_id = c.series_id AND h.method = m) AS freq
    FROM (SELECT DISTINCT series_id FROM h) c, (SELECT unnest([0, 1, 2]) AS m)
), cf AS (SELECT *, CAST(sum(freq) OVER (PARTITION BY series_id ORDER BY method) AS BIGINT) AS cum_hi FROM f)"""


def _methods(spark, sf_dir) -> DataFrame:
    return cascade.hybrid_rows(events_by_user(spark, sf_dir), HEAD, tiers=3)


@query(f"WITH {_H3}, {_FREQS} SELECT series_id, method, freq FROM f")
def method_freqs(spark, sf_dir):
    return entropy.method_table(_methods(spark, sf_dir)).select("series_id", "method", "freq")


@query(f"WITH {_H3}, {_FREQS} SELECT series_id, method, freq, cum_hi - freq AS cum_lo, cum_hi FROM cf")
def method_cumul(spark, sf_dir):
    return entropy.method_table(_methods(spark, sf_dir))


@query(
    f"""WITH {_H3}, {_FREQS} SELECT series_id, round(sum((freq - 1) * log2(total / freq)), 6) AS ideal_bits
    FROM (SELECT *, sum(freq) OVER (PARTITION BY series_id) AS total FROM f) GROUP BY series_id"""
)
def method_ideal_bits(spark, sf_dir):
    return _rounded(entropy.method_bits(_methods(spark, sf_dir)), "ideal_bits")


@query(f"WITH {_H3} SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS BIGINT) AS pos, method AS v FROM h")
def ac_methods_roundtrip(spark, sf_dir):
    coded = codec.encode_methods(codec.gathered(_methods(spark, sf_dir), "method"))
    return codec.exploded(codec.decode_methods(coded), "method")


@query()
def ac_method_sizes(spark, sf_dir):
    coded = codec.encode_methods(codec.gathered(_methods(spark, sf_dir), "method"))
    return coded.select("series_id", "n", F.octet_length("payload").cast("bigint").alias("n_bytes"), bits.effective_bits_column(F.col("payload")).alias("n_bits"))


# XOR coding

_XOR = f"""{_CASCADE}, r AS (
    SELECT series_id, pos, v - p0 AS r, lag(v - p0) OVER (PARTITION BY series_id ORDER BY pos) AS pr FROM t
), x AS (SELECT series_id, pos, bin(xor(r, pr)) AS b, xor(r, pr) AS x FROM r WHERE pr IS NOT NULL),
y AS (SELECT *, CASE WHEN x = 0 THEN 64 ELSE 64 - length(b) END AS lz, CASE WHEN x = 0 THEN 0 ELSE length(b) - length(rtrim(b, '0')) END AS tz FROM x),
z AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE 64 - lz - tz END AS sig FROM y)"""


def _xor_rows(spark, sf_dir) -> DataFrame:
    rows = events_by_user(spark, sf_dir).select("series_id", "pos", (F.col("v") - predictors.naive()).alias("r")).where(F.col("pos") >= HEAD)
    before = F.lag("r").over(predictors.by_series())
    pairs = rows.withColumn("pr", before).where("pr IS NOT NULL")
    return pairs.select("series_id", "pos", *[c.alias(k) for k, c in codec.xor_layout(F.col("r"), F.col("pr")).items()])


@query(f"WITH {_XOR} SELECT series_id, pos, CAST(lz AS INTEGER) AS lz, CAST(tz AS INTEGER) AS tz, CAST(sig AS INTEGER) AS sig, CAST(CASE WHEN x = 0 THEN 1 ELSE 13 + sig END AS INTEGER) AS bits FROM z")
def xor_int_layout(spark, sf_dir):
    return _xor_rows(spark, sf_dir)


@query(f"WITH {_XOR} SELECT series_id, CAST(64 + sum(CASE WHEN x = 0 THEN 1 ELSE 13 + sig END) AS BIGINT) AS bits FROM z GROUP BY series_id")
def xor_int_bits(spark, sf_dir):
    return _xor_rows(spark, sf_dir).groupBy("series_id").agg((F.sum("bits") + 64).alias("bits"))


@query(f"WITH {_XOR} SELECT series_id, CAST(64 + sum(CASE WHEN x = 0 THEN 1 ELSE 13 + sig END) AS BIGINT) AS bits FROM z GROUP BY series_id")
def xor_int_coded_bits(spark, sf_dir):
    rows = events_by_user(spark, sf_dir).select("series_id", "pos", (F.col("v") - predictors.naive()).alias("r")).where(F.col("pos") >= HEAD)
    return codec.encode_words(codec.gathered(rows, "r"), "r").where("n > 1").select("series_id", F.col("bit_len").alias("bits"))


@query(f"WITH {_USER} SELECT series_id, pos, v FROM s")
def xor_int_roundtrip(spark, sf_dir):
    coded = codec.encode_words(codec.gathered(events_by_user(spark, sf_dir), "v"), "v")
    return codec.exploded(codec.decode_words(coded))


@query(f"WITH {_USER} SELECT series_id, pos, value AS v FROM s")
def xor_float_roundtrip(spark, sf_dir):
    coded = codec.encode_words(codec.gathered(events_by_user(spark, sf_dir), "value"), "value", floats=True)
    return codec.exploded(codec.decode_words(coded, floats=True))


def _hybrid(spark, sf_dir) -> DataFrame:
    rows = events_by_user(spark, sf_dir)
    return codec.encode_hybrid(cascade.hybrid_rows(rows, HEAD, tiers=3), rows.where(F.col("pos") < HEAD))


@query(f"WITH {_USER} SELECT series_id, pos, v FROM s")
def hybrid_roundtrip(spark, sf_dir):
    return codec.decode_hybrid(_hybrid(spark, sf_dir))


@query(f"WITH {_USER} SELECT count(*) AS n, CAST(0 AS BIGINT) AS different, CAST(0 AS BIGINT) AS max_abs, 0.0::DOUBLE AS mean_abs FROM s")
def verify_diff(spark, sf_dir):
    return metrics.verify(events_by_user(spark, sf_dir), codec.decode_hybrid(_hybrid(spark, sf_dir)))


@query()
def compression_metrics(spark, sf_dir):
    return metrics.hybrid_ratios(_hybrid(spark, sf_dir))


@query(f"WITH {_USER} SELECT series_id, count(*) * 64 AS file_bits FROM s GROUP BY series_id")
def raw_series_bits(spark, sf_dir):
    return metrics.raw_bits(events_by_user(spark, sf_dir))


@query(f"WITH {_USER} SELECT series_id, pos, v FROM s")
def container_roundtrip(spark, sf_dir):
    rows = events_by_user(spark, sf_dir).withColumn("stream_id", F.floor(F.col("pos") / 32).cast("int"))
    split = rows.select(F.struct("series_id", "stream_id").alias("series_id"), "pos", "v")
    coded = codec.encode_words(codec.gathered(split, "v"), "v").select("series_id.series_id", "series_id.stream_id", F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), "payload").alias("payload"))
    parts = container.unpack(container.pack(coded))
    n = F.conv(F.hex(F.substring("payload", 1, 8)), 16, 10).cast("bigint")
    again = parts.select(F.struct("series_id", "stream_id").alias("series_id"), n.alias("n"), F.expr("substring(payload, 9)").alias("payload"))
    back = codec.exploded(codec.decode_words(again))
    return back.select("series_id.series_id", (F.col("series_id.stream_id") * 32 + F.col("pos")).alias("pos"), "v")


# characters, ranks and text coding

_PAIRS = """d AS (SELECT doc_id, string_split(text, '') AS a FROM documents WHERE length(text) > 0),
u AS (SELECT doc_id, a, unnest(range(len(a))) AS k FROM d),
pr AS (SELECT doc_id, CAST(k AS BIGINT) AS pos, CASE WHEN k = 0 THEN '' ELSE a[k] END AS ctx, a[k + 1] AS token FROM u),
n AS (SELECT ctx, token, count(*) AS n FROM pr GROUP BY ctx, token),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY ctx ORDER BY n DESC, token) - 1 AS INTEGER) AS rank FROM n)"""
_TURN_PAIRS = _PAIRS.replace("doc_id", "conv_id, turn").replace("documents", "conversations")


def _pairs(spark, sf_dir) -> DataFrame:
    return entropy.successors(table(spark, sf_dir, "documents"), "text", "doc_id")


def _turn_pairs(spark, sf_dir) -> DataFrame:
    return entropy.successors(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn")


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS token FROM documents WHERE length(text) > 0) GROUP BY token")
def char_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.length("text") > 0).select(F.explode(F.split("text", "")).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PAIRS} SELECT token, count(*) AS n, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS idx FROM pr GROUP BY token")
def vocab_dense(spark, sf_dir):
    return vocabulary.dense_vocabulary(_pairs(spark, sf_dir))


@query("SELECT doc_id, text FROM documents WHERE length(text) > 0")
def detokenize(spark, sf_dir):
    made = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "")
    return _pairs(spark, sf_dir).groupBy("doc_id").agg(made.alias("text"))


_NUMERIC = _USER + ", q AS (SELECT series_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS text FROM s GROUP BY series_id)"
_IDS = ", ".join(f"('{c}', {i}, {vocabulary.dense_index()[c]})" for c, i in vocabulary.symbol_ids().items())


def _numeric_text(spark, sf_dir) -> DataFrame:
    rows = codec.gathered(events_by_user(spark, sf_dir), "v")
    return rows.select("series_id", F.concat_ws(",", F.col("v").cast("array<string>")).alias("text"))


@query(
    f"""WITH {_NUMERIC}, m(c, id, idx) AS (VALUES {_IDS}), u AS (SELECT series_id, unnest(string_split(text, '')) AS c FROM q)
    SELECT series_id, CAST(id AS INTEGER) AS id, CAST(idx AS INTEGER) AS idx, count(*) AS n FROM u JOIN m USING (c) GROUP BY ALL"""
)
def numeric_text_tokens(spark, sf_dir):
    chars = _numeric_text(spark, sf_dir).select("series_id", F.explode(F.split("text", "")).alias("c"))
    made = chars.select("series_id", vocabulary.lookup(F.col("c"), vocabulary.symbol_ids()).alias("id"), vocabulary.lookup(F.col("c"), vocabulary.dense_index()).alias("idx"))
    return made.groupBy("series_id", "id", "idx").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_PAIRS} SELECT ctx, token, n, round((n + 1) / sum(n + 1) OVER (PARTITION BY ctx), 9) AS prob FROM n")
def kgram_probs(spark, sf_dir):
    made = entropy.smoothed(entropy.successor_counts(_pairs(spark, sf_dir)))
    return made.select("ctx", "token", "n", F.round("prob", 9).alias("prob"))


@query(
    f"""WITH {_PAIRS}, p AS (SELECT ctx, token, (n + 1) / sum(n + 1) OVER (PARTITION BY ctx) AS prob FROM n),
    g AS (SELECT ctx, token, CASE WHEN token IN ('a', 'e', 'i', 'o', 'u') THEN prob ELSE 0 END AS prob FROM p)
    SELECT ctx, token, round(prob / sum(prob) OVER (PARTITION BY ctx), 9) AS prob FROM g
    QUALIFY sum(prob) OVER (PARTITION BY ctx) > 0"""
)
def good_token_renorm(spark, sf_dir):
    probs = entropy.smoothed(entropy.successor_counts(_pairs(spark, sf_dir)))
    allowed = F.col("token").isin("a", "e", "i", "o", "u")
    over = Window.partitionBy("ctx")
    some = probs.withColumn("any", F.max(allowed).over(over)).where("any")
    return some.select("ctx", "token", F.round(entropy.renormalise(F.col("prob"), allowed, over), 9).alias("prob"))


@query(
    """WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS k FROM embeddings),
    e AS (SELECT vec_id, k, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM s)
    SELECT vec_id, CAST(k AS INTEGER) AS k, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS prob FROM e"""
)
def softmax_scores(spark, sf_dir):
    probs = entropy.softmax_array(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(probs).alias("k", "prob")).select("vec_id", "k", F.round("prob", 9).alias("prob"))


@query(f"WITH {_TURN_PAIRS} SELECT conv_id, turn, pos, rank FROM pr JOIN rk USING (ctx, token)")
def token_rank(spark, sf_dir):
    rows = _turn_pairs(spark, sf_dir)
    return entropy.token_ranks(rows, entropy.ranked(entropy.successor_counts(rows))).select("conv_id", "turn", "pos", "rank")


@query(f"WITH {_PAIRS} SELECT rank, CAST(sum(n) AS BIGINT) AS n FROM rk GROUP BY rank")
def rank_histogram(spark, sf_dir):
    counts = entropy.ranked(entropy.successor_counts(_pairs(spark, sf_dir)))
    return counts.groupBy("rank").agg(F.sum("n").alias("n"))


@query(f"WITH {_PAIRS} SELECT ctx, token FROM rk WHERE rank = 0")
def greedy_successor(spark, sf_dir):
    return entropy.greedy(entropy.successor_counts(_pairs(spark, sf_dir)))


@query(f"WITH {_TURN_PAIRS} SELECT conv_id, turn, pos, token FROM pr")
def rank_inverse(spark, sf_dir):
    rows = _turn_pairs(spark, sf_dir)
    table_ = entropy.ranked(entropy.successor_counts(rows))
    ranks = entropy.token_ranks(rows, table_).select("conv_id", "turn", "pos", "ctx", "rank")
    return entropy.token_at_rank(table_, ranks).select("conv_id", "turn", "pos", "token")


@query(
    f"""WITH {_PAIRS}, p AS (SELECT ctx, token, (n + 1) / sum(n + 1) OVER (PARTITION BY ctx) AS prob FROM n),
    c AS (SELECT ctx, token, list(prob * 10000000 + 1) OVER (PARTITION BY ctx ORDER BY token) AS parts FROM p)
    SELECT ctx, token, CAST(floor(list_reduce(parts, lambda a, x: a + x)) AS BIGINT) AS cum FROM c"""
)
def quantised_cumul(spark, sf_dir):
    return entropy.cumulative(entropy.smoothed(entropy.successor_counts(_pairs(spark, sf_dir)))).select("ctx", "token", "cum")


@query("SELECT CAST(k AS INTEGER) AS k, CAST(floor(k * (10000000 / 13.0::DOUBLE + 1)) AS BIGINT) AS cum FROM range(1, 14) AS t(k)")
def uniform_cumul(spark, sf_dir):
    size = len(vocabulary.SYMBOLS)
    return spark.range(1).select(F.posexplode(entropy.uniform_cumulative(size)).alias("k", "cum")).select((F.col("k") + 1).alias("k"), "cum")


@query(
    f"""WITH {_PAIRS}, p AS (SELECT ctx, token, (n + 1) / sum(n + 1) OVER (PARTITION BY ctx) AS prob FROM n)
    SELECT doc_id, round(sum(-log2(prob)), 3) AS ideal_bits FROM pr JOIN p USING (ctx, token) GROUP BY ALL"""
)
def ac_text_ideal_bits(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    probs = entropy.smoothed(entropy.successor_counts(rows)).select("ctx", "token", "prob")
    bits_of = rows.join(entropy.small(probs), ["ctx", "token"]).groupBy("doc_id").agg(F.sum(-F.log2("prob")).alias("ideal_bits"))
    return bits_of.select("doc_id", F.round("ideal_bits", 3).alias("ideal_bits"))


@query(f"WITH {_NUMERIC} SELECT series_id, text FROM q")
def ac_text_roundtrip(spark, sf_dir):
    coded = text_codec.encode_text(_numeric_text(spark, sf_dir), head=HEAD, alphabet=vocabulary.SYMBOLS)
    return text_codec.decode_text(coded, head=HEAD)


@query(f"WITH {_NUMERIC} SELECT series_id, text FROM q")
def rank_decode_roundtrip(spark, sf_dir):
    coded = text_codec.encode_text(_numeric_text(spark, sf_dir), head=HEAD, alphabet=vocabulary.SYMBOLS)
    return text_codec.decode_ranks(coded, head=HEAD)


@query(f"WITH {_NUMERIC} SELECT series_id, text FROM q")
def ac_text_steps_roundtrip(spark, sf_dir):
    coded = text_codec.encode_text(_numeric_text(spark, sf_dir), head=HEAD, alphabet=vocabulary.SYMBOLS, step=S)
    return text_codec.decode_text(coded, head=HEAD, step=S)


def _turns(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    return rows.select(F.concat_ws(":", "conv_id", "turn").alias("series_id"), "text")


@query("SELECT concat_ws(':', conv_id, turn) AS series_id, text FROM conversations WHERE text IS NOT NULL")
def ac_any_text_roundtrip(spark, sf_dir):
    return text_codec.decode_text(text_codec.encode_text(_turns(spark, sf_dir), head=64), head=64)


def _text_streams(spark, sf_dir) -> DataFrame:
    return text_codec.cut_text(_numeric_text(spark, sf_dir), L, S, BATCH, fill=vocabulary.SYMBOLS[-1])


@query(
    f"""WITH {_NUMERIC}, l AS (SELECT series_id, text, length(text) AS n, CAST(greatest(0, ceil((length(text) - 16) / 4.0)) AS BIGINT) AS windows FROM q),
    c AS (SELECT *, windows // 8 AS per, CASE WHEN windows < 8 THEN 0 WHEN windows % 8 > 0 THEN 8 ELSE 7 END AS streams,
                 CASE WHEN windows > 0 THEN rpad(text, CAST(windows * 4 + 16 AS INTEGER), '.') ELSE text END AS filled FROM l),
    r AS (SELECT *, unnest(range(streams + 1)) AS k FROM c)
    SELECT series_id, CAST(k AS BIGINT) AS stream_id, CASE WHEN k < streams THEN substr(filled, k * per * 4 + 1, per * 4) ELSE substr(filled, k * per * 4 + 1) END AS text FROM r"""
)
def text_streams(spark, sf_dir):
    return _text_streams(spark, sf_dir).select("series_id.series_id", "series_id.stream_id", "text")


@query(f"WITH {_NUMERIC} SELECT series_id, text FROM q")
def ac_text_streams_roundtrip(spark, sf_dir):
    # streams lie in a container; how long each is follows from the length of the text alone
    texts, parts = _numeric_text(spark, sf_dir), _text_streams(spark, sf_dir)
    coded = text_codec.encode_text(parts, head=L, alphabet=vocabulary.SYMBOLS, step=S)
    packed = container.pack(coded.select("series_id.series_id", F.col("series_id.stream_id").cast("int").alias("stream_id"), "payload"))
    sizes = texts.select("series_id", F.length("text").alias("n"))
    laid = sizes.select("series_id", *[c.alias(k) for k, c in text_codec.text_layout(F.col("n"), L, S, BATCH).items()])
    whole = F.when(F.col("windows") > 0, F.col("windows") * S + L)
    back = container.unpack(packed).join(laid, "series_id").join(sizes, "series_id")
    final = F.coalesce(whole, F.col("n")) - F.col("streams") * F.col("per_stream") * S
    size = F.when(F.col("stream_id") < F.col("streams"), F.col("per_stream") * S).otherwise(final).cast("bigint")
    rows = back.select(F.struct("series_id", "stream_id").alias("series_id"), size.alias("n"), F.lit("".join(sorted(vocabulary.SYMBOLS))).alias("symbols"), "payload")
    return text_codec.join_text(text_codec.decode_text(rows, head=L, step=S), sizes)


def _byte_tokens():
    import public_tokenizers

    return partial(tokens.library, public_tokenizers.path("byte_bpe_50k.json"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def subword_roundtrip(spark, sf_dir):
    factory = _byte_tokens()
    return tokens.detokenise(tokens.tokenise(table(spark, sf_dir, "documents"), factory, "doc_id"), factory, "doc_id")


@query("SELECT concat_ws(':', conv_id, turn) AS series_id, text FROM conversations WHERE text IS NOT NULL")
def ac_tokens_roundtrip(spark, sf_dir):
    factory = _byte_tokens()
    rows = tokens.tokenise(_turns(spark, sf_dir), factory)
    # one number per token of the vocabulary
    counts = rows.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pydict()
    size, model = factory().size, text_codec.SharedFrequencies(dict(zip(counts["id"], counts["n"], strict=True)))
    coded = text_codec.encode_tokens(rows, size, model, head=16)
    return tokens.detokenise(text_codec.decode_tokens(coded, size, model, head=16), factory)


@query()
def ac_text_metrics(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    return metrics.text_ratios(text_codec.encode_text(rows, head=64), rows, "series_id")


# digits, varints, sizes

_DIGITS = digits.SerializerSettings(prec=2, bit_sep="", time_sep=",", max_val=1e7)


@query(
    f"""WITH {_USER} SELECT series_id, string_agg((CASE WHEN v < 0 THEN ' -' ELSE '' END) || CAST(abs(v) AS VARCHAR) || ',', '' ORDER BY pos) AS text
    FROM s GROUP BY series_id"""
)
def digits_serialize(spark, sf_dir):
    rows = codec.gathered(events_by_user(spark, sf_dir), "value")
    return rows.select("series_id", digits.serialize_array(F.col("value"), _DIGITS).alias("text"))


@query(f"WITH {_USER} SELECT series_id, pos, v FROM s")
def digits_deserialize(spark, sf_dir):
    rows = codec.gathered(events_by_user(spark, sf_dir), "value")
    back = digits.deserialize_array(digits.serialize_array(F.col("value"), _DIGITS), _DIGITS)
    # half a unit is added to each size on reading
    values = rows.select("series_id", F.posexplode(back).alias("pos", "x"))
    whole = F.signum("x") * F.floor(F.abs(F.col("x")) * 100)
    return values.select("series_id", F.col("pos").cast("bigint").alias("pos"), whole.cast("bigint").alias("v"))


@query(f"WITH {_USER}, m AS (SELECT series_id, max(pos) AS last FROM s GROUP BY series_id) SELECT series_id, pos, v FROM s JOIN m USING (series_id) WHERE pos < least(last, 60)")
def digits_deserialize_steps(spark, sf_dir):
    rows = codec.gathered(events_by_user(spark, sf_dir), "value")
    back = digits.deserialize_array(digits.serialize_array(F.col("value"), _DIGITS), _DIGITS, ignore_last=True, steps=60)
    values = rows.select("series_id", F.posexplode(back).alias("pos", "x"))
    whole = F.signum("x") * F.floor(F.abs(F.col("x")) * 100)
    return values.select("series_id", F.col("pos").cast("bigint").alias("pos"), whole.cast("bigint").alias("v"))


@query(f"WITH {_USER}, k AS (SELECT unnest(range(9)) AS k) SELECT series_id, pos, CAST(k AS INTEGER) AS k, CAST((abs(v) // CAST(pow(10, 8 - k) AS BIGINT)) % 10 AS INTEGER) AS digit FROM s, k")
def digit_matrix(spark, sf_dir):
    _, found = digits.number_to_digits(F.col("value"), _DIGITS)
    return events_by_user(spark, sf_dir).select("series_id", "pos", F.posexplode(found).alias("k", "digit"))


@query(f"WITH {_USER} SELECT series_id, pos, v FROM s")
def digit_matrix_roundtrip(spark, sf_dir):
    sign, found = digits.number_to_digits(F.col("value"), _DIGITS)
    back = digits.digits_to_number(sign, found, _DIGITS)
    whole = F.signum(back) * F.floor(F.abs(back) * 100)
    return events_by_user(spark, sf_dir).select("series_id", "pos", whole.cast("bigint").alias("v"))


@query(
    f"""WITH {_USER}, k AS (SELECT unnest(range(60)) AS k), m AS (SELECT series_id, max(pos) AS last FROM s GROUP BY series_id)
    SELECT m.series_id, CAST(k AS INTEGER) AS k, (SELECT s.value FROM s WHERE s.series_id = m.series_id AND s.pos = least(k.k, m.last)) AS v FROM m, k"""
)
def handle_prediction(spark, sf_dir):
    rows = codec.gathered(events_by_user(spark, sf_dir), "value")
    return rows.select("series_id", F.posexplode(digits.handle_prediction(F.col("value"), 60)).alias("k", "v"))


@query(f"WITH {_USER} SELECT series_id, pos, CAST(CASE WHEN abs(v) < 128 THEN 1 WHEN abs(v) < 16512 THEN 2 WHEN abs(v) < 2113664 THEN 3 WHEN abs(v) < 270549120 THEN 4 ELSE 5 END AS INTEGER) AS n FROM s")
def varint_len(spark, sf_dir):
    return events_by_user(spark, sf_dir).select("series_id", "pos", varint.length(F.abs("v")).alias("n"))


@query(f"WITH {_USER} SELECT series_id, pos, abs(v) AS v FROM s")
def varint_roundtrip(spark, sf_dir):
    def decode_all(data: bytes):
        at, out = 0, []
        while at < len(data):
            n, at = varint.decode(data, at)
            out.append(n)
        return (out,)

    rows = codec.gathered(events_by_user(spark, sf_dir).withColumn("v", F.abs("v")), "v")
    coded = codec.by_row(rows, ["series_id"], ["v"], lambda v: (b"".join(map(varint.encode, v)),), "payload binary")
    return codec.exploded(codec.by_row(coded, ["series_id"], ["payload"], decode_all, "value array<bigint>"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, CAST(octet_length(encode(text)) AS BIGINT) * 8 AS n_bits FROM documents WHERE text IS NOT NULL")
def text_bytes(spark, sf_dir):
    n = F.octet_length("text").cast("bigint")
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", n.alias("n_bytes"), (n * 8).alias("n_bits"))


@query(
    """WITH h AS (SELECT conv_id, turn, rtrim(hex(encode(text)), '0') AS h FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, CAST(CASE WHEN h = '' THEN 0 ELSE length(h) * 4 -
        CASE WHEN right(h, 1) IN ('2', '6', 'A', 'E') THEN 1 WHEN right(h, 1) IN ('4', 'C') THEN 2 WHEN right(h, 1) = '8' THEN 3 ELSE 0 END END AS BIGINT) AS file_bits FROM h"""
)
def file_bits(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    return rows.select("conv_id", "turn", bits.effective_bits_column(F.col("text").cast("binary")).alias("file_bits"))


# readers and writers over columns

def _files(spark, sf_dir) -> DataFrame:
    """A text per series with a line ``pos,value`` per point."""
    rows = events_by_user(spark, sf_dir)
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: F.concat_ws(",", x["pos"], F.format_string("%.2f", x["value"])))
    return rows.groupBy("series_id").agg(F.concat(F.array_join(line, "\n"), F.lit("\n")).alias("text"))


@query(f"WITH {_USER} SELECT series_id, pos, value FROM s")
def csv_last_field(spark, sf_dir):
    rows = readers.lines(_files(spark, sf_dir), "text", "series_id")
    return rows.select("series_id", "pos", readers.value_of(readers.last_field(F.col("line")), readers.FLOAT).alias("value"))


@query(f"WITH {_USER} SELECT series_id, pos, CAST(trunc(value) AS BIGINT) AS value FROM s")
def csv_last_field_int(spark, sf_dir):
    rows = readers.lines(_files(spark, sf_dir), "text", "series_id")
    return rows.select("series_id", "pos", readers.value_of(readers.last_field(F.col("line")), readers.INT).alias("value"))


@query(f"WITH {_USER} SELECT series_id, pos, pos AS value FROM s")
def txt_first_field(spark, sf_dir):
    spaced = _files(spark, sf_dir).withColumn("text", F.translate("text", ",", " "))
    return readers.lines(spaced, "text", "series_id").select("series_id", "pos", readers.first_field(F.col("line")).cast("bigint").alias("value"))


@query(f"WITH {_USER} SELECT series_id, pos, value FROM s")
def json_list(spark, sf_dir):
    return readers.exploded_json(writers.json_row(events_by_user(spark, sf_dir), ["series_id"]), "json", "series_id")


@query(f"WITH {_USER} SELECT series_id, string_agg(CAST(CAST(round_even(v / 100.0, 0) AS BIGINT) AS VARCHAR), ' ' ORDER BY pos) AS line FROM s GROUP BY series_id")
def txt_row(spark, sf_dir):
    whole = events_by_user(spark, sf_dir).withColumn("value", F.rint(F.col("v") / 100))
    return writers.series_row(whole, ["series_id"])


@query(f"WITH {_USER} SELECT series_id, pos, printf('%d', v) AS line, printf('%.2f', value) AS decimal_line FROM s")
def csv_lines(spark, sf_dir):
    return events_by_user(spark, sf_dir).select("series_id", "pos", writers.formatted(F.col("v"), None).alias("line"), writers.formatted(F.col("value"), 2).alias("decimal_line"))


def _written(spark, sf_dir, decimals: int | None) -> str:
    """Real files: a folder for each event type, one value per line."""
    path = new_path(spark, "series-files")
    rows = _long(spark, sf_dir).withColumn("value", F.col("v") if decimals is None else F.col("v") / 10.0**decimals)
    writers.series_lines(rows, path, ["series_id"], decimals)
    return path


def _of_folder(df: DataFrame) -> DataFrame:
    return df.select(F.regexp_extract("path", "series_id=([^/]*)", 1).alias("series_id"), "pos", "value")


@query(f"WITH {_H3} SELECT method, v - CASE method WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS residual, count(*) AS n FROM h GROUP BY ALL")
def method_residual_files(spark, sf_dir):
    path = new_path(spark, "method-residuals")
    writers.method_residuals_csv(_methods(spark, sf_dir), path)
    read = spark.read.csv(path, header=True, schema="method int, residual bigint")
    return read.groupBy("method", "residual").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TYPE} SELECT series_id AS dataset, 'mean' AS model, 16 AS win, 4 AS pred, 8 AS batch, pos, v AS value FROM s")
def partitioned_files(spark, sf_dir):
    path = new_path(spark, "layout")
    rows = _long(spark, sf_dir).select(F.col("series_id").alias("dataset"), F.lit("mean").alias("model"), F.lit(L).alias("win"), F.lit(S).alias("pred"), F.lit(BATCH).alias("batch"), "pos", F.col("v").alias("value"))
    writers.partitioned(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query(f"WITH {_TYPE} SELECT series_id, pos, value FROM s")
def csv_files(spark, sf_dir):
    return _of_folder(readers.csv_series(spark, f"{_written(spark, sf_dir, 2)}/series_id=*", readers.FLOAT))


@query(f"WITH {_TYPE} SELECT series_id, pos, v AS value FROM s")
def int_files(spark, sf_dir):
    return _of_folder(readers.int_lines(spark, f"{_written(spark, sf_dir, None)}/series_id=*"))


@query(f"WITH {_TYPE} SELECT series_id, count(*) AS n_lines, sum(length(CAST(v AS VARCHAR)) + 1)::BIGINT AS n_chars FROM s GROUP BY series_id")
def whole_files(spark, sf_dir):
    texts = readers.whole_texts(spark, f"{_written(spark, sf_dir, None)}/series_id=*")
    sizes = texts.select(F.regexp_extract("path", "series_id=([^/]*)", 1).alias("series_id"), F.length("text").cast("bigint").alias("n_chars"), (F.size(F.split("text", "\n")) - 1).cast("bigint").alias("n_lines"))
    return sizes.groupBy("series_id").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_chars").alias("n_chars"))


@query(f"WITH {_USER} SELECT CAST(count(*) * 64 AS DOUBLE) AS file_bits, true AS smaller, true AS timed, CAST(0 AS BIGINT) AS different FROM s")
def run_metrics(spark, sf_dir):
    path = new_path(spark, "run")
    coded, encoding = metrics.timed(_hybrid(spark, sf_dir), f"{path}/coded")
    decoded, decoding = metrics.timed(codec.decode_hybrid(coded), f"{path}/decoded")
    writers.json_lines(metrics.run_metrics(coded, encoding, decoding), f"{path}/metrics")
    different = F.lit(metrics.verify(events_by_user(spark, sf_dir), decoded).first()["different"]).alias("different")
    read = readers.metrics(spark, f"{path}/metrics")
    return read.select(F.col("File_bits").alias("file_bits"), (F.col("Compression_ratio") < 1).alias("smaller"), ((F.col("Encoding_time") > 0) & (F.col("Decoding_time") > 0)).alias("timed"), different)


@query("SELECT page_id, CAST(len(string_split(regexp_replace(html, '\\n$', ''), chr(10))) AS BIGINT) AS n_lines FROM pages WHERE length(html) > 0")
def line_log_tokens(spark, sf_dir):
    return readers.lines(table(spark, sf_dir, "pages"), "html", "page_id").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {_USER} SELECT series_id, count(*) AS len_series, CAST(8 AS BIGINT) AS bs, CAST(16 AS BIGINT) AS timesteps, CAST(4 AS BIGINT) AS slide FROM s GROUP BY series_id")
def params_json(spark, sf_dir):
    sizes = windows.layout(events_by_user(spark, sf_dir), L, S)
    made = sizes.select("series_id", F.to_json(F.struct(F.col("n").alias("len_series"), F.lit(BATCH).alias("bs"), F.lit(L).alias("timesteps"), F.lit(S).alias("slide"))).alias("json"))
    return made.select("series_id", F.from_json("json", readers.PARAMS).alias("p")).select("series_id", "p.len_series", "p.bs", "p.timesteps", "p.slide")


@query(
    f"""WITH {_USER}, e AS (SELECT series_id, pos, v - lag(v) OVER (PARTITION BY series_id ORDER BY pos) AS e FROM s),
    g AS (SELECT series_id, coalesce(stddev_pop(e) FILTER (WHERE pos >= 16), 1.0) AS sigma, CAST(greatest(0, count(*) - 16) AS BIGINT) AS num_values FROM e GROUP BY series_id)
    SELECT series_id, round(sigma, 6) AS sigma, round(3 * sigma, 6) AS threshold, num_values FROM g"""
)
def params_json_hybrid(spark, sf_dir):
    rows = events_by_user(spark, sf_dir)
    both = cascade.series_sigma(rows, HEAD).join(windows.layout(rows, L, S), "series_id")
    fields = F.struct(F.col("n").alias("len_series"), "sigma", "threshold", F.greatest(F.lit(0), F.col("n") - HEAD).alias("num_values"))
    read = both.select("series_id", F.from_json(F.to_json(fields), readers.PARAMS).alias("p"))
    return read.select("series_id", F.round("p.sigma", 6).alias("sigma"), F.round("p.threshold", 6).alias("threshold"), "p.num_values")


@query(
    """SELECT user_id AS series_id, event_id AS pos, CAST(round_even(value * 100, 0) AS BIGINT) AS v,
    CAST(round_even(value * 100, 0) AS BIGINT) - lag(CAST(round_even(value * 100, 0) AS BIGINT)) OVER w AS naive,
    CAST(round_even(value * 100, 0) AS BIGINT) - (2 * lag(CAST(round_even(value * 100, 0) AS BIGINT)) OVER w - lag(CAST(round_even(value * 100, 0) AS BIGINT), 2) OVER w) AS linear
    FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""
)
def stream_residual(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    points = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where(F.col("value").isNotNull())
    points = points.select(F.col("user_id").alias("series_id"), F.col("event_id").alias("pos"), rounding.scaled(F.col("value"), 2).alias("v"))
    return residuals.run_to_end(spark, points)
