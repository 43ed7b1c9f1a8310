"""Kernels: round trips, known values, and corrupted payloads."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import arith, bits, digits, rounding, varint, vocabulary, xor
from tidemark.sources import container

LONG = st.integers(-(1 << 63), (1 << 63) - 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300), st.lists(st.integers(0, 5000), min_size=5, max_size=5))
def test_arithmetic_coding_round_trip(symbols, counts):
    table = arith.smoothed(counts)
    assert arith.decode(arith.encode(symbols, table), table, len(symbols)) == symbols


def test_arithmetic_coding_is_near_the_ideal_length():
    rng = random.Random(1)
    symbols = rng.choices([0, 1, 2], [90, 9, 1], k=5000)
    counts = [symbols.count(k) for k in range(3)]
    table = arith.smoothed(counts)
    ideal = -sum(math.log2((counts[s] + 1) / table[-1]) for s in symbols)
    # the last interval may hold a short binary fraction, so a few bits less can do
    assert ideal - 32 <= bits.effective_bits(arith.encode(symbols, table)) <= ideal + 3


def test_a_changed_bit_changes_the_symbols():
    symbols = [0, 1, 2, 1, 0, 2, 2, 1] * 20
    table = arith.smoothed([5, 5, 5])
    data = bytearray(arith.encode(symbols, table))
    data[3] ^= 16
    assert arith.decode(bytes(data), table, len(symbols)) != symbols


@pytest.mark.parametrize("table", [[0, 3, 3], [0, 1, (1 << 30) + 3]])
def test_tables_that_cannot_be_coded(table):
    with pytest.raises(ValueError):
        arith.encode([0], table)


def test_quantised_tables():
    assert arith.uniform(13)[-1] == 10_000_013 or arith.uniform(13)[-1] == 10_000_012
    assert arith.quantised([0.5, 0.0, 0.5]) == [0, 5_000_001, 5_000_002, 10_000_003]


@settings(max_examples=200, deadline=None)
@given(st.lists(LONG, max_size=60))
def test_xor_ints(values):
    payload, size = xor.encode(xor.words_of_ints(values))
    assert xor.ints_of_words(xor.decode(payload, len(values))).tolist() == values
    assert len(payload) == -(-size // 8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(width=64), max_size=60))
def test_xor_floats(values):
    words = xor.words_of_floats(values)
    assert xor.decode(xor.encode(words)[0], len(values)) == words


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(LONG, st.integers(-3, 3)), max_size=12), max_size=12), st.sampled_from([1, 5, 1 << 16]), st.sampled_from([0, 1000]))
def test_many_series_at_once(series, chunk, in_step):
    words = [xor.words_of_ints(s) for s in series]
    flat = np.array([w for s in words for w in s], np.uint64)
    offsets = np.cumsum([0, *map(len, words)])
    before = xor.CHUNK, xor.IN_STEP
    xor.CHUNK, xor.IN_STEP = chunk, in_step
    try:
        payloads, sizes = xor.encode_all(flat, offsets)
        assert list(zip(payloads, sizes, strict=True)) == [xor.encode(w) for w in words]
        assert xor.decode_all(payloads, np.diff(offsets)).tolist() == flat.tolist()
    finally:
        xor.CHUNK, xor.IN_STEP = before


@pytest.mark.parametrize("values", [[], [5], [7] * 9, [1, -1] * 9, [-(1 << 63), (1 << 63) - 1, 0]])
def test_xor_edges(values):
    payload, size = xor.encode(xor.words_of_ints(values))
    assert xor.ints_of_words(xor.decode(payload, len(values))).tolist() == values
    changes = sum(a != b for a, b in zip(values, values[1:], strict=False))
    assert size >= 64 + 14 * changes if values else not size


@pytest.mark.parametrize(("n", "code"), [(0, "00"), (127, "7f"), (128, "8000"), (16511, "ff7f"), (16512, "808000"), (2113663, "ffff7f"), (2113664, "80808000")])
def test_varint(n, code, spark):
    assert varint.encode(n).hex() == code and varint.decode(bytes.fromhex(code)) == (n, len(code) // 2)
    assert spark.range(1).select(varint.length(F.lit(n))).first()[0] == len(code) // 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=8))
def test_containers(streams):
    assert container.split_streams(container.join_streams(streams)) == streams


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=6), min_size=1, max_size=40))
def test_effective_bits(spark, values):
    def by_hand(data):
        return len("".join(f"{b:08b}" for b in data).rstrip("0"))

    assert [bits.effective_bits(v) for v in values] == [by_hand(v) for v in values]
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in enumerate(values)], "k int, v binary")
    got = rows.select("k", bits.effective_bits_column(F.col("v")).alias("n")).orderBy("k").collect()
    assert [r["n"] for r in got] == [by_hand(v) for v in values]


def test_rounding_is_half_even(spark):
    values = [0.125, 1.005, 0.285, 2.5, -2.5, 0.375]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r[0] for r in rows.orderBy("k").select(rounding.half_even(F.col("v"), 2)).collect()]
    assert got == np.around(values, 2).tolist()
    assert [r[0] for r in rows.orderBy("k").select(rounding.rounded(F.col("v"))).collect()] == [0, 1, 0, 2, -2, 0]
    assert [r[0] for r in rows.orderBy("k").select(rounding.truncated(F.col("v"))).collect()] == [0, 1, 0, 2, -2, 0]


def arrays(spark, *rows):
    return spark.createDataFrame([(list(r),) for r in rows], "v array<double>")


def test_serialized_form(spark):
    plain = digits.SerializerSettings(prec=0, time_sep=",", bit_sep="")
    assert arrays(spark, [999.0, -2.0]).select(digits.serialize_array(F.col("v"), plain)).first()[0] == "999, -2,"
    usual = digits.SerializerSettings()
    assert arrays(spark, [1.5]).select(digits.serialize_array(F.col("v"), usual)).first()[0] == " 1 5 0 0 ,"
    gap = arrays(spark, [float("nan"), 0.0]).select(digits.serialize_array(F.col("v"), plain)).first()[0]
    assert gap == " Nan,0,"
    with pytest.raises(ValueError):
        digits.SerializerSettings(prec=0, decimal_point=".")


@pytest.mark.parametrize("settings_", [{}, {"bit_sep": "", "time_sep": ","}, {"decimal_point": ".", "bit_sep": ""}, {"fixed_length": True}])
def test_serialized_arrays_come_back(spark, settings_):
    s = digits.SerializerSettings.of({"prec": 2, "half_bin_correction": False, **settings_})
    values = [1.25, -3.5, 1000.0, 0.01, 0.0]
    back = arrays(spark, values).select(digits.deserialize_array(digits.serialize_array(F.col("v"), s), s)).first()[0]
    assert np.allclose(back, values)


def test_text_that_cannot_be_read_is_null(spark):
    s = digits.SerializerSettings(prec=0, time_sep=",", bit_sep="", half_bin_correction=False)
    rows = spark.createDataFrame([("12,x1, -3,,",)], "t string")
    assert rows.select(digits.deserialize_array(F.col("t"), s)).first()[0] == [12.0, None, -3.0]


def test_predictions_of_a_given_length(spark):
    rows = arrays(spark, [1.0, 2.0, 3.0], [7.0], [])
    assert [r[0] for r in rows.select(digits.handle_prediction(F.col("v"), 2)).collect()] == [[1.0, 2.0], [7.0, 7.0], None]
    assert [r[0] for r in rows.select(digits.handle_prediction(F.col("v"), 2, strict=True)).collect()] == [[1.0, 2.0], None, None]


def test_alphabet(spark):
    dense = vocabulary.dense_index()
    assert sorted(dense.values()) == list(range(13)) and dense["1"] == 0 and dense["9"] == 12
    rows = spark.createDataFrame([("7",), ("x",)], "c string")
    assert rows.where("c = '7'").select(vocabulary.lookup(F.col("c"), vocabulary.symbol_ids())).first()[0] == 767
    with pytest.raises(Exception, match="alphabet"):
        rows.select(vocabulary.lookup(F.col("c"), dense)).collect()


@pytest.mark.parametrize(("value", "fits"), [(9999999.999, True), (-9999999.999, True), (1e7, False), (12345678.25, False), (-3e9, False), (float("inf"), False), (float("nan"), True)])
def test_numbers_beyond_the_range_fail(spark, value, fits):
    settings_ = digits.SerializerSettings()
    made = spark.createDataFrame([([value],)], "x array<double>").select(digits.serialize_array(F.col("x"), settings_))
    if fits:
        assert made.first()[0]
    else:
        with pytest.raises(Exception, match="beyond max_val"):
            made.collect()


def test_negative_numbers_need_a_sign(spark):
    settings_ = digits.SerializerSettings(signed=False)
    rows = spark.createDataFrame([([1.5, 2.0],)], "x array<double>")
    back = digits.deserialize_array(digits.serialize_array(F.col("x"), settings_), settings_)
    assert np.allclose(rows.select(back).first()[0], [1.5, 2.0], atol=1e-3)
    with pytest.raises(Exception, match="negative without a sign"):
        rows.select(digits.serialize_array(F.transform("x", lambda x: -x), settings_)).collect()


def test_reading_a_part_of_a_serialized_array(spark):
    settings_ = digits.SerializerSettings(half_bin_correction=False)
    rows = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "x array<double>")
    text = digits.serialize_array(F.col("x"), settings_)
    read = lambda **more: [r[0] for r in rows.select(digits.deserialize_array(text, settings_, **more)).collect()]
    assert read() == [[1.0, 2.0, 3.0, 4.0], []]
    assert read(ignore_last=True) == [[1.0, 2.0, 3.0], []]
    assert read(steps=2) == [[1.0, 2.0], []] and read(steps=9) == read()
    assert read(ignore_last=True, steps=3) == [[1.0, 2.0, 3.0], []]
