"""Operators against NumPy one-liners and worked numbers."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import cascade, codec, entropy, metrics, predictors, scaling, text_codec, tokens, windows
from tidemark.sources import container, readers, writers

SF = "/root/testdata/sf0.001"


def series(spark, *values):
    rows = [(k, p, v) for k, s in enumerate(values) for p, v in enumerate(s)]
    return spark.createDataFrame(rows, "series_id int, pos bigint, v bigint")


def points(df):
    out = {}
    for r in df.orderBy("series_id", "pos").collect():
        out.setdefault(r["series_id"], []).append(r["v"])
    return out


def test_stride_demo(spark):
    s = series(spark, range(30), range(8), range(3))
    sizes = {r["series_id"]: (r["n"], r["windows"], r["rem"]) for r in windows.layout(s, 8, 3).collect()}
    assert sizes == {0: (30, 8, 2), 1: (8, 0, 0), 2: (3, 0, 0)}
    made = windows.strided(windows.padded(s, 8, 3), 8, 3).orderBy("win").collect()
    whole = np.concatenate((np.arange(30), [0, 0]))
    want = np.lib.stride_tricks.sliding_window_view(whole, 11)[::3]
    assert [r["ctx"] + r["tgt"] for r in made] == want.tolist()
    with pytest.raises(ValueError):
        windows.check_window(8, 3)


@pytest.mark.parametrize(("n", "want"), [(100, [12] * 8 + [4]), (96, [12] * 8), (5, [5])])
def test_stream_layouts(spark, n, want):
    sizes = spark.createDataFrame([(1, n)], "series_id int, windows bigint")
    rows = windows.stream_layout(sizes, 4, 1, 8).orderBy("stream_id").collect()
    assert [r["windows"] for r in rows] == want and [r["is_final"] for r in rows] == [False] * (len(want) - 1) + [True]
    assert [r["first_window"] for r in rows] == np.cumsum([0, *want[:-1]]).tolist()
    assert [r["coded_windows"] for r in rows] == [max(0, w - 4) for w in want[:-1]] + [want[-1]]


def cascade_by_hand(v, head, tiers, length=4):
    v = np.array(v)
    naive = [v[i] - v[i - 1] for i in range(head, len(v))]
    threshold = 3 * (np.std(naive) if naive else 1.0)
    out = []
    for i in range(head, len(v)):
        forecasts = [v[i - 1], 2 * v[i - 1] - v[i - 2], int(np.rint(v[i - length : i].mean()))][:tiers]
        errors = [abs(v[i] - p) for p in forecasts]
        method = next((k for k, e in enumerate(errors) if e <= threshold), int(np.argmin(errors)))
        out.append((method, int(v[i] - forecasts[method])))
    return out


@pytest.mark.parametrize("tiers", [2, 3])
def test_cascade(spark, tiers):
    rng = np.random.default_rng(tiers)
    all_values = [np.cumsum(rng.integers(-5, 6, 80) + 200 * (rng.random(80) < 0.05)).tolist(), list(range(0, 900, 30)), [5] * 20, [1, 2, 3]]
    made = cascade.hybrid_rows(series(spark, *all_values), 4, tiers, 4).orderBy("series_id", "pos").collect()
    for k, v in enumerate(all_values):
        assert [(r["method"], r["residual"]) for r in made if r["series_id"] == k] == cascade_by_hand(v, 4, tiers)
    sigma = {r["series_id"]: r["sigma"] for r in cascade.series_sigma(series(spark, *all_values), 4).collect()}
    assert np.isclose(sigma[0], np.std(np.diff(all_values[0])[3:])) and sigma[3] == 1.0 and sigma[2] == 0.0


def test_hybrid_codec_round_trip(spark):
    rng = np.random.default_rng(1)
    all_values = [np.cumsum(rng.integers(-9, 10, 60)).tolist(), [3] * 30, [4, 5], [-(1 << 40), 1 << 40] * 12]
    s = series(spark, *all_values)
    coded = codec.encode_hybrid(cascade.hybrid_rows(s, 16, 3), s.where("pos < 16"))
    back = codec.decode_hybrid(coded)
    assert points(back) == dict(enumerate(all_values))
    assert metrics.same_rows(s.select("series_id", "pos", "v"), back.select("series_id", "pos", "v"))
    r = metrics.verify(s, back).first()
    assert (r["n"], r["different"], r["max_abs"]) == (116, 0, 0)
    wrong = back.withColumn("v", F.col("v") + F.when((F.col("series_id") == 1) & (F.col("pos") == 3), 2).otherwise(0))
    r = metrics.verify(s, wrong).first()
    assert (r["different"], r["max_abs"]) == (1, 2) and not metrics.same_rows(s, wrong)
    sizes = {r["series_id"]: r for r in metrics.hybrid_ratios(coded).collect()}
    assert sizes[1]["payload_ratio"] < sizes[0]["payload_ratio"] < sizes[0]["total_ratio"] and sizes[2]["payload_bits"] == 0


def test_prefix_decode(spark):
    s = series(spark, [5, 3, 8, -2], [7])
    residual = s.select("series_id", "pos", (F.col("v") - F.coalesce(predictors.naive(), F.lit(0))).alias("residual"))
    assert points(cascade.prefix_decode(residual)) == {0: [5, 3, 8, -2], 1: [7]}


def test_plug_in_predictors(spark):
    s = windows.padded(series(spark, [3, 1, 4, 1, 5, 9, 2, 6]), 4, 2)
    made = windows.strided(s, 4, 2)
    last = predictors.predict_windows(made, lambda: predictors.LastValue(2)).orderBy("win").collect()
    assert [r["pred"] for r in last] == [[1.0, 1.0], [9.0, 9.0]]
    mean = predictors.window_residuals(predictors.predict_windows(made, lambda: predictors.WindowMean(2)), 4, 2)
    assert [r["residual"] for r in mean.orderBy("pos").collect()] == [3, 7, -3, 1]


def test_method_tables(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, 1)], "series_id int, method int")
    got = sorted(map(tuple, entropy.method_table(rows).collect()))
    assert got == [(1, 0, 3, 0, 3), (1, 1, 1, 3, 4), (1, 2, 2, 4, 6), (2, 0, 1, 0, 1), (2, 1, 2, 1, 3), (2, 2, 1, 3, 4)]
    bits = {r[0]: r[1] for r in entropy.method_bits(rows).collect()}
    assert np.isclose(bits[1], 2 * np.log2(2) + np.log2(3)) and np.isclose(bits[2], 1.0)


def test_softmax_and_renormalise(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (1, "c", -800.0)], "k int, token string, x double")
    over = Window.partitionBy("k")
    x = np.array([1.0, 3.0, -800.0])
    want = np.exp(x - 3) / np.exp(x - 3).sum()
    assert np.allclose([r[0] for r in rows.select(entropy.softmax(F.col("x"), over)).collect()], want)
    as_array = rows.groupBy("k").agg(entropy.softmax_array(F.collect_list("x")).alias("p")).first()["p"]
    assert np.allclose(as_array, want)
    probs = rows.withColumn("p", entropy.softmax(F.col("x"), over))
    assert np.allclose([r[0] for r in probs.select(entropy.renormalise(F.col("p"), F.col("token") != "b", over)).collect()], [1, 0, 0])
    assert spark.range(1).select(entropy.uniform_cumulative(3)).first()[0] == [3333334, 6666668, 10000003]


def test_successors_and_ranks(spark):
    texts = spark.createDataFrame([(1, "abab"), (2, "ac"), (3, ""), (4, None)], "id int, text string")
    rows = entropy.successors(texts, "text", "id")
    assert sorted((r["id"], r["pos"], r["ctx"], r["token"]) for r in rows.collect()) == [
        (1, 0, "", "a"), (1, 1, "a", "b"), (1, 2, "b", "a"), (1, 3, "a", "b"), (2, 0, "", "a"), (2, 1, "a", "c"),
    ]
    ranks = {(r["ctx"], r["token"]): r["rank"] for r in entropy.ranked(entropy.successor_counts(rows)).collect()}
    assert ranks == {("", "a"): 0, ("a", "b"): 0, ("a", "c"): 1, ("b", "a"): 0}


@pytest.mark.parametrize(("head", "step"), [(4, 1), (64, 1), (8, 4)])
def test_text_codecs(spark, head, step):
    texts = ["", "x", "the cat and the dog and the cat " * 6, "Fehler: ü 日本 🎉 " * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "series_id int, text string")
    coded = text_codec.encode_text(rows, head, step=step)
    for back in (text_codec.decode_text(coded, head, step), text_codec.decode_ranks(coded, head, step)):
        assert [r["text"] for r in back.orderBy("series_id").collect()] == texts
    r = coded.where("series_id = 2").first()
    assert len(r["ranks"]) == len(r["probs"]) == len(texts[2]) - head and all(0 < p <= 1 for p in r["probs"])
    ratios = {r["series_id"]: r["ac_ratio"] for r in metrics.text_ratios(coded.where("n > 1"), rows, "series_id").collect()}
    assert 0 < ratios[2] < 1


def test_scalers(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(10, 4, 50)
    rows = spark.createDataFrame([(1, float(x)) for x in values] + [(1, float("nan")), (2, 3.0), (2, 3.0)], "series_id int, value double")
    affine = {r["series_id"]: r for r in scaling.quantile_scaler(rows).collect()}
    shift = values.min() - 0.3 * (values.max() - values.min())
    assert np.isclose(affine[1]["shift"], shift) and np.isclose(affine[1]["q"], np.quantile(values - shift, 0.95))
    assert affine[2]["q"] == 1.0
    basic = {r["series_id"]: r for r in scaling.quantile_scaler(rows, basic=True).collect()}
    assert np.isclose(basic[1]["q"], np.quantile(np.abs(values), 0.95)) and basic[2]["q"] == 3.0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t,1\nt,u,2.7\n-3\n")
    got = readers.csv_series(spark, str(tmp_path / "a.csv")).orderBy("pos").collect()
    assert [(r["pos"], r["value"]) for r in got] == [(0, 1), (1, 2), (2, -3)]
    got = readers.csv_series(spark, str(tmp_path / "a.csv"), readers.FLOAT).orderBy("pos").collect()
    assert [r["value"] for r in got] == [1.0, 2.7, -3.0]
    (tmp_path / "bad.csv").write_text("value\n1\n")
    with pytest.raises(Exception, match="not a number"):
        readers.csv_series(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "b.txt").write_text("7 x\n  8\ty\n")
    assert [r["value"] for r in readers.txt_series(spark, str(tmp_path / "b.txt")).orderBy("pos").collect()] == [7, 8]
    (tmp_path / "c.json").write_text("[1, 2.5,\n 3]")
    assert [r["value"] for r in readers.json_series(spark, str(tmp_path / "c.json")).orderBy("pos").collect()] == [1.0, 2.5, 3.0]
    (tmp_path / "ranks").write_text("0\n12\n3\n")
    assert [r["value"] for r in readers.int_lines(spark, str(tmp_path / "ranks")).orderBy("pos").collect()] == [0, 12, 3]
    (tmp_path / "params").write_text('{"len_series": 30, "bs": 1, "timesteps": 8, "slide": 2, "sigma": 1.5}')
    r = readers.params(spark, str(tmp_path / "params")).first()
    assert (r["len_series"], r["slide"], r["sigma"], r["num_values"]) == (30, 2, 1.5, None)


def test_writers(spark, tmp_path):
    s = series(spark, [5, -3, 8], [7]).withColumnRenamed("v", "value")
    writers.series_lines(s, str(tmp_path / "lines"), ["series_id"])
    back = readers.int_lines(spark, str(tmp_path / "lines" / "series_id=0")).orderBy("pos")
    assert [r["value"] for r in back.collect()] == [5, -3, 8]
    assert [r["line"] for r in writers.series_row(s, ["series_id"]).orderBy("series_id").collect()] == ["5 -3 8", "7"]
    assert [r["json"] for r in writers.json_row(s, ["series_id"]).orderBy("series_id").collect()] == ["[5,-3,8]", "[7]"]
    rows = spark.createDataFrame([(0, 4), (2, -1)], "method int, residual bigint")
    writers.method_residuals_csv(rows.coalesce(1), str(tmp_path / "data"))
    assert next((tmp_path / "data").glob("*.csv")).read_text() == "method,residual\n0,4\n2,-1\n"
    laid = s.selectExpr("'d' as dataset", "'m' as model", "16 as win", "1 as pred", "8 as batch", "value")
    writers.partitioned(laid, str(tmp_path / "out"))
    assert (tmp_path / "out/dataset=d/model=m/win=16/pred=1/batch=8").is_dir() and spark.read.parquet(str(tmp_path / "out")).count() == 4
    writers.json_lines(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_container_rows(spark):
    rows = spark.createDataFrame([(1, 1, bytearray(b"xyz")), (1, 0, bytearray(b"")), (2, 0, bytearray(b"q" * 200))], "series_id int, stream_id int, payload binary")
    back = container.unpack(container.pack(rows)).collect()
    assert sorted((r["series_id"], r["stream_id"], bytes(r["payload"])) for r in back) == [(1, 0, b""), (1, 1, b"xyz"), (2, 0, b"q" * 200)]


# sizes by a coder written for the tests


def coded_bits(intervals):
    """Bits of an arithmetic coder of 32-bit state over (low, high, total) of each symbol, the closing bit included."""
    low, high, sent, waiting = 0, (1 << 32) - 1, 0, 0
    for a, b, total in intervals:
        width = high - low + 1
        low, high = low + a * width // total, low + b * width // total - 1
        while True:
            if high >> 31 == low >> 31:
                sent, waiting = sent + 1 + waiting, 0
                low, high = low & 0x7FFFFFFF, high & 0x7FFFFFFF
            elif low >> 30 == 1 and high >> 30 == 2:
                waiting += 1
                low, high = low - (1 << 30), high - (1 << 30)
            else:
                break
            low, high = low << 1, high << 1 | 1
    return sent + 1


def method_intervals(methods, size=3):
    freq = [methods.count(k) + 1 for k in range(size)]
    return [(sum(freq[:m]), sum(freq[: m + 1]), sum(freq)) for m in methods]


def xor_bits(values):
    size = 64
    for a, b in zip(values, values[1:], strict=False):
        x = (a ^ b) & (1 << 64) - 1
        size += 13 + len(f"{x:b}".rstrip("0")) if x else 1
    return size if values else 0


def test_sizes_of_coded_series(spark):
    from tidemark.plans.catalogue import QUERIES

    rows = {}
    for r in QUERIES["hybrid_rows_3tier"](spark, SF).orderBy("series_id", "pos").collect():
        rows.setdefault(r["series_id"], []).append((r["method"], r["residual"]))
    want = {k: coded_bits(method_intervals([m for m, _ in x])) for k, x in rows.items()}
    got = {r["series_id"]: (r["n"], r["n_bytes"], r["n_bits"]) for r in QUERIES["ac_method_sizes"](spark, SF).collect()}
    assert got == {k: (len(rows[k]), -(-n // 8), n) for k, n in want.items()}
    for r in QUERIES["compression_metrics"](spark, SF).collect():
        x = rows[r["series_id"]]
        payload = 8 * (-(-want[r["series_id"]] // 8) + -(-xor_bits([v for _, v in x]) // 8))
        file_bits = 64 * (16 + len(x))
        assert (r["file_bits"], r["payload_bits"], r["total_bits"]) == (file_bits, payload, payload + 64 * (16 + 3 + 1))
        assert np.isclose(r["payload_ratio"], payload / file_bits) and np.isclose(r["total_ratio"], r["total_bits"] / file_bits)


def quantised_by_hand(probabilities):
    total, out = 0.0, [0]
    for p in probabilities:
        total += p * 10_000_000 + 1
        out.append(int(total))
    return out


def test_sizes_of_coded_texts(spark):
    from tidemark.plans.catalogue import QUERIES

    texts = {f"{r['conv_id']}:{r['turn']}": r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").where("text IS NOT NULL").collect()}
    for r in QUERIES["ac_text_metrics"](spark, SF).collect():
        text = texts[r["series_id"]]
        letters = sorted(set(text))
        flat = quantised_by_hand([1 / len(letters)] * len(letters)) if text else [0]
        intervals = [(flat[letters.index(c)], flat[letters.index(c) + 1], flat[-1]) for c in text[:64]]
        for at in range(64, len(text)):
            seen = [b for a, b in zip(text[:64], text[1:64], strict=False) if a == text[at - 1]]
            table = quantised_by_hand([(seen.count(c) + 1) / (len(seen) + len(letters)) for c in letters])
            k = letters.index(text[at])
            intervals.append((table[k], table[k + 1], table[-1]))
        size = len("".join(f"{b:08b}" for b in text.encode()).rstrip("0"))
        assert (r["file_bits"], r["ac_bits"]) == (size, coded_bits(intervals) if text else 0)
        assert not text or np.isclose(r["ac_ratio"], r["ac_bits"] / size)


# plug-ins; workers get the classes of this file by value

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Ends:
    """The last value plus the first of its context, for windows of any step."""

    def __init__(self, step):
        self.step = step

    def predict(self, contexts):
        return np.repeat(contexts[:, :1] + contexts[:, -1:], self.step, axis=1) / 2 + np.arange(self.step)


@pytest.mark.parametrize(("length", "step", "head"), [(4, 1, 4), (4, 2, 4), (8, 4, 12)])
def test_plug_in_third_tier(spark, length, step, head):
    rng = np.random.default_rng(step)
    # after the spike the last value and the line are far off, the middle of first and last is not
    all_values = [(rng.integers(-5, 6, 61) + 1000 * (np.arange(61) == 30)).tolist(), [3] * 20, [4, 5]]
    s = series(spark, *all_values)
    forecasts = predictors.model_forecasts(s, lambda: Ends(step), length, step)
    rows = cascade.hybrid_rows(s, head, forecasts=forecasts)
    assert rows.where("method = 2").count() > 0
    for r in rows.where("series_id = 0 AND method = 2").collect():
        win, k = divmod(r["pos"] - length, step)
        context = all_values[0][win * step : win * step + length]
        assert r["v"] - r["residual"] == int(np.rint((context[0] + context[-1]) / 2 + k))
    coded = codec.encode_hybrid(rows, s.where(F.col("pos") < head))
    assert points(codec.decode_hybrid(coded, factory=lambda: Ends(step), length=length, step=step)) == dict(enumerate(all_values))


def test_float_residuals(spark):
    rows = [(1, k, v) for k, v in enumerate([1.25, 2.5, 0.1, 7.375, 2.0, 9.99])]
    s = spark.createDataFrame(rows, "series_id int, pos bigint, v double")
    made = predictors.window_residuals(predictors.predict_windows(windows.strided(s, 2, 1), lambda: predictors.LastValue(1)), 2, 1, decimals=1)
    assert [r["residual"] for r in made.orderBy("pos").collect()] == [-2.4, 7.3, -5.4, 8.0]


class Alphabet:
    """Half of all weight on the symbol after the last one, whatever came before."""

    memory = None

    def __init__(self, size, head):
        self.size = size

    def probabilities(self, context):
        row = np.full(self.size, 0.5 / self.size)
        row[(context[-1] + 1) % self.size] += 0.5
        return row


@pytest.mark.parametrize(("head", "step"), [(2, 1), (8, 4)])
def test_plug_in_text_model(spark, head, step):
    texts = ["", "q", "abcdefghijklmnopqrstuvwxyz" * 4, "the cat sat on a mat" * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "series_id int, text string")
    letters = "abcdefghijklmnopqrstuvwxyz "
    coded = text_codec.encode_text(rows, head, letters, step, factory=Alphabet)
    for back in (text_codec.decode_text(coded, head, step, factory=Alphabet), text_codec.decode_ranks(coded, head, step, factory=Alphabet)):
        assert [r["text"] for r in back.orderBy("series_id").collect()] == texts
    sizes = {r["series_id"]: len(r["payload"]) for r in coded.collect()}
    assert sizes[2] < 104 * np.log2(27) / 8 / 2  # far below a uniform code, as the model knows the order


def test_token_ids_under_a_shared_model(spark):
    rows = spark.createDataFrame([(1, [5, 70_000, 5, 5, 0, 80_000] * 9), (2, []), (3, [80_000])], "series_id int, ids array<int>")
    model = text_codec.SharedFrequencies({5: 1_000_000, 0: 4, 70_000: 9})
    coded = text_codec.encode_tokens(rows, 80_001, model, head=4)
    back = text_codec.decode_tokens(coded, 80_001, model, head=4)
    assert {r["series_id"]: r["ids"] for r in back.collect()} == {r["series_id"]: r["ids"] for r in rows.collect()}


class Bytes:
    size = 256

    def encode(self, text):
        return list(text.encode())

    def decode(self, ids):
        return bytes(ids).decode()


def test_plug_in_tokenizer(spark):
    texts = spark.createDataFrame([(1, "naïve 日本"), (2, ""), (3, None)], "series_id int, text string")
    ids = tokens.tokenise(texts, Bytes)
    assert {r["series_id"]: r["ids"] for r in ids.collect()} == {1: list("naïve 日本".encode()), 2: []}
    assert {r["series_id"]: r["text"] for r in tokens.detokenise(ids, Bytes).collect()} == {1: "naïve 日本", 2: ""}


@pytest.mark.parametrize("batch", [1, 3, 8])
def test_text_streams(spark, batch):
    texts = ["", "x", "ab" * 8, "a b" * 40, "ü日本🎉" * 30, "z" * 17]
    rows = spark.createDataFrame(list(enumerate(texts)), "series_id int, text string")
    parts = text_codec.cut_text(rows, 8, 4, batch, fill="~")
    for r in parts.collect():
        whole = texts[r["series_id"]["series_id"]]
        n = max(0, -(-(len(whole) - 8) // 4))
        per = n // batch if batch > 1 else n
        last = 0 if not per or batch == 1 else batch if n % batch else batch - 1
        filled = whole.ljust(4 * n + 8, "~") if n else whole
        k = r["series_id"]["stream_id"]
        assert r["text"] == (filled[4 * per * k : 4 * per * (k + 1)] if k < last else filled[4 * per * last :])
    coded = text_codec.encode_text(parts, head=8, step=4)
    sizes = rows.select("series_id", F.length("text").alias("n"))
    back = text_codec.join_text(text_codec.decode_text(coded, head=8, step=4), sizes)
    assert [r["text"] for r in back.orderBy("series_id").collect()] == texts


# files and tables of any size


def test_lines_of_split_files(spark, tmp_path):
    want = {}
    for name, n in (("a.txt", 3000), ("b.txt", 1), ("c.txt", 700)):
        values = [str(k * 7919 % 100_003) + "x" * (k % 5) for k in range(n)]
        (tmp_path / name).write_text("\n".join(values) + ("\n" if n > 1 else ""))
        want |= {(name, k): v for k, v in enumerate(values)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.split_lines(spark, str(tmp_path))
        splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        got = [((r["path"].rpartition("/")[2], r["pos"]), r["line"]) for r in rows.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 4 and len(got) == len(want) and dict(got) == want


def test_tables_are_broadcast_only_if_small(spark):
    table = spark.range(50).selectExpr("cast(id as string) as ctx", "'t' as token", "cast(id as int) as rank")
    assert "broadcast" in entropy.small(table)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in entropy.small(table, 49)._jdf.queryExecution().logical().toString().lower()


def test_run_metrics(spark, tmp_path):
    s = series(spark, [5] * 40, list(range(30)))
    coded, encoding = metrics.timed(codec.encode_hybrid(cascade.hybrid_rows(s, 16, 3), s.where("pos < 16")), str(tmp_path / "coded"))
    back, decoding = metrics.timed(codec.decode_hybrid(coded), str(tmp_path / "decoded"))
    assert points(back) == {0: [5] * 40, 1: list(range(30))}
    writers.json_lines(metrics.run_metrics(coded, encoding, decoding), str(tmp_path / "metrics"))
    r = readers.metrics(spark, str(tmp_path / "metrics")).first()
    assert r["File_bits"] == 70 * 64 and 0 < r["Compression_ratio"] < 1 and r["Encoding_time"] > 0 and r["Decoding_time"] > 0
