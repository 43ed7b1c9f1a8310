"""The pipeline stage by stage, and the registered queries against their SQL."""

import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, "/root/repo")
import corpus_pipeline  # noqa: E402
from tidemark.llm import bpe, packing, queries  # noqa: E402

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_llm_operators import passages_by_hand, simhash_by_hand  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = "doc_id long, text string, lang string, source string, n_chars long, kept int"
PASSAGE = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, "A clean text in English", "en", "a", 23, 1),
    (2, "a clean TEXT in english", "en", "a", 23, 1),
    (3, None, "en", "a", 0, 1),
    (4, "1234 !!", "en", "a", 7, 1),
    (5, f"first {PASSAGE} own\n{PASSAGE}\n", "en", "b", 1, 1),
    (6, f"other words come before this one, and then\n{PASSAGE}", "en", None, 1, 1),
    (7, "twice the same row", "en", "a", 18, 1),
    (7, "twice the same row", "en", "a", 18, 1),
    (None, "no id", "en", "a", 5, None),
]


def written(spark, df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def test_stages(spark, tmp_path):
    docs = written(spark, spark.createDataFrame(ROWS, NAMES), tmp_path, "docs")
    names = docs.columns
    step = dict(corpus_pipeline.STAGES)
    docs = written(spark, step["language"](spark, docs, ""), tmp_path, "language")
    assert docs.columns == names and sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 2, 5, 6, 7, 7]
    docs = written(spark, step["exact"](spark, docs, ""), tmp_path, "exact")
    assert docs.columns == names and sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 2, 5, 6, 7]
    docs = written(spark, step["near"](spark, docs, ""), tmp_path, "near")
    assert docs.columns == names and sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 2, 5, 6, 7]
    docs = written(spark, step["passages"](spark, docs, ""), tmp_path, "passages")
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert docs.columns == names and texts[5]["text"].count("w59") == 2 and "w59" not in texts[6]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    pieces = step["pack"](spark, docs, "")
    assert {r["doc_id"] for r in pieces.collect()} == set(texts)


def test_near_copies_with_repeated_ids(spark, tmp_path):
    near = [" ".join([*[f"word{j}" for j in range(300)], f"end{k}"]) for k in range(3)]
    twins = [" ".join([*[f"term{j}" for j in range(300)], f"end{k}"]) for k in range(2)]
    rows = [(1, near[0]), (5, near[1]), (5, "a clean text of its own"), (6, near[2]), (9, twins[0]), (9, twins[1]), (None, near[2])]
    docs = written(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path, "docs")
    kept = [tuple(r) for r in corpus_pipeline.near(spark, docs, "").collect()]
    assert {rows[0], rows[2], rows[6]} <= set(kept) and len(kept) == 4  # and one of the twins


def test_stages_on_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], NAMES)
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = written(spark, step(spark, docs, ""), tmp_path, str(k))
        assert docs.count() == 0


def kept_by_hand(rows):
    """(doc_id, text) of what the stages before packing keep, by plain Python over all rows: none of the operators is called."""
    import unicodedata

    rows = [(i, t) for i, t in rows if t and any(unicodedata.category(c)[0] == "L" for c in t)]
    best = {}
    for i, t in rows:  # of equal texts the largest id
        key = t.encode().lower()
        if key not in best or (i is not None, i or 0) > (best[key][0] is not None, best[key][0] or 0):
            best[key] = (i, t)
    rows = list(best.values())
    out = [(i, t) for (i, t), (_, _, lowest) in zip(rows, simhash_in_order(rows), strict=True) if i is None or i == lowest]
    cut = passages_by_hand(out, 30)
    return [(i, cut.get((i, t), t)) for i, t in out]


def simhash_in_order(rows):
    """What simhash_by_hand tells, in the order of the rows; ids are distinct here."""
    by_id = {r[0]: r for r in simhash_by_hand(rows)}
    return [by_id[i] for i, _ in rows]


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len({i for i, _ in rows}) == len(rows)
    kept = kept_by_hand(rows)
    assert len(kept) < len(rows)
    library = Tokenizer.from_file(bpe.vocabulary_path(packing.VOCABULARY))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in kept}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(ids)
    sequences, starts = defaultdict(list), defaultdict(list)
    for r in pieces:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        starts[r["doc_id"]].append((r["start"], r["length"]))
    for spans, whole in [(sorted(x), 2048 if k < max(sequences) else None) for k, x in sequences.items()] + [(sorted(x), len(ids[i])) for i, x in starts.items()]:
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert whole is None or sum(spans[-1]) == whole


def test_stages_on_very_long_texts(spark, tmp_path):
    long = " ".join(f"word{k} and" for k in range(60_000))
    rows = [(1, long + " first", "en", "a", 1, 1), (2, long + " second", "en", "a", 1, 1), (3, "a short clean text", "en", "a", 1, 1)]
    docs = spark.createDataFrame(rows, NAMES)
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = written(spark, step(spark, docs, ""), tmp_path, str(k))
        assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == ({1, 2, 3} if k < 2 else {1, 3})


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.ORACLE[name])
    order = [want.columns.index(c) for c in made.columns]
    assert sorted(tuple(r[k] for k in order) for r in want.fetchall()) == sorted(map(tuple, made.collect()))


def test_query_columns(spark):
    want = {
        "op2_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op3_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op5_simhash": ["doc_id", "fingerprint", "component_id"],
        "op6_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op9_topk": ["query_id", "rank", "vec_id", "score"],
        "op10_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    }
    assert set(queries.QUERIES) == {*want, "op1_substring_dedup", "op8_token_counts"}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, SF).columns[: len(columns)] == columns
