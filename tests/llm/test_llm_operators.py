"""Each operator against a brute-force version, on edge cases and on the small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, exact_dedup, lang_id, packing, sharding, simhash, substring_dedup, suffix_array, suffix_dedup, token_scan, topk
from tidemark.llm.components import components

SF = "/root/testdata/sf0.001"
RNG = random.Random(11)
WORDS = ["on", "the", "Sea", "über", "naïve", "état", "x1", "3,14", "don't", "日本"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


PASSAGE = " ".join(f"w{k}" for k in range(60))
EDGE = [
    (1, "Same text here and there", "en", "a"),
    (2, "same TEXT here and there", "en", None),
    (3, None, None, "a"),
    (4, "", "fr", "b"),
    (5, "   \n\t ", "fr", "b"),
    (None, "no id at all", "en", "b"),
    (None, None, None, None),
    (7, "repeated row", "en", "a"),
    (7, "repeated row", "en", "a"),
    (8, "1234 5678 !!", None, "c"),
    (9, f"{prose(30)}\n{PASSAGE}\n{prose(10)}", "en", "c"),
    (10, f"{prose(20)}\r\n{PASSAGE}", "en", "c"),
    (11, "a" * 700, None, "c"),
    (12, prose(20_000), "en", "c"),
    (13, "<|endoftext|> x <|startoftext|>", "en", "c"),
    (14, "\x00\x1c ctrl \x85 ends", "en", "c"),
]
NAMES = "doc_id long, text string, lang string, source string, uid int, key string, `a.b` int, kept string, removed_spans int, n int"


def edge(spark):
    rows = [(*r, k, "k", k, "x", 5, 1) for k, r in enumerate(EDGE)]
    return spark.createDataFrame(rows, NAMES)


def nothing(spark):
    return spark.createDataFrame([], NAMES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# staged tables


def test_staged_tables_are_cleared(spark):
    made = common.stage(spark, spark.range(3), "three")
    assert made.count() == 3 and common.work_dir(spark).startswith(common.shared_dir(spark))
    folder = Path(common.work_dir(spark).removeprefix("file://"))
    assert list(folder.glob("three-*"))
    common.clear(spark)
    assert not folder.exists()


# exact dedup


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode().lower()).hexdigest()].append(i)
    rank = lambda i: (i is not None, i or 0)
    return sorted(((i, max(g, key=rank), len(g), h) for h, g in groups.items() for i in g), key=repr)


@pytest.mark.parametrize("flush", [1, 3, 200_000])
def test_exact_dedup(spark, docs, flush):
    for table in (edge(spark), docs):
        got = exact_dedup.exact_dedup(spark, table, flush=flush).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == exact_by_hand(pairs_of(table))
        kept = [r["text_sha256"] for r in got if r["kept"]]
        assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})
    assert exact_dedup.exact_dedup(spark, nothing(spark)).count() == 0


def test_cuckoo_filter_and_index():
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    index = exact_dedup.DigestIndex(16)
    for k, d in enumerate(keys):
        index.add(d, (True, k, k))
        index.add(d, (True, k // 2, k))
    assert index.resizes > 0 and index.size == 5000
    assert all(index.find(d)[1:] == ((True, k, k), 2) for k, d in enumerate(keys))
    for d in keys[:2500]:
        index.delete(d)
    assert all(index.find(d) is None for d in keys[:2500]) and all(index.find(d) for d in keys[2500:])
    assert index.filter.live == index.size == 2500
    absent = [hashlib.sha256(b"x%d" % k).digest() for k in range(20_000)]
    assert sum(d in index.filter for d in absent) < 100 and not any(index.find(d) for d in absent)


# SimHash


def simhash_by_hand(rows, distance=4):
    prints = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    lowest = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return sorted(((rows[k][0], f"{prints[k]:016x}", lowest[group[k]]) for k in range(len(rows))), key=repr)


@pytest.mark.parametrize("hot", [1, 4096])
def test_simhash(spark, docs, hot):
    near = [(100 + k, " ".join([*[f"word{j}" for j in range(300)], f"end{k}"])) for k in range(12)]
    table = edge(spark).select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    for t in (table, docs):
        got = sorted(map(tuple, simhash.simhash_groups(spark, t, hot=hot).collect()), key=repr)
        assert got == simhash_by_hand(pairs_of(t))


@pytest.mark.parametrize(("distance", "hot"), [(1, 1), (3, 1), (5, 4096)])
def test_hamming_links_of_any_distance(spark, distance, hot):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for b in base for _ in range(30)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.hamming_links(spark, spark.createDataFrame([(x,) for x in signed], "fp long"), distance, hot=hot)
    roots = dict(map(tuple, components(spark, links).collect()))
    group = {x: x for x in signed}
    for a, x in zip(fps, signed, strict=True):
        for b, y in zip(fps, signed, strict=True):
            if (a ^ b).bit_count() <= distance and group[x] != group[y]:
                low, high = sorted((group[x], group[y]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert {x: roots.get(x, x) for x in signed} == group


def test_simhash_of_nothing(spark):
    assert simhash.simhash_groups(spark, nothing(spark)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(50, 60), (60, 50), (60, 70), (5, 5)]
    got = dict(map(tuple, components(spark, spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {**{k: 0 for k in range(1, 41)}, 60: 50, 70: 50}


# sharding


@pytest.mark.parametrize("shards", [1, 8, 50])
def test_interleaved_shards(spark, docs, shards):
    for table in (edge(spark), docs):
        rows = sharding.interleave_shards(spark, table, shards).collect()
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(
            ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs_of(table)), key=repr
        )
        slots = defaultdict(list)
        mixture = defaultdict(lambda: [0] * shards)
        for r in rows:
            assert r["law"] == "rows" and r["grown_shard"] is None
            slots[r["shard"]].append(r["slot"])
            mixture[r["stratum"]][r["shard"]] += 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
        sizes = [len(slots[k]) for k in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        assert all(max(m) - min(m) <= 2 for m in mixture.values())
    assert sharding.interleave_shards(spark, nothing(spark)).count() == 0


def test_shards_keep_a_hot_source_in_proportion(spark):
    table = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source")
    counts = sharding.interleave_shards(spark, table).groupBy("shard", "stratum").count().collect()
    per = defaultdict(list)
    for r in counts:
        per[r["stratum"]].append(r["count"])
    assert all(len(c) == 8 and max(c) - min(c) <= 2 for c in per.values())


def test_shards_spread_null_ids_and_copies(spark):
    table = spark.range(3000).selectExpr("cast(null as long) as doc_id", "if(id < 1500, concat('text ', id), 'same') as text", "'a' as source")
    rows = sharding.interleave_shards(spark, table).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(375)) for x in slots.values()) and len(slots) == 8
    buckets = spark.createDataFrame([(r["text_crc32"], r["size"]) for r in rows], "c long, s long").distinct()
    named = F.concat_ws(":", F.lit(sharding.SEED), F.lit("null"), "c", "s")
    most = buckets.groupBy(F.floor(sharding._fraction(F.md5(named)) * 54)).count().agg({"count": "max"}).first()[0]
    assert most < 60  # 1501 kinds of rows over sqrt(3000) buckets


# tokens


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(bpe.vocabulary_path(n)) for n in (bpe.VOCABULARY, packing.VOCABULARY)}


def odd_texts():
    rng = random.Random(2)
    alphabets = ["ab", "abc ", "the in er", "\n\t  xy", "áéíñß漢 😀", "0123 .,!?-", "aA'sStT ", "Σσς İi ǅ "]
    made = ["".join(rng.choice(a) for _ in range(rng.randint(1, 60))) for a in alphabets for _ in range(60)]
    made += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(12)) for _ in range(300)]
    return [*made, "", "a" * 1000, " " * 999, "x<|endoftext|><|endoftext|>y <|endoftext", *[t for _, t, *_ in EDGE if t]]


def test_bpe_is_the_library(tokenizers):
    mine, library = bpe.load(bpe.vocabulary_path(bpe.VOCABULARY)), tokenizers[bpe.VOCABULARY]
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == ids, ascii(text)
        assert mine.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


def test_every_prefix_has_one_last_token():
    coder = bpe.load(bpe.vocabulary_path(bpe.VOCABULARY))
    for piece in (b" internationalisation", b"aaaaaaaaaaaaa", " été".encode()):
        for end in range(1, len(piece) + 1):
            found = coder.encode_piece(piece[:end])
            assert b"".join(coder.token_bytes[i] for i in found) == piece[:end]
            assert all(coder.compatible(a, b) for a, b in zip(found, found[1:], strict=False))


def test_encode_and_decode_documents(spark, docs, tokenizers):
    library = tokenizers[bpe.VOCABULARY]
    for table in (edge(spark), docs):
        got = bpe.decode_documents(spark, bpe.encode_documents(spark, table)).collect()
        want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in pairs_of(table)), key=repr)
        assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["text"]).decode()) for r in got), key=repr) == want
    assert bpe.encode_documents(spark, nothing(spark)).count() == 0


def library_counts(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))
    library.encode_special_tokens = True  # strings of special tokens are text
    return sorted(((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=repr)


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_token_counts(spark, docs, block):
    tables = [edge(spark).where("doc_id <> 12 OR doc_id IS NULL") if block == 1 else edge(spark)]  # 12 is long
    tables += [docs] if block > 7 else []
    for table in tables:
        got = token_scan.document_token_counts(spark, table, block=block).collect()
        assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == library_counts(pairs_of(table))
    assert token_scan.document_token_counts(spark, nothing(spark), block=block).count() == 0


def test_token_counts_of_texts_with_a_separator(spark):
    rows = [(i, t) for i, t, *_ in EDGE] + [(20, "<|endoftext|><|endoftext|>"), (21, "one more text after it")]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # one file
    for block in (7, 1 << 18):
        got = token_scan.document_token_counts(spark, table, block=block).collect()
        assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == library_counts(rows)


def test_built_files_are_flat(spark):
    table = spark.createDataFrame([(k, t) for k, t in enumerate(["alpha beta", "", "gamma delta epsilon"])], "doc_id long, text string").coalesce(1)
    folder, names = token_scan.build_token_files(spark, table)
    coder = bpe.load(bpe.vocabulary_path(bpe.VOCABULARY))
    want = [i for r in table.collect() for i in [*np.frombuffer(coder.encode(r["text"]), "<u4"), token_scan.SEPARATOR]]
    files = spark.read.format("binaryFile").load(folder).collect()
    assert [np.frombuffer(r["content"], "<u2").tolist() for r in files] == [want]
    assert [tuple(r) for r in names.collect()] == [(files[0]["path"].rpartition("/")[2], 0, [0, 1, 2])]


@pytest.mark.parametrize("width", [2, 4])
def test_token_files(spark, tmp_path, width):
    top = 70_000 if width == 4 else 0  # ids beyond 16 bits
    files = {"a": [5, 9, top, top, 7, top], "b": [1, 2, 3], "c": [], "d": [top], "e": [4] * 25 + [top, 8]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, f"<u{width}").tobytes() + b"x" * (name == "b"))
    for block in (1, 3, 4, 100):
        blocks = token_scan.token_file_blocks(spark, str(tmp_path), block, width)
        assert blocks.where(F.col("length") > block * width).count() == 0
        rows = token_scan.count_tokens(spark, blocks, top, width).collect()
        got = sorted((r["file"], r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in rows)
        assert got == [
            ("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 1, True), ("b", 0, 0, 3, False), ("d", 0, 0, 0, True), ("e", 0, 0, 25, True), ("e", 1, 26, 1, False),
        ]


# packing


def test_word_ids_are_the_library(tokenizers):
    mine, library = packing.load(bpe.vocabulary_path(packing.VOCABULARY)), tokenizers[packing.VOCABULARY]
    for text in odd_texts():
        assert np.frombuffer(mine.encode(text.encode()), mine.kind).tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_hilbert_curve():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    keys = packing.hilbert_key(cells, 3)
    walk = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("length", [16, 2048])
def test_packing(spark, docs, tokenizers, length):
    library = tokenizers[packing.VOCABULARY]
    for table in (edge(spark), docs):
        want = defaultdict(list)
        for i, t in pairs_of(table):
            want[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
        rows = packing.pack(spark, table, length).collect()
        total = sum(len(x) for group in want.values() for x in group)
        assert sum(r["length"] for r in rows) == total
        for r in rows:
            assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in want[r["doc_id"]])
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for k, pieces in sequences.items():
            pieces.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and pieces[0][0] == 0
            assert sum(n for _, n in pieces) == (length if k < max(sequences) else total - length * max(sequences))
    assert packing.pack(spark, nothing(spark)).count() == 0


def test_neighbours_in_the_order_are_alike(spark, docs):
    """Documents next to each other share more words than documents far from each other."""
    texts = dict(r for r in pairs_of(docs) if r[1])
    rows = packing.pack(spark, docs).where("start = 0").orderBy("sequence_id", "offset").collect()
    words = [set(texts[r["doc_id"]].lower().split()) for r in rows if r["doc_id"] in texts]
    alike = lambda a, b: len(a & b) / max(1, len(a | b))
    half = len(words) // 2
    near = [alike(a, b) for a, b in zip(words, words[1:], strict=False)]
    far = [alike(words[k], words[(k + half) % len(words)]) for k in range(len(words))]
    assert np.mean(near) > 1.5 * np.mean(far)


def test_ids_of_a_large_vocabulary(spark, tmp_path):
    import json

    with open(bpe.vocabulary_path(packing.VOCABULARY), encoding="utf-8") as f:
        spec = json.load(f)
    token = "zzyzx</w>"
    assert token not in spec["model"]["vocab"]
    left = next(t for t in ("zzy", "zz") if t in spec["model"]["vocab"])
    right = token.removeprefix(left)
    spec["model"]["vocab"] |= {right: 69_999} if right not in spec["model"]["vocab"] else {}
    spec["model"]["vocab"][token] = 70_000
    (tmp_path / "large.json").write_text(json.dumps(spec))
    coder = packing.load(str(tmp_path / "large.json"))
    assert coder.kind == "<u4" and coder.size == 70_001
    assert np.frombuffer(coder.encode(b"the sea \xe6\x97\xa5"), "<u4").tolist() == coder.tokenizer.encode("the sea 日", add_special_tokens=False).ids
    table = spark.createDataFrame([(1, "the sea"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["length"]) for r in packing.pack(spark, table, path=str(tmp_path / "large.json")).collect()) == [(1, 3), (2, 1)]


# language ID


def test_language_id(spark, docs):
    got = {r["doc_id"]: r for r in lang_id.language_id(spark, docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i in truth if got[i]["held_out"] and truth[i]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held) > 20
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_edges(spark):
    got = sorted(map(tuple, lang_id.language_id(spark, edge(spark)).select("doc_id", "lang_pred", "score").collect()), key=repr)
    without = {3, 4, 5, 8}
    assert len(got) == len(EDGE) and all((p == "und" and s == 0) for i, p, s in got if i in without)
    assert all(p in ("en", "fr") for i, p, s in got if i in (1, 9, 12))
    assert lang_id.language_id(spark, nothing(spark)).count() == 0
    bare = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert lang_id.language_id(spark, bare).first()["lang_pred"] == "und"


def test_every_language_and_whole_texts_are_learned(spark):
    words = [f"{a}{b}{a}{a}{b}" for a in "abcdefghijk" for b in "lmnopqrstuv"]  # one language each
    rows = [(k, " ".join([w] * 20), f"l{k:03}") for k, w in enumerate(words)] + [(900 + k, "zwz yxy", "l999") for k in range(3)]
    table = spark.createDataFrame([*rows, (1000, "ab " * 8000 + "zq " * 9000, "long")], "doc_id long, text string, lang string")
    model = lang_id.fit(spark, table)
    assert model.languages == sorted({r[2] for r in rows} | {"long"}) and len(model.languages) > 100
    slots, counts = lang_id.features(b"zq " * 9000)
    learned = model.likelihood[model.languages.index("long")]
    assert all(learned[slots[counts > 8000]] > 1000 * learned.min())


def test_mixture_proportions(spark, docs):
    model = lang_id.fit(spark, docs)
    of = {r["lang"]: r["text"] for r in docs.where("length(text) > 1500 AND lang IS NOT NULL").orderBy("doc_id").collect()}
    text = (of["en"][:1000] + " " + of["de"][:1000]).encode()
    found = {model.languages[k]: p for k, p in lang_id.infer(model.likelihood, text)}
    assert set(found) == {"en", "de"} and 0.35 < found["en"] < 0.65
    # the likelihood of the chosen proportions beats any on a grid
    at, counts = lang_id.features(text)
    two = model.likelihood[[model.languages.index("en"), model.languages.index("de")]][:, at]
    weights, value = lang_id.mix(np.array([0.5, 0.5]), two, counts.astype(float), steps=500)
    assert all(value >= counts @ np.log(np.array([p, 1 - p]) @ two) - 1e-3 for p in np.linspace(0.01, 0.99, 99))


def test_language_sets_against_all_subsets(spark, docs):
    """The search finds the set of least penalised likelihood among all sets of four languages, or one within a hair of it."""
    from itertools import combinations

    model = lang_id.fit(spark, docs)
    texts = defaultdict(list)
    for r in docs.where("length(text) > 1200 AND lang IS NOT NULL").orderBy("doc_id").collect():
        texts[r["lang"]].append(r["text"][:1000])
    names = sorted(texts)
    assert len(model.languages) == 4
    for k in range(12):
        mixed = " ".join(texts[x][k % len(texts[x])][: 300 + 200 * j] for j, x in enumerate(names[: 1 + k % 4])).encode()
        at, counts = lang_id.features(mixed)
        table, counts = model.likelihood[:, at], counts.astype(float)
        cost = {}
        for size in range(1, 5):
            for some in combinations(range(4), size):
                _, value = lang_id.mix(np.full(size, 1 / size), table[list(some)], counts, steps=2000)
                cost[some] = value - (size - 1) * lang_id.PENALTY * np.log(counts.sum())
        found = tuple(sorted(x for x, _ in lang_id.infer(model.likelihood, mixed)))
        best = max(cost, key=cost.get)
        assert found == best or cost[best] - cost[found] < 0.01, (k, found, best, cost)


# substring dedup


def units_by_hand(raw, min_words):
    """{(start, end): words} of the paragraphs of whole lines and of whole sentences."""
    lines, at = [], 0
    for line in re.findall(rb"[^\r\n]*[\r\n]|[^\r\n]+", raw):
        pieces, place = [], at
        for piece in re.findall(rb"(?s).*?[.!?][ \t]+|.+", line):
            pieces.append((place, place + len(piece), piece.lower().split()))
            place += len(piece)
        at += len(line)
        pieces = [p for p in pieces if p[2]]
        if pieces:
            lines.append(pieces)
    out = {}
    for parts in (lines, [[p] for line in lines for p in line]):
        for k in range(len(parts)):
            words = []
            for e in range(k, len(parts)):
                words += [w for p in parts[e] for w in p[2]]
                if sum(1 + len(w) // 15 for w in words) >= min_words:
                    out[parts[k][0][0], parts[e][-1][1]] = tuple(words)
                    break
    return out


def passages_by_hand(rows, min_words):
    """What is left of each text, and the bytes removed; every byte removed lies in a unit seen earlier."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for (a, b), words in sorted(units_by_hand(raw, min_words).items()):
            if words in seen:
                gone[a:b] = True
            seen.add(words)
        out[i, t] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode()
    return out


@pytest.mark.parametrize("min_words", [1, 7, 20])
def test_substring_dedup(spark, docs, min_words):
    for table in (edge(spark), docs):
        want = passages_by_hand(pairs_of(table), min_words)
        made = substring_dedup.substring_dedup(spark, table, min_words)
        ordered = table.select("doc_id", "text").collect()
        assert sorted(((r["doc_id"], r["text"]) for r in made.collect()), key=repr) == sorted(((i, want.get((i, t), t)) for i, t in ordered), key=repr)
        texts = {(r["doc_id"], r["text"]) for r in ordered}
        for r in made.where("size(removed_spans) > 0").collect():
            cut = {t.encode() for i, t in texts if i == r["doc_id"]}
            assert any(_without(t, r["removed_spans"]) == r["text"].encode() for t in cut)
    made = substring_dedup.substring_dedup(spark, edge(spark), min_words)
    assert made.columns == [c for c in edge(spark).columns if c != "removed_spans"] + ["removed_spans"]
    assert made.where("doc_id = 10").first()["text"].count("w59") == 0
    assert substring_dedup.substring_dedup(spark, nothing(spark)).count() == 0


def test_passage_inside_a_line(spark):
    passage = "Ab one two three four. Cd five six seven eight nine! Ef is it ten? No. Gh eleven twelve thirteen fourteen fifteen sixteen seventeen."
    rows = [(1, f"Own words first. {passage} and more."), (2, f"Other start here now. {passage} Then its own end."), (3, "Cd five six seven eight nine! Clean text goes on in its own way.")]
    made = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()}
    assert made == {1: rows[0][1], 2: "Other start here now. Then its own end.", 3: rows[2][1]}


def test_words_between_repeats_stay(spark):
    one, two = "One two three four five six seven.", "Eight nine ten eleven twelve thirteen."
    rows = [(1, f"{one} {two}\n"), (2, f"{one} UNIQUE SECRET. {two}\nUNIQUE LINE\n{one} {two}\n")]
    for min_words, want in ((13, f"{one} UNIQUE SECRET. {two}\nUNIQUE LINE\n"), (1, "UNIQUE SECRET. UNIQUE LINE\n")):
        made = substring_dedup.substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), min_words)
        assert {r["doc_id"]: r["text"] for r in made.collect()} == {1: rows[0][1], 2: want}


def test_passage_without_spaces(spark):
    rows = [(k, f"{start}\n{'這是一段很長的文字沒有空格' * 12}\n") for k, start in enumerate(("甲", "乙"))]
    made = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert made == {0: rows[0][1], 1: "乙\n"}


def _without(text, spans):
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return b"".join([*out, text[at:]])


# top-k


def best_by_hand(rows, k, every):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is not None and i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j is None, j or 0) for b, (j, v) in enumerate(ok) if a != b)
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def vectors():
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1.5, 0.0, 0.25, rng.gauss(0, 0.3)]) for _ in range(6)]) for k in range(60)]
    rows += [(60, None), (61, []), (62, [1.0, None]), (63, [float("nan")] * 6), (64, [float("inf")] * 6), (None, [1.0] * 6), (None, [0.5] * 6)]
    return [*rows, (65, rows[3][1]), (66, rows[3][1]), (67, [0.0] * 6), (70, [0.5, 0.25]), (80, []), (20, rows[20][1]), (30, rows[7][1])]


@pytest.mark.parametrize(("block", "per", "group"), [(8, 2, 3), (8, 3, 100), (4096, 256, 16)])
def test_top_k(spark, block, per, group):
    table = spark.createDataFrame([(*r, 1) for r in vectors()], "vec_id long, embedding array<float>, score int")
    seen = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = sorted(map(tuple, topk.top_k(spark, table, every=10, block=block, queries_per_block=per, per_group=group).collect()), key=repr)
    assert got == best_by_hand(seen, 10, 10)
    few = topk.top_k(spark, table.where("vec_id in (0, 1, 2)"), every=10).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert topk.top_k(spark, table.limit(0)).count() == 0


def test_each_block_is_indexed_once(monkeypatch):
    built = []
    monkeypatch.setattr(topk, "ImpactBlock", lambda ids, matrix, make=topk.ImpactBlock: built.append(len(ids)) or make(ids, matrix))
    rng = np.random.default_rng(8)
    blocks = [topk._Vectors(list(range(9 * n, 9 * n + 9)), list(range(9 * n, 9 * n + 9)), rng.integers(-50, 50, (9, 4)).tolist()) for n in range(4)]
    whole = [pa.RecordBatch.from_arrays([pa.array([x]) for x in (0, kind, n)] + b.batch().columns, names=["g", "kind", "number", *b.batch().schema.names]) for kind in (0, 1) for n, b in enumerate(blocks)]
    found = [r for b in topk._search_batches(iter(whole), 3) for r in b.to_pylist()]
    assert built == [9] * 4 and len(found) == 4 * 9 * 3
    rows = [(int(i), m.tolist()) for b in blocks for i, m in zip(b.ids, b.matrix / 1024, strict=True)]
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in found) == sorted((i, j, s) for i, _, j, s in best_by_hand(rows, 3, 1))


def test_scan_stops_on_proof():
    rng = np.random.default_rng(3)
    matrix = np.floor(1024 * rng.standard_normal((4000, 24)) * np.array([4, 2] + [0.05] * 22)).astype(np.int64)
    block = topk.ImpactBlock(np.arange(4000), matrix)
    query = matrix[:5]
    at, rows, scores, scanned = topk.search_block(block, np.arange(5), query, 10, np.full(5, -np.inf))
    assert scanned < len(block.levels)
    for q in range(5):
        exact = matrix @ query[q]
        exact[q] = -(1 << 60)
        best = np.argsort(-exact, kind="stable")[:10]
        assert set(best.tolist()) <= set(rows[at == q].tolist()) and (scores[at == q] == exact[rows[at == q]]).all()


# suffix arrays


def test_suffix_array(monkeypatch):
    rng = random.Random(5)
    for k in range(600):
        monkeypatch.setattr(suffix_array, "NAMES_SHARE", rng.choice([0, 1, 16]))
        n, letters = rng.randint(1, 60), rng.choice([1, 2, 3, 250])
        text = [rng.randrange(letters) for _ in range(n)]
        if k % 3 == 0:
            text = (text[: rng.randint(1, 5)] * 60)[:n]
        order = suffix_array.suffix_array(np.array(text, np.uint8))
        assert order.tolist() == sorted(range(n), key=lambda i, t=text: t[i:])
        common = suffix_array.permuted_lcp(np.array(text, np.uint8), order)
        for a, b in zip(order.tolist(), order.tolist()[1:], strict=False):
            same = 0
            while max(a, b) + same < n and text[a + same] == text[b + same]:
                same += 1
            assert common[b] == same


def covered_by_hand(rows, width=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - width + 1):
            if raw[k : k + width] in seen:
                gone[k : k + width] = True
            seen.add(raw[k : k + width])
        out.append((i, len(raw), int(np.diff(np.concatenate(([0], gone.astype(int)))).clip(0).sum()), bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return sorted(out, key=repr)


def patchwork(n=40):
    rng = random.Random(3)
    base = "".join(rng.choice("abcd ") for _ in range(400))
    rows = []
    for k in range(n):
        text = ""
        for _ in range(rng.randint(0, 6)):
            kind, at = rng.random(), rng.randint(0, 300)
            text += base[at : at + rng.randint(50, 250)] if kind < 0.5 else rng.choice(["x", "ab"]) * rng.randint(1, 260) if kind < 0.8 else "".join(rng.choice("abcdefgh") for _ in range(90))
        rows.append((k if k != 7 else None, text if k != 9 else None))
    return rows


@pytest.mark.parametrize("hot", [1, 32, 256])
def test_suffix_dedup(spark, docs, hot):
    rows = patchwork()
    for want, table in ((rows, spark.createDataFrame(rows, "doc_id long, text string")), (pairs_of(docs), docs)):
        got = suffix_dedup.suffix_dedup(spark, table, hot=hot, shard=5000).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in got), key=repr) == covered_by_hand(want)


def test_suffix_dedup_edges(spark):
    got = suffix_dedup.suffix_dedup(spark, edge(spark)).collect()
    assert len(got) == len(EDGE) and {r["n_bytes"] for r in got if r["doc_id"] == 7} == {12}
    assert [len(r["kept"]) for r in got if r["doc_id"] == 11] == [1]
    both = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, PASSAGE)], "doc_id long, text string")
    assert sorted((r["doc_id"], len(r["kept"])) for r in suffix_dedup.suffix_dedup(spark, both).collect()) == [(1, len(PASSAGE)), (1, len(PASSAGE)), (2, 0)]
    assert suffix_dedup.suffix_dedup(spark, nothing(spark)).count() == 0


def test_copies_are_compared_byte_by_byte(spark, monkeypatch):
    """Runs of copies across spans, and what happens where hashes agree and bytes do not."""
    base = "".join(RNG.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, base), (2, "x" + base[5_000:25_000] + "y" + base[100:20_500]), (3, base), (4, base[:8_300])]
    got = suffix_dedup.suffix_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in got), key=repr) == covered_by_hand(rows)
    compared = suffix_dedup._Compared()
    compared.add([7, 7, 7, 7], [-1, -1, 3, 9], [40, 10, 11, 41], [b"xyzxyz", b"abcdefgh", b"bcdef", b"yzx"])
    for t, piece in ((11, b"bcdex"), (9, b"abcd"), (14, b"efghi"), (41, b"yzxyzx")):
        with pytest.raises(ValueError, match="equal hash"):
            compared.add([7], [3], [t], [piece])
    with pytest.raises(ValueError, match="equal hash"):
        compared.add([8], [3], [11], [b"bcdef"])


def test_steps_delete_what_earlier_steps_left(spark, docs):
    """Of the tables only the one that the result reads stays; no shuffle of a written step does."""
    shuffles = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    common.clear(spark)
    before = shuffles()
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    result = suffix_dedup.suffix_dedup(spark, docs)
    assert not shuffles() - before
    folder = Path(common.work_dir(spark).removeprefix("file://"))
    assert [x.name.rsplit("-", 1)[0] for x in folder.iterdir()] == ["suffix-spans"]
    assert result.count() == docs.count() and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting


def test_copies_of_one_text_are_spread(monkeypatch):
    """Many copies meet in no one bucket, and a task sends those of the same bytes to be compared once."""
    text, n = " ".join(f"v{k}" for k in range(90)).encode(), 3000
    schema = pa.schema([("rid", pa.int64()), ("key", pa.int64()), ("t", pa.binary())])
    rows = pa.record_batch([pa.array(range(n)), pa.array([77] * n), pa.array([text] * n)], schema=schema)
    packed = list(suffix_dedup._anchor_batches([rows], 100, 64, 256))
    claims = {b: suffix_dedup._unpack(x) for p in packed for b, kind, x in zip(*(c.to_pylist() for c in p.columns), strict=True) if kind == suffix_dedup.CLAIM}
    assert len(claims) == 64 and max(map(len, claims.values())) < 2 * sum(map(len, claims.values())) / 64
    entries = [[] for _ in range(n)]
    for p in packed:
        for kind, x in zip(p.column(1).to_pylist(), p.column(2).to_pylist(), strict=True):
            for e in suffix_dedup._unpack(x) if kind in (suffix_dedup.CLAIM, suffix_dedup.LEAD) else []:
                entries[e["rid"]].append({"kind": kind} | {c: int(e[c].view(np.int64)) if c in "ab" else int(e[c]) for c in ("a", "b", "s", "m", "t")})
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("s", pa.int32()), ("m", pa.int32()), ("t", pa.int32())]))
    joined = pa.record_batch([*rows.columns, pa.array(entries, kind)], names=["rid", "key", "t", "entries"])
    for sent in (1 << 22, 1):
        monkeypatch.setattr(suffix_dedup, "SENT", sent)
        made = list(suffix_dedup._fetch_batches([joined], 100, 64))
        compared = sum(p.column(1).to_pylist().count(suffix_dedup.VERIFY) for p in made)
        assert compared == 2 if sent > 1 else 2 < compared < n / 4
        table = pa.Table.from_batches(made).sort_by([(c, "ascending") for c in ("kind", "shard", "a", "s")])
        marks = [(r, s, m) for p in suffix_dedup._shard_batches(table.to_batches(), 100, 5000) for r, s, m in zip(*(p.column(c).to_pylist() for c in ("rid", "s", "m")), strict=True)]
        assert sorted(marks) == [(k, 0, len(text) - 99) for k in range(1, n)]


def test_long_texts_are_cut_into_chunks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    text = "".join(RNG.choice("abc") for _ in range(500)).encode()
    starts = [w for _, s, m in suffix_dedup.segments(text) for a, b in zip(s.tolist(), m.tolist(), strict=True) for w in range(a, a + b)]
    assert starts == list(range(len(text) - 99))
