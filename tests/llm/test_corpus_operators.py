"""Operators on whole corpora against brute force: search, sharding, similarity join, packing, pipeline."""

import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetdrift.llm import hnsw, jaccard, packing, shards
from fleetdrift.llm.components import components
from fleetdrift.llm.numbering import numbered
from fleetdrift.llm.queries import tokenizer_path


# --- helpers ---


def test_numbers_are_gapless_in_hot_groups(spark):
    rows = spark.range(5000).select((F.col("id") % 10 == 0).alias("g"), "id", (F.col("id") % 7).alias("x"))
    found = numbered(rows, ["g"], ["id"], "place", slices=13)
    for g in (True, False):
        places = sorted(r.place for r in found.where(F.col("g") == g).collect())
        assert places == list(range(len(places)))
    sums = numbered(rows, ["g"], ["id"], "before", F.col("x"), slices=13).where("g").orderBy("before", "x").collect()
    assert sums[0].before == 0 and len(sums) == 500


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(2)
    pairs = [tuple(int(x) for x in rng.integers(0, 400, 2)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert found == {n: find(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- search ---


def brute_nearest(ids, vectors, query, k):
    scores = vectors.astype(float) @ vectors[ids.index(query)].astype(float)
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-scores[i], ids[i]))
    return [ids[i] for i in order[:k]]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32) * rng.uniform(0.5, 2, 1500)[:, None].astype(np.float32)
    vectors[100:140] = vectors[100]  # equal vectors
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = hnsw.nearest(rows, F.col("vec_id") % 20 == 0, shard_rows=400, block_queries=30).collect()
    by_query = defaultdict(dict)
    for r in found:
        by_query[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert len(by_query) == 75 and all(sorted(x) == list(range(1, 21)) for x in by_query.values())
    hits = 0
    for q, x in by_query.items():
        best = brute_nearest(list(range(1500)), vectors, q, 20)
        hits += len(set(best) & {v for v, _ in x.values()})
        assert all(s == pytest.approx(float(vectors[v].astype(float) @ vectors[q].astype(float)), rel=1e-12) for v, s in x.values())
    assert hits >= 0.95 * 75 * 20


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]),
        (7, []), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 2.0, 3.0]), (60, [1.0]), (61, [2.0]), (None, [1.0, 1.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.nearest(table, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(found) == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5), (60, 1, 61, 2.0)]
    assert hnsw.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize(("dim", "kind"), [(16, "huge"), (16, "uneven"), (16, "one long"), (256, "even")])
def test_search_of_any_finite_lengths(spark, dim, kind):
    """Recall holds for lengths whose squares overflow, for lengths of all sizes, and for many dimensions."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(900, dim))
    if kind == "huge":
        vectors *= 1e25
    elif kind == "uneven":
        vectors *= 10.0 ** rng.integers(-5, 6, 900)[:, None]
    elif kind == "one long":
        vectors[7] *= 1e7
    vectors = vectors.astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = defaultdict(set)
    for r in hnsw.nearest(rows, F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].add(r.vec_id)
    best = {q: set(brute_nearest(list(range(900)), vectors, q, 20)) for q in found}
    assert len(found) == 45 and all(len(x) == 20 for x in found.values())
    assert sum(len(found[q] & best[q]) for q in found) >= 0.95 * 45 * 20


def test_one_vec_id_repeated_very_often(spark):
    rows = spark.range(4000).selectExpr("IF(id < 3900, 5L, id) AS vec_id", "array(cast(id as float), 1.0f) AS embedding")
    found = hnsw.nearest(rows, F.col("vec_id") == 5, k=200).collect()
    assert {r.vec_id for r in found} == set(range(3900, 4000)) and len(found) == 100


# --- sharding ---


def test_sizes_are_near_equal_and_copies_stay_together(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = shards.balanced_shards(docs, ["doc_id"], 4).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(text)
    sizes, groups, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in rows:
        raw = text[r.doc_id].encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
        sizes[r.shard] += r["size"]
        groups[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 4
    assert max(sizes.values()) - min(sizes.values()) <= 0.1 * mean
    assert sum(len(s) > 1 for s in groups.values()) <= 0.1 * len(groups)


def test_sharding_of_odd_and_hot_tables(spark):
    rows = [(i, "one text that a third of all rows share " * 3) for i in range(120)] + [(i, f"text {i} " * (i % 9)) for i in range(200, 440)]
    rows += [(1, None), (2, None), (None, ""), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x"))
    found = shards.balanced_shards(docs, ["doc_id"], 5)
    assert found.count() == len(rows) and found.select("shard").distinct().count() == 5
    sizes = [r[0] for r in found.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert max(sizes) - min(sizes) <= 0.15 * np.mean(sizes)
    assert shards.balanced_shards(docs.limit(0), ["doc_id"], 5).count() == 0


def test_linked_nodes_move_together(spark):
    nodes = spark.createDataFrame([(i, 10, i % 4) for i in range(400)], "node long, bytes long, shard int")
    links = spark.createDataFrame([(i, i // 20) for i in range(400)], "node long, link long")

    def cut(state):
        joined = links.join(state, "node").groupBy("link").agg(F.count_distinct("shard").alias("n"))
        return joined.agg(F.sum("n")).first()[0]

    after = shards.propagate(nodes, links, 3)
    assert cut(after) < cut(nodes) and after.count() == 400
    assert [r.b for r in after.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()] == pytest.approx([1000] * 4, rel=0.3)


def test_all_shards_of_a_link_have_votes(spark):
    """Nodes 0 and 1 change places: their links' fifth strongest shard is the same one each time, the stronger ones differ."""
    nodes, links = [(0, 10, 0), (1, 10, 1)], []
    for link in range(6):
        node, best = (0, 1) if link < 3 else (1, 0)
        others = [2 + 4 * link + j for j in range(4) for _ in range(3)]
        links.append((node, link))
        for shard in [*others, best, best]:
            links.append((len(nodes), link))
            nodes.append((len(nodes), 10, shard))
    state = spark.createDataFrame(nodes, "node long, bytes long, shard int")
    after = shards.propagate(state, spark.createDataFrame(links, "node long, link long"), 1)
    assert {r.node: r.shard for r in after.where("node < 2").collect()} == {0: 1, 1: 0}


def test_groups_below_a_shard_stay_whole_and_near_their_lines(spark):
    line = "a line of more than forty characters in copies and near copies "
    rows = [(i, line * 3 + f"\n{line}") for i in range(100)] + [(1000 + i, f"{line}\nnear copy {i}") for i in range(40)]
    rng = np.random.default_rng(6)
    rows += [(2000 + i, rng.bytes(70).hex()) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = shards.balanced_shards(docs, ["doc_id"], 3).collect()
    groups = Counter(r.shard for r in found if r.doc_id < 100)
    assert len(groups) == 1  # 27 of some 110 KB, a shard holds 36
    near = Counter(r.shard for r in found if 1000 <= r.doc_id < 2000)
    assert near[next(iter(groups))] >= 20  # at random some 13
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 0.05 * sum(sizes.values()) / 3
    pairs = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 0)], "link int, shard int")
    assert shards.cut_share(pairs) == pytest.approx(2 / 3)


def test_a_large_node_changes_places_with_small_ones(spark):
    nodes = [(0, 100, 0)] + [(i, 10, 1) for i in range(1, 11)] + [(i, 1, i % 2) for i in range(20, 60)]
    links = [(0, 1)] + [(i, 1) for i in range(20, 60) if i % 2 == 1] + [(i, 2) for i in range(1, 11)]
    links += [(i, 2) for i in range(20, 60) if i % 2 == 0]
    state = spark.createDataFrame(nodes, "node long, bytes long, shard int")
    after = shards.propagate(state, spark.createDataFrame(links, "node long, link long"), 1)
    place = {r.node: r.shard for r in after.collect()}
    assert place[0] == 1 and all(place[i] == 0 for i in range(1, 11))


def test_short_lines_and_near_copies_of_one_line_link(spark):
    rng = np.random.default_rng(8)
    rows, family = [], {}
    for f in range(24):
        words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(30)]
        for c in range(10):
            text = "\n".join(rng.permutation(words)) if f % 2 else " ".join([*words[:15], f"copy{c}", *words[15:]])
            family[len(rows)] = f
            rows.append((len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = shards.balanced_shards(docs, ["doc_id"], 4).collect()
    places = defaultdict(Counter)
    for r in found:
        places[family[r.doc_id]][r.shard] += 1
    most = [max(c.values()) for _, c in sorted(places.items())]
    # At random the strongest shard holds about 4 of the 10.
    assert np.mean(most[::2]) >= 7 and np.mean(most[1::2]) >= 7


def test_sketches_of_long_texts_take_bounded_memory():
    rng = np.random.default_rng(12)
    long = [rng.bytes(n).hex().upper() for n in (1_000_000, shards.PIECE // 2 + 12, shards.PIECE // 2, 30_000)]
    texts = [*long, *(f"text {i} " * 300 for i in range(2000)), "ab" * shards.PIECE, "Short", "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(len(texts)), pa.int64())], ["text", "group"])
    tracemalloc.start()
    found = [(g, x) for b in shards._window_links([batch]) for g, x in zip(b["group"].to_pylist(), b["link"].to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    sketches = defaultdict(list)
    for group, link in found:
        sketches[group].append(link)
    for group in (0, 1, 2, 3, 4, 1999, len(texts) - 4, len(texts) - 3):
        data = np.frombuffer(texts[group].lower().encode(), np.uint8)
        width = next(w for least, w in shards.WINDOWS.items() if len(data) >= least)
        starts = np.arange(len(data) - width + 1)
        hashes = np.unique(shards.span_hashes(data, starts, starts + width))[: shards.SKETCH]
        assert sketches[group] == hashes.view(np.int64).tolist()
    assert max(sketches) == len(texts) - 3


def test_a_round_writes_one_table(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, 10, i % 4) for i in range(400)], "node long, bytes long, shard int")
    links = spark.createDataFrame([(i, i // 20) for i in range(400)], "node long, link long")
    written, stored = [], shards.stored
    monkeypatch.setattr(shards, "stored", lambda df: written.append(stored(df)) or written[-1])
    after = shards.propagate(nodes, links, 2)
    assert len(written) <= 2
    even = shards.even_out(after, links.select("node").distinct().withColumn("linked", F.lit(1)), 4)
    assert len(written) <= 3
    assert even.columns == after.columns and even.count() == 400


# --- similarity join ---


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), 1 << 60), rows[i][0])
    return Counter((rows[i][0], len(sets[i]), low[find(i)]) for i in range(len(rows)))


def check_join(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    found = jaccard.similar_groups(docs, ["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)


def edited(rng, words, share):
    return [w if rng.random() > share else f"x{rng.integers(1 << 30)}" for w in words]


def test_join_equals_brute_force_on_near_copies(spark):
    """Many near copies around the threshold, of one text and of texts of all lengths."""
    rng = np.random.default_rng(6)
    rows = []
    base = [f"w{rng.integers(500)}" for _ in range(120)]
    for _ in range(120):
        rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.04])))))
    for n in list(range(1, 30)) + [60, 200]:
        text = [f"v{rng.integers(1 << 30)}" for _ in range(n)]
        for _ in range(4):
            cut = text[: max(1, n - int(rng.integers(0, n // 3 + 1)))]
            rows.append((len(rows), " ".join(edited(rng, cut, 0.01))))
    check_join(spark, rows)


def test_join_on_frequent_tokens(spark, monkeypatch):
    """Pairs of neighbouring tokens find what single tokens would."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "FREQUENT_TIMES", 0)
    rng = np.random.default_rng(7)
    passages = [[f"p{k}_{i}" for i in range(25)] for k in range(6)]
    rows = []
    for _ in range(150):
        chosen = rng.choice(6, int(rng.integers(1, 5)), replace=False)
        text = [w for k in chosen for w in passages[k]] + [f"u{rng.integers(1 << 30)}" for _ in range(int(rng.integers(0, 12)))]
        rows.append((len(rows), " ".join(text)))
    check_join(spark, rows)


def test_join_without_rounds_against_one_node(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    rng = np.random.default_rng(8)
    base = [f"w{rng.integers(500)}" for _ in range(80)]
    check_join(spark, [(i, " ".join(edited(rng, base, 0.02))) for i in range(60)])


def test_join_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    check_join(spark, [
        (5, None), (6, ""), (7, " \n"), (8, "One"), (9, "one"), (10, "ONE TWO"), (11, "one two three four five"),
        (12, "ONE two three four five"), (12, "one two three four five"), (13, long), (14, long + " more"), (15, "é É"), (16, "é É"),
    ])
    assert jaccard.similar_groups(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_join_of_the_small_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check_join(spark, rows)


# --- packing ---


def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path())
    found.encode_special_tokens = True
    return found


ODD_TEXTS = [
    None, "", "a  b", "x   y\n\n z", " <|endoftext|> don't I'll", "tab\t\tq \r\n w\x0b e\x1c f", "é  à 12 34 !!", "  lead",
    "trail  ", "日本語 テスト　 終", "a  b   c​  d", "﻿x  y'sz's", "same", "same", "long word" * 900, "\x00 \x00\x85 x",
]


def test_pieces_hold_every_id_once(spark, small):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x"))
    pieces = packing.pack(docs, tokenizer_path()).collect()
    own = tokenizer()
    ids = {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
    assert set(of_doc) == set(ids)
    for i, mine in of_doc.items():
        place = 0
        for p in sorted(mine, key=lambda p: p.start):
            assert p.start == place and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(ids[i][p.start : p.start + p.length].tobytes())
            place += p.length
        assert place == len(ids[i])
    for mine in of_sequence.values():
        place = 0
        for p in sorted(mine, key=lambda p: p.offset):
            assert p.offset == place
            place += p.length
        assert place <= 1024
    used = sum(p.length for p in pieces)
    assert used >= 0.97 * 1024 * (len(of_sequence) - 1)


def test_packing_of_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_patterns_use_every_length_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 1024, 200), rng.integers(1, 500, 200), strict=True)}
    used = Counter()
    for lengths, count in packing.pack_histogram(counts):
        assert sum(lengths) <= 1024 and count > 0
        for n in lengths:
            used[n] += count
    assert used == Counter(counts)


# --- pipeline ---


@pytest.fixture(scope="module")
def stages(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], small).cache())
    return out


def test_stages_act_on_what_the_one_before_kept(spark, small, stages):
    docs, calm, single, clean, masked, pieces = stages
    for a, b in zip(stages[:4], stages[1:5], strict=True):
        assert a.columns == b.columns == docs.columns
    assert calm.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in calm.collect()]
    groups = {c for (_, _, c) in brute_components(rows)}
    assert {r.doc_id for r in single.collect()} == groups
    items = [t.split() for t in (" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect())]
    gone = {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()}
    for r in single.collect():
        text = f" {' '.join(re.findall(r'[^\W_]+', r.text.lower()))} "
        if any(f" {' '.join(i)} " in text for i in items):
            assert r.doc_id in gone
    assert masked.count() == clean.count() and not [r for r in masked.collect() if re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", r.text)]
    assert all(r.n_chars == len(r.text) for r in masked.collect())
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in masked.collect()}


def test_stages_bear_odd_rows(spark, small):
    import corpus_pipeline

    rows = [(1, None, None, None, None), (None, "x y", "en", "s", 3), (2, "", "en", "s", 0), (3, "a b c", None, "s", 5), (3, "a b c", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", F.lit(1).alias("score"), F.lit(2).alias("node"), F.lit(3).alias("found"), F.lit("r").alias("predicted"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() >= 3
        assert stage(spark, docs.limit(0), small).count() == 0
