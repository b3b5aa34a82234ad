"""Jaccard join, embedding dedup, top-k search, mixing, components and the pipeline against plain versions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import embedding_dedup, jaccard_join, mixing, queries, topk_search
from faultline.llm.components import components

DOCS = "doc_id long, text string"


def groups(nodes, links):
    """Smallest reachable node of each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# components


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (205, 203), (203, 205)]
    links += [tuple(map(int, rng.integers(300, 400, 2))) for _ in range(60)]
    want = groups({n for p in links for n in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Jaccard join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain_join(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in groups(sets, links).items()}




def corpus(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(words, 30))
    docs = []
    for size in (5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 40, 90):
        base = list(rng.choice(words, size))
        for k in range(5):
            text = list(base)
            for _ in range(k % 3):
                text[rng.integers(size)] = str(rng.choice(words))
            docs.append(" ".join(text[: size - (k == 4)]))
    docs += [" ".join([*rng.choice(words, int(rng.integers(1, 25))), *passage, *rng.choice(words, int(rng.integers(0, 6)))]) for _ in range(25)]
    docs += ["Same Text here today now", "same  text\there today NOW", "a b", "A B", "a c", "É x", "é x", None, "", " \n", None]
    return [(i + 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("largest", [0, 12])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, largest):
    monkeypatch.setattr(jaccard_join, "boundary", lambda sizes, largest_=None: largest)
    docs = corpus(largest)
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "0 AS n_shingles").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()}
    assert got == plain_join(docs)


def test_jaccard_join_repeated_null_and_no_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = [(7, text), (7, text), (5, text + " more"), (None, text), (9, "one"), (4, "x " * 40_000)]
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.join(spark.createDataFrame(docs, DOCS)).collect())
    assert got == {(7, 5): 2, (5, 5): 1, (None, 5): 1, (9, 9): 1, (4, 4): 1}
    assert jaccard_join.join(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("words", range(7))
def test_slices_of_few_words(words):
    data = np.frombuffer(" ".join("abcdefg"[:words]).encode(), np.uint8)
    packed, sizes = jaccard_join.shingle_sets(data, np.array([0, len(data)]))
    assert sizes.tolist() == [len(shingles(data.tobytes().decode()))] and len(packed) == sizes[0]
    beside = np.frombuffer(data.tobytes() + b" v w x y z", np.uint8)
    both, _ = jaccard_join.shingle_sets(beside, np.array([0, len(data), len(beside)]))
    assert (both[: len(packed)] == packed).all()  # the same as in a slice with more words


def test_jaccard_join_of_short_documents_alone(spark):
    """One document per partition, so that each is a slice of its own."""
    docs = [(4, "two words"), (9, "now three words"), (2, "Two  WORDS"), (6, "now three words"), (8, "one"), (5, "and four words here")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(docs, len(docs)), DOCS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()} == plain_join(docs)


def test_boundary_follows_cost():
    assert jaccard_join.boundary({6: (10, 1_000_000), 12: (10, 20)}) in range(6, 12)
    assert jaccard_join.boundary({}) == 0 and jaccard_join.boundary({10: (10**6, 1)}) < 10
    for n in range(1, 60):
        assert jaccard_join.overlap(n, -(-3 * n // 4)) == -(-3 * n // 4) and jaccard_join.prefix(n) == n - -(-3 * n // 4) + 1


def test_jaccard_query_at_small_scale(spark, small):
    docs = [tuple(r) for r in queries.table(spark, small, "documents").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8(spark, small).collect()} == plain_join(docs)


# Embedding dedup


def plain_dedup(rows):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    unit = {i: ok[i] / np.linalg.norm(ok[i]) for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    count = Counter(x for p in links for x in p)
    return {i: (count[i], c, c == i) for i, c in groups([i for i, _ in rows], links).items()}


def vectors(seed, cells=6, size=40, dims=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(cells):
        center = rng.normal(size=dims)
        out += [center + rng.normal(size=dims) * rng.choice([0.05, 0.2, 0.5]) for _ in range(size)]
    out += list(rng.normal(size=(60, dims)))
    out += [out[0]] * 9 + [2 * out[1]]
    rows = [(i + 1, [float(x) for x in v]) for i, v in enumerate(out)]
    nan, inf = float("nan"), float("inf")
    return [*rows, (5000, None), (5001, [0.0] * dims), (5002, [nan] * dims), (5003, [inf] * dims), (5004, [None] * dims), (5005, []), (5006, [1.0, 2.0]), (5007, [2.0, 4.0])]


def test_dedup_equals_brute_force(spark, monkeypatch):
    for name, value in {"CELL_NODES": 120, "PART_NODES": 70, "QUERY_NODES": 50, "SHARD_NODES": 30}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS kept")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(df).collect()}
    want = plain_dedup(rows)
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and sum(got[i] != want[i] for i in want) <= 3


def test_audit_sees_lost_links(spark):
    """A few pairs beside many lone vectors and a large group: lost pairs lower the recall, and lone vectors alone have none."""
    rng = np.random.default_rng(12)
    lone, group, pairs = rng.normal(size=(2_000, 24)), rng.normal(size=24) + rng.normal(size=(200, 24)) * 0.02, np.repeat(rng.normal(size=(60, 24)), 2, axis=0)
    pairs += rng.normal(size=pairs.shape) * 0.01
    frames, groups = {}, {}
    for name, parts in {"all": (lone, group, pairs), "pairs": (lone, pairs), "lone": (lone,)}.items():
        points = np.concatenate(parts)
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        frames[name] = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(points)], "id long, copies long, v array<double>")
        groups[name] = [(i, int(n) - 1, i) for i, n in enumerate((points @ points.T >= 0.95).sum(axis=1)) if n > 1]
    found = lambda rows: spark.createDataFrame(rows, "id long, links long, root long")
    assert embedding_dedup.audit(frames["lone"], found([]), 24) == (None, 0)
    lost, seen = embedding_dedup.audit(frames["pairs"], found([]), 24)
    assert lost == 0.0 and seen > 50
    assert embedding_dedup.audit(frames["all"], found(groups["all"]), 24)[0] == 1.0
    assert embedding_dedup.audit(frames["all"], found([r for r in groups["all"] if r[1] > 1]), 24)[0] < 0.75


def test_dedup_reports_its_recall(spark):
    rng = np.random.default_rng(13)
    points = np.concatenate([rng.normal(size=(6_000, 32)), rng.normal(size=32) + rng.normal(size=(700, 32)) * 0.05, np.repeat(rng.normal(size=(300, 32)), 2, axis=0)])
    points[-600:] += rng.normal(size=(600, 32)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.dedup(df, with_recall=True).collect()}
    assert min(r.recall for r in got.values()) >= 0.99 and len({r.recall for r in got.values()}) == 1
    for i in range(6_700, 7_300, 2):
        assert got[i].component_id == got[i + 1].component_id == i and got[i].n_links == 1


def test_dedup_without_usable_rows(spark):
    kind = "vec_id long, embedding array<float>"
    got = embedding_dedup.dedup(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], kind)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert embedding_dedup.dedup(spark.createDataFrame([], kind)).count() == 0
    assert embedding_dedup.dedup(spark.createDataFrame([(3, [1.0]), (4, [2.0])], kind)).count() == 2


def test_graph_search_reaches_all():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(700, 12))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    graph = embedding_dedup.FlatGraph.build(points)
    asked = points[:200] + rng.normal(size=(200, 12)) * 0.02
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    want = asked @ points.T >= 0.8
    got = graph.within(asked, np.full(200, -1), 0.8)
    assert (got & want).sum() >= 0.97 * want.sum()


# Top-k search


def _topk_by_hand(data, width, k):
    whole = {i: [int(np.floor(64 * x)) for x in v + [0.0] * (width - len(v))] for i, v in enumerate(data)}
    for q in range(0, len(data), 20):
        yield q, sorted(((-sum(x * y for x, y in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q))[:k]


def _topk(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS shard", "3 AS u")
    got = defaultdict(list)
    for r in topk_search.search(df, df.where("vec_id % 20 = 0"), k=k).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 90)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 11)
    rng = np.random.default_rng(3)
    data = [[float(x) for x in v] for v in np.round(rng.normal(size=(400, 8)) / 3, 1)] + [[0.1] * 8] * 60 + [[0.5] * 3, [0.0] * 8, [3e4] * 8]
    got = _topk(spark, [*enumerate(data), (900, None), (920, [float("nan")] * 8), (940, [None] * 8), (960, []), (None, [1.0] * 8)], 7)
    want = {q: [(k + 1, i, -s) for k, (s, i) in enumerate(best)] for q, best in _topk_by_hand(data, 8, 7)}
    assert got == want


def test_topk_of_large_components(spark, monkeypatch):
    """Scores beyond doubles and beyond long rank like Python integers."""
    monkeypatch.setattr(topk_search, "POSTINGS", 30 * 1024)
    rng = np.random.default_rng(4)
    wide = [[float(x) for x in v] for v in rng.integers(-10_000_000, 10_000_000, (40, 1024))] + [[1e7] * 1024, [1e7] * 1023 + [9_999_999.0]]
    for data in (wide, [[4e6, 1.0], [3e6, 0.0], [5e6, 0.0], [3e6, 0.015625], [1e30, 0.0]]):
        most = (1 << 63) - 1
        want = {q: [(k + 1, i, max(-most - 1, min(most, -s))) for k, (s, i) in enumerate(best)] for q, best in _topk_by_hand(data, len(data[0]), 5)}
        assert _topk(spark, list(enumerate(data)), 5) == want


def test_topk_of_one_vector_repeated(spark, monkeypatch):
    """A third of all rows, their ids too, are one row; each of its queries has its own answer."""
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 6)), 1)] + [(300, [0.5] * 6)] * 100
    got = _topk(spark, rows, 3)
    assert len(got[300]) == 300 and all(len(x) == 3 for q, x in got.items() if q != 300)
    assert {v for _, v, _ in got[300]} <= set(range(1, 201))


def test_topk_sends_no_blocks_through_the_driver(spark, monkeypatch):
    """Blocks of queries, repeated for every shard, must not be taken for a small table."""
    plans, run = [], topk_search._run

    def kept(*given):
        out = run(*given)
        ran = out.groupBy().count()
        ran.collect()
        plans.append(ran._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(topk_search, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk_search, "_run", kept)
    data = np.random.default_rng(5).normal(size=(300, 4)).tolist()
    want = {q: [(k + 1, i, -s) for k, (s, i) in enumerate(best)] for q, best in _topk_by_hand(data, 4, 3)}
    assert _topk(spark, list(enumerate(data)), 3) == want
    assert len(plans) == 2 and not any("BroadcastHashJoin Inner" in p.split("Initial Plan")[0] or re.search(r"BroadcastHashJoin \[shard", p) for p in plans)


def test_topk_proof_stops_before_all_postings():
    """Random unit vectors, the hardest case, and near copies: most postings are never read."""
    rng = np.random.default_rng(6)
    points = rng.normal(size=(8_000, 64))
    points[4_000:] = points[0] + rng.normal(size=(4_000, 64)) / 10
    points = np.floor(64 * points / np.linalg.norm(points, axis=1, keepdims=True))
    for part, most in ((points[:4_000], 0.5), (points, 0.6)):
        index = topk_search.ImpactIndex(np.arange(len(part)), part)
        for q in range(0, 4_000, 200):
            scores = part @ part[q]
            scores[q] = -(2**40)
            at, score = index.search(part[q], q, 20)
            assert at.tolist() == np.lexsort((np.arange(len(part)), -scores))[:20].tolist() and score.tolist() == scores[at].tolist()
        assert index.taken < most * index.postings


def test_topk_few_or_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0]), (1, [1.0])], kind)
    assert [tuple(r) for r in topk_search.search(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 4096)]
    none = spark.createDataFrame([], kind)
    assert topk_search.search(none, none).count() == 0


# Mixing


def test_targets_share_and_stop():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    found = mixing.targets([1000, 10, 10], [1, 2, 3])
    assert found[1:] == [30, 30] and abs(sum(found) - 1020) < 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]


def test_tree_deals_every_block_once():
    quotas = np.array([17, 0, 5, 40])
    dealt = [mixing.split_quotas(quotas, s, 7, 3) for s in range(7)]
    assert (sum(dealt) == quotas).all() and max(x.sum() for x in dealt) - min(x.sum() for x in dealt) <= 1
    assert [x.tolist() for x in dealt] == [mixing.split_quotas(quotas, s, 7, 3).tolist() for s in range(7)]


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, s, int(rng.integers(1, 40))) for i, s in enumerate(rng.choice(["a", "b", "c"], 900, p=[0.8, 0.15, 0.05]).tolist())]
    rows += [(2000, None, 50), (2001, None, 0), (3, rows[3][1], rows[3][2]), (None, "a", 4), (2002, "empty", 0)]
    sizes = spark.createDataFrame(rows, "key long, source string, size long")
    made = mixing.plan(sizes, block_words=300)
    drawn = mixing.draw(sizes, made)
    per = {r.source: r for r in drawn.groupBy("source").agg(F.sum(F.col("size") * F.col("draws")).alias("took"), F.first("target").alias("target"), F.sum("size").alias("words")).collect()}
    assert len(per) == 5 and drawn.count() == len(rows) and drawn.agg(F.max("draws")).first()[0] <= 3
    assert all(abs(r.took - r.target) <= 40 for r in per.values())
    mix = mixing.deal(drawn, made, 6)
    assert mix.count() == drawn.agg(F.sum("draws")).first()[0]
    again = mixing.deal(mixing.draw(sizes, mixing.plan(sizes, block_words=300)), made, 6)
    keys = ["key", "source", "size", "shard", "epoch", "place"]
    assert sorted(map(str, mix.select(keys).collect())) == sorted(map(str, again.select(keys).collect()))
    assert "_block" not in mixing.clean(mix).columns


def test_mix_of_nothing(spark):
    sizes = spark.createDataFrame([], "key long, source string, size long")
    made = mixing.plan(sizes)
    assert mixing.deal(mixing.draw(sizes, made), made, mixing.shard_count(sizes)).count() == 0


def test_mixing_query(spark, small):
    found = queries.op5(spark, small).join(queries.table(spark, small, "documents").select("doc_id", "source", "text"), "doc_id").toPandas()
    words = found.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    assert (words == found["size"]).all() and (found.taken <= 3 * found["size"]).all() and (found.taken % found["size"].clip(lower=1) == 0).all()
    whole = found.groupby("source", dropna=False).agg(took=("taken", "sum"), target=("target", "first"), words=("size", "sum"), size=("source_size", "first"))
    assert (whole.words == whole["size"]).all() and abs(whole.target.sum() - found["size"].sum()) < 1e-3


# Pipeline


def test_pipeline_stages(spark, small):
    docs = queries.table(spark, small, "documents")
    frames, now = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, small)
        frames.append(now.persist())
        now = frames[-1]
    tables = [f.toPandas() for f in frames]
    assert all(list(t.columns) == docs.columns for t in tables[:-1])
    first, found, unique, clean, mixed, tokens = tables
    assert set(found.doc_id) <= set(first.doc_id) and set(found.doc_id) >= set(first[first.text.str.contains("[a-z]{3}", na=False)].doc_id)
    kept = {c for _, c in plain_join(list(zip(found.doc_id, found.text, strict=True))).values()}
    assert set(unique.doc_id) == kept and len(unique) == len(kept)
    assert len(clean) == len(unique) and not clean.text.str.contains(r"password=[0-9a-f]{6}").any()
    changed = clean.merge(unique, on="doc_id")
    assert (changed.text_x.str.len() == changed.n_chars_x)[changed.text_x != changed.text_y].all()
    assert set(mixed.doc_id) <= set(clean.doc_id) and mixed.doc_id.value_counts().max() <= 3
    assert len(tokens) == len(mixed) and tokens.exact.all() and (tokens.n_tokens * 4 == tokens.ids.map(len)).all()


def test_near_duplicates_of_rows_that_share_an_id(spark):
    """Unlinked texts under one id are separate documents, and a near copy of a smaller id's text goes."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, b), (5, c), (5, a + " more"), (5, b + " more"), (5, c), (7, c + " x"), (8, "two words"), (8, "Two words"), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "").collect()
    found = sorted((r.doc_id or 0, r.text[:2]) for r in got)
    assert found == [(0, "a0"), (0, "a0"), (1, "a0"), (5, "b0"), (5, "c0"), (8, "Tw")]
    assert all(len(r.text) == r.n_chars for r in got)


def test_pipeline_on_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words of a text here", "en", "a", 25), (3, "some words of a text here", "en", "a", 25), (None, "other words without an id", "en", None, 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert {r.doc_id for r in docs.collect()} <= {3, None}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def test_pipeline_keeps_columns_named_like_its_results(spark):
    text = "the quick brown fox jumps over the lazy dog and password=abcdef123456 is here for all to see"
    rows = [(i, text + f" number {i} " + " ".join(f"w{i}x{j}" for j in range(60)), "en", "s", 1, 0.25, "mine", "own", 7, 9.5) for i in range(30)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, secrets string, draws int, target double"
    docs = spark.createDataFrame(rows, names)
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns
    got = now.collect()
    assert got and all((r.score, r.lang_pred, r.secrets, r.draws, r.target) == (0.25, "mine", "own", 7, 9.5) for r in got)
    assert all("abcdef123456" not in r.text and r.n_chars == len(r.text) for r in got)


def test_mixing_replaces_columns_named_like_those_added(spark):
    rows = [(i, "ab"[i % 2], 10 + i) for i in range(50)]
    sizes = spark.createDataFrame(rows, "key long, source string, size long")
    made = mixing.plan(sizes)
    want = sorted(tuple(r) for r in mixing.draw(sizes, made).select("key", "source_size", "target", "draws").collect())
    clash = sizes.selectExpr("*", "1 AS source_size", "'x' AS target", "2 AS draws", "3 AS _s", "4 AS _block", "5 AS shard", "6 AS epoch", "7 AS place")
    drawn = mixing.draw(clash, made)
    assert sorted(tuple(r) for r in drawn.select("key", "source_size", "target", "draws").collect()) == want
    assert mixing.deal(drawn, made, 2).count() == sum(r[3] for r in want)
