"""Vector codes, spelling variants and packing against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import packing, queries, spelling, vector_codes

# vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """(id, label, vector) rows to {row number: (code, error)} and the codebooks, with Python's integers only."""
    grid = [(key, [math.floor(scale * float(x)) for x in vector]) for key, _, vector in rows]
    w = len(grid[0][1]) // parts
    first = sorted(g for g in grid if g[0] is not None)[:entries]
    book = [[v[p * w : (p + 1) * w] for _, v in first] for p in range(parts)]

    def nearest(part, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book[part]))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in grid:
            for p in range(parts):
                part = v[p * w : (p + 1) * w]
                members[p, nearest(p, part)[1]].append(part)
        for (p, e), all_ in members.items():
            book[p][e] = [sum(c) // len(all_) for c in zip(*all_, strict=True)]
    out = []
    for _, v in grid:
        found = [nearest(p, v[p * w : (p + 1) * w]) for p in range(parts)]
        out.append(("".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return out, book


@pytest.mark.parametrize("dtype", [np.int64, object])
def test_orchard_finds_the_nearest_entry_with_the_lowest_index(dtype):
    rng = np.random.default_rng(3)
    for size, width, reach in [(1, 3, 5), (7, 1, 3), (64, 4, 6), (64, 4, 200), (256, 8, 60)]:
        entries = rng.integers(-reach, reach + 1, (5, size, width))
        entries[:, size // 2] = entries[:, 0]
        points = rng.integers(-reach, reach + 1, (200, 5, width))
        search = vector_codes.Orchard(entries.astype(dtype))
        entry, distance = search.nearest(points.astype(dtype))
        gaps = ((points[:, :, None] - entries[None]) ** 2).sum(-1)
        assert (entry == gaps.argmin(-1)).all() and (distance.astype(np.int64) == gaps.min(-1)).all()
        assert search.computed <= gaps.size
    clustered = (rng.integers(0, 12, (1, 64, 1)) * 1000 + rng.integers(0, 9, (1, 64, 4))).astype(dtype)
    search = vector_codes.Orchard(clustered)
    search.nearest(np.repeat(clustered[0][:, None], 10, axis=0) + 1)
    assert search.computed < 0.4 * 640 * 64


def test_codes_equal_a_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i) if i % 50 else None, ["a", None, "b"][i % 3], [float(x) for x in rng.normal(0, 0.2, 32)]) for i in range(1, 300)]
    rows += [(7, "a", rows[0][2]), (7, "b", [0.5] * 32), (8, "a", [0.5] * 32)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, label string, embedding array<double>, code long").repartition(5)
    books = vector_codes.train(frame, entries=20)
    coded = vector_codes.with_label_errors(vector_codes.encode(frame.withColumnRenamed("code", "place"), books))
    want, book = plain_codes(rows, entries=20)
    got = {r.place: r for r in coded.collect()}
    assert {k: (r.code, r.error) for k, r in got.items()} == dict(enumerate(want))
    assert books.entries == book
    assert books.sha256() == hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    sums = Counter()
    for (_, label, _), (_, error) in zip(rows, want, strict=True):
        sums[label] += error
    assert all(got[i].label_error == sums[rows[i][1]] for i in got)


def test_codes_of_odd_vectors(spark):
    odd = [(1, None), (2, [float("nan")] * 16), (3, [float("inf")] * 16), (4, [1.0] * 15 + [None]), (5, [1.0] * 17), (6, []), (7, [1e300] * 16)]
    good = [(10, [1.0] * 16), (11, [2.0] * 16), (12, [3e9] * 16), (13, [-4e9] * 16)]
    frame = spark.createDataFrame(odd + good, "vec_id long, embedding array<double>")
    books = vector_codes.train(frame, rounds=1, entries=2)
    got = {r.vec_id: (r.code, r.error) for r in vector_codes.encode(frame, books).collect()}
    assert set(got) == {5, 6, 7, 10, 11, 12, 13} and all(got[i] == (None, None) for i in (5, 6, 7))
    means = [(-4 * 10**9 * 256 + 256) // 2, (512 + 3 * 10**9 * 256) // 2]
    assert books.entries == [[[m] for m in means]] * 16
    assert got[10] == ("01" * 16, None) and got[13][0] == "00" * 16
    assert vector_codes.train(frame.where("false")).entries == [[] for _ in range(16)]
    assert vector_codes.encode(frame.where("false"), vector_codes.train(frame.where("false"))).count() == 0
    none = vector_codes.encode(frame.where("vec_id = 10"), vector_codes.train(frame.where("false"))).first()
    assert (none.code, none.error) == (None, None)


def test_code_query_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    got = queries.QUERIES["op11_vector_codes"](spark, small)
    want = con.execute(queries.ORACLES["op11_vector_codes"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


# spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(counts, ratio=2):
    out = {}
    for word, n in counts.items():
        near = [o for o in counts if one_edit(word, o)]
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        out[word] = (len(near), best if best is not None and counts[best] >= ratio * n else None)
    for word in out:
        root = word
        while out[root][1] is not None:
            root = out[root][1]
        out[word] = (*out[word], root)
    return out


@pytest.mark.parametrize("most", [3, 60, 1 << 16])
def test_variants_equal_a_plain_version(spark, most):
    random.seed(most)
    letters = "abéÿ"
    counts = {"".join(random.choice(letters) for _ in range(random.randint(5, 8))): random.randint(1, 60) for _ in range(700)}
    long_ = "x" * 3000
    counts |= {long_: 9, long_ + "x": 4, "y" + long_: 2, long_[:1500] + "z" + long_[1501:]: 1}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r.word: r for r in spelling.group_variants(frame, most=most).collect()}
    want = plain_variants(counts)
    assert {w: (r.n_near, r.form, r.root) for w, r in got.items()} == want
    assert all(r.form_n == (None if r.form is None else counts[r.form]) and r.n == counts[w] for w, r in got.items())
    assert any(w[1] and w[1] != w[2] for w in want.values())
    if most == 3:
        sizes = spelling.groups(frame, most=3).groupBy("key").agg(F.count("*").alias("n"), F.max(F.expr("g.low - g.head - g.tail")).alias("open"))
        assert not sizes.where("n > 3 AND open > 1").count()


def test_variant_query_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(2)
    base = ["kettle", "kettel", "garden", "gardens", "Garden", "été", "hivernal", "Éclair", "éclair", "abc"]
    texts = [(i, " ".join(rng.choice(base) for _ in range(60)) + "," + "7".join(rng.choice(base) for _ in range(40))) for i in range(40)]
    texts += [(3, texts[3][1]), (None, "kettle kettle"), (99, None), (100, ""), (101, "12 ×÷ ...")]
    frame = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, word string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    counts, slips = Counter(), 0
    for key, text in texts:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x7f" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                slips += h % 97 == 0
                at = h % len(run)
                counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
            run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert slips and len(counts) > 6
    got = queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect()
    assert {r.word: (r.n_near, r.form, r.root) for r in got} == plain_variants(counts) and {r.word: r.n for r in got} == counts
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(queries.ORACLES["op12_spelling_variants"])
    told = [d[0] for d in cursor.description]
    assert sorted(tuple(r[c] for c in told) for r in got) == sorted(cursor.fetchall())


def test_variants_of_nothing(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.vocabulary(spelling.runs(spark.createDataFrame([(1, None)], "doc_id long, text string")), "run").count() == 0


# packing


def check_places(places, histogram, capacity):
    """Replays a plan: every piece placed once, sequences filled without gaps and within the capacity."""
    number, fill = Counter(), Counter()
    for p in places:
        assert p.number == number[p.size] and p.count % p.per == 0
        number[p.size] += p.count
        for i in range(p.count // p.per):
            assert fill[p.first + i] == p.offset
            fill[p.first + i] += p.per * p.size
    assert number == Counter(histogram) and all(0 < f <= capacity for f in fill.values())
    return len(fill)


def best_fit_decreasing(histogram, capacity):
    free = Counter()
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            room = min((f for f in free if f >= size and free[f]), default=capacity)
            if free[room]:
                free[room] -= 1
            free[room - size] += 1
    return sum(free.values())


def test_plans_fill_sequences_and_use_few():
    rng = random.Random(1)
    odd = [{}, {1: 5}, {1024: 3}, {513: 7}, {512: 7}, {600: 100, 500: 10, 400: 50}, {400: 99, 300: 101, 300 + 24: 50}]
    for histogram in odd:
        used = check_places(packing.plan(histogram), histogram, 1024)
        assert used >= -(-sum(s * n for s, n in histogram.items()) // 1024)
    assert check_places(packing.plan({512: 7}), {512: 7}, 1024) == 4
    assert check_places(packing.plan({600: 100, 500: 10, 400: 100}), {600: 100, 500: 10, 400: 100}, 1024) == 105
    thirds = {342: 600, 341: 600, 340: 600}
    assert check_places(packing.plan(thirds), thirds, 1024) <= 602
    for _ in range(4):
        histogram = {rng.randint(1, 1024): rng.randint(1, 200) for _ in range(300)}
        used, plain = check_places(packing.plan(histogram), histogram, 1024), best_fit_decreasing(histogram, 1024)
        assert used <= 1.02 * plain + 1


def test_linear_grouping_and_configurations():
    groups = packing.rounded({900: 3, 800: 5, 700: 1, 600: 3}, 4)
    assert [sum(n for _, n in g) for g in groups] == [3, 3, 3, 3] and groups[1] == [(800, 3)] and groups[2] == [(800, 2), (700, 1)] or len(groups) == 3
    assert Counter(s for g in groups for s, n in g for _ in range(n)) == Counter({900: 3, 800: 5, 700: 1, 600: 3})
    sizes, demand = np.array([6, 5, 4]), np.array([10.0, 20.0, 10.0])
    found = packing.configurations(sizes, demand, 10)
    held = sum(used * config for config, used in found)
    assert np.allclose(held, demand) and abs(sum(used for _, used in found) - 20) < 1e-6
    assert all(config @ sizes <= 10 for config, _ in found)


def test_encoder_equals_the_library_on_whole_texts(spark, small):
    file = public_tokenizers.path("byte_bpe_50k.json")
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    texts += ["a  b c  d 　 e f\n g  \t h", "<|endoftext|> x", "'s 'll don't 1 2 a's é è ", "  ", " x", "x ", "á b é ñ ÿ × ÷ x", "!! ? -- a", "ab" * 9000]
    plain = Tokenizer.from_file(file)
    plain.encode_special_tokens = True
    texts += ["a\xa0b \xa0 c", "tail ", " ", "", "x×,÷. 1, é,è. l'été, they'll. we'd) (a)", "ʯ, ɏ, ʿ x ˈ y", "日本 語 a 日"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    coder = packing.Encoder(Tokenizer.from_file(file))
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        ids, bounds = coder.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want


def test_packing_query(spark, tmp_path):
    rng = random.Random(3)
    words = "the cat sat on a mat while rain fell and no one minded très bien".split()
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 30, 400, 900, 1100, 2500])))) for i in range(150)]
    texts += [(500, None), (501, ""), (502, ""), (None, "x y"), (7, texts[7][1]), (7, "other text")] + [(600 + i, "same") for i in range(200)]
    frame = spark.createDataFrame([(*t, i, i) for i, t in enumerate(texts)], "doc_id long, text string, start long, offset long").repartition(6)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for key, text in texts:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        total += len(ids)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[key, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = queries.QUERIES["op13_best_fit_packing"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for held in fill.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(fill) <= -(-total // 1024) * 1.05 + 1
    pieces = packing.pieces(frame.drop("start", "offset"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    made = packing.sequences(packing.pack(pieces, ["doc_id", "piece", "start", "ids"])).collect()
    assert sum(r.length for r in made) == total and all(len(r.ids) == 4 * r.length <= 4096 for r in made)
    assert queries.QUERIES["op13_best_fit_packing"](spark, str(tmp_path)).schema.names[:3] == ["doc_id", "piece", "start"]


def test_packing_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    pieces = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert packing.pack(pieces, ["doc_id", "piece"]).count() == 0
