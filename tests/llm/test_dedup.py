import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.llm import exact_dedup, near_dedup, substring_dedup
from tesserae.llm import text as tx

SCHEMA = "doc_id long, text string"


def words(r, n, m=300):
    return [f"w{r.randint(0, m)}" for _ in range(n)]


# exact


def test_fuse_filter_holds_its_keys_and_few_others():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 30_000):
        keys = r.integers(0, 2**63, n, dtype=np.uint64)
        f = exact_dedup.build_filter(keys)
        assert exact_dedup.in_filter(keys, *f).all()
        assert exact_dedup.in_filter(r.integers(0, 2**63, 20_000, dtype=np.uint64), *f).mean() < 0.01
        assert n < 1000 or len(f[3]) < 1.5 * n


def test_exact_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["", "a", "b", " a", "é" * 9, "x" * 100_000, None, f"t{i}"])) for i in range(300)] + [(None, "a"), (5, "zzz")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit(1)).withColumn("d1", F.lit("clash"))
    best = {}
    for i, t in rows:
        if i is not None and (i not in best or best[i] is None or (t is not None and t < best[i])):
            best[i] = t
    first, want = {}, {}
    for i in sorted(best):
        if best[i] is not None and first.setdefault(best[i], i) != i:
            want[i] = first[best[i]]
    for old, new in (exact_dedup.halves(docs), (docs.limit(0), docs)):
        assert {x["doc_id"]: x["keeper_id"] for x in exact_dedup.exact_duplicates(old, new).collect()} == want
    kept = exact_dedup.keep_first(docs)
    assert {x["doc_id"] for x in kept.collect()} == set(best) - set(want) and kept.columns == docs.columns
    empty = docs.limit(0)
    assert exact_dedup.exact_duplicates(empty, empty).count() == 0 and exact_dedup.keep_first(empty).count() == 0


# near


def near_corpus(r):
    rows, i = [], 0
    for _ in range(25):
        base = words(r, r.choice([40, 150]), 5000)
        for k in range(r.randint(1, 4)):
            w = [x if r.random() > 0.03 * k else f"new{r.randint(0, 9999)}" for x in base]
            rows.append((i, " ".join(w)))
            i += 1
    r.shuffle(rows)
    return rows


def test_components_equal_union_find(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    assert {x["id"]: x["group"] for x in got.collect()} == {x: root(x) for x in up}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_recall_and_precision(spark):
    rows = near_corpus(random.Random(4))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "!!"), (None, rows[0][1])], SCHEMA).withColumn("id", F.lit("x"))
    got = {x["doc_id"]: x["group_id"] for x in near_dedup.near_duplicates(docs).collect()}
    grams = {i: {tuple(t.split()[k : k + near_dedup.SHINGLE]) for k in range(len(t.split()) - near_dedup.SHINGLE + 1)} for i, t in rows}
    similar = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    pairs = [(a, b) for a in grams for b in grams if a < b]
    near = [p for p in pairs if similar(*p) >= 0.6]
    assert len(near) > 15 and sum(a in got and got[a] == got.get(b) for a, b in near) >= 0.9 * len(near)
    assert not [(a, b) for a, b in pairs if a in got and got[a] == got.get(b) and similar(a, b) < 0.05]
    assert not {900, 901, 902} & set(got)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {i for i, _ in rows if got.get(i, i) == i} | {900, 901, 902}


def test_thousands_of_copies_and_chains_are_one_group(spark):
    base = words(random.Random(5), 80, 10_000)
    rows = [(i, " ".join(base)) for i in range(600)]
    chain = list(base)
    for i in range(600, 640):
        chain[i % 80] = f"c{i}"
        rows.append((i, " ".join(chain)))
    assert {x["group_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_bring_every_two_ids_of_a_bucket_together(spark):
    r = random.Random(9)
    rows = [(1, i) for i in range(120)] + [(2, i) for i in range(120)] + [(3, i) for i in range(5)] + [(4, 7)] + [(k, r.randint(0, 300)) for k in range(10, 40) for _ in range(9)]
    rows = sorted(set(rows))
    got = defaultdict(set)
    for x in near_dedup.in_blocks(spark.createDataFrame(rows, "band long, id long"), "band", 16).collect():
        assert x["id"] not in got[x["key"], x["x"], x["y"]]
        got[x["key"], x["x"], x["y"]].add(x["id"])
    want = defaultdict(set)
    for k, i in rows:
        want[k].add(i)
    pairs = lambda sets: {(a, b) for s in sets for a in s for b in s if a < b}
    assert pairs(got.values()) == pairs(want.values())
    assert max(map(len, got.values())) <= 64 and not any(k == 2 for k, *_ in got)


def test_a_band_of_many_documents_is_split(spark):
    n = 100_000
    entries = spark.range(n).selectExpr("id", "5L AS band")
    sizes = near_dedup.in_blocks(entries, "band", near_dedup.BLOCK).groupBy("key", "x", "y").count().agg(F.max("count"), F.count("*"), F.sum("count")).first()
    blocks = -(-n // near_dedup.BLOCK)
    assert sizes[0] <= 2.2 * near_dedup.BLOCK and sizes[1] == blocks * (blocks - 1) // 2 and sizes[2] == n * (blocks - 1)


def test_small_blocks_give_the_same_groups(spark):
    docs = spark.createDataFrame(near_corpus(random.Random(8)), SCHEMA)
    groups = [{x["doc_id"]: x["group_id"] for x in near_dedup.near_duplicates(docs, block=b).collect()} for b in (2, 4096)]
    assert groups[0] == groups[1] and groups[0]


# substrings


def repeats(rows, length, earlier):
    """Spans by brute force: windows of `length` words that stand elsewhere, or before."""
    places = defaultdict(list)
    for i, t in sorted(rows):
        w = t.split()
        for k in range(len(w) - length + 1):
            places[tuple(w[k : k + length])].append((i, k))
    marked = defaultdict(set)
    for at in places.values():
        for n, (i, k) in enumerate(at):
            if len(at) > 1 and (n or not earlier):
                marked[i] |= set(range(k, k + length))
    out = set()
    for i, ws in places_of_runs(marked):
        out.add((i, *ws))
    return out, places


def places_of_runs(marked):
    for i, at in marked.items():
        at = sorted(at)
        start = at[0]
        for a, b in zip(at, [*at[1:], None]):
            if b is None or b != a + 1:
                yield i, (start, a + 1)
                start = b


def substring_corpus(seed, length):
    r = random.Random(seed)
    shared = [words(r, length + r.randint(-3, 30)) for _ in range(6)]
    rows = []
    for i in range(40):
        w = words(r, r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            w += r.choice(shared) + words(r, r.randint(1, 40))
        rows.append((i, " ".join(w)))
    rows += [(40, rows[3][1]), (41, rows[3][1] + " end"), (42, ""), (43, "w1 " * 3 * length), (44, "w1 " * 2 * length)]
    return rows


def test_substrings_equal_brute_force(spark):
    for seed, length, gram, shard, hot in ((1, 20, 5, 200, 10**9), (2, 12, 4, 10_000, 3), (3, 20, 5, 50, 1)):
        rows = substring_corpus(seed, length)
        docs = spark.createDataFrame(rows + [(None, rows[3][1]), (90, None)], SCHEMA).withColumn("start", F.lit("x")).repartition(3)
        for earlier in (False, True):
            got = {(x["doc_id"], x["start_word"], x["end_word"]) for x in substring_dedup.repeated(docs, length, gram, earlier, shard, hot).collect()}
            want, _ = repeats(rows, length, earlier)
            assert got == want, (seed, earlier, got ^ want)


def test_cut_leaves_the_first(spark):
    length = 20
    rows = substring_corpus(1, length)
    docs = spark.createDataFrame([(i, t, len(t), "é") for i, t in rows] + [(90, None, None, None)], SCHEMA + ", n_chars long, lang string")
    out = substring_dedup.cut(docs, length, gram=5)
    assert out.columns == docs.columns
    got = {x["doc_id"]: x for x in out.collect()}
    want, _ = repeats(rows, length, True)
    for i, t in rows:
        w = t.split()
        gone = {k for d, a, b in want if d == i for k in range(a, b)}
        assert got[i]["text"].split() == [x for k, x in enumerate(w) if k not in gone]
        assert got[i]["n_chars"] == len(got[i]["text"]) and (gone or got[i]["text"] == t)
    assert got[90]["text"] is None
    assert substring_dedup.repeated(docs.limit(0)).count() == 0 and substring_dedup.cut(docs.limit(0)).count() == 0


def test_a_phrase_over_and_over_and_columns_that_clash(spark):
    length = 20
    r = random.Random(11)
    rows = [(1, "a " * 3000), (2, "x " + "a b c " * 1000), (3, " ".join(words(r, 30)) + " a" * 21), (4, "a " * 19), (5, "b c a " * 9 + "end"), (6, ""), (7, " a" * 20)]
    docs = spark.createDataFrame(rows + [(None, "a " * 50), (8, None)], SCHEMA)
    for c in ("cuts_", "doc_", "left_", "id_", "row_", "n_", "__row", "__cuts", "__doc", "fp", "start"):
        docs = docs.withColumn(c, F.lit(c))
    docs = docs.unionByName(docs.filter("doc_id in (3, 8)"))
    for earlier in (False, True):
        got = {(x["doc_id"], x["start_word"], x["end_word"]) for x in substring_dedup.repeated(docs, length, 5, earlier).collect()}
        assert got == repeats(rows, length, earlier)[0]
    kept = substring_dedup.cut(docs, length, gram=5)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == list(range(1, 9))
    for keep in (exact_dedup.keep_first, near_dedup.keep_one):
        assert keep(docs).columns == docs.columns and {x["doc_id"] for x in keep(docs).collect()} <= set(range(1, 9))


def test_a_very_long_text(spark):
    r = random.Random(12)
    long = words(r, 150_000, 50_000)
    rows = [(1, " ".join(long)), (2, " ".join(words(r, 100, 50_000) + long[70_000:70_200])), (3, "q " * 200_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(x["doc_id"], x["start_word"], x["end_word"]) for x in substring_dedup.repeated(docs).collect()}
    assert got == {(1, 70_000, 70_200), (2, 100, 300), (3, 0, 200_000)}
    assert near_dedup.near_duplicates(docs).count() == 0


def test_winnowing_picks_in_every_window():
    w = next(tx.slices(pa.array([" ".join(words(random.Random(6), 400))]))).words()
    _, at = substring_dedup.picked(w, 50, 8)
    assert np.diff(np.r_[-1, at, 393]).max() <= 43
