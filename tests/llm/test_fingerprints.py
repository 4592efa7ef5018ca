import random

import numpy as np
import pyarrow as pa

from tesserae.llm import fingerprints as fp
from tesserae.llm import text as tx

SCHEMA = "doc_id long, text string"


def plain_signature(data: bytes, k: int) -> str:
    """The definition, a byte at a time."""
    size, window, out, begin = fp.LEAST << k, [0] * fp.WINDOW, [], 0

    def char(a, b):
        v = tx._values[np.frombuffer(data[a:b], np.uint8)]
        h = tx.span_hashes(tx.prefix_sums(v), np.array([0]), np.array([len(v)]))[0]
        return chr(fp.ALPHABET[int(h >> np.uint64(58))])

    for i, c in enumerate(data):
        window = [*window[1:], c]
        h1, h2, h3 = sum(window), 0, 0
        for back, x in enumerate(reversed(window)):
            h2 += (fp.WINDOW - back) * x
            h3 ^= (x << 5 * back) & 0xFFFFFFFF
        if ((h1 + h2 + h3) & 0xFFFFFFFF) % size == size - 1 and len(out) < fp.MOST - 1:
            out.append(char(begin, i + 1))
            begin = i + 1
    if begin < len(data):
        out.append(char(begin, len(data)))
    return "".join(out)


def plain(data: bytes):
    k = 0
    while (fp.LEAST << k) * fp.MOST < len(data):
        k += 1
    ends = lambda k: plain_ends(data, k)
    while k and ends(k) + 1 < fp.HALF:
        k -= 1
    return fp.LEAST << k, plain_signature(data, k), plain_signature(data, k + 1)


def plain_ends(data, k):
    size, window, n = fp.LEAST << k, [0] * fp.WINDOW, 0
    for c in data:
        window = [*window[1:], c]
        h3 = 0
        for back, x in enumerate(reversed(window)):
            h3 ^= (x << 5 * back) & 0xFFFFFFFF
        n += ((sum(window) + sum((i + 1) * x for i, x in enumerate(window)) + h3) & 0xFFFFFFFF) % size == size - 1
    return n


def plain_score(a: str, b: str, block: int) -> int:
    """By the table of edit distances, insertions and deletions alone; 0 without a common run."""

    def dull(s):
        out = []
        for c in s:
            if len(out) < 3 or not (out[-1] == out[-2] == out[-3] == c):
                out.append(c)
        return "".join(out)

    a, b = dull(a), dull(b)
    if not {a[i : i + fp.GRAM] for i in range(len(a) - fp.GRAM + 1)} & {b[i : i + fp.GRAM] for i in range(len(b) - fp.GRAM + 1)}:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    n = len(a) + len(b)
    return min(100 - 100 * row[-1] // n, block // fp.LEAST * min(len(a), len(b)))


def groups(prints: dict[int, tuple], texts: dict[int, str]) -> dict[int, int]:
    """Components by brute force over all pairs; equal texts are alike whatever their length."""
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (bi, *si) in prints.items():
        for j, (bj, *sj) in prints.items():
            if i < j:
                pairs = [(x, y, bx) for bx, x in ((bi, si[0]), (2 * bi, si[1])) for by, y in ((bj, sj[0]), (2 * bj, sj[1])) if bx == by]
                same = texts[i] == texts[j] or any(x == y and len(x) >= fp.GRAM for x, y, _ in pairs)
                if same or any(plain_score(x, y, b) >= fp.ALIKE for x, y, b in pairs):
                    a, z = sorted((root(i), root(j)))
                    up[z] = a
    return {i: root(i) for i in prints}


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 3, 30, 100, 300, 700, 2000)]
    for t in list(texts):
        w = t.split()
        for share in (0.01, 0.05, 0.3):
            texts.append(" ".join(word() if r.random() < share else x for x in w))
        texts.append(t + " " + " ".join(w[: len(w) // 2]))
    return texts + [texts[4]] * 3 + ["", "aaaa" * 100, "aaaa" * 101, "é漢" * 60]


def test_signatures_follow_the_definition():
    texts = corpus()
    out = []
    for s in tx.slices(pa.array(texts), 4000):
        k, (one, two), _ = fp.signatures(s)
        out += zip((fp.LEAST << k).tolist(), one.to_pylist(), two.to_pylist(), strict=True)
    assert out == [plain(t.encode()) for t in texts]


def test_scores_follow_the_table():
    r = random.Random(2)
    alphabet = fp.ALPHABET.tobytes().decode()
    rows = ["".join(r.choice(alphabet[:6]) for _ in range(r.choice([7, 20, 63, 64]))) for _ in range(40)] + ["AAAAAAAAAAA", alphabet]
    codes, sizes = fp.coded(pa.array(rows))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(rows)), np.arange(len(rows))))
    got = fp.scores(codes, sizes, a, b, fp.masks_of(codes), np.full(len(a), 3 << 5))
    for x, y, v in zip(a, b, got, strict=True):
        if want := plain_score(rows[x], rows[y], 3 << 5):
            assert want == v


def test_groups_equal_brute_force(spark):
    rows = list(enumerate(corpus(7)))
    docs = spark.createDataFrame(rows + [(900, None), (None, rows[5][1])], SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in fp.grouped(docs).collect()}
    prints = {i: plain(t.encode()) for i, t in rows}
    want = groups(prints, dict(rows))
    assert {i: got[i]["group_id"] for i, _ in rows} == want
    assert len(set(want.values())) < len(want) - 10
    assert tuple(got[900]) == (900, None, None, None, 900)
    assert set(got) == {900, *range(len(rows))}


def test_repeated_ids_empty_tables_and_clashing_columns(spark):
    t = corpus()[5]
    docs = spark.createDataFrame([(1, t, "x"), (1, "a " + t, "y"), (2, t, None)], SCHEMA + ", signature string")
    got = {r["doc_id"]: r["signature"] for r in fp.grouped(docs).collect()}
    assert got == {1: plain(("a " + t).encode())[1], 2: plain(t.encode())[1]}
    assert fp.grouped(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_blocks_lose_no_link(spark, monkeypatch):
    rows = list(enumerate(corpus(3) + corpus(3)[10:20]))
    monkeypatch.setattr(fp, "BLOCK", 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["group_id"] for r in fp.grouped(docs).collect()}
    assert got == groups({i: plain(t.encode()) for i, t in rows}, dict(rows))


def test_unlike_signatures_of_one_bucket_are_hardly_aligned(monkeypatch):
    """Signatures that share one run only are told apart without aligning them, and not again in another bucket."""
    r, aligned = np.random.default_rng(5), []
    plain = fp.common
    monkeypatch.setattr(fp, "common", lambda codes, sizes, a, b, masks: aligned.append(len(a)) or plain(codes, sizes, a, b, masks))
    letters = [chr(c) for c in fp.ALPHABET]
    signs = ["SHAREDX" + "".join(r.choice(letters, 40)) for _ in range(300)]
    signs += [s[:30] + "+" + s[31:] for s in signs[:20]]
    codes, sizes = fp.coded(pa.array(signs))
    n = len(signs)
    a, b = fp.linked(np.arange(n), codes, sizes, np.zeros(n, int), np.full(n, 3 << 10), fp.ALIKE)
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} >= {(i, 300 + i) for i in range(20)}
    assert sum(aligned) < n * (n - 1) / 2 / 10
    aligned.clear()
    a, b = fp.linked(np.arange(n), codes, sizes, np.zeros(n, int), np.full(n, 3 << 10), fp.ALIKE, np.full(n, 9))
    assert not len(a) and not sum(aligned)
