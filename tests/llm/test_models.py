import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.llm import packing, quality, token_counts, toxicity, url_filter
from tesserae.llm import text as tx

DOCS = "doc_id long, text string, lang string, source string"


# token counts


def test_counts_equal_a_unigram_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary()
    model = models.Unigram([("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", -1e9) for i in range(256))], 0, True)
    t = Tokenizer(model)
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    r = random.Random(1)
    rows = ["", "a", "hello world again and again", "naïve 漢字 x", "🙂🙂 ok", "ffff" * 40, "A.B,C 12345"]
    rows += [" ".join("".join(r.choice("etaoinshrdl") for _ in range(r.randint(1, 12))) for _ in range(20)) for _ in range(20)]
    byte = set(f"<0x{i:02X}>" for i in range(256))
    counter = token_counts.Counter(pieces)
    floor = min(s for _, s in pieces) - token_counts.UNKNOWN
    for text in rows:
        for w in text.split():
            ours, best = counter.count(token_counts.MARK + w), plain_best(token_counts.MARK + w, dict(pieces), floor)
            assert ours == best
            if not any(p in byte for p in t.encode(w).tokens) and w.isascii():
                assert ours == len(t.encode(w).tokens)
    docs = spark.createDataFrame(list(enumerate(rows)) + [(None, "a b"), (99, None), (1, "a")], "doc_id long, text string")
    got = sorted((tuple(x) for x in token_counts.token_counts(docs).collect()), key=repr)
    want = sorted(((i, sum(counter.count(token_counts.MARK + w) for w in (s or "").split())) for i, s in [*enumerate(rows), (None, "a b"), (99, None), (1, "a")]), key=repr)
    assert got == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_counts_of_whole_texts_keep_white_space(spark):
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    pieces = token_counts.vocabulary()
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", -1e9) for i in range(256))], 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    r = random.Random(6)
    rows = ["a\nb\n\nc", "a  b", " \n ", " ", "\n", "\t", "a ", " a", "a▁b", "a▁ ▁b", "if x:\n\treturn  1\r\n", "| a |  b |\n|---|\n", "x" + " " * 40 + "y", "\r\r\n\u3000x\xa0y\n"]
    rows += ["".join(r.choice(["the", "tokens", "12", "é", "漢", " ", "  ", "\n", "\n\n", "\t", " \r\n", "    "]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*rows, "", None])), "doc_id long, text string")
    got = dict(token_counts.token_counts(docs).collect())
    floor = min(s for _, s in pieces) - token_counts.UNKNOWN
    for i, text in enumerate(rows):
        assert got[i] == plain_best("▁" + text.replace(" ", "▁"), dict(pieces), floor), text
        assert got[i] == len(t.encode(text).tokens), text
    assert got[len(rows)] == got[len(rows) + 1] == 0
    # no run of marks here, on which merges and the scores of the file differ
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.PIECES)
    assert [got[i] for i in range(2)] == [6, 3] == [len(sp.encode(x)) for x in rows[:2]]


def test_counts_of_pieces_across_spaces_and_newlines():
    import pyarrow as pa

    pieces = [("▁", -2.0), ("a", -2.0), ("b", -2.0), ("a▁b", -1.0), ("\n", -2.0), ("b\n", -1.0)]
    counter = token_counts.Counter(pieces)
    runs, offsets, newlines = token_counts.split(pa.array(["a b\na b", "", None, "\n"]), counter.cuts)
    assert not counter.cuts and runs.to_pylist() == [" a b\na b", " \n"] and offsets.tolist() == [0, 1, 1, 1, 2] and not newlines.any()
    assert counter.counts(runs.to_pylist()).tolist() == [4, 2]


def plain_best(word, pieces, floor):
    """Pieces of the best path, over all starts in order; only a strictly better one replaces."""
    n = len(word)
    best = [None] * (n + 1)
    best[0] = (0.0, 0)
    for end in range(1, n + 1):
        for begin in range(max(0, end - 64), end):
            if best[begin] is None:
                continue
            s = word[begin:end]
            if s in pieces:
                v = (best[begin][0] + pieces[s], best[begin][1] + 1)
            elif end - begin == 1:
                v = (best[begin][0] + floor, best[begin][1] + len(s.encode()))
            else:
                continue
            if best[end] is None or v[0] > best[end][0]:
                best[end] = v
    return best[n][1]


# packing


def brute_pack(sizes, capacity):
    n = max(1, -(-sum(sizes) // capacity))
    bins = [[0.0, capacity] for _ in range(n)]
    out = []
    for s in sizes:
        free = [(c, i) for i, (c, room) in enumerate(bins) if room >= s]
        if free:
            i = min(free)[1]
        else:
            bins.append([0.0, capacity])
            i = len(bins) - 1
        bins[i][0] += packing.LINEAR * s + packing.QUADRATIC * s * s
        bins[i][1] -= s
        out.append(i)
    return out


def test_packing_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0, 1, 5, 100, 4096, 4097, 9000, r.randint(1, 4000)])) for i in range(200)]
    docs = spark.createDataFrame(rows + [(None, 5), (999, None)], "doc_id long, n_tokens long")
    got = packing.packed(docs, group_tokens=10**9).toPandas()
    parts = [(i, p, min(4096, n - 4096 * p)) for i, n in rows for p in range(max(1, -(-n // 4096)))]
    parts.sort(key=lambda x: (-x[2], x[0], x[1]))
    want = dict(zip([p[:2] for p in parts], brute_pack([p[2] for p in parts], 4096)))
    assert dict(zip(zip(got.doc_id, got.part), got.sequence_id)) == want
    assert got.groupby("sequence_id").n_tokens.sum().max() <= 4096
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == dict(rows)
    many = packing.packed(docs, group_tokens=40_000).toPandas()
    assert many.groupby("sequence_id").n_tokens.sum().max() <= 4096 and many.n_tokens.sum() == got.n_tokens.sum() and (many.sequence_id // 2**32).nunique() > 3
    assert packing.packed(docs.limit(0)).count() == 0


def test_packing_of_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b c d"), (2, None), (3, "")], "doc_id long, text string")
    got = packing.pack_documents(docs).toPandas()
    assert sorted(got.doc_id) == [1, 2, 3] and packing.pack_documents(docs.limit(0)).count() == 0


# classifiers


def labelled(n, seed=3):
    r = random.Random(seed)
    good = [f"good{i}" for i in range(300)]
    bad = [f"bad{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        q = int(r.random() < 0.7)
        toxic = int(r.random() < 0.2)
        w = [r.choice(good) for _ in range(60)] if q else [r.choice(bad) + "#@" for _ in range(60)]
        if toxic:
            w[10:12] = ["vile", f"slur{r.randint(0, 3)}"]
        docs.append((i, " ".join(w), r.choice(["en", "de"]), f"s{0 if q else 1}" if r.random() < 0.8 else "s2"))
        if i % 2 == 0:
            labels.append((i, q, toxic))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_quality_on_held_out_documents(spark):
    docs, labels = labelled(600)
    d = spark.createDataFrame(docs + [(700, None, None, None), (701, "", "en", "s0"), (None, "good1 good2", "en", "s0")], DOCS)
    got = quality.scored(d, spark.createDataFrame(labels + [(5000, 1, 0), (None, 1, 1), (2, None, None)], LABELS)).toPandas()
    by = got[got.doc_id.notna()].set_index("doc_id")
    truth = {i: "good" in t for i, t, *_ in docs}
    held = [i for i in truth if i % 2]
    assert np.mean([(by.score[i] > 0.5) == truth[i] for i in held]) > 0.95
    assert by.keep[[i for i in held if truth[i]]].mean() > 0.99
    assert by.score[700] == by.score[701] == 0 and not by.keep[700] and len(got) == 603
    kept = quality.keep_good(d, spark.createDataFrame(labels, LABELS))
    assert kept.columns == d.columns
    none = quality.scored(d, spark.createDataFrame([], LABELS)).toPandas()
    assert set(none.score.round(6)) <= {0.0, 0.5}
    assert quality.scored(d.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def plain_shape(text):
    """The numbers of a text's shape, a byte and a word at a time."""
    raw = text.encode()
    kind = [quality._kinds[c] for c in raw]
    words = [w for w in re.split(rb"[\x09-\x0d\x1c-\x20]", raw) if w]
    n, size = max(len(words), 1), max(len(raw), 1)
    grams = [tuple(words[k : k + 4]) for k in range(max(len(words) - 3, min(len(words), 1)))]
    mean = lambda values: sum(values) / n
    return [
        *(kind.count(k) / size for k in range(quality.KINDS)),
        mean(quality._kinds[w[-1]] == 0 for w in words),
        mean(quality._kinds[w[0]] == 2 and quality._kinds[w[-1]] != 3 for w in words),
        mean(len(w) == 1 for w in words),
        mean(a == b for a, b in zip(words, words[1:])),
        np.log1p(mean(len(w) for w in words)),
        len(set(grams)) / max(len(grams), 1),
        np.log1p(len(raw)) / 10,
        np.log1p(n) / 10,
    ]


def plain_views(text, lang, source):
    """Both views of one document, dense."""
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    view = np.zeros(quality.SHAPE + 1024)
    view[: quality.SHAPE] = plain_shape(text)
    for w in words:
        h = tx.Slice(0, np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])).words(tx.MARKS, True).hash[0]
        view[quality.SHAPE + int(h >> np.uint64(54))] += 1 / len(words)
    view[quality.SHAPE :] **= 0.5
    at = quality.meta_view(pa.array([lang], pa.string()), pa.array([source], pa.string()), np.array([len(text.encode())]))[0]
    meta = np.zeros(1024)
    meta[at] = 1
    return view, meta, at


def plain_co_training(docs, labels, order, rounds):
    """Scores by the definition: each document by itself, and every sure one among the rows that teach the other view."""
    views = {i: plain_views(t, a, b) for i, t, a, b in docs}
    known = [i for i in order if i in labels]
    y = np.array([labels[i] for i in known], float)
    x = [np.array([views[i][k] for i in known]) for k in (0, 1)]
    taught = [[], []]
    for turn in range(rounds + 1):
        m = quality.refit(x, y, taught)
        if turn == rounds:
            break
        before, taught = taught, [[], []]
        for k in (0, 1):
            cells = {}
            for i, v in views.items():
                a, b = m["calibration"][1 - k]
                o = a * (v[1 - k] @ np.array(m["w"][1 - k][:-1]) + m["w"][1 - k][-1]) + b
                if i not in labels and abs(o) > np.log(9):
                    cells.setdefault((tuple(v[2]), o > 0), []).append(v[k])
            # one mean for each metadata and class: cells of several metadata are their weighted means
            for cell, group in gathered(cells).items():
                taught[k].append((int(cell[1]), len(group), np.mean(group, 0)))
            taught[k] = taught[k] or before[k]
    out = {}
    for i, v in views.items():
        total = m["mix"][2]
        for k in (0, 1):
            o = v[k] @ np.array(m["w"][k][:-1]) + m["w"][k][-1]
            total += m["mix"][k] * (m["calibration"][k][0] * o + m["calibration"][k][1])
        out[i] = 1 / (1 + np.exp(-total))
    return out, m


def gathered(cells):
    out = {}
    for (meta, positive), rows in cells.items():
        h = tx.span_hashes(tx.prefix_sums(np.array(meta, np.uint64)), np.array([0]), np.array([6]))[0]
        out.setdefault((int(h % np.uint64(quality.CELLS)), positive), []).extend(rows)
    return dict(sorted(out.items()))


def test_quality_equals_plain_co_training(spark):
    docs, labels = labelled(300, 12)
    docs += [(400, "Good1, good2! " * 400, None, "s0"), (401, "x", "en", None), (402, docs[4][1], "de", "s1")]
    truth = {i: q for i, q, _ in labels if i < 200}
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS size", "2 AS known", "3 AS y", "4 AS __good")
    order = [r["doc_id"] for r in d.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").collect()]
    table = spark.createDataFrame([(i, q, 0) for i, q in truth.items()] + [(4, 1, 0)], LABELS)
    for rounds in (0, 2):
        want, _ = plain_co_training(docs, truth, order, rounds)
        got = {r["doc_id"]: r["score"] for r in quality.scored(d, table, rounds=rounds).collect()}
        assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 5e-3


def test_pseudo_labels_move_the_other_view(spark):
    r = random.Random(13)
    rows, labels = [], []
    for i in range(1200):
        q = i % 2
        word = ("good" if q else "bad") if i < 400 else ("fine" if q else "poor")  # words that no labelled text has
        rows.append((i, " ".join(f"{word}{r.randint(0, 9)}" if r.random() < 0.3 else f"w{r.randint(0, 300)}" for _ in range(60)), "en", f"s{q}"))
        if i < 400:
            labels.append((i, q, 0))
    views = quality.viewed(spark.createDataFrame(rows, DOCS)).cache()
    table = spark.createDataFrame(labels, LABELS)
    before, after = (quality.fit(views, table, rounds=k) for k in (0, 2))
    w = [np.array(m["w"][0]) for m in (before, after)]
    batch = views.filter("doc_id >= 400").toArrow()
    odds = [quality.Views(batch).odds([x, np.zeros(1025)])[0] for x in w]
    truth = np.array(batch.column("doc_id").to_pylist()) % 2 == 1
    right = [np.mean((o > 0) == truth) for o in odds]
    assert right[0] < 0.8 and right[1] > 0.95
    views.unpersist()


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(600, 4)
    d = spark.createDataFrame([x[:2] for x in docs] + [(700, None), (701, "")], "doc_id long, text string")
    got = {x["doc_id"] for x in toxicity.toxic_documents(d, spark.createDataFrame(labels + [(None, 1, 1)], LABELS)).collect()}
    truth = {i for i, t, *_ in docs if "vile" in t}
    held = {i for i, *_ in docs if i % 2}
    assert len(truth & got & held) >= 0.95 * len(truth & held) and len((got - truth) & held) <= 0.02 * len(held)
    assert not {700, 701} & got
    assert toxicity.toxic_documents(d, spark.createDataFrame([], LABELS)).count() == 0
    assert toxicity.toxic_documents(d.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_ftrl_follows_the_formula():
    m = toxicity.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    m.learn(np.array([1, 2]), 1.0)
    g = 0.5 - 1.0
    z = g  # weights were zero
    want = -(z - np.sign(z) * 0.1) / ((1.0 + abs(g)) / 0.5 + 0.2)
    assert np.allclose(m.weights()[[1, 2]], want) and (m.weights()[[0, 3]] == 0).all()


def plain_ftrl(rows, bits, passes, alpha=1.0, beta=1.0, l1=4.0):
    """Weights by FTRL-proximal, a row and a coordinate at a time, over word n-grams and skip-grams."""
    z, n = {}, {}

    def weight(i):
        if i != -1 and abs(z.get(i, 0)) <= l1:
            return 0.0
        v = z.get(i, 0.0)
        return -(v - np.sign(v) * (l1 if i != -1 else 0)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha)

    for _ in range(passes):
        for text, label in rows:
            at = [*plain_coordinates(text, bits), -1]
            w = [weight(i) for i in at]
            g = 1 / (1 + np.exp(-np.clip(sum(w), -35, 35))) - label
            for i, x in zip(at, w):
                s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - s * x
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if i == -1 or weight(i)}


def plain_coordinates(text, bits):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    h = [tx.Slice(0, np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])).words(tx.MARKS, True).hash[0] for w in words]
    out = set()
    for i in range(len(words)):
        for shape, gaps in ((0, ()), (1, (1,)), (2, (1, 2)), (3, (2,))):
            if i + max(gaps, default=0) >= len(words):
                continue
            x = int(h[i])
            for g in gaps:
                x = (x * tx.BASE + int(h[i + g])) % 2**64
            value = x if shape == 0 else int(tx.mixed(np.array([(x + shape) % 2**64], np.uint64))[0])
            out.add(value >> (64 - bits))
    return sorted(out)


def test_toxicity_equals_plain_ftrl(spark):
    docs, labels = labelled(160, 9)
    docs += [(200, docs[2][1], "en", "s0"), (201, "Ünï vile, slur1! " * 300, "en", "s0"), (202, "vile", "en", "s0"), (203, "", "en", "s0")]
    labels += [(200, 1, 0), (201, 0, 1), (202, 1, 1), (203, 1, 0), (2, 1, 0)]
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    d = d.selectExpr("doc_id", "text", "doc_id AS __id", "'x' AS label", "'y' AS toxic")
    truth = {}
    for i, _, t in labels:
        truth[i] = max(t, truth.get(i, 0))
    order = [r["doc_id"] for r in d.filter(F.col("doc_id").isin(*truth)).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    texts = {i: t for i, t, *_ in docs}
    model = plain_ftrl([(texts[i], truth[i]) for i in order], 16, 3)
    want = {}
    for i, t in texts.items():
        c = plain_coordinates(t, 16)
        p = 1 / (1 + np.exp(-sum(model.get(x, 0.0) for x in [*c, -1]))) if c else 0.0
        if p >= toxicity.THRESHOLD:
            want[i] = p
    got = {r["doc_id"]: r["score"] for r in toxicity.toxic_documents(d, spark.createDataFrame(labels, LABELS), bits=16).collect()}
    assert set(got) == set(want) and len(want) > 20 and all(abs(got[i] - want[i]) < 1e-4 for i in want)


# hosts


def brute_hosts(pages, outcomes):
    seen = pd.DataFrame(outcomes, columns=["host", "domain", "suffix", "bad"])

    def strength(g, prior):
        k, n = g.bad, g.n
        v = prior * (1 - prior)
        q = (((k - n * prior) ** 2) / n).sum()
        s = (q - v.sum()) / (v * (n - 1)).sum() if (v * (n - 1)).sum() else 0
        return 1 / min(max(s, 1 / 10001), 0.5) - 1

    def level(keys):
        return seen.groupby(keys, as_index=False).agg(bad=("bad", "sum"), n=("bad", "count"))

    rate = (seen.bad.sum() + 1) / (len(seen) + 2)
    s = level(["suffix"])
    m0 = strength(s, pd.Series(rate, s.index))
    s["mean"] = (s.bad + m0 * rate) / (s.n + m0)
    d = level(["domain", "suffix"]).merge(s[["suffix", "mean"]].rename(columns={"mean": "prior"}))
    m1 = strength(d, d.prior)
    d["mean"] = (d.bad + m1 * d.prior) / (d.n + m1)
    h = level(["host", "domain"]).merge(d[["domain", "mean"]].rename(columns={"mean": "prior"}))
    m2 = strength(h, h.prior)
    out = {}
    for host, domain, suffix in pages:
        r = h[h.host == host]
        k, n = (r.bad.iloc[0], r.n.iloc[0]) if len(r) else (0, 0)
        p = next((t[t[c] == x]["mean"].iloc[0] for t, c, x in ((d, "domain", domain), (s, "suffix", suffix)) if (t[c] == x).any()), rate)
        out[host] = round((k + m2 * p) / (n + m2), 6)
    return out


def test_hosts_equal_brute_force(spark):
    r = random.Random(5)
    hosts = [(f"{a}.{b}", b, b.split(".", 1)[1]) for b in ("x.com", "y.com", "z.co.uk", "w.org") for a in "abc"]
    pages, outcomes, table = [], [], []
    for i in range(300):
        h = r.choice(hosts)
        bad = int(r.random() < (0.6 if h[0].startswith("a") else 0.1))
        table.append((f"https://{h[0]}/p/{i}", bad))
        outcomes.append((*h, bad))
    extra = [("n.x.com", "x.com", "com"), ("q.new.org", "new.org", "org"), ("q.new.net", "new.net", "net")]
    pages = hosts + extra
    df = spark.createDataFrame([(i, f"HTTP://user@{h[0].upper()}:80/x?y") for i, h in enumerate(pages)] + [(98, None), (99, "no url")], "page_id long, url string")
    got = url_filter.scored_urls(df, spark.createDataFrame(table + [(None, 1), ("https://a.x.com/", None)], "url string, bad int")).toPandas().set_index("page_id")
    want = brute_hosts(pages, outcomes)
    assert {got.host[i]: got.bad_rate[i] for i in range(len(pages))} == want
    assert got.host[98] is None and len(got) == len(pages) + 2
    none = url_filter.scored_urls(df, spark.createDataFrame([], "url string, bad int")).toPandas()
    assert len(none) == len(pages) + 2 and set(none.bad_rate) == {0.5}
    assert url_filter.scored_urls(df.limit(0), spark.createDataFrame(table, "url string, bad int")).count() == 0


def test_rules_of_a_suffix_list(spark, tmp_path):
    (tmp_path / "rules").write_text("// remark\ncom\nuk\nco.uk\n*.ck\n!www.ck\na.b.city.jp\n")
    rules = url_filter.read_suffixes(str(tmp_path / "rules"))
    hosts = {"x.y.com": ("y.com", "com"), "com": ("com", "com"), "q.z.co.uk": ("z.co.uk", "co.uk"), "a.uk": ("a.uk", "uk"), "w.v.any.ck": ("v.any.ck", "any.ck"), "x.www.ck": ("www.ck", "ck"), "p.q.a.b.city.jp": ("q.a.b.city.jp", "a.b.city.jp"), "m.unknown": ("m.unknown", "unknown"), "1.2.3.4": ("1.2.3.4", "ip")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r["host"]: (r["d"], r["s"]) for r in df.select("host", *(c.alias(n) for c, n in zip(url_filter.levels(F.col("host"), rules), "ds"))).collect()}
    assert got == hosts


def test_a_host_of_most_pages_is_judged_like_the_others(spark):
    outcomes = spark.createDataFrame([(f"https://h{i % 3}.com/{i}", int(i % 4 == 0)) for i in range(60)], "url string, bad int")
    pages = spark.createDataFrame([(i, "http://h0.com/x") for i in range(3000)] + [(5000 + i, f"http://h{i}.com/") for i in range(1, 5)] + [(6000, None)], "page_id long, url string")
    got = url_filter.scored_urls(pages, outcomes).toPandas().set_index("page_id")
    assert len(got) == 3005 and got.upper[:3000].nunique() == 1
    alone = url_filter.scored_urls(pages.filter("page_id in (7, 5001, 5003)"), outcomes).toPandas().set_index("page_id")
    assert (alone.upper == got.upper[alone.index]).all() and list(alone.n_labelled.sort_index()) == [20, 20, 0]
