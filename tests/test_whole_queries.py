"""Queries over whole tables and whole texts, held against rows worked out by hand or by brute force."""

import os
from hashlib import sha256

from conftest import DATA

from tesserae.queries import steps


def written(spark, tmp_path, texts):
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_markdown_of_long_texts_headings_and_fences(spark, tmp_path):
    a, b, x, y, z = " ".join("a" * 600), " ".join("b" * 700), "x" * 300, "y" * 300, "z" * 300
    words = " ".join(["word"] * 60)
    two = ("## Two", 2, f"## Two\n\n```\n# no heading\n```\n{words}")
    d = written(spark, tmp_path, [(1, f"{a}\n\n{b}"), (2, f"{x}\n# Own\n{y}"), (3, f"```\n# code\n{z}"), (4, None), (5, ""), (6, "v" * 5000)])
    want = {
        1: [("# One 1", 1, f"# One 1\n\n{a}"), (None, None, b), two],
        2: [("# One 2", 1, f"# One 2\n\n{x}"), ("# Own", 1, f"# Own\n\n{y}"), two],
        # the second section's fence ends the text's own, which has no end
        3: [("# One 3", 1, f"# One 3\n\n```\n# code\n{z}\n## Two\n```"), ("# no heading", 1, f"# no heading\n\n```\n{words}")],
        # a heading without content keeps the blank line behind it
        5: [("# One 5", 1, f"# One 5\n\n\n\n{two[2]}")],
        6: [("# One 6", 1, "# One 6\n\n" + "v" * 2000), (None, None, "v" * 2000), (None, None, "v" * 1000), two],
    }
    got = {}
    for r in steps.markdown_segments(spark, d).orderBy("source_file", "id").collect():
        got.setdefault(int(r["source_file"].split("/")[0]), []).append((r["heading"], r["heading_level"], r["content"]))
    assert got == want
    assert {int(r["source_file"].split("/")[0]): r["segments"] for r in steps.file_info(spark, d).collect()} == {k: len(v) for k, v in want.items()}


def test_merges_reach_all_ids(spark, tmp_path):
    common = " ".join(f"word{i}" for i in range(40))
    texts = {i: " ".join(f"own{i}x{k}" for k in range(30)) for i in range(1000, 1060)}
    # strong memories of one type, ids 5 apart, that differ by a word
    strong = [i for i in texts if i * 37 % 101 >= 40]
    a, b = next((i, j) for i in strong for j in strong if j > i and (j - i) % 5 == 0)
    texts |= {a: common, b: f"{common} more"}
    d = written(spark, tmp_path, list(texts.items()))
    for name in os.listdir(DATA):
        if name != "documents.parquet":
            os.symlink(f"{DATA}/{name}", f"{d}/{name}")
    strength, alias = {sha256(t.encode()).hexdigest(): i * 37 % 101 / 100 for i, t in texts.items()}, set()
    lost, kept = (sha256(texts[i].encode()).hexdigest() for i in (a, b))
    strength[kept] = 1.0
    if a % 4 == 2:  # it came from a consolidation, so it goes and leaves an alias
        del strength[lost]
        alias.add((lost, kept))
    else:
        strength[lost] = round(strength[lost] * 0.3, 6)
    rows = steps.merges(spark, d).collect()
    assert {r["a"]: r["value"] for r in rows if r["kind"] == "memory"} == strength
    assert {(r["a"], r["b"]) for r in rows if r["kind"] == "alias"} == alias


def test_merges_need_a_strong_source_and_a_target(spark, tmp_path):
    # like pairs of one type by the strengths of their ends: (0.4, 0.45), (0.5, 0.25), (0.5, 0.3)
    by = {round(i * 37 % 101 / 100, 2): i for i in range(1000, 1101)}
    ends = [(by[x], by[y]) for x, y in ((0.4, 0.45), (0.5, 0.25), (0.5, 0.3))]
    # ids of one strength are 101 apart, so one of five of them is of the other end's type
    ends = [(a + 101 * 5 * n, next(j for j in range(b, b + 101 * 5, 101) if (j - a) % 5 == 0)) for n, (a, b) in enumerate(ends)]
    texts = {}
    for n, (a, b) in enumerate(ends):
        common = " ".join(f"word{n}x{i}" for i in range(40))
        texts |= {a: common, b: f"{common} more"}
    d = written(spark, tmp_path, list(texts.items()))
    for name in os.listdir(DATA):
        if name != "documents.parquet":
            os.symlink(f"{DATA}/{name}", f"{d}/{name}")
    rows = steps.merges(spark, d).collect()
    kept = {r["a"] for r in rows if r["kind"] == "memory" and r["value"] == 1.0}
    assert kept == {sha256(texts[ends[2][1]].encode()).hexdigest()}


def test_ids_of_memories_move_no_texts(spark):
    from tesserae.sources import fixtures as fx

    plan = fx.ids(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "hashpartitioning(text" not in plan and "max(text" not in plan


def test_consolidation_and_renames_write_no_contents(spark, monkeypatch):
    from tesserae.operators import dml
    from tesserae.plans import consolidation
    from tesserae.queries import tables
    from tesserae.session import written as plain

    wrote = []
    spy = lambda df, name: wrote.append((name, df.columns)) or plain(df, name)
    monkeypatch.setattr(consolidation, "written", spy)
    monkeypatch.setattr(dml, "written", spy, raising=False)
    assert steps.consolidated(spark, DATA).count() == 1
    assert tables.renames(spark, DATA).count()
    assert "renamed-ids" in {name for name, _ in wrote} and not [x for x in wrote if {"content", "new_content"} & set(x[1])]


def test_a_search_parts_texts_into_tokens_once(spark):
    from tesserae.operators import lexical
    from tesserae.sources import fixtures as fx

    found = lexical.waterfall(lexical.index(fx.memories_with_docs(spark, DATA)), "and the with", 20)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count()
