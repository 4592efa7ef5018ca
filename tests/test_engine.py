"""The engine's numbers on small stores."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.operators import dml, exchanges, graph, lexical, merging, provenance, retrieval, scans, similarity
from tesserae.plans import consolidation, context
from tesserae.sources import markdown, retrieval_log, sessions, snapshot, store as st

T0 = dt.datetime(2026, 3, 1)


def now():
    return F.lit("2026-04-07 03:00:00").cast("timestamp")


def memory(id, content=None, type="fact", strength=1.0, state="none", anchor=None, source="agent_tool", consolidated=False, created=T0):
    return (id, type, content or id, state, anchor, created, float(strength), source, consolidated)


def make(spark, memories=(), edges=(), exposures=(), attributions=(), aliases=()):
    frames = {
        "memories": list(memories),
        "associations": [(a, b, float(w), T0, None) for a, b, w in edges],
        "exposures": [(s, t, m, mode, None, r, None, T0) for s, t, m, mode, r in exposures],
        "attributions": [(g, m, e, float(c), t, T0, None, False) for g, m, e, c, t in attributions],
        "aliases": [(a, b, "merged", T0) for a, b in aliases],
    }
    return st.empty(spark, **{k: spark.createDataFrame(v, S.struct(k)) for k, v in frames.items()})


def strengths(store):
    return {r["id"]: round(r["strength"], 6) for r in store.memories.collect()}


def weights(edges):
    return {(r["memory_a"], r["memory_b"]): round(r["weight"], 6) for r in edges.collect()}


def test_two_turns_of_one_channel_make_0_0975(spark):
    x = [("s", t, m, "auto_injected", "hybrid") for t in ("t1", "t2") for m in "ab"]
    s = make(spark, [memory("a"), memory("b")], exposures=x)
    assert weights(graph.with_co_retrievals(s.associations, s.exposures, s.memories, now())) == {("a", "b"): 0.0975}
    x[-1] = ("s", "t2", "b", "tool_get", None)
    s = make(spark, [memory("a"), memory("b")], exposures=x)
    assert weights(graph.with_co_retrievals(s.associations, s.exposures, s.memories, now())) == {("a", "b"): round(1 - 0.95 * 0.85, 6)}


def test_transitive(spark):
    s = make(spark, [memory(x) for x in "abc"], [("a", "b", 0.5), ("b", "c", 0.5)])
    assert weights(graph.transitive(s.associations)) == {("a", "c"): 0.25}
    assert weights(graph.transitive_in_order(s.memories, s.associations))[("a", "c")] == 0.25
    s = make(spark, [memory(x) for x in "abc"], [("a", "b", 0.2), ("b", "c", 0.3)])
    assert weights(graph.transitive(s.associations)) == {}


def test_decay_and_catch_up(spark):
    s = make(spark, [memory("w"), memory("c", consolidated=True)], [("c", "w", 1.0)])
    out = consolidation.decayed(s)
    assert strengths(out) == {"w": 0.906, "c": 0.977}
    assert weights(out.associations) == {("c", "w"): 0.9}
    last = F.lit("2026-04-03 03:00:00").cast("timestamp")  # 4 days: 3 cycles
    assert strengths(consolidation.caught_up(s, now(), last)) == {"w": round(0.906**3, 6), "c": round(0.977**3, 6)}
    assert strengths(consolidation.caught_up(s, now(), None)) == {"w": 1.0, "c": 1.0}


@pytest.mark.parametrize(("mode", "confidence", "want"), [("hybrid", 0.3, 0.71), ("bm25_only", 0.3, 0.605), ("hybrid", -0.5, 0.15)])
def test_reinforcement(spark, mode, confidence, want):
    s = make(spark, [memory("m", strength=0.5)], exposures=[("s", "t", "m", "auto_injected", mode)], attributions=[("g", "m", "auto_injected", confidence, "t"), ("g2", "gone", "tool_get", 0.6, "t")])
    out = provenance.reinforced(s)
    assert strengths(out) == {"m": want}
    assert scans.unreinforced(out.attributions).count() == 0
    assert strengths(provenance.reinforced(out)) == {"m": want}


def test_attribution_policy_is_the_sequential_one(spark):
    import random

    r = random.Random(4)
    kinds = ["auto_injected", "tool_search_returned", "tool_get", "agent_feedback_positive", "agent_feedback_negative"]
    rows = [("g", f"m{r.randint(0, 40)}", r.choice(kinds), r.choice([-0.5, 0.1, 0.3, 0.3, 0.6]), f"t{i}", T0 + dt.timedelta(minutes=r.randint(0, 99)), i) for i in range(300)]
    want = {}
    for g, m, e, c, t, at, _ in rows:
        if m not in want:
            want[m] = [e, c, t, at, None]
            continue
        was, new = want[m], e.startswith("agent")
        old = was[0].startswith("agent")
        if (new and not old) or (new == old and c > was[1]):
            was[0], was[1], was[4] = e, c, at
        was[3] = min(was[3], at)
    df = spark.createDataFrame(rows, "message_id string, memory_id string, evidence string, confidence double, turn_id string, created_at timestamp, seq long")
    got = {x["memory_id"]: [x["evidence"], x["confidence"], x["turn_id"], x["created_at"], x["updated_at"]] for x in dml.merged_attributions(df).collect()}
    assert got == want
    half = dml.attributions_upserted(make(spark).attributions, df.filter("seq < 150"))
    both = dml.attributions_upserted(half, df.filter("seq >= 150"))
    assert {x["memory_id"]: [x["evidence"], x["confidence"], x["turn_id"], x["created_at"], x["updated_at"]] for x in both.collect()} == want


def test_merge_outcomes(spark):
    s = make(spark, [memory("a" * 64, "short", strength=0.8), memory("b" * 64, "longer text", strength=0.6), memory("c" * 64, source="consolidation", strength=0.5), memory("d" * 64), memory("x" * 64)], [("a" * 64, "x" * 64, 0.5), ("b" * 64, "x" * 64, 0.3), ("c" * 64, "x" * 64, 0.9)])
    out, done = merging.merged(s, [("a" * 64, "b" * 64), ("b" * 64, "d" * 64), ("c" * 64, "d" * 64)], lambda a, b: ("both of " + a["id"][:1], "fact"), now())
    got = strengths(out)
    assert [m.outcome for m in done] == ["new", "new"]
    assert (got["a" * 64], got["b" * 64]) == (0.24, 0.18)
    assert "c" * 64 not in got and {r["old_id"] for r in out.aliases.collect()} == {"c" * 64}
    new = done[0].new_id
    assert weights(out.associations)[tuple(sorted((new, "x" * 64)))] == 0.65
    # what was deleted has no edges left to hand on
    assert tuple(sorted((done[1].new_id, "x" * 64))) not in weights(out.associations)


def test_pruning_keeps_attributions(spark):
    s = make(spark, [memory("a", strength=0.05), memory("b", strength=0.051)], [("a", "b", 0.5)], [("s", "t", "a", "tool_get", None)], [("g", "a", "tool_get", 0.6, "t")])
    out = consolidation.pruned(s)
    assert set(strengths(out)) == {"b"}
    assert (out.associations.count(), out.exposures.count(), out.attributions.count()) == (0, 0, 1)


def test_a_week(spark):
    day = dt.datetime(2026, 4, 6, 10)
    s = make(spark, [memory("aaaa", "likes green tea", strength=0.9, created=day), memory("bbbb", "uses postgres", strength=0.8, created=day), memory("cccc", "weak", strength=0.03, created=day), memory("dddd", "trip to Helsinki in June with the family", state="future", anchor=dt.datetime(2026, 4, 1), created=day)], exposures=[("s", "t1", "aaaa", "auto_injected", "hybrid"), ("s", "t1", "bbbb", "auto_injected", "hybrid")], attributions=[("g", "aaaa", "tool_get", 0.6, "t1")])
    out, n = consolidation.consolidated(s, now())
    assert (n.reinforced, n.decayed, n.pruned, n.transitioned, n.exposures_gc) == (1, 4, 1, 1, 2)
    got = strengths(out)
    assert got["aaaa"] == 0.906 and set(got) == {"aaaa", "bbbb", "dddd"}
    assert weights(out.associations) == {("aaaa", "bbbb"): 0.05}
    assert {r["temporal_state"] for r in out.memories.filter("id = 'dddd'").collect()} == {"present"}
    assert scans.state_value(out.state, "last_consolidation_at") == "2026-04-07T03:00:00.000Z"
    assert "reinforced 1" in consolidation.notification(n, 5, "detailed") and consolidation.notification(n, 5, "errors") is None


def test_a_failing_merge_closes_the_run(spark):
    twin = "the very same words stand here and there in order"
    s = make(spark, [memory("a" * 64, twin, created=dt.datetime(2026, 4, 6)), memory("b" * 64, twin + " ", created=dt.datetime(2026, 4, 6))])

    def fail(a, b):
        raise ValueError("no model")

    with pytest.raises(consolidation.MergeFailed) as e:
        consolidation.consolidated(s, now(), fail)
    assert scans.state_value(e.value.store.state, "last_consolidation_at") is not None


def test_search_against_sqlite(spark):
    import random
    import sqlite3

    r = random.Random(1)
    rows = [memory(f"{i:04d}", " ".join(r.choice("alpha beta gamma delta café naïve über x1".split()) for _ in range(r.randint(1, 12))), r.choice(["fact", "beta plan"])) for i in range(80)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, content, type, tokenize=\"unicode61 remove_diacritics 2\")")
    db.executemany("insert into f values (?, ?, ?)", [(m[0], m[2], m[1]) for m in rows])
    ix = lexical.index(spark.createDataFrame(rows, S.struct("memories")))
    for q, fts in (("beta", '"beta"'), ("cafe", '"cafe"'), ("Über", '"Über"')):
        want = {i: round(-v, 9) for i, v in db.execute("select id, bm25(f, 0, 1.0, 0.5) from f where f match ?", (fts,))}
        got = {x["id"]: round(x["bm25"], 9) for x in lexical.waterfall(ix, q, 1000).collect()}
        assert got == want
    phrase = {i: round(-v, 9) for i, v in db.execute("select id, bm25(f, 0, 1.0, 0.5) from f where f match ?", ('"alpha beta"',))}
    anyone = {i: round(-v, 9) for i, v in db.execute("select id, bm25(f, 0, 1.0, 0.5) from f where f match ?", ('"alpha" OR "beta"',))}
    got = lexical.waterfall(ix, "alpha, beta!", 1000).collect()
    assert {x["id"]: round(x["bm25"], 9) for x in got if x["pass"] == 0} == phrase
    assert {x["id"] for x in got} == set(anyone)
    assert all(round(x["bm25"], 9) == anyone[x["id"]] for x in got if x["pass"] > 0)
    assert lexical.waterfall(ix, "?!", 5) is None
    prefix = {i for (i,) in db.execute("select id from f where f match 'gam*'")}
    assert {x["id"] for x in lexical.search_rows(spark.createDataFrame(rows, S.struct("memories")), "gam*", 100).collect()} == prefix


def test_recall_follows_edges(spark):
    s = make(spark, [memory("a", "green tea is best", created=dt.datetime(2026, 4, 7)), memory("b", "unrelated note"), memory("c", "weak one", strength=0.05)] + [memory(f"f{i}", f"filler {i}") for i in range(20)], [("a", "b", 0.5), ("a", "c", 0.9)])
    s = s.with_(embeddings=spark.createDataFrame([("a", [1.0, 0.0])], S.struct("embeddings")))
    got = {r["id"]: round(r["score"], 6) for r in retrieval.recall(s, "green tea", 2, now(), [1.0, 0.0]).collect()}
    direct = retrieval.search(s, "green tea", 2, now(), [1.0, 0.0]).collect()
    assert [r["id"] for r in direct] == ["a"]
    assert set(got) == {"a", "b"} and got["b"] == round(direct[0]["score"] * 0.5 * 0.6, 6)


def test_browse_choice():
    rows = [("fact", "a" * 50), ("fact", "a" * 50 + "b"), ("fact", "c"), ("fact", "d"), ("plan", "e"), ("fact", "f")]
    assert retrieval.selected(rows, 3) == [0, 2, 4]
    assert retrieval.selected(rows, 5) == [0, 2, 4, 3, 5]
    assert retrieval.selected([], 3) == []


def test_features_and_candidates(spark):
    from tesserae.functions import text as tx

    one = spark.createDataFrame([("the quick brown fox",), ("",), ("Two words",)], "c string").select("c", tx.features(F.col("c")).alias("f")).collect()
    assert {r["c"]: set(r["f"]) for r in one} == {"the quick brown fox": {"the", "quick", "brown", "fox", "brown quick the", "brown fox quick"}, "": set(), "Two words": {"two", "words"}}
    m = spark.createDataFrame([memory("a", "we went to Helsinki in the summer of 2024"), memory("b", "we went through Helsinki in the summer of 2024"), memory("c", "we went to Helsinki in the summer of 2024", "plan"), memory("d", "?"), memory("e", "!")], S.struct("memories"))
    none = spark.createDataFrame([], S.struct("embeddings"))
    got = {(r["a"], r["b"]): round(r["score"], 3) for r in similarity.merge_candidates(similarity.prepared(m, none)).collect()}
    assert got == {("a", "b"): 0.6, ("d", "e"): 1.0}
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1])], S.struct("embeddings"))
    p = similarity.prepared(m, vec)
    assert ("a", "b") in {(r["a"], r["b"]) for r in similarity.merge_candidates(p).collect()}
    assert {(r["a"], r["b"]) for r in similarity.merge_candidates_between(p, p).collect()} == {("a", "b"), ("d", "e")}


def test_aliases_and_rename(spark):
    s = make(spark, aliases=[("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")])
    assert {(r[0], r[1]) for r in scans.resolved_aliases(s.aliases).collect()} == {("a", "c"), ("b", "c"), ("x", "y"), ("y", "x")}
    s = make(spark, [memory("a"), memory("b")], [("a", "b", 0.3)], [("s", "t", "a", "tool_get", None)], [("g", "a", "tool_get", 0.6, "t")])
    out = dml.renamed(s, spark.createDataFrame([("a", "new text")], "old_id string, new_content string"))
    from hashlib import sha256

    new = sha256(b"new text").hexdigest()
    assert set(strengths(out)) == {new, "b"} and set(weights(out.associations)) == {tuple(sorted((new, "b")))}
    assert [r["memory_id"] for r in out.exposures.collect()] == [r["memory_id"] for r in out.attributions.collect()] == [new]


def test_store_versions_and_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert st.read(spark, root).memories.count() == 0
    s = make(spark, [memory("a"), memory("b")], [("a", "b", 0.25)], [("s", "t", "a", "tool_get", None)], [("g", "a", "tool_get", 0.6, "t")], [("o", "a")])
    st.write(s, root)
    again = st.write(st.read(spark, root), root)
    assert st.vacuum(spark, root) == 1 and st.read(spark, root).memories.count() == 2
    text = snapshot.document(again, "2026-04-07T00:00:00Z")
    new = snapshot.loaded(spark, text, now())
    out, n = snapshot.imported(make(spark, [memory("b", "other")]), new, now())
    assert n.first().asDict() == {"memories": 1, "memories_skipped": 1, "associations": 1, "attributions": 1, "exposures": 1, "aliases": 1, "state": 0}
    assert set(strengths(out)) == {"a", "b"} and weights(out.associations) == {("a", "b"): 0.25}
    with pytest.raises(ValueError):
        snapshot.loaded(spark, '{"version": 3}', now())
    snapshot.export(again, f"{root}-json")
    assert snapshot.read(spark, f"{root}-json", now()).memories.count() == 2


def test_log_round_trip(spark, tmp_path):
    rows = [("2026-01-01T00:00:00.000Z", "feedback", ["a", "b"], {"a": 5, "b": 2}, 'so "good"', None), ("2026-01-01T00:00:01.000Z", "store", ["n"], None, None, ["x", "y"]), ("2026-01-01T00:00:02.000Z", "search", ["q", "r"], None, None, None), ("2026-01-01T00:00:03.000Z", "recall", [], None, None, None)]
    df = spark.createDataFrame(rows, "timestamp string, event string, ids array<string>, ratings map<string,int>, comment string, context_ids array<string>")
    retrieval_log.append(df, f"file://{tmp_path}/log")
    got = retrieval_log.read(spark, f"file://{tmp_path}/log").orderBy("timestamp").collect()
    assert [tuple(r) for r in got] == rows[:3]
    assert retrieval_log.read(spark, f"file://{tmp_path}/none").count() == 0
    assert retrieval_log.parsed(spark.createDataFrame([("broken",), ("",)], "value string")).count() == 0


def test_markdown():
    text = "---\nt: 1\n---\nintro " + "x" * 300 + "\n# One #\n" + "a" * 250 + "\n```\n## no\n```\n## Two\nshort\n### Three\nend"
    got = markdown.segments(text)
    assert [g[:2] for g in got] == [(None, None), ("# One", 1), ("## Two", 2)]
    assert got[2][2] == "## Two\n\nshort\n\n### Three\n\nend"
    assert markdown.segments("") == markdown.segments("---\na\n---\n") == []
    long = markdown.segments("# H\n" + "word " * 1000)
    assert len(long) == 3 and all(len(c) <= 2000 + len("# H\n\n") for _, _, c in long) and [h for h, _, _ in long] == ["# H", None, None]


def test_discovery(spark, tmp_path):
    (tmp_path / "memory/sub").mkdir(parents=True)
    for name in ("MEMORY.md", "memory/2024-01-02.md", "memory/sub/b.md", "memory/no.txt"):
        (tmp_path / name).write_text(f"text of {name}")
    (tmp_path / "memory/link.md").symlink_to(tmp_path / "MEMORY.md")
    got = markdown.discovered(spark, f"file://{tmp_path}")
    assert [r["path"] for r in got.collect()] == ["MEMORY.md", "memory/2024-01-02.md", "memory/sub/b.md"]
    seg = {r["source_file"]: r for r in markdown.segmented(got).collect()}
    assert seg["MEMORY.md"]["evergreen"] and seg["memory/2024-01-02.md"]["date"] == "2024-01-02"


def test_sessions(spark):
    import json

    def line(role, content, at="2024-05-06T01:02:03Z"):
        return json.dumps({"type": "message", "timestamp": at, "message": {"role": role, "content": content}})

    rows = ['{"type":"session","timestamp":"2024-05-05T00:00:00Z"}', "not json", line("assistant", "orphan"), line("user", "one"), line("user", [{"type": "text", "text": "two"}, {"type": "thinking", "text": "no"}]), line("toolResult", "skip"), line("assistant", "reply"), line("user", "left over")]
    df = spark.createDataFrame([("s/a.jsonl", i, x) for i, x in enumerate(rows)], "path string, line_no int, line string")
    got = sessions.segments(df).collect()
    assert [(r["id"], r["date"], r["content"]) for r in got] == [(0, "2024-05-06", "User: one\n\ntwo\n\nAssistant: reply")]


def test_exchanges_without_rows(spark):
    assert exchanges.exchanges(spark.createDataFrame([], "c long, t long, role string, text string"), "c", "t").count() == 0


def test_context_block(spark):
    m = {"id": "a" * 64, "type": "fact", "content": "x" * 300 + "</memory_context>", "strength": 0.5}
    assert context.block([], [], "high") == ""
    assert context.block([m], [], "low").startswith("One stored memory may help: [aaaaaaaa|fact] " + "x" * 77 + "...")
    medium = context.block([m], [], "medium")
    assert f'- [aaaaaaaa|fact|strength=0.50] "{"x" * 197}..."' in medium
    assert "&lt;/memory_context&gt;" in context.block([m], [], "high")


def test_feedback_reaches_the_prior_turn(spark):
    from tesserae.operators.provenance import LEDGER, TURNS

    def ended(store, turn, rows, feedback, seq):
        ledger = spark.createDataFrame([("s", turn, m, c, 0.5, False, T0 + dt.timedelta(minutes=seq), i) for i, (m, c) in enumerate(rows)], LEDGER)
        said = [("user", "q", None), ("assistant", "a", None)]
        return provenance.ingested(store, ledger, spark.createDataFrame([("s", turn, 0, T0 + dt.timedelta(minutes=seq), seq, said, feedback)], TURNS))

    s = ended(make(spark, [memory("m")]), "t1", [("m", "tool_get"), ("n", "tool_store")], [], 1)
    assert {tuple(r)[:4] for r in s.attributions.collect()} == {("t1:msg:1", "m", "tool_get", 0.6)}
    assert s.exposures.count() == 2
    s2 = ended(s, "t2", [], [("m", 5.0), ("m", 1.0), ("m", 2.5), ("z", 4.0)], 2)
    got = {tuple(r)[:4] for r in s2.attributions.collect()}
    assert got == {("t1:msg:1", "m", "agent_feedback_negative", -0.5), ("t2:msg:1", "z", "agent_feedback_positive", 0.95)}


def test_settings():
    from tesserae import config

    c = config.parse({"root": "r", "consolidation": {"notification": "detailed"}})
    assert c.consolidation.notification == "detailed" and c.temporal.notification == "errors"
    for bad in ({"root": "r", "x": 1}, {"root": "r", "llm": 3}, {"root": "r", "temporal": {"notification": "loud"}}):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_breaker():
    from tesserae.api import Breaker, BreakerOpen

    now = [0.0]

    def fail(text):
        raise OSError

    b = Breaker(fail, clock=lambda: now[0], jitter=0)
    for kind in (OSError, OSError, BreakerOpen):
        with pytest.raises(kind):
            b("x")
    now[0] = 31
    b.embed = lambda t: [1.0]
    assert b("x") == [1.0] and b.failures == 0


def test_engine(spark, tmp_path):
    from tesserae.api import Engine, reconciled
    from tesserae.config import Config

    e = Engine(spark, Config(f"file://{tmp_path}/s"), clock=lambda: dt.datetime(2026, 4, 7, tzinfo=dt.timezone.utc))
    id = e.store_memory("green tea is what they drink")
    assert e.store_memory("green tea is what they drink") == id
    e.store_memory("the database runs on postgres")
    assert [r["id"] for r in e.search("green tea").collect()] == [id]
    assert e.get(id[:8]).first()["content"] == "green tea is what they drink"
    assert e.browse(5).count() == 2 and e.stats().first()["total"] == 2
    assert "green tea" in e.assemble("green tea")
    e.sleep()
    assert e.stats().first()["last_consolidation_at"] is not None
    assert retrieval_log.read(spark, e.log_path).filter("event = 'store'").count() == 3
    jobs = spark.createDataFrame([("1", "n", "tag d", "0 3", "x", True, 5), ("2", "n", "tag d", "0 4", "x", True, 2)], "id string, name string, description string, expr string, text string, enabled boolean, created_at_ms long")
    wanted = spark.createDataFrame([("tag", "n", "tag d", "0 3", "x", True), ("tig", "o", "tig d", "0 3", "y", True)], "tag string, name string, description string, expr string, text string, enabled boolean")
    assert {tuple(r) for r in reconciled(jobs, wanted).collect()} == {("update", "2", "n"), ("remove", "1", "n"), ("add", None, "o")}


def test_stream(spark, tmp_path):
    import json

    from tesserae.streaming import ingest

    folder = tmp_path / "in"
    folder.mkdir()
    event = {"session_id": "s", "turn_id": "t", "prior_messages": 0, "created_at": "2026-04-06T00:00:00Z", "seq": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "feedback": [], "ledger": [{"memory_id": "m", "channel": "tool_get", "seq": 1}]}
    root = f"file://{tmp_path}/store"
    for n in range(2):  # the same turn comes twice
        (folder / f"{n}.json").write_text(json.dumps(event))
        ingest.start(spark, f"file://{folder}", root, f"file://{tmp_path}/ck").awaitTermination(120)
    s = st.read(spark, root)
    assert (s.exposures.count(), s.attributions.count()) == (1, 1)


def test_two_writers(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    st.write(make(spark, [memory("a")]), root)
    one, two = st.read(spark, root), st.read(spark, root)
    st.write(one.with_(memories=one.memories.unionByName(make(spark, [memory("b")]).memories)), root)
    with pytest.raises(st.Conflict):
        st.write(two, root)
    assert set(strengths(st.read(spark, root))) == {"a", "b"}
    calls = []

    def change(store):
        if not calls:  # another writer comes first
            st.write(st.read(spark, root).with_(memories=make(spark, [memory("c")]).memories.unionByName(store.memories)), root)
        calls.append(1)
        return store.with_(memories=store.memories.unionByName(make(spark, [memory("d")]).memories))

    assert set(strengths(st.changed(spark, root, change))) == {"a", "b", "c", "d"} and len(calls) == 2
    assert st.vacuum(spark, root) == 3 and st.read(spark, root).memories.count() == 4


def test_breaker_times_out_and_probes_once():
    import threading

    from tesserae.api import Breaker, BreakerOpen, EmbeddingTimeout

    now, go, late, states = [0.0], threading.Event(), [], []
    b = Breaker(lambda t: go.wait(20) and [2.0], threshold=1, clock=lambda: now[0], timeout=0.05, jitter=0, on_late=lambda *x: late.append(x), on_change=lambda *x: states.append(x))
    with pytest.raises(EmbeddingTimeout):
        b("x")
    assert b.state == "open"
    go.set()
    for _ in range(200):
        if late:
            break
        threading.Event().wait(0.01)
    assert late == [("done", None)]
    now[0], inside, leave = 31.0, threading.Event(), threading.Event()

    def slow(text):
        inside.set()
        leave.wait(20)
        return [1.0]

    b.embed, b.timeout, got = slow, 20, []
    probe = threading.Thread(target=lambda: got.append(b("x")))
    probe.start()
    inside.wait(20)
    with pytest.raises(BreakerOpen):
        b("y")
    leave.set()
    probe.join(20)
    assert got == [[1.0]] and b.state == "closed" and states == [("closed", "open"), ("open", "closed")]
    with pytest.raises(ValueError):
        Breaker(slow, threshold=0)


def test_imports_and_merges_get_vectors(spark):
    from tesserae.plans import importing

    s = make(spark, [memory("a"), memory("b", "gone"), memory("c")])
    s = s.with_(memories=s.memories.withColumn("source", F.when(F.col("id") == "c", "agent_tool").otherwise("import")))

    def embed(text):
        if text == "gone":
            raise OSError
        return [1, 2]

    assert [(r["id"], r["embedding"]) for r in importing.embedded(s, embed).embeddings.collect()] == [("a", [1.0, 2.0])]
    s = make(spark, [memory("a", "one text"), memory("b", "other text")])
    out, done = merging.merged(s, [("a", "b")], lambda a, b: ("both texts", "fact"), now(), lambda t: [3.0])
    assert [(r["id"], r["embedding"]) for r in out.embeddings.collect()] == [(done[0].new_id, [3.0])]
    assert merging.merged(s, [("a", "b")], lambda a, b: ("both texts", "fact"), now(), lambda t: None)[0].embeddings.count() == 0


def test_context_is_kept_only_while_nothing_changes(spark):
    a = context.Assembler(make(spark, [memory("a", "green tea is what they drink")]))
    first = a.assemble("green tea", "high", now())
    key = a.cache["key"]
    assert "green tea" in first and a.assemble("green tea", "high", now()) == first and a.cache["key"] == key
    seen = spark.createDataFrame([("a",)], "memory_id string")
    assert a.assemble("green tea", "high", now(), seen) == ""
    a.assemble("green tea", "high", now() + F.expr("interval 1 day"))
    assert a.cache["key"] != key


def test_near_duplicate_pairs_without_comparing_all_that_begin_alike(spark):
    """As by comparing all pairs, whatever the parts that the order of texts is cut into."""
    import random

    from tesserae.functions import text as tx

    head, r = "a head that thousands of texts share, ä and all ", random.Random(3)
    texts = ["", "", "a", "a", "short", head[:39], head[:40], head[:39], *(head + "".join(r.choice("ab ") for _ in range(r.randrange(7))) for _ in range(150))]
    texts += [head + f"{i:05d}" for i in range(3000)] + [head + "00007 and more", "z" * 3000, "z" * 2000, "z" * 999]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (i < 158 or j >= 3158) and tx.near_duplicate(texts[i], texts[j])}
    want |= {(i, j) for i in range(158, 3158) for j in range(3158, len(texts)) if tx.near_duplicate(texts[i], texts[j])}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, c string")
    for parts in (1, 3, 40):
        rows = [tuple(x) for x in similarity.near_duplicate_pairs(df, parts).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert similarity.near_duplicate_pairs(df.limit(0)).count() == 0
