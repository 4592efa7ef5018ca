"""The engine as an agent uses it: five tools, three commands, and the hooks around a turn.

Embedding and language models are functions that the caller gives; without them search goes by words alone, merges
take the longer content, and imports are stored as inferred.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.config import Config
from tesserae.operators import dml, merging, provenance, retrieval, scans
from tesserae.plans import consolidation, context, importing, inspection
from tesserae.sources import markdown, retrieval_log, sessions, store as st


class BreakerOpen(RuntimeError):
    """The embedder isn't asked just now."""


class EmbeddingTimeout(TimeoutError):
    """The embedder took longer than it may."""


@dataclass
class Breaker:
    """Stops asking an embedder that failed `threshold` times in a row, for about `cooldown` seconds.

    A call that takes longer than `timeout` seconds counts as failed; what becomes of it later is told to `on_late`, as
    (outcome, error). The rest varies by the share `jitter` either way, so that many engines don't come back at once.
    After it one call is let through as a probe; others are refused until it is back, and if it fails the rest starts again.
    """

    embed: Callable[[str], list[float]]
    threshold: int = 2
    cooldown: float = 30.0
    clock: Callable[[], float] = time.monotonic
    timeout: float = 3.0
    jitter: float = 0.2
    on_change: Callable[[str, str], None] | None = None
    on_late: Callable[[str, BaseException | None], None] | None = None
    failures: int = 0
    opened: float | None = None
    resting: float = 0.0
    probing: bool = False
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def __post_init__(self):
        if self.threshold < 1 or self.cooldown < 0 or self.timeout <= 0:
            raise ValueError("threshold must be 1 or more, cooldown not negative and timeout above 0")

    @property
    def state(self) -> str:
        """closed, open, or half open once the rest is over."""
        if self.opened is None:
            return "closed"
        return "half open" if self.clock() - self.opened >= self.resting else "open"

    def _asked(self, text: str) -> list[float]:
        done: Future = Future()

        def run() -> None:
            try:
                done.set_result(self.embed(text))
            except BaseException as e:  # noqa: BLE001 - handed to whoever waits
                done.set_exception(e)

        threading.Thread(target=run, daemon=True).start()
        try:
            return done.result(self.timeout)
        except TimeoutError:
            if done.done():  # the embedder's own
                raise
            if self.on_late is not None:
                done.add_done_callback(lambda f: self.on_late("failed" if f.exception() else "done", f.exception()))
            raise EmbeddingTimeout(f"no embedding after {self.timeout} s") from None

    def __call__(self, text: str) -> list[float]:
        with self.lock:
            state = self.state
            if state == "open" or (state == "half open" and self.probing):
                raise BreakerOpen
            probe = state == "half open"
            self.probing = self.probing or probe
        was = "closed" if self.opened is None else "open"
        try:
            out = self._asked(text)
        except Exception:
            with self.lock:
                self.failures += 1
                if self.failures >= self.threshold:
                    self.opened = self.clock()
                    self.resting = self.cooldown * (1 + random.uniform(-self.jitter, self.jitter))
            raise
        else:
            with self.lock:
                self.failures, self.opened = 0, None
            return out
        finally:
            if probe:
                self.probing = False
            now = "closed" if self.opened is None else "open"
            if now != was and self.on_change is not None:
                self.on_change(was, now)


@dataclass
class Engine:
    spark: SparkSession
    config: Config
    embed: Callable[[str], list[float]] | None = None
    produce: merging.Producer = merging.longest
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)
    breaker: Breaker | None = field(default=None)

    def __post_init__(self):
        if self.embed is not None and self.breaker is None:
            self.breaker = Breaker(self.embed)

    @property
    def now(self):
        return F.lit(self.clock())

    @property
    def store(self) -> st.Store:
        return st.read(self.spark, self.config.root)

    @property
    def log_path(self) -> str:
        return f"{self.config.root}/retrieval-log"

    def vector(self, text: str) -> list[float] | None:
        """The embedding of a text; None if there is no embedder, or it is at rest or late."""
        if self.breaker is None:
            return None
        try:
            return self.breaker(text)
        except (BreakerOpen, TimeoutError):
            return None

    def _log(self, event: str, ids: list[str], ratings: dict[str, int] | None = None, comment: str | None = None, context_ids: list[str] | None = None) -> None:
        at = self.clock().astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        row = [(at, event, ids, ratings, comment, context_ids)]
        kinds = "timestamp string, event string, ids array<string>, ratings map<string,int>, comment string, context_ids array<string>"
        retrieval_log.append(self.spark.createDataFrame(row, kinds).coalesce(1), self.log_path)

    # tools

    def store_memory(self, content: str, type: str = "fact", source: str = "agent_tool", temporal_state: str = "none", temporal_anchor: str | None = None, context_ids: tuple[str, ...] = ()) -> str:
        """Keeps a memory and returns its id; one that is there stays as it is."""
        if temporal_state not in S.STATES or source not in S.SOURCES:
            raise ValueError("unknown state or source")
        vector = self.vector(content)
        row = self.spark.createDataFrame([(content, type, source, temporal_state, temporal_anchor, vector)], "content string, type string, source string, temporal_state string, temporal_anchor string, embedding array<float>")
        row = row.withColumn("temporal_anchor", F.col("temporal_anchor").try_cast("timestamp"))
        st.changed(self.spark, self.config.root, lambda store: dml.stored(store, row, self.now))
        id = row.select(S.content_id(F.col("content")).alias("id")).first()["id"]
        self._log("store", [id], context_ids=list(context_ids))
        return id

    def search(self, query: str, limit: int = 5) -> DataFrame:
        found = retrieval.search(self.store, query, limit, self.now, self.vector(query)).persist()
        ids = [r["id"] for r in found.select("id").collect()]
        if ids:
            self._log("search", ids)
        return found

    def recall(self, prompt: str, limit: int = 3) -> DataFrame:
        found = retrieval.recall(self.store, prompt, limit, self.now, self.vector(prompt)).persist()
        ids = [r["id"] for r in found.select("id").collect()]
        if ids:
            self._log("recall", ids)
        return found

    def get(self, id: str) -> DataFrame:
        return S.valid_memories(scans.by_prefix(self.store.memories, id))

    def feedback(self, ratings: dict[str, int], comment: str | None = None) -> None:
        """Logs ratings; strengths change when the turn that holds them is ingested."""
        if ratings:
            self._log("feedback", list(ratings), ratings, comment)

    def browse(self, limit: int = 50) -> DataFrame:
        return retrieval.browse(self.store, min(200, max(1, limit)), self.now)

    # commands

    def sleep(self) -> consolidation.Summary:
        """Runs the consolidation and keeps its result, also where a merge failed."""
        try:
            store, summary = consolidation.consolidated(self.store, self.now, self.produce, None if self.breaker is None else self.vector)
        except consolidation.MergeFailed as e:
            st.write(e.store, self.config.root)
            raise
        st.write(store, self.config.root)
        return summary

    def migrate(self, workspace: str, session_folder: str | None = None, replies: Callable[[DataFrame], DataFrame] | None = None, enrichment: DataFrame | None = None) -> int:
        """Imports a workspace's files once, and sessions if replies turns their segments into (date, response)."""
        store = self.store
        if scans.state_value(store.state, "migration_completed_at") is not None:
            return 0
        segments = markdown.segmented(markdown.discovered(self.spark, workspace))
        rows = importing.enriched(segments, enrichment)
        if session_folder is not None and replies is not None:
            rows = rows.unionByName(importing.session_facts(replies(sessions.segments(sessions.lines(self.spark, session_folder)))))
        n = rows.count()
        new = importing.imported(store, rows, self.now)
        if self.embed is not None:
            new = importing.embedded(new, self.embed)
        at = self.clock().astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        st.write(new.with_(state=dml.state_set(new.state, migration_completed_at=at)), self.config.root)
        return n

    def transitions(self) -> int:
        """Moves due memories one state on, apart from a full run."""
        store = self.store
        n = scans.due(store.memories, self.now).count()
        st.write(store.with_(memories=consolidation.transitioned(store.memories, self.now)), self.config.root)
        return n

    def cleanup(self, files: DataFrame) -> DataFrame:
        """The workspace files (path, text) that tell an agent to keep memories in files."""
        from tesserae.functions.text import about_file_memory

        return files.filter(about_file_memory(F.col("text"))).select("path")

    # around a turn

    def assemble(self, prompt: str, budget: str = "high", visible: DataFrame | None = None) -> str:
        return context.Assembler(self.store).assemble(prompt, budget, self.now, visible, vector=self.vector(prompt))

    def after_turn(self, ledger: DataFrame, turn: DataFrame) -> None:
        st.changed(self.spark, self.config.root, lambda store: provenance.ingested(store, ledger, turn))

    def stats(self) -> DataFrame:
        return dml.counts(self.store)

    def inspect(self, id: str) -> DataFrame:
        return inspection.inspected(self.store, scans.by_prefix(self.store.memories, id).select("id"))


def reconciled(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(action, id, name): what makes jobs (id, name, description, expr, text, enabled, created_at_ms) equal to wanted (tag, name, description, expr, text, enabled).

    A job belongs to a wanted one if its description holds the tag or its name and text are the same; the oldest is
    kept, updated where it differs, and the others are removed. A wanted one without a job is added.
    """
    from pyspark.sql import Window

    j, w = jobs.alias("j"), F.broadcast(wanted).alias("w")
    belongs = F.contains(F.coalesce("j.description", F.lit("")), F.col("w.tag")) | ((F.col("j.name") == F.col("w.name")) & (F.col("j.text") == F.col("w.text")))
    order = Window.partitionBy("w.tag").orderBy(F.col("j.created_at_ms").asc_nulls_last(), "j.id")
    found = j.join(w, belongs).withColumn("n", F.row_number().over(order))
    same = F.lit(True)
    for c in ("name", "description", "expr", "text", "enabled"):
        same = same & F.col(f"j.{c}").eqNullSafe(F.col(f"w.{c}"))
    acted = found.withColumn("action", F.when(F.col("n") > 1, "remove").when(~same, "update")).filter("action is not null")
    known = found.select("w.tag").distinct()
    added = wanted.join(known, "tag", "left_anti").select(F.lit("add").alias("action"), F.lit(None).cast(jobs.schema["id"].dataType).alias("id"), "name")
    return acted.select("action", "j.id", F.col("w.name").alias("name")).unionByName(added)
