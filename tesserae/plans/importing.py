"""Imports: segments of files and sessions become memories, weakened by their age."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.functions import parsing, scoring
from tesserae.operators import dml
from tesserae.session import written
from tesserae.sources.store import Store


def file_info(segments: DataFrame) -> DataFrame:
    """(source_file, segments, evergreen, date) of the files that segments come from."""
    return segments.groupBy("source_file").agg(F.count(F.lit(1)).alias("segments"), F.max("evergreen").alias("evergreen"), F.max("date").alias("date"))


def inferred(segments: DataFrame) -> DataFrame:
    """Segments with the type and state that they have if nothing else says so."""
    kind = F.when(F.col("evergreen"), "fact").otherwise("observation")
    return segments.withColumns({"type": kind, "temporal_state": F.when(F.col("date").isNotNull(), "past").otherwise("none")})


def enriched(segments: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """(content, type, temporal_state, anchor) to store of segments; enrichment (source_file, id, type, temporal_state, temporal_anchor, sub_segments).

    A segment with sub-segments becomes these; one without enrichment is stored as inferred. Unknown states fall back.
    """
    base = inferred(segments).withColumnsRenamed({"type": "own_type", "temporal_state": "own_state", "content": "own_content"})
    if enrichment is None:
        return base.select(F.col("own_content").alias("content"), F.col("own_type").alias("type"), F.col("own_state").alias("temporal_state"), F.col("date").alias("anchor"), F.col("date").alias("decay_date"))
    rows = base.join(enrichment, ["source_file", "id"], "left")
    state = lambda c: F.when(c.isin(*S.STATES), c).otherwise(F.col("own_state"))
    anchor = F.coalesce("temporal_anchor", "date")
    whole = rows.filter(F.coalesce(F.size("sub_segments"), F.lit(0)) <= 0)
    whole = whole.select(F.col("own_content").alias("content"), F.coalesce("type", "own_type").alias("type"), state(F.col("temporal_state")).alias("temporal_state"), anchor.alias("anchor"), anchor.alias("decay_date"))
    parts = rows.filter(F.size("sub_segments") > 0).select("own_state", "date", F.explode("sub_segments").alias("s"))
    # a part without an anchor has none, but ages by its file's date
    parts = parts.select("s.content", F.coalesce("s.type", F.lit("observation")).alias("type"), state(F.col("s.temporal_state")).alias("temporal_state"), F.col("s.temporal_anchor").alias("anchor"), F.coalesce("s.temporal_anchor", "date").alias("decay_date"))
    return whole.unionByName(parts)


def session_facts(replies: DataFrame) -> DataFrame:
    """The same for replies (date, response) of a language model to exchanges."""
    rows = parsing.facts(replies)
    return rows.select("content", "type", F.when(F.col("date").isNotNull(), "past").otherwise("none").alias("temporal_state"), F.col("date").alias("anchor"), F.col("date").alias("decay_date"))


def imported(store: Store, rows: DataFrame, now: Column) -> Store:
    """The store with rows (content, type, temporal_state, anchor, decay_date) as memories of source import.

    A content that is there keeps its row, but takes the strength of its age as well if that is under 1; of rows of
    one content the last to be weakened counts, which is the least strength here.
    """
    made = rows.withColumns({"temporal_anchor": F.col("anchor").try_cast("timestamp"), "source": F.lit("import"), "created_at": now})
    out = dml.stored(store, made.select("content", "type", "temporal_state", "temporal_anchor", "source", "created_at"), now)
    aged = rows.select(S.content_id(F.col("content")).alias("id"), scoring.import_strength(F.col("decay_date").try_cast("timestamp"), now).alias("aged")).filter("aged < 1")
    aged = aged.groupBy("id").agg(F.min("aged").alias("aged"))
    return out.with_(memories=dml.updated(out.memories, aged, strength="aged"))


def embedded(store: Store, embed: Callable[[str], list[float] | None], source: str = "import") -> Store:
    """The store with vectors for those memories of a source that have none; embed goes to the executors with its batches.

    A content whose embedding fails, or is None, stays without a vector, as search goes by words then. The vectors are
    written, so that no content is sent to the model again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = [], []
            for id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    vector = embed(content)
                except Exception:  # noqa: BLE001 - whatever the model raises, the memory itself is kept
                    vector = None
                if vector is not None:
                    ids.append(id)
                    vectors.append([float(x) for x in vector])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], ["id", "embedding"])

    bare = store.memories.filter(F.col("source") == source).join(store.embeddings.select("id"), "id", "left_anti").select("id", "content")
    return store.with_(embeddings=dml.upserted(store.embeddings, written(bare.mapInArrow(run, S.TABLES["embeddings"]), "vectors"), ["id"]))
