"""JSON snapshots of a store: files of JSON lines for each table, or one document as the command line exchanges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.operators import dml
from tesserae.sources.store import Store, conformed, empty

VERSION = 2
#: The document's keys, and the tables that they hold.
KEYS = {"memories": "memories", "associations": "associations", "attributions": "attributions", "exposures": "exposures", "aliases": "aliases", "state": "state"}
TIMES = {c.split()[0] for ddl in S.TABLES.values() for c in ddl.split(", ") if c.endswith(" timestamp")}


def plain(df: DataFrame) -> DataFrame:
    """Times as ISO text."""
    return df.select(*(S.iso(F.col(c)).alias(c) if c in TIMES else F.col(c) for c in df.columns))


def export(store: Store, path: str) -> None:
    """A folder of JSON lines for each table of the document; made in parallel, of any size."""
    for key, table in KEYS.items():
        plain(getattr(store, table)).write.option("ignoreNullFields", "false").json(f"{path}/{key}")


def document(store: Store, exported_at: str) -> str:
    """The whole snapshot as one JSON document. It passes the driver: for small stores; `export` is for large ones."""
    out: dict = {"version": VERSION, "exported_at": exported_at}
    for key, table in KEYS.items():
        rows = plain(getattr(store, table)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
        out[key] = [json.loads(r["j"]) for r in rows.orderBy("j").collect()]
    return json.dumps(out, ensure_ascii=False)


def _schema(key: str, version: int) -> str:
    columns = S.TABLES[KEYS[key]].replace("timestamp", "string")
    if key == "associations" and version == 1:
        return "a string, b string, weight double, created_at string"
    return columns


def loaded(spark: SparkSession, text: str, now) -> Store:
    """The tables of a document of version 1 or 2; missing ones are empty."""
    data = json.loads(text)
    if not isinstance(data, dict) or data.get("version") not in (1, 2):
        raise ValueError("a snapshot is a JSON object of version 1 or 2")
    tables = {}
    for key, table in KEYS.items():
        rows = data.get(key) or []
        raw = spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in rows], "j string")
        tables[table] = typed(raw.select(F.from_json("j", _schema(key, data["version"])).alias("r")).select("r.*"), table, now)
    return empty(spark, **tables)


def read(spark: SparkSession, path: str, now) -> Store:
    """The tables of a folder that `export` wrote."""
    return empty(spark, **{table: typed(spark.read.schema(_schema(key, VERSION)).json(f"{path}/{key}"), table, now) for key, table in KEYS.items()})


def typed(rows: DataFrame, table: str, now) -> DataFrame:
    """Rows of a snapshot as a table; unknown states are none, unknown sources agent_tool, rows of broken domains go."""
    if "a" in rows.columns and table == "associations":
        rows = rows.withColumnsRenamed({"a": "memory_a", "b": "memory_b"})
    df = conformed(rows, table)
    if table == "memories":
        known = lambda c, domain, other: F.when(F.col(c).isin(*domain), F.col(c)).otherwise(other)
        return df.withColumns({"temporal_state": known("temporal_state", S.STATES, "none"), "source": known("source", S.SOURCES, "agent_tool"), "consolidated": F.coalesce("consolidated", F.lit(False))}).filter(S.valid_strength())
    if table == "associations":
        return df.withColumn("created_at", F.coalesce("created_at", now))
    if table == "attributions":
        return df.withColumn("reinforcement_applied", F.coalesce("reinforcement_applied", F.lit(False))).filter(S.valid_attribution())
    return df.filter(S.valid_exposure()) if table == "exposures" else df


def imported(store: Store, new: Store, now) -> tuple[Store, DataFrame]:
    """The store with a snapshot's tables, and one row of counts.

    Memories that are there are skipped; edges are set; exposures and attributions of known keys are ignored; aliases
    and state replace.
    """
    fresh = dml.first_of(new.memories, ["id"], ["created_at"]).join(store.memories.select("id"), "id", "left_anti")
    edges = dml.first_of(new.associations.select(F.least("memory_a", "memory_b").alias("memory_a"), F.greatest("memory_a", "memory_b").alias("memory_b"), "weight", "created_at"), ["memory_a", "memory_b"], [F.desc("created_at"), F.desc("weight")])
    at = edges.select("memory_a", "memory_b", F.col("created_at").alias("__at"))
    joined = dml.edges_set(store.associations, edges, F.lit(None).cast("timestamp")).join(at, ["memory_a", "memory_b"], "left")
    joined = joined.select("memory_a", "memory_b", "weight", F.coalesce("created_at", "__at").alias("created_at"), F.when(F.col("created_at").isNotNull(), F.coalesce("__at", "last_updated_at")).alias("last_updated_at"))
    out = store.with_(
        memories=store.memories.unionByName(fresh.select(*store.memories.columns)),
        associations=joined,
        exposures=dml.inserted_or_ignored(store.exposures, new.exposures, dml.EXPOSURE_KEY, ["created_at"]),
        attributions=dml.inserted_or_ignored(store.attributions, new.attributions, dml.ATTRIBUTION_KEY, ["created_at"]),
        aliases=dml.upserted(store.aliases, dml.first_of(new.aliases, ["old_id"], [F.desc("created_at")]), ["old_id"]),
        state=dml.upserted(store.state, dml.first_of(new.state, ["key"], ["value"]), ["key"]),
    )
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = n(fresh, "memories")
    for df, name in ((new.memories, "memories_read"), (new.associations, "associations"), (new.attributions, "attributions"), (new.exposures, "exposures"), (new.aliases, "aliases"), (new.state, "state")):
        counts = counts.crossJoin(F.broadcast(n(df, name)))
    counts = counts.select("memories", (F.col("memories_read") - F.col("memories")).alias("memories_skipped"), "associations", "attributions", "exposures", "aliases", "state")
    return out, counts
