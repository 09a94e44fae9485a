"""Layered tables: immutable raw, versioned adjusted, replaceable derived.

A layer is a list of generations. Every write puts its series into a generation folder of its own
(``source``, ``frequency``, ``version`` and a hash bucket are folders inside, the ticker is a column), adds
their first and last time and row count to the manifest, and becomes visible by one small commit file that
carries the next number. No stored file is ever changed: replacing a series means that a later generation
has it too, and its newest generation counts. So a write that fails leaves the layer as it was, readers
keep what they planned, and of two writers that start from the same state the second is refused
(``ConflictError``) and can try again on the new state.

What is stored is known from the manifest, one row per written series: refusing a known series, coverage
and the inventory never read the layer. Only generations that hold replaced series are joined with the
manifest when they are read; ``clean_up`` deletes those of which nothing is left.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spark import delete_shared, require_none, write_once

# Error conditions of a path that does not exist or holds no files yet.
ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
LAYERS = {
    "raw": ["source", "frequency", "bucket"],
    "adjusted": ["source", "frequency", "version", "bucket"],
    "derived": ["frequency", "bucket"],
}
SERIES_KEY = {
    "raw": ["source", "ticker", "frequency"],
    "adjusted": ["source", "ticker", "frequency", "version"],
    "derived": ["name", "frequency"],
}


class ConflictError(RuntimeError):
    """Another write was committed since this one read the state of the layer."""


@dataclass
class _State:
    """What the commits of a layer say: a few names per write, never anything per series."""

    last: int
    generations: list[str]
    replaced: set[str]
    schema: T.StructType


def _check_close(df: DataFrame) -> None:
    if "close" not in df.columns:
        raise ValueError("a stored series needs a 'close' column.")


def _merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """Columns of both; a column keeps its type, or the write is refused."""
    for field in new.fields:
        if field.name in old.names and old[field.name].dataType != field.dataType:
            raise ValueError(f"column {field.name!r} is stored as {old[field.name].dataType.simpleString()}, not {field.dataType.simpleString()}.")
    return T.StructType([*old.fields, *[f for f in new.fields if f.name not in old.names]])


class LayerStore:
    """Raw, adjusted and derived series under one root folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def path(self, layer: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}.")
        return f"{self.root}/{layer}"

    def _state(self, layer: str) -> _State:
        """Any failure but a missing folder is passed on: a broken layer must not look like an empty one."""
        try:
            files = self.spark.read.text(f"{self.path(layer)}/commits", wholetext=True).collect()
        except AnalysisException as e:
            if e.getCondition() not in ABSENT:
                raise
            files = []
        commits = sorted((json.loads(f.value) for f in files), key=lambda c: c["number"])
        gone = {g for c in commits for g in c["deleted"]}
        schema = T.StructType([])
        for c in commits:
            schema = _merged(schema, T.StructType.fromJson(c["schema"]))
        generations = [c["generation"] for c in commits if c["generation"] and c["generation"] not in gone]
        return _State(commits[-1]["number"] if commits else -1, generations, {g for c in commits for g in c["replaces"]} - gone, schema)

    def _commit(self, layer: str, state: _State, generation: str | None = None, replaces: list[str] = (), deleted: list[str] = (), schema: T.StructType | None = None) -> None:
        number = state.last + 1
        body = {"number": number, "generation": generation, "replaces": sorted(replaces), "deleted": sorted(deleted), "schema": (schema or T.StructType([])).jsonValue()}
        if not write_once(self.spark, f"{self.path(layer)}/commits/{number:012d}", json.dumps(body)):
            raise ConflictError(f"the {layer} layer has changed since this write began.")

    def _scan(self, layer: str, part: str, generations: list[str], schema: T.StructType) -> DataFrame:
        """The ``data`` or ``manifest`` of some generations, whose name is a column."""
        if not generations:
            return self.spark.createDataFrame([], schema)
        folder = f"{self.path(layer)}/{part}"
        return self.spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/generation={g}" for g in generations])

    def _manifest(self, layer: str, state: _State, only: list[str] | None = None) -> DataFrame:
        key = [T.StructField(k, state.schema[k].dataType if k in state.schema.names else T.StringType()) for k in SERIES_KEY[layer]]
        ts = state.schema["ts"].dataType if "ts" in state.schema.names else T.DateType()
        rest = [T.StructField("bucket", T.IntegerType()), T.StructField("first", ts), T.StructField("last", ts), T.StructField("row_count", T.LongType())]
        return self._scan(layer, "manifest", state.generations if only is None else only, T.StructType([*key, *rest, T.StructField("generation", T.StringType())]))

    def _live(self, layer: str, state: _State) -> DataFrame:
        """The manifest row of every series in its newest generation; names of generations sort by commit."""
        facts = F.struct("generation", "bucket", "first", "last", "row_count")
        newest = self._manifest(layer, state).groupBy(*SERIES_KEY[layer]).agg(F.max_by(facts, "generation").alias("_s"))
        return newest.select(*SERIES_KEY[layer], "_s.*")

    def exists(self, layer: str) -> bool:
        """Whether the layer has been written."""
        return bool(self._state(layer).generations)

    def series(self, layer: str) -> DataFrame:
        """One row per stored series: its key, ``first``, ``last`` and ``row_count``, from the manifest alone."""
        return self._live(layer, self._state(layer)).drop("generation", "bucket")

    def _write(self, df: DataFrame, layer: str, replace: bool) -> DataFrame:
        """Stores the rows and returns the manifest of what was written, one row per series."""
        _check_close(df)
        state, key, folders = self._state(layer), SERIES_KEY[layer], LAYERS[layer]
        schema = _merged(state.schema, df.schema)
        generation = f"{state.last + 1:012d}-{uuid.uuid4().hex}"
        at = {part: f"{self.path(layer)}/{part}/generation={generation}" for part in ("data", "manifest")}
        bucket = F.pmod(F.hash("name" if layer == "derived" else "ticker"), F.lit(self.buckets))
        try:
            df.withColumn("bucket", bucket).hint("rebalance", *folders).write.partitionBy(*folders).parquet(at["data"])
            # what the files hold, not what a second run of the plan would give
            stored = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(at["data"])
            ranges = stored.groupBy(*key, "bucket").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("row_count"))
            ranges.write.parquet(at["manifest"])
            new = self._manifest(layer, _State(state.last, [generation], set(), schema))
            require_none(new.filter(" OR ".join(f"{k} IS NULL" for k in key)).select(*key), f"{layer} series without a full key")
            replaces = self._overlap(layer, state, new, replace)
            if new.isEmpty():
                self._drop(at)
                return self.spark.createDataFrame([], new.schema)
            self._commit(layer, state, generation, replaces, schema=df.schema)
            return new
        except BaseException:
            self._drop(at)
            raise

    def _overlap(self, layer: str, state: _State, new: DataFrame, replace: bool) -> list[str]:
        """Names of the generations from which the new series take over; without ``replace`` there must be none."""
        if not state.generations:
            return []
        known = self._live(layer, state).join(new.select(*SERIES_KEY[layer]), SERIES_KEY[layer], "left_semi")
        if not replace:
            require_none(known.select(*SERIES_KEY[layer]), f"{layer} series already exist")
            return []
        return [r.generation for r in known.select("generation").distinct().toLocalIterator()]

    def _drop(self, folders: dict[str, str]) -> None:
        for folder in folders.values():
            delete_shared(self.spark, folder)

    def write_raw(self, df: DataFrame) -> None:
        """Append new series; a series that is already stored is refused."""
        self._write(df, "raw", replace=False)

    def replace_raw(self, df: DataFrame) -> None:
        """Only for callers that have checked the replacement (see ``ingest.superset_guard``)."""
        self._write(df, "raw", replace=True)

    def write_adjusted(self, df: DataFrame, version: int) -> DataFrame:
        """The written series are returned, as their manifest."""
        if version < 0:
            raise ValueError("version must be >= 0.")
        return self._write(df.withColumn("version", F.lit(version)), "adjusted", replace=True)

    def write_derived(self, df: DataFrame) -> None:
        self._write(df, "derived", replace=True)

    def clean_up(self, layer: str) -> list[str]:
        """Delete the generations of which every series has been replaced, and return their names. For times
        without readers: a plan made before may still name their files."""
        state = self._state(layer)
        held = {r.generation for r in self._live(layer, state).select("generation").distinct().toLocalIterator()}
        dead = [g for g in state.generations if g not in held]
        if dead:
            # committed first: whatever fails later, no reader asks for the folders again
            self._commit(layer, state, deleted=dead)
        for g in dead:
            self._drop({part: f"{self.path(layer)}/{part}/generation={g}" for part in ("data", "manifest")})
        return dead

    def read(
        self, layer: str, where: Column | None = None, version: int | str | None = None, series: str | None = None, among: DataFrame | None = None
    ) -> DataFrame:
        """Rows of a layer. ``where`` prunes folders and is pushed into the scan; ``series`` (a ticker,
        or the name of a derived series) reads only its generations and buckets; ``among`` (columns of the series
        key) leaves out generations that hold none of these series, its own rows are not filtered; in the adjusted
        layer ``version`` is a number or ``"latest"``."""
        state, key = self._state(layer), SERIES_KEY[layer]
        if not state.generations:
            raise LookupError(f"the {layer} layer holds nothing.")
        live, generations, places = self._live(layer, state), state.generations, F.lit(True)
        if series is not None:
            name = F.col("name" if layer == "derived" else "ticker")
            # a row per generation and bucket of one series
            held = live.filter(name == series).select("generation", "bucket").distinct().collect()
            generations = sorted({r.generation for r in held})
            places = F.col("bucket").isin(sorted({r.bucket for r in held})) & (name == series)
        if among is not None:
            # names of generations, one per write
            held = live.join(among, among.columns, "left_semi").select("generation").distinct().toLocalIterator()
            asked = {r.generation for r in held}
            generations = [g for g in generations if g in asked]
        schema = T.StructType([*state.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("generation", T.StringType())])
        df = self._scan(layer, "data", [g for g in generations if g not in state.replaced], schema)
        old = [g for g in generations if g in state.replaced]
        if old:
            # the series that later generations have: usually few, and none of them large
            stale = self._manifest(layer, state, old).select(*key, "generation").join(live.select(*key, "generation"), [*key, "generation"], "left_anti")
            df = df.unionByName(self._scan(layer, "data", old, schema).join(stale, [*key, "generation"], "left_anti"))
        df = df.filter(places).select(*state.schema.names)
        df = df if where is None else df.filter(where)
        if version == "latest":
            newest = latest_version(live).withColumnRenamed("latest_version", "version")
            return df.join(newest, ["source", "ticker", "frequency", "version"], "left_semi")
        return df if version is None else df.filter(F.col("version") == version)

    def read_derived(self, name: str, frequency: str) -> DataFrame:
        df = self.read("derived", F.col("frequency") == frequency, series=name) if self.exists("derived") else None
        if df is None or df.isEmpty():
            raise LookupError(f"no derived series {name}_{frequency}")
        return df

    def list_available(self, layer: str | None = None) -> DataFrame:
        """Inventory of all series with their row counts, sorted; read from the manifests."""
        out = None
        for name in [layer] if layer else LAYERS:
            df = self.series(name)
            source = F.col("name") if name == "derived" else F.col("source")
            ticker = F.lit(None).cast("string") if name == "derived" else F.col("ticker")
            version = F.col("version").cast("int") if name == "adjusted" else F.lit(None).cast("int")
            part = df.select(F.lit(name).alias("layer"), source.alias("source"), ticker.alias("ticker"), "frequency", version.alias("version"), "row_count")
            out = part if out is None else out.unionByName(part)
        return out.orderBy("layer", "source", "ticker", "frequency", "version")


def latest_version(adjusted: DataFrame) -> DataFrame:
    """Numerically highest version of each series."""
    return adjusted.groupBy("source", "ticker", "frequency").agg(F.max(F.col("version").cast("int")).alias("latest_version"))


def parse_series_key(df: DataFrame, layer: str = "layer", key: str = "table_id") -> DataFrame:
    """Split ids into source, ticker, frequency, version; rows that do not parse are dropped.

    raw: exactly three parts; adjusted: three parts and ``_v<n>``; derived: name and frequency.
    """
    is_adjusted, is_derived = F.col(layer) == "adjusted", F.col(layer) == "derived"
    base = F.when(is_adjusted, F.regexp_extract(key, r"^(.+)_v(\d+)$", 1)).otherwise(F.col(key))
    parts = F.split(base, "_")
    parsed = df.withColumns({
        "source": F.when(is_derived, F.regexp_extract(key, r"^(.*)_[^_]*$", 1)).otherwise(F.element_at(parts, 1)),
        "ticker": F.when(~is_derived, F.get(parts, F.lit(1))),
        "frequency": F.element_at(parts, -1),
        "version": F.when(is_adjusted, F.regexp_extract(key, r"_v(\d+)$", 1).try_cast("int")),
        "_parts": F.size(parts),
    })
    fits = F.when(is_derived, F.col("_parts") >= 2).otherwise(F.col("_parts") == 3)
    return parsed.filter(fits & (~is_adjusted | F.col("version").isNotNull())).drop("_parts")


def storage_lineage(inventory: DataFrame) -> DataFrame:
    """Per (source, ticker, frequency): raw id or null, sorted adjusted versions, sorted derived ids
    that start with ``source_ticker_`` and have the same frequency.

    ``inventory(layer, source, ticker, frequency, version, table_id)``; a derived id belongs to every
    prefix of its own name, so the prefixes are spelled out and joined by equality.
    """
    key = ["source", "ticker", "frequency"]
    stored = inventory.filter(F.col("layer") != "derived").groupBy(*key).agg(
        F.max(F.when(F.col("layer") == "raw", F.col("table_id"))).alias("raw"),
        F.sort_array(F.collect_set(F.when(F.col("layer") == "adjusted", F.col("version")))).alias("adjusted_versions"),
    )
    parts = F.split("table_id", "_")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "_")))
    derived = inventory.filter(F.col("layer") == "derived").select("table_id", F.element_at(parts, -1).alias("frequency"), prefix.alias("_prefix"))
    owned = stored.withColumn("_prefix", F.concat_ws("_", "source", "ticker")).join(derived, ["_prefix", "frequency"])
    found = owned.groupBy(*key).agg(F.sort_array(F.collect_set("table_id")).alias("derived"))
    return stored.join(found, key, "left").withColumn("derived", F.coalesce("derived", F.array().cast("array<string>")))


def write_results(metrics: DataFrame, path: str, fmt: str = "csv") -> None:
    """Metrics table as csv, json or parquet."""
    writer = metrics.write.mode("errorifexists")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def append_run_index(run: DataFrame, path: str) -> None:
    """Append ``(timestamp, run_id, path, git_commit, git_dirty)`` rows to the run index."""
    run.select("timestamp", "run_id", "path", "git_commit", "git_dirty").write.mode("append").parquet(path)
