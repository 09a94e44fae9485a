"""The variable catalogue as tables: ``variables(name, layer, ...)`` and ``edges(src, dst)``,
where ``src`` is computed from ``dst``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spark import materialise, require_none, require_rows
from .layers import LayerStore

# Layers of the catalogue and length of a spec hash.
CATALOGUE_LAYERS = ("raw", "transformed", "derived")
HASH_LENGTH = 8
SUMMARY_FIELDS = ("type", "transformation", "source", "series_id", "ticker", "frequency")


def universe_expand(template: DataFrame, tickers: DataFrame, strict: bool = False) -> DataFrame:
    """One variable per (template, ticker) of the same ``universe``, named by the template's pattern."""
    out = tickers.join(template, "universe").withColumn("name", F.replace(F.col("pattern"), F.lit("{ticker}"), F.col("ticker")))
    if strict:
        require_none(duplicate_names(out), "universe names collide")
    return out


def registry_lookup(variables: DataFrame, names: DataFrame, strict: bool = False) -> DataFrame:
    """Requested names with their spec and whether they exist."""
    out = names.select("name").distinct().join(variables.withColumn("_known", F.lit(True)), "name", "left")
    out = out.withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")
    if strict:
        require_none(out.filter("not known").select("name"), "unknown variables")
    return out


def filter_layer(variables: DataFrame, layer: str) -> DataFrame:
    if layer not in CATALOGUE_LAYERS:
        raise ValueError(f"invalid layer {layer!r}.")
    return variables.filter(F.col("layer") == layer)


def duplicate_names(variables: DataFrame) -> DataFrame:
    return variables.groupBy("name").agg(F.count(F.lit(1)).alias("definitions")).filter("definitions > 1")


def dependency_edges(specs: DataFrame) -> DataFrame:
    """``(src, dst)`` from ``source_variable``, ``sources`` and ``inputs`` of each spec."""
    one = F.when(F.col("source_variable").isNotNull(), F.array("source_variable"))
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce(one, none), F.coalesce("sources", none), F.coalesce("inputs", none))
    return specs.select(F.col("name").alias("src"), F.explode(every).alias("dst"))


def unresolved_refs(edges: DataFrame, variables: DataFrame) -> DataFrame:
    return edges.join(variables.select(F.col("name").alias("dst")), "dst", "left_anti").select("src", "dst")


def used_by(edges: DataFrame) -> DataFrame:
    """Direct users as ``(name, user)`` rows: a popular name may have too many for one list."""
    return edges.select(F.col("dst").alias("name"), F.col("src").alias("user")).distinct()


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All ``(src, dst)`` pairs joined by a path, by extending only the newest pairs each round.

    The number of rounds is the depth of the graph. Every round is written to the shared folder, so
    the plan stays short and a lost executor costs one round.
    """
    steps = materialise(edges.select("src", "dst").distinct(), "edges")
    reached = fresh = steps
    while not fresh.isEmpty():
        further = fresh.select("src", F.col("dst").alias("_via")).join(steps.select(F.col("src").alias("_via"), "dst"), "_via").select("src", "dst").distinct()
        fresh = materialise(further.join(reached, ["src", "dst"], "left_anti"), "closure")
        reached = reached.unionByName(fresh)
    return reached


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after repeatedly removing names nothing points to or that point to nothing.

    Empty for a valid catalogue, so the search below then has nothing to do.
    """
    core = materialise(edges.select("src", "dst").distinct(), "core")
    size = core.count()
    while size:
        inner = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
        inner = inner.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        core = materialise(inner, "core")
        left = core.count()
        if left == size:
            break
        size = left
    return core


def _colours(edges: DataFrame) -> DataFrame:
    """``(name, colour)``: the largest name from which each name can be reached, itself included."""
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    now = materialise(names.withColumn("colour", F.col("name")), "colours")
    while True:
        sent = edges.join(now.withColumnRenamed("name", "src"), "src").groupBy(F.col("dst").alias("name")).agg(F.max("colour").alias("_new"))
        step = now.join(sent, "name", "left").select("name", F.greatest("colour", "_new").alias("colour"), (F.col("_new") > F.col("colour")).alias("_changed"))
        step = materialise(step, "colours")
        now = step.select("name", "colour")
        if step.filter("_changed").isEmpty():
            return now


def dependency_cycles(edges: DataFrame) -> DataFrame:
    """Names lying on a cycle.

    Every name is coloured by the largest name that reaches it. Going back from that name inside its
    colour finds its strongly connected part; those parts are taken out and the rest is trimmed and
    coloured again. Tables hold names and edges, never pairs of names joined by a path.
    """
    core = cyclic_core(edges)
    found = core.select(F.col("src").alias("name")).limit(0)
    while not core.isEmpty():
        colour = _colours(core)
        ends = core.join(colour.toDF("src", "_c"), "src").join(colour.toDF("dst", "_d"), "dst")
        inner = materialise(ends.filter("_c = _d").select("src", "dst", F.col("_c").alias("colour")), "inner")
        part = fresh = materialise(colour.filter("name = colour"), "part")
        while not fresh.isEmpty():
            back = inner.join(fresh.select(F.col("name").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("name"), "colour").distinct()
            fresh = materialise(back.join(part, ["name", "colour"], "left_anti"), "part")
            part = part.unionByName(fresh)
        inside = inner.join(part.toDF("src", "colour"), ["src", "colour"], "left_semi").join(part.toDF("dst", "colour"), ["dst", "colour"], "left_semi")
        found = found.union(inside.select("src").distinct())
        gone = part.select("name")
        core = cyclic_core(core.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti"))
    return found


def used_by_transitive(edges: DataFrame) -> DataFrame:
    """``(name, user)``: everything computed, at any depth, from a name."""
    return transitive_closure(edges).select(F.col("dst").alias("name"), F.col("src").alias("user"))


def variable_lineage(edges: DataFrame, variables: DataFrame) -> DataFrame:
    """Upstream tree of every name: ``(root, depth, path, name, layer)``, one row per path.

    A path never visits a name twice, so a cycle ends instead of looping.
    """
    steps = materialise(edges.select("src", "dst").distinct(), "edges")
    names = variables.select("name", "layer")
    level = names.select(F.col("name").alias("root"), F.lit(0).alias("depth"), F.array("name").alias("path"), "name")
    tree = None
    while not level.isEmpty():
        level = materialise(level, "lineage")
        tree = level if tree is None else tree.unionByName(level)
        level = (
            level.join(steps.withColumnRenamed("src", "name"), "name")
            .filter(~F.array_contains("path", F.col("dst")))
            .select("root", F.col("depth") + 1, F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("name"))
            .toDF("root", "depth", "path", "name")
        )
    return require_rows(tree, "empty catalogue").join(names, "name", "left").select("root", "depth", "path", "name", "layer")


def _json_text(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def spec_json(specs: DataFrame) -> Column:
    """Canonical text of a spec: its structural fields in key order, ``", "`` and ``": "`` between.

    Absent window, annualised and sources are left out; frequency and transformation always appear.
    """
    def field(key: str, text: Column) -> Column:
        return F.concat(F.lit(f'"{key}": '), text)

    c = {name: F.col(name) if name in specs.columns else F.lit(None) for name in
         ("annualised", "frequency", "source_frequency", "source_variable", "sources", "transformation", "window")}
    listed = F.concat(F.lit('["'), F.array_join(c["sources"].cast("array<string>"), '", "'), F.lit('"]'))
    pieces = [
        F.when(c["annualised"].isNotNull(), field("annualised", c["annualised"].cast("string"))),
        field("frequency", _json_text(c["frequency"].cast("string"))),
        field("source_frequency", _json_text(c["source_frequency"].cast("string"))),
        F.when(c["source_variable"].isNotNull(), field("source_variable", _json_text(c["source_variable"].cast("string")))),
        F.when(c["source_variable"].isNull() & c["sources"].isNotNull(), field("sources", listed)),
        field("transformation", _json_text(c["transformation"].cast("string"))),
        F.when(c["window"].isNotNull(), field("window", c["window"].cast("string"))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pieces), F.lit("}"))


def spec_hash(specs: DataFrame) -> DataFrame:
    """Add ``spec_hash`` and the derived id ``name__hash_frequency``."""
    hashed = specs.withColumn("spec_hash", F.substring(F.sha2(spec_json(specs), 256), 1, HASH_LENGTH))
    return hashed.withColumn("derived_id", F.concat_ws("_", F.concat_ws("__", "name", "spec_hash"), "frequency"))


def stale_derived(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored ``(name, spec_hash)`` pairs of known names whose hash is not the current one."""
    return stored.join(current.select("name").distinct(), "name", "left_semi").join(current, ["name", "spec_hash"], "left_anti")


def log_transformations(entries: DataFrame, path: str) -> None:
    """Append ``(variable_name, spec_hash, frequency, created_at, source_path)``."""
    entries.select("variable_name", "spec_hash", "frequency", "created_at", "source_path").write.mode("append").parquet(path)


def derived_cache(
    store: LayerStore, name: str, frequency: str, start, end, compute: Callable[[], DataFrame], force_refresh: bool = False
) -> tuple[DataFrame, bool]:
    """Rows of a derived series in ``[start, end]`` and whether they came from the store.

    ``name`` carries the spec hash, so a changed spec never hits. A stored result is used only when
    it was computed for a range that contains the request.
    """
    lo, hi = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    wanted = (F.col("ts") >= lo) & (F.col("ts") <= hi)
    mine = F.col("frequency") == frequency
    if not force_refresh and store.exists("derived"):
        kept = store.read("derived", mine & (F.col("range_start") <= lo) & (F.col("range_end") >= hi), series=name)
        if not kept.isEmpty():
            return kept.filter(wanted), True
    rows = compute().filter(wanted).withColumns({"name": F.lit(name), "frequency": F.lit(frequency), "range_start": lo, "range_end": hi})
    store.write_derived(rows)
    return store.read("derived", mine, series=name).filter(wanted), False
