"""Reading variables by name: stored series, and transformations computed level by level over them."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.frequency import FREQUENCY_RANK, check_frequency
from ..functions.spark import materialise, require_none
from ..operators.resample import get_variable
from ..operators.transforms import TRANSFORMATIONS
from .ingest import fetch_or_load
from .landing import route_source
from .layers import LayerStore
from .registry import dependency_edges, duplicate_names, spec_hash

#: First day of a read without a start.
FIRST_DAY = date(2010, 1, 1)
#: What one computation of a level shares.
PARAMETERS = ["transformation", "window", "annualised", "frequency"]
SPEC = (
    "name string, layer string, source string, series_id string, ticker string, frequency string, source_frequency string, "
    "transformation string, source_variable string, sources array<string>, window int, annualised boolean"
)


def reachable(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``name`` of everything the given names are computed from, themselves included: a frontier search, whose
    tables hold names only and never more than what is reached."""
    seen = front = materialise(names.select("name").distinct(), "reached")
    steps = edges.select(F.col("src").alias("name"), F.col("dst"))
    while not front.isEmpty():
        further = steps.join(front, "name", "left_semi").select(F.col("dst").alias("name")).distinct()
        front = materialise(further.join(seen, "name", "left_anti"), "reached")
        seen = seen.unionByName(front)
    return seen


def dependency_levels(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``(name, level)``: 0 for names that depend on nothing in ``names``, else one more than the deepest of what
    they depend on. Names without open dependencies are taken out round by round; if none is left to take, the
    rest lies on or behind a cycle, and that is an error."""
    waiting = materialise(names.select("name").distinct(), "waiting")
    inside = edges.join(waiting.toDF("src"), "src", "left_semi").join(waiting.toDF("dst"), "dst", "left_semi")
    open_edges, out, level = materialise(inside.select("src", "dst").distinct(), "open-edges"), None, 0
    while not waiting.isEmpty():
        ready = materialise(waiting.join(open_edges.select(F.col("src").alias("name")).distinct(), "name", "left_anti"), "ready")
        if ready.isEmpty():
            require_none(waiting, "variables on a cycle, or computed from one")
        placed = ready.withColumn("level", F.lit(level))
        out, level = placed if out is None else out.unionByName(placed), level + 1
        waiting = materialise(waiting.join(ready, "name", "left_anti"), "waiting")
        open_edges = materialise(open_edges.join(ready.toDF("dst"), "dst", "left_anti"), "open-edges")
    return names.select("name", F.lit(0).alias("level")).limit(0) if out is None else out



class Catalogue:
    """Variables (columns of ``SPEC``) over a layer store and landed series ``(source, ticker, frequency, ts, close)``.

    ``source`` and ``series_id`` or ``ticker`` say where a raw variable comes from; a transformed one has a
    transformation and the variables it is computed from. Derived variables are made by signals and models
    and refused here.
    """

    def __init__(self, spark: SparkSession, store: LayerStore, variables: DataFrame, landing: DataFrame):
        self.spark, self.store, self.landing = spark, store, landing
        require_none(duplicate_names(variables), "variables defined twice")
        self.specs = materialise(spec_hash(variables), "specs")
        self.edges = materialise(dependency_edges(self.specs.withColumn("inputs", F.lit(None).cast("array<string>"))).distinct(), "edges")

    def _wanted(self, names: DataFrame | Iterable[str]) -> DataFrame:
        if not isinstance(names, DataFrame):
            names = self.spark.createDataFrame([(n,) for n in names], "name string")
        return materialise(names.select("name").distinct(), "wanted")

    def plan(self, names: DataFrame | Iterable[str]) -> DataFrame:
        """Specs of everything a read of the names needs, with ``level``: raw variables are level 0."""
        needed = reachable(self.edges, self._wanted(names)).join(self.specs, "name", "left")
        needed = materialise(needed, "needed")
        require_none(needed.filter("layer IS NULL").select("name"), "unknown variables")
        require_none(needed.filter("layer = 'derived'").select("name"), "derived variables are written by signals and models, the catalogue does not compute them")
        require_none(needed.filter("layer NOT IN ('raw', 'transformed')").select("name", "layer"), "unknown layers")
        require_none(needed.filter("layer = 'transformed'").filter(F.coalesce(~F.col("transformation").isin(*TRANSFORMATIONS), F.lit(True))).select("name", "transformation"), "unknown transformations")
        linked = self.edges.join(needed.select(F.col("name").alias("src"), "frequency", "layer"), "src").join(needed.select(F.col("name").alias("dst"), F.col("frequency").alias("of_source")), "dst")
        require_none(linked.filter("layer = 'transformed' AND frequency <> of_source").select("src", "dst"), "a source has another frequency than what is computed from it")
        # a raw variable has no dependencies, a transformed one has: levels count transformations
        return materialise(needed.join(dependency_levels(self.edges, needed), "name"), "levels")

    def get(self, names: DataFrame | Iterable[str], start=None, end=None, frequency: str | None = None, force_refresh: bool = False) -> DataFrame:
        """``(asset, ts, value)`` of the named variables in ``[start, end]`` at their own or the asked frequency.

        Raw series are loaded or landed in one pass; then the transformations of each level are computed in one
        job and kept in the derived layer under their spec hash, for reads within the range they were
        computed for. The driver sees the levels and the distinct parameter sets, never names or rows.
        """
        start, end = start or FIRST_DAY, end or date.today()
        if frequency is not None:
            check_frequency(frequency)
        wanted = self._wanted(names)
        plan = self.plan(wanted)
        plan = plan.withColumns({"_start": self._first_day(start, frequency), "_end": F.lit(end).cast("date")})
        levels = [self._raw(plan.filter("level = 0"), force_refresh)]
        while True:
            own = plan.filter(F.col("level") == len(levels))
            if own.isEmpty():
                break
            levels.append(self._computed(own, plan, levels, force_refresh))
        # only levels that hold a wanted name are read
        values = self._of_levels(levels, plan.join(wanted, "name", "left_semi"))
        chosen = values.join(wanted.toDF("asset"), "asset", "left_semi")
        if frequency is None:
            return chosen.filter((F.col("ts") >= F.lit(start).cast("date")) & (F.col("ts") < F.date_add(F.lit(end).cast("date"), 1)))
        native = plan.join(wanted, "name", "left_semi").select(F.col("name").alias("asset"), F.col("frequency").alias("_native"))
        chosen = chosen.join(native, "asset")
        # four frequencies at most
        found = sorted(r["_native"] for r in native.select("_native").distinct().collect())
        parts = [get_variable(chosen.filter(F.col("_native") == f).drop("_native"), f, frequency, start, end).select("asset", "ts", "value") for f in found]
        return reduce(DataFrame.unionByName, parts) if parts else chosen.drop("_native")

    def _first_day(self, start, frequency: str | None) -> Column:
        """Where to load from: one print earlier for a variable that is carried onto a finer frequency."""
        first = F.lit(start).cast("date")
        if frequency is None:
            return first
        out = first
        for native, rank in FREQUENCY_RANK.items():
            if rank > FREQUENCY_RANK[frequency]:
                out = F.when(F.col("frequency") == native, D.one_print_before(first, native)).otherwise(out)
        return out

    def _raw(self, plan: DataFrame, force_refresh: bool) -> DataFrame:
        routed = route_source(plan.filter("layer = 'raw'"), strict=True)
        routed = materialise(routed.select("name", F.col("source_key").alias("source"), F.col("vendor_id").alias("ticker"), "frequency", F.col("_start").alias("start"), F.col("_end").alias("end")), "routes")
        rows = fetch_or_load(self.store, self.landing, routed.drop("name").distinct(), force_refresh=force_refresh, strict=True)
        series = rows.select("source", "ticker", "frequency", "ts", F.col("close").alias("value"))
        named = series.join(routed, ["source", "ticker", "frequency"]).filter("ts >= start AND ts < date_add(end, 1)")
        return materialise(named.select(F.col("name").alias("asset"), "ts", "value"), "level-0")

    @staticmethod
    def _of_levels(levels: list[DataFrame], plan: DataFrame) -> DataFrame:
        """Rows of those levels at which the plan has names; the driver sees the level numbers."""
        held = sorted(r["level"] for r in plan.select("level").distinct().collect())
        return reduce(DataFrame.unionByName, [levels[i] for i in held]) if held else levels[0].limit(0)

    def _inputs(self, levels: list[DataFrame], plan: DataFrame, specs: DataFrame) -> DataFrame:
        """Rows of the levels from which the specs are computed."""
        sources = self.edges.join(specs.select(F.col("name").alias("src")), "src", "left_semi").select(F.col("dst").alias("name")).distinct()
        return self._of_levels(levels, plan.join(sources, "name", "left_semi"))

    def _computed(self, plan: DataFrame, whole: DataFrame, levels: list[DataFrame], force_refresh: bool) -> DataFrame:
        """Rows of the variables of one level: what the derived layer has for the range, and the rest computed."""
        plan = plan.withColumn("_id", F.col("derived_id"))
        todo, kept = plan, None
        if not force_refresh and self.store.exists("derived"):
            have = self.store.read("derived", among=plan.select(F.col("_id").alias("name")).distinct()).select(F.col("name").alias("_id"), "ts", F.col("close").alias("value"), "range_start", "range_end")
            hit = plan.join(have, "_id").filter("range_start <= _start AND range_end >= _end AND ts >= _start AND ts < date_add(_end, 1)")
            kept = materialise(hit.select(F.col("name").alias("asset"), "ts", "value"), "derived-hits")
            todo = plan.join(kept.select(F.col("asset").alias("name")).distinct(), "name", "left_anti")
        parts = []
        for p in todo.select(*PARAMETERS).distinct().collect():
            same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(p[c])) for c in PARAMETERS])
            parts.append(self._transformed(todo.filter(same), self._inputs(levels, whole, todo.filter(same)), p.asDict()))
        if not parts:
            return kept
        rows = reduce(DataFrame.unionByName, parts).join(todo.select(F.col("name").alias("asset"), "_id", "frequency", "_start", "_end"), "asset")
        fresh = materialise(rows, "level")
        self.store.write_derived(fresh.select(F.col("_id").alias("name"), "frequency", "ts", F.col("value").alias("close"), F.col("_start").alias("range_start"), F.col("_end").alias("range_end")))
        fresh = fresh.select("asset", "ts", "value")
        return fresh if kept is None else fresh.unionByName(kept)

    def _transformed(self, specs: DataFrame, values: DataFrame, p: dict) -> DataFrame:
        def rows_of(source: Column) -> DataFrame:
            """Rows of the sources under the names of what is computed from them."""
            named = specs.select(F.col("name"), source.alias("asset"))
            return values.join(named, "asset").select(F.col("name").alias("asset"), "ts", "value")

        if p["transformation"] == "difference":
            require_none(specs.filter(F.coalesce(F.size("sources") != 2, F.lit(True))).select("name"), "difference requires two sources")
            return TRANSFORMATIONS["difference"](rows_of(F.get("sources", F.lit(0))), rows_of(F.get("sources", F.lit(1)))).select("asset", "ts", "value")
        require_none(specs.filter("source_variable IS NULL").select("name"), "a transformation requires 'source_variable'")
        options = {k: p[k] for k in ("window", "annualised") if p[k] is not None}
        if p["transformation"] in ("yoy_pct_change", "rolling_vol"):
            options["frequency"] = p["frequency"]
        return TRANSFORMATIONS[p["transformation"]](rows_of(F.col("source_variable")), **options).select("asset", "ts", "value")
