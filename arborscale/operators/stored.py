"""Stored rollups: partial aggregates at recorded grains that answer coarser questions.

A store is a folder of Parquet tables with a catalogue of each generation, written last. A question names the columns that it
groups and filters by and the measures that it wants; the smallest rollup that has them all is re-summed, and the rows
themselves are read only if none has. New rows are summed by themselves and merged."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborscale.functions import folders

#: How partials of each kind of measure become one. ``moments`` are the sums that a straight line needs.
_MERGE = {"count": F.sum, "sum": F.sum, "least": F.min, "greatest": F.max}
_MOMENTS = {"n": "count", "x": "sum", "y": "sum", "xx": "sum", "yy": "sum", "xy": "sum", "x_max": "greatest"}


@dataclass(frozen=True)
class Measure:
    """``count`` of rows that fulfil a condition (or all), ``sum``, ``least``, ``greatest`` of a value, or ``moments`` of two."""

    kind: str
    value: Column | None = None
    other: Column | None = None

    def parts(self, name: str) -> dict[str, tuple[str, Column | None]]:
        """Stored columns with their kinds and the rows' values."""
        if self.kind != "moments":
            return {name: (self.kind, self.value)}
        both = self.value.isNotNull() & self.other.isNotNull()
        x, y = F.when(both, self.value), F.when(both, self.other)
        values = {"n": both, "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y, "x_max": x}
        return {f"{name}_{k}": (kind, values[k]) for k, kind in _MOMENTS.items()}


@dataclass(frozen=True)
class Rollup:
    name: str
    grain: Mapping[str, Column]
    measures: Mapping[str, Measure]

    def columns(self) -> dict[str, tuple[str, Column | None]]:
        return {c: p for name, m in self.measures.items() for c, p in m.parts(name).items()}


def partial(rows: DataFrame, rollup: Rollup) -> DataFrame:
    """The rollup of some rows. Null keys are groups like others."""
    total = {"count": lambda v: F.count("*") if v is None else F.count_if(v), "sum": F.sum, "least": F.min, "greatest": F.max}
    return rows.groupBy(*[c.alias(k) for k, c in rollup.grain.items()]).agg(*[total[kind](v).alias(c) for c, (kind, v) in rollup.columns().items()])


def re_summed(partials: DataFrame, keys: Mapping[str, Column] | Sequence[str], kinds: Mapping[str, str]) -> DataFrame:
    """Partials by coarser keys. Without keys there is one row, also of no partials, whose counts are 0."""
    columns = [c.alias(k) for k, c in keys.items()] if isinstance(keys, Mapping) else list(keys)
    merge = lambda c, kind: F.coalesce(F.sum(c), F.lit(0)) if kind == "count" else _MERGE[kind](c)
    return partials.groupBy(*columns).agg(*[merge(c, kind).alias(c) for c, kind in kinds.items()])


def line(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The least squares of merged ``moments``: ``n``, slope ``b``, intercept ``a``, ``sigma``, ``r2``, ``x_max``, as ``rollups.ols`` gives them."""
    n, x, y, xx, yy, xy = (F.col(f"{name}_{k}") for k in ("n", "x", "y", "xx", "yy", "xy"))
    m = df.where(n > 0).withColumns({"sxx": xx - x * x / n, "syy": yy - y * y / n, "sxy": xy - x * y / n, "n": n})
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    left = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    fit = F.when((F.col("syy") > 0) & (F.col("sxx") > 0), F.col("sxy") ** 2 / F.col("sxx") / F.col("syy"))
    return m.select(*keys, "n", slope.alias("b"), ((y - slope * x) / n).alias("a"), F.when(F.col("n") > 2, F.sqrt(left / (F.col("n") - 2))).alias("sigma"), fit.alias("r2"), F.col(f"{name}_x_max").alias("x_max"))


class Store:
    """Rollups of one table under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def generation(self) -> int:
        """The last one whose catalogue is complete; 0 before the first."""
        done = [int(n.removeprefix("catalogue-")) for n in folders.names(self.spark, self.path) if n.startswith("catalogue-") and folders.exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return max(done, default=0)

    def catalogue(self) -> DataFrame:
        """``name``, ``grain``, ``measures`` (stored columns with their kinds), ``rows`` and ``path`` of each rollup."""
        if not (generation := self.generation()):
            raise FileNotFoundError(f"no rollups are stored in {self.path}")
        return self.spark.read.parquet(f"{self.path}/catalogue-{generation}")

    def _commit(self, tables: Mapping[str, tuple[Sequence[str], Mapping[str, str], DataFrame]]) -> None:
        """Write tables in folders of their own, then the catalogue: until that is complete, readers see the last generation."""
        generation, rows = self.generation() + 1, []
        for name, (grain, kinds, df) in tables.items():
            place = f"{self.path}/{name}-{generation}-{uuid.uuid4().hex}"
            df.write.parquet(place)
            rows.append((name, list(grain), dict(kinds), self.spark.read.parquet(place).count(), place))
        schema = "name string, grain array<string>, measures map<string,string>, rows long, path string"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/catalogue-{generation}")

    def build(self, rows: DataFrame, rollups: Sequence[Rollup]) -> None:
        self._commit({r.name: (list(r.grain), {c: kind for c, (kind, _) in r.columns().items()}, partial(rows, r)) for r in rollups})

    def add(self, rows: DataFrame, rollups: Sequence[Rollup]) -> None:
        """Merge rows that no rollup has seen; all rollups change together."""
        known = {r["name"]: r for r in self.catalogue().collect()}
        tables = {}
        for r in rollups:
            kinds = {c: kind for c, (kind, _) in r.columns().items()}
            old = known.get(r.name)
            if old is None or set(old["grain"]) != set(r.grain) or old["measures"] != kinds:
                raise ValueError(f"{r.name} is stored with another grain or other measures")
            both = self.spark.read.parquet(old["path"]).unionByName(partial(rows, r))
            tables[r.name] = (list(r.grain), kinds, re_summed(both, list(r.grain), kinds))
        if missing := set(known) - set(tables):
            raise ValueError(f"rows must go to all rollups; not given: {sorted(missing)}")
        self._commit(tables)

    def covering(self, columns: Sequence[str], measures: Sequence[str]):
        """The catalogue's row of the smallest rollup with these columns and measures, or None. The catalogue has a row a rollup."""
        has = lambda r: set(columns) <= set(r["grain"]) and all(m in r["measures"] or f"{m}_n" in r["measures"] for m in measures)
        return min((r for r in self.catalogue().collect() if has(r)), key=lambda r: (r["rows"], r["name"]), default=None)

    def answer(self, keys: Mapping[str, Column], using: Sequence[str], measures: Sequence[str], where: Column | None = None, scan: tuple[DataFrame, Rollup] | None = None) -> DataFrame:
        """Measures by keys that are computed from the columns ``using``, of the partials that fulfil ``where``. If no rollup covers
        the question it is put to ``scan``, the rows and a rollup that does; without one it is an error."""
        found = self.covering(using, measures)
        if found is not None:
            stored, known = self.spark.read.parquet(found["path"]), found["measures"]
        elif scan is not None:
            stored, known = partial(*scan), {c: kind for c, (kind, _) in scan[1].columns().items()}
        else:
            raise LookupError(f"no stored rollup has {sorted(using)} with {sorted(measures)}")
        kinds = {c: known[c] for m in measures for c in sorted(known) if c == m or c in {f"{m}_{k}" for k in _MOMENTS}}
        return re_summed(stored if where is None else stored.where(where), keys, kinds)

    def prune(self, keep: int = 2) -> None:
        """Delete what no catalogue of the last ``keep`` generations names."""
        last = self.generation()
        kept = {f"catalogue-{g}" for g in range(last - keep + 1, last + 1)}
        kept |= {r["path"].rsplit("/", 1)[-1] for c in kept if folders.exists(self.spark, f"{self.path}/{c}/_SUCCESS") for r in self.spark.read.parquet(f"{self.path}/{c}").collect()}
        for name in folders.names(self.spark, self.path):
            if name not in kept:
                folders.delete(self.spark, f"{self.path}/{name}")
