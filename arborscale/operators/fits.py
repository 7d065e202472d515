"""Allometric fits by group with fallback, predictions from them, and robust statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborscale.functions import ordered
from arborscale.functions.groups import join_back
from arborscale.functions.lineage import checkpointed
from arborscale.operators import stored
from arborscale.operators.rollups import ols


def fallback_class(species: Column, form: Column) -> Column:
    """Which pooled fit a tree may fall back on."""
    return F.when(species.isNull(), "none").when(form == "palm", "none").when(form == "conifer", "Gymnosperm").when(form.isNotNull(), "Angiosperm").otherwise("all")


def passes(n: int, b: tuple[float, float], r2: float, x_max: float) -> Column:
    """The gate of a fit: points enough, a plausible slope, some explained variance and some range."""
    return (F.col("n") >= n) & F.col("b").between(*b) & (F.col("r2") >= r2) & (F.col("x_max") >= x_max)


def log_log_fits(rows: DataFrame, levels: Sequence[Sequence[str]], x: Column, y: Column, gate: Column) -> DataFrame:
    """Fits of log10 y on log10 x at several grains in one table: ``level``, ``taxon`` and the fit with ``ok``.

    Each row is exploded to its taxon at each grain, so all grains share one aggregation."""
    taxa = F.array(*[F.struct(F.lit(name).alias("level"), (F.concat_ws("|", *cols) if cols else F.lit("*")).alias("taxon")) for name, *cols in levels])
    keyed = rows.where((x > 0) & (y > 0)).select(F.log10(x).alias("lx"), F.log10(y).alias("ly"), F.explode(taxa).alias("k"))
    fits = ols(keyed.select("lx", "ly", "k.level", "k.taxon"), ["level", "taxon"], F.col("lx"), F.col("ly"))
    return fits.withColumn("ok", F.coalesce(gate, F.lit(False)))


def pick_fit(rows: DataFrame, fits: DataFrame, levels: Sequence[Sequence[str]], never: Column) -> DataFrame:
    """Rows with the first passing fit of their levels in order (``fit_level``, ``a``, ``b``, ``sigma``, ``x_max``)."""
    out = rows
    choice = []
    for name, *cols in levels:
        f = fits.where((F.col("level") == name) & F.col("ok")).select(F.col("taxon").alias(f"t_{name}"), F.struct(F.lit(name).alias("fit_level"), "a", "b", "sigma", "x_max").alias(f"f_{name}"))
        out = out.join(f, (F.concat_ws("|", *cols) if cols else F.lit("*")) == F.col(f"t_{name}"), "left").drop(f"t_{name}")
        choice.append(F.col(f"f_{name}"))
    fit = F.when(~never, F.coalesce(*choice))
    return out.withColumn("fit_", fit).select(*rows.columns, "fit_.*")


def trimmed_fits(rows: DataFrame, levels: Sequence[Sequence[str]], x: Column, y: Column, gate: Column, stop, rounds: int = 2, sigmas: float = 3.0) -> DataFrame:
    """Fit, keep the points within some deviations of their chosen fit, and fit again.

    Only fits are checkpointed by ``stop``, small tables; the points that are kept follow from them and are read again in each round."""
    kept = rows.where((x > 0) & (y > 0))
    fits = stop(log_log_fits(kept, levels, x, y, gate))
    for _ in range(rounds):
        chosen = pick_fit(kept, fits, levels, F.lit(False))
        near = F.col("fit_level").isNull() | (F.abs(F.log10(y) - F.col("a") - F.col("b") * F.log10(x)) <= sigmas * F.col("sigma"))
        kept = chosen.where(near).select(*rows.columns)
        fits = stop(log_log_fits(kept, levels, x, y, gate))
    return fits


def scale(a: Column, sigma: Column) -> Column:
    """Bias-corrected scale of a fit in log10."""
    return F.pow(F.lit(10.0), a + sigma * sigma * F.ln(F.lit(10.0)) / 2)


def diameter_from_age(rows: DataFrame, age: Column) -> DataFrame:
    """The diameter of the chosen fit at an age held to 1 year and the largest fitted one, with where it comes from."""
    held = F.greatest(F.lit(1.0), F.least(age, F.pow(F.lit(10.0), F.col("x_max"))))
    return rows.withColumn("predicted_dbh", scale(F.col("a"), F.col("sigma")) * F.pow(held, F.col("b"))).withColumn("dbh_source", F.when(F.col("dbh").isNotNull(), "observed").when(F.col("predicted_dbh").isNotNull(), F.concat(F.lit("fit:"), "fit_level")))


def two_segment(scale_: Column, b: Column, dbh: Column, most: Column, tail: Column) -> Column:
    """A power law up to the largest fitted diameter and one with the tail's exponent from there on."""
    return scale_ * F.pow(F.least(dbh, most), b) * F.pow(F.greatest(dbh / most, F.lit(1.0)), tail)


def predicted_height(dbh: Column, a: Column, b: Column, sigma: Column, x_max: Column) -> Column:
    """Height by the chosen fit of height on diameter; the diameter is held between 1 and the largest fitted one. Trees
    without a fit, such as palms, have none."""
    held = F.when(dbh.isNotNull(), F.greatest(F.least(dbh, F.pow(F.lit(10.0), x_max)), F.lit(1.0)))
    return scale(a, sigma) * F.pow(held, b)


def height_check(observed: Column, predicted: Column, sigma: Column, shaded: Column, measured: Column, sigmas: float = 3.0) -> Column:
    """Whether an observed height is ``unchecked`` (no measured stem or no prediction), ``shaded``, ``out_of_band`` or
    ``accepted``. The band is some deviations of the fit's own residual about the prediction without its bias
    correction."""
    edge = lambda k: F.pow(F.lit(10.0), k * sigma - sigma * sigma * F.log(F.lit(10.0)) / 2)
    out = (observed > predicted * edge(sigmas)) | (observed < predicted * edge(-sigmas))
    return F.when(observed.isNull(), None).when(~measured | predicted.isNull(), "unchecked").when(shaded, "shaded").when(out, "out_of_band").otherwise("accepted")


def height_verdict(observed: Column, predicted: Column, crown_radius: Column, low: float, high: float, shade: float) -> Column:
    """Whether an observed height is accepted, shaded, out of band or unchecked."""
    return F.when(observed.isNull(), None).when(predicted.isNull(), "unchecked").when((observed < predicted * low) & (crown_radius > shade * observed), "shaded").when((observed < predicted * low) | (observed > predicted * high), "out_of_band").otherwise("accepted")


def coefficients(taxa: DataFrame, fits: DataFrame, levels: Sequence[Sequence[str]], tail_level: str) -> DataFrame:
    """For each taxon the first passing fit from the finest grain up, with the tail exponent of its division."""
    chosen = pick_fit(taxa, fits, levels, F.lit(False))
    column = next(cols[0] for name, *cols in levels if name == tail_level)
    tail = fits.where(F.col("level") == tail_level).select(F.col("taxon").alias(column), F.col("b").alias("tail_b"))
    return chosen.join(tail, column, "left")


TAXA = ("genus", "family", "division")


def reference_coefficients(points: DataFrame, dbh: Column, radius: Column, passes: Column) -> DataFrame:
    """Crown coefficients from measured trees (``genus``, ``family``, ``division``): a row for each genus, each family and division whose fit
    passes, and ``global``. A genus has the first passing fit of genus, family, division and all.

    A row grows stems past its fit's ``dbh_max`` by the exponent ``tail_b`` of its division, or of all where that doesn't pass, up to
    ``tail_dbh_max``; a division's or the global row is its own tail. ``passes`` is a column of ``n``, ``b``, ``r2`` and ``x_max``; the global fit needn't
    pass. ``scale`` is exp(a + sigma^2 / 2). The trees are summed to moments of genera once; all levels are sums of those."""
    known = (dbh > 0) & (radius > 0)
    rollup = stored.Rollup("taxa", {c: F.col(c) for c in TAXA}, {"line": stored.Measure("moments", F.when(known, F.log(dbh)), F.when(known, F.log(radius)))})
    kinds = {c: kind for c, (kind, _) in rollup.columns().items()}
    moments = checkpointed(stored.partial(points, rollup))
    fit = F.struct("n", "b", F.exp(F.col("a") + F.col("sigma") ** 2 / 2).alias("scale"), "sigma", "r2", F.exp("x_max").alias("dbh_max"))

    def fits_by(*keys: str) -> DataFrame:
        named = moments if not keys else moments.where(F.col(keys[0]).isNotNull())
        return stored.line(stored.re_summed(named, list(keys), kinds), list(keys), "line").select(*[F.col(k).alias(f"{k}_of") for k in keys], fit.alias("fit"), F.coalesce(passes, F.lit(False)).alias("ok"))

    by = {k: fits_by(k).select(f"{k}_of", F.when(F.col("ok"), F.col("fit")).alias(f"{k}_fit")) for k in TAXA}
    every = F.broadcast(fits_by().select(F.col("fit").alias("global_fit")))  # one row
    taxa = moments.select(*TAXA).where("genus IS NOT NULL").groupBy("genus").agg(F.min(F.struct("family", "division")).alias("t")).select("genus", "t.*")
    homes = moments.where("family IS NOT NULL").groupBy("family").agg(F.min("division").alias("division"))
    rows = taxa.select(F.lit("genus").alias("level"), F.col("genus").alias("taxon"), *TAXA).unionByName(homes.select(F.lit("family").alias("level"), F.col("family").alias("taxon"), F.lit(None).cast("string").alias("genus"), "family", "division"))
    rows = rows.unionByName(moments.where("division IS NOT NULL").select("division").distinct().select(F.lit("division").alias("level"), F.col("division").alias("taxon"), *[F.lit(None).cast("string").alias(c) for c in TAXA[:2]], "division"))
    rows = rows.unionByName(moments.limit(1).select(F.lit("global").alias("level"), F.lit("all").alias("taxon"), *[F.lit(None).cast("string").alias(c) for c in TAXA]))
    for k, fits_ in by.items():
        rows = rows.join(fits_, F.col(k) == F.col(f"{k}_of"), "left").drop(f"{k}_of")
    rows = rows.crossJoin(every)
    own = F.coalesce(*[F.when(F.col(f"{k}_fit").isNotNull(), F.struct(F.lit(k).alias("fit_level"), F.col(k).alias("fit_taxon"), F.col(f"{k}_fit").alias("fit"))) for k in TAXA], F.struct(F.lit("global").alias("fit_level"), F.lit("all").alias("fit_taxon"), F.col("global_fit").alias("fit")))
    chosen = rows.withColumn("own", own).where((F.col("level") == "genus") | (F.col("level") == F.col("own.fit_level")))
    tail = F.coalesce(F.when(F.col("division_fit").isNotNull(), F.struct(F.col("division").alias("taxon"), F.col("division_fit").alias("fit"))), F.struct(F.lit("all").alias("taxon"), F.col("global_fit").alias("fit")))
    bent = F.col("own.fit_level").isin("genus", "family")
    end = F.when(bent, F.struct(tail["taxon"].alias("tail_taxon"), tail["fit"]["b"].alias("tail_b"), F.greatest(tail["fit"]["dbh_max"], F.col("own.fit.dbh_max")).alias("tail_dbh_max")))
    end = end.otherwise(F.struct(F.col("own.fit_taxon").alias("tail_taxon"), F.col("own.fit.b").alias("tail_b"), F.col("own.fit.dbh_max").alias("tail_dbh_max")))
    return chosen.select("level", "taxon", "family", "division", "own.fit_level", "own.fit_taxon", "own.fit.*", end.alias("end")).select("*", "end.*").drop("end")


def crown_widths(trees: DataFrame, coefficients_: DataFrame, dbh: Column) -> DataFrame:
    """Trees (``genus``, ``division``) with ``crown_width`` and the ``crown_level`` and ``crown_taxon`` of the fit that gave it: the row of the genus, else
    of the division, else the global one. The width follows the fit up to its largest stem, the tail's exponent up to the tail's,
    and stays there; stems under 1 count as 1; no diameter gives no width."""
    values = F.struct("fit_level", "fit_taxon", "scale", "b", "dbh_max", "tail_b", "tail_dbh_max")
    of = lambda level: coefficients_.where(F.col("level") == level).select(F.col("taxon").alias(f"{level}_row"), values.alias(f"{level}_fit"))
    out = trees.join(of("genus"), F.col("genus") == F.col("genus_row"), "left").join(of("division"), F.col("division") == F.col("division_row"), "left").crossJoin(F.broadcast(of("global")))
    c = F.coalesce("genus_fit", "division_fit", "global_fit")
    held = F.least(F.greatest(dbh, F.lit(1.0)), c["tail_dbh_max"])
    width = F.when(dbh.isNotNull(), 2 * two_segment(c["scale"], c["b"], held, c["dbh_max"], c["tail_b"]))
    return out.select(*trees.columns, width.alias("crown_width"), F.when(width.isNotNull(), c["fit_level"]).alias("crown_level"), F.when(width.isNotNull(), c["fit_taxon"]).alias("crown_taxon"))


def average_ranks(rows: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """The mean rank of ties, from counts of the distinct values."""
    by_value = rows.groupBy(*keys, value).agg(F.count("*").alias("n_"))
    if not keys:
        upto = ordered.scanned(by_value, [value], sums={"upto_": "n_"})
        return join_back(rows, upto.withColumn(name, F.col("upto_") - F.col("n_") + (F.col("n_") + 1) / 2).drop("n_", "upto_"), [value])
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_value.withColumn(name, F.coalesce(F.sum("n_").over(w), F.lit(0)) + (F.col("n_") + 1) / 2).drop("n_")
    return join_back(rows, ranks, [*keys, value])


def correlations(rows: DataFrame, x: str, y: str, keys: Sequence[str] = (), least: int = 6) -> DataFrame:
    """Pearson and Spearman correlation by group; null under some rows or where one side is constant."""
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(average_ranks(full, x, "rx_", keys), y, "ry_", keys)
    fine = (F.count("*") >= least) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when(fine, F.corr(x, y)).alias("pearson"), F.when(fine, F.corr("rx_", "ry_")).alias("spearman"))


def block_bootstrap(rows: DataFrame, tile: str, replicates: int, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Resample whole tiles with replacement: for each replicate as many hash-drawn tiles as there are, joined to their
    rows; the difference of two Spearman correlations in each, and its 95 % limits."""
    tiles = ordered.positions(rows.select(tile).distinct(), "at", tile)
    n = tiles.count()
    draw = lambda r, i: F.floor(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("draw"), r, i)), 1, 8), 16, 10).cast("double") / 4294967296.0 * n).cast("long")
    drawn = rows.sparkSession.range(replicates * n).select(F.floor(F.col("id") / max(n, 1)).alias("replicate"), F.col("id").alias("i")).withColumn("at", draw(F.col("replicate"), F.col("i")))
    sample = drawn.join(tiles, "at").join(rows, tile)
    (x1, y1), (x2, y2) = pairs
    one = correlations(sample, x1, y1, ["replicate"]).select("replicate", F.col("spearman").alias("s1"))
    two = correlations(sample, x2, y2, ["replicate"]).select("replicate", F.col("spearman").alias("s2"))
    return one.join(two, "replicate").agg(F.count("*").alias("replicates"), F.percentile(F.col("s1") - F.col("s2"), F.lit(0.025)).alias("low"), F.percentile(F.col("s1") - F.col("s2"), F.lit(0.975)).alias("high"))


def offset_modes(pairs: DataFrame, top: int, size: float = 1.0) -> DataFrame:
    """Per group the most frequent rounded displacements (``dx``, ``dy``), refined to the medians of their members."""
    r = lambda c: F.floor(F.col(c) / size + 0.5).cast("long")
    binned = pairs.withColumn("bx", r("dx")).withColumn("by", r("dy"))
    n = binned.groupBy("group", "bx", "by").agg(F.count("*").alias("n"), F.percentile("dx", F.lit(0.5)).alias("mx"), F.percentile("dy", F.lit(0.5)).alias("my"))
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "bx", "by"))
    return n.withColumn("place", rank).where(F.col("place") <= top)
