"""Cleaning of tree records: column expressions over whole tables and joins with small maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def mapping(df: DataFrame, pairs: Mapping, key: str, value: str) -> DataFrame:
    """A small table of a map, for broadcast joins."""
    return df.sparkSession.createDataFrame(list(pairs.items()), f"{key} string, {value} string")


def enforce_schema(df: DataFrame, spec: Mapping[str, str], required: Sequence[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The columns of ``spec`` with its types, missing ones as typed nulls, and a report of one row with the number of
    values that no cast could keep (``lossy_<column>``) and of nulls in required columns (``null_<column>``).

    ``strict`` makes the job that reads the table fail at a value that no cast could keep."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    cast = {c: F.col(c).try_cast(t) for c, t in spec.items() if c in df.columns}
    lost = lambda c: F.raise_error(F.concat(F.lit(f"{c} can't be {spec[c]}: "), F.col(c).cast("string"))).cast(spec[c])
    kept = {c: F.when(F.col(c).isNotNull() & x.isNull(), lost(c)).otherwise(x) if strict else x for c, x in cast.items()}
    out = df.select(*[kept[c].alias(c) if c in cast else F.lit(None).cast(t).alias(c) for c, t in spec.items()])
    report = df.agg(
        *[F.count_if(F.col(c).isNotNull() & cast[c].isNull()).alias(f"lossy_{c}") for c in cast],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
    )
    return out, report


def species_text(c: Column) -> Column:
    """Cut at ``::`` or a spaced dash; the first word with a capital, the rest small; blank is null."""
    cut = F.trim(F.regexp_replace(c, r"(::| - ).*$", ""))
    return F.nullif(F.concat(F.upper(F.substring(cut, 1, 1)), F.lower(cut.substr(F.lit(2), F.length(cut)))), F.lit(""))


def binomial(genus: Column, epithet: Column) -> Column:
    """Genus and epithet as one name; no genus gives null, no epithet the genus alone."""
    g, e = blank_to_null(genus), blank_to_null(epithet)
    return F.when(g.isNotNull(), F.concat_ws(" ", g, e))


def is_non_tree(c: Column, markers: Sequence[str], prefixes: Sequence[str]) -> Column:
    """Whether a label names no tree: one of the markers, or it starts with a prefix, after small letters, accents
    taken off and a final ``(s)`` stripped."""
    folded = F.translate(F.lower(F.trim(c)), "áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")
    plain = F.regexp_replace(folded, r"\(s\)$", "")
    starts = [plain.startswith(p) for p in prefixes]
    found = plain.isin(*markers)
    for s in starts:
        found = found | s
    return F.coalesce(found, F.lit(False))


def accepted_shape(c: Column) -> Column:
    """A name cut to genus and epithet: parentheses dropped, ``sp.`` and the like give the genus alone, a hybrid keeps
    its mark, names of other shapes are null."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"\s+", " "))
    hybrid = F.regexp_extract(plain, r"^([A-Z][a-z]+ [x×] [a-z]+(?:-[a-z]+)?)\b", 1)
    species = F.regexp_extract(plain, r"^([A-Z][a-z]+ (?!spp?\b)[a-z]{2,}(?:-[a-z]+)?)\b", 1)
    genus = F.regexp_extract(plain, r"^([A-Z][a-z]+)(?: spp?\.?)?$", 1)
    return F.when(hybrid != "", F.regexp_replace(hybrid, "×", "x")).when(species != "", species).when(genus != "", genus)


def mapped(df: DataFrame, column: str, pairs: Mapping, into: str | None = None, default: Column | None = None) -> DataFrame:
    """Fold values by a small map; values that it lacks stay, or become ``default``."""
    table = mapping(df, pairs, "map_key", "map_value")
    rest = df[column] if default is None else default
    joined = df.join(F.broadcast(table), df[column] == table["map_key"], "left")
    return joined.withColumn(into or column, F.coalesce("map_value", rest)).drop("map_key", "map_value")


def quoted_cultivar(name: Column, supplied: Column) -> Column:
    """The supplied cultivar, or the first quoted run of the name; a quote may stay open."""
    plain = F.translate(name, "‘’“”", "''''")
    return F.coalesce(blank_to_null(supplied), blank_to_null(F.regexp_extract(plain, r"'([^']+)", 1)))


def within(c: Column, low: float, high: float) -> Column:
    """The value where it lies over ``low`` and not over ``high``, else null."""
    return F.when((c > low) & (c <= high), c)


def null_implausible(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """Numbers that lie outside their range as nulls (NaN too), and one row with how many of each column became null
    (``nulled_<column>``)."""
    kept = {c: within(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)), *r) for c, r in ranges.items()}
    return df.withColumns(kept), df.agg(*[F.count_if(F.col(c).isNotNull() & x.isNull()).alias(f"nulled_{c}") for c, x in kept.items()])


def leading_year(c: Column) -> Column:
    """The year of a text that begins with four digits, such as ``1998``, ``1998-05`` or ``1998?``."""
    return F.regexp_extract(F.trim(c), r"^(\d{4})(?!\d)", 1).try_cast("int")


def unknown_labels(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Labels that a map lacks, with their rows."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*known)).groupBy(column).agg(F.count("*").alias("rows"))


def plausible_date(c: Column, today: Column) -> Column:
    return F.when((F.year(c) >= 1500) & (c <= today), c)


def null_repeated(df: DataFrame, column: str, most: int = 3) -> DataFrame:
    """Null the values that stand on more than ``most`` rows.

    The repeats are found by an aggregate first, so a name on a third of all rows never gathers in one task."""
    often = df.groupBy(F.col(column).alias("often")).count().where((F.col("count") > most) & F.col("often").isNotNull()).select("often")
    return df.join(often, df[column] == often["often"], "left").withColumn(column, F.when(F.col("often").isNull(), F.col(column))).drop("often")


def year_date(year: Column) -> Column:
    """The first of January of a positive year."""
    return F.when(year > 0, F.make_date(year, F.lit(1), F.lit(1)))


def circumference_cm_to_inches(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0)) / F.pi() / 2.54


def cm_to_inches(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0)) / 2.54


def measurement_m(c: Column, bare_cm_over: float) -> Column:
    """A length in metres from text such as ``1,2 m``, ``120 cm`` or a bare number, which is taken for centimetres
    from ``bare_cm_over`` on."""
    text = F.lower(F.trim(c))
    number = F.regexp_replace(F.regexp_extract(text, r"^(\d+(?:[.,]\d+)?)", 1), ",", ".").try_cast("double")
    unit = F.regexp_extract(text, r"^\d+(?:[.,]\d+)?\s*([a-z]*)", 1)
    bare = F.when(number > bare_cm_over, number / 100).otherwise(number)
    return F.when(unit == "m", number).when(unit == "cm", number / 100).when(unit == "mm", number / 1000).when(unit == "ft", number * 0.3048).when(unit == "", bare)


def free_text(c: Column, most: int) -> Column:
    """White space collapsed, cut at ``most`` characters, blank as null."""
    return F.nullif(F.rtrim(F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(most))), F.lit(""))


def gated_label(species: Column, p_species: Column, genus: Column, p_genus: Column, habit: Column, least: float = 0.8) -> Column:
    """The finest label that is sure enough: species, genus, or what the leaf habit says."""
    by_habit = F.when(habit == "deciduous", "Unknown deciduous").when(habit == "evergreen", "Unknown evergreen")
    return F.coalesce(F.when(p_species >= least, species), F.when(p_genus >= least, genus), by_habit)


def source_kind(label: Column, notable: bool = True) -> Column:
    """The kind of a source by the prefix of its label."""
    found = F.when(label.startswith("COMMUNITY_"), "community").when(label.startswith("SATELLITE_"), "satellite").when(label.startswith("OSM_"), "osm").when(label.startswith("PREDICTED_"), "predicted")
    if notable:
        found = found.when(label.startswith("NOTABLE_"), "notable")
    return found.otherwise("municipal")


#: A quoted run at word edges: an apostrophe inside a word opens no quote.
QUOTED = r"""(?<![^ ])(?:'[^']+'|"[^"]+"|‘[^’]+’)(?=[ ,;)]|$)"""


def common_name(name: Column, proper_words: Sequence[str] = (), proper_phrases: Sequence[str] = ()) -> Column:
    """A name in sentence case with one space between words: quoted cultivars stay as written (those all in capitals get
    one capital a word), proper words and phrases get their own spelling, the first letter outside of a quote that opens
    the name is a capital. Blank is null."""
    text = F.trim(F.regexp_replace(name, r"\s+", " "))
    spelling = F.create_map(*[F.lit(w) for p in proper_words for w in (p.lower(), p)]) if proper_words else None

    def span(s: Column) -> Column:
        low = F.lower(s)
        for phrase in sorted(proper_phrases, key=len, reverse=True):
            words = r"\b" + phrase.lower().replace(".", r"\.") + r"(?!\p{L})"
            low = F.regexp_replace(low, words, phrase)
        if spelling is None:
            return low
        return F.array_join(F.transform(F.regexp_extract_all(low, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda w: F.coalesce(F.try_element_at(spelling, F.lower(w)), w)), "")

    shout = lambda s: F.concat(F.left(s, F.lit(1)), F.initcap(s.substr(F.lit(2), F.length(s))))
    quoted = lambda s: F.when(s == F.upper(s), shout(s)).otherwise(s)
    spans = F.regexp_extract_all(text, F.lit(f"{QUOTED}|(?:(?!{QUOTED}).)+"), F.lit(0))
    joined = F.array_join(F.transform(spans, lambda s: F.when(s.rlike(f"^(?:{QUOTED})$"), quoted(s)).otherwise(span(s))), "")
    first = F.regexp_extract(joined, r"^[^\p{L}]*", 0)
    at = F.length(first) + 1
    capital = F.concat(first, F.upper(joined.substr(at, F.lit(1))), joined.substr(at + 1, F.length(joined)))
    return F.nullif(F.when(text.rlike(f"^{QUOTED}"), joined).otherwise(capital), F.lit(""))


def common_names(names: Column, proper_words: Sequence[str] = (), proper_phrases: Sequence[str] = ()) -> Column:
    """The names of a list by ``common_name``; blanks and repeats (whatever the case) dropped, in order."""
    clean = F.filter(F.transform(names, lambda n: common_name(n, proper_words, proper_phrases)), lambda n: n.isNotNull())
    none = F.array().cast("array<string>")
    return F.aggregate(clean, none, lambda seen, n: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(n)), seen).otherwise(F.array_append(seen, n)))


def slugs(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """A ``slug`` of each name: small letters and dashes; from the second of equal ones on with the least number from 2
    that neither a name of its own (``elm 2`` beside two ``elm``) nor an earlier one takes, so that no slug repeats."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    rank = F.row_number().over(Window.partitionBy("plain").orderBy(*order))
    named = df.withColumn("plain", plain)
    number = F.regexp_extract("plain", r"-([1-9]\d{0,8})$", 1).try_cast("long")
    taken = named.select("plain").distinct().withColumn("no_", number).where("no_ >= 2")
    taken = taken.groupBy(F.regexp_replace("plain", r"-\d+$", "").alias("plain")).agg(F.sort_array(F.collect_set("no_")).alias("taken_"))
    free = F.aggregate(F.coalesce("taken_", F.array().cast("array<bigint>")), F.col("rank").cast("long"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    out = named.withColumn("rank", rank).join(taken, "plain", "left")
    return out.withColumn("slug", F.when(F.col("rank") == 1, F.col("plain")).otherwise(F.concat_ws("-", F.col("plain"), free))).drop("plain", "rank", "taken_")


def any_of_each(df: DataFrame, choices: Mapping[str, Sequence]) -> DataFrame:
    """Rows that match one of the choices in every field that has any."""
    for field, values in choices.items():
        if values:
            df = df.where(F.col(field).isin(*values))
    return df


def rule_colours(df: DataFrame, matches: Column, colour: Column, known: DataFrame) -> DataFrame:
    """Trees that match a rule with one colour each, without those already known."""
    return df.where(matches).groupBy("tree_id").agg(F.min(colour).alias("colour")).join(known.select("tree_id"), "tree_id", "left_anti")


#: From this distance to the equator in degrees on, the northern months without leaves and in autumn.
SEASONS = [
    (0, [], []),
    (24, [1], [11, 12]),
    (28, [12, 1, 2], [10, 11]),
    (34, [12, 1, 2, 3], [9, 10, 11]),
    (55, [11, 12, 1, 2, 3, 4], [9, 10]),
]


def foliage_phase(latitude: Column, month: Column) -> Column:
    """Phase of the leaves of deciduous trees, ``bare``, ``autumn`` or ``growing``, by whole degree of latitude and month;
    the southern year is half a year ahead, no latitude counts as the equator."""
    known = latitude.isNotNull() & ~F.isnan(latitude)
    degree = F.when(known, F.greatest(F.least(F.floor(latitude), F.lit(90)), F.lit(-90))).otherwise(0)
    away = F.when(degree >= 0, degree).otherwise(-degree - 1)
    northern = F.when(degree < 0, (month + 5) % 12 + 1).otherwise(month)
    phase = F.lit("growing")
    for start, bare, autumn in SEASONS:
        if bare:
            phase = F.when(away < start, phase).when(northern.isin(*bare), "bare").when(northern.isin(*autumn), "autumn").otherwise("growing")
    return phase


def leaf_off_months(latitude: Column) -> Column:
    """The months without leaves at a latitude as bits, January the lowest."""
    return sum((F.when(foliage_phase(latitude, F.lit(m)) == "bare", 1 << (m - 1)).otherwise(0) for m in range(1, 13)), F.lit(0))


def decoded(df: DataFrame, column: str, codes: Mapping[str, str]) -> DataFrame:
    """Stored codes as display names in ``<column>_name``; unknown codes give null and are flagged."""
    out = mapped(df, column, codes, f"{column}_name", F.lit(None).cast("string"))
    return out.withColumn("undecoded", F.col(column).isNotNull() & F.col(f"{column}_name").isNull())


def overridden(labels: DataFrame, overrides: DataFrame, key: str, accepted: DataFrame) -> DataFrame:
    """Labels with overriding species in place, if these are among the accepted ones; the genus follows the species."""
    new = overrides.join(accepted.select("species").distinct(), "species", "left_semi").select(F.col(key).alias("o_key"), F.col("species").alias("o_species"))
    joined = labels.join(new, labels[key] == F.col("o_key"), "left").withColumn("species", F.coalesce("o_species", "species")).drop("o_key", "o_species")
    return joined.withColumn("genus", F.split_part("species", F.lit(" "), F.lit(1)))


def shades(deciduous: Column, phase: Column, fall: Column, green: Column, trunk: Column) -> Column:
    """The list of shades that a species shows: trunk when bare, fall colours in autumn if deciduous, else green."""
    return F.when(phase == "bare", F.array(trunk)).when(deciduous & (phase == "autumn") & (F.size(fall) > 0), fall).otherwise(green)
