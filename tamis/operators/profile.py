"""Data profile: one row of measures per column, then labels, statistics and anomalies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions import fixed, text
from tamis.operators import frequency, quantiles
from tamis.operators.columns import (
    EXACT, FLAG, INTEGER, MOMENT, NESTED, NUMERIC, TEXT,
    ColumnRef, columns_of, families, melt, quoted,
)
from tamis.operators.duplicates import duplicate_rows
from tamis.operators.local import local_table
from tamis.operators.spread import held

# Rows looked at first for the examples; columns that need more are completed exactly.
PEEK_ROWS = 200

_TOP = "array<struct<valeur:string,occurrences:bigint>>"
_TABLE_ROW = -1  # index under which the measures of the whole table travel

CONCURRENT_JOBS = 4

EVERYTHING = ("examples", "duplicates", "top_values", "statistics", "outliers")

_FIELDS = (
    "c int", "nom string", "famille string",
    "manquantes bigint", "renseignees bigint", "distinctes bigint",
    "sans_blancs bigint", "sans_casse bigint",
    "minimum double", "maximum double", "moyenne double", "ecart_type double",
    "entiers boolean", "binaire boolean",
    "q25 double", "q50 double", "q75 double", "extremes bigint",
    f"modalites {_TOP}", "exemples array<string>",
    "nb_lignes bigint", "doublons bigint",
    *[f"{name} bigint" for name in frequency.COUNTERS],
)


# --- Measures -----------------------------------------------------------------------------


def measure(
    df: DataFrame,
    *,
    order_by: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    wanted: Sequence[str] = EVERYTHING,
    hold: bool = True,
) -> DataFrame:
    """Everything a profile and a detection are made of: one row per column, one for the table.

    The independent branches run as concurrent jobs.  What each brings back is one row per
    column of the table; cells never leave the executors, but for the examples and frequent
    values a profile displays.  Columns named in ``order_by`` give the row order (default: the
    order in which files are read).  ``hold`` keeps a small table in memory between the passes.
    """
    if not hold:
        return _measured(df, df, order_by, exclude, wanted)
    with held(df) as table:
        return _measured(df, table, order_by, exclude, wanted)


def _measured(
    df: DataFrame, table: DataFrame, order_by: Sequence[str] | None, exclude: Sequence[str], wanted: Sequence[str]
) -> DataFrame:
    refs = columns_of(df, exclude)
    branches = [lambda group=group: _value_branch(table, group, wanted) for group in families(refs)]
    numeric = [ref for ref in refs if ref.family in NUMERIC]
    if numeric and {"statistics", "outliers"} & set(wanted):
        branches.append(lambda: _numeric_branch(table, numeric, wanted))
    if "examples" in wanted:
        branches.append(lambda: [
            Row(c=index, exemples=values) for index, values in first_examples(df, refs, order_by).items()
        ])
    if "duplicates" in wanted:
        branches.append(lambda: duplicate_rows(table, exclude).withColumn("c", F.lit(_TABLE_ROW)).collect())

    return gathered(df.sparkSession, refs, branches)


def gathered(spark: SparkSession, refs: Sequence[ColumnRef], branches: Sequence[Callable[[], list[Row]]]) -> DataFrame:
    """The measures that some branches bring, run as concurrent jobs: one row per column, one for the table."""
    found = {ref.index: {"c": ref.index, "nom": ref.name, "famille": ref.family} for ref in refs}
    with ThreadPoolExecutor(CONCURRENT_JOBS) as pool:
        for rows in pool.map(lambda branch: branch(), branches):
            for row in rows:
                found.setdefault(row["c"], {"c": row["c"]}).update(row.asDict(recursive=True))
    return local_table(spark, found.values(), ", ".join(_FIELDS))


def _value_branch(df: DataFrame, group: Sequence[ColumnRef], wanted: Sequence[str]) -> list[Row]:
    """Measures read off the value-frequency table of one family of columns."""
    recounted = lambda refs: frequency.count_values(df, refs)
    return value_measures(counted(df, group), group, wanted, recounted, lambda: df)


def counted(df: DataFrame, group: Sequence[ColumnRef]) -> DataFrame:
    """The value-frequency table of one family of columns."""
    return frequency.count_texts(df, group) if group[0].family == TEXT else frequency.count_values(df, group)


def value_measures(
    values: DataFrame, group: Sequence[ColumnRef], wanted: Sequence[str],
    recounted: Callable[[Sequence[ColumnRef]], DataFrame], whole_table: Callable[[], DataFrame],
) -> list[Row]:
    """Measures read off a value-frequency table.

    ``recounted`` gives the values of some columns anew, ``whole_table`` the table, which only ties of long texts need.
    """
    family = group[0].family
    if family == TEXT:
        parts = [frequency.missing_counts(values), frequency.text_measures(values)]
        printed = values.select(
            "c", "v", "n", F.coalesce(F.col("long")["start"], F.col("v")).alias("rang"),
            F.coalesce(F.col("long")["shown"], F.col("v")).alias("montre"), F.col("long").isNotNull().alias("longue"),
        )
    else:
        whole, binary = _whole(family), _binary(family)
        measured = values.groupBy("c").agg(
            F.sum(F.greatest(-F.col("n"), F.lit(0).cast("long"))).alias("manquantes"),
            F.sum(F.greatest(F.col("n"), F.lit(0).cast("long"))).alias("renseignees"),
            F.count("v").alias("distinctes"),
            F.sum(F.when(_social_security(family), F.col("n")).otherwise(0)).cast("long").alias("motif_3"),
            F.bool_and(whole).alias("entiers"),
            F.bool_and(binary).alias("binaire"),
        )
        parts = [measured]
        printed = values.withColumn("v", F.col("v").cast("string")).withColumn("rang", F.col("v"))
        # Columns that carry statistics do not show their frequent values.
        listed = measured.where(F.col("entiers") & (F.col("binaire") | _near_unique())).select("c")
        if family == INTEGER:
            printed = printed.join(F.broadcast(listed), "c", "left_semi")
        elif family in NUMERIC:
            told = _merged(measured)
            return told + _listed_values(recounted, group, told, wanted)
    if "top_values" in wanted and family != NESTED:
        parts.append(_top_texts(printed) if family == TEXT else _top_values(printed))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _settled(whole_table, group, _merged(rows)) if family == TEXT else _merged(rows)


def _listed_values(
    recounted: Callable[[Sequence[ColumnRef]], DataFrame], group: Sequence[ColumnRef], told: Sequence[Row], wanted: Sequence[str]
) -> list[Row]:
    """Frequent values of real and decimal columns, which only the rare whole-valued ones show."""
    shown = {
        row["c"] for row in told
        if row.asDict().get("entiers") and row["renseignees"]
        and (row["binaire"] or row["distinctes"] / row["renseignees"] >= fixed.NUMERIC_IDENTIFIER_RATIO)
    } if "top_values" in wanted else set()
    if not shown:
        return []
    values = recounted([ref for ref in group if ref.index in shown])
    return _top_values(values.withColumn("v", F.col("v").cast("string")).withColumn("rang", F.col("v"))).collect()


def _whole(family: str) -> Column:
    """Whether a counted value is a whole number; decimals travel as text of a fixed scale."""
    if family == EXACT:
        return F.col("v").rlike(r"^-?[0-9]+(\.0*)?$")
    return F.col("v") % 1 == 0 if family in NUMERIC else F.lit(False)


def _binary(family: str) -> Column:
    if family == EXACT:
        return F.col("v").rlike(r"^[01](\.0*)?$")
    return F.col("v").isin(0, 1) if family in NUMERIC else F.lit(False)


def _numeric_branch(df: DataFrame, numeric: Sequence[ColumnRef], wanted: Sequence[str]) -> list[Row]:
    """Moments, quartiles and outliers: three passes over the numeric columns, no value shuffled."""
    numbers = melt(df, numeric, lambda ref: ref.number)
    return number_measures(numbers, _numeric_measures(numbers).collect(), wanted)


def number_measures(numbers: DataFrame, measured: list[Row], wanted: Sequence[str]) -> list[Row]:
    """The measured moments with quartiles and outliers, from rows (c, v double) or (c, v double, n)."""
    quartiles = quantiles.quartiles(numbers, measured)
    rows = [Row(**{k: v for k, v in row.asDict().items() if k != "cuts"}) for row in measured]
    rows += quartiles
    if "outliers" in wanted:
        rows += quantiles.outlier_counts(numbers, quartiles).collect()
    return rows


def _merged(rows: DataFrame) -> list[Row]:
    """The rows on the driver without their missing fields: a few per column."""
    return [Row(**{k: v for k, v in row.asDict().items() if v is not None}) for row in rows.collect()]


def _numeric_measures(numbers: DataFrame) -> DataFrame:
    """One row per numeric column, from rows (c, v double); nothing is shuffled but the result."""
    v = F.col("v")
    return quantiles.cuts_of(numbers.groupBy("c").agg(
        F.count("v").alias("renseignees"),
        F.min("v").alias("minimum"), F.max("v").alias("maximum"),
        F.avg("v").alias("moyenne"), F.stddev_pop("v").alias("ecart_type"),
        quantiles.bracket().alias("croquis"),
    ))


def _social_security(family: str) -> Column:
    """A whole number printed with 13 to 15 digits; no other pattern can match a number."""
    if family == EXACT:
        return F.col("v").rlike(r"^[1-9][0-9]{12,14}(\.0*)?$")
    if family != INTEGER:
        return F.lit(False)
    return F.col("v").between(F.lit(10**12), F.lit(10**15 - 1))


def _top_values(counted: DataFrame) -> DataFrame:
    """Rows (c, modalites): most frequent values first, equal counts in value order.

    Spark keeps five rows per column in every task before anything moves.
    """
    window = Window.partitionBy("c").orderBy(F.desc("n"), "rang", "v")
    best = (
        counted.where("n > 0")
        .select("c", "rang", "n", F.row_number().over(window).alias("place"))
        .where(F.col("place") <= fixed.TOP_VALUE_COUNT)
    )
    listed = F.array_sort(F.collect_list(F.struct("place", text.shown(F.col("rang")).alias("valeur"), "n")))
    return best.groupBy("c").agg(listed.alias("l")).select(
        "c",
        F.transform("l", lambda e: F.struct(e["valeur"].alias("valeur"), e["n"].alias("occurrences")))
        .cast(_TOP).alias("modalites"),
    )


def _top_texts(counted: DataFrame) -> DataFrame:
    """Rows (c, premieres): the first values of each text column, one more than are listed, long texts by their start.

    Where a long text ties with another value on count and start, ``debut`` holds the start. A long text is the first of its
    ties, so the one row more shows a tie that reaches over the last place.
    """
    start = F.substring("rang", 1, frequency.ORDER_LENGTH)
    window = Window.partitionBy("c").orderBy(F.desc("n"), "debut", F.desc("longue"), "rang", "v")
    best = (
        counted.where("n > 0").withColumn("debut", start)
        .select("c", "n", "debut", "longue", "montre", F.row_number().over(window).alias("place"))
        .where(F.col("place") <= fixed.TOP_VALUE_COUNT + 1)
    )
    ties = Window.partitionBy("c", "n", "debut")
    told = best.withColumn("lie", (F.count("*").over(ties) > 1) & F.max("longue").over(ties))
    listed = F.array_sort(F.collect_list(F.struct(
        "place", text.shown(F.col("montre")).alias("valeur"), "n", F.when(F.col("lie"), F.col("debut")).alias("debut"),
    )))
    return told.groupBy("c").agg(listed.alias("premieres"))


def _settled(whole_table: Callable[[], DataFrame], group: Sequence[ColumnRef], rows: list[Row]) -> list[Row]:
    """The rows with ``modalites`` for ``premieres``, ties of long texts settled by the whole texts."""
    keys = {(row["c"], e["n"], e["debut"]) for row in rows for e in row.asDict().get("premieres") or () if e["debut"] is not None}
    settled = _tied_texts(whole_table(), group, keys) if keys else {}
    out = []
    for row in rows:
        fields = row.asDict()
        if first := fields.pop("premieres", None):
            listed, done = [], set()
            for e in first:
                key = (row["c"], e["n"], e["debut"])
                if e["debut"] is None:
                    listed.append((e["valeur"], e["n"]))
                elif key not in done:
                    done.add(key)
                    listed += [(value, e["n"]) for value in settled[key]]
            fields["modalites"] = [Row(valeur=v, occurrences=n) for v, n in listed[: fixed.TOP_VALUE_COUNT]]
        out.append(Row(**fields))
    return out


def _tied_texts(df: DataFrame, group: Sequence[ColumnRef], keys: set[tuple]) -> dict[tuple, list[str]]:
    """The first values, as displayed, in whole order, of all that have one of a few (column, count, start).

    A second pass over the columns concerned. Texts of other starts stay where they are; of the others each distinct one
    moves once per task, and then five of each key.
    """
    wanted = F.broadcast(local_table(
        df.sparkSession, [{"de": c, "fois": n, "debut": start} for c, n, start in keys], "de int, fois bigint, debut string"
    ))
    starts = wanted.select("de", "debut").distinct()
    refs = [ref for ref in group if ref.index in {c for c, _, _ in keys}]
    found = (
        melt(df, refs).where("v is not null").withColumn("debut", F.substring("v", 1, frequency.ORDER_LENGTH))
        .join(F.broadcast(starts.withColumnRenamed("debut", "un")), (F.col("c") == F.col("de")) & (F.col("debut") == F.col("un")), "left_semi")
        .groupBy("c", "debut", text.short_key(F.col("v")).alias("cle")).agg(F.count("*").alias("n"), F.min("v").alias("v"))
    )
    matched = found.join(wanted.withColumnRenamed("debut", "un"), (F.col("c") == F.col("de")) & (F.col("n") == F.col("fois")) & (F.col("debut") == F.col("un")), "left_semi")
    window = Window.partitionBy("c", "n", "debut").orderBy("v")
    best = matched.withColumn("place", F.row_number().over(window)).where(F.col("place") <= fixed.TOP_VALUE_COUNT)
    out: dict[tuple, list[str]] = {}
    for row in best.select("c", "n", "debut", "place", text.shown(F.col("v")).alias("valeur")).sort("c", "n", "debut", "place").collect():
        out.setdefault((row["c"], row["n"], row["debut"]), []).append(row["valeur"])
    return out


def first_examples(
    df: DataFrame, refs: Sequence[ColumnRef], order_by: Sequence[str] | None = None
) -> dict[int, list[str]]:
    """The first three non-missing values of each column, as displayed.

    The first rows are read once for all columns; those with fewer than three values there are
    completed together in a second pass, so the answer is exact however sparse the columns.
    At most 200 bounded strings per column pass through the driver.
    """
    usable = [ref for ref in refs if ref.family != NESTED]
    order = [quoted(name) for name in order_by or ()]

    def head(rows: DataFrame, wanted: Sequence[ColumnRef], count: int) -> list:
        ordered = rows.sort(*order) if order else rows
        return ordered.limit(count).select(
            *[text.shown(ref.printed).alias(f"_{ref.index}") for ref in wanted]
        ).collect()

    peeked = head(df, usable, PEEK_ROWS) if usable else []
    found = {
        ref.index: [row[i] for row in peeked if row[i] is not None][: fixed.EXAMPLE_COUNT]
        for i, ref in enumerate(usable)
    }
    if len(peeked) == PEEK_ROWS:
        sparse = [ref for ref in usable if len(found[ref.index]) < fixed.EXAMPLE_COUNT]
        if sparse:
            found |= {ref.index: [] for ref in sparse}
            # One pass for all of them: Spark keeps three rows per column in every task before anything moves.
            place = F.struct(*order) if order else F.monotonically_increasing_id()
            cells = melt(df, sparse, lambda ref: text.shown(ref.printed), keep=[(place, "place")])
            first = F.row_number().over(Window.partitionBy("c").orderBy("place"))
            rows = (
                cells.where(F.col("v").isNotNull()).withColumn("n", first)
                .where(F.col("n") <= fixed.EXAMPLE_COUNT).select("c", "n", "v").collect()
            )
            for row in sorted(rows, key=lambda row: (row["c"], row["n"])):
                found[row["c"]].append(row["v"])
    return found


# --- Labels, statistics, anomalies --------------------------------------------------------


def column_profiles(measures: DataFrame) -> DataFrame:
    """One row per column, with the fields of a profile, from the measures."""
    filled = F.coalesce("renseignees", F.lit(0).cast("long"))
    missing = F.coalesce("manquantes", F.lit(0).cast("long"))
    counted = measures.where(F.col("c") != _TABLE_ROW).withColumns(
        {"renseignees": filled, "manquantes": missing}
    )
    labelled = counted.withColumn("type", _label())
    return labelled.select(*_profile_fields())


@lru_cache(maxsize=1)
def _profile_fields() -> list[Column]:
    is_number = F.col("type").isin(fixed.WHOLE, fixed.DECIMAL)
    has_values = F.col("renseignees") > 0
    aggregates = {
        "minimum": "minimum", "maximum": "maximum", "moyenne": "moyenne",
        "mediane": "q50", "ecart_type": "ecart_type",
    }
    statistics = F.struct(
        *[F.when(is_number, F.round(source, 2)).alias(name) for name, source in aggregates.items()],
        F.when(~is_number, F.col("modalites")).alias("modalites_frequentes"),
    )
    return [
        F.col("c").alias("position"),
        F.col("nom"),
        F.col("type"),
        F.col("manquantes").alias("valeurs_manquantes"),
        text.share(F.col("manquantes"), F.col("manquantes") + F.col("renseignees")).alias("part_manquantes"),
        F.when(F.col("famille") != NESTED, F.coalesce("distinctes", F.lit(0).cast("long"))).alias("cardinalite"),
        F.coalesce("exemples", F.array().cast("array<string>")).alias("exemples"),
        F.when(has_values, statistics).alias("statistiques"),
        F.when(has_values, _anomalies()).otherwise(_none()).alias("anomalies"),
    ]


@lru_cache(maxsize=1)
def _label() -> Column:
    """The cascade of semantic labels; the first condition that holds wins."""
    filled = F.col("renseignees")
    family = F.col("famille")
    words = F.col("mots_booleens") == filled
    dated = sum((F.col(f"forme_{i}") for i in range(1, len(frequency.SHAPES))), F.col("forme_0"))
    stripped = F.col("sans_blancs")
    few = F.greatest(F.lit(float(fixed.CATEGORY_MAX_VALUES)), filled * fixed.CATEGORY_MAX_SHARE)
    of_text = (
        F.when(words, fixed.BOOLEAN)
        .when(dated / filled > fixed.DATE_SHARE, fixed.DATE)
        .when(stripped / filled >= fixed.TEXT_IDENTIFIER_RATIO, fixed.IDENTIFIER)
        .when(stripped <= few, fixed.CATEGORY)
        .otherwise(fixed.TEXT)
    )
    near_unique = _near_unique()
    of_number = (
        F.when(F.col("entiers") & F.col("binaire"), fixed.BOOLEAN)
        .when(F.col("entiers") & near_unique, fixed.IDENTIFIER)
        .when(F.col("entiers"), fixed.WHOLE)
        .otherwise(fixed.DECIMAL)
    )
    return (
        F.when((filled == 0) | (family == NESTED), fixed.TEXT)
        .when(family.isin(*NUMERIC), of_number)
        .when(family == MOMENT, fixed.DATE)
        .when(family == FLAG, fixed.BOOLEAN)
        .otherwise(of_text)
    )


def _near_unique() -> Column:
    return F.try_divide("distinctes", "renseignees") >= fixed.NUMERIC_IDENTIFIER_RATIO


def _none() -> Column:
    return F.array().cast("array<struct<type:string,detail:string>>")


def _anomalies() -> Column:
    shapes = sum(
        ((F.col(f"forme_{i}") > 0).cast("int") for i in range(1, len(frequency.SHAPES))),
        (F.col("forme_0") > 0).cast("int"),
    )
    variants = F.col("distinctes") - F.col("sans_casse")

    def one(kind: str, detail: str, count: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("type"), F.format_string(detail, count).alias("detail")))

    label = F.col("type")
    found = (
        F.when((label == fixed.DATE) & (shapes > 1), one(fixed.MIXED_DATES, fixed.MIXED_DATES_DETAIL, shapes))
        .when(
            label.isin(fixed.WHOLE, fixed.DECIMAL) & (F.col("extremes") > 0),
            one(fixed.OUTLIERS, fixed.OUTLIERS_DETAIL, F.col("extremes")),
        )
        .when(
            label.isin(fixed.CATEGORY, fixed.TEXT) & (variants > 0),
            one(fixed.VARIANTS, fixed.VARIANTS_DETAIL, variants),
        )
    )
    return F.coalesce(found, _none())


# --- The whole profile --------------------------------------------------------------------


def profile_from(measures: DataFrame) -> DataFrame:
    """The one-row profile: dimensions, duplicates, quality and one entry per column."""
    from tamis.operators.quality import with_quality

    columns = column_profiles(measures).select(
        "position",
        F.struct(
            "nom", "type", "valeurs_manquantes", "part_manquantes", "cardinalite", "exemples",
            "statistiques", "anomalies",
        ).alias("colonne"),
    )
    table = measures.where(F.col("c") == _TABLE_ROW).select(
        F.lit(_TABLE_ROW).alias("position"), "nb_lignes", "doublons"
    )
    # One entry per column of the table: as bounded as its schema.
    whole = columns.unionByName(table, allowMissingColumns=True).agg(
        F.max("nb_lignes").alias("nb_lignes"),
        F.max("doublons").alias("nb_doublons"),
        F.array_sort(
            F.collect_list(F.when(F.col("position") >= 0, F.struct("position", "colonne")))
        ).alias("rangees"),
    ).withColumn("colonnes", F.transform("rangees", lambda r: r["colonne"]))
    scored = with_quality(whole)
    return scored.select(
        "nb_lignes",
        F.size("colonnes").alias("nb_colonnes"),
        F.struct(
            F.col("nb_doublons").alias("nombre"),
            text.share(F.col("nb_doublons"), F.col("nb_lignes")).alias("part"),
        ).alias("doublons"),
        "score_qualite",
        "explication_qualite",
        "colonnes",
    )


def profile(df: DataFrame, *, order_by: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Full profile of a table, as one row."""
    return profile_from(measure(df, order_by=order_by, exclude=exclude))


def approximate(df: DataFrame, *, exclude: Sequence[str] = (), error: float = 0.01) -> DataFrame:
    """Cardinalities and quartiles within a relative error, for columns whose values are too many to be shuffled.

    Rows (nom, manquantes, renseignees, distinctes, q25, q50, q75): two passes of partial aggregates, after which one
    sketch per column and task moves.  ``error`` is the relative standard deviation of the cardinality and the rank
    error of the quartiles.
    """
    refs = [ref for ref in columns_of(df, exclude) if ref.family != NESTED]
    counted = melt(df, refs, lambda ref: ref.printed).groupBy("c").agg(
        F.count_if(F.col("v").isNull()).alias("manquantes"), F.count("v").alias("renseignees"),
        F.approx_count_distinct("v", error).alias("distinctes"),
    )
    names = local_table(df.sparkSession, [{"c": ref.index, "nom": ref.name} for ref in refs], "c int, nom string")
    out = counted.join(F.broadcast(names), "c")  # a row per column
    numeric = [ref for ref in refs if ref.family in NUMERIC]
    places = F.array(*(F.lit(p) for p in quantiles.PROBABILITIES))
    if numeric:
        found = melt(df, numeric, lambda ref: ref.number).groupBy("c").agg(
            F.percentile_approx("v", places, round(1 / error)).alias("q")
        )
        out = out.join(F.broadcast(found), "c", "left")
    else:
        out = out.withColumn("q", F.lit(None).cast("array<double>"))
    return out.select("nom", "manquantes", "renseignees", "distinctes", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(quantiles.NAMES)))


def context(profiled: DataFrame, redact: Sequence[str] = ()) -> DataFrame:
    """Compact form of a profile, without rows, score, duplicates, missing counts or anomalies.

    ``redact`` names columns whose examples and frequent values are withheld.
    """
    def compact(entry: Column) -> Column:
        secret = entry["nom"].isin(*redact) if redact else F.lit(False)
        statistics = entry["statistiques"]
        return F.struct(
            entry["nom"].alias("nom"),
            entry["type"].alias("type"),
            entry["cardinalite"].alias("cardinalite"),
            entry["part_manquantes"].alias("part_manquantes"),
            F.when(secret, F.array().cast("array<string>")).otherwise(entry["exemples"]).alias("exemples"),
            F.when(secret, statistics.withField("modalites_frequentes", F.lit(None).cast(_TOP)))
            .otherwise(statistics).alias("statistiques"),
        )

    return profiled.select("nb_lignes", F.transform("colonnes", compact).alias("colonnes"))
