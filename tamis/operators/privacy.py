"""Personal data: detection, pseudonyms, a token vault shared by files, and a leak audit."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import fixed, text
from tamis.operators import frequency
from tamis.operators.columns import EXACT, INTEGER, TEXT, ColumnRef, columns_of, melt, quoted
from tamis.operators.local import local_table
from tamis.operators.lookup import BROADCAST_BYTES, BROADCAST_ROWS, attach
from tamis.operators.ranks import number_in_order
from tamis.operators.spread import spread
from tamis.session import written

TOKEN_SCHEMA = "colonne string, empreinte string, jeton string"
VAULT_SCHEMA = "type_pii string, empreinte string, rang bigint, jeton string"
# The type of a place in files, and the bits that are left for places of one split.
PLACE, PLACE_BITS = "struct<fichier:string,bloc:bigint,rang:bigint>", 40


@dataclass(frozen=True)
class Detection:
    """A column recognised as personal."""

    colonne: str
    type_pii: str
    confiance: float
    exemple_masque: str


# --- Detection ----------------------------------------------------------------------------


def detect(df: DataFrame, *, exclude: Sequence[str] = ()) -> DataFrame:
    """Rows (colonne, type_pii, confiance, exemple_masque), in column order.

    Match rates are counted where the rows are: only one row of counters per column moves.
    """
    df, refs = spread(df), columns_of(df, exclude)
    texts = [ref for ref in refs if ref.family == TEXT]
    integers = [ref for ref in refs if ref.family == INTEGER]
    decimals = [ref for ref in refs if ref.family == EXACT]
    parts = []
    if texts:
        parts.append(frequency.text_rates(df, texts))
    if integers:
        value = F.col("v")
        # A whole number prints as 13 to 15 digits; no other pattern can match a number.
        parts.append(
            melt(df, integers).where(value.isNotNull()).groupBy("c").agg(
                F.count(F.lit(1)).alias("renseignees"),
                F.count_if(value.between(F.lit(10**12), F.lit(10**15 - 1))).alias("motif_3"),
            )
        )
    if decimals:  # printed with their scale: whole, and 13 to 15 digits before the point
        parts.append(
            melt(df, decimals).where(F.col("v").isNotNull()).groupBy("c").agg(
                F.count(F.lit(1)).alias("renseignees"),
                F.count_if(F.col("v").rlike(r"^[1-9][0-9]{12,14}(\.0*)?$")).alias("motif_3"),
            )
        )
    if not parts:
        return local_table(df.sparkSession, [], DETECTION_SCHEMA)
    counters = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    absent = {name: F.lit(0).cast("long") for name in frequency.COUNTERS if name not in counters.columns}
    names = local_table(df.sparkSession, [{"c": ref.index, "nom": ref.name} for ref in refs], "c int, nom string")
    return detections_from(counters.withColumns(absent).join(F.broadcast(names), "c"))


DETECTION_SCHEMA = "colonne string, type_pii string, confiance double, exemple_masque string"


def detections_from(measures: DataFrame) -> DataFrame:
    """Detections, from one row of counters per column (c, nom, renseignees, ...)."""
    return (
        measures.where("c >= 0 and renseignees > 0")
        .withColumns(dict(zip(("type_pii", "taux"), _verdict())))
        .where(F.col("type_pii").isNotNull())
        .sort("c")
        .select(
            F.col("nom").alias("colonne"),
            "type_pii",
            F.round("taux", 3).alias("confiance"),
            text.token(F.col("type_pii"), F.lit(1)).alias("exemple_masque"),
        )
    )


@lru_cache(maxsize=1)
def _verdict() -> tuple[Column, Column]:
    """First kind whose rate is high enough, and that rate."""
    kind, rate = F.lit(None).cast("string"), F.lit(None).cast("double")
    named = F.coalesce(F.try_divide("noms", F.col("renseignees") - F.col("vides")), F.lit(0.0))
    candidates = [
        (label, F.coalesce(F.col(f"motif_{i}") / F.col("renseignees"), F.lit(0.0)), fixed.PATTERN_SHARE)
        for i, label in enumerate(frequency.KINDS)
    ]
    candidates.append((fixed.PERSON_NAME, named, fixed.NAME_SHARE))
    for label, measured, least in reversed(candidates):
        kind = F.when(measured >= least, label).otherwise(kind)
        rate = F.when(measured >= least, measured).otherwise(rate)
    return kind, rate


def detections(found: DataFrame) -> list[Detection]:
    """The detections as objects: at most one per column."""
    return [Detection(*row) for row in found.select(*Detection.__dataclass_fields__).collect()]


# --- Pseudonyms ---------------------------------------------------------------------------


def tokens(
    df: DataFrame,
    found: Iterable[Detection],
    *,
    order_by: str | None = None,
    key: str | None = None,
    normalise: bool = False,
) -> DataFrame:
    """One row per distinct value of each detected column, numbered by first appearance.

    Rows (colonne, type_pii, empreinte, rang, jeton, occurrences, mots, empreinte_mots): the last two are the number of words of
    the value and the fingerprint of its words alone, by which an audit finds it inside a text.  ``order_by`` names the column
    that orders the rows (default: the order in which files are read); ``key`` makes
    fingerprints secret; ``normalise`` gives values that differ by outer blanks one token.
    """
    found = list(found)
    refs = _refs(df, found)
    table, position = _by_number(df, refs, order_by)
    rows = melt(table, refs, _masked_form(normalise), keep=[(position, "position")])
    firsts = (
        rows.where(F.col("v").isNotNull()).groupBy("c", "v")
        .agg(F.min("position").alias("premiere"), F.count(F.lit(1)).alias("occurrences"))
        .select("c", text.fingerprint(F.col("v"), key).alias("empreinte"), "premiere", "occurrences", *_by_words(F.col("v"), key))
    )  # from here on fingerprints stand for values: nothing written holds one
    kinds = {one.colonne: one.type_pii for one in found}
    labels = local_table(
        df.sparkSession,
        [{"c": ref.index, "colonne": ref.name, "type_pii": kinds[ref.name]} for ref in refs],
        "c int, colonne string, type_pii string",
    )
    numbered = number_in_order(firsts, ["c"], "premiere", "rang", tie=["empreinte"])
    return numbered.join(F.broadcast(labels), "c").select(
        "colonne", "type_pii", "empreinte", "rang",
        text.token(F.col("type_pii"), F.col("rang")).alias("jeton"), "occurrences", "mots", "empreinte_mots",
    )


def _by_number(df: DataFrame, refs: Sequence[ColumnRef], order_by: str | None) -> tuple[DataFrame, Column]:
    """The columns, a small table spread over the cores, and what orders the rows: a number, if it was a place in files.

    Numbers are aggregated by hash, while the least of structs would have every task sort the cells of its split. A place is the number of
    its split, in order, and the steps since the first place of it. If splits are too many for a broadcast, or a place too far, structs stay.
    """
    names = dict.fromkeys(ref.name for ref in refs)
    if order_by is None or df.schema[order_by].dataType.simpleString() != PLACE:
        position = F.monotonically_increasing_id() if order_by is None else quoted(order_by)
        kept = _free("_place", names)
        return spread(df.select(*map(quoted, names), position.alias(kept))), F.col(kept)
    place = quoted(order_by)
    table = spread(df.select(*map(quoted, names), *[place] * (order_by not in names)))
    own = F.struct(place["fichier"].alias("fichier"), place["bloc"].alias("bloc"))
    rang = place["rang"]
    splits = written(df.groupBy(own.alias("split")).agg(
        F.min(rang).alias("premier"), F.max(rang).alias("dernier"), F.count_if(place.isNull() | rang.isNull()).alias("sans")
    ), "passages")
    count, far, missing = splits.agg(F.count(F.lit(1)), F.max(F.col("dernier") - F.col("premier")), F.sum("sans")).head()
    if count > BROADCAST_ROWS or missing or (far or 0) >= 1 << PLACE_BITS:
        return table, place
    number = F.shiftleft(F.row_number().over(Window.orderBy("split")).cast("long"), PLACE_BITS) - F.col("premier")
    key, base = _free("_split", table.columns), _free("_base", table.columns)
    numbered = splits.select(F.col("split").alias(key), number.alias(base))
    return table.join(F.broadcast(numbered), own.eqNullSafe(F.col(key)), "left"), F.col(base) + rang


def _free(wanted: str, names: Iterable[str]) -> str:
    taken = {name.lower() for name in names}
    while wanted in taken:
        wanted += "_"
    return wanted


def _words(value: Column) -> Column:
    """The words of a text, without marks between or around them."""
    parts = F.split(F.regexp_replace(value, fixed.WORD_EDGES, " "), fixed.WORD_BREAKS)
    return F.filter(parts, lambda word: word != "")


def _by_words(value: Column, key: str | None) -> list[Column]:
    words = _words(value)
    return [F.size(words).alias("mots"), text.fingerprint(F.array_join(words, " "), key).alias("empreinte_mots")]


def _refs(df: DataFrame, found: Iterable[Detection]) -> list[ColumnRef]:
    names = {one.colonne for one in found}
    return [ref for ref in columns_of(df) if ref.name in names]


def _masked_form(normalise: bool):
    return (lambda ref: text.strip(ref.printed)) if normalise else (lambda ref: ref.printed)


def mask(
    df: DataFrame,
    mapping: DataFrame,
    found: Iterable[Detection],
    *,
    key: str | None = None,
    normalise: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    together: bool | None = None,
) -> DataFrame:
    """The table with the detected columns replaced by their tokens; missing stays missing.

    ``mapping`` holds (colonne, empreinte, jeton, occurrences); give it as a written table, it is
    counted first.  Columns with few tokens are joined by broadcast.  Of the others, a single one is joined by a skew-proof shuffle of
    the table; several are joined ``together`` (or one after the other, if that is false), so that the table moves a fixed number of
    times however many they are.
    """
    sizes = {
        row["colonne"]: row.asDict()
        for row in mapping.groupBy("colonne").agg(
            F.count(F.lit(1)).alias("size"), F.sum("occurrences").alias("total"),
            F.sum(F.octet_length("empreinte") + F.octet_length("jeton")).alias("width"),
        ).collect()
    }
    form = _masked_form(normalise)
    out, large = df, []
    for ref in _refs(df, list(found)):
        own = mapping.where(F.col("colonne") == ref.name).select(
            F.col("empreinte").alias("cle"), F.col("jeton").alias("valeur"), "occurrences"
        )
        measured = sizes.get(ref.name, {"size": 0, "total": 0, "width": 0})
        if together is not False and (measured["size"] > broadcast_rows or (measured["width"] or 0) > BROADCAST_BYTES):
            large.append((ref, own, measured))
            continue
        out = _masked_alone(out, ref, own, measured, form, key, broadcast_rows)
    if len(large) == 1 and not together:
        return _masked_alone(out, *large[0], form, key, broadcast_rows)
    return _masked_together(out, large, form, key) if large else out


def _masked_alone(
    df: DataFrame, ref: ColumnRef, own: DataFrame, measured: Mapping, form, key: str | None, broadcast_rows: int
) -> DataFrame:
    """One column replaced by its tokens."""
    found_tokens = attach(
        df, text.fingerprint(form(ref), key), own,
        size=measured["size"], total=measured["total"], width=measured["width"], out="_jeton", broadcast_rows=broadcast_rows,
    )
    return found_tokens.withColumn(ref.name, F.col("_jeton")).drop("_jeton")


def _masked_together(df: DataFrame, large: Sequence[tuple[ColumnRef, DataFrame, Mapping]], form, key: str | None) -> DataFrame:
    """Several columns replaced by their tokens: cells apart from rows, one join with all tokens, and rows and tokens put together.

    A row becomes a row without the columns and, for each of them that is filled, a cell of fingerprint only. Both take part
    in one join and one grouping by row, so the table moves twice.
    """
    named = lambda i, empreinte: F.concat(F.lit(f"{i}:"), empreinte)
    cells = [F.when(form(ref).isNotNull(), F.struct(F.lit(i).alias("i"), named(i, text.fingerprint(form(ref), key)).alias("cle"), F.lit(None).alias("reste"))) for i, (ref, _, _) in enumerate(large)]
    masked = {ref.name for ref, _, _ in large}
    rest = [quoted(name).alias(f"r{at}") for at, name in enumerate(df.columns) if name not in masked]
    whole = F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("cle"), F.struct(*rest, F.lit(True).alias("la")).alias("reste"))
    numbered = df.withColumn("_ligne", F.monotonically_increasing_id())
    parts = numbered.select("_ligne", F.explode(F.array_compact(F.array(whole, *cells))).alias("_part")).select("_ligne", "_part.*")
    tokens_of = reduce(DataFrame.unionByName, [own.withColumn("cle", named(i, F.col("cle"))) for i, (_, own, _) in enumerate(large)])
    joined = attach(
        parts, F.col("cle"), tokens_of, size=sum(m["size"] for _, _, m in large), total=sum(m["total"] for _, _, m in large),
        out="_jeton", broadcast_rows=-1, scatter=[F.col("_ligne"), F.col("i")],
    )
    back = joined.groupBy("_ligne").agg(
        F.first("reste", ignorenulls=True).alias("_reste"),
        *[F.max(F.when(F.col("i") == i, F.col("_jeton"))).alias(f"_j{i}") for i in range(len(large))],
    )
    at = {ref.name: F.col(f"_j{i}") for i, (ref, _, _) in enumerate(large)}
    return back.select(*[at.get(name, F.col(f"_reste.r{k}")).alias(name) for k, name in enumerate(df.columns)])


def pseudonymise(
    df: DataFrame,
    found: Iterable[Detection],
    *,
    order_by: str | None = None,
    key: str | None = None,
    normalise: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    together: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The masked table, and its tokens (colonne, empreinte, jeton).

    The tokens are written once to the shared folder, so that the mask cannot number the
    values differently from the table of tokens; values themselves are never written.
    """
    found = list(found)
    table = written(tokens(df, found, order_by=order_by, key=key, normalise=normalise), "jetons")
    masked = mask(df, table, found, key=key, normalise=normalise, broadcast_rows=broadcast_rows, together=together)
    return masked, table


def masking_summary(mapping: DataFrame) -> DataFrame:
    """Rows (colonne, valeurs_masquees): distinct values replaced, not cells."""
    return mapping.groupBy("colonne").agg(F.count(F.lit(1)).alias("valeurs_masquees"))


# --- Tokens stable across files -----------------------------------------------------------


def extend_vault(
    vault: DataFrame | None,
    df: DataFrame,
    columns: Mapping[str, str],
    *,
    order_by: str | None = None,
    key: str | None = None,
) -> DataFrame:
    """The vault (type_pii, empreinte, rang, jeton) with the values of a new table added.

    ``columns`` maps column names to kinds of personal data.  A value already in the vault
    keeps its token, whatever column or file it comes from; new values are numbered after the
    last one of their kind.
    """
    wanted = [ref for ref in columns_of(df) if ref.name in columns]
    labels = local_table(
        df.sparkSession, [{"c": ref.index, "type_pii": columns[ref.name]} for ref in wanted],
        "c int, type_pii string",
    )
    position = F.monotonically_increasing_id() if order_by is None else quoted(order_by)
    # Of any type that can be ordered; columns of one row come in table order.
    firsts = (
        melt(df, wanted, lambda ref: ref.printed, keep=[(position, "position")])
        .where(F.col("v").isNotNull()).join(F.broadcast(labels), "c")
        .groupBy("type_pii", text.fingerprint(F.col("v"), key).alias("empreinte"))
        .agg(F.min(F.struct("position", "c")).alias("premiere"))
    )
    if vault is None:
        vault = local_table(df.sparkSession, [], VAULT_SCHEMA)
    new = firsts.join(vault.select("type_pii", "empreinte"), ["type_pii", "empreinte"], "left_anti")
    numbered = number_in_order(new, ["type_pii"], "premiere", "place", tie=["empreinte"])
    last = vault.groupBy("type_pii").agg(F.max("rang").alias("dernier"))  # one row per kind
    placed = numbered.join(F.broadcast(last), "type_pii", "left").withColumn(
        "rang", F.col("place") + F.coalesce("dernier", F.lit(0).cast("long"))
    )
    added = placed.select(
        "type_pii", "empreinte", "rang", text.token(F.col("type_pii"), F.col("rang")).alias("jeton")
    )
    return vault.unionByName(added)


def vault_mapping(
    vault: DataFrame, df: DataFrame, columns: Mapping[str, str], *, key: str | None = None
) -> DataFrame:
    """The part of the vault a table needs, in the form ``mask`` takes."""
    wanted = [ref for ref in columns_of(df) if ref.name in columns]
    labels = local_table(
        df.sparkSession,
        [{"c": ref.index, "colonne": ref.name, "type_pii": columns[ref.name]} for ref in wanted],
        "c int, colonne string, type_pii string",
    )
    present = (
        melt(df, wanted, lambda ref: ref.printed).where(F.col("v").isNotNull())
        .groupBy("c", text.fingerprint(F.col("v"), key).alias("empreinte"))
        .agg(F.count(F.lit(1)).alias("occurrences"), *[F.first(column).alias(name) for column, name in zip(_by_words(F.col("v"), key), ("mots", "empreinte_mots"))])
        .join(F.broadcast(labels), "c")
    )
    return present.join(vault, ["type_pii", "empreinte"]).select(
        "colonne", "type_pii", "empreinte", "rang", "jeton", "occurrences", "mots", "empreinte_mots"
    )


# --- Audit --------------------------------------------------------------------------------


def leaks(masked: DataFrame, mapping: DataFrame, *, key: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Rows (colonne, empreinte) of cells of the masked table that still hold an original value.

    Empty when nothing leaked.  Cells are reduced to fingerprints before anything is moved: of the
    whole cell, of everything inside a text that has the shape of personal data, and of every run of words as long as an
    original is (``mots`` of the mapping; without it, of one or two words).
    """
    texts = [ref for ref in columns_of(masked, exclude) if ref.family in (TEXT, INTEGER, EXACT)]
    names = local_table(
        masked.sparkSession, [{"c": ref.index, "colonne": ref.name} for ref in texts], "c int, colonne string"
    )
    shown = (
        melt(masked, texts, lambda ref: ref.printed).where(F.col("v").isNotNull())
        .select("c", F.explode(_inside(F.col("v"), _lengths(mapping), key)).alias("vu")).distinct()
    )
    return shown.join(_originals(mapping), "vu").join(F.broadcast(names), "c").select("colonne", "empreinte").distinct()


def _lengths(mapping: DataFrame) -> list[int]:
    """How many words originals have: the different numbers, in order."""
    if "mots" not in mapping.columns:
        return [1, 2]
    return sorted(row[0] for row in mapping.select("mots").distinct().collect() if row[0])


def _originals(mapping: DataFrame) -> DataFrame:
    """Rows (vu, empreinte): fingerprints under which an original may be seen, and its own."""
    own = mapping.select(F.col("empreinte").alias("vu"), "empreinte")
    if "empreinte_mots" in mapping.columns:
        own = own.unionByName(mapping.where("mots > 0").select(F.col("empreinte_mots").alias("vu"), "empreinte"))
    return own.distinct()


def _inside(cell: Column, lengths: Sequence[int], key: str | None) -> Column:
    """Fingerprints of the cell and of the parts of it that could be a personal value of their own."""
    shaped = [F.regexp_extract_all(cell, F.lit(shape), F.lit(0)) for shape in fixed.INSIDE_SHAPES]

    def of_length(words: Column, length: int) -> Column:
        starts = F.slice(words, 1, F.greatest(F.size(words) - (length - 1), F.lit(0)))
        return F.transform(starts, lambda word, at: F.array_join(F.slice(words, at + 1, length), " "))

    def windows(words: Column) -> Column:
        return F.concat(F.array().cast("array<string>"), *[of_length(words, length) for length in lengths])

    # Bound to a variable: inside the lambdas the split would be done anew for each word.
    named = F.transform(F.array(_words(cell)), windows)[0]
    whole = F.array_distinct(F.concat(F.array(cell), *shaped, named))
    return F.transform(whole, lambda part: text.fingerprint(part, key))


def context_leaks(context: DataFrame, mapping: DataFrame, *, key: str | None = None) -> DataFrame:
    """Rows (nom, empreinte) of original values shown by a context: its examples and frequent values."""
    entry = context.select(F.explode("colonnes").alias("e"))
    frequent = F.coalesce(F.transform(F.col("e.statistiques.modalites_frequentes"), lambda m: m["valeur"]), F.array().cast("array<string>"))
    shown = entry.select(F.col("e.nom").alias("nom"), F.explode(F.concat(F.col("e.exemples"), frequent)).alias("v"))
    inside = shown.where(F.col("v").isNotNull()).select("nom", F.explode(_inside(F.col("v"), _lengths(mapping), key)).alias("vu"))
    return inside.distinct().join(_originals(mapping), "vu").select("nom", "empreinte").distinct()


def leak_audit(masked: DataFrame, mapping: DataFrame, *, key: str | None = None) -> DataFrame:
    """One row (valeurs_verifiees, fuites)."""
    checked = mapping.agg(F.count_distinct("empreinte").alias("valeurs_verifiees"), F.lit(0).cast("long").alias("fuites"))
    found = leaks(masked, mapping, key=key).agg(
        F.lit(0).cast("long").alias("valeurs_verifiees"), F.count(F.lit(1)).alias("fuites")
    )
    return checked.unionByName(found).agg(
        F.sum("valeurs_verifiees").alias("valeurs_verifiees"), F.sum("fuites").alias("fuites")
    )
