"""Reading a table without damaging it: everything as text, then numbers where nothing is lost."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions import fixed, text
from tamis.operators.columns import columns_of, melt, quoted
from tamis.operators.local import local_table
from tamis.operators.lookup import attach
from tamis.session import written
from tamis.sources import records

FORMATS = (".csv", ".parquet")
OVERFLOW = "_en_trop"
POSITION = "_position"


class Refused(ValueError):
    """The table cannot be accepted; the message is meant for the person who supplied it."""


def load(
    spark: SparkSession,
    path: str,
    *,
    max_bytes: int | None = None,
    max_rows: int | None = None,
    with_position: bool = False,
) -> DataFrame:
    """Load a CSV or Parquet table, each column a number only if no value changes by it.

    ``with_position`` adds a last column ``_position`` (underscores are added if the table has one) that orders
    the rows as the files do.
    """
    extension = extension_of(path)
    files = list_files(spark, path)
    check_size(files, max_bytes)
    if extension == ".csv":
        rows, names, overflow = _scan(spark, path, files, with_position=with_position)
        keep = names[-1:] if with_position else []
        table = promote(rows, keep=keep, overflow=overflow).select(*[quoted(name) for name in names])
    else:
        table = spark.read.parquet(path)
        if with_position:
            table = table.withColumn(free(POSITION, table.columns), _position())
    check_rows(table.select(*[quoted(name) for name in table.columns[:-1]]) if with_position else table, max_rows)
    return table


def load_with_verdicts(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A table with its position as last column, and what ``load_more`` needs: schema, separator and the verdicts on text columns."""
    if extension_of(path) == ".parquet":
        table = spark.read.parquet(path)
        return table.withColumn(free(POSITION, table.columns), _position()), {"schema": _ddl(table), "separator": None, "verdicts": {}}
    files = list_files(spark, path)
    separator = separator_of(_sample(spark, files))
    rows, names, overflow = _scan(spark, path, files, separator, with_position=True)
    found = verdicts(rows, names[-1:], overflow)
    table = promoted(rows.select(*[quoted(name) for name in names]), kinds_of(found))
    told = {name: asdict(verdict) for name, verdict in found.items()}
    return table, {"schema": _ddl(table.drop(names[-1])), "separator": separator, "verdicts": told}


def load_more(spark: SparkSession, path: str, fresh: list[str], told: dict) -> tuple[DataFrame, dict] | None:
    """Files added to a table that was loaded before, with its columns and types; none if they change a type."""
    if extension_of(path) == ".parquet":
        table = spark.read.parquet(*fresh)
        if _ddl(table) != told["schema"]:
            return None
        return table.withColumn(free(POSITION, table.columns), _position()), told
    files = spark.read.format("binaryFile").load(fresh).select("path", "length", "modificationTime")
    rows, names, overflow = _scan(spark, fresh, files, told["separator"], with_position=True)
    wanted = [field.name for field in T.StructType.fromDDL(told["schema"]).fields]
    if sorted(names[:-1]) != sorted(wanted):
        raise Refused(f"Les fichiers n'ont pas les mêmes colonnes : {sorted(set(names[:-1]) ^ set(wanted))}.")
    before = {name: Verdict(**fields) for name, fields in told["verdicts"].items()}
    found = verdicts(rows, names[-1:], overflow)
    both = {name: before.get(name, Verdict()).combined(found.get(name, Verdict())) for name in before | found}
    if kinds_of(both) != kinds_of(before):
        return None
    table = promoted(rows.select(*[quoted(name) for name in [*wanted, names[-1]]]), kinds_of(both))
    return table, {**told, "verdicts": {name: asdict(verdict) for name, verdict in both.items()}}


def _ddl(table: DataFrame) -> str:
    return ", ".join(f"`{field.name.replace('`', '``')}` {field.dataType.simpleString()}" for field in table.schema.fields)


def extension_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    extension = "." + name.rsplit(".", 1)[1] if "." in name else ""
    if extension not in FORMATS:
        raise Refused(
            f"L'extension « {extension or 'absente'} » n'est pas lue ici ; les tables sont en {' ou '.join(FORMATS)}."
        )
    return extension


# --- Admission ----------------------------------------------------------------------------


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, length, modificationTime) of the files under a path; their content is not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listed.select("path", "length", "modificationTime")


def check_size(files: DataFrame, max_bytes: int | None = None) -> None:
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    if total == 0:
        raise Refused("Aucun octet à lire : la table est vide.")
    if max_bytes is not None and total > max_bytes:
        raise Refused(f"La table occupe {total} octets, plus que les {max_bytes} admis.")


def check_rows(table: DataFrame, max_rows: int | None = None) -> None:
    if not table.columns or table.isEmpty():
        raise Refused(
            "Aucune ligne de données sous l'en-tête."
        )
    if max_rows is not None and table.limit(max_rows + 1).count() > max_rows:
        raise Refused(f"La table a plus de {max_rows} lignes, le maximum admis.")


# --- Text files ---------------------------------------------------------------------------


def read_text(
    spark: SparkSession, path: str, *, separator: str | None = None, with_position: bool = False
) -> DataFrame:
    """A CSV table with every column as text, missing cells null, and sound column names."""
    rows, names, overflow = _scan(spark, path, list_files(spark, path), separator, with_position)
    if not rows.where(quoted(overflow).isNotNull()).isEmpty():
        raise _unreadable()
    return rows.select(*[quoted(name) for name in names])


def _scan(
    spark: SparkSession, path: str | list[str], files: DataFrame, separator: str | None = None, with_position: bool = False
) -> tuple[DataFrame, list[str], str]:
    """The cells as text with one column more, for what a record holds beyond the header; the names; that column's name.

    One pass over the lines finds the header of every file, however many files there are.  Files that have the same columns
    in another order are put together by name; files with other columns are refused.
    """
    sample = _sample(spark, files)
    separator = separator or separator_of(sample)
    line_end = "\r" if "\r" in sample and "\n" not in sample else "\n"
    heads = written(records.heads(spark, path, separator, line_end), "tetes")
    longest, opened = files.agg(F.max("length")).head()[0], heads.agg(F.max("ouvert")).head()[0]
    headed, crossed = _headers(spark, path, heads, separator, line_end)
    names = headed[0][1]
    overflow, position, file = free(OVERFLOW, names), free(POSITION, names), "_fichier"
    raw = [f"c{i}" for i in range(len(names))]
    cells_of = T.StructType([T.StructField(name, T.StringType()) for name in [*raw, "rest"]])
    whole = longest <= size_in_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))  # read by one task anyway
    if whole or not opened:
        rows = _reader(spark, separator, whole).option("header", True).option("enforceSchema", True).schema(cells_of).csv(path)
        rows = rows.select("*", F.col("_metadata.file_path").alias(file), *([_position().alias("_place")] if with_position else []))
    else:  # cells hold line ends, and files have several splits
        options = {"sep": separator, "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
        cut = records.records(spark, path, separator, line_end).where("not entete")
        place = F.struct(F.col("fichier"), F.col("bloc"), F.col("rang"))
        parsed = F.from_csv("enregistrement", F.lit(", ".join(f"{name} string" for name in [*raw, "rest"])), options)
        rows = cut.select(parsed.alias("v"), F.col("fichier").alias(file), place.alias("_place")).select("v.*", file, "_place")
    if len(headed) == 1:
        own = [F.col(column) for column in raw]
    else:
        places = local_table(
            spark, [{"tete": head, "valeur": [found.index(name) + 1 for name in names]} for head, found in headed], "tete string, valeur array<int>"
        )
        table = crossed.join(F.broadcast(places), "tete").select(F.col("fichier").alias("cle"), "valeur", F.col("lignes").alias("occurrences"))
        measured = table.agg(F.count(F.lit(1)), F.sum("occurrences"), F.sum(F.octet_length("cle") + 4 * len(names))).head()
        rows = attach(rows, F.col(file), table, size=measured[0], total=measured[1], width=measured[2], out="_ordre")
        own = [F.element_at(F.array(*raw), F.element_at("_ordre", i + 1)) for i in range(len(names))]
    places = [F.col("_place").alias(position)] if with_position else []
    out = rows.select(*[_missing(cell).alias(name) for cell, name in zip(own, names)], *places, F.col("rest").alias(overflow))
    return out, [*names, position] if with_position else names, overflow


def _headers(
    spark: SparkSession, path: str | list[str], heads: DataFrame, separator: str, line_end: str
) -> tuple[list[tuple[str, list[str]]], DataFrame]:
    """The different headers, that of the first file first, with their column names; and the table (fichier, tete, lignes) of all files.

    The driver gets one row for each different header, not for each file.
    """
    if not heads.where(records.left_open(F.col("tete"), separator)).isEmpty():  # a header with a line end inside
        whole = records.records(spark, path, separator, line_end).where("entete").select("fichier", F.col("enregistrement").alias("tete"))
        heads = written(whole.join(heads.drop("tete"), "fichier"), "tetes")
    different = heads.groupBy("tete").agg(F.min("fichier").alias("fichier")).collect()
    headed = []
    for row in sorted(different, key=lambda row: row["fichier"]):
        found = repair_header(next(csv.reader(io.StringIO(row["tete"], newline=""), delimiter=separator), []))
        if headed and sorted(found) != sorted(headed[0][1]):
            raise Refused(f"Les fichiers n'ont pas les mêmes colonnes : {sorted(set(found) ^ set(headed[0][1]))}.")
        headed.append((row["tete"], found))
    if not headed:
        raise Refused("Aucun octet à lire : la table est vide.")
    return headed, heads


def free(wanted: str, names: Sequence[str]) -> str:
    """``wanted``, with underscores added until no column is called so in any case."""
    taken = {name.lower() for name in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def _unreadable() -> Refused:
    return Refused(
        "Lecture impossible : un enregistrement a plus de cellules que l'en-tête."
    )


def _reader(spark: SparkSession, separator: str, multiline: bool):
    return (
        spark.read.option("sep", separator).option("escape", '"').option("multiLine", multiline)
        .option("maxCharsPerColumn", -1).option("inferSchema", False)
    )


def _position() -> Column:
    """Place of a row: file, block of the file, and order in the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("fichier"),
        F.col("_metadata.file_block_start").alias("bloc"),
        F.monotonically_increasing_id().alias("rang"),
    )


def size_in_bytes(setting: str) -> int:
    """A size setting such as ``134217728b`` or ``128MB`` in bytes."""
    number, unit = re.fullmatch(r"([0-9]+)([a-z]*)", setting.strip().lower()).groups()
    return int(number) * 1024 ** "bkmgtp".index(unit[:1] or "b")


def _sample(spark: SparkSession, files: DataFrame) -> str:
    """The first characters of the first file that has any."""
    first = files.where("length > 0").agg(F.min("path")).head()[0]
    lines = spark.read.option("lineSep", "\n").text(first).select(F.substring("value", 1, fixed.SEPARATOR_SAMPLE)).head(256)
    return "\n".join(line[0] for line in lines)[: fixed.SEPARATOR_SAMPLE]


def separator_of(sample: str) -> str:
    """Separator among ``, ; TAB |``: the one that cuts the lines of a sample most evenly, quoted cells apart."""
    lines = [line for line in re.sub('"[^"]*"', "", sample).splitlines() if line.strip()]
    if len(sample) >= fixed.SEPARATOR_SAMPLE and len(lines) > 1:
        lines.pop()  # it may be cut
    best, chosen = (0.0, 0), fixed.DEFAULT_SEPARATOR
    for separator in fixed.SEPARATORS:
        counts = [line.count(separator) for line in lines]
        usual = max(set(counts), key=lambda n: (counts.count(n), n), default=0)
        if usual and (counts.count(usual) / len(lines), usual) > best:
            best, chosen = (counts.count(usual) / len(lines), usual), separator
    return chosen


def detect_separator(spark: SparkSession, file: str) -> str:
    """Separator of a file, judged on its first 8,192 characters."""
    return separator_of(_sample(spark, list_files(spark, file)))


def repair_header(cells: Sequence[str | None]) -> list[str]:
    """Column names that differ in more than case: blanks are numbered by position, repeats by occurrence."""
    wanted = [cell if cell else f"Unnamed: {i}" for i, cell in enumerate(cells)]
    taken, names, seen = {name.lower() for name in wanted}, [], {}
    for name in wanted:
        same = name.lower()
        if same not in seen:
            seen[same] = 0
            names.append(name)
            continue
        candidate = name
        while candidate.lower() in taken:
            seen[same] += 1
            candidate = f"{name}.{seen[same]}"
        taken.add(candidate.lower())
        names.append(candidate)
    return names


def _missing(cell: Column) -> Column:
    return F.when(~cell.isin(*fixed.MISSING_TOKENS), cell)


# --- Promotion ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Verdict:
    """What the values of a text column allow; the verdict on several parts of a column is that on each, combined."""

    numerique: bool = True
    entier: bool = True
    signifiant: bool = False
    chiffres: int = 0

    def combined(self, other: Verdict) -> Verdict:
        return Verdict(
            self.numerique and other.numerique, self.entier and other.entier, self.signifiant or other.signifiant,
            max(self.chiffres, other.chiffres),
        )

    @property
    def kind(self) -> str | None:
        """The type that changes no value, none if only text does."""
        if not self.numerique or self.signifiant or self.chiffres > fixed.MAX_INTEGER_DIGITS:
            return None
        return "bigint" if self.entier else "double"


def verdicts(df: DataFrame, keep: Sequence[str] = (), overflow: str | None = None) -> dict[str, Verdict]:
    """The verdict on each column of text that has a value.

    One pass over the rows, one row of verdicts per column.
    """
    refs = [ref for ref in columns_of(df, keep) if ref.family == "text"]
    if not refs:
        return {}
    v = F.col("s")
    whole = v.rlike(fixed.INTEGER_LITERAL)
    found = (
        melt(df, refs).where(F.col("v").isNotNull()).select("c", text.strip(F.col("v")).alias("s"))
        .groupBy("c").agg(
            F.bool_and(whole | v.rlike(fixed.DECIMAL_LITERAL)).alias("numerique"),
            F.bool_and(whole).alias("entier"),
            F.bool_or(v.rlike(fixed.SIGNIFICANT_PREFIX)).alias("signifiant"),
            F.max(F.when(whole, F.char_length(F.replace(v, F.lit("-"), F.lit(""))))).alias("chiffres"),
        ).collect()
    )
    names = {ref.index: ref.name for ref in refs}
    if any(names[row["c"]] == overflow for row in found):
        raise _unreadable()  # a record longer than the header: the same pass sees it
    return {names[row["c"]]: Verdict(row["numerique"], row["entier"], row["signifiant"], row["chiffres"] or 0) for row in found}


def promotions(df: DataFrame, keep: Sequence[str] = (), overflow: str | None = None) -> dict[str, str]:
    """Columns of text that are numbers without exception, and the type each becomes."""
    return kinds_of(verdicts(df, keep, overflow))


def kinds_of(found: Mapping[str, Verdict]) -> dict[str, str]:
    return {name: verdict.kind for name, verdict in found.items() if verdict.kind}


def promote(df: DataFrame, keep: Sequence[str] = (), overflow: str | None = None) -> DataFrame:
    """The table with its lossless numeric columns as numbers; a decimal comma becomes a dot."""
    return promoted(df, promotions(df, keep, overflow))


def promoted(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """The table with the columns that ``kinds`` names as numbers."""
    def cell(name: str) -> Column:
        if name not in kinds:
            return quoted(name)
        plain = F.replace(text.strip(quoted(name)), F.lit(","), F.lit("."))
        return plain.try_cast(kinds[name]).alias(name)

    return df.select(*[cell(name) for name in df.columns])
