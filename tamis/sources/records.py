"""Records of quoted text files, cut at line ends outside quotes, however many splits a file has.

Whether a line begins inside a quoted cell depends on all the lines before it. Every line is therefore a map from the state it
begins in to the state it ends in. The maps of a block (a split of a file) compose to one, the maps of a file's blocks, taken in order,
give each block's first state, and so each block finds its records by itself. Only a record that lies across blocks, or has several
lines, is put together by a grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.session import written

#: States within a line: at the start of a cell, inside quotes, after a quote inside quotes, inside a cell without quotes.
START, QUOTED, CLOSING, PLAIN = range(4)


def lines_of(spark: SparkSession, path: str | list[str], line_end: str = "\n") -> DataFrame:
    """Rows (fichier, bloc, rang, ligne): rang orders the lines of a block."""
    return spark.read.option("lineSep", line_end).text(path).select(
        F.col("_metadata.file_path").alias("fichier"), F.col("_metadata.file_block_start").alias("bloc"),
        F.monotonically_increasing_id().alias("rang"), F.col("value").alias("ligne"),
    )


def heads(spark: SparkSession, path: str | list[str], separator: str, line_end: str = "\n") -> DataFrame:
    """Rows (fichier, tete, lignes, ouvert): of each file the first line that is not blank, the number of lines, and whether some line
    ends inside quotes. One pass over all files; a file without such a line gives no row.
    """
    lines = lines_of(spark, path, line_end).where(~_blank(F.col("ligne")))
    return lines.groupBy("fichier").agg(
        F.min_by("ligne", F.struct("bloc", "rang")).alias("tete"), F.count(F.lit(1)).alias("lignes"),
        F.max(_end_state(F.col("ligne"), START, separator)).alias("ouvert"),
    ).withColumn("tete", _trimmed(F.col("tete")))


def _trimmed(record: Column) -> Column:
    """Without the carriage return of its line end and the mark that a file may begin with."""
    return F.regexp_replace(F.regexp_replace(record, "\\r$", ""), "^\\uFEFF", "")


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\r\ufeff", "")) == ""


def _after_text(state: Column, piece: Column, separator: str) -> Column:
    """State after text without quotes."""
    moved = F.when(F.endswith(piece, F.lit(separator)), START).otherwise(PLAIN)
    return F.when((piece == "") | (state == QUOTED), state).otherwise(moved)


def _end_state(line: Column, first: int, separator: str) -> Column:
    """Whether a line that begins in the state ``first`` ends inside quotes (1) or not (0).

    A quote opens a quoted cell at the start of a cell only; elsewhere outside quotes it is text. Inside quotes two of them are
    one of text, any other closes the cell.
    """
    pieces = F.split(line, '"')
    after_quote = lambda s: F.when(s == PLAIN, PLAIN).when(s == QUOTED, CLOSING).otherwise(QUOTED)
    end = F.aggregate(
        F.slice(pieces, 2, F.size(pieces)), _after_text(F.lit(first), pieces[0], separator),
        lambda state, piece: _after_text(after_quote(state), piece, separator),
    )
    walked = (end == QUOTED).cast("int")
    return F.when(F.contains(line, F.lit('"')), walked).otherwise(F.lit(1 if first == QUOTED else 0))


def left_open(line: Column, separator: str) -> Column:
    """Whether a record that begins with this line goes on in the next one."""
    return _end_state(line, START, separator) == 1


def _with_states(df: DataFrame, keys: list[str], order: list[str], first: Column) -> DataFrame:
    """The rows with ``avant`` and ``apres``, the states before and after each; ``first`` is the state before all of a group.

    The columns ``dehors`` and ``dedans`` tell where a row leads from outside and from inside quotes. It either sets the state, keeps
    it, or swaps it. So the state is the one last set, swapped as often as there were swaps since.
    """
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(*order)
    swaps = F.sum(F.when((F.col("dehors") == 1) & (F.col("dedans") == 0), 1).otherwise(0)).over(upto)
    placed = F.last(F.when(F.col("dehors") == F.col("dedans"), F.struct(F.col("dehors").alias("etat"), F.col("_echanges").alias("echanges"))), True).over(upto)
    after = F.pmod(F.coalesce(F.col("_pose.etat"), first) + F.col("_echanges") - F.coalesce(F.col("_pose.echanges"), F.lit(0)), F.lit(2))
    before = F.coalesce(F.lag("apres").over(earlier), first)
    return (
        df.withColumn("_echanges", swaps).withColumn("_pose", placed).withColumn("apres", after).withColumn("avant", before)
        .drop("_echanges", "_pose")
    )


def blocks_of(lines: DataFrame, separator: str) -> DataFrame:
    """Rows (fichier, bloc, debut, fin, porteur, premier): the state before and after each block, the block where the record that is open
    at its start begins, and whether it is the first of its file with a line that is not blank.

    Only lines that hold a quote count, and they are folded where they are read: one row a block moves.
    """
    quoted = F.contains(F.col("ligne"), F.lit('"'))
    # A map is told by four numbers: where it leads from either state, and whether a state outside quotes occurs on the way from inside.
    fold = F.aggregate(
        F.array_sort("cartes"), F.struct(F.lit(0).alias("dehors"), F.lit(1).alias("dedans"), F.lit(False).alias("sorti")),
        lambda done, one: F.struct(
            F.when(done["dehors"] == 0, one["dehors"]).otherwise(one["dedans"]).alias("dehors"),
            F.when(done["dedans"] == 0, one["dehors"]).otherwise(one["dedans"]).alias("dedans"),
            (done["sorti"] | (done["dedans"] == 0)).alias("sorti"),
        ),
    )
    maps = F.struct("rang", _end_state(F.col("ligne"), START, separator).alias("dehors"), _end_state(F.col("ligne"), QUOTED, separator).alias("dedans"))
    kept = quoted & ~((maps["dehors"] == 0) & (maps["dedans"] == 1))
    folded = (
        lines.groupBy("fichier", "bloc").agg(F.collect_list(F.when(kept, maps)).alias("cartes"), F.bool_or(~_blank(F.col("ligne"))).alias("plein"))
        .select("fichier", "bloc", "plein", fold.alias("carte")).select("fichier", "bloc", "plein", "carte.*")
    )
    told = _with_states(folded, ["fichier"], ["bloc"], F.lit(0))
    # A block that ends inside a record either began it, or was inside it from its start.
    begins = (F.col("avant") == 0) | F.col("sorti") | (F.col("dedans") == 0)
    earlier = Window.partitionBy("fichier").orderBy("bloc").rowsBetween(Window.unboundedPreceding, -1)
    return told.withColumn("porteur", F.last(F.when(begins, F.col("bloc")), True).over(earlier)).select(
        "fichier", "bloc", F.col("avant").alias("debut"), F.col("apres").alias("fin"), "porteur",
        (F.col("bloc") == F.min(F.when(F.col("plein"), F.col("bloc"))).over(Window.partitionBy("fichier"))).alias("premier"),
    )


def records(spark: SparkSession, path: str | list[str], separator: str, line_end: str = "\n") -> DataFrame:
    """Rows (fichier, bloc, rang, entete, enregistrement): the records of all files as one text each, blank ones left out; entete marks
    the first of a file.

    (fichier, bloc, rang) orders them as the files do. A line end inside quotes is kept as it is written, the one at the end of a
    record is not part of it.
    """
    lines = lines_of(spark, path, line_end)
    # Written once: both halves of the result must see the same blocks. No cell is written, only states.
    blocks = written(blocks_of(lines, separator), "blocs").withColumnsRenamed({"fichier": "_f", "bloc": "_b"})
    maps = lines.withColumn("dehors", _end_state(F.col("ligne"), START, separator)).withColumn("dedans", _end_state(F.col("ligne"), QUOTED, separator))
    # Both sides go to the block's partition, and the windows below need no other.
    met = maps.join(blocks, (F.col("fichier") == F.col("_f")) & (F.col("bloc") == F.col("_b")), "left").drop("_f", "_b")
    missing = F.raise_error(F.lit("The files were split differently while they were read: run the query again."))
    met = met.withColumn("debut", F.coalesce("debut", missing.cast("int")))
    told = _with_states(met, ["fichier", "bloc"], ["rang"], F.col("debut"))
    block, order = Window.partitionBy("fichier", "bloc"), Window.partitionBy("fichier", "bloc").orderBy("rang")
    begins = F.when(F.col("avant") == 0, F.col("rang"))
    head = F.col("premier") & (F.col("rang") == F.min(F.when(~_blank(F.col("ligne")), F.col("rang"))).over(block))
    placed = told.withColumn("_debut", F.last(begins, True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(
        "_dernier", F.max(begins).over(block)
    )
    open_end = (F.col("_debut") == F.col("_dernier")) & (F.col("fin") == 1)
    keyed = placed.withColumn("_bloc", F.when(F.col("_debut").isNull(), F.coalesce("porteur", "bloc")).otherwise(F.col("bloc"))).withColumn(
        "_cle", F.when(F.col("_debut").isNull() | open_end, F.lit(-1).cast("long")).otherwise(F.col("_debut"))
    )
    keyed = keyed.withColumn("entete", F.coalesce(head, F.lit(False)))
    alone = (F.col("avant") == 0) & (F.col("apres") == 0)
    single = keyed.where(alone).select("fichier", "bloc", "rang", "entete", F.col("ligne").alias("enregistrement"))
    several = (
        keyed.where(~alone).groupBy("fichier", "_bloc", "_cle")
        .agg(F.array_sort(F.collect_list(F.struct("bloc", "rang", "ligne"))).alias("_lignes"), F.bool_or("entete").alias("entete"))
        .select("fichier", F.col("_lignes")[0]["bloc"].alias("bloc"), F.col("_lignes")[0]["rang"].alias("rang"), "entete",
                F.array_join(F.transform("_lignes", lambda one: one["ligne"]), line_end).alias("enregistrement"))
    )
    return single.where(~_blank(F.col("enregistrement"))).unionByName(several).withColumn("enregistrement", _trimmed(F.col("enregistrement")))
