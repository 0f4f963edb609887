"""Near-duplicates by SimHash fingerprints, linked through shared neighbours in Hamming space (meet in the middle).

Two fingerprints at distance 3 or less meet in a point that is near to both: every fingerprint emits the points within
half the radius, rounded down, and for the odd bit one side goes a step further. Neighbouring points differ in parity, so
at distance 3 one side has even parity: only that side emits points at distance 2, and of these only the pairs of bits in
the same half of the word, since of any three bits two lie in one half. A point has at most 2,081 fingerprints around it,
so no group is larger than that, whatever the number of copies; and every link found is true without a further look.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches
from tamis.llm.components import components
from tamis.session import written

BITS = 64
SHINGLE = 3
SEED = 42
#: Shingles unpacked into bits at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is set where more than half of the shingles' hashes have it; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, count = iter([b" ".join(words)]), 1
    else:
        shingles, count = map(b" ".join, zip(*(words[k:] for k in range(shingle)))), len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, BLOCK):
        block = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print) with the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(text, shingle) for text in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"doc_id {kind}, print long"
    )


HALF = BITS // 2
SINGLES = [1 << bit for bit in range(HALF)]
PAIRS = [a | b for a, b in combinations(SINGLES, 2)]


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``print``), enough to connect all at distance 3 or less.

    Around each point, all fingerprints at distance 1 or less, and those that came from distance 2, are linked to the
    smallest of the former: at most 1 + 2 bits apart. Points are dealt by one half of their bits, once for each half: a
    fingerprint is sent to its own half and the 32 halves a bit away, and the points that share its half are formed there.
    """
    masks = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    low, high = F.col("print").bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned("print", HALF)
    sent = (
        prints.select("print", F.explode(F.array(F.struct(high.alias("key"), low.alias("rest"), F.lit(0).alias("half")), F.struct(low.alias("key"), high.alias("rest"), F.lit(1).alias("half")))).alias("to"))
        .select("print", "to.half", "to.key", "to.rest", F.explode(masks([0, *SINGLES])).alias("step"))
        .select("half", F.col("key").bitwiseXOR(F.col("step")).alias("key"), "rest", "print", (F.col("step") == 0).alias("own"))
        .repartition("half", "key")
    )
    even = F.bit_count("print") % 2 == 0
    flips = F.when(F.col("own") & even, masks([0, *SINGLES, *PAIRS])).when(F.col("own"), masks([0, *SINGLES])).otherwise(masks([0]))
    points = sent.select("half", "key", "rest", "print", F.explode(flips).alias("flip")).select(
        "half", "key", F.col("rest").bitwiseXOR(F.col("flip")).alias("point"), "print", (F.bit_count("flip") < 2).alias("near")
    )
    # Partitioned by half and key already: the window sorts, but moves nothing.
    around = Window.partitionBy("half", "key", "point")
    met = points.withColumn("center", F.min(F.when(F.col("near"), F.col("print"))).over(around))
    return met.where("center <> print").select("print", "center").distinct()


def near_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE,
) -> DataFrame:
    """Fingerprint and component of every document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Two documents are linked where their fingerprints differ in 3 bits or fewer; component_id is the smallest doc_id that
    can be reached through links, the document's own included. Equal fingerprints are one node, so thousands of copies
    cost one fingerprint and no pairs; rows come back one for one.

    Missing, empty and blank texts have fingerprint zero and are linked like any other; texts of any length are read whole,
    a shingle's bits at a time; repeated rows stay repeated; a missing id is never the smallest unless all are missing; an
    empty table gives no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs, id_column, text_column, shingle), "prints")
    # The smallest id of each fingerprint: one row per fingerprint and task is shuffled, however many copies there are.
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    nodes = written(nodes, "print-nodes")
    roots = components(links(nodes.select("print")))
    rooted = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", F.coalesce("root", "print").alias("root"), "least"
    )
    # Roots are unique per component; a component's smallest id is an aggregate, and what joins back is one row per print.
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(smallest, "root").select("print", "component_id"), "print-components")
    return prints.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
