"""An inverted index of letter triples for searches by parts of names.

A name that contains a text contains all its triples of letters, so the rows with the text's rarest triple are all that a
search has to look at; the search itself then verifies and ranks them. The index is a stored table (triple, id) in
folders by a hash of the triple, so that a search opens the folders of the text's triples alone. Keys that must agree as
a whole, such as initials, are in it with a mark before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterly.functions.names import search_name

FOLDERS = 64
WHOLE = "="
#: Up to so many candidates are broadcast to the table of names; with more the join shuffles.
BROADCAST_IDS = 200_000


def folder(triple):
    return F.pmod(F.xxhash64(triple), F.lit(FOLDERS)).cast("int")


def _triples(text):
    inner = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(F.length(text) >= 3, F.array_distinct(inner)).otherwise(F.array().cast("array<string>"))


def postings(rows: DataFrame, id_col: str, parts: list[str], lists: tuple[str, ...] = (), whole: list[str] = ()) -> DataFrame:
    """(triple, id), distinct: of the text columns `parts`, of the texts in the array columns `lists`, and the columns
    `whole` as they are behind a mark. Null texts have none."""
    own = [_triples(F.coalesce(F.col(c), F.lit(""))) for c in parts]
    own += [F.flatten(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), _triples)) for c in lists]
    own += [F.when(F.length(c) > 0, F.array(F.concat(F.lit(WHOLE), F.col(c)))).otherwise(F.array().cast("array<string>")) for c in whole]
    # Rows of one id are put together before triples are written out, so that no task holds its triples to find equal ones.
    used = F.struct(*dict.fromkeys([*parts, *lists, *whole]))
    per = rows.groupBy(F.col(id_col).alias("id")).agg(F.collect_set(used).alias("_r")).select("id", F.explode("_r").alias("_r"), (F.size("_r") > 1).alias("_more")).select("id", "_more", "_r.*")
    found = per.select("id", "_more", F.array_distinct(F.concat(*own)).alias("_t"))
    one = found.where("NOT _more").select(F.explode("_t").alias("triple"), "id")
    return one.unionByName(found.where("_more").select(F.explode("_t").alias("triple"), "id").distinct())


def write(found: DataFrame, path: str, files: int = 1) -> DataFrame:
    """Write postings by folder, each in `files` sorted files, and read them again. More files for more names keep a
    folder with a frequent triple from being one task's work."""
    placed = found.withColumn("folder", folder(F.col("triple")))
    dealt = placed.repartition("folder", F.pmod(F.xxhash64("id"), F.lit(files)))
    dealt.sortWithinPartitions("folder", "triple").write.partitionBy("folder").parquet(path)
    return found.sparkSession.read.schema(placed.schema).parquet(path)


def having(index: DataFrame, keys: list[str]) -> DataFrame:
    """The index rows of some triples; their folders are named, so that no other is opened."""
    spark = index.sparkSession
    named = spark.createDataFrame([(k,) for k in keys], "k string").select(folder(F.col("k")).alias("f")).distinct().collect()  # a row a triple of the text
    return index.where(F.col("folder").isin([r.f for r in named]) & F.col("triple").isin(keys))


def candidates(index: DataFrame, rows: DataFrame, id_col: str, query: str) -> DataFrame:
    """The rows of which a search for a text needs to look at: those with its rarest triple, and those that agree with it as
    a whole. Every match is among them. A text of under three letters has no triple: then all rows are looked at."""
    q = index.sparkSession.range(1).select(search_name(F.lit(query)).alias("q")).first().q
    wanted = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    if not wanted:
        return rows
    counts = {r.triple: r.n for r in having(index, wanted).groupBy("triple").agg(F.count("*").alias("n")).collect()}  # a row a triple of the text
    rarest = min(wanted, key=lambda t: (counts.get(t, 0), t))
    whole = WHOLE + q.replace(" ", "")
    keys = [rarest, whole] if counts.get(rarest) else [whole]
    found = having(index, keys).select(F.col("id").alias(id_col)).distinct()
    few = having(index, [whole]).limit(BROADCAST_IDS).count() + counts.get(rarest, 0) < BROADCAST_IDS
    return rows.join(F.broadcast(found) if few else found, id_col, "left_semi")
