"""Substring search by a positional trigram index.

Every place of a row's searched text (its fields in lower case with a space between) has a posting: the three characters that begin there, the row's key and the place. A query is cut into trigrams that cover it; a row holds it
exactly where all of them stand at their offsets from one start (a bit for each of them is gathered there). So a search reads postings of the query's trigrams alone, never the rows. Postings are partitioned by first character and sorted, so that a search reads
few files of them, and queries of one or two characters, and many queries at once, are searches of the same kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import haystack

GRAM, BUCKETS = 3, 64
#: A bucket has a file for so many shuffle partitions.
FILES = 32
#: Trigrams of a query that one bitmap holds.
WORD = 62
#: The bucket of the one posting of each row that says it is there.
ALL = -1


def _bucket(gram: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, 1)), F.lit(BUCKETS)).cast("int")


def build_index(rows: DataFrame, key: str, fields: Sequence[str], path: str) -> None:
    """Writes the postings of the rows: key, gram and pos (from 0), partitioned by bucket."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A row makes as many postings as its text has characters, so rows are dealt out before: a small file is one task else.
    spread = rows.select(F.col(key).alias("key"), haystack(*[F.col(f) for f in fields]).alias("t")).repartition(parts)
    places = F.concat(F.array(F.lit("")), F.regexp_extract_all("t", F.lit(f"(?s)(?=(.{{1,{GRAM}}}))."), F.lit(1)))  # first the posting that says the row is there
    postings = spread.select("key", F.posexplode(places).alias("at", "gram"))
    every = postings.select("key", F.greatest(F.col("at") - 1, F.lit(0)).alias("pos"), "gram", F.when(F.col("at") == 0, F.lit(ALL)).otherwise(_bucket(F.col("gram"))).alias("bucket"))
    # A bucket's postings are dealt out by key and gram, so a frequent first character is no one task's.
    share = F.pmod(F.xxhash64("key", "gram"), F.lit(parts // FILES + 1))
    every.repartition(parts, "bucket", share).sortWithinPartitions("bucket", "gram", "key").write.partitionBy("bucket").parquet(path)


def covering(query: str) -> list[tuple[int, str]]:
    """Offsets and trigrams that cover a query; of one under three characters, itself."""
    if len(query) <= GRAM:
        return [(0, query)]
    offsets = [*range(0, len(query) - GRAM, GRAM), len(query) - GRAM]
    return [(o, query[o : o + GRAM]) for o in offsets]


def search(spark: SparkSession, path: str, queries: Sequence[str]) -> DataFrame:
    """query and key of each row whose text holds a query, in any case; an empty query is in every row."""
    postings = spark.read.parquet(path)
    wanted = {q: q.lower() for q in dict.fromkeys(queries)}
    made = None
    parts = [(q, o, g, len(covering(low)), i // WORD, 1 << i % WORD) for q, low in wanted.items() if low for i, (o, g) in enumerate(covering(low))]
    if parts:
        grams = sorted({p[2] for p in parts})
        need = spark.createDataFrame(parts, "query string, offset int, want string, n int, word int, bit long")
        buckets = sorted({r[0] for r in need.select(_bucket(F.col("want"))).collect()})
        short = [g for g in grams if len(g) < GRAM]
        hit = F.col("gram").isin([g for g in grams if len(g) == GRAM])
        for g in short:
            hit = hit | F.startswith("gram", F.lit(g))
        read = postings.filter(F.col("bucket").isin(buckets) & hit)
        whole = read.join(F.broadcast(need.filter(F.length("want") == GRAM)), F.col("gram") == F.col("want"))  # as many rows as the queries have trigrams
        found = whole.select("query", "key", "n", "word", "bit", (F.col("pos") - F.col("offset")).alias("start"))
        for q, low in wanted.items():
            if 0 < len(low) < GRAM:
                found = found.unionByName(read.filter(F.startswith("gram", F.lit(low))).select(F.lit(q).alias("query"), "key", F.lit(1).alias("n"), F.lit(0).alias("word"), F.lit(1).cast("long").alias("bit"), F.col("pos").alias("start")))
        words = [f"got_{w}" for w in range(max(p[4] for p in parts) + 1)]
        got = found.groupBy("query", "key", "start", "n").agg(*[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0))).alias(name) for w, name in enumerate(words)])
        made = got.filter(sum((F.bit_count(w) for w in words), F.lit(0)) == F.col("n")).select("query", "key").distinct()
    for q, low in wanted.items():
        if not low:
            every = postings.filter(F.col("bucket") == ALL).select(F.lit(q).alias("query"), "key").distinct()
            made = every if made is None else made.unionByName(every)
    return made if made is not None else postings.select(F.lit("").alias("query"), "key").limit(0)
