"""Sharding by extendible hashing.

The directory is indexed by the first bits of a document's hash. Only a bucket above the byte limit splits, on the
next bit, until every shard fits. Sizes are summed by a prefix of DIRECTORY_BITS more bits at a time, and each open
bucket is split by a task of its own, which reads at most 2 ** DIRECTORY_BITS sums; buckets that are still too large
after those bits go on with the next. The directory is a table: neither it nor its leaves reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import Stage, unused

SHARD_BYTES = 16 << 20
DIRECTORY_BITS = 12
HASH_BITS = 60


def split(sizes: dict[str, int], at: str, limit: int, bits: int) -> dict[str, int]:
    """Leaves below prefix at: prefix -> bytes. sizes: bytes of each prefix of bits more bits that has documents."""
    total, out, todo = sum(sizes.values()), {}, [(at, list(sizes.items()))]
    if total <= limit:
        return {at: total}
    while todo:
        prefix, below = todo.pop()
        size = sum(n for _, n in below)
        if size <= limit or len(prefix) == len(at) + bits:
            out[prefix] = size
            continue
        for bit in "01":
            if part := [(p, n) for p, n in below if p[len(prefix)] == bit]:
                todo.append((prefix + bit, part))
    return out


def _split_one(limit: int, bits: int):
    def run(key, pdf):
        import pandas as pd

        found = split(dict(zip(pdf["prefix"].tolist(), pdf["b"].tolist(), strict=True)), key[0], limit, bits)
        return pd.DataFrame({"shard": list(found), "bytes": list(found.values())})

    return run


def directory(sized: DataFrame, stage: Stage, limit: int, directory_bits: int) -> DataFrame:
    """sized (h, b) -> staged (shard, bytes): every leaf, its prefix as bits."""
    leaves, open_, depth = [], None, 0
    while depth < HASH_BITS:
        bits = min(directory_bits, HASH_BITS - depth)
        part = sized
        if open_ is not None:
            part = sized.join(stage.small(open_), F.substring("h", 1, depth) == F.col("shard"), "left_semi")
        sums = part.groupBy(F.substring("h", 1, depth + bits).alias("prefix")).agg(F.sum("b").alias("b"))
        found = sums.groupBy(F.substring("prefix", 1, depth).alias("at")).applyInPandas(_split_one(limit, bits), "shard string, bytes long")
        found = stage.put(found, "leaves")
        depth += bits
        more = (F.col("bytes") > limit) & (F.length("shard") == depth) if depth < HASH_BITS else F.lit(False)
        leaves.append(found.where(~more))
        open_ = stage.put(found.where(more).select("shard"), "open")
        if open_.isEmpty():
            break
    out = leaves[0]
    for other in leaves[1:]:
        out = out.union(other)
    return stage.put(out, "directory")


def _paged(large: DataFrame, stage: Stage, limit: int) -> DataFrame:
    """Rows of shards that no bit makes smaller, with page: by running size, in the order in which they were written.

    Every limit bytes end a page; the document that such an end falls into has a page of its own, so that no page is
    larger than the limit or one document. A shard's rows are ranked by the tasks that wrote them, not in one.
    """
    rows = stage.put(large.withColumn("row", F.monotonically_increasing_id()), "large").withColumn("slice", F.shiftright("row", 33))
    slices = rows.groupBy("shard", "slice").agg(F.sum("size").alias("b"))
    before = F.coalesce(F.sum("b").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = stage.put(slices.select(F.col("shard").alias("s_shard"), F.col("slice").alias("s_slice"), before.alias("before")), "slices")
    met = rows.join(stage.small(slices), (F.col("shard") == F.col("s_shard")) & (F.col("slice") == F.col("s_slice")))
    begin = F.col("before") + F.coalesce(F.sum("size").over(Window.partitionBy("shard", "slice").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = met.withColumn("begin", begin)
    first, last = F.floor(F.col("begin") / limit), F.floor((F.col("begin") + F.greatest(F.col("size"), F.lit(1)) - 1) / limit)
    return met.withColumn("page", F.when(first == last, 2 * first).otherwise(2 * last - 1).cast("long"))


def shard(docs: DataFrame, limit: int = SHARD_BYTES, directory_bits: int = DIRECTORY_BITS) -> DataFrame:
    """docs with five more columns: __bytes, __shard (the hash prefix, as bits), __depth (its length), __page and
    __shard_bytes; a name that docs has already gets underscores at its end.

    A document's hash is the first 60 bits of the MD5 of its doc_id; its bytes are those of its text in UTF-8, none for a null. A null
    doc_id hashes as an empty text. Rows with the same doc_id cannot be told apart by bits: a bucket that still is
    too large at 60 bits is cut into pages, none of which is above the limit but for a document that alone is.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "sharding")
    added = unused(docs, "bytes", "shard", "depth", "page", "shard_bytes")
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    digest = F.md5(F.coalesce(at["doc_id"].cast("string"), F.lit("")).cast("binary"))
    bits = F.lpad(F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")
    size = F.coalesce(F.octet_length(at["text"].cast("string")), F.lit(0)).cast("long")
    sized = stage.put(plain.select(bits.alias("h"), size.alias("b")).groupBy("h").agg(F.sum("b").alias("b")), "sizes")
    leaves = directory(sized, stage, limit, directory_bits)
    depths = [r[0] for r in leaves.select(F.length("shard").alias("d")).distinct().orderBy("d").collect()] or [0]  # 61 at most
    prefixes = lambda h: F.explode(F.array(*[F.substring(h, 1, d) if d else F.lit("") for d in depths]))
    rows = plain.select("*", size.alias("size"), bits.alias("h"))
    known = stage.small(leaves)
    if known is not leaves:
        # a document's leaf: an equal join for each depth in use
        out = rows.withColumn("p", prefixes("h")).join(known, F.col("p") == F.col("shard")).drop("p")
    else:
        # a directory too large to send around meets the hashes first, so that texts are shuffled once
        of = sized.select(F.col("h").alias("of_h"), prefixes("h").alias("p")).join(leaves, F.col("p") == F.col("shard")).drop("p")
        out = rows.join(of, F.col("h") == F.col("of_h")).drop("of_h")
    if not leaves.where(F.col("bytes") > limit).isEmpty():  # only whole hashes shared by rows, or one document above the limit
        above = F.col("bytes") > limit
        out = out.where(~above).withColumn("page", F.lit(0).cast("long")).unionByName(_paged(out.where(above), stage, limit).drop("row", "slice", "s_shard", "s_slice", "before", "begin"))
    else:
        out = out.withColumn("page", F.lit(0).cast("long"))
    return out.select(*plain.columns, "size", "shard", F.length("shard").cast("long").alias("depth"), "page", "bytes").toDF(*docs.columns, *added)


def write_sharded(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """A folder for each shard and page, with one file: the rows of a page meet in one task, and are no more than the limit.

    A shard's name there is its bits after a b, so that no reader takes them for a number.
    """
    out = shard(docs, limit)
    _, name, _, page, _ = out.columns[-5:]
    kept = [F.col(f"`{c}`") for c in docs.columns]
    out.select(*kept, F.concat(F.lit("b"), name).alias(name), page).repartition(name, page).write.partitionBy(name, page).parquet(path)


def _digest(docs: DataFrame, limit: int) -> DataFrame:
    out = shard(docs.select("doc_id", "text"), limit)
    return out.select("doc_id", F.col("__bytes").alias("n_bytes"), F.col("__shard").alias("shard"), F.col("__depth").alias("depth"), F.col("__page").alias("page"), F.col("__shard_bytes").alias("shard_bytes"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARD_BYTES)


def small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with shards of 256 KiB, which small tables split several times."""
    return _digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), 1 << 18)


_LEAVES = " UNION ALL ".join(f"SELECT doc_id, {d} AS depth, sum(n_bytes) OVER (PARTITION BY left(h, {d})) AS s FROM w" for d in range(25))


def _sql(limit: int) -> str:
    return f"""
WITH x AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
w AS (SELECT doc_id, n_bytes, left(CAST(CAST(('0x' || left(m, 15)) AS BIGINT) AS BIT)::VARCHAR, 64)[5:] AS h FROM x),
a AS ({_LEAVES}),
d AS (SELECT doc_id, min(depth) AS depth, CAST(arg_min(s, depth) AS BIGINT) AS shard_bytes FROM a WHERE s <= {limit} GROUP BY doc_id)
SELECT w.doc_id, n_bytes, left(h, depth) AS shard, CAST(depth AS BIGINT) AS depth, CAST(0 AS BIGINT) AS page, shard_bytes FROM w JOIN d ON d.doc_id = w.doc_id
"""


OP4_SQL, SMALL_SHARDS_SQL = _sql(SHARD_BYTES), _sql(1 << 18)
