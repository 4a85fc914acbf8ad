"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text's UTF-8 bytes are cut into blocks of a fixed size. Sorting the blocks gives
equal blocks, and only those, one integer name. Then each two neighbouring names
are sorted as pairs and named in turn, level by level, until every document has one
name. Two documents of as many blocks are equal if and only if their last names are:
names are ranks in a sorted order, never hashes, so there are no collisions.

Texts cross the network once, as blocks. A block that fills more than a thousandth
of all blocks is dealt over several tasks and its partial names are joined up from
one representative for each task.

Defined results: a null text counts as the empty text; the empty text is one empty
block. Of equal texts the largest ``doc_id`` stays (null ids come last); of equal
rows one stays. Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Table, join_hot, settled, unused, with_row_id

BLOCK_BYTES = 4096
#: Blocks that one sorted bucket holds on average; a task sorts many buckets.
PER_BUCKET = 256
SALTS = 64


def _name(df: DataFrame, content: str, buckets: int, hot: DataFrame) -> DataFrame:
    """Replace ``content`` by ``name``: its rank within the hash bucket that all its
    copies share, and so an integer that only equal contents share. ``hot`` holds
    the hashes (``_hash``) whose rows are first dealt over SALTS sub-buckets."""
    rows = (
        df.withColumn("_hash", F.xxhash64(content))
        .join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))), "_hash", "left")
        .withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
        .withColumn("_salt", F.when(F.col("_is_hot"), 1 + F.pmod("rid", F.lit(SALTS))).otherwise(0))
    )
    order = Window.partitionBy("_bucket", "_salt").orderBy("_hash", content)
    ranked = rows.withColumn("_rank", F.dense_rank().over(order)).withColumn("_before", F.lag("_hash").over(order)).withColumn("_same", F.lag(content).over(order))
    first = F.col("_before").isNull() | ~F.col("_same").eqNullSafe(F.col(content))
    kept = [c for c in df.columns if c != content]
    return ranked.select(*kept, "_bucket", "_salt", "_rank", F.when((F.col("_salt") > 0) & first, F.col(content)).alias("_content"))


def _joined(named: DataFrame) -> DataFrame:
    """Join up the partial names of hot contents: each sub-bucket sends one row for a
    content, at most 1,000 contents times SALTS rows in all."""
    ranks = Window.partitionBy("_bucket").orderBy("_content")
    merged = named.where(F.col("_content").isNotNull()).select("_bucket", "_salt", "_rank", F.dense_rank().over(ranks).alias("_joined"))
    out = named.drop("_content").join(F.broadcast(merged), ["_bucket", "_salt", "_rank"], "left")
    # bucket, hot or not, rank: three fields of one integer
    name = F.shiftleft(F.col("_bucket").cast("long"), 33) + F.when(F.col("_joined").isNotNull(), F.lit(1 << 32) + F.col("_joined")).otherwise(F.col("_rank").cast("long"))
    return out.withColumn("name", name).drop("_bucket", "_salt", "_rank", "_joined")


def _hot(hashes: DataFrame, rows: int) -> DataFrame:
    """Hashes of over a thousandth of the rows: fewer than 1,000, counted before any shuffle."""
    return hashes.groupBy("_hash").count().where(F.col("count") > max(1000, rows // 1000)).select("_hash")


def name_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: rid, doc_id, sha256 of the text, its number of
    blocks and its final name. (n_blocks, name) is equal exactly for equal texts."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = with_row_id(docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("_body")), "rid")
    sized = base.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("_body") / block_bytes)).cast("int"))
    blocks = (
        sized.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("_block", F.substring(F.col("_body"), F.col("pos") * block_bytes + 1, F.lit(block_bytes)))
        .withColumn("text_sha256", F.when(F.col("pos") == 0, F.sha2("_body", 256)))
        .drop("_body")
    )
    hashes = Table(blocks.groupBy(F.xxhash64("_block").alias("_hash")).agg(F.count(F.lit(1)).alias("n"), F.max("n_blocks").alias("most")))
    total = hashes.df.agg(F.sum("n"), F.max("most")).first()
    count, most = int(total[0] or 0), int(total[1] or 1)
    hot = hashes.df.where(F.col("n") > max(1000, count // 1000)).select("_hash")
    buckets = max(1, -(-count // PER_BUCKET))
    level = Table(_final(_name(blocks, "_block", buckets, hot)))
    hashes.drop()
    heads = level.df.where(F.col("pos") == 0).select("rid", "doc_id", "text_sha256")
    names = level.df.select("rid", "pos", "n_blocks", "name")
    done, tables, width = [names.where(F.col("n_blocks") == 1).select("rid", "n_blocks", "name")], [], 1
    rest = names.where(F.col("n_blocks") > 1)
    while width < most:
        width *= 2
        pairs = (
            rest.groupBy("rid", "n_blocks", F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b"))
            .select("rid", "pos", "n_blocks", F.struct("a", "b").alias("_pair"))
        )
        paired = Table(pairs)
        n = paired.df.count()
        hot_pairs = _hot(paired.df.select(F.xxhash64("_pair").alias("_hash")), n)
        tables.append(paired)
        level = Table(_final(_name(paired.df, "_pair", max(1, -(-n // (8 * PER_BUCKET))), hot_pairs)))
        ended = F.col("n_blocks") <= width
        done.append(level.df.where(ended).select("rid", "n_blocks", "name"))
        rest = level.df.where(~ended)
    last = done[0]
    for more in done[1:]:
        last = last.unionByName(more)
    return last.join(heads, "rid").select("rid", "doc_id", "text_sha256", "n_blocks", "name")


def _final(named: DataFrame) -> DataFrame:
    """Names are written before partial names are joined up: a rank must not be
    counted anew with the rows in another order."""
    return _joined(Table(named).df)


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    named = Table(name_documents(docs, text, key, block_bytes)).df
    rows = named.count()
    named = named.withColumn("_identity", F.struct("n_blocks", "name"))
    groups = named.groupBy("_identity").agg(F.max(F.struct("doc_id", "rid")).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
    out = join_hot(named, groups, "_identity", "group_size", rows)
    return out.select("rid", "doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("_keep.rid")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without all but one of each group of equal texts; all columns stay."""
    docs = settled(docs)
    row = unused(docs, "_row")
    kept = exact_groups(docs, text, key).where("kept").select(F.col("rid").alias(unused(docs, "_kept")))
    return with_row_id(docs, row).join(kept, F.col(row) == F.col(kept.columns[0]), "left_semi").drop(row)
