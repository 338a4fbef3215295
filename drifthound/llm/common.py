"""What the operators share: the shared folder, written tables, text as bytes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts, after A-Z are lower-cased.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent and Spark runs in one process (tests), a
    temporary folder is made and set, so that later calls and checkpoint() use
    the same one; on a cluster the setting is needed.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete the folders of `written` tables that nothing will read again."""
    for df in tables:
        files = df.inputFiles() if df is not None else []
        if files:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_crc(col: str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def prefix_sums(df: DataFrame, order: list[str], sums: list[str], group: str | None = None) -> DataFrame:
    """Exclusive running sums over a global order without a global window.

    Rows are range-partitioned by `order` and written with their partition
    number; each partition (and group) is totalled, the totals are summed up
    over the few partitions, and a window inside a partition adds the rest.
    Adds `<name>_before` and, over the whole group, `<name>_total` for each
    name in `sums`.
    """
    from pyspark.sql import Window as W

    keys = [group] if group else []
    n = shuffle_partitions(df.sparkSession)
    cols = [F.col(c).asc_nulls_last() for c in order]
    parted = written(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_part", F.spark_partition_id()), "ordered")
    before = W.orderBy("_part") if not keys else W.partitionBy(*keys).orderBy("_part")
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    totals = parted.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    offsets = totals.select(
        F.col("_part").alias("_p"), *[F.col(k).alias("_g") for k in keys],
        *[F.coalesce(F.sum(f"_{c}").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_{c}_offset") for c in sums],
        *[F.sum(f"_{c}").over(whole).alias(f"{c}_total") for c in sums],
    )
    within = W.partitionBy("_part", *keys).orderBy(*cols).rowsBetween(W.unboundedPreceding, -1)
    inner = parted.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_{c}_in") for c in sums])
    on = F.col("_part") == F.col("_p")
    if keys:
        on = on & F.col(group).eqNullSafe(F.col("_g"))
    out = inner.join(offsets, on)
    return out.select(*df.columns, *[(F.col(f"_{c}_offset") + F.col(f"_{c}_in")).alias(f"{c}_before") for c in sums], *[f"{c}_total" for c in sums])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column | None = None, per_class: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of at most `per_class` labelled documents of each class: id, text, label, weight.

    Rows are taken in the order of a hash of their id, so reruns agree. The
    weight is what one row stands for. Null ids and labels are left out; an id
    with several labels has the largest, and one with several texts the first.
    """
    rated = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    if keep is not None:
        rated = rated.filter(keep)
    rated = rated.groupBy(F.col(id_col).alias("_i")).agg(F.max(label).cast("int").alias("label"))
    sizes = {r.label: r["count"] for r in rated.groupBy("label").count().collect()}
    chosen = None
    for c in (0, 1):
        part = rated.filter(F.col("label") == c).orderBy(F.xxhash64("_i"), "_i").limit(per_class).withColumn("weight", F.lit(max(1.0, sizes.get(c, 0) / per_class)))
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class ids; the documents' other columns may have any names
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen), F.col("id") == F.col("_i")).select("id", "text", "label", "weight")
    # ids that repeat may not make the sample larger: each stands with one text
    return met.groupBy("id", "label", "weight").agg(F.min("text").alias("text")).select("id", "text", "label", "weight")
