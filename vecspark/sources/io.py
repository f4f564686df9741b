"""Delimited files of measurements and groups, and bundles of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables that a bundle may hold.
BUNDLE_KEYS = ("gene_ids", "expression", "gene_to_family", "family_ids", "family_centroids", "shift_vectors")


def _lines(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """(line, n) of one file without its first ``skip`` lines.

    Line numbers count within the file; a file is split by Spark as usual, and only the
    header lines (``skip`` of them) are looked at to leave them out.
    """
    text = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    if not skip:
        return text.withColumnRenamed("value", "line")
    first = [r["n"] for r in text.orderBy("n").limit(skip).collect()]
    return text.where(~F.col("n").isin(first)).withColumnRenamed("value", "line")


def read_gene_ids(spark: SparkSession, path: str, header_rows: int = 1, gene_col: int = 1, delimiter: str = "\t") -> DataFrame:
    """(gene_id): one trimmed column of a delimited file; blank ids are left out."""
    parts = F.split("line", rf"\Q{delimiter}\E")
    ids = _lines(spark, path, header_rows).select("n", F.trim(F.get(parts, F.lit(gene_col - 1))).alias("gene_id"))
    return ids.where("gene_id <> ''").select("gene_id")


def read_expression(spark: SparkSession, paths: list[str], gene_ids: DataFrame, value_cols: list[int], header_rows: int = 1, gene_col: int = 1, delimiter: str = "\t") -> tuple[DataFrame, DataFrame]:
    """(long, rejects) of several files whose value columns become samples in a row.

    ``long`` is (gene_id, sample, value) of the genes in ``gene_ids``; sample k of file f is
    number f * columns + k, from 1.  ``rejects`` is (file, gene_id, reason): ``unknown_gene``
    (the row is skipped), ``missing_value``, ``not_a_number`` or ``not_finite``.
    """
    width = len(value_cols)
    long, rejects = None, None
    for number, path in enumerate(paths):
        parts = F.split("line", rf"\Q{delimiter}\E")
        rows = _lines(spark, path, header_rows).where("trim(line) <> ''").select(F.trim(F.get(parts, F.lit(gene_col - 1))).alias("gene_id"), parts.alias("parts"))
        cells = F.array(*(F.struct(F.lit(number * width + k + 1).alias("sample"), F.trim(F.get("parts", F.lit(c - 1))).alias("text")) for k, c in enumerate(value_cols)))
        known = rows.join(gene_ids.select("gene_id").distinct(), "gene_id", "left_semi")
        values = known.select("gene_id", F.explode(cells).alias("c")).select("gene_id", "c.sample", "c.text").withColumn("value", F.expr("try_cast(text AS DOUBLE)"))
        reason = (
            F.when(F.col("text").isNull() | (F.col("text") == ""), "missing_value")
            .when(F.col("value").isNull(), "not_a_number")
            .when(F.isnan("value") | (F.abs("value") == float("inf")), "not_finite")
        )
        bad = values.withColumn("reason", reason).where("reason IS NOT NULL").select(F.lit(path).alias("file"), "gene_id", "reason")
        unknown = rows.join(gene_ids.select("gene_id").distinct(), "gene_id", "left_anti").select(F.lit(path).alias("file"), "gene_id", F.lit("unknown_gene").alias("reason"))
        good = values.where(reason.isNull()).select("gene_id", "sample", "value")
        found = bad.unionByName(unknown)
        long = good if long is None else long.unionByName(good)
        rejects = found if rejects is None else rejects.unionByName(found)
    if long is None:
        raise ValueError("no file given")
    return long, rejects


def read_orthogroups(spark: SparkSession, path: str, gene_ids: DataFrame | None = None, header_rows: int = 1) -> DataFrame:
    """(gene_id, family_id): a family per line, then tab-parted species columns of comma-parted genes.

    A gene of several lines belongs to the last; with ``gene_ids`` only those genes stay.
    """
    fields = F.split("line", "\t")
    lines = _lines(spark, path, header_rows).select("n", F.trim(F.get(fields, F.lit(0))).alias("family_id"), F.explode(F.slice(fields, 2, 1 << 20)).alias("cell"))
    genes = lines.select("n", "family_id", F.explode(F.split("cell", ",")).alias("g")).select("n", "family_id", F.trim("g").alias("gene_id")).where("gene_id <> ''")
    found = genes.groupBy("gene_id").agg(F.max_by("family_id", "n").alias("family_id"))
    return found if gene_ids is None else found.join(gene_ids.select("gene_id").distinct(), "gene_id", "left_semi")


def save_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One table as Parquet."""
    df.write.mode(mode).parquet(path)


def load_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A saved table; with a schema, columns that differ are an error."""
    df = spark.read.parquet(path)
    if schema is not None:
        want = {f.name: f.dataType for f in schema.fields}
        have = {f.name: f.dataType for f in df.schema.fields}
        if any(have.get(name) != kind for name, kind in want.items()):
            raise ValueError(f"columns differ: {have} instead of {want}")
        df = df.select(*want)
    return df


def sort_key(df: DataFrame) -> str:
    """The column that a bundle's table is laid out by: the gene, else the family, else the first."""
    return next((c for c in ("gene_id", "family_id") if c in df.columns), df.columns[0])


def save_bundle(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Any of the standard tables, laid out for lookups, with a manifest of which folder holds which.

    Each table is parted by ranges of its key (``sort_key``) and sorted inside, with Bloom
    filters of the key; the manifest names the keys, and ``<table>_ranges`` holds the smallest
    and largest key of every file.
    """
    unknown = set(tables) - set(BUNDLE_KEYS)
    if unknown or not tables:
        raise ValueError(f"not standard tables: {sorted(unknown)}" if unknown else "no table given")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        key = sort_key(df)
        laid_out = df.repartitionByRange(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`"))
        laid_out.write.mode(mode).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/{name}")
        placed = spark.read.schema(df.schema).parquet(f"{path}/{name}").select(F.regexp_extract(F.input_file_name(), r"[^/]+$", 0).alias("file"), F.col(f"`{key}`").alias("key"))
        ranges = placed.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
        ranges.coalesce(1).write.mode(mode).parquet(f"{path}/{name}_ranges")
    rows = [(k, k, sort_key(df)) for k, df in sorted(tables.items())]
    spark.createDataFrame(rows, "key string, folder string, sorted_by string").coalesce(1).write.mode(mode).parquet(f"{path}/manifest")


def bundle_files(spark: SparkSession, path: str, name: str, ids: DataFrame, id_col: str) -> list[str]:
    """The files of a bundle's table whose range of keys may hold any of the ids (a row per file reaches the driver)."""
    ranges = spark.read.parquet(f"{path}/{name}_ranges")
    asked = ids.select(F.col(f"`{id_col}`").alias("id")).distinct()
    hit = ranges.join(asked, (F.col("id") >= F.col("low")) & (F.col("id") <= F.col("high")), "left_semi")
    return [f"{path}/{name}/{r['file']}" for r in hit.select("file").orderBy("file").collect()]


def lookup_in_bundle(spark: SparkSession, path: str, name: str, ids: DataFrame, id_col: str | None = None, at_most: int = 1000) -> DataFrame:
    """The rows of a bundle's table whose key is among ``ids``; only files that may hold one are read.

    Up to ``at_most`` ids also become a filter of the scan, so that row groups without them
    are left out by their statistics and Bloom filters.  Null ids find nothing.
    """
    whole = spark.read.parquet(f"{path}/{name}")
    key = next(r["sorted_by"] for r in spark.read.parquet(f"{path}/manifest").where(F.col("key") == name).collect())
    id_col = id_col or key
    files = bundle_files(spark, path, name, ids, id_col)
    if not files:
        return whole.limit(0)
    found = spark.read.schema(whole.schema).parquet(*files)
    few = [r[0] for r in ids.select(F.col(f"`{id_col}`")).where(F.col(f"`{id_col}`").isNotNull()).distinct().limit(at_most + 1).collect()]
    if len(few) <= at_most:
        return found.where(F.col(f"`{key}`").isin(few))
    return found.join(ids.select(F.col(f"`{id_col}`").alias(key)).distinct(), key, "left_semi")


def load_bundle(spark: SparkSession, path: str, keys: tuple[str, ...] = BUNDLE_KEYS) -> tuple[dict[str, DataFrame], list[str]]:
    """The requested tables that the bundle has, and manifest keys that are not standard.

    An empty manifest is an error.
    """
    manifest = {r["key"]: r["folder"] for r in spark.read.parquet(f"{path}/manifest").collect()}  # a row per table
    if not manifest:
        raise ValueError("the manifest is empty")
    return {k: spark.read.parquet(f"{path}/{manifest[k]}") for k in keys if k in manifest}, sorted(set(manifest) - set(BUNDLE_KEYS))

