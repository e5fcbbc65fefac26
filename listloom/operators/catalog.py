"""The catalog of compiled lists: sorting, paging, search, upsert, versioned snapshots, delete and what is still to build."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import folders
from .joins import running

SCHEMA = "id long, name string, url string, r2_download_link string, rule_count int, file_size long, last_updated timestamp, created_at timestamp"
COLUMNS = ["id", "name", "url", "r2_download_link", "rule_count", "file_size", "last_updated", "created_at"]
# What may be sorted by, and the columns meant.
SORTS = {"time": "last_updated", "size": "file_size", "rule": "rule_count", "name": "name"}


def page_arguments(page: int = 1, limit: int = 10) -> tuple[int, int]:
    """A page below 1 is 1; a limit below 1 is 10, above 100 it is 100."""
    return max(page, 1), 10 if limit < 1 else min(limit, 100)


def found(catalog: DataFrame, search: str = "") -> DataFrame:
    """Rows whose name or url contains the text; its % and _ are wildcards."""
    if not search:
        return catalog
    like = f"%{search}%"
    return catalog.where(F.col("name").ilike(like) | F.col("url").ilike(like))


def order_columns(sort: str = "", order: str = "") -> list[Column]:
    column = SORTS.get(sort, "last_updated")
    ascending = order.lower() == "asc" if order in ("asc", "ASC", "desc", "DESC") else sort == "name"
    return [F.col(column).asc() if ascending else F.col(column).desc(), F.col("id").asc()]


#: Rows up to whose place a page is taken from a heap, rows of a range of the order beyond that, and ranges of one step.
TOP, RANGE, PIECES = 10_000, 100_000, 200


def page(catalog: DataFrame, page: int = 1, limit: int = 10, search: str = "", sort: str = "", order: str = "", top: int = TOP, size_of_range: int = RANGE) -> DataFrame:
    """One page of the sorted rows. A page that ends within the first `top` rows is a top-k; for a deeper one the rows are
    stored by ranges of the order, and only the ranges that hold the page are read and sorted, so that memory doesn't grow
    with the page's number. There are at most PIECES ranges at a time: where they are larger than asked for, those that hold
    the page are cut again, and each step has the hundredth part or so of the rows of the one before."""
    number, size = page_arguments(page, limit)
    rows, by, skip = found(catalog, search), order_columns(sort, order), (number - 1) * size
    if skip + size <= top:
        return rows.orderBy(*by).offset(skip).limit(size)
    kept = folders.stored(rows, "rows")
    total = left = kept.count()
    if skip >= total:
        return rows.limit(0)
    spark, more = catalog.sparkSession, True
    while more:
        pieces = min(-(-left // size_of_range), PIECES)
        at = folders.shared_folder(spark, "page")
        ranged = kept.repartitionByRange(pieces, *by).withColumn("_piece", F.spark_partition_id())
        ranged.write.partitionBy("_piece").parquet(at)
        stored = spark.read.schema(ranged.schema).parquet(at)
        wanted, first, here, before = [], 0, 0, 0
        for r in stored.groupBy("_piece").agg(F.count("*").alias("n")).orderBy("_piece").toLocalIterator():
            if before + r["n"] > skip and before < skip + size:
                first, here = first if wanted else before, here + r["n"]
                wanted.append(r["_piece"])
            before += r["n"]
        kept, skip = stored.where(F.col("_piece").isin(wanted)).drop("_piece"), skip - first
        more = pieces == PIECES and size_of_range + size < here < left
        left = here
    return kept.orderBy(*by).offset(skip).limit(size)


def meta(catalog: DataFrame, page: int = 1, limit: int = 10, search: str = "") -> DataFrame:
    number, size = page_arguments(page, limit)
    total = found(catalog, search).agg(F.count("*").alias("total_records"))
    return total.select(F.lit(number).alias("current_page"), F.lit(size).alias("limit"), "total_records", F.ceil(F.col("total_records") / size).cast("int").alias("total_pages"))


def duplicate_urls(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("url").agg(F.count("*").alias("n")).where("n > 1")


def upsert(catalog: DataFrame, batch: DataFrame, now: str) -> DataFrame:
    """The catalog after a batch (name, url, r2_download_link, rule_count, file_size, seq) at the time `now`.

    A known url keeps id and created_at; of a url that comes twice the largest seq counts. New ids follow the largest, in
    order of the urls: new rows are stored by ranges of their urls, ids are counted within each range, and the few ranges'
    totals are added.
    """
    names = ("name", "r2_download_link", "rule_count", "file_size")
    last = batch.groupBy("url").agg(F.max_by(F.struct(*names), "seq").alias("new"))
    clock = F.lit(now).cast("timestamp")
    both = catalog.withColumn("old", F.lit(True)).join(last, "url", "full")
    known = both.where("old").select("id", *(F.coalesce(f"new.{c}", c).alias(c) for c in names), "url", F.when(F.col("new").isNotNull(), clock).otherwise(F.col("last_updated")).alias("last_updated"), "created_at")
    fresh = last.join(catalog.select("url"), "url", "left_anti").select("url", "new.*")
    placed = running(fresh, [], ["url"], {"nth": F.lit(1)}, "upsert")
    top = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    added = placed.select((F.lit(top) + F.col("nth") + 1).alias("id"), *names, "url", clock.alias("last_updated"), clock.alias("created_at"))
    return known.select(COLUMNS).unionAll(added.select(COLUMNS))


def write(catalog: DataFrame, folder: str, version: int) -> None:
    """Writes a snapshot of the catalog and then publishes it as a version by its marker.

    Until then no reader sees any of it, and what a broken write leaves behind is never read. A version that another writer
    has published since is refused with `folders.Taken`: read the catalog anew and try the next one.
    """
    spark = catalog.sparkSession
    if version in folders.versions(spark, folder):
        raise folders.Taken(f"{folder}: version {version}")
    data = f"data/{version}-{uuid.uuid4().hex}"
    catalog.select(COLUMNS).write.parquet(f"{folder}/{data}")
    folders.mark(spark, folder, version, {"data": data})


def last_version(spark: SparkSession, folder: str) -> int:
    """The last published version; 0 where there is none."""
    return max(folders.versions(spark, folder), default=0)


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The last published snapshot (before a version); an empty catalog where there is none."""
    known = [v for v in folders.versions(spark, folder) if before is None or v < before]
    if not known:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/{folders.facts(spark, folder, known[-1])['data']}")


def apply(spark: SparkSession, folder: str, batch: DataFrame, now: str, tries: int = 5) -> int:
    """Upserts a batch into the last snapshot and publishes the next one; begins anew when another writer comes first."""
    for left in range(tries - 1, -1, -1):
        version = last_version(spark, folder) + 1
        try:
            write(upsert(current(spark, folder, before=version), batch, now), folder, version)
            return version
        except folders.Taken:
            if not left:
                raise
    raise AssertionError("tries must be positive")


def sweep(spark: SparkSession, folder: str, keep: int = 3) -> None:
    """Removes all but the last `keep` snapshots, and what broken writes have left: nobody must be writing meanwhile."""
    kept = folders.versions(spark, folder)[-keep:]
    live = {folders.facts(spark, folder, v)["data"] for v in kept}
    for name in folders.names(spark, f"{folder}/data"):
        if f"data/{name}" not in live:
            folders.remove(spark, f"{folder}/data/{name}")
    folders.prune(spark, folder, min(kept, default=0))


def delete(catalog: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog without the urls, and the urls that it never had."""
    return catalog.join(urls, "url", "left_anti"), urls.join(catalog, "url", "left_anti")


def to_build(requested: DataFrame, catalog: DataFrame, force: bool = False) -> DataFrame:
    return requested if force else requested.join(catalog, "url", "left_anti")


def cached(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows of requested urls that are built already."""
    return catalog.join(requested.select("url").distinct(), "url", "left_semi")


def run_summary(runs: DataFrame) -> DataFrame:
    """run_id, succeeded, failed of runs (run_id, status, stage); a failure to write the catalog alone is no failure."""
    failed = (F.col("status") == "failed") & (F.col("stage") != "catalog")
    return runs.groupBy("run_id").agg(F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"))
