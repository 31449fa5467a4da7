"""A pair of tables as co-bucketed Parquet files: one file for each table and bucket.

Rows are clustered by bucket, one partition each, fully sorted and written through the dynamic
``partitionBy(table, bucket)`` writer without a bound on the records of a file, so each folder
gets one file. A job of renames then flattens the folders: its tasks move their files by
themselves, and a task that runs again finds what is moved already. What goes to the driver or
into these jobs is a row for each bucket or pair of old file and bucket, at most buckets squared.

A file holds a whole bucket by contract, so one task sorts (with spills) and streams it, also
where one key has a third of all rows. Only keys and counts are shuffled besides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import delete, free_name, release, shared_folder, small_batches, table, written

BUCKETS, SALT = 150, "pair"


def crc_bucket(key: Column, buckets: int = BUCKETS, salt: str = "") -> Column:
    """Unsigned crc32 of salt and decimal key, modulo the buckets; null for a null key."""
    return F.pmod(F.crc32(F.concat(F.lit(salt), key.cast("string")).cast("binary")), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Side:
    """One table of a pair: its name in paths, its rows and the number of the file that each row starts in."""

    name: str
    rows: DataFrame
    number: Column


def _order(columns: list[str], key: str) -> list[Column]:
    return [F.desc_nulls_first(key), *(F.asc_nulls_first(c) for c in columns if c != key)]


def write_clustered(df: DataFrame, columns: list[str], key: str, number: Column, numbers: int, name: str, folder: str) -> None:
    """``columns`` of ``df`` below ``folder/table=name/bucket=number``, one sorted file each; numbers are under ``numbers``."""
    b = free_name("bucket", df)
    t = free_name("table", df)
    rows = df.select(*columns, number.alias(b))
    # The name depends on the row for Catalyst, so that it stays a key of the sort and the writer takes the order as it is.
    rows = rows.withColumn(t, F.when(F.col(b) >= 0, F.lit(name)))
    clustered = rows.repartitionById(numbers, F.col(b)).sortWithinPartitions(t, b, *_order(columns, key))
    clustered.write.option("maxRecordsPerFile", 0).partitionBy(t, b).parquet(f"{folder}/{name}")


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _files(spark, folder)
    return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Move the only data file of each folder to its target, or delete where there is no target."""
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            files, source = fs.FileSystem.from_uri(row["source"]) if ":" in row["source"] else (fs.LocalFileSystem(), row["source"])
            target = row["target"] and source.removesuffix(row["source"].rpartition("//")[2]) + row["target"].rpartition("//")[2]
            if target is None:
                if files.get_file_info(source).type != fs.FileType.NotFound:
                    files.delete_file(source)
                continue
            found = files.get_file_info(fs.FileSelector(source, allow_not_found=True))
            data = [x.path for x in found if x.base_name.endswith(".parquet")]
            if len(data) == 1:
                files.move(data[0], target)
            elif data or files.get_file_info(target).type == fs.FileType.NotFound:  # an earlier attempt has moved it
                raise ValueError(f"{len(data)} files in {source}")
        yield batch


def settle(spark: SparkSession, moves: list[tuple[str, str | None]]) -> None:
    """Renames and deletions as a job of one small task for each dozen files; it can run again."""
    if moves:
        jobs = spark.createDataFrame(moves, "source string, target string").repartition(max(1, len(moves) // 12))
        jobs.mapInArrow(_settle, "source string, target string").write.format("noop").mode("overwrite").save()


def flatten(spark: SparkSession, staged: str, root: str, name: str, prefix: str) -> None:
    """``staged/name/table=../bucket=n/part-..`` to ``root/name/prefix-n.parquet``."""
    files, home = _files(spark, f"{root}/{name}")
    files.mkdirs(home)
    moves = []
    for t in (x for x in _names(spark, f"{staged}/{name}") if "=" in x):
        for b in (x for x in _names(spark, f"{staged}/{name}/{t}") if "=" in x):
            moves.append((f"{staged}/{name}/{t}/{b}", f"{root}/{name}/{prefix}-{int(b.rpartition('=')[2]):05d}.parquet"))
    settle(spark, moves)
    files, path = _files(spark, f"{staged}/{name}")
    files.delete(path, True)
    release(spark)


def write_starts(spark: SparkSession, root: str, side: Side, key: str, numbers: int = BUCKETS) -> None:
    """The table as numbered files ``root/name/start-n.parquet``, each sorted."""
    staged = f"{root}/staged-{uuid4().hex}"
    write_clustered(side.rows, side.rows.columns, key, side.number, numbers, side.name, staged)
    flatten(spark, staged, root, side.name, "start")
    _drop(spark, staged)


def _drop(spark: SparkSession, folder: str) -> None:
    files, path = _files(spark, folder)
    files.delete(path, True)


def _started(spark: SparkSession, root: str, side: Side) -> tuple[DataFrame, str]:
    """The rows of a table's files with the number in the file's name."""
    df = spark.read.schema(side.rows.schema).parquet(f"{root}/{side.name}")
    start = free_name("start", df)
    return df.withColumn(start, F.regexp_extract(df.metadataColumn("_metadata")["file_name"], r"start-(\d+)", 1).cast("int")), start


def rewrite_pair(spark: SparkSession, root: str, left: Side, right: Side, key: str, buckets: int = BUCKETS, salt: str = SALT) -> DataFrame:
    """Files that write_starts() made, rewritten in place to one file for each table and bucket; the result lists them.

    A row of ``left`` goes to the bucket of its key; one of ``right`` too if ``left`` has its key,
    else to bucket ``buckets``; rows of either with a null key go to the one after it. A file
    stays where it is if it holds exactly the rows of a bucket; all others are written anew and
    then the old ones go. Empty buckets have no file; repeated rows stay repeated; two empty
    tables give no rows.
    """
    orphan, unknown = F.lit(buckets), F.lit(buckets + 1)
    (l, l_start), (r, r_start) = _started(spark, root, left), _started(spark, root, right)
    own = F.coalesce(crc_bucket(F.col(key), buckets, salt), unknown)
    # Keys and counts: which keys of the right are unknown to the left, and how many pairs a bucket has.
    n_left, n_right = (x.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias(n)) for x, n in ((l, "n_left"), (r, "n_right")))
    keys = written(n_right.join(n_left, "key", "left"))
    pairs = keys.where("n_left is not null").groupBy(crc_bucket(F.col("key"), buckets, salt).alias("bucket")).agg(F.sum(F.col("n_left") * F.col("n_right")).alias("n_joined"))
    mark, other = free_name("unknown", r), free_name("key", r)
    unmatched = written(keys.where("n_left is null").select(F.col("key").alias(other), F.lit(True).alias(mark)))
    placed = r.join(unmatched, r[key] == unmatched[other], "left").withColumn(mark, F.when(F.col(mark), orphan).otherwise(own)).drop(other)
    bucket = {left.name: own, right.name: F.col(mark)}
    rows = {left.name: (l, l_start), right.name: (placed, r_start)}
    parts = written(_lineage(rows, bucket))
    joined = written(pairs)
    stays = _stays(parts)
    staged = f"{root}/staged-{uuid4().hex}"
    for side in (left, right):
        kept = [b for t, b, _ in stays if t == side.name]
        df, _ = rows[side.name]
        df = df.where(~bucket[side.name].isin(kept)) if kept else df
        write_clustered(df, side.rows.columns, key, bucket[side.name], buckets + 2, side.name, staged)
        flatten(spark, staged, root, side.name, "bucket")
        held = {f"start-{s:05d}.parquet" for t, _, s in stays if t == side.name}
        settle(spark, [(f"{root}/{side.name}/{n}", None) for n in _names(spark, f"{root}/{side.name}") if n.startswith("start-") and n not in held])
    _drop(spark, staged)
    delete(keys, unmatched)
    return manifest(spark, root, (left, right), key, parts, joined, stays)


def _lineage(rows: dict[str, tuple[DataFrame, str]], bucket: dict[str, Column]) -> DataFrame:
    """``(table_name, bucket, start, n)``: how many rows each file gives to each bucket, counted before the shuffle."""
    out = None
    for name, (df, start) in rows.items():
        one = df.select(bucket[name].alias("bucket"), F.col(start).alias("start")).groupBy("bucket", "start").agg(F.count("*").alias("n"))
        one = one.select(F.lit(name).alias("table_name"), "bucket", "start", "n")
        out = one if out is None else out.unionByName(one)
    return out


def _stays(parts: DataFrame) -> list[tuple[str, int, int]]:
    """``(table, bucket, file)`` where all rows of the file are all rows of the bucket: at most one a bucket."""
    alone = parts.groupBy("table_name", "bucket").agg(F.count("*").alias("files"), F.min("start").alias("start")).where("files = 1")
    whole = parts.groupBy("table_name", "start").agg(F.count("*").alias("parts")).where("parts = 1")
    return [tuple(x) for x in alone.join(whole, ["table_name", "start"]).select("table_name", "bucket", "start").collect()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and digest of the keys of each file, whose rows come one after another in order."""
    now, n, digest, out = None, 0, None, []
    for batch in batches:
        number, keys = batch.column(0).to_numpy(), batch.column(1).cast(pa.string()).fill_null("")
        at = 0
        while at < len(number):
            end = at + int((number[at:] == number[at]).sum())
            if number[at] != now:
                if digest:
                    out.append({"number": now, "n_rows": n, "ids_sha256": digest.hexdigest()})
                now, n, digest = int(number[at]), 0, hashlib.sha256()
            digest.update((("," if n else "") + ",".join(keys.slice(at, end - at).to_pylist())).encode())
            n, at = n + end - at, end
    if digest:
        out.append({"number": now, "n_rows": n, "ids_sha256": digest.hexdigest()})
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("number", pa.int32()), ("n_rows", pa.int64()), ("ids_sha256", pa.string())]))


def manifest(spark: SparkSession, root: str, sides: tuple[Side, ...], key: str, parts: DataFrame, joined: DataFrame, stays: list[tuple[str, int, int]]) -> DataFrame:
    """A row for each final file; counts and digests of keys are read back from the files, in their order."""
    small_batches(spark)
    stayed = {(t, f"start-{s:05d}.parquet"): b for t, b, s in stays}
    files, read = [], None
    for side in sides:
        names = [n for n in _names(spark, f"{root}/{side.name}") if n.endswith(".parquet")]
        if not names:
            continue
        df = spark.read.parquet(f"{root}/{side.name}")
        columns = ",".join(df.columns)
        first = len(files)
        for n in names:
            b = stayed.get((side.name, n))
            files.append((len(files), side.name, f"{root}/{side.name}/{n}", columns, int(n[7:12]) if b is None else b, b is None))
        places = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.lit(first + k))))
        about = df.metadataColumn("_metadata")
        one = df.select(places[about["file_name"]].alias("number"), F.col(key).cast("string").alias("id"), about["row_index"].alias("row"))
        read = one if read is None else read.unionByName(one)
    listed = spark.createDataFrame(files, "number int, table_name string, path string, columns string, bucket int, rewritten boolean")
    if read is None:
        read = spark.createDataFrame([], "number int, id string, row long")
    clustered = read.repartitionById(max(1, len(files)), F.col("number")).sortWithinPartitions("number", "row").select("number", "id")
    digests = clustered.mapInArrow(_digests, "number int, n_rows long, ids_sha256 string")
    sources = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "n"))), lambda x: F.concat_ws(":", x["start"].cast("string"), x["n"].cast("string"))), ",")
    lineage = parts.groupBy("table_name", "bucket").agg(F.sha2(sources, 256).alias("lineage_sha256"))
    out = listed.join(digests, "number").join(lineage, ["table_name", "bucket"]).join(joined, "bucket", "left")
    return out.select("table_name", "path", "columns", "ids_sha256", "lineage_sha256", F.col("bucket").cast("long").alias("bucket"), "n_rows", F.coalesce("n_joined", F.lit(0)).cast("long").alias("n_joined"), "rewritten")


def op11_bucketed_pair(spark, sf_dir: str) -> DataFrame:
    """sales and sale_lines written to numbered files in a new folder, then rewritten there to one file a bucket.

    It writes at every call and leaves the files. Sales with a null sale_id share bucket 151 with such lines.
    """
    root = f"{shared_folder(spark)}/pair-{uuid4().hex}"
    sales, lines = table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines")
    own = F.coalesce(crc_bucket(F.col("sale_id"), BUCKETS, SALT), F.lit(BUCKETS + 1))
    left = Side("sales", sales, F.when(own % 5 == 1, own - 1).otherwise(own))
    right = Side("sale_lines", lines, F.coalesce(crc_bucket(F.col("item_id")), F.lit(0)))
    for side in (left, right):
        write_starts(spark, root, side, "sale_id", BUCKETS + 2)
    return rewrite_pair(spark, root, left, right, "sale_id")
