"""A pair of tables in files by bucket: names, rows, order and lineage of every file against a brute-force version."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import cobucket

SF = "/root/testdata/sf0.001"


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def ordered(rows, key):
    def place(row):
        k, rest = row[key], [v for i, v in enumerate(row) if i != key]
        return (k is not None, -(k or 0)), [(v is not None, (v.encode() if isinstance(v, str) else v) if v is not None else 0) for v in rest]

    return sorted(rows, key=place)


def brute(sales, lines, sales_key=0, lines_key=0, item=2):
    crc = lambda t: zlib.crc32(t.encode()) % 150
    of = lambda k: 151 if k is None else crc(f"pair{k}")
    known = {r[sales_key] for r in sales} - {None}
    tables = {"sales": [(r, of(r[sales_key])) for r in sales], "sale_lines": [(r, of(r[lines_key]) if r[lines_key] is None or r[lines_key] in known else 150) for r in lines]}
    first = {"sales": lambda r: (b := of(r[sales_key])) - (b % 5 == 1), "sale_lines": lambda r: 0 if r[item] is None else crc(str(r[item]))}
    keys = {"sales": sales_key, "sale_lines": lines_key}
    n = {t: Counter(r[keys[t]] for r, _ in rows) for t, rows in tables.items()}
    joined = Counter()
    for k in known:
        joined[of(k)] += n["sales"][k] * n["sale_lines"][k]
    out = {}
    for t, rows in tables.items():
        files, parts, ends = defaultdict(list), defaultdict(Counter), defaultdict(set)
        for r, b in rows:
            files[b].append(r)
            parts[b][first[t](r)] += 1
            ends[first[t](r)].add(b)
        for b, held in files.items():
            (s, *more) = sorted(parts[b])
            stays = not more and len(ends[s]) == 1
            name = f"start-{s:05d}.parquet" if stays else f"bucket-{b:05d}.parquet"
            held = ordered(held, keys[t])
            out[t, b] = (name, held, sha("" if r[keys[t]] is None else str(r[keys[t]]) for r in held), sha(f"{s}:{n}" for s, n in sorted(parts[b].items())), len(held), joined[b], not stays)
    return out


def compare(spark, rows, sales, lines, columns):
    want = brute(sales, lines)
    assert {(r["table_name"], r["bucket"]) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        name, held, ids, lineage, n, joined, rewritten = want[r["table_name"], r["bucket"]]
        path = r["path"].removeprefix("file://").removeprefix("file:")
        assert os.path.basename(path) == name and r["columns"] == columns[r["table_name"]]
        assert (r["ids_sha256"], r["lineage_sha256"], r["n_rows"], r["n_joined"], r["rewritten"]) == (ids, lineage, n, joined, rewritten)
        stored = pq.ParquetFile(path).read()
        assert ",".join(stored.column_names) == r["columns"]
        assert list(zip(*stored.to_pydict().values(), strict=True)) == held
    for folder in {os.path.dirname(r["path"].removeprefix("file://")) for r in rows}:
        assert sorted(os.listdir(folder)) == sorted(os.path.basename(r["path"]) for r in rows if os.path.dirname(r["path"].removeprefix("file://")) == folder)
        assert set(os.listdir(os.path.dirname(folder))) <= {"sales", "sale_lines"}


def test_the_query_by_brute_force(spark):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("sales", "sale_lines")}
    sales, lines = ([tuple(r) for r in df.collect()] for df in tables.values())
    rows = cobucket.op11_bucketed_pair(spark, SF).collect()
    compare(spark, rows, sales, lines, {t: ",".join(df.columns) for t, df in tables.items()})
    assert {r["rewritten"] for r in rows if r["table_name"] == "sales"} == {True, False}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = datetime(2024, 1, 2, 3, 4, 5)
    sales = [(7, 1, "done", 1.5, at, None, 1), (7, None, "é", 1.5, at, at, None), (7, None, "é", 1.5, at, at, None), (None, 2, "z", None, None, None, 3), (None, 2, "Z", 9.0, None, None, 3), (8, 1, None, -1.0, at, at, 0), (10**14, 5, "", 0.25, at, at, 2)]
    lines = [(7, 1, i % 3, None, 2, 1.0, 0.1, "x" * (i % 4), at) for i in range(40)] + [(8, 1, 4, 1, 1, 1.0, None, None, None), (9, 1, 5, 1, 1, 1.0, 0.0, "é", at), (None, 1, None, 1, 1, 1.0, 0.0, "n", at), (None, None, 6, None, None, None, None, None, None)]
    folder = str(tmp_path_factory.mktemp("odd"))
    for name, rows in (("sales", sales), ("sale_lines", lines)):
        schema = spark.read.parquet(f"{SF}/{name}.parquet").schema
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder, sales, lines


def test_nulls_repeats_and_a_hot_key(spark, odd):
    folder, sales, lines = odd
    columns = {t: ",".join(spark.read.parquet(f"{folder}/{t}.parquet").columns) for t in ("sales", "sale_lines")}
    compare(spark, cobucket.op11_bucketed_pair(spark, folder).collect(), sales, lines, columns)


@pytest.mark.parametrize("empty", ["sales", "sale_lines", "both"])
def test_empty_tables(spark, odd, tmp_path, empty):
    folder, sales, lines = odd
    for t in ("sales", "sale_lines"):
        df = spark.read.parquet(f"{folder}/{t}.parquet")
        (df.where("false") if empty in (t, "both") else df).write.parquet(f"{tmp_path}/{t}.parquet")
    rows = cobucket.op11_bucketed_pair(spark, str(tmp_path)).collect()
    columns = {t: ",".join(spark.read.parquet(f"{folder}/{t}.parquet").columns) for t in ("sales", "sale_lines")}
    compare(spark, rows, [] if empty in ("sales", "both") else sales, [] if empty in ("sale_lines", "both") else lines, columns)


def test_a_file_with_exactly_a_buckets_rows_stays_whatever_its_number(spark, tmp_path):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, v string")
    a, b = cobucket.Side("l", left, F.lit(40)), cobucket.Side("r", right, F.when(F.col("k") == 1, 17).otherwise(3))
    for side in (a, b):
        cobucket.write_starts(spark, str(tmp_path), side, "k", 50)
    rows = {(r["table_name"], r["bucket"]): r for r in cobucket.rewrite_pair(spark, str(tmp_path), a, b, "k", 20, "").collect()}
    kept = {os.path.basename(r["path"]): r["n_rows"] for r in rows.values() if not r["rewritten"]}
    assert kept == {"start-00003.parquet": 1, "start-00017.parquet": 2} and len(rows) == 5


def test_columns_with_the_writers_names(spark, tmp_path):
    left = spark.createDataFrame([(5, 1, 2, 3), (None, 1, 2, 3)], "k long, bucket int, `table` int, start int")
    right = spark.createDataFrame([(5, 9, 8, 7, 6), (6, 9, 8, 7, 6)], "unknown int, key int, k long, n int, number int").select("unknown", "key", F.col("unknown").cast("long").alias("k"), "n", "number")
    a, b = cobucket.Side("l", left, F.lit(0)), cobucket.Side("r", right, F.lit(0))
    for side in (a, b):
        cobucket.write_starts(spark, str(tmp_path), side, "k", 4)
    rows = {(r["table_name"], r["bucket"]): r for r in cobucket.rewrite_pair(spark, str(tmp_path), a, b, "k", 4, "").collect()}
    own = zlib.crc32(b"5") % 4
    assert {k: (r["n_rows"], r["n_joined"], r["columns"]) for k, r in rows.items()} == {
        ("l", own): (1, 1, "k,bucket,table,start"), ("l", 5): (1, 0, "k,bucket,table,start"), ("r", own): (1, 1, "unknown,key,k,n,number"), ("r", 4): (1, 0, "unknown,key,k,n,number"),
    }


def test_moves_can_run_again(spark, tmp_path):
    (tmp_path / "from").mkdir()
    (tmp_path / "from" / "part-1.parquet").write_bytes(b"x")
    job = [(str(tmp_path / "from"), str(tmp_path / "to.parquet"))]
    for _ in range(2):
        cobucket.settle(spark, job)
        assert (tmp_path / "to.parquet").read_bytes() == b"x"
    with pytest.raises(Exception, match="0 files"):
        cobucket.settle(spark, [(str(tmp_path / "from"), str(tmp_path / "other.parquet"))])
    for _ in range(2):
        cobucket.settle(spark, [(str(tmp_path / "to.parquet"), None)])
        assert not (tmp_path / "to.parquet").exists()


def test_the_writer_takes_the_order_as_it_is(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 50 AS k", "cast(id AS string) AS v")
    before = spark.sparkContext._jvm.System.currentTimeMillis()
    cobucket.write_clustered(df, ["k", "v"], "k", F.col("k").cast("int") % 3, 3, "t", str(tmp_path))
    found = sorted(os.path.join(d, f) for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet"))
    assert len(found) == 3 and before
    for f in found:
        rows = list(zip(*pq.ParquetFile(f).read().to_pydict().values(), strict=True))
        assert rows == sorted(rows, key=lambda r: (-r[0], r[1]))
