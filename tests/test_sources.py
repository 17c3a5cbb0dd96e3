import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrv.sources import fits, rdb
from lumenrv.streaming import epochs


def header(*rows):
    text = "".join(r.ljust(80) for r in (*rows, "END"))
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def padded(raw):
    return raw + b"\0" * (-len(raw) % 2880)


@pytest.fixture
def file(tmp_path):
    primary = header("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", "OBJECT  = 'O''Neil  '          / star", "HIERARCH ESO DRS BERV = -12.5 / km/s")
    pixels = np.arange(6, dtype=">i2").reshape(2, 3)
    image = header("XTENSION= 'IMAGE'", "BITPIX  = 16", "NAXIS   = 2", "NAXIS1  = 3", "NAXIS2  = 2", "BSCALE  = 0.5", "BZERO   = 1", "BLANK   = 4", "EXTNAME = 'FLUX'") + padded(pixels.tobytes())
    rows = b"".join(struct.pack(">d5si2f", 1.5 * k, f"ab{k}".encode(), k, k, -k) for k in range(3))
    table = header("XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", "NAXIS1  = 25", "NAXIS2  = 3", "PCOUNT  = 0", "TFIELDS = 4", "TTYPE1  = 'wave'", "TFORM1  = 'D'", "TTYPE2  = 'name'", "TFORM2  = '5A'", "TTYPE3  = 'n'", "TFORM3  = 'J'", "TTYPE4  = 'pair'", "TFORM4  = '2E'") + padded(rows)
    (tmp_path / "a.fits").write_bytes(primary + image + table)
    return str(tmp_path)


def test_fits_parts(spark, file):
    heads = fits.read_headers(spark, file).orderBy("unit").collect()
    assert [h.name for h in heads] == [None, "FLUX", None]
    assert heads[0].header["OBJECT"] == "O'Neil" and float(heads[0].header["ESO DRS BERV"]) == -12.5 and len(heads[0].checksum) == 16
    image = fits.read_images(spark, file, unit="FLUX").orderBy("row").collect()
    assert [r.pixels for r in image] == [[1.0, 1.5, 2.0], [2.5, None, 3.5]]
    rows = fits.read_tables(spark, file, "wave double, name string, n int, pair array<float>").orderBy("wave").collect()
    assert [(r.wave, r.name, r.n, r["pair"]) for r in rows] == [(1.5 * k, f"ab{k}", k, [k, -k]) for k in range(3)]


def test_rdb_there_and_back(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "x\ty", 3), (None, "z", 4), (float("nan"), None, 5)], "vrad double, name string, n long")
    rdb.write_rdb(df, f"{tmp_path}/t.rdb")
    back = rdb.read_rdb(spark, f"{tmp_path}/t.rdb").orderBy("n").collect()
    assert [tuple(r) for r in back] == [(1.5, "x y", 3.0), (None, "z", 4.0), (None, None, 5.0)]


def test_stream_gives_the_table_s_nights(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", float(i), 1.0 + i % 2) for i in range(30)] + [("2024-01-09 00:00:00", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "ts string, v double, e double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = epochs.nightly_means(stream, "ts", "v", "e").writeStream.format("memory").queryName("nights").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("nights").collect()}
    assert got == {tuple(r) for r in epochs.nightly_means(df, "ts", "v", "e").collect()}


def test_incremental_work_skips_what_is_done(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        epochs.process_new(stream, lambda x: x, f"{tmp_path}/done", ["id"], f"{tmp_path}/cp{_}").awaitTermination(120)
        spark.range(3, 8).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/done").collect()) == list(range(8))
