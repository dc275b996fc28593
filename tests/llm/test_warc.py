import base64
import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gramlode.llm import warc
from gramlode.session import fresh_folder


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least):
    out = []
    for i, _, h in rows:
        n = len((h or "").encode())
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        keeper = max(same) if n >= least and same and sum((g or "") == (h or "") for *_, g in rows) > 1 else i
        kind = "response" if i == keeper else "revisit"
        out.append((i, n, digest(h), kind, None if kind == "response" else keeper))
    return sorted(out, key=str)


def pages():
    rng = random.Random(3)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9999:X>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    parts = [fake, "WARC/1.1\r\n", "\r\n\r\n", "Content-Length: 10\r\n", "é", "<html>", "text ", "\n", "W", "WARC/1.1"]
    rows = [(k, f"http://x/{k}", "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))) for k in range(150)]
    rows += [(200, None, None), (201, "u", ""), (202, "a\r\nContent-Length: 1\r\n\r\nb", "same"), (203, "u", "same"), (-4, "u", "same"), (203, "u", "same"),
             (None, "u", "same"), (None, "u", "alone"), (300, "u", "long " * 100000), (301, "u", fake * 3000)]
    return rows


@pytest.mark.parametrize("split,least", [(None, 0), (3000, 0), (100000, 5)])
def test_round_trip(spark, split, least):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        if split:
            spark.conf.set(key, str(split))
        got = sorted(map(tuple, warc.round_trip(df, least).collect()), key=str)
    finally:
        spark.conf.set(key, old)
    assert got == brute(rows, least)


def test_archives_are_warc_files(spark):
    rows = [(1, "http://x/", "<p>é</p>"), (2, "http://y/", "<p>é</p>")]
    folder = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), fresh_folder(spark, "t"))
    (file,) = glob.glob(folder.removeprefix("file://") + "/part-*")
    data = open(file, "rb").read()
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    at = n = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        length = int(data[at:end].split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert data[end + length : end + length + 4] == b"\r\n\r\n"
        at, n = end + length + 4, n + 1
    assert n == 2 and data.count(b"<p>") == 1


def test_broken_archives_fail(spark):
    folder = warc.write(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string").coalesce(1), fresh_folder(spark, "t"))
    (file,) = glob.glob(folder.removeprefix("file://") + "/part-*")
    data = open(file, "rb").read()
    bad = spark.createDataFrame([(data[: -len("abc\r\n\r\n")].decode() + "abXX",)], "value string").coalesce(1)
    other = fresh_folder(spark, "t")
    bad.write.option("lineSep", "\n").text(other)
    with pytest.raises(ValueError):
        warc.read(spark, other)


def test_empty_table_and_digest(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", None)], "page_id long, url string, html string")
    assert warc.round_trip(df.where("false")).collect() == []
    texts = ["", "a", "é" * 100] + [str(k) for k in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32_sha1(F.col("t").cast("binary")).alias("d")).collect()
    assert all(r.d == digest(r.t) for r in got)
