import collections
import hashlib
import math
import struct
import zlib

import duckdb
import pytest

from lumenrv.llm import interleaved as I


def plain_image(image):
    """Samples of a PNG with three 8-bit samples a pixel, read by the format's rules (all five filters)."""
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    at, packed = 8, b""
    while at < len(image):
        n, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        assert int.from_bytes(image[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            assert (depth, colour, interlace) == (8, 2, 0)
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, stride, out, above = zlib.decompress(packed), 3 * width, b"", bytes(3 * width)
    for r in range(height):
        kind, line = raw[r * (stride + 1)], bytearray(raw[r * (stride + 1) + 1 : (r + 1) * (stride + 1)])
        for i in range(stride if kind else 0):
            a, b, c = line[i - 3] if i > 2 else 0, above[i], above[i - 3] if i > 2 else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[i] = (line[i] + (0, a, b, (a + b) // 2, near)[kind]) & 255
        above = bytes(line)
        out += above
    return out


def plain_feature(payload):
    n, mean = len(payload), sum(payload) / len(payload)
    dev = math.sqrt(sum((x - mean) ** 2 for x in payload) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in collections.Counter(payload).values())
    cut, parts, at = [n // 17 + (k < n % 17) for k in range(17)], [], 0
    for size in cut:
        parts.append(sum(payload[at : at + size]) / size)
        at += size
    bits = sum((b > a) << i for i, (a, b) in enumerate(zip(parts, parts[1:])))
    return mean, dev, entropy, bits


def brute(text):
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
    image = I.to_png(payload)
    if len(payload) < 50_000:
        assert plain_image(image) == payload
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest()), payload


def compare(rows, texts):
    assert len(rows) == len(texts)
    want = {d: brute(t) for d, t in texts}
    by_text = {}
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want[r.doc_id][0]
        if r.payload_bytes < 50_000:
            got = dict(x.split("=") for x in r.feature.split(";"))
            mean, dev, entropy, bits = plain_feature(want[r.doc_id][1])
            assert [float(got[k]) for k in ("mean", "dev", "entropy")] == pytest.approx([mean, dev, entropy], abs=2e-4) and int(got["dhash"], 16) == bits
        assert by_text.setdefault(r.payload_sha256, r.feature) == r.feature
        assert r.pos == 1 and r.caption == f"{r.n_bytes} bytes"


def test_query_reads_back_every_text(spark):
    d = "/root/testdata/sf0.001"
    compare(I.op5_media_columns(spark, d).collect(), duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall())


def test_odd_texts(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "a" * 192), (4, "é" * 97), (5, "x" * 300_000), (6, "x" * 300_000), (7, " ")]
    spark.createDataFrame([(*t, "p", 1) for t in texts], "doc_id long, text string, digest string, pos int").write.parquet(f"{tmp_path}/documents.parquet")
    compare(I.op5_media_columns(spark, str(tmp_path)).collect(), texts)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert I.op5_media_columns(spark, f"{tmp_path}/none").count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body>one <b>two</b><p>three
<figure><img src="SHA256:AB"><img src="b.png" alt="old"><figcaption>cap &amp; tion</figcaption></figure>four<img src='sha256:cd' alt='x'/>
<video><source src="sha256:ef"></video><script>var x = "<img src='no'>"</script>five"""


def test_parsing_keeps_order_and_captions():
    got = [(x["pos"], x["kind"], x["text"] or x["src"], x["digest"], x["caption"]) for x in I.parse_page(PAGE)]
    assert got == [
        (0, "text", "one two", None, None), (1, "text", "three", None, None), (2, "image", "SHA256:AB", "ab", "cap & tion"), (3, "image", "b.png", None, "cap & tion"),
        (4, "text", "four", None, None), (5, "image", "sha256:cd", "cd", "x"), (6, "video", "sha256:ef", "ef", None), (7, "text", "five", None, None),
    ]
    assert I.parse_page(None) == [] and I.parse_page("<<>< <img") is not None


def test_join_by_digest_leaves_unknown_media_null(spark):
    media = spark.createDataFrame([("ab", 5), ("ef", 7)], "digest string, size long")
    pages = spark.createDataFrame([(PAGE, 1), (None, 2), (PAGE, 1), ("", 3)], "html string, size int")
    rows = I.resolve(I.interleave(pages), media).collect()
    assert sorted(r.size for r in rows) == [1, 1, 2, 3]
    for r in rows:
        assert [(x.pos, x.media and x.media.size) for x in r["items"] if x.media] == ([(2, 5), (6, 7)] if r.size == 1 else [])


def test_damaged_images_are_noticed():
    image = I.to_png(b"a" * 384)
    assert I.from_png(image) == b"a" * 384
    with pytest.raises(ValueError):
        I.from_png(image[:50] + b"x" + image[51:])
