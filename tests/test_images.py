"""Kernels, codecs, containers, the transform, sources, sinks and streams."""

from __future__ import annotations

import http.server
import struct
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import cli
from rasterloom.codecs import containers, jpeg, png
from rasterloom.errors import RowError, classify
from rasterloom.kernels import raster
from rasterloom.operators import transform
from rasterloom.sources import images, sinks

RNG = np.random.default_rng(5)


def corners(w, h, block):
    im = np.full((h, w, 3), 128, np.uint8)
    im[:block, :block], im[:block, -block:], im[-block:, :block], im[-block:, -block:] = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)
    return im


def seen(im):
    h, w, _ = im.shape
    out = ""
    for y, x in ((h // 8, w // 8), (h // 8, w - 1 - w // 8), (h - 1 - h // 8, w // 8), (h - 1 - h // 8, w - 1 - w // 8)):
        r, g, b = (int(v) for v in im[y, x, :3])
        out += "W" if min(r, g, b) > 180 else "R" if r > max(g, b) + 60 else "G" if g > max(r, b) + 60 else "B" if b > max(r, g) + 60 else "?"
    return out


def exif(o):
    return b"II*\0\x08\0\0\0" + struct.pack("<HHHIHHI", 1, 0x0112, 3, 1, o, 0, 0)


@pytest.mark.parametrize("shape", [((2040, 1356), (512, 340)), ((333, 217), (100, 65)), ((17, 11), (5, 3)), ((50, 40), (120, 96)), ((64, 64), (17, 9)), ((9, 300), (7, 150)), ((256, 199), (256, 1))])
def test_resample_against_doubles(shape):
    (sw, sh), (dw, dh) = shape
    im = RNG.integers(0, 65536, (sh, sw, 3)).astype(np.uint16)

    def exact(n, m):
        s = n / m
        f = max(s, 1.0)
        x = (np.arange(n)[None] + 0.5 - (np.arange(m)[:, None] + 0.5) * s) / f
        w = np.where((x >= -3) & (x < 3), np.sinc(x) * np.sinc(x / 3), 0)
        return w / w.sum(1, keepdims=True)

    want = np.einsum("ai,ijc,bj->abc", exact(sh, dh), im.astype(float), exact(sw, dw), optimize=True)
    assert np.abs(raster.resample(im, dw, dh, 65535) - np.clip(np.floor(want + 0.5), 0, 65535)).max() <= 2


def test_orientations():
    frame = np.arange(6).reshape(2, 3, 1)
    want = {1: "012345", 2: "210543", 3: "543210", 4: "345012", 5: "031425", 6: "304152", 7: "524130", 8: "251403"}
    assert {o: "".join(map(str, raster.orient(frame, o).ravel())) for o in want} == want
    table = {(0, None): 1, (1, None): 8, (2, None): 3, (3, None): 6, (0, 1): 2, (1, 1): 7, (2, 1): 4, (3, 1): 5, (0, 0): 4, (1, 0): 5, (2, 0): 2, (3, 0): 7}
    assert all(raster.orientation_of(*k) == v for k, v in table.items())


def test_alpha_does_not_bleed():
    im = np.zeros((40, 40, 4), np.uint8)
    im[:, :20], im[:, 20:] = (255, 0, 0, 0), (0, 0, 255, 255)
    for linear in (True, False):
        out = raster.resize(im, 10, 10, linear)
        assert (out[..., 0][out[..., 3] > 200] < 5).all() and out[5, 9].tolist() == [0, 0, 255, 255]
    assert raster.flatten(im)[0, 0].tolist() == [255, 255, 255] and raster.flatten(im)[0, 30].tolist() == [0, 0, 255]


def test_light():
    assert (raster.FROM_LINEAR[raster.TO_LINEAR] == np.arange(256)).all()
    y, u, v = raster.to_yuv420(np.full((3, 5, 3), 255, np.uint8))
    assert y.min() >= 1022 and (u == 512).all() and (v == 512).all() and u.shape == (2, 3)
    back = raster.from_yuv(*raster.to_yuv420(corners(64, 48, 16)))
    assert seen(back) == "RGBW"
    assert raster._twice(np.array([[0, 100]]), 4, 1).tolist() == [[0, 25, 75, 100]]


@pytest.mark.parametrize("channels", [3, 4])
@pytest.mark.parametrize("effort", list(png.EFFORT))
def test_png_round_trip(channels, effort):
    im = RNG.integers(0, 256, (21, 33, channels)).astype(np.uint8)
    icc = bytes((i * 131 + 7) % 251 for i in range(900))
    data = png.encode(im, icc, effort)
    assert (png.decode(data) == im).all() and png.metadata(data)["icc"] == icc


def raw_png(w, h, depth, colour, rows, extra=b"", interlaced=0):
    return png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)) + extra + png._chunk(b"IDAT", zlib.compress(rows)) + png._chunk(b"IEND", b"")


def test_png_kinds():
    gray = RNG.integers(0, 256, (4, 5)).astype(np.uint8)
    rows = b"".join(b"\0" + r.tobytes() for r in gray)
    assert (png.decode(raw_png(5, 4, 8, 0, rows)) == gray[..., None]).all()
    assert (png.decode(raw_png(5, 4, 8, 0, rows, png._chunk(b"tRNS", struct.pack(">H", int(gray[0, 0])))))[0, 0, 3]) == 0
    assert png.decode(raw_png(3, 1, 1, 0, b"\0\xa0"))[0, :, 0].tolist() == [255, 0, 255]
    assert png.decode(raw_png(2, 1, 2, 3, b"\0\x60", png._chunk(b"PLTE", bytes(range(12))) + png._chunk(b"tRNS", b"\xff\x07")))[0].tolist() == [[3, 4, 5, 7], [6, 7, 8, 255]]
    assert png.decode(raw_png(1, 1, 16, 2, b"\0" + bytes([9, 200, 8, 200, 7, 200]))).tolist() == [[[9, 8, 7]]]
    assert png.decode(raw_png(1, 1, 8, 4, b"\0\x21\x42")).tolist() == [[[33, 33, 33, 66]]]
    im = RNG.integers(0, 256, (9, 11, 3)).astype(np.uint8)
    passes = b"".join(b"\0" + r.tobytes() for x0, y0, dx, dy in png.PASSES for r in im[y0::dy, x0::dx] if im[y0::dy, x0::dx].size)
    assert (png.decode(raw_png(11, 9, 8, 2, passes, interlaced=1)) == im).all()
    for broken in (b"", png.encode(im)[:60], raw_png(11, 9, 8, 2, b"\0" * 20), raw_png(2, 1, 8, 3, b"\0\0\1")):
        with pytest.raises(RowError):
            png.decode(broken)


def test_palettes():
    im = np.repeat(np.repeat(RNG.integers(0, 256, (4, 4, 3)).astype(np.uint8), 5, 0), 5, 1)
    palette, indices = raster.quantized(im, 256, dither=False)
    assert len(palette) <= 16 and np.abs(palette[indices].astype(int) - im).max() <= 1
    palette, indices = raster.quantized(corners(30, 30, 10), 2)
    assert len(palette) == 2 and (png.decode(png.encode(indices, palette=palette)) == palette[indices]).all()


@pytest.mark.parametrize("half", [False, True])
def test_jpeg(half, spark, tmp_path):
    im = corners(67, 45, 16)
    icc = bytes((i * 131 + 7) % 251 for i in range(70_000))
    data = jpeg.encode(im, 92, icc, half)
    assert np.abs(jpeg.decode(data).astype(int) - im).mean() < (6 if half else 2)
    assert containers.jpeg_metadata(data)["icc"] == icc and transform.probe(data)["width"] == 67
    (tmp_path / "x.jpg").write_bytes(data)
    row = spark.read.format("image").load(f"file://{tmp_path}/x.jpg").select("image.*").first()
    theirs = np.frombuffer(bytes(row.data), np.uint8).reshape(row.height, row.width, 3)[..., ::-1]
    assert np.abs(theirs.astype(int) - jpeg.decode(data)).mean() < (4 if half else 1)


def test_progressive_jpeg(spark):
    """Written by the JVM's encoder, read by ours."""
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(40, 30, 1)
    for y in range(30):
        for x in range(40):
            picture.setRGB(x, y, (x * 6) << 16 | (y * 8) << 8 | 90)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    for mode in ("progressive", "sequential"):
        out = jvm.java.io.ByteArrayOutputStream()
        writer.setOutput(jvm.javax.imageio.stream.MemoryCacheImageOutputStream(out))
        params = writer.getDefaultWriteParam()
        if mode == "progressive":
            params.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
        writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), params)
        writer.reset()
        data = bytes(out.toByteArray())
        assert containers.jpeg_metadata(data)["progressive"] == (mode == "progressive")
        got = jpeg.decode(data).astype(int)
        want = np.array([[(x * 6, y * 8, 90) for x in range(40)] for y in range(30)])
        assert np.abs(got - want).mean() < 6


def test_damaged_jpeg():
    data = jpeg.encode(corners(40, 40, 10), 80)
    for bad in (b"\xff\xd8", data[:100], b"\xff\xd8\xff\xc3" + data[20:], data.replace(b"\xff\xc4", b"\xff\xfe")):
        with pytest.raises(RowError):
            transform.process(bad, 10, 10)


def test_exif():
    for o in range(1, 9):
        assert containers.tiff_orientation(exif(o)) == o
        big = b"MM\0*\0\0\0\x08" + struct.pack(">HHHIHHI", 1, 0x0112, 3, 1, o, 0, 0)
        assert containers.tiff_orientation(big) == o
    for bad in (exif(0), exif(9), exif(6)[:12], b"XX" + exif(1)[2:], exif(6).replace(struct.pack("<HHI", 0x0112, 3, 1), struct.pack("<HHI", 0x0112, 3, 2))):
        assert containers.tiff_orientation(bad) is None
    assert containers.exif_orientation(b"Exif\0\0" + exif(6), True) == 6 and containers.exif_orientation(exif(6), True) is None and containers.exif_orientation(exif(6)) == 6


def test_icc_chains():
    parts = [(2, 2, b"b"), (1, 2, b"a")]
    assert containers.icc_from_parts(parts) == b"ab"
    for bad in ([(1, 2, b"a")], [(0, 1, b"a")], [(1, 2, b"a"), (1, 2, b"b")], [(1, 2, b"a"), (2, 3, b"b")], []):
        assert containers.icc_from_parts(bad) is None


def box(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def avif(*properties):
    ipco = box(b"ipco", b"".join(properties))
    ipma = box(b"ipma", bytes(4) + struct.pack(">IHB", 1, 1, len(properties)) + bytes(range(1, len(properties) + 1)))
    meta = box(b"meta", bytes(4) + box(b"pitm", bytes(4) + struct.pack(">H", 1)) + box(b"iprp", ipco + ipma))
    return box(b"ftyp", b"avif\0\0\0\0avifmif1") + meta


def test_containers():
    ispe = box(b"ispe", bytes(4) + struct.pack(">II", 120, 90))
    found = containers.avif_header(avif(ispe, box(b"irot", b"\1"), box(b"imir", b"\1"), box(b"colr", b"profPROFILE")))
    assert found == {"width": 120, "height": 90, "orientation": 7, "icc": b"PROFILE"}
    lossless = b"VP8L" + struct.pack("<I", 5) + b"\x2f" + struct.pack("<I", 199 | 149 << 14 | 1 << 28) + b"\0"
    webp = b"RIFF" + struct.pack("<I", 4 + len(lossless)) + b"WEBP" + lossless
    assert containers.webp_header(webp) == {"width": 200, "height": 150, "alpha": True, "animated": False}
    withicc = containers.webp_with_icc(webp, b"PROFILE")
    assert containers.webp_metadata(withicc)["icc"] == b"PROFILE" and containers.webp_header(withicc)["width"] == 200
    for data in (webp, avif(ispe)):
        with pytest.raises(RowError) as e:
            transform.process(data, 10, 10)
        assert e.value.kind == "Undecodable" and "not enabled" in e.value.message


def test_process():
    im = corners(240, 180, 60)
    for o in range(1, 9):
        inverse = {6: 8, 8: 6}.get(o, o)
        data = png.encode(raster.orient(im, inverse))
        data = data[:33] + png._chunk(b"eXIf", exif(o)) + data[33:]
        out = transform.process(data, 100, 100)
        assert (out["width"], out["height"]) == (100, 75) and seen(png.decode(out["data"])) == "RGBW", o
        assert transform.process(data, 100, 100, config=transform.Config(auto_rotate=False))["width"] == (100 if o < 5 else 75)
    data = png.encode(im, b"PROFILE")
    assert png.metadata(transform.process(data, 50, 0)["data"])["icc"] == b"PROFILE"
    assert png.metadata(transform.process(data, 50, 0, config=transform.Config(icc=False))["data"])["icc"] is None
    assert transform.process(data, 0, 90)["width"] == 120 and transform.process(data, 9000, 9000)["width"] == 240
    assert seen(jpeg.decode(transform.process(data, 120, 90, "jpeg", 90)["data"])) == "RGBW"
    assert transform.process(data, 120, 90, config=transform.Config(png_quantize=True, png_quantize_colors=16))["data"][25] == 3
    for config in (transform.Config(max_src_pixels=100), transform.Config(max_source_bytes=10), transform.Config(max_decoded_bytes=1 << 20, max_src_pixels=1 << 40)):
        big = png.encode(np.zeros((900, 900, 3), np.uint8))
        with pytest.raises(RowError) as e:
            transform.process(big, 10, 10, config=config)
        assert e.value.kind == "SourceTooLarge"


def test_config():
    assert transform.Config().validate()
    for bad in ({"quality": 0}, {"resize": "cubic"}, {"png_quantize_colors": 1}, {"max_decoded_bytes": 5}, {"dct_margin": 9.0}, {"png_effort": "slow"}):
        with pytest.raises(ValueError):
            transform.Config(**bad).validate()
        assert transform.Config.lenient(**bad) == transform.Config()
    assert transform.parse_colour("#ff0080") == (255, 0, 128) and transform.parse_colour("xyz") is None


def test_transform_rows(spark):
    good, rows = png.encode(corners(64, 48, 16)), []
    for i in range(20):
        rows.append((i, bytearray(good) if i % 4 else bytearray(b"not an image at all"), 32, 32, "clash"))
    rows.append((99, None, 1, 1, "clash"))
    df = spark.createDataFrame(rows, "id long, content binary, max_width long, max_height long, format string")
    one, many = (sorted(transform.transform(df.repartition(n)).collect(), key=lambda r: r.id) for n in (1, 8))
    assert one == many and len(one) == 21
    kinds = [r.result.error.kind if r.result.error else None for r in one]
    assert kinds.count("Undecodable") == 5 and kinds[-1] == "SourceNotFound" and kinds.count(None) == 15
    assert {(r.result.width, r.result.height) for r in one if r.result.data} == {(32, 24)} and one[0].format == "clash"
    probed = transform.probed(df).where("probe.error is null").select("probe.*").distinct().collect()
    assert [(r.format, r.width, r.height) for r in probed] == [("png", 64, 48)]


def test_errors():
    assert classify(FileNotFoundError()).kind == "SourceNotFound"
    assert classify(PermissionError()).kind == classify(IsADirectoryError()).kind == "SourceUnreadable"
    assert classify(ConnectionResetError(), True).kind == "Upstream" and classify(EOFError()).kind == "Undecodable"
    assert classify(TimeoutError(), True).kind == "UpstreamTimeout" and classify(TimeoutError()).kind == "Undecodable"
    try:
        try:
            raise TimeoutError
        except TimeoutError as e:
            raise ValueError("x") from e
    except ValueError as e:
        assert classify(e, True).kind == "UpstreamTimeout"


@pytest.fixture(scope="module")
def origin():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            code = {"/gone.jpg": 404, "/bad.jpg": 400, "/moved.jpg": 302, "/down.jpg": 500}.get(self.path, 200)
            self.send_response(code)
            body = b"y" * 5000 if self.path == "/big.jpg" else png.encode(corners(40, 30, 10))
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http(spark, origin):
    spark.dataSource.register(images.HttpImages)
    keys = ["a b.png", "gone.jpg", "bad.jpg", "moved.jpg", "down.jpg", "big.jpg", "k" * 1025]
    df = spark.read.format("http_images").option("base", origin).option("keys", "\n".join(keys)).option("max_bytes", 4000).load()
    want = {"a b.png": None, "gone.jpg": "SourceNotFound", "bad.jpg": "SourceRejected", "moved.jpg": "Upstream", "down.jpg": "Upstream", "big.jpg": "SourceTooLarge", "k" * 1025: "SourceNotFound"}
    assert {r.key: r.kind for r in df.collect()} == want
    again = images.fetched(spark.createDataFrame([(k,) for k in keys], "key string"), origin, max_bytes=4000)
    assert {r.key: r.kind for r in again.collect()} == want
    dead = images.fetched(spark.createDataFrame([("x",)], "key string"), "http://127.0.0.1:9")
    assert dead.first().kind == "Upstream"


def test_schemes():
    assert images.scheme(None) == ("local", None) and images.scheme("https://x/")[0] == "http" and images.scheme("gs://b-1/p")[0] == "gcs"
    for bad in ("s3://b", "gs://B", "ftp://x"):
        with pytest.raises(ValueError):
            images.scheme(bad)


def test_files(spark, tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/d/a.png").write_bytes(png.encode(corners(40, 30, 10)))
    (tmp_path / "in/b.bin").write_bytes(b"z" * 9000)
    (tmp_path / "out").symlink_to("/etc")
    found = images.files(spark, f"file://{tmp_path}/in", 8000)
    assert sorted((r.path[-5:], r.error) for r in found.collect()) == [("a.png", None), ("b.bin", "SourceTooLarge")]
    assert images.contained(str(tmp_path), "in/b.bin") and images.contained(str(tmp_path), "out/passwd") is None and images.contained(str(tmp_path), "../x") is None
    done = transform.transform(found.where("error is null").withColumn("max_width", F.lit(20)))
    spark.dataSource.register(sinks.FileSink)
    (tmp_path / "made").mkdir()
    done.select(F.lit("x/t.png").alias("name"), "result.data").write.format("image_files").option("path", f"{tmp_path}/made").mode("append").save()
    assert png.decode((tmp_path / "made/x/t.png").read_bytes()).shape == (15, 20, 3)


def test_cli(tmp_path, capsys):
    source, target = tmp_path / "a.png", tmp_path / "b.jpg"
    source.write_bytes(png.encode(corners(40, 30, 10)))
    assert cli.main(["resize", str(source), str(target), "20", "0", "-q", "90"]) == 0 and target.read_bytes()[:2] == b"\xff\xd8"
    assert cli.main(["resize", str(source), str(target), "20", "0", "-f", "png"]) == 0 and target.read_bytes()[:4] == b"\x89PNG"
    assert cli.main(["probe", str(source)]) == 0 and "png 40x30" in capsys.readouterr().out
    assert cli.main(["probe", str(tmp_path / "none")]) == 1 and cli.main(["resize", str(source)]) == 2 and cli.main(["resize", str(source), str(target), "0", "0"]) == 2 and cli.main(["resize", str(source), str(target), "1", "1", "-q", "0"]) == 2


def test_streams(spark, tmp_path):
    from rasterloom.plans.image_queries import request_log
    from rasterloom.streaming import requests

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/log")
    stream = lambda: request_log(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log"))
    want = {(r["class"], r.format, r["count"]) for r in request_log(events).groupBy("class", "format").count().collect()}
    got = requests.drained(requests.totals(stream()), "totals", f"file://{tmp_path}/c1")
    assert {tuple(r) for r in got.collect()} == want
    got = requests.drained(requests.windowed_totals(stream(), "1 day", late="60 days"), "windows", f"file://{tmp_path}/c2")
    assert sum(r.requests for r in got.collect()) == events.count()
    keyed = stream().select("ts", (F.col("user_id") % 5).alias("width"), F.lit(1).alias("height"), F.lit("f").alias("file"), "format", F.lit(None).cast("int").alias("quality"))
    got = requests.drained(requests.leaders(keyed, "60 days"), "leaders", f"file://{tmp_path}/c3", "append")
    assert got.count() == request_log(events).select(F.col("user_id") % 5, "format").distinct().count()


def test_sql_functions(spark):
    from rasterloom.functions import sql
    from rasterloom.operators.transform import Config

    sql.register(spark, Config(log_decoded_bytes_above=1))
    image = np.arange(5 * 4 * 3, dtype=np.uint8).reshape(5, 4, 3)
    rows = [(1, bytearray(png.encode(image))), (2, bytearray(b"not an image at all")), (3, None)]
    spark.createDataFrame(rows, "id int, content binary").createOrReplaceTempView("sql_sources")
    got = {r.id: r for r in spark.sql("SELECT id, transform_image(content, 2, 0, 'png', CAST(NULL AS DOUBLE)) AS t, image_probe(content) AS p FROM sql_sources").collect()}
    assert (got[1].t.width, got[1].t.height, got[1].t.error) == (2, 3, None) and got[1].t.note.startswith("staged=60") and (got[1].p.width, got[1].p.height) == (4, 5)
    assert got[2].t.error.kind == "Undecodable" and got[3].t.error.kind == "SourceNotFound" and got[2].p.error
    pixels = spark.sql("SELECT id, p.* FROM sql_sources, LATERAL explode_pixels(content) p").collect()
    assert {(r.id, r.x, r.y): (r.r, r.g, r.b, r.a) for r in pixels} == {(1, x, y): (*map(int, image[y, x]), 255) for x in range(4) for y in range(5)}
    spark.createDataFrame([(1, 2, 2, bytearray(b"b")), (1, 1, 2, bytearray(b"a")), (2, 1, 2, bytearray(b"x"))], "id int, seq int, count int, data binary").createOrReplaceTempView("sql_parts")
    assert {r.id: r.icc and bytes(r.icc) for r in spark.sql("SELECT id, icc_assemble(seq, count, data) AS icc FROM sql_parts GROUP BY id").collect()} == {1: b"ab", 2: None}


def test_a_format_without_an_encoder_is_refused_before_pixels(monkeypatch):
    from rasterloom.errors import RowError
    from rasterloom.operators import transform

    content = png.encode(np.zeros((4, 4, 3), np.uint8))
    monkeypatch.setattr(transform, "decode", lambda *_: pytest.fail("decoded"))
    for fmt in ("webp", "avif"):
        with pytest.raises(RowError) as e:
            transform.process(content, output=fmt)
        assert e.value.kind == "Undecodable"


def test_faults_of_the_engine_are_internal(monkeypatch):
    from rasterloom.operators import transform

    def broken(*_, **__):
        raise IndexError("a bug")

    monkeypatch.setattr(transform, "encode", broken)
    row = transform._one({"content": png.encode(np.zeros((4, 4, 3), np.uint8))}, transform.Config())
    assert row["error"]["kind"] == "Internal" and row["error"]["message"] == "internal image-processing error"


def test_long_directories_are_read_as_far_as_the_limit():
    def tiff(count, at):
        entries = [struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) if i == at else struct.pack("<HHII", 0x0100, 4, 1, 9) for i in range(count)]
        return b"II*\0" + struct.pack("<IH", 8, count) + b"".join(entries)

    assert containers.tiff_orientation(tiff(600, 3)) == 6 and containers.tiff_orientation(tiff(600, 511)) == 6 and containers.tiff_orientation(tiff(600, 512)) is None


def test_clashing_columns_of_requests(spark):
    from rasterloom.operators import coalesce

    requests = spark.createDataFrame([(1, "k", "mine", "x")], "id int, key string, _there string, own_there string")
    got = coalesce.with_sources(requests, spark.createDataFrame([("k", "u")], "key string, url string"), "key").collect()[0]
    assert (got["_there"], got["own_there"], got.url, got.error) == ("mine", "x", "u", None)
