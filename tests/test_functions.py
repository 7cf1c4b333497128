"""Column functions against fixed vectors, and against plain Python on generated ones."""

from __future__ import annotations

import base64
import hashlib
import hmac
import random
from urllib.parse import quote

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import colour, cost, geometry, grammar

KEY, SALT = bytes(range(1, 33)), bytes(range(200, 216))


def test_the_whole_table_from_linear(spark):
    got = [r.s for r in spark.range(65536).orderBy("id").select(colour.from_linear(F.col("id")).alias("s")).collect()]
    said = [v / 65535 for v in range(65536)]
    assert got == [int((12.92 * x if x <= 0.0031308 else 1.055 * x ** (1 / 2.4) - 0.055) * 255 + 0.5) for x in said]


def run(spark, rows, ddl, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {ddl}")
    shown = df.select("_i", *columns)
    assert not any(x in shown._jdf.queryExecution().toString() for x in ("ArrowEvalPython", "BatchEvalPython"))
    return [tuple(r)[1:] for r in sorted(shown.collect())] if len(columns) > 1 else [r[1] for r in sorted(shown.collect(), key=lambda r: r[0])]


def test_fits(spark):
    rows = [(7360, 4912, 500, 500), (4912, 7360, 500, 500), (300, 200, 500, 500), (2000, 19708, 1920, 16383), (2000, 16383, 16383, 16383), (1, 10000, 5, 5)]
    got = run(spark, rows, "w long, h long, bw long, bh long", *geometry.fit(*map(F.col, ("w", "h", "bw", "bh"))))
    assert got == [(500, 334), (334, 500), (300, 200), (1663, 16383), (2000, 16383), (1, 5)]


def test_larger_fit(spark):
    rows = [(4000, 1000, 1920, geometry.UNBOUNDED), (1000, 4000, 1920, geometry.UNBOUNDED), (4000, 1000, 500, 500)]
    assert run(spark, rows, "w long, h long, bw long, bh long", *geometry.larger_fit(*map(F.col, ("w", "h", "bw", "bh")))) == [(4000, 1000), (1000, 4000), (500, 125)]


def test_decode_numerator(spark):
    rows = [(7360, 4912, 500, 334, 1.0), (1000, 667, 500, 334, 1.0), (500, 334, 500, 334, 1.0), (7360, 4912, 500, 334, None)]
    assert run(spark, rows, "w long, h long, dw long, dh long, m double", geometry.dct_numerator(*map(F.col, ("w", "h", "dw", "dh", "m")))) == [1, 4, 8, 8]


def test_ceiling_and_bounds(spark):
    got = run(spark, [(1920, "webp"), (0, "webp"), (0, "png")], "d long, f string", geometry.ceiling(geometry.bounded(F.col("d")), F.col("f")))
    assert got == [1920, 16383, geometry.UNBOUNDED]
    assert run(spark, [(0, 0), (0, 5), (8192, 8192), (8193, 1)], "w long, h long", geometry.valid_dims(F.col("w"), F.col("h"))) == [False, True, True, False]


def test_cost_saturates(spark):
    big = 1 << 40
    assert run(spark, [(big, big)], "a long, b long", cost.saturating(F.col("a"), F.lit(1 << 30), F.lit(1 << 30)))[0] == cost.LARGEST
    mib = 1 << 20
    rows = [(2250, 26115, 3, 1411, 16383)]
    terms = cost.terms(*map(F.col, ("w", "h", "ch", "ow", "oh")), linear=F.lit(True), progressive=F.lit(False), components=F.lit(3), srcbuf=F.lit(0), held=F.lit(12 * mib), fmt=F.lit("jpeg"))
    assert run(spark, rows, "w long, h long, ch int, ow long, oh long", cost.total(terms))[0] >= 592 * mib


def plain_options(said):
    """An option list by the rules: the first fault in order, or (width, height, quality, format, None)."""
    seen, formats = {}, {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "avif": "avif", "auto": None}
    for item in said.split(","):
        key, mark, value = item.partition("=")
        if not mark:
            return (None,) * 4 + (f"malformed option: {item}",)
        if key not in ("width", "height", "quality", "format"):
            return (None,) * 4 + (f"unknown option: {key}",)
        if key in seen:
            return (None,) * 4 + (f"duplicate option: {key}",)
        most = 100 if key == "quality" else 8192
        if value not in formats if key == "format" else not (value.isdigit() and 1 <= int(value) <= most):
            return (None,) * 4 + (f"invalid option: {key}",)
        seen[key] = formats[value] if key == "format" else int(value)
    if not seen.keys() & {"width", "height"}:
        return (None,) * 4 + ("no dimension",)
    return seen.get("width", 0), seen.get("height", 0), seen.get("quality"), seen.get("format"), None


def test_options(spark):
    rnd = random.Random(12)
    value = {"width": lambda: rnd.choice([1, 8192, 8193, 0, "7x", rnd.randint(2, 900)]), "height": lambda: rnd.choice([rnd.randint(1, 8192), 8193]), "quality": lambda: rnd.choice([0, 1, 100, 101]), "format": lambda: rnd.choice(["jpg", "avif", "auto", "bmp", "jxl"]), "dpr": lambda: 2}
    lists = [",".join(rnd.choice([f"{k}={value[k]()}"] * 9 + [k]) for k in rnd.choices(list(value), [6, 5, 3, 3, 1], k=rnd.randint(1, 4))) for _ in range(400)] + ["", ",", "width=", "=4"]
    got = run(spark, [(s,) for s in lists], "s string", grammar.options(F.col("s")))
    assert [tuple(g) for g in got] == [plain_options(s) for s in lists]
    assert {(g.error or "none").split(":")[0] for g in got} == {"none", "malformed option", "unknown option", "duplicate option", "invalid option", "no dimension"}


def test_paths(spark):
    rnd = random.Random(13)
    parts = ["", ".", "..", "a", "b.c", "..d", "e..", "...", "f@9", "ü ", "%41"]
    paths = ["/".join(rnd.choices(parts, [1, 1, 1, 6, 6, 3, 3, 3, 3, 3, 3], k=rnd.randint(1, 3))) + rnd.choice(["", "", "", *"?#\\\x01\x7f"]) for _ in range(300)]
    want = [not {"", ".", ".."} & set(p.split("/")) and not set(p) & set("?#\\\x01\x7f") for p in paths]
    assert run(spark, [(p,) for p in paths], "p string", grammar.valid_path(F.col("p"))) == want and 50 < sum(want) < 250


def test_tokens(spark):
    at = grammar.at_format(F.col("p"))
    said = {}
    for base in ("one.tif", "in/two.gif", "v@3/three"):
        for token, fmt in (("jpg", "jpeg"), ("jpeg", "jpeg"), ("png", "png"), ("webp", "webp"), ("avif", "avif")):
            said[f"{base}@{token}"] = (base, fmt, False)
        said[f"{base}@jxl"] = (base, None, True)
        said |= {p: (p, None, False) for p in (base, f"{base}@9x", f"{base}@tga", f"at@png/{base}")}
    said |= {p: (p, None, False) for p in ("@png", "in/@jpg")}
    assert run(spark, [(p,) for p in said], "p string", at["base"], at["format"], at["unavailable"]) == list(said.values())


def test_encoding(spark):
    rows = {"one two.gif": "one%20two.gif", "50%25/x": "50%2525/x", "naïve": "na%C3%AFve", "v@3/:;,=&": "v@3/:;,=&"}
    assert run(spark, [(p,) for p in rows], "p string", grammar.encoded_path(F.col("p"))) == list(rows.values())


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=20), min_size=20, max_size=40))
def test_encoding_any(spark, said):
    kept = "~!$&'()*+,;=:@/-._"
    assert run(spark, [(p,) for p in said], "p string", grammar.encoded_path(F.col("p"))) == [quote(p, safe=kept) for p in said]


def test_signatures(spark):
    said = ["/resize/7/9/a", "/image/height=3/b c", "/ü"]
    want = [base64.urlsafe_b64encode(hmac.new(KEY, SALT + p.encode(), hashlib.sha256).digest()).decode().rstrip("=") for p in said]
    assert run(spark, [(p,) for p in said], "p string", grammar.signature(F.col("p"), KEY, SALT)) == want
    long = b"k" * 65
    want = base64.urlsafe_b64encode(hmac.new(long, SALT + b"/a", hashlib.sha256).digest()).decode().rstrip("=")
    assert run(spark, [("/a",)], "p string", grammar.signature(F.col("p"), long, SALT)) == [want]
    assert run(spark, [("s", "s"), ("s", "t"), ("s", None)], "e string, g string", grammar.authorised(F.col("e"), F.col("g"), True)) == [200, 403, 403]
    assert run(spark, [("s", "s"), ("s", None)], "e string, g string", grammar.authorised(F.col("e"), F.col("g"), False)) == [404, 200]


def test_base64url(spark):
    got = run(spark, [("aGVsbG8",), ("aGVsbG8=",), ("-_8",), ("bad!",)], "s string", grammar.base64url(F.col("s")))
    assert [None if g is None else bytes(g) for g in got] == [b"hello", b"hello", b"\xfb\xff", None]


def test_negotiation(spark):
    rows = ["text/html, image/webp;q=0.2, image/avif;q=0.1", "image/webp", "image/svg+xml", None]
    assert run(spark, [(a,) for a in rows], "a string", grammar.negotiated(F.col("a"), ["avif", "webp"])) == ["avif", "webp", None, None]
    assert run(spark, [(a,) for a in rows], "a string", grammar.negotiated(F.col("a"), [])) == [None] * 4


def test_routes(spark):
    at = grammar.positional(F.col("u"))
    assert run(spark, [("/resize/1/2/a/b.jpg",), ("/sig/resize/1/2/x",), ("/resize/a/2/x",), ("/health",)], "u string", *at.values()) == [(None, 1, 2, "a/b.jpg"), ("sig", 1, 2, "x"), (None,) * 4, (None,) * 4]
    at = grammar.options_route(F.col("u"), "/image")
    assert run(spark, [("/image/width=1/a b.jpg",), ("/s/image/width=1,height=2/x/y.jpg",), ("/resize/1/2/x",)], "u string", *at.values()) == [(None, "width=1", "a b.jpg"), ("s", "width=1,height=2", "x/y.jpg"), (None,) * 3]


def test_built_urls_parse_back(spark):
    url = grammar.build_url(F.col("w"), F.col("h"), F.lit("a b/c.jpg"), F.col("q"), F.lit("webp"))
    got = run(spark, [(100, 0, 80), (0, 7, None)], "w long, h long, q long", url)
    assert got == ["/image/width=100,quality=80,format=webp/a%20b/c.jpg", "/image/height=7,format=webp/a%20b/c.jpg"]


def test_sniff(spark):
    heads = [b"\xff\xd8\xff" + b"x" * 20, b"\x89PNG\r\n\x1a\n" + b"x" * 9, b"RIFF1234WEBPxx", b"1234ftypavif", b"1234ftypavis", b"GIF89a123456", b"\xff\xd8"]
    assert run(spark, [(bytearray(h),) for h in heads], "c binary", grammar.sniffed(F.col("c"))) == ["jpeg", "png", "webp", "avif", "avif", None, None]


def test_light_round_trip(spark):
    got = spark.range(256).select("id", colour.from_linear(colour.to_linear(F.col("id"))).alias("back")).collect()
    assert all(r.id == r.back for r in got)


def test_colour(spark):
    assert run(spark, [(1023, 512, 512), (0, 512, 512), (512, 512, 512)], "y int, u int, v int", *colour.yuv_to_rgb(F.col("y"), F.col("u"), F.col("v"))) == [(255, 255, 255), (0, 0, 0), (128, 128, 128)]
    assert run(spark, [(255, 255, 255), (0, 0, 0)], "r int, g int, b int", colour.luma10(F.col("r"), F.col("g"), F.col("b"))) == [1023, 0]
    assert run(spark, [(0,), (100,)], "q int", colour.quality_to_qp(F.col("q"))) == [63, 0]


def test_statuses(spark):
    assert [grammar.ERRORS[k][0] for k in grammar.ERRORS] == [404, 400, 413, 500, 502, 504, 422, 500]
    assert run(spark, [(200,), (404,), (414,), (302,), (403,)], "s int", grammar.status_of(grammar.upstream_kind(F.col("s"), gcs=True))) == [200, 404, 400, 502, 500]


def test_decoded_length(spark):
    assert run(spark, [("photo.jpg",), ("a%20b.jpg",), ("%E4%B8%AD.jpg",)], "k string", grammar.decoded_length(F.col("k"))) == [9, 7, 7]


@pytest.mark.parametrize("source,target", [(7, 3), (3, 7), (64, 64), (1, 5), (100, 1)])
def test_windows(spark, source, target):
    from rasterloom.kernels.raster import weights
    from rasterloom.operators.resample import windows

    got = {(r.o, r.i): r.weight for r in windows(spark, source, target).collect()}
    want = weights(source, target)
    assert max(abs(got.get((o, i), 0.0) - want[o, i]) for o in range(target) for i in range(source)) < 1e-6
