"""Queries over the driver's tables, one per operator that SQL can say, each with the SQL that it is held against.

The tables stand in for the engine's own: part and orders for images with a size, events for a request log, pages for source keys, embeddings for rows of
samples, lineitem for measured results. Floats are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, cost, geometry, grammar
from ..operators import coalesce, metrics, quality, resample

QUERIES: dict = {}
ORACLES: dict = {}

KEY, SALT = bytes(range(1, 33)), bytes(range(200, 216))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


# ---------------------------------------------------------------- geometry and cost

IMAGES = """i AS (SELECT p_partkey, 1 + (p_partkey * 37) % 8192 AS w, 1 + (p_partkey * p_size * 11) % 8192 AS h,
  CASE WHEN p_size % 3 = 0 THEN 4294967295 ELSE 100 + p_size * 10 END AS bw, CASE WHEN p_size % 3 = 1 THEN 4294967295 ELSE 50 + p_partkey % 900 END AS bh,
  1 + p_partkey % 8 AS o, CASE p_partkey % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'avif' END AS fmt, p_size FROM part)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return _t(spark, sf_dir, "part").select(
        k, (1 + (k * 37) % 8192).alias("w"), (1 + (k * s * 11) % 8192).alias("h"),
        geometry.bounded(F.when(s % 3 == 0, 0).otherwise(100 + s * 10)).alias("bw"), geometry.bounded(F.when(s % 3 == 1, 0).otherwise(50 + k % 900)).alias("bh"),
        (1 + k % 8).alias("o"), F.element_at(F.array(*map(F.lit, ("jpeg", "png", "webp", "avif"))), (k % 4 + 1).cast("int")).alias("fmt"), s,
    )


def _fit_sql(w: str, h: str, bw: str, bh: str) -> tuple[str, str]:
    scale = f"least({bw}::DOUBLE / {w}, {bh}::DOUBLE / {h}, 1.0)"
    return tuple(f"CAST(greatest(round({d} * {scale}), 1) AS BIGINT)" for d in (w, h))


_FIT = _fit_sql("w", "h", "bw", "bh")
_CFIT = _fit_sql("w", "h", "CASE WHEN fmt = 'webp' THEN least(bw, 16383) ELSE bw END", "CASE WHEN fmt = 'webp' THEN least(bh, 16383) ELSE bh END")


@query(f"WITH {IMAGES} SELECT p_partkey, w, h, fmt, {_CFIT[0]} AS out_w, {_CFIT[1]} AS out_h, w * h > 64000000 AS too_large FROM i")
def fit_plan(spark, sf_dir):
    d = images(spark, sf_dir)
    ow, oh = geometry.fit(F.col("w"), F.col("h"), geometry.ceiling(F.col("bw"), F.col("fmt")), geometry.ceiling(F.col("bh"), F.col("fmt")))
    return d.select("p_partkey", "w", "h", "fmt", ow.alias("out_w"), oh.alias("out_h"), cost.too_many_pixels(F.col("w"), F.col("h")).alias("too_large"))


_D = ("CASE WHEN o >= 5 THEN h ELSE w END", "CASE WHEN o >= 5 THEN w ELSE h END")
_DF = _fit_sql(f"({_D[0]})", f"({_D[1]})", "bw", "bh")
_TF = _fit_sql("h", "w", "bw", "bh")


@query(f"""WITH {IMAGES}, f AS (SELECT p_partkey, o, {_D[0]} AS shown_w, {_D[1]} AS shown_h, {_DF[0]} AS fw, {_DF[1]} AS fh, {_FIT[0]} AS aw, {_FIT[1]} AS ah, {_TF[0]} AS tw, {_TF[1]} AS th FROM i)
SELECT p_partkey, shown_w, shown_h, CASE WHEN o >= 5 THEN fh ELSE fw END AS target_w, CASE WHEN o >= 5 THEN fw ELSE fh END AS target_h,
CASE WHEN aw * ah >= tw * th THEN aw ELSE th END AS larger_w, CASE WHEN aw * ah >= tw * th THEN ah ELSE tw END AS larger_h FROM f""")
def display_fit(spark, sf_dir):
    w, h, o, bw, bh = map(F.col, ("w", "h", "o", "bw", "bh"))
    shown, target, larger = geometry.display(w, h, o), geometry.oriented_fit(w, h, o, bw, bh), geometry.larger_fit(w, h, bw, bh)
    names = ["shown_w", "shown_h", "target_w", "target_h", "larger_w", "larger_h"]
    return images(spark, sf_dir).select("p_partkey", *(c.alias(n) for c, n in zip((*shown, *target, *larger), names)))


@query(f"""WITH {IMAGES}, f AS (SELECT p_partkey, w, h, {_FIT[0]} AS dw, {_FIT[1]} AS dh, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 1.0 WHEN 2 THEN 1.7 ELSE 2.0 END AS m FROM i)
SELECT p_partkey, CAST(CASE WHEN m IS NULL THEN 8 ELSE coalesce((SELECT min(k) FROM range(1, 9) r(k) WHERE (ceil(w * k / 8.0) >= ceil(dw * m) OR ceil(w * k / 8.0) >= w) AND (ceil(h * k / 8.0) >= ceil(dh * m) OR ceil(h * k / 8.0) >= h)), 8) END AS INTEGER) AS numerator,
CAST(CASE WHEN ceil(dw * coalesce(m, 1.0)) < w THEN greatest(ceil(dw * coalesce(m, 1.0)), dw) ELSE w END AS BIGINT) AS webp_w,
CAST(CASE WHEN ceil(dw * coalesce(m, 1.0)) < w THEN greatest(round(h * ceil(dw * coalesce(m, 1.0)) / w), dh) ELSE h END AS BIGINT) AS webp_h FROM f""")
def dct_scale(spark, sf_dir):
    w, h, s = F.col("w"), F.col("h"), F.col("p_size")
    dw, dh = geometry.fit(w, h, F.col("bw"), F.col("bh"))
    d = images(spark, sf_dir).select("p_partkey", "w", "h", dw.alias("dw"), dh.alias("dh"), F.when(s % 4 == 1, 1.0).when(s % 4 == 2, 1.7).when(s % 4 == 3, 2.0).alias("m"))
    scaled = geometry.webp_scale(w, h, F.col("dw"), F.col("dh"), F.coalesce("m", F.lit(1.0)))
    return d.select("p_partkey", geometry.dct_numerator(w, h, F.col("dw"), F.col("dh"), F.col("m")).alias("numerator"), scaled[0].alias("webp_w"), scaled[1].alias("webp_h"))


@query(f"""WITH {IMAGES}, c AS (SELECT p_partkey, w, h, fmt, {_FIT[0]} AS ow, {_FIT[1]} AS oh, CASE p_size % 5 WHEN 0 THEN 'gray' WHEN 1 THEN 'graya' WHEN 2 THEN 'rgb' WHEN 3 THEN 'rgba' ELSE CASE WHEN fmt = 'jpeg' THEN 'cmyk' ELSE 'palette' END END AS color, p_size FROM i),
t AS (SELECT *, CASE WHEN (fmt = 'png' AND color IN ('rgba', 'graya', 'palette')) OR (fmt = 'webp' AND color IN ('rgba', 'graya')) OR fmt = 'avif' OR (fmt = 'jpeg' AND color = 'cmyk') THEN 4 ELSE 3 END AS ch FROM c),
u AS (SELECT p_partkey, fmt, w * h * ch AS staged, CASE WHEN p_size % 2 = 0 THEN 2 * w * h * ch ELSE 0 END AS resize_input, 3 * ow * oh * ch AS output, CASE WHEN fmt = 'jpeg' AND p_size % 3 = 0 THEN 2 * w * h * 3 ELSE 0 END AS whole_source, CASE WHEN fmt = 'jpeg' THEN w ELSE w * h // 4 + w END AS compressed FROM t)
SELECT p_partkey, staged, resize_input, output, whole_source, CAST(compressed AS BIGINT) AS compressed, CAST(staged + resize_input + output + whole_source + compressed AS BIGINT) AS estimate,
staged + resize_input + output + whole_source + compressed > 134217728 AS refused,
'estimate=' || CAST(staged + resize_input + output + whole_source + compressed AS BIGINT) || ' limit=134217728 staged=' || staged || ' resize_input=' || resize_input || ' output=' || output || ' whole_source=' || whole_source || ' compressed=' || CAST(compressed AS BIGINT) AS report FROM u""")
def decode_cost(spark, sf_dir):
    w, h, fmt, s = map(F.col, ("w", "h", "fmt", "p_size"))
    ow, oh = geometry.fit(w, h, F.col("bw"), F.col("bh"))
    color = F.element_at(F.array(F.lit("gray"), F.lit("graya"), F.lit("rgb"), F.lit("rgba"), F.when(fmt == "jpeg", "cmyk").otherwise("palette")), s % 5 + 1)
    d = images(spark, sf_dir).select("p_partkey", "w", "h", "fmt", "p_size", ow.alias("ow"), oh.alias("oh"), cost.channels(fmt, color).alias("ch"))
    t = cost.terms(w, h, F.col("ch"), F.col("ow"), F.col("oh"), linear=s % 2 == 0, progressive=(fmt == "jpeg") & (s % 3 == 0), components=F.lit(3), srcbuf=F.floor(w * h / 4), held=w, fmt=fmt)
    d = d.select("p_partkey", *(c.cast("long").alias(n) for n, c in t.items()))
    parts = {n: F.col(n) for n in t}
    return d.select("p_partkey", *parts, cost.total(parts).alias("estimate"), (cost.total(parts) > 134217728).alias("refused"), cost.report(parts, cost.total(parts), F.lit(134217728)).alias("report"))


@query(f"""WITH {IMAGES}, c AS (SELECT w * h * 3 AS b FROM i), g AS (SELECT 1 << e AS bound FROM range(20, 33) r(e))
SELECT CAST(bound AS VARCHAR) AS le, (SELECT count(*) FROM c WHERE b <= bound) AS cumulative, (SELECT count(*) FROM c) AS count, (SELECT CAST(sum(b) AS DOUBLE) FROM c) AS sum FROM g
UNION ALL SELECT '+Inf', (SELECT count(*) FROM c), (SELECT count(*) FROM c), (SELECT CAST(sum(b) AS DOUBLE) FROM c)""")
def decoded_bytes_histogram(spark, sf_dir):
    sizes = images(spark, sf_dir).select((F.col("w") * F.col("h") * 3).alias("b"))
    return metrics.histogram(sizes, "b", cost.DECODED_BOUNDS, scale=1).withColumn("sum", F.col("sum").cast("double"))


# ---------------------------------------------------------------- grammar


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'avif' END AS format, doc_id % 6 = 5 AS too_short FROM documents""")
def sniff_format(spark, sf_dir):
    heads = ["FFD8FFE000104A4649460001", "89504E470D0A1A0A0000000D", "524946460000000057454250", "000000206674797061766966", "474946383961000000000000", "FFD8FF"]
    content = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 6 + 1).cast("int")))
    d = _t(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    return d.select("doc_id", F.when(F.length("content") >= 12, grammar.sniffed(F.col("content"))).alias("format"), (F.length("content") < 12).alias("too_short"))


REQS = """r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '/resize/' || (event_id % 9000) || '/' || user_id || '/a/' || event_type || '.jpg' WHEN 1 THEN '/sig' || user_id || '/resize/' || user_id || '/0/' || event_type || '.png@webp'
 WHEN 2 THEN '/resize/0/0/x.png@jxl' WHEN 3 THEN '/image/width=' || user_id || '/' || event_type || '.jpg' ELSE '/resize/100/' || (event_id % 10000) || '/dir/@webp' END AS url FROM events)"""


def _urls(spark, sf_dir) -> DataFrame:
    e, u, k = F.col("event_id"), F.col("user_id").cast("string"), F.col("event_type")
    cat = F.concat
    s = lambda c: c.cast("string")
    url = F.when(e % 5 == 0, cat(F.lit("/resize/"), s(e % 9000), F.lit("/"), u, F.lit("/a/"), k, F.lit(".jpg"))).when(e % 5 == 1, cat(F.lit("/sig"), u, F.lit("/resize/"), u, F.lit("/0/"), k, F.lit(".png@webp"))).when(
        e % 5 == 2, F.lit("/resize/0/0/x.png@jxl")).when(e % 5 == 3, cat(F.lit("/image/width="), u, F.lit("/"), k, F.lit(".jpg"))).otherwise(cat(F.lit("/resize/100/"), s(e % 10000), F.lit("/dir/@webp")))
    return _t(spark, sf_dir, "events").select("event_id", url.alias("url"))


@query(f"""WITH {REQS}, p AS (SELECT event_id, CASE event_id % 5 WHEN 1 THEN regexp_extract(url, '^/([^/]+)/', 1) END AS signature,
 CASE WHEN event_id % 5 = 3 THEN NULL ELSE CAST(regexp_extract(url, 'resize/(\\d+)/(\\d+)/', 1) AS BIGINT) END AS width, CASE WHEN event_id % 5 = 3 THEN NULL ELSE CAST(regexp_extract(url, 'resize/(\\d+)/(\\d+)/', 2) AS BIGINT) END AS height,
 CASE WHEN event_id % 5 = 3 THEN NULL ELSE regexp_extract(url, 'resize/\\d+/\\d+/(.+)$', 1) END AS file FROM r)
SELECT event_id, signature, width, height, CASE WHEN event_id % 5 IN (1, 2) THEN split_part(file, '@', 1) ELSE file END AS base, CASE event_id % 5 WHEN 1 THEN 'webp' END AS format,
CASE WHEN file IS NULL THEN 404 WHEN (width = 0 AND height = 0) OR width > 8192 OR height > 8192 OR event_id % 5 = 2 THEN 400 ELSE 200 END AS status FROM p""")
def route_parse(spark, sf_dir):
    d = _urls(spark, sf_dir)
    d = d.select("event_id", *(c.alias(n) for n, c in grammar.positional(F.col("url")).items()))
    at = grammar.at_format(F.col("file"))
    status = F.when(F.col("file").isNull(), 404).when(~geometry.valid_dims(F.col("width"), F.col("height")) | at["unavailable"], 400).otherwise(200)
    return d.select("event_id", "signature", "width", "height", at["base"].alias("base"), at["format"].alias("format"), status.alias("status"))


#: An option list made from a row: each option is there if a prime divides the id, with a value that may be out of range; both engines read this expression.
SAID = """concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'width=' || (user_id * 7 % 9500) END, CASE WHEN event_id % 3 = 0 THEN 'height=' || (event_id % 8300) END,
 CASE WHEN event_id % 5 = 0 THEN 'quality=' || (user_id % 120) END, CASE WHEN event_id % 7 = 0 THEN 'format=' || event_type END, CASE WHEN event_id % 11 = 0 THEN event_type || '=' || user_id END,
 CASE WHEN event_id % 13 = 0 THEN 'height=' || user_id END, CASE WHEN event_id % 17 = 0 THEN event_type END,
 CASE WHEN event_id % 4 = 2 THEN 'format=' || CASE user_id % 6 WHEN 0 THEN 'jpg' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'webp' WHEN 4 THEN 'avif' ELSE 'auto' END END, CASE WHEN event_id % 23 = 0 THEN 'quality=' || event_type END)"""


@query(f"""WITH l AS (SELECT event_id, {SAID} AS said FROM events),
x AS (SELECT event_id, unnest(string_split(said, ',')) AS item, generate_subscripts(string_split(said, ','), 1) AS i FROM l),
k AS (SELECT *, split_part(item, '=', 1) AS key, substr(item, instr(item, '=') + 1) AS value, instr(item, '=') > 0 AS has FROM x),
f AS (SELECT *, CASE WHEN NOT has THEN 'malformed option: ' || item WHEN key NOT IN ('width', 'height', 'quality', 'format') THEN 'unknown option: ' || key
  WHEN row_number() OVER (PARTITION BY event_id, key ORDER BY i) > 1 THEN 'duplicate option: ' || key
  WHEN key = 'format' THEN CASE WHEN value IN ('jpg', 'jpeg', 'png', 'webp', 'avif', 'auto') THEN NULL ELSE 'invalid option: format' END
  WHEN coalesce(TRY_CAST(value AS INTEGER), 0) BETWEEN 1 AND CASE WHEN key = 'quality' THEN 100 ELSE 8192 END THEN NULL ELSE 'invalid option: ' || key END AS fault FROM k),
g AS (SELECT event_id, arg_min(fault, i) FILTER (fault IS NOT NULL) AS fault, max(CASE WHEN key = 'width' THEN TRY_CAST(value AS BIGINT) END) AS w, max(CASE WHEN key = 'height' THEN TRY_CAST(value AS BIGINT) END) AS h,
  max(CASE WHEN key = 'quality' THEN TRY_CAST(value AS BIGINT) END) AS q, max(CASE WHEN key = 'format' THEN CASE value WHEN 'jpg' THEN 'jpeg' WHEN 'auto' THEN NULL ELSE value END END) AS fmt FROM f GROUP BY event_id),
e AS (SELECT *, coalesce(fault, CASE WHEN w IS NULL AND h IS NULL THEN 'no dimension' END) AS error FROM g)
SELECT event_id, CASE WHEN error IS NULL THEN coalesce(w, 0) END AS width, CASE WHEN error IS NULL THEN coalesce(h, 0) END AS height, CASE WHEN error IS NULL THEN q END AS quality, CASE WHEN error IS NULL THEN fmt END AS format, error FROM e""")
def options_parse(spark, sf_dir):
    d = _t(spark, sf_dir, "events").select("event_id", F.expr(SAID).alias("said"))
    return d.select("event_id", grammar.options(F.col("said")).alias("o")).select("event_id", "o.*")


#: A source key made from a row: a folder, a middle part that may be none or lead elsewhere, a name and an end that a key may not have.
SOURCE_KEY = """concat('s', page_id % 50, '/', CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN '.' WHEN 2 THEN '..' WHEN 3 THEN 'm..' WHEN 4 THEN '%25' WHEN 5 THEN '...m' ELSE 'm' END, '/', page_id,
 CASE page_id % 11 WHEN 0 THEN '?v' WHEN 1 THEN '#v' WHEN 2 THEN '/' WHEN 3 THEN '@3x' WHEN 4 THEN ' ü' ELSE '.jpg' END)"""


@query(f"""WITH k AS (SELECT page_id, {SOURCE_KEY} AS key FROM pages)
SELECT page_id, key, len(list_filter(string_split(key, '/'), lambda x: x IN ('', '.', '..'))) = 0 AND strpos(key, '?') = 0 AND strpos(key, '#') = 0 AS valid,
length(key) - 2 * (length(key) - length(replace(key, '%', ''))) AS decoded_length FROM k""")
def path_validate(spark, sf_dir):
    d = _t(spark, sf_dir, "pages").select("page_id", F.expr(SOURCE_KEY).alias("key"))
    return d.select("page_id", "key", grammar.valid_path(F.col("key")).alias("valid"), grammar.decoded_length(F.col("key")).cast("long").alias("decoded_length"))


_UN = "url_encode(regexp_replace(url, '^https?://', '') || ' ' || page_id || '+~!')"
for _c in "~!$&'()*+,;=:@/":
    _UN = f"replace({_UN}, '%{ord(_c):02X}', '{_c * 2 if _c == chr(39) else _c}')"


@query(f"SELECT page_id, {_UN} AS encoded FROM pages")
def path_encode(spark, sf_dir):
    key = F.concat(F.regexp_replace("url", "^https?://", ""), F.lit(" "), F.col("page_id").cast("string"), F.lit("+~!"))
    return _t(spark, sf_dir, "pages").select("page_id", grammar.encoded_path(key).alias("encoded"))


_PADS = grammar._pads(KEY)


@query(f"""WITH p AS (SELECT page_id, '/resize/' || (page_id % 900) || '/100/p' || page_id || '.jpg' AS path FROM pages)
SELECT page_id, path, rtrim(translate(base64(unhex(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || unhex('{SALT.hex()}') || encode(path)))))), '+/', '-_'), '=') AS signature FROM p""")
def url_sign(spark, sf_dir):
    k = F.col("page_id")
    d = _t(spark, sf_dir, "pages").select(k, F.concat(F.lit("/resize/"), (k % 900).cast("string"), F.lit("/100/p"), k.cast("string"), F.lit(".jpg")).alias("path"))
    return d.select("page_id", "path", grammar.signature(F.col("path"), KEY, SALT).alias("signature"))


#: An Accept header made from a row: types in an order of their own, some with weights.
ACCEPT = """concat_ws(', ', CASE WHEN event_id % 3 = 0 THEN 'text/' || event_type END, CASE WHEN event_id % 4 < 2 THEN 'image/webp;q=0.' || (user_id % 10) END, CASE WHEN event_id % 5 = 1 THEN 'image/avif' END,
 CASE WHEN event_id % 2 = 1 THEN 'image/svg+xml' END)"""


@query(f"""WITH a AS (SELECT event_id, {ACCEPT} AS accept, CASE WHEN event_id % 7 = 0 THEN 'png' END AS explicit FROM events),
n AS (SELECT *, CASE WHEN instr(accept, 'image/avif') > 0 THEN 'avif' WHEN instr(accept, 'image/webp') > 0 THEN 'webp' END AS negotiated FROM a)
SELECT event_id, negotiated, coalesce(explicit, negotiated, 'jpeg') AS format, 'Accept' AS vary FROM n""")
def negotiate_format(spark, sf_dir):
    d = _t(spark, sf_dir, "events").select("event_id", F.expr(ACCEPT).alias("accept"), F.when(F.col("event_id") % 7 == 0, "png").alias("explicit"))
    n = grammar.negotiated(F.col("accept"), ["avif", "webp"])
    return d.select("event_id", n.alias("negotiated"), grammar.precedence(F.col("explicit"), n, F.lit("jpeg")).alias("format"), F.lit("Accept").alias("vary"))


CONFIG = {"quality": 80, "webp_quality": 75, "avif_quality": 55, "avif_alpha_quality": None, "png_quantize": False, "png_quantize_colors": 256, "png_effort": None}


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(1 + event_id % 100 AS INTEGER) END AS q, CASE WHEN event_id % 4 = 0 THEN true END AS pq, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 400 AS INTEGER) END AS pc, CASE WHEN event_id % 6 = 0 THEN 'high' END AS pe FROM events)
SELECT event_id, coalesce(q, 80) AS quality, coalesce(q, 75) AS webp_quality, coalesce(q, 55) AS avif_quality, coalesce(q, 55) AS avif_alpha_quality, coalesce(pq, false) AS png_quantize, least(greatest(coalesce(pc, 256), 2), 256) AS png_quantize_colors,
coalesce(pe, CASE WHEN coalesce(pq, false) THEN 'balanced' ELSE 'fast' END) AS png_effort FROM r""")
def resolve_knobs(spark, sf_dir):
    e = F.col("event_id")
    request = {"quality": F.when(e % 3 == 0, (1 + e % 100).cast("int")), "png_quantize": F.when(e % 4 == 0, True), "png_quantize_colors": F.when(e % 5 == 0, (e % 400).cast("int")), "png_effort": F.when(e % 6 == 0, "high")}
    return _t(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in grammar.resolved(request, CONFIG).items()))


@query("""WITH s AS (SELECT event_id, ([200, 206, 301, 400, 401, 403, 404, 414, 500, 503])[CAST(event_id % 10 + 1 AS INTEGER)] AS origin FROM events),
k AS (SELECT *, CASE WHEN origin BETWEEN 200 AND 299 THEN NULL WHEN origin = 404 THEN 'SourceNotFound' WHEN origin IN (400, 414) THEN 'SourceRejected' ELSE 'Upstream' END AS kind,
 CASE WHEN origin BETWEEN 200 AND 299 THEN NULL WHEN origin IN (401, 403) THEN 'SourceUnreadable' WHEN origin = 404 THEN 'SourceNotFound' WHEN origin IN (400, 414) THEN 'SourceRejected' ELSE 'Upstream' END AS gcs_kind FROM s)
SELECT event_id, kind, CASE kind WHEN 'SourceNotFound' THEN 404 WHEN 'SourceRejected' THEN 400 WHEN 'Upstream' THEN 502 ELSE 200 END AS status,
CASE kind WHEN 'SourceNotFound' THEN 'image not found' WHEN 'SourceRejected' THEN 'source key rejected by the origin' WHEN 'Upstream' THEN 'upstream image fetch failed' END AS body,
CASE gcs_kind WHEN 'SourceNotFound' THEN 404 WHEN 'SourceRejected' THEN 400 WHEN 'Upstream' THEN 502 WHEN 'SourceUnreadable' THEN 500 ELSE 200 END AS gcs_status FROM k""")
def error_status(spark, sf_dir):
    codes = F.array(*map(F.lit, (200, 206, 301, 400, 401, 403, 404, 414, 500, 503)))
    d = _t(spark, sf_dir, "events").select("event_id", F.element_at(codes, (F.col("event_id") % 10 + 1).cast("int")).alias("origin"))
    d = d.select("event_id", grammar.upstream_kind(F.col("origin")).alias("kind"), grammar.upstream_kind(F.col("origin"), gcs=True).alias("gcs"))
    return d.select("event_id", "kind", grammar.status_of(F.col("kind")).alias("status"), grammar.body_of(F.col("kind")).alias("body"), grammar.status_of(F.col("gcs")).alias("gcs_status"))


# ---------------------------------------------------------------- metrics

LOG = """l AS (SELECT event_id, user_id, ts, value, CASE event_type WHEN 'error' THEN '5xx' WHEN 'signup' THEN '4xx' WHEN 'purchase' THEN '3xx' ELSE '2xx' END AS class,
 (['jpeg', 'png', 'webp', 'avif', 'source'])[CAST(event_id % 5 + 1 AS INTEGER)] AS format, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'not_found' WHEN 'purchase' THEN 'error' ELSE 'ok' END AS outcome FROM events)"""
GRID = "g AS (SELECT c.class, f.format FROM (SELECT unnest(['2xx', '3xx', '4xx', '5xx']) AS class) c, (SELECT unnest(['jpeg', 'png', 'webp', 'avif', 'source', 'none']) AS format) f)"


def request_log(events: DataFrame) -> DataFrame:
    """events as a log of requests."""
    k, e = F.col("event_type"), F.col("event_id")
    return events.select(
        e, "user_id", F.col("ts").cast("timestamp").alias("ts"), "value",
        F.when(k == "error", "5xx").when(k == "signup", "4xx").when(k == "purchase", "3xx").otherwise("2xx").alias("class"),
        F.element_at(F.array(*map(F.lit, metrics.FORMATS[:5])), (e % 5 + 1).cast("int")).alias("format"),
        F.when(k == "error", "timeout").when(k == "signup", "not_found").when(k == "purchase", "error").otherwise("ok").alias("outcome"),
    )


def _log(spark, sf_dir) -> DataFrame:
    return request_log(_t(spark, sf_dir, "events"))


_TOTALS = f"WITH {LOG}, {GRID}, n AS (SELECT class, format, count(*) AS n FROM l GROUP BY 1, 2), t AS (SELECT class, format, coalesce(n, 0) AS requests FROM g LEFT JOIN n USING (class, format))"


@query(f"{_TOTALS} SELECT * FROM t")
def requests_total(spark, sf_dir):
    return metrics.requests_total(_log(spark, sf_dir))


@query(f"""{_TOTALS} SELECT 'http_requests_total{{class="' || class || '",format="' || format || '"}} ' || requests AS line FROM t""")
def metrics_exposition(spark, sf_dir):
    return metrics.exposition("http_requests_total", metrics.requests_total(_log(spark, sf_dir)), ["class", "format"], "requests")


@query(f"WITH {LOG}, n AS (SELECT outcome, count(*) AS n FROM l GROUP BY 1) SELECT outcome, coalesce(n, 0) AS fetches FROM (SELECT unnest(['ok', 'not_found', 'timeout', 'rejected', 'error']) AS outcome) LEFT JOIN n USING (outcome)")
def upstream_outcomes(spark, sf_dir):
    return metrics.outcomes_total(_log(spark, sf_dir))


_BOUNDS = ", ".join(map(str, metrics.SECONDS))


@query(f"""WITH {LOG}, v AS (SELECT class, value / 50 AS s FROM l), b AS (SELECT unnest([{_BOUNDS}]) AS bound), c AS (SELECT class, count(*) AS count, CAST(sum(floor(s * 1000000)) AS DOUBLE) / 1000000 AS sum FROM v GROUP BY 1)
SELECT class, CAST(CAST(bound AS DOUBLE) AS VARCHAR) AS le, (SELECT count(*) FROM v WHERE v.class = c.class AND s <= bound) AS cumulative, count, round(sum, 6) AS sum FROM c, b
UNION ALL SELECT class, '+Inf', count, count, round(sum, 6) FROM c""")
def duration_histogram(spark, sf_dir):
    d = _log(spark, sf_dir).select("class", (F.col("value") / 50).alias("s"))
    return metrics.histogram(d, "s", metrics.SECONDS, ["class"]).withColumn("sum", F.round("sum", 6))


_FK = "user_id % 7 AS width, user_id % 5 AS height, 'f' || (event_id % 11) || '.jpg' AS file, CASE WHEN event_id % 3 = 0 THEN 'webp' END AS format, CASE WHEN event_id % 2 = 0 THEN 80 END AS quality"


def flights(spark, sf_dir) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    key = [(u % 7).alias("width"), (u % 5).alias("height"), F.concat(F.lit("f"), (e % 11).cast("string"), F.lit(".jpg")).alias("file"), F.when(e % 3 == 0, "webp").alias("format"), F.when(e % 2 == 0, 80).alias("quality")]
    return _t(spark, sf_dir, "events").select(e.alias("req_id"), F.col("ts").cast("timestamp").alias("ts"), *key)


@query(f"WITH f AS (SELECT {_FK}, date_trunc('day', ts) AS w FROM events), g AS (SELECT count(*) AS n FROM f GROUP BY width, height, file, format, quality, w) SELECT 'leader' AS role, count(*) AS requests FROM g UNION ALL SELECT 'follower', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM g")
def coalesced_roles(spark, sf_dir):
    return metrics.roles_total(flights(spark, sf_dir), "1 day")


@query(f"WITH f AS (SELECT event_id AS req_id, ts, {_FK}, date_trunc('day', ts) AS w FROM events) SELECT req_id, CASE WHEN row_number() OVER (PARTITION BY width, height, file, format, quality, w ORDER BY ts, req_id) = 1 THEN 'leader' ELSE 'follower' END AS role FROM f")
def request_roles(spark, sf_dir):
    return metrics.with_roles(flights(spark, sf_dir), "1 day").select("req_id", "role")


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, n, " + ", ".join(f"v[CAST(least(n - 1, floor(n * {p} / 100)) AS BIGINT) + 1] AS p{p}" for p in (50, 95, 99)) + " FROM s")
def latency_percentiles(spark, sf_dir):
    return metrics.percentiles(_t(spark, sf_dir, "events"), "event_type", "value", [50, 95, 99])


@query("""WITH s AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS c, sum(floor(value * 1000)) AS v FROM events GROUP BY 1, 2), r AS (SELECT event_type, day, sum(c) OVER w AS n, sum(v) OVER w AS total FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, CAST(n - lag(n) OVER w AS BIGINT) AS d_count, CAST(total - lag(total) OVER w AS BIGINT) AS d_total, round((total - lag(total) OVER w)::DOUBLE / (n - lag(n) OVER w), 6) AS mean FROM r WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def counter_delta(spark, sf_dir):
    from pyspark.sql import Window

    day = _t(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("c"), F.sum(F.floor(F.col("value") * 1000)).alias("v"))
    w = Window.partitionBy("event_type").orderBy("day")
    scrapes = day.select("event_type", "day", F.sum("c").over(w).alias("n"), F.sum("v").over(w).alias("total"))
    return metrics.deltas(scrapes, "event_type", "day", "total", "n").select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "d_count", "d_total", _r(F.col("mean"), "mean"))


@query("SELECT event_id, 'req=' || event_id || ' status=' || CASE event_type WHEN 'error' THEN '500' ELSE '200' END || ' ms=' || (user_id % 500) || '.' || (event_id % 10) || ' path=/resize/' || user_id || '/0/x.jpg' || CASE event_type WHEN 'error' THEN ' err=internal' ELSE '' END AS line FROM events")
def log_lines(spark, sf_dir):
    bad = F.col("event_type") == "error"
    line = metrics.access_line(F.col("event_id"), F.when(bad, 500).otherwise(200), F.col("user_id") % 500 + (F.col("event_id") % 10) / 10, F.concat(F.lit("/resize/"), F.col("user_id").cast("string"), F.lit("/0/x.jpg")), F.when(bad, "internal"))
    return _t(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("""WITH r AS (SELECT event_id, event_id % 1000 AS key FROM events), j AS (SELECT event_id, key, p.page_id, p.url FROM r LEFT JOIN pages p ON p.page_id = key)
SELECT event_id, key, url, CASE WHEN page_id IS NULL THEN 'SourceNotFound' END AS error FROM j""")
def source_join(spark, sf_dir):
    r = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1000).alias("key"))
    found = coalesce.with_sources(r, _t(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url"), "key")
    return found.select("event_id", "key", "url", F.col("error.kind").alias("error"))


# ---------------------------------------------------------------- studies of quality


@query("SELECT l_shipmode_ AS service, " + ", ".join(f"round(avg(CASE WHEN q = {q} THEN v END), 6) AS q{q}" for q in range(1, 8)) + " FROM (SELECT l_returnflag AS l_shipmode_, l_linenumber AS q, l_extendedprice AS v FROM lineitem) GROUP BY 1")
def quality_pivot(spark, sf_dir):
    d = quality.pivoted(_t(spark, sf_dir, "lineitem").withColumn("service", F.col("l_returnflag")), ["service"], "l_linenumber", "l_extendedprice", list(range(1, 8)))
    return d.select("service", *(_r(F.col(f"q{q}"), f"q{q}") for q in range(1, 8)))


_CURVE = "c AS (SELECT l_suppkey AS item, l_returnflag AS service, l_linenumber AS q, avg(l_quantity) AS score, avg(l_extendedprice) AS bytes FROM lineitem GROUP BY 1, 2, 3)"


def _curve(spark, sf_dir) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("service"), F.col("l_linenumber").alias("q")).agg(F.avg("l_quantity").alias("score"), F.avg("l_extendedprice").alias("bytes"))


@query(f"""WITH {_CURVE}, s AS (SELECT item, service, score, bytes, lead(score) OVER w AS s1, lead(bytes) OVER w AS b1 FROM c WINDOW w AS (PARTITION BY item, service ORDER BY score, bytes))
SELECT item, service, round(min(CASE WHEN score <= 25.5 AND s1 >= 25.5 THEN exp(ln(bytes) + coalesce((25.5 - score) / nullif(s1 - score, 0), 0) * (ln(b1) - ln(bytes))) END), 4) AS bytes_at_score FROM s GROUP BY 1, 2""")
def bytes_to_score(spark, sf_dir):
    d = quality.bytes_to_score(_curve(spark, sf_dir), ["item", "service"], 25.5)
    return d.select("item", "service", F.round("bytes_at_score", 4).alias("bytes_at_score"))


@query(f"""WITH {_CURVE}, r AS (SELECT item, service, min(bytes) AS lo, max(bytes) AS hi FROM c GROUP BY 1, 2), m AS (SELECT item, (max(lo) + min(hi)) / 2 AS mid FROM r GROUP BY 1),
s AS (SELECT c.item, service, mid, score, bytes, lead(score) OVER w AS s1, lead(bytes) OVER w AS b1 FROM c JOIN m ON c.item = m.item WINDOW w AS (PARTITION BY c.item, service ORDER BY bytes, score))
SELECT item, service, round(min(CASE WHEN bytes <= mid AND b1 >= mid THEN score + coalesce((mid - bytes) / nullif(b1 - bytes, 0), 0) * (s1 - score) END), 6) AS score_at_bytes FROM s GROUP BY 1, 2""")
def iso_byte_score(spark, sf_dir):
    c = _curve(spark, sf_dir)
    mid = c.groupBy("item", "service").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).groupBy("item").agg(((F.max("lo") + F.min("hi")) / 2).alias("mid"))
    d = quality.score_at_bytes(c.join(mid, "item"), ["item", "service"], "mid")
    return d.select("item", "service", _r(F.col("score_at_bytes"), "score_at_bytes"))


@query("""WITH v AS (SELECT l_suppkey AS item, l_returnflag AS service, avg(l_extendedprice) AS bytes FROM lineitem GROUP BY 1, 2)
SELECT a.service, round(exp(avg(ln(a.bytes / b.bytes))) - 1, 6) AS ratio, count(*) AS n FROM v a JOIN v b ON a.item = b.item AND b.service = 'N' GROUP BY 1""")
def geo_mean_ratio(spark, sf_dir):
    v = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("service")).agg(F.avg("l_extendedprice").alias("bytes"))
    return quality.geo_mean_ratio(v, "item", "service", "bytes", "N").select("service", _r(F.col("ratio"), "ratio"), "n")


@query("WITH m AS (SELECT l_returnflag AS grp, l_suppkey, min(l_extendedprice) AS least FROM lineitem GROUP BY 1, 2) SELECT grp, round(avg(least), 6) AS mean_of_least, count(*) AS items FROM m GROUP BY 1")
def best_of_n(spark, sf_dir):
    return quality.best_of(_t(spark, sf_dir, "lineitem").withColumn("grp", F.col("l_returnflag")), "grp", "l_suppkey", "l_extendedprice").select("grp", _r(F.col("mean_of_least"), "mean_of_least"), "items")


@query("""WITH c AS (SELECT l_returnflag AS grp, l_linenumber AS k, count(*) AS score, l_linenumber * 0.5 AS margin FROM lineitem GROUP BY 1, 2), b AS (SELECT grp, arg_max(k, score * 100 + k) AS best_k, max(score) AS best_score, min(k) FILTER (margin >= 1.7) AS default_k FROM c GROUP BY 1)
SELECT b.grp, best_k, best_score, default_k, best_score - c.score AS loss FROM b LEFT JOIN c ON c.grp = b.grp AND c.k = default_k""")
def default_scale(spark, sf_dir):
    c = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("k")).agg(F.count("*").alias("score")).withColumn("margin", F.col("k") * 0.5)
    return quality.default_pick(c, ["grp"], "k", "margin", "score", 1.7)


# ---------------------------------------------------------------- pixels


def _taps_sql(source: int, target: int) -> str:
    scale, fs = source / target, max(source / target, 1.0)
    return f"""o AS (SELECT CAST(r AS INTEGER) AS o, (r + 0.5) * {scale!r}::DOUBLE AS centre FROM range({target}) t(r)), t AS (SELECT o, centre, CAST(i AS INTEGER) AS i FROM o, range({source}) s(i) WHERE i >= floor(centre - {3 * fs!r}::DOUBLE) AND i < ceil(centre + {3 * fs!r}::DOUBLE)),
x AS (SELECT o, i, (i + 0.5 - centre) / {fs!r}::DOUBLE AS x FROM t), k AS (SELECT o, i, CASE WHEN x >= -3 AND x < 3 THEN CASE WHEN x = 0 THEN 1.0 ELSE sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) END ELSE 0.0 END AS w FROM x), taps AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS weight FROM k WHERE w <> 0)"""


@query(f"WITH {_taps_sql(64, 24)} SELECT o, i, round(weight, 6) AS weight FROM taps WHERE abs(weight) > 1e-9")
def lanczos_windows(spark, sf_dir):
    return resample.windows(spark, 64, 24).where(F.abs("weight") > 1e-9).select("o", "i", _r(F.col("weight"), "weight"))


@query(f"WITH {_taps_sql(64, 24)}, p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings) SELECT vec_id, CAST(o AS INTEGER) AS x, round(sum(v * weight), 5) AS v FROM p JOIN taps ON i = x GROUP BY 1, 2")
def lanczos_resample(spark, sf_dir):
    p = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v").cast("double"))
    return resample.resampled(p, resample.windows(spark, 64, 24), "x", ["vec_id"]).select("vec_id", "x", F.round("v", 5).alias("v"))


_LIN = "CAST(floor(CASE WHEN {s} / 255.0::DOUBLE <= 0.04045 THEN {s} / 255.0::DOUBLE / 12.92 ELSE pow(({s} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END * 65535 + 0.5) AS BIGINT)"
_SRGB = "CAST(floor(CASE WHEN {v} / 65535.0::DOUBLE <= 0.0031308 THEN {v} / 65535.0::DOUBLE * 12.92 ELSE 1.055 * pow({v} / 65535.0::DOUBLE, 1 / 2.4::DOUBLE) - 0.055 END * 255 + 0.5) AS BIGINT)"


@query(f"SELECT s, {_LIN.format(s='s')} AS linear FROM range(256) t(s)")
def srgb_lut(spark, sf_dir):
    return spark.range(256).select(F.col("id").alias("s"), colour.to_linear(F.col("id")).alias("linear"))


@query(f"SELECT v, {_SRGB.format(v='v')} AS srgb FROM range(65536) t(v)")
def linear_lut(spark, sf_dir):
    return spark.range(65536).select(F.col("id").alias("v"), colour.from_linear(F.col("id")).alias("srgb"))


_BYTES = "b AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 256 AS BIGINT) AS r, CAST(l_partkey % 256 AS BIGINT) AS g, CAST(l_suppkey % 256 AS BIGINT) AS bl, CAST((l_orderkey * 7 + l_linenumber * 31) % 256 AS BIGINT) AS a FROM lineitem)"


def _bytes(spark, sf_dir) -> DataFrame:
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return _t(spark, sf_dir, "lineitem").select(o, n, (o % 256).alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_suppkey") % 256).alias("bl"), ((o * 7 + n * 31) % 256).alias("a"))


@query(f"WITH {_BYTES}, m AS (SELECT l_orderkey, l_linenumber, ({_LIN.format(s='r')} * a + {_LIN.format(s='255')} * (255 - a) + 127) // 255 AS mixed FROM b) SELECT l_orderkey, l_linenumber, {_SRGB.format(v='mixed')} AS r FROM m")
def flatten_alpha(spark, sf_dir):
    return _bytes(spark, sf_dir).select("l_orderkey", "l_linenumber", colour.flattened(F.col("r"), F.col("a"), F.lit(255)).alias("r"))


@query(f"WITH {_BYTES}, p AS (SELECT *, (r * a + 127) // 255 AS pre FROM b) SELECT l_orderkey, l_linenumber, pre, CASE WHEN a = 0 THEN 0 ELSE least(pre * 255 // a, 255) END AS back, bool_or(a <> 255) OVER (PARTITION BY l_orderkey) AS has_alpha FROM p")
def premultiply(spark, sf_dir):
    from pyspark.sql import Window

    d = _bytes(spark, sf_dir).withColumn("pre", colour.premultiplied(F.col("r"), F.col("a")))
    return d.select("l_orderkey", "l_linenumber", "pre", colour.unpremultiplied(F.col("pre"), F.col("a")).alias("back"), F.bool_or(F.col("a") != 255).over(Window.partitionBy("l_orderkey")).alias("has_alpha"))


@query(f"WITH {_BYTES} SELECT l_orderkey, l_linenumber, (r * a + 127) // 255 AS r, (g * a + 127) // 255 AS g, (bl * a + 127) // 255 AS b FROM b")
def cmyk_naive(spark, sf_dir):
    return _bytes(spark, sf_dir).select("l_orderkey", "l_linenumber", *(colour.cmyk_naive(F.col(c), F.col("a")).alias(n) for c, n in (("r", "r"), ("g", "g"), ("bl", "b"))))


@query(f"WITH {_BYTES} SELECT l_orderkey, l_linenumber, ((1225 * r + 2404 * g + 467 * bl) * 1023 + 522240) // 1044480 AS luma, ((100 - a % 101) * 63 + 50) // 100 AS qp, (a * 1023 + 128) // 255 AS alpha FROM b")
def rgb_luma10(spark, sf_dir):
    a = F.col("a")
    return _bytes(spark, sf_dir).select("l_orderkey", "l_linenumber", colour.luma10(F.col("r"), F.col("g"), F.col("bl")).alias("luma"), colour.quality_to_qp(a % 101).alias("qp"), colour.alpha10(a).alias("alpha"))


_CH = "CAST(greatest(least(floor({d} / {k}::DOUBLE / 255.0 * 1023 + 512 + 0.5), 1023), 0) AS BIGINT)"


@query(f"""WITH {_BYTES}, m AS (SELECT l_orderkey // 2 AS block_y, (l_linenumber - 1) // 2 AS block_x, avg(r) AS r, avg(g) AS g, avg(bl) AS b FROM b GROUP BY 1, 2), y AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y FROM m)
SELECT CAST(block_y AS BIGINT) AS block_y, CAST(block_x AS BIGINT) AS block_x, {_CH.format(d='(b - y)', k='1.772')} AS cb, {_CH.format(d='(r - y)', k='1.402')} AS cr FROM y""")
def rgb_chroma420(spark, sf_dir):
    """Blocks of two rows (orders) by two columns (lines)."""
    row, column = F.shiftright("l_orderkey", 1).cast("long"), F.shiftright(F.col("l_linenumber") - 1, 1).cast("long")
    m = _bytes(spark, sf_dir).groupBy(row.alias("block_y"), column.alias("block_x")).agg(F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("bl").alias("b"))
    cb, cr = colour.chroma10(F.col("r"), F.col("g"), F.col("b"))
    return m.select("block_y", "block_x", cb.alias("cb"), cr.alias("cr"))


@query(f"""WITH {_BYTES}, y AS (SELECT l_orderkey, l_linenumber, r * 4 / 1023.0::DOUBLE AS y, (g * 4 - 512) / 1023.0::DOUBLE AS u, (bl * 4 - 512) / 1023.0::DOUBLE AS v FROM b), c AS (SELECT *, y + 2 * (1 - 0.299::DOUBLE) * v AS rr, y + 2 * (1 - 0.114::DOUBLE) * u AS bb FROM y)
SELECT l_orderkey, l_linenumber, CAST(greatest(least(floor(rr * 255 + 0.5), 255), 0) AS BIGINT) AS r, CAST(greatest(least(floor((y - 0.299::DOUBLE * rr - 0.114::DOUBLE * bb) / (1 - 0.299::DOUBLE - 0.114::DOUBLE) * 255 + 0.5), 255), 0) AS BIGINT) AS g, CAST(greatest(least(floor(bb * 255 + 0.5), 255), 0) AS BIGINT) AS b FROM c""")
def yuv_rgb(spark, sf_dir):
    out = colour.yuv_to_rgb(F.col("r") * 4, F.col("g") * 4, F.col("bl") * 4)
    return _bytes(spark, sf_dir).select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(out, "rgb")))


@query("""WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings), n AS (SELECT *, coalesce(lag(v) OVER w, v) AS p, coalesce(lead(v) OVER w, v) AS q FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY x))
SELECT vec_id, CAST(2 * x AS INTEGER) AS x, round((3 * v + p) / 4, 6) AS v FROM n UNION ALL SELECT vec_id, CAST(2 * x + 1 AS INTEGER), round((3 * v + q) / 4, 6) FROM n""")
def chroma_upsample(spark, sf_dir):
    p = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v").cast("double"))
    return resample.chroma_upsampled(p, ["vec_id"], "x", "v").select("vec_id", "x", _r(F.col("v"), "v"))


@query("""WITH p AS (SELECT vec_id, 1 + vec_id % 8 AS o, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), q AS (SELECT vec_id, o, v, k % 16 AS x, k // 16 AS y FROM p)
SELECT vec_id, CAST(CASE o WHEN 1 THEN x WHEN 2 THEN 15 - x WHEN 3 THEN 15 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 3 - y WHEN 7 THEN 3 - y ELSE y END AS INTEGER) AS x,
CAST(CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 3 - y WHEN 4 THEN 3 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 15 - x ELSE 15 - x END AS INTEGER) AS y, round(v, 6) AS v FROM q""")
def orient_pixels(spark, sf_dir):
    p = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    p = p.select("vec_id", (F.col("k") % 16).alias("x"), F.floor(F.col("k") / 16).cast("int").alias("y"), _r(F.col("v").cast("double"), "v"), (1 + F.col("vec_id") % 8).alias("o"))
    return resample.oriented(p, F.lit(16), F.lit(4), F.col("o")).select("vec_id", "x", "y", "v")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 AND length(text) > 1000 THEN NULL WHEN text = '' THEN NULL ELSE text END AS profile FROM documents")
def icc_reassemble(spark, sf_dir):
    parts = resample.icc_chunks(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1000)
    parts = parts.where(~((F.col("doc_id") % 10 == 3) & (F.col("count") > 1) & (F.col("seq") == F.col("count"))))
    return _t(spark, sf_dir, "documents").select("doc_id").join(resample.icc_reassembled(parts, "doc_id"), "doc_id", "left")  # without a part there is no profile
