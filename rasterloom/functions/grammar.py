"""The request grammar as columns: routes, option lists, paths, format tokens, negotiation, signatures, knobs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import MOST_DIM

#: Tokens that name a format, and the formats' MIME types.
TOKENS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "avif": "avif"}
MIME = {"jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "avif": "image/avif"}
ROUTE = r"^(?:/([^/]+))?/resize/(\d+)/(\d+)/(.+)$"
AT = r"^((?:.*/)?[^/@][^/]*|(?:.*/)?@[^/]+)@(jpg|jpeg|png|webp|avif|jxl)$"
PCHAR_KEPT = "~!$&'()*+,;=:@/"


def positional(path: Column) -> dict[str, Column]:
    """signature, width, height and file of /resize/w/h/file; nulls where the route is another."""
    hit = path.rlike(ROUTE)
    part = lambda i: F.when(hit, F.regexp_extract(path, ROUTE, i))
    return {"signature": F.nullif(part(1), F.lit("")), "width": F.try_to_number(part(2), F.lit("9" * 18)).cast("long"), "height": F.try_to_number(part(3), F.lit("9" * 18)).cast("long"), "file": part(4)}


def options_route(path: Column, prefix: str) -> dict[str, Column]:
    """signature, options and file of prefix/options/file; the file is taken as it stands."""
    route = rf"^(?:/([^/]+))?\Q{prefix}\E/([^/]*)/(.+)$"
    hit = path.rlike(route)
    part = lambda i: F.when(hit, F.regexp_extract(path, route, i))
    return {"signature": F.nullif(part(1), F.lit("")), "options": part(2), "file": part(3)}


def options(said: Column) -> Column:
    """struct(width, height, quality, format, error) of a list like width=750,quality=80. The first fault in the order of the list is the error."""
    items = F.split(said, ",")
    keys = F.transform(items, lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    known = ["width", "height", "quality", "format"]

    def fault(item, i):
        key = F.split_part(item, F.lit("="), F.lit(1))
        value = F.substring(item, F.instr(item, "=") + 1, F.length(item))
        number = F.when(value.rlike(r"^[0-9]{1,9}$"), value.cast("int"))
        most = F.when(key == "quality", 100).otherwise(MOST_DIM)
        return (
            F.when(F.instr(item, "=") == 0, F.concat(F.lit("malformed option: "), item))
            .when(~key.isin(known), F.concat(F.lit("unknown option: "), key))
            .when(F.array_contains(F.slice(keys, F.lit(1), i), key), F.concat(F.lit("duplicate option: "), key))
            .when((key == "format") & ~value.isin(*TOKENS, "auto"), F.lit("invalid option: format"))
            .when((key != "format") & (number.isNull() | (number < 1) | (number > most)), F.concat(F.lit("invalid option: "), key))
        )

    faults = F.filter(F.transform(items, fault), lambda f: f.isNotNull())

    def value(name):
        item = F.get(F.filter(items, lambda x: F.startswith(x, F.lit(f"{name}="))), F.lit(0))
        return F.substring(item, len(name) + 2, 1 << 20)

    number = lambda n: F.when(value(n).rlike(r"^[0-9]{1,9}$"), value(n).cast("long"))
    error = F.coalesce(F.get(faults, F.lit(0)), F.when(number("width").isNull() & number("height").isNull(), F.lit("no dimension")))
    ok = error.isNull()
    return F.struct(
        F.when(ok, F.coalesce(number("width"), F.lit(0))).alias("width"),
        F.when(ok, F.coalesce(number("height"), F.lit(0))).alias("height"),
        F.when(ok, number("quality")).alias("quality"),
        F.when(ok, format_of(value("format"))).alias("format"),
        error.alias("error"),
    )


def format_of(token: Column) -> Column:
    """The format of an exact token, else null; "auto" is as good as none."""
    out = F.lit(None).cast("string")
    for name, fmt in reversed(TOKENS.items()):
        out = F.when(token == name, fmt).otherwise(out)
    return out


def at_format(file: Column) -> dict[str, Column]:
    """photo.png@webp: base and token; a name without a base before the mark, or another token, stands as it is. jxl is known but refused."""
    hit = file.rlike(AT)
    token = F.when(hit, F.regexp_extract(file, AT, 2))
    return {"base": F.when(hit, F.regexp_extract(file, AT, 1)).otherwise(file), "format": format_of(token), "unavailable": F.coalesce(token == "jxl", F.lit(False))}


def negotiated(accept: Column, preferred: list[str]) -> Column:
    """The first configured format whose MIME type the header contains; weights play no part."""
    return F.coalesce(F.lit(None).cast("string"), *(F.when(F.instr(accept, MIME[f]) > 0, f) for f in preferred))


def precedence(explicit: Column, negotiated_: Column, source: Column) -> Column:
    return F.coalesce(explicit, negotiated_, source)


def valid_path(path: Column) -> Column:
    """No empty, . or .. parts, none of \\ ? #, no control characters."""
    return ~path.rlike(r"(^|/)(\.{0,2})(/|$)") & ~path.rlike(r"[\\?#\x00-\x1f\x7f]")


def encoded_path(path: Column) -> Column:
    """Percent-encoded but for the characters that a path may hold."""
    out = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for c in PCHAR_KEPT:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def decoded_length(key: Column) -> Column:
    return F.length(key) - 2 * (F.length(key) - F.length(F.replace(key, F.lit("%"), F.lit(""))))


def _pads(key: bytes) -> tuple[str, str]:
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def signature(path: Column, key: bytes, salt: bytes) -> Column:
    """base64url without padding of HMAC-SHA256(key, salt + path), in two nested digests."""
    inner, outer = _pads(key)
    said = F.concat(F.unhex(F.lit(inner)), F.lit(bytearray(salt)), path.cast("binary"))
    mac = F.unhex(F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(said, 256))), 256))
    return F.rtrim(F.translate(F.base64(mac), "+/", "-_"), F.lit("="))


def base64url(said: Column) -> Column:
    """The bytes, or null where the alphabet is another."""
    bare = F.rtrim(said, F.lit("="))
    padded = F.concat(F.translate(bare, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4)).cast("int")))
    return F.when(bare.rlike(r"^[A-Za-z0-9_-]*$") & (F.length(bare) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))


def authorised(expected: Column, given: Column, signing: bool) -> Column:
    """200, or what the signature costs: 403 without or with a wrong one while signing is on, 404 with one while it is off."""
    if signing:
        return F.when(given.isNull() | (given != expected), 403).otherwise(200)
    return F.when(given.isNotNull(), 404).otherwise(200)


def build_url(width: Column, height: Column, file: Column, quality: Column | None = None, fmt: Column | None = None, prefix: str = "/image") -> Column:
    """An options URL, options in a fixed order, the file percent-encoded."""
    parts = [F.when(width > 0, F.concat(F.lit("width="), width.cast("string"))), F.when(height > 0, F.concat(F.lit("height="), height.cast("string")))]
    if quality is not None:
        parts.append(F.when(quality.isNotNull(), F.concat(F.lit("quality="), quality.cast("string"))))
    if fmt is not None:
        parts.append(F.when(fmt.isNotNull(), F.concat(F.lit("format="), fmt)))
    return F.concat(F.lit(prefix + "/"), F.concat_ws(",", *parts), F.lit("/"), encoded_path(file))


def resolved(request: dict[str, Column], config: dict) -> dict[str, Column]:
    """Override, else configuration, in one projection."""
    c = {k: F.lit(v) for k, v in config.items()}
    quality = F.coalesce(request["quality"], c["quality"])
    avif = F.coalesce(request["quality"], c["avif_quality"])
    quantize = F.coalesce(request["png_quantize"], c["png_quantize"])
    return {
        "quality": quality,
        "webp_quality": F.coalesce(request["quality"], c["webp_quality"]),
        "avif_quality": avif,
        "avif_alpha_quality": F.coalesce(c["avif_alpha_quality"].cast("int"), avif),
        "png_quantize": quantize,
        "png_quantize_colors": F.least(F.greatest(F.coalesce(request["png_quantize_colors"], c["png_quantize_colors"]), F.lit(2)), F.lit(256)),
        "png_effort": F.coalesce(request["png_effort"], c["png_effort"].cast("string"), F.when(quantize, "balanced").otherwise("fast")),
    }


def status_of(kind: Column) -> Column:
    out = F.lit(200)
    for name, (status, _) in ERRORS.items():
        out = F.when(kind == name, status).otherwise(out)
    return out


def body_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (_, body) in ERRORS.items():
        out = F.when(kind == name, body).otherwise(out)
    return out


#: The kinds of error, their status and what the client is told.
ERRORS = {
    "SourceNotFound": (404, "image not found"),
    "SourceRejected": (400, "source key rejected by the origin"),
    "SourceTooLarge": (413, "source image too large"),
    "SourceUnreadable": (500, "source could not be read"),
    "Upstream": (502, "upstream image fetch failed"),
    "UpstreamTimeout": (504, "upstream image fetch timed out"),
    "Undecodable": (422, "image could not be decoded"),
    "Internal": (500, "internal image-processing error"),
}


def upstream_kind(status: Column, gcs: bool = False) -> Column:
    """The kind of error that an origin's status stands for, null for success."""
    out = F.when((status >= 200) & (status < 300), F.lit(None).cast("string"))
    if gcs:
        out = out.when(status.isin(401, 403), "SourceUnreadable")
    return out.when(status == 404, "SourceNotFound").when(status.isin(400, 414), "SourceRejected").otherwise("Upstream")


def sniffed(content: Column) -> Column:
    """The format by the first bytes, null if none or fewer than 12."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(F.length(content) < 12, F.lit(None).cast("string")).when(head.startswith("FFD8"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(
        head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp"
    ).when((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("61766966", "61766973"), "avif")
