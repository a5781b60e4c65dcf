"""Files: extensions, kinds, reasons to skip, output names, encodings, keys, status codes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each extension is.
MODERN = ("docx", "xlsx", "pptx", "pdf", "html", "htm", "csv", "json", "xml", "rss", "atom", "ipynb", "txt", "srt", "vtt", "png", "jpg", "jpeg", "tif", "tiff", "zip")
PLAIN = ("md", "markdown")
LEGACY = {"doc": "docx", "xls": "xlsx", "ppt": "pptx"}
NO_BACKEND_IMAGES = ("gif", "bmp", "webp")
MACRO_HINTS = {"docm": "save as docx without macros", "xlsm": "save as xlsx without macros", "pptm": "save as pptx without macros", "epub": "convert to pdf or html first"}
ARTIFACTS = (".state.json", ".progress.json", ".probe.json")
#: Status codes, append-only.
STATUS = ("E_FILE_NOT_FOUND", "E_UNSUPPORTED_FORMAT", "E_MARKITDOWN", "E_ANYTOMD", "E_LEGACY_CONVERT", "E_OCR_DEPS", "E_OCR_RUN", "E_OCR_EMPTY", "E_OCR_TIMEOUT", "E_VISION_PLAN", "E_FOREGROUND_LIMIT", "E_ASSEMBLE", "E_OUTPUT", "E_ENCRYPTED", "E_UNKNOWN")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)\z", 1))


def kind(path: Column, has_text: Column | None = None) -> Column:
    """legacy, scanned (a PDF known to have no text), modern or unsupported."""
    e = extension(path)
    out = F.when(e.isin(*LEGACY), "legacy")
    if has_text is not None:
        out = out.when((e == "pdf") & ~has_text, "scanned")
    return out.when(e.isin(*MODERN, *PLAIN), "modern").otherwise("unsupported")


def target_extension(path: Column) -> Column:
    e = extension(path)
    out = F.lit(None).cast("string")
    for old, new in LEGACY.items():
        out = F.when(e == old, new).otherwise(out)
    return out


def hint(path: Column) -> Column:
    """What to do about a file that no reader takes."""
    e = extension(path)
    out = F.when(kind(path) != "unsupported", None).when(e.isin(*NO_BACKEND_IMAGES), "convert to png or jpg first")
    for x, text in MACRO_HINTS.items():
        out = out.when(e == x, text)
    return out.otherwise("unsupported format")


def convertible(path: Column) -> Column:
    return extension(path).isin(*MODERN, *PLAIN, *LEGACY)


def skip_reason(path: Column) -> Column:
    """Why a file of a folder is left out; null: it is taken. Hidden files have a reason of their own."""
    name, e = base_name(path), extension(path)
    artifact = F.lit(False)
    for a in ARTIFACTS:
        artifact |= name.endswith(a)
    return F.when(name.startswith("."), "hidden").when(artifact, "artifact").when(e == "", "no extension").when(e.isin(*PLAIN), "markdown already").when(~convertible(path), F.concat(F.lit("unsupported extension ."), e))


def backends(platform: Column) -> Column:
    """Programs that can bring a legacy file up to date, in the order in which they are tried."""
    return F.when(F.lower(platform).isin("win32", "windows"), F.array(F.lit("wps"), F.lit("office"))).otherwise(F.array(F.lit("libreoffice")))


def output_path(path: Column, folder: str = "out") -> Column:
    return F.concat(F.lit(folder + "/"), F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*\z", ""), F.lit(".md"))


def state_key(version: str, scale: Column, path: Column, size: Column, mtime: Column) -> Column:
    """version | scale | 16 digits of a hash of path, size and modification time."""
    return F.concat_ws("|", F.lit(version), scale.cast("string"), F.left(F.sha1(F.concat_ws("|", path, size.cast("string"), mtime.cast("string"))), F.lit(16)))


def status_of(message: Column) -> Column:
    """The code that an error message starts with, encrypted files by what their readers say, otherwise unknown."""
    code = F.regexp_extract(message, r"\b(E_[A-Z_]+)\b", 1)
    return F.when(message.isNull(), None).when(code.isin(*STATUS), code).when(F.lower(message).rlike("encrypt|password"), "E_ENCRYPTED").otherwise("E_UNKNOWN")


def encoding(content: Column) -> Column:
    """By mark, then by validity."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head.startswith("EFBBBF"), "utf-8-sig").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be").when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("gb18030")


def gb18030(content: Column) -> Column:
    """Python decodes what the JVM does not by default; only rows that are no UTF-8 get here."""

    @F.arrow_udf("string")
    def decoded(x: pa.Array) -> pa.Array:
        def one(b):
            try:
                return b.decode("gb18030")
            except UnicodeDecodeError:
                return b.decode("utf-8", "replace")

        return pa.array([None if b is None else one(b) for b in x.to_pylist()], pa.string())

    return decoded(content)


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height from a PNG's header; null for other content."""
    is_png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    at = lambda i: F.when(is_png, F.conv(F.hex(F.substring(content, i, 4)), 16, 10).cast("long"))
    return at(17), at(21)
