"""Queries of the scalar text, path and page rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import paths, text
from .base import registry

QUERIES: dict = {}
query = registry(QUERIES)
long = lambda c: c.cast("long")

_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(rf"SELECT doc_id, md5(regexp_replace(text, '{_WS}+', '', 'g')) AS norm_md5, length(regexp_replace(text, '{_WS}+', '', 'g'))::BIGINT AS norm_length FROM documents", "documents")
def norm_text(documents):
    n = text.without_space(F.col("text"))
    return documents.select("doc_id", F.md5(n).alias("norm_md5"), long(F.length(n)).alias("norm_length"))


@query(
    rf"""SELECT doc_id, page_no, length(regexp_replace(regexp_replace(block, '(?s)<!--.*?-->', '', 'g'), '{_WS}+', '', 'g'))::BIGINT AS visible_chars
FROM (SELECT *, concat('<!--PAGE:', page_no, '-->', chr(10), body, ' <!-- seal --> ', '<!--/PAGE:', page_no, '-->') AS block FROM doc_pages)""",
    "doc_pages",
)
def visible_length(pages):
    block = F.concat(F.lit("<!--PAGE:"), F.col("page_no").cast("string"), F.lit("-->\n"), F.col("body"), F.lit(" <!-- seal --> "), F.lit("<!--/PAGE:"), F.col("page_no").cast("string"), F.lit("-->"))
    return pages.select("doc_id", "page_no", long(text.visible_length(block)).alias("visible_chars"))


@query(
    r"""SELECT doc_id, least(len(regexp_extract_all(text, '\x{FFFD}+')), 50)::BIGINT AS replacement, least(len(regexp_extract_all(text, '锟斤拷|烫烫烫|屯屯屯')), 50)::BIGINT AS classic,
  least(len(regexp_extract_all(text, '[\x{C0}-\x{FF}][\x{80}-\x{BF}]{2,}')), 50)::BIGINT AS high_bytes, least(len(regexp_extract_all(text, '[\x{C0}-\x{FF}]{4,}')), 50)::BIGINT AS accents
FROM documents""",
    "documents",
)
def mojibake_scan(documents):
    return documents.select("doc_id", *[long(c).alias(k) for k, c in text.mojibake(F.col("text")).items()])


@query(None, "documents")
def mojibake_samples(documents):
    return documents.select("doc_id", text.mojibake_sample(F.col("text")).alias("sample")).filter("sample is not null")


@query(
    "SELECT event_id, len(regexp_extract_all(s, '[0-9] [0-9](?: [0-9])*'))::BIGINT AS runs FROM (SELECT event_id, concat('a ', substr(event_id::VARCHAR, 1, 1), ' ', user_id, ' b ', user_id % 10, ' 4 9') AS s FROM events)",
    "events",
)
def torn_digits(events):
    s = F.concat(F.lit("a "), F.substring(F.col("event_id").cast("string"), 1, 1), F.lit(" "), F.col("user_id").cast("string"), F.lit(" b "), (F.col("user_id") % 10).cast("string"), F.lit(" 4 9"))
    return events.select("event_id", long(text.torn_digits(s)).alias("runs"))


@query(
    r"""SELECT page_id, CASE WHEN contains(tail, '.') THEN tail ELSE '' END AS tail, regexp_matches(url, '^(?i:https?://|mailto:)') AS is_link
FROM (SELECT page_id, url, regexp_extract(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS tail FROM pages)""",
    "pages",
)
def url_tail(pages):
    return pages.select("page_id", text.url_tail(F.col("url")).alias("tail"), text.is_link(F.col("url")).alias("is_link"))


@query(
    """SELECT doc_id, page_no, concat('<!--PAGE:', CASE WHEN page_no < 10 THEN '0' ELSE '' END, page_no, '-->', chr(10), chr(10), CASE WHEN b = '' THEN '' ELSE concat(b, chr(10), chr(10)) END, '<!--/PAGE:', CASE WHEN page_no < 10 THEN '0' ELSE '' END, page_no, '-->') AS block
FROM (SELECT doc_id, CASE WHEN page_no = 3 THEN 103 ELSE page_no END AS page_no, trim(CASE WHEN page_no = 2 THEN ' ' ELSE body END, ' ' || chr(9) || chr(10) || chr(13)) AS b FROM doc_pages)""",
    "doc_pages",
)
def page_anchor_wrap(pages):
    no = F.when(F.col("page_no") == 3, 103).otherwise(F.col("page_no"))
    return pages.select("doc_id", no.alias("page_no"), P.anchored(no, F.when(F.col("page_no") == 2, " ").otherwise(F.col("body"))).alias("block"))


@query(
    """SELECT doc_id, page_no, concat('<!--PAGE:', n, '-->', chr(10), chr(10), '<!-- page ', page_no, ' failed: ', left(replace(e, '--', ''), 120), ' -->', chr(10), chr(10), '<!--/PAGE:', n, '-->') AS block
FROM (SELECT doc_id, page_no, CASE WHEN page_no < 10 THEN '0' ELSE '' END || page_no AS n, concat('bad --> image ', repeat('x', (doc_id % 200)::INT)) AS e FROM ocr_events WHERE status = 'failed')""",
    "ocr_events",
)
def failed_page(events):
    error = F.concat(F.lit("bad --> image "), F.expr("repeat('x', cast(doc_id % 200 as int))"))
    return events.filter("status = 'failed'").select("doc_id", "page_no", P.failed_block(F.col("page_no"), error).alias("block"))


_SPECS = """CASE user_id % 8 WHEN 0 THEN concat(a, '-', a + 3, ',', a + 1) WHEN 1 THEN concat(a, ', ,', a) WHEN 2 THEN concat(a + 2, '-', a) WHEN 3 THEN '0-3' WHEN 4 THEN 'x1' WHEN 5 THEN ' , ' WHEN 6 THEN '' ELSE concat(a, ' - ', a + 40) END"""


@query(
    f"""WITH specs AS (SELECT event_id, {_SPECS} AS spec FROM (SELECT *, 1 + event_id % 30 AS a FROM events)),
parts AS (SELECT event_id, spec, list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM specs),
judged AS (SELECT *, CASE WHEN trim(spec) = '' THEN NULL WHEN len(list_filter(p, lambda x: NOT regexp_matches(x, '^[0-9]+(\\s*-\\s*[0-9]+)?$'))) > 0 THEN 'not understood' WHEN len(p) = 0 THEN 'empty'
  WHEN len(list_filter(p, lambda x: regexp_extract(x, '^[0-9]+')::BIGINT < 1)) > 0 THEN 'pages start at 1' WHEN len(list_filter(p, lambda x: regexp_extract(x, '^[0-9]+')::BIGINT > regexp_extract(x, '[0-9]+$')::BIGINT)) > 0 THEN 'range upside down'
  WHEN len(list_filter(p, lambda x: regexp_extract(x, '[0-9]+$')::BIGINT > 50)) > 0 THEN 'beyond the last page' END AS error FROM parts)
SELECT event_id, spec, error, CASE WHEN error IS NULL AND trim(spec) <> '' THEN array_to_string(list_sort(list_distinct(flatten(list_transform(p, lambda x: range(regexp_extract(x, '^[0-9]+')::BIGINT, regexp_extract(x, '[0-9]+$')::BIGINT + 1))))), ',') END AS pages FROM judged""".replace("\\\\s", "\\s"),
    "events",
)
def page_spec_parse(events):
    specs = events.withColumn("a", 1 + F.col("event_id") % 30).selectExpr("event_id", f"{_SPECS} as spec")
    total = F.lit(50)
    return specs.select("event_id", "spec", P.spec_error(F.col("spec"), total).alias("error"), F.array_join(P.spec_pages(F.col("spec"), total), ",").alias("pages"))


@query(None, "events")
def page_spec_modes(events):
    """The lenient and the clamping reading of the same specifications, and whether pages are a prefix."""
    specs = events.withColumn("a", 1 + F.col("event_id") % 30).selectExpr("event_id", f"{_SPECS} as spec")
    lenient, clamp = (P.spec_pages(F.col("spec"), F.lit(20), m) for m in ("lenient", "clamp"))
    return specs.select("event_id", "spec", F.array_join(lenient, ",").alias("lenient"), F.array_join(clamp, ",").alias("clamped"), P.is_prefix(clamp).alias("prefix"))


_EXT = "CASE WHEN contains(n, '.') THEN lower(regexp_extract(n, '([^.]*)$', 1)) ELSE '' END"
_NAMED = f"(SELECT *, {_EXT} AS ext FROM (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS n FROM manifest))"
_MODERN = ", ".join(f"'{e}'" for e in paths.MODERN)


@query(
    f"""SELECT path, ext, kind, CASE ext WHEN 'doc' THEN 'docx' WHEN 'xls' THEN 'xlsx' WHEN 'ppt' THEN 'pptx' END AS target,
  CASE WHEN kind <> 'unsupported' THEN NULL WHEN ext IN ('gif', 'bmp', 'webp') THEN 'convert to png or jpg first' WHEN ext = 'docm' THEN 'save as docx without macros' WHEN ext = 'epub' THEN 'convert to pdf or html first' ELSE 'unsupported format' END AS hint, size
FROM (SELECT path, ext, size, CASE WHEN ext IN ('doc', 'xls', 'ppt') THEN 'legacy' WHEN ext = 'pdf' AND size % 3 = 0 THEN 'scanned' WHEN ext IN ({_MODERN}, 'md', 'markdown') THEN 'modern' ELSE 'unsupported' END AS kind FROM {_NAMED})""",
    "manifest",
)
def ext_classify(manifest):
    p = F.col("path")
    k = paths.kind(p, F.col("size") % 3 != 0)
    return manifest.select("path", paths.extension(p).alias("ext"), k.alias("kind"), paths.target_extension(p).alias("target"), paths.hint(p).alias("hint"), "size")


@query(
    f"""SELECT path, CASE WHEN n LIKE '.%' THEN 'hidden' WHEN ext = '' THEN 'no extension' WHEN ext = 'md' THEN 'markdown already' WHEN ext NOT IN ({_MODERN}, 'doc', 'xls', 'ppt') THEN concat('unsupported extension .', ext) END AS reason FROM {_NAMED}""",
    "manifest",
)
def skip_reason(manifest):
    return manifest.select("path", paths.skip_reason(F.col("path")).alias("reason"))


@query(
    f"SELECT path, concat('out/', CASE WHEN contains(substr(n, 2), '.') THEN substr(n, 1, length(n) - length(regexp_extract(n, '(\\.[^.]*)$', 1))) ELSE n END, '.md') AS output FROM {_NAMED}",
    "manifest",
)
def output_path(manifest):
    return manifest.select("path", paths.output_path(F.col("path")).alias("output"))


@query(
    "SELECT path, concat('v1|', 2, '|', left(sha1(concat_ws('|', path, size, 1700000000 + size)), 16)) AS state_key FROM manifest",
    "manifest",
)
def state_key(manifest):
    return manifest.select("path", paths.state_key("v1", F.lit(2), F.col("path"), F.col("size"), 1700000000 + F.col("size")).alias("state_key"))


_MESSAGES = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'E_OCR_TIMEOUT: page 3' WHEN 2 THEN 'file is Encrypted' WHEN 3 THEN 'needs a password' WHEN 4 THEN 'E_NOVEL: what' ELSE concat('broken ', user_id) END"


@query(
    f"SELECT event_id, CASE WHEN m IS NULL THEN NULL WHEN event_id % 6 = 1 THEN 'E_OCR_TIMEOUT' WHEN regexp_matches(lower(m), 'encrypt|password') THEN 'E_ENCRYPTED' ELSE 'E_UNKNOWN' END AS status FROM (SELECT event_id, {_MESSAGES} AS m FROM events)",
    "events",
)
def error_status(events):
    return events.selectExpr("event_id", f"{_MESSAGES} as m").select("event_id", paths.status_of(F.col("m")).alias("status"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'utf-8-sig' WHEN doc_id % 5 = 1 THEN 'gb18030' ELSE 'utf-8' END AS encoding, md5(text) AS text_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN '中文' ELSE text END AS text FROM documents)", "documents")
def decode_text(documents):
    """Bytes with a mark, bytes of another encoding, and plain ones, read again."""
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(F.col("doc_id") % 5 == 1, F.unhex(F.lit("D6D0CEC4"))).otherwise(F.encode("text", "UTF-8"))
    from ..sources.files import decoded

    return decoded(documents.select("doc_id", raw.alias("content"))).select("doc_id", "encoding", F.md5("text").alias("text_md5"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat('# ', role, chr(10), text, chr(10), '') WHEN turn % 3 = 1 THEN concat('# ', role, chr(10), text, chr(10), '') ELSE text END AS rendered, CASE WHEN turn % 3 = 2 THEN '' ELSE 'NOTE' END AS missing FROM conversations""",
    "conversations",
)
def template_render(conversations):
    t = F.when(F.col("turn") % 3 == 2, F.lit("{{TEXT}}")).otherwise(F.lit("# {{ROLE}}\n{{TEXT}}\n{{NOTE}}"))
    return conversations.select("conv_id", "turn", text.render(t, {"ROLE": F.col("role"), "TEXT": F.col("text")}).alias("rendered"), F.array_join(text.missing_keys(t, ["ROLE", "TEXT"]), ",").alias("missing"))


@query("SELECT box_id, w, h, CASE WHEN greatest(w, h) <= 400 THEN w ELSE greatest(1, floor(w * (400.0::DOUBLE / greatest(w, h)))::BIGINT) END AS new_w, CASE WHEN greatest(w, h) <= 400 THEN h ELSE greatest(1, floor(h * (400.0::DOUBLE / greatest(w, h)))::BIGINT) END AS new_h FROM (SELECT box_id, 5 * (x2 - x1) AS w, 5 * (y2 - y1) AS h FROM boxes)", "boxes")
def image_downscale(boxes):
    from ..operators.geometry import downscaled

    w, h = 5 * (F.col("x2") - F.col("x1")), 5 * (F.col("y2") - F.col("y1"))
    a, b = downscaled(w, h, 400)
    return boxes.select("box_id", w.alias("w"), h.alias("h"), a.alias("new_w"), b.alias("new_h"))


@query("SELECT event_id, 1 + event_id % 4000 AS width, 1 + user_id AS height FROM events", "events")
def png_size(events):
    head = F.unhex(F.lit("89504E470D0A1A0A0000000D49484452"))
    be = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    content = F.concat(head, be(1 + F.col("event_id") % 4000), be(1 + F.col("user_id")))
    w, h = paths.png_size(content)
    return events.select("event_id", w.alias("width"), h.alias("height"))


@query(
    "SELECT event_id, page_no, status FROM (SELECT seq AS event_id, page_no, status FROM ocr_events WHERE seq % 9 <> 0)",
    "ocr_events",
)
def ndjson_parse(events):
    """Lines of a page event stream; damaged ones are passed over."""
    from ..sources.ndjson import parsed

    whole = F.to_json(F.struct(F.col("seq"), F.col("page_no").alias("no"), F.lit("page").alias("event"), F.struct(F.col("status")).alias("stats")))
    lines = events.select(F.when(F.col("seq") % 9 == 0, F.substring(whole, 1, 10)).otherwise(whole).alias("line"))
    return parsed(lines).select(F.col("seq").alias("event_id"), F.col("no").alias("page_no"), F.col("stats.status").alias("status"))


@query(None, "pages")
def inline_links(pages):
    """Links of a page put into its text."""
    from ..sources.web import html_text

    found = html_text(pages)
    links = F.array(F.struct(F.lit("the").alias("anchor"), F.col("url").alias("url")), F.struct(F.lit(None).cast("string").alias("anchor"), F.concat("url", F.lit("/file.zip")).alias("url")), F.struct(F.lit("than").alias("anchor"), F.col("url").alias("url")))
    out = text.inline_links(F.col("text"), links)
    return found.select("page_id", out.alias("o")).select("page_id", "o.inlined", "o.notes", F.md5("o.body").alias("body_md5"))
