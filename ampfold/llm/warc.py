"""WARC derivatives: linked metadata and plain-text conversion records of response records."""

from __future__ import annotations

import codecs
import json
import zlib
from collections.abc import Sequence
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CRLF = "\r\n"

# Fixed values of the formats: the base32 alphabet, and the references that pages are full of.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
COMMON_ENTITIES = ("nbsp", "lt", "gt", "quot", "apos", "copy", "reg", "middot", "mdash", "ndash", "hellip", "lsquo", "rsquo", "ldquo", "rdquo",
                   "laquo", "raquo", "euro", "amp")
#: All named character references of the HTML standard that end in a semicolon, without it.
ENTITIES = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}

# Fixed values of the encoding standard: labels that browsers read by a larger set than the name says.
READ_AS = {
    "ascii": "cp1252", "iso8859-1": "cp1252", "iso8859-9": "cp1254", "iso8859-11": "cp874", "tis-620": "cp874", "gb2312": "gb18030", "gbk": "gb18030",
    "shift_jis": "cp932", "euc_kr": "cp949", "big5": "big5hkscs",
}
#: Codecs of Python that are no charset of web pages.
NO_CHARSETS = {"idna", "punycode", "unicode_escape", "raw-unicode-escape", "undefined", "utf-7"}
#: Inflated payloads beyond this have no conversion (a value of a table cannot hold twice as much).
INFLATED_BYTES = 1 << 30

# What is left out, what breaks a line, and all other tags.
HIDDEN = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|noscript\b.*?</noscript\s*>|template\b.*?</template\s*>)"
BREAKS = (
    r"(?i)</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|nav|header|footer|main|aside|form|title|head|body|html|"
    r"blockquote|pre|hr)\b[^>]*>"
)
TAGS = r"<[a-zA-Z/!?][^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
# The href of an anchor, after at most 64 other attributes with values, in quotes of either kind or in none.
VALUE = r"(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)"
LINK = rf"(?i)<a(?:\s[^\"'>=]*=\s*{VALUE}){{0,64}}?\s(?:[^\"'>=]*?\s)?href\s*=\s*({VALUE})"
NAME = r"^[a-zA-Z][a-zA-Z0-9]{1,31}$"
CHARSET = r"(?i)charset\s*=\s*[\"']?([^\s;\"',/>]+)"
META_CHARSET = rf"(?is)<meta\s[^>]*?{CHARSET[4:]}"
NUMERIC = r"^#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7})$"
# Runs of blanks that are not one space, and line ends with the blanks and line ends about them.
BLANKS = r" [ \t\r\f\x{a0}]+|[\t\r\f\x{a0}][ \t\r\f\x{a0}]*"
LINE_ENDS = r" ?\n[ \n]*"


def sha1_base32(data: Column) -> Column:
    """``sha1:`` and the base32 digest, as WARC files label it."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*groups), BASE32_DIGITS, BASE32))


def uuid_of(*parts: Column) -> Column:
    """A record identifier that depends on the parts alone."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def unescaped(text: Column) -> Column:
    """Character references resolved, each once, from the left: the standard's named ones, and numeric ones (none
    of the character set: U+FFFD). What is no known reference, or has no semicolon, stays as it is."""
    def table(names: Sequence[str]) -> Column:
        return F.from_json(F.lit(json.dumps({name: ENTITIES[name] for name in names})), "map<string,string>")

    common, standard = table(COMMON_ENTITIES), table(sorted(ENTITIES))  # a map is searched from its start

    def resolved(part: Column, i: Column) -> Column:  # what follows an ampersand
        name = F.substring_index(part, ";", 1)
        digits = F.substring(name, F.lit(2), F.length(name))
        hexadecimal = F.conv(F.substring(digits, F.lit(2), F.length(digits)), 16, 10)
        number = F.when(F.lower(digits).startswith("x"), hexadecimal).otherwise(digits).cast("long")
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")
        known = F.coalesce(F.try_element_at(common, name), F.when(name.rlike(NAME), F.try_element_at(standard, name)))
        value = F.when(name.rlike(NUMERIC), numeric).otherwise(known)
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        return F.when(i == 0, part).when(part.contains(";") & value.isNotNull(), F.concat(value, rest)).otherwise(F.concat(F.lit("&"), part))

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&"), resolved), "")).otherwise(text)


def tidy(text: Column) -> Column:
    """Runs of blanks as one space, blank lines left out, nothing at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, BLANKS, " "), LINE_ENDS, "\n"), F.lit(" \n"))


def visible(html: Column) -> Column:
    """A page without scripts, styles, templates and comments."""
    return F.regexp_replace(html, HIDDEN, "")


def plain_text(html: Column) -> Column:
    """The text of a :func:`visible` page: without tags; block elements begin new lines."""
    return tidy(unescaped(F.regexp_replace(F.regexp_replace(html, BREAKS, "\n"), TAGS, "")))


def links(html: Column) -> Column:
    """The targets of the anchors of a :func:`visible` page, in their order, without the quotes, references and
    line ends that they are written with."""
    bare = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    return F.transform(bare, lambda v: F.trim(F.translate(unescaped(v), "\t\r\n", "")))


def _dechunked(data: bytes) -> bytes:
    """The payload of a chunked body; one that is not chunked as it says is taken as it is."""
    parts, at = [], 0
    while (end := data.find(b"\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return data
        if size <= 0:
            return b"".join(parts)
        parts.append(data[end + 1 : end + 1 + size])
        at = end + 1 + size
        at += 2 if data[at : at + 2] == b"\r\n" else 1
    return b"".join(parts) if parts else data


def _inflated(data: bytes, coding: str) -> bytes | None:
    """The payload behind one content coding; None if it is another, damaged or too large."""
    if coding in ("", "identity"):
        return data
    if coding not in ("gzip", "x-gzip", "deflate"):
        return None
    bits = zlib.MAX_WBITS | 32  # gzip or zlib, by the head
    if coding == "deflate" and (len(data) < 2 or data[0] & 15 != 8 or (data[0] << 8 | data[1]) % 31):
        bits = -zlib.MAX_WBITS  # bare deflate
    parts, size = [], 0
    try:
        while data:
            stream = zlib.decompressobj(bits)
            parts.append(stream.decompress(data, INFLATED_BYTES - size + 1))
            size += len(parts[-1])
            if size > INFLATED_BYTES or not stream.eof:
                return None
            data = stream.unused_data.lstrip(b"\0")  # the next member, after padding
    except zlib.error:
        return None
    return b"".join(parts)


def _decoded(data: bytes, charset: str) -> str:
    try:
        name = codecs.lookup(charset).name
        if codecs.lookup(name)._is_text_encoding and name not in NO_CHARSETS and name != "utf-8":
            return data.decode(READ_AS.get(name, name), "replace")
    except (LookupError, ValueError):  # no such charset: as if none were named
        pass
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def payload_text(data: bytes, charset: str, codings: str, chunked: bool) -> str | None:
    """The text of a payload by its HTTP headers; None if a coding cannot be undone."""
    whole: bytes | None = _dechunked(data) if chunked else data
    for coding in reversed([c.strip() for c in codings.split(",")]):
        whole = None if whole is None else _inflated(whole, coding)
    return None if whole is None else _decoded(whole, charset)


@F.pandas_udf(StringType())
def _payload_texts(data: pd.Series, charset: pd.Series, codings: pd.Series, chunked: pd.Series) -> pd.Series:
    rows = zip(data, charset, codings, chunked, strict=True)
    return pd.Series([None if d is None else payload_text(bytes(d), *how) for d, *how in rows], dtype=object)


def _parsed(responses: DataFrame) -> DataFrame:
    """The HTTP head, payload and text of each block. Payloads in UTF-8 (or in no named charset) and without codings
    stay in the JVM; the others alone are handed to Python."""
    whole = F.coalesce(F.col("block"), F.lit(b""))
    bare, mixed = (F.substring_index(whole.cast("string"), gap, 1) for gap in ("\n\n", "\n\r\n"))  # the latter is that of CRLF too
    early = F.octet_length(bare) < F.octet_length(mixed)
    rows = responses.withColumns({"_upto": F.when(early, bare).otherwise(mixed), "_gap": F.when(early, 2).otherwise(3)})
    rows = rows.withColumn("_payload", F.substring(whole, F.octet_length("_upto") + F.col("_gap") + 1, F.octet_length(whole)))
    rows = rows.withColumn("_head", F.regexp_replace(F.rtrim("_upto", F.lit("\r")), "\r?\n[ \t]+", " "))  # folded lines
    rows = rows.withColumn("_lines", F.filter(F.split("_head", "\r?\n"), lambda line: line != ""))
    rows = rows.withColumn("_headers", F.when(F.size("_lines") > 1, F.slice("_lines", 2, F.size("_lines"))).otherwise(F.array().cast("array<string>")))

    def header(name: str) -> Column:
        values = F.transform("_headers", lambda line: F.regexp_extract(line, rf"(?is)^{name}\s*:\s*(.*?)\s*$", 1))
        return F.coalesce(F.lower(F.get(F.filter(values, lambda v: v != ""), F.lit(0))), F.lit(""))

    rows = rows.withColumns({"_kind": header("content-type"), "_codings": header("content-encoding"),
                             "_chunked": header("transfer-encoding").contains("chunked")})
    utf8 = F.is_valid_utf8(F.col("_payload").cast("string"))
    named = F.regexp_extract("_kind", CHARSET, 1)
    meta = F.regexp_extract(F.decode(F.substring("_payload", 1, 1024), "ISO-8859-1"), META_CHARSET, 1)  # where the standard looks
    rows = rows.withColumn("_charset", F.when((named == "") & F.col("_kind").contains("html") & ~utf8, F.lower(meta)).otherwise(named))
    worded = F.col("_kind").contains("html") | F.col("_kind").startswith("text/")
    coded = ~F.col("_codings").isin("", "identity") | F.col("_chunked") | ~F.col("_charset").isin("", "utf-8", "utf8")
    rows = rows.withColumn("_coded", worded & coded)
    elsewhere = _payload_texts(F.when(F.col("_coded"), F.col("_payload")), "_charset", "_codings", "_chunked")
    here = F.when(utf8, F.col("_payload").cast("string")).otherwise(F.decode("_payload", "ISO-8859-1"))
    return rows.withColumn("_elsewhere", elsewhere).withColumn("_html", F.when(F.col("_coded"), F.col("_elsewhere")).otherwise(here))


def derivatives(responses: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The derived records of response records (``record_id``, ``target_uri``, ``date``, ``refers_to``, ``block``).

    Each response gives a ``metadata`` record (application/warc-fields: its status, HTTP headers, digests,
    lengths, its own refers-to, title, links, and the conversion's identifier) and, if it is text, a
    ``conversion`` record (text/plain). Both refer to the response by ``refers_to`` and keep its URI, date,
    ``source_headers`` and digests; identifiers depend on the response's alone, so a task that runs again
    makes the same records. Columns: those of ``keep``, ``warc_type``, ``record_id``, ``refers_to``,
    ``target_uri``, ``date``, ``content_type``, ``content_length``, ``block_digest``, ``source_headers``,
    ``source_block_digest``, ``source_payload_digest``, ``block``. A map over the rows, without a shuffle.

    Defined cases: a null or empty block is a response without headers and payload, with metadata only; a head ends
    at the first blank line, of CRLF or bare line feeds, and folded header lines are joined; text is read by the
    charset of Content-Type, else as UTF-8, else by the page's ``meta`` element, else as ISO-8859-1 (unknown charsets
    are as none, and so is one that says UTF-8 and is not); chunks are joined, gzip and deflate undone (the digests
    are those of the payload as stored); payloads in another coding, damaged, or of more than ``INFLATED_BYTES``
    have metadata only; a tag ends at its first ``>``, but for the anchors whose links are read; a block is taken
    whole at any length; repeated responses give repeated records; a null URI or date stays null; other columns
    are dropped.
    """
    rows = _parsed(responses.select(*keep, "record_id", "target_uri", "date", "refers_to", "block"))
    html = F.col("_kind").contains("html")
    rows = rows.withColumn("_visible", F.when(html, visible(F.col("_html"))))
    rows = rows.withColumn("_text", F.when(html, plain_text(F.col("_visible"))).when(F.col("_kind").startswith("text/"), F.col("_html")))
    own = F.coalesce("record_id", F.lit(""))
    rows = rows.withColumns({
        "_block_digest": sha1_base32(F.coalesce("block", F.lit(b""))),
        "_payload_digest": sha1_base32(F.col("_payload")),
        "_conversion_id": F.when(F.col("_text").isNotNull(), uuid_of(F.lit("conversion"), own)),
        "_title": F.when(html, F.translate(tidy(unescaped(F.regexp_extract("_visible", TITLE, 1))), "\n", " ")),
        "_links": F.when(html, links(F.col("_visible"))),
    })

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))  # null: no line

    def lines(name: str, values: str) -> Column:
        return F.array_join(F.transform(values, lambda v: line(name, v)), "")

    status = F.nullif(F.regexp_extract("_head", r"^HTTP/[0-9.]+ ([0-9]{3})", 1), F.lit(""))
    fields = F.concat_ws(
        "", line("http-status", status), lines("source-header", "_headers"),
        line("source-content-length", F.octet_length(F.coalesce("block", F.lit(b""))).cast("string")),
        line("source-block-digest", F.col("_block_digest")), line("source-payload-digest", F.col("_payload_digest")),
        line("source-refers-to", F.col("refers_to")), line("conversion", F.col("_conversion_id")),
        line("title", F.nullif(F.col("_title"), F.lit(""))), lines("outlink", "_links"),
    )

    def record(kind: str, identifier: Column, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("warc_type"), identifier.alias("record_id"), F.lit(content_type).alias("content_type"), block.alias("block"))

    metadata = record("metadata", uuid_of(F.lit("metadata"), own), "application/warc-fields", fields)
    conversion = record("conversion", F.col("_conversion_id"), "text/plain; charset=UTF-8", F.col("_text"))
    both = F.when(F.col("_text").isNotNull(), F.array(metadata, conversion)).otherwise(F.array(metadata))
    made = rows.select(*keep, F.col("record_id").alias("_source"), "target_uri", "date", "_headers", "_block_digest", "_payload_digest",
                       F.explode(both).alias("_r"))
    data = F.col("_r.block").cast("binary")
    return made.select(
        *keep, "_r.warc_type", "_r.record_id", F.col("_source").alias("refers_to"), "target_uri", "date", "_r.content_type",
        F.octet_length(data).cast("long").alias("content_length"), sha1_base32(data).alias("block_digest"),
        F.col("_headers").alias("source_headers"), F.col("_block_digest").alias("source_block_digest"),
        F.col("_payload_digest").alias("source_payload_digest"), "_r.block",
    )


def page_responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of fetched pages: what a crawler would have stored of them (null html: an empty page)."""
    html = F.coalesce(html_col, F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(html).cast("string"), F.lit(CRLF * 2),
    )
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, url_col)]
    return pages.select(
        id_col, uuid_of(F.lit("response"), *key).alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"),
        F.lit(None).cast("string").alias("refers_to"), F.concat(head, html).cast("binary").alias("block"),
    )


def warc_text(records: DataFrame) -> DataFrame:
    """Each derived record as the text of a WARC/1.1 record, without the two line ends that follow it. The headers and
    digests of its source stand in ``WARC-Source-...`` fields, so that the file alone preserves them."""
    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))

    names = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
             ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Block-Digest", "source_block_digest"),
             ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    fields = [field(name, F.col(c)) for name, c in names]
    headers = F.array_join(F.transform("source_headers", lambda h: field("WARC-Source-Header", h)), "")
    return records.select(F.concat_ws("", F.lit(f"WARC/1.1{CRLF}"), *fields, headers, F.lit(CRLF), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """One gzip WARC file per partition."""
    warc_text(records).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
