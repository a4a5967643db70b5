"""Column functions on texts: lines, trimming, byte spans."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def trim_unicode(text: Column) -> Column:
    """Trim Unicode white space at both ends (SQL ``trim`` alone takes off spaces only)."""
    return F.trim(text, F.lit(WHITE_SPACE))


def split_lines(code: Column) -> Column:
    r"""Array of lines, cut at ``\n`` and ``\r\n``.

    A final line end opens no further line; a lone ``\r`` stays in its line. The empty
    text still gives one empty line here, so callers leave empty texts out.
    """
    size = F.char_length(code)
    body = (
        F.when(F.endswith(code, F.lit("\r\n")), F.left(code, size - 2))
        .when(F.endswith(code, F.lit("\n")), F.left(code, size - 1))
        .otherwise(code)
    )
    return F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def span_start(src: Column) -> Column:
    """Byte offset of a ``start:length:file`` span; null if either number is malformed."""
    return F.when(_is_span(src), F.split_part(src, F.lit(":"), F.lit(1)).try_cast("bigint"))


def span_length(src: Column) -> Column:
    """Byte length of a ``start:length:file`` span; null if either number is malformed."""
    return F.when(_is_span(src), F.split_part(src, F.lit(":"), F.lit(2)).try_cast("bigint"))


def _is_span(src: Column) -> Column:
    return src.rlike(r"^\+?[0-9]+:\+?[0-9]+(:|\z)")


def line_of_offset(code: Column, offset: Column) -> Column:
    """1-based line of a byte offset: one more than the line ends in the bytes before it."""
    before = _bytes(code, F.lit(0), offset).cast("string")
    breaks = F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n")))
    return (breaks + 1).cast("bigint")


def snippet_of_span(code: Column, offset: Column, length: Column) -> Column:
    """Trimmed text of a byte span, cut at the end of the text.

    A character cut in half becomes U+FFFD; a span that starts past the end gives ''.
    """
    piece = F.make_valid_utf8(_bytes(code, offset, length).cast("string"))
    return F.when(offset < F.octet_length(code), trim_unicode(piece)).otherwise(F.lit(""))


def _bytes(code: Column, offset: Column, length: Column) -> Column:
    # substring takes INT positions; a text holds less than 2^31 bytes, so larger
    # numbers are as good as its end.
    size = F.octet_length(code).cast("bigint")
    start = F.least(offset, size).cast("int")
    count = F.least(length, size).cast("int")
    return F.substring(code.cast("binary"), start + 1, count)


def has_extension(path: Column, extensions: list[str], any_case: bool) -> Column:
    """True if the file name ends in one of the extensions; a bare ``.ext`` name has none."""
    flag = "(?i)" if any_case else ""
    pattern = rf"{flag}[^/]\.({'|'.join(extensions)})\z"
    return F.coalesce(path.rlike(pattern), F.lit(False))


def is_json(path: Column) -> Column:
    """True for a path ending in ``.json`` in any letter case; false for no path."""
    return F.coalesce(path.rlike(r"(?i)\.json\z"), F.lit(False))


def display_name(path: Column) -> Column:
    return F.coalesce(path, F.lit("stdin"))


def clean_path(path: Column) -> Column:
    """Path text in one form: no ``file:`` scheme, no ``//`` and no ``/./`` inside."""
    local = F.regexp_replace(path, "^file:/+", "/")
    return F.regexp_replace(local, r"(?<=[^:/]|^)/(\.?/)+", "/")
