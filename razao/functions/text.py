"""Text columns: cp1252 decoding, line cleanup, whitespace fields, blank-line
squeeze, tag / link extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# cp1252 assigns glyphs to 27 of the bytes 0x80-0x9F that ISO-8859-1 maps to
# C1 controls; the table is derived from Python's codec, not typed in.
def _cp1252_maps() -> tuple[str, str, str]:
    src, dst, undefined = [], [], []
    for b in range(0x80, 0xA0):
        try:
            glyph = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            undefined.append(chr(b))
            continue
        src.append(chr(b))
        dst.append(glyph)
    return "".join(src), "".join(dst), "".join(undefined)


LATIN1_C1, CP1252_GLYPHS, CP1252_UNDEFINED = _cp1252_maps()


def decode_cp1252(content: Column | str, fallback_whole_text: bool = True) -> Column:
    """Decode cp1252 bytes without the JVM's windows-1252 charset.

    Bytes are decoded as ISO-8859-1 (total, never fails), then the C1
    characters that cp1252 defines are translated to their glyphs.  When
    the text holds a byte cp1252 leaves undefined, the reference falls back
    to Latin-1 for the whole file; with ``fallback_whole_text`` the same
    happens here (no translation for that text).
    """
    c = F.col(content) if isinstance(content, str) else content
    latin = F.decode(c, "ISO-8859-1")
    fixed = F.translate(latin, LATIN1_C1, CP1252_GLYPHS)
    if not fallback_whole_text:
        return fixed
    has_undefined = F.regexp_like(latin, F.lit("[" + "".join(f"\\x{{{ord(ch):02X}}}" for ch in CP1252_UNDEFINED) + "]"))
    return F.when(has_undefined, latin).otherwise(fixed)


def fix_latin1_c1(col: Column | str) -> Column:
    """Translate C1 controls of a Latin-1 decoded string to cp1252 glyphs
    (for CSV read with ``encoding=ISO-8859-1``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.translate(c, LATIN1_C1, CP1252_GLYPHS)


def clean_line(col: Column | str) -> Column:
    """No-break space -> space, newline / carriage return removed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.translate(c, "\u00a0", " "), "[\r\n]", "")


def is_blank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(c, r"\s", " ")) == ""


def fields(col: Column | str) -> Column:
    """Whitespace-separated fields of a trimmed line (runs collapse)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")


def squeeze_blank_lines(col: Column | str) -> Column:
    """Runs of blank lines become one (the first of the run is kept).

    Lines end with ``\n`` only; what follows the last one is not a line yet
    and always stays.  The line array is filtered, so a run may be of any
    length.
    """
    c = F.col(col) if isinstance(col, str) else col
    lines = F.split(c, "\n", -1)
    body = F.slice(lines, 1, F.size(lines) - 1)
    blank = F.transform(body, lambda x: strip_ws(x) == "")
    # zipped, so that no array is looked up (and computed) once per element
    pairs = F.arrays_zip(body.alias("line"), blank.alias("here"), F.concat(F.array(F.lit(False)), blank).alias("before"))
    kept = F.filter(pairs, lambda z: z["line"].isNotNull() & ~(z["here"] & z["before"]))
    return F.array_join(F.concat(F.transform(kept, lambda z: z["line"]), F.array(F.element_at(lines, -1))), "\n")


def hashtags(col: Column | str) -> Column:
    """All ``#word`` tags (Unicode word characters); NULL when none."""
    c = F.col(col) if isinstance(col, str) else col
    # letters, digits and underscore of any script (Python's \w)
    found = F.regexp_extract_all(c, F.lit(r"#[\p{L}\p{N}_]+"), 0)
    return F.when(F.size(found) > 0, found)


def wiki_links(col: Column | str) -> Column:
    """All ``[[...]]`` links (shortest match); NULL when none."""
    c = F.col(col) if isinstance(col, str) else col
    found = F.regexp_extract_all(c, F.lit(r"\[\[.*?\]\]"), 0)
    return F.when(F.size(found) > 0, found)


# Python's str.strip() whitespace, as a class both Java and RE2 regexes read.
WS_CLASS = ("[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
            "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")
INLINE_WS_CLASS = WS_CLASS.replace("\\n", "")


# The same characters as a plain set for ``trim(str, chars)``.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(col: Column | str) -> Column:
    """Strip leading / trailing whitespace as Python's ``str.strip`` does
    (Spark's one-argument ``trim`` removes spaces only)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c, F.lit(WS_CHARS))
