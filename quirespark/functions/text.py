"""Text functions as Column expressions: no Python on the executors.

Character classes are written by code point, because Java's ``\\s`` and ``\\p``
shorthands differ from other engines' (and from Unicode's White_Space).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space.
SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Bidirectional embeddings, overrides and isolates.
BIDI = r"\x{202A}-\x{202E}\x{2066}-\x{2069}"
#: What no format carries: C0 but TAB and LF, DEL, C1, BOM, non-characters, bidi controls.
DROPPED = rf"\x{{0}}-\x{{8}}\x{{B}}-\x{{1F}}\x{{7F}}-\x{{9F}}\x{{FEFF}}\x{{FFFE}}\x{{FFFF}}{BIDI}"
RTL = r"\p{IsHebrew}\p{IsArabic}\p{IsSyriac}\p{IsThaana}\p{IsNko}"
#: Glyphs that stand before list items, besides the private-use area.
BULLETS = "•◦▪▫■□●○‣⁃∙·–—*-❖"
#: What a filled-in check box may say.
TRUTHY = ("t", "true", "1", "yes", "y", "x", "checked", "on")
#: Recogniser language codes and their tags.
OCR_TAGS = {"eng": "en", "deu": "de", "fra": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "pol": "pl", "rus": "ru", "jpn": "ja", "kor": "ko", "chi_sim": "zh-Hans", "chi_tra": "zh-Hant", "ara": "ar", "heb": "he"}


def clean(s: Column) -> Column:
    """Invalid UTF-8 becomes U+FFFD; line and paragraph separators become LF; what no
    format carries goes. A carriage return goes too: it is no line feed."""
    return F.regexp_replace(F.regexp_replace(F.make_valid_utf8(s), r"[\x{2028}\x{2029}]", "\n"), f"[{DROPPED}]", "")


def trim_space(s: Column) -> Column:
    return F.regexp_replace(s, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def one_line(s: Column) -> Column:
    return trim_space(F.regexp_replace(clean(s), rf"[{SPACE}]+", " "))


def is_bidi_control(c: Column) -> Column:
    return c.rlike(f"^[{BIDI}]$")


def bidi_controls(s: Column) -> Column:
    return F.regexp_count(s, F.lit(f"[{BIDI}]"))


def rtl_letters(s: Column) -> Column:
    return F.regexp_count(s, F.lit(f"[{RTL}]"))


def other_letters(s: Column) -> Column:
    return F.regexp_count(F.regexp_replace(s, f"[{RTL}]", ""), F.lit(r"\p{L}"))


def direction(s: Column) -> Column:
    return F.when(rtl_letters(s) > other_letters(s), "rtl").otherwise("ltr")


def words(s: Column) -> Column:
    """Words between Unicode white space."""
    return F.regexp_extract_all(s, F.lit(rf"([^{SPACE}]+)"), 1)


LABEL = r"(?:[0-9]{1,3}|[a-z]|[ivxlcdm]{1,4})[.)]"
BULLET = rf"[{BULLETS.replace('-', '')}\x{{2D}}\x{{E000}}-\x{{F8FF}}]"


def list_marker(line: Column) -> Column:
    """The marker before an item's text, or empty: a number, a small letter or a small
    Roman numeral with a stop or bracket, or a bullet glyph."""
    return F.regexp_extract(line, rf"^({LABEL}|{BULLET})[{SPACE}]+[^{SPACE}]", 1)


def is_bullet(c: Column) -> Column:
    return c.rlike(f"^{BULLET}$")


def numbered(marker: Column) -> Column:
    return marker.rlike("^[0-9]+[.)]$")


def safe_link(u: Column) -> Column:
    """Whether a writer may write a link: http, https or mailto, and it parses: no white
    space before the scheme, no control character, no broken escape before the query."""
    scheme, control, escape = r"(?i)^(?:https?|mailto):", r"[\x{0}-\x{1F}\x{7F}]", r"(?i)^https?:[^?#]*%(?![0-9a-f]{2})"
    return F.coalesce(u.rlike(scheme) & ~u.rlike(control) & ~u.rlike(escape), F.lit(False))


def safe_href(u: Column) -> Column:
    """Whether a page's link may be kept: the same after outer white space goes."""
    return safe_link(F.regexp_replace(u, rf"^[{SPACE}]+|[{SPACE}]+$", ""))


def lang_tag(tag: Column) -> Column:
    """The tag if it has a language tag's shape, else "und": at most 35 characters; subtags
    of one to eight letters or digits, the first of two to eight letters, or i or x."""
    shape = "^(?:[A-Za-z]{2,8}|[ixIX])(?:-[A-Za-z0-9]{1,8})*$"
    return F.when(tag.rlike(shape) & (F.length(tag) <= 35), tag).otherwise(F.lit("und"))


#: Regions whose Chinese is written in traditional script.
TRADITIONAL = ("tw", "hk", "mo")


def locale_option(locale: Column, options: Column) -> Column:
    """Of a field's options (an array of tags) the one for a locale: the same tag in any
    case, else its language; of Chinese by script, else by region; else empty."""
    want = F.lower(F.replace(F.coalesce(locale, F.lit("")), F.lit("_"), F.lit("-")))
    named = lambda tag: F.get(F.filter(options, lambda o: (o != "") & (F.lower(o) == tag)), F.lit(0))
    parts = F.split(want, "-")
    script = F.when(F.array_contains(parts, "hant") | F.arrays_overlap(parts, F.array(*map(F.lit, TRADITIONAL))), "zh-hant").otherwise("zh-hans")
    return F.coalesce(named(want), named(F.when(parts[0] == "zh", script).otherwise(parts[0])), F.lit(""))


#: Types of inline pictures, and the most bytes of one and of a page.
IMAGE_TYPES, IMAGE_BYTES, PAGE_IMAGE_BYTES = ("image/png", "image/jpeg", "image/gif", "image/webp"), 8 << 20, 64 << 20


def data_image(u: Column) -> Column:
    """struct(type, bytes) of an inline base64 picture of a known type, else null. Bytes
    are those that the body may decode to, blanks included."""
    s = F.trim(u)
    head = F.lower(F.replace(F.regexp_extract(s, r"(?is)^data:([^,]*),", 1), F.lit(" "), F.lit("")))
    body = F.regexp_extract(s, r"(?is)^data:[^,]*,(.*)$", 1)
    kind = F.regexp_replace(head, ";base64$", "")
    size = (F.floor(F.length(body) / 4) * 3).cast("long")
    ok = head.endswith(";base64") & kind.isin(*IMAGE_TYPES) & (size <= IMAGE_BYTES) & F.regexp_replace(body, r"[\n\r \t]", "").rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(ok, F.struct(kind.alias("type"), size.alias("bytes")))


def ocr_tag(code: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in OCR_TAGS.items() for x in pair))
    return F.coalesce(F.element_at(known, code), F.lit(""))


def csv_safe(cell: Column) -> Column:
    """A cell that a spreadsheet would read as a formula gets an apostrophe and loses
    the white space before it; any other cell is unchanged."""
    lead = r"^[\x{9}\x{A}\x{D}\x{20}]*"
    return F.when(cell.rlike(lead + r"[=+\x{2D}@]"), F.concat(F.lit("'"), F.regexp_replace(cell, lead, ""))).otherwise(cell)


def markdown_escape(s: Column) -> Column:
    """A backslash before each of the characters that inline Markdown reads."""
    return F.regexp_replace(s, r"([\\`*_\[\]<>|~!])", r"\\$1")


def markdown_line_start(s: Column) -> Column:
    """A backslash where a line would begin a block: a heading, quote, list or rule."""
    s = F.regexp_replace(s, r"^([#>+=\x{2D}])", r"\\$1")
    return F.regexp_replace(s, r"^([0-9]+)([.)])", r"$1\\$2")


def markdown_cell(s: Column) -> Column:
    """A cell of a table, as literal text on one line."""
    return F.trim(markdown_escape(F.translate(s, "\n\r\t", "   ")))


#: What a Markdown link target may not hold, and its escapes.
ENCODED = {" ": "%20", "(": "%28", ")": "%29", "<": "%3C", ">": "%3E", '"': "%22", "'": "%27", "\\": "%5C", "`": "%60", "*": "%2A", "_": "%5F", "|": "%7C"}


def link_target(u: Column) -> Column:
    """Percent-encodes what ends or opens syntax; an ampersand only before an entity."""
    u = F.regexp_replace(u, r"&(?=#?[A-Za-z0-9]+;)", "%26")
    for char, code in ENCODED.items():
        u = F.replace(u, F.lit(char), F.lit(code))
    return u


def xml_escape(s: Column) -> Column:
    s = clean(s)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(char), F.lit(entity))
    return s


def truthy(s: Column) -> Column:
    return F.lower(F.trim(s)).isin(*TRUTHY)


def round_half(x: Column) -> Column:
    return F.round(x * 2) / 2


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def title_from_filename(path: Column) -> Column:
    """The base name without its extension."""
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def import_name(path: Column) -> Column:
    return F.concat(title_from_filename(path), F.lit(".pdf"))


def sanitize_filename(s: Column) -> Column:
    """Drops what a path may not hold, outer dots and blanks; may be empty."""
    return F.regexp_replace(F.regexp_replace(one_line(s), r'[/\\:*?"<>|]', ""), r"^[. ]+|[. ]+$", "")


def safe_member(name: Column) -> Column:
    """Whether an archive member stays inside: not empty, absolute, on a drive, or climbing."""
    bad = r"^$|^/|\\|^[A-Za-z]:|(?:^|/)\.\.(?:/|$)"
    return ~name.rlike(bad)


def css_is_inert(css: Column) -> Column:
    """Free of anything that could fetch or run."""
    return ~F.lower(css).rlike(r"@import|url\(|image-set\(|image\(|src:|expression|behavior|-moz-binding|\\|@font-face|javascript:|<")


def natural_key(name: Column) -> Column:
    """Sorts with numbers by value: every digit run is zero-padded to 20."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def hex_decode(s: Column) -> Column:
    """Bytes of a hexadecimal string: white space skipped, an odd last digit padded with 0."""
    bare = F.regexp_replace(s, r"[\x{0}\x{9}\x{A}\x{C}\x{D}\x{20}]", "")
    return F.unhex(F.when(F.length(bare) % 2 == 1, F.concat(bare, F.lit("0"))).otherwise(bare))


def once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def last_of_class(ws: Column) -> Column:
    """How many words at the end are of the last one's class: amounts, words, others. Classes
    go by first letters, so no pattern is tried word by word."""
    kind = lambda a: F.when((a == 36) | a.between(48, 57), 1).when(a.between(65, 90) | a.between(97, 122), 2).otherwise(3)
    kinds = F.transform(F.transform(F.reverse(ws), lambda w: F.ascii(w)), kind)
    other = lambda ks: F.array_position(F.transform(ks, lambda k: k == ks[0]), F.lit(False))
    return once(once(kinds, other), lambda at: F.when(at > 0, at - 1).otherwise(F.size(ws))).cast("int")


def lead_in_dropped(ws: Column) -> Column:
    return F.when(F.size(ws) > 0, F.array_join(F.slice(ws, -last_of_class(ws), F.size(ws)), " ")).otherwise("")


def without_lead_in(option: Column) -> Column:
    """The last words of one class (amount, word, other): prose before a first option goes."""
    return once(words(option), lead_in_dropped)


def pipe_choices(line: Column) -> Column:
    """The first list of two or more options between pipes, its first option without the
    lead-in; words with a colon, bracket or blank to fill end a list. Empty if none."""
    ends = F.split(line, rf"(?:^|(?<=[{SPACE}]))[^{SPACE}]*[_:()][^{SPACE}]*")
    stretches = F.when(line.rlike("[_:()]"), ends).otherwise(F.array(line))
    listed = F.filter(F.transform(stretches, lambda s: F.split(s, r"\|")), lambda ps: F.size(ps) >= 2)
    bare = lambda p: F.trim(F.regexp_replace(p, f"[{SPACE}]+", " "))
    kept = F.transform(listed, lambda ps: F.filter(F.transform(ps, bare), lambda p: p != ""))
    lists = F.filter(kept, lambda ps: F.size(ps) >= 2)
    # An option's words stand one blank apart by now.
    first = lambda parts: F.concat(F.array(once(F.split(parts[0], " "), lead_in_dropped)), F.slice(parts, F.lit(2), F.size(parts)))
    return F.coalesce(once(F.get(lists, F.lit(0)), lambda parts: F.when(parts.isNotNull(), first(parts))), F.array().cast("array<string>"))


def yes_no_marks(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"(?i)\bY[\x{20}\x{9}]*/[\x{20}\x{9}]*N\b"))


def slash_parts(word: Column) -> Column:
    """The parts of Xx/Yy, each of two letters or more, or an empty array."""
    return F.when(word.rlike("^[A-Za-z]{2,}(?:/[A-Za-z]{2,})+$"), F.split(word, "/")).otherwise(F.array().cast("array<string>"))


def fill_template(text: Column, values: Column) -> Column:
    """struct(text, missing): {{key}} replaced by the map's value, {{=key}} left as the
    literal {{key}}; missing names keys without a value, never a value."""
    keys = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{([A-Za-z0-9_.\x{2D}]+)\}\}"), 1))
    missing = F.array_sort(F.filter(keys, lambda k: F.element_at(values, k).isNull()))
    filled = F.aggregate(keys, text, lambda acc, k: F.replace(acc, F.concat(F.lit("{{"), k, F.lit("}}")), F.coalesce(F.element_at(values, k), F.concat(F.lit("{{"), k, F.lit("}}")))))
    return F.struct(F.regexp_replace(filled, r"\{\{=([A-Za-z0-9_.\x{2D}]+)\}\}", "{{$1}}").alias("text"), missing.alias("missing"))


def unsupported(text: Column, supported: str) -> Column:
    """Distinct characters outside a class, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"([^{supported}])"), 1))


def glyph_text(name: Column, known: dict[str, str]) -> Column:
    """Text of a glyph name: the suffix after a stop goes, parts join at underscores;
    each is a known name, uniXXXX groups or uXXXX to uXXXXXX; else null."""
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else F.create_map().cast("map<string,string>")
    point = lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")
    part = lambda p: F.coalesce(
        F.element_at(names, p),
        F.when(p.rlike("^uni(?:[0-9A-F]{4})+$"), F.array_join(F.transform(F.regexp_extract_all(F.substring(p, 4, 400), F.lit("([0-9A-F]{4})"), 1), point), "")),
        F.when(p.rlike("^u[0-9A-F]{4,6}$"), point(F.substring(p, 2, 6))),
    )
    parts = F.transform(F.split(F.regexp_extract(name, r"^([^.]*)", 1), "_"), part)
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))
