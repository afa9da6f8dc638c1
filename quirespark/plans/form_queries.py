"""Queries on shapes, choices, packages, sources and small operators, with SQL where it
can say them; the others are compared with plain loops in tests/test_forms.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirespark.functions import addresses as A
from quirespark.operators import choices as Ch
from quirespark.operators import layout as L
from quirespark.operators import matching as M
from quirespark.operators import rules as R
from quirespark.operators import shapes as S
from quirespark.plans.bridge import table
from quirespark.plans.layout_queries import RUNS, own_runs
from quirespark.plans.sink_queries import _items, blocks
from quirespark.sources import formats, office, packages
from quirespark.sources import sinks as K

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def one_of(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


# Choices of forms: three rows a part, words at even steps.

FORMS = (
    ("Type of Membership: Youth Teen Adult Senior Family", "Name of The And Or", "Signature: Date Name Date"),
    ("Male/Female ( circle one )", "plain words here", "again Male/Female Home/Work"),
    ("( circle one )", "Bank Name: ___ Checking | Savings | Visa | MC", "Agree Y / N or y/n"),
    ("Increase my monthly dues by $5 | $10 | $25", "Heading: one", "x Red Green Blue"),
    ("Colour", "Only One | ", "Yes/No"),
)


def form_words(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.element_at(F.array(*(F.array(*map(F.lit, f)) for f in FORMS)), (F.col("p_partkey") % len(FORMS) + 1).cast("int"))).alias("row", "line"))
    w = p.select("doc_id", "row", F.posexplode(F.split("line", " ")).alias("k", "text"))
    x0, y = F.col("k") * 40.0, F.col("row") * 20.0 + (F.col("k") % 2) * 0.5
    return w.select("doc_id", F.lit(0).alias("page"), (F.col("row") * 100 + F.col("k")).cast("int").alias("seq"), "text", x0.alias("x0"), (x0 + F.least(F.length("text") * 4.0, F.lit(30.0))).alias("x1"), y.alias("y0"), F.lit(10.0).alias("size"))


@query("form_choices")
def form_choices(spark, d):
    return L.page_fold(form_words(spark, d), Ch.page_choices, Ch.CHOICES)


# Shapes: boxes and rules of an order's lines.


def boxes(spark, d):
    x, y = (F.col("l_partkey") % 7).cast("double") * 3, (F.col("l_suppkey") % 5).cast("double") * 4
    w, h = F.col("l_quantity") % 11 + 2, F.col("l_quantity") % 5 + 2
    nudge = F.when(F.col("l_linenumber") % 3 == 0, 0.0004).otherwise(0.0)
    kind = F.when(F.col("l_linenumber") % 4 == 0, "line").otherwise("rect")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("k"), kind.alias("kind"), (x + nudge).alias("x0"), y.alias("y0"), (x + w.cast("double")).alias("x1"), (y + h.cast("double")).alias("y1"))


BOX = ["k", "kind", "x0", "y0", "x1", "y1"]


def folded(spark, d, fold, schema):
    return R.by_document(boxes(spark, d), BOX, fold, schema)


@query("shape_dedupe")
def shape_dedupe(spark, d):
    return folded(spark, d, lambda rows: [(len(rows), len(S.dedupe_shapes([(r[1], r[2:]) for r in rows])))], "shapes int, kept int")


@query("union_areas")
def union_areas(spark, d):
    whole = boxes(spark, d).withColumns({x: F.rint(x) for x in ("x0", "x1")})
    return R.by_document(whole, BOX[2:], lambda rows: [(int(S.union_area(rows)), int(sum(map(S.area, rows))))], "area long, summed long")


@query("group_dedupe")
def group_dedupe(spark, d):
    return folded(spark, d, lambda rows: [(",".join(map(str, S.dedupe_groups([r[2:] for r in rows]))),)], "kept string")


def rules_of(rows):
    """Box edges as rules: tops across, left sides upright, to whole points."""
    return [(r[3], round(r[2]), round(r[2]) + 30.0) for r in rows], [(float(round(r[2])), r[3] - 2, r[3] + 20.0) for r in rows]


@query("merged_rules")
def merged_rules(spark, d):
    return folded(spark, d, lambda rows: [(f"{a:g}", int(lo), int(hi)) for a, lo, hi in S.merge_rules(rules_of(rows)[0])], "line string, lo int, hi int")


@query("ruled_grids")
def ruled_grids(spark, d):
    # The lines are all that rules are made of, so no more of a box is sent.
    own = boxes(spark, d).select("doc_id", F.rint("x0").alias("x"), F.col("y0").alias("y"))
    rules = lambda rows: ([(y, x, x + 30.0) for x, y in rows], [(x, y - 2, y + 20.0) for x, y in rows])
    return R.by_document(own, ["x", "y"], lambda rows: [(len(ys) - 1, len(xs) - 1, regular) for ys, xs, regular in S.ruled_grids(*rules(rows))], "rows int, columns int, regular boolean")


@query("field_proposals")
def field_proposals(spark, d):
    def fold(rows):
        squares, lines = [r[2:] for r in rows if r[1] == "rect"], [(r[5] + 20, r[2], r[4]) for r in rows if r[1] == "line"]
        return [(kind, f"{round(box[0])} {round(box[1])} {round(box[2])} {round(box[3])}") for kind, box in S.propose_fields(squares, lines, [r[2:] for r in rows[:1]])]

    return folded(spark, d, fold, "kind string, box string")


@query("link_hits", """SELECT p.doc_id, p.point, (SELECT arg_min(uri, pos) FROM k WHERE k.doc_id = p.doc_id AND p.x BETWEEN k.x0 AND k.x1 AND p.y BETWEEN k.y0 AND k.y1) AS uri FROM (
  SELECT o_orderkey AS doc_id, 1 AS point, (o_custkey % 20)::DOUBLE AS x, (o_custkey % 17)::DOUBLE AS y FROM orders) p, (SELECT 1) u""".replace("FROM k WHERE", """FROM (SELECT l_orderkey AS doc_id, l_linenumber AS pos, 'u' || l_linenumber AS uri, (l_partkey % 7)::DOUBLE * 3 AS x0, (l_suppkey % 5)::DOUBLE * 4 AS y0,
  (l_partkey % 7) * 3 + l_quantity % 11 + 2 AS x1, (l_suppkey % 5) * 4 + l_quantity % 5 + 2 AS y1 FROM lineitem) k WHERE"""))
def link_hits(spark, d):
    li, n = table(spark, d, "lineitem"), F.col("l_quantity")
    x, y = (F.col("l_partkey") % 7).cast("double") * 3, (F.col("l_suppkey") % 5).cast("double") * 4
    links = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("uri"), x.alias("x0"), y.alias("y0"), (x + n % 11 + 2).alias("x1"), (y + n % 5 + 2).alias("y1"))
    points = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("point"), (F.col("o_custkey") % 20).cast("double").alias("x"), (F.col("o_custkey") % 17).cast("double").alias("y"))
    return M.link_at(points, links)


_styles = "(SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_returnflag || ' ' || l_linestatus AS text, 's' || l_linenumber AS style FROM lineitem)"


@query("styles_by_text", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS k FROM {_styles} a), p AS (SELECT doc_id, text, style, row_number() OVER (PARTITION BY doc_id, text ORDER BY 8 - pos) AS k FROM {_styles} b WHERE pos <> 2)
  SELECT t.doc_id, t.pos, p.style FROM t LEFT JOIN p USING (doc_id, text, k)""")
def styles_by_text(spark, d):
    li = table(spark, d, "lineitem")
    text = F.concat_ws(" ", "l_returnflag", "l_linestatus")
    tree = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), text.alias("text"))
    proposal = li.where("l_linenumber <> 2").select(F.col("l_orderkey").alias("doc_id"), (8 - F.col("l_linenumber")).alias("pos"), F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  "))).alias("text"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("style"))
    return M.styles_by_text(tree, proposal).select("doc_id", "pos", "style")


@query("table_bounds", "SELECT p_partkey, CASE WHEN p_partkey % 80 > 63 OR (p_size * 40) * (p_partkey % 80) > 50000 THEN 'text' ELSE 'table' END AS kind FROM part")
def table_bounds(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).alias("n_rows"), (F.col("p_partkey") % 80).alias("n_cols")).select("p_partkey", L.table_kind().alias("kind"))


@query("cap_refusals")
def cap_refusals(spark, d):
    k = F.col("p_partkey")
    size, lines, rows, columns = k * k * 9000, k * 17, k * 41 % 12_000, k % 300
    return table(spark, d, "part").select("p_partkey", formats.cap_refusal(size, k % 2 == 0, lines, rows, columns).alias("refusal"))


#: A customer's address, by arithmetic: IPv4, IPv6 of some networks, mapped, and what is none.
GROUPS = ("2606", "2a00", "2001", "2002", "3fff", "64", "100", "fe80", "fd00", "ff02", "5f00", "fec0")
_four = "concat_ws('.', k * 7 % 256, (k * 13 + n) % 256, k % 256, k * 3 % 256)"
_group = f"element_at(array({', '.join(repr(g) for g in GROUPS)}), cast(floor(k / 4) % 12 + 1 AS int))"
_address = f"CASE WHEN k % 4 < 2 THEN {_four} WHEN k % 4 = 2 THEN concat({_group}, ':', lower(hex(k * 5 % 4500)), '::', lower(hex(n + 1)), CASE WHEN n % 3 = 0 THEN '%eth0' ELSE '' END) WHEN k % 8 = 3 THEN concat('::FFFF:', {_four}) WHEN n % 2 = 0 THEN concat(k % 300, '.1.2.300') ELSE concat('1:2::', n, '::3') END"
_reserved = """a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)) OR (b = 88 AND c = 99)))
  OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113)"""


def addresses(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", "c_custkey AS k", "c_nationkey AS n").selectExpr("c_custkey", f"{_address} AS address")


@query("routable_addresses", f"""SELECT c_custkey, CASE WHEN k % 4 < 2 OR k % 8 = 3 THEN NOT ({_reserved}) WHEN k % 4 = 2 THEN CASE (k // 4) % 12 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN g NOT BETWEEN 32 AND 47 AND g NOT IN (0, 3512) WHEN 4 THEN g >= 4096 WHEN 5 THEN true WHEN 6 THEN g > 0 ELSE false END ELSE false END AS routable
  FROM (SELECT c_custkey, c_custkey AS k, k * 7 % 256 AS a, (k * 13 + c_nationkey) % 256 AS b, k % 256 AS c, k * 5 % 4500 AS g FROM customer) q""")
def routable_addresses(spark, d):
    return addresses(spark, d).select("c_custkey", A.routable(F.col("address")).alias("routable"))


@query("broken_lines")
def broken_lines(spark, d):
    """The lines' words set anew at 40 characters."""
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name", "p_type"), " ")).alias("k", "word"))
    fold = lambda rows: [(i, " ".join(line)) for i, line in enumerate(S.break_greedy([w for _, w in rows], 40, lambda ws: len(" ".join(ws))))]
    return R.by_document(docs, ["k", "word"], fold, "line_no int, line string")


@query("word_alignment")
def word_alignment(spark, d):
    """Aligned words of a part's name and type, and the same with words dropped and added."""
    text = F.concat_ws(" ", "p_name", "p_type", "p_name")
    other = F.concat(F.regexp_replace(text, "([A-Za-z]+ )([A-Za-z]+ )", "$2"), F.lit(" end"))
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("old"), other.alias("new"))
    fold = lambda rows: [(len(pairs), pairs[0][0], pairs[-1][1]) if (pairs := R.aligned_words(rows[0][0].split(), rows[0][1].split())) else (0, -1, -1)]
    return R.by_document(docs, ["old", "new"], fold, "aligned int, first int, last int")


STREAMS = ("BT /F1 12 Tf (a (b) \\) c) Tj ET % end\n", "[(x) -120.5 (y)] TJ <</Span/A>> <4 1> .5 0 0 rg", "q 1 0 0 1 72 720 cm /Im1 Do Q", "(open", "<41> ' \" T* }{")


@query("content_edits")
def content_edits(spark, d):
    """Tokens of content streams, and each stream with its strings emptied."""
    def fold(rows):
        data = rows[0][0].encode()
        tokens = K.content_tokens(data)
        new = K.edited(data, [(a, b, b"()") for k, a, b in tokens if k == "string"])
        yield ",".join(k for k, _, _ in tokens if k != "space"), new.decode()

    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), one_of(STREAMS, F.col("p_partkey")).alias("stream"))
    return R.by_document(docs, ["stream"], fold, "kinds string, emptied string")


@query("unicode_maps", """SELECT p_partkey AS doc_id, unnest(['01', '02', '03', '10', '11']) AS code, unnest(['A', 'fi', chr(98 + (p_partkey % 20)::INTEGER), 'x', 'y']) AS mapped FROM part""")
def unicode_maps(spark, d):
    cmap = F.concat(F.lit("1 beginbfchar <01> <0041> <02> <00660069> endbfchar 2 beginbfrange <03> <03> <"), F.lpad(F.hex(98 + F.col("p_partkey") % 20), 4, "0"), F.lit("> <10> <11> [<0078> <0079>] endbfrange"))
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), cmap.alias("cmap"))
    return R.by_document(docs, ["cmap"], lambda rows: list(K.unicode_map(rows[0][0]).items()), "code string, mapped string")


# Packages, written and read again.


def package_query(kind: str, gap: str):
    """Paragraphs read back from a package of each document's blocks."""
    mark = f"CASE WHEN kind = 'item' AND marker <> '' THEN marker || '{gap}' || text ELSE text END"

    @query(f"{kind}_package", f"SELECT doc_id, count(*)::INTEGER AS paragraphs, sha256(string_agg({mark}, chr(10) ORDER BY pos)) AS digest FROM {_items} i GROUP BY doc_id")
    def run(spark, d):
        found = office.from_package(office.to_package(blocks(spark, d), kind), kind)
        return found.select("doc_id", F.size("paragraphs").alias("paragraphs"), F.sha2(F.array_join("paragraphs", "\n"), 256).alias("digest"))


for _kind in ("docx", "odt", "pptx"):
    package_query(_kind, " ")


@query("epub_package")
def epub_package(spark, d):
    """The text read back from a book of each document's blocks, by the spine."""
    level = F.when(F.col("pos") % 2 == 0, 1).otherwise(2)
    found = packages.read_epub(office.to_package(blocks(spark, d).withColumn("level", level), "epub"), "doc_id")
    return found.select("doc_id", F.regexp_count("text", F.lit(r"[^\s]+")).alias("words"), F.sha2(F.regexp_replace("text", r"\s+", " "), 256).alias("digest"), "refusal")


_grid = "(SELECT l_orderkey AS doc_id, l_linenumber AS pos, '=' || l_returnflag AS a, l_linestatus || ' <&> \"' AS b, '  ' || l_partkey AS c FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) l)"


def grid_query(kind: str):
    @query(f"{kind}_package", f"SELECT doc_id, sha256(string_agg(a || '|' || b || '|' || c, chr(10) ORDER BY pos)) AS digest FROM {_grid} g GROUP BY doc_id")
    def run(spark, d):
        li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg(*(F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_partkey")))
        cells = F.array(F.concat(F.lit("="), "l_returnflag"), F.concat("l_linestatus", F.lit(' <&> "')), F.concat(F.lit("  "), F.col("l_partkey").cast("string")))
        found = office.from_grid(office.to_grid(li.select("doc_id", "pos", cells.alias("cells")), kind), kind)
        return found.select("doc_id", F.sha2(F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "\n"), 256).alias("digest"))


for _kind in ("xlsx", "ods"):
    grid_query(_kind)


# Sources.


def web_package(html: str, k: int) -> bytes:
    """A page as MHTML with two pictures, one named by id and one by location."""
    from email.mime.image import MIMEImage
    from email.mime.multipart import MIMEMultipart
    from email.mime.text import MIMEText

    whole = MIMEMultipart("related", boundary=f"----part-{k}")
    whole.attach(MIMEText(f'<img src="cid:one"><img alt=x src="http://x/two.png"><img src="http://x/three.png">{html}', "html", "utf-8"))
    for name, value in (("Content-ID", "<one>"), ("Content-Location", "http://x/two.png")):
        image = MIMEImage(b"\x89PNG\r\n\x1a\n", "png")
        image[name] = value
        whole.attach(image)
    return whole.as_bytes()


@query("mhtml_source", """SELECT page_id, sha256('<img src="cid:one"><img alt=x src="http://x/two.png"><img src="http://x/three.png">' || html) AS digest, 3 AS parts, 2 AS pictures, 1 AS missing FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<img', '<i', 'g'), chr(13), '', 'g') AS html FROM pages) p""")
def mhtml_source(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(F.regexp_replace("html", "(?i)<img", "<i"), "\r", "").alias("html"))
    fold = lambda rows: [(p["html"], p["parts"], p["pictures"], p["missing"]) for p in (office.mhtml(web_package(rows[0][0], 1)),)]
    found = R.by_document(pages, ["html"], fold, "html string, parts int, pictures int, missing int")
    return found.select(F.col("doc_id").alias("page_id"), F.sha2("html", 256).alias("digest"), "parts", "pictures", "missing")


def header(kind: str, w: int, h: int) -> bytes:
    import struct

    makers = {  # only the kind's own: a number that fits one kind's field need not fit another's
        "png": lambda: b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h), "gif": lambda: b"GIF89a" + struct.pack("<HH", w, h), "bmp": lambda: b"BM" + bytes(16) + struct.pack("<ii", w, -h),
        "jpeg": lambda: b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + bytes(12), "webp": lambda: b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + max(0, w - 1).to_bytes(3, "little") + max(0, h - 1).to_bytes(3, "little"), "none": lambda: b"no picture",
    }
    return makers[kind]()


#: Bits of a width's field; the width in the header is at most what they hold.
WIDTH_BITS = {"png": 31, "gif": 16, "bmp": 31, "jpeg": 16, "webp": 24}


def framed(kind: str, w: int, h: int) -> list[tuple[str, int, int]]:
    """What a reader finds in a header of the kind. Widths are keys here, and keys pass what 16 or
    24 bits hold: such a header has the rest of the width, and what was left out is added again."""
    most = (1 << WIDTH_BITS.get(kind, 31)) - 1
    own = (w - 1) % most + 1
    return [(k, width + w - own, height) for k, width, height in (x for x in (office.image_info(header(kind, own, h)),) if x)]


IMAGES = ("png", "gif", "bmp", "jpeg", "webp", "none")


@query("image_headers", "SELECT p_partkey AS doc_id, kind, w AS width, h AS height FROM (SELECT p_partkey, (['png', 'gif', 'bmp', 'jpeg', 'webp', 'none'])[(p_partkey % 6 + 1)::INTEGER] AS kind, (p_partkey + 1)::INTEGER AS w, p_size::INTEGER AS h FROM part) q WHERE kind <> 'none'")
def image_headers(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), one_of(IMAGES, F.col("p_partkey")).alias("kind"), (F.col("p_partkey") + 1).cast("int").alias("w"), F.col("p_size").cast("int").alias("h"))
    return R.by_document(docs, ["kind", "w", "h"], lambda rows: framed(*rows[0]), "kind string, width int, height int")


@query("comic_pages", """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n)::INTEGER AS page, 'p' || n || '.png' AS name, n::INTEGER AS width FROM (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS n FROM lineitem) q""")
def comic_pages(spark, d):
    others = [office.packed(name, data) for name, data in (("__MACOSX/p1.png", b"x"), (".hidden.png", b"x"), ("notes.txt", b"text"))]

    def fold(rows):
        pages = [(f"p{n}.png", header("png", n, 5)) for n in sorted({n for (n,) in rows}, key=str)]
        return [(k, name, w) for k, (name, _, w, _) in enumerate(office.comic_pages(office.zipped(pages + others)), 1)]

    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").cast("int").alias("n"))
    return R.by_document(pages, ["n"], fold, "page int, name string, width int")


# Order of reading.


@query("reading_order", f"SELECT doc_id, page, seq, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN x0 < 80 THEN 0 ELSE 1 END, y1 DESC, x0, seq)::INTEGER AS place FROM {RUNS} r")
def reading_order(spark, d):
    """Places by column, left to right, then downwards. Columns are islands of runs' left ends."""
    return L.reading_order(own_runs(spark, d).withColumn("x1", F.col("x0") + 5)).select("doc_id", "page", "seq", "place")


@query("cropped_pages", """SELECT l_orderkey AS doc_id, l_linenumber AS page, greatest(l, 0.0) AS x0, greatest(b, 0.0) AS y0, least(595.0 - r, 595.0)::DOUBLE AS x1, least(842.0 - t, 842.0)::DOUBLE AS y1, l + r < 595 AND b + t < 842 AS ok FROM (
  SELECT l_orderkey, l_linenumber, (l_partkey % 300)::DOUBLE AS l, (l_suppkey % 400)::DOUBLE AS b, (l_partkey % 310)::DOUBLE AS r, (l_quantity * 10)::DOUBLE AS t FROM lineitem) q""")
def cropped_pages(spark, d):
    from quirespark.operators import pages as P

    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(595.0).alias("x1"), F.lit(842.0).alias("y1"), "l_partkey", "l_suppkey", "l_quantity")
    out = P.cropped(li, (F.col("l_partkey") % 300).cast("double"), (F.col("l_suppkey") % 400).cast("double"), (F.col("l_partkey") % 310).cast("double"), (F.col("l_quantity") * 10).cast("double"))
    return out.select("doc_id", "page", "x0", "y0", "x1", "y1", "ok")


# PDF: the documents' lines as files, 54 to a page; every seventh file has lost its header.


def pdf_files(spark, d):
    from quirespark.sources import pdf

    def write(lines):
        pages = [[(72, 720 - 12 * k, 10, text) for k, text in enumerate(lines[a : a + 54]) if text] for a in range(0, max(1, len(lines)), 54)]
        return pdf.write_pdf(pages)

    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    whole = office.made(docs, "doc_id", "lines", write, "content", "binary")
    return whole.withColumn("content", F.when(F.col("doc_id") % 7 == 6, F.expr("substring(content, 10)")).otherwise(F.col("content")))


_pdf_lines = "(SELECT doc_id, CAST((i - 1) // 54 AS INTEGER) AS page, i - 1 AS n, parts[i] AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents WHERE doc_id % 7 <> 6) d, LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i) s)"


@query("pdf_runs", f"""SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY n) - 1)::INTEGER AS seq, sha256(text) AS digest, 72.0::DOUBLE AS x0, (720 - 12 * (n % 54))::DOUBLE AS y0, (72 + 10 * length(text))::DOUBLE AS x1, 10.0::DOUBLE AS size, NULL AS refusal
  FROM {_pdf_lines} l WHERE text <> '' UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no header' FROM documents WHERE doc_id % 7 = 6""")
def pdf_runs(spark, d):
    from quirespark.sources import pdf

    found = pdf.pdf_runs(pdf_files(spark, d))
    return found.select("doc_id", "page", "seq", F.sha2("text", 256).alias("digest"), F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"), F.round("x1", 3).alias("x1"), "size", "refusal")


@query("pdf_pages", f"SELECT doc_id, max(page) + 1 AS pages, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height FROM {_pdf_lines} l GROUP BY doc_id")
def pdf_pages(spark, d):
    from quirespark.sources import pdf

    found = pdf.pdf_pages(pdf_files(spark, d)).where("refusal IS NULL")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("pages"), F.max(F.col("x1") - F.col("x0")).alias("width"), F.max(F.col("y1") - F.col("y0")).alias("height"))


@query("pdf_refusals", "SELECT 'no header' AS refusal, count(*) AS n FROM documents WHERE doc_id % 7 = 6 HAVING count(*) > 0")
def pdf_refusals(spark, d):
    from quirespark.sources import pdf

    return pdf.pdf_pages(pdf_files(spark, d)).where("refusal IS NOT NULL").groupBy("refusal").agg(F.count(F.lit(1)).alias("n"))
