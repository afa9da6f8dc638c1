"""Queries on text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.plans.bridge import injected, lines, sql_injected, sql_lines, table

#: The same classes in the syntax of the oracle's engine.
SPACE, BIDI = T.SPACE, T.BIDI
RE_RTL = r"\p{Hebrew}\p{Arabic}\p{Syriac}\p{Thaana}\p{Nko}"
CLEAN = rf"regexp_replace(regexp_replace(text, '[\x{{2028}}\x{{2029}}]', chr(10), 'g'), '[{T.DROPPED}]', '', 'g')"
ONE_LINE = rf"regexp_replace(regexp_replace({CLEAN}, '[{SPACE}]+', ' ', 'g'), '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
count = lambda s, pattern: f"len(regexp_extract_all({s}, '{pattern}'))"

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("clean_text_digest", f"SELECT doc_id, sha256({CLEAN}) AS digest FROM {sql_injected()} t")
def clean_text_digest(spark, d):
    return injected(spark, d).select("doc_id", F.sha2(T.clean(F.col("text")), 256).alias("digest"))


@query("one_line", f"SELECT doc_id, length({ONE_LINE})::BIGINT AS n, sha256({ONE_LINE}) AS digest FROM {sql_injected()} t")
def one_line(spark, d):
    s = T.one_line(F.col("text"))
    return injected(spark, d).select("doc_id", F.length(s).cast("long").alias("n"), F.sha2(s, 256).alias("digest"))


@query("direction_by_lang", rf"""SELECT lang, count(*) FILTER (WHERE rtl > ltr) AS rtl_docs, sum(rtl)::BIGINT AS rtl_letters, sum(ltr)::BIGINT AS other_letters,
  CASE WHEN sum(rtl) > sum(ltr) THEN 'rtl' ELSE 'ltr' END AS majority FROM (
  SELECT lang, {count('text', f'[{RE_RTL}]')} AS rtl, {count(f"regexp_replace(text, '[{RE_RTL}]', '', 'g')", '[' + chr(92) + 'p{L}]')} AS ltr FROM (
    SELECT lang, CASE WHEN doc_id % 15 = 8 THEN repeat('{chr(0x5E9)}{chr(0x5DC)}', length(text)) || text ELSE text END AS text FROM {sql_injected()} u) t) GROUP BY lang""")
def direction_by_lang(spark, d):
    s = F.when(F.col("doc_id") % 15 == 8, F.concat(F.repeat(F.lit("של"), F.length("text")), F.col("text"))).otherwise(F.col("text"))
    each = injected(spark, d).select("lang", T.rtl_letters(s).alias("rtl"), T.other_letters(s).alias("ltr"))
    return each.groupBy("lang").agg(
        F.count_if(F.col("rtl") > F.col("ltr")).alias("rtl_docs"), F.sum("rtl").alias("rtl_letters"), F.sum("ltr").alias("other_letters"),
        F.when(F.sum("rtl") > F.sum("ltr"), "rtl").otherwise("ltr").alias("majority"),
    )


@query("bidi_counts", f"SELECT doc_id, (length(text) - length(regexp_replace(text, '[{BIDI}]', '', 'g')))::INTEGER AS n, regexp_matches(substr(text, 1, 1), '^[{BIDI}]$') AS opens FROM {sql_injected()} t")
def bidi_counts(spark, d):
    return injected(spark, d).select("doc_id", T.bidi_controls(F.col("text")).alias("n"), T.is_bidi_control(F.substring("text", 1, 1)).alias("opens"))


LINKS = ("", "JAVASCRIPT:", "mailto:", " HTTPS://x.y/", "data:text/html,", "HTTPS://x.y/%zz?", "http://a/%41?%zz=")
_links = "CASE page_id % 7 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(LINKS)) + " END || url"


@query("safe_links", rf"""SELECT page_id, page_id % 7 NOT IN (1, 3, 4, 5) AS safe, page_id % 7 NOT IN (1, 4, 5) AS safe_href,
  regexp_replace({"".join(f"replace(" for _ in T.ENCODED)}regexp_replace(u || ' (a_b)*&amp;', '&(#?[A-Za-z0-9]+;)', '%26\1', 'g'){"".join(f", '{c if c != chr(39) else chr(39) * 2}', '{e}')" for c, e in T.ENCODED.items())}, '^$', '') AS target
  FROM (SELECT page_id, {_links} AS u FROM pages) t""")
def safe_links(spark, d):
    prefix = F.element_at(F.array(*map(F.lit, LINKS)), (F.col("page_id") % 7 + 1).cast("int"))
    u = F.concat(prefix, F.col("url"))
    return table(spark, d, "pages").select("page_id", T.safe_link(u).alias("safe"), T.safe_href(u).alias("safe_href"), T.link_target(F.concat(u, F.lit(" (a_b)*&amp;"))).alias("target"))


@query("csv_safe_cells", rf"""SELECT doc_id, sha256(CASE WHEN regexp_matches(text, '^[\x{{9}}\x{{A}}\x{{D}}\x{{20}}]*[=+\x{{2D}}@]')
  THEN '''' || regexp_replace(text, '^[\x{{9}}\x{{A}}\x{{D}}\x{{20}}]*', '') ELSE text END) AS digest FROM {sql_injected()} t""")
def csv_safe_cells(spark, d):
    return injected(spark, d).select("doc_id", F.sha2(T.csv_safe(F.col("text")), 256).alias("digest"))


_esc = r"regexp_replace(text, '([\\`*_\[\]<>|~!])', '\\\1', 'g')"
_start = rf"regexp_replace(regexp_replace({_esc}, '^([#>+=\x{{2D}}])', '\\\1'), '^([0-9]+)([.)])', '\1\\\2')"


@query("markdown_escape", f"SELECT doc_id, sha256({_esc}) AS inline_digest, sha256({_start}) AS start_digest, sha256(trim(regexp_replace(translate(text, chr(10) || chr(13) || chr(9), '   '), '([\\\\`*_\\[\\]<>|~!])', '\\\\\\1', 'g'), ' ')) AS cell_digest FROM {sql_injected()} t")
def markdown_escape(spark, d):
    e = T.markdown_escape(F.col("text"))
    return injected(spark, d).select("doc_id", F.sha2(e, 256).alias("inline_digest"), F.sha2(T.markdown_line_start(e), 256).alias("start_digest"), F.sha2(T.markdown_cell(F.col("text")), 256).alias("cell_digest"))


_marker = rf"^((?:[0-9]{{1,3}}|[a-z]|[ivxlcdm]{{1,4}})[.)]|{T.BULLET})[{SPACE}]+[^{SPACE}]"


@query("list_markers", f"SELECT regexp_extract(line, '{_marker}', 1) AS marker, count(*) AS n, count(*) FILTER (WHERE regexp_matches(regexp_extract(line, '{_marker}', 1), '^[0-9]+[.)]$')) AS numbered FROM {sql_lines(sql_injected())} l GROUP BY 1")
def list_markers(spark, d):
    marker = T.list_marker(F.col("line"))
    found = lines(injected(spark, d)).select(marker.alias("marker"))
    return found.groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.numbered(F.col("marker"))).alias("numbered"))


@query("xml_escape", f"""SELECT doc_id, sha256(replace(replace(replace(replace(replace({CLEAN}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;')) AS digest FROM {sql_injected()} t""")
def xml_escape(spark, d):
    return injected(spark, d).select("doc_id", F.sha2(T.xml_escape(F.col("text")), 256).alias("digest"))


TAGS = ("en", "en-US", "e", "123456789", "zh-Hant-TW", "x_y", "", "deu", "chi_sim", "fr-", "x-private", "I-klingon", "en-a-bbbbbbbb-cccccccc-dddddddd-eee", "en-a-bbbbbbbb-cccccccc-dddddddd-eeeeeeee", "9a", "abcdefghi", "en--US")
_good = "'en', 'en-US', 'zh-Hant-TW', 'deu', 'x-private', 'I-klingon', 'en-a-bbbbbbbb-cccccccc-dddddddd-eee'"
_tags = "[" + ", ".join(f"'{t}'" for t in TAGS) + "][(doc_id % 17 + 1)::INTEGER]"
_ocr = "CASE tag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.OCR_TAGS.items()) + " ELSE '' END"


@query("language_tags", f"SELECT doc_id, CASE WHEN tag IN ({_good}) THEN tag ELSE 'und' END AS tag, {_ocr} AS ocr_tag FROM (SELECT doc_id, {_tags} AS tag FROM documents) t")
def language_tags(spark, d):
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("doc_id") % 17 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.lang_tag(tag).alias("tag"), T.ocr_tag(tag).alias("ocr_tag"))


BOXES = ("Yes", " ON ", "off", "x", "0", "checked", "no", "True ", "", "1")
_boxes = "[" + ", ".join(f"'{t}'" for t in BOXES) + "][(l_orderkey % 10 + 1)::INTEGER]"


@query("truthy_boxes", f"SELECT box, count(*) AS n, bool_and(lower(trim(box)) IN ('t', 'true', '1', 'yes', 'y', 'x', 'checked', 'on')) AS truth FROM (SELECT {_boxes} AS box FROM lineitem) t GROUP BY box")
def truthy_boxes(spark, d):
    box = F.element_at(F.array(*map(F.lit, BOXES)), (F.col("l_orderkey") % 10 + 1).cast("int"))
    return table(spark, d, "lineitem").select(box.alias("box")).groupBy("box").agg(F.count(F.lit(1)).alias("n"), F.bool_and(T.truthy(F.col("box"))).alias("truth"))


@query("round_half", "SELECT l_orderkey, l_linenumber, round(l_quantity * 0.37::DOUBLE * 2) / 2 AS half FROM lineitem")
def round_half(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.round_half(F.col("l_quantity") * 0.37).alias("half"))


_path = "url || CASE page_id % 5 WHEN 0 THEN '/a.b.pdf' WHEN 1 THEN '/x' WHEN 2 THEN '/.hidden' WHEN 3 THEN '/p<q>: r?.txt ' ELSE chr(92) || 'w.docx' END"
_base = r"regexp_extract(p, '([^/\\]*)$', 1)"
_title = rf"regexp_replace({_base}, '(.)\.[^.]*$', '\1')"


@query("file_names", rf"""SELECT page_id, {_title} AS title, {_title} || '.pdf' AS import_name,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace({_base}, '[{SPACE}]+', ' ', 'g'), '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), '[/\\:*?"<>|]', '', 'g'), '^[. ]+|[. ]+$', '', 'g') AS safe_name,
  NOT regexp_matches(p, '^$|^/|\\|^[A-Za-z]:|(?:^|/)\.\.(?:/|$)') AS member_ok FROM (SELECT page_id, {_path} AS p FROM pages) t""")
def file_names(spark, d):
    k = F.col("page_id") % 5
    tail = F.when(k == 0, "/a.b.pdf").when(k == 1, "/x").when(k == 2, "/.hidden").when(k == 3, "/p<q>: r?.txt ").otherwise("\\w.docx")
    p = F.concat("url", tail)
    return table(spark, d, "pages").select("page_id", T.title_from_filename(p).alias("title"), T.import_name(p).alias("import_name"), T.sanitize_filename(T.base_name(p)).alias("safe_name"), T.safe_member(p).alias("member_ok"))


_choice = "line || CASE doc_id % 3 WHEN 0 THEN ' Y / N' WHEN 1 THEN ' | red | 12' ELSE '' END"


@query("choice_marks", rf"SELECT doc_id, sum({count('s', '(?i)' + chr(92) + 'bY[' + chr(92) + 'x{20}' + chr(92) + 'x{9}]*/[' + chr(92) + 'x{20}' + chr(92) + 'x{9}]*N' + chr(92) + 'b')})::BIGINT AS yes_no FROM (SELECT doc_id, {_choice} AS s FROM {sql_lines()} l) t GROUP BY doc_id")
def choice_marks(spark, d):
    k = F.col("doc_id") % 3
    s = F.concat("line", F.when(k == 0, " Y / N").when(k == 1, " | red | 12").otherwise(""))
    return lines(table(spark, d, "documents")).groupBy("doc_id").agg(F.sum(T.yes_no_marks(s)).alias("yes_no"))


@query("pipe_choices")
def pipe_choices(spark, d):
    options = T.once(T.pipe_choices(F.concat("line", F.lit(" | red | 12"))), lambda o: F.when(F.size(o) > 0, F.array(F.array_join(o, "|"))))
    # A row for each list: a filter on options would find them a second time.
    return lines(table(spark, d, "documents")).select("doc_id", "line_no", F.explode(options).alias("options"))


@query("natural_order", """SELECT p_partkey, rank() OVER (ORDER BY substr(name, 1, 1), num, tail) AS place FROM (SELECT p_partkey, 'p' || (p_partkey % 120) || CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'A' END AS name, p_partkey % 120 AS num, CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'a' END AS tail FROM part) q""")
def natural_order(spark, d):
    """Places of names such as p7A and p12b: numbers by value, letters in any case. Names are few, so ranks are of the distinct ones."""
    from pyspark.sql import Window

    k = F.col("p_partkey")
    own = table(spark, d, "part").select("p_partkey", T.natural_key(F.concat(F.lit("p"), (k % 120).cast("string"), F.when(k % 2 == 0, "b").otherwise("A"))).alias("sort_key"))
    counts = own.groupBy("sort_key").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("sort_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(counts.select("sort_key", (before + 1).alias("place")), "sort_key").select("p_partkey", "place")


@query("css_inert", r"""SELECT p_partkey, NOT (lower(css) LIKE '%@import%' OR lower(css) LIKE '%url(%' OR lower(css) LIKE '%image-set(%' OR lower(css) LIKE '%image(%' OR lower(css) LIKE '%src:%' OR lower(css) LIKE '%expression%' OR lower(css) LIKE '%behavior%' OR lower(css) LIKE '%-moz-binding%'
  OR contains(css, chr(92)) OR lower(css) LIKE '%@font-face%' OR lower(css) LIKE '%javascript:%' OR contains(css, '<')) AS inert FROM (SELECT p_partkey, p_name || (['', 'color: red', '@IMPORT x', 'a{b:URL(x)}', 'image-set(1)', 'Src: x', 'Expression(1)', 'behavior', '-moz-binding', 'a' || chr(92) || 'b', '@font-face', 'JavaScript:', '<', 'image (x)'])[(p_partkey % 14 + 1)::INTEGER] AS css FROM part) q""")
def css_inert(spark, d):
    css = ("", "color: red", "@IMPORT x", "a{b:URL(x)}", "image-set(1)", "Src: x", "Expression(1)", "behavior", "-moz-binding", "a\\b", "@font-face", "JavaScript:", "<", "image (x)")
    own = F.concat("p_name", F.element_at(F.array(*map(F.lit, css)), (F.col("p_partkey") % 14 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", T.css_is_inert(own).alias("inert"))


WORDS = ("Male/Female", "Y/N", "a/bc", "One/Two/Three", "x", "Home/Work/", "10/20", "ab/cd")


@query("slash_words", "SELECT p_partkey, w AS word, CASE WHEN w IN ('Male/Female', 'One/Two/Three', 'ab/cd') THEN replace(w, '/', '|') ELSE '' END AS parts FROM (SELECT p_partkey, (['Male/Female', 'Y/N', 'a/bc', 'One/Two/Three', 'x', 'Home/Work/', '10/20', 'ab/cd'])[(p_partkey % 8 + 1)::INTEGER] AS w FROM part) q")
def slash_words(spark, d):
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", word.alias("word"), F.array_join(T.slash_parts(word), "|").alias("parts"))


LOCALES = ("en-US", "EN_gb", "zh-TW", "zh", "zh-Hant-CN", "pt-PT", "pt-br", "xx", None, "", "de_AT", "zh_MO")


@query("locale_options", "SELECT p_partkey, (['en', 'en-GB', 'zh-Hant', 'zh-Hans', 'zh-Hant', '', 'pt-BR', '', '', '', 'de', 'zh-Hant'])[(p_partkey % 12 + 1)::INTEGER] AS choice FROM part")
def locale_options(spark, d):
    locale = F.element_at(F.array(*map(F.lit, LOCALES)), (F.col("p_partkey") % 12 + 1).cast("int"))
    options = F.array(*map(F.lit, ("", "en", "en-GB", "de", "fr", "zh-Hans", "zh-Hant", "pt-BR")))
    return table(spark, d, "part").select("p_partkey", T.locale_option(locale, options).alias("choice"))


_images = "(['data:image/png;base64,', 'DATA:image/JPEG; base64, ', 'data:image/svg+xml;base64,', 'data:image/gif,', 'data:image/webp;base64,', 'http:', 'data:image/png;base64,!'])[(event_id % 7 + 1)::INTEGER]"


@query("inline_images", f"""SELECT event_id, kept AND sum(CASE WHEN kept THEN bytes ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) <= 900 AS admitted, CASE WHEN kept THEN bytes END AS bytes FROM (
  SELECT user_id, event_id, event_id % 7 IN (0, 1, 4) AS kept, (length(body) // 4 * 3)::BIGINT AS bytes FROM (SELECT user_id, event_id, CASE WHEN event_id % 7 = 1 THEN ' ' ELSE '' END || repeat('QUJD', (event_id % 40 + 1)::INTEGER) AS body FROM events) a) q""")
def inline_images(spark, d):
    """Pictures of a page are admitted while those of a known type so far keep within the page's bytes (here 900)."""
    from pyspark.sql import Window

    heads = ("data:image/png;base64,", "DATA:image/JPEG; base64, ", "data:image/svg+xml;base64,", "data:image/gif,", "data:image/webp;base64,", "http:", "data:image/png;base64,!")
    u = F.concat(F.element_at(F.array(*map(F.lit, heads)), (F.col("event_id") % 7 + 1).cast("int")), F.repeat(F.lit("QUJD"), (F.col("event_id") % 40 + 1).cast("int")))
    own = table(spark, d, "events").select("user_id", "event_id", T.data_image(u)["bytes"].alias("bytes"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("event_id", (F.col("bytes").isNotNull() & (F.sum(F.coalesce("bytes", F.lit(0))).over(w) <= 900)).alias("admitted"), "bytes")


@query("natural_keys")
def natural_keys(spark, d):
    return table(spark, d, "pages").select("page_id", T.natural_key(F.col("url")).alias("sort_key")).orderBy("sort_key", "page_id")


@query("template_fill", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Dear ' || c_name || ', {{missing}} {{c_name}}' WHEN 1 THEN c_mktsegment || '/' || c_mktsegment || '{{}}' ELSE 'no keys {{ c_name }} {{=x.y}' END AS letter,
  CASE c_custkey % 3 WHEN 0 THEN 'missing' ELSE '' END AS missing FROM customer""")
def template_fill(spark, d):
    values, k = F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("seg"), F.col("c_mktsegment")), F.col("c_custkey") % 3
    template = F.when(k == 0, "Dear {{c_name}}, {{missing}} {{=c_name}}").when(k == 1, "{{seg}}/{{seg}}{{}}").otherwise("no keys {{ c_name }} {{=x.y}")
    filled = T.fill_template(template, values)
    return table(spark, d, "customer").select("c_custkey", filled["text"].alias("letter"), F.array_join(filled["missing"], ",").alias("missing"))


@query("unsupported_runes", r"""SELECT d.doc_id, coalesce(runes, '') AS runes FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(c, '' ORDER BY i) AS runes FROM (
    SELECT doc_id, c, min(i) AS i FROM (SELECT doc_id, unnest(a) AS c, generate_subscripts(a, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x{20}-\x{7E}\x{A}]') AS a FROM documents) x) y GROUP BY doc_id, c) z GROUP BY doc_id) r USING (doc_id)""")
def unsupported_runes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.unsupported(F.coalesce("text", F.lit("")), r"\x{20}-\x{7E}\x{A}"), "").alias("runes"))


GLYPHS = ("A", "uni00410042", "u1F600", "f_i.alt", "nosuch", "uni004", "a_uni0301")


@query("glyph_names")
def glyph_names(spark, d):
    name = F.element_at(F.array(*map(F.lit, GLYPHS)), (F.col("p_partkey") % len(GLYPHS) + 1).cast("int"))
    known = {c: c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"} | {"space": " ", "hyphen": "-"}
    return table(spark, d, "part").select("p_partkey", name.alias("glyph"), T.glyph_text(name, known).alias("glyph_text"))


@query("hex_strings", "SELECT p_partkey, decode(unhex(CASE WHEN length(h) % 2 = 1 THEN h || '0' ELSE h END)) AS decoded FROM (SELECT p_partkey, hex(encode(p_name)) || CASE WHEN p_partkey % 2 = 0 THEN '4' ELSE '' END AS h FROM part) t")
def hex_strings(spark, d):
    h = F.hex(F.encode("p_name", "UTF-8"))
    spaced = F.concat(F.regexp_replace(h, "(..)", "$1 "), F.when(F.col("p_partkey") % 2 == 0, "4").otherwise(""))
    return table(spark, d, "part").select("p_partkey", F.decode(T.hex_decode(spaced), "UTF-8").alias("decoded"))
