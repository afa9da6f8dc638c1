"""PDF reading on files made by hand: structure, text state, forms, maps, hostile input."""

import random
import zlib

import pytest

from quirespark.sources import pdf


def made(objects, trailer=b"<</Root 1 0 R>>"):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer\n" + trailer


def stream(data, extra=b""):
    return b"<<%s/Length %d>>\nstream\n%s\nendstream" % (extra, len(data), data)


def one_page(content, more=None, resources=b"<</Font<</F 9 0 R>>>>"):
    return made({
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/MediaBox[0 0 200 100]/Resources %s>>" % resources, 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>",
        4: stream(content), 9: b"<</Type/Font/Subtype/Type1/FirstChar 65/Widths[100 200]>>", **(more or {}),
    })


def runs(data):
    doc = pdf.Document(data)
    return [(r["text"], r["x0"], r["y0"], r["x1"], r["visible"]) for page in doc.pages() for r in pdf.runs_of(doc, page)]


def test_round_trip_of_random_lines():
    r = random.Random(1)
    for _ in range(20):
        pages = [[(r.randrange(300), r.randrange(700), r.choice((8, 10, 12)), "".join(r.choice("abé ש€\U0001f600()<>\\%/") for _ in range(r.randrange(1, 30)))) for _ in range(r.randrange(6))] for _ in range(r.randrange(1, 5))]
        doc = pdf.Document(pdf.write_pdf(pages))
        assert len(doc.pages()) == len(pages)
        for page, lines in zip(doc.pages(), pages):
            assert [(x["text"], x["x0"], x["y0"], x["size"]) for x in pdf.runs_of(doc, page)] == [(t, x, y, s) for x, y, s, t in lines]


def test_text_state():
    got = runs(one_page(b"BT /F 10 Tf 5 7 Td (AB) Tj 2 Tc (A) Tj 0 Tc 100 TL T* (B) Tj 3 Tr (A) ' ET"))
    assert got == [("AB", 5, 7, 8, True), ("A", 8, 7, 11, True), ("B", 5, -93, 7, True), ("A", 5, -193, 6, False)]
    assert runs(one_page(b"q 2 0 0 2 10 20 cm BT /F 10 Tf 1 0 0 1 1 1 Tm [(A) -500 (B)] TJ ET Q BT /F 10 Tf (A) Tj ET")) == [("A B", 12, 22, 28, True), ("A", 0, 0, 1, True)]


def test_forms_bring_their_runs_and_do_not_recurse():
    form = stream(b"BT /F 10 Tf (B) Tj ET /X Do", b"/Subtype/Form/Matrix[1 0 0 1 3 4]/Resources<</Font<</F 9 0 R>>/XObject<</X 5 0 R>>>>")
    assert runs(one_page(b"/X Do /X Do", {5: form}, b"<</XObject<</X 5 0 R>>>>")) == [("B", 3, 4, 5, True)] * 2


def test_strings_and_operands():
    assert list(map(bytes, pdf.values(rb"(a\(b\)\101\n) <41 4> (x(y)z)"))) == [b"a(b)A\n", b"A@", b"x(y)z"]
    assert runs(one_page(b"Tj BT Td /None 10 Tf (A) Tj (B) ' 1 Tm ET")) == []


def test_page_trees_inherit_and_may_not_loop():
    doc = pdf.Document(made({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Kids[3 0 R 2 0 R 4 0 R]/Rotate 90/MediaBox[10 10 0 0]>>", 3: b"<</Kids[5 0 R 3 0 R]/MediaBox[0 0 5 5]>>", 4: b"<</Type/Page>>", 5: b"<</Type/Page/Rotate 0>>"}))
    assert [(doc.box(p), p["Rotate"]) for p in doc.pages()] == [((0, 0, 5, 5), 0), ((0, 0, 10, 10), 90)]


def test_object_streams_and_later_objects():
    packed = b"1 0 2 31 <</Type/Catalog/Pages 2 0 R>>  <</Kids[3 0 R]/MediaBox[0 0 9 9]>>"
    first = packed.index(b"<<")
    packed = packed.replace(b"2 31", b"2 %02d" % (packed.index(b"<</Kids") - first))
    data = zlib.compress(packed)
    doc = pdf.Document(made({7: b"<</Type/ObjStm/N 2/First %d/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (first, len(data), data), 3: b"<</Type/Page>>"}) + b"\n3 0 obj\n<</Type/Page/Rotate 180>>\nendobj\n")
    assert [p["Rotate"] for p in doc.pages()] == [180]


def test_hostile_files_refuse(monkeypatch):
    with pytest.raises(ValueError, match="no header"):
        pdf.Document(b"junk")
    with pytest.raises(ValueError, match="encrypted"):
        pdf.Document(made({1: b"<</Type/Catalog>>"}, b"<</Root 1 0 R/Encrypt 2 0 R>>"))
    with pytest.raises(ValueError, match="no catalogue"):
        pdf.Document(made({1: b"5"}))
    with pytest.raises(ValueError, match="circle"):
        pdf.Document(made({1: b"2 0 R", 2: b"1 0 R"}))
    with pytest.raises(ValueError, match="nested"):
        list(pdf.values(b"[" * 100))
    monkeypatch.setattr(pdf, "STREAM_BYTES", 1000)
    bomb = zlib.compress(bytes(100_000))
    with pytest.raises(ValueError, match="too large"):
        runs(made({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Kids[3 0 R]>>", 3: b"<</Type/Page/Contents 4 0 R>>", 4: stream(bomb, b"/Filter/FlateDecode")}))


def test_refusals_are_rows(spark):
    good = pdf.write_pdf([[(1, 2, 3, "x")]])
    files = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"")), (3, None), (4, bytearray(good[:40]))], "doc_id long, content binary")
    got = {r.doc_id: (r.text, r.refusal) for r in pdf.pdf_runs(files).collect()}
    assert got == {1: ("x", None), 2: (None, "no header"), 3: (None, "no header"), 4: (None, "no catalogue")}
