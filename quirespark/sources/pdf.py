"""Reading PDF: objects, pages, decoded content, and the runs of text that a page shows.

A file is read as a document at a time; each step is one function, bounded, and what a
broken or hostile file raises is its refusal. Content tokens and character maps are
those of ``sinks``. ``write_pdf`` makes small files, for tests and fixtures.

Objects are found by scanning for "n g obj", the last of a number wins, as a reader that
repairs a file does; object streams are expanded. Encrypted files are refused."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from quirespark.functions.arrow import PIECE
from quirespark.sources.sinks import content_tokens, unicode_map

#: Bounds: bytes of one decoded stream and of a file's, objects, pages, depth, runs of a page.
STREAM_BYTES, FILE_BYTES, OBJECTS, PAGES, DEPTH, RUNS = 64 << 20, 512 << 20, 500_000, 50_000, 64, 200_000

OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
Matrix = tuple[float, float, float, float, float, float]


class Name(str):
    """A name, apart from a string."""


class Ref(int):
    """A reference to an object."""


class Stream:
    def __init__(self, info: dict, raw: bytes):
        self.info, self.raw = info, raw


def string_of(token: bytes) -> bytes:
    """A literal string's bytes: escapes, octal codes and joined lines."""
    def one(m):
        c = m[1]
        return {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(c) or (b"" if c in (b"\n", b"\r\n", b"\r") else bytes([int(c, 8) & 255]) if c[:1].isdigit() else c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def values(data: bytes) -> Iterator:
    """The values and operators of a piece of syntax: numbers, names, strings, arrays,
    dictionaries, references; an operator is a plain ``bytes``."""
    stack: list[tuple[bytes, list]] = [(b"", [])]

    def put(x):
        own = stack[-1][1]
        if x == b"R" and len(own) >= 2 and all(type(v) is int for v in own[-2:]):
            own[-2:] = [Ref(own[-2])]
        else:
            own.append({b"true": True, b"false": False, b"null": None}.get(x, x) if type(x) is bytes else x)

    for kind, a, b in content_tokens(data):
        t = data[a:b]
        if kind in ("space", "comment"):
            continue
        if kind == "open":
            if len(stack) > DEPTH:
                raise ValueError("nested too deep")
            stack.append((t, []))
        elif kind == "close":
            if len(stack) > 1:
                opened, own = stack.pop()
                put(dict(zip(own[::2], own[1::2])) if opened == b"<<" else own)
        elif kind == "number":
            put(float(t) if b"." in t else int(t))
        elif kind == "name":
            put(Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1")))
        elif kind == "string":
            put(String(string_of(t)))
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", t[1:-1])
            put(String(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())))
        else:
            put(t)
        if len(stack) == 1 and stack[0][1]:
            # A number may still become a reference: keep two back.
            while len(stack[0][1]) > 2 or stack[0][1] and type(stack[0][1][-1]) is not int:
                yield stack[0][1].pop(0)
    yield from stack[0][1]


class String(bytes):
    """A string's bytes, apart from an operator."""


class Document:
    """A file's objects, each parsed when asked for."""

    def __init__(self, data: bytes):
        if not re.search(rb"%PDF-\d", data[:1024]):
            raise ValueError("no header")
        self.data, self.spent, self.seen = data, 0, {}
        self.at = {int(m[1]): m.end() for m in OBJECT.finditer(data)}
        if len(self.at) > OBJECTS:
            raise ValueError("too many objects")
        trailers = [d for m in re.finditer(rb"trailer\s*(?=<<)", data) if isinstance(d := next(values(data[m.end() :]), None), dict)]
        self.packed = {}
        for n in list(self.at):
            head = data[self.at[n] : data.find(b"stream", self.at[n]) + 1 or len(data)]
            if head.lstrip()[:2] == b"<<" and (b"/ObjStm" in head or b"/XRef" in head) and isinstance(s := self.get(Ref(n)), Stream):
                if s.info.get("Type") == "XRef":
                    trailers.append(s.info)
                elif s.info.get("Type") == "ObjStm":
                    body, first = self.decoded(s), int(s.info["First"])
                    numbers = [int(x) for x in body[:first].split()]
                    for k, o in zip(numbers[::2], numbers[1::2]):
                        self.packed.setdefault(k, (body, first + o))
        self.trailer = {k: v for t in trailers for k, v in t.items()}
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")
        self.root = self.get(self.trailer.get("Root"))
        if not isinstance(self.root, dict):
            self.root = next((d for n in self.at if isinstance(d := self.get(Ref(n)), dict) and d.get("Type") == "Catalog"), None)
        if self.root is None:
            raise ValueError("no catalogue")

    def get(self, x):
        """What a reference leads to; anything else is itself."""
        for _ in range(DEPTH):
            if not isinstance(x, Ref):
                return x
            if x not in self.seen:
                self.seen[x] = self.parsed(x)
            x = self.seen[x]
        raise ValueError("references in a circle")

    def parsed(self, n: int):
        if n not in self.at:
            body, at = self.packed.get(n, (b"null", 0))
            return next(values(body[at:]), None)
        start = self.at[n]
        end = self.data.find(b"endobj", start)
        body = self.data[start : end if end >= 0 else len(self.data)]
        m = re.search(rb">>\s*stream\r?\n", body)
        found = next(values(body[: m.start() + 2] if m else body), None)
        if m and isinstance(found, dict):
            begin, length = start + m.end(), found.get("Length")
            self.seen[n] = None  # a length that leads back here
            length = self.get(length)
            if not isinstance(length, int) or length < 0 or self.data[begin + length : begin + length + 20].lstrip()[:9] != b"endstream":
                stop = self.data.find(b"endstream", begin)
                length = (stop if stop >= 0 else len(self.data)) - begin
            return Stream(found, self.data[begin : begin + length])
        return found

    def decoded(self, s: Stream) -> bytes:
        """A stream's bytes within the bounds; a filter that is not plain compression refuses."""
        filters = self.get(s.info.get("Filter")) or []
        data = s.raw
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) in ("FlateDecode", "Fl"):
                packed = zlib.decompressobj()
                data = packed.decompress(data, STREAM_BYTES)
                if packed.unconsumed_tail:
                    raise ValueError("a stream is too large")
            elif self.get(f) in ("ASCIIHexDecode", "AHx"):
                data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0]).decode())
            else:
                raise ValueError(f"filter {f}")
        self.spent += len(data)
        if self.spent > FILE_BYTES:
            raise ValueError("the streams are too large")
        return self.predicted(s, data)

    def predicted(self, s: Stream, data: bytes) -> bytes:
        parms = self.get(s.info.get("DecodeParms"))
        if not isinstance(parms, dict) or parms.get("Predictor", 1) < 10:
            return data
        width, out, before = int(parms.get("Columns", 1)), [], None
        before = bytes(width)
        for k in range(0, len(data), width + 1):
            row = bytearray(data[k + 1 : k + 1 + width])
            if data[k] == 2:
                row = bytearray((a + b) & 255 for a, b in zip(row, before))
            elif data[k]:
                raise ValueError("predictor")
            out.append(before := bytes(row))
        return b"".join(out)

    def pages(self) -> list[dict]:
        """Pages in order, each with what it inherits; one walk, each node once."""
        out, seen, waiting = [], set(), [(self.root.get("Pages"), {}, 0)]
        while waiting:
            ref, above, depth = waiting.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or isinstance(ref, Ref) and ref in seen or depth > DEPTH:
                continue
            seen.add(ref if isinstance(ref, Ref) else id(node))
            own = above | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                waiting += [(k, own, depth + 1) for k in reversed(kids)]
            else:
                out.append(own | node)
            if len(out) > PAGES:
                raise ValueError("too many pages")
        return out

    def content(self, page: dict) -> bytes:
        """A page's content streams, joined by a line end as one."""
        found = self.get(page.get("Contents"))
        streams = [self.get(x) for x in found] if isinstance(found, list) else [found]
        return b"\n".join(self.decoded(s) for s in streams if isinstance(s, Stream))

    def box(self, page: dict) -> tuple[float, float, float, float]:
        box = [float(self.get(x)) for x in self.get(page.get("CropBox")) or self.get(page.get("MediaBox")) or (0, 0, 612, 792)]
        return min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])


def times(a: Matrix, b: Matrix) -> Matrix:
    return a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]


class Font:
    """Codes to text and widths (in thousandths)."""

    def __init__(self, doc: Document, info: dict):
        self.wide = info.get("Subtype") == "Type0"
        to = doc.get(info.get("ToUnicode"))
        self.map = unicode_map(doc.decoded(to).decode("latin-1")) if isinstance(to, Stream) else {}
        self.first, self.widths = doc.get(info.get("FirstChar")) or 0, [doc.get(w) for w in doc.get(info.get("Widths")) or []]
        self.default = 1000 if self.wide else 500

        self.texts, self.advances = Texts(self), {}

    def codes(self, data: bytes) -> tuple[int, ...] | bytes:
        return struct.unpack(f">{len(data) // 2}H", data[: len(data) // 2 * 2]) if self.wide else data

    def width(self, code: int) -> float:
        at = code - self.first
        return float(self.widths[at] if 0 <= at < len(self.widths) else self.default)

    def moves(self, size: float, char: float, word: float, scale: float, along: float) -> Advances:
        """How far each code moves on, by what holds for it; ``along`` is the matrix's own."""
        key = (size, char, word, scale, along)
        if key not in self.advances:
            if len(self.advances) >= 64:
                self.advances.clear()
            self.advances[key] = Advances(self, *key)
        return self.advances[key]


class Texts(dict):
    """A font's codes to text, each found once."""

    def __init__(self, font: Font):
        self.font = font

    def __missing__(self, code: int) -> str:
        font = self.font
        self[code] = found = font.map.get(f"{code:0{4 if font.wide else 2}X}", "�" if font.wide else bytes([code]).decode("cp1252", "replace"))
        return found


class Advances(dict):
    """A font's codes to how far they move on, each found once."""

    def __init__(self, font: Font, size: float, char: float, word: float, scale: float, along: float):
        self.font, self.values_of = font, (size, char, word, scale, along)

    def __missing__(self, code: int) -> float:
        size, char, word, scale, along = self.values_of
        blank = not self.font.wide and code == 32
        self[code] = found = (self.font.width(code) / 1000 * size + char + (word if blank else 0)) * scale * along
        return found


IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def runs_of(doc: Document, page: dict) -> list[dict]:
    """The page's runs: text, its box and size in the page's space, and whether it is drawn
    visibly. A string shown is a run; a form that is drawn brings its own."""
    out: list[dict] = []

    def fonts_of(resources) -> dict:
        found = doc.get((doc.get(resources) or {}).get("Font")) or {}
        return {name: doc.get(f) for name, f in found.items()}

    def walk(content: bytes, resources, ctm: Matrix, depth: int, inside: frozenset) -> None:
        fonts, made, saved = fonts_of(resources), {}, []
        state = {"ctm": ctm, "font": None, "size": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0, "mode": 0}
        tm = tlm = IDENTITY
        args: list = []

        def show(items) -> None:
            nonlocal tm
            font, size, text = state["font"], state["size"], ""
            begin = tm
            for x in items:
                if isinstance(x, (int, float)):
                    tm = times((1, 0, 0, 1, -x / 1000 * size * state["scale"], 0), tm)
                    if -x > 250 and text and not text.endswith(" "):
                        text += " "
                elif isinstance(x, String) and font:
                    codes = font.codes(x)
                    text += "".join(map(font.texts.__getitem__, codes))
                    # A code moves the matrix along itself, so only its last two numbers change.
                    ends = (reduce(add, map(font.moves(size, state["char"], state["word"], state["scale"], along).__getitem__, codes), at) if along else at for along, at in ((tm[0], tm[4]), (tm[1], tm[5])))
                    tm = (*tm[:4], *ends)
            if text and len(out) >= RUNS:
                raise ValueError("too many text runs on a page")
            if text:
                a, b = times((1, 0, 0, 1, 0, state["rise"]), times(begin, state["ctm"])), times(tm, state["ctm"])
                height = size * (a[2] ** 2 + a[3] ** 2) ** 0.5
                out.append({"text": text, "x0": min(a[4], b[4]), "y0": a[5], "x1": max(a[4], b[4]), "y1": a[5] + height, "size": round(height, 3), "visible": state["mode"] != 3})

        for v in values(content):
            if type(v) is not bytes:
                args.append(v)
                continue
            try:
                if v == b"q":
                    saved.append(dict(state))
                elif v == b"Q" and saved:
                    state = saved.pop()
                elif v == b"cm":
                    state["ctm"] = times(tuple(map(float, args[-6:])), state["ctm"])
                elif v == b"BT":
                    tm = tlm = IDENTITY
                elif v == b"Tf":
                    name = args[-2]
                    if name not in made:
                        made[name] = Font(doc, fonts[name]) if isinstance(fonts.get(name), dict) else None
                    state["font"], state["size"] = made[name], float(args[-1])
                elif v in (b"Td", b"TD"):
                    if v == b"TD":
                        state["lead"] = -float(args[-1])
                    tm = tlm = times((1, 0, 0, 1, float(args[-2]), float(args[-1])), tlm)
                elif v == b"Tm":
                    tm = tlm = tuple(map(float, args[-6:]))
                elif v == b"T*":
                    tm = tlm = times((1, 0, 0, 1, 0, -state["lead"]), tlm)
                elif v in (b"Tc", b"Tw", b"TL", b"Ts", b"Tr", b"Tz"):
                    key = {b"Tc": "char", b"Tw": "word", b"TL": "lead", b"Ts": "rise", b"Tr": "mode", b"Tz": "scale"}[v]
                    state[key] = args[-1] / 100 if v == b"Tz" else args[-1]
                elif v == b"Tj":
                    show(args[-1:])
                elif v == b"TJ":
                    show(args[-1])
                elif v in (b"'", b'"'):
                    if v == b'"':
                        state["word"], state["char"] = args[-3], args[-2]
                    tm = tlm = times((1, 0, 0, 1, 0, -state["lead"]), tlm)
                    show(args[-1:])
                elif v == b"Do" and depth < 16:
                    forms = doc.get((doc.get(resources) or {}).get("XObject")) or {}
                    ref = forms.get(args[-1])
                    form = doc.get(ref)
                    if isinstance(form, Stream) and form.info.get("Subtype") == "Form" and ref not in inside:
                        matrix = tuple(float(doc.get(x)) for x in doc.get(form.info.get("Matrix")) or IDENTITY)
                        walk(doc.decoded(form), form.info.get("Resources", resources), times(matrix, state["ctm"]), depth + 1, inside | {ref})
            except (IndexError, TypeError, KeyError):
                pass  # an operator without its operands does nothing
            args.clear()

    walk(doc.content(page), page.get("Resources"), IDENTITY, 0, frozenset())
    return out


def write_pdf(pages: list[list[tuple[float, float, float, str]]], box=(0, 0, 612, 792)) -> bytes:
    """A small file: of each page the lines (x, y, size, text) in one font with a character map."""
    chars = sorted({c for page in pages for *_, text in page for c in text})
    code = {c: k + 1 for k, c in enumerate(chars)}
    shown = {c: f"{k:04X}" for c, k in code.items()}
    cmap = "".join(f"{len(part)} beginbfchar {' '.join(f'<{code[c]:04X}> <{c.encode('utf-16-be').hex()}>' for c in part)} endbfchar\n" for part in (chars[k : k + 100] for k in range(0, len(chars), 100)))
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count %d/Kids[%s]/MediaBox[%s]/Resources<</Font<</F1 3 0 R>>>>>>" % (len(pages), b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages))), " ".join(map(str, box)).encode())]

    def stream(data: bytes) -> bytes:
        packed = zlib.compress(data)
        return b"<</Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (len(packed), packed)

    objects += [b"<</Type/Font/Subtype/Type0/BaseFont/F/Encoding/Identity-H/ToUnicode 4 0 R>>", stream(cmap.encode())]
    for k, page in enumerate(pages):
        body = "".join(f"BT /F1 {size:g} Tf 1 0 0 1 {x:g} {y:g} Tm <{''.join(map(shown.__getitem__, text))}> Tj ET\n" for x, y, size, text in page)
        objects += [b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (6 + 2 * k), stream(body.encode())]
    out = bytearray(b"%PDF-1.7\n")
    offsets = []
    for n, o in enumerate(objects, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


#: Rows of a batch, after which it goes on.
ROWS = 2000

RUN_FIELDS = [("page", pa.int32()), ("seq", pa.int32()), ("text", pa.string()), ("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64()), ("size", pa.float64()), ("visible", pa.bool_())]
PAGE_FIELDS = [("page", pa.int32()), ("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64()), ("rotate", pa.int32()), ("content_bytes", pa.int64())]


def read_pdf(files: DataFrame, key: str, column: str, rows_of, fields) -> DataFrame:
    """key, fields, refusal: ``rows_of`` a file's document; a file that cannot be read is
    one row with its refusal."""
    names = [n for n, _ in fields]
    kind = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rows of several files make a batch, within a bound: one for each file costs more than its rows.
            held, whose, whys, size = [], [], [], 0
            for k, data in enumerate(batch.column(1)):
                content = data.as_py() or b""
                try:
                    rows, why = rows_of(Document(content)), None
                except Exception as e:  # noqa: BLE001  whatever a broken file raises is its refusal
                    rows, why = [{}], str(e)[:200] or type(e).__name__
                held += rows
                whose += [k] * len(rows)
                whys += [why] * len(rows)
                size += len(content)
                if len(held) >= ROWS or size >= PIECE:
                    yield packed(batch, held, whose, whys)
                    held, whose, whys, size = [], [], [], 0
            yield packed(batch, held, whose, whys)

    def packed(batch: pa.RecordBatch, rows: list[dict], whose: list[int], whys: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), *(pa.array([r.get(n) for r in rows], t) for n, t in fields), pa.array(whys, pa.string())], [key, *names, "refusal"])

    own = files.schema[key].dataType.simpleString()
    return files.select(key, column).mapInArrow(run, f"`{key}` {own}, " + ", ".join(f"{n} {kind[t]}" for n, t in fields) + ", refusal string")


def pdf_runs(files: DataFrame, key: str = "doc_id", column: str = "content") -> DataFrame:
    return read_pdf(files, key, column, lambda doc: [{"page": p, "seq": k, **r} for p, page in enumerate(doc.pages()) for k, r in enumerate(runs_of(doc, page))], RUN_FIELDS)


def pdf_pages(files: DataFrame, key: str = "doc_id", column: str = "content") -> DataFrame:
    def pages(doc: Document) -> list[dict]:
        return [{"page": p, **dict(zip(("x0", "y0", "x1", "y1"), doc.box(page))), "rotate": int(doc.get(page.get("Rotate")) or 0) % 360, "content_bytes": len(doc.content(page))} for p, page in enumerate(doc.pages())]

    return read_pdf(files, key, column, pages, PAGE_FIELDS)
