"""Choices on a form's page, from its words: circle-one lists, yes or no, lists with
pipes, options repeated elsewhere, and runs of spaced options.

A page's words (text, x0, x1, y, h; y grows downwards) are grouped into rows and read in
order, each rule looking at whole rows and their neighbours, so a page is one fold. A
group is a list of options, each with its box; groups come in the order of the rules,
and a later one that overlaps an earlier one by more than half is dropped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from quirespark.operators.shapes import dedupe_groups

MARKER = re.compile(r"\(?\s*circle\s+one\s*\)?", re.I)
CUE = re.compile(r"circle\s+one", re.I)
YES_NO = re.compile(r"\bY\s*/\s*N\b", re.I)
SLASHED = re.compile(r"^[A-Za-z]{2,}(?:/[A-Za-z]{2,})+$")
#: Words that are no option of a run.
STOP = frozenset("and or the of to by for in on a an is are".split())
OPTION = re.compile(r"^[A-Z][A-Za-z]{1,13}$")


@dataclass
class Word:
    text: str
    x0: float
    x1: float
    y: float
    h: float
    delimits: bool = False


@dataclass
class Row:
    y: float
    h: float
    words: list[Word] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join(w.text for w in self.words)

    def at(self, start: int, end: int) -> list[tuple[Word, float]]:
        """The words of a stretch of the row's text, with the middle of each character."""
        out, offset = [], 0
        for w in self.words:
            step = (w.x1 - w.x0) / max(1, len(w.text))
            out += [(w, w.x0 + (k + 0.5) * step) for k in range(len(w.text)) if start <= offset + k < end]
            offset += len(w.text) + 1
        return out


Option = tuple[str, tuple[float, float, float, float]]


def rows_of(words: list[Word]) -> list[Row]:
    """Downwards; a word joins the first row whose first word is within 6, or 0.6 of its height."""
    rows: list[Row] = []
    for w in sorted(words, key=lambda w: w.y):
        row = next((r for r in rows if abs(r.y - w.y) <= max(6.0, 0.6 * w.h)), None)
        if row is None:
            row = Row(w.y, w.h)
            rows.append(row)
        row.words.append(w)
    for row in rows:
        row.words.sort(key=lambda w: w.x0)
    return rows


def boxed(text: str, x0: float, x1: float, y: float, h: float) -> Option:
    """An option's box: a pill around a word, a circle around a letter."""
    pad = h * (0.35 if x1 - x0 > 1.3 * h else 0.7)
    return text, (x0 - pad, y - 1.1 * h, x1 + pad, y + 0.28 * h)


def parts_of(w: Word) -> Iterator[Word]:
    """A slashed word as its parts and the slashes between them, at even steps."""
    step, at = (w.x1 - w.x0) / len(w.text), 0
    for k, part in enumerate(w.text.split("/")):
        if k:
            yield Word("/", w.x0 + step * at, w.x0 + step * (at + 1), w.y, w.h, True)
            at += 1
        yield Word(part, w.x0 + step * at, w.x0 + step * (at + len(part)), w.y, w.h)
        at += len(part)


def without_lead_in(option: list[Word]) -> list[Word]:
    """The last words of one class (amount, word, other): prose before an option goes."""
    kind = lambda w: "n" if re.match(r"[$\d]", w.text) else "w" if re.match("[A-Za-z]", w.text) else "o"
    k = len(option) - 1
    while k > 0 and kind(option[k - 1]) == kind(option[-1]):
        k -= 1
    return option[k:]


def options_of(row: Row, span: tuple[float, float] | None = None, unmarked: bool = False) -> list[Option]:
    """The list of options between pipes or slashes that is nearest the span. Labels,
    blanks and brackets end a list, and so does a wide gap that no delimiter explains."""
    words = [p for w in row.words for p in (parts_of(w) if SLASHED.match(w.text) else (Word(w.text, w.x0, w.x1, w.y, w.h, w.text in ("|", "/")),))]
    lists: list[list[list[Word]]] = []
    open_: list[list[Word]] = [[]]
    before: Word | None = None

    def close() -> None:
        found = [o for o in open_ if o]
        if len(open_) > 1 and len(found) >= 2:
            lists.append(found)
        open_[:] = [[]]

    for w in words:
        if re.search("[_:()]", w.text):
            close()
            before = Word(w.text, w.x0, w.x1, w.y, w.h)
            continue
        if before and w.x0 - before.x1 > 1.6 * w.h and not w.delimits and not before.delimits:
            close()
        if w.delimits:
            open_.append([])
        else:
            open_[-1].append(w)
        before = w
    close()
    if not lists:
        return []

    def away(found: list[list[Word]]) -> float:
        if span is None:
            return 0.0
        lo, hi = min(w.x0 for o in found for w in o), max(w.x1 for o in found for w in o)
        return max(0.0, lo - span[1], span[0] - hi)

    best = min(lists, key=away)
    if unmarked:
        best = [without_lead_in(best[0]), *best[1:]]
    return [boxed(" ".join(w.text for w in o), min(w.x0 for w in o), max(w.x1 for w in o), o[0].y, o[0].h) for o in best]


def circle_one(rows: list[Row]) -> list[list[Option]]:
    """The options that a circle-one cue governs: on its row, else on the next or the one
    before, if near."""
    out = []
    for k, row in enumerate(rows):
        if not (m := MARKER.search(row.text)):
            continue
        marks = row.at(m.start(), m.end())
        span = (min(x for _, x in marks), max(x for _, x in marks)) if marks else None
        found = options_of(row, span)
        if len(found) < 2:
            cue = row.at(*CUE.search(row.text).span())[0][0]
            for other in (rows[k + 1] if k + 1 < len(rows) else None, rows[k - 1] if k else None):
                if other and min(abs(w.y - cue.y) for w in other.words) <= 2.2 * row.h:
                    found = options_of(other, span)
                    if len(found) >= 2:
                        break
        if len(found) >= 2:
            out.append(found)
    return out


def yes_or_no(rows: list[Row]) -> list[list[Option]]:
    out = []
    for row in rows:
        for m in YES_NO.finditer(row.text):
            (y, yx), (n, nx) = row.at(m.start(), m.start() + 1)[0], row.at(m.end() - 1, m.end())[0]
            h = y.h or n.h or 14.0
            out.append([boxed("Y", yx, yx, y.y, h), boxed("N", nx, nx, n.y, h)])
    return out


def between_pipes(rows: list[Row]) -> list[list[Option]]:
    """Lists with a pipe need no cue; rows with one are left to it."""
    found = (options_of(r, unmarked=True) for r in rows if not CUE.search(r.text) and any(w.text == "|" for w in r.words))
    return [f for f in found if len(f) >= 2]


def repeated_slashes(rows: list[Row]) -> list[list[Option]]:
    """A slashed word under a cue is a template: the same word anywhere is the same choice."""
    first = lambda row: next((w.text for w in row.words if SLASHED.match(w.text)), None)
    templates = set()
    for k, row in enumerate(rows):
        if CUE.search(row.text):
            near = (first(r) for r in (row, *rows[k + 1 : k + 2], *rows[max(0, k - 1) : k]))
            templates.add(next((t for t in near if t), None))
    return [[boxed(p.text, p.x0, p.x1, p.y, p.h) for p in parts_of(w) if not p.delimits] for row in rows for w in row.words if w.text in templates]


def spaced_runs(rows: list[Row], cells: list[tuple[float, float, float, float]] = ()) -> list[list[Option]]:
    """Three or more distinct short capitalised words at wide even gaps, with a label that
    ends in a colon to their left, or one above their first; not inside a table's cell."""
    fits = lambda w: bool(OPTION.match(w.text)) and w.text.lower() not in STOP
    out = []
    for k, row in enumerate(rows):
        if CUE.search(row.text):
            continue
        i = 0
        while i < len(row.words):
            j = i
            while j < len(row.words) and fits(row.words[j]):
                j += 1
            run = row.words[i:j]
            i = max(j, i + 1)
            if len(run) < 3 or len({w.text.lower() for w in run}) < len(run):
                continue
            gaps = [b.x0 - a.x1 for a, b in zip(run, run[1:])]
            x, h, above = run[0].x0, run[0].h, rows[k - 1] if k else None
            label = any(w.x1 < x and w.text.endswith(":") for w in row.words) or bool(above and ":" in above.text and any(abs(w.x0 - x) < 1.5 * h for w in above.words))
            inside = any(x < c[2] and run[-1].x1 > c[0] and c[1] - 2 < run[0].y < c[3] + 2 for c in cells)
            if min(gaps) > 0.8 * h and max(gaps) < 2.6 * min(gaps) and label and not inside:
                out.append([boxed(w.text, w.x0, w.x1, w.y, w.h) for w in run])
    return out


RULES = (("circle one", circle_one), ("yes or no", yes_or_no), ("pipes", between_pipes), ("slashes", repeated_slashes), ("run", spaced_runs))


def choices_of(words: list[Word]) -> list[tuple[str, list[Option]]]:
    """(rule, options) of a page; of overlapping groups the first."""
    rows = rows_of(words)
    found = [(name, group) for name, rule in RULES for group in rule(rows)]
    box = lambda g: (min(b[0] for _, b in g), min(b[1] for _, b in g), max(b[2] for _, b in g), max(b[3] for _, b in g))
    return [found[k] for k in dedupe_groups([box(g) for _, g in found])]


CHOICES = "doc_id long, page int, k int, rule string, options string"


def page_choices(group: list[dict]) -> list[dict]:
    """A fold for ``layout.page_fold`` over words (doc_id, page, seq, text, x0, x1, y0, size)."""
    words = [Word(r["text"], r["x0"], r["x1"], r["y0"], r["size"]) for r in group if r["text"]]
    return [{"doc_id": group[0]["doc_id"], "page": group[0]["page"], "k": k, "rule": rule, "options": "|".join(t for t, _ in options)} for k, (rule, options) in enumerate(choices_of(words))]
