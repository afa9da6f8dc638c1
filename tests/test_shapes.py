import random

from quirespark.operators import shapes as S
from quirespark.sources import sinks


def test_dedupe_is_relative_to_the_kept_shape():
    box = lambda x: (x, 0.0, x + 1, 1.0)
    kept = S.dedupe_shapes([("rect", box(0.0)), ("rect", box(0.0005)), ("rect", box(0.001)), ("line", box(0.0))])
    assert [(k, b[0]) for k, b in kept] == [("line", 0.0), ("rect", 0.0), ("rect", 0.001)]


def test_union_area_against_a_raster():
    r = random.Random(1)
    for _ in range(200):
        boxes = [(x, y, x + r.randrange(1, 6), y + r.randrange(1, 6)) for x, y in ((r.randrange(8), r.randrange(8)) for _ in range(r.randrange(6)))]
        cells = {(i, j) for a, b, c, d in boxes for i in range(a, c) for j in range(b, d)}
        assert S.union_area(boxes) == len(cells)


def test_groups_are_greedy():
    assert S.dedupe_groups([(0, 0, 4, 1), (1, 0, 5, 1), (4, 0, 8, 1)]) == [0, 2]


def test_grids():
    across = [(y, 0.0, 20.0) for y in (0.0, 10.0, 20.0)]
    upright = [(x, 0.0, 20.0) for x in (0.0, 10.0, 20.0)]
    assert S.ruled_grids(across, upright) == [([0.0, 10.0, 20.0], [0.0, 10.0, 20.0], True)]
    assert S.ruled_grids(across, [*upright[:2], (20.0, 0.0, 10.0)])[0][2] is False
    assert S.ruled_grids([(0.0, 0.0, 9.5), (0.2, 10.0, 20.0), *across[1:]], upright)[0][0] == [0.0, 10.0, 20.0]


def test_breaking_and_addresses():
    assert S.break_greedy([3, 4, 9, 1], 8, sum) == [[3, 4], [9], [1]]
    assert [S.routable(a) for a in ("8.8.8.8", "10.0.0.1", "::1", "::ffff:192.168.0.1", "x", "100.64.1.1", "::c0a8:101%eth0", "2606:4700::1%3")] == [True, False, False, False, False, False, False, True]


def test_fields():
    assert S.propose_fields([(0, 0, 10, 10), (0, 0, 30, 10)], [(50.0, 0.0, 100.0), (5.0, 0.0, 100.0), (90.0, 0.0, 10.0)], []) == [("check", (0, 0, 10, 10)), ("text", (0.0, 35.0, 100.0, 50.0))]


def test_tokens_cover_the_stream():
    r = random.Random(2)
    for _ in range(300):
        data = bytes(r.choice(b"()<>[]/%\\ \n0.5aT-") for _ in range(r.randrange(40)))
        tokens = sinks.content_tokens(data)
        assert b"".join(data[a:b] for _, a, b in tokens) == data
    assert [k for k, _, _ in sinks.content_tokens(b"/F1 12 Tf (a(b)\\)) Tj")] == ["name", "space", "number", "space", "word", "space", "string", "space", "word"]
    assert sinks.edited(b"abcdef", []) == b"abcdef" and sinks.edited(b"abcdef", [(4, 5, b"X"), (0, 2, b"")]) == b"cdXf"


def test_unicode_map():
    cmap = "1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <02> <04> <0061> <10> <11> [<0066 0069> <0078>] endbfrange".replace("0066 0069", "00660069")
    assert sinks.unicode_map(cmap) == {"01": "A", "02": "a", "03": "b", "04": "c", "10": "fi", "11": "x"}


def test_form_records_nest_and_refuse_entities():
    fields = [("a.b", "1"), ("a.c", "<2>"), ("a.b", "3"), ("d", "")]
    assert sorted(sinks.read_xfdf(sinks.write_xfdf(fields))) == sorted(fields)
    try:
        sinks.read_xfdf("<!DOCTYPE x><xfdf/>")
    except ValueError:
        return
    raise AssertionError("a document type was read")


def test_many_rules_are_merged_and_crossed_once():
    """Rules are compared with those near them and crossings are found once, so that a page of many is no square of squares."""
    n, seen = 400, [0]

    class Place(float):
        def __sub__(self, other):
            seen[0] += 1
            return float.__sub__(self, other)

        def __rsub__(self, other):
            seen[0] += 1
            return float.__rsub__(self, other)

    merged = S.merge_rules([(Place(4 * k), 0.0, 9.0) for k in range(n)])
    assert len(merged) == n and seen[0] <= 4 * n
    assert S.ruled_grids([(0.0, 0.0, 20.0), (10.0, 0.0, 20.0)], [(4.0 * k, -2.0, 20.0) for k in range(9)]) == []
    assert S.union_area([(0.0, 5.0, 4.0, 1.0), (0.0, 0.0, 4.0, 2.0)]) == 8.0
