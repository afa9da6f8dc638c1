"""The training-data operators against brute force, and on nulls, empty texts, ties,
repeated rows, empty tables and clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.llm import common, components, exact_dedup, fingerprints, induced_sort, licenses, line_dedup, mixing, near_dedup, packing, queries, shingles, sql, suffix_dedup, toxicity, warc
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, node string, kept string, norm string, _id long, turn string"


def docs_of(spark, texts, sources=None):
    """Documents with null and clashing columns beside the texts."""
    rows = [(i, t, None, sources[k] if sources else f"s{k % 3}", None, "h", "n", "k", "x", -1, "t") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = "word " * 3000
PASSAGE = "A passage of a good many words that stands in several of these texts, word for word, and is longer than one hundred bytes. "


def odd_texts():
    """Null, empty, white, ties, repeated rows, a null id, long texts."""
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(("ba", "ko", "lu", "mi", "ne", "so", "tu")) + r.choice("xyz") for _ in range(n))
    near = text(60)
    return [
        (0, None), (1, ""), (2, " \n\t"), (3, near), (4, near + " end"), (5, near.upper()), (6, near.replace(" ", "\n")), (7, LONG), (8, LONG), (9, PASSAGE + text(20)),
        (10, text(30) + " " + PASSAGE), (11, "é" * 300), (12, "é" * 300), (13, "one two"), (13, "one two"), (14, "one  two"), (None, "no id"), (15, text(40)), (16, "x" * 250),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, odd_texts())


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_sql_queries(spark):
    c = connect(FOLDER)
    for name, text in sql.oracle_sql().items():
        same(queries.queries()[name](spark, FOLDER), c, text)


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        line_dedup.drop_common_blocks(none), warc.archived(pages), packing.pack_documents(none, queries.tokenizer_path()), suffix_dedup.remove_repeats(none), fingerprints.fingerprints(none), toxicity.toxicity(none, labels),
        licenses.scan(none), near_dedup.near_groups(none), exact_dedup.exact_groups(none), mixing.mix(none), mixing.mixed_documents(none), exact_dedup.drop_copies(none), near_dedup.drop_near_copies(none), toxicity.drop_toxic(none, labels),
    ):
        assert df.collect() == []


# 1. Line dedup.


def test_patience_aligns_unique_lines():
    assert line_dedup.patience([1, 2, 3, 2, 4], [9, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]
    assert line_dedup.patience([1, 1], [1, 1]) == []
    assert line_dedup.common_lines([1, 2, 3], [3, 1, 2], [30, 30, 30]) == [1, 2]


def test_alignment_goes_on_between_anchors():
    assert line_dedup.common_lines([1, 1], [1, 1], [60, 60]) == [0, 1]
    assert line_dedup.aligned([5, 1, 1, 6, 7, 1], [1, 5, 1, 1, 6, 1]) == [(0, 1), (1, 2), (2, 3), (3, 4), (5, 5)]
    r = random.Random(7)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in range(2))
        least = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            least[i + 1][j + 1] = least[i][j] + 1 if a[i] == b[j] else max(least[i][j + 1], least[i + 1][j])
        assert len(line_dedup.longest_common(a, b)) == least[-1][-1]
        for found in (line_dedup.longest_common(a, b), line_dedup.aligned(a, b)):
            assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(found))


def naive_lines(texts):
    lines = {i: [x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n")] for i, t in texts}
    gone = defaultdict(set)
    for a, b in itertools.combinations(sorted(lines), 2):
        shared = {x for x in lines[a] if len(x) >= line_dedup.LEAST_CHARS} & set(lines[b])
        if shared:
            number = {x: k for k, x in enumerate({*lines[a], *lines[b]})}
            gone[b] |= set(line_dedup.common_lines([number[x] for x in lines[a]], [number[x] for x in lines[b]], [len(x) for x in lines[b]]))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts}


def test_line_dedup_against_all_pairs(spark):
    r = random.Random(3)
    block = [f"line number {k} of a shared block" for k in range(6)]
    texts = [(i, "\n".join([f"own line {i} {k} {r.random()}" for k in range(3)] + block[r.randrange(3) : r.randrange(3, 7)] + [f"tail of {i}, its own, {r.random()}"])) for i in range(4)]
    got = {r.doc_id: r.text for r in line_dedup.drop_common_blocks(docs_of(spark, texts)).collect()}
    assert got == naive_lines(texts)


def test_frequent_lines_against_all_pairs(spark):
    p, q, z = ("a passage that stands in most of these texts, of some length", "another passage that most of them hold, and long enough", "a third one, which is there more than once in some of them")
    short = ["first half, 25 characters", "other half, 25 characters", "menu", "home", ""]
    own = lambda i, k: f"own line {i} {k}"
    r = random.Random(11)
    parts = [[p, own(0, 0), q], *([q, own(i, 0), p] for i in range(1, 7)), [p, own(7, 0), p], [short[0]], [short[1]], *([short[0], short[1]] for _ in range(8))]
    parts += [[r.choice((p, q, z, *short, own(len(parts) + k, j))) for j in range(r.randrange(1, 9))] for k in range(60)]
    texts = [(i, "\n".join(x)) for i, x in enumerate(parts)]
    got = {x.doc_id: x.text for x in line_dedup.drop_common_blocks(docs_of(spark, texts)).collect()}
    assert got == naive_lines(texts)


def test_a_pair_with_a_rare_line_is_decided_once(spark):
    """Frequent lines beside rare ones: what aligns them in one order leaves them out in another."""
    line = lambda k: f"line {k} of a block, over forty characters long, so it counts"
    texts = [(1, [line(1), line(2), line(3), line(0)]), (2, [line(0), line(1), line(2), line(3)]), *((k, [line(0)]) for k in range(3, 10))]
    texts = [(i, "\n".join(x)) for i, x in texts]
    got = {x.doc_id: x.n_removed for x in line_dedup.drop_common_blocks(docs_of(spark, texts)).collect()}
    assert got == {1: 0, 2: 3, **{k: 1 for k in range(3, 10)}}
    r = random.Random(23)
    for _ in range(4):
        blocks = [[f"rare {b} {k} of a block, {'long ' * r.randrange(1, 5)}enough" for k in range(4)] for b in range(25)]
        texts = []
        for i in range(90):
            parts = [line(r.randrange(9)) for _ in range(r.randrange(5))] + [x for b in r.sample(range(25), r.randrange(3)) for x in blocks[b][r.randrange(2) :]] + ["menu"] * r.randrange(2)
            r.shuffle(parts)
            texts.append((i, "\n".join(parts)))
        got = {x.doc_id: x.text for x in line_dedup.drop_common_blocks(docs_of(spark, texts)).collect()}
        assert got == naive_lines(texts)


def test_line_dedup_keeps_rows_of_one_id_apart(spark):
    block = "a block of one line that several of these rows hold, long enough"
    texts = [(1, block + "\nfirst"), (5, "clean\nrows\nof five"), (5, "own\n" + block), (None, block + "\nnull one"), (None, "null two\n" + block), (None, "clean null")]
    got = Counter((x.doc_id, x.n_removed, x.text) for x in line_dedup.drop_common_blocks(docs_of(spark, texts)).collect())
    assert got == Counter([(1, 0, block + "\nfirst"), (5, 0, "clean\nrows\nof five"), (5, 1, "own"), (None, 1, "null one"), (None, 1, "null two"), (None, 0, "clean null")])


def test_line_dedup_rows(odd):
    got = line_dedup.drop_common_blocks(odd).collect()
    assert len(got) == len(odd_texts())
    assert {r.doc_id: (r.n_lines, r.text) for r in got}[0] == (0, "")
    frequent = {r.doc_id: r.n_removed for r in got}
    assert frequent[8] == 1 and frequent[7] == 0  # the later of two equal long lines


# 2. WARC.


def test_warc_round_trip(spark):
    long_ = "<p>" + "é" * 200
    rows = [(1, "http://a", None), (2, None, long_), (3, "u\r\nX: y", long_), (4, "", "x"), (5, "z", "x"), (None, "n", "tail"), (6, "q", "WARC/1.1\r\n\r\n" * 40)]
    got = {r.page_id: r for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type != "response"} == {3: ("revisit", 2)}


def test_warc_rows_without_an_id_and_of_one_id(spark):
    long_, schema = "<p>" + "x" * 200, "page_id long, url string, html string, payload string, digest string, first long"
    rows = [(3, "a", long_), (None, "b", long_), (4, "c", long_), (3, "d", long_), (None, "e", "y" * 100), (None, "f", "y" * 100), (9, "g", "z" * 99), (10, "h", "z" * 99), (11, None, "q" * 3_000_000)]
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame([(*r, "x", "y", -1) for r in rows], schema)).collect())
    assert got == Counter([(3, 203, "response", None), (None, 203, "revisit", 3), (4, 203, "revisit", 3), (3, 203, "response", None), (None, 100, "response", None), (None, 100, "response", None), (9, 99, "response", None), (10, 99, "response", None), (11, 3_000_000, "response", None)])


def test_warc_ids_that_are_text(spark):
    long_ = "w" * 150
    rows = [("None", "a", long_), (None, "b", long_), ("a>\r\nX: y", "c", long_), ("é b", "d", "")]
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {("None", "response", None), (None, "revisit", "None"), ("a>\r\nX: y", "revisit", "None"), ("é b", "response", None)}


def test_the_sidecar_index_is_what_is_read(spark):
    folder = common.stage_path(spark, "sidecar")
    pages = spark.createDataFrame([(k, f"http://{k}", f"<p>{k}" * 50) for k in range(40)], "page_id long, url string, html string")
    files = common.staged(warc.normalise(common.staged(warc.write_archives(warc.marked(pages), f"{folder}/one"), "w"), f"{folder}/two"), "f")
    lines = warc.index_lines(files).collect()
    assert len(lines) == 40 == sum(r.records for r in files.collect())
    for path in {x.path for x in lines}:
        own = sorted((x.offset, x.length) for x in lines if x.path == path)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own))


def test_records_refuse_a_cut_stream():
    one = warc.record(1, "u", b"data", "d", None)
    assert len(list(warc.records(iter([one[:50], one[50:], one])))) == 2
    with pytest.raises(ValueError):
        list(warc.records(iter([one[:-3]])))


# 3. Packing.


def test_plan_uses_each_length_as_often_as_it_is_there():
    r = random.Random(1)
    for limit in (8, 50):
        for _ in range(40):
            counts = {k: n for k in range(1, limit + 1) if (n := r.randrange(4))}
            patterns = packing.plan(counts, limit)
            used = Counter()
            for bin_, times in patterns:
                assert sum(bin_) <= limit
                for x in bin_:
                    used[x] += times
            assert used == Counter(counts)
            bins, least = sum(t for _, t in patterns), -(-sum(k * n for k, n in counts.items()) // limit)
            assert bins <= 1.1 * least + 3


def test_exact_complements():
    rest = packing.Complements({3: 1, 4: 1, 2: 2}, 10)
    assert rest.exact(3, [4]) == (3,) and rest.exact(7, []) == (4, 3) and rest.exact(8, []) == (4, 2, 2) and rest.exact(10, [3]) is None


def test_packing_rows(spark, odd):
    import numpy as np
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(queries.tokenizer_path()).encode
    rows = packing.pack_documents(odd, queries.tokenizer_path(), limit=256).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in {i: t for i, t in odd_texts()}.items():
        ids = encode(t or "", add_special_tokens=False).ids + [1]
        copies = 2 if i == 13 else 1
        assert sum(r.length for r in by[i]) == copies * len(ids)
        for r in by[i]:
            part = ids[r.start : r.start + r.length]
            assert r.start == 256 * r.piece and r.length == min(256, len(ids) - r.start) and r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 256


def test_chunked_ids_are_the_tokenizers(spark):
    chunks = packing.ChunkIds(queries.tokenizer_path())
    encode = chunks.tokenizer.encode
    for text in ("İstanbul ΣΑΣ x\x85y  <|endoftext|> a<|startoftext|>b don't I'LL 12a3 ÀÉß µ ª ÿ é Å", "", "  ", "日本 語", "x" * 300, "a,,b.. c.,", " \x0b\x0c\x1c\x1da", "Größe. Été, NAÏVE"):
        ids = encode(text, add_special_tokens=False).ids
        assert chunks.of(text) == packing.pack_ids(ids)


# 4. Suffix arrays.


def test_rough_orders_carry_no_lengths(monkeypatch):
    """Substrings between LMS positions are put in order by positions alone; lengths are found once, in the last scan."""
    made, r = [], random.Random(8)
    own = induced_sort.Least

    class Counted(own):
        def __init__(self, top, depth):
            made.append(depth)
            super().__init__(top, depth)

    monkeypatch.setattr(induced_sort, "Least", Counted)
    data = bytes(r.choice(b"abc") for _ in range(3000))
    with induced_sort.sorted_suffixes(data, 12) as got:
        order, lengths = got[:, 0].tolist(), got[:, 1].tolist()
    assert made == [12, 12] and [data[a:][:12] for a in order] == sorted(data[a:][:12] for a in range(len(data)))
    assert lengths[1:] == [next((k for k in range(12) if data[a + k : a + k + 1] != data[b + k : b + k + 1]), 12) for a, b in zip(order, order[1:])]
    values = np.array([r.randrange(50) for _ in range(300)], np.int32)
    pairs = np.array([sorted((r.randrange(300), r.randrange(300))) for _ in range(400)])
    for part in (pairs, pairs[:3]):  # from the table, and range by range
        assert induced_sort.range_least(values, part[:, 0], part[:, 1]).tolist() == [values[a : b + 1].min() for a, b in part.tolist()]


def test_induced_sort_against_brute_force(monkeypatch):
    r = random.Random(1)
    induced_sort.COUNTS.clear()
    for t in range(300):
        monkeypatch.setattr(induced_sort, "PIECE", r.choice((3, 16, 1 << 16)))
        data = bytes(r.choice(r.choice((b"ab", b"abc", b"a", b"\x00\xff"))) for _ in range(r.randint(1, 60)))
        data = (data * 5)[:200] if t % 5 == 0 else data
        depth = r.choice((1, 3, 10, 100))
        lcp = lambda i, j: next((k for k in range(depth) if data[i + k : i + k + 1] != data[j + k : j + k + 1] or i + k >= len(data)), depth)
        with induced_sort.sorted_suffixes(data, depth, budget=r.choice((64, 1 << 20)), base=r.choice((1, 4, 1 << 20))) as got:
            order = got[:, 0].tolist()
            assert sorted(order) == list(range(len(data)))
            prefixes = [data[p : p + depth] for p in order]  # order within a shared depth is free
            assert prefixes == sorted(prefixes)
            assert got[:, 1].tolist() == [lcp(order[k - 1], p) if k else 0 for k, p in enumerate(order)]
    assert induced_sort.COUNTS["spills"] and induced_sort.COUNTS["recursions"]


def test_a_shard_larger_than_its_budgets():
    """Names recurse, queues spill, and the shard's tuples (twelve times its bytes) are files."""
    import tracemalloc

    r = random.Random(2)
    data = b"".join(r.choice((b"the ", b"of a ", b"word", b"sort ", b" in ", b"disk")) for _ in range(40_000))
    induced_sort.COUNTS.clear()
    tracemalloc.start()
    with induced_sort.sorted_suffixes(data, 100, budget=1 << 14, base=1 << 12) as got:
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        order = got[:, 0].astype(int)
        assert len(order) == len(data) == len(set(order.tolist()))
        for at in range(0, len(order) - 1, 7):
            a, b = (data[order[at + k] : order[at + k] + 100] for k in (0, 1))
            assert a <= b and got[at + 1, 1] == next((k for k in range(100) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), 100)
    assert induced_sort.COUNTS["spills"] > 20 and induced_sort.COUNTS["recursions"] >= 1 and most < 24 << 20


def test_repetitive_text_is_few_segments(spark):
    texts = [(1, "a" * 1_000_000), (2, "ab" * 200_000), (3, "xyz" + "a" * 150), (4, "é" * 100_000)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert got == {1: (1_000_000, 999_999, 1), 2: (400_000, 399_998, 1), 3: (153, 150, 1), 4: (200_000, 199_998, 1)}
    data = spark.createDataFrame([(1, b"d", b"a" * 1_000_000, list(range(999_901)))], "doc_id long, digest binary, data binary, found array<int>")
    rows = suffix_dedup.segments_of(data, 100).collect()
    assert [(x.first, x.last, x.segment is None) for x in rows] == [(0, 0, False), (1, 999_900, True)]


def naive_repeats(texts):
    seen, out = {}, {}
    for i, t in sorted(texts, key=lambda e: (e[0] is None, e[0] or 0)):
        data = (t or "").encode()
        covered = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen and seen[w] != (i, s):
                covered[s : s + 100] = b"\1" * 100
            seen.setdefault(w, (i, s))
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(1 for k in range(len(data)) if covered[k] and (k == 0 or not covered[k - 1]))
        out[i] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup_against_brute_force(spark, odd, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(9)
    base = "".join(r.choice("abcdefgh ") for _ in range(900))
    more = [(100 + k, base[r.randrange(300) : r.randrange(400, 900)] + "".join(r.choice("xyz") for _ in range(r.randrange(90)))) for k in range(25)]
    got = suffix_dedup.remove_repeats(odd.unionByName(docs_of(spark, more))).collect()
    want = naive_repeats(odd_texts() + more)
    assert len(got) == len(odd_texts()) + len(more)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == want


# 5. Fingerprints.


def naive_fingerprint(text):
    """Byte by byte: the gear hash, and a cut where its top bits are zero."""
    import xxhash

    data, at, h, chunks = text.encode(), 0, 0, {}
    for k, b in enumerate(data):
        window = data[max(0, k - 63) : k + 1]
        h = sum(int(fingerprints.GEAR[x]) << (len(window) - 1 - j) for j, x in enumerate(window)) % 2**64
        n = k + 1 - at
        hard, easy = h >> 56 == 0, h >> 59 == 0
        if fingerprints.LEAST < n <= fingerprints.NORMAL and hard or n > fingerprints.NORMAL and easy or n == fingerprints.MOST or k + 1 == len(data):
            chunks[xxhash.xxh3_64_hexdigest(data[at : k + 1])] = n
            at = k + 1
    return chunks


def naive_likeness(a, b):
    whole = sum(a.values())
    return sum(n for d, n in a.items() if d in b) / whole if whole else float(not b)


def test_fingerprints_against_brute_force(spark):
    r = random.Random(21)
    text = lambda n: " ".join("".join(r.choice("abcdefghijé") for _ in range(r.randint(2, 8))) for _ in range(n))
    base = text(500)
    texts = [(k, base[: r.randrange(len(base))] + text(r.randrange(120)) if k % 5 else None if k % 2 else "") for k in range(20)] + [(3, "a second row of three"), (7, base * 3)]
    got = Counter()
    for x in fingerprints.fingerprints(docs_of(spark, texts)).collect():
        got[x.doc_id, x.n_chars, x.fingerprint, x.edited_fingerprint, round(x.near_edited, 9), round(x.near_next, 9)] += 1
    written = lambda c: " ".join(f"{d}:{n}" for d, n in sorted(c.items()))
    ids = sorted({i for i, _ in texts}, reverse=True)
    for twice in itertools.product(*(itertools.permutations([t or "" for j, t in texts if j == i]) for i in ids)):  # rows of one id in some order
        order, want = [(i, t) for i, own in zip(ids, twice) for t in own], Counter()
        for k, (i, t) in enumerate(order):
            following = order[(k + 1) % len(order)][1]
            changed = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
            one, two, three = map(naive_fingerprint, (t, changed, following))
            want[i, len(t), written(one), written(two), round(naive_likeness(one, two), 9), round(naive_likeness(one, three), 9)] += 1
        if want == got:
            return
    raise AssertionError


def test_fingerprint_rows(spark, odd):
    rows = [(i, t) for i, t in odd_texts() if i != 13]
    got = {r.doc_id: r for r in fingerprints.fingerprints(odd.where("doc_id IS NULL OR doc_id != 13")).collect()}
    order = sorted(rows, key=lambda e: (e[0] is None, -(e[0] or 0)))
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        changed = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].near_next == fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(following))
    assert got[7].fingerprint == got[8].fingerprint and got[8].near_next == 1.0


def test_many_ranges_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS", 7)
    texts = [(k * 3, f"text {k} " * 20) for k in range(60)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs_of(spark, texts)).collect()}
    for k, (i, t) in enumerate(texts):
        following = texts[k - 1][1]
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 3] + following[: len(t) // 3]).encode()).hexdigest()


def test_an_insertion_moves_few_chunks():
    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(800))
    assert fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint("inserted " + text)) > 0.9
    data = text.encode()
    h = fingerprints.gear_hashes(data)
    for k in range(200):
        want = 0
        for b in data[max(0, k - 63) : k + 1]:
            want = (2 * want + int(fingerprints.GEAR[b])) % 2**64
        assert int(h[k]) == want


# 6. Toxicity.


def test_block_max_search_is_exact(monkeypatch):
    import numpy as np

    monkeypatch.setattr(toxicity, "STEP", 400)
    monkeypatch.setattr(toxicity, "QUERIES", 7)
    r = random.Random(4)
    vector = lambda: {t: r.randint(1, 4) for t in r.sample(range(12), r.randint(0, 5))}
    idf = np.array([1 + k / 3 for k in range(12)])

    def arrays(rows):
        found = [(k, t, n) for k, row in enumerate(rows) for t, n in sorted(row.items())]
        return (np.array(x, dtype=np.int64) for x in (zip(*found) if found else ((), (), ())))

    def unit(row):
        norm = sum(n * idf[t] ** 2 for t, n in row.items()) ** 0.5 or 1.0
        return {t: n**0.5 * idf[t] / norm for t, n in row.items()}

    for size, dense in ((0, 5), (3, 5), (300, 5), (300, 0), (300, 12)):
        examples, queries_ = [vector() for _ in range(size)], [vector() for _ in range(60)]
        index = toxicity.BlockMaxIndex(*arrays(examples), np.array([k % 2 for k in range(size)]), idf, block=8, dense=dense)
        cosines, places = index.nearest(*arrays(queries_), len(queries_))
        for query, got, at in zip(queries_, cosines, places):
            all_ = [round(sum(w * unit(examples[e]).get(t, 0) for t, w in unit(query).items()), 11) for e in index.order]
            want = sorted(enumerate(all_), key=lambda e: (-e[1], e[0]))[: toxicity.NEIGHBOURS]
            assert np.allclose(got[: len(want)], [c for _, c in want], atol=1e-9) and not any(got[len(want) :])
            assert [p for c, p in zip(got, at) if c > 0] == [p for p, c in want if c > 0]


def naive_scores(texts, labels):
    """Scores by plain loops: all examples, all words."""
    import math

    known = {i: max(y for j, y in labels if j == i) for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    words = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    examples = {i: words(min(t or "" for j, t in texts if j == i)) for i in known if any(j == i for j, _ in texts)}
    df, toxic = Counter(), [i for i in examples if known[i]]
    for _, t in texts:
        df.update(set(words(t)))
    weight = {}
    for t in {t for e in examples.values() for t in e}:
        a, b = sum(t in examples[i] for i in toxic), sum(t in examples[i] for i in examples if not known[i])
        told = math.log((a + 0.5) / (b + 0.5)) - math.log((len(toxic) + 0.5) / (len(examples) - len(toxic) + 0.5)) - toxicity.SURE * (1 / (a + 0.5) + 1 / (b + 0.5)) ** 0.5
        weight[t] = math.log((1 + len(texts)) / df[t]) * (toxicity.FLOOR + max(0, told))

    def unit(row):
        own = {t: n**0.5 * weight[t] for t, n in row.items() if t in weight}
        norm = sum(w * w for w in own.values()) ** 0.5 or 1.0
        return {t: w / norm for t, w in own.items()}

    units, base, out = {i: unit(e) for i, e in examples.items()}, len(toxic) / max(1, len(examples)), []
    for i, t in texts:
        own = unit(words(t))
        near = sorted(((sum(w * u.get(x, 0) for x, w in own.items()), known[j]) for j, u in units.items()), reverse=True)[: toxicity.NEIGHBOURS]
        out.append((i, round((sum(c * y for c, y in near) + toxicity.PRIOR * base) / (sum(c for c, _ in near) + toxicity.PRIOR), 6)))
    return out


def test_toxicity_scores_against_plain_loops(spark, odd):
    r = random.Random(12)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + r.choice("aeiou")
    texts = odd_texts() + [(300 + k, " ".join(word() for _ in range(r.randrange(60))) + (" vile nasty" if k % 4 == 0 else "")) for k in range(150)] + [(300, "another vile text of the same id")]
    labels = [(300 + k, int(k % 4 == 0)) for k in range(0, 150)] + [(13, 0), (13, 1), (7, 0), (9999, 1)]
    table = spark.createDataFrame([(i, None, y, "clash") for i, y in labels], "doc_id long, quality int, toxic int, text string")
    got = toxicity.toxicity(docs_of(spark, texts), table).collect()
    want = naive_scores(texts, labels)
    key = lambda e: (e[0] is None, e[0] or 0, e[1])
    for (i, x), (j, y) in zip(sorted(((g.doc_id, g.score) for g in got), key=key), sorted(want, key=key)):
        assert i == j and abs(x - y) < 1e-5


def test_toxicity_drops_texts_not_ids(spark):
    texts = [(k, f"some words {k} of {k % 7} text" + (" vile Nasty" if k % 3 == 0 else "")) for k in range(300)]
    labels = spark.createDataFrame([(k, None, int(k % 3 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    of = next(k for k in range(0, 300, 3) if zlib.crc32(str(k).encode()) % 3 == 1)  # its label is not learned
    docs = docs_of(spark, texts + [(of, "a clean text that stands on the id of a toxic one"), (None, "vile nasty vile nasty"), (of, "some words of text")])
    kept = [(x.doc_id, x.text) for x in toxicity.drop_toxic(docs, labels).collect()]
    assert (of, "a clean text that stands on the id of a toxic one") in kept and (of, "some words of text") in kept
    assert not any("vile" in t for _, t in kept) and len(kept) == 202


def test_toxicity_without_labels_or_with_one_class(spark, odd):
    schema = "doc_id long, quality int, toxic int"
    assert {x.score for x in toxicity.toxicity(odd, spark.createDataFrame([], schema)).collect()} == {0.0}
    assert {x.score for x in toxicity.toxicity(odd, spark.createDataFrame([(3, 0, 0), (4, 0, 0), (7, 1, None)], schema)).collect()} == {0.0}


def test_toxicity_held_out(spark):
    r = random.Random(6)
    clean = lambda: " ".join(r.choice("abcdefgh") + r.choice("klmnop") for _ in range(60))
    texts = [(k, clean() + (" vile Nasty, vile" if k % 5 == 0 else "")) for k in range(400)] + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(k, None, int(k % 5 == 0)) for k in range(400)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, texts)
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    assert all(x.predicted == int(i < 400 and i % 5 == 0) for i, x in got.items())
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    assert 0 <= got[1000].score < 0.5 and len(got) == 402
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns and toxicity.drop_toxic(docs, labels).count() == 322


# 7. Licences.


def test_license_rules(spark):
    full = "MIT. Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = [(1, "x\nReleased under the MIT License.\n"), (2, full), (3, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0."), (4, None), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "the MIT licence")]
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.n_matches) for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got == {1: ("m", ["MIT"], 1), 2: ("no", ["MIT"], 1), 3: ("aq", ["Apache-2.0", "CC-BY-NC-4.0"], 2), 4: ("", [], 0), 5: ("g", ["GPL-3.0-only"], 1), 6: ("", [], 0)}


APACHE = """# Copyright 2020 A. Writer
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MIT = """MIT License

Copyright (c) 2020 A. Writer. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD2 = """Copyright (c) 2020, A. Writer
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."""
THIRD = """
3. Neither the name of Writers Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version %s of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details."""


def test_licenses_of_standard_texts(spark):
    cases = [
        (APACHE, ["Apache-2.0"]), (MIT, ["MIT"]), (BSD2 % "", ["BSD-2-Clause"]), (BSD2 % THIRD, ["BSD-3-Clause"]), (GPL % 3, ["GPL-3.0-or-later"]), (GPL % 2, ["GPL-2.0-or-later"]),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 ...\n\n" + GPL % 3, ["GPL-3.0-only"]),
        ("                                 Apache License\n                           Version 2.0, January 2004\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n" + APACHE, ["Apache-2.0"]),
        ("// SPDX-License-Identifier: Apache-2.0\nint x;", ["Apache-2.0"]), ("# SPDX-License-Identifier: (MIT OR GPL-3.0+)\n", ["MIT", "GPL-3.0-or-later"]),
        ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]), ("See https://creativecommons.org/licenses/by/4.0/.", ["CC-BY-4.0"]),
        ("This is licensed under the GNU GPL v3 or later, as said.", ["GPL-3.0-or-later"]), ("licensed under the Apache License. Version 2.0 is out", []), ("A talk on the MIT License", []),
        (MIT.replace("MIT License", "All rights reserved."), ["MIT"]), ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", ["ISC"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", ["MPL-2.0"]), ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
        (GPL.replace("GNU General", "GNU Lesser General") % "2.1", ["LGPL-2.1-or-later"]), (GPL.replace("GNU General", "GNU Affero General") % 3, ["AGPL-3.0-or-later"]), ("Boost Software License - Version 1.0 - August 17th, 2003", ["BSL-1.0"]),
        ("3. The origin of this software must not be misrepresented; you must not", ["Zlib"]),
        ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", []), ("All rights\nreserved. x", ["Proprietary"]),
    ]
    got = {r.doc_id: (r.licenses, r.n_matches) for r in licenses.scan(docs_of(spark, list(enumerate(t for t, _ in cases)))).collect()}
    assert got == {k: (want, len(want)) for k, (_, want) in enumerate(cases)}


def test_licenses_say_what_the_notice_says(spark):
    """Versions, lists, denials, SPDX names; nothing is guessed."""
    gpl = "redistribute it and/or modify it under the terms of the GNU General Public License"
    cases = [
        (f"you can {gpl} version 2 as published by the FSF", ["GPL-2.0-only"]), ("see the GNU General Public License for more details", []), ("This file is not licensed under the MIT license", []),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]), ("Copyright X. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found", ["LicenseRef-bsd-style"]),
        *((f"# SPDX-License-Identifier: {x}", [x]) for x in ("0BSD", "EPL-2.0", "CC0-1.0", "Artistic-2.0", "LGPL-2.1-only", "AGPL-3.0-only", "MIT", "Zlib")), ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 OR (MIT AND LGPL-2.1+)", ["GPL-2.0-only", "MIT", "LGPL-2.1-or-later"]),
        ("SPDX-License-Identifier: Unheard-Of-1.0", []), (f"This program is free software; you can {gpl}.", ["GPL-1.0-or-later"]), (f"This program is free software; you can {gpl}.\nSee the GNU General Public License for more details.", ["GPL-1.0-or-later"]),
        ("Distributed under the terms of the GNU Library General Public License, version 2.0.", ["LGPL-2.0-only"]), (f"you may {gpl}, version 3 or any later version", ["GPL-3.0-or-later"]), ("available under the GNU Affero General Public License v3.0 only", ["AGPL-3.0-only"]),
        ("under the terms of version 2 or later of the GNU General Public License", ["GPL-2.0-or-later"]), ("distributed under the Eclipse Public License v2.0", ["EPL-2.0"]), ("licensed under the SIL Open Font License, Version 1.1.", ["OFL-1.1"]), ("It was never released under the Apache License 2.0", []),
        ("released under the MIT license or the GPL v2", ["MIT", "GPL-2.0-only"]), ("Licensed under the GPL version 2 or the MIT license", ["GPL-2.0-only", "MIT"]), ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ]
    got = {r.doc_id: (sorted(r.licenses), r.n_matches) for r in licenses.scan(docs_of(spark, list(enumerate(t for t, _ in cases)))).collect()}
    assert got == {k: (sorted(want), len(want)) for k, (_, want) in enumerate(cases)}


def test_every_license_sentence_has_a_trigger():
    words = licenses.triggers()
    assert len(words) < 40 and all(any(w in s for w in words) for s in (*licenses.PHRASES, *licenses.TITLES))
    assert all(any(w in s for w in words) for s in ("spdx-license-identifier: x", "under the gpl v3", "gnu general public license version 3", "a bsd-style license"))


def test_license_sql_with_sentences_planted(spark):
    """The query's SQL on its own sentences, each alone and in random order."""
    import duckdb

    r, own = random.Random(8), [s for _, s in sql.SENTENCES]
    texts = [(k, s) for k, s in enumerate(own)] + [(100 + k, "\n".join(r.choice(own) for _ in range(r.randrange(6)))) for k in range(120)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    got = licenses.scan(docs_of(spark, texts)).select("doc_id", "sentence_ids", F.array_join("licenses", ",").alias("licenses"), "n_matches")
    same(got, c, sql.license_sql())


def test_license_rows_and_evidence(spark):
    texts = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "Licensed under CC BY 4.0."), (4, "word " * 200_000 + "\nLicensed under CC BY-SA 4.0.\n"), (5, "Released under the MIT License.\n" * 3)]
    got = Counter((r.doc_id, tuple((e.license, e.sentence_ids) for e in r.evidence), r.n_matches) for r in licenses.scan(docs_of(spark, texts)).collect())
    mit = ("MIT", "m")
    assert got == Counter({(1, (), 0): 1, (2, (), 0): 1, (3, (mit,), 1): 2, (None, (("CC-BY-4.0", "r"),), 1): 1, (4, (("CC-BY-SA-4.0", "s"),), 1): 1, (5, (mit,) * 3, 3): 1})


# 8. Near duplicates.


def naive_groups(texts):
    """The component of each row: the least id that it is linked with, itself included."""
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k), i) for k, (i, _) in enumerate(texts)]


def test_near_groups_against_all_pairs(spark, odd):
    r = random.Random(8)
    base = [r.choice("abcdefghijklmnop") + r.choice("qrstuvw") for _ in range(200)]
    more = []
    for k in range(40):  # edits from few to many, so that similarities lie around the threshold
        w = list(base)
        for _ in range(k % 12):
            w[r.randrange(200)] = "zz" + str(k)
        more.append((200 + k, " ".join(w)))
    got = near_dedup.near_groups(odd.unionByName(docs_of(spark, more))).collect()
    rows = odd_texts() + more
    assert Counter((x.doc_id, x.component_id) for x in got) == Counter(zip((i for i, _ in rows), naive_groups(rows)))
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_blocks_of_a_hot_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    r = random.Random(18)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(60):  # several families that share most of a text, so buckets hold more than one component
        w = list(base)
        for j in range(0, 120, 9 + k % 5):
            w[j] = f"f{k % 6}"
        for _ in range(r.randrange(3)):
            w[r.randrange(120)] = f"own{k}"
        texts.append((k, " ".join(w)))
    got = near_dedup.near_groups(docs_of(spark, texts)).collect()
    assert {x.doc_id: x.component_id for x in got} == dict(zip(range(60), naive_groups(texts)))


def test_near_copies_go_by_text(spark):
    near, far = " ".join(f"word{k}" for k in range(40)), " ".join(f"other{k}" for k in range(30))
    texts = [(1, near), (5, near + " end"), (5, far), (1, near), (1, near + " tail"), (None, near), (None, "null's own text of several words"), (6, ""), (6, None), (7, "short one"), (7, "short one")]
    kept = Counter((x.doc_id, x.text) for x in near_dedup.drop_near_copies(docs_of(spark, texts)).collect())
    assert {k for k in kept if k[0] != 1} == {(5, far), (None, "null's own text of several words"), (6, ""), (6, None), (7, "short one")}
    assert sum(n for (i, _), n in kept.items() if i == 1) == 1 and set(kept.values()) == {1}


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{100 + k: 100 for k in range(40)}}


def test_pruning_bounds():
    bounds = near_dedup.least_matches()
    assert [n for n, _ in bounds] == list(range(near_dedup.BATCH, near_dedup.VALUES + 1, near_dedup.BATCH))
    assert all(0.4 < m / n < 0.75 for n, m in bounds)
    words = shingles.WordHashes()
    assert len(shingles.shingle_set("a b c", words)) == 1 and len(shingles.shingle_set(" \n", words)) == 0 and len(shingles.shingle_set("A b c d e f", words)) == 2


# 9. Exact copies.


def test_exact_groups_rows(odd):
    got = exact_dedup.exact_groups(odd).collect()
    groups = defaultdict(list)
    for i, t in odd_texts():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    want = Counter()
    for norm, rows in groups.items():
        keep = min(rows, key=lambda e: (-e[1], e[0] is None, e[0] or 0))[0]
        for i, _ in rows:
            want[(i, keep, len(rows), i == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_a_copy_does_not_take_the_other_text_of_its_id(spark):
    texts = [(1, "the same"), (2, "the same"), (2, "of its own"), (None, "the same"), (None, "null's own")]
    assert sorted(x.text for x in exact_dedup.drop_copies(docs_of(spark, texts)).collect()) == ["null's own", "of its own", "the same"]


def test_exact_groups_of_ids_that_are_text(spark):
    rows = [("b", "same text"), ("a", "same  text"), ("c", "same\ttext"), (None, "sametext"), ("d", "x" * 200_000), ("e", "x" * 199_999)]
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": ("a", 4, True), "b": ("a", 4, False), "c": ("a", 4, False), None: ("a", 4, False), "d": ("d", 1, True), "e": ("e", 1, True)}


# 10. Mixing.


def test_mixing_keeps_its_bounds(spark, odd):
    texts = [(k, "w " * (k * 7 % 53)) for k in range(600)]
    docs = docs_of(spark, texts, [(None, "a", "b", "c")[k % 4] if k > 300 else "a" for k in range(600)])
    got = mixing.mix(docs).collect()
    by = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        x = by.setdefault(r.source_size, [r.target, 0])
        x[1] += r.taken
    assert all(abs(taken - target) <= 53 for target, taken in by.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.taken // r.size for r in got if r.size)
    assert mixing.mix(odd).count() == len(odd_texts())


def naive_mix(rows):
    """How often the mix takes each row of (id, text, source); ids are unique."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    weight, cap, rest = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {s: 2 * whole[s] for s in names}, set(names)
    budget, target = 1.5 * sum(whole.values()), {}
    while rest:
        level = (budget - sum(target.values())) / sum(weight[s] for s in rest)
        above = {s for s in rest if level * weight[s] > cap[s]}
        target |= {s: float(cap[s]) for s in above} or {s: level * weight[s] for s in rest}
        rest = rest - above if above else set()
    items = []
    for s in names:
        ahead = 0
        for turn, i in sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, _, x in rows if x == s):
            ahead += size[i]
            items += [((ahead + whole[s] * k) / target[s], turn, i, k) for k in range(2)] if size[i] else []
    times, words = Counter(), 0
    for *_, i, _ in sorted(items):
        words += size[i]
        if words > budget:
            break
        times[i] += 1
    return times, target


def test_mixing_against_plain_loops(spark):
    r = random.Random(31)
    rows = [(k, "w " * r.randrange(40) if k % 9 else None, r.choice(("a", "b", None, "c", "d") if k % 3 else ("a",))) for k in range(300)]
    times, target = naive_mix(rows)
    got = mixing.mix(docs_of(spark, [(i, t) for i, t, _ in rows], [s for *_, s in rows])).collect()
    source = {i: s for i, _, s in rows}
    assert len(got) == 300 and all(abs(x.target - target[source[x.doc_id]]) < 1e-6 for x in got)
    assert {x.doc_id: x.taken for x in got if x.taken} == {i: n * next(x.size for x in got if x.doc_id == i) for i, n in times.items()}


def test_mixed_rows_of_one_id_count_one_by_one(spark):
    texts = [(k // 2, f"word {k // 2} " * 5) for k in range(20)] + [(k, "one two three") for k in (50, 50, 50, 50, 50)] + [(50, "four five six"), (None, "a b"), (None, "a b")]
    docs = docs_of(spark, texts, ["s"] * 20 + ["a"] * 8)
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts)
    want = Counter()
    for x in got:
        want[x.doc_id, x.size] += x.taken // x.size
    copies = Counter((x.doc_id, len(x.text.split())) for x in mixing.mixed_documents(docs).collect())
    assert copies == +want and sum(copies.values()) == sum(x.taken // x.size for x in got)


def test_prefix_sums(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.md5(F.col("id").cast("string")).alias("turn"), F.lit(1).alias("one"))
    got = common.prefix_sums(df, ["k"], ["turn"], "one", "rank", 500).collect()
    for k in range(3):
        assert [r["rank"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["turn"])] == list(range(sum(r["k"] == k for r in got)))


def test_pipeline_against_plain_loops(spark, tmp_path):
    """The rows of ``run`` are the pieces of the documents that a plain chain of the stages keeps."""
    import numpy as np
    from tokenizers import Tokenizer

    import corpus_pipeline

    r = random.Random(44)
    word = lambda: "".join(r.choice("bdfgklmn") + r.choice("aeiou") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [(k, text(r.randrange(8, 60)) + (" vile nasty vile" if k % 5 == 0 else "")) for k in range(150)]
    texts += [(200 + k, texts[k][1]) for k in range(1, 20)] + [(230 + k, texts[k][1].replace(" ", "\n") + " ") for k in range(20, 30)]
    texts += [(250 + k, texts[k][1] + " " + word()) for k in range(31, 60)] + [(300, None), (301, ""), (302, text(5000))]
    sources = [r.choice("abc") if k % 4 else "hot" for k in range(len(texts))]
    labels = [(k, None, int(k % 5 == 0)) for k in range(150)]
    docs_of(spark, texts, sources).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    rows = [(i, t, s) for (i, t), s in zip(texts, sources)]
    toxic = {i for i, x in naive_scores([(i, t) for i, t, _ in rows], [(i, y) for i, _, y in labels]) if x >= toxicity.CUT}
    assert {k for k in range(0, 150, 5)} <= toxic
    rows = [x for x in rows if x[0] not in toxic]
    keep = {}
    for i, t, _ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep[norm] = min(keep.get(norm, (0, 1 << 60)), (-len(t or ""), i))
    rows = [x for x in rows if x[0] in {i for _, i in keep.values()}]
    parents = naive_groups([(i, t) for i, t, _ in rows])
    rows = [x for x, c in zip(rows, parents) if x[0] == c]
    times, _ = naive_mix(rows)
    encode, want = Tokenizer.from_file(queries.tokenizer_path()).encode, Counter()
    for i, t, _ in rows:
        ids = [*encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], dtype="<u4").tobytes())] += times[i]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == +want


def test_each_stage_keeps_every_clean_text(spark, odd):
    """On odd rows: no stage but mixing (which takes words, so no empty text) loses a text of its own."""
    import corpus_pipeline

    labels = spark.createDataFrame([(k, None, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    docs = odd.unionByName(docs_of(spark, [(3, "another text that stands on the id three, of its own words")]))
    whole = {x.text for x in docs.collect()}
    assert {x.text for x in toxicity.drop_toxic(docs, labels).collect()} == whole
    norm = lambda found: {re.sub(r"[\x20\x09-\x0D]", "", x.text or "") for x in found}
    assert norm(exact_dedup.drop_copies(docs).collect()) == norm(docs.collect())
    near = {x.text for x in near_dedup.drop_near_copies(docs).collect()}
    assert {None, "", " \n\t", "no id", "one two", "é" * 300, "x" * 250, "another text that stands on the id three, of its own words"} <= near
    mixed = {x.text for x in mixing.mixed_documents(docs).collect()}
    assert mixed <= whole and corpus_pipeline.mix_sources(spark, docs, FOLDER).columns == docs.columns


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.documents(spark, FOLDER)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.staged(stage(spark, docs, FOLDER), f"test-{name}")
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.run(spark, FOLDER).count() >= docs.count() > 0
