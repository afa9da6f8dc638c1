"""Quality rules, phrase mining and the filter audit against plain loops, and on nulls,
empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from quirespark.llm import filter_audit, phrases, quality_rules
from tests.llm.test_llm import docs_of, odd_texts

BLANK = " \t\n\x0b\x0c\r"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def with_repeats():
    r = random.Random(11)
    out = odd_texts()
    for i in range(20, 60):
        line = lambda: " ".join(r.choice("ab cd ef gh.".split()) for _ in range(r.randrange(12)))
        out.append((i, "\n".join(line() for _ in range(r.randrange(9))) + r.choice(["", "\r\n", " # | é$", "\x1f x"])))
    return [*out, (60, "one two three four five six seven eight " * 2), (61, "a" * 200_000), (62, "lang word " * 60_000), (63, "# * | % " * 9), (64, "é ü 1 2 3 " * 8)]


def naive_measures(text):
    words, lines = words_of(text), [x for x in (text or "").split("\n") if x.strip(BLANK)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_letter_words": sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words), "n_stutters": sum(a == b for a, b in zip(words, words[1:])),
    }


def test_ledger_against_loops(spark):
    texts = with_repeats()
    texts = [(k, t) for k, (_, t) in enumerate(texts)]
    book = quality_rules.verdicts(quality_rules.ledger(docs_of(spark, texts))).collect()
    assert len(book) == len(texts)
    for row in book:
        want = naive_measures(texts[row.doc_id][1])
        assert {m: row[m] for m in quality_rules.MEASURES} == want
        bits = sum(1 << k for k, rule in enumerate(quality_rules.RULES) if eval(rule.fails.replace("AND", "and"), want.copy()))
        assert (row.bits, row.kept, row.base_failed) == (bits, bits == 0, bits & 3 != 0)


def test_windows_of_small_batches(spark, monkeypatch):
    """Parts of a batch give what the whole gives; one row may be longer than a part."""
    docs = docs_of(spark, [(k, t) for k, (_, t) in enumerate(with_repeats())])
    want = sorted(quality_rules.ledger(docs).collect())
    monkeypatch.setattr(quality_rules, "BATCH_CHARS", 100)
    assert sorted(quality_rules.ledger(docs).collect()) == want


def test_repeated_words_keep_to_their_document():
    words = np.array([*range(9), *range(9), *range(20), *range(5, 13)])
    doc = np.array([0] * 9 + [1] * 9 + [2] * 28)
    assert np.flatnonzero(quality_rules.repeated_words(words, doc)).tolist() == [*range(23, 31), *range(38, 46)]
    assert not quality_rules.repeated_words(np.array([1, 1]), np.array([0, 0])).any()


def test_ablations(spark):
    book = quality_rules.ledger(docs_of(spark, with_repeats()))
    bits = [r.bits for r in book.select("bits").collect()]
    got = {(r.policy, r.rule): (r.n_failed, r.n_only, r.n_kept, r.n_kept_without) for r in quality_rules.ablations(book).collect()}
    assert len(got) == sum(map(len, quality_rules.POLICIES.values()))
    for (policy, rule), found in got.items():
        mask, bit = quality_rules.mask_of(policy), 1 << [r.name for r in quality_rules.RULES].index(rule)
        own = [b & mask for b in bits]
        assert found == (sum(b & bit > 0 for b in own), own.count(bit), own.count(0), sum(b & ~bit == 0 for b in own))


def test_keep_good(spark):
    texts = [*with_repeats(), (7, "fine words " + " ".join(f"w{k}" for k in range(40)))]
    docs = docs_of(spark, texts)
    out = quality_rules.keep_good(docs).collect()
    good = [(i, t) for i, t in texts if not any(eval(rule.fails.replace("AND", "and"), naive_measures(t)) for rule in quality_rules.RULES)]
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(i), t) for i, t in good)
    assert out and set(out[0].asDict()) == set(docs.columns)


# 12. Phrases.


def pieces_of(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def naive_phrases(rows, depth=3, least=10, top=2000):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        for piece in pieces_of(text):
            n[lang or "und"] += len(piece)
            for k in range(1, depth + 1):
                f[lang or "und"].update(tuple(piece[i : i + k]) for i in range(len(piece) - k + 1))
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and inside(p, q) for q, b in found.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def prose(seed, n=60, longest=90):
    r = random.Random(seed)
    vocabulary = "the THE of and cat dog é ßx it\x1fs naïve ½".split(" ")
    one = lambda: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n", "\x0b"]) for _ in range(r.randrange(longest)))
    return [(r.choice(["en", "de", None, "und"]), r.choice([one(), one(), one(), None, ""])) for _ in range(n)]


def with_langs(spark, rows):
    return spark.createDataFrame([(k, t, lang, "n", "p", "i") for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n string, phrase string, inside string")


@pytest.mark.parametrize(("depth", "shard"), [(3, 12 << 20), (3, 200), (4, 1000), (2, 50)])
def test_phrases_against_loops(spark, monkeypatch, depth, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    rows = prose(depth * shard) + [("en", "New York city hall " * 15 + ". " + "york city " * 2), ("en", "x " * 3000), ("fr", "a b " * 30_000)]
    got = phrases.collocations(with_langs(spark, rows), depth=depth, top=25)
    order = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.select(order).collect()) == naive_phrases(rows, depth, top=25)
    assert [k for _, k in got.select(order).dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]


def test_phrase_scores_beyond_64_bits(spark, monkeypatch):
    """Counts in the billions: products of 90 bits, floored exactly."""
    big = [("en", p, a) for p, a in (("a", 3_000_000_007), ("b", 2_000_000_011), ("a b", 1_999_999_993), ("", 9_000_000_000))]
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: spark.createDataFrame(big, "lang string, phrase string, f long"))
    row = phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect()[0]
    assert row.score == 1000000 * 1_999_999_993**2 // (3_000_000_007 * 2_000_000_011) and row.n == 9_000_000_000


def test_automaton_states():
    """States are classes of equal end positions: least and longest, links, counts."""
    words, before, names = phrases.worded([b"a b c. x b c. a b"])
    spelt = lambda ids: " ".join(names[int(k)].as_py() for k in ids)
    pieces = ["a b c".split(), "x b c".split(), "a b".split()]
    ends = defaultdict(set)
    for n, p in enumerate(pieces):
        for i in range(len(p)):
            for k in range(1, min(3, i + 1) + 1):
                ends[" ".join(p[i - k + 1 : i + 1])].add((n, i))
    classes = defaultdict(list)
    for sub, at in ends.items():
        classes[frozenset(at)].append(sub.split())
    want = sorted((" ".join(max(c, key=len)), min(map(len, c)), len(at)) for at, c in classes.items())
    got = sorted((spelt(col), int(least), int(count)) for _, cols, leasts, counts in phrases.Automaton(words, before, 3).states() for col, least, count in zip(cols.T, leasts, counts))
    assert got == want


# 13. The audit.


def naive_audit(texts, labels):
    """texts: (id, text, source); labels: id -> (quality, toxic)."""
    key = lambda i: (i is None, i or 0)
    first, docs = {}, []
    for i, t, _ in texts:
        first[t or ""] = min(first.get(t or "", key(i)), key(i))
    for i, t, s in texts:
        t = t or ""
        w = words_of(t)
        flags = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": key(i) > first[t]}
        docs.append((s or "", {f for f, x in flags.items() if x}, labels.get(i, (0, 0))))
    out = []
    for part in {p for p, _, _ in docs}:
        own = [(f, m) for p, f, m in docs if p == part]
        total, rows = Counter(), []
        for order in permutations("ABCDE"):
            rest = own
            for step, f in enumerate(order, 1):
                gone = [x for x in rest if f in x[0]]
                rest = [x for x in rest if f not in x[0]]
                total[f] += len(gone)
                rows.append((part, "".join(order), step, len(rest), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own), sum(m[0] == 1 for _, m in gone), sum(m[1] == 1 for _, m in gone)))
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_audit_against_loops(spark):
    r = random.Random(2)
    texts = [(i, t, r.choice(["s0", "", None])) for i, t in with_repeats()]
    texts += [(100 + k, r.choice(["UP ", "down ", "# "]) * r.randrange(70) + " ".join(f"w{x}" for x in range(r.choice([0, 60]))), r.choice(["s0", "s1", None])) for k in range(60)]
    texts += [(i - 50, t, "s2") for i, t, _ in texts[60:75]] + [(None, texts[70][1], "s2"), (None, "only null ids", "s2"), (None, "only null ids", "s2")]
    marks = [(i, r.randrange(2), r.randrange(2)) for i in range(0, 160, 2)] + [(2, 0, 0), (5, None, None)]
    want = {}
    for i, q, x in marks:
        a, b = want.get(i, (0, 0))
        want[i] = (max(a, q or 0), max(b, x or 0))
    docs = docs_of(spark, [(i, t) for i, t, _ in texts], [s for _, _, s in texts])
    out = filter_audit.audit(filter_audit.flagged(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")))
    order = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(x) for x in out.select(order).collect()) == naive_audit(texts, want)


def test_joint_counts_of_fewer_filters(spark):
    rows = spark.createDataFrame([("p", a, b, True, False) for a in (True, False) for b in (True, False) for _ in range(3)], "part string, A boolean, B boolean, good boolean, toxic boolean")
    assert filter_audit.joint_counts(rows, "AB").first().asDict() == {"part": "p", "every": [12, 6, 6, 3], "good": [12, 6, 6, 3], "toxic": [0] * 4}
    assert {(r.filter_order, r.step, r.kept, r.shapley) for r in filter_audit.audit(rows, "AB").collect()} == {("AB", 1, 6, 9), ("AB", 2, 3, 9), ("BA", 1, 6, 9), ("BA", 2, 3, 9)}


def test_audits_of_empty_tables(spark):
    none = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (quality_rules.ledger(none), quality_rules.keep_good(none), quality_rules.ablations(quality_rules.ledger(none)), phrases.collocations(none), filter_audit.audit(filter_audit.flagged(none, labels))):
        assert df.collect() == []
