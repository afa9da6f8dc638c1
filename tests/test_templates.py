"""Placeholders that spans cut, against the paragraph's own text."""

import re
from collections import defaultdict

from quirespark.operators import templates as P
from quirespark.plans import document_queries as Q

FOLDER = "/root/testdata/sf0.001"


def naive(spans, values):
    """spans: (seq, text or None) of one paragraph: what is filled, or why not."""
    whole, owner = "", []
    for seq, text in spans:
        owner += [seq] * len(text if text is not None else "\0")
        whole += text if text is not None else "\0"
    out = {seq: "" if text is not None else None for seq, text in spans}
    malformed, missing, places, at = 0, set(), 0, 0
    for m in [*re.finditer(r"\{\{[^{}\n]*\}\}", whole), None]:
        for k in range(at, m.start() if m else len(whole)):
            if out[owner[k]] is not None:
                out[owner[k]] += whole[k]
        if m:
            at, places = m.end(), places + 1
            p = re.fullmatch(r"\{\{\s*(=?)([A-Za-z0-9_.-]+)\s*\}\}", m[0])
            if not p:
                malformed += 1
            elif p[1]:
                out[owner[m.start()]] += "{{" + p[2] + "}}"
            elif p[2] in values:
                out[owner[m.start()]] += values[p[2]]
            else:
                missing.add(p[2])
    return out, malformed, missing, places


def naive_all(spans, values):
    paras, given, rows, outcomes = defaultdict(list), defaultdict(dict), [], {}
    for doc, para, seq, text in sorted(spans, key=lambda s: s[:3]):
        paras[doc, para].append((seq, text))
    for doc, key, value in values:
        given[doc][key] = value
    for doc in {d for d, _ in paras}:
        found = {p: naive(own, given[doc]) for (d, p), own in paras.items() if d == doc}
        missing = sorted(set().union(*(f[2] for f in found.values())))
        refusal = "malformed" if any(f[1] for f in found.values()) else "missing: " + ", ".join(missing) if missing else None
        outcomes[doc] = (sum(f[3] for f in found.values()), refusal)
        if refusal is None:
            rows += [(doc, p, seq, text) for p, f in found.items() for seq, text in f[0].items()]
    return rows, outcomes


def compare(spark, spans, values):
    rows, docs = P.filled(spark.createDataFrame(spans, "doc_id long, para int, seq int, text string"), spark.createDataFrame(values, "doc_id long, key string, value string"))
    want = naive_all(spans, values)
    key = lambda r: (*r[:3], r[3] is None, r[3])
    assert sorted(map(tuple, rows.collect()), key=key) == sorted(want[0], key=key)
    assert {r.doc_id: (r.places, r.refusal) for r in docs.collect()} == want[1]
    return want


def test_a_placeholder_split_across_spans_is_filled_into_the_span_it_begins_in(spark):
    spans = [(1, 0, 0, "Dear {"), (1, 0, 1, "{na"), (1, 0, 2, "me}"), (1, 0, 3, "}, and {{ a }}{{b}} "), (1, 0, 4, "{{=name}} é{{a}}"), (1, 1, 0, "plain"), (1, 1, 1, ""), (1, 2, 0, None)]
    spans += [(2, 0, 0, "{{na"), (2, 0, 1, None), (2, 0, 2, "me}}"), (3, 0, 0, "{{no}} {{name}} {{gone}}"), (4, 0, 0, "{{a{{a}}"), (5, 0, 0, "{{a"), (5, 1, 0, "}}")]
    values = [(d, k, v) for d in range(1, 6) for k, v in (("name", "N"), ("a", "first\tvalue {{b}}"), ("b", ""))]
    rows, outcomes = compare(spark, spans, values)
    assert [t for d, p, _, t in sorted(rows, key=lambda r: r[:3]) if (d, p) == (1, 0)] == ["Dear N", "", "", ", and first\tvalue {{b}} ", "{{name}} éfirst\tvalue {{b}}"]
    assert {d: why for d, (_, why) in outcomes.items()} == {1: None, 2: "malformed", 3: "missing: gone, no", 4: None, 5: None}


def test_template_spans(spark):
    """And template_outcomes, over documents' lines."""
    spans = [tuple(r) for r in Q.template_spans(spark, FOLDER).select("doc_id", "para", "seq", "text").collect()]
    rows, outcomes = naive_all(spans, [tuple(r) for r in Q.template_values(spark, FOLDER).collect()])
    assert {tuple(r) for r in Q.QUERIES["template_spans"](spark, FOLDER).collect()} == set(rows)
    assert {r.doc_id: (r.places, r.refusal) for r in Q.QUERIES["template_outcomes"](spark, FOLDER).collect()} == outcomes
    assert {"malformed", "missing: absent, also.absent", None} == {why for _, why in outcomes.values()}


def test_templates_of_nothing(spark):
    assert compare(spark, [], []) == ([], {})


def test_templates_deal_documents_once(spark):
    """Spans are never dealt: one exchange, of documents, and no sort, window or join."""
    for name in ("template_spans", "template_paragraphs", "template_outcomes"):
        plan = Q.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and not any(w in plan for w in ("Sort", "Window", "Join", "Aggregate")), name
        assert "Generate" not in plan[plan.index("Exchange") :]


def test_documents_that_batches_cut(spark):
    """Documents are whole wherever Arrow's batches end, and a refusal at the end takes what went before."""
    spans = [(d, p, s, t) for d in range(12) for p in range(3) for s, t in enumerate(["a {", "{k", "}", "} b", None, "", "{{k}}{{=k}}", "{{no}}" if d % 3 == 0 and p == 2 else "{{ k }}"])]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        compare(spark, spans[::-1], [(d, "k", f"v{d}") for d in range(12)])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
