import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from sward.llm.pii import KINDS, sanitise, spans_text
from llm_cases import edge, none, small  # noqa: F401

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += sum(map(int, str(int(c) * (1 + i % 2))))
    return total % 10 == 0


def _good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": all(int(p) <= 255 for p in text.split(".") if p) if kind == "ip" else False,
            "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def _base(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind], text or "") if _good(kind, m.group())]
    return sorted(found)


def _rows(docs):
    found = sanitise(docs).select(
        "doc_id", "text", *[f"n_{k}" for k in KINDS], F.sha2(spans_text(F.col("base")), 256).alias("sha"), "spans", "clean")
    return found.collect()


def _check(docs):
    rows = _rows(docs)
    for r in rows:
        base = _base(r["text"])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["sha"] == hashlib.sha256(text.encode()).hexdigest()
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 4] == base
        out, at = "", 0
        for s in r["spans"]:
            if s["start"] >= at:
                out, at = out + (r["text"] or "")[at : s["start"]] + s["replacement"], s["end"]
        assert r["clean"] == out + (r["text"] or "")[at:]
    return rows


def test_base_spans(spark, small, edge, none):
    tricky = [
        "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 9.9.9", "é +1 (415) 555-0100 x +12 +1 2", "4111 1111-1111 1111 4111111111111112",
        "+4111111111111111", "%%%@a.b@c.d.e-.", "1 2 3", "@", "🙂 q.w@é.fr me@x.io", "a." * 2000 + "@", "1" * 3000 + "." + "1 " * 500, "12.1.1.1@x.y",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(tricky)] + [(None, tricky[0]), (1, tricky[1]), (1, tricky[1])], "doc_id long, text string")
    _check(docs)
    _check(small)
    rows = _check(edge)
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in edge.collect())
    assert sanitise(none).count() == 0


def test_terms_that_disclose(spark):
    filler = "the report came in and was read by all of us again on that long day in town"
    rows = [(i, f"{filler} number {i % 7}") for i in range(200)]
    rows += [(200 + i, f"{filler}; mail from the Zanzibar office at zoe@island.org about boats, {filler}") for i in range(3)]
    rows += [(300, f"{filler} lone@one.net with Unseen words")]
    found = {r["doc_id"]: r for r in _rows(spark.createDataFrame(rows, "doc_id long, text string"))}
    text = dict(rows)
    for i in range(200, 203):
        terms = {text[i][s["start"] : s["end"]] for s in found[i]["spans"] if s["kind"] == 4}
        assert {"Zanzibar", "office", "boats"} <= terms and not terms & {"the", "in", "day", "report"}
        assert "Zanzibar" not in found[i]["clean"] and "zoe@island.org" not in found[i]["clean"]
        assert "<name>" in found[i]["clean"] or " the  " in found[i]["clean"]
    assert all(s["kind"] == 0 for s in found[300]["spans"])  # one document is no evidence
    assert all(not found[i]["spans"] and found[i]["clean"] == text[i] for i in range(200))


def test_terms_far_from_the_entity(spark):
    filler = "the report came in and was read by all of us again on that long day in town " * 5
    rows = [(i, f"{filler} number {i % 7}") for i in range(200)]
    # In the heading, beyond numbers of two digits that look like the start of a card, and in the footer.
    rows += [(200 + i, f"Minutes of Quentin; {filler} aged 42 in 1999; {filler} card 4111 1111 1111 1111 of 17, {filler} signed QUENTIN") for i in range(3)]
    found = {r["doc_id"]: r for r in _rows(spark.createDataFrame(rows, "doc_id long, text string"))}
    text = dict(rows)
    for i in range(200, 203):
        terms = [text[i][s["start"] : s["end"]] for s in found[i]["spans"] if s["kind"] == 4]
        assert terms.count("Quentin") == 1 and terms.count("QUENTIN") == 1 and not {"the", "report"} & set(terms)
        assert "quentin" not in found[i]["clean"].lower() and "<card>" in found[i]["clean"]
    assert all(not found[i]["spans"] for i in range(200))


def test_no_python_in_the_plan(small):
    plan = sanitise(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
