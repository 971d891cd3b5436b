"""Personal data and the terms that disclose it.

Entities (e-mail and network addresses, card and phone numbers) are found by patterns.  How much a term
reveals an entity is its pointwise mutual information with it, estimated from all documents: the log of
how much likelier the entity is in a document with the term.  A term that carries more than a share of
the entity's information content is generalised to its class wherever it stands in a document with the
entity; if the class discloses as much, it is removed.  Everything is a DataFrame expression.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sward.llm.common import quoted, text_or_empty, unused
from sward.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: The patterns, written so that no start is tried within a run already read: linear on long texts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_ADDRESS = rf"^{_PART}(?:\.{_PART}){{3}}$"
TERM = r"[\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*"
#: Fewest documents of a pair, and the share of an entity's information content that a term may carry.
#: An entity of a single document would make every rare word of that document disclose all of it.
SUPPORT, SHARE = 2, 0.8
#: Classes of terms and what a term of the class looks like.
CLASSES = {"<code>": r"\p{N}", "<name>": r"^\p{Lu}", "<word>": r"^\P{Lu}"}
_TEXT_HAS = {"<code>": r"\p{L}\p{N}|\p{N}\p{L}", "<name>": r"(?<![\p{L}\p{N}])\p{Lu}", "<word>": r"(?<![\p{L}\p{N}])[\p{L}&&\P{Lu}]"}


def _digits(text):
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind, match):
    digits = _digits(match)
    return {
        "email": F.lit(True),
        "ip": match.rlike(_ADDRESS),
        "card": F.length(digits).between(14, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(10, 15),
    }[kind]


def _entity(kind, match):
    value = F.lower(match) if kind == "email" else match if kind == "ip" else _digits(match)
    return F.concat(F.lit(f"{kind}:"), value)


def _class_of(term):
    named = F.when(term.rlike(CLASSES["<code>"]), "<code>").when(term.rlike(CLASSES["<name>"]), "<name>")
    return named.otherwise("<word>")


def held_texts(rows):
    """``rid, k1, k2, text, matches`` of the texts in ``k1, k2, text`` that hold an entity."""
    found = rows.withColumn("rid", F.monotonically_increasing_id())
    for kind in KINDS:
        hint = F.col("text").contains(HINTS[kind]) if kind == "email" else F.col("text").rlike(HINTS[kind])
        found = found.withColumn(f"{kind}_match", F.when(hint, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))))
        found = found.withColumn(f"{kind}_gap", F.when(hint, F.split("text", PATTERNS[kind], -1)))
    arrays = []
    for number, kind in enumerate(KINDS):
        gaps, matches = F.col(f"{kind}_gap"), F.col(f"{kind}_match")
        one = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda gap, match: F.struct(  # noqa: B023
            F.lit(number).alias("kind"), F.length(gap).alias("skipped"), F.length(match).alias("size"),
            F.when(_valid(kind, match), _entity(kind, match)).alias("entity")))
        arrays.append(F.coalesce(one, F.array().cast(_MATCHES)))
    listed = found.select("rid", "k1", "k2", "text", F.concat(*arrays).alias("matches"))
    return cut_lineage(listed.where(F.exists("matches", lambda m: m["entity"].isNotNull())))


_MATCHES = "array<struct<kind:int,skipped:int,size:int,entity:string>>"


def base_spans(held):
    """``rid, k1, k2, kind, start, end, entity`` of every entity in the texts of ``held``.

    Positions are code points, the end exclusive.  A match's start is the length of the matches and gaps
    before it: a running sum over the rows of a text.
    """
    listed = held.select("rid", "k1", "k2", F.posexplode("matches").alias("i", "m")).select("rid", "k1", "k2", "i", "m.*")
    order = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = listed.repartition("rid").withColumn("end", F.sum(F.col("skipped") + F.col("size")).over(order))
    placed = placed.where(F.col("entity").isNotNull()).withColumn("start", F.col("end") - F.col("size"))
    # Rows equal in id and text have equal spans; the first of them stands for all.
    spans = placed.groupBy("k1", "k2", "kind", "start").agg(
        F.min("rid").alias("rid"), F.first("end").alias("end"), F.first("entity").alias("entity"))
    return cut_lineage(spans.select("rid", "k1", "k2", "kind", "start", "end", "entity"))


def _pairs(held, holders):
    """``entity, n_entity, term, class, n_pair``: documents with both, anywhere in the text.

    The classes of a text's terms count as terms.
    """
    texts = held.select("rid", "text").join(holders, "rid")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))
    texts = texts.withColumn("words", F.sort_array(F.transform(words, lambda w: F.struct(F.lower(w).alias("term"), _class_of(w).alias("class")))))
    # Of one term in several spellings the first class.
    first = F.filter("words", lambda w, i: (i == 0) | (F.get("words", i - 1)["term"] != w["term"]))
    classes = F.array_compact(F.array(*[
        F.when(F.col("text").rlike(p), F.struct(F.lit(c).alias("term"), F.lit(c).alias("class"))) for c, p in _TEXT_HAS.items()]))
    each = texts.select("entities", F.explode(F.concat(first, classes)).alias("word")).select("word.*", F.explode("entities").alias("e"))
    return each.groupBy(F.col("e.entity").alias("entity"), "term").agg(
        F.first("e.n_entity").alias("n_entity"), F.count("*").alias("n_pair"), F.min("class").alias("class"))


def disclosing_terms(rows, held, spans, share=SHARE, support=SUPPORT):
    """``entity, term, replacement``: terms whose disclosure of an entity is above the threshold.

    Documents are the unit: a term's count is that of the documents with it, a pair's that of the
    documents with both.
    """
    total = rows.count()
    n = F.lit(float(total))
    in_document = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    terms = rows.select(F.explode(in_document).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    classes = rows.agg(*[F.count_if(F.col("text").rlike(p)).alias(c) for c, p in _TEXT_HAS.items()])
    classes = classes.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in _TEXT_HAS]), F.array(*[F.col(quoted(c)) for c in _TEXT_HAS]))).alias("term", "n_term"))
    inside = spans.select("entity", "rid").distinct()
    entities = inside.groupBy("entity").agg(F.count("*").alias("n_entity"))
    # No pair is in more documents than its entity.
    entities = cut_lineage(entities.where((F.col("n_entity") >= support) & (F.col("n_entity") < n)))
    holders = inside.join(entities, "entity").groupBy("rid").agg(F.collect_list(F.struct("entity", "n_entity")).alias("entities"))
    pairs = cut_lineage(_pairs(held, holders).where(F.col("n_pair") >= support))
    known = pairs.join(terms.where(F.col("n_term") >= support).union(classes), "term")
    disclosed = F.log2(F.col("n_pair") * n / (F.col("n_entity") * F.col("n_term")))
    above = cut_lineage(known.where(disclosed >= share * F.log2(n / F.col("n_entity"))).select("entity", "term", "class"))
    also = above.where(F.col("term").startswith("<")).select("entity", F.col("term").alias("class"), F.lit(True).alias("class_too"))
    return above.where(~F.col("term").startswith("<")).join(also, ["entity", "class"], "left").select(
        "entity", "term", F.when(F.col("class_too"), F.lit("")).otherwise(F.col("class")).alias("replacement")
    )


def term_spans(held, spans, flagged):
    """``k1, k2, start, kind, end, replacement`` of each flagged term in all of a text with its entity."""
    wanted = spans.select("rid", "entity").distinct().join(flagged, "entity")
    wanted = wanted.groupBy("rid", "term").agg(F.min("replacement").alias("replacement"))
    wanted = wanted.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "replacement"))).alias("wanted"))
    cut = held.select("rid", "k1", "k2", "text").join(wanted, "rid")
    cut = cut.withColumn("words", F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).withColumn("gaps", F.split("text", TERM, -1))
    steps = F.zip_with(F.slice("gaps", F.lit(1), F.size("words")), "words", lambda gap, word: F.struct(
        F.length(gap).cast("long").alias("skipped"), F.length(word).cast("long").alias("size"),
        F.try_element_at("wanted", F.lower(word)).alias("replacement")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_ADDED).alias("found"))
    added = F.aggregate(steps, start, lambda s, x: F.struct(
        (s["at"] + x["skipped"] + x["size"]).alias("at"),
        F.when(x["replacement"].isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(F.struct(
            (s["at"] + x["skipped"]).alias("start"), F.lit(len(KINDS)).alias("kind"),
            (s["at"] + x["skipped"] + x["size"]).alias("end"), x["replacement"].alias("replacement"))))).alias("found")),
        lambda s: s["found"])
    return cut.select("k1", "k2", F.inline(added))


_ADDED = "array<struct<start:bigint,kind:int,end:bigint,replacement:string>>"


def sanitise(docs, id_col="doc_id", text_col="text", share=SHARE, support=SUPPORT):
    """``docs`` with ``n_email, n_ip, n_card, n_phone, base, spans`` and ``clean`` added.

    ``base`` and ``spans`` are arrays of ``start, kind, end, replacement`` in order of start and kind
    (0 to 3 as in ``KINDS``, 4 a term); ``clean`` is the text with every span replaced, of overlapping
    spans the first.  Terms that overlap an entity add no span.

    * A null text counts as empty; texts without entities have empty arrays.
    * Rows with equal ids and texts get equal results, and count as one document where an entity is
      counted.  A null id is an id like others.
    * Columns of ``docs`` with one of the names above are replaced; others stay.  An empty table gives an
      empty result.
    """
    k1, k2 = unused(docs, "k1", "k2")
    text = text_or_empty(quoted(text_col))
    rows = docs.select(F.col(id_col).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))
    held = held_texts(rows)
    spans = base_spans(held)
    flagged = cut_lineage(disclosing_terms(rows, held, spans, share, support))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    every = spans.select("k1", "k2", "start", "kind", "end", F.get(names, F.col("kind")).alias("replacement")).union(
        term_spans(held, spans, flagged))
    listed = every.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "replacement"))).alias("all"))
    is_term = len(KINDS)
    base = F.filter("all", lambda s: s["kind"] < is_term)
    listed = listed.withColumn("base", base)
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    listed = listed.withColumn("spans", F.filter("all", lambda s: (s["kind"] < is_term) | apart(s)))
    listed = listed.select(F.col("k1").alias(k1), F.col("k2").alias(k2), "base", "spans")
    outputs = ["base", "spans", "clean", *[f"n_{k}" for k in KINDS]]
    kept = docs.drop(*outputs).withColumn(k2, F.xxhash64(text))
    joined = kept.join(listed, F.col(quoted(id_col)).eqNullSafe(F.col(k1)) & (kept[k2] == listed[k2]), "left").drop(k1, listed[k2])
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,replacement:string>>")
    joined = joined.drop(k2).withColumn("base", F.coalesce("base", none)).withColumn("spans", F.coalesce("spans", none))
    for number, kind in enumerate(KINDS):
        joined = joined.withColumn(f"n_{kind}", F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long"))
    return joined.withColumn("clean", _replaced(text, F.col("spans")))


def _replaced(text, spans):
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    # Each part is one slice; parts are joined once.
    done = F.aggregate(spans, start, lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(
        x["end"].alias("at"),
        F.concat(s["parts"], F.array(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), x["replacement"])).alias("parts"))),
        lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def spans_text(spans):
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
