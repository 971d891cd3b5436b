"""Language identification by compression.

Each language has a zstandard dictionary of raw text.  A text is compressed with every dictionary, and
the language of the smallest result wins; a narrow margin to the second rejects the text.
"""

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from sward.llm.common import quoted, unused
from sward.llm.remember import give_back
from sward.session import cut_lineage

#: Sample of the fit: texts of a language, code points of each, and bytes of its dictionary.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY = 100, 2000, 1 << 16
#: Parts in which the smallest hashes of a language are looked for first.
PARTS = 64
#: Texts are compressed in blocks, so that the dictionary counts as much at the end of a long one.
BLOCK, LEAD, LEVEL = 4096, 256, 6
#: A text is rejected when the second best language needs less than this share more bytes.
MARGIN = 0.002
UNDETERMINED = "und"
RESULT = "lang string, score double, rejected boolean"


def fit_languages(docs, text_col="text", lang_col="lang", rows=SAMPLE_ROWS, chars=SAMPLE_CHARS):
    """Dictionary bytes of each language, from a bounded sample of the labelled rows of ``docs``.

    The sample of a language is the ``rows`` different texts with the smallest hashes; ``chars`` code
    points of each are used.  Rows with a null label or without a letter teach nothing.
    """
    light = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    light = light.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # First within parts of each language, so that no task ranks what all tasks found for one.
    part = Window.partitionBy("lang", "part").orderBy("h")
    found = light.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(PARTS)))
    found = found.withColumn("n", F.row_number().over(part)).where(F.col("n") <= rows)
    whole = Window.partitionBy("lang").orderBy("h")
    # Written, so that its known small size keeps the texts out of a shuffle.
    chosen = cut_lineage(found.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= rows).select("lang", "h"))
    texts = light.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(
        F.min(F.substring("text", 1, chars)).alias("text")
    )
    model = {}
    for r in sorted(texts.collect()):  # at most ``rows`` short texts of each language
        model.setdefault(r["lang"], []).append(r["text"].lower())
    return {lang: "\n".join(found).encode()[-DICTIONARY:] for lang, found in model.items()}


class Classifier:
    def __init__(self, model):
        import zstandard

        self.languages, self.compressors = sorted(model), []
        # Each block follows text that its dictionary holds: else zstandard would store short blocks
        # as they are, and all languages would tie.
        self.leads = [model[lang][-LEAD:] for lang in self.languages]
        for lang in self.languages:
            data = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                dict_data=data, level=LEVEL, write_content_size=False, write_dict_id=False))

    def sizes(self, text):
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        pairs = zip(self.compressors, self.leads)
        return [sum([len(c.compress(lead + b)) for b in blocks]) for c, lead in pairs]

    def __call__(self, text):
        """Language, score (share of bytes saved against the second best language) and rejection."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        ranked = heapq.nsmallest(2, zip(self.sizes(text), self.languages))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, False
        margin = 1 - ranked[0][0] / ranked[1][0]
        return ranked[0][1], margin, margin < MARGIN


def predictor(model):
    """A column function from text to ``struct<lang, score, rejected>``."""

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classify = Classifier(model)
        for texts in batches:
            rows = [classify(t.as_py()) for t in texts]
            lang, score, rejected = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["lang", "score", "rejected"])
        del classify
        give_back()

    return predict


def identify(docs, model, text_col="text"):
    """``docs`` with a column ``prediction`` (or, where taken, that name and ``_``).

    * A null text, one without a letter, and any text when nothing was learned is ``und``, score 0,
      rejected.
    * Languages that tie are decided by the order of their names, and rejected.
    * Repeated rows get equal results; other columns stay as they are.
    """
    (name,) = unused(docs, "prediction")
    return docs.withColumn(name, predictor(model)(F.col(quoted(text_col)))), name


def keep_identified(docs, model, text_col="text"):
    """The rows of ``docs`` whose language is found; columns as before."""
    found, name = identify(docs, model, text_col)
    return found.where(~F.col(name)["rejected"]).drop(name)


def held_out(id_col="doc_id"):
    """Whether a document is kept from the fit: CRC-32 of its id as text is divisible by 5.

    A null id counts as an empty text.
    """
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
