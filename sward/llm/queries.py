"""Queries of this package and their SQL counterparts."""

from pyspark.sql import functions as F

from sward.session import ship

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark, sf_dir):
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op5_exact_dedup", OP5_SQL)
def op5_exact_dedup(spark, sf_dir):
    from sward.llm.exact import exact_groups

    return exact_groups(documents(spark, sf_dir))


def tokenizer_path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_token_files")
def op7_token_files(spark, sf_dir):
    from sward.llm.tokens import token_files

    tokens = token_files(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    from sward.llm.language import fit_languages, held_out, identify

    docs = documents(spark, sf_dir)
    found, name = identify(docs, fit_languages(docs.where(~held_out())))
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col(name)["lang"].alias("lang_pred"),
        F.col(name)["score"].alias("score"), F.col(name)["rejected"].alias("rejected"),
    )


@query("op4_sentencepiece")
def op4_sentencepiece(spark, sf_dir):
    from sward.llm.pieces import encode_and_decode

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found, name = encode_and_decode(docs, tokenizer_path("piece_bpe_32k.model"))
    ids, text = F.col(name)["ids"], F.col(name)["decoded"]
    return found.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.xxhash64(ids).alias("ids_hash"),
        F.sha2(text, 256).alias("decoded_sha256"),
        (text == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query("op3_mixing")
def op3_mixing(spark, sf_dir):
    from sward.llm.mixing import mix_report

    return mix_report(documents(spark, sf_dir))


OP9_SQL = """
WITH valid AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM valid a JOIN valid b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query("op9_topk", OP9_SQL)
def op9_topk(spark, sf_dir):
    from sward.llm.topk import top_inner_products

    return top_inner_products(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    from sward.llm.substring import remove_repeats

    left = remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s
    FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
      AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, len(s.s) AS n_shingles, r.c AS component_id
FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON s.doc_id = r.a
"""


@query("op10_ngram_jaccard", OP10_SQL)
def op10_ngram_jaccard(spark, sf_dir):
    from sward.llm.common import small_batches
    from sward.llm.jaccard import similar_components

    return similar_components(documents(small_batches(spark), sf_dir))


@query("op1_pii")
def op1_pii(spark, sf_dir):
    from sward.llm.pii import sanitise, spans_text

    found = sanitise(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"), F.sha2("clean", 256).alias("clean_sha256"),
    )


@query("op8_license_scan")
def op8_license_scan(spark, sf_dir):
    from sward.llm.licenses import scan

    def named(m):
        return F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))

    return scan(documents(spark, sf_dir), best=True).select(
        "doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(F.transform("found", named), ",").alias("licenses")
    )


@query("op12_token_counts")
def op12_token_counts(spark, sf_dir):
    from sward.llm.counts import token_counts

    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted, names = token_counts(docs, tokenizer_path("byte_bpe_50k.json"), limit=1024)
    return counted.select("doc_id", *names)


@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    from sward.llm.alignment import align, scored
    from sward.llm.common import small_batches

    paths = [tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    digests = F.transform("groups", lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256)))
    blocks = align(documents(small_batches(spark), sf_dir), *paths).withColumn("groups", digests)
    return scored(blocks).withColumnRenamed("groups", "groups_sha256")


@query("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    from sward.llm.conversations import damage, digests, repair

    return digests(repair(damage(ship(spark).read.parquet(f"{sf_dir}/conversations.parquet"))))
