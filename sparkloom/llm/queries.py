"""The thin queries of the training-data operators, one for each, and their DuckDB counterparts where SQL can say them."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, embedding_dedup, hard_negatives, html_text, langid, lm, resampling, secrets, simhash, token_files, toxicity
from .common import shared_dir, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def digest_of(text):
    """Lower-case SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, through the inverted index: the base kinds and the further ones of the method."""
    found = secrets.search(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE_RULES]
    return found.select(
        "doc_id",
        *(secrets.of_kind("spans", kind).alias(f"n_{kind}") for kind in base),
        digest_of(secrets.listed("spans", base)).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


def _secret_sql() -> str:
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    cut = ", ".join(f"list_transform(string_split_regex(t, {quoted(r.pattern)}), lambda x: length(x)) AS g{k}, list_transform(regexp_extract_all(t, {quoted(r.pattern)}), lambda x: length(x)) AS m{k}, list_transform(regexp_extract_all(t, {quoted(r.pattern)}, {r.group}), lambda x: length(x)) AS p{k}" for k, r in enumerate(rules))
    spans = ", ".join(f"list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'s': (list_sum(g{k}[1:i]) + coalesce(list_sum(m{k}[1:i-1]), 0))::BIGINT, 'o': {k}, 'k': '{r.kind}', 'e': (list_sum(g{k}[1:i]) + list_sum(m{k}[1:i]))::BIGINT, 'p': p{k}[i]}}), lambda x: x.p >= {r.least})" for k, r in enumerate(rules))
    counts = ", ".join(f"len(list_filter(f, lambda x: x.k = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in secrets.BASE_RULES)
    named = "lambda x: x.k || ':' || x.s || ':' || x.e"
    return f"""WITH cut AS (SELECT doc_id, {cut} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
found AS (SELECT doc_id, list_sort(flatten([{spans}])) AS f FROM cut)
SELECT doc_id, {counts},
 sha256(array_to_string(list_transform(list_filter(f, lambda x: x.o < {len(secrets.BASE_RULES)}), {named}), ',')) AS base_sha256,
 array_to_string(list_transform(f, {named}), ',') AS spans FROM found"""


ORACLES["op1_secret_scan"] = _secret_sql()


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every whole document lies inside 13-word windows of benchmark items."""
    found = decontaminate.overlap(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        digest_of(F.array_join("item_ids", ",")).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op2_decontaminate"] = rf"""WITH docs AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
long AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
pats AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM long)),
wins AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM pats))),
occ AS (SELECT doc_id, i, n, item_id FROM wins JOIN pats USING (n, p)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def remainder(id_column: str, n: int):
    """CRC-32 of the id as text, modulo n."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % n


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole document: exact unigrams, and the filter's word pairs."""
    return lm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)


@query
def lm_exact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op8 SQL can say: counts, and the base score to three places."""
    return op8_lm_score(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 3))


# CRC-32 bit by bit: the register takes in a byte and is shifted eight times
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
ORACLES["lm_exact_columns"] = rf"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_CRC} % 5 <> 1, false) AS train, coalesce({_CRC} % 5 = 1, false) AS held_out, list_append(list_filter(string_split_regex({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> ''), '') AS w FROM documents),
toks AS (SELECT r, train, held_out, unnest(w) AS t FROM docs), counts AS (SELECT t, count(*) AS c FROM toks WHERE train GROUP BY t),
whole AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM counts)
SELECT any_value(doc_id) AS doc_id, any_value(toks.held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens,
 round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 3) AS base_score
FROM toks JOIN docs USING (r) LEFT JOIN counts ON counts.t = toks.t CROSS JOIN whole GROUP BY r"""


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text and decode the ids again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    return done.select("doc_id", *(c.alias(name) for name, c in bpe.digest("token_ids", "decoded").items()))


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page."""
    return html_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; trigrams are learned from the documents' languages."""
    return langid.fuse(table(spark, sf_dir, "pages"), langid.learn(table(spark, sf_dir, "documents")))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files of byte-level BPE ids that are written first.

    Each document's ids stand behind five ids that say its doc_id, so that
    counts can be named without an index; those five are not counted.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, packed=2)
    path, end = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", 50_256
    token_files.write_packed(ids.select(F.concat(token_files.number_bytes(F.col("doc_id")), "token_ids").alias("value")), path, end)
    found = token_files.scan(spark, path, end, head=token_files.DIGITS)
    return found.select(token_files.number_of(F.col("head")).alias("doc_id"), (F.col("n_tokens") - token_files.DIGITS).alias("n_tokens"))


@query
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0)).select("query_id", "rank", "vec_id", "score")


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's weight towards the benchmark, and the twentieth of the documents that is drawn."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    weighed = resampling.weigh(docs, resampling.learn(docs, items)).drop("text")
    return resampling.draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")


# n-grams are spelled once each; the CRC takes in the bytes of their hexadecimal form, and what a byte does is the sum of what its bits do
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BITS = reduce(lambda x, y: f"xor({x}, {y})", (f"((xor(c, b) >> {i}) & 1) * {resampling.byte_effect(1 << i)}" for i in range(8)))
_BUCKET = f"(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, {_BITS})), 4294967295) % 10000)"


def _grams(rows: str) -> str:
    """(r, g): all runs of one to three words of ``rows``(r, w)."""
    word = f"SELECT r, unnest(w) AS a, unnest(range(0, len(w))) AS i FROM {rows}"
    near = f"SELECT r, a, lead(a) OVER x AS b, lead(a, 2) OVER x AS c FROM ({word}) WINDOW x AS (PARTITION BY r ORDER BY i)"
    return f"SELECT r, g FROM (SELECT r, unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c]) AS g FROM ({near})) WHERE g IS NOT NULL"


ORACLES["op11_importance_resampling"] = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), items AS (SELECT row_number() OVER () AS r, {_WORDS} AS w FROM benchmark),
raw AS MATERIALIZED ({_grams("docs")}), target AS MATERIALIZED ({_grams("items")}),
spelled AS (SELECT g, hex(g) AS h FROM (SELECT g FROM raw UNION SELECT g FROM target)), known AS MATERIALIZED (SELECT g, {_BUCKET} AS b FROM spelled),
s AS (SELECT b, count(*) AS n FROM raw JOIN known USING (g) GROUP BY b), t AS (SELECT b, count(*) AS n FROM target JOIN known USING (g) GROUP BY b),
gains AS (SELECT k AS b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000))::DOUBLE / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))::DOUBLE))::BIGINT AS gain FROM range(0, 10000) x(k) LEFT JOIN s ON s.b = k LEFT JOIN t ON t.b = k),
added AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM raw JOIN known USING (g) JOIN gains USING (b) GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
 (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM docs LEFT JOIN added USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC NULLS LAST, doc_id NULLS LAST, n_words, n_features, weight) AS place FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN score IS NOT NULL AND place <= (SELECT 5 * count(*) // 100 FROM placed) THEN place END::BIGINT AS rank FROM scored LEFT JOIN placed USING (r)"""


@query
def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector with the others at a cosine of 0.95 or more, and its component."""
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings"))


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
# labels spread from smaller ids along links until nothing changes; every pair is compared, so recall is that of the whole table
ORACLES["op12_embedding_dedup"] = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.r AS a, a.vec_id AS a_id, b.r AS b, b.vec_id AS b_id FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r, r AS other, vec_id FROM v UNION SELECT reach.r, b, b_id FROM reach JOIN link ON other = a),
least AS (SELECT r, min(vec_id) AS component_id FROM reach GROUP BY r), own AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least USING (r) LEFT JOIN own USING (r)
UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings WHERE NOT coalesce({_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, among all rows; every seventh row's label is moved on first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(rows, rows.where(F.col("vec_id") % 100 == 0))


ORACLES["op13_hard_negatives"] = f"""WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""
