"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Toxic documents go, of each group of near-duplicates the first document
stays, contaminated documents go, documents with secrets have
these blotted out, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontaminate, secrets, simhash, toxicity
from sparkloom.llm.common import materialize, packed, table
from sparkloom.llm.queries import remainder

#: What stands for a secret in a text that is kept.
BLOT = "[secret]"


def held(docs: DataFrame) -> tuple[DataFrame, list]:
    """(row, text, doc_id) of documents, every other column in ``row``, so that a stage's own columns replace none of theirs; and the columns that give the documents back."""
    rows, back = packed(docs, "text")
    return rows.withColumn("doc_id", back[docs.columns.index("doc_id")]), back


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject; null and empty texts are scored as empty ones. Every column comes back as it was."""
    rows, back = held(docs)
    scored = toxicity.score(rows, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return scored.where(F.col("predicted") == 0).select(*back)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of linked fingerprints: the one with the smallest id, nulls last, and of one id that with the smallest hash of all columns.

    Rows are told apart by what they hold, so a task that is run again names them alike; rows that are equal in every column count as one.
    """
    rows, back = held(docs)
    hashed = rows.withColumn("hash", F.xxhash64("row", "text"))
    named = hashed.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash").alias("name"), "text")
    kept = simhash.groups(named, "name").where(F.col("name") == F.col("component_id")).select("name.hash").distinct()
    return hashed.join(kept, "hash", "left_semi").dropDuplicates().select(*back)  # both meet by the hash


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in benchmark passages; null and empty texts have none and stay. Every column comes back as it was."""
    rows, back = held(docs)
    found = decontaminate.overlap(rows, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(*back)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of a secret replaced; n_chars, where there is such a column, follows the text. Every other column comes back as it was, null and empty texts too."""
    rows, back = held(docs)
    found, some = secrets.scan(rows), F.size("spans") > 0
    text = F.when(some, secrets.blotted(F.col("text"), "spans", BLOT)).otherwise(F.col("text"))
    as_was = dict(zip(docs.columns, back))
    changed = {"text": text, "n_chars": F.when(some, F.length(text).cast("long")).otherwise(as_was.get("n_chars", F.lit(None)))}
    return found.select(*((changed[c].alias(c) if c in changed else as_was[c]) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids' count and digest, and the digest of the decoded bytes; null texts are empty. Other columns are dropped."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    return done.select("doc_id", *(c.alias(name) for name, c in bpe.digest("token_ids", "decoded").items()))


STAGES = [
    ("toxicity", keep_civil),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("secrets", blot_secrets),
    ("encoding", encode),
]

#: SQL has neither trees nor XXH64, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of a scale folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
