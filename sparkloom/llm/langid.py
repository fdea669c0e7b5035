"""Language of pages by Bayesian evidence fusion.

The likelihood of a page's text under character trigrams is combined with the
language that its markup declares, with the suffix of its address, and with a prior of its
host. How well declarations and suffixes tell languages, and the priors, are
grouped sums over all pages of the shares that the text alone gives; priors of a
host lean on those of its domain, and these on those of all pages. A page's own
share is taken out of every sum that it is judged by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, join_heavy, materialize, slices
from .html_text import main_text

#: Buckets of hashed trigrams; labelled texts that they are learned from at most; the power of its length with which a text's evidence grows, as neighbouring trigrams overlap and tell less than their number; strength of the priors above.
BUCKETS, MOST_ROWS, GROWTH, STRENGTH = 1 << 14, 6_000, 0.75, 5.0


def trigrams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of a whole text: lower case, white space as one space, one space at each end."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    h = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64) % BUCKETS


def learn(df: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", most_rows: int = MOST_ROWS) -> dict[str, np.ndarray]:
    """Log probabilities of trigram buckets by language, from at most ``most_rows`` labelled texts: those whose ids have the smallest hashes."""
    usable = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_column).isNotNull())
    chosen = materialize(usable.select(F.col(id_column).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(most_rows), "sample")
    rows = usable.select(F.col(id_column).alias("_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(chosen), "_id")  # at most most_rows ids

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sums: dict[str, np.ndarray] = {}
                for t, y in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    sums[y] = sums.get(y, 0) + np.bincount(trigrams(t), minlength=BUCKETS)
                for y, n in sums.items():
                    kept = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(kept), pa.string()), pa.array(kept), pa.array(n[kept])], names=["lang", "bucket", "n"])

    counts: dict[str, np.ndarray] = {}
    for r in rows.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # at most BUCKETS rows a language
        counts.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    return {y: np.log((n + 0.1) / (n.sum() + 0.1 * BUCKETS)) for y, n in sorted(counts.items())}


def text_shares(df: DataFrame, model: dict[str, np.ndarray], text: str = "text", name: str = "by_text") -> DataFrame:
    """``df`` with the log likelihood of each whole text for each language of ``model``, in order, less the largest."""
    sent = df.sparkSession.sparkContext.broadcast(np.array(list(model.values())))

    def make():
        def one(t):
            found = trigrams(t or "")
            if not len(found):
                return np.zeros(len(sent.value))
            sums = sent.value[:, found].sum(axis=1) if len(found) < BUCKETS else sent.value @ np.bincount(found, minlength=BUCKETS)
            sums *= len(found) ** (GROWTH - 1)
            return sums - sums.max()

        def work(batch):
            return [pa.array([one(t).tolist() for t in batch.column(batch.schema.names.index(text)).to_pylist()], pa.list_(pa.float64()))]

        return work

    return append_columns(df, T.StructType([T.StructField(name, T.ArrayType(T.DoubleType()), False)]), make, text)


def address(url: Column) -> dict[str, Column]:
    """Host of an address (empty if it has none), its domain (last two labels) and its suffix (last label)."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return {"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def declared(html: Column) -> Column:
    """The main subtag of the language that the html element declares, in lower case; empty if none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,8})", 1))


def fuse(pages: DataFrame, model: dict[str, np.ndarray], id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, host, declared, text_lang, lang, confidence) for every page.

    ``text_lang`` is what the text alone says, ``lang`` what all evidence says,
    ``confidence`` its posterior probability. Nulls count as empty: a page without text, address
    and declaration has the language that is commonest over all pages. Ties go to the language
    that sorts first. Without languages in ``model``, they are null. Repeated pages are judged each on its own; other columns are dropped.
    """
    names = list(model)
    if not names:
        empty = F.lit(None).cast("string")
        return pages.select(F.col(id_column), F.col(url), address(F.col(url))["host"].alias("host"), declared(F.col(html)).alias("declared"), empty.alias("text_lang"), empty.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    base = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), declared(F.col(html)).alias("declared"), *(c.alias(k) for k, c in address(F.col(url)).items()))
    rows = text_shares(main_text(base, "html", "text").drop("html"), model).drop("text")
    rows = materialize(rows.withColumn("p", _normal(F.col("by_text"))), "pages")

    k = range(len(names))
    sums = lambda by: rows.groupBy(by).agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("p", i)) for i in k)).alias(f"n_{by}"))
    whole = rows.agg(F.array(*(F.coalesce(F.sum(F.get("p", i)), F.lit(0.0)) for i in k))).first()[0]
    met = rows
    for by in ("host", "domain", "suffix", "declared"):  # a host or suffix may have a third of all pages
        met = join_heavy(met, materialize(sums(by), by), by, "n")

    def judge(batches):
        every = np.array(whole)
        for batch in batches:
            part = batch.to_pydict()
            if not part["id"]:
                continue
            by_text, p, n_host, n_domain, n_suffix, n_declared = (np.array(part[c]) for c in ("by_text", "p", "n_host", "n_domain", "n_suffix", "n_declared"))
            less = lambda n: np.maximum(n - p, 0.0)  # noqa: E731  without the page's own share
            share = lambda n: n / n.sum(axis=1, keepdims=True)
            prior = share(less(every) + 1.0)
            for n in (n_domain, n_host):
                prior = share(less(n) + STRENGTH * prior)
            # P(value | language): pages of the language that have the value, leaning on an even share
            tells = lambda n: np.log((less(n) + 0.5) / (less(every) + 1.0))
            evidence = by_text + np.log(prior) + tells(n_suffix) + np.where((np.array(part["declared"]) != "")[:, None], tells(n_declared), 0.0)
            posterior = share(np.exp(evidence - evidence.max(axis=1, keepdims=True)))
            columns = [batch.column(c) for c in ("id", "url", "host", "declared")]
            columns += [pa.array([names[i] for i in by_text.argmax(axis=1)]), pa.array([names[i] for i in evidence.argmax(axis=1)]), pa.array(posterior.max(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    out = T.StructType().add(id_column, rows.schema["id"].dataType).add(url, T.StringType()).add("host", T.StringType()).add("declared", T.StringType()).add("text_lang", T.StringType()).add("lang", T.StringType()).add("confidence", T.DoubleType())
    return met.mapInArrow(judge, out)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _share(a: Column) -> Column:
    return F.transform(a, lambda x: x / _total(a))


def _normal(logs: Column) -> Column:
    """Probabilities of logs of which the largest is 0."""
    return _share(F.transform(logs, F.exp))
