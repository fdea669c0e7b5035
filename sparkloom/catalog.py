"""The registered queries of the text index and their DuckDB counterparts.

All read whole tables: prose is spelled as bases. For the index of reads every text is cut into
reads of 101 characters that together hold all of it; counts in texts and the build for texts of any length take texts uncut. ``documents`` serves the build, ``conversations`` and
``benchmark`` the lookups, ``part`` (names with many ties) the tie-breaking.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import alphabet
from .operators import invert, lookups, merge, runs, search, spelled, transform
from .operators.index import Index
from .plans import tools
from .plans.order import spread
from .plans.report import Meter
from .plans.shared import shared_dir
from .sources import codecs, files
from .streaming import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# what the SQL counterparts share
_ENC = "translate(regexp_replace(lower(coalesce({0}, '')), '[^a-z]', '5', 'g'), 'abcdefghijklmnopqrstuvwxyz', '12234233123134241123414321')"
_READS = "SELECT {coll} AS coll, {key} * 1048576 + k AS seq_id, substr(t, k * 101 + 1, 101) AS s FROM (SELECT *, unnest(range(0, greatest(ceil(length(t) / 101.0)::BIGINT, 1))) AS k FROM (SELECT *, {enc} AS t FROM {table}))"
_SUF = "SELECT coll, seq_id, off, substr(s, off + 1) AS suf, CASE WHEN off = 0 THEN 0 ELSE substr(s, off, 1)::INT END AS c FROM (SELECT *, unnest(range(0, length(s) + 1)) AS off FROM texts)"
_BWT = "SELECT row_number() OVER (ORDER BY suf, coll, seq_id) - 1 AS pos, c, coll, seq_id, off, suf FROM suf"
#: Tables by name: key column, text column and the collection of a row.
_TABLES = {
    "documents": ("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END"),
    "conversations": ("conv_id * 65536 + turn", "text", "CASE WHEN role = 'user' THEN 0 ELSE 1 END"),
    "benchmark": ("item_id", "text", "CASE WHEN item_id % 2 = 0 THEN 0 ELSE 1 END"),
    "part": ("p_partkey", "p_name", "p_partkey % 3"),
}


def _with(table: str, one: bool = False) -> str:
    """The common table expressions texts, suf, bwt, alpha of a table; ``one``: as a single collection."""
    key, text, coll = _TABLES[table]
    reads = _READS.format(coll="0" if one else coll, key=f"({key})", enc=_ENC.format(text), table=table)
    alpha = "SELECT comp, cnt, coalesce(sum(cnt) OVER (ORDER BY comp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c_before FROM (SELECT k AS comp, coalesce(n, 0) AS cnt FROM unnest(range(0, 6)) x(k) LEFT JOIN (SELECT c, count(*) AS n FROM bwt GROUP BY c) ON c = k)"
    return f"WITH texts AS ({reads}), suf AS ({_SUF}), bwt AS MATERIALIZED ({_BWT}), alpha AS MATERIALIZED ({alpha})"


def texts(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """texts(coll, seq_id, s): the reads of a whole table."""
    key, text, coll = _TABLES[table]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.expr(coll).cast("int").alias("coll"), F.expr(key).cast("long").alias("seq_id"), F.col(text).alias("t"))
    return transform.reads_of(spread(rows, "seq_id").select("coll", "seq_id", alphabet.prose_as_bases(F.coalesce("t", F.lit(""))).alias("s")))


def uncut(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """texts(seq_id, s): the whole texts of a table."""
    key, text, _ = _TABLES[table]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.expr(key).cast("long").alias("seq_id"), F.col(text).alias("t"))
    return spread(rows, "seq_id").select("seq_id", alphabet.prose_as_bases(F.coalesce("t", F.lit(""))).alias("s"))


def one(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return texts(spark, sf_dir, table).drop("coll")


def index(spark: SparkSession, sf_dir: str, table: str = "conversations") -> Index:
    return Index.of_texts(one(spark, sf_dir, table))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _whole(table: str) -> str:
    """As ``_with`` for uncut texts, of which ``bwt`` and ``suf`` are made only where a query names them."""
    key, text, _ = _TABLES[table]
    return f"WITH texts AS (SELECT 0 AS coll, {key} AS seq_id, {_ENC.format(text)} AS s FROM {table}), suf AS ({_SUF}), bwt AS ({_BWT})"


C, D, B, P = (_with(t, True) for t in ("conversations", "documents", "benchmark", "part"))
C2, D2, P2 = (_with(t) for t in ("conversations", "documents", "part"))
_STRETCHES = f"SELECT item_id * 1048576 + k AS pattern_id, n, substr(t, k + 1, n) AS p FROM (SELECT *, unnest(range(0, greatest(length(t) - n + 1, 1))) AS k FROM (SELECT item_id, {_ENC.format('text')} AS t, {{n}} AS n FROM benchmark))"
_PATTERNS = f"({_STRETCHES.format(n='(3 + item_id % 6)::BIGINT')})"
#: Every place of every pattern, by the suffixes' beginnings of each length of a pattern.
_HITS = "hits AS (SELECT pattern_id, pos, seq_id, off FROM pat JOIN (SELECT pos, seq_id, off, substr(suf, 1, size) AS p FROM bwt, (SELECT DISTINCT length(p) AS size FROM pat) WHERE length(suf) >= size) USING (p))"


def stretches(spark: SparkSession, sf_dir: str, size: Column) -> DataFrame:
    """(pattern_id, pattern): every stretch of ``size`` symbols of every whole benchmark text (shorter texts: the text); stretch k of text i has pattern_id i * 2**20 + k."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", alphabet.decode(alphabet.prose_as_bases(F.coalesce("text", F.lit("")))).alias("t"), size.cast("int").alias("n"))
    places = items.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.length("t") - F.col("n"), F.lit(0)))).alias("k"))
    return places.select((F.col("item_id") * (1 << 20) + F.col("k")).alias("pattern_id"), F.substr("t", F.col("k") + 1, F.col("n")).alias("pattern"))


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of three to eight symbols (by the item) of every benchmark text."""
    return stretches(spark, sf_dir, 3 + F.col("item_id") % 6)


def questions(bwt: DataFrame) -> DataFrame:
    """(i, c): a question for every position of a transform, about the symbol that stands elsewhere."""
    return bwt.select(F.col("pos").alias("i"), (1 + F.col("pos") % 5).cast("int").alias("c"))


@query("SELECT doc_id, " + _ENC.format("text") + " AS s FROM documents")
def q_reads_encode(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", alphabet.prose_as_bases(F.coalesce("text", F.lit(""))).alias("s"))


@query(f"{C} SELECT comp::INT AS comp, substr('$ACGTN', comp + 1, 1) AS ch, cnt::BIGINT AS cnt, c_before FROM alpha")
def q_alphabet_c(spark, sf_dir):
    return alphabet.of_texts(one(spark, sf_dir, "conversations"))


@query(f"{P} SELECT pos, seq_id, off FROM bwt")
def q_suffix_array(spark, sf_dir):
    return transform.build(one(spark, sf_dir, "part")).select("pos", "seq_id", "off")


@query(f"{C} SELECT pos, c FROM bwt")
def q_bwt_build(spark, sf_dir):
    return transform.build(one(spark, sf_dir, "conversations")).select("pos", "c")


@query(f"{P} SELECT pos, c FROM bwt")
def q_bwt_build_ranges(spark, sf_dir):
    """The sort dealt out by ranges, of names with many ties."""
    return transform.build(one(spark, sf_dir, "part")).select("pos", "c")


@query(f"{_whole('conversations')} SELECT pos, c FROM bwt")
def q_bwt_build_long(spark, sf_dir):
    """Prefix doubling, as for texts of any length: whole conversations, uncut."""
    return transform.build_long(uncut(spark, sf_dir, "conversations")).select("pos", "c")


_RUNS = "runs AS (SELECT row_number() OVER (ORDER BY min(pos)) - 1 AS run_id, min(pos) AS start, c, count(*) AS len FROM (SELECT pos, c, pos - row_number() OVER (PARTITION BY c ORDER BY pos) AS g FROM bwt) GROUP BY c, g)"


@query(f"{C}, {_RUNS} SELECT run_id, start, c, len FROM runs")
def q_bwt_runs(spark, sf_dir):
    return runs.runs_of_spelled(spelled.spelled(one(spark, sf_dir, "conversations"), spelled.FRAGMENT), spelled.FRAGMENT)


@query(f"{D}, {_RUNS} SELECT c, len, count(*) AS n FROM runs GROUP BY c, len")
def q_run_histogram(spark, sf_dir):
    """Runs of the transform of all documents."""
    return runs.histogram_of_spelled(spelled.spelled(one(spark, sf_dir, "documents"), spelled.FRAGMENT), spelled.FRAGMENT)


@query(f"{C}, piece AS (SELECT pos // 1024 AS blk, min(pos) AS start, c, count(*) AS len FROM (SELECT pos, c, pos - row_number() OVER (PARTITION BY c, pos // 1024 ORDER BY pos) AS g FROM bwt) GROUP BY pos // 1024, c, g), own AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY blk, c ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM piece) SELECT blk, string_agg(c::VARCHAR, '' ORDER BY start) AS sym, string_agg((start - blk * 1024)::BIGINT || ':' || before::BIGINT, ',' ORDER BY start) AS at, sum(len)::BIGINT AS positions FROM own GROUP BY blk")
def q_run_blocks(spark, sf_dir):
    """The blocks of runs that the index keeps: each run's symbol, its start, and how many of its symbol come before it in the block."""
    blocks = index(spark, sf_dir).blocks
    at = F.transform(F.slice("at", F.lit(1), F.length("sym")), lambda e: F.concat_ws(":", runs.start_of(e), runs.before_in(e)))
    return blocks.select("blk", "sym", F.array_join(at, ",").alias("at"), (F.col("end_pos") - F.col("start_pos")).alias("positions"))


@query(f"{C}, r AS (SELECT pos // 1024 AS blk, CASE WHEN c = lag(c) OVER (PARTITION BY pos // 1024 ORDER BY pos) THEN 0 ELSE 1 END AS head FROM bwt) SELECT count(DISTINCT blk) AS blocks, count(*) AS positions, sum(head)::BIGINT AS runs, (5 * sum(head) + 4 * count(DISTINCT blk))::BIGINT AS bytes FROM r")
def q_index_storage(spark, sf_dir):
    """What the runs of an index take: five bytes each and four for each block."""
    return runs.storage(index(spark, sf_dir).blocks)


_COUNTS = ", ".join(f"coalesce(sum(m{k}) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n{k}" for k in range(6))
_OWN = ", ".join(f"count(*) FILTER (c = {k}) AS m{k}" for k in range(6))


@query(f"{C} SELECT block, start_pos, end_pos, {_COUNTS} FROM (SELECT pos // 256 AS block, min(pos) AS start_pos, max(pos) + 1 AS end_pos, {_OWN} FROM bwt GROUP BY 1)")
def q_block_samples(spark, sf_dir):
    return runs.samples_of(runs.blocks_of_spelled(spelled.spelled(one(spark, sf_dir, "conversations"), 256), 256))


# ranks before a position from running counts inside blocks of 1,024 and sums of the blocks before
_IN = ", ".join(f"coalesce(sum((c = {k})::BIGINT) OVER w, 0) AS m{k}" for k in range(1, 6))
_SUMS = ", ".join(f"coalesce(sum(s{k}) OVER (ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s{k}" for k in range(1, 6))
_OF = ", ".join(f"count(*) FILTER (c = {k}) AS s{k}" for k in range(1, 6))
_BEFORE = f"SELECT i, " + ", ".join(f"(m{k} + s{k})::BIGINT AS r{k}" for k in range(1, 6)) + f" FROM (SELECT pos AS i, pos // 1024 AS blk, {_IN} FROM bwt WINDOW w AS (PARTITION BY pos // 1024 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) JOIN (SELECT blk, {_SUMS} FROM (SELECT pos // 1024 AS blk, {_OF} FROM bwt GROUP BY 1)) USING (blk)"


@query(f"{C}, b AS ({_BEFORE}) SELECT i, (1 + i % 5)::INT AS c, CASE i % 5 WHEN 0 THEN r1 WHEN 1 THEN r2 WHEN 2 THEN r3 WHEN 3 THEN r4 ELSE r5 END AS rank FROM b")
def q_rank_batch(spark, sf_dir):
    ix = index(spark, sf_dir)
    return ix.rank(questions(ix.bwt)).select("i", "c", "rank")


@query(f"{C}, b AS ({_BEFORE}) SELECT i, r1, r2, r3, r4, r5 FROM b")
def q_ranks_all(spark, sf_dir):
    ix = index(spark, sf_dir)
    return ix.ranks(ix.bwt.select(F.col("pos").alias("i")))


@query(f"{C} SELECT row_number() OVER (PARTITION BY c ORDER BY pos) AS i, c, pos FROM bwt")
def q_select_batch(spark, sf_dir):
    ix = index(spark, sf_dir)
    return ix.select(lookups.occurrences(spark, ix.counts)).select("i", "c", "pos")


@query(f"{C} SELECT pos AS i, c, row_number() OVER (PARTITION BY c ORDER BY pos) - 1 AS r FROM bwt")
def q_inverse_select(spark, sf_dir):
    ix = index(spark, sf_dir)
    return ix.inverse_select(ix.bwt.select(F.col("pos").alias("i"))).select("i", "c", "r")


_EDGES = "edges AS (SELECT pos, c, row_number() OVER (PARTITION BY c ORDER BY pos) - 1 AS r, c_before + row_number() OVER (PARTITION BY c ORDER BY pos) - 1 AS lf FROM bwt JOIN alpha ON c = comp)"


@query(f"{C}, {_EDGES} SELECT pos, c, lf FROM edges")
def q_lf_map(spark, sf_dir):
    return index(spark, sf_dir).edges.select("pos", "c", "lf")


@query(f"{C}, b AS ({_BEFORE}), k AS (SELECT " + ", ".join(f"(SELECT c_before FROM alpha WHERE comp = {k}) AS k{k}" for k in range(1, 6)) + ") SELECT i, " + ", ".join(f"k{k} + r{k} AS lf{k}" for k in range(1, 6)) + " FROM b, k")
def q_lf_all(spark, sf_dir):
    ix = index(spark, sf_dir)
    return lookups.lf_all(ix.bwt.select(F.col("pos").alias("i")), ix.blocks, ix.counts, size=ix.block_size)


@query(f"{C}, {_EDGES} SELECT lf AS pos, pos AS psi FROM edges WHERE c > 0")
def q_psi_map(spark, sf_dir):
    return index(spark, sf_dir).psi()


@query(f"{C}, n AS (SELECT count(*) AS n FROM bwt) SELECT 2 * pos AS i, coalesce((SELECT c FROM bwt x WHERE x.pos = 2 * y.pos), 0)::INT AS c FROM bwt y")
def q_access_batch(spark, sf_dir):
    """Twice every position: the upper half lies outside and has 0."""
    ix = index(spark, sf_dir)
    return ix.access(ix.bwt.select((2 * F.col("pos")).alias("i"))).select("i", "c")


@query(f"{C} SELECT pos // 100 * 100 AS lo, pos // 100 * 100 + 100 AS hi, CASE WHEN count(*) = 100 THEN string_agg(c::VARCHAR, '' ORDER BY pos) END AS digits FROM bwt GROUP BY 1, 2")
def q_extract_range(spark, sf_dir):
    ix = index(spark, sf_dir)
    asked = ix.bwt.select((F.floor(F.col("pos") / 100) * 100).alias("lo")).distinct().withColumn("hi", F.col("lo") + 100)
    return ix.extract(asked)


@query(f"{C} SELECT comp::INT AS comp, c_before AS lo, (c_before + cnt)::BIGINT AS hi FROM alpha")
def q_char_ranges(spark, sf_dir):
    return alphabet.char_ranges(index(spark, sf_dir).alphabet)


@query(f"{C} SELECT pos, CASE WHEN suf = '' THEN 0 ELSE substr(suf, 1, 1)::INT END AS comp FROM bwt")
def q_find_char(spark, sf_dir):
    ix = index(spark, sf_dir)
    return alphabet.find_char(ix.bwt.select("pos"), ix.alphabet)


@query(f"{C}, pat AS {_PATTERNS}, {_HITS} SELECT pattern_id, count(pos) AS matches, coalesce(min(pos), -1) AS lo FROM pat LEFT JOIN hits USING (pattern_id) GROUP BY pattern_id")
def q_find_ranges(spark, sf_dir):
    found = search.counts(index(spark, sf_dir).find(patterns(spark, sf_dir)))
    return found.select("pattern_id", "matches", F.when(F.col("matches") > 0, F.col("lo")).otherwise(-1).alias("lo"))


# substrings of texts by way of overlapping windows of 1,000 symbols, so that no long text is carried to each of its places
_SEEDS = "sizes AS (SELECT DISTINCT least(length(p), 16) AS n FROM pat), win AS (SELECT seq_id, n, j * 1000 AS w0, substr(s, j * 1000 + 1, 1000 + n - 1) AS w FROM (SELECT *, unnest(range(0, (length(s) - 1) // 1000 + 1)) AS j FROM texts, sizes WHERE length(s) >= n)), cut AS (SELECT seq_id, w0 + k AS k, substr(w, k, n) AS seed FROM (SELECT *, unnest(range(1, length(w) - n + 2)) AS k FROM win))"
_SHORT = _SEEDS + ", met AS (SELECT seed AS p, count(*) AS m FROM cut GROUP BY 1) SELECT pattern_id, coalesce(m, 0)::BIGINT AS matches FROM pat LEFT JOIN met USING (p)"
_LONG = _SEEDS + ", hits AS (SELECT seq_id, k, p FROM cut JOIN (SELECT DISTINCT p, substr(p, 1, 16) AS seed FROM pat) USING (seed)), met AS (SELECT p, count(*) AS m FROM hits JOIN texts USING (seq_id) WHERE substr(s, k, length(p)) = p GROUP BY p) SELECT pattern_id, coalesce(m, 0)::BIGINT AS matches FROM pat LEFT JOIN met USING (p)"


@query(f"{_whole('documents')}, pat AS {_PATTERNS}, {_SHORT}")
def q_pattern_counts(spark, sf_dir):
    """Counts of short patterns in all documents, uncut."""
    return search.in_texts(patterns(spark, sf_dir), uncut(spark, sf_dir, "documents"))


@query(f"{_whole('documents')}, pat AS (SELECT item_id AS pattern_id, {_ENC.format('text')} AS p FROM benchmark), {_LONG}")
def q_whole_pattern_counts(spark, sf_dir):
    """Counts of every whole benchmark text in all documents, uncut."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    asked = items.select(F.col("item_id").alias("pattern_id"), alphabet.decode(alphabet.prose_as_bases(F.coalesce("text", F.lit("")))).alias("pattern"))
    return search.in_texts(asked, uncut(spark, sf_dir, "documents"))


_WHOLE = f"SELECT item_id * 1048576 AS pattern_id, {_ENC.format('text')} AS p FROM benchmark"


def whole_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole benchmark text, and every stretch of 32 symbols of one: stretch k of text i has pattern_id i * 2**20 + k, the text itself k = 0."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", alphabet.decode(alphabet.prose_as_bases(F.coalesce("text", F.lit("")))).alias("t"))
    places = items.select("item_id", "t", F.explode(F.sequence(F.lit(0), F.greatest(F.length("t") - 31, F.lit(0)))).alias("k"))
    return places.select((F.col("item_id") * (1 << 20) + F.col("k")).alias("pattern_id"), F.when(F.col("k") == 0, F.col("t")).otherwise(F.substr("t", "k", F.lit(32))).alias("pattern"))


@query(f"{D}, pat AS ({_WHOLE} UNION ALL SELECT pattern_id + k, substr(p, k, 32) FROM (SELECT *, unnest(range(1, length(p) - 30)) AS k FROM ({_WHOLE}))), {_LONG}")
def q_find_whole(spark, sf_dir):
    """Every whole benchmark text and all its stretches of 32 symbols, searched in the index of the reads of all documents."""
    return index(spark, sf_dir, "documents").count(whole_patterns(spark, sf_dir)).select("pattern_id", "matches")


@query(f"{C}, pat AS {_PATTERNS} SELECT pattern_id, count(*) FILTER (ends_with(s, p)) AS ends, count(*) FILTER (starts_with(s, p)) AS starts, count(*) FILTER (s = p) AS equals FROM pat, texts GROUP BY pattern_id")
def q_anchored_counts(spark, sf_dir):
    return search.anchored(patterns(spark, sf_dir), one(spark, sf_dir, "conversations"))


@query(f"{C}, pat AS {_PATTERNS} SELECT pattern_id, count(*) FILTER (ends_with(s, p)) AS ends, count(*) FILTER (starts_with(s, p)) AS starts, count(*) FILTER (s = p) AS equals FROM pat, texts GROUP BY pattern_id")
def q_anchored_search(spark, sf_dir):
    """The same by searching P$, $P and $P$ in the index."""
    p, ix = patterns(spark, sf_dir), index(spark, sf_dir)
    kinds = (("ends", F.concat("pattern", F.lit("$")), 1), ("starts", F.concat(F.lit("$"), "pattern"), 2), ("equals", F.concat(F.lit("$"), "pattern", F.lit("$")), 3))
    asked = p.select("pattern_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("pattern")) for k, t, _ in kinds))).alias("x"))
    asked = asked.select((F.col("pattern_id") * 4 + F.when(F.col("x.kind") == "ends", 1).when(F.col("x.kind") == "starts", 2).otherwise(3)).alias("pattern_id"), "x.pattern")
    found = ix.count(asked).select(F.floor(F.col("pattern_id") / 4).alias("pattern_id"), (F.col("pattern_id") % 4).alias("kind"), "matches")
    return found.groupBy("pattern_id").agg(*(F.sum(F.when(F.col("kind") == n, F.col("matches"))).alias(k) for k, _, n in kinds))


@query(f"{C2} SELECT pos, c, coll::INT AS coll, seq_id, off FROM bwt")
def q_merge_bwt(spark, sf_dir):
    return merge.build(texts(spark, sf_dir, "conversations"))


@query(f"{P2} SELECT pos, c, coll::INT AS coll FROM bwt")
def q_merge_nway(spark, sf_dir):
    t = texts(spark, sf_dir, "part")
    return merge.merge(*(t.where(F.col("coll") == k) for k in range(3))).select("pos", "c", "coll")


_RA = "ra AS (SELECT b_pos, pos - b_pos AS a_rank FROM (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS b_pos FROM bwt WHERE coll > 0))"


@query(f"{C2}, {_RA} SELECT b_pos, a_rank FROM ra")
def q_rank_array(spark, sf_dir):
    return merge.rank_array(merge.build(texts(spark, sf_dir, "conversations")))


@query(f"{C2}, {_RA} SELECT a_rank, count(*) AS len FROM ra GROUP BY a_rank")
def q_ra_runs(spark, sf_dir):
    return merge.rank_runs(merge.rank_array(merge.build(texts(spark, sf_dir, "conversations"))))


@query(f"{P2}, {_RA} SELECT b_pos, a_rank FROM ra")
def q_rank_array_search(spark, sf_dir):
    """The rank array of two indexes that hold no texts."""
    t = texts(spark, sf_dir, "part")
    a, b = (Index.of_texts(t.where(w).drop("coll")) for w in ("coll = 0", "coll > 0"))
    return merge.rank_array_of_indexes(a, b)


@query(f"{C2} SELECT pos, (CASE WHEN coll > 0 THEN 1 ELSE 0 END)::INT AS from_coll FROM bwt")
def q_interleave_bits(spark, sf_dir):
    return merge.sources(merge.build(texts(spark, sf_dir, "conversations")))


@query(f"{C2} SELECT pos, c FROM bwt")
def q_interleave(spark, sf_dir):
    t = texts(spark, sf_dir, "conversations")
    whole = merge.build(t)
    a, b = (transform.build(t.where(F.col("coll") == k).drop("coll")) for k in (0, 1))
    return merge.interleave(a, b, merge.rank_array(whole))


@query(f"{C2}, pat AS {_PATTERNS}, {_HITS} SELECT pattern_id, count(pos) AS in_parts, count(pos) AS in_whole, true AS same FROM pat LEFT JOIN hits USING (pattern_id) GROUP BY pattern_id")
def q_merge_verify(spark, sf_dir):
    t = texts(spark, sf_dir, "conversations")
    parts = [Index.of_texts(t.where(F.col("coll") == k).drop("coll")) for k in (0, 1)]
    return merge.verify(patterns(spark, sf_dir), parts, Index.of_texts(t))


def _run_count(table: str, part: str) -> str:
    return f"SELECT {part} AS part, count(*) AS runs, sum(len)::BIGINT AS bases FROM (SELECT c, g, count(*) AS len FROM (SELECT p, c, p - row_number() OVER (PARTITION BY c ORDER BY p) AS g FROM (SELECT row_number() OVER (ORDER BY pos) AS p, c FROM {table})) GROUP BY c, g)"


@query(f"{C2} " + " UNION ALL ".join((_run_count("bwt WHERE coll = 0", "'a'"), _run_count("bwt WHERE coll = 1", "'b'"), _run_count("bwt", "'merged'"))))
def q_merge_compression(spark, sf_dir):
    """Runs of two collections before and after merging."""
    t = texts(spark, sf_dir, "conversations")
    size, n = spelled.FRAGMENT, F.col("n")
    count = lambda part, name: runs.histogram_of_spelled(spelled.spelled(part, size), size).agg(F.sum(n).alias("runs"), F.sum(n * F.col("len")).alias("bases")).select(F.lit(name).alias("part"), F.coalesce("runs", F.lit(0)).alias("runs"), "bases")
    return count(t.where("coll = 0"), "a").unionByName(count(t.where("coll = 1"), "b")).unionByName(count(t, "merged"))


@query(f"{C} SELECT row_number() OVER (ORDER BY seq_id) - 1 AS seq_id, s FROM texts")
def q_invert_bwt(spark, sf_dir):
    return invert.texts_of_index(index(spark, sf_dir))


_SIZES = {"ropebwt": "4 + parts", "sga": "30 + parts", "rfm": "8 + (bases + 7) // 8 * 8", "sdsl": "8 + (bases + 7) // 8 * 8", "plain_default": "bases", "plain_sorted": "bases"}


@query(f"{B}, {_RUNS}, n AS (SELECT sum(len)::BIGINT AS bases, sum(ceil(len / 31.0))::BIGINT AS parts FROM runs), f AS (SELECT * FROM (VALUES " + ", ".join(f"('{f.tag}', '{f.name}', '{f.order}')" for f in codecs.FORMATS.values()) + ") t(tag, name, alphabet)) SELECT tag, name, alphabet, (CASE tag " + " ".join(f"WHEN '{t}' THEN {size}" for t, size in _SIZES.items()) + " END)::BIGINT AS bytes FROM f, n")
def q_format_catalog(spark, sf_dir):
    """The formats, and the bytes that a transform takes in each; those of the native code follow from its bytes only."""
    return files.sizes(index(spark, sf_dir, "benchmark").runs())


_TAGS = ("plain_default", "plain_sorted", "rfm", "sdsl", "ropebwt", "sga")


@query(f"{C}, {_RUNS} SELECT tag, start, (CASE WHEN tag IN ('plain_sorted', 'rfm', 'sdsl') AND c >= 4 THEN 9 - c ELSE c END)::INT AS c, len FROM runs, (VALUES " + ", ".join(f"('{t}')" for t in _TAGS) + ") t(tag)")
def q_codec_roundtrip(spark, sf_dir):
    """Runs written to files of six formats, in the formats' alphabets, and read again."""
    held = files.packed(index(spark, sf_dir).runs())
    back = []
    for tag in _TAGS:
        path, order = f"{shared_dir(spark)}/codec-{tag}-{uuid.uuid4().hex}", codecs.FORMATS[tag].order
        files.write_packed(held, path, tag, order, source="default")
        back.append(files.read_runs(spark, path, tag).select(F.lit(tag).alias("tag"), "start", F.col("c").cast("int").alias("c"), "len"))
    return reduce(DataFrame.unionByName, back)


@query(f"{B}, {_RUNS} SELECT start, c::INT AS c, len FROM runs")
def q_native_code(spark, sf_dir):
    """Runs through the native code: encoded by block of positions and decoded again, its pieces joined."""
    return files.through_native(runs.runs_of(transform.build(one(spark, sf_dir, "benchmark")))).select("start", F.col("c").cast("int").alias("c"), "len")


@query(f"{C}, {_RUNS}, n AS (SELECT (count(*) FILTER (c = 0)) AS m, count(*) AS n FROM bwt), f AS (SELECT * FROM (VALUES ('ropebwt', 'ropebwt', false), ('sga', 'sga', true), ('plain_default', 'unknown', false), ('rfm', 'unknown', false)) t(tag, format, known)) SELECT tag, format, CASE WHEN known THEN m END AS sequences, CASE WHEN known THEN n END AS bases, CASE WHEN tag IN ('ropebwt', 'sga') THEN 'default' END AS alphabet FROM f, n")
def q_inspect(spark, sf_dir):
    """What the first bytes of written files say."""
    held = files.packed(index(spark, sf_dir).runs())
    paths = {}
    for tag in ("ropebwt", "sga", "plain_default", "rfm"):
        order = codecs.FORMATS[tag].order
        paths[tag] = f"{shared_dir(spark)}/inspect-{uuid.uuid4().hex}-{tag}"
        files.write_packed(held, paths[tag], tag, order, source="default")
    heads = files.inspect(spark, *paths.values())
    return heads.select(F.regexp_extract("path", "-([a-z_]+)$", 1).alias("tag"), "format", "sequences", "bases", "alphabet")


def _files(spark: SparkSession, sf_dir: str, table: str, collections: tuple[int, ...] = (0, 1)) -> list[str]:
    """Collections of a table, each written as a file of runs."""
    t, paths = texts(spark, sf_dir, table), []
    for k in collections:
        paths.append(f"{shared_dir(spark)}/tool-{uuid.uuid4().hex}-{k}")
        tools.save(Index.of_texts(t.where(F.col("coll") == k).drop("coll")), paths[-1], "sga")
    return paths


@query(f"{C2} SELECT count(DISTINCT coll) AS files, count(DISTINCT coll) AS known, (count(*) FILTER (c = 0))::BIGINT AS sequences, count(*)::BIGINT AS bases FROM bwt")
def q_tool_totals(spark, sf_dir):
    """Totals of what the headers of several files say."""
    return tools.totals(files.inspect(spark, *_files(spark, sf_dir, "conversations")))


@query(f"{P2}, kept AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS p, c FROM bwt WHERE coll < 2) SELECT min(p) AS start, c, count(*) AS len FROM (SELECT p, c, p - row_number() OVER (PARTITION BY c ORDER BY p) AS g FROM kept) GROUP BY c, g")
def q_tool_merge(spark, sf_dir):
    """Two files merged into a third by the merge tool, which is read again."""
    target = f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}"
    tools.merge(spark, _files(spark, sf_dir, "part"), target, ["sga"], "ropebwt")
    return files.read_runs(spark, target, "ropebwt").select("start", "c", "len")


@query(f"{C2} SELECT start, (CASE WHEN c >= 4 THEN 9 - c ELSE c END)::INT AS c, len FROM (SELECT min(p) AS start, c, count(*) AS len FROM (SELECT p, c, p - row_number() OVER (PARTITION BY c ORDER BY p) AS g FROM (SELECT row_number() OVER (ORDER BY pos) - 1 AS p, c FROM bwt WHERE coll = 0)) GROUP BY c, g)")
def q_tool_convert(spark, sf_dir):
    """A file converted by the tool into a format of another alphabet, and read again."""
    target = f"{shared_dir(spark)}/converted-{uuid.uuid4().hex}"
    tools.convert(spark, _files(spark, sf_dir, "conversations", (0,))[0], target, "sga", "sdsl", recode=True)
    return files.read_runs(spark, target, "sdsl").select("start", "c", "len")


_RUNS_OF = "SELECT {part} AS coll, c, count(*) AS len FROM (SELECT c, p - row_number() OVER (PARTITION BY c ORDER BY p) AS g FROM (SELECT c, row_number() OVER (ORDER BY pos) - 1 AS p FROM bwt WHERE {which})) GROUP BY c, g"
_STAGE = "(sum(len) FILTER (c = 0))::BIGINT AS sequences, sum(len)::BIGINT AS bases, {runs}::BIGINT AS runs, {bytes}::BIGINT AS bytes"
_IN_FILE = "sum(ceil(len / 31.0))"


@query(f"{P2}, parts AS ({_RUNS_OF.format(part=0, which='coll = 0')} UNION ALL {_RUNS_OF.format(part=1, which='coll = 1')}), whole AS ({_RUNS_OF.format(part=0, which='coll < 2')}), cut AS (SELECT c, count(*) AS len FROM (SELECT c, b, p - row_number() OVER (PARTITION BY c, b ORDER BY p) AS g FROM (SELECT *, p // 1024 AS b FROM (SELECT c, row_number() OVER (ORDER BY pos) - 1 AS p FROM bwt WHERE coll < 2))) GROUP BY c, b, g) "
       f"SELECT 'read ' || coll AS stage, {_STAGE.format(runs=_IN_FILE, bytes='30 + ' + _IN_FILE)} FROM parts GROUP BY coll UNION ALL SELECT 'merge', {_STAGE.format(runs='count(*)', bytes='NULL')} FROM cut UNION ALL SELECT 'write', {_STAGE.format(runs='count(*)', bytes='4 + ' + _IN_FILE)} FROM whole")
def q_stage_report(spark, sf_dir):
    """What the merge tool observes of each of its stages; times are left out."""
    meter = Meter(spark)
    tools.merge(spark, _files(spark, sf_dir, "part"), f"{shared_dir(spark)}/reported-{uuid.uuid4().hex}", ["sga"], "ropebwt", meter=meter)
    return meter.report().drop("seconds", "bpc", "rate")


@query(f"{P} SELECT pos, c FROM bwt ORDER BY pos")
def q_stream_levels(spark, sf_dir):
    """Batches added one after another, merged by levels and at last into one index."""
    rows, path = uncut(spark, sf_dir, "part"), f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    ends = [r[0] for r in rows.select(F.expr("explode(approx_percentile(seq_id, array(0.33, 0.66, 1.0)))")).collect()]
    for k, end in enumerate(ends):
        low = ends[k - 1] if k else None
        batch = rows.where((F.col("seq_id") <= end) & (F.lit(True) if low is None else F.col("seq_id") > low))
        incremental.add(spark, path, transform.reads_of(batch), k, fan=2)
    return incremental.compact(spark, path).bwt


@query(f"{B}, f AS (SELECT * FROM (VALUES ('default', 'default', '$ACGTN', false, true, true, false), ('sorted', 'sorted', '$ACGNT', true, false, true, false), ('identity', 'unknown', '012345', true, false, true, false)) t(name, found, letters, is_sorted, fits_default, fits_any, fits_unknown)), o AS (SELECT name, k, substr(letters, k + 1, 1) AS ch, CASE WHEN name = 'sorted' AND k >= 4 THEN 9 - k ELSE k END AS was FROM f, unnest(range(0, 6)) x(k)) SELECT name, found, is_sorted, fits_default, fits_any, fits_unknown, string_agg(ch || ':' || cnt, ',' ORDER BY k) AS counts FROM f JOIN o USING (name) JOIN alpha ON comp = was GROUP BY ALL")
def q_alphabet_orders(spark, sf_dir):
    """The alphabet of a transform in each order: what it is taken for, where it may be written, and how often each character occurs."""
    held = files.recoded(index(spark, sf_dir, "benchmark").alphabet.select("comp", "cnt"), "comp", "default")
    made = {order: alphabet.of_counts(held(order), order) for order in alphabet.ORDERS} | {"identity": alphabet.identity(held("default"))}
    found = [(name, alphabet.identify(a), alphabet.is_sorted(a), *(alphabet.compatible(a, o) for o in ("default", "any", "unknown"))) for name, a in made.items()]
    rows = spark.createDataFrame(found, "name string, found string, is_sorted boolean, fits_default boolean, fits_any boolean, fits_unknown boolean")
    each = reduce(DataFrame.unionByName, (a.withColumn("name", F.lit(name)) for name, a in made.items()))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("comp", "ch", "cnt"))), lambda x: F.concat_ws(":", x["ch"], x["cnt"])), ",")
    return rows.join(each.groupBy("name").agg(listed.alias("counts")), "name")


@query(f"{C} SELECT comp::INT AS comp, cnt > 0 AS present FROM alpha")
def q_has_char(spark, sf_dir):
    return alphabet.has_char(index(spark, sf_dir).alphabet)


@query(f"{C2}, a AS (SELECT c, count(*) AS n FROM bwt GROUP BY c) SELECT k::INT AS comp, substr('$ACGTN', k + 1, 1) AS ch, coalesce(n, 0)::BIGINT AS cnt, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c_before FROM unnest(range(0, 6)) x(k) LEFT JOIN a ON c = k")
def q_alphabet_merged(spark, sf_dir):
    """Counts of two collections' alphabets add up to that of the merged one."""
    t = texts(spark, sf_dir, "conversations")
    return alphabet.merged(*(alphabet.of_texts(t.where(F.col("coll") == k)) for k in (0, 1)))


@query(f"{C}, pat AS {_PATTERNS}, {_HITS}, m AS (SELECT pattern_id, count(pos) AS n FROM pat LEFT JOIN hits USING (pattern_id) GROUP BY pattern_id) SELECT count(*) AS patterns, count(*) FILTER (n > 0) AS found, coalesce(sum(n), 0)::BIGINT AS matches FROM m")
def q_find_totals(spark, sf_dir):
    return search.totals(index(spark, sf_dir).find(patterns(spark, sf_dir)))


@query(f"{C}, pat AS (SELECT pattern_id, p || '5' AS p FROM ({_STRETCHES.format(n='2')})), {_HITS} SELECT pattern_id, count(pos) AS matches FROM pat LEFT JOIN hits USING (pattern_id) GROUP BY pattern_id")
def q_find_unknown_characters(spark, sf_dir):
    """Characters outside the alphabet, here a ? behind every two symbols of every benchmark text, mean N."""
    asked = stretches(spark, sf_dir, F.lit(2)).withColumn("pattern", F.concat("pattern", F.lit("?")))
    return index(spark, sf_dir).count(asked).select("pattern_id", "matches")


@query(f"{C}, pat AS (SELECT * FROM {_PATTERNS} WHERE length(p) >= 6), {_HITS}, numbered AS (SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS r FROM texts) SELECT pattern_id, r AS seq_id, off FROM hits JOIN numbered USING (seq_id)")
def q_locate(spark, sf_dir):
    """Every place of the longer patterns, by the number of the text and the offset there, from an index without texts."""
    ix = index(spark, sf_dir)
    return invert.located_in_index(ix.find(patterns(spark, sf_dir).where(F.length("pattern") >= 6)), ix)


@query(f"{C}, pat AS (SELECT * FROM {_PATTERNS} WHERE length(p) >= 5), {_HITS} SELECT pattern_id, seq_id, off FROM hits")
def q_locate_sampled(spark, sf_dir):
    """Every place of the longer patterns, by steps back to the next sampled place: only the occurrences move."""
    ix = Index.of_texts(one(spark, sf_dir, "conversations"), places=16)
    return ix.locate(patterns(spark, sf_dir).where(F.length("pattern") >= 5), 16)


@query(f"{P2}, ra AS (SELECT coll, sum((coll = 0)::BIGINT) OVER (ORDER BY pos) AS a_rank FROM bwt) SELECT a_rank::BIGINT AS a_rank, count(*) AS len FROM ra WHERE coll > 0 GROUP BY a_rank")
def q_rank_runs_merged(spark, sf_dir):
    """The rank runs of two collections among a third, as one list."""
    t = texts(spark, sf_dir, "part")
    lists = [merge.rank_runs(merge.rank_array(merge.build(t.where(F.col("coll").isin(0, k))))) for k in (1, 2)]
    return merge.merge_rank_runs(*lists)


@query(f"{P2} SELECT pos, c FROM bwt")
def q_merge_indexes(spark, sf_dir):
    """Three indexes without texts merged by rank arrays: nothing is sorted again."""
    t = texts(spark, sf_dir, "part")
    return merge.merge_indexes([Index.of_texts(t.where(F.col("coll") == k).drop("coll")) for k in range(3)]).bwt.select("pos", "c")


@query(f"{C}, {_RUNS} SELECT run_id, part::INT AS part, c, least(len - part * 31, 31)::BIGINT AS len FROM (SELECT *, unnest(range(0, ceil(len / 31.0)::BIGINT)) AS part FROM runs)")
def q_rope_run_split(spark, sf_dir):
    return files.split_runs(index(spark, sf_dir).runs())


@query(f"{C}, {_RUNS} SELECT (sum(len) FILTER (c = 0))::BIGINT AS sequences, sum(len)::BIGINT AS bases, sum(ceil(len / 31.0))::BIGINT AS run_bytes FROM runs")
def q_sga_header(spark, sf_dir):
    return files.byte_counts(index(spark, sf_dir).runs())


@query(f"{B} SELECT printf('%016x', list_reduce(list_prepend(14695981039346656037::HUGEINT, list(c::HUGEINT ORDER BY pos)), lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616)) AS fnv1a FROM bwt")
def q_content_hash(spark, sf_dir):
    """FNV-1a over the symbols in order."""
    return runs.hash_of(runs.content_map(index(spark, sf_dir, "benchmark").blocks, 64))


@query(f"{C} SELECT pos AS i, c::BIGINT AS v, coalesce(sum(c) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sum FROM bwt")
def q_cumulative(spark, sf_dir):
    return lookups.cumulative(transform.build(one(spark, sf_dir, "conversations")).select(F.col("pos").alias("i"), F.col("c").cast("long").alias("v")))


@query("WITH v AS (SELECT p_partkey AS i, p_partkey % 4 AS v, coalesce(sum(p_partkey % 4) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM part) SELECT i, s + k AS k, k = v - 1 AS is_last FROM (SELECT *, unnest(range(0, v)) AS k FROM v)")
def q_cumulative_inverse(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    array = lookups.cumulative(parts.select(F.col("p_partkey").alias("i"), (F.col("p_partkey") % 4).alias("v")))
    places = array.where("v > 0").select(F.explode(F.sequence("sum", F.col("sum") + F.col("v") - 1)).alias("k"))
    return lookups.cumulative_inverse(places, array)
