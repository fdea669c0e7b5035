"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned into a Boolean query over trigrams
that every match must hold (a disjunction of conjunctions). ``index`` inverts the texts: for each trigram that the
rules ask for, sorted posting lists of the texts that hold it, in blocks of texts. ``candidates`` intersects the lists of a clause
and unites clauses; ``search`` runs the expressions on the texts found there and returns the spans. A rule
without mandatory trigrams scans every text.

Posting lists name a text by its hash, so copies share an entry and a shared hash only means one more text to verify.
The candidates go back to the texts as a bitmap of bounded size: a bit that two texts share again only means
verifying more, so no text moves at any size. ``scan`` gives the same spans in one pass
without an index, from the trigrams of each row alone, for texts that are read only once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize_counted

#: Alternatives beyond this many make a part of an expression count as unknown; the query stays right, only weaker.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression that never matches the empty string, and the least length of a group of it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in the order that breaks ties between spans that start together.
BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds with public, documented formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)


class _Part:
    """What is known of a part of an expression: all strings it can match (or None), and the trigram query met so far."""

    def __init__(self, strings: frozenset[str] | None, needs: frozenset[frozenset[str]]):
        self.strings, self.needs = strings, needs


_ANY = frozenset([frozenset()])


def _both(a: frozenset, b: frozenset) -> frozenset:
    joined = frozenset(x | y for x in a for y in b)
    return joined if len(joined) <= MOST_STRINGS else a


def _of_strings(strings: frozenset[str] | None) -> frozenset:
    """The query that one of ``strings`` occurs: for each, all its trigrams."""
    if strings is None:
        return _ANY
    found = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
    return _ANY if frozenset() in found else found


def _sequence(items) -> _Part:
    needs, run, whole = _ANY, frozenset([""]), True
    for item in items:
        part = _part(*item)
        grown = None if part.strings is None else frozenset(a + b for a in run for b in part.strings)
        if grown is not None and len(grown) <= MOST_STRINGS:
            run = grown
            continue
        whole = False
        needs = _both(_both(needs, _of_strings(run)), part.needs)
        run = frozenset([""]) if grown is None else part.strings
    return _Part(run, _of_strings(run)) if whole else _Part(None, _both(needs, _of_strings(run)))


def _part(op, args) -> _Part:
    if op is sre.LITERAL:
        return _Part(frozenset([chr(args).lower()]), _ANY)
    if op is sre.SUBPATTERN:
        return _sequence(args[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in args[1]]
        strings = None if any(p.strings is None for p in parts) else frozenset().union(*(p.strings for p in parts))
        needs = frozenset().union(*(p.needs for p in parts))
        return _Part(strings if strings is None or len(strings) <= MOST_STRINGS else None, _ANY if frozenset() in needs else needs)
    if op is sre.IN:
        letters = [chr(v).lower() for k, v in args if k is sre.LITERAL]
        small = len(letters) == len(args) and len(letters) <= 8
        return _Part(frozenset(letters) if small else None, _ANY)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, body = args
        inner = _sequence(body)
        if inner.strings is not None and most == 1:
            return _Part(inner.strings | ({""} if least == 0 else set()), _ANY if least == 0 else inner.needs)
        return _Part(None, _both(inner.needs, _of_strings(inner.strings)) if least else _ANY)
    return _Part(None, _ANY)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The clauses of which a match needs one; a clause is a set of lower-case trigrams that must all occur.

    An empty list means that the expression has no mandatory trigrams.
    """
    part = _sequence(sre_parser.parse(pattern))
    needs = part.needs if part.strings is None else _of_strings(part.strings)
    if frozenset() in needs:
        return []
    clauses = [c for c in needs if not any(o < c for o in needs)]
    return sorted(clauses, key=sorted)


def wanted(rules) -> list[str]:
    """The trigrams that the rules ask for, sorted."""
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})


def postings(df: DataFrame, rules, text: str = "text", name: str = "held") -> DataFrame:
    """``df`` with its posting lists as bitmaps: for each trigram that the rules ask for, in order, whether the row's text holds it.

    The lists of an index are columns here, one bit a row, beside the rows of each
    partition; so lists are intersected where the texts are, and no text moves. Null texts hold nothing.
    """
    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    bits = [F.contains(F.col("_low"), F.lit(t)) for t in wanted(rules)]
    return low.withColumn(name, F.array(*bits) if bits else F.array().cast("array<boolean>")).drop("_low")


def candidate(rule: Rule, rules, held: str = "held") -> Column:
    """Whether a row's postings meet the trigram query of a rule; true for a rule without mandatory trigrams."""
    place = {t: i for i, t in enumerate(wanted(rules))}
    clauses = trigram_query(rule.pattern)
    both = lambda clause: reduce(Column.__and__, (F.get(held, F.lit(place[t])) for t in sorted(clause)))
    return reduce(Column.__or__, map(both, clauses)) if clauses else F.lit(True)


#: Texts of a block of the index.
BLOCK_TEXTS = 4096
#: The candidates' bitmap: the log of the bits of a chunk (what Spark's bitmap functions take), bits for each candidate, and the most chunks (64 MB).
CHUNK, BITS_EACH, MOST_CHUNKS = 15, 16, 1 << 14


def index(df: DataFrame, rules, text: str = "text", blocks: int = 1) -> DataFrame:
    """postings(trigram, block, keys): for each trigram that the rules ask for the sorted keys of the texts that hold it, by blocks of texts.

    A text's key is its XXH64, so copies are one entry, which is merged before the shuffle; texts without any such trigram have none, null and empty ones too.
    What moves, once by key and once by block, are keys and a bit for each trigram; lists are made where a block lies.
    """
    terms = wanted(rules)
    words = [terms[i : i + 62] for i in range(0, len(terms), 62)]
    bit = lambda i, t: F.when(F.contains("low", F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    held = [reduce(Column.__add__, (bit(i, t) for i, t in enumerate(ts))).alias(f"w{k}") for k, ts in enumerate(words)]
    some = reduce(Column.__or__, (F.col(f"w{k}") != 0 for k in range(len(words))), F.lit(False))
    low = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("key"), F.lower(text).alias("low")).select("key", *held)
    texts = low.groupBy("key").agg(F.lit(0).alias("none"), *(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(len(words))))
    near = texts.where(some).withColumn("block", F.pmod("key", F.lit(blocks))).repartition("block")
    has = [F.when(F.getbit(f"w{k}", F.lit(i)) == 1, F.lit(t)) for k, ts in enumerate(words) for i, t in enumerate(ts)]
    each = near.select("key", "block", F.explode(F.array(*has).cast("array<string>")).alias("trigram")).where("trigram IS NOT NULL")
    return each.groupBy("trigram", "block").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def candidates(postings: DataFrame, rules) -> DataFrame:
    """(kind, key): the texts whose posting lists meet the trigram query of a rule: lists intersected inside clauses, clauses united, block by block.

    Rules without mandatory trigrams have no rows: every text is a candidate of theirs.
    """
    blocks = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def of(rule: Rule) -> Column:
        lists = ([F.coalesce(F.try_element_at("lists", F.lit(t)), none) for t in sorted(clause)] for clause in trigram_query(rule.pattern))
        return reduce(F.array_union, (reduce(F.array_intersect, clause) for clause in lists), none)

    each = F.array(*(F.struct(F.lit(r.kind).alias("kind"), of(r).alias("keys")) for r in rules))
    return blocks.select(F.explode(each).alias("found")).select("found.kind", F.explode("found.keys").alias("key"))


def _in_bitmap(rows: DataFrame, keys: DataFrame, n: int, text: str, name: str) -> DataFrame:
    """``rows`` with whether the bit of their text is set in a bitmap of ``n`` keys, which is broadcast."""
    chunks = min(MOST_CHUNKS, 1 + (n * BITS_EACH >> CHUNK))
    slot = lambda key: F.pmod(key, F.lit(chunks << CHUNK))
    inside = F.col("slot").bitwiseAND(F.lit((1 << CHUNK) - 1))
    chunk = F.shiftright("slot", CHUNK).alias("chunk")
    bitmap = keys.select(slot(F.col("key")).alias("slot")).groupBy(chunk).agg(F.bitmap_construct_agg(inside).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(inside, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, inside.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    placed = rows.select("*", slot(F.xxhash64(text)).alias("slot")).withColumn("chunk", chunk)
    return placed.join(F.broadcast(bitmap), "chunk", "left").select(*rows.columns, bit.alias(name))


#: Steps of a running total over up to 2**30 elements.
_STEPS = [1 << k for k in range(30)]


def _let(value: Column, make) -> Column:
    """``make`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _running(values: Column, both, least: Column) -> Column:
    """Inclusive running totals of an array under ``both``, by doubling: element i takes in the one 1, 2, 4, ... places before."""
    steps = lambda v: F.filter(F.array(*map(F.lit, _STEPS)), lambda d: d < F.size(v))
    return _let(values, lambda v: F.aggregate(steps(v), v, lambda now, d: F.transform(now, lambda x, i: both(x, F.coalesce(F.get(now, (i - d).cast("int")), least)))))


def _matches(text: Column, rule: Rule) -> Column:
    """The leftmost non-overlapping matches of a rule that are long enough: array<struct<start, end>>, in code points.

    The stretches between matches and the matches themselves alternate, so running sums of their lengths are the offsets.
    """
    pattern = F.lit(rule.pattern)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    part = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else whole
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    before = _let(gaps, lambda g: F.slice(g, F.lit(1), F.size(g) - 1))  # a gap before each match, and one behind the last
    rows = F.arrays_zip(whole.alias("long"), part.alias("part"), before.alias("gap"))
    # the running total rides in ``end``, so each expression is run once
    spans = F.transform(rows, lambda r: F.struct((r["gap"] + r["long"]).alias("end"), r["long"].alias("long"), r["part"].alias("part")))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("long"), F.lit(0).alias("part"))
    placed = _running(spans, lambda x, before: F.struct((x["end"] + before["end"]).alias("end"), x["long"].alias("long"), x["part"].alias("part")), none)
    long_enough = F.filter(placed, lambda r: r["part"] >= rule.least)
    return F.transform(long_enough, lambda r: F.struct((r["end"] - r["long"]).alias("start"), r["end"].alias("end")))


def scan(df: DataFrame, rules=BASE_RULES + MORE_RULES, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with its secrets: ``spans``, an array of (kind, order, start, end), sorted by start, then rule.

    Offsets are code points, the end exclusive. Null and empty texts have an
    empty array; null ids, repeated rows and rows whose ids tie are kept and
    scanned like any other; a column of ``df`` that has the name ``spans`` is
    replaced, and any other name may occur in ``df``. No row moves: one pass without a shuffle.
    """
    rows, back = _aside(df, text, spans)
    return postings(rows, rules).select(*back, _ordered_spans(rules, lambda rule: candidate(rule, rules)).alias(spans))


def search(df: DataFrame, rules=BASE_RULES + MORE_RULES, text: str = "text", spans: str = "spans") -> DataFrame:
    """As ``scan``, through the inverted index: the same rows, with the same spans.

    Reads ``df`` three times (its number of rows, the index, the verification), so it should be a table. What moves are
    posting lists, and the candidates' bitmap of at most 64 MB, which all workers get; no text does. With more candidates than that
    has bits for, more texts are verified and none is lost.
    """
    rows, back = _aside(df, text, spans)
    lists = index(rows, rules, blocks=1 + rows.count() // BLOCK_TEXTS)
    found, n = materialize_counted(candidates(lists, rules), "candidates")
    marked = _in_bitmap(rows, found, n, "text", "listed")
    may = lambda rule: F.col("listed") if trigram_query(rule.pattern) else F.lit(True)
    return marked.select(*back, _ordered_spans(rules, may).alias(spans))


def _aside(df: DataFrame, text: str, spans: str) -> tuple[DataFrame, list]:
    """(row, text) of ``df``, and the columns that give ``df`` back without ``spans``."""
    names = [c for c in df.columns if c != spans]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))  # by number, so dots and clashes in names mean nothing
    return df.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text")), [F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(names)]


def _ordered_spans(rules, may) -> Column:
    """The spans of all rules in the column text, sorted by start, then rule; ``may(rule)`` says of which texts a rule is verified."""
    kind = "array<struct<kind:string,order:int,start:int,end:int>>"

    def of(k: int, rule: Rule) -> Column:
        spans_of = F.transform(_matches(F.col("text"), rule), lambda s: F.struct(F.lit(rule.kind).alias("kind"), F.lit(k).alias("order"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(may(rule) & F.regexp(F.col("text"), F.lit(rule.pattern)), spans_of).otherwise(F.array().cast(kind))

    every = F.flatten(F.array(*(of(k, rule) for k, rule in enumerate(rules))))
    return F.array_sort(every, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["order"] - b["order"]))


def listed(spans: str, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans (of some kinds), comma-joined."""
    kept = F.col(spans) if kinds is None else F.filter(F.col(spans), lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: str, kind: str) -> Column:
    """How many spans of a kind there are."""
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == F.lit(kind))).cast("long")


def blotted(text: Column, spans: str, blot: str) -> Column:
    """The text with its sorted spans replaced, each run of overlapping spans by one ``blot``."""
    # what is covered before each span: the largest end so far
    reach = _running(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), lambda x, before: F.struct(x["start"].alias("start"), F.greatest(x["end"], before["end"]).alias("end")), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    shifted = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), reach)
    pieces = F.zip_with(F.slice(shifted, 1, F.size(spans)), F.col(spans), lambda before, s: F.when(s["start"] >= before["end"], F.concat(F.substr(text, before["end"] + 1, s["start"] - before["end"]), F.lit(blot))).otherwise(F.lit("")))
    return F.concat(F.array_join(pieces, ""), F.substr(text, F.element_at(shifted, -1)["end"] + 1))
