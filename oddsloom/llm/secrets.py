"""Secrets in texts, found through a trigram inverted index.

Each rule's regular expression gives a Boolean query over the trigrams that any match must hold. The index lists, for
each trigram that some rule names, the documents that hold it (in lower case); lists no rule asks for are not written.
Intersecting and uniting the lists leaves each rule's candidates, and only their texts are searched with its
expression. Rules without a mandatory trigram search every text.

Candidates meet the texts through bitmaps of fixed size, one per rule, so that no text is shuffled. A bitmap can let a
text through that is no candidate, never the reverse; the search itself decides. Ids need not be unique for that.

Nulls: a null text is empty; a null id is an id like any other here. Texts of any length are searched whole; a text's
matches are laid out in blocks, so that their number does not slow each one down. Spans are counted in code points,
the end exclusive. Two rules may find the same place. Rows that repeat give equal rows each. Other columns are ignored.
No rows: no rows. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.trigrams import evaluate, lookahead, trigram_query, trigrams


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has at least `least` characters; a shorter match is passed over whole."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


def _letters(word: str) -> str:
    """A pattern for an ASCII word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base rules, in order of report.
BASE = (
    Rule(
        "assign",
        f"({'|'.join(map(_letters, ('password', 'passwd', 'secret', 'token')))}|{_letters('api')}_?{_letters('key')})"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    # Longest runs are the same whether their length is asked for before or after.
    Rule("hex", "[0-9a-f]{16,}", 16),
)
# Published shapes of keys and logins.
MORE = (
    Rule("private_key", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z]{2,12}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/@]{1,64}@"),
)
#: Bits of a rule's bitmap: 512 pieces of 4 kB.
SCREEN_BITS = 1 << 24
#: Matches of a text that are laid out together.
BLOCK = 256


def trigram_index(docs: DataFrame, vocabulary: Sequence[str], *, id_col: str, text_col: str) -> DataFrame:
    """(trigram, id): the documents that hold each trigram of the vocabulary in lower case."""
    held = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(lookahead(vocabulary)), F.lit(1))
    return docs.select(F.explode(F.array_distinct(held)).alias("trigram"), F.col(id_col).alias("id"))


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(id, one flag per query): documents that satisfy at least one of the queries, by their lists.

    A document's place in the lists is gathered over the vocabulary, which the rules bound."""
    met = index.groupBy("id").agg(F.collect_set("trigram").alias("held"))
    flags = [_truth(query, F.col("held")).alias(name) for name, query in queries.items()]
    return met.select("id", *flags).filter(reduce(or_, [F.col(name) for name in queries]))


def _truth(query, held: Column) -> Column:
    return evaluate(query, lambda t: F.array_contains(held, t), lambda parts: reduce(and_, parts), lambda parts: reduce(or_, parts))


def _spot(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(SCREEN_BITS)) + 1


def _marked(rows: DataFrame, found: DataFrame, flags: Sequence[str]) -> DataFrame:
    """`rows` with a column per flag that is true wherever `found` has it for the row's id, and seldom elsewhere."""
    spot = _spot(F.col("id"))
    maps = found.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(
        *[F.bitmap_construct_agg(F.when(F.col(name), F.bitmap_bit_position(spot))).alias(f"bits_{name}") for name in flags]
    )
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(spot) == F.col("bucket"), "left")
    place = F.bitmap_bit_position(spot)
    octet = lambda name: F.conv(F.hex(F.substring(f"bits_{name}", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = {name: F.coalesce(F.getbit(octet(name), (place % 8).cast("int")) == 1, F.lit(False)) for name in flags}
    return met.select(*rows.columns, *[column.alias(name) for name, column in may.items()])


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def _totals(steps: Column, start: Column) -> Column:
    """Running sums of an array, in place of a window."""
    list_ = F.array().cast("array<bigint>")
    add = lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.array_append(acc["all"], acc["t"] + x).alias("all"))
    return F.aggregate(steps, F.struct(start.cast("bigint").alias("t"), list_.alias("all")), add, lambda acc: acc["all"])


def running_totals(steps: Column, block: int = BLOCK) -> Column:
    """Running sums of a non-empty array of bigint: inside blocks, on top of the running sums of the blocks."""
    zero = F.lit(0).cast("bigint")
    whole = lambda b: F.aggregate(b, zero, lambda acc, x: acc + x)
    cut = lambda s: F.transform(F.sequence(F.lit(1), F.size(s), F.lit(block)), lambda at: F.slice(s, at, F.lit(block)))

    def laid(blocks: Column) -> Column:
        upto = _totals(F.transform(blocks, whole), zero)
        return F.flatten(F.zip_with(blocks, upto, lambda b, end: _totals(b, end - whole(b))))

    return _let(steps, lambda s: _let(cut(s), laid))


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's leftmost non-overlapping matches that are long enough, as an array of (start, end)."""
    p, size = F.lit(rule.pattern), lambda c: F.length(c).cast("bigint")
    long_enough = F.lit(True)

    def laid(matches: Column) -> Column:
        # What stands between two matches, and the match before it, lead to the next start.
        before = F.concat(F.array(F.lit("")), F.slice(matches, F.lit(1), F.size(matches) - 1))
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches))
        starts = running_totals(F.zip_with(gaps, before, lambda g, m: size(g) + size(m)))
        part = lambda m: m if rule.group == 0 else F.regexp_extract(m, rule.pattern, rule.group)
        placed = F.zip_with(
            starts, matches,
            lambda s, m: F.struct(s.alias("start"), (s + size(m)).alias("end"), (F.length(part(m)) >= rule.least if rule.least else long_enough).alias("fits")),
        )
        return F.transform(F.filter(placed, lambda x: x["fits"]), lambda x: F.struct(x["start"], x["end"]))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return _let(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(laid(m)))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = BASE + MORE) -> DataFrame:
    """(id_col, secrets) per row of `docs`: an array of (start, no, end, kind) ordered by start, then place of the rule."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = {f"may_{k}": trigram_query(rule.pattern) for k, rule in enumerate(rules)}
    bound = {name: query for name, query in queries.items() if query is not True}
    if bound:
        vocabulary = sorted(set().union(*map(trigrams, bound.values())))
        rows = _marked(rows, candidates(trigram_index(rows, vocabulary, id_col="id", text_col="text"), bound), list(bound))
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>")

    def told(k: int, rule: Rule) -> Column:
        named = F.transform(
            spans_of(F.col("text"), rule), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("no"), x["end"].alias("end"), F.lit(rule.kind).alias("kind"))
        )
        return F.when(F.col(f"may_{k}"), named).otherwise(none) if f"may_{k}" in bound else named

    every = F.array_sort(F.concat(*[told(k, rule) for k, rule in enumerate(rules)]))
    return rows.select(F.col("id").alias(id_col), every.alias("secrets"))


def secret_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: Sequence[Rule] = BASE, more: Sequence[Rule] = MORE) -> DataFrame:
    """Counts per base kind, a digest of the base spans and all spans as text, per row of `docs`."""
    found = scan_secrets(docs, id_col=id_col, text_col=text_col, rules=(*base, *more))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["no"] == k)).cast("bigint")
    return found.select(
        id_col, *[count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(base)],
        F.sha2(text(F.filter("secrets", lambda x: x["no"] < len(base))), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"),
    )
