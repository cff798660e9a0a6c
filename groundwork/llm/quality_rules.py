"""Quality rules as a bitmask ledger, in DataFrame and SQL functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose
bit b says that rule b failed. A policy is a version name and a set of rules: applying it is one
bitwise AND, so verdicts of any number of policies, and what each would keep without one of its
rules, come from the stored ledger without reading a text again.

Nothing is shuffled: a document is measured inside its row. Repeated three-word windows are found by
sorting the hashes of a text's windows with their positions packed into the low bits; where two
equal hashes turn out to stand for different words, that text is measured by the words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.registry import query, table
from groundwork.llm.storage import stored

_BLANKS = " \t\n\x0b\f\r"
_BLANK, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_SYMBOL = "[#*$%&|<>]"
#: Hash of a window of three words, as SQL over word array ``words`` and position ``i``.
WINDOW_HASH = "xxhash64(words[i], words[i + 1], words[i + 2])"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; it must not be null. ``bit`` never changes its meaning."""

    name: str
    bit: int
    fails: str


#: Measurements: n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 60 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 15 * n_words"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A document is kept when it fails none of ``rules``."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {rule.name: rule.bit for rule in rules}
        unknown = [name for name in self.rules if name not in bits]
        if unknown:
            raise ValueError(f"policy {self.version} names unknown rules {unknown}")
        return sum(1 << bits[name] for name in set(self.rules))


POLICIES = (Policy("base", BASE), Policy("v1", (*BASE, "symbols", "repeated_lines")), Policy("v2", tuple(r.name for r in RULES)))


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and the measurements, all long.

    Words are ``[^\\x20\\x09-\\x0D]+``. n_repeat_words counts the words inside three-word windows that
    stand twice or more in the text, the first time included. A null text is the empty one, and all
    its measurements are 0. Repeated rows are measured each on their own; other columns are not
    looked at, whatever their names. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    bare = F.btrim("text", F.lit(_BLANKS))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(_WORD))
    split = texts.select("*", bare.alias("bare"), lines.alias("lines")).select(
        "*", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", _BLANK + "+", -1)).alias("words")
    )
    counted = split.select(
        "doc_id",
        "words",
        F.size("words").alias("n"),
        # Bits that hold any position of the text.
        F.length(F.bin(F.size("words"))).alias("bits"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOL)).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    keyed = counted.selectExpr(
        "*",
        f"sort_array(if(n < 3, CAST(array() AS array<bigint>), transform(sequence(0, n - 3), i -> shiftleft({WINDOW_HASH}, bits) | CAST(i AS BIGINT)))) AS keys",
        "shiftleft(1L, bits) - 1 AS low",
    )
    paired = keyed.selectExpr(
        "*",
        "if(size(keys) < 2, CAST(array() AS array<int>), filter(sequence(1, size(keys) - 1), i -> shiftrightunsigned(keys[i] ^ keys[i - 1], bits) = 0)) AS pairs",
    )
    mine, other = "CAST(keys[i] & low AS INT)", "CAST(keys[i - 1] & low AS INT)"
    differs = " OR ".join(f"words[{mine} + {k}] <> words[{other} + {k}]" for k in range(3))
    exact = """
        transform(array(sort_array(transform(sequence(0, n - 3), i -> struct(words[i] AS a, words[i + 1] AS b, words[i + 2] AS c, i AS at)))), s ->
            sort_array(array_distinct(flatten(transform(
                filter(sequence(1, size(s) - 1), i -> s[i].a = s[i - 1].a AND s[i].b = s[i - 1].b AND s[i].c = s[i - 1].c),
                i -> array(s[i].at, s[i - 1].at))))))[0]"""
    starts = paired.selectExpr(
        "*",
        f"CASE WHEN size(pairs) = 0 THEN CAST(array() AS array<int>) WHEN exists(pairs, i -> {differs}) THEN {exact} "
        f"ELSE sort_array(array_distinct(flatten(transform(pairs, i -> array({mine}, {other}))))) END AS starts",
    )
    covered = "aggregate(starts, named_struct('n', 0L, 'last', -3), (sum, at) -> named_struct('n', sum.n + least(3, at - sum.last), 'last', at), sum -> sum.n)"
    found = starts.selectExpr(
        "doc_id", "CAST(n AS BIGINT) AS n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", f"{covered} AS n_repeat_words"
    )
    # A filter on a measurement must not be pushed below: it would repeat all the steps above in its own text.
    return found.select(F.inline(F.array(F.struct(*found.columns))))


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """:func:`measure` and ``failed`` (long): bit b is set where the rule of bit b fails."""
    bits = [rule.bit for rule in rules]
    if len(set(bits)) != len(bits) or not all(0 <= bit < 63 for bit in bits):
        raise ValueError("rules need different bits from 0 to 62")
    failed = " | ".join(f"if({rule.fails}, {1 << rule.bit}L, 0L)" for rule in rules) or "0L"
    return measure(docs, id_column, text_column).withColumn("failed", F.expr(failed))


def apply_policy(found: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, name: str = "kept") -> DataFrame:
    """The rows of a ledger with ``name``: whether the policy keeps them."""
    return found.withColumn(name, F.col("failed").bitwiseAND(F.lit(policy.mask(rules))) == 0)


def ablation(found: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(version, rule, n_docs, n_failed, n_sole, n_kept, n_kept_without), one row per policy and rule of it.

    ``n_sole`` documents fail this rule of the policy and no other, so ``n_kept_without`` = n_kept +
    n_sole would be kept if the rule were dropped. The ledger is summed by failure pattern first, so
    what is multiplied by policies and rules is one row per pattern. An empty ledger gives no rows.
    """
    asked = [(p.version, p.mask(rules), r.name, 1 << r.bit) for p in policies for r in rules if r.name in p.rules]
    patterns = found.groupBy("failed").agg(F.count("*").alias("docs"))
    one = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(m).cast("long").alias("mask"), F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for v, m, n, b in asked))
    hit = patterns.select("failed", "docs", F.explode(one).alias("p")).select("failed", "docs", "p.*").withColumn("bad", F.expr("failed & mask"))

    def docs_where(condition: str):
        return F.sum(F.expr(f"if({condition}, docs, 0L)"))

    return hit.groupBy("version", "rule").agg(
        F.sum("docs").alias("n_docs"),
        docs_where("failed & bit <> 0").alias("n_failed"),
        docs_where("bad = bit").alias("n_sole"),
        docs_where("bad = 0").alias("n_kept"),
        docs_where("bad & ~bit = 0").alias("n_kept_without"),
    )


def failures_by(found: DataFrame, group: str) -> DataFrame:
    """(group, n_docs, any_failed, all_failed): bits that some, and that all, documents of a group fail."""
    return found.groupBy(group).agg(F.count("*").alias("n_docs"), F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"))


OP13_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS MATERIALIZED (
    SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM texts),
grams AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM cut)),
again AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
spans AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
m AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM cut LEFT JOIN spans USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 60 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM f
"""


@query("op13_quality_rules", OP13_SQL)
def op13(spark: SparkSession, directory: str) -> DataFrame:
    found = stored(ledger(table(spark, directory, "documents")), "ledger")
    base, latest = POLICIES[0], POLICIES[-1]
    judged = apply_policy(apply_policy(found, base, name="base_kept"), latest)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept"
    )
