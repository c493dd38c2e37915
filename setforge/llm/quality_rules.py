"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger row holds the failure bits (bit k: rule k failed) and the
measurements behind them. Policies are versioned masks over the bits, so changing or comparing policies never reads a
text again: a policy drops a document where ``bits & mask <> 0``, and an ablation counts the documents that one rule
alone removes (``bits & mask = 1 << k``), by bitwise aggregation over the ledger's distinct bit patterns.

All of it is built-in expressions on one row at a time: nothing is shuffled but the ablation's few patterns.

Repeated 3-word windows are found inside the row: 64-bit window hashes are compared by ``array_distinct``; only texts
with a repeat sort their (hash, position) pairs.

Defined results: null text has no words (and so fails ``few_words``); repeated rows are each in the ledger; an empty
table gives an empty ledger; a null doc_id stays null; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.llm.common import SPACES, WORD

#: Bit k of the ledger is rule k; bits are never reused, new rules go to the end.
RULES = (
    "few_words",  # n_words < 50
    "repeated_words",  # 100 * n_repeat_words > 50 * n_words
    "symbols",  # 10 * n_symbols > n_words
    "repeated_lines",  # 100 * n_dup_lines > 40 * n_lines
    "word_length",  # mean word length under 3 or over 12 code points
    "shouting",  # 100 * n_upper_words > 50 * n_words
    "bullets",  # 100 * n_bullet_lines > 90 * n_lines
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base", 1, RULES[:2])
STANDARD = Policy("standard", 1, RULES)
LENIENT = Policy("lenient", 1, ("repeated_words", "symbols", "repeated_lines"))


def _bound(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once: a lambda's argument is not expanded."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    trimmed = F.expr(r"trim(BOTH ' \t\n\u000B\u000C\r' FROM text)")
    rows = rows.select("doc_id", "text", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    at = lambda words, k: F.get(words, k)
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(at(F.col("words"), i), at(F.col("words"), i + 1), at(F.col("words"), i + 2)))
    rows = rows.select("*", F.when(F.size("words") > 2, windows).otherwise(F.array().cast("array<bigint>")).alias("grams"))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("grams")) == F.size("grams"), F.lit(0)).otherwise(_covered(F.col("grams"))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"))).cast("long").alias("n_upper_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣]"))).cast("long").alias("n_bullet_lines"),
    )


def _covered(grams: Column) -> Column:
    """Words that lie in a window whose hash is there twice or more."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    same = lambda a, k, x: F.coalesce(F.get(a, k)["g"] == x["g"], F.lit(False))
    repeats = _bound(pairs, lambda a: F.transform(F.filter(a, lambda x, k: same(a, k - 1, x) | same(a, k + 1, x)), lambda x: x["i"]))
    gaps = lambda a: F.aggregate(F.transform(a, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - i, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    return _bound(F.sort_array(repeats), gaps)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and bits (long): one evaluation of every rule."""
    c = F.col
    fails = (
        c("n_words") < 50,
        100 * c("n_repeat_words") > 50 * c("n_words"),
        10 * c("n_symbols") > c("n_words"),
        100 * c("n_dup_lines") > 40 * c("n_lines"),
        (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 12 * c("n_words")),
        100 * c("n_upper_words") > 50 * c("n_words"),
        100 * c("n_bullet_lines") > 90 * c("n_lines"),
    )
    bits = F.lit(0).cast("long")
    for k, fail in enumerate(fails):
        bits = bits.bitwiseOR(F.when(fail, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return _measured(docs).withColumn("bits", bits)


def verdict(policy: Policy, bits: str = "bits") -> Column:
    """True where the policy keeps the document."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policies(book: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """The ledger with one boolean column keep_<name>_v<version> for each policy."""
    return book.select("*", *[verdict(p).alias(f"keep_{p.name}_v{p.version}") for p in policies])


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """For every rule of the policy: documents that fail it, and that it alone drops (kept again without it)."""
    patterns = book.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** len(RULES) rows
    mask = F.lit(policy.mask).cast("long")
    each = []
    for r in policy.rules:
        one = F.lit(1 << RULES.index(r)).cast("long")
        each.append(F.struct(F.lit(r).alias("rule"), F.when(F.col("bits").bitwiseAND(one) != 0, F.col("n")).otherwise(0).alias("fails"), F.when(F.col("bits").bitwiseAND(mask) == one, F.col("n")).otherwise(0).alias("alone")))
    rows = patterns.select(F.explode(F.array(*each)).alias("r")).groupBy("r.rule").agg(F.sum("r.fails").alias("n_fail"), F.sum("r.alone").alias("n_only"))
    return rows.select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "rule", "n_fail", "n_only")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    from setforge.llm.common import table

    book = ledger(table(spark, sf_dir, "documents"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~verdict(BASE)).alias("base_failed"), (verdict(BASE) & verdict(STANDARD)).alias("kept"), "bits")


#: The same in DuckDB.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS w FROM (
        SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words FROM (
        SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda w: regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '\p{Ll}'))) AS n_upper,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]'))) AS n_bullets
  FROM t LEFT JOIN c ON c.doc_id = t.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
         + CASE WHEN word_chars < 3 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END
         + CASE WHEN 100 * n_upper > 50 * n_words THEN 32 ELSE 0 END + CASE WHEN 100 * n_bullets > 90 * n_lines THEN 64 ELSE 0 END)::BIGINT AS bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits FROM b
"""
