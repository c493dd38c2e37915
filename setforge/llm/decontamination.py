"""Benchmark decontamination by template canonicalisation.

A text is read in two forms, each a function of the words alone, whatever stands around them. In the *template*, numbers,
names (every capitalised word, so that the start of a sentence is no special case) and units after a number are typed
placeholders; in the *literal* form words are as written, in lower case. Windows of ``window`` words of both forms are
hashed and joined with the windows of the benchmark. Template windows that are mostly placeholders say nothing and are
not compared, nor are templates of items under ``least_words`` words: the literal form holds for these.

A document holds an item if it has ``min(enough, windows)`` of the item's literal windows, or as many of its template
windows along consistent alignments. An alignment sets the slot values (what the placeholders stand for) of the item
against those of the document: for ``consistent`` of the slots a value of the item must stand for one value of the
document throughout, and the item's different values must not run together (the document has at least ``apart`` times as many
different values as the item). So a re-parameterised question is found with its changed values, and a chance
meeting of templates isn't. A template window has at least as many plain words as slots, which the document shares.

Built-in expressions only. The benchmark's windows are broadcast up to ``broadcast_windows`` of them, the ids of candidates up
to ``broadcast_docs``; beyond that the joins are shuffled. Document texts are read once for the windows; slot values are read
from the candidates only.

Defined results: null texts and texts without words hold nothing and are never found; punctuation between words doesn't
count; n_hits and n_windows are of the template where it suffices, else of the literal form, and n_slots, n_changed of
the template's consistent alignment with most slots (0 where there is none); items shorter than a window are one window
of their own length, so a very short item is held by every document with these words in a row; repeated rows count once,
and rows with an id in common are compared text by text; empty tables give an empty result; null ids are left out; other
columns of the inputs are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.llm.common import cut

#: Placeholders: name, number, unit.
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
UNITS = "kilometers?|kilometres?|meters?|metres?|miles?|inches|feet|km|cm|mm|kg|mg|ml|grams?|liters?|litres?|pounds?|dollars?|euros?|cents?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|percent|degrees?|mph|kmh|usd|eur|hz|khz|mhz|gb|mb|%|\\$|€|£|°c|°f|°"
_NUM = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
_TAIL = r"[\p{L}\p{M}'’-]"
_NAMES = rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}\p{{N}}].){_TAIL}*"
_GAP = r"(?:[^\p{L}\p{M}\p{N}.,:/]|[.,:/](?:(?<!\p{Nd}.)|(?!\p{Nd})))+"  # 3.5 is one word
_TEMPLATE_GAP = rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}-{UNIT}]+"
_NO_UNIT = rf"(?![\p{{L}}\p{{N}}{NUMBER}])"
_PIECES = rf"(?:{NAME}{_TAIL}+|{NUMBER}{_NUM}|{UNIT}(?:{UNITS})|[\p{{L}}\p{{M}}\p{{N}}])+"
TEMPLATE, LITERAL = 0, 1


@dataclass(frozen=True)
class LeakParams:
    window: int = 8
    enough: int = 6
    least_words: int = 4
    consistent: float = 0.8
    apart: float = 0.6
    broadcast_windows: int = 500_000
    broadcast_docs: int = 1_000_000


def _plain(text: Column) -> Column:
    """The text, without the characters that serve as placeholders; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(t.rlike(f"[{NAME}-{UNIT}]"), F.translate(t, NAME + NUMBER + UNIT, "   ")).otherwise(t)


def template_words(text: Column) -> Column:
    """Words of the template; may begin and end with an empty one."""
    t = F.lower(F.regexp_replace(text, _NAMES, NAME))
    t = F.regexp_replace(t, _NUM, NUMBER)
    t = F.regexp_replace(t, rf"{NUMBER}[ \t\n\r]?(?:{UNITS}){_NO_UNIT}", f"{NUMBER} {UNIT}")
    return F.split(t, _TEMPLATE_GAP)


def literal_words(text: Column) -> Column:
    """Words as written, in lower case; may begin and end with an empty one."""
    return F.split(F.lower(text), _GAP)


def slot_words(text: Column) -> Column:
    """Words of the template, one for one, but with what each placeholder stands for behind it."""
    t = F.lower(F.regexp_replace(text, _NAMES, f"{NAME}$0"))
    t = F.regexp_replace(t, _NUM, f"{NUMBER}$0")
    t = F.regexp_replace(t, rf"({NUMBER}{_NUM})[ \t\n\r]?({UNITS}){_NO_UNIT}", f"$1 {UNIT}$2")
    return F.regexp_extract_all(t, F.lit(_PIECES), 0)


def _hashed(words: Column) -> Column:
    return F.array_remove(F.transform(words, lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _kind(size: int, form: int) -> int:
    return 2 * size + form


def _windows(h: Column, size: int, form: int) -> Column:
    out = F.transform(F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(F.slice(h, i, size), F.lit(_kind(size, form))))
    return F.when(F.size(h) >= size, out).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, p: LeakParams) -> DataFrame:
    """key (of id and text), item_id, form, size, item_pos, hash, slots (values by word, null for plain words), n_slots, n (the
    item's windows of this form)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("t")).where("item_id is not null and t is not null").dropDuplicates()
    rows = rows.select("item_id", F.xxhash64("item_id", "t").alias("key"), _plain(F.col("t")).alias("t"))
    whole = lambda words: F.filter(words, lambda w: w != "")
    slots = F.transform(slot_words(F.col("t")), lambda w: F.when(w.rlike(f"[{NAME}-{UNIT}]"), w))
    forms = F.array(
        F.struct(F.lit(TEMPLATE).alias("form"), whole(template_words(F.col("t"))).alias("words"), slots.alias("slots")),
        F.struct(F.lit(LITERAL).alias("form"), whole(literal_words(F.col("t"))).alias("words"), F.array().cast("array<string>").alias("slots")),
    )
    rows = rows.select("item_id", "key", F.explode(forms).alias("f")).select("item_id", "key", "f.*").withColumn("words_in", F.size("words")).where("words_in > 0")
    rows = rows.withColumn("size", F.least("words_in", F.lit(p.window))).where(F.col("words_in") >= F.when(F.col("form") == TEMPLATE, p.least_words).otherwise(1))
    at = F.transform(F.sequence(F.lit(1), F.col("words_in") - F.col("size") + 1), lambda i: F.struct(i.alias("i"), F.slice("words", i, F.col("size")).alias("part"), F.slice("slots", i, F.col("size")).alias("slots")))
    rows = rows.select("item_id", "key", "form", "size", F.explode(at).alias("at"))
    rows = rows.select("item_id", "key", "form", "size", (F.col("at.i") - 1).alias("item_pos"), F.col("at.part").alias("part"), F.col("at.slots").alias("slots"))
    rows = rows.withColumn("n_slots", F.size(F.filter("slots", lambda s: s.isNotNull()))).where("2 * n_slots <= size")
    rows = rows.withColumn("hash", F.xxhash64(F.transform("part", lambda w: F.xxhash64(w)), (2 * F.col("size") + F.col("form")).cast("int")))
    n = rows.groupBy("key", "form").agg(F.count(F.lit(1)).alias("n"))
    return rows.drop("part").join(n, ["key", "form"])


def leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """doc_id, item_id, n_hits, n_windows, n_slots, n_changed: a row for each item that a document holds."""
    items = cut(item_windows(benchmark, p), "items")
    kinds = sorted((r["size"], r["form"]) for r in items.select("size", "form").distinct().collect())  # at most two a size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _plain(F.col("text")).alias("t")).where("doc_id is not null")
    own = items.select("hash", "key", "form", "item_pos", "n_slots", "n")
    own = F.broadcast(own) if items.count() <= p.broadcast_windows else own
    hashed = rows.select("doc_id", F.xxhash64("t").alias("d"), _hashed(template_words(F.col("t"))).alias("h0"), _hashed(literal_words(F.col("t"))).alias("h1"))
    none = F.array().cast("array<bigint>")
    hashed = hashed.select("doc_id", "d", F.explode(F.array(*[_windows(F.col(f"h{form}"), size, form) for size, form in kinds], none)).alias("h"))
    hashed = hashed.select("doc_id", "d", F.posexplode("h").alias("doc_pos", "hash"))
    found = hashed.join(own, "hash").drop("hash")

    pair = ["doc_id", "d", "key"]
    enough = F.col("n_hits") >= F.least(F.lit(p.enough), F.col("n"))
    found = cut(found, "hits")
    counts = found.groupBy(*pair, "form").agg(F.countDistinct("item_pos").alias("n_hits"), F.first("n").alias("n"), F.max("n_slots").alias("slotted")).where(enough)
    zero = F.lit(0).cast("long")
    literal = counts.where(F.col("form") == LITERAL).select(*pair, "form", "n_hits", "n", zero.alias("n_slots"), zero.alias("n_changed"))
    template = counts.where(F.col("form") == TEMPLATE)
    hits = found.where(F.col("form") == TEMPLATE).join(template.select(*pair), pair, "left_semi").withColumn("shift", F.col("doc_pos") - F.col("item_pos"))
    lines = _alignments(rows, items, hits.where("n_slots > 0"), p)
    lines = hits.join(lines, [*pair, "shift"], "left").where(F.coalesce((F.col("n_agree") >= p.consistent * F.col("slots")) & (F.col("n_given") >= p.apart * F.col("n_asked")), F.lit(True)))
    best = F.max(F.struct(F.coalesce("slots", zero).alias("slots"), (-F.coalesce("n_changed", zero)).alias("c")))
    lines = lines.groupBy(*pair).agg(F.countDistinct("item_pos").alias("n_hits"), F.first("n").alias("n"), best.alias("b")).where(enough)
    both = literal.unionByName(lines.select(*pair, F.lit(TEMPLATE).alias("form"), "n_hits", "n", F.col("b.slots").alias("n_slots"), (-F.col("b.c")).alias("n_changed")))
    both = both.join(items.select("key", "item_id").distinct(), "key")
    one = F.max(F.struct((-F.col("form")).alias("f"), "n_hits", F.col("n").alias("n_windows"), "n_slots", "n_changed")).alias("one")
    return both.groupBy("doc_id", "item_id").agg(one).select("doc_id", "item_id", "one.n_hits", "one.n_windows", "one.n_slots", "one.n_changed")


def _alignments(docs: DataFrame, items: DataFrame, hits: DataFrame, p: LeakParams) -> DataFrame:
    """For each alignment with slots: slots, n_agree (slots whose item value stands for one value), n_asked and n_given
    (different values of the item and of the document), n_changed."""
    line = ["doc_id", "d", "key", "shift"]
    wanted = hits.select(*line, "doc_pos", "item_pos").join(items.where(F.col("form") == TEMPLATE).select("key", "item_pos", "size", F.col("slots").alias("asked")), ["key", "item_pos"])
    some = cut(wanted.select("doc_id", "d").distinct(), "candidates")
    some = F.broadcast(some) if some.count() <= p.broadcast_docs else some
    words = docs.withColumn("d", F.xxhash64("t")).join(some, ["doc_id", "d"], "left_semi").select("doc_id", "d", slot_words(F.col("t")).alias("words"))
    each = wanted.join(words, ["doc_id", "d"]).select(*line, "item_pos", F.posexplode(F.arrays_zip("asked", F.slice("words", F.col("doc_pos") + 1, F.col("size")).alias("given"))).alias("k", "z"))
    each = each.where("z.asked is not null").select(*line, (F.col("item_pos") + F.col("k")).alias("at"), F.col("z.asked").alias("asked"), F.col("z.given").alias("given")).distinct()
    each = cut(each, "values")
    asked = each.groupBy(*line, "asked").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("given").alias("kinds"), F.sum((F.col("asked") != F.col("given")).cast("long")).alias("changed"))
    asked = asked.groupBy(*line).agg(F.sum("n").alias("slots"), F.sum(F.when(F.col("kinds") == 1, F.col("n")).otherwise(0)).alias("n_agree"), F.count(F.lit(1)).alias("n_asked"), F.sum("changed").alias("n_changed"))
    given = each.groupBy(*line).agg(F.countDistinct("given").alias("n_given"))
    return asked.join(given, line)


def clean(docs: DataFrame, benchmark: DataFrame, p: LeakParams = LeakParams()) -> DataFrame:
    """The rows of docs that hold no item of the benchmark."""
    return docs.join(leaks(docs, benchmark, p).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    from setforge.llm.common import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_sql(p: LeakParams = LeakParams()) -> str:
    """The same in DuckDB, slots included; windows are joined as text."""
    name = r"'(^|[^\p{L}\p{M}\p{N}])(\p{Lu}[\p{L}\p{M}''’-]*)'"
    raw = rf"lower(regexp_replace(translate(text, '{NAME}{NUMBER}{UNIT}', '   '), {name}, '\1{NAME}\2', 'g'))"
    raw = rf"regexp_replace({raw}, '({_NUM})', '{NUMBER}\1', 'g')"
    raw = rf"regexp_replace({raw}, '({NUMBER}{_NUM})[ \t\n\r]?({UNITS})([^\p{{L}}\p{{N}}{NUMBER}]|$)', '\1 {UNIT}\2\3', 'g')"
    raw = f"regexp_extract_all({raw}, '{_PIECES.replace(chr(39), chr(39) * 2)}')"
    tail = _TAIL.replace("'", "''")
    form = f"regexp_replace(regexp_replace(regexp_replace(w, '{NAME}{tail}+', '{NAME}', 'g'), '{NUMBER}{_NUM}', '{NUMBER}', 'g'), '{UNIT}(?:{UNITS})', '{UNIT}', 'g')"
    literal = rf"regexp_extract_all(lower(text), '(?:{_NUM}|[\p{{L}}\p{{M}}\p{{N}}])+')"
    return rf"""
WITH b AS (SELECT DISTINCT item_id, text, item_id::VARCHAR || '/' || md5(text) AS key FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, text, doc_id::VARCHAR || '/' || md5(text) AS d FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
bs AS (SELECT key, {raw} AS slots FROM b),
ds AS (SELECT d, {raw} AS slots FROM d),
bw AS (SELECT key, 0 AS form, slots, list_transform(slots, lambda w: {form}) AS words FROM bs UNION ALL SELECT key, 1, NULL, {literal} FROM b),
dw AS (SELECT d, 0 AS form, list_transform(slots, lambda w: {form}) AS words FROM ds UNION ALL SELECT d, 1, {literal} FROM d),
bz AS (SELECT *, least(len(words), {p.window}) AS size FROM bw WHERE len(words) >= CASE form WHEN 0 THEN {p.least_words} ELSE 1 END),
bp AS (SELECT *, unnest(range(1, len(words) - size + 2)) AS item_pos FROM bz),
bk AS (SELECT *, len(list_filter(words[item_pos : item_pos + size - 1], lambda x: form = 0 AND regexp_matches(x, '[{NAME}-{UNIT}]'))) AS n_slots FROM bp),
k AS (SELECT key, form, size, item_pos, n_slots, slots[item_pos : item_pos + size - 1] AS asked, array_to_string(words[item_pos : item_pos + size - 1], ' ') AS w FROM bk WHERE 2 * n_slots <= size),
n AS (SELECT key, form, count(*) AS n FROM k GROUP BY ALL),
dp AS (SELECT d, form, words, size, unnest(range(1, len(words) - size + 2)) AS doc_pos FROM dw JOIN (SELECT DISTINCT size, form FROM k) USING (form)),
f AS (SELECT d, key, form, doc_pos, item_pos, doc_pos - item_pos AS shift, size, n_slots, asked FROM (SELECT d, form, size, doc_pos, array_to_string(words[doc_pos : doc_pos + size - 1], ' ') AS w FROM dp) JOIN k USING (form, size, w)),
c AS (SELECT d, key, form, count(DISTINCT item_pos) AS n_hits, n FROM f JOIN n USING (key, form) GROUP BY ALL HAVING n_hits >= least({p.enough}, n)),
h AS (SELECT f.* FROM f SEMI JOIN (SELECT * FROM c WHERE form = 0) USING (d, key) WHERE form = 0),
z AS (SELECT d, key, shift, item_pos, doc_pos, asked, unnest(range(0, size)) AS k FROM h WHERE n_slots > 0),
e AS (SELECT DISTINCT z.d, key, shift, item_pos + k AS at, asked[k + 1] AS asked, ds.slots[doc_pos + k] AS given FROM z JOIN ds ON ds.d = z.d WHERE regexp_matches(asked[k + 1], '[{NAME}-{UNIT}]')),
a AS (SELECT d, key, shift, asked, count(*) AS m, count(DISTINCT given) AS kinds, sum((asked <> given)::INT) AS changed FROM e GROUP BY ALL),
l AS (SELECT d, key, shift, sum(m) AS slots, sum(CASE WHEN kinds = 1 THEN m ELSE 0 END) AS n_agree, count(*) AS n_asked, sum(changed) AS changed FROM a GROUP BY ALL),
g AS (SELECT d, key, shift, count(DISTINCT given) AS n_given FROM e GROUP BY ALL),
o AS (SELECT h.d, h.key, item_pos, coalesce(slots, 0) AS slots, coalesce(changed, 0) AS changed FROM h LEFT JOIN l USING (d, key, shift) LEFT JOIN g USING (d, key, shift)
  WHERE slots IS NULL OR n_agree >= {p.consistent} * slots AND n_given >= {p.apart} * n_asked),
t AS (SELECT d, key, 0 AS form, count(DISTINCT item_pos) AS n_hits, n, max((slots, -changed)) AS best FROM o JOIN n USING (key) WHERE form = 0 GROUP BY d, key, n HAVING n_hits >= least({p.enough}, n)),
u AS (SELECT d, key, form, n_hits, n, best[1] AS n_slots, -best[2] AS n_changed FROM t UNION ALL SELECT d, key, form, n_hits, n, 0, 0 FROM c WHERE form = 1)
SELECT doc_id, item_id, r[2]::BIGINT AS n_hits, r[3]::BIGINT AS n_windows, r[4]::BIGINT AS n_slots, r[5]::BIGINT AS n_changed
FROM (SELECT doc_id, item_id, max((-form, n_hits, n, n_slots, n_changed)) AS r FROM u JOIN d USING (d) JOIN b USING (key) GROUP BY doc_id, item_id)
"""
