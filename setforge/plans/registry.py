"""Queries of the set sketches over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.functions import hashing as H
from setforge.operators import minwise, oneperm, ordered, setsketch, similarity, weighted
from setforge.plans.tables import table
from setforge.sources import sets
from setforge.streaming.windows import window_registers

M, BINS, POINTS, ORD_M, ORD_L = 16, 64, 192, 8, 3
P = setsketch.SketchParams(m=32)
Query = Callable[[SparkSession, str], DataFrame]

# --- sources -----------------------------------------------------------------------------------------------------------


def _tokens(s, d):
    return sets.token_sets(table(s, d, "documents"))


def _parts(s, d):
    return sets.supplier_parts(table(s, d, "lineitem"))


def _pairs(rows):
    return similarity.neighbours(rows)


TOKENS = r"(SELECT DISTINCT doc_id AS set_id, item FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS item FROM documents) WHERE item <> '')"
TERMS = r"(SELECT doc_id AS set_id, item, count(*)::DOUBLE AS weight FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS item FROM documents) WHERE item <> '' GROUP BY doc_id, item)"
PARTS = "(SELECT l_suppkey AS set_id, l_partkey AS item, sum(l_quantity) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey)"
LARGE = "(SELECT l_suppkey AS set_id, l_partkey AS item, sum(greatest(l_quantity - 25, 0)) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey HAVING sum(greatest(l_quantity - 25, 0)) > 0)"


def _sql_pairs(rows: str) -> str:
    return f"(SELECT a, a + 1 AS b FROM (SELECT DISTINCT set_id AS a FROM {rows}) WHERE a + 1 IN (SELECT set_id FROM {rows}))"


def _sql_sample(rows: str, m: int = M, keys: str = "set_id", family: str = "md5") -> str:
    u = H.sql_uniform("concat_ws('#', item, slot)", family)
    return f"""(SELECT {keys}, slot, min(x).h AS h, min(x).item AS item FROM (
      SELECT {keys}, slot, {{'h': -ln({u}) / weight, 'item': item}} AS x FROM {rows}, (SELECT unnest(range({m}))::INT AS slot)) GROUP BY {keys}, slot)"""


# --- weighted sets -----------------------------------------------------------------------------------------------------


def _flat(sig: DataFrame, name: str = "item") -> DataFrame:
    return sig.select("set_id", F.posexplode("sig").alias("slot", name))


def _term_sample(s, d):
    return weighted.sample(sets.token_weights(table(s, d, "documents")), M, scattered=False)


def pminhash_sig(s, d):
    return _term_sample(s, d).select("set_id", "slot", "item")


def pminhash_wide(s, d):
    """The wide form, unfolded again for comparison."""
    return _flat(weighted.wide(weighted.sample(_parts(s, d), M)))


def pminhash_neighbours(s, d):
    return similarity.neighbour_jaccard(_term_sample(s, d), M, "item")


def _sql_jaccard(long: str, pairs: str, m: int, value: str) -> str:
    return f"""WITH l AS MATERIALIZED {long} SELECT a, b, sum(CASE WHEN x.{value} = y.{value} THEN 1 ELSE 0 END)::BIGINT AS n_equal,
      sum(CASE WHEN x.{value} = y.{value} THEN 1 ELSE 0 END) / {m} AS jaccard, 1 - sum(CASE WHEN x.{value} = y.{value} THEN 1 ELSE 0 END) / {m} AS distance
      FROM {pairs} p JOIN l x ON x.set_id = p.a JOIN l y ON y.set_id = p.b AND y.slot = x.slot GROUP BY a, b"""


def _large(s, d):
    return sets.weighted(table(s, d, "lineitem"), "l_suppkey", "l_partkey", F.greatest(F.col("l_quantity") - 25, F.lit(0)))


def pminhash_zero_weight(s, d):
    """Weights of 0 leave no trace."""
    return weighted.sample(_large(s, d), M).select("set_id", "slot", "item")


def pminhash_map_input(s, d):
    maps = _parts(s, d).groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("item", "weight"))).alias("weights"))
    return weighted.sample(sets.from_map(maps, "set_id", "weights"), M).select("set_id", "slot", "item")


def pminhash_merge_max(s, d):
    """Sketches by supplier and line status, merged by supplier: pointwise largest weights."""
    line = table(s, d, "lineitem").withColumn("key", F.struct("l_suppkey", "l_linestatus"))
    both = weighted.sample(sets.weighted(line, "key", "l_partkey", F.col("l_quantity")), M)
    return weighted.merge_groups(both.select(F.col("set_id.l_suppkey").alias("set_id"), "slot", "h", "item"), "set_id").select("set_id", "slot", "item")


MERGED = "(SELECT set_id, item, max(weight) AS weight FROM (SELECT l_suppkey AS set_id, l_linestatus, l_partkey AS item, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL) GROUP BY set_id, item)"


def pminhash_sha(s, d):
    return weighted.sample(_parts(s, d), M, family="sha256").select("set_id", "slot", "item")


def pmh3_points(s, d):
    return weighted.sample_points(_parts(s, d), M, POINTS).select("set_id", "slot", "item")


def _sql_points(rows: str) -> str:
    e, rate = H.sql_uniform("concat_ws('#', item, i, 'e')"), math.log(M / (M - 1))
    return f"""WITH s AS MATERIALIZED {rows}, c AS (SELECT item, slot, min(i + e) AS c FROM (
      SELECT item, ({H.sql_bits52("concat_ws('#', item, i, 's')")} % {M})::INT AS slot, i, -ln(1.0 - (1.0 - {e}) * {1.0 - math.exp(-rate)!r}::DOUBLE) / {rate!r}::DOUBLE AS e
      FROM (SELECT DISTINCT item FROM s), (SELECT unnest(range({64 * M})) AS i)) GROUP BY item, slot)
      SELECT set_id, slot, min(x).item AS item FROM (SELECT set_id, slot, {{'h': c / weight, 'item': s.item}} AS x FROM s JOIN c ON c.item = s.item) GROUP BY set_id, slot"""


def pmh3_neighbours(s, d):
    return similarity.neighbour_jaccard(weighted.sample_points(_parts(s, d), M, POINTS), M, "item")


def jp_exact(s, d):
    rows = _parts(s, d)
    return similarity.exact_probability_jaccard(rows, _pairs(rows))


SQL_JP = f"""WITH s AS MATERIALIZED {PARTS}, p AS {_sql_pairs("s")},
  u AS (SELECT a, b, item, sum(wa) AS wa, sum(wb) AS wb FROM (SELECT a, b, item, weight AS wa, 0.0 AS wb FROM p JOIN s ON s.set_id = a UNION ALL SELECT a, b, item, 0.0, weight FROM p JOIN s ON s.set_id = b) GROUP BY a, b, item),
  o AS (SELECT *, CASE WHEN wb > 0 THEN wa / wb ELSE 'infinity'::DOUBLE END AS ratio FROM u),
  r AS (SELECT *, sum(wa) OVER (PARTITION BY a, b ORDER BY ratio, item ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up,
               coalesce(sum(wb) OVER (PARTITION BY a, b ORDER BY ratio, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS down FROM o),
  j AS (SELECT a, b, coalesce(sum(CASE WHEN wa > 0 AND wb > 0 THEN 1.0 / (up / wa + down / wb) END), 0.0) AS jp FROM r GROUP BY a, b)
  SELECT a, b, round(jp, 9) AS jp, round(1 - jp, 9) AS distance FROM j"""


# --- plain sets --------------------------------------------------------------------------------------------------------


def jaccard_exact(s, d):
    rows = _tokens(s, d)
    return similarity.exact_jaccard(rows, _pairs(rows), BINS)


SQL_JACCARD = f"""WITH s AS MATERIALIZED {TOKENS}, n AS (SELECT set_id, count(*) AS n FROM s GROUP BY set_id), p AS {_sql_pairs("s")},
  c AS (SELECT a, b, count(*) AS n_both FROM p JOIN s x ON x.set_id = a JOIN s y ON y.set_id = b AND y.item = x.item GROUP BY a, b),
  j AS (SELECT p.a, p.b, coalesce(n_both, 0)::BIGINT AS n_both, (na.n + nb.n - coalesce(n_both, 0))::BIGINT AS n_any FROM p JOIN n na ON na.set_id = p.a JOIN n nb ON nb.set_id = p.b LEFT JOIN c ON c.a = p.a AND c.b = p.b)
  SELECT a, b, n_both, n_any, round(n_both / n_any, 9) AS jaccard, round(1 - n_both / n_any, 9) AS distance, round(sqrt(n_both / n_any * (1 - n_both / n_any) / {BINS}), 9) AS sigma FROM j"""

_PERM = f"SELECT item, slot, (row_number() OVER (PARTITION BY item ORDER BY {H.sql_bits52("concat_ws('#', item, slot, 'p')")}, slot) - 1)::INT AS j FROM (SELECT DISTINCT item FROM s), (SELECT unnest(range({M}))::INT AS slot)"
_VISITS = f"(SELECT s.set_id, s.item, j, slot, {H.sql_uniform("concat_ws('#', s.item, j, 'r')")} AS r FROM s JOIN ({_PERM}) v ON v.item = s.item)"
SQL_SMH = f"(SELECT set_id, slot, min(r + j) AS value FROM {_VISITS} GROUP BY set_id, slot)"
SQL_SMH2 = f"(SELECT set_id, slot, min(x).hash AS value FROM (SELECT set_id, slot, {{'j': j, 'r': r, 'hash': {H.sql_item_hash('item')}}} AS x FROM {_VISITS}) GROUP BY set_id, slot)"


def superminhash_sig(s, d):
    return minwise.superminhash(_tokens(s, d), M)


def superminhash_f32(s, d):
    return superminhash_sig(s, d).select("set_id", "slot", F.col("value").cast("float").cast("double").alias("value"))


def superminhash_jaccard(s, d):
    return similarity.neighbour_jaccard(superminhash_sig(s, d), M)


def superminhash2_sig(s, d):
    return minwise.superminhash2(_tokens(s, d), M)


def superminhash2_jaccard(s, d):
    return similarity.neighbour_jaccard(superminhash2_sig(s, d), M)


def slot_permutation(s, d):
    """The order in which each part visits the slots."""
    return table(s, d, "part").select(F.col("p_partkey").alias("item"), F.posexplode(minwise.permutation(F.col("p_partkey"), M)).alias("j", "slot"))


# --- one permutation ---------------------------------------------------------------------------------------------------


def oph_bins(s, d):
    return oneperm.bins(_tokens(s, d), BINS)


SQL_BINS = f"""(SELECT set_id, slot, min(x).r AS r, min(x).hash AS value FROM (SELECT set_id, ({H.sql_bits52("concat_ws('#', item, 'b')")} % {BINS})::INT AS slot,
  {{'r': {H.sql_uniform("concat_ws('#', item, 'u')")}, 'hash': {H.sql_item_hash('item')}}} AS x FROM {TOKENS}) GROUP BY set_id, slot)"""


def _dense(s, d, scheme):
    return oneperm.densify(oph_bins(s, d), BINS, scheme)


def oph_optdens(s, d):
    return _flat(_dense(s, d, "optimal"), "value")


def oph_revoptdens(s, d):
    return _flat(_dense(s, d, "reverse"), "value")


def oph_empty(s, d):
    return _dense(s, d, "optimal").select("set_id", "n_empty")


def _sql_dense(scheme: str) -> str:
    rows = [f"({k},{n},{j})" for k, x in enumerate(oneperm.donors(BINS, scheme)) for n, j in enumerate(x)]
    return f"""WITH f AS MATERIALIZED {SQL_BINS}, t AS (SELECT * FROM (VALUES {",".join(rows)}) v(k, n, j)),
      e AS (SELECT set_id, k FROM (SELECT DISTINCT set_id FROM f), (SELECT unnest(range({BINS}))::INT AS k) EXCEPT SELECT set_id, slot FROM f),
      g AS (SELECT e.set_id, e.k AS slot, arg_min(f.value, t.n) AS value FROM e JOIN t ON t.k = e.k JOIN f ON f.set_id = e.set_id AND f.slot = t.j GROUP BY ALL)
      SELECT set_id, slot, value FROM f UNION ALL SELECT set_id, slot, value FROM g"""


def _compacted(scheme: str, bits: int) -> Query:
    def run(s, d):
        dense = _dense(s, d, scheme)
        return _flat(dense.select("set_id", oneperm.compact(F.col("sig"), bits).alias("sig")), "value")

    return run


def _sql_compacted(scheme: str, bits: int) -> str:
    return f"SELECT set_id, slot, {H.sql_hash32('value')} >> {32 - bits} AS value FROM ({_sql_dense(scheme)})"


def oph_jaccard(s, d):
    return similarity.neighbour_jaccard(oph_optdens(s, d), BINS)


def oph_revjaccard(s, d):
    return similarity.neighbour_jaccard(oph_revoptdens(s, d), BINS)


# --- SetSketch ---------------------------------------------------------------------------------------------------------

_REG = f"greatest(0, least({P.q + 1}, floor(1.0 - ln(x) / {P.ln_b!r}::DOUBLE)))::INT"
_X = f"-ln({H.sql_uniform("concat_ws('#', item, slot, 'k')")}) / {P.a!r}::DOUBLE"


def _sql_regs(rows: str, keys: str = "set_id") -> str:
    return f"(SELECT {keys}, slot, {_REG} AS reg FROM (SELECT {keys}, slot, min({_X}) AS x FROM {rows}, (SELECT unnest(range({P.m}))::INT AS slot) GROUP BY {keys}, slot))"


def setsketch_regs(s, d):
    return setsketch.registers(_tokens(s, d), P)


def setsketch_card(s, d):
    return setsketch.cardinality(setsketch_regs(s, d), P, "set_id")


_N = f"round({P.m * (1 - 1 / P.b)!r}::DOUBLE / {P.a * P.ln_b!r}::DOUBLE / sum(exp(-reg * {P.ln_b!r}::DOUBLE)), 3)"


def _lang_regs(s, d):
    docs = table(s, d, "documents").select("lang", "source", F.col("doc_id").alias("set_id"))
    return setsketch_regs(s, d).join(docs, "set_id")


def setsketch_merge(s, d):
    """Unions of the documents of each language, from their sketches."""
    return setsketch.merge(_lang_regs(s, d), "lang")


def sketch_rollup(s, d):
    """Distinct tokens by language and source, with subtotals, from sketches alone."""
    regs = _lang_regs(s, d).select(F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce("source", F.lit("-")).alias("source"), "slot", "reg")
    both = setsketch.merge(regs, "lang", "source")
    levels = both.rollup("lang", "source", "slot").agg(F.max("reg").alias("reg"), F.grouping("slot").alias("g")).where("g = 0")
    upper = both.groupBy("lang", "slot").agg(F.max("reg").alias("reg")).select("lang", F.lit("*").alias("source"), "slot", "reg")
    whole = both.groupBy("slot").agg(F.max("reg").alias("reg")).select(F.lit("*").alias("lang"), F.lit("*").alias("source"), "slot", "reg")
    every = levels.select("lang", "source", "slot", "reg").unionByName(upper).unionByName(whole)
    return setsketch.cardinality(every, P, "lang", "source").select("lang", "source", "n_est")


def setsketch_diag(s, d):
    return setsketch.diagnostics(setsketch_regs(s, d), P, "set_id")


def setsketch_bounds(s, d):
    """Bounds of the similarity for the share of equal registers of each pair."""
    share = similarity.neighbour_jaccard(setsketch_regs(s, d), P.m, "reg").select("a", "b", F.col("jaccard").alias("share"))
    low, high = setsketch.jaccard_bounds(F.col("share"), P)
    return share.select("a", "b", "share", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _counts(s, d):
    return setsketch.compared(similarity.neighbour_slots(setsketch_regs(s, d), "reg"), P)


def setsketch_mle_b1(s, d):
    return setsketch.likelihood_b1(_counts(s, d))


def setsketch_mle(s, d):
    return setsketch.likelihood(_counts(s, d), P)


def _sql_counts() -> str:
    scale = f"{P.m * (1 - 1 / P.b) / (P.a * P.ln_b)!r}::DOUBLE"
    side = lambda x: f"round({scale} / sum(exp(-{x}.reg * {P.ln_b!r}::DOUBLE)), 3)"
    return f"""r AS MATERIALIZED {_sql_regs(TOKENS)}, c AS (SELECT a, b, sum(CASE WHEN x.reg > y.reg THEN 1 ELSE 0 END)::BIGINT AS d_plus, sum(CASE WHEN x.reg < y.reg THEN 1 ELSE 0 END)::BIGINT AS d_minus,
      sum(CASE WHEN x.reg = y.reg THEN 1 ELSE 0 END)::BIGINT AS d_zero, {side("x")} AS n_a, {side("y")} AS n_b FROM {_sql_pairs("r")} p JOIN r x ON x.set_id = a JOIN r y ON y.set_id = b AND y.slot = x.slot GROUP BY a, b)"""


SQL_MLE = f"""WITH {_sql_counts()}, k AS (SELECT *, n_a / (n_a + n_b) AS u, n_b / (n_a + n_b) AS v, d_plus + d_minus + d_zero AS m FROM c),
  q AS (SELECT *, u * u * (d_minus + d_zero) AS s, v * v * (d_plus + d_zero) AS t FROM k)
  SELECT a, b, round(greatest(0.0, least(1.0, (s + t - sqrt((s - t) * (s - t) + 4.0 * d_minus * d_plus * u * u * v * v)) / (2.0 * u * v * m))), 6) AS jaccard FROM q"""

SQL_BOUNDS = f"""WITH r AS MATERIALIZED {_sql_regs(TOKENS)}, j AS (SELECT a, b, sum(CASE WHEN x.reg = y.reg THEN 1 ELSE 0 END) / {P.m} AS share FROM {_sql_pairs("r")} p JOIN r x ON x.set_id = a JOIN r y ON y.set_id = b AND y.slot = x.slot GROUP BY a, b),
  e AS (SELECT *, exp(share * {P.ln_b / 2!r}::DOUBLE) AS x FROM j)
  SELECT a, b, share, round(greatest(0.0, 2.0 * (x * {math.sqrt(P.b)!r}::DOUBLE - 1.0) / {P.b - 1!r}::DOUBLE - 1.0), 6) AS low, round((x * x - 1.0) / {P.b - 1!r}::DOUBLE, 6) AS high FROM e"""

_LANG = f"(SELECT coalesce(lang, '-') AS lang, coalesce(source, '-') AS source, r.* FROM {_sql_regs(TOKENS)} r JOIN documents d ON d.doc_id = r.set_id)"
SQL_ROLLUP = f"""WITH l AS MATERIALIZED {_LANG}, g AS (SELECT lang, source, slot, max(reg) AS reg FROM l GROUP BY lang, source, slot UNION ALL
  SELECT lang, '*', slot, max(reg) FROM l GROUP BY lang, slot UNION ALL SELECT '*', '*', slot, max(reg) FROM l GROUP BY slot) SELECT lang, source, {_N} AS n_est FROM g GROUP BY lang, source"""


def sketch_window_tumbling(s, d):
    """Users by event type and day, estimated from registers."""
    regs = window_registers(table(s, d, "events"), P, "ts", "user_id", "event_type")
    return setsketch.cardinality(regs.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")), P, "day", "key").select("day", "key", "n_est")


SQL_WINDOW = f"""SELECT day, key, {_N} AS n_est FROM {_sql_regs("(SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, event_type AS key, user_id AS item FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)", "day, key")} GROUP BY day, key"""


# --- sequences ---------------------------------------------------------------------------------------------------------


def _turns(s, d):
    """Words of each conversation in the order of its turns."""
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("set_id"), "turn", F.posexplode(sets.tokens(F.col("text"))).alias("k", "item"))
    return rows.select("set_id", (F.col("turn").cast("bigint") * 1_000_000 + F.col("k")).alias("pos"), "item")


def ordminhash_sig(s, d):
    return ordered.ordered_signature(_turns(s, d), ORD_M, ORD_L)


def ordminhash_sim(s, d):
    return similarity.neighbour_jaccard(ordminhash_sig(s, d), ORD_M)


SQL_ORD = rf"""(WITH w AS (SELECT conv_id AS set_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS ws FROM conversations),
  s AS (SELECT set_id, turn * 1000000 + unnest(range(len(ws))) AS pos, unnest(ws) AS item FROM w),
  n AS (SELECT *, row_number() OVER (PARTITION BY set_id, item ORDER BY pos) AS nth FROM s),
  x AS (SELECT *, {H.sql_bits52("concat_ws('#', item, nth, slot, '0')")} AS x FROM n, (SELECT unnest(range({ORD_M}))::INT AS slot)),
  r AS (SELECT *, row_number() OVER (PARTITION BY set_id, slot ORDER BY x, pos) AS rank FROM x)
  SELECT set_id, slot, md5(string_agg(item, '#' ORDER BY pos)) AS value FROM r WHERE rank <= {ORD_L} GROUP BY set_id, slot HAVING count(*) = {ORD_L})"""


# --- primitives --------------------------------------------------------------------------------------------------------


def _keyed(name: str, column: str, use) -> Query:
    def run(s, d):
        rows = table(s, d, name).select(F.col(column).cast("bigint").alias("key"))
        return rows.select("key", use("key").alias("x"))

    return run


def exp01_icdf(s, d):
    rows = table(s, d, "orders")
    return rows.select(F.col("o_orderkey").alias("key"), F.round(H.truncated_exponential(H.uniform(H.key_text(F.col("o_orderkey"), "t")), 0.5), 9).alias("x"))


def item_hashes(s, d):
    """The portable hashes of the distinct tokens: 60 bits, 32 bits, 52 bits of md5 and of SHA-256."""
    rows = _tokens(s, d).select("item").distinct()
    return rows.select("item", H.item_hash(F.col("item")).alias("h60"), H.hash32(F.col("item")).alias("h32"), H.bits52(F.col("item")).alias("h52"), H.bits52(F.col("item"), "sha256").alias("s52"))


def distinct_exact(s, d):
    return _tokens(s, d).groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))


def _entries() -> dict[str, tuple[Query, str | None]]:
    terms_pairs, parts_pairs, tokens_pairs = _sql_pairs(TERMS), _sql_pairs(PARTS), _sql_pairs(TOKENS)
    sig = lambda rows, **k: f"SELECT set_id, slot, item FROM {_sql_sample(rows, **k)}"
    smh = lambda body: f"WITH s AS MATERIALIZED {TOKENS} SELECT set_id, slot, value FROM {body}"
    smh_jac = lambda body: f"WITH s AS MATERIALIZED {TOKENS}, " + _sql_jaccard(body, _sql_pairs("s"), M, "value").removeprefix("WITH ")
    dense_jac = lambda scheme: _sql_jaccard(f"({_sql_dense(scheme)})", _sql_pairs("l"), BINS, "value")
    out: dict[str, tuple[Query, str | None]] = {
        "pminhash_sig": (pminhash_sig, sig(TERMS)),
        "pminhash_wide": (pminhash_wide, sig(PARTS)),
        "pminhash_neighbours": (pminhash_neighbours, _sql_jaccard(_sql_sample(TERMS), terms_pairs, M, "item")),
        "pminhash_zero_weight": (pminhash_zero_weight, sig(LARGE)),
        "pminhash_map_input": (pminhash_map_input, sig(PARTS)),
        "pminhash_merge_max": (pminhash_merge_max, sig(MERGED)),
        "pminhash_sha": (pminhash_sha, sig(PARTS, family="sha256")),
        "pmh3_points": (pmh3_points, _sql_points(PARTS)),
        "pmh3_neighbours": (pmh3_neighbours, _sql_jaccard(f"({_sql_points(PARTS)})", parts_pairs, M, "item")),
        "jp_exact": (jp_exact, SQL_JP),
        "jaccard_exact": (jaccard_exact, SQL_JACCARD),
        "distinct_exact": (distinct_exact, f"SELECT set_id, count(*) AS n FROM {TOKENS} GROUP BY set_id"),
        "superminhash_sig": (superminhash_sig, smh(SQL_SMH)),
        "superminhash_f32": (superminhash_f32, f"SELECT set_id, slot, value::FLOAT::DOUBLE AS value FROM ({smh(SQL_SMH)})"),
        "superminhash_jaccard": (superminhash_jaccard, smh_jac(SQL_SMH)),
        "superminhash2_sig": (superminhash2_sig, smh(SQL_SMH2)),
        "superminhash2_jaccard": (superminhash2_jaccard, smh_jac(SQL_SMH2)),
        "slot_permutation": (slot_permutation, f"WITH s AS (SELECT p_partkey AS item FROM part) {_PERM}"),
        "oph_bins": (oph_bins, f"SELECT * FROM {SQL_BINS}"),
        "oph_optdens": (oph_optdens, _sql_dense("optimal")),
        "oph_revoptdens": (oph_revoptdens, _sql_dense("reverse")),
        "oph_empty": (oph_empty, f"SELECT set_id, ({BINS} - count(*))::INT AS n_empty FROM {SQL_BINS} GROUP BY set_id"),
        "oph_jaccard": (oph_jaccard, dense_jac("optimal")),
        "oph_revjaccard": (oph_revjaccard, dense_jac("reverse")),
        "setsketch_regs": (setsketch_regs, f"SELECT * FROM {_sql_regs(TOKENS)}"),
        "setsketch_card": (setsketch_card, f"SELECT set_id, {_N} AS n_est, {setsketch.relative_std(P)!r}::DOUBLE AS rel_std FROM {_sql_regs(TOKENS)} GROUP BY set_id"),
        "setsketch_merge": (setsketch_merge, f"SELECT lang, slot, max(reg) AS reg FROM {_LANG} GROUP BY lang, slot"),
        "setsketch_bounds": (setsketch_bounds, SQL_BOUNDS),
        "setsketch_mle_b1": (setsketch_mle_b1, SQL_MLE),
        "setsketch_mle": (setsketch_mle, None),
        "setsketch_diag": (setsketch_diag, f"SELECT set_id, (CASE WHEN count(*) = {P.m} THEN min(reg) ELSE 0 END)::INT AS low, sum(CASE WHEN reg > {P.q} THEN 1 ELSE 0 END)::BIGINT AS n_capped FROM {_sql_regs(TOKENS)} GROUP BY set_id"),
        "sketch_rollup": (sketch_rollup, SQL_ROLLUP),
        "sketch_window_tumbling": (sketch_window_tumbling, SQL_WINDOW),
        "ordminhash_sig": (ordminhash_sig, f"SELECT * FROM {SQL_ORD}"),
        "ordminhash_sim": (ordminhash_sim, _sql_jaccard(f"(SELECT * FROM {SQL_ORD})", _sql_pairs("l"), ORD_M, "value")),
        "wang32": (_keyed("orders", "o_orderkey", H.wang32), H.sql_wang32("orders", "o_orderkey")),
        "wang32_inv": (_keyed("orders", "o_orderkey", H.wang32_inverse), H.sql_wang32_inverse("orders", "o_orderkey")),
        "wang64": (_keyed("orders", "o_orderkey", H.wang64), H.sql_wang64("orders", "o_orderkey")),
        "wang64_inv": (_keyed("orders", "o_orderkey", H.wang64_inverse), H.sql_wang64("orders", "o_orderkey", inverse=True)),
        "exp01_icdf": (exp01_icdf, f"SELECT o_orderkey AS key, round(-ln(1.0 - (1.0 - {H.sql_uniform("concat_ws('#', o_orderkey, 't')")}) * {1.0 - math.exp(-0.5)!r}::DOUBLE) / 0.5, 9) AS x FROM orders"),
        "item_hashes": (item_hashes, f"SELECT item, {H.sql_item_hash('item')} AS h60, {H.sql_hash32('item')} AS h32, {H.sql_bits52('item')} AS h52, {H.sql_bits52('item', 'sha256')} AS s52 FROM (SELECT DISTINCT item FROM {TOKENS})"),
    }
    for scheme, short in (("optimal", "oph"), ("reverse", "oph_rev")):
        for bits in (32, 16, 8):
            out[f"{short}_u{bits}"] = (_compacted(scheme, bits), _sql_compacted(scheme, bits))
    return out


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated similarity of the term weights of neighbouring documents."""
    return pminhash_neighbours(spark, sf_dir)
