"""Times the headline operators on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line.

They run with the hash family for large data (xxhash64, in generated code); the md5 family, which other SQL engines can
follow, is for verification. Every whole result goes to a no-op sink; one query warms the session up, untimed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from setforge.functions import hashing
from setforge.operators import minwise, oneperm, ordered, setsketch, similarity, weighted
from setforge.plans.registry import BINS, M, ORD_L, ORD_M, POINTS, P, queries
from setforge.plans.tables import table
from setforge.session import local_session
from setforge.sources import sets
from setforge.streaming.windows import window_registers

FAST = "xxhash64"


def headline(spark, sf_dir: str) -> dict:
    docs, line = table(spark, sf_dir, "documents"), table(spark, sf_dir, "lineitem")
    tokens, terms, parts = sets.token_sets(docs), sets.token_weights(docs), sets.supplier_parts(line)
    regs = setsketch.registers(tokens, P, family=FAST)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("set_id"), "turn", F.posexplode(sets.tokens(F.col("text"))).alias("k", "item"))
    turns = turns.select("set_id", (F.col("turn").cast("bigint") * 1_000_000 + F.col("k")).alias("pos"), "item")
    named = queries()
    return {
        "pminhash_sig": lambda: weighted.sample(terms, M, FAST),
        "pminhash_neighbours": lambda: similarity.signature_jaccard(weighted.sample(terms, M, FAST), similarity.neighbours(terms), M, "item"),
        "pmh3_points": lambda: weighted.sample_points(parts, M, POINTS, FAST),
        "jp_exact": lambda: named["jp_exact"](spark, sf_dir),
        "jaccard_exact": lambda: named["jaccard_exact"](spark, sf_dir),
        "superminhash": lambda: minwise.superminhash(tokens, M, FAST),
        "superminhash2": lambda: minwise.superminhash2(tokens, M, FAST),
        "oph_optdens": lambda: oneperm.densify(oneperm.bins(tokens, BINS, FAST), BINS, "optimal"),
        "oph_revoptdens": lambda: oneperm.densify(oneperm.bins(tokens, BINS, FAST), BINS, "reverse"),
        "setsketch_regs": lambda: regs,
        "setsketch_card": lambda: setsketch.cardinality(regs, P, "set_id"),
        "setsketch_mle": lambda: setsketch.likelihood(setsketch.compare(regs, similarity.neighbours(regs), P), P),
        "ordminhash": lambda: ordered.ordered_signature(turns, ORD_M, ORD_L, family=FAST),
        "sketch_window_tumbling": lambda: setsketch.cardinality(window_registers(table(spark, sf_dir, "events"), P, "ts", "user_id", "event_type", family=FAST), P, "window_start", "key"),
        "wang64": lambda: table(spark, sf_dir, "orders").select(hashing.wang64("o_orderkey").alias("x")),
        "pminhash_sig_md5": lambda: named["pminhash_sig"](spark, sf_dir),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries()["slot_permutation"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name, query in headline(spark, sf_dir).items():
        began = time.perf_counter()
        query().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
