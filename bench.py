"""Time the headline queries on one machine and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores. Every kind of work is run once before it is
timed, so that neither the JVM nor the Python workers start inside a figure. ``rates`` puts fingerprints in tokens and texts per
second, and models apart into fitting and predicting, over copies of the pool that fill the cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from check import session
from poolscout.catalog import REGISTRY
from poolscout.catalog.models import vector_labels, vector_pool
from poolscout.catalog.registry import Tables
from poolscout.functions.fingerprint import TOKEN
from poolscout.surrogate.factory import make_surrogate

HEADLINE = (
    "fingerprint_pair",
    "fingerprint_morgan",
    "fingerprint_path",
    "process_predictions",
    "regressor_predictions",
    "forest_predictions",
    "utility_upper_bound",
    "utility_expected_improvement",
    "hit_probability",
    "initial_batch",
    "initial_batch_by_cluster",
    "acquire_batch",
    "acquire_large_batch",
    "acquire_batch_by_cluster",
    "prune_pool",
    "lookup_scores",
    "recall_curve_by_score",
    "running_top_k_average",
    "run_rewards",
    "cost_curves",
    "error_quantiles",
    "leader_assignment",
    "graph_edge_messages",
    "random_exploration",
)
MODELS = {"process": ("gp", None), "forest": ("rf", None), "regressor": ("nn", None), "ensemble": ("nn", "ensemble")}
#: Copies of every vector in the pool that is predicted.
COPIES = 50


def timed(work) -> float:
    start = time.time()
    work()
    return round(time.time() - start, 3)


def written(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def rates(spark, folder: str, times: dict[str, float]) -> dict[str, float]:
    tables = Tables(spark, folder)
    text = tables.documents.agg(F.count("text").alias("n"), F.sum(F.regexp_count("text", F.lit(TOKEN))).alias("tokens")).first()
    out = {}
    for kind in ("pair", "morgan", "path"):
        took = times[f"fingerprint_{kind}"]
        out[f"fingerprint_{kind}_tokens_per_sec"] = round(text["tokens"] / took)
        out[f"fingerprint_{kind}_texts_per_sec"] = round(text["n"] / took)
    pool = vector_pool(tables).cache()
    known = pool.join(vector_labels(tables), "id").cache()
    n = known.count()
    cores = spark.sparkContext.defaultParallelism
    first = F.col("id") * COPIES
    large = pool.repartition(cores).select(F.explode(F.sequence(first, first + (COPIES - 1))).alias("id"), "features")
    for name, (kind, how) in MODELS.items():
        model = make_surrogate(kind, how)
        out[f"{name}_fit_rows_per_sec"] = round(n / timed(lambda: model.fit(known)))
        mean_only = "vars" not in model.provides
        written(model.predict(pool, mean_only))
        out[f"{name}_predict_rows_per_sec"] = round(n * COPIES / timed(lambda: written(model.predict(large, mean_only))))
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    for name in ("fingerprint_pair", "process_predictions", "acquire_batch", "leader_assignment"):
        written(REGISTRY[name](spark, folder))
    times = {name: timed(lambda: written(REGISTRY[name](spark, folder))) for name in HEADLINE}
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale,
                "rates": rates(spark, folder, times),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
