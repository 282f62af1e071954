"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Each query runs once after a small
warm-up query that starts the JVM and the Python workers; results go to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from corpusmill.plans.catalogue import QUERIES
from corpusmill.session import build_session

HEADLINE = [
    "content_identity",
    "frontmatter_split",
    "field_defaults",
    "dedup_winner",
    "merge_store",
    "import_job",
    "category_counts",
    "doc_tokens",
    "term_stats",
    "kw_any",
    "kw_batch",
    "kw_all",
    "kw_prefix",
    "kw_phrase",
    "vector_topk_batch",
    "retrieve_live",
    "search_summaries",
    "index_status",
    "hash_encode",
    "build_or_update",
    "ingest_files",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    spark = build_session(f"local[{cpus}]", "bench", **conf)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    run("hash_encode")
    seconds = {name: run(name) for name in names}
    n_vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    n_records = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rates = {}
    if "vector_topk_batch" in seconds:
        rates["vector_pairs_per_sec"] = round(n_vectors * n_vectors / seconds["vector_topk_batch"])
    for name in ("doc_tokens", "kw_batch", "merge_store", "ingest_files"):
        if name in seconds:
            rates[f"{name}_records_per_sec"] = round(n_records / seconds[name])
    line = {
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rates": rates,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
