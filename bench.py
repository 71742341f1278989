"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores (default all).
Arguments pick queries by name. Every query runs once unmeasured, then once measured, its whole
result written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusmill.catalog import all_queries  # noqa: E402
from corpusmill.session import build_session, drop_kept  # noqa: E402

HEADLINE = [
    "document_quality",
    "quality_tiers",
    "score_summary",
    "component_correlation",
    "output_metrics",
    "corpus_quality_proxies",
    "distinct_ngrams",
    "vocabulary_entropy",
    "rouge_n",
    "corpus_bleu",
    "self_bleu",
    "mixed_strategies",
    "exact_split",
    "score_ranks",
    "price_bins",
    "lineitem_summary",
    "price_rank_correlation",
    "task_accuracy",
    "score_store_size",
    "stream_scores",
]


def run(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = all_queries()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, catalogue[name], sf_dir)
        times[name] = round(run(spark, catalogue[name], sf_dir), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    drop_kept(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "scored_rows_per_sec": round(rows / times["document_quality"]) if "document_quality" in times else None,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
