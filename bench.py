"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every query starts at the
source tables and is evaluated completely (``noop`` sink). ``report_from_cache`` is the whole
analysis with stored model results: tables to gold to features, then every report table.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from punctual.catalogue import queries as catalogue  # noqa: E402
from punctual.catalogue import stand_ins  # noqa: E402
from punctual.operators.labelling import build_themes  # noqa: E402
from punctual.operators.sentiment import build_sentiment  # noqa: E402
from punctual.plans import medallion  # noqa: E402
from punctual.plans.report import analyse, report, store  # noqa: E402
from punctual.session import tune  # noqa: E402
from punctual.sources.cache import ResultCache  # noqa: E402
from punctual.sources.star_schema import star_schema_bronze  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "gold_reviews",
    "gold_single_statement",
    "review_features",
    "score_by_outcome",
    "score_share_by_outcome",
    "gap_histogram_daily",
    "gap_histogram_equal_width",
    "one_time_buyers",
    "sentiment_labels",
    "sentiment_summary",
    "negative_sample",
    "theme_batches_whole_text",
    "themes",
    "theme_frequency",
    "theme_outcome_pivot",
    "city_lateness",
)


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    queries = catalogue.queries()
    timings: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - start, 3)

    # Start the JVM's and the Python workers' code paths outside the timings.
    run(queries["score_by_outcome"](spark, FOLDER))
    run(queries["model_sentiment"](spark, FOLDER))

    bronze = star_schema_bronze(spark, FOLDER)
    cache = ResultCache(spark, f"{folder}/cache")
    features = medallion.build_features(bronze)
    cache.save("sentiment", build_sentiment(features, stand_ins.star_model(), stand_ins.lexicon(spark)))
    themes = cache.save("themes_table", build_themes(features, stand_ins.id_labeler(), cache))

    for name in HEADLINE:
        timed(name, lambda: run(queries[name](spark, FOLDER)))

    def whole_report() -> None:
        source = star_schema_bronze(spark, FOLDER)
        stored = cache.save("features", medallion.build_features(source))
        store(report(stored, cache.load("sentiment"), themes), cache)

    def whole_analysis() -> None:
        tables = analyse(
            star_schema_bronze(spark, FOLDER), cache, stand_ins.star_model(), stand_ins.lexicon(spark), stand_ins.id_labeler()
        )
        store(tables, cache)

    timed("report_from_cache", whole_report)
    timed("analyse", whole_analysis)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
