"""Times the headline work on one data folder and prints one JSON line.

Extraction and merge run from the source tables; the dashboard reads the report table
that the extraction wrote, as its users do.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import date
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from checks.standins import Data  # noqa: E402
from checks.texts import as_reports  # noqa: E402
from reportlake.functions.text import preprocess_report  # noqa: E402
from reportlake.operators.csv_import import import_catalogue  # noqa: E402
from reportlake.operators.extract import active_codes, one_per_accession, stamp  # noqa: E402
from reportlake.operators.filters import Catalogue, Filters  # noqa: E402
from reportlake.operators.upsert import merge_all, merge_daily  # noqa: E402
from reportlake.plans import dashboard, monitoring  # noqa: E402
from reportlake.plans.backfill import run_backfill  # noqa: E402
from reportlake.plans.daily import run_daily, window_batch  # noqa: E402
from reportlake.plans.structuring import structure_texts  # noqa: E402
from reportlake.schemas import REPORTS, RUN_DAILY, RUN_MODES, RUN_REPROCESS  # noqa: E402
from reportlake.session import local_session, staging  # noqa: E402
from reportlake.sources.sinks import apply_staged, create_reports, drop_reports  # noqa: E402
from reportlake.sources.systems import SourceTables  # noqa: E402


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(
        cpus,
        "reportlake-bench",
        **{
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.sql.files.maxPartitionBytes": "32m",
        },
    )
    data = Data(spark, folder)
    seconds: dict[str, float] = {}

    def timed(name, action):
        began = time.perf_counter()
        result = action()
        seconds[name] = round(time.perf_counter() - began, 3)
        return result

    with staging(spark) as area:
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()

        # The source tables as a hospital would hold them; building them is not timed.
        for name in ("performed", "encounter", "report", "modality", "description", "procedure_cat"):
            area.write(data.table(name), name)
        source = {n: spark.read.parquet(f"{area.root}/{n}") for n in
                  ("performed", "encounter", "report", "modality", "description", "procedure_cat")}
        data.table = lambda name, _base=Data.table: (
            source[name] if name in source else _base(data, name)
        )
        catalogue = Catalogue(source["modality"], source["description"], source["procedure_cat"])

        loaded = F.lit("2001-01-01 00:00:00").cast("timestamp")
        rows = stamp(one_per_accession(data.joined()), RUN_DAILY, loaded)
        path = f"{area.root}/reports"
        timed(
            "extract_and_write",
            lambda: rows.hint("rebalance", "year_month")
            .write.partitionBy("year_month")
            .parquet(path),
        )
        reports = spark.read.schema(REPORTS).parquet(path)

        # A window goes the way of the jobs: its narrow rows are staged before the texts.
        tables = SourceTables(source["performed"], source["encounter"], source["report"])
        codes = active_codes(catalogue.procedures)

        def extract_window(name, start, end, mode):
            with staging(spark) as own:
                _, found = window_batch(own, tables, codes, (start, end))
                area.write(stamp(found, mode, loaded), name)

        timed(
            "extract_one_week",
            lambda: extract_window("week", date(1998, 3, 2), date(1998, 3, 9), RUN_DAILY),
        )
        timed(
            "extract_since_1998",
            lambda: extract_window("year", date(1998, 1, 1), date(2010, 1, 1), RUN_REPROCESS),
        )
        batch, big = area.read("week", REPORTS), area.read("year", REPORTS)
        month = reports.filter("year_month between '1998-02' and '1998-04'")
        timed("upsert_daily", lambda: noop(merge_daily(month, batch, small_source=True)))
        timed("upsert_reprocess", lambda: noop(merge_all(reports, big)))

        # The jobs as they run: from the sources into a table.
        spark.sql("CREATE DATABASE IF NOT EXISTS bench")
        modes = spark.createDataFrame([(RUN_DAILY, True), (RUN_REPROCESS, True)], RUN_MODES)
        table = "bench.reports"
        drop_reports(spark, table)
        create_reports(reports, table)
        timed("apply_staged", lambda: apply_staged(spark, area, "week", table, RUN_DAILY))
        timed(
            "run_daily",
            lambda: run_daily(spark, tables, catalogue.procedures, modes, table, day_to_process="1998-03-02"),
        )
        for name, dry in (("backfill_dry_run", True), ("run_backfill_four_weeks", False)):
            timed(
                name,
                lambda d=dry: run_backfill(
                    spark, tables, catalogue.procedures, modes, table, "1998-03-02", "1998-03-30", 7, d
                ).collect(),
            )
        named = {"modalities": source["modality"], "descriptions": source["description"], "procedures": source["procedure_cat"]}
        grown = lambda: import_catalogue(named, data.table("csv_lines"))
        timed("run_import", lambda: [noop(df) for df in grown().values()])
        drop_reports(spark, table)

        recent = Filters(last_days=365, as_of="2001-01-01", sources=["HSP", "PSC"])
        picked = Filters(descriptions=["red", "ECONOMY"], modalities=["Brand#2", "Brand#5"])
        for name, build in {
            "kpi_row": dashboard.kpi_row,
            "daily_volume": dashboard.daily_volume,
            "by_source": dashboard.by_source,
            "top_modalities": dashboard.top_modalities,
            "top_procedures": dashboard.top_procedures,
            "by_weekday": dashboard.by_weekday,
            "by_hour": dashboard.by_hour,
            "top_descriptions": dashboard.top_descriptions,
            "modality_detail": dashboard.modality_detail,
        }.items():
            timed(name, lambda b=build: b(reports, catalogue).collect())
        timed("kpi_row_last_year", lambda: dashboard.kpi_row(reports, catalogue, recent).collect())
        timed("kpi_row_picked", lambda: dashboard.kpi_row(reports, catalogue, picked).collect())
        metrics = data.table("job_metrics")
        timed("last_runs", lambda: dashboard.last_runs(metrics).collect())
        timed("load_statistics", lambda: dashboard.load_statistics(metrics).collect())
        timed("duplicate_keys", lambda: monitoring.duplicate_keys(reports).collect())

        texts = spark.read.parquet(f"{folder}/documents.parquet").repartition(int(cpus))
        texts = area.write(texts, "documents")
        timed("sanitize", lambda: noop(texts.select(preprocess_report("text", repair=False))))
        timed("sanitize_and_repair", lambda: noop(texts.select(preprocess_report("text"))))
        data.base = lambda name, _base=Data.base: texts if name == "documents" else _base(data, name)
        timed("structure", lambda: noop(structure_texts(as_reports(data))))

    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
