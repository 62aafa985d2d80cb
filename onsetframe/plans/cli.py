"""``spark-submit`` entry: one stage per call.

    spark-submit -m onsetframe.plans.cli labelled --dataset dataset.json --configs <folder>
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from onsetframe.operators.records import clean_events, long_records
from onsetframe.plans.codelists import ANALYSIS_CATEGORIES, LABEL_CATEGORY
from onsetframe.plans.config import WINDOW_SETTINGS, CohortConfig, StagePaths, config_grid, find_configs
from onsetframe.plans.extraction import (
    LABEL_SETTINGS,
    ONSET_SETTINGS,
    demographics_for_labels,
    digest,
    ecg_for_labels,
    extract,
    extract_grid,
)
from onsetframe.plans.learning import Source, learn_job
from onsetframe.session import join_path, tune
from onsetframe.sources.stages import StageStore, is_complete, write_output, write_records
from onsetframe.sources.tables import ClinicalTables, read_sample

STAGES = ("labelled", "ecg", "demographics", "records", "sample-records", "grid", "learn")


def _configs(args: argparse.Namespace) -> list[tuple[CohortConfig, StagePaths]]:
    return [
        (CohortConfig.from_json(c), StagePaths.from_json(p)) for c, p in find_configs(args.configs, args.first)
    ]


def _dated(args: argparse.Namespace, config: CohortConfig) -> CohortConfig:
    """The settings whose dates are labelled: of the ``--first`` category, with the same onset settings."""
    alike = [c for c, _ in _configs(args) if c.key(*ONSET_SETTINGS) == config.key(*ONSET_SETTINGS)]
    return alike[0]


def _learn(tables: ClinicalTables, args: argparse.Namespace) -> None:
    """Model and metrics from the written windows and labels of each settings file."""
    for config, paths in _configs(args):
        windows = join_path(paths.rolling_lab_records, config.key(*WINDOW_SETTINGS))
        labels = join_path(paths.labeled_lab_records, _dated(args, config).key(*LABEL_SETTINGS))
        name = digest(config=config.key(), windows=windows, labels=labels)
        source = Source("lab", tables.spark.read.parquet(windows), len(config.selected_analyses_ids))
        learn_job(
            StageStore(tables.spark, join_path(args.output, "stages")), name, tables.spark.read.parquet(labels), [source],
            config.backward_window_value, output=join_path(args.output, name), trees=args.trees, max_depth=args.max_depth,
            inputs=[windows, labels],
        )


def _secondary(tables: ClinicalTables, args: argparse.Namespace) -> None:
    for config, paths in _configs(args):
        target = paths.rolling_ecg_records if args.stage == "ecg" else paths.demographics_records
        if target is None or paths.labeled_lab_records is None:
            continue
        if is_complete(tables.spark, target) and not args.overwrite:
            print(f"kept {target}")
            continue
        labels = tables.spark.read.parquet(join_path(paths.labeled_lab_records, _dated(args, config).key(*LABEL_SETTINGS)))
        if args.stage == "ecg":
            result = ecg_for_labels(tables.ecg_machine_measurements(), labels, config)
        else:
            result = demographics_for_labels(tables.patients(), labels)
        write_output(result, target, args.overwrite)


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    tables = ClinicalTables.from_config(spark, args.dataset)
    if args.analyses_parquet:
        tables.replace("analyses", read_sample(spark, args.analyses_parquet))
    if args.stage == "labelled":
        for config, paths in _configs(args):
            extract(tables, config, paths, overwrite=args.overwrite, label_config=_dated(args, config))
    elif args.stage == "learn":
        _learn(tables, args)
    elif args.stage == "grid":
        extract_grid(tables, config_grid(ANALYSIS_CATEGORIES), args.output, args.first, args.overwrite)
    elif args.stage in ("ecg", "demographics"):
        _secondary(tables, args)
    else:
        events = read_sample(spark, args.sample) if args.stage == "sample-records" else tables.analyses()
        # the sparse form: one row per patient, hour and analysis, whatever analyses there are
        write_records(long_records(clean_events(events)), args.output, overwrite=args.overwrite)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("stage", choices=STAGES)
    parser.add_argument("--dataset", required=True, help="JSON file with database_root")
    parser.add_argument("--configs", help="folder with settings and paths files")
    parser.add_argument("--first", default=LABEL_CATEGORY, help="category whose dates become the label dates")
    parser.add_argument("--analyses-parquet", help="converted analyses table")
    parser.add_argument("--sample", help="Parquet sample of the analyses")
    parser.add_argument("--output", help="record set, or folder of the grid or the models, to write")
    parser.add_argument("--trees", type=int, default=100)
    parser.add_argument("--max-depth", type=int, default=10)
    parser.add_argument("--overwrite", action="store_true")
    args = parser.parse_args(argv)
    run(args, tune(SparkSession.builder.appName("onsetframe").getOrCreate()))


if __name__ == "__main__":
    main()
