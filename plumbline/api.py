"""One object to score outputs with, and a command for boards.

``python -m plumbline.api board --records FOLDER --tasks FILE --config FILE --out FOLDER`` reads a tree of records and writes
the board; it runs under ``spark-submit`` as well.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import curation, metrics, records
from plumbline.plans import leaderboard
from plumbline.session import session
from plumbline.sources import files
from plumbline.sources.config import DatasetConfig


@dataclass(frozen=True)
class Evaluation:
    """A dataset with its metrics.  ``preprocess`` takes the example table and gives another; it must keep the standard columns."""

    config: DatasetConfig
    metrics: list[str]
    preprocess: Callable[[DataFrame], DataFrame] | None = None
    extra: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def examples(self, df: DataFrame, key: str = "index") -> DataFrame:
        """Standard columns, the user's own preprocessing, no empty inputs."""
        rows = curation.standardised(df, self.config.columns)
        rows = rows.transform(self.preprocess) if self.preprocess else rows
        column = "tokens" if self.config.task == "token-classification" else "context" if self.config.task == "question-answering" else "text"
        return curation.non_empty(curation.require_columns(rows, [key, column]), column)

    def scores(self, examples: DataFrame, outputs: DataFrame, by: list[str], key: str = "index") -> DataFrame:
        """A row for each group of ``by`` with every metric, over outputs (``prediction``) beside their examples."""
        target = curation.target_column(self.config.task)
        rows = metrics.paired(outputs, examples.withColumnRenamed(target, "reference"), [key])
        known = metrics.REGISTRY | self.extra
        if missing := [m for m in self.metrics if m not in known]:
            raise ValueError(f"unknown metrics: {', '.join(missing)}")
        out = None
        for name in self.metrics:
            one = known[name](rows, by)
            out = one if out is None else out.join(one, by)
        return out

    def results(self, scores: DataFrame, model: str, version: str) -> DataFrame:
        """Records of the scores' groups (``iteration`` among them), as they are stored."""
        rows = scores.groupBy(F.col(model).alias("model")).agg(F.array_sort(F.collect_list(F.struct("iteration", *self.metrics))).alias("r"))
        raw = F.transform("r", lambda r: F.create_map(*[x for m in self.metrics for x in (F.lit(f"test_{m}"), r[m].cast("double"))]))
        mean = lambda m: 100 * F.aggregate("r", F.lit(0.0), lambda a, r: a + r[m]) / F.size("r")
        total = F.create_map(*[x for m in self.metrics for x in (F.lit(f"test_{m}"), mean(m))])
        flat = rows.select("model", F.lit(self.config.name).alias("dataset"), F.lit(self.config.task).alias("task"), F.lit(True).alias("few_shot"), F.lit(False).alias("validation_split"), F.lit(version).alias("version"), raw.alias("raw"), total.alias("total"))
        return records.flat_to_envelope(flat)


def board(spark: SparkSession, folder: str, tasks: str, config: str, out: str) -> None:
    stored = records.numbered(files.record_tree(spark, folder), "path")
    scores = leaderboard.score_table(stored, spark.read.json(tasks), spark.read.json(config))
    files.write_board(leaderboard.board(scores, spark.read.json(config)), out)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    command = parser.add_subparsers(required=True).add_parser("board", help="rank the models of a tree of records")
    for name in ("records", "tasks", "config", "out"):
        command.add_argument(f"--{name}", required=True)
    given = parser.parse_args(arguments)
    board(session("board"), given.records, given.tasks, given.config, given.out)


if __name__ == "__main__":
    main()
