"""Accuracy of reading levels on grades held out, over several weights: python -m lodestack.llm.heldout FOLDER."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import reading_level
from lodestack.sources.tables import table


def held_out(spark: SparkSession, folder: str, share: float = 0.3, **options) -> dict[str, float]:
    """Mean absolute error and correlation for the graded documents hidden, by a hash of their id, with those of the
    mean grade and of the documents' words and sentences (a line through those shown) to compare with."""
    docs, grades = table(spark, folder, "documents"), table(spark, folder, "doc_grades")
    hidden = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1000)) < F.lit(int(1000 * share))
    levels = reading_level.reading_levels(docs, "doc_id", "text", grades.where(~hidden), "rater", "grade", **options)
    truth: DataFrame = reading_level.mean_grades(grades, "doc_id", "rater", "grade")
    both = levels.join(truth, "doc_id").where("level IS NOT NULL AND lix IS NOT NULL").select(hidden.alias("hidden"), "level", "grade", "lix").toPandas()
    test, shown = both[both["hidden"]], both[~both["hidden"]]
    slope, start = np.polyfit(shown["lix"], shown["grade"], 1)
    error = lambda guess: float(np.abs(guess - test["grade"]).mean())
    found = {"documents": len(test), "error": error(test["level"]), "correlation": float(np.corrcoef(test["level"], test["grade"])[0, 1])}
    line = {"line_error": error(start + slope * test["lix"]), "line_correlation": float(np.corrcoef(test["lix"], test["grade"])[0, 1])}
    return found | {"mean_error": error(shown["grade"].mean())} | line


def main(folder: str) -> None:
    from lodestack.session import local_session

    spark = local_session(8, 8, spark__ui__showConsoleProgress="false")
    for options in [{}, {"shape": 1.0}, {"shape": 10.0}, {"shape": 1000.0}, {"times": 1.0}, {"times": 10.0}, {"times": 1000.0}, {"prior": 0.01}, {"prior": 0.2}]:
        print(options, {k: round(v, 3) for k, v in held_out(spark, folder, **options).items()}, flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
