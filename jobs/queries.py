"""The jobs as queries: each runs twice into a new folder, and what it has written is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cytoplan.plans import oracles
from cytoplan.sources.stage import folder

from . import cohort_curves, marker_words


def job1_cohort_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings, out = cohort_curves.settings_of(), folder(spark, "job1-cohort-curves")
    for _ in range(2):
        cohort_curves.run(spark, sf_dir, out, settings)
    return cohort_curves.output(spark, out, settings)


def job2_marker_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings, out = marker_words.settings_of(), folder(spark, "job2-marker-words")
    for _ in range(2):
        marker_words.run(spark, sf_dir, out, settings)
    return marker_words.output(spark, out, settings)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_cohort_curves, job2_marker_words)}


_MARKER_WORDS_SQL = """
WITH words AS (SELECT lang, source, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS word FROM documents),
sums AS (SELECT lang, source, word, count(*) AS s FROM words GROUP BY ALL),
members AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL),
overall AS (SELECT word, sum(s) AS "all" FROM sums GROUP BY ALL),
scored AS (SELECT x.*, n, s / n AS mean, log2((s / n + 1e-6) / ("all" / (SELECT count(*) FROM documents) + 1e-6)) AS e
  FROM sums x JOIN members y ON x.lang IS NOT DISTINCT FROM y.lang AND x.source IS NOT DISTINCT FROM y.source JOIN overall USING (word)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY round(e, 9) DESC, s DESC, word) AS r FROM scored WHERE s >= {least})
SELECT lang, source, CAST(r AS INT) AS rank, word, n AS n_documents, s AS n_words, round(mean, 6) AS mean_count, round(e, 6) AS log2_enrichment FROM ranked WHERE r <= {top}
"""


def oracle_sql() -> dict[str, str]:
    return {"job1_cohort_curves": oracles.oracle_sql()["gapfill_summary"], "job2_marker_words": _MARKER_WORDS_SQL.format(**marker_words.settings_of())}
