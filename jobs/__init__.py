"""Runnable jobs over tables: ``python -m jobs.cohort_curves`` and ``python -m jobs.marker_words``."""
