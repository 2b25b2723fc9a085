"""runlens: Spark-native analytics for model evaluation runs.

Runs tables (one row per model answer) are standardized, scored, featurized
and analysed as DataFrame jobs grouped by experiment, so one job covers any
number of experiments.
"""

__version__ = "0.1.0"
