"""The data contract of a result table. Names, order, allowed values, tolerance, titles."""

from __future__ import annotations

from pyspark.sql import types as T

COLUMNS = (
    "type", "model", "organization", "model_url", "access", "domain", "params_b", "method",
    "melody", "rhythm", "timbre", "harmony", "overall", "acc_fs", "miss_rate", "false_flip_rate", "a_rate",
    "readout", "verified", "submitted_by", "date", "source_url", "benchmark_version", "notes",
)
TASKS = ("melody", "rhythm", "timbre", "harmony")
REQUIRED_PERCENT = (*TASKS, "overall", "acc_fs", "miss_rate", "false_flip_rate")
PERCENT = (*REQUIRED_PERCENT, "a_rate")
LOWER_IS_BETTER = ("miss_rate", "false_flip_rate")
TYPES, VERIFIED = ("baseline", "model"), ("no", "yes")
ACCESS, DOMAIN, READOUT, VERSIONS = ("open", "closed"), ("general", "music"), ("logprob", "generated"), ("1.0",)
TOLERANCE = 0.1
DEFAULT_CHANCE = 50.0
GROUPS = (
    "Zero-shot models",
    "Models trained on the released training split",
    "Music-specific models: zero-shot",
    "Music-specific models: trained on the released training split",
    "References",
)
SORT_KEYS = ("model", "method", *TASKS, "overall", "acc_fs", "miss_rate", "false_flip_rate", "a_rate")

RAW = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
