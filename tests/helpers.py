"""A valid record, and files made of records."""

from __future__ import annotations

import csv
from pathlib import Path

from evalboard.contract import COLUMNS

VALID = {
    "type": "model", "model": "M1", "organization": "Org", "model_url": "", "access": "open", "domain": "general", "params_b": "7", "method": "zero-shot",
    "melody": "60.0", "rhythm": "55.2", "timbre": "66.8", "harmony": "52.0", "overall": "58.5", "acc_fs": "57.6", "miss_rate": "40.1", "false_flip_rate": "44.7", "a_rate": "52.0",
    "readout": "logprob", "verified": "yes", "submitted_by": "me", "date": "2026-10-01", "source_url": "", "benchmark_version": "1.0", "notes": "",
}


def record(**changes: str) -> dict[str, str]:
    return VALID | changes


def write_csv(path: Path, records: list[dict[str, str]], header: tuple[str, ...] = COLUMNS) -> str:
    with path.open("w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(header)
        for r in records:
            w.writerow([r[c] for c in COLUMNS])
    return str(path)
