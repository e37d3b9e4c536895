"""Explicit schemas and the fixed lists that operators share."""

from __future__ import annotations

RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]
UNKNOWN = "Unknown"
#: Column order of prediction files (a fixed format).
PREDICTION_COLUMNS = ["sequence_id", *RANKS, "confidence", "method", "predicted_label"]

SEQUENCE = "file string, at long, sequence_id string, description string, sequence string"
READ = "file string, at long, read_id string, sequence string, quality string"
MANIFEST = "single array<struct<sample_id:string,file:string>>, paired array<struct<sample_id:string,forward:string,reverse:string>>"
RUN = (
    "sample_id string, input_type string, input_files array<string>, output_dir string, start_time timestamp, end_time timestamp, "
    "processing_time double, success boolean, error string, status string, "
    "pipeline_steps array<struct<step:string,status:string>>, current_step string, current_message string, progress int"
)
