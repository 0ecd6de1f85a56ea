"""Fixed schemas of the data model."""

from __future__ import annotations

#: One line of a transcript; all five fields are required.
TRANSCRIPT = "seg_id string, source_id smallint, text string, duration_sec double, timestamp string"
#: A piece of a source's signal; chunk_seq gives the order that a stream has by itself.
CHUNKS = "source_id smallint, chunk_seq bigint, samples array<smallint>"
#: Control rows travel in the same stream: kind is data, pause, resume or eof.
UNITS = "source_id smallint, chunk_seq bigint, n_samples int, verdicts array<boolean>, kind string"
SEGMENTS = "source_id smallint, seq bigint, seg_id string, n_chunks bigint, duration_sec double, reason string"
LOGS = "stage string, source_id smallint, chunk_sec double, proc_sec double, detail string, verbose_only boolean"
DEVICE_CONFIG = "mic string, loopback boolean, loopback_device string"
