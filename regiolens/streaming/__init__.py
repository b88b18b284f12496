from regiolens.streaming.ingest import csv_stream, daily_totals_stream, ingest  # noqa: F401
