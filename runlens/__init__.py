"""Job-run analytics on Spark: history, telemetry, queue and inventory reports as DataFrame jobs."""
