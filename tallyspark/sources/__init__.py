"""Sources and sinks (S1-S11): table scans, fixture adapters, copies, CSV, overwrite writes."""

from tallyspark.sources.tables import TABLES, load, scan_snapshot, tables  # noqa: F401
