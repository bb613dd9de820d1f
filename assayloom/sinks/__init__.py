"""Writers: rerunnable appends, overwrites and snapshots on Parquet, CSV and JSON."""
