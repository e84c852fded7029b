"""Reading and writing tables."""

from newsloom.sources.dataset import Dataset
from newsloom.sources.csv_tables import merge_run_logs, write_csv
from newsloom.sources.metric_log import MetricLog
from newsloom.sources.parquet import read_parquet, write_parquet

__all__ = ["Dataset", "MetricLog", "merge_run_logs", "read_parquet", "write_csv", "write_parquet"]
