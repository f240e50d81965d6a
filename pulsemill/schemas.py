"""Canonical schemas of all tables. Columns are nullable; there are no keys or defaults."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

_TYPES = {"timestamp_ntz": TimestampNTZType(), "timestamp": TimestampType(), "string": StringType(), "double": DoubleType(), "int": IntegerType(), "bigint": LongType(), "boolean": BooleanType(), "array<double>": ArrayType(DoubleType())}


def _of(text: str) -> StructType:
    """`name type, name type, ...`; unlike Spark's own parser this needs no session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (part.split(" ") for part in text.split(", "))])


MESSAGE = _of("timestamp string, location string, x double, y double, z double")
RAW = _of("timestamp timestamp_ntz, location string, x double, y double, z double")
STAGING = _of("timestamp timestamp_ntz, location string, x double, y double, z double, magnitude double, batch_ts timestamp, batch_id string")
LOCATION_HLP = _of("location_key int, location_name string, city string, country string, ins_tmstmp timestamp_ntz, upd_tmstmp timestamp_ntz, batch_id string")
LOCATION_DIM = _of("location_key int, location_name string, city string, country string, is_current boolean, valid_from timestamp_ntz, valid_to timestamp_ntz, ins_tmstmp timestamp_ntz, upd_tmstmp timestamp_ntz, oper string, batch_id string")
FACT = _of("timestamp timestamp_ntz, location_key int, x double, y double, z double, magnitude double, ins_tmstmp timestamp_ntz, batch_id string")
HOURLY = _of("hour_ts timestamp_ntz, location_key int, location_name string, city string, country string, sample_count bigint, avg_x double, avg_y double, avg_z double, avg_magnitude double, max_magnitude double, min_magnitude double, stddev_magnitude double, ins_tmstmp timestamp_ntz, upd_tmstmp timestamp_ntz, batch_id string")
SPECTRUM = _of("window_ts timestamp_ntz, location_key int, sample_count int, freq_hz array<double>, fft_x array<double>, fft_y array<double>, fft_z array<double>, fft_magnitude array<double>, ins_tmstmp timestamp_ntz, upd_tmstmp timestamp_ntz, batch_id string")
CDC = _of("raw_file string, file_size_bytes bigint, run_id string, batch_id string, status string, processed_ts timestamp_ntz, ins_tmstmp timestamp_ntz")
BENCHMARK = _of("run_id string, env string, batch_id string, raw_file string, step_name string, sql_file string, target_table string, data_ingested_rows bigint, data_ingested_bytes bigint, duration_ms double, start_ts timestamp_ntz, end_ts timestamp_ntz, status string, error_message string, ins_tmstmp timestamp_ntz")
QUEUE = _of("file_path string, folder_path string, file_size_bytes bigint, file_mtime_ns bigint, status string, attempts int, next_retry_ts timestamp_ntz, last_error string, last_run_id string, created_ts timestamp_ntz, updated_ts timestamp_ntz")

#: The tables of each schema by their public names.
TABLES = {
    "staging.stg_accelerometer": STAGING,
    "curated.location_hlp": LOCATION_HLP,
    "curated.location_dim": LOCATION_DIM,
    "curated.fact_accelerometer": FACT,
    "marts.accel_hourly_summary": HOURLY,
    "marts.accel_fft_mart": SPECTRUM,
    "staging.processed_files_cdc": CDC,
    "marts.pipeline_benchmark": BENCHMARK,
    "staging.realtime_job_queue": QUEUE,
}
