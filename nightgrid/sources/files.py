"""Text and header file sources with explicit, all-string schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions.columns import tolerant_number, tolerant_text

BOM = "﻿"


def read_metadata(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Recording metadata CSV, all strings, by folder and session; optional first N for smoke runs."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip(BOM) for c in df.columns]).orderBy("BIDSFolder", "SessionID")
    return df if limit is None else df.limit(limit)


def session_columns(metadata: DataFrame) -> DataFrame:
    """Metadata rows with their session key and typed fields."""
    raw = tolerant_text(F.col("SessionID"))
    session = F.when(raw.startswith("ses-"), raw).otherwise(F.concat(F.lit("ses-"), raw))
    return metadata.select(
        tolerant_text(F.col("BDSPPatientID")).alias("patient_id"), tolerant_text(F.col("BIDSFolder")).alias("subject_id"),
        session.alias("session_id"), F.concat_ws("/", tolerant_text(F.col("BIDSFolder")), session).alias("session_key"),
        tolerant_number(F.col("RecordingDuration")).alias("metadata_duration_seconds"),
        tolerant_text(F.col("StartDateTime")).alias("metadata_start"), tolerant_text(F.col("EndDateTime")).alias("metadata_end"))


TSV_COLUMNS = ("name", "type", "units", "sampling_frequency", "lowcutoff", "high_cutoff", "status",
               "status_description", "description")


def _python_float(x: Column) -> Column:
    """Text of a number the way the filter summary prints it: 5 as 5.0, NULL as None."""
    return F.when(x.isNull(), "None").otherwise(x.cast("string"))


def read_channels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated channel descriptions; rows without a name are dropped."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    df = df.toDF(*[c.lstrip(BOM) for c in df.columns])
    df = df.withColumns({c: F.lit(None).cast("string") for c in TSV_COLUMNS if c not in df.columns})
    hp, lp = tolerant_number(F.col("lowcutoff")), tolerant_number(F.col("high_cutoff"))
    return df.where(tolerant_text(F.col("name")) != "").select(
        *[c for c in df.columns if c not in TSV_COLUMNS],
        tolerant_text(F.col("name")).alias("raw_channel"), tolerant_text(F.col("type")).alias("channel_type"),
        tolerant_text(F.col("units")).alias("unit"), tolerant_number(F.col("sampling_frequency")).alias("fs_hz"),
        hp.alias("hp_hz"), lp.alias("lp_hz"), F.lit(None).cast("double").alias("notch_hz"),
        (hp.isNotNull() | lp.isNotNull()).alias("filter_parse_ok"),
        F.concat(F.lit("HP:"), _python_float(hp), F.lit(" LP:"), _python_float(lp)).alias("prefilter_raw"),
        tolerant_text(F.col("status")).alias("status"), tolerant_text(F.col("status_description")).alias("status_description"),
        tolerant_text(F.col("description")).alias("description"))


SIDECAR_SCHEMA = ("Manufacturer string, PowerLineFrequency string, SamplingFrequency string, SoftwareFilters string, "
                  "RecordingType string, EEGReference string")


def sidecar_fields(df: DataFrame) -> DataFrame:
    return df.select(
        tolerant_text(F.col("Manufacturer")).alias("manufacturer"),
        tolerant_text(F.col("PowerLineFrequency")).alias("power_line_frequency"),
        tolerant_number(F.col("SamplingFrequency")).alias("bids_sampling_frequency"),
        tolerant_text(F.col("SoftwareFilters")).alias("bids_software_filters"),
        tolerant_text(F.col("RecordingType")).alias("recording_type"), tolerant_text(F.col("EEGReference")).alias("eeg_reference"),
        F.when(F.col("_corrupt_record").isNotNull(), "unreadable JSON").alias("bids_json_error"),
        *[F.col(x) for x in df.columns if x == "path"])


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Selected sidecar keys with the file they came from; unreadable files keep an error text."""
    df = (spark.read.schema(SIDECAR_SCHEMA + ", _corrupt_record string").option("multiLine", True)
          .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path))
    return sidecar_fields(df.withColumn("path", F.col("_metadata.file_path")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Task label CSV with every column as text; missing required columns are a caller error."""
    from nightgrid.operators.labels import check_columns

    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.lstrip(BOM) for c in df.columns])
    check_columns(df)
    return df


def read_channel_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(m.CHANNEL_HEADER_SCHEMA).parquet(path)


def list_files(spark: SparkSession, root: str, pattern: str = "*.h5",
               layout: str = r"/(sub-[^/]+)/(ses-[^/]+)/eeg/[^/]+$") -> DataFrame:
    """Recording files below sub-*/ses-*/eeg with their keys; only the listing is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(root).select("path", "length"))
    part = lambda i: F.regexp_extract("path", layout, i)
    return (files.withColumn("subject_id", part(1)).withColumn("session_id", part(2))
            .where(F.col("subject_id") != "")
            .withColumn("session_key", F.concat_ws("/", "subject_id", "session_id")))


def exactly_one(files: DataFrame, kinds: dict[str, Column], excluded: str, key: str = "session_key",
                path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Sessions with exactly one file of every kind, and an error row for the others.

    Names that contain the excluded token are ignored.
    """
    name = F.lower(F.element_at(F.split(F.translate(F.col(path), "\\", "/"), "/"), -1))
    live = ~name.contains(excluded.lower())
    per = files.groupBy(key).agg(
        *[F.count_if(cond & live).alias(f"_n_{k}") for k, cond in kinds.items()],
        *[F.min(F.when(cond & live, F.col(path))).alias(k) for k, cond in kinds.items()])
    ok = F.lit(True)
    for k in kinds:
        ok = ok & (F.col(f"_n_{k}") == 1)
    counts = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(f"_n_{k}").cast("string")) for k in kinds])
    errors = per.where(~ok).select(key, F.lit("sources").alias("stage"), F.lit("SOURCE_COUNT").alias("code"), counts.alias("detail"))
    return per.where(ok).select(key, *kinds), errors


def write_binary(rows: DataFrame, folder: str) -> int:
    """(path, content) rows as files below a folder, written by the tasks; returns how many.

    Paths are relative and must differ; a task that runs again writes the same bytes.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with store.open_output_stream(f"{root}/{path}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("path", "content").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def store(path: str):
    """(file system, path in it); any URI that Arrow knows, or a plain local path. For use in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def open_file(path: str):
    """A file open for reading at any place."""
    system, inner = store(path)
    return system.open_input_file(inner)
