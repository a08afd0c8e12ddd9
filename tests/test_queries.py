"""Registered queries against their SQL on the given tables; NIGHTGRID_ALL=1 runs every one."""

import decimal
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver

SAMPLE = (
    "A2_night_grade", "A3_rule_summary", "A5_hard_events", "A8_token_ranking", "A9_issue_counts", "A13_duration_quantiles", "A22_combination_completeness",
    "A34_header_field_distribution", "A40_profile_summary", "A44_masked_attention_pooling", "D1_exact_once_batches", "D1_permuted_batches", "D2_class_metrics", "F2_parse_prefilter_strict",
    "F8_release_split", "F13_path_safety", "F14_block_tree", "F14_checked_ranges", "F14_file_checksums", "J3_h5_edf_compare", "J5_expected_channel_missing", "J8_point_in_interval", "K8_idempotent_publish", "K9_release_ledger",
    "L5_time_grid_overlay", "L8_alignment_summary", "P16_channel_selection", "P24_session_findings", "Q6_line_power_fraction", "Q14_placeholder_rows",
    "S2_edf_header_scan", "S2_edf_listed_headers", "S3_edf_listed_samples", "S3_edf_sample_range", "U1_registered_reader_windows", "V1_flag_audit", "V13_batch_contract", "W5_global_index_lookup", "W11_greedy_shards", "W13_pad_batches", "X2_chunked_band_filter", "X3_chunked_resample", "X3_rational_resample")
QUERIES, SQL = driver.queries(), driver.oracle_sql()
NAMES = list(QUERIES) if os.environ.get("NIGHTGRID_ALL") else list(SAMPLE)


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return float(v) if isinstance(v, (int, np.integer)) else str(v)


@pytest.fixture(scope="module")
def tables(data_dir):
    con = duckdb.connect()
    for name in os.listdir(data_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    cursor = tables.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in cursor.fetchall()), key=repr)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
