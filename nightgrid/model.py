"""Constants, schemas and rule parameters shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: they must equal the published format for results to agree -------------
FS = 200
EPOCH_SECONDS = 30
EPOCH_SAMPLES = 6000
EPOCH_NS = 30_000_000_000
MIN_DURATION_SECONDS = 30
MAX_DURATION_SECONDS = 72 * 3600
GIB = 1024**3

CHANNELS = (
    "f3-m2", "f4-m1", "c3-m2", "c4-m1", "o1-m2", "o2-m1", "e1", "e2", "ecg",
    "chin1-chin2", "lat", "rat", "airflow", "snore", "spo2",
)
GROUP_CHANNELS = {
    "eeg": ("f3-m2", "f4-m1", "c3-m2", "c4-m1", "o1-m2", "o2-m1"),
    "eog": ("e1", "e2"),
    "ecg": ("ecg",),
    "emg": ("chin1-chin2", "lat", "rat"),
    "respiratory": ("airflow", "snore", "spo2"),
}
CHANNEL_ALIASES = {
    "f3-m2": ("f3-m2",), "f4-m1": ("f4-m1",), "c3-m2": ("c3-m2",), "c4-m1": ("c4-m1",),
    "o1-m2": ("o1-m2",), "o2-m1": ("o2-m1",), "e1": ("e1",), "e2": ("e2",),
    "ecg": ("ecg", "ekg"), "chin1-chin2": ("chin1-chin2", "chin"), "lat": ("lat",),
    "rat": ("rat",), "airflow": ("airflow", "npt", "ptaf"), "snore": ("snore",),
    "spo2": ("spo2", "sao2"),
}
HARD_CODES = {
    0: "NO_HARD_ARTIFACT_DETECTED", 1: "NAN", 2: "FLAT_LINE", 3: "SATURATION",
    4: "HIGH_AMPLITUDE", 5: "POWER_LINE_INTERFERENCE", 6: "HIGH_FREQUENCY_NOISE",
    7: "SPO2_OUT_OF_RANGE",
}
HARD_PRIORITY = (1, 3, 4, 2, 5, 6, 7)
APPLICABLE_MASK = {"eeg": 63, "eog": 63, "ecg": 63, "emg": 29, "airflow": 3, "snore": 1, "spo2": 65}
CHANNEL_STATUS = {
    "AVAILABLE": 0, "CHANNEL_MISSING": 1, "CHANNEL_UNREADABLE": 2,
    "CALIBRATION_OR_UNIT_INVALID": 3, "PROFILE_EXCLUDED": 4, "SPO2_NEAR_ZERO": 5,
}
FILTER_TARGETS = {
    "eeg": (0.3, 35.0), "eog": (0.3, 35.0), "ecg": (0.3, 70.0), "emg": (10.0, 100.0),
    "airflow": (0.159, 15.0), "snore": (10.0, 100.0),
}
FILTER_STATE = {"NOT_EVALUATED": 0, "SOURCE_FILTER_EXPLICIT": 1, "SOURCE_FILTER_UNKNOWN": 2}
FILTER_RELATION = {
    "NOT_EVALUATED": 0, "MATCH": 1, "SOURCE_WIDER": 2, "SOURCE_NARROWER": 3, "MIXED": 4,
    "UNKNOWN": 5, "NOT_REQUIRED": 6,
}
EFFECTIVE_FILTER = {
    "NOT_EVALUATED": 0, "SOURCE_FILTER_AS_RECORDED": 1, "SOURCE_FILTER_REAPPLY": 2,
    "FILTER_NOT_REQUIRED": 3, "REAPPLY_FAILED": 4, "PROCESSING_SKIPPED_PROFILE_EXCLUDED": 5,
}
PROCESS_RESULT = {
    "NOT_EVALUATED": 0, "NOT_REQUIRED": 1, "SUCCESS": 2, "FAILED": 3, "UNSUPPORTED": 4,
    "NOT_RUN_PROFILE_EXCLUDED": 5, "PARTIAL": 6,
}
COVERAGE_DETECTION = {"NOT_EVALUATED": 0, "LENGTH_ONLY": 1, "TIMESTAMP_CHECKED": 2}
UNIT_SCALE = {"uv": 1.0, "microvolt": 1.0, "microvolts": 1.0, "mv": 1e3, "v": 1e6}
PERCENT_UNITS = ("%", "percent", "percentage")
TASK_FIELDS = {
    "sleep_stage": ("stage",),
    "heart_rate": ("max_bpm", "min_bpm", "mean_bpm"),
    "sao2": ("max_percent", "min_percent"),
}
TASK_SOURCE_COLUMNS = {
    "stage": "Stage", "max_bpm": "Heart Rate Max", "min_bpm": "Heart Rate Min",
    "mean_bpm": "Heart Rate Avg", "max_percent": "SaO2 Max", "min_percent": "SaO2 Min",
}
TASK_LIMITS = {"heart_rate": (20.0, 300.0), "sao2": (20.0, 100.0)}
TASK_QC = {
    0: "TASK_INCLUDED", 1: "TASK_SOURCE_EPOCH_MISSING", 2: "TASK_VALUE_MISSING_OR_NONFINITE",
    3: "TASK_VALUE_OUT_OF_RANGE_OR_UNKNOWN_CLASS", 4: "TASK_FIELD_ORDER_INVALID",
    5: "TASK_SOURCE_TIME_UNVERIFIED", 6: "TASK_H5_STAGE_CONFLICT", 7: "TASK_SOURCE_STAGE_MISMATCH",
}
TASK_STRUCTURE = {
    0: "TASK_STRUCTURE_PASS", 1: "TASK_SOURCE_COVERAGE_MISMATCH", 2: "TASK_N_MISMATCH",
    3: "TASK_RECORD_RANGE_MISMATCH", 4: "TASK_EPOCH_KEY_MISMATCH", 5: "TASK_DURATION_MISMATCH",
}
STAGE_TOKENS = {
    "N3": 1, "3": 1, "N2": 2, "2": 2, "N1": 3, "1": 3, "REM": 4, "R": 4, "WAKE": 5, "W": 5,
}
EVENT_STAGES = ("N3", "N2", "N1", "REM", "WAKE")
METRIC_SENTINELS = {
    "nonfinite_output_count": 65535, "nonfinite_source_count": 4294967295,
    "std_physical": float("nan"), "digital_peak_to_peak_codes": float("nan"),
    "digital_unique_count_capped3": 255, "saturation_fraction": float("nan"),
    "high_amplitude_duration_seconds": 255, "power_line_fraction": float("nan"),
    "high_frequency_fraction": float("nan"), "spo2_in_range_fraction": float("nan"),
}
RELEASE_VERSION = "v1.0.0"
RELEASE_SCHEMAS = ("1.0.0-pilot.2", "1.0.0-full.1")
RELEASE_STATUSES = ("COMPLETE", "COMPLETE_WITH_FAILURES")
MANIFEST_VERSION = 1
DEFAULT_RATES = {"eeg": 100.0, "eog": 100.0, "emg": 100.0, "ecg": 100.0, "resp": 25.0, "spo2": 25.0}
_SIX_EEG = tuple((name,) for name in GROUP_CHANNELS["eeg"])
_TWO_EOG = (("e1",), ("e2",))
CHANNEL_PROFILES = {
    "full": {
        "eeg": _SIX_EEG, "eog": _TWO_EOG, "emg": (("chin1-chin2",),), "ecg": (("ecg",),),
        "resp": (("abd",), ("chest",), ("airflow", "ptaf")), "spo2": (("spo2",),),
    },
    "neuro": {"eeg": _SIX_EEG, "eog": _TWO_EOG, "emg": (("chin1-chin2",),)},
    "compact7": {
        "eeg": (("c4-m1", "c3-m2"),), "eog": (("e1", "e2"),), "emg": (("chin1-chin2",),),
        "ecg": (("ecg",),), "resp": (("abd",), ("chest",)), "spo2": (("spo2",),),
    },
}
# Slots whose published name differs from their first candidate.
PROFILE_SLOT_NAMES = {("compact7", "eeg", 0): "central-eeg", ("compact7", "eog", 0): "eog"}
# --- end of fixed values -----------------------------------------------------------------


def channel_kind(name: str) -> str:
    """Rule family of a channel: its storage group, or itself for the respiratory three."""
    for group, members in GROUP_CHANNELS.items():
        if name in members:
            return name if group == "respiratory" else group
    raise ValueError(f"unknown channel {name!r}")


@dataclass(frozen=True)
class RuleSpec:
    """Every number the epoch rules use. The defaults are the published rules."""

    fs: float = float(FS)
    epoch_seconds: float = float(EPOCH_SECONDS)
    epoch_samples: int = EPOCH_SAMPLES
    amplitude_windows: int = 30
    amplitude_limit: dict = field(
        default_factory=lambda: {"eeg": 1000.0, "eog": 2000.0, "ecg": 10000.0, "emg": 5000.0})
    flat_std: dict = field(default_factory=lambda: {"eeg": 0.5, "eog": 0.5, "ecg": 5.0})
    psd_segment: int = 800
    psd_overlap: int = 400
    line_threshold: float = 0.40
    high_frequency_threshold: float = 0.50
    saturation_threshold: float = 0.05
    flat_code_span: float = 2.0
    flat_code_unique: int = 2
    spo2_range: tuple = (50.0, 110.0)
    spo2_min_fraction: float = 0.70


def _literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return f"'{value}'" if isinstance(value, str) else str(value)


def channel_map(values: dict, column: Column) -> Column:
    """Look a key up in a small constant dictionary, parsed as one map literal."""
    table = ", ".join(_literal(x) for pair in values.items() for x in pair)
    return F.try_element_at(F.expr(f"map({table})"), column)


def kind_column(channel: Column) -> Column:
    return channel_map({name: channel_kind(name) for name in CHANNELS}, channel)


def group_column(channel: Column) -> Column:
    return channel_map({c: g for g, cs in GROUP_CHANNELS.items() for c in cs}, channel)


def inline_table(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A few constant rows as a local relation of the plan."""
    values = ", ".join("(" + ", ".join(_literal(x) for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def channel_dimension(spark: SparkSession) -> DataFrame:
    """Fifteen fixed rows: order, kind, storage group, applicable rules and output unit."""
    rows = [
        (i, c, channel_kind(c), next(g for g, m in GROUP_CHANNELS.items() if c in m),
         APPLICABLE_MASK[channel_kind(c)], "%" if c == "spo2" else "uV")
        for i, c in enumerate(CHANNELS)
    ]
    return inline_table(spark, rows, ("channel_idx", "channel", "kind", "grp", "applicable", "unit"))


def enum_dimension(spark: SparkSession) -> DataFrame:
    """All enum dictionaries as (enum, code, label); a fixed few dozen rows."""
    tables = {
        "hard_code": HARD_CODES,
        "task_qc": TASK_QC,
        "task_structure": TASK_STRUCTURE,
        "channel_status": {v: k for k, v in CHANNEL_STATUS.items()},
        "source_filter_state": {v: k for k, v in FILTER_STATE.items()},
        "filter_relation": {v: k for k, v in FILTER_RELATION.items()},
        "effective_filter_state": {v: k for k, v in EFFECTIVE_FILTER.items()},
        "process_result": {v: k for k, v in PROCESS_RESULT.items()},
        "coverage_detection": {v: k for k, v in COVERAGE_DETECTION.items()},
    }
    rows = [(name, code, label) for name, t in tables.items() for code, label in t.items()]
    return inline_table(spark, rows, ("enum", "code", "label"))


CHANNEL_HEADER_SCHEMA = (
    "recording_id string, channel string, source_present boolean, read_error string, fs double, "
    "source_samples bigint, duration_sec double, unit string, dig_min double, dig_max double, "
    "phys_min double, phys_max double, prefilter string")
NATIVE_CHUNK_SCHEMA = (
    "recording_id string, channel string, chunk_no int, first_sample bigint, codes array<double>")
STAGE_EVENT_SCHEMA = (
    "recording_id string, event_idx int, start_s double, end_s double, code int")
