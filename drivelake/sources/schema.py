"""Record kinds of a drive: their columns, their place in the canonical order, and their names in JSON lines.

Every table has drive_id and seq (the row's place in its source) in front; times are whole nanoseconds of a monotonic clock.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns of list-shaped records' members.
SAT = "svid INT, constellation INT, cn0_dbhz DOUBLE, elev_deg DOUBLE, az_deg DOUBLE, used_in_fix BOOLEAN, has_ephemeris BOOLEAN, has_almanac BOOLEAN, carrier_hz DOUBLE, baseband_cn0_dbhz DOUBLE"
CLOCK = "time_nanos BIGINT, leap_second INT, time_unc_nanos DOUBLE, full_bias_nanos BIGINT, bias_nanos DOUBLE, bias_unc_nanos DOUBLE, drift_nsps DOUBLE, drift_unc_nsps DOUBLE, hw_clock_discontinuity_count INT"
MEAS = (
    "svid INT, constellation INT, time_offset_nanos DOUBLE, state INT, received_sv_time_nanos BIGINT, received_sv_time_unc_nanos BIGINT, cn0_dbhz DOUBLE, pseudorange_rate_mps DOUBLE, pseudorange_rate_unc_mps DOUBLE, "
    "adr_state INT, adr_m DOUBLE, adr_unc_m DOUBLE, carrier_hz DOUBLE, multipath INT, snr_db DOUBLE, agc_db DOUBLE, baseband_cn0_dbhz DOUBLE, code_type STRING"
)
AGC = "constellation INT, carrier_hz DOUBLE, level_db DOUBLE"
CELL = (
    "rat STRING, registered BOOLEAN, mcc INT, mnc INT, area BIGINT, cid BIGINT, pci INT, arfcn INT, bandwidth_khz INT, rssi_dbm INT, rsrp_dbm INT, rsrq_db INT, sinr_db INT, timing_advance INT, asu_level INT, "
    "measured_ns BIGINT, connection_status INT"
)
AP = "bssid STRING, rssi_dbm INT, freq_mhz INT, channel_width INT, seen_ns BIGINT, standard INT"


def members(fields: str) -> str:
    """The type of an array of structs with these columns."""
    return f"ARRAY<STRUCT<{', '.join(x.replace(' ', ': ', 1) for x in fields.split(', '))}>>"


COV = "STRUCT<ee: DOUBLE, en: DOUBLE, nn: DOUBLE>"


@dataclass(frozen=True)
class Kind:
    """One record kind: JSON name, table, rank among equal times, columns after t_ns, whether it is a pipeline input, whether old
    bundles may lack it, values that JSON leaves out, and child tables (column -> table, member columns)."""

    name: str
    table: str
    rank: int
    columns: str
    measurement: bool = True
    optional: bool = False
    defaults: dict = field(default_factory=dict)
    children: dict = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [c.split(" ", 1)[0] for c in split_columns(self.columns)]

    @property
    def ddl(self) -> str:
        return f"drive_id STRING, seq BIGINT, t_ns BIGINT, {self.columns}"


def split_columns(text: str) -> list[str]:
    """The columns of a DDL text; commas inside angle brackets don't separate."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


#: The record kinds.
KINDS = {
    k.table: k
    for k in (
        Kind("session", "session", 0, "session_id STRING, anchor_elapsed_ns BIGINT, anchor_wall_ms BIGINT, device STRING, manufacturer STRING, model STRING, android_sdk INT, app_version STRING, mode STRING, notes STRING, config_json STRING",
             False, defaults=dict(device="", manufacturer="", model="", android_sdk=0, app_version="", mode="", notes="", config_json="")),
        Kind("sensor_info", "sensor_info", 1, "type INT, string_type STRING, name STRING, vendor STRING, version INT, resolution DOUBLE, max_range DOUBLE, min_delay_us INT, max_delay_us INT, fifo_max_events INT, power_ma DOUBLE", False),
        Kind("provider", "provider_event", 2, "provider STRING, event STRING"),
        Kind("imu", "imu", 3, "kind STRING, x DOUBLE, y DOUBLE, z DOUBLE, bx DOUBLE, by DOUBLE, bz DOUBLE, accuracy INT", defaults=dict(accuracy=0)),
        Kind("orientation", "orientation", 4, "kind STRING, qw DOUBLE, qx DOUBLE, qy DOUBLE, qz DOUBLE, heading_acc_rad DOUBLE"),
        Kind("gnss_status", "gnss_status", 5, f"sats {members(SAT)}", children=dict(sats=("gnss_sat", SAT, dict(has_ephemeris=False, has_almanac=False)))),
        Kind("gnss_meas", "gnss_meas", 6, f"clock {members(CLOCK)[6:-1]}, meas {members(MEAS)}, agc {members(AGC)}", children=dict(meas=("gnss_meas", MEAS, dict(multipath=0)), agc=("gnss_agc", AGC, {}))),
        Kind("nmea", "nmea", 7, "text STRING"),
        Kind("cell_scan", "cell_scan", 8, f"cells {members(CELL)}", optional=True, children=dict(cells=("cell", CELL, {}))),
        Kind("wifi_scan", "wifi_scan", 9, f"aps {members(AP)}", optional=True, children=dict(aps=("wifi_ap", AP, {}))),
        Kind("geomag", "geomag", 10, "lat DOUBLE, lon DOUBLE, declination_deg DOUBLE, inclination_deg DOUBLE, field_ut DOUBLE, source STRING", optional=True, defaults=dict(source="WMM")),
        Kind("power", "power", 11, "plug STRING, charging BOOLEAN, current_ua BIGINT, voltage_mv INT, level_pct INT, temperature_c DOUBLE", optional=True),
        Kind("vehicle_speed", "vehicle_speed", 12, "speed_mps DOUBLE, std_mps DOUBLE, source STRING"),
        Kind("location", "location", 13,
             "recv_ns BIGINT, source STRING, provider STRING, lat DOUBLE, lon DOUBLE, alt_m DOUBLE, h_acc_m DOUBLE, v_acc_m DOUBLE, speed_mps DOUBLE, speed_acc_mps DOUBLE, bearing_deg DOUBLE, bearing_acc_deg DOUBLE, "
             "wall_time_ms BIGINT, is_mock BOOLEAN, sats_used INT, extras MAP<STRING, STRING>", defaults=dict(wall_time_ms=0, is_mock=False, extras={})),
        Kind("annotation", "annotation", 14, "label STRING, note STRING", defaults=dict(note="")),
        Kind("trust", "trust", 15, "source STRING, provider STRING, state STRING, confidence DOUBLE, reasons ARRAY<STRING>, innovation_nis DOUBLE, implied_speed_mps DOUBLE", False),
        Kind("estimate", "estimate", 15, f"estimator STRING, lat DOUBLE, lon DOUBLE, cov {COV}, heading_rad DOUBLE, heading_std_rad DOUBLE, speed_mps DOUBLE, speed_std_mps DOUBLE, mode STRING, confidence DOUBLE, "
             f"hypotheses ARRAY<STRUCT<weight: DOUBLE, lat: DOUBLE, lon: DOUBLE, cov: {COV}>>", False),
        Kind("obd_raw", "obd_raw", 15, "request STRING, response STRING, latency_ms INT", False, optional=True),
    )
}

#: JSON names that don't follow from the column's name.
_JSON_NAMES = {"recv_ns": "receivedNs", "cn0_dbhz": "cn0DbHz", "baseband_cn0_dbhz": "basebandCn0DbHz", "type": "sensorType"}


def json_name(column: str) -> str:
    head, *rest = column.split("_")
    return _JSON_NAMES.get(column) or head + "".join(x.capitalize() for x in rest)


def json_type(columns: str) -> str:
    """A DDL text with JSON's names instead of the columns', at every depth."""
    out = []
    for c in split_columns(columns):
        name, kind = (x.strip() for x in c.replace(":", " ", 1).split(" ", 1)) if ":" not in c.split(" ", 1)[0] else (x.strip() for x in c.split(":", 1))
        at = kind.find("STRUCT<")
        if at >= 0:
            close = kind.rindex(">", 0, len(kind) - (1 if kind.startswith("ARRAY") else 0))
            kind = f"{kind[: at + 7]}{json_type(kind[at + 7 : close])}{kind[close:]}"
        out.append(f"{json_name(name)}: {kind}")
    return ", ".join(out)


def without_default(c: Column, value: object) -> Column:
    """Null where the column holds the value that JSON leaves out."""
    if value == {}:
        return F.when(F.size(c) > 0, c)
    return F.nullif(c, F.lit(value))


#: Kind of source by provider name; any other is OTHER.
PROVIDER_SOURCES = {"gps": "GNSS", "network": "NETWORK", "fused": "FUSED", "passive": "PASSIVE"}


def source_of_provider(provider: Column) -> Column:
    out = F.lit("OTHER")
    for name, source in PROVIDER_SOURCES.items():
        out = F.when(provider == name, source).otherwise(out)
    return out


def is_synthetic(is_mock: Column, extras: Column, key: str = "synthetic") -> Column:
    """True for fixes that a test provider made, by their flag or by "1" under the key with which their recorder notes it."""
    return F.coalesce(is_mock, F.lit(False)) | F.coalesce(F.try_element_at(extras, F.lit(key)) == "1", F.lit(False))


def without_sentinels(c: Column, kind: str = "int") -> Column:
    """Null where a sensor reports the largest number of its type, which stands for unavailable."""
    return F.nullif(c, F.lit((1 << 31) - 1 if kind == "int" else (1 << 63) - 1))
