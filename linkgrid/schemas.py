"""Explicit schemas (DDL text). Times are UTC, NULL means missing (never NaN)."""

PROBE_HOURLY = ("h3_cell bigint, hour_utc timestamp, rtt_ms_median double, samples bigint")
TEST_HOURLY = (
    "h3_cell bigint, hour_utc timestamp, dl_mbps_median double, rtt_ms_median double, samples bigint"
)
USER_HOURLY = (
    "h3_cell bigint, hour_utc timestamp, target string, value_median double, samples bigint"
)
TILE_CONTEXT = (
    "h3_cell bigint, tests bigint, devices bigint, terrestrial_baseline_mbps double, "
    "terrestrial_latency_ms double"
)
ORBITAL_FEATURES = (
    "h3_cell bigint, hour_utc timestamp, sats_visible int, max_elevation_deg double"
)
WEATHER_FEATURES = (
    "h3_cell bigint, hour_utc timestamp, precip_mm_h double, precip_lag_1h double, "
    "precip_forecast_3h double"
)
ACTIVE_CELLS = ("h3_cell bigint")
CELL_STATS = ("h3_cell bigint, median double, hours int")
LATITUDE_PRIORS = ("band int, median double")
LABELS = (
    "h3_cell bigint, hour_utc timestamp, target string, value double, source string, samples bigint"
)
MEASUREMENTS = (
    "user_id string, ts timestamp, h3_cell bigint, source string, latency_ms double, "
    "dl_mbps double, ul_mbps double, obstruction_pct double, hw_version string"
)
BAND_CACHE = (
    "h3_cell bigint, hour_utc timestamp, metric string, q10 double, q50 double, q90 double, "
    "basis string, model_version string"
)
DEVICE_STATUS = (
    "ts timestamp, pop_ping_latency_ms double, downlink_throughput_bps double, "
    "uplink_throughput_bps double, fraction_obstructed double, hardware_version string"
)
PROBES = ("id bigint, geometry struct<type: string, coordinates: array<double>>")
PINGS = ("prb_id bigint, timestamp bigint, min double")
WEATHER_SERIES = ("hourly struct<time: array<string>, precipitation: array<double>>")
WEATHER_NOW = (
    "current struct<precipitation: double, snowfall: double, cloud_cover: double>"
)
ELEMENTS = (
    "OBJECT_NAME string, NORAD_CAT_ID string, EPOCH string, MEAN_MOTION string, "
    "ECCENTRICITY string, INCLINATION string, RA_OF_ASC_NODE string, ARG_OF_PERICENTER string, "
    "MEAN_ANOMALY string, BSTAR string"
)
