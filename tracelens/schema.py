"""Constants and table schemas of the telemetry domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data sets: sentinel times, event codes, priority bands, SMART eras.
TIME_BEFORE, TIME_AFTER = 0, 2**63 - 1
SUBMIT, QUEUE, ENABLE, SCHEDULE, EVICT, FAIL, FINISH, KILL, LOST, UPDATE_PENDING, UPDATE_RUNNING = range(11)
TERMINAL, FAILURE, SUCCESS = (EVICT, FAIL, FINISH, KILL, LOST), (FAIL, LOST), (FINISH,)
PRIORITY_BANDS = (("free", None, 99), ("best_effort", 100, 115), ("mid", 116, 119), ("production", 120, 359), ("monitoring", 360, None))
PRODUCTION_LOW, MONITORING_LOW = 120, 360

MICROS = 1_000_000
WINDOW_US = 300 * MICROS
INVERSION_US = 60 * MICROS
MAX_RESIDENCY_WINDOWS = 288
EARLY_RUNTIME_S = 60
SLOPE_S = (5, 15, 30)
TIER3_S = (300, 900, 3600)
ROLLING_ROWS = (7, 14, 30)
HORIZON_DAYS = (7, 14, 30)
NEGATIVE_CAP, SEED = 5, 42

_L, _D, _I, _S = T.LongType(), T.DoubleType(), T.IntegerType(), T.StringType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


SCHEMAS = {
    "instance_events": _schema(("time", _L), ("type", _L), ("collection_id", _L), ("instance_index", _L), ("machine_id", _L), ("scheduling_class", _L), ("priority", _L), ("cpu_request", _D), ("memory_request", _D)),
    "instance_usage": _schema(("collection_id", _L), ("instance_index", _L), ("machine_id", _L), ("start_time", _L), ("end_time", _L), ("avg_cpu", _D), ("avg_memory", _D), ("cycles_per_instruction", _D), ("memory_accesses_per_instruction", _D)),
    "machine_events": _schema(("time", _L), ("machine_id", _L), ("platform_id", _S), ("capacity_cpus", _D), ("capacity_memory", _D)),
    "drive_day": _schema(("serial_number", _L), ("date", T.DateType()), ("model", _S), ("capacity_bytes", _L), ("failure", _I), ("smart_5_raw", _L), ("smart_187_raw", _L), ("smart_197_raw", _L)),
}
