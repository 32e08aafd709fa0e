"""The event table and the constants that define its semantics."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("node", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("anomaly", T.BooleanType(), False),
        T.StructField("event_template", T.StringType()),
        T.StructField("raw_message", T.StringType()),
    ]
)
#: Session-keyed logs also carry the session.
SESSION_EVENT = T.StructType([*EVENT.fields[:3], T.StructField("block_id", T.StringType()), *EVENT.fields[3:]])


@dataclass(frozen=True)
class Profile:
    """Constants of a data set; the defaults are those of a microsecond system log."""

    min_baseline: int = 10
    mad_floor_s: float = 1e-3
    mad_to_sigma: float = 1.4826
    rare_frequency: float = 1e-4
    z_limit: float = 3.0
    window_events: int = 20
    vocabulary: int = 300
    grid_s: int = 60
    train_fraction: float = 0.7
    threshold_quantile: float = 0.95
    pca_components: int = 20
    trees: int = 100
    rolling: int = 20
    ewma_span: int = 20
    min_periods: int = 3
    # injection
    n_injections: int = 100
    stall_seed: int = 42
    burst_seed: int = 43
    intensities: tuple[float, ...] = (10.0, 15.0, 20.0, 25.0, 30.0)
    burst_lengths: tuple[int, ...] = (10, 15, 20, 25)
    stall_min_events: int = 30
    burst_min_events: int = 55
    stall_range: tuple[float, float] = (0.2, 0.8)
    burst_range: tuple[float, float] = (0.2, 0.7)
    tries: int = 200
    fault_cap_s: float = 3600.0
    require_valid_baseline: bool = False
    exclude_zero_from_pooled: bool = False
    millisecond_clock: bool = False

    @property
    def max_mad_eff_s(self) -> float:
        """Largest scaled MAD for which the strongest stall stays under the cap."""
        return self.fault_cap_s / max(self.intensities)


SYSTEM_LOG = Profile()
#: A log with a one-second clock: most gaps are zero.
SECOND_LOG = replace(SYSTEM_LOG, exclude_zero_from_pooled=True, require_valid_baseline=True, millisecond_clock=True)
#: The ``events`` table: about one event a user every seven hours.
SPARSE = replace(SYSTEM_LOG, rare_frequency=0.02, window_events=10, grid_s=86_400, fault_cap_s=900_000.0)
#: The same under a one-hour clock, with the rules of a log with a coarse clock.
SPARSE_SECOND = replace(SPARSE, exclude_zero_from_pooled=True, require_valid_baseline=True, millisecond_clock=True)
