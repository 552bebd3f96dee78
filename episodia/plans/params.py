"""Parameters of the registered queries, fit for about one event in 12 minutes per asset (sf 0.01)."""

from datetime import datetime

from ..config import EvaluationSettings, Event, FeatureSettings, Region, RegimeSettings, RuleSettings, SplitSettings

MIN = 60_000_000
HOUR = 60 * MIN
DAY = 24 * HOUR

REGIMES = RegimeSettings(states={"LOADED": {"is_click": 1.0}}, split_channel="value", split_at=35.0, min_duration="12min", settle="8min")
FEATURES = FeatureSettings(decay_channel="value", min_samples=3, gap="80min", baseline="1D", duty="4h", lag="2D")
RULES = RuleSettings(baseline="1D", mode="trailing", lag="2D")
EVENTS = (
    Event(1, datetime(2024, 1, 8, 0), datetime(2024, 1, 8, 4), datetime(2024, 1, 8, 8)),
    Event(2, datetime(2024, 1, 15, 6), datetime(2024, 1, 15, 10)),
    Event(3, datetime(2024, 1, 20, 12), datetime(2024, 1, 20, 15), datetime(2024, 1, 20, 18)),
    Event(4, datetime(2024, 1, 26, 0), datetime(2024, 1, 26, 6), datetime(2024, 1, 26, 7)),
)
SPLIT = SplitSettings(embargo="6h", pre_margin="6h", post_settle="6h", fallback_post="12h", regions=(Region(datetime(2024, 1, 11, 0), datetime(2024, 1, 11, 6)),), min_train_days=2)
WIDTHS = (6.0, 12.0, 24.0)
QUANTILES = (0.95, 0.99, 0.995)
EVALUATION = EvaluationSettings(widths_h=WIDTHS, quantile=0.95, quantiles=QUANTILES, hold="40min", score_gap="2h", permutation_samples=200, chance_threshold=0.1, pooled_buffer="6h", false_alarm_ceiling=1.0, events=EVENTS)
DATA_START, DATA_END = datetime(2024, 1, 1), datetime(2024, 1, 30)
INTERVAL_US, LENGTH, STRIDE, TOLERANCE = 12 * MIN, 10, 2, 0.1
SCORE_THRESHOLD = 0.9


def _settings():
    from ..config import ForestSettings, ReconstructionSettings, ScalingSettings, Settings, WindowSettings

    every = ("value",)
    scaling = ScalingSettings(channels=every, passthrough=("is_error", "is_view"), min_samples=10, active={"LOADED": every, "OFFLOAD": every, "STOPPED": every, "TRANSITION": ()})
    windows = WindowSettings(window="2h", stride_train="24min", stride_score="12min", gap="80min")
    return Settings(SPLIT, EVALUATION, REGIMES, FEATURES, scaling, windows, RULES, ForestSettings(trees=30, max_samples=128), ReconstructionSettings(bottleneck=4, widths=(8, 8), kernel=3, epochs=5))


def _us(t):
    from ..operators.folds import at

    return at(t)


SETTINGS = _settings()
US_START, US_END = _us(DATA_START), _us(DATA_END)
