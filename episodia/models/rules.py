"""The rule model: four interpretable quantities against their training distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FeatureSettings, RegimeSettings, RuleSettings, micros
from ..operators.cycles import LOADED, OFFLOAD, STOPPED, baselines, duty_ratio
from ..operators.ordered import with_last_runs
from ..operators.rank import percentile_ranks, weight
from ..operators.stretches import Scope, Wanted, raw_stretches, stretches

#: Canonical order, and the side on which each quantity is abnormal.
RULES = {"short_stopped_duration": "low", "fast_pressure_decay": "high", "low_peak_pressure": "low", "high_duty_ratio": "high"}
#: Label, fact of the last finished run, and whether a truncated run hides it.
RUN_FACTS = {"short_stopped_duration": (STOPPED, "duration_s", True), "fast_pressure_decay": (STOPPED, "abs_slope", False), "low_peak_pressure": (OFFLOAD, "peak", True)}
RELATIVE = tuple(RUN_FACTS)


def _n_rows(measured: DataFrame) -> Column:
    """How many rows a measured row stands for."""
    return F.size("__us") if "__us" in measured.columns else weight(measured)


class RuleModel:
    def __init__(self, features: FeatureSettings = FeatureSettings(), rules: RuleSettings = RuleSettings(), by: Sequence[str] = ("scope_id",), train_keys: Sequence[str] = (), regimes: RegimeSettings | None = None):
        """by: the series key; train_keys: the part of it that has a training distribution of its own. regimes: how packed
        quantities label rows that have no regime yet."""
        if unknown := [r for r in rules.enabled if r not in RULES]:
            raise ValueError(f"unknown rules {unknown}")
        if rules.mode not in ("trailing", "lagged"):
            raise ValueError(f"unknown baseline mode {rules.mode!r}")
        self.features, self.rules, self.by, self.train_keys, self.regimes = features, rules, list(by), list(train_keys), regimes
        self.contributors = [r for r in RULES if r in rules.enabled]
        self.train: DataFrame | None = None
        self.until: int | None = None

    def _lag(self) -> int | None:
        return micros(self.rules.lag) if self.rules.mode == "lagged" else None

    def _wanted(self, hole_us: int | None, cuts: Sequence[int]) -> Wanted:
        facts = {f"q_{r}": RUN_FACTS[r] for r in RELATIVE if r in self.contributors}
        shares = {"q_high_duty_ratio": (LOADED, micros(self.features.duty))} if "high_duty_ratio" in self.contributors else {}
        lag = self._lag()
        age = None if lag is None else micros(self.rules.baseline) + lag
        return Wanted(facts, shares, micros(self.features.gap), micros(self.rules.baseline), lag, hole_us, tuple(cuts), age)

    def scoped_quantities(self, df: DataFrame, tasks: Sequence[Sequence[Scope]], by: Sequence[str] | None = None, hole_us: int | None = None, cuts: Sequence[int] = (), times: bool = False) -> DataFrame:
        """Packed quantities of rows without regimes, each scope as a series of its own (__scope), in one pass over the rows.
        Without times, a stretch has us, __until and __n instead of __us."""
        if self.regimes is None:
            raise ValueError("rows without regimes need the settings of these")
        return raw_stretches(df, self.regimes, self.features.decay_channel, self._wanted(hole_us, cuts), by or self.by, tasks, times)

    def quantities(self, df: DataFrame, by: Sequence[str] | None = None, packed: bool = False, hole_us: int | None = None, cuts: Sequence[int] = (), tasks: Sequence[Sequence[Scope]] | None = None) -> DataFrame:
        """Adds q_<rule> for every enabled rule: values of the last finished runs, then their ratio to a moving baseline.

        packed: (by, q_<rule>, __begin, __us) instead, a row for a stretch of rows that have the same, with their times; it
        ends at larger holes than hole_us and before the times in cuts. One pass, and far fewer rows to rank. tasks: scoped_quantities() of these scopes."""
        by = by or self.by
        if packed and tasks is not None:
            return self.scoped_quantities(df, tasks, by, hole_us, cuts)
        if packed and "regime" not in df.columns:
            return self.scoped_quantities(df, [[Scope(0)]], by, hole_us, cuts, True).drop("__scope")
        if packed:
            return stretches(df, self.features.decay_channel, self._wanted(hole_us, cuts), by)
        lag = self._lag()
        if "high_duty_ratio" in self.contributors:
            df = df.withColumn("q_high_duty_ratio", duty_ratio(micros(self.features.duty), by))
        wanted = {f"__{r}": RUN_FACTS[r] for r in RELATIVE if r in self.contributors}
        if not wanted:  # needs no runs
            return df
        rows = with_last_runs(df, self.features.decay_channel, wanted, micros(self.features.gap), by)
        rows = rows.drop("run_id", *(f"{c}_gap" for c in wanted))
        return baselines(rows, {c: f"q{c[1:]}" for c in wanted}, micros(self.rules.baseline), lag, by).drop(*wanted)

    def fit(self, train: DataFrame) -> RuleModel:
        """train: rows with the train keys, us, regime and the decay channel. Other parts of the series key may be absent."""
        missing = [F.lit(None).alias(c) for c in self.by if c not in train.columns]
        self.train = train.select(*(c for c in self.by if c in train.columns), *missing, "us", "regime", self.features.decay_channel)
        self.until = None
        return self

    def fit_until(self, us: int) -> RuleModel:
        """Training on the rows before `us` of the series that contributions() is given. As a row's quantities depend on no
        later row, it is measured once, for training and to be judged."""
        self.train, self.until = None, us
        return self

    def rated(self, measured: DataFrame) -> DataFrame:
        """Adds the severities to measured rows, judged among those of their train keys that have __train. Packed rows stay
        packed: each of their rows has the same severities."""
        in_train = F.col("__train").cast("long") * _n_rows(measured)
        us = F.get("__us", F.lit(0)) if "__us" in measured.columns else F.col("us")
        both = percentile_ranks(measured.withColumn("__weight", in_train), "__weight", {f"q_{r}": f"__rank_{r}" for r in self.contributors}, self.train_keys).drop("__weight")
        warm = micros(self.rules.baseline) + micros(self.rules.lag)
        severities = {}
        for r in self.contributors:
            rank = F.col(f"__rank_{r}")
            ramp = 1 - 2 * rank if RULES[r] == "low" else 2 * rank - 1
            missing = F.when(us - F.col("__begin") >= warm, F.lit(0.0)) if r in RELATIVE and self.rules.mode == "lagged" else F.lit(0.0)
            severities[r] = F.when(rank.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ramp))).otherwise(missing)
        return both.withColumns(severities).drop("__begin", *(f"__rank_{r}" for r in self.contributors))

    def contributions(self, rows: DataFrame) -> DataFrame:
        """Adds a severity in [0, 1] per rule: 0 up to the median of training, 1 at its extreme; missing reads 0, or NULL
        in the warm-up of a lagged baseline. Training rows go through the same pass as the others, as series of their own
        unless they are the past of the same series (fit_until; then only the series key, us, quantities and severities return)."""
        if self.until is not None:
            if "regime" in rows.columns:
                rows = rows.select(*self.by, "us", "regime", self.features.decay_channel)
            measured = self.quantities(rows, None, True, None, (self.until,))
            rated = self.rated(measured.withColumn("__train", F.get("__us", F.lit(0)) < self.until))
            # adaptive execution takes packed rows for few and would unpack them in one task
            n = int(rated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            return rated.repartition(n).withColumn("us", F.explode("__us")).drop("__us", "__train")
        if self.train is None:
            raise ValueError("the model is not fitted")
        both = rows.withColumn("__train", F.lit(False)).unionByName(self.train.withColumn("__train", F.lit(True)), allowMissingColumns=True)
        by = [*self.by, "__train"]
        measured = self.quantities(both, by)
        if self.rules.mode == "lagged":
            measured = measured.withColumn("__begin", F.min("us").over(Window.partitionBy(*by)))
        return self.rated(measured).where("not __train").drop("__train")

    def calibration_quantile(self, rule: str, q: float) -> DataFrame:
        """(train keys, value): the q-th linear quantile of a rule's quantity in its training distribution."""
        if self.train is None:
            raise ValueError("the model is not fitted")
        if rule not in self.contributors:
            raise KeyError(rule)
        return self.calibration(self.quantities(self.train), q).where(F.col("rule") == rule).drop("rule")

    def calibration(self, measured: DataFrame, q: float) -> DataFrame:
        """(train keys, rule, value): the q-th linear quantiles of all rules' quantities in measured (or packed) training rows."""
        n = _n_rows(measured)
        wide = measured.groupBy(*self.train_keys).agg(*(F.percentile(f"q_{r}", F.lit(float(q)), n).alias(r) for r in self.contributors))
        pairs = [x for r in self.contributors for x in (F.lit(r), F.col(r))]
        return wide.select(*self.train_keys, F.stack(F.lit(len(self.contributors)), *pairs).alias("rule", "value"))

    def score(self, rows: DataFrame) -> DataFrame:
        return self.scored(self.contributions(rows))

    def scored(self, rated: DataFrame) -> DataFrame:
        top = F.greatest(*(F.col(r) for r in self.contributors)) if len(self.contributors) > 1 else F.col(self.contributors[0])
        return rated.withColumn("score", top)
