"""The contract of prediction models: named outcomes that sum to one, or an abstention with its reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Probabilities of a row may miss one by so much.
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Model:
    """run takes subjects and gives at most one row for each, with a column for each outcome; others abstain for `otherwise`."""

    id: str
    version: str
    outcomes: tuple[str, ...]
    run: Callable[[DataFrame], DataFrame]
    otherwise: str = "no output"


@dataclass
class Registry:
    """Models of one kind of subject, in the order of their registration."""

    keys: tuple[str, ...]
    outcomes: tuple[str, ...]
    models: dict[str, Model] = field(default_factory=dict)

    def register(self, model: Model) -> None:
        if model.outcomes != self.outcomes:
            raise ValueError(f"{model.id} gives {model.outcomes}, not {self.outcomes}")
        if model.id in self.models:
            raise ValueError(f"{model.id} is registered already")
        self.models[model.id] = model

    def outputs(self, subjects: DataFrame) -> DataFrame:
        """(keys, model, version, outcomes, abstained, reason): a row for each subject and model.

        A model that leaves out a subject abstains; one whose probabilities are missing, outside 0 to 1, or do not sum to one
        is made to abstain. A model without one of its columns is an error.
        """
        if not self.models:
            raise ValueError("no model is registered")
        asked = subjects.select(*self.keys).distinct()
        found = None
        for model in self.models.values():
            out = model.run(subjects)
            if lacking := [c for c in (*self.keys, *self.outcomes) if c not in out.columns]:
                raise ValueError(f"{model.id} lacks {lacking}")
            rows = asked.join(out.select(*self.keys, *(F.col(c).cast("double").alias(c) for c in self.outcomes), F.lit(True).alias("given")), list(self.keys), "left")
            p = [F.col(c) for c in self.outcomes]
            total = sum(p, F.lit(0.0))
            valid = (F.abs(total - 1) <= TOLERANCE) & F.least(*p).between(0, 1) & F.greatest(*p).between(0, 1)
            reason = F.when(F.col("given").isNull(), F.lit(model.otherwise)).when(~F.coalesce(valid, F.lit(False)), F.lit("probabilities are none that sum to one"))
            rows = rows.withColumn("reason", reason)
            kept = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in self.outcomes]
            rows = rows.select(*self.keys, F.lit(model.id).alias("model"), F.lit(model.version).alias("version"), *kept, F.col("reason").isNotNull().alias("abstained"), "reason")
            found = rows if found is None else found.unionByName(rows)
        return found
