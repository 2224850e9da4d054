"""The whole analysis of one run: from graded responses to one row of results and a few small tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import long_features
from ..operators import accounting, describe, equivalence, inference


@dataclass
class Analysis:
    """DataFrames of results; none is computed before it is asked for."""

    per_wording: DataFrame
    accounting: DataFrame
    unfiltered: DataFrame
    strict: DataFrame
    parsed_only: DataFrame
    lenient: DataFrame
    histogram: DataFrame
    extremes: DataFrame
    canonical: DataFrame
    spread: DataFrame
    reliability: DataFrame
    features: DataFrame
    dropped: DataFrame

    def document(self) -> dict:
        """All of it as one nested document without a timestamp; a few hundred rows at most besides the wordings."""
        one = lambda df: {k: v for k, v in (df.first() or {}).asDict(True).items()}
        rows = lambda df: [r.asDict(True) for r in df.collect()]
        return {
            "paraphrases_dropped_for_failed_calls": self.dropped.count(), "unfiltered": one(self.unfiltered), "accounting": one(self.accounting),
            "strict": one(self.strict), "parsed_only": one(self.parsed_only), "lenient": one(self.lenient), "histogram": rows(self.histogram.orderBy("bin")),
            "best_and_worst": one(self.extremes), "canonical": one(self.canonical), "spread_test": one(self.spread), "reliability": one(self.reliability),
            "features": rows(self.features.orderBy("ord")), "per_paraphrase": rows(self.per_wording.orderBy("p")),
        }


def analyse(responses: DataFrame, items: DataFrame, pool: DataFrame, kind: str, n_items: int, equivalent: DataFrame | None = None, permutations: int = 1000, splits: int = 200, reps: int = 2000) -> Analysis:
    """``responses`` (p, i, r and, if calls were repeated, at), ``items`` (key, answer), ``pool`` (id, text) and, where a check was made, ``equivalent`` (p).

    The last record of a call counts. Wordings count if every item has a response and no call failed. The equivalence filter comes
    after that; the canonical accuracy is looked up before it.
    """
    if "at" in responses.columns:
        responses = accounting.latest(responses).drop("at")
    rows = accounting.graded(accounting.with_answers(responses, items), kind)
    usable = accounting.usable(rows, n_items)
    kept = rows.join(usable.where("kept").select("p"), "p", "left_semi")
    everyone = accounting.by_wording(kept).cache()
    cells = accounting.cells(kept)
    whole = equivalence.only_equivalent(everyone, equivalent)
    matrix = equivalence.only_equivalent(inference.complete(cells, n_items), equivalent).cache()
    wordings = pool.select(F.col("id").alias("p"), "text")
    scored = long_features(whole.select("p", F.col("strict_accuracy").alias("y")).join(wordings, "p"), "p", others=("y",))
    return Analysis(
        per_wording=whole, accounting=accounting.totals(whole), unfiltered=describe.describe(everyone, "strict_accuracy"), strict=describe.describe(whole, "strict_accuracy"),
        parsed_only=describe.describe(whole, "parsed_accuracy"), lenient=describe.describe(whole, "lenient_accuracy"),
        histogram=describe.score_histogram(whole, "strict_accuracy", n_items), extremes=accounting.best_and_worst(whole), canonical=accounting.canonical_rank(whole, everyone),
        spread=inference.spread_test(matrix, permutations), reliability=inference.split_half_reliability(matrix, splits), features=inference.feature_table(scored, reps),
        dropped=usable.where("NOT kept").select("p"),
    )
