"""Publication and release rules as row-wise decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Publication states, their watermarks and reasons.
SYNTHETIC = (
    "BLOCKED_SYNTHETIC_DEMONSTRATION",
    "DEMONSTRAÇÃO SINTÉTICA — NÃO É PREVISÃO ELEITORAL",
    "Resultados produzidos com dados sintéticos não podem ser apresentados como previsão da eleição presidencial de ",
)
PENDING = (
    "BLOCKED_PENDING_INDEPENDENT_VALIDATION",
    "MODELO NÃO VALIDADO PARA PUBLICAÇÃO",
    "A publicação externa exige backtesting temporal e validação metodológica independente.",
)
ELIGIBLE = (
    "PUBLICATION_ELIGIBLE",
    None,
    "Dados operacionais e modelo informados como independentemente validados.",
)
# Release reasons.
RELEASE_REASONS = {
    "dataset": "publication blocked: dataset is not real",
    "validation": "publication blocked: dataset/model validation is incomplete",
    "elections": "publication blocked: insufficient historical elections in backtest",
    "brier": "publication blocked: Brier score does not meet release threshold",
    "calibration": "publication blocked: calibration error does not meet release threshold",
}


def publication_status(df: DataFrame) -> DataFrame:
    """Whether a forecast may be published, with status, watermark and reason."""
    synthetic = F.col("dataset_type") == "synthetic"
    pending = F.col("validation_status") != "independently_validated"

    def choose(i: int, year=None):
        first = F.concat(F.lit(SYNTHETIC[2]), F.col("election_year").cast("string"), F.lit(".")) if year else F.lit(SYNTHETIC[i])
        return F.when(synthetic, first).when(pending, F.lit(PENDING[i])).otherwise(F.lit(ELIGIBLE[i]))

    return (
        df.withColumn("allowed", ~synthetic & ~pending)
        .withColumn("status", choose(0))
        .withColumn("watermark", choose(1))
        .withColumn("reason", choose(2, year=True))
    )


def release_gate(
    df: DataFrame, max_brier: float = 0.25, max_calibration_error: float = 0.10, min_elections: int = 2
) -> DataFrame:
    """Release decision with the reasons that block it."""
    why = {k: F.lit(v) for k, v in RELEASE_REASONS.items()}
    checks = [
        F.when(F.lower("dataset_type") != "real", why["dataset"]),
        F.when(~F.lower("validation_status").isin("validated", "approved"), why["validation"]),
        F.when(F.col("backtest_elections") < min_elections, why["elections"]),
        F.when(F.col("brier_score").isNull() | (F.col("brier_score") > max_brier), why["brier"]),
        F.when(
            F.col("calibration_error").isNull() | (F.col("calibration_error") > max_calibration_error),
            why["calibration"],
        ),
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*checks))).withColumn(
        "allowed", F.size("reasons") == 0
    )
