"""The stateless operators on a stream: clean, label and grade rows as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from modloom.operators.harmonize import flag_signals
from modloom.operators.labels import label_flags
from modloom.operators.severity import derive_severity
from modloom.rules import LABEL_RULES, SEVERITY_RULES, TEXT_RULES, LabelRules, SeverityRules, TextRules


def moderate_flags(
    rows: DataFrame,
    origin: str | Column,
    text_rules: TextRules = TEXT_RULES,
    label_rules: LabelRules = LABEL_RULES,
    severity_rules: SeverityRules = SEVERITY_RULES,
) -> DataFrame:
    """Raw flag rows to labelled and graded rows; works on a table and on a stream alike."""
    signals = flag_signals(rows, origin, text_rules)
    return derive_severity(label_flags(signals, label_rules), severity_rules)


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends everything that is available now, exactly once, and ends."""
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
