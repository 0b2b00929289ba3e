"""End-to-end plans: unified table, graded dataset, token table, training batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modloom.checks import require, require_zero, watched
from modloom.domains import FLAG_SIGNALS, ORIGIN_TEST, ORIGIN_TRAIN, SOURCE_COLUMNS
from modloom.operators import evaluate
from modloom.operators import harmonize as H
from modloom.operators.labels import label_flags, label_scores
from modloom.operators.heads import score_batches
from modloom.operators.sampling import (
    EVAL_ROWS,
    epoch_resample,
    eval_sample,
    padded_batches,
    sample_rows,
)
from modloom.operators.schema import enforce_schema, need_schema, null_counts, repeated_uids, validate_schema
from modloom.operators.severity import derive_severity, judge_severity, severity_check, severity_counts
from modloom.operators.split import add_groups_and_split, split_leakage
from modloom.operators.tokens import PAD_ID, build_vocab, target_prepare, tokenize
from modloom.rules import (
    LABEL_RULES,
    SEVERITY_RULES,
    SPLIT_RULES,
    TEXT_RULES,
    LabelRules,
    SeverityRules,
    SplitRules,
    TextRules,
)
from modloom.sources.storage import Checked, cut_lineage, materialize, own_scratch, write_table


def flag_tables(
    train: DataFrame, test: DataFrame, rules: TextRules = TEXT_RULES
) -> tuple[DataFrame, DataFrame]:
    """(labelled, unlabelled) signal tables of the flag source."""
    train_labeled, train_unlabeled = H.split_labeled(train)
    test_labeled, test_unlabeled = H.split_labeled(test)
    labeled = [(train_labeled, ORIGIN_TRAIN), (test_labeled, ORIGIN_TEST)]
    unlabeled = [(train_unlabeled, ORIGIN_TRAIN), (test_unlabeled, ORIGIN_TEST)]
    return (
        H.assemble_parts(labeled, rules),
        H.assemble_parts(unlabeled, rules).select(*SOURCE_COLUMNS),
    )


def load_flags(
    spark, train, texts, labels, labeled_path, unlabeled_path, rules=TEXT_RULES, force=False
) -> tuple[DataFrame, DataFrame]:
    """Checked and cleaned flag tables, written once. Inputs are functions that open a table."""

    def build() -> tuple[Checked, DataFrame]:
        # The first check reads keys only, the other one counts while the table is written.
        label_rows = cut_lineage(labels(), "labels")
        require(H.check_test_labels(texts().select("id"), label_rows), "bad test labels")
        labeled, unlabeled = flag_tables(train(), H.join_test_labels(texts(), label_rows), rules)
        labeled, counts = watched(labeled, [H.invalid_rows(FLAG_SIGNALS)])
        return Checked(labeled, lambda _: require_zero(counts(), "flags outside 0 and 1")), unlabeled

    return materialize(spark, (labeled_path, unlabeled_path), build, force)


def load_annotators(spark, rows, order, path, rules=TEXT_RULES, force=False) -> DataFrame:
    """Aggregated and cleaned annotator table, written once."""

    def build() -> tuple[DataFrame]:
        return (H.annotator_signals(H.aggregate_annotators(rows(), order), rules),)

    return materialize(spark, path, build, force)[0]


def unify(
    flags: DataFrame,
    scores: DataFrame,
    label_rules: LabelRules = LABEL_RULES,
    split_rules: SplitRules = SPLIT_RULES,
) -> DataFrame:
    """The unified table."""
    combined = H.combine_sources(label_flags(flags, label_rules), label_scores(scores, label_rules))
    return enforce_schema(add_groups_and_split(combined, split_rules))


def check_unified(unified: DataFrame) -> None:
    require(validate_schema(unified), "the unified table breaks its schema")
    check_splits(unified)


def check_splits(unified: DataFrame) -> None:
    leaks = split_leakage(unified)
    if not leaks.isEmpty():
        raise ValueError("some texts span more than one split")


def build_unified(
    flags: DataFrame, scores: DataFrame, path: str, sample: int | None = None, **rules
) -> DataFrame:
    """Builds, checks and publishes the unified table, or an exact sample of its rows.

    A sample is drawn after duplicates and splits are known, so its rows have the values they
    have in the whole table. Nulls are counted by the write itself; unique ids and leaks are
    checked on the written keys, before the table takes the place of an older one.
    """
    with own_scratch(flags.sparkSession):
        rows = unify(flags, scores, **rules)
        rows = rows if sample is None else sample_rows(rows, sample)
        need_schema(rows)
        rows, nulls = watched(rows, null_counts())

        def accept(written: DataFrame) -> None:
            message = "the unified table breaks its schema"
            require_zero(nulls(), message)
            require(repeated_uids(written), message)
            check_splits(written)

        write_table(rows, path, accept=accept)
    return flags.sparkSession.read.parquet(path)


def build_graded(
    unified: DataFrame, path: str | None = None, rules: SeverityRules = SEVERITY_RULES
) -> DataFrame:
    """Adds severity and refuses a rubric with a rare level; published only then, if asked to."""
    graded = derive_severity(unified, rules)
    message = "the severity rubric does not fit"
    if path is None:
        require(severity_check(graded, rules), message)
        return graded
    spark = unified.sparkSession
    rows, counts = watched(graded, severity_counts())
    write_table(
        rows, path, accept=lambda _: require(judge_severity(spark.createDataFrame([counts()]), rules), message)
    )
    return spark.read.parquet(path)


def build_tokens(graded: DataFrame, path: str, vocab: DataFrame | None = None) -> DataFrame:
    """Token table, one folder per split, so a split is read without the others.

    Without a vocabulary, one is made of the training split alone.
    """
    with own_scratch(graded.sparkSession):
        train = graded.filter("split = 'train'")
        words = vocab if vocab is not None else cut_lineage(build_vocab(train), "vocab")
        write_table(tokenize(target_prepare(graded), words), path, ("split",))
    return graded.sparkSession.read.parquet(path)


def training_batches(tokens: DataFrame, epoch: int = 0, pad_id: int = PAD_ID) -> DataFrame:
    """Resampled, length-grouped and padded rows of one epoch, with their batch_id."""
    return padded_batches(epoch_resample(tokens, epoch), pad_id, epoch)


def score_split(
    rows: DataFrame, load_model, split: str = "val", n: int | None = EVAL_ROWS
) -> DataFrame:
    """A model's scores on one split, or on an exact sample of its rows with a severity."""
    chosen = rows.filter(F.col("split") == split)
    return score_batches(chosen if n is None else eval_sample(chosen, n), load_model)


def analyze_scores(
    rows: DataFrame, load_model, split: str = "val", n: int | None = EVAL_ROWS
) -> dict[str, DataFrame]:
    """Severity report, confusion and distance of errors of a model on one split."""
    scored = cut_lineage(score_split(rows, load_model, split, n), "scored")
    return {
        "report": evaluate.severity_report(scored),
        "confusion": evaluate.severity_confusion(scored),
        "distance": evaluate.severity_distance(scored),
    }


def tune_thresholds(rows: DataFrame, load_model, split: str = "val") -> DataFrame:
    """The best threshold per target of a model on one whole split."""
    return evaluate.threshold_table(cut_lineage(score_split(rows, load_model, split, None), "scored"))
