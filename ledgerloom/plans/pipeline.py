"""The four stages as whole runs: build a dataset, describe it, evaluate questions on it, score the results."""

from ledgerloom.plans.build import build_dataset, is_current, prune_dataset
from ledgerloom.plans.evaluate import evaluate, results_of, retrieve, score
from ledgerloom.plans.figures import figures, write_figures
from ledgerloom.plans.report import describe, is_fresh

__all__ = ["build_dataset", "describe", "evaluate", "figures", "is_current", "is_fresh", "prune_dataset", "results_of", "retrieve", "score", "write_figures"]
