"""Task catalog: text fields, label counts, metrics, submission names."""

from __future__ import annotations

# Text fields per task.
TASK_FIELDS = {
    "rte": ("sentence1", "sentence2"),
    "sst2": ("sentence",),
    "qqp": ("question1", "question2"),
    "mnli": ("premise", "hypothesis"),
    "mnli_matched": ("premise", "hypothesis"),
    "mnli_mismatched": ("premise", "hypothesis"),
    "qnli": ("question", "sentence"),
    "cola": ("sentence",),
    "mrpc": ("sentence1", "sentence2"),
    "stsb": ("sentence1", "sentence2"),
    "wnli": ("sentence1", "sentence2"),
    "homophones": ("word1", "word2"),
    "rhyme": ("sentence1", "sentence2"),
    "etymology": ("word1", "word2"),
    "verses": ("Verse",),
}

# Number of labels per task; 1 means regression.
TASK_LABELS = {
    "rte": 2, "sst2": 2, "qqp": 2, "mnli": 3, "qnli": 2, "cola": 2, "mrpc": 2, "stsb": 1, "wnli": 2,
    "homophones": 2, "rhyme": 2, "etymology": 2, "verses": 4,
}

# Reported metric per task.
TASK_METRIC = {
    "rte": "accuracy", "sst2": "accuracy", "qqp": "f1", "mnli": "accuracy", "qnli": "accuracy",
    "cola": "accuracy", "mrpc": "f1", "stsb": "spearmanr", "wnli": "accuracy",
}

# Tasks of the sentence benchmark.
BENCHMARK_TASKS = (
    "cola", "mnli", "mnli_matched", "mnli_mismatched", "mrpc", "qnli", "qqp", "rte", "sst2", "stsb", "wnli",
)

# Submission file per task.
SUBMISSION_FILES = {
    "cola": "CoLA.tsv", "sst2": "SST-2.tsv", "mrpc": "MRPC.tsv", "qqp": "QQP.tsv", "stsb": "STS-B.tsv",
    "mnli_matched": "MNLI-m.tsv", "mnli_mismatched": "MNLI-mm.tsv", "qnli": "QNLI.tsv", "rte": "RTE.tsv",
    "wnli": "WNLI.tsv", "ax": "AX.tsv",
}

# Printed label names; other tasks print the number.
LABEL_NAMES = {
    "mnli_matched": ("entailment", "neutral", "contradiction"),
    "mnli_mismatched": ("entailment", "neutral", "contradiction"),
    "ax": ("entailment", "neutral", "contradiction"),
    "qnli": ("entailment", "not_entailment"),
    "rte": ("entailment", "not_entailment"),
}

# Meter classes of the verse task.
METERS = ("iambic", "anapaestic", "trochaic", "dactyl")


def task_fields(task: str) -> tuple[str, ...]:
    if task not in TASK_FIELDS:
        raise ValueError(f"unknown task: {task}")
    return TASK_FIELDS[task]
