"""Corpus curation and detector evaluation as Spark DataFrame jobs.

The package turns label protocols and file listings into one manifest table,
checks and profiles it, extracts and pools frame features in bulk, scores
examples and derives detection metrics (EER, ROC/DET, bootstrap intervals).

Conventions: spoof = 1 and is the positive class, a larger score means spoof,
a decision is ``score >= threshold``, the key is ``(dataset_id, utt_id)`` and a
missing value is NULL.
"""
