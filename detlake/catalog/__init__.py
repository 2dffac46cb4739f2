"""Registered queries, each with the SQL that checks it where SQL can."""

MODULES = [
    "source_queries", "manifest_queries", "quality_queries", "resume_queries",
    "profile_queries", "detection_queries", "frame_queries", "model_queries",
]
