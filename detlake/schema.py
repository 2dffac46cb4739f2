"""Declared schemas of every table the package exchanges."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["dataset_id", "utt_id"]

REQUIRED = T.StructType([
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("utt_id", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("label", T.LongType(), False),
    T.StructField("split", T.StringType(), False),
])

OPTIONAL = T.StructType([
    T.StructField("attack_type", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("transmission", T.StringType()),
    T.StructField("vocoder", T.StringType()),
    T.StructField("speaker_id", T.StringType()),
    T.StructField("sample_rate", T.LongType()),
    T.StructField("codec", T.StringType()),
    T.StructField("duration", T.DoubleType()),
])

MANIFEST = T.StructType(REQUIRED.fields + OPTIONAL.fields)
REQUIRED_COLUMNS = REQUIRED.names
OPTIONAL_COLUMNS = OPTIONAL.names

HISTORY = T.StructType([
    T.StructField("epoch", T.LongType()),
    T.StructField("train_loss", T.DoubleType()),
    T.StructField("val_eer", T.DoubleType()),
    T.StructField("val_threshold", T.DoubleType()),
    T.StructField("lr", T.DoubleType()),
])

INDEX_COLUMNS = [
    "utt_id", "path", "label", "split",
    "source_dataset_id", "source_utt_id", "attack_type",
]
INDEX = T.StructType([T.StructField(c, T.StringType()) for c in INDEX_COLUMNS])

SCORE_COLUMNS = ["dataset_id", "utt_id", "split", "label", "attack_type", "score"]

WAVEFORM = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("utt_id", T.StringType()),
    T.StructField("sr", T.IntegerType()),
    T.StructField("samples", T.ArrayType(T.FloatType())),
])
