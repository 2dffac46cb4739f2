"""Constants that must hold exactly for results to agree.

These are plain facts about the input formats and the published conventions.
Nothing here is computed.
"""

# --- classes and splits -----------------------------------------------------
LABEL_BONAFIDE = 0
LABEL_SPOOF = 1
LABEL_WORDS = {"spoof": 1, "bonafide": 0}
SPLITS = ["train", "dev", "test"]

# --- placeholders that stand for "no value" ---------------------------------
ATTACK_SENTINELS = ["", "-", "bonafide", "unknown", "none", "n/a"]
CONDITION_SENTINELS = ["", "-", "n/a"]

# --- audio containers recognised in a listing -------------------------------
AUDIO_SUFFIXES = [".flac", ".wav", ".mp3", ".m4a", ".ogg"]

# --- tokens a header CSV uses for a missing value ---------------------------
CSV_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- positional layouts of the label protocols (zero-based) -----------------
PROTOCOL_5_FIELDS = {"speaker_id": 0, "utt_id": 1, "attack": 3, "label": 4}
KEYS_8_FIELDS = {
    "speaker_id": 0, "utt_id": 1, "condition": 2, "transmission": 3,
    "attack": 4, "label": 5,
}
KEYS_13_FIELDS = {
    "speaker_id": 0, "utt_id": 1, "condition": 2, "attack": 4, "label": 5,
    "vocoder": 8,
}
NATIVE_SPLITS = {"train": "train", "dev": "dev", "eval": "test"}
SPLIT_DIRS = {"training": "train", "validation": "dev", "testing": "test"}
CLASS_DIRS = {"real": 0, "fake": 1}

# --- file-name safety -------------------------------------------------------
SAFE_UTT_ID = r"^[A-Za-z0-9._-]+$"
RESERVED_UTT_IDS = [".", ".."]

# --- small balanced dataset -------------------------------------------------
MINI_DATASET_ID = "mini"
MINI_PER_CLASS = 5
MINI_SPLIT_QUOTA = {"train": 2, "dev": 2, "test": 1}

# --- profile and evaluation defaults ----------------------------------------
VALUE_COUNT_LIMIT = 64
DEFAULT_SEED = 1337
DEFAULT_BOOTSTRAP = 1000
DEFAULT_CI = 0.95
DEFAULT_MIN_COVERAGE = 0.99
DEFAULT_SHARD_ROWS = 20000
DEFAULT_T_FIXED = 400
STD_FLOOR = 1e-5

# --- frame features ---------------------------------------------------------
LOGMEL_PARAMS = {
    "target_sr": 16000, "n_fft": 512, "hop_length": 160, "win_length": 400,
    "n_mels": 80, "fmin": 0.0, "fmax": None,
}
LFCC_PARAMS = {
    "target_sr": 16000, "n_fft": 512, "hop_length": 160, "win_length": 400,
    "n_filter": 20, "n_lfcc": 20, "with_deltas": True, "delta_width": 9,
    "log_eps": 1e-10,
}
POWER_FLOOR = 1e-10

# --- Slaney mel scale: linear below the break, logarithmic above ------------
MEL_HZ_PER_STEP = 200.0 / 3.0
MEL_BREAK_HZ = 1000.0
MEL_LOG_STEP_NUMERATOR = 6.4
MEL_LOG_STEP_DENOMINATOR = 27.0
