"""Fixed values shared by the jobs: vocabularies, limits, prices, word lists."""

# --- fixed values: outcome labels, call and stage vocabularies -------------
FAULTS = ("bad_stt", "hallucination", "tts_glitch", "timeout", "user_hangup", "network_drop", "exception")
OUTCOMES = (*FAULTS, "ok", "unknown")
CALL_STATUSES = ("queued", "in_progress", "completed", "failed", "aborted")
FINISHED = ("completed", "failed")
IN_FLIGHT = ("queued", "in_progress")
MAIN_STAGES = ("stt", "llm", "tts")
STAGES = (*MAIN_STAGES, "analysis")
INPUT_SOURCES = ("sample", "upload", "recording", "live_mic")
STAGE_LIMIT_MS = {"stt": 5000, "llm": 8000, "tts": 5000}
MODEL_DEPENDENT_FAULTS = ("hallucination",)
CAUSE_STAGE = {"bad_stt": "stt", "hallucination": "llm", "tts_glitch": "tts"}

# --- fixed values: monitor and quota defaults ------------------------------
SLA_MAX_FAILURE_PCT = 5.0
SLA_WINDOW_MINUTES = 60
SLA_MIN_CALLS = 5
SLA_COOLDOWN_MINUTES = 15
DAILY_CALL_LIMIT = 25
HOURLY_UNITS_PER_ADDRESS = 60
DEBOUNCE_SECONDS = 10
RECURRING_MIN_COUNT = 3
SUGGESTION_FRESH_HOURS = 2
OUTAGE_MAX_SECONDS = 300
STALE_RUN_MINUTES = 5
SMALL_SAMPLE_FAULT_RUNS = 14
DAILY_SPEND_CAP_USD = 5.0
SESSION_SPEND_CAP_USD = 1.0

# --- fixed values: reference cost used when a tenant has no healthy calls --
REFERENCE_CALL_COST_USD = 0.00408
REFERENCE_CALL_COST_N = 19

# --- fixed values: price list (USD) ----------------------------------------
STT_PER_MINUTE = {"deepgram": 0.0043, "whisper": 0.006}
LLM_PER_1K_TOKENS = {"gpt-4o-mini": (0.00015, 0.0006), "gpt-4o": (0.0025, 0.01)}
TTS_PER_1K_CHARS = {"tts-1": 0.015}
DEFAULT_LLM = "gpt-4o-mini"
DEFAULT_TTS = "tts-1"

# --- fixed values: recogniser thresholds -----------------------------------
STT_MIN_CONFIDENCE = 0.6
STT_MIN_CONFIDENCE_BY_PROVIDER = {"deepgram": 0.85}
LOW_WORD_CONFIDENCE = 0.7

# --- fixed values: A/B decision thresholds ---------------------------------
AB_MIN_RUNS = 2
AB_FAILURE_GAP = 0.5
AB_WER_GAP = 0.03
AB_TIME_GAP_S = 0.4
AB_COST_GAP_USD = 0.0002
AB_RELATIVE_GAP = 0.1

# --- fixed values: conversation structure ----------------------------------
PHRASE_PAUSE_S = 0.25
PAUSE_S = 0.7
LONG_PAUSE_S = 1.5
TURN_UNCERTAIN_BELOW = 0.6
OVERLAP_MIN_S = 0.15
CUT_GAP_S = 0.5
BACKGROUND_MERGE_S = 0.6
ACKNOWLEDGEMENTS = (
    "yeah", "yes", "yep", "yup", "okay", "ok", "right", "sure", "mm", "mhm", "hmm", "uh-huh", "uh", "huh", "oh",
    "alright", "i", "see", "got", "it", "thanks", "thank", "you", "sorry", "go", "ahead", "please",
)
DANGLING_WORDS = (
    "the", "a", "an", "and", "but", "or", "to", "of", "for", "with", "my", "your", "i", "it's", "it", "that", "is",
    "are", "was", "on", "in", "at", "so", "because", "if", "i'm", "we", "you", "this",
)
FILLERS = ("uh", "um", "uhm", "uhh", "umm", "er", "erm", "ah", "hmm", "mm", "mmm")

# --- fixed values: number words --------------------------------------------
CURRENCY_WORDS = ("dollars", "dollar", "cents", "cent")
UNIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19,
}
TEN_WORDS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
WRITTEN_ORDINALS = {
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "twelfth": "12th",
    "fourteenth": "14th", "fifteenth": "15th", "twentieth": "20th",
}
ORDINAL_WORDS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9,
    "tenth": 10, "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15,
    "sixteenth": 16, "seventeenth": 17, "eighteenth": 18, "nineteenth": 19, "twentieth": 20, "thirtieth": 30,
}
ORDINAL_TENS = {"twenty": 20, "thirty": 30}
CORRECTION_MARKERS = ("no", "nope", "sorry", "wait", "actually", "rather", "meant", "mean", "oops")
VALUE_STOP_WORDS = (
    "the", "and", "dollars", "dollar", "cents", "usd", "order", "number", "amount", "approximately", "about",
)
ORDINAL_SUFFIXES = ("st", "nd", "rd", "th")

# --- fixed values: understanding document ----------------------------------
INTENTS = (
    "duplicate_charge", "failed_payment", "pending_transaction", "missing_order", "refund_request",
    "incorrect_charge", "subscription_charge", "delivery_problem", "billing_account_issue",
    "unauthorized_transaction", "general_inquiry", "other", "unclear",
)
EMOTIONS = (
    "calm", "confused", "frustrated", "impatient", "nervous", "embarrassed", "rushed", "distracted", "relieved",
    "angry", "neutral", "not_evident",
)
HIGH_ENERGY_EMOTIONS = ("frustrated", "angry", "impatient", "rushed", "nervous")
CALM_EMOTIONS = ("calm", "relieved")
NO_EMOTION = ("not_evident", "unclear", "neutral")
VALENCES = ("negative", "neutral", "positive", "mixed", "unclear")
LEVELS = ("low", "medium", "high")
ENTITY_KEYS = ("order_ids", "transaction_ids", "amounts", "dates", "other")

# --- fixed values: voice and signal thresholds -----------------------------
FAST_WPM, SLOW_WPM = 165, 125
WIDE_ST, NARROW_ST = 11.0, 5.0
SWING_DB, STEADY_DB = 8.0, 3.5
HESITANT_FILLERS_PER_MIN, HESITANT_PAUSE_RATIO, LONG_PAUSE_COUNT = 3.0, 0.25, 2
MIN_TONE_SPEECH_S, MIN_TONE_SNR_DB, MIN_LOUDNESS_SNR_DB = 8.0, 15.0, 18.0
MEDIUM_CONFIDENCE_SPEECH_S = 15.0
BAND_LIMITED_HF_DB = -27.0
COMPRESSED_LEVEL_SD_DB, COMPRESSED_MIN_SNR_DB = 3.5, 18.0
VERY_NOISY_DB, NOISY_DB, CLEAN_DB = 12.0, 26.0, 30.0
CLIPPING_RATIO = 0.005

# --- fixed values: speaker separation --------------------------------------
MIN_PITCH_DELTA_ST, MIN_DPRIME, MIN_SECOND_VOICE_S, POOLED_SD_FLOOR = 5.5, 3.5, 1.0, 0.8
RELIABLE_PHRASE_FRAMES = 30
WORD_MIN_FRAMES, WORD_FULL_WEIGHT_FRAMES, VOICE_SIGMA_FLOOR = 4, 12, 2.0
SWITCH_COST, SWITCH_DISCOUNT, SWITCH_PAUSE_S = 20.0, 0.4, 0.35
REPAIR_MAX_RUN, REPAIR_GAP_S = 2, 0.3
BACKGROUND_DB, BACKGROUND_MIN_FRAMES, SAME_VOICE_ST = 12.0, 8, 3.0
VOICED_ABOVE_FLOOR_DB = 8.0
RELIABLE_SOURCES = ("acoustic", "recognizer+acoustic", "single_voice")

# --- fixed values: findings ------------------------------------------------
SEVERITY_WEIGHT = {"info": 0.5, "warn": 2.0, "issue": 3.0}
AREAS = ("audio", "speech", "conversation", "content")

# --- fixed values: file kinds ----------------------------------------------
AUDIO_EXTENSIONS = ("wav", "mp3", "m4a", "mp4", "ogg", "oga", "webm", "flac", "aac", "mpeg", "mpga")
EXTENSION_ALIASES = {"mpeg": "mp3", "mpga": "mp3"}
MIME_EXTENSIONS = {
    "audio/wav": "wav", "audio/x-wav": "wav", "audio/wave": "wav", "audio/mpeg": "mp3", "audio/mp3": "mp3",
    "audio/mp4": "m4a", "audio/x-m4a": "m4a", "audio/aac": "aac", "audio/ogg": "ogg", "audio/webm": "webm",
    "video/webm": "webm", "audio/flac": "flac",
}
