"""Constants that are part of the log model's semantics.

The values in this module are FIXED VALUES: word lists, lookup tables, patterns and thresholds that results
depend on. They are data, not logic.
"""

# --- fixed values: categories -------------------------------------------------------------------------------
DEFAULT_CATEGORIES = [
    "thermal", "mechanical", "electrical", "gas_leak", "contamination",
    "process_drift", "safety", "software", "maintenance", "unknown",
]

# Ordered: the first group with a keyword inside the lower-cased text gives the category.
CATEGORY_KEYWORDS = [
    ("safety", ["fire", "evacuate", "toxic", "emergency", "gas detector"]),
    ("gas_leak", ["sih4", "hbr", "nf3", "cl2", "gas leak", "mfc", "pressure drop", "gas_leak"]),
    ("thermal", ["temperature", "temp", "overheat", "thermal", "heater", "cooling"]),
    ("electrical", ["voltage", "current", "rf", "arc", "power", "electrical", "vsup", "dcbx", "almid"]),
    ("mechanical", ["collision", "robot", "wafer drop", "mechanical", "valve", "pump"]),
    ("contamination", ["particle", "contamination", "spill", "chemical"]),
    ("process_drift", ["overlay", "removal rate", "etch rate", "drift", "out-of-spec", "recipe"]),
    ("software", ["timeout", "mes", "communication", "software", "crash"]),
    ("maintenance", ["pm due", "calibration", "maintenance", "scheduled"]),
]

# Equipment family -> (alias tokens, candidate categories).
EQUIPMENT_FAMILIES = [
    ("thin_film", ["CENTURA", "VANTAGE", "VECTOR", "ENDURA", "PRODUCER", "CVD", "ALD", "PVD", "PECVD"],
     ["gas_leak", "thermal", "electrical", "process_drift"]),
    ("plasma_etch", ["KIYO", "VANTEX", "FLEX", "EPISODE", "ETCH", "RIE"],
     ["electrical", "gas_leak", "mechanical", "thermal", "process_drift"]),
    ("lithography", ["TWINSCAN", "LITHO-SCANNER", "LITHO", "SCANNER", "EUV"],
     ["mechanical", "process_drift", "electrical", "maintenance"]),
    ("cmp", ["REFLEXION", "MIRRA", "CMP"],
     ["mechanical", "thermal", "process_drift", "contamination"]),
    ("thermal_processing", ["ANNEAL", "DIFFUSION", "RTP", "FURNACE", "THERMAL"],
     ["thermal", "electrical", "process_drift"]),
    ("atomic_layer", ["ALD", "PULSAR"],
     ["process_drift", "gas_leak", "mechanical"]),
    ("implantation", ["IMPLANT", "NV8200"],
     ["electrical", "mechanical", "process_drift"]),
    ("wet_processing", ["WET-BENCH", "WET-STATION", "TRACK", "WET"],
     ["contamination", "gas_leak", "process_drift", "safety"]),
    ("plating", ["ECP", "ELECTROFILL", "PLATING"],
     ["process_drift", "electrical", "contamination"]),
    ("epitaxy", ["EPI", "EPITAXIAL"],
     ["process_drift", "thermal", "gas_leak"]),
    ("wafer_handling", ["ROBOT", "ROBOT-ARM", "HANDLER", "EFEM"],
     ["mechanical"]),
    ("gas_delivery", ["GAS-PANEL", "GAS-CABINET", "MFC", "VMB"],
     ["gas_leak", "safety", "mechanical"]),
    ("metrology", ["SEM", "OCD", "SURFSCAN", "METROLOGY", "KLA"],
     ["maintenance", "contamination", "process_drift"]),
    ("support", ["PUMP", "CHILLER", "UPS", "ABATEMENT", "VACUUM"],
     ["mechanical", "thermal", "electrical"]),
    ("mes", ["MES-SERVER", "HOST", "SECS", "E84"],
     ["software"]),
]

# --- fixed values: canonical record -------------------------------------------------------------------------
FIELD_ALIASES = {
    "timestamp": ["timestamp", "ts", "time", "date", "created_at", "created"],
    "source": ["source", "machine", "machine_id", "host", "device", "tool"],
    "severity": ["severity", "level", "log_level", "priority"],
    "message": ["message", "msg", "event", "description", "text"],
    "event_type": ["event_type", "event", "type", "category"],
}
SEVERITY_NAMES = {
    "CRITICAL": "critical", "ERROR": "error", "WARNING": "warning",
    "WARN": "warning", "INFO": "info", "DEBUG": "info",
}
FILE_FORMATS = ["json", "xml", "csv", "log", "txt"]
LINE_TIMESTAMP_PATTERN = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
LINE_SEVERITY_PATTERN = r"\b(ERROR|CRITICAL|WARNING|WARN|INFO|DEBUG)\b"
LINE_SOURCE_PATTERN = r"\b(machine|tool|device|host)_\w+"
CATEGORY_NAME_PATTERN = r"^[a-z][a-z0-9_]{0,31}$"
FORMAT_SNIFF_BYTES = 500
RAW_VIEW_BYTES = 512_000

# --- fixed values: scoring ----------------------------------------------------------------------------------
SEVERITY_CODES = {"critical": 4, "error": 3, "warning": 2, "warn": 2, "info": 1, "debug": 0, "unknown": 0}
CATEGORY_CODES = {
    "safety": 0, "electrical": 1, "thermal": 2, "gas_leak": 3, "mechanical": 4,
    "contamination": 5, "process_drift": 6, "software": 7, "maintenance": 8, "unknown": 9,
}
CONFIDENCE_THRESHOLD = 0.85
DEAD_LETTER_CONFIDENCE = 0.3
MISSING_FIELD_PENALTY = 0.1
RULE_CONFLICT_PENALTY = 0.1
RULE_AGREEMENT_BONUS = 0.15
FEEDBACK_BOOST_RANGE = 0.20
MESSAGE_LENGTH_NORM = 500.0
CONFLICT_REASON = "Rule and AI categorization conflict"
QUEUE_DEFAULT_REASON = "Low confidence in categorization"
ROUTE_DEFAULT_REASON = "Low confidence"
FAILED_CLASSIFICATION = ("unknown", "unknown", "manual review", 0.0)
DEFAULT_CLASSIFICATION_CONFIDENCE = 0.5

# --- fixed values: topics, windows, limits ------------------------------------------------------------------
TOPIC_P0 = "logs.p0"
TOPIC_P1 = "logs.p1"
TOPIC_P2 = "logs.p2"
TOPIC_DEADLETTER = "logs.deadletter"
TOPICS = [TOPIC_P0, TOPIC_P1, TOPIC_P2, TOPIC_DEADLETTER]
DEDUP_TTL_SECONDS = 86_400
SPIKE_THRESHOLD = 10
SPIKE_WINDOW_SECONDS = 300
POOL_LIMIT = 50
EXAMPLES_PER_EVENT = 3
COLD_BATCH_ROWS = 100
COLD_BATCH_SECONDS = 300
RETENTION_DAYS = {"normalized_events": 7, "raw_logs": 30, "log_events": 90}
NOVELTY_ALERT = 0.72
FOREST_MIN_ROWS = 50
FOREST_REFIT_EVERY = 20
FOREST_TREES = 100
FOREST_SUBSAMPLE = 256
FOREST_SEED = 42
CONFIDENCE_HIGH = 0.70
CONFIDENCE_MEDIUM = 0.50
NOVELTY_HIGH = 0.58
