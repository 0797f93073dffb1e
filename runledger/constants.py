"""Vocabularies, texts and thresholds that results depend on."""

# Replica states.
TRANSFERRING = "transferring"
VERIFYING = "verifying"
TRANSFERRED = "transferred"
ERROR = "error"
FAILED = "failed"
REUPLOAD = "RSEreupload"
QUOTA = "RSEquota"
OVERWRITE_REQUEST = "overwrite_request"

# Replica types.
RAW = "raw"
PROCESSED = "processed"
UNTRIGGERED = "untriggered"

# Detectors.
TPC = "tpc"
VETO = "muon_veto"

NOT_AVAILABLE = "n/a"
NOT_SET = "not_set"
VALID = "valid"

# Directory holding one processing version: prefix + version.
VERSION_DIR_PREFIX = "pax_"

# Files of a raw directory that hold no events.
EXTRA_RAW_FILES = 4
DEFAULT_EVENTS_PER_FILE = 1000

# Stall limits in hours, purge floor in copies, single-core limit in events.
STALL_ALERT_HOURS = 2
STALL_PURGE_HOURS = 24
MIN_COPIES_BEFORE_PURGE = 3
SINGLE_CORE_EVENTS = 1000
REQUIRED_WRITE_MODE = 2
SKIP_TAG = "donotprocess"
REQUIRED_PARAMS = ("gains", "drift_velocity_liquid", "electron_lifetime_liquid")

# Rule lifetimes: verify only, permanent; seconds granted to a file-level rule.
LIFETIME_VERIFY = "-2"
LIFETIME_PERMANENT = "-1"
FILE_RULE_LIFETIME = 10
RULE_ID_LENGTH = 32

# Gains of channels that are not computed.
VETO_GAIN = 1e6
LED_GAIN = 1.0

# Last instant of the first science period, and the period names.
SCIENCE_CUTS = (("2017-02-02 17:40:00", "SR000"),)
SCIENCE_LAST = "SR001"

# Products derived from one processed run.
DERIVED_PRODUCTS = (
    "Corrections", "Basics", "Fundamentals", "PositionReconstruction", "CorrectedDoubleS1Scatter",
    "LargestPeakProperties", "IsolatedPeaks", "TotalProperties", "Extended", "Proximity",
    "LoneSignalsPreS1", "LoneSignals", "FlashIdentification", "SingleElectrons",
)

# Text marks in tape client output: (field, mark, is integer).
UPLOAD_COUNTERS = (
    ("inspected", "Total number of objects inspected:", True),
    ("backedup", "Total number of objects backed up:", True),
    ("updated", "Total number of objects updated:", True),
    ("rebound", "Total number of objects rebound:", True),
    ("deleted", "Total number of objects deleted:", True),
    ("expired", "Total number of objects expired:", True),
    ("failed", "Total number of objects failed:", True),
    ("encrypted", "Total number of objects encrypted:", True),
    ("grew", "Total number of objects grew:", True),
    ("retries", "Total number of retries:", True),
    ("bytes_inspected", "Total number of bytes inspected:", False),
    ("bytes_transferred", "Total number of bytes transferred:", False),
    ("data_transfer_time", "Data transfer time:", False),
    ("network_transfer_rate", "Network data transfer rate:", False),
    ("aggregate_transfer_rate", "Aggregate data transfer rate:", False),
    ("object_compressed", "Objects compressed by:", False),
    ("total_data_reduction", "Total data reduction ratio:", False),
    ("elapsed_processing_time", "Elapsed processing time:", False),
)
RESTORE_COUNTERS = (
    ("restored_objects", "Total number of objects restored"),
    ("restored_bytes", "Total number of bytes transferred:"),
    ("failed_objects", "Total number of objects failed:"),
    ("data_transfer_time", "Data transfer time:"),
    ("network_transfer_rate", "Network data transfer rate:"),
    ("aggregate_transfer_rate", "Aggregate data transfer rate:"),
    ("elapsed_processing_time", "Elapsed processing time:"),
)
RESTORE_FILE_MARK = "Restoring"
LISTING_MARK = "DEFAULT"

# Transfer log marks (the success phrase is spelt like this in the logs).
SUCCESS_PHRASE = "Upload to tape: [succcessful]"
LOG_UPLOADED = "Number of uploaded files:"
LOG_INSPECTED = "Number of inspected files:"
LOG_AMOUNT = "Transferred amount of data:"
LOG_RATE = "Network transfer rate:"
LOG_DATASET = "tsm upload dataset"

# Error texts of uploads, in the order they are tested, with the resulting state.
UPLOAD_ERRORS = (
    ("ERROR [The requested service is not available at the moment.", REUPLOAD),
    ("ERROR [There is not enough quota left to fulfil the operation.", QUOTA),
    ("ERROR [('Connection aborted.', BadStatusLine('',))]", REUPLOAD),
    ("Details: Missing dependency : gfal2]", REUPLOAD),
    ("SSL routines:SSL3_READ_BYTES:sslv3 alert certificate expired]", REUPLOAD),
    ("Details: (_mysql_exceptions.OperationalError) (1040, 'Too many connections')", REUPLOAD),
    ("ERROR ['x-rucio-auth-token']", REUPLOAD),
)
# Error texts of rule creation.
RULE_ERRORS = (
    ("ERROR [Data identifier not found.", NOT_AVAILABLE),
    ("Details: There is insufficient quota", "Failed"),
    ("ERROR [The creation of the replication rule failed at this time. Please try again later.", "Failed"),
    ("ERROR [A duplicate rule for this account, did, rse_expression, copies already exists.", "duplicate"),
)
# Messages of downloads.
DOWNLOAD_ERRORS = (
    ("No such file or directory:", "no_directory"),
    ("has no replicas available on disk endpoints and cannot be downloaded. Please ask for a replication",
     "no_replica"),
    ("WARNING [Provided RSE expression is considered invalid.", "endpoint_ignored"),
    ("Details: (_mysql_exceptions.OperationalError) (1040, 'Too many connections')", "too_many_connections"),
)
DOWNLOAD_OK = "successfully downloaded"
DOWNLOAD_FROM = "successfully downloaded from"
DOWNLOAD_BYTES = "bytes downloaded"
ENDPOINT_MARK = "_USERDISK"
