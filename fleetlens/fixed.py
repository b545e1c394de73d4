"""Fixed values.

These strings and numbers must equal those of the experiment-runner whose
configs, commands and file layout fleetlens reads and reproduces; they are the
compatibility contract, so they are stated once, here, as plain text.
"""

# ---- fixed values: object and runner type names in spec files -------------
CAPTURE_TYPE = "tshark"
TRANSMIT_TYPE = "srt-xtransmit"
LOCAL_RUNNER = "local-runner"
REMOTE_RUNNER = "remote-runner"

# ---- fixed values: transmit application roles and their subcommands --------
ROLE_SENDER = "snd"
ROLE_RECEIVER = "rcv"
ROLE_FORWARDER = "fwd"
SUBCOMMANDS = {"snd": "generate", "rcv": "receive"}

# ---- fixed values: command formats -----------------------------------------
URI_SCHEME = "srt://"
CAPTURE_FILTER_PREFIX = "udp port "
CAPTURE_SNAPLEN = 1500
CAPTURE_FLAGS = ("-i", "-f", "-s", "-w")

# ---- fixed values: artifact options and collected layout -------------------
STATS_OPTION = "--statsfile"
METRICS_OPTION = "--metricsfile"
LOCAL_ORIGIN = "local"
DEFAULT_RESULTS_PATH = "."

# ---- fixed values: waits, in seconds ---------------------------------------
PROBE_WAIT_LOCAL_S = 5
PROBE_WAIT_REMOTE_S = 11
TERMINATE_WAIT_S = 3
KILL_WAIT_S = 1
MAX_STOP_ATTEMPTS = 2

# ---- fixed values: text rendering -------------------------------------------
NULL_TEXT = "None"
PARAM_SEPARATOR = "&"

# ---- fixed values: status words ---------------------------------------------
STATUS_IDLE = "idle"
STATUS_RUNNING = "running"
