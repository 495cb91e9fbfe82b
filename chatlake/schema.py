"""Fixed schemas of the stored tables, raw inputs and result records."""

from pyspark.sql import types as T

S, L, I = T.StringType(), T.LongType(), T.IntegerType()

# ---- stored tables -------------------------------------------------------

SESSION = T.StructType([
    T.StructField("id", S, False),
    T.StructField("source", S, False),
    T.StructField("directory", S, False),
    T.StructField("branch", S, True),
    T.StructField("title", S, True),
    T.StructField("parent_id", S, True),
    T.StructField("started_at", L, True),
    T.StructField("last_at", L, True),
    T.StructField("message_count", I, True),
])

MESSAGE = T.StructType([
    T.StructField("session_id", S, False),
    T.StructField("role", S, True),
    T.StructField("content", S, False),
    T.StructField("timestamp_ms", L, True),
    T.StructField("position", I, False),
    T.StructField("model", S, True),
    T.StructField("output_tokens", L, True),
    T.StructField("cache_read", L, True),
    T.StructField("cache_write", L, True),
])

MANIFEST = T.StructType([
    T.StructField("path", S, False),
    T.StructField("source", S, False),
    T.StructField("mtime_ms", L, False),
    T.StructField("indexed_at", T.TimestampType(), True),
])

# ---- what the store keeps beside them ---------------------------------------

_AT = T.StructType([T.StructField("no_ts", T.BooleanType()), T.StructField("ts", S)])
# per session, so that a later drop can go on where the earlier ones ended: its
# number of messages, the place of the last one, of the title's and of the branch's,
# and the file that names the directory
SESSION_STATE = T.StructType([
    T.StructField("n", L), T.StructField("last", _AT), T.StructField("title", _AT), T.StructField("branch", _AT),
    T.StructField("file", T.StructType([T.StructField("mtime_ms", L), T.StructField("path", S)])),
])
STORED_SESSION = T.StructType([*SESSION.fields, T.StructField("state", SESSION_STATE)])
SESSION_FILE = T.StructType([T.StructField("session_id", S), T.StructField("path", S)])
TOKENS = ["output_tokens", "cache_read", "cache_write"]
SESSION_USAGE = T.StructType([T.StructField("session_id", S), T.StructField("model", S), T.StructField("turns", L),
                              *[T.StructField(c, T.DecimalType(38, 0)) for c in TOKENS]])
SESSION_DAY = T.StructType([T.StructField("session_id", S), T.StructField("day", S), T.StructField("user_msgs", L),
                            T.StructField("asst_turns", L)])
USAGE = T.StructType([T.StructField("source", S), T.StructField("directory", S), *SESSION_USAGE.fields[1:]])
DAILY = T.StructType([T.StructField("source", S), T.StructField("directory", S), T.StructField("day", S),
                      T.StructField("sessions", L), *SESSION_DAY.fields[2:]])
POSTING = T.StructType([T.StructField("trigram", S), T.StructField("session_id", S)])

SESSION_COLS = [f.name for f in SESSION.fields]
MESSAGE_COLS = [f.name for f in MESSAGE.fields]
MANIFEST_COLS = [f.name for f in MANIFEST.fields]

# ---- raw transcript line (JSON) -----------------------------------------
# Only the paths the index reads.  ``content`` and the token counts are read
# as strings: content may be an array of blocks (kept as JSON text, then
# dropped by the usable-text rule) and tokens may be fractional or junk.

TRANSCRIPT_LINE = T.StructType([
    T.StructField("type", S),
    T.StructField("sessionId", S),
    T.StructField("timestamp", S),
    T.StructField("gitBranch", S),
    T.StructField("message", T.StructType([
        T.StructField("role", S),
        T.StructField("content", S),
        T.StructField("model", S),
        T.StructField("usage", T.StructType([
            T.StructField("output_tokens", S),
            T.StructField("cache_read_input_tokens", S),
            T.StructField("cache_creation_input_tokens", S),
        ])),
    ])),
])

# Parsed raw row (SRC2 output).
RAW_ROW = T.StructType([
    T.StructField("path", S), T.StructField("line_no", L),
    T.StructField("msg_type", S), T.StructField("session_id", S),
    T.StructField("ts", S), T.StructField("branch", S),
    T.StructField("role", S), T.StructField("content", S),
    T.StructField("model", S), T.StructField("output_tokens", L),
    T.StructField("cache_read", L), T.StructField("cache_write", L),
])
