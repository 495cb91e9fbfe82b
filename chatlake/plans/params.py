"""Parameters of the registered test queries (shared by the Spark plans and
their SQL oracles so both sides ask the same question)."""

from chatlake.sources.driver_views import EPOCH_BASE_MS, MS_PER_CONVERSATION

KW_ONE = ["tion"]
KW_MULTI = ["schst", "É", "a_c"]          # non-ASCII fold and a `_` wildcard
KW_SCOPED = ["the", "nicht"]
SCOPE = ["/work/team1/proj1"]             # also a prefix of /work/team1/proj11 (S16)
SOURCE = "claude-code"
SINCE_MS = EPOCH_BASE_MS + 30 * MS_PER_CONVERSATION
SEARCH_LIMIT = 20
LIST_LIMIT = 50
NOW_MS = EPOCH_BASE_MS + 400 * 86_400_000  # injected "now" for ages
FILE_NEEDLE = "nicht"
CONTEXT_KW = ["schst"]
CONTEXT_RADIUS = 2
READ_PREFIX = "conv-" + "0" * 18 + "4"        # ids 40 to 49
READ_FROM, READ_TO = 1, 5
AROUND_PREFIX = "conv-" + "0" * 18 + "1"
AROUND_AT, AROUND_RADIUS, AROUND_ROLE = 3, 2, "assistant"
SKIM_HEAD, SKIM_TAIL = 3, 3
PREVIEW_HEAD, PREVIEW_TAIL, PREVIEW_MAX_LINES = 2, 5, 8
LAST_DAYS = 14
CHANGE_TOLERANCE_MS = 1000
STORE_BUCKETS = 8
CHANGED_SLUG = "-work-team1-proj1"        # the project whose files are replaced
STORE_KW = ["V2: ", "schst"]              # searched through the postings
STREAM_CUTS = (2, 5)                      # turns at which a session goes on in the next drop
STREAM_FILES = 20                         # files of a micro-batch
REMOVED_SCOPE = ["slug=/work/team2", "/work/team0/proj0"]
OWNER_PREFIX_LEN = 24                     # all but the last digit: a prefix spans ten sessions
FILTER_TEXT = "proj1"                      # FLT14 over the flat list
PROJECT_FILTER_TEXT = "nicht"             # FLT15 matches via session titles
PER_PROJECT_K = 3
BIDI_SCOPE = ["/work/team2", "/work/team3/proj13/src"]   # below and above stored directories
