"""Limits, alphabets and names the results depend on."""

# --- fixed values -----------------------------------------------------------
MAX_FILE_BYTES = 2_000_000      # larger files are not indexed
BINARY_SNIFF_BYTES = 8192       # a NUL byte in this prefix marks a binary file
CANDIDATE_LIMIT = 2000          # the classic candidate cap (opt-in, see plans.search)
HITS_PER_FILE = 50              # matching lines kept per file
MAX_RESULTS = 300               # default number of hits
MAX_RANGES = 201                # highlighted spans kept per line
DEBOUNCE = "800 milliseconds"   # quiet period that closes a batch of changes
CHANGE_KINDS = ("create", "modify", "remove")

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
# The two characters outside ASCII whose Unicode case folding is an ASCII letter.
FOLDING_TO_ASCII = {"K": "k", "ſ": "s"}

UTF8 = "utf-8"
SHIFT_JIS = "shift_jis"
EUC_JP = "euc-jp"
ENCODING_ALIASES = {
    SHIFT_JIS: ("shift_jis", "sjis", "cp932"),
    EUC_JP: ("euc-jp", "eucjp", "euc_jp"),
}
JAVA_CHARSETS = {SHIFT_JIS: "windows-31j", EUC_JP: "EUC-JP"}
# ----------------------------------------------------------------------------

# Sizes that steer how work is laid out; none of them changes a result.
BROADCAST_ROWS = 200_000        # a side is broadcast only when its row bound is below this
BROADCAST_BYTES = 64 * 1024 * 1024      # ... and its texts are below this
EARLY_STOP_DOCS = 1_000_000     # from so many documents on, limited searches verify in growing batches
EARLY_STOP_STEP = 1_000         # candidates of the first batch
FOLD_RATIO = 4                  # a segment is folded with smaller ones that hold a share of this at least
RETIRED_SHARE = 0.2             # an index with more retired documents than this share is folded
LOOKUP_ROWS = 2_000             # up to this many documents are fetched by number
LOOKUP_MOST = 8_000             # ... and so many of the best candidates of a limited search
LOOKUP_SHARE = 0.01             # ... and only for at most this share of the index
LOOKUP_STEP = 100               # documents per scan of such a fetch; see inFilterThreshold
DOCS_PER_FILE = 1_000_000       # documents in one file of the document table
PART_BITS = 4                   # 2**4 build tasks share a folder of documents
PREFILTER_GRAMS = 6             # the rarest grams read when only a prefilter is needed
POSTINGS_PER_BUCKET = 1_000_000
PATHS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 4096
BLOCK_BITS = 16                 # a posting list covers at most 2**16 documents
SEGMENT_TASKS = 4096            # input partitions that make up one segment of a build
SMALL_SPLIT_BYTES = 16 * 1024 * 1024    # a source below this per core is spread over the cores
