"""Values that outputs have to share with other tools, as plain text."""

# Labels, separators, identifiers and defaults.
PAGE_HEADER = "PAGE TITLE: "
SECTION_HEADER = "SECTION: "
NO_HEADING = "Page content"
HEADING_JOINT = " > "
CHUNK_JOINT = "\n\n"
PAGE_STRATEGY = "page-aware-v2"
WHOLE_PAGE = "full_page"
PAGE_WINDOW = "page_window"
NO_CATEGORY = "uncategorized"
PENDING = "pending"
COMPLETE = "complete"
ERROR = "error:"
ACTIVE = "ok"
ERROR_CHARS = 500
TOO_SIMILAR = "evaluation question is too similar to its training question"
EMPTY_ANSWER = "empty answer or malformed evidence"

# Budgets and sizes.
LEAST_CHUNK_CHARS = 240
ADJACENT_CHARS = 9_000
PAGE_TOKENS = 24_000
CHARS_PER_TOKEN = 4.0
SIMILARITY = 0.85
BENCHMARK_SIZE = 400
SELECTION_SIZE = 50
