"""The patterns, word lists and thresholds that results depend on, for Java's regular expressions.

``(?iu)`` ignores case beyond ASCII and ``(?U)`` makes \\w, \\s, \\d and \\b cover Unicode, as names need.
"""

URL = r"(?iuU)(?:https?://\S+)|(?:www\.\S+)|(?:\b[\w-]+\.(?:com|net|org|io|co|info|biz|tv|me|cc|us|uk|ca|au)(?:/\S*)?)"
SCAN_GROUP = r"(?iuU)\b[\w-]*scans?\b|\b[\w-]*scanners?\b|\b[\w-]*scanlations?\b"
TRAILING_SLASH = r"(?U)[\s/]+$"
G_CODE = r"(?U)[\s\-]*\bG\d{3,5}$"
NOT_ALLOWED = r"[^\x{0000}-\x{024F}\x{0370}-\x{03FF}\x{2000}-\x{206F}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F300}-\x{1FAFF}]+"
BRACKETS = r"\[[^\]]*\]|\([^)]*\)"
STRAY_BRACKETS = r"[\[\]()]"
SPACES = r" {2,}"
EDGE_SPACE = r"(?U)^\s+|\s+$"

LEADING_HASH = r"(?U)^#+\s*"
TRAILING_HASH = r"(?U)\s*#+$"
TRAILING_STUB = r"(?iuU)[\s_\-]*(?:part|v|ch(?:ap(?:ter)?)?)\s*$"
TRAILING_STUB_STRICT = r"(?iuU)[\s_\-]+(?:part|v|ch(?:ap(?:ter)?)?)\s*$"
LEADING_NUMBER = {"batch": r"(?iuU)^(?:\d+\s+v\d+\s+|\d+\s*[-_]\s*)", "live": r"(?iuU)^\d+\s*-\s*"}
TRAILING_JUNK = r"(?U)[\s\-_\x{2013}\x{2014}]+$"

GENERIC = {
    "batch": r"(?iuU)manga_chapter|^#\s*english|^#\s*chapter|^chapter|^part\s+\d+|^doujinshi[\s_]chapter|^unknown[\s_]chapter",
    "live": r"(?iuU)manga[\s_]chapter|#\s*english|^chapter|^part\s+\d+|doujinshi[\s_]chapter|official[\s_]chapter|unknown[\s_]chapter",
}
GIBBERISH = r"(?iu)^(?:TEMP[\s_-]*[0-9a-f]{8,}|[0-9a-f]{16,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"
GENERIC_STEM = r"(?iuU)^(?:ch(?:ap(?:ter)?)?p?\.?\s*\d[\d.]*|ep(?:isode)?\.?\s*\d[\d.]*|issue\s*\d[\d.]*|vol(?:ume)?\.?\s*\d[\d.]*|#\s*\d[\d.]*|\d{1,4}[\d.]*|chapter$|episode$)$"

UNKNOWN_CHAPTER = r"(?iuU)^unknown[\s_]chapter[\s_]*(\d[\d.]*)(.*?)$"
HASH_CHAPTER = r"(?iuU)^#\s*chapter\s*(\d[\d.]*)(.*?)$"
CHAPTER_ONLY = r"(?iuU)^(?:ch(?:ap(?:ter)?)?\.?\s*|chp\.?\s*)(\d[\d.]*)"
NUMBERED_CHAPTER = r"(?iuU)^(?:\d+\.\s*ch(?:ap(?:ter)?)?p?\.?\s*-?\s*|ch(?:ap(?:ter)?)?p?\.?\s*-\s*)(\d[\d.]*)\s*$"
GENERIC_CHAPTER = (
    r"(?iuU)^(?:(?:(?:doujinshi|official|manga|unknown)[\s_]+)(?:#\s*(?:english[\s_]+)?)?(?:ch(?:ap(?:ter)?)?p?\.?\s*|part\.?\s*)"
    r"|#\s*(?:english[\s_]+)?(?:ch(?:ap(?:ter)?)?p?\.?\s*)?|(?:chapter|part)\.?\s+)(\d[\d.]*)(.*?)$"
)

CHAPTER = r"(?iuU)(?:ch(?:ap(?:ter)?)?p?\.?\s*|issue\s*|ep(?:isode)?\.?\s*|#\s*)(\d[\d.]*)"
VOLUME = r"(?iuU)(?:vol(?:ume)?\.?\s*|v(?=\d[\d.]*(?:\s|ch|ep|$)))(\d[\d.]*)"
GAP_NUMBER = r"(?iuU)(?:ch(?:ap(?:ter)?)?p?\.?\s*(\d[\d.]*)|issue\s*(\d[\d.]*)|#\s*(\d[\d.]*)|[^\d](\d{1,4}(?:\.\d+)?)\s*$)"
RANGE = r"(?iuU)ch(?:ap(?:ter)?)?p?\.?\s*(\d[\d.]*)\s*[-–—]\s*(\d[\d.]*)"
CHAPTER_TOKEN_ONCE = r"(?isuU)^(.*?ch(?:ap(?:ter)?)?p?\.?\s*)(\d[\d.]*)"
NUMBER_TOKEN = r"(?iU)((?:ch(?:ap(?:ter)?)?p?|issue|ep(?:isode)?|vol(?:ume)?|v(?=\d))\.?\s*)(\d[\d.]*)"
TRAILING_TOKEN = (
    r"(?iuU)[\s_\-]*(?:ch(?:ap(?:ter)?)?p?\.?\s*\d[\d.]*|issue\s*\d[\d.]*|ep(?:isode)?\.?\s*\d[\d.]*|vol(?:ume)?\.?\s*\d[\d.]*"
    r"|v\d[\d.]*(?=\s*$)|\d+$)[\s_\-.,]*$"
)
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'

DEDUP_DROP = r"(?U)[\s\-_.,!?'\"]+"
PUNCTUATION = r"(?U)[^\w\s]"
MARKER = r"(?iuU)\b(uncensored|decensored)\b"

#: Label words that may stand before a repeated number, for Python's expressions.
LABEL = r"(?:ver(?:sion)?|v|ch(?:ap(?:ter)?)?|episode|ep|vol(?:ume)?|part|pt)"

RULES = frozenset({"url", "scan_groups", "non_latin", "brackets", "leading_nums", "trailing_junk", "number_tokens", "normalize_stem", "comicinfo"})
IMAGE_EXTENSIONS = {"ranges": (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".tiff", ".tif"), "dedup": (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".tiff", ".tif", ".avif")}
REPORT_RATIO, AUTO_RATIO = 0.80, 0.90
SETTLE_SECONDS, MIN_AGE_SECONDS, POLL_SECONDS = 5, 300, 2
STABLE_POLLS, MAX_POLLS = 3, 30

TEMPLATE = """<ComicInfo
  xmlns:xsd="http://www.w3.org/2001/XMLSchema"
  xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">
  <Title></Title>
  <Series></Series>
  <Number></Number>
  <Summary></Summary>
  <Writer></Writer>
  <Penciller></Penciller>
  <Genre></Genre>
  <Web></Web>
  <ty:PublishingStatusTachiyomi xmlns:ty="http://www.w3.org/2001/XMLSchema"></ty:PublishingStatusTachiyomi>
  <ty:Categories xmlns:ty="http://www.w3.org/2001/XMLSchema"></ty:Categories>
  <mh:SourceMihon xmlns:mh="http://www.w3.org/2001/XMLSchema">Komga</mh:SourceMihon>
</ComicInfo>"""

#: For archives of merged series.
SHORT_TEMPLATE = """<ComicInfo
  xmlns:xsd="http://www.w3.org/2001/XMLSchema"
  xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">
  <Title></Title>
  <Series></Series>
  <Number></Number>
</ComicInfo>"""
