"""Regular expressions shared by the text functions.

Character classes are spelled out because ``\\s`` and ``\\w`` are ASCII-only in Java while the
wanted semantics are Unicode.
"""

# The code points Unicode-aware splitting treats as white space.
WS = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
NON_WS = f"[^{WS}]"
WORD_CHAR = r"[\p{L}\p{N}_]"

PIECE = NON_WS + "+"
MENTION = "@" + NON_WS + "+"
HASHTAG = "#" + NON_WS + "+"
URL = "https?://" + NON_WS + "+"
URL_ANY_CASE = "(?i)" + URL
CAPITAL = "[A-Z]"
TAG = "<[^>]+>"
RETWEET = r"(?i)(?<![\p{L}\p{N}_])RT(?![\p{L}\p{N}_])"
NOT_ALNUM = f"[^a-zA-Z0-9{WS}]"
SPACES = f"[{WS}]+"
MENTION_WORD = "@" + WORD_CHAR + "+"
HASHTAG_WORD = "#" + WORD_CHAR + "+"
EDGE_SPACES = f"^[{WS}]+|[{WS}]+$"

# Pictograph ranges removed from text (the last range also covers CJK and Hangul).
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)

TOKEN_2PLUS = WORD_CHAR + "{2,}"
TOKEN_1PLUS = WORD_CHAR + "+"
ASCII_ONLY = r"^[\x00-\x7F]*$"

# --- forms for the Java engine only: same meaning, cheaper to match ------------------------------

# Code points of WS as characters, for trimming from both ends without a regular expression.
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# One wide range rules out letters before the exact class is consulted.
SPACE_RUN = f"[\\x09-\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}-\\x{{3000}}&&[{WS}]]+"
_SYMBOL = r"[!-/:-@\[-`{-\x{10FFFF}\x00-\x1F]"
_SEPARATOR = r"[\x00-/:-@\[-`{-\x{10FFFF}]"
# Runs of separators that are not already one plain space.
SEPARATOR_RUN = f" ?{_SYMBOL}{_SEPARATOR}*+|  {_SEPARATOR}*+"
