"""Regular expressions of the message domain, in the Java dialect Spark uses.

Character classes are spelled out instead of relying on ``\\w``, ``\\d`` and ``\\s``:
Java reads those as ASCII, the intended meaning is Unicode. Repeated groups are
possessive and run starts are guarded by look-behind, which keeps every match linear
in the length of the text and off the Java call stack, so one huge or hostile message
cannot stall or crash a task. ASCII members of a class are listed one by one, because the
Java engine then tests them with one table look-up instead of a chain of range checks.
"""

from collections.abc import Iterable
from string import ascii_letters, digits


def ranges(codes: Iterable[int]) -> str:
    """Rising code points as the ranges of a character class."""
    found: list[list[int]] = []
    for c in codes:
        if found and c == found[-1][1] + 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in found)


# Building blocks.
SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\p{Z}"
ASCII_WORD = ascii_letters + digits + "_"
WORD = ASCII_WORD + r"\p{L}\p{N}"
DIGIT = r"\p{Nd}"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# What counts as a link, an address, a phone number, money, a number, an emoji.
BARE_DOMAIN_ENDINGS = "com|org|net|edu|gov|io|co|uk|in|ai|app|dev|xyz"
CURRENCY_SIGNS = "$£€₹¥"
CURRENCY_WORDS = r"dollars?|pounds?|euros?|rupees?|rs\.?|usd|gbp|eur|inr"
# The emoji blocks as their union; the second range takes in CJK, kana and Hangul, as intended.
EMOJI_RANGES = (
    r"\x{24C2}-\x{1F251}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}"
)
KEPT_SIGNS = r".,!?;:'\"\-"
KEPT_INK = ascii_letters + digits + KEPT_SIGNS

ANY_DIGIT = DIGIT
NON_ASCII = r"[^\x00-\x7F]"
# Blocks whose characters are looked at one by one for what folding makes of them: Latin, punctuation, currency.
FOLD_BLOCKS = ((0x80, 0x24F), (0x2010, 0x205E), (0x20A0, 0x20C0))
HTML_TAG = r"<[^>]++>"

_link_body = rf"[^{SPACE}<>\"')\]]*+"
URL = (
    rf"(?iu:https?://|ftp://|www\.){_link_body}"
    rf"|(?<![{WORD}.\-])[{WORD}.\-]+\.(?iu:{BARE_DOMAIN_ENDINGS}){_link_body}"
)
# Every link has one of these, few other texts do.
URL_MARK = "://"
URL_DOT = rf"\.(?:(?<=[wW]\.)|(?iu:{BARE_DOMAIN_ENDINGS}))"

# Letters that equal an ASCII letter when case is ignored belong to an address, too.
_letter = ascii_letters + r"\x{130}\x{131}\x{17F}\x{212A}"
_local = _letter + digits + r"._%+\-"
# \G lets a second address begin inside a run whose first part was just matched.
EMAIL = rf"(?:\G|(?<![{_local}]))[{_local}]++@[{_letter}{digits}.\-]+\.[{_letter}]{{2,}}+"

PHONE = (
    rf"(?:\+?{DIGIT}{{1,3}}[-.{SPACE}]?)?"
    rf"(?:\(?{DIGIT}{{1,4}}\)?[-.{SPACE}]?)?"
    rf"{DIGIT}{{3,4}}[-.{SPACE}]?{DIGIT}{{3,4}}"
)

EMOJI = rf"[{EMOJI_RANGES}]+"

CURRENCY = (
    rf"[{CURRENCY_SIGNS}][{SPACE}]?{DIGIT}++(?:[.,]{DIGIT}++)*+"
    rf"|(?<!{DIGIT})(?<!{DIGIT}[.,]){DIGIT}++(?:[.,]{DIGIT}++)*+[{SPACE}]?(?iu:{CURRENCY_WORDS})"
)

NUMBER = rf"(?<![{WORD}]){DIGIT}++(?![{WORD}])(?:[.,]{DIGIT}++(?![{WORD}]))*+"

SPECIAL = rf"[^{KEPT_INK}{SPACE}]"
# Both steps in one: every run that is neither kept sign nor one plain space.
SPECIAL_OR_SPACES = rf"[^{KEPT_INK}]{{2,}}+|[^{KEPT_INK}\x20]"
REPEATED = r"(?d)(.)\1{2,}+"
SPACES = rf"[{SPACE}]+"
EDGE_SPACES = rf"^[{SPACE}]+|[{SPACE}]+$"

WORD_TOKEN = rf"[{WORD}]++(?:'[{WORD}]++)?"
FEATURE_TOKEN = rf"[{WORD}]{{2,}}+"
NON_WORD = rf"[^{WORD}]+"
