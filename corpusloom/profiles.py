"""Language profiles: the character classes that text operators work with, as regex fragments.

Fragments stand inside square brackets and are written so that Java and RE2 read them alike.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Indic blocks and others, as ranges of code points.
DEVANAGARI, BENGALI, GURMUKHI, GUJARATI = r"\x{0900}-\x{097F}", r"\x{0980}-\x{09FF}", r"\x{0A00}-\x{0A7F}", r"\x{0A80}-\x{0AFF}"
ODIA, TAMIL, TELUGU_BLOCK, KANNADA = r"\x{0B00}-\x{0B7F}", r"\x{0B80}-\x{0BFF}", r"\x{0C00}-\x{0C7F}", r"\x{0C80}-\x{0CFF}"
MALAYALAM, PRIVATE, SPECIALS = r"\x{0D00}-\x{0D7F}", r"\x{E000}-\x{F8FF}", r"\x{FFF0}-\x{FFFF}"
#: Thai, Tibetan, Burmese, Georgian, Hangul, kana, CJK, Greek, Cyrillic, Armenian, Hebrew, Arabic, tags.
FAR_SCRIPTS = (
    r"\x{0E00}-\x{0E7F}\x{0F00}-\x{0FFF}\x{1000}-\x{109F}\x{10A0}-\x{10FF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}"
    r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{0370}-\x{03FF}\x{0400}-\x{04FF}\x{0530}-\x{058F}\x{0590}-\x{05FF}"
    r"\x{0600}-\x{06FF}\x{E0000}-\x{E07FF}"
)
_SOUTH = BENGALI + GURMUKHI + GUJARATI + ODIA + TAMIL + KANNADA + MALAYALAM
#: Pictographs, arrows, boxes, symbols, CJK punctuation and compatibility, selectors, half widths, joiner.
WIDE_EMOJI = (
    r"\x{1F000}-\x{1FAFF}\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}\x{2100}-\x{214F}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2460}-\x{24FF}"
    r"\x{2500}-\x{25FF}\x{2800}-\x{28FF}\x{2B00}-\x{2BFF}\x{3000}-\x{303F}\x{3200}-\x{33FF}\x{FE00}-\x{FE0F}\x{FF00}-\x{FFEE}\x{200D}"
)
NARROW_EMOJI = r"\x{1F300}-\x{1FAFF}\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}\x{1F000}-\x{1F0FF}\x{2190}-\x{21FF}\x{FE0F}\x{200D}"
#: Fixed value: punctuation taken off a word's ends before it is classed.
EDGE = r""".,!?;:"'()\[\]"""


@dataclass(frozen=True)
class LangProfile:
    name: str
    block: str  # letters and marks of the language
    base: str  # letters that can stand alone
    dependent: str  # marks that cannot begin a word; empty: none
    virama: str  # a mark that cannot end a word; empty: none
    digits: str  # digits of clean numbers
    own_digits: str  # digits that make a token with symbols noise
    junk: str  # scripts that have no business here
    edge: str
    emoji: str
    mixed_is_noise: bool = True  # a word of this script and Latin letters is noise
    brackets: str = ""  # consonants before which a stray bracket is a misread ligature
    answer_marker: str = ""
    question_tag: str = ""


TELUGU = LangProfile(
    "telugu", TELUGU_BLOCK, r"\x{0C05}-\x{0C39}\x{0C58}-\x{0C5A}\x{0C60}\x{0C61}", r"\x{0C3E}-\x{0C56}\x{0C62}\x{0C63}", "్",
    # Devanagari digits, as the corpus was made with; Telugu digits are in own_digits alone.
    r"0-9\x{0966}-\x{096F}", r"0-9\x{0C66}-\x{0C6F}", DEVANAGARI + _SOUTH + FAR_SCRIPTS + PRIVATE + SPECIALS, EDGE, WIDE_EMOJI,
    brackets=r"\x{0C15}-\x{0C39}", answer_marker="సమాధానం", question_tag="ప్రశ్న:",
)
NEPALI = LangProfile(
    "nepali", DEVANAGARI, r"\x{0905}-\x{0939}\x{0958}-\x{095F}\x{0960}\x{0961}", r"\x{093E}-\x{094C}\x{094E}\x{094F}\x{0955}-\x{0957}\x{0962}\x{0963}", "्",
    r"0-9\x{0966}-\x{096F}", r"0-9\x{0966}-\x{096F}", _SOUTH + TELUGU_BLOCK + PRIVATE + SPECIALS, EDGE + r"\x{0964}\x{0965}", NARROW_EMOJI,
    answer_marker="उत्तर", question_tag="प्रश्न:",
)
LATIN = LangProfile(
    "latin", "A-Za-zÀ-ÖØ-öø-ÿŒœ", "A-Za-zÀ-ÖØ-öø-ÿŒœ", "", "", "0-9", "0-9", DEVANAGARI + _SOUTH + TELUGU_BLOCK + FAR_SCRIPTS + PRIVATE + SPECIALS,
    EDGE, WIDE_EMOJI, mixed_is_noise=False, answer_marker="Answer", question_tag="Question:",
)
PROFILES = {p.name: p for p in (TELUGU, NEPALI, LATIN)}
