"""Patterns, word lists and tables that decide what the operators find. All patterns are Java's, Unicode-aware."""

NOTE_START = r"(?U)^\s*(?:[*†‡§¶]|\(?\d{1,3}\)?[.)]?)(?:\s|$)"
ENDNOTE_HEAD = r"(?iuU)^\s*(notes|endnotes|notes to chapter\s*\d*)\s*$"
FOLIO = r"(?U)^[\dIVXLCivxlc\s.\-–—\[\]]+$"
TOP_BAND, BOTTOM_BAND, MIN_REPEATS, MAX_PEELED = 0.14, 0.86, 3, 3

NOTE_SYMBOLS = ("*", "†", "‡", "§", "¶")
NOTE_LABEL = r"(?Us)^\s*(\d{1,3}(?!\d)|[*†‡§¶])[.)]?\s*(.+)$"
MARKER_TEXT = r"(?U)^[*†‡§¶]?\d{0,3}[*†‡§¶]?$"
EMBEDDED_MARKER = r"(?U)(?<=\p{L})(\d{1,3})(?=[\s.,;:)\]\"'”’]|$)"
CONTINUES = r"(?U)^\s*[,;:.)\-]"

DIVISION = (
    r"(?iuU)^\s*(chapters?|parts?|books?|sections?|prologue|epilogue|introduction|preface|appendix(?:es|ices)?|conclusions?|foreword|afterword|abstract|"
    r"summary|bibliography|references|acknowledge?ments?|glossary|index|"
    r"capitolul?|partea|cartea|secţiunea|secțiunea|introducere|prefaţă|prefață|anexa|anexă|concluzii|concluzie|rezumat|bibliografie|referinţe|referințe|glosar|"
    r"chapitre|partie|préface|conclusion|résumé|bibliographie|glossaire|"
    r"kapitel|teil|einleitung|vorwort|schlussfolgerung|zusammenfassung|"
    r"capítulo|parte|introducción|prefacio|conclusión|resumen|bibliografía|"
    r"capitolo|prefazione|conclusione|riepilogo)\b"
)
NUMBERED = r"(?U)^\s*(\d+(?:\.\d+){0,3})\.?\s*\S"
ROMAN_TITLE = r"(?U)^\s*([IVXLC]{1,6})\.\s+\S"
BARE_ROMAN = r"(?U)^\s*[IVXLC]{1,6}\.?\s*$"
BARE_NUMBER = r"(?U)^\s*\d+(?:\.\d+){0,3}\.?\s*$"
DOT_LEADER = r"\.{4,}|…{2,}"
CAPTION = r"(?iuU)^\s*(figure|fig\.?|table|tbl\.?|plate|chart|diagram|scheme|equation|eq\.?|listing|algorithm|map|graph|exhibit|box)\s*\.?\s*\d"
NOTES_HEAD = r"(?iuU)^\s*(notes?|endnotes?|footnotes?)\s*$"
REFERENCES_HEAD = r"(?iuU)^\s*(references?|bibliography|works\s+cited|literature\s+cited|further\s+reading|sources)\s*$"
NOTE_ENTRY = r"(?Us)^\s*(\d{1,3})[.)]?\s+(.*)$"
PRINT_NAV = r"(?iuU)^\s*(contents|table\s+of\s+contents|cuprins|sumar|sommaire|inhalt|tabla\s+de\s+contenido|table\s+des\s+matières)\s*$"
FRONT_LIST = r"(?iuU)^\s*list\s+of\s+(illustrations|maps|tables|figures|plates|abbreviations)\s*$|^\s*(illustrations|maps|tables|figures|plates|contents|table\s+of\s+contents)\s*$"
COPYRIGHT_NAME = r"(?U)©\s*([A-Z][\w.'\-]+(?:\s+[A-Z][\w.'\-]+){0,4})\s*,?\s*(?:19|20)\d{2}"
TOC_KEYWORDS = r"(?iuU)list\s+of\s+(illustrations|maps|tables|figures|plates)|further\s+reading|acknowledgments|\bcontents\b"
SENTENCE_END = (".", "!", "?", '"', "”", "’", "'", ")", ":", ";", "—")
MIN_IMAGE_PX = 80
TOC_PAGE_LIMIT = 25

TOC_HEADING = r"(?iuU)^\s*(contents|table\s+of\s+contents|list\s+of\s+(figures|tables|illustrations|maps)|cuprins|sumar|sommaire|inhalt|tabla\s+de\s+contenido|table\s+des\s+matières)\s*$"
COPYRIGHT_WORD = r"(?iuU)\b(copyright|all rights reserved|isbn)\b"
INDEX_PAGE = r"(?iuU)^\s*index\s*$"
BIBLIOGRAPHY_HEAD = r"(?iuU)^\s*(bibliography|references|works cited|sources)\s*$"

CHAPTER_TITLE = r"(?iuU)^\s*(chapter|part|book)\s+([\divxlc]+)\b\s*[:.\-–]?\s*(.*)$"
NUMBER_TITLE = r"(?U)^\s*(\d+(?:\.\d+){0,3})\.?\s+(\S.*)$"
DINKUS = "· · ·"
LEAD_PUNCTUATION = "“‘\"'("

LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
FRACTIONS = {"1⁄2": "½", "1⁄3": "⅓", "2⁄3": "⅔", "1⁄4": "¼", "3⁄4": "¾", "1⁄8": "⅛", "3⁄8": "⅜", "5⁄8": "⅝", "7⁄8": "⅞"}
BREAK_HYPHENS = "-­‐‑"

LEGIT_LEAD = "„“”\"'‘’«»([{¿¡—–-"
LEGIT_TAIL = ".,;:!?)]}\"'“”‘’«»…—–-­"

IMAGE_MEDIA = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "webp": "image/webp"}
DICTIONARY_FOLDERS = ("/usr/share/hunspell", "/usr/share/myspell", "/usr/local/share/hunspell")
LANGUAGE_CODES = {
    "ron": "ro", "rum": "ro", "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "por": "pt",
    "nld": "nl", "dut": "nl", "pol": "pl", "rus": "ru", "ell": "el", "grc": "el", "ukr": "uk", "hun": "hu", "ces": "cs", "cze": "cs",
}
LOOKUP_FOLD = ("şŞţŢ", "șȘțȚ")
