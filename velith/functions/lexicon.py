"""Word lists, patterns and constants that results depend on."""

from __future__ import annotations

# Fixed values. White space as Python's str methods and patterns understand it; Java's and RE2's own \s is ASCII only.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# The same in Java's notation, which is many times faster there than a list of ranges: white space, other characters, white
# space within a line whose end is \n, ends of lines.
SPACE, NOT_SPACE = r"(?U:[\s\x1c-\x1f])", r"(?U:[^\s\x1c-\x1f])"
LINE_SPACE = r"(?U:[\s\x1f&&[^\n]])"
ANY_LINE_END = r"\R|[\x1c-\x1e]"
OTHER_LINE_END = r"\r\n?|[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"  # those but for \n itself
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))  # the characters of WS

# Fixed values. Headings, tried in this order: label, then the heading's own words where there are any.
SECTION_PATTERNS = (
    rf"^{WS}*(§+{WS}*\d+[a-z]?(?:{WS}*[-–bis]+{WS}*\d+[a-z]?)?){WS}*(.*)$",
    rf"(?i)^{WS}*(Artikel{WS}+\d+[a-z]?){WS}*(.*)$",
    rf"(?i)^{WS}*(Abschnitt{WS}+[IVXLC\d]+){WS}*(.*)$",
    rf"(?i)^{WS}*(Kapitel{WS}+[IVXLC\d]+){WS}*(.*)$",
    rf"^{WS}*(\d+(?:\.\d+)*\.?{WS}+[A-Z][A-Za-z ]{{3,60}}){WS}*$",
)
MAX_HEADING = 120
HEADING_START = "^[§0-9AaKk]"  # the first character of any of them; what starts otherwise needs no further look

# Fixed values. Page furniture.
NOISE_PATTERNS = (
    rf"(?i)^{WS}*-{WS}*Seite{WS}+\d+{WS}+von{WS}+\d+{WS}*-{WS}*$",
    rf"(?i)^{WS}*Ein Service des Bundesministeriums der Justiz.*$",
    rf"(?i)^{WS}*www\.gesetze-im-internet\.de{WS}*$",
    rf"(?i)^{WS}*Seite \d+{WS}*$",
    rf"^{WS}*\d+{WS}*$",
)

# Fixed values. Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ["Abs", "Nr", "lit", "vgl", "bzw", "ggf", "insb", "sog", "z.B", "u.a", "d.h", "Art", "S", "Ziff", "Buchst", "Satz", "Halbs", "evtl", "inkl", "ca", "Nrn", "BGBl", "i.V.m", "i.S.d", "i.d.R", "u.U", "z.T"]
SENTENCE_MARKS = ".!?:;"
SENTENCE_STARTS = "A-ZÄÖÜ§("
CUT = "\uffff"  # stands for a cut while a text is split; no character of Unicode

# Fixed values. Search terms: the section sign, a number with at most one letter, or a run of letters, digits and _.
TERM = r"[§]|[0-9]+[a-z]?|[\p{L}\p{N}_]+"
GERMAN_STOPWORDS = """der die das des dem den ein eine einer eines einem einen und oder aber auch ist sind war waren
wird werden wurde nicht kein keine im in an auf für von zu zum zur mit bei nach aus über unter durch gegen ohne um als
wenn dass so wie nur noch schon sich es er sie man dieser diese""".split()
ENGLISH_STOPWORDS = """the a an and or but is are was were be been of to in on at for with by from as that this these
those it its not no can will would should may if than then so""".split()
STOPWORDS = sorted({*GERMAN_STOPWORDS, *ENGLISH_STOPWORDS})

# Fixed values. Ranking.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K, CANDIDATES, TOP_K, VARIANTS = 60, 20, 5, 3
DENSE_FLOOR, DENSE_BAND, SPARSE_HALF, STRENGTH_SHARE, AGREEMENT_SHARE, REFUSE_BELOW = 0.70, 0.25, 12.0, 0.7, 0.3, 0.30

# Fixed values. Chunking: tokens and overlap of windows; tokens and sentences of packs; tokens, percentile and least sentences of topics.
FIXED_TOKENS, FIXED_OVERLAP = 512, 50
SENTENCE_TOKENS, SENTENCE_OVERLAP = 512, 1
SEMANTIC_TOKENS, SEMANTIC_PERCENTILE, SEMANTIC_SENTENCES = 512, 0.85, 3

# Fixed values. Cuts in characters.
EXCERPT, PREVIEW, CONTEXT, LEAST_CONTEXT, JUDGE_PASSAGE, JUDGE_CONTEXT = 600, 300, 8000, 200, 2500, 6000
CUT_MARK = " […]"
MEMORY_TURNS = 3

# Fixed values. Query rewriting: word forms and what stands for them, in this order; frame words of questions.
SECTION_FORMS = [("paragraf", "§"), ("paragraph", "§"), ("artikel", "art."), ("absatz", "abs."), ("satz", "s.")]
QUESTION_WORDS = r"wie|was|wann|wo|wer|warum|welche[rsn]?|wieviel|what|when|where|who|why|which|how"
FRAME_WORDS = "lange|viel|viele|oft|ist|sind|war|kann|darf|muss|soll|does|do|is|are|can|must|long|many|much"

# Fixed values. Language markers, looked for in the lower-cased text with a blank at either end.
GERMAN_MARKERS = [" der ", " die ", " das ", " den ", " dem ", " des ", " ein ", " eine ", " einer ", " und ", " oder ", " ist ", " sind ", " nicht ", " kein ", " keine ", " wie ", " was ", " wann ", " wo ", " wer ", " warum ", " wieviel", " wie viele ", " welche", " viele ", " muss ", " darf ", " kann ", " soll ", " für ", " bei ", " mit ", " von ", " zu ", " im ", " auf ", " nach ", " über ", " unter ", " stehen ", " mir ", " ich ", " sich ", " lange ", " gilt ", " gibt ", "ä", "ö", "ü", "ß", "§"]
ENGLISH_MARKERS = [" the ", " a ", " an ", " and ", " or ", " is ", " are ", " was ", " were ", " not ", " what ", " when ", " where ", " who ", " why ", " which ", " how ", " many ", " much ", " must ", " may ", " can ", " should ", " for ", " with ", " from ", " to ", " in ", " on ", " under ", " does ", " do ", " i ", " my ", " of "]
GERMAN_LETTERS = ["ä", "ö", "ü", "ß", "§"]

# Fixed values. Answers: phrases of a refusal, and the numbers that brackets which may cite start with.
REFUSALS = ["ich weiß es nicht", "weiss es nicht", "i don't know", "i do not know", "keine information", "nicht genügend", "not contain this information", "insufficient information", "cannot answer", "kann ich nicht beantworten"]
# A number that may cite: the first behind a bracket of at most 120 characters, or one behind a comma where the last one ended.
CITED = rf"(?:\[(?=[^\]\[]{{0,120}}+\])|(?!\A)\G{WS}*,){WS}*(\d+)"
