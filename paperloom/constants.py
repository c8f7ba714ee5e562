"""Fixed values of the paper model: page, densities, thresholds, letters and word lists."""

PAGE_WIDTH_IN, PAGE_HEIGHT_IN = 8.2681, 11.6931
SAFETY = 0.97
LINE_LATIN, LINE_DEVANAGARI = 1.18, 1.40
COLUMN_GAP_IN = 0.2
INDENT = {"sub": 0.3, "option": 0.58, "item": 0.3, "pair": 0.3}
COLUMN_IN, WRAPPED_AT = 6.8, 0.5
MAX_TABBED, MAX_OPTION, MAX_RUN, MAX_BARE, MAX_BARE_WORDS = 45, 45, 8, 25, 4
MAX_PAIR, MAX_PAIR_WORDS, MIN_JUMP = 40, 5, 2
SHORT_LETTERS, SHORT_CHARS, SHORT_IN = 14, 30, 2.4
INLINE_COLUMNS, CUT_BREATH_PT, MAX_BLANK_LINES, MAX_FIXES = 5, 10.0, 2, 60
BLANK_LENGTH = 10

#: rung, id, manual only, margins top, bottom and side (in), line, gap lines, gaps before a question, sub-question and header (pt)
DENSITIES = [
    (0, "spacious", True, 0.75, 0.65, 0.75, 1.15, 2, 32.0, 3.0, 10.0),
    (1, "roomy", False, 0.75, 0.65, 0.75, 1.10, 0, 7.0, 2.0, 8.0),
    (2, "normal", False, 0.65, 0.55, 0.65, 1.05, 0, 5.0, 1.0, 6.0),
    (3, "tight", False, 0.55, 0.45, 0.60, 1.00, 0, 4.0, 0.0, 5.0),
    (4, "tighter", False, 0.50, 0.40, 0.55, 0.97, 0, 3.0, 0.0, 4.0),
    (5, "compact", False, 0.45, 0.35, 0.50, 0.93, 0, 2.0, 0.0, 3.0),
    (6, "ultra", False, 0.40, 0.30, 0.45, 0.88, 0, 1.0, 0.0, 2.0),
]
NORMAL = "normal"
DENSITY_COLUMNS = "rung int, density_id string, manual_only boolean, top double, bottom double, side double, line double, gap_lines int, gap_question double, gap_sub double, gap_header double"

ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
HINDI_ITEMS = ["क", "ख", "ग", "घ", "ङ", "च", "छ", "ज"]
HINDI_OPTIONS = ["अ", "ब", "स", "द"]

#: Character widths in hundredths of an em, by class; the rest is 52.
STACKED = "".join(map(chr, [*range(0x900, 0x904), 0x93A, *range(0x941, 0x949), 0x94D, *range(0x951, 0x958), 0x962, 0x963]))
BESIDE = {"ा": 34, "ि": 30, "ी": 34, "ॉ": 34, "ॊ": 34, "ो": 34, "ौ": 40}
DEVANAGARI = "".join(map(chr, range(0x900, 0x980)))
WIDTH_CLASSES = [
    (" \u00a0", 28),
    ("\t", 0),
    (STACKED, 3),
    *[("".join(c for c in BESIDE if BESIDE[c] == w), w) for w in (34, 30, 40)],
    ("".join(c for c in DEVANAGARI if c not in STACKED and c not in BESIDE), 66),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 67),
    ("0123456789", 56),
    (".,;:'`!|()[]", 30),
    ("_-–—", 55),
]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(c for c in DEVANAGARI if c not in STACKED)

TITLE_SMALL = ["of", "the", "and", "for", "in", "to"]
NOT_INITIALS = ["ST", "MT", "DR", "MR", "MS", "JR", "SR", "THE"]
#: Words that take the other article than their first letter says.
A_BEFORE_VOWEL = ["university", "unit", "uniform", "union", "european", "one", "once", "useful", "user"]
AN_BEFORE_CONSONANT = ["hour", "honest", "honour", "honor", "heir"]

#: Words that are never taken for names.
FUNCTION_WORDS = (
    "the a an and or but if then than that this these those of in on at to for from with "
    "is are was were be been being do does did have has had will would shall should can could may might must "
    "who what when where why how which whose whom not no yes it its he she they them his her their our your my "
    "write answer tick fill match complete give choose question class time sub subject academy examination half "
    "yearly correct option following blanks true false word words meaning meanings opposite opposites plural "
    "plurals spellings poem poems statement statements "
    "too many much more most very little less few some any all both each every other another same such "
    "here there now then also only just still even well back down out up off over under again once "
    "first second third next last new old good bad big small long short high low right left "
    "day days time times year years thing things people man men woman women boy boys girl girls "
    "said say says tell tells told make makes made take takes went gone come comes came get gets got "
    "know knows knew think thinks like likes want wants see sees look looks feel feels felt find finds "
    "about after before between during under above because while until since though although however "
    "meaning meanings sentence sentences paragraph essay letter application picture story stories "
    "name names complete choose underline correct incorrect blank blanks column columns following"
).split()

#: id, pattern, replacement, confidence
SUGGESTIONS = [
    ("felt-tired", r"(?i)\bfelt\s+tried\b", "felt tired", "high"),
    ("doctor-advises", r"(?i)\b(doctor|teacher)\s+advice\s+", r"$1 advises ", "high"),
    ("brush-his-teeth", r"(?i)\bbrush\s+is\s+teeth\b", "brush his teeth", "high"),
    ("every-day", r"(?i)\beveryday\b(\s*[.?\[]|\s*$)", r"every day$1", "high"),
    ("did-have", r"(?i)\bdid\s+(he|she|they|it|you|we|i)\s+had\b", r"did $1 have", "high"),
    ("live-under", r"(?i)\bto\s+leave\s+under\b", "to live under", "low"),
    ("true-or-false", r"(?i)\btrue\s+and\s+false\b", "true or false", "high"),
    ("egrets", r"(?i)\btwo\s+greats\s+as\s+friends\b", "two egrets as friends", "low"),
    ("tortoise-was", r"(?i)\bToto\s+was\s+a\s+little\s*$", "Toto was a little", "low"),
]
QUESTION_WORDS = ["who", "what", "when", "where", "why", "how", "which", "whose", "whom"]
#: Hindi ones ask wherever they stand.
HINDI_QUESTION_WORDS = (
    "कौन कौनसा कौनसी कौनसे क्या क्यों कब कहाँ कहां कैसा कैसी कैसे कितना कितनी कितने "
    "किस किसका किसकी किसके किसको किसने किसमें किससे किसे किन किनका किनकी किनके किनको किन्हें किन्होंने"
).split()
