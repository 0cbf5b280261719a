"""They must equal the published formats for results to agree."""

# -- fixed values: alphabets and check tables of the identifier formats ------
DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Month letters of the Italian tax code, January to December.
MONTH_LETTERS = "ABCDEHLMPRST"

# Weight of each character of the tax code in the 1st, 3rd, 5th ... position.
TAX_CODE_ODD_WEIGHTS = {
    "0": 1, "1": 0, "2": 5, "3": 7, "4": 9, "5": 13, "6": 15, "7": 17, "8": 19, "9": 21,
    "A": 1, "B": 0, "C": 5, "D": 7, "E": 9, "F": 13, "G": 15, "H": 17, "I": 19, "J": 21,
    "K": 2, "L": 4, "M": 18, "N": 20, "O": 11, "P": 3, "Q": 6, "R": 8, "S": 12, "T": 14,
    "U": 16, "V": 10, "W": 22, "X": 25, "Y": 24, "Z": 23,
}

# Years x months x days x sexes, and cadastral letter x three digits.
DATE_DOMAIN = 100 * 12 * 31 * 2
PLACE_DOMAIN = 26 * 1000

# -- fixed values: pronounceable units of off-list names ---------------------
VOWELS = "AEIOU"
CONSONANTS = "BCDFGHJKLMNPQRSTVWXYZ"
LIQUID_CLUSTERS = ("BL", "BR", "CL", "CR", "DR", "FL", "FR", "GL", "GR", "PL", "PR", "TR", "VR")
DIGRAPHS = ("CH", "GH")
NASALS = "MN"
LIQUIDS = "LR"
STOPS = "BCDGPT"

# Smallest domain that may be permuted, of a field and of a word list.
MIN_DOMAIN = 100

# Version of the off-list treatment; stored with a list's fingerprint.
FALLBACK_VERSION = 3

# -- fixed values: column-type detection -------------------------------------
DETECTION_SHARE = 0.9
DETECTION_MIN_VALUES = 4

# -- fixed values: words of the policy and registry documents ----------------
TYPES = ("CF", "COGNOME", "IBAN", "NOME", "PIVA")
DETECTION_ORDER = ("CF", "IBAN", "PIVA", "NOME", "COGNOME")
LIST_TYPES = {"NOME": "nomi", "COGNOME": "cognomi"}
ENCRYPT, KEEP, NULLIFY = "cifra", "mantieni", "azzera"
STRATEGIES = (ENCRYPT, KEEP, NULLIFY)
DECRYPT = "decifra"
CLEAR, ENCRYPTED, NULLIFIED, RUNNING = "in_chiaro", "cifrata", "azzerata", "in_corso"
STATES = (CLEAR, ENCRYPTED, NULLIFIED, RUNNING)
ERROR, WARNING = "errore", "avviso"
HISTORY_LENGTH = 20

# Characters that Unicode counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
