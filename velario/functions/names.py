"""Name columns: word lists, writing style, and names outside the list.

Columns first: spotting list entries, restyling and refusing short names are
expressions. Only the off-list walk, whose number of steps depends on the value,
runs in an Arrow function, once per distinct value of a batch.

The walk treats all unfinished values of a batch at once, in matrices with a row for
each value and a column for each letter. Two neighbouring letters tell by a table
which unit begins with the first, so units are read, and a word that was put together
is held against the shape it must have, without a look at single values.
"""

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from velario.fixed import (CONSONANTS, DIGRAPHS, LIQUID_CLUSTERS, LIQUIDS, MIN_DOMAIN, NASALS,
                           STOPS, VOWELS)
from velario.functions.checksums import strip
from velario.functions.ff1 import MIXED, engine, step_digits

# Pieces by type in index order. Reading prefers the types as listed here.
PIECES = {
    "V": list(VOWELS),
    "GG": [c + c for c in CONSONANTS],
    "CL": list(LIQUID_CLUSTERS),
    "DI": list(DIGRAPHS),
    "NO": [a + b for a in NASALS for b in STOPS],
    "SO": ["S" + b for b in STOPS],
    "LC": [a + b for a in LIQUIDS for b in CONSONANTS],
    "C": list(CONSONANTS),
}
# The alternatives come in reading order, so the leftmost that matches is the unit.
UNIT_PATTERN = (
    f"[{VOWELS}]|" + "|".join(PIECES["GG"]) + "|" + "|".join(LIQUID_CLUSTERS) + "|"
    + "|".join(DIGRAPHS) + f"|[{NASALS}][{STOPS}]|S[{STOPS}]|[{LIQUIDS}][{CONSONANTS}]|[{CONSONANTS}]"
)
# The same by two letters (0 to 25; 26 behind the end): kind of the unit that begins with
# the first, and its place among the pieces of that kind. V comes first, C last.
_KINDS = list(PIECES)
_END, _V, _C = 26, 0, len(_KINDS) - 1
_RADIX = np.array([len(PIECES[k]) for k in _KINDS] + [1], np.int64)      # the last: no unit begins here
_NONE = len(_KINDS)


def _tables():
    kind, place = np.full((27, 27), _NONE, np.int8), np.zeros((27, 27), np.int64)
    spelling = np.full((2, len(_KINDS) + 1, max(_RADIX)), _END, np.uint8)
    for k in reversed(range(len(_KINDS))):                                # earlier kinds win
        for i, piece in enumerate(PIECES[_KINDS[k]]):
            letters = [ord(c) - 65 for c in piece]
            spelling[:len(letters), k, i] = letters
            where = tuple(letters) if len(letters) == 2 else (letters[0], slice(None))
            kind[where], place[where] = k, i
    return kind, place, spelling


_KIND_AT, _PLACE_AT, _SPELLING = _tables()
_IS_VOWEL = np.array([chr(65 + i) in VOWELS for i in range(26)] + [False])

# Letters that become one of A-Z when upper-cased.
_LETTER_CLASS = "A-Za-zıſ"
_CASED_RUN = "[\\p{IsLowercase}\\p{IsUppercase}\\p{Lt}]+|[^\\p{IsLowercase}\\p{IsUppercase}\\p{Lt}]+"


# -- columns ------------------------------------------------------------------
def title(value: Column) -> Column:
    """Capital after every character that is not a cased letter, small otherwise."""
    runs = F.transform(
        F.regexp_extract_all(value, F.lit(_CASED_RUN), F.lit(0)),
        lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(run.substr(F.lit(2), F.length(run)))))
    return F.when(value.rlike("^[A-Za-z ]*$"), F.initcap(value)).otherwise(F.array_join(runs, ""))


def is_canonical(value: Column) -> Column:
    """Written all upper, all lower, or with capitals at the start of words."""
    return (value == F.upper(value)) | (value == F.lower(value)) | (value == title(value))


def restyle(original: Column, entry: Column, entry_title: Column) -> Column:
    """The entry in the writing style of the original."""
    upper, lower = F.upper(original), F.lower(original)
    cased = upper != lower
    return (F.when(cased & (original == upper), F.upper(entry))
            .when(cased & (original == lower), F.lower(entry))
            .otherwise(entry_title))


def letters_of(value: Column) -> Column:
    """The letters A-Z of a value, upper-cased, in order."""
    return F.upper(F.regexp_replace(value, f"[^{_LETTER_CLASS}]", ""))


def units_of(value: Column) -> Column:
    """Pronounceable units of a value."""
    return F.regexp_extract_all(letters_of(value), F.lit(UNIT_PATTERN), F.lit(0))


def unit_kind(unit: Column) -> Column:
    first, second = F.substring(unit, 1, 1), F.substring(unit, 2, 1)
    return (F.when(F.length(unit) == 1, F.when(unit.rlike(f"[{VOWELS}]"), "V").otherwise("C"))
            .when(first == second, "GG")
            .when(unit.isin(list(LIQUID_CLUSTERS)), "CL")
            .when(unit.isin(list(DIGRAPHS)), "DI")
            .when(first.isin(list(NASALS)), "NO")
            .when(first == "S", "SO")
            .otherwise("LC"))


def unit_radix(unit: Column) -> Column:
    kind = unit_kind(unit)
    out = F.lit(len(PIECES["C"]))
    for name in ("LC", "SO", "NO", "DI", "CL", "GG", "V"):
        out = F.when(kind == name, len(PIECES[name])).otherwise(out)
    return out


def off_list_error(value: Column) -> Column:
    """Why an off-list value cannot be treated, or NULL."""
    # Two letters give at least two combinations, so 14 letters always suffice.
    combinations = F.aggregate(
        units_of(value), F.lit(1), lambda acc, unit: F.least(F.lit(MIN_DOMAIN), acc * unit_radix(unit)))
    letters = letters_of(value)
    return (F.when(F.length(letters) == 0, "no_letters")
            .when((F.length(letters) < 14) & (combinations < MIN_DOMAIN), "too_short"))


_COMBINED = "[^\\x00-\\x7F]"


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def collapse(value: Column) -> Column:
    """Upper case, outer white space removed, inner white space single; accents stay."""
    from velario.functions.checksums import _SPACE_CLASS
    return F.regexp_replace(F.upper(strip(value)), _SPACE_CLASS + "+", " ")


def normalise(value: Column) -> Column:
    """``collapse`` in Unicode form NFC; only non-ASCII values leave the JVM."""
    plain = collapse(value)
    composed = _nfc(F.when(plain.rlike(_COMBINED), plain))
    return F.coalesce(composed, plain)


# -- inside tasks -------------------------------------------------------------
_CELLS = 1 << 21             # letters of the values that walk together
_TOGETHER = 100_000          # rows of the batches that walk together


def is_entry(value, entries):
    """A list entry in canonical writing (the twin of the join in ``identifiers``)."""
    upper = value.upper()
    return upper in entries and value in (upper, value.lower(), value.title())


def _following(letters):
    return np.concatenate((letters[:, 1:], np.full((len(letters), 1), _END, np.uint8)), axis=1)


def _doubled_vowels(letters):
    return (letters == _following(letters)) & _IS_VOWEL[letters]


class _Words:
    """Values of like length: their letters, units, and numbers among all words of their shape."""

    def __init__(self, values):
        self.values = values
        self.plain = [v.isascii() and v.isalpha() for v in values]
        self.places = [None if p else [i for i, c in enumerate(v) if len(c.upper()) == 1 and "A" <= c.upper() <= "Z"]
                       for v, p in zip(values, self.plain)]
        words = [v.upper() if p is None else "".join(v[i].upper() for i in p) for v, p in zip(values, self.places)]
        width = max(map(len, words))
        raw = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)
        self.letters = np.where(raw, raw - 65, _END).astype(np.uint8)
        kinds = _KIND_AT[self.letters, _following(self.letters)]
        open_ = np.ones(len(words), bool)
        for i in range(width):                    # a unit of two letters covers the place behind it
            kinds[~open_, i] = _NONE
            own = kinds[:, i]
            open_ = (own == _V) | (own == _C) | (own == _NONE)
        self.kinds, self.radix = kinds, _RADIX[kinds]
        self.doubled = _doubled_vowels(self.letters)
        self.large = np.log10(self.radix).sum(axis=1) > 17.9               # exact numbers need Python's integers
        self.low = np.array([[c.islower() for c in v] + [False] * (width - len(v)) if p else [False] * width
                             for v, p in zip(values, self.plain)], bool).reshape(len(words), width)

    def numbers(self, rows, kind):
        """(number, how many there are) of each word among those of its shape."""
        index, size = np.zeros(len(rows), kind), np.ones(len(rows), kind)
        place = np.where(self.kinds == _NONE, 0, _PLACE_AT[self.letters, _following(self.letters)])[rows]
        for i in range(self.letters.shape[1]):
            radix = self.radix[rows, i].astype(kind)
            index, size = index * radix + place[:, i].astype(kind), size * radix
        return index, size

    def spelled(self, rows, index):
        """The letters of the words with these numbers, and whether they have the shape."""
        kinds, radix = self.kinds[rows], self.radix[rows]
        letters = np.full(kinds.shape, _END, np.uint8)
        for i in reversed(range(kinds.shape[1])):
            r = radix[:, i]
            if (r == 1).all():
                continue
            index, piece = index // r, (index % r).astype(np.int64)
            first, second = _SPELLING[0, kinds[:, i], piece], _SPELLING[1, kinds[:, i], piece]
            begins = kinds[:, i] != _NONE
            letters[begins, i] = first[begins]
            if i + 1 < kinds.shape[1]:
                two = second != _END
                letters[two, i + 1] = second[two]
        same = (kinds == _NONE) | (_KIND_AT[letters, _following(letters)] == kinds)
        return letters, same.all(axis=1) & (_doubled_vowels(letters) == self.doubled[rows]).all(axis=1)

    def written(self, rows, letters):
        """The values with these letters in place of their own, in the same writing."""
        raw = np.where(letters == _END, 0, letters + 65 + 32 * self.low[rows]).astype(np.uint8)
        texts = np.ascontiguousarray(raw).view(f"S{raw.shape[1]}")[:, 0].astype(str).tolist()
        for k, row in enumerate(rows.tolist()):
            if not self.plain[row]:
                out = list(self.values[row])
                for i, letter in zip(self.places[row], texts[k]):
                    out[i] = letter if out[i].isupper() else letter.lower()
                texts[k] = "".join(out)
        return texts


def _steps(ff1, x, digits, tweak, forward):
    short = digits <= MIXED
    if short.all():
        return ff1.permute_mixed(x, digits, tweak, forward)
    out = np.empty_like(x)
    out[short] = ff1.permute_mixed(x[short], digits[short], tweak, forward)
    for n in np.unique(digits[~short]):
        some = digits == n
        out[some] = step_digits(ff1, x[some], int(n), tweak, forward)
    return out


def _walked(ff1, words, rows, kind, entries, tweak, forward, result, limit):
    x, size = words.numbers(rows, kind)
    digits = np.array([max(2, len(str(int(s) - 1))) for s in size])
    for _ in range(limit):
        if not len(rows):
            return
        x = _steps(ff1, x, digits, tweak, forward)
        inside = np.flatnonzero(x < size)
        letters, good = words.spelled(rows[inside], x[inside])
        landed, done = inside[good], np.zeros(len(rows), bool)
        for at, text in zip(landed.tolist(), words.written(rows[landed], letters[good])):
            if not is_entry(text, entries):
                result[rows[at]] = text
                done[at] = True
        rows, x, size, digits = rows[~done], x[~done], size[~done], digits[~done]
    raise RuntimeError("the walk of an off-list name does not end")


def _of_like_length(values):
    """Row numbers of values that walk together: letters times values are bounded."""
    group = []
    for row in sorted(range(len(values)), key=lambda r: len(values[r])):
        if group and (len(group) + 1) * len(values[row]) > _CELLS:
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def walk_off_list(ff1, values, entries, tweak, forward, limit=100_000):
    """Surrogates of off-list values; every round permutes all unfinished ones."""
    out = [None] * len(values)
    for group in _of_like_length(values):
        words, result = _Words([values[r] for r in group]), [None] * len(group)
        for large, kind in ((False, np.int64), (True, object)):
            rows = np.flatnonzero(words.large == large)
            _walked(ff1, words, rows, kind, entries, tweak, forward, result, limit)
        for row, text in zip(group, result):
            out[row] = text
    return out


def off_list_udf(key: bytes, entries: frozenset, tweak: bytes, forward: bool):
    """Arrow function: stripped off-list values to surrogates, NULL to NULL.

    The last few values of a walk take as many rounds as all, so batches walk together.
    """
    def walked(batches):
        codes, distinct = pd.factorize(pd.concat(batches, ignore_index=True))
        found = walk_off_list(engine(key), list(distinct), entries, tweak, forward)
        whole, at = np.array(found + [None], dtype=object)[codes], 0
        for batch in batches:
            yield pd.Series(whole[at:at + len(batch)], dtype=object)
            at += len(batch)

    @F.pandas_udf(StringType())
    def off_list(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, n = [], 0
        for values in series:
            held.append(values)
            n += len(values)
            if n >= _TOGETHER:
                yield from walked(held)
                held, n = [], 0
        if held:
            yield from walked(held)
    # see identifiers.class_permutation
    return off_list.asNondeterministic()
