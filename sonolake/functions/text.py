"""Transcript text rules as column expressions; numbers and full Unicode folding run as Arrow-batched functions on rows that need them."""

from __future__ import annotations

from collections.abc import Callable

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolake.functions import numbers
from sonolake.functions.parts import by_parts, only_where

# Abbreviations with a full stop and what they stand for, in the order in which they are tried.
ABBREVIATIONS = (
    ("mrs", "missus"), ("mr", "mister"), ("dr", "doctor"), ("st", "saint"), ("co", "company"), ("jr", "junior"), ("maj", "major"),
    ("gen", "general"), ("drs", "doctors"), ("rev", "reverend"), ("lt", "lieutenant"), ("hon", "honorable"), ("sgt", "sergeant"),
    ("capt", "captain"), ("esq", "esquire"), ("ltd", "limited"), ("col", "colonel"), ("ft", "fort"),
)
# Symbols and their words.
SYMBOLS = (("&", " and "), ("+", " plus "), ("%", " percent "), ("@", " at "), (":", " "))
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Letters that decomposition leaves whole.
LETTERS = (("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss"), ("ẞ", "SS"), ("đ", "d"), ("Đ", "D"), ("ð", "d"), ("Ð", "D"), ("þ", "th"), ("Þ", "th"), ("ł", "l"), ("Ł", "L"))
FOLDS = str.maketrans(dict(LETTERS))
# Standardisation of English, patterns and replacements in the order in which they apply.
FILLERS = r"\b(hmm|mm|mhm|mmm|uh|um|mmhmm|uhhuh|huh)\b"
CONTRACTIONS = (
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"\blemme\b", "let me"), (r"\bdunno\b", "do not know"), (r"\bain't\b", "aint"), (r"\by'all\b", "you all"),
    (r"\bwanna\b", "want to"), (r"\bkinda\b", "kind of"), (r"\bgotta\b", "got to"), (r"\blotta\b", "lot of"), (r"\bsorta\b", "sort of"), (r"\bgonna\b", "going to"), (r"\bi'ma\b", "i am going to"), (r"\bimma\b", "i am going to"),
    (r"\bwoulda\b", "would have"), (r"\bcoulda\b", "could have"), (r"\bshoulda\b", "should have"), (r"\bma'am\b", "madam"), (r"\balright\b", "all right"),
    (r"\bmr\b", "mister "), (r"\bmrs\b", "missus "), (r"\bst\b", "saint "), (r"\bdr\b", "doctor "), (r"\bprof\b", "professor "), (r"\bcapt\b", "captain "),
    (r"\bgov\b", "governor "), (r"\bald\b", "alderman "), (r"\bgen\b", "general "), (r"\bsen\b", "senator "), (r"\brep\b", "representative "),
    (r"\bpres\b", "president "), (r"\brev\b", "reverend "), (r"\bhon\b", "honorable "), (r"\basst\b", "assistant "), (r"\bassoc\b", "associate "),
    (r"\blt\b", "lieutenant "), (r"\bcol\b", "colonel "), (r"\bjr\b", "junior "), (r"\bsr\b", "senior "), (r"\besq\b", "esquire "),
    (r"'d been\b", " had been"), (r"'s been\b", " has been"), (r"'d gone\b", " had gone"), (r"'s gone\b", " has gone"), (r"'d done\b", " had done"), (r"'s got\b", " has got"),
    (r"n't\b", " not"), (r"'re\b", " are"), (r"it's\b", "it is"), (r"he's\b", "he is"), (r"she's\b", "she is"), (r"that's\b", "that is"), (r"what's\b", "what is"),
    (r"there's\b", "there is"), (r"'d\b", " would"), (r"'ll\b", " will"), (r"'t\b", " not"), (r"'ve\b", " have"), (r"'m\b", " am"), (r"\bcuz\b", "'cause"),
)


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def where_found(text: Column, pattern: str, rules: Callable[[Column], Column]) -> Column:
    """rules(text) where the pattern is found, else the text: one search spares a text all of the rules' own. The text is bound once."""
    return F.get(F.transform(F.array(text), lambda x: F.when(x.rlike(pattern), rules(x)).otherwise(x)), F.lit(0))


def expand_abbreviations(text: Column) -> Column:
    def each(text: Column) -> Column:
        for short, long in ABBREVIATIONS:
            text = F.regexp_replace(text, rf"(?iU)\b{short}\.", long)
        return text

    return where_found(text, rf"(?iU)\b(?:{'|'.join(short for short, _ in ABBREVIATIONS)})\.", each)


def expand_symbols(text: Column) -> Column:
    for symbol, word in SYMBOLS:
        text = F.replace(text, F.lit(symbol), F.lit(word))
    return text


def drop_punctuation(text: Column, charset: str) -> Column:
    """Punctuation outside the charset becomes spaces, but for marks that are spoken as words."""
    gone = "".join(c for c in PUNCTUATION if c not in "+&@%:" + charset)
    return F.translate(text, gone, " " * len(gone))


def remove_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[a-zA-Z_]+>", "")


def scrub(text: Column, charset: str) -> Column:
    allowed = "".join("\\" + c if c in "\\]^-[&" else c for c in charset)
    return F.regexp_replace(text, f"[^{allowed}]", "")


def replace_all(text: Column, replacements: list[tuple[str, str]]) -> Column:
    for old, new in replacements:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalise_punctuation(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit('"'), F.lit("")), ";:!-", ",.. ")


def _folded(s: str) -> str:
    return unicodedata.normalize("NFKD", s.translate(FOLDS)).encode("ascii", "ignore").decode()


_fold = by_parts(lambda: _folded)


def ascii_fold(text: Column) -> Column:
    """ASCII letters for accented ones; what has no ASCII form goes. Rows that are ASCII already stay in the JVM."""
    return only_where(text.rlike(r"[^\x00-\x7F]"), _fold, text)


def _without_symbols() -> Callable[[str], str]:
    table = dict(LETTERS)

    def one(s: str) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", s):
            kind = unicodedata.category(c)
            out.append(c if c in ".%$¢€£'" else table.get(c) or ("" if kind == "Mn" else " " if kind[0] in "MSP" else c))
        return "".join(out)

    return one


_strip_symbols = by_parts(_without_symbols)


def strip_symbols(text: Column) -> Column:
    """Symbols and punctuation but .%$¢€£' become spaces, diacritics go."""
    plain = F.translate(text, "!\"#&()*+,-/:;<=>?@[\\]^_`{|}~", " " * 28)
    return only_where(text.rlike(r"[^\x00-\x7F]"), _strip_symbols, text, plain)


#: Where any contraction stands: without one, none of the replacements changes a text.
CONTRACTED = r"(?U)(?:\b(?:{})|{})\b".format(*["|".join(p[2 * led : -2] for p, _ in CONTRACTIONS if p.startswith(r"\b") == led) for led in (True, False)])


def contract(text: Column) -> Column:
    for pattern, new in CONTRACTIONS:
        text = F.regexp_replace(text, "(?U)" + pattern, new)
    return text


def american(text: Column, spelling: dict[str, str]) -> Column:
    """Words by a user's spelling table."""
    if not spelling:
        return F.array_join(F.array_remove(F.split(text, r"\s+"), ""), " ")
    if len(spelling) > 64:  # a map column is searched from end to end
        look_up = F.pandas_udf(lambda s: s.map(lambda x: " ".join(spelling.get(w, w) for w in x.split()), na_action="ignore"), T.StringType())
        return look_up(text)
    table = F.create_map(*[F.lit(x) for kv in spelling.items() for x in kv])
    return F.array_join(F.transform(F.array_remove(F.split(text, r"\s+"), ""), lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def standardise(text: Column, spelling: dict[str, str] | None = None) -> Column:
    """The English standardiser: brackets, fillers, contractions, numbers' commas, symbols, spelling."""
    s = F.lower(text)
    s = F.regexp_replace(s, r"[<\[][^>\]]*[>\]]", "")
    s = F.regexp_replace(s, "(?U)" + FILLERS, "")
    s = F.regexp_replace(s, r"\s+'", "'")
    s = where_found(s, CONTRACTED, contract)
    s = F.regexp_replace(s, r"(\d),(\d)", "$1$2")
    s = F.regexp_replace(s, r"\.([^0-9]|$)", " $1")
    s = american(strip_symbols(s), spelling or {})
    s = F.regexp_replace(s, r"[.$¢€£]([^0-9])", " $1")
    s = F.regexp_replace(s, r"([^0-9])%", "$1 ")
    return collapse(s)


def wer_standard(spelling: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """The standardiser of error rates: the lower-case pipeline with letters, apostrophe and tag brackets, then standardise()."""
    return lambda text: standardise(lower_pipeline(text, " '<>abcdefghijklmnopqrstuvwxyz"), spelling)


def lower_pipeline(text: Column, charset: str, strict: bool = True) -> Column:
    """ASCII, lower case, numbers as words, abbreviations, symbols, single spaces; if strict, punctuation becomes spaces and only the
    charset stays."""
    s = F.lower(ascii_fold(text))
    s = only_where(s.rlike("[0-9]"), numbers.spoken("-" in charset), s)
    s = expand_abbreviations(s)
    s = expand_symbols(drop_punctuation(s, charset) if strict else s)
    s = F.trim(collapse(s))
    return scrub(s, charset) if strict else s


def normalise(df: DataFrame, column: str, level: str, charset: str, replacements: list[tuple[str, str]] | None = None, keep_tags: bool = False, english: bool = False, spelling: dict[str, str] | None = None) -> DataFrame:
    """df with column at one of five levels: identity, scrub, ascii, digit_to_word, lowercase. Later steps are replacements, tags and
    the charset; with tags kept, <, > and _ count as its members. english: lowercase text is standardised as well."""
    allowed = charset + ("<>_" if keep_tags else "")
    s = F.col(column)
    if level == "lowercase":
        s = lower_pipeline(s, charset, strict=False)
        s = standardise(s, spelling) if english else s
    elif level in ("ascii", "digit_to_word"):
        s = ascii_fold(s)
        if level == "digit_to_word":
            s = only_where(s.rlike("[0-9]"), numbers.spoken("-" in charset), s)
    s = replace_all(s, replacements or [])
    s = s if keep_tags else remove_tags(s)
    return df.withColumn(column, s if level == "identity" else scrub(s, allowed))


def masked(text: Column, symbols: list[str]) -> Column:
    """User symbols as letter words that no later rule touches; unmasked() turns them back."""
    for i, s in enumerate(symbols):
        text = F.replace(text, F.lit(s), F.lit(_mask(i)))
    return text


def unmasked(text: Column, symbols: list[str]) -> Column:
    for i, s in enumerate(symbols):
        text = F.replace(text, F.lit(_mask(i)), F.lit(s))
    return text


def _mask(i: int) -> str:
    return "q" + "".join(chr(98 + (i // 20**k) % 20) for k in range(4)) + "zqxjzqxjzqxjzqx"


def by_line(text: Column, rule: Callable[[Column], Column] = F.trim) -> Column:
    """The lines, each by a rule of its own, joined by spaces."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: rule(line)), " ")  # a function of two parameters (F.trim) would get the place as its second


def merged_splits(parts: Column) -> Column:
    """Segments of a text with those that were parted inside a word put together: where neither side has a space at the seam."""
    seam = lambda a, x: F.element_at(a, -1).endswith(" ") | x.startswith(" ")
    start = F.slice(parts, 1, 1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.aggregate(rest, start, lambda a, x: F.when(seam(a, x), F.concat(a, F.array(x))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), x)))))


CLEANERS: dict[str, Callable[[Column], Column]] = {"collapse": collapse, "lower": F.lower, "abbreviations": expand_abbreviations, "symbols": expand_symbols, "trim": F.trim, "punctuation": lambda c: normalise_punctuation(c), "tags": lambda c: remove_tags(c)}


def cleaned(text: Column, names: list[str]) -> Column:
    """The text through cleaners chosen by name, in that order; an unknown name is an error."""
    for name in names:
        text = CLEANERS[name](text)
    return text


def is_tag(word: Column) -> Column:
    """Whether a word is nothing but tags."""
    return (F.trim(remove_tags(word)) == "") & (F.trim(word) != "")


def sentence_ends(text: Column, mark: str = "<EOS>") -> tuple[Column, Column]:
    """The text with a mark after each inner sentence end, and how many there are."""
    ended = F.regexp_replace(text, r"([.?!]+)\s+(?=\S)", "$1 " + mark + " ")
    return ended, F.regexp_count(ended, F.lit(mark))


def non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F⺀-⿟㇀-㇯㐀-䶿一-鿿豈-﫿]")


def code_points(text: Column) -> Column:
    """Code points; hexadecimal UTF-32 gives them exactly, where chr() and ascii() stop at small ones."""
    return F.transform(F.array_remove(F.split(text, ""), ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))


def from_code_points(points: Column) -> Column:
    """The text of code points; negative ones are padding."""
    kept = F.filter(points, lambda p: p >= 0)
    return F.decode(F.unhex(F.array_join(F.transform(kept, lambda p: F.lpad(F.hex(p.cast("long")), 8, "0")), "")), "UTF-32")
