"""Scripts: transliteration, romanisation, script profiles and phonetic skeletons, as JVM expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

# The romanisation convention, letter by letter.
CONSONANTS = "ક ખ ગ ઘ ઙ ચ છ જ ઝ ઞ ટ ઠ ડ ઢ ણ ત થ દ ધ ન પ ફ બ ભ મ ય ર લ વ શ ષ સ હ ળ".split()
CONSONANT_SOUNDS = "k kh g gh ng ch chh j jh n T Th D Dh N t th d dh n p ph b bh m y r l v sh sh s h L".split()
VOWELS = "અ આ ઇ ઈ ઉ ઊ એ ઍ ઐ ઓ ઑ ઔ ઋ".split()
VOWEL_SOUNDS = "a aa i ee u oo e e ai o o au ru".split()
MATRAS = "ા િ ી ુ ૂ ે ૅ ૈ ો ૉ ૌ ૃ".split()
MATRA_SOUNDS = "aa i ee u oo e e ai o o au ru".split()
SIGNS = "ં ઁ ઃ".split()
SIGN_SOUNDS = "n n h".split()
VIRAMA = "્"
# The classes of the phonetic skeleton, and the roman spellings of one sound, in order of replacement.
SKELETON_CLASSES = {
    "k": "કખ", "g": "ગઘ", "c": "ચછ", "j": "જઝ", "t": "ટઠતથ", "d": "ડઢદધ", "n": "ણનં", "p": "પફ", "b": "બભ", "m": "મ", "y": "ય",
    "r": "રઋ", "l": "લળ", "v": "વ", "s": "સશષ", "h": "હ", "a": "અઆા", "i": "ઇઈિી", "u": "ઉઊુૂ", "e": "એઍેૅૈઐઁ", "o": "ઓઑોૉૌઔ",
}
ROMAN_SPELLINGS = [
    ("chh", "c"), ("ch", "c"), ("sh", "s"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("ph", "p"), ("bh", "b"), ("jh", "j"), ("zh", "j"),
    ("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u"), ("ai", "e"), ("au", "o"),
]
ROMAN_LETTERS, ROMAN_CLASSES = "zwfqx", "jvpkk"

_SHIFT = 0x180
_DANDAS = "।॥"


def _assigned(o: int) -> bool:
    return bool(unicodedata.name(chr(o), ""))


def devanagari_shifted(text: Column) -> Column:
    """Letters, signs and digits to the Gujarati block, dandas to full stops; whether the target is assigned isn't asked."""
    block = [*range(0x0901, 0x0964), *range(0x0966, 0x0970)]
    return F.translate(text, "".join(map(chr, block)) + _DANDAS, "".join(chr(o + _SHIFT) for o in block) + "..")


def devanagari_for_lexicon(text: Column) -> Column:
    """Dandas to full stops, avagraha and abbreviation sign dropped; what has no Gujarati counterpart stays."""
    block = [o for o in range(0x0900, 0x0980) if chr(o) not in "।॥ऽ॰" and _assigned(o + _SHIFT)]
    # translate drops the letters at the end that have no partner
    return F.translate(text, "".join(map(chr, block)) + "।॥" + "ऽ॰", "".join(chr(o + _SHIFT) for o in block) + "..")


def _normal_form(form: str):
    @F.pandas_udf("string")
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normal


def nfc(text: Column) -> Column:
    """Canonical composition; there is no such expression in the JVM, so texts that may change are sent to Python, and nulls for all others."""
    odd = r"[\x{0300}-\x{036F}\x{093C}\x{09BC}-\x{09D7}\x{0A3C}\x{0958}-\x{095F}\x{0B3C}-\x{0B57}\x{0BBE}-\x{0BD7}\x{0CC2}-\x{0CD6}\x{0D3E}-\x{0D57}\x{1100}-\x{11FF}\x{1E00}-\x{1FFF}\x{2000}-\x{2001}\x{2126}-\x{212B}\x{F900}-\x{FAFF}\x{0340}-\x{0387}]"
    return F.coalesce(_normal_form("NFC")(F.when(text.rlike(odd), text)), text)


def devanagari_for_text(text: Column) -> Column:
    """Decomposed, shifted where a Gujarati letter is assigned (dandas stay), and composed again."""
    block = [o for o in range(0x0900, 0x0980) if chr(o) not in _DANDAS and _assigned(o + _SHIFT)]
    table = {o: o + _SHIFT for o in block}

    @F.pandas_udf("string")
    def shifted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(table)))

    # Plain ASCII and Latin-1 letters come out as they went in.
    return F.coalesce(shifted(F.when(text.rlike(r"[^\x{0000}-\x{02FF}]"), text)), text)


def romanised(text: Column) -> Column:
    """The roman draft of a Gujarati text.

    Each sign looks at its neighbours only: a consonant takes the following vowel sign with it, has
    no vowel before a virama, an inherent a before a consonant, vowel or nasal sign, and none at
    the end of a word; a vowel sign or virama after a consonant is thus spent. One pass of one
    pattern in Arrow batches: a chain of replacements in the JVM reads each text fifty times.
    """
    sounds = dict(zip(CONSONANTS, CONSONANT_SOUNDS))
    taken = dict(zip(MATRAS, MATRA_SOUNDS)) | {VIRAMA: ""}
    single = dict(zip(VOWELS + SIGNS, VOWEL_SOUNDS + SIGN_SOUNDS)) | {chr(0x0AE6 + d): str(d) for d in range(10)}
    consonant, voiced = f"[{''.join(sounds)}]", f"[{''.join(CONSONANTS + VOWELS + SIGNS)}]"
    pattern = f"({consonant})([{''.join(taken)}]|(?={voiced}))?|[{''.join(single)}]"
    heard = {c + t: s + x for c, s in sounds.items() for t, x in taken.items()} | single

    def sound(m: re.Match) -> str:
        found = m.group()
        return heard[found] if found in heard else sounds[found] + ("" if m.group(2) is None else "a")

    @F.pandas_udf("string")
    def spelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        drafted = re.compile(pattern)
        for s in batches:
            yield s.map(lambda t: None if t is None else drafted.sub(sound, t))

    return F.coalesce(spelled(F.when(text.rlike(r"[\x{0A80}-\x{0AFF}]"), text)), text)


def slug(text: Column, length: int = 40) -> Column:
    """ASCII letters, digits and single hyphens, of a bounded length; ``src`` if nothing is left."""
    kept = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^a-zA-Z0-9\s-]", ""), r"^\s+|\s+$", ""))
    short = F.substring(F.regexp_replace(kept, r"[\s_-]+", "-"), 1, length)
    return F.when(short == "", "src").otherwise(short)


def script_counts(text: Column) -> dict[str, Column]:
    """How many code points of each script's range a text has; the Latin range runs from A to z with the signs between."""
    ranges = {"gujarati": r"[^\x{0A80}-\x{0AFF}]+", "devanagari": r"[^\x{0900}-\x{097F}]+", "latin": r"[^A-z]+"}
    return {name: F.length(F.regexp_replace(text, other, "")) for name, other in ranges.items()}


def line_script(line: Column) -> Column:
    """The script most of a line is in, the first of equals; null if none."""
    n = script_counts(line)

    def most(n: Column) -> Column:
        g, d, latin = n["gujarati"], n["devanagari"], n["latin"]
        return F.when((g + d + latin) == 0, None).when((g >= d) & (g >= latin), "gujarati").when(d >= latin, "devanagari").otherwise("latin")

    return let(F.struct(*[c.alias(name) for name, c in n.items()]), most)


def _sound_classes() -> tuple[str, str]:
    """The letters that have a sound class in either script, and their classes."""
    letters = [(c, k) for k, cs in SKELETON_CLASSES.items() for c in cs]
    both = letters + [(chr(ord(c) - _SHIFT), k) for c, k in letters]
    return "".join(c for c, _ in both), "".join(k for _, k in both)


def _ranges(letters: str) -> str:
    """Letters as ranges of a pattern's class, as a long list of single ones is slow."""
    points = sorted(set(map(ord, letters)))
    first = [c for c in points if c - 1 not in points]
    last = [c for c in points if c + 1 not in points]
    return "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in zip(first, last))


def skeleton_gujarati(text: Column, kept: str = "") -> Column:
    """One letter per sound class; Devanagari counts as Gujarati, all else but ``kept`` is dropped."""
    known, classes = _sound_classes()
    return F.translate(F.regexp_replace(text, f"[^{_ranges(known)}{kept}]", ""), known, classes)


def skeleton_roman(text: Column) -> Column:
    """Lower case, one spelling per sound, letters only, runs of a letter collapsed."""
    t = F.lower(text)
    for spelled, sound in ROMAN_SPELLINGS:
        t = F.replace(t, F.lit(spelled), F.lit(sound))
    return F.regexp_replace(F.translate(F.regexp_replace(t, r"[^\p{L}]", ""), ROMAN_LETTERS, ROMAN_CLASSES), r"(.)\1+", "$1")


def skeleton(text: Column) -> Column:
    """The longer of both skeletons, the Gujarati one of equals."""
    longer = lambda s: F.when(F.length(s["r"]) > F.length(s["g"]), s["r"]).otherwise(s["g"])
    return let(F.struct(skeleton_gujarati(text).alias("g"), skeleton_roman(text).alias("r")), longer)


def skeletons(text: Column) -> Column:
    """The skeletons of words between single blanks, in one pass where no letter lacks a sound class: there the Gujarati ones are as long as any."""
    unclassed = text.rlike(rf"[\p{{L}}&&[^{_ranges(_sound_classes()[0])}]]")
    return F.when(~unclassed, skeleton_gujarati(text, " ")).otherwise(F.array_join(F.transform(F.split(text, " "), skeleton), " "))
