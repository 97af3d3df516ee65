"""Part-of-speech and feature tags as map look-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.values import mapped

# Universal parts of speech by tag, as published for the Stockholm-Umeå tag set.
SUC_UPOS = {
    "NN": "NOUN", "PM": "PROPN", "VB": "VERB", "IE": "PART", "PC": "VERB", "PL": "PART", "PN": "PRON", "PS": "DET", "HP": "PRON", "HS": "DET", "DT": "DET", "HD": "DET", "JJ": "ADJ",
    "AB": "ADV", "HA": "ADV", "KN": "CONJ", "SN": "SCONJ", "PP": "ADP", "RG": "NUM", "RO": "ADJ", "IN": "INTJ", "UO": "X", "MAD": "PUNCT", "MID": "PUNCT", "PAD": "PUNCT",
}
# Universal parts of speech by (the beginning of) a tag, as the tag sets' manuals give them.
PENN_UPOS = {
    "CC": "CONJ", "DT": "DET", "EX": "PRON", "I": "INTJ", "IN": "ADP", "JJ": "ADJ", "JJR": "ADJ", "JJS": "ADJ", "MD": "VERB", "PDT": "DET", "POS": "ADP", "PRP": "PRON", "PRP$": "PRON", "RB": "ADV", "RBR": "ADV", "RBS": "ADV",
    "RP": "PART", "TO": "PART", "UH": "INTJ", "VB": "VERB", "VBD": "VERB", "VBG": "VERB", "VBN": "VERB", "VBP": "VERB", "VBZ": "VERB", "W": "NUM", "WDT": "DET", "WP": "PRON", "WP$": "PRON", "WRB": "ADV", "CD": "NUM", "FW": "X",
    "LS": "X", "SYM": "SYM", "NN": "NOUN", "NNS": "NOUN",
}
EAGLES_UPOS = {
    "A": "ADJ", "CC": "CONJ", "CS": "SCONJ", "D": "DET", "F": "PUNCT", "I": "INTJ", "NC": "NOUN", "NP": "PROPN", "P": "PRON", "R": "ADV", "S": "ADP", "VM": "VERB", "VA": "AUX", "VS": "VERB", "VV": "VERB", "W": "NUM", "Z": "NUM",
    "Y": "X", "X": "X",
}
RUSSIAN_EAGLES_UPOS = {
    "A": "ADJ", "B": "ADP", "C": "CONJ", "D": "ADV", "E": "PRON", "J": "INTJ", "M": "X", "P": "ADV", "Y": "NUM", "R": "ADV", "T": "PART", "Q": "VERB", "Z": "NUM", "V": "VERB", "F": "PUNCT", "W": "NUM",
}
BULGARIAN_UPOS = {
    "Nc": "NOUN", "Np": "PROPN", "A": "ADJ", "H": "PROPN", "P": "PRON", "M": "NUM", "Vp": "VERB", "Vn": "VERB", "Vx": "AUX", "Vy": "AUX", "Vi": "AUX", "D": "ADV", "Cc": "CONJ", "Cs": "SCONJ", "T": "PART", "R": "ADP", "I": "INTJ",
}
ESTONIAN_UPOS = {
    "S": "NOUN", "V": "VERB", "A": "ADJ", "G": "ADJ", "P": "PRON", "D": "ADV", "K": "ADP", "N": "NUM", "I": "INTJ", "Y": "X", "X": "ADV", "Z": "PUNCT", "T": "X",
}
FINNISH_UPOS = {
    "Abbr": "X", "Adp": "ADP", "Adv": "ADV", "Interj": "INTJ", "N": "NOUN", "Num": "NUM", "PrfPrc": "VERB", "Pron": "PRON", "PrsPrc": "VERB", "Punct": "PUNCT", "SENT": "PUNCT", "V": "VERB", "AgPcp": "VERB", "A": "ADJ", "CC": "CONJ",
    "CS": "SCONJ", "NON-TWOL": "X",
}
DUTCH_UPOS = {
    "adj": "ADJ", "adv": "ADV", "con": "CONJ", "det": "DET", "int": "INTJ", "nou": "NOUN", "num": "NUM", "par": "PART", "pre": "ADP", "pro": "PRON", "pun": "PUNCT", "ver": "VERB",
}
LATIN_UPOS = {
    "ESSE": "AUX", "V": "VERB", "PRON": "PRON", "REL": "PRON", "POSS": "PRON", "DIMOS": "PRON", "INDEF": "PRON", "N": "NOUN", "NPR": "PROPN", "CC": "CONJ", "CS": "SCONJ", "ADJ": "ADJ", "ADV": "ADV", "PREP": "ADP", "INT": "INTJ",
    "ABBR": "X", "EXCL": "INTJ", "FW": "X", "SENT": "PUNCT", "PUN": "PUNCT", "SYM": "SYM", "CLI": "X",
}
POLISH_UPOS = {
    "subst": "NOUN", "depr": "NOUN", "num": "NUM", "numcol": "NUM", "adj": "ADJ", "adja": "ADJ", "adjp": "ADJ", "adjc": "ADJ", "adv": "ADV", "qub": "ADV", "ppron12": "PRON", "ppron3": "PRON", "siebie": "PRON", "fin": "VERB",
    "bedzie": "VERB", "inf": "VERB", "ger": "VERB", "aglt": "VERB", "praet": "PART", "pcon": "PART", "pant": "PART", "pact": "PART", "ppas": "PART", "impt": "VERB", "imps": "VERB", "winien": "AUX", "pred": "ADJ", "prep": "ADP",
    "conj": "CONJ", "comp": "SCONJ", "brev": "X", "burk": "X", "interj": "INTJ", "interp": "PUNCT", "SENT": "PUNCT", "xxx": "X", "ign": "X",
}
ROMANIAN_UPOS = {
    "Nc": "NOUN", "Np": "PROPN", "Vm": "VERB", "Va": "AUX", "A": "ADJ", "P": "PRON", "D": "DET", "T": "DET", "R": "ADV", "Sp": "ADP", "SE": "PUNCT", "Cc": "CONJ", "Cr": "CONJ", "Cs": "SCONJ", "CO": "PUNCT", "M": "NUM", "Q": "PART",
    "I": "INTJ", "Y": "X", "X": "X",
}
SLOVAK_UPOS = {
    "S": "NOUN", "A": "ADJ", "P": "PRON", "N": "NUM", "V": "VERB", "G": "PART", "D": "ADV", "E": "ADP", "O": "CONJ", "T": "PART", "J": "INTJ", "R": "X", "Y": "X", "W": "SYM", "Z": "PUNCT", "Q": "X", "#": "X", "%": "X", "0": "NUM",
    ":r": "PROPN", ":q": "X",
}
STTS_UPOS = {
    "ADJA": "ADJ", "ADJD": "ADJ", "ADV": "ADV", "APPR": "ADP", "APPRART": "ADP", "APPO": "ADP", "APZR": "ADP", "ART": "DET", "CARD": "NUM", "FM": "X", "ITJ": "INTJ", "ORD": "NUM", "KOUI": "SCONJ", "KOUS": "SCONJ", "KON": "CONJ",
    "KOKOM": "CONJ", "NN": "NOUN", "NE": "PROPN", "PDS": "PRON", "PDAT": "PRON", "PIS": "PRON", "PIAT": "PRON", "PIDAT": "PRON", "PPER": "PRON", "PPOSS": "PRON", "PPOSAT": "PRON", "PRELS": "PRON", "PRELAT": "PRON", "PRF": "PRON",
    "PWS": "PRON", "PWAT": "PRON", "PWAV": "PRON", "PAV": "ADV", "PTKZU": "PART", "PTKNEG": "PART", "PTKVZ": "PART", "PTKANT": "PART", "PTKA": "PART", "SGML": "X", "SPELL": "X", "TRUNC": "X", "VVFIN": "VERB", "VVIMP": "VERB",
    "VVINF": "VERB", "VVIZU": "VERB", "VVPP": "VERB", "VAFIN": "VERB", "VAIMP": "VERB", "VAINF": "VERB", "VAPP": "VERB", "VMFIN": "VERB", "VMINF": "VERB", "VMPP": "VERB", "XY": "SYM", "$,": "PUNCT", "$.": "PUNCT", "$(": "PUNCT",
}
FRENCH_UPOS = {
    "ABR": "X", "ADJ": "ADJ", "ADV": "ADV", "DET": "DET", "INT": "INTJ", "KON": "CONJ", "NAM": "PROPN", "NOM": "NOUN", "NUM": "NUM", "PRO": "PRON", "PRP": "ADP", "PUN": "PUNCT", "SEN": "X", "SYM": "SYM", "VER": "VERB",
}
SPANISH_UPOS = {
    "ADJ": "ADJ", "ADV": "ADV", "ART": "DET", "CAR": "NUM", "CC": "CONJ", "CCA": "CONJ", "CCN": "CONJ", "CQU": "SCONJ", "CSU": "SCONJ", "DM": "PRON", "INT": "PRON", "ITJ": "INTJ", "NC": "NOUN", "NME": "NOUN", "NMO": "NOUN", "NP": "PROPN",
    "ORD": "DET", "PAL": "ADP", "PDE": "ADP", "PPC": "PRON", "PPO": "PRON", "PPX": "PRON", "PRE": "ADP", "REL": "PRON", "SE": "PART", "QU": "DET", "BAC": "SYM", "CM": "PUNCT", "COL": "PUNCT", "DAS": "PUNCT", "DOT": "PUNCT", "FS": "PUNCT",
    "SYM": "SYM", "LP": "PUNCT", "QT": "PUNCT", "RP": "PUNCT", "SEM": "PUNCT", "SLA": "SYM", "PER": "SYM",
}
ITALIAN_UPOS = {
    "ADJ": "ADJ", "ADV": "ADV", "CON": "CONJ", "DET": "DET", "INT": "INTJ", "LS": "SYM", "NOM": "NOUN", "NPR": "PROPN", "NUM": "NUM", "PON": "PUNCT", "PRE": "ADP", "PRO": "PRON", "SYM": "SYM", "VER": "VERB",
}
RUSSIAN_UPOS = {
    "A": "ADJ", "C": "CONJ", "I": "INTJ", "M": "NUM", "N": "NOUN", "P": "PRON", "Q": "PART", "R": "ADV", "S": "ADP", "V": "VERB",
}
FALLBACK = "X"


@dataclass(frozen=True)
class TagSet:
    """How a tag of a set is looked up. patterns: (regular expression, part of speech) that decide before the table does. letters: how many of the tag's first letters are its
    key, 0 for all. two: first letters after which the key has two. part: what ends the key instead.
    """

    table: dict[str, str]
    patterns: tuple[tuple[str, str], ...] = ()
    letters: int = 0
    two: str = ""
    part: str = ""

    def upos(self, tag: Column) -> Column:
        if self.part:
            key = F.substring_index(tag, self.part, 1)
        elif self.two:
            key = F.when(tag.rlike(f"^[{self.two}]"), tag.substr(1, 2)).otherwise(tag.substr(1, 1))
        else:
            key = tag.substr(1, self.letters) if self.letters else tag
        out = mapped(key, self.table, FALLBACK)
        for pattern, pos in reversed(self.patterns):
            out = F.when(tag.rlike(pattern), pos).otherwise(out)
        return out


EAGLES = TagSet(EAGLES_UPOS, letters=1, two="NVC")
CONVERTERS = {
    ("swe", "SUC"): TagSet(SUC_UPOS),
    **{(language, "EAGLES"): EAGLES for language in ("ast", "cat", "deu", "spa", "fra", "glg", "ita", "nob", "por", "slv")},
    ("rus", "EAGLES"): TagSet(RUSSIAN_EAGLES_UPOS, letters=1),
    ("eng", "Penn"): TagSet(PENN_UPOS, (("^NNS?$", "NOUN"), ("^N", "PROPN"), ("^FW$", "X"), ("^F", "PUNCT"), ("^Z", "NUM"))),
    ("bul", "BulTreeBank"): TagSet(BULGARIAN_UPOS, (("^PT", "PUNCT"),), two="NVC"),
    ("est", "TreeTagger"): TagSet(ESTONIAN_UPOS, part="."),
    ("fin", "FinnTreeBank"): TagSet(FINNISH_UPOS, part="_"),
    ("nld", "TreeTagger"): TagSet(DUTCH_UPOS, (("^\\$\\.$", "PUNCT"), ("^pronadv$", "ADV"), ("^det__art$", "DET")), letters=3),
    ("lat", "TreeTagger"): TagSet(LATIN_UPOS, part=":"),
    ("pol", "NationalCorpusofPolish"): TagSet(POLISH_UPOS, part=":"),
    ("ron", "MULTEXT"): TagSet(ROMANIAN_UPOS, two="NVCS"),
    ("slk", "SlovakNationalCorpus"): TagSet(SLOVAK_UPOS, (("^[^\\p{L}]$", "PUNCT"), ("^:r$", "PROPN"), ("^:", "X")), letters=1),
    ("deu", "STTS"): TagSet(STTS_UPOS),
    ("fra", "TreeTagger"): TagSet(FRENCH_UPOS, (("^DET:POS$", "PRON"),), letters=3),
    ("spa", "TreeTagger"): TagSet(SPANISH_UPOS, (("^V", "VERB"),), letters=3),
    ("ita", "TreeTagger"): TagSet(ITALIAN_UPOS, letters=3),
    ("rus", "TreeTagger"): TagSet(RUSSIAN_UPOS, letters=1),
}

# Universal features by part of a morphological tag.
FEATURES = {
    "UTR": "Gender=Com", "NEU": "Gender=Neut", "MAS": "Gender=Masc", "UTR+NEU": "Gender=Com,Neut", "SIN": "Number=Sing", "PLU": "Number=Plur", "SIN+PLU": "Number=Plur,Sing",
    "IND": "Definite=Ind", "DEF": "Definite=Def", "IND+DEF": "Definite=Def,Ind", "NOM": "Case=Nom", "GEN": "Case=Gen", "POS": "Degree=Pos", "KOM": "Degree=Cmp", "SUV": "Degree=Sup",
    "PRS": "Tense=Pres", "PRT": "Tense=Past", "INF": "VerbForm=Inf", "SUP": "VerbForm=Sup", "IMP": "Mood=Imp", "AKT": "Voice=Act", "SFO": "Voice=Pass", "KON": "Mood=Sub", "PRF": "Tense=Past",
    "AN": "Abbr=Yes", "SMS": "Compound=Yes", "SUB": "Case=Nom", "OBJ": "Case=Acc", "SUB+OBJ": "Case=Acc,Nom",
}
PUNCTUATION = ("MAD", "MID", "PAD")


def upos(tag: Column, language: str = "swe", tag_set: str = "SUC") -> Column:
    """Universal parts of speech; X for tags of the set that have none, '' for sets that are not known."""
    known = CONVERTERS.get((language, tag_set))
    return known.upos(tag) if known else F.lit("")


def pos_of(msd: Column) -> Column:
    """The part of speech: the first part of a morphological tag."""
    return F.split(msd, r"\.")[0]


def features(pos: Column, msd: Column) -> Column:
    """The sorted array of universal features of a morphological tag.

    None for punctuation and for tags of one part. Participles are VerbForm=Part; verbs that are no abbreviation, part of a compound or of another form are
    finite, and indicative unless a mood is given.
    """
    table = F.create_map(*[F.lit(x) for pair in FEATURES.items() for x in pair])
    parts = F.filter(F.split(msd, r"\."), lambda p: p != "-")
    found = F.filter(F.transform(parts, lambda p: table[p]), lambda f: f.isNotNull())
    has = lambda name: F.exists(found, lambda f: f.startswith(name))
    finite = (pos == "VB") & ~has("Abbr=Yes") & ~has("Compound=Yes") & ~has("VerbForm=")
    none = F.array().cast("array<string>")
    extra = F.concat(
        F.when(pos == "PC", F.array(F.lit("VerbForm=Part"))).otherwise(none),
        F.when(finite, F.array(F.lit("VerbForm=Fin"))).otherwise(none),
        F.when(finite & ~has("Mood="), F.array(F.lit("Mood=Ind"))).otherwise(none),
    )
    return F.when(pos.isin(*PUNCTUATION) | (F.size(parts) <= 1), none).otherwise(F.array_sort(F.concat(found, extra)))
