"""Words and script runs as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinloom.functions.text import words

# Fixed value: stands for the space in front of a word.
SPACE_MARK = "▁"

# A learned piece never mixes scripts. These are the names that regular expressions
# know them by; kana count as Han, and marks without a script of their own go with their neighbours.
SINGLE_SCRIPTS = """
    Latin Common Greek Cyrillic Armenian Hebrew Arabic Syriac Thaana Devanagari Bengali Gurmukhi
    Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Thai Lao Tibetan Myanmar Georgian
    Hangul Ethiopic Cherokee Canadian_Aboriginal Ogham Runic Khmer Mongolian Bopomofo Yi
    Old_Italic Gothic Deseret Tagalog Hanunoo Buhid Tagbanwa Limbu Tai_Le Linear_B Ugaritic
    Shavian Osmanya Cypriot Braille Buginese Coptic New_Tai_Lue Glagolitic Tifinagh Syloti_Nagri
    Old_Persian Kharoshthi Balinese Cuneiform Phoenician Phags_Pa Nko Sundanese Batak Lepcha
    Ol_Chiki Vai Saurashtra Kayah_Li Rejang Lycian Carian Lydian Cham Tai_Tham Tai_Viet Avestan
    Egyptian_Hieroglyphs Samaritan Mandaic Lisu Bamum Javanese Meetei_Mayek Imperial_Aramaic
    Old_South_Arabian Inscriptional_Parthian Inscriptional_Pahlavi Old_Turkic Brahmi Kaithi
    Meroitic_Hieroglyphs Meroitic_Cursive Sora_Sompeng Chakma Sharada Takri Miao
    Caucasian_Albanian Bassa_Vah Duployan Elbasan Grantha Pahawh_Hmong Khojki Linear_A Mahajani
    Manichaean Mende_Kikakui Modi Mro Old_North_Arabian Nabataean Palmyrene Pau_Cin_Hau
    Old_Permic Psalter_Pahlavi Siddham Khudawadi Tirhuta Warang_Citi Ahom Anatolian_Hieroglyphs
    Hatran Multani Old_Hungarian SignWriting Adlam Bhaiksuki Marchen Newa Osage Tangut
    Masaram_Gondi Nushu Soyombo Zanabazar_Square Hanifi_Rohingya Old_Sogdian Sogdian Dogra
    Gunjala_Gondi Makasar Medefaidrin Elymaic Nandinagari Nyiakeng_Puachue_Hmong Wancho Yezidi
    Chorasmian Dives_Akuru Khitan_Small_Script
""".split()
SCRIPTS = (*((name,) for name in SINGLE_SCRIPTS), ("Han", "Hiragana", "Katakana"))


def _run_pattern() -> str:
    listed = "".join(rf"\p{{Is{name}}}" for group in SCRIPTS for name in group)
    groups = ["".join(rf"\p{{Is{name}}}" for name in group) for group in SCRIPTS]
    runs = [rf"[{g}\p{{IsInherited}}]+" for g in groups] + [rf"[^{listed}]+"]
    return f"{SPACE_MARK}?(?:" + "|".join(runs) + ")"


def marked_words(text: Column, dummy_prefix: bool) -> Column:
    """Words with the space mark in front; the first one only with ``dummy_prefix``."""
    mark = F.lit(SPACE_MARK)
    if dummy_prefix:
        return F.transform(words(text), lambda w: F.concat(mark, w))
    return F.transform(words(text), lambda w, i: F.when(i == 0, w).otherwise(F.concat(mark, w)))


def script_runs(word: Column) -> Column:
    """Maximal parts of one script; the space mark stays with the first part."""
    return F.regexp_extract_all(word, F.lit(_run_pattern()), F.lit(0))
