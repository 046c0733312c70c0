"""Languages by name and code, and what depends on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed values.
CODES = {
    "English": "en",
    "Traditional Chinese": "zh-TW",
    "Simplified Chinese": "zh-CN",
    "Japanese": "ja",
    "Korean": "ko",
    "Vietnamese": "vi",
    "Thai": "th",
    "Indonesian": "id",
    "Malay": "ms",
    "Filipino": "fil",
    "Burmese": "my",
    "Khmer": "km",
    "Lao": "lo",
    "Hindi": "hi",
    "Bengali": "bn",
    "Tamil": "ta",
    "Telugu": "te",
    "Marathi": "mr",
    "Gujarati": "gu",
    "Kannada": "kn",
    "Malayalam": "ml",
    "Punjabi": "pa",
    "Urdu": "ur",
    "Nepali": "ne",
    "Sinhala": "si",
    "French": "fr",
    "German": "de",
    "Spanish": "es",
    "Portuguese": "pt",
    "Italian": "it",
    "Dutch": "nl",
    "Swedish": "sv",
    "Norwegian": "no",
    "Danish": "da",
    "Finnish": "fi",
    "Icelandic": "is",
    "Russian": "ru",
    "Polish": "pl",
    "Ukrainian": "uk",
    "Czech": "cs",
    "Romanian": "ro",
    "Hungarian": "hu",
    "Bulgarian": "bg",
    "Slovak": "sk",
    "Croatian": "hr",
    "Serbian": "sr",
    "Slovenian": "sl",
    "Lithuanian": "lt",
    "Latvian": "lv",
    "Estonian": "et",
    "Greek": "el",
    "Turkish": "tr",
    "Arabic": "ar",
    "Hebrew": "he",
    "Persian": "fa",
    "Swahili": "sw",
    "Amharic": "am",
    "Hausa": "ha",
    "Yoruba": "yo",
    "Zulu": "zu",
}
#: Marks in a language hint and the sentence splitter's code, the first that is found.
SPLITTERS = [
    ("en", "en"), ("english", "en"),
    ("es", "es"), ("spanish", "es"),
    ("fr", "fr"), ("french", "fr"),
    ("de", "de"), ("german", "de"),
    ("it", "it"), ("italian", "it"),
    ("nl", "nl"), ("dutch", "nl"),
    ("pl", "pl"), ("polish", "pl"),
    ("da", "da"), ("danish", "da"),
    ("ru", "ru"), ("russian", "ru"),
    ("ja", "ja"), ("japanese", "ja"),
    ("zh", "zh"), ("zh-cn", "zh"), ("zh-tw", "zh"), ("chinese", "zh"),
]
NOT_AVAILABLE = {
    "Vietnamese": "Không có",
    "English": "N/A",
    "Japanese": "なし",
    "Korean": "없음",
    "Thai": "ไม่มี",
    "German": "Keine",
    "French": "Aucun",
    "Spanish": "Ninguno",
    "Italian": "Nessuno",
    "Portuguese": "Nenhum",
    "Dutch": "Geen",
    "Indonesian": "Tidak ada",
    "Malay": "Tiada",
}

#: Texts that say that there is nothing.
NOTHING = ["无", "無", "无。", "無。"]


def _dict(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def code_of(language: Column) -> Column:
    """A language's code by its name in any case; codes, and names that aren't known, stay."""
    named = _dict({k.lower(): v for k, v in CODES.items()})[F.lower(language)]
    return F.when(F.contains(language, F.lit("-")) | (F.length(language) <= 3), language).otherwise(F.coalesce(named, language))


def splitter_code(hint: Column) -> Column:
    """The sentence splitter for a language hint: the first mark found anywhere in it, else English."""
    low, out = F.lower(F.coalesce(hint, F.lit(""))), F.lit("en")
    for mark, code in reversed(SPLITTERS):
        out = F.when(F.contains(low, F.lit(mark)), code).otherwise(out)
    return F.when(low == "", "en").otherwise(out)


def bypass(text: Column, target: Column) -> Column:
    """The target language's way to say that there is nothing, for a text that says so; null for any other."""
    return F.when(strip(F.coalesce(text, F.lit(""))).isin(NOTHING), F.coalesce(_dict(NOT_AVAILABLE)[target], F.lit("N/A")))
