"""The rule pack for Croatian acts: patterns and word lists that the text and extraction operators use by default.

Patterns are written so that Java's regular expressions and RE2 read them alike: no look-around, and explicit
classes of letters in place of ``\\w`` and ``\\b``.
"""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]"
EDGE = r"(?:^|[^\p{L}\p{N}_])"  # before a word
TAIL = r"(?:[^\p{L}\p{N}_]|$)"  # after a word

# Headings of acts.
CHAPTER = r"(?i)^[IVX]+\.?\s+.+"
ARTICLE = r"(?i)^Član\s+\d+\.\s*$"
MODERN_ARTICLE = r"(?i)^(Član|Članak)\s+\d+\.\s*$"
PARAGRAPH = r"^\(\d+\)"

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "br", "st", "čl", "dr", "mr", "prof", "op", "sl", "tzv", "tj", "npr", "str", "god", "sv", "vs", "al", "ul", "bb", "no", "tar", "pos", "vel",
    "odg", "ref", "tel", "itd", "idr", "spec", "nar", "sr", "rh", "nn", "sfrj", "sfr",
)

# Phrases that state a deadline, in the order in which they are looked for.
_UNITS = r"(?:dana?|tjedna?|mjeseca?|godina?)"
DEADLINES = (
    r"u\s+roku\s+od\s+[\p{L}\p{N}_\s]+?(?:dana|tjedna?|mjeseca?|godina?)",
    r"najkasnije\s+u\s+roku\s+od\s+[\p{L}\p{N}_\s]+?" + _UNITS,
    r"stupa\s+na\s+snagu\s+[\p{L}\p{N}_\s,]+?(?:dana?|danom|objavom|objave|stupanja)",
    r"u\s+roku\s+\d+\s+" + _UNITS,
    r"do\s+\d{1,2}\.\s*[\p{L}\p{N}_]+\s+\d{4}\.\s*godine",
    r"do\s+\d{1,2}\.\s+(?:siječnja|veljače|ožujka|travnja|svibnja|lipnja|srpnja|kolovoza|rujna|listopada|studenog|prosinca)\s+\d{4}\.",
    r"(?:idućeg|narednog|sljedećeg)\s+dana\s+(?:nakon|od|po)\s+[\p{L}\p{N}_\s]+",
    r"od\s+dana\s+stupanja\s+na\s+snagu[\p{L}\p{N}_\s,]*",
)

# Words that name institutions.
INSTITUTIONS = "ministarstvo|vlada|sabor|vijeće|odbor|komisija|ured|agencija|zavod|fond|institut|sud|tužilaštvo|tužiteljstvo|inspektorat|uprava|direkcija|tijelo|organ"
# Runs of capitalised words with a tail of lower-case ones, and headers in capitals.
BODY = r"[A-ZŠĐČĆŽ][a-zšđčćžA-ZŠĐČĆŽ]+(?:\s+[A-ZŠĐČĆŽ][a-zšđčćžA-ZŠĐČĆŽ]+)+(?:\s+(?:za|i|o|u)\s+[a-zšđčćžA-ZŠĐČĆŽ\s]+)?"
HEADER = r"[A-ZŠĐČĆŽ][A-ZŠĐČĆŽА-ЯЁ\s]{10,60}"

# Phrases that mark duties, scope and penalties.
OBLIGATION = (
    r"dužan\s+je|dužna\s+je|dužni\s+su|obvezna?\s+je|obvezni\s+su|mora(?:ju)?\s+(?:se\s+)?|mora\s+biti|obvezan\s+je|"
    r"podnijeti|dostaviti|prijaviti|obavijestiti|uskladiti|osigurati|priložiti|čuvati|voditi|plaćati|platiti"
)
SCOPE = (
    r"primjenjuje\s+se\s+na|odnosi\s+se\s+na|ovim\s+zakonom\s+(?:uređuje|određuje|propisuje|utvrđuje)|zakon\s+se\s+primjenjuje|"
    r"obvezuje\s+(?:sve\s+)?|pravo\s+(?:imaju|na|na\s+to)|na\s+koje\s+se|na\s+koga\s+se"
)
SANCTION = (
    r"kaznit\s+(?:će\s+se|se)|novčana\s+kazna|kazna\s+zatvora|novčanom\s+kaznom|kaznom\s+zatvora|kazneno\s+djelo|prekršaj|"
    r"oduzimanje|zabrana\s+djelovanja|raspuštanje|zabranit\s+(?:će\s+se|se)"
)
# Kinds of acts that a title begins with, and words that are no subjects.
ACTS = "zakon|pravilnik|uredba|odluka|naredba|rješenje|naputak|uputa"
STOP_WORDS = (
    "o", "u", "i", "a", "te", "za", "na", "od", "do", "po", "iz", "se", "je", "su", "će", "bi", "da", "li", "ali", "ili", "kao", "koji", "koja",
    "koje", "ovim", "ovoga", "toga", "tome", "ovome", "sve", "svi", "svim", "zakona", "zakon", "zakonom", "prečišćeni", "tekst", "izmjenama",
    "dopunama", "odredbama", "odredbe", "primjeni", "primjena", "br", "nn", "sl", "člana", "članak",
)
CAPITAL_HEADING = r"^[IVXLC]+\.\s+[A-ZŠĐČĆŽ\s]{5,}"

# Longest item of each extracted list, in characters.
LENGTHS = {"deadlines": 200, "responsible_bodies": 150, "obligations": 250, "scope": 250, "sanctions": 250, "subjects": 120}


def marked(phrases: str) -> str:
    """A pattern that finds one of the phrases as whole words, whatever the case."""
    return f"(?i){EDGE}(?:{phrases}){TAIL}"
