"""Consistent and comparison forms of readings, and the sign string of a hieroglyphs field.

The table is the plain, whole-string form of the rules; `lookalike` reaches the same spellings through a vocabulary.
"""

from __future__ import annotations

import json
import re
import unicodedata

# Letters of the consistent form that aren't ASCII, and stand-ins that look like a letter or mark of it.
LETTERS = "ꜣꞽꜥḥḫẖšṯḏꜢꞼꜤḤḪŠṮḎ"
STAND_INS = {
    # alef, ayin, yod of old fonts and other scripts
    "ȝ": "ꜣ", "Ȝ": "Ꜣ", "ʾ": "ꜣ", "ʒ": "ꜣ", "Ʒ": "Ꜣ",
    "ʿ": "ꜥ", "ʕ": "ꜥ", "ˁ": "ꜥ", "ˤ": "ꜥ", "ᶜ": "ꜥ", "ʽ": "ꜥ",
    "ỉ": "ꞽ", "Ỉ": "Ꞽ",
    # Cyrillic, Armenian, Greek and IPA letters
    "ԝ": "w", "Ԝ": "W", "ѡ": "w", "ա": "w", "ᴡ": "w",
    "ո": "n", "Ո": "N", "ѕ": "s", "Ѕ": "S", "у": "y", "У": "Y", "ү": "y", "Ү": "Y",
    "р": "p", "Р": "P", "ρ": "p", "Ρ": "P", "һ": "h", "Һ": "H", "հ": "h",
    "ԁ": "d", "Ԁ": "D", "ԛ": "q", "Ԛ": "Q", "զ": "q", "ɡ": "g", "Ɡ": "G", "ց": "g",
    "і": "i", "І": "I", "ı": "i", "г": "r", "В": "B", "К": "K", "к": "k", "М": "M", "Т": "T", "Н": "H",
    # signs and marks; the slanted double hyphen (U+2E17) differs visibly from the equals sign and stays
    "꞊": "=", "‐": "-", "‑": "-", "−": "-", "̲": "̱", "̠": "̱",
}
# Marks that make a yod of an i; code points that show nothing though their category isn't Cf.
YOD_MARKS = "̓҆͗̉͑"
NOTHING = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
LINE_AND_TAB = "\t\n\r\v\f\x1c\x1d\x1e\x85  "

_CLEAN = re.compile(f"[\t\n\r -~{LETTERS}\U00013000-\U0001342f]*\\Z")
_YOD = re.compile(f"([iI])[{YOD_MARKS}]")
_LAYOUT = re.compile("[\U00013430-\U0001345f]")
_SIGNS = re.compile("[\U00013000-\U0001342f\U00013460-\U000143ff]+")
_NOT_SIGNS = re.compile("[^\U00013000-\U0001342f\U00013460-\U000143ff]+")


def folded(ch: str) -> str:
    """What one code point shows, in the letters of the consistent form: "" if it shows nothing."""
    if ch in STAND_INS:
        return STAND_INS[ch]
    if ch in LINE_AND_TAB or " " <= ch <= "~":
        return ch
    kind = unicodedata.category(ch)
    if kind in ("Cf", "Cc") or ch in NOTHING or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if kind == "Zs":
        return " "
    shown = unicodedata.normalize("NFKC", ch)
    if shown == ch or shown[0] == " ":
        return ch
    return "".join(STAND_INS.get(x, x) for x in shown)


class _Folding(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = folded(chr(code))
        return out


class _Kept(dict):
    def __missing__(self, code: int) -> str:
        ch = chr(code)
        self[code] = out = ch if unicodedata.category(ch)[0] in "LM" or unicodedata.category(ch) == "Nd" else ""
        return out


_FOLD, _KEEP = _Folding(), _Kept()


def consistent(text: str | None) -> str | None:
    """What looks the same is written the same; None stays None, runs of blanks and line breaks stay."""
    if text is None or _CLEAN.match(text):
        return text
    out = _YOD.sub(lambda m: "ꞽ" if m[1] == "i" else "Ꞽ", text.translate(_FOLD))
    return unicodedata.normalize("NFC", out)


def lowered(form: str) -> str:
    """Lower case; composed again, as some capitals have no code point of their own."""
    low = form.lower()
    return low if low.isascii() else unicodedata.normalize("NFC", low)


def comparison(text: str | None) -> str:
    """Consistent form, lower case, only letters, digits and combining marks; "" for None."""
    return lowered(consistent(text)).translate(_KEEP) if text else ""


def sign_string(text: str | None) -> str:
    return _NOT_SIGNS.sub("", text) if text else ""


def sign_terms(text: str | None) -> list[str]:
    """Sign groups: layout controls removed, all else that isn't a sign taken as a blank."""
    return _SIGNS.findall(_LAYOUT.sub("", text)) if text else []


def reading_terms(text: str | None) -> list[str]:
    """Tokens of the consistent form in lower case."""
    return lowered(consistent(text)).split() if text else []


def payload_form(payload: str | None) -> str:
    """Fields of a JSON object by name with their comparison forms; "" if it is no object or has no field.

    Text that isn't a JSON object counts by its own comparison form, apart from all objects.
    """
    if not payload:
        return ""
    try:
        fields = json.loads(payload)
    except ValueError:
        fields = None
    if not isinstance(fields, dict):
        form = comparison(payload)
        return form and f"text\x1f{form}"
    return "\x1e".join(f"{k}\x1f{comparison(v if isinstance(v, str) or v is None else json.dumps(v, sort_keys=True))}" for k, v in sorted(fields.items()))
