"""Folding of texts: what remains is letters and digits without case and accents."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np

#: Code points below this are folded by table; others are kept as they are if they are letters or digits.
_TABLE = 0x3000
DROP, BREAK = 1, 0
_fold: np.ndarray | None = None


def _table() -> np.ndarray:
    """Per code point: the folded letter's code, DROP for marks that vanish, BREAK for what separates words."""
    global _fold
    if _fold is None:
        t = np.zeros(_TABLE, np.uint32)
        for cp in range(_TABLE):
            base = unicodedata.normalize("NFKD", chr(cp)).lower()
            first = base[0] if base else " "
            if unicodedata.combining(chr(cp)) or cp in (0xAD, 0x200B, 0x200C, 0x200D):
                t[cp] = DROP
            elif first.isalnum():
                t[cp] = ord(first)
        _fold = t
    return _fold


# Two to four characters that are UTF-8 bytes read one by one, as Latin-1 or Windows-1252.
_TAIL = "\u0080-¿" + "".join(bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0))
_DAMAGED = re.compile(f"[Â-ß][{_TAIL}]|[à-ï][{_TAIL}]{{2}}|[ð-ô][{_TAIL}]{{3}}")
_HYPHEN = re.compile(r"(\w)[-­‐]\s*\n\s*(?=\w)")


def _redecode(m: re.Match) -> str:
    raw = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in m[0])
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def repaired(text: str) -> str:
    """The text with entities resolved and damaged encoding undone."""
    if "&" in text:
        text = html.unescape(text)
    if "Ã" in text or "Â" in text or "â" in text or "Å" in text:
        text = _DAMAGED.sub(_redecode, text)
    return text


def folded_codes(text: str) -> np.ndarray:
    """Per character of ``text`` its folded code, DROP or BREAK."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return folded_points(cps, np.minimum(cps, _TABLE - 1))


def folded_points(cps: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The same of code points; ``low`` has them cut to the table."""
    out = _table()[low]
    at = np.flatnonzero(cps >= _TABLE)
    if len(at):
        out[at] = [c if chr(c).isalnum() else BREAK for c in cps[at].tolist()]
    return out


def words(text: str) -> list[str]:
    """The folded words of ``text``, words broken at a line's end joined."""
    codes = folded_codes(_HYPHEN.sub(r"\1", repaired(text)))
    codes = np.where(codes == BREAK, 32, codes)[codes != DROP]
    return codes.astype(np.uint32).tobytes().decode("utf-32-le").split()
