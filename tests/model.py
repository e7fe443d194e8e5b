"""A small independent model of the row-wise operators, for the tests."""

import math
import re
import unicodedata
from collections import Counter

from glyphsieve.functions.codepoints import CATEGORIES

KIND = {chr(cp): c for c, pairs in CATEGORIES.items() for a, b in pairs for cp in range(a, b + 1)}


def findings(text):
    return [(i, f"U+{ord(c):04X}", unicodedata.name(c, f"UNNAMED CONTROL (U+{ord(c):04X})"), KIND[c], text[max(0, i - 12) : i], text[i + 1 : i + 13]) for i, c in enumerate(text) if c in KIND]


def purified(text, off=(), form="NFC"):
    out = "".join(c for c in text if c not in KIND or KIND[c] in off)
    return out if form == "none" else unicodedata.normalize(form, out)


def entropy(items):
    n = len(items)
    return -sum(c / n * math.log2(c / n) for c in Counter(items).values())


def style(text):
    words = re.findall(r"[A-Za-z0-9']+", text.lower())
    parts = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]
    out = []
    if not words:
        out.append((0.0, 1.0))
    else:
        top = math.log2(len(words)) if len(words) > 1 else 1.0
        out.append((round(min(1.0, entropy(words) / top) * 10, 3) + 0.0, 1.2))
    clean = re.sub(r"\s+", " ", text.lower())
    out.append((round(min(1.0, entropy(list(zip(clean, clean[1:]))) / 4.2) * 10, 3), 1.0) if len(clean) > 1 else (0.0, 0.8))
    lengths = [len(re.findall(r"[A-Za-z0-9']+", s)) for s in parts]
    mean = sum(lengths) / len(lengths) if lengths else 0
    if len(parts) < 3 or mean == 0:
        out.append((5.0, 0.6))
    else:
        spread = math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)) / mean
        out.append((round(min(1.0, spread / 0.5) * 10, 3), 1.0))
    triples = list(zip(words, words[1:], words[2:]))
    out.append((round(len(set(triples)) / len(triples) * 10, 3), 1.0) if len(words) >= 10 else (5.0, 0.6))
    total = round(max(0.0, min(10.0, sum(v * w for v, w in out) / sum(w for _, w in out))), 3)
    n = len(words)
    band = "low" if n < 60 or len(parts) < 3 else "moderate" if n < 200 else "elevated" if n < 600 else "high"
    return out, total, band
