"""Personal data in texts: regular expressions propose spans, validators confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are reported wherever form and checksum hold, whatever their score. Added kinds
(iban, ssn, local phone numbers) are reported from a score of THRESHOLD up, which a checksum or nearby context words
must supply. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ._shared import documents, map_texts

THRESHOLD = 0.5
#: Characters before and after a span that are searched for context words.
NEAR = 48
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behinds only keep a long run of digits from being tried again at each of its digits: a run that fails from its first digit fails from all.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}(?![A-Za-z0-9])|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3}(?![A-Za-z0-9]))?)")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write|reach|mailto", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|client", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment|cvv", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|cell|fax|whatsapp", re.I),
    "iban": re.compile(r"iban|account|bank|transfer|konto", re.I),
    "ssn": re.compile(r"\bssn\b|social security|tax id", re.I),
    "local_phone": re.compile(r"phone|call|\btel|mobile|cell|fax", re.I),
}
#: Score of a span by its form alone, and what its checksum and context words add.
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.3, "phone": 0.4, "iban": 0.2, "ssn": 0.3, "local_phone": 0.3}
CHECKSUM, WORDS = 0.4, 0.25


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain. Found from the @ outwards, so that long words cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        found = m[0]
        while len(compact := found.replace(" ", "")) >= 15:  # groups after the number may look like parts of it
            if len(compact) <= 34 and mod_97(compact):
                yield m.start(), m.start() + len(found)
                break
            if " " not in found:
                break
            found = found.rpartition(" ")[0]


def proposed(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether a checksum confirmed it) of every span that its validator does not reject."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b, False
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end(), False
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield "card", m.start(), m.end(), True
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", m.start(), m.end(), False
    for a, b in ibans(text):
        yield "iban", a, b, True
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end(), False
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end(), False


def score(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    near = CONTEXT[kind].search(text, max(0, start - NEAR), start) or CONTEXT[kind].search(text, end, end + NEAR)
    return min(1.0, PRIOR[kind] + CHECKSUM * checked + WORDS * bool(near))


BASE = KINDS[:4]


def spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, place of the kind in KINDS, end, score) of all that is reported, in order. Added spans don't overlap base ones."""
    found = [(start, KINDS.index(kind), end, score(text, kind, start, end, checked)) for kind, start, end, checked in proposed(text)]
    base = sorted(s for s in found if s[1] < len(BASE))
    added = sorted(s for s in found if s[1] >= len(BASE) and s[3] >= THRESHOLD)
    out, k, until = list(base), 0, -1
    for s in added:
        while k < len(base) and base[k][0] < s[2]:
            until = max(until, base[k][2])
            k += 1
        if s[0] >= until:
            out.append(s)
    return sorted(out)


def shown(found: list[tuple[int, int, int, float]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found])


def find_pii(docs: DataFrame, **columns: str) -> DataFrame:
    """For each row: counts of the base kinds, the digest of the base spans, all spans, and their scores in that order.

    Null and empty texts have no spans. Rows, repeated ones too, are independent of each other; other columns of
    docs are not kept. An empty table gives no rows.
    """

    def make() -> Callable[[list[str]], dict[str, list]]:
        def work(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores")}
            for text in texts:
                found = spans(text)
                base = [s for s in found if s[1] < len(BASE)]
                for k, kind in enumerate(BASE):
                    out[f"n_{kind}"].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(shown(base).encode()).hexdigest())
                out["spans"].append(shown(found))
                out["scores"].append([round(s[3], 2) for s in found])
            return out

        return work

    return map_texts(docs, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>", **columns)


def redact(text: str, mark: str = "<{kind}>") -> str:
    """text with each span replaced by a mark of its kind; of overlapping spans the first counts."""
    out, at = [], 0
    for a, k, b, _ in spans(text):
        if a >= at:
            out += [text[at:a], mark.format(kind=KINDS[k])]
            at = b
    return "".join([*out, text[at:]])


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
