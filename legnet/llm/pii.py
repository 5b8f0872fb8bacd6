"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, dots
before digits, digits, plus signs before digits, schemes and identifier cues. From
each anchor a local parser walks left and right over the characters its kind allows
and validates what it found. Nothing is searched twice and no pattern runs over the
whole text.

Kinds, in this order: `email`, `ip`, `card`, `phone` (the base kinds, leftmost and
non-overlapping; a match that fails its check is dropped and not retried), then
`iban` (cue IBAN or a country code and check digits, of the country's length, valid
modulo 97; countries not listed here need the cue), `secret` (a value of 16 or more
characters after token, secret, password, passwd, api_key, apikey or access_key and =
or :, or after the word is, then with a letter and a digit), `login` (user and password
in a scheme's authority) and `account` (6 to 17 digits after account or acct and number,
no, num, nr, #, = or :).

Defined results: a missing or empty text has no spans; texts of any length are read
whole; spans are (kind, start, end) in code points, end exclusive, ordered by kind and
start; spans of different kinds may overlap; repeated rows give repeated results; other
columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from legnet.llm.batches import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "login", "account")

# Letters and digits the kinds allow.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
ALNUM = frozenset(LETTERS + DIGITS)
UPPER_DIGITS = frozenset(LETTERS[:26] + DIGITS)
LOCAL = frozenset(LETTERS + DIGITS + "._%+-")
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")
ACCOUNTS = ("account", "acct")
# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_quad = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").match
_digits = re.compile(r"[0-9](?:[ -]?[0-9])*").match
_phone = re.compile(r"\+[0-9][ ().0-9-]+").match
_value = re.compile(r"[\"']?[ ]?[=:][ ]?[\"']?([A-Za-z0-9_+/=.~-]{16,})").match
_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])").match
_said = re.compile(r"[\"']?[ ]is[ ][\"']?([A-Za-z0-9_+/=.~-]{16,})").match
_account = re.compile(
    r"(?:[ _-]?(?:number|no\.?|num\.?|nr\.?)[\"']?(?: is(?= )| ?[#:=])?|[\"']? ?[#:=]) ?[\"']?"
    r"([0-9](?:[ -]?[0-9]){5,})(?![A-Za-z0-9])",
    re.IGNORECASE,
).match
_cue_gap = re.compile(r"[ :]{0,3}").match
_login = re.compile(r"[^\s/@:]+:[^\s/@]+@").match


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def mod97(account: str) -> bool:
    rest = 0
    for c in account[4:] + account[:4]:
        x = int(c, 36)
        rest = (rest * (100 if x > 9 else 10) + x) % 97
    return rest == 1


def _mixed(value: str) -> bool:
    return any(c in DIGITS for c in value) and any(c in LETTERS for c in value)


def iban_end(text: str, at: int) -> int:
    """Where a valid account number that begins at a place ends; -1 if none does.

    Single spaces may stand between its characters. Without a known length the longest
    run of groups of four counts.
    """
    size = IBAN_LENGTHS.get(text[at : at + 2])
    if size is None:
        m = _iban(text, at)
        return m.end() if m and mod97(m[0].replace(" ", "")) else -1
    taken, i = [], at
    while len(taken) < size:
        c = text[i : i + 1]
        if c == " " and taken and text[i - 1] != " ":
            i += 1
        elif c and c in UPPER_DIGITS:
            taken.append(c)
            i += 1
        else:
            return -1
    whole = i == len(text) or text[i] not in ALNUM
    return i if whole and taken[2] in DIGITS and taken[3] in DIGITS and mod97("".join(taken)) else -1


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for d in DIGITS:
        a.add_word("." + d, ("ip", 2))
        a.add_word("+" + d, ("phone", 2))
        a.add_word(d, ("card", 1))
    a.add_word("IBAN", ("iban", 4))
    a.add_word("://", ("login", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("secret", len(form)))
    for cue in ACCOUNTS:
        for form in (cue, cue.upper(), cue.capitalize()):
            a.add_word(form, ("account", len(form)))
    a.make_automaton()
    return a


_FOUND: list = []


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, ordered by kind and start."""
    if not text:
        return []
    if not _FOUND:
        _FOUND.append(_automaton())
    found = {kind: [] for kind in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin
    size = len(text)
    for at, (kind, width) in _FOUND[0].iter(text):
        i = at - width + 1  # the anchor's first character
        if kind == "card":
            # Two letters of a known country before the first digit begin an account number.
            if i >= max(2, past["iban"] + 2) and text[i - 2 : i] in IBAN_LENGTHS:
                if (i == 2 or text[i - 3] not in ALNUM) and (end := iban_end(text, i - 2)) > 0:
                    past["iban"] = end
                    found["iban"].append((i - 2, end))
            if i < past["card"]:
                continue
            end = _digits(text, i).end()
            past["card"] = end
            number = text[i:end].replace(" ", "").replace("-", "")
            if 13 <= len(number) <= 19 and luhn(number):
                found["card"].append((i, end))
        elif kind == "ip":
            low = past["ip"]
            j = i
            while j > low and text[j - 1] in DIGITS:
                j -= 1
            if j < i and i >= low and (m := _quad(text, j)):
                past["ip"] = m.end()
                if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
                    found["ip"].append(m.span())
        elif kind == "email":
            low = past["email"]
            j = i
            while j > low and text[j - 1] in LOCAL:
                j -= 1
            if j < i and i >= low and (m := _domain(text, i + 1)):
                past["email"] = m.end()
                found["email"].append((j, m.end()))
        elif kind == "phone":
            if i < past["phone"] or not (m := _phone(text, i)):
                continue
            end = m.end()
            while text[end - 1] not in DIGITS:
                end -= 1
            if end - i > 3:  # plus, digit, something, digit
                past["phone"] = end
                if 9 <= sum(c in DIGITS for c in text[i:end]) <= 15:
                    found["phone"].append((i, end))
        elif kind == "iban":
            j = _cue_gap(text, at + 1).end()
            if j >= past["iban"] and (end := iban_end(text, j)) > 0:
                past["iban"] = end
                found["iban"].append((j, end))
        elif kind == "secret":
            if at >= past["secret"] and (m := _value(text, at + 1)):
                past["secret"] = m.end()
                found["secret"].append(m.span(1))
            elif at >= past["secret"] and (m := _said(text, at + 1)) and _mixed(m[1]):
                past["secret"] = m.end()
                found["secret"].append(m.span(1))
        elif kind == "account":
            if at >= past["account"] and (m := _account(text, at + 1)):
                past["account"] = m.end()
                if sum(c in DIGITS for c in m[1]) <= 17:
                    found["account"].append(m.span(1))
        elif at + 1 < size and i >= past["login"] and (m := _login(text, at + 1)):
            past["login"] = m.end()
            found["login"].append((at + 1, m.end() - 1))
    return [(kind, a, b) for kind in KINDS for a, b in found[kind]]


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for kind, a, b in found])


def redact(text: str | None, found: list[tuple[str, int, int]] | None = None) -> str | None:
    """The text with every span replaced by its kind in angle brackets.

    Overlapping spans go together, under the kind of the one that begins first (the
    earlier kind in KINDS on a tie).
    """
    found = spans(text) if found is None else found
    if not found:
        return text
    out, past = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[past:a], f"<{kind}>"]
        past = b
    return "".join([*out, text[past:]])


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, one count per kind, base_sha256 (of the base spans as written) and spans."""
    from hashlib import sha256

    schema = StructType.fromDDL(
        "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    )

    def run(rows):
        every = [spans(t) for t in rows["_text"]]
        out = {"id": rows["_id"]}
        for k in KINDS:
            out[f"n_{k}"] = [sum(s[0] == k for s in x) for x in every]
        out["base_sha256"] = [
            sha256(written([s for s in x if s[0] in BASE]).encode()).hexdigest() for x in every
        ]
        out["spans"] = [written(x) for x in every]
        return out

    given = docs.select(docs[id_col].cast("long").alias("_id"), docs[text].alias("_text"))
    return map_batches(given, run, schema).withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its text replaced; all columns kept."""
    names = docs.columns
    place = f"_{names.index(text)}"
    fields = [StructField(f"_{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]

    def run(rows) -> Iterator[dict]:
        return rows | {place: [redact(t) for t in rows[place]]}

    fields[names.index(text)] = StructField(place, StringType())
    given = docs.toDF(*[f.name for f in fields])
    return map_batches(given, run, StructType(fields)).toDF(*names)
