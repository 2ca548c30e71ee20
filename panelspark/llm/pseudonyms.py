"""PII: format-preserving pseudonyms by a keyed Feistel permutation.

Numbers, dates, addresses and secrets are found by pattern and checked (check digits, calendar, ranges).
Each is mapped to a number below the count of all values of its format, permuted there by a keyed
Feistel network with cycle walking, and written back in the same format with the same separators and a
right check digit. As this is a permutation, equal values get equal pseudonyms in every document and
different values different ones; who has the key can undo it.

Numbers with check digits are tried at every group of digits beside them, so a date, a security code or a
word next to them hides none. Card readings that overlap go to the usual layouts first, then to the longest;
number lists would give a card in every other line, so parts of a run are read as a card only if all their groups
but the last have four digits. A card that could be taken for another reading once it is changed is permuted on until it
cannot; there alone, its pseudonym depends on the numbers beside it.

Defined results: null stays null, texts without findings stay as they are; overlapping findings go to the one
that begins first, then to the longer one, and secrets go before IBANs, these before cards and addresses, and these
before phone numbers, dates and plain numbers; repeated rows are treated alike; other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from collections.abc import Callable
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tasks import column, ship_functions

KEY = b"panelspark-demo-key"  # a deployment passes its own
ROUNDS = 10
_FIRST_DAY, _DAYS = dt.date(1900, 1, 1).toordinal(), 73_049  # 1900 to 2099


# --- permutation --------------------------------------------------------------------


class Feistel:
    """Keyed permutation of the numbers below ``size``, another one for each ``tweak``."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.left = isqrt(size - 1) + 1 if size > 1 else 1
        self.right = -(-size // self.left)
        self.seed = hashlib.blake2b(f"{tweak}:{size}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, number: int, value: int, below: int) -> int:
        text = number.to_bytes(1, "big") + value.to_bytes((value.bit_length() + 7) // 8, "big")
        wide = (below.bit_length() + 7) // 8 + 8
        return int.from_bytes(hashlib.shake_256(self.seed + text).digest(wide), "big") % below

    def _once(self, value: int, back: bool) -> int:
        a, b = divmod(value, self.right)
        for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                b = (b + sign * self._round(k, a, self.right)) % self.right
            else:
                a = (a + sign * self._round(k, b, self.left)) % self.left
        return a * self.right + b

    def __call__(self, value: int, back: bool = False) -> int:
        if self.size < 2:
            return value
        value = self._once(value, back)
        while value >= self.size:  # walk the cycle until it is back among the values
            value = self._once(value, back)
        return value


@lru_cache(maxsize=4096)
def _permutation(key: bytes, tweak: str, size: int) -> Feistel:
    return Feistel(key, tweak, size)


def _permute_symbols(key: bytes, tweak: str, text: str, alphabets: list[str], back: bool) -> str:
    """Permute a text whose i-th character is one of ``alphabets[i]``."""
    value, size = 0, 1
    for char, letters in zip(text, alphabets, strict=True):
        value = value * len(letters) + letters.index(char)
        size *= len(letters)
    value = _permutation(key, f"{tweak}:{'|'.join(alphabets)}", size)(value, back)
    out = []
    for letters in reversed(alphabets):
        value, place = divmod(value, len(letters))
        out.append(letters[place])
    return "".join(reversed(out))


# --- formats ------------------------------------------------------------------------

_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_CLASSES = [_DIGITS, _LOWER, _LOWER.upper()]

Change = Callable[[bytes, "re.Match[str]", bool], "str | None"]


def _refill(shape: str, symbols: str, takes: Callable[[str], bool] = str.isdigit) -> str:
    """Put symbols in the places of ``shape`` that hold one."""
    rest = iter(symbols)
    return "".join(next(rest) if takes(c) else c for c in shape)


def _by_class(key: bytes, tweak: str, text: str, back: bool) -> str:
    """Permute letters and digits of a text within their kind; other characters stay."""
    kind = lambda c: next((k for k in _CLASSES if c in k), None)
    symbols = [c for c in text if kind(c)]
    changed = _permute_symbols(key, tweak, "".join(symbols), [kind(c) for c in symbols], back) if symbols else ""
    return _refill(text, changed, lambda c: kind(c) is not None)


def luhn_digit(digits: str) -> str:
    """Check digit that makes ``digits`` a valid card number."""
    total = 0
    for i, char in enumerate(reversed(digits)):
        value = int(char) * (2 - i % 2)
        total += value - 9 if value > 9 else value
    return str(-total % 10)


def _is_card(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return 12 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1]


def _card(key: bytes, text: str, back: bool) -> str:
    """Issuer digit and length stay, the digits between are permuted, the check digit is set anew."""
    digits = re.sub(r"\D", "", text)
    body = digits[0] + _permute_symbols(key, "card" + digits[0], digits[1:-1], [_DIGITS] * (len(digits) - 2), back)
    return _refill(text, body + luhn_digit(body))


def _account(key: bytes, m: re.Match[str], back: bool) -> str | None:
    """Long digit runs without a valid check digit keep failing the check, so they never meet a card's pseudonym."""
    digits = re.sub(r"\D", "", m[0])
    if not 12 <= len(digits) <= 19:
        return None
    shift = (int(digits[-1]) - int(luhn_digit(digits[:-1]))) % 10
    body = _permute_symbols(key, f"account{len(digits)}", digits[:-1], [_DIGITS] * (len(digits) - 1), back)
    return _refill(m[0], body + str((int(luhn_digit(body)) + shift) % 10))


def _phone(key: bytes, m: re.Match[str], back: bool) -> str | None:
    """The country code stays. North American numbers (area and exchange begin with 2 to 9) stay such, others too."""
    code, rest = m["code"] or "", m["rest"]
    digits, country = re.sub(r"\D", "", rest), re.sub(r"\D", "", code) or "1"
    regular = lambda d: country == "1" and len(d) == 10 and d[0] > "1" and d[3] > "1"
    if not (regular(digits) or code and 7 <= len(digits) <= 12):
        return None
    kind = regular(digits)
    while True:
        digits = _permute_symbols(key, "phone" + country, digits, [_DIGITS] * len(digits), back)
        if regular(digits) == kind:
            return code + _refill(rest, digits)


def _ssn(key: bytes, m: re.Match[str], back: bool) -> str | None:
    """Numbers of valid areas, groups and serials are permuted among themselves."""
    area, group, serial = int(m[1]), int(m[2]), int(m[3])
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    place = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
    place = _permutation(key, "ssn", 898 * 99 * 9999)(place, back)
    area, rest = divmod(place, 99 * 9999)
    group, serial = divmod(rest, 9999)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _is_iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and _iban_rest(text) == 1


def _iban(key: bytes, text: str, back: bool) -> str:
    """Country and the kinds of the characters stay; the two check digits are set anew."""
    plain = text.replace(" ", "")
    body = _by_class(key, "iban" + plain[:2], plain[4:], back)
    check = 98 - _iban_rest(plain[:2] + "00" + body)
    return _refill(text, f"{plain[:2]}{check:02d}{body}", lambda c: c != " ")


def _ip(key: bytes, m: re.Match[str], back: bool) -> str | None:
    """Unicast addresses are permuted among themselves, and so are the others."""
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value, low, high = int(ipaddress.IPv4Address(m[0])), 1 << 24, 224 << 24
    if low <= value < high:
        return str(ipaddress.IPv4Address(low + _permutation(key, "ip", high - low)(value - low, back)))
    other = value if value < low else value - (high - low)
    other = _permutation(key, "ip-other", (1 << 32) - (high - low))(other, back)
    return str(ipaddress.IPv4Address(other if other < low else other + (high - low)))


def _email(key: bytes, m: re.Match[str], back: bool) -> str | None:
    """Letters and digits of the local part are permuted within their kind; the host stays."""
    return _by_class(key, "mail", m["local"], back) + m[0][len(m["local"]) :]


def _day(key: bytes, ordinal: int, keep: Callable[[dt.date], bool], back: bool) -> dt.date | None:
    """Permute a day among the days of 1900 to 2099 that pass ``keep``."""
    place = ordinal - _FIRST_DAY
    if not 0 <= place < _DAYS:
        return None
    permutation = _permutation(key, "date", _DAYS)
    while True:
        place = permutation(place, back)
        found = dt.date.fromordinal(_FIRST_DAY + place)
        if keep(found):
            return found


def _date(year: int, month: int, day: int) -> int | None:
    try:
        return dt.date(year, month, day).toordinal()
    except ValueError:
        return None


def _iso_date(key: bytes, m: re.Match[str], back: bool) -> str | None:
    ordinal = _date(int(m[1]), int(m[3]), int(m[4]))
    found = ordinal and _day(key, ordinal, lambda d: True, back)
    return f"{found.year:04d}{m[2]}{found.month:02d}{m[2]}{found.day:02d}" if found else None


def _dotted_date(key: bytes, m: re.Match[str], back: bool) -> str | None:
    ordinal = _date(int(m[3]), int(m[2]), int(m[1]))
    found = ordinal and _day(key, ordinal, lambda d: True, back)
    return f"{found.day:02d}.{found.month:02d}.{found.year:04d}" if found else None


def _slashed_date(key: bytes, m: re.Match[str], back: bool) -> str | None:
    """Month first; day first where only that is a date, and then the pseudonym is such a date too."""
    a, b, year = int(m[1]), int(m[2]), int(m[3])
    month_first = _date(year, a, b)
    ordinal = month_first or _date(year, b, a)
    found = ordinal and _day(key, ordinal, (lambda d: True) if month_first else (lambda d: d.day > 12), back)
    if not found:
        return None
    first, second = (found.month, found.day) if month_first else (found.day, found.month)
    return f"{first:02d}/{second:02d}/{found.year:04d}"


def _secret(key: bytes, m: re.Match[str], back: bool) -> str | None:
    body = m["secret"]
    lead = m[0][: m.start("secret") - m.start()]
    if re.fullmatch(r"[0-9a-f]+", body):
        hexes = _DIGITS + "abcdef"
        body = _permute_symbols(key, f"hex{len(body)}", body, [hexes] * len(body), back)
    elif body.startswith("AKIA"):
        letters = _LOWER.upper() + _DIGITS
        body = "AKIA" + _permute_symbols(key, "access", body[4:], [letters] * (len(body) - 4), back)
    else:
        body = _by_class(key, "secret", body, back)
    return lead + body + m[0][m.end("secret") - m.start() :]


_FREE_LEFT, _FREE_RIGHT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
# Kind, pattern, change; the order decides between findings at one place of one length.
DETECTORS: list[tuple[str, re.Pattern[str], Change]] = [
    ("secret", re.compile(_FREE_LEFT + r"(?P<secret>AKIA[0-9A-Z]{16})" + _FREE_RIGHT), _secret),
    ("secret", re.compile(_FREE_LEFT + r"(?i:token|secret|password|passwd|api_?key)\s{0,3}[=:]\s{0,3}[\"']?(?P<secret>[^\s\"']{6,})"), _secret),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9._%+-]{1,64})@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"), _email),
    ("ssn", re.compile(_FREE_LEFT + r"([0-9]{3})-([0-9]{2})-([0-9]{4})" + _FREE_RIGHT), _ssn),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?P<code>\+?1[ .-]?)?(?P<rest>\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4})" + _FREE_RIGHT), _phone),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?P<code>\+[0-9]{1,3}[ .-]?)(?P<rest>\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3})" + _FREE_RIGHT), _phone),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"), _ip),
    ("date", re.compile(_FREE_LEFT + r"([0-9]{4})([-/.])([0-9]{2})\2([0-9]{2})(?:(?=[Tt][0-9]{2}:?[0-9]{2})|" + _FREE_RIGHT + ")"), _iso_date),
    ("date", re.compile(_FREE_LEFT + r"([0-9]{2})\.([0-9]{2})\.([0-9]{4})" + _FREE_RIGHT), _dotted_date),
    ("date", re.compile(_FREE_LEFT + r"([0-9]{2})/([0-9]{2})/([0-9]{4})" + _FREE_RIGHT), _slashed_date),
    ("account", re.compile(_FREE_LEFT + r"[0-9]{12,19}" + _FREE_RIGHT), _account),
]
# A text without any of these has no finding.
_SIGNS = re.compile(r"[0-9@=:]")


_CARD_SPAN = re.compile(_FREE_LEFT + r"[0-9](?:[ -]?[0-9]){11,18}" + _FREE_RIGHT)
_CARD_RUN = re.compile(_FREE_LEFT + r"[0-9](?:[ -]?[0-9]){11,}" + _FREE_RIGHT)
_CARD_LAYOUTS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
_IBAN_START = re.compile(_FREE_LEFT + r"[A-Z]{2}[0-9]{2}(?=[A-Z0-9 ])")
_IBAN_SPAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _FREE_RIGHT)
_GROUP_END = re.compile(r"[0-9A-Za-z](?![0-9A-Za-z])")


def _card_spans(text: str) -> list[tuple[int, int]]:
    """Spans that could be a card, the preferred ones first. The order depends on the layout only."""
    ranked = {(m.start(), m.end()): 2 for m in _CARD_SPAN.finditer(text)}
    for run in _CARD_RUN.finditer(text):
        groups = [(run.start() + g.start(), run.start() + g.end()) for g in re.finditer("[0-9]+", run[0])]
        for i, (begin, _) in enumerate(groups):
            sizes = []
            for j in range(i, len(groups)):
                a, b = groups[j]
                sizes.append(b - a)
                if sum(sizes) > 19:
                    break
                if sum(sizes) >= 12:
                    usual = len(sizes) == 1 or tuple(sizes) in _CARD_LAYOUTS and len({*text[begin:b]} & {" ", "-"}) == 1
                    ranked[begin, b] = 0 if usual else 1
                if b - a < 4:
                    break
    digits = lambda span: sum(map(str.isdigit, text[slice(*span)]))
    return sorted(ranked, key=lambda span: (ranked[span], -digits(span), span))


def _iban_spans(text: str) -> list[tuple[int, int]]:
    """Spans that could be an IBAN: at each start all ends behind a group, the longest first."""
    spans = []
    for start in _IBAN_START.finditer(text):
        m = _IBAN_SPAN.match(text, start.start())
        ends = [g.end() for g in _GROUP_END.finditer(text, start.end(), m.end())] if m else []
        spans += [(start.start(), end) for end in reversed(ends) if _IBAN_SPAN.fullmatch(text, start.start(), end)]
    return spans


def _checked(
    text: str, spans: list[tuple[int, int]], valid: Callable[[str], bool], change: Callable[[bytes, str, bool], str], key: bytes, back: bool
) -> list[tuple[int, int, str]]:
    """The first valid of the ``spans`` that overlap, with their pseudonyms.

    A pseudonym that makes a span before it valid is permuted again, so the same spans are found in the result.
    """
    owner: dict[int, int] = {}  # place in the text: the chosen span there
    chosen = []
    for k, (a, b) in enumerate(spans):
        if not any(i in owner for i in range(a, b)) and valid(text[a:b]):
            chosen.append(k)
            owner.update(dict.fromkeys(range(a, b), k))
    rivals: dict[int, list[int]] = {k: [] for k in chosen}
    for k, (a, b) in enumerate(spans if chosen else []):
        over = {owner[i] for i in range(a, b) if i in owner}
        if over and min(over) > k:
            for other in over:
                rivals[other].append(k)
    chars = list(text) if chosen else []
    made = []
    for k in sorted(chosen, key=lambda k: spans[k], reverse=back):
        a, b = spans[k]
        while True:
            chars[a:b] = change(key, "".join(chars[a:b]), back)
            if not any(valid("".join(chars[c:d])) for c, d in (spans[r] for r in rivals[k])):
                break
        made.append((a, b, "".join(chars[a:b])))
    return made


def _matched(text: str, pattern: re.Pattern[str], change: Change, key: bytes, back: bool) -> list[tuple[int, int, str]]:
    """Accepted matches; behind a refused one shorter ones and those that begin within it are tried."""
    out, at = [], 0
    while m := pattern.search(text, at):
        at = m.start() + 1
        made = change(key, m, back)
        ends = [g.end() for g in _GROUP_END.finditer(text, m.start(), m.end())][:-1] if made is None else []
        while made is None and ends:
            if shorter := pattern.match(text, m.start(), ends.pop()):
                m, made = shorter, change(key, shorter, back)
        if made is not None:
            out.append((m.start(), m.end(), made))
            at = max(at, m.end())
    return out


def find(text: str, key: bytes, back: bool = False) -> list[tuple[int, int, str, str]]:
    """Findings that do not overlap: begin, end, kind and pseudonym."""
    if not _SIGNS.search(text):
        return []

    done: list[tuple[int, int, str, str]] = []

    def settle(found: list[tuple[int, int, int, str, str]]) -> str:
        """Keep what does not overlap; the text without it is searched further."""
        reached = 0
        for begin, minus_end, _, kind, made in sorted(found):
            if begin >= reached:
                reached = -minus_end
                done.append((begin, reached, kind, made))
        return replace(text, [(a, b, kind, "\0" * (b - a)) for a, b, kind, _ in sorted(done)])

    def matched(rest: str, kinds: tuple[str, ...]) -> list[tuple[int, int, int, str, str]]:
        return [
            (a, -b, rank, kind, made)
            for rank, (kind, pattern, change) in enumerate(DETECTORS) if kind in kinds
            for a, b, made in _matched(rest, pattern, change, key, back)
        ]

    rest = settle(matched(text, ("secret",)))
    rest = settle([(a, -b, 0, "iban", made) for a, b, made in _checked(rest, _iban_spans(rest), _is_iban, _iban, key, back)])
    cards = [(a, -b, 0, "card", made) for a, b, made in _checked(rest, _card_spans(rest), _is_card, _card, key, back)]
    rest = settle(matched(rest, ("email",)) + cards)
    settle(matched(rest, ("ssn", "phone", "ip", "date", "account")))
    return sorted(done)


def replace(text: str, found: list[tuple[int, int, str, str]]) -> str:
    """The text with its findings replaced."""
    parts, at = [], 0
    for begin, end, _, made in found:
        parts += [text[at:begin], made]
        at = end
    return "".join([*parts, text[at:]])


# --- DataFrames ---------------------------------------------------------------------

_FOUND = "array<struct<kind:string,begin:int,end:int>>"


def pseudonymised(text: Column, key: bytes = KEY, back: bool = False) -> Column:
    """A text column with pseudonyms, as ``text`` and ``found`` (spans in the text as it was)."""

    @F.arrow_udf(f"struct<text:string,found:{_FOUND}>")
    def run(texts: pa.Array) -> pa.Array:
        made, spans = [], []
        for value in texts:
            value = value.as_py()
            found = find(value, key, back) if value else []
            made.append(replace(value, found) if found else value)
            spans.append([{"kind": k, "begin": a, "end": b} for a, b, k, _ in found])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(made, pa.string()), pa.array(spans, kind)], ["text", "found"])

    return run(text)


def pseudonymise(docs: DataFrame, key: bytes = KEY, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_chars`` (if there is one) of the new text."""
    ship_functions(docs.sparkSession)
    out = docs.withColumn("text", pseudonymised(column(docs, "text"), key, back)["text"])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def with_findings(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``doc_id, text, n_found, found`` of every row of ``docs``."""
    ship_functions(docs.sparkSession)
    done = docs.select(column(docs, "doc_id").alias("doc_id"), pseudonymised(column(docs, "text"), key).alias("done"))
    return done.select("doc_id", "done.text", F.size("done.found").cast("long").alias("n_found"), "done.found")
