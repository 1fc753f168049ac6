"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (Luhn, octets, calendar).  A validated value is mapped by
a keyed permutation of its own format: its free characters form a number in a mixed radix, two
halves of which pass through keyed Feistel rounds.  The number is then advanced along the one cycle
this defines, so that no value stays itself.  The same value gets the same pseudonym in every
document, and the key holder can invert it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

KEY_CONF = "spark.rollscope.pii.key"
ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
_HINT = re.compile(r"[0-9@:=]|A[KS]IA")  # every match of _FIND holds one of these
_FIND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<secret>(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\"?\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9+/_-]{8,}))"
    r"|(?P<access>\bA[KS]IA[A-Z0-9]{16}\b)"
    r"|(?P<phone>(?<![\w.])(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    r"|(?:\(\d{3}\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4})(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<date>(?<![\w/-])(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4})(?![\w/-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}|\d{4}(?P<sep2>[ -])\d{6}(?P=sep2)\d{5})(?![\w-]))",
    re.ASCII)


_KINDS = ("email", "secret", "access", "phone", "ip", "date", "ssn", "card")


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


class Pseudonyms:
    """Keyed permutations within a format; one object a key."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, x: int, size: int) -> int:
        h = hashlib.blake2b(b"%s|%d|%d" % (tweak, i, x), key=self.key, digest_size=16 + (size.bit_length() + 7) // 8)
        return int.from_bytes(h.digest(), "big") % size

    def _forth(self, x: int, a: int, b: int, tweak: bytes) -> int:
        left, right = divmod(x, b)
        for i in range(ROUNDS):
            left = (left + self._round(tweak, 2 * i, right, a)) % a
            right = (right + self._round(tweak, 2 * i + 1, left, b)) % b
        return left * b + right

    def _back(self, x: int, a: int, b: int, tweak: bytes) -> int:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)):
            right = (right - self._round(tweak, 2 * i + 1, left, b)) % b
            left = (left - self._round(tweak, 2 * i, right, a)) % a
        return left * b + right

    def permute(self, digits: list[int], radices: list[int], kind: str, step: int = 1) -> list[int]:
        """Another number of the same mixed radix, never the same one; ``step=-1`` inverts."""
        half = len(radices) // 2
        a = b = 1
        for r in radices[:half]:
            a *= r
        for r in radices[half:]:
            b *= r
        if a * b < 2:
            return digits
        x = 0
        for d, r in zip(digits, radices):
            x = x * r + d
        tweak = f"{kind}:{a}:{b}".encode()
        x = self._back((self._forth(x, a, b, tweak) + step) % (a * b), a, b, tweak)
        out = []
        for r in reversed(radices):
            x, d = divmod(x, r)
            out.append(d)
        return out[::-1]

    def text(self, value: str, kind: str, alphabets: list[str | None], step: int = 1) -> str:
        """``value`` with the characters that have an alphabet permuted within it."""
        free = [(i, s) for i, s in enumerate(alphabets) if s]
        new = self.permute([s.index(value[i]) for i, s in free], [len(s) for _, s in free], kind, step)
        out = list(value)
        for (i, s), d in zip(free, new):
            out[i] = s[d]
        return "".join(out)

    def by_class(self, value: str, kind: str, step: int = 1) -> str:
        """Letters stay letters of the same case and digits digits; lower-case hexadecimal stays that."""
        if not value.strip("0123456789abcdef"):
            return self.text(value, kind, ["0123456789abcdef"] * len(value), step)
        digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return self.text(value, kind, [next((s for s in (digits, lower, upper) if c in s), None) for c in value], step)

    def card(self, value: str, step: int = 1) -> str:
        """First digit and separators stay, the check digit is made anew."""
        at = [i for i, c in enumerate(value) if c.isdigit()]
        inner = set(at[1:-1])
        new = self.text(value, f"card{len(at)}", ["0123456789" if i in inner else None for i in range(len(value))], step)
        body = "".join(new[i] for i in at[:-1])
        check = next(c for c in "0123456789" if luhn(body + c))
        return new[:at[-1]] + check + new[at[-1] + 1:]

    def phone(self, value: str, step: int = 1) -> str:
        """Assignable numbers (area and exchange from 200) stay assignable, others stay unassignable."""
        at = [i for i, c in enumerate(value) if c.isdigit()][-10:]

        def real(v: str) -> bool:
            return v[at[0]] > "1" and v[at[3]] > "1"

        low = (at[0], at[3]) if real(value) else ()
        sets = [None if i not in at else "23456789" if i in low else "0123456789" for i in range(len(value))]
        new = self.text(value, f"phone{len(low)}", sets, step)
        while real(new) != real(value):
            new = self.text(new, f"phone{len(low)}", sets, step)
        return new

    def ip(self, value: str, step: int = 1) -> str:
        return ".".join(map(str, self.permute([int(x) for x in value.split(".")], [256] * 4, "ip", step)))

    def ssn(self, value: str, step: int = 1) -> str:
        return self.text(value, "ssn", ["0123456789" if c.isdigit() else None for c in value], step)

    def date(self, value: str, step: int = 1) -> str:
        """Another day of 1900 to 2099 in the same notation; walks on over numbers that are no day."""
        form = "%Y-%m-%d" if "-" in value else "%d/%m/%Y" if _day(value, "%d/%m/%Y") else "%m/%d/%Y"
        n = _day(value, form) - FIRST_DAY
        while True:
            a, b = self.permute([n // 271, n % 271], [270, 271], "date", step)
            n = a * 271 + b
            if n <= LAST_DAY - FIRST_DAY:
                day = dt.date.fromordinal(FIRST_DAY + n)
                return f"{day.year:04d}-{day.month:02d}-{day.day:02d}" if "-" in value else day.strftime(form)


def _day(value: str, form: str) -> int | None:
    try:
        day = dt.datetime.strptime(value, form).toordinal()
    except ValueError:
        return None
    return day if FIRST_DAY <= day <= LAST_DAY else None


def _valid(kind: str, value: str) -> bool:
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return luhn(digits) and len(set(digits)) > 1
    if kind == "ip":
        return all(int(x) < 256 and str(int(x)) == x for x in value.split("."))
    if kind == "date":
        return any(_day(value, f) for f in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y"))
    if kind == "ssn":
        a, b, c = value.split("-")
        return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"
    return True


def pseudonymise_text(text: str, keyed: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in the new text."""
    if not _HINT.search(text):
        return text, []
    parts, spans, done, size = [], [], 0, 0
    m = _FIND.search(text)
    while m:
        kind = next(k for k in _KINDS if m.group(k))
        start, end = m.span("value") if kind == "secret" else m.span()
        value = text[start:end]
        if not _valid(kind, value):
            m = _FIND.search(text, m.start() + 1)  # a valid value may begin within the rejected one
            continue
        if kind == "email":
            local, _, domain = value.rpartition("@")
            new = keyed.by_class(local, "email") + "@" + domain
        elif kind == "secret":
            new = keyed.by_class(value, "secret")
        elif kind == "access":
            new = value[:4] + keyed.text(value[4:], "access", ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] * 16)
        else:
            new = getattr(keyed, kind)(value)
        parts += [text[done:start], new]
        size += start - done
        spans.append((kind, size, size + len(new)))
        size += len(new)
        done = end
        m = _FIND.search(text, m.end())
    return ("".join([*parts, text[done:]]), spans) if spans else (text, [])


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                   T.StructField("end", T.IntegerType())]))


def pseudonymise(docs: DataFrame, key: bytes, spans: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; with ``spans``, a further column of that name says where.

    Row by row, whole texts, no shuffle. Null text stays null (no spans); null ids and repeated rows
    are treated like any others, so equal rows stay equal; other columns pass unchanged, whatever their
    names; an empty table stays empty. Values that fail validation are left as they are.
    """
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *([T.StructField(spans, _SPANS)] if spans else [])])
    out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Pseudonyms(key)
        for part in parts:
            new, where = [], []
            for text in part.column(at):
                value, found = (None, []) if text.as_py() is None else pseudonymise_text(text.as_py(), keyed)
                new.append(value)
                where.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            columns = [*part.columns]
            columns[at] = pa.array(new, pa.string())
            if spans:
                columns.append(pa.array(where, out))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(batches, schema)


def session_key(spark) -> bytes:
    """The key named by the session; a fixed one for trials where it names none."""
    return spark.conf.get(KEY_CONF, "rollscope-trial-key").encode()
