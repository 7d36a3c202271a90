"""Operator 9: secret scans.

One Aho-Corasick automaton of keywords passes over each text in C.  Only where a keyword
ends is the regular expression of its rule tried, anchored at the keyword's start.  A
match whose format embeds a checksum counts only if the checksum holds: the base-62 CRC-32
at the end of ghp_ and npm_ tokens, also where such a token is assigned to a name.  Only
those are reported as `valid`.  Other rules test what their format allows, without a
checksum: the account number inside AKIA key ids, the header of a JWT, or a minimal entropy.  What is assigned to a name with a
keyword in it is a secret from 16 characters on; neither it, the name nor the blanks
between them have a greatest length, and a text takes linear time all the same.

Defined cases: a null or empty text has no findings.  Findings carry the doc_id as it is,
null included, and a repeated row repeats them.  Offsets count characters of the original
text.  Where findings overlap, the one that starts first wins, then the more specific
rule, then the longer.  Very long texts are read whole.  Other columns are ignored by the
scan and passed on by the redaction, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matching import kept, lower_in_place

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_tail(body: str) -> str:
    """The six base-62 digits that end a token with an embedded CRC-32."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE62[digit] + out
    return out


def _crc_holds(secret: str) -> bool:
    body = secret.split("_", 1)[1]
    return crc_tail(body[:-6]) == body[-6:]


def _account_holds(secret: str) -> bool:
    """The account number that a key id carries in base 32 has twelve digits at most."""
    raw = int.from_bytes(base64.b32decode(secret[4:])[:6], "big")
    return (raw & 0x7FFFFFFFFF80) >> 7 < 10**12


def _header_holds(secret: str) -> bool:
    part = secret.split(".")[0]
    try:
        return isinstance(head := json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict) and "alg" in head
    except ValueError:
        return False


def entropy(secret: str) -> float:
    """Bits per character."""
    return _bits(Counter(secret)) if secret else 0.0


def _bits(counts: Counter) -> float:
    size = counts.total()
    return -math.fsum(n / size * math.log2(n / size) for n in counts.values())  # whatever the order of the counts


def _varied(secret: str) -> bool:
    return bool(secret) and _varied_counts(Counter(secret))


def _varied_counts(counts: Counter) -> bool:
    return _bits(counts) >= 3.0 and any(c.isdigit() for c in counts)


#: An assignment: the rest of the name from the keyword on, what is between name and value, a character of the value.  No length is bounded.
_NAME, _GIVEN, _VALUE = r"[\w-]*+", r"""["']?\s*+(?::=|=>|=|:)\s*+["']?""", "[A-Za-z0-9+/_=-]"

#: (rule, keywords in lower case, expression anchored at the keyword, group of the secret, what must hold, whether that is a checksum)
_RULES: list[tuple[str, tuple[str, ...], str, int, Callable[[str], bool], bool]] = [
    ("repository_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", 0, _crc_holds, True),
    ("package_token", ("npm_",), r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", 0, _crc_holds, True),
    ("cloud_key_id", ("akia", "asia"), r"A[KS]IA[A-Z2-7]{16}(?![A-Z0-9])", 0, _account_holds, False),
    ("web_token", ("eyj",), r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, _header_holds, False),
    ("project_token", ("glpat-",), r"glpat-[A-Za-z0-9_-]{20}(?![A-Za-z0-9_-])", 0, _varied, False),
    ("chat_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"xox[abprs]-[A-Za-z0-9-]{20,}+", 0, _varied, False),
    ("search_key", ("aiza",), r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", 0, _varied, False),
    ("payment_key", ("sk_live_", "rk_live_"), r"[sr]k_live_[A-Za-z0-9]{20,}", 0, _varied, False),
    ("private_key", ("-----begin ",), r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----[A-Za-z0-9+/=\s:,.()-]*?-----END \1-----", 0, lambda s: True, False),
    ("assigned_secret", ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "auth_key"), _NAME + _GIVEN + rf"({_VALUE}{{16,}}+)", 1, _varied, False),
]


_ASSIGNED = len(_RULES) - 1
_NAME_AT, _GIVEN_AT, _VALUE_AT = re.compile(_NAME), re.compile(rf"{_GIVEN}(?={_VALUE}{{16}})"), re.compile(f"{_VALUE}++")


def _automaton() -> tuple[ahocorasick.Automaton, list[re.Pattern]]:
    words = ahocorasick.Automaton()
    for rule, (_, keywords, *_rest) in enumerate(_RULES):
        for word in keywords:
            words.add_word(word, (rule, len(word)))
    words.make_automaton()
    return words, [re.compile(rule[2]) for rule in _RULES]


def _candidate(text: str, rule: int, pattern: re.Pattern, at: int) -> tuple[int, int, int] | None:
    name, _, _, group, holds, _ = _RULES[rule]
    if name != "assigned_secret" and at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return None
    hit = pattern.match(text, at)
    return (hit.start(group), hit.end(group), rule) if hit and holds(hit.group(group)) else None


def _assigned(text: str, places: list[int], rule: int) -> set[tuple[int, int, int]]:
    """_candidate() of assigned_secret at all these places, in ascending order, in linear time.

    Keywords in one name share its value, and values that end together share the counts of their common end.
    """
    name_end, value_end, values = -1, -1, []
    for at in places:
        if at < name_end:
            continue
        name_end = _NAME_AT.match(text, at).end()
        if hit := _GIVEN_AT.match(text, name_end):
            if hit.end() >= value_end:
                value_end = _VALUE_AT.match(text, hit.end()).end()
            values.append((hit.end(), value_end))
    found, counts, known, last = set(), Counter(), -1, -1
    for start, end in reversed(values):
        if end != last:
            counts, known, last = Counter(), end, end
        counts.update(text[start:known])
        known = start
        if _varied_counts(counts) and not _spoilt(text, start, end):
            found.add((start, end, rule))
    return found


def _spoilt(text: str, start: int, end: int) -> bool:
    """Whether a value has the whole form of a token with a checksum, and the checksum is wrong."""
    checked = (rule for rule in _RULES if rule[5] and text.startswith(rule[1], start))
    return any(re.compile(rule[2]).fullmatch(text, start, end) and not rule[4](text[start:end]) for rule in checked)


def _settle(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for start, end, rule in sorted(found, key=lambda x: (x[0], x[2], -x[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end, rule))
    return out


def find_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, number of the rule) of the secrets in a text, in order and apart from each other."""
    if not text:
        return []
    words, patterns = kept("secrets", _automaton)
    low = lower_in_place(text)
    places = [(end + 1 - size, rule) for end, (rule, size) in words.iter(low)]
    found = {_candidate(text, rule, patterns[rule], at) for at, rule in places if rule != _ASSIGNED}
    found |= _assigned(text, sorted(at for at, rule in places if rule == _ASSIGNED), _ASSIGNED)
    return _settle(found - {None})


def rule_name(rule: int) -> str:
    return _RULES[rule][0]


def has_checksum(rule: int) -> bool:
    return _RULES[rule][5]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "rule", "start", "end", "secret_sha256", "checksum"]
    for batch in batches:
        rows, at = [], []
        for i, text in enumerate(batch.column(1)):
            text = text.as_py()
            for start, end, rule in find_secrets(text):
                at.append(i)
                rows.append((rule_name(rule), start, end, hashlib.sha256(text[start:end].encode()).hexdigest(), "valid" if has_checksum(rule) else "none"))
        if rows:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)


def secret_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, start, end, secret_sha256, checksum), a row for each secret; the secret itself is not repeated."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, rule string, start bigint, end bigint, secret_sha256 string, checksum string")


def redacted(text: str | None) -> str | None:
    """The text with each secret replaced by [REDACTED:rule]."""
    found = find_secrets(text)
    if not found:
        return text
    out, at = [], 0
    for start, end, rule in found:
        out += [text[at:start], f"[REDACTED:{rule_name(rule)}]"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents, in all their columns, with redacted texts; n_chars, where there is one, follows the new text."""
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(place)
            new = {i: y for i, t in enumerate(texts) if (x := t.as_py()) and (y := redacted(x)) is not x}
            if new:
                values = texts.to_pylist()
                for i, y in new.items():
                    values[i] = y
                batch = batch.set_column(place, batch.schema.field(place), pa.array(values, texts.type))
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
