"""Secret scans: a keyword automaton over the whole text, regular expressions anchored at its hits, then checksums.

The automaton (Aho-Corasick) finds every keyword in one pass; only there is a
regular expression tried, anchored at the hit, so that text without keywords
costs one pass and nothing else. Formats that embed a checksum or a checkable
structure are then validated, and what fails is no finding.

Defined results: null or empty text has no findings; a text of any length is
scanned whole; repeated rows give their findings each; of overlapping findings
the one that starts first stays, then the longest, then the first kind by
name; spans count code points and are half open. Other columns are ignored by
scan() and passed through by redact().
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc62(body: str) -> str:
    """CRC-32 of a token's body as six base-62 digits, the checksum of several vendors' tokens."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out


def _crc_tail(token: str) -> bool:
    body = token.split("_", 1)[1]
    return crc62(body[:-6]) == body[-6:]


def _json_web_token(token: str) -> bool:
    try:
        head, body, _ = token.split(".")
        both = [json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (head, body)]
        return all(isinstance(x, dict) for x in both) and "alg" in both[0]
    except (ValueError, binascii.Error):
        return False


def _key_block(block: str) -> bool:
    """The base64 body is DER whose outer length is the body's length, or an OpenSSH key, or, where a header says so, encrypted in whole blocks."""
    locked = "Proc-Type: 4,ENCRYPTED" in block
    inner = re.sub(r"-----[^-]+-----|^[A-Za-z-]+: .*$|\s", "", block, flags=re.M)
    try:
        der = base64.b64decode(inner, validate=True)
    except (ValueError, binascii.Error):
        return False
    if locked:
        return len(der) >= 16 and len(der) % 8 == 0
    if der.startswith(b"openssh-key-v1\0"):
        return True
    if len(der) < 4 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return der[1] + 2 == len(der)
    n = der[1] & 0x7F
    return int.from_bytes(der[2 : 2 + n], "big") + 2 + n == len(der)


def _mod_97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _distinct(value: str) -> bool:
    """A value of a keyword's assignment: random enough to be a credential."""
    return len(set(value)) >= 8 and any(c.isdigit() for c in value)


_WORDS = [f(w) for w in ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth_key") for f in (str.lower, str.upper, str.title)]
_IBAN = ["IBAN", "iban", "Iban"]

#: kind: keywords, expression anchored at the keyword (group v, if there is one, is the secret), validation, whether it is a checksum.
RULES: dict[str, tuple[list[str], str, object, bool]] = {
    "github_token": (["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", _crc_tail, True),
    "npm_token": (["npm_"], r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", _crc_tail, True),
    "private_key": (["-----BEGIN"], r"-----BEGIN (?P<n>[A-Z ]*PRIVATE KEY)-----\s*(?:[A-Za-z-]+: [^\n]*\n)*[A-Za-z0-9+/=\s]+-----END (?P=n)-----", _key_block, True),
    "json_web_token": (["eyJ"], r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", _json_web_token, True),
    "iban": (_IBAN, r"[Ii](?:BAN|ban)\s*[:=]?\s*(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", _mod_97, True),
    "aws_key_id": (["AKIA", "ASIA"], r"(?:AKIA|ASIA)[A-Z2-7]{16}(?![A-Za-z0-9])", None, False),
    "stripe_key": (["sk_live_", "rk_live_", "sk_test_", "rk_test_"], r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", None, False),
    "sendgrid_key": (["SG."], r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}(?![A-Za-z0-9_-])", None, False),
    "slack_token": (["xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"], r"xox[bpars]-[A-Za-z0-9-]{10,}", None, False),
    "google_key": (["AIza"], r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", None, False),
    "gitlab_token": (["glpat-"], r"glpat-[A-Za-z0-9_-]{20,}", None, False),
    "assigned": (_WORDS, r"[A-Za-z_]+[\"']?\s{0,3}(?:=|:|=>|:=)\s{0,3}[\"']?(?P<v>[A-Za-z0-9_+/=.-]{16,})", _distinct, False),
}
#: Characters before a keyword that make it the middle of a longer word; a keyword of an assignment may follow an underscore or a letter.
_GLUE = re.compile(r"[A-Za-z0-9]")


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    for kind, (words, *_) in RULES.items():
        for w in words:
            kinds.setdefault(w, []).append(kind)
    for w, of in kinds.items():
        out.add_word(w, (w, of))
    out.make_automaton()
    return out


def find(text: str | None, words: ahocorasick.Automaton, rules: dict[str, re.Pattern]) -> list[tuple[int, int, str, str]]:
    """The findings in a text: start, end, kind, and checksum "valid" or "none"."""
    if not text:
        return []
    got = []
    for last, (word, kinds) in words.iter(text):
        at = last - len(word) + 1
        for kind in kinds:
            if kind != "assigned" and at and _GLUE.match(text, at - 1):
                continue
            m = rules[kind].match(text, at)
            if not m:
                continue
            group = "v" if "v" in m.re.groupindex else 0
            _, _, check, sums = RULES[kind]
            if check is None or check(m[group]):
                got.append((m.start(group), m.end(group), kind, "valid" if sums else "none"))
    if len(got) < 2:
        return got
    got.sort(key=lambda x: (x[0], -x[1], x[2]))
    kept = [got[0]]
    for x in got[1:]:
        if x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each finding: id, kind, span, checksum, and the SHA-256 of the secret, which itself is not repeated."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rules = automaton(), {k: re.compile(r[1]) for k, r in RULES.items()}
        for b in batches:
            ids, rows = b.column(0), []
            for i, v in enumerate(b.column(1)):
                text = v.as_py()
                rows += [(i, *f, hashlib.sha256(text[f[0] : f[1]].encode()).hexdigest()) for f in find(text, words, rules)]
            i, start, end, kind, check, digest = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i, pa.int64())), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(check, pa.string()), pa.array(digest, pa.string())], names=["doc_id", "kind", "start", "end", "checksum", "secret_sha256"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(kernel, "doc_id long, kind string, start long, end long, checksum string, secret_sha256 string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows as they are, with each secret replaced by <secret:kind>; length_col, if present, gets the new length of changed texts."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    size = names.index(length_col) if length_col in names else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rules = automaton(), {k: re.compile(r[1]) for k, r in RULES.items()}
        for b in batches:
            texts, changed = [v.as_py() for v in b.column(at)], {}
            for i, t in enumerate(texts):
                if found := find(t, words, rules):
                    parts, last = [], 0
                    for start, end, kind, _ in found:
                        parts += [t[last:start], f"<secret:{kind}>"]
                        last = end
                    changed[i] = "".join(parts) + t[last:]
            if changed:
                columns = list(b.columns)
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[at].type)
                if size is not None:
                    columns[size] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(columns[size].to_pylist())], columns[size].type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(kernel, schema)
