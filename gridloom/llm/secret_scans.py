"""Secret scans: pattern spans, and spans whose decoded bytes have the structure of a key or signed token."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import byte_batches, texts

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 characters or more
_CUES = ("passw", "secret", "token", "apikey", "api_key")

#: Kinds in the order of a tie; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem")
#: A candidate begins where no letter or digit stands before it: after =, /, -, _ and + too, as its structure decides.
_AT = r"(?<![A-Za-z0-9])"
#: A token's header is a JSON object: 0x7B and a quotation mark or white space encode to ey or ew.
_TOKEN_CUE = re.compile(r"e[yw][A-Za-z0-9_-]{9}")
_TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]+")
_TOKEN_START = re.compile(_AT + r"e[yw]")
_SIGNED = re.compile(r"\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*|\.\.[A-Za-z0-9_-]{16,}")
_ENCRYPTED = re.compile(r"\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+){3}")
_BLANK_END = re.compile(r"\s*\Z")
_JSON = json.JSONDecoder()
_DER = re.compile(_AT + r"M[A-P][A-Za-z0-9+/_-]{8}")  # 0x30, which begins an ASN.1 sequence, encodes to MA to MP
_SSH_KEY = re.compile(_AT + r"b3BlbnNzaC1rZXktdjEA")
_SSH_BLOB = re.compile(_AT + r"AAAA[A-Za-z0-9+/_-]{24,}={0,2}")
_PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY|CERTIFICATE)-----")
_PEM_BREAK = re.compile(r"(?:\s|\\[rn])*+")
_PEM_HEADER = re.compile(r"[A-Z][A-Za-z-]{2,40}: [^\n\\]*+")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s\\]++")
_PEM_CODED = re.compile(_AT + r"LS0tLS1CRUdJTi")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:30|000000|6[Ff]70656[Ee]7373|2[Dd]2[Dd]2[Dd]2[Dd]2[Dd]424547494[Ee])[0-9A-Fa-f]{46,}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_WRAP = re.compile(r"[ \t]*(?:\\r)?(?:\\n|\r?\n)[ \t]*(?=[A-Za-z0-9+/_-])")
_MAGIC = b"openssh-key-v1\0"
#: ASN.1 elements nest so deep at most.
DEPTH = 32


class Run:
    """Base64 characters from a place of a text on, over line wraps, read as far as they are asked for."""

    def __init__(self, text: str, at: int):
        self.text, self.parts, self.size, self.next = text, [], 0, at

    def take(self, need: int | None) -> str | None:
        """The first `need` characters (None: all of the run), or None if the run has fewer."""
        while (need is None or self.size < need) and self.next is not None:
            m = _LINE.match(self.text, self.next)
            self.parts.append((m.start(), m[0]))
            self.size += len(m[0])
            wrap = _WRAP.match(self.text, m.end())
            self.next = wrap.end() if wrap else None
        if need is not None and self.size < need:
            return None
        return "".join(p for _, p in self.parts)[:need]

    def end(self, used: int) -> tuple[int, bool]:
        """Where the first `used` characters and their padding end in the text, and whether the run ends there too."""
        for start, part in self.parts:
            if used <= len(part):
                at = start + used
                break
            used -= len(part)
        more = self.text[at : at + 1]
        while self.text[at : at + 1] == "=":
            at += 1
        return at, not (more.isascii() and (more.isalnum() or more in ("+", "/")) and more != "")

    def bytes(self, n: int) -> bytes | None:
        part = self.take(-(-n * 4 // 3))
        return None if part is None else (decode64(part) or b"")[:n]


def decode64(s: str) -> bytes | None:
    """Bytes of plain or URL-safe base64, with or without padding; None if it isn't any."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes, at: int = 0) -> tuple[int, int] | None:
    """(start, end) of the value of the ASN.1 element at `at`, if its length is well formed and fits."""
    if at + 2 > len(data):
        return None
    first, start = data[at + 1], at + 2
    if first < 128:
        n = first
    else:
        k = first & 127
        if not 1 <= k <= 4 or start + k > len(data) or data[start] == 0:
            return None
        n, start = int.from_bytes(data[start : start + k], "big"), start + k
        if n < 128:
            return None
    return (start, start + n) if start + n <= len(data) else None


def is_der(data: bytes) -> bool:
    """A sequence that fills data, whose elements fill it in turn, two at least, the first an integer or a sequence.

    Elements within elements are parsed likewise, down to DEPTH; plain ones have the lengths that their tags allow.
    """
    if not data or data[0] != 0x30 or not (outer := der_length(data)) or outer[1] != len(data):
        return False
    tags, open_at = [], [outer]
    while open_at:
        at, end = open_at.pop()
        if at == end:
            continue
        tag = data[at]
        if tag & 0x1F == 0x1F or not (inner := der_length(data, at)) or inner[1] > end:
            return False
        if not open_at:
            tags.append(tag)
        open_at.append((inner[1], end))
        size = inner[1] - inner[0]
        if tag & 0x20:
            if len(open_at) >= DEPTH:
                return False
            open_at.append(inner)
        elif (tag in (0x02, 0x0A) and not size) or (tag == 0x01 and size != 1) or (tag == 0x05 and size) or (tag == 0x03 and (not size or data[inner[0]] > 7)):
            return False
        elif tag == 0x06 and (not size or data[inner[1] - 1] & 0x80):
            return False
    return len(tags) >= 2 and tags[0] in (0x02, 0x30)


def ssh_container(read, limit: int) -> int | None:
    """Length of an OpenSSH private key container: magic, cipher, kdf, its options, count, public keys and private part.

    read(n) gives the first n bytes or None; a field that would go beyond limit bytes fails before it is read.
    """
    at = len(_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        head = read(at + 4)
        if head is None or len(head) < at + 4:
            return None
        n = int.from_bytes(head[at : at + 4], "big")
        if at + 4 + n > limit:
            return None
        data = read(at + 4 + n)
        if data is None or len(data) < at + 4 + n:
            return None
        at += 4 + n
        return data[at - n : at]

    if (read(at) or b"") != _MAGIC:
        return None
    cipher, kdf = field(), field()
    if not cipher or not kdf or not re.fullmatch(rb"[a-z0-9@.+-]+", cipher) or not re.fullmatch(rb"[a-z0-9@.+-]+", kdf):
        return None
    if (options := field()) is None or (kdf == b"none") != (cipher == b"none") or (kdf == b"none") != (not options):
        return None
    count = read(at + 4)
    if count is None or len(count) < at + 4 or not 1 <= (n := int.from_bytes(count[at : at + 4], "big")) <= 64:
        return None
    at += 4
    for _ in range(n):
        if not (key := field()) or not is_ssh(key):
            return None
    private = field()
    return at if private and len(private) % 8 == 0 else None


def is_ssh(data: bytes) -> bool:
    """An OpenSSH private key, or length-prefixed fields of which the first names a key type."""
    if data.startswith(_MAGIC):
        return ssh_container(lambda n: data[:n], len(data)) == len(data)
    at, fields = 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(data) and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", fields[0]) is not None


def token_header(data: bytes, text: str, at: int) -> dict | None:
    """The JSON object that fills data from byte `at` on, if it names its algorithm, as the header of a token does; text is data in Latin-1."""
    try:
        head, end = _JSON.raw_decode(text, at)
        if not _BLANK_END.match(text, end):
            return None
        data[at:].decode()
    except (ValueError, RecursionError):
        return None
    return head if isinstance(head, dict) and isinstance(head.get("alg"), str) else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind that are long enough."""
    out = []
    low = text.lower()
    if any(c in low for c in _CUES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _tokens(text: str):
    """Signed tokens (three parts, or two where the content is detached) and encrypted ones (five).

    A header reaches to the end of its run of characters. The run is decoded once for each of four alignments; a start's
    JSON begins at its byte there. At a later start, which stands in a string for the JSON before it, the quotation mark
    ends that string and begins one for the new JSON, so of two that go on one fails soon: the cost is linear.
    """
    at = 0
    while cue := _TOKEN_CUE.search(text, at):
        run = _TOKEN_RUN.match(text, cue.start())
        begin, end = cue.start(), run.end()
        while begin > at and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "-_"):
            begin -= 1
        at = end
        if text[end : end + 1] != ".":
            continue
        decoded: dict[int, tuple[int, bytes, str]] = {}
        for m in _TOKEN_START.finditer(text, begin, end):
            k = m.start() % 4
            if k not in decoded:
                data = decode64(text[m.start() : end]) or b""
                decoded[k] = m.start(), data, data.decode("latin-1")
            first, data, plain = decoded[k]
            head = token_header(data, plain, (m.start() - first) // 4 * 3) if data else None
            rest = (_ENCRYPTED.match(text, end) if "enc" in head else None) or _SIGNED.match(text, end) if head else None
            if rest:
                yield "jwt", m.start(), rest.end()
                at = rest.end()
                break


def _sequences(text: str):
    """ASN.1 sequences in base64: their own length says where they end, over line wraps too."""
    at = 0
    while m := _DER.search(text, at):
        at = m.start() + 1
        head = decode64(m[0][:8]) or b""
        k = head[1] & 127 if head[1] >= 128 else 0
        if k > 3 or (head[1] >= 128 and not k) or head[2 + k] not in (0x02, 0x30):
            continue  # no definite length, or the first element isn't an integer or a sequence
        n = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])
        if n < 24 or n > len(text):
            continue
        run = Run(text, m.start())
        data = run.bytes(n)
        if data is not None and len(data) == n and is_der(data):
            end, alone = run.end(-(-n * 4 // 3))
            if alone:
                yield "der", m.start(), end
                at = end


def _containers(text: str):
    at = 0
    while m := _SSH_KEY.search(text, at):
        at = m.end()
        run = Run(text, m.start())
        if n := ssh_container(run.bytes, len(text)):
            at, _ = run.end(-(-n * 4 // 3))
            yield "ssh", m.start(), at


def _coded_pems(text: str):
    """Base64 of a whole PEM text."""
    at = 0
    while m := _PEM_CODED.search(text, at):
        run = Run(text, m.start())
        part = run.take(None)
        at, _ = run.end(len(part))
        data = decode64(part[: len(part) - (len(part) % 4 == 1)])
        if data and any(True for _ in _pems(data.decode("latin-1"))):
            yield "pem", m.start(), at


def _pems(text: str):
    """PEM blocks. Header lines are read one by one; a line that several blocks begin before is read once."""
    after: dict[int, int] = {}  # by where header lines may begin: where they end
    at = 0
    while m := _PEM_BEGIN.search(text, at):
        at = m.end()
        body_at, walked = m.end(), []
        while body_at not in after:
            walked.append(body_at)
            header = _PEM_HEADER.match(text, _PEM_BREAK.match(text, body_at).end())
            if not header:
                break
            body_at = header.end()
        body_at = after.get(body_at, body_at)
        after.update(dict.fromkeys(walked, body_at))
        body, last = _PEM_BODY.match(text, body_at), f"-----END {m[1]}-----"
        if not body or not text.startswith(last, body.end()):
            continue
        at = body.end() + len(last)
        data = decode64(re.sub(r"\\[rn]|\s", "", body[0])) or b""
        coded = text.find("ENCRYPTED", m.end(), body_at) >= 0 and len(data) >= 16 and len(data) % 8 == 0
        if coded or is_der(data) or is_ssh(data):
            yield "pem", m.start(), at


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates whose decoded content has the structure of a key or of a signed token."""
    out = list(_sequences(text))
    if "ey" in text or "ew" in text:
        out += _tokens(text)
    for m in _HEX_RUN.finditer(text):
        data = bytes.fromhex(m[0][: len(m[0]) & ~1])
        if data[:5] == b"-----" and any(True for _ in _pems(data.decode("latin-1"))):
            out.append(("pem", *m.span()))
        elif len(m[0]) % 2 == 0 and (is_der(data) or is_ssh(data)):
            out.append(("der" if data[0] == 0x30 else "ssh", *m.span()))
    if "AAAA" in text:
        out += [("ssh", *m.span()) for m in _SSH_BLOB.finditer(text) if is_ssh(decode64(m[0]) or b"")]
    if "b3BlbnNzaC1" in text:
        out += _containers(text)
    if "-----BEGIN " in text:
        out += _pems(text)
    if "LS0tLS1CRUdJTi" in text:
        out += _coded_pems(text)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan_secrets(df: DataFrame, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, base_spans and spans (arrays of kind, start, end in code points) for each row of df (doc_id, text).

    Base spans always stay; the structural kinds come on top of them. A null text is the empty one and
    has no spans. Rows that repeat give a row each, a null doc_id stays null, an empty table gives an
    empty result, further columns are ignored. The cost is linear in the text: nothing is cut.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for ids, batch in byte_batches(batches, batch_bytes):
            base = [base_spans(t) for t in batch]
            more = [b + confirmed_spans(t) for b, t in zip(base, batch, strict=True)]
            cells = [[[{"kind": k, "start": a, "end": b} for k, a, b in sorted(x, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))] for x in xs] for xs in (base, more)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cells[0], kind), pa.array(cells[1], kind)], ["doc_id", "base_spans", "spans"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return texts(df).mapInArrow(run, f"doc_id long, base_spans {spans}, spans {spans}")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
