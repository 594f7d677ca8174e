"""Secret scans: fixed patterns, and strings that zstandard finds new in a sensitive context.

Each candidate is measured by its marginal compressed bytes: the size of its line's
surroundings with it, less their size without it, both under a dictionary of common
code and identifier text. Prose and identifiers cost little; keys cost nearly their
entropy. Other occurrences of a candidate's value don't count as surroundings. A
candidate is reported as `novel` where its surroundings, or those of a line of its
block, name a credential and its cost a character is high. Pattern matches (assign, access, hex) are always
reported, with their own marginal bytes beside them.

Null and empty texts have no spans. Whole texts are scanned, very long ones in time that grows
with their length. Spans of one start come in the order of KINDS. Repeated rows give repeated
results, an empty table none. Positions are code points, ends exclusive. Only the id and text
columns are read (redaction keeps all), so others may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.llm.tables import read
from verdictspark.llm.words import pieces

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?a)(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_DIGIT = re.compile(r"[0-9]")
_WORDLIKE = re.compile(r"[A-Z]?[a-z]{3,}|(?<![A-Za-z0-9])[A-Z]{2,}(?![A-Za-z0-9])")
#: The password of an address, user:password@host, which names itself a credential.
_USERINFO = re.compile(r"://[^\s:/@]+:([^\s/@]{8,})@")
_SENSITIVE = re.compile(
    r"(?ai)pass(?:word|wd|phrase)|\bpass\b|pwd|secret|token|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|credential"
    r"|auth(?!or(?:s|ed|ing|ial|ship|itative|ity|ities)?\b)|bearer|signature|session(?!s\b)|cookie|cert(?:s|ificates?)?(?![a-z])(?!\x20of\b)|hmac|\bsalt\b(?!\x20[a-z])"
)

#: What stands between two parts of a block: a dot (as in signed tokens), or one line break (or an escaped one), quotes and signs of continuation.
_ADJOINS = re.compile(r"""\.|[ \t"',;>*#|]*(?:\r?\n|\r|\\)[ \t"',;>*#|]*\\?""")
#: The short last line of an encoded block, before its closing line.
_LAST = re.compile(r"""((?:[ \t"',;>*#|]*(?:\r?\n|\r|\\(?:r\\)?n))[ \t"',;>*#|]*[A-Za-z0-9+/=]{1,15})(?=[ \t"',;>*#|]*(?:\r?\n|\r|\\(?:r\\)?n)[ \t"',;>*#|]*-----END)""")
#: A name that stands for a value, as ${NAME} does.
_PLACEHOLDER = re.compile(r"\$?[{<(\[%]+[A-Za-z0-9_.-]+[}>)\]%]+")

#: Text that primes the compressor: what code and configuration commonly repeat.
IDENTIFIERS = """
import from return class function const let var public private static void int string bool true false null None self this new
def async await try except catch finally raise throw if else elif for while switch case break continue with yield lambda
config configuration settings environment production development staging default local server client host port database user
username password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret
authorization bearer session cookie signature credential certificate endpoint request response header content-type application/json
AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY GITHUB_TOKEN DATABASE_URL SECRET_KEY_BASE API_TOKEN AUTH_TOKEN PRIVATE_KEY SLACK_WEBHOOK
http://localhost:8080/ https://www.example.com/ index.html main.py app.js README.md package.json requirements.txt Makefile
get_value set_value create_user update_record delete_item find_by_id to_string from_json parse_args read_file write_file
getValue setValue createUser updateRecord deleteItem findById toString fromJson parseArgs readFile writeFile
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 2024-01-01T00:00:00Z 127.0.0.1 localhost
"""

_state: dict[str, zstandard.ZstdCompressor] = {}


def _compressor() -> zstandard.ZstdCompressor:
    if "c" not in _state:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=3)
        _state["c"] = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_dict_id=False)
    return _state["c"]


def _without(text: str, value: str, lo: int, hi: int, keep_end: bool) -> str:
    """text[lo:hi] less the occurrences of value, also those that the cut at its far end divides."""
    n = len(value)
    if keep_end:
        at = text.find(value, max(0, lo - n + 1), min(hi, lo + n - 1))
        lo = at + n if at >= 0 else lo
    else:
        at = text.rfind(value, max(lo, hi - n + 1), hi + n - 1)
        hi = at if at >= 0 else hi
    return text[lo:hi].replace(value, "")


def marginal_bytes(text: str, start: int, end: int, around: int) -> int:
    """Compressed bytes that text[start:end] adds to the `around` characters on either side.

    Other occurrences of the same string, or of the value behind its last =, are left out
    of the surroundings: a key given twice is as new as one given once.
    """
    c = _compressor()
    value = text[start:end]
    behind = value.rstrip("=").rpartition("=")[2]
    value = behind if len(behind) >= 8 else value
    before, after = _without(text, value, max(0, start - around), start, True), _without(text, value, end, min(len(text), end + around), False)
    near = f"{before}{after}".encode("utf-8", "replace")
    return len(c.compress(near + text[start:end].encode("utf-8", "replace"))) - len(c.compress(near))


def _blocks(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of candidates on adjoining lines; a short last line belongs to the line before it."""
    block: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(text):
        if block and not _ADJOINS.fullmatch(text, block[-1][1], m.start()):
            yield block
            block = []
        last = _LAST.match(text, m.end())
        block.append((m.start(), last.end(1) if last else m.end()))
    if block:
        yield block


def _merged(found: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Matches as disjoint intervals in order: their starts and ends."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(found, key=lambda f: f[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _overlaps(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    k = bisect_left(starts, b) - 1
    return k >= 0 and ends[k] > a


def scan(text: str, least: int = 16, ratio: float = 0.62, around: int = 96, reach: int = 48) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, marginal bytes) of a text's secrets, by start, then kind as listed.

    A novel candidate has `least` characters or more, letters and digits in its block, a
    sensitive word within `reach` characters of a line of its block, a marginal cost of
    `ratio` bytes a character or more, isn't mostly made of words (an identifier) or of
    letters of one case, and doesn't overlap a pattern's match. Parts joined by a dot are a block.
    The password of an address (user:password@host) needs eight characters, a digit or letters of both cases, and that cost.
    """
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    spans = [(k, a, b, marginal_bytes(text, a, b, around)) for k, a, b in found]
    starts, ends = _merged(found)
    for m in _USERINFO.finditer(text):
        a, b = m.span(1)
        if not _overlaps(starts, ends, a, b) and (_DIGIT.search(text, a, b) or text[a:b] not in (text[a:b].lower(), text[a:b].upper())) and not _PLACEHOLDER.fullmatch(text, a, b):
            cost = marginal_bytes(text, a, b, around)
            if cost >= ratio * (b - a):
                spans.append(("novel", a, b, cost))
                found.append(("novel", a, b))
    starts, ends = _merged(found)
    for block in _blocks(text):
        if not any(_DIGIT.search(text, a, b) for a, b in block) or not any(_SENSITIVE.search(text, max(0, a - reach), min(len(text), b + reach)) for a, b in block):
            continue
        for a, b in block:
            whole = text[a:b]
            if b - a < least or whole.isdigit() or _overlaps(starts, ends, a, b):
                continue
            if not _DIGIT.search(whole) and (whole.isupper() or whole.islower()):
                continue
            if sum(map(len, _WORDLIKE.findall(whole))) > 0.6 * (b - a):
                continue
            cost = marginal_bytes(text, a, b, around)
            if cost >= ratio * (b - a):
                spans.append(("novel", a, b, cost))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by [SECRET]."""
    out, at = [], 0
    for _, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_SPANS = "array<struct<kind: string, start: long, end: long, marginal_bytes: long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("marginal_bytes", pa.int64())]))


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def secret_spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and the array `found` of spans, for every row."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, found {_SPANS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            spans = [[dict(zip(("kind", "start", "end", "marginal_bytes"), s, strict=True)) for s in scan(t)] for t in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, _SPAN_TYPE)], names=["doc_id", "found"])

    return docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(run, schema)


def redacted(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The same rows and columns, secrets replaced in `text`, `length` brought up to date.

    Only texts with a secret change; null texts stay null.
    """

    def run(column: pa.Array) -> list[str | None]:
        return [t if not t or not (s := scan(t)) else redact(t, s) for t in column.to_pylist()]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            new = pa.array(run(batch.column(text)), pa.string())
            yield batch.set_column(batch.schema.get_field_index(text), pa.field(text, pa.string()), new)

    out = docs.mapInArrow(batches_of, docs.schema)
    if length not in docs.columns:
        return out
    kind = docs.schema[length].dataType
    return out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.length(text)).cast(kind))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base matches, their digest, and all spans of every document."""
    found = secret_spans(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(told(F.filter("found", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        told(F.col("found")).alias("spans"),
        count("novel").alias("n_novel"),
    )
