"""Secret scans: fixed patterns, and strings that zstandard cannot explain.

A candidate is a long mixed run of secret-like characters with a sensitive
word shortly before it. Its novelty is what it adds to the compressed size of
the code around it, with a compressor primed by a dictionary of identifiers:
names and copies of nearby text cost next to nothing, random keys cost most of
their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a shorter maximal run fails anyway
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A mixed run; = only pads its end, so a name and its value are apart in name=value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LEAST_CHARS = 16
CONTEXT = re.compile(r"(?:password|passwd|secret|token|api_?key|access_?key|private_?key|credential|auth|bearer|signature)", re.I | re.A)
JOINS, DIGIT = "_/-", re.compile(r"[0-9]")
LONGEST_WORD, CONTEXT_CHARS, AROUND = 12, 48, 400
#: Compressed bytes added per character from which a string counts as novel:
#: random base64 costs 0.75 to 0.9, hexadecimal 0.5 to 0.6, identifiers under 0.4.
NOVELTY = 0.5

#: Identifiers that code is full of.
IDENTIFIERS = """abstract address algorithm allocate append application argument array assert async attribute authorization
await background backup basename batch boolean boundary buffer build bytes cache callback cancel canonical capacity catch
category certificate channel character charset checksum children class client clone close cluster column command commit
compare component compress config connection console const constructor container content context controller cookie copy
counter create credentials current cursor database datetime debug decimal declare decode default delegate delete dependency
deploy description destination device dictionary directory disable dispatch display document domain double download driver
element email enable encode encoding endpoint entity environment error event exception execute export expression extends
extension factory feature field file filter final finally flag float folder format function gateway generate global handler
header height hidden hostname identifier implements import include index initialize input insert instance integer interface
internal interval invalid iterator javascript keyboard language length library license listener loader local location logger
manager mapping margin master match maximum message metadata method migration minimum model module monitor namespace network
number object offset operation operator option order output override package padding parameter parent parse password pattern
payload permission pipeline placeholder plugin pointer policy position prefix primary private process production profile
project promise property protected protocol provider proxy public publish query queue random range record recursive redirect
reference register release remote remove render repository request require resource response result return revision router
sample schedule schema scope script search secret section security select separator sequence serialize server service session
settings shared signature single singleton snapshot socket source static status storage stream string struct subscribe
success summary suffix switch symbol synchronized system table target template temporary terminal testing thread throw
timeout timestamp token trace transaction transform translate trigger undefined unicode unique update upload username utils
validate value variable vector vendor verbose version virtual volume warning webhook widget width window worker wrapper
function(self, args, kwargs) return None true false null def class import from if else for while try except public static void
api_key = os.environ["API_KEY"] password = getpass.getpass() access_token secret_key private_key client_secret auth_header"""


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, in order; kinds: assign, access, hex."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _value(text: str, start: int, end: int) -> int | None:
    """Where the value starts in a candidate that is a sensitive name and its value, joined by a character of both; None if it is not.

    No digit stands before the name's end, and no joining character in the
    value, or it would be a longer name. So the name ends with the last joining
    character, and is looked for from there, in one pass.
    """
    value = max(text.rfind(c, start, end) for c in JOINS) + 1
    if value <= start or DIGIT.search(text, start, value):
        return None
    name = text[start:value].rstrip(JOINS)
    # The sensitive word may end anywhere in the letters before the joining character.
    letters, at = len(name), len(name) - 1
    while at >= 0 and name[at].isascii() and name[at].isalpha():
        letters, at = at, at - 1
    return value if any(m.end() >= letters for m in CONTEXT.finditer(name, max(0, letters - LONGEST_WORD))) else None


class Novelty:
    """Marginal compressed bytes of a string in its surroundings."""

    def __init__(self, level: int = 3):
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False)

    def of(self, text: str, start: int, end: int) -> float:
        around = text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]
        size = lambda s: len(self.compressor.compress(s.encode("utf-8", "replace")))
        return (size(around + "\n" + text[start:end]) - size(around)) / (end - start)

    def spans(self, text: str) -> list[tuple[int, int]]:
        if not CONTEXT.search(text):
            return []
        out = []
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            told = CONTEXT.search(text, max(0, start - CONTEXT_CHARS), start)
            if (value := _value(text, start, end)) is not None:
                told, start = True, value
            s = text[start:end]
            if told and len(s) >= LEAST_CHARS and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and self.of(text, start, end) >= NOVELTY:
                out.append((start, end))
        return out


NAMES = ("assign", "access", "hex", "novel")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    for batch in T.sliced(batches):
        rows = []
        for text in pc.fill_null(batch["text"], "").to_pylist():
            base = base_spans(text)
            told = ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in base)
            every = sorted(base + [(a, 3, b) for a, b in novelty.spans(text)])
            n = [sum(k == kind for _, k, _ in every) for kind in range(4)]
            rows.append((*n, hashlib.sha256(told.encode()).hexdigest(), ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in every)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        arrays = [batch["doc_id"].cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans of every row of docs (doc_id, text).

    spans are kind:start:end in code points, end exclusive, by start and then
    by kind as listed; base_sha256 is that of the spans without the novel ones.
    Null and empty texts have none. Rows that repeat a doc_id get a row each; a
    null doc_id stays null. Other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(T.task(_scan), SCHEMA)
