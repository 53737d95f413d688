"""Secret scans by dictionary-primed compression novelty.

Three base patterns find assignments, access keys and long hex strings.  Other
secrets have no pattern but are strings that nothing predicts.  A candidate is
a long token shortly after a sensitive word; of a token NAME=value only the
value is one, and the name belongs to what comes before it.  Its novelty is what it adds to
the compressed size of its surroundings, by a zstandard compressor primed with
identifiers gathered from code: ordinary names, paths and repeats of nearby code add
little, random strings about as many bytes as they have characters.
Candidates that add more than NOVEL_SHARE of their length are reported.

Every document is judged on its own, from its whole text.

Edge cases: a null text is empty and has no spans; repeated rows get equal
results; a text of any length is scanned in one pass with a bounded window
around each candidate; an empty table yields no rows; columns besides those
asked for are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from importlib import resources
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm.text import arrow_batches
from ledgerloom.storage import stored

#: The base patterns and the least characters of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "novel")

LEAST_NOVEL = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_NOVEL},}}")
SENSITIVE = re.compile(r"(?:secret|token|key|passw|pwd|auth|bearer|credential|private|signature)", re.IGNORECASE | re.ASCII)
#: Characters before a candidate in which a sensitive word makes it one, and of surroundings on either side.
REACH, AROUND = 48, 256
#: Level and share by measurement: of random strings of 16 letters and more, from any of six alphabets, at least 0.98 add more;
#: of identifiers of code that the dictionary has not seen, 0.10 (snake_case) to 0.17 (file names).
LEVEL, NOVEL_SHARE = 3, 0.9
#: Identifiers and texts that configuration files are full of.
IDENTIFIERS = (
    "authorization authentication authenticate credential credentials password username secretkey access_key private_key public_key client_id client_secret "
    "configuration configure environment production development application controller repository implementation interface component template service "
    "request response session database connection string number boolean function return import export default constant parameter argument exception error "
    "message handler listener callback promise async await public private protected static final class abstract extends implements override namespace "
    "package module version license copyright document element attribute property value index length container initialize register dispatch subscribe "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx 0000000000000000 example.com https://www. http://localhost node_modules/"
)
#: Identifiers as programs write them, from rare to frequent: package data, so that every interpreter has the same.
#: Gathered once by ``gathered`` from Python 3.13.
WORDS_FILE = "identifiers.txt"
CODE = ("argparse", "configparser", "email.message", "http.client", "http.server", "json.decoder", "logging.config", "smtplib", "socketserver", "sqlite3.dbapi2", "ssl", "subprocess", "tarfile", "threading", "unittest.case", "urllib.request", "xml.etree.ElementTree", "zipfile")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{4,}")
FOUND = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("secret_start", T.IntegerType()), T.StructField("secret_end", T.IntegerType()),
])


class Span(NamedTuple):
    """What matched, and within it the secret itself; code points, end exclusive."""

    kind: str
    start: int
    end: int
    secret_start: int
    secret_end: int


def gathered(sources: Iterable[str]) -> list[str]:
    """The identifiers of some programs from rare to frequent: how WORDS_FILE was made from the modules of CODE."""
    n: dict[str, int] = {}
    for source in sources:
        for word in IDENTIFIER.findall(source):
            n[word] = n.get(word, 0) + 1
    return sorted(n, key=lambda w: (n[w], w))


@cache
def identifiers() -> str:
    """The dictionary: WORDS_FILE, then the fixed identifiers; what comes last is cheapest to refer to."""
    words = resources.files(__package__).joinpath(WORDS_FILE).read_text("utf-8").split()
    return " ".join([*words, IDENTIFIERS])


@cache
def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(identifiers().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False)


def novelty(candidate: str, before: str, after: str) -> float:
    """Compressed bytes that a candidate adds to its surroundings, per character of it."""
    compress = _compressor().compress
    around = f"{before}\n{after}\n".encode("utf-8", "surrogatepass")
    return (len(compress(around + candidate.encode())) - len(compress(around))) / len(candidate)


def base_spans(text: str) -> list[Span]:
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [Span("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [Span("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [Span("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]


def _novel(text: str, start: int, end: int, taken: list[tuple[int, int]], at: int) -> list[tuple[int, int]]:
    """What is novel in a candidate: of NAME=value the value, and the name if it is novel too; else the whole.

    ``taken`` from ``at`` on are the spans that may overlap the candidate.
    """

    def secret(s: int, e: int, reach: int) -> bool:
        if e - s < LEAST_NOVEL or not SENSITIVE.search(text, max(0, reach), s):
            return False
        k = at
        while k < len(taken) and taken[k][0] < e:
            if s < taken[k][1]:
                return False
            k += 1
        return novelty(text[s:e], text[max(0, s - AROUND) : s], text[e : e + AROUND]) > NOVEL_SHARE

    inner = text[start:end].rstrip("=")
    # A=B=value: after the first sign, or else after the last.
    for sign in dict.fromkeys((inner.find("="), inner.rfind("="))):
        name, value = start + sign, start + sign + 1
        while sign >= 0 and text[value] == "=":
            value += 1
        # The whole name comes before its value, however long it is.
        if sign >= 0 and secret(value, end, min(start, value - REACH)):
            return [*([(start, name)] if secret(start, name, start - REACH) else []), (value, end)]
    return [(start, end)] if secret(start, end, start - REACH) else []


def spans_of(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind as listed."""
    if not text:
        return []
    found = base_spans(text)
    taken = sorted((s.start, s.end) for s in found)
    at = 0
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        found += [Span("novel", s, e, s, e) for s, e in _novel(text, *m.span(), taken, at)]
    return sorted(found, key=lambda x: (x.start, KINDS.index(x.kind)))


def written(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def secrets(documents: DataFrame, kept: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``kept`` of documents with the spans of their secrets; stored."""
    source = documents.select(*kept, F.col(text_col).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("secret_spans", T.ArrayType(FOUND))])
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in spans_of(t)] for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, arrow.field(len(kept)).type)], schema=arrow)

    with arrow_batches(documents.sparkSession):
        return stored(source.mapInArrow(scan, schema), "secrets")


def masked(text: str | None, spans: list[Span], mask: str = "[SECRET]") -> str | None:
    """A text with each secret replaced; overlapping ones by one mask."""
    if not spans:
        return text
    out, at = [], 0
    for s, e in sorted((s.secret_start, s.secret_end) for s in spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """Documents with the secrets in their texts masked, all other columns as they are; computed when read."""
    arrow = to_arrow_schema(documents.schema)
    at = documents.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t, spans_of(t), mask) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, arrow.field(at).type) if k == at else c for k, c in enumerate(batch.columns)], schema=arrow)

    return documents.mapInArrow(clean, documents.schema)


def op9_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))
