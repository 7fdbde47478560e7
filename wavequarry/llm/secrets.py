"""Secret scans: fixed patterns, and strings that a token vocabulary can't shorten."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The kinds in the order they are listed, their patterns, and the least lengths.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Least length of a run that may be a random string, unless another is given: shorter ones are told from words and names no longer.
RUN = 12
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Hexadecimal lengths of known digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
#: Parts of an identifier: words, abbreviations, numbers.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: A word has so many letters at least, and so many to a token: what a vocabulary knows is told from random letters by that.
WORD, KNOWN = 3, 2.5
#: Letters of one case alone are random under this share of the ratio, as rare and foreign words take many tokens too. From SURE
#: letters on the whole ratio counts: words of that length are compounds of known parts.
LETTERS, SURE = 0.75, 20


@functools.cache
def run_pattern(least: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_=-]{{{least},}}")


@functools.cache
def vocabulary(path: str):
    """A tiktoken encoding from a file of base64 tokens and ranks; one a Python worker, for all its tasks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", mergeable_ranks=ranks, special_tokens={})


def is_digest(run: str) -> bool:
    return len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run) is not None


def is_identifier(run: str, encoding) -> bool:
    """A UUID, a number, a path of words, or names joined by humps, _ - / + or =: all but a fifth of the letters and digits lie in such parts.

    A part of letters counts if the vocabulary shortens it, a number of up to four digits if no other letters touch it.
    """
    if run.isdigit() or UUID.fullmatch(run):
        return True
    parts = [(m.start(), m.end(), m[0]) for m in PART.finditer(run)]
    known = [len(t) >= WORD and len(t) >= KNOWN * len(encoding.encode_ordinary(t)) if t[0].isalpha() else None for _, _, t in parts]
    # Letters on either side, if they touch the number.
    before = [None, *[k if a[1] == b[0] else None for a, b, k in zip(parts, parts[1:], known)]]
    after = [*[k if a[1] == b[0] else None for a, b, k in zip(parts, parts[1:], known[1:])], None]
    covered = sum(len(t) for (_, _, t), k, x, y in zip(parts, known, before, after) if k or (k is None and len(t) <= 4 and x is not False and y is not False))
    return covered >= 0.8 * sum(c.isalnum() for c in run)


def is_random(run: str, encoding, ratio: float) -> bool:
    """At under ratio characters a token, less for letters of one case alone, and neither a number, a digest nor an identifier."""
    classes = any(c.isdigit() for c in run) + any(c.islower() for c in run) + any(c.isupper() for c in run[1:])
    letters = any(c.isalpha() for c in run)
    most = ratio if classes >= 2 or len(run) >= SURE else ratio * LETTERS
    return letters and len(run) < most * len(encoding.encode_ordinary(run)) and not is_digest(run) and not is_identifier(run, encoding)


def find(text: str, encoding, ratio: float, least: int = RUN) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in code points, by start, then kind as listed."""
    low, base = text.lower(), []
    if any(k in low for k in KEYS):
        base += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        base += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    runs = list(run_pattern(min(least, LEAST["hex"])).finditer(text))
    # A run of hexadecimal digits that is long enough lies within a run of the wider class.
    base += [(r.start() + h.start(), r.start() + h.end(), "hex") for r in runs for h in HEX.finditer(r[0]) if len(h[0]) >= LEAST["hex"]]
    free = [r for r in runs if len(r[0]) >= least and not any(s < r.end() and r.start() < e for s, e, _ in base)]
    found = base + [(*r.span(), "token") for r in free if is_random(r[0], encoding, ratio)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def spell(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, *, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", ratio: float = 2.0, least: int = RUN) -> DataFrame:
    """Secrets in every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token, values.

    A narrow pass over the texts, no shuffle. The base kinds match leftmost and without overlap within their kind; matches
    that are too short are dropped but use up their characters. The token kind adds runs of `least` or more characters that take
    more than one token for each `ratio` characters (letters of one case alone: LETTERS of it, under SURE of them), unless they overlap a base span or are digests or identifiers.
    values holds the matched texts. Null and empty texts have no spans (the digest of the empty text, an empty list);
    null ids stay null; repeated rows are scanned each; empty tables give no rows; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocabulary_path)
        for batch in batches:
            rows = [find(t.as_py() or "", encoding, ratio, least) for t in batch.column(1)]
            base = [[x for x in r if x[2] != "token"] for r in rows]
            count = lambda kind: pa.array([sum(x[2] == kind for x in r) for r in rows], pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
                "base_sha256": pa.array([hashlib.sha256(spell(b).encode()).hexdigest() for b in base], pa.string()),
                "spans": pa.array([spell(r) for r in rows], pa.string()), "n_token": count("token"),
                "values": pa.array([[t.as_py()[s:e] for s, e, _ in r] for t, r in zip(batch.column(1), rows, strict=True)], pa.list_(pa.string())),
            })

    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return narrow.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long, values array<string>")
