"""Secrets in texts: patterns, and strings that a tokenizer's vocabulary finds hard to shorten.

A byte-pair vocabulary writes language in few tokens; random characters need a token for every one or two. What remains of
long unbroken strings after known digests and identifiers is a secret if it has few characters per token, as a whole or in
any window of its tokens: a key at the end of a readable path is not averaged with the path.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import bounded_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary splits a text into pieces (fixed value of the vocabulary).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z]+| ?[0-9]+| ?[^\sa-zA-Z0-9]+|\s+"""
#: Characters per token below which a string counts as random. Prose in Latin letters has 2.5 and more, base64 1.3 to 1.8.
RATIO = 2.0
#: Shortest string judged.
LENGTH = 16

SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24}")
#: An unbroken string of the characters of keys.
UNBROKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LENGTH)

#: Digests with their name before them, in hexadecimal or base64 of the digest's length (fixed values).
_NAMED = r"(?:md5|sha1|sha224|sha256|sha384|sha512)[-_=](?:%s)" % "|".join((
    *("[0-9a-f]{%d}" % size for size in (32, 40, 56, 64, 96, 128)), *("[0-9A-F]{%d}" % size for size in (32, 40, 56, 64, 96, 128)),
    *("[A-Za-z0-9+/]{%d}%s" % size for size in ((22, "=="), (27, "="), (38, "=="), (43, "="), (64, ""), (86, "=="))),
))
#: Digests and identifiers that are not secrets, by shape (fixed values).
KNOWN = (
    re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"),
    re.compile(r"[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(_NAMED),
    re.compile(r"[0-9_+/=-]+"),
)
#: Digests (hexadecimal, or named and in base64) and identifiers as parts of a longer match; windows do not reach into them.
KNOWN_PARTS = re.compile(r"(?<![A-Za-z0-9])(?:%s)(?![A-Za-z0-9])" % "|".join((*(known.pattern for known in KNOWN[:3]), _NAMED)))
PART = re.compile(r"[A-Za-z0-9]+")


def _base_spans(text: str) -> list[tuple[int, int, str]]:
    """The pattern kinds: leftmost matches that do not overlap, by kind; matches that are too short are dropped after."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if HEX_LONG.search(text):
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return spans


_encodings: dict = {}


def _encoding(vocabulary: str):
    """The tokenizer of a vocabulary file, read once by each worker that meets a long string."""
    if vocabulary not in _encodings:
        _encodings[vocabulary] = _read_encoding(vocabulary)
    return _encodings[vocabulary]


def _read_encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


#: Longest string given to the tokenizer at once: its time grows with the square of an unbroken string.
PIECE = 4096


def characters_per_token(text: str, vocabulary: str = VOCABULARY) -> float:
    """Characters of a string for each token that the vocabulary writes it in."""
    encode = _encoding(vocabulary).encode_ordinary
    return len(text) / max(1, sum(len(encode(text[at : at + PIECE])) for at in range(0, len(text), PIECE)))


def _tokens(text: str, vocabulary: str) -> list[tuple[int, int]]:
    """Start and end of each token of letters or digits; tokens of separators count neither as tokens nor as characters."""
    encoding, found = _encoding(vocabulary), []
    for first in range(0, len(text), PIECE):
        at = first
        for token in encoding.encode_ordinary(text[first : first + PIECE]):
            end = at + len(encoding.decode_single_token_bytes(token))
            if text[at].isalnum():
                found.append((at, end))
            at = end
    return found


def _random_windows(text: str, ratio: float, vocabulary: str) -> list[tuple[int, int]]:
    """Spans of a match in which windows of its tokens are random: of each token on, the fewest that have LENGTH characters.

    Windows that meet are one span, grown to the ends of the parts between separators that it touches. Separators are passed
    over, so that neither a path's nor a key's own slashes count. Digits alone are not judged.
    """
    spans: list[tuple[int, int]] = []
    for first, last in _between(text, KNOWN_PARTS):
        part, end, size = text[first:last], 0, 0
        tokens = _tokens(part, vocabulary)
        for begin, (start, stop) in enumerate(tokens):
            while end < len(tokens) and size < LENGTH:
                size += tokens[end][1] - tokens[end][0]
                end += 1
            if size < LENGTH:
                break
            until = tokens[end - 1][1]
            if size < ratio * (end - begin) and any(c.isalpha() for c in part[start:until]):
                if spans and first + start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], first + until)
                else:
                    spans.append((first + start, first + until))
            size -= stop - start
    grown: list[tuple[int, int]] = []
    parts = [m.span() for m in PART.finditer(text)] if spans else []
    at = 0
    for start, until in spans:
        while parts[at][1] <= start:
            at += 1
        start = min(start, parts[at][0])
        while parts[at][1] < until:
            at += 1
        until = max(until, parts[at][1])
        if not text[until:].strip("="):
            until = len(text)
        if grown and start <= grown[-1][1]:
            grown[-1] = (grown[-1][0], until)
        else:
            grown.append((start, until))
    return grown


def _between(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """The stretches of a text that no match of the pattern covers."""
    edges = [0, *(edge for m in pattern.finditer(text) for edge in m.span()), len(text)]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= LENGTH]


def _random_spans(text: str, ratio: float, vocabulary: str) -> list[tuple[int, int]]:
    """The random parts of a match of UNBROKEN: all of it, or the windows that are."""
    if any(known.fullmatch(text) for known in KNOWN):
        return []
    return [(0, len(text))] if characters_per_token(text, vocabulary) < ratio else _random_windows(text, ratio, vocabulary)


def spans_of(text: str | None, ratio: float = RATIO, vocabulary: str = VOCABULARY) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, by start, then kind as listed."""
    text = text or ""
    found = _base_spans(text)
    for m in UNBROKEN.finditer(text):
        found += [(m.start() + a, m.start() + b, "random") for a, b in _random_spans(m[0], ratio, vocabulary)]
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2]), span[1]))


def find(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", ratio: float = RATIO,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """The secrets of every document: doc_id, secrets array of (start, end, kind).

    Positions are code points, the end exclusive. The vocabulary file must exist at the same path on every executor. Missing
    and empty texts have no spans; long texts are read whole; repeated rows stay repeated; an empty table gives no rows;
    other columns are ignored. Spans of different kinds may cover the same characters; all are kept.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [
                [{"start": a, "end": b, "kind": k} for a, b, k in spans_of(text, ratio, vocabulary)]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, SPANS)], ["doc_id", "secrets"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"doc_id {kind}, secrets array<struct<start:int,end:int,kind:string>>"
    )


def redacted(text: str | None, ratio: float = RATIO, vocabulary: str = VOCABULARY, mark: str = "[secret]") -> str | None:
    """The text with each maximal run of secret characters replaced by a mark."""
    if not text:
        return text
    pieces, done = [], 0
    for start, end, _ in spans_of(text, ratio, vocabulary):
        if start >= done:
            pieces += [text[done:start], mark]
        done = max(done, end)
    return "".join(pieces) + text[done:]


def redact(docs: DataFrame, text_column: str = "text", ratio: float = RATIO, vocabulary: str = VOCABULARY) -> DataFrame:
    """The same rows and columns, with secrets in the text replaced by a mark; texts without one are unchanged."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            clean = [redacted(text, ratio, vocabulary) for text in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)

