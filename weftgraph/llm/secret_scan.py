"""Secret scans: patterns of known kinds, and a token-efficiency test for random strings of unknown kind.

A byte-pair vocabulary made from ordinary text spends few characters a token on random strings.  Candidates are runs
of letters, digits and `+/_-=.` of 16 characters or more; those whose characters a token stay below EFFICIENCY are
secrets of kind `random`.  In a run that isn't, so that ordinary words don't hide a secret beside them, candidates are its
pieces between `+/_-=.`, and stretches of pieces without ordinary ones (numbers, UUIDs, and letters that are one token
or not below EFFICIENCY).  Known digests are excluded: strings that are listed as known, and hex digits of a digest's
length (32, 40, 56, 64, 96 or 128) behind a word that names a digest (DIGEST_NAME).  So are UUIDs, numbers, candidates
that a base span overlaps, and letters without digits that are, or have among their pieces, words and identifiers
(IDENTIFIER: humps of a camel case of four letters or more each; WORD: fewer than 20 letters of one case, a capital first
letter aside).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import jobs

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut into pieces before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EFFICIENCY, LEAST = 2.1, 16
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{15,}[A-Za-z0-9+/_=-]")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
#: Words that name a digest, and the characters before it among which they are looked for.
DIGEST_NAME, BEFORE = re.compile(r"(?i)\b(?:sha-?[0-9]+|md5|blake[0-9]?[a-z]?|commit|checksum|digest|etag|integrity|revision|blob)\b[^A-Za-z0-9]*$", re.ASCII), 32
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")
PIECE = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
IDENTIFIER = re.compile(r"(?:[a-z]{4,}|[A-Z]{4,}(?![a-z]))?(?:[A-Z][a-z]{3,}|[A-Z]{4,}(?![a-z]))+|[A-Z]?[a-z]+(?:[A-Z][a-z]{3,})+")
WORD = re.compile(r"[A-Z]?[a-z]{,19}|[A-Z]{,19}")
LETTERS = re.compile("[A-Za-z]+")
KEYWORD = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary at path, read once in each Python worker."""
    if path not in _ENCODINGS:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODINGS[path] = tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds; code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if KEYWORD.search(text) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, taken: list[tuple[int, int, int]], vocabulary: str, known: frozenset[str] = frozenset(), efficiency: float = EFFICIENCY) -> list[tuple[int, int, int]]:
    def below(part: str) -> bool:
        return len(part) < efficiency * len(encoding(vocabulary).encode_ordinary(part))

    def secret(part: str, start: int) -> bool:
        if len(part) < LEAST or part in known or UUID.fullmatch(part):
            return False
        if len(part) in DIGEST_LENGTHS and DIGEST.fullmatch(part) and DIGEST_NAME.search(text[max(0, start - BEFORE) : start]):
            return False
        if any(a < start + len(part) and start < b for a, _, b in taken):
            return False
        if not MIXED.match(part):
            pieces = LETTERS.findall(part)
            if len(pieces) != 1 + len(part) - sum(map(len, pieces)) or any(IDENTIFIER.fullmatch(p) or WORD.fullmatch(p) and (len(p) < 20 or len(pieces) > 1) for p in pieces):
                return False
        return below(part)

    def ordinary(piece: str) -> bool:
        if piece.isalpha():
            return not below(piece) or len(encoding(vocabulary).encode_ordinary(piece)) == 1
        return piece.isdigit() or piece in known or bool(UUID.fullmatch(piece))

    found = []
    for m in RUN.finditer(text):
        if secret(m[0], m.start()):
            found.append((m.start(), 3, m.end()))
            continue
        pieces = [(m.start() + p.start(), m.start() + p.end()) for p in PIECE.finditer(m[0])]
        if m[0] in known or len(pieces) < 2 or UUID.fullmatch(m[0]):
            continue
        stretch: list[tuple[int, int]] = []
        for a, b in [*pieces, (m.end(), m.end())]:
            alone = secret(text[a:b], a)
            if a < b and not alone and not ordinary(text[a:b]):
                stretch.append((a, b))
                continue
            if len(stretch) > 1 and secret(text[stretch[0][0] : stretch[-1][1]], stretch[0][0]):
                found.append((stretch[0][0], 3, stretch[-1][1]))
            stretch = []
            if alone:
                found.append((a, 3, b))
    return found


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, known: Iterable[str] = (), efficiency: float = EFFICIENCY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each row of docs, which has doc_id and text.

    spans lists kind:start:end by start and kind, comma-joined; base_sha256 digests the list of the base kinds alone.
    known: strings that are not secrets (a list short enough to send to every task); base spans stay all the same.
    A null text is as empty: no spans, the digest of the empty string.  Other columns are not read.
    """
    jobs.small_batches(docs.sparkSession)
    known = frozenset(known)

    def listed(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, base, vocabulary, known, efficiency)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base) if k < 3 else len(more))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(sorted(base + more)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    return scan(jobs.table(spark, sf_dir, "documents"))
