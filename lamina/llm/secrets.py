"""Secret scans: assignments, access keys and hex runs by pattern, and other random strings by token efficiency.

A byte-pair vocabulary is learned from ordinary text, so that ordinary strings take few tokens: words about four characters
each, random strings under two. A run of base-64 or URL-safe characters with a low ratio of characters to tokens is reported as
``random``, whatever its letters, unless it is a known digest (hex of a usual length, a UUID) or overlaps a span already found. Of a
run that is ordinary as a whole, as a readable path with a key behind it, those stretches between ``/``, ``=``, ``-`` and ``_``
are reported that are long enough and have a low ratio themselves. Numbers between such marks, as in dates, are identifiers and count for nothing.

Not found: random strings under 20 characters, of which ordinary words can have as low a ratio, and strings of digits alone.
"""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lamina.llm.bpe import encoding, load
from lamina.llm.common import as_bytes, map_texts, table
from lamina.llm.spans import Span, beside, digest, report

RANKS = "byte_bpe_50k.tiktoken"


def _either(words: str) -> str:
    """A pattern for the words with ASCII letters in either case (IGNORECASE would take other letters too)."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words.split("|"))


ASSIGN = re.compile(rf"""(?:{_either("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "api")
#: Characters that a random string has at least.
LEAST = 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512, and UUIDs, as parts of a run.
DIGEST = re.compile(r"(?<![A-Za-z0-9+])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{128}|[0-9a-fA-F]{96}|[0-9a-fA-F]{64}|[0-9a-fA-F]{56}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})(?![A-Za-z0-9+])")
#: Words of capitals, as in names of constants, which are weighed as the same words in lower case.
CAPITALS = re.compile(rf"(?<![A-Za-z0-9+])[A-Z]{{2,{LEAST - 1}}}(?![A-Za-z0-9+])")
#: Numbers that are whole parts of a run, as of dates, times and versions.
NUMBER = re.compile(r"(?<![A-Za-z0-9+])[0-9]+(?![A-Za-z0-9+])")
ATOM = re.compile(r"[^/=_-]*+[/=_-]*+")


def base_spans(text: str) -> list[Span]:
    """The contract's three kinds. A failing match is dropped but still takes its characters."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return out


def random_parts(run: str, begin: int, end: int, excess) -> list[tuple[int, int]]:
    """The stretches of whole parts of ``run[begin:end]`` with the most ``excess`` (positive where a string is random), from left to right."""
    parts = [(m.start(), m.end()) for m in ATOM.finditer(run, begin, end) if m[0]]
    scores = [excess(run[a:b]) for a, b in parts]
    out, k = [], 0
    while k < len(parts):
        total = best = 0
        last = j = k
        while j < len(parts) and (total := total + scores[j]) > 0:
            if total > best:
                best, last = total, j
            j += 1
        if best > 0:
            a, b = parts[k][0], parts[last][1]
            if b < end:
                b = a + len(run[a:b].rstrip("/_-"))
            if b - a >= LEAST and excess(run[a:b]) > 0:
                out.append((a, b))
        k = last + 1
    return out


def random_spans(text: str, enc, ratio: float) -> list[Span]:
    """Spans of strings with under ``ratio`` characters a token, and of such stretches of others."""

    def excess(x: str) -> float:
        x = NUMBER.sub("", CAPITALS.sub(lambda m: m[0].lower(), x))
        if not x.strip("/=_-"):
            return 0
        return ratio * sum(len(enc.encode_ordinary(x[k : k + 512])) for k in range(0, len(x), 512)) - len(x)

    out: list[Span] = []
    for m in RUN.finditer(text):
        run, begin = m[0], 0
        for stop, after in [*(d.span() for d in DIGEST.finditer(run)), (len(run), len(run))]:
            if stop - begin >= LEAST:
                found = [(begin, stop)] if excess(run[begin:stop]) > 0 else random_parts(run, begin, stop, excess)
                out += [(m.start() + a, 3, "random", m.start() + b) for a, b in found]
            begin = len(run) - len(run[after:].lstrip("/=_-"))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ratio: float = 2.0) -> DataFrame:
    """Per row of ``docs``: the id, ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base_sha256``, ``spans`` (code points, end exclusive)
    and ``has_secret``, whether there is any.

    A null or empty text has no spans: counts 0, an empty ``spans`` and the digest of the empty string.
    """
    ranks = load(docs.sparkSession, path or public_tokenizers.path(RANKS))

    def work(ids, texts):
        enc = encoding(ranks.value, public_tokenizers.PATTERN)
        out = {"id": ids, "n_assign": [], "n_access": [], "n_hex": [], "n_random": [], "base_sha256": [], "spans": [], "has_secret": []}
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            more = beside(random_spans(text, enc, ratio), base)
            for kind in ("assign", "access", "hex"):
                out[f"n_{kind}"].append(sum(x[2] == kind for x in base))
            out["n_random"].append(len(more))
            out["base_sha256"].append(digest(base))
            out["spans"].append(report(base + more))
            out["has_secret"].append(bool(base or more))
        return out

    found = map_texts(as_bytes(docs, id_col, text_col), work, "id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, has_secret boolean")
    return found.withColumnRenamed("id", id_col)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`find_secrets` in all documents."""
    return find_secrets(table(spark, sf_dir, "documents"))
