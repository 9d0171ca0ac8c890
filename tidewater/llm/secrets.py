"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns at the hits, checksum validation.

One pass of an automaton over the text gives every keyword's place. A pattern is matched only there,
anchored, and what has a checksum of its own counts only if that checksum holds.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, map_texts, slices

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "crc62", "jwt")
#: Prefixes of tokens that end in a base-62 CRC32 of their body.
CRC62_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MASK = "[SECRET]"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEY = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = re.compile(rf"""({KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
CRC62 = re.compile(f"(?:{'|'.join(CRC62_PREFIXES)})([0-9A-Za-z]{{30}})([0-9A-Za-z]{{6}})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("crc62", CRC62_PREFIXES), ("jwt", ("eyj",))):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def crc62(body: str) -> str:
    """Six base-62 digits of the body's CRC32."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):
        return False


def _accept(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 8
    if kind == "access":
        return m.end() - m.start() >= 16
    if kind == "crc62":
        return crc62(m[1]) == m[2]
    return _json_part(m[1]) and _json_part(m[2])


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "crc62": CRC62, "jwt": JWT}
LOWER = {i: i + 32 for i in range(65, 91)}


def scan(text: str, auto: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, sorted.

    Every match of a keyword kind starts at a keyword, so anchored matches at the hits in order, each
    beginning at or after the last match's end, are the leftmost non-overlapping matches. A match that
    fails its length or checksum still takes its place, as it would in a plain search.
    """
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lowered
        low = text.translate(LOWER)
    found, free = [], dict.fromkeys(PATTERNS, 0)
    for end, (kind, n) in auto.iter(low):
        s = end - n + 1
        if s >= free[kind] and (m := PATTERNS[kind].match(text, s)):
            free[kind] = m.end()
            if _accept(kind, m):
                found.append((s, KINDS.index(kind), m.end()))
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]  # runs of 32 and more; no keyword announces them
    return sorted(found)


def mask(text: str, spans: list[tuple[int, int, int]], by: str = MASK) -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, at = [], 0
    for s, e in merged(spans):
        out += [text[at:s], by]
        at = e
    return "".join([*out, text[at:]])


def merged(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, _, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def scan_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_assign, n_access, n_hex, base_sha256, spans; NULL is an empty text.

    Whole texts, one row each, no shuffle; repeated rows give repeated results.
    """
    auto: list = []

    def run(c: dict[str, list]) -> dict[str, list]:
        if not auto:
            auto.append(automaton())
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for t in c["text"]:
            found = scan(t or "", auto[0])
            names = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
            for i, n in enumerate(("n_assign", "n_access", "n_hex")):
                out[n].append(sum(k == i for _, k, _ in found))
            base = ",".join(n for n, (_, k, _) in zip(names, found, strict=True) if k < 3)
            out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            out["spans"].append(",".join(names))
        return {"doc_id": c["doc_id"], **out}

    return map_rows(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"),
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
        run,
    )


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with every span of a secret in text replaced; all other columns and rows as they are."""
    auto: list = []

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        if not auto:
            auto.append(automaton())
        for whole in batches:
            for b in slices(whole):
                texts = [None if t is None else mask(t, scan(t, auto[0])) for t in b.column(at).to_pylist()]
                yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return map_texts(docs, run)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(documents(spark, sf_dir))
