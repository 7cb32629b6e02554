"""Quality rules: repetition coverage from rolling hashes, in numpy.

Many texts are laid end to end and handled as one byte array. Prefix sums of a polynomial
hash give every word's hash, and a running combination of those the hash of every n-gram
of each length; all are mixed with the document's number, so that one sort per length
finds what repeats inside a document. Duplicated n-grams mark their words, and the marked
words' characters are the coverage.

Defined results: null text is an empty text; an empty text has no words and fails the base
rule; a text of any length is measured whole; repeated rows each get their row; an empty
table gives an empty result; other columns are ignored, under whatever names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, only, read_table, sliced, texts_of

#: Most of a text's characters, in percent, that duplicated n-grams of a length may cover,
#: first occurrences included: twice the published limits, which count repeats alone. All lie
#: well under MAX_REPEAT_PERCENT, so that they decide on texts which the base rule passes.
COVER_LIMITS = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
#: Most of a text's characters, in percent, in lines that repeat an earlier line.
LINE_LIMIT = 20
#: Symbols for each 100 words.
SYMBOL_LIMIT = 10
MIN_WORDS, MAX_REPEAT_PERCENT, BASE_N = 50, 50, 3

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_TABLE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE, _MULT = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD1342543DE82EF95)
_PIECE = 1 << 20
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_BACK = pow(_BASE, -1, 1 << 64)
_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_BACK, _BLOCK)


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """Sums of byte values times base**position modulo 2**64, before each position; in blocks, so that
    a long text costs eight bytes a byte."""
    out = np.zeros(len(buf) + 1, np.uint64)
    factor, step = np.ones(1, np.uint64), np.array([pow(_BASE, _BLOCK, 1 << 64)], np.uint64)
    for at in range(0, len(buf), _BLOCK):
        part = _TABLE[buf[at : at + _BLOCK]]
        part *= _UP[: len(part)]
        np.cumsum(part, out=part)
        part *= factor
        part += out[at]
        out[at + 1 : at + 1 + len(part)] = part
        factor *= step
    return out


def inverse_powers(at: np.ndarray) -> np.ndarray:
    """base**-position for each position."""
    high = _powers(pow(_BACK, _BLOCK, 1 << 64), int(at.max(initial=0) >> 16) + 1)
    return high[at >> 16] * _DOWN[at & (_BLOCK - 1)]


def inverse_powers_upto(n: int) -> np.ndarray:
    high = _powers(pow(_BACK, _BLOCK, 1 << 64), n // _BLOCK + 1)
    return (high[:, None] * _DOWN[None, :]).ravel()[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def measure(texts: list[str], lengths=tuple(COVER_LIMITS)) -> dict[str, np.ndarray]:
    """Counts for each text; dup_chars_n for each n-gram length n."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n_docs = len(raw)
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, n_docs)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    ends = starts + sizes
    sums = prefix_hashes(buf)
    small = np.int32 if len(buf) < 1 << 31 else np.int64
    points = np.concatenate([np.zeros(1, small), np.cumsum((buf & 0xC0) != 0x80, dtype=small)])
    symbols = np.concatenate([np.zeros(1, small), np.cumsum(_SYMBOL[buf], dtype=small)])

    def hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((sums[b] - sums[a]) * inverse_powers(a) ^ (b - a).astype(np.uint64) * _MULT)

    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    w_at, w_to = edge[::2], edge[1::2]
    w_doc = np.searchsorted(starts, w_at, "right") - 1
    w_chars = points[w_to] - points[w_at]
    n_words = np.bincount(w_doc, minlength=n_docs)
    salt = mix64(np.arange(1, n_docs + 1, dtype=np.uint64) * _MULT)
    out = {"n_words": n_words.astype(np.int64), "word_chars": _per_doc(w_chars, w_doc, n_docs), "n_symbols": (symbols[ends] - symbols[starts]).astype(np.int64)}

    l_to = np.flatnonzero(buf == 10)
    l_at = np.concatenate([[0], l_to[:-1] + 1])
    has_word = np.searchsorted(w_at, l_to) > np.searchsorted(w_at, l_at)
    l_at, l_to = l_at[has_word], l_to[has_word]
    l_doc = np.searchsorted(starts, l_at, "right") - 1
    keys = mix64(hashes(l_at, l_to) ^ salt[l_doc])
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = np.bincount(l_doc[again], minlength=n_docs).astype(np.int64)
    wc = np.concatenate([[0], np.cumsum(w_chars)])
    a, b = np.searchsorted(w_at, l_at[again]), np.searchsorted(w_at, l_to[again])
    out["dup_line_chars"] = _per_doc(wc[b] - wc[a], l_doc[again], n_docs)

    word = hashes(w_at, w_to)
    gram = word.copy()
    for n in range(2, max((BASE_N, *lengths)) + 1):
        gram = gram[: max(0, len(word) - n + 1)] * _MULT + word[n - 1 :]
        if n != BASE_N and n not in lengths:
            continue
        inside = np.flatnonzero(w_doc[n - 1 :] == w_doc[: len(gram)])
        at = inside[_repeated(mix64(gram[inside] ^ salt[w_doc[inside]]))]
        change = np.zeros(len(word) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        covered = np.cumsum(change[:-1]) > 0
        if n == BASE_N:
            out["n_repeat_words"] = np.bincount(w_doc[covered], minlength=n_docs).astype(np.int64)
        if n in lengths:
            out[f"dup_chars_{n}"] = _per_doc(w_chars[covered], w_doc[covered], n_docs)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept), from measure()'s counts; whole numbers only."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    bad = (100 * m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]) | (100 * m["n_symbols"] > SYMBOL_LIMIT * m["n_words"])
    for n, most in COVER_LIMITS.items():
        bad |= 100 * m[f"dup_chars_{n}"] > most * m["word_chars"]
    return failed, ~failed & ~bad


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_chars_{n}" for n in COVER_LIMITS]]


def score(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct __quality: the counts, base_failed and kept."""
    fields = ", ".join(f"{c}: long" for c in COUNTS) + ", base_failed: boolean, kept: boolean"
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("__quality", T._parse_datatype_string(f"struct<{fields}>"))])

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = []
            for piece in sliced(batch, _PIECE):
                m = measure(texts_of(piece, text_col))
                failed, kept = verdicts(m)
                parts.append(pa.StructArray.from_arrays([*[pa.array(m[c], pa.int64()) for c in COUNTS], pa.array(failed), pa.array(kept)], [*COUNTS, "base_failed", "kept"]))
            arr = pa.concat_arrays(parts)
            return pa.RecordBatch.from_arrays([*batch.columns, arr], [*batch.schema.names, "__quality"])

        return f

    return map_batches(docs, make, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return score(docs).select("doc_id", *[F.col(f"__quality.{c}").alias(c) for c in (*COUNTS[:5], "base_failed", "kept", *COUNTS[5:])])


def _op4_sql() -> str:
    grams = "\n".join(
        f"""), g{n} AS (
  SELECT row, pos, list_aggregate(list(w) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING), 'string_agg', ' ') AS g,
    count(*) OVER (PARTITION BY row ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS k FROM words
), c{n} AS (
  SELECT DISTINCT x.row, x.pos + unnest(range({n})) AS pos
  FROM g{n} x JOIN (SELECT row, g FROM g{n} WHERE k = {n} GROUP BY row, g HAVING count(*) > 1) y ON x.row = y.row AND x.g = y.g AND x.k = {n}
), r{n} AS (
  SELECT c.row, count(*) AS n, sum(length(w.w))::BIGINT AS chars FROM c{n} c JOIN words w ON w.row = c.row AND w.pos = c.pos GROUP BY c.row"""
        for n in (BASE_N, *COVER_LIMITS)
    )
    joins = "\n".join(f"LEFT JOIN r{n} ON r{n}.row = d.row" for n in (BASE_N, *COVER_LIMITS))
    limits = "".join(f" OR 100 * dup_chars_{n} > {m} * word_chars" for n, m in COVER_LIMITS.items())
    cover = ", ".join(f"coalesce(r{n}.chars, 0) AS dup_chars_{n}" for n in COVER_LIMITS)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)
), lines AS (
  SELECT row, l, count(*) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY row, l
), dup AS (
  SELECT row, sum(n - 1)::BIGINT AS n_dup_lines, sum((n - 1) * length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')))::BIGINT AS chars FROM lines GROUP BY row
), tot AS (
  SELECT row, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM words GROUP BY row
{grams}
), m AS (
  SELECT d.doc_id, coalesce(tot.n_words, 0) AS n_words, coalesce(tot.word_chars, 0) AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n_dup_lines, 0) AS n_dup_lines,
    coalesce(r{BASE_N}.n, 0) AS n_repeat_words, coalesce(dup.chars, 0) AS dup_line_chars, {cover}
  FROM d LEFT JOIN tot ON tot.row = d.row LEFT JOIN dup ON dup.row = d.row
{joins}
), v AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND NOT (100 * dup_line_chars > {LINE_LIMIT} * word_chars OR 100 * n_symbols > {SYMBOL_LIMIT} * n_words{limits}) AS kept FROM v
"""


OP4_SQL = _op4_sql()
