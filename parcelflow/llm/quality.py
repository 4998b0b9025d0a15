"""Quality rules by repetition coverage: characters inside duplicated word n-grams and duplicated lines.

Words are runs of non-blank characters (ASCII blanks part them), lines end at a line feed. For each n of NGRAMS, a word is
covered if any n-gram that holds it occurs twice or more in the document; the share counts the covered words' characters
against all words' characters. Lines count stripped of blanks; of equal lines all but the first are copies.
Everything is a scan: no shuffle, no join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import textkit as tk

NGRAMS = (5, 6, 7, 8, 9, 10)
#: Largest shares that a kept document has: of characters in duplicated n-grams, of copied lines, of their characters.
MOST = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MOST_LINES, MOST_LINE_CHARS = 0.30, 0.20

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, " + ", ".join(f"dup_{n} bigint" for n in NGRAMS) + ", n_lines bigint, line_chars bigint, dup_lines bigint, dup_line_chars bigint, keep boolean"


def _char_sum(buf: np.ndarray) -> np.ndarray:
    """Characters before each byte."""
    c = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=c[1:])
    return c


def _repeated(h: np.ndarray) -> np.ndarray:
    """Which hashes are there twice or more."""
    s = np.sort(h)
    d = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(d):
        return np.zeros(len(h), bool)
    seen = np.zeros(1 << 16, bool)  # most hashes fall out here, before the search
    seen[(d >> tk.U64(48)).astype(np.int64)] = True
    out = seen[(h >> tk.U64(48)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = d[np.minimum(np.searchsorted(d, h[at]), len(d) - 1)] == h[at]
    return out


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of SCHEMA for each row of a chunk."""
    rows = len(offs) - 1
    chars = _char_sum(buf)
    starts, ends, first = tk.spans(buf, offs, ~tk.SPACE_BYTE)
    size = chars[ends] - chars[starts]
    doc = np.repeat(np.arange(rows), np.diff(first))
    stop = first[1:][doc]
    per_doc = lambda x, d: np.bincount(d, x, rows).astype(np.int64)
    out = {"n_words": np.diff(first), "word_chars": per_doc(size, doc)}
    grams = tk.Grams(tk.run_hashes(buf, starts, ends))
    salt = tk.mix(np.arange(1, rows + 1, dtype=tk.U64))
    place = np.arange(len(starts))
    for n in NGRAMS:
        g = grams.of(n)
        inside = np.flatnonzero(place[: len(g)] + n <= stop[: len(g)])
        hit = inside[_repeated(g[inside] ^ salt[doc[inside]])]
        edge = np.zeros(len(starts) + 1, np.int64)
        edge[hit] += 1
        edge[hit + n] -= 1  # hits are distinct, so no index comes twice
        out[f"dup_{n}"] = per_doc(size * (np.cumsum(edge[:-1]) > 0), doc)
    # lines: from the first to the last non-blank byte between line feeds
    line_of_word = np.searchsorted(np.flatnonzero(buf == 10), starts)
    new = np.ones(len(starts), bool)
    new[1:] = (line_of_word[1:] != line_of_word[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    end = ends[np.append(at[1:], len(starts)) - 1] if len(at) else at
    ls = starts[at] if len(at) else at
    ld = doc[at] if len(at) else at
    lsize = chars[end] - chars[ls] if len(at) else at
    key = tk.run_hashes(buf, ls, end) ^ salt[ld] if len(at) else np.zeros(0, tk.U64)
    copy = np.ones(len(at), bool)
    copy[np.unique(key, return_index=True)[1]] = False
    out |= {"n_lines": per_doc(None, ld), "line_chars": per_doc(lsize, ld), "dup_lines": per_doc(copy.astype(float), ld), "dup_line_chars": per_doc(lsize * copy, ld)}
    return out


def _keep(m: dict[str, np.ndarray]) -> np.ndarray:
    ok = m["n_words"] > 0
    for n in NGRAMS:
        ok &= m[f"dup_{n}"] <= MOST[n] * m["word_chars"]
    return ok & (m["dup_lines"] <= MOST_LINES * m["n_lines"]) & (m["dup_line_chars"] <= MOST_LINE_CHARS * m["line_chars"])


def _run(batches):
    for b in batches:
        for i, j, buf, offs in tk.plain_chunks(b.column("text")):
            m = measure(buf, offs)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(i, j - i)} | m | {"keep": _keep(m)})


def repetition(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (SCHEMA), repeated rows and null ids too; null, empty and blank texts have zero counts and aren't kept; other columns are ignored."""
    return tk.texts_of(docs).mapInArrow(_run, SCHEMA)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(tk.table(spark, sf_dir, "documents"))


def _sql() -> str:
    cov = "\n".join(
        f""", g{n} as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(list_slice(ws, i, i + {n - 1}), ' ')) > 1 as rep
          from (select doc_id, ws, unnest(range(1, n_words - {n - 2})) as i from w where n_words >= {n}))
        , c{n} as (select doc_id, sum(size) filter (hit) as dup_{n} from (select p.doc_id, p.size, bool_or(coalesce(g.rep, false)) over (partition by p.doc_id order by p.i rows between {n - 1} preceding and current row) as hit
          from pos p left join g{n} g on g.doc_id = p.doc_id and g.i = p.i) group by doc_id)"""
        for n in NGRAMS
    )
    rules = " and ".join(f"coalesce(dup_{n}, 0) <= {MOST[n]}::double * word_chars" for n in NGRAMS)
    return rf"""
    with w as (select doc_id, regexp_extract_all(text, '[^\t\n\x0b\f\r ]+') as ws, len(regexp_extract_all(text, '[^\t\n\x0b\f\r ]+')) as n_words, text from documents)
    , pos as (select doc_id, i, length(ws[i]) as size from (select doc_id, ws, unnest(range(1, n_words + 1)) as i from w))
    , t as (select doc_id, sum(size) as word_chars from pos group by doc_id)
    {cov}
    , ln as (select doc_id, row_number() over (partition by doc_id, l order by k) > 1 as copy, length(l) as size
        from (select doc_id, k, regexp_extract(lines[k], '^[\t\n\x0b\f\r ]*(.*?)[\t\n\x0b\f\r ]*$', 1) as l
              from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as k from (select doc_id, string_split(text, chr(10)) as lines from documents))) where l <> '')
    , la as (select doc_id, count(*) as n_lines, sum(size) as line_chars, count(*) filter (copy) as dup_lines, coalesce(sum(size) filter (copy), 0) as dup_line_chars from ln group by doc_id)
    , j as (select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, {", ".join(f"coalesce(dup_{n}, 0) as dup_{n}" for n in NGRAMS)},
        coalesce(n_lines, 0) as n_lines, coalesce(line_chars, 0) as line_chars, coalesce(dup_lines, 0) as dup_lines, coalesce(dup_line_chars, 0) as dup_line_chars
        from w d left join t using (doc_id) {" ".join(f"left join c{n} using (doc_id)" for n in NGRAMS)} left join la using (doc_id))
    select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, {", ".join(f"dup_{n}::bigint as dup_{n}" for n in NGRAMS)}, n_lines::bigint as n_lines, line_chars::bigint as line_chars, dup_lines::bigint as dup_lines,
        dup_line_chars::bigint as dup_line_chars, n_words > 0 and {rules} and dup_lines <= {MOST_LINES}::double * n_lines and dup_line_chars <= {MOST_LINE_CHARS}::double * line_chars as keep from j
    """


SQL = _sql()
