"""Token counts under a unigram piece model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a blank-delimited run of bytes behind a word mark. A chunk's new distinct pre-tokens form a trie, which is walked
depth first: in sorted order, the nodes of a word that no word before it has are its prefixes beyond those it shares with the
word before, and the path from the root lies on a stack. A node's forward score is the maximum over the pieces that end there
of the score at the ancestor where the piece starts plus the piece's; it depends on the prefix alone, so it is computed
once for all words that share it, and its token count with it. Of the terminal nodes the counts are stored by word, for all
chunks to come, and summed by document. Words of any length take the same way, in time linear in their new nodes.
Texts are only read: no shuffle. What is broadcast is the vocabulary, of fixed size.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import textkit as tk

VOCABULARY = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁".encode()
#: Scores are whole numbers of so many to a nat, so that sums are exact in any order.
UNIT = 1_000_000
#: Score of a single byte that no piece covers.
BYTE_SCORE = -20 * UNIT

SCHEMA = "doc_id bigint, n_pretokens bigint, n_tokens bigint, log_prob double"


#: In Pieces.ends, what only ends longer pieces.
TAIL = math.inf


@dataclass
class Pieces:
    """ends: the score of every piece, and TAIL for what only ends longer ones, so that the way back from a node stops where no piece can end. counter: what a worker has counted with them so far, in all its tasks."""

    ends: dict[bytes, float]
    counter: Counter | None = None

    def known(self) -> Counter:
        if self.counter is None:
            self.counter = Counter(self)
        return self.counter


def load(path: str = VOCABULARY) -> Pieces:
    """Pieces of a sentencepiece model. A merge list's scores are ranks, not log-probabilities; they count as a Zipf law over the ranks."""
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=path)
    own = [(sp.id_to_piece(i).encode(), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    own.sort(key=lambda x: (-x[1], x[0]))
    norm = math.log(sum(1 / (r + 2.7) for r in range(len(own))))
    return pieces({p: round(UNIT * (-math.log(r + 2.7) - norm)) for r, (p, _) in enumerate(own)})


def pieces(scores: dict[bytes, float]) -> Pieces:
    ends = {p[k:]: TAIL for p in scores for k in range(1, len(p))}
    return Pieces(ends | scores)


def shared(a: bytes, b: bytes) -> int:
    """Bytes of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k, (x, y) in enumerate(zip(a, b)) if x != y)


def trie_counts(words: list[bytes], v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and scores of distinct words. Of equal scores the shortest last piece wins; a byte that no piece covers is a token of BYTE_SCORE."""
    tokens, score = np.zeros(len(words), np.int64), np.zeros(len(words))
    best, count, last = [0], [0], b""  # of the prefixes of the last word
    ends = v.ends.get
    for i in sorted(range(len(words)), key=words.__getitem__):
        w = words[i]
        d = shared(last, w)
        del best[d + 1 :], count[d + 1 :]
        for e in range(d + 1, len(w) + 1):
            s = ends(w[e - 1 : e])
            top, n = best[e - 1] + (BYTE_SCORE if s is None or s == TAIL else s), count[e - 1]
            k = e - 2
            while s is not None and k >= 0:
                s = ends(w[k:e])
                if s is not None and s != TAIL and best[k] + s > top:
                    top, n = best[k] + s, count[k]
                k -= 1
            best.append(top)
            count.append(n + 1)
        last = w
        tokens[i], score[i] = count[len(w)], best[len(w)]
    return tokens, score


class Counter:
    """Counts of the pre-tokens met so far, by hash; emptied when it holds too many, so memory is bounded and nothing is lost but time."""

    def __init__(self, v: Pieces, most: int = 1_000_000):
        self.v, self.most = v, most
        self.keys, self.tokens, self.score = np.zeros(0, tk.U64), np.zeros(0, np.int64), np.zeros(0)

    def _known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h

    def of(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens, tokens and score of each row of a chunk."""
        starts, ends, first = tk.spans(buf, offs, ~tk.SPACE_BYTE)
        keys, at, inverse = np.unique(tk.run_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self.keys, self.tokens, self.score = self.keys[:0], self.tokens[:0], self.score[:0]
        where, known = self._known(keys)
        new = np.flatnonzero(~known)
        if len(new):
            raw = buf.tobytes()
            words = [MARK + raw[starts[i] : ends[i]] for i in at[new]]
            t, s = trie_counts(words, self.v)
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.tokens, self.score = np.concatenate([self.tokens, t])[order], np.concatenate([self.score, s])[order]
            where, _ = self._known(keys)
        rows = len(offs) - 1
        doc = np.repeat(np.arange(rows), np.diff(first))
        return np.diff(first), np.bincount(doc, self.tokens[where][inverse], rows).astype(np.int64), np.bincount(doc, self.score[where][inverse], rows)


def count(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each row of docs (SCHEMA), repeated rows and null ids too; null and empty texts have no tokens; other columns are ignored. The vocabulary is read on the driver and must have been checked to be small (it is a file of pieces, not of corpus size)."""
    v = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches):
        c = v.value.known()
        for b in batches:
            for i, j, buf, offs in tk.plain_chunks(b.column("text")):
                n, t, s = c.of(buf, offs)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(i, j - i), "n_pretokens": n, "n_tokens": t, "log_prob": s / UNIT})

    return tk.texts_of(docs).mapInArrow(run, SCHEMA)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(tk.table(spark, sf_dir, "documents"))


def sql(vocabulary: str = VOCABULARY) -> str:
    """The same in DuckDB, over the same vocabulary: the recurrence runs over characters, as every piece is whole characters; a character that no piece covers is its bytes."""
    own = {p.decode(): s for p, s in load(vocabulary).ends.items() if s != TAIL}
    longest = max(map(len, own))
    rows = "\n".join(f"{s}\t{p}" for p, s in own.items()).replace("'", "''")
    mark = MARK.decode()
    return rf"""
with recursive v as (select string_split(x, chr(9))[2] as p, string_split(x, chr(9))[1]::bigint as s from (select unnest(string_split('{rows}', chr(10))) as x))
, d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents)
, t as (select r, w, count(*) as n from (select r, unnest(string_split_regex(text, '[\t\n\x0b\f\r ]+')) as w from d) where w <> '' group by all)
, w as (select w, '{mark}' || w as m, length(w) + 1 as size from (select distinct w from t))
, e as (select w, m, size, unnest(range(1, size + 1)) as e from w)
, c as (select w, e, k, substring(m, e - k + 1, k) as p from (select *, unnest(range(1, least(e, {longest}) + 1)) as k from e))
, f as (select c.w, c.e, k, v.s, 1 as t from c join v using (p) union all select c.w, c.e, 1, {BYTE_SCORE} * strlen(p), strlen(p) from c anti join v using (p) where k = 1)
, g as (select w, e, list({{'k': k, 's': s, 't': t}}) as ends from f group by w, e)
, dp as (select w, size, 0 as done, [0::bigint] as best, [0::bigint] as cnt from w
  union all select w, size, done + 1, list_append(best[-{longest}:], x.s), list_append(cnt[-{longest}:], x.c)
  from (select dp.w, dp.size, done, best, cnt, list_sort(list_transform(ends, lambda y: {{'s': best[-y.k] + y.s, 'k': -y.k, 'c': cnt[-y.k] + y.t}}), 'DESC')[1] as x from dp join g on g.w = dp.w and g.e = dp.done + 1))
, z as (select w, best[-1] as s, cnt[-1] as c from dp where done = size)
, q as (select r, sum(n) as n, sum(n * c) as c, sum(n * s) as s from t join z using (w) group by r)
select doc_id, coalesce(n, 0)::bigint as n_pretokens, coalesce(c, 0)::bigint as n_tokens, coalesce(s, 0)::double / {UNIT} as log_prob from d left join q using (r)
"""
