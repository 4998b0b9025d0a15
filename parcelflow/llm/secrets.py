"""Secrets: the guess cost of values in credential context.

A candidate is a value after a credential name (one of NAMES inside an identifier, then = or :, with or without quotes, which may be
escaped). Its cost
is log10 of the guesses that the cheapest segmentation needs, over dictionary words (with capitals and letters written
as digits), dates, repeats, keyboard walks and brute-force spans. Dynamic programming over the end positions finds it; a brute-force
span costs by the character, so its best start is a running minimum; runs of repeats and walks are measured once from the right,
and a start has a bounded number of patterned segments, so the work is linear in the value's length. A repeat has up to REPEATS
units, or as many as there are, or one less; a walk has up to WALK keys, or as many as there are. Values of
at least MIN_COST are secrets; cheaper ones (placeholders such as `changeme`, words of prose) are reported with secret false.
The dictionary is WORDS, common passwords, and behind them the whole words of a public vocabulary by rank (WORD_LIST, a file of fixed size).
Assignment marks are found in the bytes with numpy; only there the text is looked at, backwards to the mark before at most. No shuffle.
"""

from __future__ import annotations

import functools
import json
import math
import os
import re
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import textkit as tk

MIN_COST, MIN_LENGTH = 10.0, 4
NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "accesskey", "access-key", "private_key", "privatekey", "private-key", "credential", "auth_key", "authkey", "client_key", "signing_key", "encryption_key", "authorization", "bearer", "_pass")
MASK = "[SECRET]"

#: By how common they are; the rank is the guess count.
WORDS = (
    "password 123456 12345678 qwerty abc123 monkey letmein dragon 111111 baseball iloveyou trustno1 1234567 sunshine master 123123 welcome shadow ashley football jesus michael ninja mustang password1 admin login "
    "princess starwars hello freedom whatever qazwsx 654321 superman batman secret changeme default guest root test user example sample placeholder dummy demo foobar foo bar baz temp temporary pass token key null none "
    "true false undefined your my the insert here value string enter replace this with todo fixme redacted hidden xxx removed empty public private access api client server service account database production staging "
    "development local prod dev stage computer internet orange apple banana summer winter spring autumn january february march april may june july august september october november december monday tuesday wednesday thursday "
    "friday saturday sunday love baby angel family money happy hunter killer soccer hockey flower cheese coffee cookie pepper ginger silver golden purple yellow green black white blue red correct horse battery staple"
).split()
#: A vocabulary whose entries that end a word come by rank; its words of SHORTEST letters or more are the dictionary's bulk.
WORD_LIST, WORD_END, SHORTEST = os.environ.get("WORD_LIST", "/opt/tokenizers/word_bpe_49k.json"), "</w>", 4


PLAIN = str.maketrans("@401!3$57+", "aaoiiesstt")
KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
WALKS = {a: {b for s, rw in enumerate(KEYS) for t, b in enumerate(rw) if abs(s - r) <= 1 and abs(t - c) <= 1 and (s, t) != (r, c)} for r, row in enumerate(KEYS) for c, a in enumerate(row)}
START = math.log10(sum(map(len, KEYS)))
REPEATS, WALK = 8, 12
#: What another segment adds: the guesser doesn't know where it starts.
SWITCH = 0.3
DATE = re.compile(r"(?:(?P<y>(?:19|20)\d\d)([-/.]?)(?P<m>\d{1,2})\2(?P<d>\d{1,2})|(?P<d2>\d{1,2})([-/.]?)(?P<m2>\d{1,2})\6(?P<y2>(?:19|20)\d\d))")

IDENTIFIER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
#: Quoted to the same quote, escaped or not, or else to the end of the line; unquoted to a blank or quote, or to where another assignment begins.
VALUE = re.compile(
    r"=*>?[ \t]*(?:(?:bearer|basic)[ \t]+)?(?:\\\"([^\r\n]+?)\\\"|\\'([^\r\n]+?)\\'|\"([^\"\r\n]+)|'([^'\r\n]+)|`([^`\r\n]+)|((?:(?![,;|&][\w.\-]{1,64}=)[^\s\"'`<>])+))", re.I
)

SCHEMA = "doc_id bigint, key string, value string, start bigint, end bigint, log10_guesses double, segments string, secret boolean"


def per_char(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if "a" <= c.lower() <= "z" else math.log10(33) if c.isascii() else 2.0


class Dictionary:
    """Ranks of words; the rank is the guess count."""

    def __init__(self, words: list[str]):
        self.rank: dict[str, int] = {}
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.begun = {w[:k] for w in self.rank for k in range(1, len(w) + 1)}

    def words(self, s: str, low: str, plain: str, i: int):
        """(end, cost) of the words that start at i. low, plain: s in lower case, and with digits and signs as the letters that they stand for."""
        for j in range(i + 1, len(s) + 1):
            w, p = low[i:j], plain[i:j]
            if w not in self.begun and p not in self.begun:
                return
            r, leet = self.rank.get(w), 0.0
            if r is None and (r := self.rank.get(p)) is not None:
                leet = math.log10(2) * sum(a != b for a, b in zip(w, p))
            if r is not None:
                yield j, math.log10(r) + leet + self._case(s[i:j])

    @staticmethod
    def _case(s: str) -> float:
        ups = sum(c.isupper() for c in s)
        return 0.0 if not ups else math.log10(2) if ups == len(s) or (ups == 1 and s[0].isupper()) else math.log10(sum(math.comb(len(s), k) for k in range(1, min(ups, len(s) - ups) + 1)) or 2)


@functools.cache
def dictionary(path: str | None = WORD_LIST) -> Dictionary:
    """WORDS and the words of the vocabulary at path; None: WORDS alone."""
    if path is None:
        return Dictionary(WORDS)
    with open(path, encoding="utf-8") as f:
        ranks = json.load(f)["model"]["vocab"]
    ends = [w.removesuffix(WORD_END) for w in sorted(ranks, key=ranks.__getitem__) if w.endswith(WORD_END)]
    return Dictionary(WORDS + [w for w in ends if len(w) >= SHORTEST and w.isalpha()])


def date_cost(s: str) -> float | None:
    m = DATE.fullmatch(s)
    if not m:
        return None
    try:
        y = date(int(m["y"] or m["y2"]), int(m["m"] or m["m2"]), int(m["d"] or m["d2"])).year
    except ValueError:
        return None
    return math.log10(365 * max(20, abs(y - 2000))) + (math.log10(4) if re.search(r"\D", s) else 0)


PLACE = {c: (r, k) for r, row in enumerate(KEYS) for k, c in enumerate(row)}


def _place(c: str) -> tuple[int, int]:
    return PLACE[c]


class Patterns:
    """The patterned segments of a value, brute-force spans apart. Runs of repeats and walks are measured once, from the right."""

    def __init__(self, s: str, words: Dictionary):
        self.s, self.words, n = s, words, len(s)
        low = s.lower() if len(s.lower()) == n else "".join(c.lower()[0] for c in s)
        self.low, self.plain = low, low.translate(PLAIN)
        self.same = {}  # by unit: how many characters from here on equal the one a unit further
        for unit in (1, 2, 3, 4):
            run = [0] * (n + 1)
            for i in range(n - unit - 1, -1, -1):
                run[i] = run[i + 1] + 1 if s[i] == s[i + unit] else 0
            self.same[unit] = run
        self.end = list(range(1, n + 1))  # where the walk from here ends
        self.turns = [0] * (n + 1)  # changes of direction up to here
        step = [_step(a, b) for a, b in zip(low, low[1:])]
        for i in range(n - 2, -1, -1):
            if step[i] is not None:
                self.end[i] = self.end[i + 1]
        for i in range(1, n - 1):
            self.turns[i + 1] = self.turns[i] + (step[i] != step[i - 1])

    def at(self, i: int):
        """(end, kind, cost) of those that start at i."""
        s, n = self.s, len(self.s)
        for j, c in self.words.words(s, self.low, self.plain, i):
            yield j, "word", c
        if s[i].isdigit():
            for j in range(i + 6, min(n, i + 10) + 1):
                if (c := date_cost(s[i:j])) is not None:
                    yield j, "date", c
        for unit, run in self.same.items():
            k, least = 1 + run[i] // unit, 3 if unit == 1 else 2
            if k >= least:
                base = sum(map(per_char, s[i : i + unit]))
                for m in {*range(least, min(k, REPEATS) + 1), *range(max(least, k - 1), k + 1)}:
                    yield i + m * unit, "repeat", base + math.log10(m)
        e = self.end[i]
        for j in {*range(i + 4, min(e, i + WALK) + 1), *([e] if e - i > WALK else [])}:
            yield j, "walk", START + math.log10(j - i) + (1 + self.turns[j - 1] - self.turns[i + 1]) * math.log10(8)


def _step(a: str, b: str) -> tuple[int, int] | None:
    """From key to neighbouring key; None if they aren't neighbours."""
    return (_place(b)[0] - _place(a)[0], _place(b)[1] - _place(a)[1]) if b in WALKS.get(a, ()) else None


def guess_cost(s: str, words: Dictionary | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses of the cheapest segmentation, and its segments (start, end, kind). Empty: 0."""
    n = len(s)
    patterns = Patterns(s, words or dictionary())
    best, back = [math.inf] * (n + 1), [(0, "")] * (n + 1)
    best[0] = -SWITCH
    brute, since = math.inf, 0  # the cheapest open brute-force span that ends here, and its start
    for i in range(n + 1):
        if i and brute < best[i]:
            best[i], back[i] = brute, (since, "brute")
        if i == n:
            break
        if best[i] + SWITCH < brute:
            brute, since = best[i] + SWITCH, i
        brute += per_char(s[i])
        for j, kind, c in patterns.at(i):
            if best[i] + SWITCH + c < best[j]:
                best[j], back[j] = best[i] + SWITCH + c, (i, kind)
    out, j = [], n
    while j > 0:
        i, kind = back[j]
        out.append((i, j, kind))
        j = i
    return max(0.0, best[n]), out[::-1]


def name_before(text: str, i: int, done: int = 0) -> str | None:
    """The credential identifier that ends at i, blanks and a quote aside; not from before done."""
    e = i
    while e > done and text[e - 1] in " \t":
        e -= 1
    if e > done and text[e - 1] in "\"'`":
        e -= 1
        if e > done and text[e - 1] == "\\":
            e -= 1
    b = e
    while b > done and text[b - 1] in IDENTIFIER:
        b -= 1
    name = text[b:e].lower()
    return text[b:e] if any(x in name for x in NAMES) else None


def find(text: str, marks: list[int] | None = None):
    """(key, value, start, end) of the values in credential context. marks: where = or : stand, if known."""
    at = marks if marks is not None else [i for i, c in enumerate(text) if c in "=:"]
    done = 0
    for i in at:
        if i < done:
            continue
        k = name_before(text, i, done)
        v = VALUE.match(text, i + 1) if k else None
        if v:
            g = next(g for g in range(1, 7) if v[g] is not None)
            start, end = v.span(g)
            if g == 6:
                end = start + len(v[g].rstrip(",;|"))
            if end - start >= MIN_LENGTH:
                yield k, text[start:end], start, end
                done = end


def _marked(texts: pa.Array):
    """(row, text, character places of = and :) of the rows that have any."""
    for i, _, buf, offs in tk.plain_chunks(texts):
        at = np.flatnonzero((buf == 61) | (buf == 58))
        if not len(at):
            continue
        row = np.searchsorted(offs, at, "right") - 1
        chars = np.cumsum((buf & 0xC0) != 0x80)
        cut = np.flatnonzero(np.diff(row)) + 1
        for places in np.split(at, cut):
            r = int(np.searchsorted(offs, places[0], "right") - 1)
            base = chars[offs[r] - 1] if offs[r] else 0
            yield i + r, buf[offs[r] : offs[r + 1]].tobytes().decode(), (chars[places] - 1 - base).tolist()


def _run(words):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = []
            for r, text, marks in _marked(b.column("text")):
                for key, value, start, end in find(text, marks):
                    cost, segs = guess_cost(value, words.value)
                    rows.append((ids[r], key, value, start, end, round(cost, 6), " ".join(f"{k}:{e - a}" for a, e, k in segs), cost >= MIN_COST))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], f.type) for c, f in enumerate(ARROW)], schema=ARROW)

    return run


ARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("value", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64()), ("segments", pa.string()), ("secret", pa.bool_())])


def scan(docs: DataFrame, word_list: str | None = WORD_LIST) -> DataFrame:
    """One row for each value in credential context (SCHEMA), start and end in characters of the text. Null and empty texts give none; repeated rows give repeated findings; a null doc_id stays null; other columns are ignored."""
    return tk.texts_of(docs).mapInArrow(_run(docs.sparkSession.sparkContext.broadcast(dictionary(word_list))), SCHEMA)


def masked(text: str, marks: list[int], words: Dictionary | None = None) -> str:
    out, at = [], 0
    for _, value, start, end in find(text, marks):
        if guess_cost(value, words)[0] >= MIN_COST:
            out += [text[at:start], MASK]
            at = end
    return "".join(out) + text[at:] if out else text


def mask(docs: DataFrame, word_list: str | None = WORD_LIST) -> DataFrame:
    """docs with every secret replaced by MASK in text, and n_chars, if there, counted anew where text changed; rows and other columns stay as they are."""
    tk.small_batches(docs.sparkSession)
    names = docs.columns
    words = docs.sparkSession.sparkContext.broadcast(dictionary(word_list))

    def run(batches):
        for b in batches:
            changed = {}
            for r, text, marks in _marked(b.column("text")):
                new = masked(text, marks, words.value)
                if new is not text:
                    changed[r] = new
            if changed:
                text = b.column("text").to_pylist()
                for r, new in changed.items():
                    text[r] = new
                b = b.set_column(names.index("text"), "text", pa.array(text, b.column("text").type))
                if "n_chars" in names:
                    n = b.column("n_chars").to_pylist()
                    for r, new in changed.items():
                        n[r] = len(new)
                    b = b.set_column(names.index("n_chars"), "n_chars", pa.array(n, b.column("n_chars").type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(tk.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked."""
    return mask(docs)
