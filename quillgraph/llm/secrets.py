"""Secret scans: base patterns, and the guess cost of values that stand in credential context."""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.pii import span_digest
from quillgraph.llm.spans import SECRET_KINDS, in_order, secret_spans
from quillgraph.llm.text import map_batches

#: Vocabulary file of a public tokenizer that marks word ends; its words, in order of rank, are the dictionary.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: log10 of the guesses from which a credential's value counts as a secret.
GUESS_COST = 8.0
# Words that guessers try first, most common first.
COMMON_WORDS = (
    "password passwd pass secret admin root user login welcome letmein master hello dragon monkey shadow sunshine princess football baseball "
    "superman batman trustno1 iloveyou access changeme default example test testing guest public private server system manager service "
    "token key api apikey auth credential placeholder value string your here insert enter none null true false todo dummy sample demo "
    "love money summer winter spring autumn january february march april may june july august september october november december "
    "monday friday sunday london paris berlin madrid texas tiger eagle silver golden purple orange black white green flower star magic the and"
).split()
# Rows of a keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
_LEET = str.maketrans("04315$@7", "oaelssat")
_YEAR, _MONTH, _DAY = r"(?:19|20)[0-9][0-9]", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])"
#: Forms of a date and log10 of the guesses that go through them.
_DATES = [(re.compile(_YEAR), 2.1)] + [
    (re.compile(form), 4.6) for form in (rf"{_YEAR}([-/.]?){_MONTH}\1{_DAY}", rf"{_DAY}([-/.]?){_MONTH}\1{_YEAR}", rf"{_MONTH}([-/.]?){_DAY}\1{_YEAR}")
]
#: Price of a walk of three keys or more: its start, each step, each change of direction.
WALK_START, WALK_STEP, WALK_TURN = 1.7, 0.1, 0.7
_OWNERS = "api|access|auth|private|client"
_CONTEXT = re.compile(
    rf"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|login|pin|(?:{_OWNERS})[_\-\x20]?(?:key|secret|token|code))"
    r"[\"'`]?(?:\x20*+(?:[:=]{1,2}>?|->)\x20*+|\x20++(?:is|was|to)\x20++)[\"'`]?([^\s\"'`<>,;]{6,})",
    re.I | re.A,
)
#: Every text with a span fits it: each name of _CONTEXT and each base pattern holds one of these.
_KEYWORD = f"(?i)pass|pwd|secret|token|credential|login|pin|key|(?:{_OWNERS})[_\\-\\x20]?code|AKIA|[0-9a-f]{{32}}"


def _step(a: str, b: str) -> tuple | None:
    """How to get from one key to a neighbouring key or letter; None if they are no neighbours."""
    if (p := _PLACE.get(a)) and (q := _PLACE.get(b)):
        if abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 and p != q:
            return "key", q[0] - p[0], q[1] - p[1]
    if a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1:
        return "code", ord(b) - ord(a)
    return None


class Ranks(dict):
    """Rank of every word, from 1; ``longest`` is the length of the longest."""

    def __init__(self, words=()):
        super().__init__()
        for word in words:
            self.setdefault(word, len(self) + 1)
        self.longest = max(map(len, self), default=0)

    def __reduce__(self):
        return Ranks, (list(self),)


@lru_cache(maxsize=4)
def word_ranks(path: str = VOCABULARY) -> Ranks:
    """The dictionary: the words guessers try first, then the vocabulary's in their order."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = [t.removesuffix("</w>") for t in sorted(vocabulary, key=vocabulary.get) if t.endswith("</w>")]
    return Ranks([*COMMON_WORDS, *(w for w in words if re.fullmatch("[a-z]{3,}", w))])


def word_price(value: str, low: str, plain: str, ranks: Ranks) -> float | None:
    """log10 guesses of a word in this spelling; None if it is no word. Capitals and digits for letters cost extra."""
    rank = ranks.get(low) or ranks.get(plain)
    if not rank:
        return None
    return math.log10(rank + 1) + (0 if value == low else 0.3 if value.istitle() or value.isupper() else 1.0) + (0 if low in ranks else 0.6)


def alphabet(value: str) -> float:
    """log10 of the characters that brute force tries for each of the value's."""
    if re.fullmatch("[0-9a-f]+", value):
        return math.log10(16 if re.search("[a-f]", value) else 10)
    kinds = (26, any(c.islower() for c in value)), (26, any(c.isupper() for c in value)), (10, any(c.isdigit() for c in value)), (33, any(not c.isalnum() for c in value))
    return math.log10(max(10, sum(n for n, has in kinds if has)))


def guess_cost(value: str, ranks: Ranks | None = None, max_period: int = 8) -> float:
    """log10 guesses of the cheapest cut of ``value`` into words, dates, repeats, walks and brute force.

    best[j] is the least cost of the first j characters. From every i all segments are offered: every
    word, every form of date, every part of a keyboard or alphabet walk and every number of repeats of
    a unit, brute force for one character. A repeat that goes on through i is not begun anew there, nor
    is one whose unit is a repeat itself: neither is ever cheaper. So long runs cost time linear in them.
    """
    n = len(value)
    if not n:
        return 0.0
    ranks = word_ranks() if ranks is None else ranks
    low = value.lower()
    if len(low) != n:  # a few capitals change length when lowered
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    brute = alphabet(value)
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    steps = [_step(low[i], low[i + 1]) for i in range(n - 1)]
    walk = [math.inf] * (n + 1)  # least cost of the first j characters if the last ones are a walk
    again = {p: [0] * (n + 1) for p in range(1, max_period + 1)}
    for p, run in again.items():
        for i in range(n - p - 1, -1, -1):
            run[i] = run[i + 1] + 1 if value[i] == value[i + p] else 0
    repeated: dict[tuple[int, int], float] = {}  # (period, place that a repeat goes on through): its cost there
    for i in range(n):
        if i >= 3 and steps[i - 2] and steps[i - 3]:
            turn = WALK_TURN * (steps[i - 2] != steps[i - 3])
            walk[i] = turn + WALK_STEP + min(walk[i - 1], best[i - 3] + WALK_START + WALK_STEP)
            best[i] = min(best[i], walk[i])
        b = best[i]
        best[i + 1] = min(best[i + 1], b + brute)
        for size in range(3, min(ranks.longest, n - i) + 1):
            price = word_price(value[i : i + size], low[i : i + size], plain[i : i + size], ranks)
            if price is not None and b + price < best[i + size]:
                best[i + size] = b + price
        if value[i].isdigit():
            for form, price in _DATES:
                if (m := form.match(value, i)) and b + price < best[m.end()]:
                    best[m.end()] = b + price
        for p, run in again.items():
            times = 1 + run[i] // p
            if times < 2 or times * p < 3 or repeated.get((p, i), math.inf) <= b + 1e-9:
                continue
            if any(p % q == 0 and again[q][i] >= times * p - q for q in range(1, p)):
                continue
            for count in range(max(2, -(-3 // p)), times + 1):
                j, cost = i + count * p, b + p * brute + math.log10(count)
                best[j] = min(best[j], cost)
                if count < times:
                    repeated[p, j] = min(repeated.get((p, j), math.inf), cost)
    if n >= 3 and steps[n - 2] and steps[n - 3]:
        best[n] = min(best[n], WALK_TURN * (steps[n - 2] != steps[n - 3]) + WALK_STEP + min(walk[n - 1], best[n - 3] + WALK_START + WALK_STEP))
    return best[n]


def scan(text: str, least: float = GUESS_COST, ranks: Ranks | None = None) -> tuple[list, list]:
    """(base spans, all spans): ``guess`` spans are values in credential context that are hard to guess."""
    base = secret_spans(text)
    taken, added = sorted((a, b) for a, b, _ in base), []
    j = 0
    for m in _CONTEXT.finditer(text):
        a, b = m.span(1)
        while b > a and text[b - 1] in ".!?)]}:":
            b -= 1
        while j < len(taken) and taken[j][1] <= a:
            j += 1
        if b - a >= 6 and not any(x < b and y > a for x, y in taken[max(0, j - 3) : j + 3]) and guess_cost(text[a:b], ranks) >= least:
            added.append((a, b, "guess"))
    return base, in_order(base + added, (*SECRET_KINDS, "guess"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, base spans, all spans) of every row, whole texts, in code points.

    The driver reads the dictionary from ``vocabulary`` and sends it with the plan.

    Null and empty texts have no span. A value is read to its end however long it is. Repeated rows
    are scanned alike; other columns are not read.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    ranks = word_ranks(vocabulary)

    def make():
        def each(batch: pa.RecordBatch):
            n = batch.num_rows
            some = pc.fill_null(pc.match_substring_regex(batch.column(1), _KEYWORD), False).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(some)
            base, full = [[]] * n, [[]] * n
            for i, text in zip(at, batch.column(1).take(pa.array(at)).to_pylist(), strict=True):
                base[i], full[i] = scan(text, ranks=ranks)
            as_list = lambda rows: pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in r] for r in rows], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_list(base), as_list(full)], names=[id_col, "base", "spans"])

        return each

    s = "array<struct<start:long,end:long,kind:string>>"
    return map_batches(docs, [id_col, text_col], make, f"{id_col} {dict(docs.dtypes)[id_col]}, base {s}, spans {s}")


def op7_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the secrets in every text of ``documents``."""
    return span_digest(find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")), SECRET_KINDS)
