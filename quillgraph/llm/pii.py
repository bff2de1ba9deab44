"""Personal data by a skip-chain conditional random field over each document's candidate tokens."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.spans import PII_KINDS, in_order, luhn, pii_spans
from quillgraph.llm.text import map_batches

LABELS = ("none", *PII_KINDS)
_O = 0
#: Damping of loopy message passing, and the belief at which a token is taken.
DAMPING, BELIEF = 0.3, 0.6
#: Messages are swept until none moves by more; a component that swings stops after the sweeps given.
SETTLED, MOST_SWEEPS = 1e-4, 1000
#: Log weight that holds a token a base pattern matched to the kinds of its matches, however many others pull.
OBSERVED = 1e9
#: Digits that tokens side by side may have together to be one number.
MOST_DIGITS = {"card": 19, "phone": 15}
#: Characters of the texts whose tokens are held at a time; a longer text is held alone, whole.
TAGGED_CHARS = 1 << 20
_DIGITS = re.compile(r"[0-9]+")
_EDGE = "\"'`()[]{}<>,;:!?."
_CANDIDATE = re.compile("[0-9@]")
_TOKEN = re.compile(r"\S+")
N_FEATURES = 22


def candidates(text: str) -> list[tuple[int, int]]:
    """White-space tokens that hold a digit or @; of the others, only ``alike_words`` are not clamped to ``none``."""
    out, end = [], -1
    for m in _CANDIDATE.finditer(text):
        at = m.start()
        if at < end:
            continue
        start = at
        while start > max(end, 0) and not text[start - 1].isspace():
            start -= 1
        end = at + 1
        while end < len(text) and not text[end].isspace():
            end += 1
        out.append((start, end))
    return out


def features(token: str, evidence: frozenset | set) -> list[int]:
    """Indices of the active features: base evidence by kind, and the token's shape."""
    digits = sum(len(m.group()) for m in _DIGITS.finditer(token))
    core = token.strip(_EDGE)
    on = [0]
    on += [1 + PII_KINDS.index(k) for k in evidence]
    on.append(5 + (0 if digits == 0 else 1 if digits < 4 else 2 if digits < 7 else 3 if digits < 10 else 4 if digits < 14 else 5 if digits < 20 else 6))
    if "@" in core:
        on.append(12)
    if core[:1] == "+":
        on.append(13)
    if "(" in token or ")" in token:
        on.append(14)
    if "-" in core:
        on.append(15)
    dots = core.count(".")
    on.append(16 if dots == 0 else 17 if dots < 3 else 18)
    if any(c.isalpha() for c in core):
        on.append(19)
    if "=" in core or "/" in core or ":" in core:
        on.append(20)
    if 14 <= digits <= 19 and not any(c.isalpha() for c in token) and luhn("".join(_DIGITS.findall(token))):
        on.append(21)
    return on


def likeness(token: str) -> str | None:
    """Key of tokens that share a skip potential: same local part, same last seven digits, same token."""
    core = token.strip(_EDGE).lower()
    if "@" in core:
        core = core.split("@")[0]
    digits = "".join(_DIGITS.findall(core))
    if len(digits) >= 7 and not any(c.isalpha() for c in core):
        return "d" + digits[-7:]
    return "s" + core if len(core) >= 4 else None


def alike_words(text: str, keys: set[str]) -> list[tuple[int, int]]:
    """White-space tokens without a digit or @ whose likeness is one of ``keys``."""
    return [m.span() for m in _TOKEN.finditer(text) if not _CANDIDATE.search(m.group()) and likeness(m.group()) in keys]


class Graph:
    """Tokens of many documents with chain edges (neighbours) and skip edges (alike tokens).

    If a base pattern matched some of the alike tokens of a document, each of the others is tied to
    one of those, at whatever distance; if none, an occurrence is tied to the one before it. Either
    way there are as many edges as occurrences.
    """

    def __init__(self):
        self.on: list[list[int]] = []
        self.seen: list[set] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, tokens: list[str], spans: list[tuple[int, int]], evidence: list[set]) -> int:
        first, last, source = len(self.on), {}, {}
        keys = [likeness(token) for token in tokens]
        for i, key in enumerate(keys):
            if key and evidence[i]:
                source.setdefault(key, first + i)
        for i, token in enumerate(tokens):
            me = first + i
            self.on.append(features(token, evidence[i]))
            self.seen.append(evidence[i])
            if i and spans[i][0] - spans[i - 1][1] == 1:
                self.chain.append((me - 1, me))
            key = keys[i]
            if key in source:
                if evidence[i]:
                    source[key] = me  # the nearest match before, else the first
                else:
                    self.skip.append((source[key], me))
            elif key:
                if key in last:
                    self.skip.append((last[key], me))
                last[key] = me
        return first

    def arrays(self):
        n = len(self.on)
        x = np.zeros((n, N_FEATURES))
        rows = np.repeat(np.arange(n), [len(o) for o in self.on])
        x[rows, [f for o in self.on for f in o]] = 1
        edges = np.array(self.chain + self.skip, np.int64).reshape(-1, 2)
        kind = np.array([0] * len(self.chain) + [1] * len(self.skip), np.int64)
        return x, edges, kind


def beliefs(weights: tuple[np.ndarray, np.ndarray], graph: Graph, sweeps: int = MOST_SWEEPS) -> np.ndarray:
    """Marginals of every token by loopy sum-product message passing, swept until messages settle.

    Tokens that a base pattern matched are observed. Once its incoming messages have settled, a
    message is not computed again, so a long document does not hold up the others.
    """
    unary, pair = weights
    x, edges, kind = graph.arrays()
    node = x @ unary
    for i, kinds in enumerate(graph.seen):
        for k in kinds:
            node[i, LABELS.index(k)] += OBSERVED
    if not len(edges):
        return _softmax(node)
    src = np.concatenate([edges[:, 0], edges[:, 1]])
    dst = np.concatenate([edges[:, 1], edges[:, 0]])
    m = len(edges)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    tables, which = [*pair, *pair.transpose(0, 2, 1)], np.concatenate([kind, kind + len(pair)])
    message = np.zeros((2 * m, len(LABELS)))
    moving = np.arange(2 * m)
    for _ in range(sweeps):
        total = node.copy()
        np.add.at(total, dst, message)
        out = total[src[moving]] - message[back[moving]]
        new = np.empty_like(out)
        for k, table in enumerate(tables):
            rows = np.flatnonzero(which[moving] == k)
            new[rows] = _logsumexp(out[rows][:, :, None] + table)
        new -= new.max(1, keepdims=True)
        new = DAMPING * message[moving] + (1 - DAMPING) * new
        moved = np.abs(new - message[moving]).max(1) > SETTLED
        message[moving] = new
        # A message may move again while it does so itself or one into its source does.
        stirred = np.zeros(len(node), bool)
        stirred[dst[moving[moved]]] = True
        again = stirred[src]
        again[moving[moved]] = True
        moving = np.flatnonzero(again)
        if not len(moving):
            break
    total = node.copy()
    np.add.at(total, dst, message)
    return _softmax(total)


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _logsumexp(z):
    top = z.max(1, keepdims=True)
    return np.log(np.exp(z - top).sum(1)) + top[:, 0]


def _example(rng) -> tuple[list[str], list[int]]:
    """Tokens and labels of an invented document: entities, later mentions in other forms, look-alikes."""
    tokens, labels, again = [], [], []

    def put(words, label):
        tokens.extend(words), labels.extend([label] * len(words))

    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    for _ in range(int(rng.integers(2, 7))):
        what = int(rng.integers(0, 9))
        tokens.append("\0"), labels.append(_O)  # a gap: words that are no candidates
        if what == 0:
            local = f"{letters(5)}.{num(2)}"
            put([f"{local}@mail{num(1)}.example.com"], 1)
            again.append(([local], 1))
        elif what == 1:
            ip = ".".join(str(v) for v in rng.integers(1, 255, 4))
            put([ip], 2)
            again.append(([ip], 2))
        elif what == 2:
            body = num(15)
            card = next(body + str(d) for d in range(10) if luhn(body + str(d)))
            put([card], 3)
            again.append((["/".join(card[i : i + 4] for i in range(0, 16, 4))], 3))
        elif what == 3:
            area, a, b = num(3), num(3), num(4)
            put(["+1", f"({area})", f"{a}-{b}"], 4)
            again.append(([[f"{area}-{a}-{b}"], [f"({area})", f"{a}-{b}"], [f"{a}-{b}"]][int(rng.integers(0, 3))], 4))
        elif what == 4:
            put([f"password={num(4)}{letters(4)}{num(6)}"], _O)
        elif what == 5:
            put([f"{num(1)}.{num(1)}."], _O)
        elif what == 6:
            n = num(int(rng.integers(1, 19)))
            put([n], _O) if not (14 <= len(n) and luhn(n)) else None
            again.append(([n], _O)) if not luhn(n) else None
        elif what == 7:
            put([f"{num(4)}-{num(2)}-{num(2)}"], _O)
        else:
            put([f"{letters(3)}{num(3)}"], _O)
            again.append(([tokens[-1]], _O))
    for words, label in again:
        if rng.random() < 0.7:
            tokens.append("\0"), labels.append(_O)
            put(words, label)
    return tokens, labels


@lru_cache(maxsize=2)
def train(seed: int = 7, documents: int = 1500, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights fitted by pseudo-likelihood to invented labelled documents; no input rows are used."""
    rng = np.random.default_rng(seed)
    graph, gold = Graph(), []
    for _ in range(documents):
        tokens, labels = _example(rng)
        text, spans, at = "", [], 0
        for t in tokens:
            spans.append((len(text), len(text) + len(t)))
            text += t + " "
        base = pii_spans(text)
        keep = [i for i, t in enumerate(tokens) if t != "\0"]
        evidence = [{k for a, b, k in base if a < spans[i][1] and b > spans[i][0]} for i in keep]
        graph.add([tokens[i] for i in keep], [spans[i] for i in keep], evidence)
        gold += [labels[i] for i in keep]
    x, edges, kind = graph.arrays()
    gold = np.array(gold)
    one = np.eye(len(LABELS))[gold]
    unary, pair = np.zeros((N_FEATURES, len(LABELS))), np.zeros((2, len(LABELS), len(LABELS)))
    n = len(gold)
    for step in range(steps):
        z = x @ unary
        for k in (0, 1):
            e = edges[kind == k]
            np.add.at(z, e[:, 1], pair[k][gold[e[:, 0]]])
            np.add.at(z, e[:, 0], pair[k].T[gold[e[:, 1]]])
        err = one - _softmax(z)
        rate = 4.0 * (1 - step / steps)
        unary += rate * (x.T @ err / n - 1e-4 * unary)
        for k in (0, 1):
            e = edges[kind == k]
            g = one[e[:, 0]].T @ err[e[:, 1]] + err[e[:, 0]].T @ one[e[:, 1]]
            pair[k] += rate * (g / n - 1e-4 * pair[k])
    return unary, pair


def tag(texts: list[str], weights) -> list[tuple[list, list]]:
    """(base spans, all spans) of every text, about TAGGED_CHARS characters at a time."""
    out, begin, size = [], 0, 0
    for end, text in enumerate(texts, 1):
        size += len(text)
        if size >= TAGGED_CHARS or end == len(texts):
            out += _tag(texts[begin:end], weights)
            begin, size = end, 0
    return out


def _one_entity(kind: str, text: str) -> bool:
    """Whether tokens side by side, of one label, can be one entity: a number of so many digits."""
    return kind in MOST_DIGITS and sum(len(m.group()) for m in _DIGITS.finditer(text)) <= MOST_DIGITS[kind]


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The stretch without punctuation at its ends; brackets stay whose partner lies inside, unless they enclose all."""
    partner, opened = {}, []
    for i in range(a, b):
        if text[i] in "([{<":
            opened.append(i)
        elif text[i] in ")]}>" and opened and "([{<".index(text[opened[-1]]) == ")]}>".index(text[i]):
            partner[i] = opened[-1]
            partner[opened.pop()] = i
    while a < b:
        if partner.get(a) == b - 1 and text[a] in "([{<":
            a, b = a + 1, b - 1
        elif text[a] in _EDGE and partner.get(a, -1) < a:
            a += 1
        elif text[b - 1] in _EDGE and partner.get(b - 1, -1) < a:
            b -= 1
        else:
            break
    return a, b


def _tag(texts: list[str], weights) -> list[tuple[list, list]]:
    graph, held, out = Graph(), [], []
    for text in texts:
        base = pii_spans(text)
        spans = candidates(text)
        evidence, j = [set() for _ in spans], 0
        for a, b, k in base:
            while j and spans[j - 1][1] > a:
                j -= 1
            while j < len(spans) and spans[j][1] <= a:
                j += 1
            i = j
            while i < len(spans) and spans[i][0] < b:
                evidence[i].add(k)
                i += 1
        # Words that repeat the key of a matched token, such as the local part of an address, are tokens too.
        keys = {likeness(text[a:b]) for (a, b), e in zip(spans, evidence, strict=True) if e}
        keys = {k for k in keys if k and not _CANDIDATE.search(k)}
        if words := alike_words(text, keys) if keys else []:
            both = sorted([*zip(spans, evidence, strict=True), *((w, set()) for w in words)], key=lambda t: t[0])
            spans, evidence = [t[0] for t in both], [t[1] for t in both]
        held.append((base, spans, evidence, graph.add([text[a:b] for a, b in spans], spans, evidence)))
    p = beliefs(weights, graph) if graph.on else np.empty((0, len(LABELS)))
    label = p.argmax(1) if len(p) else np.empty(0, int)
    for text, (base, spans, evidence, first) in zip(texts, held, strict=True):
        added, run = [], None
        for i, (a, b) in enumerate(spans):
            k = int(label[first + i])
            if k == _O or evidence[i] or p[first + i, k] < BELIEF:
                run = None
                continue
            # Edges go from the whole of a run: a bracket opened by its first token may close in a later one.
            if run and run[2] == LABELS[k] and spans[i - 1][1] + 1 == a and _one_entity(run[2], text[run[0] : b]):
                run = (run[0], b, run[2])
                added[-1] = (*_trimmed(text, run[0], b), run[2])
            else:
                run = (a, b, LABELS[k])
                added.append((*_trimmed(text, a, b), run[2]))
        out.append((base, in_order(base + added, PII_KINDS)))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base spans array, all spans array) of every row, whole texts, in code points.

    Null and empty texts have no span. Base spans follow fixed patterns; the field adds tokens that
    repeat or resemble a found one elsewhere in the document. Repeated rows are tagged alike; other
    columns are not read.
    """
    weights = train()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def make():
        def each(batch: pa.RecordBatch):
            n = batch.num_rows
            some = pc.fill_null(pc.match_substring_regex(batch.column(1), "[0-9@]"), False).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(some)
            base, full = [[]] * n, [[]] * n
            for i, (b, a) in zip(at, tag(batch.column(1).take(pa.array(at)).to_pylist(), weights), strict=True):
                base[i], full[i] = b, a
            as_list = lambda rows: pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in r] for r in rows], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_list(base), as_list(full)], names=[id_col, "base", "spans"])

        return each

    s = "array<struct<start:long,end:long,kind:string>>"
    return map_batches(docs, [id_col, text_col], make, f"{id_col} {dict(docs.dtypes)[id_col]}, base {s}, spans {s}")


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in angle brackets.

    A text without spans, a null and an empty text stay as they are; overlapping spans are replaced
    as one, named by the first. ``n_chars``, where it is a column, follows the text.
    """
    weights, columns, types = train(), docs.columns, dict(docs.dtypes)
    where = columns.index("text")

    def make():
        def each(batch: pa.RecordBatch):
            column = batch.column(where)
            some = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False)
            at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            clean = []
            texts = column.take(pa.array(at)).to_pylist()
            for text, (_, spans) in zip(texts, tag(texts, weights), strict=True):
                parts, last = [], 0
                for a, b, k in spans:
                    if a >= last:
                        parts += [text[last:a], f"<{k}>"]
                    last = max(last, b)
                clean.append("".join(parts) + text[last:])
            arrays = list(batch.columns)
            arrays[where] = pc.replace_with_mask(column, some, pa.array(clean, column.type)) if len(at) else column
            if "n_chars" in columns and types["n_chars"] == "bigint":
                k = columns.index("n_chars")
                arrays[k] = pc.if_else(some, pc.cast(pc.utf8_length(arrays[where]), pa.int64()), arrays[k])
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

        return each

    return map_batches(docs, [f"`{c}`" for c in columns], make, docs.schema)


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the personal data in every text of ``documents``."""
    return span_digest(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")), PII_KINDS)


def span_digest(found: DataFrame, kinds: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and the SHA-256 of the base spans, and all spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in kinds]
    return found.select(id_col, *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


