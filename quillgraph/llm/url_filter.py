"""URL filters: all wildcard rules simulated at once by a bit-parallel automaton."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.text import map_batches

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path.
HOST_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Globs over host + path that decide where no rule fits; ``*`` is any run, ``?`` any one byte.
BLOCK_GLOBS = ("*casino*", "*free-bets*", "*adult-*", "*spam-farm*", "*poker*", "*xxx*", "*porn*", "*viagra*")
#: Stands between host and path; no UTF-8 text holds this byte.
BORDER = b"\xff"


class ShiftAnd:
    """Anchored globs packed into words of 64 state bits; one step moves every glob at once.

    Bit j of a glob means that its first j literals have matched. A ``*`` after them keeps the bit
    alive on any byte; a glob fits if its last bit is alive at the end. Globs that do not name BORDER
    read past it as if it were not there; in a glob that names it, what stands before it can only
    match before it.
    """

    def __init__(self, globs: list[bytes | str]):
        bits, starts, ends, stay, masks, blind = 0, [], [], [], {}, []
        self.globs = [g if isinstance(g, bytes) else g.encode() for g in globs]
        for raw in self.globs:
            at, sees = bits, BORDER in raw
            starts.append(at)
            literals = 0
            for c in raw:
                if c == 0x2A:
                    stay.append(at + literals)
                else:
                    literals += 1
                    for b in range(255) if c == 0x3F else (c,):
                        masks.setdefault(b, []).append(at + literals)
            ends.append(at + literals)
            if not sees:
                blind += range(at, at + literals + 1)
            bits += literals + 1
        self.words = max(1, -(-bits // 64))
        self.start, self.stay = self._pack(starts), self._pack(stay)
        self.last_bits = np.array(ends, np.int64)
        #: A shift must not carry a glob's last bit into the next glob's first.
        self.shiftable = ~self._pack(ends)
        self.step = np.zeros((256, self.words), np.uint64)
        for b, where in masks.items():
            self.step[b] = self._pack(where)
        #: Bits that stay alive on each byte.
        self.hold = np.tile(self.stay, (256, 1))
        self.hold[BORDER[0]] |= self._pack(blind)

    def _pack(self, where) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for j in where:
            out[j // 64] |= np.uint64(1) << np.uint64(j % 64)
        return out

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Boolean (text, glob); every text is read whole, byte by byte, all texts side by side."""
        n = len(texts)
        out = np.zeros((n, len(self.globs)), bool)
        if not n or not self.globs:
            return out
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        for pos in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -pos, "left"))  # texts longer than pos
            now = state[:live]
            moved = now & self.shiftable
            carry = moved[:, :-1] >> top
            moved = moved << one
            moved[:, 1:] |= carry
            byte = data[begin[:live] + pos]
            state[:live] = (moved & self.step[byte]) | (now & self.hold[byte])
        word, bit = self.last_bits // 64, (self.last_bits % 64).astype(np.uint64)
        out[order] = ((state[:, word] >> bit) & one).astype(bool)
        return out


def host_and_path(url: str = "url") -> tuple:
    """Columns host and path: no ``://`` or null gives two empty strings."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(df: DataFrame, key: str = "page_id", url: str = "url", rules=HOST_RULES, globs=BLOCK_GLOBS) -> DataFrame:
    """(key, host, path, rule, verdict): the longest fitting rule decides, else the block globs.

    Rules and globs run in one automaton over the host, a border, and the path: the host of a rule
    ends at the border, its path begins there. Null or unparsable urls have empty host
    and path and are allowed unless a glob fits the empty string. Other columns are not read.
    """
    rules = sorted(rules, key=lambda r: -len(r[1] + r[2]))  # longest first
    names = [h + p for _, h, p in rules]
    patterns = [start + h.encode() + BORDER + p.encode() + b"*" for _, h, p in rules for start in (b"", b"*.")]
    verdicts = [v for v, _, _ in rules]

    def make():
        automaton = ShiftAnd(patterns + list(globs))

        def each(batch: pa.RecordBatch):
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            fits = automaton.match([h.encode() + BORDER + p.encode() for h, p in zip(hosts, paths, strict=True)])
            of_rule = fits[:, : len(patterns)].reshape(len(hosts), len(rules), 2).any(2)
            by_rule, first = of_rule.any(1), of_rule.argmax(1) if len(rules) else np.zeros(len(hosts), int)
            blocked = fits[:, len(patterns) :].any(1)
            rule = [names[first[i]] if by_rule[i] else None for i in range(len(hosts))]
            verdict = [verdicts[first[i]] if by_rule[i] else "block" if blocked[i] else "allow" for i in range(len(hosts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[key, "host", "path", "rule", "verdict"])

        return each

    host, path = host_and_path(url)
    parts = df.select(F.col(key), host.alias("host"), path.alias("path"))
    return map_batches(parts, [key, "host", "path"], make, f"{key} {dict(parts.dtypes)[key]}, host string, path string, rule string, verdict string")


def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every ``pages`` url."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in HOST_RULES)
_GLOB_TEST = " OR ".join(f"contains(host || path, '{g.strip('*')}')" for g in BLOCK_GLOBS)
OP9_SQL = f"""
WITH t AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
r(v, h, s) AS (VALUES {_RULE_ROWS}),
f AS (SELECT p.page_id, max_by(h || s, length(h || s)) AS rule, max_by(v, length(h || s)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, CASE WHEN {_GLOB_TEST} THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id
"""
