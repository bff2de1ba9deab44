"""Fill-in-the-middle documents: token offsets from a Split pre-tokenizer, slices at drawn ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.text import map_batches

TOKEN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the documents that are rearranged, and of those with the suffix in front.
FIM_RATE, SPM_RATE = 90, 20
SEED = 1
#: Characters whose offsets are held at a time; a longer run of letters, one token, is held alone, whole.
PIECE = 1 << 16


class Slicer:
    """Counts the tokens of a text and finds the code points at which given ranks begin."""

    def __init__(self, pattern: str = TOKEN, piece: int = PIECE):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split, self.piece = Split(Regex(pattern), "isolated"), piece

    def offsets(self, text: str) -> np.ndarray:
        """Ends of the tokens of ``text``, in code points."""
        return np.fromiter((end for _, (_, end) in self.split.pre_tokenize_str(text)), np.int64)

    def pieces(self, text: str) -> Iterator[tuple[int, int]]:
        """Stretches that no token crosses: a stretch ends after a character that is no letter."""
        begin = 0
        while begin < len(text):
            end = begin + self.piece
            while end < len(text) and text[end - 1].isascii() and text[end - 1].isalpha():
                end += 1
            end = min(end, len(text))
            yield begin, end
            begin = end

    def cut(self, text: str, ranks) -> tuple[int, list[int]]:
        """(n, code points where the first rank(n) tokens end); ``ranks`` is given n."""
        pieces = list(self.pieces(text))
        if len(pieces) == 1:
            held = [self.offsets(text)]
            sizes = [len(held[0])]
        else:
            held, sizes = None, [len(self.offsets(text[a:b])) for a, b in pieces]
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n, at = int(first[-1]), []
        for rank in ranks(n):
            if rank == 0:
                at.append(0)
                continue
            k = int(np.searchsorted(first, rank, "left")) - 1
            a, b = pieces[k]
            ends = held[0] if held else self.offsets(text[a:b])
            at.append(a + int(ends[rank - first[k] - 1]))
        return n, at


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE, seed: int = SEED
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every whole text.

    Two ranks drawn by the id's hash cut the tokens into prefix, middle and suffix. Form is ``plain``
    (the text as it is, character counts null) for an empty or null text, for one that holds a marker,
    and for the share that is not drawn; else ``spm`` or ``psm``. A null id is drawn as an empty one;
    repeated rows are cut alike; other columns are not read. A worker holds a text, its output and
    the offsets of PIECE characters.
    """
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(draw, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *[c.alias(f"h{k + 1}") for k, c in enumerate(h)])

    def make():
        slicer = Slicer()

        def each(batch: pa.RecordBatch):
            columns = [batch.column(k).to_pylist() for k in range(2, 6)]
            n_out, form, prefix, middle, output = [], [], [], [], []
            for i in range(batch.num_rows):
                text, (h1, h2, h3, h4) = batch.column(1)[i].as_py(), (c[i] for c in columns)
                n, (a, b) = slicer.cut(text, lambda n: sorted((h1 % (n + 1), h2 % (n + 1))))  # noqa: B023
                n_out.append(n)
                if not text or h3 % 100 >= fim_rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    form.append("plain"), prefix.append(None), middle.append(None), output.append(text)
                    continue
                spm = h4 % 100 < spm_rate
                form.append("spm" if spm else "psm"), prefix.append(a), middle.append(b - a)
                parts = (SUFFIX, text[b:], PREFIX, text[:a]) if spm else (PREFIX, text[:a], SUFFIX, text[b:])
                output.append("".join((*parts, MIDDLE, text[a:b])))
            arrays = [batch.column(0), pa.array(n_out, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

        return each

    kind = dict(rows.dtypes)["id"]
    found = map_batches(rows, rows.columns, make, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("id", id_col)


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output of a form was made of; markers occur once each in a rearranged output."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    rest = F.substring(output, 1 + len(PREFIX), 2**31 - 1)
    second = F.when(form == "psm", F.locate(SUFFIX, rest)).otherwise(F.locate(PREFIX, rest))
    third = F.locate(MIDDLE, rest)
    one = F.substring(rest, F.lit(1), second - 1)
    two = F.substring(rest, second + len(SUFFIX), third - second - len(SUFFIX))
    three = F.substring(rest, third + len(MIDDLE), F.length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's rearranged text, and of the text rebuilt from it."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


OP13_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents
), d as (
  select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as tok,
    ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from t
), c as (
  select *, len(tok) as n, least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) as a, greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from d
), p as (
  select *, array_to_string(tok[1:a], '') as pre, array_to_string(tok[a + 1:b], '') as mid, array_to_string(tok[b + 1:], '') as suf from c
)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
