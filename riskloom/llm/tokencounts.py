"""Token counts attributed to sections by offsets.

Each whole text is encoded once. A byte-level vocabulary gives every token's length, so running sums are
the tokens' byte spans in the text; sections, given in code points, are put in bytes the same way, and a
sorted search joins the two interval lists. A token that lies across sections is counted for one of them by
a stated rule, so the sections' counts always sum to the text's tokens:

* ``first``: the section of the token's first byte (the default);
* ``last``: the section of its last byte;
* ``most``: the section that holds most of its bytes, the earlier of equals.

The split pattern's regular expression engine runs out of stack on a run of about a million blanks. The
pattern takes all of a run of white space but its last character (or all of it at the end of the text) as
one piece, so runs of ``LONG_BLANKS`` or more are cut out here, encoded as that piece, and the texts around
them encoded on their own: the tokens are those of the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import buffers

#: The split pattern of the byte-level vocabularies. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("first", "last", "most")
LONG_BLANKS = 4096
#: Unicode white space, as \s in the pattern has it. Fixed values.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_ids(encoder, text: str, long_blanks: int = LONG_BLANKS) -> list[int]:
    """The encoder's tokens of a text of any kind and length."""
    out, at = [], 0
    for run in re.finditer(f"[{BLANKS}]{{{long_blanks},}}", text):
        stop = run.end() - (run.end() < len(text))  # the last blank goes with what follows
        out += encoder.encode_ordinary(text[at : run.start()])
        out += encoder._encode_single_piece(text[run.start() : stop])
        at = stop
    return out + encoder.encode_ordinary(text[at:])


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which lines begin, and the end; a line break belongs to the line it ends."""
    at = np.flatnonzero(data == 10) + 1
    inner = at[at < len(data)]
    return np.r_[0, inner, len(data)]


def attribute(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token or -1, whether it crosses a border) for disjoint ascending sections low..high, all in bytes."""
    n = len(low)
    a = np.searchsorted(low, starts, side="right") - 1  # the last section that begins at or before the first byte
    b = np.searchsorted(low, ends - 1, side="right") - 1
    inside = lambda i, x: (i >= 0) & (x < high[np.maximum(i, 0)]) if n else np.zeros(len(x), dtype=bool)
    in_a, in_b = inside(a, starts), inside(b, ends - 1)
    crossing = ~((a == b) & in_a & in_b) & (in_a | in_b | (a != b))
    if rule == "first":
        return np.where(in_a, a, -1), crossing
    if rule == "last":
        return np.where(in_b, b, -1), crossing
    out = np.where(in_a & (a == b) & in_b, a, -1)
    for i in np.flatnonzero(crossing).tolist():  # few: only tokens on a border
        best, most = -1, 0
        for s in range(max(0, int(a[i])), int(b[i]) + 1):
            held = min(int(ends[i]), int(high[s])) - max(int(starts[i]), int(low[s]))
            if held > most:
                best, most = s, held
        out[i] = best
    return out, crossing


SCHEMA = "doc_id bigint, section int, start bigint, end bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint"


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sections: str | None = None, vocabulary: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """One row for each section of each text: its tokens, and how many of them lie across a border.

    ``sections`` names a column of disjoint ascending code point ranges, array<struct<start, end>>; without
    it each line is a section. Tokens outside all sections make a row of section -1 (null range), if there
    are any. A null or empty text has no tokens, and one empty line. Ranges are cut to the text; an empty
    range has no tokens; a null array has no sections. Repeated rows are counted each; an empty table gives
    no rows; other columns are not read. ``doc_tokens`` is the number of tokens of the whole text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # one vocabulary, whatever the data
    spans = F.lit(None).cast("array<struct<start:bigint,end:bigint>>") if sections is None else F.transform(sections, lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end")))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), spans.alias("sections"))
    by_lines = sections is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        length = np.zeros(max(ranks.value.values()) + 1, dtype=np.int64)
        for piece, rank in ranks.value.items():
            length[rank] = len(piece)
        for batch in batches:
            data, off = buffers(batch.column(1))
            given = None if by_lines else batch.column(2).to_pylist()
            cols: list[list] = [[] for _ in range(6)]
            owners = []
            for i, value in enumerate(batch.column(1)):
                raw = data[off[i] : off[i + 1]]
                ids = np.array(token_ids(encoder, value.as_py() or ""), dtype=np.int64)
                ends = np.cumsum(length[ids])
                starts = ends - length[ids]
                if by_lines:
                    bounds = line_bounds(raw)
                    low, high = bounds[:-1], bounds[1:]
                    chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                    begin, stop = chars[low], chars[high]
                else:
                    places = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]
                    ranges = given[i] or []
                    begin = np.array([min(max(0, r["start"]), len(places) - 1) for r in ranges], dtype=np.int64)
                    stop = np.maximum(begin, np.array([min(r["end"], len(places) - 1) for r in ranges], dtype=np.int64))
                    low, high = places[begin], places[stop]
                section, crossing = attribute(starts, ends, low, high, rule)
                n = len(low)
                held = np.bincount(section + 1, minlength=n + 1)
                across = np.bincount(section + 1, crossing, n + 1).astype(np.int64)
                extra = int(held[0] > 0)
                owners.append(np.full(n + extra, i))
                cols[0].append(np.r_[np.arange(n), [-1] * extra])
                cols[1].append(np.r_[begin, [-1] * extra])
                cols[2].append(np.r_[stop, [-1] * extra])
                cols[3].append(np.r_[held[1:], held[:1] if extra else []])
                cols[4].append(np.r_[across[1:], across[:1] if extra else []])
                cols[5].append(np.full(n + extra, len(ids)))
            if owners:
                owner = np.concatenate(owners)
                section, begin, stop, *counts = (np.concatenate(c).astype(np.int64) for c in cols)
                void = section < 0
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(section.astype(np.int32)), pa.array(begin, mask=void), pa.array(stop, mask=void), *(pa.array(c) for c in counts)], [x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
