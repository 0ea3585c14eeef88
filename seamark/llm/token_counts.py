"""Token counts of a document's sections from one encoding of the whole document."""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import ready

#: Words with a leading space, numbers, other signs and white space, as the vocabulary was built with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most")
#: Signs of white space in a row that are encoded together; what is longer is encoded in pieces of so many, as the pattern looks back over all of them.
LONGEST_SPACE = 1000
LONG_SPACE = re.compile(rf"\s{{{LONGEST_SPACE + 1},}}")


@lru_cache(maxsize=4)
def byte_encoder(path: str):
    """The encoder of a rank file and the number of bytes of each of its tokens."""
    import tiktoken

    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return encoding, lengths


def stretches(text: str) -> list[str]:
    """The text in pieces to be encoded one by one: whole, but for runs of white space longer than ``LONGEST_SPACE``, which are cut."""
    out, last = [], 0
    for run in LONG_SPACE.finditer(text):
        for k in range(run.start() + LONGEST_SPACE, run.end(), LONGEST_SPACE):
            out.append(text[last:k])
            last = k
    return [*out, text[last:]]


def line_edges(data: np.ndarray) -> np.ndarray:
    """Where a text's lines end, in bytes; a line includes its line feed."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def attribute(token_bytes: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) for each section: the tokens it is given, and those of them that cross a boundary.

    Both are spans over the same bytes. A token inside one section belongs to it. A
    crossing one goes, by ``rule``, to the section of its first byte, of its last
    byte, or to the one that holds most of its bytes (the earlier of equals).
    """
    ends = np.cumsum(token_bytes)
    starts = ends - token_bytes
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, ends - 1, "right")
    crossing = first != last
    owner = last if rule == "last" else first.copy()
    if rule == "most":
        for t in np.flatnonzero(crossing):
            edges = np.concatenate([[starts[t]], section_ends[first[t] : last[t]], [ends[t]]])
            owner[t] = first[t] + int(np.diff(edges).argmax())
    count = len(section_ends)
    return np.bincount(owner, minlength=count), np.bincount(owner[crossing], minlength=count)


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", rule: str = "most") -> DataFrame:
    """One row per line of each document: (key, section int, first_char long, n_chars long, n_tokens long, n_crossing long).

    The document is encoded once as a whole, so tokens are those a model would see;
    their spans are then matched with those of the lines, by bytes: a byte-level token
    may hold part of a character. ``n_tokens`` of a document's lines add up to its
    whole count. ``tokenizer`` is a rank file that every executor can read. Strings of
    special tokens are ordinary text. Runs of more than ``LONGEST_SPACE`` signs of white space are encoded in pieces of that length.

    A null text gives one section with null counts, an empty one a section of none;
    ids are not looked at, so null and repeated ones keep all their rows. No shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ready(docs.sparkSession)

    def count(batches):
        encoding, lengths = byte_encoder(tokenizer)
        for batch in batches:
            rows, sections, firsts, chars, tokens, crosses = [], [], [], [], [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                if body is None:
                    rows.append([row]), sections.append([0])
                    for x in (firsts, chars, tokens, crosses):
                        x.append([-1])
                    continue
                raw = np.frombuffer(body.encode(), np.uint8)
                edges = line_edges(raw)
                spans = lengths[np.concatenate([np.array(encoding.encode_ordinary(s), np.int64) for s in stretches(body)])]
                given, crossing = attribute(spans, edges, rule)
                begins = np.concatenate([[0], edges[:-1]])
                heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                rows.append(np.full(len(edges), row)), sections.append(np.arange(len(edges)))
                firsts.append(heads[begins]), chars.append(heads[edges] - heads[begins])
                tokens.append(given), crosses.append(crossing)
            if not rows:
                continue
            place = np.concatenate(rows).astype(np.int64)
            columns = [np.concatenate(x).astype(np.int64) for x in (firsts, chars, tokens, crosses)]
            none = columns[0] < 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(place)),
                    pa.array(np.concatenate(sections).astype(np.int32)),
                    *[pa.array(x, mask=none) for x in columns],
                ],
                [key, "section", "first_char", "n_chars", "n_tokens", "n_crossing"],
            )

    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, section int, first_char long, n_chars long, n_tokens long, n_crossing long"
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(count, schema)
