"""Token counts that follow edits.

A document's text is cut into the tokenizer's pre-tokens, which are encoded apart, so its number of tokens is the sum of
its pre-tokens' numbers. A segment tree holds those sums: its leaves are runs of at most LEAF pre-tokens with their
lengths and token counts, each inner node the sums of two. An edit replaces a range of characters. The pre-tokens it
touches are cut again from the last one before it that can't feel it, until a new cut falls on an old one behind it;
only that region is encoded, the leaves it lies in are replaced, and sums change on the path to the root.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded_batches, cache, claim, slices

LEAF = 64
#: Pre-tokens whose counts a worker keeps; the older half goes when it is full.
CACHE = 700_000
#: Characters beyond a pre-token's end that its cut may look at.
CONTEXT = 2

EDIT = "array<struct<start:int,length:int,insert:string>>"


class PreTokens:
    """Cuts text as the byte-level tokenizer does and counts the tokens of each piece."""

    def __init__(self, path: str):
        import os

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cut = regex.compile(public_tokenizers.PATTERN)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, int] = cache("edit_counts")

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not met before, in one call."""
        known = self.known
        if len(known) > CACHE:
            for key in list(known)[: CACHE // 2]:
                del known[key]
        fresh = [p for p in pieces if p not in known]
        if fresh:
            known.update(zip(fresh, (len(x.ids) for x in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)), strict=True))

    def counts(self, pieces: list[str]) -> list[int]:
        self.learn(set(pieces))
        return [self.known[p] for p in pieces]


class CountTree:
    """A document's pre-tokens under a tree of sums of (characters, tokens)."""

    def __init__(self, text: str, pre: PreTokens, pieces: list[str] | None = None):
        self.text, self.pre = text, pre
        pieces = pre.cut.findall(text) if pieces is None else pieces
        counts = pre.counts(pieces)
        self.leaves = [([len(p) for p in pieces[i : i + LEAF]], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)]
        self.encoded = 0
        self._build()

    def _build(self) -> None:
        """Sums bottom-up in an array: node k over nodes 2k and 2k + 1, leaves from `width` on."""
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (lengths, counts) in enumerate(self.leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(lengths), sum(counts)
        for k in range(self.width - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character; the last leaf beyond the end."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if position >= before + self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.width, before

    def _set_leaf(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (lengths, counts)
        k = self.width + leaf
        chars, tokens = sum(lengths) - self.chars[k], sum(counts) - self.tokens[k]
        while k:
            self.chars[k] += chars
            self.tokens[k] += tokens
            k //= 2

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace text[start : start + length] (clipped to the text) by `insert`."""
        start = max(0, min(start, len(self.text)))
        length = max(0, min(length, len(self.text) - start))
        old_end, shift = start + length, len(insert) - length
        self.text = self.text[:start] + insert + self.text[start + length :]
        if not self.leaves:
            self.leaves = [([], [])]
            self._build()
        first, at = self._leaf_at(max(0, start - CONTEXT))
        lengths, counts = self.leaves[first]
        ends = (np.cumsum(lengths) + at).tolist()
        keep = bisect_right(ends, start - CONTEXT)  # pre-tokens that end early enough stay
        scan = ends[keep - 1] if keep else at
        new: list[str] = []
        # old cuts behind the edit, leaf after leaf
        leaf, place, offset = first, at, 0
        bounds = [at, *ends]
        position, stop = scan, None
        for piece in self.pre.cut.finditer(self.text, scan):
            position = piece.end()
            new.append(piece.group())
            target = position - shift
            if target < old_end:
                continue
            while target > bounds[-1] and leaf + 1 < len(self.leaves):
                leaf += 1
                place = bounds[-1]
                bounds = [place, *(np.cumsum(self.leaves[leaf][0]) + place).tolist()]
            offset = bisect_right(bounds, target) - 1
            if 0 <= offset < len(bounds) and bounds[offset] == target:
                stop = (leaf, offset)
                break
        if stop is None:
            stop = (len(self.leaves) - 1, len(self.leaves[-1][0]))
        self.encoded += sum(map(len, new))
        added = self.pre.counts(new)
        last, cut = stop
        all_lengths = lengths[:keep] + [len(p) for p in new] + self.leaves[last][0][cut:]
        all_counts = counts[:keep] + added + self.leaves[last][1][cut:]
        if first == last and len(all_lengths) <= 2 * LEAF:
            self._set_leaf(first, all_lengths, all_counts)
            return
        groups = [(all_lengths[i : i + LEAF], all_counts[i : i + LEAF]) for i in range(0, len(all_lengths), LEAF)] or [([], [])]
        if len(groups) == last - first + 1:
            for k, (a, b) in enumerate(groups):
                self._set_leaf(first + k, a, b)
        else:  # the number of leaves changes: sums are made again, nothing is encoded
            self.leaves[first : last + 1] = groups
            self._build()


_pre: dict[str, PreTokens] = {}


def pre_tokens(path: str) -> PreTokens:
    """One for each worker process and tokenizer file; claims the worker."""
    claim("edit_counts")
    if path not in _pre:
        _pre[path] = PreTokens(path)
    return _pre[path]


def count_edits(docs: DataFrame, tokenizer: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Add n_tokens, edited_tokens, edited_chars, encoded_chars to docs, whose `edits` column is an EDIT array.

    Edits apply in order, positions in code points of the text as it then is; positions beyond the text are moved to its
    end. encoded_chars is what the edits made necessary to cut and encode again. A null text is empty, null edits are
    none, a null start or length is 0, a null insert empty. Columns of docs with these names are replaced, all rows stay.
    """
    bounded_batches(docs.sparkSession)
    made = ("n_tokens", "edited_tokens", "edited_chars", "encoded_chars")
    kept = docs.drop(*made)
    names = [c for c in kept.columns if c not in (text, edits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = pre_tokens(tokenizer)
        for whole in batches:
            for batch in slices(whole, text):
                texts = batch.column(text).fill_null("").to_pylist()
                cuts = [pre.cut.findall(t) for t in texts]
                pre.learn(set().union(*cuts))
                rows = []
                for t, pieces, changes in zip(texts, cuts, batch.column(edits).to_pylist(), strict=True):
                    tree = CountTree(t, pre, pieces)
                    n = tree.total
                    for e in changes or []:
                        if e:
                            tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                    rows.append((n, tree.total, len(tree.text), tree.encoded))
                cols = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(list(c), pa.int64()) for c in cols)], [*names, *made])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names] + [f"{c} long" for c in made]
    return kept.withColumn(text, F.col(text).cast("string")).mapInArrow(run, ", ".join(schema))


def sample_edits(text: Column) -> Column:
    """Four edits of a text, from its length n: drop 40 characters at n / 5, put a sentence in at n / 2, replace 12
    characters at 3 n / 4 by a word, add a line at the end."""
    n = F.coalesce(F.length(text), F.lit(0))
    change = lambda start, length, insert: F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"), F.lit(insert).alias("insert"))
    return F.array(
        change(F.floor(n / 5), 40, ""), change(F.floor(n / 2), 0, " This sentence is new, it's 100% made up. "),
        change(F.floor(n * 3 / 4), 12, "replacement"), change(n + 1000, 0, "\nThe end."),
    )


def edit_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, edited_tokens, edited_chars, encoded_chars of every whole text after sample_edits.

    A null text is an empty one, a null doc_id stays null, repeated rows are counted each for itself, extra columns are
    ignored whatever their names; an empty table gives an empty result.
    """
    chosen = docs.select("doc_id", "text", sample_edits(F.col("text")).alias("edits"))
    return count_edits(chosen, tokenizer)
