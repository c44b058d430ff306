"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit one linear n-gram classifier tells the languages with a 1 from those
with a 0: the mean, over a text's letter n-grams, of the log odds of the n-gram in either group. Counts of n-grams come
from all labelled training rows in one aggregation. Loss-weighted decoding adds up, for each language, the logistic loss
of its codeword's bits, each weighted by how often that bit came out right for that language on a fold of the training
rows that classifiers learnt from the other rows have not seen, and takes the language with the least loss. A text is ambiguous if more of its bits are off the nearest codeword
than the code can correct, or if the runner-up's loss is close.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, bounded_batches, claim, slices, text_bytes, trimmed

#: Features: all pairs of bytes, then triples by hash.
FEATURES = (1 << 16) + (1 << 16)
UNKNOWN = "und"
CLOSE = 0.1
#: Labels learnt, those with the most training rows: the tables on the driver are this many x FEATURES at most.
MOST_LANGUAGES = 256
_STEP = 1 << 19


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each language: exhaustive codes up to 7, beyond the best of seeded random dense ones."""
    if languages < 3:
        return np.array([[1], [-1]])[:languages]
    if languages <= 7:
        columns = [(1, *bits) for bits in itertools.product((1, -1), repeat=languages - 1) if -1 in bits]
        return np.array(columns).T
    rng, bits = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(languages)))
    made = (np.where(rng.random((languages, bits)) < 0.5, 1, -1) for _ in range(200))
    return max(made, key=lambda c: int(((bits - c @ c.T) // 2)[np.triu_indices(languages, 1)].min()))


def ngrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all letter n-grams of texts laid end to end, where each text's begin, and its number of letter bytes.

    Letters are lower-cased (ASCII and Latin-1); whatever lies between two runs of letters counts as one space, and each
    text stands between spaces. Features of text i: [begin[i], begin[i + 1]).
    """
    n_texts = len(at) - 1
    low = LOWER[raw]
    after_c3 = np.zeros(len(raw), dtype=bool)
    after_c3[1:] = raw[:-1] == 0xC3
    low = np.where(after_c3 & (low >= 0x80) & (low <= 0x9E), low + 0x20, low).astype(np.uint8)
    letter = ((low >= 97) & (low <= 122)) | (low >= 0x80)
    # each text gets a space before it and after it; runs of anything but letters become one space
    padded = np.full(len(raw) + 2 * n_texts, 32, dtype=np.uint8)
    of_text = np.repeat(np.arange(n_texts), np.diff(at))
    place = np.arange(len(raw)) + 2 * of_text + 1
    padded[place] = np.where(letter, low, 32)
    owner = np.repeat(np.arange(n_texts), np.diff(at) + 2)
    space = padded == 32
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1] & (owner[1:] == owner[:-1]))
    text, owner = padded[keep].astype(np.uint32), owner[keep]
    letters = np.bincount(of_text[letter], minlength=n_texts)
    pair = text[:-1] << 8 | text[1:]
    triple = ((pair[:-1] << 8 | text[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    same2, same3 = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    features = np.concatenate([pair[same2], triple[same3] + np.uint32(1 << 16)])
    owners = np.concatenate([owner[:-1][same2], owner[:-2][same3]])
    order = np.argsort(owners, kind="stable")
    return features[order], np.searchsorted(owners[order], np.arange(n_texts + 1)), letters


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x features
    trust: np.ndarray  # languages x bits, each row sums to 1

    def margins(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text and bit the sum of log odds over the root of the number of n-grams; the numbers of letters."""
        features, begin, letters = ngrams(raw, at)
        n = np.diff(begin)
        sums = np.zeros((len(n), len(self.weights)))
        some = np.flatnonzero(n)
        for b, w in enumerate(self.weights):
            if len(some):
                sums[some, b] = np.add.reduceat(w[features], begin[some], dtype=np.float64)
        return sums / np.sqrt(np.maximum(n, 1))[:, None], letters

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword of each row, its share by loss (0 to 1), and whether it is ambiguous."""
        losses = np.stack([np.logaddexp(0, -margins * code) @ trust for code, trust in zip(self.codes, self.trust, strict=True)], axis=1)
        best = losses.argmin(axis=1)
        least = losses[np.arange(len(best)), best]
        share = 1 / np.exp(np.clip(least[:, None] - losses, -700, 0)).sum(axis=1)
        wrong = (np.where(margins >= 0, 1, -1) != self.codes[best]).sum(axis=1)
        k = len(self.languages)
        apart = min((int((a != b).sum()) for a, b in itertools.combinations(self.codes, 2)), default=1)
        second = np.partition(losses, 1, axis=1)[:, 1] if k > 1 else np.full(len(best), np.inf)
        return best, share, (2 * wrong >= max(apart, 2)) | (second - least < CLOSE)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 modulo 4 (a null doc_id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _weights(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The bits' classifiers from counts (languages x FEATURES): log odds of each n-gram in either group of languages."""
    share = (table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True)
    return np.stack([np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0)) for bit in codes.T]).astype(np.float32)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", most: int = MOST_LANGUAGES) -> Model | None:
    """Learn from all rows with one of the `most` most frequent labels; None without any. Null texts count for nothing.

    What returns to the driver: at most FEATURES counts for each label and fold.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("lang"))
    languages = sorted(r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect())
    if not languages:
        return None
    fold = F.coalesce(F.crc32(F.col("text").cast("binary")) % 4 == 1, F.lit(False))
    rows = rows.where(F.col("lang").isin(languages)).withColumn("fold", fold)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id")
        totals: dict[tuple[str, bool], np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text", _STEP):
                features, begin, _ = ngrams(*text_bytes(batch.column("text")))
                groups = list(zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist(), strict=True))
                for group in set(groups):
                    own = np.repeat(np.array([x == group for x in groups]), np.diff(begin))
                    totals[group] = totals.get(group, 0) + np.bincount(features[own], minlength=FEATURES)
        for (lang, folded), c in totals.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([folded] * len(at), pa.bool_()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "fold", "feature", "n"])

    counts = rows.mapInArrow(trimmed(count), "lang string, fold boolean, feature int, n long").groupBy("lang", "fold", "feature").agg(F.sum("n").alias("n")).toArrow()
    place = {x: i for i, x in enumerate(languages)}
    table = np.zeros((2, len(languages), FEATURES))
    of_fold = counts.column("fold").to_numpy(zero_copy_only=False).astype(int)
    table[of_fold, [place[x] for x in counts.column("lang").to_pylist()], counts.column("feature").to_numpy()] = counts.column("n").to_numpy()
    codes = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, codes, np.zeros((1, FEATURES), np.float32), np.ones((1, 1)))
    even = np.full(codes.shape, 1 / codes.shape[1])
    shared = labelled.sparkSession.sparkContext.broadcast(Model(languages, codes, _weights(table[0], codes), even))  # languages x bits x FEATURES, whatever the input

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id")
        m = shared.value
        right, seen = np.zeros(m.codes.shape), np.zeros(len(m.languages))
        for whole in batches:
            for batch in slices(whole, "text", _STEP):
                margins, letters = m.margins(*text_bytes(batch.column("text")))
                own = np.array([place[x] for x in batch.column("lang").to_pylist()])
                np.add.at(right, own[letters > 0], (np.sign(margins) == m.codes[own])[letters > 0])
                np.add.at(seen, own[letters > 0], 1)
        for i in range(len(m.languages)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([seen[i]]), pa.array([right[i].tolist()])], ["language", "seen", "bits"])

    judged = rows.where("fold").mapInArrow(trimmed(judge), "language long, seen double, bits array<double>").select("language", "seen", F.posexplode("bits").alias("bit", "ok"))
    trust = even.copy()
    for r in judged.groupBy("language", "bit").agg(F.sum("seen").alias("seen"), F.sum("ok").alias("ok")).collect():
        trust[r["language"], r["bit"]] = (r["ok"] + 1) / (r["seen"] + 2)
    shared.unpersist()
    return Model(languages, codes, _weights(table.sum(axis=0), codes), trust / trust.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous to every row, from its text alone.

    A text that is null or has no letter is `und` with score 0; without a model all are. Columns of docs with these
    names are replaced; other columns, repeated rows and nulls pass through.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score", "ambiguous")
    names = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id")
        m = shared.value
        for whole in batches:
            for batch in slices(whole, text, _STEP):
                n = batch.num_rows
                lang, score, ambiguous = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.ones(n, dtype=bool)
                if m is not None:
                    margins, letters = m.margins(*text_bytes(batch.column(text)))
                    letter = pc.match_substring_regex(batch.column(text).fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
                    real = (letters > 0) & letter  # bytes beyond ASCII needn't be letters
                    best, share, unsure = m.decode(margins)
                    lang[real], score[real], ambiguous[real] = np.array(m.languages, dtype=object)[best[real]], share[real], unsure[real]
                arrays = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(ambiguous)], [*names, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double, ambiguous boolean"
    return kept.mapInArrow(trimmed(label), schema.lstrip(", "))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, then predict every row: doc_id, held_out, lang_pred, score, ambiguous.

    A row with a null doc_id isn't held out. Null texts, texts without a letter and, if no row has a label, all texts are
    `und`. Repeated rows count as often as they occur and each get a row; extra columns are ignored; an empty table gives
    an empty result.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")), model).drop("text")
