"""Output codes, I-Match and plain Jaccard links against plain Python; names that clash, long texts, extra columns."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tests_words import near_groups, words

from tidewatch.llm import common, embedding_dedup, hmm, imatch, language_id, licenses, near_dedup, packing, token_files

LANGS = {"en": ["the", "and", "of", "thing", "wing"], "fr": ["été", "les", "où", "ça", "ment"], "de": ["über", "und", "ß", "keit", "der"], "es": ["año", "los", "ción", "que", "del"]}


def features(text):
    """Letter n-grams of a text as feature numbers."""
    out, last = [32], 0
    for b in (text or "").encode():
        c = b + 32 if 65 <= b <= 90 or last == 0xC3 and 0x80 <= b <= 0x9E else b
        last = b
        if not (97 <= c <= 122 or c >= 0x80):
            c = 32
        if c != 32 or out[-1] != 32:
            out.append(c)
    if out[-1] != 32:
        out.append(32)
    pairs = [a << 8 | b for a, b in zip(out, out[1:], strict=False)]
    triples = [((a << 16 | b << 8 | c) * 2654435761 % 2**32 >> 16) + 65536 for a, b, c in zip(out, out[1:], out[2:], strict=False)]
    return pairs + triples


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(3)
    rows = []
    for i in range(160):
        lang = list(LANGS)[i % 4]
        other = list(LANGS)[(i + 1) % 4]
        pool = LANGS[lang] * 3 + LANGS[other] * (4 if i % 9 == 0 else 0)
        rows.append((i, " ".join("".join(rng.choices(pool, k=rng.randint(1, 2))) for _ in range(rng.randint(1, 30))) + ".", lang if i % 11 else None))
    return rows + [(200, None, "en"), (201, "", "fr"), (202, "½ 12 ²", "de"), (203, "中", None), (None, "les années", "fr")]


def test_language_codes_by_plain_loops(spark, labelled):
    langs = sorted(LANGS)
    codes = language_id.codewords(4)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    train = [(t, x) for d, t, x in labelled if x and not held(d)]
    in_fold = lambda t: t is not None and zlib.crc32(t.encode()) % 4 == 1

    def classifiers(rows):
        counts = {x: Counter() for x in langs}
        for t, x in rows:
            counts[x].update(features(t) if t is not None else [])
        table = np.array([[0.5 + counts[x][f] for f in range(language_id.FEATURES)] for x in langs])
        share = table / table.sum(axis=1, keepdims=True)
        return [np.log(share[codes[:, b] > 0].mean(axis=0)) - np.log(share[codes[:, b] < 0].mean(axis=0)) for b in range(codes.shape[1])]

    margin = lambda ws, t: [sum(w[f] for f in features(t)) / math.sqrt(len(features(t))) for w in ws]
    lettered = lambda t: any(97 <= b | 32 <= 122 or b >= 128 for b in (t or "").encode())
    unseen = classifiers([r for r in train if not in_fold(r[0])])
    right, seen = np.zeros(codes.shape), Counter()
    for t, x in train:
        if in_fold(t) and lettered(t):
            seen[x] += 1
            right[langs.index(x)] += np.sign(margin(unseen, t)) == codes[langs.index(x)]
    trust = np.array([(right[i] + 1) / (seen[x] + 2) for i, x in enumerate(langs)])
    trust /= trust.sum(axis=1, keepdims=True)
    ws = classifiers(train)
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(labelled, "doc_id long, text string, lang string")).collect()}
    apart = min(int((codes[i] != codes[j]).sum()) for i in range(4) for j in range(i))
    for d, t, _ in labelled:
        if d in (200, 201, 202):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        m = margin(ws, t)
        losses = [sum(w * math.log1p(math.exp(-c * x)) for w, c, x in zip(trust[i], codes[i], m, strict=True)) for i in range(4)]
        best = min(range(4), key=losses.__getitem__)
        wrong = sum((1 if x >= 0 else -1) != c for x, c in zip(m, codes[best], strict=True))
        ambiguous = 2 * wrong >= apart or sorted(losses)[1] - losses[best] < language_id.CLOSE
        assert (got[d]["lang_pred"], got[d]["held_out"], got[d]["ambiguous"]) == (langs[best], held(d), ambiguous)
        assert got[d]["score"] == pytest.approx(1 / sum(math.exp(losses[best] - x) for x in losses), rel=1e-3)


def test_most_frequent_labels_are_learnt(spark):
    rows = [(i, "the thing" if i % 2 else "les été", "en" if i % 2 else "fr") for i in range(40)] + [(50, "und über", "de")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=2)
    assert model.languages == ["en", "fr"]


M = (1 << 64) - 1


def mix(x):
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * k & M
    return x ^ x >> 33


def test_imatch_by_plain_loops(spark):
    rng = random.Random(8)
    voc = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        base = rng.choices(voc, k=rng.choice([3, 40, 300]))
        rows.append((i, " ".join(w + rng.choice(["", "", ",", ".", "!?"]) for w in base)))
    rows += [(200, None), (201, ""), (202, rows[4][1]), (203, "never seen words"), (204, "?"), (205, rows[9][1].upper())]
    terms = lambda t: sorted({w[:-1] if len(w.encode()) > 1 and w[-1] in ".,;:!?" else w for w in words(t)})
    number = lambda w: int(common.words(*common.text_bytes(pa.array([w])))[3][0]) >> 24
    df = Counter(w for _, t in rows for w in terms(t))
    least, most = imatch.LEAST, 0.2
    known = {number(w) for w, n in df.items() if max(2, least * len(rows)) <= n <= max(2, most * len(rows))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = imatch.lexicon(docs, least=least, most=most)
    assert sorted(known) == found.tolist()

    def plain(text):
        numbers = sorted(number(w) for w in terms(text))
        inside = [x for x in numbers if x in known] or numbers
        whole = sum(mix(mix(x + 1) + rank & M) for rank, x in enumerate(inside)) & M
        parts, k = [], 0
        for one_in, subsets in imatch.SUBSETS:
            for _ in range(subsets):
                k += 1
                drawn = [mix(x + 1) * (mix(k) | 1) & M for x in inside]
                part = sum(mix(x) for x in drawn if x < (1 << 64) // one_in) & M
                parts.append(part % 0xFFFF + 1 if part else 0)
        return whole, parts

    texts = [t or "" for _, t in rows]
    got = imatch.fingerprints(texts, found)
    for t, g in zip(texts, got, strict=True):
        whole, parts = plain(t)
        assert g == f"{whole:016x}" + "".join(f"{p:04x}" for p in parts)
    assert got[4] == got[-4] and got[9] == got[-1]
    for i in range(0, len(texts) - 1, 7):
        (_, a), (_, b) = plain(texts[i]), plain(texts[i + 1])
        some = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        want = 1.0 if got[i] == got[i + 1] else sum(x == y for x, y in some) / len(some) if some else 0.0
        assert imatch.likeness(got[i], got[i + 1]) == pytest.approx(want)


def test_lexicon_beyond_its_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(imatch, "LEXICON_TERMS", 3)
    docs = spark.createDataFrame([(i, "a b c d e") for i in range(2)], "doc_id long, text string")
    with pytest.raises(ValueError, match="narrower"):
        imatch.lexicon(docs, most=1.0)


def test_blocks_of_few_rows_hold_every_next_row(spark):
    rows = [(i // 2, f"text {i} " * (i % 5)) for i in range(300)] + [(None, "z"), (None, "y"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tails = defaultdict(list)
    for r in imatch.with_next(docs, rows=10).collect():
        tails[r["block"]].append((r["tail"], r["doc_id"], r["text"]))
    own = Counter((d, t) for some in tails.values() for tail, d, t in some if not tail)
    assert own == Counter((d, t or "") for d, t in rows) and len(tails) > 5


def test_plain_jaccard_links_of_repeated_passages(spark):
    """Texts alike by their sets of shingles though one repeats half of its passages many times."""
    rng = random.Random(1)
    rows = []
    for g in range(40):
        common = [[f"g{g}p{k}w{i}" for i in range(30)] for k in range(6)]
        own = [[f"g{g}o{k}w{i}" for i in range(8)] for k in range(2)]
        one = [w for p in common for w in p] + own[0]
        two = [w for k, p in enumerate(common) for w in p * (rng.choice([15, 25, 40]) if k < 3 else 1)] + own[1]
        rows += [(2 * g, " ".join(one)), (2 * g + 1, " ".join(two))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.8)
    assert sorted(r["doc_id"] for r in got.where("kept").collect()) == sorted(near_groups(rows, 0.8))
    assert len(near_groups(rows, 0.8)) < 60


def test_names_long_texts_and_repeats(spark):
    clash = spark.createDataFrame([(1, "a b c " * 30_000, "b", "x", 1, 2), (1, "a b c " * 30_000, "b", "x", 1, 2), (2, "one two", "h", "y", 3, 4), (None, None, None, None, None, None)], "doc_id long, text string, block string, held string, start long, n_tokens long")
    scored = hmm.score_documents(clash).collect()
    assert sorted(str(r["doc_id"]) for r in scored) == ["1", "1", "2", "None"] and {r["n_tokens"] for r in scored} == {90_001, 3, 1}
    files = token_files.token_files_round_trip(clash, public_tokenizers.path("word_bpe_49k.json"), 1)
    assert files.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and files.count() == 4
    packed = packing.pack_documents(clash, public_tokenizers.path("byte_bpe_50k.json"))
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    marked = licenses.license_report(clash.withColumnRenamed("block", "digest"))
    assert marked.columns == ["doc_id", "digest", "license_id", "notices"] and marked.count() == 4
    mit = dict(licenses.LICENSES)["MIT"]
    long = spark.createDataFrame([(1, mit + " word" * 200_000), (2, "filler line\n" * 100_000 + "Released under the MIT License.\n"), (3, mit)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_report(long).collect()}
    assert [got[k]["license_id"] for k in (1, 2, 3)] == [None, None, "MIT"] and got[2]["notices"] == "MIT"


def test_vectors_with_extra_columns(spark):
    rows = [(1, [1.0, 0.0], "n", 5, "c"), (2, [1.0, 0.01], "n", 5, "c"), (3, [0.0, 1.0], "n", 5, "c")]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string, n long, component_id string"))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
